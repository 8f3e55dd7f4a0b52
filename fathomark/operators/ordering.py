"""Running totals and positions over groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomark.session import materialise


def running_before(df: DataFrame, groups: Sequence[str], order: Sequence[Column], weight: Column | int, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``weight`` over the rows of the same group that come before in ``order``.

    The rows are laid out by ranges of (group, order), which cut a group that holds a third of all rows into as
    many pieces as its size asks for; sums are taken within the pieces, and the totals of the pieces, a row each,
    carry them over. Group columns must not be null; rows of equal order get sums in an arbitrary order.
    """
    weight = F.lit(weight) if isinstance(weight, int) else weight
    laid = df.withColumn("_w", weight.cast("long")).repartitionByRange(*[F.col(g) for g in groups], *order).withColumn("_piece", F.spark_partition_id())
    laid = materialise(laid, "ranges")
    totals = laid.groupBy(*groups, "_piece").agg(F.sum("_w").alias("_t"))
    upto = Window.partitionBy(*groups).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*groups, "_piece", F.coalesce(F.sum("_t").over(upto), F.lit(0)).alias("_base"))
    within = Window.partitionBy(*groups, "_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = laid.withColumn("_s", F.coalesce(F.sum("_w").over(within), F.lit(0)))
    return summed.join(totals, [*groups, "_piece"]).withColumn(name, F.col("_s") + F.col("_base")).drop("_s", "_w", "_base", "_piece")


def salted_join(big: DataFrame, small: DataFrame, keys: Sequence[str], spread: Sequence[str], salts: int = 16) -> DataFrame:
    """Inner join of a table with hot keys to one of few rows a key: the big side's rows of a key go to ``salts``
    tasks by a hash of ``spread``, and each row of the small side is repeated as often."""
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"]).drop("_salt")


def hot_join(big: DataFrame, small: DataFrame, keys: Sequence[str], spread: Sequence[str], count: str, total: int, salts: int = 64) -> DataFrame:
    """Inner join of a table with hot keys to one that says, in ``count``, how many of the big side's rows a key has.

    Keys with more than a thousandth of the ``total`` rows, of which there are fewer than a thousand and which are
    broadcast for that reason, are spread over ``salts`` tasks by a hash of ``spread``; only their rows of the small
    side are repeated. ``small`` is read twice, so it should be a written table. Keys must not be null.
    """
    many = F.col(count) * 1000 > F.lit(int(total))
    hot = small.where(many).select(*keys).distinct().withColumn("_hot", F.lit(True))
    left = big.join(F.broadcast(hot), list(keys), "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")).otherwise(0)).drop("_hot")
    right = small.withColumn("_salt", F.explode(F.when(many, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [*keys, "_salt"]).drop("_salt")
