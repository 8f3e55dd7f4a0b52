"""References to records that do not exist, direct and inherited.

A *reference* points at a key at an instant; a *presence* says from when until when a record with that key exists.
:func:`dangling` finds the references that pointed at nothing; :func:`cascade` carries orphanhood down a graph of
foreign keys until nothing changes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomark.functions.paths import note_part, path_suffixes
from fathomark.operators.ordering import salted_join
from fathomark.session import materialise, scratch_path


def note_presence(notes: DataFrame) -> DataFrame:
    """``path, first_at, gone_at``: a note holds from its first ``ingested_at`` until its ``deleted_at``, if any.

    Notes with a null path are no records; several versions of a note count as one; of several deletions the
    first counts.
    """
    return (
        notes.where(F.col("path").isNotNull())
        .groupBy("path")
        .agg(F.min("ingested_at").alias("first_at"), F.min("deleted_at").alias("gone_at"))
    )


def dangling(refs: DataFrame, presence: DataFrame) -> DataFrame:
    """The rows of ``refs`` (``key, at``, any others) for which no row of ``presence`` (``key, first_at, gone_at``) held.

    Adds ``kind``: ``missing`` if the key never occurs, else ``later`` if a record with it first comes after ``at``,
    else ``deleted``. A null key is no reference. With a null ``at`` only ``missing`` can be told. Rows keep their
    multiplicity. An empty ``presence`` makes every reference ``missing``.

    Arrivals and removals are steps of +1 and -1; a reference holds if the running sum of its key is positive. Only
    the distinct (key, instant) pairs of references are judged, so a bulk import at one instant, or without any, is one
    row there. The sum is taken in two levels, per (key, hour) and within it, so that a key with a third of all rows is
    spread over as many groups as it has hours. The verdicts go back to the references by a salted join.
    """
    bucket = lambda t: F.unix_date(t.cast("date")) * 24 + F.hour(t)  # noqa: E731  (without a time zone)
    lived = F.col("gone_at").isNull() | (F.col("gone_at") > F.col("first_at"))
    known = presence.where(F.col("key").isNotNull()).select("key", F.col("first_at").cast("timestamp_ntz").alias("first_at"), F.col("gone_at").cast("timestamp_ntz").alias("gone_at"))
    none = F.lit(None).cast("timestamp_ntz")
    step = lambda at, delta, first: F.struct(at.alias("t"), F.when(lived & F.col("first_at").isNotNull() & at.isNotNull(), delta).otherwise(0).alias("delta"), first.alias("first_at"))
    steps = known.select("key", F.explode(F.array(step(F.col("first_at"), 1, F.col("first_at")), step(F.col("gone_at"), -1, none))).alias("s"))
    steps = steps.select("key", "s.t", "s.delta", "s.first_at", F.lit(False).alias("asks"))
    asked = refs.where(F.col("key").isNotNull()).withColumn("_t", F.col("at").cast("timestamp_ntz"))
    asks = asked.select("key", F.col("_t").alias("t")).distinct().select("key", "t", F.lit(0).alias("delta"), none.alias("first_at"), F.lit(True).alias("asks"))
    rows = steps.unionByName(asks).withColumn("bucket", F.coalesce(bucket(F.col("t")), F.lit(-(2**30))))
    per_key = Window.partitionBy("key")
    base = (
        rows.groupBy("key", "bucket")
        .agg(F.sum("delta").alias("net"), F.max("first_at").alias("last"), F.max(~F.col("asks")).alias("has"))
        .select(
            "key",
            "bucket",
            F.coalesce(F.sum("net").over(per_key.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"),
            F.max("last").over(per_key).alias("last"),
            F.max("has").over(per_key).alias("has"),
        )
    )
    within = Window.partitionBy("key", "bucket").orderBy("t", "asks").rowsBetween(Window.unboundedPreceding, 0)
    kind = (
        F.when(~F.col("has"), "missing")
        .when(F.col("t").isNull() | (F.col("base") + F.col("sum") > 0), None)
        .when(F.col("last") > F.col("t"), "later")
        .otherwise("deleted")
    )
    # A null instant joins under a stand-in of its own.
    same = lambda c: [F.coalesce(F.col(c), F.lit(0).cast("timestamp").cast("timestamp_ntz")).alias("_at"), F.col(c).isNull().alias("_never")]
    judged = rows.withColumn("sum", F.sum("delta").over(within)).where("asks").join(base, ["key", "bucket"]).select("key", *same("t"), kind.alias("kind")).where(F.col("kind").isNotNull())
    own = [c for c in refs.columns if c != "key"]
    asked = asked.select("key", *same("_t"), F.struct(*own).alias("_own"))
    return salted_join(asked, judged, ["key", "_at", "_never"], ["_own"], SALTS).select("key", "_own.*", "kind").select(*refs.columns, "kind")


#: Tasks over which the references of one key and instant are spread.
SALTS = 8


def vault_references(notes: DataFrame, links: DataFrame, tags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """References of links and tags, and the presence of the keys they use.

    Link keys are path suffixes, tag keys whole paths; a leading letter keeps the two apart.
    """
    lived = note_presence(notes)
    by_suffix = lived.select(F.explode(path_suffixes(F.col("path"))).alias("key"), "first_at", "gone_at")
    presence = by_suffix.select(F.concat(F.lit("s"), "key").alias("key"), "first_at", "gone_at").unionByName(
        lived.select(F.concat(F.lit("p"), "path").alias("key"), "first_at", "gone_at")
    )
    ref = lambda name, ident, key: [F.lit(name).alias("ref_table"), F.col(ident).alias("ref_id"), key.alias("key"), F.col("seen_at").alias("at")]
    refs = links.select(*ref("links", "link_id", F.concat(F.lit("s"), note_part(F.col("target"))))).unionByName(
        tags.select(*ref("tags", "tag_id", F.concat(F.lit("p"), F.col("path"))))
    )
    return refs, presence


def month(at: Column) -> Column:
    """``YYYY-MM`` of an instant without a time zone."""
    return F.substring(at.cast("timestamp_ntz").cast("string"), 1, 7)


def cascade(records: DataFrame, refs: DataFrame, direct: DataFrame) -> DataFrame:
    """Carry orphanhood down a foreign-key graph to its fixpoint.

    ``records``: ``tbl, rid, key`` (key: what children point at, may be null). ``refs``: ``tbl, rid, parent_tbl,
    parent_key``. ``direct``: ``tbl, rid`` and any others of records whose own reference dangles. Gives ``tbl, rid,
    depth`` and the others of ``direct`` (for inherited orphans as ``refs`` has them, null where it does not): depth 0 for
    direct, n for records all of whose parents under a key are orphans of depth below n. Each round is a semi-join of the references with the keys orphaned
    in the round before and an anti-join with what is known; rounds go on until one finds nothing, however many that
    takes. They end, also over cycles, because only new orphans go on. Repeated rows count once; empty tables give an
    empty result.

    Each round is a folder of one written table, so neither the lineage nor the plan grows with the rounds.
    """
    spark = records.sparkSession
    place = scratch_path(spark, "orphans")
    direct.distinct().withColumn("depth", F.lit(0)).write.parquet(f"{place}/0")
    shape = spark.read.parquet(f"{place}/0").schema
    rest = [f.name for f in shape if f.name not in ("tbl", "rid", "depth")]
    held = [c for c in rest if c in refs.columns]
    # Only records that have a key and children can pass orphanhood on: read once, here, for all rounds.
    pointers = materialise(refs.where(F.col("parent_key").isNotNull()).select("tbl", "rid", "parent_tbl", "parent_key", *held).distinct(), "pointers")
    pointed = pointers.select(F.col("parent_tbl").alias("tbl"), F.col("parent_key").alias("key")).distinct()
    holders = materialise(records.where(F.col("key").isNotNull()).select("tbl", "rid", "key").distinct().join(pointed, ["tbl", "key"], "left_semi"), "holders")
    passing = not holders.isEmpty()  # else no orphan has children
    read = lambda *rounds: spark.read.schema(shape).parquet(*[f"{place}/{n}" for n in rounds])
    depth = 0
    while passing and not read(depth).isEmpty():
        known = read(*range(depth + 1)).select("tbl", "rid").distinct()
        touched = holders.join(read(depth).select("tbl", "rid"), ["tbl", "rid"], "left_semi").select("tbl", "key").distinct()
        alive = holders.join(touched, ["tbl", "key"], "left_semi").join(known, ["tbl", "rid"], "left_anti").select("tbl", "key")
        dead = touched.join(alive, ["tbl", "key"], "left_anti").select(F.col("tbl").alias("parent_tbl"), F.col("key").alias("parent_key"))
        fresh = pointers.join(dead, ["parent_tbl", "parent_key"], "left_semi").select("tbl", "rid", *held).distinct().join(known, ["tbl", "rid"], "left_anti")
        depth += 1
        lacking = [F.lit(None).cast(shape[c].dataType).alias(c) for c in rest if c not in held]
        fresh.select("tbl", "rid", *held, *lacking, F.lit(depth).alias("depth")).select(*shape.names).write.parquet(f"{place}/{depth}")
    return read(*range(depth + 1))


#: Child table, its column, and the table whose records it points at (by their path). A link or tag of a note whose
#: collected file is an orphan is one by inheritance, unless it is one itself.
VAULT_KEYS: Sequence[tuple[str, str, str]] = (
    ("links", "path", "collected_notes"),
    ("tags", "path", "collected_notes"),
    ("meta_notes", "path", "collected_notes"),
    ("note_vectors", "path", "collected_notes"),
    ("hits", "path", "note_vectors"),
)
#: Tables that are direct orphans where their parent table has no such path at all. Links, tags and collected notes
#: are judged against the notes, at their instant.
_UNTIMED = ("meta_notes", "note_vectors", "hits")


def vault_orphans(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``tbl, rid, kind, period, depth`` of the orphans among the given tables of a vault, by :func:`cascade`.

    ``tables`` has ``notes, links, tags``, and any of ``collected_notes, meta_notes, note_vectors, hits``; foreign keys
    between tables that are not given do not count. ``kind`` is that of direct orphans; ``period`` is the month of the
    orphan's own instant, null in tables without one.
    """
    ident = {
        "links": ["link_id"], "tags": ["tag_id"], "collected_notes": ["path", "collected_at"], "meta_notes": ["run_id", "path"],
        "note_vectors": ["vec_id"], "hits": ["query_id", "path", "via"],
    }
    rid = {t: F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols)) for t, cols in ident.items()}
    refs, presence = vault_references(tables["notes"], tables["links"], tables["tags"])
    timed = refs.select(F.col("ref_table").alias("tbl"), F.col("ref_id").cast("string").alias("rid"), "key", "at")
    if "collected_notes" in tables:
        c = tables["collected_notes"]
        timed = timed.unionByName(c.select(F.lit("collected_notes").alias("tbl"), rid["collected_notes"].alias("rid"), F.concat(F.lit("p"), "path").alias("key"), F.col("collected_at").alias("at")))
    direct = dangling(timed, presence).select("tbl", "rid", "kind", month(F.col("at")).alias("period"))
    none = timed.limit(0)
    instants = {"links": "seen_at", "tags": "seen_at"}
    pointers = none.select("tbl", "rid", F.lit("").alias("parent_tbl"), F.col("key").alias("parent_key"), F.lit("").alias("period"))
    holders = none.select("tbl", "rid", "key")
    for child, column, parent in VAULT_KEYS:
        if child not in tables or parent not in tables:
            continue
        period = month(F.col(instants[child])) if child in instants else F.lit(None).cast("string")
        own = tables[child].select(F.lit(child).alias("tbl"), rid[child].alias("rid"), F.lit(parent).alias("parent_tbl"), F.col(column).alias("parent_key"), period.alias("period"))
        pointers = pointers.unionByName(own)
        if child in _UNTIMED:
            known = tables[parent].select(F.col("path").alias("parent_key")).distinct()
            lost = own.where(F.col("parent_key").isNotNull()).join(known, "parent_key", "left_anti")
            direct = direct.unionByName(lost.select("tbl", "rid", F.lit("missing").alias("kind"), F.lit(None).cast("string").alias("period")))
    for parent in sorted({p for _, _, p in VAULT_KEYS if p in tables}):
        holders = holders.unionByName(tables[parent].select(F.lit(parent).alias("tbl"), rid[parent].alias("rid"), F.col("path").alias("key")))
    return cascade(holders, pointers, direct)


def direct_orphans(notes: DataFrame, links: DataFrame, tags: DataFrame) -> DataFrame:
    """``ref_table, ref_id, kind, period`` of each link and tag that points at no present note: the cascade's orphans of
    depth 0; distinct rows."""
    found = vault_orphans({"notes": notes, "links": links, "tags": tags}).where("depth = 0")
    return found.select(F.col("tbl").alias("ref_table"), F.col("rid").try_cast("long").alias("ref_id"), "kind", "period").distinct()


def orphan_report(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``ref_table, period, origin, n``: orphan records per table and month, ``direct`` or ``inherited``.

    The month is that of the orphan's own instant; tables without one have none.
    """
    return (
        vault_orphans(tables).select("tbl", "rid", "period", F.when(F.col("depth") == 0, "direct").otherwise("inherited").alias("origin")).distinct()
        .groupBy(F.col("tbl").alias("ref_table"), "period", "origin").agg(F.count("*").alias("n"))
    )
