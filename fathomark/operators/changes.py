"""Processing only what is new or changed: a partitioned change log, a write-ahead plan, and an idempotent sink."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomark.session import scratch_path


def current_rows(collected: DataFrame) -> DataFrame:
    """``path, hash``: per path the row with the greatest ``collected_at`` (of equals, the greatest hash); null paths are no notes."""
    return (
        collected.where(F.col("path").isNotNull())
        .groupBy("path")
        .agg(F.max(F.struct("collected_at", "hash")).alias("m"))
        .select("path", F.col("m.hash").alias("hash"))
    )


def latest_good_run(meta: DataFrame) -> DataFrame:
    """One row ``run_id``: of the runs whose state is ``ok`` and never anything else, the one generated last (of equals or
    without a time, the greatest number). Blanks and letter case in the loosely typed values do not matter. No
    such run gives no row."""
    key = F.regexp_extract("key", r"^\s*run/(\d+)/(state|generated)\s*$", 1)
    what = F.regexp_extract("key", r"^\s*run/(\d+)/(state|generated)\s*$", 2)
    text = F.lower(F.regexp_replace("value", r"(?U)^\s+|\s+$", ""))
    runs = (
        meta.select(key.try_cast("long").alias("run_id"), what.alias("what"), text.alias("text"))
        .where(F.col("run_id").isNotNull())
        .groupBy("run_id")
        .agg(
            F.min(F.when(F.col("what") == "state", F.col("text") == "ok")).alias("ok"),
            F.max(F.when(F.col("what") == "generated", F.col("text").try_cast("double"))).alias("at"),
        )
        .where("ok")
    )
    return runs.orderBy(F.desc_nulls_last("at"), F.desc("run_id")).limit(1).select("run_id")


def note_changes(collected: DataFrame, meta_notes: DataFrame, meta: DataFrame) -> DataFrame:
    """``path, change, digest``: current notes against the latest good run, unchanged notes left out.

    ``added``: not in that run; ``changed``: another digest, or none recorded; ``deleted``: in that run only.
    Digests compare in lower case; a path recorded twice in a run is unchanged if one of its digests agrees.
    Without a good run every note is ``added``.
    """
    digest = lambda c: F.nullif(F.lower(F.trim(F.col(c))), F.lit(""))
    run = F.broadcast(latest_good_run(meta))  # one row at most
    now = current_rows(collected).select("path", digest("hash").alias("digest"), F.lit(1).alias("now"))
    # Both sides are reduced per path before they meet, so a path repeated many times is folded map-side.
    both = (
        meta_notes.where(F.col("path").isNotNull()).join(run, "run_id", "left_semi").select("path", digest("hash").alias("digest"))
        .groupBy("path").agg(F.collect_set("digest").alias("was"))
        .join(now, "path", "full_outer")
    )
    change = (
        F.when(F.col("was").isNull(), "added")
        .when(F.col("now").isNull(), "deleted")
        .when(F.col("digest").isNull() | ~F.array_contains("was", F.col("digest")), "changed")
    )
    return both.select("path", change.alias("change"), "digest").where(F.col("change").isNotNull())


@dataclass
class ChangeFeed:
    """A run over a change log that survives failure without skipping or repeating a record.

    The log is a table ``part, seq, path, change, digest, base``: records spread by key over partitions, numbered within
    each. A batch is planned by writing, ahead of any work, which offsets of which partitions it covers; work
    appends to the sink under the batch's name; a commit marks the end. After a failure the same plan is read back
    and replayed, and readers take each (key, offset) once, so what a dead attempt left behind does no harm. One run at
    a time writes to a feed.
    """

    spark: SparkSession
    root: str

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _names(self, folder: str) -> list[str]:
        fs, p = self._fs(folder)
        return [str(s.getPath().getName()) for s in fs.listStatus(p)] if fs.exists(p) else []

    def _move(self, source: str, target: str) -> None:
        fs, p = self._fs(source)
        if not fs.rename(p, self._fs(target)[1]):
            raise OSError(f"cannot rename {source} to {target}")

    def _read_json(self, name: str):
        fs, p = self._fs(f"{self.root}/{name}")
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _write_json(self, name: str, value) -> None:
        """Atomic: written beside and renamed. What is there already stays: a plan or commit is made once."""
        fs, p = self._fs(f"{self.root}/{name}.tmp")
        out = fs.create(p, True)
        out.write(bytearray(json.dumps(value), "utf-8"))
        out.close()
        if fs.exists(self._fs(f"{self.root}/{name}")[1]):
            fs.delete(p, False)
        else:
            self._move(f"{self.root}/{name}.tmp", f"{self.root}/{name}")

    def log(self) -> DataFrame:
        """All that was appended, also what no batch covers yet."""
        names = [n for n in self._names(f"{self.root}/log") if n.startswith("append-")]
        read = self.spark.read.schema(_LOG)
        return read.parquet(*[f"{self.root}/log/{n}" for n in names]) if names else self.spark.createDataFrame([], _LOG)

    def _ends(self) -> dict[int, int]:
        return {r.part: r.end for r in self.log().groupBy("part").agg((F.max("seq") + 1).alias("end")).collect()}  # one row a partition

    def append_log(self, changes: DataFrame, parts: int) -> DataFrame:
        """Number the changes (``path, change, digest`` and perhaps ``base``) within each partition and add them to the log
        after its present end.

        An append goes by the next batch's number and a digest of its rows. One of that name that is there already
        is this one, tried before, and nothing is added: an append may be repeated until it succeeds. It is written
        aside and renamed, so a dead attempt leaves nothing in the log.
        """
        base = F.col("base").cast("long") if "base" in changes.columns else F.lit(None).cast("long")
        rows = changes.select(F.pmod(F.xxhash64("path"), F.lit(parts)).cast("int").alias("part"), "path", "change", "digest", base.alias("base"))
        ends = self._ends()
        start = F.coalesce(F.create_map(*[F.lit(x) for kv in ends.items() for x in kv])[F.col("part")], F.lit(0)).cast("long") if ends else F.lit(0).cast("long")
        seq = F.row_number().over(Window.partitionBy("part").orderBy("path", "change")) - 1 + start
        aside = f"{self.root}/incoming-{uuid.uuid4().hex}"
        rows.withColumn("seq", seq).select(*_LOG_COLUMNS).write.parquet(aside)
        mark = F.bit_xor(F.xxhash64("path", "change", "digest", "base"))
        r = self.spark.read.schema(_LOG).parquet(aside).agg(F.count("*").alias("n"), mark.alias("mark")).first()
        name = f"append-{self._planned() + 1}-{r.n}-{(r.mark or 0) & (2**64 - 1):x}"
        fs, p = self._fs(aside)
        if r.n == 0 or name in self._names(f"{self.root}/log"):
            fs.delete(p, True)
        else:
            fs.mkdirs(self._fs(f"{self.root}/log")[1])
            self._move(aside, f"{self.root}/log/{name}")
        return self.log()

    def _numbers(self, kind: str) -> list[int]:
        return [int(n[len(kind) + 1 : -5]) for n in self._names(self.root) if n.startswith(f"{kind}-") and n.endswith(".json")]

    def _planned(self) -> int:
        return max(self._numbers("plan"), default=-1)

    def plan(self) -> dict:
        """The batch to run: the uncommitted plan of a failed run as it was, else a new one from the committed offsets."""
        state = self._state()
        planned = self._read_json(f"plan-{state['batch'] + 1}.json")
        if planned:
            return planned
        planned = {"batch": state["batch"] + 1, "from": state["ends"], "to": {str(k): int(v) for k, v in self._ends().items()}}
        self._write_json(f"plan-{planned['batch']}.json", planned)
        return planned

    def pending(self) -> bool:
        """Whether a run has planned a batch and not committed it."""
        return self._planned() > self._state()["batch"]

    def behind(self) -> bool:
        """Whether the log holds what no committed batch covers."""
        return {str(k): int(v) for k, v in self._ends().items()} != self._state()["ends"]

    def batch(self, plan: dict) -> DataFrame:
        """The records that a plan covers; its bounds are two numbers a partition."""
        bounds = [(int(k), int(plan["from"].get(k, 0)), int(v)) for k, v in plan["to"].items()]
        at = self.spark.createDataFrame(bounds or [(-1, 0, 0)], "part int, low long, high long")
        return self.log().join(F.broadcast(at), "part").where("seq >= low and seq < high").drop("low", "high")

    def run(self, work=lambda df: df) -> dict:
        """Plan, do ``work`` on the batch into the sink, commit."""
        plan = self.plan()
        work(self.batch(plan)).withColumn("batch", F.lit(plan["batch"])).write.mode("append").parquet(f"{self.root}/sink")
        self.commit(plan)
        return plan

    def commit(self, plan: dict) -> None:
        """One new file a batch, so that a crash leaves either the old or the new state."""
        self._write_json(f"commit-{plan['batch']}.json", {"batch": plan["batch"], "ends": plan["from"] | plan["to"]})

    def _state(self) -> dict:
        done = self._numbers("commit")
        return self._read_json(f"commit-{max(done)}.json") if done else {"batch": -1, "ends": {}}

    def sink(self) -> DataFrame:
        """What was delivered, each (partition, offset, key) once whatever was replayed."""
        if not self._names(f"{self.root}/sink"):
            return self.spark.createDataFrame([], f"{_LOG}, batch int")
        return self.spark.read.parquet(f"{self.root}/sink").dropDuplicates(["part", "seq", "path"])


_LOG = "part int, seq long, path string, change string, digest string, base long"
_LOG_COLUMNS = [f.split()[0] for f in _LOG.split(", ")]
#: What the log says of a path whose change has been taken back: nothing to do any more.
SETTLED = "settled"


def latest(delivered: DataFrame, run: DataFrame) -> DataFrame:
    """``path, change, digest``: what a log or sink said last (by offset) of each path since the run of ``run``
    (``run_id``, one row at most), settled paths included. A path lies in one partition, so its offsets are in order."""
    since = F.broadcast(run.select(F.col("run_id").cast("long").alias("base")))
    own = delivered.join(since, "base", "left_semi") if not run.isEmpty() else delivered.where(F.col("base").isNull())
    return own.groupBy("path").agg(F.max_by(F.struct("change", "digest"), "seq").alias("m")).select("path", "m.change", "m.digest")


def capture_changes(collected: DataFrame, meta_notes: DataFrame, meta: DataFrame, parts: int = 256, root: str | None = None, work=lambda df: df) -> DataFrame:
    """``path, change`` of the notes to process since the latest good run, delivered through a :class:`ChangeFeed`.

    ``root`` is the feed's folder and stays the same between runs (None: a new one in the shared folder). A call first
    replays the plan of a call that failed, if there is one, without computing its changes anew. Then only what the
    log does not say yet since that good run is appended, planned, worked on and committed: a note whose change is in
    the log already is not worked on again, one that changed again is, and one whose change was taken back is
    recorded as settled. Out comes what the sink says last of each path since the good run. With another good run
    the comparison starts anew.
    """
    spark = collected.sparkSession
    feed = ChangeFeed(spark, root or scratch_path(spark, "changes"))
    if feed.pending():
        feed.run(work)
    run = latest_good_run(meta)
    run = spark.createDataFrame(run.collect(), "run_id long")  # one row at most
    said = latest(feed.log(), run)
    now = note_changes(collected, meta_notes, meta)
    both = now.join(said.select("path", F.col("change").alias("was"), F.col("digest").alias("had")), "path", "full_outer")
    same = F.col("change").eqNullSafe(F.col("was")) & F.col("digest").eqNullSafe(F.col("had"))
    back = F.col("change").isNull() & (F.col("was") == SETTLED)
    base = run.first()
    fresh = both.where(~same & ~back).select("path", F.coalesce("change", F.lit(SETTLED)).alias("change"), "digest", F.lit(base.run_id if base else None).cast("long").alias("base"))
    feed.append_log(fresh, parts)
    if feed.behind():
        feed.run(work)
    return latest(feed.sink(), run).where(F.col("change") != SETTLED).select("path", "change")
