"""Orphan references and change capture: small cases, brute force, nulls, ties, repeated rows, failures."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from fathomark.operators import changes, orphans
from fathomark.operators.ordering import hot_join, running_before
from pyspark.sql import functions as F

NOTES = "path string, ingested_at timestamp_ntz, deleted_at timestamp_ntz, extra string"
LINKS = "link_id long, path string, target string, seen_at timestamp_ntz, kind string"
TAGS = "tag_id long, path string, tag string, seen_at timestamp_ntz"


def day(n: int, hour: int = 0) -> dt.datetime:
    return dt.datetime(2024, 1, 1, hour) + dt.timedelta(days=n)


def brute(notes, links, tags):
    life: dict[str, list] = {}
    for path, at, gone, _ in notes:
        if path is not None:
            first, end = life.get(path, (None, None))
            life[path] = (min(x for x in (first, at) if x) if first or at else None, min((x for x in (end, gone) if x), default=None))
    out = set()
    refs = [("links", i, t, s, None) for i, _, t, s, _ in links] + [("tags", i, None, s, p) for i, p, _, s in tags]
    for name, ident, target, at, path in refs:
        if name == "links":
            part = (target or "").split("#")[0]
            part = part.removesuffix(".md")
            if not part:
                continue
            match = [v for p, v in life.items() if p.removesuffix(".md") == part or p.removesuffix(".md").endswith("/" + part)]
        else:
            if path is None:
                continue
            match = [life[path]] if path in life else []
        if any(f and f <= at and (g is None or at < g) for f, g in match):
            continue
        kind = "missing" if not match else "later" if any(f and f > at for f, _ in match) else "deleted"
        out.add((name, ident, kind, at.strftime("%Y-%m")))
    return out


def test_direct_orphans_agree_with_brute_force(spark):
    rng = random.Random(5)
    names = ["a/x.md", "b/x.md", "a/b/y.md", "z.md", "q.md", "a b.md"]
    notes = [(rng.choice(names), day(rng.randint(0, 60), rng.randint(0, 23)), day(rng.randint(30, 90)) if rng.random() < 0.3 else None, "e") for _ in range(14)]
    notes += notes[:3] + [(None, day(1), None, None)]
    targets = ["x", "a/x", "b/x.md", "y#part", "b/y", "nope", "", "#here", None, "Z", "z.md", "q", ".md", " a b", "a b#", "z.md.md"]
    links = [(i, "s.md", rng.choice(targets), day(rng.randint(0, 90), rng.randint(0, 23)), "clash") for i in range(400)]
    tags = [(i, rng.choice([*names, None, "nope.md"]), rng.choice(["t", None]), day(rng.randint(0, 90))) for i in range(150)]
    links += links[:20]
    got = orphans.direct_orphans(spark.createDataFrame(notes, NOTES), spark.createDataFrame(links, LINKS), spark.createDataFrame(tags, TAGS))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == brute(notes, links, tags)


def test_presence_is_half_open(spark):
    notes = spark.createDataFrame([("n.md", day(5), day(9), "")], NOTES)
    links = spark.createDataFrame([(i, "s", "n", day(i), "") for i in range(4, 11)], LINKS)
    got = {(r.ref_id, r.kind) for r in orphans.direct_orphans(notes, links, spark.createDataFrame([], TAGS)).collect()}
    assert got == {(4, "later"), (9, "deleted"), (10, "deleted")}


def test_empty_notes_make_all_missing_and_empty_references_none(spark):
    links = spark.createDataFrame([(1, "s", "n", day(1), ""), (2, "s", None, day(1), ""), (3, "s", "n", None, "")], LINKS)
    none = spark.createDataFrame([], NOTES)
    got = {(r.ref_id, r.kind, r.period) for r in orphans.direct_orphans(none, links, spark.createDataFrame([], TAGS)).collect()}
    assert got == {(1, "missing", "2024-01"), (3, "missing", None)}
    assert orphans.direct_orphans(none, links.limit(0), spark.createDataFrame([], TAGS)).count() == 0


def test_hot_key_keeps_every_row(spark):
    notes = spark.createDataFrame([("hub.md", day(10), None, "")], NOTES)
    links = spark.range(3000).select(F.col("id").alias("link_id"), F.lit("s").alias("path"), F.lit("hub").alias("target"), F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, cast(id as int))").alias("seen_at"), F.lit("").alias("kind"))
    assert orphans.direct_orphans(notes, links, spark.createDataFrame([], TAGS)).count() == 3000


def test_cascade_reaches_a_fixpoint_over_chains_and_cycles(spark):
    records = spark.createDataFrame([("a", "1", "k1"), ("a", "1b", "k1"), ("b", "2", "k2"), ("c", "3", "k3"), ("c", "4", None), ("d", "5", "k5"), ("d", "6", "k6")], "tbl string, rid string, key string")
    refs = spark.createDataFrame([("b", "2", "a", "k1"), ("c", "3", "b", "k2"), ("c", "4", "c", "k3"), ("d", "5", "d", "k6"), ("d", "6", "d", "k5")], "tbl string, rid string, parent_tbl string, parent_key string")
    one = orphans.cascade(records, refs, spark.createDataFrame([("a", "1")], "tbl string, rid string"))
    assert {(r.tbl, r.rid) for r in one.collect()} == {("a", "1")}  # another record still holds the key
    both = orphans.cascade(records, refs, spark.createDataFrame([("a", "1"), ("a", "1b")], "tbl string, rid string"))
    assert {(r.tbl, r.rid, r.depth) for r in both.collect()} == {("a", "1", 0), ("a", "1b", 0), ("b", "2", 1), ("c", "3", 2), ("c", "4", 3)}
    ring = orphans.cascade(records, refs, spark.createDataFrame([("d", "5")], "tbl string, rid string"))
    assert {(r.rid, r.depth) for r in ring.collect()} == {("5", 0), ("6", 1)}


def test_cascade_agrees_with_a_slow_fixpoint(spark):
    rng = random.Random(8)
    records = [(t, str(i), f"k{rng.randint(0, 29)}" if rng.random() < 0.9 else None) for t in "ab" for i in range(25)]
    refs = [(*rng.choice(records)[:2], rng.choice("ab"), f"k{rng.randint(0, 29)}") for _ in range(90)]
    seeds = {r[:2] for r in rng.sample(records, 18)}
    want = {r: 0 for r in seeds}
    while True:
        holders: dict[tuple, set] = {}
        for t, i, k in records:
            if k is not None:
                holders.setdefault((t, k), set()).add((t, i))
        dead = {k for k, own in holders.items() if own <= want.keys()}
        fresh = {(t, i) for t, i, pt, pk in refs if (pt, pk) in dead} - want.keys()
        if not fresh:
            break
        want |= dict.fromkeys(fresh, max(want.values()) + 1)
    got = orphans.cascade(
        spark.createDataFrame(records + records[:5], "tbl string, rid string, key string"), spark.createDataFrame(refs + refs[:5], "tbl string, rid string, parent_tbl string, parent_key string"),
        spark.createDataFrame(sorted(seeds), "tbl string, rid string"),
    )
    assert {(r.tbl, r.rid): r.depth for r in got.collect()} == want and max(want.values()) > 1


def test_cascade_follows_a_chain_past_a_hundred_rounds(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        many = 104
        records = spark.createDataFrame([("t", str(i), f"k{i}") for i in range(many)], "tbl string, rid string, key string")
        refs = spark.createDataFrame([("t", str(i), "t", f"k{i - 1}") for i in range(1, many)], "tbl string, rid string, parent_tbl string, parent_key string")
        got = orphans.cascade(records, refs, spark.createDataFrame([("t", "0")], "tbl string, rid string"))
        assert {(r.rid, r.depth) for r in got.collect()} == {(str(i), i) for i in range(many)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_links_and_tags_of_an_orphaned_note_are_inherited_orphans(spark):
    notes = spark.createDataFrame([("n.md", day(1), day(3), ""), ("m.md", day(1), None, "")], NOTES)
    links = spark.createDataFrame([(1, "n.md", "m", day(2), ""), (2, "n.md", "nope", day(2), ""), (3, "m.md", "m", day(2), ""), (None, "n.md", "gone", day(2), "")], LINKS)
    tags = spark.createDataFrame([(1, "n.md", "t", day(2)), (2, "n.md", "t", day(5))], TAGS)
    collected = spark.createDataFrame([("n.md", "", "", "h", day(4), ""), ("m.md", "", "", "h", day(4), "")], COLLECTED)
    got = orphans.vault_orphans({"notes": notes, "links": links, "tags": tags, "collected_notes": collected}).collect()
    assert {(r.tbl, r.rid, r.depth) for r in got if r.rid != ""} == {("links", None, 0), ("links", "2", 0), ("tags", "2", 0), ("collected_notes", f"n.md|{day(4)}", 0), ("links", "1", 1), ("tags", "1", 1)}
    assert {r.period for r in got} == {"2024-01"}
    assert {(r.ref_table, r.ref_id) for r in orphans.direct_orphans(notes, links, tags).collect()} == {("links", None), ("links", 2), ("tags", 2)}


def test_a_bulk_import_at_one_instant_keeps_every_row(spark):
    notes = spark.createDataFrame([("hub.md", day(10), None, "")], NOTES)
    links = spark.range(2000).select(F.col("id").alias("link_id"), F.lit("s").alias("path"), F.lit("hub").alias("target"), F.when(F.col("id") % 2 == 0, F.lit(day(1)).cast("timestamp_ntz")).alias("seen_at"), F.lit("").alias("kind"))
    got = orphans.direct_orphans(notes, links, spark.createDataFrame([], TAGS)).collect()
    assert {(r.ref_id, r.kind) for r in got} == {(i, "later") for i in range(0, 2000, 2)}


COLLECTED = "path string, title string, text string, hash string, collected_at timestamp_ntz, change string"
RUNS = "run_id long, path string, title string, hash string"


def tables(spark, collected, runs, meta):
    return spark.createDataFrame(collected, COLLECTED), spark.createDataFrame(runs, RUNS), spark.createDataFrame(meta, "key string, value string")


META = [("run/1/state", "ok"), ("run/1/generated", "10"), ("run/2/state", " OK\n"), ("run/2/generated", "20.5"), ("run/3/state", "failed"), ("run/3/generated", "30"), (None, None), ("run/x/state", "ok"), ("run/2/state", "ok"), ("run/4/state", None)]


def test_changes_compare_with_the_latest_good_run(spark):
    rows = [(p, "t", "x", h, day(d), "clash") for p, h, d in [("same", "AB", 1), ("new", "cd", 1), ("moved", "ef", 1), ("moved", "00", 2), ("bare", "11", 1), ("nullhash", None, 1), (None, "zz", 1)]]
    runs = [(2, "same", "", "ab"), (2, "same", "", "ab"), (2, "moved", "", "EF"), (2, "bare", "", None), (2, "gone", "", "77"), (2, "nullhash", "", "11"), (3, "new", "", "cd"), (1, "old", "", "1"), (2, None, "", "1")]
    got = changes.capture_changes(*tables(spark, rows + rows[:2], runs, META))
    assert sorted(tuple(r) for r in got.collect()) == [("bare", "changed"), ("gone", "deleted"), ("moved", "changed"), ("new", "added"), ("nullhash", "changed")]


def test_embedding_plan_compares_with_the_latest_good_run(spark, tmp_path):
    from fathomark.plans import reference

    rows = [(p, "t", "x", h, day(1), "") for p, h in [("same", "ab"), ("new", "cd")]]
    runs = [(3, "new", "", "cd"), (4, "same", "", "ab"), (4, "gone", "", "77"), (5, "new", "", "cd")]
    meta = [("run/3/state", "ok"), ("run/3/generated", "10"), ("run/4/state", "ok"), ("run/4/generated", "20"), ("run/5/state", "failed"), ("run/5/generated", "30")]
    for name, df in zip(("collected_notes", "meta_notes", "meta"), tables(spark, rows, runs, meta), strict=True):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    assert sorted((r.path, r.action) for r in reference.embed_plan(spark, str(tmp_path)).collect()) == [("gone", "drop"), ("new", "encode"), ("same", "keep")]


@pytest.mark.parametrize("step", ["append_log", "plan", "batch", "commit"])
@pytest.mark.parametrize("after", [False, True])
def test_changes_survive_a_failure_at_each_step(spark, tmp_path, monkeypatch, step, after):
    """The call fails before or after ``step``; the next one delivers each change once, and works on none twice after a commit."""
    root, made = f"file://{tmp_path}/feed", [("run/1/state", "ok")]
    first = tables(spark, [("a", "", "", "1", day(1), ""), ("b", "", "", "2", day(1), "")], [(1, "c", "", "3")], made)
    real = getattr(changes.ChangeFeed, step)

    def fails(self, *args):
        if after:
            real(self, *args)
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(changes.ChangeFeed, step, fails)
        with pytest.raises(OSError, match="lost"):
            changes.capture_changes(*first, parts=4, root=root)
    want = [("a", "added"), ("b", "added"), ("c", "deleted")]
    assert sorted(tuple(r) for r in changes.capture_changes(*first, parts=4, root=root).collect()) == want
    feed = changes.ChangeFeed(spark, root)
    assert sorted((r.path, r.change) for r in feed.sink().collect()) == want and not feed.pending() and not feed.behind()


def test_changes_go_on_from_the_offsets_of_the_call_before(spark, tmp_path):
    root, made = f"file://{tmp_path}/feed", [("run/1/state", "ok")]
    worked: list[list] = []

    def work(df):
        worked.append(sorted((r.path, r.change) for r in df.collect()))
        return df

    def call(collected, runs, meta=made):
        frames = tables(spark, [(p, "", "", h, day(1), "") for p, h in collected], runs, meta)
        return sorted(tuple(r) for r in changes.capture_changes(*frames, parts=4, root=root, work=work).collect())

    runs = [(1, "c", "", "3"), (1, "e", "", "5")]
    assert call([("a", "1"), ("e", "5")], runs) == [("a", "added"), ("c", "deleted")] == worked[-1]
    assert call([("a", "1"), ("e", "5")], runs) == [("a", "added"), ("c", "deleted")] and len(worked) == 1  # nothing anew
    assert call([("a", "2"), ("e", "6")], runs) == [("a", "added"), ("c", "deleted"), ("e", "changed")]
    assert worked[-1] == [("a", "added"), ("e", "changed")]  # changed again, and newly changed
    assert call([("a", "2"), ("e", "5"), ("c", "3")], runs) == [("a", "added")] and worked[-1] == [("c", changes.SETTLED), ("e", changes.SETTLED)]
    later = [*runs, (2, "a", "", "2"), (2, "e", "", "0")]
    assert call([("a", "2"), ("e", "5")], later, [*made, ("run/2/state", "ok")]) == [("e", "changed")] == worked[-1]
    assert call([("a", "2"), ("e", "5")], later, [*made, ("run/2/state", "ok")]) == [("e", "changed")] and len(worked) == 4


def test_a_retried_append_adds_nothing(spark, tmp_path):
    feed = changes.ChangeFeed(spark, f"file://{tmp_path}/feed")
    df = spark.createDataFrame([("a", "added", "1"), ("b", "added", None)], "path string, change string, digest string")
    assert feed.append_log(df, 4).count() == 2 and feed.append_log(df, 4).count() == 2
    other = feed.append_log(spark.createDataFrame([("a", "changed", "2")], df.schema), 4)
    assert sorted((r.path, r.change) for r in other.collect()) == [("a", "added"), ("a", "changed"), ("b", "added")]
    feed.run()
    assert feed.sink().count() == 3 and feed.append_log(df, 4).count() == 5  # after a commit the same change is a new one


def test_without_a_good_run_everything_is_added(spark):
    got = changes.capture_changes(*tables(spark, [("a", "", "", "1", day(1), "")], [(1, "b", "", "1")], [("run/1/state", "failed")]))
    assert [tuple(r) for r in got.collect()] == [("a", "added")]
    assert changes.capture_changes(*tables(spark, [], [], [])).count() == 0


def test_feed_replays_a_failed_batch_without_loss_or_repetition(spark, tmp_path):
    feed = changes.ChangeFeed(spark, f"file://{tmp_path}/feed")
    schema = "path string, change string, digest string"
    feed.append_log(spark.createDataFrame([(f"p{i}", "added", "d") for i in range(20)], schema), 4)
    plan = feed.plan()
    feed.batch(plan).withColumn("batch", F.lit(plan["batch"])).limit(7).write.mode("append").parquet(f"{feed.root}/sink")  # a run that died half way
    feed.append_log(spark.createDataFrame([(f"q{i}", "added", "d") for i in range(5)], schema), 4)
    assert feed.plan() == plan  # the plan written ahead is replayed, not made anew
    feed.run()
    assert sorted(r.path for r in feed.sink().collect()) == sorted(f"p{i}" for i in range(20))
    second = feed.run()
    assert second["batch"] == 1
    assert sorted(r.path for r in feed.sink().collect()) == sorted([*(f"p{i}" for i in range(20)), *(f"q{i}" for i in range(5))])
    feed.commit(second)  # committing again changes nothing
    assert feed.batch(feed.plan()).count() == 0


def test_running_sums_over_ranges(spark):
    rows = [("g", i % 7, i) for i in range(200)] + [("h", 1, 0)]
    df = spark.createDataFrame(rows, "g string, a int, b int").repartition(5)
    got = running_before(df, ["g"], [F.col("a"), F.col("b").desc()], 1, "before").collect()
    want = {}
    for g in "gh":
        for n, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], -r[2]))):
            want[r] = n
    assert {(r.g, r.a, r.b): r.before for r in got} == want


def test_hot_join_keeps_every_row(spark):
    big = spark.range(5000).select(F.when(F.col("id") < 3000, 0).otherwise(F.col("id")).alias("k"), "id")
    small = big.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    got = hot_join(big, small, ["k"], ["id"], "n", 5000, 8).collect()
    assert len(got) == 5000 and {(r.k, r.n, r.least) for r in got if r.k == 0} == {(0, 3000, 0)} and len({r.id for r in got}) == 5000
