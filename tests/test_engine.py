"""The command line over a small vault of our own, and the operators behind it against independent versions."""

from __future__ import annotations

import json
import os
import random
import sqlite3
from pathlib import Path

import pytest
from fathomark import cli
from fathomark.config import Config, ConfigError, find_root, load_config
from fathomark.functions import parse, paths
from fathomark.functions import text as tx
from fathomark.operators import browse, fusion, graph, lexical, vector
from fathomark.render import relative_link
from fathomark.sources import catalog, discover
from fathomark.streaming import ingest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

FILES = {
    "fathomark.toml": "[health]\nmin_words = 10\n",
    "broken/open.md": "---\ntitle: lost\ntags: [x]\n\nno end here\n",
    "notes/plain.md": "Just words without any heading at all, to be named by the file.\n",
    "notes/headed.md": "# Named by heading\n\nSome words follow here, enough of them to pass the lower limit of words.\n",
    "notes/short.md": "---\ntitle: 短い\ndate: 2026-06-01\ntags: [misc]\n---\n\n短い。\n",
    "notes/slam.md": "---\ntitle: SLAM basics\ndate: 2026-05-01\nupdated: 2026-05-02\ntags: [robotics, slam, slam]\nsummary: Mapping and place.\n---\n\n# SLAM\n\nRobots map with SLAM and filters, see [[control]]; it takes many words to say so.\n",
    "notes/control.md": "---\ntitle: Control\ndate: 2026-05-10\ntags: [robotics, control]\nsummary: Loops.\n---\n\nA control loop for robots needs tuning; it takes several words to say all of that.\n",
    "notes/hub.md": "---\ntitle: Hub\ndate: 2026-03-01\nupdated: 2026-03-02\ntags: [links]\nsummary: All links.\n---\n\n[[headed|alias]] [[plain#part]] [[notes/short.md]] [[nowhere]] [[#own]] and enough other words to pass the limit.\n",
    "nested/fathomark.toml": "[scan]\nexclude_dirs = ['drafts']\n",
    "nested/notes/zebra.md": "---\ntitle: Zebra guide\ndate: 2026-04-10\nupdated: 2026-04-12\ntags: [nested]\nsummary: zebra\n---\n\nThe zebra has stripes, and a zebra runs. Words words words words words words words.\n",
    "nested/drafts/zebra.md": "zebra draft\n",
    "nested/inner/.fathomark.toml": "[scan]\nexclude_dirs = ['scratch']\n",
    "nested/inner/deep.md": "---\ntitle: Inner zebra\ndate: 2026-04-05\nupdated: 2026-04-06\ntags: [nested]\nsummary: inner\n---\n\nzebra zebra zebra inside, with a few more words to make it count as long enough.\n",
    "nested/inner/scratch/zebra.md": "zebra scratch\n",
    "README.md": "not a note",
    ".git/x.md": "no note",
    "node_modules/y.md": "no note",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("vault")
    for name, text in FILES.items():
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_text(text)
    return top


@pytest.fixture(scope="module")
def ask(spark, root):
    def run(*argv: str) -> tuple[int, str]:
        out: list[str] = []
        code = cli.main(["--root", str(root), *argv], spark, out.append)
        return code, "\n".join(out)

    assert run("index")[0] == 0
    return run


def test_discovery_follows_nested_rules(root):
    rel = [f.rel for f in discover.note_files(load_config(root))]
    assert rel == sorted((n for n in FILES if n.endswith(".md") and not any(x in n for x in ("drafts", "scratch", "README", ".git", "node_modules"))), key=lambda p: p.split("/"))


def test_find_orders_by_relevance_and_says_so(ask):
    code, out = ask("find", "zebra", "--json")
    rows = [json.loads(x) for x in out.splitlines()]
    assert code == 0 and rows[0] == {"type": "meta", "command": "find", "count": 2, "order": "relevance", "capped": False}
    assert [r["path"] for r in rows[1:]] == ["nested/inner/deep.md", "nested/notes/zebra.md"] and "score" not in rows[1]
    code, out = ask("find", "短い")
    assert code == 0 and out.startswith("全文検索 '短い' の結果 (1件, date 降順 (短語を含み relevance 算出不可)):") and "(なし — 要約未設定" in out
    assert ask("find", "mpc", "1ms") == (1, "全文検索 'mpc 1ms' の結果 (0件, BM25 relevance 順):\n\n該当するノートが見つかりませんでした。")


def test_tag_title_recent_list_tags(ask):
    assert [json.loads(x)["path"] for x in ask("tag", "ROBOT", "--json")[1].splitlines()[1:]] == ["notes/control.md", "notes/slam.md"]
    assert ask("tag", "nothing")[0] == 1 and ask("title", "BASICS")[0] == 0 and ask("recent", "0")[0] == 0
    rows = [json.loads(x) for x in ask("recent", "3", "--json")[1].splitlines()]
    assert [r["path"] for r in rows[1:]] == ["notes/short.md", "notes/control.md", "notes/slam.md"]
    tags = ask("list-tags")[1].splitlines()
    assert tags[0] == "タグ一覧 (6件):" and tags[2:4] == ["  nested (2件)", "  robotics (2件)"]


def test_links_and_backlinks(ask, capsys):
    code, out = ask("links", "hub")
    assert code == 0 and out.startswith("'notes/hub.md' の発リンク (target 4件, 解決 3件 / 未解決 1件):") and out.endswith("  (未解決) [[nowhere]]")
    assert ask("links", "notes/short.md")[0] == 1 and ask("backlinks", "zebra")[0] == 1
    code, out = ask("backlinks", "control")
    assert code == 0 and "notes/slam.md" in out
    assert ask("links", "absent")[0] == 2 and "no note is called 'absent'" in capsys.readouterr().err


def test_health_report_is_complete_and_deterministic(ask, root, tmp_path):
    report = root / "report.txt"
    code, out = ask("health", "--md-report", str(report))
    assert code == 0 and "[frontmatter 破損 (1件)]" in out and "[タグなし (3件)]" in out and "[低ボリューム: < 10 words (2件)]" in out
    first = report.read_bytes()
    ask("health", "--md-report", str(report))
    assert report.read_bytes() == first and b"\r" not in first and b"[broken/open.md](broken/open.md)" in first
    report.unlink()
    assert relative_link("a b/[x]#1%.md", Path("/r/out"), Path("/r")) == r"[a b/\[x\]#1%.md](<../a b/[x]%231%25.md>)"


def test_index_check_and_version_and_bad_config(ask, root, spark, tmp_path, capsys):
    assert ask("index", "--check")[0] == 1
    (tmp_path / "fathomark.toml").write_text("[search]\nbm25_limit = true\n")
    assert cli.main(["--root", str(tmp_path), "find", "x"], spark) == 2 and "bm25_limit" in capsys.readouterr().err
    assert ask("semantic", "x")[0] == 2 and ask("embed")[0] == 2


def test_hybrid_degrades_without_embeddings(ask):
    rows = [json.loads(x) for x in ask("hybrid", "control", "loop", "--json")[1].splitlines()]
    assert rows[0]["degraded"] is True and rows[1]["score"] == 1 / 61 and rows[1]["via"] == "bm25"


def test_embedding_lifecycle(spark, tmp_path):
    cfg = Config(tmp_path, semantic_enabled=True)
    encoder = vector.HashingEncoder(16)
    for n in "abc":
        (tmp_path / f"{n}.md").write_text(f"# Note {n}\n\ntext about {n * 5}\n")
    assert catalog.embed(spark, cfg, encoder) == {"encode": 3}
    assert catalog.embed(spark, cfg, encoder) == {"keep": 3}
    (tmp_path / "b.md").write_text("# Note b\n\nother words\n")
    assert catalog.embed(spark, cfg, encoder) == {"keep": 2, "encode": 1}
    (tmp_path / "c.md").unlink()
    assert catalog.embed(spark, cfg, encoder) == {"keep": 2, "drop": 1}
    assert catalog.stored_embeddings(spark, cfg).count() == 2
    assert catalog.embed(spark, Config(tmp_path, passage_prefix="p: "), encoder) == {"encode": 2}
    (tmp_path / "fathomark.toml").write_text("[semantic]\nenabled = true\nmodel = 'hashing-trigram-16'\n")
    out: list[str] = []
    assert cli.main(["--root", str(tmp_path), "embed"], spark, out.append) == 0
    out.clear()
    assert cli.main(["--root", str(tmp_path), "hybrid", "other words", "--json"], spark, out.append) == 0
    assert json.loads(out[0])["degraded"] is False and any('"via":"bm25+vec"' in line for line in out)
    assert cli.main(["--root", str(tmp_path), "semantic", "other words", "--json"], spark, out.append) == 0
    for n in "ab":
        (tmp_path / f"{n}.md").unlink()
    assert catalog.embed(spark, cfg, encoder) == {} and not cfg.embeddings.exists()


def test_staleness(spark, tmp_path):
    cfg = Config(tmp_path, auto_rebuild=True)
    (tmp_path / "a.md").write_text("# A\n")
    assert catalog.stale(spark, cfg)
    catalog.ensure(spark, cfg)
    assert not catalog.stale(spark, cfg) and catalog.newer_files(spark, cfg) == 0
    os.utime(tmp_path / "a.md", (4e9, 4e9))
    assert catalog.stale(spark, cfg) and catalog.newer_files(spark, cfg) == 1
    os.utime(tmp_path / "a.md", (1, 1))
    (tmp_path / "a.md").rename(tmp_path / "b.md")
    assert catalog.stale(spark, cfg)
    catalog.ensure(spark, cfg)
    assert [r.path for r in catalog.load(spark, cfg, "notes").collect()] == ["b.md"]


def test_config_types(tmp_path):
    assert load_config(tmp_path) == Config(tmp_path)
    for bad in ("[scan]\ninclude = 'x'", "[health]\nmin_words = 1.5", "[health]\ndisable = ['nope']", "scan = 3", "[index]\nauto_rebuild = 1"):
        (tmp_path / ".fathomark.toml").write_text(bad)
        with pytest.raises(ConfigError, match="fathomark.toml"):
            load_config(tmp_path)
    (tmp_path / ".fathomark.toml").write_bytes("﻿[scan]\nexclude_dirs = []\n[search]\nbm25_weight = 1\n".encode())
    cfg = load_config(tmp_path)
    assert cfg.exclude_dirs == {".git", ".fathomark"} and cfg.bm25_weight == 1.0
    (tmp_path / "sub").mkdir()
    assert find_root(cwd=str(tmp_path / "sub")) == tmp_path.resolve()


def test_parsing_rules():
    note = parse.parse_note("\n---\ntitle: 0\ndate: 2024-01-02\ntags: abc\nupdated: yes\n----\n# Head \n", "stem")
    assert (note.title, note.date, note.updated, note.tags, note.issue) == ("Head", "2024-01-02", "yes", ["a", "b", "c"], None)
    assert parse.parse_note("---\ntitle: true\ntags: [1, x, null]\n---\nbody", "s").title == "True"
    held = parse.parse_note("---\ntitle: [a, b, [c, 1e20]]\ntags: [null, [x, y], 1e20, {a: true}, ~, 2024-01-02, 1.50]\ndate: {}\nsummary: {m: 'l1\n\n  l2', e: []}\n---\nb", "s")
    assert held.title == "- a\n- b\n- - c\n  - 1e20" and held.tags == ["null", "- x\n- y", "1e20", "a: true", "null", "2024-01-02", "1.5"]
    assert held.date == "" and held.summary == "m: |-\n  l1\n  l2\ne: []"
    numbers = {1e20: "1e20", 1.0: "1.0", 1e15: "1000000000000000.0", 1e16: "1e16", 0.00001: "0.00001", 1.5e-7: "1.5e-7", -2.5: "-2.5", float("inf"): ".inf", 3: "3"}
    assert {x: parse.number_text(x) for x in numbers} == numbers
    assert parse.parse_note("---\na: 1\na: 2\n---\nb", "s").issue[0] == parse.BAD_YAML
    assert parse.parse_note("---\n- list\n---\nb", "s").content == "b"
    assert parse.frontmatter_issue("---") == (parse.UNCLOSED, "先頭 '---' のみで本文が無い")
    assert parse.frontmatter_issue("---foo\nx") [0] == parse.UNCLOSED
    assert parse.frontmatter_issue("---\na: 1\n----\nx")[0] == parse.UNCLOSED and parse.parse_note("---\na: 1\n----\nx", "s").content == "x"
    assert parse.parse_note("## two\n#  \nx", "s").title == "" and parse.parse_note("#x", "s").title == "s"
    assert parse.decode("﻿a".encode() + b"\xff") == "a�"


def test_columns(spark):
    df = spark.createDataFrame([("[[b|x]] [[a#p]] [[b]] [[ | ]]", "aaaa Straße İ ΣΑΣ ab12 漢字ｶﾅ é")], "body string, t string")
    row = df.select(
        tx.wikilinks(F.col("body")).alias("w"), tx.word_count(F.col("t")).alias("n"), tx.occurrences(tx.fold(F.col("t")), "aa").alias("o"),
        F.length(tx.fold(F.col("t"))).alias("len"), F.length("t").alias("raw"), tx.like_any(F.col("t"), "A_12").alias("wild"), tx.like_any(F.col("t"), "a_12", "literal").alias("lit"),
        paths.note_part(F.lit("a/b.md#x")).alias("part"), paths.note_part(F.lit("#x")).alias("anchor"), tx.trim(F.lit("　 x\n　")).alias("trim"),
    ).first()
    assert row.w == [" ", "a#p", "b"] and row.n == tx.count_words("aaaa Straße İ ΣΑΣ ab12 漢字ｶﾅ é") and row.o == 3 and row.len == row.raw
    assert row.wild and not row.lit and row.part == "a/b" and row.anchor is None and row.trim == "x"


def test_bm25_agrees_with_fts5(spark, tmp_path):
    rng = random.Random(3)
    words = ["alpha", "beta", "aaaa", "Été", "ロボット", "gamma ray", "x"]
    rows = [(f"p{i}", " ".join(rng.choices(words, k=2)), " ".join(rng.choices(words, k=rng.randint(0, 30))) if i % 9 else None) for i in range(120)]
    con = sqlite3.connect(":memory:")
    try:
        con.execute("CREATE VIRTUAL TABLE f USING fts5(path UNINDEXED, title, content, tokenize='trigram')")
    except sqlite3.OperationalError:
        pytest.skip("no trigram tokeniser")
    con.executemany("INSERT INTO f VALUES (?, ?, ?)", [(p, t, c or "") for p, t, c in rows])
    corpus = spark.createDataFrame(rows, "path string, title string, content string").cache()
    index = lexical.postings(corpus)
    lexical.write_postings(corpus, f"file://{tmp_path}/grams", 4)
    lengths = corpus.select("path", lexical.length_in_grams(corpus).alias("len"))
    for terms in (["aaa"], ["alpha", "beta"], ["été"], ["ロボッ"], ["nothing"]):
        match = " AND ".join(f'"{t}"' for t in terms)
        want = dict(con.execute("SELECT path, -rank FROM f WHERE f MATCH ?", (match,)).fetchall())
        stored = lexical.search_stored(spark, f"file://{tmp_path}/grams", terms, -1)
        for got in (lexical.search_bm25(corpus, terms, -1), lexical.search_postings(index, lengths, terms, -1), stored):
            found = {r.path: r.score for r in got.collect()}
            assert found.keys() == want.keys() and all(abs(found[p] - want[p]) < 1e-9 for p in want)


def test_edges_on_random_paths(spark):
    rng = random.Random(1)
    notes = ["/".join(rng.choices("abc", k=rng.randint(1, 4))) + ".md" for _ in range(60)]
    links = [(f"s{i}", "/".join(rng.choices("abcd", k=rng.randint(1, 3))) + rng.choice(["", ".md", "#f"])) for i in range(200)]
    n, l = spark.createDataFrame([(p,) for p in notes + [None]], "path string"), spark.createDataFrame(links + [("s", None), ("s", "")], "path string, target string")
    want = {(s, t, p) for s, t in links for p in notes if ("/" + p.removesuffix(".md")).endswith("/" + t.split("#")[0].removesuffix(".md"))}
    assert {tuple(r) for r in graph.edges(l, n).collect()} == want
    assert {tuple(r) for r in graph.unresolved(l, n).collect()} == {(s, t) for s, t in links if not any(w[:2] == (s, t) for w in want)}


def test_fusion_ties_and_weights(spark):
    lex = spark.createDataFrame([("a", 1), ("b", 2)], "path string, rank long")
    vec = spark.createDataFrame([("c", 1), ("b", 2)], "path string, rank long")
    rows = fusion.reciprocal_rank_fusion(lex, vec, 10, 60, 0.5, 0.5).collect()
    assert [(r.path, r.via) for r in rows] == [("b", "bm25+vec"), ("a", "bm25"), ("c", "vec")]
    assert fusion.weights(0.4, 0.6, False) == (1.0, 0.0) and fusion.weights(0.0, 0.6, False) == (0.0, 0.0)


def test_enrich_drops_missing_notes_and_keeps_clashing_columns_apart(spark):
    notes = spark.createDataFrame([("a", None, "d", None)], "path string, title string, date string, summary string")
    tags = spark.createDataFrame([("a", "y"), ("a", "x"), ("a", "x"), ("a", None), ("z", "q")], "path string, tag string")
    hits = spark.createDataFrame([("a", 1.0, "clash"), ("gone", 2.0, "clash")], "path string, score double, title string")
    row = browse.enrich(hits, notes, tags).collect()
    assert [(r.path, r.title, r.tags, r.summary, r.score) for r in row] == [("a", "", ["x", "y"], "", 1.0)]


def test_encoder_and_dot(spark):
    e = vector.HashingEncoder(8)
    assert abs(float((e.encode(["hello world"]) ** 2).sum()) - 1) < 1e-6 and not e.encode([""]).any()
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", None), ("d", [1.0])], "path string, embedding array<float>")
    assert [(r.path, r.score) for r in vector.nearest(df, [0.5, 1.0], 5).collect()] == [("b", 1.0), ("a", 0.5)]


def test_pooling_leaves_padding_out():
    import numpy as np

    tokens = np.array([[[3.0, 0.0], [0.0, 4.0], [9.0, 9.0]], [[1.0, 1.0], [5.0, 5.0], [5.0, 5.0]]])
    got = vector.mean_pool(tokens, np.array([[1, 1, 0], [0, 0, 0]]))
    assert np.allclose(got[0], [0.6, 0.8]) and not got[1].any()


def test_batches_are_of_similar_length_and_rows_keep_their_vectors(spark, tmp_path):
    class Noting(vector.HashingEncoder):
        def encode(self, texts):
            with open(f"{tmp_path}/batches", "a") as f:
                f.write(json.dumps([len(t) for t in texts]) + "\n")
            return super().encode(texts)

    texts = [("x" * (i * 37 % 50), i) for i in range(20)]
    df = spark.createDataFrame(texts, "text string, i int").coalesce(1)
    got = {r.i: r.embedding for r in vector.encode_column(df, "text", Noting(8), batch=4).collect()}
    plain = vector.HashingEncoder(8).encode([t for t, _ in texts])
    assert all(got[i] == plain[i].tolist() for i in range(20))
    sizes = [json.loads(x) for x in (tmp_path / "batches").read_text().splitlines()]
    assert [n for b in sizes for n in b] == sorted((len(t) for t, _ in texts), reverse=True) and all(len(b) == 4 for b in sizes)


def test_precomputed_vectors():
    e = vector.PrecomputedEncoder({"a": [1.0, 0.0]})
    assert e.dimensions == 2 and e.encode(["a"]).tolist() == [[1.0, 0.0]]
    with pytest.raises(KeyError):
        e.encode(["b"])


def test_tags_are_counted_in_windows_of_file_times(spark, tmp_path):
    source = f"{tmp_path}/in"
    rows = [("a.md", "---\ntags: [x, y]\n---\n", "h", 1), ("b.md", "---\ntags: [x]\n---\n", "h", 1), ("c.md", "---\ntags: [x]\n---\n", "h", 3)]
    df = spark.createDataFrame(rows, "path string, text string, hash string, day int")
    df.select("path", "text", "hash", F.make_timestamp_ltz(F.lit(2030), F.lit(1), F.col("day"), F.lit(5), F.lit(0), F.lit(0)).alias("at")).write.parquet(source)
    counts = ingest.tag_activity(spark.readStream.schema(ingest.FILES).parquet(source))
    counts.writeStream.outputMode("complete").format("memory").queryName("activity").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start().awaitTermination(120)
    assert sorted((r.window.start.day, r.tag, r.n) for r in spark.table("activity").collect()) == [(1, "x", 2), (1, "y", 1), (3, "x", 1)]


def test_streaming_ingestion_takes_each_version_once(spark, tmp_path):
    source, out, point = tmp_path / "in", f"{tmp_path}/out", f"{tmp_path}/point"
    source.mkdir()
    (source / "a.md").write_text("---\ntitle: One\ntags: [t]\n---\nbody")
    (source / "b.md").write_text("# Two")
    ingest.write_notes(ingest.note_stream(spark, f"file://{source}"), out, point).awaitTermination(120)
    (source / "a2.md").write_text("---\ntitle: Three\n---\n")
    ingest.write_notes(ingest.note_stream(spark, f"file://{source}"), out, point).awaitTermination(120)
    assert sorted(r.title for r in ingest.current_notes(spark, out).collect()) == ["One", "Three", "Two"]


def test_streaming_ingestion_keeps_late_notes(spark, tmp_path):
    source, out, point = tmp_path / "in", f"{tmp_path}/out", f"{tmp_path}/point"
    source.mkdir()
    for name, at in (("new.md", 2e9), ("late.md", 1e9), ("newer.md", 2.1e9), ("oldest.md", 5e8)):
        (source / name).write_text(f"# {name}")
        os.utime(source / name, (at, at))
        ingest.write_notes(ingest.note_stream(spark, f"file://{source}"), out, point).awaitTermination(120)
    names = lambda: sorted(r.path.rsplit("/", 1)[1] for r in spark.read.parquet(out).collect())
    assert names() == ["late.md", "new.md", "newer.md", "oldest.md"]


def test_streaming_ingestion_takes_a_version_that_comes_back(spark, tmp_path):
    source, out, point = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/point"
    versions = [("a", 5, 1), ("a", 6, 1), ("b", 7, 2), ("a", 8, 3), ("a", 8, 3), ("c", 1, 4)]  # hash, day, rows then
    for text, day, rows in versions:
        df = spark.createDataFrame([("n.md", f"# {text}", text)] * 2, "path string, text string, hash string")
        df.withColumn("at", F.make_timestamp_ltz(F.lit(2030), F.lit(1), F.lit(day), F.lit(0), F.lit(0), F.lit(0))).write.mode("append").parquet(source)
        ingest.write_notes(spark.readStream.schema(ingest.FILES).parquet(source), out, point).awaitTermination(120)
        assert spark.read.parquet(out).count() == rows
    assert [r.title for r in ingest.current_notes(spark, out).collect()] == ["a"]


def test_entry_without_the_training_text_queries():
    import __spark_entry__ as entry

    names = entry.queries()
    assert entry.oracle_sql().keys() <= names.keys() and "find_bm25_single" in names and "p1_found" in names


def test_stored_search_reads_only_its_trigrams(spark, tmp_path):
    corpus = spark.createDataFrame([(f"p{i}", "t", "alpha beta gamma " * 20 + str(i)) for i in range(50)], "path string, title string, content string")
    lexical.write_postings(corpus, f"file://{tmp_path}", 8)
    rows = lexical.stored_postings(spark, f"file://{tmp_path}", ["beta"])
    assert {r.gram for r in rows.select("gram").distinct().collect()} == {"bet", "eta"}
    plan = rows._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan and "PushedFilters: [In(gram" in plan
    assert lexical.search_stored(spark, f"file://{tmp_path}", ["beta", "gam"], 3).count() == 3
    lexical.write_postings(corpus.limit(0), f"file://{tmp_path}/none", 8)
    assert lexical.search_stored(spark, f"file://{tmp_path}/none", ["beta"], 3).count() == 0


def test_no_text_is_shuffled_by_a_search(spark, tmp_path):
    from fathomark.plans import vault

    spark.createDataFrame([("a", "t", "some words"), ("a", "t", "some words"), ("b", None, None)], "path string, title string, content string").write.parquet(f"{tmp_path}/corpus.parquet")
    rows = vault.corpus_rows(spark, str(tmp_path))
    counted = vault.once(rows, lexical.frequencies(rows, ["words"]))
    assert sorted((r.path, r.len, r.f0) for r in counted.collect()) == [("a", 8, 1), ("b", 0, 0)]
    exchanged = [line for line in counted._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line]
    assert exchanged and not any("content" in line for line in exchanged)


def test_safetensors_round_trip(spark, tmp_path):
    from fathomark.sources import safetensors

    url = f"file://{tmp_path}/m.safetensors"
    rows = spark.createDataFrame([(f"p{i}", [float(i), i / 3, -1.5]) for i in range(500)], "path string, embedding array<float>")
    kept = safetensors.write_matrix(rows.orderBy("path"), url, "vectors", ["path"])
    raw = (tmp_path / "m.safetensors").read_bytes()
    size = int.from_bytes(raw[:8], "little")
    assert json.loads(raw[8 : 8 + size])["vectors"] == {"dtype": "F32", "shape": [500, 3], "data_offsets": [0, 6000]} and len(raw) == 8 + size + 6000
    back = {r.row: r.embedding for r in safetensors.read_matrix(spark, url, "vectors").collect()}
    want = {r.path: r.embedding for r in rows.collect()}
    assert len(back) == 500 and all(back[i] == want[k["path"]] for i, k in enumerate(kept))
    for kind, numbers in (("F64", "<f8"), ("F16", "<f2")):
        import numpy as np

        head = json.dumps({"v": {"dtype": kind, "shape": [2, 2], "data_offsets": [0, 4 * np.dtype(numbers).itemsize]}}).encode()
        (tmp_path / kind).write_bytes(len(head).to_bytes(8, "little") + head + np.array([[1, 2], [3, 0.5]], numbers).tobytes())
        assert [r.embedding for r in safetensors.read_matrix(spark, f"file://{tmp_path}/{kind}", "v").orderBy("row").collect()] == [[1, 2], [3, 0.5]]
    for bad in (b"", b"\xff" * 20, raw[:-1], (2).to_bytes(8, "little") + b"{}"):
        (tmp_path / "bad").write_bytes(bad)
        with pytest.raises(safetensors.FormatError):
            safetensors.read_matrix(spark, f"file://{tmp_path}/bad", "vectors")


def test_stored_matrices_of_other_tools_are_used(spark, tmp_path):
    cfg, encoder = Config(tmp_path, semantic_enabled=True), vector.HashingEncoder(16)
    for n in "abc":
        (tmp_path / f"{n}.md").write_text(f"# Note {n}\n\ntext about {n * 5}\n")
    catalog.embed(spark, cfg, encoder)
    want = sorted((r.path, r.hash, tuple(r.embedding)) for r in catalog.stored_embeddings(spark, cfg).collect())
    catalog.export_matrix(spark, cfg)
    import shutil

    shutil.rmtree(cfg.embeddings / "vectors")
    assert sorted((r.path, r.hash, tuple(r.embedding)) for r in catalog.stored_embeddings(spark, cfg).collect()) == want
    (tmp_path / "b.md").write_text("# Note b\n\nother words\n")
    assert catalog.embed(spark, cfg, encoder) == {"keep": 2, "encode": 1}


# --- behaviours of the command line over vaults of their own ---


def vault_of(tmp_path, files):
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    return tmp_path


def run(spark, root, *argv):
    out: list[str] = []
    return cli.main(["--root", str(root), *argv], spark, out.append), "\n".join(out)


def rels(root):
    return [f.rel for f in discover.note_files(load_config(root))]


def test_the_visible_settings_file_wins(tmp_path, capsys):
    root = vault_of(tmp_path, {"fathomark.toml": "[scan]\nexclude_dirs = ['drafts']\n", ".fathomark.toml": "[scan]\nexclude_dirs = ['notes']\n", "notes/a.md": "a", "drafts/b.md": "b"})
    assert rels(root) == ["notes/a.md"] and "takes precedence" in capsys.readouterr().err


def test_nested_repositories(tmp_path):
    root = vault_of(tmp_path, {
        "fathomark.toml": "[scan]\nexclude_dirs = ['drafts', 'shut']\n", "a.md": "", "drafts/x.md": "",
        "shut/fathomark.toml": "[scan]\n", "shut/never.md": "",  # the parent's exclusion comes before the nested rules
        "sub/fathomark.toml": "[scan]\ninclude = ['.', '../outside', 'vecs/../kept']\n[index]\nembeddings_dir = 'vecs'\n", "sub/drafts/seen.md": "", "sub/vecs/leak.md": "", "sub/kept/k.md": "", "outside/o.md": "",
    })
    assert sorted(rels(root)) == ["a.md", "outside/o.md", "sub/drafts/seen.md", "sub/kept/k.md"]


def test_exclusions_hold_at_any_depth_and_for_included_folders(tmp_path):
    root = vault_of(tmp_path, {"fathomark.toml": "[scan]\ninclude = ['.', 'templates/sub', '../elsewhere']\n", "n/a.md": "", "templates/sub/t.md": "", "n/deep/node_modules/x/y.md": "", "n/.git/z.md": ""})
    assert rels(root) == ["n/a.md"]
    (root / "fathomark.toml").write_text("[scan]\nexclude_dirs = []\n")
    assert rels(root) == ["n/a.md", "n/deep/node_modules/x/y.md", "templates/sub/t.md"]  # .git stays out


def test_broken_nested_settings_end_the_command(spark, tmp_path, capsys):
    root = vault_of(tmp_path, {"fathomark.toml": "[scan]\n", "a.md": "# A", "bad/fathomark.toml": "[scan]\ninclude = 'notes'\n", "bad/b.md": "# B"})
    assert run(spark, root, "index")[0] == 2
    said = capsys.readouterr().err
    assert "bad" in said and "list" in said


def test_rebuilding_does_not_hide_what_health_says(spark, tmp_path, capsys):
    root = vault_of(tmp_path, {"fathomark.toml": "[index]\nauto_rebuild = true\n", "a.md": "# A\n\nquokka"})
    assert run(spark, root, "index")[0] == 0
    (root / "a.md").write_text("# A\n\nwalrus")
    os.utime(root / "a.md", (4e9, 4e9))
    capsys.readouterr()
    assert "[index鮮度]" in run(spark, root, "health")[1] and "anew" not in capsys.readouterr().err
    assert run(spark, root, "find", "walrus")[0] == 0 and "anew" in capsys.readouterr().err
    os.utime(root / "a.md", (1, 1))
    (root / "a.md").rename(root / "b.md")
    assert "b.md" in run(spark, root, "find", "walrus")[1]
    (root / "c.md").write_text("# C\n\nquokka")
    (root / "b.md").unlink()
    assert run(spark, root, "find", "walrus")[0] == 1 and run(spark, root, "find", "quokka")[0] == 0


def test_disabled_checks_are_left_out_of_output_and_report(spark, tmp_path):
    root = vault_of(tmp_path, {"fathomark.toml": "[health]\ndisable = ['frontmatter', 'tags']\n", "a.md": "---\ntitle: x\n\nopen"})
    report = tmp_path / "report.txt"
    code, out = run(spark, root, "health", "--md-report", str(report))
    assert code == 0 and "frontmatter" not in out and "タグなし" not in out and "[要約なし (1件)]" in out
    text = report.read_text()
    assert "タグなし" not in text and "## 要約なし (1件)" in text and text.endswith("合計: 1ノート中 3件の問題 (重複あり)\n")
    assert run(spark, root, "index", "--check")[0] == 1  # the index still tells of broken files
    (root / "fathomark.toml").write_text("[health]\ndisable = ['nope']\n")
    assert run(spark, root, "health")[0] == 2


def test_ambiguous_notes_and_targets(spark, tmp_path, capsys):
    root = vault_of(tmp_path, {"fathomark.toml": "", "x/same.md": "# X", "y/same.md": "# Y", "hub.md": "[[same]] [[x/same]]"})
    assert run(spark, root, "links", "same")[0] == 2
    said = capsys.readouterr().err
    assert "x/same.md" in said and "y/same.md" in said
    code, out = run(spark, root, "links", "hub")
    assert code == 0 and "target 2件, 解決 2件" in out and out.count("path: ") == 2
    assert run(spark, root, "backlinks", "y/same")[0] == 0


def test_output_of_a_first_run_is_pure_json(spark, tmp_path, capsys):
    root = vault_of(tmp_path, {"fathomark.toml": "", "a.md": "---\ntitle: A\nsummary: |\n  one\n  two\ntags: [t]\n---\n\nquokka body"})
    code, out = run(spark, root, "find", "quokka", "--json")
    rows = [json.loads(x) for x in out.splitlines()]
    assert code == 0 and len(rows) == 2 and rows[1]["summary"] == "one\ntwo\n" and "no index yet" in capsys.readouterr().err
    assert [json.loads(x) for x in run(spark, root, "find", "zzzz", "--json")[1].splitlines()] == [{"type": "meta", "command": "find", "count": 0, "order": "relevance", "capped": False}]


def test_a_reader_that_leaves_early_is_no_error(spark, tmp_path):
    root = vault_of(tmp_path, {"fathomark.toml": "", "a.md": "# A\n\nquokka"})
    run(spark, root, "index")

    def closed(_):
        raise BrokenPipeError

    kept = os.dup(1)
    try:
        assert cli.main(["--root", str(root), "find", "quokka"], spark, closed) == 0
    finally:
        os.dup2(kept, 1)
        os.close(kept)


def test_executable_bits_come_from_the_git_index(tmp_path):
    import subprocess

    root = vault_of(tmp_path, {"fathomark.toml": "[health]\nexec_bit_prefixes = ['bin']\n", "bin/no.sh": "#", "bin/yes.sh": "#", "bin/x.txt": "#", "lib/no.sh": "#", "bin/é.sh": "#"})
    os.chmod(root / "bin/yes.sh", 0o755)
    git = lambda *a: subprocess.run(["git", "-C", str(root), *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "-A")
    git("update-index", "--chmod=+x", "bin/yes.sh")
    git("update-index", "--chmod=-x", "bin/no.sh", "bin/é.sh")
    assert sorted(discover.executable_bits(load_config(root))) == [("bin/no.sh", "100644"), ("bin/é.sh", "100644")]


def test_files_that_cannot_be_read_are_reported(spark, tmp_path):
    files = [discover.NoteFile(tmp_path / "gone.md", "gone.md")]
    row = discover.read_files(spark, files).first()
    assert row.text is None and row.hash is None and "gone.md" in row.error


def test_a_local_folder_is_refused_on_a_cluster(monkeypatch):
    from types import SimpleNamespace as Fake

    from fathomark.sources.store import SHARED_VARIABLE, require_shared

    cluster = Fake(sparkContext=Fake(master="spark://host:7077"))
    with pytest.raises(ConfigError, match="local to a machine"):
        require_shared(cluster, "file:///x")
    require_shared(cluster, "hdfs://x/y")
    monkeypatch.setenv(SHARED_VARIABLE, "1")
    require_shared(cluster, "file:///x")


def test_scratch_of_other_applications_is_cleared(spark, tmp_path, monkeypatch):
    from fathomark import session

    monkeypatch.setattr(session, "shared_dir", lambda _: f"file://{tmp_path}")
    (tmp_path / "fathomark/run-old/x").mkdir(parents=True)
    (tmp_path / "fathomark/feeds").mkdir()
    os.utime(tmp_path / "fathomark/run-old", (1, 1))
    assert session.clear_scratch(spark) == 1 and [p.name for p in (tmp_path / "fathomark").iterdir()] == ["feeds"]
