"""Look-alikes, markup, splitting, tokens: round trips, brute force and the cases every operator must bear."""

from __future__ import annotations

import hashlib
import random
import subprocess
import sys
import unicodedata
from pathlib import Path

import numpy as np
import pytest
from fathomark.llm import lookalike, markup, splitting, tokens
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

# --- look-alikes ---


@pytest.fixture(scope="module")
def letters(spark):
    return tuple(sorted(lookalike.confusable_letters(spark).items()))


def test_letters_come_from_the_unicode_data(letters):
    known = dict(letters)
    assert len(known) > 600 and not any(k < 128 for k in known)
    # Some letters of other scripts and what they look like.
    some = {"A": "ΑАᎪ", "B": "ΒВ", "C": "СᏟ", "E": "ΕЕ", "H": "ΗН", "J": "Ј", "K": "Κ", "O": "ΟО", "P": "ΡР", "T": "ΤТ", "X": "ΧХ", "a": "а", "c": "с", "e": "е", "o": "οо", "p": "рρ", "x": "х", "口": "ロ", "力": "カ"}
    assert all(known.get(ord(c)) == to for to, cs in some.items() for c in cs)


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("Ａｂｃ　１", "Abc 1", True), ("Étude", "Étude", True), ("sen​sor­", "sensor", True), ("a b", "a b", True), ("ｶﾞｰ", "ガー", True),
        ("ｺﾟ", "コ゚", True), ("раper", "paper", True), ("ﬁle", "file", True), ("⼯⽇", "工日", True), ("料", "料", True), ("x²", "x2", False), ("Sensor", "sensor", False),
        ("夕ー夕卜", "ターダト", False), ("デー夕のロボッ卜", "データの口ボット", True), ("Ϲafé", "Café", True), ("ёлка", "ëлка", True), ("Ԁ", "d", False), ("Ι", "I", True), ("l", "I", False), ("0", "O", False), ("rn", "m", False), ("ª", "a", False), ("𝐀", "A", False),
        ("cafe", "café", False), ("a  b", "a b", False), ("a-b", "a_b", False), ("ガ", "カ", False), ("①", "1", False), ("", " ", False),
    ],
)
def test_looks(letters, a, b, same):
    assert (lookalike.look(a, letters) == lookalike.look(b, letters)) is same


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_look_is_stable(letters, text):
    once = lookalike.look(text, letters)
    assert lookalike.look(once, letters) == once and unicodedata.is_normalized("NFC", once)
    assert lookalike.look_all([text, "a\tb", "", text + "ｶﾞ\u200b"], letters) == [once, "a b", "", lookalike.look(text + "ｶﾞ\u200b", letters)]


def test_looks_of_many_are_the_looks_of_each(letters):
    signs = [chr(i) for i in range(0x32000) if not 0xD800 <= i < 0xE000]
    texts = signs + [f"バ{c}ﬃ\u200b{c}" for c in signs[::50]]
    assert lookalike.look_all(texts, letters) == [lookalike.look(t, letters) for t in texts]


def test_pairs_and_classes(spark):
    rows = [("title", "p1", "Note a", 1), ("title", "p2", "Nοte a", 2), ("title", "p3", "Note a", 3), ("title", "p4", "note a", 4), ("title", "p5", None, 5), ("title", None, "Note a", 6), ("tag", "Note a", "Note a", 7), ("title", "p6", "", 8), ("title", "p7", "Note　a", 9)]
    df = spark.createDataFrame(rows + rows[:2], "field string, key string, value string, form int")
    got = {tuple(r) for r in lookalike.look_pairs(df).collect()}
    assert got == {("title", "p1", "p2"), ("title", "p2", "p3"), ("title", "p1", "p7"), ("title", "p3", "p7"), ("title", "p2", "p7")}
    classes = lookalike.look_classes(df).collect()
    assert len({r["class"] for r in classes if r.field == "title"}) == 3 and len(classes) == 7
    digests = [hashlib.md5(t.encode()).digest() for t in ("Note a", "Nοte a", "Note\u3000a")]
    assert {bytes(r.canonical) for r in classes if r.key in ("p1", "p2", "p7") and r.field == "title"} == {min(digests)}
    assert {r.key: bytes(r.vid) for r in classes if r.field == "title"}["p2"] == digests[1]
    assert lookalike.canonical_forms(df).count() == 7
    assert lookalike.look_pairs(df.limit(0)).count() == 0
    shared = spark.createDataFrame([("title", "p", "Note"), ("tag", "Note", "Note"), ("tag", "Nοte", "Nοte"), ("content", "q", "Nοte")], "field string, key string, value string").coalesce(1)
    assert {tuple(r) for r in lookalike.look_pairs(shared).collect()} == {("tag", "Note", "Nοte")} and lookalike.look_classes(shared).count() == 4
    copies = spark.range(2000).select(F.lit("title").alias("field"), F.col("id").cast("string").alias("key"), F.when(F.col("id") == 0, "Ａ").otherwise("A").alias("value"))
    assert lookalike.look_pairs(copies).count() == 1999


def test_the_least_member_stands_for_its_class(spark):
    looks = {"Note a": ("Nοte a", "Note\u3000a", "Ｎote a", "Note a"), "Νοte b": ("Ｎote b", "Νοte b"), "ｶ": ("ｶ",), "ab": ("a\u200bb", "ab")}
    assert any(min(vs, key=lambda v: hashlib.md5(v.encode()).digest()) != t for t, vs in looks.items())  # not the least digests
    rows = [("title", f"{t} {v} {i}", v) for t, vs in looks.items() for v in vs for i in range(3)]
    df = spark.createDataFrame(rows + rows[:5] + [("tag", "Ｎote a", "Ｎote a"), ("title", "none", None), ("title", "", "")], "field string, key string, value string")
    want = {("title", k): next(t for t in looks if v in looks[t]) for _, k, v in rows} | {("tag", "Ｎote a"): "Ｎote a", ("title", ""): ""}
    for out in (lookalike.look_classes(df), lookalike.canonical_forms(df)):
        got = out.collect()
        assert len(got) == len(want) and {(r.field, r.key): r.text for r in got} == want
        assert len({r["class"] for r in got}) == len(looks) + 2
    copies = spark.range(3000).select(F.lit("title").alias("field"), F.col("id").cast("string").alias("key"), F.when(F.col("id") % 3 == 0, "Ａ").otherwise("A").alias("value"))
    assert {tuple(r) for r in lookalike.canonical_forms(copies).groupBy("text").count().collect()} == {("A", 3000)}


# --- markup ---

PAGE = """# Top

Text with $x^2$ and \\(a\\), it costs $3 to $9. Also `echo $HOME $PATH` and \\# no.

Under
=====
Second
------

- one
  - nested **bold**
1. first
* * *
** wiki deep

```sh
# not a heading
- not a list $a$
```

~~~
== no ==
~~~

    indented $b$
    - code

== Wiki '''x''' ==
<h2
 class='c'>Html</h2><ul><li>a<LI>b $y$</ul>
<!-- <h2>old</h2>
- gone -->
% \\section{hidden}
\\section*{Tex} \\begin{itemize}
  \\item i1
\\end{itemize}
\\begin{equation}
e = m
\\end{equation}
<pre><code># c</code></pre>
:<math>z</math> \\ensuremath{q_{1}}
$$
d
$$
==highlight== here
#tag
"""


def test_structure_of_a_page():
    page = markup.parse(PAGE)
    assert dict(zip(markup.KINDS, page.counts, strict=True)) == {"heading": 6, "list": 7, "code": 4, "formula": 7}
    text = page.text
    assert "# Top" in text and "- nested bold" in text and "old" not in text.replace("bold", "") and "hidden" not in text and "```\n# not a heading" in text
    assert "## Html" in text and "- a\n- b $y$" in text and "* *" not in text
    assert markup.parse(PAGE.replace("\n", "\r\n")).counts == page.counts


def test_golden_page():
    page = """<header><ul><li>Home<li>About <b>us</b><ul><li>Team</li></ul></ul></header>
<div class='x'><h2>A <i>title</i></h2><p>One &amp; two, `code <p>`</p>

<table><tr><th>k</th><th>v</th></tr><tr><td>a</td><td>$x<1$</td></tr></table>
<pre>
keep <li> this
</pre></div>
"""
    want = "- Home\n- About us\n  - Team\n\n## A title\n\nOne & two, `code <p>`\n\nk | v\na | $x<1$\n\n```\nkeep <li> this\n```"
    assert markup.parse(page).text == want and markup.parse(page).counts == [1, 3, 1, 1]


def _of_tree(page: str) -> list[str]:
    """Every subtree of well-formed HTML, slowly: tag and contents."""
    import xml.etree.ElementTree as ET

    return [ET.tostring(e, encoding="unicode", short_empty_elements=False).strip() for e in ET.fromstring(f"<root>{page}</root>").iter() if e.tag != "root"]


def test_subtrees_at_every_depth_are_hashed():
    nav = "<nav><ul><li>Home</li><li>About</li></ul></nav>"
    one, two = (markup.parse(f"{nav}<div><p>{x}</p></div>") for x in ("own words", "other words"))
    assert len(one.digests) == 9 and len(set(one.digests) & set(two.digests)) == 6  # nav, ul, two li and their texts
    assert len(_of_tree(nav)) == 4
    whole = next(d for d in one.digests if markup.parse(f"{nav}<div><p>own words</p></div>", {d}).text == "own words")
    left = markup.parse(f"{nav}<div><p>own words</p><ul><li>mine</li></ul></div>", {whole})
    assert left.text == "own words\n\n- mine" and left.counts == [0, 1, 0, 0]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="#-*=`~<>$\\[]{}()\n ab1.|%!lih/\x01\t", max_size=80), st.booleans())
def test_parser_never_fails(text, tags):
    text = text.replace("1", "</li>").replace("l", "<li>").replace("h", "<h2>") if tags else text
    page = markup.parse(text)
    assert all(c >= 0 for c in page.counts)
    none = markup.parse(text, set(page.digests))
    assert none.counts[2:] == [0, 0] and none.text == "" or not page.digests


def test_long_pages_stay_linear():
    import time

    signs = ["`", "$", "<", "[[", "- a\n", "a ", "$a ", "\\begin{verbatim}", "\\begin{align}", "\\[", "\\(", "<pre>", "<pre ", "<math>", "<script>", "<div>", "<ul><li>", "<h1>", "== ", "==a ", "[a](", "\\emph{", "[^", "{{"]
    for sign in signs:
        page = sign * (60_000 // len(sign))
        began = time.process_time()
        markup.parse(page + " " * 30_000 + "x")
        assert time.process_time() - began < 5, sign


def test_structure_and_templates(spark):
    rows = [(f"host/{i}.md", f"Site menu, always the same\n\n# Own {i}\n\n- item\n\n<nav><p>footer</p></nav>") for i in range(30)]
    rows += [("host/0.md", rows[0][1]), ("other/a.md", "Site menu, always the same"), ("n", None), ("e", ""), (None, "# x")]
    corpus = spark.createDataFrame([(p, c, "clash", "h") for p, c in rows], "path string, content string, block string, host string")
    got = {tuple(r) for r in markup.structure(corpus).collect()}
    assert got == {(f"host/{i}.md", "heading", 1) for i in range(30)} | {(None, "heading", 1)}
    texts = {r.path: r.text for r in markup.cleaned(corpus).collect()}
    assert texts["host/3.md"] == "# Own 3" and texts["other/a.md"] == "Site menu, always the same" and "e" not in texts
    assert markup.structure(corpus.limit(0)).count() == 0


@pytest.mark.parametrize("most", [100, 0])  # templates sent to all workers, or joined
def test_planted_templates_go_and_nothing_else_does(spark, most):
    nav = lambda x: f"<nav class='{x}'><ul><li><a href='/'>Home</a></li><li>About\n\nus</li></ul></nav>"
    page = lambda h, i: f"{nav(i % 3) if h != 'plain' else ''}<div><h2>Page {h} {i}</h2><ul><li>point {h} {i}</li></ul>\n\nwords {h} {i}</div>" + (f"<footer>made by {h}</footer>" if i % 3 == 0 else "")
    hosts = {"big": 40, "small": 7, "plain": 9, "tiny": 2}
    rows = [(f"{h}/{i}.md", page(h, i)) for h, n in hosts.items() for i in range(n)]
    corpus = spark.createDataFrame(rows, "path string, content string").repartition(3)
    texts = {r.path: (r.text, r.heading, r.list) for r in markup.stripped(corpus, most=most).collect()}
    for path, text in rows:
        host, i = path.split("/")[0], int(path.split("/")[1][:-3])
        menu = "- Home\n- About\n  us\n\n" if host == "tiny" else ""  # two pages are not many
        foot = f"\n\nmade by {host}" if i % 3 == 0 and host not in ("big",) else ""
        assert texts[path] == (f"{menu}## Page {host} {i}\n\n- point {host} {i}\n\nwords {host} {i}{foot}", 1, 3 if host == "tiny" else 1), text


def test_template_share_is_exact(spark):
    # in host n, one element is in exactly a quarter of 3000 + 4n bodies, another in one fewer
    body = spark.range(20).select(F.col("id").alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), 2999 + 4 * F.col("id"))).alias("body"))
    part = 750 + F.col("n")
    digests = F.array_compact(F.array(F.lit(0), F.col("body") + 10, F.when(F.col("body") < part, 1), F.when(F.col("body") < part - 1, 2)))
    nodes = body.select(F.concat(F.lit("h"), "n").alias("host"), F.xxhash64("n", "body").alias("body"), F.explode(digests).alias("digest"))
    assert {(r.host, r.digest) for r in markup.templates(nodes).collect()} == {(f"h{n}", 1) for n in range(20)}


def test_copies_of_one_body_are_no_template(spark):
    rows = [(f"host/{i}.md", f"# Own {i}\n\ntext {i}") for i in range(10)] + [(f"host/copy{i}.md", "# Copied\n\n- item\n\nbody") for i in range(30)]
    corpus = spark.createDataFrame(rows, "path string, content string")
    got = {tuple(r) for r in markup.structure(corpus).collect()}
    assert got == {(p, "heading", 1) for p, _ in rows} | {(p, "list", 1) for p, _ in rows[10:]}
    assert {r.path: r.text for r in markup.cleaned(corpus).collect()}.keys() == {p for p, _ in rows}


# --- splitting ---


def cut(text, limit=splitting.LIMIT, width=splitting.RANGE):
    """Begin and end of all pieces, range by range, stitched by hand."""
    raw = text.encode() if isinstance(text, str) else text
    out, n, chars, reach = [], 0, 0, splitting.halo(limit, 200)
    while n == 0 or n * width < len(raw):
        base = max(n * width - reach, 0)
        c = splitting.cut_range(raw[base : (n + 1) * width + reach], base, n, len(raw), limit, width=width)
        out += [(a + chars, b + chars) for a, b in zip(c.begin.tolist(), c.end.tolist(), strict=True)]
        chars += c.chars
        n += 1
    assert not isinstance(text, str) or chars == len(text)
    return out


@pytest.mark.parametrize("alphabet", ["a", "ab \n", "あ。い", "a\r\n b.", "é", " ", "\n", "𝒳😀 ", "aé漢😀 .\n"])
def test_pieces_cover_overlap_and_fit(alphabet):
    rng = random.Random(2)
    for size in (0, 1, 1999, 2000, 2001, 2100, 16_384, 16_385, 20_000, 70_001):
        text = "".join(rng.choice(alphabet) for _ in range(size))[:size]
        p = cut(text, width=8192)
        assert p[0][0] == 0 and p[-1][1] == size and all(0 <= b - a <= 2000 for a, b in p)
        assert all(100 <= b - c <= 200 and d > b for (_, b), (c, d) in zip(p, p[1:], strict=False))
        assert (len(p) == 1) == (size <= 2000)


def test_cuts_fall_on_boundaries():
    text = ("Some words make a sentence. " * 30 + "\n\n") * 6
    assert all(text[b - 2 : b] == "\n\n" for _, b in cut(text))
    text = unicodedata.normalize("NFD", "é" * 3000)
    assert all(text[b] != "\u0301" for _, b in cut(text)[:-1])


def test_malformed_bytes_are_cut_too():
    raw = bytes(random.Random(1).choices(range(256), k=40_000))
    p = cut(raw, width=8192)
    assert p[0][0] == 0 and all(b - a <= 2000 for a, b in p) and all(100 <= b - c <= 200 for (_, b), (c, _) in zip(p, p[1:], strict=False))


def test_pieces_in_spark(spark):
    long = "wörd " * 30_000
    corpus = spark.createDataFrame([("a", long, 1), ("a", long, 1), ("b", "x" * 2000, 2), ("c", None, 3), ("d", "", 4), (None, "y" * 2001, 5)], "path string, content string, ord int")
    collected = spark.createDataFrame([("a", "z" * 3000, 1), ("a", "short", 2), ("e", "あ" * 2001, 1), ("f", None, 1)], "path string, text string, collected_at int")
    assert {tuple(r) for r in splitting.oversized(corpus, collected).collect()} == {("corpus", "a"), ("corpus", None), ("collected_notes", "e")}
    rows = splitting.pieces(splitting.vault_items(corpus, collected)).collect()
    mine = sorted((r for r in rows if r.path == "a" and r.item_table == "corpus"), key=lambda r: r.ord)
    assert all(x == y for x, y in zip(mine[::2], mine[1::2], strict=True))  # a repeated row is cut twice
    mine = mine[::2]
    assert [r.ord for r in mine] == list(range(1, len(mine) + 1))
    whole = mine[0].piece
    for r in mine[1:]:
        overlap = len(whole) - r.begin
        assert 100 <= overlap <= 200 and whole[r.begin :] == r.piece[:overlap] and r.end - r.begin == len(r.piece)
        whole += r.piece[overlap:]
    assert whole == long and [r.piece for r in rows if r.path == "d"] == [""]
    assert splitting.oversized(corpus.limit(0), collected.limit(0)).count() == 0
    with pytest.raises(ValueError, match="name"):
        splitting.pieces(corpus.withColumnRenamed("content", "text"))


def test_files_are_cut_by_ranges(spark, tmp_path):
    rng = random.Random(4)
    texts = {"one.txt": "".join(rng.choice("aé漢😀 .\n") for _ in range(90_000)), "sub/two.txt": "short", "empty.txt": "", "a b%.txt": "名 " * 3000}
    for name, text in texts.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text, newline="")
    del texts["empty.txt"]
    rows = splitting.file_pieces(spark, f"file://{tmp_path}", width=16_384).collect()
    for name, text in texts.items():
        mine = sorted((r for r in rows if r.file.endswith("/" + name.rsplit("/", 1)[-1])), key=lambda r: r.ord)
        assert [r.ord for r in mine] == list(range(1, len(mine) + 1)) and all(text[r.begin : r.end] == r.piece and len(r.piece) <= 2000 for r in mine)
        assert (mine[0].begin, mine[-1].end) == (0, len(text)) and all(100 <= x.end - y.begin <= 200 for x, y in zip(mine, mine[1:], strict=False))


def test_a_giant_file_needs_no_more_memory_than_a_range(tmp_path):
    """300 MB are cut by a process that takes 40 MB at most for it."""
    code = f"""
import resource, sys
sys.path.insert(0, {str(Path(__file__).parents[2])!r})
from fathomark.llm import splitting
path = {str(tmp_path / "giant")!r}
line = "Some words of a sentence, and 漢字. ".encode() * 1000
with open(path, "wb") as f:
    for _ in range(300_000_000 // len(line)):
        f.write(line)
    size = f.tell()
reach, width = splitting.halo(), splitting.RANGE
splitting.cut_range(line, 0, 0, len(line))
peak = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
count = chars = 0
with open(path, "rb") as f:
    for n in range(0, -(-size // width), 20):  # every twentieth range; they do not wait for each other
        base = max(n * width - reach, 0)
        f.seek(base)
        c = splitting.cut_range(f.read((n + 1) * width + reach - base), base, n, size)
        count += len(c.begin)
        assert (c.end - c.begin <= 2000).all()
print(count, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - peak) // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, check=True).stdout.split()
    assert int(out[0]) > 6000 and int(out[1]) < 40


# --- tokens ---


@pytest.fixture(scope="module")
def coder():
    return tokens.Encoder()


def reference_ids(texts):
    tiktoken = pytest.importorskip("tiktoken")
    own = tiktoken.Encoding("own", pat_str=r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=tokens.read_ranks(tokens.VOCABULARY), special_tokens={})
    return [own.encode_ordinary(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("'sdmtlvre \n\t09.aé漢　"), st.characters(exclude_categories=("Cs", "Cn", "Co"), max_codepoint=0x2FFF))), max_size=6))
def test_ids_equal_the_public_encoding_and_decode(coder, texts):
    ids, at = coder.batch(texts)
    assert [ids[i:j].tolist() for i, j in zip(at, at[1:], strict=False)] == reference_ids(texts)
    assert coder.counts(texts).tolist() == np.diff(at).tolist()
    assert [coder.decode(ids[i:j]) for i, j in zip(at, at[1:], strict=False)] == texts


def test_giant_texts_are_encoded_in_parts(coder):
    texts = ["some words here, it's fine 123 " * 50, None, "きょう、いぬをみます。ねこもいます。" * 40, "x" * 500, "", "short", "1 2\n 3\t\t4  X.Y " * 60, "A'S 'LL ' s\r\n\r\n" * 40, "漢字、カナ。９！？" * 50]
    a, b = coder.batch(texts), coder.batch(texts, giant=100)
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all()
    assert all("".join(p) == t and (len(p) > 4 or t[0] == "x") for t in texts if t and len(t) > 100 for p in [tokens.parts(t, 100)])


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("'sdmtlvre \n\t09.aéA漢　。、かカ_²")), st.integers(1, 9))
def test_parts_give_the_same_ids(coder, text, most):
    whole = coder._ids([text]).tolist()
    assert [i for p in tokens.parts(text, most) for i in coder._ids([p]).tolist()] == whole


def test_encode_in_spark(spark, coder):
    rows = [(1, None), (2, ""), (3, "<|endoftext|> it's"), (None, "x"), (3, "<|endoftext|> it's"), (4, "long " * 300_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, ids string")
    got = tokens.encode(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r.ids for r in got}
    assert by[1] == [] and by[2] == [] and coder.decode(by[4]) == "long " * 300_000 and max(by[3]) < 50_256
    assert tokens.encode(df.limit(0)).count() == 0
