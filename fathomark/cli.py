"""The command line: twelve commands over a note repository. Exit code 0 with hits, 1 without, 2 on errors."""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Callable, Iterable, Iterator, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomark import __version__, render
from fathomark.config import Config, ConfigError, find_root, load_config
from fathomark.functions.parse import UNREADABLE, parse_texts
from fathomark.operators import browse, fusion, graph, health, lexical, vector
from fathomark.session import local_session, materialise
from fathomark.sources import catalog, discover


class UserError(Exception):
    """Ends the command with exit code 2; the lines go to stderr."""


def encoder_for(cfg: Config) -> vector.Encoder:
    """The encoder a repository names; models that are not installed here are an error, never a silent stand-in."""
    if cfg.model.startswith("hashing-trigram-"):
        return vector.HashingEncoder(int(cfg.model.rsplit("-", 1)[1]))
    raise UserError(f"Error: the model {cfg.model} is not available here")


Rows = Callable[[], Iterable[tuple[str, str]]]


class App:
    """The commands. Result rows are counted first and then fetched a partition at a time, however many there are."""

    def __init__(self, spark: SparkSession, cfg: Config, out: Callable[[str], None] = print):
        self.spark, self.cfg, self.out = spark, cfg, out

    def table(self, name: str) -> DataFrame:
        return catalog.load(self.spark, self.cfg, name)

    def _hits(self, ranked: DataFrame, order: Sequence, without: Sequence[str] = ()) -> tuple[int, Iterator[dict]]:
        """How many rows there are, and their details in order."""
        full = materialise(browse.enrich(ranked, self.table("notes"), self.table("tags")), "hits")
        rows = full.orderBy(*order).drop(*without)
        return full.count(), (r.asDict() for r in rows.toLocalIterator())

    def _show(self, hits: tuple[int, Iterator[dict]], json: bool, head: str, meta: str) -> int:
        count, rows = hits
        if json:
            self.out(meta)
            for h in rows:
                self.out(render.hit_line(h))
        else:
            self.out(head + "\n")
            for h in rows:
                self.out(render.hit_text(h))
            if not count:
                self.out(render.NONE_FOUND)
        return 0 if count else 1

    # --- commands ---

    def index(self, check: bool = False) -> int:
        built = catalog.build(self.spark, self.cfg)
        for path, kind, detail in built.broken:
            print(f"Warning: {path}: {kind}: {detail}", file=sys.stderr)
        self.out(f"インデックスを生成しました: {self.cfg.index}\n  ノート数: {built.notes}\n  タグ数: {built.tags}\n  frontmatter 破損: {len(built.broken)}件")
        return 1 if check and built.broken else 0

    def embed(self, force: bool = False) -> int:
        self._need_semantic()
        counts = catalog.embed(self.spark, self.cfg, encoder_for(self.cfg), force)
        if not counts:
            self.out("対象ノートが見つかりませんでした。")
        elif set(counts) == {"keep"}:
            self.out("すべてのノートが最新です。更新の必要はありません。")
        else:
            self.out(f"埋め込みを保存しました: {self.cfg.embeddings}\n  新規/更新: {counts.get('encode', 0)}件, 再利用: {counts.get('keep', 0)}件, 削除: {counts.get('drop', 0)}件")
        return 0

    def _need_semantic(self) -> None:
        if not self.cfg.semantic_enabled:
            raise UserError("Error: no semantic search in this repository; turn it on by enabled = true under [semantic]")

    def find(self, query: str, json: bool = False) -> int:
        limit = self.cfg.bm25_limit
        found = catalog.find(self.spark, self.cfg, query, limit)
        relevance = found.order == "relevance"
        order = [F.desc("score"), F.asc("path")] if relevance else [F.desc("date"), F.asc("path")]
        hits = self._hits(found.hits, order, ["score"])
        count = hits[0]
        capped = found.capped(count)
        by = "BM25 relevance 順" if relevance else "date 降順 (短語を含み relevance 算出不可)"
        note = f" ※上限到達: 上位{limit}件で打ち切り (全ヒット数は不明)" if capped else ""
        return self._show(hits, json, f"全文検索 '{query}' の結果 ({count}件, {by}){note}:", render.meta_line("find", count, order=found.order, capped=capped))

    def tag(self, keyword: str, json: bool = False) -> int:
        hits = self._hits(browse.by_tag(self.table("notes"), self.table("tags"), keyword), [F.desc("date"), F.asc("path")])
        if not hits[0] and not json:
            self.out(f"タグ '{keyword}' に一致するノートが見つかりませんでした。")
            return 1
        return self._show(hits, json, f"タグ '{keyword}' の検索結果 ({hits[0]}件):", render.meta_line("tag", hits[0]))

    def title(self, keyword: str, json: bool = False) -> int:
        hits = self._hits(browse.by_title(self.table("notes"), keyword), [F.desc("date"), F.asc("path")])
        return self._show(hits, json, f"タイトル '{keyword}' の検索結果 ({hits[0]}件):", render.meta_line("title", hits[0]))

    def recent(self, count: int = 10, json: bool = False) -> int:
        hits = self._hits(browse.recent(self.table("notes"), count), [F.desc("date"), F.asc("path")])
        self._show(hits, json, f"最近のノート (上位{count}件):", render.meta_line("recent", hits[0]))
        return 0

    def list_tags(self, json: bool = False) -> int:
        tags = materialise(browse.tag_counts(self.table("tags")), "tags")
        many = tags.count()
        rows = tags.orderBy(F.desc("count"), F.asc("tag")).toLocalIterator()
        self.out(render.meta_line("list-tags", many) if json else f"タグ一覧 ({many}件):\n")
        for r in rows:
            self.out(render.line({"tag": r.tag, "count": r["count"]}) if json else f"  {r.tag} ({r['count']}件)")
        return 0

    def _query_vector(self, query: str) -> tuple[DataFrame, list[float]]:
        """Stored vectors and the encoded query; what was stored decides on encoder and prefix."""
        meta, stored = catalog.embeddings_meta(self.spark, self.cfg), catalog.stored_embeddings(self.spark, self.cfg)
        if meta is None or stored is None:
            raise UserError("Error: there are no usable embeddings here\n  make them by: fathomark embed")
        encoder = encoder_for(Config(self.cfg.root, model=meta.get("model", self.cfg.model)))
        q = encoder.encode([meta.get("query_prefix", self.cfg.query_prefix) + query])[0].tolist()
        if stored.where(F.size("embedding") != len(q)).limit(1).count():
            raise UserError("Error: the stored embeddings have another length than the query's\n  make them anew by: fathomark embed --force")
        return stored, q

    def semantic(self, query: str, top: int = 5, json: bool = False) -> int:
        self._need_semantic()
        stored, q = self._query_vector(query)
        hits = self._hits(vector.semantic(stored, self.table("notes"), q, top), [F.desc("score"), F.asc("path")])
        return self._show(hits, json, f"セマンティック検索 '{query}' の結果 (上位{top}件):", render.meta_line("semantic", hits[0]))

    def hybrid(self, query: str, top: int = 5, json: bool = False) -> int:
        cfg, depth = self.cfg, top * self.cfg.candidate_factor
        found = catalog.find(self.spark, cfg, query, depth)
        order = [F.desc("score"), F.asc("path")] if found.order == "relevance" else [F.desc("date"), F.asc("path")]
        lex, vec = fusion.ranked(found.hits, order, depth), None
        if cfg.semantic_enabled:
            try:
                stored, q = self._query_vector(query)
                vec = fusion.ranked(vector.nearest(stored, q, depth), [F.desc("score"), F.asc("path")], depth)
            except UserError as e:
                print(f"Warning: without semantic search ({str(e).splitlines()[0]}), by BM25 alone", file=sys.stderr)
        fused = fusion.reciprocal_rank_fusion(lex, vec, top, cfg.rrf_k, cfg.bm25_weight, cfg.vector_weight)
        hits = self._hits(fused, [F.desc("score"), F.asc_nulls_last("bm25_rank"), F.asc_nulls_last("vec_rank")])
        mode = "BM25 + semantic" if vec is not None else "BM25 のみ (semantic 未構築)"
        return self._show(hits, json, f"ハイブリッド検索 '{query}' の結果 (上位{top}件, {mode}):", render.meta_line("hybrid", hits[0], degraded=vec is None))

    def _resolve(self, name: str) -> str:
        found = graph.resolve_note(self.table("notes"), name).orderBy("path")
        some = [r.path for r in found.take(2)]
        if not some:
            raise UserError(f"Error: no note is called '{name}'; name it by its path below the root or by the end of that")
        if len(some) > 1:
            print(f"Error: '{name}' can be any of these notes; name one by its path:", file=sys.stderr)
            for r in found.toLocalIterator():
                print(f"  {r.path}", file=sys.stderr)
            raise UserError("")
        return some[0]

    def links(self, name: str) -> int:
        path = self._resolve(name)
        own = self.table("links").where(F.col("path") == path)
        every = graph.targets(own).count()
        missing = graph.unresolved(own, self.table("notes"))
        lost = missing.count()
        self.out(f"'{path}' の発リンク (target {every}件, 解決 {every - lost}件 / 未解決 {lost}件):\n")
        if not every:
            self.out("wikilink がありません。")
            return 1
        resolved = graph.links_of(own, self.table("notes"), path).select(F.col("resolved").alias("path"), "target")
        for hit in self._hits(resolved, ["target", "path"])[1]:
            self.out(render.hit_text(hit))
        for r in missing.orderBy("target").toLocalIterator():
            self.out(f"  (未解決) [[{r.target}]]")
        return 0

    def backlinks(self, name: str) -> int:
        path = self._resolve(name)
        hits = self._hits(graph.backlinks(self.table("links"), self.table("notes"), path), [F.desc("date"), F.asc("path")])
        return self._show(hits, False, f"'{path}' の被リンク ({hits[0]}件):", "")

    def _broken(self) -> tuple[int, Rows]:
        """Files whose frontmatter is broken, checked where they are read."""
        cfg = self.cfg
        files = [f for f in discover.note_files(cfg) if not f.rel.startswith(cfg.scan_skip_prefixes or ("\0",))]
        read = parse_texts(discover.read_files(self.spark, files))
        unreadable = F.col("hash").isNull()  # the file could not be read at all
        kind = F.when(unreadable, F.lit(UNREADABLE)).otherwise(F.col("issue"))
        broken = materialise(read.select("ord", "path", kind.alias("kind"), F.when(unreadable, F.col("error")).otherwise(F.col("detail")).alias("detail")).where(F.col("kind").isNotNull()), "broken")
        return broken.count(), lambda: ((r.path, f"  -- {r.kind}: {r.detail}") for r in broken.orderBy("ord").toLocalIterator())

    def health(self, report: str | None = None) -> int:
        cfg = self.cfg
        sections: list[tuple[str, int, Rows]] = []
        if "frontmatter" not in cfg.disable:
            many, rows = self._broken()
            sections.append((f"frontmatter 破損 ({many}件)", many, rows))
        modes = [(p, f"  -- index mode {m} (実行bit欠落)") for p, m in discover.executable_bits(cfg)]
        sections.append((f"実行bit欠落 ({len(modes)}件)", len(modes), lambda: modes))
        notes = self.table("notes")
        found = materialise(health.findings(notes, self.table("tags"), cfg.min_words, cfg.quality_skip_prefixes, tuple(cfg.disable)), "findings")
        counts = {r.check: r["count"] for r in found.groupBy("check").count().collect()}  # a row a check
        names = {"tags": "タグなし", "summary": "要約なし", "low_words": f"低ボリューム: < {cfg.min_words} words", "updated": "updated未設定"}
        for check, name in names.items():
            own = health.ordered(found.where(F.col("check") == check))
            words = check == "low_words"
            rows = lambda own=own, words=words: ((r.path, f"  -- {r.title}" + (f" ({r.word_count} words)" if words else "")) for r in own.toLocalIterator())
            sections.append((f"{name} ({counts.get(check, 0)}件)", counts.get(check, 0), rows))
        sections = [s for s in sections if s[1]]
        issues = sum(many for _, many, _ in sections)
        total = notes.where(health.outside(cfg.quality_skip_prefixes)).count()
        for heading, _, items in sections:
            self.out(f"[{heading}]")
            for p, d in items():
                self.out(f"  {p}{d}")
            self.out("")
        newer = catalog.newer_files(self.spark, cfg, cfg.scan_skip_prefixes)
        if newer is None:
            self.out("[index鮮度] 生成時刻が index に無い (旧形式)。fathomark index で再構築を推奨\n")
        elif newer:
            self.out(f"[index鮮度] index 生成後に更新された md が {newer}件。fathomark index で再構築を推奨\n")
        self.out(f"--- 合計: {total}ノート中 {issues}件の問題（重複あり）" if issues else render.NO_ISSUES)
        if report:
            try:
                with open(report, "w", encoding="utf-8", newline="\n") as f:
                    f.writelines(x + "\n" for x in render.health_report([(h, rows()) for h, _, rows in sections], total, issues, Path(report), cfg.root))
            except OSError as e:
                raise UserError(f"Error: the report cannot be written: {e}") from None
            print(f"report written: {report}", file=sys.stderr)
        return 0


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="fathomark")
    p.add_argument("--root")
    p.add_argument("--version", action="version", version=f"fathomark {__version__} (+semantic)")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("index").add_argument("--check", action="store_true")
    sub.add_parser("embed").add_argument("--force", action="store_true")
    for name in ("find", "semantic", "hybrid"):
        c = sub.add_parser(name)
        c.add_argument("words", nargs="+")
        c.add_argument("--json", action="store_true")
        if name != "find":
            c.add_argument("--top", type=int, default=5)
    for name in ("tag", "title"):
        c = sub.add_parser(name)
        c.add_argument("keyword")
        c.add_argument("--json", action="store_true")
    sub.add_parser("list-tags").add_argument("--json", action="store_true")
    c = sub.add_parser("recent")
    c.add_argument("count", nargs="?", type=int, default=10)
    c.add_argument("--json", action="store_true")
    for name in ("links", "backlinks"):
        sub.add_parser(name).add_argument("note")
    sub.add_parser("health").add_argument("--md-report")
    return p


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None, out: Callable[[str], None] = print) -> int:
    a = _parser().parse_args(argv)
    try:
        cfg = load_config(find_root(a.root))
        spark = spark or local_session()
        app = App(spark, cfg, out)
        if a.command not in ("index", "embed"):
            catalog.ensure(spark, cfg, rebuild=a.command != "health")
        run = {
            "index": lambda: app.index(a.check),
            "embed": lambda: app.embed(a.force),
            "find": lambda: app.find(" ".join(a.words), a.json),
            "tag": lambda: app.tag(a.keyword, a.json),
            "title": lambda: app.title(a.keyword, a.json),
            "semantic": lambda: app.semantic(" ".join(a.words), a.top, a.json),
            "hybrid": lambda: app.hybrid(" ".join(a.words), a.top, a.json),
            "list-tags": lambda: app.list_tags(a.json),
            "recent": lambda: app.recent(a.count, a.json),
            "links": lambda: app.links(a.note),
            "backlinks": lambda: app.backlinks(a.note),
            "health": lambda: app.health(a.md_report),
        }
        return run[a.command]()
    except ConfigError as e:
        print(f"Error: {e}", file=sys.stderr)
        return 2
    except UserError as e:
        if str(e):
            print(e, file=sys.stderr)
        return 2
    except BrokenPipeError:
        # The reader left early: not an error of ours.
        os.dup2(os.open(os.devnull, os.O_WRONLY), sys.stdout.fileno())
        return 0


if __name__ == "__main__":
    sys.exit(main())
