"""Result rows as text or JSON Lines, and the health report as Markdown."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator, Sequence
from pathlib import Path

NONE_FOUND = "該当するノートが見つかりませんでした。"
_NO_SUMMARY = "(なし — 要約未設定。内容は path を開いて確認)"
NO_ISSUES = "問題のあるノートはありません。"


def line(value: dict) -> str:
    """One JSON line; doubles in full precision."""
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def meta_line(command: str, count: int, **extra: object) -> str:
    return line({"type": "meta", "command": command, "count": count, **extra})


def hit_line(hit: dict) -> str:
    """A hit as JSON: score and via only where there are any, tags always a list."""
    out = {k: hit[k] for k in ("path", "title", "date", "tags", "summary")}
    out["tags"] = list(out["tags"])
    return line(out | {k: hit[k] for k in ("score", "via") if hit.get(k) is not None})


def hit_text(hit: dict) -> str:
    head = f"  {hit['title']}" + (f" ({hit['date']})" if hit["date"] else "")
    if hit.get("score") is not None:
        head += f"  [score: {hit['score']:.4f}" + (f" via {hit['via']}" if hit.get("via") else "") + "]"
    rows = [head, f"    path: {hit['path']}"]
    if hit["tags"]:
        rows.append("    tags: " + ", ".join(hit["tags"]))
    rows.append(f"    summary: {hit['summary'] or _NO_SUMMARY}")
    return "\n".join(rows) + "\n"


def relative_link(path: str, report_dir: Path, root: Path) -> str:
    """A Markdown link from the report's directory to a note, its label and target escaped."""
    to = os.path.relpath(os.path.join(os.path.abspath(root), path), os.path.abspath(report_dir)).replace("\\", "/")
    to = to.replace("%", "%25").replace("#", "%23")
    if any(c in to for c in " ()"):
        to = f"<{to}>"
    label = path.replace("[", "\\[").replace("]", "\\]")
    return f"[{label}]({to})"


def health_report(sections: Sequence[tuple[str, Iterable[tuple[str, str]]]], notes: int, issues: int, report: Path, root: Path) -> Iterator[str]:
    """The lines of the Markdown report: nothing in it depends on when or where it is made."""
    yield from [
        "---", "title: KB health レポート (自動生成)", "tags: [meta, health, auto-generated]", "summary: >-",
        "  fathomark health --md-report が生成する KB 健全性の最新スナップショット。",
        "  内容が変わった時だけ commit する運用を想定 (生成時刻は git log を参照)。",
        "---", "", "# KB health レポート", "", "> 自動生成 (`fathomark health --md-report`)。手編集しない。",
        "> 実行時刻・index 鮮度など揮発情報は含めない (このファイルの差分 = 実質的な状態変化)。", "",
    ]
    for heading, items in sections:
        yield from (f"## {heading}", "")
        for p, d in items:
            yield f"- {relative_link(p, report.absolute().parent, root)}{d}"
        yield ""
    if not sections:
        yield from (NO_ISSUES, "")
    yield f"合計: {notes}ノート中 {issues}件の問題 (重複あり)"
