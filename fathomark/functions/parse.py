"""Parsing note files: frontmatter, title, tags, body, and what is wrong with the frontmatter."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

# The delimiters of frontmatter, as parsed and (more strictly) as checked, and what a heading looks like.
_SPLIT = re.compile(r"^-{3,}\s*$", re.M)
_CLOSE = re.compile(r"^---\s*$", re.M)
_OPEN = re.compile(r"-{3,}\s*")
_HEADING = re.compile(r"^#[^\S\n](.+)$", re.M)
UNREADABLE, UNCLOSED, BAD_YAML = "読込不可", "閉じ---欠落", "YAMLエラー"
_ONLY_OPEN = "先頭 '---' のみで本文が無い"
_NO_END = "終端 '---' が無く metadata が silent に喪失する"


class NoteLoader(yaml.SafeLoader):
    """YAML 1.2 scalars: true and false only, no dates, no base-60 numbers; duplicate keys are an error."""


NoteLoader.yaml_implicit_resolvers = {}
for _tag, _pattern, _first in (
    ("tag:yaml.org,2002:bool", r"^(?:true|True|TRUE|false|False|FALSE)$", "tTfF"),
    ("tag:yaml.org,2002:int", r"^[-+]?(?:0|[1-9][0-9]*)$|^0o[0-7]+$|^0x[0-9a-fA-F]+$", "-+0123456789"),
    ("tag:yaml.org,2002:float", r"^[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?$|^[-+]?\.(?:inf|Inf|INF)$|^\.(?:nan|NaN|NAN)$", "-+.0123456789"),
    ("tag:yaml.org,2002:null", r"^(?:~|null|Null|NULL|)$", "~nN\0"),
    ("tag:yaml.org,2002:merge", r"^(?:<<)$", "<"),
):
    NoteLoader.add_implicit_resolver(_tag, re.compile(_pattern), list(_first) if _first[-1] != "\0" else [*_first[:-1], ""])


def _mapping(loader: NoteLoader, node: yaml.MappingNode, deep: bool = False) -> dict:
    seen = set()
    for key, _ in node.value:
        name = (key.tag, getattr(key, "value", None) if isinstance(key, yaml.ScalarNode) else id(key))
        if name in seen:
            raise yaml.constructor.ConstructorError(None, None, f"duplicate key {key.value!r}", key.start_mark)
        seen.add(name)
    return yaml.SafeLoader.construct_mapping(loader, node, deep=True)


def _integer(loader: NoteLoader, node: yaml.ScalarNode) -> int:
    text = node.value
    return int(text, 0) if text[:2] in ("0o", "0x") else int(text)


NoteLoader.add_constructor("tag:yaml.org,2002:map", _mapping)
NoteLoader.add_constructor("tag:yaml.org,2002:int", _integer)


@dataclass
class Parsed:
    """A note file: its fields, whether it can be used, and what the stricter check has against it."""

    title: str = ""
    tags: list[str] = field(default_factory=list)
    date: str = ""
    updated: str = ""
    summary: str = ""
    content: str = ""
    readable: bool = True
    issue: tuple[str, str] | None = None


def decode(raw: bytes) -> str:
    """Lossy UTF-8 without a leading byte-order mark."""
    return raw.decode("utf-8", errors="replace").removeprefix("\ufeff")


def lossy_text(content: Column) -> Column:
    """:func:`decode` of a binary column; Spark's own decoding fails on malformed bytes."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda raw: decode(bytes(raw)), na_action="ignore")

    return run(content)


def truthy(value: object) -> bool:
    """Null, false, zero, empty text and empty collections are not."""
    return bool(value)


def number_text(value: float) -> str:
    """A number as YAML has it: the shortest digits that say it, with a point or an exponent; up to 16 digits before the
    point and up to four zeros behind it are written out."""
    if isinstance(value, int):
        return str(value)
    if value != value:
        return ".nan"
    if value in (float("inf"), float("-inf")):
        return ".inf" if value > 0 else "-.inf"
    sign, digits, exponent = Decimal(repr(value)).as_tuple()
    text = "".join(map(str, digits)).rstrip("0") or "0"
    exponent += len(digits) - len(text)
    point = len(text) + exponent  # digits before the point
    if text == "0":
        out = "0.0"
    elif exponent >= 0 and point <= 16:
        out = text + "0" * exponent + ".0"
    elif 0 < point <= 16:
        out = text[:point] + "." + text[point:]
    elif -5 < point <= 0:
        out = "0." + "0" * -point + text
    else:
        out = text[0] + ("." + text[1:] if len(text) > 1 else "") + f"e{point - 1}"
    return "-" + out if sign else out


class _Dumper(yaml.SafeDumper):
    """Writes what :class:`NoteLoader` reads, in block style."""

    def ignore_aliases(self, data: object) -> bool:
        return True


_Dumper.yaml_implicit_resolvers = NoteLoader.yaml_implicit_resolvers
_Dumper.add_representer(float, lambda d, x: d.represent_scalar("tag:yaml.org,2002:float", number_text(x)))
_Dumper.add_representer(str, lambda d, x: d.represent_scalar("tag:yaml.org,2002:str", x, style="|" if "\n" in x else None))


def scalar_text(value: object) -> str:
    """A YAML value as text: booleans capitalised, numbers by :func:`number_text`, null and collections as YAML writes them."""
    if isinstance(value, bool):
        return "True" if value else "False"
    if isinstance(value, str):
        return value
    if isinstance(value, (int, float)):
        return number_text(value)
    if value is None:
        return "null"
    return yaml.dump(value, Dumper=_Dumper, default_flow_style=False, allow_unicode=True, sort_keys=False, width=float("inf")).rstrip()


def split_frontmatter(text: str) -> tuple[object, str]:
    """Metadata and body of a file's text. Raises :class:`yaml.YAMLError` if the metadata cannot be read.

    The text is trimmed first; its first line must be three or more dashes; the next such line ends the metadata.
    Without one everything is body. Metadata that is no mapping counts as none, but is cut from the body.
    """
    text = text.strip()
    if not _OPEN.fullmatch(text.split("\n", 1)[0]):
        return {}, text
    parts = _SPLIT.split(text, maxsplit=2)
    if len(parts) < 3:
        return {}, text
    meta = yaml.load(parts[1], NoteLoader) if parts[1].strip() else None  # noqa: S506
    return meta if isinstance(meta, dict) else {}, parts[2].strip()


def frontmatter_issue(text: str) -> tuple[str, str] | None:
    """What the check says of a file's text: kind and detail, or nothing. It is stricter than the parser: the file must
    begin with the dashes, and exactly three dashes end the metadata."""
    if not text.startswith("---"):
        return None
    end = text.find("\n")
    if end < 0:
        return UNCLOSED, _ONLY_OPEN
    close = _CLOSE.search(text, end + 1)
    if not close:
        return UNCLOSED, _NO_END
    try:
        yaml.load(text[end + 1 : close.start()], NoteLoader)  # noqa: S506
    except (yaml.YAMLError, ValueError, RecursionError) as e:
        return BAD_YAML, str(e).split("\n", 1)[0]
    return None


def first_heading(body: str) -> str | None:
    """The first level-one heading of a body, trimmed; fenced code is not left out."""
    m = _HEADING.search(body)
    return m.group(1).strip() if m else None


def parse_note(text: str, stem: str) -> Parsed:
    """A file's text as a note: title from the metadata, else the first heading, else the file's stem."""
    out = Parsed(issue=frontmatter_issue(text))
    try:
        meta, out.content = split_frontmatter(text)
    except (yaml.YAMLError, ValueError, RecursionError):
        out.readable = False
        return out
    assert isinstance(meta, dict)
    heading = first_heading(out.content)
    given = meta.get("title")
    out.title = scalar_text(given) if truthy(given) else heading if heading is not None else stem
    tags = meta.get("tags")
    # A text given for the list of tags falls apart into its letters: the documented behaviour of the format.
    items = tags if isinstance(tags, list) else list(tags) if isinstance(tags, str) else []
    out.tags = [scalar_text(t) for t in items]
    for name in ("date", "updated", "summary"):
        value = meta.get(name)
        setattr(out, name, scalar_text(value) if truthy(value) else "")
    return out


NOTE = StructType(
    [
        StructField("title", StringType()), StructField("tags", ArrayType(StringType())), StructField("date", StringType()),
        StructField("updated", StringType()), StructField("summary", StringType()), StructField("content", StringType()),
        StructField("readable", StringType()), StructField("issue", StringType()), StructField("detail", StringType()),
    ]
)


def parse_texts(files: DataFrame, text: str = "text", path: str = "path") -> DataFrame:
    """``files`` with its parsed fields: one pass yields the note and what is wrong with its frontmatter.

    Null texts count as empty files. ``readable`` is false where the metadata cannot be read; such files are no notes.
    """

    @F.pandas_udf(NOTE)
    def run(series: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, paths in series:
            rows = []
            for t, p in zip(texts, paths, strict=True):
                stem = (p or "").rsplit("/", 1)[-1].removesuffix(".md")
                n = parse_note(t if t is not None else "", stem)
                rows.append((n.title, n.tags, n.date, n.updated, n.summary, n.content, "true" if n.readable else "false", *(n.issue or (None, None))))
            yield pd.DataFrame(rows, columns=NOTE.names)

    rest = [c for c in files.columns if c not in NOTE.names]
    return files.withColumn("_n", run(F.col(text), F.col(path))).select(*rest, "_n.*").withColumn("readable", F.col("readable") == "true")
