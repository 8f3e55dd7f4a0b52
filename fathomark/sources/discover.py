"""Finding note files: included roots, exclusions, nested repositories; and reading them as a DataFrame."""

from __future__ import annotations

import hashlib
import os
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from fathomark.config import Config, config_file, load_config
from fathomark.functions.parse import decode, lossy_text
from fathomark.sources.store import require_shared


@dataclass(frozen=True)
class NoteFile:
    path: Path
    rel: str


def note_files(cfg: Config) -> list[NoteFile]:
    """The note files below a root, by path components within each included directory; of repeated ones the first."""
    seen: dict[str, NoteFile] = {}
    for f in _included(cfg, cfg.root):
        seen.setdefault(f.rel, f)
    return list(seen.values())


def _included(cfg: Config, top: Path) -> Iterator[NoteFile]:
    """Files of one repository's rules, with paths relative to ``top``."""
    home = cfg.root.resolve()
    for item in cfg.include:
        start = (home / item).resolve()
        if not start.is_dir() or not start.is_relative_to(home):
            continue
        if any(part in cfg.exclude_dirs for part in start.relative_to(home).parts):
            continue
        found = list(_walk(cfg, home, start, top.resolve(), start == home))
        yield from sorted(found, key=lambda f: f.rel.split("/"))


def _walk(cfg: Config, home: Path, directory: Path, top: Path, own: bool) -> Iterator[NoteFile]:
    """A directory that has its own settings file is walked by them; the parent's exclusions end at its entrance."""
    if not own and directory != home and config_file(directory, warn=False):
        yield from _included(load_config(directory), top)
        return
    try:
        entries = list(os.scandir(directory))
    except OSError:
        return
    for e in entries:
        if e.is_dir(follow_symlinks=False):
            if e.name not in cfg.exclude_dirs:
                yield from _walk(cfg, home, Path(e.path), top, False)
        elif e.name.endswith(".md") and e.is_file() and e.name not in cfg.exclude_files:
            inside = Path(e.path).relative_to(home).as_posix()
            if not any(inside.startswith(p + "/") for p in cfg.excluded_prefixes):
                yield NoteFile(Path(e.path), Path(e.path).relative_to(top).as_posix())


def paths_digest(paths: list[str]) -> str:
    """SHA-256 of the sorted paths, a line each."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def modified_at(path: Path) -> float:
    try:
        return path.stat().st_mtime_ns / 1e9
    except OSError:
        return 0.0


def read_files(spark: SparkSession, files: list[NoteFile]) -> DataFrame:
    """``path, text, hash, ord, error``: lossy text and SHA-256 of each file, read by the executors.

    The listing travels, the contents are read where they are parsed; a file that cannot be read has a null text and hash.
    """
    for f in files[:1]:
        require_shared(spark, f"file://{f.path}")
    listing = spark.createDataFrame([(f.rel, str(f.path), i) for i, f in enumerate(files)], "path string, file string, ord long")

    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, file, order in zip(*(c.to_pylist() for c in b.columns), strict=True):
                try:
                    raw = Path(file).read_bytes()
                    row = (path, decode(raw), hashlib.sha256(raw).hexdigest(), order, None)
                except OSError as e:
                    row = (path, None, None, order, str(e))
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=["path", "text", "hash", "ord", "error"])

    parts = max(1, min(len(files) // 64, 4 * spark.sparkContext.defaultParallelism))
    return listing.repartition(parts).mapInArrow(run, "path string, text string, hash string, ord long, error string")


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """``path, text, hash``: every ``.md`` below a folder of any file system Spark reads, without repository rules."""
    from pyspark.sql import functions as F

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).load(folder)
    return files.select("path", lossy_text(F.col("content")).alias("text"), F.sha2("content", 256).alias("hash"), "modificationTime")


def executable_bits(cfg: Config) -> list[tuple[str, str]]:
    """Tracked shell scripts below the configured prefixes whose mode in git's index is not executable; silent without git."""
    if not cfg.exec_bit_prefixes:
        return []
    try:
        args = ["git", "-C", str(cfg.root), "-c", "core.quotepath=off", "ls-files", "-s", "--", *cfg.exec_bit_prefixes]
        out = subprocess.run(args, capture_output=True, check=True).stdout.decode("utf-8", errors="replace")
    except (OSError, subprocess.CalledProcessError):
        return []
    rows = [line.partition("\t") for line in out.splitlines()]
    return [(path, head.split()[0]) for head, _, path in rows if path.endswith(".sh") and head.split()[:1] != ["100755"]]
