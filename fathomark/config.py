"""Settings of a note repository: a strictly typed TOML file at its root."""

from __future__ import annotations

import os
import subprocess
import sys
import tomllib
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from fathomark.operators.health import CHECKS

#: The visible name wins over the dotfile.
FILES = ("fathomark.toml", ".fathomark.toml")
ROOT_VARIABLE = "FATHOMARK_ROOT"
OUTPUT = ".fathomark"
# Directories and files that are no notes unless the settings say otherwise.
EXCLUDE_DIRS = (
    ".obsidian", ".claude", ".agents", ".codex", ".cursor", ".gemini", ".git", ".venv", "__pycache__", "node_modules", "templates", "dist", "build",
)
EXCLUDE_FILES = ("README.md", "CLAUDE.md", "AGENTS.md", "GEMINI.md")
ALWAYS_EXCLUDED = (".git", OUTPUT)


class ConfigError(Exception):
    """A setting of the wrong type or an unknown check; the message names the file."""


@dataclass(frozen=True)
class Config:
    root: Path
    include: tuple[str, ...] = (".",)
    exclude_dirs: frozenset[str] = frozenset((*EXCLUDE_DIRS, *ALWAYS_EXCLUDED))
    exclude_files: frozenset[str] = frozenset(EXCLUDE_FILES)
    index_path: str = f"{OUTPUT}/index"
    embeddings_dir: str = f"{OUTPUT}/embeddings"
    auto_rebuild: bool = False
    semantic_enabled: bool = False
    model: str = "hashing-trigram-64"
    query_prefix: str = "query: "
    passage_prefix: str = "passage: "
    bm25_limit: int = 50
    rrf_k: int = 60
    bm25_weight: float = 0.4
    vector_weight: float = 0.6
    candidate_factor: int = 4
    scan_skip_prefixes: tuple[str, ...] = ()
    quality_skip_prefixes: tuple[str, ...] = ()
    min_words: int = 50
    exec_bit_prefixes: tuple[str, ...] = ()
    disable: frozenset[str] = field(default_factory=frozenset)

    @property
    def index(self) -> Path:
        return self.root / self.index_path

    @property
    def embeddings(self) -> Path:
        return self.root / self.embeddings_dir

    def url(self, path: str) -> str:
        """Where an output lies: as it is named, if by a URI, else below the root."""
        return path if "://" in path else f"file://{self.root / path}"

    @property
    def excluded_prefixes(self) -> tuple[str, ...]:
        """Root-relative places of the outputs; what lies below them is no note. Outputs elsewhere exclude nothing."""
        out = []
        for p in (self.index, self.embeddings):
            rel = os.path.relpath(os.path.normpath(p), os.path.normpath(self.root)).replace("\\", "/")
            if rel != "." and not rel.startswith("../") and rel != "..":
                out.append(rel)
        return tuple(out)


def config_file(directory: Path, warn: bool = True) -> Path | None:
    """The settings file of a directory, if it has one."""
    found = [directory / name for name in FILES if (directory / name).is_file()]
    if len(found) > 1 and warn:
        print(f"Warning: {found[0]} takes precedence over {found[1].name}", file=sys.stderr)
    return found[0] if found else None


def find_root(given: str | None = None, cwd: str | None = None) -> Path:
    """The repository's root: as given, from the environment, upward to a settings file, or the git root."""
    for choice in (given, os.environ.get(ROOT_VARIABLE)):
        if choice:
            path = Path(choice)
            if not path.is_dir():
                raise ConfigError(f"{choice} is not a directory")
            return path.resolve()
    here = Path(cwd or os.getcwd()).resolve()
    for directory in (here, *here.parents):
        if config_file(directory, warn=False):
            return directory
    try:
        out = subprocess.run(["git", "-C", str(here), "rev-parse", "--show-toplevel"], capture_output=True, check=True)
        return Path(out.stdout.decode("utf-8").strip())
    except (OSError, subprocess.CalledProcessError):
        raise ConfigError(f"no root: give --root, set {ROOT_VARIABLE}, or put a {FILES[0]} there") from None


def _texts(value: object) -> tuple[str, ...]:
    if not isinstance(value, list) or not all(isinstance(v, str) for v in value):
        raise TypeError("a list of strings")
    return tuple(value)


def _of(kind: type, name: str) -> Callable:
    def check(value: object):
        if type(value) is not kind:  # a bool is no int
            raise TypeError(name)
        return value

    return check


def _number(value: object) -> float:
    if type(value) not in (int, float):
        raise TypeError("a number")
    return float(value)


_text, _flag, _whole = _of(str, "a string"), _of(bool, "true or false"), _of(int, "an integer")
_KEYS: dict[tuple[str, str], tuple[str, Callable]] = {
    ("scan", "include"): ("include", _texts), ("scan", "exclude_dirs"): ("exclude_dirs", _texts), ("scan", "exclude_files"): ("exclude_files", _texts),
    ("index", "path"): ("index_path", _text), ("index", "embeddings_dir"): ("embeddings_dir", _text), ("index", "auto_rebuild"): ("auto_rebuild", _flag),
    ("semantic", "enabled"): ("semantic_enabled", _flag), ("semantic", "model"): ("model", _text),
    ("semantic", "query_prefix"): ("query_prefix", _text), ("semantic", "passage_prefix"): ("passage_prefix", _text),
    ("search", "bm25_limit"): ("bm25_limit", _whole), ("search", "rrf_k"): ("rrf_k", _whole), ("search", "bm25_weight"): ("bm25_weight", _number),
    ("search", "vector_weight"): ("vector_weight", _number), ("search", "candidate_factor"): ("candidate_factor", _whole),
    ("health", "scan_skip_prefixes"): ("scan_skip_prefixes", _texts), ("health", "quality_skip_prefixes"): ("quality_skip_prefixes", _texts),
    ("health", "min_words"): ("min_words", _whole), ("health", "exec_bit_prefixes"): ("exec_bit_prefixes", _texts), ("health", "disable"): ("disable", _texts),
}


def load_config(root: Path) -> Config:
    """The settings at ``root``; a missing file or key means the default, a wrong type is an error."""
    path = config_file(root)
    if not path:
        return Config(root)
    try:
        data = tomllib.loads(path.read_bytes().decode("utf-8").removeprefix("\ufeff"))
    except (OSError, ValueError) as e:
        raise ConfigError(f"{path}: {e}") from None
    values: dict[str, object] = {}
    for section in {s for s, _ in _KEYS}:
        if section in data and not isinstance(data[section], dict):
            raise ConfigError(f"{path}: [{section}] must be a table")
    for (section, key), (name, check) in _KEYS.items():
        if key in data.get(section, {}):
            try:
                values[name] = check(data[section][key])
            except TypeError as e:
                raise ConfigError(f"{path}: {section}.{key} must be {e}") from None
    if "exclude_dirs" in values:
        values["exclude_dirs"] = frozenset((*values["exclude_dirs"], *ALWAYS_EXCLUDED))
    if "exclude_files" in values:
        values["exclude_files"] = frozenset(values["exclude_files"])
    if unknown := sorted(set(values.get("disable", ())) - set(CHECKS)):
        raise ConfigError(f"{path}: health.disable: unknown check {', '.join(unknown)} (known: {', '.join(CHECKS)})")
    if "disable" in values:
        values["disable"] = frozenset(values["disable"])
    return Config(root, **values)
