"""Folders of tables and small files on any file system that Spark reaches, swapped in whole."""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession

from fathomark.config import ConfigError

#: Set this where the repository lies on a mount that all executors share under the same path.
SHARED_VARIABLE = "FATHOMARK_SHARED_ROOT"


def require_shared(spark: SparkSession, url: str) -> None:
    """A local folder serves a session of one process only, unless it is said to be shared."""
    if url.startswith("file:") and not spark.sparkContext.master.startswith("local[") and not os.environ.get(SHARED_VARIABLE):
        raise ConfigError(f"{url} is local to a machine: name a shared folder by its URI in [index], or set {SHARED_VARIABLE} if it is a shared mount")


def arrow_uri(path: str) -> str:
    """A path as Spark has it, without escapes and, if local, as ``file:/path``, as a URI for pyarrow's file systems."""
    scheme, rest = path.split(":", 1)
    slashes = "" if rest.startswith("//") else "//"
    return f"{'s3' if scheme in ('s3a', 's3n') else scheme}:{slashes}{quote(rest, safe='/:@')}"


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    url: str

    def _at(self, name: str = ""):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.url}/{name}" if name else self.url)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def exists(self, name: str = "") -> bool:
        fs, p = self._at(name)
        return fs.exists(p)

    def read(self, name: str) -> str | None:
        fs, p = self._at(name)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        fs, p = self._at(name)
        out = fs.create(p, True)
        out.write(bytearray(text, "utf-8"))
        out.close()

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.url}/{name}")

    def delete(self) -> None:
        fs, p = self._at()
        fs.delete(p, True)

    def beside(self, kind: str) -> Store:
        """A new folder next to this one."""
        require_shared(self.spark, self.url)
        return Store(self.spark, f"{self.url}.{kind}-{uuid.uuid4().hex[:8]}")

    def replace_by(self, fresh: Store) -> None:
        """Put a finished folder in the place of this one."""
        fs, here = self._at()
        old = self.beside("old")
        had = fs.exists(here)
        if had and not fs.rename(here, old._at()[1]):
            raise OSError(f"cannot move {self.url} aside")
        if not fs.rename(fresh._at()[1], here):
            raise OSError(f"cannot move {fresh.url} to {self.url}")
        if had:
            old.delete()
