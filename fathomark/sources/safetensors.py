"""Matrices in safetensors files: eight bytes of header length, a JSON header, and raw little-endian numbers."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomark.sources.store import arrow_uri

# The names of number types in the format; bf16 is the upper half of a 32-bit float.
_TYPES = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "BF16": "<u2"}
#: Bytes of a matrix that one task row reads, and the longest header accepted.
RANGE, LONGEST_HEADER = 8 << 20, 100 << 20


class FormatError(ValueError):
    """The file is not a safetensors file, or does not hold the matrix asked for."""


def _open(url: str):
    system, path = arrow_fs.FileSystem.from_uri(arrow_uri(url))
    return system.open_input_file(path)


def header(url: str) -> tuple[dict, int]:
    """The header of a file, and where its numbers begin."""
    try:
        with _open(url) as f:
            size = f.size()
            length = struct.unpack("<Q", f.read(8))[0]
            if length > min(LONGEST_HEADER, size - 8):
                raise FormatError(f"{url}: the header is longer than the file")
            return json.loads(f.read(length)), 8 + length
    except (OSError, struct.error, ValueError) as e:
        raise FormatError(f"{url}: {e}") from None


def read_matrix(spark: SparkSession, url: str, name: str) -> DataFrame:
    """``row, embedding`` of the matrix ``name``: only the header is read here, rows are read by offset in the tasks."""
    tensors, begin = header(url)
    spec = tensors.get(name)
    if not isinstance(spec, dict) or spec.get("dtype") not in _TYPES or len(spec.get("shape", ())) != 2:
        raise FormatError(f"{url} has no matrix {name!r} of floating-point numbers")
    rows, width = spec["shape"]
    kind = np.dtype(_TYPES[spec["dtype"]])
    first, last = spec["data_offsets"]
    with _open(url) as f:
        if last - first != rows * width * kind.itemsize or begin + last > f.size():
            raise FormatError(f"{url}: the matrix {name!r} is not as long as its header says")
    at, bf16 = begin + first, spec["dtype"] == "BF16"
    step = max(1, RANGE // max(width * kind.itemsize, 1))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _open(url) as f:
            for b in batches:
                for i in b.column(0).to_pylist():
                    n = min(step, rows - i * step)
                    f.seek(at + i * step * width * kind.itemsize)
                    x = np.frombuffer(f.read(n * width * kind.itemsize), kind)
                    x = (x.astype("<u4") << 16).view("<f4") if bf16 else x.astype("<f4")
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(x))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(n) + i * step), lists], names=["row", "embedding"])

    return spark.range(-(-rows // step)).mapInArrow(read, "row long, embedding array<float>")


def write_matrix(rows: DataFrame, url: str, name: str, keep: Sequence[str], vector: str = "embedding") -> list[dict]:
    """Write the vectors of ``rows``, in their order, as one 32-bit matrix, and give the ``keep`` columns of each.

    The format is one file, so its rows pass through the driver, a partition at a time.
    """
    some = rows.select(F.size(vector).alias("n")).groupBy().agg(F.count("*").alias("rows"), F.min("n").alias("least"), F.max("n").alias("most")).first()
    width = some["most"] or 0
    if some["rows"] and some["least"] != width:
        raise FormatError("the vectors differ in length")
    size = some["rows"] * width * 4
    head = json.dumps({name: {"dtype": "F32", "shape": [some["rows"], width], "data_offsets": [0, size]}}, separators=(",", ":")).encode()
    head += b" " * (-len(head) % 8)
    kept = []
    system, path = arrow_fs.FileSystem.from_uri(arrow_uri(url))
    with system.open_output_stream(path + ".tmp") as f:
        f.write(struct.pack("<Q", len(head)) + head)
        for r in rows.select(*keep, vector).toLocalIterator():
            f.write(np.array(r[vector], "<f4").tobytes())
            kept.append({k: r[k] for k in keep})
    system.move(path + ".tmp", path)
    return kept
