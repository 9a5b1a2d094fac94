"""Arrow batches of bounded bytes between Spark and Python functions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

FLUSH_BYTES = 8 << 20


def map_rows(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterable[tuple]], schema: str, weigh: Callable[[tuple], int] | None = None) -> DataFrame:
    """mapInArrow over a generator of plain tuples.

    Output batches end at 10,000 rows or, where weigh gives a row's bytes, at 8 MB; so memory does not depend on
    how long the texts of a batch are.
    """
    kind: StructType = _parse_datatype_string(schema)
    out = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for row in f(batches):
            rows.append(row)
            held += weigh(row) if weigh else 0
            if len(rows) >= 10_000 or held >= FLUSH_BYTES:
                yield _batch(rows, out)
                rows, held = [], 0
        if rows:
            yield _batch(rows, out)

    return df.mapInArrow(run, kind)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[bytes]:
    """UTF-8 bytes of a string column, one at a time; null is empty."""
    for x in batch.column(name).cast(pa.large_binary() if pa.types.is_large_string(batch.column(name).type) else pa.binary()):
        v = x.as_buffer()
        yield b"" if v is None else v.to_pybytes()


def pack(level: int = 1, **arrays: np.ndarray) -> bytes:
    """Named arrays of numbers as one compressed value."""
    head = " ".join(f"{k}:{a.dtype.str}:{len(a)}" for k, a in arrays.items()).encode() + b"\n"
    return zstandard.ZstdCompressor(level=level).compress(head + b"".join(a.tobytes() for a in arrays.values()))


def unpack(data: bytes) -> dict[str, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    at = raw.index(b"\n") + 1
    out = {}
    for part in raw[: at - 1].decode().split(" "):
        k, kind, n = part.split(":")
        out[k] = np.frombuffer(raw, kind, int(n), at)
        at += out[k].nbytes
    return out
