"""Vectors as bytes, as embedded databases keep them: 32-bit floats, little-endian."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def _mapped(df: DataFrame, column: str, change, kind: str) -> DataFrame:
    at = df.columns.index(column)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.set_column(at, column, change(batch.column(at)))

    schema = ", ".join(f"`{c}` {kind if c == column else t}" for c, t in df.dtypes)
    return df.mapInArrow(run, schema)


def to_bytes(df: DataFrame, column: str) -> DataFrame:
    """df with the array of numbers in column as bytes."""
    return _mapped(df, column, lambda c: pa.array([None if x is None else np.asarray(x, "<f4").tobytes() for x in c.to_pylist()], pa.binary()), "binary")


def from_bytes(df: DataFrame, column: str) -> DataFrame:
    """df with the bytes in column as an array of floats; bytes that are no whole number of floats give null."""
    read = lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, "<f4").tolist()
    return _mapped(df, column, lambda c: pa.array([read(b) for b in c.to_pylist()], pa.list_(pa.float32())), "array<float>")
