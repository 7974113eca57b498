"""Hashes of files, and what they sum up to."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hashes(files: DataFrame, content: str = "content", key: str = "path", method: str = "xxh3") -> DataFrame:
    """(key, hash, size_bytes) of each file's bytes; a null content, as of a file that can't be read, gives no row.

    method: xxh3 (16 hex digits; no built-in function gives it, so batches go to Python as Arrow) or sha256, which stays
    in the JVM.
    """
    rows = files.select(key, F.col(content).cast("binary").alias("_raw")).where("_raw is not null")
    if method == "sha256":
        return rows.select(key, F.sha2("_raw", 256).alias("hash"), F.octet_length("_raw").cast("long").alias("size_bytes"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            views = [memoryview(x.as_buffer()) for x in batch.column(1)]
            found = pa.array([xxhash.xxh3_64_hexdigest(v) for v in views], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), found, pa.array(map(len, views), pa.int64())], names=[key, "hash", "size_bytes"])

    return rows.mapInArrow(run, f"{key} {files.schema[key].dataType.simpleString()}, hash string, size_bytes bigint")


def totals(hashed: DataFrame) -> DataFrame:
    """(files, total_bytes) of hashed files."""
    return hashed.agg(F.count("*").alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes"))
