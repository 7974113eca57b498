"""Nearest vectors for many queries at once: inverted lists, residual product codes, exact re-ranking.

write() fits list centres and, for what is left of a vector beyond its centre, a codebook of every two components, on a
bounded sample; every vector is then put into its list as codes, with the length of what the codes miss. A search
decodes the lists around a query in blocks and bounds the distance of every vector from below by that length.
The k-th least distance in the nearest lists is a limit; lists that lie wholly beyond it are skipped, vectors whose
lower bound lies beyond it are dropped, and those left are ranked by their own components, which lie in the block beside
the codes, so that only pairs within the limit leave the task. As bounds are never on the wrong side, the rows are those
of a comparison of all: codes and lists only save work.

Similarity is the cosine: vectors are scaled to length one. Cases: null, zero or non-finite vectors, and those of
another length than most, are in no list and found by nothing, and as queries find nothing; null ids of vectors are
kept; equal vectors are all found, ties broken by id; fewer than k vectors are all found.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.operators import search

#: Vectors that centres and codebooks are fitted on, the most lists, vectors of a block, queries of a block, lists probed first.
SAMPLE, LISTS, BLOCK, ASKED, PROBES = 16_384, 1024, 1024, 128, 8
WIDTH, ENTRIES, ROUNDS, SEED = 2, 256, 8, 7
#: Room for rounding, in distances of unit vectors and in their squares.
ROOM = 1e-5


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = [((c := centres) ** 2).sum(1)[None, :] - 2 * part @ c.T for part in np.array_split(x, max(1, len(x) // 4096))]
    return np.concatenate([d.argmin(1) for d in out])


def fit(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """k centres of the rows of x, fewer if there are fewer rows."""
    r = np.random.default_rng(seed)
    centres = x[r.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        code = _nearest(x, centres)
        n = np.bincount(code, minlength=len(centres))
        sums = np.stack([np.bincount(code, x[:, j], len(centres)) for j in range(x.shape[1])], 1)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


class Codes:
    """Centres of lists, and codebooks of pairs of components of what is left."""

    def __init__(self, sample: np.ndarray, lists: int) -> None:
        self.dims = sample.shape[1]
        self.centres = fit(sample, lists)
        left = sample - self.centres[_nearest(sample, self.centres)]
        self.books = [fit(left[:, a : a + WIDTH], ENTRIES) for a in range(0, self.dims, WIDTH)]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lists, codes, and the length that they miss, rounded up."""
        lists = _nearest(x, self.centres)
        left = x - self.centres[lists]
        codes = np.stack([_nearest(left[:, p * WIDTH : (p + 1) * WIDTH], b) for p, b in enumerate(self.books)], 1).astype(np.uint8)
        return lists, codes, np.sqrt(((x - self.decode(lists, codes)) ** 2).sum(1)) + ROOM

    def decode(self, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return self.centres[lists] + np.concatenate([b[codes[:, p]] for p, b in enumerate(self.books)], 1)


def unit(vectors: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(id, unit) of the vectors that can be scaled to length one."""
    v = F.col(vector).cast("array<double>")
    fine = F.col(vector).isNotNull() & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    scale = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x)))  # noqa: E731  keeps squares in range
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    rows = vectors.where(F.coalesce(fine, F.lit(False)) & (scale(v) > 0)).select(F.col(id_column).alias("id"), v.alias("v"))
    scaled = rows.select("id", _divided(F.col("v"), scale).alias("v"))
    return scaled.select("id", _divided(F.col("v"), norm).alias("unit"))


def _divided(v: Column, by: Callable[[Column], Column]) -> Column:
    """v by a number that is taken once for the array: named outside the inner lambda, it is not computed for each component."""
    return F.get(F.transform(F.array(v), lambda a: F.get(F.transform(F.array(by(a)), lambda s: F.transform(a, lambda x: x / s)), F.lit(0))), F.lit(0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _bytes(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in x], pa.binary())


def _rows(column: pa.Array, kind: type) -> np.ndarray:
    """The rows of a matrix that _bytes() made."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def write(vectors: DataFrame, place: str, id_column: str = "vec_id", vector: str = "embedding") -> Codes | None:
    """Write the vectors, scaled, and their codes by list below place; the centres and codebooks that a search needs."""
    spark = vectors.sparkSession
    rows = unit(vectors, id_column, vector)
    common = rows.groupBy(F.size("unit").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return None
    dims, n = common["d"], common["count"]
    rows = rows.where(F.size("unit") == dims)
    some = rows.orderBy(F.xxhash64("unit")).limit(SAMPLE).select("unit").toArrow()  # bounded by SAMPLE
    sample = np.concatenate([_matrix(c) for c in some["unit"].chunks if len(c)])
    codes = Codes(sample, max(1, min(LISTS, math.isqrt(n))))
    sent = spark.sparkContext.broadcast(codes)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, own, missed = sent.value.encode(_matrix(batch.column(1)))
            far = np.sqrt(((_matrix(batch.column(1)) - sent.value.centres[lists]) ** 2).sum(1))
            arrays = [batch.column(0), _bytes(_matrix(batch.column(1))), pa.array(lists, pa.int32()), _bytes(own), pa.array(missed), pa.array(far)]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "unit", "list", "codes", "missed", "far"])

    coded = rows.mapInArrow(run, f"id {kind}, unit binary, list int, codes binary, missed double, far double")
    coded = coded.withColumn("row", F.monotonically_increasing_id())
    coded.write.parquet(f"{place}/vectors")
    written = spark.read.schema(coded.schema).parquet(f"{place}/vectors")
    sizes = written.groupBy("list").agg(F.count("*").alias("size"), F.max("far").alias("radius"))  # a row for each list
    sizes.write.parquet(f"{place}/lists")
    dealt = written.join(F.broadcast(spark.read.schema(sizes.schema).parquet(f"{place}/lists")), "list").withColumn("chunk", F.pmod(F.xxhash64("row"), F.ceil(F.col("size") / BLOCK)))
    # a hot list has many blocks; each holds about BLOCK vectors
    blocks = dealt.groupBy("list", "chunk").agg(F.collect_list(F.struct("id", "unit", "codes", "missed")).alias("own"))
    blocks.select("list", "chunk", "own.id", "own.unit", "own.codes", "own.missed").write.parquet(f"{place}/blocks")
    return codes


def _compare(spark: SparkSession, blocks: DataFrame, codes: Codes, asked: DataFrame, k: int | None) -> DataFrame:
    """(query_id, id, score) for asked (query_id, unit, list, reach): of each block the k nearest (k given), or all within
    reach. Codes tell which vectors can be; only these are compared, inside the task, by their own components."""
    sent = spark.sparkContext.broadcast(codes)
    kind = asked.schema["query_id"].dataType.simpleString()
    own = blocks.select("list", "id", F.col("unit").alias("own"), "codes", "missed")
    sizes = asked.groupBy("list").agg(F.ceil(F.count("*") / ASKED).alias("parts"))  # at most a row for each list
    dealt = asked.join(F.broadcast(sizes), "list").withColumn("part", F.pmod(F.xxhash64("query_id", "list"), F.col("parts")))
    queries = dealt.groupBy("list", "part").agg(F.collect_list(F.struct("query_id", "unit", "reach")).alias("q")).select("list", "q.query_id", "q.unit", "q.reach")
    met = own.join(queries, "list").select("list", "id", "own", "codes", "missed", "query_id", "unit", "reach")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, own, coded, missed, asked_ids, q, reach = (batch.column(c)[i].values for c in range(1, 8))
                q, x = _matrix(q), _rows(own, np.float64)
                if k is None:
                    reach = reach.to_numpy(zero_copy_only=False)
                    y = sent.value.decode(np.full(len(x), batch.column(0)[i].as_py()), _rows(coded, np.uint8))
                    d = np.sqrt(np.maximum((q * q).sum(1)[:, None] - 2 * q @ y.T + (y * y).sum(1)[None, :], 0))
                    can = d - missed.to_numpy(zero_copy_only=False)[None, :] - ROOM <= reach[:, None]
                    some = np.flatnonzero(can.any(0))
                    score = q @ x[some].T
                    a, b = np.nonzero(can[:, some] & (2 - 2 * score <= (reach * reach)[:, None] + ROOM))
                    found, b = score[a, b], some[b]
                else:
                    score = q @ x.T
                    near = np.argsort(-score, 1, kind="stable")[:, :k]
                    a, b = np.repeat(np.arange(len(q)), near.shape[1]), near.ravel()
                    found = score[a, b]
                yield pa.RecordBatch.from_arrays([asked_ids.take(pa.array(a)), ids.take(pa.array(b)), pa.array(found)], names=["query_id", "id", "score"])

    return met.mapInArrow(run, f"query_id {kind}, id {own.schema['id'].dataType.elementType.simpleString()}, score double")


def _probe(spark: SparkSession, radius: np.ndarray, codes: Codes, queries: DataFrame, probes: int | None) -> DataFrame:
    """(query_id, unit, list, reach) of queries (query_id, unit, reach): the nearest lists, or all within reach."""
    sent = spark.sparkContext.broadcast((codes.centres, radius))
    kind = queries.schema["query_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, far = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            q, reach = _matrix(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False)
            d = np.sqrt(np.maximum((q * q).sum(1)[:, None] - 2 * q @ centres.T + (centres * centres).sum(1)[None, :], 0))
            d[:, far < 0] = np.inf  # no vector there
            if probes is None:
                a, b = np.nonzero(d - far[None, :] - ROOM <= reach[:, None])
            else:
                near = np.argsort(d, 1, kind="stable")[:, : min(probes, int((far >= 0).sum()))]
                a, b = np.repeat(np.arange(len(q)), near.shape[1]), near.ravel()
            took = pa.array(a)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(took), batch.column(1).take(took), pa.array(b, pa.int32()), batch.column(2).take(took)], names=["query_id", "unit", "list", "reach"])

    return queries.select("query_id", "unit", "reach").mapInArrow(run, f"query_id {kind}, unit array<double>, list int, reach double")


def nearest(spark: SparkSession, place: str, codes: Codes | None, queries: DataFrame, k: int, id_column: str = "vec_id", vector: str = "embedding", probes: int = PROBES, exact: bool = True) -> DataFrame:
    """(query_id, id, score): the k nearest vectors of each query and those that tie within a millionth, by cosine.

    exact=False stays within the `probes` nearest lists: less work, and a neighbour in another list is missed.
    """
    empty = spark.createDataFrame([], f"query_id {queries.schema[id_column].dataType.simpleString()}, id {queries.schema[id_column].dataType.simpleString()}, score double")
    if codes is None:
        return empty
    asked = unit(queries, id_column, vector).where(F.size("unit") == codes.dims).select(F.col("id").alias("query_id"), "unit", F.lit(4.0).alias("reach"))
    blocks, radius = spark.read.parquet(f"{place}/blocks"), np.full(len(codes.centres), -np.inf)
    for r in spark.read.parquet(f"{place}/lists").collect():  # at most LISTS rows
        radius[r["list"]] = r["radius"]
    near = search.top(_compare(spark, blocks, codes, _probe(spark, radius, codes, asked, probes), k), k, "query_id", tie="id")
    reach = near.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    wide = F.when(F.col("n") >= k, F.sqrt(F.greatest(2 - 2 * F.col("least"), F.lit(0.0)) + ROOM)).otherwise(4.0)  # no two unit vectors are 4 apart
    limited = asked.drop("reach").join(reach.select("query_id", wide.alias("reach")), "query_id", "left").fillna(4.0, ["reach"])
    return _compare(spark, blocks, codes, _probe(spark, radius, codes, limited, None if exact else probes), None)
