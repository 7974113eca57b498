"""Near-duplicate embeddings: a forest of random projection trees with spill, comparison inside leaves, union.

Equal vectors of a label are one class, so a copied vector costs as much as one. The trees are fitted on the driver
from a bounded sample of classes: each level has a random direction, each node a cut near the median of the sample's
projections; vectors close to a cut go to both sides. Every class is sent to its leaves in all trees. Leaves are
compared by blocks, and a leaf of many rows is dealt to cells of bounded size in which each pair meets once. A cell
gives one row per vector (its number of links, and the least vector that it reaches there), never pairs. A pair that
shares several leaves is counted in the first only. Components are joined by label propagation.

Cases: only vectors with equal labels and equally many components are compared. Null labels, null, empty or zero
vectors, and vectors with null or non-finite components link with nothing and are components of their own. Rows that
repeat a vec_id are vectors of their own, counted as links of each other if equal; equal vectors are always linked. A
null vec_id links with nothing and is not kept. Other columns, whatever their names, are not looked at. An empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

THRESHOLD = 0.98
#: Trees, classes that the trees are fitted on at most, classes wanted in a leaf, half width of the spill.
TREES, SAMPLE, LEAF, SPILL, SEED = 6, 16_384, 512, 0.008, 9
#: Further trees for each level beyond so many: each cut parts some pairs of a large loose group, more trees make up for it.
MORE_TREES, BEYOND = 3, 6
#: Rows of one side of a cell.
CELL = 1024


class Forest:
    """Directions by tree and level, cuts by tree and node."""

    def __init__(self, sample: np.ndarray, classes: int, trees: int = TREES, leaf: int = LEAF, seed: int = SEED) -> None:
        r = np.random.default_rng(seed)
        self.depth = min(16, max(0, math.ceil(math.log2(max(1, classes) / leaf))))
        self.trees = trees + MORE_TREES * max(0, self.depth - BEYOND) if self.depth else 1
        d = sample.shape[1]
        self.directions = r.normal(size=(self.trees, max(1, self.depth), d))
        self.directions /= np.linalg.norm(self.directions, axis=2, keepdims=True)
        self.cuts = np.zeros((self.trees, 2**self.depth))
        for t in range(self.trees):
            own = {1: np.arange(len(sample))}  # the sample of each node; of one that it hardly reaches, that of the node above
            for level in range(self.depth):
                p, below = sample @ self.directions[t, level], {}
                for k, rows in own.items():
                    self.cuts[t, k] = cut = np.quantile(p[rows], r.uniform(0.4, 0.6))
                    right = p[rows] > cut
                    for child, part in ((2 * k, rows[~right]), (2 * k + 1, rows[right])):
                        below[child] = part if len(part) >= 8 else rows
                own = below

    def leaves(self, x: np.ndarray, spill: float = SPILL) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each tree (rows, leaf codes) of the unit vectors x; a row is in all leaves that its spill reaches."""
        for t in range(self.trees):
            rows, node = np.arange(len(x)), np.ones(len(x), np.int64)
            for level in range(self.depth):
                p = (x @ self.directions[t, level])[rows] - self.cuts[t, node]
                left, right = p <= spill, p > -spill
                rows, node = np.concatenate([rows[left], rows[right]]), np.concatenate([2 * node[left], 2 * node[right] + 1])
            yield rows, (t << 20) + node


def _unit(blobs: list[bytes]) -> np.ndarray:
    return _unit_rows(np.frombuffer(b"".join(blobs), "<f8").reshape(len(blobs), -1))


def _unit_rows(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(1, keepdims=True)  # keeps squares of huge and tiny numbers in range
    x = x / scale
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def compare(group: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """The rows of one cell with their links there and the least row that they reach there."""
    group = group.sort_values(["v", "h"], ignore_index=True)
    x = _unit(list(group["vec"]))
    linked = x @ x.T >= threshold
    np.fill_diagonal(linked, False)
    if group["cell_i"][0] != group["cell_j"][0]:
        chunk = group["chunk"].to_numpy()
        linked &= chunk[:, None] != chunk[None, :]
    a, b = np.nonzero(np.triu(linked))
    width = max(map(len, group["codes"]))
    codes = np.full((len(group), width), np.iinfo(np.int64).max)
    for i, c in enumerate(group["codes"]):
        codes[i, : len(c)] = np.sort(c)
    n, here, links = group["n"].to_numpy(), np.int64(group["code"][0]), np.zeros(len(group), np.int64)
    for s in range(0, len(a), 20_000):
        i, j = a[s : s + 20_000], b[s : s + 20_000]
        common = (codes[i][:, :, None] == codes[j][:, None, :]).any(2) & (codes[i] != np.iinfo(np.int64).max)
        own = codes[i][np.arange(len(i)), common.argmax(1)] == here
        np.add.at(links, i[own], n[j[own]])
        np.add.at(links, j[own], n[i[own]])
    root = shared.least_reachable(linked)
    out = pd.DataFrame({"v": group["v"], "h": group["h"], "links": links, "rv": group["v"][root].to_numpy(), "rh": group["h"][root].to_numpy()})
    return out[linked.any(1)]


def link(vectors: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding, label)."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite, F.lit(False))
    rows = rows.withColumn("ok", usable).withColumn("h", F.when(F.col("ok"), F.xxhash64("label", "embedding"))).withColumn(
        "h2", F.when(F.col("ok"), F.xxhash64("embedding", F.lit(1), "label"))
    )
    classes = (
        rows.where("ok").groupBy("h", "h2").agg(F.min("vec_id").alias("v"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    )
    classes = shared.stash(classes, "vectors")
    dims = classes.groupBy(F.size("embedding")).count().collect()
    forests = {}
    for d, n in dims:
        some = classes.where(F.size("embedding") == d).orderBy("h").limit(SAMPLE).select("embedding").toArrow()
        sample = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in some["embedding"].chunks])
        forests[d] = Forest(_unit_rows(sample.astype("<f8").reshape(-1, d)), n, trees, leaf)

    def route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = [np.asarray(x, "<f8") for x in batch.column(3).to_pylist()]
            sizes = np.array([len(x) for x in vecs])
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                blobs = [vecs[i].tobytes() for i in at]
                codes: list[list[int]] = [[] for _ in at]
                for r, leaves in forests[int(d)].leaves(_unit(blobs)):
                    for i, c in zip(r.tolist(), leaves.tolist(), strict=True):
                        codes[i].append(c)
                took = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).take(took) for k in (0, 1, 2, 4)), pa.array([int(d)] * len(at), pa.int32()), pa.array(blobs, pa.binary()), pa.array(codes, pa.list_(pa.int64()))],
                    names=["v", "h", "n", "label", "dim", "vec", "codes"],
                )

    kinds = {f.name: f.dataType.simpleString() for f in classes.schema}
    routed = shared.map_batches(
        classes.select("v", "h", "n", "embedding", "label"), route, f"v {kinds['v']}, h bigint, n bigint, label {kinds['label']}, dim int, vec binary, codes array<bigint>"
    )
    placed = shared.stash(routed, "leaves").withColumn("code", F.explode("codes"))
    keys = ["label", "dim", "code"]
    cells = shared.in_cells(placed, keys, F.xxhash64("v", "h"), CELL)
    found = cells.groupBy(*keys, "cell_i", "cell_j").applyInPandas(
        lambda g: compare(g, threshold), f"v {kinds['v']}, h bigint, links bigint, rv {kinds['v']}, rh bigint"
    )
    found = shared.stash(found, "links")
    node = lambda a, b: F.struct(F.col(a).alias("v"), F.col(b).alias("h"))
    groups = shared.components(found.select(node("v", "h").alias("a"), node("rv", "rh").alias("b")))
    counted = found.groupBy("v", "h").agg(F.sum("links").alias("links"))
    solved = (
        classes.select("h", "h2", "v", "n")
        .join(counted, ["v", "h"], "left")
        .join(groups.select("node.v", "node.h", F.col("component.v").alias("c")), ["v", "h"], "left")
        .select("h", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("c", "v").alias("component_id"))
    )
    return rows.select("vec_id", "h", "h2").join(solved, ["h", "h2"], "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept"),
    )


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(shared.read_table(spark, sf_dir, "embeddings"))


#: DuckDB: every pair of a label, and the closure of the links.
OP9_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  AND list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, least(a, min(b)) AS c FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(c, vec_id) AS component_id, vec_id = coalesce(c, vec_id) AS kept
FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
