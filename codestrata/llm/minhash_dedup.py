"""Near-duplicate documents: improved consistent weighted sampling (ICWS) over TF-IDF shingles, banded and verified.

1. A text's shingles are its runs of five words (lower case, without punctuation). A shingle weighs its count in the
   text times its IDF. Document frequencies are counted over all documents by the features that shingles are hashed
   to, 2**19 of them, so the table of IDFs that is broadcast has one size at any number of documents. A feature that
   is rarer than 1 in 500 documents has the largest IDF. IDFs are scaled to lie between 1 and 1.5: unscaled ones would
   weigh an edited word, which is rare, many times what a large group of copies shares, and so part the group.
2. ICWS draws 30 samples; two texts agree in one with the probability of their weighted Jaccard similarity. Ten bands
   of three samples: texts of similarity 0.8 meet in a band with probability 0.999.
3. Texts that are equal are one class from here on. In each bucket every class is compared with the least one (a
   star, linear in the bucket). In a bucket that the verified links don't yet join, the classes outside its largest
   piece are compared with all of it, in cells of bounded size by matrix products of the shingle sets: as many
   comparisons as pairs between pieces need, however large the largest piece is. All links are verified by exact
   weighted Jaccard similarity; pairs are never listed.
4. Components of the links are the groups; the least doc_id of a group is its document to keep.

Cases: null texts are empty. Equal texts are always one group, empty ones too; other texts without a word link with
nothing. Texts of any length are read whole, by blocks. Rows that repeat a doc_id are one document: what any of its
texts links is linked. Rows with a null doc_id link with nothing, have a null class_id and are kept. Other columns,
whatever their names, are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from codestrata.plans.adapters import texts

from . import shared

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 10, 3
#: Features that shingles are hashed to for their IDF, as bits; those of at least this share of the documents have an IDF
#: below the largest.
FEATURE_BITS, FREQUENT = 19, 1 / 500
#: Rows of one side of a cell, and compared rows of one leader in a task.
CELL = 512
#: Bits of the bitmap by which texts that are compared are found; at most 8 MB are broadcast.
FILTER_BITS = 1 << 26
#: Characters that are hashed at a time.
BLOCK = 1 << 21

_U = np.uint64
_PRIME = _U(0x9E3779B97F4A7C15)
#: Low bits of a shingle element that hold its IDF.
_LOW = _U(0xFFF)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64's finaliser)."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


_CODES = mix(np.arange(1, 257, dtype=_U) * _PRIME)
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True


@functools.lru_cache(1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    base, inverse = np.full(size, _PRIME), np.full(size, _U(pow(int(_PRIME), -1, 1 << 64)))
    base[0] = inverse[0] = 1
    return np.multiply.accumulate(base), np.multiply.accumulate(inverse)


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words of a text, in order."""
    found, start = [], 0
    while start < len(text):
        end = start + BLOCK
        while end < len(text) and (text[end].isalnum() or text[end] == "_"):  # a block ends between words
            end += 1
        found.append(_block_hashes(text[start:end]))
        start = end
    return np.concatenate(found) if found else np.zeros(0, _U)


def _block_hashes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    edge = np.diff(_IN_WORD[raw].astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size = 1 << max(16, (len(raw) + 1).bit_length())
    power, inverse = _powers(size)
    sums = np.zeros(len(raw) + 1, _U)
    np.cumsum(_CODES[raw] * power[: len(raw)], out=sums[1:])
    return mix((sums[end] - sums[start]) * inverse[start])


def shingles(words: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes in order, their counts); the low bits of a hash hold its IDF, which table has by feature.
    Texts of fewer than five words have one shingle, of all words."""
    n = len(words)
    if n == 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    size = min(SHINGLE, n)
    h = np.zeros(n - size + 1, _U)
    for k in range(size):
        h = (h + words[k : n - size + 1 + k]) * _PRIME
    h, counts = np.unique(mix(h) & ~_LOW, return_counts=True)
    return h | table[features(h)], counts


def features(h: np.ndarray) -> np.ndarray:
    return (h >> _U(64 - FEATURE_BITS)).astype(np.intp)


def elements(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A set with an element for each occurrence of a shingle: weighted Jaccard similarity of texts is that of sets."""
    extra = np.flatnonzero(counts > 1)
    if not len(extra):
        return h
    times = counts[extra] - 1
    number = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + 1
    again = np.repeat(h[extra], times)
    more = (mix(again + number.astype(_U) * _PRIME) & ~_LOW) | (again & _LOW)
    return np.unique(np.concatenate([h, more]))


def weights(h: np.ndarray) -> np.ndarray:
    return 1 + (h & _LOW).astype(np.float64) / 8190


@functools.lru_cache(1)
def _gamma() -> tuple[np.ndarray, np.ndarray]:
    """65536 quantiles of Gamma(2, 1), and their logarithms."""
    p = (np.arange(65536) + 0.5) / 65536
    x = np.where(p < 0.5, np.sqrt(2 * p), -np.log1p(-p) + 1)
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - p) / (x * np.exp(-x)), x / 4)
    return x.astype(np.float32), np.log(x).astype(np.float32)


def samples(h: np.ndarray, counts: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """ICWS samples of a non-empty weighted set."""
    gamma, log_gamma = _gamma()
    log_w = np.log(counts * weights(h)).astype(np.float32)
    seeds = mix(np.arange(1, size + 1, dtype=_U) * _PRIME)
    best, sample = np.full(size, np.inf, np.float32), np.zeros(size, _U)
    step = 1 << 14
    for s in range(0, len(h), step):
        part, lw = h[s : s + step], log_w[s : s + step]
        bits = mix(part[None, :] ^ seeds[:, None])
        r = gamma[(bits & _U(0xFFFF)).astype(np.intp)]
        beta = ((bits >> _U(32)) & _U(0xFFFF)).astype(np.float32) / np.float32(65536)
        t = np.floor(lw[None, :] / r + beta)
        rank = log_gamma[((bits >> _U(16)) & _U(0xFFFF)).astype(np.intp)] - r * (t - beta + 1)
        at = rank.argmin(1)
        rows = np.arange(size)
        better = rank[rows, at] < best
        drawn = mix(part[at] + mix(t[rows, at].astype(np.int64).astype(_U) + seeds))
        best, sample = np.where(better, rank[rows, at], best), np.where(better, drawn, sample)
    return sample


def band_keys(sample: np.ndarray) -> np.ndarray:
    key = np.arange(1, BANDS + 1, dtype=_U)
    for column in sample.reshape(BANDS, ROWS).T:
        key = mix(key * _PRIME + column)
    return key.astype(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two element sets."""
    both = weights(np.intersect1d(a, b, assume_unique=True)).sum()
    total = weights(a).sum() + weights(b).sum() - both
    return float(both / total) if total else 0.0


def similar(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """The matrix of all pairs of sets whose weighted Jaccard similarity is at least threshold."""
    n = len(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    found, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    w, both = weights(found), np.zeros((n, n))
    place = np.cumsum(times > 1) - 1
    use = times[column] > 1
    row, column, w = row[use], place[column[use]], w[times > 1]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for s in range(0, len(w), 2048):
        a, b = np.searchsorted(column, [s, s + 2048])
        x = np.zeros((n, min(2048, len(w) - s)))
        x[row[a:b], column[a:b] - s] = 1
        both += (x * w[s : s + 2048]) @ x.T
    total = np.array([weights(s).sum() for s in sets])
    linked = both >= threshold * (total[:, None] + total[None, :] - both) - 1e-12
    np.fill_diagonal(linked, False)
    return linked & (both > 0)


def groups_of(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[list[list]]:
    """The rows of sorted batches, group by group; the first `keys` columns name the group, the last is the largest."""
    name, rows = None, []
    for batch in batches:
        named = zip(*(c.to_pylist() for c in batch.columns[:-1]), strict=True)
        for i, head in enumerate(named):
            row = (*head, batch.columns[-1][i].as_py())
            if row[:keys] != name:
                if rows:
                    yield rows
                name, rows = row[:keys], []
            rows.append(row)
    if rows:
        yield rows


def idf_table(docs: DataFrame, frequent: float = FREQUENT) -> np.ndarray:
    """The IDF of each feature, as 0 (in every document) to 4095 (in at most a share `frequent` of them).

    A task counts the documents of each feature and gives a row per feature; only these rows are shuffled.
    """
    rare = np.full(1 << FEATURE_BITS, 4095, _U)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << FEATURE_BITS, np.int64)
        for batch in batches:
            for x in batch.column(0):
                held[features(shingles(word_hashes(x.as_py() or ""), rare)[0])] += 1  # a document counts once
        found = np.flatnonzero(held)
        for s in range(0, len(found), 1 << 16):
            part = found[s : s + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(held[part])], names=["feature", "n"])

    total = docs.count()
    counted = shared.map_batches(docs.select("text"), run, "feature int, n bigint").groupBy("feature").agg(F.sum("n").alias("n"))
    found = counted.where(F.col("n") >= max(2.0, frequent * total)).toArrow()  # a row per feature at most
    scale = math.log(max(1 / frequent, 1 + 1e-9))
    table = rare.copy()
    table[found["feature"].to_numpy()] = np.clip(np.log(total / found["n"].to_numpy()) / scale * 4095, 0, 4095).astype(_U)
    return table


def id_filter(ids: DataFrame) -> np.ndarray:
    """A bitmap of the 64-bit hashes in ids (column h), 16 bits for each of them, at most FILTER_BITS in all.

    It passes every id, and with 16 bits for each 6 percent of the others. Beyond its bound it passes more, never less.
    """
    bits = 1 << 6
    wanted = min(FILTER_BITS, 16 * ids.count())
    while bits < wanted:
        bits *= 2
    bit = F.pmod(F.col("h"), F.lit(bits))
    words = ids.groupBy(F.floor(bit / 64).cast("int").alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(pmod(h, {bits}) % 64 AS INT))")).alias("b"))
    found = words.toArrow()
    out = np.zeros(bits // 64, _U)
    out[found["w"].to_numpy()] = found["b"].to_numpy().view(_U)
    return out


def _set_mapper(table, bitmap) -> Callable:
    """(rep, hash of rep, text) to (rep, set) for the rows that pass the bitmap."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for batch in batches:
            at = batch.column(1).to_numpy().view(_U) & _U(64 * len(bits) - 1)
            found = np.flatnonzero(bits[(at >> _U(6)).astype(np.intp)] >> (at & _U(63)) & _U(1))
            batch = batch.take(pa.array(found))
            rows, size = 0, 0
            blobs: list[bytes] = []
            for i, x in enumerate(batch.column(2)):
                blobs.append(elements(*shingles(word_hashes(x.as_py() or ""), table.value)).tobytes())
                size += len(blobs[-1])
                if size > 1 << 24 or i == batch.num_rows - 1:
                    own = batch.slice(rows, len(blobs))
                    yield pa.RecordBatch.from_arrays([own.column(0), pa.array(blobs, pa.binary())], names=["rep", "set"])
                    rows, size, blobs = i + 1, 0, []

    return run


def find_groups(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, kept) for every row of docs (doc_id, text); class_id is the least doc_id of the group."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    named = rows.where(F.col("doc_id").isNotNull())
    table = spark.sparkContext.broadcast(idf_table(named))

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bands = []
            for x in batch.column(3):
                h, n = shingles(word_hashes(x.as_py()), table.value)
                bands.append(band_keys(samples(h, n)) if len(h) else [])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "h1", "h2", "bands"])

    hashed = named.select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text", F.lit(2)).alias("h2"), "text")
    signed = shared.stash(shared.map_batches(hashed, sign, f"doc_id {kind}, h1 bigint, h2 bigint, bands array<bigint>"), "signatures")
    classes = shared.stash(signed.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "classes")

    # stars: every class of a bucket with the least one
    keyed = classes.select("rep", F.explode("bands").alias("key"))
    buckets = shared.stash(keyed.groupBy("key").agg(F.min("rep").alias("lead"), F.count("*").alias("n")).where("n > 1"), "buckets")
    pairs = keyed.join(buckets, "key").where("rep <> lead").select("rep", "lead").distinct()
    pairs = shared.stash(pairs, "pairs")
    leads_of = pairs.groupBy("lead").agg(F.ceil(F.count("*") / CELL).cast("int").alias("parts"))
    leads_of = shared.stash(leads_of, "leads")
    leads = pairs.unionByName(leads_of.select(F.col("lead").alias("rep"), "lead"))
    needed = leads.groupBy("rep").agg(F.collect_set("lead").alias("leads"))  # a row is in ten buckets at most
    needed = shared.stash(needed, "needed")
    # only rows that pass a bitmap of the needed ids become sets and are shuffled; the join then drops the rest
    bitmap = spark.sparkContext.broadcast(id_filter(needed.select(F.xxhash64("rep").alias("h"))))
    texts = named.select(F.col("doc_id").alias("rep"), F.xxhash64("doc_id").alias("h"), "text")
    sets = shared.map_batches(texts, _set_mapper(table, bitmap), f"rep {kind}, set binary").join(needed, "rep")
    sets = shared.stash(sets.select("rep", "leads", "set"), "sets")
    sent = (
        sets.select(F.explode("leads").alias("lead"), "rep", "set")
        .join(leads_of, "lead")
        .withColumn("first", F.col("rep") == F.col("lead"))
        .withColumn(
            "part",
            F.explode(
                F.when(F.col("first"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(
                    F.array(F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
                )
            ),
        )
        .select("lead", "part", F.when(F.col("first"), 0).otherwise(1).alias("later"), "rep", "set")
    )

    def stars(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, own = None, []  # a repeated doc_id may have several sets
        for batch in batches:
            name, later, reps, blobs = (batch.column(i) for i in (0, 2, 3, 4))
            a, b = [], []
            for k, late, rep, blob in zip(name.to_pylist(), later.to_pylist(), reps.to_pylist(), blobs, strict=True):
                one = np.frombuffer(blob.as_buffer(), _U)
                if k != lead:
                    lead, own = k, []
                if not late:
                    own.append(one)
                elif any(similarity(one, x) >= threshold for x in own):
                    a.append(rep)
                    b.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(a, batch.schema.field(3).type), pa.array(b, batch.schema.field(0).type)], names=["a", "b"])

    dealt = sent.repartition("lead", "part").sortWithinPartitions("lead", "part", "later", "rep")
    links = shared.stash(shared.map_batches(dealt, stars, f"a {kind}, b {kind}"), "links")

    # buckets of three or more that the stars leave in several pieces: all their pairs
    joined = shared.components(links)
    members = (
        keyed.join(buckets.where("n > 2").select("key"), "key")
        .join(joined.withColumnRenamed("node", "rep"), "rep", "left")
        .select("key", "rep", F.coalesce("component", "rep").alias("piece"))
    )
    members = shared.stash(members, "members")
    pieces = members.groupBy("key", "piece").agg(F.count("*").alias("n"), F.sum(F.xxhash64("rep") % (1 << 40)).alias("sum"))
    open_keys = (
        pieces.groupBy("key")
        .agg(F.max_by("piece", F.struct("n", "piece")).alias("main"), F.max("n").alias("inner"), F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.count("*").alias("pieces"))
        .where("pieces > 1")
        .groupBy("main", "inner", "n", "sum")  # bands with the same rows need one look
        .agg(F.min("key").alias("key"))
    )
    chunks = lambda n: F.ceil(F.col(n) / CELL).cast("int")
    open_keys = shared.stash(open_keys.select("key", "main", chunks("inner").alias("c0"), F.ceil((F.col("n") - F.col("inner")) / CELL).cast("int").alias("c1")), "open")
    # cell (i, j): chunk i of the largest piece, or from c0 on of the others, against chunk j of the others
    chunk = F.pmod(F.xxhash64("rep"), F.when(F.col("inside"), F.col("c0")).otherwise(F.col("c1"))).cast("int")
    cell = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    across = F.transform(upto("c0"), lambda i: cell(i, F.col("chunk")))
    outside = F.transform(upto("c1"), lambda j: cell(F.col("c0") + F.least("chunk", j), F.greatest("chunk", j)))
    to = F.when(F.col("inside"), F.transform(upto("c1"), lambda j: cell(F.col("chunk"), j))).otherwise(F.concat(across, outside))
    cells = members.join(open_keys, "key").withColumn("inside", F.col("piece") == F.col("main")).withColumn("chunk", chunk)
    cells = cells.select("key", "rep", F.explode(to).alias("cell")).select("key", "cell.i", "cell.j", "rep")
    cells = cells.join(sets.select("rep", "set"), "rep").select("key", "i", "j", "rep", "set")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, 3):
            linked = similar([np.frombuffer(r[4], _U) for r in group], threshold)
            root = shared.least_reachable(linked)
            own = np.flatnonzero(root != np.arange(len(group)))
            if len(own):
                a = [group[i][3] for i in own]
                b = [group[i][3] for i in root[own]]
                yield pa.RecordBatch.from_arrays([pa.array(a, id_type), pa.array(b, id_type)], names=["a", "b"])

    id_type = to_arrow_type(docs.schema["doc_id"].dataType)
    dealt = cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "rep")
    more = shared.map_batches(dealt, compare, f"a {kind}, b {kind}")
    more = shared.stash(more, "more-links")
    joined = shared.components(links.unionByName(more)) if more.take(1) else joined
    shared.discard(buckets, pairs, needed, leads_of, sets, links, members, open_keys, more)
    solved = (
        classes.select("h1", "h2", "rep")
        .join(joined.withColumnRenamed("node", "rep"), "rep", "left")
        .select("h1", "h2", F.coalesce("component", "rep").alias("class_id"))
    )
    done = signed.select("doc_id", "h1", "h2").join(solved, ["h1", "h2"]).select(
        "doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept")
    )
    none = rows.where(F.col("doc_id").isNull()).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(True).alias("kept"))
    return done.unionByName(none)


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_groups(texts(spark, sf_dir, "doc_id", "text"))
