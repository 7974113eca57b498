"""Quality classifier: naive Bayes support vectors (NB-SVM).

Indicators of a text's n-grams (byte trigrams, words, pairs of words, and runs of one to three word shapes, the text's
ends included; all hashed) are scaled by the log of the ratio of their shares in the two classes. A shape is the kinds
of a word's characters and whether it repeats the word before it. A linear model with hinge loss is fitted to the
scaled indicators by dual coordinate descent, interpolated with the naive Bayes weights, and a logistic curve turns
its margin into a score.

The model is fitted on the driver from a bounded sample of labelled rows (a parameter); every text is scored whole, in
one pass without a shuffle.

Cases: null and empty texts get the score of a text without n-grams; texts of any length are read whole; repeated rows
are scored each, and one of them is learned from; documents with conflicting labels are not learned from; other
columns, whatever their names, are not looked at; an empty table gives an empty result, and without labels every score
is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.plans.adapters import texts

from . import shared

#: Labelled rows of each class that are learned from at most; buckets of the hashed n-grams.
PER_CLASS, BITS = 1500, 18
#: Rounds of dual coordinate descent, its cost parameter, smoothing of counts, weight of the fitted model.
ROUNDS, COST, SMOOTHING, BETA = 15, 1.0, 1.0, 0.75
#: What is added to the squared length of a scaled row in its margin.
SHRINK = 20.0

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: The kind of each byte, a bit: blank, small letter, capital, digit, other ASCII, beyond ASCII.
_KIND = np.array([1 if _BLANK[c] else 2 if 97 <= c < 123 else 4 if 65 <= c < 91 else 8 if 48 <= c < 58 else 16 if c < 128 else 32 for c in range(256)], np.uint32)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint32(15))
    h = h * np.uint32(0x2C1B3C6D)
    h = h ^ (h >> np.uint32(12))
    return (h * np.uint32(0x297A2D39)) >> np.uint32(32 - BITS)


def indicators(raw: bytes, scratch: np.ndarray) -> np.ndarray:
    """The distinct buckets of a text's n-grams; scratch: a reused uint32 array of 1 << BITS."""
    b = np.frombuffer(raw, np.uint8)
    if len(b) == 0:
        return np.zeros(0, np.uint32)
    w = b.astype(np.uint32)
    grams = [_mix(w[:-2] | w[1:-1] << np.uint32(8) | w[2:] << np.uint32(16))] if len(b) > 2 else []
    # words: prefix sums of byte values times powers, with wrap-around, give each word's hash
    blank = _BLANK[b]
    edge = np.diff(np.concatenate(([True], blank, [True])).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if len(start):
        code = (w + np.uint32(1)) * _mix32(w)
        total = np.concatenate((np.zeros(1, np.uint32), np.cumsum(code, dtype=np.uint32)))
        word = total[end] - total[start] + (end - start).astype(np.uint32) * np.uint32(0x9E3779B1)
        word = word ^ (w[start] << np.uint32(24)) ^ (w[end - 1] << np.uint32(16))
        grams.append(_mix(word + np.uint32(0x51ED270B)))
        if len(word) > 1:
            pairs = word[:-1] * np.uint32(31) + word[1:] * np.uint32(0x85EBCA6B)
            grams.append(_mix(pairs))
        # shapes: the kinds of a word's characters, those of its first and last, and whether it repeats the word before
        kind, whole = _KIND[b], np.bitwise_or.reduceat(_KIND[b], start)
        shape = whole | kind[start] << np.uint32(6) | kind[end - 1] << np.uint32(12)
        shape[1:] |= (word[1:] == word[:-1]).astype(np.uint32) << np.uint32(18)
        edged = np.concatenate((np.full(1, 1 << 19, np.uint32), shape, np.full(1, 1 << 20, np.uint32)))
        code = _mix32(edged)
        for n in (1, 2, 3):
            run = np.full(max(0, len(code) - n + 1), n, np.uint32)
            for k in range(n):
                run = run * np.uint32(0x9E3779B1) + code[k : len(code) - n + 1 + k]
            grams.append(_mix(_mix32(run)))
    h = np.concatenate(grams) if grams else np.zeros(0, np.uint32)
    # distinct without a sort: of equal buckets the last writer stays
    index = np.arange(len(h), dtype=np.uint32)
    scratch[h] = index
    return h[scratch[h] == index]


def _mix32(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x45D9F3B)
    return h ^ (h >> np.uint32(16))


def fit(rows: list[np.ndarray], labels: np.ndarray, good_share: float | None = None, seed: int = 3) -> tuple[np.ndarray, float, float]:
    """(weights by bucket, slope, intercept): score = 1 / (1 + exp(-(slope * margin + intercept))).

    good_share: the share of label 1 among all labels, which the score is calibrated to; that of rows if not given.
    """
    size = 1 << BITS
    y = np.where(labels == 1, 1.0, -1.0)
    if len(set(y)) < 2:  # one class or none: no weights, and the score of that class
        return np.zeros(size), 0.0, float(np.clip(y.sum(), -3, 3))
    good, bad = np.full(size, SMOOTHING), np.full(size, SMOOTHING)
    for r, k in zip(rows, y, strict=True):
        (good if k > 0 else bad)[r] += 1
    ratio = np.log(good / good.sum()) - np.log(bad / bad.sum())
    # dual coordinate descent for the hinge loss; rows have unit length, classes the same total cost
    scaled = [ratio[r] for r in rows]
    scaled = [s / max(np.linalg.norm(s), 1e-9) for s in scaled]
    norms = [float(s @ s) + 1.0 for s in scaled]
    cost = np.where(y > 0, COST * len(y) / (2 * (y > 0).sum()), COST * len(y) / (2 * (y < 0).sum()))
    weights, bias, alpha, order = np.zeros(size), 0.0, np.zeros(len(y)), np.random.default_rng(seed)
    for _ in range(ROUNDS):
        for i in order.permutation(len(y)):
            g = y[i] * (weights[rows[i]] @ scaled[i] + bias) - 1
            new = min(max(alpha[i] - g / norms[i], 0.0), cost[i])
            if (step := (new - alpha[i]) * y[i]) != 0:
                weights[rows[i]] += step * scaled[i]
                bias += step
                alpha[i] = new
    mean = np.abs(weights).sum() / max((weights != 0).sum(), 1)
    final = (BETA * weights + (1 - BETA) * mean * np.where(weights != 0, 1.0, 0.0)) * ratio
    # margins are taken as in scoring, over the root of the number of n-grams, then a logistic curve is fitted
    margin = np.array([margin_of(r, final, ratio) for r in rows]) + bias
    share = (y > 0).mean() if good_share is None else min(max(good_share, 0.02), 0.98)
    slope, intercept = _logistic(margin, y, share)
    return np.stack([final, ratio]), slope, intercept + slope * bias


def margin_of(r: np.ndarray, final: np.ndarray, ratio: np.ndarray) -> float:
    """The sum of weights over the length of the scaled row; short texts, which say little, are drawn to 0."""
    return float(final[r].sum() / np.sqrt(np.square(ratio[r]).sum() + SHRINK)) if len(r) else 0.0


def _logistic(margin: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and intercept of the probability of label 1 by margin, where a share of all rows has label 1."""
    a, b, t = 1.0, 0.0, np.where(y > 0, 0.98, 0.02)
    w = len(y) * np.where(y > 0, share / (y > 0).sum(), (1 - share) / (y < 0).sum())
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g, h = w * (p - t), w * p * (1 - p) + 1e-9
        m = np.array([[h @ margin**2 + 1e-6, h @ margin], [h @ margin, h.sum()]])
        da, db = np.linalg.solve(m, np.array([g @ margin, g.sum()]))
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-9:
            break
    return float(a), float(b)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def usable_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, y) of the documents that may be learned from; those with conflicting labels are left out."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    both = rows.groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("y2"))
    return both.where("y = y2").select("doc_id", "y")


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """(doc_id, text, y): at most per_class rows of each class, the first in order of a hash of the id."""
    usable = usable_labels(labels)
    first = lambda k: usable.where(F.col("y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    chosen = first(0).unionAll(first(1))  # at most 2 * per_class ids: safe to broadcast
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[np.ndarray, float, float]:
    """The model; only the n-gram buckets of the bounded sample come to the driver, not its texts.

    One row is taken of a document that is repeated.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scratch = np.zeros(1 << BITS, np.uint32)
        for batch in batches:
            got = [np.sort(indicators((x.as_py() or "").encode(), scratch)).astype("<u4").tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(got, pa.binary())], names=["doc_id", "y", "grams"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    mapped = shared.map_batches(training_rows(docs, labels, per_class), run, f"doc_id {kind}, y int, grams binary")
    rows = mapped.groupBy("doc_id").agg(F.max(F.struct("y", "grams")).alias("x")).select("doc_id", "x.*").orderBy("doc_id").collect()
    share = usable_labels(labels).agg(F.avg("y")).first()[0]
    return fit([np.frombuffer(r[2], "<u4") for r in rows], np.array([r[1] for r in rows]), share)


def score(docs: DataFrame, model: tuple[np.ndarray, float, float]) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs; null and empty texts get the score of no n-grams."""
    (weights, slope, intercept), context = model, docs.sparkSession.sparkContext
    shipped = context.broadcast((weights.astype(np.float32), slope, intercept))  # 2 * 2**BITS numbers

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scratch = np.zeros(1 << BITS, np.uint32)
        table, a, b = shipped.value
        for batch in batches:
            out = np.full(batch.num_rows, b, float)
            if table.ndim == 2:
                for i, x in enumerate(batch.column(1)):
                    out[i] += a * margin_of(indicators((x.as_py() or "").encode(), scratch), table[0], table[1])
            got = 1 / (1 + np.exp(-np.clip(out, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = shared.map_batches(docs.select("doc_id", F.col("text").cast("string").alias("text")), run, f"doc_id {kind}, score double")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir, "doc_id", "text")
    return score(docs, learn(docs, shared.read_table(spark, sf_dir, "labels")))
