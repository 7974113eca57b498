"""Fill-in-the-middle: texts cut into prefix, middle and suffix, written as plain, psm or spm.

A Split pre-tokenizer (tokenizers library) with an isolated regular expression that matches one code point gives each
text an array of offsets: its length is n, and the offsets of the two ranks drawn for a document are its cuts. Nothing
is trained. As matches don't depend on what stands around them, the words of a batch are matched once each and a
text's array is put together from those of its words. What is drawn comes from hashes of doc_id, so a lost task gives
the same again. restore() reads a text back from the output, by DataFrame functions.

Cases: a null or empty text is empty, plain, n = 0; a text that holds a marker is plain, as its output could not be
read back; a null doc_id draws like an empty one; repeated rows give repeated rows; a text of any length is cut whole,
blocks of words at a time; other columns, whatever their names, are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import gc
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.plans.adapters import texts

from . import shared

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 documents with a text so many are cut, and of 100 that are cut so many begin with the suffix.
CUT_RATE, SPM_RATE, SEED = 90, 20, 1
#: Code points that are matched at a time.
BLOCK = 1 << 9
_WORD = re.compile(r"[^ ]+| +")


@functools.lru_cache(1)
def _splitter():
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(r"\O"), "isolated")  # any one code point, line ends too


class Offsets:
    """The offsets of the texts of a batch: each distinct word is matched once, the words of a block together."""

    def __init__(self, texts: list[str]) -> None:
        seen: dict[str, int] = {}
        self.codes = [np.array([seen.setdefault(w, len(seen)) for w in _WORD.findall(t)], np.int64) for t in texts]
        split, starts = _splitter().pre_tokenize_str, []
        joined = "".join(seen)
        collects = gc.isenabled()
        gc.disable()  # millions of short-lived tuples, no cycle among them
        try:
            for base in range(0, len(joined), BLOCK):
                starts.append(np.array([span[0] for _, span in split(joined[base : base + BLOCK])], np.int64) + base)
        finally:
            if collects:
                gc.enable()
        self.flat = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self.base = np.cumsum([0, *map(len, seen)])  # where each word begins
        self.first = np.searchsorted(self.flat, self.base)  # and which match is its first
        self.sizes = np.diff(self.first)

    def of(self, i: int) -> tuple[int, Callable[[int], int]]:
        """How many offsets text i has, and the offset of a rank; that of rank n is the text's end."""
        codes = self.codes[i]
        ends, widths = np.cumsum(self.sizes[codes]), np.cumsum((self.base[1:] - self.base[:-1])[codes])
        n = int(ends[-1]) if len(ends) else 0

        def at(rank: int) -> int:
            if rank == n:
                return int(widths[-1]) if n else 0
            unit = int(np.searchsorted(ends, rank, "right"))
            word = codes[unit]
            before = int(widths[unit - 1]) if unit else 0
            local = self.first[word] + rank - (int(ends[unit - 1]) if unit else 0)
            return before + int(self.flat[local] - self.base[word])

        return n, at


def infill(docs: DataFrame, cut_rate: int = CUT_RATE, spm_rate: int = SPM_RATE, seed: int = SEED) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row of docs (doc_id, text)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    draws = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            offsets = Offsets(texts)
            h1, h2, h3, h4 = (batch.column(2 + k).to_numpy() for k in range(4))
            rows: list[tuple] = []
            size = at = 0
            for i in range(batch.num_rows):
                text, (n, offset) = texts[i], offsets.of(i)
                if n == 0 or h3[i] % 100 >= cut_rate or PREFIX in text or SUFFIX in text or MIDDLE in text:
                    rows.append((n, "plain", None, None, text))
                else:
                    low, high = sorted((int(h1[i]) % (n + 1), int(h2[i]) % (n + 1)))
                    a, b = offset(low), offset(high)
                    head, middle, tail = PREFIX + text[:a], MIDDLE + text[a:b], SUFFIX + text[b:]
                    form, parts = ("spm", (tail, head, middle)) if h4[i] % 100 < spm_rate else ("psm", (head, tail, middle))
                    rows.append((n, form, low, high - low, "".join(parts)))
                size += 4 * n
                if size > 1 << 24 or i == batch.num_rows - 1:
                    counts, forms, firsts, middles, outputs = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).slice(at, len(rows)),
                            pa.array(counts, pa.int64()),
                            pa.array(forms, pa.string()),
                            pa.array(firsts, pa.int64()),
                            pa.array(middles, pa.int64()),
                            pa.array(outputs, pa.string()),
                        ],
                        names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                    )
                    at, rows, size = i + 1, [], 0

    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", F.col("text").cast("string").alias("text"), *draws)
    return shared.map_batches(source, run, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restore(output, form):
    """The text that infill() made this output of. No marker can arise across a seam, so the first of each is the seam."""
    body = lambda mark: F.substring_index(output, mark, 1)
    after = lambda column, mark: F.substr(column, F.locate(mark, column) + F.lit(len(mark)))
    psm = F.concat(after(body(SUFFIX), PREFIX), after(output, MIDDLE), after(body(MIDDLE), SUFFIX))
    spm = F.concat(after(body(MIDDLE), PREFIX), after(output, MIDDLE), after(body(PREFIX), SUFFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return infill(texts(spark, sf_dir, "doc_id", "text")).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        digest(F.col("output")).alias("output_sha256"), digest(restore(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


OP11_SQL = f"""
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
u AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST(('0x' || d[1:8]) AS BIGINT) AS h1, CAST(('0x' || d[9:16]) AS BIGINT) AS h2,
  CAST(('0x' || d[17:24]) AS BIGINT) AS h3, CAST(('0x' || d[25:32]) AS BIGINT) AS h4 FROM h),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= {CUT_RATE} THEN 'plain'
    WHEN h4 % 100 < {SPM_RATE} THEN 'spm' ELSE 'psm' END AS form FROM u),
o AS (SELECT *, '<P>' || substring(t, 1, a) AS p, '<M>' || substring(t, a + 1, b - a) AS m, '<S>' || substring(t, b + 1, n - b) AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN p || s || m ELSE s || p || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM o
"""
