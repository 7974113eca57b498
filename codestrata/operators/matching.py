"""Many identifiers in many lines: one pass over the lines by an automaton of all identifiers.

The identifiers become an Aho-Corasick automaton that every Python worker builds once and runs over Arrow batches of
lines, so the work is linear in a line and doesn't depend on how many identifiers there are. An automaton holds at most
SHARD identifiers, and that many are broadcast; more are dealt to several automata by hash, each a pass of its own.
Evidence is counted inside the task: what is shuffled is a number per identifier and task.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Identifiers of one automaton.
SHARD = 200_000
_WORD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")


@functools.lru_cache(2)
def _automaton(key: str, words: _Words):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for at, word in enumerate(words.value()):
        automaton.add_word(word, (at, len(word), "/" in word))
    automaton.make_automaton()
    return automaton


class _Words:
    """A broadcast list; equal for the cache whenever its key is."""

    def __init__(self, key: str, sent) -> None:
        self.key, self.sent = key, sent

    def value(self) -> list[str]:
        return self.sent.value

    def __hash__(self) -> int:
        return hash(self.key)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Words) and self.key == other.key


def found_in(automaton, line: str, all_occurrences: bool = True) -> set[int]:
    """The numbers of the identifiers that stand in line: by themselves, or anywhere if they have a slash."""
    hits, tested, end_of_line = set(), set(), len(line) - 1
    for end, (at, size, anywhere) in automaton.iter(line):
        if at in hits or at in tested:
            continue
        if anywhere or ((end == end_of_line or line[end + 1] not in _WORD) and (end < size or line[end - size] not in _WORD)):
            hits.add(at)
        elif not all_occurrences:
            tested.add(at)
    return hits


def _shards(words: DataFrame, most: int) -> Iterator[_Words]:
    """The distinct words in broadcast lists of about `most` words."""
    spark = words.sparkSession
    distinct = words.select(F.col(words.columns[0]).cast("string").alias("word")).where("word <> ''").distinct()
    few = [r[0] for r in distinct.limit(most + 1).collect()]  # bounded by an automaton's size
    shards = 0 if not few else 1 if len(few) <= most else -(-distinct.count() // most)
    for k in range(shards):
        held = sorted(few if shards == 1 else (r[0] for r in distinct.where(F.pmod(F.xxhash64("word"), F.lit(shards)) == k).toLocalIterator()))
        sent = spark.sparkContext.broadcast(held)
        yield _Words(f"{spark.sparkContext.applicationId}-{sent._jbroadcast.id()}", sent)


def occurrences(lines: DataFrame, words: DataFrame, all_occurrences: bool = True, shard: int = SHARD) -> DataFrame:
    """(word, path, line_no) once for each line of lines (path, line_no, line) and word (the first column) found in it."""
    kinds = {f.name: f.dataType.simpleString() for f in lines.schema}
    source = lines.select("path", "line_no", "line").where("line <> ''")
    out = None
    for held in _shards(words, shard):

        def run(batches: Iterable[pa.RecordBatch], held: _Words = held) -> Iterator[pa.RecordBatch]:
            automaton, names = _automaton(held.key, held), held.value()
            for batch in batches:
                where, which = [], []
                for i, line in enumerate(batch.column(2).to_pylist()):
                    hits = found_in(automaton, line, all_occurrences)
                    where += [i] * len(hits)
                    which += [names[at] for at in sorted(hits)]
                took = pa.array(where, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(which, pa.string()), batch.column(0).take(took), batch.column(1).take(took)], names=["word", "path", "line_no"])

        own = source.mapInArrow(run, f"word string, path {kinds['path']}, line_no {kinds['line_no']}")
        out = own if out is None else out.unionByName(own)
    return lines.sparkSession.createDataFrame([], f"word string, path {kinds['path']}, line_no {kinds['line_no']}") if out is None else out


def line_counts(lines: DataFrame, words: DataFrame, all_occurrences: bool = True, shard: int = SHARD) -> DataFrame:
    """(word, lines): in how many lines each word is found; words that are found nowhere are missing."""
    source = lines.select("line").where("line <> ''")
    out = None
    for held in _shards(words, shard):

        def run(batches: Iterable[pa.RecordBatch], held: _Words = held) -> Iterator[pa.RecordBatch]:
            automaton, names = _automaton(held.key, held), held.value()
            counts: dict[int, int] = {}
            for batch in batches:
                for line in batch.column(0).to_pylist():
                    for at in found_in(automaton, line, all_occurrences):
                        counts[at] = counts.get(at, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([names[at] for at in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "lines"])

        own = source.mapInArrow(run, "word string, lines bigint")
        out = own if out is None else out.unionByName(own)
    if out is None:
        return lines.sparkSession.createDataFrame([], "word string, lines bigint")
    return out.groupBy("word").agg(F.sum("lines").alias("lines"))


def is_blank(word: Column) -> Column:
    return word.rlike(r"^\s*$")
