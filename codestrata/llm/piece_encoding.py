"""SentencePiece encoding (byte-pair merges) and decoding by vectorised merge rounds.

A batch of texts is cut where no piece of the model can reach across: before a blank that follows another character. Its
distinct words become one flat array of symbols. In each round every word finds the least rank among its pairs (a
segmented minimum), and all words merge their leftmost pairs of that rank at once; the array is then compacted, and
words without a pair leave it, until none is left. A word is further cut between two characters that stand side by side
in no piece. Merging several equal pairs of a word in one round is what one-by-one merging gives unless a merge makes a
pair that ranks as high or higher; the merges of that word in that round end there, so results are those of the
library. Rounds are at most the merges of one word, and, but for such stops, at most the ranks of the model.

Characters that the model doesn't have become their UTF-8 bytes. Decoding gathers the bytes of all pieces of a batch
by one index.

Cases: null and empty texts have the begin and end ids only and decode to an empty text; blanks, control characters
and the mark that stands for a blank are text as the library treats them; a text of any length is encoded whole, in
stretches cut as above; repeated rows are encoded each, null or repeated doc_ids are carried along; other columns,
whatever their names, are not looked at; an empty table gives no rows. Decoding a null list of ids gives an empty text.
"""

from __future__ import annotations

import codecs
import functools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.plans.adapters import texts

from . import shared

MODEL = "piece_bpe_32k.model"
BLANK = "▁"  # the mark that stands for a blank in pieces
#: Characters of text that are looked at at a time; longer texts are cut before a blank.
STRETCH = 1 << 21
_NONE = np.int32(2**31 - 1)  # the rank of what is no pair
_SEAM = re.compile("(?<=[^ ]) ")


class Model:
    """The tables of a model: symbols of characters, ranks of pairs, bytes of pieces."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        if library.normalize("ﬁ  x ") != f"{BLANK}ﬁ{BLANK * 2}x{BLANK}":
            raise ValueError("the model changes texts before it encodes them")
        self.size, self.bos, self.eos = library.get_piece_size(), library.bos_id(), library.eos_id()
        names = [library.id_to_piece(i) for i in range(self.size)]
        self.is_byte = np.array([library.is_byte(i) for i in range(self.size)])
        self.is_control = np.array([library.is_control(i) for i in range(self.size)])
        self.is_unknown = np.array([library.is_unknown(i) for i in range(self.size)])
        plain = np.flatnonzero(~(self.is_byte | self.is_control | self.is_unknown)).tolist()
        if any(BLANK in names[i].lstrip(BLANK) for i in plain):
            raise ValueError("the model has pieces that reach across words")
        if not self.is_byte.any():
            raise ValueError("the model has no pieces for bytes")
        symbol = {names[i]: i for i in plain}
        for c in sorted({c for i in plain for c in names[i]} - set(symbol)):
            symbol[c] = self.size + len(symbol)
        self.unknown = self.size + len(symbol) + 1
        self.symbol_of_char = np.full(0x110000, self.unknown, np.int64)
        for s, i in symbol.items():
            if len(s) == 1:
                self.symbol_of_char[ord(s)] = i
        self.symbol_of_char[32] = self.symbol_of_char[ord(BLANK)]
        order = {s: r for r, s in enumerate(sorted({library.get_score(i) for i in plain}, reverse=True))}
        pairs = {}
        for i in plain:
            for k in range(1, len(names[i])):
                a, b = symbol.get(names[i][:k]), symbol.get(names[i][k:])
                if a is not None and b is not None:
                    pairs[a * (self.unknown + 1) + b] = (order[library.get_score(i)], i)
        self.keys = np.array([*sorted(pairs), -1], np.int64)  # -1: no pair
        self.ranks = np.array([*(pairs[k][0] for k in self.keys[:-1].tolist()), _NONE], np.int32)
        self.made = np.array([*(pairs[k][1] for k in self.keys[:-1].tolist()), 0], np.int64)
        self.bits = max(4, len(pairs).bit_length() + 3)
        self.slot = np.full((1 << self.bits) + len(pairs), len(pairs), np.int32)
        for k, h in enumerate(self.hash(self.keys[:-1]).tolist()):
            while self.slot[h] < len(pairs):
                h += 1
            self.slot[h] = k
        inside = sorted({c for i in plain if len(names[i]) > 1 for c in names[i]})
        self.place = np.zeros(0x110000, np.int64)  # 0: a character that stands beside none
        for k, c in enumerate(inside, 1):
            self.place[ord(c)] = k
        self.place[32] = self.place[ord(BLANK)]
        self.beside = np.zeros((len(inside) + 1) ** 2, bool)
        self.places = len(inside) + 1
        for i in plain:
            at = self.place[[ord(c) for c in names[i]]]
            self.beside[at[:-1] * self.places + at[1:]] = True
        line = "\n" if not any("\n" in names[i] and len(names[i]) > 1 for i in plain) else ""
        self.unit = re.compile(f" *[^ {line}]+| +" + f"|{line}" * bool(line))
        self.byte_id = np.zeros(256, np.int64)
        for i in np.flatnonzero(self.is_byte).tolist():
            self.byte_id[int(names[i][3:-1], 16)] = i
        blobs = [names[i].replace(BLANK, " ").encode() for i in range(self.size)]
        for i in range(self.size):
            if self.is_byte[i]:
                blobs[i] = bytes([int(names[i][3:-1], 16)])
            elif self.is_control[i]:
                blobs[i] = b""
            elif self.is_unknown[i]:
                blobs[i] = " ⁇ ".encode()
        self.blob = np.frombuffer(b"".join(blobs), np.uint8)
        self.blob_size = np.array([len(b) for b in blobs], np.int64)
        self.blob_at = np.cumsum(self.blob_size) - self.blob_size
        self.leads = np.array([n.startswith(BLANK) for n in names])

    def look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair and the piece that it makes."""
        key = a * (self.unknown + 1) + b
        h = self.hash(key)
        at = self.slot[h]
        other = np.flatnonzero(self.keys[at] != key)
        other = other[at[other] < len(self.keys) - 1]
        while len(other):  # the slot is taken by another pair: the next one
            h[other] += 1
            at[other] = self.slot[h[other]]
            other = other[(self.keys[at[other]] != key[other]) & (at[other] < len(self.keys) - 1)]
        return self.ranks[at], self.made[at]

    def hash(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def merge(self, sym: np.ndarray, first: np.ndarray) -> np.ndarray:
        """What is left of each symbol after all merges: a symbol, or -1 where it went into the one before it.

        first marks the symbols that start a segment; no pair reaches across segments."""
        out, pos, start = np.full(len(sym), -1, np.int64), np.arange(len(sym)), np.flatnonzero(first)
        rank, made = np.full(len(sym), _NONE, np.int32), np.zeros(len(sym), np.int64)
        rank[:-1], made[:-1] = self.look(sym[:-1], sym[1:])
        rank[np.append(start[1:], len(sym)) - 1] = _NONE
        while len(start):
            sizes = np.diff(np.append(start, len(sym)))
            low = np.minimum.reduceat(rank, start)
            live = low < _NONE
            if not live.all():
                stays = np.repeat(live, sizes)
                out[pos[~stays]] = sym[~stays]
                sym, pos, rank, made = sym[stays], pos[stays], rank[stays], made[stays]
                low, sizes = low[live], sizes[live]
                start = np.cumsum(sizes) - sizes
                if not len(start):
                    break
            segment = np.repeat(np.arange(len(start)), sizes)
            hit = np.flatnonzero(rank == low[segment])
            run = np.maximum.accumulate(np.where(np.diff(hit, prepend=-2) > 1, hit, 0))  # the last of a segment is no pair
            hit = hit[(hit - run) % 2 == 0]
            own, piece = segment[hit], made[hit]
            # pairs that a merge makes with its neighbours, those to the left being merged already
            before, after = hit > start[own], hit + 2 < (start + sizes)[own]
            left = sym[np.maximum(hit - 1, 0)]
            beside = np.flatnonzero(np.diff(hit) == 2) + 1
            left[beside] = piece[beside - 1]
            worse = ~before | (self.look(left, piece)[0] > low[own])
            worse &= ~after | (self.look(piece, sym[np.minimum(hit + 2, len(sym) - 1)])[0] > low[own])
            if not worse.all():
                last = np.full(len(start), len(sym))
                ends = np.flatnonzero(~worse)[::-1]
                last[own[ends]] = hit[ends]
                took = hit <= last[own]
                hit, piece, own = hit[took], piece[took], own[took]
            sym[hit] = piece
            kept = np.ones(len(sym), bool)
            kept[hit + 1] = False
            moved = np.cumsum(kept) - 1
            sym, pos, rank, made = sym[kept], pos[kept], rank[kept], made[kept]
            start, hit = moved[start], moved[hit]
            ends = np.append(start[1:], len(sym)) - 1
            for at in (hit[hit < ends[own]], (hit - 1)[hit > start[own]]):
                rank[at], made[at] = self.look(sym[at], sym[at + 1])
            rank[ends] = _NONE
        return out

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words (blanks in them are blanks) one after the other, and how many each has."""
        chars = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        if not len(chars):
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        place = self.place[chars]
        first = np.append(True, ~self.beside[place[:-1] * self.places + place[1:]] | (word[1:] != word[:-1]))
        merged = self.merge(self.symbol_of_char[chars], first)
        kept = merged >= 0
        ids, chars, word = merged[kept], chars[kept], word[kept]
        foreign = ids >= self.size
        if foreign.any():
            spelled = np.frombuffer("".join(map(chr, chars[foreign].tolist())).encode(), np.uint8)
            c = chars[foreign]
            counts = np.ones(len(ids), np.int64)
            counts[foreign] = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
            word, is_foreign, ids = np.repeat(word, counts), np.repeat(foreign, counts), np.repeat(ids, counts)
            ids[is_foreign] = self.byte_id[spelled]
        return ids, np.bincount(word, minlength=len(words))

    def encode(self, texts: Iterable[str], stretch: int = STRETCH) -> Iterator[np.ndarray]:
        """The ids of each text, with begin and end ids. Texts are taken together up to stretch characters."""
        seen: dict[str, int] = {}
        codes: list[np.ndarray] = []
        ends: list[int] = []  # after which of codes a text ends
        done: list[np.ndarray] = []  # of a text that is not whole yet
        held = 0

        def flush() -> Iterator[np.ndarray]:
            ids, counts = self.encode_words(list(seen))
            starts = np.cumsum(counts) - counts
            unit = np.concatenate(codes) if codes else np.zeros(0, np.int64)
            sizes = counts[unit]
            total = np.cumsum(sizes)
            flat = ids[np.repeat(starts[unit] - total + sizes, sizes) + np.arange(total[-1] if len(total) else 0)]
            units = np.cumsum([0, *map(len, codes)])
            cuts = np.append(0, total)[units]
            begin = 0
            for end in ends:
                done.append(flat[cuts[begin] : cuts[end]])
                yield np.concatenate([[self.bos], *done, [self.eos]]).astype("<u4")
                done.clear()
                begin = end
            done.append(flat[cuts[begin] : cuts[-1]])
            seen.clear(), codes.clear(), ends.clear()

        for text in texts:
            spaced, at = " " * bool(text) + text.replace(BLANK, " "), 0
            while at < len(spaced):
                seam = _SEAM.search(spaced, at + stretch) if len(spaced) - at > stretch else None
                to = seam.start() if seam else len(spaced)
                units = self.unit.findall(spaced, at, to)
                codes.append(np.array([seen.setdefault(u, len(seen)) for u in units], np.int64))
                held, at = held + to - at, to
                if held >= stretch and at < len(spaced):
                    yield from flush()
                    held = 0
            ends.append(len(codes))
            if held >= stretch:
                yield from flush()
                held = 0
        yield from flush()

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """The text of each list of ids, as the library puts it together."""
        flat = np.concatenate(ids).astype(np.int64) if ids else np.zeros(0, np.int64)
        if len(flat) and int(flat.max()) >= self.size:
            raise ValueError("an id that the model does not have")
        sizes = self.blob_size[flat]
        total = np.cumsum(sizes)
        chars = self.blob[np.repeat(self.blob_at[flat] - total + sizes, sizes) + np.arange(total[-1] if len(total) else 0)]
        out, at, seen = [], 0, np.append(0, total)
        for own in ids:
            end = at + len(own)
            begin = int(seen[at])
            speaks = np.flatnonzero(~self.is_control[own.astype(np.int64)])[:1]  # the first piece loses the blank that encoding put before the text
            if len(speaks) and self.leads[int(own[speaks[0]])]:
                begin += 1
            # bytes on two sides of a control piece are never one character
            cuts = [begin, *seen[at + np.flatnonzero(self.is_control[own.astype(np.int64)][1:-1]) + 1].tolist(), int(seen[end])]
            out.append("".join(chars[a:b].tobytes().decode("utf-8", "one_by_one") for a, b in zip(cuts, cuts[1:], strict=False)))
            at = end
        return out


def _one_by_one(error: UnicodeError) -> tuple[str, int]:
    """Each byte that is no part of a character becomes a mark of its own."""
    return "�", error.start + 1


codecs.register_error("one_by_one", _one_by_one)


@functools.lru_cache(1)
def model(name: str = MODEL) -> Model:
    import public_tokenizers

    return Model(public_tokenizers.path(name))


def encode(docs: DataFrame, name: str = MODEL) -> DataFrame:
    """(doc_id, n_tokens, ids) of every text of docs (doc_id, text); ids are little-endian unsigned 32-bit integers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size, at = [], 0, 0
            for ids in model(name).encode(x.as_py() or "" for x in batch.column(1)):
                rows.append(ids)
                size += ids.nbytes
                if size > 1 << 24 or at + len(rows) == batch.num_rows:
                    ids_of = pa.array([x.tobytes() for x in rows], pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(at, len(rows)), pa.array([len(x) for x in rows], pa.int64()), ids_of], names=["doc_id", "n_tokens", "ids"]
                    )
                    at, rows, size = at + len(rows), [], 0

    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return shared.map_batches(source, run, f"doc_id {kind}, n_tokens bigint, ids binary")


def decode(encoded: DataFrame, name: str = MODEL) -> DataFrame:
    """encoded (doc_id, n_tokens, ids) with the text that the ids stand for."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = batch.column(2).fill_null(b"")
            at = 0
            while at < batch.num_rows:
                own, size = [], 0
                while at + len(own) < batch.num_rows and size < 1 << 22:
                    own.append(np.frombuffer(blobs[at + len(own)].as_buffer(), "<u4"))
                    size += own[-1].nbytes
                texts_of = pa.array(model(name).decode(own), pa.string())
                yield pa.RecordBatch.from_arrays([*(c.slice(at, len(own)) for c in batch.columns), texts_of], names=["doc_id", "n_tokens", "ids", "text"])
                at += len(own)

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return shared.map_batches(encoded.select("doc_id", "n_tokens", "ids"), run, f"doc_id {kind}, n_tokens bigint, ids binary, text string")


def op12_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode(encode(texts(spark, sf_dir, "doc_id", "text"))).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256")
    )
