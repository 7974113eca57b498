r"""Personal data: exact patterns, and a semi-Markov conditional random field that adds what they miss.

The patterns (BASE) give the base spans. The field labels segments, not tokens: a candidate segment of at most
MAX_TOKENS tokens gets features of the whole span (its shape, digits, checksums, what stands around it), and dynamic
programming over segment ends chooses boundaries and kinds jointly. Segments are bounded, so the work is linear in
the text. Only stretches around a digit or an at sign can hold an entity, so only these are decoded; elsewhere the
outside label is the only one. Its spans are added where they touch no base span; base spans always stay.

The weights are trained here, on the driver, from labelled sentences that a seeded generator writes (their number is
a parameter): forward-backward over segments, stochastic gradient steps. Every whole text is scanned in one pass over
the table, without a shuffle.

Cases: a null text is empty and has no spans; a text of any length is scanned whole, in time linear in it; repeated
rows are scanned each; of segmentations of equal score that of the shortest last segment wins; other columns, whatever
their names, are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import math
import random
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.plans.adapters import texts

from . import shared

KINDS = ("email", "ip", "card", "phone")
OUTSIDE = "outside"
#: Tokens in a segment, and tokens whose segments are listed at a time.
MAX_TOKENS, BLOCK = 12, 400
#: Labelled sentences that the field is trained from, rounds over them, and the generator's seed.
SENTENCES, EPOCHS, SEED = 500, 5, 11

# The same matches as the patterns of the contract, without their backtracking: a run of digits is never entered
# in its middle, as it would fail there like at its start.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed; code points, end exclusive; overlaps between kinds stay."""
    found = []
    # email: for the first at sign that a local part precedes, the local part reaches left as far as it can
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, 0, m.end()))
            free = m.end()
        else:
            free = at + 1  # no local part can reach over the sign
        at = text.find("@", max(at + 1, free))
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(g) < 20 and int(g) <= 255 for g in (x.lstrip("0") or "0" for x in m.groups()))]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m.group()) <= 15]
    return [(s, e, KINDS[k]) for s, k, e in sorted(found)]


_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\s+|[^\s]")


def each_token(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    return (m.span() for m in _TOKEN.finditer(text, start, end))


def tokens_of(text: str, start: int = 0, end: int | None = None) -> list[tuple[int, int]]:
    return list(each_token(text, start, len(text) if end is None else end))


def _shape(piece: str) -> str:
    return re.sub(r"9+", "9", re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]", "9", piece)))


def _piece_features(piece: str) -> tuple[list[str], list[str]]:
    """The features that a piece has wherever it stands: those before and after the ones of its surroundings."""
    groups = re.findall(r"[0-9]+", piece)
    digits = "".join(groups)
    first = [
        "shape=" + _shape(piece)[:24],
        f"digits={min(len(digits), 20)}",
        f"groups={min(len(groups), 6)}:{','.join(str(min(len(g), 9)) for g in groups[:5])}",
    ]
    last = []
    if 13 <= len(digits) <= 19:
        last.append(f"luhn={luhn(digits)}:{14 <= len(digits)}")
    if len(groups) == 4 and re.fullmatch(r"[0-9]+(\.[0-9]+){3}", piece):
        last.append(f"octets={all(len(g) < 4 and int(g) < 256 for g in groups)}")
    if "@" in piece:
        last.append(f"address={bool(re.fullmatch(r'[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+', piece))}:{piece.count('@')}")
    return first, last


_short_piece_features = functools.lru_cache(1 << 14)(_piece_features)


def span_features(text: str, start: int, end: int) -> list[str]:
    """Features of a whole candidate span, apart from its label."""
    piece = text[start:end]
    first, last = (_short_piece_features if len(piece) <= 64 else _piece_features)(piece)
    before, after = text[start - 1 : start], text[end : end + 1]
    out = [
        *first,
        f"left={'word' if before.isalnum() else before if before in '+@.-_%(' else 'edge'}",
        f"right={'word' if after.isalnum() else after if after in '@-_%' else 'edge'}",
    ]
    if after == "." and text[end + 1 : end + 2].isalnum():
        out.append("right=goes on")
    out += last
    words = re.findall(r"[^\W\d_]+", text[max(0, start - 24) : start])
    if words:
        out.append("word=" + words[-1].lower()[:12])
    return out


def candidates(text: str, spans: list[tuple[int, int]]) -> dict[tuple[int, int], list[str]]:
    """The segments (first token, end token) that can be an entity, with their features."""
    n, out = len(spans), {}
    marked = [bool(re.search("[0-9@]", text[a:b])) for a, b in spans]
    for i in range(n):
        first = text[spans[i][0]]
        if not (first.isalnum() or first in "+("):
            continue
        has = False
        for j in range(i, min(n, i + MAX_TOKENS)):
            a, b = spans[j]
            if text[a] in "\n\r" or b - a > 1 and text[a].isspace():
                break
            has |= marked[j]
            if has and text[b - 1].isalnum():
                out[i, j + 1] = span_features(text, spans[i][0], b)
    return out


def _outside_features(text: str, a: int, b: int) -> list[str]:
    return ["out=" + _shape(text[a:b])[:4], "out:digits=" + str(min(sum(c.isdigit() for c in text[a:b]), 17))]


class Field:
    """Weights by (label, feature); scores, training and decoding."""

    def __init__(self, weights: dict | None = None) -> None:
        self.weights = weights if weights is not None else {}

    def lattice(self, text: str, spans: list[tuple[int, int]]):
        """For each end token the segments that end there: (first token, label, score, features)."""
        w, ends = self.weights, [[] for _ in range(len(spans) + 1)]
        for j, (a, b) in enumerate(spans):
            f = _outside_features(text, a, b)
            ends[j + 1].append((j, OUTSIDE, sum(w.get((OUTSIDE, x), 0.0) for x in f), f))
        for (i, j), f in candidates(text, spans).items():
            for kind in KINDS:
                ends[j].append((i, kind, sum(w.get((kind, x), 0.0) for x in f) + w.get((kind, "bias"), 0.0), [*f, "bias"]))
        return ends

    def best_lattice(self, text: str, spans: list[tuple[int, int]]):
        """lattice(), with the best kind only of each segment and without features; equal features are scored once."""
        w, known, ends = self.weights, {}, [[] for _ in range(len(spans) + 1)]
        for j, (a, b) in enumerate(spans):
            f = _outside_features(text, a, b)
            ends[j + 1].append((j, OUTSIDE, sum(w.get((OUTSIDE, x), 0.0) for x in f)))
        for (i, j), f in candidates(text, spans).items():
            if (key := tuple(f)) not in known:
                scores = [sum(w.get((kind, x), 0.0) for x in f) + w.get((kind, "bias"), 0.0) for kind in KINDS]
                known[key] = KINDS[scores.index(max(scores))], max(scores)
            ends[j].append((i, *known[key]))
        return ends

    def decode(self, text: str, spans: Iterable[tuple[int, int]]) -> list[tuple[int, int, str]]:
        """The best segmentation's entities. Segments are listed by blocks of tokens, and the last MAX_TOKENS states are
        carried on to the next block, so that the result is that of one block and memory is bounded by the entities."""
        rest, kept, best, paths = iter(spans), [], [0.0], [None]
        while block := list(itertools.islice(rest, BLOCK)):
            window = kept + block
            for j, found in enumerate(self.best_lattice(text, window)[len(best) :], len(best)):
                best.append(-math.inf)
                for i, label, score in found:
                    if best[i] + score > best[j]:
                        best[j], last = best[i] + score, (i, label)
                i, label = last
                paths.append(paths[i] if label == OUTSIDE else (paths[i], (window[i][0], window[j - 1][1], label)))
            kept, best, paths = window[1 - MAX_TOKENS :], best[-MAX_TOKENS:], paths[-MAX_TOKENS:]
        out, path = [], paths[-1]
        while path:
            path, entity = path
            out.append(entity)
        return out[::-1]

    def learn(self, text: str, gold: list[tuple[int, int, str]], rate: float) -> None:
        """A gradient step on the log-likelihood of the gold segmentation (forward-backward over segments)."""
        spans = tokens_of(text)
        ends, n = self.lattice(text, spans), len(spans)

        def add(a: float, b: float) -> float:
            return max(a, b) + math.log1p(math.exp(-abs(a - b))) if a > -math.inf else b

        forward, backward = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
        for j in range(1, n + 1):
            for i, _, s, _ in ends[j]:
                forward[j] = add(forward[j], forward[i] + s)
        for j in range(n, 0, -1):
            for i, _, s, _ in ends[j]:
                backward[i] = add(backward[i], backward[j] + s)
        true = {(a, b): k for a, b, k in gold}
        covered = [any(a <= x < b for a, b, _ in gold) for x, _ in spans]
        for j in range(1, n + 1):
            for i, label, s, feats in ends[j]:
                share = math.exp(min(0.0, forward[i] + s + backward[j] - forward[n]))
                hit = not covered[i] if label == OUTSIDE else true.get((spans[i][0], spans[j - 1][1])) == label
                if abs(step := rate * (hit - share)) > 1e-6:
                    for f in feats:
                        self.weights[label, f] = self.weights.get((label, f), 0.0) + step


def sentences(count: int, seed: int = SEED) -> Iterator[tuple[str, list[tuple[int, int, str]]]]:
    """Labelled sentences: invented words with personal data and with look-alikes that are none."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "es", "la", "ment", "que")) for _ in range(r.randint(1, 4)))
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def card() -> str:
        body = num(r.choice((13, 15, 15, 15, 18)))
        whole = next(body + str(d) for d in range(10) if luhn(body + str(d)))
        return "-".join(whole[i : i + 4] for i in range(0, len(whole), 4)) if r.random() < 0.2 else whole

    octet = lambda: str(r.randint(0, 255))
    make = {
        "email": lambda: f"{word()}{r.choice(('', '.', '_'))}{num(r.randint(0, 2))}@{r.choice(('mail', word()))}{num(r.randint(0, 1))}.{r.choice(('example', word()))}.{r.choice(('com', 'org', 'de'))}",
        "ip": lambda: ".".join(octet() for _ in range(4)),
        "card": card,
        "phone": lambda: r.choice((f"+{r.randint(1, 99)} ({num(3)}) {num(3)}-{num(4)}", f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"+{r.randint(1, 99)} {num(3)} {num(7)}")),
    }

    def not_luhn() -> str:
        while luhn(x := num(16)):
            pass
        return x

    alike = (
        not_luhn, not_luhn, lambda: f"{r.randint(1, 9)}.{r.randint(0, 9)}", lambda: f"{r.randint(1, 9)}.{r.randint(0, 9)}.{r.randint(0, 30)}",
        lambda: f"20{num(2)}-{r.randint(10, 12)}-{r.randint(10, 28)}", lambda: num(r.randint(1, 7)), lambda: f"{r.randint(256, 999)}.{octet()}.{octet()}.{octet()}",
        lambda: f'"{r.getrandbits(160):040x}"', lambda: f"{r.randint(1, 23)}:{num(2)}", lambda: f"@{word()}", lambda: f"{num(2)}%", lambda: f"{num(1)},{num(3)},{num(3)}",
        lambda: ".".join(octet() for _ in range(5)), lambda: num(r.randint(20, 30)), lambda: f"{word()}{num(3)}",
    )
    for _ in range(count):
        text, gold = word(), []
        for _ in range(r.randint(2, 5)):
            text += " " + word()
            text += r.choice((" ", " ", " ", "\n", ": ", " (")) if r.random() < 0.9 else r.choice(("### ", "!! "))
            if r.random() < 0.6:
                kind = r.choice(KINDS)
                piece = make[kind]()
                gold.append((len(text), len(text) + len(piece), kind))
            else:
                piece = r.choice(alike)()
            text += piece + r.choice(("", "", "", "", ".", ",", "!!", "###", "$$$", ")"))
        yield text + " " + word(), gold


@functools.lru_cache(4)
def trained(count: int = SENTENCES, epochs: int = EPOCHS, seed: int = SEED) -> dict:
    """Weights after training on so many generated sentences; the same for the same parameters."""
    field, data = Field(), list(sentences(count, seed))
    for epoch in range(epochs):
        for text, gold in data:
            field.learn(text, gold, 0.3 / (1 + epoch))
    return field.weights


_MARK = re.compile(r"[0-9@]")


def stretches(text: str) -> Iterator[tuple[int, int]]:
    """The parts of text that can hold an entity: words with a digit or an at sign, with what one blank joins to them.

    A stretch is as long as its text, a table of numbers in one line too: it is never cut, as an entity could be there.
    """
    at, n = 0, len(text)
    while m := _MARK.search(text, at):
        start = m.start()
        while start > at and not text[start - 1].isspace():
            start -= 1
        end, seen = m.end(), m.end()
        while end < n:
            c = text[end]
            if c.isspace() and (c != " " or end - seen > 1 and not _MARK.search(text, end + 1, min(n, end + 6))):
                break
            end += 1
            if _MARK.match(c):
                seen = end
        yield start, end
        at = end


def find(text: str, field: Field) -> tuple[list, list]:
    """(base spans, all spans), each by start, then kind as listed."""
    base = base_spans(text)
    every = list(base)
    taken = sorted((s, e) for s, e, _ in base)
    tops, top = [], 0
    for _, e in taken:
        tops.append(top := max(top, e))
    for a, b in stretches(text):
        for s, e, kind in field.decode(text, each_token(text, a, b)):
            i = bisect.bisect_left(taken, (e, 0)) - 1  # the last base span that starts before e
            if i < 0 or tops[i] <= s:
                every.append((s, e, kind))
    order = {k: i for i, k in enumerate(KINDS)}
    return base, sorted(every, key=lambda x: (x[0], order[x[2]], x[1]))


def find_spans(docs: DataFrame, weights: dict | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base, spans) for every row of docs, in one pass.

    base and spans are strings kind:start:end, comma-joined; positions count code points, ends are exclusive. Rows stay
    apart, with the same doc_id too.
    """
    weights = trained() if weights is None else weights
    write = lambda spans: ",".join(f"{k}:{s}:{e}" for s, e, k in spans)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(weights)
        for batch in batches:
            texts, counts, bases, spans = batch.column(1), [[] for _ in KINDS], [], []
            for i in range(batch.num_rows):
                base, every = find(texts[i].as_py() or "", field)
                for k, kind in enumerate(KINDS):
                    counts[k].append(sum(x[2] == kind for x in base))
                bases.append(write(base))
                spans.append(write(every))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(bases, pa.string()), pa.array(spans, pa.string())],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} bigint" for k in KINDS)
    return shared.map_batches(
        docs.select("doc_id", F.col("text").cast("string").alias("text")), run, f"doc_id {kind}, {counts}, base string, spans string"
    )


def redact(text: str, spans: str) -> str:
    """text with each span of a find_spans string replaced by its kind in angle brackets; overlaps become one."""
    out, at = [], 0
    for part in filter(None, spans.split(",")):
        kind, s, e = part.split(":")
        if int(s) >= at:
            out += [text[at : int(s)], f"<{kind}>"]
        at = max(at, int(e))
    return "".join(out) + text[at:]


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(texts(spark, sf_dir, "doc_id", "text"))
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), "spans")
