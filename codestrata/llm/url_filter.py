"""URL filters: block and allow rules by host and path, and gradient-boosted trees on lexical features for the rest.

A rule is a host and the start of a path; it fits its host and all subdomains, and the longest rule that fits wins.
URLs without a rule are judged by boosted trees trained from labelled URLs: length, depth, digit ratio, entropy,
parameter and hyphen counts, and the share of bad URLs among the training URLs with the same host suffix.

Training is on the driver, from a bounded sample (a parameter); every row is judged, in one pass without a shuffle.

Cases: a null URL or one without "://" has an empty host and path, no rule, and is judged by the trees like any other;
a URL of any length is read whole; repeated rows are judged each; of rules of equal length that fit, the more specific
host wins; other columns, whatever their names, are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import shared

RULES = {
    "com/en/": "block",
    "example.com/en/7": "allow",
    "net/de/": "allow",
    "example.net/de/8": "block",
    "org/es/": "block",
}
#: Labelled URLs used for training at most, trees, depth, learning rate, least leaf, cut points for a feature.
MAX_TRAINING, TREES, DEPTH, RATE, LEAF, CUTS = 20_000, 40, 3, 0.3, 20, 32
SEED = 5

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_HOST_END, _PATH_END = re.compile(r"[/?#]"), re.compile(r"[?#]")


def parts(url: str | None) -> tuple[str, str]:
    """(host, path): after the first "://" to "/", "?", "#" or the end, A to Z in lower case; then to "?" or "#"."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    cut = m.start() if (m := _HOST_END.search(rest)) else len(rest)
    path = rest[cut:]
    return rest[:cut].translate(_LOWER), path[: m.start()] if (m := _PATH_END.search(path)) else path


def by_host(rules: dict[str, str]) -> dict[str, list[tuple[str, str, str]]]:
    """Rules by host, the longest first: (path, rule, verdict)."""
    out: dict[str, list] = {}
    for rule, verdict in rules.items():
        host, slash, path = rule.partition("/")
        out.setdefault(host, []).append((slash + path, rule, verdict))
    return {h: sorted(r, key=lambda x: -len(x[1])) for h, r in out.items()}


def match(host: str, path: str, rules: dict[str, list]) -> tuple[str | None, str | None]:
    best, suffix = (None, None), host
    while suffix:
        for start, rule, verdict in rules.get(suffix, ()):
            if path.startswith(start) and (best[0] is None or len(rule) > len(best[0])):
                best = (rule, verdict)
                break
        _, _, suffix = suffix.partition(".")
    return best


def lexical(url: str, suffixes: dict[str, float]) -> list[float]:
    host, path = parts(url)
    n = max(1, len(url))
    counts = Counter(url)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    query = url.partition("?")[2].partition("#")[0]
    labels = host.split(".")
    words = [x for x in re.split(r"[^a-z]+", host) if x]
    return [
        len(url),
        len(host),
        len(path),
        path.count("/"),
        sum(c.isdigit() for c in url) / n,
        sum(c.isdigit() for c in host) / max(1, len(host)),
        entropy,
        query.count("=") + query.count("&"),
        host.count("-"),
        len(labels),
        max(map(len, words), default=0),
        sum(c in "aeiou" for c in host) / max(1, len(host)),
        suffixes.get(labels[-1], suffixes[""]),
        suffixes.get(".".join(labels[-2:]), suffixes[""]),
    ]


class Trees:
    """Boosted regression trees for the log-odds of a label, on binned features; complete trees of a fixed depth."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, CUTS + 1)[1:-1])) for c in x.T]
        bins = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T, strict=True)], 1)
        mean = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base, self.trees = math.log(mean / (1 - mean)), []
        score = np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            gradient, weight = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            feature, cut = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf)
            for level in range(DEPTH):
                for k in range(2**level):
                    here = np.flatnonzero(node == k)
                    f, b = self._split(bins[here], gradient[here], weight[here])
                    if f >= 0:
                        feature[2**level - 1 + k], cut[2**level - 1 + k] = f, cuts[f][b]
                place = 2**level - 1 + node
                node = 2 * node + (x[np.arange(len(y)), feature[place]] > cut[place])
            g, w = np.bincount(node, gradient, 2**DEPTH), np.bincount(node, weight, 2**DEPTH)
            value = RATE * g / (w + 1.0)
            self.trees.append((feature, cut, value))
            score += value[node]
        return self

    @staticmethod
    def _split(bins: np.ndarray, g: np.ndarray, w: np.ndarray) -> tuple[int, int]:
        best, where = 1e-9, (-1, 0)
        for f in range(bins.shape[1]):
            top = bins[:, f].max() + 1 if len(bins) else 0
            if top < 2:
                continue
            left_g = np.cumsum(np.bincount(bins[:, f], g, top))[:-1]
            left_w = np.cumsum(np.bincount(bins[:, f], w, top))[:-1]
            left_n = np.cumsum(np.bincount(bins[:, f], minlength=top))[:-1]
            right_g, right_w = g.sum() - left_g, w.sum() - left_w
            gain = left_g**2 / (left_w + 1) + right_g**2 / (right_w + 1) - g.sum() ** 2 / (w.sum() + 1)
            gain[(left_n < LEAF) | (len(g) - left_n < LEAF)] = 0
            if gain.max(initial=0) > best:
                best, where = gain.max(), (f, int(gain.argmax()))
        return where

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(DEPTH):
                place = 2**level - 1 + node
                node = 2 * node + (x[rows, feature[place]] > cut[place])
            total += value[node]
        return 1 / (1 + np.exp(-total))


def fit(urls: list[str], bad: list[int]) -> tuple[Trees, dict[str, float]]:
    """Trees and suffix statistics from labelled URLs (1: bad)."""
    if not urls:
        return Trees().fit(np.zeros((2, len(lexical("", {"": 0.0})))), np.array([0, 0])), {"": 0.0}
    seen, hits = Counter(), Counter()
    for url, y in zip(urls, bad, strict=True):
        labels = parts(url)[0].split(".")
        for s in {labels[-1], ".".join(labels[-2:])}:
            seen[s] += 1
            hits[s] += y
    rate = sum(bad) / len(bad)
    suffixes = {s: (hits[s] + 20 * rate) / (n + 20) for s, n in seen.items() if n >= 5} | {"": rate}
    x = np.array([lexical(u, suffixes) for u in urls], float)
    return Trees().fit(x, np.asarray(bad, float)), suffixes


def fit_table(labelled: DataFrame, limit: int = MAX_TRAINING) -> tuple[Trees, dict[str, float]]:
    """fit on a table (url, label), on the first `limit` rows in order of a hash of the URL; null rows don't count."""
    rows = labelled.where("url is not null and label is not null").selectExpr("url", "label").orderBy("xxhash64(url)", "url").limit(limit).collect()
    return fit([r[0] for r in rows], [int(r[1]) for r in rows])


def generated(count: int = 4000, seed: int = SEED) -> tuple[list[str], list[int]]:
    """Labelled URLs by a seeded generator: plain ones, and ones with the marks of link farms.

    Names are made of a consonant and a vowel at a time and domains are drawn from public endings, so that no name of
    a table to be judged is learned. Plain hosts have a hyphen or a number now and then, bad ones mostly.
    """
    r = random.Random(seed)
    word = lambda least=2, most=4: "".join(r.choice("bcdfghklmnprstvwz") + r.choice("aeiou") + r.choice(("", "", "n", "r", "s", "l")) for _ in range(r.randint(least, most)))
    number = lambda most: str(r.randint(1, most))
    pairs = lambda n: "&".join(f"{r.choice(('id', 'ref', 'src', 'page', 'aff', 'clk', word(1, 1)))}={r.choice((number(9999), f'{r.getrandbits(48):x}'))}" for _ in range(n))
    urls, bad = [], []
    for _ in range(count):
        y = int(r.random() < 0.3)
        joined = r.choice((2, 2, 3, 4)) if r.random() < (0.92 if y else 0.03) else 1
        name = "-".join(word(1, 3) for _ in range(joined)) + (number(9999) if r.random() < (0.3 if y else 0.05) else "")
        host = r.choice(("", "", "", "www.", "m.", word(1, 2) + ".")) + name + r.choice(("", "", "." + word())) + "." + r.choice(("com", "org", "net", "info", "biz", "io", "de", "fr"))
        path = "".join("/" + r.choice((word(), number(9999), word(1, 1), f"{word()}-{word()}")) for _ in range(r.randint(0, 6 if y else 4)))
        tail = r.choice(("", "", "/", ".html", "#" + word(), "?" + pairs(1), "?" + pairs(2)))
        if y and r.random() < 0.5:
            tail = "?" + pairs(r.randint(3, 7))
        urls.append(f"http{r.choice(('', 's'))}://{host}{path}{tail}")
        bad.append(y)
    return urls, bad


@functools.lru_cache(2)
def default_model(count: int = 4000, seed: int = SEED) -> tuple[Trees, dict[str, float]]:
    return fit(*generated(count, seed))


def filter_urls(pages: DataFrame, rules: dict[str, str] = RULES, model: tuple | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row of pages.

    rule is null where none fits; verdict is the rule's, else "block" where the trees' score is 0.5 or more.
    """
    trees, suffixes = model or default_model()
    hosts = by_host(rules)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = batch.column(1).to_pylist()
            split = [parts(u) for u in urls]
            found = [match(h, p, hosts) for h, p in split]
            score = trees.score(np.array([lexical(u or "", suffixes) for u in urls], float).reshape(len(urls), -1)) if urls else np.zeros(0)
            verdict = [v or ("block" if s >= 0.5 else "allow") for (_, v), s in zip(found, score, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([h for h, _ in split], pa.string()),
                    pa.array([p for _, p in split], pa.string()),
                    pa.array([f for f, _ in found], pa.string()),
                    pa.array(verdict, pa.string()),
                    pa.array(score, pa.float64()),
                ],
                names=["page_id", "host", "path", "rule", "verdict", "score"],
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return shared.map_batches(
        pages.select("page_id", "url"), run, f"page_id {kind}, host string, path string, rule string, verdict string, score double"
    )


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(shared.read_table(spark, sf_dir, "pages"))
