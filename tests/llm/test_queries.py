"""The registered queries and the pipeline on small tables, against versions that are plain and slow."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from codestrata.llm import minhash_dedup, mixing, packing, pii, queries, secret_scan, shared, url_filter

SYLLABLES = ("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "es", "la", "ment", "que", "st", "ou")
HOSTS = ("a.example.com", "example.com", "x.example.net", "net", "b.org", "cheap-pills.example.org", "com.evil", "EXAMPLE.Com")
PATHS = ("/en/7", "/en/8?a=1", "/de/8", "/de/", "/es/x#y", "", "?q=/en/", "/fr/1", "/en")


def prose(r, n):
    return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(n))


def secret(r):
    return f'token = "{r.getrandbits(160):040x}"'


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r, folder = random.Random(21), tmp_path_factory.mktemp("tables")
    texts = [prose(r, r.choice((5, 25, 60, 300))) for _ in range(120)]
    texts += [t for t in texts[:20]] + [re.sub(r"^\S+", "changed", t) for t in texts[20:50]]
    texts += [prose(r, 40) + " " + secret(r) + " " + prose(r, 5) for _ in range(15)]
    texts += [prose(r, 30) + f" a{i}@mail.example.org 10.0.0.{i} +1 (017) 555-77{i:02d} 4111111111111111" for i in range(10)] + [None, ""]
    docs = [(i, t, r.choice(("en", "de")), r.choice(("src0", "src0", "src1", "src2")), len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    urls = [f"http{s}://{h}{p}" for s in ("", "s") for h in HOSTS for p in PATHS] + [None, "", "example.com/en/7", "x://y://z/en/"]
    spark.createDataFrame([(i, u, "<html>") for i, u in enumerate(urls)], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return str(folder), docs, urls


def test_urls(spark, tables):
    folder, _, urls = tables
    rules = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "block"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
    got = {r.page_id: r for r in queries.QUERIES["op5_url_filter"](spark, folder).collect()}
    assert len(got) == len(urls)
    for i, url in enumerate(urls):
        m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, max(fits)[1] if fits else None)
        assert got[i].verdict == max(fits)[2] if fits else got[i].verdict in ("allow", "block")
        assert "cheap-pills" not in host or fits or got[i].verdict == "block"


def test_personal_data(spark, tables):
    folder, docs, _ = tables
    got = {r.doc_id: r for r in queries.QUERIES["op3_pii"](spark, folder).collect()}
    for i, text, *_ in docs:
        base = ",".join(f"{k}:{s}:{e}" for s, e, k in pii.base_spans(text or ""))
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert got[i].n_email == base.count("email:") and set(filter(None, base.split(","))) <= set(got[i].spans.split(","))


def test_secrets(spark, tables):
    folder, docs, _ = tables
    rows = queries.QUERIES["op7_secret_scan"](spark, folder).collect()
    found = {(r.doc_id, r.start, r.start + r.length) for r in rows if r.is_secret}
    assert found == {(i, m.start(1), m.end(1)) for i, t, *_ in docs for m in re.finditer('token = "([0-9a-f]{40})"', t or "")}


def fill(children, amount):
    """Budgets of (capacity, weight) nodes: the emptiest by weight fill up first, the others share what is left."""
    out, left = {}, amount
    order = sorted(children, key=lambda k: (children[k][0] / children[k][1], k))
    for n, k in enumerate(order):
        level = left / sum(children[j][1] for j in order[n:])
        if children[k][0] >= children[k][1] * level:
            return out | {j: min(children[j][0], math.floor(children[j][1] * level)) for j in order[n:]}
        out[k], left = children[k][0], left - children[k][0]
    return out


def mixed(docs):
    """Copies by doc_id, from (doc_id, text, lang, source)."""
    leaf, tokens, digest = {}, {}, {}
    for i, text, lang, source in docs:
        domain = "d" + str(int(hashlib.md5(source.encode()).hexdigest()[0], 16) % 4)
        tokens[i], digest[i] = len((text or "").split()), hashlib.md5((text or "").encode()).hexdigest()
        leaf.setdefault((domain, lang, source), []).append(i)
    size = {k: sum(tokens[i] for i in v) for k, v in leaf.items()}
    given = {(): math.floor(sum(size.values()) * mixing.BUDGET_SHARE)}
    for depth, level in enumerate(mixing.LEVELS):
        for parent in {k[:depth] for k in size}:
            children = {}
            for k, n in size.items():
                if k[:depth] == parent:
                    cap, _ = children.get(k[: depth + 1], (0, 0))
                    children[k[: depth + 1]] = (cap + n * mixing.MAX_EPOCHS, mixing.WEIGHTS[level].get(k[depth], 1))
            given |= fill(children, given[parent])
    copies = {}
    for k, ids in leaf.items():
        epochs, rest = divmod(given[k], size[k]) if size[k] else (0, 0)
        total = 0
        for i in sorted(ids, key=lambda i: (hashlib.md5(f"{mixing.SEED}:{epochs}:{i}:{digest[i]}".encode()).hexdigest(), i)):
            total += tokens[i]
            copies[i] = epochs + (rest > 0 and total <= rest)
    return copies


def test_mixing(spark, tables):
    folder, docs, _ = tables
    got = {r.doc_id: r.copies for r in queries.QUERIES["op1_mixing"](spark, folder).collect()}
    assert got == mixed([d[:4] for d in docs])


def test_pipeline(spark, tables):
    """Stage after stage in plain Python: base rules (too few labels for cutoffs), all pairs, a pattern, budgets, ids."""
    folder, docs, _ = tables
    kept = [d for d in docs if len((d[1] or "").split()) >= 20]  # no text here repeats eight words
    words = minhash_dedup.idf_table(spark.createDataFrame([(d[1],) for d in kept], "text string"))
    sets = [minhash_dedup.elements(*minhash_dedup.shingles(minhash_dedup.word_hashes(d[1]), words)) for d in kept]
    linked = np.array([[a is not b and (x[1] == y[1] or minhash_dedup.similarity(a, b) >= 0.8) for b, y in zip(sets, kept, strict=True)] for a, x in zip(sets, kept, strict=True)])
    root = shared.least_reachable(linked)
    kept = [d for n, d in enumerate(kept) if root[n] == n]
    kept = [(d[0], re.sub('(token = ")[0-9a-f]{40}"', rf'\g<1>{secret_scan.MARK}"', d[1]), d[2], d[3]) for d in kept]
    copies = mixed(kept)
    expected = {i: (n, len(packing.encode(t)) + 1) for i, t, *_ in kept if (n := copies[i])}
    rows = corpus_pipeline.run(spark, folder).collect()
    got: dict[int, list] = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(r)
    assert {i: (sum(p.start == 0 for p in v), v[0].doc_tokens) for i, v in got.items()} == expected
    assert all(sum(p.length for p in v) == expected[i][0] * expected[i][1] for i, v in got.items())
    places = sorted((r.sequence_id * 1024 + r.offset, r.length) for r in rows)
    assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:], strict=False))
    assert len(got) < len(docs) and max(n for n, _ in expected.values()) >= 1


def test_stages_chain_unwritten(spark, tables):
    """All stages one on the other, nothing written in between, and another run of the pipeline before the rows are read."""
    folder, _, _ = tables
    docs = shared.read_table(spark, folder, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
    want = corpus_pipeline.run(spark, folder).groupBy("doc_id", "start").count().collect()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert sorted(packed.groupBy("doc_id", "start").count().collect()) == sorted(want)


def test_what_nothing_reads_is_deleted(spark, tables, tmp_path):
    """A stage's tables go when the next stage begins, once its rows are written; those of another run stay."""
    folder, _, _ = tables
    first = corpus_pipeline.quality(spark, shared.read_table(spark, folder, "documents"), folder)
    kept = corpus_pipeline._left.get()
    mine = [p for p in kept if p.rsplit("/", 1)[-1].startswith("quality")][-1:]
    corpus_pipeline.run(spark, folder)
    first.write.parquet(f"{tmp_path}/first")
    corpus_pipeline.secrets(spark, spark.read.parquet(f"{tmp_path}/first"), folder)
    assert mine and not set(mine) & set(corpus_pipeline._left.get())
    with pytest.raises(Exception, match="(?i)not.?exist"):
        spark.read.parquet(mine[0])


def test_rules_of_the_contract(spark):
    urls = ["http://a.com/en/1", "http://b.example.com/en/7", "http://a.net/de/1", "http://x.example.net/de/8", "http://a.org/es/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.rule: r.verdict for r in url_filter.filter_urls(pages).collect()}
    assert got == {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
