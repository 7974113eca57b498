"""Operators against brute force, exact round trips and held-out accuracy, on small inputs."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codestrata.llm import chat_format, embedding_dedup, minhash_dedup, mixing, packing, pii, quality_classifier, quality_rules, secret_scan, shared, url_filter

SYLLABLES = ("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "es", "la", "ment", "que", "st", "ou")


def prose(r, n):
    return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(n))


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(50)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in shared.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in {v for e in edges if e[0] != e[1] for v in e}}


# --- 4 quality rules


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = {}
    for k in range(len(words) - 7):
        seen.setdefault(tuple(words[k : k + 8]), []).append(k)
    covered = {p for ks in seen.values() if len(ks) > 1 for k in ks for p in range(k, k + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark):
    r = random.Random(1)
    texts = ["".join(r.choice("ab #\n\t\x0b😀") for _ in range(r.randint(0, 120))) for _ in range(150)] + ["a " * 30, "", "x\ny\nx\n \n \nx"]
    rows = quality_rules.metrics(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for row in rows:
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == brute_counts(texts[row.doc_id])


def test_binomial_tail(spark):
    cases = [(n, k) for n in (5, 60, 900, 40_000) for k in (0, 1, 4, 30, 399)]
    got = spark.createDataFrame(cases, "n long, k long").select("n", "k", quality_rules.binomial_tail(F.col("n"), F.col("k"), 0.01).alias("p")).collect()
    for row in got:
        exact = math.fsum(math.exp(math.lgamma(row.n + 1) - math.lgamma(i + 1) - math.lgamma(row.n - i + 1) + i * math.log(0.01) + (row.n - i) * math.log(0.99)) for i in range(min(row.n, row.k) + 1))
        assert row.p == pytest.approx(exact, rel=1e-8)


def test_thresholds_limit_rejection(spark):
    r = random.Random(3)
    bad = lambda: " ".join(w + "###" for w in prose(r, 40).split())
    docs = [(i, prose(r, 60), "en", 1) for i in range(3000)] + [(3000 + i, bad(), "en", 0) for i in range(300)] + [(9000 + i, prose(r, 60), "xx", 1) for i in range(20)]
    table = spark.createDataFrame([d[:3] for d in docs], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(d[0], d[3]) for d in docs], "doc_id long, quality int")
    rows = {x.doc_id: x.kept for x in quality_rules.apply_rules(table, labels).collect()}
    assert sum(not rows[i] for i in range(3000)) <= 0.05 * 3000
    assert not any(rows[3000 + i] for i in range(300))
    assert all(rows[9000 + i] for i in range(20))  # too few labels for a cutoff


def test_risk_of_the_cutoffs(spark):
    """1,000 draws of 200 good labels: hardly any gets cutoffs that reject more than alpha of all good documents."""
    steps, r = 40, np.random.default_rng(4)
    good = steps * (1 - r.random((1000, 200)) ** (1 / 6))  # lies above a cutoff with the probability (1 - cutoff / steps) ** 6
    rows = [(f"s{d}", 1000 * d + k, float(x)) for d in range(1000) for k, x in enumerate(good[d])]
    rows += [(f"s{d}", 1000 * d + 500 + k, k * steps / 300) for d in range(1000) for k in range(300)]  # bad ones at every step
    measured = spark.createDataFrame(rows, "stratum string, doc_id long, x double").withColumn("base_failed", F.lit(False))
    labels = measured.select("doc_id", (F.col("doc_id") % 1000 < 500).cast("int").alias("quality"))
    again = measured.where("doc_id % 1000 < 30"), labels.where("doc_id % 1000 < 40")  # repeated rows and labels count once
    found = quality_rules.thresholds(measured.union(again[0]), labels.union(again[1]), grid={"x": [float(i) for i in range(steps)]}).collect()
    assert len(found) > 900 and all(f.n_good == 200 for f in found)
    over = sum((1 - f.cutoff / steps) ** 6 > quality_rules.ALPHA for f in found)
    assert over <= 2 * quality_rules.DELTA / 5 * 1000  # 10 are expected at most


def test_cutoffs_of_a_plain_count(spark):
    """Steps tested one by one in plain Python, with exact fractions."""
    from fractions import Fraction

    r = random.Random(12)
    grid = {"x": [0.1 * i for i in range(1, 9)], "y": [0.05 * i for i in range(1, 9)]}
    rows = [(s, 1000 * k + i, r.random() ** 4 if i % 3 else r.random(), r.random() ** 6 / 2 if i % 3 else r.random()) for k, s in enumerate(("en", "fr", "de")) for i in range(450)]
    measured = spark.createDataFrame(rows, "stratum string, doc_id long, x double, y double").withColumn("base_failed", F.col("doc_id") % 50 == 0)
    labels = spark.createDataFrame([(i, int(i % 1000 % 3 > 0)) for _, i, *_ in rows], "doc_id long, quality int")
    got = {(f.stratum, f.rule): (f.cutoff, f.n_good, f.n_rejected, f.n_caught) for f in quality_rules.thresholds(measured, labels, alpha=0.2, grid=grid).collect()}
    want = {}
    for stratum in ("en", "fr", "de"):
        own = [x for x in rows if x[0] == stratum and x[1] % 50]
        good, best = [x for x in own if x[1] % 1000 % 3], None
        for i in range(7, -1, -1):
            hit = lambda x, i=i: x[2] > grid["x"][i] or x[3] > grid["y"][i]
            k, caught, n, a = sum(map(hit, good)), sum(hit(x) for x in own if x[1] % 1000 % 3 == 0), len(good), Fraction(1, 5)
            if float(sum(math.comb(n, j) * a**j * (1 - a) ** (n - j) for j in range(k + 1))) > 0.05 / 5:
                break
            if caught > k and (best is None or caught - k > best[0]):
                best = caught - k, i, k, caught
        if best:
            want |= {(stratum, rule): (cuts[best[1]], len(good), best[2], best[3]) for rule, cuts in grid.items()}
    assert got == want and want


# --- 1 mixing


def test_pour_matches_filling_step_by_step(spark):
    r = random.Random(5)
    nodes = [(p, i, r.randint(0, 50), r.randint(1, 5)) for p in range(20) for i in range(r.randint(1, 6))]
    amounts = {p: r.randint(0, sum(c for q, _, c, _ in nodes if q == p)) for p in range(20)}
    table = spark.createDataFrame([(p, i, amounts[p], w, c) for p, i, c, w in nodes], "p long, i long, amount long, weight long, capacity long")
    got = {(x.p, x.i): x.budget for x in mixing.pour(table, ["p"], ["i"]).collect()}
    for p in range(20):
        own = {i: (c, w) for q, i, c, w in nodes if q == p}
        share, left, open_ = dict.fromkeys(own, 0.0), float(amounts[p]), set(own)
        while left > 1e-9 and open_:
            total = sum(own[i][1] for i in open_)
            step = min([left / total, *((own[i][0] - share[i]) / own[i][1] for i in open_)])
            for i in open_:
                share[i] += step * own[i][1]
            left -= step * total
            open_ = {i for i in open_ if own[i][0] - share[i] > 1e-9}
        for i, x in share.items():
            assert abs(got[p, i] - x) <= 1 + 1e-6


def test_mix_prefixes(spark):
    r = random.Random(6)
    docs = [(i, prose(r, r.randint(1, 60)), "en", "src0" if i % 3 else f"src{i % 5}", ) for i in range(400)]
    rows = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")).collect()
    total, taken = sum(x.tokens for x in rows), sum(x.tokens * x.copies for x in rows)
    assert 0.8 * total - 60 * 5 * 2 <= taken <= 0.8 * total
    leaves = {}
    for x in rows:
        leaves.setdefault((x.domain, x.lang, x.source), []).append(x)
    for leaf in leaves.values():
        low = min(x.copies for x in leaf)
        order = sorted(leaf, key=lambda x: (hashlib.md5(f"{mixing.SEED}:{low}:{x.doc_id}:{hashlib.md5(docs[x.doc_id][1].encode()).hexdigest()}".encode()).hexdigest(), x.doc_id))
        counts = [x.copies - low for x in order]
        assert counts == sorted(counts, reverse=True) and set(counts) <= {0, 1}  # a prefix has one copy more


# --- 6 packing


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.text(alphabet=st.sampled_from(list("ab C.'\n\t 12é😀\u00a0\u2028ß<|endoftext|>")), max_size=400))
def test_encode(text):
    exact = packing._exact("byte_bpe_50k.json")
    whole = exact.encode(text, add_special_tokens=False).ids
    assert packing.encode(text).tolist() == whole
    assert [i for p in packing.pieces_of(text, 20) for i in exact.encode(p, add_special_tokens=False).ids] == whole


def test_pack(spark):
    r = random.Random(7)
    docs = [(i, prose(r, r.choice((0, 3, 50, 900)))) for i in range(60)] + [(99, None)]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    pieces = packing.pack(table, with_ids=True)
    rows = pieces.collect()
    at = {}
    for p in rows:
        assert zlib.crc32(bytes(p.ids)) == p.ids_crc32 and p.offset + p.length <= 1024
        at[p.sequence_id * 1024 + p.offset] = p.length
    place = 0
    while place in at:
        place += at.pop(place)
    assert not at  # gapless from 0
    for i, text in docs:
        own = sorted((p for p in rows if p.doc_id == i), key=lambda p: p.start)
        ids = [x for p in own for x in np.frombuffer(bytes(p.ids), "<u4").tolist()]
        assert ids == [*packing.encode(text or "").tolist(), 0] and own[0].doc_tokens == len(ids)
    packed = packing.sequences(pieces).orderBy("sequence_id").collect()
    assert [len(s.ids) for s in packed[:-1]] == [4096] * (len(packed) - 1)
    assert math.log2(len(packed[-1].ids) / 4).is_integer() and len(packed[-1].ids) // 4 >= packed[-1].used


# --- 10 chat


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(st.lists(st.text(alphabet=st.sampled_from(list("\\lhc#<:/ turn>\n")), max_size=12), min_size=1, max_size=8))
def test_escape_round_trip(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in df.select("t", chat_format.escape(F.col("t"), True).alias("e"), chat_format.unescape(chat_format.escape(F.col("t"), True)).alias("u")).collect():
        assert row.u == row.t and "#" not in row.e and "<" not in row.e and ":" not in row.e


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(st.lists(st.tuples(st.sampled_from([None, 1, 2]), st.integers(0, 3000), st.sampled_from(["system", "user", "assistant"]), st.integers(0, 60)), min_size=1, max_size=60))
def test_windows_keep_the_budget(spark, turns):
    """Windows built turn by turn in plain Python; those of two or more new turns hold at most the budget."""
    budget, past = 50, 20
    table = [(c, t, role, " ".join(f"{i}<{k}" for k in range(n))) for i, (c, t, role, n) in enumerate(turns)]
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.window_id): r for r in chat_format.format_windows(df, budget, past).collect()}
    want, escaped = {}, lambda t: t.replace("<", "\\l")
    for conv in {x[0] for x in table}:
        own, at, windows = sorted((t, role, text) for c, t, role, text in table if c == conv), 0, []
        for t, role, text in own:
            n = 1 if role == "system" else len(text.split()) + 1
            crosses = at // budget != (at + n - 1) // budget
            if crosses or not windows or windows[-1][0] or windows[-1][1] != at // budget:
                windows.append((crosses, at // budget, []))
            windows[-1][2].append((at, n, role, text))
            at += n
        for k, (_, _, new) in enumerate(windows):
            before = [x for w in windows[:k] for x in w[2]]
            rule = [x for x in before if x[2] == "system"][-1:]
            again = rule + [x for x in before if x[2] != "system" and x[0] >= new[0][0] - past]
            want[conv, k] = again, new
            assert len(new) == 1 or sum(x[1] for x in new) <= budget
    assert set(got) == set(want)
    for key, (again, new) in want.items():
        r = got[key]
        assert r.formatted == "".join(f"### {role}: {escaped(text)}</turn>\n" for _, _, role, text in again + new) and r.n_repeated == len(again)
        assert [r.formatted[s.start : s.start + s.length] for s in r.loss_spans] == [escaped(text) for _, _, role, text in new if role == "assistant"]


# --- 3 personal data


def by_pattern(text):
    kinds = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(re.sub("[^0-9]", "", m)) <= 19 and pii.luhn(re.sub("[^0-9]", "", m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
    ]
    found = [(m.start(), k, m.end()) for k, (p, good) in enumerate(kinds) for m in re.finditer(p, text) if good(m.group())]
    return [(s, e, pii.KINDS[k]) for s, k, e in sorted(found)]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("a1290.@-+ ()é")), max_size=60))
def test_base_spans(text):
    assert pii.base_spans(text) == by_pattern(text)


def test_field_learns():
    field, hit, all_, found = pii.Field(pii.trained()), 0, 0, 0
    for text, gold in pii.sentences(150, seed=77):
        got = set(field.decode(text, pii.tokens_of(text)))
        hit, all_, found = hit + len(got & set(gold)), all_ + len(gold), found + len(got)
    assert hit / all_ > 0.9 and hit / found > 0.9


def test_field_adds_to_base(spark):
    text = "Call (499) 555-6503 now, cards 4111111111111111 4012888888881881, mail a.b@c.de or 10.0.0.1"
    row = pii.find_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert set(row.base.split(",")) <= set(row.spans.split(",")) and row.n_card == 0 and row.n_email == 1
    kinds = [p.split(":")[0] for p in row.spans.split(",")]
    assert kinds.count("card") == 2 and kinds.count("phone") == 1
    assert "4111" not in pii.redact(text, row.spans) and "<email>" in pii.redact(text, row.spans)


def test_long_digits_are_linear():
    import time

    began = time.time()
    pii.find("1" * 200_000 + " " + "1.2." * 50_000 + "+1" * 50_000 + "a@" * 50_000, pii.Field(pii.trained()))
    assert time.time() - began < 60


def uncut(field, text):
    """The spans of the best segmentation of the whole text, listed and decoded as one."""
    spans = pii.tokens_of(text)
    best, back = [0.0] + [-math.inf] * len(spans), [None] * (len(spans) + 1)
    for j, found in enumerate(field.lattice(text, spans)):
        for i, label, score, _ in found:
            if best[i] + score > best[j]:
                best[j], back[j] = best[i] + score, (i, label)
    out, j = [], len(spans)
    while j:
        i, label = back[j]
        out += [(spans[i][0], spans[j - 1][1], label)] * (label != pii.OUTSIDE)
        j = i
    return out[::-1]


def segmentations(spans, text, i=0):
    """All ways to cut tokens into outside tokens and labelled segments, by enumeration."""
    if i == len(spans):
        yield []
        return
    for rest in segmentations(spans, text, i + 1):
        yield [(i, i + 1, pii.OUTSIDE), *rest]
    for j in range(i + 1, min(len(spans), i + pii.MAX_TOKENS) + 1):
        piece = text[spans[i][0] : spans[j - 1][1]]
        if not (piece[0].isalnum() or piece[0] in "+(") or not piece[-1].isalnum() or not re.search("[0-9@]", piece) or re.search(r"\s\s|[\n\r]", piece):
            continue
        for rest in segmentations(spans, text, j):
            for kind in pii.KINDS:
                yield [(i, j, kind), *rest]


@pytest.mark.parametrize("text", ["(499) 55", "x@y.z 1", "+1 2-3", "4111 888", "7@b.c,d"])
def test_decoding_is_the_best_of_all_segmentations(text):
    field = pii.Field(pii.trained())
    spans, w = pii.tokens_of(text), field.weights

    def score(cut):
        total = 0.0
        for i, j, label in cut:
            a, b = spans[i][0], spans[j - 1][1]
            feats = pii._outside_features(text, a, b) if label == pii.OUTSIDE else [*pii.span_features(text, a, b), "bias"]
            total += sum(w.get((label, f), 0.0) for f in feats)
        return total

    best = max(segmentations(spans, text), key=score)
    got = field.decode(text, spans)
    found = {(spans[i][0], spans[j - 1][1], k) for i, j, k in best if k != pii.OUTSIDE}
    mine = [(k, k + 1, pii.OUTSIDE) for k, (a, b) in enumerate(spans) if not any(s <= a and b <= e for s, e, _ in got)]
    mine += [([a for a, _ in spans].index(s), [b for _, b in spans].index(e) + 1, k) for s, e, k in got]
    assert score(mine) == pytest.approx(score(best)) and found == set(got)


def test_long_lines_lose_no_span():
    field, r = pii.Field(pii.trained()), random.Random(1)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    phones = " ".join(f"({d(3)}) {d(3)}-{d(4)}" for _ in range(340))
    dashed = " ".join(f"{d(3)}-{d(3)}-{d(4)}" for _ in range(400))
    json = "{" + ",".join(f'"id":{d(4)},"tel":"({d(3)})555-{d(4)}","mail":"a{d(2)}@b.com"' for _ in range(100)) + "}"
    for text in (phones, dashed, json):
        assert len(text) > 4700 and list(pii.stretches(text))[0][1] == len(text)
        start = next(pii.stretches(text))[0]
        base, every = pii.find(text[start:], field)
        clear = [x for x in uncut(field, text[start:]) if not any(s < x[1] and x[0] < e for s, e, _ in base)]
        assert set(every) == set(base) | set(clear) and len(clear) > 60


def test_a_word_is_decoded_from_its_start():
    """However long a word is before its first digit, the field sees it from where it starts."""
    field, r = pii.Field(pii.trained()), random.Random(2)
    for _ in range(60):
        lead = "".join(r.choice("abcdefgh-./") for _ in range(r.randint(60, 300)))
        text = f"see {lead}{r.randint(100, 999)}-{r.randint(100, 999)}-{r.randint(1000, 9999)} there"
        assert list(pii.stretches(text))[0][0] == 4
        base, every = pii.find(text, field)
        clear = [x for x in uncut(field, text[4:]) if not any(s < x[1] + 4 and x[0] + 4 < e for s, e, _ in base)]
        assert set(every) == set(base) | {(s + 4, e + 4, k) for s, e, k in clear if s + 4 < len(text) - 6}


# --- 5 URLs


def test_url_trees():
    trees, suffixes = url_filter.default_model()
    urls, bad = url_filter.generated(800, seed=99)
    score = trees.score(np.array([url_filter.lexical(u, suffixes) for u in urls], float))
    assert ((score >= 0.5) == np.array(bad)).mean() > 0.95


def test_trees_against_a_plain_walk():
    """The score of each URL by walking tree after tree, and each tree's first cut by trying all of them."""
    urls, bad = url_filter.generated(600, seed=3)
    trees, suffixes = url_filter.fit(urls, bad)
    x = np.array([url_filter.lexical(u, suffixes) for u in urls], float)
    for row, got in zip(x[:80], trees.score(x)[:80], strict=True):
        total = trees.base
        for feature, cut, value in trees.trees:
            k = 0
            while k < 2**url_filter.DEPTH - 1:
                k = 2 * k + 1 + (row[feature[k]] > cut[k])
            total += value[k - (2**url_filter.DEPTH - 1)]
        assert got == pytest.approx(1 / (1 + math.exp(-total)))
    y = np.array(bad, float)
    p = min(max(y.mean(), 1e-3), 1 - 1e-3)
    gain = lambda m: (y[m] - p).sum() ** 2 / (m.sum() * p * (1 - p) + 1)
    best = max(
        gain(x[:, f] <= c) + gain(x[:, f] > c)
        for f in range(x.shape[1])
        for c in np.unique(np.quantile(x[:, f], np.linspace(0, 1, url_filter.CUTS + 1)[1:-1]))
        if url_filter.LEAF <= (x[:, f] <= c).sum() <= len(y) - url_filter.LEAF
    )
    feature, cut = trees.trees[0][0][0], trees.trees[0][1][0]
    assert gain(x[:, feature] <= cut) + gain(x[:, feature] > cut) == pytest.approx(best)


# --- 7 secrets


def walk(tree, x):
    while isinstance(tree, tuple):
        feature, cut, left, right = tree
        tree = left if x[feature] <= cut else right
    return tree


def plain_features(before2, before, lead, value, tail):
    """The features of a candidate in plain Python."""
    word, n, low = lead + value + tail, len(value), value.lower()
    near = " ".join([before2, before, lead]).lower()
    has = lambda pattern, text: float(bool(re.search(pattern, text)))
    share = lambda pattern: len(re.findall(pattern, value)) / n
    return [
        n, share("[0-9]"), share("[A-Z]"), share("[a-z]"), share("[_+/=-]"), share("[a-z](?=[^a-z])|[A-Z](?=[^A-Z])|[0-9](?=[^0-9])"),
        len(set(value)) / min(n, 40), has("^[0-9a-f]+$", low), 1 - len(re.sub(secret_scan._DICTIONARY, "", low)) / n, max(map(len, re.split("[^A-Za-z]+", value))),
        has(r"://|^[./~]|\.[a-z]{2,4}\b|/[a-z]+/", word), share("/"), share("-"), has(secret_scan._NAMES, near), has(secret_scan._OTHER, near),
        has(r"[=:]\s*[\"'`(]*\s*$", near), has("[\"'`]$", lead), has("^(AKIA|ASIA|ghp_|gho_|sk_|pk_|rk_|xox[abp]-|glpat-|AIza|eyJ)", value),
    ]


def test_scan_against_a_plain_finder(spark):
    """Candidates by one loop over words and runs, features in Python, and the forest walked tree by tree."""
    r, forest = random.Random(13), secret_scan.default_forest(spark)
    bits = ["token", "=", "sha1:", "0123456789abcdef" * 2, "ghp_" + "aB3" * 9, "x-1", "plainwordwithoutdigits", "/a/b-c/some-long-path-2024.html", "é", "1" * 20, "==", '"']
    texts = ["".join(r.choice(bits) + r.choice(["", " ", "\n", '"', ",", "=", "  "]) for _ in range(r.randint(0, 30))) for _ in range(120)]
    rows = secret_scan.scan(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), forest).collect()
    for row in rows:
        words, want = list(re.finditer(r"[^\x20\x09-\x0D]+", row.text)), []
        for k, w in enumerate(words):
            runs = list(re.finditer(r"[A-Za-z0-9_+/-]{16,}={0,2}", w[0]))
            ends = [0, *[m.end() for m in runs]]
            for i, m in enumerate(runs):
                lead = w[0][(runs[i - 1].start() if i else 0) : m.start()]
                tail = w[0][m.end() : runs[i + 1].start() if i + 1 < len(runs) else len(w[0])]
                if re.search("[0-9]", m[0]):
                    x = plain_features(words[k - 2][0] if k > 1 else "", words[k - 1][0] if k else "", lead, m[0], tail)
                    want.append((w.start() + m.start(), len(m[0]), m[0], sum(walk(t, x) for t in forest) / len(forest)))
            assert ends == sorted(ends)
        assert [(f.start, f.length, f.value) for f in row._findings] == [x[:3] for x in want]
        assert [f.score for f in row._findings] == pytest.approx([x[3] for x in want])


def test_secret_forest(spark):
    forest = secret_scan.default_forest(spark)
    held = secret_scan.generated_findings(spark, 900, seed=123).withColumn("text", F.concat_ws(" ", "before2", "before", "word", "after"))
    rows = secret_scan.scan(held.select("text", "label"), forest).collect()
    judged = [(max(f.score for f in r._findings) >= secret_scan.VOTES, r.label) for r in rows if r._findings]
    assert len(judged) > 700 and sum(a == bool(b) for a, b in judged) / len(judged) > 0.93
    for r in rows:
        for f in r._findings:
            assert r.text[f.start : f.start + f.length] == f.value


def test_every_run_of_a_word_is_judged(spark):
    r = random.Random(5)
    hexed = lambda n: f"{r.getrandbits(4 * n):0{n}x}"
    mixed = lambda n: "".join(r.choice("ABCDEFGHJKMNabcdefghjkmn0123456789") for _ in range(n)) + "7"
    github, aws, plain, sha = "ghp_" + mixed(35), "AKIA" + hexed(16).upper(), mixed(24), hexed(40)
    jwt = "eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9PlFUP0THsR8U"
    cases = [
        (f"set AWS_SECRET_ACCESS_KEY={plain} now", [plain]), (f'client_secret_key="{sha}"', [sha]), (f"DATABASE_PASSWORD={plain}", [plain]),
        (f'é {{"a_token":"{github}","b_token":"{aws}"}}', [github, aws]), (f"Authorization: Bearer {jwt}", jwt.split(".")),
        (f"see https://host.com/long-path-12345678?token={github} there", [github]),
        (f"https://host.com/?access_token={github}&commit={sha}", [github]),  # each is judged by its own lead
        (f"{{\"keys\":[{','.join([aws] * 50)}]}}", [aws] * 50),
    ]
    forest = secret_scan.default_forest(spark)
    table = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "id long, text string")
    for row in secret_scan.scan(table, forest).collect():
        text, secrets = cases[row.id]
        assert [f.value for f in row._findings if f.score >= secret_scan.VOTES] == secrets
        runs = [m for m in re.finditer(r"[A-Za-z0-9_+/-]{16,}={0,2}", text) if re.search("[0-9]", m[0])]
        assert [(f.start, f.length) for f in row._findings] == [(m.start(), len(m[0])) for m in runs]
    for row in secret_scan.redact(table, forest).collect():
        assert not any(v in row.text for v in cases[row.id][1])


def test_many_findings_are_linear(spark):
    """Texts of many candidates, in many words or in one: positions hold, and four times as many take no more than eight times as long."""
    import time

    forest, r = secret_scan.default_forest(spark), random.Random(8)
    for sep in (" ", ":"):
        took = []
        for n in (50, 4000, 16_000):
            text = sep.join(f"é{r.getrandbits(128):032x}" for _ in range(n))
            found = secret_scan.scan(spark.createDataFrame([(text,)], "text string"), forest)
            began = time.time()
            rows = found.select(F.inline(F.transform("_findings", lambda f: F.struct(f["start"].alias("start"), f["value"].alias("value"))))).collect()
            took.append(time.time() - began)
            assert len(rows) == n and all(text[x.start : x.start + 32] == x.value for x in rows)
        assert took[2] < 8 * max(took[1], 0.5)


# --- 8 classifier


def test_classifier_held_out(spark):
    r = random.Random(8)
    good = lambda: prose(r, 60)
    bad = lambda: " ".join(w.upper() + "!!" for w in prose(r, 60).split())
    docs = [(i, bad() if i % 4 == 0 else good()) for i in range(600)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i, _ in docs], "doc_id long, quality int, toxic int")
    rows = quality_classifier.score(table, quality_classifier.learn(table, labels)).collect()
    held = [(x.predicted, int(x.doc_id % 4 != 0)) for x in rows if x.held_out]
    assert {x.doc_id for x in rows if x.held_out} == {i for i, _ in docs if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert {x.doc_id % 1 for x in quality_classifier.training_rows(table, labels).collect()} == {0}
    assert not any(zlib.crc32(str(x.doc_id).encode()) % 3 == 1 for x in quality_classifier.training_rows(table, labels).collect())


def test_hinge_loss_by_plain_coordinate_descent():
    """fit() against the same dual problem solved with dense rows: equal scores, and no better weights nearby."""
    r = np.random.default_rng(14)
    labels = r.integers(0, 2, 60)
    rows = [np.unique(np.concatenate([r.integers(0, 40, 8), 100 + r.integers(0, 6, 2) if k else 200 + r.integers(0, 6, 2)])).astype(np.uint32) for k in labels]
    (final, ratio), slope, intercept = quality_classifier.fit(rows, labels)
    y, size = np.where(labels == 1, 1.0, -1.0), 1 << quality_classifier.BITS
    dense = np.zeros((60, 256))
    for i, row in enumerate(rows):
        dense[i, row] = 1
    count = lambda k: quality_classifier.SMOOTHING + dense[y == k].sum(0)
    total = lambda k: count(k).sum() + (size - 256) * quality_classifier.SMOOTHING
    plain = np.log(count(1) / total(1)) - np.log(count(-1) / total(-1))
    assert ratio[:256] == pytest.approx(plain)
    x = dense * plain
    x = np.hstack([x / np.linalg.norm(x, axis=1, keepdims=True), np.ones((60, 1))])
    cost = np.where(y > 0, 30 / (y > 0).sum(), 30 / (y < 0).sum()) * quality_classifier.COST
    primal = lambda w: w @ w / 2 + cost @ np.maximum(0, 1 - y * (x @ w))
    alpha, w, order = np.zeros(60), np.zeros(257), np.random.default_rng(3)
    for _ in range(quality_classifier.ROUNDS):
        for i in order.permutation(60):
            old, alpha[i] = alpha[i], min(max(alpha[i] - (y[i] * (x[i] @ w) - 1) / (x[i] @ x[i]), 0), cost[i])
            w = w + (alpha[i] - old) * y[i] * x[i]
    used = np.flatnonzero(w[:256])
    mixed = quality_classifier.BETA * w[:256] + (1 - quality_classifier.BETA) * np.abs(w[:256]).sum() / len(used) * (w[:256] != 0)
    assert final[:256] == pytest.approx(mixed * plain) and slope > 0
    assert primal(w) - (alpha.sum() - w @ w / 2) < 0.1 * primal(w)  # the duality gap has closed
    score = [1 / (1 + math.exp(-(slope * quality_classifier.margin_of(q, final, ratio) + intercept))) for q in rows]
    assert np.mean((np.array(score) >= 0.5) == labels) > 0.95


# --- 9 embeddings


def test_links_match_brute_force(spark):
    r = np.random.default_rng(9)
    centers = r.normal(size=(60, 16))
    x = np.concatenate([centers[r.integers(0, 60, 1500)] + 0.06 * r.normal(size=(1500, 16)), np.repeat(centers[:1], 300, 0), centers[1] + 0.02 * r.normal(size=(400, 16))])
    label = r.integers(0, 2, len(x))
    table = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<double>, label int")
    got = {v.vec_id: (v.n_links, v.component_id) for v in embedding_dedup.link(table, leaf=128).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = (u @ u.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(linked, False)
    true, found = linked.sum(1), np.array([got[i][0] for i in range(len(x))])
    assert (found <= true).all() and found.sum() >= 0.97 * true.sum()
    root = shared.least_reachable(linked)
    assert np.mean([got[i][1] == root[i] for i in range(len(x))]) > 0.99


# --- 2 near-duplicates


def test_near_groups_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "CELL", 40)  # so that cells and parts are dealt even here
    r = random.Random(10)

    def edited(text, n):
        words = text.split()
        for _ in range(n):
            words[r.randrange(len(words))] = prose(r, 1)
        return " ".join(words)

    texts = [prose(r, 150) for _ in range(60)]
    near = texts[0]
    texts += [edited(near, r.randint(1, 5)) for _ in range(150)] + [edited(t, 1) for t in texts[:30]] + [near] * 50 + [texts[3][:-1], "", "a b", "a b c"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.class_id for x in minhash_dedup.find_groups(table).collect()}
    words = minhash_dedup.idf_table(table)
    sets = [minhash_dedup.elements(*minhash_dedup.shingles(minhash_dedup.word_hashes(t), words)) for t in texts]
    linked = np.array([[i != j and (texts[i] == texts[j] or minhash_dedup.similarity(a, b) >= 0.8) for j, b in enumerate(sets)] for i, a in enumerate(sets)])
    root = shared.least_reachable(linked)
    assert [got[i] for i in range(len(texts))] == root.tolist()


def test_sampling_follows_similarity():
    r = random.Random(11)
    empty = np.full(1 << minhash_dedup.FEATURE_BITS, 4095, np.uint64)
    base = [prose(r, 1) for _ in range(400)]
    a = minhash_dedup.shingles(minhash_dedup.word_hashes(" ".join(base[:300])), empty)
    b = minhash_dedup.shingles(minhash_dedup.word_hashes(" ".join(base[60:360])), empty)
    true = minhash_dedup.similarity(minhash_dedup.elements(*a), minhash_dedup.elements(*b))
    agree = (minhash_dedup.samples(*a, size=2000) == minhash_dedup.samples(*b, size=2000)).mean()
    assert abs(agree - true) < 0.05
