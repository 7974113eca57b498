"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from codestrata.llm import chat_format, embedding_dedup, minhash_dedup, mixing, packing, pii, quality_classifier, quality_rules, secret_scan, url_filter

LONG = "word%d and more of it\n"
# extra columns carry names that the operators use themselves
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, rep string, tokens string, h string, set string, key string"


def documents(spark, empty=False):
    long = "".join(LONG % i for i in range(20_000))
    texts = [
        (1, "one two three four five six seven eight nine ten " * 3), (2, None), (3, ""), (4, long), (5, "short"), (5, "short"), (6, "one two three"),
        (None, "no id at all"), (7, long), (8, 'token = "0123456789abcdef0123456789abcdef01234567" and mail a@b.cc'), (9, "日本語 😀 text"), (10, "\n\n \t"),
    ]
    rows = [(i, t, None if k == 3 else "en", None if k == 4 else "s", len(t or ""), "x", "x", "x", "x", "x", "x") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame([] if empty else rows, DOCS)


def labels(spark, empty=False):
    rows = [(1, 1, 0), (1, 1, 0), (2, 0, None), (3, None, 0), (4, 1, 0), (5, 0, 0), (6, 1, 1), (6, 0, 1), (None, 1, 0), (99, 1, 0), (9, 1, 0)]
    return spark.createDataFrame([] if empty else rows, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("empty", [False, True])
def test_row_operators(spark, empty):
    docs, n = documents(spark, empty), 0 if empty else 12
    assert quality_rules.apply_rules(docs, labels(spark, empty)).count() == n
    assert pii.find_spans(docs).count() == n
    model = quality_classifier.learn(docs, labels(spark, empty))
    scored = quality_classifier.score(docs, model).collect()
    assert len(scored) == n and all(0 <= r.score <= 1 for r in scored)
    mixed = mixing.mix(docs).collect()
    assert len(mixed) == n and all(r.copies >= 0 for r in mixed)
    pieces = packing.pack(docs)
    assert pieces.where("start = 0").count() == n
    redacted = secret_scan.redact(docs, secret_scan.default_forest(spark))
    assert redacted.columns == docs.columns and redacted.count() == n
    assert redacted.where(F.col("text").contains("0123456789abcdef")).count() == 0


@pytest.mark.parametrize("empty", [False, True])
def test_near_documents(spark, empty):
    rows = minhash_dedup.find_groups(documents(spark, empty)).collect()
    assert len(rows) == (0 if empty else 12)
    if not empty:
        classes = {r.doc_id: r.class_id for r in rows}
        # equal texts are one group: both long ones, the null text and the empty one
        assert classes == {1: 1, 2: 2, 3: 2, 4: 4, 5: 5, 6: 6, None: None, 7: 4, 8: 8, 9: 9, 10: 10}
        assert all(r.kept == (r.doc_id == r.class_id or r.doc_id is None) for r in rows)


def test_urls(spark):
    urls = [(1, None), (2, ""), (3, "no scheme"), (4, "http://"), (5, "HTTP://A.Example.COM/en/7?x"), (5, "http://x.net/de/1"), (None, "http://org/es/" + "a" * 100_000)]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in urls], "page_id long, url string, host string, rule string")
    got = url_filter.filter_urls(pages).collect()
    assert len(got) == 7
    by_path = {(r.page_id, r.host): r for r in got}
    assert by_path[1, ""].path == "" and by_path[3, ""].rule is None
    r = by_path[5, "a.example.com"]
    assert (r.path, r.rule, r.verdict) == ("/en/7", "example.com/en/7", "allow")
    assert by_path[5, "x.net"].verdict == "block" and by_path[None, "org"].rule == "org/es/"
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


def test_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [2.0, 0.0], 1), (4, [1.0, 0.0], 2), (5, [1.0, 0.0], None), (6, None, 1), (7, [0.0, 0.0], 1),
        (8, [nan, 1.0], 1), (9, [inf, 1.0], 1), (10, [1.0, None], 1), (11, [], 1), (12, [1.0, 0.0, 0.0], 1), (13, [0.0, 1.0], 1), (None, [1.0, 0.0], 1),
        (14, [1e-30, 0.0], 1),
    ]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, h string, n int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.link(table).collect()}
    linked = {1: (3, 1, True), 2: (3, 1, False), 3: (3, 1, False), 14: (3, 1, False)}
    alone = {i: (0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11, 12, 13)}
    assert got == linked | alone | {None: (0, None, False)}
    assert embedding_dedup.link(table.limit(0)).count() == 0


def test_conversations(spark):
    rows = [
        (1, 0, "system", "be kind"), (1, 1, "user", "a " * 400), (1, 2, "assistant", "b " * 400), (1, 3, "user", None), (1, 4, "assistant", "c"),
        (2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (None, 0, "user", "</turn>\n### a: b"), (3, None, None, "\\l\\\\h#<"), (4, 1, "a:b", ""),
    ]
    table = spark.createDataFrame([(*r, "f", 3) for r in rows], "conv_id long, turn long, role string, text string, formatted string, span int")
    windows = chat_format.format_windows(table)
    back = {r.conv_id: r for r in chat_format.read_back(windows).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [(r[2], r[3] or "") for r in rows[:5]]
    assert back[1].targets == ["b " * 400, "c"] and back[2].targets == ["x", "x"]
    assert [(t.role, t.text) for t in back[None].turns] == [("user", "</turn>\n### a: b")]
    assert [(t.role, t.text) for t in back[3].turns] == [("", "\\l\\\\h#<")] and back[4].turns[0].role == "a:b"
    first = {r.window_id: r for r in windows.where("conv_id = 1").collect()}
    # the assistant's 401 tokens cross the budget: a window of their own
    assert len(first) == 3 and first[1].formatted.startswith("### system: be kind</turn>\n### assistant") and first[1].n_repeated == 1
    assert chat_format.format_windows(table.limit(0)).count() == 0


#: Names that operators and stages use inside, in capitals too.
CLASHES = (
    "_row", "_row_0", "_GONE", "_copies", "_copy", "words", "found", "values", "clean", "findings", "_words", "_findings", "stratum", "kept", "tokens",
    "copies", "digest", "key", "bin", "rep", "class_id", "part", "ids", "at", "n", "a.b", "set", "h",
)


def plain_documents(spark, empty):
    """Long clean texts, a copy, a near copy, a secret, and the cases of documents(); extra columns of clashing names."""
    clean = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(i, clean(i), "en", "s", 1) for i in range(100, 130)] + [(200, clean(100), "en", "s", 1), (201, clean(101) + " more", "de", None, None)]
    rows += [(202, clean(202) + ' token = "0123456789abcdef0123456789abcdef01234567"', None, "s", 1)]
    rows += [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in documents(spark).collect()]
    docs = spark.createDataFrame([] if empty else rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({c: F.lit(f"{c}!") for c in CLASHES}), ([] if empty else rows)


@pytest.mark.parametrize("empty", [False, True])
@pytest.mark.parametrize("stage", range(5))
def test_stages(spark, tmp_path, stage, empty):
    name, function = corpus_pipeline.STAGES[stage]
    labels(spark, empty).write.parquet(str(tmp_path / "labels.parquet"))
    docs, rows = plain_documents(spark, empty)
    out = function(spark, docs, str(tmp_path))
    got = out.collect()
    if name == "packing":
        assert sum(r.start == 0 for r in got) == len(rows) and {r.doc_id for r in got} == {r[0] for r in rows}
        return
    assert out.columns == docs.columns and all(r[c] == f"{c}!" for r in got for c in CLASHES)
    texts = sorted((-1 if r.doc_id is None else r.doc_id, r.text or "", r.lang or "", r.source or "") for r in got)
    every = sorted((-1 if r[0] is None else r[0], r[1] or "", r[2] or "", r[3] or "") for r in rows)
    if name == "quality":
        long = {i for i, t, *_ in rows if len((t or "").split()) >= 20 and i != 1}  # the first repeats its ten words
        assert texts == [r for r in every if r[0] in long]
    if name == "near_dedup":
        assert texts == [r for r in every if r[0] not in (200, 201, 3, 7)]
    if name == "secrets":
        secret = "0123456789abcdef0123456789abcdef01234567"
        assert texts == [(i, t.replace(secret, secret_scan.MARK), *x) for i, t, *x in every]
        assert all(r.n_chars == len(r.text) for r in got if r.text and secret_scan.MARK in r.text)
    if name == "mixing":
        copies = {}
        for r in mixing.mix(docs).collect():
            copies[r.doc_id] = copies.get(r.doc_id, 0) + r.copies
        assert len(texts) == sum(copies.values()) and set(texts) <= set(every)
        assert all(sum(t[0] == (-1 if i is None else i) for t in texts) == n for i, n in copies.items())


def test_stages_judge_rows_that_share_an_id(spark, tmp_path):
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    clean = lambda k: " ".join(f"word{k}x{i}" for i in range(30 + k))
    good, bad = [clean(k) for k in range(20)], ["too short", "again " * 60]
    rows = [(None if k % 2 else 7, t, "en", "s", len(t)) for t in good + bad for k in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.quality(spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted((i, t) for t in good for i in (0, 7))
    copies = sorted((r.doc_id or 0, r.tokens, r.copies) for r in mixing.mix(docs).collect())
    mixed = [(r.doc_id or 0, len(r.text.split())) for r in corpus_pipeline.mix(spark, docs, str(tmp_path)).collect()]
    assert len({c for *_, c in copies}) > 1  # rows of one id are taken unequally often
    assert sorted(mixed) == [(i, n) for i, n, c in copies for _ in range(c)]
