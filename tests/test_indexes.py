"""Written indexes and the automaton, against plain searches of everything."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from codestrata.functions import symbols
from codestrata.operators import contracts, grams, matching, ranked, search, segments, vector_lists
from codestrata.plans import fact_queries

WORDS = ("alpha", "beta", "gamma_x", "delta", "né", "a", "of", "Epsilon", "zeta9", "a/b", "日本語")


def prose(r, n, words=WORDS):
    return " ".join(r.choice(words) for _ in range(n))


def rows_read(spark, job):
    """How many rows a job reads from files."""
    store = spark.sparkContext._jsc.sc().statusStore()
    gateway = spark.sparkContext._gateway
    nothing = gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList()
    total = lambda: sum(s.inputRecords() for s in _list(store.stageList(None, False, False, *nothing)))
    before = total()
    out = job()
    time.sleep(0.5)
    return out, total() - before


def rows_shuffled(spark, job):
    """How many rows a job writes to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    gateway = spark.sparkContext._gateway
    nothing = gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList()
    total = lambda: sum(s.shuffleWriteRecords() for s in _list(store.stageList(None, False, False, *nothing)))
    before = total()
    job()
    time.sleep(0.5)
    return total() - before


def _list(seq):
    it = seq.iterator()
    while it.hasNext():
        yield it.next()


def test_automaton_against_patterns(spark):
    r = random.Random(4)
    texts = ["".join(r.choice("ab /_cé") for _ in range(r.randint(0, 14))) for _ in range(300)] + [None, ""]
    words = sorted({"".join(r.choice("ab/_é ") for _ in range(r.randint(1, 3))) for _ in range(60)})
    lines = spark.createDataFrame([("f", i, t) for i, t in enumerate(texts)], "path string, line_no int, line string")
    asked = spark.createDataFrame([(w,) for w in [*words, words[0], ""]], "identifier string").union(spark.createDataFrame([(None,)], "identifier string"))
    alone = lambda w, t: w in t if "/" in w else re.search(r"(?<![A-Za-z0-9_])" + re.escape(w) + r"(?![A-Za-z0-9_])", t)
    expected = {(w, i) for w in words for i, t in enumerate(texts) if t and alone(w, t)}
    for shard in (1000, 7):
        rows = matching.occurrences(lines, asked, shard=shard).collect()
        assert len(rows) == len(expected) and {(x.word, x.line_no) for x in rows} == expected
        counts = {x.word: x.lines for x in matching.line_counts(lines, asked, shard=shard).collect()}
        assert counts == {w: n for w in words if (n := sum(a == w for a, _ in expected))}
    assert matching.occurrences(lines, asked.limit(0)).count() == 0 == matching.line_counts(lines, asked.limit(0)).count()
    first = {x.identifier: x.evidence_count for x in contracts.crossref(spark.createDataFrame([("foo",)], "identifier string"), lines.limit(0)).collect()}
    assert first == {"foo": 0}


def test_automaton_is_linear_in_a_line():
    import ahocorasick

    r = random.Random(5)
    words = sorted({"".join(r.choice("abcdefghij") for _ in range(r.randint(5, 9))) for _ in range(100_000)})
    automaton = ahocorasick.Automaton()
    for at, w in enumerate(words):
        automaton.add_word(w, (at, len(w), False))
    automaton.make_automaton()
    took = []
    for n in (50_000, 100_000, 200_000):
        line, began = " ".join(r.choice(words) for _ in range(n)), time.process_time()
        assert matching.found_in(automaton, line) == {i for i in map({w: i for i, w in enumerate(words)}.get, line.split(" "))}
        took.append(time.process_time() - began)
    assert took[2] < 12 * took[0]  # four times the line; quadratic work would be sixteen times


def test_standing_columns(spark):
    lines = spark.createDataFrame([("f", 1, "get get_x get"), ("f", 2, "x.get(get)"), ("f", 3, "éget"), ("f", 4, "")], "path string, line_no int, line string")
    got = sorted((r.line_no, r.col) for r in grams.find_with_scan(lines, spark.createDataFrame([("get",)], "word string")).collect())
    assert got == [(1, 1), (1, 11), (2, 3), (2, 7), (3, 2)]
    assert got == sorted((r.line_no, r.col) for r in symbols.references(lines, "get").collect())


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    """A hundred and sixty thousand lines in files, one rare name in a few of them, and their index."""
    r, place = random.Random(6), str(tmp_path_factory.mktemp("grams"))
    rows = []
    for f in range(80):
        for n in range(2000):
            text = "fn %s_%d() { %s }" % (r.choice(("load", "Store", "scan")), r.randint(0, 99), f"{r.getrandbits(400):x}")
            if f == 57 and n % 400 == 3:
                text += " quixotic_name = quixotic_name"
            rows.append((f"src/f{f:02d}.rs", n + 1, text))
    rows += [("src/z.rs", 1, None), ("src/z.rs", 2, ""), ("src/z.rs", 3, "QUIXOTIC_NAME né"), ("vendor/node_modules/q.rs", 1, "quixotic_name")]
    lines = spark.createDataFrame(rows, "path string, line_no int, line string")
    grams.write(lines, place)
    return place, lines, rows


def test_grams_equal_a_scan(spark, source):
    place, lines, _ = source
    words = spark.createDataFrame([(w,) for w in ("quixotic_name", "load_7", "né", "fn", "absent", "QUIXOTIC_NAME", "load_7", "")], "word string")
    key = lambda df: sorted((r.word, r.path, r.line_no, r.col) for r in df.collect())
    found = key(grams.find(spark, place, words))
    assert found == key(grams.find_with_scan(lines, words)) and sum(w == "quixotic_name" for w, *_ in found) == 11


def test_grams_read_little(spark, source):
    place, _, _ = source
    word = spark.createDataFrame([("quixotic_name",)], "word string")
    found, own = rows_read(spark, lambda: grams.find(spark, place, word).collect())
    scanned, whole = rows_read(spark, lambda: grams.find_with_scan(spark.read.parquet(f"{place}/lines"), word).collect())
    assert len(found) == len(scanned) == 11 and own < whole / 10, (own, whole)


def test_grams_stop_early(spark, source):
    place, lines, rows = source
    rules = lambda q, files=None: [
        (p, n) for p, n, t in sorted((x for x in rows if x[2]), key=lambda x: x[:2]) if (m := re.match(r"fn ([A-Za-z0-9_]+)", t)) and q in m[1].lower() and "node_modules" not in p and (files is None or p in files)
    ]
    got = [(r.path, r.line_no) for r in grams.workspace_symbols(spark, place, "STORE_7").collect()]
    assert got == rules("store_7")[:200]
    assert [(r.path, r.line_no) for r in grams.workspace_symbols(spark, place, "scan_42", most=5).collect()] == rules("scan_42")[:5]
    few = sorted({p for p, *_ in rows})[:3]
    assert [(r.path, r.line_no) for r in grams.workspace_symbols(spark, place, "load", most_files=3).collect()] == rules("load", few)[:200]
    assert [(r.path, r.line_no) for r in grams.workspace_symbols(spark, place, "9", most=7).collect()] == rules("9")[:7]
    assert [(r.path, r.col > 0) for r in grams.references(spark, place, "quixotic_name", most=3).collect()] == [("src/f57.rs", True)] * 3
    assert grams.workspace_symbols(spark, place, "nothing_like_it").count() == 0


def test_block_max_equals_bm25(spark, tmp_path):
    r = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)]
    docs = [(i, prose(r, int(r.paretovariate(1.2) * 8) % 400, vocabulary[: r.choice((30, 400))])) for i in range(1500)] + [(9000, None), (9001, "")]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    queries = spark.createDataFrame([(q, prose(r, 4, vocabulary)) for q in range(12)] + [(90, "absent"), (91, None), (92, "w1 w1 w2")], "query_id long, text string")
    ranked.write(table, str(tmp_path), block=8)
    best = lambda df: {(x.query_id, x["rank"]): (x.doc_id, x.score) for x in search.top(df.withColumn("score", F.round("score", 6)), 5, "query_id").collect()}
    got, expected = best(ranked.search_blocks(spark, str(tmp_path), queries, 5)), best(search.bm25(table, queries))
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in expected.items()}
    assert all(got[k][1] == pytest.approx(expected[k][1]) for k in got) and not any(q in (90, 91) for q, _ in got)
    read = {x.query_id: (x.chosen, x.blocks) for x in ranked.blocks_read(spark, str(tmp_path), queries, 5).collect()}
    assert sum(c for c, _ in read.values()) < 0.7 * sum(b for _, b in read.values())


def test_blocks_shuffle_no_tokens(spark, tmp_path):
    r = random.Random(10)
    vocabulary = [f"w{i}" for i in range(90)]
    table = spark.createDataFrame([(i, prose(r, 60, vocabulary)) for i in range(400)], "doc_id long, text string")
    queries = spark.createDataFrame([(q, prose(r, 20, vocabulary)) for q in range(10)], "query_id long, text string")
    assert rows_shuffled(spark, lambda: ranked.write(table, str(tmp_path))) < 2000  # of 24,000 tokens
    assert rows_shuffled(spark, lambda: ranked.search_blocks(spark, str(tmp_path), queries, 5).collect()) < 2000


def test_queries_in_several_matrices(spark, tmp_path, monkeypatch):
    r = random.Random(11)
    table = spark.createDataFrame([(i, prose(r, r.randint(0, 9))) for i in range(200)], "doc_id long, text string")
    queries = spark.createDataFrame([(q, prose(r, 3)) for q in range(40)], "query_id long, text string")
    monkeypatch.setattr(ranked, "CELLS", 12)
    monkeypatch.setattr(search, "BROADCAST_ROWS", 30)
    monkeypatch.setattr(ranked, "BYTES", 200)
    ranked.write(table, str(tmp_path))
    best = lambda df: {(x.query_id, x["rank"]): (x.doc_id, x.score) for x in search.top(df.withColumn("score", F.round("score", 6)), 5, "query_id").collect()}
    got, expected = best(ranked.search_blocks(spark, str(tmp_path), queries, 5)), best(search.bm25(table, queries))
    assert got == {k: (d, pytest.approx(s)) for k, (d, s) in expected.items()}


def test_scores_are_summed_where_documents_lie(spark):
    r = random.Random(12)
    docs = [(i, sorted(set(prose(r, 30).split()))) for i in range(300)]
    index = spark.createDataFrame([(i, w, 1 + i % 3) for i, ws in docs for w in ws], "doc_id long, token string, tf long")
    lengths = spark.createDataFrame([(i, len(ws)) for i, ws in docs], "doc_id long, doc_length long")
    queries = spark.createDataFrame([(q, "alpha beta delta epsilon") for q in range(60)], "query_id long, text string")
    assert rows_shuffled(spark, lambda: search.search_index(index, lengths, queries).write.format("noop").mode("overwrite").save()) < 6000  # 18,000 pairs


def test_segments_shuffle_no_tokens(spark, tmp_path):
    r = random.Random(13)
    vocabulary = [f"w{i}" for i in range(90)]
    table = spark.createDataFrame([(f"f{i % 7}", i, prose(r, 60, vocabulary)) for i in range(300)] + [("n", 999, None)], "path string, doc_id long, text string")
    write = lambda: segments.write_segment(table, table.select("path").limit(0), segments.file_hashes(table), str(tmp_path))
    assert rows_shuffled(spark, write) < 1000  # of about 13,000 postings
    plain = search.postings(table.where("text is not null")).collect()
    assert sorted(map(tuple, search.counted(table, "text", "doc_id").collect())) == sorted(map(tuple, plain))


def test_features_of_long_texts(spark, tmp_path):
    words = " ".join(f"w{i}" for i in range(30_000))
    for name, rows, schema in (
        ("documents", [(1, words), (2, "a b"), (3, None), (4, "x y z x y z")], "doc_id long, text string"),
        ("labels", [(i, 1) for i in range(1, 5)], "doc_id long, quality long"),
        ("benchmark", [(7, "w29997 w29998 w29999 more"), (8, "w1 w3 w4"), (9, "x y z"), (10, "a b")], "item_id long, text string"),
    ):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    began, found = time.perf_counter(), []
    assert rows_shuffled(spark, lambda: found.extend(fact_queries.phantom_features(spark, str(tmp_path)).collect())) < 1000  # of 30,000 runs
    assert time.perf_counter() - began < 30  # a text split anew for each run takes 30,000 times the text
    assert sorted((r.item_id, r.feature) for r in found) == [(7, "w29997 w29998 w29999"), (9, "x y z")]


def test_vector_lists_equal_brute_force(spark, tmp_path):
    r = np.random.default_rng(8)
    centres = r.normal(size=(12, 16))
    x = np.concatenate([centres[r.integers(0, 12, 1500)] + 0.4 * r.normal(size=(1500, 16)), r.normal(size=(500, 16))])
    rows = [(i, [float(v) for v in x[i]]) for i in range(len(x))] + [(5000, rows0) for rows0 in ([float(v) for v in x[0]],)]
    odd = [(6000, None), (6001, [0.0] * 16), (6002, [float("nan")] * 16), (6003, [1.0] * 3), (6004, [None] * 16), (6005, [])]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    codes = vector_lists.write(table, str(tmp_path))
    asked = table.where("vec_id % 100 = 0")
    pick = lambda df: {(q.query_id, q["rank"]): q.id for q in search.top(df.withColumn("score", F.round("score", 6)), 10, "query_id", tie="id").collect()}
    got = pick(vector_lists.nearest(spark, str(tmp_path), codes, asked, 10))
    ids, full = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    full /= np.linalg.norm(full, axis=1, keepdims=True)
    expected = {}
    for i in ids[ids % 100 == 0]:
        score = np.round(full @ full[np.flatnonzero(ids == i)[0]], 6)
        for n, k in enumerate(np.lexsort((ids, -score))[:10]):
            expected[int(i), n + 1] = int(ids[k])
    assert got == expected
    near = pick(vector_lists.nearest(spark, str(tmp_path), codes, asked, 10, exact=False))
    recall = len({(q, v) for (q, _), v in near.items()} & {(q, v) for (q, _), v in expected.items()}) / len(expected)
    assert recall >= 0.9
    assert vector_lists.write(table.limit(0), f"{tmp_path}/none") is None and vector_lists.nearest(spark, "", None, asked, 3).count() == 0


def test_units_are_linear_in_the_length(spark):
    began = time.perf_counter()
    rows = vector_lists.unit(spark.range(8).select("id", F.transform(F.sequence(F.lit(1), F.lit(1500)), lambda x: x * (F.col("id") + 1.0)).alias("v")), "id", "v").collect()
    assert time.perf_counter() - began < 60  # a norm computed for each component would take 1500 ** 3 steps a row
    full = np.arange(1, 1501) / np.linalg.norm(np.arange(1, 1501))
    assert len(rows) == 8 and all(np.allclose(r.unit, full, atol=1e-12) for r in rows)


def test_segments(spark, tmp_path):
    r, place = random.Random(9), str(tmp_path / "index")
    schema = "path string, doc_id long, text string"
    files = {f"f{i}": [(f"f{i}", 10 * i + k, prose(r, r.randint(0, 30))) for k in range(3)] for i in range(30)}
    queries = spark.createDataFrame([(1, "alpha zeta9"), (2, "delta delta Epsilon")], "query_id long, text string")
    table = lambda: spark.createDataFrame([d for f in files.values() for d in f], schema)
    found = lambda version=None: {(x.query_id, x.doc_id): round(x.score, 9) for x in segments.find(spark, place, queries, version).collect()}
    plain = lambda: {(x.query_id, x.doc_id): round(x.score, 9) for x in search.bm25(table().select("doc_id", "text"), queries).collect()}
    assert found() == {}
    assert segments.refresh(spark, place, table()) == 1
    first = plain()
    assert found() == first and segments.refresh(spark, place, table()) == 1  # nothing has changed
    files["f3"] = [("f3", 30, "alpha alpha"), ("f3", 999, "delta")]
    del files["f4"]
    files["new"] = [("new", 1000, "zeta9 zeta9")]
    # a writer that dies before its manifest is there leaves nothing to see
    segments.write_segment(table(), table().select("path"), segments.file_hashes(table()), place)
    assert found() == first
    assert segments.refresh(spark, place, table()) == 2 and found() == plain() != first and found(1) == first
    with pytest.raises(segments.Taken):
        segments.publish(spark, place, 2, [])
    files["f4"], files["f3"] = [("f4", 41, "Epsilon")], [("f3", 30, "beta")]
    assert segments.refresh(spark, place, table()) == 3 and found() == plain()
    assert segments.merge(spark, place) == 4 == segments.merge(spark, place) and found() == plain()
    assert len(segments.manifest(spark, place)["segments"]) == 1
    segments.vacuum(spark, place)
    assert segments.versions(spark, place) == [4] and found() == plain()
    files.clear()
    assert segments.refresh(spark, place, table().union(spark.createDataFrame([(None, 1, "alpha")], schema)) if files else spark.createDataFrame([(None, 1, "alpha")], schema)) == 5
    assert found() == {}


def test_grams_of_lines_by_one_sort():
    """Each gram of a line once, in order, as from sets; of many different characters, too."""
    import numpy as np

    from codestrata.operators import grams

    many = "".join(map(chr, (*range(0x20, 0xD800), *range(0xE000, 0x110000))))
    for texts in (["abcabc", "", "ab", "xabc\U0001f600é", "éab"], ["aaaa"], [many, "abcd", many[:5]] * 3):
        chars = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64)
        row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        whole = row[2:] == row[:-2]
        which, lines, known = grams._by_gram(chars, row[2:][whole], whole, len(texts))
        names = [chr(k >> 42) + chr(k >> 21 & 0x1FFFFF) + chr(k & 0x1FFFFF) for k in known.tolist()]
        expected = sorted({(t[i : i + 3], n) for n, t in enumerate(texts) for i in range(len(t) - 2)})
        assert [(names[w], n) for w, n in zip(which.tolist(), lines.tolist(), strict=True)] == expected


def test_tokens_that_no_query_asks_for_are_not_shuffled(spark, tmp_path):
    table = spark.createDataFrame([(i, " ".join(str(40 * i + k) for k in range(40))) for i in range(300)], "doc_id long, text string")  # 12,000 different tokens
    queries = spark.createDataFrame([(1, "17 80 absent"), (2, "11999")], "query_id long, text string")
    found = []
    assert rows_shuffled(spark, lambda: ranked.write(table, str(tmp_path))) < 100
    assert rows_shuffled(spark, lambda: found.extend(ranked.search_blocks(spark, str(tmp_path), queries, 5).collect())) < 100
    assert sorted((r.query_id, r.doc_id) for r in found) == [(1, 0), (1, 2), (2, 299)]


def test_blocks_of_many_documents_and_repeats(spark, tmp_path):
    texts = [(i, "alpha " * (i % 5) + "beta") for i in range(400)] + [(400, "alpha " * 300), (401, "beta " * 70_000), (402, None)]
    table = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    queries = spark.createDataFrame([(1, "alpha"), (2, "beta alpha")], "query_id long, text string")
    ranked.write(table, str(tmp_path), block=500)  # numbers of documents and of repeats do not fit a byte
    best = lambda df: {(x.query_id, x["rank"]): (x.doc_id, x.score) for x in search.top(df.withColumn("score", F.round("score", 6)), 300, "query_id").collect()}
    got, expected = best(ranked.search_blocks(spark, str(tmp_path), queries, 300)), best(search.bm25(table, queries))
    assert len(got) == 600 and got == {k: (d, pytest.approx(s)) for k, (d, s) in expected.items()}
