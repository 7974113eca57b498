"""Fill-in-the-middle, piece encoding and vector codes: plain versions, the library itself, exact round trips, odd rows."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from codestrata.llm import infill, piece_encoding, queries, vector_codes

PIECES = "ab aab  \n\tthe ▁ é日本ﬁ👩‍👧\x00<s>0x1f</s>"


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    """Texts of many kinds as a table, with columns that clash with names used inside."""
    r, folder = random.Random(31), tmp_path_factory.mktemp("codes")
    texts = ["".join(r.choice(PIECES) for _ in range(r.choice((1, 5, 60, 900)))) for _ in range(150)]
    texts += [None, "", " ", "   x", "a" * 30_000, "wort " * 9000, "a<P>b", "<M>", "x<S", "<", "the end\r\n", texts[0], texts[0]]
    rows = [(i, t, "en", 1, "h") for i, t in enumerate(texts)] + [(None, "no id", None, None, None), (7, "again", "de", 2, "x")]
    spark.createDataFrame(rows, "doc_id long, text string, form string, n long, ids string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    return str(folder), [r[:2] for r in rows]


def plain_infill(doc_id, text):
    digest, n = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest(), len(text)
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = "<P>" + text[:a], "<M>" + text[a:b], "<S>" + text[b:]
    return (n, "spm", a, b - a, s + p + m) if h4 % 100 < 20 else (n, "psm", a, b - a, p + s + m)


def test_infill(spark, documents):
    folder, rows = documents
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    expected = []
    for i, t in rows:
        n, form, first, middle, output = plain_infill(i, t or "")
        expected.append((i, n, form, first, middle, sha(output), sha(t or "")))
    key = lambda rows: sorted(map(tuple, rows), key=str)
    assert key(queries.QUERIES["op11_infill"](spark, folder).collect()) == key(expected)
    assert {e[2] for e in expected} == {"plain", "psm", "spm"}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    assert key(con.sql(queries.SQL["op11_infill"]).project("doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256").fetchall()) == key(expected)
    assert infill.infill(spark.read.parquet(f"{folder}/documents.parquet").limit(0)).count() == 0


def test_offsets_have_one_rank_for_each_code_point():
    r = random.Random(32)
    texts = ["".join(r.choice(PIECES) for _ in range(r.randint(0, 80))) for _ in range(200)] + ["x" * 5000, ""]
    offsets = infill.Offsets(texts)
    for i, t in enumerate(texts):
        n, at = offsets.of(i)
        assert n == len(t) and [at(k) for k in range(n + 1)] == list(range(n + 1))


def library():
    import sentencepiece

    import public_tokenizers

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(piece_encoding.MODEL))


def test_piece_encoding_query(spark, documents):
    folder, rows = documents
    sp, expected = library(), []
    for i, t in rows:
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        decoded = sp.decode(ids)
        expected.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    key = lambda rows: sorted(map(tuple, rows), key=str)
    assert key(queries.QUERIES["op12_piece_encoding"](spark, folder).collect()) == key(expected)
    encoded = piece_encoding.encode(spark.read.parquet(f"{folder}/documents.parquet").limit(0))
    assert encoded.count() == 0 == piece_encoding.decode(encoded).count()
    assert piece_encoding.decode(spark.createDataFrame([(1, 0, None)], "doc_id long, n_tokens long, ids binary")).first().text == ""


def test_piece_encoding_is_the_librarys():
    """Pieces side by side, runs of one character and of blanks, ties, foreign characters; any cut into stretches."""
    r, sp, model = random.Random(33), library(), piece_encoding.model()
    names = [sp.id_to_piece(i) for i in range(259, 32_000)]
    texts = ["".join(r.choice(names) for _ in range(r.randint(0, 30))) for _ in range(3000)]
    texts += ["".join(r.choice("ab aab  \n") for _ in range(r.randint(0, 60))) for _ in range(2000)]
    texts += [r.choice("aeo=-_*. xＡ") * r.randint(0, 300) for _ in range(300)] + [" " * r.randint(0, 70) + r.choice(("", "x", "▁▁")) + " " * r.randint(0, 40) for _ in range(300)]
    texts += ["".join(chr(r.choice((r.randint(0, 127), r.randint(0x4E00, 0x4FFF), r.randint(0x1F300, 0x1F6FF), 0x2581, 0xFFFD))) for _ in range(60)) for _ in range(500)]
    expected = sp.encode(texts, add_bos=True, add_eos=True, num_threads=1)
    for stretch in (1 << 20, 40):
        got = list(model.encode(texts if stretch > 40 else texts[:2500], stretch))
        assert [g.tolist() for g in got] == expected[: len(got)]
    assert model.decode([np.array(e, "<u4") for e in expected]) == sp.decode(expected)
    ids = [[r.randint(0, 31_999) if r.random() < 0.5 else r.randint(0, 258) for _ in range(r.randint(0, 12))] for _ in range(3000)]
    assert model.decode([np.array(x, "<u4") for x in ids]) == [sp.decode(x) for x in ids]


def plain_codes(rows, parts=4, entries=256, rounds=4):
    """Lloyd's rounds in whole numbers, every distance computed. rows: (vec_id, vector, label)."""
    kept = [r for r in rows if r[1] is not None and all(v is not None and np.isfinite(v) for v in r[1])]
    width = -(-max((len(v) for _, v, _ in kept), default=1) // parts)
    whole = [[int(np.floor(np.float64(v) * 1024)) for v in r[1]] for r in kept]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, whole[i]))
    x = np.array([w + [0] * (parts * width - len(w)) for w in whole], np.int64).reshape(len(kept), parts, width)
    books = [x[order[:entries], p].copy() for p in range(parts)]
    for n in range(rounds + 1):
        d = [((x[:, p, None, :] - books[p][None]) ** 2).sum(2) for p in range(parts)]
        code = [m.argmin(1) for m in d]
        if n < rounds:
            for p in range(parts):
                for e in set(code[p].tolist()):
                    own = x[code[p] == e, p]
                    books[p][e] = own.sum(0) // len(own)
    error = sum(d[p][np.arange(len(kept)), code[p]] for p in range(parts))
    label = {}
    for r, e in zip(kept, error, strict=True):
        label[r[2]] = label.get(r[2], 0) + int(e)
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel()).encode()).hexdigest()
    return [(r[0], bytes(int(code[p][i]) for p in range(parts)).hex(), int(error[i]), label[r[2]], digest) for i, r in enumerate(kept)]


@pytest.mark.parametrize("kind", ["loose", "ties", "ragged", "few", "huge"])
def test_vector_codes(spark, tmp_path, kind):
    r = np.random.default_rng(34)
    n, d = {"loose": (900, 16), "ties": (700, 8), "ragged": (400, 7), "few": (40, 8), "huge": (300, 8)}[kind]
    x = r.normal(size=(n, d))
    if kind == "ties":
        x = r.integers(-2, 3, (n, d)) / 1024
    if kind == "huge":
        x = x * 50_000
    rows = [(int(i), [float(v) for v in x[i][: d if kind != "ragged" or i % 3 else i % d]], None if i % 7 == 0 else int(i % 3)) for i in r.permutation(n)]
    rows += [(3, rows[0][1], 1), (3, rows[1][1], 1), (None, rows[2][1], 2), (-1, None, 1), (-2, [float("nan")] * d, 1), (-3, [None] * d, 1), (-4, [float("inf")] * d, 0)]
    table = spark.createDataFrame([(*row, "c", 0.5) for row in rows], "vec_id long, embedding array<double>, label int, code string, error double")
    table.repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.QUERIES["op13_vector_codes"](spark, str(tmp_path)).collect()
    key = lambda rows: sorted(map(tuple, rows), key=str)
    assert key(got) == key(plain_codes(rows))


def test_vector_codes_of_no_rows(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    df = queries.QUERIES["op13_vector_codes"](spark, str(tmp_path))
    assert df.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and df.count() == 0


def test_bounds_save_most_distances():
    """In loose groups, later rounds compute few of the distances, and get the same entries."""
    r = np.random.default_rng(35)
    x = (r.normal(size=(64, 16)) * 400)[r.integers(0, 64, 4000)].astype(np.int64) + r.integers(-60, 61, (4000, 16))
    part = vector_codes.Part(x[:256].copy())
    code, exact, lower = part.first(x)
    upper, computed = np.sqrt(exact), 0
    for _ in range(3):
        book = part.book.copy()
        for e in np.unique(code):
            book[e] = x[code == e].sum(0) // (code == e).sum()
        packed, scale = vector_codes._pack(lower)
        assert (packed * scale[:, None].astype(np.float64) <= lower + 1e-6).all()
        part = vector_codes.Part(book, part.book)
        code, upper, lower, n = part.again(x, code, upper, packed * scale[:, None].astype(np.float64) * (1 - vector_codes.ROOM))
        computed += n
        d = vector_codes.distances(x, book)
        assert (code == d.argmin(1)).all() and (upper**2 >= d.min(1) * (1 - 1e-9)).all() and (lower**2 <= d + 1e-6).all()
    assert computed < 0.15 * 3 * 4000 * 256


def test_restore_is_by_functions(spark):
    row = spark.createDataFrame([("<P>a<<S>c><M>b<", "psm"), ("<S>c<P>a<M>b", "spm"), ("<P>", "plain")], "output string, form string")
    assert [r[0] for r in row.select(infill.restore(F.col("output"), F.col("form"))).collect()] == ["a<b<c>", "abc", "<P>"]
