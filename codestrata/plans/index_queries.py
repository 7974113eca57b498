"""Queries of written indexes: each writes its index to the shared folder, asks it, and gives what a full scan would."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions import text as T
from codestrata.operators import contracts, grams, matching, ranked, search, segments, vector_lists

from .adapters import document_lines, table, texts
from .parsed_queries import _CODE, _code, new_folder
from .search_queries import _LINES_SQL, _bm25_sql, _queries, _tokens_sql


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first long word of each benchmark text."""
    return table(spark, sf_dir, "benchmark").select(F.regexp_extract("text", "([A-Za-z]{6,})", 1).alias("word")).where("word <> ''").distinct()


def indexed_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of many words in all documents, by grams."""
    place = new_folder(spark, "grams")
    grams.write(document_lines(spark, sf_dir), place)
    return grams.find(spark, place, _words(spark, sf_dir))


def crossref_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty lines of each word of the benchmark texts, by one automaton of all words."""
    words = T.explode_tokens(_queries(spark, sf_dir), "text").select("token").where(F.col("token").rlike("^[A-Za-z0-9_]{3,}$"))
    found = matching.occurrences(document_lines(spark, sf_dir), words).withColumnRenamed("word", "identifier")
    return contracts.evidence(found).select("identifier", "path", "line_no", F.col("rank").cast("long").alias("rank"))


def indexed_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first symbols that hold a name, found by grams in order of files."""
    place = new_folder(spark, "grams")
    grams.write(_code(spark, sf_dir), place)
    return grams.workspace_symbols(spark, place, "YM_1").select("path", "line_no", "kind", "name")


def block_max_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark text, from blocks that know their best score."""
    place = new_folder(spark, "blocks")
    ranked.write(texts(spark, sf_dir, "doc_id", "text"), place)
    found = ranked.search_blocks(spark, place, _queries(spark, sf_dir), 10).withColumn("score", F.round("score", 6))
    return search.top(found, 10, "query_id").select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every vector whose id is divisible by 100, by inverted lists and codes."""
    vectors, place = table(spark, sf_dir, "embeddings"), new_folder(spark, "vectors")
    codes = vector_lists.write(vectors, place)
    found = vector_lists.nearest(spark, place, codes, vectors.where("vec_id % 100 = 0"), 10).withColumn("score", F.round("score", 6))
    best = search.top(found, 10, "query_id", tie="id")
    return best.select("query_id", F.col("id").alias("vec_id"), "score", F.col("rank").cast("long").alias("rank"))


def _kept(df: DataFrame, place: str) -> DataFrame:
    """df, computed once and written below the folder of its query."""
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def hybrid_multi_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark text that has a vector of its number: words and vectors, both by index."""
    vectors, place = table(spark, sf_dir, "embeddings"), new_folder(spark, "mixed")
    own = _kept(_queries(spark, sf_dir).join(vectors.select(F.col("vec_id").alias("query_id"), "embedding"), "query_id"), f"{place}/own")
    ranked.write(texts(spark, sf_dir, "doc_id", "text"), f"{place}/words")
    words = ranked.search_blocks(spark, f"{place}/words", own.select("query_id", "text"), search.CANDIDATES).withColumn("score", F.round("score", 6))
    words = _kept(search.top(words, search.CANDIDATES, "query_id").drop("rank"), f"{place}/best")
    codes = vector_lists.write(vectors, f"{place}/vectors")
    asked = own.select(F.col("query_id").alias("vec_id"), "embedding")
    near = _kept(search.top(vector_lists.nearest(spark, f"{place}/vectors", codes, asked, 10 + search.CANDIDATES), 10 + search.CANDIDATES, "query_id", tie="id"), f"{place}/near")
    mixed = search.hybrid_many(words, near, vectors.select(F.col("vec_id").alias("doc_id"), "embedding"), own.select("query_id", "embedding"))
    return search.top(mixed.withColumn("score", F.round("score", 6)), 10, "query_id").select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


def refreshed_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best documents of each benchmark text, from an index that was filled, refreshed twice and merged.

    Files are sources. The first filling lacks each third document and has changed texts; a source that is gone later
    is among it, too.
    """
    place = new_folder(spark, "segments")
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("path"), "doc_id", "text")
    old = docs.where("doc_id % 3 <> 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.upper("text")).otherwise(F.col("text")))
    gone = docs.select(F.lit("gone").alias("path"), (F.col("doc_id") + 1_000_000_000).alias("doc_id"), "text")
    segments.refresh(spark, place, old.unionByName(gone))
    segments.refresh(spark, place, docs.where("doc_id % 2 = 0"))
    segments.refresh(spark, place, docs)
    segments.merge(spark, place)
    found = segments.find(spark, place, _queries(spark, sf_dir)).withColumn("score", F.round("score", 6))
    return search.top(found, 5, "query_id").select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


QUERIES = {f.__name__: f for f in (indexed_references, indexed_symbols, crossref_evidence, block_max_search, vector_search, hybrid_multi_query, refreshed_index)}
SQL = {
    "indexed_references": f"""WITH {_LINES_SQL}, k AS (SELECT DISTINCT regexp_extract(text, '([A-Za-z]{{6,}})', 1) AS word FROM benchmark),
c AS (SELECT path, line_no, line, word FROM l JOIN k ON word <> '' AND contains(line, word)),
p AS (SELECT path, line_no, word, line, unnest(list_filter(range(1, length(line) + 1), lambda i: substr(line, i, length(word)) = word)) AS col FROM c)
SELECT word, path, line_no, col FROM p WHERE (col = 1 OR NOT regexp_full_match(substr(line, col - 1, 1), '[A-Za-z0-9_]'))
 AND (col + length(word) > length(line) OR NOT regexp_full_match(substr(line, col + length(word), 1), '[A-Za-z0-9_]'))""",
    "indexed_symbols": f"""WITH {_CODE} SELECT path, line_no, CASE split_part(trim(lead), ' ', -1) WHEN 'func' THEN 'function' WHEN 'struct' THEN 'struct' WHEN 'def' THEN 'function'
 WHEN 'class' THEN 'class' WHEN 'interface' THEN 'interface' ELSE 'function' END AS kind, name FROM c WHERE contains(lower(name), 'ym_1') ORDER BY path, line_no LIMIT 200""",
    "block_max_search": f"""WITH {_bm25_sql('benchmark')}, r AS (SELECT query_id, doc_id, round(score, 6) AS score,
 row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM scored) SELECT * FROM r WHERE rank <= 10""",
    "vector_search": """WITH c AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score
 FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM c) SELECT * FROM r WHERE rank <= 10""",
    "refreshed_index": f"""WITH {_bm25_sql('benchmark')}, r AS (SELECT query_id, doc_id, round(score, 6) AS score,
 row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM scored) SELECT * FROM r WHERE rank <= 5""",
    "crossref_evidence": f"""WITH {_LINES_SQL}, i AS (SELECT DISTINCT t FROM (SELECT unnest({_tokens_sql('text')}) AS t FROM benchmark) WHERE regexp_full_match(t, '[A-Za-z0-9_]{{3,}}')),
w AS (SELECT DISTINCT path, line_no, unnest(regexp_extract_all(line, '[A-Za-z0-9_]+')) AS t FROM l),
r AS (SELECT t AS identifier, path, line_no, row_number() OVER (PARTITION BY t ORDER BY path, line_no) AS rank FROM w JOIN i USING (t)) SELECT * FROM r WHERE rank <= 20""",
    "hybrid_multi_query": f"""WITH own AS (SELECT item_id, text, embedding FROM benchmark JOIN embeddings ON item_id = vec_id), {_bm25_sql('own')},
b AS (SELECT query_id, doc_id, round(score, 6) AS b FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) <= 200),
mx AS (SELECT query_id, greatest(max(b), 1e-9) AS most FROM b GROUP BY query_id),
c AS (SELECT item_id AS query_id, v.vec_id AS doc_id, list_cosine_similarity(CAST(own.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS c FROM own, embeddings v),
m AS (SELECT coalesce(b.query_id, c.query_id) AS query_id, coalesce(b.doc_id, c.doc_id) AS doc_id, b, c FROM b FULL OUTER JOIN c ON b.query_id = c.query_id AND b.doc_id = c.doc_id),
s AS (SELECT query_id, doc_id, round(0.3 * coalesce(b / most, 0) + 0.7 * coalesce(least(greatest((c + 1) / 2, 0), 1), 0), 6) AS score FROM m LEFT JOIN mx USING (query_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 10""",
}
