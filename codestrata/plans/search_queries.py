"""Queries of retrieval, co-change and text search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions import symbols
from codestrata.functions import text as T
from codestrata.operators import contracts, graph, knowledge, search, summaries

from .adapters import daily_baskets, document_lines, table, texts

_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


def _tokens_sql(text: str) -> str:
    raw = f"regexp_extract_all(regexp_replace(coalesce({text}, ''), '([a-z])([A-Z])', '\\1 \\2', 'g'), '[0-9]+|\\p{{L}}+')"
    return f"list_filter(list_transform({raw}, lambda x: lower(x)), lambda x: (strlen(x) >= 2 OR regexp_full_match(x, '[0-9]+')) AND x NOT IN ({_STOP}))"


_POSTINGS = f"""tok AS (SELECT doc_id, {_tokens_sql('text')} AS ts FROM documents),
len AS (SELECT doc_id, len(ts) AS dl FROM tok), st AS (SELECT count(*) AS n, avg(dl) AS adl FROM len),
post AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS token FROM tok) GROUP BY ALL),
dfs AS (SELECT token, count(*) AS df FROM post GROUP BY token)"""


def _bm25_sql(queries: str) -> str:
    return f"""{_POSTINGS}, q AS (SELECT item_id AS query_id, unnest({_tokens_sql('text')}) AS token FROM {queries}),
scored AS (SELECT q.query_id, post.doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / adl))) AS score,
  list_sort(list(q.token)) AS matched
 FROM q JOIN post USING (token) JOIN dfs USING (token) JOIN len USING (doc_id), st GROUP BY ALL)"""


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def tokenize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir, "doc_id", "text")
    return docs.select("doc_id", F.posexplode(T.tokenize(F.col("text"))).alias("pos", "token")).select("doc_id", F.col("pos").cast("long").alias("pos"), "token")


def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = texts(spark, sf_dir, "text").select(F.size(T.tokenize(F.col("text"))).alias("n"))
    return sizes.agg(F.count("*").alias("total_docs"), F.sum("n").alias("total_tokens"), F.round(F.avg("n"), 6).alias("avg_doc_length"))


def postings_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = search.postings(texts(spark, sf_dir, "doc_id", "text"))
    return index.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.bm25(texts(spark, sf_dir, "doc_id", "text"), _queries(spark, sf_dir).where("query_id = 0"))
    best = search.top(found.withColumn("score", F.round("score", 6)), 10)
    return best.select("doc_id", "score", F.array_join("matched", " ").alias("matched"))


def bm25_multi_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.bm25(texts(spark, sf_dir, "doc_id", "text"), _queries(spark, sf_dir)).withColumn("score", F.round("score", 6))
    return search.top(found, 5, "query_id").select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


def _vector_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("query_vector"))


def embed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = search.embed(table(spark, sf_dir, "embeddings"), _vector_query(spark, sf_dir), "vec_id")
    return search.top(scored.withColumn("score", F.round("score", 6)), 10).select(F.col("doc_id").alias("vec_id"), "score")


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by BM25 and, under the same ids, vectors by cosine."""
    words = search.bm25(texts(spark, sf_dir, "doc_id", "text"), _queries(spark, sf_dir).where("query_id = 0")).withColumn("score", F.round("score", 6))
    near = search.embed(table(spark, sf_dir, "embeddings"), _vector_query(spark, sf_dir), "vec_id")
    mixed = search.hybrid(words, near).withColumn("score", F.round("score", 6))
    return search.top(mixed, 20).select("doc_id", "score")


def _pairs(spark: SparkSession, sf_dir: str, ratio: float = graph.MIN_RATIO) -> DataFrame:
    return graph.pairs(daily_baskets(spark, sf_dir), min_ratio=ratio, excludes=())


def _shown(found: DataFrame) -> DataFrame:
    return found.select("file_a", "file_b", "shared", "total_a", "total_b", F.round("ratio", 6).alias("ratio"), "strength")


def cochange_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_pairs(spark, sf_dir))


def cochange_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cochange_pairs(), of which a report shows the first 100."""
    return _shown(graph.best_pairs(daily_baskets(spark, sf_dir), 100, excludes=()))


def cochange_asymmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.directed(_pairs(spark, sf_dir)).select("file", "partner", "shared", F.round("confidence", 6).alias("confidence"))


def cochange_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.item_clusters(graph.compared(daily_baskets(spark, sf_dir), excludes=()), 0.9)
    return found.select("component", F.array_join(F.transform("files", lambda x: x.cast("string")), ",").alias("files"), "size", F.round("cohesion", 6).alias("cohesion"))


def cluster_partial_touch(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = graph.item_members(graph.compared(daily_baskets(spark, sf_dir), min_ratio=0.9, excludes=()), 0.9, 0.9)
    plan = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("node"))
    return graph.partly_touched(members, plan)


_PLAN = (3, 7, 11)


def missing_cochange(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = spark.range(1).select(F.explode(F.array(*[F.lit(x).cast("long") for x in _PLAN])).alias("file"))
    found = graph.partners(*graph.class_pairs(daily_baskets(spark, sf_dir), excludes=(), wanted=plan), plan)
    return graph.unplanned(found, plan).select("partner", F.round("confidence", 6).alias("confidence"), "because")


def cochange_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.of_all(daily_baskets(spark, sf_dir), [3, 7])


_PAIRS_SQL = """b AS (SELECT DISTINCT CAST(ts AS DATE) AS sha, user_id AS file FROM events),
t AS (SELECT file, count(*) AS total FROM b GROUP BY file HAVING count(*) >= 5), k AS (SELECT b.*, total FROM b JOIN t USING (file)),
p AS (SELECT * FROM (SELECT x.file AS file_a, y.file AS file_b, count(*) AS shared, any_value(x.total) AS total_a, any_value(y.total) AS total_b,
  count(*) / greatest(any_value(x.total), any_value(y.total)) AS ratio FROM k x JOIN k y ON x.sha = y.sha AND x.file < y.file GROUP BY ALL) WHERE ratio >= 0.5),
d AS (SELECT file_a AS file, file_b AS partner, shared, shared / total_a AS confidence FROM p UNION ALL SELECT file_b, file_a, shared, shared / total_b FROM p)"""
_COMPONENTS_SQL = """e AS (SELECT file_a AS a, file_b AS b FROM p WHERE ratio >= 0.9 UNION SELECT file_b, file_a FROM p WHERE ratio >= 0.9),
reach AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
m AS (SELECT a AS node, least(a, min(b)) AS component FROM reach GROUP BY a)"""


def crossref_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = T.explode_tokens(_queries(spark, sf_dir), "text").select(F.col("token").alias("identifier")).distinct()
    found = contracts.crossref(items, document_lines(spark, sf_dir))
    return found.select("identifier", "status", F.col("evidence_count").cast("long").alias("evidence_count"))


def grep_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence of two words by themselves: file, line and column from 1."""
    lines = document_lines(spark, sf_dir)
    found = symbols.references(lines, "the").unionByName(symbols.references(lines, "est"))
    return found.select("path", "line_no", "col")


def grep_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The output of a search, as file:line:text, by file."""
    found = symbols.references(document_lines(spark, sf_dir), "the").dropDuplicates(["path", "line_no"])
    return summaries.grep_by_file(found.select(F.concat_ws(":", "path", "line_no", "line").alias("line")))


def duplicate_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items and the first half of each as specs."""
    items = _queries(spark, sf_dir).select(F.col("query_id").alias("item_id"), T.tokenize(F.col("text")).alias("terms"))
    halves = items.select((F.col("item_id") + 1_000_000).alias("item_id"), F.slice("terms", F.lit(1), F.ceil(F.size("terms") / 2).cast("int")).alias("terms"))
    return knowledge.duplicate_specs(items.unionByName(halves)).withColumn("overlap", F.round("overlap", 6))


def crossref_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = T.explode_tokens(_queries(spark, sf_dir), "text").select(F.col("token").alias("identifier")).distinct()
    return contracts.status_counts(contracts.crossref(items, document_lines(spark, sf_dir)))


def link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("pos", "href"))
    return links.select("page_id", F.col("pos").cast("long").alias("pos"), "href")


_LINES_SQL = """l AS (SELECT doc_id AS path, unnest(range(1, len(parts) + 1)) AS line_no, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL))"""

_CROSSREF_SQL = f"""{_LINES_SQL}, i AS (SELECT DISTINCT t AS identifier FROM (SELECT unnest({_tokens_sql('text')}) AS t FROM benchmark)),
w AS (SELECT DISTINCT path, line_no, unnest(regexp_extract_all(line, '[A-Za-z0-9_]+')) AS word FROM l),
o AS (SELECT identifier, line FROM (SELECT * FROM i WHERE NOT regexp_full_match(identifier, '[A-Za-z0-9_]+')) JOIN l ON contains(line, identifier)),
h AS (SELECT word AS identifier, least(count(*), 20) AS n FROM w GROUP BY word UNION ALL
  SELECT identifier, least(count(*), 20) FROM o WHERE regexp_matches(line, '(^|[^A-Za-z0-9_])' || identifier || '([^A-Za-z0-9_]|$)') GROUP BY identifier),
cr AS (SELECT i.identifier, CASE WHEN n IS NULL THEN 'PHANTOM' WHEN n < 3 THEN 'CANDIDATE' ELSE 'IMPLEMENTED' END AS status, coalesce(n, 0) AS evidence_count
  FROM i LEFT JOIN h ON i.identifier = h.identifier AND strlen(i.identifier) >= 3)"""

QUERIES = {
    f.__name__: f
    for f in (
        tokenize_documents, corpus_stats, postings_df, bm25_search, bm25_multi_query, embed_search, hybrid_search, cochange_pairs,
        cochange_asymmetric, cochange_clusters, cluster_partial_touch, missing_cochange, cochange_intersection, crossref_status,
        grep_references, grep_by_file, duplicate_specs, crossref_counts, link_extract,
    )
}
_COS = "SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) AS c FROM embeddings"
SQL = {
    "tokenize_documents": f"WITH t AS (SELECT doc_id, {_tokens_sql('text')} AS ts FROM documents) SELECT doc_id, unnest(range(len(ts))) AS pos, unnest(ts) AS token FROM t",
    "corpus_stats": f"WITH {_POSTINGS} SELECT count(*) AS total_docs, CAST(sum(dl) AS BIGINT) AS total_tokens, round(avg(dl), 6) AS avg_doc_length FROM len",
    "postings_df": f"WITH {_POSTINGS} SELECT token, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM post GROUP BY token",
    "bm25_search": f"WITH {_bm25_sql('(SELECT * FROM benchmark WHERE item_id = 0)')} SELECT doc_id, round(score, 6) AS score, array_to_string(matched, ' ') AS matched FROM scored ORDER BY round(score, 6) DESC, doc_id LIMIT 10",
    "bm25_multi_query": f"WITH {_bm25_sql('benchmark')}, r AS (SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM scored) SELECT * FROM r WHERE rank <= 5",
    "embed_search": f"SELECT vec_id, round(c, 6) AS score FROM ({_COS}) ORDER BY 2 DESC, 1 LIMIT 10",
    "hybrid_search": f"""WITH {_bm25_sql('(SELECT * FROM benchmark WHERE item_id = 0)')},
b AS (SELECT doc_id, round(score, 6) AS b FROM scored ORDER BY 2 DESC, 1 LIMIT 200), mx AS (SELECT greatest(coalesce(max(b), 0), 1e-9) AS most FROM b), c AS ({_COS})
SELECT coalesce(b.doc_id, c.vec_id) AS doc_id, round(0.3 * coalesce(b / most, 0) + 0.7 * coalesce(least(greatest((c + 1) / 2, 0), 1), 0), 6) AS score
FROM b FULL OUTER JOIN c ON b.doc_id = c.vec_id, mx ORDER BY 2 DESC, 1 LIMIT 20""",
    "cochange_pairs": f"WITH {_PAIRS_SQL} SELECT file_a, file_b, shared, total_a, total_b, round(ratio, 6) AS ratio, CASE WHEN ratio >= 0.9 THEN 'strong' WHEN ratio >= 0.7 THEN 'moderate' ELSE 'weak' END AS strength FROM p",
    "cochange_asymmetric": f"WITH {_PAIRS_SQL} SELECT file, partner, shared, round(confidence, 6) AS confidence FROM d",
    "cochange_clusters": f"""WITH RECURSIVE {_PAIRS_SQL}, {_COMPONENTS_SQL}
SELECT c.component, c.files, c.size, round(coalesce(i.cohesion, 0), 6) AS cohesion FROM
 (SELECT component, string_agg(CAST(node AS VARCHAR), ',' ORDER BY node) AS files, count(*) AS size FROM m GROUP BY component) c LEFT JOIN
 (SELECT x.component, avg(ratio) AS cohesion FROM p JOIN m x ON x.node = file_a JOIN m y ON y.node = file_b AND x.component = y.component GROUP BY 1) i USING (component)""",
    "cluster_partial_touch": f"""WITH RECURSIVE {_PAIRS_SQL}, {_COMPONENTS_SQL}
SELECT component, count(c_custkey) AS touched, count(*) AS size FROM m LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) ON node = c_custkey
GROUP BY component HAVING count(c_custkey) > 0 AND count(c_custkey) < count(*)""",
    "missing_cochange": f"WITH {_PAIRS_SQL} SELECT partner, round(max(confidence), 6) AS confidence, count(*) AS because FROM d WHERE confidence >= 0.9 AND file IN {_PLAN} AND partner NOT IN {_PLAN} GROUP BY partner",
    "cochange_intersection": f"WITH {_PAIRS_SQL}, s AS (SELECT sha FROM b WHERE file IN (3, 7) GROUP BY sha HAVING count(*) = 2) SELECT file, count(*) AS commits FROM b JOIN s USING (sha) WHERE file NOT IN (3, 7) GROUP BY file",
    "crossref_status": f"WITH {_CROSSREF_SQL} SELECT identifier, status, evidence_count FROM cr",
    "crossref_counts": f"WITH {_CROSSREF_SQL} SELECT status, count(*) AS identifiers FROM cr GROUP BY status",
    "grep_references": f"""WITH {_LINES_SQL}, k(word) AS (VALUES ('the'), ('est')), c AS (SELECT path, line_no, line, word, unnest(range(1, length(line) + 1)) AS col FROM l JOIN k ON contains(line, word))
SELECT path, line_no, col FROM c WHERE substr(line, col, 3) = word AND (col = 1 OR NOT regexp_full_match(substr(line, col - 1, 1), '[A-Za-z0-9_]'))
 AND (col + 3 > length(line) OR NOT regexp_full_match(substr(line, col + 3, 1), '[A-Za-z0-9_]'))""",
    "grep_by_file": f"WITH {_LINES_SQL} SELECT CAST(path AS VARCHAR) AS file, count(*) AS matches FROM l WHERE regexp_matches(line, '(^|[^A-Za-z0-9_])the([^A-Za-z0-9_]|$)') GROUP BY path ORDER BY 2 DESC, 1 LIMIT 15",
    "duplicate_specs": f"""WITH i AS (SELECT item_id, {_tokens_sql('text')} AS ts FROM benchmark), t AS (SELECT item_id, list_distinct(ts) AS ts FROM i
  UNION ALL SELECT item_id + 1000000, list_distinct(ts[1:CAST(ceil(len(ts) / 2) AS BIGINT)]) FROM i)
SELECT a.item_id AS item_a, b.item_id AS item_b, len(list_intersect(a.ts, b.ts)) AS shared, round(len(list_intersect(a.ts, b.ts)) / least(len(a.ts), len(b.ts)), 6) AS overlap
FROM t a JOIN t b ON a.item_id < b.item_id WHERE len(list_intersect(a.ts, b.ts)) > 0.7 * least(len(a.ts), len(b.ts)) AND len(list_intersect(a.ts, b.ts)) > 0""",
    "link_extract": """WITH t AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS h FROM pages) SELECT page_id, unnest(range(len(h))) AS pos, unnest(h) AS href FROM t""",
}
