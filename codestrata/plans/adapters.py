"""Benchmark tables as repository facts: commits, files, lines, endpoints. No rows are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Set to "true", texts are dealt to all cores by a shuffle: for files of one row group, which one core would read.
DEAL = "spark.codestrata.dealTexts"


def texts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The documents, only with these columns, for work on every text; read where they lie unless DEAL is set."""
    docs = table(spark, sf_dir, "documents").select(*columns)
    return docs.repartition(spark.sparkContext.defaultParallelism) if spark.conf.get(DEAL, "false") == "true" else docs


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, line_no, line): documents as files, their lines from 1."""
    docs = texts(spark, sf_dir, "doc_id", "text").select(F.col("doc_id").alias("path"), "text")
    return docs.select("path", F.posexplode(F.split("text", "\n", -1)).alias("at", "line")).select(
        "path", (F.col("at") + 1).cast("long").alias("line_no"), "line"
    )


def daily_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sha, file): a day of events as a commit, its users as files."""
    return table(spark, sf_dir, "events").select(F.to_date("ts").alias("sha"), F.col("user_id").alias("file"))


def order_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sha, author, authored_at, subject): orders as commits."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("sha"), F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("authored_at"), subject().alias("subject")
    )


def subject() -> Column:
    """A commit subject that follows from the order's key and priority."""
    start = F.element_at(
        F.array(*map(F.lit, ("feat! ", "fix: timeout in ", "Revert ", "docs: ", "migrate ", "fix flaky ", "refactor: ", "chore: "))),
        (F.col("o_orderkey") % 8 + 1).cast("int"),
    )
    return F.concat(start, F.lower("o_orderpriority"))


SUBJECT_SQL = """(CASE o_orderkey % 8 WHEN 0 THEN 'feat! ' WHEN 1 THEN 'fix: timeout in ' WHEN 2 THEN 'Revert ' WHEN 3 THEN 'docs: '
  WHEN 4 THEN 'migrate ' WHEN 5 THEN 'fix flaky ' WHEN 6 THEN 'refactor: ' ELSE 'chore: ' END || lower(o_orderpriority))"""


def release_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tag, tagged_at): a release at the start of each year that has orders, but for the first."""
    years = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("y")).distinct()
    first = years.agg(F.min("y").alias("first"))
    return years.crossJoin(F.broadcast(first)).where("y > first").select(
        F.concat(F.lit("v1."), (F.col("y") - F.col("first")).cast("string"), F.lit(".0")).alias("tag"),
        F.make_date("y", F.lit(1), F.lit(1)).cast("timestamp_ntz").alias("tagged_at"),
    )


TAGS_SQL = """tags AS (SELECT 'v1.' || (y - first) || '.0' AS tag, make_timestamp(y, 1, 1, 0, 0, 0) AS tagged_at FROM
  (SELECT DISTINCT year(o_orderdate) AS y FROM orders), (SELECT min(year(o_orderdate)) AS first FROM orders) WHERE y > first)"""


def part_path() -> Column:
    """A file path made of a part's type, brand and name."""
    ends = F.element_at(
        F.array(*map(F.lit, (".go", ".rs", "_test.go", ".test.ts", ".py", ".md", ".lock", ".min.js", "", ".tsx"))), (F.col("p_partkey") % 10 + 1).cast("int")
    )
    start = F.element_at(F.array(*map(F.lit, ("src/", "tests/", "vendor/", "lib/", "docs/", "app/models/", ""))), (F.col("p_partkey") % 7 + 1).cast("int"))
    return F.concat(start, F.lower(F.regexp_replace("p_brand", "[^A-Za-z0-9]", "")), F.lit("/"), F.translate(F.lower("p_name"), " ", "_"), ends)


PATH_SQL = """(CASE p_partkey % 7 WHEN 0 THEN 'src/' WHEN 1 THEN 'tests/' WHEN 2 THEN 'vendor/' WHEN 3 THEN 'lib/' WHEN 4 THEN 'docs/'
  WHEN 5 THEN 'app/models/' ELSE '' END || lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')) || '/' || replace(lower(p_name), ' ', '_') ||
  CASE p_partkey % 10 WHEN 0 THEN '.go' WHEN 1 THEN '.rs' WHEN 2 THEN '_test.go' WHEN 3 THEN '.test.ts' WHEN 4 THEN '.py' WHEN 5 THEN '.md'
  WHEN 6 THEN '.lock' WHEN 7 THEN '.min.js' WHEN 8 THEN '' ELSE '.tsx' END)"""
