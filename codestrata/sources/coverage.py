"""Coverage reports as one table: (report, path, line, hits). Reports are files (path, content)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Where reports are looked for.
CANDIDATES = (
    "lcov.info", "coverage/lcov.info", "coverage.xml", "cobertura.xml", "coverage/cobertura-coverage.xml", "target/site/jacoco/jacoco.xml",
    "build/reports/jacoco/test/jacocoTestReport.xml", "coverage/coverage-summary.json", "coverage-summary.json", "coverage.out", "cover.out", "c.out",
)


def lcov(files: DataFrame) -> DataFrame:
    """Records SF: to end_of_record hold DA:line,hits; a line reported twice keeps its last number."""
    records = files.select(F.col("path").alias("report"), F.explode(F.split("content", r"(?m)^end_of_record\s*$")).alias("record"))
    named = records.withColumn("path", F.regexp_extract("record", r"(?m)^SF:(.+?)\s*$", 1)).where("path <> ''")
    rows = named.select("report", "path", F.posexplode(F.regexp_extract_all("record", F.lit(r"(?m)^DA:([0-9]+,[0-9]+)"), F.lit(1))).alias("n", "da"))
    parts = rows.select("report", "path", "n", F.split("da", ",").alias("p"))
    return parts.groupBy("report", "path", F.get("p", F.lit(0)).cast("int").alias("line")).agg(F.max_by(F.get("p", F.lit(1)).cast("long"), "n").alias("hits"))


def cobertura(files: DataFrame) -> DataFrame:
    """Lines of class elements, those inside methods too."""
    rows = files.select(F.col("path").alias("report"), F.explode(F.regexp_extract_all("content", F.lit(r"(?s)<class\b.*?</class>"), F.lit(0))).alias("c"))
    rows = rows.withColumn("path", F.regexp_extract("c", r'^<class\b[^>]*?\bfilename="([^"]*)"', 1)).where("path <> ''")
    lines = rows.select("report", "path", F.explode(F.regexp_extract_all("c", F.lit(r"<line\b[^>]*>"), F.lit(0))).alias("l"))
    number = lambda k: F.regexp_extract("l", rf'\b{k}="([0-9]+)"', 1).try_cast("long")
    return lines.select("report", "path", number("number").cast("int").alias("line"), number("hits").alias("hits")).where("line is not null")


def jacoco(files: DataFrame) -> DataFrame:
    """Lines of source files, their path that of the package; hits are the covered instructions."""
    package = F.explode(F.regexp_extract_all("content", F.lit(r"(?s)<package\b.*?</package>"), F.lit(0)))
    rows = files.select(F.col("path").alias("report"), package.alias("p"))
    rows = rows.select("report", F.regexp_extract("p", r'^<package\b[^>]*?\bname="([^"]*)"', 1).alias("folder"), F.explode(F.regexp_extract_all("p", F.lit(r"(?s)<sourcefile\b.*?</sourcefile>"), F.lit(0))).alias("s"))
    name = F.regexp_extract("s", r'^<sourcefile\b[^>]*?\bname="([^"]*)"', 1)
    rows = rows.select("report", F.when(F.col("folder") == "", name).otherwise(F.concat_ws("/", "folder", name)).alias("path"), F.explode(F.regexp_extract_all("s", F.lit(r"<line\b[^>]*>"), F.lit(0))).alias("l"))
    number = lambda k: F.regexp_extract("l", rf'\b{k}="([0-9]+)"', 1).try_cast("long")
    return rows.select("report", "path", number("nr").cast("int").alias("line"), number("ci").alias("hits")).where("line is not null")


def go_profile(files: DataFrame) -> DataFrame:
    """A row for each block of a coverprofile, at its first line."""
    rows = files.select(F.col("path").alias("report"), F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^(\S+:[0-9]+\.[0-9]+,[0-9]+\.[0-9]+ [0-9]+ [0-9]+)"), F.lit(1))).alias("b"))
    at = lambda i: F.regexp_extract("b", r"^(.+):([0-9]+)\..* ([0-9]+)$", i)
    return rows.select("report", at(1).alias("path"), at(2).cast("int").alias("line"), at(3).cast("long").alias("hits"))


def jest_summary(files: DataFrame) -> DataFrame:
    """(report, path, lines_total, lines_covered, percent) of a summary; its entry "total" is no file."""
    kind = "map<string,struct<lines:struct<total:bigint,covered:bigint,pct:double>>>"
    rows = files.select(F.col("path").alias("report"), F.explode(F.from_json("content", kind)).alias("path", "x")).where("path <> 'total' and x.lines is not null")
    return rows.select("report", "path", F.col("x.lines.total").alias("lines_total"), F.col("x.lines.covered").alias("lines_covered"), F.col("x.lines.pct").alias("percent"))


def find(files: DataFrame) -> DataFrame:
    """The files that are reports by their place."""
    return files.where(F.col("path").isin(*CANDIDATES))


#: Which parser reads which of the places, by the form of its report.
FORMS = {
    "lcov": ("lcov.info", "coverage/lcov.info"),
    "cobertura": ("coverage.xml", "cobertura.xml", "coverage/cobertura-coverage.xml"),
    "jacoco": ("target/site/jacoco/jacoco.xml", "build/reports/jacoco/test/jacocoTestReport.xml"),
    "go": ("coverage.out", "cover.out", "c.out"),
}


def discover(files: DataFrame) -> DataFrame:
    """(report, path, line, hits) of all reports with lines that files (path, content) holds at the usual places."""
    found = find(files)
    parsers = {"lcov": lcov, "cobertura": cobertura, "jacoco": jacoco, "go": go_profile}
    out = None
    for form, places in FORMS.items():
        own = parsers[form](found.where(F.col("path").isin(*places))).select("report", "path", "line", "hits")
        out = own if out is None else out.unionByName(own)
    return out


def read_lcov(spark: SparkSession, *places: str) -> DataFrame:
    """(report, path, line, hits) of LCOV files, read record by record: a large file is split over tasks."""
    records = spark.read.option("lineSep", "end_of_record").text(list(places))
    return lcov(records.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")))


def read_go_profile(spark: SparkSession, *places: str) -> DataFrame:
    """(report, path, line, hits) of coverprofiles, read line by line."""
    return go_profile(spark.read.text(list(places)).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")))


_LINES = "array<struct<_number:string,_hits:string>>"


def read_cobertura(spark: SparkSession, *places: str) -> DataFrame:
    """(report, path, line, hits) of Cobertura files, of any size: read as a stream of class elements by Spark's XML source.

    Attributes stand in any order; comments, CDATA and entities are XML's own affair. A file is one task's, which holds
    one class at a time; files are read side by side. A file that isn't well-formed gives the classes before its fault.
    """
    schema = f"_filename string, lines struct<line:{_LINES}>, methods struct<method:array<struct<lines:struct<line:{_LINES}>>>>"
    rows = spark.read.format("xml").option("rowTag", "class").schema(schema).load(list(places))
    none = F.array().cast(_LINES)
    inner = F.flatten(F.transform(F.coalesce("methods.method", F.array().cast(f"array<struct<lines:struct<line:{_LINES}>>>")), lambda m: F.coalesce(m["lines"]["line"], none)))
    each = rows.where("_filename <> ''").select(
        F.col("_metadata.file_path").alias("report"), F.col("_filename").alias("path"), F.explode(F.concat(inner, F.coalesce("lines.line", none))).alias("l")
    )
    return each.select("report", "path", F.col("l._number").try_cast("int").alias("line"), F.col("l._hits").try_cast("long").alias("hits")).where("line is not null")


def read_jacoco(spark: SparkSession, *places: str) -> DataFrame:
    """(report, path, line, hits) of JaCoCo files, read as a stream of package elements like read_cobertura()."""
    schema = "_name string, sourcefile array<struct<_name:string,line:array<struct<_nr:string,_ci:string>>>>"
    rows = spark.read.format("xml").option("rowTag", "package").schema(schema).load(list(places))
    each = rows.select(F.col("_metadata.file_path").alias("report"), F.coalesce("_name", F.lit("")).alias("folder"), F.explode("sourcefile").alias("s"))
    each = each.select("report", "folder", F.col("s._name").alias("name"), F.explode("s.line").alias("l"))
    path = F.when(F.col("folder") == "", F.col("name")).otherwise(F.concat_ws("/", "folder", "name"))
    return each.select("report", path.alias("path"), F.col("l._nr").try_cast("int").alias("line"), F.col("l._ci").try_cast("long").alias("hits")).where("line is not null")
