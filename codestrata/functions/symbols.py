"""Symbols of source lines by patterns, with the comment above each as its documentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import paths, text

# For each language its patterns in order of precedence; group 1 is the name. The kind "indented" is a
# method where the line is indented and a function elsewhere; "receiver" is a method where a receiver precedes.
PATTERNS = {
    "go": (
        (r"^\s*func\s+(?:\([^)]+\)\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*\(", "receiver"),
        (r"^\s*type\s+([A-Za-z_][A-Za-z0-9_]*)\s+(?:struct|interface|=)", "type"),
        (r"^\s*(?:const|var)\s+([A-Z][A-Za-z0-9_]*)\s+", "constant"),
    ),
    "rust": (
        (r"^\s*(?:pub\s+(?:\([^)]*\)\s+)?)?(?:async\s+)?(?:unsafe\s+)?fn\s+([a-zA-Z_][a-zA-Z0-9_]*)", "function"),
        (r"^\s*(?:pub\s+(?:\([^)]*\)\s+)?)?(?:struct|enum|trait)\s+([A-Z][A-Za-z0-9_]*)", "type"),
        (r"^\s*(?:pub\s+(?:\([^)]*\)\s+)?)?(?:const|static)\s+([A-Z_][A-Z0-9_]*)\s*:", "constant"),
    ),
    "typescript": (
        (r"^\s*(?:export\s+)?(?:async\s+)?function\s+([A-Za-z_$][A-Za-z0-9_$]*)", "function"),
        (r"^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*[:=][^=]*=\s*(?:async\s*)?\(", "function"),
        (r"^\s*(?:export\s+(?:default\s+)?)?(?:abstract\s+)?class\s+([A-Z][A-Za-z0-9_$]*)", "class"),
        (r"^\s*(?:export\s+)?interface\s+([A-Z][A-Za-z0-9_$]*)", "type"),
        (r"^\s*(?:export\s+)?type\s+([A-Z][A-Za-z0-9_$]*)\s*=", "type"),
        (r"^\s*(?:export\s+)?const\s+([A-Z_][A-Z0-9_]+)\s*[:=]", "constant"),
    ),
    "python": (
        (r"^\s*(?:async\s+)?def\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*\(", "indented"),
        (r"^\s*class\s+([A-Z][A-Za-z0-9_]*)", "class"),
    ),
    "php": (
        (r"^\s*(?:(?:public|private|protected|static|abstract|final)\s+)*function\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(", "indented"),
        (r"^\s*(?:abstract\s+|final\s+)?class\s+([A-Z][A-Za-z0-9_]*)", "class"),
        (r"^\s*interface\s+([A-Z][A-Za-z0-9_]*)", "type"),
    ),
    "bash": (
        (r"^\s*function\s+([A-Za-z_][A-Za-z0-9_]*)\s*(?:\(\))?\s*\{?", "function"),
        (r"^\s*([A-Za-z_][A-Za-z0-9_]*)\s*\(\)\s*\{?", "function"),
    ),
}
GREP_KINDS = (
    ("fn", "function"), ("func", "function"), ("def", "function"), ("function", "function"), ("class", "class"), ("struct", "struct"),
    ("interface", "interface"), ("type", "type"), ("enum", "enum"), ("const", "constant"),
)
DEFINITION_WORDS = ("fn ", "func ", "def ", "class ", "struct ", "type ", "const ", "let ", "var ")


def _hit(language: Column, line: Column) -> Column:
    """A struct (name, kind) of the first pattern that fits the line, else null."""
    out = F.lit(None).cast("struct<name:string,kind:string>")
    trimmed = F.trim(line)
    comment = trimmed.startswith("//") | ((language != "bash") & trimmed.startswith("#") & ~trimmed.startswith("#!"))
    tests = []
    for lang, rules in PATTERNS.items():
        same = language.isin("typescript", "javascript") if lang == "typescript" else language == lang
        for pattern, kind in rules:
            if kind == "indented":
                label = F.when(line.rlike("^(    |\t)"), "method").otherwise("function")
            elif kind == "receiver":
                label = F.when(F.ltrim(line).startswith("func ("), "method").otherwise("function")
            else:
                label = F.lit(kind)
            found = F.regexp_extract(line, pattern, 1)
            tests.append(F.when(same & (found != ""), F.struct(found.alias("name"), label.alias("kind"))))
    return F.when(comment, out).otherwise(F.coalesce(*tests))


def extract(lines: DataFrame) -> DataFrame:
    """(repo, path, line_no, language, name, kind, signature, doc) of lines (repo, path, line_no, line).

    doc: the lines of comment that end right above a definition, joined by blanks.
    """
    source = lines.withColumn("language", paths.language(F.col("path"))).where("language is not null")
    order = Window.partitionBy("repo", "path").orderBy("line_no")
    t = F.trim("line")
    comment = F.coalesce(
        *[F.when(t.rlike(p), F.trim(F.regexp_extract(t, p, 1))) for p in (r"^///(.*)$", r"^//(.*)$", r"^#(.*)$", r"^\* (.*)$")]
    )
    marked = source.withColumn("_c", comment).withColumn("_hit", _hit(F.col("language"), F.col("line")))
    # a run of comment lines shares the number of other lines before it
    marked = marked.withColumn("_run", F.sum(F.when(F.col("_c").isNull(), 1).otherwise(0)).over(order))
    runs = (
        marked.where("_c is not null")
        .groupBy("repo", "path", "_run")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "_c"))), lambda x: x["_c"]), " ").alias("doc"), (F.max("line_no") + 1).alias("line_no"))
        .drop("_run")
    )
    hits = marked.where("_hit is not null").select("repo", "path", "line_no", "language", "_hit.name", "_hit.kind", F.trim("line").alias("signature"))
    return hits.join(runs, ["repo", "path", "line_no"], "left")


def workspace_symbols(lines: DataFrame, query: str) -> DataFrame:
    """(path, line_no, kind, name) whose name holds query, whatever its case; a line may give several."""
    rules = [
        F.struct(F.lit(kind).alias("kind"), F.regexp_extract("line", rf"(?:^|[^A-Za-z0-9_]){word} ([A-Za-z0-9_]+)", 1).alias("name")) for word, kind in GREP_KINDS
    ]
    rows = lines.where(~paths.skipped_by_search(F.col("path"))).select("path", "line_no", F.explode(F.array(*rules)).alias("s"))
    return rows.select("path", "line_no", "s.kind", "s.name").where((F.col("name") != "") & F.lower("name").contains(query.lower()))


def references(lines: DataFrame, word: str) -> DataFrame:
    """(path, line_no, col, line) of every place where word stands by itself in lines; col counts from 1."""
    found = lines.where(F.col("line").contains(word) & F.col("line").rlike(text.bounded(word)))
    return found.select("path", "line_no", F.explode(text.standing("line", F.lit(word))).alias("col"), "line")


def definitions(references: DataFrame) -> DataFrame:
    """The references (with line) that a defining word precedes."""
    return references.where(paths.any_of(F.col("line").contains(w) for w in DEFINITION_WORDS))


def identifier_at(line: Column, column: Column) -> Column:
    """The identifier around a column, from 1."""
    before = F.regexp_extract(F.substr(line, F.lit(1), column - 1), "([A-Za-z0-9_]*)$", 1)
    return F.concat(before, F.regexp_extract(F.substr(line, column), "^([A-Za-z0-9_]*)", 1))


def hover(lines: DataFrame, around: int = 2) -> DataFrame:
    """lines with context: the lines from `around` before to `around` after."""
    order = Window.partitionBy("path").orderBy("line_no").rowsBetween(-around, around)
    return lines.withColumn("context", F.array_join(F.collect_list("line").over(order), "\n"))
