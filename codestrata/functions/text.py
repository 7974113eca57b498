"""Text functions as column expressions: the identifier tokenizer, word-boundary search, extraction from code lines."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

# The stop words and phrases that results depend on.
STOP_WORDS = (
    "the", "and", "for", "with", "from", "this", "that", "get", "set", "is", "of", "to", "in", "on", "by", "as", "an", "a",
)
REPLACEMENT_PHRASES = ("use ", "replaced by ", "replaced-by:", "use instead:", "prefer ")
SINCE_PHRASES = ('since = "', 'since="', "since: ", "@since ")
REMOVE_PHRASES = ("remove-after:", "remove after:", "remove_after:")
CONVENTIONAL = ("feat!", "fix!", "refactor!", "perf!", "chore!", "revert!", "build!")
MIGRATION_WORDS = (
    ("migrate ", "migrate_keyword"), ("migration ", "migrate_keyword"), ("replace ", "refactor_keyword"),
    ("rewrite ", "rewrite_keyword"), ("refactor: ", "refactor_keyword"),
)
FLAKY_WORDS = (
    "flaky", "stabilize", "stabili", "race", "timeout", "intermittent", "unstable", "skip test", "disable test",
    "retry", "rerun", "flake",
)
REVERT_WORDS = ("revert ", "reverts ")


def raw_tokens(text: Column) -> Column:
    """Runs of digits and runs of letters, cut where a lower-case letter meets an upper-case one; not yet filtered."""
    cut = F.regexp_replace(F.coalesce(text, F.lit("")), "(?<=[a-z])(?=[A-Z])", " ")
    return F.regexp_extract_all(cut, F.lit(r"([0-9]+|\p{IsAlphabetic}+)"), F.lit(1))


def keep_token(token: Column) -> Column:
    """Of lower-cased tokens: two bytes or more, or digits; no stop words."""
    return ((F.octet_length(token) >= 2) | token.rlike("^[0-9]+$")) & ~token.isin(*STOP_WORDS)


def tokenize(text: Column) -> Column:
    """The tokens of a text as an array, in order, with repeats."""
    return F.filter(F.transform(raw_tokens(text), F.lower), keep_token)


def explode_tokens(docs: DataFrame, text: str, *keep: str) -> DataFrame:
    """(keep..., token): one row for each token; filtered after the explode, where the expressions are compiled."""
    rows = docs.select(*keep, F.explode(raw_tokens(F.col(text))).alias("_raw")).select(*keep, F.lower("_raw").alias("token"))
    return rows.where(keep_token(F.col("token")))


def lines_of(files: DataFrame, content: str = "content", *keep: str) -> DataFrame:
    """(keep..., line_no, line): lines numbered from 1; a last line end makes no further line."""
    text = F.regexp_replace(F.col(content), r"\r?\n$", "")
    rows = files.where(F.col(content).isNotNull() & (F.col(content) != ""))
    return rows.select(*keep, F.posexplode(F.split(text, r"\r?\n", -1)).alias("_at", "line")).select(
        *keep, (F.col("_at") + 1).alias("line_no"), "line"
    )


def bounded(identifier: str) -> str:
    """A pattern for the identifier where no letter, digit or underscore of ASCII adjoins."""
    return r"(?<![A-Za-z0-9_])" + re.escape(identifier) + r"(?![A-Za-z0-9_])"


@F.pandas_udf(ArrayType(LongType()))
def standing(line: pd.Series, word: pd.Series) -> pd.Series:
    """The columns, from 1, where word stands by itself in line: one pass, however many there are."""
    known = {w: re.compile(rf"(?<![A-Za-z0-9_]){re.escape(w)}(?![A-Za-z0-9_])") for w in word.unique()}
    return pd.Series([[m.start() + 1 for m in known[w].finditer(t)] for t, w in zip(line, word, strict=True)])


def first_is_bounded(line: Column, identifier: Column) -> Column:
    """Whether the first occurrence of identifier in line stands alone; later ones are not looked at."""
    at = F.instr(line, identifier)
    before = F.substr(line, at - 1, F.when(at > 1, F.lit(1)).otherwise(F.lit(0)))
    after = F.substr(line, at + F.length(identifier), F.lit(1))
    alone = lambda c: ~c.rlike("^[A-Za-z0-9_]$")
    return (at > 0) & alone(before) & alone(after)


def _phrase(line: Column, phrases: tuple, ends: str, most: int, any_case: bool, trim: str = "") -> Column:
    """What follows the first phrase, in their order, that gives something: to one of ends, else `most` characters."""
    flag = "(?i)" if any_case else ""
    found = []
    for p in phrases:
        rest = F.regexp_extract(line, f"{flag}{re.escape(p)}(.*)$", 1)
        cut = F.when(rest.rlike(f"[{ends}]"), F.regexp_extract(rest, f"^([^{ends}]*)", 1)).otherwise(F.substring(rest, 1, most))
        value = F.trim(cut)
        if trim:
            value = F.regexp_replace(value, trim, "")
        found.append(F.when(F.octet_length(value).between(1, 99), value))
    return F.coalesce(*found)


def replacement(line: Column) -> Column:
    return _phrase(line, REPLACEMENT_PHRASES, "\\n)\"'", 80, True, "[.,;]+$")


def since(line: Column) -> Column:
    return _phrase(line, SINCE_PHRASES, '"), \\n', 30, False)


def remove_after(line: Column) -> Column:
    stripped = F.regexp_replace(line, r"(?i)(remove[- _]after:)\s+", "$1")
    return _phrase(stripped, REMOVE_PHRASES, ')\\n,"', 30, True)


def deprecation_marker(line: Column) -> Column:
    """annotation, todo, comment or runtime-warn, the first that fits; else null."""
    t, low = F.trim(line), F.lower(F.trim(line))
    has = lambda c, *parts: c.rlike("|".join(map(re.escape, parts)))
    return (
        F.when(has(low, "@deprecated", "#[deprecated"), "annotation")
        .when(has(low, "todo(deprecate", "todo(remove", "todo: deprecate", "todo: remove"), "todo")
        .when(low.rlike("^(// deprecated|# deprecated|/\\* deprecated|deprecated:)") | t.contains("DEPRECATED:"), "comment")
        .when(low.contains("deprecationwarning"), "runtime-warn")
    )


def deprecation_severity(line: Column) -> Column:
    t = F.trim(line)
    return F.when(remove_after(t).isNotNull(), "critical").when(since(t).isNotNull() | replacement(t).isNotNull(), "warning").otherwise("info")


def breaking_kind(subject: Column, body: Column) -> Column:
    """How a commit says that it breaks something, the first sign that fits; else null."""
    low = F.lower(subject)
    out = F.when(subject.contains("BREAKING CHANGE") | F.coalesce(body, F.lit("")).contains("BREAKING CHANGE"), "breaking_change_footer")
    out = out.when(subject.rlike("(^| )(" + "|".join(map(re.escape, CONVENTIONAL)) + ")"), "conventional_breaking")
    for word, kind in MIGRATION_WORDS:
        out = out.when(low.contains(word), kind)
    return out


def is_breaking_subject(subject: Column) -> Column:
    """The shorter test that the report of unreleased commits uses."""
    return subject.contains("BREAKING CHANGE") | subject.rlike("^(feat|fix|refactor|perf)!| (feat|fix)!")


def naming_style(stem: Column) -> Column:
    return (
        F.when(stem.contains("-"), "kebab")
        .when(stem.contains("_"), "snake")
        .when(stem.rlike("^[a-z]") & stem.rlike("[A-Z]"), "camel")
        .when(stem != "", "snake")
    )


def version_numbers(version: Column) -> Column:
    """The numeric parts of a version as integers, for ordering: parts that are no numbers are left out."""
    parts = F.split(F.regexp_replace(version, "^v+", ""), "[.-]")
    return F.transform(F.filter(parts, lambda p: p.rlike("^[0-9]+$")), lambda p: p.cast("bigint"))


def is_semver(version: Column) -> Column:
    return version.rlike(r"^v*[0-9]+([-+][^.]*)?(\.[0-9]+([-+][^.]*)?){1,3}$")


def path_similarity(a: Column, b: Column) -> Column:
    """0.9 for equal stems; else the Jaccard index of the stems' parts, 0.2 more in the same folder (1 at most)."""
    from . import paths

    sa, sb = F.lower(paths.stem(a)), F.lower(paths.stem(b))
    pa, pb = F.array_distinct(F.split(sa, "[_-]", -1)), F.array_distinct(F.split(sb, "[_-]", -1))
    jaccard = F.size(F.array_intersect(pa, pb)) / F.size(F.array_union(pa, pb))
    near = F.when(paths.folder(a) == paths.folder(b), F.least(jaccard + 0.2, F.lit(1.0))).otherwise(jaccard)
    return F.when((sa == "") | (sb == ""), 0.0).when(sa == sb, 0.9).otherwise(near)
