"""Derived facts and their ageing: confidence, time to live, verdicts on features, stale sections, reuse categories."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.functions import paths
from codestrata.operators.search import checked

# Ageing factors, lifetimes, weights and rules that results depend on.
DECAY = ((7, 1.0), (30, 0.95), (90, 0.85), (180, 0.70))
OLDEST, EXPIRES_BELOW = 0.50, 0.5
TTL_DAYS = {"pattern": 30, "fact": 14, "rule": 60, "risk": 30, "feature": 7, "reuse_item": 30}
PATTERN_WEIGHTS = {
    "five_uses": 0.3, "ten_uses": 0.5, "in_tests_too": 0.2, "comment": 0.2, "documented": 0.2, "recent": 0.1,
    "no_variants": 0.2, "variants": -0.3, "one_or_two_uses": -0.4, "old_only": -0.2, "conflict": -0.3,
}
FEATURE_WEIGHTS = {
    "terms": 0.3, "sibling_test": 0.2, "branch": 0.2, "recent_spec": 0.1, "old": -0.2, "generic": -0.3, "partial": -0.2,
}
CONFIDENT = 0.7
SECTION_RULES = (
    ("*go.mod|*package.json|*composer.json|*pyproject.toml|*Cargo.toml|*Gemfile|*pubspec.yaml|*.csproj", ("01-topology/stacks",)),
    ("Dockerfile|*/Dockerfile|docker-compose.*|.github/workflows/*|.gitlab-ci.yml|.circleci/config.yml|Makefile|*/Makefile", ("01-topology/deployments",)),
    ("*.tf|*.tofu", ("01-topology/stacks", "01-topology/deployments")),
    ("docs/*|specs/*|requirements/*|rfcs/*|README.md|CHANGELOG.md|*.md", ("09-features",)),
    ("*_test.go|*test_*.py|*.test.ts|*.test.tsx|*.spec.ts|*.spec.tsx|*.test.js|*Test.php|*Tests.php|tests/*|test/*|spec/*|__tests__/*", ("02-conventions/testing", "05-risks/untested")),
    ("src/*|cmd/*|internal/*|pkg/*|lib/*|app/*|*.go|*.ts|*.tsx|*.js|*.py|*.php|*.rs|*.java|*.kt|*.swift", ("01-topology/activity", "02-conventions/naming", "02-conventions/errors", "02-conventions/logging")),
    ("pkg/*|lib/*|utils/*|helpers/*|shared/*|*/pkg/*|*/lib/*|*/utils/*|*/helpers/*|*/shared/*", ("03-reuse",)),
    ("*/components/*|components/*|*/hooks/*|hooks/*", ("03-reuse",)),
    ("*/models/*|models/*|*/entities/*|entities/*|*/domain/*|domain/*", ("04-domain/entities",)),
)
CATEGORIES = (
    ("validation", "valid|check"), ("logging", "log|audit"), ("auth", "auth|jwt|token|permission"),
    ("http_client", "client|request|fetch|api"), ("persistence", "repository|dao|query|db"),
    ("format", "format|parse|convert|to_"), ("testing_helper", "factory|builder|mock|stub"),
    ("crypto", "hash|encrypt|decrypt|sign"), ("ui_component", "component|view|layout"), ("hook", "^use"),
)


def decay(age_days: Column) -> Column:
    """The factor of a fact's confidence at an age in days."""
    out = F.when(age_days < DECAY[0][0], DECAY[0][1])
    for days, factor in DECAY[1:]:
        out = out.when(age_days <= days, factor)
    return out.otherwise(OLDEST)


def aged(findings: DataFrame) -> DataFrame:
    """findings (initial, age_days, ...) with current and expired."""
    return findings.withColumn("current", F.col("initial") * decay(F.col("age_days"))).withColumn("expired", F.col("current") < EXPIRES_BELOW)


def ttl_days(kind: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in TTL_DAYS.items() for x in kv])[kind]


def confidence(signals: Mapping[str, Column], weights: Mapping[str, float] = PATTERN_WEIGHTS) -> Column:
    """The sum of the weights of the signals that hold, between 0 and 1."""
    total = F.lit(0.0)
    for name, holds in signals.items():
        total = total + F.when(holds, weights[name]).otherwise(0.0)
    return F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))


def verdict(presence: Column, has_tests: Column, branch: Column, pr_open: Column, complete_doc: Column, failed: Column, asserts: Column) -> Column:
    """The state of a feature: presence none, partial or complete; branch none, active or obsolete."""
    drifted = (asserts > 0) & (failed >= 0.3 * asserts)
    return (
        F.when((presence == "complete") & has_tests & drifted, "DRIFTED")
        .when((presence == "complete") & has_tests, "IMPLEMENTED")
        .when((presence == "partial") & (branch == "obsolete") & ~pr_open, "ABANDONED")
        .when((presence != "none") | (branch == "active") | pr_open, "IN_PROGRESS")
        .when(complete_doc, "SPEC_ONLY")
        .otherwise("NOT_STARTED")
    )


def breakdown(verdicts: DataFrame, verdict: str = "verdict") -> DataFrame:
    """(verdict, features): how many features are in each state."""
    return verdicts.groupBy(F.col(verdict).alias("verdict")).agg(F.count("*").alias("features"))


def section_metrics(findings: DataFrame, *by: str) -> DataFrame:
    """(by..., findings, active, superseded, expired, avg_initial, avg_current) of aged() findings with superseded (boolean).

    Active findings are neither superseded nor expired; a superseded one doesn't count as expired.
    """
    gone = F.coalesce(F.col("superseded"), F.lit(False))
    return findings.groupBy(*by).agg(
        F.count("*").alias("findings"),
        F.count_if(~gone & ~F.col("expired")).alias("active"),
        F.count_if(gone).alias("superseded"),
        F.count_if(~gone & F.col("expired")).alias("expired"),
        F.avg("initial").alias("avg_initial"),
        F.avg("current").alias("avg_current"),
    )


def phantom_features(implemented: DataFrame, open_items: DataFrame, *key: str) -> DataFrame:
    """The open items of a tracker whose feature (the columns key) the code has: done, but still listed as open."""
    asked = checked(open_items.select(*key).distinct())  # only features of open items are told apart
    return open_items.join(implemented.select(*key).join(asked, list(key), "left_semi").distinct(), list(key), "left_semi")


def duplicate_specs(specs: DataFrame, least: float = 0.7, key: str = "item_id", terms: str = "terms") -> DataFrame:
    """(item_a, item_b, shared, overlap), item_a < item_b: specs (key, terms, an array) of which more than `least` of the
    smaller one's distinct terms are the other's. Specs meet by the terms that they share."""
    each = specs.select(F.col(key).alias("item"), F.array_distinct(terms).alias("t")).select("item", F.size("t").alias("n"), F.explode("t").alias("term"))
    a, b = (each.select(F.col("item").alias(f"item_{s}"), F.col("n").alias(f"n_{s}"), "term") for s in "ab")
    both = a.join(b, "term").where("item_a < item_b").groupBy("item_a", "item_b", "n_a", "n_b").agg(F.count("*").alias("shared"))
    overlap = F.col("shared") / F.least("n_a", "n_b")
    return both.where(overlap > least).select("item_a", "item_b", "shared", overlap.alias("overlap"))


def risk(files: DataFrame, fragile: DataFrame, untested: DataFrame, debt: DataFrame, zones: DataFrame, owners: DataFrame, drifted: DataFrame) -> DataFrame:
    """(path, fragile, untested, debt, zone, owner, clear_owner, drifted, signals) for every path of files.

    fragile: (path, score); untested: (path); debt: (path, todo, fixme, hack, xxx, disabled); zones: (path, zone);
    owners: as activity.ownership or activity.owners gives them; drifted: (path), a row per drifted feature. Each has a path once but
    owners and drifted. signals: how many of the six speak of a risk.
    """
    marks = sum((F.coalesce(F.col(c), F.lit(0)) for c in ("todo", "fixme", "hack", "xxx", "disabled")), F.lit(0))
    parts = [
        fragile.select("path", F.col("score").alias("fragile")),
        untested.select("path").distinct().withColumn("untested", F.lit(True)),
        debt.select("path", marks.cast("long").alias("debt")),
        zones.select("path", "zone"),
        owners.where("rank = 1").select("path", F.col("author").alias("owner"), "clear_owner"),
        drifted.groupBy("path").agg(F.count("*").alias("drifted")),
    ]
    out = files.select("path").distinct()
    for part in parts:
        out = out.join(part, "path", "left")
    out = out.fillna(0.0, ["fragile"]).fillna(False, ["untested"]).fillna(0, ["debt", "drifted"])
    signs = [F.col("fragile") > 0, F.col("untested"), F.col("debt") > 0, F.coalesce(F.col("zone") == "hot", F.lit(False)), ~F.coalesce("clear_owner", F.lit(False)), F.col("drifted") > 0]
    return out.withColumn("signals", sum((s.cast("int") for s in signs), F.lit(0)))


def sections(path: Column) -> Column:
    """The distinct sections that a changed path makes stale, as an array; the rules are a fixed table."""
    hit = [F.when(path.rlike(paths.glob_regex(glob)), F.array(*map(F.lit, names))) for glob, names in SECTION_RULES]
    return F.array_distinct(F.flatten(F.array_compact(F.array(*hit))))


def stale_sections(changed: DataFrame, path: str = "path") -> DataFrame:
    """(path, section): the sections that changed paths make stale."""
    return changed.select(F.col(path).alias("path"), F.explode(sections(F.col(path))).alias("section"))


def category(name: Column) -> Column:
    """The first reuse category whose words a symbol's name holds, else other."""
    low = F.lower(name)
    out = F.when(low.rlike(CATEGORIES[0][1]), CATEGORIES[0][0])
    for label, words in CATEGORIES[1:]:
        out = out.when(low.rlike(words), label)
    return out.otherwise("other")


def stale_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) between two snapshots of (path, hash): added, removed, changed."""
    both = old.select("path", F.col("hash").alias("a")).join(new.select("path", F.col("hash").alias("b")), "path", "full_outer")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return both.select("path", change.alias("change")).where("change is not null")


def plan_against_actual(planned: DataFrame, actual: DataFrame, tolerated: int = 3) -> DataFrame:
    """(done, missed, unplanned, verdict) of two lists of paths; over `tolerated` unplanned ones diverge."""
    a, b = planned.select("path").distinct().withColumn("p", F.lit(1)), actual.select("path").distinct().withColumn("a", F.lit(1))
    counted = a.join(b, "path", "full_outer").agg(
        F.count_if(F.col("p").isNotNull() & F.col("a").isNotNull()).alias("done"),
        F.count_if(F.col("a").isNull()).alias("missed"),
        F.count_if(F.col("p").isNull()).alias("unplanned"),
    )
    return counted.withColumn("verdict", F.when(F.col("unplanned") > tolerated, "DIVERGED").when(F.col("missed") > 0, "INCOMPLETE").otherwise("MATCHES"))
