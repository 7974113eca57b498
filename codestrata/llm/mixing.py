"""Mixing sources to target weights: hierarchical token budgets over a tree of domain, language and source.

The budget of the root is dealt to its children by their weights, and so on down to the leaves. A node never gets
more than its capacity, the tokens of its documents times the allowed epochs. What a node can't use goes to its
siblings by their weights, until they are full too; only then is it left to the parent's siblings. A leaf takes
every document once for each whole epoch in its budget, and of one more epoch a prefix, in an order that the seed
and the number of the epoch fix, as long as the budget holds whole documents.

DataFrame functions only. A leaf's prefix is found as one key, the largest that is taken, without bringing the leaf
together: tokens are summed by bins, the leading digits of the keys; the rows of the one bin into which the budget's
end falls are put in order. Each row is then taken or left by its own key. The number of bins grows with the root of
the number of rows, 4096 in a leaf at least. The key is a hash of the id and of the text, so rows that share an id,
null ids too, are spread like any others; rows equal in both have equal keys and are taken or left together.

Cases: null names are "", null texts empty; texts without a word are taken as often as their leaf has whole epochs, and
once more inside a prefix; texts of any length count whole; repeated rows are documents of their own with one key;
other columns are not looked at, whatever their names (those in keep are passed on); an empty table gives an empty
result.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codestrata.plans.adapters import texts

from . import shared

LEVELS = ("domain", "lang", "source")
SEED = 17
MAX_EPOCHS = 2
#: Target weights by level and name; other names weigh 1.
WEIGHTS = {"domain": {"d0": 3, "d1": 2}, "lang": {"en": 4, "de": 2, "fr": 2}, "source": {"src0": 2}}
#: The budget as a share of all tokens.
BUDGET_SHARE = 0.8
#: Hex digits of the order key that make a bin, at least: 16**3 bins in a leaf.
BIN_DIGITS = 3


def domain_of(source: Column) -> Column:
    """The domain of a source in these tables, which have none: four, by a hash of the name."""
    digit = F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(source.cast("binary")), 1, 1)) - 1
    return F.concat(F.lit("d"), (digit % 4).cast("string"))


def _weight(level: str, weights: Mapping) -> Column:
    out = F.lit(1)
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, F.lit(int(w))).otherwise(out)
    return out.cast("long")


def pour(nodes: DataFrame, parent: list[str], order: list[str]) -> DataFrame:
    """nodes with budget: the parent's amount, dealt by weight under capacities; nothing a sibling can use is lost.

    nodes: columns amount (the parent's), weight (positive) and capacity. In order of capacity / weight the nodes
    that fill up are a prefix; the first that does not fill up sets the level per weight for itself and the rest.
    """
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    ranked = by.orderBy(F.col("capacity") / F.col("weight"), *order)
    before = ranked.rowsBetween(Window.unboundedPreceding, -1)
    whole = ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = nodes.select(
        "*",
        F.sum("weight").over(by).alias("_all"),
        F.coalesce(F.sum("capacity").over(before), F.lit(0)).alias("_full"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("_used"),
    )
    level = (F.col("amount") - F.col("_full")) / (F.col("_all") - F.col("_used"))
    leveled = sums.withColumn("_level", F.when(F.col("capacity") >= F.col("weight") * level, level))
    share = F.floor(F.col("weight") * F.first("_level", ignorenulls=True).over(whole))
    return leveled.withColumn("budget", F.least("capacity", F.coalesce(share, F.col("capacity")))).drop(
        "_all", "_full", "_used", "_level"
    )


def leaf_budgets(
    leaves: DataFrame,
    levels: tuple = LEVELS,
    weights: Mapping = WEIGHTS,
    share: float = BUDGET_SHARE,
    max_epochs: int = MAX_EPOCHS,
) -> DataFrame:
    """leaves (the levels and tokens) with budget, from the root down. The tree is as large as the list of sources."""
    capacity = F.col("tokens") * max_epochs
    dealt = None
    for depth in range(1, len(levels) + 1):
        path, above = list(levels[:depth]), list(levels[: depth - 1])
        nodes = leaves.groupBy(*path).agg(F.sum(capacity).alias("capacity"), F.sum("tokens").alias("tokens"))
        nodes = nodes.withColumn("weight", _weight(levels[depth - 1], weights))
        if dealt is None:
            every = Window.partitionBy(F.lit(0))  # the few nodes of the first level
            nodes = nodes.withColumn("amount", F.floor(F.sum("tokens").over(every) * F.lit(share)))
        else:
            nodes = nodes.join(dealt.select(*above, F.col("budget").alias("amount")), above)
        dealt = pour(nodes, above, path)
    return dealt.select(*levels, "tokens", "budget")


def _named(docs: DataFrame, domain: Column | None) -> dict[str, Column]:
    """The names of a row's leaf by level."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in docs.columns else F.lit("")
    return {"domain": F.coalesce(domain, F.lit("")) if domain is not None else domain_of(name("source")), "lang": name("lang"), "source": name("source")}


def measure(docs: DataFrame, domain: Column | None = None, keep: tuple = ()) -> DataFrame:
    """(doc_id, domain, lang, source, tokens, digest) and the columns keep of each row; tokens are words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        "doc_id",
        *[c.alias(k) for k, c in _named(docs, domain).items()],
        F.regexp_count(text, F.lit(shared.WORD_CLASS + "+")).cast("long").alias("tokens"),
        F.md5(text.cast("binary")).alias("digest"),
        *keep,
    )


def order_key(seed: int) -> Column:
    """A row's place in its leaf's last epoch, from doc_id, digest and the number of that epoch."""
    name = F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "digest")
    return F.md5(name.cast("binary"))


def _end(parts: DataFrame, leaf: list[str], by: str) -> DataFrame:
    """(leaf..., by, before): the part of each leaf (by, tokens) into which the end of its rest falls, and the tokens before it."""
    upto = F.col("before") + F.sum("tokens").over(Window.partitionBy(*leaf).orderBy(by).rowsBetween(Window.unboundedPreceding, 0))
    over = parts.withColumn("upto", upto).where("upto > rest")
    ends = over.groupBy(*leaf).agg(F.min(F.struct(by, (F.col("upto") - F.col("tokens")).alias("before"))).alias("e"))
    return ends.select(*leaf, "e.*")


def prefixes(measured: DataFrame, weights: Mapping, share: float, max_epochs: int, seed: int) -> DataFrame:
    """(domain, lang, source, epochs, last): how often a leaf takes each row, and the last key that it takes once more."""
    leaf = list(LEVELS)
    sums = measured.groupBy(*leaf).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    budgets = leaf_budgets(shared.stash(sums, "mixing-leaves"), LEVELS, weights, share, max_epochs)
    some = F.col("tokens") > 0
    plan = budgets.select(
        *leaf,
        F.when(some, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("long").alias("epochs"),
        F.when(some, F.col("budget") % F.col("tokens")).otherwise(0).cast("long").alias("rest"),
    )
    plan = shared.stash(plan, "mixing-plan")
    digits = max(BIN_DIGITS, math.ceil(math.log(max(measured.count(), 1), 16) / 2))
    keyed = measured.join(plan.where("rest > 0"), leaf).select(*leaf, "rest", "tokens", order_key(seed).alias("key"))
    keyed = keyed.withColumn("bin", F.substring("key", 1, digits))
    # the first bin that the budget doesn't hold whole: found among the bins' leading digits, then among those with these
    bins = keyed.groupBy(*leaf, "rest", "bin").agg(F.sum("tokens").alias("tokens"))
    bins = shared.stash(bins.withColumn("lead", F.substring("bin", 1, digits // 2)), "mixing-bins")
    leads = bins.groupBy(*leaf, "rest", "lead").agg(F.sum("tokens").alias("tokens")).withColumn("before", F.lit(0).cast("long"))
    inner = _end(leads, leaf, "lead").select(*leaf, "lead", "before")
    ends = shared.stash(_end(bins.join(inner, [*leaf, "lead"]), leaf, "bin"), "mixing-ends")
    # the rows of that bin by key, equal keys together; the bin's own digits sort before all its keys
    by_key = Window.partitionBy(*leaf, "bin").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    last = keyed.join(ends, [*leaf, "bin"]).groupBy(*leaf, "bin", "before", "rest", "key").agg(F.sum("tokens").alias("tokens"))
    last = last.withColumn("upto", F.col("before") + F.sum("tokens").over(by_key)).where("upto <= rest").groupBy(*leaf).agg(F.max("key").alias("key"))
    found = plan.join(ends, leaf, "left").join(last, leaf, "left")
    return shared.stash(found.select(*leaf, "epochs", F.coalesce("key", "bin", F.lit("")).alias("last")), "mixing-prefixes")


def mix(
    docs: DataFrame,
    weights: Mapping = WEIGHTS,
    share: float = BUDGET_SHARE,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
    domain: Column | None = None,
    keep: tuple = (),
) -> DataFrame:
    """A row per row of docs: doc_id, domain, lang, source, tokens, copies (long, 0: left out) and the columns keep."""
    measured = shared.stash(measure(docs, domain), "mixing")
    found = prefixes(measured, weights, share, max_epochs, seed)
    rows = measure(docs, domain, keep) if keep else measured  # kept columns are read again, not written
    copies = F.col("epochs") + F.when(order_key(seed) <= F.col("last"), 1).otherwise(0)
    return rows.join(found, list(LEVELS)).select("doc_id", *LEVELS, "tokens", copies.alias("copies"), *keep)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(texts(spark, sf_dir, "doc_id", "text", "lang", "source"))


def _sql_weight(level: str) -> str:
    cases = "".join(f" WHEN '{n}' THEN {w}" for n, w in WEIGHTS[level].items())
    return f"CAST(CASE {level}{cases} ELSE 1 END AS BIGINT)"


def _sql_level(depth: int, amount: str) -> str:
    """DuckDB: one level of the tree dealt by trying every number of full siblings, apart from the DataFrame's way."""
    path, above = ", ".join(LEVELS[:depth]), ", ".join(LEVELS[: depth - 1])
    part = f"PARTITION BY {above}" if above else ""
    order = f"ORDER BY capacity / weight, {path}"
    return f"""
n{depth} AS (SELECT {path}, sum(tokens) * {MAX_EPOCHS} AS capacity, sum(tokens) AS tokens, {_sql_weight(LEVELS[depth - 1])} AS weight
  FROM leaf GROUP BY {path}),
r{depth} AS (SELECT n.*, {amount} AS amount, row_number() OVER ({part} {order}) AS k,
    coalesce(sum(capacity) OVER ({part} {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done,
    sum(weight) OVER ({part} {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS todo
  FROM n{depth} n {f"JOIN b{depth - 1} USING ({above})" if above else ""}),
l{depth} AS (SELECT {above + ", " if above else ""} min_by(CAST(amount - done AS DOUBLE) / todo, k) AS level FROM r{depth}
  WHERE capacity >= weight * (CAST(amount - done AS DOUBLE) / todo) {f"GROUP BY {above}" if above else ""}),
b{depth} AS (SELECT {path}, tokens, least(capacity, CAST(coalesce(floor(weight * level), capacity) AS BIGINT)) AS budget
  FROM r{depth} LEFT JOIN l{depth} {f"USING ({above})" if above else "ON true"})"""


OP1_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
    'd' || (instr('0123456789abcdef', substr(md5(coalesce(source, '')), 1, 1)) - 1) % 4 AS domain,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS tokens, md5(coalesce(text, '')) AS digest FROM documents
), leaf AS (SELECT domain, lang, source, sum(tokens) AS tokens FROM d GROUP BY ALL),
total AS (SELECT floor(sum(tokens) * CAST({BUDGET_SHARE} AS DOUBLE)) AS t FROM leaf),
{_sql_level(1, "(SELECT t FROM total)")},
{_sql_level(2, "b1.budget")},
{_sql_level(3, "b2.budget")},
p AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS epochs,
  CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest FROM b3)
SELECT doc_id, domain, lang, source, tokens, CAST(epochs + CASE WHEN rest > 0 AND
    sum(tokens) OVER (PARTITION BY domain, lang, source
      ORDER BY md5('{SEED}:' || epochs || ':' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || digest) RANGE UNBOUNDED PRECEDING) <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM d JOIN p USING (domain, lang, source)
"""
