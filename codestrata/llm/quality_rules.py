"""Quality rules whose cutoffs are risk-controlled: exact binomial bounds on labelled holdouts limit false rejection.

Each rule rejects a document whose metric lies above a cutoff. The cutoffs of all rules come from a ladder that is
fixed beforehand: step by step every rule becomes stricter, so what one step rejects all later steps reject. For each
stratum (language) the steps are tested in this order: the hypothesis "the rules of this step together reject more
than the share alpha of good documents" is refuted if the exact binomial probability of so few rejected good labels
is at most delta over the number of strata. The tests end at the first step that is not refuted. As the order is
fixed, no correction for the number of steps or rules is needed (fixed-sequence testing); Bonferroni covers the strata.
So with probability 1 - delta every stratum rejects at most alpha of its good documents, whichever refuted step is
taken. Taken is the one that rejects the most bad labels less good ones, the most lenient of equals; where no step
rejects more bad than good ones, no cutoff is set. At alpha = delta = 0.05 and five strata a stratum needs 90 good
labels, none of them rejected, or 200 with three rejected; one with fewer gets no cutoff, and the rules reject nothing
there.

Built of DataFrame functions only. Words and repeated windows are found inside the row, so nothing of a text is
shuffled; of labelled documents (id, step) is, then counts by stratum and step.

Cases: null texts have no words; texts of any length are measured whole; other columns, whatever their names, are not
looked at; repeated rows are judged each, but a document counts as one label; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.plans.adapters import texts

from . import shared

#: Strata: these languages; all others, null too, together. The bound on the size of what is broadcast.
LANGUAGES = ("en", "fr", "de", "es")
#: Share of good documents that may be rejected in a stratum, and the probability that this fails anywhere.
ALPHA, DELTA = 0.05, 0.05
#: For each rule, the metric and its cutoffs from the strictest step to the most lenient, fixed before any data are seen.
STEPS = 25
GRID = {
    "symbols_per_word": [0.02 * 1.25**i for i in range(STEPS)],
    "exclamations_per_word": [0.02 * 1.25**i for i in range(STEPS)],
    "duplicate_line_share": [0.04 * (i + 1) for i in range(STEPS)],
    "repeated_word_share": [0.012 * (i + 1) for i in range(STEPS)],
    "mean_word_length": [6.0 + 0.5 * i for i in range(STEPS)],
}
WINDOW = 8
SYMBOLS = "#*$%&|<>"


def repeated_words(hashes: Column, window: int = WINDOW) -> Column:
    """How many words lie in a window of so many words that occurs twice or more (long).

    hashes: array of word hashes. Windows are compared by 64-bit hashes. Linear but for a sort of the windows,
    which only rows with a repeated window reach.
    """
    n = F.size(hashes)
    windows = F.transform(F.sequence(F.lit(1), n - (window - 1)), lambda i: F.xxhash64(F.slice(hashes, i, window)))

    def covered(w: Column) -> Column:
        ranked = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            m = F.size(s)
            pairs = F.zip_with(
                F.slice(s, F.lit(1), m - 1),
                F.slice(s, F.lit(2), m - 1),
                lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])),
            )
            return F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))

        def total(p: Column) -> Column:
            m = F.size(p)
            gaps = F.zip_with(
                F.slice(p, F.lit(1), m - 1), F.slice(p, F.lit(2), m - 1), lambda a, b: F.least(b - a, F.lit(window))
            )
            return F.aggregate(gaps, F.lit(window), lambda acc, g: acc + g)

        return shared.let(shared.let(ranked, places), total)

    repeats = shared.let(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(0))
    return F.when(n <= window, F.lit(0)).otherwise(repeats).cast("long")


def metrics(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", keep: tuple = ()) -> DataFrame:
    """One row per row of docs: doc_id, stratum, the counts of the base rules, the metrics of the learned ones, and the
    columns keep, named otherwise than these."""
    lang = F.col(lang_col) if lang_col in docs.columns else F.lit(None).cast("string")
    base = docs.select(
        "doc_id",
        *keep,
        F.when(lang.isin(*LANGUAGES), lang).otherwise("other").alias("stratum"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"),
    )
    ws = F.lit(shared.WS_CHARS)
    split = base.select(
        "doc_id",
        *keep,
        "stratum",
        "t",
        F.transform(shared.words(F.col("t")), lambda w: F.xxhash64(w)).alias("wh"),
        F.transform(
            F.filter(F.split("t", "\n"), lambda x: F.length(F.trim(x, ws)) > 0), lambda x: F.xxhash64(x)
        ).alias("lh"),
    )
    counted = split.select(
        "doc_id",
        *keep,
        "stratum",
        F.size("wh").cast("long").alias("n_words"),
        F.length(shared.without_chars(F.col("t"), shared.WS_CHARS)).cast("long").alias("word_chars"),
        shared.count_chars(F.col("t"), SYMBOLS).alias("n_symbols"),
        shared.count_chars(F.col("t"), "!").alias("n_bang"),
        F.size("lh").cast("long").alias("n_lines"),
        (F.size("lh") - F.size(F.array_distinct("lh"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("wh")).alias("n_repeat_words"),
    )
    per_word = lambda c: F.col(c) / F.greatest(F.col("n_words"), F.lit(1))
    return counted.select(
        "doc_id",
        *keep,
        "stratum",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
        per_word("n_symbols").alias("symbols_per_word"),
        per_word("n_bang").alias("exclamations_per_word"),
        (F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("duplicate_line_share"),
        per_word("n_repeat_words").alias("repeated_word_share"),
        per_word("word_chars").alias("mean_word_length"),
    )


def _log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1 (Stirling's series after a shift by 8; its error is below 1e-13)."""
    shift = F.lit(0.0)
    for i in range(8):
        shift = shift + F.ln(x + i)
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return (y - 0.5) * F.ln(y) - y + 0.9189385332046727 + series - shift


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, by the modified Lentz method."""
    tiny = F.lit(1e-300)
    safe = lambda v: F.when(F.abs(v) < tiny, tiny).otherwise(v)
    first = 1 / safe(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))

    def step(s: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        half = lambda t, k: F.struct(
            safe(1 + k / t["c"]).alias("c"), (1 / safe(1 + k * t["d"])).alias("d"), t["h"].alias("h")
        )
        grown = lambda t: F.struct(t["c"].alias("c"), t["d"].alias("d"), (t["h"] * t["c"] * t["d"]).alias("h"))
        return shared.let(shared.let(half(s, even), grown), lambda t: shared.let(half(t, odd), grown))

    rounds = (100 + 3 * F.sqrt(a + b)).cast("int")
    return F.aggregate(F.transform(F.sequence(F.lit(1), rounds), lambda i: i.cast("double")), start, step)["h"]


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), 0 < p < 1: the regularised incomplete beta function I_{1-p}(n - k, k + 1)."""
    a, b, x = (n - k).cast("double"), (k + 1).cast("double"), F.lit(1.0 - p)
    front = F.exp(_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * F.ln(x) + b * F.ln(F.lit(p)))
    low = front * _fraction(a, b, x) / a
    high = 1 - front * _fraction(b, a, 1 - x) / b
    return F.when(k >= n, F.lit(1.0)).when(x < (a + 1) / (a + b + 2), low).otherwise(high)


def thresholds(
    measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, grid: dict | None = None
) -> DataFrame:
    """Rows (stratum, rule, cutoff, n_good, n_rejected, n_caught, p_value), one for each rule of a stratum with cutoffs.

    n_good: the good labels of the stratum; n_rejected and n_caught: the good and the bad labels that all its rules
    together reject. grid: for each rule equally many cutoffs, from the strictest. labels: (doc_id, quality). A
    document counts once, in the least of its strata and by its worst row, however often it or its label is repeated;
    with conflicting labels it is bad. Null labels, labels of unknown documents and documents that fail the base rules
    don't count.
    """
    grid = grid or GRID
    steps = len(next(iter(grid.values())))
    marked = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("_q"))

    # how many of its rule's cutoffs a metric exceeds, by the worst rule: the step i rejects a document with more than i
    def exceeded(rule: str, cuts: list) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: F.col(rule) > c))

    worst = F.greatest(*[exceeded(r, c) for r, c in grid.items()]) if len(grid) > 1 else exceeded(*next(iter(grid.items())))
    counted = (
        measured.where(~F.col("base_failed"))
        .select("doc_id", "stratum", worst.alias("worst"))
        .join(marked, "doc_id")
        .groupBy("doc_id")
        .agg(F.min("stratum").alias("stratum"), F.max("worst").alias("worst"), F.min("_q").alias("q"))
        .groupBy("stratum", "worst")
        .agg(F.count_if(F.col("q") == 1).alias("good"), F.count_if(F.col("q") != 1).alias("bad"))
        .groupBy("stratum")
        .agg(F.sum("good").alias("n_good"), F.collect_list(F.struct("worst", "good", "bad")).alias("at"))  # steps + 1 rows at most
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    )
    above = lambda what: F.aggregate("at", F.lit(0).cast("long"), lambda acc, x: acc + F.when(x["worst"] > F.col("i"), x[what]).otherwise(0))
    # what a step rejects the next ones reject, so that the steps before the first failure are just those below the level
    tested = counted.select("stratum", "n_good", "i", above("good").alias("n_rejected"), above("bad").alias("n_caught"))
    tested = shared.stash(tested.where("n_caught > n_rejected"), "steps")  # a row per stratum and step at most
    tails = tested.select("n_good", "n_rejected").distinct().withColumn("p_value", binomial_tail(F.col("n_good"), F.col("n_rejected"), alpha))
    tested = tested.join(tails, ["n_good", "n_rejected"])  # equal counts have one tail
    best = (
        tested.where(F.col("p_value") <= delta / (len(LANGUAGES) + 1))
        .groupBy("stratum")
        .agg(F.max_by(F.struct("i", "n_good", "n_rejected", "n_caught", "p_value"), F.struct(F.col("n_caught") - F.col("n_rejected"), "i")).alias("x"))
    )
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.array(*map(F.lit, c)).alias("cuts")) for r, c in grid.items()])
    return best.withColumn("r", F.explode(rules)).select(
        "stratum", "r.rule", F.element_at("r.cuts", F.col("x.i") + 1).alias("cutoff"), "x.n_good", "x.n_rejected", "x.n_caught", "x.p_value"
    )


def judge(measured: DataFrame, cutoffs: DataFrame, grid: dict | None = None) -> DataFrame:
    """measured with kept (boolean) and failed_rules (array of rule names); cutoffs has a row per stratum and rule."""
    grid = grid or GRID
    per = cutoffs.groupBy("stratum").agg(
        F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs")
    )  # one row per stratum, and strata are a fixed list: safe to broadcast
    failed = F.array_compact(
        F.array(*[F.when(F.col(r) > F.coalesce(F.col("cutoffs")[r], F.lit(float("inf"))), F.lit(r)) for r in grid])
    )
    return (
        measured.join(F.broadcast(per), "stratum", "left")
        .withColumn("failed_rules", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
        .drop("cutoffs")
    )


def apply_rules(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """A row per row of docs, a null doc_id or not, with its counts, base_failed, failed_rules and kept.

    The measures are written once to the shared folder, then read for the cutoffs and for the verdicts.
    """
    measured = shared.stash(metrics(docs), "quality")
    return judge(measured, thresholds(measured, labels, **options))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = apply_rules(texts(spark, sf_dir, "doc_id", "text", "lang"), shared.read_table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        F.array_join("failed_rules", ",").alias("failed_rules"),
    )


_WORD, _SPACE = "[^\\x20\\x09-\\x0D]+", "[\\x20\\x09-\\x0D]"
_SEEN_SQL = ", ".join(f"len(list_filter({[repr(c) for c in cuts]}::DOUBLE[], lambda c: {rule} > c))" for rule, cuts in GRID.items())
_CUTS_SQL = "{" + ", ".join(f"'{rule}': {[repr(c) for c in cuts]}::DOUBLE[]" for rule, cuts in GRID.items()) + "}"
#: DuckDB: windows as strings, the binomial tail term by term, and the steps tested one after the other.
OP4_SQL = f"""
WITH d AS (SELECT doc_id, CASE WHEN lang IN {LANGUAGES} THEN lang ELSE 'other' END AS stratum, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{_WORD}') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls FROM d),
v AS (SELECT doc_id, unnest(range(1, len(ws) - {WINDOW - 2})) AS i,
  unnest(list_transform(range(1, len(ws) - {WINDOW - 2}), lambda j: array_to_string(ws[j:j + {WINDOW - 1}], ' '))) AS x FROM w WHERE len(ws) >= {WINDOW}),
s AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS n FROM v),
r AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS k FROM s WHERE n > 1) GROUP BY 1),
c AS (SELECT w.doc_id, stratum, len(ws) AS n_words, length(regexp_replace(t, '{_SPACE}', '', 'g')) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
  length(regexp_replace(t, '[^!]', '', 'g')) AS bang, len(ls) AS n_lines FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
m AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, n_symbols / greatest(n_words, 1) AS symbols_per_word,
  bang / greatest(n_words, 1) AS exclamations_per_word, n_dup_lines / greatest(n_lines, 1) AS duplicate_line_share,
  n_repeat_words / greatest(n_words, 1) AS repeated_word_share, word_chars / greatest(n_words, 1) AS mean_word_length FROM c),
g AS (SELECT doc_id, min(quality) AS q FROM labels WHERE quality IS NOT NULL GROUP BY 1),
u AS (SELECT doc_id, min(stratum) AS stratum, max(greatest({_SEEN_SQL})) AS e, min(q) AS q FROM m JOIN g USING (doc_id) WHERE NOT base_failed GROUP BY doc_id),
k AS (SELECT stratum, i, count(*) FILTER (q = 1) AS n, count(*) FILTER (q = 1 AND e > i) AS k, count(*) FILTER (q <> 1 AND e > i) AS caught FROM u, range({STEPS}) t(i) GROUP BY ALL),
p AS (SELECT *, list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - CASE WHEN j > 0 THEN lgamma(j + 1) ELSE 0 END - CASE WHEN j < n THEN lgamma(n - j + 1) ELSE 0 END
  + j * ln({ALPHA}::DOUBLE) + (n - j) * ln({1 - ALPHA}::DOUBLE)))) AS p FROM k WHERE n > 0),
f AS (SELECT *, bool_and(p <= {DELTA / (len(LANGUAGES) + 1)!r}::DOUBLE) OVER (PARTITION BY stratum ORDER BY i DESC) AS safe FROM p),
h AS (SELECT stratum, max_by(i, (caught - k, i)) AS i FROM f WHERE safe AND caught > k GROUP BY stratum),
o AS (SELECT m.*, {", ".join(f"coalesce({rule} > ({_CUTS_SQL})['{rule}'][h.i + 1], false) AS f{n}" for n, rule in enumerate(GRID))} FROM m LEFT JOIN h ON h.stratum = m.stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR {" OR ".join(f"f{n}" for n in range(len(GRID)))}) AS kept,
  array_to_string(list_filter([{", ".join(f"CASE WHEN f{n} THEN '{rule}' END" for n, rule in enumerate(GRID))}], lambda x: x IS NOT NULL), ',') AS failed_rules FROM o
"""
