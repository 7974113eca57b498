r"""Secret scans: candidate strings judged by a random forest that removes false positives.

A candidate is a run of at least 16 letters, digits and `_ + / -` with a digit among them, inside a word; a word can
hold many. Its features: length, shares of character classes, transitions between classes, distinct characters, coverage by a
dictionary, marks of paths, and the neighbouring words. The forest is trained by Spark's own trees from labelled
findings, and its trees become plain column expressions, so that a text is scanned, judged and redacted inside its
row: DataFrame functions only, one pass, no shuffle.

Labelled findings are a table (before2, before, word, after, label); `generated_findings` writes one from a range of
numbers, with real formats of keys and the usual look-alikes (commit ids, checksums, UUIDs, paths, numbers,
placeholders).

Cases: null, empty and blank texts have no findings; a text of any length is scanned whole, in time linear in it;
repeated rows are scanned each, and so are equal values inside a text; columns of docs may have any names; an empty
table gives an empty result.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.plans.adapters import texts

from . import shared

#: Labelled findings, trees, depth, seed; the least share of votes for a secret.
FINDINGS, TREES, DEPTH, SEED = 4000, 20, 6, 7
VOTES = 0.5
MARK = "<SECRET>"
#: Pieces of a text whose sizes are summed as one, as a shift.
_BLOCK = 7

_RUN = r"[A-Za-z0-9_+/-]{16,}={0,2}"
_VALUE = rf"(?:^|[^A-Za-z0-9_+/-])({_RUN})"
_NAMES = r"token|secret|passw|pwd|api.?key|access.?key|auth|credential|private|bearer"
_OTHER = r"commit|sha|md5|hash|checksum|uuid|guid|version|build|revision|digest|etag|order|card|file|page"
#: Words whose presence in a candidate speaks for a name or a placeholder.
_DICTIONARY = (
    "your|example|sample|test|dummy|placeholder|change|replace|insert|here|token|secret|password|key|value|name|user|"
    "admin|default|config|index|module|number|string|version|release|report|image|photo|chapter|section|page|file|"
    "path|home|data|table|column|article|update|system|server|client|service|product|item|list|the|and|xxxx+|0000+|"
    "1234+|abcd+|tion|ing|ment|ness|able"
)
FEATURES = (
    "length", "digits", "upper", "lower", "symbols", "transitions", "distinct", "hex", "dictionary", "longest_letters",
    "path", "slashes", "dashes", "named", "other", "assigned", "quoted", "known",
)


def candidates(word: Column) -> Column:
    """All candidates of a word, in order: an array of (start, lead, value, tail), start from 0 in code points.

    The lead is what stands before the value back to the start of the run before it, and the tail reaches up to the
    next run: each part of a long word is looked at a bounded number of times.
    """

    def of(runs: Column, gaps: Column, place: Callable[[Column], Column]) -> Column:
        def one(value: Column, k: Column) -> Column:
            return F.when(
                value.rlike("[0-9]"),
                F.struct(
                    place(k).alias("start"),
                    F.concat(F.when(k > 0, F.get(runs, k - 1)).otherwise(""), F.get(gaps, k)).alias("lead"),
                    value.alias("value"),
                    F.get(gaps, k + 1).alias("tail"),
                ),
            )

        return F.filter(F.transform(runs, one), lambda c: c.isNotNull())

    runs = F.regexp_extract_all(word, F.lit(_RUN), F.lit(0))
    return shared.let(runs, lambda r: shared.let(F.split(word, _RUN, -1), lambda g: _placed(r, g, lambda place: of(r, g, place))))


def _placed(pieces: Column, gaps: Column, body: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """body(place): place(k) is where pieces[k] starts in a text that is a gap, a piece, a gap and so on.

    Sizes are summed once, by blocks of pieces; a place is the sum before its block and of the few pieces in it before."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda acc, x: acc + x)
    first = lambda block: F.shiftleft(block, _BLOCK) + 1
    sizes = F.transform(pieces, lambda x, k: F.length(F.get(gaps, k)) + F.length(x))

    def with_sizes(size: Column) -> Column:
        own = F.transform(F.sequence(F.lit(0), F.shiftright(F.size(size), _BLOCK)), lambda b: total(F.slice(size, first(b), F.lit(1 << _BLOCK))))
        sums = F.aggregate(own, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

        def place(before: Column) -> Callable[[Column], Column]:
            inside = lambda k: total(F.slice(size, first(F.shiftright(k, _BLOCK)), k.bitwiseAND((1 << _BLOCK) - 1)))
            return lambda k: F.get(before, F.shiftright(k, _BLOCK)) + inside(k) + F.length(F.get(gaps, k))

        return shared.let(sums, lambda before: body(place(before)))

    return shared.let(sizes, with_sizes)


def features(before2: Column, before: Column, candidate: Column) -> Column:
    """A struct of doubles by FEATURES, of a candidate and the two words before its word."""
    value, lead = candidate["value"], candidate["lead"]
    word = F.concat(lead, value, candidate["tail"])
    n = F.length(value)
    share = lambda pattern: F.regexp_count(value, F.lit(pattern)) / n
    near = F.lower(F.concat_ws(" ", F.coalesce(before2, F.lit("")), F.coalesce(before, F.lit("")), lead))
    low = F.lower(value)
    of = {
        "length": n,
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "lower": share("[a-z]"),
        "symbols": share("[_+/=-]"),
        "transitions": share("[a-z](?=[^a-z])|[A-Z](?=[^A-Z])|[0-9](?=[^0-9])"),
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / F.least(n, F.lit(40)),
        "hex": F.when(low.rlike("^[0-9a-f]+$"), 1).otherwise(0),
        "dictionary": 1 - F.length(F.regexp_replace(low, _DICTIONARY, "")) / n,
        "longest_letters": F.array_max(F.transform(F.split(value, "[^A-Za-z]+"), lambda x: F.length(x))),
        "path": F.when(word.rlike(r"://|^[./~]|\.[a-z]{2,4}\b|/[a-z]+/"), 1).otherwise(0),
        "slashes": share("/"),
        "dashes": share("-"),
        "named": F.when(near.rlike(_NAMES), 1).otherwise(0),
        "other": F.when(near.rlike(_OTHER), 1).otherwise(0),
        "assigned": F.when(near.rlike(r"[=:]\s*[\"'`(]*\s*$"), 1).otherwise(0),
        "quoted": F.when(lead.rlike("[\"'`]$"), 1).otherwise(0),
        "known": F.when(value.rlike("^(AKIA|ASIA|ghp_|gho_|sk_|pk_|rk_|xox[abp]-|glpat-|AIza|eyJ)"), 1).otherwise(0),
    }
    return F.struct(*[of[f].cast("double").alias(f) for f in FEATURES])


def generated_findings(spark: SparkSession, count: int = FINDINGS, seed: int = SEED) -> DataFrame:
    """Labelled findings (before2, before, word, after, label) from numbers alone; the same for the same parameters."""
    digest = lambda salt: F.sha2(F.concat_ws(":", F.lit(salt), F.lit(seed), F.col("id")).cast("binary"), 256)

    def pick(salt: str, *names: str) -> Column:
        place = F.conv(F.substring(digest(salt), 1, 4), 16, 10).cast("int") % len(names)
        return F.element_at(F.array(*map(F.lit, names)), place + 1)

    def column(name: str, value: Column) -> Column:
        parts[name] = value
        return F.col(name)

    parts: dict[str, Column] = {}
    hexed = column("hexed", digest("a"))
    mixed = column("mixed", F.regexp_replace(F.base64(F.unhex(F.concat(digest("a"), digest("b")))), "[+/=]", "x"))
    syllables = [pick("w1", "th", "er", "on", "an", "que", "sch"), pick("w2", "ed", "ing", "ment", "la", "tion"), pick("w3", "", "er", "es", "ung")]
    word = column("word", F.concat(*syllables))
    numbers = column("numbers", F.translate(F.substring(digest("n"), 1, 24), "abcdef", "012345"))
    sized = F.substr(mixed, F.lit(1), (20 + F.col("id") % 23).cast("int"))
    size = F.element_at(F.array(*map(F.lit, (32, 40, 40, 64))), (F.col("id") % 4 + 1).cast("int"))
    short_hex = F.substr(hexed, F.lit(1), size)
    named = column("named", pick("k", "token", "secret", "api_key", "access_token", "password", "auth_token", "client_secret", "TOKEN", "API_KEY"))
    quote = column("quote", pick("q", '"', '"', "'", ""))
    tail = column("tail", pick("t", "", "", ".", ",", "!!", "###", "%%%", "&&&", "$$$", "***"))
    prefix = column("prefix", pick("p", "ghp_", "sk_live_", "glpat-", "xoxb-"))
    about = column("about", pick("c", "commit", "sha1", "md5", "checksum", "revision", "digest", "sha256:", "build", "etag"))
    unique = column("uniq", pick("u", "uuid", "id", "guid:", "request"))
    folder = column("folder", pick("d2", "lib", "share", "src", "report"))
    dummy = column("dummy", pick("d", "your_api_key_here_1234", "xxxxxxxxxxxxxxxxxxxx0", "replace_with_token_1", "example_secret_value_1", "test_password_12345", "changeme_placeholder_0000"))
    case = lambda x: F.when(F.col("id") % 7 == 3, F.upper(x)).otherwise(x)
    dashed = F.concat_ws("-", F.substring(hexed, 1, 8), F.substring(hexed, 9, 4), F.substring(hexed, 13, 4), F.substring(hexed, 17, 4), F.substring(hexed, 21, 12))
    rows = [
        # secrets: before2, before, value in its word
        (1, named, F.lit("="), F.concat(quote, case(short_hex), quote, tail)),
        (1, named, F.lit("="), F.concat(quote, short_hex, quote, tail)),
        (1, named, F.lit(":"), F.concat(quote, sized, F.lit("7"), quote, tail)),
        (1, word, F.concat(named, F.lit(":")), F.concat(quote, sized, F.lit("4"), quote, tail)),
        (1, word, word, F.concat(named, F.lit("="), quote, sized, F.lit("2"), quote)),
        (1, word, word, F.concat(prefix, sized, F.lit("9"), tail)),
        (1, word, word, F.concat(F.lit("AKIA"), F.upper(F.substring(hexed, 1, 16)), tail)),
        # look-alikes
        (0, word, about, F.concat(short_hex, tail)),
        (0, about, F.lit("="), F.concat(quote, short_hex, quote, tail)),
        (0, word, unique, F.concat(dashed, tail)),
        (0, word, word, F.concat(numbers, tail)),
        (0, word, word, F.concat(F.substring(numbers, 1, 16), tail)),
        (0, named, F.lit("="), F.concat(quote, dummy, quote)),
        (0, word, word, F.concat(F.lit("/"), word, F.lit("/"), folder, F.lit("/"), word, F.lit("-2"), F.substring(numbers, 1, 3), F.lit(".html"))),
        (0, word, word, F.concat(F.lit("https://"), word, F.lit(".example.com/"), word, F.lit("-"), word, F.lit("-"), F.substring(numbers, 1, 5))),
        (0, word, word, F.concat(word, F.lit("_"), word, F.lit("_"), word, F.substring(numbers, 1, 2), tail)),
        (0, word, word, F.concat(word, word, word, word, F.substring(numbers, 1, 2), tail)),
        (0, word, word, F.concat_ws("-", word, word, word, F.substring(numbers, 1, 4))),
    ]
    # one partition: a row is built of the template that its number picks, from pieces written once
    made = shared.stash(spark.range(0, count, 1, 1).select("id", *[v.alias(k) for k, v in parts.items()]), "pieces")
    picked = F
    for i, (y, before2, before, own) in enumerate(rows):
        one = F.struct(before2.alias("before2"), before.alias("before"), own.alias("word"), F.col("word").alias("after"), F.lit(y).alias("label"))
        picked = picked.when(F.col("id") % len(rows) == i, one)
    return made.select(picked.alias("row")).select("row.*")


def fit(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> list:
    """A forest from labelled findings: nested tuples (feature index, cut, left, right) with votes at the leaves.

    Rows without a candidate or a label don't count; a word with several counts by its first. All rows are learned from;
    they are as many as were labelled.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = findings.withColumn("found", F.get(candidates(F.col("word")), F.lit(0)))
    rows = rows.where(F.col("found").isNotNull() & F.col("label").isNotNull())
    rows = rows.select(features(F.col("before2"), F.col("before"), F.col("found")).alias("x"), F.col("label").cast("double").alias("label")).select("x.*", "label")
    rows = shared.stash(rows, "findings")  # the trees read it several times
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).select("features", "label")
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(ready)
    return [_parse(t.toDebugString) for t in model.trees]


def _parse(text: str):
    """The tree of a printed model."""
    lines = [x.strip() for x in text.splitlines() if re.search(r"\b(If|Else|Predict)\b", x)]

    def node(i: int):
        if lines[i].startswith("Predict"):
            return float(lines[i].split(":")[1]), i + 1
        feature, cut = re.search(r"feature (\d+) <= (\S+?)\)", lines[i]).groups()
        left, i = node(i + 1)
        right, i = node(i + 1)  # past the Else
        return (int(feature), float(cut), left, right), i

    return node(0)[0]


@functools.lru_cache(2)
def _default_forest(application: str) -> list:
    return fit(generated_findings(SparkSession.getActiveSession()))


def default_forest(spark: SparkSession) -> list:
    return _default_forest(spark.sparkContext.applicationId)


def votes(x: Column, forest: list) -> Column:
    """The share of the forest's trees that call the features x a secret."""

    def walk(tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(tree)
        feature, cut, left, right = tree
        return F.when(x[FEATURES[feature]] <= cut, walk(left)).otherwise(walk(right))

    total = walk(forest[0])
    for tree in forest[1:]:
        total = total + walk(tree)
    return total / len(forest)


def scan(docs: DataFrame, forest: list, text_col: str = "text", out_col: str = "_findings") -> DataFrame:
    """docs with out_col, a name that docs must not have: an array of (start, length, value, score), start from 0 in code
    points, in order."""
    if out_col.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has a column {out_col}")
    text = F.coalesce(shared.column(text_col).cast("string"), F.lit(""))
    has = lambda w: (F.length(w) >= 16) & w.rlike("[0-9]") & w.rlike(_VALUE)

    def found_in(words: Column) -> Column:
        def inside(w: Column, i: Column) -> Column:
            before, before2 = F.get(words, i - 1), F.get(words, i - 2)
            return F.when(has(w), F.struct(i.alias("i"), candidates(w).alias("own"), before.alias("before"), before2.alias("before2")))

        return F.filter(F.transform(words, inside), lambda w: w.isNotNull() & (F.size(w["own"]) > 0))

    def judged(w: Column, place: Column, c: Column) -> Column:
        score = shared.let(features(w["before2"], w["before"], c), lambda x: votes(x, forest))
        start = (place + c["start"]).cast("long")
        return F.struct(start.alias("start"), F.length(c["value"]).cast("long").alias("length"), c["value"].alias("value"), score.alias("score"))

    def judged_in(place: Callable[[Column], Column], w: Column) -> Column:
        return shared.let(place(w["i"]), lambda p: F.transform(w["own"], lambda c: judged(w, p, c)))

    def of(words: Column, found: Column) -> Column:
        each = lambda place: F.flatten(F.transform(found, lambda w: judged_in(place, w)))
        gaps = F.split(text, shared.WORD_CLASS + "+", -1)
        return F.when(F.size(found) > 0, shared.let(gaps, lambda g: _placed(words, g, each))).otherwise(
            F.array().cast("array<struct<start:bigint,length:bigint,value:string,score:double>>")
        )

    # all is bound to variables: a filter that is pushed below computes the words once for a text, too, not once for a word
    findings = shared.let(shared.words(text), lambda words: shared.let(found_in(words), lambda found: of(words, found)))
    return docs.select(*map(shared.column, docs.columns), findings.alias(out_col))


def redact(docs: DataFrame, forest: list, votes_needed: float = VOTES) -> DataFrame:
    """docs with every secret in text replaced by a mark, wherever its value stands in the text; other texts stay.

    n_chars, if there is such a column, is set anew for the texts that change. All other columns stay as they are.
    """
    findings, values, clean = shared.fresh(docs, "findings", "values", "clean")
    scanned = scan(docs, forest, out_col=findings)
    secret = F.filter(findings, lambda f: f["score"] >= votes_needed)
    ordered = F.sort_array(F.transform(secret, lambda f: F.struct(F.length(f["value"]).alias("n"), f["value"].alias("v"))), asc=False)
    out = scanned.withColumn(values, F.array_distinct(ordered))
    marked = F.aggregate(values, F.col("text"), lambda acc, v: F.replace(acc, v["v"], F.lit(MARK)))
    out = out.withColumn(clean, F.when(F.size(values) > 0, marked).otherwise(F.col("text")))
    size = F.when(F.size(values) > 0, F.length(clean)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    of = {"text": F.col(clean).alias("text")} | ({} if size is None else {"n_chars": size.alias("n_chars")})
    return out.select(*[of[c] if c in of else shared.column(c) for c in docs.columns])


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per candidate of every text: doc_id, start, length, score, is_secret and the value's digest."""
    docs = texts(spark, sf_dir, "doc_id", "text")
    row = lambda f: F.struct(
        f["start"].alias("start"),
        f["length"].alias("length"),
        F.sha2(f["value"], 256).alias("value_sha256"),
        f["score"].alias("score"),
        (f["score"] >= VOTES).alias("is_secret"),
    )
    # inline of an expression: of a column, Spark would first filter by its size, and scan each text for that as well
    return scan(docs, default_forest(spark)).select("doc_id", F.inline(F.transform("_findings", row)))
