"""The co-change graph: pairs of items that change together, clusters, and lookups in it."""

from __future__ import annotations

import tempfile
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codestrata.functions import paths
from codestrata.operators import cells, search

MIN_COMMITS, MIN_RATIO, CLUSTER_RATIO = 5, 0.5, 0.7
#: Commits of an item in one row, about; classes of commits by hash where an item's first ones are told apart.
BUCKET, BINS = 2048, 1024
#: Items of a class that meet others at once, about; pairs of items that a task writes, about.
CELL, TASK = 1024, 2_000_000
#: Candidates that are joined in any case; pairs of classes that are kept; pairs of items that one pair of classes gives in place.
JOINED, FEW, HEAVY = 1_000_000, 4_000_000, 1_000_000
#: Items that are sent to every executor at most (two numbers each).
MEMBERS = 2_000_000
#: Commits in a row of bits, at most; what a joined candidate costs, and a pair in a cell: by itself and for each commit.
COMMITS, JOIN_COST, CELL_COST = 1 << 16, 500, (5, 0.04)


def strength(ratio: Column) -> Column:
    return F.when(ratio >= 0.9, "strong").when(ratio >= 0.7, "moderate").otherwise("weak")


def in_window(commits: DataFrame, at: str, reference: Column, days: int) -> DataFrame:
    """The rows of the last `days` days before reference; a plain comparison, which reaches the scan."""
    return commits.where(F.col(at) >= reference - F.make_interval(days=F.lit(days)))


def classes(known: DataFrame) -> DataFrame:
    """(file, total, n, rep) of known (file, total, sha): items of equal commits are one class, named by its least item.

    n counts the item's commits. Classes are found by hashes of sets, and each item is then compared with its class's
    least one, commit by commit: one whose commits differ is a class of its own.
    """
    keys = ["total", "n", "x0", "x1"]
    marks = known.groupBy("file", "total").agg(F.count("*").alias("n"), *[F.bit_xor(F.xxhash64("sha", F.lit(i))).alias(f"x{i}") for i in (0, 1)])
    named = marks.join(marks.groupBy(*keys).agg(F.min("file").alias("rep")), keys)
    others = known.join(named.where("file <> rep").select("file", "rep"), "file").select("file", "rep", "sha")
    met = others.join(known.select(F.col("file").alias("rep"), "sha"), ["rep", "sha"]).groupBy("file").agg(F.count("*").alias("met"))
    rep = F.when(F.col("met") == F.col("n"), F.col("rep")).otherwise(F.col("file"))
    return named.join(met, "file", "left").select("file", "total", "n", rep.alias("rep"))


class Compared(NamedTuple):
    """classes(), the commits of each class's least item, those of them that are joined, and blocks if cells are cheaper."""

    classed: DataFrame
    sized: DataFrame
    first: DataFrame
    blocks: cells.Blocks | None


def compared(
    commit_files: DataFrame,
    min_commits: int = MIN_COMMITS,
    min_ratio: float = MIN_RATIO,
    excludes: tuple = paths.DEFAULT_EXCLUDES,
    commit: str = "sha",
    item: str = "file",
    dense: bool = True,
) -> Compared:
    """What class_pairs() compares.

    Items with too few commits are dropped first. Of a class's commits, the smallest first, only so many are joined that
    every partner of a ratio of at least min_ratio must share one of them (prefix filtering): a commit of very many
    classes is among them only for those that have hardly another. Where that prefix ends is found from counts of commits
    by size and hash, so not even a class of all commits is sorted or gathered. Where the prefixes would give more
    candidates than it costs to compare all classes (few commits, most of which touch most items), classes become rows
    of bits in blocks instead, and a task compares two blocks whole: no pair of classes is shuffled or written.
    """
    files = commit_files.select(F.col(commit).alias("sha"), F.col(item).alias("file"))
    if excludes:
        files = files.where(~paths.excluded(F.col("file").cast("string"), excludes))
    files = files.distinct()
    totals = files.groupBy("file").agg(F.count("*").alias("total")).where(F.col("total") >= min_commits)
    every = checkpoint(files.join(totals, "file").where("sha is not null"))
    classed = checkpoint(classes(every))
    known = every.join(classed.where("file = rep").select("file"), "file", "left_semi")
    sized = known.join(known.groupBy("sha").agg(F.count("*").alias("items")), "sha").withColumn("bin", F.pmod(F.xxhash64("sha"), F.lit(BINS)))
    sized = checkpoint(sized)
    # the prefix of an item: whole (items, bin) in that order, which is one for all items, until it is long enough
    need = F.greatest(F.lit(1), F.col("total") - F.ceil(F.col("total") * min_ratio - 1e-9) + 1)
    before = F.sum("n").over(Window.partitionBy("file").orderBy("items", "bin").rowsBetween(Window.unboundedPreceding, -1))
    steps = sized.groupBy("file", "total", "items", "bin").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(before, F.lit(0)))
    first = sized.join(steps.where(F.col("before") < need).select("file", "items", "bin"), ["file", "items", "bin"]).select("file", "total", "sha")
    return Compared(classed, sized, first, _blocks(classed, sized, first) if dense else None)


def _blocks(classed: DataFrame, sized: DataFrame, first: DataFrame) -> cells.Blocks | None:
    """The classes as blocks, if their cells cost less than the candidates of their prefixes."""
    joined = first.groupBy("sha").agg(F.count("*").cast("double").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0
    if joined <= JOINED:
        return None
    commits = sized.select("sha").distinct()
    width = commits.limit(COMMITS + 1).count()
    items, named = classed.agg(F.count("*"), F.count_if(F.col("file") == F.col("rep"))).first()
    if width > COMMITS or joined * JOIN_COST <= named * named / 2 * (CELL_COST[0] + width * CELL_COST[1]):
        return None
    numbers = commits.select("sha", (F.row_number().over(Window.orderBy("sha")) - 1).alias("at"))  # at most COMMITS rows
    sizes = classed.groupBy(F.col("rep").alias("file")).agg(F.count("*").alias("size"))
    count = max(-(-named // cells.BLOCK), min(5, -(-named // 512)), int(items / (20 * TASK) ** 0.5))
    listed = sized.join(F.broadcast(numbers), "sha").groupBy("file", "total").agg(F.collect_list("at").alias("at")).join(sizes, "file")
    listed = listed.withColumn("block", F.pmod(F.xxhash64("file", F.lit(3)), F.lit(count)))
    return cells.Blocks(checkpoint(cells.packed(listed, -(-width // 8))), count, -(-width // 8))


def class_pairs(
    commit_files: DataFrame,
    min_commits: int = MIN_COMMITS,
    min_ratio: float = MIN_RATIO,
    excludes: tuple = paths.DEFAULT_EXCLUDES,
    commit: str = "sha",
    item: str = "file",
    wanted: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """classes(), and (file_a, file_b, shared, total_a, total_b, ratio, links): the pairs of classes, links pairs of items each.

    A class of more than one item is paired with itself, too. Of wanted (column file), only pairs with one of these
    items' classes are looked for. See compared() for how; the pairs are kept, so use the functions that take commits
    where there may be very many.
    """
    these = compared(commit_files, min_commits, min_ratio, excludes, commit, item, wanted is None)
    return these.classed, checkpoint(_in_order(cells.pairs(these.blocks, min_ratio))) if these.blocks else _joined(these, min_ratio, wanted)


def _joined(these: Compared, min_ratio: float, wanted: DataFrame | None = None) -> DataFrame:
    """The pairs of classes by candidates, whose commits are compared whole, bucket by bucket.

    A row holds a class's commits of one bucket, about BUCKET at most, and nothing is lost or estimated.
    """
    classed, sized, first, _ = these
    a, b = (first.select("sha", F.col("file").alias(f"file_{s}"), F.col("total").alias(f"total_{s}")) for s in "ab")
    near = F.least("total_a", "total_b") >= min_ratio * F.greatest("total_a", "total_b") - 1e-9  # no more can be shared
    if wanted is None:
        joined = a.join(b, "sha").where((F.col("file_a") < F.col("file_b")) & near)
    else:
        asked = classed.join(wanted.select("file").distinct(), "file").select(F.col("rep").alias("file_a")).distinct()
        joined = _in_order(a.join(asked, "file_a", "left_semi").join(b, "sha").where((F.col("file_a") != F.col("file_b")) & near))
    candidates = joined.select("file_a", "file_b", "total_a", "total_b").distinct()
    most = sized.agg(F.max("total")).first()[0] or 0
    bucket = F.pmod(F.xxhash64("sha", F.lit(1)), F.lit(max(1, -(-most // BUCKET))))
    listed = checkpoint(sized.groupBy("file", bucket.alias("bucket")).agg(F.collect_list("sha").alias("in")))
    sides = [listed.select(F.col("file").alias(f"file_{s}"), "bucket", F.col("in").alias(f"in_{s}")) for s in "ab"]
    met = candidates.join(sides[0], "file_a").join(sides[1], ["file_b", "bucket"])
    met = met.select("file_a", "file_b", "total_a", "total_b", F.size(F.array_intersect("in_a", "in_b")).cast("long").alias("n"))
    counted = met.groupBy("file_a", "file_b", "total_a", "total_b").agg(F.sum("n").alias("shared")).where("shared > 0")
    sizes = classed.groupBy("rep", "total", "n").agg(F.count("*").alias("size"))
    own = sizes.where("size > 1 and n > 0").select(
        F.col("rep").alias("file_a"), F.col("rep").alias("file_b"), F.col("total").alias("total_a"), F.col("total").alias("total_b"), F.col("n").alias("shared")
    )
    held = counted.unionByName(own).withColumn("ratio", F.col("shared") / F.greatest("total_a", "total_b")).where(F.col("ratio") >= min_ratio)
    for s in "ab":
        held = held.join(sizes.select(F.col("rep").alias(f"file_{s}"), F.col("size").alias(f"size_{s}")), f"file_{s}")
    links = F.when(F.col("file_a") == F.col("file_b"), F.expr("size_a * (size_a - 1) div 2")).otherwise(F.col("size_a") * F.col("size_b"))
    return checkpoint(held.select("file_a", "file_b", "shared", "total_a", "total_b", "ratio", links.alias("links")))


def _in_order(found: DataFrame) -> DataFrame:
    """found with file_a and file_b, and their totals, in order of the items."""
    swap = F.col("file_a") > F.col("file_b")
    names = [f"{c}_{s}" for c in ("file", "total") for s in "ab"]
    other = {"a": "b", "b": "a"}
    return found.select(*[c for c in found.columns if c not in names], *[F.when(swap, F.col(n[:-1] + other[n[-1]])).otherwise(F.col(n)).alias(n) for n in names])


def expanded(classed: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs of items, file_a < file_b, that class_pairs() stand for.

    Large classes are dealt to parts of about CELL items, and pairs of parts to tasks by the number of pairs that they
    give; no pair of items is shuffled if the list of items can be broadcast.
    """
    rows, most = found.agg(F.sum("links"), F.max("links")).first()
    if not most or most == 1 and found.where("file_a = file_b").limit(1).count() == 0:
        return found.drop("links")
    slots = classed.groupBy("rep").agg(F.ceil(F.count("*") / CELL).alias("slots"))
    part = F.pmod(F.xxhash64("file", F.lit(2)), F.col("slots"))
    members = checkpoint(classed.join(slots, "rep").select("rep", part.alias("part"), "file"))
    small = members.limit(search.BROADCAST_ROWS + 1).count() <= search.BROADCAST_ROWS
    cells = found.drop("links").withColumnsRenamed({"file_a": "rep_a", "file_b": "rep_b"})
    for s in "ab":
        cells = cells.join(members.select(F.col("rep").alias(f"rep_{s}"), F.col("part").alias(f"part_{s}")).distinct(), f"rep_{s}")
    cells = cells.where("rep_a <> rep_b or part_a <= part_b")
    cells = cells.repartition(min(20_000, max(cells.sparkSession.sparkContext.defaultParallelism, rows // TASK)), "rep_a", "part_a", "rep_b", "part_b")
    for s in "ab":
        side = members.select(F.col("rep").alias(f"rep_{s}"), F.col("part").alias(f"part_{s}"), F.col("file").alias(f"file_{s}"))
        cells = cells.join(F.broadcast(side) if small else side, [f"rep_{s}", f"part_{s}"])
    once = cells.where("rep_a <> rep_b or part_a < part_b or file_a < file_b")
    return _in_order(once.drop("rep_a", "rep_b", "part_a", "part_b"))


def pairs(
    commit_files: DataFrame,
    min_commits: int = MIN_COMMITS,
    min_ratio: float = MIN_RATIO,
    excludes: tuple = paths.DEFAULT_EXCLUDES,
    commit: str = "sha",
    item: str = "file",
) -> DataFrame:
    """(file_a, file_b, shared, total_a, total_b, ratio, strength, confidence_ab, confidence_ba), file_a < file_b.

    ratio is shared commits over the larger total; the confidences are over either total. Classes of items are compared
    (see class_pairs), and their pairs are then written out.
    """
    these = compared(commit_files, min_commits, min_ratio, excludes, commit, item)
    return _named(_expanded(these, min_ratio))


def _named(found: DataFrame) -> DataFrame:
    return (
        found.withColumn("strength", strength(F.col("ratio")))
        .withColumn("confidence_ab", F.col("shared") / F.col("total_a"))
        .withColumn("confidence_ba", F.col("shared") / F.col("total_b"))
    )


def _expanded(these: Compared, min_ratio: float, kept: Column | None = None) -> DataFrame:
    """The pairs of items; only of pairs of classes that are kept.

    Many pairs of classes are written out where a cell finds them and are never kept or shuffled, but for the few that
    stand for very many pairs of items each: these are dealt to tasks by expanded().
    """
    keep = (lambda df: df) if kept is None else lambda df: df.where(kept)
    classed, blocks = these.classed, these.blocks
    if not blocks:
        return expanded(classed, keep(_joined(these, min_ratio)))
    if _few(these):
        return expanded(classed, checkpoint(keep(_in_order(cells.pairs(blocks, min_ratio)))))
    out = keep(cells.pairs(blocks, min_ratio, many=HEAVY)).drop("links").withColumnsRenamed({"file_a": "rep_a", "file_b": "rep_b"})
    members = checkpoint(classed.select("rep", "file"))
    small = members.limit(MEMBERS + 1).count() <= MEMBERS
    for s in "ab":
        side = members.select(F.col("rep").alias(f"rep_{s}"), F.col("file").alias(f"file_{s}"))
        out = out.join(F.broadcast(side) if small else side, f"rep_{s}")
    light = _in_order(out.where("rep_a <> rep_b or file_a < file_b").drop("rep_a", "rep_b"))
    heavy = expanded(classed, checkpoint(keep(_in_order(cells.pairs(blocks, min_ratio, HEAVY)))))
    return light.unionByName(heavy.select(*light.columns))


def _few(these: Compared) -> bool:
    """Whether all pairs of classes are few enough to be kept."""
    named = these.classed.where("file = rep").count()
    return named * (named + 1) // 2 <= FEW


def best_pairs(
    commit_files: DataFrame,
    most: int,
    digits: int = 6,
    min_commits: int = MIN_COMMITS,
    min_ratio: float = MIN_RATIO,
    excludes: tuple = paths.DEFAULT_EXCLUDES,
    commit: str = "sha",
    item: str = "file",
) -> DataFrame:
    """Of pairs(), those whose ratio, rounded, and shared commits are among the highest that most pairs need, and all of equal ones.

    Pairs of classes are counted by the two, and only the best of them are written out.
    """
    these = compared(commit_files, min_commits, min_ratio, excludes, commit, item)
    rank = [F.round("ratio", digits).alias("r"), F.col("shared").alias("s")]
    if these.blocks:
        found = cells.counts(these.blocks, min_ratio).withColumn("ratio", F.col("shared") / F.col("larger"))
    else:
        found = _joined(these, min_ratio)
    groups = found.groupBy(*rank).agg(F.sum("links").alias("links"), F.min("ratio").alias("least")).orderBy(F.desc("r"), F.desc("s")).limit(most).collect()
    reached, least, last = 0, 1.0, None
    for last in groups:
        reached, least = reached + last["links"], min(least, last["least"])
        if reached >= most:
            break
    kept = F.lit(False) if last is None else (rank[0] > last["r"]) | (rank[0] == last["r"]) & (rank[1] >= last["s"])
    return _named(_expanded(these, least, kept) if these.blocks else expanded(these.classed, found.where(kept)))


def stats(commit_files: DataFrame, excludes: tuple = paths.DEFAULT_EXCLUDES, commit: str = "sha", item: str = "file") -> DataFrame:
    """(commits, files_analyzed): commits, and distinct files after exclusion."""
    kept = ~paths.excluded(F.col(item).cast("string"), excludes) if excludes else F.lit(True)
    return commit_files.agg(F.countDistinct(commit).alias("commits"), F.countDistinct(F.when(kept, F.col(item))).alias("files_analyzed"))


def set_checkpoint_dir(spark: SparkSession) -> None:
    """Set the folder of spark.checkpoint.dir; only a local session may do without one."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(base or tempfile.mkdtemp(prefix="codestrata-"))


def checkpoint(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder."""
    set_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def components(edges: DataFrame, a: str = "file_a", b: str = "file_b", rounds: int = 50) -> DataFrame:
    """(node, component): the least node that each node reaches; nodes without an edge do not appear.

    Labels fall to the least of a node's neighbours' and then jump to their label's label, so long chains halve.
    Every round is checkpointed to the shared folder, which keeps plans short and survives lost executors.
    """
    set_checkpoint_dir(edges.sparkSession)
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("other")).unionAll(edges.select(F.col(b), F.col(a)))
    both = both.distinct().checkpoint()
    labels = both.groupBy("node").agg(F.min("other").alias("label")).select("node", F.least("node", "label").alias("label"))
    labels = labels.checkpoint()
    for _ in range(rounds):
        near = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("label").alias("near"))
        low = labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        jump = low.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        new = low.join(jump, "label", "left").select("node", F.least("label", "jump").alias("label"), "old").checkpoint()
        labels = new.select("node", "label")
        if not new.where("label <> old").take(1):
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError(f"components not settled after {rounds} rounds")


def clusters(found: DataFrame, ratio: float = CLUSTER_RATIO) -> DataFrame:
    """(component, files, size, cohesion) of pairs at or above ratio; cohesion is the mean ratio of all pairs inside."""
    found = checkpoint(found.select("file_a", "file_b", "ratio", F.lit(1).cast("long").alias("links")))  # read for the edges and for the cohesion
    reached = components(found.where(F.col("ratio") >= ratio))
    return _clusters(found, reached, reached)


def item_members(these: Compared, ratio: float = CLUSTER_RATIO, min_ratio: float = MIN_RATIO) -> DataFrame:
    """(node, component) of the items of compared(), by pairs at or above ratio."""
    found = checkpoint(cells.forest(these.blocks, ratio)) if these.blocks else _joined(these, min_ratio).where(F.col("ratio") >= ratio)
    return _members(these.classed, components(found))


def item_clusters(these: Compared, ratio: float = CLUSTER_RATIO, min_ratio: float = MIN_RATIO) -> DataFrame:
    """clusters() of the items of compared(), without writing any pairs out."""
    if not these.blocks:
        return class_clusters(these.classed, _joined(these, min_ratio), ratio)
    reached = components(checkpoint(cells.forest(these.blocks, ratio)))
    inside = cells.sums(these.blocks, reached.select(F.col("node").alias("file"), F.col("component").alias("label")), min_ratio)
    inside = inside.select(F.col("label").alias("component"), (F.col("ratios") / F.col("links")).alias("cohesion"))
    return _sized(_members(these.classed, reached), inside)


def _members(classed: DataFrame, reached: DataFrame) -> DataFrame:
    return classed.join(reached.withColumnRenamed("node", "rep"), "rep").select(F.col("file").alias("node"), "component")


def class_members(classed: DataFrame, found: DataFrame, ratio: float = CLUSTER_RATIO) -> tuple[DataFrame, DataFrame]:
    """components() of class_pairs() at or above ratio, and of the items behind them."""
    reached = components(found.where(F.col("ratio") >= ratio))
    return reached, _members(classed, reached)


def class_clusters(classed: DataFrame, found: DataFrame, ratio: float = CLUSTER_RATIO) -> DataFrame:
    """clusters() of the items behind class_pairs(), without writing their pairs out."""
    return _clusters(found, *class_members(classed, found, ratio))


def _clusters(found: DataFrame, reached: DataFrame, members: DataFrame) -> DataFrame:
    inside = (
        found.join(reached.select(F.col("node").alias("file_a"), F.col("component").alias("ca")), "file_a")
        .join(reached.select(F.col("node").alias("file_b"), F.col("component").alias("cb")), "file_b")
        .where("ca = cb")
        .groupBy(F.col("ca").alias("component"))
        .agg((F.sum(F.col("ratio") * F.col("links")) / F.sum("links")).alias("cohesion"))
    )
    return _sized(members, inside)


def _sized(members: DataFrame, inside: DataFrame) -> DataFrame:
    sized = members.groupBy("component").agg(F.array_sort(F.collect_list("node")).alias("files"), F.count("*").alias("size"))
    return sized.join(inside, "component", "left").fillna(0.0, ["cohesion"])


def directed(found: DataFrame) -> DataFrame:
    """(file, partner, shared, confidence): each pair from both sides, relative to file."""
    sides = [F.struct(F.col(f"file_{x}").alias("file"), F.col(f"file_{y}").alias("partner"), "shared", F.col(f"confidence_{x}{y}").alias("confidence")) for x, y in ("ab", "ba")]
    return found.select(F.inline(F.array(*sides)))


def partners(classed: DataFrame, found: DataFrame, wanted: DataFrame) -> DataFrame:
    """directed(), of the items behind class_pairs(), for wanted items (column file) alone."""
    sides = [F.struct(F.col(f"file_{x}").alias("rep"), F.col(f"file_{y}").alias("other"), "shared", F.col(f"total_{x}").alias("of")) for x, y in ("ab", "ba")]
    each = found.select(F.inline(F.array(*sides))).distinct()  # a class and itself is one of both sides
    mine = classed.join(wanted.select("file").distinct(), "file").select("rep", "file")
    every = each.join(mine, "rep").join(classed.select(F.col("rep").alias("other"), F.col("file").alias("partner")), "other")
    return every.where("file <> partner").select("file", "partner", "shared", (F.col("shared") / F.col("of")).alias("confidence"))


def missing(found: DataFrame, plan: DataFrame, least: float = 0.9) -> DataFrame:
    """(partner, because, confidence): what changes with planned files (column file) but isn't planned, of pairs()."""
    return unplanned(directed(found), plan, least)


def unplanned(found: DataFrame, plan: DataFrame, least: float = 0.9) -> DataFrame:
    """missing() of directed() or partners()."""
    return (
        found.where(F.col("confidence") >= least)
        .join(plan.select("file").distinct(), "file")
        .join(plan.select(F.col("file").alias("partner")), "partner", "left_anti")
        .groupBy("partner")
        .agg(F.max("confidence").alias("confidence"), F.count("*").alias("because"))
    )


def of_all(commit_files: DataFrame, wanted: list, commit: str = "sha", item: str = "file") -> DataFrame:
    """(file, commits): what changed in the commits that touch every one of the wanted items."""
    touched = commit_files.where(F.col(item).isin(*wanted)).groupBy(commit).agg(F.countDistinct(item).alias("n")).where(F.col("n") == len(set(wanted)))
    rest = commit_files.where(~F.col(item).isin(*wanted)).join(touched, commit, "left_semi").select(commit, item).distinct()
    return rest.groupBy(F.col(item).alias("file")).agg(F.count("*").alias("commits"))


def partly_touched(members: DataFrame, plan: DataFrame) -> DataFrame:
    """(component, touched, size) of clusters of which a plan (column node) touches some but not all."""
    hit = F.col("hit").isNotNull()
    joined = members.join(plan.select("node").distinct().withColumn("hit", F.lit(1)), "node", "left")
    return joined.groupBy("component").agg(F.count_if(hit).alias("touched"), F.count("*").alias("size")).where("touched > 0 and touched < size")
