"""Merkle manifest of a dataset with checkpointed levels.

A leaf is the SHA-256 of a row's fields. Inside a group (source) leaves stand by ascending id,
and every ``FAN`` consecutive nodes become the SHA-256 of their digests, until one node
remains; the groups' last nodes, in order of their names, form the tree on top in the same way.

Only every ``STEP``-th level is stored. An aligned subtree of FAN ** STEP stored nodes is a
group of its own in every job, so a group that holds a third of all rows is spread like any
other, and each round of building shrinks the tree by that factor. ``proofs`` reads the stored
nodes again, regenerates the levels in between inside each subtree, emits for every stored
node the siblings on its way to the next stored level, and discards the rest; a leaf's proof
is its own part followed by those of its stored ancestors.

Positions come from one range sort by (group, id, leaf): a row's place is its place in its sorted
partition plus the counts of the partitions before, so no window holds a group.

Edge cases: a null field counts as "-", which differs from an empty one ("0:"). Null ids stand
first; rows with equal ids stand by their leaf, and whole repeated rows are interchangeable. A
null group is the first. A group of one leaf has that leaf as its last node. An empty table
gives an empty result. Columns that are not fields are neither read nor hashed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arrears.llm.common import stage

FAN, STEP = 3, 4
SPAN = FAN ** STEP
NONE = "cast(array() as array<struct<left:string,right:string>>)"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_hash(*fields: Column) -> Column:
    """SHA-256 over the fields: ``-`` for null, else byte count, colon, value."""
    parts = []
    for f in fields:
        s = f.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _joined(digests: Column, start: Column, count) -> Column:
    return F.array_join(F.slice(digests, start, count), "")


def _above(level: Column) -> Column:
    """The nodes over a level of an aligned subtree."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(level) - 1) / FAN).cast("int")),
                       lambda k: F.sha2(_joined(level, k * FAN + 1, F.lit(FAN)), 256))


def positions(rows: DataFrame) -> DataFrame:
    """Rows (tree, tie columns in order, ...) plus ``place``, the number within the tree; stored
    in order. ``rows`` must hold ``tree``, ``key`` and ``hash``; equal rows are told apart by
    their place in the input, so a run of them is no single range."""
    keyed = rows.withColumn("copy", F.monotonically_increasing_id())
    order = ["tree", F.col("key").asc_nulls_first(), "hash", "copy"]
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order).drop("copy", "key")
    ranged = stage(ranged.withColumn("at", F.monotonically_increasing_id()), "merkle-leaves")
    part = F.shiftright("at", 33)
    runs = stage(ranged.groupBy("tree", part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("n")),
                 "merkle-runs")
    tree = Window.partitionBy("tree")
    until = F.sum("n").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    runs = runs.select("tree", "part", (until - F.col("n") - F.col("first")).alias("base"),
                       F.sum("n").over(tree).alias("leaves"))  # a row per tree and partition
    return ranged.withColumn("part", part).join(runs, ["tree", "part"]).withColumn(
        "place", F.col("base") + F.col("at")).drop("part", "base", "at")


def _subtrees(nodes: DataFrame) -> DataFrame:
    """(tree, place of the subtree, leaves: nodes of the whole level, l0 .. l4): the levels of
    every aligned subtree, regenerated from its stored nodes; a level past the last is null."""
    grouped = nodes.groupBy("tree", F.floor(F.col("place") / SPAN).cast("bigint").alias("above")).agg(
        F.max("leaves").alias("leaves"), F.sort_array(F.collect_list(F.struct("place", "hash"))).alias("held"))
    out = grouped.select("tree", "above", "leaves", F.col("held.hash").alias("l0"))
    reach = 1
    for k in range(1, STEP + 1):  # a level is made while the one below has more than one node
        out = out.withColumn(f"l{k}", F.when(F.col("leaves") > reach, _above(F.col(f"l{k - 1}"))))
        reach *= FAN
    return out


def build(leaves: DataFrame) -> list[DataFrame]:
    """The stored levels (tree, place, hash, leaves: nodes of the level in the tree), from the
    leaves up to the one node of each tree. ``leaves``: tree, hash, place, leaves."""
    levels = [leaves.select("tree", "place", "hash", "leaves")]
    while levels[-1].where("leaves > 1").limit(1).count():
        made = _subtrees(levels[-1].where("leaves > 1"))
        top = F.coalesce(*[F.col(f"l{k}") for k in range(STEP, -1, -1)])[0]
        up = made.select("tree", F.col("above").alias("place"), top.alias("hash"),
                         F.ceil(F.col("leaves") / SPAN).cast("bigint").alias("leaves"))
        levels.append(stage(up, "merkle-level"))
    return levels


def tops(levels: list[DataFrame]) -> DataFrame:
    """(tree, top): the last node of every tree."""
    out = levels[0].where("leaves = 1")
    for level in levels[1:]:
        out = out.unionByName(level.where("leaves = 1"))
    return out.select("tree", F.col("hash").alias("top"))


def _siblings(level: Column, place: Column) -> Column:
    """The other nodes of a node's run, before and after it."""
    at = F.pmod(place, F.lit(FAN)).cast("int")
    start = (place - at).cast("int")
    return F.struct(_joined(level, start + 1, at).alias("left"),
                    _joined(level, start + at + 2, FAN - 1 - at).alias("right"))


def _segments(nodes: DataFrame) -> DataFrame:
    """(tree, place, steps): for every stored node the siblings on the way to the next stored
    level, as an array of (left, right)."""
    made = _subtrees(nodes.where("leaves > 1"))
    def steps(at: Column) -> Column:
        own = [F.when(F.col(f"l{k + 1}").isNotNull(), _siblings(F.col(f"l{k}"), F.floor(at / FAN ** k)))
               for k in range(STEP)]
        return F.filter(F.array(*own), lambda s: s.isNotNull())

    nodes = F.transform("l0", lambda _, at: F.struct(at.alias("at"), steps(at).alias("steps")))
    return made.select("tree", "above", F.explode(nodes).alias("n")).select(
        "tree", (F.col("above") * SPAN + F.col("n.at")).alias("place"), "n.steps")


def proofs(levels: list[DataFrame]) -> DataFrame:
    """(tree, place, steps): the siblings of every leaf on the way to the last node of its tree."""
    found = None
    for level in reversed(levels):
        own = _segments(level)
        if found is not None:
            above = found.select("tree", F.col("place").alias("above"), F.col("steps").alias("rest"))
            own = own.withColumn("above", F.floor(F.col("place") / SPAN).cast("bigint")).join(
                above, ["tree", "above"], "left").select(
                    "tree", "place", F.concat("steps", F.coalesce("rest", F.expr(NONE))).alias("steps"))
        found = own
    return found


def fold(leaf: Column, steps: Column) -> Column:
    """The last node that a leaf and its siblings give."""
    return F.aggregate(steps, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def manifest(docs: DataFrame, changed_text: Column | None = None, id_col: str = "doc_id", group_col: str = "source",
             fields: tuple[str, ...] = FIELDS, text_col: str = "text") -> DataFrame:
    """One row per document: id, leaf, subroot, root, steps (siblings up to the root), and
    folded_root: what the siblings give with the leaf of ``changed_text`` instead of the text."""
    changed = F.col(text_col) if changed_text is None else changed_text
    rows = docs.select(
        # Names keep their order; no name is null.
        F.coalesce(F.concat(F.lit("="), F.col(group_col)), F.lit("")).alias("tree"), F.col(id_col).alias("key"),
        leaf_hash(*[F.col(f) for f in fields]).alias("hash"), F.col(id_col).alias("id"),
        leaf_hash(*[changed if f == text_col else F.col(f) for f in fields]).alias("seen"))
    leaves = stage(positions(rows), "merkle-placed")
    levels = build(leaves)
    subroots = stage(tops(levels), "merkle-subroots")
    over = positions(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("key"), F.col("top").alias("hash"),
                                     F.col("tree").alias("group")))
    over = stage(over, "merkle-groups")
    upper = build(over)
    root = (tops(upper).first() or (None, None))[1]  # one row
    last = over.join(proofs(upper).select("place", "steps"), "place", "left").select(
        F.col("group").alias("tree"), F.col("hash").alias("subroot"), F.col("steps").alias("rest"))
    last = stage(last, "merkle-upper").withColumn("root", F.lit(root).cast("string"))
    steps = F.concat(F.coalesce("steps", F.expr(NONE)), F.coalesce("rest", F.expr(NONE)))
    return leaves.join(proofs(levels), ["tree", "place"], "left").join(last, "tree").select(
        F.col("id").alias(id_col), F.col("hash").alias("leaf"), "subroot", "root", steps.alias("steps"), "seen"
    ).withColumn("folded_root", fold(F.col("seen"), F.col("steps"))).drop("seen")
