"""Merkle manifest of a dataset: digests of rows, of runs of digests, and proofs that a row belongs.

Every row is a leaf. Per language the leaves stand in the order of their ids and
are numbered; a node is labelled with the interval of leaf numbers it covers, so
intervals nest. Runs of ``ARITY`` neighbours form a parent until one node, the
subroot, is left; the subroots of the languages form the root in the same way.

Going down again, each level's nodes find their parent by a join on the level's
bucket (leaf number divided by the level's width), checked by containment of the
intervals. A node's siblings are what is left of its parent's children without
its own interval. A leaf joins its parent only, which brings the whole path; so
the paths of all levels move once, with an eighth of the rows.

Unusual rows. A null in any column counts as ``-``; null languages form a tree of
their own. Rows with a null or repeated id are leaves like others: they follow the
order of id (null first) and digest, and equal rows are told apart at random, which
changes no digest. Empty texts are texts of length 0. Very long texts are hashed
where they are read and never shuffled. An empty table has no leaf, no root and no
row. Columns other than those hashed are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrubline.staging import stage

ARITY = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
RANGE_BITS = 33  # a number from monotonically_increasing_id: the task, then the place in it
PATH = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """``-`` for null, else the count of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """Digest of a row's values, as lowercase hex."""
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def leaves(df: DataFrame, id_col: str = "doc_id", tree_col: str = "lang", fields: Sequence[str] = FIELDS, text_col: str = "text", altered: Column | None = None) -> DataFrame:
    """``(id, tree, leaf, altered)`` of every row, written once.

    ``altered`` is a text that stands in for ``text_col`` in a second digest, null
    where the row is to be taken as it is.
    """
    own = leaf(*[F.col(f"`{f}`") for f in fields])
    other = leaf(*[altered if f == text_col else F.col(f"`{f}`") for f in fields]) if altered is not None else None
    lean = df.select(
        F.col(f"`{id_col}`").alias("id"),
        F.coalesce(F.concat(F.lit("="), F.col(f"`{tree_col}`").cast("string")), F.lit("")).alias("tree"),
        own.alias("leaf"),
        (F.when(altered.isNotNull(), other) if altered is not None else F.lit(None).cast("string")).alias("altered"),
    )
    return stage(lean, "leaves")


def _ranked(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``lo``, the place within the tree, and ``n``, the tree's size.

    The rows are sorted in ranges; a tree may hold most rows and spans many
    ranges, whose counts are added up in a table of one row per tree and range.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["tree", *order, "_tie"]
    by = [F.col(c).asc_nulls_first() for c in keys]
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    sorted_rows = tied.repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("_tie")
    placed = stage(sorted_rows.withColumn("_place", F.monotonically_increasing_id()), "leaf-order").withColumn("_range", F.shiftright("_place", RANGE_BITS))
    runs = placed.groupBy("tree", "_range").agg(F.min("_place").alias("_first"), F.count("*").alias("_count"))
    w = Window.partitionBy("tree")
    runs = runs.withColumn("n", F.sum("_count").over(w)).withColumn("_before", F.sum("_count").over(w.orderBy("_range")) - F.col("_count"))
    ranked = placed.join(runs, ["tree", "_range"]).withColumn("lo", F.col("_place") - F.col("_first") + F.col("_before"))
    return ranked.select(*rows.columns, "lo", "n")


@dataclass
class Forest:
    """Trees over ranked leaves.

    ``rows`` are the leaves with all their columns; ``levels[k]`` holds the nodes
    that cover up to ``ARITY ** k`` leaves.
    """

    rows: DataFrame
    levels: list[DataFrame]

    def nodes(self) -> DataFrame:
        """All nodes: level, tree, interval ``[lo, hi)`` of leaf numbers, digest."""
        out = [df.select(F.lit(k).alias("level"), "tree", "lo", "hi", "digest") for k, df in enumerate(self.levels)]
        return _union(out)

    def tops(self) -> DataFrame:
        """The subroot of each tree."""
        return _union([df.where(_is_top()).select("tree", "digest") for df in self.levels])


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _is_top() -> Column:
    return (F.col("lo") == 0) & (F.col("hi") == F.col("n"))


def _bucket(level: int) -> Column:
    return F.expr(f"lo div {ARITY**level}")


def grow(leaf_rows: DataFrame, order: Sequence[str]) -> Forest:
    """The trees of ``leaf_rows`` (``tree``, ``leaf``), whose leaves stand in ``order``."""
    rows = stage(_ranked(leaf_rows, order), "ranked")
    level = rows.select("tree", "lo", (F.col("lo") + 1).alias("hi"), "n", F.col("leaf").alias("digest"))
    most = rows.agg(F.max("n")).first()[0] or 0
    levels, width = [level], 1
    while width < most:
        width *= ARITY
        # at most ARITY children meet in a group, so nothing is hot
        grouped = levels[-1].where(~_is_top()).groupBy("tree", "n", _bucket(len(levels)).alias("bucket")).agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "digest"))).alias("children"))
        parents = grouped.select("tree", F.col("children")[0]["lo"].alias("lo"), F.element_at("children", -1)["hi"].alias("hi"), "n", F.sha2(F.array_join(F.col("children.digest"), ""), 256).alias("digest"), "children")
        levels.append(stage(parents, f"level-{len(levels)}"))
    return Forest(rows, levels)


def _beside(children: Column, test) -> Column:
    return F.array_join(F.transform(F.filter(children, test), lambda c: c["digest"]), "")


def descend(forest: Forest, tops: DataFrame) -> DataFrame:
    """The forest's leaves with ``path``: the siblings left and right of the leaf's ancestors, leaf first.

    ``tops`` (``tree``, ``path`` and more) holds the paths beyond the subroots; its
    other columns come along.
    """
    extra = [c for c in tops.columns if c not in ("tree", "path")]
    known = None
    for k in range(len(forest.levels) - 1, -1, -1):
        is_leaf = k == 0
        nodes = forest.rows.withColumn("hi", F.col("lo") + 1) if is_leaf else forest.levels[k]
        own = nodes.columns
        here = nodes.where(_is_top()).join(tops, "tree").select(*own, "path", *extra)
        if known is not None:
            parents = known.select(
                F.col("tree"), _bucket(k + 1).alias("bucket"), F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi"),
                F.col("children").alias("p_children"), F.col("path").alias("p_path"), *extra,
            )
            below = nodes.where(~_is_top()).withColumn("bucket", _bucket(k + 1)).join(parents, ["tree", "bucket"])
            below = below.where((F.col("p_lo") <= F.col("lo")) & (F.col("hi") <= F.col("p_hi")))
            step = F.struct(
                _beside(F.col("p_children"), lambda c: c["hi"] <= F.col("lo")).alias("left"),
                _beside(F.col("p_children"), lambda c: c["lo"] >= F.col("hi")).alias("right"),
            )
            path = F.concat(F.array(step), "p_path").cast(PATH).alias("path")
            here = here.unionByName(below.select(*own, path, *extra))
        known = here if is_leaf else stage(here, f"paths-{k}")
    return known


def fold(path: Column, start: Column) -> Column:
    """The root that ``start`` leads to along ``path``."""
    return F.aggregate(path, start, lambda digest, step: F.sha2(F.concat(step["left"], digest, step["right"]), 256))


def siblings(path: Column) -> Column:
    """All siblings of a path, level by level and left to right, in one text."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "")


@dataclass
class Manifest:
    """``forest`` over the rows of each tree, ``crown`` over the subroots."""

    forest: Forest
    crown: Forest

    def nodes(self) -> DataFrame:
        """Every node below the root; the crown's trees are named ``*``."""
        return self.forest.nodes().unionByName(self.crown.nodes().withColumn("tree", F.lit("*")))

    def proofs(self) -> DataFrame:
        """``(id, tree, leaf, altered, lo, subroot, root, path)`` of every row."""
        root = self.crown.tops().select("tree", F.col("digest").alias("root"), F.array().cast(PATH).alias("path"))
        crown = descend(self.crown, root)
        tops = crown.select(F.col("name").alias("tree"), F.col("leaf").alias("subroot"), "root", "path")
        return descend(self.forest, stage(tops, "subroots")).select("id", "tree", "leaf", "altered", "lo", "subroot", "root", "path")


def build(leaf_rows: DataFrame) -> Manifest:
    """The manifest of leaves from :func:`leaves`."""
    forest = grow(leaf_rows, ["id", "leaf"])
    subroots = forest.tops().select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("digest").alias("leaf"))
    return Manifest(forest, grow(subroots, ["name"]))


def check(proofs: DataFrame) -> DataFrame:
    """``proofs`` with the root that each row, altered where it is, folds to, and whether that is the manifest's."""
    folded = fold(F.col("path"), F.coalesce("altered", "leaf"))
    return proofs.withColumn("folded_root", folded).withColumn("verified", F.col("folded_root") == F.col("root"))
