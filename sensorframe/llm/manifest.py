"""Merkle manifest of a dataset with nested-interval labels.

Every node of a tree carries the interval ``[lo, hi)`` of the leaf ranks it covers and that of its parent, so an
ancestor is a node whose interval contains another's, and a node's sibling is what its parent covers and it does not.
Levels are cut into bands. A band's nodes are bucketed by the node of its top level that contains them, 64 base nodes
in a bucket at most however large a tree is, and a join inside the buckets attaches to every base node the levels above
it. The buckets' roots are the base of the next band, so a tree of n leaves takes log64(n) bands, each a 64th of the one
below, and a path is put together from the top down by one join per band.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..scratch import pin
from .common import rank_in_groups

#: Levels of a band; a bucket holds at most 2 ** BAND base nodes.
BAND = 6

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def row_digest(fields: Sequence[Column]) -> Column:
    """SHA-256 of a row: each field as its UTF-8 byte count, a colon and the value, or ``-`` for null."""
    texts = [field.cast("string") for field in fields]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def tree_key(group: Column) -> Column:
    """A key without null that sorts as the group does, null first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("-"))


def _joined(below: Column):
    def node(i: Column) -> Column:
        left, right = F.get(below, 2 * i), F.get(below, 2 * i + 1)
        digest = F.sha2(F.concat(left["digest"], F.coalesce(right["digest"], F.lit(""))), 256)
        return F.struct(left["lo"].alias("lo"), F.coalesce(right["hi"], left["hi"]).alias("hi"), digest.alias("digest"))

    return node


def _labelled(level: int, above: Column):
    def node(x: Column, i: Column) -> Column:
        parent = F.get(above, F.shiftright(i, 1))
        own = [F.lit(level).alias("level"), *[x[c].alias(c) for c in ("lo", "hi", "digest")]]
        return F.struct(*own, parent["lo"].alias("plo"), parent["hi"].alias("phi"))

    return node


def _band_of(base: DataFrame, band: int) -> DataFrame:
    """All nodes of one band from its base nodes ``(tree, lo, hi, digest)``; ``plo`` and ``phi`` are null for a bucket's root."""
    bucketed = base.withColumn("bucket", F.shiftright("lo", (band + 1) * BAND))
    nodes = bucketed.groupBy("tree", "bucket").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "digest"))).alias("n0"))
    # A tree that fits a bucket ends where one node is left. In others every bucket has all levels of the band.
    size = F.size("n0")
    narrow = (F.col("bucket") == 0) & (size < 1 << BAND)
    height = F.when(narrow, sum(((size > 1 << k).cast("int") for k in range(BAND)), F.lit(0))).otherwise(F.lit(BAND))
    nodes = nodes.withColumn("height", height)
    for k in range(BAND):
        runs = F.sequence(F.lit(0), F.shiftright(F.size(f"n{k}") + 1, 1) - 1)
        nodes = nodes.withColumn(f"n{k + 1}", F.when(F.col("height") > k, F.transform(runs, _joined(F.col(f"n{k}")))))
    nodes = nodes.withColumn(f"n{BAND + 1}", F.lit(None).cast(nodes.schema["n0"].dataType))
    levels = [F.transform(f"n{k}", _labelled(band * BAND + k, F.col(f"n{k + 1}"))) for k in range(BAND + 1)]
    return nodes.select("tree", "bucket", F.inline(F.flatten(F.array_compact(F.array(*levels)))))


@dataclass(frozen=True)
class Forest:
    """Trees over ranked leaves: the nodes of each band, and one root ``(tree, lo, hi, digest)`` per tree."""

    bands: tuple[DataFrame, ...]
    roots: DataFrame

    def nodes(self) -> DataFrame:
        """``tree, level, lo, hi, digest, plo, phi`` of every node, each once: what a manifest stores."""
        labelled = [nodes.where("plo is not null") for nodes in self.bands]
        roots = self.roots.select("tree", F.lit(None).cast("int").alias("level"), "lo", "hi", "digest", *[F.lit(None).cast("long").alias(c) for c in ("plo", "phi")])
        return reduce(DataFrame.unionByName, [nodes.drop("bucket") for nodes in labelled], roots)


def grow(leaves: DataFrame, label: str) -> Forest:
    """The trees of ``leaves(tree, rank, digest)``, ranks gapless from 0 in each tree; written band by band."""
    widest = (leaves.agg(F.max("rank")).first()[0] or 0) + 1
    base = leaves.select("tree", F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "digest")
    bands = []
    while widest > 1:
        bands.append(pin(_band_of(base, len(bands)), label))
        base = bands[-1].where("plo is null").select("tree", "lo", "hi", "digest")
        widest = -(-widest // (1 << BAND))
    return Forest(tuple(bands), base)


def _steps(base: DataFrame, nodes: DataFrame, above: DataFrame, band: int) -> DataFrame:
    """``base(tree, lo, …)`` with ``steps`` to the root and the further columns of ``above(tree, lo, steps, …)``, the bucket roots.

    One step per level: the digest on the ``left`` or ``right`` of the node, neither where it is alone below its parent.
    """
    own = base.withColumns({"hi": F.col("lo") + F.lit(1 << band * BAND), "bucket": F.shiftright("lo", (band + 1) * BAND)})
    names = own.columns
    n = nodes.where("plo is not null").select(*[F.col(c).alias(f"n_{c}") for c in ("tree", "bucket", "level", "lo", "hi", "digest", "plo", "phi")])
    # The parent contains this node, and the other child is what is left of the parent's interval, if anything is.
    inside = (F.col("n_plo") <= F.col("lo")) & (F.col("lo") < F.col("n_phi"))
    before, after = F.col("n_hi") <= F.col("lo"), F.col("n_lo") > F.col("lo")
    alone = (F.col("n_lo") == F.col("n_plo")) & (F.col("n_hi") == F.col("n_phi"))
    joined = own.join(n, (F.col("tree") == F.col("n_tree")) & (F.col("bucket") == F.col("n_bucket")) & inside & (before | after | alone), "left")
    step = F.struct(F.col("n_level").alias("level"), F.when(before, F.col("n_digest")).alias("left"), F.when(after, F.col("n_digest")).alias("right"))
    carried = [c for c in names if c not in ("tree", "bucket", "lo", "hi")]
    grouped = joined.groupBy("tree", "bucket", "lo").agg(
        *[F.first(c).alias(c) for c in carried], F.sort_array(F.collect_list(F.when(F.col("n_level").isNotNull(), step))).alias("own_steps")
    )
    plain = F.transform("own_steps", lambda s: F.struct(s["left"].alias("left"), s["right"].alias("right")))
    top = above.select(F.col("tree").alias("t_tree"), F.shiftright("lo", (band + 1) * BAND).alias("t_bucket"), *[c for c in above.columns if c not in ("tree", "lo")])
    out = grouped.join(top, (F.col("tree") == F.col("t_tree")) & (F.col("bucket") == F.col("t_bucket")))
    return out.withColumn("steps", F.concat(plain, "steps")).drop("own_steps", "bucket", "t_tree", "t_bucket")


def attach_paths(forest: Forest, leaves: DataFrame, tops: DataFrame) -> DataFrame:
    """``leaves(tree, rank, …)`` with ``steps`` up to where ``tops(tree, steps, …)`` leads and the other columns of ``tops``."""
    above = tops.withColumn("lo", F.lit(0).cast("long"))
    for band in range(len(forest.bands) - 1, -1, -1):
        base = forest.bands[band - 1].where("plo is null").select("tree", "lo") if band else leaves.withColumnRenamed("rank", "lo")
        above = _steps(base, forest.bands[band], above, band)
    if not forest.bands:
        above = leaves.withColumnRenamed("rank", "lo").join(above.drop("lo"), "tree")
    return above.withColumnRenamed("lo", "rank")


def folded(leaf: Column, steps: Column) -> Column:
    """The digest to which a leaf leads along its steps."""

    def up(digest: Column, step: Column) -> Column:
        return F.sha2(F.concat(F.coalesce(step["left"], F.lit("")), digest, F.coalesce(step["right"], F.lit(""))), 256)

    return F.aggregate(steps, leaf, up)


def siblings(steps: Column) -> Column:
    """The digests beside a leaf's path, from the leaf to the root, as an array."""
    return F.filter(F.transform(steps, lambda s: F.coalesce(s["left"], s["right"])), lambda digest: digest.isNotNull())


def merkle_manifest(docs: DataFrame, columns: Sequence[str] = COLUMNS, group_col: str = "lang", order_col: str = "doc_id", carry: Sequence[Column] = ()) -> DataFrame:
    """One row per document: its order column, ``leaf, subroot, root, steps`` and the columns of ``carry``.

    A leaf is the digest of ``columns``. The leaves of each group stand in order, every two neighbours become the digest
    of both, one that is left over that of itself, until one node is left, the ``subroot``; subroots by group, null
    first, lead to ``root`` in the same way. ``steps`` are the siblings up to the root, each on the ``left`` or ``right``
    of the path, neither where there is none.

    Null, empty and very long values are digested as they are, a null group is a group, null order values come first;
    rows alike in the order column stand by their digest, so repeated rows are leaves of their own in any order. An
    empty table gives an empty result; other columns are not read.
    """
    leaves = docs.select(
        tree_key(F.col(group_col)).alias("tree"), F.col(order_col).alias("ordered"), row_digest([F.col(c) for c in columns]).alias("digest"),
        F.struct(F.lit(True).alias("held"), *carry).alias("carried"),
    )
    leaves = pin(rank_in_groups(pin(leaves, "leaves"), ["tree"], ["ordered", "digest"], "ranked-leaves"), "ranked-leaves")
    forest = grow(leaves, "merkle-band")
    subroots = forest.roots.select("tree", F.col("digest").alias("subroot"))
    ranked = rank_in_groups(pin(subroots, "subroots"), [], ["tree"], "ranked-subroots")
    top_leaves = pin(ranked.select(F.lit("").alias("tree"), "rank", F.col("subroot").alias("digest"), F.col("tree").alias("below")), "subroots")
    top = grow(top_leaves, "merkle-top")
    no_steps = F.array().cast("array<struct<left:string,right:string>>")
    roots = top.roots.select("tree", F.col("digest").alias("root"), no_steps.alias("steps"))
    tops = attach_paths(top, top_leaves.withColumnRenamed("digest", "subroot"), roots).select(F.col("below").alias("tree"), "subroot", "root", "steps")
    placed = attach_paths(forest, leaves.withColumnRenamed("digest", "leaf"), pin(tops, "merkle-tops"))
    return placed.select(F.col("ordered").alias(order_col), "leaf", "subroot", "root", "steps", "carried.*").drop("held")
