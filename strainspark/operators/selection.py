"""Choice of enriched clades: odds of class pairs, contrasts of nested clades, and disjoint clades that stand for a tree.

Clades of one tree overlap only where one lies inside the other, so every choice among
overlapping clades is a join with the tree's ancestry.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strainspark.functions.special import exact_rows
from strainspark.operators.statistics import with_fisher


def clade_odds(counts: DataFrame) -> DataFrame:
    """(tree, node, x, y, odds, pval): for each pair of classes, x < y, their conditional odds ratio inside against outside a clade, with its exact p.

    ``counts``: (tree, node, class, inside, outside).
    """
    side = lambda name, inside, outside: counts.select("tree", "node", F.col("class").alias(name), F.col("inside").alias(inside), F.col("outside").alias(outside))
    pairs = side("x", "a", "c").join(side("y", "b", "d"), ["tree", "node"]).filter("x < y")
    return with_fisher(pairs).select("tree", "node", "x", "y", "odds", "pval")


def largest_log_odds(odds: DataFrame) -> DataFrame:
    """(tree, node, effect): the largest |ln odds| over the class pairs, of those that are finite; null where none is."""
    size = F.abs(F.log(F.when(F.col("odds") > 0, F.col("odds"))))
    finite = F.when(~F.isnan(size) & (size < float("inf")), size)
    return odds.groupBy("tree", "node").agg(F.max(finite).alias("effect"))


def significant_nodes(stats: DataFrame, level: float = 0.05) -> DataFrame:
    """Rows of (tree, node, padj, effect, ...) with padj below ``level`` and a finite effect."""
    effect = F.col("effect")
    return stats.filter((F.col("padj") < level) & effect.isNotNull() & ~F.isnan(effect) & (F.abs(effect) < float("inf")))


def with_exact_rows(rows: DataFrame, whole: str, part: str) -> DataFrame:
    """Adds ``pval``: exact test of the counts in array ``part`` against the rest of those in ``whole``."""

    @F.pandas_udf("double")
    def p(w: pd.Series, x: pd.Series) -> pd.Series:
        return pd.Series([exact_rows(tuple(np.asarray(b, int).tolist()), tuple((np.asarray(a, int) - np.asarray(b, int)).tolist())) for a, b in zip(w, x, strict=True)], dtype=float)

    return rows.withColumn("pval", p(whole, part))


def nested_contrasts(ancestry: DataFrame, nodes: DataFrame) -> DataFrame:
    """(tree, node, below, pval): exact test of a clade's classes against the rest of the clade around it.

    For each two of ``nodes`` (tree, node, effect, counts), the one inside the other and
    of at least its effect; ``counts`` is the array of its tips of each class.  No other
    pair decides on a choice.  ``ancestry``: (tree, node, below).
    """
    outer, inner = nodes.select("tree", "node", F.col("effect").alias("e1"), F.col("counts").alias("c1")), nodes.select("tree", F.col("node").alias("below"), F.col("effect").alias("e2"), F.col("counts").alias("c2"))
    pairs = ancestry.filter("node <> below").join(outer, ["tree", "node"]).join(inner, ["tree", "below"]).filter("e2 >= e1")
    return with_exact_rows(pairs, "c1", "c2").select("tree", "node", "below", "pval")


def topmost(nodes: DataFrame, ancestry: DataFrame) -> DataFrame:
    """The rows of (tree, node, ...) that have none of the others above them."""
    held = nodes.select("tree", F.col("node").alias("above"))
    under = ancestry.filter("node <> below").select("tree", F.col("node").alias("above"), F.col("below").alias("node")).join(held, ["tree", "above"], "left_semi")
    return nodes.join(under.select("tree", "node").distinct(), ["tree", "node"], "left_anti")


def enriched_clades(ancestry: DataFrame, nodes: DataFrame, contrasts: DataFrame, level: float = 0.05) -> DataFrame:
    """(tree, node): disjoint enriched clades.

    A node is passed over if a clade inside it, of at least its effect, differs from
    the rest of it (a contrast below ``level``; a null one counts as 1).  Of the others,
    taken by falling effect, a node inside a taken one is left out, and one around
    taken ones replaces them; whatever the order, those without another above them stay.
    """
    split = contrasts.filter(F.col("pval") < level).select("tree", "node").distinct()
    return topmost(nodes.select("tree", "node").join(split, ["tree", "node"], "left_anti"), ancestry)


def filling_clades(ancestry: DataFrame, sizes: DataFrame, taken: DataFrame, least: int = 11) -> DataFrame:
    """(tree, node): the largest clades of ``least`` tips or more of (tree, node, size, is_tip) that overlap neither ``taken`` nor each other."""
    near = ancestry.join(taken.select("tree", "node"), ["tree", "node"], "left_semi").select("tree", F.col("below").alias("node"))
    over = ancestry.join(taken.select("tree", F.col("node").alias("below")), ["tree", "below"], "left_semi").select("tree", "node")
    free = sizes.filter(~F.col("is_tip") & (F.col("size") >= least)).select("tree", "node").join(near.union(over).distinct(), ["tree", "node"], "left_anti")
    return topmost(free, ancestry)


def selected_clades(edges: DataFrame, ancestry: DataFrame, stats: DataFrame, inner: float = 0.05, outer: float = 0.05, least: int = 11, contrasts: DataFrame | None = None) -> DataFrame:
    """(tree, node, enriched): enriched clades, and around them the largest other ones; a tree without a significant node gives its root.

    ``stats``: (tree, node, padj, effect, counts).  Without ``contrasts`` (tree, node, below,
    pval), of another model say, they are exact tests of the counts.
    """
    nodes = significant_nodes(stats, outer)
    tested = nested_contrasts(ancestry, nodes) if contrasts is None else contrasts
    enriched = enriched_clades(ancestry, nodes, tested, inner)
    known = nodes.select("tree").distinct()
    tips = edges.filter("is_tip").select("tree", F.col("node").alias("below"))
    sizes = ancestry.join(tips, ["tree", "below"]).groupBy("tree", "node").agg(F.count("*").alias("size")).join(edges.select("tree", "node", "is_tip"), ["tree", "node"]).join(known, "tree", "left_semi")
    roots = edges.filter("parent IS NULL").select("tree", "node").join(known, "tree", "left_anti")
    marked = lambda x, flag: x.select("tree", "node", F.lit(flag).alias("enriched"))
    return marked(enriched, True).union(marked(filling_clades(ancestry, sizes, enriched, least), False)).union(marked(roots, False))
