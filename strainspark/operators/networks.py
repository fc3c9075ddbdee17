"""Degree-keeping shuffles of edges, p-values of a network's edges, and merging of clusters by their markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strainspark.functions.numeric import ratio
from strainspark.operators.markers import centroids
from strainspark.operators.ranking import first_of
from strainspark.scratch import Scratch


def _number(*parts: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[F.coalesce(x.cast("string"), F.lit("")) for x in parts])), 1, 15), 16, 10).cast("long")


def _exchanged(pairs: DataFrame, seed: str, turn: int) -> DataFrame:
    """One turn of (k, group, a, b): edges of one shuffle and group are paired, and each pair swaps its ends b where that makes no repeated edge.

    Edges are dealt into pairs by their places in a random order, within buckets of
    about 1,000 edges drawn by hash, so that no group is ordered as a whole; an odd one
    out waits.  A swap stands if neither new edge is there already, nor proposed by
    another swap, of which the one with the smaller number stands.
    """
    draw = lambda *x: _number(F.lit(f"{seed}/{turn}"), *x)
    size = F.ceil(F.col("edges") / 1000)
    marked = pairs.withColumn("bucket", F.pmod(draw(F.lit("bucket"), F.col("k"), F.col("a"), F.col("b")), size)).withColumn("u", draw(F.lit("order"), F.col("k"), F.col("a"), F.col("b")))
    place = F.row_number().over(Window.partitionBy("k", "group", "bucket").orderBy("u", "a", "b")) - 1
    marked = marked.withColumn("pair", F.floor(place / 2)).withColumn("second", place % 2)
    one, other = (marked.filter(F.col("second") == s).select("k", "group", "bucket", "pair", F.col("a").alias(f"a{s}"), F.col("b").alias(f"b{s}")) for s in (0, 1))
    swaps = one.join(other, ["k", "group", "bucket", "pair"]).filter("a0 <> a1 AND b0 <> b1").withColumn("swap", F.xxhash64("group", "bucket", "pair"))
    made = swaps.select("k", "swap", F.explode(F.array(F.struct(F.col("a0").alias("a"), F.col("b1").alias("b")), F.struct(F.col("a1").alias("a"), F.col("b0").alias("b")))).alias("e")).select("k", "swap", "e.a", "e.b")
    there = made.join(pairs.select("k", "a", "b"), ["k", "a", "b"], "left_semi").select("k", "swap")
    first = made.groupBy("k", "a", "b").agg(F.min("swap").alias("least"))
    late = made.join(first, ["k", "a", "b"]).filter("swap > least").select("k", "swap")
    kept = swaps.join(there.union(late).distinct(), ["k", "swap"], "left_anti")
    moves = kept.select("k", F.explode(F.array(F.struct(F.col("a0").alias("a"), F.col("b0").alias("b"), F.col("b1").alias("to")), F.struct(F.col("a1").alias("a"), F.col("b1").alias("b"), F.col("b0").alias("to")))).alias("e")).select("k", "e.a", "e.b", "e.to")
    return pairs.join(moves, ["k", "a", "b"], "left").withColumn("b", F.coalesce("to", "b")).drop("to")


def shuffled_edges(edges: DataFrame, shuffles: int, scratch: Scratch, seed: str = "1", turns: int = 20) -> DataFrame:
    """(k, group, a, b) for each shuffle k from 1: the distinct edges (a, b), or (group, a, b), with their ends exchanged.

    Every node keeps its number of edges and no edge is repeated; with a ``group``, ends
    are exchanged within it only.  All shuffles take their turns together, each turn a table.
    """
    if "group" not in edges.columns:
        edges = edges.withColumn("group", F.lit(0))
    own = edges.select("group", "a", "b").distinct()
    sizes = own.groupBy("group").agg(F.count("*").alias("edges"))
    current = own.join(sizes, "group").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(shuffles)))).select("k", "group", "a", "b", "edges")
    for turn in range(turns):
        current = scratch.keep(_exchanged(current, seed, turn), f"turn{turn}")
        scratch.drop(f"turn{turn - 1}")
    return current.select("k", "group", "a", "b")


def cell_graph(edges: DataFrame, *by: str) -> DataFrame:
    """(by, a, b, weight): between two groups of cells the distinct ligands plus the distinct receptors of (by, lcell, rcell, lig, rec), both directions summed."""
    one = edges.groupBy(*by, F.col("lcell").alias("a"), F.col("rcell").alias("b")).agg((F.countDistinct("lig") + F.countDistinct("rec")).alias("w"))
    turned = one.select(*by, F.col("b").alias("a"), F.col("a").alias("b"), "w")
    return one.unionByName(turned).groupBy(*by, "a", "b").agg(F.sum("w").alias("weight"))


def network_pvalues(edges: DataFrame, scratch: Scratch, shuffles: int = 100, seed: str = "1", turns: int = 20) -> DataFrame:
    """(a, b, weight, pval): of each two groups of cells the share of shuffled networks in which they are joined as strongly.

    ``edges``: (lcell, rcell, lig, rec).  In a shuffle the ligands' cells are exchanged
    among the distinct (lcell, lig), the receptors' among the distinct (rcell, rec); every
    edge then takes the new cells of both.  Pairs without an edge aren't returned.
    """
    edges = scratch.keep(edges.select("lcell", "rcell", "lig", "rec").distinct(), "edges")

    def moved(cell: str, gene: str) -> DataFrame:
        """(k, cell, gene, new_cell): the i-th of a gene's cells becomes the i-th of its shuffled ones."""
        own = edges.select(F.col(gene).alias("a"), F.col(cell).alias("b")).distinct()
        drawn = shuffled_edges(own, shuffles, Scratch(scratch.spark, cell), f"{seed}/{cell}", turns)
        numbered = lambda x, *by: x.withColumn("i", F.row_number().over(Window.partitionBy(*by, "a").orderBy("b")))
        met = numbered(drawn.select("k", "a", "b"), "k").select("k", "a", "i", F.col("b").alias(f"new_{cell}")).join(numbered(own), ["a", "i"])
        return met.select("k", F.col("b").alias(cell), F.col("a").alias(gene), f"new_{cell}")

    left, right = scratch.keep(moved("lcell", "lig"), "left"), scratch.keep(moved("rcell", "rec"), "right")
    new = edges.join(left, ["lcell", "lig"]).join(right, ["k", "rcell", "rec"]).select("k", F.col("new_lcell").alias("lcell"), F.col("new_rcell").alias("rcell"), "lig", "rec")
    true, null = cell_graph(edges), cell_graph(new, "k")
    met = true.join(null.select("k", "a", "b", F.col("weight").alias("w")), ["a", "b"], "left")
    return met.groupBy("a", "b", "weight").agg((F.sum(F.when(F.col("w") >= F.col("weight"), 1).otherwise(0)) / F.lit(shuffles)).alias("pval"))


def merged_clusters(cells: DataFrame, counts: DataFrame, scratch: Scratch, markers: int = 10, least_auc: float = 0.65, batches: int = 3, batch_share: float = 1.0, fold: float = 2.0) -> tuple[DataFrame, list[tuple]]:
    """((cell, ident), merges): clusters that are each other's nearest merged while they can't be told apart.

    ``cells``: (cell, ident, batch, v), v the cell's place; ``counts``: (cell, gene, value), absent
    values being 0.  In a round, mutually nearest clusters by their mean places are
    tested together: they merge if the ``batches`` largest batches of either hold
    ``batch_share`` of it, or if the ``markers``-th best gene of neither side, of the genes
    whose means differ by ``fold`` or more, has an AUC of ``least_auc``.  Such pairs share no
    cluster, so they are contracted together; rounds go on until none merges.  A
    pair is named by its smaller name; a pair that was refused isn't tested again.
    """
    state, refused, merges, turn = scratch.keep(cells.select("cell", F.col("ident").cast("string").alias("ident"), "batch", "v"), "cells0"), set(), [], 0
    while True:
        means = centroids(state.select(F.col("ident").alias("label"), "v"))
        x, y = means.select("place", F.col("label").alias("a"), F.col("mean").alias("x")), means.select("place", F.col("label").alias("b"), F.col("mean").alias("y"))
        far = x.join(y, "place").filter("a <> b").groupBy("a", "b").agg(F.sum((F.col("x") - F.col("y")) * (F.col("x") - F.col("y"))).alias("d"))
        near = first_of(far, ["a"], [F.round("d", 12), F.asc("b")])
        back = near.select(F.col("a").alias("b"), F.col("b").alias("a"))
        mutual = [(r["a"], r["b"]) for r in near.join(back, ["a", "b"]).filter("a < b").select("a", "b").collect()]  # half the clusters at most
        open_pairs = [p for p in mutual if p not in refused]
        if not open_pairs:
            return state.select("cell", "ident"), merges
        pairs = scratch.keep(state.sparkSession.createDataFrame(open_pairs, "a string, b string"), f"pairs{turn}")
        sizes = state.groupBy("ident", "batch").agg(F.count("*").alias("n"))
        top = sizes.withColumn("i", F.row_number().over(Window.partitionBy("ident").orderBy(F.desc("n"), "batch"))).groupBy("ident").agg(F.sum(F.when(F.col("i") <= batches, F.col("n"))).alias("top"), F.sum("n").alias("n"))
        dominated = {r["ident"] for r in top.filter(F.col("top") >= batch_share * F.col("n")).select("ident").collect()}
        alike = _alike(state, counts, pairs, markers, least_auc, fold)
        joined = [p for p in open_pairs if p[0] in dominated or p[1] in dominated or p in alike]
        refused |= set(open_pairs) - set(joined)
        if joined:
            merges += joined
            names = state.sparkSession.createDataFrame([(b, a) for a, b in joined], "ident string, into string")
            turn += 1
            state = scratch.keep(state.join(names, "ident", "left").select("cell", F.coalesce("into", "ident").alias("ident"), "batch", "v"), f"cells{turn}")
            # A contracted cluster has another mean and other cells: pairs of it are open again.
            touched = {x for p in joined for x in p}
            refused = {p for p in refused if not touched & set(p)}


def _alike(state: DataFrame, counts: DataFrame, pairs: DataFrame, markers: int, least_auc: float, fold: float) -> set[tuple]:
    """Pairs (a, b) of which neither side has ``markers`` genes of an AUC of ``least_auc`` or more."""
    sides = pairs.select("a", "b", F.col("a").alias("ident"), F.lit(1).alias("one")).union(pairs.select("a", "b", F.col("b"), F.lit(0)))
    members = state.select("cell", "ident").join(F.broadcast(sides), "ident")  # as many rows as clusters
    sizes = members.groupBy("a", "b").agg(F.sum("one").alias("n1"), F.count("*").alias("n"))
    stored = counts.filter("value <> 0").join(members, "cell").select("a", "b", "one", "gene", F.col("value").cast("double").alias("value"))
    # Absent values are one tied value: ranks come from the distinct values' numbers of cells.
    by = stored.groupBy("a", "b", "gene", "value").agg(F.sum("one").alias("k1"), F.count("*").alias("k"))
    sums = by.groupBy("a", "b", "gene").agg(F.sum("k1").alias("s1"), F.sum("k").alias("s"), F.sum(F.col("value") * F.col("k1")).alias("v1"), F.sum(F.col("value") * (F.col("k") - F.col("k1"))).alias("v0")).join(sizes, ["a", "b"])
    zeros = sums.select("a", "b", "gene", F.lit(0.0).alias("value"), (F.col("n1") - F.col("s1")).alias("k1"), (F.col("n") - F.col("s")).alias("k"))
    below = F.sum("k").over(Window.partitionBy("a", "b", "gene").orderBy("value").rowsBetween(Window.unboundedPreceding, -1))
    ranked = by.unionByName(zeros).withColumn("r", F.coalesce(below, F.lit(0)) + (F.col("k") + 1) / 2)
    ranks = ranked.groupBy("a", "b", "gene").agg(F.sum(F.col("k1") * F.col("r")).alias("r1"))
    scored = sums.join(ranks, ["a", "b", "gene"])
    n0 = F.col("n") - F.col("n1")
    area = ratio(F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2, F.col("n1") * n0)
    m1, m0 = F.col("v1") / F.col("n1"), F.col("v0") / n0
    differs = (F.greatest(m1, m0) >= fold * F.least(m1, m0)) & (m1 != m0)
    found = scored.filter(differs).groupBy("a", "b").agg(F.sum(F.when(area >= least_auc, 1).otherwise(0)).alias("high"), F.sum(F.when(area <= 1 - least_auc, 1).otherwise(0)).alias("low"))
    told = pairs.join(found, ["a", "b"], "left").filter((F.coalesce("high", F.lit(0)) < markers) & (F.coalesce("low", F.lit(0)) < markers))
    return {(r["a"], r["b"]) for r in told.collect()}
