"""Cell-level relations: expression by group, markers, interactions, neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strainspark.functions.numeric import ratio


def expression_stats(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """One-vs-rest statistics of every gene and group in one grouped pass.

    ``cells``: (cell, gene, count); ``groups``: (cell, ident).  n: cells that
    express; alpha: their share; total: the group's share of the gene's sum; mu and
    mean: log2 of the mean over the expressing and over all cells; ref_ the same of
    all other cells; log2fc: mean less ref_mean.  Before a logarithm a quarter of
    the least positive count, divided by the number of cells, is added.
    """
    sizes = groups.groupBy("ident").agg(F.count("*").alias("size"))
    all_ = groups.agg(F.count("*").alias("cells"))
    positive = cells.filter("count > 0").join(groups, "cell")
    least = positive.agg(F.min("count").alias("least"))
    by = positive.groupBy("gene", "ident").agg(F.count("*").alias("n"), F.sum("count").alias("sum"))
    gene = Window.partitionBy("gene")
    x = by.join(sizes, "ident").crossJoin(F.broadcast(all_)).crossJoin(F.broadcast(least)).withColumns({"gn": F.sum("n").over(gene), "gt": F.sum("sum").over(gene)})
    rest, zero = F.col("cells") - F.col("size"), F.lit(0.25) * F.col("least") / F.col("cells")
    ref_n, ref_sum = F.col("gn") - F.col("n"), F.col("gt") - F.col("sum")
    log = lambda s, k: F.log2(F.coalesce(ratio(s, k), F.lit(0.0)) + zero)
    x = x.withColumns({"ref_n": ref_n, "alpha": ratio(F.col("n"), F.col("size")), "ref_alpha": ratio(ref_n, rest), "mu": log(F.col("sum"), F.col("n")), "ref_mu": log(ref_sum, ref_n),
                       "mean": log(F.col("sum"), F.col("size")), "ref_mean": log(ref_sum, rest), "total": ratio(F.col("sum"), F.col("gt")), "ref_total": ratio(ref_sum, F.col("gt"))})
    return x.withColumn("log2fc", F.col("mean") - F.col("ref_mean")).select("gene", "ident", "n", "ref_n", "alpha", "ref_alpha", "mu", "ref_mu", "mean", "ref_mean", "total", "ref_total", "log2fc")


def next_stats(stats: DataFrame, families: DataFrame | None = None) -> DataFrame:
    """Adds same_ and next_ columns to (ident, gene, alpha, mu, mean), the means being logarithms.

    ``families`` (ident, family) says which idents belong together; without it each
    stands alone.  same_mean and same_ident are of the gene's largest mean within the
    ident's family, next_mean and next_ident of that outside it; same_log2fc and
    next_log2fc are the family's and the ident's own mean less next_mean, infinite
    where the gene is in no other family.  Of equal means the smaller ident.  Only
    the best row of each gene and family meets the gene's rows.
    """
    x = stats.withColumn("family", F.col("ident")) if families is None else stats.join(families, "ident")
    best = x.groupBy("gene", "family").agg(F.min(F.struct((-F.col("mean")).alias("m"), F.col("ident").alias("i"), F.col("alpha").alias("a"))).alias("__b"))
    order = Window.partitionBy("gene").orderBy("__b")
    two = best.withColumn("__k", F.row_number().over(order)).filter("__k <= 2").groupBy("gene").agg(*[F.max(F.when(F.col("__k") == k, F.struct(F.col("family").alias("f"), F.col("__b").alias("b")))).alias(f"__{k}") for k in (1, 2)])
    out = x.join(best, ["gene", "family"]).join(two, "gene")
    other = F.when(F.col("__1.f") != F.col("family"), F.col("__1.b")).otherwise(F.col("__2.b"))
    out = out.withColumns({"same_mean": -F.col("__b.m"), "same_ident": F.col("__b.i"), "same_alpha": F.col("__b.a"), "next_mean": -other["m"], "next_ident": other["i"], "next_alpha": other["a"]})
    fold = lambda c: F.when(F.col("next_mean").isNull(), F.lit(float("inf"))).otherwise(F.col(c) - F.col("next_mean"))
    return out.withColumns({"same_log2fc": fold("same_mean"), "next_log2fc": fold("mean")}).drop("__b", "__1", "__2", "family")


def specific_everywhere(pairwise: DataFrame) -> DataFrame:
    """(gene, ident) that pass in every pairwise contrast (gene, ident, other, passes)."""
    return pairwise.groupBy("gene", "ident").agg(F.bool_and("passes").alias("all"), F.count("*").alias("contrasts")).filter("all").select("gene", "ident", "contrasts")


def interaction_edges(markers: DataFrame, pairs: DataFrame) -> DataFrame:
    """(lcell, rcell, lig, rec): groups that have all genes of a ligand, and of its receptor.

    ``markers``: (ident, gene); ``pairs``: (lig, rec), complexes joined by +.
    """
    def having(column: str, cell: str) -> DataFrame:
        need = pairs.select(column).distinct().withColumn("gene", F.explode(F.split(column, r"\+"))).withColumn("size", F.size(F.array_distinct(F.split(column, r"\+"))))
        found = need.distinct().join(markers.select("ident", "gene").distinct(), "gene").groupBy(column, "size", "ident").agg(F.count("*").alias("n"))
        return found.filter("n = size").select(column, F.col("ident").alias(cell))

    return pairs.distinct().join(having("lig", "lcell"), "lig").join(having("rec", "rcell"), "rec").select("lcell", "rcell", "lig", "rec")


def interaction_graph(edges: DataFrame) -> DataFrame:
    """(a, b, weight): distinct ligands plus distinct receptors between two groups, in both directions."""
    ligands = edges.groupBy("lcell", "rcell").agg(F.countDistinct("lig").alias("l"), F.countDistinct("rec").alias("r"))
    w = ligands.select(F.col("lcell").alias("a"), F.col("rcell").alias("b"), (F.col("l") + F.col("r")).alias("w"))
    return w.union(w.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy("a", "b").agg(F.sum("w").alias("weight"))


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (id, v) packed, those without a direction with a null similarity to all: their vectors become NaN."""
    for batch in batches:
        if len(batch):
            wide = max((len(x) for x in batch["v"] if x is not None), default=0)
            v = np.full((len(batch), wide), np.nan)
            for k, x in enumerate(batch["v"]):
                if x is not None and len(x) == wide:
                    v[k] = x
            norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
            yield pd.DataFrame({"ids": [batch["id"].to_list()], "m": [(v / np.where(norm > 0, norm, np.nan)).tobytes()]})


def _nearest(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for qs, a, ids, b in batch[["qs", "qm", "ids", "m"]].itertuples(index=False):
                qs, ids = np.asarray(qs), np.asarray(ids)
                order = np.argsort(ids, kind="stable")
                ids, v = ids[order], np.frombuffer(b).reshape(len(ids), -1)[order]
                q = np.frombuffer(a).reshape(len(qs), -1)
                for low in range(0, len(qs), 128):
                    of = qs[low : low + 128]
                    sim = np.round(q[low : low + 128] @ v.T, 9)
                    cost = np.where(np.isnan(sim), np.inf, -sim)
                    same = of[:, None] == ids[None, :]
                    cost = np.where(same, np.nan, cost)  # sorted last, and left out
                    best = np.argsort(cost, axis=1, kind="stable")[:, : k + 1]
                    at = np.repeat(np.arange(len(of)), best.shape[1]), best.ravel()
                    good = ~same[at]
                    yield pd.DataFrame({"q": of[at[0]][good], "id": ids[at[1]][good], "sim": sim[at][good]})

    return run


def nearest(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(q, id, sim, rank): the k most similar vectors of each query by cosine; of equals the smaller id, those without a direction last with a null one.

    All queries meet all vectors, in blocks whose similarities are a product of matrices;
    a pair of blocks gives k rows a query, and what a task holds is two blocks.
    """
    kind = dict(vectors.dtypes)["id"]
    packed = lambda rows: rows.select("id", "v").mapInPandas(_blocks, f"ids array<{kind}>, m binary")
    met = packed(vectors).crossJoin(packed(queries).withColumnsRenamed({"ids": "qs", "m": "qm"}))
    dealt = met.repartition(4 * vectors.sparkSession.sparkContext.defaultParallelism, F.xxhash64("ids", "qs"))
    found = dealt.mapInPandas(_nearest(k), f"q {kind}, id {kind}, sim double").withColumn("sim", F.nanvl("sim", F.lit(None).cast("double")))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "id")))
    return ranked.filter(F.col("rank") <= k)


def neighbour_jaccard(neighbours: DataFrame) -> DataFrame:
    """(a, b, weight): shared over united neighbours of pairs that share one."""
    sizes = neighbours.groupBy("q").agg(F.count("*").alias("n"))
    x, y = neighbours.select("id", F.col("q").alias("a")), neighbours.select("id", F.col("q").alias("b"))
    both = x.join(y, "id").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("both"))
    out = both.join(sizes.select(F.col("q").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("q").alias("b"), F.col("n").alias("nb")), "b")
    return out.select("a", "b", ratio(F.col("both"), F.col("na") + F.col("nb") - F.col("both")).alias("weight"))


def centroids(vectors: DataFrame) -> DataFrame:
    """(label, place, mean): mean of each component of each label's vectors."""
    return vectors.select("label", F.posexplode("v").alias("place", "x")).groupBy("label", "place").agg(F.avg("x").alias("mean"))


def centroid_distances(means: DataFrame) -> DataFrame:
    """(a, b, distance): Euclidean distances of centroids."""
    x, y = means.select("place", F.col("label").alias("a"), F.col("mean").alias("x")), means.select("place", F.col("label").alias("b"), F.col("mean").alias("y"))
    return x.join(y, "place").filter("a < b").groupBy("a", "b").agg(F.sqrt(F.sum((F.col("x") - F.col("y")) * (F.col("x") - F.col("y")))).alias("distance"))


def doublet_odds(cells: DataFrame) -> DataFrame:
    """Log odds that a cell's depth is of two cells of its group rather than one: Normal(2 mu, 2 var) against Normal(mu, var)."""
    w = Window.partitionBy("ident")
    mu, var = F.avg("depth").over(w), F.var_samp("depth").over(w)
    x = F.col("depth")
    odds = -F.pow(x - 2 * mu, F.lit(2)) / (4 * var) + F.pow(x - mu, F.lit(2)) / (2 * var) - 0.5 * F.log(F.lit(2.0))
    return cells.withColumn("odds", F.when(var > 0, odds))
