"""Batch effects: shrunken location and scale, and corrections from mutual nearest neighbours of two batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strainspark.functions.numeric import ratio
from strainspark.operators.graphs import BUCKET, cross_knn
from strainspark.scratch import Scratch


def shrunken_batches(matrix: DataFrame, batches: DataFrame, rounds: int = 60) -> DataFrame:
    """(gene, batch, n, centre, spread, location, scale): each gene's batch effects, shrunk towards the batch's over all genes.

    ``matrix``: (sample, gene, value); ``batches``: (sample, batch).  Values are taken
    from the gene's mean over the batches' residual deviation (spread); of what is left, a batch's
    mean has a normal and its variance an inverse-gamma prior, whose parameters are the
    moments of all genes in the batch, and both are the posterior's, found by ``rounds``
    alternations.  Batches of one value of a gene have no variance and aren't shrunk (null); a gene without
    residual deviation isn't returned.  All of it follows from sums by gene and batch.
    """
    rows = matrix.join(batches, "sample").withColumn("value", F.col("value").cast("double"))
    by = rows.groupBy("gene", "batch").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    gene = Window.partitionBy("gene")
    n = F.sum("n").over(gene)
    by = by.withColumns({"centre": F.sum(F.col("n") * F.col("m")).over(gene) / n, "spread": F.sqrt(F.sum(F.col("n") * F.col("v")).over(gene) / n)}).filter("spread > 1e-9")
    by = by.select("gene", "batch", "n", "centre", "spread", ((F.col("m") - F.col("centre")) / F.col("spread")).alias("g"), F.when(F.col("n") > 1, F.col("v") * F.col("n") / (F.col("n") - 1) / (F.col("spread") * F.col("spread"))).alias("d"))
    prior = by.filter("n > 1").groupBy("batch").agg(F.avg("g").alias("gbar"), F.var_samp("g").alias("t2"), F.avg("d").alias("dm"), F.var_samp("d").alias("dv"))
    prior = prior.select("batch", "gbar", "t2", ratio(2 * F.col("dv") + F.col("dm") * F.col("dm"), F.col("dv")).alias("a"), ratio(F.col("dm") * F.col("dv") + F.pow("dm", F.lit(3)), F.col("dv")).alias("b"))
    x = by.join(prior, "batch", "left")

    def turn(state, _):
        location = (F.col("t2") * F.col("n") * F.col("g") + state["d"] * F.col("gbar")) / (F.col("t2") * F.col("n") + state["d"])
        squares = (F.col("n") - 1) * F.col("d") + F.col("n") * (F.col("g") - location) * (F.col("g") - location)
        return F.struct(location.alias("g"), ((0.5 * squares + F.col("b")) / (F.col("n") / 2 + F.col("a") - 1)).alias("d"))

    start = F.struct(F.col("g").alias("g"), F.col("d").alias("d"))
    fitted = F.when((F.col("n") > 1) & (F.col("t2") > 0), F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, turn))
    return x.withColumn("e", fitted).select("gene", "batch", "n", "centre", "spread", F.col("e.g").alias("location"), F.col("e.d").alias("scale"))


def combat_adjusted(matrix: DataFrame, batches: DataFrame, rounds: int = 60) -> DataFrame:
    """(sample, gene, value) without the shrunken effects; a value whose effect isn't known stays as it is."""
    effects = shrunken_batches(matrix, batches, rounds)
    rows = matrix.join(batches, "sample").join(effects, ["gene", "batch"], "left")
    z = (F.col("value") - F.col("centre")) / F.col("spread")
    moved = (z - F.col("location")) / F.sqrt("scale") * F.col("spread") + F.col("centre")
    return rows.select("sample", "gene", F.coalesce(moved, F.col("value").cast("double")).alias("value"))


def mutual_pairs(one: DataFrame, other: DataFrame, k: int, scratch: Scratch, bucket: int = BUCKET) -> DataFrame:
    """(a, b) of the vectors (id, v) of two batches that are among each other's k nearest."""
    there = cross_knn(one, other, k, scratch, bucket).select(F.col("q").alias("a"), F.col("id").alias("b"))
    back = cross_knn(other, one, k, Scratch(scratch.spark, "back"), bucket).select(F.col("id").alias("a"), F.col("q").alias("b"))
    return there.join(back, ["a", "b"])


def _smoothed(width: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """The vector less the kernel-weighted mean of its neighbours' corrections."""
        v = np.array(pdf["v"].iat[0], float)
        near, moves = np.stack(pdf["w"].to_numpy()), np.stack(pdf["move"].to_numpy())
        unit = lambda x: x / np.sqrt((x * x).sum(axis=-1, keepdims=True))
        far = ((unit(near) - unit(v)) ** 2).sum(axis=1)
        weight = np.exp(-(far - far.min()) / width)
        return pd.DataFrame({"id": [pdf["id"].iat[0]], "v": [(v + (weight[:, None] * moves).sum(axis=0) / weight.sum()).tolist()]})

    return run


def neighbour_corrected(vectors: DataFrame, order: list, scratch: Scratch, k: int = 20, smooth: int = 50, width: float = 0.1, bucket: int = BUCKET) -> DataFrame:
    """(id, batch, v) with each batch of ``order`` moved onto those before it.

    ``vectors``: (id, batch, v).  Mutual nearest pairs of a batch and the merged ones
    before it give corrections, the difference of the two vectors, averaged at the
    batch's one; every vector of the batch then moves by the mean of the corrections
    of the ``smooth`` nearest such vectors, weighted by a Gaussian kernel of the squared
    distance of directions over ``width``.  A batch without a mutual pair stays.  Vectors
    without a direction, and batches that aren't listed, are returned as they are.
    """
    kind = dict(vectors.dtypes)["id"]
    merged = scratch.keep(vectors.filter(F.col("batch") == order[0]).select("id", "v"), "merged0")
    for step, batch in enumerate(order[1:], 1):
        own = scratch.keep(vectors.filter(F.col("batch") == batch).select("id", "v"), f"own{step}")
        pairs = mutual_pairs(merged, own, k, Scratch(scratch.spark, "pairs"), bucket)
        met = pairs.join(merged.select(F.col("id").alias("a"), F.col("v").alias("x")), "a").join(own.select(F.col("id").alias("b"), F.col("v").alias("y")), "b")
        moves = met.select("b", F.posexplode(F.zip_with("x", "y", lambda x, y: x - y)).alias("place", "m")).groupBy("b", "place").agg(F.avg("m").alias("m"))
        moves = moves.groupBy("b").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "m"))), lambda x: x["m"]).alias("move"))
        known = scratch.keep(own.join(moves, F.col("id") == F.col("b")).select("id", "v", "move"), f"moves{step}")
        # A vector at which a correction stands is its own nearest one.
        near = cross_knn(own, known, smooth, Scratch(scratch.spark, "near"), bucket).select(F.col("q"), F.col("id").alias("of"))
        gathered = near.join(own.withColumnRenamed("id", "q"), "q").join(known.select(F.col("id").alias("of"), F.col("v").alias("w"), "move"), "of").select(F.col("q").alias("id"), "v", "w", "move")
        moved = scratch.keep(gathered.groupBy("id").applyInPandas(_smoothed(width), f"id {kind}, v array<double>"), f"moved{step}")
        merged = scratch.keep(merged.unionByName(moved).unionByName(own.join(moved.select("id"), "id", "left_anti")), f"merged{step}")
        scratch.drop(f"merged{step - 1}")
    return vectors.drop("v").join(merged, "id").select("id", "batch", "v").unionByName(vectors.filter(~F.col("batch").isin(order) | F.col("batch").isNull()).select("id", "batch", "v"))
