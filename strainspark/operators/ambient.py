"""Ambient contamination of groups of cells: a robust line of log means in a group against those of the cells around it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strainspark.functions.numeric import ratio


def reference_means(values: DataFrame, cells: DataFrame) -> DataFrame:
    """(ident, gene, mean, reference): each gene's mean over a group's cells, and over the other cells as the group's samples have them.

    ``values``: (cell, gene, value), absent values being 0; ``cells``: (cell, ident, sample).
    A sample's other cells sum to a value that is divided by all its cells, and samples
    count by their shares of the group's cells.  A gene is listed where a sample of the
    group has it.
    """
    n = cells.groupBy("ident", "sample").agg(F.count("*").alias("n"))
    whole = n.groupBy("sample").agg(F.sum("n").alias("all"))
    shares = n.join(whole, "sample").withColumn("size", F.sum("n").over(Window.partitionBy("ident"))).select("ident", "sample", "all", "size", (F.col("n") / F.col("size")).alias("share"))
    by = values.join(cells, "cell").groupBy("ident", "sample", "gene").agg(F.sum("value").cast("double").alias("s"))
    total = by.groupBy("sample", "gene").agg(F.sum("s").alias("t"))
    around = shares.join(total, "sample").groupBy("ident", "gene").agg(F.sum(F.col("share") * F.col("t") / F.col("all")).alias("r"))
    own = by.join(shares, ["ident", "sample"]).groupBy("ident", "gene").agg((F.sum("s") / F.max("size")).alias("mean"), F.sum(F.col("share") * F.col("s") / F.col("all")).alias("o"))
    met = around.join(own, ["ident", "gene"], "left")
    return met.select("ident", "gene", F.coalesce("mean", F.lit(0.0)).alias("mean"), F.greatest(F.col("r") - F.coalesce("o", F.lit(0.0)), F.lit(0.0)).alias("reference"))


def boundary_genes(means: DataFrame, n: int = 50, bins: int = 10, quantile: float = 0.9, top: int = 100) -> DataFrame:
    """(ident, gene, x, y) of at most ``n`` genes of each group along the lower edge of log2 mean (y) over log2 reference (x).

    x lies above what genes absent from the group reach (their ``quantile``) and below its
    ``top``-th largest value.  In each of ``bins`` bins of equal width the n / bins genes
    of the lowest y - x are taken; of equal ones the smaller gene.
    """
    logged = means.select("ident", "gene", F.when(F.col("mean") > 0, F.log2("mean")).alias("y"), F.when(F.col("reference") > 1e-12, F.log2("reference")).alias("x"))
    low = logged.filter("y IS NULL AND x IS NOT NULL").groupBy("ident").agg(F.percentile("x", F.lit(quantile)).alias("low"))
    order = Window.partitionBy("ident").orderBy(F.desc("x"), "gene")
    high = logged.filter("x IS NOT NULL").withColumn("k", F.row_number().over(order)).filter(F.col("k") <= top).groupBy("ident").agg(F.min("x").alias("high"), F.count("*").alias("many"))
    high = high.select("ident", F.when(F.col("many") == top, F.col("high")).alias("high"))
    inside = logged.filter("x IS NOT NULL AND y IS NOT NULL").join(low, "ident", "left").join(high, "ident", "left").filter("x >= coalesce(low, x) AND x <= coalesce(high, x)")
    ident = Window.partitionBy("ident")
    place = F.floor(ratio(F.col("x") - F.min("x").over(ident), F.max("x").over(ident) - F.min("x").over(ident)) * bins)
    binned = inside.withColumn("bin", F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)))
    k = F.row_number().over(Window.partitionBy("ident", "bin").orderBy(F.col("y") - F.col("x"), "gene"))
    return binned.withColumn("k", k).filter(F.col("k") <= max(1, n // bins)).select("ident", "gene", "x", "y")


def huber_line(x: np.ndarray, y: np.ndarray, bound: float = 1.345, rounds: int = 50) -> tuple[float, float]:
    """(intercept, slope) by reweighting: residuals beyond ``bound`` times their scale, the median over 0.6745, count less."""
    a = np.column_stack([np.ones(len(x)), x])
    beta = np.linalg.lstsq(a, y, rcond=None)[0]
    r = y - a @ beta
    for _ in range(rounds):
        scale = np.median(np.abs(r)) / 0.6745
        if scale < 1e-12:
            break
        w = np.sqrt(np.minimum(1.0, bound * scale / np.maximum(np.abs(r), 1e-300)))
        beta = np.linalg.lstsq(a * w[:, None], y * w, rcond=None)[0]
        before, r = r, y - a @ beta
        if np.sqrt(((before - r) ** 2).sum() / max(1e-20, (before**2).sum())) < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def robust_lines(points: DataFrame) -> DataFrame:
    """(ident, intercept, slope) of each group's points (ident, x, y), few each; null with fewer than three points or one x."""
    kind = dict(points.dtypes)["ident"]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
        enough = len(x) >= 3 and x.max() - x.min() > 1e-9
        order = np.lexsort((y, x))
        a, b = huber_line(x[order], y[order]) if enough else (None, None)
        return pd.DataFrame({"ident": pdf["ident"].iloc[:1], "intercept": pd.array([a], "Float64"), "slope": pd.array([b], "Float64")})

    return points.groupBy("ident").applyInPandas(fit, f"ident {kind}, intercept double, slope double")


def contaminants(means: DataFrame, most: float = 2.0, **choice) -> DataFrame:
    """(ident, gene, x, y, residual, contaminant): how far a gene's log2 mean lies above its group's line; below ``most`` it may come from outside."""
    lines = robust_lines(boundary_genes(means, **choice))
    logged = means.filter("mean > 0 AND reference > 1e-12").select("ident", "gene", F.log2("reference").alias("x"), F.log2("mean").alias("y"))
    residual = F.col("y") - F.col("intercept") - F.col("slope") * F.col("x")
    return logged.join(lines, "ident").select("ident", "gene", "x", "y", residual.alias("residual"), (residual < most).alias("contaminant"))
