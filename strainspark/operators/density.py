"""Down-sampling that thins dense places more than sparse ones."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strainspark.operators.graphs import BUCKET, knn_graph
from strainspark.scratch import Scratch


def solved_rates(crowds: np.ndarray, cells: np.ndarray, remove: float) -> np.ndarray:
    """The rates (c / p) ** (1 / (p - 1)) of the crowd sizes p, for the c with which they remove ``remove`` of all cells.

    c is at most the smallest p, so no rate is over 1; where even that removes too
    few, it stays there.  A cell in nobody's neighbourhood (p = 1) has rate 0.
    """
    alone = crowds <= 1
    some = np.where(alone, 2, crowds).astype(float)

    def rates(log_c: float) -> np.ndarray:
        return np.where(alone, 0.0, np.minimum(1.0, np.exp((log_c - np.log(some)) / (some - 1))))

    low, high = -700.0, float(np.log(some[~alone].min())) if (~alone).any() else 0.0
    if (rates(high) * cells).sum() <= remove:
        return rates(high)
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if (rates(middle) * cells).sum() < remove else (low, middle)
    return rates(high)


def deletion_rates(cells: DataFrame, quotas: DataFrame, scratch: Scratch, k: int = 10, bucket: int = BUCKET) -> DataFrame:
    """(cell, ident, crowd, rate) of (cell, ident, v): a cell's crowd is one more than how many cells of its group have it among their ``k`` nearest.

    ``quotas``: (ident, quota), cells to keep.  The rate comes from the numbers of cells of
    each crowd size, a few rows a group.  Groups within their quota, or without one, have rate 0.
    """
    near = knn_graph(cells.select(F.col("cell").alias("id"), "v", "ident"), k, scratch, bucket, within="ident")
    crowd = near.groupBy(F.col("id").alias("cell")).agg((F.count("*") + 1).alias("crowd"))
    held = scratch.keep(cells.select("cell", "ident").join(crowd, "cell", "left").withColumn("crowd", F.coalesce("crowd", F.lit(1))), "crowds")
    sizes = held.groupBy("ident", "crowd").agg(F.count("*").alias("n")).join(quotas, "ident")
    kind = dict(cells.dtypes)["ident"]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        n = pdf["n"].to_numpy(float)
        return pd.DataFrame({"ident": pdf["ident"], "crowd": pdf["crowd"], "rate": solved_rates(pdf["crowd"].to_numpy(), n, max(0.0, n.sum() - pdf["quota"].iat[0])) if n.sum() > pdf["quota"].iat[0] else np.zeros(len(n))})

    rates = sizes.groupBy("ident").applyInPandas(solve, f"ident {kind}, crowd long, rate double")
    return held.join(rates, ["ident", "crowd"], "left").select("cell", "ident", "crowd", F.coalesce("rate", F.lit(0.0)).alias("rate"))


def density_downsampled(cells: DataFrame, quotas: DataFrame, scratch: Scratch, k: int = 10, around: int = 50, bucket: int = BUCKET) -> DataFrame:
    """(cell, ident, crowd, rate, kept) of (cell, ident, depth, v): a cell stays if its depth reaches that of enough cells around it.

    Of its ``around`` nearest cells of its group, the share given by its deletion rate
    must not be deeper.  A cell without neighbours stays.
    """
    rates = scratch.keep(deletion_rates(cells, quotas, scratch, k, bucket), "rates")
    near = knn_graph(cells.select(F.col("cell").alias("id"), "v", "ident"), around, Scratch(scratch.spark, "around"), bucket, within="ident")
    depth = cells.select("cell", "depth")
    met = near.select(F.col("q").alias("cell"), "id").join(depth, "cell").join(depth.select(F.col("cell").alias("id"), F.col("depth").alias("other")), "id")
    beats = met.groupBy("cell").agg(F.sum((F.col("depth") >= F.col("other")).cast("int")).alias("beats"), F.count("*").alias("seen"))
    return rates.join(beats, "cell", "left").select("cell", "ident", "crowd", "rate", F.coalesce(F.col("beats") >= F.col("rate") * F.col("seen"), F.lit(True)).alias("kept"))
