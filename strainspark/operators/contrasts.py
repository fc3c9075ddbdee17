"""Comparisons of classes and batches, conserved columns, labelled points and hierarchical clusters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strainspark.functions.numeric import ratio


def two_part(k1: Column, k0: Column, n1: Column, n0: Column, s1: Column, s0: Column, q: Column) -> tuple[Column, Column]:
    """Likelihood-ratio statistics of detection and level: k of n samples a class are positive, with sums s of logarithms and q of all their squares."""
    term = lambda k, n: F.when(k > 0, k * F.log(k / n)).otherwise(0.0)
    fit = lambda k, n: term(k, n) + term(n - k, n)
    detected = F.greatest(2 * (fit(k1, n1) + fit(k0, n0) - fit(k1 + k0, n1 + n0)), F.lit(0.0))
    whole, apart = q - (s1 + s0) * (s1 + s0) / (k1 + k0), q - ratio(s1 * s1, k1) - ratio(s0 * s0, k0)
    level = F.when((k1 > 0) & (k0 > 0) & (k1 + k0 >= 3) & (apart > 1e-9 * q), F.greatest((k1 + k0) * F.log(whole / apart), F.lit(0.0)))
    return detected, level


def hurdle_tests(matrix: DataFrame, classes: DataFrame, case: str) -> DataFrame:
    """(gene, k1, k0, detected, level, pval): likelihood-ratio tests of a class in a two-part model of stored values.

    ``detected`` compares the shares of samples that have a positive value, ``level`` the
    means of its binary logarithm, both by maximum likelihood; their sum has two degrees of
    freedom, so p is exp(-sum / 2).  ``level`` and p are null where a class has no positive
    value, there are fewer than three, or the classes leave no variance.
    """
    one = F.col("class") == case
    count = lambda x: F.sum(F.when(x, 1.0).otherwise(0.0))
    sizes = classes.agg(count(one).alias("n1"), count(~one).alias("n0"))
    rows = matrix.filter("value > 0").withColumn("v", F.log2(F.col("value").cast("double"))).join(classes, "sample")
    part = lambda x, keep: F.sum(F.when(keep, x).otherwise(0.0))
    v = F.col("v")
    m = rows.groupBy("gene").agg(count(one).alias("k1"), count(~one).alias("k0"), part(v, one).alias("s1"), part(v, ~one).alias("s0"), F.sum(v * v).alias("q"))
    m = m.crossJoin(F.broadcast(sizes))
    k1, k0, n1, n0, s1, s0, q = (F.col(c) for c in ("k1", "k0", "n1", "n0", "s1", "s0", "q"))
    detected, level = two_part(k1, k0, n1, n0, s1, s0, q)
    out = m.select("gene", k1.cast("long").alias("k1"), k0.cast("long").alias("k0"), detected.alias("detected"), level.alias("level"))
    return out.withColumn("pval", F.exp(-(F.col("detected") + F.col("level")) / 2))


def average_precision(rows: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """(by, n1, ap, area): area under the precision-recall curve, at the distinct scores from the highest down; null without class 1.

    ap takes steps, each threshold's precision for the recall it adds; area takes
    trapezoids from a first point of recall and precision 0, rounded to three places.
    """
    at = rows.groupBy(*by, F.col(score).alias("cutoff")).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("p"), F.count("*").alias("n"))
    order = Window.partitionBy(*by).orderBy(F.desc("cutoff"))
    down = order.rowsBetween(Window.unboundedPreceding, 0)
    x = at.withColumns({"tp": F.sum("p").over(down), "seen": F.sum("n").over(down)}).withColumn("precision", ratio(F.col("tp"), F.col("seen")))
    x = x.withColumn("before", F.coalesce(F.lag("precision").over(order), F.lit(0.0)))
    sums = x.groupBy(*by).agg(F.sum("p").alias("n1"), F.sum(F.col("p") * F.col("precision")).alias("s"), F.sum(F.col("p") * (F.col("precision") + F.col("before")) / 2).alias("t"))
    return sums.select(*by, "n1", ratio(F.col("s"), F.col("n1")).alias("ap"), F.round(ratio(F.col("t"), F.col("n1")), 3).alias("area"))


def batch_adjusted(matrix: DataFrame, batches: DataFrame) -> DataFrame:
    """(sample, gene, value): each batch's mean and deviation of a gene become the gene's mean and its deviation within batches.

    A batch without deviation is only moved.  The estimates aren't shrunk towards each other.
    """
    rows = matrix.join(batches, "sample").withColumn("value", F.col("value").cast("double"))
    stats = rows.groupBy("gene", "batch").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("var"))
    genes = stats.groupBy("gene").agg(ratio(F.sum(F.col("n") * F.col("mean")), F.sum("n")).alias("centre"), F.sqrt(ratio(F.sum(F.col("n") * F.col("var")), F.sum("n"))).alias("spread"))
    x = rows.join(stats, ["gene", "batch"]).join(genes, "gene")
    scale = F.when(F.sqrt("var") > 1e-9, F.col("spread") / F.sqrt("var")).otherwise(1.0)
    return x.select("sample", "gene", ((F.col("value") - F.col("mean")) * scale + F.col("centre")).alias("value"))


def conserved_columns(bases: DataFrame, share: float = 0.5, gaps: float = 0.5, least: float = 0.5) -> DataFrame:
    """(gene, pos, n, top): columns of alignments (gene, sample, pos, base), a missing row being a gap, that are conserved.

    Sequences with fewer than ``least`` of the gene's columns go first.  Of the n that stay, the
    commonest base has at least int(share * n) + 1, and at most ``gaps`` * n have a gap.
    """
    columns = bases.groupBy("gene").agg(F.countDistinct("pos").alias("width"))
    kept = bases.groupBy("gene", "sample").agg(F.count("*").alias("k")).join(columns, "gene").filter(F.col("k") >= least * F.col("width")).select("gene", "sample")
    n = kept.groupBy("gene").agg(F.count("*").alias("n"))
    at = bases.join(kept, ["gene", "sample"], "left_semi").groupBy("gene", "pos", "base").agg(F.count("*").alias("k")).groupBy("gene", "pos").agg(F.max("k").alias("top"), F.sum("k").alias("filled"))
    return at.join(n, "gene").filter((F.col("top") >= F.floor(share * F.col("n")) + 1) & (F.col("n") - F.col("filled") <= gaps * F.col("n"))).select("gene", "pos", "n", "top")


def labelled_points(points: DataFrame, x: str, score: str, key: str, bins: int, best: int) -> DataFrame:
    """The points to label: the best of each of ``bins`` bins of equal width on either side of x = 0, and the ``best`` best of all."""
    side = Window.partitionBy("__side")
    place = F.floor((F.col(x) - F.min(x).over(side)) / F.nullif(F.max(x).over(side) - F.min(x).over(side), F.lit(0.0)) * bins)
    binned = points.withColumn("__side", F.col(x) >= 0).withColumn("__bin", F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)))
    order = [F.desc(score), F.asc(key)]
    first = binned.withColumn("__k", F.row_number().over(Window.partitionBy("__side", "__bin").orderBy(*order))).filter("__k = 1").select(key)
    top = points.orderBy(*order).limit(best).select(key)
    return points.join(first.union(top).distinct(), key, "left_semi")


def _merges(x: np.ndarray) -> list[tuple[int, int, float, int]]:
    """(left, right, height, size) of average linkage by Euclidean distance; merge k makes cluster len(x) + k."""
    n = len(x)
    d = np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(axis=2), 0))
    np.fill_diagonal(d, np.inf)
    name, size, out = list(range(n)), np.ones(n), []
    for k in range(n - 1):
        a, b = sorted(divmod(int(d.argmin()), n))
        out.append((min(name[a], name[b]), max(name[a], name[b]), float(d[a, b]), int(size[a] + size[b])))
        row = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        row[a] = np.inf
        d[a], d[:, a], d[b], d[:, b] = row, row, np.inf, np.inf
        size[a] += size[b]
        name[a] = n + k
    return out


def hierarchical_merges(points: DataFrame, by: str, key: Column, vector: str) -> DataFrame:
    """(by, step, left, right, height, size) of an average-linkage tree for each group.

    A group's points are numbered from 0 in order of ``key``; step k, from 0, makes cluster n + k.
    A group is one task and takes its number of points squared: it is meant for idents and terms, not for cells.
    """
    kind = dict(points.dtypes)[by]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__key")
        found = _merges(np.array(pdf[vector].tolist(), float))
        return pd.DataFrame({by: pd.Series([pdf[by].iat[0]] * len(found), dtype=object), "step": range(len(found)), **{c: [m[k] for m in found] for k, c in enumerate(("left", "right", "height", "size"))}})

    return points.withColumn("__key", key).groupBy(by).applyInPandas(run, f"{by} {kind}, step long, left long, right long, height double, size long")
