"""Variable genes: residuals of log variability around a robust local regression on log mean."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strainspark.operators.ordering import in_order
from strainspark.scratch import Scratch

#: Points at which the curve is fitted, half of them evenly spread over the genes' order and half over x; between them it is a cubic through values and slopes.
VERTICES = 96


def _vertices(placed: DataFrame, n: int, width: int, many: int) -> list[tuple[float, float]]:
    """(x, bandwidth) at points spread over ``placed`` (x, place): the distance to the ``width``-th nearest x.

    The nearest ``width`` of an ordered list stand together, so every run of that
    length offers its farther end, and the least offer is the bandwidth.
    """
    half = max(2, many // 2)
    places = sorted({round(1 + k * (n - 1) / (half - 1)) for k in range(half)})
    at = placed.filter(F.col("place").isin(places)).select(F.col("x").alias("v"))
    ends = placed.agg(F.min("x").alias("low"), F.max("x").alias("high"))
    step = (F.col("high") - F.col("low")) / half
    at = at.union(ends.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(half - 1)), lambda k: F.col("low") + k * step)))).distinct()
    ends = placed.select("place", F.col("x").alias("low")).join(placed.select((F.col("place") - width + 1).alias("place"), F.col("x").alias("high")), "place")
    points = F.broadcast(at)  # as many as vertices
    offer = ends.crossJoin(points).groupBy("v").agg(F.min(F.greatest(F.col("v") - F.col("low"), F.col("high") - F.col("v"))).alias("h"))
    return sorted((r["v"], r["h"]) for r in offer.collect())


def _fit(rows: DataFrame, vertices: list[tuple[float, float]], weight: Column) -> list[tuple[float, float, float]]:
    """(x, value, slope) at each vertex of the weighted quadratic through the rows (x, y) in its bandwidth.

    One pass: each row adds to the moments of the vertices it lies near; what comes
    back is a row a vertex.
    """
    points = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v"), F.lit(max(h, 1e-12)).alias("h")) for k, (v, h) in enumerate(vertices)])
    near = rows.select("x", "y", weight.alias("r"), F.explode(points).alias("p")).filter(F.abs(F.col("x") - F.col("p.v")) < F.col("p.h"))
    t = F.col("x") - F.col("p.v")
    u = F.abs(t) / F.col("p.h")
    w = F.pow(1 - F.pow(u, F.lit(3)), F.lit(3)) * F.col("r")
    near = near.select(F.col("p.k").alias("k"), (t / F.col("p.h")).alias("t"), "y", w.alias("w"))
    power = lambda m: F.sum(F.col("w") * F.pow("t", F.lit(m)))
    sums = near.groupBy("k").agg(*[power(m).alias(f"s{m}") for m in range(5)], *[F.sum(F.col("w") * F.col("y") * F.pow("t", F.lit(m))).alias(f"y{m}") for m in range(3)]).collect()
    out = []
    for r in sorted(sums, key=lambda r: r["k"]):
        m = np.array([[r[f"s{i + j}"] for j in range(3)] for i in range(3)])
        c = np.linalg.lstsq(m, np.array([r[f"y{i}"] for i in range(3)]), rcond=1e-12)[0]
        v, h = vertices[r["k"]]
        out.append((v, float(c[0]), float(c[1] / max(h, 1e-12))))
    return out


def _curve(x: Column, knots: list[tuple[float, float, float]]) -> Column:
    """The cubic through the values and slopes at both knots around x."""
    if len(knots) == 1:
        return F.lit(knots[0][1])
    k = F.least(F.greatest(F.size(F.filter(F.array(*[F.lit(v) for v, _, _ in knots]), lambda v: v <= x)), F.lit(1)), F.lit(len(knots) - 1)) - 1
    table = [F.array(*[F.lit(float(row[i])) for row in knots]) for i in range(3)]
    a, b = (tuple(t[k + d] for t in table) for d in (0, 1))
    h = b[0] - a[0]
    t = (x - a[0]) / h
    t2, t3 = t * t, t * t * t
    return (2 * t3 - 3 * t2 + 1) * a[1] + (t3 - 2 * t2 + t) * h * a[2] + (3 * t2 - 2 * t3) * b[1] + (t3 - t2) * h * b[2]


def _median(rows: DataFrame, value: str, n: int, scratch: Scratch, name: str) -> float:
    placed = in_order(rows.select(value), [F.asc(value)], scratch, name)
    return placed.filter(F.col("place").isin((n + 1) // 2, n // 2 + 1)).agg(F.avg(value).alias("m")).first()["m"]


def local_residuals(genes: DataFrame, scratch: Scratch, span: float = 0.75, turns: int = 4, vertices: int = VERTICES) -> DataFrame:
    """``genes`` (gene, x, y) with fitted and residual: y around a local quadratic of x, robust to outliers.

    At each of ``vertices`` places the nearest ``span`` of all genes are fitted with
    tricube weights; between them the curve is the cubic through values and slopes.
    Each further turn weighs genes down by their residuals, by a bisquare of six times the median.
    Genes whose x or y isn't a finite number are left out.  Each turn is one pass over
    the genes; a vertex' moments and the median are all that the driver sees.
    """
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rows = in_order(genes.filter(finite("x") & finite("y")), [F.asc("x"), F.asc("gene")], scratch, "ordered").drop("__part")
    n = rows.count()
    if not n:
        return rows.withColumns({"fitted": F.lit(0.0), "residual": F.lit(0.0)})
    found, weight = _vertices(rows, n, max(1, min(n, int(n * span + 1e-9))), vertices), F.lit(1.0)
    fitted = rows
    for turn in range(turns):
        knots = _fit(fitted, found, weight)
        fitted = scratch.keep(rows.withColumn("fitted", _curve(F.col("x"), knots)).withColumn("residual", F.col("y") - F.col("fitted")), f"turn{turn}")
        if turn + 1 < turns:
            scale = 6 * _median(fitted.withColumn("size", F.abs("residual")), "size", n, scratch, f"sizes{turn}")
            u = F.abs(F.col("residual")) / F.lit(max(scale, 1e-300))
            weight = F.when(u < 1, F.pow(1 - u * u, F.lit(2))).otherwise(0.0)
    return fitted


def variable_genes(moments: DataFrame, scratch: Scratch, number: int = 1500, bins: int = 20, **fit) -> DataFrame:
    """(gene, bin, residual, rank): in each of ``bins`` bins of equal numbers of genes by mean, those of the largest residuals.

    ``moments``: (gene, mean, variance) of each gene; genes without either are left out.
    Log coefficient of variation around its regression on log mean.  Genes of equal
    mean share a bin, that of the first of them; of equal residuals the smaller gene.
    """
    known = moments.filter("mean > 0 AND variance > 0").select("gene", F.log("mean").alias("x"), F.log(F.sqrt("variance") / F.col("mean")).alias("y"))
    around = local_residuals(known, scratch, **fit)
    n = around.count()
    first = around.groupBy(F.col("x").alias("of")).agg(F.min("place").alias("place_of"))
    binned = around.join(first, F.col("x") == F.col("of")).withColumn("bin", F.floor((F.col("place_of") - 1) * bins / F.lit(max(1, n))).cast("int") + 1)
    # A bin's best are found in each of many parts first.
    part = F.pmod(F.xxhash64("gene"), F.lit(64))
    best = lambda rows, by: rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("residual"), "gene"))).filter(F.col("rank") <= number // bins)
    return best(best(binned.withColumn("part", part), ["bin", "part"]), ["bin"]).select("gene", "bin", "residual", "rank")
