"""Abundance matrices as long relations (sample, gene, value); a missing row is 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strainspark.functions.numeric import log2p1, ratio


def count_matrix(rows: DataFrame, sample: str, gene: str, value: str | Column) -> DataFrame:
    """Sum of ``value`` by sample and gene."""
    value = F.col(value) if isinstance(value, str) else value
    return rows.groupBy(F.col(sample).alias("sample"), F.col(gene).alias("gene")).agg(F.sum(value).alias("value"))


def keep_samples(matrix: DataFrame, least: float) -> DataFrame:
    """Rows of the samples whose values sum to ``least`` or more."""
    return matrix.join(matrix.groupBy("sample").agg(F.sum("value").alias("t")).filter(F.col("t") >= least).select("sample"), "sample", "left_semi")


def keep_genes(matrix: DataFrame, samples: int, least: float = 0.0, repeated: bool = True) -> DataFrame:
    """Rows of the genes with more than ``least`` in ``samples`` samples or more.

    Where no sample and gene come in two rows, ``repeated=False`` spares the tables of
    distinct ones, here and below.
    """
    number = F.countDistinct("sample") if repeated else F.count("sample")
    good = matrix.filter(F.col("value") > least).groupBy("gene").agg(number.alias("n")).filter(F.col("n") >= samples)
    return matrix.join(good.select("gene"), "gene", "left_semi")


def keep_both(matrix: DataFrame, least: float, samples: int, repeated: bool = True) -> DataFrame:
    """Both filters, each judged on the whole matrix."""
    return keep_samples(matrix, least).join(keep_genes(matrix, samples, repeated=repeated).select("gene").distinct(), "gene", "left_semi")


def keep_in_turn(matrix: DataFrame, least: float, samples: int, repeated: bool = True) -> DataFrame:
    """Samples first; genes judged on what is left."""
    return keep_genes(keep_samples(matrix, least), samples, repeated=repeated)


def normalised(matrix: DataFrame, total: float = 1e4) -> DataFrame:
    """Adds ``tpk``, the share of the sample's sum times ``total``, and ``log_tpk``; one window over the sample."""
    tpk = ratio(total * F.col("value"), F.sum("value").over(Window.partitionBy("sample")))
    return matrix.withColumn("tpk", tpk).withColumn("log_tpk", log2p1(F.col("tpk")))


def group_means(matrix: DataFrame, groups: DataFrame, value: str = "value") -> DataFrame:
    """(grp, gene, total, mean, n): of the samples of each group, zeros included, so the mean divides by the group's size."""
    sizes = groups.groupBy("grp").agg(F.countDistinct("sample").alias("n"))
    sums = matrix.join(groups, "sample").groupBy("grp", "gene").agg(F.sum(value).alias("total"))
    return sums.join(sizes, "grp").select("grp", "gene", "total", ratio(F.col("total"), F.col("n")).alias("mean"), "n")


def densified(matrix: DataFrame) -> DataFrame:
    """Every (sample, gene) of the matrix's own samples and genes, 0 where it has no row."""
    universe = matrix.select("sample").distinct().crossJoin(matrix.select("gene").distinct())
    return universe.join(matrix, ["sample", "gene"], "left").select("sample", "gene", F.coalesce("value", F.lit(0.0)).alias("value"))


def aggregated(matrix: DataFrame, groups: DataFrame) -> DataFrame:
    """(grp, gene) with mean, sum, sd and median over all samples of the group, zeros included."""
    dense = densified(matrix).join(groups.dropna(), "sample")
    return dense.groupBy("grp", "gene").agg(F.avg("value").alias("mean"), F.sum("value").alias("sum"), F.stddev_samp("value").alias("sd"), F.median("value").alias("median"))


def nonzero_means(matrix: DataFrame, by: str) -> DataFrame:
    """(by, mean) of the values other than 0; 0 where there is none."""
    x = F.col("value")
    return matrix.groupBy(by).agg(F.coalesce(ratio(F.sum(x), F.sum(F.when(x != 0, 1).otherwise(0))), F.lit(0.0)).alias("mean"))


def aligned_union(parts: list[DataFrame]) -> DataFrame:
    """Rows of all parts, columns by name, nulls where a part lacks one."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def matrix_sum(parts: list[DataFrame]) -> DataFrame:
    """Entry-wise sum of matrices of any extent."""
    return aligned_union(parts).groupBy("sample", "gene").agg(F.sum("value").alias("value"))


def entropy(matrix: DataFrame) -> DataFrame:
    """(sample, entropy): -sum p ln p over the sample's shares."""
    p = ratio(F.col("value"), F.sum("value").over(Window.partitionBy("sample")))
    return matrix.filter("value > 0").withColumn("p", p).groupBy("sample").agg((-F.sum(F.col("p") * F.log("p"))).alias("entropy"))


def imputed(rows: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """``column`` with its mean for nulls, then as a z-score (sample deviation) in column_z."""
    w = Window.partitionBy(*(by or []))
    if by:
        filled = rows.withColumn(column, F.coalesce(F.col(column), F.avg(column).over(w)))
        return filled.withColumn(f"{column}_z", ratio(F.col(column) - F.avg(column).over(w), F.stddev_samp(column).over(w)))
    mean = rows.agg(F.avg(column).alias("__m"))
    filled = rows.crossJoin(F.broadcast(mean)).withColumn(column, F.coalesce(F.col(column), F.col("__m"))).drop("__m")
    stats = filled.agg(F.avg(column).alias("__m"), F.stddev_samp(column).alias("__s"))
    return filled.crossJoin(F.broadcast(stats)).withColumn(f"{column}_z", ratio(F.col(column) - F.col("__m"), F.col("__s"))).drop("__m", "__s")


def clamped_rescaled(rows: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """``column`` clamped to its quantiles and scaled to 0..1 in column_scaled; a constant column gives 0."""
    edges = rows.agg(F.percentile(column, F.lit(low)).alias("__a"), F.percentile(column, F.lit(high)).alias("__b"))
    x = F.least(F.greatest(F.col(column), F.col("__a")), F.col("__b"))
    return rows.crossJoin(F.broadcast(edges)).withColumn(f"{column}_scaled", F.coalesce(ratio(x - F.col("__a"), F.col("__b") - F.col("__a")), F.lit(0.0))).drop("__a", "__b")
