"""Feature-level operators: normalisation by rank, variability, bins, dependence and annotation lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strainspark.functions.numeric import ratio
from strainspark.operators.ordering import in_order
from strainspark.scratch import Scratch


def quantile_normalised(matrix: DataFrame) -> DataFrame:
    """(sample, gene, value): each value becomes the mean, over samples, of the values of its place; ties in order of gene."""
    placed = matrix.withColumn("place", F.row_number().over(Window.partitionBy("sample").orderBy("value", "gene")))
    means = placed.groupBy("place").agg(F.avg("value").alias("mean"))
    return placed.join(means, "place").select("sample", "gene", F.col("mean").alias("value"))


def variability(matrix: DataFrame) -> DataFrame:
    """(gene, n, mean, cv, log_mean, log_cv) over stored values, null where there is no deviation."""
    m = matrix.groupBy("gene").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    cv = ratio(F.col("sd"), F.col("mean"))
    return m.select("gene", "n", "mean", cv.alias("cv"), F.when(F.col("mean") > 0, F.log("mean")).alias("log_mean"), F.when(cv > 0, F.log(cv)).alias("log_cv"))


#: Places of one block of a rolling window; a block also gets the rows around it that its windows reach.
ROLLING_BLOCK = 10_000


def rolling_z(rows: DataFrame, value: str, order: list[Column], before: int = 49, after: int = 50, block: int = ROLLING_BLOCK) -> DataFrame:
    """``value`` as a z-score among the rows around it in ``order``, as value_z; edges take the part of the window there is.

    Rows get their places first; windows then span blocks of places with the rows that
    reach into them, so none spans the table.
    """
    if max(before, after) > block:
        raise ValueError("a window reaches beyond the next block")
    placed = in_order(rows, order, Scratch(rows.sparkSession, "rolling"), "order").drop("__part")
    of = lambda shift: F.floor((F.col("place") + shift) / block)
    dealt = placed.withColumn("__block", F.explode(F.array_distinct(F.array(of(-after), of(0), of(before)))))
    w = Window.partitionBy("__block").orderBy("place").rowsBetween(-before, after)
    scored = dealt.withColumn(f"{value}_z", ratio(F.col(value) - F.avg(value).over(w), F.stddev_samp(value).over(w)))
    return scored.filter(F.col("__block") == of(0)).drop("__block", "place")


def in_equal_bins(rows: DataFrame, value: str, bins: int, order: list[Column], out: str = "bin") -> DataFrame:
    """Bins of equal numbers of rows, from 1, in a total order; the first ones have a row more where the numbers don't divide."""
    placed = in_order(rows, order, Scratch(rows.sparkSession, "bins"), "order").drop("__part")
    sizes = placed.agg(F.floor(F.count("*") / bins).alias("__size"), (F.count("*") % bins).alias("__more"))
    large = F.col("__more") * (F.col("__size") + 1)
    late = F.col("__more") + F.floor((F.col("place") - 1 - large) / F.greatest(F.col("__size"), F.lit(1))) + 1
    bin_ = F.when(F.col("place") <= large, F.floor((F.col("place") - 1) / (F.col("__size") + 1)) + 1).otherwise(late)
    return placed.crossJoin(F.broadcast(sizes)).withColumn(out, bin_.cast("int")).drop("__size", "__more", "place")


def mutual_information(rows: DataFrame, x: str, y: str) -> DataFrame:
    """One row: the mutual information, in nats, of two binned columns, from joint counts."""
    joint = rows.groupBy(x, y).agg(F.count("*").alias("n"))
    whole = Window.partitionBy()
    p = lambda n: F.col(n) / F.sum("n").over(whole)
    marked = joint.withColumns({"px": F.sum("n").over(Window.partitionBy(x)) / F.sum("n").over(whole), "py": F.sum("n").over(Window.partitionBy(y)) / F.sum("n").over(whole), "p": p("n")})
    return marked.agg(F.sum(F.col("p") * F.log(F.col("p") / (F.col("px") * F.col("py")))).alias("mi"))


def partial_correlation(r: DataFrame) -> DataFrame:
    """Adds ``partial`` of (n, rxy, rxz, ryz): the correlation of x and y without z.

    Null below four rows, and where z explains a side wholly: the quotient would be noise over zero.
    """
    x, y = 1 - F.col("rxz") * F.col("rxz"), 1 - F.col("ryz") * F.col("ryz")
    known = (F.col("n") >= 4) & ~F.isnan(x) & ~F.isnan(y) & (x > 1e-9) & (y > 1e-9)
    return r.withColumn("partial", F.when(known, (F.col("rxy") - F.col("rxz") * F.col("ryz")) / F.sqrt(x * y)))


def small_groups_merged(rows: DataFrame, group: str, least: int, other: str = "Other") -> DataFrame:
    """``group`` with groups of ``least`` rows or fewer under one name; sizes come from a map-side combined count."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("__n"))
    return rows.join(sizes, group).withColumn(group, F.when(F.col("__n") <= least, other).otherwise(F.col(group))).drop("__n")


def balanced_sites(counts: DataFrame, classes: DataFrame, first: str, second: str, most: float = 0.5) -> DataFrame:
    """(pos, f1, f2): sites whose coverage shares in two classes differ by a log ratio of ``most`` at most (not reached)."""
    sizes = classes.groupBy("class").agg(F.countDistinct("sample").alias("n"))
    hit = counts.select("sample", "pos").distinct().join(classes, "sample").groupBy("pos", "class").agg(F.count("*").alias("k")).join(sizes, "class")
    share = lambda c: F.max(F.when(F.col("class") == c, ratio(F.col("k"), F.col("n"))))
    both = hit.groupBy("pos").agg(share(first).alias("f1"), share(second).alias("f2"))
    return both.filter((F.col("f1") > 0) & (F.col("f2") > 0) & (F.abs(F.log(F.col("f1") / F.col("f2"))) < most))


def joined_annotations(rows: DataFrame, key: str, value: str, sep: str = ",") -> DataFrame:
    """(key, value): distinct annotations in order, joined."""
    return rows.filter(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(value)), sep).alias(value))


def dominance(rows: DataFrame, cluster: str, batch: str, k: int) -> DataFrame:
    """(cluster, n, share): the k largest batches' share of each cluster."""
    sizes = rows.groupBy(cluster, batch).agg(F.count("*").alias("n"))
    ranked = sizes.withColumn("__k", F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc("n"), batch)))
    return ranked.groupBy(cluster).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("__k") <= k, F.col("n"))).alias("top")).select(cluster, "n", ratio(F.col("top"), F.col("n")).alias("share"))


def geometric_means(matrix: DataFrame) -> DataFrame:
    """(gene, gmean) of the positive values."""
    return matrix.filter("value > 0").groupBy("gene").agg(F.exp(F.avg(F.log("value"))).alias("gmean"))


def annotated(description: Column) -> Column:
    """Not blank and without the words unknown, hypothetical and uncharacterized."""
    text = F.trim(description)
    return F.coalesce((text != "") & ~F.rlike(text, F.lit("(?i)unknown|hypothetical|uncharacterized")), F.lit(False))
