"""Ranks, false-discovery rates and choices within groups; every order is total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strainspark.functions.numeric import ratio


def average_rank(column: str, *by: str) -> Column:
    """Rank within ``by``; ties share their mean."""
    return F.rank().over(Window.partitionBy(*by).orderBy(column)) + (F.count("*").over(Window.partitionBy(*by, column)) - 1) / 2


def sparse_ranks(matrix: DataFrame, n_samples: Column) -> DataFrame:
    """Average ranks of each gene's stored values among all samples, absent ones counting as 0 below them."""
    stored = F.count("*").over(Window.partitionBy("gene"))
    return matrix.filter("value > 0").withColumn("rank", average_rank("value", "gene") + (n_samples - stored))


def bh_adjusted(rows: DataFrame, p: str, by: list[str], out: str = "padj") -> DataFrame:
    """Benjamini-Hochberg adjusted p within ``by``; null p stay null and don't count.

    All comes from one sort, from the largest p down: its rank from the other end is
    the number of tests less those before it, and null p come last.
    """
    order = Window.partitionBy(*by).orderBy(F.desc(p))
    n, before = F.count(p).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.rank().over(order) - 1
    placed = rows.withColumns({"__n": n, "__rank": n - before})
    lowest = F.min(F.col(p) * F.col("__n") / F.col("__rank")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), lowest))).drop("__n", "__rank")


def first_of(rows: DataFrame, by: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each group in a total order."""
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("__k") <= n).drop("__k")


def significant_or_best(rows: DataFrame, by: list[str], p: str, order: list[Column], level: float = 0.05) -> DataFrame:
    """All rows of a group below ``level``, else the single best."""
    k = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("__k", k).filter((F.col("__k") == 1) | (F.col(p) < level)).drop("__k")


def repeats_in_order(rows: DataFrame, columns: list[str], order: list[Column], out: str = "redundant") -> DataFrame:
    """Whether any of ``columns`` has its value in an earlier row."""
    flags = [F.row_number().over(Window.partitionBy(c).orderBy(*order)) > 1 for c in columns]
    any_ = flags[0]
    for f in flags[1:]:
        any_ = any_ | f
    return rows.withColumn(out, any_)


def unique_suffix(rows: DataFrame, column: str, order: list[Column]) -> DataFrame:
    """``column`` with _1, _2 ... where it repeats, as column_unique."""
    w = Window.partitionBy(column)
    many = F.count("*").over(w) > 1
    return rows.withColumn(f"{column}_unique", F.when(many, F.concat_ws("_", column, F.row_number().over(w.orderBy(*order)))).otherwise(F.col(column)))


def quotas(sizes: DataFrame, group: str, size: str, total: Column) -> DataFrame:
    """``sizes`` with ``quota``: water-filling of ``total`` over the groups, so small groups are kept whole.

    In order of size, a group takes all it has or an even share of what the
    groups before it left; the remainder of an uneven split is not dealt.
    """
    order = Window.orderBy(size, group)
    before = F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.count("*").over(Window.partitionBy()) - F.row_number().over(order) + 1
    share = F.floor(F.greatest(total - before, F.lit(0)) / left)
    with_share = sizes.withColumn("__share", share).withColumn("__whole", F.col(size) <= F.col("__share"))
    # The first group that can't be whole fixes the share of all after it.
    fixed = F.first(F.when(~F.col("__whole"), F.col("__share")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return with_share.withColumn("quota", F.when(fixed.isNull(), F.col(size)).otherwise(F.least(F.col(size), fixed)).cast("long")).drop("__share", "__whole")


def downsampled(rows: DataFrame, group: str, key: str, total: int, seed: str = "1") -> DataFrame:
    """At most ``total`` rows, evenly over the groups; which ones a hash of ``key`` says."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("n"))
    kept = quotas(sizes, group, "n", F.lit(total)).select(group, "quota")
    order = [F.md5(F.concat(F.lit(seed + ":"), F.col(key).cast("string"))), F.col(key)]
    ranked = rows.withColumn("__k", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return ranked.join(kept, group).filter("__k <= quota").drop("__k", "quota")


def z_scores(rows: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Adds column_z: distance from the group's mean in sample deviations, null where there is no deviation."""
    w = Window.partitionBy(*by)
    for c in columns:
        rows = rows.withColumn(f"{c}_z", ratio(F.col(c) - F.avg(c).over(w), F.stddev_samp(c).over(w)))
    return rows


def pruned_overlaps(sets: DataFrame, most: float) -> DataFrame:
    """(term, ord): terms whose share of members in any earlier term is ``most`` at most.

    ``sets``: (term, ord, member).  Every earlier term counts, kept or not.
    """
    sizes = sets.groupBy("term", "ord").agg(F.count("*").alias("n"))
    early, late = sets.select(F.col("ord").alias("o1"), "member"), sets.select("term", F.col("ord").alias("o2"), "member")
    shared = late.join(early, "member").filter("o1 < o2").groupBy("term", "o1").agg(F.count("*").alias("both"))
    bad = shared.join(sizes, "term").filter(F.col("both") > most * F.col("n")).select("term").distinct()
    return sizes.join(bad, "term", "left_anti").select("term", "ord", "n")
