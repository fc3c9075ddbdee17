"""Places, running sums and adjusted p-values over a whole table's order, without a window over all rows.

Rows are dealt by ranges of their order and sorted; what a partition can't know comes
from a table of one row a partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strainspark.scratch import Scratch


def in_order(rows: DataFrame, order: list[Column], scratch: Scratch, name: str, amounts: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` with __part, place (from 1, over all rows) and, for each amount, its sum up to and with the row as running_<name>.

    Rows of equal order stay in one partition, whichever comes first; so give a total
    order.  The rows are written once.  The broadcast table has a row for each
    partition that has rows.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    kept = scratch.keep(dealt, name).withColumn("__part", F.shiftright("__id", 33))
    amounts = {"place": F.lit(1), **{f"running_{k}": v for k, v in (amounts or {}).items()}}
    parts = kept.groupBy("__part").agg(*[F.sum(v).alias(f"__all_{k}") for k, v in amounts.items()])
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("__part", *[F.coalesce(F.sum(f"__all_{k}").over(earlier), F.lit(0)).alias(f"__before_{k}") for k in amounts])
    within = Window.partitionBy("__part").orderBy("__id").rowsBetween(Window.unboundedPreceding, 0)
    out = kept.join(F.broadcast(parts), "__part")
    out = out.withColumn("place", (F.col("__id") - F.shiftleft("__part", 33) + 1 + F.col("__before_place")).cast("long"))
    for k, v in amounts.items():
        if k != "place":
            out = out.withColumn(k, F.sum(v).over(within) + F.col(f"__before_{k}"))
    return out.drop("__id", *[f"__before_{k}" for k in amounts])


def adjusted_over_all(rows: DataFrame, p: str, scratch: Scratch, out: str = "padj", name: str = "adjust", more: DataFrame | None = None) -> DataFrame:
    """Benjamini-Hochberg adjusted p over the whole table; null p stay null and don't count.

    Equal p share their adjusted value, so the order and its running minimum are of the
    distinct ones, and each row looks its own up.  ``more`` (p, n) are tests without
    rows, n of each p.
    """
    distinct = rows.filter(F.col(p).isNotNull()).groupBy(F.col(p).alias("__p")).agg(F.count("*").alias("__n"))
    if more is not None:
        distinct = distinct.union(more.select("p", "n")).groupBy("__p").agg(F.sum("__n").alias("__n"))
    placed = in_order(distinct, [F.col("__p")], scratch, name, {"n": F.col("__n")})
    total = placed.agg(F.sum("__n").alias("__total"))
    value = placed.crossJoin(F.broadcast(total)).withColumn("__v", F.col("__p") * F.col("__total") / F.col("running_n"))
    later = Window.orderBy(F.desc("__part")).rowsBetween(Window.unboundedPreceding, -1)
    ends = value.groupBy("__part").agg(F.min("__v").alias("__m")).select("__part", F.min("__m").over(later).alias("__after"))
    down = Window.partitionBy("__part").orderBy(F.desc("__p")).rowsBetween(Window.unboundedPreceding, 0)
    found = value.join(F.broadcast(ends), "__part").select("__p", F.least(F.lit(1.0), F.min("__v").over(down), "__after").alias(out))
    return rows.join(found, F.col(p) == F.col("__p"), "left").drop("__p")
