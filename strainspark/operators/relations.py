"""Joins, set operations and relational division."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def looked_up(rows: DataFrame, table: DataFrame, on: list[str], order: list[Column]) -> DataFrame:
    """Left join to the first match of each key."""
    first = table.withColumn("__k", F.row_number().over(Window.partitionBy(*on).orderBy(*order))).filter("__k = 1").drop("__k")
    return rows.join(first, on, "left")


def all_members_in(panel: DataFrame, key: str, member: str, kept: DataFrame) -> DataFrame:
    """Keys of ``panel`` all of whose members are in ``kept``: division by counting."""
    marked = panel.select(key, member).distinct().join(kept.select(member).distinct().withColumn("__in", F.lit(1)), member, "left")
    return marked.groupBy(key).agg(F.count("*").alias("n"), F.count("__in").alias("__found")).filter("n = __found").select(key, "n")


def pairs_in_time(samples: DataFrame, by: list[str], time: str, gap: float, values: list[str]) -> DataFrame:
    """Ordered pairs of a subject's samples more than ``gap`` apart: columns end in 0 and f."""
    first = samples.select(*by, F.col(time).alias("t0"), *[F.col(v).alias(f"{v}0") for v in values])
    later = samples.select(*by, F.col(time).alias("tf"), *[F.col(v).alias(f"{v}f") for v in values])
    return first.join(later, by).filter(F.col("tf") > F.col("t0") + gap)


def inside(points: DataFrame, ranges: DataFrame, on: str, at: str, low: str, high: str, width: int) -> DataFrame:
    """Points in ranges of the same ``on``: an equi-join on bins of ``width`` instead of a range join over the key."""
    p = points.withColumn("__bin", F.floor(F.col(at) / width))
    r = ranges.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return p.join(r, [on, "__bin"]).filter((F.col(at) >= F.col(low)) & (F.col(at) <= F.col(high))).drop("__bin")


def reads_in_genes(reads: DataFrame, genes: DataFrame, width: int) -> DataFrame:
    """(id, gene), each once, of reads (contig, id, first, last) whose first or last base lies in a gene (contig, gene, low, high)."""
    # A pair met by its first base isn't met by its last again, so only names of several rows need comparing.
    reads, genes = reads.select("contig", "id", "first", "last"), genes.select("contig", "gene", "low", "high")
    marked = lambda rows, name, out: rows.withColumn(out, F.count("*").over(Window.partitionBy(name)) > 1)
    reads, genes = marked(reads, "id", "__more"), marked(genes, "gene", "__again")
    ends = reads.withColumn("__ends", F.array(F.struct(F.col("first").alias("at"), F.lit(None).cast(dict(reads.dtypes)["first"]).alias("before")), F.struct(F.col("last").alias("at"), F.col("first").alias("before"))))
    ends = ends.select("contig", "id", "__more", F.inline("__ends"))

    def met(e: DataFrame, g: DataFrame) -> DataFrame:
        found = inside(e, g, "contig", "at", "low", "high", width)
        return found.filter(F.col("before").isNull() | ~F.col("before").between(F.col("low"), F.col("high"))).select("id", "gene")

    one, again = ends.filter("NOT __more"), genes.filter("__again")
    repeated = met(ends.filter("__more"), genes).union(met(one, again)).distinct()
    return met(one, genes.filter("NOT __again")).union(repeated)


def mapped_lists(rows: DataFrame, column: str, table: DataFrame, sep: str = "\t") -> DataFrame:
    """(id, column) whose list of old names becomes the distinct new names of ``table`` (old, new), in order."""
    each = rows.select("id", F.explode(F.split(column, sep)).alias("old"))
    found = each.join(table, "old").groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("new")), sep).alias(column))
    return rows.select("id").join(found, "id", "left").select("id", F.coalesce(column, F.lit("")).alias(column))


def combinations(panel: DataFrame, key: str, slot: str, choice: str, slots: list[str]) -> DataFrame:
    """Every choice of one value for each slot of a key, one column a slot; joined within the key."""
    out = None
    for s in slots:
        part = panel.filter(F.col(slot) == s).select(key, F.col(choice).alias(s)).distinct()
        out = part if out is None else out.join(part, key)
    return out


def key_hierarchy(pairs: DataFrame, selected: DataFrame) -> DataFrame:
    """(key, n, n_selected, inside, apart) of (key, value) pairs against selected values."""
    marked = pairs.distinct().join(selected.distinct().withColumn("__in", F.lit(1)), "value", "left")
    out = marked.groupBy("key").agg(F.count("*").alias("n"), F.count("__in").alias("n_selected"))
    return out.select("key", "n", "n_selected", (F.col("n") == F.col("n_selected")).alias("inside"), (F.col("n_selected") == 0).alias("apart"))
