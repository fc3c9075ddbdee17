"""Gene-set enrichment with permutation p-values, and overlaps of sets with exact tests."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strainspark.functions.numeric import ratio
from strainspark.operators.ordering import adjusted_over_all, in_order
from strainspark.operators.statistics import with_fisher
from strainspark.scratch import Scratch

#: Places of the p-values of set pairs before they are adjusted; such as differ beyond them count as equal.
PLACES = 9


def placed_genes(ranked: DataFrame, scratch: Scratch) -> DataFrame:
    """(gene, stat, place) of (gene, stat) from the highest stat down, of equals the smaller gene first; null stats are left out."""
    known = ranked.filter("stat IS NOT NULL").select("gene", F.col("stat").cast("double").alias("stat"))
    return in_order(known, [F.desc("stat"), F.asc("gene")], scratch, "genes").select("gene", "stat", "place")


def running_scores(placed: DataFrame, sets: DataFrame, n_genes: int) -> DataFrame:
    """(name, n, score): the running-sum score of each set (name, member) over ``placed`` genes.

    Hits add their share of the set's |stat|, misses take an even share away; the score
    is the largest excursion, of equals the upper one.  A set's hits alone are sorted.
    """
    hits = placed.join(sets.select("name", F.col("member").alias("gene")).distinct(), "gene")
    order, whole = Window.partitionBy("name").orderBy("place"), Window.partitionBy("name")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    h = hits.withColumns({"n": F.count("*").over(whole), "hit": ratio(F.sum(F.abs("stat")).over(so_far), F.sum(F.abs("stat")).over(whole)), "k": F.row_number().over(order)})
    miss = ratio(F.col("place") - F.col("k"), F.lit(n_genes) - F.col("n"))
    # The sum is largest just at a hit and smallest just before one.
    h = h.withColumns({"up": F.col("hit") - miss, "down": F.coalesce(F.lag("hit").over(order), F.lit(0.0)) - miss})
    peaks = h.groupBy("name", "n").agg(F.max("up").alias("up"), F.min("down").alias("down"))
    return peaks.select("name", "n", F.when(F.col("up") >= -F.col("down"), F.col("up")).otherwise(F.col("down")).alias("score"))


def random_places(spark, n_genes: int, most: int, permutations: int, seed: str) -> DataFrame:
    """(k, draw, place): for each of ``permutations`` the first ``most`` places, from 1, of a random order of ``n_genes``.

    Places are hashes of (seed, k, i), repeated ones dropped; where ``most`` is over
    half of the genes, all of them are ordered by such a hash.  Any number of draws from
    the first is a random sample, so one order serves sets of all sizes.
    """
    number = lambda *x: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *[v.cast("string") for v in x])), 1, 15), 16, 10).cast("long")
    each = spark.range(1, permutations + 1).withColumnRenamed("id", "k")
    if 2 * most > n_genes:
        drawn = each.withColumn("place", F.explode(F.sequence(F.lit(1), F.lit(n_genes)))).withColumn("i", number(F.col("k"), F.col("place")))
    else:
        tried = each.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(2 * most + 64)))).withColumn("place", 1 + F.pmod(number(F.col("k"), F.col("i")), F.lit(n_genes)))
        drawn = tried.groupBy("k", "place").agg(F.min("i").alias("i"))
    order = Window.partitionBy("k").orderBy("i", "place")
    return drawn.select("k", "place", F.row_number().over(order).alias("draw")).filter(F.col("draw") <= most)


def _null_scores(sizes: list[int], n_genes: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("draw")
        places, weights, out = pdf["place"].to_numpy(np.int64), np.abs(pdf["stat"].to_numpy(float)), []
        for n in sizes:
            order = np.argsort(places[:n])
            p, r = places[:n][order], weights[:n][order]
            if not r.sum():
                continue
            hit, miss = np.cumsum(r) / r.sum(), (p - np.arange(1, n + 1)) / max(1, n_genes - n)
            up, down = (hit - miss).max(), (np.concatenate([[0.0], hit[:-1]]) - miss).min()
            out.append((pdf["k"].iat[0], n, up if up >= -down else down))
        return pd.DataFrame(out, columns=["k", "n", "score"])

    return run


def set_enrichment(ranked: DataFrame, sets: DataFrame, scratch: Scratch, permutations: int = 1000, least: int = 5, largest: int = 500, seed: str = "1") -> DataFrame:
    """(name, n, score, nes, pval, padj) of sets (name, member) with ``least`` to ``largest`` genes of (gene, stat).

    The null scores are those of random genes, as many as the set has; sets of one size
    share them.  With b and c null scores at least and at most as large, of p and q that
    aren't negative and aren't positive, pval is the smaller of (1 + b) / (1 + p) and
    (1 + c) / (1 + q); nes is the score over the mean null score of its sign.  Adjusted
    over all sets.  One permutation's draws, at most ``largest`` rows, are a group; scores are
    compared at nine places.
    """
    spark = ranked.sparkSession
    placed = scratch.keep(placed_genes(ranked, scratch), "placed")
    n_genes = placed.count()
    scores = running_scores(placed, sets, n_genes).filter(F.col("n").between(least, largest)).filter("score IS NOT NULL").withColumn("score", F.round("score", 9))
    scores = scratch.keep(scores, "scores")
    sizes = sorted(r["n"] for r in scores.select("n").distinct().collect())  # between the two bounds
    schema = "k long, n long, score double"
    if not sizes:
        null = spark.createDataFrame([], schema)
    else:
        drawn = random_places(spark, n_genes, sizes[-1], permutations, seed).join(placed.select("place", "stat"), "place")
        null = drawn.groupBy("k").applyInPandas(_null_scores(sizes, n_genes), schema).withColumn("score", F.round("score", 9))
    null = null.select("n", F.col("score").alias("null"))
    up, down = F.col("null") >= 0, F.col("null") <= 0
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    met = scores.join(null, "n").groupBy("name", "n", "score").agg(count(F.col("null") >= F.col("score")).alias("b"), count(F.col("null") <= F.col("score")).alias("c"), count(up).alias("p"), count(down).alias("q"),
                                                                  F.avg(F.when(up, F.col("null"))).alias("above"), F.avg(F.when(down, F.col("null"))).alias("below"))
    tested = met.select("name", "n", "score", ratio(F.col("score"), F.when(F.col("score") > 0, F.col("above")).otherwise(F.abs("below"))).alias("nes"),
                        F.least((1 + F.col("b")) / (1 + F.col("p")), (1 + F.col("c")) / (1 + F.col("q"))).alias("pval"))
    return adjusted_over_all(scratch.keep(tested, "tested"), "pval", scratch)


def set_pair_tests(left: DataFrame, right: DataFrame, universe: int, scratch: Scratch) -> DataFrame:
    """(s1, s2, both, n1, n2, odds, pval, padj): exact tests of the sets (name, member) of two collections, of pairs that share a member.

    ``universe`` is the number of members that could be in a set.  Pairs come from an
    equi-join on the member.  Pairs without a common member aren't listed, but are
    tests too: their p depends on both sizes only, so they are counted by sizes and
    adjusted with the others.  p-values are those of PLACES places.
    """
    def sized(x: DataFrame, name: str, n: str) -> tuple[DataFrame, DataFrame]:
        x = x.select(F.col("name").alias(name), "member").distinct()
        return x, x.groupBy(name).agg(F.count("*").alias(n))

    def tabled(x: DataFrame) -> DataFrame:
        return x.withColumns({"a": F.col("both"), "b": F.col("n1") - F.col("both"), "c": F.col("n2") - F.col("both"), "d": F.lit(universe) - F.col("n1") - F.col("n2") + F.col("both")})

    (x, of_x), (y, of_y) = sized(left, "s1", "n1"), sized(right, "s2", "n2")
    both = x.join(y, "member").groupBy("s1", "s2").agg(F.count("*").alias("both")).join(of_x, "s1").join(of_y, "s2")
    tested = scratch.keep(with_fisher(tabled(both)).select("s1", "s2", "both", "n1", "n2", "odds", F.round("pval", PLACES).alias("pval")), "pairs")
    sizes_x, sizes_y = of_x.groupBy("n1").agg(F.count("*").alias("k1")), of_y.groupBy("n2").agg(F.count("*").alias("k2"))
    # Sizes by sizes: as many rows as two collections have different sizes.
    cells = sizes_x.crossJoin(sizes_y).join(tested.groupBy("n1", "n2").agg(F.count("*").alias("listed")), ["n1", "n2"], "left")
    bare = cells.select("n1", "n2", F.lit(0).alias("both"), (F.col("k1") * F.col("k2") - F.coalesce("listed", F.lit(0))).alias("n")).filter((F.col("n") > 0) & (F.col("n1") + F.col("n2") <= universe))
    return adjusted_over_all(tested, "pval", scratch, more=with_fisher(tabled(bare)).select(F.round("pval", PLACES).alias("p"), "n"))
