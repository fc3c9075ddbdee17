"""Enrichment over many experiments: the matrix of terms by experiments, without redundant terms, and enrichment of pairs of genes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strainspark.functions.numeric import ratio
from strainspark.operators.ranking import average_rank, first_of
from strainspark.operators.statistics import with_fisher
from strainspark.scratch import Scratch


def rank_sum_enrichment(ranked: DataFrame, sets: DataFrame) -> DataFrame:
    """(experiment, term, n, nes): rank sums of sets (term, gene) among each experiment's (experiment, gene, stat) as tie-corrected normal scores.

    Genes are ranked once an experiment, however many sets there are.  Null where all
    genes tie or none is outside the set; null stats are left out.
    """
    known = ranked.filter("stat IS NOT NULL")
    ties = known.groupBy("experiment", "stat").agg(F.count("*").cast("double").alias("t")).groupBy("experiment").agg(F.sum("t").alias("all"), F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    rows = known.withColumn("r", average_rank("stat", "experiment")).join(sets.select("term", "gene").distinct(), "gene")
    x = rows.groupBy("experiment", "term").agg(F.count("*").alias("n"), F.sum("r").alias("r")).join(ties, "experiment")
    n, m = F.col("n"), F.col("all")
    var = n * (m - n) / 12 * (m + 1 - ratio(F.col("ties"), m * (m - 1)))
    return x.select("experiment", "term", "n", F.when(var > 0, (F.col("r") - n * (m + 1) / 2) / F.sqrt(var)).alias("nes"))


def enrichment_matrix(results: DataFrame, n: int = 3, most_p: float = 1.0, most_padj: float = 1.0, shown: int | None = None, shown_p: float = 1.0, shown_padj: float = 1.0) -> DataFrame:
    """(term, experiment, nes, pval): the chosen terms in every experiment of (experiment, term, nes, pval, padj).

    Each experiment chooses its ``n`` terms of the largest positive nes within both
    bounds on p, of equals the smaller term.  A chosen term keeps its nes and p where
    it is within the shown bounds and the first ``shown`` by nes; elsewhere they are 0
    and 1.  Rows with a null nes or p take no part.
    """
    known = results.filter("nes IS NOT NULL AND pval IS NOT NULL AND padj IS NOT NULL").select("experiment", "term", "nes", "pval", "padj")
    order = [F.desc("nes"), F.asc("term")]
    within = lambda p, padj: (F.col("pval") <= p) & (F.col("padj") <= padj)
    terms = first_of(known.filter(within(most_p, most_padj) & (F.col("nes") > 0)), ["experiment"], order, n).select("term").distinct()
    values = known.filter(within(shown_p, shown_padj))
    if shown is not None:
        values = first_of(values, ["experiment"], order, shown)
    # One row that lists the experiments, a row for each of which every term gets.
    listed = known.select("experiment").distinct().agg(F.collect_list("experiment").alias("all"))
    dense = terms.crossJoin(F.broadcast(listed)).select("term", F.explode("all").alias("experiment"))
    return dense.join(values.drop("padj"), ["term", "experiment"], "left").select("term", "experiment", F.coalesce("nes", F.lit(0.0)).alias("nes"), F.coalesce("pval", F.lit(1.0)).alias("pval"))


def redundant_terms(matrix: DataFrame, scratch: Scratch, cut: float, share: float = 0.8) -> DataFrame:
    """(term) of rows (term, experiment, nes) that go because a like row has larger scores.

    In the order of terms, each that hasn't gone looks at the terms correlated with it
    by more than ``cut``, itself and those gone among them, and all of these go but
    those of the largest ``share`` quantile.  Rows without variance are like none.
    Whether a term looks depends on the smaller terms that would drop it, so all whose
    such terms are settled are settled together, round by round.
    """
    rows = matrix.select("term", "experiment", "nes")
    y = rows.select(F.col("term").alias("other"), "experiment", F.col("nes").alias("y"))
    r = ratio(F.covar_pop("nes", "y"), F.stddev_pop("nes") * F.stddev_pop("y"))
    pairs = rows.join(y, "experiment").groupBy("term", "other").agg(F.round(r, 9).alias("r")).filter(F.col("r") > cut)
    high = rows.groupBy(F.col("term").alias("other")).agg(F.round(F.percentile("nes", F.lit(share)), 9).alias("high"))
    like = scratch.keep(pairs.join(high, "other"), "like")
    tops = like.groupBy("term").agg(F.max("high").alias("top"))
    drops = scratch.keep(like.join(tops, "term").filter("high < top").select("term", "other"), "drops")
    earlier = drops.filter("term < other").select(F.col("term").alias("by"), F.col("other").alias("term"))
    state = scratch.keep(rows.select("term").distinct().withColumn("looks", F.lit(None).cast("boolean")), "state0")
    k = 0
    while state.filter("looks IS NULL").limit(1).count():
        by = earlier.join(state.select(F.col("term").alias("by"), F.col("looks").alias("by_looks")), "by")
        # True where a settled term drops it, null where one isn't settled, else false.
        gone = by.groupBy("term").agg(F.max("by_looks").alias("dropped"), F.count(F.when(F.col("by_looks").isNull(), 1)).alias("open"))
        settled = F.when(F.coalesce("dropped", F.lit(False)), False).when(F.coalesce("open", F.lit(0)) == 0, True)
        k += 1
        state = scratch.keep(state.join(gone, "term", "left").select("term", F.coalesce("looks", settled).alias("looks")), f"state{k}")
        scratch.drop(f"state{k - 1}")
    return drops.join(state.filter("looks").select("term"), "term", "left_semi").select(F.col("other").alias("term")).distinct()


def without_redundant(matrix: DataFrame, scratch: Scratch, cut: float, share: float = 0.8) -> DataFrame:
    """``matrix`` without the rows of ``redundant_terms``."""
    return matrix.join(redundant_terms(matrix, scratch, cut, share), "term", "left_anti")


def pair_enrichment(pairs: DataFrame, sets: DataFrame, universe: DataFrame, both: bool = True) -> DataFrame:
    """(term, n, firsts, seconds, pval): exact tests of the sets (term, gene) for pairs (a, b) of genes of ``universe`` (gene).

    With ``both``, pairs count whose genes are both in the set.  firsts and seconds list
    the set's genes that stand first and second, comma-joined in order; n is twice the
    smaller number, and is tested against the set's size and the number of genes in
    pairs.  Sets with n under 2 are left out; p is null where the table would hold
    negative counts.
    """
    known = universe.select("gene").distinct()
    inside = lambda x, c: x.join(known.select(F.col("gene").alias(c)), c, "left_semi")
    pairs, sets = inside(inside(pairs.select("a", "b").distinct(), "a"), "b"), inside(sets.select("term", "gene").distinct(), "gene")
    of = lambda c: sets.select("term", F.col("gene").alias(c))
    if both:
        met = pairs.join(of("a"), "a").join(of("b"), ["term", "b"])
        ends = met.select("term", F.col("a").alias("gene"), F.lit(1).alias("side")).union(met.select("term", "b", F.lit(2)))
    else:
        ends = pairs.select("a").distinct().join(of("a"), "a").select("term", F.col("a").alias("gene"), F.lit(1).alias("side")).union(pairs.select("b").distinct().join(of("b"), "b").select("term", "b", F.lit(2)))
    genes = lambda k: F.collect_set(F.when(F.col("side") == k, F.col("gene")))
    x = ends.groupBy("term").agg(genes(1).alias("f"), genes(2).alias("s")).withColumn("n", (2 * F.least(F.size("f"), F.size("s"))).cast("long")).filter("n >= 2")
    paired = pairs.select(F.explode(F.array("a", "b")).alias("gene")).agg(F.countDistinct("gene").alias("paired"))
    x = x.join(sets.groupBy("term").agg(F.count("*").alias("size")), "term").crossJoin(F.broadcast(paired)).crossJoin(F.broadcast(known.agg(F.count("*").alias("all"))))
    x = x.withColumns({"a": F.col("n"), "b": F.col("size") - F.col("n"), "c": F.col("paired") - F.col("n")}).withColumn("d", F.col("all") - F.col("a") - F.col("b") - F.col("c"))
    x = x.withColumn("usable", F.least("b", "c", "d") >= 0).withColumns({k: F.when(F.col("usable"), F.col(k)).otherwise(0).cast("long") for k in "abcd"})
    text = lambda c: F.array_join(F.array_sort(F.transform(c, lambda g: g.cast("string"))), ",")
    return with_fisher(x).select("term", "n", text("f").alias("firsts"), text("s").alias("seconds"), F.when(F.col("usable"), F.col("pval")).alias("pval"))
