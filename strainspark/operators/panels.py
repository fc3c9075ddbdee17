"""Marker panels: correlations of genes, and the best allele of each slot for a genome."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strainspark.operators.curation import draw
from strainspark.operators.ranking import first_of
from strainspark.operators.relations import combinations


def rank_correlations(matrix: DataFrame) -> DataFrame:
    """(g1, g2, n, rho) of all pairs of genes g1 < g2 over all samples, those without a value as 0.

    Each gene is ranked once; zeros share a rank, which is shifted to 0, so that only
    the other values meet in one join on the sample, and the rest is moments of
    single genes.  Null where a gene has one value throughout.
    """
    n = matrix.agg(F.countDistinct("sample").alias("n"))
    x = matrix.filter("value <> 0").crossJoin(F.broadcast(n))
    gene = Window.partitionBy("gene")
    x = x.withColumn("nz", F.count("*").over(gene))
    # Values are positive, so zeros come before them; equal values share their mean rank.
    place = F.rank().over(gene.orderBy("value")) + (F.count("*").over(Window.partitionBy("gene", "value")) - 1) / 2
    ranked = x.select("sample", "gene", "n", (place + (F.col("n") - F.col("nz") - 1) / 2).alias("r"))
    mean, square = F.sum("r") / F.first("n"), F.sum(F.col("r") * F.col("r")) / F.first("n")
    single = ranked.groupBy("gene").agg(mean.alias("m"), (square - mean * mean).alias("v"), F.first("n").alias("n"))
    a, b = (ranked.select("sample", F.col("gene").alias(g), F.col("r").alias(r)) for g, r in (("g1", "x"), ("g2", "y")))
    both = a.join(b, "sample").filter("g1 < g2").groupBy("g1", "g2").agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    # Pairs without a common sample have no row yet; the genes are few beside the samples.
    one, two = (single.select(F.col("gene").alias(g), F.col("m").alias(f"m{k}"), F.col("v").alias(f"v{k}"), F.col("n").alias(f"n{k}")) for g, k in (("g1", 1), ("g2", 2)))
    pairs = one.join(two, F.col("g1") < F.col("g2")).join(both, ["g1", "g2"], "left")
    cov = F.coalesce("xy", F.lit(0.0)) / F.col("n1") - F.col("m1") * F.col("m2")
    return pairs.select("g1", "g2", F.col("n1").alias("n"), F.when((F.col("v1") > 1e-9) & (F.col("v2") > 1e-9), cov / F.sqrt(F.col("v1") * F.col("v2"))).alias("rho"))


def chosen_panels(choices: DataFrame, correlations: DataFrame, slots: list[str], least: float) -> DataFrame:
    """(genome, the slots, rho): each genome's combination of one gene a slot with the largest mean correlation, above ``least``.

    ``choices``: (genome, slot, gene); ``correlations``: (g1, g2, rho), g1 < g2.  The
    mean is over the whole square of the combination's genes, the diagonal's ones
    included; a missing correlation counts 0.  Genomes without a choice for some
    slot have no combination.  Of equal means the first genes in order.
    """
    combos = combinations(choices, "genome", "slot", "gene", slots)
    genes = F.array(*slots)
    k = len(slots)
    pairs = [F.struct(F.least(slots[i], slots[j]).alias("g1"), F.greatest(slots[i], slots[j]).alias("g2")) for i in range(k) for j in range(i + 1, k)]
    each = combos.withColumn("__genes", genes).select("genome", *slots, F.explode(F.array(*pairs)).alias("p")).select("genome", *slots, "p.g1", "p.g2")
    met = each.join(correlations, ["g1", "g2"], "left").withColumn("r", F.when(F.col("g1") == F.col("g2"), 1.0).otherwise(F.coalesce("rho", F.lit(0.0))))
    means = met.groupBy("genome", *slots).agg(((2 * F.sum("r") + k) / (k * k)).alias("rho"))
    best = first_of(means.withColumn("__r", F.round("rho", 9)), ["genome"], [F.desc("__r"), *[F.asc(s) for s in slots]])
    return best.filter(F.col("rho") > least).select("genome", *slots, "rho")


def random_panels(choices: DataFrame, seed: str = "3") -> DataFrame:
    """(genome, slot, gene): one gene a slot, chosen by a hash of the seed."""
    return first_of(choices.distinct(), ["genome", "slot"], [draw(seed, F.col("genome"), F.col("slot"), F.col("gene")), F.asc("gene")]).select("genome", "slot", "gene")


def predicted_genes(found: DataFrame, core: DataFrame, least_n: int = 100, most_p: float = 5e-3, deviations: float = 1.5) -> DataFrame:
    """(gene, rho) of genes with enough samples and a small p whose rho exceeds the mean of the core genes' less ``deviations`` of theirs.

    ``found``: (gene, n, rho, pval); ``core``: (gene).
    """
    enough = found.filter(F.col("n") >= least_n)
    cut = enough.join(core.distinct(), "gene", "left_semi").agg((F.avg("rho") - deviations * F.stddev_samp("rho")).alias("cut"))
    return enough.crossJoin(F.broadcast(cut)).filter((F.col("rho") > F.col("cut")) & (F.col("pval") < most_p)).select("gene", "rho").distinct()
