"""Alignments to allele counts to consensus genotypes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strainspark.functions.numeric import ratio
from strainspark.functions.sequence import (allele_order, cigar_operations, codon_position, identity, located, matched_length, mismatches,
                                            reverse_complement)


def identity_filter(sam: DataFrame, least: float = 90.0) -> DataFrame:
    """Alignments whose matches less mismatches make ``least`` per cent of the read; unaligned ones go."""
    rows = sam.filter("rname <> '*' AND cigar <> '*'")
    return rows.filter(F.round(100 * identity(F.col("cigar"), mismatches(F.array_join("tags", "\t"))), 9) >= least)


def carried_sequences(sam: DataFrame) -> DataFrame:
    """Secondary rows' * sequences and qualities from the last row of the query that has them.

    Where the strands differ the sequence is reverse complemented and the quality reversed.
    """
    w = Window.partitionBy("qname").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    known = F.last(F.when(F.col("seq") != "*", F.struct("seq", "qual", F.col("flag").bitwiseAND(16).alias("strand"))), ignorenulls=True).over(w)
    rows = sam.withColumn("__k", known)
    turned = F.col("flag").bitwiseAND(16) != F.col("__k.strand")
    seq = F.when(turned, reverse_complement(F.col("__k.seq"))).otherwise(F.col("__k.seq"))
    qual = F.when(turned, F.reverse(F.col("__k.qual"))).otherwise(F.col("__k.qual"))
    missing = F.col("seq") == "*"
    return rows.withColumns({"qual": F.when(missing & F.col("__k").isNotNull(), qual).otherwise(F.col("qual")), "seq": F.when(missing & F.col("__k").isNotNull(), seq).otherwise(F.col("seq"))}).drop("__k")


def aligned_bases(sam: DataFrame) -> DataFrame:
    """(contig, pos, allele, quality, mapq) of each base that an alignment matches."""
    start = F.struct(F.lit(0).alias("read"), F.col("pos").alias("ref"), F.array().cast("array<struct<n:int,read:int,ref:int>>").alias("out"))

    def step(acc, x):
        n, op = x["n"], x["op"]
        read = acc["read"] + F.when(op.isin("M", "I", "S", "=", "X"), n).otherwise(0)
        ref = acc["ref"] + F.when(op.isin("M", "D", "N", "=", "X"), n).otherwise(0)
        run = F.array(F.struct(n.alias("n"), acc["read"].alias("read"), acc["ref"].alias("ref")))
        return F.struct(read.alias("read"), ref.alias("ref"), F.when(op.isin("M", "=", "X"), F.concat(acc["out"], run)).otherwise(acc["out"]).alias("out"))

    runs = sam.select("rname", "seq", "qual", "mapq", F.explode(F.aggregate(cigar_operations(F.col("cigar")), start, step)["out"]).alias("r"))
    each = runs.select("rname", "seq", "qual", "mapq", F.col("r.read").alias("read"), F.col("r.ref").alias("ref"), F.explode(F.expr("sequence(0, r.n - 1)")).alias("k"))
    base, quality = F.substring("seq", F.col("read") + F.col("k") + 1, F.lit(1)), F.ascii(F.substring("qual", F.col("read") + F.col("k") + 1, F.lit(1))) - 33
    return each.select(F.col("rname").alias("contig"), (F.col("ref") + F.col("k")).alias("pos"), F.upper(base).alias("allele"), quality.alias("quality"), "mapq")


def allele_counts(bases: DataFrame, least_quality: int = 10, least_mapq: int = 0) -> DataFrame:
    """(contig, pos, allele, n): one map-side combined aggregation over good bases."""
    good = bases.filter((F.col("quality") >= least_quality) & (F.col("mapq") >= least_mapq) & (F.col("allele") != "-"))
    return good.groupBy("contig", "pos", "allele").agg(F.count("*").alias("n"))


def pileup_report(counts: DataFrame, by: list[str], depth: int = 1) -> DataFrame:
    """Adds consensus and freq (per cent) after dropping counts of ``depth`` or less; ties take the first letter."""
    kept = counts.filter(F.col("n") > depth)
    site = Window.partitionBy(*by)
    consensus = F.first("allele").over(site.orderBy(F.desc("n"), "allele").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return kept.withColumn("consensus", consensus).withColumn("freq", ratio(100 * F.col("n"), F.sum("n").over(site)))


def consensus_alleles(counts: DataFrame, by: list[str]) -> DataFrame:
    """(by, allele, n): the most frequent allele; of equals the first in ACGTN."""
    k = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), allele_order(F.col("allele")), "allele"))
    return counts.withColumn("__k", k).filter("__k = 1").select(*by, "allele", "n")


def site_filters(counts: DataFrame, sample_share: float = 0.5, site_share: float = 0.05, reads: int = 10) -> DataFrame:
    """Counts (gene, sample, pos, allele, n) after three filters, in this order.

    Samples covering ``sample_share`` of the gene's sites; sites covered by
    ``site_share`` of the remaining samples; sites with two alleles of ``reads``
    reads in some of those samples.
    """
    sites = counts.groupBy("gene").agg(F.countDistinct("pos").alias("sites"))
    covered = counts.groupBy("gene", "sample").agg(F.countDistinct("pos").alias("c")).join(sites, "gene").filter(F.col("c") >= sample_share * F.col("sites"))
    x = counts.join(covered.select("gene", "sample"), ["gene", "sample"], "left_semi")
    samples = x.groupBy("gene").agg(F.countDistinct("sample").alias("samples"))
    wide = x.groupBy("gene", "pos").agg(F.countDistinct("sample").alias("c")).join(samples, "gene").filter(F.col("c") >= site_share * F.col("samples"))
    x = x.join(wide.select("gene", "pos"), ["gene", "pos"], "left_semi")
    poly = x.filter(F.col("n") >= reads).groupBy("gene", "pos").agg(F.countDistinct("allele").alias("a")).filter("a >= 2")
    return x.join(poly.select("gene", "pos"), ["gene", "pos"], "left_semi")


def majority_by_deepest(counts: DataFrame, subjects: DataFrame, least_depth: float) -> DataFrame:
    """(subject, sample, gene, pos, allele): consensus of each subject's deepest sample of mean depth over ``least_depth``."""
    depth = counts.groupBy("gene", "sample").agg(ratio(F.sum("n"), F.countDistinct("pos")).alias("depth")).filter(F.col("depth") > least_depth)
    ranked = depth.join(subjects, "sample").withColumn("__k", F.row_number().over(Window.partitionBy("gene", "subject").orderBy(F.desc("depth"), "sample")))
    best = ranked.filter("__k = 1").select("gene", "subject", "sample")
    return consensus_alleles(counts.join(best, ["gene", "sample"]), ["subject", "sample", "gene", "pos"]).drop("n")


def overlaid(reference: DataFrame, called: DataFrame) -> DataFrame:
    """(sample, gene, seq): the reference sequence with called alleles in place, N where nothing covers."""
    each = reference.select("gene", F.posexplode(F.split("seq", "")).alias("k", "r")).withColumn("pos", F.col("k") + 1)
    samples = called.select("sample", "gene").distinct()
    full = samples.join(each, "gene").join(called.select("sample", "gene", "pos", "allele"), ["sample", "gene", "pos"], "left")
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("allele", F.lit("N")).alias("c")))), lambda x: x["c"]), "")
    return full.groupBy("sample", "gene").agg(ordered.alias("seq"))


def concatenated(alignments: DataFrame, genes: DataFrame) -> DataFrame:
    """(sample, seq): genes' aligned sequences in order of (ord), N's of its length where a sample lacks one."""
    lengths = alignments.groupBy("gene").agg(F.max(F.length("seq")).alias("n"))
    universe = alignments.select("sample").distinct().crossJoin(F.broadcast(genes.join(lengths, "gene")))
    full = universe.join(alignments, ["sample", "gene"], "left").select("sample", "ord", F.coalesce("seq", F.repeat(F.lit("N"), F.col("n"))).alias("seq"))
    return full.groupBy("sample").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "seq"))), lambda x: x["seq"]), "").alias("seq"))


def genes_at(features: DataFrame, contigs: DataFrame) -> DataFrame:
    """(gene, id, seq): the features' bases from their contigs, one equi-join."""
    return features.join(contigs.select(F.col("id").alias("contig"), F.col("seq").alias("__s")), "contig").select("gene", "id", located(F.col("__s"), F.col("beg"), F.col("end"), F.col("strand")).alias("seq"))


def in_codons(rows: DataFrame, genes: DataFrame) -> DataFrame:
    """Pileup rows with the gene, its reference base and codon place; a gene has each of its places, so the join is on (contig, pos)."""
    each = genes.select("contig", "gene", "beg", "strand", F.posexplode(F.split("seq", "")).alias("k", "ref"))
    sites = each.select("contig", (F.col("beg") + F.col("k")).alias("pos"), "gene", "ref", codon_position(F.col("beg") + F.col("k"), F.col("beg"), F.col("strand")).alias("codon"))
    return rows.join(sites, ["contig", "pos"])


def aligned_length(sam: DataFrame) -> DataFrame:
    return sam.withColumn("matched", matched_length(F.col("cigar")))
