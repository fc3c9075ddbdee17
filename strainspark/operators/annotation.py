"""Joins of genes, proteins, genomes and their annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strainspark.functions.numeric import ratio


def kegg_table(rows: DataFrame) -> DataFrame:
    """(id, ko) of eggNOG rows (id, id2, kos) that name a ko: both ids (the second cut to 22 characters), one row a KO without its prefix."""
    named = rows.filter(F.contains("kos", F.lit("ko:")))
    ids = named.select(F.explode(F.array(F.col("id"), F.substring("id2", 1, 22))).alias("id"), F.explode(F.split("kos", ",")).alias("ko"))
    return ids.filter(F.startswith("ko", F.lit("ko:"))).select("id", F.substring("ko", 4, 8).alias("ko")).distinct()


def genes_of_groups(kos: DataFrame, genes: DataFrame) -> DataFrame:
    """(gene, ko, grp): all pairs of genes and groups that share a KO; many to many, so both sides are made distinct first."""
    return genes.select("gene", "ko").distinct().join(kos.select("ko", "grp").distinct(), "ko").select("gene", "ko", "grp")


def same_sequence(proteins: DataFrame, known: DataFrame, sep: str = "|") -> DataFrame:
    """(id, hits): ids of ``known`` (id, seq) with exactly the same sequence, in any letter case, joined; empty where there is none."""
    key = lambda: F.sha2(F.upper("seq").cast("binary"), 256).alias("key")
    lists = known.select("id", key()).groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("id")), sep).alias("hits"))
    return proteins.select("id", key()).join(lists, "key", "left").select("id", F.coalesce("hits", F.lit("")).alias("hits"))


def hit_lists(hits: DataFrame, least: float) -> DataFrame:
    """(query, n, targets): targets of each query with at least ``least`` identity, joined in order."""
    return hits.filter(F.col("pident") >= least).groupBy("query").agg(F.countDistinct("target").alias("n"), F.array_join(F.array_sort(F.collect_set(F.col("target").cast("string"))), ",").alias("targets"))


def panel_with_hits(panel: DataFrame, lists: DataFrame) -> DataFrame:
    """(genome, gene, ids): a panel's ids with their joined hits in their place; ids without hits stay."""
    return panel.join(lists.select(F.col("query").cast("string").alias("id"), "targets"), "id", "left").select("genome", "gene", F.coalesce("targets", "id").alias("ids"))


def genomes_with_all(hits: DataFrame, panel: DataFrame) -> DataFrame:
    """(panel, genome, gene, target): genomes that have a hit of every gene of a panel, with the target of the highest identity for each.

    ``hits``: (panel, gene, genome, target, pident); ``panel``: (panel, gene).
    Genomes are joined by their whole id; of equal identities the smaller target.
    """
    size = panel.distinct().groupBy("panel").agg(F.count("*").alias("size"))
    best = hits.groupBy("panel", "gene", "genome").agg(F.min(F.struct((-F.col("pident")).alias("p"), F.col("target").alias("t"))).alias("b"))
    best = best.join(panel.distinct(), ["panel", "gene"], "left_semi")
    whole = best.groupBy("panel", "genome").agg(F.count("*").alias("n")).join(size, "panel").filter("n = size").select("panel", "genome")
    return best.join(whole, ["panel", "genome"], "left_semi").select("panel", "genome", "gene", F.col("b.t").alias("target"))


def symbol_rows(rows: DataFrame, column: str, symbols: DataFrame, sep: str = "[,;|]") -> DataFrame:
    """(symbol, row): rows whose delimited list holds a symbol as a whole item."""
    items = rows.select("row", F.explode(F.split(column, sep)).alias("symbol")).select("row", F.trim("symbol").alias("symbol")).distinct()
    return items.join(symbols.select("symbol").distinct(), "symbol").select("symbol", "row")


def gene_symbol(gene: Column, alias: Column, kegg: Column, genome: Column) -> Column:
    """A gene's symbol: its own name, else the alias, else KEGG's, without what follows an underline, if it begins with a
    small letter and has more than two characters; else ``<genome>_group``."""
    name = F.coalesce(*[F.when(x != "", x) for x in (gene, alias, kegg)])
    short = F.regexp_replace(name, "_.*$", "")
    return F.when(F.rlike(short, F.lit("^[a-z]")) & (F.length(short) > 2), short).otherwise(F.concat(genome, F.lit("_group")))


def one_to_one(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs whose two sides are in no other pair."""
    x = pairs.select(a, b).distinct()
    only = lambda c: x.groupBy(c).agg(F.count("*").alias("__n")).filter("__n = 1").select(c)
    return x.join(only(a), a, "left_semi").join(only(b), b, "left_semi")


def summed_by_genome(presence: DataFrame, table: DataFrame) -> DataFrame:
    """(genome, ko, n): gene counts summed by the genes' KOs or symbols; ``presence``: (genome, gene, n), ``table``: (gene, ko)."""
    return presence.join(table.select("gene", "ko").distinct(), "gene").groupBy("genome", "ko").agg(F.sum("n").alias("n"))


def top_group(rows: DataFrame, cluster: str, group: str, minor: str) -> DataFrame:
    """(cluster, group, n, n2): each cluster's annotation group of most rows, of equals the one of fewer distinct ``minor``, then the smaller name."""
    x = rows.groupBy(cluster, group).agg(F.count("*").alias("n"), F.countDistinct(minor).alias("n2"))
    order = Window.partitionBy(cluster).orderBy(F.desc("n"), "n2", group)
    return x.withColumn("__k", F.row_number().over(order)).filter("__k = 1").drop("__k")


def line_ranges(lines: DataFrame) -> DataFrame:
    """(gene, first, last): line numbers of each gene's lines; header lines, whose sample is ``Sample``, don't count.  First and last belong to the gene."""
    return lines.filter(F.col("sample") != "Sample").groupBy("gene").agg(F.min("line").alias("first"), F.max("line").alias("last"))


def accessions(panel: DataFrame, names: DataFrame) -> DataFrame:
    """(accession) of the genomes of a panel's alleles (allele without its final number), and of the panel's own genomes, each once."""
    genomes = panel.select(F.regexp_replace("allele", r"_\d+$", "").alias("genome")).distinct()
    return genomes.join(names, "genome").select("accession").union(panel.filter("accession IS NOT NULL").select("accession")).distinct()


def contaminated(markers: DataFrame, groups: DataFrame, most: float) -> DataFrame:
    """Adds ``residual`` of a line of log means inside against outside a group, and ``clean``: residual of ``most`` or more.

    ``markers``: (ident, gene, mean, ref_mean), both positive; the line is least
    squares within each ident of ``groups`` (ident), by grouped moments.
    """
    x = markers.join(groups.distinct(), "ident", "left_semi").filter("mean > 0 AND ref_mean > 0").withColumns({"__y": F.log2("mean"), "__x": F.log2("ref_mean")})
    line = x.groupBy("ident").agg(ratio(F.covar_pop("__x", "__y"), F.var_pop("__x")).alias("__b"), F.avg("__x").alias("__mx"), F.avg("__y").alias("__my"))
    res = F.col("__y") - F.col("__my") - F.coalesce("__b", F.lit(0.0)) * (F.col("__x") - F.col("__mx"))
    return x.join(line, "ident").withColumn("residual", res).withColumn("clean", F.col("residual") >= most).select("ident", "gene", "mean", "ref_mean", "residual", "clean")


def signature_stats(cells: DataFrame, groups: DataFrame, sets: DataFrame) -> DataFrame:
    """(ident, signature, n, alpha, mean): of each group and gene set, expressing (cell, gene) pairs, their share of all, and the mean over all.

    ``cells``: (cell, gene, count), zeros left out; ``groups``: (cell, ident); ``sets``: (signature, gene).
    """
    sizes = groups.groupBy("ident").agg(F.count("*").alias("cells"))
    genes = sets.distinct().groupBy("signature").agg(F.count("*").alias("genes"))
    hit = cells.filter("count > 0").join(groups, "cell").groupBy("ident", "gene").agg(F.count("*").alias("n"), F.sum("count").alias("s"))
    found = hit.join(sets.distinct(), "gene").groupBy("ident", "signature").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    out = found.join(sizes, "ident").join(genes, "signature")
    pairs = F.col("cells") * F.col("genes")
    return out.select("ident", "signature", "n", ratio(F.col("n"), pairs).alias("alpha"), ratio(F.col("s"), pairs).alias("mean"))
