"""Cleaning of metadata, names and labels; filters, fills and orders of tidy tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strainspark.functions.numeric import ratio
from strainspark.operators.ranking import quotas

RANKS = ("domain", "phylum", "class", "order", "family", "genus", "species")


def draw(*parts: Column | str) -> Column:
    """A uniform number in [0, 1) from a hash of the parts' text, the same in every engine that has md5."""
    text = F.concat_ws(":", *[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def renamed(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns by their short names; columns that ``names`` lacks stay."""
    return rows.withColumnsRenamed(names)


def cleaned_metadata(rows: DataFrame) -> DataFrame:
    """Adds nice_dx2 (IBDU counts as CD) and nice_dx (CD and UC are IBD); age becomes a number, null where it is blank
    or has a capital letter; sex is M, F or null."""
    dx = F.regexp_replace("dx", "IBDU", "CD")
    age = F.when(~F.rlike(F.col("age"), F.lit("[A-Z]")) & (F.col("age") != ""), F.expr("try_cast(age AS double)"))
    return rows.withColumns({"nice_dx2": dx, "nice_dx": F.regexp_replace(dx, "CD|UC", "IBD"), "age": age, "sex": F.when(F.col("sex").isin("M", "F"), F.col("sex"))})


def imputed_metadata(rows: DataFrame, key: str, numbers: list[str], category: str, first: str, second: str, least: int = 10) -> DataFrame:
    """Adds nice_ columns: numbers with their mean in place of nulls, as z-scores of the filled column; a missing category drawn
    with the known shares.  A column with fewer than ``least`` known values is drawn whole: standard normal, or either
    category with equal chance.  Draws are hashes of the key, so they don't depend on partitioning."""
    known = rows.agg(*[F.count(c).alias(f"n_{c}") for c in numbers], *[F.avg(c).alias(f"m_{c}") for c in numbers],
                     F.count(category).alias("n_cat"), ratio(F.count(F.when(F.col(category) == first, 1)), F.count(category)).alias("share"))
    one = rows.crossJoin(F.broadcast(known))
    for c in numbers:
        normal = F.sqrt(-2 * F.log(1 - draw(c, "1", F.col(key)))) * F.cos(2 * math.pi * draw(c, "2", F.col(key)))
        one = one.withColumn(f"nice_{c}", F.when(F.col(f"n_{c}") < least, normal).otherwise(F.coalesce(F.col(c), F.col(f"m_{c}"))))
    share = F.when(F.col("n_cat") < least, F.lit(0.5)).otherwise(F.col("share"))
    drawn = F.when(draw(category, F.col(key)) < share, first).otherwise(second)
    one = one.withColumn(f"nice_{category}", F.when(F.col("n_cat") < least, drawn).otherwise(F.coalesce(F.col(category), drawn)))
    moments = one.agg(*[x for c in numbers for x in (F.avg(f"nice_{c}").alias(f"a_{c}"), F.stddev_samp(f"nice_{c}").alias(f"s_{c}"))])
    one = one.crossJoin(F.broadcast(moments))
    scaled = {f"nice_{c}": ratio(F.col(f"nice_{c}") - F.col(f"a_{c}"), F.col(f"s_{c}")) for c in numbers}
    return one.withColumns(scaled).select(*rows.columns, *[f"nice_{c}" for c in numbers], f"nice_{category}")


def complete(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without a null or an empty text in ``columns``."""
    kept = F.lit(True)
    for c in columns:
        kept = kept & F.col(c).isNotNull() & (F.col(c).cast("string") != "")
    return rows.filter(kept)


def taxonomy(lineage: Column) -> dict[str, Column]:
    """The seven ranks of a lineage such as d__A;p__B_C: without rank letters and a final capital-letter suffix; missing ranks are empty."""
    parts = F.split(lineage, ";")
    clean = lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), "^[dpcofgs]__", ""), "_[A-Z]$", "")
    return {rank: F.coalesce(clean(F.get(parts, F.lit(k))), F.lit("")) for k, rank in enumerate(RANKS)}


def nice_name(ranks: dict[str, Column]) -> Column:
    """A label from the deepest rank that is neither blank nor holds a digit; null where no rank is.

    A blank species is ``<genus> sp.`` first (blank if the genus is too).  Then: the
    species; ``<genus> sp.``; ``<species> (<rank's value> <rank>)`` where the species
    is named but not nice; else ``<rank's value> <rank> microbe``.
    """
    species = F.when(ranks["species"] != "", ranks["species"]).when(ranks["genus"] != "", F.concat(ranks["genus"], F.lit(" sp."))).otherwise(F.lit(""))
    all_ = {**ranks, "species": species}
    nice = {r: (all_[r] != "") & ~F.rlike(all_[r], F.lit(r"\d")) for r in RANKS}
    out = F.lit(None).cast("string")
    for r in RANKS[:5]:  # deeper ranks come later and win
        at = F.concat(all_[r], F.lit(f" {r}"))
        out = F.when(nice[r], F.when(species != "", F.concat(species, F.lit(" ("), at, F.lit(")"))).otherwise(F.concat(at, F.lit(" microbe")))).otherwise(out)
    out = F.when(nice["genus"], F.concat(all_["genus"], F.lit(" sp."))).otherwise(out)
    return F.when(nice["species"], species).otherwise(out)


def without_diagnosis(label: Column) -> Column:
    """A sample label without its diagnosis suffix."""
    return F.regexp_replace(label, "_(HC|UC|CD|IBDU|IBD)$", "")


def diagnosis(label: Column) -> Column:
    """The diagnosis suffix of a sample label, null where it has none."""
    found = F.regexp_extract(label, "_(HC|UC|CD|IBDU|IBD)$", 1)
    return F.when(found != "", found)


def reference_name(label: Column) -> Column:
    """GUTREFGUTGENOME and six digits, anywhere in a label, as GUT_GENOME and these digits; other labels stay."""
    digits = F.regexp_extract(label, r"GUTREFGUTGENOME(\d{6})", 1)
    return F.when(digits != "", F.concat(F.lit("GUT_GENOME"), digits)).otherwise(label)


def matching(text: Column, include: list[str], exclude: list[str] = ()) -> Column:
    """Whether a text fits every pattern of ``include`` and none of ``exclude``."""
    fits = F.lit(True)
    for p in include:
        fits = fits & F.rlike(text, F.lit(p))
    for p in exclude:
        fits = fits & ~F.rlike(text, F.lit(p))
    return F.coalesce(fits, F.lit(False))


def selected_cells(cells: DataFrame, covariates: list[str], group: str, batch: str, key: str, total: int) -> DataFrame:
    """Cells whose covariates are known, ``total`` at most, evenly over group and batch: quotas fill smaller ones first; which cells stay is a hash of the key."""
    known = cells.dropna(subset=covariates).withColumn("__g", F.concat_ws("/", F.col(group).cast("string"), F.col(batch).cast("string")))
    sizes = known.groupBy("__g").agg(F.count("*").alias("__n"))
    wanted = quotas(sizes, "__g", "__n", F.lit(total))
    place = F.row_number().over(Window.partitionBy("__g").orderBy(draw("cell", F.col(key)), key))
    return known.withColumn("__k", place).join(wanted.select("__g", "quota"), "__g").filter("__k <= quota").drop("__k", "__g", "quota")


def selected_genes(stats: DataFrame, least_cells: int, least_alpha: float, least_fold: float) -> DataFrame:
    """Rows of (gene, ident, n, alpha, ref_alpha, log2fc) expressed in enough cells, in a large enough share of either side, with a large enough fold."""
    return stats.filter((F.col("n") >= least_cells) & (F.greatest("alpha", "ref_alpha") >= least_alpha) & (F.abs("log2fc") >= least_fold))


def filtered_cells(cells: DataFrame, least_cells: int, least_genes: int, most_genes: int, keep: str | None = None, drop: str | None = None, repeated: bool = True) -> DataFrame:
    """(cell, gene, count) of genes in at least ``least_cells`` cells, then of cells with ``least_genes`` to ``most_genes`` genes.

    ``keep`` and ``drop`` are patterns of cell names; null genes go.  Where no cell and
    gene come in two rows, ``repeated=False`` spares the tables of distinct ones.
    """
    number = lambda c: (F.countDistinct(c) if repeated else F.count(c)).alias("n")
    x = cells.filter(F.col("gene").isNotNull() & (F.col("count") > 0))
    if keep:
        x = x.filter(F.rlike(F.col("cell").cast("string"), F.lit(keep)))
    if drop:
        x = x.filter(~F.rlike(F.col("cell").cast("string"), F.lit(drop)))
    genes = x.groupBy("gene").agg(number("cell")).filter(F.col("n") >= least_cells)
    x = x.join(genes.select("gene"), "gene", "left_semi")
    sizes = x.groupBy("cell").agg(number("gene")).filter(F.col("n").between(least_genes, most_genes))
    return x.join(sizes.select("cell"), "cell", "left_semi").select("cell", "gene", "count")


def filtered_markers(markers: DataFrame, most_p: float, least_fold: float, unique: bool, top: int) -> DataFrame:
    """Markers by p, fold and, if ``unique``, genes that pass in one contrast only; the ``top`` of each contrast by p, then fold, then gene."""
    x = markers.filter((F.col("pval") <= most_p) & (F.col("log2fc") >= least_fold))
    if unique:
        x = x.withColumn("__n", F.count("*").over(Window.partitionBy("gene"))).filter("__n = 1").drop("__n")
    order = Window.partitionBy("contrast").orderBy("pval", F.desc("log2fc"), "gene")
    return x.withColumn("__k", F.row_number().over(order)).filter(F.col("__k") <= top).drop("__k")


def present_in_a_class(presence: DataFrame, classes: DataFrame, share: float = 0.05) -> DataFrame:
    """(feature, best) of features present in more than ``share`` of the samples of any class; ``presence``: (sample, feature)."""
    sizes = classes.groupBy("class").agg(F.countDistinct("sample").alias("size"))
    found = presence.distinct().join(classes, "sample").groupBy("feature", "class").agg(F.countDistinct("sample").alias("n")).join(sizes, "class")
    return found.groupBy("feature").agg(F.max(ratio(F.col("n"), F.col("size"))).alias("best")).filter(F.col("best") > share)


def term_name(term: Column, length: int) -> Column:
    """An enrichment term's text: without a bracketed id at its end, blanks for underlines, first letter upper case, cut to ``length``."""
    text = F.trim(F.regexp_replace(F.regexp_replace(term, r"\s*\([^()]*:[^()]*\)$", ""), "_+", " "))
    return F.substring(F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 2147483647))), 1, length)


def collapsed(markers: DataFrame, by: list[str], numbers: list[str], others: list[str], order: str) -> DataFrame:
    """One row a key: means of ``numbers``, and of ``others`` the value that comes first by ``order``."""
    return markers.groupBy(*by).agg(*[F.avg(c).alias(c) for c in numbers], *[F.min_by(c, order).alias(c) for c in others])


def frequencies(rows: DataFrame, column: str) -> DataFrame:
    """(value, n) of a column, null included."""
    return rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def filled(rows: DataFrame, group: str, number: str, category: str) -> DataFrame:
    """Nulls of a number by its group's mean and of a category by its group's mode; of equal modes the smallest."""
    means = rows.groupBy(group).agg(F.avg(number).alias("__mean"))
    counts = rows.filter(F.col(category).isNotNull()).groupBy(group, category).agg(F.count("*").alias("__n"))
    modes = counts.groupBy(group).agg(F.min(F.struct((-F.col("__n")).alias("n"), F.col(category).alias("c"))).alias("__m")).select(group, F.col("__m.c").alias("__mode"))
    return (rows.join(means, group, "left").join(modes, group, "left").withColumn(number, F.coalesce(number, "__mean"))
            .withColumn(category, F.coalesce(category, "__mode")).drop("__mean", "__mode"))


def near_mean(rows: DataFrame, value: str, by: list[str], most: float = 3.0) -> DataFrame:
    """Rows whose z-score in their group, by the population deviation, is below ``most``; a group without a deviation stays whole."""
    moments = rows.groupBy(*by).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    z = F.abs(ratio(F.col(value) - F.col("__m"), F.col("__s")))
    return rows.join(moments, by).filter(F.coalesce(z < most, F.lit(True))).drop("__m", "__s")


def running_max(rows: DataFrame, value: str, by: list[str], order: list[Column], out: str) -> DataFrame:
    """The largest value so far in each group's order."""
    return rows.withColumn(out, F.max(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def max_filled(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Nulls of a column by its group's largest value."""
    return rows.withColumn(value, F.coalesce(F.col(value), F.max(value).over(Window.partitionBy(*by))))


def argmax_places(rows: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """(row, peak, value): each row's column of the largest value, of equals the smallest; ordered by peak, value, row it is a heat map's order."""
    best = rows.groupBy(row).agg(F.min(F.struct((-F.col(value)).alias("v"), F.col(column).alias("c"))).alias("__b"))
    return best.select(row, F.col("__b.c").alias("peak"), (-F.col("__b.v")).alias(value)).orderBy("peak", F.desc(value), row)


def width_bins(rows: DataFrame, value: str, bins: int, out: str = "bin") -> DataFrame:
    """Bins 1 to ``bins`` of equal widths between the least and the largest value; the largest is in the last, and a constant column in the first."""
    ends = rows.agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    place = F.floor(ratio((F.col(value) - F.col("__lo")) * bins, F.col("__hi") - F.col("__lo"))).cast("int")
    found = F.when(F.col(value).isNotNull(), F.least(F.coalesce(place, F.lit(0)) + 1, F.lit(bins)))
    return rows.crossJoin(F.broadcast(ends)).withColumn(out, found).drop("__lo", "__hi")


def frequency_bins(rows: DataFrame, value: str, bins: int, out: str = "bin") -> DataFrame:
    """Bins 1 to ``bins`` of about equal numbers of rows, by quantile edges, so that equal values share a bin."""
    edges = rows.agg(F.array(*[F.percentile(value, F.lit(k / bins)) for k in range(1, bins)]).alias("__e"))
    place = F.size(F.filter("__e", lambda e: e <= F.col(value))) + 1
    return rows.crossJoin(F.broadcast(edges)).withColumn(out, F.when(F.col(value).isNotNull(), place)).drop("__e")


def variable_votes(genes: DataFrame, k: int) -> DataFrame:
    """The ``k`` genes of most votes, (batch, gene) rows; of those with equal votes at the border a hash chooses."""
    votes = genes.distinct().groupBy("gene").agg(F.count("*").alias("votes"))
    return votes.orderBy(F.desc("votes"), draw("vote", F.col("gene")), "gene").limit(k)


def loaded_genes(loadings: DataFrame, n: int) -> DataFrame:
    """(pc, gene, loading, side) of the ``n`` largest and ``n`` smallest loadings of each component."""
    top, low = (Window.partitionBy("pc").orderBy(x, "gene") for x in (F.desc("loading"), F.asc("loading")))
    x = loadings.withColumns({"__t": F.row_number().over(top), "__l": F.row_number().over(low)})
    side = F.when(F.col("__t") <= n, "top").when(F.col("__l") <= n, "bottom")
    return x.withColumn("side", side).filter("side IS NOT NULL").drop("__t", "__l")


def best_estimates(estimates: DataFrame, n: int) -> DataFrame:
    """(uid, loglik) of the ``n`` most likely of each group: no NaN, one of each uid."""
    x = estimates.filter(~F.isnan("loglik") & F.col("loglik").isNotNull()).groupBy("grp", "uid").agg(F.max("loglik").alias("loglik"))
    return x.withColumn("__k", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("loglik"), "uid"))).filter(F.col("__k") <= n).drop("__k")


def swapped(text: Column, changes: dict[int, str]) -> Column:
    """A text with other characters at some places, from 1; places beyond its end are left out."""
    for at, c in sorted(changes.items()):
        text = F.when(F.length(text) >= at, F.overlay(text, F.lit(c), at, 1)).otherwise(text)
    return text


def wrapped(label: Column, words: int) -> Column:
    """A label with a line break after every ``words`` words."""
    parts = F.split(label, " ")
    lines = F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / words).cast("int"))
    return F.array_join(F.transform(lines, lambda k: F.array_join(F.slice(parts, k * words + 1, words), " ")), "\n")


def log_base(matrix: DataFrame) -> DataFrame:
    """One row (base): counts if all values are whole and the largest is over 50, tpm if a sum by sample is near 1e6 or 1e4 as it is,
    2, e or 10 if that is so of the values raised back, else null."""
    back = {"tpm": F.col("value"), "2": F.pow(F.lit(2.0), "value") - 1, "e": F.exp("value") - 1, "10": F.pow(F.lit(10.0), "value") - 1}
    sums = matrix.groupBy("sample").agg(*[F.sum(x).alias(f"s_{k}") for k, x in back.items()], F.max("value").alias("most"), F.bool_and(F.col("value") == F.floor("value")).alias("whole"))
    near = lambda c: F.greatest(*[F.max(F.when(F.abs(F.col(c) / t - 1) < 0.01, 1).otherwise(0)) for t in (1e4, 1e6)]) == 1
    found = F.when(F.bool_and("whole") & (F.max("most") > 50), F.lit("counts"))
    for k in back:
        found = found.when(near(f"s_{k}"), F.lit(k))
    return sums.agg(found.alias("base"))


def chunked(rows: DataFrame, group: str, order: list[Column], n: int, out: str = "chunk") -> DataFrame:
    """``n`` consecutive chunks of about equal size in each group's order."""
    return rows.withColumn(out, F.ntile(n).over(Window.partitionBy(group).orderBy(*order)))
