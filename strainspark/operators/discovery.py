"""Marker genes of groups of cells: all contrasts, one group against the rest or against each other group, in one pass."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strainspark.functions.numeric import ratio
from strainspark.operators.contrasts import two_part
from strainspark.operators.ordering import in_order
from strainspark.operators.ranking import bh_adjusted
from strainspark.scratch import Scratch

#: Groups of cells at most: running counts are a column a group, contrasts a row a pair of groups.
MOST_GROUPS = 200
_SUMS = ("n", "s", "l", "q")


def value_counts(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """(gene, value, ident, n): how many cells of each group have each positive value; cells without a group are left out."""
    known = groups.filter("ident IS NOT NULL").select("cell", "ident")
    return cells.filter("count > 0").join(known, "cell").groupBy("gene", F.col("count").cast("double").alias("value"), "ident").agg(F.count("*").alias("n"))


def group_contrasts(tally: DataFrame, groups: DataFrame, against: str, idents: list[str] | None = None) -> DataFrame:
    """(ident, ref, size, ref_size, zero): one row a contrast; ref is null for the rest of the cells.

    ``zero`` is added before logarithms: a quarter of the least positive value of the
    contrast's cells over their number.  Contrasts without other cells are left out.
    """
    least = tally.groupBy("ident").agg(F.min("value").alias("least"))
    info = groups.filter("ident IS NOT NULL").groupBy("ident").agg(F.count("*").alias("size")).join(least, "ident", "left")
    # One row that lists the groups: MOST_GROUPS entries at most.
    others = info.agg(F.collect_list(F.struct("ident", "size", "least")).alias("all"), F.sum("size").alias("cells"), F.min("least").alias("any_least"))
    x = info.crossJoin(F.broadcast(others))
    if against == "rest":
        x = x.select("ident", F.lit(None).cast(info.schema["ident"].dataType).alias("ref"), "size", (F.col("cells") - F.col("size")).alias("ref_size"), F.col("any_least").alias("low")).filter("ref_size > 0")
    else:
        x = x.withColumn("o", F.explode("all")).filter("o.ident <> ident")
        x = x.select("ident", F.col("o.ident").alias("ref"), "size", F.col("o.size").alias("ref_size"), F.least("least", "o.least").alias("low"))
    if idents is not None:
        x = x.filter(F.col("ident").isin(idents))
    return x.select("ident", "ref", "size", "ref_size", (0.25 * F.col("low") / (F.col("size") + F.col("ref_size"))).alias("zero"))


def contrast_statistics(tally: DataFrame, contrasts: DataFrame, against: str) -> DataFrame:
    """Expression of every gene in both sides of every contrast, where a cell of either side expresses it.

    Of ident and, with ref_, of the other side: n expressing cells, their share alpha,
    log2 mean over them (mu) and over all cells (mean), share of the contrast's sum
    (total); log2fc is mean less ref_mean.  detected, level and pval are the two-part
    test of the class on binary logarithms (``contrasts.two_part``).
    """
    v = F.log2("value")
    by = tally.groupBy("gene", "ident").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("value")).alias("s"), F.sum(F.col("n") * v).alias("l"), F.sum(F.col("n") * v * v).alias("q"))
    none = F.lit(0.0)
    if against == "rest":
        whole = by.groupBy("gene").agg(*[F.sum(c).alias(f"all_{c}") for c in _SUMS])
        # A row for every gene and contrast is the result itself.
        listed = contrasts.agg(F.collect_list(F.struct(*contrasts.columns)).alias("c"))
        x = whole.crossJoin(F.broadcast(listed)).select("gene", *[f"all_{c}" for c in _SUMS], F.inline("c")).join(by, ["gene", "ident"], "left")
        x = x.withColumns({c: F.coalesce(c, none) for c in _SUMS}).withColumns({f"ref_{c}": F.col(f"all_{c}") - F.col(c) for c in _SUMS})
    else:
        left = by.join(contrasts.select("ident", "ref"), "ident")
        right = by.select("gene", F.col("ident").alias("ref"), *[F.col(c).alias(f"ref_{c}") for c in _SUMS]).join(contrasts.select("ident", "ref"), "ref")
        x = left.join(right, ["gene", "ident", "ref"], "full").join(contrasts, ["ident", "ref"])
        x = x.withColumns({c: F.coalesce(c, none) for side in ("", "ref_") for c in [f"{side}{k}" for k in _SUMS]})
    log = lambda s, k: F.log2(F.coalesce(ratio(s, k), none) + F.col("zero"))
    c = F.col
    x = x.withColumns({"alpha": ratio(c("n"), c("size")), "ref_alpha": ratio(c("ref_n"), c("ref_size")), "mu": log(c("s"), c("n")), "ref_mu": log(c("ref_s"), c("ref_n")), "mean": log(c("s"), c("size")), "ref_mean": log(c("ref_s"), c("ref_size")),
                       "total": ratio(c("s"), c("s") + c("ref_s")), "ref_total": ratio(c("ref_s"), c("s") + c("ref_s"))}).withColumn("log2fc", c("mean") - c("ref_mean"))
    # Sums of the rest are differences; what they lose in the last places isn't a variance.
    detected, level = two_part(*[c(k).cast("double") for k in ("n", "ref_n", "size", "ref_size", "l", "ref_l")], c("q") + c("ref_q"))
    x = x.withColumns({"detected": detected, "level": level}).withColumn("pval", F.exp(-(c("detected") + c("level")) / 2))
    return x.withColumns({k: c(k).cast("long") for k in ("n", "ref_n")}).drop("s", "ref_s", "l", "ref_l", "q", "ref_q", "zero", *[f"all_{k}" for k in _SUMS])


def selected(stats: DataFrame, least_cells: int = 3, least_share: float = 0.05, least_fold: float = 1.25, direction: str = "up") -> DataFrame:
    """Genes of contrasts that enough cells and a large enough share of either side express, and whose mean changes enough; compared at nine places."""
    fold = F.round(F.col("log2fc") if direction == "up" else F.abs("log2fc"), 9)
    cells, share = F.greatest("n", "ref_n") >= least_cells, F.round(F.greatest("alpha", "ref_alpha"), 9) >= least_share
    return stats.filter(cells & share & (fold >= round(math.log2(least_fold), 9)))


def _running(tally: DataFrame, idents: list[str], scratch: Scratch) -> DataFrame:
    """(gene, value, at, below): for each distinct value of a gene, cells of each of ``idents`` that have it and that have a smaller positive one.

    The values of all genes are put in one order by ranges, so a gene that all cells
    express is spread over tasks.
    """
    at = tally.groupBy("gene", "value").agg(*[F.sum(F.when(F.col("ident") == i, F.col("n")).otherwise(0)).alias(f"at{k}") for k, i in enumerate(idents)])
    placed = in_order(at, [F.asc("gene"), F.asc("value")], scratch, "values", {str(k): F.col(f"at{k}") for k in range(len(idents))})
    placed = placed.select("gene", "value", F.array(*[f"at{k}" for k in range(len(idents))]).alias("at"), F.array(*[F.col(f"running_{k}") - F.col(f"at{k}") for k in range(len(idents))]).alias("before"))
    # Running counts never fall, so a gene's first row holds what the genes before it had.
    first = placed.groupBy("gene").agg(*[F.min(F.col("before")[k]).alias(f"f{k}") for k in range(len(idents))]).select("gene", F.array(*[f"f{k}" for k in range(len(idents))]).alias("first"))
    return placed.join(first, "gene").select("gene", "value", "at", F.zip_with("before", "first", lambda x, y: x - y).alias("below"))


def _below(counts: DataFrame, keys: list[str], scratch: Scratch, name: str) -> DataFrame:
    """(keys, value, n, below) of (keys, value, n): cells with a smaller positive value of the same keys, from one order by ranges."""
    placed = in_order(counts.select(*keys, "value", "n"), [F.asc(k) for k in [*keys, "value"]], scratch, name, {"n": F.col("n")})
    placed = placed.select(*keys, "value", "n", (F.col("running_n") - F.col("n")).alias("before"))
    first = placed.groupBy(*keys).agg(F.min("before").alias("first"))
    return placed.join(first, keys).select(*keys, "value", "n", (F.col("before") - F.col("first")).alias("below"))


def _against_rest(tally: DataFrame, own: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows of ``own`` by value with n, own_below, ref_below and ref_at: the rest is all cells less the group's, so no row has a column a group."""
    group = _below(tally, ["gene", "ident"], scratch, "group_values").withColumnRenamed("below", "own_below")
    whole = _below(tally.groupBy("gene", "value").agg(F.sum("n").alias("n")), ["gene"], scratch, "values").withColumnsRenamed({"n": "all_at", "below": "all_below"})
    met = own.join(group, ["gene", "ident"]).join(whole, ["gene", "value"])
    return met.withColumns({"ref_below": F.col("all_below") - F.col("own_below"), "ref_at": F.col("all_at") - F.col("n")}).drop("all_below", "all_at")


def _against_each(tally: DataFrame, own: DataFrame, names: list[str], scratch: Scratch) -> DataFrame:
    """Rows of ``own`` by value with n, own_below, ref_below and ref_at, each from the groups' columns."""
    met = tally.join(own, ["gene", "ident"]).join(_running(tally, names, scratch), ["gene", "value"])
    i, j = _place(names, "ident"), F.coalesce(_place(names, "ref"), F.lit(1))
    return met.withColumns({"own_below": F.element_at("below", i), "ref_below": F.element_at("below", j), "ref_at": F.element_at("at", j)}).drop("below", "at")


def _place(idents: list[str], column: str) -> Column:
    return F.array_position(F.array(*[F.lit(i) for i in idents]), F.col(column)).cast("int")


def find_markers(cells: DataFrame, groups: DataFrame, scratch: Scratch, against: str = "rest", idents: list[str] | None = None,
                 least_cells: int = 3, least_share: float = 0.05, least_fold: float = 1.25, direction: str = "up") -> DataFrame:
    """One row for each gene and contrast of groups that ``selected`` keeps, with its statistics, tests and best cutoff.

    ``cells``: (cell, gene, count), one row a cell and gene; values that aren't positive
    are zeros.  ``groups``: (cell, ident); cells without an ident take no part.
    ``against``: "rest" compares each group with all other cells (ref is null), "each"
    with every other group; ``idents`` are the groups to compare, by default all.
    Beside ``contrast_statistics`` with padj over the genes of a contrast: auc (zeros
    are tied), and the positive cutoff of the best F1 of being in the group, of equals
    the highest, with accuracy, sensitivity, specificity and fdr.  The contrast's
    smallest value is no cutoff.  A gene that no cell of the group expresses has F1 0 and
    no cutoff.  Cells can be drawn beforehand with ``curation.selected_cells``.
    """
    if against not in ("rest", "each"):
        raise ValueError(f"against must be rest or each, not {against}")
    tally = scratch.keep(value_counts(cells, groups), "tally")
    names = [r["ident"] for r in groups.filter("ident IS NOT NULL").select("ident").distinct().orderBy("ident").limit(MOST_GROUPS + 1).collect()]
    if len(names) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups")
    contrasts = scratch.keep(group_contrasts(tally, groups, against, idents), "contrasts")
    kept = scratch.keep(selected(contrast_statistics(tally, contrasts, against), least_cells, least_share, least_fold, direction), "kept")
    if not names:
        names = [""]
    own = kept.select("gene", "ident", "ref", F.col("n").alias("own_n"), "ref_n", "size", "ref_size")
    met = _against_rest(tally, own, scratch) if against == "rest" else _against_each(tally, own, names, scratch)
    c = F.col
    met = met.withColumns({"tp": c("own_n") - c("own_below"), "fp": c("ref_n") - c("ref_below"), "wins": c("n") * (c("ref_below") + c("ref_at") / 2 + c("ref_size") - c("ref_n"))})
    smallest = (c("own_below") + c("ref_below") == 0) & (c("own_n") == c("size")) & (c("ref_n") == c("ref_size"))
    f1 = F.when(~smallest, ratio(2 * c("tp"), c("tp") + c("fp") + c("size")))
    best = met.groupBy("gene", "ident", c("ref").alias("ref")).agg(F.sum("wins").alias("wins"), F.max(F.when(f1.isNotNull(), F.struct(f1.alias("f1"), c("value").alias("cutoff"), "tp", "fp"))).alias("best"))
    x = kept.alias("k").join(best.alias("b"), (c("k.gene") == c("b.gene")) & (c("k.ident") == c("b.ident")) & c("k.ref").eqNullSafe(c("b.ref")), "left").select("k.*", "b.wins", "b.best")
    zeros = (c("size") - c("n")) * (c("ref_size") - c("ref_n")) / 2
    x = x.withColumns({"auc": ratio(F.coalesce("wins", F.lit(0.0)) + zeros, c("size") * c("ref_size")), "cutoff": c("best.cutoff"), "f1": F.coalesce("best.f1", F.lit(0.0)), "accuracy": ratio(c("best.tp") + c("ref_size") - c("best.fp"), c("size") + c("ref_size")),
                       "sensitivity": ratio(c("best.tp"), c("size")), "specificity": ratio(c("ref_size") - c("best.fp"), c("ref_size")), "fdr": ratio(c("best.fp"), c("best.tp") + c("best.fp"))})
    return bh_adjusted(scratch.keep(x.drop("wins", "best"), "markers"), "pval", ["ident", "ref"])
