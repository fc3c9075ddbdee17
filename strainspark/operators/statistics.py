"""Correlations, rank tests, ROC measures, linear models and permutation tests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strainspark.functions.numeric import ratio
from strainspark.functions.special import correlation_p, fisher_exact, normal_two_sided, t_two_sided
from strainspark.operators.ranking import average_rank
from strainspark.scratch import Scratch

#: Names of a member's sets that are moved in one list.
LISTED = 1000
#: Names that sets have met, counted at a time in a worker; of one set all are.
COUNTED_AT_ONCE = 1 << 20


def correlation(x: str, y: str) -> Column:
    """Pearson correlation from moments, null where a side has no variance."""
    n, sx, sy = F.count("*").cast("double"), F.sum(x), F.sum(y)
    cov = F.sum(F.col(x) * F.col(y)) - sx * sy / n
    vx, vy = F.sum(F.col(x) * F.col(x)) - sx * sx / n, F.sum(F.col(y) * F.col(y)) - sy * sy / n
    return F.when((vx > 1e-12) & (vy > 1e-12), cov / F.sqrt(vx * vy))


def spearman(pairs: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """(by, n, rho): correlation of the average ranks within each group."""
    ranked = pairs.withColumn("__x", average_rank(x, *by)).withColumn("__y", average_rank(y, *by))
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), correlation("__x", "__y").alias("rho"))


def gene_pairs(matrix: DataFrame) -> DataFrame:
    """(g1, g2, x, y): values of each pair of genes, g1 < g2, in each sample that has both; an equi-join on the sample."""
    a, b = matrix.select("sample", F.col("gene").alias("g1"), F.col("value").alias("x")), matrix.select("sample", F.col("gene").alias("g2"), F.col("value").alias("y"))
    return a.join(b, "sample").filter("g1 < g2")


def masked_spearman(matrix: DataFrame, target: DataFrame) -> DataFrame:
    """(gene, n, rho) of each gene against ``target`` (sample, target), leaving out samples where both are 0."""
    rows = matrix.join(target, "sample").filter("value > 0 OR target > 0")
    return spearman(rows, "value", "target", ["gene"])


def with_correlation_p(rows: DataFrame, rho: str = "rho", n: str = "n") -> DataFrame:
    """Adds ``pval`` of the correlation by its F test."""

    @F.pandas_udf("double")
    def p(r: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([correlation_p(a, int(b)) if a == a and a is not None else np.nan for a, b in zip(r, k, strict=True)])

    return rows.withColumn("pval", p(rho, n))


def auc(rows: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """(by, n1, n0, auc) from rank sums; null where a class is absent."""
    ranked = rows.withColumn("__r", average_rank(score, *by))
    sums = ranked.groupBy(*by).agg(F.sum(F.when(F.col(label) == 1, F.col("__r"))).alias("r1"), F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("n1"), F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).alias("n0"))
    return sums.select(*by, "n1", "n0", ratio(F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2, F.col("n1") * F.col("n0")).alias("auc"))


def wilcoxon(rows: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """(by, n1, n0, u, z): rank-sum statistic of class 1 and its tie-corrected normal score."""
    w = Window.partitionBy(*by, score)
    ranked = rows.withColumn("__r", average_rank(score, *by)).withColumn("__t", F.count("*").over(w))
    n = F.count("*")
    sums = ranked.groupBy(*by).agg(F.sum(F.when(F.col(label) == 1, F.col("__r"))).alias("r1"), F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("n1"), F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).alias("n0"), n.alias("n"), F.sum(F.col("__t") * F.col("__t") - 1).alias("ties"))
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    var = F.col("n1") * F.col("n0") / 12.0 * (F.col("n") + 1 - ratio(F.col("ties"), F.col("n") * (F.col("n") - 1)))
    return sums.select(*by, "n1", "n0", u.alias("u"), F.when(var > 0, (u - F.col("n1") * F.col("n0") / 2) / F.sqrt(var)).alias("z"))


def with_normal_p(rows: DataFrame, z: str = "z") -> DataFrame:
    @F.pandas_udf("double")
    def p(x: pd.Series) -> pd.Series:
        return x.map(normal_two_sided)

    return rows.withColumn("pval", p(z))


def best_cutoff(rows: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """The cutoff of the best F1 for each group, of equals the highest, with its accuracy, sensitivity, specificity and fdr.

    Counts above each cutoff are running sums over distinct scores from the highest down.
    """
    at = rows.groupBy(*by, F.col(score).alias("cutoff")).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("q"))
    down = Window.partitionBy(*by).orderBy(F.desc("cutoff")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    x = at.withColumns({"tp": F.sum("p").over(down), "fp": F.sum("q").over(down), "np": F.sum("p").over(whole), "nq": F.sum("q").over(whole)})
    x = x.withColumn("f1", ratio(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("np")))
    best = x.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("f1"), F.desc("cutoff")))).filter("__k = 1")
    return best.select(*by, "cutoff", "f1", ratio(F.col("tp") + F.col("nq") - F.col("fp"), F.col("np") + F.col("nq")).alias("accuracy"), ratio(F.col("tp"), F.col("np")).alias("sensitivity"), ratio(F.col("nq") - F.col("fp"), F.col("nq")).alias("specificity"), ratio(F.col("fp"), F.col("tp") + F.col("fp")).alias("fdr"))


def contingency(presence: DataFrame, classes: DataFrame, case: str) -> DataFrame:
    """(gene, a, b, c, d): genomes of the case class with and without each gene, then of the others."""
    totals = classes.agg(F.sum(F.when(F.col("class") == case, 1).otherwise(0)).alias("cases"), F.count("*").alias("all"))
    found = presence.join(classes, "genome").groupBy("gene").agg(F.sum(F.when(F.col("class") == case, 1).otherwise(0)).alias("a"), F.sum(F.when(F.col("class") == case, 0).otherwise(1)).alias("c"))
    return found.crossJoin(F.broadcast(totals)).select("gene", "a", (F.col("cases") - F.col("a")).alias("b"), "c", (F.col("all") - F.col("cases") - F.col("c")).alias("d"))


def with_fisher(rows: DataFrame) -> DataFrame:
    """Adds the conditional maximum-likelihood odds ratio and the two-sided p of (a, b, c, d)."""

    @F.pandas_udf("odds double, pval double")
    def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([fisher_exact(*map(int, x)) for x in zip(a, b, c, d, strict=True)], columns=["odds", "pval"])

    return rows.withColumn("__f", run("a", "b", "c", "d")).select("*", "__f.odds", "__f.pval").drop("__f")


def linear_model(rows: DataFrame, y: str, x: str, z: str, by: list[str]) -> DataFrame:
    """(by, n, bx, bz): least squares of y on an intercept and two covariates, from grouped moments; null if they are collinear."""
    n = F.count("*").cast("double")
    cov = lambda a, b: F.sum(F.col(a) * F.col(b)) - F.sum(a) * F.sum(b) / n
    m = rows.groupBy(*by).agg(F.count("*").alias("n"), cov(x, x).alias("xx"), cov(z, z).alias("zz"), cov(x, z).alias("xz"), cov(x, y).alias("xy"), cov(z, y).alias("zy"), cov(y, y).alias("yy"))
    det = F.col("xx") * F.col("zz") - F.col("xz") * F.col("xz")
    safe = F.when(F.abs(det) > 1e-9 * (F.abs(F.col("xx") * F.col("zz")) + 1e-12), det)
    bx, bz = (F.col("zz") * F.col("xy") - F.col("xz") * F.col("zy")) / safe, (F.col("xx") * F.col("zy") - F.col("xz") * F.col("xy")) / safe
    rss = F.col("yy") - bx * F.col("xy") - bz * F.col("zy")
    se = F.sqrt(F.greatest(rss, F.lit(0.0)) / F.nullif(F.col("n") - 3, F.lit(0)) * F.col("zz") / safe)
    return m.select(*by, "n", bx.alias("bx"), bz.alias("bz"), ratio(bx, se).alias("tx"))


def with_t_p(rows: DataFrame, t: str, n: str, lost: int = 3) -> DataFrame:
    @F.pandas_udf("double")
    def p(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([t_two_sided(x, k - lost) if x == x and x is not None else np.nan for x, k in zip(a, b, strict=True)])

    return rows.withColumn("pval", p(t, n))


def permutation_p(rows: DataFrame, value: str, label: str, by: list[str], key: str, n: int = 100) -> DataFrame:
    """(by, observed, pval): difference of class means against ``n`` label shuffles.

    Shuffle k deals the observed number of 1 labels to the rows in order of a hash
    of (k, key), so it is the same everywhere; p counts shuffles as large or larger.
    """
    # By the hash's first two characters the rows fall into bins in order; all move as sums of a
    # bin, but those of the bin in which the last 1 label is dealt.
    bin_of = lambda h: F.substring(h, 1, 2)
    hashed = F.md5(F.concat_ws(":", F.col("k").cast("string"), F.col(key).cast("string")))
    of_value = lambda: [F.count("*").alias("__rows"), F.count(value).alias("__n"), F.sum(value).alias("__s")]
    # Few rows of much work each: dealt out whatever their bytes, rows of few groups a task, so that the sums of a bin are mostly made there.
    near = rows.select(*by, key, value).repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, *by, F.pmod(F.xxhash64(key), F.lit(16)))
    each = near.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("__h", hashed)
    bins = each.groupBy(*by, "k", bin_of(F.col("__h")).alias("__bin")).agg(*of_value())
    whole, order = Window.partitionBy(*by, "k"), Window.partitionBy(*by, "k").orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0)
    ones = rows.groupBy(*by).agg(F.sum(label).alias("__n1"))
    placed = bins.join(ones, by).withColumns({"__to": F.sum("__rows").over(order), "__all_n": F.sum("__n").over(whole), "__all_s": F.sum("__s").over(whole)})
    placed = placed.withColumn("__from", F.col("__to") - F.col("__rows"))
    full = placed.groupBy(*by, "k").agg(F.max("__all_n").alias("__all_n"), F.max("__all_s").alias("__all_s"), F.sum(F.when(F.col("__to") <= F.col("__n1"), F.col("__n"))).alias("n"), F.sum(F.when(F.col("__to") <= F.col("__n1"), F.col("__s"))).alias("s"))
    split = placed.filter("__from < __n1 AND __to > __n1").select(*by, "k", "__bin", (F.col("__n1") - F.col("__from")).alias("__left"))
    cut = each.withColumn("__bin", bin_of(F.col("__h"))).join(F.broadcast(split), [*by, "k", "__bin"])  # a row a group and shuffle
    dealt = F.row_number().over(Window.partitionBy(*by, "k").orderBy("__h", key)) <= F.col("__left")
    rest = cut.withColumn("__one", dealt).filter("__one").groupBy(*by, "k").agg(F.count(value).alias("n"), F.sum(value).alias("s"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    both = full.withColumnsRenamed({"n": "__n_full", "s": "__s_full"}).join(rest, [*by, "k"], "left")
    n1, s1 = zero("__n_full") + zero("n"), zero("__s_full") + zero("s")
    null = both.select(*by, "k", (ratio(s1, n1) - ratio(F.col("__all_s") - s1, F.col("__all_n") - n1)).alias("d"))
    diff = lambda c: ratio(F.sum(F.when(F.col(c) == 1, F.col(value))), F.sum(F.when(F.col(c) == 1, 1))) - ratio(F.sum(F.when(F.col(c) == 0, F.col(value))), F.sum(F.when(F.col(c) == 0, 1)))
    seen = rows.groupBy(*by).agg(diff(label).alias("observed"))
    return seen.join(null, by).groupBy(*by, "observed").agg(F.avg(F.when(F.col("d") >= F.col("observed") - 1e-9, 1.0).otherwise(0.0)).alias("pval"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(s1, s2, both) of rows (s1, names) that come with equal s1 together, about COUNTED_AT_ONCE names at a time."""

    def counted(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        first, lists = (rows[c].chunk(0) for c in ("s1", "names"))
        names = lists.flatten().dictionary_encode()
        # Rows of one s1 are neighbours, so its number and the name's are a key.
        own = first.dictionary_encode()
        keys = np.repeat(own.indices.to_numpy().astype(np.int64), lists.value_lengths().to_numpy()) * len(names.dictionary) + names.indices.to_numpy()
        pairs, both = np.unique(keys, return_counts=True)
        one, two = np.divmod(pairs, max(len(names.dictionary), 1))
        return pa.record_batch({"s1": own.dictionary.take(pa.array(one)), "s2": names.dictionary.take(pa.array(two)), "both": pa.array(both.astype(np.int64))})

    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += len(batch["names"].flatten())
        if n >= COUNTED_AT_ONCE:
            # The last s1 may go on in the next batch.
            last = batch["s1"][batch.num_rows - 1]
            ended = [int(pc.index(x["s1"], last).as_py()) for x in held]
            now = [x.slice(0, k) if k >= 0 else x for x, k in zip(held, ended, strict=True)]
            held = [x.slice(k) for x, k in zip(held, ended, strict=True) if k >= 0]
            n = sum(len(x["names"].flatten()) for x in held)
            if any(x.num_rows for x in now):
                yield counted(now)
    if held:
        yield counted(held)


def set_overlaps(sets: DataFrame) -> DataFrame:
    """(s1, s2, both, n1, n2, jaccard) of pairs of sets (name, member) that share a member.

    A member's names are lists of ``LISTED`` at most.  Each name meets the rest of its
    own list, and those of the later ones where a member has several, and what a set
    has met is counted in one place; pairs don't move one by one.
    """
    scratch = Scratch(sets.sparkSession, "overlaps")
    kind = sets.schema["name"].dataType
    sets = scratch.keep(sets.distinct(), "sets")
    # Few rows beside the pairs; as a table their size is known before these are joined.
    sizes = scratch.keep(sets.groupBy("name").agg(F.count("*").alias("n")), "sizes")
    whole = sets.filter("name IS NOT NULL AND member IS NOT NULL")
    several = not whole.groupBy("member").count().filter(F.col("count") > LISTED).isEmpty()
    block = F.floor((F.row_number().over(Window.partitionBy("member").orderBy("name")) - 1) / LISTED) if several else F.lit(0)
    lists = whole.withColumn("block", block).groupBy("member", "block").agg(F.sort_array(F.collect_list("name")).alias("names"))
    met = lists.select(F.posexplode("names").alias("k", "s1"), "names").filter(F.col("k") + 1 < F.size("names")).select("s1", F.slice("names", F.col("k") + 2, LISTED).alias("names"))
    if several:
        own = lists.select("member", F.explode("names").alias("s1"), F.col("block").alias("own"))
        met = met.union(own.join(lists, "member").filter("own < block").select("s1", "names"))
    dealt = met.repartition("s1").sortWithinPartitions("s1")
    both = dealt.mapInArrow(_counted, T.StructType([T.StructField("s1", kind), T.StructField("s2", kind), T.StructField("both", T.LongType())]))
    out = both.join(sizes.select(F.col("name").alias("s1"), F.col("n").alias("n1")), "s1").join(sizes.select(F.col("name").alias("s2"), F.col("n").alias("n2")), "s2")
    return out.withColumn("jaccard", ratio(F.col("both"), F.col("n1") + F.col("n2") - F.col("both")))
