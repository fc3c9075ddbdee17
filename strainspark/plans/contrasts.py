"""Queries of comparisons between classes and batches, exact p-values and clusters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strainspark.operators import contrasts, matrix, ordering, panels, ranking, statistics
from strainspark.plans.common import BRANDS, COUNTS, META, PILE, brands, counts, metadata, pileup, r6, table
from strainspark.plans.inference import SCORED, SQL as INFERENCE, scored, tables
from strainspark.scratch import Scratch

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _classes(spark, d):
    return metadata(spark, d).select("sample", F.col("dx").alias("class"))


def _fit(k: str, n: str) -> str:
    return f"(CASE WHEN {k} > 0 THEN {k} * ln({k} / {n}) ELSE 0 END + CASE WHEN {n} - {k} > 0 THEN ({n} - {k}) * ln(({n} - {k}) / {n}) ELSE 0 END)"


@query(f"""WITH c AS (SELECT sample, dx = 'IBD' AS one FROM ({META})), t AS (SELECT count(*) FILTER (WHERE one)::DOUBLE AS n1, count(*) FILTER (WHERE NOT one)::DOUBLE AS n0 FROM c),
m AS (SELECT gene, log2(value::DOUBLE) AS v, one FROM ({COUNTS}) JOIN c USING (sample) WHERE value > 0),
g AS (SELECT gene, count(*) FILTER (WHERE one)::DOUBLE AS k1, count(*) FILTER (WHERE NOT one)::DOUBLE AS k0, coalesce(sum(v) FILTER (WHERE one), 0) AS s1, coalesce(sum(v) FILTER (WHERE NOT one), 0) AS s0, sum(v * v) AS q FROM m GROUP BY 1),
x AS (SELECT gene, k1, k0, greatest(2 * ({_fit('k1', 'n1')} + {_fit('k0', 'n0')} - {_fit('(k1 + k0)', '(n1 + n0)')}), 0) AS detected,
CASE WHEN k1 > 0 AND k0 > 0 AND k1 + k0 >= 3 AND q - s1 * s1 / k1 - s0 * s0 / k0 > 1e-9 * q THEN greatest((k1 + k0) * ln((q - (s1 + s0) * (s1 + s0) / (k1 + k0)) / (q - s1 * s1 / k1 - s0 * s0 / k0)), 0) END AS level FROM g, t)
SELECT gene, k1::BIGINT AS k1, k0::BIGINT AS k0, round(detected, 6) AS detected, round(level, 6) AS level, round(exp(-(detected + level) / 2), 6) AS pval FROM x""")
def hurdle_tests(spark, d):
    """Detection and level of each part in suppliers of two classes."""
    return contrasts.hurdle_tests(counts(spark, d), _classes(spark, d), "IBD").select("gene", "k1", "k0", r6("detected", "detected"), r6("level", "level"), r6("pval", "pval"))


@query(f"""WITH a AS (SELECT gene, score, sum(y) AS p, count(*) AS n FROM ({SCORED}) GROUP BY 1, 2), x AS (SELECT gene, score, p, (sum(p) OVER w)::DOUBLE / sum(n) OVER w AS pr FROM a WINDOW w AS (PARTITION BY gene ORDER BY score DESC ROWS UNBOUNDED PRECEDING)), y AS (SELECT *, coalesce(lag(pr) OVER (PARTITION BY gene ORDER BY score DESC), 0) AS before FROM x)
SELECT gene, sum(p)::BIGINT AS n1, round(sum(p * pr) / sum(p), 6) AS ap, round(sum(p * (pr + before) / 2) / sum(p), 3) AS area FROM y GROUP BY 1""")
def average_precision(spark, d):
    """Area under the precision-recall curve by steps and by trapezoids."""
    return contrasts.average_precision(scored(spark, d), "score", "y", ["gene"]).select("gene", "n1", r6("ap", "ap"), "area")


@query(f"""WITH r AS (SELECT sample, gene, value::DOUBLE AS value, cohort FROM ({BRANDS}) JOIN ({META}) USING (sample)), s AS (SELECT gene, cohort, count(*) AS n, avg(value) AS mean, var_pop(value) AS v FROM r GROUP BY 1, 2),
g AS (SELECT gene, sum(n * mean) / sum(n) AS centre, sqrt(sum(n * v) / sum(n)) AS spread FROM s GROUP BY 1)
SELECT sample, gene, round((value - mean) * CASE WHEN sqrt(v) > 1e-9 THEN spread / sqrt(v) ELSE 1 END + centre, 6) AS value FROM r JOIN s USING (gene, cohort) JOIN g USING (gene)""")
def batch_adjusted(spark, d):
    """Brands' counts with the cohorts' location and scale taken out."""
    return contrasts.batch_adjusted(brands(spark, d), metadata(spark, d).select("sample", F.col("cohort").alias("batch"))).select("sample", "gene", r6("value", "value"))


BASES = f"SELECT gene, sample, pos, allele AS base FROM (SELECT *, row_number() OVER (PARTITION BY gene, sample, pos ORDER BY n DESC, allele) AS k FROM ({PILE})) WHERE k = 1"


@query(f"""WITH b AS ({BASES}), w AS (SELECT gene, count(DISTINCT pos) AS width FROM b GROUP BY 1), k AS (SELECT gene, sample FROM b JOIN w USING (gene) GROUP BY 1, 2 HAVING count(*) >= 0.6 * any_value(width)), n AS (SELECT gene, count(*) AS n FROM k GROUP BY 1),
c AS (SELECT gene, pos, base, count(*) AS k FROM b SEMI JOIN k USING (gene, sample) GROUP BY 1, 2, 3), t AS (SELECT gene, pos, max(k) AS top, sum(k) AS filled FROM c GROUP BY 1, 2)
SELECT gene, pos, n, top FROM t JOIN n USING (gene) WHERE top >= floor(0.5 * n) + 1 AND n - filled <= 0.4 * n""")
def conserved_columns(spark, d):
    """Conserved line numbers of the brands' majority alleles."""
    w = Window.partitionBy("gene", "sample", "pos").orderBy(F.desc("n"), "allele")
    bases = pileup(spark, d).withColumn("k", F.row_number().over(w)).filter("k = 1").select("gene", "sample", "pos", F.col("allele").alias("base"))
    return contrasts.conserved_columns(bases, 0.5, 0.4, 0.6)


@query("""WITH p AS (SELECT p_partkey, p_retailprice::DOUBLE - 1400 AS x, p_size AS score FROM part), s AS (SELECT *, x >= 0 AS side, min(x) OVER (PARTITION BY x >= 0) AS lo, max(x) OVER (PARTITION BY x >= 0) AS hi FROM p),
b AS (SELECT *, least(coalesce(floor((x - lo) / nullif(hi - lo, 0) * 10), 0), 9) AS bin FROM s), f AS (SELECT *, row_number() OVER (PARTITION BY side, bin ORDER BY score DESC, p_partkey) AS k, row_number() OVER (ORDER BY score DESC, p_partkey) AS best FROM b)
SELECT p_partkey, round(x, 6) AS x, score FROM f WHERE k = 1 OR best <= 5""")
def labelled_points(spark, d):
    points = table(spark, d, "part").select("p_partkey", (F.col("p_retailprice").cast("double") - 1400).alias("x"), F.col("p_size").alias("score"))
    return contrasts.labelled_points(points, "x", "score", "p_partkey", 10, 5).select("p_partkey", r6("x", "x"), "score")


@query()
def hierarchical_merges(spark, d):
    """Trees of each type's brands by their mean sizes and prices; tests compare with distances of whole clusters."""
    part = table(spark, d, "part").groupBy("p_type", "p_brand").agg(F.array(F.avg("p_size"), F.avg("p_retailprice").cast("double")).alias("v"))
    return contrasts.hierarchical_merges(part, "p_type", F.col("p_brand"), "v").select("p_type", "step", "left", "right", r6("height", "height"), "size")


# Exact and tail probabilities as sums


def _adjusted(by: str = "") -> str:
    """p-values of ``p`` adjusted by the false discovery rate."""
    w = f"PARTITION BY {by} " if by else ""
    also = f"PARTITION BY {by}, pval" if by else "PARTITION BY pval"
    return f"""(SELECT * EXCLUDE (k, al), least(1, min(pval * al / k) OVER ({w}ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) AS padj FROM (SELECT *, rank() OVER ({w}ORDER BY pval) + count(*) OVER ({also}) - 1 AS k, count(*) OVER ({w}) AS al FROM p))"""


@query(f"""WITH t AS ({INFERENCE['fisher_counts']}), x AS (SELECT gene, a, b, c, d, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS s FROM t),
l AS (SELECT gene, a, s, -(lgamma(s + 1) + lgamma(a + b - s + 1) + lgamma(a + c - s + 1) + lgamma(d - a + s + 1)) AS w FROM x), e AS (SELECT gene, a, s, exp(w - max(w) OVER (PARTITION BY gene)) AS e FROM l),
h AS (SELECT *, max(e) FILTER (WHERE s = a) OVER (PARTITION BY gene) AS here, sum(e) OVER (PARTITION BY gene) AS al FROM e), p AS (SELECT gene, round(least(1, sum(e) FILTER (WHERE e <= here * (1 + 1e-7)) / any_value(al)), 9) AS pval FROM h GROUP BY 1)
SELECT gene, round(pval, 6) AS pval, round(padj, 6) AS padj FROM {_adjusted()}""")
def fisher_pvalues(spark, d):
    """Exact two-sided p-values of genes' presence by class, and adjusted."""
    scratch = Scratch(spark, "fisher")
    rows = scratch.keep(statistics.with_fisher(tables(spark, d)).select("gene", F.round("pval", 9).alias("pval")), "tests")
    return ordering.adjusted_over_all(rows, "pval", scratch).select("gene", r6("pval", "pval"), r6("padj", "padj"))


@query(f"""WITH u AS ({INFERENCE['wilcoxon_u']}), x AS (SELECT gene, abs(z) / sqrt(2) AS x FROM u), e AS (SELECT gene, 2 / sqrt(pi()) * sum(exp(2 * k * ln(2) + (2 * k + 1) * ln(greatest(x, 1e-200)) - x * x - lgamma(2 * k + 2) + lgamma(k + 1))) AS erf FROM x, range(0, 200) r(k) GROUP BY 1),
p AS (SELECT u.*, round(greatest(0, 1 - erf), 9) AS pval FROM u JOIN e USING (gene)) SELECT gene, n1, n0, u, round(pval, 6) AS pval, round(padj, 6) AS padj FROM {_adjusted()}""")
def wilcoxon_pvalues(spark, d):
    """Rank-sum tests with normal p-values of the score at six places, adjusted over genes."""
    z = statistics.wilcoxon(scored(spark, d), "score", "y", ["gene"]).withColumn("z", F.round("z", 6))
    scratch = Scratch(spark, "wilcoxon")
    rows = scratch.keep(statistics.with_normal_p(z).withColumn("pval", F.round("pval", 9)), "tests")
    return ordering.adjusted_over_all(rows, "pval", scratch).select("gene", "n1", "n0", r6("u", "u"), r6("pval", "pval"), r6("padj", "padj"))


@query(f"""WITH r AS (SELECT g1, g2, n, rho, n - 2 AS v, 1 - rho * rho AS c FROM ({INFERENCE['spearman_pairs']}) WHERE rho IS NOT NULL),
s AS (SELECT g1, g2, sum(CASE WHEN v % 2 = 0 THEN exp(lgamma(j + 0.5) - lgamma(0.5) - lgamma(j + 1)) ELSE exp(lgamma(j + 1) - lgamma(j + 1.5) + lgamma(1.5)) END * CASE WHEN j = 0 THEN 1 ELSE c ** j END) AS s FROM r JOIN range(0, 2000) k(j) ON j < CASE WHEN v % 2 = 0 THEN v // 2 ELSE (v - 1) // 2 END GROUP BY 1, 2),
p AS (SELECT g1, g2, n, rho, round(greatest(0, 1 - CASE WHEN v % 2 = 0 THEN abs(rho) * s ELSE 2 / pi() * (asin(abs(rho)) + abs(rho) * sqrt(c) * coalesce(s, 0)) END), 9) AS pval FROM r LEFT JOIN s USING (g1, g2))
SELECT g1, g2, n, rho, round(pval, 6) AS pval, round(padj, 6) AS padj FROM {_adjusted('g1')}""")
def correlation_pvalues(spark, d):
    """Rank correlations at six places with the p-values of their F tests, adjusted by first gene; the SQL sums the t distribution's finite series."""
    rho = panels.rank_correlations(brands(spark, d)).filter("rho IS NOT NULL").withColumn("rho", F.round("rho", 6))
    rows = statistics.with_correlation_p(rho).withColumn("pval", F.round("pval", 9))
    return ranking.bh_adjusted(rows, "pval", ["g1"]).select("g1", "g2", "n", "rho", r6("pval", "pval"), r6("padj", "padj"))


@query(f"""WITH r AS (SELECT gene, n, rho, n - 2 AS v, 1 - rho * rho AS c FROM ({INFERENCE['masked_spearman']}) WHERE rho IS NOT NULL),
s AS (SELECT gene, sum(CASE WHEN v % 2 = 0 THEN exp(lgamma(j + 0.5) - lgamma(0.5) - lgamma(j + 1)) ELSE exp(lgamma(j + 1) - lgamma(j + 1.5) + lgamma(1.5)) END * CASE WHEN j = 0 THEN 1 ELSE c ** j END) AS s FROM r JOIN range(0, 2000) k(j) ON j < CASE WHEN v % 2 = 0 THEN v // 2 ELSE (v - 1) // 2 END GROUP BY 1),
p AS (SELECT gene, n, rho, greatest(0, 1 - CASE WHEN v % 2 = 0 THEN abs(rho) * s ELSE 2 / pi() * (asin(abs(rho)) + abs(rho) * sqrt(c) * coalesce(s, 0)) END) AS pval FROM r LEFT JOIN s USING (gene)),
e AS (SELECT * FROM p WHERE n >= 100), t AS (SELECT avg(rho) - 1.5 * stddev_samp(rho) AS cut FROM e WHERE gene < 'Brand#2')
SELECT gene, round(rho, 6) AS rho FROM e, t WHERE rho > cut AND pval < 0.005""")
def predicted_genes(spark, d):
    """Brands whose masked rank correlation with one brand is about as high as the core brands', and significant."""
    dense = matrix.densified(brands(spark, d))
    target = dense.filter("gene = 'Brand#11'").select("sample", F.col("value").alias("target"))
    rho = statistics.masked_spearman(dense, target).filter("rho IS NOT NULL").withColumn("rho", F.round("rho", 6))
    found = statistics.with_correlation_p(rho)
    return panels.predicted_genes(found, found.filter("gene < 'Brand#2'").select("gene")).select("gene", r6("rho", "rho"))
