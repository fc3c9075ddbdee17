"""Queries of enrichment over many experiments and of pairs of genes."""

from __future__ import annotations

from pyspark.sql import functions as F

from strainspark.operators import experiments, statistics
from strainspark.operators.ranking import bh_adjusted
from strainspark.plans.common import r6, table
from strainspark.scratch import Scratch

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Nations as experiments, parts as genes, brands as terms.
_SCORES = """v AS (SELECT s_nationkey AS experiment, l_partkey AS gene, sum(l_quantity)::DOUBLE AS stat FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
k AS (SELECT experiment, gene, rank() OVER (PARTITION BY experiment ORDER BY stat) + (count(*) OVER (PARTITION BY experiment, stat) - 1) / 2 AS r FROM v),
ti AS (SELECT experiment, sum(t)::DOUBLE AS al, sum(t * t * t - t)::DOUBLE AS ties FROM (SELECT experiment, stat, count(*) AS t FROM v GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT experiment, p_brand AS term, count(*)::DOUBLE AS n, sum(r) AS r FROM k JOIN part ON p_partkey = gene GROUP BY 1, 2),
z AS (SELECT experiment, term, n::BIGINT AS n, round((r - n * (al + 1) / 2) / sqrt(n * (al - n) / 12 * (al + 1 - ties / (al * (al - 1)))), 6) AS nes FROM s JOIN ti USING (experiment) WHERE n < al AND al + 1 > ties / (al * (al - 1)))"""
_TESTED = f"""{_SCORES}, e AS (SELECT experiment, term, 2 / sqrt(pi()) * sum(exp(2 * j * ln(2) + (2 * j + 1) * ln(greatest(abs(nes) / sqrt(2), 1e-200)) - nes * nes / 2 - lgamma(2 * j + 2) + lgamma(j + 1))) AS erf FROM z, range(0, 200) q(j) GROUP BY 1, 2),
res AS (SELECT z.*, round(greatest(0, 1 - erf), 9) AS pval FROM z JOIN e USING (experiment, term))"""
_MATRIX = f"""{_TESTED}, ch AS (SELECT term FROM res WHERE pval <= 0.2 AND nes > 0 QUALIFY row_number() OVER (PARTITION BY experiment ORDER BY nes DESC, term) <= 3),
mx AS (SELECT t.term, x.experiment, coalesce(r.nes, 0) AS nes, coalesce(r.pval, 1) AS pval FROM (SELECT DISTINCT term FROM ch) t CROSS JOIN (SELECT DISTINCT experiment FROM res) x LEFT JOIN res r ON r.term = t.term AND r.experiment = x.experiment AND r.pval <= 0.5)"""
_CUT = 0.3


def _results(spark, d):
    lines = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    ranked = lines.groupBy(F.col("s_nationkey").alias("experiment"), F.col("l_partkey").alias("gene")).agg(F.sum("l_quantity").cast("double").alias("stat"))
    sets = table(spark, d, "part").select(F.col("p_brand").alias("term"), F.col("p_partkey").alias("gene"))
    scores = experiments.rank_sum_enrichment(ranked, sets).filter("nes IS NOT NULL").withColumn("nes", F.round("nes", 6))
    tested = statistics.with_normal_p(scores, "nes").withColumn("pval", F.round("pval", 9))
    return bh_adjusted(Scratch(spark, "tested").keep(tested, "tested"), "pval", ["experiment"])


def _matrix(spark, d):
    return experiments.enrichment_matrix(_results(spark, d), n=3, most_p=0.2, shown_p=0.5)


@query(f"WITH {_SCORES} SELECT * FROM z")
def rank_sum_enrichment(spark, d):
    """Rank sums of each brand's parts among the parts that each nation ships."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    ranked = lines.groupBy(F.col("s_nationkey").alias("experiment"), F.col("l_partkey").alias("gene")).agg(F.sum("l_quantity").cast("double").alias("stat"))
    sets = table(spark, d, "part").select(F.col("p_brand").alias("term"), F.col("p_partkey").alias("gene"))
    return experiments.rank_sum_enrichment(ranked, sets).filter("nes IS NOT NULL").select("experiment", "term", "n", r6("nes", "nes"))


@query(f"WITH {_MATRIX} SELECT term, experiment, nes, round(pval, 6) AS pval FROM mx")
def enrichment_matrix(spark, d):
    """Scores and p in all nations of the brands that are among the first three of one."""
    return _matrix(spark, d).select("term", "experiment", "nes", r6("pval", "pval"))


@query(f"""WITH RECURSIVE {_MATRIX}, li AS (SELECT x.term AS a, y.term AS b, round(corr(x.nes, y.nes), 9) AS r FROM mx x JOIN mx y USING (experiment) GROUP BY 1, 2), hi AS (SELECT term, round(quantile_cont(nes, 0.8), 9) AS high FROM mx GROUP BY 1),
nr AS (SELECT a, b, high FROM li JOIN hi ON hi.term = b WHERE r > {_CUT}), dr AS (SELECT a, list(b) AS gone FROM (SELECT *, max(high) OVER (PARTITION BY a) AS top FROM nr) WHERE high < top GROUP BY 1),
od AS (SELECT term, row_number() OVER (ORDER BY term) AS i FROM hi), st(i, gone) AS (SELECT 0::BIGINT, []::VARCHAR[] UNION ALL SELECT od.i, CASE WHEN list_contains(st.gone, od.term) THEN st.gone ELSE list_concat(st.gone, coalesce(dr.gone, [])) END FROM st JOIN od ON od.i = st.i + 1 LEFT JOIN dr ON dr.a = od.term),
la AS (SELECT gone FROM st ORDER BY i DESC LIMIT 1) SELECT term, experiment, nes, round(pval, 6) AS pval FROM mx, la WHERE NOT list_contains(gone, term)""")
def nonredundant_enrichment(spark, d):
    """The same without brands that a brand of larger scores is like."""
    scratch = Scratch(spark, "terms")
    return experiments.without_redundant(scratch.keep(_matrix(spark, d), "matrix"), scratch, _CUT).select("term", "experiment", "nes", r6("pval", "pval"))


@query("""WITH p AS (SELECT DISTINCT x.l_partkey AS a, y.l_partkey AS b FROM lineitem x JOIN lineitem y USING (l_orderkey) WHERE x.l_linenumber = 1 AND y.l_linenumber = 2), s AS (SELECT DISTINCT l_suppkey AS term, l_partkey AS gene FROM lineitem),
m AS (SELECT x.term, a, b FROM p JOIN s x ON x.gene = a JOIN s y ON y.gene = b AND y.term = x.term), f AS (SELECT term, list(DISTINCT a::VARCHAR) AS f, list(DISTINCT b::VARCHAR) AS s, 2 * least(count(DISTINCT a), count(DISTINCT b)) AS n FROM m GROUP BY 1),
t AS (SELECT term, f, s, n AS a, (SELECT count(*) FROM s x WHERE x.term = f.term) - n AS b, (SELECT count(DISTINCT g) FROM (SELECT a AS g FROM p UNION ALL SELECT b FROM p)) - n AS c, (SELECT count(*) FROM part) AS al FROM f),
o AS (SELECT *, al - a - b - c AS d, least(b, c, al - a - b - c) >= 0 AS ok FROM t), x AS (SELECT term, a, b, c, d, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS i FROM o WHERE ok),
l AS (SELECT term, a, i, -(lgamma(i + 1) + lgamma(a + b - i + 1) + lgamma(a + c - i + 1) + lgamma(d - a + i + 1)) AS w FROM x), e AS (SELECT term, a, i, exp(w - max(w) OVER (PARTITION BY term)) AS e FROM l),
h AS (SELECT *, max(e) FILTER (WHERE i = a) OVER (PARTITION BY term) AS here, sum(e) OVER (PARTITION BY term) AS tot FROM e), q AS (SELECT term, least(1, sum(e) FILTER (WHERE e <= here * (1 + 1e-7)) / any_value(tot)) AS pval FROM h GROUP BY 1)
SELECT term, a::BIGINT AS n, array_to_string(list_sort(f), ',') AS firsts, array_to_string(list_sort(s), ',') AS seconds, round(pval, 6) AS pval FROM o LEFT JOIN q USING (term)""")
def pair_enrichment(spark, d):
    """Suppliers whose parts are first and second parts of orders; all parts are the universe."""
    lines = table(spark, d, "lineitem")
    at = lambda k, name: lines.filter(F.col("l_linenumber") == k).select("l_orderkey", F.col("l_partkey").alias(name))
    sets = lines.select(F.col("l_suppkey").alias("term"), F.col("l_partkey").alias("gene"))
    found = experiments.pair_enrichment(at(1, "a").join(at(2, "b"), "l_orderkey"), sets, table(spark, d, "part").select(F.col("p_partkey").alias("gene")))
    return found.select("term", "n", "firsts", "seconds", r6("pval", "pval"))
