"""Queries of marker genes over all contrasts of groups of cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from strainspark.operators import discovery
from strainspark.plans.common import counts, r6, table
from strainspark.scratch import Scratch

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _term(k: str, n: str) -> str:
    return f"CASE WHEN {k} > 0 THEN {k} * ln({k} / {n}) ELSE 0 END"


def _fit(k: str, n: str) -> str:
    return f"({_term(k, n)} + {_term(f'({n} - {k})', n)})"


_KEPT = ("n", "ref_n", "alpha", "ref_alpha", "mu", "ref_mu", "mean", "ref_mean", "total", "ref_total", "log2fc", "pval", "auc", "cutoff", "f1", "accuracy", "sensitivity", "specificity", "fdr")
#: Parts as cells, their brands as groups, suppliers as genes.
_CELLS = """c AS (SELECT p_partkey AS cell, p_brand AS ident FROM part), v AS (SELECT l_partkey AS cell, l_suppkey AS gene, sum(l_quantity)::DOUBLE AS value FROM lineitem GROUP BY 1, 2),
e AS (SELECT gene, cell, ident, value FROM v JOIN c USING (cell) WHERE value > 0), z AS (SELECT ident, count(*)::DOUBLE AS size FROM c GROUP BY 1), lo AS (SELECT ident, min(value) AS low FROM e GROUP BY 1),
b AS (SELECT gene, ident, count(*)::DOUBLE AS n, sum(value) AS s, sum(log2(value)) AS l, sum(log2(value) ** 2) AS q FROM e GROUP BY 1, 2), """
_SIDES = {
    "rest": """k AS (SELECT ident, NULL::VARCHAR AS ref, size, al - size AS ref_size, (SELECT min(low) FROM lo) AS low FROM z, (SELECT sum(size) AS al FROM z)), w AS (SELECT gene, sum(n) AS n, sum(s) AS s, sum(l) AS l, sum(q) AS q FROM b GROUP BY 1),
d AS (SELECT w.gene, k.ident, k.ref, coalesce(b.n, 0) AS n, coalesce(b.s, 0) AS s, coalesce(b.l, 0) AS l, w.n - coalesce(b.n, 0) AS rn, w.s - coalesce(b.s, 0) AS rs, w.l - coalesce(b.l, 0) AS rl, w.q AS q, size, ref_size, low FROM w CROSS JOIN k LEFT JOIN b ON b.gene = w.gene AND b.ident = k.ident), """,
    "each": """k AS (SELECT x.ident, y.ident AS ref, x.size, y.size AS ref_size, least(lx.low, ly.low) AS low FROM z x JOIN z y ON x.ident <> y.ident LEFT JOIN lo lx ON lx.ident = x.ident LEFT JOIN lo ly ON ly.ident = y.ident), w AS (SELECT DISTINCT gene FROM b),
d AS (SELECT w.gene, k.ident, k.ref, coalesce(b.n, 0) AS n, coalesce(b.s, 0) AS s, coalesce(b.l, 0) AS l, coalesce(r.n, 0) AS rn, coalesce(r.s, 0) AS rs, coalesce(r.l, 0) AS rl, coalesce(b.q, 0) + coalesce(r.q, 0) AS q, size, ref_size, low
FROM w CROSS JOIN k LEFT JOIN b ON b.gene = w.gene AND b.ident = k.ident LEFT JOIN b r ON r.gene = w.gene AND r.ident = k.ref WHERE coalesce(b.n, 0) + coalesce(r.n, 0) > 0), """,
}
_MET = {"rest": "y.ident <> x.ident", "each": "y.ident = x.ref"}


def _markers(against: str, where: str) -> str:
    """Every cell of a group is compared with every other one, where Spark takes running counts."""
    test = f"2 * ({_fit('n', 'size')} + {_fit('rn', 'ref_size')} - {_fit('(n + rn)', '(size + ref_size)')})"
    left = "(q - l * l / n - rl * rl / rn)"
    level = f"CASE WHEN n > 0 AND rn > 0 AND n + rn >= 3 AND {left} > 1e-9 * q THEN greatest((n + rn) * ln((q - (l + rl) ** 2 / (n + rn)) / {left}), 0) END"
    return f"""WITH {_CELLS}{_SIDES[against]}t AS (SELECT *, 0.25 * low / (size + ref_size) AS zero FROM d),
m AS (SELECT *, n / size AS alpha, rn / ref_size AS ref_alpha, log2(CASE WHEN n > 0 THEN s / n ELSE 0 END + zero) AS mu, log2(CASE WHEN rn > 0 THEN rs / rn ELSE 0 END + zero) AS ref_mu, log2(s / size + zero) AS mean, log2(rs / ref_size + zero) AS ref_mean, s / (s + rs) AS total, rs / (s + rs) AS ref_total,
exp(-(greatest({test}, 0) + {level}) / 2) AS pval FROM t), o AS (SELECT * FROM m WHERE greatest(n, rn) >= 3 AND round(greatest(alpha, ref_alpha), 9) >= 0.05 AND {where}),
x AS (SELECT o.gene, o.ident, o.ref, e.value AS v FROM o JOIN e ON e.gene = o.gene AND e.ident = o.ident),
u AS (SELECT x.gene, x.ident, x.ref, sum(CASE WHEN x.v > y.value THEN 1 WHEN x.v = y.value THEN 0.5 ELSE 0 END) AS wins FROM x JOIN e y ON y.gene = x.gene AND {_MET[against]} GROUP BY 1, 2, 3),
g AS (SELECT gene, ident, ref, v, count(*) AS k FROM x GROUP BY 1, 2, 3, 4), h AS (SELECT gene, ident, ref, v, sum(k) OVER (PARTITION BY gene, ident, ref ORDER BY v DESC) AS tp FROM g),
f AS (SELECT x.gene, x.ident, x.ref, x.v, any_value(x.tp)::DOUBLE AS tp, count(y.value)::DOUBLE AS fp FROM h x LEFT JOIN e y ON y.gene = x.gene AND {_MET[against]} AND y.value >= x.v GROUP BY 1, 2, 3, 4),
r AS (SELECT f.*, 2 * tp / (tp + fp + size) AS f1, row_number() OVER (PARTITION BY f.gene, f.ident, f.ref ORDER BY 2 * tp / (tp + fp + size) DESC, v DESC) AS i FROM f JOIN k ON k.ident = f.ident AND k.ref IS NOT DISTINCT FROM f.ref WHERE tp + fp < size + ref_size),
j AS (SELECT o.*, wins, r.v AS cutoff, coalesce(f1, 0) AS f1, tp, fp FROM o LEFT JOIN u ON u.gene = o.gene AND u.ident = o.ident AND u.ref IS NOT DISTINCT FROM o.ref LEFT JOIN r ON r.gene = o.gene AND r.ident = o.ident AND r.ref IS NOT DISTINCT FROM o.ref AND i = 1)
SELECT gene, ident, {'' if against == 'rest' else 'ref, '}n::BIGINT AS n, rn::BIGINT AS ref_n, {', '.join(f'round({c}, 6) AS {c}' for c in _KEPT[2:12])}, round((coalesce(wins, 0) + n * (ref_size - rn) + (size - n) * (ref_size - rn) / 2) / (size * ref_size), 6) AS auc,
cutoff, round(f1, 6) AS f1, round((tp + ref_size - fp) / (size + ref_size), 6) AS accuracy, round(tp / size, 6) AS sensitivity, round((ref_size - fp) / ref_size, 6) AS specificity, round(fp / (tp + fp), 6) AS fdr FROM j"""


def _cells(spark, d):
    cells = counts(spark, d).select(F.col("gene").alias("cell"), F.col("sample").alias("gene"), F.col("value").alias("count"))
    return cells, table(spark, d, "part").select(F.col("p_partkey").alias("cell"), F.col("p_brand").alias("ident"))


def _rounded(found, keys: list[str]):
    return found.select(*keys, "n", "ref_n", *[r6(c, c) for c in _KEPT[2:]])


@query(_markers("rest", "round(mean - ref_mean, 9) >= round(log2(1.25), 9)").replace("round(log2fc, 6)", "round(mean - ref_mean, 6)"))
def markers_against_rest(spark, d):
    """Suppliers that mark a brand's parts against all other parts."""
    return _rounded(discovery.find_markers(*_cells(spark, d), Scratch(spark, "markers")), ["gene", "ident"])


@query(_markers("each", "abs(round(mean - ref_mean, 9)) >= 1").replace("round(log2fc, 6)", "round(mean - ref_mean, 6)"))
def markers_against_each(spark, d):
    """Suppliers that mark a brand's parts, by more or by less, against those of each other brand; a mean twice as large at least."""
    found = discovery.find_markers(*_cells(spark, d), Scratch(spark, "markers"), against="each", least_fold=2.0, direction="both")
    return _rounded(found, ["gene", "ident", "ref"])
