"""Faults of round 3: work that grew faster than its table."""

import numpy as np

from strainspark.operators import curation, discovery, matrix, ranking, search
from strainspark.scratch import Scratch


def test_samples_are_fitted_together_as_one_by_one():
    rng = np.random.default_rng(5)
    bits = np.zeros((400, 8), np.int64)
    n = np.zeros((400, 8))
    for row in range(400):
        k = rng.integers(1, 9)
        bits[row, :k] = rng.choice(8, k, replace=False)
        n[row, :k] = rng.integers(1, 40, k)
    start = rng.random((400, 3)) + 0.01
    together = search._fitted(bits, n, start, 300)
    p = (1 - search.ERROR) * ((bits[:, :, None] >> np.arange(3)) & 1) + search.ERROR / 4
    for row in range(400):
        own, z = n[row] > 0, start[row] / start[row].sum()
        for _ in range(300):
            part = p[row, own] * z
            more = (n[row, own, None] * part / part.sum(axis=1, keepdims=True)).sum(axis=0)
            done, z = np.abs(more / more.sum() - z).max() < 1e-9, more / more.sum()
            if done:
                break
        assert np.allclose(together[row], z, atol=1e-8)
    assert np.allclose(together.sum(axis=1), 1)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_adjusted_p_values_come_from_one_sort(spark):
    rows = [(g, k, p) for g in "ab" for k, p in enumerate([0.01, 0.04, 0.04, None, 0.5, 0.03, float("nan")])]
    found = ranking.bh_adjusted(spark.createDataFrame(rows, "g string, k int, p double").repartition(3), "p", ["g"])
    assert sum("Sort [" in line for line in _plan(found).split("\n")) == 1 and "Union" not in _plan(found)
    got = {(r.g, r.k): r.padj for r in found.collect()}
    wanted = [0.06, 0.06, 0.06, None, 0.6, 0.06, 1.0]
    for g in "ab":
        assert all(got[g, k] is None if w is None else abs(got[g, k] - w) < 1e-9 for k, w in enumerate(wanted))


def test_filters_of_unique_rows_need_no_distinct_ones(spark):
    rows = spark.createDataFrame([(f"c{c}", f"g{g}", 1.0) for c in range(6) for g in range(c + 1)], "cell string, gene string, count double")
    cells = lambda **more: curation.filtered_cells(rows, 3, 2, 3, **more)
    turned = rows.select(rows["cell"].alias("sample"), "gene", rows["count"].alias("value"))
    for kept in (matrix.keep_both, matrix.keep_in_turn):
        either, once = kept(turned, 3, 3), kept(turned, 3, 3, repeated=False)
        assert sorted(either.collect()) == sorted(once.collect()) and once.count()
        assert _plan(once).count("HashAggregate") < _plan(either).count("HashAggregate")
    assert sorted(cells().collect()) == sorted(cells(repeated=False).collect()) and cells().count()
    assert _plan(cells(repeated=False)).count("HashAggregate") < _plan(cells()).count("HashAggregate")


def test_markers_against_the_rest_have_no_column_a_group(spark, monkeypatch):
    rng = np.random.default_rng(3)
    idents = [f"g{k:02}" for k in range(30)]
    of = [idents[k % 30] for k in range(300)]
    value = rng.integers(0, 5, 300) + np.where(np.array(of) == "g03", 4, 0)
    cells = spark.createDataFrame([(k, "m", float(v)) for k, v in enumerate(value)], "cell int, gene string, count double")
    kept, keep = {}, Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, name: kept.update({name: len(df.columns)}) or keep(self, df, name))
    found = discovery.find_markers(cells, spark.createDataFrame(list(enumerate(of)), "cell int, ident string"), Scratch(spark, "markers"))
    got = {r.ident: r.auc for r in found.collect()}
    assert kept["values"] < 10 and kept["group_values"] < 10 and "g03" in got
    for ident, auc in got.items():
        x, y = value[np.array(of) == ident][:, None], value[np.array(of) != ident][None]
        assert abs(auc - ((x > y).mean() + (x == y).mean() / 2)) < 1e-9
