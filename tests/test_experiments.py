"""Enrichment over experiments against the sequential rule and counting by hand."""

import numpy as np
import pytest

from strainspark.operators import experiments
from strainspark.scratch import Scratch


def _rows(spark, x, names=None):
    return spark.createDataFrame([(names[t] if names else f"t{t:02}", f"e{e}", float(v)) for t, row in enumerate(x) for e, v in enumerate(row)], "term string, experiment string, nes double")


def _gone(x, cut):
    """The terms that go, one after the other."""
    with np.errstate(all="ignore"):
        r = np.round(np.corrcoef(x), 9)
    high, gone = np.round(np.quantile(x, 0.8, axis=1), 9), set()
    for i in range(len(x)):
        like = [j for j in range(len(x)) if r[i, j] > cut]
        if i not in gone and len(like) > 1:
            gone |= {j for j in like if high[j] != max(high[k] for k in like)}
    return {f"t{j:02}" for j in gone}


@pytest.mark.parametrize("seed", range(4))
def test_redundant_terms_go_as_one_after_the_other(spark, seed):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(14, 6)) + rng.normal(size=(3, 6))[rng.integers(0, 3, 14)] * 1.5, 3)
    x[4] = 0  # no variance: like none
    x[7] = x[6]  # equal rows: both stay or both go
    scratch = Scratch(spark, "tests")
    assert {r.term for r in experiments.redundant_terms(_rows(spark, x), scratch, 0.4).collect()} == _gone(x, 0.4) != set()
    assert experiments.without_redundant(_rows(spark, x), scratch, 0.4).count() == (14 - len(_gone(x, 0.4))) * 6


def test_a_chain_of_drops_is_settled_in_turn(spark):
    # Each row is like its neighbours only, and smaller than the next.
    x = np.zeros((6, 9))
    for t in range(6):
        x[t, t], x[t, t + 1], x[t, 7] = 1 + t, 1 + t, 0
    r = np.corrcoef(x)
    cut = float(min(r[t, t + 1] for t in range(5))) - 0.01
    assert all(r[t, t + 2] < cut for t in range(4))
    assert {q.term for q in experiments.redundant_terms(_rows(spark, x), Scratch(spark, "tests"), cut).collect()} == _gone(x, cut)


def test_matrix_chooses_positive_terms_within_bounds_and_fills_the_rest(spark):
    rows = [("e1", "a", 3.0, 0.01, 0.02), ("e1", "b", 2.0, 0.01, 0.30), ("e1", "c", -4.0, 0.0, 0.0), ("e1", "d", 1.0, 0.04, 0.04), ("e1", "f", 1.0, 0.04, 0.04),
            ("e2", "a", -1.0, 0.5, 0.5), ("e2", "d", 2.5, 0.6, 0.6), ("e3", "g", None, 0.0, 0.0), ("e4", "c", -1.0, 0.01, 0.01)]
    results = spark.createDataFrame(rows, "experiment string, term string, nes double, pval double, padj double")
    got = {(r.term, r.experiment): (r.nes, r.pval) for r in experiments.enrichment_matrix(results, n=2, most_padj=0.05, shown_p=0.5).collect()}
    assert got == {("a", "e1"): (3.0, 0.01), ("d", "e1"): (1.0, 0.04), ("a", "e2"): (-1.0, 0.5), ("d", "e2"): (0.0, 1.0), ("a", "e4"): (0.0, 1.0), ("d", "e4"): (0.0, 1.0)}
    first = {(r.term, r.experiment): r.nes for r in experiments.enrichment_matrix(results, n=2, most_padj=0.05, shown=1).collect()}
    assert first["a", "e1"] == 3.0 and first["d", "e1"] == 0.0 and first["d", "e2"] == 2.5 and first["a", "e2"] == 0.0
    assert experiments.enrichment_matrix(results.limit(0)).count() == 0
    assert experiments.redundant_terms(_rows(spark, np.zeros((2, 2))).limit(0), Scratch(spark, "tests"), 0.5).count() == 0


def test_rank_sums_by_counting_pairs(spark):
    stats = [("e", f"g{k}", float(v)) for k, v in enumerate([1, 1, 2, 3, 3, 3, 5])] + [("e", "null", None), ("flat", "g0", 1.0), ("flat", "g1", 1.0)]
    ranked = spark.createDataFrame(stats, "experiment string, gene string, stat double")
    sets = spark.createDataFrame([("s", "g2"), ("s", "g6"), ("s", "g6"), ("s", "none"), ("all", "g0"), ("all", "g1")], "term string, gene string")
    got = {(r.experiment, r.term): (r.n, r.nes) for r in experiments.rank_sum_enrichment(ranked, sets).collect()}
    inside, outside = [2, 5], [1, 1, 3, 3, 3]
    u = sum((a > b) + (a == b) / 2 for a in inside for b in outside)
    var = 2 * 5 / 12 * (8 - ((8 - 2) + (27 - 3)) / (7 * 6))
    assert got["e", "s"][0] == 2 and abs(got["e", "s"][1] - (u - 5) / var**0.5) < 1e-9
    assert got["flat", "all"] == (2, None)


def test_pairs_in_a_set(spark):
    pairs = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("b", "y"), ("b", "far"), ("c", "z")], "a string, b string")
    sets = spark.createDataFrame([("s", g) for g in "abxyq"] + [("one", "a"), ("one", "z"), ("s", "far")], "term string, gene string")
    universe = spark.createDataFrame([(g,) for g in "abcxyzqrstuv"], "gene string")
    got = {r.term: r for r in experiments.pair_enrichment(pairs, sets, universe).collect()}
    assert set(got) == {"s"} and (got["s"].n, got["s"].firsts, got["s"].seconds) == (4, "a,b", "x,y")
    # Table (4, 1, 2, 5): 12 genes, 5 in the set, 6 in pairs.
    assert abs(got["s"].pval - sum(p for p in _hyper(12, 5, 6) if p <= _hyper(12, 5, 6)[4] * (1 + 1e-7))) < 1e-9
    loose = {r.term: r.n for r in experiments.pair_enrichment(pairs, sets, universe, both=False).collect()}
    assert loose == {"s": 4, "one": 2}
    # A gene on both sides counts twice, which its set can't hold: no p.
    narrow = experiments.pair_enrichment(spark.createDataFrame([("a", "a")], "a string, b string"), sets, universe).collect()
    assert {r.term: (r.n, r.pval) for r in narrow} == {"s": (2, None), "one": (2, None)}


def _hyper(all_, size, drawn):
    from math import comb

    return [comb(size, k) * comb(all_ - size, drawn - k) / comb(all_, drawn) for k in range(size + 1)]
