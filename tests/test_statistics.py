import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from strainspark.functions import special
from strainspark.operators import markers, matrix, ranking, relations, statistics, strain, trees


def test_special_functions():
    assert abs(special.t_two_sided(2.228, 10) - 0.05) < 1e-3
    assert abs(special.f_tail(4.96, 1, 10) - 0.05) < 1e-3
    assert abs(special.normal_two_sided(1.959964) - 0.05) < 1e-6
    assert special.correlation_p(1.0, 5) == 0.0


@settings(max_examples=60, deadline=None)
@given(st.tuples(*[st.integers(0, 9)] * 4))
def test_fisher_is_enumeration(t):
    a, b, c, d = t
    row, other, col = a + b, c + d, a + c
    weights = {k: math.comb(row, k) * math.comb(other, col - k) for k in range(max(0, col - other), min(row, col) + 1)}
    p = sum(w for w in weights.values() if w <= weights[a] * (1 + 1e-7)) / sum(weights.values())
    assert abs(special.fisher_exact(a, b, c, d)[1] - min(1, p)) < 1e-9


def test_conditional_odds():
    # The conditional estimate of this table is 6.408, not the sample ratio 9 x 3 / ...
    odds, p = special.fisher_exact(3, 1, 1, 3)
    assert abs(odds - 6.4083) < 1e-3 and abs(p - 0.4857) < 1e-3


def test_bh(spark):
    rows = spark.createDataFrame([("a", 0.01), ("a", 0.02), ("a", 0.04), ("a", None), ("b", 0.5)], "g string, p double")
    got = sorted((r.g, r.p if r.p is not None else 9, round(r.padj, 6) if r.padj is not None else None) for r in ranking.bh_adjusted(rows, "p", ["g"]).collect())
    assert got == [("a", 0.01, 0.03), ("a", 0.02, 0.03), ("a", 0.04, 0.04), ("a", 9, None), ("b", 0.5, 0.5)]


def test_ranks_and_auc(spark):
    rows = spark.createDataFrame([("g", 5.0), ("g", 5.0), ("g", 7.0)], "g string, x double")
    assert sorted(r[0] for r in rows.select(ranking.average_rank("x", "g")).collect()) == [1.5, 1.5, 3.0]
    scored = spark.createDataFrame([("g", float(k), int(k > 2)) for k in range(1, 5)], "g string, s double, y int")
    assert statistics.auc(scored, "s", "y", ["g"]).first().auc == 1.0


def test_normalisation_and_group_means(spark):
    m = spark.createDataFrame([("s", "a", 1.0), ("s", "b", 3.0)], "sample string, gene string, value double")
    assert {r.gene: r.tpk for r in matrix.normalised(m).collect()} == {"a": 2500.0, "b": 7500.0}
    m = spark.createDataFrame([("s1", "a", 2.0), ("s2", "a", 6.0)], "sample string, gene string, value double")
    groups = spark.createDataFrame([(f"s{k}", "g") for k in range(1, 5)], "sample string, grp string")
    assert matrix.group_means(m, groups).first()["mean"] == 2.0


def test_quota(spark):
    from pyspark.sql import functions as F

    sizes = spark.createDataFrame([("a", 2), ("b", 10), ("c", 10)], "g string, n long")
    assert {r.g: r.quota for r in ranking.quotas(sizes, "g", "n", F.lit(12)).collect()} == {"a": 2, "b": 5, "c": 5}
    rows = spark.createDataFrame([(g, k) for g, n in (("a", 2), ("b", 10)) for k in range(n)], "g string, k int")
    assert ranking.downsampled(rows, "g", "k", 6).count() == 6


def test_relations(spark):
    panel = spark.createDataFrame([("p", "a"), ("p", "b"), ("q", "a")], "k string, m string")
    assert [r.k for r in relations.all_members_in(panel, "k", "m", spark.createDataFrame([("a",)], "m string")).collect()] == ["q"]
    days = spark.createDataFrame([("n", 0, 1.0), ("n", 20, 2.0), ("n", 25, 3.0)], "s string, day int, v double")
    assert sorted((r.t0, r.tf) for r in relations.pairs_in_time(days, ["s"], "day", 14, ["v"]).collect()) == [(0, 20), (0, 25)]


def test_competition(spark):
    rows = spark.createDataFrame([("g", "s", 0, 0.2, 0.15, 10.0), ("g", "s", 20, 0.3, 0.1, 20.0), ("g", "s", 20, 0.3, 0.1, 12.0), ("g", "t", 0, 0.05, 0.5, 1.0), ("g", "t", 40, 0.5, 0.5, 9.0)], "name string, subject string, day int, h double, d double, c double")
    got = strain.competition(rows).collect()
    assert [(r.subject, r.t0, r.tf, r.delta_c, r.direction) for r in got] == [("s", 0, 20, 10.0, 1)]


def _tree(spark):
    return spark.createDataFrame([("t", "n1", None, False), ("t", "n2", "n1", False), ("t", "a", "n2", True), ("t", "b", "n2", True), ("t", "c", "n1", True)], "tree string, node string, parent string, is_tip boolean")


def test_closure_and_ancestors(spark):
    closed = trees.closure(_tree(spark))
    assert {(r.node, r.tip) for r in closed.collect()} == {("n1", "a"), ("n1", "b"), ("n1", "c"), ("n2", "a"), ("n2", "b"), ("a", "a"), ("b", "b"), ("c", "c")}
    sets = spark.createDataFrame([("x", "a"), ("x", "c"), ("y", "a"), ("y", "b")], "name string, tip string")
    assert {r.name: r.node for r in trees.smallest_common(closed, sets).collect()} == {"x": "n1", "y": "n2"}


def test_greedy_choice_is_disjoint_and_in_order(spark):
    closed = trees.closure(_tree(spark))
    nodes = spark.createDataFrame([("t", "n1", 0.02), ("t", "n2", 0.01), ("t", "c", 0.5)], "tree string, node string, padj double")
    assert sorted((r.node, r.pick) for r in trees.greedy_disjoint(closed, nodes).collect()) == [("c", 2), ("n2", 1)]


def test_deconvolution_recovers_simulated_mixtures(spark):
    rng = np.random.default_rng(3)
    genotypes = [(k, pos, "ACGT"[rng.integers(4)], 1.0) for k in range(3) for pos in range(60)]
    z = rng.dirichlet([1, 1, 1], 8)
    counts = []
    for m in range(8):
        for pos in range(60):
            p = np.full(4, 0.0025)
            for k, q, a, _ in genotypes:
                if q == pos:
                    p["ACGT".index(a)] += 0.99 * z[m, k]
            counts += [(m, pos, "ACGT"[i], int(n)) for i, n in enumerate(rng.multinomial(500, p / p.sum())) if n]
    c = spark.createDataFrame(counts, "sample int, pos int, allele string, n long")
    g = spark.createDataFrame(genotypes, "strain int, pos int, allele string, p double")
    got = {(r.sample, r.strain): r.z for r in strain.sample_frequencies(c, g).collect()}
    assert all(abs(sum(got[m, k] for k in range(3)) - 1) < 1e-9 for m in range(8))
    assert max(abs(got[m, k] - z[m, k]) for m in range(8) for k in range(3)) < 0.03
    frequencies, found = strain.deconvolved(c, g, rounds=1)
    assert frequencies.count() == 24 and found.count() == 180


def test_interactions_need_whole_complexes(spark):
    m = spark.createDataFrame([("x", "l1"), ("x", "l2"), ("y", "l1"), ("y", "r")], "ident string, gene string")
    pairs = spark.createDataFrame([("l1+l2", "r"), ("l1", "r")], "lig string, rec string")
    assert {tuple(r) for r in markers.interaction_edges(m, pairs).collect()} == {("x", "y", "l1+l2", "r"), ("x", "y", "l1", "r"), ("y", "y", "l1", "r")}


def test_overlap_pruning(spark):
    rows = spark.createDataFrame([("t1", 1, "a"), ("t1", 1, "b"), ("t2", 2, "a"), ("t3", 3, "c"), ("t3", 3, "a")], "term string, ord int, member string")
    assert sorted(r.term for r in ranking.pruned_overlaps(rows, 0.5).collect()) == ["t1", "t3"]




def test_convergence_of_a_likelihood():
    from strainspark.operators.strain import converged

    assert not converged([-10.0, -5.0], 0.1, 0.1, 2) and not converged([-10.0, -5.0, -4.99, -1.0], 0.1, 0.001, 2)
    assert converged([-10.0, -5.0, -4.99, -4.985], 0.1, 1e-9, 2) and converged([-1e6, -5e5, -499999.0, -499998.5], 0.01, 1e-5, 2)
