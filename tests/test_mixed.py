"""Mixed models against dense matrices and quadrature; panels and clean-ups by hand."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from strainspark.operators import annotation, curation, features, markers, mixed, panels


def simulated(seed, n=240, cohorts=8):
    rng = np.random.default_rng(seed)
    cohort = rng.integers(cohorts, size=n)
    x = rng.normal(size=(n, 2))
    return rng, cohort, x, rng.normal(size=cohorts)[cohort]


def dense_deviance(x, y, z, theta):
    """-2 log of the restricted likelihood with whole matrices."""
    v = theta[0] * np.eye(len(y)) + theta[1] * z @ z.T
    w = np.linalg.inv(v)
    xx = x.T @ w @ x
    r = y - x @ np.linalg.solve(xx, x.T @ w @ y)
    return np.linalg.slogdet(v)[1] + np.linalg.slogdet(xx)[1] + r @ w @ r, np.linalg.solve(xx, x.T @ w @ y), np.sqrt(np.diag(np.linalg.inv(xx)))


def test_linear_mixed_model_is_the_best_dense_one(spark):
    rng, cohort, x, u = simulated(1, 100)
    y = 1 + x @ [0.5, -1.0] + 1.2 * u + rng.normal(size=len(u))
    rows = spark.createDataFrame([("g", str(c), float(a), float(b), float(v)) for c, (a, b), v in zip(cohort, x, y, strict=True)], "name string, cohort string, a double, b double, y double")
    got = {r.test: r for r in mixed.linear_mixed(rows, "y", ["a", "b"]).collect()}
    design, z = np.column_stack([np.ones(len(y)), x]), np.eye(8)[cohort]
    best = min(((dense_deviance(design, y, z, (e, s)), (e, s)) for e in np.linspace(0.6, 1.6, 11) for s in np.linspace(0.1, 4, 12)), key=lambda t: t[0][0])
    sums = [(float((cohort == c).sum()), np.column_stack([design, y])[cohort == c]) for c in range(8)]
    model = mixed.Reml([(n, m.sum(axis=0), m.T @ m) for n, m in sums])
    _, _, _, e, s = model.fit()
    assert dense_deviance(design, y, z, (e, s))[0] <= best[0][0] + 1e-6
    coef, se = dense_deviance(design, y, z, (e, s))[1:]
    for k, t in enumerate(["(Intercept)", "a", "b"]):
        assert abs(got[t].coef - coef[k]) < 1e-6 and abs(got[t].se - se[k]) < 1e-6
    # Within cohorts the slopes have nearly all degrees of freedom, the intercept about those of the cohorts.
    assert got["(Intercept)"].df < 12 and got["a"].df > 80


def test_linear_mixed_model_without_cohort_effect_is_least_squares(spark):
    rows = [("g", str(k % 4), float(k // 4 % 2), float(k // 4 % 2) * 2 + (k * 7 % 5) - 2 - (k % 4) * 0.0) for k in range(80)]
    got = {r.test: r for r in mixed.linear_mixed(spark.createDataFrame(rows, "name string, cohort string, a double, y double"), "y", ["a"]).collect()}
    x, y = np.array([[1, r[2]] for r in rows]), np.array([r[3] for r in rows])
    coef, rest, _, _ = np.linalg.lstsq(x, y, rcond=None)
    assert abs(got["a"].coef - coef[1]) < 1e-8 and got["a"].df == 78
    assert abs(got["a"].se - np.sqrt(rest[0] / 78 * np.linalg.inv(x.T @ x)[1, 1])) < 1e-8
    one = spark.createDataFrame([("h", "1", 1.0, 2.0), ("h", "1", 1.0, 3.0), ("h", "2", 1.0, 2.5), (None, "2", None, 1.0)], "name string, cohort string, a double, y double")
    assert [r.note for r in mixed.linear_mixed(one, "y", ["a"]).collect()] == ["too few rows or collinear"]


def test_binomial_mixed_model_is_near_quadrature(spark):
    rng, cohort, x, u = simulated(3, 600, 10)
    hit = (rng.random(600) < 1 / (1 + np.exp(-(-0.3 + 0.8 * (x[:, 0] > 0) + 0.7 * u)))).astype(int)
    rows = spark.createDataFrame([("n", int(c), int(a > 0), int(h)) for c, a, h in zip(cohort, x[:, 0], hit, strict=True)], "name string, cohort int, dx int, hit int")
    got = {r.test: r for r in mixed.binomial_mixed(rows, "hit", ["dx"]).collect()}
    model = mixed.Binomial(np.column_stack([np.ones(600), x[:, 0] > 0]), hit.astype(float), np.ones(600), cohort)
    coef, _, sd, _ = model.fit()
    assert np.allclose(coef, [got["(Intercept)"].coef, got["dx"].coef], atol=1e-3)
    nodes, weights = np.polynomial.hermite_e.hermegauss(60)

    def exact(theta):
        total = 0.0
        for c in range(10):
            mine = cohort == c
            eta = model.x[mine] @ theta[:2]
            z = eta[:, None] + np.exp(theta[2]) * nodes
            total += np.log((weights / weights.sum() * np.exp((hit[mine][:, None] * z - np.logaddexp(0, z)).sum(axis=0))).sum())
        return total

    at = np.array([*coef, np.log(sd)])
    assert abs(model.loglik(at) - exact(at)) < 0.2
    assert exact(at) > max(exact(at + d) for d in np.vstack([np.eye(3), -np.eye(3)]) * 0.15)
    few = rows.filter("hit = 0").union(rows.filter("hit = 1").limit(5))
    assert [r.note for r in mixed.binomial_mixed(few, "hit", ["dx"]).collect()] == ["too few"]


def test_best_combination_by_enumeration(spark):
    rho = {("p", "q"): 0.9, ("p", "r"): 0.1, ("q", "r"): 0.2, ("p", "s"): -0.5, ("q", "s"): 0.3, ("r", "s"): None}
    choices = [("g", "a", "p"), ("g", "a", "q"), ("g", "b", "q"), ("g", "b", "r"), ("g", "c", "s"), ("g", "c", "p"), ("h", "a", "p"), ("h", "b", "q")]
    got = panels.chosen_panels(spark.createDataFrame(choices, "genome string, slot string, gene string"), spark.createDataFrame([(*k, v) for k, v in rho.items()], "g1 string, g2 string, rho double"), ["a", "b", "c"], 0.5).collect()
    value = lambda x, y: 1.0 if x == y else rho[tuple(sorted((x, y)))] or 0.0
    best = max(itertools.product("pq", "qr", "sp"), key=lambda c: sum(value(x, y) for x in c for y in c))
    assert [(r.genome, r.a, r.b, r.c) for r in got] == [("g", *best)]
    assert abs(got[0].rho - sum(value(x, y) for x in best for y in best) / 9) < 1e-9


def test_rank_correlations_rank_zeros_once(spark):
    rng = np.random.default_rng(4)
    m = rng.integers(0, 4, size=(30, 5)) * 1.0
    m[:, 4] = [1.0] + [0.0] * 29
    rows = spark.createDataFrame([(i, f"g{j}", float(m[i, j])) for i in range(30) for j in range(5) if m[i, j]] + [(99, "g0", 1.0)], "sample int, gene string, value double")
    m = np.vstack([m, [1, 0, 0, 0, 0]])
    ranks = np.stack([[(c < v).sum() + ((c == v).sum() + 1) / 2 for v in c] for c in m.T])
    expected = np.corrcoef(ranks)
    got = {(r.g1, r.g2): (r.n, r.rho) for r in panels.rank_correlations(rows).collect()}
    assert len(got) == 10 and all(n == len(set(rows.toPandas()["sample"])) for n, _ in got.values())
    if len(set(rows.toPandas()["sample"])) == 31:
        assert all(abs(got[f"g{i}", f"g{j}"][1] - expected[i, j]) < 1e-9 for i in range(5) for j in range(i + 1, 5))


def test_next_statistics_by_hand(spark):
    rows = [("a1", "g", 0.5, 0.0, 3.0), ("a2", "g", 0.6, 0.0, 5.0), ("b1", "g", 0.7, 0.0, 4.0), ("a1", "h", 0.1, 0.0, 1.0)]
    stats = spark.createDataFrame(rows, "ident string, gene string, alpha double, mu double, mean double")
    families = spark.createDataFrame([("a1", "a"), ("a2", "a"), ("b1", "b")], "ident string, family string")
    got = {(r.ident, r.gene): r for r in markers.next_stats(stats, families).collect()}
    x = got["a1", "g"]
    assert (x.same_mean, x.same_ident, x.next_mean, x.next_ident, x.same_log2fc, x.next_log2fc) == (5.0, "a2", 4.0, "b1", 1.0, -1.0)
    assert got["b1", "g"].next_ident == "a2" and got["a1", "h"].next_log2fc == float("inf")
    assert {(r.ident, r.gene): r.next_ident for r in markers.next_stats(stats).collect()}["a2", "g"] == "b1"


def test_partial_correlation_is_null_where_it_would_be_noise(spark):
    r = spark.createDataFrame([(3, 0.5, 0.1, 0.2), (9, 0.5, 1.0, 0.2), (9, 0.5, 0.1, 0.2), (9, 0.5, float("nan"), 0.2)], "n int, rxy double, rxz double, ryz double")
    got = [x.partial for x in features.partial_correlation(r).collect()]
    assert got[0] is None and got[1] is None and got[3] is None and got[2] == pytest.approx((0.5 - 0.02) / np.sqrt(0.99 * 0.96))


def test_names_and_labels(spark):
    one = spark.range(1)
    label = lambda text: one.select(curation.nice_name(curation.taxonomy(F.lit(text))).alias("x")).first().x
    assert label("d__B;p__P_A;c__C;o__O;f__F;g__G;s__G alba") == "G alba"
    assert label("d__B;p__P;c__C;o__O;f__F;g__G;s__") == "G sp."
    assert label("d__B;p__P;c__C;o__O;f__F;g__G12;s__G12 sp3") == "G12 sp3 (F family)"
    assert label("d__B;p__P_A;c__;o__;f__;g__;s__") == "P phylum microbe"
    got = one.select(curation.reference_name(F.lit("GUTREFGUTGENOME012345_1")).alias("a"), curation.without_diagnosis(F.lit("s1_UC")).alias("b"), curation.diagnosis(F.lit("s1")).alias("c"), curation.wrapped(F.lit("a b c d e"), 2).alias("d"), curation.swapped(F.lit("abc"), {2: "X", 9: "Y"}).alias("e")).first()
    assert tuple(got) == ("GUT_GENOME012345", "s1", None, "a b\nc d\ne", "aXc")


def test_same_genome_isn_t_a_prefix(spark):
    hits = spark.createDataFrame([("P", "g1", "GUT_1", "t1", 90.0), ("P", "g1", "GUT_1", "t0", 90.0), ("P", "g2", "GUT_1", "t2", 80.0), ("P", "g1", "GUT_12", "t3", 99.0)], "panel string, gene string, genome string, target string, pident double")
    panel = spark.createDataFrame([("P", "g1"), ("P", "g2")], "panel string, gene string")
    assert sorted((r.genome, r.gene, r.target) for r in annotation.genomes_with_all(hits, panel).collect()) == [("GUT_1", "g1", "t0"), ("GUT_1", "g2", "t2")]


def test_few_known_values_are_drawn(spark):
    rows = spark.createDataFrame([(k, None if k % 9 else 30.0, None) for k in range(60)], "sample int, age double, sex string")
    out = curation.imputed_metadata(rows, "sample", ["age"], "sex", "M", "F").toPandas()
    assert out.nice_age.notna().all() and abs(out.nice_age.mean()) < 1e-9 and set(out.nice_sex) == {"M", "F"} and out.nice_age.nunique() > 50
