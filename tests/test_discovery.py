"""Marker contrasts against direct comparison of all cells."""

import math

import numpy as np
import pytest

from strainspark.operators import discovery
from strainspark.scratch import Scratch


@pytest.fixture
def scratch(spark):
    return Scratch(spark, "tests")


def _tables(spark, seed=4, n_cells=60, n_genes=12):
    rng = np.random.default_rng(seed)
    idents = [["a", "b", "c", None][k] for k in rng.integers(0, 4, n_cells)]
    x = rng.integers(0, 4, (n_cells, n_genes)).astype(float)
    x[:, 0] += 1  # every cell expresses it
    x[[i == "a" for i in idents], 1] += 3
    x[[i != "b" for i in idents], 2] = 0  # in one group only
    x[[i == "b" for i in idents], 3] = 0  # in all groups but one
    x[:, 4] = 2  # all cells alike
    x[:, 5] = 0
    cells = spark.createDataFrame([(f"c{i}", f"g{j:02}", float(x[i, j]), "x") for i in range(n_cells) for j in range(n_genes) if x[i, j] or (i + j) % 2], "cell string, gene string, count double, ident string")
    return x, idents, cells.drop("ident"), spark.createDataFrame([(f"c{i}", g) for i, g in enumerate(idents)], "cell string, ident string")


def _direct(x, idents, ident, ref):
    one = np.array([g == ident for g in idents])
    two = np.array([g is not None and g != ident and ref in (None, g) for g in idents])
    used = x[one | two]
    zero = 0.25 * used[used > 0].min() / (one.sum() + two.sum())
    out = {}
    for j in range(x.shape[1]):
        u, v = x[one, j], x[two, j]
        if not u.any() and not v.any():
            continue
        auc = np.mean([(a > v).mean() + (a == v).mean() / 2 for a in u])
        cutoffs = sorted(set(u) | set(v), reverse=True)[:-1]
        f = [(2 * (u >= t).sum() / ((u >= t).sum() + (v >= t).sum() + len(u)), t) for t in cutoffs]
        best = max(f, default=(0.0, None))
        out[f"g{j:02}"] = (int((u > 0).sum()), int((v > 0).sum()), math.log2(u.mean() + zero) - math.log2(v.mean() + zero), auc, *(best if best[0] else (0.0, None)))
    return out


@pytest.mark.parametrize("against", ["rest", "each"])
def test_all_contrasts_are_those_of_direct_comparison(spark, scratch, against):
    x, idents, cells, groups = _tables(spark)
    found = discovery.find_markers(cells, groups, scratch, against, least_cells=0, least_share=0.0, least_fold=1.0, direction="both")
    got = {}
    for r in found.collect():
        assert (r.ident, r.ref, r.gene) not in got
        got[r.ident, r.ref, r.gene] = (r.n, r.ref_n, r.log2fc, r.auc, r.f1, r.cutoff)
    contrasts = [(i, None) for i in "abc"] if against == "rest" else [(i, j) for i in "abc" for j in "abc" if i != j]
    wanted = {(i, j, g): v for i, j in contrasts for g, v in _direct(x, idents, i, j).items()}
    assert set(got) == set(wanted) and ("b", None if against == "rest" else "a", "g02") in got
    for key, v in wanted.items():
        assert got[key][:2] == v[:2] and np.allclose(got[key][2:5], v[2:5]) and got[key][5] == v[5], key


def test_contrasts_of_one_pair_are_mirrored(spark, scratch):
    _, _, cells, groups = _tables(spark, seed=9)
    found = {(r.ident, r.ref, r.gene): r for r in discovery.find_markers(cells, groups, scratch, "each", least_cells=0, least_share=0.0, least_fold=1.0, direction="both").collect()}
    for (i, j, g), r in found.items():
        other = found[j, i, g]
        assert abs(r.auc + other.auc - 1) < 1e-9 and abs(r.log2fc + other.log2fc) < 1e-9
        assert (r.pval is None) == (other.pval is None) and (r.pval is None or abs(r.pval - other.pval) < 1e-9)


def test_thresholds_direction_and_chosen_groups(spark, scratch):
    _, _, cells, groups = _tables(spark)
    up = discovery.find_markers(cells, groups, scratch, idents=["a"]).collect()
    assert {r.ident for r in up} == {"a"} and "g01" in {r.gene for r in up} and all(r.log2fc >= math.log2(1.25) and max(r.n, r.ref_n) >= 3 for r in up)
    both = discovery.find_markers(cells, groups, Scratch(spark, "tests"), idents=["b"], direction="both").collect()
    assert {"g02", "g03"} <= {r.gene for r in both} and {r.gene: r.cutoff for r in both}["g03"] is None
    with pytest.raises(ValueError, match="against"):
        discovery.find_markers(cells, groups, scratch, "none")


def test_empty_tables_and_a_single_group(spark, scratch):
    _, _, cells, groups = _tables(spark)
    assert discovery.find_markers(cells.limit(0), groups, scratch).count() == 0
    assert discovery.find_markers(cells, groups.limit(0), Scratch(spark, "tests")).count() == 0
    assert discovery.find_markers(cells, groups.filter("ident = 'a'"), Scratch(spark, "tests"), "each").count() == 0
    assert discovery.find_markers(cells, groups.filter("ident = 'a'"), Scratch(spark, "tests")).count() == 0
