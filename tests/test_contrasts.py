"""Clusters against distances of whole clusters; two-part tests by hand."""

import math

import numpy as np
from pyspark.sql import functions as F

from strainspark.operators import contrasts


def test_merges_are_those_of_average_linkage(spark):
    rng = np.random.default_rng(5)
    x = {g: rng.normal(size=(n, 3)) for g, n in (("a", 14), ("b", 2), ("c", 1))}
    rows = spark.createDataFrame([(g, k, p.tolist()) for g, points in x.items() for k, p in enumerate(points)], "g string, k int, v array<double>")
    got = {}
    for r in contrasts.hierarchical_merges(rows, "g", F.col("k"), "v").collect():
        got.setdefault(r.g, {})[r.step] = (r.left, r.right, r.height, r.size)
    assert set(got) == {"a", "b"} and len(got["a"]) == 13
    for g, merges in got.items():
        members = {k: [k] for k in range(len(x[g]))}
        far = lambda a, b: np.mean([np.linalg.norm(x[g][i] - x[g][j]) for i in members[a] for j in members[b]])  # noqa: B023, E731
        for step in range(len(merges)):
            left, right, height, size = merges[step]
            nearest = min(far(a, b) for a in members for b in members if a < b)
            assert abs(far(left, right) - nearest) < 1e-9 and abs(height - nearest) < 1e-9
            members[len(x[g]) + step] = members.pop(left) + members.pop(right)
            assert len(members[len(x[g]) + step]) == size


def test_two_part_tests_by_hand(spark):
    values = {"s1": 2.0, "s2": 4.0, "s3": 4.0, "s5": 16.0, "s6": 16.0, "s7": 64.0}
    matrix = spark.createDataFrame([(s, "g", v) for s, v in values.items()] + [("s1", "only", 3.0)], "sample string, gene string, value double")
    classes = spark.createDataFrame([(f"s{k}", "x" if k < 5 else "y") for k in range(1, 9)], "sample string, class string")
    got = {r.gene: r for r in contrasts.hurdle_tests(matrix, classes, "x").collect()}
    level = 6 * math.log(((1 + 4 + 4 + 16 + 16 + 36) - 19 * 19 / 6) / (2 / 3 + 8 / 3))
    assert (got["g"].k1, got["g"].k0, got["g"].detected) == (3, 3, 0.0)
    assert abs(got["g"].level - level) < 1e-9 and abs(got["g"].pval - math.exp(-level / 2)) < 1e-12
    one = 2 * (math.log(1 / 4) + 3 * math.log(3 / 4) - math.log(1 / 8) - 7 * math.log(7 / 8))
    assert abs(got["only"].detected - one) < 1e-9 and got["only"].level is None and got["only"].pval is None


def test_every_type_has_a_whole_tree(spark, data):
    from strainspark.plans import contrasts as plans

    brands = {r.p_type: r.n for r in spark.read.parquet(f"{data}/part.parquet").groupBy("p_type").agg(F.countDistinct("p_brand").alias("n")).collect()}
    sizes = {}
    for r in plans.hierarchical_merges(spark, data).collect():
        sizes[r.p_type] = max(sizes.get(r.p_type, 1), r.size)
    assert sizes == {t: n for t, n in brands.items() if n > 1}
