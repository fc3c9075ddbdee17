"""Steps that took memory or time beyond the growth of their input, and their results."""

import time

from strainspark.functions import special
from strainspark.operators import enrichment, trees
from strainspark.scratch import Scratch


def test_set_pairs_are_adjusted_at_the_places_of_their_p(spark):
    rows = lambda k: spark.createDataFrame([(f"s{m % k}", m) for m in range(97)], "name string, member long")
    got = enrichment.set_pair_tests(rows(7), rows(5), 97, Scratch(spark, "places")).collect()
    assert got and all(r.pval == round(r.pval, 9) for r in got)


def test_clades_of_values_are_those_of_all_pairs(spark):
    closed = [("t", "root", x) for x in "abcdefg"] + [("t", "x", x) for x in "abc"] + [("t", "y", x) for x in "de"] + [("t", "z", x) for x in "fg"] + [("t", x, x) for x in "abcdefg"]
    value = {"a": (1, 1.0), "b": (1, 4.5), "c": (1, 3.0), "d": (1, 1.0), "e": (2, 1.5), "f": (2, 9.0), "g": (2, 30.0)}
    of = spark.createDataFrame(closed, "tree string, node string, tip string")
    places = spark.createDataFrame([(t, *v) for t, v in value.items()], "tip string, grp int, value double")
    pairs = [(a, b, abs(value[a][1] - value[b][1])) for a in value for b in value if a < b and value[a][0] == value[b][0]]
    slow = trees.tight_clades(of, spark.createDataFrame(pairs, "a string, b string, d double"), 10).collect()
    assert sorted(trees.tight_value_clades(of, places, 10).collect()) == sorted(slow) == [("t", "x", 3, 3.5)]


def test_exact_rows_of_many_counts():
    start = time.time()
    assert abs(special.exact_rows((60000, 60300, 59800), (240000, 239000, 241000)) - 0.0353032372) < 1e-9
    # Two columns and an empty one are Fisher's test; so unlikely a table is 0 in doubles.
    assert abs(special.exact_rows((6000, 0, 6100), (23900, 0, 24000)) - special.fisher_exact(6000, 6100, 23900, 24000)[1]) < 1e-9
    assert special.exact_rows((100000, 0, 0), (0, 100000, 100000)) == 0.0
    assert time.time() - start < 30


def test_nearest_is_a_product_of_blocks(spark):
    from strainspark.operators import markers

    rows = [(k, [float(k % 7) - 3, float(k % 5), 1.0]) for k in range(60)] + [(60, [0.0, 0.0, 0.0]), (61, None)]
    v = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    found = markers.nearest(v.filter("id % 20 = 0"), v, 61)
    # No vector is compared in Spark's own arrays, element by element.
    assert "zip_with" not in found._jdf.queryExecution().toString()
    got = found.collect()

    def cos(a, b):
        return None if not a or not b or not any(a) or not any(b) else round(sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) ** 0.5 * sum(y * y for y in b) ** 0.5), 9)

    for q, own in rows:
        if q % 20 == 0:
            best = sorted(((None if (c := cos(own, x)) is None else -c, k) for k, x in rows if k != q), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
            assert [(r.id, r.sim) for r in sorted((r for r in got if r.q == q), key=lambda r: r.rank)] == [(k, None if c is None else -c) for c, k in best]


def test_reads_and_genes_of_several_rows_meet_once(spark):
    from strainspark.operators import relations

    reads = [(1, 1, 5, 15), (1, 2, 95, 104), (1, 2, 95, 104), (1, 3, 40, 400), (2, 3, 5, 15), (1, 4, 0, 500)]
    genes = [(1, 10, 0, 20), (1, 11, 100, 120), (1, 11, 90, 99), (2, 10, 0, 20), (1, 12, 400, 600), (1, 13, 30, 450)]
    found = relations.reads_in_genes(spark.createDataFrame(reads, "contig int, id int, first int, last int"), spark.createDataFrame(genes, "contig int, gene int, low int, high int"), 50)
    want = {(i, g) for c, i, a, b in reads for d, g, low, high in genes if c == d and (low <= a <= high or low <= b <= high)}
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)
    # Pairs of names with one row each are not gathered again.
    assert found._jdf.queryExecution().optimizedPlan().toString().lstrip().startswith("Union")


def test_permutations_move_sums_of_bins(spark):
    import hashlib

    from strainspark.operators import statistics

    rows = [(g, s, float((s * 7 + len(g)) % 11), int(s % 3 == 0)) for g in ("a", "bb") for s in range(1500 if g == "a" else 5)]
    found = statistics.permutation_p(spark.createDataFrame(rows, "g string, s long, x double, y int"), "x", "y", ["g"], "s", 20)
    for r in found.collect():
        own = [x for x in rows if x[0] == r.g]
        n1, total = sum(x[3] for x in own), sum(x[2] for x in own)
        d = lambda ones: sum(x[2] for x in ones) / n1 - (total - sum(x[2] for x in ones)) / (len(own) - n1)  # noqa: B023, E731
        observed = d([x for x in own if x[3]])
        drawn = [d(sorted(own, key=lambda x: (hashlib.md5(f"{k}:{x[1]}".encode()).hexdigest(), x[1]))[:n1]) for k in range(1, 21)]  # noqa: B023
        assert abs(r.observed - observed) < 1e-9 and abs(r.pval - sum(v >= observed - 1e-9 for v in drawn) / 20) < 1e-9


def test_sums_at_the_cut_are_kept_in_any_order(spark):
    from strainspark.operators import strain

    # Two strains have 153 of 170 reads, 9/10 exactly; their sum in doubles is below it.
    total = 10000.0
    freq = [v / 170 for v in (23, 130, 8, 9)]
    assert freq[0] * total + freq[1] * total < 9000
    rows = spark.createDataFrame([("s", "x", f"t{k}", f) for k, f in enumerate(freq)], "sample string, species string, strain string, freq double")
    found = strain.strain_features(spark.createDataFrame([("s", "x", total)], "sample string, species string, tpk double"), rows, 0.1, 9000)
    assert found.count() == len(freq) + 1


def test_overlaps_move_lists_of_names(spark, monkeypatch):
    from strainspark.operators import statistics

    rows = [(k % 11 if k % 5 else None, k % 7 if k % 13 else None) for k in range(60)]
    sets = {}
    for name, member in rows:
        sets.setdefault(name, set()).add(member)
    want = [(a, b, len((sets[a] & sets[b]) - {None}), len(sets[a]), len(sets[b])) for a in sets for b in sets if a is not None and b is not None and a < b]
    for listed in (1000, 2):
        monkeypatch.setattr(statistics, "LISTED", listed)
        found = statistics.set_overlaps(spark.createDataFrame(rows, "name int, member int"))
        assert sorted((r.s1, r.s2, r.both, r.n1, r.n2) for r in found.collect()) == sorted(x for x in want if x[2])
        # The pairs of a set are counted where its lists are; none is a row of a join.
        assert "collect_list" in found._jdf.queryExecution().optimizedPlan().toString()


def test_overlaps_are_counted_by_arrays(spark, monkeypatch):
    from strainspark.operators import statistics

    rows = [(f"n{k * k % 23}", k % 9) for k in range(200)] + [(None, 1), ("n1", None), ("alone", 99)]
    sets = {}
    for name, member in rows:
        sets.setdefault(name, set()).add(member)
    del sets[None]
    want = [(a, b, n, len(sets[a]), len(sets[b])) for a in sets for b in sets if a < b and (n := len((sets[a] & sets[b]) - {None}))]
    for listed, at_once in ((1000, 1 << 20), (1000, 3), (2, 5)):
        monkeypatch.setattr(statistics, "LISTED", listed)
        monkeypatch.setattr(statistics, "COUNTED_AT_ONCE", at_once)
        found = statistics.set_overlaps(spark.createDataFrame(rows, "name string, member int"))
        assert sorted((r.s1, r.s2, r.both, r.n1, r.n2) for r in found.collect()) == sorted(want)
        # No pair is a row before it is counted.
        assert "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString()
    assert statistics.set_overlaps(spark.createDataFrame([], "name string, member int")).count() == 0


def test_batches_of_met_names_are_cut_between_sets():
    import pyarrow as pa

    from strainspark.operators import statistics

    kept, statistics.COUNTED_AT_ONCE = statistics.COUNTED_AT_ONCE, 4
    try:
        rows = [(s, [(s * 7 + j * k) % 5 for j in range(k % 4)]) for s in range(6) for k in range(s + 3)]
        whole = pa.record_batch({"s1": pa.array([s for s, _ in rows], "int32"), "names": pa.array([x for _, x in rows], pa.list_(pa.int32()))})
        for step in (1, 2, 5, 100):
            got = [r for b in statistics._counted(whole.slice(i, step) for i in range(0, len(rows), step)) for r in b.to_pylist()]
            want = {}
            for s, names in rows:
                for x in names:
                    want[s, x] = want.get((s, x), 0) + 1
            assert sorted((r["s1"], r["s2"], r["both"]) for r in got) == sorted((*k, n) for k, n in want.items())
    finally:
        statistics.COUNTED_AT_ONCE = kept


def test_genes_of_any_batches_are_fitted_together(monkeypatch):
    import numpy as np
    import pandas as pd
    import pyarrow as pa

    from strainspark.operators import hurdle

    rng = np.random.default_rng(3)
    design = pd.DataFrame({"dx": [0.0, 0.0, 1.0, 1.0], "age": [0.0, 1.0, 0.0, 1.0], "size": [9, 8, 7, 9]})
    k = rng.integers(0, 6, (9, 4))
    k[3], k[5] = (0, 2, 0, 0), (3, 2, 0, 0)  # one pattern, one class
    gene, pattern = np.nonzero(k)
    n = k[gene, pattern]
    s = n * 3 + rng.normal(size=len(n))
    names = pa.array([None if g == 0 else f"g{g}" for g in gene])  # null is a gene
    rows = pa.record_batch({"gene": names, "pattern": pa.array(pattern.astype("int32")), "k": pa.array(n), "s": pa.array(s), "q": pa.array(s * s / n + 1)})

    def fits(batches):
        return pa.Table.from_batches(list(hurdle._tests(design, ["dx", "age"], ["dx"])(iter(batches)))).to_pandas()

    whole = fits([rows])
    assert whole["gene"].tolist() == [None, *[f"g{g}" for g in range(1, 9)]] and whole["detected"].tolist() == k.sum(axis=1).tolist()
    assert whole["p_c"].isna()[[3, 5]].all() and whole["p_c"].notna().any() and whole["p_d"].notna().all()
    pd.testing.assert_frame_equal(fits([rows.slice(i, 4) for i in range(0, len(n), 4)]), whole)
    monkeypatch.setattr(hurdle, "CELLS", 8)
    pd.testing.assert_frame_equal(fits([rows]), whole)
    alone = pd.concat([fits([rows.filter(pa.array(gene == g))]) for g in range(9)], ignore_index=True)
    pd.testing.assert_frame_equal(alone, whole)
