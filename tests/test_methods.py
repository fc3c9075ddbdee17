"""Communities, enrichment and the other iterative methods against enumeration and direct computation."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strainspark.operators import enrichment, graphs, ordering
from strainspark.scratch import Scratch


@pytest.fixture
def scratch(spark):
    return Scratch(spark, "tests")


# order


def test_places_and_adjusted_p_over_the_whole_table(spark, scratch):
    rng = np.random.default_rng(3)
    p = np.round(rng.random(500), 2)  # many ties
    rows = spark.createDataFrame([(k, float(x)) for k, x in enumerate(p)] + [(-1, None)], "k long, p double").repartition(7)
    placed = ordering.in_order(rows.filter("p IS NOT NULL"), [F.asc("p"), F.desc("k")], scratch, "o", {"p": F.col("p")}).toPandas().sort_values("place")
    assert placed["place"].tolist() == list(range(1, 501)) and placed["k"].tolist() == sorted(range(500), key=lambda k: (p[k], -k))
    assert np.allclose(placed["running_p"], np.cumsum(np.sort(p)))
    rank = np.array([(p <= x).sum() for x in p])
    wanted = [min(1.0, *(500 * p / rank)[p >= x]) for x in p]
    got = ordering.adjusted_over_all(rows, "p", scratch).toPandas().set_index("k")["padj"]
    assert np.isnan(got[-1]) and np.allclose(got[range(500)], wanted)
    # 250 tests without rows, all of p 1, are as many more tests
    more = spark.createDataFrame([(1.0, 250)], "p double, n long")
    with_more = ordering.adjusted_over_all(rows, "p", scratch, more=more).toPandas().set_index("k")["padj"]
    wanted = [min(1.0, *(750 * p / rank)[(p >= x) & (p < 1)]) if (p[p >= x] < 1).any() else 1.0 for x in p]
    assert np.allclose(with_more[range(500)], wanted)
    assert ordering.adjusted_over_all(rows.limit(0), "p", scratch).count() == 0


# graphs


def brute_modularity(edges, of):
    whole = 2 * sum(w for _, _, w in edges)
    inside = sum(2 * w for a, b, w in edges if of[a] == of[b])
    ends = {}
    for a, b, w in edges:
        for x in (a, b):
            ends[of[x]] = ends.get(of[x], 0) + w
    return inside / whole - sum((x / whole) ** 2 for x in ends.values())


def partitions(items):
    if not items:
        yield []
        return
    for rest in partitions(items[1:]):
        for k in range(len(rest)):
            yield rest[:k] + [[items[0], *rest[k]]] + rest[k + 1 :]
        yield [[items[0]], *rest]


def test_modularity_is_that_of_its_definition(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b), float(rng.integers(1, 5))) for a, b in itertools.combinations(range(12), 2) if rng.random() < 0.4] + [(3, 3, 2.0)]
    of = {k: k % 3 for k in range(12)}
    table = spark.createDataFrame(edges, "a long, b long, w double")
    got = graphs.modularity(table, spark.createDataFrame(list(of.items()), "node long, community long")).agg(F.sum("modularity")).first()[0]
    assert abs(got - brute_modularity(edges, of)) < 1e-12


@pytest.mark.parametrize("edges", [
    [(a, b, 1.0) for g in (range(4), range(4, 8)) for a, b in itertools.combinations(g, 2)] + [(3, 4, 1.0)],
    [(k, (k + 1) % 8, 1.0 + (k % 2) * 3) for k in range(8)],
])
def test_communities_are_the_best_partition_of_small_graphs(spark, scratch, edges):
    found, levels = graphs.louvain(spark.createDataFrame(edges, "a long, b long, w double"), scratch)
    of = {r.node: r.community for r in found.collect()}
    best = max(brute_modularity(edges, {x: k for k, part in enumerate(parts) for x in part}) for parts in partitions(list(range(8))))
    assert abs(brute_modularity(edges, of) - best) < 1e-9 and abs(levels[-1] - best) < 1e-9
    assert all(of[x] == min(y for y in of if of[y] == of[x]) for x in of)


def test_levels_rise_and_planted_groups_come_out(spark, scratch):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b), 1.0) for a, b in itertools.combinations(range(60), 2) if rng.random() < (0.6 if a // 15 == b // 15 else 0.03)]
    found, levels = graphs.louvain(spark.createDataFrame(edges, "a long, b long, w double"), scratch)
    of = {r.node: r.community for r in found.collect()}
    assert levels == sorted(levels) and abs(levels[-1] - brute_modularity(edges, of)) < 1e-9
    assert levels[-1] >= brute_modularity(edges, {k: k // 15 for k in range(60)}) - 0.01
    assert sum(of[a] == of[b] for a, b in itertools.combinations(range(60), 2) if a // 15 == b // 15) > 0.9 * 4 * 105
    none, levels = graphs.louvain(spark.createDataFrame([], "a long, b long, w double"), scratch)
    assert none.count() == 0 and levels == []


def test_neighbours_are_exact_in_one_bucket_and_recalled_in_many(spark, scratch):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    v = centres[rng.integers(0, 12, 600)] + 0.3 * rng.normal(size=(600, 16))
    v[100:140] = v[100]  # copies
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)] + [(1000, [0.0] * 16), (1001, None)], "id long, v array<double>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    sim = np.round(unit @ unit.T, 9)
    np.fill_diagonal(sim, -9)
    wanted = {(q, int(x)) for q in range(600) for x in np.argsort(-sim[q], kind="stable")[:5]}
    exact = {(r.q, r.id) for r in graphs.knn_graph(rows, 5, scratch).collect()}
    assert len(exact & wanted) >= 0.995 * len(wanted) and len(exact) == len(wanted)  # equal ones at nine places aside
    many = graphs.knn_graph(rows, 5, Scratch(spark, "many"), bucket=40).collect()
    assert max(r["rank"] for r in many) == 5 and all(r.q != r.id for r in many)
    near = [r for r in many if not 100 <= r.q < 140]
    assert sum(r.sim >= sorted(sim[r.q])[-5] - 1e-9 for r in near) >= 0.9 * 5 * 560


def test_jaccard_weights(spark):
    near = spark.createDataFrame([(1, 2), (1, 3), (2, 1), (2, 3), (3, 4), (4, 3)], "q long, id long")
    got = {(r.a, r.b): r.w for r in graphs.neighbour_edges(near).collect()}
    assert got == {(1, 2): 1 / 3}
    assert {(r.a, r.b, r.w) for r in graphs.neighbour_edges(near, "count").collect()} == {(1, 2, 1.0), (1, 3, 1.0), (2, 3, 1.0), (3, 4, 1.0)}


# enrichment


def plain_score(places, stats, n_genes):
    hits = sorted(places)
    weights = np.abs([stats[p - 1] for p in hits])
    best, run, at = 0.0, 0.0, 0
    top, low = -9.0, 9.0
    for place in range(1, n_genes + 1):
        if at < len(hits) and hits[at] == place:
            low = min(low, run)
            run += weights[at] / weights.sum()
            top = max(top, run)
            at += 1
        else:
            run -= 1 / (n_genes - len(hits))
    best = top if top >= -low - 1e-12 else low
    return best


def test_enrichment_p_of_all_small_sets(spark, scratch):
    """Of 9 genes, all sets of 3 as null: p of every set against the share of sets at least as extreme."""
    stats = [4.0, 3.0, 2.5, 1.0, 0.5, -0.5, -1.5, -2.0, -4.5]
    ranked = spark.createDataFrame([(f"g{k}", x) for k, x in enumerate(stats)] + [("gone", None)], "gene string, stat double")
    all_sets = list(itertools.combinations(range(1, 10), 3))
    sets = spark.createDataFrame([(",".join(map(str, s)), f"g{p - 1}") for s in all_sets[::7] for p in s], "name string, member string")
    got = enrichment.set_enrichment(ranked, sets, scratch, permutations=4000, least=2).collect()
    null = np.array([plain_score(s, stats, 9) for s in all_sets])
    for r in got:
        score = plain_score([int(x) for x in r.name.split(",")], stats, 9)
        assert abs(r.score - score) < 1e-6
        p = min((null >= score - 1e-9).sum() / (null >= 0).sum(), (null <= score + 1e-9).sum() / (null <= 0).sum(), 1)
        assert abs(r.pval - p) < 0.05, (r, p)
        assert abs(r.nes - score / abs(null[null >= 0].mean() if score > 0 else null[null <= 0].mean())) < 0.1
    assert len(got) == len(all_sets[::7])
    assert enrichment.set_enrichment(ranked, sets.limit(0), Scratch(spark, "none")).count() == 0


def test_random_places_are_samples_without_repeats(spark):
    for n, most in ((1000, 50), (30, 20)):
        rows = enrichment.random_places(spark, n, most, 200, "s").toPandas()
        assert len(rows) == 200 * most and rows.groupby("k")["place"].nunique().eq(most).all() and rows["place"].between(1, n).all()
        assert abs(rows["place"].mean() - (n + 1) / 2) < n * 0.02


def test_pairs_of_sets_against_enumeration(spark, scratch):
    from strainspark.functions.special import fisher_exact

    rng = np.random.default_rng(7)
    left = {f"a{k}": set(rng.choice(30, rng.integers(2, 9), replace=False).tolist()) for k in range(6)}
    right = {f"b{k}": set(rng.choice(30, rng.integers(2, 9), replace=False).tolist()) for k in range(5)}
    table = lambda sets: spark.createDataFrame([(k, int(x)) for k, v in sets.items() for x in v], "name string, member long")
    p = {(a, b): fisher_exact(len(x & y), len(x - y), len(y - x), 30 - len(x | y)) for a, x in left.items() for b, y in right.items()}
    values = np.array([v[1] for v in p.values()])
    adjusted = {k: min([1.0] + [values[values <= x * (1 + 1e-9)].max() * len(values) / (values <= x * (1 + 1e-9)).sum() for x in values if x >= v[1] * (1 - 1e-9)]) for k, v in p.items()}
    got = enrichment.set_pair_tests(table(left), table(right), 30, scratch).collect()
    assert len(got) == sum(bool(x & y) for x in left.values() for y in right.values())
    for r in got:
        odds, pval = p[(r.s1, r.s2)]
        assert abs(r.pval - pval) < 1e-9 and (abs(r.odds - odds) < 1e-6 or r.odds == odds) and abs(r.padj - adjusted[(r.s1, r.s2)]) < 1e-9


# clades


def random_tree(rng, n_tips):
    """(edges, tips below each node) of a random tree with nodes of two or three children."""
    parts = [(f"t{k}", {f"t{k}"}) for k in range(n_tips)]
    edges, below, k = [], dict(parts), 0
    while len(parts) > 1:
        taken = [parts.pop(rng.integers(len(parts))) for _ in range(min(len(parts), int(rng.integers(2, 4))))]
        name, k = f"i{k}", k + 1
        edges += [(x, name) for x, _ in taken]
        below[name] = set().union(*(y for _, y in taken))
        parts.append((name, below[name]))
    return [*edges, (parts[0][0], None)], below


def chosen_one_by_one(below, stats, p, least):
    """By falling effect: nodes are refused, taken or replaced one after the other, then the largest others are added."""
    order = sorted(stats, key=lambda x: -stats[x])
    used = {}
    for i in order:
        inside = [j for j in order if j != i and below[j] < below[i]]
        if any(stats[j] >= stats[i] and p[(i, j)] < 0.05 for j in inside):
            used[i] = False
            continue
        for j in [j for j in order if used.get(j)]:
            if below[i] & below[j]:
                large, small = (i, j) if len(below[i]) > len(below[j]) else (j, i)
                winner = large if p[(large, small)] >= 0.05 else (i if stats[i] > stats[j] else j)
                used[i], used[j] = winner == i, winner == j
        used.setdefault(i, True)
    enriched = {x for x in used if used[x]}
    others = set()
    while True:
        free = [x for x in below if x.startswith("i") and len(below[x]) >= least and not any(below[x] & below[y] for y in enriched | others)]
        if not free:
            return enriched, others
        others.add(max(free, key=lambda x: len(below[x])))


def test_clades_are_those_chosen_one_by_one(spark):
    from strainspark.functions.special import exact_rows
    from strainspark.operators import selection, trees

    rng = np.random.default_rng(11)
    edges, stats, expected = [], [], set()
    for tree in range(25):
        rows, below = random_tree(rng, 12 if tree < 20 else 40)
        classes = {x: int(rng.integers(0, 3)) for x in below if x.startswith("t")}
        counts = {x: [20 * sum(classes[t] == c for t in tips) for c in range(3)] for x, tips in below.items()}  # each tip stands for 20 samples
        effect = {x: float(np.round(rng.random() * 3, 3)) for x in below if x.startswith("i")}
        low = {x for x in effect if rng.random() < 0.6}
        edges += [(tree, x, y, x.startswith("t")) for x, y in rows]
        stats += [(tree, x, 0.01 if x in low else 0.5, effect[x], counts[x]) for x in effect] + [(tree, rows[-1][0], 0.001, float("nan"), counts[rows[-1][0]])]
        significant = {x: effect[x] for x in low}
        if significant:
            p = {(x, y): exact_rows(tuple(counts[y]), tuple(a - b for a, b in zip(counts[x], counts[y], strict=True))) for x in effect for y in effect if below[y] < below[x]}
            enriched, others = chosen_one_by_one(below, significant, p, 4)
            expected |= {(tree, x, True) for x in enriched} | {(tree, x, False) for x in others}
        else:
            expected.add((tree, rows[-1][0], False))
    edges = spark.createDataFrame(edges, "tree long, node string, parent string, is_tip boolean")
    stats = spark.createDataFrame(stats, "tree long, node string, padj double, effect double, counts array<long>")
    got = selection.selected_clades(edges, trees.ancestry(edges), stats, least=4).collect()
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)
    assert any(r.enriched for r in got) and any(not r.enriched for r in got)


def test_exact_p_of_two_rows():
    from math import comb

    from strainspark.functions.special import exact_rows, fisher_exact

    assert abs(exact_rows((3, 5), (9, 2)) - fisher_exact(3, 5, 9, 2)[1]) < 1e-12
    x, y = (3, 1, 4), (1, 5, 2)
    columns = [a + b for a, b in zip(x, y, strict=True)]
    weight = {a: comb(columns[0], a[0]) * comb(columns[1], a[1]) * comb(columns[2], a[2]) for a in itertools.product(*(range(c + 1) for c in columns)) if sum(a) == sum(x)}
    assert abs(exact_rows(x, y) - sum(w for w in weight.values() if w <= weight[x] * (1 + 1e-7)) / sum(weight.values())) < 1e-12
    assert exact_rows((0, 0, 0), (3, 4, 5)) == exact_rows((3, 0, 0), (4, 0, 0)) == 1.0
    four = exact_rows((2, 1, 0, 3), (1, 1, 4, 0))
    assert 0 < four < 0.2


def test_ancestry_of_deep_and_bushy_trees(spark):
    from strainspark.operators import trees

    rows = [("chain", k, k - 1 if k else None, k == 20) for k in range(21)] + [("star", k, 0 if k else None, k > 0) for k in range(9)] + [("one", 0, None, True)]
    edges = spark.createDataFrame(rows, "tree string, node long, parent long, is_tip boolean")
    got = [tuple(r) for r in trees.ancestry(edges).collect()]
    wanted = {("chain", a, b) for a in range(21) for b in range(a, 21)} | {("star", 0, k) for k in range(9)} | {("star", k, k) for k in range(9)} | {("one", 0, 0)}
    assert set(got) == wanted and len(got) == len(wanted)
    assert trees.ancestry(edges.limit(0)).count() == 0


# search over estimates


def planted(rng, strains, samples, sites, depth=60):
    """(counts rows, genotypes, shares) of a mixture whose strains all differ."""
    g = rng.integers(0, 4, (strains, sites))
    z = rng.dirichlet(np.full(strains, 0.5), samples)
    rows = []
    for m in range(samples):
        for pos in range(sites):
            p = np.full(4, 0.01 / 4)
            for k in range(strains):
                p[g[k, pos]] += 0.99 * z[m, k]
            rows += [(m, pos, "ACGT"[a], int(n)) for a, n in enumerate(rng.multinomial(depth, p / p.sum())) if n]
    return rows, g, z


def plain_likelihood(n, g, z, penalty=None):
    """n: samples, sites, 4."""
    share = (z[:, :, None, None] * np.eye(4)[g][None]).sum(axis=1)
    model = (n * np.log(np.maximum(1e-10, 0.99 * share + 0.0025))).sum(axis=2)
    low = np.log(0.25) * n.sum(axis=2)
    return model.sum() if penalty is None else np.maximum(model, penalty * low).sum()


def test_search_recovers_a_planted_mixture(spark, scratch):
    from strainspark.operators import search

    rng = np.random.default_rng(4)
    rows, g, z = planted(rng, 3, 12, 25)
    sites = search.site_counts(spark.createDataFrame([*rows, (0, 0, "N", 9)], "sample long, pos long, allele string, n long"))
    found = search.Search(sites, 3, scratch)
    found.shallow(6, 3, 2, seed="7")
    found.deep(60, 1, rise=1e-4)
    assert all(b >= a - 1e-6 for h in found.history.values() for a, b in zip(h, h[1:], strict=False))
    n = np.zeros((12, 25, 4))
    for m, pos, a, k in rows:
        n[m, pos, "ACGT".index(a)] = k
    best = found.best(1)[0]
    got_g = np.array([r.g for r in found.genotypes.filter(F.col("estimate") == best).orderBy("pos").collect()]).T
    got_z = np.array([r.z for r in found.frequencies.filter(F.col("estimate") == best).orderBy("sample").collect()])
    assert abs(got_z.sum(axis=1) - 1).max() < 1e-9
    assert abs(found.history[best][-1] - plain_likelihood(n, got_g, got_z)) < 1e-4
    assert found.history[best][-1] >= plain_likelihood(n, g, z) - 5
    order = [int((got_g == g[k]).mean(axis=1).argmax()) for k in range(3)]
    assert sorted(order) == [0, 1, 2] and (got_g[order] == g).mean() > 0.9 and abs(got_z[:, order] - z).mean() < 0.05
    row = found.table().collect()[0]
    k = 1 + 12 * 2 + 3 * 3 * 25
    assert abs(row.aic - (2 * k - 2 * row.loglik)) < 1e-6 and abs(row.bic - (k * np.log(n.sum()) - 2 * row.loglik)) < 1e-6


def test_steps_of_known_and_masked_sites(spark, scratch):
    from strainspark.operators import search

    rng = np.random.default_rng(9)
    rows, g, z = planted(rng, 2, 5, 12)
    n = np.zeros((5, 12, 4))
    for m, pos, a, k in rows:
        n[m, pos, "ACGT".index(a)] = k
    n[1, 3], n[2, 5] = [15, 15, 15, 15], [0, 0, 0, 90]  # sites that fit no mixture
    g[:, 5] = 1
    sites = spark.createDataFrame([(m, pos, n[m, pos].tolist()) for m in range(5) for pos in range(12)], "sample long, pos long, n array<double>")
    genotypes = spark.createDataFrame([(0, pos, g[:, pos].tolist()) for pos in range(12)], "estimate long, pos long, g array<int>")
    frequencies = spark.createDataFrame([(0, m, z[m].tolist()) for m in range(5)], "estimate long, sample long, z array<double>")
    plain, masked = search.likelihoods(sites, genotypes, frequencies).first(), search.likelihoods(sites, genotypes, frequencies, 1.25).first()
    assert abs(plain.loglik - plain_likelihood(n, g, z)) < 1e-6 and plain.masked == 0
    assert abs(masked.loglik - plain_likelihood(n, g, z, 1.25)) < 1e-6 and masked.masked >= 1
    # the best of all changes of one or two strains
    moved = {r.pos: r.g for r in search.genotype_step(sites, genotypes, frequencies, 2, penalty=1.25).collect()}
    for pos in range(12):
        def score(x):
            one = g.copy()
            one[:, pos] = x
            return plain_likelihood(n[:, [pos]], one[:, [pos]], z, 1.25)
        options = [[a, b] for a in range(4) for b in range(4)]
        assert abs(score(moved[pos]) - max(map(score, options))) < 1e-5
    held = search.genotype_step(sites, genotypes, frequencies, 2, held=1)
    assert all(r.g[0] == g[0, r.pos] for r in held.collect())
    # frequencies against a fine grid
    fitted = {r.sample: r.z for r in search.frequency_step(sites, genotypes, 2).collect()}
    for m in range(5):
        grid = max((plain_likelihood(n[[m]], g, np.array([[x, 1 - x]])), x) for x in np.linspace(0, 1, 2001))
        assert plain_likelihood(n[[m]], g, np.array([fitted[m]])) >= grid[0] - 1e-6


def test_searches_merge_and_agree(spark, scratch):
    from strainspark.operators import search

    rng = np.random.default_rng(6)
    rows, _, _ = planted(rng, 2, 6, 10)
    sites = search.site_counts(spark.createDataFrame(rows, "sample long, pos long, allele string, n long"))
    one, two = search.Search(sites, 2, Scratch(spark, "one")), search.Search(sites, 2, Scratch(spark, "two"))
    for x, seed in ((one, "a"), (two, "b")):
        x.shallow(4, 25, 1, seed=seed)
    likely = sorted([one.history[one.best(1)[0]][-1], two.history[two.best(1)[0]][-1]], reverse=True)
    kept = one.merge(two, 2)
    assert [one.history[k][-1] for k in kept] == likely
    d = search.estimate_distances(one.genotypes, one.frequencies)
    row = d.collect()
    assert len(row) == 1 and 0 <= row[0].genetic <= 1 and -1e-9 <= row[0].frequency <= 1
    assert search.agree(d, 1.0, 1.0) and not search.agree(d.limit(0), 1.0, 1.0)
    same = one.genotypes.filter(F.col("estimate") == kept[0])
    twice, shares = same.union(same.withColumn("estimate", F.lit(99).cast("long"))), one.frequencies.filter(F.col("estimate") == kept[0])
    zero = search.estimate_distances(twice, shares.union(shares.withColumn("estimate", F.lit(99).cast("long")))).first()
    assert zero.genetic == 0 and abs(zero.frequency) < 1e-9
    assert search.has_converged([1.0, 5.0, 5.0005], 1e-2, None, 2) and not search.has_converged([1.0, 5.0], 1.0, None, 2)
    assert search.has_converged([0.0, 99.0, 100.0], None, 0.02, 2) and not search.has_converged([0.0, 50.0, 100.0], None, 0.02, 2)
    fixed = spark.createDataFrame([(p, [2]) for p in range(10)], "pos long, g array<int>")
    assert all(r.g[0] == 2 and len(r.g) == 3 for r in search.first_genotypes(sites, 2, 3, "s", fixed).collect())


# batches


def test_neighbours_between_two_sides(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(90, 6))
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, v array<double>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    sim = unit[:30] @ unit[30:].T
    wanted = {(q, 30 + int(x)) for q in range(30) for x in np.argsort(-sim[q])[:4]}
    got = {(r.q, r.id) for r in graphs.cross_knn(rows.filter("id < 30"), rows.filter("id >= 30"), 4, Scratch(spark, "cross")).collect()}
    assert got == wanted
    assert graphs.cross_knn(rows.limit(0), rows, 4, Scratch(spark, "none")).count() == 0


def test_mutual_neighbours_move_a_batch_onto_another(spark, scratch):
    from strainspark.operators import batches

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(3, 8)) * 3
    one = centres[rng.integers(0, 3, 60)] + 0.2 * rng.normal(size=(60, 8))
    two = centres[rng.integers(0, 3, 50)] + 0.2 * rng.normal(size=(50, 8)) + np.array([0.8] * 8)
    rows = spark.createDataFrame([(k, "a", x.tolist()) for k, x in enumerate(one)] + [(100 + k, "b", x.tolist()) for k, x in enumerate(two)] + [(900, "c", [1.0] * 8), (901, None, [2.0] * 8)], "id long, batch string, v array<double>")
    got = {r.id: np.array(r.v) for r in batches.neighbour_corrected(rows, ["a", "b"], scratch, k=5, smooth=10).collect()}
    assert len(got) == 112 and all(np.allclose(got[k], one[k]) for k in range(60)) and np.allclose(got[900], 1) and np.allclose(got[901], 2)

    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    sim = np.round(unit(one) @ unit(two).T, 9)
    there, back = np.argsort(-sim, axis=1, kind="stable")[:, :5], np.argsort(-sim.T, axis=1, kind="stable")[:, :5]
    pairs = [(a, b) for a in range(60) for b in there[a] if a in back[b]]
    moves = {b: np.mean([one[a] - two[b] for a, c in pairs if c == b], axis=0) for b in {b for _, b in pairs}}
    known = sorted(moves)
    for b in range(50):
        s = np.round(unit(two[b]) @ unit(two[known]).T, 9)
        near = [known[k] for k in np.argsort(-s, kind="stable")[:10]]
        far = ((unit(two[near]) - unit(two[b])) ** 2).sum(axis=1)
        w = np.exp(-(far - far.min()) / 0.1)
        assert np.allclose(got[100 + b], two[b] + (w[:, None] * np.array([moves[x] for x in near])).sum(axis=0) / w.sum())
    apart = lambda x: np.linalg.norm(x - one[:, None], axis=2).min(axis=0).mean()
    assert apart(np.array([got[100 + b] for b in range(50)])[None]) < 0.6 * apart(two[None])


def test_shrunken_batches_against_a_direct_fit(spark):
    from strainspark.operators import batches

    rng = np.random.default_rng(2)
    batch = np.array(["x"] * 7 + ["y"] * 9 + ["z"])
    value = rng.normal(size=(17, 12)) * rng.uniform(0.5, 2, 12) + 3 + (batch == "y")[:, None] * rng.normal(1, 0.3, 12)
    matrix = spark.createDataFrame([(s, g, float(value[s, g])) for s in range(17) for g in range(12)] + [(s, 99, 4.0) for s in range(17)], "sample long, gene long, value double")
    got = {(r.sample, r.gene): r.value for r in batches.combat_adjusted(matrix, spark.createDataFrame([(k, b) for k, b in enumerate(batch)], "sample long, batch string")).collect()}
    centre = value.mean(axis=0)
    residual = value - np.array([value[batch == b].mean(axis=0) for b in batch])
    spread = np.sqrt((residual**2).mean(axis=0))
    z = (value - centre) / spread
    for b in ("x", "y"):
        rows = z[batch == b]
        g, d, n = rows.mean(axis=0), rows.var(axis=0, ddof=1), len(rows)
        gbar, t2, m, s2 = g.mean(), g.var(ddof=1), d.mean(), d.var(ddof=1)
        a, c = (2 * s2 + m * m) / s2, (m * s2 + m**3) / s2
        gs, ds = g, d
        for _ in range(500):
            gs = (t2 * n * g + ds * gbar) / (t2 * n + ds)
            ds = (0.5 * ((rows - gs) ** 2).sum(axis=0) + c) / (n / 2 + a - 1)
        wanted = (rows - gs) / np.sqrt(ds) * spread + centre
        for k, s in enumerate(np.flatnonzero(batch == b)):
            assert np.allclose([got[(s, x)] for x in range(12)], wanted[k], atol=1e-6)
    assert all(got[(16, g)] == value[16, g] for g in range(12)) and all(got[(s, 99)] == 4.0 for s in range(17))


# variable genes


def direct_local(x, y, span=0.75, turns=4):
    """The robust local quadratic at every point itself."""
    n, robust = len(x), np.ones(len(x))
    q = int(n * span + 1e-9)
    for turn in range(turns):
        fitted = np.empty(n)
        for k in range(n):
            far = np.abs(x - x[k])
            h = np.sort(far)[q - 1]
            w = np.where(far < h, (1 - (far / h) ** 3) ** 3, 0) * robust
            a = np.stack([np.ones(n), x - x[k], (x - x[k]) ** 2], axis=1)
            fitted[k] = np.linalg.lstsq(a * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0][0]
        r = np.abs(y - fitted)
        robust = np.clip(1 - (r / (6 * np.median(r))) ** 2, 0, None) ** 2
    return fitted


def test_local_regression_is_that_of_direct_fits(spark, scratch):
    from strainspark.operators import variable

    rng = np.random.default_rng(1)
    x = np.sort(rng.gamma(2, 1.5, 300))
    y = np.sin(x / 2) - 0.2 * x + 0.1 * rng.normal(size=300)
    y[::40] += 3  # outliers
    rows = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(x, y, strict=True))] + [(900, None, 1.0), (901, 1.0, float("nan"))], "gene long, x double, y double")
    got = {r.gene: (r.fitted, r.residual) for r in variable.local_residuals(rows, scratch).collect()}
    wanted = direct_local(x, y)
    assert sorted(got) == list(range(300))
    apart = np.array([abs(got[k][0] - wanted[k]) for k in range(300)])
    assert apart.max() < 0.02 and apart.mean() < 5e-4  # the curve is a cubic between its points
    assert all(abs(got[k][0] + got[k][1] - y[k]) < 1e-9 for k in range(300))
    assert variable.local_residuals(rows.limit(0), Scratch(spark, "none")).count() == 0


def test_variable_genes_come_from_every_bin(spark, scratch):
    from strainspark.operators import variable

    rng = np.random.default_rng(5)
    mean = np.repeat(rng.gamma(2, 5, 200), 2)  # each mean twice
    variance = mean * rng.uniform(0.5, 2, 400)
    rows = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(mean, variance, strict=True))] + [(900, 0.0, 1.0), (901, 2.0, 0.0)], "gene long, mean double, variance double")
    got = variable.variable_genes(rows, scratch, 40, 10).toPandas()
    around = {r.gene: r for r in variable.local_residuals(rows.filter("mean > 0 AND variance > 0").selectExpr("gene", "ln(mean) AS x", "ln(sqrt(variance) / mean) AS y"), Scratch(spark, "again")).collect()}
    first = {}
    for k in range(400):
        first[around[k].x] = min(first.get(around[k].x, 999), around[k].place)
    bins = {k: (first[around[k].x] - 1) * 10 // 400 + 1 for k in range(400)}
    wanted = {k for b in range(1, 11) for k in sorted((x for x in bins if bins[x] == b), key=lambda x: (-around[x].residual, x))[:4]}
    assert set(got["gene"]) == wanted and len(got) == 40 and all(bins[g] == b for g, b in zip(got["gene"], got["bin"], strict=True))


# components


def standardised(x):
    return (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)


def sparse_rows(spark, x):
    return spark.createDataFrame([(f"s{i}", j, float(x[i, j])) for i in range(x.shape[0]) for j in range(x.shape[1]) if x[i, j]], "sample string, gene long, value double")


def test_random_components_are_those_of_the_svd(spark, scratch):
    from strainspark.operators import components

    rng = np.random.default_rng(1)
    x = np.round(np.maximum(rng.normal(size=(80, 4)) @ (rng.normal(size=(4, 30)) * np.array([8, 5, 3, 2])[:, None]) + rng.normal(size=(80, 30)), 0), 3)
    constant = spark.createDataFrame([(f"s{i}", 99, 2.0) for i in range(80)] + [("s0", 98, None)], "sample string, gene long, value double")
    scores, loadings, values = components.random_pca(sparse_rows(spark, x).union(constant), 4, scratch, passes=8)
    z = standardised(x)
    u, s, vt = np.linalg.svd(z, full_matrices=False)
    assert np.allclose(values, s[:4], rtol=1e-6)
    v = np.array([r.v for r in loadings.orderBy("gene").collect()])
    assert v.shape == (30, 4) and np.allclose(np.abs((v * vt[:4].T).sum(axis=0)), 1, atol=1e-5)
    assert all(v[np.abs(v[:, k]).argmax(), k] > 0 for k in range(4))
    got = {r.sample: r.y for r in scores.collect()}
    assert np.allclose([got[f"s{i}"] for i in range(80)], z @ v, atol=1e-8)
    stats = spark.createDataFrame([(j, float(x[:, j].mean()), float(x[:, j].std(ddof=1))) for j in range(30)], "gene long, mean double, sd double")
    again = {r.sample: r.y for r in components.projected(sparse_rows(spark, x[:7]), stats, loadings).collect()}
    assert np.allclose([again[f"s{i}"] for i in range(7)], (z @ v)[:7], atol=1e-8)


def test_number_of_planted_components(spark, scratch):
    from strainspark.operators import components

    rng = np.random.default_rng(4)
    x = rng.normal(size=(100, 2)) @ (3 * rng.normal(size=(2, 20))) + rng.normal(size=(100, 20)) + 20
    number, p = components.significant_components(sparse_rows(spark, x), 6, scratch, permutations=15)
    assert number == 2 and p == sorted(p) and p[0] == 0 and p[-1] == 1
    none, _ = components.significant_components(sparse_rows(spark, rng.normal(size=(100, 20)) + 20), 6, Scratch(spark, "noise"), permutations=15)
    assert none <= 1


# networks


def test_shuffles_keep_degrees_and_repeat_no_edge(spark, scratch):
    from strainspark.operators import networks

    rng = np.random.default_rng(3)
    edges = sorted({(f"g{rng.integers(12)}", f"c{rng.integers(9)}") for _ in range(60)})
    table = spark.createDataFrame(edges, "a string, b string")
    rows = networks.shuffled_edges(table.union(table.limit(3)), 8, scratch, turns=12).toPandas()
    degrees = lambda pairs, side: sorted(pd.Series([p[side] for p in pairs]).value_counts().items())
    different = set()
    for k, one in rows.groupby("k"):
        pairs = list(zip(one["a"], one["b"], strict=True))
        assert len(pairs) == len(set(pairs)) == len(edges)
        assert all(degrees(pairs, side) == degrees(edges, side) for side in (0, 1))
        different.add(tuple(sorted(pairs)))
        assert len(set(pairs) & set(edges)) < len(edges)
    assert len(different) == 8
    groups = spark.createDataFrame([(int(a[1:]) % 2, a, b) for a, b in edges], "group long, a string, b string")
    for (k, g), one in networks.shuffled_edges(groups, 3, Scratch(spark, "groups"), turns=6).toPandas().groupby(["k", "group"]):
        own = [(a, b) for a, b in edges if int(a[1:]) % 2 == g]
        assert degrees(list(zip(one["a"], one["b"], strict=True)), 1) == degrees(own, 1)


def test_shuffles_are_even_over_the_graphs_of_these_degrees(spark, scratch):
    """Of 3 by 3 nodes with two edges each there are six graphs, which shuffles meet about equally often."""
    from strainspark.operators import networks

    edges = [("x", "p"), ("x", "q"), ("y", "q"), ("y", "r"), ("z", "r"), ("z", "p")]
    rows = networks.shuffled_edges(spark.createDataFrame(edges, "a string, b string"), 600, scratch, turns=16).toPandas()
    seen = pd.Series([tuple(sorted(zip(g["a"], g["b"], strict=True))) for _, g in rows.groupby("k")]).value_counts()
    assert len(seen) == 6 and seen.min() > 60 and seen.max() < 150


def test_network_p_against_the_exact_null(spark, scratch):
    from strainspark.operators import networks

    rng = np.random.default_rng(2)
    lig, rec = [("A", "l1"), ("A", "l2"), ("B", "l2"), ("B", "l3"), ("C", "l3"), ("C", "l1")], [("A", "r1"), ("B", "r1"), ("B", "r2"), ("C", "r2")]
    pairs = [("l1", "r1"), ("l2", "r1"), ("l2", "r2"), ("l3", "r2")]
    make = lambda lig, rec: {(lc, rc, x, y) for lc, x in lig for rc, z in rec for u, y in pairs if u == x and y == z}
    edges = sorted(make(lig, rec))

    def graph(rows):
        out = {}
        for a, b in {(r[0], r[1]) for r in rows}:
            w = len({r[2] for r in rows if (r[0], r[1]) == (a, b)}) + len({r[3] for r in rows if (r[0], r[1]) == (a, b)})
            for x in ((a, b), (b, a)):
                out[x] = out.get(x, 0) + w
        return out

    def graphs_of(own):
        cells, genes = [c for c, _ in own], [g for _, g in own]
        return [x for x in {tuple(sorted(zip(p, genes, strict=True))) for p in itertools.permutations(cells)} if len(set(x)) == len(x)]

    null = [graph(make(x, y)) for x in graphs_of(lig) for y in graphs_of(rec)]
    true = graph(edges)
    got = {(r.a, r.b): (r.weight, r.pval) for r in networks.network_pvalues(spark.createDataFrame(edges, "lcell string, rcell string, lig string, rec string"), scratch, shuffles=300, turns=12).collect()}
    assert {x: v[0] for x, v in got.items()} == true
    for x, (w, p) in got.items():
        assert abs(p - np.mean([g.get(x, 0) >= w for g in null])) < 0.1, (x, p)
    assert rng is not None


def test_clusters_merge_as_one_pair_at_a_time_would(spark, scratch):
    from strainspark.operators import networks

    rng = np.random.default_rng(7)
    places = {"a": (0, 0), "b": (0.4, 0), "c": (10, 0), "d": (10, 0.5), "e": (0, 20), "f": (0.6, 20), "g": (30, 30)}
    kinds = {"a": 0, "b": 0, "c": 1, "d": 2, "e": 3, "f": 4, "g": 5}  # a and b can't be told apart; c and d, e and f can
    rows, counts = [], []
    for ident, at in places.items():
        for k in range(30):
            cell = f"{ident}{k}"
            rows.append((cell, ident, "s1" if ident == "e" else f"s{k % 6}", [at[0] + 0.05 * float(rng.normal()), at[1] + 0.05 * float(rng.normal())]))
            counts += [(cell, gene, float(rng.poisson(6 if gene % 6 == kinds[ident] else 1))) for gene in range(18)]
    cells, matrix = spark.createDataFrame(rows, "cell string, ident string, batch string, v array<double>"), spark.createDataFrame(counts, "cell string, gene long, value double")
    found, merges = networks.merged_clusters(cells, matrix, scratch, markers=3, batches=2)
    of = {r.cell: r.ident for r in found.collect()}
    assert set(merges) == {("a", "b"), ("e", "f")}  # e is of one batch only
    assert of["b0"] == "a" and of["f3"] == "e" and of["c0"] == "c" and of["d0"] == "d" and of["g0"] == "g" and len(of) == 210

    def area(x, y):
        return np.mean([(u > v) + 0.5 * (u == v) for u in x for v in y])

    table = pd.DataFrame(counts, columns=["cell", "gene", "value"])
    table["ident"] = table["cell"].str[0]
    for pair in (("a", "b"), ("c", "d")):
        high = low = 0
        for _, one in table.groupby("gene"):
            x, y = (one.loc[one["ident"] == i, "value"].to_numpy() for i in pair)
            if x.mean() != y.mean() and max(x.mean(), y.mean()) >= 2 * min(x.mean(), y.mean()):
                high, low = high + (area(x, y) >= 0.65), low + (area(x, y) <= 0.35)
        assert (high < 3 and low < 3) == (pair in merges)


# two-part models and contamination


def test_two_part_tests_against_dense_fits(spark, scratch):
    from strainspark.functions.special import chi_square_tail
    from strainspark.operators import hurdle

    assert abs(chi_square_tail(3.841458820694124, 1) - 0.05) < 1e-9 and abs(chi_square_tail(5.991464547107979, 2) - 0.05) < 1e-9
    assert abs(chi_square_tail(7.814727903251179, 3) - 0.05) < 1e-9 and abs(chi_square_tail(9.487729036781154, 4) - 0.05) < 1e-9
    rng = np.random.default_rng(8)
    n = 120
    dx, age = rng.integers(0, 2, n), rng.integers(0, 5, n)
    rows, dense = [], {}
    for g in range(6):
        hit = rng.random(n) < 1 / (1 + np.exp(-(-0.5 + 0.9 * dx * (g % 2) + 0.2 * age)))
        v = 2.0 ** (3 + 0.5 * dx * (g > 2) + 0.1 * age + rng.normal(0, 0.7, n))
        dense[g] = np.where(hit, v, 0)
        rows += [(s, g, float(dense[g][s])) for s in range(n) if hit[s]]
    rows += [(0, 50, 3.0), (1, 50, 0.0), (999, 0, 5.0)]
    samples = spark.createDataFrame([(s, int(dx[s]), int(age[s])) for s in range(n)] + [(999, None, 1)], "sample long, dx int, age int")
    got = {r.gene: r for r in hurdle.covariate_tests(spark.createDataFrame(rows, "sample long, gene long, value double"), samples, ["dx", "age"], ["dx"], scratch).collect()}
    x = np.column_stack([np.ones(n), dx, age])

    def logistic(x, y):
        b = np.zeros(x.shape[1])
        for _ in range(200):
            p = 1 / (1 + np.exp(-x @ b))
            b = b + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x, x.T @ (y - p))
        eta = x @ b
        return b, (y * eta - np.logaddexp(0, eta)).sum()

    def normal(x, y):
        b = np.linalg.lstsq(x, y, rcond=None)[0]
        return b, -len(y) / 2 * np.log(((y - x @ b) ** 2).sum())

    for g in range(6):
        hit = dense[g] > 0
        (bd, ld), (_, ld0) = logistic(x, hit), logistic(x[:, [0, 2]], hit)
        (bc, lc), (_, lc0) = normal(x[hit], np.log2(dense[g][hit])), normal(x[hit][:, [0, 2]], np.log2(dense[g][hit]))
        r = got[g]
        assert r.detected == hit.sum() and abs(r.coef_d - bd[1]) < 1e-6 and abs(r.coef_c - bc[1]) < 1e-6
        assert abs(r.p_d - chi_square_tail(2 * (ld - ld0), 1)) < 1e-6 and abs(r.p_c - chi_square_tail(2 * (lc - lc0), 1)) < 1e-6
        assert abs(r.p_h - chi_square_tail(2 * (ld - ld0 + lc - lc0), 2)) < 1e-6
    assert got[50].detected == 1 and got[50].p_c is None and got[50].p_h is None and got[50].p_d is not None
    p = sorted(got[g].p_h for g in range(6))
    assert abs(min(got[g].padj_h for g in range(6)) - min(6 * x / (k + 1) for k, x in enumerate(p))) < 1e-9


def test_contaminants_lie_on_a_robust_line(spark):
    from strainspark.operators import ambient

    rng = np.random.default_rng(5)
    x = np.linspace(-2, 8, 40)
    y = 0.9 * x - 3 + 0.05 * rng.normal(size=40)
    y[::8] += 4
    a, b = ambient.huber_line(x, y)
    w = np.ones(40)
    for _ in range(2000):  # the same estimating equations, stepped slowly
        m = np.column_stack([np.ones(40), x])
        beta = np.linalg.solve((m * w[:, None]).T @ m, (m * w[:, None]).T @ y)
        r = y - m @ beta
        w = np.minimum(1, 1.345 * np.median(np.abs(r)) / 0.6745 / np.abs(r))
    assert abs(a - beta[0]) < 1e-4 and abs(b - beta[1]) < 1e-4 and abs(b - 0.9) < 0.05
    rows = [("g", f"n{k}", float(2 ** (0.9 * v - 3)), float(2**v)) for k, v in enumerate(x)] + [("g", "own", 64.0, 4.0), ("g", "absent", 0.0, 2**-3.0), ("tiny", "n1", 1.0, 1.0)]
    means = spark.createDataFrame(rows, "ident string, gene string, mean double, reference double")
    got = {(r.ident, r.gene): r for r in ambient.contaminants(means, top=3).collect()}
    assert got[("g", "own")].residual > 5 and not got[("g", "own")].contaminant
    assert all(abs(got[("g", f"n{k}")].residual) < 0.1 and got[("g", f"n{k}")].contaminant for k in range(40))
    assert got[("tiny", "n1")].residual is None and ("g", "absent") not in got


# density


def test_crowded_cells_are_thinned_more(spark, scratch):
    from strainspark.operators import density

    rng = np.random.default_rng(12)
    v = np.concatenate([rng.normal(size=(60, 5)) * 0.1 + [3, 0, 0, 0, 0], rng.normal(size=(40, 5))])
    rows = [(k, "a", int(k % 13), x.tolist()) for k, x in enumerate(v)] + [(1000 + k, "b", 1, [1.0, float(k), 0.0, 0.0, 0.0]) for k in range(4)] + [(2000, "c", 1, [1.0] * 5)]
    cells = spark.createDataFrame(rows, "cell long, ident string, depth int, v array<double>")
    quotas = spark.createDataFrame([("a", 55), ("b", 10)], "ident string, quota int")
    got = {r.cell: r for r in density.density_downsampled(cells, quotas, scratch, k=6, around=15).collect()}
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    sim = np.round(unit @ unit.T, 9)
    np.fill_diagonal(sim, -9)
    near = np.argsort(-sim, axis=1, kind="stable")
    crowd = np.bincount(near[:, :6].ravel(), minlength=100) + 1
    assert all(got[k].crowd == crowd[k] for k in range(100))
    rates = np.array([got[k].rate for k in range(100)])
    assert abs(rates.sum() - 45) < 1
    order = np.argsort(crowd, kind="stable")
    assert (np.diff(rates[order]) >= -1e-12).all() and rates.min() >= 0 and rates.max() <= 1
    for k in range(100):
        beats = sum(k % 13 >= j % 13 for j in near[k][:15])
        assert got[k].kept == (beats >= rates[k] * 15)
    assert all(got[x].rate == 0 and got[x].kept for x in (1000, 1003, 2000)) and len(got) == 105


def test_rolling_windows_and_bins_by_blocks(spark):
    from strainspark.operators import features

    rng = np.random.default_rng(4)
    frame = pd.DataFrame({"k": range(157), "o": rng.integers(0, 40, 157), "v": rng.normal(size=157)})
    rows = spark.createDataFrame(frame).repartition(5)
    ordered = frame.sort_values(["o", "k"])
    wanted = {}
    for p, k in enumerate(ordered["k"]):
        near = ordered["v"].iloc[max(0, p - 4) : p + 6]
        wanted[k] = (ordered["v"].iloc[p] - near.mean()) / near.std()
    got = {r.k: r.v_z for r in features.rolling_z(rows, "v", [F.asc("o"), F.asc("k")], 4, 5, block=10).collect()}
    assert len(got) == 157 and all(abs(got[k] - wanted[k]) < 1e-9 for k in wanted)
    bins = {r.k: r.bin for r in features.in_equal_bins(rows, "o", 8, [F.asc("o"), F.asc("k")]).collect()}
    parts = np.array_split(ordered["k"].to_numpy(), 8)
    assert all(bins[k] == b for b, part in enumerate(parts, 1) for k in part)
    few = {r.k: r.bin for r in features.in_equal_bins(rows.filter("k < 3"), "k", 8, [F.asc("k")]).collect()}
    assert few == {0: 1, 1: 2, 2: 3}


# queries of trained models, and chosen cells


def test_principal_components_against_a_full_decomposition(spark, data):
    from strainspark.plans import inference

    got = {r.id: r.scores for r in inference.pca_project(spark, data).collect()}
    rows = {r.id: r.v for r in inference._vectors(spark, data).collect()}
    ids = sorted(rows)
    z = standardised(np.array([rows[k] for k in ids]))
    _, s, vt = np.linalg.svd(z, full_matrices=False)
    wanted = z @ vt[:5].T
    wanted *= np.where(vt[np.arange(5), np.abs(vt[:5]).argmax(axis=1)] > 0, 1, -1)
    assert np.allclose([got[k] for k in ids], wanted, atol=1e-4)


def test_forest_covers_held_out_vectors_and_is_repeatable(spark, data):
    from strainspark.plans import inference

    rows = inference.rf_classify(spark, data).collect()
    held = {r.id for r in inference._vectors(spark, data).filter("label IS NOT NULL").filter(F.pmod(F.xxhash64("id"), F.lit(5)) == 0).collect()}
    assert {r.id for r in rows} == held
    assert all(abs(sum(r.probability) - 1) < 1e-9 and r.probability[r.prediction] == max(r.probability) for r in rows)
    again = {r.id: r.prediction for r in inference.rf_classify(spark, data).collect()}
    assert all(again[r.id] == r.prediction for r in rows)  # labels of these vectors are drawn at random, so accuracy says nothing


def test_chosen_cells_are_known_even_and_the_same_again(spark):
    from strainspark.operators import curation

    rows = [(k, "a" if k < 40 else "b" if k < 55 else "c", k % 2, None if k % 10 == 0 else 1.0) for k in range(60)]
    cells = spark.createDataFrame(rows, "cell long, ident string, batch int, age double")
    one = {r.cell for r in curation.selected_cells(cells, ["age"], "ident", "batch", "cell", 24).collect()}
    again = {r.cell for r in curation.selected_cells(cells.repartition(3), ["age"], "ident", "batch", "cell", 24).collect()}
    assert one == again and len(one) <= 24 and not any(k % 10 == 0 for k in one)
    sizes = pd.Series([(rows[k][1], rows[k][2]) for k in one]).value_counts()
    known = pd.Series([(r[1], r[2]) for r in rows if r[3]]).value_counts()
    least = min(sizes[x] for x in sizes.index if sizes[x] < known[x])
    assert all(sizes[x] == known[x] or abs(sizes[x] - least) <= 1 for x in known.index)
