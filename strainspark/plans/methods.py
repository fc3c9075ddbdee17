"""Queries of neighbour graphs, communities, enrichment, searches and corrections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strainspark.operators import ambient, batches, components, curation, density, enrichment, graphs, hurdle, networks, ordering, search, selection, trees, variable
from strainspark.plans.common import BRANDS, META, brands, counts, metadata, r6, table
from strainspark.plans.inference import CLOSED, EDGE, GENOTYPES, SITES, _edges, _genotypes, _interactions, _sites, _vectors
from strainspark.scratch import Scratch

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Communities


@query(f"""WITH e AS ({EDGE}), w AS (SELECT least(lcell, rcell) AS a, greatest(lcell, rcell) AS b, count(DISTINCT (lig, rec)) AS w FROM e GROUP BY 1, 2),
d AS (SELECT a, b, w FROM w WHERE a <> b UNION ALL SELECT b, a, w FROM w WHERE a <> b UNION ALL SELECT a, b, 2 * w FROM w WHERE a = b),
p AS (SELECT right(a, 1) AS ca, right(b, 1) AS cb, w FROM d), t AS (SELECT sum(w)::DOUBLE AS al FROM p)
SELECT ca AS community, round(sum(CASE WHEN ca = cb THEN w ELSE 0 END) / any_value(al), 6) AS inside, round(sum(w) / any_value(al), 6) AS share,
round(sum(CASE WHEN ca = cb THEN w ELSE 0 END) / any_value(al) - (sum(w) / any_value(al)) ** 2, 6) AS modularity FROM p, t GROUP BY 1""")
def interaction_modularity(spark, d):
    """Modularity of brands by their last digit on the graph of their interactions."""
    e = _interactions(spark, d).select(F.least("lcell", "rcell").alias("a"), F.greatest("lcell", "rcell").alias("b"), "lig", "rec").distinct()
    edges = e.groupBy("a", "b").agg(F.count("*").cast("double").alias("w"))
    brands = table(spark, d, "part").select(F.col("p_brand").alias("node"), F.expr("right(p_brand, 1)").alias("community")).distinct()
    return graphs.modularity(edges, brands).select("community", r6("inside", "inside"), r6("share", "share"), r6("modularity", "modularity"))


@query()
def embedding_clusters(spark, d):
    """Communities of the vectors' weighted graph of ten nearest neighbours; tests compare levels and partitions with enumeration."""
    scratch = Scratch(spark, "clusters")
    near = scratch.keep(graphs.knn_graph(_vectors(spark, d).select("id", "v"), 10, scratch), "near")
    return graphs.louvain(graphs.neighbour_edges(near), scratch)[0]


# Enrichment

RANKED = "SELECT p_partkey AS gene, p_retailprice - 1400 AS stat, row_number() OVER (ORDER BY p_retailprice - 1400 DESC, p_partkey) AS place, count(*) OVER () AS al FROM part"
_SCORE = "CASE WHEN max(up) >= -min(down) THEN max(up) ELSE min(down) END"


@query(f"""WITH g AS MATERIALIZED ({RANKED}), s AS (SELECT DISTINCT p_brand AS name, p_partkey AS gene FROM part),
h AS (SELECT name, place, al, count(*) OVER (PARTITION BY name) AS n, sum(abs(stat)) OVER w / sum(abs(stat)) OVER (PARTITION BY name) AS hit, count(*) OVER w AS k FROM g JOIN s USING (gene) WINDOW w AS (PARTITION BY name ORDER BY place ROWS UNBOUNDED PRECEDING)),
p AS (SELECT name, n, hit - (place - k) / (al - n) AS up, coalesce(lag(hit) OVER (PARTITION BY name ORDER BY place), 0) - (place - k) / (al - n) AS down FROM h),
e AS (SELECT name, n, round({_SCORE}, 9) AS score FROM p GROUP BY 1, 2 HAVING n BETWEEN 5 AND 5000),
m AS (SELECT max(n) AS most FROM e), c AS (SELECT count(*) AS al FROM g),
t AS (SELECT k, 1 + ('0x' || substr(md5('1:' || k || ':' || i), 1, 15))::BIGINT % al AS place, min(i) AS i FROM range(1, 1001) a(k), m, c, range(1, 2 * most + 65) b(i) GROUP BY 1, 2),
w AS MATERIALIZED (SELECT k, place, row_number() OVER (PARTITION BY k ORDER BY i, place) AS draw FROM t), z AS (SELECT DISTINCT n FROM e),
x AS (SELECT w.k, z.n, w.place, abs(stat) AS r, al FROM w JOIN z ON draw <= n JOIN g USING (place)),
y AS (SELECT k, n, al, place, sum(r) OVER v / sum(r) OVER (PARTITION BY k, n) AS hit, count(*) OVER v AS j FROM x WINDOW v AS (PARTITION BY k, n ORDER BY place ROWS UNBOUNDED PRECEDING)),
u AS (SELECT k, n, hit - (place - j) / (al - n) AS up, coalesce(lag(hit) OVER (PARTITION BY k, n ORDER BY place), 0) - (place - j) / (al - n) AS down FROM y), o AS (SELECT k, n, round({_SCORE}, 9) AS d FROM u GROUP BY 1, 2),
p2 AS (SELECT name, n, score, score / CASE WHEN score > 0 THEN avg(d) FILTER (WHERE d >= 0) ELSE abs(avg(d) FILTER (WHERE d <= 0)) END AS nes,
least((1 + count(*) FILTER (WHERE d >= score)) / (1 + count(*) FILTER (WHERE d >= 0)), (1 + count(*) FILTER (WHERE d <= score)) / (1 + count(*) FILTER (WHERE d <= 0))) AS pval FROM e JOIN o USING (n) GROUP BY 1, 2, 3),
q AS (SELECT *, rank() OVER (ORDER BY pval) + count(*) OVER (PARTITION BY pval) - 1 AS k, count(*) OVER () AS tests FROM p2)
SELECT name, n, round(score, 6) AS score, round(nes, 6) AS nes, round(pval, 6) AS pval, round(least(1, min(pval * tests / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING)), 6) AS padj FROM q""")
def set_enrichment(spark, d):
    """Brands as sets of parts ranked by price, against 1,000 shared orders of random parts."""
    part = table(spark, d, "part")
    ranked = part.select(F.col("p_partkey").alias("gene"), (F.col("p_retailprice") - 1400).alias("stat"))
    found = enrichment.set_enrichment(ranked, part.select(F.col("p_brand").alias("name"), F.col("p_partkey").alias("member")), Scratch(spark, "enrichment"), largest=5000)
    return found.select("name", "n", r6("score", "score"), r6("nes", "nes"), r6("pval", "pval"), r6("padj", "padj"))


@query("""WITH x AS (SELECT DISTINCT p_brand AS s1, p_partkey AS m FROM part), y AS (SELECT DISTINCT p_size AS s2, p_partkey AS m FROM part), u AS (SELECT count(*) AS al FROM part),
a AS (SELECT s1, count(*) AS n1 FROM x GROUP BY 1), b AS (SELECT s2, count(*) AS n2 FROM y GROUP BY 1), o AS (SELECT s1, s2, count(*) AS k FROM x JOIN y USING (m) GROUP BY 1, 2),
t AS (SELECT s1, s2, n1, n2, al, coalesce(k, 0) AS k FROM a CROSS JOIN b CROSS JOIN u LEFT JOIN o USING (s1, s2)), e AS (SELECT *, unnest(range(greatest(0, n1 + n2 - al), least(n1, n2) + 1)) AS s FROM t),
l AS (SELECT *, -(lgamma(s + 1) + lgamma(n1 - s + 1) + lgamma(n2 - s + 1) + lgamma(al - n1 - n2 + s + 1)) AS w FROM e), v AS (SELECT *, exp(w - max(w) OVER g) AS e FROM l WINDOW g AS (PARTITION BY s1, s2)),
h AS (SELECT *, max(e) FILTER (WHERE s = k) OVER (PARTITION BY s1, s2) AS here FROM v), p AS (SELECT s1, s2, k, n1, n2, round(least(1, sum(e) FILTER (WHERE e <= here * (1 + 1e-7)) / sum(e)), 9) AS pval FROM h GROUP BY ALL),
r AS (SELECT *, rank() OVER (ORDER BY pval) + count(*) OVER (PARTITION BY pval) - 1 AS i, count(*) OVER () AS tests FROM p), q AS (SELECT *, least(1, min(pval * tests / i) OVER (ORDER BY i DESC ROWS UNBOUNDED PRECEDING)) AS padj FROM r)
SELECT s1, s2, k AS both, n1, n2, round(pval, 6) AS pval, round(padj, 6) AS padj FROM q WHERE k > 0""")
def set_pair_tests(spark, d):
    """Exact tests of every brand's parts against every size's, adjusted over all pairs."""
    part = table(spark, d, "part")
    left, right = part.select(F.col("p_brand").alias("name"), F.col("p_partkey").alias("member")), part.select(F.col("p_size").alias("name"), F.col("p_partkey").alias("member"))
    found = enrichment.set_pair_tests(left, right, part.select("p_partkey").distinct().count(), Scratch(spark, "pairs"))
    return found.select("s1", "s2", "both", "n1", "n2", r6("pval", "pval"), r6("padj", "padj"))


# Clades of customers by region and nation; the class leans on the nation.

DX = "CASE WHEN c_acctbal + 2500 * (c_nationkey % 3) > 7500 THEN 'CD' WHEN c_acctbal + 2500 * (c_nationkey % 3) > 4500 THEN 'UC' ELSE 'HC' END"
CLADES = f"""k AS (SELECT 'c' || c_custkey AS tip, {DX} AS class FROM customer), t AS (SELECT class, count(*) AS al FROM k GROUP BY 1),
cc AS (SELECT x.node, t.class, count(k.tip) AS inside, any_value(t.al) - count(k.tip) AS outside FROM (SELECT node, tip FROM cl WHERE node NOT LIKE 'c%') x CROSS JOIN t LEFT JOIN k ON k.tip = x.tip AND k.class = t.class GROUP BY 1, 2),
pr AS (SELECT p.node, p.class AS x, q.class AS y, p.inside AS a, q.inside AS b, p.outside AS c, q.outside AS d FROM cc p JOIN cc q ON p.node = q.node AND p.class < q.class)"""
#: The conditional odds ratio by bisection: the mean of the first cell under ln odds t is where it was seen.
ODDS = """su AS (SELECT *, range(greatest(0, a - d), least(a + b, a + c) + 1) AS ss FROM pr), we AS (SELECT *, list_transform(ss, lambda s: -(lgamma(s + 1) + lgamma(a + b - s + 1) + lgamma(a + c - s + 1) + lgamma(d - a + s + 1))) AS w0 FROM su),
wf AS (SELECT *, list_transform(w0, lambda w: w - list_max(w0)) AS ws FROM we),
bi AS (SELECT node, x, y, a, ss, ws, -50::DOUBLE AS lo, 50::DOUBLE AS hi, 0 AS step FROM wf UNION ALL
SELECT node, x, y, a, ss, ws, CASE WHEN m < a THEN (lo + hi) / 2 ELSE lo END, CASE WHEN m < a THEN hi ELSE (lo + hi) / 2 END, step + 1 FROM (
SELECT *, list_sum(list_transform(es, lambda e, i: e * ss[i])) / list_sum(es) AS m FROM (SELECT *, list_transform(vs, lambda v: exp(v - list_max(vs))) AS es FROM (SELECT *, list_transform(ws, lambda w, i: w + ss[i] * (lo + hi) / 2) AS vs FROM bi WHERE step < 60)))),
od AS (SELECT node, x, y, CASE WHEN len(ss) = 1 THEN NULL WHEN a = ss[1] THEN 0 WHEN a = ss[-1] THEN 'inf'::DOUBLE ELSE exp((lo + hi) / 2) END AS odds FROM bi WHERE step = 60),
ef AS (SELECT node, max(CASE WHEN odds > 0 AND odds < 'inf'::DOUBLE THEN abs(ln(odds)) END) AS effect FROM od GROUP BY 1)"""


def _dx():
    leaning = F.col("c_acctbal") + 2500 * (F.col("c_nationkey") % 3)
    return F.when(leaning > 7500, "CD").when(leaning > 4500, "UC").otherwise("HC")


def _clades(spark, d, scratch):
    """(edges, ancestry, counts) of the inner nodes of the customers' tree."""
    edges = _edges(spark, d)
    paths = scratch.keep(trees.ancestry(edges), "paths")
    tips = edges.filter("is_tip").select("tree", F.col("node").alias("below"))
    closed = paths.join(tips, ["tree", "below"]).select("tree", "node", F.col("below").alias("tip"))
    inner = closed.join(edges.filter("NOT is_tip").select("tree", "node"), ["tree", "node"], "left_semi")
    classes = table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("tip"), _dx().alias("class"))
    return edges, paths, scratch.keep(trees.clade_counts(inner, classes), "counts")


@query(f"WITH RECURSIVE {CLOSED}, {CLADES}, {ODDS} SELECT node, x, y, round(odds, 6) AS odds FROM od WHERE odds > 0 AND odds < 'inf'::DOUBLE")
def clade_odds(spark, d):
    """Conditional odds ratios of each pair of classes in every region and nation, where they are finite."""
    counts = _clades(spark, d, Scratch(spark, "clades"))[2]
    return selection.clade_odds(counts).filter("odds > 0 AND odds < double('infinity')").select("node", "x", "y", r6("odds", "odds"))


@query(f"WITH RECURSIVE {CLOSED}, {CLADES}, {ODDS} SELECT node, round(effect, 6) AS abs_log_odds FROM ef")
def class_odds(spark, d):
    """The largest logarithm of a class pair's odds in every region and nation."""
    effects = selection.largest_log_odds(selection.clade_odds(_clades(spark, d, Scratch(spark, "clades"))[2]))
    return effects.select("node", r6("effect", "abs_log_odds"))


@query(f"""WITH RECURSIVE {CLOSED}, {CLADES}, {ODDS},
ct AS (SELECT node, max(CASE class WHEN 'CD' THEN inside END) AS i1, max(CASE class WHEN 'HC' THEN inside END) AS i2, max(CASE class WHEN 'UC' THEN inside END) AS i3, max(CASE class WHEN 'CD' THEN inside + outside END) AS t1, max(CASE class WHEN 'HC' THEN inside + outside END) AS t2, max(CASE class WHEN 'UC' THEN inside + outside END) AS t3 FROM cc GROUP BY 1),
ps AS (SELECT node AS outer_node, NULL::VARCHAR AS inner_node, i1 AS x1, i2 AS x2, i3 AS x3, t1 AS c1, t2 AS c2, t3 AS c3 FROM ct UNION ALL
SELECT p.node, q.node, q.i1, q.i2, q.i3, p.i1, p.i2, p.i3 FROM anc JOIN ct p ON p.node = anc.node JOIN ct q ON q.node = anc.below JOIN ef e1 ON e1.node = p.node JOIN ef e2 ON e2.node = q.node WHERE anc.node <> anc.below AND round(e2.effect, 9) >= round(e1.effect, 9)),
en AS (SELECT *, lgamma(c1 + 1) - lgamma(a1 + 1) - lgamma(c1 - a1 + 1) + lgamma(c2 + 1) - lgamma(a2 + 1) - lgamma(c2 - a2 + 1) + lgamma(c3 + 1) - lgamma(a3 + 1) - lgamma(c3 - a3 + 1) AS w FROM (
SELECT *, x1 + x2 + x3 - a1 - a2 AS a3 FROM ps, range(0, c1 + 1) r1(a1), range(0, c2 + 1) r2(a2)) WHERE a3 BETWEEN 0 AND c3),
wx AS (SELECT *, exp(w - max(w) OVER (PARTITION BY outer_node, inner_node)) AS e FROM en), hx AS (SELECT *, max(e) FILTER (WHERE a1 = x1 AND a2 = x2) OVER (PARTITION BY outer_node, inner_node) AS here FROM wx),
px AS (SELECT outer_node, inner_node, round(least(1, sum(e) FILTER (WHERE e <= here * (1 + 1e-7)) / sum(e)), 12) AS pval FROM hx GROUP BY 1, 2),
r AS (SELECT outer_node AS node, pval, rank() OVER (ORDER BY pval) + count(*) OVER (PARTITION BY pval) - 1 AS i, count(*) OVER () AS tests FROM px WHERE inner_node IS NULL),
pa AS (SELECT node, least(1, min(pval * tests / i) OVER (ORDER BY i DESC ROWS UNBOUNDED PRECEDING)) AS padj FROM r),
sg AS (SELECT node FROM pa JOIN ef USING (node) WHERE padj < 0.05 AND effect IS NOT NULL),
el AS (SELECT node FROM sg WHERE NOT EXISTS (SELECT 1 FROM px WHERE outer_node = sg.node AND inner_node IN (SELECT node FROM sg) AND pval < 0.05)),
us AS (SELECT node FROM el WHERE NOT EXISTS (SELECT 1 FROM anc WHERE anc.below = el.node AND anc.node <> el.node AND anc.node IN (SELECT node FROM el))),
fr AS (SELECT node FROM (SELECT node, count(*) AS size FROM cl GROUP BY 1) z WHERE size > 10 AND node NOT LIKE 'c%' AND EXISTS (SELECT 1 FROM sg) AND NOT EXISTS (SELECT 1 FROM anc WHERE (anc.node = z.node AND anc.below IN (SELECT node FROM us)) OR (anc.below = z.node AND anc.node IN (SELECT node FROM us))))
SELECT node, true AS enriched FROM us UNION ALL SELECT node, false FROM fr WHERE NOT EXISTS (SELECT 1 FROM anc WHERE anc.below = fr.node AND anc.node <> fr.node AND anc.node IN (SELECT node FROM fr))
UNION ALL SELECT 'root', false WHERE NOT EXISTS (SELECT 1 FROM sg)""")
def selected_clades(spark, d):
    """Regions and nations whose classes are enriched, told from those around and inside them, and the largest others."""
    scratch = Scratch(spark, "selection")
    edges, paths, counts = _clades(spark, d, scratch)
    arrays = counts.groupBy("tree", "node").agg(F.transform(F.array_sort(F.collect_list(F.struct("class", "inside", "outside"))), lambda x: F.struct(x["inside"].alias("i"), x["outside"].alias("o"))).alias("c"))
    arrays = arrays.select("tree", "node", F.transform("c", lambda x: x["i"]).alias("counts"), F.transform("c", lambda x: x["i"] + x["o"]).alias("whole"))
    effects = selection.largest_log_odds(selection.clade_odds(counts)).withColumn("effect", F.round("effect", 9))
    tested = scratch.keep(selection.with_exact_rows(arrays.join(effects, ["tree", "node"]), "whole", "counts").withColumn("pval", F.round("pval", 12)), "tested")
    stats = scratch.keep(ordering.adjusted_over_all(tested, "pval", scratch), "stats")
    # Kept, so that the tests aren't run again for each of their uses.
    nested = scratch.keep(selection.nested_contrasts(paths, selection.significant_nodes(stats)), "nested")
    return selection.selected_clades(edges, paths, stats, contrasts=nested).select("node", "enriched")


# Search over strain estimates


@query(f"""WITH c AS ({SITES}), g AS ({GENOTYPES}), s AS (SELECT strain, row_number() OVER (ORDER BY strain) - 1 AS k, count(*) OVER () AS al FROM (SELECT DISTINCT strain FROM g)),
z AS (SELECT e.estimate, sample, strain, CASE e.estimate WHEN 0 THEN 1.0 / al WHEN 1 THEN (k + 1) / (al * (al + 1) / 2) ELSE CASE WHEN k = sample % al THEN 0.9 ELSE 0.1 / (al - 1) END END::DOUBLE AS z FROM s, (SELECT DISTINCT sample FROM c), (VALUES (0), (1), (2)) e(estimate)),
m AS (SELECT estimate, sample, pos, allele, sum(z) AS zp FROM z JOIN g USING (strain) GROUP BY 1, 2, 3, 4), x AS (SELECT e.estimate, c.*, coalesce(zp, 0) AS zp FROM c CROSS JOIN (VALUES (0), (1), (2)) e(estimate) LEFT JOIN m ON m.estimate = e.estimate AND m.sample = c.sample AND m.pos = c.pos AND m.allele = c.allele),
t AS (SELECT estimate, sample, pos, sum(n * ln(greatest(1e-10, 0.99 * zp + 0.0025))) AS model, 1.25 * ln(0.25) * sum(n) AS low FROM x GROUP BY 1, 2, 3)
SELECT estimate::BIGINT AS estimate, round(sum(greatest(model, low)), 3) AS loglik, count(*) FILTER (WHERE model < low) AS masked FROM t GROUP BY 1""")
def penalised_likelihood(spark, d):
    """Three mixtures of the five genotypes, even, graded and led by one strain, with masked sites at 1.25 times equal shares."""
    genotypes = _genotypes(spark, d)
    strains = genotypes.select("strain").distinct().withColumn("k", F.row_number().over(Window.orderBy("strain")) - 1)  # five regions
    index = F.expr(f"locate(allele, '{search.LETTERS}')") - 1
    ordered = lambda value: F.transform(F.array_sort(F.collect_list(F.struct("k", value.alias("v")))), lambda x: x["v"])
    g = genotypes.join(strains, "strain").groupBy("pos").agg(ordered(index).alias("g"))
    sites = search.site_counts(_sites(spark, d))
    n = F.size("g")
    one = g.select(n.alias("n")).limit(1)
    k = F.sequence(F.lit(0), F.col("n") - 1)
    shares = {0: F.transform(k, lambda i: 1.0 / F.col("n")), 1: F.transform(k, lambda i: (i + 1) / (F.col("n") * (F.col("n") + 1) / 2)),
              2: F.transform(k, lambda i: F.when(i == F.pmod("sample", "n"), 0.9).otherwise(0.1 / (F.col("n") - 1)))}
    samples = sites.select("sample").distinct().crossJoin(F.broadcast(one))
    estimates = F.explode(F.array(*[F.struct(F.lit(e).cast("long").alias("estimate"), F.transform(z, lambda x: x.cast("double")).alias("z")) for e, z in shares.items()]))
    z = samples.select("sample", estimates.alias("e")).select("sample", "e.*")
    held = g.select("pos", "g", F.explode(F.array(*[F.lit(e).cast("long") for e in shares])).alias("estimate"))
    return search.likelihoods(sites, held, z, 1.25).select("estimate", F.round("loglik", 3).alias("loglik"), "masked")


@query()
def strain_search(spark, d):
    """Three strains of the suppliers' pileup: the two likeliest of eight starts, refined; tests recover planted mixtures."""
    found = search.Search(search.site_counts(_sites(spark, d)), 3, Scratch(spark, "search"))
    found.shallow(8, 3, 2)
    found.deep(6)
    return found.table()


# Batches and variability


@query(f"""WITH RECURSIVE r AS (SELECT sample, gene, value::DOUBLE AS value, cohort AS batch FROM ({BRANDS}) JOIN ({META}) USING (sample)), s AS (SELECT gene, batch, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM r GROUP BY 1, 2),
c AS (SELECT *, sum(n * m) OVER w / sum(n) OVER w AS centre, sqrt(sum(n * v) OVER w / sum(n) OVER w) AS spread FROM s WINDOW w AS (PARTITION BY gene)),
e AS (SELECT gene, batch, n, centre, spread, (m - centre) / spread AS g, CASE WHEN n > 1 THEN v * n / (n - 1) / spread ** 2 END AS d FROM c WHERE spread > 1e-9),
p AS (SELECT batch, avg(g) AS gbar, var_samp(g) AS t2, (2 * var_samp(d) + avg(d) ** 2) / nullif(var_samp(d), 0) AS a, (avg(d) * var_samp(d) + avg(d) ** 3) / nullif(var_samp(d), 0) AS b FROM e WHERE n > 1 GROUP BY 1),
t AS (SELECT gene, batch, n, centre, spread, g, d, gbar, t2, a, b, g AS gs, d AS ds, 0 AS k FROM e JOIN p USING (batch) WHERE n > 1 AND t2 > 0 UNION ALL
SELECT gene, batch, n, centre, spread, g, d, gbar, t2, a, b, gn, (0.5 * ((n - 1) * d + n * (g - gn) ** 2) + b) / (n / 2 + a - 1), k + 1 FROM (SELECT *, (t2 * n * g + ds * gbar) / (t2 * n + ds) AS gn FROM t WHERE k < 60))
SELECT sample, r.gene, round(coalesce(((value - centre) / spread - gs) / sqrt(ds) * spread + centre, value), 5) AS value FROM r LEFT JOIN (SELECT * FROM t WHERE k = 60) t ON t.gene = r.gene AND t.batch = r.batch""")
def combat_adjusted(spark, d):
    """Brands' counts without the cohorts' shrunken location and scale."""
    adjusted = batches.combat_adjusted(brands(spark, d), metadata(spark, d).select("sample", F.col("cohort").alias("batch")))
    return adjusted.select("sample", "gene", F.round("value", 5).alias("value"))


@query()
def neighbour_corrected(spark, d):
    """Vectors of labels 0 to 2, as batches, each moved onto those before it by mutual nearest neighbours; tests compare with numpy."""
    v = _vectors(spark, d).select("id", F.col("label").alias("batch"), "v")
    return batches.neighbour_corrected(v, [0, 1, 2], Scratch(spark, "batches"), k=10).select("id", "batch", F.transform("v", lambda x: F.round(x, 6)).alias("v"))


@query()
def variable_genes_loess(spark, d):
    """Parts whose variability over suppliers stands out from the local regression on their mean; tests compare with direct local fits."""
    m = counts(spark, d).groupBy("gene").agg(F.avg("value").cast("double").alias("mean"), F.var_samp("value").cast("double").alias("variance"))
    found = variable.variable_genes(m, Scratch(spark, "variable"), 200)
    return found.select("gene", "bin", r6("residual", "residual"), "rank")


@query()
def random_pca(spark, d):
    """Scores of suppliers on five components of their brands, by a random range finder; tests compare with a full decomposition."""
    scores, _, _ = components.random_pca(brands(spark, d), 5, Scratch(spark, "pca"), passes=12)
    return scores.select("sample", F.transform("y", lambda x: F.round(x, 3)).alias("y"))


# Networks


@query()
def network_pvalues(spark, d):
    """Brands' interactions against 20 degree-keeping shuffles; tests compare with the exact null of a small network."""
    found = networks.network_pvalues(_interactions(spark, d), Scratch(spark, "network"), 20, turns=8)
    return found.select("a", "b", "weight", r6("pval", "pval"))


@query()
def merged_clusters(spark, d):
    """Labels of the vectors as clusters, their components' positive parts as genes; tests compare with pairs one at a time."""
    v = _vectors(spark, d).filter("label IS NOT NULL")
    cells = v.select(F.col("id").alias("cell"), F.col("label").alias("ident"), (F.col("id") % 7).alias("batch"), "v")
    values = v.select(F.col("id").alias("cell"), F.posexplode("v").alias("gene", "value")).filter("value > 0")
    return networks.merged_clusters(cells, values, Scratch(spark, "merge"))[0]


# Two-part models and contamination


@query(f"""WITH c AS (SELECT p_partkey AS cell, p_brand AS ident, p_size % 4 AS sample FROM part), v AS (SELECT l_partkey AS cell, l_suppkey AS gene, sum(l_quantity)::DOUBLE AS value FROM lineitem GROUP BY 1, 2),
n AS (SELECT ident, sample, count(*) AS n FROM c GROUP BY 1, 2), w AS (SELECT sample, sum(n) AS al FROM n GROUP BY 1), h AS (SELECT ident, sample, al, sum(n) OVER (PARTITION BY ident) AS size, n / sum(n) OVER (PARTITION BY ident) AS share FROM n JOIN w USING (sample)),
b AS (SELECT ident, sample, gene, sum(value) AS s FROM v JOIN c USING (cell) GROUP BY 1, 2, 3), t AS (SELECT sample, gene, sum(s) AS t FROM b GROUP BY 1, 2),
r AS (SELECT ident, gene, sum(share * t / al) AS r FROM h JOIN t USING (sample) GROUP BY 1, 2), o AS (SELECT ident, gene, sum(s) / max(size) AS mean, sum(share * s / al) AS o FROM b JOIN h USING (ident, sample) GROUP BY 1, 2)
SELECT ident, gene, round(coalesce(mean, 0), 6) AS mean, round(greatest(r - coalesce(o, 0), 0), 6) AS reference FROM r LEFT JOIN o USING (ident, gene)""")
def reference_means(spark, d):
    """Suppliers' means over a brand's parts, and over the other parts as the brand's samples have them."""
    found = ambient.reference_means(*_ambient(spark, d))
    return found.select("ident", "gene", r6("mean", "mean"), r6("reference", "reference"))


def _ambient(spark, d):
    cells = table(spark, d, "part").select(F.col("p_partkey").alias("cell"), F.col("p_brand").alias("ident"), (F.col("p_size") % 4).alias("sample"))
    values = counts(spark, d).select(F.col("gene").alias("cell"), F.col("sample").alias("gene"), "value")
    return values, cells


@query()
def contaminants(spark, d):
    """Suppliers whose mean in a brand is near the line of its lower edge; tests compare with a direct robust fit."""
    found = ambient.contaminants(ambient.reference_means(*_ambient(spark, d)), top=5)
    return found.select("ident", "gene", r6("residual", "residual"), "contaminant")


@query()
def covariate_tests(spark, d):
    """Two-part tests of parts by class, with a covariate of five values; tests compare with dense fits."""
    samples = metadata(spark, d).select("sample", F.when(F.col("dx") == "IBD", 1).otherwise(0).alias("dx"), F.col("cohort"))
    found = hurdle.covariate_tests(counts(spark, d), samples, ["dx", "cohort"], ["dx"], Scratch(spark, "hurdle"))
    return found.select("gene", "detected", *[r6(c, c) for c in ("coef_d", "p_d", "coef_c", "p_c", "p_h", "padj_d", "padj_c", "padj_h")])


@query()
def density_downsampled(spark, d):
    """Vectors of each label thinned to 30 by how crowded their places are; tests compare with a direct computation."""
    v = _vectors(spark, d).filter("label IS NOT NULL").select(F.col("id").alias("cell"), F.col("label").alias("ident"), (F.col("id") % 17).alias("depth"), "v")
    quotas = v.select("ident").distinct().withColumn("quota", F.lit(30))
    return density.density_downsampled(v, quotas, Scratch(spark, "density")).select("cell", "ident", "crowd", r6("rate", "rate"), "kept")


# Cells


@query("""WITH k AS (SELECT c_custkey, c_mktsegment || '/' || c_nationkey AS g FROM customer WHERE c_acctbal > 0), s AS (SELECT g, count(*) AS n FROM k GROUP BY 1),
o AS (SELECT g, n, row_number() OVER (ORDER BY n, g) AS i, coalesce(sum(n) OVER (ORDER BY n, g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, count(*) OVER () AS al FROM s),
h AS (SELECT g, n, i, floor(greatest(300 - before, 0) / (al - i + 1)) AS share FROM o), f AS (SELECT *, min(CASE WHEN n > share THEN i END) OVER () AS first_i FROM h), q AS (SELECT g, CASE WHEN first_i IS NULL OR i < first_i THEN n ELSE least(n, (SELECT share FROM f x WHERE x.i = x.first_i)) END AS quota FROM f)
SELECT g, least(count(*), any_value(quota))::BIGINT AS kept FROM k JOIN q USING (g) GROUP BY 1 HAVING least(count(*), any_value(quota)) > 0""")
def selected_cells(spark, d):
    """How many customers of each segment and nation are kept of 300, those without a positive balance left out; tests look at which."""
    cells = table(spark, d, "customer").withColumn("balance", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")))
    kept = curation.selected_cells(cells, ["balance"], "c_mktsegment", "c_nationkey", "c_custkey", 300)
    return kept.groupBy(F.concat_ws("/", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("g")).agg(F.count("*").alias("kept"))
