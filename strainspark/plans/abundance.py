"""Queries of matrices, filters, joins, rankings and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from strainspark.functions.numeric import ratio
from strainspark.operators import markers, matrix, ranking, relations
from strainspark.plans.common import BRANDS, COUNTS, META, brands, counts, metadata, r6, table

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""
WITH c AS ({COUNTS}), s AS (SELECT sample FROM c GROUP BY 1 HAVING sum(value) >= 1000), f AS (SELECT c.* FROM c SEMI JOIN s USING (sample)),
g AS (SELECT gene FROM f WHERE value > 0 GROUP BY 1 HAVING count(DISTINCT sample) >= 2), k AS (SELECT f.* FROM f SEMI JOIN g USING (gene)),
n AS (SELECT *, log2(10000 * value / sum(value) OVER (PARTITION BY sample) + 1) AS l FROM k), m AS ({META}), z AS (SELECT subject, count(*) AS n FROM m GROUP BY 1)
SELECT subject, gene, round(sum(l) / any_value(z.n), 6) AS mean_log FROM n JOIN m USING (sample) JOIN z USING (subject) GROUP BY 1, 2""")
def strain_abundance_tp10k(spark, d):
    """Flagship: filtered counts, normalised to 1e4 a sample, log2, mean by subject with zeros."""
    kept = matrix.normalised(matrix.keep_in_turn(counts(spark, d), 1000, 2, repeated=False))
    groups = metadata(spark, d).select("sample", F.col("subject").alias("grp"))
    means = matrix.group_means(kept, groups, "log_tpk")
    return means.select(F.col("grp").alias("subject"), "gene", r6("mean", "mean_log"))


@query(f"WITH c AS ({COUNTS}) SELECT sample, gene, round(10000 * value / sum(value) OVER (PARTITION BY sample), 6) AS tpk, round(log2(1 + 10000 * value / sum(value) OVER (PARTITION BY sample)), 6) AS log_tpk FROM c")
def tp10k_log2(spark, d):
    return matrix.normalised(counts(spark, d)).select("sample", "gene", r6("tpk", "tpk"), r6("log_tpk", "log_tpk"))


@query(f"""WITH c AS ({COUNTS}) SELECT * FROM c SEMI JOIN (SELECT sample FROM c GROUP BY 1 HAVING sum(value) >= 12000) s USING (sample)
SEMI JOIN (SELECT gene FROM c WHERE value > 0 GROUP BY 1 HAVING count(DISTINCT sample) >= 3) g USING (gene)""")
def sample_gene_filter(spark, d):
    return matrix.keep_both(counts(spark, d), 12000, 3, repeated=False).select("sample", "gene", "value")


@query(f"""WITH c AS ({COUNTS}), f AS (SELECT * FROM c SEMI JOIN (SELECT sample FROM c GROUP BY 1 HAVING sum(value) >= 12000) s USING (sample))
SELECT * FROM f SEMI JOIN (SELECT gene FROM f WHERE value > 0 GROUP BY 1 HAVING count(DISTINCT sample) >= 3) g USING (gene)""")
def sample_then_gene_filter(spark, d):
    return matrix.keep_in_turn(counts(spark, d), 12000, 3, repeated=False).select("sample", "gene", "value")


@query(f"WITH c AS ({COUNTS}), m AS ({META}), z AS (SELECT subject, count(*) AS n FROM m GROUP BY 1) SELECT subject, gene, sum(value) AS total, round(sum(value) / any_value(n), 6) AS mean FROM c JOIN m USING (sample) JOIN z USING (subject) GROUP BY 1, 2")
def subject_mean_incl_zeros(spark, d):
    out = matrix.group_means(counts(spark, d), metadata(spark, d).select("sample", F.col("subject").alias("grp")))
    return out.select(F.col("grp").alias("subject"), "gene", "total", r6("mean", "mean"))


@query(f"""WITH b AS ({BRANDS}), m AS ({META}), u AS (SELECT s.sample, g.gene FROM (SELECT DISTINCT sample FROM b) s CROSS JOIN (SELECT DISTINCT gene FROM b) g)
SELECT cohort, gene, round(avg(coalesce(value, 0)), 6) AS mean, round(sum(coalesce(value, 0)), 6) AS sum, round(stddev_samp(coalesce(value, 0)), 6) AS sd, round(median(coalesce(value, 0)), 6) AS median
FROM u LEFT JOIN b USING (sample, gene) JOIN m USING (sample) GROUP BY 1, 2""")
def group_aggregate_dense(spark, d):
    out = matrix.aggregated(brands(spark, d), metadata(spark, d).select("sample", F.col("cohort").alias("grp")))
    return out.select(F.col("grp").alias("cohort"), "gene", r6("mean", "mean"), r6("sum", "sum"), r6("sd", "sd"), r6("median", "median"))


@query(f"WITH c AS ({COUNTS}) SELECT gene, round(sum(value) / count(*) FILTER (WHERE value <> 0), 6) AS mean FROM c GROUP BY 1")
def nonzero_gene_means(spark, d):
    return matrix.nonzero_means(counts(spark, d), "gene").select("gene", r6("mean", "mean"))


@query("SELECT l_suppkey AS sample, count(DISTINCT l_partkey) AS genes, count(DISTINCT CASE WHEN l_quantity > 40 THEN l_partkey END) AS deep FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) > 100")
def genes_over_n_samples(spark, d):
    x = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("sample")).agg(F.countDistinct("l_partkey").alias("genes"), F.countDistinct(F.when(F.col("l_quantity") > 40, F.col("l_partkey"))).alias("deep"))
    return x.filter("genes > 100")


@query("SELECT l_partkey AS target, count(*) AS hits FROM lineitem WHERE l_quantity > 45 AND l_discount < 0.05 GROUP BY 1")
def hit_counts(spark, d):
    """Hits above an identity cut and below an e-value cut, both strict, by target."""
    return table(spark, d, "lineitem").filter("l_quantity > 45 AND l_discount < 0.05").groupBy(F.col("l_partkey").alias("target")).agg(F.count("*").alias("hits"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 30 AND l_quantity >= 0.9 * p_size")
def blast_hq_filter(spark, d):
    """Identity and covered length, both not strict; the length is the query's."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.filter("l_quantity >= 30 AND l_quantity >= 0.9D * p_size").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("""WITH panel AS (SELECT DISTINCT o_custkey AS k, l_partkey AS m FROM orders JOIN lineitem ON o_orderkey = l_orderkey), kept AS (SELECT p_partkey AS m FROM part WHERE p_size <= 45)
SELECT k AS genome, count(*) AS n FROM panel LEFT JOIN kept USING (m) GROUP BY 1 HAVING count(*) = count(kept.m)""")
def panel_all_members_survive(spark, d):
    panel = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("genome"), F.col("l_partkey").alias("m"))
    return relations.all_members_in(panel, "genome", "m", table(spark, d, "part").filter("p_size <= 45").select(F.col("p_partkey").alias("m")))


@query("""WITH b AS (SELECT DISTINCT l_suppkey AS genome, l_returnflag AS slot, l_linestatus || l_linenumber AS allele FROM lineitem)
SELECT a.genome, a.allele AS A, n.allele AS N, r.allele AS R FROM b a JOIN b n ON a.genome = n.genome AND n.slot = 'N' JOIN b r ON a.genome = r.genome AND r.slot = 'R' WHERE a.slot = 'A'""")
def allele_combinations(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("genome"), F.col("l_returnflag").alias("slot"), F.concat("l_linestatus", F.col("l_linenumber").cast("string")).alias("allele"))
    return relations.combinations(rows, "genome", "slot", "allele", ["A", "N", "R"])


@query("SELECT o_orderkey, o_custkey, c_name, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def metadata_lookup(spark, d):
    customer = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", F.col("c_nationkey").alias("n_nationkey"))
    nation = table(spark, d, "nation").select("n_nationkey", "n_name")
    out = relations.looked_up(table(spark, d, "orders"), customer, ["o_custkey"], [F.col("c_name")])
    return relations.looked_up(out, nation, ["n_nationkey"], [F.col("n_name")]).select("o_orderkey", "o_custkey", "c_name", "n_name")


@query("""SELECT coalesce(a.k, b.k) AS part, a.n AS returned, b.n AS open FROM (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40 GROUP BY 1) a
FULL JOIN (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' AND l_quantity > 45 GROUP BY 1) b ON a.k = b.k""")
def full_outer_merge(spark, d):
    x = table(spark, d, "lineitem")
    a = x.filter("l_returnflag = 'R' AND l_quantity > 40").groupBy(F.col("l_partkey").alias("part")).agg(F.count("*").alias("returned"))
    b = x.filter("l_linestatus = 'O' AND l_quantity > 45").groupBy(F.col("l_partkey").alias("part")).agg(F.count("*").alias("open"))
    return a.join(b, "part", "full")


@query("SELECT p_partkey, p_brand, 'semi' AS kind FROM part SEMI JOIN (SELECT l_partkey AS p_partkey FROM lineitem WHERE l_quantity = 50) x USING (p_partkey) UNION ALL SELECT p_partkey, p_brand, 'anti' FROM part ANTI JOIN (SELECT l_partkey AS p_partkey FROM lineitem WHERE l_quantity = 50) x USING (p_partkey)")
def semi_anti_sets(spark, d):
    part, hit = table(spark, d, "part").select("p_partkey", "p_brand"), table(spark, d, "lineitem").filter("l_quantity = 50").select(F.col("l_partkey").alias("p_partkey"))
    return part.join(hit, "p_partkey", "left_semi").withColumn("kind", F.lit("semi")).union(part.join(hit, "p_partkey", "left_anti").withColumn("kind", F.lit("anti")))


@query("""WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 48), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_discount > 0.09)
SELECT k, 'both' AS kind FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT k, 'first' FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT k, 'second' FROM (SELECT k FROM b EXCEPT SELECT k FROM a)""")
def set_algebra(spark, d):
    x = table(spark, d, "lineitem")
    a, b = x.filter("l_quantity > 48").select(F.col("l_partkey").alias("k")), x.filter("l_discount > 0.09").select(F.col("l_partkey").alias("k"))
    return a.intersect(b).withColumn("kind", F.lit("both")).union(a.subtract(b).withColumn("kind", F.lit("first"))).union(b.subtract(a).withColumn("kind", F.lit("second")))


@query(f"WITH b AS ({BRANDS}), m AS ({META}) SELECT sample, gene, value, NULL::VARCHAR AS dx FROM b UNION ALL SELECT sample, NULL, NULL, dx FROM m")
def union_aligned(spark, d):
    return matrix.aligned_union([brands(spark, d), metadata(spark, d).select("sample", "dx")]).select("sample", "gene", "value", "dx")


@query("""SELECT sample, gene, sum(value) AS value FROM (SELECT l_suppkey AS sample, l_returnflag AS gene, l_quantity AS value FROM lineitem WHERE l_linenumber <= 3
UNION ALL SELECT l_suppkey, l_linestatus, l_quantity FROM lineitem WHERE l_linenumber > 2) GROUP BY 1, 2""")
def matrix_sum(spark, d):
    x = table(spark, d, "lineitem")
    return matrix.matrix_sum([matrix.count_matrix(x.filter("l_linenumber <= 3"), "l_suppkey", "l_returnflag", "l_quantity"), matrix.count_matrix(x.filter("l_linenumber > 2"), "l_suppkey", "l_linestatus", "l_quantity")])


@query(f"WITH c AS ({BRANDS}), p AS (SELECT sample, value / sum(value) OVER (PARTITION BY sample) AS p FROM c WHERE value > 0) SELECT sample, round(-sum(p * ln(p)), 6) AS entropy FROM p GROUP BY 1")
def shannon_entropy(spark, d):
    return matrix.entropy(brands(spark, d)).select("sample", r6("entropy", "entropy"))


@query("""WITH x AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS v FROM customer), f AS (SELECT c_custkey, coalesce(v, (SELECT avg(v) FROM x)) AS v FROM x)
SELECT c_custkey, round(v, 6) AS v, round((v - (SELECT avg(v) FROM f)) / (SELECT stddev_samp(v) FROM f), 6) + 0.0::DOUBLE AS v_z FROM f""")
def impute_zscore(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("v"))
    return matrix.imputed(rows, "v").select("c_custkey", r6("v", "v"), (F.round("v_z", 6) + F.lit(0.0)).alias("v_z"))


@query("""WITH e AS (SELECT quantile_cont(c_acctbal, 0.05) AS a, quantile_cont(c_acctbal, 0.95) AS b FROM customer)
SELECT c_custkey, round((least(greatest(c_acctbal, a), b) - a) / (b - a), 6) AS scaled FROM customer, e""")
def rescale_qtrim(spark, d):
    return matrix.clamped_rescaled(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", 0.05, 0.95).select("c_custkey", r6("c_acctbal_scaled", "scaled"))


P = "(l_discount * 10 + l_tax + 0.001 * l_linenumber) / 2"


@query(f"""WITH t AS (SELECT l_partkey, l_suppkey AS g, min({P}) AS p FROM lineitem GROUP BY 1, 2), r AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY p) + count(*) OVER (PARTITION BY g, p) - 1 AS k, count(*) OVER (PARTITION BY g) AS n FROM t)
SELECT l_partkey, g, round(least(1, min(p * n / k) OVER (PARTITION BY g ORDER BY k DESC ROWS UNBOUNDED PRECEDING)), 6) AS padj FROM r""")
def bh_fdr_by_group(spark, d):
    t = table(spark, d, "lineitem").groupBy("l_partkey", F.col("l_suppkey").alias("g")).agg(F.min(F.expr(P.replace("0.001", "0.001D"))).alias("p"))
    return ranking.bh_adjusted(t, "p", ["g"]).select("l_partkey", "g", r6("padj", "padj"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1")
def top1_per_group(spark, d):
    return ranking.first_of(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")])


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 3")
def top_n_per_contrast(spark, d):
    return ranking.first_of(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)


@query("SELECT l_orderkey, l_linenumber, l_discount FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount, l_linenumber) AS k FROM lineitem) WHERE k = 1 OR l_discount < 0.02")
def sig_or_best(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount")
    return ranking.significant_or_best(rows, ["l_orderkey"], "l_discount", [F.asc("l_discount"), F.asc("l_linenumber")], 0.02)


@query("SELECT p_brand, p_type, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_retailprice DESC, p_partkey) AS k FROM part) WHERE k = 1")
def dedupe_first_by_annotation(spark, d):
    return ranking.first_of(table(spark, d, "part").select("p_brand", "p_type", "p_partkey", "p_retailprice"), ["p_brand", "p_type"], [F.desc("p_retailprice"), F.asc("p_partkey")]).drop("p_retailprice")


@query("""SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) > 1 OR row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) > 1 AS redundant FROM customer""")
def duplicate_flags(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    return ranking.repeats_in_order(rows, ["c_nationkey", "c_mktsegment"], [F.desc("c_acctbal"), F.asc("c_custkey")]).select("c_custkey", "redundant")


@query(f"WITH b AS ({BRANDS}) SELECT sample, gene, rank() OVER (PARTITION BY gene ORDER BY value) + (count(*) OVER (PARTITION BY gene, value) - 1) / 2 AS rank FROM b")
def avg_rank(spark, d):
    return brands(spark, d).select("sample", "gene", ranking.average_rank("value", "gene").alias("rank"))


@query(f"""WITH c AS ({COUNTS}) SELECT sample, gene, rank() OVER (PARTITION BY gene ORDER BY value) + (count(*) OVER (PARTITION BY gene, value) - 1) / 2 + (SELECT count(*) FROM supplier) - count(*) OVER (PARTITION BY gene) AS rank FROM c WHERE value > 0""")
def sparse_rank_offset(spark, d):
    n = table(spark, d, "supplier").agg(F.count("*").alias("ns"))
    return ranking.sparse_ranks(counts(spark, d).crossJoin(F.broadcast(n)), F.col("ns")).select("sample", "gene", "rank")


@query("SELECT c_custkey, c_mktsegment || '_' || row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS name FROM customer")
def unique_names(spark, d):
    return ranking.unique_suffix(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", [F.asc("c_custkey")]).select("c_custkey", F.col("c_mktsegment_unique").alias("name"))


@query("""WITH RECURSIVE s AS (SELECT c_nationkey AS g, count(*) AS n FROM customer GROUP BY 1), o AS (SELECT g, n, row_number() OVER (ORDER BY n, g) AS k, count(*) OVER () AS m, coalesce(sum(n) OVER (ORDER BY n, g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM s),
x AS (SELECT *, floor(greatest(900 - b, 0) / (m - k + 1)) AS share FROM o), y AS (SELECT *, min(CASE WHEN n > share THEN k END) OVER () AS first_cut FROM x)
SELECT g, n, CASE WHEN first_cut IS NULL OR k < first_cut THEN n ELSE least(n, (SELECT share FROM x WHERE k = first_cut)) END::BIGINT AS quota FROM y""")
def downsample_quota(spark, d):
    sizes = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("g")).agg(F.count("*").alias("n"))
    return ranking.quotas(sizes, "g", "n", F.lit(900)).select("g", "n", "quota")


@query(f"WITH m AS ({META}) SELECT sample, round((cov - avg(cov) OVER (PARTITION BY cohort)) / stddev_samp(cov) OVER (PARTITION BY cohort), 6) AS cov_z FROM m")
def zscore_by_subject(spark, d):
    return ranking.z_scores(metadata(spark, d), ["cov"], ["cohort"]).select("sample", r6("cov_z", "cov_z"))


@query("""WITH s AS (SELECT DISTINCT c_mktsegment || c_nationkey AS term, dense_rank() OVER (ORDER BY c_mktsegment || c_nationkey) AS ord, p_brand AS member FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey),
z AS (SELECT term, ord, count(*) AS n FROM s GROUP BY 1, 2), b AS (SELECT DISTINCT l.term FROM (SELECT l.term, e.ord, count(*) AS shared FROM s l JOIN s e ON l.member = e.member AND e.ord < l.ord GROUP BY 1, 2) l JOIN z USING (term) WHERE shared > 0.8 * n)
SELECT term, n FROM z ANTI JOIN b USING (term)""")
def overlap_pruned_sets(spark, d):
    from pyspark.sql import Window

    rows = (table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey")).join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
            .join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.concat("c_mktsegment", F.col("c_nationkey").cast("string")).alias("term"), F.col("p_brand").alias("member")).distinct())
    order = rows.select("term").distinct().withColumn("ord", F.row_number().over(Window.orderBy("term")))
    return ranking.pruned_overlaps(rows.join(order, "term"), 0.8).select("term", "n")


@query("""WITH p AS (SELECT DISTINCT c_nationkey AS k, c_mktsegment || (c_custkey % 7) AS v FROM customer), s AS (SELECT DISTINCT c_mktsegment || (c_custkey % 7) AS v FROM customer WHERE c_acctbal > 9500)
SELECT k AS key, count(*) AS n, count(s.v) AS n_selected, count(*) = count(s.v) AS inside, count(s.v) = 0 AS apart FROM p LEFT JOIN s USING (v) GROUP BY 1""")
def key_hierarchy_select(spark, d):
    value = F.concat("c_mktsegment", (F.col("c_custkey") % 7).cast("string")).alias("value")
    x = table(spark, d, "customer")
    return relations.key_hierarchy(x.select(F.col("c_nationkey").alias("key"), value), x.filter("c_acctbal > 9500").select(value))


@query("""WITH s AS (SELECT o_custkey AS subject, o_orderkey AS id, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS t, o_totalprice AS v FROM orders)
SELECT a.subject, a.t AS t0, b.t AS tf, round(b.v - a.v, 4) AS delta FROM s a JOIN s b ON a.subject = b.subject AND b.t > a.t + 1500""")
def longitudinal_pairs(spark, d):
    s = table(spark, d, "orders").select(F.col("o_custkey").alias("subject"), F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date")).cast("long").alias("t"), F.col("o_totalprice").alias("v"))
    return relations.pairs_in_time(s, ["subject"], "t", 1500, ["v"]).select("subject", "t0", "tf", F.round(F.col("vf") - F.col("v0"), 4).alias("delta"))


@query("""WITH p AS (SELECT c_nationkey AS contig, c_custkey AS id, (c_acctbal + 1000)::BIGINT AS x, (c_acctbal + 1000)::BIGINT + 99 AS y FROM customer), r AS (SELECT s_nationkey AS contig, s_suppkey AS gene, (s_acctbal + 1000)::BIGINT AS lo, (s_acctbal + 1250)::BIGINT AS hi FROM supplier)
SELECT DISTINCT id, gene FROM p JOIN r USING (contig) WHERE x BETWEEN lo AND hi OR y BETWEEN lo AND hi""")
def position_in_gene(spark, d):
    """Reads whose first or last base lies in a gene, as an equi-join on bins."""
    reads = table(spark, d, "customer").select(F.col("c_nationkey").alias("contig"), F.col("c_custkey").alias("id"), F.bround(F.col("c_acctbal") + 1000).cast("long").alias("first")).withColumn("last", F.col("first") + 99)
    genes = table(spark, d, "supplier").select(F.col("s_nationkey").alias("contig"), F.col("s_suppkey").alias("gene"), F.bround(F.col("s_acctbal") + 1000).cast("long").alias("low"), F.bround(F.col("s_acctbal") + 1250).cast("long").alias("high"))
    return relations.reads_in_genes(reads, genes, 250).select("id", "gene")


@query("""WITH x AS (SELECT p_partkey AS id, unnest(string_split(p_type, ' ')) AS old FROM part), m AS (SELECT DISTINCT old, upper(substr(old, 1, 4)) AS new FROM x)
SELECT id, coalesce(string_agg(DISTINCT new, ' ' ORDER BY new), '') AS p_type FROM x JOIN m USING (old) GROUP BY 1""")
def mapped_lists(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_type")
    m = rows.select(F.explode(F.split("p_type", " ")).alias("old")).distinct().select("old", F.upper(F.substring("old", 1, 4)).alias("new"))
    return relations.mapped_lists(rows, "p_type", m, " ")


@query("SELECT p_brand, count(*) AS n, sum(CASE WHEN p_size >= 10 THEN 1 ELSE 0 END)::BIGINT AS over_10, sum(CASE WHEN p_size >= 25 THEN 1 ELSE 0 END)::BIGINT AS over_25, median(p_size) AS median_size FROM part GROUP BY 1")
def qc_by_collection(spark, d):
    over = lambda k: F.sum(F.when(F.col("p_size") >= k, 1).otherwise(0)).alias(f"over_{k}")
    return table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"), over(10), over(25), F.median("p_size").alias("median_size"))


@query(f"""WITH b AS ({BRANDS}), m AS ({META}) SELECT dx, gene, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value) / sqrt(count(*)), 0), 6) AS se, round(median(value), 6) AS median FROM b JOIN m USING (sample) GROUP BY 1, 2""")
def group_mean_se(spark, d):
    x = brands(spark, d).join(metadata(spark, d), "sample")
    return x.groupBy("dx", "gene").agg(r6(F.avg("value"), "mean"), r6(F.coalesce(F.stddev_samp("value") / F.sqrt(F.count("*")), F.lit(0.0)), "se"), r6(F.median("value"), "median"))


@query("""SELECT l_suppkey AS sample, coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = 'A'), 0) AS a, coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = 'N'), 0) AS n, coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = 'R'), 0) AS r FROM lineitem GROUP BY 1""")
def pivot_wide(spark, d):
    """Long to wide, the values stated so no pass finds them."""
    x = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("sample")).pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum("l_quantity")).fillna(0.0)
    return x.select("sample", F.col("A").alias("a"), F.col("N").alias("n"), F.col("R").alias("r"))


@query("SELECT l_orderkey, l_linenumber, 'l_discount' AS name, l_discount AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem")
def melt_long(spark, d):
    return table(spark, d, "lineitem").unpivot(["l_orderkey", "l_linenumber"], ["l_discount", "l_tax"], "name", "value")


@query(f"""WITH b AS ({BRANDS}), g AS (SELECT gene, count(DISTINCT sample) / (SELECT count(*) FROM supplier) AS share FROM b WHERE value > 500 GROUP BY 1) SELECT gene, round(share, 6) AS share FROM g WHERE share > 0.5""")
def presence_core_genes(spark, d):
    n = table(spark, d, "supplier").agg(F.count("*").alias("all"))
    g = brands(spark, d).filter("value > 500").groupBy("gene").agg(F.countDistinct("sample").alias("k")).crossJoin(F.broadcast(n))
    return g.withColumn("share", ratio(F.col("k"), F.col("all"))).filter("share > 0.5").select("gene", r6("share", "share"))


@query("""WITH e AS (SELECT c_nationkey AS q, count(*) AS w FROM customer GROUP BY 1) SELECT q, w, round(w / sum(w) OVER (), 6) AS share, round(sum(w) OVER (ORDER BY w DESC, q ROWS UNBOUNDED PRECEDING) / sum(w) OVER (), 6) AS running FROM e""")
def cumulative_shares(spark, d):
    from pyspark.sql import Window

    e = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("q")).agg(F.count("*").alias("w"))
    total = F.sum("w").over(Window.partitionBy())
    return e.select("q", "w", r6(F.col("w") / total, "share"), r6(F.sum("w").over(Window.orderBy(F.desc("w"), "q").rowsBetween(Window.unboundedPreceding, 0)) / total, "running"))


EXPRESSION = """WITH m AS (SELECT p_brand AS ident, p_type AS gene, count(*) AS n, sum(p_size)::DOUBLE AS total FROM part WHERE p_size > 0 GROUP BY 1, 2), z AS (SELECT p_brand AS ident, count(*) AS size FROM part GROUP BY 1), a AS (SELECT count(*) AS cells, 0.25 * min(p_size) FILTER (WHERE p_size > 0) / count(*) AS zero FROM part),
g AS (SELECT m.*, size, cells, zero, sum(n) OVER (PARTITION BY gene) AS gn, sum(total) OVER (PARTITION BY gene) AS gt FROM m JOIN z USING (ident), a),
e AS (SELECT gene, ident, n, (gn - n)::BIGINT AS ref_n, n / size AS alpha, (gn - n) / (cells - size) AS ref_alpha, log2(total / n + zero) AS mu, log2(coalesce((gt - total) / nullif(gn - n, 0), 0) + zero) AS ref_mu, log2(total / size + zero) AS mean, log2((gt - total) / (cells - size) + zero) AS ref_mean, total / gt AS total, (gt - total) / gt AS ref_total FROM g)"""


@query(EXPRESSION + "SELECT gene, ident, n, ref_n, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("alpha", "ref_alpha", "mu", "ref_mu", "mean", "ref_mean", "total", "ref_total")) + ", round(mean - ref_mean, 6) AS log2fc FROM e")
def expression_stats(spark, d):
    out = _expression(spark, d)
    return out.select("gene", "ident", "n", "ref_n", *[r6(c, c) for c in ("alpha", "ref_alpha", "mu", "ref_mu", "mean", "ref_mean", "total", "ref_total", "log2fc")])


def _expression(spark, d):
    part = table(spark, d, "part")
    cells = part.select(F.col("p_partkey").alias("cell"), F.col("p_type").alias("gene"), F.col("p_size").cast("double").alias("count"))
    return markers.expression_stats(cells, part.select(F.col("p_partkey").alias("cell"), F.col("p_brand").alias("ident")))


@query(EXPRESSION + """, f AS (SELECT gene, ident, substr(ident, 7, 1) AS family, round(mean, 9) AS mean FROM e),
j AS (SELECT a.gene, a.ident, a.mean, max(b.mean) FILTER (WHERE b.family = a.family) AS same_mean, min_by(b.ident, (-b.mean, b.ident)) FILTER (WHERE b.family = a.family) AS same_ident,
max(b.mean) FILTER (WHERE b.family <> a.family) AS next_mean, min_by(b.ident, (-b.mean, b.ident)) FILTER (WHERE b.family <> a.family) AS next_ident FROM f a JOIN f b USING (gene) GROUP BY 1, 2, 3)
SELECT gene, ident, round(same_mean, 6) AS same_mean, same_ident, round(next_mean, 6) AS next_mean, next_ident, round(coalesce(same_mean - next_mean, 'inf'::DOUBLE), 6) AS same_log2fc, round(coalesce(mean - next_mean, 'inf'::DOUBLE), 6) AS next_log2fc FROM j""")
def next_stats(spark, d):
    """Best statistics within and outside an ident's family; brands of one first digit are a family."""
    s = _expression(spark, d).select("gene", "ident", "alpha", "mu", F.round("mean", 9).alias("mean"))
    families = s.select("ident", F.substring("ident", 7, 1).alias("family")).distinct()
    out = markers.next_stats(s, families)
    return out.select("gene", "ident", r6("same_mean", "same_mean"), "same_ident", r6("next_mean", "next_mean"), "next_ident", r6("same_log2fc", "same_log2fc"), r6("next_log2fc", "next_log2fc"))
