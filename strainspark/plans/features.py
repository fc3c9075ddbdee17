"""Queries of feature-level operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from strainspark.operators import features
from strainspark.plans.common import BRANDS, COUNTS, META, PILE, brands, counts, metadata, pileup, r6, table
from strainspark.streaming.windows import windowed_counts

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH b AS ({BRANDS}), p AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY value, gene) AS place FROM b), m AS (SELECT place, avg(value) AS mean FROM p GROUP BY 1) SELECT sample, gene, round(mean, 6) AS value FROM p JOIN m USING (place)")
def quantile_normalise(spark, d):
    return features.quantile_normalised(brands(spark, d)).select("sample", "gene", r6("value", "value"))


@query(f"WITH c AS ({COUNTS}) SELECT gene, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value) / avg(value), 6) AS cv, round(ln(avg(value)), 6) AS log_mean FROM c GROUP BY 1")
def variable_gene_moments(spark, d):
    return features.variability(counts(spark, d)).select("gene", "n", r6("mean", "mean"), r6("cv", "cv"), r6("log_mean", "log_mean"))


@query("""SELECT p_partkey, round((p_size - avg(p_size) OVER w) / nullif(stddev_samp(p_size) OVER w, 0), 6) AS size_z FROM part WINDOW w AS (ORDER BY p_retailprice, p_partkey ROWS BETWEEN 49 PRECEDING AND 50 FOLLOWING)""")
def rolling_zscore(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_retailprice", F.col("p_size").alias("size"))
    return features.rolling_z(rows, "size", [F.asc("p_retailprice"), F.asc("p_partkey")]).select("p_partkey", r6("size_z", "size_z"))


@query("SELECT p_partkey, ntile(8) OVER (ORDER BY p_retailprice, p_partkey)::INTEGER AS bin FROM part")
def equal_frequency_bins(spark, d):
    return features.in_equal_bins(table(spark, d, "part"), "p_retailprice", 8, [F.asc("p_retailprice"), F.asc("p_partkey")]).select("p_partkey", "bin")


@query("""WITH j AS (SELECT l_returnflag AS x, l_linenumber AS y, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY x) AS nx, sum(n) OVER (PARTITION BY y) AS ny FROM j) SELECT round(sum(n / t * ln(n * t / (nx * ny))), 6) AS mi FROM t""")
def mutual_information(spark, d):
    return features.mutual_information(table(spark, d, "lineitem"), "l_returnflag", "l_linenumber").select(r6("mi", "mi"))


@query("""WITH r AS (SELECT p_brand, count(*) AS n, corr(p_size, p_retailprice) AS a, corr(p_size, p_partkey % 97) AS b, corr(p_retailprice, p_partkey % 97) AS c FROM part GROUP BY 1)
SELECT p_brand, CASE WHEN n >= 4 AND 1 - b * b > 1e-9 AND 1 - c * c > 1e-9 THEN round((a - b * c) / sqrt((1 - b * b) * (1 - c * c)), 6) END AS partial FROM r""")
def partial_correlation(spark, d):
    x = lambda c: F.col(c).cast("double")
    part = table(spark, d, "part").withColumn("z", F.col("p_partkey") % 97)
    r = part.groupBy("p_brand").agg(F.count("*").alias("n"), F.corr(x("p_size"), x("p_retailprice")).alias("rxy"), F.corr(x("p_size"), x("z")).alias("rxz"), F.corr(x("p_retailprice"), x("z")).alias("ryz"))
    return features.partial_correlation(r).select("p_brand", r6("partial", "partial"))


@query("""WITH n AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) SELECT CASE WHEN n <= 58 THEN 'Other' ELSE c_nationkey::VARCHAR END AS batch, count(*) AS n FROM customer JOIN n USING (c_nationkey) GROUP BY 1""")
def small_batches_merged(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("batch"))
    return features.small_groups_merged(rows, "batch", 58).groupBy("batch").agg(F.count("*").alias("n"))


@query(f"""WITH p AS (SELECT DISTINCT gene AS pos, sample FROM ({PILE}) WHERE n > 5), m AS ({META}), z AS (SELECT dx, count(DISTINCT sample) AS n FROM m GROUP BY 1), h AS (SELECT pos, dx, count(*) / any_value(n) AS f FROM p JOIN m USING (sample) JOIN z USING (dx) GROUP BY 1, 2),
b AS (SELECT pos, max(f) FILTER (WHERE dx = 'HC') AS f1, max(f) FILTER (WHERE dx = 'IBD') AS f2 FROM h GROUP BY 1) SELECT pos, round(f1, 6) AS f1, round(f2, 6) AS f2 FROM b WHERE f1 > 0 AND f2 > 0 AND abs(ln(f1 / f2)) < 0.25""")
def balanced_sites(spark, d):
    rows = pileup(spark, d).filter("n > 5").select("sample", F.col("gene").alias("pos"))
    return features.balanced_sites(rows, metadata(spark, d).select("sample", F.col("dx").alias("class")), "HC", "IBD", 0.25).select("pos", r6("f1", "f1"), r6("f2", "f2"))


@query("SELECT p_brand, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS p_type FROM part GROUP BY 1")
def joined_annotations(spark, d):
    return features.joined_annotations(table(spark, d, "part"), "p_brand", "p_type")


@query("""WITH s AS (SELECT c_mktsegment AS cluster, c_nationkey AS batch, count(*) AS n FROM customer GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, batch) AS k FROM s) SELECT cluster, sum(n)::BIGINT AS n, round(sum(n) FILTER (WHERE k <= 3) / sum(n), 6) AS share FROM k GROUP BY 1""")
def batch_dominance(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_mktsegment").alias("cluster"), F.col("c_nationkey").alias("batch"))
    return features.dominance(rows, "cluster", "batch", 3).select("cluster", "n", r6("share", "share"))


@query(f"WITH c AS ({COUNTS}) SELECT gene, round(exp(avg(ln(value))), 6) AS gmean FROM c WHERE value > 0 GROUP BY 1")
def geometric_means(spark, d):
    return features.geometric_means(counts(spark, d)).select("gene", r6("gmean", "gmean"))


@query("SELECT p_brand, count(*) FILTER (WHERE trim(p_type) <> '' AND NOT regexp_matches(p_type, '(?i)unknown|hypothetical|uncharacterized')) AS annotated FROM part GROUP BY 1")
def annotated_gene_counts(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.count(F.when(features.annotated(F.col("p_type")), 1)).alias("annotated"))


@query("SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_events(spark, d):
    """An addition: hourly windows, as a stream would give them."""
    out = windowed_counts(table(spark, d, "events"), "ts", ["event_type"], "value", "1 hour")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
