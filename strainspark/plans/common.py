"""Stand-ins for the domain's inputs on the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strainspark.operators.matrix import count_matrix


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def counts(spark: SparkSession, d: str) -> DataFrame:
    """(sample, gene, value): suppliers by parts."""
    return count_matrix(table(spark, d, "lineitem"), "l_suppkey", "l_partkey", "l_quantity")


COUNTS = "SELECT l_suppkey AS sample, l_partkey AS gene, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2"


def brands(spark: SparkSession, d: str) -> DataFrame:
    """(sample, gene, value): suppliers by brands, nearly dense."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return count_matrix(rows, "l_suppkey", "p_brand", "l_quantity")


BRANDS = "SELECT l_suppkey AS sample, p_brand AS gene, sum(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"


def metadata(spark: SparkSession, d: str) -> DataFrame:
    """(sample, subject, cohort, dx, cov) of suppliers."""
    rows = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select(F.col("s_suppkey").alias("sample"), F.col("s_nationkey").alias("subject"), F.col("n_regionkey").alias("cohort"), F.when(F.col("s_acctbal") > 5000, "IBD").otherwise("HC").alias("dx"), F.col("s_acctbal").alias("cov"))


META = "SELECT s_suppkey AS sample, s_nationkey AS subject, n_regionkey AS cohort, CASE WHEN s_acctbal > 5000 THEN 'IBD' ELSE 'HC' END AS dx, s_acctbal AS cov FROM supplier JOIN nation ON s_nationkey = n_nationkey"


def pileup(spark: SparkSession, d: str) -> DataFrame:
    """(gene, sample, pos, allele, n): brands, suppliers, line numbers and return flags."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    allele = F.when(F.col("l_returnflag") == "N", "C").when(F.col("l_returnflag") == "R", "T").otherwise("A")
    return rows.groupBy(F.col("p_brand").alias("gene"), F.col("l_suppkey").alias("sample"), F.col("l_linenumber").alias("pos"), allele.alias("allele")).agg(F.count("*").alias("n"))


PILE = "SELECT p_brand AS gene, l_suppkey AS sample, l_linenumber AS pos, CASE l_returnflag WHEN 'N' THEN 'C' WHEN 'R' THEN 'T' ELSE 'A' END AS allele, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL"


def r6(x: Column | str, name: str) -> Column:
    """Rounded to six places, so that the order of summation doesn't show."""
    return F.round(F.col(x) if isinstance(x, str) else x, 6).alias(name)
