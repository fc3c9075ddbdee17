"""Queries of metadata cleaning, filters, fills, annotation joins and panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from strainspark.operators import annotation, curation, mixed, panels
from strainspark.operators.curation import RANKS
from strainspark.plans.common import COUNTS, BRANDS, META, brands, metadata, r6, table

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _hash(text: str) -> str:
    """DuckDB's form of ``curation.draw`` for a text expression."""
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT / 4294967296.0)"


# Metadata: customers as samples, with blanks and letters as the sheets have them

RAW = """SELECT c_custkey AS sample, CASE WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 11 = 0 THEN '9Z' ELSE (c_custkey % 90)::VARCHAR END AS age,
CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'M' WHEN 2 THEN 'M' ELSE 'F' END AS sex, CASE c_custkey % 4 WHEN 0 THEN 'HC' WHEN 1 THEN 'UC' WHEN 2 THEN 'CD' ELSE 'IBDU' END AS dx,
CASE WHEN c_acctbal > 0 THEN c_acctbal END AS bmi, c_nationkey AS cohort FROM customer"""


def _raw(spark, d):
    k = F.col("c_custkey")
    age = F.when(k % 7 == 0, "").when(k % 11 == 0, "9Z").otherwise((k % 90).cast("string"))
    sex = F.when(k % 5 == 0, "").when((k % 5).isin(1, 2), "M").otherwise("F")
    dx = F.when(k % 4 == 0, "HC").when(k % 4 == 1, "UC").when(k % 4 == 2, "CD").otherwise("IBDU")
    rows = table(spark, d, "customer").select(k, age.alias("Age (years)"), sex.alias("Sex"), dx.alias("Diagnosis"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("bmi"), F.col("c_nationkey").alias("Study cohort"))
    return curation.renamed(rows, {"c_custkey": "sample", "Age (years)": "age", "Sex": "sex", "Diagnosis": "dx", "Study cohort": "cohort"})


CLEAN = f"""SELECT sample, try_cast(CASE WHEN age <> '' AND NOT regexp_matches(age, '[A-Z]') THEN age END AS DOUBLE) AS age, CASE WHEN sex IN ('M', 'F') THEN sex END AS sex, bmi, cohort,
replace(dx, 'IBDU', 'CD') AS nice_dx2, CASE WHEN dx = 'HC' THEN 'HC' ELSE 'IBD' END AS nice_dx FROM ({RAW})"""


@query(f"SELECT sample, age, sex, nice_dx2, nice_dx FROM ({CLEAN})")
def cleaned_metadata(spark, d):
    return curation.cleaned_metadata(_raw(spark, d)).select("sample", "age", "sex", "nice_dx2", "nice_dx")


@query(f"""WITH c AS ({CLEAN}), k AS (SELECT avg(age) AS ma, avg(bmi) AS mb, count(*) FILTER (WHERE sex = 'M') / count(sex) AS share FROM c),
f AS (SELECT sample, coalesce(age, ma) AS a, coalesce(bmi, mb) AS b, coalesce(sex, CASE WHEN {_hash("'sex:' || sample")} < share THEN 'M' ELSE 'F' END) AS nice_sex FROM c, k)
SELECT sample, round((a - avg(a) OVER ()) / stddev_samp(a) OVER (), 6) AS nice_age, round((b - avg(b) OVER ()) / stddev_samp(b) OVER (), 6) AS nice_bmi, nice_sex FROM f""")
def imputed_metadata(spark, d):
    out = curation.imputed_metadata(curation.cleaned_metadata(_raw(spark, d)), "sample", ["age", "bmi"], "sex", "M", "F")
    return out.select("sample", r6("nice_age", "nice_age"), r6("nice_bmi", "nice_bmi"), "nice_sex")


@query(f"SELECT sample, age, sex, bmi FROM ({RAW}) WHERE age <> '' AND sex <> '' AND bmi IS NOT NULL")
def complete_rows(spark, d):
    return curation.complete(_raw(spark, d), ["age", "sex", "bmi"]).select("sample", "age", "sex", "bmi")


# Taxonomy: parts as genomes

LINEAGE = """SELECT p_partkey, 'd__Bacteria;p__' || p_type || '_A;c__' || replace(p_brand, '#', '') || ';o__;f__' || split_part(p_name, ' ', 1) || ';g__' || CASE WHEN p_size % 3 = 0 THEN '' WHEN p_size % 3 = 1 THEN 'G' || p_size ELSE split_part(p_name, ' ', 2) END
|| ';s__' || CASE WHEN p_size % 4 = 0 THEN '' WHEN p_size % 4 = 1 THEN 'sp' || p_size ELSE p_name END AS lineage FROM part"""


def _lineage(spark, d):
    size, word = F.col("p_size"), lambda k: F.split_part("p_name", F.lit(" "), F.lit(k))
    genus = F.when(size % 3 == 0, "").when(size % 3 == 1, F.concat(F.lit("G"), size.cast("string"))).otherwise(word(2))
    species = F.when(size % 4 == 0, "").when(size % 4 == 1, F.concat(F.lit("sp"), size.cast("string"))).otherwise(F.col("p_name"))
    text = F.concat(F.lit("d__Bacteria;p__"), F.col("p_type"), F.lit("_A;c__"), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit(";o__;f__"), word(1), F.lit(";g__"), genus, F.lit(";s__"), species)
    return table(spark, d, "part").select("p_partkey", text.alias("lineage"))


TAXA = "SELECT p_partkey, " + ", ".join(f"""regexp_replace(regexp_replace(split_part(lineage, ';', {k + 1}), '^[dpcofgs]__', ''), '_[A-Z]$', '') AS "{r}\"""" for k, r in enumerate(RANKS)) + f" FROM ({LINEAGE})"


@query(TAXA)
def taxonomy_ranks(spark, d):
    ranks = curation.taxonomy(F.col("lineage"))
    return _lineage(spark, d).select("p_partkey", *[c.alias(r) for r, c in ranks.items()])


@query(f"""WITH t AS ({TAXA}), u AS (SELECT * REPLACE (CASE WHEN species <> '' THEN species WHEN genus <> '' THEN genus || ' sp.' ELSE '' END AS species) FROM t),
n AS (SELECT *, CASE WHEN species <> '' AND NOT regexp_matches(species, '\\d') THEN 7 WHEN genus <> '' AND NOT regexp_matches(genus, '\\d') THEN 6 WHEN family <> '' AND NOT regexp_matches(family, '\\d') THEN 5
WHEN "order" <> '' AND NOT regexp_matches("order", '\\d') THEN 4 WHEN "class" <> '' AND NOT regexp_matches("class", '\\d') THEN 3 WHEN phylum <> '' AND NOT regexp_matches(phylum, '\\d') THEN 2 ELSE 1 END AS k FROM u),
v AS (SELECT *, list_extract([domain, phylum, "class", "order", family], k) || ' ' || list_extract(['domain', 'phylum', 'class', 'order', 'family'], k) AS a FROM n)
SELECT p_partkey, CASE WHEN k = 7 THEN species WHEN k = 6 THEN genus || ' sp.' WHEN species <> '' THEN species || ' (' || a || ')' ELSE a || ' microbe' END AS nice FROM v""")
def nice_taxon_labels(spark, d):
    """Labels by the deepest named rank, in their four forms."""
    return _lineage(spark, d).select("p_partkey", curation.nice_name(curation.taxonomy(F.col("lineage"))).alias("nice"))


LABELS = f"SELECT sample, CASE WHEN sample % 3 = 0 THEN 'GUTREFGUTGENOME' || lpad(sample::VARCHAR, 6, '0') || '_x' ELSE 's' || sample || '_' || dx END AS label FROM ({RAW})"


@query(f"""SELECT sample, regexp_replace(label, '_(HC|UC|CD|IBDU|IBD)$', '') AS stripped, nullif(regexp_extract(label, '_(HC|UC|CD|IBDU|IBD)$', 1), '') AS dx,
CASE WHEN label LIKE 'GUTREF%' THEN 'GUT_GENOME' || regexp_extract(label, 'GENOME(\\d{{6}})', 1) ELSE label END AS reference FROM ({LABELS})""")
def repaired_labels(spark, d):
    label = F.when(F.col("sample") % 3 == 0, F.concat(F.lit("GUTREFGUTGENOME"), F.lpad(F.col("sample").cast("string"), 6, "0"), F.lit("_x"))).otherwise(F.concat(F.lit("s"), F.col("sample").cast("string"), F.lit("_"), F.col("dx")))
    x = _raw(spark, d).select("sample", label.alias("label"))
    return x.select("sample", curation.without_diagnosis(F.col("label")).alias("stripped"), curation.diagnosis(F.col("label")).alias("dx"), curation.reference_name(F.col("label")).alias("reference"))


@query("SELECT p_partkey FROM part WHERE regexp_matches(p_name, 'o') AND regexp_matches(p_name, 't$|r$') AND NOT regexp_matches(p_name, '^red')")
def matching_names(spark, d):
    return table(spark, d, "part").filter(curation.matching(F.col("p_name"), ["o", "t$|r$"], ["^red"])).select("p_partkey")


@query("SELECT p_partkey, overlay AS swapped, label FROM (SELECT p_partkey, 'X' || substr(p_name, 2, 2) || CASE WHEN length(p_name) >= 4 THEN '-' ELSE '' END || substr(p_name, 5) AS overlay, replace(p_name, ' ', chr(10)) AS label FROM part)")
def swapped_characters(spark, d):
    return table(spark, d, "part").select("p_partkey", curation.swapped(F.col("p_name"), {1: "X", 4: "-"}).alias("swapped"), curation.wrapped(F.col("p_name"), 1).alias("label"))


@query("SELECT p_partkey, substr(upper(substr(t, 1, 1)) || lower(substr(t, 2)), 1, 12) AS term FROM (SELECT p_partkey, trim(regexp_replace(regexp_replace(p_type || '_' || replace(p_name, ' ', '__') || ' (GO:000' || p_size || ')', '\\s*\\([^()]*:[^()]*\\)$', ''), '_+', ' ', 'g')) AS t FROM part)")
def term_names(spark, d):
    term = F.concat("p_type", F.lit("_"), F.replace("p_name", F.lit(" "), F.lit("__")), F.lit(" (GO:000"), F.col("p_size").cast("string"), F.lit(")"))
    return table(spark, d, "part").select("p_partkey", curation.term_name(term, 12).alias("term"))


# Cells: parts as cells of a brand, types as genes


def _cells(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("cell"), F.col("l_partkey").alias("gene")).agg(F.sum("l_quantity").alias("count"))


CELLS = "SELECT l_orderkey AS cell, l_partkey AS gene, sum(l_quantity) AS count FROM lineitem GROUP BY 1, 2"


@query(f"""WITH c AS ({CELLS}), g AS (SELECT gene FROM c GROUP BY 1 HAVING count(*) >= 28), k AS (SELECT * FROM c SEMI JOIN g USING (gene) WHERE NOT regexp_matches(cell::VARCHAR, '7$')),
r AS (SELECT * FROM c WHERE NOT regexp_matches(cell::VARCHAR, '7$')), h AS (SELECT gene FROM r GROUP BY 1 HAVING count(*) >= 28), x AS (SELECT * FROM r SEMI JOIN h USING (gene)), s AS (SELECT cell FROM x GROUP BY 1 HAVING count(*) BETWEEN 3 AND 6) SELECT x.* FROM x SEMI JOIN s USING (cell)""")
def filtered_cells(spark, d):
    return curation.filtered_cells(_cells(spark, d), 28, 3, 6, drop="7$", repeated=False)


STATS = "SELECT p_type AS gene, p_brand AS ident, count(*) FILTER (WHERE p_size > 25) AS n, avg(p_size) AS mean, count(*) FILTER (WHERE p_size > 25) / count(*) AS alpha FROM part GROUP BY 1, 2"
MARKERS = f"""SELECT gene, ident AS contrast, n, round(alpha, 9) AS alpha, round((sum(n) OVER g - n) / 100.0, 9) AS ref_alpha, round(log2(mean / avg(mean) OVER g), 9) AS log2fc, round(exp(-n), 9) AS pval FROM ({STATS}) WINDOW g AS (PARTITION BY gene)"""


def _markers(spark, d):
    from pyspark.sql import Window

    s = table(spark, d, "part").groupBy(F.col("p_type").alias("gene"), F.col("p_brand").alias("contrast")).agg(F.count(F.when(F.col("p_size") > 25, 1)).alias("n"), F.avg("p_size").alias("mean"), (F.count(F.when(F.col("p_size") > 25, 1)) / F.count("*")).alias("alpha"))
    g = Window.partitionBy("gene")
    return s.select("gene", "contrast", "n", F.round("alpha", 9).alias("alpha"), F.round((F.sum("n").over(g) - F.col("n")) / 100.0, 9).alias("ref_alpha"), F.round(F.log2(F.col("mean") / F.avg("mean").over(g)), 9).alias("log2fc"), F.round(F.exp(-F.col("n")), 9).alias("pval"))


@query(f"SELECT * FROM ({MARKERS}) WHERE n >= 5 AND greatest(alpha, ref_alpha) >= 0.3 AND abs(log2fc) >= 0.05")
def selected_genes(spark, d):
    return curation.selected_genes(_markers(spark, d), 5, 0.3, 0.05)


@query(f"SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY contrast ORDER BY pval, log2fc DESC, gene) AS k FROM ({MARKERS}) WHERE pval <= 0.01 AND log2fc >= 0.02) WHERE k <= 2")
def filtered_markers(spark, d):
    return curation.filtered_markers(_markers(spark, d), 0.01, 0.02, False, 2)


@query(f"SELECT * EXCLUDE (k) FROM (SELECT *, count(*) OVER (PARTITION BY gene) AS k FROM ({MARKERS}) WHERE pval <= 0.01 AND log2fc >= 0.2) WHERE k = 1")
def unique_markers(spark, d):
    return curation.filtered_markers(_markers(spark, d), 0.01, 0.2, True, 1000)


@query(f"SELECT contrast, gene, round(avg(log2fc), 6) AS log2fc, min_by(ident, pos) AS ident FROM (SELECT 'c' || (n % 2) AS contrast, gene, log2fc, contrast AS ident, contrast AS pos FROM ({MARKERS})) GROUP BY 1, 2")
def collapsed_markers(spark, d):
    x = _markers(spark, d).select(F.concat(F.lit("c"), (F.col("n") % 2).cast("string")).alias("contrast"), "gene", "log2fc", F.col("contrast").alias("ident"))
    return curation.collapsed(x.withColumn("pos", F.col("ident")), ["contrast", "gene"], ["log2fc"], ["ident"], "pos").select("contrast", "gene", r6("log2fc", "log2fc"), "ident")


@query(f"SELECT gene, contrast, pval FROM ({MARKERS})")
def ranked_markers(spark, d):
    """All markers in the order of p and fold."""
    return _markers(spark, d).orderBy("pval", F.desc("log2fc"), "gene", "contrast").select("gene", "contrast", "pval")


@query(f"""SELECT gene, contrast, 'fewer' AS test FROM ({MARKERS}) WHERE log2fc < 0 UNION ALL SELECT gene, contrast, 'more' FROM ({MARKERS}) WHERE log2fc > 0 UNION ALL SELECT gene, contrast, 'strong' FROM ({MARKERS}) WHERE abs(log2fc) > 0.1 UNION ALL SELECT gene, contrast, 'sure' FROM ({MARKERS}) WHERE pval < 0.01""")
def contrast_union(spark, d):
    """Four sets of results, by name, under one another."""
    m = _markers(spark, d)
    parts = [m.filter(f).select("gene", "contrast", F.lit(t).alias("test")) for t, f in (("fewer", "log2fc < 0"), ("more", "log2fc > 0"), ("strong", "abs(log2fc) > 0.1"), ("sure", "pval < 0.01"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(f"""WITH b AS ({BRANDS}), p AS (SELECT sample, gene FROM b WHERE value > 550), m AS ({META}), z AS (SELECT dx, count(DISTINCT sample) AS n FROM m GROUP BY 1)
SELECT gene AS feature, round(max(k / n), 6) AS best FROM (SELECT gene, dx, count(DISTINCT sample) AS k FROM p JOIN m USING (sample) GROUP BY 1, 2) JOIN z USING (dx) GROUP BY 1 HAVING max(k / n) > 0.05""")
def present_in_a_class(spark, d):
    found = brands(spark, d).filter("value > 550").select("sample", F.col("gene").alias("feature"))
    return curation.present_in_a_class(found, metadata(spark, d).select("sample", F.col("dx").alias("class"))).select("feature", r6("best", "best"))


@query("SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1")
def frequency_table(spark, d):
    return curation.frequencies(table(spark, d, "orders"), "o_orderpriority")


HOLES = "SELECT o_orderkey AS id, o_custkey % 20 AS grp, CASE WHEN o_orderkey % 6 <> 0 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END AS priority FROM orders"


def _holes(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("id"), (F.col("o_custkey") % 20).alias("grp"), F.when(k % 6 != 0, F.col("o_totalprice")).alias("price"), F.when(k % 4 != 0, F.col("o_orderpriority")).alias("priority"))


@query(f"""WITH h AS ({HOLES}), m AS (SELECT grp, avg(price) AS mean FROM h GROUP BY 1), c AS (SELECT grp, priority, count(*) AS n FROM h WHERE priority IS NOT NULL GROUP BY 1, 2), o AS (SELECT grp, first(priority ORDER BY n DESC, priority) AS mode FROM c GROUP BY 1)
SELECT id, grp, round(coalesce(price, mean), 4) AS price, coalesce(priority, mode) AS priority FROM h JOIN m USING (grp) JOIN o USING (grp)""")
def filled_by_group(spark, d):
    return curation.filled(_holes(spark, d), "grp", "price", "priority").select("id", "grp", F.round("price", 4).alias("price"), "priority")


@query(f"SELECT id, grp, coalesce(price, max(price) OVER (PARTITION BY grp)) AS price FROM ({HOLES})")
def max_filled(spark, d):
    return curation.max_filled(_holes(spark, d), "price", ["grp"]).select("id", "grp", "price")


@query(f"SELECT id, grp FROM (SELECT *, avg(price) OVER w AS m, stddev_pop(price) OVER w AS s FROM ({HOLES}) WHERE price IS NOT NULL WINDOW w AS (PARTITION BY grp)) WHERE abs(price - m) / s < 1.5")
def near_group_mean(spark, d):
    return curation.near_mean(_holes(spark, d).filter("price IS NOT NULL"), "price", ["grp"], 1.5).select("id", "grp")


@query(f"SELECT id, max(price) OVER (PARTITION BY grp ORDER BY id ROWS UNBOUNDED PRECEDING) AS so_far FROM ({HOLES})")
def running_max(spark, d):
    return curation.running_max(_holes(spark, d), "price", ["grp"], [F.asc("id")], "so_far").select("id", "so_far")


@query(f"SELECT id, ntile(5) OVER (PARTITION BY grp ORDER BY id)::INTEGER AS chunk FROM ({HOLES})")
def chunked(spark, d):
    return curation.chunked(_holes(spark, d), "grp", [F.asc("id")], 5).select("id", "chunk")


@query(f"SELECT sample, gene AS peak, value FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY value DESC, gene) AS k FROM ({BRANDS})) WHERE k = 1")
def argmax_places(spark, d):
    return curation.argmax_places(brands(spark, d), "sample", "gene", "value")


@query("SELECT c_custkey, least(floor((c_acctbal - lo) * 10 / (hi - lo))::INTEGER + 1, 10) AS bin FROM customer, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)")
def equal_width_bins(spark, d):
    return curation.width_bins(table(spark, d, "customer"), "c_acctbal", 10).select("c_custkey", "bin")


@query("SELECT p_partkey, len(list_filter(e, lambda x: x <= p_size))::INTEGER + 1 AS bin FROM part, (SELECT [" + ", ".join(f"quantile_cont(p_size, {k / 4})" for k in (1, 2, 3)) + "] AS e FROM part)")
def tied_frequency_bins(spark, d):
    return curation.frequency_bins(table(spark, d, "part"), "p_size", 4).select("p_partkey", "bin")


@query(f"""SELECT gene, count(*) AS votes FROM (SELECT DISTINCT l_suppkey % 10 AS batch, l_partkey AS gene FROM lineitem WHERE l_quantity > 25) GROUP BY 1 ORDER BY 2 DESC, {_hash("'vote:' || gene")}, 1 LIMIT 50""")
def variable_votes(spark, d):
    rows = table(spark, d, "lineitem").filter("l_quantity > 25").select((F.col("l_suppkey") % 10).alias("batch"), F.col("l_partkey").alias("gene"))
    return curation.variable_votes(rows, 50)


@query("""WITH l AS (SELECT p_brand AS pc, p_partkey AS gene, p_retailprice - avg(p_retailprice) OVER () AS loading FROM part), k AS (SELECT *, row_number() OVER (PARTITION BY pc ORDER BY loading DESC, gene) AS t, row_number() OVER (PARTITION BY pc ORDER BY loading, gene) AS l FROM l)
SELECT pc, gene, CASE WHEN t <= 5 THEN 'top' ELSE 'bottom' END AS side FROM k WHERE t <= 5 OR l <= 5""")
def loaded_genes(spark, d):
    p = table(spark, d, "part")
    x = p.crossJoin(F.broadcast(p.agg(F.avg("p_retailprice").alias("m")))).select(F.col("p_brand").alias("pc"), F.col("p_partkey").alias("gene"), (F.col("p_retailprice") - F.col("m")).alias("loading"))
    return curation.loaded_genes(x, 5).select("pc", "gene", "side")


@query("""WITH e AS (SELECT o_custkey % 10 AS grp, o_custkey AS uid, max(o_totalprice) AS loglik FROM orders WHERE o_orderkey % 9 <> 0 GROUP BY 1, 2) SELECT grp, uid, loglik FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY loglik DESC, uid) AS k FROM e) WHERE k <= 5""")
def best_estimates(spark, d):
    e = table(spark, d, "orders").select((F.col("o_custkey") % 10).alias("grp"), F.col("o_custkey").alias("uid"), F.when(F.col("o_orderkey") % 9 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice")).alias("loglik"))
    return curation.best_estimates(e, 5)


#: Matrices of the same counts as they are, as shares of 10,000, as logarithms of these with one added, and without a scale.
SCALES = {"counts": "value", "tpm": "1e4 * value / t", "2": "log2(1 + 1e4 * value / t)", "e": "ln(1 + 1e4 * value / t)", "10": "ln(1 + 1e4 * value / t) / ln(10)", "none": "value / 7.3"}


@query(f"""WITH c AS (SELECT sample, gene, value::DOUBLE AS value, sum(value) OVER (PARTITION BY sample)::DOUBLE AS t FROM ({COUNTS})), m AS ({" UNION ALL ".join(f"SELECT '{k}' AS matrix, sample, gene, {x} AS value FROM c" for k, x in SCALES.items())}),
s AS (SELECT matrix, sample, sum(value) AS s1, sum(2 ** value - 1) AS s2, sum(exp(least(value, 700)) - 1) AS s3, sum(10 ** least(value, 300) - 1) AS s4, max(value) AS most, bool_and(value = floor(value)) AS whole FROM m GROUP BY 1, 2)
SELECT matrix, CASE WHEN bool_and(whole) AND max(most) > 50 THEN 'counts' WHEN bool_or(abs(s1 / 1e4 - 1) < 0.01 OR abs(s1 / 1e6 - 1) < 0.01) THEN 'tpm' WHEN bool_or(abs(s2 / 1e4 - 1) < 0.01 OR abs(s2 / 1e6 - 1) < 0.01) THEN '2'
WHEN bool_or(abs(s3 / 1e4 - 1) < 0.01 OR abs(s3 / 1e6 - 1) < 0.01) THEN 'e' WHEN bool_or(abs(s4 / 1e4 - 1) < 0.01 OR abs(s4 / 1e6 - 1) < 0.01) THEN '10' END AS base FROM s GROUP BY 1""")
def log_base(spark, d):
    """The scale of each of six matrices of the same counts."""
    from pyspark.sql import Window

    from strainspark.plans.common import counts

    c = counts(spark, d).withColumn("value", F.col("value").cast("double")).withColumn("t", F.sum("value").over(Window.partitionBy("sample")))
    found = [curation.log_base(c.select("sample", "gene", F.expr(x).alias("value"))).select(F.lit(k).alias("matrix"), "base") for k, x in SCALES.items()]
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out


@query("SELECT c_mktsegment, round(median(c_acctbal), 6) AS x, round(median(c_custkey), 6) AS y FROM customer GROUP BY 1")
def coordinate_medians(spark, d):
    """Where a group's label goes: the medians of its coordinates, in the order of the first."""
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(r6(F.median("c_acctbal"), "x"), r6(F.median("c_custkey"), "y")).orderBy("x", "c_mktsegment")


# Annotation: parts as proteins, customers and suppliers as tables of ids

EGG = "SELECT 'id' || p_partkey AS id, 'second_name_of_a_gene_' || p_name AS id2, CASE WHEN p_size % 3 = 0 THEN '-' ELSE 'ko:K' || lpad((p_size)::VARCHAR, 5, '0') || ',ko:K' || lpad((p_size % 7)::VARCHAR, 5, '0') END AS kos FROM part"


@query(f"""WITH e AS ({EGG}) SELECT DISTINCT id, substr(ko, 4) AS ko FROM (SELECT unnest([id, substr(id2, 1, 22)]) AS id, kos FROM e WHERE contains(kos, 'ko:')), unnest(string_split(kos, ',')) AS t(ko)""")
def kegg_table(spark, d):
    size = F.col("p_size")
    ko = lambda x: F.concat(F.lit("ko:K"), F.lpad(x.cast("string"), 5, "0"))
    rows = table(spark, d, "part").select(F.concat(F.lit("id"), F.col("p_partkey").cast("string")).alias("id"), F.concat(F.lit("second_name_of_a_gene_"), "p_name").alias("id2"), F.when(size % 3 == 0, "-").otherwise(F.concat(ko(size), F.lit(","), ko(size % 7))).alias("kos"))
    return annotation.kegg_table(rows)


@query("SELECT DISTINCT p_partkey AS gene, p_size AS ko, s_nationkey AS grp FROM part JOIN supplier ON p_size = s_suppkey % 50")
def genes_of_groups(spark, d):
    kos = table(spark, d, "supplier").select((F.col("s_suppkey") % 50).alias("ko"), F.col("s_nationkey").alias("grp"))
    return annotation.genes_of_groups(kos, table(spark, d, "part").select(F.col("p_partkey").alias("gene"), F.col("p_size").cast("long").alias("ko"))).select("gene", F.col("ko").cast("int").alias("ko"), "grp")


@query("""WITH k AS (SELECT upper(p_name) AS s, string_agg(DISTINCT p_brand, '|' ORDER BY p_brand) AS hits FROM part WHERE p_size % 2 = 0 GROUP BY 1) SELECT p_partkey AS id, coalesce(hits, '') AS hits FROM part LEFT JOIN k ON upper(p_name || CASE WHEN p_size > 40 THEN 'x' ELSE '' END) = s""")
def same_sequence(spark, d):
    p = table(spark, d, "part")
    proteins = p.select(F.col("p_partkey").alias("id"), F.concat("p_name", F.when(F.col("p_size") > 40, "x").otherwise("")).alias("seq"))
    return annotation.same_sequence(proteins, p.filter("p_size % 2 = 0").select(F.col("p_brand").alias("id"), F.upper("p_name").alias("seq")))


HITS = "SELECT l_suppkey AS query, l_partkey AS target, 100 - 100 * l_discount AS pident FROM lineitem"


def _hits(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("query"), F.col("l_partkey").alias("target"), (100 - 100 * F.col("l_discount")).alias("pident"))


@query(f"SELECT query, count(DISTINCT target) AS n, string_agg(DISTINCT target::VARCHAR, ',' ORDER BY target::VARCHAR) AS targets FROM ({HITS}) WHERE pident >= 99 GROUP BY 1")
def hit_lists(spark, d):
    return annotation.hit_lists(_hits(spark, d), 99)


@query(f"""WITH l AS (SELECT query::VARCHAR AS id, string_agg(DISTINCT target::VARCHAR, ',' ORDER BY target::VARCHAR) AS targets FROM ({HITS}) WHERE pident >= 99 GROUP BY 1) SELECT p_partkey AS genome, p_brand AS gene, coalesce(targets, (p_size * 3)::VARCHAR) AS ids FROM part LEFT JOIN l ON id = (p_size * 3)::VARCHAR""")
def panel_with_hits(spark, d):
    panel = table(spark, d, "part").select(F.col("p_partkey").alias("genome"), F.col("p_brand").alias("gene"), (F.col("p_size") * 3).cast("string").alias("id"))
    return annotation.panel_with_hits(panel, annotation.hit_lists(_hits(spark, d), 99))


@query("""WITH h AS (SELECT l_linenumber AS panel, l_returnflag AS gene, l_suppkey AS genome, l_partkey AS target, l_quantity AS pident FROM lineitem), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY panel, gene, genome ORDER BY pident DESC, target) AS k FROM h) WHERE k = 1),
w AS (SELECT panel, genome FROM b GROUP BY 1, 2 HAVING count(*) = 3) SELECT panel, genome, gene, target FROM b SEMI JOIN w USING (panel, genome)""")
def genomes_with_all(spark, d):
    x = table(spark, d, "lineitem")
    hits = x.select(F.col("l_linenumber").alias("panel"), F.col("l_returnflag").alias("gene"), F.col("l_suppkey").alias("genome"), F.col("l_partkey").alias("target"), F.col("l_quantity").alias("pident"))
    panel = x.select(F.col("l_linenumber").alias("panel")).distinct().crossJoin(F.broadcast(x.select(F.col("l_returnflag").alias("gene")).distinct()))
    return annotation.genomes_with_all(hits, panel)


@query("SELECT DISTINCT s AS symbol, p_partkey AS row FROM (SELECT p_partkey, trim(unnest(string_split(p_name || '|' || p_type || '|' || p_brand, '|'))) AS s FROM part) WHERE s IN (SELECT p_brand FROM part UNION SELECT p_name FROM part WHERE p_size > 25)")
def symbol_rows(spark, d):
    p = table(spark, d, "part")
    rows = p.select(F.col("p_partkey").alias("row"), F.concat_ws("|", "p_name", "p_type", "p_brand").alias("names"))
    return annotation.symbol_rows(rows, "names", p.select(F.col("p_brand").alias("symbol")).union(p.filter("p_size > 25").select("p_name")))


@query("""WITH n AS (SELECT p_partkey, p_brand, coalesce(CASE WHEN p_size % 4 = 0 THEN p_name END, CASE WHEN p_size % 4 = 1 THEN p_type END, CASE WHEN p_size % 4 = 2 THEN 'k' || p_size || '_x' END) AS name FROM part), s AS (SELECT *, regexp_replace(name, '_.*$', '') AS short FROM n)
SELECT p_partkey, CASE WHEN regexp_matches(short, '^[a-z]') AND length(short) > 2 THEN short ELSE p_brand || '_group' END AS symbol FROM s""")
def gene_symbols(spark, d):
    size = F.col("p_size")
    gene, alias, kegg = F.when(size % 4 == 0, F.col("p_name")).otherwise(""), F.when(size % 4 == 1, F.col("p_type")), F.when(size % 4 == 2, F.concat(F.lit("k"), size.cast("string"), F.lit("_x")))
    return table(spark, d, "part").select("p_partkey", annotation.gene_symbol(gene, alias, kegg, F.col("p_brand")).alias("symbol"))


@query("WITH p AS (SELECT DISTINCT o_orderkey % 11000 AS human, o_custkey * 7 + day(o_orderdate) AS mouse FROM orders) SELECT human, mouse FROM p WHERE human IN (SELECT human FROM p GROUP BY 1 HAVING count(*) = 1) AND mouse IN (SELECT mouse FROM p GROUP BY 1 HAVING count(*) = 1)")
def one_to_one(spark, d):
    pairs = table(spark, d, "orders").select((F.col("o_orderkey") % 11000).alias("human"), (F.col("o_custkey") * 7 + F.dayofmonth("o_orderdate")).alias("mouse"))
    return annotation.one_to_one(pairs, "human", "mouse")


@query("SELECT l_suppkey AS genome, p_size AS ko, sum(n)::BIGINT AS n FROM (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2) JOIN part ON l_partkey = p_partkey GROUP BY 1, 2")
def genome_kos(spark, d):
    presence = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("genome"), F.col("l_partkey").alias("gene")).agg(F.count("*").alias("n"))
    return annotation.summed_by_genome(presence, table(spark, d, "part").select(F.col("p_partkey").alias("gene"), F.col("p_size").alias("ko")))


@query("SELECT p_brand, p_type, n, n2 FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, n2, p_type) AS k FROM (SELECT p_brand, p_type, count(*) AS n, count(DISTINCT p_size) AS n2 FROM part GROUP BY 1, 2)) WHERE k = 1")
def top_group(spark, d):
    return annotation.top_group(table(spark, d, "part"), "p_brand", "p_type", "p_size")


@query("SELECT event_type AS gene, min(event_id) AS first, max(event_id) AS last FROM events WHERE user_id % 10 <> 3 GROUP BY 1")
def line_ranges(spark, d):
    lines = table(spark, d, "events").select(F.when(F.col("user_id") % 10 == 3, "Sample").otherwise(F.col("user_id").cast("string")).alias("sample"), F.col("event_type").alias("gene"), F.col("event_id").alias("line"))
    return annotation.line_ranges(lines)


@query("SELECT DISTINCT 'acc' || s_nationkey AS accession FROM part JOIN supplier ON p_partkey % 200 = s_suppkey UNION SELECT p_type FROM part WHERE p_size = 7")
def accessions(spark, d):
    panel = table(spark, d, "part").select(F.concat(F.lit("g"), (F.col("p_partkey") % 200).cast("string"), F.lit("_"), F.col("p_size").cast("string")).alias("allele"), F.when(F.col("p_size") == 7, F.col("p_type")).alias("accession"))
    names = table(spark, d, "supplier").select(F.concat(F.lit("g"), F.col("s_suppkey").cast("string")).alias("genome"), F.concat(F.lit("acc"), F.col("s_nationkey").cast("string")).alias("accession"))
    return annotation.accessions(panel, names)


@query(f"""WITH x AS (SELECT ident, gene, log2(mean) AS y, log2(sum(mean) OVER g - mean) AS x FROM ({STATS}) WINDOW g AS (PARTITION BY gene)), l AS (SELECT ident, covar_pop(y, x) / var_pop(x) AS b, avg(x) AS mx, avg(y) AS my FROM x WHERE x IS NOT NULL GROUP BY 1)
SELECT ident, gene, round(y - my - b * (x - mx), 6) AS residual FROM x JOIN l USING (ident)""")
def contamination_residuals(spark, d):
    from pyspark.sql import Window

    s = table(spark, d, "part").groupBy(F.col("p_type").alias("gene"), F.col("p_brand").alias("ident")).agg(F.avg("p_size").alias("mean"))
    m = s.withColumn("ref_mean", F.sum("mean").over(Window.partitionBy("gene")) - F.col("mean"))
    return annotation.contaminated(m, s.select("ident"), 2.0).select("ident", "gene", r6("residual", "residual"))


@query("""WITH c AS (SELECT p_partkey AS cell, p_brand AS ident, p_type AS gene, p_size AS v FROM part), z AS (SELECT ident, count(*) AS cells FROM c GROUP BY 1), s AS (SELECT 's' || length(gene) AS signature, gene FROM (SELECT DISTINCT gene FROM c)), g AS (SELECT signature, count(*) AS genes FROM s GROUP BY 1)
SELECT ident, signature, count(*) AS n, round(count(*) / (any_value(cells) * any_value(genes)), 6) AS alpha, round(sum(v) / (any_value(cells) * any_value(genes)), 6) AS mean FROM c JOIN s USING (gene) JOIN z USING (ident) JOIN g USING (signature) WHERE v > 0 GROUP BY 1, 2""")
def signature_stats(spark, d):
    p = table(spark, d, "part")
    cells = p.select(F.col("p_partkey").alias("cell"), F.col("p_type").alias("gene"), F.col("p_size").alias("count"))
    sets = p.select(F.concat(F.lit("s"), F.length("p_type").cast("string")).alias("signature"), F.col("p_type").alias("gene"))
    out = annotation.signature_stats(cells, p.select(F.col("p_partkey").alias("cell"), F.col("p_brand").alias("ident")), sets)
    return out.select("ident", "signature", "n", r6("alpha", "alpha"), r6("mean", "mean"))


# Panels

RANKED = f"""b AS ({BRANDS}), u AS (SELECT s.sample, g.gene, coalesce(b.value, 0) AS v FROM (SELECT DISTINCT sample FROM b) s CROSS JOIN (SELECT DISTINCT gene FROM b) g LEFT JOIN b ON b.sample = s.sample AND b.gene = g.gene),
k AS (SELECT sample, gene, rank() OVER (PARTITION BY gene ORDER BY v) + (count(*) OVER (PARTITION BY gene, v) - 1) / 2 AS r FROM u), rho AS (SELECT x.gene AS g1, y.gene AS g2, count(*) AS n, corr(x.r, y.r) AS rho FROM k x JOIN k y ON x.sample = y.sample AND x.gene < y.gene GROUP BY 1, 2)"""


SLOT = "CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 'a' WHEN p_type IN ('MEDIUM', 'PROMO') THEN 'b' ELSE 'c' END"


def _choices(spark, d):
    slot = F.when(F.col("p_type").isin("ECONOMY", "SMALL"), "a").when(F.col("p_type").isin("MEDIUM", "PROMO"), "b").otherwise("c")
    return table(spark, d, "part").select(F.col("p_size").alias("genome"), slot.alias("slot"), F.col("p_brand").alias("gene"))


@query(f"""WITH {RANKED}, c AS (SELECT DISTINCT p_size AS genome, {SLOT} AS slot, p_brand AS gene FROM part), t AS (SELECT x.genome, x.gene AS a, y.gene AS b, z.gene AS c FROM c x JOIN c y USING (genome) JOIN c z USING (genome) WHERE x.slot = 'a' AND y.slot = 'b' AND z.slot = 'c'),
f AS (SELECT g1, g2, rho FROM rho UNION ALL SELECT g2, g1, rho FROM rho UNION ALL SELECT gene, gene, 1.0 FROM (SELECT DISTINCT gene FROM b)),
m AS (SELECT genome, a, b, c, (3 + 2 * (coalesce(p.rho, 0) + coalesce(q.rho, 0) + coalesce(s.rho, 0))) / 9 AS rho FROM t LEFT JOIN f p ON p.g1 = a AND p.g2 = b LEFT JOIN f q ON q.g1 = a AND q.g2 = c LEFT JOIN f s ON s.g1 = b AND s.g2 = c)
SELECT genome, a, b, c, round(rho, 6) AS rho FROM (SELECT *, row_number() OVER (PARTITION BY genome ORDER BY round(rho, 9) DESC, a, b, c) AS k FROM m) WHERE k = 1 AND rho > 0.35""")
def chosen_panels(spark, d):
    """Each genome's alleles whose rank correlations have the largest mean."""
    out = panels.chosen_panels(_choices(spark, d), panels.rank_correlations(brands(spark, d)).select("g1", "g2", "rho"), ["a", "b", "c"], 0.35)
    return out.select("genome", "a", "b", "c", r6("rho", "rho"))


@query(f"""SELECT genome, slot, gene FROM (SELECT *, row_number() OVER (PARTITION BY genome, slot ORDER BY {_hash("'3:' || genome || ':' || slot || ':' || gene")}, gene) AS k FROM (SELECT DISTINCT p_size AS genome, {SLOT} AS slot, p_brand AS gene FROM part)) WHERE k = 1""")
def random_panels(spark, d):
    return panels.random_panels(_choices(spark, d))


# Mixed models; tests check the fits

def _with_covariates(spark, d):
    meta = metadata(spark, d).select("sample", "cohort", F.when(F.col("dx") == "IBD", 1).otherwise(0).alias("dx"), ((F.col("sample") * 7) % 60).alias("age"), (F.col("sample") % 2).alias("sex"))
    return brands(spark, d).join(meta, "sample").withColumnRenamed("gene", "name")


@query()
def abundance_mixed_models(spark, d):
    """Abundance by diagnosis, age and sex with a random intercept by cohort, for each genome."""
    return mixed.linear_mixed(_with_covariates(spark, d), "value", ["dx", "age", "sex"])


@query()
def clade_mixed_models(spark, d):
    """Membership of a clade by diagnosis with a random intercept by cohort, for each node."""
    x = _with_covariates(spark, d)
    middle = x.groupBy("name").agg(F.median("value").alias("m"))
    return mixed.binomial_mixed(x.join(middle, "name").withColumn("in_node", F.when(F.col("value") > F.col("m"), 1).otherwise(0)), "in_node", ["dx"])
