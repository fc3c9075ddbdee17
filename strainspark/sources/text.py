"""Line-oriented readers: every format has an explicit schema; nothing is inferred.

Readers take a path or glob that Spark reads, gzip included, and return lazy
tables.  Records of several lines are put together from (file, line number), in
the order of the lines of each file.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, line_no, line), numbered from 0 in each file; files are split as Spark splits them.

    A block's lines are consecutive in one partition, so a line's number is its place
    there plus the lines of the file's earlier blocks, which a first pass counts: a
    row a block, whatever the files' sizes.
    """
    meta = F.col("_metadata")
    rows = spark.read.text(path).select(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("__at"), F.regexp_replace("value", "\r$", "").alias("line"))
    blocks = rows.groupBy("file", "block").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first")).drop("__first", "__n")
    return rows.join(blocks, ["file", "block"]).select("file", "block", (F.col("__at") + F.col("__before")).alias("line_no"), "line")


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """(line) of formats where a line is a record of its own; nothing is numbered."""
    return spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("line"))


def files_of(spark: SparkSession, path: str, pattern: str = "") -> DataFrame:
    """(path, length) of the files below a path or glob whose path fits a pattern; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return found.filter(F.rlike("path", F.lit(pattern)))


def read_table(spark: SparkSession, path: str, schema: str, sep: str = "\t", header: bool = False) -> DataFrame:
    """Delimited text by a given schema."""
    return spark.read.schema(schema).csv(path, sep=sep, header=header, nullValue="")


# FASTA and FASTQ


def fasta_records(lines: DataFrame) -> DataFrame:
    """(id, header, seq, ordinal) of FASTA lines; sequences of several lines are joined, records without a sequence left out.

    Headers are counted within a block and added to those of the file's earlier
    blocks; lines without a ``block`` column are one block a file.
    """
    lines = lines if "block" in lines.columns else lines.withColumn("block", F.lit(0).cast("long"))
    head = F.startswith("line", F.lit(">"))
    heads = lines.groupBy("file", "block").agg(F.count(F.when(head, 1)).alias("__n"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__n")
    w = Window.partitionBy("file", "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("__here", F.sum(F.when(head, 1).otherwise(0)).over(w)).join(heads, ["file", "block"]).withColumn("record", F.col("__here") + F.col("__before")).filter("record > 0")
    header = F.max(F.when(head, F.col("line"))).alias("header")
    parts = F.collect_list(F.when(~head, F.struct("line_no", F.trim("line").alias("s"))))
    records = marked.groupBy("file", "record").agg(header, parts.alias("parts"))
    seq = F.array_join(F.transform(F.array_sort("parts"), lambda x: x["s"]), "")
    out = records.select(F.regexp_extract("header", r"^>(\S*)", 1).alias("id"), F.substring("header", 2, 1 << 30).alias("header"), seq.alias("seq"), F.struct("file", "record").alias("ordinal"))
    return out.filter("seq <> ''")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    return fasta_records(read_lines(spark, path)).select("id", "header", "seq", "ordinal")


def fasta_dictionary(records: DataFrame) -> DataFrame:
    """(id, seq): of records of one id the last."""
    return records.groupBy("id").agg(F.max_by("seq", "ordinal").alias("seq"))


def fastq_records(lines: DataFrame, *keep: str) -> DataFrame:
    """(id, seq, plus, qual) of four-line records whose third line starts with +."""
    quad = lines.filter("line <> ''").withColumn("record", F.floor(F.col("line_no") / 4)).withColumn("k", F.col("line_no") % 4)
    pick = lambda k: F.max(F.when(F.col("k") == k, F.col("line")))
    out = quad.groupBy("file", "record").agg(pick(0).alias("head"), pick(1).alias("seq"), pick(2).alias("plus"), pick(3).alias("qual"))
    return out.filter(F.startswith("plus", F.lit("+"))).select(*keep, F.regexp_extract("head", r"^@(\S*)", 1).alias("id"), "seq", "plus", "qual")


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    return fastq_records(read_lines(spark, path))


def sequence_format(lines: DataFrame) -> DataFrame:
    """(file, format): fastq if line 0 starts with @ and line 2 with +, fasta if line 0 starts with >, else unknown."""
    first = F.max(F.when(F.col("line_no") == 0, F.substring("line", 1, 1)))
    third = F.max(F.when(F.col("line_no") == 2, F.substring("line", 1, 1)))
    return lines.filter("line_no < 3").groupBy("file").agg(first.alias("a"), third.alias("b")).select("file", F.when(F.col("a") == ">", "fasta").when((F.col("a") == "@") & (F.col("b") == "+"), "fastq").otherwise("unknown").alias("format"))


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """(file, id, seq, qual) of files that may be FASTA or FASTQ, each by its own first lines; qual is null for FASTA."""
    lines = read_lines(spark, path)
    of = sequence_format(lines)
    some = lambda kind: lines.join(of.filter(F.col("format") == kind).select("file"), "file", "left_semi")
    fasta = fasta_records(some("fasta")).select(F.col("ordinal.file").alias("file"), "id", "seq", F.lit(None).cast("string").alias("qual"))
    fastq = fastq_records(some("fastq"), "file").select("file", "id", "seq", "qual")
    return fasta.union(fastq)


# Genes and features

GENE_FILE = "contig string, gene string, beg int, end int, strand string, seq string"


def read_gene_file(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, GENE_FILE)


def gff_features(lines: DataFrame, genes: list[str] | None = None) -> DataFrame:
    """(contig, feature, beg, end, strand, id, gene) of the feature lines, up to the FASTA section; optionally of some genes."""
    f = F.split("line", "\t")
    rows = lines.filter((F.size(f) >= 9) & ~F.startswith("line", F.lit("#")))
    gene = F.regexp_extract(f[8], r"(?:^|;)gene=([^;_]*)", 1)
    out = rows.select(f[0].alias("contig"), f[2].alias("feature"), f[3].cast("int").alias("beg"), f[4].cast("int").alias("end"), f[6].alias("strand"), F.regexp_replace(F.split(f[8], ";")[0], "^ID=", "").alias("id"), F.nullif(gene, F.lit("")).alias("gene"))
    return out.filter(F.col("gene").isin(genes)) if genes else out


def locus_ids(lines: DataFrame) -> DataFrame:
    """(locus), each once: ids of a GFF's features that end in an underline and digits."""
    f = F.split("line", "\t")
    name = F.regexp_extract(F.split(f[8], ";")[0], "^ID=(.*)$", 1)
    return lines.filter((F.size(f) >= 9) & ~F.startswith("line", F.lit("#"))).select(name.alias("locus")).filter(F.rlike("locus", F.lit(r"_[0-9]+$"))).distinct()


def gtf_genes(lines: DataFrame) -> DataFrame:
    """(gene_id, locus_tag) of exon and gene rows, the first of each gene_id; incomplete rows are left out."""
    f = F.split("line", "\t")
    rows = lines.filter((F.size(f) >= 9) & f[2].isin("exon", "gene")).select("line_no", F.nullif(F.regexp_extract(f[8], r'gene_id "([^"]*)"', 1), F.lit("")).alias("gene_id"), F.nullif(F.regexp_extract(f[8], r'locus_tag "([^"]*)"', 1), F.lit("")).alias("locus_tag"))
    return rows.dropna().groupBy("gene_id").agg(F.min_by("locus_tag", "line_no").alias("locus_tag"))


# Alignments

SAM_FIELDS = ["qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual"]
SAM_INTS = {"flag", "pos", "mapq", "pnext", "tlen"}


def sam_records(lines: DataFrame) -> DataFrame:
    """The eleven fixed fields, ``tags`` as an array, and the line number; header lines are left out."""
    f = F.split("line", "\t")
    fixed = [(f[k].cast("int") if name in SAM_INTS else f[k]).alias(name) for k, name in enumerate(SAM_FIELDS)]
    rest = F.when(F.size(f) > 11, F.slice(f, F.lit(12), F.size(f) - 11)).otherwise(F.array().cast("array<string>"))
    return lines.filter(~F.startswith("line", F.lit("@")) & (F.size(f) >= 11)).select("line_no", *fixed, rest.alias("tags"))


def sam_headers(lines: DataFrame) -> DataFrame:
    """(kind, fields) of the header lines: @SQ and the like, with their tag:value fields as a map."""
    f = F.split("line", "\t")
    pairs = F.transform(F.filter(F.slice(f, 2, F.size(f)), lambda x: F.contains(x, F.lit(":"))), lambda x: F.struct(F.substring_index(x, ":", 1).alias("k"), F.regexp_replace(x, "^[^:]*:", "").alias("v")))
    return lines.filter(F.startswith("line", F.lit("@"))).select(f[0].alias("kind"), F.map_from_entries(pairs).alias("fields"))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    return sam_records(read_lines(spark, path))


PILEUP = "sample string, contig string, pos int, gene string, ref string, codon int, consensus string, allele string, counts long, freq double"


def read_pileup(spark: SparkSession, path: str) -> DataFrame:
    """Pileup rows; a table written with partitionBy('gene') is pruned by filters on gene."""
    return read_table(spark, path, PILEUP, header=True)


BLAST6 = "qseqid string, sseqid string, pident double, length int, mismatch int, gapopen int, qstart int, qend int, sstart int, send int, evalue double, bitscore double"


def read_blast(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, BLAST6)


UC = "kind string, cluster int, length int, identity string, strand string, c5 string, c6 string, cigar string, member string, centroid string"


def read_uc(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, UC)


def uc_map(uc: DataFrame) -> DataFrame:
    """(genome, allele): first two _ parts of each member, and its cluster's centroid; * stands for the member itself."""
    allele = F.when(F.col("centroid") == "*", F.col("member")).otherwise(F.col("centroid"))
    return uc.select(F.substring_index("member", "_", 2).alias("genome"), allele.alias("allele")).distinct()


# Annotation tables

EGGNOG_FIELDS = 22


def clean_eggnog(lines: DataFrame) -> DataFrame:
    """Rows of 20 to 22 fields, padded to 22; the two orthologous-group fields are joined unless the second is NA|NA|NA."""
    f = F.split("line", "\t")
    wide = F.concat(f, F.array_repeat(F.lit(""), EGGNOG_FIELDS - 20))
    at = lambda k: wide[k]
    group = F.when(at(19) == "NA|NA|NA", at(18)).otherwise(F.concat_ws(",", at(18), at(19)))
    rows = lines.filter((F.size(f) >= 20) & ~F.startswith("line", F.lit("#")))
    return rows.select(*[at(k).alias(f"field_{k}") for k in range(16)], group.alias("groups"))


def clean_interpro(lines: DataFrame) -> DataFrame:
    """Rows of 13 to 15 fields, padded to 15; | becomes a comma and ': ' a colon."""
    f = F.split("line", "\t")
    rows = lines.filter(F.size(f).between(13, 15))
    wide = F.concat(f, F.array_repeat(F.lit(""), 2))
    return rows.select(*[F.regexp_replace(F.regexp_replace(wide[k], r"\|", ","), ": ", ":").alias(f"field_{k}") for k in range(15)])


#: The rank codes of a taxonomic report and what they become.
RANK_CODES = {"R1": "D", "R2": "P", "R3": "C", "R4": "O", "R5": "F", "R6": "G", "R7": "S"}


def fix_rank_codes(rows: DataFrame, column: str = "rank") -> DataFrame:
    code = F.trim(column)
    mapped = F.create_map(*[F.lit(x) for pair in RANK_CODES.items() for x in pair])
    return rows.withColumn(column, F.coalesce(F.try_element_at(mapped, code), F.col(column)))


def read_key_values(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of a two-column table; commas on either side list several, each pair once."""
    rows = read_table(spark, path, "keys string, vals string")
    return rows.select(F.explode(F.split("keys", ",")).alias("key"), "vals").select("key", F.explode(F.split("vals", ",")).alias("value")).distinct()


def read_gene_sets(spark: SparkSession, path: str) -> DataFrame:
    """(name, genes) of lines of a name and a comma-joined list."""
    return read_table(spark, path, "name string, genes string").select("name", F.split("genes", ",").alias("genes"))


def charsets(lines: DataFrame) -> DataFrame:
    """(gene, beg, end) of the charset lines of a NEXUS file."""
    p = r"(?i)charset\s+(\S+?)\s*=\s*(\d+)\s*-\s*(\d+)"
    part = lambda k: F.regexp_extract("line", p, k)
    return lines.filter(F.rlike("line", F.lit(p))).select(part(1).alias("gene"), part(2).cast("int").alias("beg"), part(3).cast("int").alias("end"))


# Delimited text without a schema


def _head(spark: SparkSession, path: str, n: int) -> list[str]:
    """The first ``n`` lines; the reader stops there."""
    return [r["value"] for r in spark.read.text(path).limit(n).collect()]


def sniffed_separator(head: list[str]) -> str:
    """The separator that splits all first lines into as many fields, most of them; of equals tab, comma, semicolon, bar, blank."""
    best, many = "\t", 1
    for sep in "\t,;| ":
        sizes = {len(x.split(sep)) for x in head[1:] or head}
        if len(sizes) == 1 and min(sizes) > many:
            best, many = sep, min(sizes)
    return best


def read_delimited(spark: SparkSession, path: str, sep: str | None = None, header: bool | None = None) -> DataFrame:
    """Delimited text as strings; separator, header and row names are told from the first lines.

    The first line is a header if none of its fields is a number or if it has a field
    less than the second; in that case the first column holds row names and is
    called row_name.  Without a header columns are called V1, V2 and so on.
    """
    head = [x for x in _head(spark, path, 20) if x]
    if not head:
        return spark.createDataFrame([], "V1 string")
    sep = sep or sniffed_separator(head)
    names, width = head[0].split(sep), len((head[1:] or head)[0].split(sep))
    if header is None:
        header = len(names) == width - 1 or not any(re.fullmatch(r"[-+]?[0-9.]+([eE][-+]?[0-9]+)?", x) for x in names)
    columns = (["row_name"] * (width - len(names)) + names) if header else [f"V{k + 1}" for k in range(width)]
    rows = spark.read.schema(", ".join(f"c{k} string" for k in range(width))).csv(path, sep=sep, header=False)
    if header:
        first = F.concat_ws(sep, *[f"c{k}" for k in range(min(width, len(names)))])
        rows = rows.filter(first != F.lit(sep.join(names)))
    return rows.toDF(*columns)


def kegg_hierarchy(lines: DataFrame, keep: str | None = None, drop: str | None = None) -> DataFrame:
    """(pathway, gene) of a KEGG hierarchy: a C line names a pathway, the D lines below it its genes; patterns choose pathways.

    Blanks in pathway names become underlines.
    """
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    name = F.when(F.rlike("line", F.lit("^[A-C]")), F.when(F.startswith("line", F.lit("C")), F.regexp_extract("line", r"^C\s+\d+\s+(.*?)\s*(\[.*)?$", 1)).otherwise(F.lit("")))
    rows = lines.withColumn("pathway", F.last(name, ignorenulls=True).over(w)).filter(F.startswith("line", F.lit("D")) & (F.coalesce("pathway", F.lit("")) != ""))
    if keep:
        rows = rows.filter(F.rlike("pathway", F.lit(keep)))
    if drop:
        rows = rows.filter(~F.rlike("pathway", F.lit(drop)))
    return rows.select(F.regexp_replace("pathway", r"\s+", "_").alias("pathway"), F.regexp_extract("line", r"^D\s+(?:\d+\s+)?([^;\s]+)", 1).alias("gene")).distinct()


# Matrices


def label_column(labels: DataFrame) -> str:
    """The column of a label table with the most distinct values; of equals the first."""
    counts = labels.agg(*[F.approx_count_distinct(c, 0.01).alias(c) for c in labels.columns]).first()
    return max(labels.columns, key=lambda c: (counts[c], -labels.columns.index(c)))


def merged_counts(parts: dict[str, DataFrame], least_cells: int = 0, least_genes: int = 0, pattern: str | None = None) -> DataFrame:
    """(gene, cell, count) of several samples' matrices as one: cells are prefixed by their sample, genes that come
    twice in a cell are summed, then genes in fewer than ``least_cells`` cells go, then cells with fewer than ``least_genes`` genes."""
    out = None
    for sample, matrix in sorted(parts.items()):
        part = matrix.select("gene", F.concat(F.lit(f"{sample}."), F.col("cell").cast("string")).alias("cell"), "count")
        out = part if out is None else out.unionByName(part)
    out = out.filter(F.rlike("cell", F.lit(pattern))) if pattern else out
    out = out.groupBy("gene", "cell").agg(F.sum("count").alias("count")).filter("count > 0")
    kept = out.groupBy("gene").agg(F.count("*").alias("n")).filter(F.col("n") >= least_cells)
    out = out.join(kept.select("gene"), "gene", "left_semi")
    cells = out.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") >= least_genes)
    return out.join(cells.select("cell"), "cell", "left_semi")


def read_matrix_market(spark: SparkSession, prefix: str) -> DataFrame:
    """(gene, cell, count) of matrix.mtx with features.tsv and barcodes.tsv below ``prefix``; repeated genes are summed."""
    entries = read_lines(spark, f"{prefix}/matrix.mtx").filter(~F.startswith("line", F.lit("%")) & (F.col("line") != ""))
    head = entries.agg(F.min("line_no").alias("head"))
    f = F.split(F.trim("line"), r"\s+")
    cells = entries.join(F.broadcast(head)).filter("line_no > head").select(f[0].cast("long").alias("i"), f[1].cast("long").alias("j"), f[2].cast("double").alias("count"))
    name = lambda file, out, key: read_lines(spark, f"{prefix}/{file}").filter("line <> ''").select((F.col("line_no") + 1).cast("long").alias(key), F.split("line", "\t")[0].alias(out))
    return cells.join(name("features.tsv", "gene", "i"), "i").join(name("barcodes.tsv", "cell", "j"), "j").groupBy("gene", "cell").agg(F.sum("count").alias("count"))


def write_matrix_market(matrix: DataFrame, folder: str) -> None:
    """Writes (gene, cell, count) as triplets and two ordered label tables, each a folder of text."""
    ordinal = lambda c, out: matrix.select(c).distinct().select(c, F.row_number().over(Window.orderBy(c)).alias(out))
    genes, cells = ordinal("gene", "i"), ordinal("cell", "j")
    matrix.join(genes, "gene").join(cells, "cell").select(F.concat_ws(" ", "i", "j", "count")).write.mode("overwrite").text(f"{folder}/matrix")
    genes.orderBy("i").select("gene").write.mode("overwrite").text(f"{folder}/features")
    cells.orderBy("j").select("cell").write.mode("overwrite").text(f"{folder}/barcodes")


# Writers


def fasta_lines(records: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    return records.select(F.concat(F.lit(">"), key, F.lit("\n"), seq).alias("value"))


def write_fasta(records: DataFrame, path: str, by: str | None = None) -> None:
    """Text of FASTA records; ``by`` names a column that gives each value a folder of its own."""
    out = records.select(*([by] if by else []), F.concat(F.lit(">"), "id", F.lit("\n"), "seq").alias("value"))
    (out.write.partitionBy(by) if by else out.write).mode("overwrite").text(path)


def nexus_charsets(lengths: DataFrame, name: str = "name", length: str = "length") -> DataFrame:
    """(value) lines of a NEXUS sets block: each part of a concatenated alignment, in the order of names, with its first and last column.

    Parts are as few as a panel's genes; the running sum over them is one task.
    """
    last = F.sum(length).over(Window.orderBy(name).rowsBetween(Window.unboundedPreceding, 0))
    sets = lengths.select(name, (last - F.col(length) + 1).alias("first"), last.alias("last"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", F.format_string("  charset %s = %s-%s;", name, "first", "last").alias("t")))), lambda x: x["t"]), "\n")
    return sets.agg(F.concat(F.lit("#nexus\nbegin sets;\n"), body, F.lit("\nend;")).alias("value"))


def write_sheets(rows: DataFrame, by: str, folder: str) -> None:
    """A delimited table for each value of a column, each in a folder of its own."""
    rows.write.mode("overwrite").partitionBy(by).csv(folder, sep="\t", header=True)


def write_tsv(rows: DataFrame, path: str, header: bool = True) -> None:
    rows.write.mode("overwrite").csv(path, sep="\t", header=header)


def slug(text: Column) -> Column:
    """Lower case, runs of other than letters, digits, - and _ as one -."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^a-z0-9_-]+", "-"), r"^-+|-+$", "")
