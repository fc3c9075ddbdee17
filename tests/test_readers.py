"""Readers through files that the tests write."""

import pytest
from pyspark.sql import functions as F

from strainspark.sources import text


@pytest.fixture
def small_splits(spark):
    """Files of a few lines fall into several blocks."""
    keys = {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_lines_are_numbered_over_blocks(spark, tmp_path, small_splits):
    content = [f"line {k} " + "x" * (k % 13) for k in range(200)]
    (tmp_path / "a.txt").write_text("\r\n".join(content) + "\n")
    (tmp_path / "b.txt").write_text("one\ntwo")
    got = text.read_lines(spark, str(tmp_path / "*.txt")).collect()
    assert len({r.block for r in got}) > 5
    assert [r.line for r in sorted((r for r in got if r.file.endswith("a.txt")), key=lambda r: r.line_no)] == content
    assert sorted((r.line_no, r.line) for r in got if r.file.endswith("b.txt")) == [(0, "one"), (1, "two")]


def test_sequences_over_blocks(spark, tmp_path, small_splits):
    records = {f"s{k}": "ACGT" * (3 + k % 40) for k in range(60)}
    (tmp_path / "x.fa").write_text("".join(f">{k} note\n" + "".join(v[i : i + 30] + "\n" for i in range(0, len(v), 30)) for k, v in records.items()))
    (tmp_path / "y.fq").write_text("".join(f"@{k}\n{v}\n+\n{'I' * len(v)}\n" for k, v in records.items()))
    (tmp_path / "z.txt").write_text("neither\n")
    got = text.read_sequences(spark, str(tmp_path / "*")).collect()
    assert len(got) == 120
    assert {r.id: r.seq for r in got if r.file.endswith("x.fa")} == records == {r.id: r.seq for r in got if r.file.endswith("y.fq")}
    assert all((r.qual is None) == r.file.endswith("x.fa") for r in got)
    assert {r.path.rsplit("/", 1)[1] for r in text.files_of(spark, str(tmp_path), r"\.f[aq]$").collect()} == {"x.fa", "y.fq"}


def test_delimited_text_is_sniffed(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n3,4\n")
    (tmp_path / "b.tsv").write_text("x\ty\nr1\t1\t2\nr2\t3\t4\n")
    (tmp_path / "c.txt").write_text("1;2;3\n4;5;6\n")
    read = lambda f: text.read_delimited(spark, str(tmp_path / f))
    assert read("a.csv").columns == ["x", "y"] and sorted(map(tuple, read("a.csv").collect())) == [("1", "2"), ("3", "4")]
    assert read("b.tsv").columns == ["row_name", "x", "y"] and read("b.tsv").count() == 2
    assert read("c.txt").columns == ["V1", "V2", "V3"] and read("c.txt").count() == 2


def lines(spark, content):
    return spark.createDataFrame([("f", k, x) for k, x in enumerate(content.split("\n"))], "file string, line_no long, line string")


def test_headers_ids_and_hierarchies(spark):
    sam = lines(spark, "@HD\tVN:1.6\n@SQ\tSN:c:1\tLN:9\nr\t0\tc\t1\t9\t1M\t*\t0\t0\tA\tI")
    assert [(r.kind, r.fields) for r in text.sam_headers(sam).collect()] == [("@HD", {"VN": "1.6"}), ("@SQ", {"SN": "c:1", "LN": "9"})]
    gff = lines(spark, "#x\nc\tp\tCDS\t1\t9\t.\t+\t0\tID=GUT_1_00012;gene=a\nc\tp\tCDS\t1\t9\t.\t+\t0\tID=GUT_x;n=_12")
    assert [r.locus for r in text.locus_ids(gff).collect()] == ["GUT_1_00012"]
    kegg = lines(spark, "A09100 Metabolism\nB  09101 Carbohydrates\nC    00010 Glycolysis / x [PATH:hsa00010]\nD      3101 HK3; hexokinase\nD      226 ALDOA\nB  next\nD  9 LOST\nC    00020 Citrate cycle\nD      47 ACLY; a")
    assert {(r.pathway, r.gene) for r in text.kegg_hierarchy(kegg).collect()} == {("Glycolysis_/_x", "HK3"), ("Glycolysis_/_x", "ALDOA"), ("Citrate_cycle", "ACLY")}
    assert {r.gene for r in text.kegg_hierarchy(kegg, drop="Glyco").collect()} == {"ACLY"}


def test_merged_matrices_and_writers(spark, tmp_path):
    a = spark.createDataFrame([("g", "1", 2), ("g", "1", 3), ("h", "1", 1)], "gene string, cell string, count long")
    b = spark.createDataFrame([("g", "1", 4), ("k", "2", 1)], "gene string, cell string, count long")
    got = {(r.gene, r.cell): r["count"] for r in text.merged_counts({"A": a, "B": b}, least_cells=2).collect()}
    assert got == {("g", "A.1"): 5, ("g", "B.1"): 4}
    assert text.label_column(spark.createDataFrame([("a", "x", "1"), ("a", "y", "1")], "p string, q string, r string")) == "q"
    sets = text.nexus_charsets(spark.createDataFrame([("rpoB", 300), ("dnaG", 120)], "name string, length long")).first().value
    assert sets == "#nexus\nbegin sets;\n  charset dnaG = 1-120;\n  charset rpoB = 121-420;\nend;"
    text.write_sheets(a.withColumn("contrast", F.col("gene")), "contrast", str(tmp_path / "m"))
    assert {p.name for p in (tmp_path / "m").iterdir() if p.is_dir()} == {"contrast=g", "contrast=h"}
    # Chunks that were written apart are read as one table.
    assert spark.read.option("header", "true").csv(str(tmp_path / "m"), sep="\t").count() == 3
