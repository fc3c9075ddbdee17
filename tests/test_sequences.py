from pyspark.sql import functions as F

from strainspark.functions import sequence as seq
from strainspark.operators import pileup
from strainspark.sources import text
from strainspark.sources.trees import newick_edges, parse_newick


def lines(spark, content):
    return spark.createDataFrame([("f", k, x) for k, x in enumerate(content.split("\n"))], "file string, line_no int, line string")


def one(spark, expression, **columns):
    return spark.createDataFrame([tuple(columns.values())], list(columns)).select(expression).first()[0]


def test_reverse_complement(spark):
    assert one(spark, seq.reverse_complement(F.col("s")), s="ACGTNacgtn") == "nacgtNACGT"


def test_cigar(spark):
    c = "2S5M1I3M1D2M"
    assert one(spark, seq.matched_length(F.col("c")), c=c) == 10
    assert one(spark, seq.read_length(F.col("c")), c=c) == 13
    assert one(spark, seq.expand_cigar(F.col("c")), c="3M1I2M") == "MMMIMM"
    assert round(one(spark, seq.identity(F.col("c"), F.lit(0)), c=c), 3) == 0.769


def test_codons(spark):
    rows = spark.range(1, 5)
    get = lambda strand: [r[0] for r in rows.select(seq.codon_position(F.col("id"), F.lit(1), F.lit(strand))).collect()]
    assert get("+") == [1, 2, 3, 1]
    assert get("-") == [3, 2, 1, 3]


def test_similarity(spark):
    assert one(spark, seq.sequence_similarity(F.col("a"), F.col("b")), a="ACNT", b="AGGT") == 0.75


def test_fasta(spark):
    records = text.fasta_records(lines(spark, ">a x\nAC\nGT\n>b\n>c\nTT\n>a y\nGG"))
    assert sorted((r.id, r.seq) for r in records.collect()) == [("a", "ACGT"), ("a", "GG"), ("c", "TT")]
    assert {r.id: r.seq for r in text.fasta_dictionary(records).collect()} == {"a": "GG", "c": "TT"}
    assert text.sequence_format(lines(spark, ">a\nAC")).first().format == "fasta"
    assert text.sequence_format(lines(spark, "@a\nAC\n+\nII")).first().format == "fastq"


def test_fastq(spark):
    rows = text.fastq_records(lines(spark, "@r1 z\nACG\n+\nIII\n@r2\nTT\nx\nII")).collect()
    assert [(r.id, r.seq, r.qual) for r in rows] == [("r1", "ACG", "III")]


def test_gff(spark):
    rows = text.gff_features(lines(spark, "##gff\nc1\tp\tCDS\t2\t4\t.\t-\t0\tID=x_1;gene=dnaG_2;note=1\nc1\tp\tCDS\t9\t12\t.\t+\t0\tID=y"), ["dnaG"]).collect()
    assert [(r.contig, r.beg, r.end, r.strand, r.id, r.gene) for r in rows] == [("c1", 2, 4, "-", "x_1", "dnaG")]
    contigs = spark.createDataFrame([("c1", "AACGT")], "id string, seq string")
    found = pileup.genes_at(spark.createDataFrame([("g", "x", "c1", 2, 4, "-")], "gene string, id string, contig string, beg int, end int, strand string"), contigs)
    assert found.first().seq == "CGT"


def test_sam_to_consensus(spark):
    sam = text.sam_records(lines(spark, "@HD\nr1\t0\tc\t1\t60\t4M\t*\t0\t0\tACGT\tIIII\tNM:i:0\nr2\t0\tc\t1\t60\t1S3M\t*\t0\t0\tTACG\tIII!\tXM:i:1\nr3\t0\t*\t0\t0\t*\t*\t0\t0\tA\tI"))
    kept = pileup.identity_filter(sam, 50)
    assert sorted(r.qname for r in kept.collect()) == ["r1", "r2"]
    counts = {(r.pos, r.allele): r.n for r in pileup.allele_counts(pileup.aligned_bases(kept)).collect()}
    assert counts == {(1, "A"): 2, (2, "C"): 2, (3, "G"): 1, (4, "T"): 1}
    rows = spark.createDataFrame([("c", 1, "A", 5), ("c", 1, "C", 1), ("c", 2, "T", 3), ("c", 2, "A", 3)], "contig string, pos int, allele string, n long")
    report = {(r.pos, r.allele): (r.consensus, r.freq) for r in pileup.pileup_report(rows, ["contig", "pos"]).collect()}
    assert report == {(1, "A"): ("A", 100.0), (2, "A"): ("A", 50.0), (2, "T"): ("A", 50.0)}


def test_carried_sequences(spark):
    sam = text.sam_records(lines(spark, "q\t0\tc\t1\t60\t3M\t*\t0\t0\tACG\tABC\nq\t272\tc\t9\t0\t3M\t*\t0\t0\t*\t*"))
    second = pileup.carried_sequences(sam).filter("flag = 272").first()
    assert (second.seq, second.qual) == ("CGT", "CBA")


def test_uc(spark):
    row = lambda kind, member, centroid: (kind, 0, 0, "", "", "", "", "", member, centroid)
    rows = spark.createDataFrame([row("S", "g1_1_9", "*"), row("H", "g2_2_4", "g1_1_9")], text.UC)
    assert {(r.genome, r.allele) for r in text.uc_map(rows).collect()} == {("g1_1", "g1_1_9"), ("g2_2", "g1_1_9")}


def test_files(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">x\nAC\nGT\n")
    assert [(r.id, r.seq) for r in text.read_fasta(spark, str(tmp_path / "a.fa")).collect()] == [("x", "ACGT")]
    m = tmp_path / "m"
    m.mkdir()
    (m / "matrix.mtx").write_text("%%MatrixMarket\n2 2 3\n1 1 5\n2 1 1\n2 2 7\n")
    (m / "features.tsv").write_text("g\ng\n")
    (m / "barcodes.tsv").write_text("c1\nc2\n")
    assert {(r.gene, r.cell): r["count"] for r in text.read_matrix_market(spark, str(m)).collect()} == {("g", "c1"): 6.0, ("g", "c2"): 7.0}


def test_newick(spark):
    rows = parse_newick("((a:1,b:2)n2:0.5,c:3)n1;")
    assert [r[3] for r in rows if r[4]] == ["a", "b", "c"]
    names = {r[0]: r[3] for r in rows}
    assert {(r[3], names.get(r[1])) for r in rows} == {("n1", None), ("n2", "n1"), ("a", "n2"), ("b", "n2"), ("c", "n1")}
    edges = newick_edges(spark.createDataFrame([("t", "((a,b)n2,c)n1;")], "tree string, newick string"))
    assert edges.count() == 5


def test_concatenation(spark):
    rows = spark.createDataFrame([("s1", "g1", "AC"), ("s2", "g2", "TTT")], "sample string, gene string, seq string")
    genes = spark.createDataFrame([("g1", 1), ("g2", 2)], "gene string, ord int")
    assert {r.sample: r.seq for r in pileup.concatenated(rows, genes).collect()} == {"s1": "ACNNN", "s2": "NNTTT"}


def test_annotation_tables(spark):
    assert text.fix_rank_codes(spark.createDataFrame([("R1",), ("S1",)], "rank string")).collect()[0].rank == "D"
    eggs = "\t".join(map(str, range(20)))
    row = text.clean_eggnog(lines(spark, eggs + "\nshort")).collect()
    assert len(row) == 1 and row[0].groups == "18,19"
    assert text.clean_interpro(lines(spark, "\t".join(["a|b: c"] * 13))).first().field_0 == "a,b:c"
    assert [tuple(r) for r in text.charsets(lines(spark, "charset dnaG = 1-300;")).collect()] == [("dnaG", 1, 300)]
