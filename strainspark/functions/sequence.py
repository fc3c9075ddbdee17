"""Nucleotide sequences, CIGAR strings and codons, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUCLEOTIDES = "ACGTN"


def reverse_complement(seq: Column) -> Column:
    """Case is kept; letters other than ACGTN stay as they are."""
    return F.translate(F.reverse(seq), "acgtnACGTN", "tgcanTGCAN")


def cigar_operations(cigar: Column) -> Column:
    """array<struct<n int, op string>> of a CIGAR string."""
    counts = F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(1))
    letters = F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(2))
    return F.zip_with(counts, letters, lambda n, op: F.struct(n.cast("int").alias("n"), op.alias("op")))


def cigar_length(cigar: Column, letters: str) -> Column:
    """Sum of the lengths of the operations named in ``letters``."""
    return F.aggregate(cigar_operations(cigar), F.lit(0), lambda total, x: total + F.when(F.lit(letters).contains(x["op"]), x["n"]).otherwise(0))


def matched_length(cigar: Column) -> Column:
    return cigar_length(cigar, "M")


def read_length(cigar: Column) -> Column:
    """Bases of the read: everything but deletions and hard clips (which count as soft clips)."""
    return cigar_length(F.regexp_replace(cigar, "H", "S"), "MINSP=X")


def expand_cigar(cigar: Column) -> Column:
    """3M1I -> MMMI."""
    return F.array_join(F.transform(cigar_operations(cigar), lambda x: F.repeat(x["op"], x["n"])), "")


def mismatches(tags: Column) -> Column:
    """The count of the first NM:i: or XM:i: tag."""
    return F.try_to_number(F.regexp_extract(tags, r"[NX]M:i:(\d+)", 1), F.lit("999999999")).cast("int")


def identity(cigar: Column, mismatch: Column) -> Column:
    """Share of the read's bases that match."""
    return F.try_divide((matched_length(cigar) - mismatch).cast("double"), read_length(cigar))


def base_quality(quality: Column, offset: int = 33) -> Column:
    """array<int> of the qualities behind a quality string."""
    return F.transform(F.split(quality, ""), lambda c: F.ascii(c) - offset)


def codon_position(pos: Column, begin: Column, strand: Column) -> Column:
    """1 to 3 within the codon; on the minus strand 1 and 3 change places as a lookup of (pos - begin + 1) mod 3."""
    rest = F.pmod(pos - begin + 1, F.lit(3))
    plus = F.when(rest == 0, 3).otherwise(rest)
    minus = F.when(rest == 1, 3).when(rest == 0, 1).otherwise(2)
    return F.when(strand == "-", minus).otherwise(plus).cast("int")


def located(seq: Column, begin: Column, end: Column, strand: Column) -> Column:
    """Bases begin to end (1-based, inclusive), reverse complemented on the minus strand."""
    part = F.substring(seq, begin, end - begin + 1)
    return F.when(strand == "-", reverse_complement(part)).otherwise(part)


def one_hot(letter: Column) -> Column:
    """array<int> over ACGT; zeros for any other letter."""
    return F.array(*[F.when(letter == x, 1).otherwise(0) for x in NUCLEOTIDES[:4]])


def allele_order(letter: Column) -> Column:
    """Place of an allele in ACGTN, for ties; others come last."""
    at = F.array_position(F.array(*[F.lit(x) for x in NUCLEOTIDES]), letter)
    return F.when(at == 0, 9).otherwise(at)


def sequence_similarity(x: Column, y: Column) -> Column:
    """Share of places where the letters are equal or either is N; over the shorter length."""
    same = F.filter(F.zip_with(F.split(x, ""), F.split(y, ""), lambda a, b: (a == b) | (a == "N") | (b == "N")), lambda e: e)
    return F.try_divide(F.size(same).cast("double"), F.least(F.length(x), F.length(y)))
