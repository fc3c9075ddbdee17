"""Document fingerprints as homomorphic multiset hashes, in DataFrame functions only.

A text is a multiset of paragraphs: its lines, cut at the ends of sentences, without
blank ones.  A paragraph's MD5 gives a vector of 120 lanes of 0 or 1; a text's vector
is their sum, each lane modulo 2 ** 19, beside the number of paragraphs and a sum of
31-bit hashes.  So

* equal multisets have equal fingerprints, whatever the order of their paragraphs; two
  unlike ones agree with a probability of 2 ** -120 at most (with one of 2 ** -30 where
  every multiplicity differs by a multiple of 2 ** 19);
* the fingerprint of a text with a paragraph more or less is that of the text plus or
  minus the paragraph's (``inserted``, ``deleted``), lane by lane;
* twice a lane less the number of paragraphs is a sum of random signs, one for each
  paragraph.  The products of two texts' sums estimate the inner product of their
  multisets, from which ``likeness`` follows.

Three lanes share a 60-bit word, 20 bits apart; the bit above each lane catches its
carry and is cleared after each addition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strainspark.scratch import Scratch

LANE_BITS, SHIFTS = 19, 20
#: One bit in each of a word's three lanes; all bits of its lanes.
ONES = sum(1 << at for at in (0, SHIFTS, 2 * SHIFTS))
LANES = ONES * ((1 << LANE_BITS) - 1)
CARRIES = ONES << LANE_BITS
WORDS = 2 * SHIFTS
#: Bits of the hash that are summed whole.
SUM_MASK = (1 << 31) - 1

FINGERPRINT = "struct<n:bigint,total:bigint,words:array<bigint>>"


def paragraphs(text: Column) -> Column:
    """The text's lines, cut after . ! or ? before spaces, without those of white space only."""
    cut = F.split(F.regexp_replace(text, r"([.!?])[ \t\r]+", "$1\n"), "\n")
    return F.filter(cut, lambda x: F.rlike(x, F.lit(r"[^ \t-\r]")))


def _hashes(paragraph: Column) -> Column:
    digest = F.md5(paragraph)
    half = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("long")
    return F.struct(half(1).alias("a"), half(16).alias("b"))


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it occurs in there."""
    return F.transform(F.array(value), use)[0]


def of_hashes(hashes: Column) -> Column:
    """The fingerprint of an array of paragraph hashes.  A word is one pass over the array; the sums can't pass 63 bits."""
    def word(half: str, shift: int) -> Column:
        return F.aggregate(hashes, F.lit(0).cast("long"), lambda held, h: (held + F.shiftright(h[half], shift).bitwiseAND(F.lit(ONES))).bitwiseAND(F.lit(LANES)))

    total = F.aggregate(hashes, F.lit(0).cast("long"), lambda held, h: held + h["b"].bitwiseAND(F.lit(SUM_MASK)))
    words = F.array(*[word(half, shift) for half in "ab" for shift in range(SHIFTS)])
    return F.struct(F.size(hashes).cast("long").alias("n"), total.alias("total"), words.alias("words"))


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text, as FINGERPRINT; a null text is empty, and its fingerprint all zero."""
    return _bound(F.transform(paragraphs(F.coalesce(text, F.lit(""))), _hashes), of_hashes)


def inserted(x: Column, y: Column) -> Column:
    """The fingerprint of the two multisets' sum."""
    words = F.zip_with(x["words"], y["words"], lambda a, b: (a + b).bitwiseAND(F.lit(LANES)))
    return F.struct((x["n"] + y["n"]).alias("n"), (x["total"] + y["total"]).alias("total"), words.alias("words"))


def deleted(x: Column, y: Column) -> Column:
    """The fingerprint of the first multiset without the second."""
    words = F.zip_with(x["words"], y["words"], lambda a, b: (a + F.lit(CARRIES) - b).bitwiseAND(F.lit(LANES)))
    return F.struct((x["n"] - y["n"]).alias("n"), (x["total"] - y["total"]).alias("total"), words.alias("words"))


def signs(x: Column) -> Column:
    """For each lane twice its value less the number of paragraphs, the nearest to zero modulo 2 ** 20."""
    modulus = 2 << LANE_BITS
    lane = lambda w, at: F.shiftright(w, at).bitwiseAND(F.lit((1 << LANE_BITS) - 1))
    near = lambda w, at: F.pmod(2 * lane(w, at) - x["n"] + F.lit(modulus // 2), F.lit(modulus)) - F.lit(modulus // 2)
    return F.flatten(F.transform(x["words"], lambda w: F.array(*[near(w, at) for at in (0, SHIFTS, 2 * SHIFTS)])))


def _product(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0).cast("long"), lambda held, v: held + v)


def likeness(x: Column, y: Column) -> Column:
    """2 <x, y> / (<x, x> + <y, y>) of two ``signs``, between 0 and 1; two texts without paragraphs are alike.

    For texts without repeated paragraphs the estimate is Dice's coefficient of their
    sets, with a standard error of about 0.09 for unlike texts; it is 1 for equal
    fingerprints.
    """
    whole = _product(x, x) + _product(y, y)
    alike = F.coalesce(F.try_divide((2 * _product(x, y)).cast("double"), whole.cast("double")), F.lit(1.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), alike))


def as_text(x: Column) -> Column:
    """Hexadecimal: 8 digits of the number of paragraphs, 16 of the sum of hashes, 15 of each word."""
    digits = lambda v, n: F.lpad(F.lower(F.hex(v)), n, "0")
    return F.concat(digits(x["n"], 8), digits(x["total"], 16), F.array_join(F.transform(x["words"], lambda w: digits(w, 15)), ""))


def followers(keyed: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, h, next_id, next_h, n_chars) for each distinct document (id, h), in ascending order, the last followed by the first.

    Ids and lengths alone are dealt by ranges and sorted; within a partition the next
    place follows at once, and a table of one row a partition names the next one's
    first.  Null ids come first, equal ids are ordered by h.
    """
    ranked = keyed.distinct().repartitionByRange("id", "h").sortWithinPartitions("id", "h").withColumn("place", F.monotonically_increasing_id())
    order = scratch.keep(ranked, "order")
    part = F.shiftright("place", 33).alias("part")
    ends = order.groupBy(part).agg(F.min("place").alias("first"), F.max("place").alias("last"))
    # One row for each partition that has rows, so the window and the broadcast are as small as the number of partitions.
    whole = Window.orderBy("first")
    ends = ends.withColumn("after", F.coalesce(F.lead("first").over(whole), F.min("first").over(whole)))
    turned = order.join(F.broadcast(ends.select(F.col("last").alias("place"), "after")), "place", "left").withColumn("after", F.coalesce("after", F.col("place") + 1))
    following = order.select(F.col("id").alias("next_id"), F.col("h").alias("next_h"), F.col("place").alias("after"))
    return scratch.keep(turned.join(following, "after").select("id", "h", "n_chars", "next_id", "next_h"), "followers")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every document row.

    The edited text is the document's first half and then the next one's first code
    points, as many as the second half has, or all.  A null text is empty.  A document is an id with
    its text: repeated rows of both are one document, whose row comes as often; texts
    that share an id, null or not, are ordered by their MD5, and null ids come first.
    A document alone in the table follows itself.  An empty table gives no rows; other
    columns aren't read.

    Each text is dealt once by (id, MD5), and half of it, with its fingerprint, once
    more to the document before it.
    """
    scratch = Scratch(docs.sparkSession, "fingerprints")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("h", F.unhex(F.md5("text")))
    order = followers(rows.select("id", "h", F.length("text").alias("n_chars")), scratch)
    marked = rows.withColumn("own", fingerprint(F.col("text")))
    wanted = order.select(F.col("id").alias("for_id"), F.col("h").alias("for_h"), F.floor(F.col("n_chars") / 2).cast("int").alias("half"), "next_id", "next_h")
    handed = marked.join(wanted, F.col("id").eqNullSafe(F.col("next_id")) & (F.col("h") == F.col("next_h")))
    handed = handed.select("for_id", "for_h", F.expr("substring(text, 1, half)").alias("tail"), F.col("own").alias("next"), "half").dropDuplicates(["for_id", "for_h"])
    both = marked.join(handed, F.col("id").eqNullSafe(F.col("for_id")) & (F.col("h") == F.col("for_h")))
    edited = both.select("id", "text", "own", "next", F.concat(F.expr("substring(text, 1, length(text) - half)"), "tail").alias("edited_text"))
    done = edited.withColumn("edited", fingerprint(F.col("edited_text")))
    near = _bound(signs(F.col("own")), lambda s: F.struct(*[_bound(signs(F.col(x)), lambda t: likeness(s, t)).alias(f"near_{x}") for x in ("edited", "next")]))
    told = done.select(F.col("id").alias("doc_id"), F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
                       as_text(F.col("own")).alias("fingerprint"), as_text(F.col("edited")).alias("edited_fingerprint"), near.alias("near"))
    return told.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near.*")


def report_sql() -> str:
    """The same rows in DuckDB's SQL, where no id repeats."""
    def print_of(name: str, text: str) -> str:
        word = lambda half, shift: f"list_sum(list_transform({half}, lambda x: (x >> {shift}) & {ONES}))"
        masked = lambda w: f"({w} & {LANES})"
        words = ", ".join(f"coalesce({masked(word(half, shift))}, 0)::BIGINT" for half in "ab" for shift in range(SHIFTS))
        return f"""
    {name}_p AS (SELECT *, list_filter(string_split(regexp_replace({text}, '([.!?])[ \\t\\r]+', '\\1' || chr(10), 'g'), chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]')) AS ps FROM {name}_t),
    {name}_h AS (SELECT * EXCLUDE (ps), len(ps)::BIGINT AS n, list_transform(ps, lambda x: ('0x' || substr(md5(x), 1, 15))::BIGINT) AS a, list_transform(ps, lambda x: ('0x' || substr(md5(x), 16, 15))::BIGINT) AS b FROM {name}_p),
    {name}_w AS (SELECT * EXCLUDE (a, b), coalesce(list_sum(list_transform(b, lambda x: x & {SUM_MASK})), 0)::BIGINT AS total, [{words}] AS words FROM {name}_h),
    {name} AS (SELECT *, lower(lpad(hex(n), 8, '0') || lpad(hex(total), 16, '0') || array_to_string(list_transform(words, lambda w: lpad(hex(w), 15, '0')), '')) AS print,
                      flatten(list_transform(words, lambda w: list_transform([0, {SHIFTS}, {2 * SHIFTS}], lambda k: 2 * ((w >> k) & {(1 << LANE_BITS) - 1}) - n))) AS s FROM {name}_w)"""

    dot = lambda x, y: f"list_sum(list_transform(list_zip({x}, {y}), lambda v: v[1] * v[2]))"
    near = lambda x, y: f"least(1.0, greatest(0.0, coalesce((2 * {dot(x, y)})::DOUBLE / nullif({dot(x, x)} + {dot(y, y)}, 0), 1.0)))"
    return f"""
    WITH own_t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    {print_of("own", "t")},
    following AS (SELECT *, coalesce(lead(t) OVER o, first(t) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS next_t,
                          coalesce(lead(s) OVER o, first(s) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS next_s
                   FROM own WINDOW o AS (ORDER BY doc_id)),
    edited_t AS (SELECT doc_id, substr(t, 1, length(t) - length(t) // 2) || substr(next_t, 1, length(t) // 2) AS e FROM following),
    {print_of("edited", "e")}
    SELECT f.doc_id, length(f.t)::BIGINT AS n_chars, sha256(e.e) AS edited_sha256, f.print AS fingerprint, e.print AS edited_fingerprint,
           {near("f.s", "e.s")} AS near_edited, {near("f.s", "f.next_s")} AS near_next
    FROM following f JOIN edited e ON f.doc_id = e.doc_id"""
