"""Secret scan over a trigram inverted index, in DataFrame functions only.

Each rule's regular expression gives a Boolean query of trigrams that every match
must hold.  The index lists, for each trigram that some rule needs, the documents
that hold it; postings are intersected and united as the query says, and only the
candidates' texts are searched with the expression.  A rule without mandatory
trigrams searches every text.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _constants as sre
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strainspark.scratch import Scratch


@dataclass(frozen=True)
class Rule:
    """``pattern`` must mean the same to Java and Python; a match counts if ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


BASE_RULES = [
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
]
MORE_RULES = [
    Rule("bearer", r"[Bb]earer\x20+[A-Za-z0-9._~+/-]+=*", 0, 27),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
]

#: A query is True (anything may match), or ("and" | "or", parts), or a trigram.
Query = bool | str | tuple
_MOST = 64


def _both(x: Query, y: Query) -> Query:
    return y if x is True else x if y is True else x if x == y else ("and", (x, y))


def _either(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(parts))
    return True if True in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_strings(strings: set[str]) -> Query:
    """The query that one of these strings occurs."""
    parts: list[Query] = []
    for s in sorted(strings):
        q: Query = True
        for k in range(len(s) - 2):
            q = _both(q, s[k : k + 3])
        parts.append(q)
    return _either(parts)


def _walk(nodes) -> tuple[set[str] | None, Query]:
    """(all strings a sequence can match, lower-cased, or None if too many; its query)."""
    query: Query = True
    run, exact = {""}, True
    for op, arg in nodes:
        strings, q = _node(op, arg)
        if strings is not None and len(run) * len(strings) <= _MOST:
            run = {x + y for x, y in product(run, strings)}
            continue
        query, exact = _both(query, _of_strings(run)), False
        run = strings if strings is not None else {""}
        query = _both(query, q if strings is None else True)
    return (run if exact else None), _both(query, _of_strings(run))


def _node(op, arg) -> tuple[set[str] | None, Query]:
    if op is sre.LITERAL:
        return {chr(arg).lower()}, True
    if op is sre.IN:
        found: set[str] = set()
        for kind, x in arg:
            if kind is sre.LITERAL:
                found.add(chr(x).lower())
            elif kind is sre.RANGE and x[1] - x[0] < 6:
                found |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None, True
        return (found, True) if len(found) <= 6 else (None, True)
    if op is sre.SUBPATTERN:
        return _walk(arg[3])
    if op is sre.BRANCH:
        parts = [_walk(x) for x in arg[1]]
        if all(s is not None for s, _ in parts):
            return set().union(*(s for s, _ in parts)), True
        return None, _either([_of_strings(s) if s is not None else q for s, q in parts])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, inner = arg
        strings, q = _walk(inner)
        if (low, high) == (0, 1) and strings is not None:
            return strings | {""}, True
        return None, (_of_strings(strings) if strings is not None else q) if low else True
    if op is sre.AT:
        return {""}, True
    return None, True


def trigram_query(pattern: str) -> Query:
    """The Boolean query of lower-case trigrams that any match of ``pattern`` must hold."""
    strings, query = _walk(_parser.parse(pattern))
    return query if strings is None else _of_strings(strings)


def trigrams(query: Query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*(trigrams(x) for x in query[1]))


def _holds(query: Query, held: Column) -> Column:
    if isinstance(query, str):
        return F.array_contains(held, query)
    parts = [_holds(x, held) for x in query[1]]
    out = parts[0]
    for x in parts[1:]:
        out = (out & x) if query[0] == "and" else (out | x)
    return out


def postings(docs: DataFrame, needed: list[str]) -> DataFrame:
    """The inverted index (trigram, doc_id): each document that holds a needed trigram, letters' case aside."""
    low = F.lower("text")
    held = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(x)), F.lit(x)) for x in needed]))
    return docs.select("doc_id", F.explode(held).alias("trigram"))


def _spans(text: Column, rule: Rule, matches: Column, groups: Column) -> Column:
    """(start, end) of the rule's matches that are long enough, in code points.

    Matches are leftmost and do not overlap; the pieces between them give their places.
    """
    pieces = F.split(text, rule.pattern, -1)
    lengths = F.zip_with(F.transform(F.slice(pieces, F.lit(1), F.size(matches)), lambda piece: F.length(piece)), matches, lambda gap, m: F.struct(gap.alias("gap"), F.length(m).alias("n")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    walked = F.aggregate(lengths, start, lambda s, x: F.struct((s["at"] + x["gap"] + x["n"]).alias("at"), F.concat(s["spans"], F.array(F.struct((s["at"] + x["gap"]).alias("start"), (s["at"] + x["gap"] + x["n"]).alias("end")))).alias("spans")))
    kept = F.filter(F.zip_with(walked["spans"], groups, lambda s, g: F.when(F.length(g) >= rule.least, s)), lambda s: s.isNotNull())
    return F.when(F.exists(groups, lambda g: F.length(g) >= rule.least), kept).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def find_secrets(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, spans) for each row: spans is an array of (start, place of the rule, kind, end).

    Spans are ordered by start, then by the rules' order; places are code points,
    the end exclusive.  A null text is searched as an empty one; rows that share
    an id, null or not, are each searched on their own; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = [r for r in rules if queries[r.kind] is not True]
    needed = sorted(set().union(*(trigrams(queries[r.kind]) for r in indexed)))
    if needed:
        index = scratch.keep(postings(texts, needed), "index")
        held = index.groupBy("doc_id").agg(F.collect_set("trigram").alias("held"))  # at most the needed trigrams of a document
        wanted = F.array_compact(F.array(*[F.when(_holds(queries[r.kind], F.col("held")), F.lit(r.kind)) for r in indexed]))
        candidates = scratch.keep(held.select(F.col("doc_id").alias("id"), wanted.alias("wanted")).filter(F.size("wanted") > 0), "candidates")
        texts = texts.join(candidates, F.col("doc_id").eqNullSafe(F.col("id")), "left").select("doc_id", "text", "wanted")
    else:
        texts = texts.withColumn("wanted", F.lit(None).cast("array<string>"))
    none = F.array().cast("array<string>")
    for r in rules:
        # A rule that counts long matches only needs no look at short ones, where the whole match is a run of one class.
        looked = F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))
        if queries[r.kind] is True and r.group == 0:
            looked = F.when(F.rlike("text", F.lit(_at_least(r))), looked).otherwise(none)
        elif queries[r.kind] is not True:
            looked = F.when(F.array_contains("wanted", r.kind), looked).otherwise(none)
        texts = texts.withColumn(f"m_{r.kind}", looked)
    for k, r in enumerate(rules):
        groups = F.col(f"m_{r.kind}") if r.group == 0 else F.when(F.size(f"m_{r.kind}") > 0, F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group))).otherwise(none)
        placed = _spans(F.col("text"), r, F.col(f"m_{r.kind}"), groups)
        texts = texts.withColumn(f"s_{r.kind}", F.transform(placed, _named(k, r.kind)))
    return texts.select("doc_id", "text", F.array_sort(F.concat(*[F.col(f"s_{r.kind}") for r in rules])).alias("spans"))


def _named(place: int, kind: str):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(place).alias("place"), F.lit(kind).alias("kind"), s["end"].alias("end"))


def _at_least(rule: Rule) -> str:
    """Of a single repeated class: the pattern of a run of ``least`` or more; else the pattern itself."""
    parsed = list(_parser.parse(rule.pattern))
    if len(parsed) == 1 and parsed[0][0] is sre.MAX_REPEAT and len(parsed[0][1][2]) == 1 and rule.pattern.endswith("]+"):
        return f"{rule.pattern[:-1]}{{{rule.least},}}"
    return rule.pattern


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every document row."""
    found = find_secrets(docs, BASE_RULES + MORE_RULES, id_col)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["place"] < len(BASE_RULES))
    return found.select("doc_id", *[count(r.kind) for r in BASE_RULES], F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def _sql_spans(place: int, rule: Rule) -> str:
    pattern = "'" + rule.pattern.replace("'", "''") + "'"
    return f"""
      SELECT row, {place} AS place, '{rule.kind}' AS kind, start, start + length(m) AS stop
      FROM (SELECT row, unnest(ms) AS m, unnest(gs) AS g,
                   unnest(list_transform(range(1, len(ms) + 1), lambda i: list_sum(list_transform(ps[1:i], lambda p: length(p))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda p: length(p))), 0))) AS start
            FROM (SELECT row, regexp_extract_all(t, {pattern}) AS ms, regexp_extract_all(t, {pattern}, {rule.group}) AS gs, string_split_regex(t, {pattern}) AS ps FROM d{
                f" WHERE regexp_matches(t, '{_at_least(rule)}')" if _at_least(rule) != rule.pattern else ""}))
      WHERE length(g) >= {rule.least}"""


def report_sql() -> str:
    """The same rows in DuckDB's SQL, by searching every text with every rule."""
    rules = BASE_RULES + MORE_RULES
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in BASE_RULES)
    piece = "kind || ':' || start || ':' || stop"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
    s AS ({" UNION ALL ".join(_sql_spans(k, r) for k, r in enumerate(rules))}),
    g AS (SELECT d.row, d.doc_id, {counts},
                 sha256(coalesce(string_agg({piece}, ',' ORDER BY start, place) FILTER (WHERE place < {len(BASE_RULES)}), '')) AS base_sha256,
                 coalesce(string_agg({piece}, ',' ORDER BY start, place), '') AS spans
          FROM d LEFT JOIN s ON d.row = s.row GROUP BY d.row, d.doc_id)
    SELECT doc_id, n_assign, n_access, n_hex, base_sha256, spans FROM g"""
