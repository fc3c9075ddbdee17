"""Mixing to target weights by iterative proportional fitting, in DataFrame functions only.

Documents fall into cells of (source, language, topic).  The cells' token weights
are raked: in turn, every source, language and topic is scaled to its target
share, until all three marginals meet.  A document is then drawn with a
probability that is its cell's raked weight over the cell's tokens, scaled so
that the cell most in demand is kept whole; the draw is a hash of the document,
so it is the same at every run and place.
"""

from __future__ import annotations

import warnings
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strainspark.scratch import Scratch

MARGINS = ("source", "lang", "topic")
#: Without targets, shares are raised to this power, which lifts rare sources, languages and topics
#: gently, so that about half of the documents are drawn.
TEMPERATURE = 0.9
#: Rounds made between two looks at the error, and the marginal error at which they end.
ROUNDS, TOLERANCE = 12, 1e-6

#: Topics by the words that mark them; the first that fits, else prose.
TOPICS = [
    ("code", r"\b(def|class|import|function|return|void|const)\b\s"),
    ("legal", r"(?i)\b(license|licence|copyright|warranty)\b"),
    ("contact", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]+|https?://"),
    ("symbols", r"[#$%&*]{3}"),
]


#: Strings of which a text of that topic has one, so that most texts need no regular expression.
NEEDED = {"contact": ("@", "://")}


def topic_of(text: Column) -> Column:
    """The topic of a text by TOPICS; of null, prose."""
    out = F.lit("prose")
    for name, pattern in reversed(TOPICS):
        fits = F.rlike(text, F.lit(pattern))
        if name in NEEDED:
            fits = reduce(or_, [F.contains(text, F.lit(x)) for x in NEEDED[name]]) & fits
        out = F.when(F.coalesce(fits, F.lit(False)), name).otherwise(out)
    return out


def tokens_of(text: Column) -> Column:
    """Words, runs of other than space and \\t-\\r; a text without words counts one, so every document has weight."""
    return F.greatest(F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]+")), F.lit(0)), F.lit(1)).cast("long")


def smoothed_targets(cells: DataFrame, margin: str, power: float) -> DataFrame:
    """(margin, share): natural shares of tokens to a power, scaled to sum to 1."""
    sums = cells.groupBy(margin).agg(F.sum("tokens").cast("double").alias("t")).withColumn("t", F.pow("t", F.lit(power)))
    total = sums.agg(F.sum("t").alias("total"))
    return sums.join(F.broadcast(total)).select(margin, (F.col("t") / F.col("total")).alias("share"))


def marginal_error(fitted: DataFrame) -> float:
    """The largest difference between a marginal share of ``weight`` and its target, of the values that have cells."""
    worst = 0.0
    for margin in MARGINS:
        sums = fitted.groupBy(margin).agg(F.sum("weight").alias("w"), F.first(f"target_{margin}").alias("t"))
        whole = sums.agg(F.sum("w").alias("ws"), F.sum("t").alias("ts"))
        apart = F.abs(F.try_divide("w", "ws") - F.try_divide("t", "ts"))
        worst = max(worst, sums.join(F.broadcast(whole)).agg(F.max(apart).alias("x")).first()["x"] or 0.0)
    return worst


def rake(cells: DataFrame, targets: dict[str, DataFrame], scratch: Scratch, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """``cells`` (the margins, tokens) with ``weight``, whose marginal shares meet ``targets``.

    A value without a target keeps weight 0; targets are rescaled to the values
    that have cells.  ``rounds`` rounds are made at a time, until no marginal share
    is off by more than ``tolerance``.  Where the cells allow no such weights (two
    sources that alone make a language, say), the error stops falling: rounds end
    once ``rounds`` of them lower it by less than a hundredth, and a warning names
    the error that is left.  The work is on cells, not documents: each step is a
    group-by on one margin, and each round's table is written.
    """
    fitted = cells
    for margin in MARGINS:
        fitted = fitted.join(targets[margin].withColumnRenamed("share", f"target_{margin}"), margin, "left").fillna(0.0, [f"target_{margin}"])
    fitted = scratch.keep(fitted.withColumn("weight", F.col("tokens").cast("double")), "rake0")
    done, error, before = 0, float("inf"), float("inf")
    while done == 0 or (error > tolerance and error < 0.99 * before):
        for done in range(done + 1, done + rounds + 1):
            for margin in MARGINS:
                shares = fitted.groupBy(margin).agg(F.sum("weight").alias("share"))
                weight = F.coalesce(F.try_divide(F.col("weight") * F.col(f"target_{margin}"), F.col("share")), F.lit(0.0))
                fitted = fitted.join(shares, margin).withColumn("weight", weight).drop("share")
            fitted = scratch.keep(fitted, f"rake{done}")
            scratch.drop(f"rake{done - 1}")
        before, error = error, marginal_error(fitted)
    if error > tolerance:
        warnings.warn(f"mixing: after {done} rounds a marginal share is {error:.2g} off its target", stacklevel=2)
    return fitted.select(*MARGINS, "tokens", "weight")


def marked(docs: DataFrame, text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic: Column | None = None, out: str = "mix") -> DataFrame:
    """``docs`` with a struct column ``out``: source, lang, topic, tokens."""
    text = F.col(f"`{text_col}`")
    value = lambda name: F.coalesce(F.col(f"`{name}`"), F.lit(""))
    return docs.withColumn(out, F.struct(value(source_col).alias("source"), value(lang_col).alias("lang"), (topic if topic is not None else topic_of(text)).alias("topic"), tokens_of(text).alias("tokens")))


def calibrated(rows: DataFrame, scratch: Scratch, targets: dict[str, DataFrame] | None = None, power: float = TEMPERATURE, id_col: str = "doc_id", out: str = "mix") -> DataFrame:
    """``marked`` rows, whose ``out`` also has probability and kept."""
    cells = scratch.keep(rows.select(f"{out}.*").groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")), "cells")
    wanted = {m: (targets or {}).get(m) or smoothed_targets(cells, m, power) for m in MARGINS}
    raked = rake(cells, wanted, scratch)
    factor = raked.withColumn("factor", F.col("weight") / F.col("tokens"))
    most = factor.agg(F.max("factor").alias("most"))
    chances = scratch.keep(factor.join(F.broadcast(most)).select(F.struct(*MARGINS).alias("cell"), F.coalesce(F.try_divide("factor", "most"), F.lit(0.0)).alias("probability")), "chances")
    draw = F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    cell = F.struct(*[F.col(f"{out}.{m}").alias(m) for m in MARGINS])
    chances = chances.select(F.col("cell").alias("__of"), F.round("probability", 9).alias("__chance"))
    joined = rows.withColumn("__cell", cell).join(chances, F.col("__cell") == F.col("__of"), "left")
    return joined.withColumn(out, F.col(out).withField("probability", F.col("__chance")).withField("kept", draw < F.col("__chance"))).drop("__cell", "__of", "__chance")


def with_probability(docs: DataFrame, targets: dict[str, DataFrame] | None = None, power: float = TEMPERATURE, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic: Column | None = None, out: str = "mix") -> DataFrame:
    """``docs`` with a struct column ``out``: source, lang, topic, tokens, probability, kept.

    Null sources and languages are values of their own (an empty string); a null
    text has one token.  Equal documents of one id share their draw; those of
    different ids are drawn apart.  ``targets`` gives (value, share) tables by
    margin; without, natural shares to ``power``.  An empty table stays empty.
    Topics and tokens are found twice, for the cells and for the rows, which is
    less than writing the corpus; ``report`` has narrow rows and writes them.
    """
    return calibrated(marked(docs, text_col, source_col, lang_col, topic, out), Scratch(docs.sparkSession, "mixing"), targets, power, id_col, out)


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, topic, tokens, probability, kept) of every document row."""
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = scratch.keep(marked(docs.select("doc_id", "text", "source", "lang")).select("doc_id", "mix"), "rows")
    return calibrated(rows, scratch).select("doc_id", "mix.topic", "mix.tokens", "mix.probability", "mix.kept")


def report_sql(docs: str = "documents", rounds: int = ROUNDS, power: float = TEMPERATURE) -> str:
    """The same rows in DuckDB's SQL; each raking step is a common table expression."""
    topic = "CASE " + " ".join(f"WHEN regexp_matches(coalesce(text, ''), '{p}') THEN '{n}'" for n, p in TOPICS) + " ELSE 'prose' END"
    steps, last = [], "w"
    for k in range(rounds):
        for m in MARGINS:
            name = f"w{k}_{m}"
            steps.append(f"{name} AS MATERIALIZED (SELECT * REPLACE (coalesce(weight * target_{m} / nullif(sum(weight) OVER (PARTITION BY {m}), 0), 0) AS weight) FROM {last})")
            last = name
    targets = ", ".join(f"t_{m} AS (SELECT {m}, pow(sum(tokens)::DOUBLE, {power}) / sum(pow(sum(tokens)::DOUBLE, {power})) OVER () AS target_{m} FROM cells GROUP BY {m})" for m in MARGINS)
    return f"""
    WITH d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, {topic} AS topic,
                      greatest(len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+')), 1)::BIGINT AS tokens FROM {docs}),
    cells AS (SELECT source, lang, topic, sum(tokens)::BIGINT AS tokens FROM d GROUP BY ALL),
    {targets},
    w AS (SELECT *, tokens::DOUBLE AS weight FROM cells JOIN t_source USING (source) JOIN t_lang USING (lang) JOIN t_topic USING (topic)),
    {", ".join(steps)},
    c AS (SELECT source, lang, topic, round((weight / tokens) / max(weight / tokens) OVER (), 9) AS probability FROM {last})
    SELECT doc_id, topic, d.tokens, probability,
           ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0 < probability AS kept
    FROM d JOIN c USING (source, lang, topic)"""
