"""How filters of documents interact: what each removes at each place of every order.

1. In Spark every document becomes a mask, one bit for each filter that it fails, and
   the masks are counted: a cell holds the documents of one part of the corpus with one
   mask, at most 2 ** k cells a part for k filters.  An order of the filters, and so
   every figure below, depends on the cells alone.
2. For each part, a worker visits all orders by adjacent transpositions (each order
   differs from the one before by one swap of neighbours).  A step's figures depend on
   the set of filters before it and its own only, so a swap changes two steps; these
   are computed anew from the cells and the others stay.
3. A filter's Shapley figure is what it removes, summed over all orders; the walk adds
   to it as it goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strainspark.scratch import Scratch

#: Parameters of the audited filters: a failing document is below, below (percent of words), or above (percent of characters).
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SIGNS = 100, 80, 10, "#$%&*|"
MOST_FILTERS = 7
_COUNTS = ("n", "good", "toxic")


def text_filters(text: Column) -> dict[str, Column]:
    """The filters that look at a text alone, by name; true where a text fails.  Words are runs of other than space and \\t-\\r."""
    words = F.array_remove(F.split(text, r"[ \t-\r]+"), "")
    total, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    capitals = F.regexp_count(text, F.lit("[A-Z]")).cast("long")
    return {
        "A": total < LEAST_WORDS,
        "B": 100 * distinct < LEAST_DISTINCT * total,
        "C": 100 * capitals > MOST_CAPITALS * F.length(text).cast("long"),
        "D": F.rlike(text, F.lit(f"[{SIGNS}]")),
    }


def mask_of(filters: list[Column]) -> Column:
    """Bit k is set where the k-th filter fails the document."""
    return sum((F.when(x, 1 << k).otherwise(0) for k, x in enumerate(filters)), F.lit(0))


def cells(docs: DataFrame, labels: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the filters A to E that they fail.

    E fails a document whose text a smaller id holds too, anywhere in the table.  Texts
    are compared by their MD5; copies are first counted by id, then by text within each
    task, so a text that a third of the table shares is a few rows of each task.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), text.alias("text"))
    narrow = scratch.keep(rows.select("id", "part", F.unhex(F.md5("text")).alias("h"), mask_of(list(text_filters(F.col("text")).values())).alias("mask")), "narrow")
    marks = labels.groupBy(F.col("doc_id").alias("label_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    no = F.lit(False)
    named = narrow.filter("id IS NOT NULL").join(marks, F.col("id") == F.col("label_id"), "left").drop("label_id")
    named = named.withColumns({"good": F.coalesce("good", no), "toxic": F.coalesce("toxic", no)})
    known = named.unionByName(narrow.filter("id IS NULL").withColumns({"good": no, "toxic": no}))

    of_text = ["h", "part", "mask", "good", "toxic"]
    by_id = known.groupBy(*of_text, "id").agg(F.count("*").alias("n"))
    # Rows of the smallest id of a text within its part and labels, and of no id, are no copies of a smaller one there.
    by_text = by_id.groupBy(*of_text).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("nameless"),
                                          F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first"))
    # A text has as many rows here as it has parts and labels.
    held = by_text.withColumn("least", F.min("first.id").over(Window.partitionBy("h")))
    original = F.col("nameless") + F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0)
    split = held.select("part", "good", "toxic", F.explode(F.array(F.struct(F.col("mask"), original.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - original).alias("n")))).alias("c"))
    count = lambda mark, name: F.sum(F.when(F.col(mark), F.col("c.n")).otherwise(0)).alias(name)
    return split.groupBy("part", F.col("c.mask").alias("mask")).agg(F.sum("c.n").alias("n"), count("good", "good"), count("toxic", "toxic"))


def adjacent_swaps(k: int) -> Iterator[int]:
    """Places p such that swapping items p and p + 1, one after the other, visits every order of k items once."""
    directions, at, items = [-1] * k, list(range(k)), list(range(k))
    while True:
        # The largest item with a smaller neighbour in its direction moves; all larger ones turn round.
        moving = next((x for x in range(k - 1, -1, -1) if 0 <= at[x] + directions[x] < k and items[at[x] + directions[x]] < x), None)
        if moving is None:
            return
        here, there = at[moving], at[moving] + directions[moving]
        other = items[there]
        items[here], items[there], at[moving], at[other] = other, moving, there, here
        for x in range(moving + 1, k):
            directions[x] = -directions[x]
        yield min(here, there)


def walk(n: np.ndarray, k: int) -> tuple[list[tuple[tuple[int, ...], np.ndarray]], np.ndarray]:
    """All orders with their steps, and each filter's Shapley sum.

    ``n`` holds the counts of 2 ** k masks (documents, good, toxic).  A step's row is
    removed, redundant, good lost, toxic lost, kept.
    """
    masks = np.arange(1 << k)
    fails = [n[(masks >> f & 1) == 1, 0].sum() for f in range(k)]
    total = n[:, 0].sum()

    def step(before: int, f: int) -> list[int]:
        gone = n[(masks & before == 0) & (masks >> f & 1 == 1)].sum(axis=0)
        kept = n[masks & (before | 1 << f) == 0, 0].sum()
        return [gone[0], fails[f] - gone[0], gone[1], gone[2], kept]

    order, steps, before = list(range(k)), np.zeros((k, 5), np.int64), 0
    for p, f in enumerate(order):
        steps[p] = step(before, f)
        before |= 1 << f
    assert k == 0 or steps[-1, 4] == total - steps[:, 0].sum()
    removed = steps[:, 0].copy()  # by filter
    shapley, out = removed.copy(), [(tuple(order), steps.copy())]
    for p in adjacent_swaps(k):
        order[p], order[p + 1] = order[p + 1], order[p]
        before = sum(1 << f for f in order[:p])
        steps[p], steps[p + 1] = step(before, order[p]), step(before | 1 << order[p], order[p + 1])
        removed[order[p]], removed[order[p + 1]] = steps[p, 0], steps[p + 1, 0]
        shapley += removed
        out.append((tuple(order), steps.copy()))
    return out, shapley


AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def _orders(names: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = len(names)
        for batch in batches:
            for part, held in zip(batch["part"], batch["cells"], strict=True):
                n = np.zeros((1 << k, 3), np.int64)
                for cell in held:
                    n[cell["mask"]] += [cell[x] for x in _COUNTS]
                visited, shapley = walk(n, k)
                rows = [("".join(names[f] for f in order), p + 1, int(s[4]), int(s[0]), int(s[1]), int(n[1 << order[p], 0]), int(s[2]), int(s[3]), int(shapley[order[p]])) for order, steps in visited for p, s in enumerate(steps)]
                out = pd.DataFrame(rows, columns=["filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"])
                out.insert(0, "part", part)
                yield out

    return run


def audit(counted: DataFrame, names: str) -> DataFrame:
    """AUDIT's columns for every part of ``cells`` and every order of the filters ``names``, one letter each.

    Bit k of a mask is the k-th letter.  A part is one row of at most 2 ** k cells, so
    parts are worked on side by side.  Seven filters at most: the result has k! orders.
    """
    if len(names) > MOST_FILTERS:
        raise ValueError(f"all orders of more than {MOST_FILTERS} filters")
    parts = counted.groupBy("part").agg(F.collect_list(F.struct(F.col("mask").cast("int").alias("mask"), *_COUNTS)).alias("cells"))
    return parts.mapInPandas(_orders(names), AUDIT)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of filters A to E over whole ``documents``, by language.

    A null text is empty, a null language the part ''.  Each row is a document: repeated
    rows of one id count each, and are no copies of a smaller id by themselves.  A null id
    is neither smaller nor larger than another, and has no labels.  A document is good or
    toxic where any of its label rows says 1.  An empty table has no parts and gives no
    rows; other columns aren't read.
    """
    return audit(cells(docs, labels, Scratch(docs.sparkSession, "audit")), "ABCDE")


REPORT_SQL = f"""
    WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, regexp_extract_all(t, '[^ \\t-\\r]+') AS words FROM d),
    l AS (SELECT doc_id AS label_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY 1),
    m AS (SELECT part, (CASE WHEN len(words) < {LEAST_WORDS} THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(words)) < {LEAST_DISTINCT} * len(words) THEN 2 ELSE 0 END)
                 + (CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > {MOST_CAPITALS} * length(t) THEN 4 ELSE 0 END) + (CASE WHEN regexp_matches(t, '[{SIGNS}]') THEN 8 ELSE 0 END)
                 + (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END) AS mask, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
          FROM w LEFT JOIN l ON doc_id = label_id),
    c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM m GROUP BY ALL),
    f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(letter, bit)),
    o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order FROM f a, f b, f c, f d, f e
          WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
    s AS (SELECT filter_order, step, bit, (SELECT coalesce(sum(g.bit), 0) FROM f g WHERE instr(filter_order, g.letter) < step)::BIGINT AS before
          FROM o, range(1, 6) AS r(step), f WHERE letter = substr(filter_order, step, 1)),
    u AS (SELECT DISTINCT before, bit FROM s),
    x AS (SELECT part, before, bit, sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed,
                 sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
                 sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
          FROM c, u GROUP BY ALL)
    SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
           good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
    FROM s JOIN x USING (before, bit)"""
