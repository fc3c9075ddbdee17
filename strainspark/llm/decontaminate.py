"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The test strings are the benchmark's windows of words, held as places in one flat
array of word ids.  A table maps the hash of each block of B words that ends at
some position of a test string to the distance by which the search may jump, the
least where hashes meet; blocks that end a test string have distance 0 and select a
bucket, in which the first B words select the strings that are then compared
word by word.  Blocks that no test string holds let the search skip m - B + 1
words, and a word that none holds is skipped whole, so most words of a clean
document are never looked at.
"""

from __future__ import annotations

import hashlib
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strainspark.llm.words import binary
from strainspark.scratch import Scratch

#: Bytes of benchmark text whose windows are searched for, and broadcast, in one pass.  Their tables take less than 200 MB.
BLOCK_BYTES = 8_000_000

#: Lower-cases A-Z and turns every byte that is in no word into a space; bytes of other than ASCII characters are word bytes.
_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

RESULT = "n_words long, spans array<struct<first:long,last:long>>, item_ids array<string>"


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TO_WORDS).split() if text else []


#: Factors of a block's words in its key; ids are below 2 ** 23, so sums stay below 2 ** 63.
_FACTORS = (0x2545F4914F, 0x1B873593E5, 0x3C6EF372FE)
#: Joins the keys of a string's last and first block.
_JOIN, _LOW64 = 0x9E3779B97F4A7C15, (1 << 64) - 1


class WuManber:
    """Search for test strings of one length ``m``, in words.

    A test string is a place in the flat array ``tokens`` of word ids; ``owner`` has
    the item of each place in ``starts``.  Equal strings are held once.
    """

    def __init__(self, vocabulary: dict[bytes, int], tokens: np.ndarray, starts: np.ndarray, owner: np.ndarray, m: int, block: int = 3):
        self.word, self.tokens, self.m, self.b = vocabulary.get, tokens, m, min(block, m)
        self.factors = [(j + 1, _FACTORS[j % 3] + 2 * (j // 3)) for j in range(self.b)]
        jump = m - self.b + 1
        # Blocks by the distance of their ends from the strings' end; a slot that several blocks share keeps the least.
        size = max(4 * len(starts), 1024) | 1
        shift = np.full(size, min(jump, 255), np.uint8)
        for end in range(self.b, m + 1):
            slots = self._keys(starts + end) % size
            np.minimum.at(shift, slots, min(m - end, 255))
        self.size, self.shift = size, shift.tobytes()
        keys = self._joined(self._keys(starts + m), self._keys(starts + self.b))
        whole = np.zeros(len(starts), np.uint64)
        for j in range(m):
            whole = whole * np.uint64(_JOIN) + tokens[starts + j].astype(np.uint64) + np.uint64(1)
        order = np.lexsort((owner, whole, keys))
        keys, starts, owner = keys[order], starts[order], owner[order]
        new = np.ones(len(starts), bool)
        for k in range(0, len(starts) - 1, 100_000):  # neighbours are compared word by word, some at a time
            here = np.arange(k, min(k + 100_000, len(starts) - 1))
            same = np.ones(len(here), bool)
            for j in range(m):
                same &= tokens[starts[here] + j] == tokens[starts[here + 1] + j]
            new[here + 1] = ~same
        self.keys, self.first = keys[new], starts[new]
        self.owner, self.owner_at = owner, np.append(np.flatnonzero(new), len(starts))

    def _keys(self, ends: np.ndarray) -> np.ndarray:
        """The keys of the blocks that end before ``ends``."""
        out = np.zeros(len(ends), np.int64)
        for j, factor in self.factors:
            out += self.tokens[ends - j].astype(np.int64) * factor
        return out

    @staticmethod
    def _joined(last: np.ndarray, first: np.ndarray) -> np.ndarray:
        return last.astype(np.uint64) ^ (first.astype(np.uint64) * np.uint64(_JOIN))

    def search(self, words: list[bytes], spans: list[tuple[int, int]], items: set[int]) -> None:
        """Adds the places [first, last) and the items of all occurrences."""
        m, b, shift, size, word, factors, end, n = self.m, self.b, self.shift, self.size, self.word, self.factors, self.m, len(words)
        while end <= n:
            key = 0
            for j, factor in factors:
                one = word(words[end - j])
                if one is None:  # no string holds this word, so the next one begins behind it
                    end += m - j + 1
                    break
                key += one * factor
            else:
                step = shift[key % size]
                if not step:
                    self._compare(words, end - m, key, spans, items)
                    step = 1
                end += step

    def _compare(self, words: list[bytes], first: int, key: int, spans: list[tuple[int, int]], items: set[int]) -> None:
        ids = [self.word(x) for x in words[first : first + self.m]]
        if None in ids:
            return
        start = sum(ids[self.b - j] * factor for j, factor in self.factors)
        joined = np.uint64(key ^ (start * _JOIN & _LOW64))
        for k in range(int(np.searchsorted(self.keys, joined)), int(np.searchsorted(self.keys, joined, "right"))):
            at = int(self.first[k])
            if self.tokens[at : at + self.m].tolist() == ids:
                spans.append((first, first + self.m))
                items.update(self.owner[self.owner_at[k] : self.owner_at[k + 1]].tolist())


def searchers(items: list[tuple[str | None, bytes | None]], window: int, block: int = 3) -> list[WuManber]:
    """One search for each length of test string: windows of ``window`` words, shorter items whole.  Items are numbered."""
    vocabulary: dict[bytes, int] = {}
    tokens, starts, owner = array("i"), defaultdict(list), defaultdict(list)
    for number, (_, text) in enumerate(items):
        words = words_of(text)
        width = min(window, len(words))
        if width:
            starts[width].append(np.arange(len(tokens), len(tokens) + len(words) - width + 1))
            owner[width].append(np.full(len(words) - width + 1, number, np.int32))
            tokens.extend([vocabulary.setdefault(x, len(vocabulary)) for x in words])
    flat = np.frombuffer(tokens, np.int32) if tokens else np.empty(0, np.int32)
    return [WuManber(vocabulary, flat, np.concatenate(starts[m]), np.concatenate(owner[m]), m, block) for m in sorted(starts)]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint ascending spans that cover the same words."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


_BUILT: dict[str, list[WuManber]] = {}

_PLACES = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def _found(held, key: str, window: int, texts: Iterable[bytes | None]) -> Iterator[tuple[int, list[dict[str, int]], list[str]]]:
    """Number of words, merged places and item names of each text, for the block of items in the broadcast ``held``."""
    if key not in _BUILT:  # one block at a time stays in a worker that is used again
        _BUILT.clear()
        _BUILT[key] = searchers(held.value, window)
    for text in texts:
        words, spans, items = words_of(text), [], set()
        for finder in _BUILT[key]:
            finder.search(words, spans, items)
        names = {held.value[k][0] for k in items} - {None}
        yield len(words), [{"first": a, "last": b} for a, b in merged(spans)], sorted(names)


def _search(held, key: str, window: int):
    """An Arrow UDF: text -> RESULT."""

    @F.arrow_udf(RESULT)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = list(_found(held, key, window, binary(batch)))
            yield pa.StructArray.from_arrays(
                [pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], _PLACES), pa.array([x[2] for x in rows], pa.list_(pa.string()))],
                names=["n_words", "spans", "item_ids"])

    return run


def _hits(held, key: str, window: int):
    """(name, text) -> (name, spans, item_ids) of the texts that are hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(name, x[1], x[2]) for name, x in zip(batch.column(0).to_pylist(), _found(held, key, window, binary(batch.column(1))), strict=True) if x[1]]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows]), pa.array([x[1] for x in rows], _PLACES), pa.array([x[2] for x in rows], pa.list_(pa.string()))], names=["name", "spans", "item_ids"])

    return run


def _merge(spans: Column) -> Column:
    @F.arrow_udf("array<struct<first:long,last:long>>")
    def run(rows: pa.Array) -> pa.Array:
        return pa.array([[{"first": a, "last": b} for a, b in merged([(x["first"], x["last"]) for x in row])] for row in rows.to_pylist()], rows.type)

    return run(spans)


def _n_words(text: Column) -> Column:
    @F.arrow_udf("long")
    def run(rows: pa.Array) -> pa.Array:
        return pa.array([len(words_of(x)) for x in binary(rows)], pa.int64())

    return run(text)


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_bytes: int = BLOCK_BYTES, out: str = "contamination") -> DataFrame:
    """``docs`` with a struct column ``out``: n_words, spans (word places), item_ids (sorted strings).

    The benchmark is dealt into blocks of about ``block_bytes``; each block is
    broadcast on its own, so what is broadcast and held by a worker is bounded
    whatever the benchmark's size.  With one block no row is moved: each is searched
    where it is read.  With several, each block's search reads the texts alone and
    writes only what it finds, named by the text's hash, and ``docs`` meets all that
    once.  Null texts have no words and no occurrences; a null or wordless item
    gives no test string; items of a null id are searched for, but have no name to
    list; repeated items and windows count once; an empty benchmark hits nothing.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).filter("text IS NOT NULL")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0)).alias("n")).first()["n"]
    n_blocks = -(-size // block_bytes) or 1
    text = F.col(text_col).cast("binary")

    def block(k: int) -> tuple:
        rows = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == k).distinct().select("item", F.col("text").cast("binary").alias("text")).collect()
        found = sorted(((r["item"], bytes(r["text"])) for r in rows), key=lambda x: (x[0] is None, x))
        return spark.sparkContext.broadcast(found), hashlib.sha256(repr((window, found)).encode()).hexdigest(), window

    if n_blocks == 1:
        return docs.withColumn(out, _search(*block(0))(text))
    scratch, hits, name = Scratch(spark, "decontaminate"), [], f"__{out}_name"
    texts = docs.filter(F.col(text_col).isNotNull()).select(F.sha2(text, 256).alias("name"), text.alias("text"))
    for k in range(n_blocks):
        found = texts.mapInArrow(_hits(*block(k)), "name string, spans array<struct<first:long,last:long>>, item_ids array<string>")
        hits.append(scratch.keep(found.groupBy("name").agg(F.first("spans").alias("spans"), F.first("item_ids").alias("item_ids")), f"block{k}"))
    each = reduce(DataFrame.union, hits).groupBy("name").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
    each = each.select(F.col("name").alias(name), F.struct(_merge(F.col("spans")).alias("spans"), "item_ids").alias(f"{name}_found"))
    both, found = docs.withColumn(name, F.sha2(text, 256)).join(each, name, "left"), F.col(f"{name}_found")
    none = lambda c, kind: F.coalesce(found[c], F.array().cast(kind)).alias(c)
    result = F.struct(_n_words(text).alias("n_words"), none("spans", "array<struct<first:long,last:long>>"), none("item_ids", "array<string>"))
    return both.withColumn(out, result).drop(name, f"{name}_found")


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), one row for each document row."""
    found = contamination(docs.select(F.col(id_col).alias("doc_id"), "text"), benchmark)
    x = F.col("contamination")
    n_hit = F.aggregate(x["spans"], F.lit(0).cast("long"), lambda s, v: s + v["last"] - v["first"])
    return found.select("doc_id", x["n_words"].alias("n_words"), n_hit.alias("n_hit"), F.size(x["item_ids"]).cast("long").alias("n_items"),
                        F.sha2(F.array_join(x["item_ids"], ",").cast("binary"), 256).alias("items_sha256"), (F.size(x["spans"]) > 0).alias("contaminated"))
