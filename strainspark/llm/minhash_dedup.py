"""MinHash near-duplicates with odd-sketch candidate verification.

1. Every document gets the set of its word shingles, hashed; documents with equal
   sets collapse into one class (a map-side combined group-by), so a group of
   copies of any size is one row from here on.
2. 128 MinHash samples form 32 bands of 4: at a similarity of 0.75 a pair shares
   no band with a probability of 5e-6.  The samples are also folded into an odd
   sketch, a parity bitmap in which the XOR of two bitmaps holds about the
   samples that differ.
3. In each band bucket every class is paired with the bucket's smallest class
   only (a star); the sketches' XOR population count drops pairs that can't
   reach the threshold, and the rest are confirmed on full shingle sets.
4. Buckets whose classes are not in one component yet are searched again, between
   components only, in blocks: a bucket is dealt into blocks of BLOCK classes and
   pairs of blocks are searched where they meet.  A first search, by sketches,
   finds the classes of which some pair passes; a second, over these with their
   texts, confirms pairs on full sets and returns as many links as connect the
   components.  No pairs are emitted for a later step, and no bucket is held as a
   whole.
5. Connected components over all confirmed links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strainspark.llm.components import connected_components
from strainspark.llm.words import WordHashes, binary, mixed, shingle_set
from strainspark.scratch import Scratch

BANDS, ROWS = 32, 4
SKETCH_BITS = 512
#: Classes of a bucket that one group of the second search holds of each side.
BLOCK = 512

SIGNATURE = f"doc_id long, text_hash long, n_shingles long, set_a long, set_b long, bands array<long>, {', '.join(f's{k} long' for k in range(SKETCH_BITS // 64))}"
SKETCH = [f"s{k}" for k in range(SKETCH_BITS // 64)]


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of the MinHash samples, from a fixed seed."""
    seeds = mixed(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[0::2] | np.uint64(1), seeds[1::2]


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """MinHash samples of a non-empty set, in slices that bound the memory of long texts."""
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 1024):
        np.minimum(low, (shingles[k : k + 1024, None] * a + b).min(axis=0), out=low)
    return low


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity bitmap of the (position, sample) pairs, as 64-bit words."""
    place = mixed(samples + np.arange(len(samples), dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) % np.uint64(SKETCH_BITS)
    odd = np.bincount(place.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def expected_parity(similarity: float, samples: int = BANDS * ROWS) -> float:
    """Expected number of ones in the XOR of two sketches at this similarity."""
    return SKETCH_BITS / 2 * (1 - math.exp(-2 * (2 * samples * (1 - similarity)) / SKETCH_BITS))


def _most_parity(threshold: float) -> int:
    """The population count beyond which a pair is dropped: four standard errors
    of the sample below the threshold, and four of the parities beside it."""
    low = max(0.0, threshold - 4 * math.sqrt(threshold * (1 - threshold) / (BANDS * ROWS)))
    ones = expected_parity(low)
    return math.ceil(ones + 4 * math.sqrt(ones * (1 - ones / SKETCH_BITS)) / 2)


def _signatures(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, (a, b) = WordHashes(), _coefficients()
        high = np.arange(BANDS, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for batch in batches:
                counts, keys, bands, sketches = [], [], [], []
                for text in binary(batch.column(1)):
                    shingles = shingle_set(text, size, hashes.fresh())
                    counts.append(len(shingles))
                    keys.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                    if len(shingles):
                        samples = signature(shingles, a, b)
                        joined = high.copy()
                        for k in range(ROWS):
                            joined = mixed(joined * np.uint64(0x9E3779B97F4A7C15) + samples[k::ROWS])
                        bands.append(joined.view(np.int64))
                        sketches.append(odd_sketch(samples).view(np.int64))
                    else:
                        bands.append(None)
                        sketches.append(np.zeros(SKETCH_BITS // 64, np.int64))
                key = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
                sketch = np.array(sketches, np.int64).reshape(-1, SKETCH_BITS // 64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array(counts, pa.int64()), pa.array(key[:, 0]), pa.array(key[:, 1]), pa.array(bands, pa.list_(pa.int64())), *(pa.array(sketch[:, k]) for k in range(sketch.shape[1]))],
                    names=["doc_id", "text_hash", "n_shingles", "set_a", "set_b", "bands", *SKETCH])

    return run


def _confirm(size: int, threshold: int):
    """Keeps the pairs (a, b) whose texts' full sets meet 100 * both >= threshold * either."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: WordHashes = WordHashes()
        last: tuple[bytes | None, np.ndarray] = (b"", np.empty(0, np.uint64))
        with np.errstate(over="ignore"):
            for batch in batches:
                found = []
                for x, y in zip(binary(batch.column(2)), binary(batch.column(3)), strict=True):
                    if x != last[0]:
                        last = (x, shingle_set(x, size, hashes.fresh()))
                    other = shingle_set(y, size, hashes)
                    both = len(np.intersect1d(last[1], other, assume_unique=True))
                    found.append(100 * both >= threshold * (len(last[1]) + len(other) - both))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(found, pa.bool_()))

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The runs of rows of one (key, p, q), which the input is sorted by."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]) if held is not None else table
        keys = np.stack([table[x].to_numpy() for x in ("key", "p", "q")], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist()]
        for first, last in zip(cuts, cuts[1:], strict=False):
            yield table.slice(first, last - first)
        held = table.slice(cuts[-1])
    if held is not None and held.num_rows:
        yield held


def _near(group: pa.Table, most: int, threshold: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, rows) that sketches and sizes let pass, of different components; each pair of rows once."""
    i, p, q = (group[x].to_numpy() for x in ("i", "p", "q"))
    left, right = np.flatnonzero(i == p), np.flatnonzero(i == q)
    sketch = np.stack([group[s].to_numpy() for s in SKETCH], axis=1).view(np.uint64)
    component, n = group["component"].to_numpy(), group["n_shingles"].to_numpy()
    for k in left.tolist():
        near = right[(component[right] != component[k]) & (100 * np.minimum(n[k], n[right]) >= threshold * np.maximum(n[k], n[right]))]
        near = near[np.bitwise_count(sketch[near] ^ sketch[k]).sum(axis=1) <= most]
        if p[0] == q[0]:
            near = near[near > k]
        if len(near):
            yield k, near


def _promising(most: int, threshold: int):
    """The members of each group that some pair lets pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            rows = np.unique(np.concatenate([x for k, near in _near(group, most, threshold) for x in ([k], near)] or [np.empty(0, np.int64)])).astype(np.int64)
            if len(rows):
                found = group.select(["key", "node"]).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([c.combine_chunks() for c in found.columns], names=["key", "node"])

    return run


def _search(size: int, most: int, threshold: int):
    """Links between components within each group, confirmed on full sets; as many as connect them.

    A pair that meets in several buckets is looked at in the first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for group in _groups(batches):
            bands = group["bands"].combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
            key, node, component = group["key"][0].as_py(), group["node"].to_numpy(), group["component"].to_numpy()
            with np.errstate(over="ignore"):
                sets = [shingle_set(x, size, hashes.fresh()) for x in binary(group["text"])]
            lengths = np.array([len(x) for x in sets])
            # Shingles as small numbers, so that a set is a mark in a table and a count of shared ones a look-up.
            number = np.unique(np.concatenate(sets), return_inverse=True)[1]
            ends = np.cumsum(lengths)
            mark = np.zeros(int(number.max(initial=0)) + 1, bool)
            above: dict[int, int] = {}

            def top(x: int, above: dict[int, int] = above) -> int:
                while (y := above.get(x, x)) != x:
                    x = y
                return x

            found = []
            for k, near in _near(group, most, threshold):
                same = bands[near] == bands[k]
                near = near[bands[k][same.argmax(axis=1)] == key]
                mine = number[ends[k] - lengths[k] : ends[k]]
                mark[mine] = True
                for x in near.tolist():
                    a, b = top(int(component[k])), top(int(component[x]))
                    if a == b:
                        continue
                    both = int(np.count_nonzero(mark[number[ends[x] - lengths[x] : ends[x]]]))
                    if 100 * both >= threshold * (lengths[k] + lengths[x] - both):
                        above[max(a, b)] = min(a, b)
                        found.append((int(node[k]), int(node[x])))
                mark[mine] = False
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], names=["a", "b"])

    return run


def _parity(x: str, y: str) -> Column:
    total = F.bit_count(F.col(f"{x}.s0").bitwiseXOR(F.col(f"{y}.s0")))
    for s in SKETCH[1:]:
        total = total + F.bit_count(F.col(f"{x}.{s}").bitwiseXOR(F.col(f"{y}.{s}")))
    return total


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: int = 75) -> DataFrame:
    """Near-duplicate groups of ``docs``: (doc_id, n_shingles, component_id, kept, text_hash, group).

    Documents link when ``100 * shared >= threshold * united`` shingles.  One row
    for each input row; component_id is the smallest id reachable by links.  A
    null or wordless text has n_shingles 0 and links with nothing; repeated rows
    are copies of each other; rows of a null id keep component_id null and kept
    false, as they can't be told apart; an empty table gives an empty result.
    Rows of one id with different texts are judged each by its own text; ``text_hash``
    tells them apart, and ``group``, the least set hash of the component (null for an
    empty set), tells apart components of one smallest id.  Other columns are never read.
    """
    spark = docs.sparkSession
    scratch, most = Scratch(spark, "minhash"), _most_parity(threshold / 100)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    each = scratch.keep(texts.mapInArrow(_signatures(shingle), SIGNATURE), "each")

    # One row for each distinct shingle set, numbered where it is written; the first text of its smallest document stands for it.
    some = each.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    sets = some.groupBy("set_a", "set_b").agg(F.min(F.struct("doc_id", "text_hash")).alias("doc"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), *(F.first(s).alias(s) for s in SKETCH))
    classes = scratch.keep(sets.withColumn("node", F.monotonically_increasing_id()), "classes")
    slim = classes.select("node", "n_shingles", *SKETCH)

    banded = classes.select("node", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("n")).filter("n > 1")
    members = scratch.keep(banded.join(buckets, "key"), "members")

    def sketched(pairs: DataFrame) -> DataFrame:
        x, y = slim.alias("x"), slim.alias("y")
        return (pairs.join(x, F.col("a") == F.col("x.node")).join(y, F.col("b") == F.col("y.node"))
                .filter((_parity("x", "y") <= most) & (100 * F.least("x.n_shingles", "y.n_shingles") >= threshold * F.greatest("x.n_shingles", "y.n_shingles")))
                .select("a", "b"))

    # One pass over the texts for all later verification.
    nodes = classes.join(members.select("node").distinct(), "node", "left_semi").select("node", "doc.doc_id", "doc.text_hash")
    held = scratch.keep(texts.hint("merge").join(nodes, ["doc_id", "text_hash"]).groupBy("node").agg(F.min("text").alias("text")), "held")

    stars = members.filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    x, y = held.select(F.col("node").alias("a"), F.col("text").alias("left")), held.select(F.col("node").alias("b"), F.col("text").alias("right"))
    linked = scratch.keep(sketched(stars).join(y, "b").join(x, "a").select("a", "b", "left", "right").mapInArrow(_confirm(shingle, threshold), "a long, b long"), "linked")

    # Buckets that hold several components still, dealt into blocks: each block meets itself and each other block once.
    first = connected_components(linked, scratch, "first")
    placed = members.join(first, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    open_buckets = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).filter("low < high")
    rest = scratch.keep(placed.join(open_buckets.select("key", "n"), "key").join(slim, "node"), "rest")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def dealt(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("long")).withColumn("i", F.pmod(F.xxhash64("node"), F.col("blocks")))
        rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        rows = rows.withColumn("p", F.least("i", "j")).withColumn("q", F.greatest("i", "j")).drop("j", "blocks", "n")
        return rows.repartition(tasks, "key", "p", "q").sortWithinPartitions("key", "p", "q")

    promising = scratch.keep(dealt(rest).mapInArrow(_promising(most, threshold), "key long, node long").distinct(), "promising")
    sizes = promising.groupBy("key").agg(F.count("*").alias("n"))
    again = rest.drop("n").join(promising, ["key", "node"]).join(sizes, "key")
    again = again.join(classes.select("node", "bands"), "node").join(held, "node")
    linked2 = scratch.keep(dealt(again).mapInArrow(_search(shingle, most, threshold), "a long, b long"), "linked2")
    scratch.drop("members", "held", "rest", "promising")

    found = connected_components(linked.union(linked2), scratch, "all")
    placed = classes.select("set_a", "set_b", "node", "doc.doc_id").join(found, "node", "left").select("set_a", "set_b", F.coalesce("component", "node").alias("top"), F.col("doc_id").alias("first"))
    tops = placed.groupBy("top").agg(F.min("first").alias("component_id"), F.min("set_a").alias("group"), F.count("*").alias("n")).filter("n > 1").drop("n")
    component = placed.join(tops, "top", "left").select("set_a", "set_b", F.coalesce("component_id", "first").alias("component_id"), F.coalesce("group", "set_a").alias("group"))
    out = each.select("doc_id", "text_hash", "n_shingles", "set_a", "set_b").join(component, ["set_a", "set_b"], "left")
    linked_with_none = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    own = F.when(linked_with_none, F.col("doc_id")).otherwise(F.col("component_id"))
    return (out.select("doc_id", "n_shingles", own.alias("component_id"), "text_hash", F.when(~linked_with_none, F.col("group")).alias("group"))
            .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"), "text_hash", "group"))
