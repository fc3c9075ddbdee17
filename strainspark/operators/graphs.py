"""Neighbour graphs of vectors and communities of weighted graphs.

A graph is a table of edges (a, b, w).  Communities are found by moves that raise the
modularity and by contracting them, level by level; every step is a join or an
aggregate over the edges, and no list of nodes or neighbours is held in one place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strainspark.scratch import Scratch

#: Vectors that are compared with each other as a whole; with more, tables of buckets of about that size are searched.
BUCKET, TABLES = 2000, 12


def _codes(planes: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                v = np.stack(batch["v"].to_numpy())
                for t, own in enumerate(planes):
                    yield batch.assign(table=t, code=((v @ own.T) > 0) @ (1 << np.arange(len(own), dtype=np.int64)))

    return run


def _nearest(k: int, sides: bool = False):
    """The k nearest of a bucket's vectors, of all others or, with ``sides``, of those that don't ask to those that do."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        ids, v = pdf["id"].to_numpy(), np.stack(pdf["v"].to_numpy())
        v = v / np.sqrt((v * v).sum(axis=1, keepdims=True))
        asks = pdf["asks"].to_numpy(bool) if sides else np.ones(len(v), bool)
        to = np.flatnonzero(~asks) if sides else np.arange(len(v))
        out = [pd.DataFrame({"q": ids[:0], "id": ids[:0], "sim": np.empty(0)})]
        wanted = min(k, len(to) - (not sides))
        of = np.flatnonzero(asks)
        for low in range(0, len(of) if wanted > 0 else 0, 256):
            here = of[low : low + 256]
            sim = np.round(v[here] @ v[to].T, 9)
            if not sides:
                sim[np.arange(len(here)), here] = -np.inf
            best = np.argsort(-sim, axis=1, kind="stable")[:, :wanted]
            out.append(pd.DataFrame({"q": np.repeat(ids[here], wanted), "id": ids[to][best.ravel()], "sim": np.take_along_axis(sim, best, 1).ravel()}))
        return pd.concat(out)

    return run


def _in_buckets(vectors: DataFrame, n: int, scratch: Scratch, bucket: int, tables: int, seed: int) -> DataFrame:
    """(id, v, ..., table, code, part) of (id, v, ...): each vector in its bucket of every table."""
    bits = max(0, math.ceil(math.log2(n / bucket))) if n else 0
    if not bits:
        return vectors.withColumns({"table": F.lit(0), "code": F.lit(0).cast("long"), "part": F.lit(0).cast("long")})
    planes = np.random.default_rng(seed).normal(size=(tables, bits, len(vectors.first()["v"])))
    schema = ", ".join(f"`{name}` {kind}" for name, kind in vectors.dtypes)
    coded = scratch.keep(vectors.mapInPandas(_codes(planes), f"{schema}, table int, code long"), "coded")
    sizes = coded.groupBy("table", "code").agg(F.ceil(F.count("*") / (4 * bucket)).alias("parts"))
    return coded.join(sizes, ["table", "code"]).withColumn("part", F.pmod(F.xxhash64("id", "table"), F.col("parts"))).drop("parts")


def _best(found: DataFrame, k: int) -> DataFrame:
    """(q, id, sim, rank): the k nearest of those found in any bucket; a vector meets k partners a table at most, so what is gathered for it is bounded."""
    met = F.array_sort(F.collect_set(F.struct((-F.col("sim")).alias("far"), F.col("id"))))
    best = found.groupBy("q").agg(F.slice(met, 1, k).alias("best"))
    return best.select("q", F.posexplode("best").alias("rank", "b")).select("q", "b.id", (-F.col("b.far")).alias("sim"), (F.col("rank") + 1).alias("rank"))


def _usable(vectors: DataFrame) -> DataFrame:
    return vectors.filter(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x) > 0)


def knn_graph(vectors: DataFrame, k: int, scratch: Scratch, bucket: int = BUCKET, tables: int = TABLES, seed: int = 1, within: str | None = None) -> DataFrame:
    """(q, id, sim, rank): the k most similar other vectors of every vector (id, v) by cosine, of those equal in ``within`` if it is given; of equals the smaller id.

    Up to ``bucket`` vectors are compared exactly.  More are dealt ``tables`` times
    into buckets by the sides of random planes on which they lie, and compared within
    their buckets; one that comes out larger than four times ``bucket`` (copies, say)
    is dealt further by a hash.  So the work is the number of vectors times the
    bucket's size, and a pair is missed only if no table brings it together.  Null
    vectors and such without a direction have no neighbours.
    """
    also = [within] if within else []
    usable, kind = _usable(vectors.select("id", "v", *also)), dict(vectors.dtypes)["id"]
    placed = _in_buckets(usable, usable.count(), scratch, bucket, tables, seed)
    return _best(placed.groupBy(*also, "table", "code", "part").applyInPandas(_nearest(k), f"q {kind}, id {kind}, sim double"), k)


def cross_knn(left: DataFrame, right: DataFrame, k: int, scratch: Scratch, bucket: int = BUCKET, tables: int = TABLES, seed: int = 1) -> DataFrame:
    """(q, id, sim, rank): the k most similar vectors of ``right`` of every vector of ``left``, both (id, v), as in ``knn_graph``."""
    both = _usable(left.select("id", "v", F.lit(True).alias("asks")).unionByName(right.select("id", "v", F.lit(False).alias("asks"))))
    kind = dict(left.dtypes)["id"]
    placed = _in_buckets(both, both.count(), scratch, bucket, tables, seed)
    return _best(placed.groupBy("table", "code", "part").applyInPandas(_nearest(k, True), f"q {kind}, id {kind}, sim double"), k)


def neighbour_edges(neighbours: DataFrame, weights: str = "jaccard") -> DataFrame:
    """(a, b, w), a < b: the undirected edges of (q, id), each once.

    w is 1, or with "jaccard" the shared over the united neighbours of both ends; edges
    without a shared neighbour go.
    """
    edges = neighbours.select(F.least("q", "id").alias("a"), F.greatest("q", "id").alias("b")).distinct()
    if weights == "count":
        return edges.withColumn("w", F.lit(1.0))
    lists = neighbours.groupBy("q").agg(F.collect_set("id").alias("own"))
    both = edges.join(lists.select(F.col("q").alias("a"), F.col("own").alias("of_a")), "a").join(lists.select(F.col("q").alias("b"), F.col("own").alias("of_b")), "b")
    return both.select("a", "b", (F.size(F.array_intersect("of_a", "of_b")) / F.size(F.array_union("of_a", "of_b"))).alias("w")).filter("w > 0")


def both_ways(edges: DataFrame) -> DataFrame:
    """(a, b, w) from either end; an edge from a node to itself counts twice, as its two ends do."""
    turned = edges.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "w")
    own = edges.filter("a = b").select("a", "b", (2 * F.col("w")).alias("w"))
    return edges.filter("a <> b").select("a", "b", "w").unionByName(turned).unionByName(own).groupBy("a", "b").agg(F.sum("w").alias("w"))


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """(community, inside, share, modularity): of each community of (node, community) the share of edge weight inside it, that of its ends, and what it adds to the modularity.

    ``edges``: (a, b, w), each once; a node without a community is left out.
    """
    return _modularity(both_ways(edges), communities)


def _by_community(ends: DataFrame, communities: DataFrame) -> DataFrame:
    """(community, i, t): weight of ends whose other end is in the same community, and of all ends."""
    of = lambda x: communities.select(F.col("node").alias(x), F.col("community").alias(f"c{x}"))
    placed = ends.join(of("a"), "a").join(of("b"), "b")
    return placed.groupBy(F.col("ca").alias("community")).agg(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0)).alias("i"), F.sum("w").alias("t"))


def _modularity(ends: DataFrame, communities: DataFrame) -> DataFrame:
    by = _by_community(ends, communities)
    whole = by.agg(F.sum("t").alias("all"))
    x = by.crossJoin(F.broadcast(whole)).select("community", (F.col("i") / F.col("all")).alias("inside"), (F.col("t") / F.col("all")).alias("share"))
    return x.withColumn("modularity", F.col("inside") - F.col("share") * F.col("share"))


def _moves(ends: DataFrame, state: DataFrame, whole: float) -> DataFrame:
    """(node, home, to, gain): each node's best move to a neighbour's community, where it gains.

    The gain is half the change of the modularity times the weight of all ends.
    """
    totals = state.groupBy("community").agg(F.sum("k").alias("total"), F.count("*").alias("size"))
    near = ends.filter("a <> b").join(state.select(F.col("node").alias("b"), F.col("community").alias("to")), "b").groupBy(F.col("a").alias("node"), "to").agg(F.sum("w").alias("w"))
    own = state.select("node", F.col("community").alias("to"), F.lit(0.0).alias("w"))
    offers = near.unionByName(own).groupBy("node", "to").agg(F.sum("w").alias("w")).join(state.select("node", F.col("community").alias("home"), "k"), "node").join(totals.withColumnRenamed("community", "to"), "to")
    stays = F.col("to") == F.col("home")
    worth = F.col("w") - F.col("k") * (F.col("total") - F.when(stays, F.col("k")).otherwise(0.0)) / F.lit(whole)
    # Of equal offers the smaller community.
    offer = F.struct((-F.round(worth, 12)).alias("cost"), "to", "size")
    best = offers.groupBy("node", "home").agg(F.min(F.when(~stays, offer)).alias("best"), F.max(F.when(stays, worth)).alias("stay"), F.max(F.when(stays, F.col("size"))).alias("mates"))
    moves = best.select("node", "home", F.col("best.to").alias("to"), (-F.col("best.cost") - F.col("stay")).alias("gain"), F.col("mates").alias("home_size"), F.col("best.size").alias("to_size"))
    return moves.filter("gain > 1e-10")


def _apart(moves: DataFrame) -> DataFrame:
    """Moves of which no two touch one community, the largest gains first; their gains add up exactly."""
    rank = F.struct("gain", "node")
    touched = moves.select(F.explode(F.array("home", "to")).alias("community"), rank.alias("rank")).groupBy("community").agg(F.max("rank").alias("first"))
    home, to = (touched.select(F.col("community").alias(x), F.col("first").alias(f"first_{x}")) for x in ("home", "to"))
    return moves.join(home, "home").join(to, "to").filter((F.col("first_home") == rank) & (F.col("first_to") == rank)).select(*moves.columns)


def louvain(edges: DataFrame, scratch: Scratch, tolerance: float = 1e-4) -> tuple[DataFrame, list[float]]:
    """((node, community), modularities): communities by modularity, named by their smallest first-level node, and the modularity of each level.

    In each round all nodes look for their best move, and half of them, drawn by a
    hash, make it at once (of two single nodes the larger goes to the smaller).
    Neighbours that move together can spoil each other's gain, so the modularity is
    computed; where it didn't rise, only moves of which no two touch one community are
    made, whose gains add up.  So no round lowers it.  A level ends without moves or
    with a rise below ``tolerance``; its communities become the next one's nodes.
    Nodes without edges aren't returned, weights that aren't positive are left out.
    """
    ends = scratch.keep(both_ways(edges.filter("w > 0")), "ends0")
    whole = ends.agg(F.sum("w").alias("w")).first()["w"]
    member = ends.select(F.col("a").alias("node")).distinct().withColumn("community", F.col("node"))
    if not whole:
        return member, []
    member, levels, level = scratch.keep(member, "member0"), [], 0

    def score(state: DataFrame) -> float:
        sums = _by_community(ends, state).agg(F.sum("i").alias("i"), F.sum(F.col("t") * F.col("t")).alias("t")).first()
        return sums["i"] / whole - sums["t"] / whole**2

    while True:
        state = scratch.keep(ends.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k")).withColumn("community", F.col("node")), f"state{level}_0")
        before, rounds = score(state), 0
        start = before
        while True:
            rounds += 1
            moves = scratch.keep(_moves(ends, state, whole), f"moves{level}_{rounds}")
            if moves.isEmpty():
                break
            drawn = (F.pmod(F.xxhash64("node", F.lit(level), F.lit(rounds)), F.lit(2)) == 0) & ((F.col("home_size") > 1) | (F.col("to_size") > 1) | (F.col("to") < F.col("home")))
            for chosen in (moves.filter(drawn), _apart(moves)):
                following = state.join(chosen.select("node", "to"), "node", "left").select("node", "k", F.coalesce("to", "community").alias("community"))
                following = scratch.keep(following, f"state{level}_{rounds}")
                q = score(following)
                if q > before + 1e-12:
                    break
            else:  # gains too small for the precision of the sum
                scratch.drop(f"state{level}_{rounds}")
                break
            scratch.drop(f"state{level}_{rounds - 1}", f"moves{level}_{rounds}")
            state, rise, before = following, q - before, q
            if rise < tolerance:
                break
        if before <= start:
            break
        named = state.join(state.groupBy("community").agg(F.min("node").alias("name")), "community").select("node", "name")
        named = scratch.keep(named, f"named{level}")
        levels.append(before)
        level += 1
        member = scratch.keep(member.join(named, F.col("community") == named["node"]).select(member["node"], F.col("name").alias("community")), f"member{level}")
        of = lambda x: named.select(F.col("node").alias(x), F.col("name").alias(f"n{x}"))  # noqa: E731, B023
        ends = scratch.keep(ends.join(of("a"), "a").join(of("b"), "b").groupBy(F.col("na").alias("a"), F.col("nb").alias("b")).agg(F.sum("w").alias("w")), f"ends{level}")
        scratch.drop(f"ends{level - 1}", f"member{level - 1}")
    return member, levels
