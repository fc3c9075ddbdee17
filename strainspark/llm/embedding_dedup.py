"""Embedding near-duplicates over sharded small-world graphs.

1. Equal vectors of a label collapse into one node with their number.
2. Each label's nodes are dealt by hash into shards of about SHARD_BYTES; each
   shard gets a hierarchical navigable small-world graph (``hnsw.Graph``).
3. Blocks of nodes query every shard of their label.  A block's audited nodes are
   also compared with the whole shard; while the audit misses links, beams are
   widened and the search is run again.  A beam of the whole shard is a product of
   two matrices, which takes the beams' place where they would be that wide.
4. Cosines are verified in double precision on the vectors as given.
5. A unit of work, one block on one shard, returns each node's number of links
   and a spanning forest of them; components come from the forests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strainspark.llm.components import connected_components
from strainspark.llm.hnsw import Graph
from strainspark.llm.words import mixed
from strainspark.scratch import Scratch

#: Bytes of a shard's vectors in double precision, nodes of a block of queries, and blocks that meet one copy of a shard's graph.
SHARD_BYTES, BLOCK, BLOCKS_A_COPY = 32 << 20, 1024, 8
#: First beam, share of a block's nodes that is audited, and links the audit must find.
BEAM, AUDITED, RECALL = 64, 1 / 32, 0.99
#: The graphs hold single precision; what they meet is verified if it is this near to the threshold.
SLACK = 1e-4


def unit(raw: np.ndarray) -> np.ndarray:
    return raw / np.sqrt((raw * raw).sum(axis=1))[:, None]


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("node")
    raw = np.stack(pdf["v"].to_numpy()).astype("<f8")
    ids = pdf["node"].to_numpy(np.int64)
    graph = Graph(unit(raw).astype(np.float32), ids).build()
    place = np.searchsorted(ids, graph.ids)
    return pd.DataFrame([{"label": pdf["label"].iat[0], "shard": pdf["shard"].iat[0], "ids": graph.ids.astype("<i8").tobytes(), "raw": raw[place].tobytes(), "copies": pdf["copies"].to_numpy("<i8")[place].tobytes(), "levels": [x.astype("<i4").tobytes() for x in graph.levels]}])


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("node")
    return pd.DataFrame([{"label": pdf["label"].iat[0], "block": pdf["block"].iat[0], "q_ids": pdf["node"].to_numpy("<i8").tobytes(), "q_raw": np.stack(pdf["v"].to_numpy()).astype("<f8").tobytes()}])


class _Links:
    """Numbers of links of a block's nodes on one shard, and a spanning forest of the links.

    A shard's node is owned by the first query that linked it; a later query adds
    an edge only for nodes without an owner and for owners not yet connected with
    it, so there are no more edges than nodes however many links there are.
    """

    def __init__(self, queries: int, copies: np.ndarray):
        self.copies, self.count = copies, np.zeros(queries, np.int64)
        self.owner, self.above = np.full(len(copies), -1), list(range(queries))
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []

    def _top(self, x: int) -> int:
        while (y := self.above[x]) != x:
            self.above[x] = self.above[y]
            x = y
        return x

    def add(self, q: int, nodes: np.ndarray) -> None:
        """The links of query ``q``, or more of them; each comes once."""
        self.count[q] += int(self.copies[nodes].sum())
        owners, first = np.unique(self.owner[nodes], return_index=True)
        joined = []
        for owner, at in zip(owners.tolist(), first.tolist(), strict=True):
            if owner >= 0 and (i := self._top(owner)) != (j := self._top(q)):
                self.above[max(i, j)] = min(i, j)
                joined.append(nodes[at])
        new = nodes[self.owner[nodes] < 0]
        self.owner[new] = q
        ends = np.concatenate([new, np.array(joined, new.dtype)])
        self.edges.append((np.full(len(ends), q), ends))


def linked(graph: Graph, raw: np.ndarray, q_ids: np.ndarray, q_raw: np.ndarray, threshold: float, copies: np.ndarray, recall: float = RECALL) -> _Links:
    """All links found of the queries on the graph, none below the threshold; a node doesn't link with itself.

    Beams are widened until the audited nodes' links are found; a block whose audit
    would need a quarter of the shard as its beam, and a node whose links fill half
    its beam, are compared with the whole shard by one product of the matrices.
    """
    queries = unit(q_raw).astype(np.float32)
    mine, theirs = unit(q_raw), unit(raw)
    n, out = len(graph.ids), _Links(len(q_ids), copies)

    def search(which: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        q, x = graph.query(queries[which], beam, threshold - SLACK)
        q = which[q]
        good = q_ids[q] != graph.ids[x]
        q, x = q[good], x[good]
        sure = np.concatenate([np.einsum("nd,nd->n", mine[q[k : k + 65536]], theirs[x[k : k + 65536]]) for k in range(0, len(q), 65536)] or [np.empty(0)]) >= threshold
        return q[sure], x[sure]

    def compared(which: np.ndarray, nodes: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(query, its links) by products with all nodes, or with ``nodes``."""
        others, ids = (theirs, graph.ids) if nodes is None else (theirs[nodes], graph.ids[nodes])
        for k in range(0, len(which), 64):
            some = which[k : k + 64]
            near = (mine[some] @ others.T >= threshold) & (q_ids[some][:, None] != ids[None])
            for i in np.flatnonzero(near.any(axis=1)).tolist():
                found = np.flatnonzero(near[i])
                yield int(some[i]), found if nodes is None else nodes[found]

    audited = np.flatnonzero(mixed(q_ids.astype(np.uint64)) % np.uint64(round(1 / AUDITED)) == 0)
    truth = np.zeros(len(q_ids), np.int64)
    for k, found in compared(audited):
        truth[k] = len(found)
    beam = BEAM
    q, x = search(np.arange(len(q_ids)), beam)
    whole = np.bincount(q, minlength=len(q_ids)) * 2 > beam
    while True:
        # What is compared with the whole shard is found; the audit is of the others.
        asked = audited[~whole[audited]]
        if np.isin(q, asked).sum() >= recall * truth[asked].sum():
            break
        beam *= 2
        if beam * 4 >= n:
            whole[:] = True
            break
        left = np.flatnonzero(~whole)
        q, x = search(left, beam)
        whole |= np.bincount(q, minlength=len(q_ids)) * 2 > beam
    order = np.argsort(q, kind="stable")
    q, x = q[order], x[order]
    starts = np.searchsorted(q, np.arange(len(q_ids) + 1))
    for k in np.flatnonzero(~whole & (np.diff(starts) > 0)).tolist():
        out.add(k, x[starts[k] : starts[k + 1]])
    for k, found in compared(np.flatnonzero(whole)):
        out.add(k, found)
    # No beam meets a node that no path leads to.
    if len(strays := graph.strays()):
        for k, found in compared(np.flatnonzero(~whole), strays):
            out.add(k, found)
    return out


def _query(threshold: float, recall: float):
    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for row in pdf.itertuples():
                ids, q_ids = np.frombuffer(row.ids, "<i8"), np.frombuffer(row.q_ids, "<i8")
                raw, q_raw = (np.frombuffer(x, "<f8").reshape(n, -1) for x, n in ((row.raw, len(ids)), (row.q_raw, len(q_ids))))
                graph = Graph.from_bytes(row.ids, unit(raw).astype("<f4").tobytes(), list(row.levels))
                out = linked(graph, raw, q_ids, q_raw, threshold, np.frombuffer(row.copies, "<i8"), recall)
                yield pd.DataFrame({"a": q_ids, "b": pd.array([None] * len(q_ids), "Int64"), "n": out.count})
                if out.edges:
                    q, x = (np.concatenate([edge[k] for edge in out.edges]) for k in range(2))
                    yield pd.DataFrame({"a": q_ids[q], "b": pd.array(ids[x], "Int64"), "n": 0})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", shard_bytes: int = SHARD_BYTES, block: int = BLOCK, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of ``vectors``.

    Vectors of equal labels link if their cosine is ``threshold`` or more.  A null
    label, a null, empty or zero vector, and one with a null, infinite or NaN
    component link with nothing; vectors of unequal lengths don't link.  Repeated
    rows of an id and vector are one vector; of an id with unequal vectors, each
    has its own links.  A null id has no component and isn't kept.  A shard holds
    about ``shard_bytes`` of vectors, and each block of ``block`` nodes finds at
    least ``recall`` of its audited nodes' links on each shard.  An empty table
    gives no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embeddings")
    every = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = F.coalesce(F.forall("v", finite) & F.exists("v", lambda x: x != 0), F.lit(False)) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    valid = every.filter(usable).select("vec_id", F.concat_ws("/", F.col("label").cast("string"), F.size("v").cast("string")).alias("label"), F.transform("v", lambda x: x.cast("double")).alias("v"))
    nodes = scratch.keep(valid.distinct().groupBy("label", "v").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")), "nodes")

    sizes = nodes.groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d"))
    sizes = scratch.keep(sizes.select("label", F.ceil(F.col("n") * F.col("d") * 8 / shard_bytes).cast("long").alias("shards"), F.ceil(F.col("n") / block).cast("long").alias("blocks")), "sizes")
    copies = F.ceil(F.col("blocks") / BLOCKS_A_COPY).cast("long")
    units = sizes.agg(F.coalesce(F.sum(F.col("shards") * F.col("blocks")), F.lit(0)).alias("n")).first()["n"]
    tasks = int(min(max(units, 1), 50_000))
    dealt = nodes.join(sizes, "label").select("label", "node", "v", "copies", F.pmod(F.xxhash64("node"), F.col("shards")).alias("shard"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).alias("block"))
    graphs = scratch.keep(dealt.repartition(tasks, "label", "shard").groupBy("label", "shard").applyInPandas(_build, "label string, shard long, ids binary, raw binary, copies binary, levels array<binary>"), "graphs")
    blocks = scratch.keep(dealt.select("label", "block", "node", "v").groupBy("label", "block").applyInPandas(_pack, "label string, block long, q_ids binary, q_raw binary"), "blocks")
    zero = F.lit(0).cast("long")
    left = graphs.join(sizes, "label").select(graphs["*"], F.explode(F.sequence(zero, copies - 1)).alias("copy"))
    right = blocks.join(sizes, "label").select(blocks["*"], F.floor(F.col("block") / BLOCKS_A_COPY).alias("copy"), F.explode(F.sequence(zero, F.col("shards") - 1)).alias("shard"))
    keys = ["label", "shard", "copy"]
    met = left.repartition(tasks, *keys).join(right.repartition(tasks, *keys), keys).select("ids", "raw", "copies", "levels", "q_ids", "q_raw")
    found = scratch.keep(met.mapInPandas(_query(threshold, recall), "a long, b long, n long"), "found")
    scratch.drop("graphs", "blocks")

    counts = found.filter("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    components = connected_components(found.filter("b IS NOT NULL").select("a", "b"), scratch)
    state = nodes.join(counts, "node", "left").join(components, "node", "left").select("label", "v", F.coalesce("component", "node").alias("component"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    keyed = every.select("vec_id", F.when(usable, F.concat_ws("/", F.col("label").cast("string"), F.size("v").cast("string"))).alias("label"), F.when(usable, F.transform("v", lambda x: x.cast("double"))).alias("v"))
    out = keyed.join(state, ["label", "v"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
