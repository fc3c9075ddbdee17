"""A hierarchical navigable small-world graph over unit vectors, in numpy.

Searches and insertions run in batches: each step widens the beams of all the
batch's queries at once, so the work is a few large array operations.
"""

from __future__ import annotations

import numpy as np

from strainspark.llm.words import mixed

#: Links of a node above the ground level; twice as many on it.
LINKS = 12
#: Beam of insertions.
BUILD_BEAM = 48
BATCH = 128


class Graph:
    """Levels of neighbour tables; -1 fills unused places.  ``vectors`` are unit vectors, float32."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        self.vectors = np.ascontiguousarray(vectors, np.float32)
        self.ids = ids
        self.levels: list[np.ndarray] = []
        self.entry = 0

    def build(self) -> Graph:
        n = len(self.vectors)
        # Levels by a hash of the id: a node is on level k with probability LINKS ** -k.
        u = (mixed(self.ids.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D)) >> np.uint64(11)).astype(float) / 2.0**53
        level = np.minimum((-np.log(np.maximum(u, 1e-18)) / np.log(LINKS)).astype(int), 6)
        # Highest nodes come first, so every level has its entry when lower nodes arrive.
        order = np.argsort(-level, kind="stable")
        self.vectors, self.ids, level = self.vectors[order], self.ids[order], level[order]
        top = int(level[0]) if n else 0
        self.levels = [np.full((int((level >= k).sum()), LINKS * (1 if k else 2)), -1, np.int32) for k in range(top + 1)]
        for at in range(1, n, BATCH):
            # The first batches are small, so that they find something to link with.
            step = min(BATCH, at)
            for first in range(at, min(at + BATCH, n), step):
                self._insert(np.arange(first, min(first + step, at + BATCH, n)), first)
        return self

    def _insert(self, new: np.ndarray, known: int) -> None:
        queries = self.vectors[new]
        near = np.zeros((len(new), 1), np.int32)
        inside = queries @ queries.T
        np.fill_diagonal(inside, -2)
        for k in range(len(self.levels) - 1, -1, -1):
            rows = len(self.levels[k])
            here = new < rows
            near, sims = self._search(queries, near, k, BUILD_BEAM if here.any() else 1, min(known, rows))
            if not here.any():
                continue
            # The batch's own nearest members are candidates too.
            own = np.argsort(-inside, axis=1)[:, : min(8, len(new) - 1)] if len(new) > 1 else np.empty((len(new), 0), int)
            for i in np.flatnonzero(here):
                c = np.concatenate([near[i][near[i] >= 0], new[own[i]][new[own[i]] < rows]])
                s = np.concatenate([sims[i][near[i] >= 0], inside[i][own[i]][new[own[i]] < rows]])
                for x in self._select(c, s, self.levels[k].shape[1] // (1 if k else 2)):
                    self._link(k, int(new[i]), int(x))
                    self._link(k, int(x), int(new[i]))

    def _select(self, nodes: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Nearest first, each nearer to the centre than to those chosen; then the nearest of the others."""
        order = np.argsort(-sims, kind="stable")
        nodes, sims = nodes[order], sims[order]
        if len(nodes) <= most:
            return nodes
        between = self.vectors[nodes] @ self.vectors[nodes].T
        chosen: list[int] = []
        worst = np.full(len(nodes), -2.0, np.float32)
        for k in range(len(nodes)):
            if worst[k] < sims[k]:
                chosen.append(k)
                np.maximum(worst, between[k], out=worst)
                if len(chosen) == most:
                    break
        rest = [k for k in range(len(nodes)) if k not in set(chosen)]
        return nodes[chosen + rest[: most - len(chosen)]]

    def _link(self, k: int, a: int, b: int) -> None:
        if a == b:
            return
        row = self.levels[k][a]
        if (row == b).any():
            return
        free = np.flatnonzero(row < 0)
        if len(free):
            row[free[0]] = b
            return
        nodes = np.append(row, b)
        row[:] = self._select(nodes, self.vectors[nodes] @ self.vectors[a], len(row))

    def _search(self, queries: np.ndarray, start: np.ndarray, k: int, beam: int, known: int, hits: list | None = None, least: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
        """Beams (nodes, similarities), nearest first, among the first ``known`` nodes of level k.

        ``hits`` gets (query, node) arrays of all nodes looked at with a similarity of ``least`` or more.
        """
        q, table = len(queries), self.levels[k]
        nodes = np.full((q, beam), -1, np.int32)
        sims = np.full((q, beam), -3.0, np.float32)
        done = np.ones((q, beam), bool)
        seen = np.zeros((q, known + 1), bool)
        rows = np.arange(q)
        seen[:, known] = True

        def add(who: np.ndarray, found: np.ndarray) -> None:
            """found: candidates of the queries ``who``, one row each, -1 where none."""
            found = np.where((found < 0) | (found >= known), known, found)
            fresh = ~seen[who[:, None], found]
            seen[who[:, None], found] = True
            seen[:, known] = True
            value = np.where(fresh, np.einsum("qcd,qd->qc", self.vectors[np.minimum(found, len(self.vectors) - 1)], queries[who]), -3.0).astype(np.float32)
            if hits is not None:
                i, j = np.nonzero(value >= least)
                hits.append((who[i], found[i, j]))
            all_nodes = np.concatenate([nodes[who], np.where(fresh, found, -1)], axis=1)
            all_sims = np.concatenate([sims[who], value], axis=1)
            all_done = np.concatenate([done[who], ~fresh], axis=1)
            best = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
            nodes[who], sims[who], done[who] = (np.take_along_axis(x, best, axis=1) for x in (all_nodes, all_sims, all_done))

        width = start.shape[1]
        start = np.where(start < known, start, 0) if known else start
        # A node twice among the starts counts once.
        ordered = np.sort(start, axis=1)
        ordered[:, 1:][ordered[:, 1:] == ordered[:, :-1]] = -1
        add(rows, ordered.reshape(q, width))
        while True:
            # Beams hold what can still improve them: open nodes, nearest first.
            open_ = ~done & (nodes >= 0)
            active = np.flatnonzero(open_.any(axis=1))
            if not len(active):
                return nodes, sims
            pick = open_[active].argmax(axis=1)
            at = nodes[active, pick]
            done[active, pick] = True
            add(active, table[at])

    def query(self, queries: np.ndarray, beam: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs of the nodes met whose similarity is ``least`` or more, by float32."""
        n = len(self.vectors)
        if not n or not len(queries):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        pairs_q, pairs_n = [], []
        for first in range(0, len(queries), BATCH):
            some = queries[first : first + BATCH]
            near = np.zeros((len(some), 1), np.int32)
            for k in range(len(self.levels) - 1, 0, -1):
                near = self._search(some, near, k, 4, len(self.levels[k]))[0]
            hits: list[tuple[np.ndarray, np.ndarray]] = []
            self._search(some, near, 0, min(beam, n), n, hits, least)
            pairs_q += [x + first for x, _ in hits]
            pairs_n += [y for _, y in hits]
        return np.concatenate(pairs_q), np.concatenate(pairs_n)

    def strays(self) -> np.ndarray:
        """Nodes that no path leads to on the ground level from the nodes above, where searches begin."""
        n = len(self.vectors)
        met = np.zeros(n + 1, bool)
        met[n] = True
        edge = np.arange(len(self.levels[1]) if len(self.levels) > 1 else min(n, 1))
        met[edge] = True
        while len(edge):
            edge = np.unique(self.levels[0][edge])
            edge = edge[(edge >= 0) & ~met[edge]]
            met[edge] = True
        return np.flatnonzero(~met[:n])

    def to_bytes(self) -> dict:
        return {"ids": self.ids.astype("<i8").tobytes(), "vectors": self.vectors.astype("<f4").tobytes(), "levels": [x.astype("<i4").tobytes() for x in self.levels]}

    @classmethod
    def from_bytes(cls, ids: bytes, vectors: bytes, levels: list[bytes]) -> Graph:
        ids_ = np.frombuffer(ids, "<i8")
        out = cls(np.frombuffer(vectors, "<f4").reshape(len(ids_), -1), ids_)
        out.levels = [np.frombuffer(x, "<i4").reshape(-1, LINKS * (1 if k else 2)) for k, x in enumerate(levels)]
        return out
