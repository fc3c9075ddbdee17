"""Alignment of two tokenizers' tokens over the same bytes.

1. A worker encodes each text twice and merges the cumulative token ends of both with
   two pointers: where both end at one byte, a group closes.  Every token of one side
   is linked with every token of the other within its group.
2. Documents are gathered into chunks of a bounded number of links.  A chunk is one
   row: its documents' figures, the distinct id pairs it holds, in how many of its
   documents each is linked, and for each document the places of its pairs and how
   often they occur.  So a pair that all documents hold is one row a chunk, and links
   are never rows.
3. Spark sums the pairs' documents over the chunks, takes each id's highest count on
   either side, and joins both back to the chunks' pairs; a worker adds them up by
   document, a chunk at a time.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strainspark.llm.token_files import _byte_letters
from strainspark.scratch import Scratch

#: Links of a chunk, at which the next one begins; a document of more has a chunk of its own.
CHUNK_LINKS = 1_000_000
#: Links of a group beyond which it is counted by its distinct ids.
BLOCK_LINKS = 1 << 18

#: The splitting pattern of byte-level BPE; a fixed value of the tokenizer.
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ByteLevel:
    """A byte-level BPE file: ids of space + text, and each id's bytes.

    Where the file's merges stand in the order of their ids and it splits words by
    BYTE_PATTERN, the same merges run in a faster library; else the file's own encodes.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        config, letters = json.loads(tokenizer.to_str()), {c: b for b, c in _byte_letters().items()}
        special = {x["id"] for x in config["added_tokens"]}
        vocabulary = config["model"]["vocab"]
        self.bytes = [b""] * (max([*vocabulary.values(), *special]) + 1)
        for token, k in vocabulary.items():
            if k not in special:
                self.bytes[k] = bytes(letters[c] for c in token)
        merged = [vocabulary["".join(x if isinstance(x, list) else x.split(" "))] for x in config["model"]["merges"]]
        splits = config["pre_tokenizer"] or {}
        plain = config["normalizer"] is None and splits.get("type") == "ByteLevel" and not splits["add_prefix_space"] and splits.get("use_regex", True)
        if plain and merged == sorted(merged) and {len(self.bytes[k]) for k in set(vocabulary.values()) - set(merged) - special} == {1}:
            import tiktoken

            ranks = {self.bytes[k]: k for k in vocabulary.values() if k not in special}
            encoding = tiktoken.Encoding("file", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.encode, self.lossless = (lambda text: encoding.encode_to_numpy(text, disallowed_special=())), True  # every byte has an id, and nothing is normalised
        else:
            self.encode, self.lossless = (lambda text: tokenizer.encode(text, add_special_tokens=False).ids), False


class Pieces:
    """A sentence-piece file, which adds the space itself: ids of a text, and each id's bytes."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        processor = SentencePieceProcessor(model_file=path)
        self.encode = processor.encode
        piece = processor.id_to_piece
        self.bytes = [bytes([int(piece(k)[3:5], 16)]) if processor.is_byte(k) else piece(k).replace("▁", " ").encode() for k in range(processor.get_piece_size())]


class Aligner:
    """Aligned tokens of one text after the other; a worker keeps one."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        self.a_length, self.b_length = (np.array([len(x) for x in y.bytes], np.int64) for y in (self.a, self.b))
        self.wide = len(self.b.bytes)
        # An id with what follows it: A's inside a group and at its end, then B's.
        self.spelled = [f"{k}{mark}" for side, marks in ((self.a, ",|"), (self.b, ",;")) for k in range(len(side.bytes)) for mark in marks]

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Both sides' ids, None where a side doesn't spell space + text."""
        if not text:
            return None
        b, whole = self.b.encode(text), (" " + text).encode()
        if b"".join(map(self.b.bytes.__getitem__, b)) != whole:
            return None
        a = self.a.encode(" " + text)
        if not self.a.lossless and b"".join(map(self.a.bytes.__getitem__, a)) != whole:
            return None
        return np.asarray(a, np.int64), np.array(b, np.int64)

    def align(self, text: str | None) -> tuple[int, int, int, int, str, np.ndarray, np.ndarray]:
        """(n_a, n_b, n_groups, n_links, groups, distinct pairs as a * wide + b, how often each is linked)."""
        found = self.tokens(text)
        if found is None:
            return 0, 0, 0, 0, "", np.empty(0, np.int64), np.empty(0, np.int64)
        a, b = found
        last_a, last_b = merge_ends(np.cumsum(self.a_length[a]), np.cumsum(self.b_length[b]))  # tokens up to each group's end
        of_a, of_b = np.diff(last_a, prepend=0), np.diff(last_b, prepend=0)
        group_a, group_b = np.repeat(np.arange(len(of_a)), of_a), np.repeat(np.arange(len(of_b)), of_b)

        spelled = np.empty(len(a) + len(b), np.int64)
        ends_a, ends_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        ends_a[last_a - 1] = ends_b[last_b - 1] = 1
        spelled[np.arange(len(a)) + (last_b - of_b)[group_a]] = 2 * a + ends_a
        spelled[np.arange(len(b)) + last_a[group_b]] = 2 * (len(self.a.bytes) + b) + ends_b
        groups = "".join(map(self.spelled.__getitem__, spelled.tolist()))[:-1]

        links = of_a * of_b
        pairs, times = self._pairs(a, b, of_a, of_b, last_a, last_b, group_a, links)
        return len(a), len(b), len(of_a), int(links.sum()), groups, pairs, times

    def _pairs(self, a, b, of_a, of_b, last_a, last_b, group_a, links) -> tuple[np.ndarray, np.ndarray]:
        large = np.flatnonzero(links > BLOCK_LINKS)
        repeats = of_b[group_a]
        if len(large):
            repeats = np.where(np.isin(group_a, large), 0, repeats)
        first = np.repeat((last_b - of_b)[group_a] - np.cumsum(repeats) + repeats, repeats)
        keys = np.repeat(a, repeats) * self.wide + b[first + np.arange(len(first))]
        pairs, times = np.unique(keys, return_counts=True)
        for g in large.tolist():
            (x, n), (y, m) = (np.unique(t[at[g] - size[g] : at[g]], return_counts=True) for t, at, size in ((a, last_a, of_a), (b, last_b, of_b)))
            more, counts = (x[:, None] * self.wide + y).ravel(), np.outer(n, m).ravel()
            pairs, at = np.unique(np.concatenate([pairs, more]), return_inverse=True)
            summed = np.zeros(len(pairs), np.int64)
            np.add.at(summed, at, np.concatenate([times, counts]))
            times = summed
        return pairs, times


def merge_ends(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place where both ascending arrays of ends meet, how many ends of either came by then.

    The two pointers of a merge, moved in one call: for ends in ascending order the
    search goes on from where the end before it was found.  The last ends are equal.
    """
    at = np.searchsorted(y, x)
    met = np.flatnonzero(y[at] == x)
    return met + 1, at[met] + 1


#: The aligner of this worker, by its files.
_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner_of(a_path: str, b_path: str) -> Aligner:
    key = (a_path, b_path)
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(a_path, b_path)
    return _ALIGNERS[key]


_FIGURES = ("n_a", "n_b", "n_groups", "n_links")
CHUNKS = f"chunk long, ids array<string>, {', '.join(f'{x} array<long>' for x in _FIGURES)}, shas array<string>, ends array<int>, places binary, times binary, a array<int>, b array<int>, docs array<int>"


def _narrow(x: np.ndarray) -> bytes:
    """The values as 1, 2 or 4 little-endian bytes each, whichever holds the largest."""
    most = int(x.max(initial=0))
    return x.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4").tobytes()


def _widened(x: bytes, n: int) -> np.ndarray:
    return np.frombuffer(x, {1: "<u1", 2: "<u2", 4: "<u4"}[len(x) // n]).astype(np.int64) if n else np.empty(0, np.int64)


def _chunks(a_path: str, b_path: str, most: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner, part, seq = aligner_of(a_path, b_path), TaskContext.get().partitionId(), itertools.count()
        held: list[tuple] = []

        def row() -> pd.DataFrame:
            ids, n_a, n_b, n_groups, n_links, shas, pairs, times = zip(*held, strict=True)
            distinct, places = np.unique(np.concatenate(pairs), return_inverse=True)
            docs = np.bincount(places, minlength=len(distinct)).astype(np.int32)
            return pd.DataFrame({"chunk": [(part << 33) + next(seq)], "ids": [list(ids)], "n_a": [list(n_a)], "n_b": [list(n_b)], "n_groups": [list(n_groups)], "n_links": [list(n_links)], "shas": [list(shas)],
                                 "ends": [np.cumsum([len(x) for x in pairs]).astype(np.int32)], "places": [_narrow(places)], "times": [_narrow(np.concatenate(times))],
                                 "a": [(distinct // aligner.wide).astype(np.int32)], "b": [(distinct % aligner.wide).astype(np.int32)], "docs": [docs]})

        links = 0
        for batch in batches:
            ids, texts = batch["id"].tolist(), batch["text"].tolist()
            for k, text in zip(ids, texts, strict=True):
                n_a, n_b, n_groups, n_links, groups, pairs, times = aligner.align(text)
                sha = hashlib.sha256(groups.encode()).hexdigest() if n_a else ""
                held.append((k, n_a, n_b, n_groups, n_links, sha, pairs, times))
                links += n_links + 1
                if links >= most:
                    yield row()
                    held, links = [], 0
        if held:
            yield row()

    return run


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, n_best_b long"


def _added(key, chunk: pd.DataFrame, counted: pd.DataFrame) -> pd.DataFrame:
    """The documents of one chunk, from its row and its pairs' counts."""
    row = chunk.iloc[0]
    n, best_a, best_b = (np.zeros(len(row["a"]), np.int64) for _ in range(3))
    at = counted["place"].to_numpy()
    n[at], best_a[at], best_b[at] = counted["n"], counted["best_a"], counted["best_b"]
    ends = np.asarray(row["ends"], np.int64)
    size = int(ends[-1]) if len(ends) else 0
    places, times = _widened(row["places"], size), _widened(row["times"], size)
    before = np.concatenate([[0], ends])

    def by_document(values: np.ndarray) -> np.ndarray:
        running = np.concatenate([[0], np.cumsum(values[places] * times)])
        return running[before[1:]] - running[before[:-1]]

    out = pd.DataFrame({x: np.asarray(row[x], np.int64) for x in _FIGURES})
    out.insert(0, "doc_id", pd.array([None if x is None else int(x) for x in row["ids"]], dtype="Int64"))
    return out.assign(n_best=by_document(best_a), count_sum=by_document(n), groups_sha256=list(row["shas"]), n_best_b=by_document(best_b))


def align_corpus(docs: DataFrame, a_path: str, b_path: str, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", most: int = CHUNK_LINKS) -> tuple[DataFrame, DataFrame]:
    """(chunks, pairs): CHUNKS' rows, and (a, b, n, best_a, best_b) for each linked id pair.

    n is in how many documents the pair is linked; best_a (best_b) whether that is the
    highest count of its A (B) id, ties included.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))  # an id as text, so that null and large ones pass pandas unchanged
    chunks = scratch.keep(rows.mapInPandas(_chunks(a_path, b_path, most), CHUNKS), "chunks")
    counts = scratch.keep(_pairs(chunks).groupBy("a", "b").agg(F.sum("docs").alias("n")), "counts")
    of_a = counts.groupBy("a").agg(F.max("n").alias("most_a"))
    of_b = counts.groupBy("b").agg(F.max("n").alias("most_b"))
    pairs = counts.join(of_a, "a").join(of_b, "b").select("a", "b", "n", (F.col("n") == F.col("most_a")).cast("int").alias("best_a"), (F.col("n") == F.col("most_b")).cast("int").alias("best_b"))
    return chunks, scratch.keep(pairs, "pairs")


def _pairs(chunks: DataFrame) -> DataFrame:
    """(chunk, place, a, b, docs): a row for each distinct pair of a chunk."""
    return chunks.select("chunk", F.posexplode(F.arrays_zip("a", "b", "docs")).alias("place", "p")).select("chunk", "place", "p.a", "p.b", "p.docs")


def report(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_best_b) of every document row.

    n_best_b is n_best by the B ids' highest counts.  A text that is null, empty or
    that a tokenizer doesn't give back byte by byte has no tokens, zeros and an empty
    groups_sha256.  Rows are documents of their own, whether their ids repeat or are
    null.  An empty table gives no rows; other columns aren't read.
    """
    scratch = Scratch(docs.sparkSession, "alignment")
    chunks, pairs = align_corpus(docs, a_path, b_path, scratch, id_col, text_col)
    counted = _pairs(chunks).drop("docs").join(pairs, ["a", "b"]).select(F.col("chunk").alias("of_chunk"), "place", "n", "best_a", "best_b")
    return chunks.groupBy("chunk").cogroup(counted.groupBy("of_chunk")).applyInPandas(_added, RESULT)
