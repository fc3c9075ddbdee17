"""Token ids in byte-aligned variable-length files, frequency-ranked.

The most frequent id has rank 0.  A rank takes 1 to 4 bytes; the lengths of four
ranks make one control byte, and control bytes are kept apart from data bytes, so
a file is decoded by looking whole control bytes up in a table.

A file ``part-PPPPPP-SSSSSS.svb`` holds consecutive documents in ascending order of
doc_id; files follow each other by name.  Little-endian, in this order:

    4 bytes  SVB1
    5 int64  documents, ids, bytes of data, ids before this file, files' rank table length
    int64    doc_id of each document            (0 where it is null)
    uint8    1 for each document whose id is null
    int64    ids of each document
    uint8    control bytes, two bits an id: bytes of its rank less one
    uint8    data bytes

The rank table (rank -> id) is a table of its own beside the files.
"""

from __future__ import annotations

import itertools
import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strainspark.llm.words import binary
from strainspark.scratch import Scratch

MAGIC = b"SVB1"
#: Ids of one file, at which the next one begins; a longer document has a file of its own.
FILE_IDS = 2_000_000
MEMO_CHUNKS, MEMO_PIECES = 150_000, 600_000

#: Fixed values of the tokenizer file whose pieces are remembered: its splitting pattern.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same pattern for texts of _PLAIN characters only, lower-cased.
_PIECES = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9 \t-\r]+")
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ \t-\r]+")


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter for each byte: printable ones stand for themselves, the others follow from 256 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [x for x in range(256) if x not in kept]
    return {x: chr(x) for x in kept} | {x: chr(256 + k) for k, x in enumerate(other)}


class Encoder:
    """Whole texts to ids, as little-endian unsigned bytes of ``dtype``.

    Where the tokenizer drops white space before it looks at words, a text of plain
    letters, digits and signs is split into pieces here, whose ids are remembered.
    Of any other text the white-space-separated chunks are remembered, and those
    that aren't plain are split by the library, as is a text that holds a special
    token.  Any other tokenizer gets the text as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        config = json.loads(self.tokenizer.to_str())
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.special = [x["content"].encode() for x in config["added_tokens"]]
        steps = [x["type"] for x in (config["normalizer"] or {}).get("normalizers", [])]
        splits = (config["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.by_chunk = steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in splits] == ["Split", "ByteLevel"] and splits[0]["pattern"].get("Regex") == _SPLIT and not any(b" " in x for x in self.special)
        self.letters = _byte_letters()
        self.chunks: dict[bytes, bytes] = _Memo(self._chunk, MEMO_CHUNKS)
        self.pieces: dict[str, bytes] = _Memo(self._piece, MEMO_PIECES)

    def _bytes(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def _ids(self, text: str) -> bytes:
        return self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _piece(self, piece: str) -> bytes:
        # Printable ASCII characters are their own letters.
        spelled = piece if piece.isascii() else "".join([self.letters[x] for x in piece.encode()])
        return self._bytes([x.id for x in self.tokenizer.model.tokenize(spelled)])

    def _chunk(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        return self._plain(text) if _PLAIN.fullmatch(text) else self._ids(text)

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, _PIECES.findall(text.lower())))

    def encode(self, text: bytes | None) -> bytes:
        if not text:
            return b""
        if not self.by_chunk or any(x in text for x in self.special):
            return self._ids(text.decode())
        self.chunks.fresh()
        self.pieces.fresh()
        if _PLAIN.fullmatch(plain := text.decode()):
            return self._plain(plain)
        return b"".join(map(self.chunks.__getitem__, text.split()))


class _Memo(dict):
    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value

    def fresh(self) -> None:
        """Forgets the half that came first, beyond the bound."""
        if len(self) > self.most:
            for key in list(itertools.islice(self, len(self) // 2)):
                del self[key]


#: The encoder of this worker; what it remembers serves the worker's later tasks too.
_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit ranks."""
    extra = (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = extra
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    spread = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.astype(np.uint8).tobytes(), spread[np.arange(4, dtype=np.uint8) <= extra[:, None]].tobytes()


#: Byte lengths of the four ranks of each control byte.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + np.uint8(1)


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The ranks again: lengths by table lookup, then one gather for each byte place."""
    lengths = LENGTHS[control].reshape(-1)[:n]
    first = np.cumsum(lengths, dtype=np.int64) - lengths
    ranks = data[first].astype(np.uint32)
    for k in range(1, int(lengths.max(initial=1))):
        longer = np.flatnonzero(lengths > k)
        ranks[longer] |= data[first[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks


def write_file(ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray, start: int, rank_of: np.ndarray) -> bytes:
    control, data = pack(rank_of[ids])
    head = MAGIC + struct.pack("<5q", len(doc_ids), len(ids), len(data), start, len(rank_of))
    null = np.array([x is None for x in doc_ids], np.uint8)
    return b"".join([head, np.array([x or 0 for x in doc_ids], "<i8").tobytes(), null.tobytes(), lengths.astype("<i8").tobytes(), control, data])


def read_file(content: bytes, id_of: np.ndarray) -> tuple[list[int | None], np.ndarray, int, np.ndarray]:
    """(doc_ids, ids of each document, ids before this file, all ids)."""
    if content[:4] != MAGIC:
        raise ValueError("not an SVB1 file")
    n_docs, n_ids, n_data, start, _ = struct.unpack_from("<5q", content, 4)
    at = 44
    doc_ids = np.frombuffer(content, "<i8", n_docs, at)
    null = np.frombuffer(content, np.uint8, n_docs, at := at + 8 * n_docs)
    lengths = np.frombuffer(content, "<i8", n_docs, at := at + n_docs)
    n_control = -(-n_ids // 4)
    control = np.frombuffer(content, np.uint8, n_control, at := at + 8 * n_docs)
    data = np.frombuffer(content, np.uint8, n_data, at + n_control)
    return [None if gone else int(x) for x, gone in zip(doc_ids, null, strict=True)], lengths, start, id_of[unpack(control, data, n_ids)]


_GROUPS = "part int, seq int, inside long, n_ids long, doc_ids array<long>, lengths array<long>, ids binary, counts binary"


def _group(path: str, end_id: int, file_ids: int):
    """Sorted documents of a partition to rows of about ``file_ids`` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq, inside = encoder_of(path), TaskContext.get().partitionId(), 0, 0
        end = np.array([end_id], encoder.dtype).tobytes()
        doc_ids, pieces, held = [], [], 0

        def row() -> pa.RecordBatch:
            lengths = [len(x) // encoder.dtype.itemsize for x in pieces]
            ids = b"".join(pieces)
            counts = np.bincount(np.frombuffer(ids, encoder.dtype)).astype("<u4").tobytes()  # a row has fewer than 2 ** 32 ids
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([inside], pa.int64()), pa.array([sum(lengths)], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([ids], pa.binary()), pa.array([counts], pa.binary())],
                                              names=["part", "seq", "inside", "n_ids", "doc_ids", "lengths", "ids", "counts"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), binary(batch.column(1)), strict=True):
                doc_ids.append(doc_id)
                pieces.append(encoder.encode(text) + end)
                held += len(pieces[-1]) // encoder.dtype.itemsize
                if held >= file_ids:
                    yield row()
                    doc_ids, pieces, held, seq, inside = [], [], 0, seq + 1, inside + held
        if doc_ids:
            yield row()

    return run


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows' counts of each id, summed for a task."""
    seen = np.zeros(0, np.int64)
    for batch in batches:
        for x in batch.column(0).to_pylist():
            counts = np.frombuffer(x, "<u4")
            if len(counts) > len(seen):
                seen = np.concatenate([seen, np.zeros(len(counts) - len(seen), np.int64)])
            seen[: len(counts)] += counts
    ids = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(seen[ids], pa.int64())], names=["id", "n"])


def _write(folder: str, ranks, starts, wide: str):
    """Writes one file a row.  A file is moved to its name when complete; a task that is run again writes the same bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pa.fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            names = []
            for row in batch.to_pylist():
                content = write_file(np.frombuffer(row["ids"], wide), row["doc_ids"], np.array(row["lengths"], np.int64), int(starts.value[row["part"]]) + row["inside"], ranks.value)
                names.append(f"part-{row['part']:06d}-{row['seq']:06d}.svb")
                with store.open_output_stream(f"{root}/_{attempt}-{names[-1]}") as out:
                    out.write(content)
                # An earlier attempt's file has the same bytes; some stores refuse to move onto a name that is taken.
                if store.get_file_info(f"{root}/{names[-1]}").type != pa.fs.FileType.NotFound:
                    store.delete_file(f"{root}/{names[-1]}")
                store.move(f"{root}/_{attempt}-{names[-1]}", f"{root}/{names[-1]}")
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["file"])

    return run


def _read(ids):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                doc_ids, lengths, start, values = read_file(content, ids.value)
                last = np.cumsum(lengths)
                sums = [zlib.crc32(values[b - n : b].astype("<u4")) for b, n in zip(last.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(start + last - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())],
                                                 names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def encode_corpus(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Writes ``docs`` to ``folder`` (files and rank table) and returns the table of ranks (rank, id, n).

    Documents are dealt by ranges of doc_id, null ids first, and sorted within;
    documents of one id are ordered by text.  A null text is empty and has the end
    id only; an empty table writes no file.  Only the counts of each id, as many
    as the vocabulary holds, and of each part, as many as there are shuffle
    partitions, come to the driver.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "tokens")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    groups = scratch.keep(rows.mapInArrow(_group(tokenizer_path, end_id, file_ids), _GROUPS), "groups")
    wide = Encoder(tokenizer_path).dtype.str
    counted = groups.select("counts").mapInArrow(_sum, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    ordered = sorted(((r["n"], r["id"]) for r in counted), key=lambda x: (-x[0], x[1]))
    rank_of = np.zeros(max((x for _, x in ordered), default=0) + 1, np.uint32)
    rank_of[[x for _, x in ordered]] = np.arange(len(ordered))
    table = spark.createDataFrame([(k, x, n) for k, (n, x) in enumerate(ordered)], "rank long, id long, n long")
    table.write.mode("overwrite").parquet(f"{folder}/ranks")

    # Ids before each part; there are as many parts as shuffle partitions at most.  Within a part each row has its own.
    sizes = {r["part"]: r["n"] for r in groups.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    before = np.zeros(max(sizes, default=0) + 2, np.int64)
    for part, n in sizes.items():
        before[part + 1] = n
    starts = spark.sparkContext.broadcast(np.cumsum(before))
    scratch.keep(groups.drop("counts").mapInArrow(_write(f"{folder}/files", spark.sparkContext.broadcast(rank_of), starts, wide), "file string"), "written")
    scratch.drop("groups", "written")
    return table


def read_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files of ``folder``."""
    ranks = spark.read.parquet(f"{folder}/ranks").orderBy("rank").select("id").collect()
    ids = spark.sparkContext.broadcast(np.array([r["id"] for r in ranks], np.uint32))
    if not ranks:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.svb").load(f"{folder}/files").select("content")
    return files.mapInArrow(_read(ids), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes ``docs`` into files of the shared folder and reads the documents back from them."""
    folder = Scratch(docs.sparkSession, "svb").base
    encode_corpus(docs, folder, tokenizer_path, end_id, id_col, text_col)
    return read_corpus(docs.sparkSession, folder)
