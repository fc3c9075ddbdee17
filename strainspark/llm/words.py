"""Word hashing shared by the operators that work on word shingles."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash

#: Odd multiplier of the polynomial that joins the hashes of consecutive words.
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Distinct words remembered by one Python worker before it starts anew.
MEMO_WORDS = 400_000


class WordHashes(dict):
    """Remembers the 64-bit hash of each word; ``fresh`` bounds its size."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def fresh(self) -> WordHashes:
        if len(self) > MEMO_WORDS:
            self.clear()
        return self


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``size``-word shingles of ``text``.

    A-Z is lower-cased; words are runs of other characters than space and
    \\x09-\\x0D.  A text of fewer words counts as one shingle; null and a text
    without words give an empty set.
    """
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(size, len(words))
    joined = each[: len(words) - width + 1].copy()
    for k in range(1, width):
        joined *= MULTIPLIER
        joined += each[k : len(words) - width + 1 + k]
    return np.unique(mixed(joined + np.uint64(width)))


def binary(array: pa.Array | pa.ChunkedArray) -> Iterable[bytes | None]:
    """The values of a string or binary column as bytes, nulls as None."""
    return array.cast(pa.large_binary()).to_pylist()
