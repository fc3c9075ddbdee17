"""Language identification with a word-first backoff.

A word seen in training scores by its smoothed log frequency in each language.
An unseen word backs off to its character n-grams, longest first: the first
length of which any n-gram is known decides, by the mean of the known ones.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strainspark.llm.words import MEMO_WORDS, MULTIPLIER, mixed

#: The model is fitted on about this many documents of each language at most, chosen by a hash of their id and text.
TRAIN_DOCS = 1500
LONGEST, SMOOTHING = 5, 0.5
UNDETERMINED = "und"
#: Texts of an Arrow batch that are Python objects at a time, and words whose n-grams are held at a time in training.
TEXTS_AT_ONCE, WORDS_AT_ONCE = 256, 50_000
_WORD = re.compile(r"[^\W\d_]+")


def tokens(text: str) -> list[str]:
    """Runs of letters (category L), lower-cased."""
    words = _WORD.findall(text.lower())
    if text.isascii() or all(map(str.isalpha, words)):
        return words
    # The pattern lets number signs such as one half pass.
    return [x for word in words for x in "".join([c if c.isalpha() else " " for c in word]).split()]


def _spread(words: list[str], edges: bool) -> tuple[np.ndarray, np.ndarray]:
    """Mixed code points of all words, one after another, within ^ and $ if ``edges``; and the first place of each."""
    joined = "".join([f"^{x}$" for x in words] if edges else words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2 * edges
    points = np.frombuffer(joined.encode("utf-32-le"), "<u4").astype(np.uint64)
    return mixed(points + np.uint64(1)), np.cumsum(lengths) - lengths


def hashed_words(words: list[str]) -> np.ndarray:
    """A 64-bit hash of each word; words aren't empty."""
    if not words:
        return np.empty(0, np.uint64)
    points, first = _spread(words, False)
    lengths = np.diff(first, append=len(points))
    place = np.arange(len(points)) - np.repeat(first, lengths)
    powers = MULTIPLIER ** np.arange(int(lengths.max()), dtype=np.uint64)
    return mixed(np.add.reduceat(points * powers[place], first) + lengths.astype(np.uint64))


def hashed_grams(words: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of ``words``, with the word's place; words count with their edges if n > 1."""
    points, first = _spread(words, n > 1)
    lengths = np.diff(first, append=len(points))
    many = np.maximum(lengths - n + 1, 0)
    owner = np.repeat(np.arange(len(words)), many)
    at = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + first[owner]
    total = np.zeros(len(at), np.uint64)
    for k in range(n):
        total = total * MULTIPLIER + points[at + k]
    return mixed(total + np.uint64(n)), owner


class Table:
    """Log frequencies of hashed keys: sorted hashes and a row of one value a language, in single precision."""

    def __init__(self, parts: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]], languages: int):
        """Parts of (keys, language (a place), occurrences); a key may come more than once."""
        self.keys, counts = np.empty(0, np.uint64), np.empty((0, languages))
        for keys, language, n in parts:
            new, row = np.unique(keys, return_inverse=True)
            more = np.bincount(row * languages + language, weights=n, minlength=len(new) * languages).reshape(len(new), languages)
            both, row = np.unique(np.concatenate([self.keys, new]), return_inverse=True)
            summed = np.zeros((len(both), languages))
            summed[row[: len(self.keys)]] += counts
            summed[row[len(self.keys) :]] += more
            self.keys, counts = both, summed
        total = counts.sum(axis=0) + SMOOTHING * (len(self.keys) + 1)
        self.rows = np.log((counts + SMOOTHING) / total).astype(np.float32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 where it is unknown."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)


class Model:
    """Log frequencies by language: of words, and of character n-grams of 1 to LONGEST."""

    def __init__(self, counts: dict[str, dict[str, int]], documents: dict[str, int]):
        """counts: language -> word -> occurrences; documents: language -> training documents."""
        flat = [(x, word, n) for x, one in counts.items() for word, n in one.items()]
        self._fill(*[[row[k] for row in flat] for k in range(3)], documents)

    @classmethod
    def of_rows(cls, languages: list[str], words: list[str], n: list[int], documents: dict[str, int]) -> Model:
        """The same of parallel lists, each word once a language."""
        model = cls.__new__(cls)
        model._fill(languages, words, n, documents)
        return model

    def _fill(self, of: list[str], words: list[str], occurrences: list[int], documents: dict[str, int]) -> None:
        self.languages = sorted(documents)
        total = sum(documents.values())
        self.prior = np.array([math.log(documents[x] / total) for x in self.languages])
        place = {x: k for k, x in enumerate(self.languages)}
        language = np.array([place[x] for x in of], np.int64)
        n = np.array(occurrences, np.float64)
        parts = [slice(k, k + WORDS_AT_ONCE) for k in range(0, len(words), WORDS_AT_ONCE)]
        self.words = Table(((hashed_words(words[x]), language[x], n[x]) for x in parts), len(self.languages))

        def counted(size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for x in parts:
                keys, owner = hashed_grams(words[x], size)
                yield keys, language[x][owner], n[x][owner]

        self.grams = [Table(counted(size), len(self.languages)) for size in range(1, LONGEST + 1)]

    def scores(self, words: list[str]) -> np.ndarray:
        """Log frequencies of each word; zeros where nothing of it is known."""
        out = np.zeros((len(words), len(self.languages)), np.float32)
        if not words or not self.languages:
            return out
        row = self.words.find(hashed_words(words))
        out[row >= 0] = self.words.rows[row[row >= 0]]
        left = np.flatnonzero(row < 0)
        for size in range(LONGEST, 0, -1):
            if not len(left):
                break
            keys, owner = hashed_grams([words[k] for k in left.tolist()], size)
            row = self.grams[size - 1].find(keys)
            known, rows = owner[row >= 0], self.grams[size - 1].rows[row[row >= 0]]
            many = np.bincount(known, minlength=len(left))
            found = many > 0
            means = np.stack([np.bincount(known, weights=rows[:, k], minlength=len(left)) for k in range(rows.shape[1])], axis=1)[found] / many[found, None]
            out[left[found]] = means
            left = left[~found]
        return out


class _Scores(dict):
    """Word -> row of a growing table of scores; starts anew beyond MEMO_WORDS."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.rows = model, np.empty((1024, len(model.languages)), np.float32)

    def learn(self, texts: list[list[str]]) -> None:
        """Scores the words of ``texts`` that aren't known yet, all at once."""
        if len(self) > MEMO_WORDS:
            self.clear()
        new = list(dict.fromkeys(x for words in texts for x in words if x not in self))
        while len(self) + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
        self.rows[len(self) : len(self) + len(new)] = self.model.scores(new)
        self.update(zip(new, range(len(self), len(self) + len(new)), strict=True))


def predict(model: Model, scores: _Scores, text: str | None) -> tuple[str, float]:
    """The most probable language of ``text`` and its probability; see ``judge``."""
    words = tokens(text) if text else []
    scores.learn([words])
    return judge(model, scores, words)


def judge(model: Model, scores: _Scores, words: list[str]) -> tuple[str, float]:
    """The most probable language of learned ``words`` and its probability, tempered for long texts.

    The words' mean log frequencies count as those of 20 words at most, so that
    the probability of a long text isn't always 1.  Ties go to the language that
    is first by name.
    """
    if not words or not model.languages:
        return UNDETERMINED, 0.0
    places = np.fromiter(map(scores.__getitem__, words), np.int64, len(words))
    total = scores.rows[places].mean(axis=0, dtype=np.float64) * min(len(words), 20) + model.prior
    odds = np.exp(total - total.max())
    best = int(odds.argmax())
    return model.languages[best], float(odds[best] / odds.sum())


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", max_docs: int = TRAIN_DOCS) -> Model:
    """A model of the labelled rows; null texts and null languages are left out.

    Of a language with more than ``max_docs`` documents a share is taken by hash,
    so the sample, its word counts and the model that is broadcast are bounded by
    max_docs for each language, whatever the size of the table.
    """
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(id_col).alias("id")).filter("text IS NOT NULL AND lang IS NOT NULL")
    documents = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not documents:
        return Model({}, {})
    share = F.create_map(*[F.lit(x) for lang, n in sorted(documents.items()) for x in (lang, min(1.0, max_docs / n))])
    place = F.pmod(F.xxhash64(F.lit("sample"), "id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.filter(place < share[F.col("lang")]).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, Counter] = defaultdict(Counter)
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[lang].update(tokens(text))
            flat = [(x, w, c) for x, one in seen.items() for w, c in one.items()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*flat, strict=True) if flat else ([], [], []), (pa.string(), pa.string(), pa.int64()), strict=True)], names=["lang", "word", "n"])

    counted = sample.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    return Model.of_rows(*[counted.column(x).to_pylist() for x in ("lang", "word", "n")], documents)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """A struct column (lang_pred, score) of each row's whole text; nothing but the text is read.

    Null texts and texts without a letter are ``und`` with score 0, as is every
    text if the model has no language.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scores = _Scores(held.value)
        for batch in batches:
            found = []
            for first in range(0, len(batch), TEXTS_AT_ONCE):
                texts = [tokens(x) if x else [] for x in batch.slice(first, TEXTS_AT_ONCE).to_pylist()]
                scores.learn(texts)
                found += [judge(held.value, scores, words) for words in texts]
            yield pa.StructArray.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["lang_pred", "score"])

    return run(F.col(text_col))


def is_held_out(id_col: str = "doc_id") -> Column:
    """Whether the document's label may not be learned from; so for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))
