"""Language of a text by n-gram filters that answer for all languages at once."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settle
from .bpe import pieces
from .worker import kept

GRAM = 3  # letters of an n-gram; the place before and after a word counts as one
TRAINING_ROWS = 6_000  # rows of each language that are learnt from, expected
LEAST_SHARE = 1e-5  # of a language's n-grams; a rarer one is not its own
NEAR_BEST = 0.2  # an n-gram is of a language if its share is so much of the greatest
MAX_GRAMS = 2_000_000  # bound of the n-grams of all languages together
MAX_LANGUAGES = 4_096
HASHES = 4
ROWS_PER_GRAM = 16
WINDOW = 1 << 19  # places of the text that are worked on at once
UNDETERMINED = "und"
_SPACE = 32
_MIX = np.uint64(0x9E3779B97F4A7C15)  # fixed values: odd multipliers
_OTHER_MIX = np.uint64(0xC2B2AE3D27D4EB4F)


def _letter_table() -> np.ndarray:
    """Letters and marks as they are, all other characters as a space."""
    kinds = (unicodedata.category(chr(c))[0] for c in range(0x110000))
    return np.fromiter((c if k in "LM" else _SPACE for c, k in enumerate(kinds)), np.uint32, 0x110000)


def grams(texts: list[str], size: int = GRAM) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashed n-grams of lower-cased texts and the numbers of their texts,
    window by window.

    N-grams lie in one word, with at most one place on either side of it, so
    none reaches into the next text.
    """
    table = kept(("letters",), _letter_table)
    lowered = [t.lower() for t in texts]
    ends = np.cumsum([len(t) + 1 for t in lowered])
    joined = np.frombuffer(f" {' '.join(lowered)} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    for start in range(0, max(len(joined) - size + 1, 0), WINDOW):
        part = table[joined[start : start + WINDOW + size - 1]].astype(np.uint64)
        count = len(part) - size + 1
        blank = part == _SPACE
        key = np.zeros(count, np.uint64)
        for k in range(size):
            key = (key ^ (key >> np.uint64(29))) * _MIX + part[k : k + count]
        key = (key ^ (key >> np.uint64(32))) * _OTHER_MIX
        key ^= key >> np.uint64(29)
        inside = np.ones(count, bool)
        for k in range(1, size - 1):
            inside &= ~blank[k : k + count]
        if size < 3:
            inside &= ~blank[:count]
        at = np.flatnonzero(inside)
        # The place after the first is in the word, and so in the text.
        before = np.searchsorted(at + (start + (size > 2)), ends)
        yield key[at], np.repeat(np.arange(len(texts)), np.diff(before, prepend=0))


@dataclass
class LanguageFilter:
    """Bit-sliced Bloom filters: row r holds bit r of the filters of all
    languages, 64 a number, so a look at a row answers for all of them."""

    languages: list[str]  # those with most training rows first
    rows: np.ndarray  # (rows, numbers), the count of rows a power of two

    def __post_init__(self):
        bits = [((self.rows[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(self.languages))]
        self.false_positive = np.array(bits) ** HASHES

    @classmethod
    def build(cls, languages: list[str], keys: np.ndarray, language: np.ndarray) -> LanguageFilter:
        """``keys[i]`` is an n-gram of the language with number ``language[i]``."""
        count = 1 << max(6, int(np.ceil(np.log2(max(1, len(keys)) * ROWS_PER_GRAM))))
        rows = np.zeros((count, -(-max(1, len(languages)) // 64)), np.uint64)
        bit = np.uint64(1) << (language % 64).astype(np.uint64)
        for place in _places(keys, count):
            np.bitwise_or.at(rows, (place, language // 64), bit)
        return cls(languages, rows)

    def masks(self, keys: np.ndarray) -> np.ndarray:
        """The languages that contain each n-gram, as bits."""
        found = None
        for place in _places(keys, len(self.rows)):
            found = self.rows[place] if found is None else found & self.rows[place]
        return found

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text.

        A language's count of n-grams is freed of those that its filter is
        expected to let through by chance; the largest count wins, of equal
        ones the language with more training rows.  The score is that count's
        share of the text's n-grams.
        """
        known = len(self.languages)
        hits = np.zeros((known, len(texts)))
        totals = np.zeros(len(texts))
        for keys, owner in grams([t or "" for t in texts]):
            totals += np.bincount(owner, minlength=len(texts))
            masks = self.masks(keys)
            for k in range(known):
                has = (masks[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1) != 0
                hits[k] += np.bincount(owner[has], minlength=len(texts))
        if not known:
            return [UNDETERMINED] * len(texts), totals * 0
        by_chance = np.minimum(self.false_positive, 0.999)[:, None]
        counts = np.maximum(0, (hits - by_chance * totals) / (1 - by_chance))
        best = counts.argmax(axis=0)
        lettered = np.array([bool(t) and any(map(str.isalpha, t)) for t in texts], bool)
        share = counts[best, np.arange(len(texts))] / np.maximum(totals, 1)
        names = [self.languages[b] if ok else UNDETERMINED for b, ok in zip(best.tolist(), lettered.tolist())]
        return names, np.where(lettered, np.clip(share, 0, 1), 0.0)


def _places(keys: np.ndarray, count: int) -> Iterator[np.ndarray]:
    """A row for each hash function, from two halves of the key."""
    step = (keys >> np.uint64(32)) | np.uint64(1)
    for k in range(HASHES):
        yield ((keys + np.uint64(k) * step) & np.uint64(count - 1)).astype(np.int64)


def _counted(rows: DataFrame) -> DataFrame:
    """``language`` (a number), ``gram`` and ``amount`` of rows of ``language,
    text``; added up within each piece of a task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            numbers = batch.column(0).to_numpy()
            for keys, owner in grams(batch.column(1).to_pylist()):
                for number in np.unique(numbers[owner]).tolist():
                    found, amount = np.unique(keys[numbers[owner] == number], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(found), number, np.int32)), pa.array(found.view(np.int64)),
                         pa.array(amount.astype(np.int64))],
                        names=["language", "gram", "amount"],
                    )

    counted = rows.mapInArrow(run, "language int, gram bigint, amount bigint")
    return counted.groupBy("language", "gram").agg(F.sum("amount").alias("amount"))


def learn(
    docs: DataFrame,
    *,
    text_col: str = "text",
    lang_col: str = "lang",
    training_rows: int = TRAINING_ROWS,
) -> LanguageFilter:
    """A filter learnt from about ``training_rows`` rows of each language,
    chosen by a hash of their text; of a language with fewer, from all.

    Rows without text or language are left out.  An n-gram belongs to a
    language if it makes up at least ``LEAST_SHARE`` of the language's n-grams
    (more if the languages together could exceed ``MAX_GRAMS``) and at least
    ``NEAR_BEST`` of its greatest share in any language.  As shares sum to one,
    that bounds what the driver gathers.  More than ``MAX_LANGUAGES``
    languages are an error.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("name"), F.col(text_col).alias("text")
    )
    counts = known.groupBy("name").count().orderBy(F.desc("count"), "name").limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return LanguageFilter.build([], np.empty(0, np.uint64), np.empty(0, np.int64))
    numbered = [(row["name"], k, min(1.0, training_rows / row["count"])) for k, row in enumerate(counts)]
    languages = docs.sparkSession.createDataFrame(numbered, "name string, language int, part double")
    drawn = (F.xxhash64("text", F.lit(GRAM)).bitwiseAND((1 << 40) - 1)) / float(1 << 40)
    chosen = known.join(F.broadcast(languages), "name").where(drawn < F.col("part"))  # MAX_LANGUAGES rows at most
    amounts = settle(_counted(chosen.select("language", "text")), "grams")
    totals = dict(amounts.groupBy("language").agg(F.sum("amount")).collect())
    least = max(LEAST_SHARE, len(counts) / MAX_GRAMS)
    total_rows = [(k, float(total)) for k, total in totals.items()]
    totals_table = docs.sparkSession.createDataFrame(total_rows, "language int, total double")
    shares = amounts.join(F.broadcast(totals_table), "language").select(
        "language", "gram", (F.col("amount") / F.col("total")).alias("share")
    )
    kept_rows = shares.where(F.col("share") >= least).toArrow()
    language = kept_rows.column("language").to_numpy().astype(np.int64)
    gram, share = kept_rows.column("gram").to_numpy(), kept_rows.column("share").to_numpy()
    _, place = np.unique(gram, return_inverse=True)
    greatest = np.zeros(place.max(initial=-1) + 1)
    np.maximum.at(greatest, place, share)
    own = share >= NEAR_BEST * greatest[place]
    return LanguageFilter.build([row["name"] for row in counts], gram[own].view(np.uint64), language[own])


def identify(df: DataFrame, model: LanguageFilter, *, text_col: str, keep: list[str]) -> DataFrame:
    """Columns ``keep``, ``lang_pred`` and ``score`` (0 to 1) of every row.

    ``und`` and 0 if the text is null or has no letter, or if no language was
    learnt.  Letters that no language has count for the one with most training
    rows, with score 0.  Whole texts are read, in windows.  Rows do not depend
    on each other, so repeated ones get equal answers; further columns are not
    read; an empty table gives no rows.  The filter is broadcast: at most
    ``MAX_GRAMS`` times ``ROWS_PER_GRAM`` rows, twice that as a power of two,
    some megabytes in practice.
    """
    names = [f"k{n}" for n in range(len(keep))]
    languages, sent = model.languages, df.sparkSession.sparkContext.broadcast(model.rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = LanguageFilter(languages, sent.value)
        for batch in pieces(batches):
            predicted, scores = own.predict(batch.column(len(names)).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(names)], pa.array(predicted, pa.string()), pa.array(scores)],
                names=[*names, "lang_pred", "score"],
            )

    kinds = [T.StructField(n, df.schema[c].dataType) for n, c in zip(names, keep)]
    made = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    chosen = df.select(*(F.col(c).alias(n) for c, n in zip(keep, names)), F.col(text_col).alias("_text"))
    out = chosen.mapInArrow(run, T.StructType([*kinds, *made]))
    return out.select(*(F.col(n).alias(c) for c, n in zip(keep, names)), "lang_pred", "score")


# -- the query ----------------------------------------------------------------


def held_out(doc_id: Column) -> Column:
    """Rows that no language is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def op12_language_id(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = learn(docs.where(~held_out(F.col("doc_id"))))
    found = identify(docs, model, text_col="text", keep=["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {"op12_language_id": op12_language_id}
ORACLE: dict[str, str] = {}
