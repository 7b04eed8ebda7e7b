"""Language identification by language-bitmask n-gram filters.

Every language has a Bloom filter of the character n-grams that a share of its training
documents hold.  The filters have one size and the same hash functions and are stored bit-sliced:
row j of the table has, as bits of one mask, bit j of each language's filter, so the AND of an
n-gram's few rows is the mask of all languages that contain it, found in one probe.  A text's
masks are counted bit by bit (popcounts).  Of n n-grams a filter with false positive rate f also
answers yes to f of those it does not hold, so a count c is corrected to (c - f n) / (1 - f).
The language with the largest corrected count is predicted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_small
from .common import importable, shuffle_partitions
from .ranking import held_out

LANG_ROWS = 4_000  # training documents of each language, at most about so many
GRAMS = (2, 3, 4)  # characters of an n-gram; the space before and after a word counts as one
SHARE = 0.02  # of a language's training documents hold an n-gram that the language contains
PROBES = 4  # rows of the table that an n-gram stands in
LOG_ROWS = 18  # the table has 2**18 rows ...
TABLE_BYTES = 64 << 20  # ... or fewer, if so many would take more than this for all languages
BROADCAST_LANGS = 10_000
CHUNK = 1 << 18  # characters looked up at a time


@cache
def _letters() -> np.ndarray:
    """Whether a code point is a letter, for all of them."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def code_chunks(text: str | None) -> Iterator[np.ndarray]:
    """Code points of the lower-cased letters with one zero after each word, a bounded number of characters at a time."""
    text, inside = text or "", False
    for at in range(0, len(text), CHUNK):
        points = np.frombuffer(text[at:at + CHUNK].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[points]
        after = np.empty_like(letter)
        after[0], after[1:] = inside, letter[:-1]
        inside = bool(letter[-1])
        yield (points * letter)[letter | after].astype(np.uint64)
    if inside:
        yield np.zeros(1, np.uint64)


def gram_hashes(text: str | None) -> Iterator[np.ndarray]:
    """64-bit hashes of all n-grams of a text; nothing without letters.

    An n-gram lies in one word, with the gap before or after it as a character of its own.
    """
    tail = np.zeros(1, np.uint64)
    for chunk in code_chunks(text):
        points = np.concatenate([tail, chunk])
        gaps = np.cumsum(points == 0)
        for n in GRAMS:
            first = max(0, len(tail) - n + 1)  # n-grams that end in the tail came with the last chunk
            size = len(points) - first - n + 1
            if size > 0:
                h = points[first:first + size] * _MULTIPLIERS[n, 0]
                for k in range(1, n):
                    h += points[first + k:first + k + size] * _MULTIPLIERS[n, k]
                whole = gaps[first + n - 2:first + n - 2 + size] == gaps[first:first + size]
                h = _mix(h[whole])
                if len(h):
                    yield h
        tail = points[-(max(GRAMS) - 1):]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


_MULTIPLIERS = {(n, k): _mix(np.array([1 + 16 * n + k], np.uint64))[0] | np.uint64(1) for n in GRAMS for k in range(n)}


def positions(hashes: np.ndarray, probe: int, rows: int) -> np.ndarray:
    """The row of the table that each n-gram's ``probe``-th hash function names; ``rows`` is a power of two."""
    return ((hashes + np.uint64(probe) * ((hashes >> np.uint64(32)) | np.uint64(1))) & np.uint64(rows - 1)).astype(np.int64)


@dataclass
class Filters:
    """Bit-sliced Bloom filters: ``table[row, word]`` has a bit for each of 64 languages a word."""

    languages: list[str]  # the more training documents first
    table: np.ndarray
    wrong: np.ndarray  # false positive rate of each language's filter

    @classmethod
    def of(cls, languages: list[str], table: np.ndarray) -> Filters:
        full = np.array([float((table[:, k >> 6] >> np.uint64(k & 63) & np.uint64(1)).mean()) for k in range(len(languages))])
        return cls(languages, table, full ** PROBES)

    def masks(self, hashes: np.ndarray) -> np.ndarray:
        """Masks of the languages that contain each n-gram."""
        found = self.table[positions(hashes, 0, len(self.table))]
        for probe in range(1, PROBES):
            found &= self.table[positions(hashes, probe, len(self.table))]
        return found

    def popcounts(self, hashes: np.ndarray) -> np.ndarray:
        """How many of the n-grams each language contains, false positives included."""
        octets = -(-len(self.languages) // 8)
        found = self.masks(hashes).view(np.uint8).reshape(len(hashes), -1)[:, :octets]
        return np.unpackbits(found, axis=1, bitorder="little")[:, :len(self.languages)].sum(axis=0, dtype=np.int64)

    def decide(self, text: str | None) -> tuple[str, float]:
        """Language and score of a whole text; ``und`` and 0 without a letter or without languages."""
        n, count = 0, np.zeros(len(self.languages), np.int64)
        for hashes in gram_hashes(text):
            n += len(hashes)
            count += self.popcounts(hashes)
        if not n or not self.languages:
            return "und", 0.0
        right = np.clip((count - self.wrong * n) / np.maximum(1 - self.wrong, 1e-9), 0, None)
        best = int(np.argmax(right))
        total = float(right.sum())
        return self.languages[best], float(right[best] / total) if total > 0 else 0.0


def training_rows(docs: DataFrame, lang: str, id_col: str, text: str, lang_rows: int) -> DataFrame:
    """(lang, text): different texts of each language outside the held-out fold, a hash sample of about ``lang_rows`` at most."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(id_col)) \
        .select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(text), F.lit(11)).alias("h"))
    sizes = known.groupBy("lang").agg(F.count("*").alias("rows")).select(F.col("lang").alias("l"), "rows")
    sizes = checkpoint_small(sizes)  # a row a language
    # a hot language does not land in one task: sizes go to every task, or if they are many, under several keys a language
    if sizes.count() <= BROADCAST_LANGS:
        sizes, parts = F.broadcast(sizes.withColumn("part", F.lit(0))), 1
    else:
        parts = shuffle_partitions(docs.sparkSession)
        sizes = sizes.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    # texts are hashed, so of many copies all or none are taken, and those count once
    share = F.least(F.lit(1.0), F.lit(float(lang_rows)) / F.col("rows"))
    same = (F.col("lang") == F.col("l")) & (F.pmod("h", F.lit(parts)).cast("int") == F.col("part"))
    picked = known.join(sizes, same).where(F.pmod(F.shiftright("h", 16), F.lit(1_000_000)) < share * 1_000_000)
    return picked.groupBy("lang", "h").agg(F.first("text").alias("text")).select("lang", "text")


def fit(docs: DataFrame, lang: str = "lang", id_col: str = "doc_id", text: str = "text", lang_rows: int = LANG_ROWS,
        share: float = SHARE, log_rows: int = LOG_ROWS, table_bytes: int = TABLE_BYTES) -> Filters:
    """Filters of all languages that a training document has.

    Grams are counted and the table's rows put together by Spark; the driver gets the languages
    and at most as many rows as the table has.
    """
    importable(docs.sparkSession)
    sample = checkpoint_small(training_rows(docs, lang, id_col, text, lang_rows))
    sizes = {r["lang"]: r["n"] for r in sample.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes, key=lambda x: (-sizes[x], x))
    number = {x: k for k, x in enumerate(languages)}
    words = max(1, -(-len(languages) // 64))
    rows = 1 << log_rows
    while rows > 1024 and rows * words * 8 > table_bytes:
        rows >>= 1

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, t in zip(b["lang"], b["text"]):
                found = np.unique(np.concatenate([np.zeros(0, np.uint64), *gram_hashes(t)]))
                yield pd.DataFrame({"language": np.full(len(found), number[name], np.int32), "gram": found.view(np.int64)})

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            gram, language = b["gram"].to_numpy().view(np.uint64), b["language"].to_numpy()
            for probe in range(PROBES):
                yield pd.DataFrame({"row": positions(gram, probe, rows), "word": language >> 6,
                                    "mask": (np.uint64(1) << (language & 63).astype(np.uint64)).view(np.int64)})

    need = F.element_at(F.create_map(*[F.lit(v) for k, x in enumerate(languages) for v in (k, max(1.0, share * sizes[x]))]), F.col("language")) \
        if languages else F.lit(1.0)
    held = (sample.mapInPandas(grams, "language int, gram long").groupBy("language", "gram").agg(F.count("*").alias("docs"))
            .where(F.col("docs") >= need).select("language", "gram"))
    sliced = held.mapInPandas(placed, "row long, word int, mask long").groupBy("row", "word").agg(F.bit_or("mask").alias("mask")).toPandas()
    table = np.zeros((rows, words), np.uint64)
    table[sliced["row"].to_numpy(np.int64), sliced["word"].to_numpy(np.int64)] = sliced["mask"].to_numpy(np.int64).view(np.uint64)
    return Filters.of(languages, table)


def identify(docs: DataFrame, lang: str = "lang", id_col: str = "doc_id", text: str = "text", **params) -> DataFrame:
    """(id, held_out, lang_pred, score) of every document; the score is the language's share of all corrected counts.

    Null texts and texts without a letter are ``und`` with score 0; so are all, if nothing can be
    learned.  Very long texts are read whole, a bounded number of n-grams at a time.  Of equal
    counts the language with more training documents wins, then the smaller name; repeated rows
    are predicted each and learned from once; a null id is in the training fold; other columns are
    ignored, whatever their names; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    # the table is at most TABLE_BYTES
    shared = spark.sparkContext.broadcast(fit(docs, lang, id_col, text, **params))

    @F.pandas_udf("lang_pred string, score double")
    def decided(texts: pd.Series) -> pd.DataFrame:
        model = shared.value
        return pd.DataFrame([model.decide(t) for t in texts], columns=["lang_pred", "score"])

    rows = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), decided(F.col(text)).alias("__p"))
    return rows.select(id_col, "held_out", F.col("__p.lang_pred").alias("lang_pred"), F.col("__p.score").alias("score"))
