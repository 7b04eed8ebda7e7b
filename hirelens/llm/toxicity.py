"""Toxicity by compression distance: two zstandard dictionaries, one of toxic and one of ordinary text.

A window is a word with the spaces around it.  Each dictionary is made of the windows that
mark its class in labelled text (rarest first, so frequent ones are nearest).  A window is
compressed with either dictionary; a frame has a fixed cost of some bytes that would hide what
a short word saves, so the window is written ``REPEAT`` times.  The pair of lengths (with the
window's own length) is calibrated on other labelled documents: its log-likelihood ratio of
standing in toxic text.  Windows above the threshold add up to a document's features, and a
logistic fit on a third part of the labelled documents turns these into the score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .ranking import held_out, training_rows

FIT_ROWS = 20_000  # labelled documents to learn from, at most about so many
DICTIONARY_BYTES = 16_384
LIFT = 6.0  # times more frequent in toxic documents: a toxic window
RARE = 0.005  # share of the toxic documents that must hold it
REPEAT = 3
THRESHOLD = 1.0  # log-likelihood ratio from which a window counts
CACHE_WORDS = 300_000
EDGES = ".,;:!?\"'()[]{}*#$%&|<>-_"


def windows(text: str | None) -> list[str]:
    return (text or "").lower().split()


class Distance:
    """(window bytes, toxic length, ordinary length less toxic length) of a word, cached."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        size = max(len(toxic), len(ordinary), 1)
        params = zstandard.ZstdCompressionParameters.from_level(
            3, source_size=64, dict_size=size, format=zstandard.FORMAT_ZSTD1_MAGICLESS, min_match=4, search_log=9, hash_log=17,
            chain_log=17, window_log=17, strategy=zstandard.STRATEGY_BTLAZY2, write_content_size=0, write_dict_id=0, write_checksum=0)
        self.sides = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(
            d or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params) for d in (toxic, ordinary)]
        self.cache: dict[str, tuple[int, int, int]] = {}

    def __call__(self, word: str) -> tuple[int, int, int]:
        found = self.cache.get(word)
        if found is None:
            if len(self.cache) >= CACHE_WORDS:
                self.cache.clear()
            core = (word.strip(EDGES) or word).encode("utf-8", "replace")
            window = (b" " + core) * REPEAT + b" "
            toxic, ordinary = (len(c.compress(window)) for c in self.sides)
            found = self.cache[word] = (min(len(core), 30), min(toxic, 30), max(-8, min(8, ordinary - toxic)))
        return found


class Scorer:
    """Features and score of a whole text."""

    def __init__(self, toxic: bytes, ordinary: bytes, ratios: dict[tuple[int, int, int], float], weights: np.ndarray | None = None):
        self.args = (toxic, ordinary, ratios, weights)
        self.distance, self.ratios, self.weights = Distance(toxic, ordinary), ratios, weights
        self.values: dict[str, float] = {}

    def __reduce__(self):
        return Scorer, self.args

    def features(self, text: str | None) -> list[float]:
        """1, the largest ratio, the sum of the three largest, and of those above the threshold the log sum and the mean."""
        words, values = windows(text), self.values
        if len(values) >= CACHE_WORDS:
            values.clear()
        for w in words:
            if w not in values:
                values[w] = self.ratios.get(self.distance(w), 0.0)
        if not words:
            return [1.0, 0.0, 0.0, 0.0, 0.0]
        x = np.array([values[w] for w in words])
        x = np.where(x > THRESHOLD, x, 0.0)
        top = np.sort(x)[-3:]
        return [1.0, float(top[-1]), float(top.sum()), float(np.log1p(x.sum())), float(x.mean() * 100)]

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.weights, self.features(text)), -30, 30))))


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights of a logistic fit by Newton steps, classes weighed alike up to a factor of three."""
    w = np.zeros(x.shape[1])
    ones = max(1, int(y.sum()))
    weight = np.where(y == 1, min(3.0, max(1.0, (len(y) - ones) / ones)), 1.0)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + l2 * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train_dictionaries(sample: DataFrame, size: int = DICTIONARY_BYTES) -> tuple[bytes, bytes]:
    """(toxic, ordinary) dictionaries from ``sample`` (text, label): windows by the documents that hold them."""
    edges = "[" + "".join("\\" + c for c in EDGES) + "]+"
    word = F.regexp_replace("w", f"^{edges}|{edges}$", "")
    total = sample.agg(F.count(F.when(F.col("label") == 1, 1)).alias("t"), F.count(F.when(F.col("label") == 0, 1)).alias("o")).first()
    held = (sample.select("label", F.explode(F.array_distinct(F.split(F.trim(F.lower(F.coalesce("text", F.lit("")))), r"\s+"))).alias("w"))
            .select("label", word.alias("w")).where("w != ''")
            .groupBy("w").agg(F.count(F.when(F.col("label") == 1, 1)).alias("t"), F.count(F.when(F.col("label") == 0, 1)).alias("o"))
            .withColumn("lift", ((F.col("t") + 0.5) / (total["t"] + 1)) / ((F.col("o") + 0.5) / (total["o"] + 1))))
    held = written(held.where("t + o >= 2"), "toxic-words")
    most = size // 4  # a dictionary has room for no more
    toxic = held.where((F.col("t") >= max(2, round(RARE * total["t"]))) & (F.col("lift") > LIFT)).orderBy(F.desc("t"), "w").limit(most)
    plain = held.where(F.col("lift") < 2).orderBy(F.desc("o"), "w").limit(most)

    def content(rows):
        return (" " + " ".join(r["w"] for r in reversed(rows)) + " ").encode()[-size:]

    return content(toxic.select("w").collect()), content(plain.select("w").collect())


def fit(sample: DataFrame) -> Scorer:
    """Learn from ``sample`` (id, text, label), in three parts: dictionaries, calibration, score."""
    part = F.pmod(F.xxhash64(F.col("id"), F.lit(11)), F.lit(4))
    sample = written(sample.withColumn("part", part), "toxic-sample")
    toxic, ordinary = train_dictionaries(sample.where("part < 2"))
    distance = (toxic, ordinary)

    def lengths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        measure, counts = Distance(*distance), Counter()
        for b in batches:
            for text, label in zip(b["text"], b["label"]):
                counts.update((label, *k) for k in {measure(w) for w in windows(text)})
                counts[(label, -1, -1, -1)] += 1  # documents
        yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["label", "a", "b", "c", "n"])

    rows = (sample.where("part = 2").select("text", "label").mapInPandas(lengths, "label int, a int, b int, c int, n long")
            .groupBy("label", "a", "b", "c").agg(F.sum("n").alias("n")).collect())  # some thousand triples of lengths
    n = {(r["label"], (r["a"], r["b"], r["c"])): r["n"] for r in rows}
    docs = {y: n.get((y, (-1, -1, -1)), 0) for y in (0, 1)}
    ratios = {k: float(np.log(((n.get((1, k), 0) + 0.5) / (docs[1] + 1)) / ((n.get((0, k), 0) + 0.5) / (docs[0] + 1))))
              for k in {k for _, k in n} if k[0] >= 0}
    scorer = Scorer(toxic, ordinary, ratios)

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"label": b["label"], "x": [scorer.features(t) for t in b["text"]]})

    last = sample.where("part = 3").select("text", "label").mapInPandas(vectors, "label int, x array<double>").toPandas()
    last = last.iloc[last["x"].map(tuple).argsort(kind="stable")].sort_values("label", kind="stable")
    x = np.array(last["x"].tolist(), dtype=float).reshape(len(last), 5)
    scorer.weights = logistic(x, last["label"].to_numpy()) if len(last) else np.zeros(5)
    scorer.args = (toxic, ordinary, ratios, scorer.weights)
    return scorer


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text: str = "text",
          cut: float = 0.5, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(id, held_out, score, predicted) of every document; predicted is 1 where score >= ``cut``.

    Null and empty texts have no windows and are scored like any other; repeated rows are scored
    each; without labels all score 0.5; other columns are ignored; an empty table gives an empty
    result.  The sample to learn from has about ``fit_rows`` labelled documents at most, none of
    them from the held-out fold.
    """
    scorer = fit(training_rows(docs, labels, label, id_col, text, fit_rows))

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series([scorer.score(t) for t in texts], dtype=float)

    rows = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), scored(F.col(text)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= cut).cast("int"))
