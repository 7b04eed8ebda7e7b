"""Quality classifier by Bradley-Terry pairwise ranking.

Each pair of a good and a bad labelled document is a comparison the good one wins.  Weights
minimise the logistic loss on the pairs' feature differences, so w.x is the Bradley-Terry
strength of a document.  Every labelled document outside the held-out fold and every pair of them
counts: the loss of a pair depends on its two strengths alone, so the sums over all pairs follow
from sums over documents of about the same strength (bins of ``WIDTH``, at their mean strength),
and a Newton step is two passes over the documents.  The threshold is the quantile of the training
scores that leaves the labelled share of bad documents below it; scores are mapped to 0..1 with it
at ``cut``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .quality_rules import repeated_words

WIDTH = 1 / 32  # of a bin of strengths
MOST_BINS = 4096  # strengths further from the mean than half of these are in the last bin
FEW = 1000  # training scores compared one by one for the threshold
SYMBOL = re.compile(r"[#*$%&|<>]")
FEATURES = ("log_words", "word_length", "symbols", "symbol_words", "upper", "digits", "marks", "bars", "dup_lines", "repeated",
            "distinct", "line_length", "sentence_ends", "non_letters")


def features(text: str | None) -> list[float]:
    """Surface features of a whole text; all zero for a null text or one without words."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    size = len(text)
    lines = [x for x in text.split("\n") if x.strip()]
    symbols = len(SYMBOL.findall(text))
    upper = sum(map(str.isupper, words))
    digits = sum(text.count(d) for d in "0123456789")
    marks = sum(text.count(c) for c in "!?")
    marked = sum(1 for w in words if not w[-1].isalnum() and w[-1] not in ".,;:!?")
    ends = text.count(".") + marks
    return [np.log1p(n), size / n, symbols / size, marked / n, upper / n, digits / size, marks / n, text.count("|") / n,
            1 - len(set(lines)) / len(lines), repeated_words(words) / n, len(set(words)) / n, np.log1p(size / len(lines)),
            ends / n, 1 - sum(map(str.isalpha, words)) / n]


def held_out(id_col: str) -> Column:
    """True where crc32 of the id as text leaves 0 modulo 5; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) == 0, F.lit(False))


def known_labels(labels: DataFrame, label: str, id_col: str) -> DataFrame:
    """(id, label) of every labelled id outside the held-out fold."""
    return (labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label")).where("id is not null and label is not null")
            .where(~held_out("id")).groupBy("id").agg(F.max("label").alias("label")))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text: str, fit_rows: int) -> DataFrame:
    """(text, label) of labelled documents outside the held-out fold, a hash sample of about ``fit_rows`` at most."""
    known = known_labels(labels, label, id_col)
    share = min(1.0, fit_rows / max(1, labels.count()))
    known = known.where(F.pmod(F.xxhash64(F.col("id"), F.lit(3)), F.lit(1_000_000)) < int(share * 1_000_000))
    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")) \
        .join(F.broadcast(known), "id").select("id", "text", "label")  # ``known`` has about fit_rows rows at most


@dataclass
class Ranker:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float
    cut: float

    def design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.hstack([z, z * z])

    def strengths(self, x: np.ndarray) -> np.ndarray:
        return (self.design(x) * self.weights).sum(axis=1)  # row by row, the same in any batch

    def scores(self, x: np.ndarray) -> np.ndarray:
        s = self.strengths(x) - self.threshold + np.log(self.cut / (1 - self.cut))
        return 1 / (1 + np.exp(-np.clip(s, -500, 500)))


# (function of features and labels giving (keys, values), number of values) -> the values' sums by key, over all training rows
Sums = Callable[[Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], int], tuple[np.ndarray, np.ndarray]]


def sums_of_arrays(x: np.ndarray, y: np.ndarray) -> Sums:
    """Sums over features and labels in memory."""
    def sums(fn, width):
        keys, values = fn(x, y) if len(y) else (np.zeros(0, np.int64), np.zeros((0, width)))
        return _by_key(keys, values)

    return sums


def sums_of_rows(train: DataFrame) -> Sums:
    """Sums over the rows of ``train`` (label, x): partial ones in each task, few keys to the driver."""
    def sums(fn, width):
        names = [f"v{k}" for k in range(width)]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    keys, values = _by_key(*fn(np.stack(b["x"].to_numpy()), b["label"].to_numpy()))
                    yield pd.DataFrame(values, columns=names).assign(key=keys)[["key", *names]]

        rows = train.select("label", "x").mapInPandas(run, "key long, " + ", ".join(f"{n} double" for n in names)) \
            .groupBy("key").agg(*[F.sum(n).alias(n) for n in names]).orderBy("key").collect()
        return np.array([r[0] for r in rows], np.int64), np.array([r[1:] for r in rows], float).reshape(len(rows), width)

    return sums


def _by_key(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, place = np.unique(keys, return_inverse=True)
    out = np.zeros((len(keys), values.shape[1]))
    np.add.at(out, place, values)
    return keys, out


def _total(sums: Sums, fn: Callable[[np.ndarray, np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """The sum of the rows' values."""
    _, found = sums(lambda x, y: (np.zeros(1, np.int64), fn(x, y).sum(axis=0)[None, :]), width)
    return found.sum(axis=0)


def _rounded(x: np.ndarray) -> np.ndarray:
    """Ten digits, so that the order in which tasks are summed shows in no result."""
    return np.array([float(f"{v:.10g}") for v in x])


def quantile(sums: Sums, model: Ranker, n: int, share: float) -> float:
    """The ``share`` quantile of the ``n`` training strengths, between two neighbours in proportion, as numpy's."""
    def value(k: int) -> float:
        """The strength with ``k`` smaller ones: bins around it become narrower until they hold few."""
        reach = float(np.abs(model.weights).sum()) * 36 + 1
        low, high, left = -reach, reach, k
        while True:
            step = (high - low) / MOST_BINS

            def bins(x, y):
                s = model.strengths(x)
                s = s[(s >= low) & (s < high)]
                return np.minimum((s - low) / step, MOST_BINS - 1).astype(np.int64), np.ones((len(s), 1))

            keys, counts = sums(bins, 1)
            ends = counts[:, 0].cumsum()
            at = min(int(np.searchsorted(ends, left, "right")), len(ends) - 1)
            left -= int(ends[at] - counts[at, 0])
            low, high = low + keys[at] * step, low + (keys[at] + 1) * step
            if counts[at, 0] <= FEW or step <= 1e-13 * max(1.0, abs(low)):
                break

        def single(x, y):  # with a margin for the rounding of edges
            s = model.strengths(x)
            s = s[(s >= low - step / 2) & (s < high + step / 2)]
            return s.view(np.int64), np.stack([np.ones(len(s)), (s < low).astype(float)], axis=1)

        bits, found = sums(single, 2)
        values = bits.view(float)
        order = np.argsort(values)
        ends = found[order, 0].cumsum()
        left += int(found[:, 1].sum())
        return float(values[order][min(int(np.searchsorted(ends, left, "right")), len(ends) - 1)])

    place = share * (n - 1)
    k = int(place)
    first = value(k)
    return first if place == k else first + (place - k) * (value(k + 1) - first)


def _curves(at: np.ndarray, n: np.ndarray, other: np.ndarray, other_n: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, ...]:
    """For good bins at strengths ``at`` and bad ones at ``other``: what all pairs add to loss, gradient and curvature.

    (loss, miss of each good bin, miss of each bad bin, curvature of each good bin, of each bad bin, curvature times ``z`` of the bad bins).
    """
    loss, miss, curve, mixed = 0.0, [], [], []
    other_miss, other_curve = np.zeros(len(other)), np.zeros(len(other))
    for lo in range(0, len(at), 256):
        gap = at[lo:lo + 256, None] - other[None, :]
        p = 1 / (1 + np.exp(np.clip(gap, -500, 500)))  # the bad one wins
        d, own = p * (1 - p), n[lo:lo + 256]
        loss += float(own @ np.logaddexp(0, -gap) @ other_n)
        miss.append(p @ other_n)
        curve.append(d @ other_n)
        mixed.append(d @ z)
        other_miss += own @ p
        other_curve += own @ d
    return loss, np.concatenate(miss), other_miss, np.concatenate(curve), other_curve, np.concatenate(mixed)


def fit_sums(sums: Sums, cut: float = 0.3, l2: float = 1e-3, steps: int = 60) -> Ranker:
    """Bradley-Terry weights by Newton steps on the mean logistic loss over all good-minus-bad feature differences."""
    size = len(FEATURES)
    first = _total(sums, lambda x, y: np.column_stack([np.ones(len(y)), y == 1, y == 0, x]), size + 3)
    n, good, bad = (int(v) for v in first[:3])
    mean = _rounded(first[3:] / max(n, 1))
    spread = _rounded(np.sqrt(_total(sums, lambda x, y: (x - mean) ** 2, size) / max(n, 1)))
    model = Ranker(mean, np.where(spread > 1e-9, spread, 1.0), np.zeros(2 * size), 0.0, cut)
    if not good or not bad:
        return model
    wide = 2 * size
    middle = _total(sums, lambda x, y: model.design(x), wide) / n
    pairs = good * bad

    def bin_keys(s, y, centre):
        place = np.clip(np.floor((s - centre) / WIDTH), -MOST_BINS // 2, MOST_BINS // 2 - 1).astype(np.int64) + MOST_BINS // 2
        return 2 * place + (y == 1)

    def compared(w):
        """(loss, gradient, bins' keys and curvature, the curvature that good and bad ones share) at weights ``w``."""
        centre = float(middle @ w)

        def bins(x, y):
            x, y = x[(y == 0) | (y == 1)], y[(y == 0) | (y == 1)]
            z = model.design(x)
            s = (z * w).sum(axis=1)
            return bin_keys(s, y, centre), np.column_stack([np.ones(len(y)), s, z])

        keys, found = sums(bins, wide + 2)
        won = keys % 2 == 1
        count, at, z = found[:, 0], found[:, 1] / found[:, 0], found[:, 2:]
        loss, miss, other_miss, curve, other_curve, mixed = _curves(at[won], count[won], at[~won], count[~won], z[~won])
        gradient = (other_miss @ z[~won] - miss @ z[won]) / pairs + l2 * w
        weight = np.zeros(2 * MOST_BINS)
        weight[keys[won]], weight[keys[~won]] = curve, other_curve
        shared = z[won].T @ mixed
        return loss / pairs + l2 / 2 * float(w @ w), gradient, weight, shared

    def curvature(w, weight, shared):
        centre = float(middle @ w)

        def squares(x, y):
            x, y = x[(y == 0) | (y == 1)], y[(y == 0) | (y == 1)]
            z = model.design(x)
            own = weight[bin_keys((z * w).sum(axis=1), y, centre)]
            return np.arange(wide), (z * own[:, None]).T @ z

        return (sums(squares, wide)[1] - shared - shared.T) / pairs + l2 * np.eye(wide)

    w = model.weights
    loss, gradient, weight, shared = compared(w)
    for _ in range(steps):
        step = np.linalg.solve(curvature(w, weight, shared), gradient)
        while True:
            ahead = compared(w - step)
            if ahead[0] <= loss + 1e-7 or np.abs(step).max() < 1e-4:
                break
            step = step / 2
        w, (loss, gradient, weight, shared) = w - step, ahead
        if np.abs(step).max() < 1e-4:
            break
    model.weights = _rounded(w)
    model.threshold = quantile(sums, model, n, bad / n)
    return model


def fit_ranker(x: np.ndarray, y: np.ndarray, cut: float = 0.3) -> Ranker:
    """``fit_sums`` over features and labels in memory."""
    return fit_sums(sums_of_arrays(np.asarray(x), np.asarray(y)), cut)


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text: str = "text",
          cut: float = 0.3) -> DataFrame:
    """(id, held_out, score, predicted) of every document; predicted is 1 where score >= ``cut``.

    Null and empty texts have zero features and are scored like any other; repeated rows are
    scored each; without usable labels of both kinds all score ``cut``; other columns are ignored;
    an empty table gives an empty result.  Texts are read once: their features are written, and
    both the fit, on every labelled row outside the held-out fold, and the scores read these.
    """
    @F.pandas_udf("array<double>")
    def vectors(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in texts])

    vectored = written(docs.select(F.col(id_col).alias("id"), vectors(F.col(text)).alias("x")), "ranking-features")
    train = written(vectored.join(known_labels(labels, label, id_col), "id").select("label", "x"), "ranking-rows")
    model = fit_sums(sums_of_rows(train), cut)

    @F.pandas_udf("double")
    def scored(x: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.stack(x.to_numpy())) if len(x) else [], dtype=float)

    rows = vectored.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), scored("x").alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= cut).cast("int"))
