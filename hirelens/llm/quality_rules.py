"""Quality rules: per-document word rules and cross-document line frequency.

Lines are normalised and hashed, and each line counts the distinct documents of its host that
hold it.  Copies are one document, not many: a document counts under a hash of its whole set of
lines, so documents that share some lines and differ in others count each.  Lines above the
limit of their host are boilerplate and removed; a document that keeps too little is depleted
and rejected, as is one that fails the word rules.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import without_lines, written

WORDS = re.compile("[^\x20\x09-\x0d]+")
SYMBOLS = re.compile(r"[#*$%&|<>]")
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
MIN_WORDS = 50
REPEAT_PERCENT = 50
LINE_LIMIT = 50  # distinct documents of a host that may share a line, at least
LINE_SHARE = 0.01  # and the share of the host's documents that may
KEEP_PERCENT = 20  # of its words a document must keep


def repeated_words(words: list[str]) -> int:
    """Words inside three-word windows that occur twice or more in the text, the first occurrence included."""
    n = len(words) - 2
    if n < 2:
        return 0
    grams = list(zip(words, words[1:], words[2:]))
    counts = Counter(grams)
    if len(counts) == n:
        return 0
    again = np.fromiter([counts[g] > 1 for g in grams], dtype=bool, count=n)
    inside = np.zeros(len(words), bool)
    for k in range(3):
        inside[k:k + n] |= again
    return int(inside.sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    words = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return (len(words), sum(map(len, words)), len(SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeated_words(words))


def line_hashes(text: str | None) -> tuple[list[int], list[int]]:
    """A hash and the words of each line: lower case, digits as 0, single spaces; 0 and 0 for a line without a word."""
    hashes, words = [], []
    for line in (text or "").split("\n"):
        found = line.lower().split()
        key = re.sub(r"\d", "0", " ".join(found))
        hashes.append(xxhash.xxh64_intdigest(key.encode("utf-8", "replace")) - (1 << 63) if found else 0)
        words.append(len(found))
    return hashes, words


def set_hash(hashes: list[int], words: list[int]) -> int | None:
    """One hash of the different lines with a word, in any order and number; None if there are none."""
    different = np.unique(np.array(hashes, np.int64)[np.array(words, np.int64) > 0])
    return xxhash.xxh64_intdigest(different.tobytes()) - (1 << 63) if len(different) else None


def document_lines(docs: DataFrame, id_col: str, text: str, host: str) -> DataFrame:
    """Per row: id (as text), host, the base counts, the hash and words of each line, and a hash of its set of lines."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            base = pd.DataFrame([base_counts(t) for t in batch["text"]], columns=[c.split()[0] for c in BASE.split(", ")],
                                dtype="int64")
            lines = [line_hashes(t) for t in batch["text"]]
            yield batch[["__row", "id", "host"]].reset_index(drop=True).assign(
                **base, hashes=[x for x, _ in lines], words=[x for _, x in lines],
                lineset=pd.array([set_hash(*x) for x in lines], dtype="Int64"))

    # ids go through Python as text: pandas would turn whole numbers beside nulls into floats
    rows = docs.select(F.monotonically_increasing_id().alias("__row"), F.col(id_col).cast("string").alias("id"),
                       F.col(host).cast("string").alias("host"), F.col(text).alias("text"))
    typed = "__row long, id string, host string, " + BASE + ", hashes array<long>, words array<long>, lineset long"
    return rows.mapInPandas(run, typed)


def judge(docs: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source", min_words: int = MIN_WORDS,
          repeat_percent: int = REPEAT_PERCENT, line_limit: int = LINE_LIMIT, line_share: float = LINE_SHARE,
          keep_percent: int = KEEP_PERCENT) -> DataFrame:
    """One row per document: id, the counts, base_failed, words_removed (in lines above the limit), kept, and lines_removed.

    ``lines_removed`` has the places of the lines above the limit, from 0; ``keep_good`` gives texts without them.

    A null text has no words and fails; a null host is a host of its own; repeated rows are judged
    each and alike; other columns are ignored; an empty table gives an empty result.
    """
    rows = written(document_lines(docs, id_col, text, host), "rules-lines")
    return _judged(rows, min_words, repeat_percent, line_limit, line_share, keep_percent) \
        .select(F.col("id").cast("long").alias(id_col), *[c.split()[0] for c in BASE.split(", ")], "base_failed", "words_removed",
                "kept", "lines_removed")


def _judged(rows, min_words, repeat_percent, line_limit, line_share, keep_percent) -> DataFrame:
    lines = rows.select("__row", "host", "lineset", F.posexplode(F.arrays_zip("hashes", "words")).alias("at", "l")) \
        .select("__row", "host", "lineset", "at", F.col("l.hashes").alias("line"), F.col("l.words").alias("words")).where("words > 0")
    hosts = rows.where("lineset is not null").select("host", "lineset").distinct().groupBy("host").agg(F.count("*").alias("docs"))
    limit = F.greatest(F.lit(float(line_limit)), F.col("docs") * F.lit(line_share))
    common = (lines.select("host", "line", "lineset").distinct().groupBy("host", "line").agg(F.count("*").alias("n"))
              .where(F.col("n") > line_limit).withColumnRenamed("host", "h"))
    common = common.join(hosts, F.col("h").eqNullSafe(F.col("host"))).where(F.col("n") > limit) \
        .select("h", F.col("line").alias("l"))
    common = written(common, "rules-common-lines")
    removed = (lines.join(common, F.col("host").eqNullSafe(F.col("h")) & (F.col("line") == F.col("l")))
               .groupBy("__row").agg(F.sum("words").alias("words_removed"), F.array_sort(F.collect_list("at")).alias("lines_removed")))
    base_failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    depleted = 100 * (F.col("n_words") - F.col("words_removed")) < keep_percent * F.col("n_words")
    return (rows.drop("hashes", "words", "lineset").join(removed, "__row", "left").fillna(0, ["words_removed"])
            .withColumn("lines_removed", F.coalesce("lines_removed", F.array().cast("array<int>")))
            .withColumn("base_failed", base_failed).withColumn("kept", ~base_failed & ~depleted))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source", length: str = "n_chars",
              **params) -> DataFrame:
    """The rows of ``docs`` that the rules keep, ``text`` without the lines above the limit; other columns unchanged.

    Where lines are removed, ``length`` (if there is such a column) is that of the new text.  Verdict
    and lines depend on host and text alone, so rows are matched by the hash of both.
    """
    def key(df):
        named = F.col(host).cast("string")
        named = F.coalesce(F.concat(F.length(named).cast("string"), F.lit(":"), named), F.lit("-"))
        return df.withColumn("__key", F.md5(F.concat(named, F.coalesce(F.col(text), F.lit("")))))

    defaults = {"min_words": MIN_WORDS, "repeat_percent": REPEAT_PERCENT, "line_limit": LINE_LIMIT, "line_share": LINE_SHARE,
                "keep_percent": KEEP_PERCENT} | params
    keyed = key(docs).select(F.col("__key").alias("__id"), F.col(text).alias("__text"), F.col(host).alias("__host"))
    rows = written(document_lines(keyed, "__id", "__text", "__host"), "rules-lines")
    changed = _judged(rows, **defaults).where(~F.col("kept") | (F.col("words_removed") > 0)) \
        .groupBy(F.col("id").alias("__key")).agg(F.first("kept").alias("__kept"), F.first("lines_removed").alias("__gone"))
    good = key(docs).join(written(changed, "rules-changed"), "__key", "left").where(F.coalesce("__kept", F.lit(True)))
    cut = F.col("__gone").isNotNull()
    good = good.withColumn(text, without_lines(F.col(text), F.coalesce("__gone", F.array().cast("array<int>"))))
    if length in docs.columns:
        renewed = F.length(text).cast(docs.schema[length].dataType)
        good = good.withColumn(length, F.when(cut, renewed).otherwise(F.col(length)))
    return good.select(*docs.columns)
