"""Lexical retrieval packing: windows of training tokens filled with BM25 neighbours.

Every document becomes token ids and an end id, and each id goes to exactly one window.
Documents are range-partitioned by a lexical key (the rarest of a few hashed words), so texts
that share rare words, copies above all, reach the same shard; equal keys are spread by a
hash, so a group of copies of any size splits over shards.  Each shard, a run of bounded size
within a partition, holds a BM25 inverted index over its documents with document frequencies
and lengths counted over the whole corpus.  The seed of a window asks the index for unused
neighbours, best first, which fill the window greedily; the one that does not fit is cut,
its rest opens the next window and is the next seed.  Only the last window of a partition can
be short, so padding falls with the partition size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .tokens import CachedTokenizer

WINDOW = 2048
END_ID = 1
K1, B = 1.2, 0.75
PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
_TOKENIZERS: dict[str, CachedTokenizer] = {}


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _tokenizer(path: str) -> CachedTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = CachedTokenizer(path)
    return _TOKENIZERS[path]


def tokenize(docs: DataFrame, id_col: str, text: str, path: str, end_id: int) -> DataFrame:
    """(doc_id, ids binary of little-endian 16-bit ids, n, place): place is the lexical key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = _tokenizer(path)
        end = np.array([end_id], dtype="<u2")
        # a fixed random rank of each id: the least rank in a text is a one-value MinHash of its tokens
        rank = np.random.default_rng(7).permutation(65_536).astype(np.int64)
        common = np.zeros(65_536, bool)
        common[:1024] = True  # single bytes and the first merges, which most texts hold
        rank[common] += 65_536
        for batch in batches:
            ids = [np.concatenate((tok.ids(t or ""), end)) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": [i.astype("<u2").tobytes() for i in ids],
                                "n": [len(i) for i in ids], "place": [int(rank[i].min()) for i in ids]})

    # ids go through Python as text: pandas would turn whole numbers beside nulls into floats
    return docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text).alias("text")) \
        .mapInPandas(run, "doc_id string, ids binary, n long, place long").withColumn("doc_id", F.col("doc_id").cast("long"))


def term_counts(tokens: DataFrame) -> tuple[np.ndarray, int, int]:
    """Over all documents: in how many each id occurs (at most 65,536 numbers), how many there are, their tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, docs, total = np.zeros(65_536, np.int64), 0, 0
        for batch in batches:
            for blob in batch["ids"]:
                ids = np.frombuffer(blob, dtype="<u2")
                df[np.unique(ids)] += 1
                docs, total = docs + 1, total + len(ids)
        found = np.flatnonzero(df)
        yield pd.DataFrame({"id": np.r_[found, -1, -2], "c": np.r_[df[found], docs, total]})

    rows = tokens.select("ids").mapInPandas(run, "id long, c long").groupBy("id").agg(F.sum("c").alias("c")).toPandas()
    df, at = np.zeros(65_536, np.int64), dict(zip(rows["id"], rows["c"]))
    for i, c in at.items():
        if i >= 0:
            df[i] = c
    return df, int(at.get(-1, 0)), int(at.get(-2, 0))


class Shard:
    """BM25 inverted index over the documents of one shard; ``neighbours`` ranks the unused ones."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean_length: float):
        rows, terms, weights = [], [], []
        for k, ids in enumerate(docs):
            term, tf = np.unique(ids, return_counts=True)
            rows.append(np.full(len(term), k, np.int32))
            terms.append(term)
            weights.append(tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ids) / mean_length)) * idf[term])
        self.terms_of = terms
        term, row, weight = np.concatenate(terms), np.concatenate(rows), np.concatenate(weights)
        order = np.argsort(term, kind="stable")
        self.row, self.weight = row[order], weight[order].astype(np.float32)
        self.first = np.searchsorted(term[order], np.arange(65_537))
        self.unused = np.ones(len(docs), bool)
        self.listed = self.left = len(docs)

    def use(self, doc: int) -> None:
        """Take a document out; once half of the listed ones are, the postings are compacted."""
        self.unused[doc] = False
        self.left -= 1
        if self.left < self.listed // 2:
            stay = self.unused[self.row]
            self.first = np.r_[0, np.cumsum(stay)][self.first]
            self.row, self.weight, self.listed = self.row[stay], self.weight[stay], self.left

    def neighbours(self, seed: int) -> np.ndarray:
        """Unused documents, highest BM25 score for the seed's terms first, ties by their place."""
        t = self.terms_of[seed]
        begin, size = self.first[t], self.first[t.astype(np.int64) + 1] - self.first[t]
        at = np.repeat(begin - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        score = np.bincount(self.row[at], weights=self.weight[at], minlength=len(self.unused))
        free = np.flatnonzero(self.unused)
        return free[np.argsort(-score[free], kind="stable")]


def fill(docs: list[np.ndarray], idf: np.ndarray, mean_length: float, room: int, window: int) -> Iterator[int]:
    """The order in which a shard's documents go into windows of which the open one has ``room``."""
    if not docs:
        return
    shard = Shard(docs, idf, mean_length)
    best, seed = iter([0]), 0
    while shard.left:
        for k in best:
            shard.use(k)
            yield k
            n = len(docs[k])
            if n >= room:  # cut: its rest opens the next window, for which it is the seed
                room, seed = window - (n - room) % window, k
                break
            room -= n
            seed = k
        best = map(int, shard.neighbours(seed))


def pack(docs: DataFrame, id_col: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = END_ID,
         window: int = WINDOW, with_ids: bool = True, shard_tokens: int = 500_000, partition_tokens: int = 8_000_000) -> DataFrame:
    """Pieces of documents in windows: see PIECES; ``ids`` (little-endian 16-bit) holds the piece's tokens, if asked for.

    A null or empty text is its end id alone; repeated rows are packed each; null ids stay null;
    ties in the lexical key are split by a hash; other columns are ignored; an empty table gives
    no pieces.  ``start`` counts the document's ids before the piece.
    """
    spark = docs.sparkSession
    tokens = written(tokenize(docs, id_col, text, tokenizer or tokenizer_path(), end_id), "packing-tokens")
    df, n_docs, total = term_counts(tokens)
    idf = np.log(1 + (n_docs - df + 0.5) / (df + 0.5)).astype(np.float32)
    mean_length = max(1.0, total / max(1, n_docs))
    stats = spark.sparkContext.broadcast((idf, mean_length))  # 65,536 numbers

    schema = PIECES + ", ids binary" * with_ids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        idf, mean_length = stats.value
        sequence, offset = TaskContext.get().partitionId() << 40, 0
        held_ids, held_docs, held = [], [], 0

        def flush():
            nonlocal sequence, offset, held_ids, held_docs, held
            out = []
            for k in fill(held_docs, idf, mean_length, window - offset, window):
                ids, start = held_docs[k], 0
                while start < len(ids):
                    piece = ids[start:start + window - offset]
                    out.append((held_ids[k], start, len(piece), zlib.crc32(piece.astype("<u4").tobytes()), len(ids),
                                sequence, offset, *([piece.tobytes()] if with_ids else [])))
                    start, offset = start + len(piece), offset + len(piece)
                    if offset == window:
                        sequence, offset = sequence + 1, 0
            held_ids, held_docs, held = [], [], 0
            names = [c.split()[0] for c in schema.split(", ")]
            return pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

        for batch in batches:
            for doc_id, blob in zip(batch["doc_id"], batch["ids"]):
                held_ids.append(None if doc_id is None else int(doc_id))
                held_docs.append(np.frombuffer(blob, dtype="<u2"))
                held += len(held_docs[-1])
                if held >= shard_tokens:
                    yield flush()
        if held:
            yield flush()

    parts = max(1, round(total / partition_tokens))
    spread = F.xxhash64("doc_id", "ids")
    return (tokens.withColumn("spread", spread).repartitionByRange(parts, "place", "spread")
            .sortWithinPartitions("place", "spread", "doc_id").drop("spread")
            .select(F.col("doc_id").cast("string"), "ids").mapInPandas(run, schema))
