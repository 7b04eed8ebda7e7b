"""Ranked lexical search over document FP-trees by branch and bound.

Documents are reduced to the terms that some query item has.  In a shard of documents these
restricted term vectors, most frequent term first, are sorted, so that vectors with a common
beginning share a path of a trie; small neighbouring branches form one leaf.  Each node keeps, for
the documents under it, the largest tf of every term, the smallest m and the smallest id.  A term
adds w * (1e9 tf div (1000 tf + 8 m)) to a score, more with larger tf and less with larger m, so
the maxima and the minimum bound every score under a node.  Each item walks the tree depth first,
best bound first, and leaves out nodes that cannot reach its k best.

No document is left out: every shard is searched for every item, and each shard's k best of
an item are ranked again over all shards.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import floor, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import importable, written

# bytes of terms: A-Z become lower case, other ASCII but letters and digits a space; all bytes of other characters stay
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
K = 10
BLOCK_TERMS = 1 << 18  # terms of the items, repeats over items included, that are searched for in one pass
SHARD_DOCS = 8192
SHARD_ENTRIES = 1 << 21  # (document, term) pairs of a shard
LEAF_DOCS = 32
LAST_ID = 2**63 - 1  # a null id comes after all others


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a whole text, in order, with repeats."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split()


def weight(docs: int, df: int) -> int:
    return floor(1000 * log((2 * docs + 2) / (2 * df + 1)))


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term of weight 1 adds to the score of a document."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


@dataclass
class Shard:
    """Documents sorted by their restricted term vectors, and the trie over them as arrays (node 0 is the root)."""

    ids: np.ndarray  # of each document; the largest number for a null id
    offsets: np.ndarray  # where each document's entries begin, and the end
    terms: np.ndarray  # of each entry: the term, as its place in the order of frequencies
    impacts: np.ndarray
    lo: np.ndarray  # of each node: its documents lo..hi
    hi: np.ndarray
    first_child: np.ndarray  # the children of a node stand side by side
    children: np.ndarray  # how many; 0 for a leaf
    least_m: np.ndarray
    least_id: np.ndarray
    keys: np.ndarray  # sorted node * n_terms + term ...
    max_tf: np.ndarray  # ... and the largest tf of the term under the node
    n_terms: int

    def bounds(self, nodes: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """An upper bound of the scores under each node, for an item's different terms and their weights times repeats."""
        want = nodes[:, None] * self.n_terms + terms[None, :]
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        tf = np.where(self.keys[at] == want, self.max_tf[at], 0)
        return (impact(tf, self.least_m[nodes][:, None]) * weights[None, :]).sum(axis=1)

    def scores(self, lo: int, hi: int, weight_of: np.ndarray) -> np.ndarray:
        a, b = self.offsets[lo], self.offsets[hi]
        return np.add.reduceat(weight_of[self.terms[a:b]] * self.impacts[a:b], self.offsets[lo:hi] - a)

    def best(self, terms: np.ndarray, weights: np.ndarray, weight_of: np.ndarray, k: int, top: list) -> list:
        """The k best (-score, id) of ``top`` and this shard, sorted; ``weight_of`` has the weights by term, else zeros."""
        stack = [(0, 0)]
        while stack:
            node, bound = stack.pop()
            if node and len(top) == k and (-bound, self.least_id[node]) >= top[-1]:
                continue  # what is under the node comes after the k best at best
            if not self.children[node]:
                score = self.scores(self.lo[node], self.hi[node], weight_of)
                ids = self.ids[self.lo[node]:self.hi[node]]
                good = score > 0
                if len(top) == k:
                    good &= score >= -top[-1][0]
                good = np.flatnonzero(good)
                if len(good) > k:
                    good = good[np.lexsort((ids[good], -score[good]))[:k]]
                if len(good):
                    top = sorted(top + list(zip((-score[good]).tolist(), ids[good].tolist())))[:k]
                continue
            below = np.arange(self.first_child[node], self.first_child[node] + self.children[node])
            bound = self.bounds(below, terms, weights)
            keep = bound > 0
            if len(top) == k:
                keep &= bound >= -top[-1][0]
            below, bound = below[keep], bound[keep]
            order = np.argsort(bound, kind="stable")  # the best bound on top of the stack
            stack += zip(below[order].tolist(), bound[order].tolist())
        return top


def build(docs: list[tuple[int, int, np.ndarray, np.ndarray]], n_terms: int, leaf_docs: int = LEAF_DOCS) -> Shard:
    """The trie of (id, m, terms ascending, tfs) of documents with at least one term."""
    order = sorted(range(len(docs)), key=lambda i: docs[i][2].astype(">i4").tobytes())
    vectors = [docs[i][2] for i in order]
    ids, m = (np.array([docs[i][k] for i in order], np.int64) for k in (0, 1))
    sizes = np.array([len(v) for v in vectors], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    terms = np.concatenate(vectors).astype(np.int64)
    tfs = np.concatenate([docs[i][3] for i in order]).astype(np.int64)
    shared = np.array([0] + [_common(a, b) for a, b in zip(vectors, vectors[1:])], np.int64)  # with the document before
    lo, hi, first_child, children, parent = [0], [len(docs)], [0], [0], [-1]
    todo = [0]
    while todo:
        node = todo.pop()
        a, b = lo[node], hi[node]
        if b - a <= leaf_docs:
            continue
        depth = shared[a + 1:b].min()  # all share the path so far
        cuts = np.concatenate([[a], a + 1 + np.flatnonzero(shared[a + 1:b] == depth), [b]])
        if depth == sizes[a] == sizes[b - 1]:
            continue  # copies
        runs, at = [], 0
        while at < len(cuts) - 1:  # neighbouring small branches become one leaf
            end = at + 1
            while end < len(cuts) - 1 and cuts[end + 1] - cuts[at] <= leaf_docs:
                end += 1
            runs.append((int(cuts[at]), int(cuts[end])))
            at = end
        if len(runs) == 1:
            continue
        first_child[node], children[node] = len(lo), len(runs)
        for x, y in runs:
            todo.append(len(lo))
            lo.append(x)
            hi.append(y)
            first_child.append(0)
            children.append(0)
            parent.append(node)
    keys, most = [None] * len(lo), [None] * len(lo)
    least_m, least_id = (np.array([x[a:b].min() for a, b in zip(lo, hi)]) for x in (m, ids))
    for node in range(len(lo) - 1, -1, -1):  # children come after their parents
        if children[node]:
            below = range(first_child[node], first_child[node] + children[node])
            keys[node], most[node] = _largest(np.concatenate([keys[c] for c in below]), np.concatenate([most[c] for c in below]))
        else:
            a, b = offsets[lo[node]], offsets[hi[node]]
            keys[node], most[node] = _largest(terms[a:b], tfs[a:b])
    every = np.concatenate([x + node * n_terms for node, x in enumerate(keys)])
    return Shard(ids, offsets, terms, impact(tfs, np.repeat(m, sizes)), np.array(lo), np.array(hi), np.array(first_child),
                 np.array(children), least_m, least_id, every, np.concatenate(most), n_terms)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


def _largest(terms: np.ndarray, tfs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((-tfs, terms))
    terms, tfs = terms[order], tfs[order]
    first = np.flatnonzero(np.diff(terms, prepend=-1))
    return terms[first], tfs[first]


def _vectors(docs: DataFrame, id_col: str, text: str, number: dict[bytes, int]) -> DataFrame:
    """(id, n, terms, tfs) of every document with a term: all its terms counted, those with a number kept."""
    shared = docs.sparkSession.sparkContext.broadcast(number)  # the terms of one block of items

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for batch in batches:
            out = []
            for doc, text in zip(batch["id"], batch["text"]):
                words = terms_of(text)
                if words:
                    found = Counter(w for w in words if w in known)
                    out.append((doc, len(words), np.array([known[w] for w in found], np.int32).tobytes(),
                                np.array(list(found.values()), np.int32).tobytes()))
            yield pd.DataFrame(out, columns=["id", "n", "terms", "tfs"])

    # ids go through Python as text: pandas would turn whole numbers beside nulls into floats
    return docs.select(F.col(id_col).cast("string").alias("id"), F.col(text).alias("text")) \
        .mapInPandas(run, "id string, n long, terms binary, tfs binary")


def _document_frequencies(vectors: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each of ``size`` terms."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = np.zeros(size, np.int64)
        for batch in batches:
            count += np.bincount(np.frombuffer(b"".join(batch["terms"]), np.int32), minlength=size)
        held = np.flatnonzero(count)
        yield pd.DataFrame({"term": held, "df": count[held]})

    found = vectors.select("terms").mapInPandas(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
    out = np.zeros(size, np.int64)
    out[found["term"].to_numpy(np.int64)] = found["df"].to_numpy(np.int64)
    return out


def _search(docs: DataFrame, items: list[tuple[str | None, Counter]], id_col: str, text: str, k: int, shard_docs: int,
            shard_entries: int, leaf_docs: int) -> DataFrame:
    """(item, doc, score): the k best of every item in each task's documents."""
    spark = docs.sparkSession
    number = {t: i for i, t in enumerate(sorted(set().union(*[set(c) for _, c in items])))}
    vectors = written(_vectors(docs, id_col, text, number), "fptree-vectors")
    sums = vectors.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = sums["docs"], sums["terms"] or 1
    df = _document_frequencies(vectors, len(number))
    place = np.empty(len(number), np.int64)  # of each term in the order of frequencies, the most frequent first
    by_frequency = np.argsort(-df, kind="stable")
    place[by_frequency] = np.arange(len(number))
    queries = []
    for item, counts in items:
        terms = np.array([place[number[t]] for t in counts], np.int64)
        weights = np.array([weight(n_docs, int(df[number[t]])) * n for t, n in counts.items()], np.int64)
        held = np.array([df[number[t]] > 0 for t in counts], bool) & (weights > 0)
        queries.append((item, terms[held], weights[held]))
    shared = spark.sparkContext.broadcast((place, queries))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, queries = shared.value
        best: list[list] = [[] for _ in queries]
        weight_of = np.zeros(len(place), np.int64)
        held, entries = [], 0

        def search():
            shard = build(held, len(place), leaf_docs)
            for q, (_, terms, weights) in enumerate(queries):
                if len(terms):
                    weight_of[terms] = weights
                    best[q] = shard.best(terms, weights, weight_of, k, best[q])
                    weight_of[terms] = 0

        for batch in batches:
            for doc, n, terms, tfs in zip(batch["id"], batch["n"].tolist(), batch["terms"], batch["tfs"]):
                if not terms:
                    continue
                terms, tfs = place[np.frombuffer(terms, np.int32)], np.frombuffer(tfs, np.int32)
                order = np.argsort(terms)
                held.append((LAST_ID if doc is None else int(doc), 100 - 75 + 75 * n * n_docs // n_terms, terms[order], tfs[order]))
                entries += len(terms)
                if len(held) >= shard_docs or entries >= shard_entries:
                    search()
                    held, entries = [], 0
        if held:
            search()
        rows = [(item, None if doc == LAST_ID else str(doc), -score) for (item, _, _), top in zip(queries, best) for score, doc in top]
        yield pd.DataFrame(rows, columns=["item", "doc", "score"])

    return vectors.select("id", "n", "terms", "tfs").mapInPandas(run, "item string, doc string, score long")


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id",
           item_text: str = "text", k: int = K, block_terms: int = BLOCK_TERMS, shard_docs: int = SHARD_DOCS,
           shard_entries: int = SHARD_ENTRIES, leaf_docs: int = LEAF_DOCS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k highest-scoring documents with a score above 0.

    Equal scores go by ascending id, a null id last.  Every row of ``docs`` is a document, repeated
    ones too.  Rows of one item id are one item, with the smallest of their texts; a null id is an
    item.  Null and empty texts have no terms, and an item without terms no rows; very long texts are
    read whole.  Other columns are ignored, whatever their names; an empty table gives an empty
    result.  Ids are whole numbers.

    Items go in blocks of about ``block_terms`` terms, each a pass over the documents: what the
    driver and each task hold grows with a block, not with the number of items.
    """
    spark = docs.sparkSession
    importable(spark)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [Counter(terms_of(t)) for t in batch["text"]]
            yield pd.DataFrame({"item": batch["item"], "terms": [list(c) for c in found], "repeats": [list(c.values()) for c in found]})

    named = items.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text"))
    named = written(named.groupBy("item").agg(F.min("text").alias("text"))
                    .mapInPandas(counted, "item string, terms array<binary>, repeats array<long>"), "fptree-items")
    total = named.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, -(-total // block_terms))
    found = None
    for block in range(blocks):
        rows = named.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect()  # about block_terms terms
        part = [(r["item"], Counter(dict(zip(map(bytes, r["terms"]), r["repeats"])))) for r in rows if r["terms"]]
        if part:
            best = _search(docs, sorted(part, key=lambda x: x[0] or ""), id_col, text, k, shard_docs, shard_entries, leaf_docs)
            found = best if found is None else found.unionByName(best)
    if found is None:
        found = spark.createDataFrame([], "item string, doc string, score long")
    ids = found.select(F.col("item").cast("long").alias(item_id), F.col("doc").cast("long").alias(id_col), "score")
    order = Window.partitionBy(item_id).orderBy(F.desc("score"), F.col(id_col).asc_nulls_last())
    return ids.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(item_id, "rank", id_col, "score")
