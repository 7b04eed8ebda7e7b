"""Conversation prefix trie from sorted conversations, LCPs and range minima.

Conversations are sequences of turn digests, cut into segments of ``SEGMENT`` turns, so that one of
any length is many small rows.  Segments are sorted by place, hash of all that precedes, and
digests; in this order the members of every prefix stand side by side.  Blocks of the sorted rows
keep the LCP of each row with the row before.  In a block a sparse table of range minima over the
LCPs lets each candidate prefix (row, depth) binary-search its left and its right extent, each by
itself: the interval of its members.  The candidates at a left extent are the nodes; counts over an
interval are differences of running sums, the smallest member is a range minimum again.

Intervals that cross the border of a block are added up by the hash of their prefix.  A node's
subtree needs no walk: with B bytes of a member's turns from the node on, and U bytes of those that
are new in sorted order, the sum of (n_convs - 1) * bytes over the subtree is the sum of B - U.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import importable, shuffle_partitions, written

SEGMENT = 64  # turns of a row
BLOCK_ROWS = 8192  # rows of a sparse table
CHUNK = 4096  # turns of a conversation that are joined under one key
HEAD = 9  # first turns taken over are fewer than so many
GROUP = 5
NO_ENDS = hashlib.sha256(b"").hexdigest()
UNKNOWN = -2  # the LCP at the border of two partitions


def running(df: DataFrame, key: str, order: list[Column], keep: list[str], values: list[str], name: str) -> DataFrame:
    """``key`` and ``keep`` of ``df`` (whole numbers and bytes, no nulls) with before_<v>: the sum of v over the key's rows that come first.

    A range sort, so a key of any size is spread over tasks; what a partition's first key has
    before it comes from sums of the partitions before, of which the driver gets one row each.
    Sums wrap around at 64 bits.
    """
    columns = [key, *keep]
    rows = df.withColumn("__tie", F.xxhash64(F.monotonically_increasing_id()))
    keys = [F.col(key), *order, F.col("__tie")]
    rows = rows.repartitionByRange(shuffle_partitions(df.sparkSession), *keys).sortWithinPartitions(*keys).select(*columns)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    before = [f"before_{v}" for v in values]
    typed = ", ".join([*[f"{c} {types[c]}" for c in columns], *[f"{b} long" for b in before], "__pid int", "__head boolean", "__row long"])

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        pid, first, last, carry, at = TaskContext.get().partitionId(), None, None, None, 0
        for b in batches:
            if not len(b):
                continue
            k, v = b[key].to_numpy(), b[values].to_numpy(np.int64)
            total = np.vstack([np.zeros((1, len(values)), np.int64), np.cumsum(v, axis=0)])
            starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            run = np.cumsum(np.r_[True, k[1:] != k[:-1]]) - 1
            out = total[:-1] - total[starts[run]]
            if last is not None and k[0] == last:
                out[run == 0] += carry
            first = k[0] if first is None else first
            last, carry = k[-1], out[-1] + v[-1]
            yield b.assign(**dict(zip(before, out.T)), __pid=np.int32(pid), __head=k == first, __row=np.arange(at, at + len(b)))
            at += len(b)

    done = written(rows.mapInPandas(sums, typed), name)
    ends = done.groupBy("__pid").agg(F.min(key).alias("first"), F.max(key).alias("last"),
                                     F.max_by(F.struct(*before, *values), "__row").alias("at_end")).orderBy("__pid").collect()
    add, last, carry = {}, None, None
    for r in ends:
        after = np.array([r["at_end"][b] for b in before], np.int64) + np.array([r["at_end"][v] for v in values], np.int64)
        if last is not None and r["first"] == last:
            add[r["__pid"]] = carry
            carry = carry + after if r["first"] == r["last"] else after
        else:
            carry = after
        last = r["last"]

    def carried(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[before].to_numpy(np.int64).copy()
            pid, head = b["__pid"].to_numpy(), b["__head"].to_numpy(bool)
            for p in np.unique(pid[head]).tolist():
                if p in add:
                    out[head & (pid == p)] += add[p]
            yield b[columns].assign(**dict(zip(before, out.T)))

    return done.mapInPandas(carried, ", ".join([*[f"{c} {types[c]}" for c in columns], *[f"{b} long" for b in before]]))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def turn_hashes(digests: np.ndarray, places: np.ndarray) -> np.ndarray:
    """128 bits for each turn at its place, as two numbers; a prefix's hash is the sum over its turns."""
    x = digests.reshape(-1, 2)
    salt = _mix(places.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    return np.stack([_mix(x[:, 0] ^ salt) + x[:, 1], _mix(x[:, 1] ^ _mix(salt)) + x[:, 0]], axis=1)


def rebuilt(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str, chunk: int) -> tuple[DataFrame, DataFrame]:
    """(c, n_turns) of every rebuilt conversation, and (c, n_turns, pos, x, bytes) of its turns."""
    own_text, own_role = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in (text, role))
    turns = conversations.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("c"), F.col(turn).alias("t"),
        F.unhex(F.md5(F.concat(F.octet_length(own_role).cast("string"), F.lit(":"), own_role, own_text))).alias("x"),
        F.octet_length(own_text).cast("long").alias("bytes"), F.lit(1).cast("long").alias("one"))
    own = written(running(turns, "c", [F.col("t").asc_nulls_first(), F.col("x")], ["x", "bytes", "one"], ["one"], "trie-turns")
                  .select("c", "x", "bytes", F.col("before_one").alias("pos")), "trie-own")
    sizes = own.groupBy("c").agg(F.count("*").alias("n"))
    h = F.pmod(F.crc32(F.col("c").cast("string")), F.lit(HEAD))
    named = sizes.select("c", "n", h.alias("h"), (F.col("c") - F.col("c") % GROUP).alias("base"))
    named = named.join(sizes.select(F.col("c").alias("base"), F.col("n").alias("base_n")), "base", "left")
    taken = F.least("h", F.coalesce("base_n", F.lit(0)))
    convs = written(named.select("c", "base", "n", "h", taken.alias("taken"),
                                 (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns")), "trie-convs")
    first = convs.where("taken > 0").join(own.where(F.col("pos") < HEAD).select(F.col("c").alias("base"), "pos", "x", "bytes"), "base") \
        .where(F.col("pos") < F.col("h")).select("c", "n_turns", "pos", "x", "bytes")
    # a conversation of many turns meets its sizes under many keys
    spread = convs.select("c", "h", "taken", "n_turns", F.explode(F.expr(f"sequence(0L, (n - 1) div {chunk})")).alias("part"))
    rest = own.withColumn("part", F.expr(f"pos div {chunk}")).join(spread, ["c", "part"]).where(F.col("pos") >= F.col("h")) \
        .select("c", "n_turns", (F.col("taken") + F.col("pos") - F.col("h")).alias("pos"), "x", "bytes")
    return convs, first.unionByName(rest)


def segments(convs: DataFrame, turns: DataFrame, size: int) -> DataFrame:
    """Rows (c, s, g1, g2, more, xs, sizes): the s-th ``size`` turns; g1, g2 hash all before, more: others follow.

    A conversation without turns has one empty segment.
    """
    s = F.expr(f"pos div {size}")
    members = F.array_sort(F.collect_list(F.struct("pos", "x", "bytes")))  # at most ``size``
    rows = turns.groupBy("c", s.alias("s")).agg(F.first("n_turns").alias("n_turns"), members.alias("m"))
    rows = rows.select("c", "s", "n_turns", F.unhex(F.array_join(F.transform("m", lambda t: F.hex(t.x)), "")).alias("xs"),
                       F.transform("m", lambda t: t.bytes).alias("sizes"))
    empty = convs.where("n_turns = 0").select("c", F.lit(0).cast("long").alias("s"), "n_turns", F.unhex(F.lit("")).alias("xs"),
                                              F.array().cast("array<long>").alias("sizes"))
    rows = written(rows.unionByName(empty).withColumn("more", F.col("n_turns") > (F.col("s") + 1) * size).drop("n_turns"), "trie-segments")
    first = rows.where("s = 0").select("*", F.lit(0).cast("long").alias("g1"), F.lit(0).cast("long").alias("g2"))
    long = rows.where("s > 0 or more")
    if long.isEmpty():
        return first

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = [turn_hashes(np.frombuffer(x, np.uint64), s * size + np.arange(len(x) // 16)).sum(axis=0) for x, s in zip(b["xs"], b["s"])]
            at = np.array(at, np.uint64).reshape(-1, 2).view(np.int64)
            yield pd.DataFrame({"c": b["c"], "s": b["s"], "h1": at[:, 0], "h2": at[:, 1]})

    sums = long.select("c", "s", "xs").mapInPandas(hashed, "c long, s long, h1 long, h2 long")
    chained = running(sums, "c", [F.col("s")], ["s", "h1", "h2"], ["h1", "h2"], "trie-chains")
    later = rows.where("s > 0").join(chained.select("c", "s", F.col("before_h1").alias("g1"), F.col("before_h2").alias("g2")), ["c", "s"])
    return first.unionByName(later)


class Block:
    """Neighbouring rows of the sorted segments, as arrays; ``shared`` is each row's LCP with the row before.

    LCPs count turns of the segment: -1 between rows with another place or another beginning.
    """

    FIELDS = (("c", np.int64), ("s", np.int64), ("g1", np.int64), ("g2", np.int64), ("more", bool), ("n", np.int64))

    def __init__(self, rows: pd.DataFrame):
        self.c, self.s, self.g1, self.g2 = (rows[x].to_numpy(np.int64) for x in ("c", "s", "g1", "g2"))
        self.more = rows["more"].to_numpy(bool)
        self.n = np.array([len(x) // 16 for x in rows["xs"]], np.int64)
        self.x = np.frombuffer(b"".join(rows["xs"]), np.uint64).reshape(-1, 2)
        self.sizes = np.concatenate([np.zeros(0, np.int64), *[np.asarray(v, np.int64) for v in rows["sizes"]]])
        self.at = np.cumsum(self.n) - self.n
        self.shared = np.full(len(rows), UNKNOWN, np.int64)
        self.shared[1:] = self._lcps()
        self.after = UNKNOWN

    def __len__(self):
        return len(self.c)

    def _lcps(self) -> np.ndarray:
        out = np.zeros(max(0, len(self) - 1), np.int64)
        live = np.arange(len(out))
        same = (self.s[1:] == self.s[:-1]) & (self.g1[1:] == self.g1[:-1]) & (self.g2[1:] == self.g2[:-1])
        out[~same] = -1
        live, depth = live[same], 0
        while len(live):
            live = live[(self.n[live] > depth) & (self.n[live + 1] > depth)]
            live = live[(self.x[self.at[live] + depth] == self.x[self.at[live + 1] + depth]).all(axis=1)]
            depth += 1
            out[live] = depth
        return out

    def key(self, row: int) -> bytes:
        """Place, beginning and turns of a row, for the LCP over a border."""
        return np.array([self.s[row], self.g1[row], self.g2[row]], np.int64).tobytes() + self.x[self.at[row]:self.at[row] + self.n[row]].tobytes()

    def arrays(self) -> bytes:
        import pickle

        return pickle.dumps(self.__dict__, protocol=5)

    @classmethod
    def of(cls, blob: bytes) -> Block:
        import pickle

        block = cls.__new__(cls)
        block.__dict__.update(pickle.loads(blob))
        return block

    def new_bytes(self) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of each row's turns, and of those that the row before does not share."""
        total = np.concatenate([[0], np.cumsum(self.sizes)])
        return total[self.at + self.n] - total[self.at], total[self.at + self.n] - total[self.at + np.maximum(self.shared, 0)]

    def leaves(self) -> np.ndarray:
        """1 for the last of the rows of a childless node, else 0."""
        follows = np.append(self.shared[1:], self.after)
        return (~self.more & (follows < self.n)).astype(np.int64)


def border_lcp(a: bytes, b: bytes) -> int:
    if a[:24] != b[:24]:
        return -1
    n = 0
    while a[24 + 16 * n:40 + 16 * n] == b[24 + 16 * n:40 + 16 * n] != b"":
        n += 1
    return n


def sorted_blocks(rows: DataFrame, block_rows: int) -> DataFrame:
    """(pid, no, first, last, block): the sorted segments, ``block_rows`` to a row; first and last only at a partition's borders."""
    keys = ["s", "g1", "g2", "xs", "more", "c"]  # where a prefix ends comes before where it goes on
    rows = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        pid, held, waiting, no = TaskContext.get().partitionId(), None, None, 0

        def row(block, no, last=None):
            return pd.DataFrame({"pid": [np.int32(pid)], "no": [no], "first": [block.key(0) if no == 0 else None], "last": [last],
                                 "block": [block.arrays()]})

        def ready(frame):
            nonlocal waiting, no
            block, before = Block(frame), waiting
            waiting = block
            if before is None:
                return
            block.shared[0] = before.after = border_lcp(before.key(len(before) - 1), block.key(0))
            yield row(before, no)
            no += 1

        for b in batches:
            held = b if held is None else pd.concat([held, b], ignore_index=True)
            while len(held) >= block_rows:
                yield from ready(held[:block_rows].reset_index(drop=True))
                held = held[block_rows:].reset_index(drop=True)
        if held is not None and len(held):
            yield from ready(held)
        if waiting is not None:
            yield row(waiting, no, waiting.key(len(waiting) - 1))

    return rows.mapInPandas(pack, "pid int, no long, first binary, last binary, block binary")


def _sparse_table(values: np.ndarray) -> list[np.ndarray]:
    """Row j: the minima of 2**j values from each place on."""
    table, step = [values], 1
    while 2 * step <= len(values):
        table.append(np.minimum(table[-1][:-step], table[-1][step:]))
        step *= 2
    return table


def _minimum(table: list[np.ndarray], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minima of the values lo..hi, both included."""
    level = np.floor(np.log2(hi - lo + 1)).astype(np.int64)
    out = np.empty(len(lo), np.int64)
    for j in np.unique(level).tolist():
        pick = level == j
        out[pick] = np.minimum(table[j][lo[pick]], table[j][hi[pick] - (1 << j) + 1])
    return out


def extents(shared: np.ndarray, row: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last row of the interval around each row whose neighbours all share at least ``depth`` turns.

    Two binary searches of each candidate by itself, over range minima of the LCPs.
    """
    table = _sparse_table(shared)
    left, right = row.copy(), row.copy()
    for j in range(len(table) - 1, -1, -1):
        step = 1 << j
        can = np.flatnonzero(left - step >= 0)
        can = can[table[j][left[can] - step + 1] >= depth[can]]
        left[can] -= step
        can = np.flatnonzero(right + step < len(shared))
        can = can[table[j][right[can] + 1] >= depth[can]]
        right[can] += step
    return left, right


NODES = "depth long, p1 long, p2 long, q1 long, q2 long, c long, n long, leaves long, saved long, sha string, ends string, part string"


def _nodes(block: Block, later: np.ndarray, part: str, size: int) -> pd.DataFrame:
    """The nodes of a block's rows; ``later`` has bytes, new bytes and leaves of each row's later segments."""
    rows = len(block)
    shared = block.shared
    hashes = turn_hashes(block.x, np.repeat(block.s * size, block.n) + np.arange(len(block.x)) - np.repeat(block.at, block.n))
    summed = np.vstack([np.zeros((1, 2), np.uint64), np.cumsum(hashes, axis=0, dtype=np.uint64)])
    total = np.concatenate([[0], np.cumsum(block.sizes)])
    # candidates: every turn of every row, and the root in the first segments
    root = np.flatnonzero(block.s == 0)
    row = np.concatenate([root, np.repeat(np.arange(rows), block.n)])
    depth = np.concatenate([np.zeros(len(root), np.int64), np.arange(len(block.x)) - np.repeat(block.at, block.n) + 1])
    left, right = extents(shared, row, depth)
    own = left == row  # each interval once, by the candidate at its left extent
    row, right, depth = row[own], right[own], depth[own]
    goes_on = shared[row] >= depth  # from the block before: only where the row is the first

    def over(values):
        before = np.concatenate([[0], np.cumsum(values)])
        return before[right + 1] - before[row]

    def prefix_hash(d):
        base = np.stack([block.g1[row], block.g2[row]], axis=1).view(np.uint64)
        return (base + summed[block.at[row] + d] - summed[block.at[row]]).view(np.int64)

    own_bytes, new_bytes = block.new_bytes()
    above = total[block.at[row] + np.maximum(depth - 1, 0)] - total[block.at[row]]
    known = np.where(goes_on, 0, np.maximum(above - (total[block.at[row] + np.maximum(shared[row], 0)] - total[block.at[row]]), 0))
    count = right - row + 1
    saved = over(own_bytes + later[:, 0]) - count * above - (over(new_bytes + later[:, 1]) - known)
    here, up = prefix_hash(depth), prefix_hash(np.maximum(depth - 1, 0))
    # members that end here: the first rows of the interval, if they have no more turns
    ended = ~block.more
    alike = np.append(ended[1:] & ended[:-1] & (block.n[1:] == block.n[:-1]) & (shared[1:] == block.n[1:]), False)
    stops = np.flatnonzero(~alike)
    last = stops[np.searchsorted(stops, row)]
    ends = np.where(ended[row] & (block.n[row] == depth), last - row + 1, 0)
    crossing = goes_on | ((row + ends == rows) & (block.after >= depth))
    sha, text = [None] * len(row), [None] * len(row)
    for k in np.flatnonzero(ends).tolist():
        joined = ",".join(map(str, block.c[row[k]:row[k] + ends[k]].tolist()))
        if crossing[k]:
            text[k] = joined
        else:
            sha[k] = hashlib.sha256(joined.encode()).hexdigest()
    return pd.DataFrame({"depth": block.s[row] * size + depth, "p1": here[:, 0], "p2": here[:, 1], "q1": up[:, 0], "q2": up[:, 1],
                         "c": _minimum(_sparse_table(block.c), row, right), "n": count, "leaves": over(block.leaves() + later[:, 2]),
                         "saved": saved, "sha": sha, "ends": text, "part": part})


def _later(blocks: DataFrame) -> DataFrame | None:
    """(pid, no, later): for blocks with conversations of several segments, (row, bytes, new bytes, leaves) of what follows."""
    def single(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for pid, no, blob in zip(b["pid"], b["no"], b["block"]):
                block = Block.of(blob)
                own, new = block.new_bytes()
                row = np.flatnonzero(block.more | (block.s > 0))
                yield pd.DataFrame({"c": block.c[row], "back": -block.s[row], "pid": np.int32(pid), "no": no, "row": row, "own": own[row],
                                    "new": new[row], "leaf": block.leaves()[row]})

    values = ["own", "new", "leaf"]
    rows = written(blocks.mapInPandas(single, "c long, back long, pid int, no long, row long, own long, new long, leaf long"), "trie-parts")
    if rows.isEmpty():
        return None
    after = running(rows, "c", [F.col("back")], ["pid", "no", "row", *values], values, "trie-later")
    return after.groupBy("pid", "no").agg(F.collect_list(F.struct("row", *[f"before_{v}" for v in values])).alias("later"))


def _joined_hashes(pieces: DataFrame) -> DataFrame:
    """(depth, p1, p2, whole): SHA-256 of the joined texts of nodes whose ends stand in several blocks, a piece at a time."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, state = None, None
        for b in batches:
            out = []
            for *key, ends in b[["depth", "p1", "p2", "ends"]].itertuples(index=False):
                if key != node:
                    if node is not None:
                        out.append((*node, state.hexdigest()))
                    node, state = key, hashlib.sha256(ends.encode())
                else:
                    state.update(b"," + ends.encode())
            yield pd.DataFrame(out, columns=["depth", "p1", "p2", "whole"])
        if node is not None:
            yield pd.DataFrame([(*node, state.hexdigest())], columns=["depth", "p1", "p2", "whole"])

    return (pieces.where("ends is not null").select("depth", "p1", "p2", "part", "ends").repartition("depth", "p1", "p2")
            .sortWithinPartitions("depth", "p1", "p2", "part").mapInPandas(run, "depth long, p1 long, p2 long, whole string"))


def prefix_trie(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                segment: int = SEGMENT, block_rows: int = BLOCK_ROWS, chunk: int = CHUNK) -> DataFrame:
    """The nodes of the trie over the rebuilt conversations: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256).

    Rows of a null conv_id belong to no conversation and are left out.  Turns go by number, null
    first; rows of one conversation with the same number, repeated rows among them, by the MD5 of
    role and text.  Null roles and texts are empty; very long texts enter by their digest and size.
    Other columns are ignored, whatever their names; an empty table gives an empty result.
    The SHA-256 of a node's ends runs over the joined ids in order, so a node's pieces (one a
    block, of text) pass one task, one at a time.
    """
    spark = conversations.sparkSession
    importable(spark)
    convs, turns = rebuilt(conversations, conv_id, turn, role, text, chunk)
    blocks = written(sorted_blocks(segments(convs, turns, segment), block_rows), "trie-blocks")
    # two keys of at most 16 * segment + 24 bytes for each shuffle partition
    borders = blocks.where("first is not null or last is not null").select("pid", "no", "first", "last").orderBy("pid", "no").collect()
    firsts = [(r["pid"], bytes(r["first"])) for r in borders if r["first"] is not None]
    lasts = [(r["pid"], bytes(r["last"])) for r in borders if r["last"] is not None]
    entry = {p: border_lcp(a, b) for (_, a), (p, b) in zip(lasts, firsts[1:])}
    leave = {p: entry[q] for (p, _), (q, _) in zip(lasts, firsts[1:])}

    def settled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            blobs = []
            for pid, blob in zip(b["pid"].tolist(), b["block"]):
                block = Block.of(blob)
                block.shared = block.shared.copy()
                if block.shared[0] == UNKNOWN:
                    block.shared[0] = entry.get(pid, -1)
                if block.after == UNKNOWN:
                    block.after = leave.get(pid, -1)
                blobs.append(block.arrays())
            yield pd.DataFrame({"pid": b["pid"], "no": b["no"], "block": blobs})

    def nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for pid, no, blob, after in zip(b["pid"], b["no"], b["block"], b["later"]):
                block = Block.of(blob)
                later = np.zeros((len(block), 3), np.int64)
                if after is not None and len(after):
                    found = np.array([(r["row"], r["before_own"], r["before_new"], r["before_leaf"]) for r in after], np.int64)
                    later[found[:, 0]] = found[:, 1:]
                yield _nodes(block, later, f"{pid:08d}-{no:012d}", segment)

    whole = blocks.mapInPandas(settled, "pid int, no long, block binary")
    later = _later(whole)
    of_row = "array<struct<row: bigint, before_own: bigint, before_new: bigint, before_leaf: bigint>>"
    joined = whole.join(later, ["pid", "no"], "left") if later is not None else whole.withColumn("later", F.lit(None).cast(of_row))
    pieces = written(joined.select("pid", "no", "block", "later").mapInPandas(nodes, NODES), "trie-pieces")
    found = pieces.groupBy("depth", "p1", "p2").agg(
        F.min("c").alias("c"), F.first("q1").alias("q1"), F.first("q2").alias("q2"), F.sum("n").alias("n"),
        F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.max("sha").alias("sha"))
    found = written(found.join(_joined_hashes(pieces), ["depth", "p1", "p2"], "left")
                    .withColumn("sha", F.coalesce("whole", "sha", F.lit(NO_ENDS))).drop("whole"), "trie-nodes")
    below = found.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")) \
        .agg(F.count("*").alias("children"))
    found = found.join(below, ["depth", "p1", "p2"], "left")
    parents = found.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("c").alias("parent"))
    smallest = found.where("depth = 0").agg(F.min("c")).first()[0]  # the root's member, for its many children
    top = found.where("depth <= 1").withColumn("parent", F.when(F.col("depth") == 1, F.lit(smallest).cast("long")))
    deep = found.where("depth > 1").join(parents.where("depth > 1"), ["depth", "q1", "q2"], "left")
    return top.unionByName(deep).select(
        F.col("c").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.coalesce("children", F.lit(0)).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.col("sha").alias("ends_sha256"))
