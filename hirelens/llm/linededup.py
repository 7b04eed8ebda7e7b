"""Fuzzy line dedup: SimHash of normalised lines, pigeonhole blocks, edit similarity, connected groups.

Equal normalised lines are one distinct line.  A line's words are cut into four runs of about
the same number, and its fingerprint is the four 64-bit SimHashes of these runs: where up to three
words of a line differ, one of the four blocks is the same (pigeonhole), so lines are joined on
each block with its place and the line's number of words.  Shorter lines, in which fewer edits keep
the similarity, have fewer and longer blocks.  A word more or less moves the blocks; such lines
are also joined on the two least hashes of their pairs of neighbouring words, three in long lines, in
six orders (MinHash),
and if short on the halves of their words.
Pairs of lines that share a list and could be long enough for each other are compared by edit
similarity, 1 - distance / longer length, each pair once.  Connected groups of lines keep one
occurrence: that in the smallest document id, at its first place there.

All pairs of a list are compared only if it is short.  The members of a long list are compared with
one of them, its most frequent line; what that leaves in different groups is then compared
with all members of other groups.  So a list of n similar lines costs about n comparisons, and no
pair that could connect two groups is left out.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from .common import components, importable, key_runs, near_in_runs, shuffle_partitions, without_lines, written

MIN_WORDS = 3  # shorter lines stay: headings, brackets and list marks repeat rightly
CHARS_A_WORD = 5  # characters of scripts written without spaces count as so many to a word
BLOCKS = 4
BANDS = 6
SIMILARITY = 0.9
SHORT_WORDS = 14
LONG_WORDS = 20
SHORT_LIST = 16  # all pairs of a list of at most so many lines are compared at once
BLOCK_LINES, BLOCK_CHARS = 128, 1 << 20  # about so much of a long list meets another block of it in one task
BAND = 511  # pairs that may have more edits are compared one by one
FEW_PAIRS = 24  # also one by one, as single columns of few pairs cost more
_POSTING = np.dtype([("key", "<i8"), ("id", "<i8"), ("size", "<i4"), ("n", "<i4")])  # a line under a key, n of it in a batch
PACKED = 1024  # postings to a row of their shuffle
MOST_PACKED = 1 << 26  # bytes of postings that one task sorts in memory; more go through Spark's sort as single rows
STRIDE = 64
LENGTH_BITS = 24  # longer lines count as of one length before their comparison
# a byte's normal form: letters and bytes of other scripts stay, digits are 0, punctuation and white space a space
_PLAIN = bytes(c if c >= 128 or c == 10 or chr(c).isalpha() else ord("0") if chr(c).isdigit()
               else c if c < 32 and c not in b"\t\v\f\r" else 32 for c in range(256))
# Thai, Lao, Tibetan, Burmese, Khmer, kana, Bopomofo and Han; and the bytes their characters begin with
_UNSPACED = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u312f\u31a0-\u31ff\u3400-\u4dbf\u4e00-\u9fff"
                       "\uf900-\ufaff\uff66-\uff9f\U0001b000-\U0001b16f\U00020000-\U0003ffff]")
_LEADS = np.isin(np.arange(256), [0xE0, 0xE1, *range(0xE3, 0xEA), 0xEF, 0xF0])
CHUNK = 1 << 16  # bytes hashed at a time
GROUP = 1 << 20  # characters of texts normalised together
# 64 random bits for each of 256 bytes at each of 64 places of a word (places repeat in longer words)
_PLACED = np.frombuffer(b"".join(xxhash.xxh64_digest(bytes((p, c)), 7) for p in range(64) for c in range(256)), np.uint64)
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)).view(np.uint64)  # the bits of a byte, one to a byte


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the runs of ``values`` that begin at ``starts``, modulo 2**64, as differences of running sums."""
    total = np.cumsum(values)
    ends = np.append(starts[1:], len(values)) - 1
    out = total[ends]
    out[1:] -= out[:-1].copy()
    return out


def _word_hashes(letters: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hash of each word: the sum of what its bytes stand for at their places; words begin at ``first``."""
    out = np.zeros(len(first), np.uint64)
    for lo in range(0, len(letters), CHUNK):
        hi = min(lo + CHUNK, len(letters))
        a, b = np.searchsorted(first, lo, "right") - 1, np.searchsorted(first, hi, "left")
        at = np.maximum(first[a:b], lo)  # the first word may go on from the last chunk
        place = np.arange(lo, hi) - np.repeat(first[a:b], np.diff(at, append=hi))
        out[a:b] += _sums(_PLACED[(place & 63) << 8 | letters[lo:hi]], at - lo)
    return out


def _majorities(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For runs of ``sizes`` (over 0) hashes: the bits that are set in over half of them, as signed numbers."""
    runs = (sizes + 254) // 255  # of at most 255 hashes, so that no byte of a sum overflows
    first = np.cumsum(runs) - runs
    starts = np.repeat(np.cumsum(sizes) - sizes, runs) + 255 * (np.arange(runs.sum()) - np.repeat(first, runs))
    octets = hashes.view(np.uint8).reshape(-1, 8)
    ones = np.stack([_sums(_SPREAD[octets[:, k]], starts) for k in range(8)], axis=1).view(np.uint8).reshape(-1, 64)
    if len(runs) == len(starts):  # no run was cut
        return np.packbits(ones > (sizes // 2).astype(np.uint8)[:, None], axis=1).view(">i8").ravel().astype(np.int64)
    ones = np.add.reduceat(ones, first, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > sizes[:, None], axis=1).view(">i8").ravel().astype(np.int64)


_MULTIPLIERS = np.frombuffer(b"".join(xxhash.xxh64_digest(bytes((p,)), 11) for p in range(BANDS)), np.uint64) | np.uint64(1)
_LARGEST = np.uint64(2**64 - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def _bands(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, key): six numbers of the two least different hashes of pairs of neighbouring words, or of the three least in a long line.

    More than one, so that lines do not meet for a frequent pair of words.  Lines of a length between have both.
    """
    first = np.cumsum(sizes) - sizes
    before = np.roll(hashes, 1)
    before[first] = 0
    pairs = _mixed(_mixed(before) + hashes)
    few, many = np.flatnonzero(sizes < LONG_WORDS + 3), np.flatnonzero(sizes >= LONG_WORDS)
    keys = []
    for m in _MULTIPLIERS:
        value, least = pairs * m, []
        for _ in range(3):
            least.append(np.minimum.reduceat(value, first))
            value[value == np.repeat(least[-1], sizes)] = _LARGEST
        two = _mixed(_mixed(least[0]) + least[1])
        keys += [two[few], _mixed(two + least[2])[many]]
    return np.concatenate([few, many] * len(_MULTIPLIERS)), np.concatenate(keys)


def _blocks(hashes: np.ndarray, sizes: np.ndarray, edits: np.ndarray, lengths: np.ndarray, with_length: bool) -> tuple[np.ndarray, np.ndarray]:
    """(line, key) of the SimHashes of min(edits + 1, 4) runs of each line's words, with their place and the number of words.

    With one edit in a short line the blocks are few words: the keys then have the line's length too,
    and that plus one, so that lines meet whose lengths differ by one.
    """
    parts = np.minimum(edits + 1, BLOCKS)
    of_line, keys = [], []
    for n in range(2, BLOCKS + 1):
        pick = parts == n
        if not pick.any():
            continue
        lines, size = np.flatnonzero(pick), sizes[pick]
        cuts = np.arange(n + 1)[None, :] * size[:, None] // n
        runs = np.diff(cuts, axis=1).ravel()
        full = runs > 0
        sims = _majorities(hashes[np.repeat(pick, sizes)], runs[full]).view(np.uint64)
        line = np.repeat(lines, n)[full]
        place = np.tile(np.arange(n), len(lines))[full].astype(np.uint64)
        shape = _mixed(np.uint64(8 * n) + place + (sizes[line].astype(np.uint64) << np.uint64(8)))
        key = _mixed(_mixed(sims) + shape)
        if with_length and n == 2:
            for more in (0, 1):
                of_line.append(line)
                keys.append(_mixed(key + (lengths[line] + more).astype(np.uint64)))
        else:
            of_line.append(line)
            keys.append(key)
    none = np.zeros(0, np.int64)
    return (np.concatenate(of_line), np.concatenate(keys)) if keys else (none, none.view(np.uint64))


def _halves(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, key) of the first and the last half of the words of short lines, as of lines of so many words and of one word fewer.

    Where a line has one word more than another, both halves of the shorter one cannot be changed.
    """
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(hashes), dtype=np.uint64)])
    first = np.cumsum(sizes) - sizes
    of_line, keys = [], []
    for fewer in (0, 1):
        line = np.flatnonzero((sizes <= SHORT_WORDS) & (sizes > 1 + fewer))
        words = sizes[line] - fewer
        half, start, end = (words + 1) // 2, first[line], first[line] + sizes[line]
        for side, own in ((1, total[start + half] - total[start]), (2, total[end] - total[end - half])):
            of_line.append(line)
            keys.append(_mixed(_mixed(own) + (words * 4 + side).astype(np.uint64)))
    return np.concatenate(of_line), np.concatenate(keys)


def line_keys(hashes: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(line, key), by line: what lines of ``sizes`` words (over 0) and ``lengths`` characters are joined on.

    A line in which no edit keeps the similarity has no keys.  A line that is short for its number
    of edits also has the blocks of the next longer lines, which it may be similar to.
    """
    edits = _edits(lengths, similarity)
    more = _edits(lengths + edits + 1, similarity)
    own = _blocks(hashes, sizes, edits, lengths, True)
    longer = _blocks(hashes, sizes, np.where(np.minimum(more, BLOCKS - 1) > np.minimum(edits, BLOCKS - 1), more, 0), lengths, True)
    line, key = (np.concatenate(x) for x in zip(_halves(hashes, sizes), _bands(hashes, sizes)))
    wanted = more[line] > 0
    line = np.concatenate([own[0], longer[0], line[wanted]])
    key = np.concatenate([own[1], longer[1], key[wanted]])
    order = np.argsort(line, kind="stable")
    return line[order], key[order]


def _edits(lengths: np.ndarray, similarity: float) -> np.ndarray:
    """How many edits a line of these lengths may have."""
    return ((1 - similarity) * lengths + 1e-9).astype(np.int64)


def line_prints(text: str, similarity: float = SIMILARITY) -> tuple[list[bytes], np.ndarray, np.ndarray, list[np.ndarray]]:
    """Each line's normal form, number of words, number of characters and keys.

    Normal: lower case, ASCII punctuation as spaces, digits as 0, single spaces between words.
    Words of scripts without spaces are estimated by their characters, and their features are trigrams.
    """
    data = np.frombuffer(text.lower().encode("utf-8", "replace").translate(_PLAIN), np.uint8)
    newline, kept = data == 10, data != 32
    inside = kept & ~newline
    bounded = np.zeros(len(inside) + 2, bool)
    bounded[1:-1] = inside
    edges = np.flatnonzero(bounded[1:] != bounded[:-1])
    starts, ends = edges[::2], edges[1::2]
    bounds = np.concatenate([[0], np.searchsorted(starts, np.flatnonzero(newline)), [len(starts)]])
    sizes = np.diff(bounds)
    full = np.flatnonzero(sizes)
    later = np.ones(len(starts), bool)
    later[bounds[full]] = False
    kept[starts[later] - 1] = True  # one space before each word but a line's first
    plain = data[kept]
    lines = plain.tobytes().split(b"\n")
    stops = np.append(np.flatnonzero(plain == 10), len(plain))
    lengths = np.diff(stops, prepend=-1) - 1
    lengths -= np.diff(np.searchsorted(np.flatnonzero((plain & 0xC0) == 0x80), stops), prepend=0)  # less all but a character's first byte
    keys = [np.zeros(0, np.uint64)] * len(sizes)
    if len(starts):
        widths = ends - starts
        hashes = _word_hashes(data[inside], np.cumsum(widths) - widths)
        line, key = line_keys(hashes, sizes[full], lengths[full], similarity)
        cuts = np.searchsorted(line, np.arange(len(full) + 1)).tolist()
        for k, x in enumerate(full.tolist()):
            keys[x] = key[cuts[k]:cuts[k + 1]]
    if _LEADS[data].any():
        for k, x in enumerate(lines):
            if sizes[k] and not x.isascii() and (unspaced := len(_UNSPACED.findall(x.decode()))):
                found = features(x.decode())
                sizes[k] = max(sizes[k], sum(not _UNSPACED.search(w) for w in x.decode().split(" ")) + unspaced // CHARS_A_WORD)
                widths = np.array([len(f) for f in found])
                hashes = _word_hashes(np.frombuffer(b"".join(found), np.uint8), np.cumsum(widths) - widths)
                keys[k] = line_keys(hashes, np.array([len(found)]), lengths[k:k + 1], similarity)[1]
    return lines, sizes, lengths, keys


def features(norm: str) -> list[bytes]:
    """The words of a normal form; for a word with characters of a script without spaces its character trigrams."""
    out = []
    for w in norm.split(" "):
        out += [w[k:k + 3] for k in range(max(1, len(w) - 2))] if _UNSPACED.search(w) else [w]
    return [w.encode() for w in out]


def normalise(line: str) -> str:
    """A line's words with single spaces between."""
    return b" ".join(line.lower().encode("utf-8", "replace").translate(_PLAIN).split()).decode()


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance by bit vectors (one machine-word column update per character of ``b``)."""
    start = 0
    shorter = min(len(a), len(b))
    while start < shorter and a[start] == b[start]:
        start += 1
    end = 0
    while end < shorter - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start:len(a) - end], b[start:len(b) - end]
    if not a or not b:
        return len(a) + len(b)
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    top = 1 << len(a) - 1
    plus, minus, distance = full, 0, len(a)
    for c in b:
        match = where.get(c, 0)
        vertical = match | minus
        across = (((match & plus) + plus) ^ plus) | match
        up, down = minus | (full & ~(across | plus)), plus & across
        distance += (up & top != 0) - (down & top != 0)
        up, down = (up << 1 | 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(vertical | up)), up & vertical
    return distance


# words left out on each side where an alignment may go on, nearest first
_SKIPS = sorted(((p, q) for p in range(5) for q in range(5) if p or q), key=lambda x: (max(x), x[0] != x[1]))


def at_most(a: str, b: str, limit: int) -> int:
    """An upper bound of the edit distance by a greedy alignment of words; over ``limit`` if none is found."""
    x, y, i, j, cost = a.split(" "), b.split(" "), 0, 0, 0
    while i < len(x) and j < len(y) and cost <= limit:
        if x[i] == y[j]:
            i, j = i + 1, j + 1
            continue
        for p, q in _SKIPS:
            if x[i + p:i + p + 2] == y[j + q:j + q + 2]:
                break
        else:
            return limit + 1
        # a word counts with the space after it
        cost += max(p + sum(map(len, x[i:i + p])), q + sum(map(len, y[j:j + q])))
        i, j = i + p, j + q
    return cost + sum(len(w) + 1 for w in x[i:]) + sum(len(w) + 1 for w in y[j:])


def at_least(a: str, b: str, limit: int, piece: int) -> int:
    """A lower bound of the edit distance, if that is at most ``limit``; else the bound may pass ``limit``.

    An edit changes one piece of ``a`` at most, and up to ``limit`` edits shift the others by no more.
    """
    missing = 0
    for k in range(0, len(a) - piece + 1, piece):
        if b.find(a[k:k + piece], max(0, k - limit), k + piece + limit) < 0:
            missing += 1
            if missing > limit:
                break
    return missing


def similar(a: str, b: str, least: float) -> bool:
    """Whether 1 - edit distance / longer length is at least ``least``; the distance is counted where its bounds leave it open."""
    longer = max(len(a), len(b))
    limit = int((1 - least) * longer + 1e-9)
    if abs(len(a) - len(b)) > limit:
        return False
    if at_most(a, b, limit) <= limit:
        return True
    piece = max(1, int(0.5 / max(1 - least, 1e-9)))
    return at_least(a, b, limit, piece) <= limit and edit_distance(a, b) <= limit


def _codes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of all lines as numbers, none of them one of the two largest of their type; and where each line begins."""
    points = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32)
    top = int(points.max(initial=0)) + 2
    starts = np.cumsum([0, *map(len, lines)])
    return points.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32), starts


def _cut(codes: np.ndarray, first: np.ndarray, size: np.ndarray, width: int, other: int, ahead: np.ndarray | int = 0) -> np.ndarray:
    """Rows of ``width`` codes: ``size`` of them from ``first`` on, after ``ahead`` places; elsewhere the type's largest number less ``other``."""
    at = np.arange(width) - np.broadcast_to(ahead, first.shape)[:, None]
    inside = (at >= 0) & (at < size[:, None])
    return np.where(inside, codes[np.where(inside, first[:, None] + at, 0)], np.iinfo(codes.dtype).max - other).astype(codes.dtype)


def _common(codes: np.ndarray, x: np.ndarray, y: np.ndarray, size: np.ndarray, step: int) -> np.ndarray:
    """How many codes from x and y on (backwards with step -1), up to ``size``, are equal."""
    same, going = np.zeros(len(x), np.int64), np.arange(len(x))
    while len(going):
        at = same[going][:, None] + np.arange(STRIDE)
        inside = at < size[going][:, None]
        one, two = (codes[np.where(inside, start[going][:, None] + step * at, 0)] for start in (x, y))
        equal = inside & (one == two)
        run = np.where(equal.all(axis=1), STRIDE, equal.argmin(axis=1))
        same[going] += run
        going = going[run == STRIDE]
    return same


def _in_band(codes: np.ndarray, x: np.ndarray, m: np.ndarray, y: np.ndarray, n: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Whether the edit distance of codes [x, x + m) and [y, y + n), n <= m <= n + limit, is at most ``limit``, for many pairs at once.

    Bit-parallel columns (Hyyro 2003) of the diagonals which a path of so few edits can reach; the
    cost is followed along the diagonal of the last cell, on which it never falls.
    """
    delta = m - n
    above = (limit - delta) // 2
    kind = next((t for t in (np.uint16, np.uint32) if limit.max(initial=0) < 8 * t().itemsize), np.uint64)  # no wider than the band
    bits, one_bit = 8 * kind().itemsize, kind(1)
    words = int(limit.max(initial=0)) // bits + 1
    good = np.zeros(len(x), bool)
    left, pattern, text = np.arange(len(x)), _cut(codes, x, m, int(n.max(initial=0)) + bits * words, 0, above), _cut(codes, y, n, int(n.max(initial=0)), 1)
    word = np.arange(words)[:, None]
    # rows over 0 of the first column: bit r stands for row 1 - above + r
    plus = np.where(above >= bits * (word + 1), kind(0), ~kind(0) << np.clip(above - bits * word, 0, bits - 1).astype(kind))
    minus, cost = np.zeros_like(plus), delta.copy()
    for c in range(text.shape[1] + 1):
        if c % 16 == 0 or c == text.shape[1]:
            ended = n[left] <= c
            good[left[ended & (cost <= limit[left])]] = True
            keep = ~ended & (cost <= limit[left])
            if not keep.any():
                break
            if not keep.all():
                left, pattern, text, plus, minus, cost = left[keep], pattern[keep], text[keep], plus[:, keep], minus[:, keep], cost[keep]
            ends, bit_word, bit = n[left], (above + delta)[left] // bits, ((above + delta)[left] % bits).astype(kind)
            rows = np.arange(len(left))
        match = np.packbits(pattern[:, c:c + bits * words] == text[:, c:c + 1], axis=1, bitorder="little").view(np.dtype(kind).newbyteorder("<")).T
        diagonal, carry = np.empty_like(plus), np.zeros(len(left), kind)
        for w in range(words):
            one = match[w] & plus[w]
            total = one + plus[w]
            over = total < one
            total += carry
            carry = (over | (total < carry)).astype(kind)
            diagonal[w] = (total ^ plus[w]) | match[w] | minus[w]
        up, down = minus | ~(diagonal | plus), diagonal & plus
        cost += ((diagonal[bit_word, rows] >> bit & one_bit) == 0) & (ends > c)
        later = diagonal >> one_bit
        later[:-1] |= diagonal[1:] << kind(bits - 1)
        plus, minus = down | ~(later | up), later & up
    return good


def similar_pairs(lines: list[str], a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """``similar`` of lines a and b of many pairs."""
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    limit = _edits(np.maximum(lengths[a], lengths[b]), least)
    good = np.zeros(len(a), bool)
    possible = np.abs(lengths[a] - lengths[b]) <= limit
    alone = np.flatnonzero(possible & (limit > BAND))
    good[alone] = [similar(lines[p], lines[q], least) for p, q in zip(a[alone].tolist(), b[alone].tolist())]
    todo = np.flatnonzero(possible & (limit <= BAND))
    if len(todo) < FEW_PAIRS:
        good[todo] = [similar(lines[p], lines[q], least) for p, q in zip(a[todo].tolist(), b[todo].tolist())]
        return good
    codes, starts = _codes(lines)
    longer = lengths[a] >= lengths[b]
    p, q = np.where(longer, a, b), np.where(longer, b, a)
    for lo in range(0, len(todo), 1 << 14):
        pick = todo[lo:lo + (1 << 14)]
        x, y, m, n = starts[p[pick]], starts[q[pick]], lengths[p[pick]], lengths[q[pick]]
        begin = _common(codes, x, y, n, 1)
        end = _common(codes, x + m - 1, y + n - 1, n - begin, -1)
        x, y, m, n = x + begin, y + begin, m - begin - end, n - begin - end
        most = limit[pick]
        good[pick[m <= most]] = True  # what differs could all be replaced
        # pairs of about one size and band together, as many as some millions of places hold
        bands = (most >= 32) + most // 64
        for band in np.unique(bands[m > most]).tolist():
            order = np.flatnonzero((m > most) & (bands == band))
            if len(order) < FEW_PAIRS:
                one, two = pick[order].tolist(), order.tolist()
                good[one] = [edit_distance(lines[a[k]], lines[b[k]]) <= most[i] for k, i in zip(one, two)]
                continue
            order = order[np.argsort(n[order], kind="stable")]
            while len(order):
                width = n[order] + 64 * (most[order] // 64 + 1)
                many = max(1, int(np.searchsorted(np.arange(1, len(order) + 1) * np.maximum.accumulate(width), 1 << 21, "right")))
                now, order = order[:many], order[many:]
                good[pick[now]] = _in_band(codes, x[now], m[now], y[now], n[now], most[now])
    return good


def _with_lines(docs: DataFrame, text: str, min_words: int, similarity: float) -> DataFrame:
    """``docs`` with __row, __hash (of each line; null: never removed), and of the lines with a hash: __shape (number of keys and
    length) and __keys, one after another."""

    def of_texts(texts: list[str]) -> Iterator[tuple[list, bytes, bytes]]:
        """The columns of each text; texts go through together up to a size, as single short ones cost more."""
        lines, words, lengths, keys = line_prints("\n".join(texts), similarity)
        fit = words >= min_words
        hashes = [xxhash.xxh128_digest(x) if ok else None for x, ok in zip(lines, fit.tolist())]
        shapes = np.stack([np.array([len(k) for k in keys]), np.minimum(lengths, (1 << LENGTH_BITS) - 1)], axis=1).astype(np.int32)
        at = 0
        for t in texts:
            end = at + t.count("\n") + 1
            own = fit[at:end]
            yield hashes[at:end], shapes[at:end][own].tobytes(), b"".join([k.tobytes() for k, ok in zip(keys[at:end], own.tolist()) if ok])
            at = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, group, size = [], [], 0
            for t in batch.column(place):
                t = t.as_py() or ""
                if group and size + len(t) > GROUP:
                    found += of_texts(group)
                    group, size = [], 0
                group.append(t)
                size += len(t)
            found += of_texts(group) if group else []
            hashes, shapes, keys = ([x[k] for x in found] for k in range(3))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(hashes, pa.list_(pa.binary())), pa.array(shapes, pa.binary()), pa.array(keys, pa.binary())],
                names=[*batch.schema.names, "__hash", "__shape", "__keys"])

    # one shuffle of the texts by row; the joins by row to come then find them in buckets and move only their other side
    n = shuffle_partitions(docs.sparkSession)
    rows = docs.withColumn("__row", F.monotonically_increasing_id()).repartition(n, "__row")
    place = docs.columns.index(docs.select(F.col(text)).columns[0])
    schema = T.StructType([*rows.schema.fields, T.StructField("__hash", T.ArrayType(T.BinaryType())), T.StructField("__shape", T.BinaryType()),
                           T.StructField("__keys", T.BinaryType())])
    return _bucketed(rows.mapInArrow(run, schema), "__row", n, "lines-base")


def _bucketed(df: DataFrame, key: str, n: int, name: str) -> DataFrame:
    """``df`` written into the shared checkpoint folder in ``n`` buckets of ``key`` and read again."""
    spark = df.sparkSession
    importable(spark)
    table = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    df.write.bucketBy(n, key).option("compression", "zstd").option("path", scratch_path(spark, name)).format("parquet").saveAsTable(table)
    read = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # only its name: the files stay, and ``read`` knows them and their buckets
    return read


def _posted(base: DataFrame) -> DataFrame:
    """(bucket, postings): each line under its keys, equal lines of a batch once; a line's id is the half of its hash.

    The postings of a bucket of keys go through the shuffle as arrays, up to ``PACKED`` in a row.
    """
    buckets = 4 * shuffle_partitions(base.sparkSession)

    def packed(rows: np.ndarray) -> pa.RecordBatch:
        bucket = (_mixed(rows["key"].view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        rows, bucket = rows[order], bucket[order]
        own = np.r_[True, bucket[1:] != bucket[:-1]]
        inside = np.arange(len(rows)) - np.maximum.accumulate(np.where(own, np.arange(len(rows)), 0))
        starts = np.flatnonzero(inside % PACKED == 0)
        data = rows.tobytes()
        offsets = pa.py_buffer((np.append(starts, len(rows)) * _POSTING.itemsize).astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(bucket[starts]), pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, offsets, pa.py_buffer(data)])],
                                          names=["bucket", "postings"])

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column(0).flatten().drop_null().to_pylist()
            ids = np.frombuffer(b"".join(hashes), ">i8")[::2].astype(np.int64)
            shapes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int32).reshape(-1, 2)
            keys = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int64)
            number, size = shapes[:, 0].astype(np.int64), shapes[:, 1]
            _, first, count = np.unique(ids, return_index=True, return_counts=True)
            starts = np.cumsum(number) - number
            n = number[first]
            at = np.repeat(starts[first] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            rows = np.empty(len(at), _POSTING)
            rows["key"], rows["id"], rows["size"] = keys[at], np.repeat(ids[first], n), np.repeat(size[first], n)
            rows["n"] = np.repeat(np.minimum(count, 1 << 30), n)
            for lo in range(0, len(rows), 1 << 20):
                yield packed(rows[lo:lo + (1 << 20)])

    return base.select("__hash", "__shape", "__keys").mapInArrow(post, "bucket int, postings binary")


def _candidates(base: DataFrame, similarity: float) -> DataFrame:
    """(key, a, b, size): pairs a < b of a short list, or of a long one's first member and any other.

    Members of long lists also come as rows without b.  A task sorts its postings in memory; what is
    too much for that, as a list of very many lines, is dealt out again and sorted by Spark.
    """
    def close(size):
        return lambda i, j: np.abs(size[i] - size[j]) <= _edits(np.maximum(size[i], size[j]).astype(np.int64), similarity)

    def output(key, a, b, size, frequent) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) if x is not None else pa.nulls(len(a), t) for x, t in (
            (key, pa.int64()), (a, pa.int64()), (b, pa.int64()), (size, pa.int32()), (frequent, pa.int32()))],
            names=["key", "a", "b", "size", "frequent"])

    def met(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(rows["key"])
        key = rows["key"][order]
        again = key[1:] == key[:-1]
        rows = rows[order[np.r_[False, again] | np.r_[again, False]]]  # the others are alone under their key
        if not len(rows):
            return
        rows = rows[np.lexsort((rows["id"], rows["key"]))]
        key, ids = rows["key"], rows["id"]
        first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])])
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        number = np.repeat(np.diff(np.append(starts, len(key))), np.diff(np.append(starts, len(key))))[first]
        count, key, ids, size = np.add.reduceat(rows["n"].astype(np.int64), first), key[first], ids[first], rows["size"][first]
        short, many = number <= SHORT_LIST, number > SHORT_LIST
        some, some_size = ids[short], size[short]
        i, j = near_in_runs(key[short], len(some), close(some_size))
        a, b = some[i], some[j]
        if many.any():
            key, ids, size, count = key[many], ids[many], size[many], count[many]
            order = np.lexsort((ids, -count, key))
            key, ids, size = key[order], ids[order], size[order]
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            hub = np.repeat(starts, np.diff(np.append(starts, len(key))))
            yield output(key, ids, None, size, None)
            j = np.flatnonzero((np.arange(len(key)) != hub) & close(size)(np.arange(len(key)), hub))
            a, b = np.append(a, ids[j]), np.append(b, ids[hub[j]])
        if len(a):
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            yield output(None, pairs[:, 0], pairs[:, 1], None, None)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, over = [], 0, False
        for batch in batches:
            for x in batch.column(1):
                held.append(x.as_py())
                size += len(held[-1])
                if size > MOST_PACKED or over and size > PACKED * _POSTING.itemsize:
                    rows = np.frombuffer(b"".join(held), _POSTING)
                    held, size, over = [], 0, True
                    for lo in range(0, len(rows), 1 << 16):
                        x = rows[lo:lo + (1 << 16)]
                        yield output(x["key"], x["id"], None, x["size"], -x["n"])
        if held:
            rows = np.frombuffer(b"".join(held), _POSTING)
            if over:
                yield output(rows["key"], rows["id"], None, rows["size"], -rows["n"])
            else:
                yield from met(rows)

    def ordered(key, a, b):
        return pd.DataFrame({"key": key, "a": np.minimum(a, b), "b": pd.array(np.maximum(a, b), dtype="Int64"), "size": 0})

    def meet_sorted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hub_key, hub, hub_size = None, None, None
        for frame, whole in key_runs(batches, "key", SHORT_LIST):
            keys, ids, size = (frame[c].to_numpy() for c in ("key", "id", "size"))
            if whole:
                i, j = near_in_runs(keys, len(ids), close(size))
                differ = ids[i] != ids[j]
                i, j = i[differ], j[differ]
                yield ordered(keys[i], ids[i], ids[j])
                continue
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            for at, end in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)]):
                if keys[at] != hub_key:
                    hub_key, hub, hub_size = keys[at], ids[at], size[at]
                own, own_size = ids[at:end], size[at:end]
                yield pd.DataFrame({"key": hub_key, "a": own, "b": pd.array([None] * len(own), dtype="Int64"), "size": own_size})
                near = (own != hub) & (np.abs(own_size - hub_size) <= _edits(np.maximum(own_size, hub_size).astype(np.int64), similarity))
                yield ordered(np.full(near.sum(), hub_key), own[near], np.full(near.sum(), hub))

    n, fields = shuffle_partitions(base.sparkSession), "key long, a long, b long, size int"
    found = written(_posted(base).repartition(n, "bucket").mapInArrow(meet, fields + ", frequent int"), "lines-candidates")
    done, rest = found.where("frequent is null").drop("frequent"), found.where("frequent is not null")
    if rest.isEmpty():
        return done
    rest = rest.select("key", "frequent", F.col("a").alias("id"), "size").repartition(n, "key").sortWithinPartitions("key", "frequent", "id")
    return done.unionByName(written(rest.mapInPandas(meet_sorted, fields), "lines-candidates"))


def _letters(norm: str) -> np.ndarray:
    """How often characters of 32 classes stand in a line, up to 65535 each."""
    points = np.frombuffer(norm.encode() if norm.isascii() else norm.encode("utf-32-le"), np.uint8 if norm.isascii() else np.uint32)
    return np.minimum(np.bincount(points & 31, minlength=32), 65535).astype(np.int32)


def _classes(lines: list[str]) -> np.ndarray:
    """``_letters`` of many lines, short ones together."""
    out, lo, size = np.zeros((len(lines), 32), np.int32), 0, 0
    for k, x in enumerate(lines):
        size += len(x)
        if size < GROUP and k + 1 < len(lines):
            continue
        codes, starts = _codes(lines[lo:k + 1])
        row = np.repeat(np.arange(k + 1 - lo) * 32, np.diff(starts))
        out[lo:k + 1] = np.minimum(np.bincount(row + (codes & 31), minlength=32 * (k + 1 - lo)), 65535).reshape(-1, 32)
        lo, size = k + 1, 0
    return out


def _letters_allow(a: pd.Series, b: pd.Series, limit: np.ndarray) -> np.ndarray:
    """Whether so few edits could make one line's characters the other's: an edit adds one to a class at most, and takes one."""
    x, y = (np.concatenate([np.zeros(0, np.int32), *s]).reshape(-1, 32) for s in (a, b))
    more = x - y
    return (np.maximum(more, 0).sum(axis=1) <= limit) & (np.maximum(-more, 0).sum(axis=1) <= limit)


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between lines, by their whole hashes, of the pairs (a, b) of ids whose texts are similar."""
    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            lines, n = [*x["p"], *x["q"]], np.arange(len(x))
            classes, lengths = _classes(lines), np.fromiter(map(len, lines), np.int64, len(lines))
            n = n[np.abs(lengths[n] - lengths[n + len(x)]) <= _edits(np.maximum(lengths[n], lengths[n + len(x)]), similarity)]
            n = n[_letters_allow(classes[n], classes[n + len(x)], _edits(np.maximum(lengths[n], lengths[n + len(x)]), similarity))]
            # most are similar, by an alignment that is cheaper than their distance
            limit = _edits(np.maximum(lengths[n], lengths[n + len(x)]), similarity)
            sure = np.array([at_most(lines[k], lines[k + len(x)], most) <= most for k, most in zip(n.tolist(), limit.tolist())], bool)
            left = n[~sure]
            good = np.append(n[sure], left[similar_pairs(lines, left, left + len(x), similarity)])
            yield x.iloc[good][["ha", "hb"]].rename(columns={"ha": "a", "hb": "b"})

    left = texts.select(F.col("id").alias("a"), F.col("h").alias("ha"), F.col("norm").alias("p"))
    right = texts.select(F.col("id").alias("b"), F.col("h").alias("hb"), F.col("norm").alias("q"))
    return pairs.join(left, "a").join(right, "b") \
        .select("ha", "hb", "p", "q").mapInPandas(verify, "a binary, b binary")


def _across(lists: DataFrame, texts: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between groups whose lines are similar and share a long list.

    Every member outside the largest group of its list meets all members of other groups: the list is
    cut into blocks by a hash, and each pair of blocks that has such members is a small task of its
    own.  Lines of several common lists are compared in that of the least key only.
    """
    named = texts.select("id", "h").join(roots.select(F.col("node").alias("h"), "root"), "h", "left") \
        .select("id", F.coalesce("root", "h").alias("grp"))
    members = written(lists.distinct().join(named, "id"), "lines-long-lists")
    sizes = members.groupBy("key", "grp").agg(F.count("*").alias("n"), F.sum(F.col("size").cast("long")).alias("chars"))
    most = F.struct("n", "grp")
    several = sizes.groupBy("key").agg(F.max_by("grp", most).alias("main"), F.sum("n").alias("n"), F.sum("chars").alias("chars"),
                                       F.max_by("chars", most).alias("main_chars"), F.max("n").alias("main_n"), F.count("*").alias("groups"))

    def blocks(n, chars):
        return F.greatest(F.ceil(n / BLOCK_LINES), F.ceil(chars / BLOCK_CHARS)).cast("int")

    several = written(several.where("groups > 1").select("key", "main", blocks(F.col("n") - F.col("main_n"), F.col("chars") - F.col("main_chars")).alias("stray"),
                                                         blocks(F.col("main_n"), F.col("main_chars")).alias("rest")), "lines-split-lists")
    mixed = written(members.join(several, "key"), "lines-split-members")
    shared = mixed.groupBy("id").agg(F.collect_list("key").alias("keys"))
    own, all_blocks = F.col("grp") != F.col("main"), F.col("stray") + F.col("rest")
    block = F.when(own, F.pmod(F.xxhash64("id"), F.col("stray"))).otherwise(F.col("stray") + F.pmod(F.xxhash64("id"), F.col("rest"))).cast("int")
    meets = F.explode(F.sequence(F.lit(0), F.when(own, all_blocks).otherwise(F.col("stray")) - 1))
    tasks = mixed.select("key", "id", "grp", block.alias("block"), meets.alias("other")) \
        .select("key", "id", "grp", "block", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two")) \
        .join(shared, "id").join(texts.select("id", "norm"), "id")

    def pairs(frame: pd.DataFrame, classes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of the pairs in each run of equal tasks that lengths and characters leave open."""
        group, block, key = pd.factorize(frame["grp"])[0], frame["block"].to_numpy(), frame["key"].to_numpy()
        sizes = frame["norm"].str.len().to_numpy(np.int64)
        number, keys = frame["keys"].str.len().to_numpy(np.int64), np.concatenate(frame["keys"].to_list())
        first = np.cumsum(number) - number
        of_task = frame[["task", "key", "one", "two"]].to_numpy(np.int64)
        starts = np.flatnonzero(np.r_[True, (of_task[1:] != of_task[:-1]).any(axis=1)])
        for at, end in zip(starts.tolist(), [*starts[1:].tolist(), len(frame)]):
            inside = block[at] == frame["one"].iat[at] == frame["two"].iat[at]
            cut = at if inside else at + int(np.searchsorted(block[at:end], block[at], "right"))
            a, b = (x.ravel() for x in np.meshgrid(np.arange(at, end if inside else cut), np.arange(cut, end), indexing="ij"))
            limit = _edits(np.maximum(sizes[a], sizes[b]), similarity)
            open_ = (group[a] != group[b]) & (np.abs(sizes[a] - sizes[b]) <= limit)
            if inside:
                open_ &= a < b
            a, b, limit = a[open_], b[open_], limit[open_]
            # the lines' lesser keys, one column each
            row, lesser = np.repeat(np.arange(end - at), number[at:end]), keys[first[at]:first[end - 1] + number[end - 1]]
            row, lesser = row[lesser < key[at]], lesser[lesser < key[at]]
            if len(row):
                found, column = np.unique(lesser, return_inverse=True)
                has = np.zeros((end - at, len(found)), np.float32)
                has[row, column] = 1
                here = (has @ has.T)[a - at, b - at] == 0
                a, b, limit = a[here], b[here], limit[here]
            for lo in range(0, len(a), 1 << 14):
                x, y = a[lo:lo + (1 << 14)], b[lo:lo + (1 << 14)]
                more = classes[x] - classes[y]
                fit = (np.maximum(more, 0).sum(axis=1) <= limit[lo:lo + (1 << 14)]) & (np.maximum(-more, 0).sum(axis=1) <= limit[lo:lo + (1 << 14)])
                yield x[fit], y[fit]

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, _ in key_runs(batches, "task", 1 << 62):
            frame = frame.reset_index(drop=True)
            lines = frame["norm"].to_list()
            classes = _classes(lines)
            found = list(pairs(frame, classes))
            a, b = (np.concatenate([np.zeros(0, np.int64), *[x[k] for x in found]]) for k in range(2))
            good = similar_pairs(lines, a, b, similarity)
            grp = frame["grp"].to_numpy()
            yield pd.DataFrame({"a": grp[a[good]], "b": grp[b[good]]}).drop_duplicates()

    n = shuffle_partitions(texts.sparkSession)
    return tasks.withColumn("task", F.xxhash64("key", "one", "two")).repartition(n, "task").sortWithinPartitions("task", "key", "one", "two", "block") \
        .mapInPandas(meet, "a binary, b binary")


def _texts(base: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """(id, h, norm): the normalised text of each wanted line (h, __row), each document split once."""
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hs, norms = [], []
            for t, hashes, want in zip(*(batch.column(k).to_pylist() for k in range(3))):
                left = set(want)
                for line, h in zip(t.split("\n"), hashes):
                    if h in left:
                        left.remove(h)
                        hs.append(h)
                        norms.append(normalise(line))
            ids = np.frombuffer(b"".join(hs), ">i8")[::2].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(hs, pa.binary()), pa.array(norms, pa.string())], names=["id", "h", "norm"])

    by_row = wanted.groupBy("__row").agg(F.collect_list("h").alias("want"))
    rows = base.select("__row", F.col(text).alias("t"), "__hash").join(by_row.hint("shuffle_hash"), "__row")
    return written(rows.select("t", "__hash", "want").mapInArrow(pick, "id long, h binary, norm string"), "lines-texts")


def _half(h: str):
    """A line's id: the first 64 bits of its hash."""
    return F.conv(F.hex(F.substring(h, 1, 8)), 16, -10).cast("long")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, similarity: float = SIMILARITY,
                counts: str = "lines", places: str = "lines_removed") -> DataFrame:
    """``docs`` with ``text`` without its repeated lines, and columns ``counts`` (number of lines) and ``places`` (those removed, from 0).

    Ids are whole numbers; lines of a null id come after all others, repeated ids (ties) in row
    order.  Null texts stay null, and empty texts and lines without words stay as they are; very
    long texts and lines are compared whole; repeated rows lose all lines but in the first.  Other
    columns are kept, but one named as ``counts`` or ``places`` is replaced; an empty table gives
    an empty result.
    """
    base = _with_lines(docs, text, min_words, similarity)
    whole = "decimal(38,0)"
    # documents in the order of their ids, then rows: one number, so that the first place is a plain minimum
    place = (F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).cast("decimal(19,0)") * F.lit(10**18).cast("decimal(19,0)")
             + F.pmod(F.col("__row"), F.lit(10**18))).cast(whole)
    lines = base.select("__row", place.alias("place"), "__hash").select("__row", "place", F.posexplode("__hash").alias("at", "h")).where("h is not null")
    met = _candidates(base, similarity)
    pairs = written(met.where("b is not null").select("a", "b").distinct(), "lines-pairs")
    lists = met.where("b is null").select("key", F.col("a").alias("id"), "size")
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).unionByName(lists.select("id")).distinct()
    # of the distinct lines only those that repeat or are compared are written
    every = lines.groupBy("h").agg(F.count("*").alias("n"), F.min("place").alias("place"), F.min("__row").alias("row")).withColumn("id", _half("h"))
    distinct = written(every.join(ids.withColumn("met", F.lit(True)), "id", "left").where("n > 1 or met").drop("id"), "lines-distinct")
    texts = _texts(base, text, distinct.where("met").select("h", F.col("row").alias("__row")))
    links = written(_verified(pairs, texts, similarity), "lines-links")
    roots = components(links, "lines")
    if not lists.isEmpty():
        across = written(_across(lists, texts, roots, similarity), "lines-across")
        if not across.isEmpty():
            merged = components(across, "lines-groups").select(F.col("node").alias("grp"), F.col("root").alias("to"))
            single = merged.join(roots.select(F.col("node").alias("grp")), "grp", "left_anti").select(F.col("grp").alias("node"), F.col("to").alias("root"))
            roots = roots.withColumnRenamed("root", "grp").join(merged, "grp", "left").select("node", F.coalesce("to", "grp").alias("root")).unionByName(single)
    grouped = roots.select(F.col("node").alias("h"), "root").join(distinct.select("h", "place"), "h")
    owners = grouped.groupBy("root").agg(F.min("place").alias("owner"))
    several = grouped.select("h", "root").join(owners, "root").select("h", F.col("root").alias("grp"), "owner")
    alone = distinct.where("n > 1").join(roots.select(F.col("node").alias("h")), "h", "left_anti") \
        .select("h", F.col("h").alias("grp"), F.col("place").alias("owner"))
    owned = written(several.unionByName(alone), "lines-owned")
    of_group = (lines.join(owned, "h").groupBy("__row", "grp")
                .agg(F.max(F.col("owner") == F.col("place")).alias("mine"), F.min("at").alias("first"), F.collect_list("at").alias("all")))
    gone = F.when(F.col("mine"), F.array_remove("all", F.col("first"))).otherwise(F.col("all"))
    removed = written(of_group.groupBy("__row").agg(F.array_sort(F.flatten(F.collect_list(gone))).alias("__gone")), "lines-removed")
    own = [F.col(f"`{c}`") for c in docs.columns if c != text and c.lower() not in (counts.lower(), places.lower())]
    # joined to the buckets at any size: what would be broadcast here grows with the input
    counted = base.withColumn("__lines", F.size("__hash")).drop("__hash", "__shape", "__keys")
    joined = counted.join(removed.hint("shuffle_hash"), "__row", "left") \
        .withColumn("__gone", F.coalesce("__gone", F.array().cast("array<int>")))
    return joined.select(*own, without_lines(text, "__gone").alias(text), F.col("__lines").alias(counts), F.col("__gone").alias(places))
