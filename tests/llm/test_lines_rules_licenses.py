"""Line dedup, quality rules and license scans against brute force."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash

from hirelens.llm import licenses, linededup, quality_rules

from .helpers import doc_frame, edge_documents


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
    return row[-1]


def test_edit_distance_equals_the_table():
    rng = random.Random(2)
    for _ in range(300):
        a = "".join(rng.choice("abc é") for _ in range(rng.randint(0, 90)))
        b = list(a)
        for _ in range(rng.randint(0, 9)):
            at = rng.randint(0, len(b))
            b[at:at + rng.randint(0, 2)] = rng.choice(["", "x", "ab"])
        b = "".join(b)
        assert linededup.edit_distance(a, b) == levenshtein(a, b)


def test_similar_equals_the_table():
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcé") for _ in range(rng.randint(1, 7))) for _ in range(40)]
    seen = set()
    for _ in range(600):
        x = [rng.choice(vocabulary) for _ in range(rng.randint(0, 40))]
        y = list(x)
        for _ in range(rng.randint(0, 5)):
            at = rng.randint(0, len(y))
            y[at:at + rng.randint(0, 3)] = [rng.choice(vocabulary) for _ in range(rng.randint(0, 3))]
        if rng.random() < 0.2:
            rng.shuffle(y)
        a, b = " ".join(x), " ".join(y)
        distance, longer = levenshtein(a, b), max(len(a), len(b))
        for least in (1.0, 0.95, 0.9, 0.7, 0.4):
            limit = int((1 - least) * longer + 1e-9)
            above = linededup.at_most(a, b, limit)
            assert above > limit or above >= distance
            assert distance > limit or linededup.at_least(a, b, limit, 3) <= distance
            few = linededup._letters_allow(pd.Series([linededup._letters(a)]), pd.Series([linededup._letters(b)]), np.array([limit]))
            assert distance > limit or few[0]
            assert linededup.similar(a, b, least) == (distance <= (1 - least) * longer + 1e-9)
            seen.add((least, distance <= limit))
    assert len(seen) == 10


def plain_normal(line):
    """Words of a line by plain Python: lower case, digits as 0, other ASCII signs as spaces."""
    def plain(c):
        if c.isdigit() and c < "\x80":
            return "0"
        return c if c >= "\x80" or c < " " and c not in "\t\v\f\r" or c.isalpha() else " "

    return [w.encode() for w in "".join(map(plain, line.lower())).split(" ") if w]


def plain_hash(word):
    return sum(int.from_bytes(xxhash.xxh64_digest(bytes((p % 64, c)), 7), "little") for p, c in enumerate(word)) % 2**64


def plain_simhash(words):
    """Bits that are set in over half of the words' hashes."""
    hashes = [plain_hash(w) for w in words]
    # bit 63 - 8 k - b of the fingerprint is bit 8 k + 7 - b of the hashes
    return sum(1 << 63 - 8 * k - b for k in range(8) for b in range(8) if 2 * sum(h >> 8 * k + 7 - b & 1 for h in hashes) > len(hashes))


def plain_keys(norm, words, similarity=linededup.SIMILARITY):
    """What a line is joined on, as tuples: blocks of words with place and number, the least hashes of word pairs."""
    edits = int((1 - similarity) * len(norm) + 1e-9)
    more = int((1 - similarity) * (len(norm) + edits + 1) + 1e-9)
    keys = set()
    for n in {min(e + 1, 4) for e in (edits, more) if e}:
        for i in range(n):
            run = words[i * len(words) // n:(i + 1) * len(words) // n]
            if run:
                lengths = (len(norm), len(norm) + 1) if n == 2 else (None,)
                keys |= {(n, i, len(words), plain_simhash(run), x) for x in lengths}
    for n in (len(words), len(words) - 1):
        if more and 1 < n and len(words) <= 14:
            keys |= {("first", n, *sorted(words[:(n + 1) // 2])), ("last", n, *sorted(words[len(words) - (n + 1) // 2:]))}
    return keys


def plain_bands(words):
    def mixed(x):
        x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 % 2**64
        return x ^ x >> 32

    hashes = [plain_hash(w) for w in words]
    pairs = [mixed((mixed(a) + b) % 2**64) for a, b in zip([0, *hashes], hashes)]
    least = [sorted({p * int(m) % 2**64 for p in pairs}) for m in linededup._MULTIPLIERS]
    return {(k, n, *x[:n]) for k, x in enumerate(least) for n, fits in ((2, len(words) < 23), (3, len(words) >= 20)) if fits}


def test_line_prints_equal_plain_python():
    rng = random.Random(4)
    texts = ["", "\n", "\n\n a  b\t\x00c \r\n", "  \n   ", "É — ß\x0b\x0cq 12%", "w " * 700, "x" * (linededup.CHUNK * 2 + 5) + " y"]
    texts += ["".join(rng.choice("ab C9.\n\té") for _ in range(rng.randint(1, 900))) for _ in range(60)]
    texts += ["\n".join(" ".join(rng.choice(("ab", "c", "dé", "efghij", "kl")) for _ in range(rng.randint(1, 12))) for _ in range(80))]
    shared, unshared = 0, 0
    for text in texts:
        lines, sizes, lengths, keys = linededup.line_prints(text)
        want = [plain_normal(x) for x in text.split("\n")]
        assert [linededup.normalise(x).encode() for x in text.split("\n")] == lines
        assert lines == [b" ".join(x) for x in want] and sizes.tolist() == [len(x) for x in want]
        assert lengths.tolist() == [len(x.decode()) for x in lines]
        plain = [plain_keys(x.decode(), w) | (plain_bands(w) if plain_keys(x.decode(), w) else set()) for x, w in zip(lines, want)]
        assert [len(set(k.tolist())) for k in keys] == [len(x) for x in plain]
        for i in range(len(lines)):
            for j in range(i):
                assert len(set(keys[i].tolist()) & set(keys[j].tolist())) == len(plain[i] & plain[j])
                shared, unshared = shared + bool(plain[i] & plain[j]), unshared + (not plain[i] & plain[j])
    assert shared > 100 and unshared > 100


def brute_dedup(rows, similarity=linededup.SIMILARITY):
    """Texts without the lines that their group keeps elsewhere; rows in order of (id, row)."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    lines = sorted({n for r in rows for x in (r[1] or "").split("\n") if len((n := linededup.normalise(x)).split()) >= linededup.MIN_WORDS})
    group = {x: x for x in lines}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    keys = {x: plain_keys(x, x.encode().split()) for x in lines}
    keys = {x: k | plain_bands(x.encode().split()) if k else k for x, k in keys.items()}
    for k, a in enumerate(lines):
        for b in lines[k + 1:]:
            if keys[a] & keys[b] and levenshtein(a, b) <= int((1 - similarity) * max(len(a), len(b)) + 1e-9):
                group[find(b)] = find(a)
    seen, out = set(), {}
    for k in order:
        if rows[k][1] is None:
            out[k] = None
            continue
        kept = []
        for x in rows[k][1].split("\n"):
            n = linededup.normalise(x)
            if n in group:
                if find(n) in seen:
                    continue
                seen.add(find(n))
            kept.append(x)
        out[k] = "\n".join(kept)
    return [out[k] for k in range(len(rows))]


def lines_corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(200)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(0, 6)):
            x = rng.choice(base).split()
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                x[rng.randrange(len(x))] += rng.choice("xyz")
            lines.append(" ".join(x).capitalize() + rng.choice(["", ".", " 7"]))
        rows.append((i, "\n".join(lines), "en", "src0", 0))
    return rows


@pytest.mark.parametrize("short_list", [linededup.SHORT_LIST, 2])
def test_line_dedup_equals_brute_force(spark, monkeypatch, short_list):
    monkeypatch.setattr(linededup, "SHORT_LIST", short_list)
    rows = lines_corpus(11)
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(doc_frame(spark, rows)).collect()}
    assert [got[r[0]] for r in rows] == brute_dedup(rows)


@pytest.mark.parametrize("most", [linededup.MOST_PACKED, 3000, 0])
def test_line_dedup_whatever_a_task_can_sort(spark, monkeypatch, most):
    """Postings sorted in memory, by Spark, and some by each."""
    monkeypatch.setattr(linededup, "MOST_PACKED", most)
    monkeypatch.setattr(linededup, "PACKED", 8)
    monkeypatch.setattr(linededup, "SHORT_LIST", 3)
    rows = lines_corpus(13)
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(doc_frame(spark, rows)).collect()}
    assert [got[r[0]] for r in rows] == brute_dedup(rows)


def test_postings_go_many_to_a_row(spark):
    """All keys of all lines are posted with the line's id and length, in far fewer rows than keys."""
    rows = lines_corpus(14)
    found = linededup._posted(linededup._with_lines(doc_frame(spark, rows).coalesce(1), "text", 3, linededup.SIMILARITY)).collect()
    want = set()
    for _, text, *_ in rows:
        for norm, words, size, keys in zip(*linededup.line_prints(text)):
            if words >= 3:
                want |= {(k, int.from_bytes(xxhash.xxh128_digest(norm)[:8], "big", signed=True), int(size)) for k in keys.view(np.int64).tolist()}
    postings = np.concatenate([np.frombuffer(r["postings"], linededup._POSTING) for r in found])
    assert set(zip(*(postings[c].tolist() for c in ("key", "id", "size")))) == want
    assert len(found) * 3 < len(want)
    assert all(len({r["bucket"] for r in found if k in np.frombuffer(r["postings"], linededup._POSTING)["key"]}) == 1 for k in postings["key"][::50])


def test_long_lists_connect_what_all_pairs_connect(spark, monkeypatch):
    """Lists of many lines: similar to one line in the middle, in chains that the first member does not reach, and not similar at all."""
    monkeypatch.setattr(linededup, "SHORT_LIST", 3)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    head = " ".join(word() for _ in range(6))  # the first block of all
    lines = []
    for _ in range(4):
        chain = head.split() + [word() for _ in range(18)]
        for _ in range(14):  # each two steps of the chain are similar, its ends are not
            chain = list(chain)
            chain[rng.randrange(6, 24)] = word()
            lines.append(" ".join(chain))
    lines += [head + " " + " ".join(word() for _ in range(18)) for _ in range(20)]
    rows = [(i, x, "en", "s", 0) for i, x in enumerate(rng.sample(lines, len(lines)))] + [(900 + i, lines[0], "en", "s", 0) for i in range(5)]
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(doc_frame(spark, rows)).collect()}
    assert [got[r[0]] for r in rows] == brute_dedup(rows)
    assert 20 < sum(x != "" for x in got.values()) < 60


def test_similar_pairs_equal_similar():
    """Many pairs at once: characters of one to four bytes, one and several words a column, pairs with more edits than the band."""
    rng = random.Random(1)
    for alphabet in ("abcdefgh ", "ab\u00e9\u6f22 \x00\x01", "ab\U0001f600\u00ff\uffff \ufffe"):
        lines = []
        for size in (0, 3, 40, 100, 400, 1500):
            for _ in range(4):
                x = [rng.choice(alphabet) for _ in range(rng.randint(size // 2, size))]
                lines.append("".join(x))
                for _ in range(5):
                    y = list(x)
                    for _ in range(rng.choice([1, 2, 5, 20, 60, 100])):
                        at = rng.randint(0, len(y))
                        y[at:at + rng.randint(0, 2)] = [rng.choice(alphabet) for _ in range(rng.randint(0, 2))]
                    lines.append("".join(y))
        a = np.array([rng.randrange(len(lines)) for _ in range(400)])
        b = np.array([x // 6 * 6 + rng.randrange(6) if rng.random() < 0.8 else rng.randrange(len(lines)) for x in a.tolist()])
        for least in (1.0, 0.95, 0.9, 0.4):
            want = [linededup.similar(lines[x], lines[y], least) for x, y in zip(a.tolist(), b.tolist())]
            assert linededup.similar_pairs(lines, a, b, least).tolist() == want and 20 < sum(want) < 380
            assert linededup.similar_pairs(lines, a[:5], b[:5], least).tolist() == want[:5]


def test_groups_of_long_lists_meet_in_blocks(spark, monkeypatch):
    """Every pair of lines of different groups in a common list is compared, in one of their lists, without a row for each pair."""
    monkeypatch.setattr(linededup, "BLOCK_LINES", 4)
    rng = random.Random(9)
    compared, plain = spark.sparkContext.accumulator(0), linededup.similar_pairs

    def counted(lines, a, b, least):
        compared.add(len(a))
        return plain(lines, a, b, least)

    monkeypatch.setattr(linededup, "similar_pairs", counted)
    passage = "one passage that stands in every line of these lists " * 3
    words = ["".join(rng.choice("abcde") for _ in range(4)) for _ in range(30)]
    norms = sorted({passage + " ".join(rng.choice(words) for _ in range(rng.randint(4, 7))) for _ in range(90)})
    lists = [(key, i) for key in (5, 6, 7, 8) for i in range(len(norms)) if key == 5 or rng.random() < 0.7]
    hashes = [xxhash.xxh128_digest(x) for x in norms]
    roots = [(hashes[i], hashes[0]) for i in range(0, 40)] + [(hashes[i], hashes[40]) for i in range(40, 50)]
    grp = {i: hashes[0] if i < 40 else hashes[40] if i < 50 else hashes[i] for i in range(len(norms))}
    texts = spark.createDataFrame([(i, bytearray(hashes[i]), x) for i, x in enumerate(norms)], "id long, h binary, norm string")
    members = spark.createDataFrame([(k, i, len(norms[i])) for k, i in lists * 2], "key long, id long, size int")
    links = linededup._across(members, texts, spark.createDataFrame([(bytearray(x), bytearray(y)) for x, y in roots], "node binary, root binary"), 0.9)
    got = {frozenset((bytes(r["a"]), bytes(r["b"]))) for r in links.collect()}
    pairs = [(i, j) for i in range(len(norms)) for j in range(i) if grp[i] != grp[j]]
    limit = {(i, j): int(0.1 * max(len(norms[i]), len(norms[j])) + 1e-9) for i, j in pairs}
    letters = [pd.Series([linededup._letters(x)]) for x in norms]
    open_ = [p for p in pairs if abs(len(norms[p[0]]) - len(norms[p[1]])) <= limit[p]
             and linededup._letters_allow(letters[p[0]], letters[p[1]], np.array([limit[p]]))[0]]
    assert got == {frozenset((grp[i], grp[j])) for i, j in pairs if linededup.edit_distance(norms[i], norms[j]) <= limit[i, j]}
    assert compared.value == len(open_) and 1000 < len(open_)


def test_line_dedup_in_scripts_without_spaces(spark):
    rng = random.Random(12)
    text = lambda first, n: "".join(chr(first + rng.randrange(40)) for _ in range(n))
    rows = []
    for first in (0x4E00, 0x3042, 0x0E01, 0x20000):
        line, at = text(first, 600), len(rows)
        near = line[:300] + "x" + line[301:]
        assert len(set(map(linededup.normalise, (line, near)))) == 2
        short, heading = text(first, 15), text(first, 9)
        rows += [(at, f"{line}\n{short}\n{heading}", "zh", "s", 0), (at + 1, f"{heading}\n{line}\n{short}", "zh", "s", 0),
                 (at + 2, f"{near}\n{text(first, 600)}", "zh", "s", 0)]
    got = {r["doc_id"]: r["lines_removed"] for r in linededup.dedup_lines(doc_frame(spark, rows)).collect()}
    assert [got[k] for k in range(len(rows))] == [[], [1, 2], [0]] * 4


def edited(rng, words, vocabulary, kind):
    y = list(words)
    if kind.endswith("typos") or kind == "one typo":
        text = list(" ".join(y))
        for _ in range(1 if kind == "one typo" else 3):
            at = rng.choice([k for k, c in enumerate(text) if c != " "])
            text[at:at + rng.randint(0, 1)] = rng.choice("abcdefghijklmnop")
        return "".join(text)
    if kind == "replaced":
        y[rng.randrange(len(y))] = rng.choice(vocabulary)
    elif kind == "inserted":
        y.insert(rng.randint(0, len(y)), rng.choice(vocabulary))
    else:
        for _ in range(2 if kind == "two deleted" else 1):
            del y[rng.randrange(len(y))]
    return " ".join(y)


@pytest.mark.parametrize("zipf", [False, True])
def test_recall_of_similar_lines(zipf):
    """Share of made pairs of edit similarity 0.9 that share a key, by kind of edit and words of the line."""
    rng = random.Random(18)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    weights = [1 / (k + 1) if zipf else 1 for k in range(3000)]
    kinds, sizes = ("one typo", "three typos", "replaced", "inserted", "deleted", "two deleted"), ((3, 7), (8, 14), (15, 29), (30, 80))
    found = {}
    for kind in kinds:
        for low, high in sizes:
            pairs = hits = tries = 0
            while pairs < 150 and tries < 6000:
                tries += 1
                x = rng.choices(vocabulary, weights, k=rng.randint(low, high))
                a, b = " ".join(x), edited(rng, x, vocabulary, kind)
                if a == b or len(b.split()) < linededup.MIN_WORDS or not linededup.similar(a, b, 0.9):
                    continue
                _, _, _, keys = linededup.line_prints(a + "\n" + b)
                pairs += 1
                hits += bool(set(keys[0].tolist()) & set(keys[1].tolist()))
            if pairs >= 30:
                found[kind, low] = round(hits / pairs, 2)
    print(found)
    assert len(found) >= 19 and min(found.values()) >= 0.9, found


def test_line_dedup_edges(spark):
    docs = edge_documents(spark)
    got = linededup.dedup_lines(docs)
    assert sorted(got.columns) == sorted([*docs.columns, "lines_removed"])  # the documents' own ``lines`` is replaced
    rows = got.select("doc_id", "text", "lines", "lines_removed").collect()
    assert len(rows) == docs.count() and all(isinstance(r["lines"], int) for r in rows)
    kept = linededup.dedup_lines(docs, counts="__lines", places="__removed")
    assert {r["lines"] for r in kept.select("lines").collect()} == {"x"}
    assert sorted(kept.columns) == sorted([*docs.columns, "__lines", "__removed"])
    first = [r for r in rows if r["text"] and r["text"].startswith("The same line")]
    assert len(first) == 1 and first[0]["doc_id"] == 1
    assert sum(r["text"] is None for r in rows) == 2
    assert linededup.dedup_lines(docs.limit(0)).count() == 0


def brute_counts(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    inside = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    dup = sum(x in lines[:k] for k, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside)


def test_quality_rules(spark):
    rng = random.Random(8)
    body = lambda: "\n".join(" ".join(rng.choice("abcdefgh") + str(rng.randint(0, 99)) for _ in range(30)) for _ in range(3))
    menu = "home page about us " * 15
    rows = [(i, (menu + "\n") * (i % 2) + body(), "en", "h1", 0) for i in range(80)]  # a shared menu, own bodies
    rows += [(100 + i, menu + f"\nbody{i} alone", "en", "h1", 0) for i in range(80)]  # little but the menu
    rows += [(200 + i, rows[0][1], "en", "h1", 0) for i in range(200)]  # copies of a clean document
    rows += [(500 + i, rows[1][1] + f"\nnear copy {i} of the text", "en", None, 0) for i in range(60)]
    got = {r["doc_id"]: r for r in quality_rules.judge(doc_frame(spark, rows), line_limit=20, line_share=0.05).collect()}
    for i, text, *_ in rows:
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_counts(text)
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
    assert all(not got[i]["kept"] for i in range(100, 180))
    assert all(got[200 + i]["kept"] for i in range(200))
    assert all(got[i]["words_removed"] == (60 if i % 2 else 0) for i in range(80))


def test_quality_rules_edges(spark):
    docs = edge_documents(spark)
    got = quality_rules.judge(docs).collect()
    assert len(got) == docs.count()
    for r, d in zip(sorted(got, key=lambda r: (r["doc_id"] is None, r["doc_id"], r["n_words"])),
                    sorted(docs.collect(), key=lambda d: (d["doc_id"] is None, d["doc_id"], len((d["text"] or "").split())))):
        assert (r["doc_id"], r["n_words"]) == (d["doc_id"], len((d["text"] or "").split()))
    assert quality_rules.judge(docs.limit(0)).count() == 0
    kept = quality_rules.keep_good(docs, min_words=5)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 1, 2, 7]  # the long text repeats itself


def brute_common(rows, limit, share):
    """(host, normalised line) in more distinct documents of the host than its limit; documents of equal lines are one."""
    normal = lambda x: re.sub(r"\d", "0", " ".join(x.lower().split()))
    sets = {(r[3], frozenset(filter(None, map(normal, (r[1] or "").split("\n"))))) for r in rows}
    sets = {(h, s) for h, s in sets if s}
    return {(h, x) for h, s in sets for x in s
            if sum(x in t for g, t in sets if g == h) > max(limit, share * sum(g == h for g, _ in sets))}, normal


def test_rules_remove_lines_above_the_limit(spark):
    rng = random.Random(15)
    body = lambda n: "\n".join(" ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(30)) for _ in range(n))
    rows = [(i, f"Menu  {i % 10} of all pages\n{body(2)}\n \n{body(1)}\nmenu 7 of all pages\n", "en", "h1", 5) for i in range(30)]
    rows += [(100 + i, body(3), "en", "h1", 5) for i in range(5)]
    rows += [(200 + i, "menu 7 of all pages\n" + body(3), "en", None, 5) for i in range(3)]  # few of another host
    rows += [(300 + i, rows[0][1], "en", "h1", 5) for i in range(2)] + [(400, None, "en", "h1", None)]
    common, normal = brute_common(rows, 20, 0.05)
    assert common == {("h1", "menu 0 of all pages")}
    kept = {r["doc_id"]: r for r in quality_rules.keep_good(doc_frame(spark, rows), line_limit=20, line_share=0.05).collect()}
    judged = {r["doc_id"]: r for r in quality_rules.judge(doc_frame(spark, rows), line_limit=20, line_share=0.05).collect()}
    assert sorted(kept) == [r[0] for r in rows if r[1]]
    for i, text, _, host, n_chars in rows[:-1]:
        lines = text.split("\n")
        gone = [k for k, x in enumerate(lines) if (host, normal(x)) in common]
        assert judged[i]["lines_removed"] == gone and len(gone) == (2 if host and "enu" in text else 0)
        assert kept[i]["text"] == "\n".join(x for k, x in enumerate(lines) if k not in gone)
        assert kept[i]["n_chars"] == (len(kept[i]["text"]) if gone else n_chars)


def test_rules_count_documents_that_share_lines(spark):
    rng = random.Random(3)
    line = lambda: " ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(12))
    shared, parts = [line() for _ in range(10)], [line() for _ in range(14)]
    rows = [(i, "\n".join([*shared, line()]), "en", "h1", 0) for i in range(40)]  # ten shared lines, one own
    rows += [(100 + i, "\n".join(rng.sample(parts, 7)), "en", "h2", 0) for i in range(80)]  # shared lines in other selections
    rows += [(200 + i, "\n".join(rng.sample(shared, 10)), "en", "h3", 0) for i in range(60)]  # the same lines in any order
    common, normal = brute_common(rows, 20, 0.05)
    assert {h for h, _ in common} == {"h1", "h2"} and len(common) == 24
    for r in quality_rules.judge(doc_frame(spark, rows), line_limit=20, line_share=0.05).collect():
        _, text, _, host, _ = next(x for x in rows if x[0] == r["doc_id"])
        assert r["lines_removed"] == [k for k, x in enumerate(text.split("\n")) if (host, normal(x)) in common]
        assert r["kept"] == (host == "h3")


def brute_scan(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    words = word.findall(lowered)
    found = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(words))
             if words[i:i + len(p.split())] == p.split()]
    more, best = set(), 0.0
    for line in lowered.split("\n"):
        have = set(word.findall(line))
        for label, template in licenses.TEMPLATES:
            t = set(word.findall(template.lower()))
            if len(have & t) / len(t) >= licenses.THRESHOLD - 1e-9:
                more.add(label)
                best = max(best, len(have & t) / len(t))
    base = {x for _, x in found}
    starts = [i for i, _ in found]
    return (len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
            ",".join(sorted(base | more)), 1.0 if found else best)


def test_license_scan_equals_brute_force(spark):
    rng = random.Random(6)
    pieces = [t for _, t in licenses.TEMPLATES] + ["MIT - License!", "the mit license,mit License", "xmit license", "GENERAL\npublic license",
                                                  "general public licenses", "émit license", "apache_license", "plain words here"]
    rows = []
    for i in range(150):
        parts = []
        for _ in range(rng.randint(0, 4)):
            w = rng.choice(pieces).split(" ")
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                w[rng.randrange(len(w))] = rng.choice(["zzz", "the", ""])
            parts.append(" ".join(w))
        rows.append((i, rng.choice(["\n", " "]).join(parts), "en", "s", 0))
    got = {r["doc_id"]: tuple(r)[1:] for r in licenses.scan(doc_frame(spark, rows)).collect()}
    for i, text, *_ in rows:
        want = brute_scan(text)
        assert got[i][:6] == want[:6], text
        assert got[i][6] == pytest.approx(want[6])


def test_license_scan_edges(spark):
    docs = edge_documents(spark)
    got = licenses.scan(docs).collect()
    assert len(got) == docs.count()
    count = defaultdict(list)
    for r in got:
        count[r["doc_id"]].append(tuple(r)[1:6])
    for d in docs.collect():
        assert brute_scan(d["text"])[:5] in count[d["doc_id"]]
    assert licenses.scan(docs.limit(0)).count() == 0
