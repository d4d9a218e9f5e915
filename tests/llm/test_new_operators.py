"""Tries, byte deduplication and periodic runs against plain versions."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from brute import FOLDER, sha, spaced
from oracle import compare

from tidegauge.llm import conversations, periods, suffixes
from tidegauge.llm.queries import llm_oracles, llm_queries


@pytest.mark.parametrize("name", ["op11_tree_contraction", "op12_suffix_array", "op13_block_convolution"])
def test_query_is_its_sql(spark, name):
    problem, n = compare(name, llm_queries()[name], llm_oracles()[name], spark, FOLDER)
    assert problem is None and n > 0, problem


# ---------------------------------------------------------------- op11


def plain_trie(rows):
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0, role or ""), (role or "", text or "")))
    turns = {c: [t for _, t in sorted(r, key=lambda x: x[0])] for c, r in own.items()}
    held = collections.defaultdict(list)
    ends = collections.defaultdict(list)
    for c in turns:
        base = int(np.fix(c / 100)) * 100
        h = zlib.crc32(str(c).encode()) % 6
        path = tuple(turns.get(base, [])[:h] + turns[c][h:])
        ends[path].append(c)
        for d in range(len(path) + 1):
            held[path[:d]].append(c)
    children = collections.Counter(p[:-1] for p in held if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, who in held.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(who) - 1) * len(p[-1][1]) if p else 0
    return sorted(
        ((min(w), len(p), min(held[p[:-1]]) if p else None, len(w), children[p], leaves[p], saved[p], sha(",".join(map(str, sorted(ends[p]))))) for p, w in held.items()), key=str)


SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, node string, a string, parent string"


def trie_of(spark, rows, tmp_path):
    spark.createDataFrame([(*r, "x", "y", "z", "p") for r in rows], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    return sorted((tuple(r) for r in conversations.op11_tree_contraction(spark, str(tmp_path)).collect()), key=str)


def test_trie(spark, tmp_path):
    rng = random.Random(5)
    rows = []
    for c in [*range(40), 100, 101, 205, 305, 310, -5, -120, 1000]:
        for turn in rng.sample([None, 0, 1, 2, 3, 4, 5, 6, 7, 8], rng.randint(1, 9)):
            rows.append((c, turn, rng.choice(["user", "assistant", None]), rng.choice(["", None, "a", "héé"])))
    rows += [(400, i, "user", f"line {i % 3}") for i in range(90)] + [(401, i, "user", f"line {i % 3}") for i in range(70)]
    rows += [(None, 1, "user", "lost"), (500, None, None, None)]
    assert trie_of(spark, rows, tmp_path) == plain_trie(rows)


def test_equal_turns_all_count(spark, tmp_path):
    rows = [(7, 1, "user", "again")] * 5
    got = trie_of(spark, rows, tmp_path)
    assert sorted(r[1] for r in got) == [0, 1, 2, 3, 4, 5]


def test_empty_trie(spark, tmp_path):
    assert trie_of(spark, [], tmp_path) == []


@pytest.mark.parametrize("shape", ["random", "chain", "star", "caterpillar", "forest"])
def test_subtree_totals(spark, shape):
    rng = random.Random(shape)
    n = 300
    parent = {0: None}
    for i in range(1, n):
        parent[i] = {
            "random": rng.randrange(i), "chain": i - 1, "star": 0, "caterpillar": i - 1 if i % 2 else max(0, i - 2),
            "forest": None if i % 50 == 0 else rng.randrange(max(i - 4, i - i % 50), i)}[shape]
    depth = {}
    for i in range(n):
        depth[i] = 0 if parent[i] is None else depth[parent[i]] + 1
    value = {i: rng.randrange(-5, 50) for i in range(n)}
    total = dict(value)
    for i in range(n - 1, 0, -1):
        if parent[i] is not None:
            total[parent[i]] += total[i]
    children = collections.Counter(p for p in parent.values() if p is not None)
    tree = spark.createDataFrame([(i, parent[i], depth[i], value[i]) for i in range(n)], "node bigint, parent bigint, depth int, v bigint")
    got = conversations.subtree_totals(tree, ["v"]).collect()
    assert sorted((r.node, r.v, r.n_children) for r in got) == [(i, total[i], children[i]) for i in range(n)]


def test_long_lists_of_endings_are_hashed_in_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(conversations, "PIECE", 3)
    rows = [(c, 0, "user", "same") for c in range(0, 3000, 100)]
    assert trie_of(spark, rows, tmp_path) == plain_trie(rows)


# ---------------------------------------------------------------- op12


def plain_bytes(rows, length):
    first = {}
    for i, text in rows:
        b = (text or "").encode()
        if i is not None:
            for k in range(len(b) - length + 1):
                first[b[k : k + length]] = min(first.get(b[k : k + length], i), i)
    out = []
    for i, text in rows:
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if i is not None and first[b[k : k + length]] < i:
                gone[k : k + length] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=str)


def byte_rows(seed):
    rng = random.Random(seed)
    base = "".join(rng.choice("abcé ") for _ in range(400))
    rows = []
    for i in range(120):
        text = ""
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(300)
            text += base[at : at + rng.randint(10, 100)] if rng.random() < 0.6 else "".join(rng.choice("abcdé \n") for _ in range(rng.randint(0, 60)))
        rows.append((i // 2 if rng.random() < 0.5 else i, "a" * rng.randint(40, 300) if rng.random() < 0.1 else text))
    return [*rows, (None, base), (None, None), (7, None), (500, base), (501, base), (501, base)]


@pytest.mark.parametrize(("slice_rows", "length", "gram"), [(3, 50, 16), (1 << 15, 50, 16), (40, 20, 9), (7, 64, 12)])
def test_byte_dedup(spark, slice_rows, length, gram):
    rows = byte_rows(slice_rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = suffixes.dedup_bytes(docs, length, gram, slice_rows).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_bytes(rows, length)


def test_byte_dedup_awkward(spark, awkward, empty):
    rows = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    got = suffixes.dedup_bytes(awkward).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_bytes(rows, 50)
    assert suffixes.dedup_bytes(empty).count() == 0


def test_equal_runs():
    rng = np.random.default_rng(1)
    strings = rng.integers(0, 2, (500, 11)).astype(np.uint8)
    run = suffixes.equal_runs(strings)
    by = collections.defaultdict(set)
    for r, s in zip(run.tolist(), map(bytes, strings), strict=True):
        by[r].add(s)
    assert all(len(s) == 1 for s in by.values()) and len(by) == len(set(map(bytes, strings)))


# ---------------------------------------------------------------- op13


def plain_runs(words, least=12):
    n, seen = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                seen.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, q, e - s) for (s, e), q in seen.items())


@pytest.mark.parametrize("transformed", [2, 8, 32])
def test_runs(monkeypatch, transformed):
    monkeypatch.setattr(periods, "NTT", transformed)
    rng = random.Random(transformed)
    for _ in range(120):
        n, kinds = rng.choice([0, 5, 12, 30, 80, 200, 400]), rng.choice([1, 2, 3, 5, 50])
        words = [rng.randrange(kinds) for _ in range(n)]
        if rng.random() < 0.6 and n > 20:
            at = rng.randrange(n)
            p = 1 + (n - at) // rng.randint(2, 9)
            words = words[:at] + [words[at + i % p] for i in range(n - at)]
        start, length, period = periods.find_runs(np.array(words, np.int64), n)
        assert list(zip(start.tolist(), period.tolist(), length.tolist(), strict=True)) == plain_runs(words)


def test_correlations_are_exact():
    rng = np.random.default_rng(2)
    blocks, windows = rng.integers(0, 1 << 29, (5, 16)), rng.integers(0, 1 << 29, (5, 46))
    got = periods.correlations(blocks, windows)
    for b, w, row in zip(blocks.tolist(), windows.tolist(), got.tolist(), strict=True):
        assert row == [sum(x * y for x, y in zip(b, w[i : i + 16], strict=True)) % periods.PRIME for i in range(31)]


def test_runs_awkward(spark, awkward, empty):
    got = periods.periodic_runs(awkward).collect()
    want = []
    for r in awkward.select("doc_id", "text").collect():
        words = spaced(r.text)
        if len(words) > 1000:  # 977 triples of words, over and over
            runs = [(0, 2931, len(words))]
        else:
            runs = plain_runs(words)
        kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, q, n in runs)]
        want.append((r.doc_id, len(words), runs, " ".join(kept)))
    assert sorted(((r.doc_id, r.n_words, [(x.start, x.period, x.length) for x in r.runs], r.collapsed) for r in got), key=str) == sorted(want, key=str)
    assert periods.periodic_runs(empty).count() == 0


def test_a_text_of_one_word(spark):
    text = "word " * 300_000  # longer than a slice
    row = periods.periodic_runs(spark.createDataFrame([(1, text), (2, re.sub("word", "two words", text[:500]))], "doc_id bigint, text string")).orderBy("doc_id").collect()
    assert [tuple(r.runs[0]) for r in row] == [(0, 300_000, 1), (0, 200, 2)]
    assert [r.collapsed for r in row] == ["word", "two words"]
