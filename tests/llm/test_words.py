"""Byte-run words, hashes and windows against regular expressions; codes and tables round trip."""

import random

import brute
import numpy as np
import pyarrow as pa
import pytest

from tidegauge.llm import bittable, simple8b
from tidegauge.llm.bytewords import ALNUM, NOT_SPACE, Prefix, find_words, run_hashes, slices, sliding_min, spaced
from tidegauge.llm.frequent import most_frequent


def some_texts(seed):
    rng = random.Random(seed)
    return [None if rng.random() < 0.1 else "".join(rng.choice("aZé 0\n\t._\x00ß漢 -") for _ in range(rng.randint(0, 30))) for _ in range(6)]


@pytest.mark.parametrize("seed", range(40))
def test_words_and_hashes(seed):
    texts = some_texts(seed)
    for table, lower, plain in ((NOT_SPACE, False, brute.spaced), (ALNUM, True, brute.alnum)):
        words = find_words(pa.array(texts, pa.string()), table, lower)
        got = [[words.data[words.start[i] : words.end[i]].tobytes().decode() for i in range(words.first[r], words.first[r + 1])] for r in range(len(texts))]
        assert got == [plain(t) for t in texts]
        flat, hashes = sum(got, []), words.hashes()
        assert len(set(hashes.tolist())) == len(set(flat))
        assert spaced(words)[0].decode() == " ".join(flat)
        for k in (1, 2, 3):
            at = np.arange(max(0, len(flat) - k + 1))
            distinct = len({tuple(flat[i : i + k]) for i in at})
            assert len(set(run_hashes(hashes, k).tolist())) == len(set(Prefix(hashes, 77).of(at, at + k).tolist())) == distinct
            assert sliding_min(hashes, k).tolist() == [min(hashes[i : i + k]) for i in at]


def test_slices_cover_all_rows():
    batch = pa.record_batch([pa.array(["a" * n for n in (5, 0, 100, 3, 3, 0)])], names=["text"])
    parts = list(slices(batch, limit=8))
    assert [p.num_rows for p in parts] == [2, 1, 3] and sum(p.num_rows for p in parts) == batch.num_rows


@pytest.mark.parametrize("n", [0, 1, 59, 60, 61, 1023, 1024, 1025, 5000])
@pytest.mark.parametrize("most", [1, 17, 50257, 2**30, 2**61, 2**64 - 1])
def test_simple8b_round_trip(n, most):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, most, n, dtype=np.uint64, endpoint=True)
    for values in (ids, np.where(rng.random(n) < 0.9, ids % np.uint64(3), ids)):
        words, blocks, raw = simple8b.encode(values)
        assert (simple8b.decode(words, blocks, raw, n) == values).all()
        assert len(blocks) == -(-n // simple8b.BLOCK)


def test_bit_table_never_loses(spark):
    keys = [-(2**63), -5, -1, 0, 7, 2**24 + 7, 2**63 - 1]
    table = bittable.collect_bits(spark.createDataFrame([(k,) for k in [*keys, None]], "k bigint"), "k", bits=12)
    assert table.nbytes == 512 and bittable.member(table, np.array(keys)).all()
    assert not bittable.member(table, np.array([3, 100, 2000])).any()


@pytest.mark.parametrize("most", [0, 1, 7, 50, 500])
def test_most_frequent_is_bounded_and_from_the_top(spark, most):
    counts = {f"w{i}": 1 + (i * i) % 97 for i in range(200)}
    got = {r.word: r.n for r in most_frequent(spark.createDataFrame(list(counts.items()), "word string, n bigint"), "n", most).collect()}
    assert len(got) == min(most, 200) and (not got or min(got.values()) >= max([0, *(n for w, n in counts.items() if w not in got)]))
    if most >= 200:
        assert got == counts
    assert most_frequent(spark.createDataFrame([], "word string, n bigint"), "n", most).count() == 0


def test_most_frequent_of_equal_counts(spark):
    frame = spark.createDataFrame([(f"w{i}", 1000 if i < 3 else 7) for i in range(120)], "word string, n bigint")
    got = {r.word for r in most_frequent(frame, "n", 40).collect()}
    assert len(got) == 40 and {"w0", "w1", "w2"} <= got
    assert got == {r.word for r in most_frequent(frame.repartition(5), "n", 40).collect()}
