"""Quality rules with an isolation forest on rule statistics.

Per text: words `[^\\x20\\x09-\\x0D]+`, code points in words, characters of `[#*$%&|<>]`,
lines (cut at newlines) that have a word, such lines equal to an earlier one, and words in
3-word windows found twice or more.  The base rules fail texts of under 50 words and those
with over half of their words in repeated windows.

The method scores statistics that do not depend on length (code points a word, symbols a
word, share of repeated lines, share of repeated words) with an isolation forest: every
tree splits rows of quality 1 at random places of random statistics, and a text that few
splits set apart is anomalous.  Places are drawn from the range of all labelled rows, so a
statistic that is constant among good rows can still set others apart.  They do not depend
on the rows inside a node, so a tree needs no sample: it is drawn first, tasks count all
rows of quality 1 in its slots, and the counts give the path lengths.  One forest is grown
for each set of statistics on labelled rows with even hash; rows with odd hash pick the set
and the threshold: most rows of quality 0 go while at least ``keep_good`` of quality 1 stay.
All labelled rows that pass the base rules take part.

Rows: null and empty texts have no words and fail the base rules; several labels of an id
count as their smallest; labels without a document, or null, are ignored; with no labels
of both kinds the base rules decide alone; null ids and repeated rows get verdicts of
their own; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.bytewords import NOT_SPACE, Prefix, find_words, mix, run_hashes, slices, text_bytes
from tidegauge.operators.ordered import ladder
from tidegauge.session import stage

KEEP_GOOD = 0.998
TREES = 128
DEPTH = 8
MIN_WORDS = 50

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
RATIOS = [("word_chars", "n_words"), ("n_symbols", "n_words"), ("n_dup_lines", "n_lines"), ("n_repeat_words", "n_words")]
WIDTH = len(RATIOS)


def _per_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[bounds])


def _seen_before(keys: np.ndarray) -> np.ndarray:
    """Whether an equal key stands at an earlier place."""
    again = np.ones(len(keys), bool)
    again[np.unique(keys, return_index=True)[1]] = False
    return again


def rule_statistics(texts: pa.Array) -> list[np.ndarray]:
    """The columns STATS of every text."""
    data, offsets = text_bytes(texts)
    words = find_words(texts, NOT_SPACE)
    word_chars = _per_row(NOT_SPACE[data] & ((data & 0xC0) != 0x80), offsets)
    n_symbols = _per_row(SYMBOLS[data], offsets)

    ends = np.union1d(np.flatnonzero(data == 10), offsets[1:])  # of lines: newlines and ends of texts
    starts = np.concatenate([[0], ends[:-1] + (data[np.minimum(ends[:-1], len(data) - 1)] == 10) * (ends[:-1] < len(data))]) if len(data) else np.zeros(len(ends), np.int64)
    starts = np.minimum(starts, ends)
    held = np.searchsorted(words.start, ends) > np.searchsorted(words.start, starts)
    starts, ends = starts[held], ends[held]
    line_row = np.searchsorted(offsets, starts, side="right") - 1
    salt = np.uint64(0x9E3779B97F4A7C15)
    lines = Prefix(data.astype(np.uint64) + np.uint64(1), 0xC2B2AE3D27D4EB4F).of(starts, ends)
    again = _seen_before(mix(lines + line_row.astype(np.uint64) * salt))
    rows = len(texts)
    n_lines = np.bincount(line_row, minlength=rows)
    n_dup = np.bincount(line_row[again], minlength=rows)

    row = words.row
    grams = run_hashes(words.hashes(), 3)
    inside = np.flatnonzero(row[: len(grams)] == row[2:]) if len(grams) else np.zeros(0, np.int64)
    keys = mix(grams[inside] + row[inside].astype(np.uint64) * salt)
    _, index, count = np.unique(keys, return_inverse=True, return_counts=True)
    at = inside[count[index] > 1]
    repeated = np.zeros(len(row), bool)
    for off in range(3):
        repeated[at + off] = True
    return [words.counts, word_chars, n_symbols, n_dup, _per_row(repeated, words.first), n_lines]


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            columns = [pa.array(c.astype(np.int64)) for c in rule_statistics(part.column(1))]
            yield pa.record_batch([part.column(0), *columns], names=["doc_id", *STATS])


def features(*values: np.ndarray) -> np.ndarray:
    """The RATIOS of the columns STATS."""
    held = dict(zip(STATS, values, strict=True))
    return np.stack([held[a] / np.maximum(held[b], 1) for a, b in RATIOS], axis=1)


def average_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among ``n`` rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Whole binary trees as arrays (trees x nodes): statistic, place; path length by slot at the bottom."""

    feature: np.ndarray
    place: np.ndarray
    path: np.ndarray
    norm: float

    @classmethod
    def plant(cls, low: np.ndarray, high: np.ndarray, use: list[int], trees: int = TREES, seed: int = 42) -> Forest:
        """Trees over the statistics ``use``, not counted yet; ``low`` to ``high`` is the range of places."""
        random = np.random.default_rng(seed)
        features, places = [], []
        least, most = (np.broadcast_to(x, (trees, 1, len(x))) for x in (low, high))
        for _ in range(DEPTH):
            f = np.array(use)[random.integers(len(use), size=least.shape[:2])]
            at = f[:, :, None] == np.arange(len(low))
            cut = random.uniform(least[at], most[at]).reshape(f.shape)
            features.append(f)
            places.append(cut)
            upper, lower = np.where(at, cut[:, :, None], least), np.where(at, cut[:, :, None], most)
            least = np.stack([least, upper], axis=2).reshape(trees, -1, len(low))
            most = np.stack([lower, most], axis=2).reshape(trees, -1, len(low))
        return cls(np.concatenate(features, axis=1).astype(np.int8), np.concatenate(places, axis=1), np.zeros((trees, 1 << DEPTH)), 1.0)

    def slots(self, rows: np.ndarray, tree: int) -> np.ndarray:
        """Each row's place at the bottom of a tree."""
        at, every = np.zeros(len(rows), np.int64), np.arange(len(rows))
        for _ in range(DEPTH):
            at = 2 * at + 1 + (rows[every, self.feature[tree, at]] >= self.place[tree, at])
        return at - ((1 << DEPTH) - 1)

    def counted(self, counts: np.ndarray) -> Forest:
        """The forest whose slots hold ``counts`` rows (trees x slots): a node of one row or none ends a path."""
        path = DEPTH + average_path(counts)
        for level in range(DEPTH - 1, -1, -1):
            inside = counts.reshape(len(counts), 1 << level, -1).sum(axis=2)
            path = np.where(np.repeat(inside <= 1, 1 << (DEPTH - level), axis=1), level, path)
        return Forest(self.feature, self.place, path, float(average_path(counts[0].sum())) or 1.0)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / expected path): near 1 is anomalous."""
        total = np.zeros(len(rows))
        for tree in range(len(self.path)):
            total += self.path[tree, self.slots(rows, tree)]
        return 2.0 ** (-total / len(self.path) / self.norm)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(f"f{i}").to_numpy() for i in range(WIDTH)], axis=1)


def calibrate(rows: DataFrame, keep_good: float, seed: int) -> tuple[Forest | None, float]:
    """The forest and the least score to reject, from all of ``rows``: ``f0`` to ``f3``, ``good``, ``held``.

    Trees count every good row that is not held.  Of the sets of statistics the one wins that
    rejects most bad held rows while ``keep_good`` of the good held ones stay; with none,
    nothing is rejected.  The threshold is half-way to the next bad row.
    """
    spark, names = rows.sparkSession, [f"f{i}" for i in range(WIDTH)]
    found = rows.agg(F.count_if(F.col("good") & ~F.col("held")), F.count_if(F.col("good") & F.col("held")), F.count_if(~F.col("good") & F.col("held")),
                     *[f(n) for f in (F.min, F.max) for n in names]).first()
    if found[0] < 2 or not found[1] or not found[2]:
        return None, float("inf")
    low, high = np.array(found[3 : 3 + WIDTH]), np.array(found[3 + WIDTH :])
    sets = [u for n in range(1, WIDTH + 1) for u in combinations([f for f in range(WIDTH) if high[f] > low[f]], n)]
    forests = [Forest.plant(low, high, list(use), seed=seed) for use in sets]
    if not forests:
        return None, float("inf")
    planted = spark.sparkContext.broadcast(forests)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((len(planted.value), TREES, 1 << DEPTH), np.int64)
        for batch in batches:
            x = _matrix(batch)
            for total, forest in zip(totals, planted.value, strict=True):
                for tree in range(TREES):
                    total[tree] += np.bincount(forest.slots(x, tree), minlength=1 << DEPTH)
        at = np.flatnonzero(totals)
        yield pa.record_batch([pa.array(at), pa.array(totals.ravel()[at])], names=["at", "n"])

    # at most one line a slot, however many rows
    held = rows.where("good and not held").mapInArrow(count, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(forests) * TREES << DEPTH, np.int64)
    counts[held.column("at").to_numpy()] = held.column("n").to_numpy()
    forests = [forest.counted(c) for forest, c in zip(forests, counts.reshape(len(forests), TREES, -1), strict=True)]
    grown = spark.sparkContext.broadcast(forests)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, good = _matrix(batch), batch.column("good")
            for nth, forest in enumerate(grown.value):
                yield pa.record_batch([pa.array(np.full(len(x), nth, np.int32)), good, pa.array(forest.scores(x))], names=["nth", "good", "score"])

    scored = stage(rows.where("held").mapInArrow(score, "nth int, good boolean, score double"))
    floor = F.min(F.when(F.col("cum_n") >= F.greatest(F.lit(1), F.ceil(F.lit(keep_good) * F.col("all_n"))), F.col("v"))).alias("floor")
    floors = ladder(scored.where("good"), ["nth"], "score").groupBy("nth").agg(floor)
    caught = scored.where("not good").join(F.broadcast(floors), "nth").where("score > floor").groupBy("nth").agg(
        F.first("floor").alias("floor"), F.min("score").alias("above"), F.count("*").alias("n"))
    best = max(caught.collect(), key=lambda r: (r["n"], -r["nth"]), default=None)  # one line a set of statistics
    return (forests[best["nth"]], (best["floor"] + best["above"]) / 2) if best else (None, float("inf"))


def _base_failed(n_words, n_repeat):
    return (n_words < MIN_WORDS) | (100 * n_repeat > 50 * n_words)


def judge(docs: DataFrame, labels: DataFrame, keep_good: float = KEEP_GOOD, seed: int = 42) -> DataFrame:
    """One row a document: the statistics, anomaly score, base_failed and kept."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    stats = stage(docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        _statistics, f"doc_id {id_type}, " + ", ".join(f"{c} bigint" for c in STATS)))
    marked = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    ratios = [f"{a} / greatest({b}, 1) AS f{i}" for i, (a, b) in enumerate(RATIOS)]
    labelled = stage(stats.join(marked, "doc_id").where(~_base_failed(F.col("n_words"), F.col("n_repeat_words"))).selectExpr(
        *ratios, "quality > 0 AS good", "(shiftright(xxhash64(doc_id), 32) & 1) = 1 AS held"))
    forest, limit = calibrate(labelled, keep_good, seed)
    shared = docs.sparkSession.sparkContext.broadcast((forest, limit))

    def verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grown, most = shared.value
        for batch in batches:
            values = [batch.column(1 + i).to_numpy() for i in range(len(STATS))]
            failed = _base_failed(values[0], values[4])
            score = grown.scores(features(*values)) if grown else np.zeros(batch.num_rows)
            yield pa.record_batch(
                [*batch.columns, pa.array(score), pa.array(failed), pa.array(~failed & (score < most))], names=[*batch.schema.names, "anomaly", "base_failed", "kept"])

    return stats.mapInArrow(
        verdicts, f"doc_id {id_type}, " + ", ".join(f"{c} bigint" for c in STATS) + ", anomaly double, base_failed boolean, kept boolean")


def op5_isolation(spark: SparkSession, folder: str) -> DataFrame:
    judged = judge(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    return judged.select("doc_id", *STATS[:5], "base_failed", "kept", F.round("anomaly", 9).alias("anomaly"))
