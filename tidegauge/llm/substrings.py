"""Substring deduplication by hashes of content-defined blocks and windows.

This takes the place of a greedy relative Lempel-Ziv parse: no match is extended.

Words are `[^\\x20\\x09-\\x0D]+`, unchanged.  A word goes when it lies in a window of
``length`` (50) words whose sequence also starts in a document with a smaller id.

The corpus is its own reference.  Each document is cut, by content alone, into reference
blocks: of the 35 k-gram hashes (k = 16) inside each window the smallest owns the window,
and consecutive windows with one owner are a block.  The same words give the same blocks
anywhere, and every window lies in exactly one block.

1. Index: blocks whose owner k-gram occurs under two ids are kept, all others are literals.
2. Factors: a block whose whole span of words stands in a document with a smaller
   id is a factor; all its windows go.  Neighbouring factors join to one long span.
3. Factor boundaries: blocks where a factor starts or ends are matched only in part, so
   each of their windows is compared by itself with the windows of the first document of
   every other such block.

Equality is that of two independent 64-bit hashes of the words.  Everything is a grouped
minimum and a join on those hashes, both of which Spark splits for a hot passage; the
number of rows follows the number of words, never pairs of documents.

Rows: null texts have no words; rows with a null id are kept whole and are no reference;
rows with one id are compared with smaller ids only, so repeated rows keep each other;
empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import bittable
from tidegauge.llm.bytewords import NOT_SPACE, Prefix, Words, find_words, list_array, run_hashes, signed, slices, sliding_min, spaced
from tidegauge.session import stage

LENGTH = 50
GRAM = 16

_LOW = np.uint64(0xFFFFFFFF)
_KEYS = (0x8CB92BA72F3D8DD7, 0xD1B54A32D192ED03)


def blocks(hashes: np.ndarray, row: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """First and last window start of each block and the hash of its owner k-gram."""
    if len(hashes) < length:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    grams = run_hashes(hashes, gram)
    place = np.arange(len(grams), dtype=np.uint64)
    least = sliding_min((grams & ~_LOW) | (_LOW - place), length - gram + 1)
    owner = (_LOW - (least & _LOW)).astype(np.int64)
    inside = row[: len(least)] == row[length - 1 :]
    start = inside.copy()
    start[1:] &= ~inside[:-1] | (owner[1:] != owner[:-1]) | (row[1 : len(least)] != row[: len(least) - 1])
    low = np.flatnonzero(start)
    end = inside.copy()
    end[:-1] &= ~inside[1:] | start[1:]
    return low, np.flatnonzero(end), grams[owner[low]]


def digests(words: Words) -> list[str]:
    """SHA-256 of each row's words, joined by one blank."""
    joined, start, end = spaced(words)
    view = memoryview(joined)
    first = words.first
    return [
        hashlib.sha256(view[start[first[r]] : end[first[r + 1] - 1]] if first[r + 1] > first[r] else b"").hexdigest()
        for r in range(len(first) - 1)
    ]


def _parse(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = find_words(part.column(2), NOT_SPACE)
                hashes, row = words.hashes(), words.row
                low, high, owner = blocks(hashes, row, length, gram)
                at = row[low] if len(low) else row[:0]
                spans = [Prefix(hashes, key).of(low, high + length) for key in _KEYS] if len(low) else [owner, owner]
                base = words.first[at]
                found = pa.StructArray.from_arrays(
                    [signed(owner), signed(spans[0]), signed(spans[1]), pa.array((low - base).astype(np.int32)), pa.array((high - base).astype(np.int32))],
                    names=["owner", "a", "b", "low", "high"],
                )
                yield pa.record_batch(
                    [part.column(0), part.column(1), pa.array(words.counts, pa.int64()), pa.array(digests(words), pa.string()), list_array(found, at, part.num_rows)],
                    names=["doc_id", "text_hash", "n_words", "sha", "blocks"],
                )

    return run


def _boundary_windows(length: int):
    """Rows of (doc_id, text_hash, text, lows, highs) to one row for each window start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = find_words(part.column(2), NOT_SPACE)
                hashes = words.hashes()
                lows, highs = part.column(3), part.column(4)
                of = np.repeat(np.arange(part.num_rows), lows.value_lengths().to_numpy())
                low, high = (x.flatten().to_numpy().astype(np.int64) for x in (lows, highs))
                size = high - low + 1
                which = np.repeat(np.arange(len(low)), size)
                start = low[which] + np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
                at = start + words.first[of[which]]
                a, b = (Prefix(hashes, key).of(at, at + length) for key in _KEYS)
                take = pa.array(of[which])
                yield pa.record_batch(
                    [part.column(0).take(take), part.column(1).take(take), pa.array(start.astype(np.int32)), signed(a), signed(b)],
                    names=["doc_id", "text_hash", "start", "a", "b"],
                )

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (doc_id, text_hash, text, starts, ends) to the figures of the words kept."""
    for batch in batches:
        for part in slices(batch):
            words = find_words(part.column(2), NOT_SPACE)
            starts, ends = part.column(3), part.column(4)
            base = words.first[np.repeat(np.arange(part.num_rows), starts.value_lengths().to_numpy())]
            depth = np.zeros(len(words.start) + 1, np.int64)
            np.add.at(depth, base + starts.flatten().to_numpy(), 1)
            np.add.at(depth, base + ends.flatten().to_numpy(), -1)
            kept = np.cumsum(depth[:-1]) == 0
            before = np.concatenate([[0], np.cumsum(kept)])[words.first]
            left = Words(words.data, words.start[kept], words.end[kept], before)
            yield pa.record_batch(
                [part.column(0), part.column(1), pa.array(words.counts - left.counts, pa.int64()), pa.array(digests(left), pa.string())],
                names=["doc_id", "text_hash", "n_removed", "sha_left"],
            )


def _spans_of(docs: DataFrame, spans: DataFrame, *lists: str) -> DataFrame:
    """(doc_id, text_hash, text, list columns) of documents that have spans.

    Lists are bounded by a document's length.  The bit table drops other documents in the
    scan, so their texts are not shuffled.
    """
    grouped = stage(spans.groupBy("doc_id", "text_hash").agg(*[F.collect_list(c).alias(c) for c in lists]))
    table = docs.sparkSession.sparkContext.broadcast(bittable.collect_bits(grouped, "text_hash"))

    @F.pandas_udf("boolean")
    def wanted(keys):
        import pandas as pd

        return pd.Series(bittable.member(table.value, keys.to_numpy()))

    return docs.where(wanted("text_hash")).join(grouped, ["doc_id", "text_hash"])


def duplicate_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """All documents (doc_id, text_hash, n_words, sha) and the spans of words to remove.

    Spans are (doc_id, text_hash, start, end) in words from 0; they may overlap.
    """
    own = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    base = stage(own.mapInArrow(
        _parse(length, gram),
        f"doc_id {id_type}, text_hash bigint, n_words bigint, sha string, blocks array<struct<owner:bigint,a:bigint,b:bigint,low:int,high:int>>"))
    indexed = base.where(F.col("doc_id").isNotNull()).select("doc_id", "text_hash", F.inline("blocks"))
    # grouped sides are written first: only between two plain tables can Spark split a hot key
    shared = stage(indexed.groupBy("owner").agg(F.min("doc_id").alias("m"), F.max("doc_id").alias("x")).where("m < x").select("owner"))
    known = stage(indexed.join(shared, "owner", "left_semi").drop("owner"))
    first = stage(known.groupBy("a", "b").agg(F.min("doc_id").alias("origin")))
    parsed = stage(known.join(first, ["a", "b"]).select(
        "doc_id", "text_hash", "low", "high", (F.col("origin") < F.col("doc_id")).alias("factor")))
    rest = parsed.where(~F.col("factor")).select("doc_id", "text_hash", F.col("low").alias("lows"), F.col("high").alias("highs"))
    windows = stage(_spans_of(own, rest, "lows", "highs").select("doc_id", "text_hash", "text", "lows", "highs").mapInArrow(
        _boundary_windows(length), f"doc_id {id_type}, text_hash bigint, start int, a bigint, b bigint"))
    seen = stage(windows.groupBy("a", "b").agg(F.min("doc_id").alias("m"), F.max("doc_id").alias("x")).where("m < x").drop("x"))
    spans = (
        windows.join(seen, ["a", "b"])
        .where(F.col("m") < F.col("doc_id"))
        .select("doc_id", "text_hash", "start", (F.col("start") + length).alias("end"))
        .unionByName(parsed.where("factor").select("doc_id", "text_hash", F.col("low").alias("start"), (F.col("high") + length).alias("end")))
    )
    return base.select("doc_id", "text_hash", "n_words", "sha"), spans


def dedup_substrings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row a document: doc_id, n_words, n_removed, kept_sha256."""
    base, spans = duplicate_spans(docs, length, gram)
    own = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    cut = (
        _spans_of(own, spans.withColumnsRenamed({"start": "starts", "end": "ends"}), "starts", "ends")
        .select("doc_id", "text_hash", "text", "starts", "ends")
        .mapInArrow(_cut, f"doc_id {id_type}, text_hash bigint, n_removed bigint, sha_left string")
        .dropDuplicates(["doc_id", "text_hash"])
    )
    return base.join(cut, ["doc_id", "text_hash"], "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("sha_left", "sha").alias("kept_sha256"))


def op7_relative_lz(spark: SparkSession, folder: str) -> DataFrame:
    return dedup_substrings(spark.read.parquet(f"{folder}/documents.parquet"))


OP7_SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS win
  FROM words, unnest(range(1, len(w) - 48)) AS s(i) WHERE len(w) >= 50),
firsts AS (SELECT win, min(doc_id) AS origin FROM windows GROUP BY win),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p
  FROM windows JOIN firsts USING (win) WHERE origin < doc_id),
placed AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM words),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n
  FROM placed ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""
