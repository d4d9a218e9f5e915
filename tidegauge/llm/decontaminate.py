"""Benchmark decontamination by winnowing.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z.  A window is
``length`` consecutive words of an item; an item with fewer words, but not none, is one
window.  A window of L words is found through fingerprints: of every L - k + 1 consecutive
k-gram hashes (k = L // 2 + 1) the smallest is kept, the rightmost on a tie.  The choice
depends on the window's words alone, so a document that holds the window keeps the same
fingerprint inside it: no shared span of L words can be missed.

1. Items and documents are fingerprinted, once for each window length that items have.
   A fixed-size bit table of the items' fingerprints lets other ones drop in the scan.
2. The fingerprints left are joined with the items' fingerprints.
3. Each hit is extended left and right to every window of L words that covers its k-gram,
   and the words of these windows are joined with the items' windows: equal words, no hash.

Items are listed once for each set of them that documents hit, not once a document: windows
of equal item sets are one class (two 64-bit XORs of the ids' hashes, and their number), a
document has the set of its classes, and equal sets share one list, its size and its digest.
So a passage of many documents and many items gives one row for each place and one for each
item.  A caller that leaves ``item_ids`` out never moves the lists.

Rows: nulls in ``text`` have no words; an item id that is null marks words but is not
listed; equal rows and repeated or null ids are documents of their own; empty tables give
empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.llm import bittable
from tidegauge.llm.bytewords import ALNUM, find_words, list_array, mix, run_hashes, signed, slices, sliding_min, spaced
from tidegauge.session import stage

WINDOW = 10

_CANDIDATES = "array<struct<len:int,fp:bigint,start:int,win:string>>"


def gram_size(length: int) -> int:
    """Words in a k-gram, so that L - k + 1 of them lie in each window of L words."""
    return length // 2 + 1


def winnow(hashes: np.ndarray, row: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and values of the fingerprints kept in runs of equal ``row``."""
    k = gram_size(length)
    width = length - k + 1
    if len(hashes) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = mix(run_hashes(hashes, k) + np.uint64(length))
    least = sliding_min(grams, width)
    whole = row[: len(least)] == row[length - 1 :]
    last = np.zeros(len(least), np.int64)
    for off in range(1, width):
        last[grams[off : off + len(least)] == least] = off
    at = np.unique(np.flatnonzero(whole) + last[whole])
    return at, grams[at]


def _item_windows(longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = find_words(part.column(1), ALNUM, lower=True)
                hashes, counts = words.hashes(), words.counts
                joined, start, end = spaced(words)
                ids, lengths, prints, windows = [], [], [], []
                for r in np.flatnonzero(counts):
                    a, n = int(words.first[r]), int(counts[r])
                    size = min(n, longest)
                    _, kept = winnow(hashes[a : a + n], np.zeros(n, np.int8), size)
                    ids.append(part.column(0)[int(r)].as_py())
                    lengths.append(size)
                    prints.append(kept.view(np.int64).tolist())
                    windows.append([joined[start[i] : end[i + size - 1]].decode() for i in range(a, a + n - size + 1)])
                yield pa.record_batch(
                    [pa.array(ids, pa.string()), pa.array(lengths, pa.int32()), pa.array(prints, pa.list_(pa.int64())), pa.array(windows, pa.list_(pa.string()))],
                    names=["item_id", "len", "fps", "wins"],
                )

    return run


def _document_candidates(lengths: list[int], table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = table.value
        for batch in batches:
            for part in slices(batch):
                words = find_words(part.column(2), ALNUM, lower=True)
                hashes, row, first = words.hashes(), words.row, words.first
                found: list[tuple[int, int, int, int]] = []
                for length in lengths:
                    at, prints = winnow(hashes, row, length)
                    may = bittable.member(bits, prints.view(np.int64))
                    for p, fp in zip(at[may].tolist(), prints[may].view(np.int64).tolist(), strict=True):
                        lowest = max(p - (length - gram_size(length)), int(first[row[p]]))
                        highest = min(p, int(first[row[p] + 1]) - length)
                        found.extend((s, length, fp, int(row[p])) for s in range(lowest, highest + 1))
                found.sort()
                at_row = np.array([f[3] for f in found], np.int64)
                joined, start, end = spaced(words) if found else (b"", None, None)
                structs = pa.StructArray.from_arrays(
                    [
                        pa.array([f[1] for f in found], pa.int32()),
                        pa.array([f[2] for f in found], pa.int64()),
                        pa.array([f[0] - int(first[f[3]]) for f in found], pa.int32()),
                        pa.array([joined[start[f[0]] : end[f[0] + f[1] - 1]].decode() for f in found], pa.string()),
                    ],
                    names=["len", "fp", "start", "win"],
                )
                yield pa.record_batch(
                    [part.column(0), part.column(1), pa.array(words.counts, pa.int64()), list_array(structs, at_row, part.num_rows)],
                    names=["row", "doc_id", "n_words", "found"],
                )

    return run


def decontaminate(docs: DataFrame, items: DataFrame, length: int = WINDOW) -> DataFrame:
    """One row a document: row, doc_id, n_words, n_hit, n_items, items_sha256, item_ids (sorted strings).

    ``row`` numbers the rows of ``docs`` as they are scanned; ``doc_id``, of any type, is
    carried along.
    """
    spark = docs.sparkSession
    test = stage(items.select(F.col("item_id").cast("string"), "text").mapInArrow(
        _item_windows(length), "item_id string, len int, fps array<bigint>, wins array<string>"))
    lengths = sorted(r[0] for r in test.select("len").distinct().collect())  # 1 .. length at most
    prints = test.select("len", F.explode("fps").alias("fp")).distinct()
    windows = test.select("item_id", F.explode("wins").alias("win")).distinct()
    table = spark.sparkContext.broadcast(bittable.collect_bits(prints, "fp"))
    mark = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), F.col("item_id")))
    classes = stage(windows.groupBy("win").agg(F.concat_ws(":", F.count(F.lit(1)), mark(1), mark(2)).alias("class")))
    members = classes.groupBy("class").agg(F.min("win").alias("win")).join(windows, "win").select("class", "item_id")

    base = stage(
        docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
            _document_candidates(lengths, table),
            f"row bigint, doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words bigint, found {_CANDIDATES}",
        )
    )
    hits = stage(
        base.where(F.size("found") > 0)
        .select("row", F.inline("found"))
        .join(prints, ["len", "fp"], "left_semi")
        .select("row", "start", "len", "win")
        .distinct()
        .join(classes, "win")
        .select("row", "start", "len", "class")
    )
    before = Window.partitionBy("row").orderBy("start", "len").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("len")
    covered = (
        hits.select("row", "start", "len")
        .withColumn("fresh", F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce(F.max(end).over(before), F.lit(0)))))
        .groupBy("row")
        .agg(F.sum("fresh").cast("long").alias("n_hit"))
    )
    sets = stage(
        hits.groupBy("row").agg(F.sort_array(F.collect_set("class")).alias("classes")).withColumn("set", F.sha2(F.array_join("classes", ","), 256)))
    lists = stage(
        sets.groupBy("set").agg(F.first("classes").alias("classes"))
        .select("set", F.explode("classes").alias("class"))
        .join(members, "class")
        .groupBy("set").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
        .select("set", "item_ids", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"))
    )
    named = sets.select("row", "set").join(lists, "set").drop("set")
    return (
        base.select("row", "doc_id", "n_words")
        .join(covered, "row", "left")
        .join(named, "row", "left")
        .select(
            "row", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
            F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
            F.coalesce("item_ids", F.expr("cast(array() as array<string>)")).alias("item_ids"),
        )
    )


def op4_winnowing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document against every item of ``benchmark``."""
    found = decontaminate(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


OP4_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM items, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM item_windows),
places AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM words, sizes, unnest(range(1, len(w) - n + 2)) AS s(i) WHERE len(w) >= n),
hits AS (SELECT doc_id, i, p.n, item_id FROM places p JOIN item_windows USING (win) WHERE p.n = item_windows.n),
n_hit AS (
  SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
n_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN n_hit USING (doc_id) LEFT JOIN n_items USING (doc_id)
"""
