"""Substring deduplication of bytes by a distributed, sparse suffix array.

A byte goes when it lies in a string of ``length`` (50) bytes that also starts in a document
with a smaller id; whole texts are taken as UTF-8 bytes, matches never cross documents.

1. Anchors: of the hashes of ``gram`` bytes inside each window of ``length`` bytes the
   smallest owns the window; windows in a row with one owner are a block.  Equal windows
   have equal anchors at equal places, so only suffixes that start at an anchor are sorted.
   An anchor whose first ``gram`` bytes stand in one document alone is a literal and is left
   out: a bit table drops most of these in the scan, and nothing depends on it.
2. Buckets: the suffixes (from the anchor to the end of its block's last window, with the
   bytes before it and the block's places) are range-partitioned by their leading bytes;
   Spark samples the splitters.  The id is part of the order, so a suffix that a third of
   all documents share is cut like everything else.
3. Local sort: a bucket's sorted suffixes are taken in slices of bounded size.  Blocks with
   equal bytes are one, the windows of all blocks are sorted by multikey quicksort (eight
   bytes at a time, each step only inside runs that are still equal), and a window goes when
   its run has a smaller id.
4. Boundaries: a window whose bytes from the anchor on are also those of the first or the
   last suffix of a slice may have its like in another slice.  Those of the smallest id of
   each run meet once more on the whole window, by a grouped minimum and a join.

Equality is that of bytes, but for two 64-bit hashes where windows meet across slices.
Rows exchanged follow the number of anchors, about one in nine bytes that other documents
share and one in nine hashes of the rest, never pairs of documents.

Rows: a document is its id and a 32-bit hash of its text, so that repeated ids stay apart;
null texts are empty; rows with a null id are kept whole and are no reference; rows
with one id are compared with smaller ids only, so repeated rows keep each other; empty
tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import bittable
from tidegauge.llm.bytewords import list_array, mix, signed, slices, sliding_min, text_bytes
from tidegauge.session import stage

LENGTH = 50
GRAM = 16
#: suffixes of a bucket sorted at a time
SLICE = 1 << 15
#: bits of the table that drops literals: sixteen a key, between these powers of two
LEAST_BITS, MOST_BITS = 20, 27

_LOW = np.uint64(0xFFFFFFFF)
_NONE = np.zeros(0, np.int64)


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of every ``gram`` bytes (8 to 16), from two overlapping words of eight."""
    x = data.astype(np.uint64)
    for step in (1, 2, 4):
        x = x[:-step] | (x[step:] << np.uint64(8 * step))
    return mix(x[: len(x) - gram + 8] * np.uint64(0x9E3779B97F4A7C15) + (x[gram - 8 :] ^ np.uint64(0xD6E8FEB86659FD93)))


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Row, first and last window start, anchor and anchor hash of each block of windows."""
    if len(data) < length:
        return _NONE, _NONE, _NONE, _NONE, np.zeros(0, np.uint64)
    grams = _gram_hashes(data, gram)
    least = sliding_min((grams & ~_LOW) | (_LOW - np.arange(len(grams), dtype=np.uint64)), length - gram + 1)
    owner = (_LOW - (least & _LOW)).astype(np.int64)
    ends = np.repeat(offsets[1:], np.diff(offsets))[: len(owner)]
    inside = np.arange(length, length + len(owner)) <= ends
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | (owner[1:] != owner[:-1]) | (ends[1:] != ends[:-1])
    low = np.flatnonzero(opens)
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | opens[1:]
    place = owner[low]
    return np.searchsorted(offsets, low, side="right") - 1, low, np.flatnonzero(closes), place, grams[place]


def _ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indices start .. start + size - 1 of each run, one run after another."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _binaries(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    bounds = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(bounds), pa.py_buffer(data[_ragged(start, size)])])


def _distinct_grams(length: int, gram: int):
    """Rows of text to the distinct anchor hashes of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                row, _, _, _, owner = anchors(*text_bytes(part.column(0)), length, gram)
                once = np.unique(mix(owner ^ mix(row.astype(np.uint64) + np.uint64(1))), return_index=True)[1]
                yield pa.record_batch([signed(owner[once])], names=["owner"])

    return run


def _suffixes(table, length: int, gram: int):
    """Rows of documents to the suffixes at anchors that other documents may share.

    A block's bytes that come again in one document are one row; ``lows`` has all places.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                data, offsets = text_bytes(part.column(2))
                row, low, high, place, owner = anchors(data, offsets, length, gram)
                known = bittable.member(table.value, owner.view(np.int64))
                row, low, high, place = row[known], low[known], high[known], place[known]
                sizes = high + length - low
                whole = _binaries(data, low, sizes).dictionary_encode().indices.to_numpy() if len(low) else _NONE
                by = np.lexsort((low, whole, row))
                fresh = np.ones(len(by), bool)
                fresh[1:] = (row[by][1:] != row[by][:-1]) | (whole[by][1:] != whole[by][:-1])
                first = by[fresh]
                lows = list_array(pa.array((low - offsets[row])[by].astype(np.int32)), np.cumsum(fresh) - 1, len(first))
                back = np.argsort(first)  # neighbours in a text stay neighbours, which packs well
                first, lows = first[back], lows.take(pa.array(back))
                take = pa.array(row[first])
                yield pa.record_batch(
                    [part.column(0).take(take), part.column(1).take(take), lows, _binaries(data, low[first], place[first] - low[first]),
                     _binaries(data, place[first], high[first] + length - place[first])],
                    names=["doc_id", "text_hash", "lows", "before", "suffix"])

    return run


def equal_runs(strings: np.ndarray) -> np.ndarray:
    """The number of the run of equal strings that each row of a byte matrix is in.

    Multikey quicksort: rows are split by their first eight bytes, then each run of more than
    one row by the next eight, and so on; runs of one row are done.
    """
    n, width = strings.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = strings
    tokens = padded.view(">u8").astype(np.uint64)
    run = np.zeros(n, np.int64)
    left, settled = np.arange(n), 0
    out = np.zeros(n, np.int64)
    for step in range(tokens.shape[1]):
        by = np.lexsort((tokens[left, step], run))
        left, run = left[by], run[by]
        key = tokens[left, step]
        opens = np.ones(len(left), bool)
        opens[1:] = (run[1:] != run[:-1]) | (key[1:] != key[:-1])
        run = np.cumsum(opens) - 1
        alone = opens & np.concatenate([opens[1:], [True]])
        count = int(alone.sum())
        out[left[alone]] = settled + np.arange(count)
        settled += count
        left, run = left[~alone], run[~alone]
        if not len(left):
            return out
    out[left] = settled + np.unique(run, return_inverse=True)[1]
    return out


def _common(data: np.ndarray, start: np.ndarray, size: np.ndarray, like: int) -> np.ndarray:
    """How many leading bytes each string shares with string number ``like``."""
    width = int(size.max())
    own = np.zeros(width + 1, np.uint8)
    own[: size[like]] = data[start[like] : start[like] + size[like]]
    at = np.minimum(start[:, None] + np.arange(width), len(data) - 1)
    reach = np.minimum(size, size[like])
    same = (data[at] == own[:width]) & (np.arange(width) < reach[:, None])
    return np.where(same.all(axis=1), width, np.argmin(same, axis=1))


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8), at - at[0]


def sort_slice(ids: np.ndarray, before: pa.Array, suffix: pa.Array, length: int) -> tuple[np.ndarray, ...]:
    """Windows of a slice of sorted suffixes that must go, and those open at its ends.

    (row, window) of both, and two hashes of the open ones; windows count from a row's first.
    """
    left, left_at = _bytes_of(before)
    right, right_at = _bytes_of(suffix)
    ahead, after = np.diff(left_at), np.diff(right_at)
    size = ahead + after
    data = np.empty(len(left) + len(right), np.uint8)
    start = np.concatenate([[0], np.cumsum(size)])[:-1]
    data[_ragged(start, ahead)] = left
    data[_ragged(start + ahead, after)] = right
    shared = np.maximum(_common(data, start + ahead, after, 0), _common(data, start + ahead, after, len(size) - 1))
    # equal blocks are one for the sort, under their smallest id
    block = _binaries(data, start, size).dictionary_encode().indices.to_numpy().astype(np.int64)
    by = np.lexsort((np.arange(len(ids)), ids, block))
    opens = np.concatenate([[True], block[by][1:] != block[by][:-1]])
    head = by[opens]  # of block number j
    windows = size - length + 1
    per = windows[head]
    of = np.repeat(np.arange(len(head)), per)
    window = _ragged(np.zeros(len(head), np.int64), per)
    strings = np.lib.stride_tricks.sliding_window_view(data, length)[start[head][of] + window]
    run = equal_runs(strings)
    least = np.full(int(run.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, run, ids[head][of])
    smallest = least[run]
    first = np.concatenate([[0], np.cumsum(per)])[:-1]
    # back to rows: row r's window w is window w of its block's head
    row = np.repeat(np.arange(len(ids)), windows)
    own = _ragged(np.zeros(len(ids), np.int64), windows)
    at = first[block[row]] + own
    gone = smallest[at] < ids[row]
    open_ended = ~gone & (length - (ahead[row] - own) <= shared[row])
    text = strings[at[open_ended]]
    words = np.zeros((len(text), -(-length // 8) * 8), np.uint8)
    words[:, :length] = text
    words = words.view(np.uint64)
    a, b = np.full(len(text), 1, np.uint64), np.full(len(text), 2, np.uint64)
    for c in words.T:
        a, b = mix(a * np.uint64(0x9E3779B97F4A7C15) ^ c), mix(b * np.uint64(0xD6E8FEB86659FD93) + c)
    return row[gone], own[gone], row[open_ended], own[open_ended], a, b


def _bucket(length: int, slice_rows: int):
    """Sorted suffixes to rows (doc_id, text_hash, lows, from, to, a, b): runs of windows that go, or open windows."""

    def settle(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        column = lambda c: rows.column(c).combine_chunks() if isinstance(rows.column(c), pa.ChunkedArray) else rows.column(c)
        ids = column("doc_id").to_numpy()
        row, own, open_row, open_own, a, b = sort_slice(ids, column("before"), column("suffix"), length)
        opens = np.ones(len(row), bool)
        opens[1:] = (row[1:] != row[:-1]) | (own[1:] != own[:-1] + 1)
        low = np.flatnonzero(opens)
        high = np.concatenate([low[1:], [len(row)]]) - 1 if len(low) else low
        take = pa.array(np.concatenate([row[low], open_row]))
        hashes = lambda x: pa.array(np.concatenate([np.zeros(len(low), np.int64), x.view(np.int64)]), mask=np.concatenate([np.ones(len(low), bool), np.zeros(len(x), bool)]))
        return pa.record_batch(
            [column("doc_id").take(take), column("text_hash").take(take), column("lows").take(take),
             pa.array(np.concatenate([own[low], open_own]).astype(np.int32)), pa.array(np.concatenate([own[high], open_own]).astype(np.int32)), hashes(a), hashes(b)],
            names=["doc_id", "text_hash", "lows", "low", "high", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                count += batch.num_rows
            while count >= slice_rows:
                rows = pa.Table.from_batches(held)
                yield settle(rows.slice(0, slice_rows))
                held = rows.slice(slice_rows).to_batches()
                count -= slice_rows
        if count:
            yield settle(pa.Table.from_batches(held))

    return run


def duplicate_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, slice_rows: int = SLICE) -> DataFrame:
    """Spans of bytes to remove: doc_id, text_hash, start, end (from 0; they may overlap).

    ``docs`` has doc_id (of an integer type, not null), text_hash and text.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    grams = docs.select("text").mapInArrow(_distinct_grams(length, gram), "owner bigint")
    shared = stage(grams.groupBy("owner").agg(F.count("*").alias("n")).where("n > 1").select("owner"))
    bits = min(max(LEAST_BITS, int(16 * shared.count()).bit_length()), MOST_BITS)
    table = docs.sparkSession.sparkContext.broadcast(bittable.collect_bits(shared, "owner", bits))
    # not written first: the scan is run once more for the sample of splitters, which costs less than a copy on disk
    suffixes = docs.select("doc_id", "text_hash", "text").mapInArrow(
        _suffixes(table, length, gram), f"doc_id {id_type}, text_hash int, lows array<int>, before binary, suffix binary")
    buckets = suffixes.repartitionByRange("suffix", "doc_id").sortWithinPartitions("suffix", "doc_id")
    found = stage(buckets.mapInArrow(
        _bucket(length, slice_rows), f"doc_id {id_type}, text_hash int, lows array<int>, low int, high int, a bigint, b bigint"))
    open_ended = found.where(F.col("a").isNotNull())
    first = stage(open_ended.groupBy("a", "b").agg(F.min("doc_id").alias("m"), F.max("doc_id").alias("x")).where("m < x").drop("x"))
    across = open_ended.join(first, ["a", "b"]).where(F.col("m") < F.col("doc_id"))
    columns = ("doc_id", "text_hash", "lows", "low", "high")
    runs = found.where(F.col("a").isNull()).select(*columns).unionByName(across.select(*columns))
    return runs.select("doc_id", "text_hash", "low", "high", F.explode("lows").alias("at")).select(
        "doc_id", "text_hash", (F.col("at") + F.col("low")).alias("start"), (F.col("at") + F.col("high") + length).alias("end"))


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            data, offsets = text_bytes(part.column(2))
            shas = [hashlib.sha256(data[i:j]).hexdigest() for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.record_batch([part.column(0), part.column(1), pa.array(np.diff(offsets)), pa.array(shas, pa.string())], names=["doc_id", "text_hash", "n_bytes", "sha"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (doc_id, text_hash, text, starts, ends) to what is left of each text."""
    for batch in batches:
        for part in slices(batch):
            data, offsets = text_bytes(part.column(2))
            starts, ends = part.column(3), part.column(4)
            base = np.repeat(offsets[:-1], starts.value_lengths().to_numpy())
            depth = np.bincount(base + starts.flatten().to_numpy(), minlength=len(data) + 1) - np.bincount(base + ends.flatten().to_numpy(), minlength=len(data) + 1)
            gone = np.cumsum(depth[:-1]) > 0
            opens = gone.copy()
            opens[1:] &= ~gone[:-1]
            opens[offsets[:-1][offsets[:-1] < len(data)]] |= gone[offsets[:-1][offsets[:-1] < len(data)]]
            total = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])
            left = data[~gone]
            cuts = np.concatenate([[0], np.cumsum(~gone)])[offsets].tolist()
            yield pa.record_batch(
                [part.column(0), part.column(1), pa.array(total(gone).astype(np.int64)), pa.array(total(opens).astype(np.int64)),
                 pa.array([left[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())],
                names=["doc_id", "text_hash", "n_removed", "n_spans", "kept"])


def remove_duplicates(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """What is left of the documents that have spans: doc_id, text_hash, n_removed, n_spans, kept.

    A document's spans are a list bounded by its length; the bit table drops other documents
    in the scan, so that their texts are not exchanged.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    grouped = stage(spans.groupBy("doc_id", "text_hash").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends")))
    table = docs.sparkSession.sparkContext.broadcast(bittable.collect_bits(grouped, "text_hash"))

    @F.pandas_udf("boolean")
    def wanted(keys):
        import pandas as pd

        return pd.Series(bittable.member(table.value, keys.to_numpy()))

    held = docs.where(wanted("text_hash")).join(grouped, ["doc_id", "text_hash"])
    return held.select("doc_id", "text_hash", "text", "starts", "ends").mapInArrow(
        _cut, f"doc_id {id_type}, text_hash int, n_removed bigint, n_spans bigint, kept binary")


def dedup_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, slice_rows: int = SLICE) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    own = docs.select("doc_id", F.hash("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    named = own.where(F.col("doc_id").isNotNull())
    left = remove_duplicates(named, duplicate_bytes(named, length, gram, slice_rows)).select(
        "doc_id", "text_hash", "n_removed", "n_spans", F.sha2("kept", 256).alias("sha_left")).dropDuplicates(["doc_id", "text_hash"])
    base = own.mapInArrow(_whole, f"doc_id {id_type}, text_hash int, n_bytes bigint, sha string")
    none = F.lit(0).cast("long")
    return base.join(left, ["doc_id", "text_hash"], "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"),
        F.coalesce("sha_left", "sha").alias("kept_sha256"))


def op12_suffix_array(spark: SparkSession, folder: str) -> DataFrame:
    return dedup_bytes(spark.read.parquet(f"{folder}/documents.parquet"))


OP12_SQL = r"""
WITH texts AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
pieces_of AS (SELECT doc_id, c, substr(x, 1000 * c + 1, 1098) AS piece FROM texts, unnest(range(0, len(x) // 1000 + 1)) AS s(c)),
windows AS (SELECT doc_id, 500 * c + j AS i, md5(substr(piece, 2 * j + 1, 100)) AS win FROM pieces_of, unnest(range(0, least(500, len(piece) // 2 - 49))) AS s(j)),
firsts AS (SELECT win, min(doc_id) AS origin FROM windows GROUP BY win),
hits AS (SELECT doc_id, i FROM windows JOIN firsts USING (win) WHERE origin < doc_id),
marked AS (SELECT doc_id, i, coalesce(i - lag(i) OVER w > 50, true) AS opens FROM hits WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
numbered AS (SELECT doc_id, i, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM marked),
spans AS (SELECT doc_id, n, min(i) AS low, max(i) + 50 AS high FROM numbered GROUP BY ALL),
edges AS (SELECT doc_id, high, low, lag(high, 1, 0) OVER (PARTITION BY doc_id ORDER BY n) AS before FROM spans),
pieces AS (
  SELECT doc_id, string_agg(substr(x, 2 * before + 1, 2 * (low - before)), '' ORDER BY low) AS kept, sum(high - low) AS n_removed, count(*) AS n_spans, max(high) AS tail
  FROM edges JOIN texts USING (doc_id) GROUP BY doc_id)
SELECT doc_id, len(x) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept || substr(x, 2 * tail + 1), x))) AS kept_sha256
FROM texts LEFT JOIN pieces USING (doc_id)
"""
