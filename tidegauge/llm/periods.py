"""Periodic runs of words, found by block convolution at dyadic scales.

Words are `[^\\x20\\x09-\\x0D]+`.  A run is a stretch with smallest period q and at least
max(``least``, 2 q) words that no neighbouring word extends.

1. Scales m = 2, 4, 8, ...: the words are cut into aligned blocks of m.  A run of period
   2m - 1 to 4m - 2 (from 1 at the smallest scale) holds an aligned block among its first q
   words, and that block comes again q words later.
2. Zero mismatches: the sum of squared differences between a block and every place of the
   window after it is the block's squares plus the window's, less twice their correlation.
   The correlation is an integer convolution: by a number-theoretic transform modulo a
   prime, many blocks at once, and by direct comparison at scales below ``NTT``, where a
   transform costs more.  A block with a word that does not come again within reach cannot
   match and is left out.
3. Extension: each zero's distance is a period; common extensions to both sides give the
   whole stretch.  Of the periods found for one stretch the smallest is its period.  Runs
   are compared word by word at the end, so a sum that is zero modulo the prime only, or a
   chance of hashes, adds none.

All documents of an Arrow slice are convolved together; a document's words are numbered
apart from all others, so nothing matches across documents.  Work is n log^2 n of a text's
words whatever they repeat, and no rows are exchanged.

Rows: null and empty texts have no words and no runs; every row gives one row, repeated or
not; null ids are carried along; texts of any length are one piece; empty tables give empty
results; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.bytewords import NOT_SPACE, Prefix, Words, find_words, list_array, mix, slices, spaced
from tidegauge.llm.conversations import CRC_SQL

LEAST = 12
#: blocks of this many words and more are transformed
NTT = 32
PRIME, ROOT = 998_244_353, 3
#: numbers transformed, and matches extended, at a time
LANES = 1 << 18


def _twiddles(size: int, root: int) -> list[np.ndarray]:
    """Powers of the roots of unity of each halving step."""
    out, length = [], size
    while length > 1:
        w = pow(root, (PRIME - 1) // length, PRIME)
        powers = np.ones(length // 2, np.int64)
        have = 1
        while have < length // 2:
            powers[have : 2 * have] = powers[:have] * pow(w, have, PRIME) % PRIME
            have *= 2
        out.append(powers)
        length //= 2
    return out


def transform(rows: np.ndarray, twiddles: list[np.ndarray]) -> np.ndarray:
    """Number-theoretic transform of each row, in bit-reversed order."""
    count, size = rows.shape
    for w in twiddles:
        pairs = rows.reshape(count, -1, 2, len(w))
        low, high = pairs[:, :, 0], pairs[:, :, 1]
        rows = np.stack([(low + high) % PRIME, (low - high) % PRIME * w % PRIME], axis=2)
    return rows.reshape(count, size)


def inverse(rows: np.ndarray, twiddles: list[np.ndarray]) -> np.ndarray:
    """Rows back from bit-reversed order; ``twiddles`` are those of the inverse root."""
    count, size = rows.shape
    for w in reversed(twiddles):
        pairs = rows.reshape(count, -1, 2, len(w))
        low, high = pairs[:, :, 0], pairs[:, :, 1] * w % PRIME
        rows = np.stack([(low + high) % PRIME, (low - high) % PRIME], axis=2)
    return rows.reshape(count, size) * pow(size, -1, PRIME) % PRIME


def correlations(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Row by row, the sums of products of a block with each place of its window, modulo the prime."""
    m, size = blocks.shape[1], 1
    while size < windows.shape[1]:
        size *= 2
    ahead, back = _twiddles(size, ROOT), _twiddles(size, pow(ROOT, -1, PRIME))
    padded = np.zeros((2, len(blocks), size), np.int64)
    padded[0, :, :m] = blocks[:, ::-1]
    padded[1, :, : windows.shape[1]] = windows
    a, b = (transform(p, ahead) for p in padded)
    return inverse(a * b % PRIME, back)[:, m - 1 : windows.shape[1]]


def _matches(ids: np.ndarray, comes_again: np.ndarray, m: int, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(block start, distance) where a block of m comes again ``low`` to ``high`` words later."""
    n = len(ids) // m
    alive = np.flatnonzero(comes_again[: n * m].reshape(n, m).max(axis=1) <= high) * m
    if not len(alive):
        return
    width = high - low + m
    far = np.concatenate([ids, -1 - np.arange(high + m)])  # no word equals these
    if m < NTT:
        for distance in range(low, high + 1):
            same = np.ones(len(alive), bool)
            for j in range(m):
                same &= ids[alive + j] == far[alive + j + distance]
            yield alive[same], np.full(int(same.sum()), distance)
        return
    values = far % PRIME
    squares = np.concatenate([[0], np.cumsum(values * values % PRIME)])
    step = max(1, LANES // (4 * m))
    for at in range(0, len(alive), step):
        start = alive[at : at + step]
        blocks = values[start[:, None] + np.arange(m)]
        first = start[:, None] + low + np.arange(width - m + 1)
        both = correlations(blocks, values[start[:, None] + low + np.arange(width)])
        own = (squares[start + m] - squares[start])[:, None]
        apart = (own + squares[first + m] - squares[first] - 2 * both) % PRIME
        which, shift = np.nonzero(apart == 0)
        yield start[which], shift + low


def _gathered(matches: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same matches in pieces of about ``LANES``."""
    held, size = [], 0
    for match in matches:
        held.append(match)
        size += len(match[0])
        if size >= LANES:
            yield tuple(np.concatenate(c) for c in zip(*held, strict=True))
            held, size = [], 0
    if size:
        yield tuple(np.concatenate(c) for c in zip(*held, strict=True))


def _extend(prefix: Prefix, n: int, start: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 word of the stretch about each match, by bisection on hashes of runs."""

    def reach(limit: np.ndarray, same: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        good, bad = np.zeros(len(limit), np.int64), limit + 1
        while (bad - good > 1).any():
            middle = (good + bad) // 2
            fits = (middle > good) & same(middle)
            bad = np.where(~fits & (middle > good), middle, bad)
            good = np.where(fits, middle, good)
        return good

    right = reach(n - start - distance, lambda k: prefix.of(start, start + k) == prefix.of(start + distance, start + distance + k))
    left = reach(start.copy(), lambda k: prefix.of(start - k, start) == prefix.of(start + distance - k, start + distance))
    return start - left, start + distance + right


def find_runs(ids: np.ndarray, longest: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of all runs, by start and period.

    ``ids`` are numbers of words, at most ``longest`` of which belong to one document.
    """
    n = len(ids)
    none = np.zeros(0, np.int64)
    if n < least:
        return none, none, none
    order = np.argsort(ids, kind="stable")
    comes_again = np.full(n, n, np.int64)
    repeats = ids[order[1:]] == ids[order[:-1]]
    comes_again[order[:-1][repeats]] = (order[1:] - order[:-1])[repeats]
    prefix = Prefix(mix(ids.astype(np.uint64) + np.uint64(1)), 0xD6E8FEB86659FD93)
    found, m = [], 2
    while m == 2 or 2 * (2 * m - 1) <= longest:
        low, high = (1 if m == 2 else 2 * m - 1), 4 * m - 2
        for starts, distances in _gathered(_matches(ids, comes_again, m, low, high)):
            # neighbouring blocks with one distance lie in one stretch; the first seeds it
            by = np.lexsort((starts, distances))
            starts, distances = starts[by], distances[by]
            fresh = np.ones(len(starts), bool)
            fresh[1:] = (distances[1:] != distances[:-1]) | (starts[1:] != starts[:-1] + m)
            start, distance = starts[fresh], distances[fresh]
            first, end = _extend(prefix, n, start, distance)
            whole = end - first >= np.maximum(least, 2 * distance)
            found.append(np.unique(np.stack([first[whole], end[whole], distance[whole]]), axis=1))
        m *= 2
    if not found:
        return none, none, none
    first, end, period = np.unique(np.concatenate(found, axis=1), axis=1)
    if len(first):
        smallest = np.concatenate([[True], (first[1:] != first[:-1]) | (end[1:] != end[:-1])])
        first, end, period = first[smallest], end[smallest], period[smallest]
    true = np.array([np.array_equal(ids[s : e - q], ids[s + q : e]) for s, e, q in zip(first.tolist(), end.tolist(), period.tolist(), strict=True)], bool)
    first, end, period = first[true], end[true], period[true]
    by = np.lexsort((period, first))
    return first[by], (end - first)[by], period[by]


def _worker(least: int, prepare: Callable[[pa.RecordBatch], pa.RecordBatch] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                part = prepare(part) if prepare else part
                words = find_words(part.column(1), NOT_SPACE)
                row, counts = words.row, words.counts
                ids = np.unique(words.hashes() ^ mix(row.astype(np.uint64) + np.uint64(1)), return_inverse=True)[1].astype(np.int64)
                start, length, period = find_runs(ids, int(counts.max(initial=0)), least)
                depth = np.zeros(len(ids) + 1, np.int64)
                np.add.at(depth, start + period, 1)
                np.add.at(depth, start + length, -1)
                kept = np.cumsum(depth[:-1]) == 0
                before = np.concatenate([[0], np.cumsum(kept)])[words.first]
                joined, opens, ends = spaced(Words(words.data, words.start[kept], words.end[kept], before))
                texts = [joined[opens[i] : ends[j - 1]].decode() if j > i else "" for i, j in zip(before[:-1].tolist(), before[1:].tolist(), strict=True)]
                of = row[start] if len(start) else row[:0]
                runs = pa.StructArray.from_arrays([pa.array(start - words.first[of]), pa.array(length), pa.array(period)], names=["start", "length", "period"])
                yield pa.record_batch(
                    [part.column(0), pa.array(counts, pa.int64()), list_array(runs, of, part.num_rows), pa.array(texts, pa.string())],
                    names=["doc_id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, least: int = LEAST, prepare: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period), collapsed.

    ``collapsed`` has the words that no run contains after its first period, joined by one
    blank.  ``prepare`` may change the texts of a slice of rows (doc_id, text) first.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        _worker(least, prepare), f"doc_id {id_type}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def planted(part: pa.RecordBatch) -> pa.RecordBatch:
    """The query's texts: one document in ten is periodic from some word on; a null id is not."""
    texts = []
    for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
        h = 1 if doc is None else zlib.crc32(str(doc).encode())
        words = _WORD.findall(text or "") if h % 10 == 0 else []
        if words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            text = " ".join([*words[:a], *(words[a + k % p] for k in range(n - a))])
        texts.append(text)
    return pa.record_batch([part.column(0), pa.array(texts, part.column(1).type)], names=part.schema.names)


def op13_block_convolution(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs(spark.read.parquet(f"{folder}/documents.parquet"), prepare=planted)
    best = F.sort_array(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return found.withColumn("best", F.get(best, F.lit(0))).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.less")).alias("length"),
        F.col("best.period").alias("period"), F.expr("-best.less * 1000 div best.period").alias("exponent_milli"),
        sha(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"))


OP13_SQL = CRC_SQL + r"""
told AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
drawn AS (
  SELECT doc_id, w, len(w) AS n,
         xor(list_reduce([4294967295] || [ord(c) FOR c IN string_split(doc_id::VARCHAR, '')], lambda s, c: xor(t[xor(s, c) % 256 + 1], s // 256)), 4294967295) AS h
  FROM told, steps),
starts AS (SELECT *, (h // 10) % greatest(n, 1) AS a, (h // 10) % 8 + 3 AS k FROM drawn),
words AS (
  SELECT doc_id, i, CASE WHEN h % 10 = 0 AND i >= a THEN w[1 + a + (i - a) % (1 + (n - a) // k)] ELSE w[1 + i] END AS word
  FROM starts, unnest(range(0, n)) AS s(i)),
same AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM same),
stretches AS (SELECT doc_id, q, min(i) AS low, max(i) + 1 + q AS high FROM islands GROUP BY doc_id, q, island),
runs AS (
  SELECT doc_id, low AS start, high - low AS length, min(q) AS period FROM stretches
  WHERE high - low >= greatest(12, 2 * q) GROUP BY ALL),
per_doc AS (
  SELECT doc_id, count(*) AS n_runs, arg_min(struct_pack(start, length, period), (-length, start, period)) AS best,
         string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS lines
  FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period,
       1000 * best.length // best.period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM told LEFT JOIN per_doc USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
