"""Two-pass external shuffle of a corpus into shards.

Pass 1 scatters records by a seeded hash of id and text into buckets that fit in memory; their
number follows the bytes of the input, about ``bucket_bytes`` each.  Pass 2 loads one
bucket at a time, puts it in a fixed order, shuffles it by Fisher-Yates with a generator
seeded by the bucket, and writes it.  The buckets in turn are one random order of all
records; shards are equal cuts of it, so their counts differ by at most one (law
``rows``).  Records, seed and bucket size alone decide the result, so a task that runs
again writes the same rows.

Where records go needs the count of each bucket before pass 2: one scan counts records and
bytes in ``CELLS`` cells of the hash, so the driver gets at most that many rows, and
buckets are runs of whole cells.

Rows: repeated and null ids are scattered by their texts, so a third of all rows may have one
id; only rows equal in both id and text share a bucket, whatever its size; null texts count 16
bytes; empty tables give no rows; all columns are kept, inside the struct ``record``, so their
names cannot clash with the added ones.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.session import shared_folder

SHARDS = 40
BUCKET_BYTES = 16 << 20
#: up to 65,536 buckets, 1 TB at the default size; raise both for more
CELLS = 1 << 16
SEED = 42


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text, and 16."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def fisher_yates(n: int, seed: int) -> list[int]:
    """A random order of 0 .. n - 1: each place in turn is swapped with one at or before it."""
    random = np.random.Generator(np.random.PCG64(seed))
    draws = (random.random(n) * np.arange(1, n + 1)).astype(np.int64).tolist()
    order = list(range(n))
    for i in range(n - 1, 0, -1):
        j = draws[i]
        order[i], order[j] = order[j], order[i]
    return order


def cell_of(cells: int, seed: int) -> Column:
    """The record's cell, from id and text."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")), F.lit(cells)).cast("int")


def _shuffle(starts: np.ndarray, total: int, shards: int, seed: int):
    """Rows of (bucket, record), whole buckets one after another, to shuffled records with their places."""

    def shuffled(bucket: int, held: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        records = pa.concat_arrays(held)
        rank = starts[bucket] + np.arange(len(records))
        numbers = rank * shards // total
        slots = rank - -(-numbers * total // shards)
        order = np.array(fisher_yates(len(records), seed * 1_000_003 + bucket), np.int64)
        for low in range(0, len(order), 4096):
            part = slice(low, low + 4096)
            yield pa.record_batch(
                [records.take(pa.array(order[part])), pa.array(numbers[part].astype(np.int32)), pa.array(slots[part])], names=["record", "shard", "slot"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = -1, []
        for batch in batches:
            buckets = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), batch.num_rows]
            for low, high in zip(edges, edges[1:], strict=False):
                if low == high:
                    continue
                if buckets[low] != current and held:
                    yield from shuffled(current, held)
                    held = []
                current = int(buckets[low])
                held.append(batch.column(1).slice(low, high - low))
        if held:
            yield from shuffled(current, held)

    return run


def shard(docs: DataFrame, path: str, shards: int = SHARDS, bucket_bytes: int = BUCKET_BYTES, cells: int = CELLS, seed: int = SEED) -> DataFrame:
    """Writes the records of ``docs`` in random order under ``path``, one folder a shard, and reads them back.

    Columns: ``record`` (all columns), ``shard`` (0 to shards - 1), ``slot`` (from 0, gapless).
    """
    record = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    cell = cell_of(cells, seed)
    sizes = docs.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.sum(record_size(F.col("text"))).alias("bytes")).toArrow()
    counts, total_bytes = np.zeros(cells, np.int64), int(np.sum(sizes.column("bytes").to_numpy()))
    counts[sizes.column("cell").to_numpy()] = sizes.column("n").to_numpy()
    total = int(counts.sum())
    buckets = min(cells, max(1, -(-total_bytes // bucket_bytes)))
    per_bucket = np.bincount(np.arange(cells) * buckets // cells, weights=counts, minlength=buckets).astype(np.int64)
    starts = np.cumsum(per_bucket) - per_bucket

    scattered = (
        docs.select(
            F.floor(cell.cast("long") * buckets / cells).cast("int").alias("bucket"), record.alias("record"),
            F.xxhash64(F.lit(seed + 1), F.col("doc_id"), F.col("text")).alias("tie"))
        .repartitionById(buckets, F.col("bucket"))
        .sortWithinPartitions("bucket", "tie")
        .select("bucket", "record")
    )
    schema = f"record {scattered.schema['record'].dataType.simpleString()}, shard int, slot bigint"
    if total:
        scattered = scattered.mapInArrow(_shuffle(starts, total, shards, seed), schema)
    else:
        scattered = scattered.select("record", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    scattered.write.option("compression", "zstd").partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def op6_two_pass(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{shared_folder(spark).rstrip('/')}/shards-{uuid.uuid4().hex}"
    placed = shard(spark.read.parquet(f"{folder}/documents.parquet"), path)
    text = F.col("record.text")
    return placed.select(
        F.col("record.doc_id").alias("doc_id"), record_size(text).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
