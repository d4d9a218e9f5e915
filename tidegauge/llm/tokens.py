"""Token ids of a corpus in one order, written as Simple-8b chunks and read back.

A byte-level BPE never joins across the place between a word and the white space after it,
so a text is cut there and each distinct piece is encoded once a worker (bounded memory of
pieces; a full one encodes, but does not keep).  Texts with white space other than ASCII
are encoded whole.

File format: a Parquet folder; a row is a chunk of documents that follow one another:
``part`` and ``seq`` (order), ``first`` (ids before it in its part), ``doc_ids``,
``lengths`` (uint32), ``n_ids``, ``words`` (uint64), ``blocks`` (uint32 word offset of
every 1,024 ids) and ``raw`` (uint32 indexes of escaped words), all little-endian.  Parts
are ranges of (doc_id, text hash), so a repeated id cannot fill one part; a chunk ends
after ``CHUNK`` ids.  Spark's commit protocol writes whole parts or none.

Rows: null texts are empty and have the end id only; null ids come first; repeated rows
follow each other; empty tables give an empty folder; other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import simple8b
from tidegauge.llm.bytewords import slices
from tidegauge.session import shared_folder

END_ID = 2
CHUNK = 1 << 18
KEPT_PIECES = 300_000

UNIT = re.compile(r"[\t-\r ]*[^\t-\r ]+|[\t-\r ]+")
#: white space that is not ASCII, and separators that only some libraries call white space
ODD_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: the split of byte-level BPE, a fixed value of the tokenizer's format
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
LATIN = re.compile(r"[\x00-\u024f]*")
#: the most common shape of a piece, which SPLIT cuts at the same places
PLAIN = re.compile(r"(\n?)( ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f]+)([!-&(-/:-@\[-`{-~]*)")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Encoder(dict):
    """From a piece of text to its ids as little-endian uint32 bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        before = spec.get("pre_tokenizer") or {}
        self.cuts = (
            spec.get("normalizer") is None and before.get("type") == "ByteLevel"
            and not before.get("add_prefix_space") and before.get("use_regex", True) and spec["model"]["type"] == "BPE"
        )
        self.letters = byte_alphabet()
        self.words: dict[str, bytes] = {}
        self.coded = [np.array([i], "<u4").tobytes() for i in range(self.library.get_vocab_size())]

    def _library(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        if not word:
            return b""
        if word.isascii() and word.lstrip(" ").isprintable() and " " not in word[1:]:
            mapped = word.replace(" ", self.letters[32])
        else:
            letters = self.letters
            mapped = "".join([letters[b] for b in word.encode()])
        coded = self.coded
        ids = b"".join([coded[t.id] for t in self.library.model.tokenize(mapped)])
        if len(self.words) < KEPT_PIECES:
            self.words[word] = ids
        return ids

    def __missing__(self, unit: str) -> bytes:
        known = self.words
        if shape := PLAIN.fullmatch(unit):
            ids = b"".join([known.get(w) or self._word(w) for w in shape.groups()])
        elif LATIN.fullmatch(unit):
            ids = b"".join([known.get(w) or self._word(w) for w in SPLIT.findall(unit)])
        else:
            ids = self._library(unit)
        if len(self) < KEPT_PIECES:
            self[unit] = ids
        return ids

    def text(self, text: str) -> bytes:
        if not self.cuts or ODD_SPACE.search(text):
            return self._library(text)
        return b"".join(map(self.__getitem__, UNIT.findall(text)))


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _pack(path: str, end_id: int, id_type: pa.DataType):
    def chunk(part: int, seq: int, first: int, ids: list, coded: list[bytes]) -> pa.RecordBatch:
        tokens = np.frombuffer(b"".join(coded), "<u4").astype(np.uint64)
        words, offsets, raw = simple8b.encode(tokens)
        lengths = np.array([len(c) // 4 for c in coded], "<u4")
        return pa.record_batch(
            [
                pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([first], pa.int64()),
                pa.array([ids], pa.list_(id_type)), pa.array([lengths.tobytes()]), pa.array([len(tokens)], pa.int64()),
                pa.array([words.astype("<u8").tobytes()]), pa.array([offsets.astype("<u4").tobytes()]), pa.array([raw.astype("<u4").tobytes()]),
            ],
            names=["part", "seq", "first", "doc_ids", "lengths", "n_ids", "words", "blocks", "raw"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path), np.array([end_id], "<u4").tobytes()
        part, seq, first, held = TaskContext.get().partitionId(), 0, 0, 0
        ids: list = []
        coded: list[bytes] = []
        for batch in batches:
            for piece in slices(batch):
                for doc_id, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    ids.append(doc_id)
                    coded.append(encode.text(text or "") + end)
                    held += len(coded[-1]) // 4
                    if held >= CHUNK:
                        yield chunk(part, seq, first, ids, coded)
                        seq, first, held, ids, coded = seq + 1, first + held, 0, [], []
        if ids:
            yield chunk(part, seq, first, ids, coded)

    return run


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID) -> None:
    """All documents in ascending id order into the folder ``path``."""
    kind = docs.schema["doc_id"].dataType
    id_type = {"bigint": pa.int64(), "int": pa.int32()}.get(kind.simpleString(), pa.string())
    id_name = kind.simpleString() if kind.simpleString() in ("bigint", "int") else "string"
    ordered = (
        docs.select(F.col("doc_id").cast(id_name).alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("tie"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
    )
    ordered.mapInArrow(
        _pack(tokenizer, end_id, id_type),
        f"part int, seq bigint, first bigint, doc_ids array<{id_name}>, lengths binary, n_ids bigint, words binary, blocks binary, raw binary",
    ).write.option("compression", "zstd").parquet(path)


def _unpack(starts: dict[int, int], id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, first, doc_ids, lengths, n, words, blocks, raw = (batch.column(c)[row] for c in range(8))
                of = lambda x, kind: np.frombuffer(x.as_buffer(), kind)
                ids = simple8b.decode(of(words, "<u8"), of(blocks, "<u4"), of(raw, "<u4"), n.as_py()).astype("<u4")
                sizes = of(lengths, "<u4").astype(np.int64)
                ends = np.cumsum(sizes)
                view = memoryview(ids.view(np.uint8))
                sums = [zlib.crc32(view[4 * (e - s) : 4 * e]) for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)]
                yield pa.record_batch(
                    [doc_ids.values.cast(id_type), pa.array(starts[part.as_py()] + first.as_py() + ends - sizes), pa.array(sizes), pa.array(sums, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return run


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row a document from the files: doc_id, start, n_tokens, ids_crc32.

    The driver gets one total for each part that was written.
    """
    files = spark.read.parquet(path)
    starts, total = {}, 0
    for part, n in sorted(files.groupBy("part").agg(F.sum("n_ids")).collect()):
        starts[part] = total
        total += n
    name = files.schema["doc_ids"].dataType.elementType.simpleString()
    id_type = {"bigint": pa.int64(), "int": pa.int32()}.get(name, pa.string())
    return files.select("part", "first", "doc_ids", "lengths", "n_ids", "words", "blocks", "raw").mapInArrow(
        _unpack(starts, id_type), f"doc_id {name}, start bigint, n_tokens bigint, ids_crc32 bigint")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op2_simple8b(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{shared_folder(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    write_tokens(spark.read.parquet(f"{folder}/documents.parquet"), tokenizer_path("byte_bpe_50k.json"), path)
    return read_tokens(spark, path)
