"""SentencePiece encoding that keeps source offsets, and decoding.

``Normaliser`` reads the model file's normaliser: at each place the longest prefix that the
compiled character map (a double-array trie) knows is replaced, any other character is
copied, white space is folded and marked as the model says.  It records for every
normalised byte the source byte it came from, so the end of each piece projects to a place
in the original text, whatever the map replaced.

Pieces come from the library.  Where the model has no piece that joins a character to a
following blank mark, a text is cut before each run of marks (and about newlines when no
piece holds one), and each distinct cut is encoded once a worker; results are those of the
whole text.  Other models encode whole texts.

Rows: null texts are empty and give the end id only; nulls, repeated rows and other
columns are kept; empty tables give empty results.
"""

from __future__ import annotations

import functools
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.bytewords import slices
from tidegauge.llm.tokens import tokenizer_path

MARK = "▁"
KEPT_PIECES = 300_000


def proto_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol-buffer message; nested messages stay bytes."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class CharacterMap:
    """The compiled map: trie size, double array, then zero-ended replacements."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.replacements = blob[4 + size :]

    def __bool__(self) -> bool:
        return bool(self.units)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest known prefix of ``data[at:]`` and what replaces it."""
        units, found = self.units, None
        step = lambda unit: (unit >> 10) << ((unit >> 6) & 8)
        node = step(units[0])
        for length in range(1, len(data) - at + 1):
            byte = data[at + length - 1]
            node ^= byte
            if node >= len(units) or units[node] & 0x800000FF != byte:
                break
            unit = units[node]
            node ^= step(unit)
            if unit >> 8 & 1:
                found = length, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        start = found[1]
        return found[0], self.replacements[start : self.replacements.index(b"\0", start)]


class Normaliser:
    """Fixed defaults of the format: dummy prefix, folded blanks and marks are on."""

    def __init__(self, spec: bytes):
        fields = dict(proto_fields(spec))
        self.map = CharacterMap(fields.get(2, b""))
        self.dummy = bool(fields.get(3, 1))
        self.fold = bool(fields.get(4, 1))
        self.escape = bool(fields.get(5, 1))
        self.blank = MARK.encode() if self.escape else b" "

    @property
    def plain(self) -> bool:
        """Whether only blanks change."""
        return not self.map and not self.fold and self.escape

    def __call__(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and the source byte of each (and of the end)."""
        source = text.encode()
        if not source:
            return b"", np.zeros(1, np.int64)
        if self.plain:
            data = np.frombuffer(source, np.uint8)
            origin = np.repeat(np.arange(len(data) + 1), np.append(np.where(data == 0x20, 3, 1), 1))
            out = text.replace(" ", MARK).encode()
            if self.dummy:
                return self.blank + out, np.concatenate([np.zeros(3, np.int64), origin])
            return out, origin
        parts: list[tuple[bytes, int]] = []
        at = 0
        while at < len(source):
            size, into = (self.map.longest(source, at) if self.map else None) or (0, b"")
            if not size:
                size = next((n for limit, n in ((0x80, 1), (0xE0, 2), (0xF0, 3)) if source[at] < limit), 4)
                into = source[at : at + size]
            parts.append((into, at))
            at += size
        end = len(source)
        if self.fold:
            parts, end = self._folded(parts, end)
        out, origin = bytearray(), []
        if parts and self.dummy:
            out += self.blank
            origin += [parts[0][1]] * len(self.blank)
        for into, place in parts:
            into = into.replace(b" ", self.blank)
            out += into
            origin += [place] * len(into)
        return bytes(out), np.array([*origin, end], np.int64)

    @staticmethod
    def _folded(parts: list[tuple[bytes, int]], end: int) -> tuple[list[tuple[bytes, int]], int]:
        """Without blanks at either end, and with one where several stood together."""
        kept: list[tuple[bytes, int]] = []
        blank = True
        for into, place in parts:
            if blank:
                into = into.lstrip(b" ")
            if into:
                kept.append((into, place))
                blank = into.endswith(b" ")
        while kept and kept[-1][0].endswith(b" "):
            into, place = kept.pop()
            end = place
            if into.rstrip(b" "):
                kept.append((into.rstrip(b" "), place))
        return kept, end


class Model(dict):
    """From a cut of normalised text to its ids as little-endian uint32 bytes."""

    def __init__(self, path: str):
        import sentencepiece

        super().__init__()
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as file:
            fields = list(proto_fields(file.read()))
        self.normaliser = Normaliser(next((v for f, v in fields if f == 3), b""))
        pieces = [dict(proto_fields(v)) for f, v in fields if f == 1]
        names = [p[1].decode() for p in pieces]
        kinds = [p.get(3, 1) for p in pieces]  # 1 normal, 4 user-defined, 6 byte
        self.sizes = np.array([1 if k == 6 else len(n.encode()) if k in (1, 4, 5) else 0 for n, k in zip(names, kinds, strict=True)], np.int64)
        self.texts = [str(i) for i in range(len(names))]
        self.end_id = self.library.eos_id()
        normal = [n for n, k in zip(names, kinds, strict=True) if k != 6]
        self.unknown = self.library.unk_id() if 6 not in kinds else -1
        self.cuts = self.normaliser.plain and self.normaliser.dummy and 4 not in kinds and not any(MARK in n[1:] and n.strip(MARK) for n in normal)
        self.lines = not any("\n" in n for n in normal) and 6 in kinds
        self.unit = re.compile("▁+(?=\n)|▁*[^▁\n]+|▁+|\n" if self.lines else "▁*[^▁]+|▁+")

    def __missing__(self, unit: str) -> bytes:
        if unit[0] == MARK:
            ids = self.library.encode(unit[1:].replace(MARK, " ")) if len(unit) > 1 else self.library.encode("\n")[:1]
        else:
            ids = self.library.encode("\n" + unit)[2:]  # without the dummy prefix and the newline
        coded = np.array(ids, "<u4").tobytes()
        if len(self) < KEPT_PIECES:
            self[unit] = coded
        return coded

    def ids(self, text: str) -> bytes:
        if not self.cuts or not self.lines:
            return np.array(self.library.encode(text), "<u4").tobytes()
        return b"".join(map(self.__getitem__, self.unit.findall(MARK + text.replace(" ", MARK)))) if text else b""

    def spans(self, text: str, ids: np.ndarray) -> np.ndarray:
        """Byte bounds in ``text`` of every piece: row 0 starts, row 1 ends."""
        normal, origin = self.normaliser(text)
        if self.unknown >= 0 and (ids == self.unknown).any():
            sizes = np.array([len(p.encode()) for p in self.library.encode(text, out_type=str)], np.int64)
        else:
            sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        if len(ends) and ends[-1] != len(normal):
            raise ValueError("pieces do not cover the normalised text")
        return np.stack([origin[ends - sizes], origin[ends]])


@functools.cache
def model(path: str) -> Model:
    return Model(path)


def _encode(path: str, full: bool, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = model(path)
        end = np.array([coder.end_id], "<u4").tobytes()
        for batch in batches:
            for part in slices(batch):
                counts, shas, sums, decoded, all_ids, all_spans = [], [], [], [], [], []
                for text in part.column(1).to_pylist():
                    text = text or ""
                    ids = np.frombuffer(coder.ids(text) + end, "<u4")
                    bounds = coder.spans(text, ids[:-1])
                    listed = ids.tolist()
                    counts.append(len(listed))
                    decoded.append(coder.library.decode(listed))
                    if full or keep_ids:
                        all_ids.append(listed)
                    if full:
                        all_spans.append(bounds)
                    else:
                        shas.append(hashlib.sha256(" ".join([coder.texts[i] for i in listed]).encode()).hexdigest())
                        sums.append(zlib.crc32(bounds.astype("<i8").tobytes()))
                if full:
                    rest = [pa.array(all_ids, pa.list_(pa.int32())), *(pa.array([b[k] for b in all_spans], pa.list_(pa.int64())) for k in (0, 1)), pa.array(decoded, pa.string())]
                    names = ["ids", "starts", "ends", "decoded"]
                else:
                    rest = [pa.array(shas, pa.string()), pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded], pa.string()), pa.array(sums, pa.int64())]
                    names = ["ids_sha256", "decoded_sha256", "spans_crc32"]
                    if keep_ids:
                        rest, names = [pa.array(all_ids, pa.list_(pa.int32())), *rest], ["ids", *names]
                yield pa.record_batch([part.column(0), pa.array(counts, pa.int64()), *rest], names=["doc_id", "n_tokens", *names])

    return run


def _apply(docs: DataFrame, path: str, full: bool, columns: str, ids: bool = False) -> DataFrame:
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        _encode(path, full, ids), f"doc_id {id_type}, n_tokens bigint, {columns}")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (the end id is last), starts and ends of the pieces in source bytes, decoded text."""
    return _apply(docs, path, True, "ids array<int>, starts array<bigint>, ends array<bigint>, decoded string")


def digests(docs: DataFrame, path: str, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and spans_crc32 of the same values; ``ids`` adds the ids."""
    return _apply(docs, path, False, "ids array<int>, " * ids + "ids_sha256 string, decoded_sha256 string, spans_crc32 bigint", ids)


def op10_offsets(spark: SparkSession, folder: str) -> DataFrame:
    return digests(spark.read.parquet(f"{folder}/documents.parquet"), tokenizer_path("piece_bpe_32k.model"))
