"""What the operators of this subpackage have in common: table access, shared-folder tables, byte-level numpy helpers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_folder

#: White space of the contracts: space and U+0009 to U+000D.
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write df as Parquet to the shared folder and read it back, so that a lost executor repeats only its own tasks."""
    path = f"{shared_folder(df.sparkSession)}/weftline/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Appended:
    """A table in the shared folder that grows by whole results; each reading plans as one scan, however many were added."""

    def __init__(self, spark: SparkSession, tag: str, schema: str):
        self.spark, self.schema = spark, schema
        self.path = f"{shared_folder(spark)}/weftline/{tag}-{uuid.uuid4().hex}"
        spark.createDataFrame([], schema).write.parquet(self.path)

    def add(self, df: DataFrame) -> None:
        df.write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)


def uniform(*parts: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on seed and parts only; the same in DuckDB's md5()."""
    text = F.concat_ws("|", F.lit(str(seed)), *(p.cast("string") for p in parts))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, element by element."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def to_unit(x: np.ndarray) -> np.ndarray:
    """64-bit hashes to doubles in (0, 1)."""
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each slice holds about `most` bytes of the text column; a longer text makes a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(_lengths(batch.column(column)))
        start = 0
        while start < batch.num_rows:
            before = size[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(size, before + most, side="right")))
            yield batch.slice(start, end - start)
            start = end


def _lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column (null: empty) as one array, and the n + 1 offsets of the rows in it."""
    column = column.fill_null("") if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column.fill_null(b"")
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, at - at[0]


#: Inverse of the odd base modulo 2**64, and powers of both up to the longest slice seen so far.
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, 1 << 20)
        with np.errstate(over="ignore"):
            _POWERS["up"] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _BASE, np.uint64)]))
            _POWERS["down"] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, pow(_BASE, -1, 1 << 64), np.uint64)]))
    return _POWERS["up"], _POWERS["down"]


def token_spans(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that are no white space, none crossing a row, and the row of each."""
    return spans_of(~((body == 32) | ((body >= 9) & (body <= 13))), offsets)


def spans_of(black: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of marked bytes, none crossing a row, and the row of each."""
    if not len(black):
        return (np.zeros(0, np.int64),) * 3
    first = black.copy()
    first[1:] &= ~black[:-1]
    heads = offsets[:-1][offsets[:-1] < len(black)]
    first[heads] = black[heads]
    last = black.copy()
    last[:-1] &= first[1:] | ~black[1:]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def span_hashes(body: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: differences of prefix sums of a polynomial modulo 2**64, brought to the same power."""
    up, down = _powers(len(body) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(body) + 1, np.uint64)
        np.cumsum(mix64(np.arange(256, dtype=np.uint64))[body] * up[: len(body)], out=total[1:])
        return mix64((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def distinct_words(body: np.ndarray, black: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The number of each span's word, and the distinct words; the spans are all the marked bytes, in order."""
    at = np.zeros(len(start) + 1, np.int32)
    np.cumsum(end - start, out=at[1:])
    words = pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(body[black]))]).dictionary_encode()
    return words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary


def word_buckets(words: pa.Array, buckets: int) -> np.ndarray:
    """A bucket of each word, by a hash of its bytes."""
    body, at = text_bytes(words)
    return (span_hashes(body, at[:-1], at[1:]) % np.uint64(buckets)).astype(np.int64)


def number_of_buckets(df: DataFrame, column: str, each: int) -> int:
    """So many buckets that `each` bytes of the column go to one."""
    return max(1, -(-(df.agg(F.sum(F.octet_length(column))).first()[0] or 0) // each))


_TYPES = [np.dtype(t) for t in (np.uint64, np.int64, np.uint32, np.uint8, np.float64, np.float32)]


def pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays behind one another, their lengths and types in front, compressed. Arrays of 64-bit integers go as differences."""
    arrays = [np.diff(a, prepend=a.dtype.type(0)) if a.dtype.kind in "iu" and a.dtype.itemsize == 8 else a for a in arrays]
    raw = np.array([x for a in arrays for x in (len(a), _TYPES.index(a.dtype))], np.int64).tobytes() + b"".join(a.tobytes() for a in arrays)
    return np.array([len(raw), len(arrays)], np.int64).tobytes() + pa.Codec("zstd", compression_level=3).compress(raw, asbytes=True)


def unpack(blob: bytes) -> list[np.ndarray]:
    size, n = np.frombuffer(blob[:16], np.int64)
    raw = pa.decompress(blob[16:], decompressed_size=int(size), codec="zstd", asbytes=True)
    head = np.frombuffer(raw, np.int64, 2 * int(n)).reshape(-1, 2)
    at, out = 16 * int(n), []
    for length, kind in head:
        a = np.frombuffer(raw, _TYPES[kind], int(length), at)
        at += a.nbytes
        out.append(np.cumsum(a, dtype=a.dtype) if a.dtype.kind in "iu" and a.dtype.itemsize == 8 else a)
    return out
