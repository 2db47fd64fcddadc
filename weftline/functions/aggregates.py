"""Aggregates for SQL that work through partial states: <name>_part makes a state of a block of rows, <name>_merge one of several states, and
<name>_final the value. A Python aggregate sees all rows of its group at once, so a group of any size is cut into blocks first and
states are merged in as many steps as it takes:

    SELECT lang, percentile_final(percentile_merge(state), 0.5)
    FROM (SELECT lang, percentile_part(length(text)) AS state FROM documents GROUP BY lang, doc_id DIV 10000) GROUP BY lang

States are: of a fingerprint nine whole numbers; of percentiles the distinct values with their counts; of a bootstrap two sums for each sample.
Nulls are left out. The order of rows, blocks and merges does not matter.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, StringType

#: Resamples of a bootstrap, and the cumulative probabilities of a Poisson variable of mean 1, in 32 bits: how often a row is drawn.
SAMPLES = 200
DRAWN = np.array([round(2**32 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(12)], np.uint64)


def _blob(*arrays: np.ndarray) -> bytes:
    return np.int64(len(arrays[0])).tobytes() + b"".join(a.tobytes() for a in arrays)


def _ints(states: pa.Array) -> np.ndarray:
    """States of one width, a row each."""
    rows = [np.frombuffer(s, np.int64) for s in states.drop_null().to_pylist()]
    return np.stack(rows) if rows else np.zeros((0, 9), np.int64)


@arrow_udf(BinaryType())
def fingerprint_part(text: pa.Array) -> bytes:
    """A15, independent of order: the number of texts, and the sums of the eight 32-bit parts of their SHA-256."""
    sums = np.zeros(9, np.int64)
    for value in text.drop_null():
        sums += np.concatenate([[1], np.frombuffer(hashlib.sha256(value.as_buffer()).digest(), ">u4").astype(np.int64)])
    return sums.tobytes()


@arrow_udf(BinaryType())
def fingerprint_merge(state: pa.Array) -> bytes:
    return _ints(state).sum(axis=0).astype(np.int64).tobytes()


@arrow_udf(StringType())
def fingerprint_final(state: pa.Array) -> pa.Array:
    """The first 16 hexadecimal digits of the SHA-256 of the nine sums."""
    return pa.array([None if s is None else hashlib.sha256("|".join(map(str, np.frombuffer(s, np.int64))).encode()).hexdigest()[:16] for s in state.to_pylist()], pa.string())


@arrow_udf(BinaryType())
def percentile_part(value: pa.Array) -> bytes:
    """the distinct values and how often they occur."""
    values, counts = np.unique(value.drop_null().cast(pa.float64()).to_numpy(zero_copy_only=False), return_counts=True)
    return _blob(values, counts.astype(np.int64))


@arrow_udf(BinaryType())
def percentile_merge(state: pa.Array) -> bytes:
    parts = [(int(np.frombuffer(s, np.int64, 1)[0]), s) for s in state.drop_null().to_pylist()]
    every = np.concatenate([np.frombuffer(s, np.float64, n, 8) for n, s in parts] or [np.zeros(0)])
    counts = np.concatenate([np.frombuffer(s, np.int64, n, 8 + 8 * n) for n, s in parts] or [np.zeros(0, np.int64)])
    values, of = np.unique(every, return_inverse=True)
    sums = np.zeros(len(values), np.int64)
    np.add.at(sums, of, counts)
    return _blob(values, sums)


@arrow_udf(DoubleType())
def percentile_final(state: pa.Array, share: pa.Array) -> pa.Array:
    """Linear interpolation between the two nearest values; 0 without any."""
    out = []
    for s, f in zip(state.to_pylist(), share.cast(pa.float64()).to_pylist(), strict=True):
        n = 0 if s is None else int(np.frombuffer(s, np.int64, 1)[0])
        if not n:
            out.append(0.0)
            continue
        values, upto = np.frombuffer(s, np.float64, n, 8), np.cumsum(np.frombuffer(s, np.int64, n, 8 + 8 * n))
        at = (int(upto[-1]) - 1) * f
        low, high = (values[np.searchsorted(upto, int(k), side="right")] for k in (np.floor(at), np.ceil(at)))
        out.append(float(low + (high - low) * (at - np.floor(at))))
    return pa.array(out, pa.float64())


def mix(x: np.ndarray) -> np.ndarray:
    """A hash of 64-bit numbers: the finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@arrow_udf(BinaryType())
def bootstrap_part(key: pa.Array, part: pa.Array, whole: pa.Array) -> bytes:
    """A9 for a ratio of sums of whole numbers: for each sample both sums, each row drawn a Poisson number of times that its key (a whole number) and the sample decide."""
    keep = pc.and_(pc.is_valid(key), pc.and_(pc.is_valid(part), pc.is_valid(whole)))
    k, a, b = (x.filter(keep).cast(pa.int64()).to_numpy(zero_copy_only=False) for x in (key, part, whole))
    sums = np.zeros((2, SAMPLES), np.int64)
    for s in range(SAMPLES):
        with np.errstate(over="ignore"):
            u = mix(mix(k.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) + np.uint64(s) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
        times = np.searchsorted(DRAWN, u, side="right")
        sums[:, s] = (a * times).sum(), (b * times).sum()
    return sums.tobytes()


@arrow_udf(BinaryType())
def bootstrap_merge(state: pa.Array) -> bytes:
    rows = [np.frombuffer(s, np.int64) for s in state.drop_null().to_pylist()]
    return (np.stack(rows).sum(axis=0) if rows else np.zeros(2 * SAMPLES, np.int64)).astype(np.int64).tobytes()


@arrow_udf(ArrayType(DoubleType()))
def bootstrap_final(state: pa.Array) -> pa.Array:
    """The 2.5th and the 97.5th percentile of the samples' ratios (0 for a sample without a denominator)."""
    out = []
    for s in state.to_pylist():
        if s is None:
            out.append(None)
            continue
        part, whole = np.frombuffer(s, np.int64).reshape(2, -1)
        ratios = np.divide(part, whole, out=np.zeros(len(part)), where=whole != 0)
        out.append([float(x) for x in np.percentile(ratios, [2.5, 97.5])])
    return pa.array(out, pa.list_(pa.float64()))


def register(spark: SparkSession) -> None:
    for name in ("fingerprint", "percentile", "bootstrap"):
        for step in ("part", "merge", "final"):
            spark.udf.register(f"{name}_{step}", globals()[f"{name}_{step}"])
