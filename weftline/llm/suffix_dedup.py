"""Suffix-array deduplication: prefix doubling over positions, ranked by the strings of 8, 16, 32 and LENGTH bytes that start there.

Two equal strings of LENGTH bytes hold the same 8-byte words, so also the same smallest word by hash (their key). All positions with
one key meet in one bucket, and doubling runs there: a rank is a hash made of the pair of ranks of a position and of the one an offset
further on, for 8, 16 and 32 bytes. At 32 bytes positions are sorted and those of unique rank drop out; the others are sorted once
more by two hashes of all LENGTH bytes. Neighbouring positions mostly
share their key, so a task sends runs of positions as one stretch of text (about 3 bytes for each byte of the input, before
compression), with all places of its block of documents where the same stretch stands; a stretch with many copies goes once for
each block. A key that many positions have is joined with the smallest word by a second hash, which equal strings share as well, so a
frequent word does not fill one bucket. Ranking all positions in every round over Spark's shuffle instead would send some 50 bytes for each byte and round.

Of each rank the smallest doc_id is found, and a position with a smaller doc_id than its own marks its LENGTH bytes. Marks are gathered by
document and joined with the text.

Defined results: a null text counts as empty. Texts under LENGTH bytes lose nothing; a text of any length is cut whole. A string that repeats
in its own document only is kept. Of equal strings in several documents those of the smallest doc_id stay. Rows that repeat a doc_id do not
remove from one another; each is a row of the result. A null doc_id comes after all others, and such rows do not remove from one another. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import mix64, pack, slices, stored, table, text_bytes, unpack

LENGTH = 50
WORD = 8
#: Text bytes for each bucket of keys.
BUCKET_BYTES = 3 << 20
PARTITION_BUCKETS = 4
#: Documents that tell which keys are frequent, and the share of all positions from which a key may be.
SAMPLE_DOCS = 2000
LEAST_SHARE = 2e-6
#: Stands for a null doc_id, which comes last.
LAST = (1 << 63) - 1
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _words(body: np.ndarray) -> np.ndarray:
    """The 8 bytes at each position as one number; zeros behind the end."""
    padded = np.concatenate([body, np.zeros(WORD, np.uint8)])
    return np.ndarray(len(body), np.dtype("<u8"), padded.data, strides=(1,))


def _double(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A name for each pair of names."""
    with np.errstate(over="ignore"):
        return mix64(first * _A + (second ^ _B))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each `width` neighbours, by doubling."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (width - have)], out[width - have :]) if have < width else out


def _keys(body: np.ndarray, length: int, frequent: np.ndarray) -> np.ndarray:
    """The key of each position: the smallest word, by hash, within `length` bytes; with a frequent one, the smallest by a second hash too."""
    words = _words(body)[: len(body) - WORD + 1]
    key = _least(mix64(words), length - WORD + 1)
    if len(frequent):
        hot = frequent[np.minimum(np.searchsorted(frequent, key), len(frequent) - 1)] == key
        if hot.any():
            key = np.where(hot, _double(key, _least(mix64(words ^ _B), length - WORD + 1)), key)
    return key


def _key_counts(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "body"):
            body, _ = text_bytes(batch.column("body"))
            if len(body) >= length:
                key, n = np.unique(_keys(body, length, np.zeros(0, np.uint64)), return_counts=True)
                yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(n)], names=["key", "n"])

    return run


def _frequent_keys(rows: DataFrame, length: int, buckets: int) -> np.ndarray:
    """Keys of a large share of the positions, from a sample of documents by hash. They only steer how work is dealt, not what is found."""
    share = max(1, rows.count() // SAMPLE_DOCS)
    counted = rows.where(F.pmod(F.xxhash64("doc_id", "mark"), F.lit(share)) == 0).mapInArrow(_key_counts(length), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    total = counted.agg(F.sum("n")).first()[0] or 0
    # At most 1 / LEAST_SHARE keys.
    found = counted.where(F.col("n") > total * max(LEAST_SHARE, 0.25 / buckets)).select("key").toPandas()["key"].to_numpy(np.int64) if total else np.zeros(0, np.int64)
    return np.sort(found.view(np.uint64))


def stretches(body: np.ndarray, at: np.ndarray, length: int = LENGTH, frequent: np.ndarray = np.zeros(0, np.uint64)) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key, row, first position and number of positions of each run of positions with the same key."""
    if len(body) < length:
        return (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 3
    key = _keys(body, length, frequent)
    # Positions from which `length` bytes stay within their row.
    size = np.maximum(np.diff(at) - length + 1, 0)
    inside = np.zeros(len(key) + 1, np.int32)
    np.add.at(inside, at[:-1][size > 0], 1)
    np.add.at(inside, (at[:-1] + size)[size > 0], -1)
    good = np.cumsum(inside[:-1]) > 0
    head = good.copy()
    head[1:] &= (key[1:] != key[:-1]) | ~good[:-1]
    row_heads = at[:-1][size > 0]
    head[row_heads] = True
    start = np.flatnonzero(head)
    # A run ends before the next run or where its row's last position is.
    row = np.searchsorted(at, start, side="right") - 1
    end = np.minimum(np.append(start[1:], len(key)), at[1:][row] - length + 1)
    return key[start], row, start, end - start


def _cutter(buckets: int, length: int, frequent: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "body"):
            body, at = text_bytes(batch.column("body"))
            key, row, start, count = stretches(body, at, length, frequent)
            if not len(key):
                continue
            size = count + length - 1
            # Equal stretches of this block go once; a stretch's name is that of its key, size, and first and last words.
            words = _words(body)
            with np.errstate(over="ignore"):
                name = _stretch_names(words, start, size)
            bucket = (mix64(key) % np.uint64(buckets)).astype(np.int32)
            order = np.lexsort((start, name, bucket))
            bucket, name, row, start, size = bucket[order], name[order], row[order], start[order], size[order]
            new = np.concatenate([[True], (name[1:] != name[:-1]) | (bucket[1:] != bucket[:-1])])
            first = np.flatnonzero(new)
            places = np.diff(np.append(first, len(name)))
            edge = np.flatnonzero(np.concatenate([[True], bucket[first][1:] != bucket[first][:-1]]))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            marks = batch.column("mark").to_numpy(zero_copy_only=False)
            names, blobs = [], []
            for low, high in zip(edge, np.append(edge[1:], len(first)), strict=True):
                mine = first[low:high]
                all_of = slice(mine[0], first[high] if high < len(first) else len(name))
                here, local = np.unique(row[all_of], return_inverse=True)
                text = body[np.repeat(start[mine] - np.cumsum(size[mine]) + size[mine], size[mine]) + np.arange(size[mine].sum())]
                names.append(int(bucket[mine[0]]))
                blobs.append(pack([text, size[mine].astype(np.uint32), places[low:high].astype(np.uint32), local.astype(np.uint32), (start[all_of] - at[row[all_of]]).astype(np.uint32), ids[here], marks[here]]))
                if len(names) == 64:
                    yield pa.record_batch([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "block"])
                    names, blobs = [], []
            yield pa.record_batch([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "block"])

    return run


def _stretch_names(words: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit name of all bytes of each stretch: its words every 8 bytes and the last 8 bytes, folded."""
    out = mix64(size.astype(np.uint64))
    live, offset = np.arange(len(start)), 0
    while len(live):
        out[live] = _double(out[live], words[start[live] + offset])
        offset += WORD
        live = live[size[live] >= offset + WORD]
    return _double(out, words[start + size - WORD])


def _ranker(length: int):
    """Marked spans of each document: doc_id, mark (its text's hash), span (start * 2**32 + end)."""

    def done(blocks: list[bytes]) -> Iterator[pa.RecordBatch]:
        parts = [unpack(b) for b in blocks]
        body = np.concatenate([p[0] for p in parts])
        size = np.concatenate([p[1] for p in parts]).astype(np.int64)
        places = np.concatenate([p[2] for p in parts]).astype(np.int64)
        shift = np.cumsum([0, *(len(p[5]) for p in parts[:-1])])
        doc = np.concatenate([p[3].astype(np.int64) + s for p, s in zip(parts, shift, strict=True)])
        position = np.concatenate([p[4] for p in parts]).astype(np.int64)
        ids, marks = np.concatenate([p[5] for p in parts]), np.concatenate([p[6] for p in parts])
        del parts

        start = np.cumsum(size) - size
        count = size - length + 1
        window = np.cumsum(count) - count  # first position of each stretch
        of = np.repeat(np.arange(len(size)), count)
        p = np.arange(len(of)) - window[of] + start[of]
        first_place = np.cumsum(places) - places
        least = np.minimum.reduceat(ids[doc], first_place)
        found = least[of]  # the smallest doc_id known to hold the string at each position

        words = _words(body)
        rank = _double(_double(words[p], words[p + 8]), _double(words[p + 16], words[p + 24]))
        live, rank = _repeated(np.arange(len(p)), rank)
        if len(live):
            q = p[live]
            tail = words[q + length - WORD]  # the last word ends at `length` and may overlap the one before
            for offset in range(32, length - WORD, WORD):
                tail = _double(tail, words[q + offset])
            full, again = _double(rank, tail), mix64(rank + _double(tail, words[q]))
            order = np.lexsort((again, full))
            live, full, again = live[order], full[order], again[order]
            head = np.flatnonzero(np.concatenate([[True], (full[1:] != full[:-1]) | (again[1:] != again[:-1])]))
            smallest = np.minimum.reduceat(found[live], head)
            found[live] = np.repeat(smallest, np.diff(np.append(head, len(live))))

        low, high = np.minimum.reduceat(found, window), np.maximum.reduceat(found, window)
        stretch = np.repeat(np.arange(len(size)), places)
        own = ids[doc]
        whole = high[stretch] < own
        part = np.flatnonzero((low[stretch] < own) & ~whole)
        whole = np.flatnonzero(whole)
        docs, begin, end = [doc[whole]], [position[whole]], [position[whole] + size[stretch[whole]]]
        if len(part):
            n = count[stretch[part]]
            which = np.repeat(part, n)
            k = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            hit = found[window[stretch[which]] + k] < own[which]
            run = hit.copy()
            run[1:] &= ~hit[:-1] | (which[1:] != which[:-1])
            stop = hit.copy()
            stop[:-1] &= ~hit[1:] | (which[1:] != which[:-1])
            a, b = np.flatnonzero(run), np.flatnonzero(stop)
            docs.append(doc[which[a]])
            begin.append(position[which[a]] + k[a])
            end.append(position[which[b]] + k[b] + length)
        d, begin, end = map(np.concatenate, (docs, begin, end))
        for k in range(0, len(d), 100_000):
            s = slice(k, k + 100_000)
            yield pa.record_batch([pa.array(ids[d[s]]), pa.array(marks[d[s]]), pa.array((begin[s] << 32) | end[s])], names=["doc_id", "mark", "span"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, blocks = None, []
        for batch in batches:
            for name, block in zip(batch.column("bucket").to_pylist(), batch.column("block").to_pylist(), strict=True):
                if name != bucket and blocks:
                    yield from done(blocks)
                    blocks = []
                bucket = name
                blocks.append(block)
        if blocks:
            yield from done(blocks)

    return run


def _repeated(live: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The positions whose name is not unique, with it."""
    order = np.argsort(name)
    sorted_name = name[order]
    same = sorted_name[1:] == sorted_name[:-1]
    keep = np.zeros(len(name), bool)
    keep[1:] |= same
    keep[:-1] |= same
    order = order[keep]
    return live[order], name[order]


def _cut_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n_bytes, n_removed, n_spans and kept_sha256 of each row with its marked spans."""
    for batch in batches:
        column = batch.column("body").fill_null(b"")
        out: list[tuple] = []
        for doc_id, text, spans in zip(batch.column("doc_id").to_pylist(), column, batch.column("spans"), strict=True):
            raw = text.as_buffer()
            if not spans.is_valid:
                out.append((doc_id, raw.size, 0, 0, hashlib.sha256(raw).hexdigest()))
                continue
            both = np.sort(spans.values.to_numpy())
            begin, end = both >> 32, np.maximum.accumulate(both & 0xFFFFFFFF)
            head = np.concatenate([[True], begin[1:] > end[:-1]])
            begin, end = begin[head], end[np.append(np.flatnonzero(head)[1:] - 1, len(end) - 1)]
            kept, at, view = hashlib.sha256(), 0, memoryview(raw)
            for a, b in zip(begin.tolist(), end.tolist(), strict=True):
                kept.update(view[at:a])
                at = b
            kept.update(view[at:])
            out.append((doc_id, raw.size, int((end - begin).sum()), len(begin), kept.hexdigest()))
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        yield pa.record_batch([pa.array(x, pa.string() if n == "kept_sha256" else pa.int64()) for n, x in zip(names, zip(*out, strict=True) if out else [()] * 5, strict=True)], names=names)


def _rows(docs: DataFrame, text: str, key: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("doc_id"), F.xxhash64(text).alias("mark"), F.col(text).cast("binary").alias("body"), F.col(key).cast("long").alias("given"))


def repeated_spans(docs: DataFrame, *, text: str = "text", key: str = "doc_id", length: int = LENGTH, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id (LAST for null), mark and spans (array of start * 2**32 + end, in bytes) of the documents of which something goes; spans may touch or overlap."""
    if length < 5 * WORD:
        raise ValueError(f"the last round needs strings of {5 * WORD} bytes or more")
    rows = _rows(docs, text, key)
    total = rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    cut = rows.mapInArrow(_cutter(buckets, length, _frequent_keys(rows, length, buckets)), "bucket int, block binary")
    # So many partitions that each reads the same amount, whatever the size of the input.
    spans = cut.repartition(max(1, -(-buckets // PARTITION_BUCKETS)), "bucket").sortWithinPartitions("bucket").mapInArrow(_ranker(length), "doc_id long, mark long, span long")
    return stored(spans.groupBy("doc_id", "mark").agg(F.collect_list("span").alias("spans")), "spans")


def remove_repeats(docs: DataFrame, *, text: str = "text", key: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row of docs."""
    spans = repeated_spans(docs, text=text, key=key, length=length)
    joined = _rows(docs, text, key).join(spans, ["doc_id", "mark"], "left").select(F.col("given").alias("doc_id"), "body", "spans")
    return joined.mapInArrow(_cut_spans, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


QUERIES = {"op4_suffix_dedup": op4_suffix_dedup}
SQL = {
    "op4_suffix_dedup": r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(n - 49, 0))) AS p FROM d)),
f AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) < doc_id AS gone FROM w),
g AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM f WHERE gone),
r AS (SELECT doc_id, p, sum(CASE WHEN before IS NULL OR p > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM g),
spans AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM r GROUP BY doc_id, k),
pieces AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS low, a AS high FROM spans UNION ALL SELECT d.doc_id, coalesce(max(b), 0), d.n FROM d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id, d.n),
kept AS (SELECT p.doc_id, sha256(unhex(string_agg(substr(d.h, 2 * p.low + 1, 2 * (p.high - p.low)), '' ORDER BY p.low, p.high))) AS sha FROM pieces p JOIN d USING (doc_id) GROUP BY p.doc_id)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, CAST(coalesce(s.removed, 0) AS BIGINT) AS n_removed, coalesce(s.spans, 0) AS n_spans, kept.sha AS kept_sha256
FROM d LEFT JOIN (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM spans GROUP BY doc_id) s USING (doc_id) JOIN kept USING (doc_id)"""
}
