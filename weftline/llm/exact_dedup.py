"""Exact deduplication: Patricia-trie owners over partitions by length and content hash.

Stage 1, without a shuffle: each input partition inserts its normalised texts into radix tries and so finds, for each of its texts,
the first row that holds the same bytes there (the local owner), the smallest row and the number of rows. A group of copies that holds a
third of all rows thus sends one text for each input partition, whatever its size.
Stage 2: the local owners' full byte strings are shuffled by length and content hash; each partition inserts them into a trie whose
terminal nodes hold the smallest row of one text and its number of rows, so a text that many partitions send costs its length each time and
no more memory. A trie over its byte budget spills its largest subtree to Spark's scratch folder of the executor and finishes it afterwards.
Stage 3: owners meet their group by the hash of their text, and rows meet their owner.

Defined results: a null text counts as empty; all empty texts are equal. Texts are equal when identical after each run of
`[\\x20\\x09-\\x0D]` became one space. Of rows that repeat a doc_id and a text one is kept, the first in the input; a null doc_id comes last in
order. A text of any length is one key; it needs a few times its length in memory. Extra columns of the input are not read. An empty table
gives an empty result.
"""

from __future__ import annotations

import os
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import BLANKS, stored, table, text_bytes

#: Bytes of edge labels that one trie may hold before it spills or, in stage 1, starts anew.
TRIE_BYTES = 96 << 20


def _scratch() -> str | None:
    """Spark's scratch folder of this executor, which its Python workers are told."""
    return os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None


class Patricia:
    """A compressed radix trie over byte strings; a terminal holds what merge() makes of all values put there.

    Nodes are lists [label, children by first byte, value or None]. put() returns the terminal's node.
    """

    def __init__(self, merge, most: int = TRIE_BYTES):
        self.merge, self.most = merge, most
        self.root: list = [b"", {}, None]
        self.held = 0
        self.spilled: dict[bytes, object] = {}  # files by the subtree's prefix

    def put(self, key: bytes, value) -> list | None:
        """Insert, or append to the subtree's spill file and return None."""
        for prefix, file in self.spilled.items():
            if key.startswith(prefix):
                pickle.dump((key[len(prefix) :], value), file, protocol=5)
                return None
        node, at = self.root, 0
        while at < len(key):
            child = node[1].get(key[at])
            if child is None:
                child = [key[at:], {}, None]
                self.held += len(key) - at + 200
                node[1][key[at]] = child
                node, at = child, len(key)
                break
            label = child[0]
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            same = _common(label, key, at)
            fork = [label[:same], {label[same]: child}, None]
            child[0] = label[same:]
            node[1][key[at]] = fork
            node, at = fork, at + same
        node[2] = value if node[2] is None else self.merge(node[2], value)
        if self.held > self.most:
            self._spill()
        return node

    def _spill(self) -> None:
        """Move the heaviest subtree below the first fork to a file."""
        node, path = self.root, b""
        while len(node[1]) == 1 and node[2] is None:
            (node,) = node[1].values()
            path += node[0]
        if not node[1]:
            return
        sizes = {first: _weight(child) for first, child in node[1].items()}
        first = max(sizes, key=sizes.get)
        child = node[1].pop(first)
        out = tempfile.TemporaryFile(dir=_scratch())  # has no name, so nothing stays behind
        for key, value in _walk(child, b""):
            pickle.dump((key[len(child[0]) :], value), out, protocol=5)
        self.spilled[path + child[0]] = out
        self.held -= sizes[first]

    def items(self) -> Iterator[tuple[bytes, object]]:
        """The keys and values of all terminals: those in memory, then each spilled subtree, one after the other."""
        yield from _walk(self.root, b"")
        self.root, self.held = [b"", {}, None], 0
        for prefix, file in self.spilled.items():
            part = Patricia(self.merge, self.most)
            file.seek(0)
            while True:
                try:
                    part.put(*pickle.load(file))
                except EOFError:
                    break
            file.close()
            for key, value in part.items():
                yield prefix + key, value
        self.spilled = {}


def _common(label: bytes, key: bytes, at: int) -> int:
    """Length of the common start of label and key[at:], by halving."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if label[low:middle] == key[at + low : at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _weight(node: list) -> int:
    total, todo = 0, [node]
    while todo:
        label, children, _ = todo.pop()
        total += len(label) + 200
        todo.extend(children.values())
    return total


def _walk(node: list, before: bytes) -> Iterator[tuple[bytes, object]]:
    todo = [(node, before)]
    while todo:
        (label, children, value), before = todo.pop()
        key = before + label
        if value is not None:
            yield key, value
        todo.extend((child, key) for child in children.values())


_TAGGED = "doc_id long, row_key long, owner long, sha string, least_doc long, least_row long, n long, body binary"


def _joined(old: list, new: list) -> list:
    """Terminals hold [owner, smallest row as (doc_id is null, doc_id, row), number of rows]."""
    old[1] = min(old[1], new[1])
    old[2] += new[2]
    return old


def _place(doc_id: int | None, row: int) -> tuple[bool, int, int]:
    return doc_id is None, doc_id or 0, row


def _record(rows: list[tuple]) -> pa.RecordBatch:
    names = [part.split()[0] for part in _TAGGED.split(", ")]
    types = [pa.string() if n == "sha" else pa.binary() if n == "body" else pa.int64() for n in names]
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _local_owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with its owner, the first row of this task with the same text; then each owner with its text, smallest row and number of rows."""
    trie, shas = Patricia(_joined), {}

    def owners() -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for body, (owner, (no_id, least, row), n) in trie.items():
            rows.append((None, None, owner, shas[owner], None if no_id else least, row, n, body))
            size += len(body)
            if size > 8 << 20:
                yield _record(rows)
                rows, size = [], 0
        yield _record(rows)

    for batch in batches:
        body, at = text_bytes(batch.column("norm").cast(pa.binary()))
        raw = body.tobytes()
        rows = []
        for k, (doc_id, row, sha) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("row_key").to_pylist(), batch.column("sha").to_pylist(), strict=True)):
            if trie.held > trie.most // 2:  # a new trie; what it misses meets in stage 2
                yield from owners()
                trie, shas = Patricia(_joined), {}
            owner = trie.put(raw[at[k] : at[k + 1]], [row, _place(doc_id, row), 1])[2][0]
            if owner == row:
                shas[row] = sha
            rows.append((doc_id, row, owner, sha, None, None, None, None))
        yield _record(rows)
    yield from owners()


_GROUPS = "sha string, keep_id long, keep_row long, group_size long"


def _global_owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tries over the local owners of one partition: each terminal ends with the smallest row and the number of rows of one text."""
    trie = Patricia(_joined)
    for batch in batches:
        body, at = text_bytes(batch.column("body"))
        raw = body.tobytes()
        columns = (batch.column(c).to_pylist() for c in ("sha", "least_doc", "least_row", "n"))
        for k, (sha, doc_id, row, n) in enumerate(zip(*columns, strict=True)):
            trie.put(raw[at[k] : at[k + 1]], [sha, _place(doc_id, row), n])
    found: list = []

    def result() -> pa.RecordBatch:
        parts = zip(*found, strict=True) if found else [()] * 4
        return pa.record_batch([pa.array(x, t) for x, t in zip(parts, (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["sha", "keep_id", "keep_row", "group_size"])

    for _, (sha, (no_id, least, row), n) in trie.items():
        found.append((sha, None if no_id else least, row, n))
        if len(found) >= 50_000:
            yield result()
            found = []
    yield result()


def exact_dedup(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    norm = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), BLANKS, " ")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), norm.alias("norm")).withColumns({"sha": F.sha2(F.col("norm"), 256), "row_key": F.monotonically_increasing_id()})
    tagged = stored(rows.mapInArrow(_local_owners, _TAGGED), "owners")
    members, owners = tagged.where("n IS NULL").select("doc_id", "row_key", "owner", "sha"), tagged.where("n IS NOT NULL")
    dealt = owners.select("sha", "least_doc", "least_row", "n", "body").repartition(F.octet_length("body"), F.xxhash64("body"))
    groups = dealt.mapInArrow(_global_owners, _GROUPS)
    # A group has one owner for each task at most, and an owner the rows of one task: neither key is hot.
    named = owners.select("owner", "sha").join(groups, "sha").drop("sha")
    return members.join(named, "owner").select("doc_id", "keep_id", "group_size", (F.col("row_key") == F.col("keep_row")).alias("kept"), F.col("sha").alias("text_sha256"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = {
    "op7_exact_dedup": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id) = 1 AS kept, sha256(norm) AS text_sha256
FROM n"""
}
QUERIES = {"op7_exact_dedup": op7_exact_dedup}
