"""SentencePiece encoding and decoding: forward-filtering backward-sampling over the piece lattice.

A text is encoded as the model does it: a space in front, spaces as part of pieces, and bytes for characters without a piece. The
segmentation is drawn from the distribution that gives each segmentation a weight of the product of its pieces' weights: forward sums
over the lattice, then pieces drawn from the end to the front. The draws depend on `seed`, the row's key and the place in the text
only, so a rerun, on any partitioning, gives the same pieces. No piece has a space after another character or holds a newline (checked
when the vocabulary is read), so the lattice falls into independent chunks at those places; lattices of chunks are kept for
reuse within a task, up to a bound.

Decoding joins the pieces' bytes and drops the space in front: any text comes back byte for byte, U+2581 and control characters too.

Defined results: a null text has null ids and n_tokens 0, and counts as lossless; an empty one has no ids. Rows that repeat a key and
a text get the same ids. Extra columns are not read unless carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import mix64, slices, span_hashes, table, text_bytes, to_unit

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SEED = 42
#: Chunks whose lattices a task keeps; beyond that it starts anew.
MOST_CHUNKS = 180_000


@dataclass
class Vocabulary:
    """Pieces by id as bytes (a space where the model has U+2581), their log weights, the ids of the 256 byte pieces."""

    pieces: list[bytes]
    weight: np.ndarray
    usable: np.ndarray
    byte_ids: np.ndarray


def read_vocabulary(model: str = MODEL, temperature: float = 1.0) -> Vocabulary:
    """Read a SentencePiece model on the driver.

    A BPE model's scores are ranks 0, -1, -2, ...; such pieces get the weight 1 / (1 + rank), after Zipf. A unigram model's scores are
    log probabilities and stay. Both are divided by the temperature.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    n = sp.get_piece_size()
    score = np.array([sp.get_score(i) for i in range(n)])
    pieces, byte_ids, usable = [], np.full(256, -1, np.int32), np.zeros(n, bool)
    for i in range(n):
        name = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(name[1:-1], 16)] = i
            pieces.append(bytes([int(name[1:-1], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            pieces.append(b"")
        else:
            pieces.append(name.replace("▁", " ").encode())
            usable[i] = True
    ranks = (score == np.round(score)).all()
    weight = (-np.log1p(np.maximum(-score, 0.0)) if ranks else score) / temperature
    for p in (p for p, u in zip(pieces, usable, strict=True) if u):
        if b"\n" in p or b" " in p.lstrip(b" "):
            raise ValueError(f"a piece that crosses chunks: {p!r}")
    if (byte_ids < 0).any():
        raise ValueError("the model has no pieces for bytes, so not every text could be encoded")
    return Vocabulary(pieces, weight, usable, byte_ids)


class _Lattices:
    """Lattices of the chunks met so far, as arrays over edges sorted by the node in which they end."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        lengths: dict[int, list[int]] = {}
        for i in np.flatnonzero(vocabulary.usable):
            lengths.setdefault(len(vocabulary.pieces[i]), []).append(int(i))
        for n, ids in lengths.items():
            body = np.frombuffer(b"".join(vocabulary.pieces[i] for i in ids), np.uint8)
            start = np.arange(len(ids)) * n
            h = span_hashes(body, start, start + n)
            order = np.argsort(h)
            maybe = np.zeros(1 << 18, bool)  # by a hash's first 18 bits: whether a piece of this length has them
            maybe[h >> np.uint64(46)] = True
            self.by_length[n] = h[order], np.array(ids, np.int32)[order], maybe
        self.clear()

    def clear(self) -> None:
        self.known, self.which = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.base, self.end = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.first = np.zeros(0, np.int64)  # first edge into each node
        self.start, self.piece, self.upto = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.float32)

    def find(self, body: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Indexes of the chunks body[start:end], new ones added."""
        h = span_hashes(body, start, end)
        distinct, sample, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) > MOST_CHUNKS:
            self.clear()
        place = np.searchsorted(self.known, distinct)
        old = np.zeros(len(distinct), bool)
        inside = place < len(self.known)
        old[inside] = self.known[place[inside]] == distinct[inside]
        if not old.all():
            new = np.flatnonzero(~old)
            self._add(body, start[sample[new]], end[sample[new]])
            known = np.concatenate([self.known, distinct[new]])
            which = np.concatenate([self.which, np.arange(len(self.base) - len(new), len(self.base))])
            order = np.argsort(known, kind="stable")
            self.known, self.which = known[order], which[order]
            place = np.searchsorted(self.known, distinct)
        return self.which[place][inverse]

    def _add(self, source: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        size = end - start
        at = np.concatenate([[0], np.cumsum(size)])
        body = source[np.repeat(start - at[:-1], size) + np.arange(at[-1])]
        chunk = np.repeat(np.arange(len(size)), size)
        stop = at[1:][chunk]
        node = np.arange(at[-1]) + chunk  # the node before each byte; a chunk has one node more than bytes
        lead = (body & 0xC0) != 0x80
        width = np.where(body < 0xC0, 1, np.where(body < 0xE0, 2, np.where(body < 0xF0, 3, 4)))
        covered = np.zeros(len(body), bool)
        heads, tails, ids = [], [], []
        leads = np.flatnonzero(lead)
        for n, (hashes, piece_ids, maybe) in self.by_length.items():
            i = leads[leads + n <= stop[leads]]
            if not len(i):
                continue
            h = span_hashes(body, i, i + n)
            hit = maybe[h >> np.uint64(46)]
            i, h = i[hit], h[hit]
            place = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            hit = hashes[place] == h
            i, place = i[hit], place[hit]
            covered[i[width[i] == n]] = True
            heads.append(node[i])
            tails.append(node[i] + n)
            ids.append(piece_ids[place])
        bare = leads[~covered[leads]]
        for k in range(4):  # characters without a piece go byte by byte
            i = bare[width[bare] > k] + k
            heads.append(node[i])
            tails.append(node[i] + 1)
            ids.append(self.v.byte_ids[body[i]])
        head, tail, piece = np.concatenate(heads), np.concatenate(tails), np.concatenate(ids)
        order = np.lexsort((head, tail))
        head, tail, piece = head[order], tail[order], piece[order]

        nodes = at[-1] + len(size)
        own = np.repeat(at[:-1] + np.arange(len(size)), size + 1)  # each node's chunk's first node
        alpha = np.full(nodes, -np.inf)
        alpha[at[:-1] + np.arange(len(size))] = 0.0
        weight = self.v.weight[piece]
        depth = tail - own[tail]
        by_depth = np.argsort(depth, kind="stable")
        bounds = np.searchsorted(depth[by_depth], np.arange(1, int(depth.max(initial=0)) + 2))
        for low, high in zip(bounds[:-1], bounds[1:], strict=True):
            if low == high:
                continue
            e = by_depth[low:high]
            value, ends = alpha[head[e]] + weight[e], tail[e]
            group = np.flatnonzero(np.concatenate([[True], ends[1:] != ends[:-1]]))
            most = np.maximum.reduceat(value, group)
            most = np.where(np.isfinite(most), most, 0.0)
            run = np.diff(np.append(group, len(ends)))
            with np.errstate(divide="ignore"):
                alpha[ends[group]] = most + np.log(np.add.reduceat(np.exp(value - np.repeat(most, run)), group))
        with np.errstate(invalid="ignore"):
            p = np.exp(alpha[head] + weight - alpha[tail])
        p = np.where(np.isfinite(p), p, 0.0)
        first = np.searchsorted(tail, np.arange(nodes + 1))
        total = np.concatenate([[0.0], np.cumsum(p)])
        upto = total[1:] - total[first[tail]]
        last = first[1:][np.diff(first) > 0] - 1
        upto[last] = 2.0  # a draw never passes the last edge

        shift, edges = len(self.first), len(self.start)
        self.base = np.concatenate([self.base, at[:-1] + np.arange(len(size)) + shift])
        self.end = np.concatenate([self.end, at[1:] + np.arange(len(size)) + shift])
        self.first = np.concatenate([self.first, first[:-1] + edges])
        self.start = np.concatenate([self.start, (head + shift).astype(np.int32)])
        self.piece = np.concatenate([self.piece, piece])
        self.upto = np.concatenate([self.upto, upto.astype(np.float32)])

    def sample(self, chunk: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Draw a segmentation of each chunk, backward, with numbers from its key: all piece ids in order, and their number by chunk."""
        active, node, base = np.arange(len(chunk)), self.end[chunk], self.base[chunk]
        steps, count = [], np.zeros(len(chunk), np.int64)
        while len(active):
            u = to_unit(mix64(key[active] + np.uint64(len(steps) * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)))
            edge = self.first[node]
            below = np.flatnonzero(self.upto[edge] <= u)
            while len(below):
                edge[below] += 1
                below = below[self.upto[edge[below]] <= u[below]]
            steps.append((active, self.piece[edge]))
            count[active] += 1
            node = self.start[edge].astype(np.int64)
            more = node != base[active]
            active, node = active[more], node[more]
        at = np.concatenate([[0], np.cumsum(count)])
        out = np.zeros(at[-1], np.int32)
        for k, (who, ids) in enumerate(steps):
            out[at[who] + count[who] - 1 - k] = ids
        return out, count


def _with_space(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same rows with a space in front of each that is not empty."""
    size = np.diff(at)
    more = (size > 0).astype(np.int64)
    new = np.concatenate([[0], np.cumsum(size + more)])
    out = np.full(new[-1], 32, np.uint8)
    out[np.arange(len(body)) + np.repeat(np.cumsum(more), size)] = body
    return out, new


def _chunks(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of chunks: cut at rows, before a space that follows another character, and around newlines."""
    if not len(body):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(len(body), bool)
    space, line = body == 32, body == 10
    cut[1:] = (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
    cut[at[:-1][at[:-1] < len(body)]] = True
    start = np.flatnonzero(cut)
    return start, np.append(start[1:], len(body))


def decode_ids(ids: np.ndarray, at: np.ndarray, table_at: np.ndarray, table_body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of rows of ids: the pieces' bytes joined, without the space in front."""
    size = np.diff(table_at)[ids]
    end = np.concatenate([[0], np.cumsum(size)])
    body = table_body[np.repeat(table_at[:-1][ids] - end[:-1], size) + np.arange(end[-1])]
    row = end[at]
    keep = np.ones(len(body), bool)
    keep[row[:-1][np.diff(at) > 0]] = False
    return body[keep], np.concatenate([[0], np.cumsum(np.diff(row) - (np.diff(at) > 0))])


def _encoder(vocabulary: Vocabulary, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = _Lattices(vocabulary)
        table_at = np.concatenate([[0], np.cumsum([len(p) for p in vocabulary.pieces])])
        table_body = np.frombuffer(b"".join(vocabulary.pieces), np.uint8)
        for batch in slices(batches, "body", 1 << 20):
            column = batch.column("body")
            plain, plain_at = text_bytes(column)
            body, at = _with_space(plain, plain_at)
            start, end = _chunks(body, at)
            row = np.searchsorted(at, start, side="right") - 1
            place = np.arange(len(start)) - np.searchsorted(start, at[:-1])[row]
            keys = mix64(batch.column("row_key").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            ids, count = lattices.sample(lattices.find(body, start, end), mix64(keys[row] + place.astype(np.uint64)))
            id_at = np.concatenate([[0], np.cumsum(np.bincount(row, weights=count, minlength=batch.num_rows).astype(np.int64))])
            back, back_at = decode_ids(ids, id_at, table_at, table_body)
            if len(back) == len(plain) and (back_at == plain_at).all() and (back == plain).all():
                same = np.ones(batch.num_rows, bool)
            else:
                same = np.array([back[a:b].tobytes() == plain[c:d].tobytes() for a, b, c, d in zip(back_at[:-1], back_at[1:], plain_at[:-1], plain_at[1:], strict=True)])
            lists = pa.ListArray.from_arrays(pa.array(id_at, pa.int32()), pa.array(ids, pa.int32()), mask=column.is_null())
            carry = [c for c in batch.schema.names if c not in ("body", "row_key")]
            yield pa.record_batch([*(batch.column(c) for c in carry), pa.array(np.diff(id_at), pa.int64()), lists, pa.array(same)], names=[*carry, "n_tokens", "ids", "lossless"])

    return run


def encode(docs: DataFrame, carry: list[str], *, text: str = "text", key: str = "doc_id", model: str = MODEL, temperature: float = 1.0, seed: int = SEED) -> DataFrame:
    """The columns `carry`, n_tokens, ids (array<int>) and lossless (decoding the ids gave the text back) of each row of docs."""
    kinds = dict(docs.dtypes)
    row_key = F.col(key) if kinds[key] in ("bigint", "int") else F.xxhash64(key)
    rows = docs.select(*carry, F.coalesce(row_key.cast("long"), F.lit(0)).alias("row_key"), F.col(text).cast("binary").alias("body"))
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in carry)
    return rows.mapInArrow(_encoder(read_vocabulary(model, temperature), seed), f"{schema}, n_tokens long, ids array<int>, lossless boolean")


def decode(rows: DataFrame, carry: list[str], *, ids: str = "ids", model: str = MODEL) -> DataFrame:
    """The columns `carry` and text (null for null ids) of each row."""
    pieces = read_vocabulary(model).pieces
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_at = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        table_body = np.frombuffer(b"".join(pieces), np.uint8)
        for batch in batches:
            column = batch.column(ids)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            size = np.array([0 if x is None else x for x in pa.compute.list_value_length(column).to_pylist()], np.int64)
            body, at = decode_ids(flat, np.concatenate([[0], np.cumsum(size)]), table_at, table_body)
            raw = body.tobytes()
            texts = [raw[a:b].decode() if ok else None for a, b, ok in zip(at[:-1], at[1:], column.is_valid().to_pylist(), strict=True)]
            yield pa.record_batch([*(batch.column(c) for c in carry), pa.array(texts, pa.string())], names=[*carry, "text"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in carry)
    return rows.select(*carry, ids).mapInArrow(run, f"{schema}, text string")


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), ["doc_id"])


QUERIES = {"op2_pieces": op2_pieces}
SQL: dict[str, str] = {}
