"""Language-model scoring by a hierarchical Pitman-Yor process whose seating is sampled by Gibbs sweeps.

Each context is a restaurant whose dishes are words; all context restaurants share one parent, the restaurant of single words, whose base
is uniform over the known words and one more. A context is the word before, hashed to one of CONTEXTS restaurants, so the totals by
restaurant are a vector of a fixed size. In a Gibbs sweep the customers of every dish leave each restaurant together and take their
seats again, one after the other, by the Chinese restaurant rule, given all other seats as the sweep before left them; a word's tables are
its customers in the parent. The predictive probabilities of the last SAMPLES sweeps are averaged.

Documents go by blocks. A block sends each distinct pair of word and context to the word's bucket once (a frequent word is cut by contexts), with
its training count and no document: what the buckets gather grows with the corpus. Which documents have a pair stays with the block, as numbers
of its own pairs and documents. Words by bucket are then a table in the shared folder; each sweep is a pass over it that needs the totals of the
sweep before and returns its own, summed by Spark: CONTEXTS numbers, and one for each frequent word, of which there are at most
1 / LEAST_SHARE. At last a bucket answers each block with the scores of its pairs, in the block's order, and the block sums them by document. So no
row is made for a document and a bucket, and what is shuffled is in proportion to the text. Scores go as whole numbers of 1 / UNIT, so sums don't
depend on their order. Random numbers are hashes of word, context, sweep and customer, so neither partitioning nor lost executors change a result.
Customers of one dish in one restaurant come in blocks of a sixteenth of those seated before, one by one at first; a block draws its number of
new tables from a binomial distribution.

Defined results: a null text counts as empty and has one token, the end. Rows that repeat a doc_id are scored each. A text of any length is read
whole. Words of equal counts have no order. Without training documents all words are unknown; N and V are then 0. An empty table gives an empty
result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import mix64, pack, slices, span_hashes, stored, table, text_bytes, to_unit, token_spans, unpack

CONTEXTS = 1 << 16
DISCOUNT, STRENGTH = 0.75, 2.0
PARENT_DISCOUNT, PARENT_STRENGTH = 0.6, 20.0
SWEEPS, SAMPLES = 3, 2
SEED = 42
#: Text bytes for each bucket of words.
BUCKET_BYTES = 8 << 20
#: Text bytes for each block of documents, and for each piece of it that is cut into words at once.
BLOCK_BYTES, PIECE_BYTES = 8 << 20, 2 << 20
#: Scores of pairs are sent as multiples of this part of one: at most 5e-10 off.
UNIT = 1 << 30
#: Documents that tell which words are frequent; this only steers how the work is cut.
SAMPLE_DOCS = 2000
#: Words of a smaller share of all tokens are never cut.
LEAST_SHARE = 1e-5
#: One in so many of the customers seated so far comes at once, at least one.
BLOCK = 16
_END, _START = np.uint64(0x452821E638D01377), np.uint64(0xBE5466CF34E90C6C)


@dataclass
class Totals:
    """What a sweep leaves for the next one; frequent words are in the order of `Plan.frequent`."""

    tables: np.ndarray  # by context
    parent_tables: float
    parent_customers: float
    frequent_customers: np.ndarray
    frequent_tables: np.ndarray


@dataclass
class Plan:
    buckets: int
    frequent: np.ndarray  # sorted hashes
    parts: np.ndarray  # into how many buckets each is cut
    known: float = 0.0  # V
    tokens: float = 0.0  # N
    customers: np.ndarray = field(default_factory=lambda: np.zeros(CONTEXTS))
    frequent_count: np.ndarray = field(default_factory=lambda: np.zeros(0))
    sweeps: list[Totals] = field(default_factory=list)


def _sequence(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hash, context and row of each token, the end of each text included."""
    body, at = text_bytes(batch.column("text"))
    body = np.where((body >= 65) & (body <= 90), body + 32, body).astype(np.uint8)
    start, end, row = token_spans(body, at)
    n = batch.num_rows
    words = np.full(len(start) + n, _END, np.uint64)
    words[np.arange(len(start)) + row] = span_hashes(body, start, end)
    rows = np.repeat(np.arange(n), np.bincount(row, minlength=n) + 1)
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[np.searchsorted(rows, np.arange(n))] = _START
    return words, (mix64(before) % np.uint64(CONTEXTS)).astype(np.int64), rows


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        words, count = np.unique(_sequence(batch)[0], return_counts=True)
        yield pa.record_batch([pa.array(words.view(np.int64)), pa.array(count)], names=["word", "n"])


def _planes(*arrays: np.ndarray) -> bytes:
    """Numbers packed by the place of their bytes, so that the bytes that say little stand together."""
    return pack([np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T.ravel() for a in arrays])


def _numbers(blob: bytes, *types: type) -> list[np.ndarray]:
    return [np.ascontiguousarray(a.reshape(np.dtype(t).itemsize, -1).T).view(t).ravel() for a, t in zip(unpack(blob), types, strict=True)]


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _lengths(heads: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(heads, n))


#: Distinct words as differences, the number of pairs of each, and the context and training count of each pair.
_PAIRS = (np.uint64, np.uint32, np.uint32, np.int64)
#: The documents' doc_id and whether it is null; of each pair the number of its documents; these documents, and how often they have the pair.
_TOKENS = (np.int64, np.uint8, np.uint32, np.uint32, np.uint32)
#: Names of blocks, how many pairs each asks for, and which these are in the bucket, as differences.
_ASKS = (np.int64, np.uint32, np.int64)
#: The score of each pair in -1 / UNIT, the number of pairs of each word, and the word's training count.
_ANSWER = (np.int64, np.uint32, np.int64)


def _packed_pairs(words: np.ndarray, context: np.ndarray, count: np.ndarray) -> bytes:
    head = _heads(words)
    return _planes(np.diff(words[head], prepend=np.uint64(0)), _lengths(head, len(words)).astype(np.uint32), context.astype(np.uint32), count.astype(np.int64))


def _unpacked_pairs(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words, the number of each pair's word among them, and context and training count of each pair."""
    steps, runs, context, count = _numbers(blob, *_PAIRS)
    return np.cumsum(steps, dtype=np.uint64), np.repeat(np.arange(len(runs)), runs), context, count


_ROWS = "bucket int, block long, data binary"


def _rows(bucket: list[int], block: list[int], data: list[bytes]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(bucket, pa.int32()), pa.array(block, pa.int64()), pa.array(data, pa.binary())], names=["bucket", "block", "data"])


def _packer(plan: Plan):
    """Of each block, a row for each bucket with its pairs, and one for its documents, whose bucket is below 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BLOCK_BYTES):
            words, context, rows = _block_sequence(batch)
            order = np.lexsort((context, words))  # stable: rows ascend within a pair
            words, context, rows = words[order], context[order], rows[order]
            bucket = _bucket(plan, words, context)
            order = np.argsort(bucket, kind="stable")
            words, context, rows = words[order], context[order], rows[order]
            # One entry for each (word, context, document), with a count.
            entry = _heads(words, context, rows)
            times = _lengths(entry, len(words))
            bucket, words, context, rows = bucket[order][entry], words[entry], context[entry], rows[entry]
            pair = _heads(words, context)
            train = batch.column("train").to_numpy(zero_copy_only=False).astype(np.int64)
            count = np.add.reduceat(times * train[rows], pair)
            ids, docs = batch.column("own"), batch.column("doc_id").to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore"):  # a block's name depends on its documents only
                name = int(mix64(mix64(docs.astype(np.int64).view(np.uint64)) + np.arange(len(docs), dtype=np.uint64)).sum().view(np.int64))
            own = [ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)]
            tokens = _planes(*own, _lengths(pair, len(words)).astype(np.uint32), rows.astype(np.uint32), times.astype(np.uint32))
            bucket, words, context = bucket[pair], words[pair], context[pair]
            edge = _heads(bucket)
            parts = [_packed_pairs(words[low:high], context[low:high], count[low:high]) for low, high in zip(edge, np.append(edge[1:], len(bucket)), strict=True)]
            yield _rows([-1 - name % plan.buckets, *bucket[edge].tolist()], [name] * (len(edge) + 1), [tokens, *parts])

    return run


def _block_sequence(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found, start = [], 0
    for piece in slices(iter([batch]), "text", PIECE_BYTES):
        words, context, rows = _sequence(piece)
        found.append((words, context, rows + start))
        start += piece.num_rows
    words, context, rows = map(np.concatenate, zip(*found, strict=True))
    return words, context, rows


def _bucket(plan: Plan, words: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Buckets are ranges of hashes, so the words that a block sends to one are near each other and their differences small."""
    home = ((words >> np.uint64(32)) * np.uint64(plan.buckets)) >> np.uint64(32)
    if len(plan.frequent):
        place = np.minimum(np.searchsorted(plan.frequent, words), len(plan.frequent) - 1)
        hit = plan.frequent[place] == words
        parts = np.where(hit, plan.parts[place], 1).astype(np.uint64)
        home = (home + mix64(context.astype(np.uint64)) % parts) % np.uint64(plan.buckets)
    return home.astype(np.int32)


_MERGED = "bucket int, block long, pairs binary, data binary"


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All blocks of a bucket, which follow one another, to one row: pairs of word and context with training counts, and the pairs that each
    block asks for. The rows of documents pass as they are.

    Rows stay packed, since many rows make one Arrow batch.
    """
    bucket, names, blocks = None, [], []

    def row(bucket: int, block: int | None, pairs: bytes | None, data: bytes) -> pa.RecordBatch:
        return pa.record_batch([pa.array([bucket], pa.int32()), pa.array([block], pa.int64()), pa.array([pairs], pa.binary()), pa.array([data], pa.binary())], names=["bucket", "block", "pairs", "data"])

    def done() -> pa.RecordBatch:
        words, context, count = [], [], []
        for block in blocks:
            w, of, c, n = _unpacked_pairs(block)
            words.append(w[of])
            context.append(c)
            count.append(n)
        sizes = np.array([len(c) for c in count], np.uint32)
        w, c, n = map(np.concatenate, (words, context, count))
        order = np.lexsort((c, w))
        w, c, n = w[order], c[order], n[order]
        head = _heads(w, c)
        asked = np.empty(len(w), np.int64)
        asked[order] = np.repeat(np.arange(len(head)), _lengths(head, len(w)))
        return row(bucket, None, _packed_pairs(w[head], c[head], np.add.reduceat(n, head)), _planes(np.array(names, np.int64), sizes, np.diff(asked, prepend=0)))

    for batch in batches:
        for name, block, data in zip(batch.column("bucket").to_pylist(), batch.column("block").to_pylist(), batch.column("data"), strict=True):
            if name < 0:
                yield row(name, block, None, data.as_py())
                continue
            if name != bucket and blocks:
                yield done()
                names, blocks = [], []
            bucket = name
            names.append(block)
            blocks.append(data.as_py())
    if blocks:
        yield done()


def seat(customers: np.ndarray, others: np.ndarray, base: np.ndarray, name: np.ndarray, discount: float) -> np.ndarray:
    """Tables that each dish gets when its customers are seated one after the other.

    others: strength plus discount times the tables of all other dishes; base: the dish's probability in the parent restaurant.
    """
    tables = (customers > 0).astype(np.float64)
    order = np.argsort(-customers, kind="stable")
    c, o, b, key, t = customers[order], others[order], base[order], name[order], tables[order]
    n = 1
    m = int(np.searchsorted(-c, -(n + 1), side="right"))  # dishes with more than n customers
    while m:
        # Up to 15 customers come one by one; then a sixteenth of those seated comes at a time, each with the same chance of a new table.
        size = np.minimum(c[:m] - n, max(1, n // BLOCK)).astype(np.int64)
        fresh = (o[:m] + discount * t[:m]) * b[:m]
        t[:m] += _binomial(size, fresh / (n - discount * t[:m] + fresh + (size - 1) / 2), key[:m], n)
        n += max(1, n // BLOCK)
        m = int(np.searchsorted(-c, -(n + 1), side="right"))
    tables[order] = t
    return tables


def _binomial(size: np.ndarray, p: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """A binomial draw for each entry by inverting its distribution at a hash of key and n; in the far tail of large sizes the sum stops."""
    with np.errstate(over="ignore"):
        u = to_unit(mix64(key + np.uint64(n)))
    p = np.clip(p, 0.0, 1.0 - 1e-12)
    out = np.zeros(len(size))
    with np.errstate(under="ignore"):
        log_none = size * np.log1p(-p)
        # Where no success is too unlikely to be a number, the mean is large and the distribution is normal to well within a table.
        wide = log_none < -600
        if wide.any():
            again = to_unit(mix64(key[wide] ^ np.uint64(n)))
            spread = np.sqrt(-2 * np.log(u[wide])) * np.cos(2 * np.pi * again)
            out[wide] = np.clip(np.rint(size[wide] * p[wide] + np.sqrt(size[wide] * p[wide] * (1 - p[wide])) * spread), 0, size[wide])
        term = np.where(wide, 1.0, np.exp(np.maximum(log_none, -600)))
        upto, k = term.copy(), 0
        live = np.flatnonzero((u > upto) & ~wide)
        while len(live):
            term[live] *= (size[live] - k) / (k + 1) * p[live] / (1 - p[live])
            upto[live] += term[live]
            k += 1
            out[live] = k
            live = live[(u[live] > upto[live]) & (k < size[live])]
    return out


class _Chain:
    """The seats of one bucket's words, sweep after sweep."""

    def __init__(self, plan: Plan, pairs: bytes):
        self.plan = plan
        self.words, self.of, context, self.count = _unpacked_pairs(pairs)
        self.pair_word = self.words[self.of]
        self.context = context.astype(np.int64)
        self.word_count = np.bincount(self.of, weights=self.count, minlength=len(self.words))
        self.cut = np.zeros(len(self.words), bool)
        if len(plan.frequent):
            self.place = np.minimum(np.searchsorted(plan.frequent, self.words), len(plan.frequent) - 1)
            self.cut = plan.frequent[self.place] == self.words
            if len(plan.frequent_count):
                self.word_count[self.cut] = plan.frequent_count[self.place[self.cut]]

    def start(self) -> None:
        self.tables = (self.count > 0).astype(np.float64)
        self._share(0)
        self.parent = (self.customers > 0).astype(np.float64)

    def _share(self, sweep: int) -> None:
        """Customers in the parent; for words cut over several buckets those that the sweep's totals give."""
        self.own = np.bincount(self.of, weights=self.tables, minlength=len(self.words))
        self.customers = self.own.copy()
        if sweep < len(self.plan.sweeps):
            self.customers[self.cut] = self.plan.sweeps[sweep].frequent_customers[self.place[self.cut]] if self.cut.any() else 0

    def base(self, totals: Totals) -> np.ndarray:
        return parent_probability(self.customers, self.parent, totals, self.plan)

    def sweep(self, number: int) -> None:
        """From the state after sweep number - 1 and its totals to the state after `number`."""
        last = self.plan.sweeps[number - 1]
        with np.errstate(over="ignore"):
            key = mix64(self.pair_word ^ mix64(self.context.astype(np.uint64) + np.uint64(number * 0x10001 + SEED)))
        p = self.base(last)[self.of]
        self.tables = seat(self.count, STRENGTH + DISCOUNT * np.maximum(last.tables[self.context] - self.tables, 0), p, key, DISCOUNT)
        self._share(number)
        self.parent = parent_seats(self.words, self.customers, self.parent, last, self.plan, number)

    def probability(self, totals: Totals) -> np.ndarray:
        fresh = (STRENGTH + DISCOUNT * totals.tables[self.context]) * self.base(totals)[self.of]
        return (self.count - DISCOUNT * self.tables + fresh) / (STRENGTH + self.plan.customers[self.context])


def parent_probability(customers: np.ndarray, tables: np.ndarray, totals: Totals, plan: Plan) -> np.ndarray:
    fresh = (PARENT_STRENGTH + PARENT_DISCOUNT * totals.parent_tables) / (plan.known + 1)
    return (customers - PARENT_DISCOUNT * tables + fresh) / (PARENT_STRENGTH + totals.parent_customers)


def parent_seats(words: np.ndarray, customers: np.ndarray, before: np.ndarray, totals: Totals, plan: Plan, number: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        key = mix64(words ^ np.uint64(number * 0x1000003 + SEED))
    others = PARENT_STRENGTH + PARENT_DISCOUNT * np.maximum(totals.parent_tables - before, 0)
    return seat(customers.astype(np.int64), others, np.full(len(words), 1 / (plan.known + 1)), key, PARENT_DISCOUNT)


def _summer(plan: Plan, number: int):
    """Totals of the state after sweep `number`, by kind: 0 tables by context, 1 customers in the parent by frequent word,
    2 parent tables and customers of other words; for number 0 also 3 training customers by context, 4 counts of frequent words, 5 V and N."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_context, customers = np.zeros(CONTEXTS), np.zeros(CONTEXTS)
        frequent, counts = np.zeros(len(plan.frequent)), np.zeros(len(plan.frequent))
        tables = shares = known = tokens = 0.0
        for batch in batches:
            for pairs in batch.column("pairs"):
                chain = _Chain(plan, pairs.as_py())
                chain.start()
                for k in range(1, number + 1):
                    chain.sweep(k)
                by_context += np.bincount(chain.context, weights=chain.tables, minlength=CONTEXTS)
                tables += chain.parent[~chain.cut].sum()
                shares += chain.own[~chain.cut].sum()
                if chain.cut.any():
                    np.add.at(frequent, chain.place[chain.cut], chain.own[chain.cut])
                if not number:
                    customers += np.bincount(chain.context, weights=chain.count, minlength=CONTEXTS)
                    known += (chain.word_count[~chain.cut] > 0).sum()
                    tokens += chain.count.sum()
                    if chain.cut.any():
                        np.add.at(counts, chain.place[chain.cut], np.bincount(chain.of, weights=chain.count, minlength=len(chain.words))[chain.cut])
        found = [(0, by_context), (1, frequent), (2, np.array([tables, shares]))]
        if not number:
            found += [(3, customers), (4, counts), (5, np.array([known, tokens]))]
        kind = np.concatenate([np.full(len(v), k) for k, v in found])
        key = np.concatenate([np.arange(len(v)) for _, v in found])
        value = np.concatenate([v for _, v in found])
        some = value != 0
        yield pa.record_batch([pa.array(kind[some], pa.int32()), pa.array(key[some], pa.int32()), pa.array(value[some], pa.float64())], names=["kind", "key", "value"])

    return run


def _totals(words: DataFrame, plan: Plan, number: int) -> dict[int, np.ndarray]:
    rows = words.select("pairs").mapInArrow(_summer(plan, number), "kind int, key int, value double")
    found = rows.groupBy("kind", "key").agg(F.sum("value").alias("value")).toPandas()
    sizes = {0: CONTEXTS, 1: len(plan.frequent), 2: 2, 3: CONTEXTS, 4: len(plan.frequent), 5: 2}
    out = {}
    for kind, size in sizes.items():
        part = found[found["kind"] == kind]
        out[kind] = np.zeros(size)
        out[kind][part["key"].to_numpy()] = part["value"].to_numpy()
    return out


def _learn(words: DataFrame, plan: Plan) -> None:
    """Fill the plan: counts, then the totals after each sweep."""
    for number in range(SWEEPS + 1):
        found = _totals(words, plan, number)
        if not number:
            plan.customers, plan.frequent_count = found[3], found[4]
            plan.known, plan.tokens = found[5][0] + (found[4] > 0).sum(), found[5][1]
            tables = (found[1] > 0).astype(float)
        else:
            tables = parent_seats(plan.frequent, found[1], plan.sweeps[-1].frequent_tables, plan.sweeps[-1], plan, number)
        plan.sweeps.append(Totals(found[0], found[2][0] + tables.sum(), found[2][1] + found[1].sum(), found[1], tables))


def _scorer(plan: Plan):
    """Of each bucket, a row for each block that asks it: the scores of its pairs and the training counts of their words, in the block's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, pairs, data in zip(batch.column("bucket").to_pylist(), batch.column("pairs"), batch.column("data"), strict=True):
                chain = _Chain(plan, pairs.as_py())
                chain.start()
                p, taken = np.zeros(len(chain.count)), 0
                for k in range(1, SWEEPS + 1):
                    chain.sweep(k)
                    if k > SWEEPS - SAMPLES:
                        p += chain.probability(plan.sweeps[k])
                        taken += 1
                score = np.rint(-np.log10(p / taken) * UNIT).astype(np.int64)
                words = chain.word_count.astype(np.int64)
                names, sizes, steps = _numbers(data.as_py(), *_ASKS)
                asked, end, answers = np.cumsum(steps), np.cumsum(sizes, dtype=np.int64), []
                for low, high in zip(end - sizes, end, strict=True):
                    mine = asked[low:high]
                    of = chain.of[mine]
                    head = _heads(of)
                    answers.append(_planes(score[mine], _lengths(head, len(of)).astype(np.uint32), words[of[head]]))
                yield _rows([bucket] * len(names), names.tolist(), answers)

    return run


_SCORED = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _documents(plan: Plan):
    """The documents of each block, whose rows follow one another: its own first, then the answers by bucket."""

    def done(name: int, own: list[bytes], answers: list[bytes]) -> Iterator[pa.RecordBatch]:
        found = [_numbers(a, *_ANSWER) for a in answers]
        score = np.concatenate([s for s, _, _ in found])
        count = np.concatenate([np.repeat(c, runs) for _, runs, c in found])
        base = np.log10((count + 0.1) / (plan.tokens + 0.1 * (plan.known + 1)))
        for tokens in own:
            ids, none, each, doc, times = _numbers(tokens, *_TOKENS)
            if len(each) != len(score):
                raise RuntimeError(f"block {name} has {len(each)} pairs and {len(score)} answers: its rows changed between two readings")
            pair = np.repeat(np.arange(len(each)), each)
            sums = [np.bincount(doc, weights=w, minlength=len(ids)) for w in (times, times * (count > 0)[pair], times * base[pair], times * score[pair].astype(np.float64))]
            yield pa.record_batch([pa.array(ids, mask=none.astype(bool)), pa.array(sums[0].astype(np.int64)), pa.array(sums[1].astype(np.int64)), pa.array(sums[2]), pa.array(-sums[3] / UNIT)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, last, own, answers = None, -1, [], []
        for batch in batches:
            for bucket, block, data in zip(batch.column("bucket").to_pylist(), batch.column("block").to_pylist(), batch.column("data"), strict=True):
                if block != name:
                    if own or answers:
                        yield from done(name, own, answers)
                    name, last, own, answers = block, -1, [], []
                if bucket < 0:
                    own.append(data.as_py())
                elif bucket != last:  # blocks of the same rows have one name, and the same answers
                    answers.append(data.as_py())
                    last = bucket
        if own or answers:
            yield from done(name, own, answers)

    return run


def _plan(rows: DataFrame) -> Plan:
    """Buckets by the bytes of text; frequent words from a sample of documents, chosen by hash."""
    n, size = rows.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    buckets = max(1, -(-(size or 0) // BUCKET_BYTES))
    share = max(1, (n or 0) // SAMPLE_DOCS)
    counted = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0).mapInArrow(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    total = counted.agg(F.sum("n")).first()[0] or 0
    found = counted.where(F.col("n") > F.lit(total * max(LEAST_SHARE, 0.25 / buckets))).toPandas() if total else None
    if found is None or found.empty:
        return Plan(buckets, np.zeros(0, np.uint64), np.zeros(0, np.int64))
    words = found["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(words)
    parts = np.ceil(found["n"].to_numpy()[order] / total * 4 * buckets).astype(np.int64)
    return Plan(buckets, words[order], np.maximum(parts, 1))


def score(docs: DataFrame, train: Column, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score and train_tokens of each row of docs; the model learns from the rows where train is true.

    Inside, a block of rows goes by a hash of their doc_id and text; each row is scored by itself.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("own"), F.xxhash64(F.col(key).cast("long"), body).alias("doc_id"), body.alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    plan = _plan(rows)
    packed = rows.mapInArrow(_packer(plan), _ROWS)
    kept = stored(packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_merge, _MERGED), "words")
    words = kept.where("bucket >= 0")
    _learn(words, plan)
    answers = words.select("bucket", "pairs", "data").mapInArrow(_scorer(plan), _ROWS)
    of_blocks = kept.where("bucket < 0").select("bucket", "block", "data").union(answers)
    scored = of_blocks.repartition("block").sortWithinPartitions("block", "bucket").mapInArrow(_documents(plan), _SCORED)
    return scored.select("*", F.lit(int(plan.tokens)).cast("long").alias("train_tokens"))


def op9_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10)) == 0
    scored = score(table(spark, sf_dir, "documents"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op9_pitman_yor": op9_pitman_yor}
SQL: dict[str, str] = {}
