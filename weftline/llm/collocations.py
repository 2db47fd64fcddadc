"""Phrase collocation mining by hierarchical pair naming.

Level 1 names the frequent words of each language. Level k replaces adjacent frequent (k-1)-grams (which overlap in all but one word) by
the name of their pair: a k-gram is its left and right (k-1)-gram, so names double as parent pointers, and no k-gram is counted whose parts are
not frequent. Candidates walk these pointers to the counts of their first and last words (the cuts), and every longer phrase marks its two parents
as parts (subsumption: of the longer phrases that hold a phrase, the most frequent ones are one word longer, since each longer one holds such a one).

Documents become blocks of one language: the sequence of the block's own word numbers, with breaks between pieces. In each level a block deals
its distinct pairs, as global names with counts, to buckets by a hash of the pair; a bucket holds all counts of its pairs, adds them up, and names
the frequent ones; each block gets back the names of its own pairs. Words and pairs are compared in full, never by hash. A frequent pair costs
one entry for each block, whatever its count; blocks and buckets hold a bounded size of text or a single longer text.

Counts are whole numbers, scores are divided as decimals of 38 digits. The best phrases of a language are ranked in parts first.

Defined results: a null text counts as empty, a null lang as 'und' (and so meets documents of that lang). Equal scores and counts are ordered by the
phrase's UTF-8 bytes. A language without a candidate has no row. Rows that repeat a doc_id count as documents of their own; doc_id is not read. A text of any
length is one block at least, whole. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import distinct_words, mix64, number_of_buckets, pack, slices, spans_of, stored, table, text_bytes, unpack, word_buckets

#: Words of the longest candidate, occurrences it needs, and phrases of each language in the result.
WORDS = 3
LEAST = 10
TOP = 2000
#: A phrase goes if a longer one that holds it has this share (in percent) of its occurrences.
SUBSUMED = 50
#: Text bytes of the blocks that a task holds at once, and for each bucket of names.
BLOCK_BYTES = 16 << 20
BUCKET_BYTES = 8 << 20
#: Parts of a language that are ranked on their own before the whole.
PARTS = 64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes that end a piece, and bytes of words.
_ENDS = np.isin(np.arange(256), [*b".,;:!?", 10, 11, 12, 13])
_INSIDE = ~_ENDS & ~np.isin(np.arange(256), [9, 32])


def word_blocks(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The numbers of the words of all texts in order, -1 between pieces, and the distinct words."""
    body, at = text_bytes(column)
    body = _LOWER[body]
    black = _INSIDE[body]
    start, end, row = spans_of(black, at)
    if not len(start):
        return np.zeros(0, np.int64), pa.array([], pa.binary())
    word, words = distinct_words(body, black, start, end)
    ends = np.searchsorted(np.flatnonzero(_ENDS[body]), start)
    apart = np.flatnonzero((row[1:] != row[:-1]) | (ends[1:] != ends[:-1])) + 1
    return np.insert(word, apart, -1), words


_DEALT = "block long, lang string, bucket int, body binary"


def _dealt(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * 4
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int32(), pa.binary()), strict=True)], names=["block", "lang", "bucket", "body"])


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket.astype(np.uint16) if bucket.max(initial=0) < 1 << 16 else bucket, kind="stable")
    if not len(order):
        return
    edge = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0]))
    for low, high in zip(edge, [*edge[1:], len(order)], strict=True):
        yield int(bucket[order[low]]), order[low:high]


def _blocks(buckets: int):
    """Each block's sequence (bucket is null), and its words with counts, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, held, size = TaskContext.get().partitionId(), 0, {}, 0

        def emptied() -> Iterator[pa.RecordBatch]:
            nonlocal made
            for lang, parts in held.items():
                sequence, words = word_blocks(pa.concat_arrays(parts))
                if not len(sequence):
                    continue
                block, rows = (task << 32) + made, []
                made += 1
                rows.append((block, lang, None, pack([sequence.astype(np.int32).view(np.uint32), np.array([len(words)], np.int64)])))
                count = np.bincount(sequence[sequence >= 0], minlength=len(words))
                for bucket, mine in _by_bucket(word_buckets(words, buckets)):
                    body, at = text_bytes(words.take(pa.array(mine)))
                    rows.append((block, lang, bucket, pack([body, np.diff(at).astype(np.uint32), count[mine].astype(np.uint32), mine.astype(np.uint32)])))
                yield _dealt(rows)

        for batch in batches:
            for part in slices([batch], "body", BLOCK_BYTES):
                langs = part.column("lang").dictionary_encode()
                for k, lang in enumerate(langs.dictionary.to_pylist()):
                    held.setdefault(lang, []).append(part.column("body").filter(pa.compute.equal(langs.indices, k)))
                size += part.nbytes
                if size >= BLOCK_BYTES:
                    yield from emptied()
                    held, size = {}, 0
        yield from emptied()

    return run


_NAMED = "block long, lang string, id long, left long, right long, word string, f long, body binary"


def _named(block: list, lang: list, body: list, ids=(), left=(), right=(), word=None, f=()) -> pa.Table:
    """Replies to blocks (block, lang, body) and then names."""
    n, m = len(ids), len(block)
    none = pa.nulls(m, pa.int64())
    columns = {
        "block": pa.concat_arrays([pa.array(block, pa.int64()), pa.nulls(n, pa.int64())]), "lang": pa.array([*lang[:m], *lang[m:]], pa.string()),
        "id": pa.concat_arrays([none, pa.array(ids, pa.int64())]), "left": pa.concat_arrays([none, pa.array(left, pa.int64()) if len(left) else pa.nulls(n, pa.int64())]),
        "right": pa.concat_arrays([none, pa.array(right, pa.int64()) if len(right) else pa.nulls(n, pa.int64())]),
        "word": pa.concat_arrays([pa.nulls(m, pa.string()), word.cast(pa.string()) if word is not None else pa.nulls(n, pa.string())]),
        "f": pa.concat_arrays([none, pa.array(f, pa.int64())]), "body": pa.concat_arrays([pa.array(body, pa.binary()), pa.nulls(n, pa.binary())]),
    }
    return pa.table(columns)


def _name_words(least: int):
    """One bucket: the words of each language with `least` occurrences or more get a name; every language's occurrences go into a row without one."""

    def run(dealt: pa.Table) -> pa.Table:
        dealt = dealt.combine_chunks()
        first, out = int(dealt.column("bucket")[0].as_py()) << 40, []
        langs = dealt.column("lang").combine_chunks().dictionary_encode()
        bodies, blocks = dealt.column("body"), dealt.column("block").to_numpy()
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            mine = np.flatnonzero(langs.indices.to_numpy() == k)
            parts = [unpack(bodies[int(i)].as_py()) for i in mine]
            sizes = np.concatenate([p[1] for p in parts])
            at = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
            if at[-1] >= 1 << 31:
                words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(at), pa.py_buffer(np.concatenate([p[0] for p in parts]))]).dictionary_encode()
            else:
                words = pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.concatenate([p[0] for p in parts]))]).dictionary_encode()
            word = words.indices.to_numpy()
            total = np.zeros(len(words.dictionary), np.int64)
            np.add.at(total, word, np.concatenate([p[2] for p in parts]).astype(np.int64))
            kept = np.flatnonzero(total >= least)
            ids = np.full(len(total), -1, np.int64)
            ids[kept] = first + np.arange(len(kept))
            first += len(kept)
            replies = _replies(ids[word], parts, 3)
            out.append(_named(blocks[mine[[i for i, _ in replies]]] if replies else [], [lang] * (len(replies) + len(kept)), [b for _, b in replies], ids=ids[kept], word=words.dictionary.take(pa.array(kept)), f=total[kept]))
            out.append(_named([-1], [lang], [int(total.sum()).to_bytes(8, "big")]))
        return pa.concat_tables(out)

    return run


def _replies(ids: np.ndarray, parts: list[list[np.ndarray]], own: int) -> list[tuple[int, bytes]]:
    """For each part that has frequent entries: the block's own numbers of these and their names."""
    out, at = [], 0
    for k, p in enumerate(parts):
        name = ids[at : at + len(p[own])]
        at += len(p[own])
        have = name >= 0
        if have.any():
            out.append((k, pack([p[own][have], name[have]])))
    return out


def _name_pairs(least: int):
    """One bucket: pairs with `least` occurrences or more get a name."""

    def run(dealt: pa.Table) -> pa.Table:
        parts = [unpack(b.as_py()) for b in dealt.column("body")]
        left, right = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        order = np.lexsort((right, left))
        a, b = left[order], right[order]
        head = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        total = np.add.reduceat(np.concatenate([p[2] for p in parts]).astype(np.int64)[order], head)
        kept = total >= least
        ids = np.where(kept, (np.int64(dealt.column("bucket")[0].as_py()) << 40) + np.cumsum(kept) - 1, -1)
        of = np.empty(len(order), np.int64)
        of[order] = np.repeat(ids, np.diff(np.append(head, len(order))))
        replies, blocks = _replies(of, parts, 3), dealt.column("block").to_numpy()
        return _named([blocks[k] for k, _ in replies], [None] * (len(replies) + int(kept.sum())), [body for _, body in replies], ids=ids[kept], left=a[head][kept], right=b[head][kept], f=total[kept])

    return run


def _pairs(buckets: int, level: int):
    """Of each block: its distinct pairs of adjacent frequent (level-1)-grams, as global names with counts, by bucket. names1, names2, ... hold the replies of each level before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                sequence, size = unpack(batch.column("body")[row].as_py())
                now, count = sequence.view(np.int32).astype(np.int64), int(size[0])
                for k in range(1, level):
                    name = np.full(count, -1, np.int64)
                    for blob in batch.column(f"names{k}")[row].as_py() or []:
                        own, ids = unpack(blob)
                        name[own] = ids
                    now[now >= 0] = np.where(name[now[now >= 0]] >= 0, now[now >= 0], -1)
                    here = np.flatnonzero((now[:-1] >= 0) & (now[1:] >= 0))
                    pairs, of, n = np.unique(now[here] * count + now[here + 1], return_inverse=True, return_counts=True)
                    left, right = name[pairs // max(count, 1)], name[pairs % max(count, 1)]
                    now = np.full(len(now), -1, np.int64)
                    now[here] = of
                    count = len(pairs)
                with np.errstate(over="ignore"):
                    bucket = (mix64(left.view(np.uint64) ^ mix64(right.view(np.uint64))) % np.uint64(buckets)).astype(np.int64)
                block, lang = batch.column("block")[row].as_py(), batch.column("lang")[row].as_py()
                rows = []
                for name_of, mine in _by_bucket(bucket):
                    rows.append((block, lang, name_of, pack([left[mine], right[mine], n[mine].astype(np.uint32), mine.astype(np.uint32)])))
                    if len(rows) == 64:
                        yield _dealt(rows)
                        rows = []
                yield _dealt(rows)

    return run


def phrase_names(docs: DataFrame, *, text: str = "text", lang: str = "lang", words: int = WORDS, least: int = LEAST, bucket_bytes: int = BUCKET_BYTES) -> tuple[list[DataFrame], DataFrame]:
    """The names of each level (id, left, right, f; lang and word at level 1), and lang with n, its word occurrences."""
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))
    buckets = number_of_buckets(rows, "body", bucket_bytes)
    dealt = stored(rows.mapInArrow(_blocks(buckets), _DEALT), "blocks")
    state = dealt.where("bucket IS NULL").drop("bucket")
    found = stored(dealt.where("bucket IS NOT NULL").groupBy("bucket").applyInArrow(_name_words(least), _NAMED), "names")
    totals = found.where("block = -1").select("lang", F.conv(F.hex("body"), 16, 10).cast("long").alias("n")).groupBy("lang").agg(F.sum("n").alias("n"))
    levels = [found.where("block IS NULL").select("id", "lang", "word", "f")]
    for level in range(2, words + 1):
        # A block has one reply of each bucket at most, together no larger than the block.
        replies = found.where("block >= 0").groupBy("block").agg(F.collect_list("body").alias(f"names{level - 1}"))
        state = state.join(replies, "block", "left" if level > 2 else "inner")
        found = stored(state.mapInArrow(_pairs(buckets, level), _DEALT).groupBy("bucket").applyInArrow(_name_pairs(least), _NAMED), "names")
        levels.append(found.where("block IS NULL").select("id", "left", "right", "f"))
    return levels, totals


def collocations(docs: DataFrame, *, text: str = "text", lang: str = "lang", words: int = WORDS, least: int = LEAST, top: int = TOP, subsumed: int = SUBSUMED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's best phrases of 2 to `words` words."""
    levels, totals = phrase_names(docs, text=text, lang=lang, words=words, least=least, bucket_bytes=bucket_bytes)
    # firsts and lasts: the counts of a phrase's first 1, 2, ... and last 1, 2, ... words.
    below = levels[0].select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", F.array().cast("array<long>").alias("firsts"), F.array().cast("array<long>").alias("lasts"))
    candidates = []
    for k, level in enumerate(levels[1:], 2):
        a = below.select(F.col("id").alias("left"), "lang", "phrase", F.concat("firsts", F.array("f")).alias("firsts"))
        b = below.select(F.col("id").alias("right"), "last", F.concat("lasts", F.array("f")).alias("lasts"))
        named = level.join(a, "left").join(b, "right").select("id", "left", "right", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "f", "firsts", "lasts")
        below = stored(named, f"phrases{k}")
        candidates.append(below)
    kept = None
    for k, phrases in enumerate(candidates):
        if k + 1 < len(candidates):
            longer = candidates[k + 1].select(F.explode(F.array("left", "right")).alias("id"), F.col("f").alias("most")).groupBy("id").agg(F.max("most").alias("most"))
            phrases = phrases.join(longer, "id", "left").where(f"most IS NULL OR CAST(100 AS DECIMAL(20,0)) * most < CAST({subsumed} AS DECIMAL(20,0)) * f")
        phrases = phrases.select("lang", "phrase", F.col("f").alias("a"), "firsts", "lasts")
        kept = phrases if kept is None else kept.union(phrases)
    wide = "decimal(20,0)"
    cut = F.expr(
        f"array_min(transform(sequence(1, size(firsts)), k -> struct((CAST(a AS {wide}) * CAST(a AS {wide}) * 1000000BD) div (CAST(firsts[k - 1] AS {wide}) * CAST(lasts[size(firsts) - k] AS {wide})) AS score,"
        " k, firsts[k - 1] AS l, lasts[size(firsts) - k] AS r)))"
    )
    scored = kept.select("lang", "phrase", "a", cut.alias("cut")).select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    best = (F.desc("score"), F.desc("a"), "phrase")
    part = scored.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    first = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*best))).where(F.col("rank") <= top).drop("_part", "rank")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


QUERIES = {"op11_collocations": op11_collocations}
SQL = {
    "op11_collocations": r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3)) t(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM g GROUP BY ALL HAVING count(*) >= 10),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS p, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
parts AS (SELECT *, array_to_string(p[1 : cut], ' ') AS first, array_to_string(p[cut + 1 : k], ' ') AS rest FROM c),
s AS (SELECT c.lang, c.k, c.phrase, c.a, c.cut, x.f AS l, y.f AS r, (1000000::HUGEINT * c.a * c.a) // (x.f * y.f) AS score FROM parts c
  JOIN f x ON x.lang = c.lang AND x.phrase = c.first AND x.k = c.cut JOIN f y ON y.lang = c.lang AND y.phrase = c.rest AND y.k = c.k - c.cut),
lowest AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
longer AS (SELECT lang, unnest([array_to_string(p[1:2], ' '), array_to_string(p[2:3], ' ')]) AS phrase, a FROM c WHERE k = 3),
most AS (SELECT lang, phrase, max(a) AS most FROM longer GROUP BY ALL),
kept AS (SELECT x.* FROM lowest x LEFT JOIN most m ON x.k = 2 AND m.lang = x.lang AND m.phrase = x.phrase WHERE m.most IS NULL OR 100 * m.most < 50 * x.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000"""
}
