"""Source divergence audit: how far the terms of each source of a language stand from those of the language and of its other sources.

Counting: tasks count the terms of slices of documents and deal the counts to buckets by a hash of the term. A bucket holds all counts
of its terms, so it finds the kept ones and writes one posting list (source, count) a term. Probabilities are integers,
p = 1 + floor(SCALE * (count + 1) / (N + V)), divided as decimals, so counts may pass 64 bits when scaled; f = floor((p - q)^2 / q) fits 64 bits.

Pairs of sources are computed from posting lists: a task walks the pairs within each term's list and adds how far f is from what it would be
if either or both sources lacked the term. The rest depends on one count alone and comes from each group's counts of equal p.
So the work follows the places of the lists, not terms times sources; the result itself has each ordered pair of a language's sources.

Terms are found by upper bounds: a group's terms of like count are a bucket, of which the largest p and the extreme (smallest) q
bound f. Buckets are evaluated best first, until they hold TOP terms; the value of the TOP-th is then a bound from below, and only buckets
whose own bound is not strictly below it are evaluated as well.

Defined results: null text, lang and source are ''. A group without kept terms has count 0 of each; a language without kept terms has pairs of
value 0 and no terms. A source alone in its language has no pair rows. Equal values are ordered by the item's UTF-8 bytes. Rows that repeat a
doc_id are documents of their own; doc_id is not read. A text of any length is counted in one piece. Extra columns are not read. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import distinct_words, number_of_buckets, slices, spans_of, stored, table, text_bytes, word_buckets

SCALE = 1_000_000_000
#: Documents of its language that a term is in at least.
LEAST_DOCS = 3
#: Terms of each group in the result.
TOP = 200
#: Text bytes for each bucket of terms.
BUCKET_BYTES = 8 << 20
SLICE_BYTES = 16 << 20
#: Term buckets of a group have counts within a factor of 2 ** (1 / OCTAVE).
OCTAVE = 8
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Letters A to Z and all bytes of characters from U+0080.
_INSIDE = np.zeros(256, bool)
_INSIDE[65:91] = _INSIDE[97:123] = _INSIDE[128:] = True


def _ipc(columns: dict[str, pa.Array]) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.record_batch(columns)
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _counter(buckets: int):
    """Counts of (term, lang, source) of each slice of documents, and the documents that hold the term, packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices([whole], "body", SLICE_BYTES):
                # Documents of one group stand together, so the counts of a term do too.
                part = pa.table({n: part.column(n) for n in ("lang", "source", "body")}).sort_by([("lang", "ascending"), ("source", "ascending")]).combine_chunks()
                lang, source = (part.column(n).chunk(0).dictionary_encode() for n in ("lang", "source"))
                pair = np.stack([lang.indices.to_numpy(), source.indices.to_numpy()])
                group = np.cumsum(np.concatenate([[0], (pair[:, 1:] != pair[:, :-1]).any(0)]))
                body, at = text_bytes(part.column("body").chunk(0))
                body = _LOWER[body]
                black = _INSIDE[body]
                start, end, row = spans_of(black, at)
                if not len(start):
                    continue
                word, words = distinct_words(body, black, start, end)
                of_doc, n = np.unique(word * len(group) + row, return_counts=True)
                word, row = of_doc // len(group), of_doc % len(group)
                head = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (group[row[1:]] != group[row[:-1]])]))
                n, docs = np.add.reduceat(n, head), np.diff(np.append(head, len(word)))
                word, row = word[head], row[head]
                bucket = word_buckets(words, buckets)[word]
                order = np.argsort(bucket, kind="stable")
                edge = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) > 0]))
                names, blobs = [], []
                for low, high in zip(edge, np.append(edge[1:], len(order)), strict=True):
                    mine = order[low:high]
                    doc = pa.array(row[mine])
                    names.append(int(bucket[mine[0]]))
                    blobs.append(_ipc({"term": words.take(pa.array(word[mine])), "lang": lang.take(doc), "source": source.take(doc), "n": pa.array(n[mine]), "docs": pa.array(docs[mine])}))
                yield pa.record_batch([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "block"])

    return run


_INDEX = "lang string, term string, term_no long, total long, sources array<string>, counts array<long>"


def _lists(least: int):
    """The posting lists of one bucket's terms that at least `least` documents of their language hold."""

    def run(dealt: pa.Table) -> pa.Table:
        parts = []
        for block in dealt.column("block"):
            t = pa.ipc.open_stream(block.as_buffer()).read_all()
            parts.append(pa.table({"lang": t.column("lang").cast(pa.string()), "term": t.column("term"), "source": t.column("source").cast(pa.string()), "n": t.column("n"), "docs": t.column("docs")}))
        by_group = pa.concat_tables(parts).group_by(["lang", "term", "source"]).aggregate([("n", "sum"), ("docs", "sum")])
        # A list function keeps the order of rows only in one thread.
        lists = by_group.group_by(["lang", "term"], use_threads=False).aggregate([("source", "list"), ("n_sum", "list"), ("n_sum", "sum"), ("docs_sum", "sum")])
        lists = lists.filter(pa.compute.greater_equal(lists.column("docs_sum_sum"), least))
        number = np.arange(len(lists)) + (np.int64(dealt.column("bucket")[0].as_py()) << 40)
        columns = [lists.column("lang"), lists.column("term").cast(pa.string()), pa.array(number), lists.column("n_sum_sum"), lists.column("source_list"), lists.column("n_sum_list")]
        return pa.table(columns, names=["lang", "term", "term_no", "total", "sources", "counts"])

    return run


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)); null for a language without terms."""
    wide = "decimal(38,0)"
    return F.call_function("div", (count + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), F.nullif((total + terms).cast(wide), F.lit(0))).cast("long") + 1


def _far(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _pair_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What common terms add to each ordered pair of groups; rows come sorted by term_no, and z is a group's p of count 0."""
    rest = None

    def far(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        d = p - q
        return d * d // q

    def added(t: np.ndarray, g: np.ndarray, p: np.ndarray, z: np.ndarray) -> pa.RecordBatch:
        groups, g = np.unique(g, return_inverse=True)
        head = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.zeros(0, np.int64)
        size = np.diff(np.append(head, len(t)))
        behind = np.repeat(size, size) - 1 - (np.arange(len(t)) - np.repeat(head, size))
        live, step = np.arange(len(t)), 1
        total = np.zeros((0, 2), np.int64)
        while len(live := live[behind[live] >= step]):
            other = live + step
            both = np.concatenate([live * 0 + g[live] * len(groups) + g[other], g[other] * len(groups) + g[live]])
            a, b = np.concatenate([live, other]), np.concatenate([other, live])
            value = far(p[a], p[b]) - far(p[a], z[b]) - far(z[a], p[b]) + far(z[a], z[b])
            order = np.argsort(both, kind="stable")
            both, value = both[order], value[order]
            first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
            total = np.concatenate([total, np.stack([both[first], np.add.reduceat(value, first)], axis=1)])
            step += 1
        pairs, at = np.unique(total[:, 0], return_inverse=True)
        sums = np.zeros(len(pairs), np.int64)
        np.add.at(sums, at, total[:, 1])
        return pa.record_batch([pa.array(groups[pairs // len(groups)] if len(pairs) else pairs), pa.array(groups[pairs % len(groups)] if len(pairs) else pairs), pa.array(sums)], names=["a", "b", "value"])

    for batch in batches:
        now = [batch.column(n).to_numpy() for n in ("term_no", "g", "p", "z")]
        if rest is not None:
            now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
        if not len(now[0]):
            continue
        whole = int(np.searchsorted(now[0], now[0][-1]))  # the last term may go on in the next batch
        yield added(*(x[:whole] for x in now))
        rest = [x[whole:] for x in now]
    if rest is not None:
        yield added(*rest)


def term_lists(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """lang, term, term_no, total and the posting list (sources, counts) of each kept term."""
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))
    buckets = number_of_buckets(rows, "body", bucket_bytes)
    counted = rows.mapInArrow(_counter(buckets), "bucket int, block binary")
    return stored(counted.groupBy("bucket").applyInArrow(_lists(least_docs), _INDEX), "terms")


def _totals(docs: DataFrame, index: DataFrame, lang: str, source: str) -> DataFrame:
    """Each occurring group: lang, source, its number g, N and held terms, the language's V and N, and z, the p of count 0."""
    occurring = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source")).distinct()
    of_group = index.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"), F.count("*").alias("held"))
    of_lang = index.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_n"))
    known = occurring.join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0, ["n", "held", "terms", "lang_n"])
    return stored(known.withColumns({"z": _share(F.lit(0).cast("long"), F.col("n"), F.col("terms")), "g": F.monotonically_increasing_id()}), "groups")


def _pairs(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (each other source of the language) and value."""
    together = postings.select("term_no", "g", "p", "z").repartition("term_no").sortWithinPartitions("term_no").mapInArrow(_pair_terms, "a long, b long, value long")
    z = groups.select("lang", "g", "z")
    other = z.select("lang", F.col("g").alias("og"), F.col("z").alias("oz"))
    # Terms that one group holds, as if the other did not: both as p and as q.
    alone = postings.groupBy("lang", "g", "p").agg(F.count("*").alias("n")).join(other, "lang").where("g <> og")
    both_ways = F.array(
        F.struct(F.col("g").alias("a"), F.col("og").alias("b"), (F.col("n") * _far(F.col("p"), F.col("oz"))).alias("value")),
        F.struct(F.col("og").alias("a"), F.col("g").alias("b"), (F.col("n") * _far(F.col("oz"), F.col("p"))).alias("value")),
    )
    single = alone.select(F.inline(both_ways))
    sums = together.union(single).groupBy("a", "b").agg(F.sum("value").alias("known"))
    x = groups.select("lang", "source", F.col("g").alias("a"), F.col("z").alias("za"), F.col("held").alias("held_a"), "terms")
    y = groups.select("lang", F.col("source").alias("item"), F.col("g").alias("b"), F.col("z").alias("zb"), F.col("held").alias("held_b"))
    rest = F.coalesce((F.col("terms") - F.col("held_a") - F.col("held_b")) * _far(F.col("za"), F.col("zb")), F.lit(0))
    return x.join(y, "lang").where("a <> b").join(sums, ["a", "b"], "left").select("lang", "source", "item", (F.coalesce("known", F.lit(0)) + rest).alias("value"))


def _top_terms(postings: DataFrame, top: int) -> DataFrame:
    """lang, source, item (a term), value and rank of the `top` terms of largest f of each group, with p > q."""
    rows = postings.withColumn("bucket", F.floor(F.log2("n") * OCTAVE))
    # Only terms with p > q count; with the largest p and the smallest q of a bucket, none of its terms has a larger f.
    over = F.col("p") > F.col("q")
    buckets = stored(
        rows.where(over).groupBy("g", "bucket").agg(F.count("*").alias("size"), F.max("p").alias("p"), F.min("q").alias("q")).select("g", "bucket", "size", _far(F.col("p"), F.col("q")).alias("bound")),
        "buckets",
    )
    best_first = Window.partitionBy("g").orderBy(F.desc("bound"), "bucket")
    placed = buckets.withColumn("before", F.sum("size").over(best_first.rowsBetween(Window.unboundedPreceding, -1)))
    first = placed.where(F.coalesce("before", F.lit(0)) < top)

    def evaluated(chosen: DataFrame) -> DataFrame:
        found = rows.where(over).join(chosen.select("g", "bucket"), ["g", "bucket"]).select("g", "term", _far(F.col("p"), F.col("q")).alias("value"))
        return found.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("value"), "term"))).where(F.col("rank") <= top)

    seen = stored(evaluated(first), "seen")
    least = seen.groupBy("g").agg(F.count("*").alias("have"), F.min("value").alias("least"))
    # A bucket is passed over only if its bound is strictly below the value of the top-th term seen.
    more = placed.where(F.coalesce("before", F.lit(0)) >= top).join(least, "g").where((F.col("have") < top) | (F.col("bound") >= F.col("least")))
    both = seen.select("g", "term", "value").union(evaluated(more).select("g", "term", "value"))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("value"), "term"))).where(F.col("rank") <= top)


def divergence(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value and rank."""
    index = term_lists(docs, text=text, lang=lang, source=source, least_docs=least_docs, bucket_bytes=bucket_bytes)
    groups = _totals(docs, index, lang, source)
    flat = index.select("lang", "term", "term_no", "total", F.explode(F.arrays_zip("sources", "counts")).alias("x")).select("lang", "term", "term_no", "total", F.col("x.sources").alias("source"), F.col("x.counts").alias("n"))
    sized = flat.join(groups.select("lang", "source", "g", "z", F.col("n").alias("group_n"), "terms", "lang_n"), ["lang", "source"])
    postings = stored(
        sized.select("lang", "g", "term", "term_no", "n", "z", _share(F.col("n"), F.col("group_n"), F.col("terms")).alias("p"), _share(F.col("total"), F.col("lang_n"), F.col("terms")).alias("q")),
        "postings",
    )
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = _pairs(postings, groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    terms = _top_terms(postings, top).join(groups.select("g", "lang", "source"), "g").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    return pairs.unionByName(terms)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


QUERIES = {"op13_divergence": op13_divergence}
SQL = {
    "op13_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
o AS (SELECT id, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM o GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
c AS (SELECT o.lang, source, o.term, count(*)::HUGEINT AS n FROM o JOIN kept ON o.lang = kept.lang AND o.term = kept.term GROUP BY ALL),
s AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source),
every AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(s.n, 0) + v.v) AS p, 1 + (1000000000::HUGEINT * (k.n + 1)) // (v.n + v.v) AS q
  FROM g JOIN kept k ON g.lang = k.lang JOIN v ON v.lang = g.lang LEFT JOIN s ON s.lang = g.lang AND s.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pair AS (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value FROM every x JOIN every y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
pairs AS (SELECT x.lang, x.source, y.source AS item, coalesce(p.value, 0) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN pair p ON p.lang = x.lang AND p.source = x.source AND p.item = y.source),
term AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // q AS value FROM every WHERE n > 0 AND p > q),
ranked AS (SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pairs
  UNION ALL SELECT lang, source, 'term', item, value::BIGINT, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER FROM term)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200"""
}
