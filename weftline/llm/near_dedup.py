"""MinHash near-duplicates: DartMinHash signatures, banded joins, exact check, connected components.

Each shingle throws darts into the plane of weight and rank: a Poisson process of intensity 1, in unit cells whose darts depend on the
shingle's hash alone. A document of total weight L looks at darts below its weights and below rank t / L, about t = k ln k + 2k of
them however long it is; each dart has one of k coordinates, and a coordinate keeps its dart of the lowest rank. Two documents
agree in a coordinate with the probability of their weighted Jaccard similarity; a shingle weighs as often as it occurs. A document with an empty coordinate doubles its rank
limit, which changes no coordinate already found.

Documents with equal shingles are one from the start, whatever their number. In every band's bucket the smallest identifier is
the centre and all others are compared with it. While a bucket's members are in several components and the pairs across these are many,
a further centre is compared with the members of other components: the member with most links so far, which is the base of a family
of edits. At last all pairs of a bucket that are in two components are compared, each pair once, whatever the buckets it shares, unless
its signatures agree in under 0.65 of their coordinates, which at similarity 0.8 has a probability of under 0.0001. Members of a large bucket
are compared inside tasks, two blocks of them at a time, which send on only the links that join components. So
groups of copies of any size give as many pairs as members, and no pair that shares a bucket stays apart untested. Similarity is checked exactly, on
the sets of occurrences of shingles. With BANDS of ROWS a pair of similarity 0.8 shares a bucket with a probability of 0.9999.

Defined results: words are runs outside `[\\x20\\x09-\\x0D]` of the lower-case text; a text of 1 to 4 words is one shingle; a null text or
one without words is a class of its own. A class is a component of links of similarity THRESHOLD or more; class_id is its smallest
doc_id, and that document is the one kept. A null doc_id comes last; a class of such rows only has a null class_id. Rows that repeat a doc_id
are told apart by their texts; of those that are in one class one is kept. A text of any length is read whole; its shingles are one
row when it is compared. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Appended, mix64, slices, span_hashes, stored, table, text_bytes, to_unit, token_spans
from .components import components

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 5
#: Four standard deviations of the share of equal coordinates at similarity 0.8.
AGREEMENT_MARGIN = 0.15
#: Blocks a member of the open buckets, on average, up to which they are compared without looking for further centres.
FEW_PAIRS = 4
#: Members of a bucket up to which its pairs are rows, and members of a block of a larger one.
SMALL = 32
BLOCK = 256
#: Cumulative probabilities of a Poisson variable of mean 1.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(20)])


def shingles(body: np.ndarray, at: np.ndarray, words: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and count of the distinct word shingles of each text, ordered by row and hash."""
    start, end, row = token_spans(body, at)
    word = span_hashes(body, start, end)
    factor = mix64(np.arange(1, words + 1)) | np.uint64(1)
    rows, found = [], []
    with np.errstate(over="ignore"):
        have = len(word) - words + 1
        if have > 0:
            whole = sum((word[j : j + have] * factor[j] for j in range(words)), np.zeros(have, np.uint64))
            inside = row[:have] == row[words - 1 :]
            rows.append(row[:have][inside])
            found.append(mix64(whole[inside]))
        count = np.bincount(row, minlength=len(at) - 1)
        short = np.flatnonzero((count > 0) & (count < words))
        if len(short):
            first = np.searchsorted(row, short)
            rows.append(short)
            found.append(mix64(np.array([np.sum(word[f : f + c] * factor[:c]) + np.uint64(c) for f, c in zip(first, count[short], strict=True)], np.uint64)))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    r, h = np.concatenate(rows), np.concatenate(found)
    order = np.lexsort((h, r))
    r, h = r[order], h[order]
    head = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (h[1:] != h[:-1])])) if len(r) else np.zeros(0, np.int64)
    return r[head], h[head], np.diff(np.append(head, len(r)))


def dart_minhash(row: np.ndarray, element: np.ndarray, weight: np.ndarray, rows: int, k: int) -> np.ndarray:
    """DartMinHash signatures (rows by k) of weighted sets given as sorted (row, element, weight); rows without elements get 0."""
    signature = np.zeros((rows, k), np.uint64)
    total = np.bincount(row, weights=weight, minlength=rows)
    todo = np.flatnonzero(total > 0)
    limit = np.zeros(rows)
    limit[todo] = (k * math.log(k) + 2 * k) / total[todo]
    while len(todo):
        chosen = np.isin(row, todo) if len(todo) < rows else np.ones(len(row), bool)
        r, x, w = row[chosen], element[chosen], weight[chosen].astype(np.float64)
        rank = np.full(rows * k, np.inf)
        thrown = []
        low, width, level = 0.0, 1.0, 0
        while len(r):
            # One stripe of the weight axis, [low, low + width), cut along the rank axis into cells of area 1.
            cells = np.ceil(limit[r] * width).astype(np.int64)
            cell_of = np.repeat(np.arange(len(r)), cells)
            step = np.arange(len(cell_of)) - np.repeat(np.cumsum(cells) - cells, cells)
            with np.errstate(over="ignore"):
                seed = mix64(x[cell_of] + np.uint64(level) * np.uint64(0xA24BAED4963EE407) + step.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
            darts = np.searchsorted(_POISSON, to_unit(seed))
            of = np.repeat(np.arange(len(cell_of)), darts)
            nth = np.arange(len(of)) - np.repeat(np.cumsum(darts) - darts, darts)
            with np.errstate(over="ignore"):
                name = mix64(seed[of] + (nth + 1).astype(np.uint64))
            item = cell_of[of]
            height = (step[of] + to_unit(name)) / width
            across = low + to_unit(mix64(name ^ np.uint64(0x5851F42D4C957F2D))) * width
            hit = (across < w[item]) & (height < limit[r[item]])
            name, height, item = name[hit], height[hit], item[hit]
            place = r[item] * k + (mix64(name ^ np.uint64(0x14057B7EF767814F)) % np.uint64(k)).astype(np.int64)
            np.minimum.at(rank, place, height)
            thrown.append((place, height, name))
            low, width, level = low + width, low + width, level + 1
            more = w > low
            r, x, w = r[more], x[more], w[more]
        flat = signature.reshape(-1)
        for place, height, name in thrown:
            best = height == rank[place]
            flat[place[best]] = name[best]
        empty = np.isinf(rank.reshape(rows, k)[todo]).any(1)
        todo = todo[empty]
        limit[todo] *= 2
    return signature


def _signer(bands: int, depth: int, weighted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "body", 2 << 20):
            n = batch.num_rows
            row, element, count = shingles(*text_bytes(batch.column("body")))
            signature = dart_minhash(row, element, count if weighted else np.ones(len(row)), n, bands * depth)
            with np.errstate(over="ignore"):
                value = np.zeros((n, bands), np.uint64) + mix64(np.arange(bands))
                for j in range(depth):
                    value = mix64(value ^ signature.reshape(n, bands, depth)[:, :, j])
                sums, again = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                every = _occurrences(element, count) if weighted else element
                of = np.repeat(row, count) if weighted else row
                np.add.at(sums, of, mix64(every ^ np.uint64(1)))
                np.add.at(again, of, mix64(every ^ np.uint64(2)))
            size = np.bincount(row, minlength=n)
            none = pa.array(size == 0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * bands, pa.int32()), pa.array(value.reshape(-1).view(np.int64)), mask=none)
            marks = (signature & np.uint64(0xFF)).astype(np.uint8).view(np.int8).reshape(-1)
            short = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * bands * depth, pa.int32()), pa.array(marks), mask=none)
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("hash"), pa.array(sums.view(np.int64), mask=size == 0), pa.array(again.view(np.int64), mask=size == 0), lists, short],
                names=["doc_id", "hash", "set_a", "set_b", "bands", "marks"],
            )

    return run


def _occurrences(element: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A name for each occurrence: the first, second, ... of an element. The sets of these names have the weighted similarity of the elements."""
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    with np.errstate(over="ignore"):
        return mix64(np.repeat(element, count) + nth.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))


def _shingle_sets(weighted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "body", 2 << 20):
            row, element, count = shingles(*text_bytes(batch.column("body")))
            if weighted:
                row, element = np.repeat(row, count), _occurrences(element, count)
            at = np.searchsorted(row, np.arange(batch.num_rows + 1))
            yield pa.record_batch([batch.column("rep"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(element.view(np.int64)))], names=["rep", "shingles"])

    return run


def near_duplicates(docs: DataFrame, *, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, weighted: bool = True, margin: float | None = AGREEMENT_MARGIN) -> DataFrame:
    """doc_id, class_id, class_size and kept of each row of docs.

    weighted: a shingle weighs its number of occurrences, in signatures and in the check; else it weighs 1. margin: pairs of two components
    that share a bucket are compared if their signatures agree in threshold - margin of the coordinates; None compares all of them.
    """
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("body")).withColumn("hash", F.xxhash64("body"))
    signatures = texts.mapInArrow(_signer(bands, rows, weighted), "doc_id long, hash long, set_a long, set_b long, bands array<long>, marks array<tinyint>")
    # Rows and sets get numbers, which hold because they are stored; doc_id may be null or repeat.
    signed = stored(signatures.withColumn("row", F.monotonically_increasing_id()), "signatures")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    sets = stored(
        signed.where("set_a IS NOT NULL").groupBy("set_a", "set_b").agg(F.min(F.struct(order.alias("order"), "hash", "bands", "marks")).alias("least"), F.count("*").alias("n"))
        .select("set_a", "set_b", F.monotonically_increasing_id().alias("rep"), "n", F.col("least.order").alias("order"), F.col("least.hash").alias("hash"), "least.bands", "least.marks"),
        "sets",
    )
    named_texts = sets.select("rep", F.col("order.doc_id").alias("of"), F.col("hash").alias("of_hash"))
    roots = _links(texts, named_texts, sets.select("rep", F.explode("bands").alias("bucket")), sets.select("rep", "marks", "bands"), threshold, weighted, margin, bands * rows)
    classed = sets.select("set_a", "set_b", "rep", "n", "order").join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("class", F.coalesce("root", "rep"))
    classes = classed.groupBy("class").agg(F.sum("n").alias("class_size"), F.min("order").alias("first"))
    named = classed.select("set_a", "set_b", "class").join(classes, "class")
    found = signed.select("doc_id", "row", "set_a", "set_b").join(named, ["set_a", "set_b"], "left")
    alone = F.col("first").isNull()
    return found.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        (alone | (F.col("row") == F.col("first.row"))).alias("kept"),
    )


def _links(texts: DataFrame, named: DataFrame, buckets: DataFrame, marks: DataFrame, threshold: float, weighted: bool, margin: float | None, bands: int) -> DataFrame:
    """node, root of the components of links of similarity threshold or more between representatives that share a bucket."""
    many = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    now = stored(buckets.select("bucket", "rep").join(many, "bucket", "left_semi"), "members")
    wanted = named.join(now.select("rep").distinct(), "rep", "left_semi")
    # Representatives are documents, known by doc_id and text; the texts meet them once, for all rounds.
    same = texts["doc_id"].eqNullSafe(wanted["of"]) & (texts["hash"] == wanted["of_hash"])
    sets = stored(texts.join(wanted.hint("shuffle_hash"), same).select("rep", "body").mapInArrow(_shingle_sets(weighted), "rep long, shingles array<long>").dropDuplicates(["rep"]), "shingles")
    a, b = sets.select(F.col("rep").alias("u"), F.col("shingles").alias("a")), sets.select(F.col("rep").alias("v"), F.col("shingles").alias("b"))
    common = F.size(F.array_intersect("a", "b"))
    tested = Appended(texts.sparkSession, "tested", "u long, v long, ok boolean")

    def check(pairs: DataFrame, roots: DataFrame | None = None) -> DataFrame:
        """Test pairs(u, v) that were not tested yet; the components of all links so far, of which `roots` has those found before."""
        new = pairs.distinct().join(tested.read(), ["u", "v"], "left_anti")
        tested.add(new.join(a, "u").join(b, "v").select("u", "v", (common / (F.size("a") + F.size("b") - common) >= threshold).alias("ok")))
        links = tested.read().where("ok").select("u", "v")
        if roots is None:
            return components(links)
        # Links within a component are left out, the others become links of roots: a small graph.
        start = [roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in ("u", "v")]
        across = links.join(start[0], "u", "left").join(start[1], "v", "left").select(F.coalesce("root_u", "u").alias("u"), F.coalesce("root_v", "v").alias("v")).where("u <> v")
        joined = stored(components(across), "joined")
        moved = roots.join(joined.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        return stored(moved.union(joined.join(roots.select("node"), "node", "left_anti").select("node", "root")), "roots")

    used = now.groupBy("bucket").agg(F.min("rep").alias("centre"))
    roots = check(_spokes(now, used))
    last = math.inf
    while True:
        # A bucket whose members are of one component is done; of any other all members stay, those that joined the centre too.
        label = now.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "rep", F.coalesce("root", "rep").alias("label"))
        open_buckets = label.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("bucket")
        rest = stored(label.join(open_buckets, "bucket", "left_semi"), "members")
        parts = rest.groupBy("bucket", "label").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same"))
        size = parts.agg(F.sum("n"), F.sum((F.col("n") * F.col("n") - F.col("same")) / 2)).first()
        if not size[0]:
            return roots
        if size[1] <= FEW_PAIRS * BLOCK * size[0] or 2 * size[1] > last:
            break
        last = size[1]
        # Many pairs: first compare with one more centre a bucket, the member with most links so far, as long as that halves them.
        links = tested.read().where("ok").select(F.explode(F.array("u", "v")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
        fresh = rest.join(used.withColumnRenamed("centre", "rep"), ["bucket", "rep"], "left_anti").join(links, "rep", "left")
        hubs = stored(fresh.groupBy("bucket").agg(F.max_by("rep", F.struct(F.coalesce("links", F.lit(0)), F.xxhash64("rep", "bucket"), "rep")).alias("centre")), "centres")
        used = used.union(hubs)
        roots = check(_spokes(rest, hubs), roots)
    # Every pair of a bucket that is in two components, each pair once: in the least of the buckets it shares.
    agree = (threshold - (1.0 if margin is None else margin)) * bands  # of all coordinates
    sized = rest.join(rest.groupBy("bucket").agg(F.count("*").alias("n")), "bucket")
    small, large = sized.where(F.col("n") <= SMALL).drop("n"), sized.where(F.col("n") > SMALL)
    kept = small.join(marks, "rep")
    x, y = kept.alias("x"), kept.alias("y")
    both = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.rep") > F.col("y.rep")) & (F.col("x.label") != F.col("y.label"))
    once = F.array_min(F.array_intersect("x.bands", "y.bands")) == F.col("x.bucket")
    # Signatures that agree this little are of sets of similarity `threshold` with a probability of under 0.0001.
    alike = F.size(F.filter(F.zip_with("x.marks", "y.marks", lambda m, n: m == n), lambda same: same)) >= agree
    tested.add(_block_links(large, marks.join(sets, "rep"), threshold, agree))
    return check(x.join(y, both & once & alike).select(F.col("x.rep").alias("u"), F.col("y.rep").alias("v")), roots)


def _block_links(members: DataFrame, texts: DataFrame, threshold: float, agree: float) -> DataFrame:
    """u, v, ok: enough links to join what is similar among the members(bucket, rep, label, n) of large buckets.

    A bucket is cut into blocks, and each two blocks meet in one task, which compares their members there: so a member becomes a row for each
    block of its bucket, not for each other member, and only links are sent on.
    """
    blocks = F.ceil(F.col("n") / BLOCK)
    own = F.pmod(F.xxhash64("rep", F.lit(1)), blocks).cast("int")
    dealt = members.select("bucket", "rep", "label", own.alias("own"), F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))).alias("other"))
    keyed = dealt.select("bucket", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "rep", "label", "own")
    return keyed.join(texts, "rep").groupBy("bucket", "low", "high").applyInArrow(_compare_blocks(threshold, agree), "u long, v long, ok boolean")


def _compare_blocks(threshold: float, agree: float):
    def run(members: pa.Table) -> pa.Table:
        members = members.combine_chunks()
        bucket, one = members.column("bucket")[0].as_py(), members.column("low")[0].as_py() == members.column("high")[0].as_py()
        rep, label, own = (members.column(c).to_numpy() for c in ("rep", "label", "own"))
        marks = np.array(members.column("marks").to_pylist(), np.int8)
        bands = np.array(members.column("bands").to_pylist(), np.int64)
        shingles = [np.asarray(s.values) for s in members.column("shingles")]
        # Each set as the bits of one integer, a bit for each shingle of these members.
        names = np.unique(np.concatenate(shingles))
        bits, size = [], np.array([len(s) for s in shingles])
        for s in shingles:
            flags = np.zeros(len(names), np.uint8)
            flags[np.searchsorted(names, s)] = 1
            bits.append(int.from_bytes(np.packbits(flags).tobytes(), "big"))
        group = {k: k for k in label.tolist()}

        def root(k: int) -> int:
            while group[k] != k:
                group[k] = k = group[group[k]]
            return k

        first = np.flatnonzero(own == members.column("low")[0].as_py())
        second = first if one else np.flatnonzero(own == members.column("high")[0].as_py())
        found = []
        for i in first.tolist():
            j = second[(label[second] != label[i]) & ((rep[second] < rep[i]) if one else True)]
            j = j[(np.minimum(size[j], size[i]) >= threshold * np.maximum(size[j], size[i])) & ((marks[j] == marks[i]).sum(axis=1) >= agree)]
            j = j[~((bands[j] == bands[i]) & (bands[j] < bucket)).any(axis=1)]
            for k in j.tolist():
                x, y = root(int(label[i])), root(int(label[k]))
                if x != y:
                    common = (bits[i] & bits[k]).bit_count()
                    if common / (int(size[i]) + int(size[k]) - common) >= threshold:
                        group[x] = y
                        found.append((max(int(rep[i]), int(rep[k])), min(int(rep[i]), int(rep[k]))))
        u, v = zip(*found, strict=True) if found else ((), ())
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "ok": pa.array([True] * len(found), pa.bool_())})

    return run


def _spokes(members: DataFrame, centres: DataFrame) -> DataFrame:
    """u > v: each bucket's centre with the bucket's other members, but those whose label is the centre's."""
    pairs = members.join(centres, "bucket").where("rep <> centre")
    if "label" in members.columns:
        own = members.select("bucket", F.col("rep").alias("centre"), F.col("label").alias("held"))
        pairs = pairs.join(own, ["bucket", "centre"]).where("label <> held")
    return pairs.select(F.greatest("rep", "centre").alias("u"), F.least("rep", "centre").alias("v"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op8_near_dedup": op8_near_dedup}
SQL = {
    "op8_near_dedup": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, unnest(CASE WHEN len(w) BETWEEN 1 AND 4 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS g FROM w),
s AS (SELECT doc_id, g, count(*) AS times FROM g GROUP BY ALL),
n AS (SELECT doc_id, sum(times) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, sum(least(a.times, b.times)) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE c::DOUBLE / (x.n + y.n - c) >= 0.8),
both_ways AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, b.v FROM reach r JOIN both_ways b ON r.other = b.u),
classes AS (SELECT doc_id, min(other) AS class_id FROM reach GROUP BY doc_id)
SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size, doc_id = class_id AS kept FROM classes"""
}
