"""Approximate nearest neighbours: NN-descent by Spark joins of neighbours of neighbours, greedy graph search for queries.

Equal vectors become one node, which keeps its smallest identifiers, so copies cost nothing and ties between them go the right way. A
first graph links each node with the nearest of its block, for several random orders of the nodes. Then each round joins the
neighbours of every node, forward and backward, with one another: pairs closer than what either already has are links of the next graph.
It ends when few links are new. A query walks the graph greedily: again and again the best nodes of its pool that were not yet opened are
opened, until the pool's best BEAM are all open. Graph and walk compare vectors rounded to one byte for each component, which is all
that their joins move; at the end, scores are computed from the original vectors, in double precision.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, or have a null identifier, take no part, as queries or as candidates. Shorter
vectors count as padded with zeros. Ties go to the smaller identifier. A query with fewer candidates than asked for gets all that
it can reach. Rows that repeat an identifier and a vector count as copies; of an identifier with several vectors each is a candidate, and the one
that has the smallest identifier among its copies is asked, once. A walk goes on until all of its best nodes are open. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import stored, table

#: Links of a node, and the links backward that join in a round.
LINKS = 30
BACK = 30
BLOCK = 128
ORDERS = 6
ROUNDS = 8
#: Of a node's new links each group gives its best so many; what is left out is found again in the next round.
FOUND = 4
#: Rounds end when under this share of all links is new.
SETTLED = 0.01
BEAM = 200
#: Nodes that a query opens in one step.
OPENED = 64
SEED = 42


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array, width: int, dtype=np.float64) -> np.ndarray:
    """A list column as rows of a matrix, short ones padded with zeros."""
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    if (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width), dtype)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows to length 1; the largest component is taken out first, so squares neither vanish nor overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=1e-300)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _code(x: np.ndarray) -> np.ndarray:
    """Vectors to bytes, by component, each scaled by its own largest."""
    return np.rint(x / np.abs(x).max(axis=1, keepdims=True, initial=1e-300) * 127).astype(np.int8)


def _codes(column: pa.Array, width: int) -> np.ndarray:
    """Unit vectors of a column of codes."""
    flat = np.frombuffer(column.buffers()[2], np.int8)[column.offset * width : (column.offset + len(column)) * width] if len(column) else np.zeros(0, np.int8)
    x = flat.reshape(len(column), width).astype(np.float32)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _coder(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = _code(_matrix(batch.column("vector"), width))
            yield pa.record_batch([batch.column("node"), pa.array([c.tobytes() for c in codes], pa.binary())], names=["node", "code"])

    return run


def nodes_of(vectors: DataFrame, id_col: str, vec_col: str, copies: int) -> DataFrame:
    """node, vector, and the `copies` smallest ids with that vector, of each distinct usable vector."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vector")).where(F.col("id").isNotNull() & usable(F.col("vector")))
    # Ranks under a limit are cut in each task first, so a common vector brings few rows.
    same = Window.partitionBy("vector").orderBy("id")
    few = rows.withColumn("place", F.row_number().over(same)).where(F.col("place") <= copies)
    return few.groupBy("vector").agg(F.min("id").alias("node"), F.sort_array(F.collect_list("id")).alias("ids")).select("node", "vector", "ids")


def _orderer(width: int, orders: int, bits: int, seed: int):
    """For each order the node's place: sign bits of random projections, then a projection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.default_rng(seed).standard_normal((width, orders * (bits + 1)))
        for batch in batches:
            x = _codes(batch.column("code"), width)
            side = x.astype(np.float64) @ planes
            side = side.reshape(len(x), orders, bits + 1)
            signs = ((side[:, :, :bits] > 0) << np.arange(bits)).sum(axis=2)
            for k in range(orders):
                yield pa.record_batch([batch.column("node"), batch.column("code"), pa.array(np.full(len(x), k), pa.int32()), pa.array(signs[:, k], pa.int64()), pa.array(side[:, k, bits])], names=["node", "code", "turn", "side", "along"])

    return run


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest of each row, in no order."""
    return np.argpartition(-scores, k - 1, axis=1)[:, :k] if k < scores.shape[1] else np.tile(np.arange(scores.shape[1]), (len(scores), 1))


def _blocks(width: int, links: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("node").to_numpy()
            x = _codes(batch.column("code"), width)
            turn = batch.column("turn").to_numpy()
            # Blocks overlap by half, so nodes at a border meet both sides.
            for k in np.unique(turn):
                mine = np.flatnonzero(turn == k)
                for start in range(0, len(mine), BLOCK // 2):
                    b = mine[start : start + BLOCK]
                    if len(b) < 2 or (start and len(b) <= BLOCK // 2):
                        continue
                    s = x[b] @ x[b].T
                    np.fill_diagonal(s, -2.0)
                    best = _best(s, min(links, len(b) - 1))
                    head = np.repeat(np.arange(len(b)), best.shape[1])
                    tail = best.reshape(-1)
                    yield pa.record_batch([pa.array(ids[b[head]]), pa.array(ids[b[tail]]), pa.array(s[head, tail].astype(np.float64))], names=["node", "link", "score"])

    return run


def _keep(edges: DataFrame, links: int) -> DataFrame:
    """node, links: the best distinct links of each node as an array of (score, link), best first."""
    # A node has a bounded number of rows here: those of its blocks or of a round.
    return edges.groupBy("node").agg(F.slice(F.sort_array(F.collect_set(F.struct("score", "link")), asc=False), 1, links).alias("links"))


def _joiner(width: int, links: int):
    """Pairs of one group (all that link to or from a node), closer than what the pair's first node has: node, link, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            group = np.concatenate([[] if rest is None else rest[0], batch.column("hub").to_numpy()]).astype(np.int64)
            ids = np.concatenate([[] if rest is None else rest[1], batch.column("node").to_numpy()]).astype(np.int64)
            least = np.concatenate([[] if rest is None else rest[2], batch.column("least").to_numpy()])
            x = _codes(batch.column("code"), width)
            x = x if rest is None else np.concatenate([rest[3], x])
            edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            last = edge[-1]
            yield from _pairs(edge, ids, least, x, links)
            rest = group[last:], ids[last:], least[last:], x[last:]
        if rest is not None and len(rest[0]):
            yield from _pairs(np.array([0, len(rest[0])]), *rest[1:], links)

    def _pairs(edge, ids, least, x, most):
        heads, tails, scores = [], [], []
        for low, high in zip(edge[:-1], edge[1:], strict=True):
            if high - low < 2:
                continue
            s = x[low:high] @ x[low:high].T
            np.fill_diagonal(s, -2.0)
            # Of each node its group's best few, so what is given does not depend on how groups lie in batches and tasks.
            few = _best(s, min(most, high - low - 1))
            h = np.repeat(np.arange(high - low), few.shape[1])
            t = few.reshape(-1)
            good = s[h, t] > least[low + h] + 1e-7
            heads.append(ids[low + h[good]])
            tails.append(ids[low + t[good]])
            scores.append(s[h[good], t[good]])
        if heads:
            h, t, s = np.concatenate(heads), np.concatenate(tails), np.concatenate(scores).astype(np.float64)
            order = np.lexsort((t, h))
            h, t, s = h[order], t[order], s[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (t[1:] != t[:-1])]) if len(h) else np.zeros(0, bool)
            yield pa.record_batch([pa.array(h[new]), pa.array(t[new]), pa.array(s[new])], names=["node", "link", "score"])

    return run


_EDGE = "node long, link long, score double"


def build_graph(nodes: DataFrame, *, width: int, count: int, links: int = LINKS, orders: int = ORDERS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """NN-descent: node, links (array of score and link, best first) over nodes(node, code)."""
    bits = max(0, int(np.ceil(np.log2(max(count, 1) / BLOCK))))
    placed = nodes.select("node", "code").mapInArrow(_orderer(width, orders, bits, seed), "node long, code binary, turn int, side long, along double")
    ranged = placed.repartitionByRange("turn", "side", "along", "node").sortWithinPartitions("turn", "side", "along", "node")
    graph = stored(_keep(ranged.mapInArrow(_blocks(width, links), _EDGE), links), "graph")
    for _ in range(rounds):
        edges = graph.select("node", F.explode("links").alias("e")).select("node", F.col("e.link").alias("link"), F.col("e.score").alias("score"))
        back = edges.withColumn("place", F.row_number().over(Window.partitionBy("link").orderBy(F.desc("score"), "node"))).where(F.col("place") <= BACK)
        group = edges.select(F.col("node").alias("hub"), F.col("link").alias("node")).union(back.select(F.col("link").alias("hub"), "node")).distinct()
        least = graph.select("node", F.when(F.size("links") >= links, F.element_at("links", -1)["score"]).otherwise(F.lit(-2.0)).alias("least"))
        known = nodes.select("node", "code").join(least, "node", "left").fillna({"least": -2.0})
        brought = group.join(known, "node").repartition("hub").sortWithinPartitions("hub").select("hub", "node", "least", "code")
        found = brought.mapInArrow(_joiner(width, FOUND), _EDGE).join(edges.select("node", "link"), ["node", "link"], "left_anti").withColumn("new", F.lit(True))
        # Pairs are found anew at different hubs with the same score, so the set drops repeats.
        scored = edges.withColumn("new", F.lit(False)).union(found)
        best = F.slice(F.sort_array(F.collect_set(F.struct("score", "link", "new")), asc=False), 1, links)
        merged = stored(scored.groupBy("node").agg(best.alias("links")), "graph")
        changed = merged.select(F.sum(F.size(F.filter("links", lambda e: e["new"]))), F.sum(F.size("links"))).first()
        graph = merged.select("node", F.transform("links", lambda e: F.struct(e["score"], e["link"])).alias("links"))
        if not changed[1] or changed[0] < SETTLED * changed[1]:
            break
    return graph


def _scorer(width: int, carry: list[str], a: str, b: str, coded: bool):
    """Cosines of two columns, row by row: of codes in single precision, of vectors in double."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = ((_codes(batch.column(c), width) if coded else _unit(_matrix(batch.column(c), width))) for c in (a, b))
            yield pa.record_batch([*(batch.column(c) for c in carry), pa.array((x * y).sum(axis=1).astype(np.float64))], names=[*carry, "score"])

    return run


def search(nodes: DataFrame, graph: DataFrame, queries: DataFrame, *, width: int, beam: int = BEAM, opened: int = OPENED) -> DataFrame:
    """Greedy graph search: query, node, score of the best `beam` nodes of each row of queries(query, code, entry)."""
    out = graph.select("node", F.explode("links.link").alias("to"))
    back = graph.select(F.explode("links").alias("e"), F.col("node").alias("to")).select(F.col("e.link").alias("node"), "to", F.col("e.score").alias("score"))
    back = back.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("score"), "to"))).where(F.col("place") <= BACK).select("node", "to")
    ways = stored(out.union(back).distinct().groupBy("node").agg(F.collect_list("to").alias("ways")), "ways")
    codes, asked = nodes.select("node", "code"), queries.select("query", F.col("code").alias("q"))

    def scored(pairs: DataFrame) -> DataFrame:
        return pairs.join(codes, "node").join(asked, "query").select("query", "node", "code", "q").mapInArrow(_scorer(width, ["query", "node"], "code", "q", True), "query long, node long, score double")

    pool = stored(scored(queries.select("query", F.col("entry").alias("node"))).withColumn("open", F.lit(False)), "pool")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    while True:  # every step opens nodes that stay open, so it ends
        # Nodes to open: the best of the pool that are still closed.
        closed = pool.where("NOT open").withColumn("place", F.row_number().over(best)).where(F.col("place") <= opened)
        fresh = closed.join(ways, "node").select("query", F.explode("ways").alias("node")).distinct().join(pool, ["query", "node"], "left_anti")
        marks = closed.select("query", "node", F.lit(True).alias("now"))
        was = pool.join(marks, ["query", "node"], "left").select("query", "node", "score", (F.col("open") | F.coalesce("now", F.lit(False))).alias("open"))
        everything = was.union(scored(fresh).withColumn("open", F.lit(False)))
        # Nodes beyond the beam stay out for good: the beam's worst score only rises.
        pool = stored(everything.withColumn("place", F.row_number().over(best)).where(F.col("place") <= beam).drop("place"), "pool")
        if pool.where("NOT open").isEmpty():
            break
    return pool.select("query", "node", "score")


def nearest(vectors: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest rows of vectors, other than its own, of each row of queries.

    queries are rows of vectors; each enters the graph at its own node.
    """
    nodes = stored(nodes_of(vectors, id_col, vec_col, k + 1), "nodes")
    count, width = nodes.agg(F.count("*"), F.max(F.size("vector"))).first()
    width = width or 1
    coded = stored(nodes.select("node", "vector").mapInArrow(_coder(width), "node long, code binary"), "codes")
    graph = build_graph(coded, width=width, count=count)
    asked = queries.select(F.col(id_col).cast("long").alias("query"), F.col(vec_col).alias("q")).where(F.col("query").isNotNull() & usable(F.col("q")))
    entered = asked.join(nodes.select(F.col("vector").alias("q"), F.col("node").alias("entry")), "q")
    # Of an identifier's several vectors the one with the smallest node is asked.
    entered = entered.groupBy("query").agg(F.min_by(F.struct("q", "entry"), "entry").alias("asked")).select("query", "asked.*")
    entered = stored(entered.join(coded.withColumnRenamed("node", "entry"), "entry").select("query", "q", "entry", "code"), "queries")
    found = search(coded, graph, entered, width=width)
    pairs = found.select("query", "node").join(nodes, "node").join(entered.select("query", "q"), "query")
    exact = pairs.select("query", "ids", "q", "vector").mapInArrow(_scorer(width, ["query", "ids"], "q", "vector", False), "query long, ids array<long>, score double")
    candidates = exact.select("query", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query")
    rank = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return candidates.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select(F.col("query").alias("query_id"), "rank", "vec_id", "score")


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0))


QUERIES = {"op1_neighbours": op1_neighbours}
SQL: dict[str, str] = {}
