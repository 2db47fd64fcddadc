"""Deduplication, splits and samples. Order comes from hashes of the rows, so results never depend on partitioning."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import row_hash


def keep_first(df: DataFrame, by: list[Column], order: list[Column], *, unless: Column | None = None) -> DataFrame:
    """The first row by `order` of each value of `by`; rows where `unless` holds are all kept and claim no key."""
    if unless is None:
        return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_rank = 1").drop("_rank")
    free = df.where(unless)
    return keep_first(df.where(~unless), by, order).unionByName(free)


def hash_key(*parts: Column, seed: int = 42) -> Column:
    """L4: the order key of a row."""
    return row_hash(F.lit(str(seed)), *(p.cast("string") for p in parts))


def unit_hash(*parts: Column, seed: int = 42) -> Column:
    """A number in [0, 1) from the first 13 hexadecimal digits of the order key."""
    return F.conv(F.substring(hash_key(*parts, seed=seed), 1, 13), 16, 10).cast("double") / float(1 << 52)


def hash_sample(df: DataFrame, key: Column, n: int, seed: int = 42) -> DataFrame:
    """L1, L2, L4: the n rows that come first by hash. A top-n of every task goes to one; no full sort."""
    return df.withColumn("_h", hash_key(key, seed=seed)).orderBy("_h").limit(n).drop("_h")


def hash_split(df: DataFrame, key: Column, share: float, seed: int = 42) -> DataFrame:
    """Column split, 'train' for about `share` of the keys. All rows of one key are on the same side; no shuffle is needed."""
    return df.withColumn("split", F.when(unit_hash(key, seed=seed) < share, "train").otherwise("dev"))


def first_by_hash(keys: DataFrame, key: str, wanted: int | Column, seed: int = 42) -> DataFrame:
    """The `wanted` rows of keys that come first by hash, none sorted as a whole. wanted: a number, or a column over n, the number of keys.

    The border is the wanted-th smallest of all hashes, found as a percentile would be: keys are counted by the first 3 digits of
    their hash, and only the keys of the one prefix in which the border lies are ranked.
    """
    hashed = keys.select(key).withColumn("_h", hash_key(F.col(key), seed=seed)).withColumn("_p", F.substring("_h", 1, 3))
    by_prefix = hashed.groupBy("_p").agg(F.count("*").alias("_n"))
    upto = by_prefix.select("_p", "_n", F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("n"))
    placed = upto.select("_p", F.coalesce("_before", F.lit(0)).alias("_before"), "_n", (wanted if isinstance(wanted, Column) else F.lit(wanted)).alias("_wanted"))
    # 4096 prefixes at most.
    ranked = hashed.join(F.broadcast(placed), "_p")
    border = (F.col("_before") < F.col("_wanted")) & (F.col("_before") + F.col("_n") > F.col("_wanted"))
    inside = ranked.where(border).withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy("_h")) + F.col("_before"))
    return ranked.where(F.col("_before") + F.col("_n") <= F.col("_wanted")).select(key).union(inside.where(F.col("_r") <= F.col("_wanted")).select(key))


def exact_group_split(df: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """L6 with an exact number of groups: the floor(share * groups) keys that come first by hash are 'train'."""
    train = first_by_hash(df.select(key).distinct(), key, F.floor(F.col("n") * share), seed)
    return df.join(train.withColumn("split", F.lit("train")), key, "left").fillna({"split": "dev"})


def stratified_cap(df: DataFrame, band: str, key: Column, factor: int = 2, seed: int = 42) -> DataFrame:
    """At most `factor` times the smallest band's rows of each band, those that come first by hash.

    A band may hold most of all rows, so none is ranked whole: rows are counted by band and the first 3 digits of their hash, and only the
    rows of the prefix in which a band's border lies are ranked. A null band is a band of its own.
    """
    hashed = df.withColumn("_h", hash_key(key, seed=seed)).withColumn("_p", F.substring("_h", 1, 3))
    counts = hashed.groupBy(F.col(band).alias("_b"), "_p").agg(F.count("*").alias("_n"))
    cap = counts.groupBy("_b").agg(F.sum("_n").alias("_all")).agg((F.min("_all") * factor).alias("_cap"))
    along = Window.partitionBy("_b").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(along), F.lit(0))).crossJoin(F.broadcast(cap))  # one row
    # The prefix in which the cap is reached, one row for each band; bands that stay under it have none.
    border = starts.where("_before < _cap AND _before + _n >= _cap").select("_b", F.col("_p").alias("_border"), "_before", "_cap")
    placed = hashed.join(border, F.col(band).eqNullSafe(F.col("_b")), "left")
    ranked = placed.where("_p = _border").withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy("_h")) + F.col("_before")).where("_r <= _cap").drop("_r")
    return placed.where("_border IS NULL OR _p < _border").unionByName(ranked).select(*df.columns)


def shard(df: DataFrame, index: Column, shards: int, which: int) -> DataFrame:
    """Disjoint shards by a row number."""
    return df.where(F.pmod(index, F.lit(shards)) == which)


#: Blocks of keys of an alias table.
BLOCKS = 1024


def alias_table(weights: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Walker's table: cell k gives itself with probability keep[k], else other[k]; each cell is drawn equally often."""
    w = np.asarray(weights, np.float64)
    n = len(w)
    share = w * (n / w.sum())
    keep, other = np.ones(n), np.arange(n)
    low, high = [k for k in range(n) if share[k] < 1], [k for k in range(n) if share[k] >= 1]
    while low and high:
        small, large = low.pop(), high[-1]
        keep[small], other[small] = share[small], large
        share[large] -= 1 - share[small]
        if share[large] < 1:
            low.append(high.pop())
    return keep, other


def weighted_draws(weights: DataFrame, key: str, weight: str, draws: int, seed: int = 42) -> DataFrame:
    """Draw, key - `draws` rows drawn with replacement in proportion to the weights.

    Keys are dealt to BLOCKS blocks by hash. A draw first falls on a block, by an alias table of the blocks' sums (BLOCKS rows at most, on the driver), and
    then on a cell of the block's own alias table, which is a row for each key; so a draw meets one row, however heavy a key is. Null,
    negative and zero weights are not drawn; without others there are no draws.
    """
    kinds = dict(weights.dtypes)
    blocks = weights.where(F.col(weight) > 0).select(F.pmod(F.xxhash64(key), F.lit(BLOCKS)).cast("int").alias("block"), F.col(key), F.col(weight).cast("double").alias("w"))
    sums = blocks.groupBy("block").agg(F.sum("w").alias("w"), F.count("*").alias("n")).orderBy("block").collect()  # BLOCKS rows at most
    if not sums:
        return weights.sparkSession.createDataFrame([], f"draw long, `{key}` {kinds[key]}")

    def cells(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(key)
        keep, other = alias_table(rows.column("w").to_numpy())
        return pa.table({"block": rows.column("block"), "cell": pa.array(np.arange(len(keep))), "keep": pa.array(keep), "own": rows.column(key), "other": rows.column(key).take(pa.array(other))})

    tables = blocks.groupBy("block").applyInArrow(cells, f"block int, cell long, keep double, own {kinds[key]}, other {kinds[key]}")
    keep, other = alias_table([r["w"] for r in sums])
    top = weights.sparkSession.createDataFrame([(k, r["block"], r["n"], float(keep[k]), sums[other[k]]["block"], sums[other[k]]["n"]) for k, r in enumerate(sums)], "at long, b long, bn long, keep_block double, ob long, obn long")
    turn = weights.sparkSession.range(draws).select(F.col("id").alias("draw"), *(unit_hash(F.col("id"), F.lit(k), seed=seed).alias(f"u{k}") for k in range(4)))
    met = turn.withColumn("at", F.floor(F.col("u0") * len(sums))).join(F.broadcast(top), "at")
    own = F.col("u1") < F.col("keep_block")
    placed = met.select("draw", "u3", F.when(own, F.col("b")).otherwise(F.col("ob")).cast("int").alias("block"), F.floor(F.col("u2") * F.when(own, F.col("bn")).otherwise(F.col("obn"))).alias("cell"))
    return placed.join(tables, ["block", "cell"]).select("draw", F.when(F.col("u3") < F.col("keep"), F.col("own")).otherwise(F.col("other")).alias(key))
