"""Mixing sources to target weights: Efraimidis-Spirakis sampling on Spark SQL functions alone.

Each source's target is split into complete epochs, which take every document whole times, and a rest. The rest goes to the documents
with the smallest exponential keys -ln(u) / w, where u is a hash of the document's identifier and w its quality: sizes are
prefix-summed along the keys up to the rest, and the document across the border is taken if that brings the source nearer its target.

A source may hold any share of all rows, so no window runs over a source: the keys are cut into bins by a monotone function, bins
are summed and prefix-summed, and only the one bin in which a source's border lies is looked at further. While that has many rows it is
cut again in the same way, so whatever the weights are, only a few rows are sorted.

Defined results: size is the number of runs of characters outside `[\\x20\\x09-\\x0D]`; a null text has size 0, as has an empty one.
A null source is a source of its own, last in order. A table without words gives targets of 0. Documents of size 0 are taken with 0
words. A text of any length is one document and is taken whole. Ties in the keys go by doc_id; rows that repeat a doc_id share a key and fall on
the same side. An empty table gives an empty result. Extra columns are not read, and may bear any name with `carry`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import WORD, stored, table, uniform

WEIGHTS = (5.0, 2.0, 1.0)
TOTAL_SHARE = 1.5
MOST_EPOCHS = 2.0
SEED = 42
#: Bins of keys for each source, and again for a border's bin of more rows than are sorted at once.
BINS = 4096
SORTED_ROWS = 100_000
#: Up to so many sources their table is broadcast, under 1 MB.
FEW_SOURCES = 10_000
#: A document without any letter still has this quality.
LEAST_QUALITY = 0.1


def letter_share(text: Column) -> Column:
    """A quality weight in [0.1, 1]: the share of the letters A to Z, in either case, among all characters."""
    others = F.length(F.regexp_replace(text, "[A-Za-z]+", ""))
    share = F.when(F.length(text) > 0, (F.length(text) - others) / F.length(text)).otherwise(0.0)
    return F.greatest(F.lit(LEAST_QUALITY), share)


def source_targets(sizes: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, share: float = TOTAL_SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """One row per source of sizes(source, source_size): source, source_size, target.

    Targets share `share` of all words by weight, none above `most` times its source. Sources stop at that limit in the order of
    limit over weight; the level at which the others stand then follows from prefix sums in closed form.
    """
    # 'source IS NULL' first puts null last; strings compare by their UTF-8 bytes, which is the order of code points.
    order = Window.orderBy(F.col("source").isNull(), "source")
    place = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), place + 1)).withColumn("limit", F.col("source_size") * F.lit(most))
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source")
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(share)
    level = ranked.withColumn("level", (total - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    # The first source, by ratio, that its own level leaves within its limit sets the level of all after it.
    free = level.withColumn("first_free", F.min(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.struct(F.col("limit") / F.col("weight"), "level"))).over(Window.partitionBy()))
    target = F.when(F.col("first_free").isNull() | (F.col("limit") / F.col("weight") < F.col("first_free")["col1"]), F.col("limit")).otherwise(F.least(F.col("limit"), F.col("first_free")["level"] * F.col("weight")))
    return free.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, *, quality: Column | None = None, weights: tuple[float, ...] = WEIGHTS, share: float = TOTAL_SHARE, most: float = MOST_EPOCHS, seed: int = SEED, bins: int = BINS, sorted_rows: int = SORTED_ROWS, carry: bool = False) -> DataFrame:
    """One row per row of docs(doc_id, text, source): doc_id, size, source_size, target, taken, epochs (whole copies in the mix).

    quality: positive sampling weight of a document; by default its share of letters. carry: the row of docs itself as the column `row`.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    key = -F.log(uniform(F.col("doc_id"), seed=seed)) / (letter_share(text) if quality is None else quality)
    row = [F.struct(*docs.columns).alias("row")] if carry else []
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), key.alias("key"), *row)
    # 1 - exp(-key) spreads keys of weight 1 evenly over the bins; other weights make some bins larger, which are cut again below.
    binned = stored(sized.withColumn("bin", F.floor((1 - F.exp(-F.col("key"))) * bins).cast("int")), "sized")

    sums = binned.groupBy("source", "bin").agg(*_bin_facts())
    targets = source_targets(sums.groupBy("source").agg(F.sum("bin_size").alias("source_size")), weights=weights, share=share, most=most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = targets.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))

    rests = targets.select(F.col("source").alias("its"), "rest", F.lit(0).cast("long").alias("from"))
    border = stored(_borders(sums.join(rests, F.col("source").eqNullSafe(F.col("its"))).drop("source")), "borders")
    rows = binned.select("source", "key", "doc_id", "size")
    inside = rows.join(_small(border), F.col("source").eqNullSafe(F.col("its")) & F.col("key").between(F.col("low"), F.col("high"))).drop("source")
    # A bin of many unlike keys is cut into bins of equal width between its smallest and its largest key, until few rows are left to sort.
    while (border.agg(F.max(F.when(F.col("low") < F.col("high"), F.col("rows")))).first()[0] or 0) > sorted_rows:
        width = F.try_divide(F.col("key") - F.col("low"), F.col("high") - F.col("low"))
        finer = inside.withColumn("bin", F.least(F.coalesce(F.floor(width * bins), F.lit(0)), F.lit(bins - 1)).cast("int"))
        finer = finer.groupBy("its", "bin", "rest", F.col("start").alias("from")).agg(*_bin_facts())
        border = stored(_borders(finer), "borders")
        inside = rows.join(_small(border), F.col("source").eqNullSafe(F.col("its")) & F.col("key").between(F.col("low"), F.col("high"))).drop("source")
    upto = F.col("start") + F.sum("size").over(Window.partitionBy("its").orderBy("key", "doc_id"))
    prefix = inside.withColumn("upto", upto)
    # Taken while the middle of the document lies before the border: the document across it goes to the nearer side.
    last = prefix.where(F.col("upto") - F.col("size") / 2 <= F.col("rest")).groupBy("its").agg(F.max(F.struct("key", "doc_id")).alias("last"))
    borders = border.select("its", "low").join(last.withColumnRenamed("its", "also"), F.col("its").eqNullSafe(F.col("also")), "left").drop("also")
    plan = stored(targets.join(borders, F.col("source").eqNullSafe(F.col("its")), "left").drop("its").withColumnRenamed("source", "its"), "plan")

    placed = binned.join(_small(plan), F.col("source").eqNullSafe(F.col("its")))
    before = (F.col("key") < F.col("low")) | F.coalesce(F.struct("key", "doc_id") <= F.col("last"), F.lit(False))
    chosen = F.when(F.col("rest") <= 0, F.lit(False)).otherwise(before)
    epochs = (F.col("whole") + F.coalesce(chosen, F.lit(False)).cast("int")).cast("int")
    return placed.select("doc_id", "size", "source_size", "target", (F.col("size") * epochs).alias("taken"), epochs.alias("epochs"), *(["row"] if carry else []))


def _bin_facts() -> list[Column]:
    """What a bin tells: its words, rows, and smallest and largest key."""
    return [F.sum("size").alias("bin_size"), F.count("*").alias("rows"), F.min("key").alias("low"), F.max("key").alias("high")]


def _borders(sums: DataFrame) -> DataFrame:
    """Of bins (its, bin, rest, from, bin_size, rows, low, high) the one of each source in which the words up to it reach `rest`."""
    along = Window.partitionBy("its").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.col("from") + F.coalesce(F.sum("bin_size").over(along), F.lit(0)))
    return starts.where((F.col("start") < F.col("rest")) & (F.col("start") + F.col("bin_size") >= F.col("rest"))).select("its", "rest", "start", "rows", "low", "high")


def _small(by_source: DataFrame) -> DataFrame:
    """A table of one row for each source, marked for broadcast if there are few; else the join shuffles, and Spark splits a hot source."""
    return F.broadcast(by_source) if by_source.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES else by_source


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


QUERIES = {"op3_mixing": op3_mixing}
SQL = {
    "op3_mixing": r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         (('0x' || substr(md5('42|' || doc_id), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         -ln(u) / greatest(0.1::DOUBLE, CASE WHEN length(text) > 0
             THEN (length(text) - length(regexp_replace(text, '[A-Za-z]+', '', 'g')))::DOUBLE / length(text) ELSE 0 END) AS key
  FROM d),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, source_size * 2.0::DOUBLE AS lim,
         CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM src),
levels AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE
             - coalesce(sum(lim) OVER (ORDER BY lim / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY lim / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev
  FROM ranked),
free AS (SELECT min(lim / w) AS r, min_by(lev, lim / w) AS lev FROM levels WHERE lev * w <= lim),
targets AS (
  SELECT l.source, l.source_size,
         CASE WHEN f.r IS NULL OR l.lim / l.w < f.r THEN l.lim ELSE least(l.lim, f.lev * l.w) END AS target
  FROM levels l CROSS JOIN free f),
parts AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM targets),
placed AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS rest,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id) AS upto
  FROM sized s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source),
taken AS (SELECT *, CAST(whole + CASE WHEN rest > 0 AND upto - size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END AS INT) AS epochs FROM placed)
SELECT doc_id, size, source_size, target, size * epochs AS taken, epochs FROM taken"""
}
