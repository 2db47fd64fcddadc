"""A training corpus from raw documents: language ID, exact and near deduplication, mixing of sources, SentencePiece encoding."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm._shared import shared_folder, stored
from weftline.llm.exact_dedup import exact_dedup
from weftline.llm.langid import keep_identified
from weftline.llm.mixing import mix
from weftline.llm.near_dedup import near_duplicates
from weftline.llm.pieces import encode


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language is not told, go."""
    return keep_identified(docs)


def _first_of_each(docs: DataFrame, group: str, grouped) -> DataFrame:
    """Of each group of rows the one with the smallest doc_id, a null last; rows are told apart by a number of their own, not by doc_id."""
    rows = stored(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    groups = grouped(rows).select(F.col("doc_id").alias("__row"), group)
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("__row"))
    first = groups.join(rows.select("__row", "doc_id"), "__row").groupBy(group).agg(F.min_by("__row", order).alias("__row"))
    return rows.join(first, "__row", "left_semi").select(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest doc_id stays."""
    return _first_of_each(docs, "keep_id", lambda rows: exact_dedup(rows, key="__row"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays."""
    return _first_of_each(docs, "class_id", lambda rows: near_duplicates(rows, key="__row"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stands in the mix as often as the mix takes it: never, once or twice."""
    taken = mix(docs, carry=True).where("epochs > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), "epochs"))).select("row.*")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of each document; all texts decode to themselves."""
    return encode(docs, ["doc_id", "lang", "source"])


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("mixing", mixing),
    ("encoding", encoding),
]
#: Language ID, near-duplicates and sampled pieces have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet to the shared folder and read again as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/corpus_pipeline/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
