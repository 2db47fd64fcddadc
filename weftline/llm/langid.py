"""Language identification by a string kernel: blended-spectrum n-gram presence, Nystroem landmarks, one-versus-rest ridge regression.

The kernel of two texts is the number of byte n-grams (n = 1 to 4, lower case, letters and blanks only) that both contain, counted by
presence, divided by the root of both texts' own numbers. N-grams are hashed to `DIMENSIONS` presence features, so the kernel is a
product of presence vectors. The model is fitted on the driver from a bounded sample: at most PER_LANGUAGE labelled documents of
each language (parameters `per_language` and `most`), chosen by a hash of doc_id, of which the first LANDMARKS / languages are the landmarks. Since kernel values against
the landmarks are linear in the presence vector, scoring multiplies a batch of presence vectors by one matrix, landmarks, whitening
and regression weights folded together.

Defined results: a null text, or one without a letter, has lang_pred 'und' and score 0. A text whose n-grams are unknown gets the
class with the largest output. Without any labelled document all predictions are 'und'. Ties go to the language first in order.
A text of any length is scored whole. Rows that repeat a doc_id are scored each. An empty table gives an empty result. Extra columns are not read; lang, source and doc_id are no inputs of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import slices, table, text_bytes

DIMENSIONS = 1 << 14
SPECTRUM = (1, 2, 3, 4)
#: The bound of the sample that the model is fitted on: labelled documents of each language, and of all together (one of each at least).
PER_LANGUAGE = 400
SAMPLE = 20_000
#: Rows that are ranked for each one taken, on average.
OVERSAMPLE = 4
#: Landmarks; of more languages than that each has one.
LANDMARKS = 320
RIDGE = 0.05
UNKNOWN = "und"


def normalised(text: Column) -> Column:
    """Lower case, with every run of characters that are no letters turned into one space."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " ")


def presence(body: np.ndarray, at: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Presence vectors (rows by dimensions, 0 or 1) of the n-grams of each text; none crosses a text's border."""
    rows = len(at) - 1
    out = np.zeros(rows * dimensions, np.float32)
    if len(body):
        row = np.repeat(np.arange(rows, dtype=np.int64) * dimensions, np.diff(at))
        gram = np.zeros(len(body), np.uint32)
        for n in range(1, max(SPECTRUM) + 1):
            have = len(body) - n + 1
            if have <= 0:
                break
            gram = (gram[:have] << np.uint32(8)) | body[n - 1 :]
            if n in SPECTRUM:
                inside = row[:have] == row[n - 1 :]
                cell = ((gram ^ np.uint32(n * 0x3C6EF372 & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - int(np.log2(dimensions)))
                out[(row[:have] + cell)[inside]] = 1.0
    return out.reshape(rows, dimensions)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "norm", 1 << 20):
        bits = np.packbits(presence(*text_bytes(batch.column("norm"))).astype(bool), axis=1)
        yield pa.record_batch([batch.column("lang"), batch.column("place"), pa.array([b.tobytes() for b in bits], pa.binary())], names=["lang", "place", "bits"])


def fit(sample: DataFrame, *, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> tuple[list[str], np.ndarray]:
    """Fit on sample(lang, place, norm), of bounded size: the languages in order, and the matrix that scores presence vectors."""
    rows = sample.mapInArrow(_features, "lang string, place int, bits binary").toPandas().sort_values(["place", "lang"], kind="stable")
    languages = sorted(rows["lang"].unique())
    if not languages:
        return [], np.zeros((DIMENSIONS, 0), np.float32)
    bits = np.frombuffer(b"".join(rows["bits"]), np.uint8).reshape(len(rows), -1)

    def unpacked(part: np.ndarray) -> np.ndarray:
        x = np.unpackbits(part, axis=1).astype(np.float32)
        return x / np.maximum(np.sqrt(x.sum(1, keepdims=True)), 1)

    marks = unpacked(bits[: max(landmarks, len(languages))])  # by place, so all languages have their share
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = values > 1e-6 * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])
    z = np.concatenate([(unpacked(bits[k : k + 1000]) @ marks.T).astype(np.float64) @ whiten for k in range(0, len(bits), 1000)])
    y = (rows["lang"].to_numpy()[:, None] == np.array(languages)[None, :]).astype(np.float64)
    mean, base = z.mean(0), y.mean(0)
    beta = np.linalg.solve((z - mean).T @ (z - mean) + ridge * len(z) / 100 * np.eye(z.shape[1]), (z - mean).T @ (y - base))
    folded = np.zeros((DIMENSIONS + 1, len(languages)), np.float32)
    folded[:-1] = marks.T @ (whiten @ beta)
    folded[-1] = base - mean @ beta
    return languages, folded


def _scorer(languages: list[str], folded: np.ndarray):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*languages, UNKNOWN], dtype=object)
        for batch in slices(batches, "norm", 1 << 20):
            body, at = text_bytes(batch.column("norm"))
            best, top, gap = np.full(batch.num_rows, len(languages)), np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            if languages:
                for k in range(0, batch.num_rows, 256):
                    part = at[k : k + 257]
                    x = presence(body[part[0] : part[-1]], part - part[0])
                    out = x @ folded[:-1] / np.maximum(np.sqrt(x.sum(1, keepdims=True)), 1) + folded[-1]
                    best[k : k + 256], top[k : k + 256] = out.argmax(1), out.max(1)
                    gap[k : k + 256] = top[k : k + 256] - (np.partition(out, -2, axis=1)[:, -2] if len(languages) > 1 else 0.0)
            none = ~batch.column("lettered").to_numpy(zero_copy_only=False).astype(bool)
            best[none], top[none], gap[none] = len(languages), 0.0, 0.0
            yield pa.record_batch(
                [*(batch.column(c) for c in batch.schema.names if c not in ("norm", "lettered")), pa.array(names[best], pa.string()), pa.array(np.clip(top, 0.0, 1.0).round(6), pa.float64()), pa.array(gap.round(6), pa.float64())],
                names=[*(c for c in batch.schema.names if c not in ("norm", "lettered")), "lang_pred", "score", "margin"],
            )

    return score


def identify(docs: DataFrame, labelled: DataFrame, carry: list[str], *, text: str = "text", labelled_text: str = "text", key: str = "doc_id", lang: str = "lang", per_language: int = PER_LANGUAGE, most: int = SAMPLE, landmarks: int = LANDMARKS) -> DataFrame:
    """The columns `carry`, lang_pred, score and margin (of the best output over the second) of each row of docs.

    The model is fitted on a bounded sample of labelled(key, text, lang): at most `per_language` rows of each language and, with very many
    languages, at most `most` of all, but one of each. Every language that has a label and a text with a letter is learned.
    """

    def lettered(body: Column) -> Column:
        return F.coalesce(body.rlike(r"\p{L}"), F.lit(False))

    named = labelled.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(key).alias("id"), F.col(labelled_text).alias("body")).where(lettered(F.col("body")))
    named = named.withColumn("hash", F.when(F.col("id").isNotNull(), F.xxhash64("id")).otherwise(F.xxhash64("body")))
    counts = {r["lang"]: r["count"] for r in named.groupBy("lang").count().orderBy("lang").collect()}  # a row for each language
    per_language = max(1, min(per_language, most // max(1, len(counts))))
    # Only rows of small hashes are ranked, a few times as many as are taken, so what is ranked does not grow with the table.
    shares = [x for name, n in counts.items() for x in (F.lit(name), F.lit(min(1.0, OVERSAMPLE * per_language / n)))]
    share = F.element_at(F.create_map(*shares), F.col("lang")) if shares else F.lit(0.0)
    usable = named.where(F.col("hash") / float(1 << 64) + 0.5 <= share)
    by_hash = Window.partitionBy("lang").orderBy("hash", "id")
    sample = usable.withColumn("place", F.row_number().over(by_hash)).where(F.col("place") <= per_language).select("lang", "place", normalised(F.col("body")).alias("norm"))
    languages, folded = fit(sample, landmarks=landmarks)
    rows = docs.select(*carry, F.coalesce(normalised(F.col(text)), F.lit("")).alias("norm"), lettered(F.col(text)).alias("lettered"))
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in carry)
    return rows.mapInArrow(_scorer(languages, folded), f"{schema}, lang_pred string, score double, margin double")


def remainder(key: Column, n: int) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(n))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 3) == 1
    predicted = identify(docs, docs.where(~held_out), ["doc_id"])
    return predicted.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


#: A document goes if its two best languages are within this of one another; the number of languages does not move it. Texts of two languages
#: have small margins too, so it is no larger than what tells a tie.
LEAST_MARGIN = 0.001


def keep_identified(docs: DataFrame, *, least: float = LEAST_MARGIN) -> DataFrame:
    """The rows of docs(doc_id, text, lang, ...) whose language is told; the columns stay as they are, whatever their names.

    Scores are computed on the rows themselves, so no join back by doc_id is needed.
    """
    numbered = docs.select(*(F.col(c).alias(f"__{k}") for k, c in enumerate(docs.columns)))
    at = {c: f"__{k}" for k, c in enumerate(docs.columns)}
    scored = identify(numbered, docs.where(remainder(F.col("doc_id"), 3) != 1), numbered.columns, text=at["text"])
    told = scored.where((F.col("lang_pred") != UNKNOWN) & (F.col("margin") >= least))
    return told.select(*(F.col(at[c]).alias(c) for c in docs.columns))


QUERIES = {"op10_language_id": op10_language_id}
SQL: dict[str, str] = {}
