"""Scoring and splitting of corrections: (source, target, prediction) rows to edits, safe candidates, metrics and intervals."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import edits as E
from ..functions.metrics import f_beta, ratio
from ..functions.text import SCORED_NUMBER, let, same_multiset, span_count
from ..sources.shared import stored
from .joins import with_place
from .selection import first_by_hash

PAIRS = "array<struct<old:array<string>,new:array<string>>>"


def apply_scripts(rows: DataFrame, source: str = "source", script: str = "script", finished: Column | None = None) -> DataFrame:
    """rows with text, status (INVALID, KEEP, REJECTED, APPLIED), reasons and operation_count. Sources are normalised first."""
    done = F.lit(True) if finished is None else finished
    parsed = rows.withColumn("_s", E.normal(F.col(source))).withColumn("_p", E.parse_and_splice(F.col("_s"), F.col(script)))
    spliced = parsed.withColumn("_c", E.normal(F.col("_p.candidate"))).withColumn("_loop", E.loops(F.col("_c")))
    bad, kept = F.col("_p.error").isNotNull(), F.size("_p.operations") == 0
    first = F.struct(F.when(bad, "INVALID").when(kept, "KEEP").alias("status"), F.when(bad, F.array("_p.error")).otherwise(F.array().cast("array<string>")).alias("reasons"))
    found = E.safety_reasons(F.col("_s"), F.col("_c"), F.col("_p.ratio"), done, F.col("_loop"))
    return _judged(spliced.withColumn("operation_count", F.when(bad, 0).otherwise(F.size("_p.operations"))), first, found).drop("_s", "_p", "_c", "_loop")


def _judged(rows: DataFrame, first: Column, found: Column) -> DataFrame:
    """rows with status, reasons and text: as `first` says, or else by the reasons found. These search both texts by nine patterns and more, so they are bound."""

    def judged(x: Column) -> Column:
        status = F.coalesce(x["first"]["status"], F.when(F.size(x["found"]) > 0, "REJECTED").otherwise("APPLIED"))
        return F.struct(status.alias("status"), F.coalesce(x["found"], x["first"]["reasons"]).alias("reasons"), F.when(status == "APPLIED", F.col("_c")).otherwise(F.col("_s")).alias("text"))

    both = let(first, lambda x: F.struct(x.alias("first"), F.when(x["status"].isNull(), found).alias("found")))
    return rows.withColumn("_judged", let(both, judged)).withColumns({c: F.col(f"_judged.{c}") for c in ("status", "reasons", "text")}).drop("_judged")


def validate_candidates(rows: DataFrame, source: str = "source", candidate: str = "candidate", finished: Column | None = None) -> DataFrame:
    """as apply_scripts(), for whole candidate texts; a loop counts only if the source has none."""
    return _validated(rows.withColumns({"_s": E.normal(F.col(source)), "_c": E.normal(F.coalesce(F.col(candidate), F.lit("")))}), finished)


def _validated(n: DataFrame, finished: Column | None = None) -> DataFrame:
    """validate_candidates() of normalised texts _s and _c."""
    done = F.lit(True) if finished is None else finished
    n = n.withColumns({"_r": E.text_similarity("_s", "_c"), "_loop": E.loops("_c"), "_was": E.loops("_s"), "_n": E.operation_count("_s", "_c")})
    empty, same = F.col("_c") == "", F.col("_c") == F.col("_s")
    first = F.struct(F.when(empty, "INVALID").when(same, "KEEP").alias("status"), F.when(empty, F.array(F.lit("empty_candidate"))).otherwise(F.array().cast("array<string>")).alias("reasons"))
    found = E.safety_reasons(F.col("_s"), F.col("_c"), F.col("_r"), done, F.col("_loop") & ~F.col("_was"))
    out = _judged(n.withColumn("operation_count", F.when(empty | same, 0).otherwise(F.col("_n"))), first, found)
    return out.drop("_s", "_c", "_r", "_loop", "_was", "_n")


def with_edits(rows: DataFrame) -> DataFrame:
    """rows(id, category, document, source, target, prediction) with edits, spans, pairs and flags.

    Optional columns: contextual (boolean), protected (array of spans) and lemma_pairs (array of (old, new) words of unseen lemmas). The
    alignments are costly and every score reads them several times, so the result is written once to the shared folder.
    """
    return stored(_edited(rows), "edits")


def _edited(rows: DataFrame) -> DataFrame:
    return _with_flags(_aligned(rows))


def _aligned(rows: DataFrame) -> DataFrame:
    """Rows as with_edits() takes them, their texts normalised, with gold and made."""
    lacking = {"contextual": F.lit(False), "protected": F.array().cast("array<string>"), "lemma_pairs": F.array().cast(PAIRS)}
    n = rows.withColumns({c: e for c, e in lacking.items() if c not in rows.columns})
    n = n.withColumns({c: E.normal(F.col(c)) for c in ("source", "target", "prediction")})
    w = n.withColumns({f"_{c}": E.edit_words(F.col(c)) for c in ("source", "target", "prediction")})
    return w.withColumns({"gold": E.word_edits("_source", "_target"), "made": E.word_edits("_source", "_prediction")}).drop("_source", "_target", "_prediction")


def _with_flags(e: DataFrame) -> DataFrame:
    s, t, p = F.col("source"), F.col("target"), F.col("prediction")
    changed = s != t
    return e.withColumns(
        {
            "exact": p == t,
            "changed": changed,
            "clean_preserved": ~changed & (p == s),
            "undercorrected": changed & (p == s),
            "wrong_corrected": changed & (p != s) & (p != t),
            "gold_spans": E.edit_spans(F.col("gold")),
            "made_spans": E.edit_spans(F.col("made")),
            "gold_pairs": E.edit_pairs(F.col("gold")),
            "made_pairs": E.edit_pairs(F.col("made")),
            "number_mutation": ~same_multiset(F.regexp_extract_all(s, F.lit(SCORED_NUMBER), F.lit(0)), F.regexp_extract_all(p, F.lit(SCORED_NUMBER), F.lit(0))),
            "protected_mutation": protected_mutated(s, p, F.col("protected")),
        }
    )


def raw_and_safe(rows: DataFrame, candidate: str = "candidate") -> DataFrame:
    """Rows with source, target and a candidate as validate_candidates() has them, each twice and with the columns of with_edits(): kind raw has the candidate as its
    prediction, safe the text that may be used.

    That text is the candidate or the source, so it needs no alignment of its own: its edits are the candidate's or none. Nothing is written. Alignments come
    first: a Python function above the reasons would bring a copy of them for each of their uses.
    """
    e = _validated(_aligned(rows.withColumn("prediction", F.coalesce(candidate, F.lit("")))).withColumns({"_s": F.col("source"), "_c": F.col("prediction")}))
    none = F.array().cast(e.schema["made"].dataType)
    used = F.struct(F.lit("safe").alias("kind"), F.col("text").alias("prediction"), F.when(F.col("text") == F.col("prediction"), F.col("made")).otherwise(none).alias("made"))
    both = F.array(F.struct(F.lit("raw").alias("kind"), "prediction", "made"), used)
    kept = [c for c in e.columns if c not in ("prediction", "made", candidate, "text")]
    return _with_flags(e.select(*kept, F.explode_outer(both).alias("_b")).select(*kept, "_b.*"))


def gold_edits(rows: DataFrame) -> DataFrame:
    """Rows with changed and gold_pairs as with_edits() has them, for what reads no prediction: source and target are aligned only, and nothing is written."""
    n = rows.withColumns({c: E.normal(F.col(c)) for c in ("source", "target")})
    w = n.withColumns({f"_{c}": E.edit_words(F.col(c)) for c in ("source", "target")}).withColumn("gold", E.word_edits("_source", "_target"))
    return w.withColumns({"changed": F.col("source") != F.col("target"), "gold_pairs": E.edit_pairs(F.col("gold"))}).drop("_source", "_target")


def mark_unseen(edits: DataFrame, taught: DataFrame, key: str = "id") -> DataFrame:
    """Column unseen, the gold edits whose pair is not among taught(old, new)."""
    exploded = edits.select(key, F.explode("gold").alias("g")).select(key, "g", F.col("g.old").alias("old"), F.col("g.new").alias("new"))
    new = exploded.join(taught.select("old", "new").distinct(), ["old", "new"], "left_anti").groupBy(key).agg(F.collect_set("g").alias("unseen"))
    return edits.join(new, key, "left").withColumn("unseen", F.coalesce("unseen", F.array().cast(edits.schema["gold"].dataType)))


def _marks(edits: DataFrame) -> dict[str, Column]:
    """What each row counts in the sums, but for unseen edits: counts by name."""

    def common(a: str, b: str) -> Column:
        return F.size(F.array_intersect(a, b))

    def yes(c: Column) -> Column:
        return F.coalesce(c, F.lit(False)).cast("int")

    c = {name: F.col(name) for name in edits.columns}
    return {
        "n": F.lit(1),
        "n_changed": yes(c["changed"]),
        "n_clean": yes(~c["changed"]),
        "s_exact": yes(c["exact"]),
        "s_changed_exact": yes(c["exact"] & c["changed"]),
        "s_preserved": yes(c["clean_preserved"]),
        "s_under": yes(c["undercorrected"]),
        "s_wrong": yes(c["wrong_corrected"]),
        "s_gold": F.size("gold"),
        "s_made": F.size("made"),
        "s_matched": common("gold", "made"),
        "s_gold_spans": F.size("gold_spans"),
        "s_made_spans": F.size("made_spans"),
        "s_matched_spans": common("gold_spans", "made_spans"),
        "s_lemmas": F.size("lemma_pairs"),
        "s_lemma_hit": common("lemma_pairs", "made_pairs"),
        "n_contextual": yes(c["contextual"]),
        "s_contextual_exact": yes(c["exact"] & c["contextual"]),
        "s_protected_mutation": yes(c["protected_mutation"]),
        "s_number_mutation": yes(c["number_mutation"]),
    }


UNSEEN = ("s_unseen", "s_unseen_hit")


def partial_sums(edits: DataFrame, by: list[str], more: Iterable[Column] = ()) -> DataFrame:
    """Sums by group of rows with edits and unseen, and other aggregates. All metrics are ratios of such sums, so groups, totals and resamples add them up."""
    marks = _marks(edits) | {"s_unseen": F.size("unseen"), "s_unseen_hit": F.size(F.array_intersect("unseen", "made"))}
    return edits.groupBy(*by).agg(*(F.sum(c).alias(name) for name, c in marks.items()), *more)


def sums_with_unseen(rows: DataFrame, teaches: Column, by: str) -> DataFrame:
    """partial_sums() of rows as with_edits() takes them; the pairs of rows where `teaches` holds are taught, and gold edits of other pairs are unseen.

    A row's counts are found inside the row and only they and its gold edits are written. Edits are summed up by pair and group before pairs that are
    taught leave, so what is shuffled are different pairs, and no row is joined to its edits.
    """
    e = _edited(rows)
    marks = _marks(e)
    gold = F.transform(F.array_distinct("gold"), lambda g: F.struct(g["old"].alias("old"), g["new"].alias("new"), F.array_contains("made", g).alias("hit")))
    counted = stored(e.select(F.col(by), teaches.alias("teaches"), gold.alias("gold"), *(c.alias(name) for name, c in marks.items())), "counted")
    sums = counted.groupBy(by).agg(*(F.sum(name).alias(name) for name in marks))
    each = counted.select(by, "teaches", F.explode("gold").alias("g")).groupBy("g.old", "g.new", by)
    pairs = each.agg(F.count("*").alias("s_unseen"), F.count_if("g.hit").alias("s_unseen_hit"), F.bool_or(F.coalesce("teaches", F.lit(False))).alias("taught"))
    unseen = pairs.join(pairs.where("taught").select("old", "new").distinct(), ["old", "new"], "left_anti").groupBy(by).agg(*(F.sum(c).alias(c) for c in UNSEEN))
    both = sums.unionByName(unseen, allowMissingColumns=True).groupBy(by)
    return both.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*marks, *UNSEEN)))


def metrics(sums: DataFrame, keep: list[str]) -> DataFrame:
    """Metrics of rows of sums; 0 where a denominator is 0."""

    def r(a: str, b: str) -> Column:
        return ratio(F.col(a), F.col(b))

    precision, recall = r("s_matched", "s_made"), r("s_matched", "s_gold")
    spotted, found = r("s_matched_spans", "s_made_spans"), r("s_matched_spans", "s_gold_spans")
    out = {
        "exact_match": r("s_exact", "n"),
        "change_needed_exact": r("s_changed_exact", "n_changed"),
        "clean_preservation": r("s_preserved", "n_clean"),
        "overcorrection_rate": ratio(F.col("n_clean") - F.col("s_preserved"), F.col("n_clean")),
        "undercorrection_rate": r("s_under", "n_changed"),
        "wrong_correction_rate": r("s_wrong", "n_changed"),
        "edit_precision": precision,
        "edit_recall": recall,
        "edit_f05": f_beta(precision, recall, 0.5),
        "detection_precision": spotted,
        "detection_recall": found,
        "detection_f1": f_beta(spotted, found),
        "unseen_pair_recall": r("s_unseen_hit", "s_unseen"),
        "unseen_lemma_recall": r("s_lemma_hit", "s_lemmas"),
        "contextual_exact": r("s_contextual_exact", "n_contextual"),
        "protected_mutation_rate": r("s_protected_mutation", "n"),
        "number_mutation_rate": r("s_number_mutation", "n"),
    }
    counts = ["n", "n_changed", "n_clean", "n_contextual", "s_gold", "s_made", "s_unseen", "s_lemmas"]
    return sums.select(*keep, *counts, *(F.round(c, 6).alias(name) for name, c in out.items()))


#: Metrics for which intervals are given.
INTERVALS = (
    "exact_match", "change_needed_exact", "clean_preservation", "overcorrection_rate", "edit_precision", "edit_recall", "edit_f05", "unseen_pair_recall",
    "contextual_exact", "protected_mutation_rate", "number_mutation_rate",
)


#: Documents whose draws one leaf of the tree of ranges decides.
LEAF = 4096


def drawn_counts(n: int, samples: int, seed: int, leaf: int) -> np.ndarray:
    """How often each document of one leaf (documents leaf * LEAF up to the next leaf, of n in all) is drawn in each sample: samples by documents.

    n draws with replacement from n documents are a multinomial. Going down a binary tree of ranges, the draws of a range fall on its left
    half by a binomial law, whatever happens elsewhere. Each node's generator starts from its own place, so every leaf finds the same counts above it, and all leaves
    together hold n draws of each sample.
    """

    def left_part(low: int, middle: int, high: int, draws: np.ndarray) -> np.ndarray:
        return np.random.Generator(np.random.Philox(key=[seed, (low << 32) ^ high])).binomial(draws, (middle - low) / (high - low))

    draws = np.full(samples, n, np.int64)
    low, high, first = 0, n, leaf * LEAF
    while high - low > LEAF:  # ranges begin at multiples of LEAF
        middle = low + (-(-(high - low) // LEAF) + 1) // 2 * LEAF
        left = left_part(low, middle, high, draws)
        low, high, draws = (low, middle, left) if first < middle else (middle, high, draws - left)
    out = np.zeros((samples, high - low), np.int64)
    todo = [(low, high, draws)]
    while todo:
        a, b, now = todo.pop()
        if b - a == 1:
            out[:, a - low] = now
            continue
        middle = (a + b) // 2
        left = left_part(a, middle, b, now)
        todo += [(a, middle, left), (middle, b, now - left)]
    return out


def bootstrap(edits: DataFrame, document: str = "document", samples: int = 1000, seed: int = 42) -> DataFrame:
    """Metric, low, high - intervals from samples of as many documents as there are, drawn with replacement.

    Metrics are ratios of sums, so each document is summed up and numbered first. No draw is a row: a task finds for a range of LEAF documents how often each
    sample draws them (drawn_counts) and adds up their sums; what is shuffled is a row for each sample and range.
    """
    return bootstrap_sums(partial_sums(edits, [document]), document, samples, seed)


def bootstrap_sums(by_document: DataFrame, document: str = "document", samples: int = 1000, seed: int = 42) -> DataFrame:
    """bootstrap() of the sums of each document."""
    names = [c for c in by_document.columns if c != document]
    placed = stored(with_place(by_document, F.col(document), "place").select("place", *names), "documents")
    sums = resampled_sums(placed, names, placed.count(), samples, seed)
    long = metrics(sums, ["sample"]).unpivot(["sample"], list(INTERVALS), "metric", "value")
    return long.groupBy("metric").agg(F.round(F.percentile("value", 0.025), 6).alias("low"), F.round(F.percentile("value", 0.975), 6).alias("high"))


def resampled_sums(placed: DataFrame, names: list[str], n: int, samples: int, seed: int) -> DataFrame:
    """sample and the sums of the columns `names` over the documents drawn; place counts them from 1 to n."""

    def leaf_sums(rows: pa.Table) -> pa.Table:
        place = rows.column("place").to_numpy() - 1
        times = drawn_counts(n, samples, seed, int(place[0] // LEAF))[:, place % LEAF]
        out = {"sample": pa.array(np.arange(samples))}
        for c in names:
            out[c] = pa.array(times @ rows.column(c).to_numpy(zero_copy_only=False).astype(np.int64))
        return pa.table(out)

    leaves = placed.withColumn("leaf", F.floor((F.col("place") - 1) / LEAF)).groupBy("leaf").applyInArrow(leaf_sums, "sample long, " + ", ".join(f"`{c}` long" for c in names))
    return leaves.groupBy("sample").agg(*(F.sum(c).alias(c) for c in names))


def acceptance(rates: DataFrame) -> DataFrame:
    """Rows of (invalid_rate, applied_rate, edit_f05) with `accepted`: not half of the scripts invalid, some applied, and an F0.5 above 0."""
    return rates.withColumn("accepted", (F.col("invalid_rate") < 0.5) & (F.col("applied_rate") > 0) & (F.col("edit_f05") > 0))


def _half_even(x: float) -> int:
    return round(x)


def pair_disjoint_split(edits: DataFrame, key: str = "id", *, dev_share: float = 0.05, changed_share: float = 0.65, most_uses: int = 2, seed: int = 42) -> DataFrame:
    """Key and split (dev, train, dropped): dev rows are seeded from rare edit pairs and unchanged rows by hash; rows of the rest that
    share a pair with dev are dropped, so the two sides share none."""
    pairs = edits.select(key, F.explode("gold_pairs").alias("pair"))
    uses = pairs.groupBy("pair").agg(F.count("*").alias("uses"))
    rare = pairs.join(uses, "pair").groupBy(key).agg((F.max("uses") <= most_uses).alias("rare"))
    rows = stored(edits.select(key, "changed").join(rare, key, "left").select(key, "changed", F.coalesce("rare", F.lit(False)).alias("rare")), "rows")
    n = rows.count()
    size = max(2, _half_even(n * dev_share))
    k1 = _half_even(size * changed_share)
    seeded = first_by_hash(rows.where("changed AND rare").select(key), key, k1, seed).unionByName(first_by_hash(rows.where("NOT changed").select(key), key, size - k1, seed))
    reserved = pairs.join(seeded, key, "left_semi").select("pair").distinct()
    shares = pairs.join(reserved, "pair", "left_semi").select(key).distinct().withColumn("shares", F.lit(True))
    placed = edits.select(key).join(seeded.withColumn("dev", F.lit(True)), key, "left").join(shares, key, "left")
    return placed.select(key, F.when(F.col("dev"), "dev").when(F.col("shares"), "dropped").otherwise("train").alias("split"))


def protected_mutated(source: Column, prediction: Column, spans: Column) -> Column:
    """F71 over an array of spans."""
    return F.coalesce(F.exists(spans, lambda s: (s != "") & (span_count(source, s) != span_count(prediction, s))), F.lit(False))

