"""Style correctness of a rewritten text: numbers, fact tokens, content, length and quality, as columns of one row.

Numbers and fact tokens are multisets: an occurrence that is repeated must be repeated in the rewritten text. Case counts, as it does for the
script this was made for, which has none.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .metrics import char_cosine, multiset_common
from .profiles import LATIN, ScriptProfile
from .text import NUMBER_SIMPLE, let, numbers, scoring_text, stutters, text_or_empty

#: Weights of the parts, the share of numbers that are kept in their part, and the least overall score of each tier.
WEIGHTS = {"numbers": 0.30, "facts": 0.35, "content_similarity": 0.20, "length": 0.10, "quality": 0.05}
KEPT_NUMBERS = 0.75
TIERS = ((90, "excellent"), (80, "good"), (70, "acceptable"), (60, "needs improvement"))
#: Characters under which a rewritten text is too short, and the score of one that is short or stutters.
SHORT = 100
POOR = 30.0


def style_tokens(c: Column, profile: ScriptProfile = LATIN) -> Column:
    """Runs of the script, of ASCII letters, or numbers with a decimal part."""
    return F.regexp_extract_all(c, F.lit(rf"[{profile.block}]+|[A-Za-z]+|{NUMBER_SIMPLE}"), F.lit(0))


def fact_tokens(c: Column, profile: ScriptProfile = LATIN) -> Column:
    """F23 with decimal parts: tokens with a digit, and others of more than 2 characters that are no stop words."""
    return F.filter(style_tokens(c, profile), lambda w: ~w.isin(*profile.stopwords) & (w.rlike(r"\p{Nd}") | (F.length(w) > 2)))


def numbered(a: Column) -> Column:
    """The occurrences of an array of strings, sorted: each string with its number among its equals, so multisets become sets."""

    def occurrences(s: Column) -> Column:
        heads = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (F.get(s, i - 1) != x), i).otherwise(F.lit(-1))), lambda i: i >= 0)
        return let(
            F.concat(heads, F.array(F.size(s))),
            lambda h: F.flatten(F.transform(F.slice(h, F.lit(1), F.size(h) - 1), lambda at, k: F.transform(F.sequence(F.lit(1), F.get(h, k + 1) - at), lambda n: F.concat(F.get(s, at), F.lit("\x01"), n.cast("string"))))),
        )

    return let(F.sort_array(a), occurrences)


def surplus(a: Column, b: Column) -> Column:
    """The distinct strings, sorted, that a holds more often than b."""
    return F.array_sort(F.array_distinct(F.transform(F.array_except(numbered(a), numbered(b)), lambda x: F.substring_index(x, "\x01", 1))))


def _percent(part: Column, whole: Column) -> Column:
    return 100.0 * part / whole


def number_score(original: Column, rewritten: Column) -> Column:
    """Share of the original's numbers that are kept; 100 without any."""
    return F.when(F.size(original) == 0, 100.0).otherwise(_percent(multiset_common(original, rewritten), F.greatest(F.size(original), F.lit(1))))


def extra_number_score(original: Column, rewritten: Column) -> Column:
    """100, less twice the share of the rewritten text's numbers that the original has not or less often."""
    extra = F.size(rewritten) - multiset_common(original, rewritten)
    return F.when(F.size(rewritten) == 0, 100.0).otherwise(F.greatest(F.lit(0.0), 100.0 - 2 * _percent(extra, F.greatest(F.size(rewritten), F.lit(1)))))


def length_score(original: Column, rewritten: Column) -> Column:
    """100 at equal length; twice as steep between 0.6 and 1.4 of the original's length as beyond; 0 for an empty original."""
    ratio = F.length(rewritten) / F.greatest(F.length(original), F.lit(1))
    slope = F.when((ratio >= 0.60) & (ratio <= 1.40), 200.0).otherwise(100.0)
    return F.when(F.length(original) == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 100.0 - F.abs(ratio - 1.0) * slope))


def quality_score(rewritten: Column, tokens: Column) -> Column:
    """0 if empty; POOR if short, or if three words are repeated by the next three at three places or more; else 100."""
    poor = (F.length(rewritten) < SHORT) | ((F.size(tokens) >= 8) & (stutters(tokens) >= 3))
    return F.when(rewritten == "", 0.0).when(poor, POOR).otherwise(100.0)


def with_style_scores(pairs, original: str, rewritten: str, profile: ScriptProfile = LATIN):
    """pairs and F49, F50: numbers, facts, content_similarity, length, quality and overall (unrounded), the verbatim flag, and the distinct missing and extra numbers and missing facts,
    sorted. Null texts count as empty."""
    columns = pairs.columns
    p = pairs.withColumns({"_o": scoring_text(text_or_empty(F.col(original))), "_r": scoring_text(text_or_empty(F.col(rewritten)))})
    o, r = F.col("_o"), F.col("_r")
    p = p.withColumns({"_no": numbers(o, NUMBER_SIMPLE), "_nr": numbers(r, NUMBER_SIMPLE), "_fo": fact_tokens(o, profile), "_fr": fact_tokens(r, profile), "_tr": style_tokens(r, profile)})
    no, nr, fo, fr = (F.col(c) for c in ("_no", "_nr", "_fo", "_fr"))
    p = p.withColumns(
        {
            "numbers": KEPT_NUMBERS * number_score(no, nr) + (1 - KEPT_NUMBERS) * extra_number_score(no, nr),
            "facts": number_score(fo, fr),
            "content_similarity": 100.0 * char_cosine(3, short=False)(o, r),
            "length": length_score(o, r),
            "quality": quality_score(r, F.col("_tr")),
            "verbatim": o == r,
            "missing_numbers": surplus(no, nr),
            "extra_numbers": surplus(nr, no),
            "missing_facts": surplus(fo, fr),
        }
    )
    overall = sum((w * F.col(name) for name, w in WEIGHTS.items()), F.lit(0.0))
    new = [*WEIGHTS, "overall", "verbatim", "missing_numbers", "extra_numbers", "missing_facts"]
    return p.withColumn("overall", overall).select(*(c for c in columns if c not in new), *new)


def tier(score: Column) -> Column:
    """A22."""
    out = F.lit("poor")
    for least, name in reversed(TIERS):
        out = F.when(score >= least, name).otherwise(out)
    return out
