"""Row-level quality rules as reason columns: one pass gives the filter and its statistics."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.profiles import LATIN, ScriptProfile

#: Length buckets of summaries: bounds of the ratio to the article, and most words.
BUCKETS = (("short", 0.04, 0.18, 45), ("medium", 0.12, 0.32, 80), ("long", 0.22, 0.55, 130))
#: Bounds of the train-time filter: bucket, least and largest ratio, most tokens.
TRAIN_BUCKETS = (("short", 0.04, 0.18, 70), ("medium", 0.12, 0.32, 120), ("long", 0.22, 0.55, 190))
LEAST_SUMMARY_WORDS = 8
#: Numbers that a summary may hold though its article does not.
FREE_NUMBERS = ("10", "20", "35", "1", "2", "3")
SERIOUS = (
    "empty", "too_short", "too_short_relative_to_source", "possible_truncation", "missing_source_number", "low_script_ratio", "word_repetition",
    "phrase_repetition", "markdown_artifact", "meta_text", "forced_phrase",
)


def first_reason(*rules: tuple[Column, Column | str], default: Column | str | None = None) -> Column:
    """The reason of the first rule whose condition holds, in order; `default` if none does."""
    out = F.lit(None).cast("string") if default is None else F.lit(default) if isinstance(default, str) else default
    for condition, reason in reversed(rules):
        out = F.when(condition, F.lit(reason) if isinstance(reason, str) else reason).otherwise(out)
    return out


def article_reason(title: Column, content: Column, profile: ScriptProfile = LATIN, *, content_chars: tuple[int, int] = (300, 10_000), title_chars: tuple[int, int] = (10, 200), least_script: float = 0.30) -> Column:
    """Why an article is rejected, or 'ok'. Bounds are inclusive."""
    title, content = T.text_or_empty(title), T.text_or_empty(content)
    return first_reason(
        ((title == "") | (content == ""), "missing_field"),
        (F.length(content) < content_chars[0], "content_too_short"),
        (F.length(content) > content_chars[1], "content_too_long"),
        (F.length(title) < title_chars[0], "title_too_short"),
        (F.length(title) > title_chars[1], "title_too_long"),
        (T.script_ratio(content, profile) < least_script, "content_not_in_script"),
        (T.script_ratio(title, profile) < least_script, "title_not_in_script"),
        default="ok",
    )


def summary_text(summary: Column) -> Column:
    """A summary without a number or label in front."""
    return T.trim_ws(F.regexp_replace(T.trim_ws(T.text_or_empty(summary)), r"(?i)^(?:[0-9]+[.)]|short:|medium:|long:)\s*", ""))


def summary_reason(summary: Column, article: Column, bucket: str, profile: ScriptProfile = LATIN, *, glue_and_units: bool = True) -> Column:
    """Why a summary is rejected, or null. The older rule has neither glue nor units."""
    s, article = summary_text(summary), T.text_or_empty(article)
    glue = T.word_glue(s, profile) if glue_and_units else None
    units = T.unit_mismatch(T.number_units(s, profile), T.number_units(article, profile)) if glue_and_units else None
    return _summary_reason(s, T.word_count(s), T.word_count(article), _new_numbers(s, T.numbers(article, T.NUMBER_PLAIN)), glue, units, bucket, profile)


def with_summary_reasons(rows: DataFrame, buckets: tuple[str, ...], article: str, profile: ScriptProfile = LATIN) -> DataFrame:
    """P9 for summaries in columns named by bucket: rows with reason_<bucket>.

    What the rules ask of a text is a column of its own first, so that no pattern runs twice over an article.
    """
    text = T.text_or_empty(F.col(article))
    facts = rows.withColumns({"_m": T.word_count(text), "_numbers": T.numbers(text, T.NUMBER_PLAIN), "_units": T.number_units(text, profile), **{f"_s_{b}": summary_text(F.col(b)) for b in buckets}})
    each = {}
    for b in buckets:
        s = F.col(f"_s_{b}")
        each |= {f"_n_{b}": T.word_count(s), f"_x_{b}": _new_numbers(s, F.col("_numbers")), f"_g_{b}": T.word_glue(s, profile), f"_u_{b}": T.unit_mismatch(T.number_units(s, profile), F.col("_units"))}
    facts = facts.withColumns(each)
    out = facts.withColumns({f"reason_{b}": _summary_reason(*(F.col(f"_{c}_{b}") if c != "m" else F.col("_m") for c in "snmxgu"), b, profile) for b in buckets})
    return out.drop("_m", "_numbers", "_units", *(f"_{c}_{b}" for c in "snxgu" for b in buckets))


def _new_numbers(summary: Column, article_numbers: Column) -> Column:
    return F.sort_array(F.array_except(F.array_except(F.array_distinct(T.numbers(summary, T.NUMBER_PLAIN)), article_numbers), F.array(*map(F.lit, FREE_NUMBERS))))


def _summary_reason(s: Column, n: Column, m: Column, extra: Column, glue: Column | None, units: Column | None, bucket: str, profile: ScriptProfile) -> Column:
    """The rules in order; n and m are the words of summary and article, extra the numbers that only the summary has."""
    _, low, high, most = next(b for b in BUCKETS if b[0] == bucket)
    cap = F.greatest(F.lit(most), F.floor(m * high + 15))
    ratio = F.coalesce(F.try_divide(n, m), F.lit(0.0))
    bound = F.when(m < 100, F.least(F.lit(0.85), high + 0.25 * (1 - m / 100))).otherwise(high)
    rules = [
        (s == "", "empty"),
        (F.contains(s, F.lit("�")), "replacement_char"),
        (F.startswith(s, F.lit("#")) | F.contains(s, F.lit("\n#")), "markdown_header"),
        (s.rlike(r"^\p{M}"), "leading_combining_mark"),
        *((F.contains(s, F.lit(p)), f"meta_commentary:{p}") for p in profile.meta_patterns),
        (n < LEAST_SUMMARY_WORDS, "too_short"),
        (n > cap, F.concat(F.lit("over_word_cap:"), n.cast("string"), F.lit(">"), cap.cast("string"))),
        ((ratio < low) | (ratio > bound), "ratio_out_of_band"),
        (F.size(extra) > 0, F.concat(F.lit("hallucinated_numbers:"), F.array_join(F.slice(extra, 1, 3), ","))),
    ]
    rules += [(c.isNotNull(), c) for c in (glue, units) if c is not None]
    return first_reason(*rules)


def find_defect(summaries: dict[str, Column], article: Column, profile: ScriptProfile = LATIN) -> Column:
    """The first bucket's glue, else the first bucket's unit mismatch, as bucket:reason; null if none."""
    units = T.number_units(article, profile)
    reasons = [F.concat(F.lit(f"{b}:"), T.word_glue(c, profile)) for b, c in summaries.items()]
    reasons += [F.concat(F.lit(f"{b}:"), T.unit_mismatch(T.number_units(c, profile), units)) for b, c in summaries.items()]
    return F.coalesce(*reasons)


def keeps_numbers(original: Column, rewritten: Column) -> Column:
    """Whether every number of the first array stands at least as often in the second."""
    # Both are sorted, and each number takes its count along as a suffix: what is left of a multiset are then plain sets.
    return F.size(F.array_except(_numbered(original), _numbered(rewritten))) == 0


def _numbered(xs: Column) -> Column:
    """Each element of an array with how many equal ones come before it: 'x#1', 'x#2' and so on."""
    return T.let(F.sort_array(xs), lambda ordered: F.transform(ordered, lambda x, k: F.concat(x, F.lit("#"), (k + 2 - F.array_position(ordered, x)).cast("string"))))


def with_rewrite_issues(rows: DataFrame, original: str, rewritten: str, word_repeat: str, phrase_repeat: str, profile: ScriptProfile = LATIN) -> DataFrame:
    """Rows with `issues`, the sorted set of issues of a rewrite. The two repetition flags come from their own operators.

    Normalised texts, their numbers and what is asked of them more than once are bound: a filter on the issues, which is pushed below, would else
    put their patterns in the place of each use.
    """

    def found(x: Column) -> Column:
        a, b, low, ratio = (x[c] for c in ("a", "b", "low", "ratio"))

        def any_of(phrases: tuple[str, ...]) -> Column:
            return reduce(lambda x, y: x | y, (F.contains(low, F.lit(p.lower())) for p in phrases), F.lit(False))

        rules = [
            (F.length(b) < 50, "too_short"),
            (ratio < 0.55, "too_short_relative_to_source"),
            (ratio > 1.80, "too_long"),
            (T.letter_ratio(b, profile) < 0.60, "low_script_ratio"),
            (T.looks_truncated(a, b, profile), "possible_truncation"),
            (~keeps_numbers(T.numbers(a), T.numbers(b)), "missing_source_number"),
            (F.col(word_repeat), "word_repetition"),
            (F.col(phrase_repeat), "phrase_repetition"),
            (F.contains(b, F.lit("```")), "markdown_artifact"),
            (F.startswith(b, F.lit("#")), "markdown_heading"),
            (any_of(profile.meta_patterns), "meta_text"),
            (any_of(profile.forced_phrases), "forced_phrase"),
        ]
        return F.when(b == "", F.array(F.lit("empty"))).otherwise(F.sort_array(F.array_compact(F.array(*(F.when(c, F.lit(r)) for c, r in rules)))))

    def measured(t: Column) -> Column:
        more = F.struct(t["a"].alias("a"), t["b"].alias("b"), F.lower(t["b"]).alias("low"), (F.length(t["b"]) / F.greatest(F.length(t["a"]), F.lit(1))).alias("ratio"))
        return T.let(more, found)

    texts = F.struct(T.style_text(F.col(original)).alias("a"), T.style_text(F.col(rewritten)).alias("b"))
    return rows.withColumn("issues", T.let(texts, measured))


def is_serious(issues: Column) -> Column:
    return F.arrays_overlap(issues, F.array(*map(F.lit, SERIOUS)))


def composite(column: Column) -> tuple[Column, Column]:
    """Category and body of 'Category: X\\nArticle: body'; the category is General without the label."""
    category = F.regexp_extract(column, r"^Category: *([^\n]*)", 1)
    body = F.regexp_extract(column, r"(?s)(?:^|\n)Article: *(.*)$", 1)
    return F.when(category == "", "General").otherwise(category), F.when(body == "", column).otherwise(body)


def is_failed(status: Column, error: Column, text: Column) -> Column:
    """P7."""
    return (F.coalesce(F.lower(status), F.lit("")) == "failed") | (T.text_or_empty(error) != "") | (T.trim_ws(T.text_or_empty(text)) == "")


def escaped(names: tuple[str, ...]) -> str:
    return "|".join(map(re.escape, names))
