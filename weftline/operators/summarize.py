"""Extractive summaries: documents to their best sentences.

A sentence's score depends on its own document only, so scores are found inside the row, over Arrow batches: words become numbers there, and counts
by document, sentence and word are sorted numbers. No word is a row, and nothing is shuffled. TextRank and MMR need a document's whole sentence
matrix; blocks of rows of the matrix bound the memory of long documents.

All methods share one contract: a document of at most n sentences is returned whole; else the n sentences of the highest score, ties to the
earlier one, stand in their order in the text.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ..functions import text as T
from ..functions.metrics import _lists, _parts
from ..functions.profiles import LATIN, ScriptProfile
from ..sources.shared import spread


def pick(scored: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """Key and summary of rows of key, s (sentences) and r (their scores). Ranks go by scores rounded to 9 places."""
    ranked = F.array_sort(F.transform("r", lambda x, k: F.struct((-F.round(F.coalesce(x, F.lit(0.0)), 9)).alias("low"), k.alias("k"))))
    best = F.array_sort(F.transform(F.slice(ranked, 1, n), lambda x: x["k"]))
    chosen = T.let(F.struct("s", best.alias("k")), lambda x: F.transform(x["k"], lambda k: F.get(x["s"], k)))
    return scored.select(key, F.array_join(F.when(F.size("s") <= n, F.col("s")).otherwise(chosen), " ").alias("summary"))


class Words:
    """The words of a range of rows of a column of sentences, each an array of words: by word its number (w), sentence (k) and row (d)."""

    def __init__(self, rows: pa.Array, more: pa.Array | None = None):
        sentences = rows.flatten()
        self.total = pc.list_value_length(rows).to_numpy(zero_copy_only=False)
        self.of = np.repeat(np.arange(len(rows)), self.total)
        self.size = pc.list_value_length(sentences).to_numpy(zero_copy_only=False)
        names = pa.concat_arrays([sentences.flatten(), *([more.flatten()] if more is not None else [])]).dictionary_encode()
        number = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.names, self.many = names.dictionary, max(len(names.dictionary), 1)
        self.k = np.repeat(np.arange(len(sentences)), self.size)
        self.d = self.of[self.k]
        self.w, self.more = number[: len(self.k)], number[len(self.k) :]

    def by_word(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct (row, word), row times `many` plus word, and by word the place of its own among them."""
        return np.unique(self.d * self.many + self.w, return_inverse=True)


def _pieces(rows: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about as many words as fit at once."""
    at = rows.offsets.to_numpy() if len(rows) else np.zeros(1, np.int64)
    ends = np.append(0, np.cumsum(pc.list_value_length(rows.values).to_numpy(zero_copy_only=False)))
    return _parts(np.diff(ends[at]))


def _scored(rows: pa.Array, score: Callable) -> pa.Array:
    rows = _lists(rows)
    out = [np.zeros(0)]
    for low, high in _pieces(rows):
        out.append(score(low, high, rows.slice(low, high - low)))
    sizes = pc.list_value_length(rows).to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(np.concatenate(out)))


def _by_sentence(x: Words, value: np.ndarray, k: np.ndarray, root: bool) -> np.ndarray:
    size = np.maximum(x.size, 1)
    return np.bincount(k, value, len(x.size)) / (np.sqrt(size) if root else size)


@arrow_udf(ArrayType(DoubleType()))
def tfidf_score(words: pa.Array) -> pa.Array:
    """Mean idf of a sentence's words, case kept; idf over the document's sentences is ln((N + 1) / (df + 1)) + 1."""

    def score(low: int, high: int, rows: pa.Array) -> np.ndarray:
        x = Words(rows)
        names, at = x.by_word()
        pairs = np.unique(x.k * len(names) + at)
        df = np.bincount(pairs % max(len(names), 1), minlength=len(names))
        idf = np.log((x.total[names // x.many] + 1) / (df + 1)) + 1
        return _by_sentence(x, idf[at], x.k, False)

    return _scored(words, score)


def rake_score(profile: ScriptProfile = LATIN) -> Callable:
    """Phrases are runs of words that are no stop words, over the whole text; a word scores (degree + frequency) / frequency."""

    @arrow_udf("array<double>")
    def scores(words: pa.Array, text: pa.Array) -> pa.Array:
        text = _lists(text)

        def score(low: int, high: int, rows: pa.Array) -> np.ndarray:
            whole = text.slice(low, high - low)
            x = Words(rows, whole)
            stop = pc.is_in(x.names, pa.array(profile.stopwords, x.names.type)).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(high - low), pc.list_value_length(whole).to_numpy(zero_copy_only=False))
            place = np.flatnonzero(~stop[x.more]) if len(x.more) else np.zeros(0, np.int64)
            row, word = row[place], x.more[place]
            new = np.append(True, (np.diff(place) > 1) | (np.diff(row) > 0))[: len(place)]
            run = np.cumsum(new) - 1
            length = np.bincount(run)[run] if len(run) else run
            names, at = np.unique(row * x.many + word, return_inverse=True)
            count = np.bincount(at, minlength=len(names))
            weight = (np.bincount(at, length - 1, len(names)) + count) / np.maximum(count, 1)
            key = x.d * x.many + x.w
            to = np.minimum(np.searchsorted(names, key), max(len(names) - 1, 0))
            found = np.where(names[to] == key, weight[to], 0.0) if len(names) else np.zeros(len(key))
            return _by_sentence(x, found, x.k, True)

        return _scored(words, score)

    return scores


def word_facts(x: Words) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """The distinct (row, word) and by word its own, as by_word() has them, and of each distinct one its occurrences (f), the upper median of its places
    in the row's running words, its distinct neighbours on the left (l) and right (r) within a sentence, and its sentences (s)."""
    names, at = x.by_word()
    many = len(names)
    f = np.bincount(at, minlength=many)
    order = np.argsort(at, kind="stable")  # places ascend within a word
    start = np.searchsorted(x.d, x.d, side="left")
    median = (np.arange(len(at)) - start)[order][np.append(0, np.cumsum(f))[:-1] + f // 2]
    same = x.k[1:] == x.k[:-1]

    def distinct(mine: np.ndarray, other: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(np.unique(mine * max(width, 1) + other) // max(width, 1), minlength=many)

    left, right = distinct(at[1:][same], x.w[:-1][same], x.many), distinct(at[:-1][same], x.w[1:][same], x.many)
    return names, at, {"f": f, "median": median, "l": left, "r": right, "s": distinct(at, x.k, len(x.size))}


@arrow_udf(ArrayType(DoubleType()))
def yake_score(words: pa.Array) -> pa.Array:
    """T4: position, frequency, neighbours and spread of each word; a sentence sums the inverse scores of its distinct words."""

    def score(low: int, high: int, rows: pa.Array) -> np.ndarray:
        x = Words(rows)
        names, at, facts = word_facts(x)
        f, row = facts["f"], names // x.many
        n = np.maximum(np.bincount(row, minlength=high - low), 1)
        mean = np.bincount(row, f, high - low) / n
        std = np.sqrt(np.bincount(row, (f - mean[row]) ** 2, high - low) / n)
        most = np.zeros(high - low)
        np.maximum.at(most, row, f)
        rel = 1 + (facts["l"] / f + facts["r"] / f) * (f / most[row])
        freq = f / (mean + std + 1e-6)[row]
        weight = 1 / (rel * np.log(facts["median"] + 2.0) / (1 + freq / rel + facts["s"] / x.total[row] / rel) + 1e-4)
        pairs = np.unique(x.k * max(len(names), 1) + at)
        return _by_sentence(x, weight[pairs % max(len(names), 1)], pairs // max(len(names), 1), True)

    return _scored(words, score)


#: Of a word: itself, its occurrences, its median place, its neighbours on both sides, its sentences.
FACTS = StructType([StructField("word", StringType()), *(StructField(c, LongType()) for c in ("n", "median_pos", "left_words", "right_words", "n_sentences"))])


@arrow_udf(ArrayType(FACTS))
def frequent_words(words: pa.Array) -> pa.Array:
    """The facts of each word that stands 5 times or more in a document."""
    words, out, sizes = _lists(words), [], [np.zeros(0, np.int64)]
    for low, high in _pieces(words):
        x = Words(words.slice(low, high - low))
        names, _, facts = word_facts(x)
        on = np.flatnonzero(facts["f"] >= 5)
        sizes.append(np.bincount(names[on] // x.many, minlength=high - low))
        columns = [x.names.take(pa.array(names[on] % x.many)), *(pa.array(facts[c][on].astype(np.int64)) for c in ("f", "median", "l", "r", "s"))]
        out.append(pa.StructArray.from_arrays(columns, ["word", "n", "median_pos", "left_words", "right_words", "n_sentences"]))
    values = pa.concat_arrays(out) if out else pa.array([], pa.struct([("word", pa.string()), *((c, pa.int64()) for c in ("n", "median_pos", "left_words", "right_words", "n_sentences"))]))
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.concatenate(sizes))), pa.int32()), values)


#: Pairs of sentences, or of their words, that are looked at together.
PAIRS_AT_ONCE = 1 << 21


def _chunks(work: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about PAIRS_AT_ONCE of work; an entry of more is a range of its own."""
    upto, start = np.cumsum(work), 0
    while start < len(work):
        end = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + PAIRS_AT_ONCE, side="right")))
        yield start, end
        start = end


def _expanded(first: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of `many` places from `first` on, laid out: the number of the range and the place."""
    of = np.repeat(np.arange(len(many)), many)
    return of, first[of] + np.arange(len(of)) - (np.cumsum(many) - many)[of]


def _alike(x: Words, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs i < j of sentences of one row whose bags of words have a cosine of `least` or more, and the cosine; in order."""
    names, at = x.by_word()
    many, sentences = max(len(names), 1), len(x.size)
    key, c = np.unique(x.k * many + at, return_counts=True)
    k, w = key // many, key % many
    from_, size = np.searchsorted(k, np.arange(sentences)), np.bincount(k, minlength=sentences)
    square = np.bincount(k, c * c, sentences)
    df = np.bincount(w, minlength=many)
    order = np.lexsort((w, df[w], k))
    upto = np.cumsum((c * c)[order])
    behind = upto[np.maximum(from_ + size - 1, 0)][k] if len(k) else upto  # the sum at the sentence's end
    rest = behind - upto + (c * c)[order]
    heads = order[(rest >= least * least * square[k] - 1e-9) & (df[w[order]] > 1)]
    heads = heads[np.lexsort((k[heads], w[heads]))]
    hk, hw = k[heads], w[heads]
    partners = np.searchsorted(hw, hw, side="right") - np.arange(len(hw)) - 1
    turn = np.argsort(hk, kind="stable")
    by_sentence = np.bincount(hk, partners, sentences).astype(np.int64)
    start = np.searchsorted(hk[turn], np.arange(sentences + 1))
    for low, high in _chunks(by_sentence):
        mine = turn[start[low] : start[high]]
        of, place = _expanded(mine + 1, partners[mine])
        pair = np.unique(hk[mine][of] * sentences + hk[place])
        i, j = pair // sentences, pair % sentences
        for a, b in _chunks(size[i]):
            of, place = _expanded(from_[i[a:b]], size[i[a:b]])
            wanted = j[a:b][of] * many + w[place]
            found = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
            hit = key[found] == wanted
            dot = np.bincount(of[hit], (c[place] * c[found])[hit], b - a)
            cosine = dot / (np.sqrt(square[i[a:b]]) * np.sqrt(square[j[a:b]]))
            on = cosine >= least
            yield i[a:b][on], j[a:b][on], cosine[on]


def similar_sentences(least: float) -> Callable:
    """The pairs i < j of a document's sentences, each an array of words, with a cosine of `least` or more.

    A sentence's words are put in the order of how few of the document's sentences have them. Behind the place where what follows has under
    `least` of the sentence's norm, no word can be the first that a pair has in common, so only the words up to there bring sentences
    together; that leaves out the frequent words and loses no pair. No word and no candidate is a row.
    """

    @arrow_udf("array<struct<i:int,j:int,cosine:double>>")
    def pairs(words: pa.Array) -> pa.Array:
        words, out, sizes = _lists(words), [], [np.zeros(0, np.int64)]
        for low, high in _pieces(words):
            x = Words(words.slice(low, high - low))
            first = np.cumsum(x.total) - x.total
            size = np.zeros(high - low, np.int64)
            for i, j, cosine in _alike(x, least):
                size += np.bincount(x.of[i], minlength=high - low)
                out.append((i - first[x.of[i]], j - first[x.of[j]], cosine))
            sizes.append(size)
        i, j, cosine = (np.concatenate([z[c] for z in out]) if out else np.zeros(0) for c in range(3))
        values = pa.StructArray.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(cosine)], ["i", "j", "cosine"])
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.concatenate(sizes))), pa.int32()), values)

    return pairs


def _counts(text: str) -> dict[str, int]:
    """Grapheme counts of a text; most texts have no combining marks, and then their graphemes are their characters."""
    counts = Counter(text)
    if any(unicodedata.combining(c) for c in counts):
        clusters: list[str] = []
        for c in text:
            if clusters and unicodedata.combining(c):
                clusters[-1] += c
            else:
                clusters.append(c)
        counts = Counter(clusters)
    return {g: n for g, n in counts.items() if g.strip()}


def _vectors(texts: list[str]) -> np.ndarray:
    """TF-IDF vectors of the graphemes of texts, of length 1 unless empty."""
    names: dict = {}
    rows, columns, values = [], [], []
    for k, text in enumerate(texts):
        counts = _counts(text)
        total = sum(counts.values())
        for t, c in counts.items():
            rows.append(k)
            columns.append(names.setdefault(t, len(names)))
            values.append(c / total)
    x = np.zeros((len(texts), max(len(names), 1)))
    x[rows, columns] = values
    x *= np.log((len(texts) + 1) / ((x > 0).sum(axis=0) + 1)) + 1
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def _rank(x: np.ndarray, damping: float = 0.85, rounds: int = 100, settled: float = 1e-6, block: int = 2048) -> np.ndarray:
    """TextRank scores of unit vectors x, whose products are the similarities. The matrix is never whole in memory: each round multiplies
    through the vectors, and the diagonal is taken out."""
    n = len(x)
    own = (x * x).sum(axis=1)
    sums = x @ x.sum(axis=0) - own
    sums = np.where(sums > 0, sums, 1.0)
    scores = np.full(n, 1 / n)
    for _ in range(rounds):
        share = scores / sums
        spread = x @ (x.T @ share) - own * share
        new = (1 - damping) / n + damping * spread
        if np.abs(new - scores).max() < settled:
            break
        scores = new
    return scores


@pandas_udf(ArrayType(DoubleType()))
def textrank_score(sentences: pd.Series) -> pd.Series:
    """A score for each of a document's sentences. The scores before the last round are returned when it settles."""
    return pd.Series([_rank(_vectors(list(doc))).tolist() if doc is not None and len(doc) else [] for doc in sentences])


def _mmr(x: np.ndarray, target: np.ndarray, n: int, diversity: float) -> list[int]:
    relevance = x @ target
    chosen = [int(relevance.argmax())]
    nearest = x @ x[chosen[0]]
    while len(chosen) < min(n, len(x)):
        score = (1 - diversity) * relevance - diversity * nearest
        score[chosen] = -np.inf
        chosen.append(int(score.argmax()))
        nearest = np.maximum(nearest, x @ x[chosen[-1]])
    return sorted(chosen)


def mmr_choice(n: int, diversity: float = 0.5):
    """T5: places of the chosen sentences; the first is the nearest to the whole text, the others trade nearness against likeness to those
    chosen before. Takes the sentences and the text."""

    @pandas_udf(ArrayType(IntegerType()))
    def choose(sentences: pd.Series, whole: pd.Series) -> pd.Series:
        out = []
        for s, w in zip(sentences, whole, strict=True):
            if s is None or not len(s):
                out.append([])
                continue
            x = _vectors([*s, w])
            out.append(_mmr(x[:-1], x[-1], n, diversity))
        return pd.Series(out)

    return choose


def sentence_words(s: Column, lower: bool = True) -> Column:
    return F.transform(s, lambda x: T.word_tokens(F.lower(x) if lower else x))


def _by_score(score: Callable) -> Callable:
    """A method whose scores come from the column of sentences `s` and the text."""

    def run(docs: DataFrame, n: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
        s = docs.select(key, F.col(text).alias("_text"), T.sentences(F.col(text)).alias("s")).where(F.size("s") > 0)
        return pick(s.select(key, "s", score(F.col("s"), F.col("_text")).alias("r")), n, key)

    return run


textrank = _by_score(lambda s, text: textrank_score(s))


def mmr(docs: DataFrame, n: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    s = docs.select(key, F.col(text).alias("_text"), T.sentences(F.col(text)).alias("s")).where(F.size("s") > 0)
    chosen = s.select(key, "s", F.when(F.size("s") > n, mmr_choice(n)("s", "_text")).alias("c"))
    return chosen.select(key, F.array_join(F.when(F.col("c").isNull(), F.col("s")).otherwise(F.transform("c", lambda i: F.get("s", i))), " ").alias("summary"))


METHODS: dict[str, Callable] = {
    "tfidf": _by_score(lambda s, text: tfidf_score(sentence_words(s, lower=False))),
    "textrank": textrank,
    "rake": _by_score(lambda s, text: rake_score()(sentence_words(s), T.word_tokens(F.lower(text)))),
    "yake": _by_score(lambda s, text: yake_score(sentence_words(s))),
    "keybert": mmr,
}


def summarize(docs: DataFrame, method: str = "textrank", n: int = 3, **names) -> DataFrame:
    """By a method's name, with or without the prefix extractive_; an unknown one means TextRank."""
    rows = docs.select(names.get("key", "doc_id"), names.get("text", "text"))
    return METHODS.get(method.removeprefix("extractive_"), textrank)(spread(rows), n, **names)
