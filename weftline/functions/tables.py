"""Extractive summaries as a table function for SQL:

    SELECT * FROM summary_rows(TABLE(SELECT doc_id, text FROM documents) PARTITION BY (doc_id), 'extractive_rake', 3)

The first column of the table is the key, the second the text; a document may come in several rows, which are joined by line breaks in the order
that ORDER BY gives. Spark deals documents to tasks; the function holds one document at a time. Scores are those of operators.summarize.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..operators.summarize import _mmr, _rank, _vectors
from .profiles import LATIN
from .text import SENTENCE_LEAST


def sentences(text: str) -> list[str]:
    return [s for s in (p.strip() for p in re.split(r"(?<=[.!?])\s+", text.strip())) if len(s) >= SENTENCE_LEAST]


def tokens(text: str) -> list[str]:
    return re.findall(rf"[\w{LATIN.block}]+", text)


def tfidf(parts: list[str], text: str) -> list[float]:
    words = [tokens(s) for s in parts]
    df = Counter(w for ws in words for w in set(ws))
    return [sum(math.log((len(parts) + 1) / (df[w] + 1)) + 1 for w in ws) / len(ws) if ws else 0.0 for ws in words]


def rake(parts: list[str], text: str) -> list[float]:
    stop, run = set(LATIN.stopwords), []
    degree, count = Counter(), Counter()
    for w in [*tokens(text.lower()), None]:
        if w is not None and w not in stop:
            run.append(w)
            continue
        for x in run:
            degree[x] += len(run) - 1
            count[x] += 1
        run = []
    words = [tokens(s.lower()) for s in parts]
    return [sum((degree[w] + count[w]) / count[w] for w in ws if count[w]) / math.sqrt(len(ws)) if ws else 0.0 for ws in words]


def yake(parts: list[str], text: str) -> list[float]:
    words = [tokens(s.lower()) for s in parts]
    places, left, right, spread = (defaultdict(list), defaultdict(set), defaultdict(set), defaultdict(set))
    at = 0
    for k, ws in enumerate(words):
        for i, w in enumerate(ws):
            places[w].append(at)
            spread[w].add(k)
            if i:
                left[w].add(ws[i - 1])
            if i + 1 < len(ws):
                right[w].add(ws[i + 1])
            at += 1
    if not places:
        return [0.0] * len(parts)
    often = np.array([len(p) for p in places.values()])
    mean, std, most = often.mean(), often.std(), often.max()

    def weight(w: str) -> float:
        f = len(places[w])
        related = 1 + (len(left[w]) / f + len(right[w]) / f) * (f / most)
        score = related * math.log(places[w][f // 2] + 2.0) / (1 + f / (mean + std + 1e-6) / related + len(spread[w]) / len(parts) / related)
        return 1 / (score + 1e-4)

    weights = {w: weight(w) for w in places}
    return [sum(weights[w] for w in set(ws)) / math.sqrt(len(ws)) if ws else 0.0 for ws in words]


def textrank(parts: list[str], text: str) -> list[float]:
    return _rank(_vectors(parts)).tolist()


SCORES = {"tfidf": tfidf, "rake": rake, "yake": yake, "textrank": textrank}


def summary(text: str, method: str, n: int) -> str:
    """The n best sentences in their order; an unknown method means TextRank."""
    parts = sentences(text)
    if len(parts) <= n:
        return " ".join(parts)
    method = method.removeprefix("extractive_")
    if method == "keybert":
        x = _vectors([*parts, text])
        chosen = _mmr(x[:-1], x[-1], n, 0.5)
    else:
        scores = SCORES.get(method, textrank)(parts, text)
        chosen = sorted(sorted(range(len(parts)), key=lambda k: (-round(scores[k], 9), k))[:n])
    return " ".join(parts[k] for k in chosen)


class Summaries:
    """key and summary of each document of more than no sentence."""

    def __init__(self):
        self.key, self.text, self.method, self.n = None, [], "textrank", 3

    @staticmethod
    def analyze(table: AnalyzeArgument, method: AnalyzeArgument, n: AnalyzeArgument) -> AnalyzeResult:
        fields = table.dataType.fields if table.isTable else []
        if len(fields) < 2 or fields[1].dataType != StringType():
            raise ValueError("summary_rows takes a table of a key and a text")
        if not method.isConstantExpression or not n.isConstantExpression or n.value is None or n.value < 1:
            raise ValueError("summary_rows takes a method's name and a number of sentences of at least 1")
        return AnalyzeResult(StructType([fields[0], StructField("summary", StringType())]))

    def eval(self, table, method: str, n: int) -> None:
        self.key, self.method, self.n = table[0], method or "", n
        if table[1] is not None:
            self.text.append(table[1])

    def terminate(self):
        out = summary("\n".join(self.text), self.method, self.n)
        if out:
            yield self.key, out


def register(spark: SparkSession) -> None:
    spark.udtf.register("summary_rows", udtf(Summaries))
