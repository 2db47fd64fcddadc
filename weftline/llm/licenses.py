"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them. Spark SQL functions only.

Templates and texts are five-word shingles. A window is a stretch of consecutive shingles, one beginning at every word; its length is the
largest of WINDOWS that the template has, so a window that lines up with the template differs from it only where the text does. A
window's signature has BANDS minima of one row each: a stretch of which the template contains 0.8, in a row, has a Jaccard similarity of
2/3 or more with it, and is retrieved with a probability of 1 - (1/3)^BANDS, over 0.9998. What was retrieved is then laid on the
template where the windows met, each such place once, and the share of the template's shingles found there is counted exactly: from the
text's shingles that stand in a template, each counted for the places that it lies in, so no row carries a whole text.

Every match holds most of the template's shingles, and so one of a few long words that stand in many of them: texts with none of these
words are dropped first, which loses no match.

Defined results: words are runs outside `[\\x20\\x09-\\x0D]` of the lower-case text. A null text, and one under five words, matches nothing.
A text of any length is read whole; what is sent of it grows with its notices. Per document and template the largest containment counts, of
equal ones at its first place. Rows that repeat a doc_id are matched each, and the best match of each template counts. An empty table gives an
empty result. Extra columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let
from ._shared import BLANKS, table

SHINGLE = 5
CONTAINMENT = 0.8
BANDS = 8
WINDOWS = (1, 3, 7, 12)

# Notices by which works name their licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def with_shingles(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows with a column shingles: the hashes of the text's five-word shingles, in order; empty for fewer words."""
    words = F.filter(F.split(F.lower(text), BLANKS), lambda w: w != "")

    def hashed(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(w) - SHINGLE + 1), lambda i: F.xxhash64(F.array_join(F.slice(w, i, F.lit(SHINGLE)), " ")))
        return F.when(F.size(w) >= SHINGLE, each).otherwise(F.array().cast("array<bigint>"))

    return rows.withColumn("shingles", let(words, hashed))


def _bands(shingles: Column) -> Column:
    """The shingles' hashes under each band's function, as an array of arrays."""
    return F.array(*(F.transform(shingles, _seeded(j)) for j in range(BANDS)))


def _seeded(band: int):
    return lambda s: F.xxhash64(s, F.lit(band))


def _minimum(bands: Column, band: int, start: Column, size: int) -> Column:
    return F.array_min(F.slice(F.get(bands, F.lit(band)), start, F.lit(size)))


def _starts(shingles: Column, size: int) -> Column:
    """Where windows of `size` shingles begin, from 1."""
    return F.when(F.size(shingles) >= size, F.sequence(F.lit(1), F.size(shingles) - size + 1)).otherwise(F.array().cast("array<int>"))


def _retrieved(shingles: Column, bands: Column, size: int, band: int, wanted: list[int]) -> Column:
    """The windows whose minimum in a band is one of a template's: an array of (name, start)."""
    windows = F.transform(_starts(shingles, size), lambda i: F.struct(_minimum(bands, band, i, size).alias("minimum"), i.alias("start")))
    return F.transform(F.filter(windows, lambda w: w["minimum"].isin(wanted)), lambda w: F.struct(_window_name(F.lit(size), F.lit(band), w["minimum"]).alias("name"), w["start"].alias("start")))


def _template_rows(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    listed = F.array(*(F.struct(F.lit(name).alias("license"), F.lit(text).alias("text")) for name, text in templates.items()))
    return with_shingles(spark.range(1).select(F.inline(listed)))


def signature_words(templates: dict[str, str], containment: float = CONTAINMENT) -> list[str]:
    """Words of which every match holds one.

    A match may lack a share 1 - containment of a template's shingles, so words that stand in more shingles than that are enough: the
    longest ones, until they do.
    """
    out = set()
    for text in templates.values():
        words = text.lower().split()
        shingles = [set(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)]
        spare = int((1 - containment) * len(shingles) + 1e-9)
        for word in sorted(set(words), key=lambda w: (-len(w), w)):
            if not shingles or sum(bool(s & out) for s in shingles) > spare:
                break
            out.add(word)
    return sorted(out)


def scan(docs: DataFrame, *, templates: dict[str, str] | None = None, text: str = "text", key: str = "doc_id", containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, license, containment and first_word (from 0) of each template found in each document."""
    templates = templates or TEMPLATES
    spark = docs.sparkSession
    # Signatures of the templates' windows; a few rows, since the templates are a parameter of the job.
    known = _template_rows(spark, templates).where(F.size("shingles") > 0).withColumn("bands", _bands(F.col("shingles"))).persist()
    names = sorted(templates)
    wanted: dict[tuple[int, int], set[int]] = {}
    window_codes: dict[int, set[int]] = {}
    for size, larger in zip(WINDOWS, (*WINDOWS[1:], 1 << 30), strict=True):
        fits = known.where((F.size("shingles") >= size) & (F.size("shingles") < larger)).withColumn("at", F.explode(_starts(F.col("shingles"), size)))
        least = [_minimum(F.col("bands"), j, F.col("at"), size) for j in range(BANDS)]
        minima = [F.struct(m.alias("m"), _window_name(F.lit(size), F.lit(j), m).alias("name")) for j, m in enumerate(least)]
        for row in fits.select("license", "at", F.array(*minima).alias("minima")).collect():
            for j, (m, name) in enumerate(row["minima"]):
                wanted.setdefault((size, j), set()).add(m)
                window_codes.setdefault(name, set()).add(_code(names.index(row["license"])) - row["at"])
    lengths = {r["license"]: r["shingles"] for r in known.select("license", "shingles").collect()}
    known.unpersist()
    if not wanted:
        return docs.select(F.col(key).cast("long").alias("doc_id"), F.lit("").alias("license"), F.lit(0.0).alias("containment"), F.lit(0).alias("first_word")).limit(0)

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row"))
    rows = rows.where(F.lower(F.col("text")).rlike("|".join(map(re.escape, signature_words(templates, containment)))))
    # The shingles of any template, each with all codes of the stretches in which it then lies: as many as the template is long.
    shingle_codes: dict[int, set[int]] = {}
    for name, shingles in lengths.items():
        for s in shingles:
            shingle_codes.setdefault(s, set()).update(_code(names.index(name)) - d for d in range(len(shingles)))

    def retrieved(shingles: Column) -> Column:
        """Where templates begin whose windows share a band with the text's: codes of template and place, each once."""

        def laid(bands: Column) -> Column:
            hits = F.concat(*(_retrieved(shingles, bands, size, j, sorted(minima)) for (size, j), minima in sorted(wanted.items())))
            return F.array_distinct(F.flatten(F.transform(hits, lambda h: F.transform(_entries(window_codes, h["name"]), lambda base: base + h["start"]))))

        return let(_bands(shingles), laid)

    def inside(shingles: Column) -> Column:
        """The text's shingles that stand in a template, with the codes of all stretches in which they lie."""
        found = F.filter(F.transform(shingles, lambda s, i: F.struct(s.alias("s"), i.alias("i"))), lambda x: x["s"].isin(sorted(shingle_codes)))
        return F.flatten(F.transform(found, lambda x: F.transform(_entries(shingle_codes, x["s"]), lambda base: F.struct((base + x["i"]).alias("code"), x["s"].alias("shingle")))))

    def marked(shingles: Column) -> Column:
        def with_starts(codes: Column) -> Column:
            starts = F.transform(codes, lambda c: F.struct(c.alias("code"), F.lit(None).cast("long").alias("shingle")))
            return F.when(F.size(codes) > 0, F.concat(starts, inside(shingles)))

        return let(retrieved(shingles), with_starts)

    marks = with_shingles(rows).select("doc_id", "row", F.explode(let(F.col("shingles"), marked)).alias("mark")).select("doc_id", "row", "mark.*")
    # A set holds a template's shingles at most; nulls, which mark a retrieved place, are counted apart.
    counted = marks.groupBy("doc_id", "row", "code").agg(F.count_if(F.col("shingle").isNull()).alias("retrieved"), F.size(F.collect_set("shingle")).alias("common")).where("retrieved > 0")
    known_sizes = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(names.index(n)).cast("long").alias("number"), F.lit(n).alias("license"), F.lit(len(set(s))).alias("size")) for n, s in lengths.items()))))
    # One row for each template, whose number does not depend on the documents.
    placed = counted.withColumns({"number": F.shiftright("code", 32), "first": F.col("code").bitwiseAND((1 << 32) - 1) - _OFFSET}).join(F.broadcast(known_sizes), "number")
    checked = placed.select("doc_id", "license", F.greatest(F.col("first"), F.lit(0)).cast("int").alias("first_word"), (F.col("common") / F.col("size")).alias("containment"))
    best = F.min(F.struct((-F.col("containment")).alias("less"), F.col("first_word")))
    return (
        checked.where(F.col("containment") >= containment)
        .groupBy("doc_id", "license")
        .agg(best.alias("best"))
        .select("doc_id", "license", (-F.col("best.less")).alias("containment"), F.col("best.first_word").alias("first_word"))
    )


#: A code is a template's number in the upper bits, and in the lower the shingle of the text at which it begins; it may begin before the text.
_OFFSET = 1 << 20


def _code(number: int) -> int:
    return (number << 32) + _OFFSET


def _window_name(size: Column, band: Column, minimum: Column) -> Column:
    return F.xxhash64(size, band, minimum)


def _entries(codes: dict[int, set[int]], name: Column) -> Column:
    """The codes that a literal map has for a name; an empty array for other names."""
    pairs = [x for k, v in sorted(codes.items()) for x in (F.lit(k).cast("long"), F.array(*(F.lit(c).cast("long") for c in sorted(v))))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), name), F.array().cast("array<bigint>"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """Brute force: every template laid on every place where one of its shingles stands."""
    listed = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in TEMPLATES.items())
    words = r"list_filter(string_split_regex(lower({}), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
    return f"""
WITH t AS (SELECT license, {words.format("text")} AS w FROM (VALUES {listed}) v(license, text)),
ts AS (SELECT license, k, array_to_string(w[k + 1 : k + 5], ' ') AS shingle FROM (SELECT license, w, unnest(range(0, len(w) - 4)) AS k FROM t)),
n AS (SELECT license, count(DISTINCT shingle) AS n, count(*) AS length FROM ts GROUP BY license),
d AS (SELECT doc_id, {words.format("text")} AS w FROM documents WHERE text IS NOT NULL),
ds AS (SELECT doc_id, p, array_to_string(w[p + 1 : p + 5], ' ') AS shingle FROM (SELECT doc_id, w, unnest(range(0, len(w) - 4)) AS p FROM d)),
hits AS (SELECT ds.doc_id, ts.license, ds.p, ds.p - ts.k AS first, ts.shingle FROM ds JOIN ts USING (shingle)),
starts AS (SELECT DISTINCT doc_id, license, first FROM hits),
laid AS (
  SELECT s.doc_id, s.license, greatest(s.first, 0) AS first_word, count(DISTINCT h.shingle)::DOUBLE / any_value(n.n) AS containment
  FROM starts s JOIN n USING (license) JOIN hits h ON h.doc_id = s.doc_id AND h.license = s.license AND h.p >= s.first AND h.p < s.first + n.length
  GROUP BY s.doc_id, s.license, s.first)
SELECT doc_id, license, max(containment) AS containment, CAST(arg_min(first_word, (-containment, first_word)) AS INT) AS first_word
FROM laid WHERE containment >= 0.8 GROUP BY doc_id, license"""


QUERIES = {"op5_licenses": op5_licenses}
SQL = {"op5_licenses": _sql()}
