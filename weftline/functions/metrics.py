"""Overlap metrics over pairs of texts.

Overlaps of n-grams are multiset intersections, computed inside the row over Arrow batches: no token becomes a row, and nothing is
shuffled. (The same as column functions, by a walk through a sorted array, took five to eight times as long.) All results stay finite: an empty denominator gives 0, as each metric's definition says.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, IntegerType, LongType


def f_beta(p: Column, r: Column, beta: float = 1.0) -> Column:
    """0 where both are 0."""
    b = beta * beta
    return F.coalesce(F.try_divide((1 + b) * p * r, b * p + r), F.lit(0.0))


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def multiset_common(a: Column, b: Column) -> Column:
    """S3: occurrences that two arrays of strings both have."""
    tagged = F.concat(F.transform(a, lambda g: F.struct(g.alias("g"), F.lit(0).alias("side"))), F.transform(b, lambda g: F.struct(g.alias("g"), F.lit(1).alias("side"))))
    start = F.struct(F.lit(None).cast("string").alias("g"), F.lit(0).alias("left"), F.lit(0).alias("common"))

    def step(now: Column, e: Column) -> Column:
        left = F.when(now["g"].eqNullSafe(e["g"]), now["left"]).otherwise(0)
        move = F.when(e["side"] == 0, 1).when(left > 0, -1).otherwise(0)
        return F.struct(e["g"].alias("g"), (left + move).alias("left"), F.when(move < 0, now["common"] + 1).otherwise(now["common"]).alias("common"))

    return F.aggregate(F.sort_array(tagged), start, step, lambda x: x["common"].cast("long"))


#: Tokens or characters of both sides that are counted at once.
GRAMS_AT_ONCE = 1 << 20


def _parts(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about GRAMS_AT_ONCE tokens; a longer row is a range of its own."""
    upto = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        end = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + GRAMS_AT_ONCE, side="right")))
        yield start, end
        start = end


def _counted(row: np.ndarray, name: np.ndarray, names: int) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(row * names + name, return_counts=True)


def _lists(column: pa.Array) -> pa.Array:
    return column.fill_null(pa.scalar([], column.type)) if column.null_count else column


def gram_common(sizes: tuple[int, ...]) -> Callable:
    """For two arrays of tokens the occurrences that both have of their n-grams, an element for each n in sizes.

    Tokens of a batch get numbers, n-grams the numbers of pairs of an (n-1)-gram and a token, and the occurrences of each row are counted and
    matched as sorted numbers.
    """

    @arrow_udf("array<bigint>")
    def common(a: pa.Array, b: pa.Array) -> pa.Array:
        a, b = _lists(a), _lists(b)
        out = np.zeros((len(a), len(sizes)), np.int64)
        total = pc.add(pc.list_value_length(a), pc.list_value_length(b)).to_numpy(zero_copy_only=False)
        for low, high in _parts(total):
            x, y = a.slice(low, high - low), b.slice(low, high - low)
            tokens = pa.concat_arrays([x.flatten(), y.flatten()]).dictionary_encode()
            token = tokens.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            rows = high - low
            # The rows of b come behind those of a.
            row = np.repeat(np.arange(2 * rows), np.concatenate([pc.list_value_length(z).to_numpy(zero_copy_only=False) for z in (x, y)]))
            name, place, many = token, np.arange(len(token)), len(tokens.dictionary)
            for n in range(1, max(sizes) + 1):
                if n > 1:
                    on = (place + n - 1 < len(token)) & (row[np.minimum(place + n - 1, len(token) - 1)] == row[place]) if len(token) else np.zeros(0, bool)
                    place = place[on]
                    kept, name = np.unique(name[on] * len(tokens.dictionary) + token[place + n - 1], return_inverse=True)
                    many = len(kept)
                if n in sizes:
                    of = row[place]
                    ours = of < rows
                    (ka, ca), (kb, cb) = _counted(of[ours], name[ours], max(many, 1)), _counted(of[~ours] - rows, name[~ours], max(many, 1))
                    both, at, to = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
                    np.add.at(out[low:high, sizes.index(n)], both // max(many, 1), np.minimum(ca[at], cb[to]))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * len(sizes), pa.int32()), pa.array(out.reshape(-1)))

    return common


def char_cosine(n: int, short: bool) -> Callable:
    """cosine of the counts of two texts' character n-grams, n up to 3; 0 if one has none. short: a text of fewer characters is one gram."""

    @arrow_udf("double")
    def cosine(a: pa.Array, b: pa.Array) -> pa.Array:
        out = np.zeros(len(a))
        sizes = pc.fill_null(pc.add(pc.utf8_length(a), pc.utf8_length(b)), 0).to_numpy(zero_copy_only=False)
        for low, high in _parts(sizes):
            sides = []
            for column in (a, b):
                texts = [t or "" for t in column.slice(low, high - low).to_pylist()]
                size = np.array([len(t) for t in texts])
                # One more than the code point, so that what is behind a short text's end differs from all characters.
                c = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
                row = np.repeat(np.arange(len(texts)), size)
                behind = np.repeat(np.cumsum(size), size) - np.arange(len(c))  # characters from here to the row's end
                gram = np.zeros(len(c), np.int64)
                for k in range(n):
                    gram = (gram << 21) | np.where(behind > k, c[np.minimum(np.arange(len(c)) + k, len(c) - 1)] if len(c) else c, 0)
                whole = behind >= n
                if short:
                    whole |= (size[row] < n) & (behind == size[row])
                sides.append((row[whole], gram[whole]))
            (ra, ga), (rb, gb) = sides
            names, of = np.unique(np.concatenate([ga, gb]), return_inverse=True)
            many = max(len(names), 1)
            (ka, ca), (kb, cb) = _counted(ra, of[: len(ga)], many), _counted(rb, of[len(ga) :], many)
            both, at, to = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
            rows = high - low
            dot = np.bincount(both // many, weights=ca[at] * cb[to], minlength=rows)
            norm = np.sqrt(np.bincount(ka // many, weights=ca * ca, minlength=rows)) * np.sqrt(np.bincount(kb // many, weights=cb * cb, minlength=rows))
            out[low:high] = np.divide(dot, norm, out=np.zeros(rows), where=norm > 0)
        return pa.array(out)

    return cosine


def overlaps(pairs: DataFrame, a: str, b: str, sizes: dict[str, int]) -> DataFrame:
    """pairs and, for each name in sizes, common_<name>, a_<name> and b_<name>: multiset overlap and sizes of the n-grams of two token arrays. No gram leaves its row."""

    def many(c: str, n: int) -> Column:
        return F.greatest(F.coalesce(F.size(c), F.lit(0)) - (n - 1), F.lit(0)).cast("long")

    found = pairs.withColumn("_common", gram_common(tuple(sizes.values()))(F.col(a), F.col(b)))
    out = {}
    for k, (name, n) in enumerate(sizes.items()):
        out |= {f"common_{name}": F.get("_common", F.lit(k)), f"a_{name}": many(a, n), f"b_{name}": many(b, n)}
    return found.withColumns(out).drop("_common")


_KINDS: dict[str, np.ndarray] = {}


def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """By code point, whether it is a combining mark, and whether it is white space, as functions.text.graphemes() has them."""
    if "blank" not in _KINDS:
        blank = np.zeros(0x110000, bool)
        blank[[*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True
        _KINDS["marks"] = np.fromiter((unicodedata.combining(chr(c)) > 0 for c in range(0x110000)), bool, 0x110000)
        _KINDS["blank"] = blank
    return _KINDS["marks"], _KINDS["blank"]


def _code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The characters of all texts (null: none) behind one another, and how many each text has."""
    texts = texts.fill_null("")
    body = "".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(body, np.uint32).astype(np.int64), pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)


def _grapheme_names(c: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each grapheme of texts given by their characters, equal for equal graphemes, and its text; blank ones are dropped."""
    marks, blank = _kinds()
    begins = ~marks[c]
    begins[(np.cumsum(size) - size)[size > 0]] = True
    start = np.flatnonzero(begins)
    length = np.diff(np.append(start, len(c)))
    name = c[start]
    clusters: dict[bytes, int] = {}
    several = np.flatnonzero(length > 1)
    name[several] = [clusters.setdefault(c[k : k + n].tobytes(), 0x110000 + len(clusters)) for k, n in zip(start[several], length[several], strict=True)]
    kept = (length > 1) | ~blank[np.minimum(name, 0x10FFFF)]
    return name[kept], np.repeat(np.arange(len(size)), size)[start[kept]]


def grapheme_common(sizes: tuple[int, ...]) -> Callable:
    """As gram_common(), for the graphemes of two texts, and behind them how many graphemes each text has.

    No grapheme becomes a string. n-grams, their row and their side are one number of 64 bits as long as they fit, so that counting is a sort of plain
    numbers; where they do not fit, n-grams are numbered first.
    """

    @arrow_udf("array<bigint>")
    def common(a: pa.Array, b: pa.Array) -> pa.Array:
        out = np.zeros((len(a), len(sizes) + 2), np.int64)
        total = pc.fill_null(pc.utf8_length(a), 0).to_numpy(zero_copy_only=False) + pc.fill_null(pc.utf8_length(b), 0).to_numpy(zero_copy_only=False)
        for low, high in _parts(total.astype(np.int64)):
            rows = high - low
            (c, n), (d, m) = _code_points(a.slice(low, rows)), _code_points(b.slice(low, rows))
            name, row = _grapheme_names(np.concatenate([c, d]), np.concatenate([n, m]))  # the rows of b come behind those of a
            counted = np.bincount(row, minlength=2 * rows)
            out[low:high, -2], out[low:high, -1] = counted[:rows], counted[rows:]
            present = np.zeros(int(name.max(initial=0)) + 1, bool)
            present[name] = True
            token = (np.cumsum(present) - 1)[name]
            bits = wide = int(present.sum()).bit_length()
            gram, place = token, np.arange(len(row))
            for k in range(1, max(sizes) + 1):
                if k > 1:
                    longer = place + k - 1 < len(row)
                    longer[longer] = row[place[longer]] == row[place[longer] + k - 1]
                    gram, place = gram[longer], place[longer]
                    if wide + bits + (2 * rows).bit_length() > 62:
                        names, gram = np.unique(gram, return_inverse=True)
                        wide = len(names).bit_length()
                    gram, wide = (gram << bits) | token[place + k - 1], wide + bits
                if k in sizes:
                    of = row[place]
                    key = np.sort(((np.where(of < rows, of, of - rows) << wide | gram) << 1) | (of >= rows))
                    head = np.flatnonzero(np.append(True, (key[1:] >> 1) != (key[:-1] >> 1))[: len(key)])
                    if len(head):
                        ours = np.add.reduceat(key & 1, head)
                        both = np.minimum(ours, np.diff(np.append(head, len(key))) - ours)
                        out[low:high, sizes.index(k)] = np.bincount(key[head] >> (wide + 1), both, rows)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * (len(sizes) + 2), pa.int32()), pa.array(out.reshape(-1)))

    return common


def grapheme_overlaps(pairs: DataFrame, a: str, b: str, sizes: dict[str, int]) -> DataFrame:
    """overlaps() of the graphemes of two texts; also na and nb, how many graphemes they have."""
    found = pairs.withColumn("_common", grapheme_common(tuple(sizes.values()))(F.col(a), F.col(b)))
    out = {"na": F.get("_common", F.lit(len(sizes))), "nb": F.get("_common", F.lit(len(sizes) + 1))}
    for k, (name, n) in enumerate(sizes.items()):
        out |= {f"common_{name}": F.get("_common", F.lit(k))}
        out |= {f"{side}_{name}": F.greatest(out[f"n{side}"] - (n - 1), F.lit(0).cast("long")) for side in "ab"}
    return found.withColumns(out).drop("_common")


@arrow_udf(IntegerType())
def lcs_length(a: pa.Array, b: pa.Array) -> pa.Array:
    """length of the longest common subsequence of two token arrays; 0 for null."""
    a, b = _lists(a), _lists(b)
    sizes = [pc.list_value_length(z).to_numpy(zero_copy_only=False).astype(np.int64) for z in (a, b)]
    out = np.zeros(len(a), np.int32)
    for low, high in _parts(sum(sizes)):
        tokens = pa.concat_arrays([z.slice(low, high - low).flatten() for z in (a, b)]).dictionary_encode(null_encoding="encode")
        out[low:high] = _lcs_of_rows(tokens.indices.to_numpy(zero_copy_only=False).astype(np.int64), *(n[low:high] for n in sizes))
    return pa.array(out)


@arrow_udf(ArrayType(LongType()))
def grapheme_lcs(a: pa.Array, b: pa.Array) -> pa.Array:
    """As lcs_length(), for the graphemes of two texts, and behind it how many graphemes each text has. No grapheme becomes a string."""
    out = np.zeros((len(a), 3), np.int64)
    total = pc.fill_null(pc.utf8_length(a), 0).to_numpy(zero_copy_only=False) + pc.fill_null(pc.utf8_length(b), 0).to_numpy(zero_copy_only=False)
    for low, high in _parts(total.astype(np.int64)):
        rows = high - low
        (c, n), (d, m) = _code_points(a.slice(low, rows)), _code_points(b.slice(low, rows))
        name, row = _grapheme_names(np.concatenate([c, d]), np.concatenate([n, m]))
        counted = np.bincount(row, minlength=2 * rows)
        out[low:high, 1], out[low:high, 2] = counted[:rows], counted[rows:]
        out[low:high, 0] = _lcs_of_rows(name, counted[:rows], counted[rows:])
    return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * 3, pa.int32()), pa.array(out.reshape(-1)))


def _lcs_of_rows(tokens: np.ndarray, n: np.ndarray, m: np.ndarray) -> list[int]:
    """The length for each row; the numbers of the rows' tokens stand behind one another, those of the second sides behind all of the first."""
    ends, behind = np.cumsum(n), np.cumsum(m) + int(n.sum())
    return [_lcs(tokens[e - k : e], tokens[f - h : f]) for e, k, f, h in zip(ends.tolist(), n.tolist(), behind.tolist(), m.tolist(), strict=True)]


#: Up to so many tokens of the second side all of its places are asked at once; the search for the few that can matter would take longer.
LCS_WHOLE = 2048


def _without_ends(x: np.ndarray, y: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """How many tokens two sequences share at their ends, which some longest subsequence holds, and what is between."""
    n = min(len(x), len(y))
    other = np.flatnonzero(x[:n] != y[:n])
    head = int(other[0]) if len(other) else n
    n -= head
    other = np.flatnonzero(x[len(x) - n :] != y[len(y) - n :])
    tail = n - 1 - int(other[-1]) if len(other) else n
    return head + tail, x[head : len(x) - tail], y[head : len(y) - tail]


def _lcs(x: np.ndarray | list, y: np.ndarray | list) -> int:
    """The length for two sequences of numbers, or of words.

    A subsequence that leaves d tokens of both sides together out never joins places further apart than d, nor d' < d with the lengths' difference taken
    off. So places are asked in a band, which is widened until what it leaves out fits into it; then no longer one is outside.
    """
    ends, x, y = _without_ends(np.asarray(x), np.asarray(y))
    if len(x) and len(y) > LCS_WHOLE:  # what only one side has is in no subsequence
        x, y = x[np.isin(x, y)], y[np.isin(y, x)]
        more, x, y = _without_ends(x, y)
        ends += more
    n, m = len(x), len(y)
    if not n or not m:
        return ends
    if m <= LCS_WHOLE:
        return ends + _lcs_in_band(x, y, n, m)
    d = max(64, 2 * abs(m - n))
    while True:
        below, above = (d - m + n) // 2 + 1, (d + m - n) // 2 + 1
        found = _lcs_in_band(x, y, below, above)
        left_out = n + m - 2 * found
        if left_out <= d or (below >= n and above >= m):
            return ends + found
        d = min(left_out, 4 * d)


def _lcs_in_band(x: np.ndarray, y: np.ndarray, below: int, above: int) -> int:
    """The length of some common subsequence; of a longest one if it joins only places i of x and j of y with -below <= j - i <= above.

    The rows of the table are sets of bits in one integer, a bit for each token of y in the band of a stretch of rows, so that a whole row is a few operations
    on machine words. Bits are 0 where the row's value is larger than its left neighbour's.
    """
    n, m = len(x), len(y)
    step = n if below >= n and above >= m else below + above
    low = high = rises = passed = 0
    for i in range(0, n, step):
        now = x[i : i + step].tolist()
        start, end = max(low, min(i - below, m)), max(high, min(i + len(now) + above, m))
        start = min(start, end)
        passed += start - low - (rises & ((1 << (start - low)) - 1)).bit_count()  # values of what lies left of the band
        rises >>= start - low
        rises |= ((1 << (end - high)) - 1) << max(high - start, 0)
        low, high = start, end
        every = (1 << (high - low)) - 1
        masks = _masks(y[low:high], set(now))
        for token in now:
            hit = rises & masks.get(token, 0)
            if hit:
                rises = ((rises + hit) | (rises - hit)) & every
    return passed + high - low - rises.bit_count()


def _masks(y: np.ndarray, asked: set[int]) -> dict[int, int]:
    """By token that is asked for, the places of a sequence that have it, as bits."""
    order = np.argsort(y, kind="stable")
    of = y[order]
    begin = np.flatnonzero(np.append(True, of[1:] != of[:-1])[: len(of)])
    out = {}
    for token, start, end in zip(of[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(of)], strict=True):
        if token in asked:
            flags = np.zeros(len(y), np.uint8)
            flags[order[start:end]] = 1
            out[token] = int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")
    return out


def rouge_f1(common: Column, a: Column, b: Column) -> Column:
    """F1 of an overlap with sizes a and b, by one division: through precision and recall, halves of the last place that is kept would be rounded down at times."""
    return ratio(2 * common, a + b)


def bleu4(o: dict[int, tuple[Column, Column]], candidate: Column, reference: Column) -> Column:
    """BLEU of 1- to 4-grams without smoothing; o has common and candidate counts by n."""
    precisions = [ratio(common, total) for common, total in (o[n] for n in (1, 2, 3, 4))]
    some = precisions[0] > 0
    for p in precisions[1:]:
        some = some & (p > 0)
    mean = sum((F.log(p) for p in precisions[1:]), F.log(precisions[0])) / 4
    brevity = F.when(candidate >= reference, F.lit(1.0)).otherwise(F.exp(1 - ratio(reference, candidate)))
    return F.when(some, brevity * F.exp(mean)).otherwise(0.0)


def gleu(o: dict[int, tuple[Column, Column, Column]]) -> Column:
    """the smaller of precision and recall over all 1- to 4-grams together."""
    common = sum((o[n][0] for n in (2, 3, 4)), o[1][0])
    a = sum((o[n][1] for n in (2, 3, 4)), o[1][1])
    b = sum((o[n][2] for n in (2, 3, 4)), o[1][2])
    return ratio(common, F.greatest(a, b))
