"""What repeats within a text: words, phrases and runs of words, counted inside the row.

Takes arrays of words. The words of an Arrow batch get numbers, phrases the numbers of pairs of a shorter phrase and a word, and the occurrences
of each row are counted as sorted numbers; no word becomes a row, and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.functions import arrow_udf

from .metrics import _lists, _parts


def numbered(lists: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, pa.Array]]:
    """Ranges of rows of a column of arrays: low, high, each token's row in the range, its number, and the tokens by number."""
    lists = _lists(lists)
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    for low, high in _parts(sizes):
        tokens = lists.slice(low, high - low).flatten().dictionary_encode()
        yield low, high, np.repeat(np.arange(high - low), sizes[low:high]), tokens.indices.to_numpy(zero_copy_only=False).astype(np.int64), tokens.dictionary


def pair_names(a: np.ndarray, b: np.ndarray, many: int) -> np.ndarray:
    """A number for each pair of numbers, equal ones for equal pairs; those of b are below many."""
    return np.unique(a * max(many, 1) + b, return_inverse=True)[1]


def word_repeated(least: int = 12, among: int = 20, longer: int = 3, ignored: tuple[str, ...] = ()) -> Callable:
    """F32: some word of more than `longer` characters, not among the ignored, stands `least` times or more in a text of `among` words or more."""

    @arrow_udf("boolean")
    def repeated(words: pa.Array) -> pa.Array:
        out = np.zeros(len(words), bool)
        for low, high, row, token, names in numbered(words):
            counts = pc.and_(pc.greater(pc.utf8_length(names), longer), pc.invert(pc.is_in(names, pa.array(ignored, names.type)))).to_numpy(zero_copy_only=False)
            on = counts[token] if len(token) else np.zeros(0, bool)
            found, n = np.unique(row[on] * max(len(names), 1) + token[on], return_counts=True)
            out[low + found[n >= least] // max(len(names), 1)] = True
            out[low:high] &= np.bincount(row, minlength=high - low) >= among
        return pa.array(out)

    return repeated


def phrase_repeated(n: int) -> Callable:
    """F33 in sorted order: a phrase of n words whose outer ones may be cut short stands twice without overlap.

    Two places i < j match if the last character of word i, the words between, and the first character of word i + n - 1 agree, and
    j is n or more places on, or n - 1 places and the word shared there has more than one character. Per key the first and the
    last place suffice.
    """

    @arrow_udf("boolean")
    def repeated(words: pa.Array) -> pa.Array:
        out = np.zeros(len(words), bool)
        for low, _, row, token, names in numbered(words):
            place = np.arange(len(token) - n + 1)
            place = place[row[place] == row[place + n - 1]] if len(place) else place
            if not len(place):
                continue
            first, last = (pc.utf8_slice_codeunits(names, *cut).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) for cut in ((0, 1), (-1, None)))
            key = row[place] * len(names) + last[token[place]]
            for k in range(1, n - 1):
                key = pair_names(key, token[place + k], len(names))
            key = pair_names(key, first[token[place + n - 1]], len(names))
            order = np.argsort(key, kind="stable")
            ends = np.flatnonzero(np.append(np.diff(key[order]) > 0, True))
            starts = np.append(0, ends[:-1] + 1)
            lowest, highest = place[order[starts]], place[order[ends]]
            size = pc.utf8_length(names).to_numpy(zero_copy_only=False)[token[highest]]
            gap = highest - lowest
            out[low + row[lowest[(gap > n - 1) | ((gap == n - 1) & (size > 1))]]] = True
        return pa.array(out)

    return repeated


def most_of_a_run(n: int, among: int) -> Callable:
    """How often the most frequent n words in a row stand in a text; 0 for fewer than `among` words."""

    @arrow_udf("bigint")
    def most(words: pa.Array) -> pa.Array:
        out = np.zeros(len(words), np.int64)
        for low, high, row, token, names in numbered(words):
            place = np.arange(len(token) - n + 1)
            place = place[(row[place] == row[place + n - 1]) & (np.bincount(row)[row[place]] >= among)] if len(place) else place
            key = row[place] * max(len(names), 1) + token[place] if len(place) else place
            for k in range(1, n):
                key = pair_names(key, token[place + k], len(names))
            found, at, times = np.unique(key, return_index=True, return_counts=True)
            np.maximum.at(out, low + row[place[at]], times)
        return pa.array(out)

    return most
