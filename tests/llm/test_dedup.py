import hashlib
import re

import pytest
from pyspark.sql import functions as F

from weftline.llm.components import components
from weftline.llm.exact_dedup import Patricia, exact_dedup
from weftline.llm.near_dedup import near_duplicates
from weftline.llm.suffix_dedup import remove_repeats

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n=120):
    return " ".join(WORDS[(seed * 7919 + k * k * 31 + k * (seed + 3)) % 20] + str((seed * 31 + k * 17) % 13) for k in range(n))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


CASES = [(5, "a  b"), (3, "a b"), (9, "a\tb"), (4, None), (8, ""), (2, "a b "), (7, "ab"), (7, "ab"), (1, "é" * 3), (6, "long " * 30000)]


def test_exact_dedup_matches_grouping(spark):
    rows = CASES + [(100 + k, "hot copy") for k in range(200)]
    groups = {}
    for i, t in rows:
        groups.setdefault(normal(t), []).append(i)
    want = []
    for i, t in rows:
        ids = groups[normal(t)]
        first = i == min(ids) and (i, t) not in [(w[0], w[-1]) for w in want]
        want.append((i, min(ids), len(ids), first, hashlib.sha256(normal(t).encode()).hexdigest(), t))
    got = exact_dedup(docs(spark, rows).repartition(5)).collect()
    assert sorted(tuple(r) for r in got) == sorted(w[:-1] for w in want)


def test_exact_dedup_keeps_one_of_repeated_rows(spark):
    got = exact_dedup(docs(spark, [(1, "same"), (1, "same"), (1, "same"), (None, "same"), (None, "only"), (2, "x" * 300_000), (3, "x" * 300_000)]).repartition(3)).collect()
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in got) == [(0, 0, 1, True), (0, 1, 4, False), (1, 1, 4, False), (1, 1, 4, False), (1, 1, 4, True), (2, 2, 2, True), (3, 2, 2, False)]


def test_exact_dedup_of_a_text_in_many_partitions(spark):
    rows = spark.range(0, 3000, 1, 300).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("t"), "id")).otherwise(F.lit("hot text " * 200)).alias("text"))
    got = exact_dedup(rows).groupBy("group_size").agg(F.count("*").alias("n"), F.count_if("kept").alias("kept"), F.min("keep_id").alias("least")).orderBy("group_size").collect()
    assert [tuple(r) for r in got] == [(1, 1000, 1000, 0), (2000, 2000, 1, 1)]


def test_exact_dedup_empty_table_and_extra_columns(spark):
    assert exact_dedup(docs(spark, [])).count() == 0
    extra = docs(spark, CASES).withColumns({"keep_id": F.lit("x"), "owner": F.lit(1), "body": F.lit("y")})
    assert exact_dedup(extra).count() == len(CASES)


def test_patricia_spills_and_finds_all():
    trie = Patricia(lambda a, b: a + b, most=4000)
    keys = [prose(k, 30).encode() for k in range(60)] * 2 + [b"", b"x", b"xy"]
    for k, key in enumerate(keys):
        trie.put(key, (k,))
    assert trie.spilled
    expected = {}
    for k, key in enumerate(keys):
        expected.setdefault(key, []).append(k)
    found = dict(trie.items())
    assert {k: sorted(v) for k, v in found.items()} == expected


def brute_near(rows):
    sets = {}
    for i, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").lower()) if x]
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def test_near_duplicates_match_brute_force(spark):
    rows = [(k, prose(k)) for k in range(20)]
    for k in range(12):  # copies with some words changed, here and there
        words = prose(k % 4).split()
        for change in range(k):
            words[(change * 37 + k) % len(words)] = f"new{k}{change}"
        rows.append((100 + k, " ".join(words)))
    rows += [(200, "one two three"), (201, "One  two three"), (202, None), (203, ""), (204, "one two three four"), (300, prose(1)), (301, prose(1).upper())]
    got = {r.doc_id: r for r in near_duplicates(docs(spark, rows)).collect()}
    want = brute_near(rows)
    assert {i: r.class_id for i, r in got.items()} == want
    assert all(r.kept == (r.class_id == i) and r.class_size == list(want.values()).count(r.class_id) for i, r in got.items())
    assert got[202].class_id == 202 and got[203].class_id == 203


def test_near_duplicates_hot_group_and_empty_table(spark):
    assert near_duplicates(docs(spark, [])).count() == 0
    rows = [(k, prose(1) + f" tail{k}") for k in range(60)] + [(100 + k, prose(2)) for k in range(60)]
    got = near_duplicates(docs(spark, rows).withColumn("bands", F.lit(0))).groupBy("class_id").count().collect()
    assert sorted((r[0], r[1]) for r in got) == [(0, 60), (100, 60)]


def test_near_duplicates_star_of_edits_around_a_middle_id(spark):
    base = prose(1).split()
    rows = [(100, " ".join(base))]
    for k in range(201):  # two words changed: alike to the base, less so to one another
        if k != 100:
            words = list(base)
            first, second = 5 + k * 7 % 50, 62 + k * 11 % 51
            words[first], words[second] = f"new{k}", f"other{k}"
            rows.append((k, " ".join(words)))
    want = brute_near(rows)
    assert set(want.values()) == {0}
    assert {r.doc_id: r.class_id for r in near_duplicates(docs(spark, rows)).collect()} == want


def brute_weighted(rows):
    from collections import Counter

    bags = {}
    for i, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").lower()) if x]
        bags[i] = Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()
    return {(i, j): sum((bags[i] & bags[j]).values()) / max(1, sum((bags[i] | bags[j]).values())) for i in bags for j in bags if i < j}


def test_near_duplicates_weigh_occurrences(spark):
    line = prose(2, 12)
    rows = [(1, " ".join([line] * 3)), (2, " ".join([line] * 4)), (3, " ".join([line] * 40)), (4, " ".join([line] * 41)), (5, prose(3)), (5, prose(3)), (6, "word " * 20_000), (7, "word " * 19_000)]
    alike = {pair for pair, s in brute_weighted(rows).items() if s >= 0.8}
    assert alike == {(3, 4), (6, 7)}
    got = {r.doc_id: r.class_id for r in near_duplicates(docs(spark, rows)).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 3, 5: 5, 6: 6, 7: 6}
    plain = {r.doc_id: r.class_id for r in near_duplicates(docs(spark, rows), weighted=False, margin=None).collect()}
    assert plain[1] == plain[2] == plain[3] == plain[4] == 1 and plain[6] == plain[7] == 6


def test_near_duplicates_recall_by_similarity(spark):
    import random

    draw = random.Random(5)
    rows, planted = [], []
    for k in range(60):
        base = [f"w{draw.randrange(5000)}" for _ in range(300)]
        rows.append((1000 + k, " ".join(base)))
        for step, edits in enumerate((3, 5, 6)):  # similarities of about 0.90, 0.84 and 0.81
            copy = list(base)
            for place in range(edits):
                copy[10 + place * 45] = f"x{k}_{step}_{place}"
            rows.append((k * 3 + step, " ".join(copy)))
            planted.append((k * 3 + step, 1000 + k))
    want = brute_near(rows)
    got = {r.doc_id: r.class_id for r in near_duplicates(docs(spark, rows)).collect()}
    assert sum(got[a] == got[b] for a, b in planted) == sum(want[a] == want[b] for a, b in planted) == len(planted)


def test_components_of_a_long_chain(spark):
    edges = spark.range(1, 40).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    found = {r.node: r.root for r in components(edges.union(edges)).collect()}
    assert found == {k: 1 for k in range(2, 41)}
    assert components(edges.limit(0)).count() == 0


def brute_repeats(rows, length=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        mark = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < i:
                mark[p : p + length] = b"\1" * length
        kept = bytes(x for x, m in zip(b, mark) if not m)
        out.append((i, len(b), sum(mark), sum(1 for s in bytes(mark).split(b"\0") if s), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_repeats_match_brute_force(spark):
    shared = "This passage of well over fifty bytes, with an é, stands in more than one document."
    rows = [(k, prose(k, 60)) for k in range(8)]
    rows += [(20, shared), (10, "x" + shared + "y"), (30, shared[:49]), (31, shared[:50]), (32, shared + shared), (40, "a" * 500), (41, "a" * 300 + "b"), (42, "ab" * 100), (43, "ba" * 90)]
    rows += [(50, None), (51, ""), (52, prose(3, 60)), (53, prose(3, 60) + " more"), (60, "a" * 49), (70, "ü" * 40), (71, "ü" * 30)]
    got = [tuple(r) for r in remove_repeats(docs(spark, rows).repartition(4)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    assert sorted(got) == brute_repeats(rows)


def test_repeats_of_a_frequent_word_and_a_long_text(spark):
    hot = " frequentword "
    rows = [(k, "".join(hot + f"{(k * 131 + j * 17) % 997:03d}" for j in range(60))) for k in range(12)] + [(40, prose(9, 3000)), (41, prose(9, 3000)), (42, prose(11, 3000))]
    got = [tuple(r) for r in remove_repeats(docs(spark, rows).repartition(4)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    assert sorted(got) == brute_repeats(rows)


def test_frequent_keys_are_joined_with_a_second_word():
    import numpy as np

    from weftline.llm.suffix_dedup import _keys

    body = np.frombuffer("".join(f" frequentword {k:05d}" for k in range(400)).encode(), np.uint8)
    plain = _keys(body, 50, np.zeros(0, np.uint64))
    names, counts = np.unique(plain, return_counts=True)
    hot = np.sort(names[counts > 100])
    assert len(hot)
    cut = _keys(body, 50, hot)
    assert np.unique(cut, return_counts=True)[1].max() < counts.max() / 2
    strings = {}
    for p, key in enumerate(cut.tolist()):  # equal strings still share their key
        assert strings.setdefault(body[p : p + 50].tobytes(), key) == key


def test_repeats_longer_strings_repeated_ids_and_empty_table(spark):
    assert remove_repeats(docs(spark, [])).count() == 0
    rows = [(1, prose(5, 40)), (2, prose(5, 40) + "z"), (3, prose(6, 10))]
    got = [tuple(r) for r in remove_repeats(docs(spark, rows), length=100).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    assert sorted(got) == brute_repeats(rows, 100)
    same = remove_repeats(docs(spark, [(1, prose(5)), (1, prose(5)), (1, prose(6))]).withColumn("spans", F.lit(1))).collect()
    assert [r.n_removed for r in same] == [0, 0, 0]


def test_suffix_dedup_of_null_and_large_ids(spark):
    a, b = prose(1, 40), prose(2, 40)
    got = remove_repeats(docs(spark, [(None, a), (5, a), (8, a), (None, b), (2**60 + 1, b), (2**60 + 3, b), (None, prose(3, 40)), (None, prose(3, 40))]).repartition(3)).collect()
    size, other, third = len(a.encode()), len(b.encode()), len(prose(3, 40).encode())
    want = [(None, size, size), (5, size, 0), (8, size, size), (None, other, other), (2**60 + 1, other, 0), (2**60 + 3, other, other), (None, third, 0), (None, third, 0)]
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in got) == sorted((i or 0, n, m) for i, n, m in want)


def test_near_duplicates_of_null_ids(spark):
    got = near_duplicates(docs(spark, [(None, prose(1)), (5, prose(1)), (8, prose(1)), (None, prose(2)), (None, prose(2)), (None, None)]).repartition(4)).collect()
    want = [(0, 5, 3, False), (5, 5, 3, True), (8, 5, 3, False), (0, 0, 2, True), (0, 0, 2, False), (0, 0, 1, True)]
    assert sorted((r.doc_id or 0, r.class_id or 0, r.class_size, r.kept) for r in got) == sorted(want)


@pytest.mark.parametrize("turn", [1, -1])
def test_near_duplicates_of_one_id_with_two_texts(spark, turn):
    near = prose(2).replace(WORDS[3], "changed", 1)
    rows = [(5, prose(1)), (5, prose(2)), (9, near), (7, prose(4))][::turn]
    got = near_duplicates(docs(spark, rows).coalesce(1)).collect()
    assert sorted((r.doc_id, r.class_id, r.class_size, r.kept) for r in got) == [(5, 5, 1, True), (5, 5, 2, True), (7, 7, 1, True), (9, 5, 2, False)]


def test_near_duplicates_of_unlike_members_of_large_buckets(spark, monkeypatch):
    """Texts of one base, most of them just too unlike one another: their buckets are compared in blocks, and give the links of brute force."""
    import random

    from weftline.llm import near_dedup

    monkeypatch.setattr(near_dedup, "SMALL", 2)
    monkeypatch.setattr(near_dedup, "BLOCK", 5)
    draw = random.Random(9)
    base = [f"b{k}" for k in range(200)]
    rows = []
    for k in range(90):
        words = list(base)
        for place in draw.sample(range(4, 196), 3 if k % 9 else 2):
            words[place] = f"x{k}_{place}"
        rows.append((k, " ".join(words)))
    want = brute_near(rows)
    assert 10 < len(set(want.values())) < 90
    assert {r.doc_id: r.class_id for r in near_duplicates(docs(spark, rows), margin=None).collect()} == want
