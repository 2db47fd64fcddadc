"""Collocations, WARC archives and the divergence audit against plain versions, with the edge cases that their docstrings state."""

import hashlib
import io
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.oracle import connect, rows_of, sql_rows
from weftline.llm import collocations as co
from weftline.llm import divergence as di
from weftline.llm import warc
from weftline.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.mark.parametrize("name", ["op11_collocations", "op12_warc", "op13_divergence"])
def test_matches_sql(spark, sf_dir, name):
    assert rows_of(QUERIES[name](spark, sf_dir)) == sql_rows(connect(sf_dir), ORACLE_SQL[name])


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def text_rows(seed, n=160):
    r = random.Random(seed)
    words = ["New", "york", "CITY", "the", "of", "café", "ÉTÉ", "x\x00y", "zeta", "a", "b"]
    rows = []
    for i in range(n):
        text = "".join(r.choice(words) + r.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b"]) for _ in range(r.randrange(60)))
        rows.append((r.choice([i, None, 7]), r.choice([text, text, text, None, ""]), r.choice(["en", "en", "de", None]), r.choice(["s1", "s1", "s2", "s3", "", None])))
    rows.append((1, "new york city " * 20_000, "en", "s1"))
    rows.append((2, "lonely words here", "fr", "s9"))
    return rows


def plain_collocations(rows, words, least, top, subsumed):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, words + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in candidates.items():
            longer = [b for q, b in candidates.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if any(100 * b >= subsumed * a for b in longer):
                continue
            score, _, l, r = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), a, l, r))
        for rank, (score, _, phrase, a, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), a, l, r, n[lang], -score))
    return sorted(out)


@pytest.mark.parametrize(("words", "least", "top"), [(3, 10, 2000), (5, 4, 7), (2, 1, 50)])
def test_collocations(spark, words, least, top):
    rows = text_rows(words)
    df = spark.createDataFrame(rows, SCHEMA).repartition(6).withColumns({c: F.lit("clash") for c in ("block", "bucket", "body", "word", "n", "id")})
    got = co.collocations(df, words=words, least=least, top=top, bucket_bytes=50_000)
    assert sorted(tuple(r) for r in got.collect()) == plain_collocations(rows, words, least, top, 50)


def test_collocations_of_nothing(spark):
    assert co.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert co.collocations(spark.createDataFrame([(None, None, None, None), (1, " . ", "en", "s")], SCHEMA)).count() == 0


def plain_divergence(rows, least, top):
    terms = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low(text))) for _, text, lang, source in rows]
    out = []
    for lang in {t[0] for t in terms}:
        docs = Counter(w for a, _, ws in terms if a == lang for w in set(ws))
        kept = {w for w, n in docs.items() if n >= least}
        groups = {s: Counter() for a, s, _ in terms if a == lang}
        for a, s, ws in terms:
            if a == lang:
                groups[s].update(w for w in ws if w in kept)
        whole = sum(groups.values(), Counter())

        def p(c, w, v=len(kept)):
            return 1 + 1_000_000_000 * (c[w] + 1) // (c.total() + v)

        def f(x, y):
            return (x - y) ** 2 // y

        for s, c in groups.items():
            pairs = sorted(((-sum(f(p(c, w), p(o, w)) for w in kept), t.encode()) for t, o in groups.items() if t != s))
            own = sorted((-f(p(c, w), p(whole, w)), w.encode()) for w in kept if c[w] and p(c, w) > p(whole, w))[:top]
            for part, found in (("pair", pairs), ("term", own)):
                out += [(lang, s, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize(("seed", "top"), [(1, 200), (2, 3), (3, 1)])
def test_divergence(spark, seed, top):
    rows = text_rows(seed)
    r = random.Random(seed)
    rows += [(i, " ".join(f"w{chr(97 + int(26 * r.random() ** 3))}{chr(97 + int(26 * r.random() ** 2))}" for _ in range(80)), "en", f"s{i % 7}") for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6).withColumns({c: F.lit("clash") for c in ("term", "g", "body", "bucket", "p", "value")})
    got = di.divergence(df, top=top, bucket_bytes=20_000)
    assert sorted(tuple(r) for r in got.collect()) == plain_divergence(rows, 3, top)


def test_divergence_of_nothing(spark):
    assert di.divergence(spark.createDataFrame([], SCHEMA)).count() == 0
    got = di.divergence(spark.createDataFrame([(1, None, None, None), (2, "a b", "en", "x"), (3, "123 !", "en", "y")], SCHEMA))
    assert sorted(tuple(r) for r in got.collect()) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


def test_divergence_of_counts_over_64_bits(spark):
    """A count of 10**13 scaled passes 64 bits; the quotient is exact."""
    c, total, terms = 10**13 + 7, 3 * 10**13 + 1, 12345
    df = spark.createDataFrame([(c, total, terms)], "c long, t long, v long")
    assert df.select(di._share(F.col("c"), F.col("t"), F.col("v"))).first()[0] == 1 + 1_000_000_000 * (c + 1) // (total + terms)


PAGES = "page_id long, url string, html string"
PAGE_ROWS = [
    (3, "http://a/1", "x" * 100), (1, "http://a/2", "x" * 100), (2, None, "x" * 100), (None, "", "x" * 100), (4, "http://b/ü q%41\n", "x" * 99), (5, "http://b", "x" * 99),
    (6, "http://c", None), (7, "http://c", ""), (8, "http://d", "é" * 50), (8, "http://d", "é" * 50), (9, "http://e", "long\r\n\r\n" * 300_000), (10, "http://e", "long\r\n\r\n" * 300_000),
]


def test_archives_round_trip(spark):
    df = spark.createDataFrame(PAGE_ROWS, PAGES).repartition(4).withColumns({c: F.lit("clash") for c in ("payload", "row", "digest", "archive")})
    archives = warc.write_archives(df, archive_bytes=2_000)
    got = warc.read_archives(archives, payload=True, strict=True).where("record_type <> 'warcinfo'").collect()
    assert archives.agg(F.sum("records")).first()[0] == len(got) == len(PAGE_ROWS)
    by_id = {r.record_id: r for r in got}
    for r in got:
        whole = (by_id[r.refers_to_id] if r.record_type == "revisit" else r).payload
        assert r.payload_bytes == len(whole) and r.payload_digest == hashlib.sha256(whole).hexdigest()
    assert sorted((r.page_id or 0, r.url or "-", (by_id[r.refers_to_id] if r.refers_to_id else r).payload.decode()) for r in got) == sorted((i or 0, u or "-", h or "") for i, u, h in PAGE_ROWS)
    assert {r.url for r in got if r.page_id in (2, None)} == {None, ""}
    kinds = sorted((r.page_id or 0, r.record_type, by_id[r.refers_to_id].page_id if r.refers_to_id else None) for r in got)
    assert kinds == [
        (0, "revisit", 1), (1, "response", None), (2, "revisit", 1), (3, "revisit", 1), (4, "response", None), (5, "response", None), (6, "response", None), (7, "response", None),
        (8, "response", None), (8, "revisit", 8), (9, "response", None), (10, "revisit", 9),
    ]


def test_archives_of_nothing(spark):
    assert warc.read_archives(warc.write_archives(spark.createDataFrame([], PAGES))).count() == 0


def good(text=b"<p>hello</p>", **fields):
    http = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(text)
    return warc.member("response", [("WARC-Record-ID", "<urn:x:1>"), ("Content-Type", "application/http; msgtype=response"), *((k.replace("_", "-"), v) for k, v in fields.items())], http + text)


def plain_member(raw):
    out = zlib.compressobj(6, zlib.DEFLATED, 31)
    return out.compress(raw) + out.flush()


def test_reader_names_broken_records():
    whole = zlib.decompress(good(), 31)
    cases = [
        (good(), None), (good(WARC_Payload_Digest="sha256:" + "0" * 64), "payload_digest"), (plain_member(whole.replace(b"hello", b"hollo")), "block_digest"),
        (plain_member(whole[:-2]), "ending"), (plain_member(whole[:-9]), "length"), (plain_member(whole + b"more than the end"), "length"), (plain_member(b"no record at all"), "header"),
        (plain_member(whole.replace(b"Content-Length: 5", b"Content-Length: x")), "header"), (plain_member(whole.replace(b"WARC/1.1", b"WERC/1.1")), "header"), (good(), None),
    ]
    got = list(warc.records(io.BytesIO(b"".join(c for c, _ in cases)), gather=True))
    assert [r["error"] for r in got] == [e for _, e in cases]
    assert [r["offset"] for r in got] == [sum(len(c) for c, _ in cases[:k]) for k in range(len(cases))]
    assert got[-1]["payload"] == b"<p>hello</p>"
    cut = list(warc.records(io.BytesIO(good() + good()[:-5])))
    assert [r["error"] for r in cut] == [None, "gzip"]
    assert [r["error"] for r in warc.records(io.BytesIO(good() + b"garbage" + good()))] == [None, "gzip"]


def test_reader_holds_a_bounded_piece():
    """Ten megabytes that compress to ten kilobytes come in pieces; folded header lines are joined."""
    raw = good(b"\0" * 10_000_000, X_Note="a\r\n b")
    part = warc._Member(warc._Source(io.BytesIO(raw)))
    sizes = []
    while piece := part.piece():
        sizes.append(len(piece))
    assert max(sizes) <= warc.CHUNK and sum(sizes) > 10_000_000
    assert next(warc.records(io.BytesIO(raw)))["payload_bytes"] == 10_000_000


def test_strict_reading_fails(spark, tmp_path):
    path = tmp_path / "bad.warc.gz"
    path.write_bytes(good() + good()[:-5])
    archives = spark.createDataFrame([(f"file://{path}",)], "archive string")
    assert [r.error for r in warc.read_archives(archives).collect()] == [None, "gzip"]
    with pytest.raises(Exception, match="broken record"):
        warc.read_archives(archives, strict=True).collect()
