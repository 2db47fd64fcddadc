import pytest
from pyspark.sql import functions as F

from tests.llm.test_dedup import docs, prose
from tests.oracle import connect, rows_of, sql_rows
from weftline.llm import queries
from weftline.llm.html_text import _Lines, extract, main_text
from weftline.llm.licenses import TEMPLATES, scan
from weftline.llm.mixing import mix, source_targets

LONG = "A long line of the article that says much about the matter and goes on for a while."
PAGES = [
    ("", ""),
    (None, ""),
    ("<p>plain", "plain"),
    (f"<nav><a href=x>Home</a></nav><article><h1>T &amp; U</h1><p><b>{LONG}<br><p>Short.</p></article><footer>&copy;</footer>", f"T & U\n{LONG}\nShort."),
    (f"<article><h1>T</h1><p>One\n two&nbsp;three</p><div class='ad-box'>buy</div><form><input>Name</form><section class=comments><p>{LONG}</p></section><p>{LONG}", f"T\nOne two three\n{LONG}"),
    (f"<body><div id=menu>m</div><div id=content><h2>H</h2><p>{LONG}</p><p>x &lt; y</p><p>{LONG}</p></div><div class='sidebar'>{LONG}</div></body>", f"H\n{LONG}\nx < y\n{LONG}"),
    (f"<script>var a = '<p>{LONG}</p>';</script><style>p{{}}</style><main><p>{LONG}</p></main><aside><p>{LONG}</p></aside>", LONG),
    (f"<article><p>{LONG}</p><article class='comment'><p>reader</p></article></article>", LONG),
    ("<ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul>", ""),
]


def test_extraction_cases(spark):
    rows = [(k, f"http://x/{k}", html) for k, (html, _) in enumerate(PAGES)] + [(99, "u", "<p>word " + "word " * 50000)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("other"))
    got = {r.page_id: r for r in extract(frame).collect()}
    for k, (_, want) in enumerate(PAGES):
        assert got[k].text == want and got[k].n_chars == len(want)
    assert got[99].n_chars == 5 * 50001 - 1 and extract(frame.limit(0)).count() == 0


LAYOUTS = "content with-sidebar|site has-sidebar|no-sidebar|post-content no-comments|search-results|elementor-widget-theme-post-content|hfeed comments-open".split("|")
SPARED = [(f"<div class='{c}'><article><h1>T</h1><p>{LONG}</p></article></div><div class='sidebar'><p>{LONG}</p></div>", f"T\n{LONG}") for c in LAYOUTS]
SPARED += [(f"<body><section class='{c}'><p>{LONG}</p><p>{LONG}</p></section><div class=sidebar><p>{LONG}</p></div></body>", f"{LONG}\n{LONG}") for c in LAYOUTS]
SPARED += [
    (f"<article><h1>T</h1><div class='widget-post-content'><p>{LONG}</p><div class=ad>buy</div></div></article>", f"T\n{LONG}"),
    (f"<article><p>{LONG}</p></article><div class=comments><article><p>{LONG} {LONG}</p></article></div>", LONG),
    (f"<article><p>{LONG}</p><div class=comments><p>{LONG}</p><p>{LONG}</p></div></article>", LONG),
    (f"<div id=content><p>{LONG}</p><p>{LONG}</p></div><div class=related><article><p>{LONG}</p></article></div>", f"{LONG}\n{LONG}"),
    (f"<article><p class='ad'>buy<p>{LONG}</p><p hidden>secret</p><ul><li class=ad>x<ul><li>y</li></ul>z<li>kept</ul><p>Short.</article>", f"{LONG}\nkept\nShort."),
    (f"<body><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p><p>The end.</p></body>", f"{LONG}\n{LONG}\n{LONG}\nThe end."),
    # Forms around the whole page, and forms inside it.
    (f"<form id='aspnetForm'><nav>menu</nav><article><h1>T</h1><p>{LONG}</p></article><form><p>Your name</p></form></form>", f"T\n{LONG}"),
    (f"<form id='aspnetForm'><div id=c><p>{LONG}</p><p>{LONG}</p><form class=search><p>Find</p></form></div></form>", f"{LONG}\n{LONG}"),
    (f"<article><p>{LONG}</p><form><p>Your name and mail</p></form><p>{LONG}</p></article><form><p>{LONG}</p></form>", f"{LONG}\n{LONG}"),
    (f"<article><p>{LONG}</p><form><p>Your name<article><p>no article</p></article></form><p>{LONG}</p></article>", f"{LONG}\n{LONG}"),
]


@pytest.mark.parametrize("html,want", SPARED)
def test_elements_that_hold_the_article_are_spared(html, want):
    assert main_text(_Lines(), html) == want


LINKS = "".join(f"<p><a href=/{k}>Another story of the day, number {k}</a></p>" for k in range(4))
METHOD = [
    # A list of links without a class, below the article's text and inside its element.
    (f"<article><h1><a href=/>T</a></h1><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p><p>See <a href=/s>this and that page</a></p>{LINKS}</article>", f"T\n{LONG}\n{LONG}\n{LONG}\nSee this and that page"),
    # Short lines in an article element, more in all than the text, which is in none.
    (f"<div><article>{''.join(f'<p>Ticker {k} up</p>' for k in range(60))}</article></div><div>{''.join(f'<p>{LONG}</p>' for _ in range(8))}</div>", "\n".join([LONG] * 8)),
]
UNCLOSED = [
    (f"<body><nav><ul><li><a href=/>Home</a></ul><article><p>{LONG}</p></article></body>", LONG),
    (f"<body><aside>Advert<div id=content><p>{LONG}</p><p>{LONG}</p></div></body>", f"{LONG}\n{LONG}"),
    (f"<div><header><h2>Site</h2><main><p>{LONG}</p></main></div>", LONG),
    (f"<nav><div>Menu</div></nav><article><p>{LONG}</p></article>", LONG),
]


@pytest.mark.parametrize("html,want", METHOD + UNCLOSED)
def test_content_regions(html, want):
    assert main_text(_Lines(), html) == want


def test_clusters_select_the_text(monkeypatch):
    from weftline.llm import html_text

    monkeypatch.setattr(html_text, "upper_cluster", lambda values: html_text.np.ones(len(values), bool))
    assert all(main_text(_Lines(), html) != want for html, want in METHOD)


def test_extraction_of_repeated_rows_and_nulls(spark):
    rows = [(1, None, f"<p>{LONG}"), (1, None, f"<p>{LONG}"), (None, "u", None)]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, None, LONG, len(LONG))] * 2 + [(None, "u", "", 0)], key=repr)


def targets_by_hand(sizes, weights=(5.0, 2.0, 1.0)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 2.0 * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [{"a": 10}, {"a": 1000, "b": 10, "c": 30, None: 5}, {"z": 7, "é": 900, "A": 0, "b": 300, "c": 20, "d": 5000}, {"a": 0, "b": 0}])
def test_targets(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in source_targets(frame).collect()}
    want = targets_by_hand(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_mix_meets_targets(spark):
    rows = [(k, prose(k, 5 + k % 60), "en", ["hot", "b", None][0 if k % 3 else 1 + k % 2], 0) for k in range(600)] + [(900, None, "en", "b", 0), (901, "", "en", "hot", 0), (5, "twice here", "en", "hot", 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"key": F.lit(1), "size": F.lit("x")})
    out = mix(frame).collect()
    assert len(out) == len(rows) and sorted(map(tuple, mix(frame.repartition(9)).collect())) == sorted(map(tuple, out))
    for target in {r.target for r in out}:
        mine = [r for r in out if r.target == target]
        assert abs(sum(r.taken for r in mine) - target) <= max(r.size for r in mine)
        assert all(r.taken in (r.epochs * r.size, 0) and r.taken <= 2 * r.size for r in mine)
    assert mix(frame.limit(0)).count() == 0


def brute_mix(rows, target, quality):
    """doc_id to copies, for one source."""
    import hashlib
    import math

    keyed = []
    for i, text in rows:
        u = (int(hashlib.md5(f"42|{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        keyed.append((-math.log(u) / quality, i, len(text.split())))
    whole, total = int(target // sum(n for *_, n in keyed)), sum(n for *_, n in keyed)
    rest, upto, out = target - whole * total, 0, {}
    for _, i, n in sorted(keyed):
        upto += n
        out[i] = whole + (rest > 0 and upto - n / 2 <= rest)
    return out


def test_mix_cuts_large_bins_again(spark):
    rows = [(k, " ".join(["слово"] * (1 + k % 9)), "ru", "s", 0) for k in range(2000)] + [(5000 + k, "х" * 40_000, "ru", "s", 0) for k in range(2)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = None
    for sorted_rows in (100_000, 20, 1):  # no letter from A to Z: the last of 4096 bins has 43 % of the rows
        out = mix(frame, sorted_rows=sorted_rows).collect()
        want = want or brute_mix([(r[0], r[1]) for r in rows], out[0].target, 0.1)
        assert {r.doc_id: r.epochs for r in out} == want


def test_licenses_of_many_notices_and_repeated_rows(spark):
    notice = TEMPLATES["MIT-grant"]
    many = " ".join(f"{notice} w{k}" for k in range(400))
    rows = [(1, many), (2, prose(1, 9) + " " + notice), (2, prose(1, 4) + " " + notice), (3, notice[len("Permission is ") :]), (4, TEMPLATES["MIT"] + " " + TEMPLATES["MIT"])]
    got = {(r.doc_id, r.license): (round(r.containment, 3), r.first_word) for r in scan(docs(spark, rows)).collect()}
    n = len(notice.split()) - 4
    assert got[1, "MIT-grant"] == (1.0, 0) and got[2, "MIT-grant"] == (1.0, 4) and got[3, "MIT-grant"] == (round((n - 2) / n, 3), 0) and got[4, "MIT"] == (1.0, 0)


def test_licenses_found_where_they_stand(spark):
    rows = [(k, f"{prose(k, 30)}\n{text.upper()} {prose(k + 1, 7)}") for k, text in enumerate(TEMPLATES.values())]
    rows += [(100, None), (101, ""), (102, "license"), (103, prose(1, 20000) + " " + TEMPLATES["MIT"]), (104, TEMPLATES["GPL-3.0"].replace("version 3.", "version 2.")), (105, "permission is hereby granted")]
    got = {(r.doc_id, r.license): r for r in scan(docs(spark, rows).withColumn("shingles", F.lit(1))).collect()}
    for k, name in enumerate(TEMPLATES):
        assert got[k, name].containment == 1.0 and got[k, name].first_word == 30
    assert got[103, "MIT"].first_word == 20000 and abs(got[104, "GPL-3.0"].containment - 7 / 8) < 0.04
    assert not {i for i, _ in got} & {100, 101, 102, 105} and scan(docs(spark, [])).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_match_sql(spark, sf_dir, name):
    assert rows_of(queries.QUERIES[name](spark, sf_dir)) == sql_rows(connect(sf_dir), queries.ORACLE_SQL[name])
