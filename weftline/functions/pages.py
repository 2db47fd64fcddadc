"""Articles of news pages by the places where their parts stand; parsing runs in Arrow batches."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType, StructField, StructType

ARTICLE = StructType([StructField(n, StringType()) for n in ("headline", "date", "content")])
#: Where parts stand, best place first: a tag, and a class or None.
HEADLINES = (("h1", "news-heading"), ("h1", None))
DATES = (("p", "news-datestamp"), ("time", None))
BODIES = (("div", "news-content"), ("div", "story-text"), ("div", "news-body"), ("article", None))


class _Places(HTMLParser):
    """Texts by place: for headlines and dates the element's text, for bodies the texts of their paragraphs."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, frozenset]] = []
        self.found: dict[tuple, list[str]] = {}
        self.paragraph: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "p":
            self._end_paragraph()
            self.paragraph = []
        if tag in ("h1", "p", "time", "div", "article", "script", "style"):
            names = frozenset((dict(attrs).get("class") or "").split())
            if tag == "p":
                self.open = [o for o in self.open if o[0] != "p"]  # a paragraph ends where the next begins
            self.open.append((tag, names))
            for place in HEADLINES + DATES:
                if self._is(place, tag, names):
                    self.found.setdefault(place, []).append("")

    def handle_endtag(self, tag):
        if tag in ("p", "div", "article"):
            self._end_paragraph()
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                break

    def handle_data(self, data):
        if any(t in ("script", "style") for t, _ in self.open):
            return
        for place in HEADLINES + DATES:
            if any(self._is(place, t, names) for t, names in self.open):
                self.found[place][-1] += data
        if self.paragraph is not None:
            self.paragraph.append(data)

    @staticmethod
    def _is(place, tag, names):
        return place[0] == tag and (place[1] is None or place[1] in names)

    def _end_paragraph(self):
        text = " ".join("".join(self.paragraph or []).split())
        if text:
            for place in BODIES:
                if any(self._is(place, t, names) for t, names in self.open):
                    self.found.setdefault(place, []).append(text)
        self.paragraph = None

    def best(self, places) -> list[str]:
        return next((self.found[p] for p in places if any(x.strip() for x in self.found.get(p, []))), [])


@pandas_udf(ARTICLE)
def article_of(html: pd.Series) -> pd.DataFrame:
    """headline, date and paragraphs joined by line breaks; '' where a page has none."""
    rows = []
    for page in html:
        p = _Places()
        p.feed(page or "")
        p.close()
        p._end_paragraph()
        first = [" ".join((p.best(places) or [""])[0].split()) for places in (HEADLINES, DATES)]
        rows.append((*first, "\n".join(p.best(BODIES))))
    return pd.DataFrame(rows, columns=["headline", "date", "content"])
