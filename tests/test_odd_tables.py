"""Queries over tables with odd rows: texts without words, and scores that lie half-way between two rounded ones. Their rows are those of the SQL."""

import pytest

from tests.oracle import connect, rows_of, sql_rows
from weftline.plans import catalogue


@pytest.fixture
def given(spark, tmp_path):
    """A query's rows, and those of its SQL, over documents of given texts, numbered from 1."""

    def both(name, texts):
        spark.createDataFrame([(k, t, "en", "src1", len(t or "")) for k, t in enumerate(texts, 1)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/made")
        part = next((tmp_path / "made").glob("*.parquet"))
        (tmp_path / "documents.parquet").symlink_to(part)
        return rows_of(catalogue.QUERIES[name](spark, str(tmp_path))), sql_rows(connect(str(tmp_path)), catalogue.ORACLE_SQL[name])

    return both


BLANK = ["", "  \n ", None, "one", "one two three"]


def test_a_share_of_no_words(given):
    got, wanted = given("legacy_filter", [*BLANK, "The first sentence has quite a number of words in it. " * 8])
    assert got == wanted and got[1] == [(1, 6)]


def test_characters_of_empty_texts(given):
    got, wanted = given("char_f1", BLANK)
    assert got == wanted and (1.0, 1) in got[1] and (0.0, 3) in got[1]


#: F1 of 621 characters of 621 and 659, of 287 of 287 and 8,673, and of 121 of 121 and 135: all end in a 5 at the seventh place.
@pytest.mark.parametrize(("both", "more"), [(621, 33), (287, 8381), (121, 9)])
def test_halves_are_rounded_as_in_sql(given, both, more):
    text = f"{'b' * more} c d {'a' * both}"
    got, wanted = given("char_f1", [text])
    assert got == wanted
