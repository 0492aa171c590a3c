import pytest
from pyspark.sql import functions as F

from scholaspark.functions import text as T
from scholaspark.functions.stem import stem


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(("value", "want"), [(None, ""), ("", ""), ("  a b\t\n", "a b"), ("a\x00b\x1fc\td", "abc\td"), (" x ", "x")])
def test_safe_value(spark, value, want):
    assert one(spark, T.safe_value, value) == want


@pytest.mark.parametrize(("value", "want"), [(None, None), ("á  b\n\n\n\nc\x07 ", "á b\n\nc"), ("​a\tb", "a\tb"), ("   ", "")])
def test_prepared(spark, value, want):
    assert one(spark, T.prepared, value) == want


PAPER = "arXiv:2301.00001v1\nOn Old Mills\nAnna Smith, Bo Jones and Cy Lee\n\nAbstract\nMills are\nold.\n\n1 Introduction\nThey grind.\n\n2. Method\nWe look at re-\nmains.\f\n\n\n\nEnd 2019."


def test_paper_parts(spark):
    assert one(spark, T.title_of, PAPER) == "On Old Mills Anna Smith, Bo Jones and Cy Lee"
    assert one(spark, T.authors_of, PAPER) == ["Anna Smith", "Bo Jones", "Cy Lee"]
    assert one(spark, T.abstract_of, PAPER) == "Mills are old."
    assert [(s.heading, s.text) for s in one(spark, T.sections_of, PAPER)] == [("Introduction", "They grind."), ("Method", "We look at re-\nmains.\f\n\n\n\nEnd 2019.")]
    assert "remains.\n\nEnd" in one(spark, T.reading_text, PAPER)


@pytest.mark.parametrize(("doc_id", "text", "want"), [("2301.00001", "", 2023), ("9901.1", "", 1999), ("x", "in 2014 or 2020", 2014), ("x", "none", None), ("x", None, None)])
def test_year(spark, doc_id, text, want):
    df = spark.createDataFrame([(doc_id, text)], "d string, t string")
    assert df.select(T.year_of(F.col("d"), F.col("t")).alias("y")).first().y == want


def test_empty_parts(spark):
    for f, want in ((T.title_of, ""), (T.authors_of, []), (T.abstract_of, ""), (T.sections_of, [])):
        assert one(spark, f, "") == want and one(spark, f, None) == want


@pytest.mark.parametrize(("chunk", "first", "last"), [("a__chunk_3", "a", "a"), ("v__x_1__chunk_0", "v", "v__x_1"), ("plain", "plain", "plain"), ("a__chunk_1__chunk_2", "a", "a__chunk_1")])
def test_chunk_ids(spark, chunk, first, last):
    assert one(spark, T.doc_of_chunk, chunk) == first and one(spark, T.doc_of_chunk_last, chunk) == last


def test_stems():
    pairs = "caresses caress ponies poni ties tie cats cat feed feed agreed agre plastered plaster motoring motor conflated conflat hopping hop falling fall failing fail filing file happy happi sky sky relational relat valency valenc digitizer digit operator oper formality formal triplicate triplic hopeful hope goodness good revival reviv allowance allow adoption adopt activate activ probate probat rate rate cease ceas controlling control"
    words = pairs.split()
    assert [stem(w) for w in words[::2]] == words[1::2]
