import random

import pytest

from scholaspark.llm import p08_tokens as p8


@pytest.mark.parametrize("seed", range(30))
def test_chunked_encoding_equals_whole(seed):
    rng = random.Random(seed)
    parts = ["word", " ", "  ", "\n\n", "\t", "12", "'s", "…", "é", "中文", "<|endoftext|>", "a" * 90, "    x", "\U0001f600", " \n b"]
    text = "".join(rng.choice(parts) for _ in range(400))
    whole = p8.encoding().encode_ordinary(text)
    chunked = [i for x in p8.pieces(text, 60, 12) for i in p8.encoding().encode_ordinary(x)]
    assert chunked == whole
    assert p8.decode_ids(whole) == text


def test_one_pretoken_longer_than_every_overlap():
    text = "x" * 5000 + " y " + " " * 700 + "z"
    assert [i for x in p8.pieces(text, 100, 10) for i in p8.encoding().encode_ordinary(x)] == p8.encoding().encode_ordinary(text)


def test_defined_results(spark):
    df = spark.createDataFrame([(1, None, 7), (2, "", 7), (3, "a b", 7), (3, "a b", 7)], "doc_id long, text string, ids int")
    rows = sorted((r.doc_id, list(r.ids)) for r in p8.encode(df, "doc_id", "text").collect())
    assert rows == [(1, []), (2, []), (3, [64, 275]), (3, [64, 275])]
    assert p8.encode(df.limit(0), "doc_id", "text").count() == 0


@pytest.mark.parametrize("seed", range(10))
def test_long_pretokens_among_others(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["word ", "x" * rng.randint(1, 900), " " * rng.randint(1, 400), "12", "\n\n", "é"]) for _ in range(40))
    whole = p8.encoding().encode_ordinary(text)
    for chunk, overlap in ((100, 10), (64, 8), (300, 40)):
        parts = p8.pieces(text, chunk, overlap)
        assert "".join(parts) == text and [i for x in parts for i in p8.encoding().encode_ordinary(x)] == whole
