import random

import numpy as np
from pyspark.sql import functions as F

from scholaspark.operators import chunking as C
from scholaspark.operators import documents as D
from scholaspark.operators import vectors as V

DOC = "doc_id string, text string, title string, authors array<string>, categories array<string>, year int, position int"


def docs(spark):
    rows = [("a", "x", "Deep Claims", ["Ann Lee"], ["cs.LG"], 2020, 9), ("b", None, "claims", None, None, None, 9), ("c", "", None, ["Bo"], ["math"], 2020, 9), ("b", None, "claims", None, None, None, 9)]
    return spark.createDataFrame(rows, DOC)


def test_search(spark):
    got = D.search_by_title(docs(spark), "CLAIM", 2).collect()
    assert [(r.doc_id, r.position) for r in got] == [("b", 0), ("b", 0)]
    assert [r.doc_id for r in D.search_by_title(docs(spark), "claim").collect()] == ["b", "b", "a"]
    assert [r.doc_id for r in D.search_by_metadata(docs(spark), 2020, "CS.", "lee").collect()] == ["a"]
    assert D.search_by_metadata(docs(spark), category="x").count() == 0
    assert D.search_by_title(docs(spark).limit(0), "x").count() == 0


def test_first_loads_and_manifest(spark):
    df = spark.createDataFrame([("k", 2, "late"), ("k", 1, "early"), (None, 1, "n"), (None, 0, "m")], "doc_id string, t int, v string")
    assert {(r.doc_id, r.v) for r in D.first_loads(df, ["doc_id"], [F.col("t")]).collect()} == {("k", "early"), (None, "m")}
    manifest = D.manifest_of(df)
    assert [r.doc_id for r in manifest.collect()] == ["k"]
    assert D.not_indexed(docs(spark), D.manifest_of(docs(spark).where("doc_id = 'b'"), manifest)).select("doc_id").distinct().count() == 2


def test_windows_cover_and_overlap(spark):
    text = " ".join(f"word{i}" for i in range(300))
    df = spark.createDataFrame([("d", text, "t"), ("n", None, None), ("e", "", "t")], "doc_id string, text string, title string")
    rows = sorted(C.chunk(df, 50, 10).collect(), key=lambda r: r["index"])
    coder = C.encoding("/opt/tokenizers", "byte_bpe_50k.tiktoken")
    tokens = coder.encode_ordinary(text)
    assert [r.chunk_id for r in rows][:2] == ["d__chunk_0", "d__chunk_1"] and {r.doc_id for r in rows} == {"d"}
    assert [r.text for r in rows] == [coder.decode(tokens[i : i + 50]) for i in range(0, len(tokens), 40)]
    assert sum(r.n_tokens for r in rows) >= len(tokens)
    counts = {r.doc_id: r.n_tokens for r in C.token_counts(df, "doc_id", "text").collect()}
    assert counts == {"d": len(tokens), "n": 0, "e": 0}


def test_vector_search_against_numpy(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 6)).astype(np.float32)
    base[10] = base[11]
    base[20] = 0
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(100, None), (101, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "id int, embedding array<float>")
    asked = df.where("id < 5 or id = 10").select(F.col("id").alias("query_id"), "embedding").union(spark.createDataFrame([(None, None)], "query_id int, embedding array<float>"))
    unit = base.astype(float) / np.where(np.linalg.norm(base, axis=1) > 0, np.linalg.norm(base.astype(float), axis=1), 1)[:, None]
    for limit in (10**7, 100):
        monkeypatch.setattr(V, "get_settings", lambda limit=limit: type("S", (), {"broadcast_bytes": limit, "embedding_dim": 8})())
        got = {(r.query_id, r["rank"]): (r.id, round(r.score, 6)) for r in V.search(df, asked, 4).collect()}
        for q in (0, 1, 2, 3, 4, 10):
            s = unit @ unit[q]
            want = sorted(range(60), key=lambda i: (-round(s[i], 12), i))[:4]
            assert [got[q, k + 1] for k in range(4)] == [(i, round(float(s[i]), 6)) for i in want]
        assert len(got) == 24
    assert V.search(df, asked.limit(0), 4).count() == 0


def test_hashed_embedding(spark):
    df = spark.createDataFrame([(1, "Red red wine"), (2, "wine RED red"), (3, None), (4, "")], "i int, t string")
    got = {r.i: list(r.v) for r in df.select("i", V.hashed_embedding(F.col("t"), 16).alias("v")).collect()}
    assert got[1] == got[2] and abs(sum(x * x for x in got[1]) - 1) < 1e-5 and set(got[3]) == set(got[4]) == {0.0}


def test_first_loads_with_shared_places(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(rng.choice([None, *(f"k{i}" for i in range(200))]), rng.choice([None, *range(5)]), n) for n in range(400)]
    df = spark.createDataFrame(rows, "k string, at int, n int")
    want = {}
    for k, at, n in rows:
        place = (-1 if at is None else at, n)
        want[k] = min(want.get(k, place), place)
    for bits in (6, 25):
        monkeypatch.setattr(D, "MAP_BITS", bits)
        got = D.first_loads(df, ["k"], [F.col("at"), F.col("n")]).collect()
        assert len(got) == len(want) and {r.k: (-1 if r.at is None else r.at, r.n) for r in got} == want
    assert D.first_loads(df.limit(0), ["k"], [F.col("n")]).count() == 0


def test_vector_index_recall(spark, monkeypatch):
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(30, 16))
    rows = [(i, (middles[i % 30] + 0.4 * rng.normal(size=16)).tolist()) for i in range(1500)] + [(9000 + i, [1.0] * 16) for i in range(500)] + [(1, None), (9999, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    asked = df.where("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")
    exact = {(r.query_id, r.id) for r in V.search(df, asked, 5).collect()}
    for slice_ in (50_000, 40):
        monkeypatch.setattr(V.VectorIndex, "SLICE", slice_)
        index = V.VectorIndex.build(df)
        assert index.cells.count() == 2000
        got = index.search(asked, 5)
        assert got.groupBy("query_id").count().where("count > 5").count() == 0
        assert len({(r.query_id, r.id) for r in got.collect()} & exact) >= 0.9 * len(exact)
    assert V.VectorIndex.build(df.limit(0)).search(asked).count() == 0


def test_metadata_of_chunks(spark):
    rows = [("a", "some words", "Title", "f.txt", [("One", "x"), (None, "y")], {"title": "Own", "k": "v"}), ("b", "more words", None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id string, text string, title string, source_file string, sections array<struct<heading string, text string>>, metadata map<string,string>")
    got = {r.doc_id: r.metadata for r in C.chunk(df).collect()}
    assert got == {"a": {"title": "Own", "doc_id": "a", "source_file": "f.txt", "sections": '["One",null]', "k": "v"}, "b": {"title": "", "doc_id": "b"}}
