import pytest
from pyspark.sql import functions as F

from tessellum.functions import text as T
from tessellum.functions import vectors as V


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


def test_chunks(spark):
    df = spark.createDataFrame([(1, "x" * 2000), (2, ""), (3, None), (4, "y" * 800), (5, "z" * 801)], "id int, text string")
    got = {}
    for r in T.chunk(df).collect():
        got.setdefault(r["id"], []).append((r["chunk_start"], r["chunk_end"], len(r["body"])))
    assert sorted(got[1]) == [(0, 800, 800), (700, 1500, 800), (1400, 2000, 600)]
    assert 2 not in got and 3 not in got and got[4] == [(0, 800, 800)] and len(got[5]) == 2
    with pytest.raises(ValueError):
        T.chunk(df, size=10, overlap=10)


def test_terms(spark):
    assert one(spark, "foo ab bar", T.substring_terms) == ["foo", "bar"]
    assert one(spark, "How does (paginate) the list. work, PAGINATE?", T.keyword_terms) == ["paginate", "list.", "work"]
    assert one(spark, "", T.keyword_terms) == []
    assert one(spark, "'paginate' now, _x$ ...", T.word_terms) == ["paginate", "now", "_x$"]
    assert one(spark, "Éa_b foo.bar", T.index_tokens) == ["ea_b", "foo", "bar"]
    assert [one(spark, w, T.is_identifier) for w in ("fooBar", "a1", "x_y", "plain", "Title")] == [True, True, True, False, False]


def test_small_functions(spark):
    assert one(spark, "abc", T.fnv1a) == 440920331
    assert tuple(one(spark, "find repo:core retry", T.parse_hint)) == ("gh:core", "find retry")
    assert one(spark, "First one. Second.", T.lead_sentence) == "First one."
    assert one(spark, "&amp;lt; &nbsp;x", T.decode_entities) == "&lt;  x"
    assert [one(spark, x, T.is_refusal) for x in ("  NO_ANSWER: none", "", "yes", None)] == [True, True, False, True]
    assert one(spark, "One fact here. Ok. Another longer fact;\nlast line there", T.statements) == ["One fact here.", "Another longer fact;", "last line there"]
    assert one(spark, "getUserName of THE user", T.eval_tokens) == ["get", "user", "name", "user"]
    snip = spark.createDataFrame([("a" * 300 + " needle " + "b" * 300,)], "b string").select(T.snippet(F.col("b"), F.lit("needle"))).first()[0]
    assert "「needle」" in snip and snip.startswith("…") and snip.endswith("…")
    assert T.shard_file("gh:Org/Repo").startswith("gh-org-repo-")


def test_vectors(spark):
    assert abs((V.hash_embedding("hello world") ** 2).sum() - 1) < 1e-5 and not V.hash_embedding("").any()
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [1.0, 1.0]), (5, None)], "vec_id bigint, embedding array<float>")
    q = spark.createDataFrame([(7, [1.0, 0.1]), (8, [1.0, 1.0])], "query_id bigint, embedding array<float>")
    got = V.top_similar(rows, q, 2).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in got] == [(7, 1), (7, 3), (8, 3), (8, 4)]
    many = V.top_similar(rows, q, 2, batch_queries=1).orderBy("query_id", "rank").collect()
    assert [tuple(r)[:2] for r in many] == [tuple(r)[:2] for r in got]
    assert one(spark, "abc", lambda x: V.cosine(F.array(F.lit(1.0)), F.array(F.lit(0.0)))) == 0
    assert V.embed(spark.createDataFrame([(None,), ("abcd",)], "t string"), "t", 16).count() == 2
