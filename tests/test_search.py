import sqlite3

import pytest
from pyspark.sql import functions as F

from tessellum.operators import graph, routing, search

TEXTS = [("alpha", "the quick brown fox paginates lists"), ("beta", "Paginate now: paginateNow(list) café naïve"), ("gamma fox", "nothing to see aaaa aaa"), ("delta", "quick quick quick fox"), ("epsilon", "a b c"), ("zeta", "brown bread and the lists of lists")]


@pytest.fixture(scope="module")
def atoms(spark):
    rows = [(i + 1, "s1" if i % 2 else "s2", "g", "c1" if i < 3 else "c2", t, b) for i, (t, b) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "id bigint, shard_key string, graph string, cluster string, title string, body string").persist()


def ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id bigint, query string")


def fts(tokenizer, match):
    con = sqlite3.connect(":memory:")
    con.execute(f"CREATE VIRTUAL TABLE f USING fts5(title, body, tokenize=\"{tokenizer}\")")
    con.executemany("INSERT INTO f(title, body) VALUES (?, ?)", TEXTS)
    return dict(con.execute("SELECT rowid, bm25(f, 2.0, 1.0) FROM f WHERE f MATCH ?", (match,)).fetchall())


@pytest.mark.parametrize("text", ["fox", "quick", "aaa", "list", "brown fox", "PAGINATE", "zzz"])
def test_substring_lane_is_the_index_formula(spark, atoms, text):
    got = {r["id"]: r["score"] for r in search.substring_lane(atoms, ask(spark, text)).collect()}
    want = fts("trigram", " ".join(f'"{w}"' for w in text.split()))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


@pytest.mark.parametrize("text,match", [("fox", '"fox"'), ("quick", '"quick" *'), ("cafe", '"cafe" *'), ("list brown", '"list" * AND "brown" *')])
def test_word_lane_is_the_index_formula(spark, atoms, text, match):
    got = {r["id"]: r["score"] for r in search.word_lane(atoms, ask(spark, text)).collect()}
    want = fts("unicode61 remove_diacritics 2 tokenchars '_$'", match)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_word_phrase_with_prefix(spark):
    rows = [(1, "", "foo.barbaz"), (2, "", "foo barn"), (3, "", "foo x bar"), (4, "", "bar foo")]
    atoms = spark.createDataFrame(rows, "id bigint, title string, body string")
    assert {r["id"] for r in search.word_lane(atoms, ask(spark, "foo.bar")).collect()} == {1, 2}


def test_filters_keep_scores_and_ignored_terms(spark, atoms):
    hits = search.substring_lane(atoms, ask(spark, "fox", "ab", ""))
    scoped = search.scope(hits, atoms, F.col("cluster") == "c1")
    every = {r["id"]: r["score"] for r in hits.collect()}
    assert {r["id"]: r["score"] for r in scoped.collect()} == {k: v for k, v in every.items() if k <= 3}
    assert {r["query_id"] for r in hits.collect()} == {0}


def test_rrf_golden(spark):
    lists = [("a", "x", 1), ("a", "y", 2), ("b", "z", 1), ("b", "x", 2), ("c", "10", 1), ("d", "9", 1)]
    df = spark.createDataFrame([(1, *r) for r in lists], "query_id int, lane string, id string, rank int")
    got = search.rrf(df, ["query_id"], "id").orderBy("fused_rank").collect()
    assert [r["id"] for r in got] == ["x", "10", "9", "z", "y"]
    assert abs(got[0]["rrf_score"] - (1 / 61 + 1 / 62)) < 1e-12 and got[0]["sources"] == "a,b"


def test_hybrid_weighs_identifiers_and_per_index_statistics(spark, atoms):
    got = search.hybrid(atoms, ask(spark, "paginateNow list", "fox")).collect()
    assert min((r for r in got if r["query_id"] == 0), key=lambda r: r["fused_rank"])["id"] == 2
    assert {r["id"] for r in got if r["query_id"] == 1} == {1, 3, 4}
    per = search.substring_lane(atoms, ask(spark, "quick"), per=("shard_key",)).collect()
    alone = search.substring_lane(atoms.where("shard_key = 's1'"), ask(spark, "quick")).collect()
    assert {r["id"]: r["score"] for r in per if r["shard_key"] == "s1"} == {r["id"]: r["score"] for r in alone}


def test_expansion(spark):
    hits = spark.createDataFrame([(1, 1, 0.02, "word", 1), (1, 2, 0.005, "word", 2)], "query_id int, id bigint, rrf_score double, sources string, fused_rank int")
    edges = spark.createDataFrame([(1, 2, "t", 1.0), (2, 3, "t", 1.0), (1, 4, "u", 0.5)], "src bigint, dst bigint, edge_type string, weight double")
    plain = {r["id"]: r for r in search.expand_edges(hits, edges).collect()}
    assert plain[2]["rrf_score"] == 0.01 and plain[2]["sources"] == "word,edge" and plain[3]["rrf_score"] == 0.0025 and plain[4]["sources"] == "edge"
    ordered = {r["id"]: r for r in search.expand_in_order(hits, edges).collect()}
    assert ordered[3]["rrf_score"] == 0.005 and ordered[2]["rrf_score"] == 0.01


def shards(spark):
    rows = [("gh:pay", "payments", ["invoice", "ledger"], "ACTIVE", 3), ("gh:auth", "auth", ["token", "session"], "ACTIVE", 2), ("gh:old", "old", ["invoice"], "EVICTED", 1), ("gh:web", "web", ["button"], "ACTIVE", 9)]
    return spark.createDataFrame(rows, "shard_key string, display_name string, routing_terms array<string>, status string, updated_at int")


def test_routing(spark):
    got = {}
    for r in routing.route(shards(spark), ask(spark, "invoice ledger total", "repo:auth anything", "unrelated words", "session token"), fallback=2).orderBy("route_rank").collect():
        got.setdefault(r["query_id"], []).append((r["shard_key"], r["pinned"]))
    assert got[0][0] == ("gh:pay", False) and got[1] == [("gh:auth", True)]
    assert [s for s, _ in got[2]] == ["gh:web", "gh:pay"] and got[3][0][0] == "gh:auth"


def test_interleave_and_waves(spark):
    lists = spark.createDataFrame([(1, 0, "a", 1), (1, 0, "b", 2), (1, 1, "b", 1), (1, 1, "c", 2)], "query_id int, term_pos int, shard_key string, rank int")
    got = {r["shard_key"]: r["route_rank"] for r in routing.interleave(lists).collect()}
    assert got == {"a": 1, "b": 2, "c": 3}
    routed = spark.createDataFrame([(1, f"s{i}", i) for i in range(1, 10)] + [(2, "s1", 1)], "query_id int, shard_key string, route_rank int")
    hits = spark.createDataFrame([(1, "s6")], "query_id int, shard_key string")
    kept = routing.waves(routed, hits).collect()
    assert {r["shard_key"] for r in kept if r["query_id"] == 1} == {f"s{i}" for i in range(1, 9)} and sum(r["query_id"] == 2 for r in kept) == 1
    assert routing.waves(routed, hits, strict=True).count() == 10


def test_federated(spark, atoms):
    s = spark.createDataFrame([("s1", "one", ["quick"], "ACTIVE", 1), ("s2", "two", ["brown", "fox"], "ACTIVE", 2)], "shard_key string, display_name string, routing_terms array<string>, status string, updated_at int")
    hits, diagnostics = routing.federated(atoms, s, ask(spark, "quick fox"), strict=True)
    assert {r["id"] for r in hits.collect()} >= {1, 4}
    assert diagnostics.first()["pinned"] is False and diagnostics.first()["stragglers"] == []


def test_context(spark):
    rows = [(1, "s", "f", 0, "A" * 200, 2), (1, "s", "f", 1, "A" * 100 + "B" * 50, 1), (1, "s", "f", 1, "dup", 5), (1, "s", "f", 3, "C" * 40, 3), (1, "s", "g", 0, "D" * 9000, 4)]
    hits = spark.createDataFrame(rows, "query_id int, shard_key string, origin_file string, chunk_index int, body string, rank int")
    blocks = graph.assemble_context(hits, 200).orderBy("block").collect()
    assert blocks[0]["header"] == "### s · f · chunks 0–1" and blocks[0]["body"] == "A" * 200 + "B" * 50
    assert len(blocks) == 2 and blocks[0]["truncated"] and blocks[-1]["tokens_used"] <= 200
    assert len(graph.assemble_context(hits, 1).collect()) == 1


def test_edges(spark, atoms):
    nodes = atoms.withColumn("graph", F.when(F.col("id") == 6, "other").otherwise("g"))
    new = spark.createDataFrame([(1, 2, "t", None, 1), (1, 2, "t", 0.3, 2), (1, 6, "t", 1.0, 3), (1, 99, "t", 1.0, 4)], "src bigint, dst bigint, edge_type string, weight double, seq int")
    good, bad = graph.check_edges(nodes, new)
    assert {r["reason"] for r in bad.collect()} == {"two graphs", "no destination"}
    merged = graph.upsert_edges(new.limit(0).select("src", "dst", "edge_type", "weight"), good)
    assert [tuple(r) for r in merged.collect()] == [(1, 2, "t", 0.3)]
    near = graph.neighbours(nodes, merged, nodes, "both").collect()
    assert {(r["node"], r["direction"]) for r in near} == {(1, "out"), (2, "in")}
    assert graph.edges_of(merged, nodes.where("id = 2")).count() == 1 and graph.delete_edges(merged, merged).count() == 0


def test_summaries(spark, atoms):
    rows = {r["cluster"]: r for r in graph.summaries(atoms).collect()}
    assert rows["c1"]["title"] == "c1 · 3 atoms" and " … " in rows["c1"]["summary"]
    names = atoms.select("cluster").distinct().withColumn("cluster_id", F.col("cluster"))
    routed = graph.route_to_clusters(graph.summary_terms(atoms), names, ask(spark, "quick fox", "zzz")).collect()
    assert [r["cluster"] for r in sorted((r for r in routed if r["query_id"] == 1), key=lambda r: r["rank"])] == ["c1", "c2"]
