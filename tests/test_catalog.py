"""The catalog's operators, the crawl into a federation, and the evaluation's generators."""

import numpy as np
from pyspark.sql import functions as F

from tessellum.api import Federation
from tessellum.functions import vectors
from tessellum.operators import catalog, routing, search
from tessellum.plans import evaluate
from tessellum.sources.connectors import FileTree


def test_crawl_crash_resume_and_cascade(spark, tmp_path):
    tree = tmp_path / "tree"
    (tree / "docs").mkdir(parents=True)
    for i in range(60):
        (tree / "docs" / f"a{i:02d}.md").write_text(f"invoice ledger number {i} is settled. " * 30)
    f = Federation(spark, str(tmp_path / "org"))
    source = FileTree(spark, str(tree))
    try:
        f.crawl(source, "tree:one", crash_after=1)
    except RuntimeError:
        pass
    assert f.documents().count() == 50 and f.checkpoints().count() == 0
    report = f.crawl(source, "tree:one")
    assert (report["mode"], report["documents"], report["skipped"]) == ("full", 60, 50) and f.documents().count() == 60
    assert [r["name"] for r in f.catalog().first()["clusters"]] == ["docs"] and f.catalog().first()["status"] == "ACTIVE"
    assert f.integrity().first()["ok"]
    first = f.atoms().where("chunk_index = 0").orderBy("source_key").limit(3).collect()
    f.add_edges(spark.createDataFrame([(first[0]["id"], first[1]["id"], "t", 1.0), (first[1]["id"], first[2]["id"], "t", 1.0)], "src bigint, dst bigint, edge_type string, weight double"))
    (tree / first[0]["source_key"]).unlink()
    (tree / "docs" / "a59.md").write_text("a new text about tokens")
    again = f.crawl(source, "tree:one")
    assert (again["mode"], again["documents"], again["deleted"]) == ("delta", 1, 1)
    assert f.documents().count() == 59 and f.edges().count() == 1
    assert f.delete_edges(f.edges().select("src", "dst", "edge_type")) == 1 and f.delete_edges(f.edges().select("src", "dst", "edge_type")) == 0
    asked = spark.createDataFrame([(1, "new text about tokens")], "query_id int, query string")
    assert f.node(f.vector_topk(asked, 1).first()["id"]).first()["source_key"] == "docs/a59.md" == f.document("docs/a59.md").first()["source_key"]
    assert f.hybrid(asked, 3, with_vectors=True).where("sources LIKE '%vector%'").count() == 3

    class Broken:
        def crawl(self, cursor):
            raise OSError("no disk")

    reports = f.crawl_org({"tree:one": source, "tree:two": Broken()})
    assert reports[0]["documents"] == 0 and reports[1] == {"shard": "tree:two", "error": "no disk"}


def test_index_integrity_finds_what_is_wrong(spark):
    atoms = spark.createDataFrame([(1, "t", "some words"), (2, "t", ""), (3, None, "other words here")], "id bigint, title string, body string")
    assert tuple(catalog.index_integrity(atoms, search.Index(atoms)).first()) == (3, 3, 0, 0, 0, True)
    stale = search.Index(atoms.where("id > 1").withColumn("body", F.when(F.col("id") == 3, "changed").otherwise(F.col("body"))).unionByName(spark.createDataFrame([(9, "t", "b")], atoms.schema)))
    assert tuple(catalog.index_integrity(atoms, stale).first()) == (3, 3, 1, 1, 1, False)


def test_written_index_gives_the_same_scores(spark, tmp_path):
    rows = [(i, "s1" if i % 2 else "s2", f"title {i}", f"the quick fox_{i} foo.bar naïve café {'aaaa ' * (i % 4)}") for i in range(40)] + [(99, "s1", "  ", " \n ")]
    atoms = spark.createDataFrame(rows, "id bigint, shard_key string, title string, body string")
    asked = spark.createDataFrame([(1, "quick fox_3"), (2, "aaa"), (3, "foo.b"), (4, "cafe"), (5, "")], "query_id bigint, query string")
    for per in ((), ("shard_key",)):
        stored = search.Index(atoms, ("shard_key",)).write(str(tmp_path / f"index{len(per)}"))
        for lane in (search.substring_lane, search.word_lane):
            want = sorted(map(str, lane(atoms, asked, per=per).collect()))
            assert want and sorted(map(str, lane(stored, asked, per=per).collect())) == want
    plan = search.substring_lane(search.Index(atoms).stored(), asked)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_lanes_against_counting(spark):
    bodies = ["alpha beta alphabet", "BETA-alpha x", "a.b alpha", "al pha", "", "alpha alpha beta\tgamma"]
    atoms = spark.createDataFrame([(i, "t", b) for i, b in enumerate(bodies)], "id bigint, title string, body string")
    for term in ("alpha", "beta", "pha", "-al", "lph"):
        got = {r["id"] for r in search.substring_lane(atoms, spark.createDataFrame([(1, term)], "query_id int, query string")).collect()}
        assert got == {i for i, b in enumerate(bodies) if term in b.lower()}, term


def test_many_clusters_are_joined(spark, monkeypatch):
    atoms = spark.createDataFrame([(i, b) for i, b in enumerate(["tokens and session", "invoice invoice", "nothing"])], "id bigint, body string")
    clusters = spark.createDataFrame([("auth", ["token", "session"]), ("pay", ["invoice"])], "name string, keywords array<string>")
    inline = sorted(map(tuple, routing.route_atoms(atoms, clusters).select("id", "cluster", F.round("density", 6)).collect()))
    monkeypatch.setattr(routing, "INLINE", 1)
    assert sorted(map(tuple, routing.route_atoms(atoms, clusters).select("id", "cluster", F.round("density", 6)).collect())) == inline == [(0, "auth", inline[0][2]), (1, "pay", inline[1][2]), (2, "general", 0.0)]


def test_vectors_of_any_id_with_nulls_ties_and_slices(spark, monkeypatch):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(50, 8))
    m[7] = m[3]
    rows = [(f"v{i:02d}", [float(x) for x in m[i]]) for i in range(50)] + [("none", None)]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<float>").repartition(3)
    unit = np.array([r[1] for r in rows[:50]], np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    sim = np.round(unit @ unit.T, 9)
    want = {(f"v{q:02d}", r + 1): f"v{i:02d}" for q in range(50) for r, i in enumerate(sorted(range(50), key=lambda i: (-sim[q, i], i))[:4])}
    for sizes in ((128 << 20, 64 << 20), (900, 500)):
        monkeypatch.setattr(vectors, "QUERY_BYTES", sizes[0])
        monkeypatch.setattr(vectors, "SIMILARITY_BYTES", sizes[1])
        got = {(r["query_id"], r["rank"]): r["vec_id"] for r in vectors.top_similar(df, df.withColumnRenamed("vec_id", "query_id"), 4).collect()}
        assert got == want
    assert vectors.top_similar(df, df.withColumnRenamed("vec_id", "query_id").limit(0), 4).count() == 0


def test_generators(spark):
    draw = evaluate.mulberry32(42)
    first = [draw() for _ in range(3)]
    assert abs(first[0] - 0.6011037519201636) < 1e-15 and all(0 <= x < 1 for x in first)
    docs, asked = evaluate.synthetic_org(spark, 6, 5, questions=20)
    assert docs.count() == 30 and docs.select("needle").distinct().count() == 30
    kinds = {r["type"]: r["n"] for r in asked.groupBy("type").agg(F.count("*").alias("n")).collect()}
    assert kinds == {"needle": 14, "cross-shard": 4, "no-answer": 2}
    assert docs.exceptAll(evaluate.synthetic_org(spark, 6, 5)[0]).count() == 0
    needle = docs.orderBy("source_key").first()
    hits = search.top(search.word_lane(docs.select(F.xxhash64("shard_key", "source_key").alias("id"), "title", F.col("text").alias("body")), spark.createDataFrame([(1, needle["needle"])], "query_id int, query string")))
    assert hits.count() == 1


def test_doc_precision(spark):
    ranked = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("a", "z", 3), ("b", "q", 1)], "case_id string, doc string, rank int")
    expected = spark.createDataFrame([("a", "y"), ("a", "z")], "case_id string, doc string")
    got = {r["case_id"]: r["score"] for r in evaluate.doc_precision(ranked, expected).collect()}
    assert abs(got["a"] - (1 / 2 + 2 / 3) / 2) < 1e-12 and got["b"] == 0
