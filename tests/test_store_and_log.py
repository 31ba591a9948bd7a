import json
import random
import subprocess

import pytest
from pyspark.sql import functions as F

from tessellum.api import Collection, Federation
from tessellum.operators import store
from tessellum.plans import evaluate
from tessellum.sources import connectors, storage
from tessellum.streaming import log


def docs(spark, *rows):
    return spark.createDataFrame(list(rows), "source_key string, title string, text string")


def test_collection_lifecycle(spark, tmp_path):
    c = Collection(spark, str(tmp_path / "c"), clusters=[("animals", ["fox", "bear"]), ("food", ["bread"])])
    first = docs(spark, ("a", "A", "the quick fox"), ("b", "B", "brown bread"), ("c", "C", "nothing"))
    assert c.upsert(first) == {"new": 3} and c.upsert(first) == {"skip": 3}
    assert c.upsert(docs(spark, ("a", "A2", "the quick fox"), ("b", "B", "black bread"))) == {"skip": 1, "changed": 1}
    assert {r["title"]: r["cluster"] for r in c.atoms().collect()} == {"A": "animals", "B": "food", "C": "general"}
    q = spark.createDataFrame([(1, "bread")], "query_id bigint, query string")
    assert c.search(q).count() == 1 and c.search(q, lane="word", cluster="animals").count() == 0
    ids = {r["title"]: r["id"] for r in c.atoms().collect()}
    c.add_edges(spark.createDataFrame([(ids["B"], ids["A"], "see", 1.0)], "src bigint, dst bigint, edge_type string, weight double"))
    with pytest.raises(ValueError):
        c.add_edges(spark.createDataFrame([(1, 2, "see", 1.0)], "src bigint, dst bigint, edge_type string, weight double"))
    expanded = c.hybrid(q, expand=0.5).collect()
    assert {r["id"] for r in expanded} == {ids["A"], ids["B"]}
    assert c.hybrid(q, via_summaries=1).count() == 1
    c.delete(spark.createDataFrame([("b",)], "source_key string"))
    assert c.search(q).count() == 0 and {r["name"]: r["n_rows"] for r in c.stats().collect()}["documents"] == 2
    assert c.snapshots.commit({}) > 4


def test_federation(spark, tmp_path):
    f = Federation(spark, str(tmp_path / "f"))
    rows = [(f"s{i % 3}", f"d{i}", f"T{i}", ("invoice ledger" if i % 3 == 0 else "session token" if i % 3 == 1 else "button colour") + f" item{i}") for i in range(9)]
    f.upsert(spark.createDataFrame(rows, "shard_key string, source_key string, title string, text string"))
    hits, _ = f.search_all(spark.createDataFrame([(1, "invoice ledger"), (2, "shard:s1 token")], "query_id bigint, query string"))
    got = hits.collect()
    assert {r["shard_key"] for r in got if r["query_id"] == 1} == {"s0"} and {r["shard_key"] for r in got if r["query_id"] == 2} == {"s1"}


def test_queue(spark):
    q = spark.createDataFrame([(1, "a", "full", 0, "PENDING"), (2, "b", "full", 5, "PENDING"), (3, "b", "delta", 9, "RUNNING")], "id int, shard_key string, task string, priority int, status string")
    assert store.claimable(q).first()["id"] == 1
    assert store.claimable(store.recover(q)).first()["id"] == 3
    more = spark.createDataFrame([(4, "a", "full", 1, "PENDING"), (5, "a", "delta", 1, "PENDING")], "id int, shard_key string, task string, priority int, status string")
    assert {r["id"] for r in store.enqueue(q, more).collect()} == {1, 2, 3, 5}
    done = store.complete(q, spark.createDataFrame([(3, True)], "id int, ok boolean"))
    assert {r["id"]: r["status"] for r in done.collect()}[3] == "DONE"


def test_merge_is_order_independent_and_idempotent(spark):
    rng = random.Random(0)
    rows = [(rng.randint(1, 4), rng.choice("ab"), str(i), rng.randint(1, 9), rng.randint(1, 3), 0) for i in range(60)]
    one = spark.createDataFrame(rows, log.OPS)
    shuffled = spark.createDataFrame(rng.sample(rows, 60) + rows[:30], log.OPS)
    key = lambda df: sorted(map(tuple, log.merge(df).collect()))
    assert key(one) == key(shuffled)
    best = {}
    for node, field, value, lamport, client, _ in rows:
        best[node, field] = max(best.get((node, field), (0, 0, "")), (lamport, client, value))
    assert {(n, f): (la, c, v) for n, f, v, la, c in key(one)} == best
    assert set(log.fields(log.merge(one), ["a", "zz"]).columns) == {"node", "a", "zz"}


def test_epochs_frontier_and_compaction(spark):
    nodes = spark.createDataFrame([(1, 2, 1, "SYNCED"), (2, 2, 1, "DIRTY")], "node bigint, epoch bigint, version int, status string")
    updates = spark.createDataFrame([(1, 1), (2, 3), (3, 1), (1, None)], "node bigint, epoch bigint")
    split = log.split_remote(updates, nodes)
    assert sorted((r["node"], r["action"]) for r in split.collect()) == [(1, "queued"), (1, "stale"), (2, "adopted"), (3, "unknown")]
    after = {r["node"]: r for r in log.apply_remote(nodes, split).collect()}
    assert after[1]["status"] == "CONFLICT" and after[2]["epoch"] == 3 and after[2]["version"] == 2
    vectors = spark.createDataFrame([("A", 1, 5), ("A", 2, 9), ("B", 1, 3)], "replica string, client bigint, clock bigint")
    frontier = log.stable_frontier(vectors)
    assert {r["client"]: r["clock"] for r in frontier.collect()} == {1: 3, 2: 0}
    ops = spark.createDataFrame([(1, "a", "x", 1, 1, 0), (1, "a", "y", 3, 1, 0), (2, "a", "z", 4, 1, 0)], log.OPS)
    stable = log.stable_nodes(ops, frontier)
    assert [r["node"] for r in stable.collect()] == [1]
    small = log.compact(ops, stable)
    assert sorted(map(tuple, log.merge(small).collect())) == sorted(map(tuple, log.merge(ops).collect())) and small.count() == 2
    assert log.diff(ops, spark.createDataFrame([(1, 3)], "client bigint, clock bigint")).count() == 1


def test_outbox_migrations_subscriptions(spark):
    outbox = spark.createDataFrame([(1, 1, "node.updated", "DIRTY"), (2, 1, "remote.stale", "DIRTY"), (3, 2, "node.created", "SYNCED")], "id bigint, node bigint, event_type string, status string")
    nodes = spark.createDataFrame([(1, 0, 1, "CONFLICT"), (2, 0, 1, "DIRTY")], "node bigint, epoch bigint, version int, status string")
    n, o = log.sync_round(nodes, outbox)
    assert {r["node"]: (r["version"], r["status"]) for r in n.collect()} == {1: (2, "SYNCED"), 2: (1, "DIRTY")} and log.dirty(o).count() == 0
    old = spark.createDataFrame([(1, 0, "t"), (2, 2, "t")], "node bigint, schema_version int, title string")
    done = log.migrate(old, [(2, lambda d: d.withColumn("title", F.concat("title", F.lit("-2")))), (1, lambda d: d.withColumn("title", F.concat("title", F.lit("-1"))))])
    assert {r["node"]: r["title"] for r in done.collect()} == {1: "t-1-2", 2: "t"}
    with pytest.raises(ValueError):
        log.migrate(old, [(1, lambda d: d), (1, lambda d: d)])
    known = spark.createDataFrame([("a",), ("b",)], "shard_key string")
    good, bad = log.subscribed(spark.createDataFrame([("a",), ("b",), ("c",)], "shard_key string"), known, known.where("shard_key = 'a'"))
    assert good.count() == 1 and {r["reason"] for r in bad.collect()} == {"not subscribed", "unknown shard"}


def test_outbox_stream_replays_to_the_same_registers(spark, tmp_path):
    folder, seen = str(tmp_path / "ops"), []
    spark.createDataFrame([(1, "a", "x", 1, 1, 0)], log.OPS).write.parquet(folder)
    sink = lambda batch, number: seen.extend(map(tuple, log.merge(batch).collect()))
    log.outbox_stream(spark, folder, sink, str(tmp_path / "ck")).awaitTermination(60)
    spark.createDataFrame([(1, "a", "y", 2, 1, 0)], log.OPS).write.mode("append").parquet(folder)
    log.outbox_stream(spark, folder, sink, str(tmp_path / "ck")).awaitTermination(60)
    assert [r[2] for r in seen] == ["x", "y"]


def test_file_tree(spark, tmp_path):
    root = tmp_path / "tree"
    for name, size in (("readme.md", 5), ("src/a.py", 7), ("src/empty.py", 0), ("src/big.py", 200_000), ("node_modules/x.js", 3), ("logo.png", 3)):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("x" * size)
    source = connectors.FileTree(spark, str(root))
    events = list(source.crawl(None))
    assert [e.kind for e in events] == ["clusters", "batch", "cursor"]
    assert [r["source_key"] for r in events[1].rows] == ["readme.md", "src/a.py"] and [c["name"] for c in events[0].rows] == ["root", "src"]
    (root / "src/a.py").write_text("changed!")
    (root / "readme.md").unlink()
    again = list(source.crawl(events[-1].cursor))
    assert [r["source_key"] for e in again if e.kind == "batch" for r in e.rows] == ["src/a.py"] and [e.rows for e in again if e.kind == "deletes"] == [["readme.md"]]


def test_git_tree(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "a.md").write_text("one")
    (tmp_path / "b.md").write_text("two is a longer file\nwith lines\n")
    git("add", "-A"), git("commit", "-qm", "1")
    source = connectors.GitTree(spark, str(tmp_path))
    full = list(source.crawl(None))
    assert [r["text"] for r in full[1].rows] == ["one", "two is a longer file\nwith lines\n"]
    git("mv", "b.md", "c.md")
    (tmp_path / "a.md").write_text("changed")
    git("add", "-A"), git("commit", "-qm", "2")
    delta = list(source.crawl(full[-1].cursor))
    assert delta[0].rows == ["b.md"] and [r["source_key"] for r in delta[1].rows] == ["a.md", "c.md"] and delta[-1].cursor != full[-1].cursor


class Memory:
    def __init__(self):
        self.docs, self.cursor = {}, None

    def clusters(self, shard, rows):
        pass

    def upsert(self, shard, rows):
        same = sum(self.docs.get(r["source_key"]) == r["text"] for r in rows)
        self.docs.update({r["source_key"]: r["text"] for r in rows})
        return {"skip": same}

    def delete(self, shard, keys):
        return sum(self.docs.pop(k, None) is not None for k in keys)

    def get_cursor(self, shard):
        return self.cursor

    def put_cursor(self, shard, cursor):
        self.cursor = cursor


def test_wiki_crawl_with_storms_and_crash():
    pages = [{"id": i, "title": f"P{i}", "body": f"<p>body {i}</p>", "version": 1, "lastModified": "2020"} for i in range(5)]
    calls = {"n": 0}

    def get(path, params):
        calls["n"] += 1
        if calls["n"] % 3 == 0:
            return 429, {"Retry-After": "0"}, {}
        if params.get("trashed"):
            return 200, {}, {"results": [pages[0]]}
        at = int(params.get("cursor", 0))
        return 200, {}, {"results": pages[at : at + 2], "next": str(at + 2) if at + 2 < 5 else None}

    wiki = connectors.Wiki(get, connectors.Throttle(sleep=lambda s: None), now=lambda: "2021")
    kept = Memory()
    with pytest.raises(RuntimeError):
        connectors.crawl(wiki.crawl and type("S", (), {"crawl": lambda self, c: wiki.crawl("K", c)})(), kept, "cf:K", crash_after=2)
    assert kept.cursor is None
    source = type("S", (), {"crawl": lambda self, c: wiki.crawl("K", c)})()
    report = connectors.crawl(source, kept, "cf:K")
    assert report["mode"] == "full" and report["skipped"] == 4 and kept.docs["3"] == "body 3" and json.loads(kept.cursor)["watermark"] == "2021"
    assert connectors.crawl(source, kept, "cf:K")["deleted"] == 1


def test_storage_text():
    markup = '<h1>T</h1><p>a &amp;lt; b<br/>c</p><table><tr><th>x</th><td>y <b>z</b></td></tr></table><a href="http://u">link</a><ac:structured-macro ac:name="code"><ac:plain-text-body><![CDATA[if (a  <  b) {}]]></ac:plain-text-body></ac:structured-macro>'
    out = storage.to_text(markup)
    assert "if (a  <  b) {}" in out and "x | y z" in out and "link (http://u)" in out and "a &lt; b\nc" in out
    assert storage.to_text(None) == ""


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, 1, False), (1, 2, False), (1, 3, True), (2, 1, False)], "c int, rank int, relevant boolean")
    assert {r["c"]: round(r["score"], 6) for r in evaluate.contextual_precision(ranked, ["c"]).collect()} == {1: 0.333333, 2: 0}
    cases = spark.createDataFrame([("a", ["s1", "s2"], ["s1"]), ("b", [], ["s1"])], "case_id string, expected_shards array<string>, probed array<string>")
    assert {r["case_id"]: r["score"] for r in evaluate.routing_recall(cases).collect()} == {"a": 0.5, "b": 1.0}
    c = spark.createDataFrame([("q", "Paging uses cursors. Storms retry later.", ["Paging uses stable cursors here.", "other"], "what does paging use")], "case_id string, expected string, contexts array<string>, question string")
    assert evaluate.contextual_recall(c).first()["score"] == 0.5
    assert evaluate.extractive_answers(c.select("case_id", "question", "contexts")).first()["answer"] == "Paging uses stable cursors here."
    refused = evaluate.extractive_answers(c.select("case_id", F.lit("unrelated zebra").alias("question"), "contexts"), floor=0.12).first()["answer"]
    assert refused == "NO_ANSWER"
    empty = evaluate.distribution(spark.createDataFrame([], "query_type string")).collect()
    assert not any(r["ok"] for r in empty)
    with pytest.raises(ValueError):
        evaluate.separate_models("x", "x")
    right = evaluate.correctness(spark.createDataFrame([(1, "NO_ANSWER", "", False, "none"), (2, "same words here", "same words here", True, "none")], "case_id int, actual string, expected string, answerable boolean, allowed_variance string"))
    assert all(r["passed"] for r in right.collect())


def test_goldens(spark):
    d = spark.createDataFrame([("a.py", "def loadLedger(): pass. It loads."), ("b.py", "calls loadLedger() twice"), ("c.py", "def shared_name"), ("d.py", "def shared_name")], "doc string, text string")
    found = evaluate.unique_definitions(d).collect()
    assert [(r["identifier"], r["references"]) for r in found] == [("loadLedger", ["b.py"])]
    assert evaluate.synthesize_goldens(d).first()["input"] == "What does loadLedger do in a.py?"
