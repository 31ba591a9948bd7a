"""Collections and federations: the engine's operators behind one object each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .functions import vectors
from .operators import catalog, graph, routing, search, store
from .sources import connectors

DOCUMENTS = "shard_key string, source_key string, title string, text string, content_hash string, origin_file string"
SHARDS = "shard_key string, kind string, display_name string, clusters array<struct<name:string,keywords:array<string>>>, status string"
EDGES = "src bigint, dst bigint, edge_type string, weight double"


class Collection:
    """Documents, their atoms and edges under one snapshot folder; ``graph`` is the access boundary."""

    def __init__(self, spark: SparkSession, root: str, graph: str = "default", clusters: list[tuple[str, list[str]]] | None = None, size: int = T.CHUNK, overlap: int = T.OVERLAP):
        self.spark, self.graph, self.size, self.overlap = spark, graph, size, overlap
        self.snapshots = store.Snapshots(spark, root)
        self._clusters = clusters or []

    def _table(self, name: str, schema: str) -> DataFrame:
        found = self.snapshots.read(name)
        return self.spark.createDataFrame([], schema) if found is None else found

    def documents(self) -> DataFrame:
        return self._table("documents", DOCUMENTS)

    def edges(self) -> DataFrame:
        return self._table("edges", EDGES)

    def clusters(self) -> DataFrame:
        return self.spark.createDataFrame(self._clusters, "name string, keywords array<string>")

    def atoms(self) -> DataFrame:
        """Chunks of the current documents with their topic; ids follow from key and chunk, so they outlive a rewrite."""
        return self._chunks(self.documents())

    def _chunks(self, documents: DataFrame) -> DataFrame:
        given = documents.select("shard_key", F.lit(self.graph).alias("graph"), "source_key", "title", "text", "origin_file")
        chunks = T.chunk(given, size=self.size, overlap=self.overlap)
        ids = chunks.withColumn("id", F.abs(F.xxhash64("shard_key", "source_key", "chunk_index")))
        return routing.route_atoms(ids, self.clusters()) if self._clusters else ids.withColumns({"cluster": F.lit("general"), "density": F.lit(0.0)})

    def upsert(self, incoming: DataFrame) -> dict[str, int]:
        """New and changed documents replace stored ones, unchanged texts are skipped; returns the counts."""
        given = incoming.withColumns({c: F.lit(None).cast("string") for c in ("origin_file",) if c not in incoming.columns} | ({} if "shard_key" in incoming.columns else {"shard_key": F.lit(self.graph)}))
        judged = store.classify(given, self.documents()).persist()
        counts = {r[0]: r[1] for r in judged.groupBy("change").count().collect()}
        if counts.get("new", 0) + counts.get("changed", 0):
            fresh = judged.where("change <> 'skip'").select(*self.documents().columns)
            self.snapshots.commit({"documents": store.upsert(self.documents(), fresh, ["shard_key", "source_key"])})
        judged.unpersist()
        return counts

    def delete(self, keys: DataFrame) -> int:
        """The documents of these keys (any of shard_key, source_key) go, and the edges of their atoms; returns how many."""
        gone = self.documents().join(keys.distinct(), keys.columns, "left_semi")
        n = gone.count()
        if n:
            left = self.documents().join(keys, keys.columns, "left_anti")
            live = self._chunks(left).select("id")
            edges = self.edges().join(live.withColumnRenamed("id", "src"), "src", "left_semi").join(live.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "edge_type", "weight")
            self.snapshots.commit({"documents": left, "edges": edges})
        return n

    def document(self, source_key: str) -> DataFrame:
        return self.documents().where(F.col("source_key") == source_key)

    def node(self, atom_id: int) -> DataFrame:
        return self.atoms().where(F.col("id") == atom_id)

    def index(self) -> search.Index:
        """Postings of the current atoms, written once for each version of the documents."""
        version = self.snapshots.pointer().get("documents", "none")
        if getattr(self, "_indexed", (None, None))[0] != version:
            self._indexed = (version, search.Index(self.atoms(), ("shard_key",)).stored())
        return self._indexed[1]

    def integrity(self) -> DataFrame:
        return catalog.index_integrity(self.atoms(), self.index())

    def add_edges(self, edges: DataFrame) -> None:
        """All or nothing: an edge with a missing end, or between graphs, rejects the batch."""
        accepted, rejected = graph.check_edges(self.atoms(), edges)
        bad = rejected.limit(1).collect()
        if bad:
            raise ValueError(f"edge rejected: {bad[0]['reason']}")
        # of repeated edges the last by ``seq`` if the batch has it; a DataFrame has no order of its own
        new = accepted if "seq" in accepted.columns else accepted.withColumn("seq", F.lit(0))
        self.snapshots.commit({"edges": graph.upsert_edges(self.edges(), new)})

    def delete_edges(self, gone: DataFrame) -> int:
        """How many of the edges (src, dst, edge_type) were there and went."""
        there = self.edges().join(gone.distinct(), ["src", "dst", "edge_type"], "left_semi").count()
        if there:
            self.snapshots.commit({"edges": graph.delete_edges(self.edges(), gone)})
        return there

    def edges_of(self, nodes: DataFrame) -> DataFrame:
        return graph.edges_of(self.edges(), nodes)

    def vector_topk(self, queries: DataFrame, limit: int = 10, cluster: str | None = None) -> DataFrame:
        """(query_id, id, score, rank): exhaustive cosine of embedded queries and atoms."""
        atoms = self.atoms() if cluster is None else self.atoms().where(F.col("cluster") == cluster)
        return search.vector_lane(self.vectors(atoms), vectors.embed(queries, "query"), limit)

    def vectors(self, atoms: DataFrame | None = None) -> DataFrame:
        given = self.atoms() if atoms is None else atoms
        return vectors.embed(given.select(F.col("id").alias("vec_id"), F.concat_ws(" ", "title", "body").alias("t")), "t").drop("t")

    def neighbours(self, nodes: DataFrame, **how) -> DataFrame:
        return graph.neighbours(self.atoms(), self.edges(), nodes, **how)

    def search(self, queries: DataFrame, lane: str = "trigram", limit: int = 10, cluster: str | None = None) -> DataFrame:
        index = self.index()
        hits = (search.substring_lane if lane == "trigram" else search.word_lane)(index, queries)
        return search.top(search.scope(hits, index, None if cluster is None else F.col("cluster") == cluster), limit)

    def hybrid(self, queries: DataFrame, limit: int = 10, expand: float | None = None, via_summaries: int | None = None, with_vectors: bool = False, edge_type: str | None = None, direction: str = "out") -> DataFrame:
        atoms = self.atoms()
        over = 3 * limit if expand or via_summaries else limit
        lane = (self.vectors(atoms), vectors.embed(queries, "query")) if with_vectors else (None, None)
        hits = search.hybrid(self.index(), queries, over, *lane)
        if via_summaries:
            names = atoms.select("cluster").distinct().withColumn("cluster_id", F.col("cluster"))
            wanted = graph.route_to_clusters(self.summary_terms(), names, queries, via_summaries)
            placed = hits.join(atoms.select("id", "cluster"), "id")
            hits = placed.join(wanted.select("query_id", "cluster"), ["query_id", "cluster"], "left_semi").drop("cluster")
        if expand:
            edges = self.edges() if edge_type is None else self.edges().where(F.col("edge_type") == edge_type)
            back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "edge_type", "weight")
            hits = search.expand_in_order(hits, edges if direction == "out" else back if direction == "in" else edges.unionByName(back), expand)
        order = search.Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), F.col("id").cast("string"))
        return hits.withColumn("fused_rank", F.row_number().over(order)).where(F.col("fused_rank") <= limit)

    def summary_terms(self) -> DataFrame:
        return graph.summary_terms(self.atoms())

    def summaries(self) -> DataFrame:
        return graph.summaries(self.atoms())

    def stats(self) -> DataFrame:
        return store.store_stats(documents=self.documents(), atoms=self.atoms(), edges=self.edges())


class Federation(Collection):
    """Many shards in one snapshot folder, told apart by shard_key."""

    def shards(self) -> DataFrame:
        docs = self.documents()
        best = routing.best_terms(docs)
        terms = routing.signatures(best, docs.select("shard_key").distinct())
        ordered = terms.groupBy("shard_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("routing_terms"))
        sizes = docs.groupBy("shard_key").agg(F.count("*").alias("doc_count"), F.sum(F.length("text")).alias("bytes"))
        return sizes.join(ordered, "shard_key", "left").select("shard_key", F.col("shard_key").alias("display_name"), F.coalesce("routing_terms", F.array().cast("array<string>")).alias("routing_terms"), F.lit("ACTIVE").alias("status"), F.lit(0).alias("updated_at"), "doc_count", "bytes")

    def search_all(self, queries: DataFrame, **how) -> tuple[DataFrame, DataFrame]:
        """(hits, diagnostics) over the routed shards."""
        return routing.federated(self.index(), self.shards(), queries, **how)

    def catalog(self) -> DataFrame:
        return self._table("catalog", SHARDS)

    def ensure_shards(self, wanted: DataFrame) -> None:
        self.snapshots.commit({"catalog": catalog.ensure_shards(self.catalog(), wanted)})

    def checkpoints(self) -> DataFrame:
        return self._table("checkpoints", catalog.CHECKPOINTS)

    def store(self, connector: str) -> CrawlStore:
        return CrawlStore(self, connector)

    def crawl(self, source, shard: str, connector: str = "files", mode: str = "auto", **how) -> dict:
        """Feeds a shard from a source; resumes from its checkpoint."""
        self.ensure_shards(self.spark.createDataFrame([(shard, connector, shard, [])], "shard_key string, kind string, display_name string, clusters array<struct<name:string,keywords:array<string>>>"))
        return connectors.crawl(source, self.store(connector), shard, mode, **how)

    def crawl_org(self, sources: dict[str, object], connector: str = "files", mode: str = "auto") -> list[dict]:
        """Every shard's task goes through the queue: a report for each that ended, its error for each that failed."""
        reports: dict[str, dict] = {}
        tasks = [{"id": i, "shard_key": key, "priority": 0, "status": "PENDING"} for i, key in enumerate(sorted(sources))]
        catalog.drain(tasks, lambda t: reports.update({t["shard_key"]: self.crawl(sources[t["shard_key"]], t["shard_key"], connector, mode)}))
        return [reports.get(t["shard_key"], {"shard": t["shard_key"], "error": t.get("error")}) for t in tasks]


class CrawlStore:
    """What a crawl writes to: documents, clusters and cursors of a federation's shards, each call a commit."""

    def __init__(self, federation: Federation, connector: str):
        self.federation, self.connector = federation, connector

    def get_cursor(self, shard: str) -> str | None:
        found = self.federation.checkpoints().where((F.col("shard_key") == shard) & (F.col("connector") == self.connector)).select("cursor").collect()
        return found[0][0] if found else None

    def put_cursor(self, shard: str, cursor: str) -> None:
        f = self.federation
        new = f.spark.createDataFrame([(shard, self.connector, cursor, 0)], "shard_key string, connector string, cursor string, seq int")
        f.snapshots.commit({"checkpoints": catalog.put_checkpoints(f.checkpoints(), new)})

    def clusters(self, shard: str, rows: list[dict]) -> None:
        given = [(shard, None, None, [(r["name"], list(r["keywords"])) for r in rows])]
        self.federation.ensure_shards(self.federation.spark.createDataFrame(given, "shard_key string, kind string, display_name string, clusters array<struct<name:string,keywords:array<string>>>"))

    def upsert(self, shard: str, rows: list[dict]) -> dict[str, int]:
        given = [(shard, r["source_key"], r["title"], r["text"], r.get("origin_file")) for r in rows]
        return self.federation.upsert(self.federation.spark.createDataFrame(given, "shard_key string, source_key string, title string, text string, origin_file string"))

    def delete(self, shard: str, keys: list[str]) -> int:
        return self.federation.delete(self.federation.spark.createDataFrame([(shard, k) for k in keys], "shard_key string, source_key string")) if keys else 0
