"""Connectors: file trees, git repositories and wiki spaces, and the crawl that feeds a collection from them.

A crawl yields events in a strict order: clusters, batches of documents, deletes,
cursor.  A cursor is kept only after everything before it is committed; a crash
replays one batch, whose unchanged documents are skipped by hash.
"""

from __future__ import annotations

import json
import re
import subprocess
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES, BATCH = 131_072, 50
INCLUDE = r"\.(md|mdx|txt|rst|adoc|ts|tsx|js|jsx|mjs|cjs|py|go|rs|java|kt|rb|php|c|h|cc|cpp|hpp|cs|swift|scala|sql|sh|json|ya?ml|toml|css|html)$"
EXCLUDE = r"(^|/)(node_modules|\.git|dist|build|vendor)/"


@dataclass
class Event:
    """One of: clusters, batch, deletes, cursor."""

    kind: str
    rows: list = field(default_factory=list)
    cursor: str | None = None


def admitted(df: DataFrame, path: str = "path", size: str = "size", include: str | None = None, exclude: str | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Files by path and size; given patterns replace the defaults and see the whole relative path."""
    return df.where(F.col(path).rlike(include or INCLUDE) & ~F.col(path).rlike(exclude or EXCLUDE) & (F.col(size) > 0) & (F.col(size) <= max_bytes))


def file_tree(spark: SparkSession, root: str, include: str | None = None, exclude: str | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, size, mtime, content) of the files under root; sizes and paths are filtered before contents are read."""
    # the reader skips empty matches by itself; names that start with . or _ are hidden to it
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    clean = re.escape(root.rstrip("/").removeprefix("file:"))
    relative = found.select(F.regexp_replace("path", f"^.*?{clean}/", "").alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")
    return admitted(relative, include=include, exclude=exclude, max_bytes=max_bytes)


def top_clusters(df: DataFrame, path: str = "path") -> DataFrame:
    """(name, keywords): the top-level directories, or root."""
    name = F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1)).otherwise("root")
    return df.select(name.alias("name")).distinct().select("name", F.array("name").alias("keywords"))


def tree_documents(tree: DataFrame) -> DataFrame:
    """(source_key, title, text, content_hash, source_version, origin_file) of a file tree."""
    return tree.select(F.col("path").alias("source_key"), F.element_at(F.split("path", "/"), -1).alias("title"), F.decode("content", "UTF-8").alias("text"), F.sha2("content", 256).alias("content_hash"), F.date_format("mtime", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("source_version"), F.col("path").alias("origin_file"))


class FileTree:
    """A directory as a source; the cursor is the manifest of what was seen."""

    def __init__(self, spark: SparkSession, root: str, **filters):
        self.spark, self.root, self.filters = spark, root, filters

    def crawl(self, cursor: str | None) -> Iterator[Event]:
        tree = file_tree(self.spark, self.root, **self.filters).orderBy("path")
        yield Event("clusters", [r.asDict() for r in top_clusters(tree).orderBy("name").collect()])
        then = json.loads(cursor) if cursor else {}
        listing = {r["path"]: [r["size"], r["m"]] for r in tree.select("path", "size", F.unix_millis("mtime").alias("m")).toLocalIterator()}
        changed = [p for p, v in listing.items() if then.get(p) != v]
        for i in range(0, len(changed), BATCH):
            yield Event("batch", [r.asDict() for r in tree_documents(tree.where(F.col("path").isin(changed[i : i + BATCH]))).collect()])
        if cursor:  # a full crawl never deletes
            yield Event("deletes", sorted(set(then) - set(listing)))
        yield Event("cursor", cursor=json.dumps(listing, sort_keys=True))


def parse_raw_diff(lines: DataFrame, line: str = "line") -> DataFrame:
    """(action, path, sha) of ``git diff --raw -M`` lines: deletes and upserts, a rename being one of each."""
    head = r"^:\d+ \d+ [0-9a-f]+ ([0-9a-f]+) ([A-Z])\d*\t([^\t]+)(?:\t([^\t]+))?$"
    parts = lines.select(*[F.regexp_extract(line, head, i).alias(n) for i, n in enumerate(("sha", "status", "a", "b"), 1)]).where(F.col("status").isin("A", "M", "D", "R"))
    gone = parts.where(F.col("status").isin("D", "R")).select(F.lit("delete").alias("action"), F.col("a").alias("path"), F.lit(None).cast("string").alias("sha"))
    new = parts.where(F.col("status").isin("A", "M", "R")).select(F.lit("upsert").alias("action"), F.when(F.col("status") == "R", F.col("b")).otherwise(F.col("a")).alias("path"), "sha")
    return gone.unionByName(new)


class GitTree:
    """A local clone as a source; the cursor is the commit last seen."""

    def __init__(self, spark: SparkSession, clone: str, **filters):
        self.spark, self.clone, self.filters = spark, clone, filters

    def _git(self, *args: str) -> str:
        return subprocess.run(["git", "-C", self.clone, *args], capture_output=True, check=True).stdout.decode("utf-8", "replace")

    def _blobs(self, shas: list[str]) -> dict[str, str]:
        """The contents of blobs, read by one process."""
        out = subprocess.run(["git", "-C", self.clone, "cat-file", "--batch"], input="\n".join(shas).encode(), capture_output=True, check=True).stdout
        texts, at = {}, 0
        for sha in shas:
            end = out.index(b"\n", at)
            size = int(out[at:end].split()[-1])
            texts[sha] = out[end + 1 : end + 1 + size].decode("utf-8", "replace")
            at = end + size + 2
        return texts

    def _documents(self, entries: list[tuple[str, str]], head: str) -> Iterator[Event]:
        for i in range(0, len(entries), BATCH):
            texts = self._blobs([sha for _, sha in entries[i : i + BATCH]])
            rows = [{"source_key": p, "title": p.split("/")[-1], "text": texts[sha], "content_hash": sha, "source_version": head, "origin_file": p} for p, sha in entries[i : i + BATCH]]
            yield Event("batch", rows)

    def crawl(self, cursor: str | None) -> Iterator[Event]:
        head = self._git("rev-parse", "HEAD").strip()
        if cursor and cursor != head:
            lines = [(x,) for x in self._git("diff", "--raw", "-M", "--no-abbrev", cursor, head).splitlines()]
            changes = parse_raw_diff(self.spark.createDataFrame(lines, "line string")).collect()
            yield Event("deletes", sorted(r["path"] for r in changes if r["action"] == "delete"))
            named = self.spark.createDataFrame([(r["path"], r["sha"], 1) for r in changes if r["action"] == "upsert"], "path string, sha string, size bigint")
            yield from self._documents([(r["path"], r["sha"]) for r in admitted(named, **self.filters).orderBy("path").collect()], head)
        elif not cursor:
            rows = [re.match(r"\d+ blob ([0-9a-f]+)\s+(\d+)\t(.*)", x) for x in self._git("ls-tree", "-r", "-l", "HEAD").splitlines()]
            listed = self.spark.createDataFrame([(m[3], m[1], int(m[2])) for m in rows if m], "path string, sha string, size bigint")
            kept = admitted(listed, **self.filters)
            yield Event("clusters", [r.asDict() for r in top_clusters(kept).orderBy("name").collect()])
            yield from self._documents([(r["path"], r["sha"]) for r in kept.orderBy("path").collect()], head)
        yield Event("cursor", cursor=head)


class Throttle:
    """A token bucket, and retries that honour the server's wait."""

    def __init__(self, rate: float = 8.0, retries: int = 5, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.retries, self.clock, self.sleep = rate, retries, clock, sleep
        self.tokens, self.at = rate, clock()

    def take(self) -> None:
        now = self.clock()
        self.tokens, self.at = min(self.rate, self.tokens + (now - self.at) * self.rate), now
        if self.tokens < 1:
            self.sleep((1 - self.tokens) / self.rate)
            self.tokens, self.at = 1, self.clock()
        self.tokens -= 1

    def call(self, fetch: Callable[[], tuple[int, dict, dict]]) -> dict:
        """fetch gives (status, headers, body)."""
        for _ in range(self.retries + 1):
            self.take()
            status, headers, body = fetch()
            if status != 429:
                if status >= 400:
                    raise RuntimeError(f"status {status}")
                return body
            self.sleep(max(0.01, float(headers.get("Retry-After", 1))))
        raise RuntimeError("still rate-limited after all retries")


class Wiki:
    """Spaces of a wiki over an injected ``get(path, params) -> (status, headers, body)``.

    Pages arrive as {results: [{id, key, title, body, version, lastModified}], next}.
    """

    def __init__(self, get: Callable, throttle: Throttle | None = None, now: Callable[[], str] | None = None):
        self.get, self.throttle = get, throttle or Throttle()
        self.now = now or (lambda: time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()))

    def _pages(self, path: str, **params) -> Iterator[tuple[list[dict], str | None]]:
        cursor = params.pop("cursor", None)
        while True:
            body = self.throttle.call(lambda: self.get(path, params | ({"cursor": cursor} if cursor else {})))
            cursor = body.get("next")
            yield body.get("results", []), cursor
            if not cursor:
                return

    def discover(self) -> list[dict]:
        """One shard per space; root pages are its clusters."""
        out = []
        for spaces, _ in self._pages("spaces"):
            for s in spaces:
                roots = [p for rows, _ in self._pages("pages", space=s["key"], root=True) for p in rows]
                clusters = [{"name": re.sub(r"[^a-z0-9]+", "-", p["title"].lower()).strip("-")[:40] or "page", "keywords": [w for w in re.findall(r"\w+", p["title"].lower()) if len(w) >= 3]} for p in roots]
                out.append({"shard_key": f"cf:{s['key']}", "kind": "space", "display_name": s["name"], "clusters": clusters})
        return out

    def crawl(self, space: str, cursor: str | None) -> Iterator[Event]:
        from .storage import to_text

        started = self.now()
        old = json.loads(cursor) if cursor else None
        params = {"space": space, **({"modified_after": old["watermark"], "cursor": old.get("page_cursor")} if old else {})}
        for rows, following in self._pages("pages", **params):
            docs = [{"source_key": str(p["id"]), "title": p["title"], "text": to_text(p["body"]), "source_version": str(p["version"]), "origin_file": p["title"]} for p in rows]
            if docs:
                yield Event("batch", docs)
                if old and following:
                    yield Event("cursor", cursor=json.dumps({"watermark": old["watermark"], "page_cursor": following}))
        if old:
            yield Event("deletes", sorted(str(p["id"]) for rows, _ in self._pages("pages", space=space, trashed=True) for p in rows))
        yield Event("cursor", cursor=json.dumps({"watermark": started, "page_cursor": None}))


def crawl(source, store, shard: str, mode: str = "auto", crash_after: int | None = None) -> dict:
    """Feed a store (upsert, delete, clusters, get_cursor, put_cursor) from a source; returns the report."""
    cursor = store.get_cursor(shard) if mode in ("auto", "delta") else None
    report = {"shard": shard, "mode": "delta" if cursor else "full", "documents": 0, "skipped": 0, "deleted": 0, "batches": 0}
    for event in source.crawl(cursor):
        if event.kind == "clusters":
            store.clusters(shard, event.rows)
        elif event.kind == "batch":
            done = store.upsert(shard, event.rows)
            report["documents"] += len(event.rows)
            report["skipped"] += done.get("skip", 0)
            report["batches"] += 1
            if crash_after and report["batches"] >= crash_after:
                raise RuntimeError("crash asked for")
        elif event.kind == "deletes":
            report["deleted"] += store.delete(shard, event.rows)
        else:
            store.put_cursor(shard, event.cursor)
            report["cursor"] = event.cursor
    return report
