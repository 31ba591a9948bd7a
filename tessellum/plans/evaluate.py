"""Evaluation of retrieval and generation: metrics, judges, goldens and baselines, set-based over cases."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import text as T

ATTRIBUTION, RELEVANCE, REFUSAL = 0.7, 0.2, 0.12
BANDS = {"common": (0.50, 0.60), "distractor": (0.20, 0.25), "multi-hop": (0.10, 0.15), "no-answer": (0.10, 0.15), "cross-shard": (0.0, 0.0)}


def presence_cosine(a: Column, b: Column) -> Column:
    """Cosine of the presence vectors of two token arrays; 0 when either is empty."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    size = F.sqrt(F.size(x).cast("double") * F.size(y))
    return F.when(size > 0, F.size(F.array_intersect(x, y)) / size).otherwise(0.0)


def attribution(statement: Column, context: Column) -> Column:
    """Share of a statement's tokens that the context has; null without tokens."""
    return F.when(F.size(statement) > 0, F.size(F.filter(statement, lambda t: F.array_contains(context, t))) / F.size(statement))


def attributable(statement: Column, context: Column, floor: float = ATTRIBUTION) -> Column:
    return F.coalesce(attribution(statement, context) >= floor, F.lit(False))


def term_cosine(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, cosine) of term-frequency vectors; inputs (a, tokens) and (b, tokens), pairs that share a term."""
    def counted(df: DataFrame, key: str) -> DataFrame:
        return df.select(key, F.explode("tokens").alias("t")).groupBy(key, "t").agg(F.count("*").alias("n"))

    x, y = counted(left, "a"), counted(right, "b")
    nx, ny = x.groupBy("a").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("nx")), y.groupBy("b").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("ny"))
    dots = x.join(y.withColumnRenamed("n", "m"), "t").groupBy("a", "b").agg(F.sum(F.col("n") * F.col("m")).alias("d"))
    return dots.join(nx, "a").join(ny, "b").select("a", "b", (F.col("d") / (F.col("nx") * F.col("ny"))).alias("cosine"))


def relevant(chunks: DataFrame) -> DataFrame:
    """chunks (case_id, chunk, text, input, expected) with ``relevant``: alike enough to the input by term frequency, or carrying a statement of the expected answer alone."""
    told = chunks.withColumns({"_t": T.eval_tokens(F.col("text")), "_i": T.eval_tokens(F.col("input"))})
    count = lambda tokens, t: F.size(F.filter(tokens, lambda v: v == t)).cast("double")
    norm = lambda c: F.sqrt(F.aggregate(F.array_distinct(c), F.lit(0.0), lambda a, t: a + count(F.col(c), t) * count(F.col(c), t)))
    dot = F.aggregate(F.array_intersect("_t", "_i"), F.lit(0.0), lambda a, t: a + count(F.col("_t"), t) * count(F.col("_i"), t))
    size = norm("_t") * norm("_i")
    alike = F.when(size > 0, dot / size).otherwise(0.0) >= RELEVANCE
    carries = F.exists(T.statements(F.col("expected")), lambda s: attributable(T.eval_tokens(s), F.col("_t")))
    return told.withColumn("relevant", alike | F.coalesce(carries, F.lit(False))).select(*chunks.columns, "relevant")


def doc_precision(ranked: DataFrame, expected: DataFrame) -> DataFrame:
    """(case_id, score): mean precision at the ranks of supporting documents; ranked (case_id, doc, rank), expected (case_id, doc)."""
    flagged = ranked.join(expected.distinct().withColumn("hit", F.lit(True)), ["case_id", "doc"], "left").withColumn("relevant", F.coalesce("hit", F.lit(False)))
    return contextual_precision(flagged, ["case_id"])


def contextual_recall(cases: DataFrame) -> DataFrame:
    """(case_id, score): share of the expected answer's statements that the contexts carry; cases: case_id, expected, contexts."""
    context = T.eval_tokens(F.array_join("contexts", "\n"))
    s = T.statements(F.col("expected"))
    good = F.size(F.filter(s, lambda x: attributable(T.eval_tokens(x), context)))
    return cases.select("case_id", F.when(F.size(s) > 0, good / F.size(s)).otherwise(0.0).alias("score"))


def faithfulness(cases: DataFrame) -> DataFrame:
    """The same of the actual answer's claims; cases: case_id, actual, contexts."""
    return contextual_recall(cases.withColumnRenamed("actual", "expected"))


def answer_relevancy(cases: DataFrame) -> DataFrame:
    """Mean presence cosine of up to three reverse questions and the input; cases: case_id, input, questions."""
    own = T.eval_tokens(F.col("input"))
    scores = F.transform(F.slice("questions", 1, 3), lambda q: presence_cosine(T.eval_tokens(q), own))
    return cases.select("case_id", F.when(F.size(scores) > 0, F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores)).otherwise(0.0).alias("score"))


def contextual_precision(ranked: DataFrame, by: list[str]) -> DataFrame:
    """Mean precision at the relevant ranks; ranked: by, rank, relevant."""
    order = Window.partitionBy(*by).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    at = F.sum(F.col("relevant").cast("int")).over(order) / F.count("*").over(order)
    return ranked.withColumn("p", F.when(F.col("relevant"), at)).groupBy(*by).agg(F.coalesce(F.avg("p"), F.lit(0.0)).alias("score"))


def doc_recall(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(case_id, score): found share of the supporting documents, 1 if none is expected; both (case_id, doc)."""
    hit = expected.distinct().join(found.distinct().withColumn("hit", F.lit(1)), ["case_id", "doc"], "left")
    return hit.groupBy("case_id").agg((F.sum(F.when(F.col("doc").isNull(), 1).otherwise(F.coalesce("hit", F.lit(0)))) / F.count("*")).alias("score"))


def routing_recall(cases: DataFrame) -> DataFrame:
    """(case_id, score): expected shards among the probed; 1 when none is expected."""
    n = F.size("expected_shards")
    return cases.select("case_id", F.when(n > 0, F.size(F.array_intersect("expected_shards", "probed")) / n).otherwise(1.0).alias("score"))


def metric_means(results: DataFrame) -> DataFrame:
    """(name, component, mean, failures) of metric rows (name, component, score, passed)."""
    return results.groupBy("name", "component").agg(F.round(F.avg("score"), 3).alias("mean"), F.sum(F.when(F.col("passed"), 0).otherwise(1)).alias("failures"))


def distribution(cases: DataFrame, kind: str = "query_type", bands: dict[str, tuple[float, float]] = BANDS) -> DataFrame:
    """(query_type, fraction, ok): shares against their bands, with half a case of slack."""
    spark = cases.sparkSession
    limits = spark.createDataFrame([(k, lo, hi) for k, (lo, hi) in bands.items()], "query_type string, low double, high double")
    total = cases.agg(F.count("*").alias("total"))
    n = cases.groupBy(F.col(kind).alias("query_type")).agg(F.count("*").alias("n"))
    j = limits.join(n, "query_type", "full").join(F.broadcast(total)).withColumn("share", F.coalesce(F.col("n") / F.col("total"), F.lit(0.0)))
    slack = 0.5 / F.greatest(F.col("total"), F.lit(1))
    ok = (F.col("total") > 0) & (F.col("share") >= F.col("low") - slack) & (F.col("share") <= F.col("high") + slack)
    return j.select("query_type", F.round("share", 3).alias("fraction"), F.coalesce(ok, F.lit(False)).alias("ok"))


def nearest_rank(df: DataFrame, value: str, by: list[str], percents: list[int]) -> DataFrame:
    """Percentiles without interpolation: the value at rank ceil(p n / 100)."""
    order = Window.partitionBy(*by).orderBy(value)
    ranked = df.select(*by, value, F.row_number().over(order).alias("r"), F.count("*").over(Window.partitionBy(*by)).alias("n"))
    return ranked.groupBy(*by).agg(*[F.max(F.when(F.col("r") == F.greatest(F.ceil(F.lit(p) * F.col("n") / 100), F.lit(1)), F.col(value))).alias(f"p{p}") for p in percents])


def sentence_scores(cases: DataFrame) -> DataFrame:
    """(case_id, pos, sentence, similarity, rank) of the context sentences by tf-idf cosine with the question; cases: case_id, question, contexts."""
    sentences = cases.select("case_id", F.posexplode(F.flatten(F.transform("contexts", lambda c: F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+|\n+"), F.trim), lambda s: s != "")))).alias("pos", "sentence"))
    tf = sentences.select("case_id", "pos", F.explode(T.eval_tokens(F.col("sentence"))).alias("t")).groupBy("case_id", "pos", "t").agg(F.count("*").alias("n"))
    total = sentences.groupBy("case_id").agg(F.count("*").alias("total"))
    df = tf.groupBy("case_id", "t").agg(F.count("*").alias("df"))
    q = cases.select("case_id", F.explode(T.eval_tokens(F.col("question"))).alias("t")).groupBy("case_id", "t").agg(F.count("*").alias("m"))
    idf = F.log(1 + F.col("total") / (1 + F.coalesce("df", F.lit(0))))
    wq = q.join(df, ["case_id", "t"], "left").join(total, "case_id").select("case_id", "t", (F.col("m") * idf).alias("wq"))
    ws = tf.join(df, ["case_id", "t"]).join(total, "case_id").select("case_id", "pos", "t", (F.col("n") * idf).alias("ws"))
    nq = wq.groupBy("case_id").agg(F.sqrt(F.sum(F.col("wq") * F.col("wq"))).alias("nq"))
    ns = ws.groupBy("case_id", "pos").agg(F.sqrt(F.sum(F.col("ws") * F.col("ws"))).alias("ns"))
    dots = ws.join(wq, ["case_id", "t"]).groupBy("case_id", "pos").agg(F.sum(F.col("ws") * F.col("wq")).alias("d"))
    sim = dots.join(ns, ["case_id", "pos"]).join(nq, "case_id").select("case_id", "pos", (F.col("d") / (F.col("ns") * F.col("nq"))).alias("similarity"))
    every = sentences.join(sim, ["case_id", "pos"], "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
    order = Window.partitionBy("case_id").orderBy(F.desc(F.round("similarity", 9)), "pos")
    return every.withColumn("rank", F.row_number().over(order))


_JAVA_SPACE = " \t\n\x0b\f\r"
_SENTENCE_END = re.compile(rf"(?<=[.!?])[{_JAVA_SPACE}]+|\n+")
_STOPS = frozenset(T.EVAL_STOP)


def _tokens(text: str) -> list[str]:
    """T.eval_tokens of one text."""
    parts = re.split(r"[^a-z0-9]+", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", text).lower())
    return [w for w in parts if len(w) > 1 and w not in _STOPS]


def _half_up(x: float, places: int = 9) -> Decimal:
    return Decimal(repr(x)).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP)


class Sentences:
    """The sentences of some contexts and where each token is: made once, however many questions follow."""

    def __init__(self, contexts: list[str | None]):
        self.sentences = [s for c in contexts if c is not None for s in (x.strip(" ") for x in _SENTENCE_END.split(c)) if s]
        self.at: dict[str, list[tuple[int, int]]] = {}
        each = [Counter(_tokens(s)) for s in self.sentences]
        for pos, counts in enumerate(each):
            for t, n in counts.items():
                self.at.setdefault(t, []).append((pos, n))
        self.norms = [math.sqrt(sum((n * self.idf(t)) ** 2 for t, n in counts.items())) for counts in each]

    def idf(self, t: str) -> float:
        return math.log(1 + len(self.sentences) / (1 + len(self.at.get(t, ()))))

    def similar(self, question: str | None) -> dict[int, float]:
        """Positive cosines by position."""
        asked = {t: m * self.idf(t) for t, m in Counter(_tokens(question or "")).items()}
        dots: dict[int, float] = {}
        for t, w in asked.items():
            for pos, n in self.at.get(t, ()):
                dots[pos] = dots.get(pos, 0.0) + n * self.idf(t) * w
        size = math.sqrt(sum(w * w for w in asked.values()))
        return {pos: d / (self.norms[pos] * size) for pos, d in dots.items()}

    def answer(self, question: str | None, most: int, floor: float | None) -> str | None:
        similar = self.similar(question)
        best = sorted(similar, key=lambda pos: (-_half_up(similar[pos]), pos))[:most]
        if floor is not None and max((similar[pos] for pos in best), default=0.0) < floor:
            return "NO_ANSWER"
        return " ".join(self.sentences[pos] for pos in sorted(best)) if best or floor is None else None


def extractive_answers(cases: DataFrame, most: int = 3, floor: float | None = None) -> DataFrame:
    """(case_id, answer): the best sentences in their order; NO_ANSWER below the floor, if one is given."""
    asked = cases.select(F.array(F.struct("case_id", "question")).alias("asked"), "contexts")
    return answer_groups(asked, most, floor)


def answer_groups(groups: DataFrame, most: int = 3, floor: float | None = None) -> DataFrame:
    """extractive_answers of (asked, contexts): contexts with all the cases, (case_id, question), that ask them.

    A group is answered in its own row, so its contexts are split once and
    nothing is shuffled.
    """
    case = groups.schema["asked"].dataType.elementType["case_id"]
    schema = StructType([StructField("case_id", case.dataType, True), StructField("answer", StringType(), True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, answers = [], []
            for asked, contexts in zip(batch.column("asked"), batch.column("contexts")):
                known = Sentences(contexts.as_py() or [])
                for one in asked.as_py():
                    ids.append(one["case_id"])
                    answers.append(known.answer(one["question"], most, floor))
            kind = batch.schema.field("asked").type.value_type.field("case_id").type
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(answers, pa.string())], ["case_id", "answer"])

    return groups.select("asked", "contexts").mapInArrow(run, schema)


def correctness(cases: DataFrame) -> DataFrame:
    """(case_id, score, passed): presence cosine of the answers, against 0.7, 0.45 or 0.25 by allowed variance; a refusal is right iff unanswerable."""
    score = presence_cosine(T.eval_tokens(F.col("actual")), T.eval_tokens(F.col("expected")))
    floor = F.when(F.col("allowed_variance") == "none", 0.7).when(F.col("allowed_variance") == "low", 0.45).otherwise(0.25)
    refused = T.is_refusal(F.col("actual"))
    return cases.select("case_id", F.when(F.col("answerable"), score).otherwise(refused.cast("double")).alias("score"), F.when(F.col("answerable"), (score >= floor) & ~refused).otherwise(refused).alias("passed"))


def jury(votes: list[Column]) -> Column:
    """A strict majority; an even tie is no."""
    return sum((v.cast("int") for v in votes), F.lit(0)) * 2 > len(votes)


def separate_models(generator: str, judge: str) -> None:
    if generator == judge:
        raise ValueError("the generator can't judge itself")


def unique_definitions(docs: DataFrame, pattern: str = r"(?:def|class|function|const|interface|type)\s+([A-Za-z_][A-Za-z0-9_]{3,})", most_references: int = 4) -> DataFrame:
    """(identifier, doc, references): identifiers that one document alone defines, and few others name."""
    defined = docs.select("doc", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)))).alias("identifier"))
    once = defined.groupBy("identifier").agg(F.min("doc").alias("doc"), F.count("*").alias("n")).where("n = 1").drop("n")
    named = docs.select(F.col("doc").alias("other"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z_][A-Za-z0-9_]{3,}"), F.lit(0)))).alias("identifier"))
    uses = once.join(named, "identifier").where("other <> doc").groupBy("identifier").agg(F.array_sort(F.collect_list("other")).alias("references"))
    return once.join(uses, "identifier", "left").withColumn("references", F.coalesce("references", F.array().cast("array<string>"))).where(F.size("references") <= most_references)


def synthesize_goldens(docs: DataFrame, n: int = 24, seed: int = 42, quality: float = 0.5) -> DataFrame:
    """(input, expected_output, source_contexts, quality): questions on unique identifiers that the critic lets pass."""
    found = unique_definitions(docs).join(docs, "doc")
    question = F.concat(F.lit("What does "), F.col("identifier"), F.lit(" do in "), F.col("doc"), F.lit("?"))
    cases = found.select(question.alias("input"), T.lead_sentence(F.col("text")).alias("expected_output"), F.array("text").alias("source_contexts"), F.xxhash64("identifier", F.lit(seed)).alias("o"))
    judged = cases.withColumn("quality", T.critique(F.col("input")))
    return judged.where((F.col("quality.self_containment") >= quality) & (F.col("quality.clarity") >= quality)).orderBy("o", "input").limit(n).drop("o")


def compare_baseline(current: DataFrame, baseline: DataFrame, band: float = 0.25, floor_ms: float = 0.5) -> DataFrame:
    """(name, regressed, reason): one-sided; a latency must also be worse by floor_ms. Both (name, kind, value)."""
    j = baseline.select("name", F.col("kind").alias("bk"), F.col("value").alias("bv")).join(current.select("name", F.col("kind").alias("ck"), F.col("value").alias("cv")), "name", "left")
    slow = (F.col("bk") == "latency") & (F.col("cv") > F.col("bv") * (1 + band)) & (F.col("cv") - F.col("bv") > floor_ms)
    low = (F.col("bk") == "throughput") & (F.col("cv") < F.col("bv") * (1 - band))
    reason = F.when(F.col("ck").isNull(), "missing").when(F.col("ck") != F.col("bk"), "another kind").when(slow, "slower").when(low, "less throughput").otherwise("ok")
    return j.select("name", (reason != "ok").alias("regressed"), reason.alias("reason"))


def retrieve_fused(atoms: DataFrame, queries: DataFrame, lane: Callable, limit: int = 10) -> DataFrame:
    """The evaluation's retriever: a lane per query term, fused by rank."""
    from ..operators.search import rrf, top

    parts = queries.select("query_id", F.explode(T.keyword_terms(F.col("query"))).alias("part"))
    each = parts.select("part").distinct().select(F.col("part").alias("query_id"), F.col("part").alias("query"))
    ranked = top(lane(atoms, each), limit).select(F.col("query_id").alias("part"), "id", "rank").join(parts, "part").select("query_id", F.col("part").alias("lane"), "id", "rank")
    return rrf(ranked, ["query_id"], "id").where(F.col("fused_rank") <= limit)


def mulberry32(seed: int) -> Callable[[], float]:
    """A seeded generator of doubles below 1, the same on every machine."""
    state = [seed & 0xFFFFFFFF]

    def step() -> float:
        state[0] = (state[0] + 0x6D2B79F5) & 0xFFFFFFFF
        t = state[0]
        t = (t ^ t >> 15) * (t | 1) & 0xFFFFFFFF
        t ^= (t + ((t ^ t >> 7) * (t | 61) & 0xFFFFFFFF)) & 0xFFFFFFFF
        return ((t ^ t >> 14) & 0xFFFFFFFF) / 4294967296

    return step


TRADES = {"billing": "invoice ledger refund charge", "access": "token session login grant", "search": "index query rank shard", "media": "frame codec stream clip", "fleet": "node deploy rollout probe", "mail": "inbox bounce relay draft"}


def synthetic_org(spark: SparkSession, shards: int = 500, docs_per_shard: int = 40, seed: int = 42, questions: int = 100) -> tuple[DataFrame, DataFrame]:
    """(documents, questions) of a made-up organisation, generated on the executors, a shard from its own seed.

    documents: shard_key, source_key, title, text, domain, needle, needle_query; each
    has one needle, a name that no other document has, and a lure that is nearly
    another's.  questions: type, query, expected_shards; 70 % ask for a needle, 20 %
    for a domain across its shards, 10 % for nothing that is there.
    """
    import pandas as pd

    names = sorted(TRADES)

    def needle(shard: int, doc: int) -> str:
        return f"handler_{shard:05d}_{doc:04d}"

    def make(batches):
        for ids in batches:
            rows = []
            for shard in ids.id.tolist():
                draw = mulberry32(seed ^ shard * 0x9E3779B1 & 0xFFFFFFFF)
                own = sorted(names, key=lambda _: draw())[:3]
                for doc in range(docs_per_shard):
                    domain = own[int(draw() * 3)]
                    words = TRADES[domain].split()
                    body = " ".join(f"The {words[int(draw() * 4)]} of the {words[int(draw() * 4)]} is checked by step {int(draw() * 90) + 10}." for _ in range(4 + int(draw() * 5)))
                    lure = needle(shard, doc).replace("handler", "handled")
                    rows.append((f"org:{shard:05d}", f"{domain}/doc{doc}.md", f"{domain} {doc}", f"{body} {needle(shard, doc)} settles the {words[0]}, not {lure}x.", domain, needle(shard, doc), f"what does {needle(shard, doc)} settle?"))
            yield pd.DataFrame(rows, columns=["shard_key", "source_key", "title", "text", "domain", "needle", "needle_query"])

    docs = spark.range(shards).mapInPandas(make, "shard_key string, source_key string, title string, text string, domain string, needle string, needle_query string")
    draw = mulberry32(seed ^ 0xBEEF)
    rows = []
    for i in range(questions):
        if i % 10 < 7:
            shard, doc = int(draw() * shards), int(draw() * docs_per_shard)
            rows.append(("needle", f"what does {needle(shard, doc)} settle?", [f"org:{shard:05d}"], None))
        elif i % 10 < 9:
            rows.append(("cross-shard", f"how is the {TRADES[d := names[int(draw() * len(names))]].split()[0]} checked", None, d))
        else:
            rows.append(("no-answer", f"zyx{int(draw() * 1e6)} quux", [], None))
    asked = spark.createDataFrame(rows, "type string, query string, e array<string>, domain string")
    homes = docs.groupBy("domain").agg(F.sort_array(F.collect_set("shard_key")).alias("homes"))
    return docs, asked.join(homes, "domain", "left").select("type", "query", F.coalesce("e", "homes", F.array().cast("array<string>")).alias("expected_shards"))
