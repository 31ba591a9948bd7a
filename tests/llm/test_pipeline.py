"""The pipeline and the queries without SQL, against brute force on a small fixture."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tessellum.llm import bitsample, language, lsr, packing, templates

from .test_operators import brute_pack, brute_templates, edited, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("sf")
    items = [prose(90_500 + i, 30) + ". " + prose(90_600 + i, 6) + "." for i in range(6)]
    texts = ["\n".join(prose(50 * i + k, 30) for k in range(4)) for i in range(60)]
    texts = [t + "\nhome about contact" if i % 3 == 0 else t for i, t in enumerate(texts)]
    texts += [texts[0], texts[1], edited(texts[2], 1, 0.02), texts[4] + "\n" + items[0], texts[5].replace("\n", " " + items[1] + " ", 1), "1234 5678 !!", "", None]
    rows = [(i, t, None if i > 60 and not t else "en", f"src{i % 3}", 0 if t is None else len(t)) for i, t in enumerate(texts)]
    random.Random(1).shuffle(rows)
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{root}/benchmark.parquet")
    spark.createDataFrame([(r[0], r[0] % 2, int(r[0] % 5 == 0)) for r in rows], "doc_id bigint, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(i, f"u{i}", f"<p>{prose(i, 300)}</p>") for i in range(9)], "page_id bigint, url string, html string").write.parquet(f"{root}/pages.parquet")
    return str(root), rows, items


def without_lines(texts):
    """The fixture's one boilerplate line is dropped where brute force says so."""
    dropped = brute_templates(texts, templates.MIN_DOCS, templates.SIMILARITY)
    assert set(dropped) == {0, 1}
    return ["\n".join(x for x in t.split("\n") if x != "home about contact") if n else t for t, n in zip(texts, dropped)]


def test_pipeline_against_brute_force(spark, folder):
    root, rows, items = folder
    model = language.train(spark.read.parquet(f"{root}/documents.parquet"))
    kept = [(r[0], r[1]) for r in rows if model.judge(pa.array([r[1]], pa.string()), 0.5, 1, None)["keep"][0].as_py()]
    kept = list(zip([i for i, _ in kept], without_lines([t for _, t in kept])))
    sig, words = bitsample.signatures(pa.array([t.rstrip("\n") for _, t in kept]))
    far = np.bitwise_count(sig[:, None] ^ sig[None]).sum(axis=2)
    group = list(range(len(kept)))
    for a in range(len(kept)):
        for b in range(a):
            if far[a, b] <= bitsample.MAX_DISTANCE:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    first = {}
    for g, (i, t) in zip(group, kept):
        first[g] = min(first.get(g, (i, t)), (i, t))
    survivors = sorted(first.values())
    zero = np.zeros((lsr.FEATURES, lsr.RANK), np.float32)
    found = lsr._leaks(pa.array([t for _, t in survivors]), lsr.Items(list(range(len(items))), items, zero, 8), zero, -1.0, lsr.VERBATIM, lsr.PARAPHRASE, lsr.ANSWER)
    clean = [x for k, x in enumerate(survivors) if k not in {r for r, _ in found}]
    got = corpus_pipeline.run(spark, root).collect()
    assert {r["doc_id"] for r in got} == {i for i, _ in clean}
    lengths = packing.token_counts(pa.array([t for _, t in clean])).tolist()
    bins = {}
    for r in got:
        bins.setdefault(r["bin_id"], []).append(r["n_tokens"])
    assert sorted(tuple(sorted(b, reverse=True)) for b in bins.values()) == [tuple(sorted(b, reverse=True)) for b in brute_pack(lengths, packing.CAPACITY)]


def test_stages_keep_the_columns_and_survive_an_empty_table(spark, folder):
    root, _, _ = folder
    docs = spark.read.parquet(f"{root}/documents.parquet")
    for given in (docs.limit(0), docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, given, root).columns == docs.columns, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), root).count() == 0


def test_stages_keep_clashing_columns_repeats_and_long_texts(spark, folder):
    root, _, items = folder
    long = "\n".join(prose(95_000 + k, 200) for k in range(1100))  # above a megabyte
    cut = long.index("\n", 1 << 20)
    docs = spark.read.parquet(f"{root}/documents.parquet")
    more = spark.createDataFrame([(5000, long, "en", "a", len(long)), (5001, long[:cut] + " " + items[0] + long[cut:], "en", "a", len(long)), (5002, long, "en", "b", len(long))] + [(5003, prose(96_000, 50), "en", "c", 1)] * 30, docs.schema)
    names = ("keep", "share", "n_dropped", "_keys", "sig", "detected", "c0", "t", "_k1")
    given = docs.unionByName(more).withColumns({c: F.lit(c + "!") for c in names}).repartition(4)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, given, root)
        assert out.columns == given.columns and dict(out.dtypes) == dict(given.dtypes), name
        rows = out.persist()
        assert all(r[c] == c + "!" for r in rows.select(*names).distinct().collect() for c in names), name
        ids = [r["doc_id"] for r in rows.select("doc_id").collect()]
        if name == "language_id":
            assert ids.count(5003) == 30 and {5000, 5001, 5002} <= set(ids)
        if name == "line_templates":
            assert rows.where("doc_id = 5000").first()["text"] == long
        if name == "simhash_near_dedup":
            assert ids.count(5003) == 1 and len({5000, 5001, 5002} & set(ids)) == 1
        given = rows
    packed = corpus_pipeline.STAGES[-1][1](spark, given, root).where("doc_id = 5000")
    assert packed.agg(F.sum("n_tokens")).first()[0] == int(packing.token_counts(pa.array([long]))[0])
    # the leak in a long text is found where it isn't a copy of a kept one
    kept = corpus_pipeline.drop_benchmark_leaks(spark, more, root).select("doc_id").distinct().collect()
    assert sorted(r["doc_id"] for r in kept) == [5000, 5002, 5003]


def test_run_deletes_what_it_made(spark, folder):
    from tessellum.operators import materialise

    before = len(materialise._MADE)
    corpus_pipeline.run(spark, folder[0]).count()
    assert len(materialise._MADE) == before


@pytest.mark.parametrize("name,n", [("op4_language_id", 68), ("op6_toxicity", 68), ("op8_site_quality", 68), ("op9_line_templates", 68), ("op7_mpeg_audio", 9), ("op3_cross_entropy_difference", 68)])
def test_queries_return_every_row(spark, folder, name, n):
    assert __spark_entry__.queries()[name](spark, folder[0]).count() == n


def test_queries_of_groups_and_leaks(spark, folder):
    root, _, _ = folder
    leaks = {(r["doc_id"], r["item_id"]) for r in __spark_entry__.queries()["op1_decontamination"](spark, root).collect()}
    assert leaks == {(63, 0), (64, 1)}
    groups = {r["doc_id"]: r["group_id"] for r in __spark_entry__.queries()["op10_simhash_groups"](spark, root).collect()}
    assert groups[60] == 0 and groups[61] == 1 and groups[62] == 2
    packed = __spark_entry__.queries()["op5_best_fit_packing"](spark, root).collect()
    assert len(packed) == 66
