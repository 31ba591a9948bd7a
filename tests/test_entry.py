import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from tessellum import registry

ROOT = Path(__file__).resolve().parents[1]
DATA = Path("/root/testdata/sf0.001")


def test_every_query_has_a_name_and_sql_belongs_to_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert len(registry.QUERIES) >= 50


def test_entry_works_without_the_corpus_subpackage(tmp_path):
    shutil.copytree(ROOT / "tessellum", tmp_path / "tessellum", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and 'hybrid_search' in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, timeout=120)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["chunk_atoms", "word_bm25", "parse_hint", "crdt_merge", "context_budget", "replace_classify", "queue_claim", "edge_firewall"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    want = con.sql(registry.ORACLES[name])
    got = registry.QUERIES[name](spark, str(DATA))
    names = sorted(want.columns)
    key = lambda rows: sorted(str(tuple(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r)) for r in rows)
    assert sorted(got.columns) == names
    assert key(map(tuple, got.select(*names).collect())) == key(want.project(", ".join(f'"{n}"' for n in names)).fetchall())
