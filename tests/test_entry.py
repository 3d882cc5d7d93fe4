"""The driver's contract: oracles agree on the smallest tables, and the library stands without its language-model part."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

ROOT, SMALL = Path(__file__).parents[1], "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = ["tokenize", "bm25f_top10", "knn_exact", "reciprocal_rank_fusion", "transitions", "merkle_tree", "snapshot_changes", "distinct_edges", "innermost_span", "stale_confusion", "splits", "replay", "merge_preview", "refresh_freshness", "timeline_forward", "memory_preamble", "debounce", "page_links", "api_edges", "index_incremental", "resolved_edges", "branch_states", "merkle_refresh", "encoded_neighbours", "knapsack_value"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


def rows(df):
    df = df[sorted(df.columns)]
    plain = lambda x: round(float(x), 6) if hasattr(x, "__float__") and not isinstance(x, bool) and str(x) not in ("nan", "NaT") else str(x).replace("NaT", "None").replace("nan", "None")
    return list(df.columns), sorted(tuple(map(str, map(plain, r))) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", CHECKED)
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    assert rows(entry.queries()[name](spark, SMALL).toPandas()) == rows(con.execute(entry.oracle_sql()[name]).df())


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "id", "score", "rank"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("gone", [["corvane/llm", "corpus_pipeline.py"], ["corvane/llm"], ["corpus_pipeline.py"]])
def test_import_without_the_llm_part(tmp_path, gone):
    shutil.copytree(ROOT / "corvane", tmp_path / "corvane", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    for name in gone:
        path = tmp_path / name
        if path.is_dir():
            shutil.rmtree(path)
        else:
            path.unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 90, len(q); assert 'pipeline' not in q; e.oracle_sql()"
    found = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert found.returncode == 0, found.stderr


def test_packing_options_hold_every_part(spark):
    from corvane.plans.packings import options

    rows, _ = options(spark, SMALL)
    assert rows.filter("level <> 'omit'").count() == spark.read.parquet(f"{SMALL}/part.parquet").count()
