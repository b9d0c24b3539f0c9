import os
import re
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["label", "user_id", "rank", "item_id", "value"]
    assert df.count() > 0


def test_every_definition_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    # The training-data operators, where present, have tests of their own.
    without = {n for n in set(entry.queries()) - set(entry.oracle_sql()) if not re.match(r"op\d+_|pipeline$", n)}
    assert without == {
        "train_als_explicit", "train_als_implicit", "train_all_labels", "als_error_curve", "grid_search_als",
        "train_topics", "document_topics", "topic_terms_dump", "doc_topics_dump", "infer_topics",
        "fit_streaming_kmeans", "stream_kmeans", "fold_in_least_squares",
    }


def test_entry_without_the_training_data_part(tmp_path):
    here = os.path.dirname(os.path.abspath(entry.__file__))
    copy = tmp_path / "repo"
    shutil.copytree(here, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache"))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    for remaining in (True, False):
        if not remaining:
            (copy / "corpus_pipeline.py").unlink()
        code = "import __spark_entry__ as e; names = set(e.queries()); assert 'top_n' in names and not any(n == 'pipeline' or n.startswith('op1') for n in names)"
        done = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
        assert done.returncode == 0, done.stderr[-2000:]


@pytest.mark.parametrize(
    "name",
    ["recommend_itembased", "recommend_mf", "recommend_items_for_items", "kfold_split", "nearest_centroid", "tfidf", "stream_candidates"],
)
def test_query_against_its_definition(spark, name):
    con = duckdb.connect()
    for table in ("orders", "lineitem", "part", "events", "embeddings", "documents", "customer"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    result = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    want = sorted(result.fetchall(), key=repr)
    got = entry.queries()[name](spark, SF).select(*columns)
    assert sorted(map(tuple, got.collect()), key=repr) == want
