"""Workers that don't have the package: what tasks need travels with the job."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

JOB = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config(
    "spark.checkpoint.dir", {shared!r}).getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
import corpus_pipeline
from prefspark.llm import classifier, hmm, ngram_join, source_audit, vector_codes
docs = spark.createDataFrame([(i, "alpha beta gamma delta epsilon " * (2 + i % 3) + "w%d" % i, "en", "s%d" % (i % 2), 1) for i in range(40)],
                             "doc_id long, text string, lang string, source string, n_chars long")
labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
vectors = spark.createDataFrame([(i, [float(i), 1.0] * 8, 1) for i in range(20)], "vec_id long, embedding array<float>, label int")
counts = [
    hmm.score_documents(docs, own_classes=4, buckets=4, by_word=True), ngram_join.ngram_components(docs), corpus_pipeline.near_duplicates(spark, docs, ""),
    classifier.score_quality(docs, labels), source_audit.audit_sources(docs, min_docs=2), vector_codes.encode_vectors(vectors),
]
print("rows", *(df.count() for df in counts))
"""


def test_jobs_run_where_only_the_driver_has_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_HOME")}
    job = JOB.format(repo=REPO, shared=str(tmp_path / "shared"))
    done = subprocess.run([sys.executable, "-c", job], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=400)
    assert done.returncode == 0, done.stderr[-3000:]
    rows = done.stdout.split("rows ")[1].split()
    assert rows[0] == rows[1] == rows[3] == "40" and rows[5] == "20" and 0 < int(rows[2]) <= 40 and int(rows[4]) > 0
