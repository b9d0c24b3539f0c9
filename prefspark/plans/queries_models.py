"""Trained models. Their numbers have no SQL definition; tests check their properties."""

from pyspark.sql import functions as F

from prefspark import views as V
from prefspark.functions.text import clean
from prefspark.operators import clustering as K, factors as M, splits as S, topics as L, tuning as T
from prefspark.operators.preferences import preferences_for_label
from prefspark.operators.text import spread
from prefspark.plans.catalog import query
from prefspark.plans.session import materialize, tasks
from prefspark.sources import sinks


def _both(users, items):
    return users.withColumn("side", F.lit("user")).unionByName(items.withColumn("side", F.lit("item")))


@query("train_als_explicit")
def train_als_explicit(spark, d):
    return _both(*M.train_als_explicit(V.prefs_o(spark, d), rank=8, reg=0.05, iters=5))


@query("train_als_implicit")
def train_als_implicit(spark, d):
    return _both(*M.train_als_implicit(V.prefs_o(spark, d), rank=8, reg=0.05, iters=5, alpha=40.0))


@query("train_all_labels")
def train_all_labels(spark, d):
    return _both(*M.train_all_labels(V.prefs_o(spark, d), V.cands_o(spark, d), rank=8, iters=5, implicit=False))


@query("als_error_curve")
def als_error_curve(spark, d):
    train, test = (materialize(p, "curve") for p in S.kfold_split(V.prefs_e(spark, d), 0))
    errors = T.als_error_curve(train, test, rank=4, reg=0.05, iters=3)
    return spark.createDataFrame(list(enumerate(errors)), "iterations int, error double")


@query("grid_search_als")
def grid_search_als(spark, d):
    return T.grid_search_als(
        V.prefs_e(spark, d), V.cands_e(spark, d), "purchase", [4], [0.05], [40.0], [2], parallelism=3
    )


def _docs(spark, d):
    docs = spread(V.documents(spark, d).withColumnRenamed("doc_id", "item_id"), tasks(spark))
    return docs.select("item_id", "lang", clean(F.col("text")).alias("text"))


def _model(docs):
    return L.train_topics(docs.select("item_id", "text"), k=8, iters=5, subsampling=1.0, partitions=tasks(docs.sparkSession))


@query("train_topics")
def train_topics(spark, d):
    docs = materialize(_docs(spark, d), "docs")
    return L.topic_terms(_model(docs), 20)


@query("document_topics")
def document_topics(spark, d):
    docs = materialize(_docs(spark, d), "docs")
    return L.document_topics(_model(docs))


@query("topic_terms_dump")
def topic_terms_dump(spark, d):
    docs = materialize(_docs(spark, d), "docs")
    return sinks.topic_terms_dump(_model(docs), 100)


@query("doc_topics_dump")
def doc_topics_dump(spark, d):
    docs = materialize(_docs(spark, d), "docs")
    return sinks.doc_topics_dump(_model(docs), n=100)


@query("infer_topics")
def infer_topics(spark, d):
    """Train on the labelled documents, infer the others."""
    docs = materialize(_docs(spark, d), "docs")
    labelled = V.table(spark, d, "labels").select(F.col("doc_id").alias("item_id")).distinct()
    known = docs.join(labelled, "item_id", "left_semi")
    return L.infer_topics(_model(known), docs, known, partitions=tasks(spark))


@query("fit_streaming_kmeans")
def fit_streaming_kmeans(spark, d):
    # Written once: every pass reads them.
    vectors = materialize(K.item_user_vectors(V.prefs_o(spark, d), 40), "vectors")
    return K.fit_streaming_kmeans(vectors, k=12, cutoff=20.0)[0]
