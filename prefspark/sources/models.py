"""Trained models on shared storage."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.ml.clustering import LocalLDAModel
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from prefspark.operators.topics import TopicModel
from prefspark.plans.publish import current, new_version, publish, save, training, version_path
from prefspark.schemas import FACTORS, SIMILARITIES, TOPICS


def read_or_none(spark: SparkSession, path: str, schema=None) -> DataFrame | None:
    """A parquet table, or None where nothing was written yet."""
    try:
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def write_similarities(sims: DataFrame, path: str) -> None:
    """Text lines item,similar item,value; a model of several labels has a folder for each."""
    columns = ["item_id", "similar_item_id", "similarity"]
    if "label" in sims.columns:
        sims.select(*columns, "label").write.mode("overwrite").partitionBy("label").csv(path)
    else:
        sims.select(*columns).write.mode("overwrite").csv(path)


def read_similarities(spark: SparkSession, path: str, labelled: bool = False) -> DataFrame:
    schema = StructType([*SIMILARITIES.fields, *([StructField("label", StringType())] if labelled else [])])
    return spark.read.schema(schema).csv(path)


def save_similarities(sims: DataFrame, root: str) -> str:
    """Write the item-based model, labels included, as a new version and put it in force."""
    version = new_version()
    save(sims, root, "similarities", version)
    publish(sims.sparkSession, root, version)
    return version


def load_similarities(spark: SparkSession, root: str) -> DataFrame | None:
    """The model in force, or None where nothing is trained yet."""
    found = current(spark, root)
    return None if found is None else spark.read.parquet(version_path(root, found[0], "similarities"))


def save_factors(users: DataFrame, items: DataFrame, root: str) -> str:
    """Write both tables as a new version and put it in force."""
    version = new_version()
    save(users, root, "users", version)
    save(items, root, "items", version)
    publish(users.sparkSession, root, version)
    return version


def load_factors(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """User and item vectors in force; two empty tables where nothing is trained yet.

    Call it again (in every micro-batch, say) to see a newer model.
    """
    found = current(spark, root)
    if found is None:
        return spark.createDataFrame([], FACTORS), spark.createDataFrame([], FACTORS)
    users, items = (spark.read.parquet(version_path(root, found[0], p)) for p in ("users", "items"))
    return users, items


def save_topic_model(topics: DataFrame, root: str, expected_key: str | None = None) -> str | None:
    """Save item topics. Without a key this is a new training and makes one.

    With a key the rows were inferred under that training: they are discarded, and None returned, if
    another training has been published since.
    """
    spark = topics.sparkSession
    if expected_key is not None:
        found = current(spark, root)
        if found is None or found[1] != expected_key:
            return None
    key = expected_key or uuid.uuid4().hex[:10]
    version = new_version()
    save(topics.withColumn("model_key", F.lit(key)), root, "topics", version)
    publish(spark, root, version, key, retrained=expected_key is None)
    return key


def load_topic_model(spark: SparkSession, root: str, but_batch: int | None = None) -> tuple[DataFrame, str | None]:
    """(item topics, key) in force: those of the version and those appended under its key.

    `but_batch` leaves out what one streaming batch appended, which it will write again.
    """
    found = current(spark, root)
    if found is None:
        return spark.createDataFrame([], TOPICS), None
    version, key = found
    topics = spark.read.parquet(version_path(root, version, "topics")).select("item_id", "topics")
    added = read_or_none(spark, f"{root.rstrip('/')}/appended", _APPENDED)
    if added is not None:
        added = added.where(F.col("model_key") == key)
        if but_batch is not None:
            added = added.where(F.col("batch_id") != but_batch)
        topics = topics.unionByName(added.select("item_id", "topics"))
    return topics, key


_APPENDED = "item_id long, topics array<double>, model_key string, batch_id long"


def append_topics(topics: DataFrame, root: str, expected_key: str, batch_id: int) -> str | None:
    """Add item topics inferred under a key; a batch written twice replaces itself.

    They are discarded, and None returned, if another training has been published since.
    """
    found = current(topics.sparkSession, root)
    if found is None or found[1] != expected_key:
        return None
    (
        topics.select("item_id", "topics", F.lit(expected_key).alias("model_key"), F.lit(batch_id).cast("long").alias("batch_id"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("model_key", "batch_id")
        .parquet(f"{root.rstrip('/')}/appended")
    )
    return expected_key


def save_trained_topics(model: TopicModel, topics: DataFrame, root: str) -> str:
    """Publish a new training whole: dictionary, weights and topics of the slots, and the items' topics."""
    spark, key, version = topics.sparkSession, uuid.uuid4().hex[:10], new_version()
    model.lda.write().overwrite().save(version_path(root, version, "lda"))
    save(model.terms, root, "terms", version)
    if model.weights is not None:
        save(model.weights, root, "weights", version)
    save(spark.createDataFrame([(model.bits, model.weights is not None)], "bits int, weighted boolean"), root, "space", version)
    save(topics.withColumn("model_key", F.lit(key)), root, "topics", version)
    publish(spark, root, version, key)
    return key


def load_trained_topics(spark: SparkSession, root: str) -> tuple[TopicModel, str] | None:
    """The newest training's model and its key; None where none was stored."""
    found = training(spark, root)
    if found is None:
        return None
    version, key = found
    stored = read_or_none(spark, version_path(root, version, "space"))
    if stored is None:
        return None
    space, read = stored.first(), lambda part: spark.read.parquet(version_path(root, version, part))
    lda = LocalLDAModel.load(version_path(root, version, "lda"))
    return TopicModel(space.bits, read("terms"), read("weights") if space.weighted else None, lda), key
