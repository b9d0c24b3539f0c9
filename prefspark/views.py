"""Preference, candidate, article and factor tables derived from the given parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from prefspark.operators.preferences import upsert_max


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_to_preferences(events: DataFrame) -> DataFrame:
    """Raw event rows as a preference log; `event_id` is the order of arrival."""
    return events.select(
        "user_id",
        F.get_json_object("props", "$.k").cast("long").alias("item_id"),
        F.col("value").cast("float").alias("preference"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("ingest_seq"),
        F.col("event_type").alias("label"),
    )


def pref_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_to_preferences(table(spark, sf_dir, "events"))


def prefs_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert_max(pref_events(spark, sf_dir))


def pref_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
    )
    return (
        table(spark, sf_dir, "lineitem")
        .select("l_orderkey", F.col("l_partkey").alias("item_id"), "l_quantity")
        .join(orders, "l_orderkey")
        .select("user_id", "item_id", F.col("l_quantity").cast("float").alias("preference"), "ts")
    )


def prefs_o(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert_max(pref_orders(spark, sf_dir))


def cands_o(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_type").alias("label"), F.col("p_partkey").alias("item_id")
    )


def cands_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pref_events(spark, sf_dir).select("label", "item_id").distinct()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("item_id"),
        F.col("source").alias("label"),
        "text",
        F.col("lang").alias("sce_al1"),
    )


def factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as trained vectors, for scoring operators."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features")
    )
