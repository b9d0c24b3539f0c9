"""Tables that streams add to: a base and the batches since, under a published manifest.

A batch writes the folder `<path>/batch_id=N` and replaces it when Spark repeats it. `compact` folds the base and the
batches up to one into a new base beside the table and publishes it with that batch's number; readers take the newest
published base and the batches after it. `expire` removes what no kept base needs. So what a reader or a
batch lists is bounded by the batches between two compactions, not by the stream's age.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from prefspark.plans.publish import current, drop_folders, expire as expire_versions, folders, new_version, publish, save, version_path


def write_batch(df: DataFrame, batch_id: int, path: str, *partitions: str) -> None:
    (
        df.withColumn("batch_id", F.lit(batch_id).cast("long"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partitions, "batch_id")
        .parquet(path)
    )


def base_root(path: str) -> str:
    return f"{path.rstrip('/')}_base"


def read_table(spark: SparkSession, path: str, schema: str | None = None, upto: int | None = None) -> DataFrame | None:
    """The base in force and the batches after it (up to `upto`), each row with its batch_id; None where nothing was written."""
    base = current(spark, base_root(path))
    try:
        deltas = (spark.read if schema is None else spark.read.schema(schema)).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        deltas = None
    if deltas is not None and upto is not None:
        deltas = deltas.where(F.col("batch_id") <= upto)
    if base is None:
        return deltas
    version, last = base
    held = spark.read.parquet(version_path(base_root(path), version, "rows"))
    if deltas is None:
        return held
    return held.unionByName(deltas.where(F.col("batch_id") > int(last)).select(*held.columns))


def compact(spark: SparkSession, path: str, fold: Callable[[DataFrame], DataFrame], upto: int, schema: str | None = None) -> str | None:
    """Fold everything up to batch `upto` into a new base and put it in force; returns its version.

    `fold` keeps the columns, batch_id included, and may drop rows that later folds don't need. Batches
    after `upto` are not touched, so a batch that Spark may still repeat stays a batch.
    """
    before = current(spark, base_root(path))
    rows = read_table(spark, path, schema, upto)
    if rows is None or before is not None and int(before[1]) >= upto:
        return None
    version = new_version()
    save(fold(rows).select(*rows.columns), base_root(path), "rows", version)
    publish(spark, base_root(path), version, str(upto))
    return version


def expire(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Remove the bases before the newest `keep`, and the batches that the oldest kept one holds; returns all their names.

    A reader that began with one of the kept bases goes on undisturbed.
    """
    gone = expire_versions(spark, base_root(path), keep)
    found = current(spark, base_root(path))
    if found is None:
        return gone
    first = spark.read.parquet(f"{base_root(path)}/published").agg(F.min(F.col("model_key").cast("long"))).first()[0]
    batches = [n for n in folders(spark, path) if n.startswith("batch_id=") and int(n[9:]) <= first]
    drop_folders(spark, path, batches)
    return gone + batches


def tidy(spark: SparkSession, path: str, fold: Callable[[DataFrame], DataFrame], batch_id: int, every: int | None, schema: str | None = None) -> None:
    """Inside a batch: every so many batches, compact those before it and expire."""
    if every and batch_id and batch_id % every == 0:
        compact(spark, path, fold, batch_id - 1, schema)
        expire(spark, path)
