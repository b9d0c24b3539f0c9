"""Versioned tables: write a new version, then publish it.

Versions are folders nobody else writes to. Publishing appends one row to a small log, which Spark
commits as a whole; readers take the newest published version and never see a half-written one.
"""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

_LOG = "seq long, version string, model_key string, retrained boolean"


def new_version() -> str:
    return f"{time.time_ns()}-{uuid.uuid4().hex[:8]}"


def version_path(root: str, version: str, part: str) -> str:
    return f"{root.rstrip('/')}/v={version}/{part}"


def publish(spark: SparkSession, root: str, version: str, model_key: str = "", retrained: bool = True) -> None:
    row = [(time.time_ns(), version, model_key, retrained)]
    spark.createDataFrame(row, _LOG).coalesce(1).write.mode("append").parquet(f"{root.rstrip('/')}/published")


def current(spark: SparkSession, root: str):
    """(version, model_key) in force, or None.

    The newest training decides the key; of the versions under that key the newest holds. A version
    published under an older key, however late, is never taken.
    """
    try:
        log = spark.read.schema(_LOG).parquet(f"{root.rstrip('/')}/published")
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    key = log.where("retrained").agg(F.max_by("model_key", "seq")).scalar()
    found = (
        log.where(F.col("model_key").eqNullSafe(key))
        .agg(F.max_by(F.struct("version", "model_key"), "seq").alias("v"))
        .first()
    )
    return None if found is None or found.v is None else (found.v.version, found.v.model_key)


def training(spark: SparkSession, root: str):
    """(version, model_key) of the newest training, or None: what its later versions were made with."""
    try:
        log = spark.read.schema(_LOG).parquet(f"{root.rstrip('/')}/published")
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    found = log.where("retrained").agg(F.max_by(F.struct("version", "model_key"), "seq").alias("v")).first()
    return None if found.v is None else (found.v.version, found.v.model_key)


def save(df: DataFrame, root: str, part: str, version: str, **write_options) -> None:
    df.write.options(**write_options).mode("overwrite").parquet(version_path(root, version, part))


# -- expiry --------------------------------------------------------------------------


def folders(spark: SparkSession, root: str) -> list[str]:
    """Names of what lies in `root`, nothing where it doesn't exist."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(status.getPath().getName() for status in fs.listStatus(path)) if fs.exists(path) else []


def drop_folders(spark: SparkSession, root: str, names: list[str]) -> None:
    """Remove files and folders of `root`. Spark has no writer that removes, so this asks the file system itself."""
    for name in names:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def expire(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Remove the versions before the newest `keep` published ones, and their rows of the log; returns the versions.

    What is in force stays whatever its age. Versions that were begun before all that stay and never published go as
    well. A reader that took one of the kept versions goes on undisturbed.
    """
    root = root.rstrip("/")
    found = current(spark, root)
    if found is None:
        return []
    log = spark.read.schema(_LOG).parquet(f"{root}/published").withColumn("file", F.input_file_name())
    rows = sorted(log.collect(), key=lambda r: -r.seq)
    kept = [r for i, r in enumerate(rows) if i < keep or r.version in (found[0], training(spark, root)[0])]
    names = {r.version for r in kept}
    oldest = min(int(name.split("-")[0]) if name.split("-")[0].isdigit() else 0 for name in names)
    gone = []
    for name in folders(spark, root):
        version = name.removeprefix("v=")
        stamp = version.split("-")[0]
        if name != version and version not in names and (any(r.version == version for r in rows) or stamp.isdigit() and int(stamp) < oldest):
            gone.append(version)
    drop_folders(spark, root, [f"v={v}" for v in gone])
    stale = {r.file for r in rows} - {r.file for r in kept}
    drop_folders(spark, f"{root}/published", sorted(f.rsplit("/", 1)[1] for f in stale))
    keys = {r.model_key for r in kept}
    drop_folders(spark, f"{root}/appended", [n for n in folders(spark, f"{root}/appended") if n.startswith("model_key=") and n[10:] not in keys])
    return gone
