"""Readers for preference, candidate, article and stop-word files and for the preference table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from prefspark.operators.preferences import remap_ids
from prefspark.schemas import CANDIDATES, PREFERENCES

# Fixed value: fields are separated by a tab or a comma.
SEPARATOR = "[\\t,]"


def _fields(lines: DataFrame, schema) -> tuple[DataFrame, list[Column]]:
    parts = lines.withColumn("_f", F.split("value", SEPARATOR))
    return parts, [F.get("_f", F.lit(n)) for n in range(len(schema.fields))]


def _read(spark: SparkSession, path: str, schema, mode: str):
    if mode not in ("fail", "quarantine"):
        raise ValueError("mode must be 'fail' or 'quarantine'")
    lines = spark.read.text(path)
    parts, raw = _fields(lines, schema)
    named = list(zip(raw, schema.fields))
    if mode == "fail":
        checked = [
            F.when(r.isNotNull(), r)
            .otherwise(F.raise_error(F.concat(F.lit("too few fields: "), F.col("value"))))
            .cast(f.dataType)
            .alias(f.name)
            for r, f in named
        ]
        return parts.select(*checked)
    parts = parts.withColumns({f.name: r.try_cast(f.dataType) for r, f in named})
    bad = F.lit(False)
    for f in schema.fields:
        bad = bad | F.col(f.name).isNull()
    good = parts.where(~bad).select(*schema.fieldNames())
    rejects = parts.where(bad).select("value", F.input_file_name().alias("file"))
    return good, rejects


def read_preferences(spark: SparkSession, path: str, mode: str = "fail", remap: bool = True):
    """user, item, value per line, no header; further fields are ignored.

    A bad line fails the job; with mode="quarantine" the result is (rows, rejected lines).
    """
    out = _read(spark, path, PREFERENCES, mode)
    if not remap:
        return out
    if mode == "quarantine":
        return remap_ids(out[0]), out[1]
    return remap_ids(out)


def read_candidates(spark: SparkSession, path: str, mode: str = "fail", remap: bool = True):
    """label, item per line, as `read_preferences`."""
    out = _read(spark, path, CANDIDATES, mode)
    if not remap:
        return out
    if mode == "quarantine":
        return remap_ids(out[0], "item_id"), out[1]
    return remap_ids(out, "item_id")


def scan_preferences(
    spark: SparkSession,
    path_or_url: str,
    table: str = "preferences",
    partitions: int = 64,
    bounds: tuple[int, int] = (0, 2147483647),
    fetch_size: int = 10_000,
    properties: dict | None = None,
) -> DataFrame:
    """The whole preference table, from parquet or from a database read in ranges of user ids."""
    if path_or_url.startswith("jdbc:"):
        return spark.read.jdbc(
            path_or_url,
            table,
            column="user_id",
            lowerBound=bounds[0],
            upperBound=bounds[1],
            numPartitions=partitions,
            properties={"fetchsize": str(fetch_size), **(properties or {})},
        )
    return spark.read.parquet(path_or_url)


def read_articles(spark: SparkSession, directory: str) -> DataFrame:
    """One file per article; the file name is the item id."""
    return spark.read.text(directory, wholetext=True).select(
        F.regexp_extract("_metadata.file_name", "^([^.]+)", 1).cast("long").alias("item_id"),
        F.col("value").alias("text"),
    )


def read_stop_words(spark: SparkSession, path: str) -> list[str]:
    """One word per line. A stop-word list is a language's worth of words, not data."""
    rows = spark.read.text(path).select(F.trim("value").alias("w")).where("w <> ''").distinct()
    return sorted(r.w for r in rows.collect())
