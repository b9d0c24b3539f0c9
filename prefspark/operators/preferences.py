"""Preference table: lookups, upserts, retention."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from prefspark.functions.columns import epoch_hours, id_remap, slot_hours, slot_seq

KEY = ["user_id", "item_id"]
TRIPLE = ["user_id", "item_id", "preference"]


def remap_ids(df: DataFrame, *columns: str) -> DataFrame:
    """Bring id columns into the 32-bit range, on every way in."""
    return df.withColumns({c: id_remap(F.col(c)) for c in columns or KEY})


# -- lookups -----------------------------------------------------------------


def preference_lookup(prefs: DataFrame, keys: DataFrame) -> DataFrame:
    """Values of the asked (user, item) keys; an unknown key has no row."""
    return prefs.join(keys.select(*KEY).distinct(), KEY, "left_semi").select(*TRIPLE)


def preference_time_lookup(log: DataFrame, keys: DataFrame) -> DataFrame:
    """Time of the newest write of the asked keys."""
    return (
        log.join(keys.select(*KEY).distinct(), KEY, "left_semi")
        .groupBy(*KEY)
        .agg(F.max("ts").alias("ts"))
    )


def preferences_for_label(
    prefs: DataFrame, cands: DataFrame, label: str | Column | None = None
) -> DataFrame:
    """Training view: triples whose item is a candidate of the label.

    With no label given every label is answered at once and kept as a column.
    """
    cands = cands.select("label", "item_id").distinct()
    triples = prefs.select(*TRIPLE).distinct()
    if label is None:
        return triples.join(cands, "item_id").select("label", *TRIPLE)
    return triples.join(cands.where(F.col("label") == label), "item_id", "left_semi")


def prefs_of_users(
    prefs: DataFrame, users: DataFrame, cands: DataFrame | None = None, label: str | None = None
) -> DataFrame:
    """Distinct triples of the given users, restricted to a label's items if one is named."""
    mine = prefs.select(*TRIPLE).join(users.select("user_id").distinct(), "user_id", "left_semi")
    if cands is not None:
        mine = mine.join(
            cands.where(F.col("label") == label).select("item_id"), "item_id", "left_semi"
        )
    return mine.select(*TRIPLE).distinct()


def prefs_of_items(prefs: DataFrame, items: DataFrame) -> DataFrame:
    return (
        prefs.select(*TRIPLE)
        .join(items.select("item_id").distinct(), "item_id", "left_semi")
        .select(*TRIPLE)
        .distinct()
    )


def heavy_users(prefs: DataFrame, min_ratings: int) -> DataFrame:
    """Users with strictly more than `min_ratings` rows."""
    return (
        prefs.groupBy("user_id")
        .agg(F.count("*").alias("ratings"))
        .where(F.col("ratings") > min_ratings)
    )


def items_of_users(prefs: DataFrame, users: DataFrame) -> DataFrame:
    return (
        prefs.join(users.select("user_id").distinct(), "user_id", "left_semi")
        .select("item_id")
        .distinct()
    )


# -- upserts -----------------------------------------------------------------


def upsert_last(state: DataFrame, updates: DataFrame | None = None, order: str = "ingest_seq") -> DataFrame:
    """Insert or overwrite on (user, item): the write with the highest `order` wins."""
    rows = state if updates is None else state.unionByName(updates, allowMissingColumns=True)
    return rows.groupBy(*KEY).agg(
        F.max_by("preference", F.col(order)).alias("preference"), F.max(order).alias(order)
    )


def upsert_max(state: DataFrame, updates: DataFrame | None = None) -> DataFrame:
    """Insert or keep the larger value; the order of writes does not matter."""
    rows = state.select(*TRIPLE)
    if updates is not None:
        rows = rows.unionByName(updates.select(*TRIPLE))
    return rows.groupBy(*KEY).agg(F.max("preference").alias("preference"))


def remove_preference(state: DataFrame, keys: DataFrame) -> DataFrame:
    return state.join(keys.select(*KEY).distinct(), KEY, "left_anti").select(*state.columns)


# -- retention ring ------------------------------------------------------------


def assign_slot(log: DataFrame, window_hours: int = 24) -> DataFrame:
    """Add the running slot number (the partition column of the log) and the ring position."""
    return log.withColumn("slot_seq", slot_seq(F.col("ts"), window_hours)).withColumn(
        "slot", (F.col("slot_seq") % 6).cast("int")
    )


def _as_timestamp(now: Column | dt.datetime | str) -> Column:
    return now if isinstance(now, Column) else F.lit(now).cast("timestamp")


def purge_old(slotted: DataFrame, now: Column | dt.datetime | str, window_hours: int = 24) -> DataFrame:
    """Keep the current slot and the four before it.

    The bound is a constant on `slot_seq`, so on a log partitioned by that column older folders
    are never listed.
    """
    current = F.floor(epoch_hours(_as_timestamp(now)) / slot_hours(window_hours))
    return slotted.where(F.col("slot_seq") >= current - 4)


def collapse_slots(slotted: DataFrame, mode: str = "last") -> DataFrame:
    """One row per (user, item) out of the values its slots hold."""
    if mode == "max":
        return upsert_max(slotted)
    if mode == "last":
        return slotted.groupBy(*KEY).agg(
            F.max_by("preference", F.struct("slot_seq", "ts", "ingest_seq")).alias("preference")
        )
    raise ValueError(f"mode must be 'last' or 'max', not {mode!r}")


# -- counts ----------------------------------------------------------------------


def num_users(prefs: DataFrame, cands: DataFrame | None = None) -> DataFrame:
    """Distinct users, per label when candidates are given."""
    return _count_distinct(prefs, cands, "user_id", "num_users")


def num_items(prefs: DataFrame, cands: DataFrame | None = None) -> DataFrame:
    return _count_distinct(prefs, cands, "item_id", "num_items")


def _count_distinct(prefs, cands, column, name):
    if cands is None:
        return prefs.agg(F.countDistinct(column).alias(name))
    rows = prefs.join(cands.select("label", "item_id").distinct(), "item_id")
    return rows.groupBy("label").agg(F.countDistinct(column).alias(name))


def distinct_users(prefs: DataFrame, cands: DataFrame | None = None) -> DataFrame:
    if cands is None:
        return prefs.select("user_id").distinct()
    return prefs.join(cands, "item_id").select("label", "user_id").distinct()


def distinct_items(prefs: DataFrame, cands: DataFrame | None = None) -> DataFrame:
    """Items somebody has rated; per label when candidates are given."""
    rated = prefs.select("item_id").distinct()
    if cands is None:
        return rated
    return cands.select("label", "item_id").distinct().join(rated, "item_id", "left_semi")


def item_pref_count(prefs: DataFrame, cands: DataFrame | None = None) -> DataFrame:
    counts = prefs.groupBy("item_id").agg(F.count("*").alias("num_prefs"))
    if cands is None:
        return counts
    return counts.join(cands.select("label", "item_id").distinct(), "item_id")


def preference_bounds(prefs: DataFrame) -> DataFrame:
    return prefs.agg(
        F.min("preference").alias("min_preference"), F.max("preference").alias("max_preference")
    )


def num_entries(prefs: DataFrame, cands: DataFrame) -> DataFrame:
    """Distinct triples per label."""
    return preferences_for_label(prefs, cands).groupBy("label").agg(F.count("*").alias("num_entries"))


def item_average_rating(prefs: DataFrame) -> DataFrame:
    return prefs.groupBy("item_id").agg(
        F.avg(F.col("preference").cast("double")).alias("average_rating")
    )
