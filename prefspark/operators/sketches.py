"""Distinct counts that can be merged: sketches of users and items per label and retention slot.

Exact counts (`operators/preferences.py`) stay the default. A sketch has a fixed size, whatever it counted, so the
ring's counts come from its slots' sketches without a row being read again, and a new slot is one more sketch.
Null users and items are not counted; a label without rows has no sketch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from prefspark.operators.factors import MIN_ITEMS, MIN_USERS

#: Base-2 logarithm of a sketch's registers: a standard error of about 0.4 %.
LG_K = 16


def distinct_sketches(prefs: DataFrame, cands: DataFrame, lg_k: int = LG_K) -> DataFrame:
    """(label[, slot_seq], users, items): a sketch each, per slot where the rows carry `slot_seq`."""
    slot = ["slot_seq"] if "slot_seq" in prefs.columns else []
    rows = prefs.select(*slot, "user_id", "item_id").join(cands.select("label", "item_id").distinct(), "item_id")
    return rows.groupBy("label", *slot).agg(
        F.hll_sketch_agg("user_id", lg_k).alias("users"), F.hll_sketch_agg("item_id", lg_k).alias("items")
    )


def merge_sketches(sketches: DataFrame) -> DataFrame:
    """(label, users, items) over all slots; sketches of several tables may be united first."""
    return sketches.groupBy("label").agg(F.hll_union_agg("users").alias("users"), F.hll_union_agg("items").alias("items"))


def estimated_counts(sketches: DataFrame) -> DataFrame:
    """(label, num_users, num_items) as the sketches estimate them."""
    return merge_sketches(sketches).select(
        "label", F.hll_sketch_estimate("users").alias("num_users"), F.hll_sketch_estimate("items").alias("num_items")
    )


def estimated_gate(sketches: DataFrame) -> DataFrame:
    """`training_gate` from sketches: counts as small as its limits are exact in a sketch."""
    return estimated_counts(sketches).where((F.col("num_items") >= MIN_ITEMS) & (F.col("num_users") >= MIN_USERS))
