"""Seeded train/test folds without a global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

DEFAULT_SEED = 20_260
FOLDS = 3


def order_key(seed: int) -> Column:
    """Pseudo-random position of a row, the same wherever the row is processed."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("user_id").cast("string"), F.col("item_id").cast("string")))


def fold_bounds(prefs: DataFrame, frac: float = 0.3, seed: int = DEFAULT_SEED) -> DataFrame:
    """Order keys at which the folds start and end: one row per boundary (0..3).

    `prefs` holds one row per (user, item). Rows are counted per 4-digit prefix of the key (at most 65,536 counts). Only the prefixes in
    which a boundary falls are ranked row by row, each in its own window.
    """
    keys = prefs.select(order_key(seed).alias("k"))
    counts = keys.groupBy(F.substring("k", 1, 4).alias("prefix")).agg(F.count("*").alias("rows"))
    running = Window.orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    # Windows without a key are safe here: `counts` never exceeds 65,536 rows.
    placed = counts.select(
        "prefix",
        "rows",
        F.coalesce(F.sum("rows").over(running), F.lit(0)).alias("before"),
        F.floor(F.sum("rows").over(whole) * F.lit(frac)).alias("bin"),
    )
    boundaries = placed.select(
        "*", F.explode(F.array(*(F.lit(f) for f in range(FOLDS + 1)))).alias("boundary")
    ).where(
        (F.col("boundary") * F.col("bin") >= F.col("before"))
        & (F.col("boundary") * F.col("bin") < F.col("before") + F.col("rows"))
    )
    inside = Window.partitionBy("prefix", "boundary").orderBy("k")
    return (
        keys.withColumn("prefix", F.substring("k", 1, 4))
        .join(boundaries, "prefix")
        .withColumn("position", F.col("before") + F.row_number().over(inside) - 1)
        .where(F.col("position") == F.col("boundary") * F.col("bin"))
        .select("boundary", "k")
    )


def assign_folds(prefs: DataFrame, frac: float = 0.3, seed: int = DEFAULT_SEED) -> DataFrame:
    """Add `fold`: 0, 1, 2 for the rows some fold tests, null for the rest.

    Fold f tests the positions [bin*f, bin*(f+1)) of the seeded order, bin = floor(frac * rows).
    Given the bounds this is a filter on each row alone: the table is not shuffled.
    """
    bounds = fold_bounds(prefs, frac, seed).groupBy().agg(
        *(F.max(F.when(F.col("boundary") == f, F.col("k"))).alias(f"k{f}") for f in range(FOLDS + 1))
    )
    marks = bounds.select(F.struct("*").alias("marks")).scalar()
    keyed = prefs.withColumn("_k", order_key(seed)).withColumn("_m", marks)
    fold = F.lit(None).cast("int")
    for f in reversed(range(FOLDS)):
        start, end = F.col(f"_m.k{f}"), F.col(f"_m.k{f + 1}")
        # A fold with no start is empty; one with no end runs to the last row.
        fold = F.when((F.col("_k") >= start) & (end.isNull() | (F.col("_k") < end)), F.lit(f)).otherwise(fold)
    return keyed.withColumn("fold", fold).drop("_k", "_m")


def kfold_split(
    prefs: DataFrame, fold: int, frac: float = 0.3, seed: int = DEFAULT_SEED
) -> tuple[DataFrame, DataFrame]:
    """(train, test) of one fold."""
    if fold not in range(FOLDS):
        raise ValueError(f"fold must be 0..{FOLDS - 1}")
    folded = assign_folds(prefs, frac, seed)
    is_test = F.col("fold").eqNullSafe(F.lit(fold))
    return folded.where(~is_test).drop("fold"), folded.where(is_test).drop("fold")
