"""Best N rows per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F


def top_n(
    scored: DataFrame,
    key: str | Sequence[str],
    how_many: int = 10,
    value: str = "value",
    item: str = "item_id",
    limit_column: str | None = None,
) -> DataFrame:
    """Rank by value, ties by item id; undefined scores never enter.

    Spark limits every key inside each task before it shuffles, so a key that holds a large share
    of the rows sends at most `how_many` of them per task. `limit_column` lets every key ask for
    fewer than `how_many`.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if how_many < 1:
        raise ValueError("how_many must be at least 1")
    order = Window.partitionBy(*keys).orderBy(F.col(value).desc(), F.col(item).asc())
    ranked = (
        scored.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= how_many)
    )
    if limit_column is not None:
        ranked = ranked.where(F.col("rank") <= F.col(limit_column))
    return ranked


def top_similar_items(sims: DataFrame, k: int = 25) -> DataFrame:
    """The k most similar items of every item; extra key columns (a label) are kept apart."""
    extra = [c for c in sims.columns if c not in ("item_id", "similar_item_id", "similarity")]
    return top_n(sims, [*extra, "item_id"], k, "similarity", "similar_item_id")
