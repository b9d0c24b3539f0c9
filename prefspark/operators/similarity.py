"""Item-item statistics and similarities.

Preferences hold one row per (user, item), see `upsert_max` and `collapse_slots`. With a `label` column
they hold one row per (label, user, item), and pairs are formed per label in one plan.

How pairs are counted. A user's basket of d items stands for d*(d-1)/2 pairs. Every basket is cut into
chunks of about `chunk_items` items, packed into one array each; most are one chunk. A chunk's own pairs come
from its sorted array, and every two chunks of a basket meet once, as arrays: a rating is copied once per chunk of its
own basket at most, so a user who owns a third of the table is spread over many tasks, and no pair is made twice
or thrown away. Pairs are summed inside the task and packed before they are shuffled (`pair_sums`). What a rating costs
follows its basket, not the catalogue.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from prefspark.functions.columns import ALWAYS_DEFINED, rounded, similarity, uses
from prefspark.operators.pair_sums import PackedSums, basket_sums, entry_type, sums_type
from prefspark.operators.topk import top_similar_items

SUMS = ["both", "sxy", "sx", "sy", "sxx", "syy"]

CHUNK_ITEMS = 512


def _extra_keys(prefs: DataFrame) -> list[str]:
    return ["label"] if "label" in prefs.columns else []


def _baskets(prefs: DataFrame, carry: list[str]) -> DataFrame:
    return prefs.select(
        *_extra_keys(prefs), "user_id", "item_id", F.col("preference").cast("double").alias("x"), *carry
    )


def _carried(carry: list[str]) -> list[str]:
    return [f"{c}_{side}" for c in carry for side in "ij"]


def _packed(baskets: DataFrame, owner: list[str], chunk_items: int) -> DataFrame:
    """(owner, own, chunks, held): the chunks of every basket, their ratings as an array."""
    long = (
        baskets.groupBy(*owner)
        .agg(F.ceil(F.count("*") / chunk_items).alias("chunks"))
        .where(F.col("chunks") > 1)
    )
    chunks = F.coalesce("chunks", F.lit(1)).alias("chunks")
    dealt = baskets.join(long, owner, "left").withColumn("own", F.pmod(F.xxhash64("item_id"), chunks))
    rating = F.struct("item_id", *(c for c in baskets.columns if c not in (*owner, "item_id")))
    return dealt.groupBy(*owner, "own", chunks).agg(F.collect_list(rating).alias("held"))


def _met(packed: DataFrame, owner: list[str]) -> DataFrame:
    """(owner, left, right): every chunk by itself, and every two chunks of a basket."""
    alone = packed.select(*owner, F.col("held").alias("left"), F.lit(None).cast(packed.schema["held"].dataType).alias("right"))
    long = packed.where("chunks > 1")
    left = long.where("own < chunks - 1").select(*owner, F.col("held").alias("left"), F.explode(F.sequence(F.col("own") + 1, F.col("chunks") - 1)).alias("own"))
    return alone.unionByName(left.join(long.select(*owner, "own", F.col("held").alias("right")), [*owner, "own"]).drop("own"))


def _pairs(packed: DataFrame, owner: list[str]) -> DataFrame:
    """(owner, a, b): every two ratings of a basket, the lower item first, as rows. `basket_sums` makes the same without rows."""
    each = _met(packed, owner).select(*owner, "right", F.col("left").alias("own"), F.explode("left").alias("a"))
    met = each.select(*owner, "right", "a", F.explode(F.coalesce("right", "own")).alias("b"))
    lower = F.col("a.item_id") < F.col("b.item_id")
    crossed = F.col("right").isNotNull() & (F.col("a.item_id") > F.col("b.item_id"))
    return met.where(lower | crossed).select(*owner, F.when(lower, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(lower, F.col("b")).otherwise(F.col("a")).alias("b"))


def _doubles(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values, 0 where there is none, and where there is one."""
    return pc.fill_null(column, 0.0).to_numpy(), column.is_valid().to_numpy()


def products(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    return {"sxy": x * y, "sx": x, "sy": y, "sxx": x * x, "syy": y * y}


#: Sides that a figure is made from: first item, second item.
SIDES = {"sxy": (True, True), "sx": (True, False), "sy": (False, True), "sxx": (True, False), "syy": (False, True)}


def _figures(sums: list[str], carry: list[str]) -> Callable:
    def figures(fields: pa.Table, i: np.ndarray, j: np.ndarray):
        x, known = _doubles(fields["x"])
        made = products(x[i], x[j])
        out = {"both": pa.array(np.ones(len(i), np.int64))} if "both" in sums else {}
        for c in sums:
            if c != "both":
                first, second = SIDES[c]
                out[c] = pa.array(made[c], mask=~((known[i] | (not first)) & (known[j] | (not second))))
        out |= {f"{c}_{name}": fields[c].take(pa.array(at)) for c in carry for name, at in (("i", i), ("j", j))}
        return out, None

    return figures


def pair_statistics(
    prefs: DataFrame,
    chunk_items: int = CHUNK_ITEMS,
    carry: list[str] | None = None,
    sums: list[str] | None = None,
    packed: bool = False,
) -> DataFrame | PackedSums:
    """For every item pair i < j rated by at least one common user: their count and rating sums.

    `sums` names the figures wanted, all of `SUMS` by default. `carry` names columns of `prefs` that
    depend on the item alone; they come out as <name>_i, <name>_j without a join on the pairs. `packed` hands over what is shuffled
    for the sums, to be kept or added to others.
    """
    extra, carry, sums = _extra_keys(prefs), carry or [], sums or SUMS
    owner = [*extra, "user_id"]
    met = _met(_packed(_baskets(prefs, carry), owner, chunk_items), owner)
    carried = [StructField(f"{c}_{side}", entry_type(met, c)) for c in carry for side in "ij"]
    schema = StructType([*sums_type(met, extra, sums).fields, *carried])
    found = basket_sums(met, schema, extra, _figures(sums, carry), _carried(carry))
    return found if packed else found.sums()


def pair_cooccurrence(prefs: DataFrame, chunk_items: int = CHUNK_ITEMS) -> DataFrame:
    """Number of users who rated both items, for every pair i < j that has any."""
    extra = _extra_keys(prefs)
    return pair_statistics(prefs, chunk_items, sums=["both"]).select(
        *extra, F.col("i").alias("item_id"), F.col("j").alias("other_item_id"), "both"
    )


def _item_figures(prefs: DataFrame, extra: list[str]) -> DataFrame:
    """Per (label, item): raters, sum of squared ratings, and the users of the label."""
    x = F.col("preference").cast("double")
    items = prefs.groupBy(*extra, "item_id").agg(F.count("*").alias("n"), F.sum(x * x).alias("norm"))
    if not extra:
        return items.withColumn("n_users", prefs.agg(F.countDistinct("user_id")).scalar())
    users = prefs.groupBy(*extra).agg(F.countDistinct("user_id").alias("n_users"))
    return items.join(users, extra)


def item_similarity(
    prefs: DataFrame,
    measure: str = "loglikelihood",
    digits: int | None = None,
    chunk_items: int = CHUNK_ITEMS,
) -> DataFrame:
    """Similarity of every co-rated pair, item_id < similar_item_id; undefined ones are left out.

    Figures of single items ride on the ratings, which are joined with the catalogue; the far longer
    table of pairs never is.
    """
    extra = _extra_keys(prefs)
    sums = ["both", *(c for c in SUMS if c != "both" and uses(measure, c))]
    carry = [c for c in ("n", "norm") if uses(measure, f"{c}_i")] + ["n_users"] * uses(measure, "n_users")
    if carry:
        items = _item_figures(prefs, extra).select(*extra, "item_id", *carry)
        prefs = prefs.join(items, [*extra, "item_id"])
    stats = pair_statistics(prefs, chunk_items, carry, sums)
    if "n_users" in carry:
        stats = stats.withColumnRenamed("n_users_i", "n_users")
    sims = stats.select(
        *extra,
        F.col("i").alias("item_id"),
        F.col("j").alias("similar_item_id"),
        similarity(measure).alias("similarity"),
    )
    if measure not in ALWAYS_DEFINED:
        sims = sims.where(F.col("similarity").isNotNull() & ~F.isnan("similarity"))
    if digits is not None:
        sims = sims.withColumn("similarity", rounded(F.col("similarity"), digits))
    return sims


def both_directions(sims: DataFrame) -> DataFrame:
    """Every pair seen from either of its items, in one pass over the pairs."""
    extra = _extra_keys(sims)
    i, j, s = F.col("item_id"), F.col("similar_item_id"), F.col("similarity")
    return sims.select(
        *extra,
        F.inline(
            F.array(
                F.struct(i.alias("item_id"), j.alias("similar_item_id"), s.alias("similarity")),
                F.struct(j.alias("item_id"), i.alias("similar_item_id"), s.alias("similarity")),
            )
        ),
    )


def similar_items_model(
    prefs: DataFrame, k: int = 25, measure: str = "loglikelihood", digits: int | None = None, **sizes
) -> DataFrame:
    """The trained item-based model: the k most similar items of every item, ranked."""
    sims = item_similarity(prefs, measure, digits, **sizes)
    return top_similar_items(both_directions(sims), k)
