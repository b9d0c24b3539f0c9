"""Matrix factorisation with Spark's ALS."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame, Window, functions as F

from prefspark.operators.preferences import num_items, num_users, preferences_for_label
from prefspark.plans.session import materialize, scratch_path
from prefspark.schemas import FACTORS

# A label is trained with at least this many items and users.
MIN_ITEMS = 5
MIN_USERS = 10

INDEX_BUCKETS = 65_536


def dense_index(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Number the distinct keys 0..n-1 without a global sort.

    Keys are hashed into buckets; a bucket's start is the running sum of at most 65,536 counts, and
    keys are numbered inside their bucket.
    """
    keys = df.select(*columns).distinct().withColumn(
        "_bucket", F.pmod(F.xxhash64(*columns), F.lit(INDEX_BUCKETS))
    )
    running = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        keys.groupBy("_bucket")
        .agg(F.count("*").alias("_n"))
        .select("_bucket", F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy("_bucket").orderBy(*columns)
    return keys.join(starts, "_bucket").select(
        *columns, (F.col("_start") + F.row_number().over(inside) - 1).cast("int").alias(name)
    )


def fit_numbered(ratings: DataFrame, rank, reg, iters, implicit, alpha, seed, blocks):
    """ALS on (user_idx, item_idx, preference)."""
    parallel = ratings.sparkSession.sparkContext.defaultParallelism
    als = ALS(
        userCol="user_idx",
        itemCol="item_idx",
        ratingCol="preference",
        rank=rank,
        regParam=reg,
        maxIter=iters,
        implicitPrefs=implicit,
        alpha=alpha,
        nonnegative=False,
        coldStartStrategy="drop",
        seed=seed,
        numUserBlocks=blocks or min(parallel, 1000),
        numItemBlocks=blocks or min(parallel, 1000),
    )
    return als.fit(ratings.select("user_idx", "item_idx", "preference"))


def indexes(prefs: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Numbers of the users and items, written: read for a fit and again for the names of its vectors."""
    return (
        materialize(dense_index(prefs, [*keys, "user_id"], "user_idx"), "user-index"),
        materialize(dense_index(prefs, [*keys, "item_id"], "item_idx"), "item-index"),
    )


def number_ratings(prefs: DataFrame, keys: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Numbers of the users and items, and the ratings by them, written: the solver reads its input twice, and fits of one table
    may share it."""
    keys = list(keys)
    users, items = indexes(prefs, keys)
    ratings = prefs.join(users, [*keys, "user_id"]).join(items, [*keys, "item_id"])
    return users, items, materialize(ratings.select("user_idx", "item_idx", "preference"), "ratings")


def _train(prefs, rank, reg, iters, implicit, alpha, seed, blocks, keys=(), numbered=None):
    """(user factors, item factors); `keys` are carried columns that keep blocks of ids apart."""
    keys = list(keys)
    users, items, ratings = numbered or number_ratings(prefs, keys)
    model = fit_numbered(ratings, rank, reg, iters, implicit, alpha, seed, blocks)

    def named(factors, index, idx, column):
        vectors = factors.select(F.col("id").alias(idx), F.col("features").cast("array<double>"))
        return vectors.join(index, idx).select(*keys, F.col(column).alias("id"), "features")

    return (
        named(model.userFactors, users, "user_idx", "user_id"),
        named(model.itemFactors, items, "item_idx", "item_id"),
    )


def train_als_explicit(
    prefs: DataFrame,
    rank: int = 10,
    reg: float = 0.01,
    iters: int = 10,
    seed: int = 42,
    blocks: int | None = None,
    numbered: tuple[DataFrame, DataFrame, DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Weighted-lambda ALS on ratings: user and item vectors (id, features). `numbered` is `number_ratings(prefs)`, for several fits."""
    return _train(prefs, rank, reg, iters, False, 1.0, seed, blocks, numbered=numbered)


def train_als_implicit(
    prefs: DataFrame,
    rank: int = 10,
    reg: float = 0.01,
    iters: int = 10,
    alpha: float = 40.0,
    seed: int = 42,
    blocks: int | None = None,
    numbered: tuple[DataFrame, DataFrame, DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """ALS on confidences 1 + alpha * value."""
    return _train(prefs, rank, reg, iters, True, alpha, seed, blocks, numbered=numbered)


def empty_factors(spark) -> tuple[DataFrame, DataFrame]:
    """What a recommender answers from until it is trained."""
    return spark.createDataFrame([], FACTORS), spark.createDataFrame([], FACTORS)


def training_gate(prefs: DataFrame, cands: DataFrame) -> DataFrame:
    """Labels with enough data to train, with their counts."""
    return _enough(num_items(prefs, cands), num_users(prefs, cands))


def gate_of(view: DataFrame) -> DataFrame:
    """The same from a training view (label, user_id, item_id, ..) of all labels."""
    counts = (view.groupBy("label").agg(F.countDistinct(f"{side}_id").alias(f"num_{side}s")) for side in ("item", "user"))
    return _enough(*counts)


def _enough(items: DataFrame, users: DataFrame) -> DataFrame:
    return items.join(users, "label").where((F.col("num_items") >= MIN_ITEMS) & (F.col("num_users") >= MIN_USERS))


def train_all_labels(
    prefs: DataFrame,
    cands: DataFrame,
    rank: int = 10,
    reg: float = 0.01,
    iters: int = 10,
    implicit: bool = True,
    alpha: float = 40.0,
    seed: int = 42,
    blocks: int | None = None,
    parallelism: int = 2,
) -> tuple[DataFrame, DataFrame]:
    """One model per label that passes the gate: vectors with a `label` column.

    Explicit models of different labels share no unknowns once (label, user) and (label, item) are
    the ids, so all of them are one fit, up to the solver's 2^31 distinct ids; beyond that fit groups of
    labels. Implicit models meet in the sum over all items, so they are fitted label by label, `parallelism`
    at a time, on a view that is written once by label; each fit is distributed and its vectors are written.
    """
    # Written once: the gate, the numbering and the fit all read it, and would each join and shuffle the log anew.
    rated = materialize(preferences_for_label(prefs, cands), "label-ratings")
    gated = materialize(gate_of(rated).select("label"), "gated-labels")
    view = rated.join(gated, "label", "left_semi")
    if not implicit:
        return _train(view, rank, reg, iters, False, 1.0, seed, blocks, keys=["label"])
    spark = prefs.sparkSession
    path = scratch_path(spark, "label-view")
    view.write.partitionBy("label").parquet(path)
    stored = spark.read.schema(view.schema).parquet(path)

    def fit(label: str) -> list[str]:
        found = train_als_implicit(stored.where(F.col("label") == label), rank, reg, iters, alpha, seed, blocks)
        paths = [scratch_path(spark, f"label-{side}") for side in ("users", "items")]
        for vectors, at in zip(found, paths):
            vectors.select(F.lit(label).alias("label"), "id", "features").write.parquet(at)
        return paths

    labels = [row.label for row in gated.orderBy("label").toLocalIterator()]
    with ThreadPoolExecutor(parallelism) as pool:
        written = list(pool.map(inheritable_thread_target(spark)(fit), labels))
    if not written:
        users, items = (d.withColumn("label", F.lit(None).cast("string")) for d in empty_factors(spark))
        return users, items
    return tuple(spark.read.parquet(*side) for side in zip(*written))
