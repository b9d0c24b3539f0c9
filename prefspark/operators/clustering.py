"""Clusters of items by the users who rated them, Manhattan distance.

Item vectors are binary and stay in long form (item_id, dim, value) with dim = user id: no row holds
a whole vector, so an item rated by a third of all users is just many rows.

Fitting is one streaming pass per partition (facility opening with a growing cost, after Shindler,
Wong and Meyerson 2011) over fixed-size sketches of the vectors, a tree of merges over the weighted
centroids the partitions return, and then exact rounds over the vectors themselves.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from prefspark.functions.columns import rounded
from prefspark.operators.preferences import heavy_users
from prefspark.plans.session import materialize

SKETCH_DIMS = 256
FAN_IN = 64
GROWTH = 1.5
BATCH = 256


# -- vectors -----------------------------------------------------------------------


def item_user_vectors(
    prefs: DataFrame, min_ratings: int, cands: DataFrame | None = None, label: str | None = None
) -> DataFrame:
    """Items seen by at least one heavy user, one row per heavy user who rated them."""
    if cands is not None:
        wanted = cands.where(F.col("label") == label).select("item_id").distinct()
        prefs = prefs.join(wanted, "item_id", "left_semi")
    return new_item_vectors(prefs, heavy_users(prefs, min_ratings))


def new_item_vectors(
    prefs: DataFrame, users: DataFrame, known_items: DataFrame | None = None
) -> DataFrame:
    """Vectors in the space of the given users, of items not clustered yet."""
    rows = prefs.join(users.select("user_id").distinct(), "user_id", "left_semi")
    if known_items is not None:
        rows = rows.join(known_items.select("item_id").distinct(), "item_id", "left_anti")
    return (
        rows.select("item_id", F.col("user_id").alias("dim")).distinct().withColumn("value", F.lit(1.0))
    )


# -- fitting -----------------------------------------------------------------------


class _Centroids:
    """A bounded number of weighted centroids over a stream of weighted points."""

    def __init__(self, k: int, cutoff: float, dims: int):
        self.k, self.cutoff = k, cutoff
        self.vectors, self.weights = np.empty((2 * k, dims)), np.empty(2 * k)
        self.n = self.seen = 0

    def limit(self) -> int:
        return max(self.k, self.k * math.ceil(math.log2(self.seen + 1)))

    def extend(self, points: np.ndarray, weights: np.ndarray, draws: np.ndarray) -> None:
        """Absorb at once what is near by, and open or place the rest one after the other."""
        self.seen += len(points)
        left = np.arange(len(points))
        if self.n:
            near, distance = self._nearest(points)
            absorbed = draws >= np.minimum(1.0, weights * distance / self.cutoff)
            self._absorb(near[absorbed], points[absorbed], weights[absorbed])
            left = left[~absorbed]
        for at in left:
            self._place(points[at], weights[at], draws[at])
            while self.n > self.limit():
                self.cutoff *= GROWTH
                vectors, held = self.vectors[: self.n].copy(), self.weights[: self.n].copy()
                self.n = 0
                for nth, (v, w) in enumerate(zip(vectors, held)):
                    self._place(v, w, (draws[at] + nth * 0.6180339887498949) % 1.0)

    def _nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        distance = _manhattan(points, self.vectors[: self.n])
        near = distance.argmin(axis=1)
        return near, distance[np.arange(len(points)), near]

    def _absorb(self, near: np.ndarray, points: np.ndarray, weights: np.ndarray) -> None:
        added = np.bincount(near, weights, self.n)
        moved = np.zeros((self.n, points.shape[1]))
        np.add.at(moved, near, points * weights[:, None])
        total = self.weights[: self.n] + added
        self.vectors[: self.n] = (self.vectors[: self.n] * self.weights[: self.n, None] + moved) / total[:, None]
        self.weights[: self.n] = total

    def _place(self, x: np.ndarray, weight: float, draw: float) -> None:
        if self.n:
            distance = np.abs(self.vectors[: self.n] - x).sum(axis=1)
            near = int(distance.argmin())
            if draw >= min(1.0, weight * distance[near] / self.cutoff):
                total = self.weights[near] + weight
                self.vectors[near] += (x - self.vectors[near]) * (weight / total)
                self.weights[near] = total
                return
        if self.n == len(self.weights):
            self.vectors = np.concatenate([self.vectors, np.empty_like(self.vectors)])
            self.weights = np.concatenate([self.weights, np.empty_like(self.weights)])
        self.vectors[self.n], self.weights[self.n] = x, weight
        self.n += 1


def _manhattan(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.stack([np.abs(points - c).sum(axis=1) for c in centers], axis=1)


def _dense(rows: pd.DataFrame, dims: int) -> np.ndarray:
    """Sketches as rows of a matrix."""
    out = np.zeros((len(rows), dims))
    at = np.repeat(np.arange(len(rows)), rows["slots"].map(len))
    out[at, np.concatenate(rows["slots"].to_numpy())] = np.concatenate(rows["sums"].to_numpy())
    return out


def _sketch_pass(k: int, cutoff: float, dims: int):
    """Over sketches, or over centroids, which are written in full."""
    def run(batches):
        found = _Centroids(k, cutoff, dims)
        for batch in batches:
            for start in range(0, len(batch), BATCH):
                some = batch.iloc[start : start + BATCH]
                found.extend(np.stack(some["v"].to_numpy()) if "v" in some else _dense(some, dims), some["weight"].to_numpy(), some["draw"].to_numpy())
        if found.n:
            yield pd.DataFrame({"v": list(found.vectors[: found.n]), "weight": found.weights[: found.n]})

    return run


def _ball(points: np.ndarray, weights: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """k centers of a small weighted set: the heaviest point, then ever the one that weighs most by its
    distance to those before; a few rounds of weighted means."""
    chosen = [int(weights.argmax())]
    distance = np.abs(points - points[chosen[0]]).sum(axis=1)
    while len(chosen) < min(k, len(points)) and (distance > 0).any():
        chosen.append(int((weights * distance).argmax()))
        distance = np.minimum(distance, np.abs(points - points[chosen[-1]]).sum(axis=1))
    centers = points[chosen]
    for _ in range(rounds):
        near = _manhattan(points, centers).argmin(axis=1)
        mass = np.bincount(near, weights, len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, near, points * weights[:, None])
        centers = np.where(mass[:, None] > 0, sums / np.maximum(mass, 1e-12)[:, None], centers)
    return centers


def _draw(seed: int, *columns: str):
    """A number in [0, 1) that depends on the row alone, so a repeated task opens the same facilities."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1_000_003)) / 1_000_003


def sketch_vectors(vectors: DataFrame, dims: int = SKETCH_DIMS) -> DataFrame:
    """(item_id, slots, sums): the vector with its dimensions hashed into `dims` sums, and the numbers of those that have one."""
    hashed = vectors.groupBy("item_id", F.pmod(F.xxhash64("dim"), F.lit(dims)).cast("int").alias("b")).agg(
        F.coalesce(F.sum("value"), F.lit(0.0)).alias("x")
    )
    cells = hashed.groupBy("item_id").agg(F.collect_list(F.struct("b", "x")).alias("cells"))
    return cells.select("item_id", F.col("cells.b").alias("slots"), F.col("cells.x").alias("sums"))


def fit_streaming_kmeans(
    vectors: DataFrame,
    k: int = 20,
    cutoff: float = 10.0,
    seed: int = 42,
    sketch_dims: int = SKETCH_DIMS,
    rows_per_part: int = 10_000,
    rounds: int = 2,
) -> tuple[DataFrame, DataFrame]:
    """(centroids, assignment): at most k weighted centroids, and each item's nearest one.

    The streaming pass starts with `cutoff` as the cost of opening a centroid, over parts of about
    `rows_per_part` items, so the model is a function of the vectors and these arguments. It works on
    sketches: dimensions are hashed into `sketch_dims` sums, which only choose where the exact rounds
    start. Each of these takes every item to its nearest centroid in the full space and the means anew;
    at the end every item is at its nearest centroid, and a centroid's weight is the number of items
    whose mean it is.
    """
    sketches = materialize(sketch_vectors(vectors, sketch_dims), "sketches")
    parts = max(1, math.ceil(sketches.count() / rows_per_part))
    # Placed and ordered by hash: the same input gives the same centroids.
    points = (
        sketches.select("slots", "sums", F.lit(1.0).alias("weight"), _draw(seed, "item_id").alias("draw"), "item_id")
        .repartition(parts, "item_id")
        .sortWithinPartitions(F.xxhash64("item_id"), "item_id")
    )
    schema = "v array<double>, weight double"
    found = materialize(points.mapInPandas(_sketch_pass(k, cutoff, sketch_dims), schema), "sketch-centroids")
    while parts > 1:
        parts = math.ceil(parts / FAN_IN)
        keyed = found.withColumn("h", F.xxhash64("v", "weight"))
        merged = keyed.withColumn("draw", _draw(seed, "h")).repartition(parts, "h")
        merged = merged.sortWithinPartitions(F.desc("weight"), "h")
        found = materialize(merged.mapInPandas(_sketch_pass(k, cutoff, sketch_dims), schema), "sketch-centroids")
    # At most k * log2(items) rows of fixed width.
    rows = sorted(found.collect(), key=lambda r: (-r.weight, r.v))
    if rows:
        centers = _ball(np.array([r.v for r in rows]), np.array([r.weight for r in rows]), k)
    else:
        centers = np.zeros((1, sketch_dims))

    def assign(batches):
        for batch in batches:
            if len(batch):
                distance = _manhattan(_dense(batch, sketch_dims), centers)
                yield pd.DataFrame({"item_id": batch["item_id"], "centroid_id": distance.argmin(axis=1)})

    assignment = sketches.mapInPandas(assign, "item_id long, centroid_id long")
    centroids = materialize(centroids_of(vectors, assignment), "centroids")
    for _ in range(rounds):
        assignment = materialize(nearest_centroid(vectors, centroids).drop("distance"), "assignment")
        centroids = materialize(centroids_of(vectors, assignment), "centroids")
    return centroids, nearest_centroid(vectors, centroids).drop("distance")


def centroids_of(vectors: DataFrame, assignment: DataFrame) -> DataFrame:
    """Mean vector and number of items of every cluster: (centroid_id, weight, dim, value)."""
    weights = assignment.groupBy("centroid_id").agg(F.count("*").cast("double").alias("weight"))
    sums = (
        vectors.join(assignment, "item_id")
        .groupBy("centroid_id", "dim")
        .agg(F.sum("value").alias("total"))
    )
    return sums.join(weights, "centroid_id").select(
        "centroid_id", "weight", "dim", (F.col("total") / F.col("weight")).alias("value")
    )


def merge_into_centroids(centroids: DataFrame, vectors: DataFrame, assignment: DataFrame) -> DataFrame:
    """Fold new items into the centroids they are assigned to; unknown centroid ids become new ones."""
    added = centroids_of(vectors, assignment)
    mass = F.col("weight") * F.col("value")
    both = centroids.select("centroid_id", "dim", mass.alias("total")).unionByName(
        added.select("centroid_id", "dim", mass.alias("total"))
    )
    weights = (
        centroids.select("centroid_id", "weight")
        .distinct()
        .unionByName(added.select("centroid_id", "weight").distinct())
        .groupBy("centroid_id")
        .agg(F.sum("weight").alias("weight"))
    )
    return (
        both.groupBy("centroid_id", "dim")
        .agg(F.sum("total").alias("total"))
        .join(weights, "centroid_id")
        .select("centroid_id", "weight", "dim", (F.col("total") / F.col("weight")).alias("value"))
    )


def move_between_centroids(
    centroids: DataFrame, old: DataFrame, left: DataFrame, new: DataFrame, joined: DataFrame
) -> DataFrame:
    """Means after some items changed: their `old` vectors leave the centroids of `left`, their `new` ones go to those of `joined`.

    Vectors are (item_id, dim, value), `left` and `joined` (item_id, centroid_id); an item without an entry in `left` is new.
    Only sums by (centroid, dim) of the changed items are added, with their sign. Centroids that no item is left in go.
    """
    def sums(vectors: DataFrame, of: DataFrame, sign: int) -> DataFrame:
        return vectors.join(of, "item_id").select("centroid_id", "dim", (F.lit(float(sign)) * F.col("value")).alias("total"))

    def counts(of: DataFrame, sign: int) -> DataFrame:
        return of.select("centroid_id", F.lit(float(sign)).alias("weight"))

    held = centroids.select("centroid_id", "dim", (F.col("weight") * F.col("value")).alias("total"))
    totals = held.unionByName(sums(old, left, -1)).unionByName(sums(new, joined, 1)).groupBy("centroid_id", "dim").agg(F.sum("total").alias("total"))
    weights = (
        centroids.select("centroid_id", "weight").distinct().unionByName(counts(left, -1)).unionByName(counts(joined, 1))
        .groupBy("centroid_id").agg(F.sum("weight").alias("weight")).where(F.col("weight") > 0)
    )
    # Vectors are binary, so totals are whole numbers; a product of mean and weight is one but for its last bits.
    whole = totals.withColumn("total", F.round("total", 6)).where(F.col("total") != 0)
    return whole.join(weights, "centroid_id").select("centroid_id", "weight", "dim", (F.col("total") / F.col("weight")).alias("value"))


# -- use ----------------------------------------------------------------------------


def cluster_stats(centroids: DataFrame, digits: int | None = None) -> DataFrame:
    """Size figures of every centroid, with the largest weight and the mean volume of this model."""
    each = centroids.groupBy("centroid_id").agg(
        F.max("weight").alias("weight"),
        F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("l2_norm"),
        F.count_if(F.col("value") != 0).alias("non_zero"),
    )
    volumes = each.withColumn("max_weight", each.agg(F.max("weight")).scalar()).withColumn(
        "norm_weight", F.col("weight") / F.col("max_weight")
    )
    volumes = volumes.withColumn("volume", F.col("norm_weight") * F.col("non_zero"))
    out = volumes.withColumn("mean_volume", volumes.agg(F.avg("volume")).scalar())
    if digits is not None:
        out = out.withColumns(
            {c: rounded(F.col(c), digits) for c in ("weight", "l2_norm", "max_weight", "norm_weight", "volume", "mean_volume")}
        )
    return out


def nearest_centroid(vectors: DataFrame, centroids: DataFrame, digits: int = 9, at_once: int = 64) -> DataFrame:
    """(item_id, centroid_id, distance): closest centroid, ties by id.

    |x - c| = |x| + |c| + sum over the dims of x of (|x_d - c_d| - |x_d| - |c_d|). Centroids are pivoted to one
    row per dim with the values of `at_once` of them, so a vector's entry meets one row, and the sums of all
    centroids are columns of one aggregation inside the task. The driver gets an id and a norm per centroid.
    """
    norms = centroids.groupBy("centroid_id").agg(F.sum(F.abs("value")).alias("norm")).orderBy("centroid_id").collect()
    nearest = None
    for start in range(0, len(norms), at_once):
        some = norms[start : start + at_once]
        number = F.create_map(*(F.lit(x) for i, r in enumerate(some) for x in (r.centroid_id, i)))
        held = centroids.where(F.col("centroid_id").between(some[0].centroid_id, some[-1].centroid_id))
        by_dim = held.groupBy("dim").agg(F.map_from_entries(F.collect_list(F.struct(number[F.col("centroid_id")].alias("n"), "value"))).alias("of"))
        values = F.transform(F.sequence(F.lit(0), F.lit(len(some) - 1)), lambda n: F.coalesce(F.col("of")[n], F.lit(0.0)))
        met = vectors.join(by_dim.select("dim", values.alias("c")), "dim", "left")
        x = F.abs("value")
        gains = []
        for n in range(len(some)):
            c = F.coalesce(F.col("c")[n], F.lit(0.0))
            gains.append(F.sum(F.abs(F.col("value") - c) - x - F.abs(c)).alias(f"g{n}"))
        summed = met.groupBy("item_id").agg(F.sum(x).alias("length"), *gains)
        distances = [
            F.struct(rounded(F.col("length") + F.lit(r.norm) + F.col(f"g{n}"), digits).alias("distance"), F.lit(r.centroid_id).alias("centroid_id"))
            for n, r in enumerate(some)
        ]
        found = summed.select("item_id", F.array_min(F.array(*distances)).alias("n"))
        nearest = found if nearest is None else nearest.unionByName(found)
    if nearest is None:
        return vectors.where("false").select("item_id", F.lit(0).cast("long").alias("centroid_id"), F.lit(0.0).alias("distance"))
    if len(norms) > at_once:
        nearest = nearest.groupBy("item_id").agg(F.min("n").alias("n"))
    return nearest.select("item_id", "n.centroid_id", "n.distance")


def recommend_cluster_weight(
    items: DataFrame, vectors: DataFrame, centroids: DataFrame, digits: int | None = None
) -> DataFrame:
    """For every given item the weight of its centroid over the largest; unknown items have no row."""
    asked = items.select("item_id").distinct()
    known = vectors.join(asked, "item_id", "left_semi")
    weights = cluster_stats(centroids).select("centroid_id", "norm_weight")
    value = F.col("norm_weight")
    if digits is not None:
        value = rounded(value, digits)
    return (
        items.join(nearest_centroid(known, centroids), "item_id")
        .join(weights, "centroid_id")
        .select(*items.columns, value.alias("value"))
    )
