"""Scores and top-N lists from user and item vectors.

Whole-table scoring pairs every requester with every candidate of the label that the requester has not
seen. The pairs are never written as rows: requesters are hashed into chunks and candidates into
blocks of bounded size, a task multiplies one chunk by one block, some requesters at a time, and returns each
requester's best N of the block. A vector is sent once for each block, or chunk, that it meets, so both are large where
there is enough to do for all tasks.

Candidates lie in bands by the length of their vectors. A product is at most the product of the two lengths, so
once the longest candidates gave a requester N scores, bands that cannot reach the N-th are never sent to it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer

from prefspark.functions.columns import dot, l1_norm
from prefspark.operators.topk import top_n
from prefspark.plans.session import even_tasks, materialize

BlockRescore = Callable[[np.ndarray, np.ndarray], np.ndarray]

#: Requests of a chunk: the first number, up to the second as long as every task has a cell.
CHUNK_REQUESTS, LARGE_CHUNK = 1024, 65_536
BLOCK_CANDIDATES = 32_768
#: Candidates that bounds score first, and scores that a task holds at a time.
HEAD_CANDIDATES, TILE_SCORES = 4096, 1 << 20
#: Bands for a factor of two in length, and the number of the last band; both ends are open.
BANDS_PER_OCTAVE, LAST_BAND = 4, 200


def unseen_items(users: DataFrame, prefs: DataFrame, cands: DataFrame) -> DataFrame:
    """For every asked (user_id, label): the label's items with at least one preference, minus the
    user's own. The answer is as long as the lists are, so ask for the users you need; the
    recommenders below never build it.
    """
    rated = prefs.select("item_id").distinct()
    universe = cands.select("label", "item_id").distinct().join(rated, "item_id", "left_semi")
    return (
        users.select("user_id", "label")
        .distinct()
        .join(universe, "label")
        .join(prefs.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
        .select("label", "user_id", "item_id")
    )


def score_pairs(pairs: DataFrame, user_factors: DataFrame, item_factors: DataFrame) -> DataFrame:
    """Add `value`, the product of the two vectors; a pair with an unknown side has no row."""
    users = user_factors.select(F.col("id").alias("user_id"), F.col("features").alias("_u"))
    items = item_factors.select(F.col("id").alias("item_id"), F.col("features").alias("_v"))
    return (
        pairs.join(users, "user_id")
        .join(items, "item_id")
        .withColumn("value", dot(F.col("_u"), F.col("_v")))
        .select(*pairs.columns, "value")
    )


def estimate_preference(pairs: DataFrame, user_factors: DataFrame, item_factors: DataFrame) -> DataFrame:
    """Estimated value of (user, item) pairs, as stored: 32-bit."""
    scored = score_pairs(pairs.select("user_id", "item_id"), user_factors, item_factors)
    return scored.withColumn("value", F.col("value").cast("float"))


def _best_of_block(how_many: int, digits: int | None, rescore: BlockRescore | None):
    def best(key: tuple, left: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        columns = ["label", "request_id", "item_id", "value"]
        requests = left[left["seen_item"].isna()]
        if requests.empty or block.empty:
            return pd.DataFrame(columns=columns)
        # In the order of ids, which decides between equal scores.
        block = block.sort_values("item_id")
        ids, asked = block["item_id"].to_numpy(), requests["request_id"].to_numpy()
        users = np.stack(requests["features"].to_numpy())
        vectors = np.stack([np.zeros(users.shape[1]) if v is None else v for v in block["features"]]).T
        known_row = known_col = np.zeros(0, int)
        seen = left[left["seen_item"].notna()]
        if not seen.empty:
            row = pd.Index(asked).get_indexer(seen["request_id"])
            col = pd.Index(ids).get_indexer(seen["seen_item"].astype("int64"))
            order = np.argsort(row, kind="stable")
            order = order[(row[order] >= 0) & (col[order] >= 0)]
            known_row, known_col = row[order], col[order]
        least = None
        if "least" in requests and requests["least"].notna().any():
            least = requests["least"].fillna(-np.inf).to_numpy(float)
        room = 0.0 if digits is None or rescore is not None else 10.0**-digits
        found = []
        step = max(1, TILE_SCORES // len(ids))
        for start in range(0, len(users), step):
            scores = users[start : start + step] @ vectors
            if rescore is not None:
                scores = np.array(rescore(ids[None, :], scores), float)
                if digits is not None:
                    scores = np.round(scores, digits)
            a, b = np.searchsorted(known_row, [start, start + step])
            scores[known_row[a:b] - start, known_col[a:b]] = -np.inf
            scores[np.isnan(scores)] = -np.inf
            kept = scores > -np.inf
            if how_many < len(ids):
                # All that may be among the best once they are rounded.
                last = np.partition(scores, len(ids) - how_many, axis=1)[:, len(ids) - how_many, None]
                kept &= scores >= last - room
            rows, cols = np.nonzero(kept)
            values = scores[rows, cols]
            if digits is not None:
                values = np.round(values, digits)
            # Of each request's rows the best, ties by id.
            order = np.lexsort((cols, -values, rows))
            rows, cols, values = rows[order], cols[order], values[order]
            place = np.arange(len(rows)) - np.searchsorted(rows, rows)
            best_of = place < how_many
            if least is not None:
                best_of &= values >= least[start + rows]
            found.append((start + rows[best_of], cols[best_of], values[best_of]))
        rows, cols, values = (np.concatenate(x) for x in zip(*found))
        return pd.DataFrame(
            {
                "label": key[0],
                "request_id": asked[rows],
                "item_id": ids[cols],
                "value": values,
            },
            columns=columns,
        )

    return best


def vector_length(features: Column) -> Column:
    """Euclidean length; 0 for no vector, infinite where a component is null or not a number."""
    squares = F.aggregate(features, F.lit(0.0), lambda total, x: total + x.cast("double") * x)
    length = F.coalesce(F.sqrt(squares), F.lit(float("inf")))
    return F.when(features.isNull(), 0.0).when(F.isnan(length), float("inf")).otherwise(length)


def length_band(length: Column) -> Column:
    """Number of the band: the smaller, the longer the vectors."""
    level = F.floor(-BANDS_PER_OCTAVE * F.log2(length))
    inner = F.greatest(F.lit(-LAST_BAND), F.least(F.lit(LAST_BAND), level)).cast("int")
    return F.when(length == 0, LAST_BAND).when(length == float("inf"), -LAST_BAND).otherwise(inner)


def band_profile(universe: DataFrame, head_candidates: int, block_candidates: int) -> DataFrame:
    """Per label its `bands`, an array of (band, longest, blocks) of at most 2 * LAST_BAND + 1 entries, and its `head`:
    the first band up to which there are `head_candidates`, or the last one.

    universe: (label, item_id, length, band).
    """
    each = universe.groupBy("label", "band").agg(F.count("*").alias("n"), F.max("length").alias("longest"))
    running = Window.partitionBy("label").orderBy("band")
    counted = each.withColumn("upto", F.sum("n").over(running)).withColumn(
        "blocks", F.ceil(F.col("n") / block_candidates)
    )
    return counted.groupBy("label").agg(
        F.array_sort(F.collect_list(F.struct("band", "longest", "blocks"))).alias("bands"),
        F.coalesce(
            F.min(F.when(F.col("upto") >= head_candidates, F.col("band"))), F.max("band")
        ).alias("head"),
    )


def deeper_requests(
    first: DataFrame, requests: DataFrame, profile: DataFrame, how_many: int, digits: int | None = None,
    key: Sequence[str] = ("request_id",),
) -> DataFrame:
    """Requests that need bands after the head: (request_id, label, least, lo, hi).

    first: (request_id, label, value), the best rows of the head. `least` is the N-th best score there of a request's list, which
    `key` tells from others; null if it has fewer.
    A band is needed unless the request's length times the band's longest vector stays below `least`; some room is
    left for the last bits of a sum and for rounding to `digits`.
    """
    least = (
        first.groupBy(*key)
        .agg(F.sort_array(F.collect_list("value"), asc=False).alias("best"))
        .select(*key, F.get("best", F.lit(how_many - 1)).alias("least"))
    )
    room = 0.0 if digits is None else 10.0**-digits
    reach = F.col("length") * F.col("b.longest")
    needed = F.col("least").isNull() | F.isnan(reach) | (reach * (1 + 1e-9) + room >= F.col("least"))
    asking = requests.select("request_id", "label", vector_length(F.col("features")).alias("length"))
    return (
        asking.join(profile, "label")
        .where(F.get("bands", F.size("bands") - 1)["band"] > F.col("head"))
        .join(least, list(key), "left")
        .withColumn("b", F.explode(F.filter("bands", lambda b: b["band"] > F.col("head"))))
        .where(needed)
        .groupBy("request_id", "label", "least", (F.col("head") + 1).alias("lo"))
        .agg(F.max("b.band").alias("hi"))
    )


def _cells(
    vectors: DataFrame, asked: DataFrame, seen: DataFrame, universe: DataFrame, profile: DataFrame,
    best: Callable, chunk_requests: int | None,
) -> DataFrame:
    """Best rows of every cell of a chunk of requests and a block of candidates.

    vectors: (request_id, label, features, least, lo, hi), asked: (request_id, label, lo, hi). A request meets the blocks of
    the bands lo..hi of its label; requests of equal lo and hi share chunks. Without `chunk_requests` they are as large as
    leaves every task a cell, within bounds: a number of cells that does not grow sends a vector to as many as before.
    A row of `seen` holds for all labels of its request.
    """
    counted = asked.groupBy("label", "lo", "hi").agg(F.count("*").alias("n"))
    if chunk_requests is None:
        # One row per label and bands.
        met = F.filter("bands", lambda b: b["band"].between(F.col("lo"), F.col("hi")))
        cells = F.col("n") * F.aggregate(met, F.lit(0).cast("long"), lambda total, b: total + b["blocks"])
        counted = counted.join(profile.select("label", "bands"), "label").withColumn("cells", cells)
        each = F.sum("cells").over(Window.partitionBy(F.lit(0))) / even_tasks(asked.sparkSession)
        counted = counted.withColumn("size", F.least(F.lit(LARGE_CHUNK), F.greatest(F.lit(CHUNK_REQUESTS), each)))
    else:
        counted = counted.withColumn("size", F.lit(chunk_requests))
    chunks = counted.select("label", "lo", "hi", F.ceil(F.col("n") / F.col("size")).alias("chunks"))
    chunk = F.pmod(F.xxhash64("request_id", F.lit("chunk")), F.col("chunks")).alias("chunk")
    block = F.pmod(F.xxhash64("item_id", F.lit("block")), F.col("blocks")).alias("block")
    none = F.lit(None)
    cell = ["label", "hi", "chunk", "band", "block"]
    left = [*cell, "request_id", "features", "least", "seen_item"]
    blocks_of = profile.select("label", F.explode("bands").alias("b")).select("label", "b.band", "b.blocks")
    placed = universe.join(blocks_of, ["label", "band"]).select("label", "item_id", "features", "band", block)

    askers = (
        vectors.join(chunks, ["label", "lo", "hi"])
        .withColumn("chunk", chunk)
        .join(profile.select("label", "bands"), "label")
        .withColumn("b", F.explode(F.filter("bands", lambda b: b["band"].between(F.col("lo"), F.col("hi")))))
        .withColumn("band", F.col("b.band"))
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("b.blocks") - 1)))
        .withColumn("seen_item", none.cast("long"))
        .select(*left)
    )
    # A seen item goes to the one cell of its request and its own block. Items first: what is no candidate goes no further.
    marks = (
        seen.select("request_id", "item_id")
        .join(placed.drop("features"), "item_id")
        .join(asked.join(chunks, ["label", "lo", "hi"]), ["request_id", "label"])
        .where(F.col("band").between(F.col("lo"), F.col("hi")))
        .select("label", "hi", chunk, "band", "block", "request_id", "item_id")
        .distinct()
        .select(
            *cell, "request_id", none.cast("array<double>").alias("features"),
            none.cast("double").alias("least"), F.col("item_id").alias("seen_item"),
        )
    )
    groups = chunks.groupBy("label").agg(F.collect_list(F.struct("lo", "hi", "chunks")).alias("groups"))
    blocks = (
        placed.join(groups, "label")
        .withColumn("g", F.explode(F.filter("groups", lambda g: F.col("band").between(g["lo"], g["hi"]))))
        .withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g.chunks") - 1)))
        # Own names on this side: requests and candidates may come from the same table.
        .select(
            F.col("label").alias("label"), F.col("g.hi").alias("hi"), F.col("chunk").alias("chunk"),
            F.col("band").alias("band"), F.col("block").alias("block"),
            F.col("item_id").alias("item_id"), F.col("features").alias("features"),
        )
    )
    request_type = vectors.schema["request_id"].dataType.simpleString()
    return (
        askers.unionByName(marks)
        .groupBy(*cell)
        .cogroup(blocks.groupBy(*cell))
        .applyInPandas(best, f"label string, request_id {request_type}, item_id long, value double")
    )


def _first_zeros(universe: DataFrame, seen: DataFrame, how_many: int) -> DataFrame:
    """`universe` without candidates that nobody's list can hold: those without a vector all score 0, so of a label's only
    the first ones by id count, as many as a list has places and a request has seen items."""
    most = seen.groupBy("request_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    without = universe.where(F.col("features").isNull()).withColumn("value", F.lit(0.0))
    first = top_n(without, "label", how_many + most).select(*universe.columns)
    return universe.where(F.col("features").isNotNull()).unionByName(first)


def top_unseen(
    requests: DataFrame,
    seen: DataFrame,
    item_factors: DataFrame,
    cands: DataFrame,
    how_many: int = 10,
    asked: DataFrame | None = None,
    rescore: BlockRescore | None = None,
    digits: int | None = None,
    missing_as_zero: bool = False,
    chunk_requests: int | None = None,
    block_candidates: int = BLOCK_CANDIDATES,
    bounds: bool = False,
    head_candidates: int = HEAD_CANDIDATES,
    key: Sequence[str] = ("request_id",),
) -> DataFrame:
    """Best `how_many` candidates of the request's label by vector product, seen ones left out.

    requests: (request_id, label, features); seen: (request_id, item_id). A list is told from others by `key`; with the label in it
    an id may ask for several labels, a list for each. `asked` is the requests'
    (request_id, label) where that is cheaper to get than the vectors; it may hold more. Items without a vector are
    no candidates or, with `missing_as_zero`, score 0. With `digits` scores are rounded before they are ranked, so that the order does
    not hang on the last bits of a sum. `rescore` is called inside the block with numpy arrays, the item ids
    as one row and the scores of all its requests, and returns the scores to rank by; NaN leaves a
    candidate out. A block hands over `how_many` rows per request at most, ties broken by item id.

    With `bounds` the label's longest vectors, `head_candidates` of them or some more, are scored first, and then only
    the bands of shorter ones that can still reach the request's N-th best score. The rows are the same; it pays where
    lengths differ and labels have many candidates. The first scores are written to the shared folder. A rescorer may lift
    any candidate, so with one everything is scored. `chunk_requests` and `block_candidates` are the sizes of a task's work.
    """
    asked = requests.select("request_id", "label") if asked is None else asked
    items = item_factors.select(F.col("id").alias("item_id"), "features")
    universe = (
        cands.select("label", "item_id")
        .distinct()
        .join(items, "item_id", "left" if missing_as_zero else "inner")
    )
    if missing_as_zero and rescore is None:
        universe = _first_zeros(universe, seen, how_many)
    best = _best_of_block(how_many, digits, rescore)
    if not bounds or rescore is not None:
        universe = universe.withColumns({"length": F.lit(0.0), "band": F.lit(0)})
        profile = band_profile(universe, 1, block_candidates)
        span = {"lo": F.lit(0), "hi": F.lit(0)}
        vectors = requests.select("request_id", "label", "features").withColumns({"least": F.lit(None).cast("double"), **span})
        scored = _cells(vectors, asked.withColumns(span), seen, universe, profile, best, chunk_requests)
    else:
        universe = universe.withColumn("length", vector_length(F.col("features")))
        universe = materialize(universe.withColumn("band", length_band(F.col("length"))), "candidates")
        profile = materialize(band_profile(universe, head_candidates, block_candidates), "bands")
        to_head = profile.select("label", F.lit(-LAST_BAND).alias("lo"), F.col("head").alias("hi"))
        vectors = requests.select("request_id", "label", "features", F.lit(None).cast("double").alias("least"))
        scored = _cells(
            vectors.join(to_head, "label"), asked.join(to_head, "label"), seen, universe, profile, best, chunk_requests
        )
        if not profile.where(F.get("bands", F.size("bands") - 1)["band"] > F.col("head")).isEmpty():
            first = top_n(scored, key, how_many).select("label", "request_id", "item_id", "value")
            first = materialize(first, "head-scores")
            deeper = materialize(deeper_requests(first, requests, profile, how_many, digits, key), "deeper")
            vectors = requests.select("request_id", "label", "features").join(deeper, ["request_id", "label"])
            rest = _cells(vectors, deeper.drop("least"), seen, universe, profile, best, chunk_requests)
            scored = first.unionByName(rest)
    return top_n(scored, key, how_many).select(
        "label", "request_id", "rank", "item_id", "value"
    )


def recommend_mf(
    users: DataFrame,
    prefs: DataFrame,
    user_factors: DataFrame,
    item_factors: DataFrame,
    cands: DataFrame,
    how_many: int = 10,
    seen: DataFrame | None = None,
    **options,
) -> DataFrame:
    """Top items per (user, label) by the user's stored vector.

    users: (user_id, label). Left out are the user's own items or, if `seen` (user_id, item_id) is
    given, those instead. The universe is the label's items with a preference and a vector; a user
    without a vector gets no rows.
    """
    asked = users.select("user_id", "label").distinct()
    rated = prefs.select("item_id").distinct()
    universe = cands.join(rated, "item_id", "left_semi")
    vectors = user_factors.select(F.col("id").alias("user_id"), "features")
    requests = asked.join(vectors, "user_id").withColumnRenamed("user_id", "request_id")
    history = (prefs if seen is None else seen).select(F.col("user_id").alias("request_id"), "item_id")
    known = requests.select("request_id", "label")
    # A user's request for one label is a list of its own.
    top = top_unseen(
        requests, history, item_factors, universe, how_many, known, key=["request_id", "label"], **options
    )
    return top.select("label", F.col("request_id").cast("long").alias("user_id"), "rank", "item_id", "value")


def _known(item_sets: DataFrame, item_factors: DataFrame) -> DataFrame:
    """(request_id, item_id), each once, of the items that have a row in `item_factors`."""
    ids = item_factors.select(F.col("id").alias("item_id")).distinct()
    return item_sets.select("request_id", "item_id").join(ids, "item_id", "left_semi").distinct()


def fold_in_anonymous(item_sets: DataFrame, item_factors: DataFrame) -> DataFrame:
    """Vector of an unknown user: sum of the given items' vectors over its L1 norm.

    `item_sets` is long: (request_id, item_id). Unknown items are skipped; a request with none known
    has no row. Vectors are summed inside each task before the shuffle.
    """
    given = _known(item_sets, item_factors)
    items = item_factors.select(F.col("id").alias("item_id"), array_to_vector("features").alias("v"))
    summed = (
        given.join(items, "item_id")
        .groupBy("request_id")
        .agg(vector_to_array(Summarizer.sum(F.col("v"))).alias("s"))
    )
    norm = l1_norm(F.col("s"))
    return summed.withColumn("norm", norm).select(
        "request_id", F.transform("s", lambda x: F.try_divide(x, F.col("norm"))).alias("features")
    )


def shared_lists(requests: DataFrame, key: Sequence[str]) -> DataFrame:
    """(request_id, list_id, key), written: requests of equal keys have the same answer, worked out once for the least id of them."""
    ids = requests.groupBy(*key).agg(F.min("request_id").alias("list_id"))
    same = F.lit(True)
    for c in key:
        same = same & F.col(f"r.{c}").eqNullSafe(F.col(f"l.{c}"))
    members = requests.alias("r").join(ids.alias("l"), same).select("r.request_id", "l.list_id", *(f"r.{c}" for c in key))
    return materialize(members.distinct(), "shared-lists")


def handed_out(answers: DataFrame, members: DataFrame) -> DataFrame:
    """The answers of lists, (request_id, ..), for all requests that share them. A list travels as one row."""
    columns = [c for c in answers.columns if c != "request_id"]
    lists = answers.groupBy(F.col("request_id").alias("list_id")).agg(F.collect_list(F.struct(*columns)).alias("rows"))
    return members.select("request_id", "list_id").join(lists, "list_id").select("request_id", F.inline("rows")).select(*answers.columns)


def recommend_anonymous_mf(
    item_sets: DataFrame,
    item_factors: DataFrame,
    prefs: DataFrame,
    cands: DataFrame,
    how_many: int = 10,
    share: bool = False,
    **options,
) -> DataFrame:
    """Top items for given item lists (request_id, label, item_id) through the folded-in vector.

    Only given items with a vector tell: they make the request's vector, and others are no candidates. With `share` requests of the
    same known items and labels share one list; it pays where lists are short. Items without a vector score 0
    with `missing_as_zero`, so there requests stay alone.
    """
    universe = cands.join(prefs.select("item_id").distinct(), "item_id", "left_semi")
    if not share or options.get("missing_as_zero"):
        return _anonymous(item_sets, item_sets, item_factors, universe, how_many, options)
    ids = item_factors.select(F.col("id").alias("item_id"), F.lit(True).alias("known")).distinct()
    given = item_sets.where(F.col("request_id").isNotNull()).select("request_id", "label", "item_id").join(ids, "item_id", "left")
    asked = given.groupBy("request_id").agg(
        F.array_sort(F.collect_set("label")).alias("labels"), F.array_sort(F.collect_set(F.when(F.col("known"), F.col("item_id")))).alias("items")
    )
    members = shared_lists(asked.where((F.size("items") > 0) & (F.size("labels") > 0)), ["labels", "items"])
    lists = members.where("request_id = list_id")
    known = lists.select("request_id", F.explode("items").alias("item_id"))
    labels = lists.select("request_id", F.explode("labels").alias("label"))
    top = _anonymous(known, labels, item_factors, universe, how_many, options)
    return handed_out(top, members)


def _anonymous(given: DataFrame, asked: DataFrame, item_factors: DataFrame, universe: DataFrame, how_many: int, options: dict) -> DataFrame:
    """given: (request_id, item_id); asked: (request_id, label)."""
    labels = asked.select("request_id", "label").distinct()
    vectors = fold_in_anonymous(given, item_factors).where(
        ~F.exists("features", lambda x: x.isNull())
    )
    return top_unseen(
        vectors.join(labels, "request_id"), given, item_factors, universe, how_many, labels, **options
    )


def gram_matrix(item_factors: DataFrame) -> np.ndarray:
    """Sum of v v^T over all items: K*K numbers whatever the number of items."""

    def partial(batches):
        total = None
        for batch in batches:
            if len(batch):
                v = np.stack(batch["features"].to_numpy())
                total = v.T @ v if total is None else total + v.T @ v
        if total is not None:
            yield pd.DataFrame(
                {"r": np.repeat(np.arange(len(total)), len(total)),
                 "c": np.tile(np.arange(len(total)), len(total)), "x": total.ravel()}
            )

    sums = (
        item_factors.select("features")
        .mapInPandas(partial, "r int, c int, x double")
        .groupBy("r", "c")
        .agg(F.sum("x").alias("x"))
        .toPandas()
    )
    k = 0 if sums.empty else int(sums["r"].max()) + 1
    matrix = np.zeros((k, k))
    matrix[sums["r"], sums["c"]] = sums["x"]
    return matrix


def fold_in_least_squares(item_sets: DataFrame, item_factors: DataFrame) -> DataFrame:
    """User vector as the sum of the given items' rows of Y (Y^T Y)^-1."""
    given = _known(item_sets, item_factors)
    items = item_factors.select(F.col("id").alias("item_id"), array_to_vector("features").alias("v"))
    summed = (
        given.join(items, "item_id")
        .groupBy("request_id")
        .agg(vector_to_array(Summarizer.sum(F.col("v"))).alias("s"))
    )
    gram = gram_matrix(item_factors)
    if not len(gram):
        return summed.select("request_id", F.col("s").alias("features"))

    # Summing rows of Y and multiplying once equals summing rows of Y (Y^T Y)^-1.
    inverse = np.linalg.pinv(gram)

    def multiply(batches):
        for batch in batches:
            if len(batch):
                product = np.stack(batch["s"].to_numpy()) @ inverse
                yield pd.DataFrame({"request_id": batch["request_id"], "features": list(product)})

    request_type = item_sets.schema["request_id"].dataType.simpleString()
    return summed.mapInPandas(multiply, f"request_id {request_type}, features array<double>")
