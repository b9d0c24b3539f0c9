"""One entry point for recommendation requests of every kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from prefspark.operators.clustering import recommend_cluster_weight
from prefspark.operators.itembased import recommend_items_for_items, recommend_itembased
from prefspark.operators.scoring import handed_out, recommend_anonymous_mf, recommend_mf, shared_lists
from prefspark.operators.topics import recommend_topics
from prefspark.plans.session import materialize
from prefspark.schemas import DEFAULT_HOW_MANY

KINDS = ("itembased", "factorization", "lda", "clusters")
RESULT = ["request_id", "rank", "item_id", "value", "error"]


def route(requests: DataFrame) -> DataFrame:
    """Add `path` (user, user_items, items, error) and fill in `how_many`.

    requests: (request_id, user_id, item_ids, label, how_many), where user_id, item_ids and how_many
    may be null. A list that holds only the id 0 counts as not given.
    """
    listed = F.col("item_ids").isNotNull() & (F.size("item_ids") > 0)
    placeholder = F.col("item_ids") == F.array(F.lit(0).cast("long"))
    items = listed & ~(placeholder & F.col("user_id").isNotNull())
    user = F.col("user_id").isNotNull()
    return requests.withColumns(
        {
            "path": F.when(user & items, "user_items")
            .when(user, "user")
            .when(items, "items")
            .otherwise("error"),
            "how_many": F.coalesce("how_many", F.lit(DEFAULT_HOW_MANY)),
        }
    )


def _item_rows(requests: DataFrame) -> DataFrame:
    return requests.select(
        "request_id", "label", F.posexplode("item_ids").alias("position", "item_id")
    )


def _failed(requests: DataFrame, reason: str) -> DataFrame:
    return requests.select(
        "request_id",
        F.lit(None).cast("int").alias("rank"),
        F.lit(None).cast("long").alias("item_id"),
        F.lit(None).cast("double").alias("value"),
        F.lit(reason).alias("error"),
    )


def recommend(
    kind: str,
    requests: DataFrame,
    cands: DataFrame,
    prefs: DataFrame | None = None,
    sims: DataFrame | None = None,
    user_factors: DataFrame | None = None,
    item_factors: DataFrame | None = None,
    topics: DataFrame | None = None,
    vectors: DataFrame | None = None,
    centroids: DataFrame | None = None,
    max_how_many: int | None = None,
    **options,
) -> DataFrame:
    """Answer a table of requests: (request_id, rank, item_id, value, error).

    `max_how_many` is the largest list any request asks for; it is read from the requests when not
    given. A request with neither a user nor items yields one row with `error` set, and so does a request
    for clusters none of whose items has a vector.
    """
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}, not {kind!r}")
    # Read by every path below: worked out once.
    routed = materialize(route(requests), "requests")
    n = max_how_many or routed.agg(F.max("how_many")).first()[0] or DEFAULT_HOW_MANY
    by_user = routed.where(F.col("path").isin("user", "user_items"))
    by_items = routed.where(F.col("path") == "items")
    if kind in ("lda", "clusters"):
        # These two know items only.
        by_items = routed.where(F.col("path").isin("items", "user_items"))
    answered = by_items if kind in ("lda", "clusters") else by_user.unionByName(by_items)
    errors = _failed(
        routed.join(answered.select("request_id"), "request_id", "left_anti"), "user_id or item_ids must be supplied"
    )
    answers = {
        "itembased": lambda: _itembased(by_user, by_items, prefs, sims, cands, n, options),
        "factorization": lambda: _factorization(
            by_user, by_items, prefs, user_factors, item_factors, cands, n, options
        ),
        "lda": lambda: recommend_topics(_item_rows(by_items), topics, cands, n, **options),
        "clusters": lambda: _clusters(by_items, vectors, centroids),
    }[kind]()
    answers = answers.select("request_id", "rank", "item_id", "value")
    if kind == "clusters":
        known = _item_rows(by_items).join(vectors.select("item_id").distinct(), "item_id", "left_semi")
        unknown = by_items.join(known.select("request_id").distinct(), "request_id", "left_anti")
        errors = errors.unionByName(_failed(unknown, "no item is known"))
    if kind != "clusters":
        limits = routed.select("request_id", "how_many")
        answers = answers.join(limits, "request_id").where(F.col("rank") <= F.col("how_many"))
    return answers.withColumn("error", F.lit(None).cast("string")).select(*RESULT).unionByName(errors)


def _itembased(by_user, by_items, prefs, sims, cands, n, options):
    """User requests become users of their own, so that label and given items stay per request."""
    history = by_user.select("request_id", "user_id", "label").join(
        prefs.select("user_id", "item_id", "preference"), "user_id"
    )
    own = history.select("label", F.col("request_id").alias("user_id"), "item_id", "preference")
    given = _item_rows(by_user.where(F.col("path") == "user_items"))
    labels = by_user.select("label").unionByName(by_items.select("label")).distinct()
    allowed = cands.join(labels, "label", "left_semi").select("label", "item_id").distinct()
    if "label" not in sims.columns:
        sims = sims.join(allowed.withColumnRenamed("item_id", "similar_item_id"), "similar_item_id")
    users = recommend_itembased(
        None,
        own,
        sims,
        cands,
        n,
        seen=given.select(F.col("request_id").alias("user_id"), "item_id"),
        **options,
    ).withColumnRenamed("user_id", "request_id")
    items = recommend_items_for_items(
        _item_rows(by_items).select("request_id", "label", "item_id"), sims, cands, n, **options
    )
    columns = ["request_id", "rank", "item_id", "value"]
    return users.select(*columns).unionByName(items.select(*columns))


def _factorization(by_user, by_items, prefs, user_factors, item_factors, cands, n, options):
    """A user's requests for one label share a list, unless their given items leave out different candidates."""
    columns = ["request_id", "rank", "item_id", "value"]
    rows = _item_rows(by_user.where(F.col("path") == "user_items"))
    if not options.get("missing_as_zero"):
        ids = item_factors.select(F.col("id").alias("item_id")).distinct()
        rows = rows.join(cands.select("label", "item_id").distinct().join(ids, "item_id", "left_semi"), ["label", "item_id"], "left_semi")
    left_out = rows.groupBy("request_id", "label").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    asked = by_user.select("request_id", "user_id", "label", "path").join(left_out, ["request_id", "label"], "left")
    members = shared_lists(asked, ["user_id", "label", "path", "items"])
    by_user = members.where("request_id = list_id")
    given = by_user.select("request_id", "label", F.explode("items").alias("item_id"))
    history = (
        by_user.where(F.col("path") == "user")
        .select("request_id", "user_id")
        .join(prefs.select("user_id", "item_id"), "user_id")
    )
    seen = history.select("request_id", "item_id").unionByName(given.select("request_id", "item_id"))
    vectors = by_user.select("request_id", "user_id").join(
        user_factors.select(F.col("id").alias("user_id"), "features"), "user_id"
    )
    users = recommend_mf(
        by_user.select(F.col("request_id").alias("user_id"), "label"),
        prefs,
        vectors.select(F.col("request_id").alias("id"), "features"),
        item_factors,
        cands,
        n,
        seen=seen.select(F.col("request_id").alias("user_id"), "item_id"),
        **options,
    )
    users = handed_out(users.select(F.col("user_id").alias("request_id"), *columns[1:]), members)
    items = recommend_anonymous_mf(
        _item_rows(by_items).select("request_id", "label", "item_id"),
        item_factors,
        prefs,
        cands,
        n,
        share=True,
        **options,
    )
    return users.select(*columns).unionByName(items.select(*columns))


def _clusters(by_items, vectors, centroids):
    """Every known given item in the order of the request; how_many and label play no part."""
    rows = _item_rows(by_items)
    return recommend_cluster_weight(
        rows.select("request_id", (F.col("position") + 1).alias("rank"), "item_id"), vectors, centroids
    )
