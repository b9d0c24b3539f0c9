"""Facts of trained models that SQL can state: sizes, sums and bounds that hold whatever the training found."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from prefspark import views as V
from prefspark.operators import clustering as K, factors as M, scoring as R, splits as S, topics as L, tuning as T
from prefspark.operators.preferences import preferences_for_label
from prefspark.plans.catalog import query, with_views
from prefspark.plans.queries_models import _docs, _model
from prefspark.plans.queries_recommend import _FOLD_SQL, MODEL_O, label_baskets
from prefspark.plans.queries_streaming import event_stream, finish
from prefspark.plans.session import materialize, scratch_path, tasks
from prefspark.plans.training import train
from prefspark.sources import sinks
from prefspark.sources.models import load_factors, load_similarities, load_topic_model
from prefspark.streaming import preferences as SP
from prefspark.streaming.content import load_clusters


@query(
    "fold_in_least_squares_normal",
    with_views("label_prefs factors", f"{_FOLD_SQL}\nSELECT request_id, dim, round(s, 4) AS s FROM sums"),
)
def fold_in_least_squares_normal(spark, d):
    """The folded vector times the Gram matrix is the sum of the given items' vectors."""
    items = V.factors(spark, d)
    gram = R.gram_matrix(items)

    def multiply(batches):
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"request_id": batch["request_id"], "s": list(np.stack(batch["features"].to_numpy()) @ gram)})

    back = R.fold_in_least_squares(label_baskets(spark, d), items).mapInPandas(multiply, "request_id string, s array<double>")
    return back.select("request_id", F.posexplode("s").alias("dim", "s")).select(
        "request_id", (F.col("dim") + 1).cast("long").alias("dim"), F.round("s", 4).alias("s")
    )


@query(
    "fit_streaming_kmeans_facts",
    with_views(
        "prefs_o",
        """SELECT count(*) AS items, CAST(count(*) AS DOUBLE) AS weight, 0 AS away, true AS within_k FROM
(SELECT DISTINCT item_id FROM prefs_o WHERE user_id IN (SELECT user_id FROM prefs_o GROUP BY 1 HAVING count(*) > 40)) t""",
    ),
)
def fit_streaming_kmeans_facts(spark, d):
    """Every item is at its nearest centroid, and the weights add up to the items."""
    vectors = materialize(K.item_user_vectors(V.prefs_o(spark, d), 40), "vectors")
    centroids, assignment = K.fit_streaming_kmeans(vectors, k=12, cutoff=20.0)
    weights = centroids.select("centroid_id", "weight").distinct()
    nearest = K.nearest_centroid(vectors, centroids).select("item_id", F.col("centroid_id").alias("nearest"))
    items = assignment.join(nearest, "item_id", "full").agg(
        F.count("*").alias("items"), F.count_if(~F.col("centroid_id").eqNullSafe(F.col("nearest"))).alias("away")
    )
    return items.select(
        "items",
        weights.agg(F.sum("weight")).scalar().alias("weight"),
        F.col("away").cast("int").alias("away"),
        (weights.agg(F.count("*")).scalar() <= 12).alias("within_k"),
    )


@query(
    "train_als_facts",
    with_views(
        "prefs_o",
        """SELECT kind, users, items, 8 AS rank, true AS fits FROM (VALUES ('explicit'), ('implicit')) k(kind),
(SELECT count(DISTINCT user_id) AS users, count(DISTINCT item_id) AS items FROM prefs_o) t""",
    ),
)
def train_als_facts(spark, d):
    """A vector for every user and item; explicit fits are nearer to the ratings than their mean is, implicit
    ones score what was rated above an item taken at random."""
    prefs = materialize(V.prefs_o(spark, d), "prefs")
    x = F.col("preference").cast("double")
    mean = prefs.agg(F.avg(x)).scalar()
    spread = prefs.select(F.abs(x - mean).alias("e")).agg(F.avg("e")).first()[0]
    rows, numbered = [], M.number_ratings(prefs)
    for kind in ("explicit", "implicit"):
        train = M.train_als_explicit if kind == "explicit" else M.train_als_implicit
        users, items = (materialize(f, "factors") for f in train(prefs, rank=8, reg=0.05, iters=5, numbered=numbered))
        sizes = [f.agg(F.count("*"), F.max(F.size("features"))).first() for f in (users, items)]
        if kind == "explicit":
            fits = T.absolute_error(prefs, users, items).first().mean_error < spread
        else:
            rated = R.score_pairs(prefs, users, items).agg(F.avg("value")).first()[0]
            # The mean score of all pairs is the product of the mean vectors.
            u, v = (np.array(f.select(F.posexplode("features")).groupBy("pos").agg(F.avg("col").alias("m")).orderBy("pos").toPandas()["m"]) for f in (users, items))
            fits = rated > float(u @ v)
        rows.append((kind, sizes[0][0], sizes[1][0], sizes[0][1], bool(fits)))
    return spark.createDataFrame(rows, "kind string, users long, items long, rank int, fits boolean")


@query(
    "train_all_labels_facts",
    with_views(
        "label_prefs",
        """SELECT kind, label, users, items FROM (VALUES ('explicit'), ('implicit')) k(kind),
(SELECT label, count(DISTINCT user_id) AS users, count(DISTINCT item_id) AS items FROM label_prefs GROUP BY 1
HAVING count(DISTINCT item_id) >= 5 AND count(DISTINCT user_id) >= 10) t""",
    ),
)
def train_all_labels_facts(spark, d):
    """Both branches train the labels that pass the gate, with a vector for each of their users and items."""
    prefs, cands = materialize(V.prefs_o(spark, d), "prefs"), V.cands_o(spark, d)
    out = None
    for kind in ("explicit", "implicit"):
        users, items = M.train_all_labels(prefs, cands, rank=4, iters=2, implicit=kind == "implicit")
        counted = (
            users.groupBy("label").agg(F.count("*").alias("users"))
            .join(items.groupBy("label").agg(F.count("*").alias("items")), "label")
            .select(F.lit(kind).alias("kind"), "label", "users", "items")
        )
        out = counted if out is None else out.unionByName(counted)
    return out


@query("als_error_curve_facts", "SELECT CAST(range AS INTEGER) AS iterations, true AS positive FROM range(3)")
def als_error_curve_facts(spark, d):
    """One error per iteration."""
    train, test = (materialize(p, "curve") for p in S.kfold_split(V.prefs_e(spark, d), 0))
    errors = T.als_error_curve(train, test, rank=4, reg=0.05, iters=3)
    return spark.createDataFrame([(n, e > 0) for n, e in enumerate(errors)], "iterations int, positive boolean")


_GRID = {"features": [2, 4], "lambdas": [0.05, 0.1], "alphas": [40.0], "iterations": [2]}


@query(
    "grid_search_als_facts",
    """SELECT label, iterations, rows FROM (SELECT DISTINCT event_type AS label FROM events WHERE event_type IN ('purchase', 'view')) l,
(VALUES (-1, CAST(4 AS BIGINT)), (0, CAST(12 AS BIGINT)), (1, CAST(12 AS BIGINT))) t(iterations, rows)""",
)
def grid_search_als_facts(spark, d):
    """Four grid points over three folds for two labels: a row per iteration, and a total per point."""
    prefs, cands = materialize(V.prefs_e(spark, d), "prefs"), materialize(V.cands_e(spark, d), "cands")
    out = None
    for label in ("purchase", "view"):
        found = T.grid_search_als(prefs, cands, label, **_GRID, parallelism=6)
        out = found if out is None else out.unionByName(found)
    return out.groupBy("label", "iterations").agg(F.count("*").alias("rows"))


@query(
    "halving_search_als_facts",
    with_views(
        "cands_e",
        """SELECT label, CAST(iterations AS INTEGER) AS iterations, points, spent, CAST(24 AS BIGINT) AS in_all, true AS kept_best FROM (SELECT DISTINCT label FROM cands_e) l,
(VALUES (1, CAST(4 AS BIGINT), CAST(12 AS BIGINT)), (2, CAST(2 AS BIGINT), CAST(12 AS BIGINT))) t(iterations, points, spent)""",
    ),
)
def halving_search_als_facts(spark, d):
    """Every label's grid by two rungs: points and iterations of each, and that the better half went on."""
    prefs, cands = materialize(V.prefs_e(spark, d), "prefs"), materialize(V.cands_e(spark, d), "cands")
    out = None
    for (label,) in cands.select("label").distinct().orderBy("label").collect():
        found = T.halving_search_als(prefs, cands, label, [2, 4], [0.05, 0.5], [40.0], [1, 2], parallelism=6)
        out = found if out is None else out.unionByName(found)
    out = materialize(out, "rungs")
    point = F.struct("error", "features", "lambda", "alpha")
    first = out.where("iterations = 1").groupBy("label").agg(F.slice(F.sort_array(F.collect_list(point)), 1, 2).alias("better"))
    held = F.exists("better", lambda b: (b["features"] == F.col("features")) & (b["lambda"] == F.col("lambda")) & (b["alpha"] == F.col("alpha")))
    each = out.join(first, "label").groupBy("label", "iterations").agg(
        F.count("*").alias("points"), F.sum("spent").alias("spent"), F.bool_and((F.col("iterations") == 1) | held).alias("kept_best")
    )
    return each.join(T.best_of_halving(out).select("label", F.col("spent").alias("in_all")), "label")


@query(
    "append_tuning_results",
    """SELECT p_type AS label, CAST(count(*) % 5 AS INTEGER) + 2 AS features, 0.01::DOUBLE AS "lambda", 40.0::DOUBLE AS alpha FROM part GROUP BY 1""",
)
def append_tuning_results(spark, d):
    """Results appended by two runs, and the best combination of each label read back: errors are made so that
    the number of its parts mod 5, plus 2, is the best number of features."""
    path = scratch_path(spark, "tuning")
    labels = V.cands_o(spark, d).groupBy("label").agg((F.count("*") % 5 + 2).cast("int").alias("best"))
    for lo, hi in ((1, 4), (5, 8)):
        rows = labels.withColumn("features", F.explode(F.sequence(F.lit(lo), F.lit(hi))))
        sinks.append_tuning_results(
            rows.select(
                "label", "features", F.lit(-1).alias("iterations"), F.lit(40.0).alias("alpha"), F.lit(0.01).alias("lambda"),
                (F.abs(F.col("features") - F.col("best")) + 1.0).cast("double").alias("error"),
            ),
            path,
        )
    return T.best_params(sinks.read_tuning_results(spark, path)).select("label", "features", "lambda", "alpha")


@query(
    "train_topics_facts",
    """SELECT CAST(range AS INTEGER) AS topic, CAST(100 AS BIGINT) AS terms, 100 AS last, CAST(100 AS BIGINT) AS ranks, true AS falling FROM range(8)""",
)
def train_topics_facts(spark, d):
    """Every topic's heaviest terms: distinct, ranked without gaps, weights that never rise and stay below one."""
    docs = materialize(_docs(spark, d), "docs")
    terms = sinks.topic_terms_dump(_model(docs), 100)
    ordered = F.array_sort(F.collect_list(F.struct("rank", "weight")))
    per_topic = terms.groupBy("topic").agg(
        F.countDistinct("term").alias("terms"), F.max("rank").alias("last"), F.countDistinct("rank").alias("ranks"),
        ordered.alias("listed"), F.sum("weight").alias("total"),
    )
    falls = F.forall(
        F.sequence(F.lit(1), F.size("listed") - 1),
        lambda i: F.get(F.col("listed.weight"), i) <= F.get(F.col("listed.weight"), i - 1),
    )
    return per_topic.select("topic", "terms", "last", "ranks", (falls & (F.col("total") <= 1.0)).alias("falling"))


@query(
    "document_topics_facts",
    """SELECT doc_id AS item_id, 8 AS topics, true AS whole, NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AS inferred
FROM documents d""",
)
def document_topics_facts(spark, d):
    """A distribution over eight topics for every document, trained for the labelled, inferred for the others;
    all zero for a text without a term of the dictionary."""
    docs = materialize(_docs(spark, d), "docs")
    labelled = V.table(spark, d, "labels").select(F.col("doc_id").alias("item_id")).distinct()
    known = materialize(docs.join(labelled, "item_id", "left_semi"), "known")
    model = _model(known)
    both = L.document_topics(model).withColumn("inferred", F.lit(False)).unionByName(
        L.infer_topics(model, docs, known, partitions=tasks(spark)).withColumn("inferred", F.lit(True))
    )
    total = F.aggregate("topics", F.lit(0.0), lambda acc, x: acc + x)
    return both.select("item_id", F.size("topics").alias("topics"), F.round(total, 6).isin(0.0, 1.0).alias("whole"), "inferred")


@query("doc_topics_dump_facts", "SELECT doc_id AS item_id, CAST(8 AS BIGINT) AS topics, 8 AS last, true AS whole FROM documents")
def doc_topics_dump_facts(spark, d):
    docs = materialize(_docs(spark, d), "docs")
    dump = sinks.doc_topics_dump(_model(docs), n=100)
    return dump.groupBy("item_id").agg(
        F.countDistinct("topic").alias("topics"), F.max("rank").alias("last"), F.round(F.sum("weight"), 6).isin(0.0, 1.0).alias("whole")
    )


@query(
    "train_by_name",
    with_views(
        "prefs_e cands_e",
        """SELECT c.label, count(DISTINCT p.user_id) AS users, count(DISTINCT p.item_id) AS items FROM cands_e c JOIN prefs_e p USING (item_id)
WHERE c.label IN (SELECT label FROM pref_events GROUP BY 1 HAVING count(*) >= 2000) GROUP BY 1
HAVING count(DISTINCT p.item_id) >= 5 AND count(DISTINCT p.user_id) >= 10""",
    ),
)
def train_by_name(spark, d):
    """Labels whose changes reach a multiple of 2,000 in the stream are trained and published."""
    state, root = scratch_path(spark, "triggers"), scratch_path(spark, "factors")
    stream = event_stream(spark, d, "label", "ingest_seq")
    finish(SP.stream_retrain_triggers(stream, state, scratch_path(spark, "ckpt"), 2000, available_now=True))
    labels = [r.label for r in SP.read_retrain_triggers(spark, state).select("label").distinct().collect()]
    prefs, cands = materialize(V.prefs_e(spark, d), "prefs"), materialize(V.cands_e(spark, d), "cands")
    train("factorization", root, prefs, cands, labels, rank=4, iters=2)
    users, items = load_factors(spark, root)
    if "label" not in users.columns:  # nothing was due
        users, items = (f.withColumn("label", F.lit(None).cast("string")) for f in (users, items))
    return (
        users.groupBy("label").agg(F.count("*").alias("users"))
        .join(items.groupBy("label").agg(F.count("*").alias("items")), "label")
    )


@query(
    "train_by_name_itembased",
    with_views("label_prefs", f", {MODEL_O}\nSELECT label, item_id, similar_item_id, similarity FROM top"),
)
def train_by_name_itembased(spark, d):
    """The item-based model of every label, trained by its kind and read back."""
    root = scratch_path(spark, "similarities")
    train("itembased", root, V.prefs_o(spark, d), V.cands_o(spark, d), k=25, digits=6)
    return load_similarities(spark, root).select("label", "item_id", "similar_item_id", "similarity")


@query(
    "train_by_name_lda",
    "SELECT doc_id AS item_id, CAST(6 AS BIGINT) AS topics, true AS whole FROM documents",
)
def train_by_name_lda(spark, d):
    """Topics of every document under the model that was trained by its kind and published."""
    root = scratch_path(spark, "topics")
    docs = materialize(_docs(spark, d).select("item_id", "text"), "docs")
    train("lda", root, docs=docs, k=6, iters=3, partitions=tasks(spark))
    topics, _ = load_topic_model(spark, root)
    total = F.aggregate("topics", F.lit(0.0), lambda acc, x: acc + x)
    return topics.select("item_id", F.size("topics").cast("long").alias("topics"), F.round(total, 6).isin(0.0, 1.0).alias("whole"))


@query(
    "train_by_name_clusters",
    with_views(
        "prefs_e cands_e",
        """, r AS (SELECT DISTINCT c.label, p.user_id, p.item_id FROM prefs_e p JOIN cands_e c USING (item_id)),
heavy AS (SELECT label, user_id FROM r GROUP BY 1, 2 HAVING count(*) > 4)
SELECT label, count(DISTINCT item_id) AS items, CAST(count(DISTINCT item_id) AS DOUBLE) AS weight, CAST(0 AS BIGINT) AS misplaced
FROM r JOIN heavy USING (label, user_id) GROUP BY 1""",
    ),
)
def train_by_name_clusters(spark, d):
    """Clusters of labels that share items: each label's heavy users and items alone, every item at its nearest centroid."""
    root = scratch_path(spark, "clusters")
    prefs, cands = materialize(V.prefs_e(spark, d), "prefs"), materialize(V.cands_e(spark, d), "cands")
    train("clusters", root, prefs, cands, min_ratings=4, k=6, cutoff=10.0)
    centroids, items = load_clusters(spark, root)
    view = preferences_for_label(prefs, cands).select("label", "user_id", "item_id").distinct()
    heavy = view.groupBy("label", "user_id").agg(F.count("*").alias("n")).where("n > 4").select("label", "user_id")
    # By brute force: the distance of every item from every centroid of its label.
    x = view.join(heavy, ["label", "user_id"]).select("label", "item_id", F.col("user_id").alias("dim"))
    c = centroids.select("label", "centroid_id", "dim", "value")
    norms = c.groupBy("label", "centroid_id").agg(F.sum(F.abs("value")).alias("norm"))
    each = x.groupBy("label", "item_id").agg(F.count("*").alias("length")).join(norms, "label")
    gain = x.join(c, ["label", "dim"]).groupBy("label", "item_id", "centroid_id").agg(F.sum(F.abs(1 - F.col("value")) - 1 - F.abs("value")).alias("gain"))
    far = each.join(gain, ["label", "item_id", "centroid_id"], "left").select(
        "label", "item_id", "centroid_id", (F.col("length") + F.col("norm") + F.coalesce("gain", F.lit(0.0))).alias("far")
    )
    best = far.groupBy("label", "item_id").agg(F.min("far").alias("best"))
    placed = items.join(far, ["label", "item_id", "centroid_id"]).join(best, ["label", "item_id"])
    facts = placed.groupBy("label").agg(F.countDistinct("item_id").alias("items"), F.count_if(F.col("far") > F.col("best") + 1e-6).alias("misplaced"))
    weights = centroids.select("label", "centroid_id", "weight").distinct().groupBy("label").agg(F.sum("weight").alias("weight"))
    return facts.join(weights, "label").select("label", "items", "weight", "misplaced")
