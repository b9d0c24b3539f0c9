"""Streaming jobs run to the end of the given tables, and file round trips.

Input files, logs and checkpoints go below the session's shared folder, a fresh path each time.
"""

from datetime import timedelta

from pyspark.sql import functions as F

from prefspark import views as V
from prefspark.operators import clustering as K, similarity as S
from prefspark.operators.text import article_variants
from prefspark.operators.topics import document_topics, train_topics
from prefspark.plans.catalog import query, with_views
from prefspark.plans.queries_recommend import MODEL_E, MODEL_O, label_prefs, model_e
from prefspark.plans.queries_text import _clean, _words
from prefspark.plans.session import materialize, scratch_path, tasks
from prefspark.sources import files, models, sinks
from prefspark.streaming import content as W, deltas, preferences as SP


def as_stream(df, name, files_per_batch=1):
    """The rows of `df` as a file stream, one batch per file."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def event_stream(spark, d, *columns):
    log = V.pref_events(spark, d).select(*columns)
    return as_stream(log.repartition(4, "ingest_seq") if "ingest_seq" in columns else log, "events")


def finish(running):
    running.awaitTermination()
    if running.exception() is not None:
        raise running.exception()


# -- preferences -----------------------------------------------------------------------


@query("stream_preferences_max", with_views("prefs_e", "SELECT * FROM prefs_e"))
def stream_preferences_max(spark, d):
    log = scratch_path(spark, "log")
    stream = event_stream(spark, d, "user_id", "item_id", "preference", "ingest_seq")
    finish(SP.stream_preferences(stream, log, scratch_path(spark, "ckpt"), "max", available_now=True))
    return SP.read_preference_state(spark, log, "max")


CURRENT_SQL = with_views(
    "pref_events",
    """SELECT user_id, item_id, preference FROM (SELECT *, row_number() OVER
(PARTITION BY user_id, item_id ORDER BY ingest_seq DESC) AS r FROM pref_events) t WHERE r = 1""",
)


@query("stream_preferences_last", CURRENT_SQL)
def stream_preferences_last(spark, d):
    log = scratch_path(spark, "log")
    stream = event_stream(spark, d, "user_id", "item_id", "preference", "ingest_seq")
    finish(SP.stream_preferences(stream, log, scratch_path(spark, "ckpt"), "last", available_now=True))
    return SP.read_preference_state(spark, log, "last")


@query("stream_compact", CURRENT_SQL)
def stream_compact(spark, d):
    """The same state from a log that is compacted every other batch, and once more at the end."""
    log = scratch_path(spark, "log")
    stream = event_stream(spark, d, "user_id", "item_id", "preference", "ingest_seq")
    finish(SP.stream_preferences(stream, log, scratch_path(spark, "ckpt"), "last", available_now=True, compact_every=2))
    newest = deltas.read_table(spark, log).agg(F.max("batch_id")).first()[0]
    deltas.compact(spark, log, lambda rows: SP.fold_preference_log(rows, "last"), newest)
    deltas.expire(spark, log, keep=1)
    return SP.read_preference_state(spark, log, "last")


@query(
    "retrain_triggers",
    with_views(
        "pref_events",
        """SELECT label, unnest(generate_series(1, n // 250)) * 250 AS changes FROM
(SELECT label, count(*) AS n FROM pref_events GROUP BY 1) t""",
    ),
)
def retrain_triggers(spark, d):
    state = scratch_path(spark, "triggers")
    stream = event_stream(spark, d, "label", "ingest_seq")
    finish(SP.stream_retrain_triggers(stream, state, scratch_path(spark, "ckpt"), 250, available_now=True))
    return SP.read_retrain_triggers(spark, state)


@query(
    "stream_slots",
    """SELECT epoch(slot_start)::BIGINT AS slot_start, rows FROM (SELECT time_bucket(INTERVAL 4 HOUR, ts) AS slot_start,
count(*) AS rows FROM events GROUP BY 1) t WHERE slot_start + INTERVAL 4 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 16 HOUR""",
)
def stream_slots(spark, d):
    """Slots closed by the end of the table; the open ones have not been emitted yet."""
    out, ckpt = scratch_path(spark, "slots"), scratch_path(spark, "ckpt")
    stream = as_stream(V.pref_events(spark, d).select("ts"), "events", 1000)
    closed = SP.stream_slots(stream, 24).select(F.unix_seconds("slot_start").alias("slot_start"), "rows")
    writer = closed.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt)
    finish(writer.outputMode("append").trigger(availableNow=True).start())
    return spark.read.schema(closed.schema).parquet(out)


RING_SQL = with_views(
    "pref_events",
    """, s AS (SELECT *, CAST(floor(floor(epoch(ts) / 3600) / 4) AS BIGINT) AS slot_seq FROM pref_events)
SELECT user_id, item_id, preference, ingest_seq, slot_seq FROM s WHERE slot_seq >= (SELECT max(slot_seq) FROM s) - 4""",
)


@query("stream_slot_log", RING_SQL)
def stream_slot_log(spark, d):
    log = scratch_path(spark, "ring")
    stream = event_stream(spark, d, "user_id", "item_id", "preference", "ts", "ingest_seq")
    finish(SP.stream_slot_log(stream, log, scratch_path(spark, "ckpt"), 24, available_now=True))
    kept = spark.read.parquet(log)
    return kept.select("user_id", "item_id", "preference", "ingest_seq", F.col("slot_seq").cast("long").alias("slot_seq"))


@query("stream_slot_log_deferred", RING_SQL)
def stream_slot_log_deferred(spark, d):
    """The clock stands one slot before the newest rows for all batches but the last; these wait and enter with it."""
    log, path, checkpoint = (scratch_path(spark, name) for name in ("ring", "events", "ckpt"))
    rows = V.pref_events(spark, d).select("user_id", "item_id", "preference", "ts", "ingest_seq")
    newest = rows.agg(F.max("ts")).first()[0]
    # The last file has the row that was sent last; the others come before it.
    last = F.col("ingest_seq") == rows.agg(F.max("ingest_seq")).scalar()
    for part, clock in ((rows.where(~last).repartition(3, "ingest_seq"), newest - timedelta(hours=4)), (rows.where(last), newest)):
        part.write.mode("append").parquet(path)
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
        finish(SP.stream_slot_log(stream, log, checkpoint, 24, available_now=True, now=lambda clock=clock: clock))
    kept = spark.read.parquet(log)
    return kept.select("user_id", "item_id", "preference", "ingest_seq", F.col("slot_seq").cast("long").alias("slot_seq"))


# -- content -----------------------------------------------------------------------------

# The event table read as a candidate log: high values empty a label, middle ones delete, the rest add.
_OPS = "CASE WHEN preference > 400 THEN 'delete_all' WHEN preference > 100 THEN 'delete' ELSE 'add' END"

_CANDIDATE_SQL = with_views(
    "pref_events",
    f""", ev AS (SELECT label, CASE WHEN preference > 400 THEN NULL ELSE item_id END AS item_id, {_OPS} AS op, ts,
  ingest_seq AS seq FROM pref_events),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label, item_id ORDER BY ts DESC, seq DESC) AS r
  FROM ev WHERE op <> 'delete_all') t WHERE r = 1 AND op = 'add')
SELECT label, item_id FROM l WHERE NOT EXISTS (SELECT 1 FROM ev e WHERE e.op = 'delete_all' AND e.label = l.label
  AND (e.ts > l.ts OR (e.ts = l.ts AND e.seq > l.seq)))""",
)


def candidate_events(spark, d):
    return V.pref_events(spark, d).select(
        "label",
        F.expr("CASE WHEN preference > 400 THEN NULL ELSE item_id END").alias("item_id"),
        F.expr(_OPS).alias("op"),
        "ts",
        F.col("ingest_seq").alias("seq"),
    )


@query("fold_candidate_events", _CANDIDATE_SQL)
def fold_candidate_events(spark, d):
    return W.fold_candidate_events(candidate_events(spark, d))


@query("stream_candidates", _CANDIDATE_SQL)
def stream_candidates(spark, d):
    log = scratch_path(spark, "candidates")
    stream = as_stream(candidate_events(spark, d).repartition(4, "seq"), "events")
    finish(W.stream_candidates(stream, log, scratch_path(spark, "ckpt"), available_now=True))
    return W.read_candidate_state(spark, log)


_VARIANT_SQL = f"""SELECT item_id, label, training_set, t AS text FROM (
SELECT item_id, label, 'pure' AS training_set, text AS t FROM a
UNION ALL SELECT item_id, label, 'stopwords', {_clean("text")} FROM a
UNION ALL SELECT item_id, label, 'SCEAL1', text || ' ' || sce_al1 FROM a
UNION ALL SELECT item_id, label, 'processedSCEAL1', {_clean("text || ' ' || sce_al1")} FROM a) v"""


@query(
    "stream_articles",
    with_views(
        "articles", f", a AS (SELECT * FROM articles WHERE len({_words('text')}) >= 50)\n{_VARIANT_SQL}"
    ),
)
def stream_articles(spark, d):
    corpus, cands = scratch_path(spark, "corpus"), scratch_path(spark, "cands")
    stream = as_stream(V.articles(spark, d).repartition(2, "item_id"), "articles")
    finish(
        W.stream_articles(
            stream, corpus, cands, scratch_path(spark, "topics"), None, scratch_path(spark, "ckpt"), 50,
            available_now=True,
        )
    )
    return sinks.read_article_variants(spark, corpus)


@query(
    "stream_articles_backlog",
    with_views(
        "articles",
        f"""SELECT doc_id AS item_id, 4 AS topics FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) OR len({_words('text')}) >= 50""",
    ),
)
def stream_articles_backlog(spark, d):
    """Articles arrive before there is a model; a training on the labelled documents follows, and the backlog is worked off."""
    corpus, root = scratch_path(spark, "corpus"), scratch_path(spark, "topics")
    articles = V.articles(spark, d)
    # Two batches of as many files as tasks: a file of half the texts would be written by one task.
    stream = as_stream(articles.repartition(2 * tasks(spark), "item_id"), "articles", tasks(spark))
    finish(W.stream_articles(stream, corpus, scratch_path(spark, "cands"), root, None, scratch_path(spark, "ckpt"), 50, available_now=True))
    labelled = V.table(spark, d, "labels").select(F.col("doc_id").alias("item_id")).distinct()
    docs = articles.join(labelled, "item_id", "left_semi").select("item_id", "text")
    model = train_topics(docs, k=4, iters=2, partitions=tasks(spark))
    models.save_trained_topics(model, document_topics(model), root)
    W.infer_backlog(spark, corpus, root)
    found, _ = models.load_topic_model(spark, root)
    return found.select("item_id", F.size("topics").alias("topics"))


@query("stream_kmeans")
def stream_kmeans(spark, d):
    root = scratch_path(spark, "clusters")
    prefs = V.prefs_e(spark, d).select("user_id", "item_id")
    stream = as_stream(prefs.repartition(3, "item_id"), "prefs")
    finish(
        W.stream_kmeans(
            stream, scratch_path(spark, "log"), root, scratch_path(spark, "ckpt"), k=8, min_ratings=5, available_now=True
        )
    )
    return K.cluster_stats(W.load_clusters(spark, root)[0])


@query(
    "stream_kmeans_facts",
    with_views(
        "prefs_e",
        """, early AS (SELECT * FROM prefs_e WHERE (user_id + item_id) % 3 <> 0 AND item_id % 5 <> 0),
space AS (SELECT user_id FROM early GROUP BY 1 HAVING count(*) > 5)
SELECT count(*) AS items, CAST(count(*) AS DOUBLE) AS weight, 0 AS away, 0 AS off FROM
(SELECT DISTINCT item_id FROM prefs_e WHERE user_id IN (SELECT user_id FROM space)) t""",
    ),
)
def stream_kmeans_facts(spark, d):
    """A fit, then a batch with ratings of known and of new items: weights add up to the items, the batch's items are at the
    centroid that was nearest (`away`), and the means are those of the items as a full count gives them (`off`)."""
    prefs = materialize(V.prefs_e(spark, d).select("user_id", "item_id"), "prefs")
    is_early = (F.pmod(F.col("user_id") + F.col("item_id"), F.lit(3)) != 0) & (F.col("item_id") % 5 != 0)
    path, log, root, ckpt = (scratch_path(spark, n) for n in ("prefs", "log", "clusters", "ckpt"))
    seen = []
    for rows in (prefs.where(is_early), prefs.where(~is_early)):
        rows.coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(rows.schema).parquet(path)
        finish(W.stream_kmeans(stream, log, root, ckpt, k=8, available_now=True))
        seen.append(W.load_clusters(spark, root))
    (before, _), (centroids, items) = seen
    space = K.heavy_users(prefs.where(is_early), 5)
    vectors = materialize(K.new_item_vectors(prefs, space), "vectors")
    touched = K.new_item_vectors(prefs.where(~is_early), space).select("item_id").distinct()
    near = K.nearest_centroid(vectors.join(touched, "item_id", "left_semi"), before).select("item_id", F.col("centroid_id").alias("near"))
    away = near.join(items, "item_id", "left").where(~F.col("near").eqNullSafe(F.col("centroid_id")))
    counted = K.centroids_of(vectors, items).select("centroid_id", "dim", F.col("weight").alias("w"), F.col("value").alias("v"))
    off = centroids.join(counted, ["centroid_id", "dim"], "full").where(
        F.col("w").isNull() | F.col("weight").isNull() | (F.abs(F.col("v") - F.col("value")) > 1e-9) | (F.col("w") != F.col("weight"))
    )
    weights = centroids.select("centroid_id", "weight").distinct()
    return items.agg(F.count("*").alias("items")).select(
        "items",
        weights.agg(F.sum("weight")).scalar().alias("weight"),
        away.agg(F.count("*").cast("int")).scalar().alias("away"),
        off.agg(F.count("*").cast("int")).scalar().alias("off"),
    )


# -- files ---------------------------------------------------------------------------------


@query("read_preferences", with_views("pref_events", "SELECT user_id, item_id, preference FROM pref_events"))
def read_preferences(spark, d):
    path = scratch_path(spark, "preferences")
    rows = V.pref_events(spark, d)
    rows.select(F.concat_ws("\t", "user_id", "item_id", "preference", "label")).write.text(path)
    return files.read_preferences(spark, path)


@query("read_candidates", with_views("cands_o", "SELECT * FROM cands_o"))
def read_candidates(spark, d):
    path = scratch_path(spark, "candidates")
    V.cands_o(spark, d).select(F.concat_ws(",", "label", "item_id")).write.text(path)
    return files.read_candidates(spark, path)


@query(
    "write_similarities",
    with_views("prefs_e", f", {MODEL_E}\nSELECT item_id, similar_item_id, similarity FROM top"),
)
def write_similarities(spark, d):
    path = scratch_path(spark, "similarities")
    models.write_similarities(model_e(spark, d), path)
    return models.read_similarities(spark, path)


@query(
    "write_similarities_by_label",
    with_views("label_prefs", f", {MODEL_O}\nSELECT label, item_id, similar_item_id, similarity FROM top"),
)
def write_similarities_by_label(spark, d):
    path = scratch_path(spark, "similarities")
    models.write_similarities(S.similar_items_model(label_prefs(spark, d), 25, digits=6), path)
    return models.read_similarities(spark, path, labelled=True)


@query(
    "save_similarities",
    with_views("label_prefs", f", {MODEL_O}\nSELECT label, item_id, similar_item_id, similarity, rank FROM top"),
)
def save_similarities(spark, d):
    """The version in force, after one that held a single label's pairs."""
    root = scratch_path(spark, "similarities")
    sims = materialize(S.similar_items_model(label_prefs(spark, d), 25, digits=6), "model")
    models.save_similarities(sims.where("label = 'PROMO'"), root)
    models.save_similarities(sims, root)
    return models.load_similarities(spark, root).select("label", "item_id", "similar_item_id", "similarity", "rank")


@query(
    "write_article_variants",
    with_views("articles", f", a AS (SELECT * FROM articles)\n{_VARIANT_SQL}"),
)
def write_article_variants(spark, d):
    path = scratch_path(spark, "variants")
    articles = V.articles(spark, d)
    sinks.write_article_variants(article_variants(articles.withColumn("text", F.lit("old"))), path, 0)
    sinks.write_article_variants(article_variants(articles), path, 1)
    return sinks.read_article_variants(spark, path)


@query(
    "save_factors",
    with_views(
        "factors",
        "SELECT id, dim, round(x, 6) AS x FROM (SELECT id, generate_subscripts(features, 1) AS dim, unnest(features) AS x FROM factors) t",
    ),
)
def save_factors(spark, d):
    root = scratch_path(spark, "factors")
    f = V.factors(spark, d)
    models.save_factors(f.where("false"), f.where("false"), root)
    models.save_factors(f, f, root)
    _, items = models.load_factors(spark, root)
    return items.select("id", F.posexplode("features").alias("dim", "x")).select(
        "id", (F.col("dim") + 1).cast("long").alias("dim"), F.round("x", 6).alias("x")
    )


@query(
    "save_topic_model",
    """SELECT vec_id AS item_id, len(embedding) AS topics, CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[-1] AS DOUBLE) AS last,
round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total FROM embeddings""",
)
def save_topic_model(spark, d):
    """A second training comes between: rows inferred under the first are discarded."""
    root = scratch_path(spark, "topics")
    topics = V.factors(spark, d).select(F.col("id").alias("item_id"), F.col("features").alias("topics"))
    first = models.save_topic_model(topics.withColumn("topics", F.slice("topics", 1, 2)), root)
    models.save_topic_model(topics, root)
    models.save_topic_model(topics.withColumn("topics", F.slice("topics", 1, 3)), root, expected_key=first)
    saved, _ = models.load_topic_model(spark, root)
    return saved.select(
        "item_id",
        F.size("topics").cast("long").alias("topics"),
        F.get("topics", F.lit(0)).alias("first"),
        F.get("topics", F.size("topics") - 1).alias("last"),
        F.round(F.aggregate("topics", F.lit(0.0), lambda total, x: total + x), 6).alias("total"),
    )
