"""Keyed streaming state, pair statistics kept up to date, and mergeable counts."""

from pyspark.sql import functions as F

from prefspark import views as V
from prefspark.operators import pair_deltas as D, preferences as P, similarity as S, sketches as H
from prefspark.plans.catalog import query, with_views
from prefspark.plans.queries_recommend import pairs_sql
from prefspark.plans.queries_streaming import CURRENT_SQL, event_stream, finish
from prefspark.plans.session import materialize, scratch_path
from prefspark.streaming import preferences as SP, stateful as ST
from prefspark.streaming.deltas import read_table

_WRITE = "user_id", "item_id", "preference", "ingest_seq"


def _after_stream(spark, d, mode):
    log = scratch_path(spark, "changes")
    finish(ST.stream_preference_changes(event_stream(spark, d, *_WRITE), log, scratch_path(spark, "ckpt"), mode, available_now=True, compact_every=2))
    return ST.preferences_after(read_table(spark, log))


@query("stream_changes_last", CURRENT_SQL)
def stream_changes_last(spark, d):
    """The last write of every key, from the changes that keyed state reports."""
    return _after_stream(spark, d, "last")


@query("stream_changes_max", with_views("prefs_e", "SELECT * FROM prefs_e"))
def stream_changes_max(spark, d):
    return _after_stream(spark, d, "max")


@query(
    "stream_retrain_counters",
    with_views(
        "pref_events",
        """SELECT label, unnest(generate_series(1, n // 250)) * 250 AS changes FROM
(SELECT label, count(*) AS n FROM pref_events GROUP BY 1) t""",
    ),
)
def stream_retrain_counters(spark, d):
    state = scratch_path(spark, "triggers")
    stream = event_stream(spark, d, "label", "ingest_seq")
    finish(ST.stream_retrain_counters(stream, state, scratch_path(spark, "ckpt"), 250, available_now=True))
    return SP.read_retrain_triggers(spark, state)


@query(
    "pair_cooccurrence_delta",
    with_views(
        "prefs_o",
        """, kept AS (SELECT user_id, item_id, CAST(CASE WHEN (user_id + 2 * item_id) % 7 = 1 THEN preference + 1 ELSE preference END AS FLOAT) AS preference
FROM prefs_o WHERE (user_id + item_id) % 11 <> 3), """
        + pairs_sql("kept")
        + """
SELECT i AS item_id, j AS other_item_id, k11 AS "both", sxy, sx, sy, sxx, syy FROM k""",
    ),
)
def pair_cooccurrence_delta(spark, d):
    """A full count of one state of the table, and the signed change to the next: ratings are removed, changed and
    inserted. The sum is the full count of the new state."""
    new = materialize(V.prefs_o(spark, d), "new")
    x = F.col("preference")
    after = new.where((F.col("user_id") + F.col("item_id")) % 11 != 3).withColumn(
        "preference", F.when((F.col("user_id") + 2 * F.col("item_id")) % 7 == 1, x + 1).otherwise(x).cast("float")
    )
    before = new.where((F.col("user_id") + F.col("item_id")) % 11 != 5)
    stored = S.pair_statistics(before, packed=True).materialize("pairs")
    changes = materialize(D.preference_changes(before, after), "changes")
    merged = D.merge_pair_statistics(stored, D.pair_statistics_delta(before, changes, packed=True))
    return merged.withColumnsRenamed({"i": "item_id", "j": "other_item_id"})


@query(
    "stream_pair_statistics",
    with_views(
        "pref_events",
        f""", last AS ({CURRENT_SQL[CURRENT_SQL.index("SELECT user_id, item_id, preference FROM (SELECT *"):]}), {pairs_sql("last")}
SELECT i AS item_id, j AS other_item_id, k11 AS "both" FROM k""",
    ),
)
def stream_pair_statistics(spark, d):
    """Pairs of the preferences in force, kept current by a stream of writes."""
    pairs = scratch_path(spark, "pairs")
    stream = event_stream(spark, d, *_WRITE)
    finish(ST.stream_pair_statistics(stream, scratch_path(spark, "changes"), pairs, scratch_path(spark, "ckpt"), sums=["both"], available_now=True, compact_every=2))
    return ST.read_pair_statistics(spark, pairs).withColumnsRenamed({"i": "item_id", "j": "other_item_id"})


@query(
    "distinct_sketches",
    with_views(
        "pref_events cands_e",
        """SELECT label, count(DISTINCT user_id) AS num_users, count(DISTINCT item_id) AS num_items, true AS users_close, true AS items_close
FROM pref_events e JOIN cands_e c USING (item_id) GROUP BY c.label""".replace("SELECT label", "SELECT c.label"),
    ),
)
def distinct_sketches(spark, d):
    """Users and items per label, exact and from the merged sketches of all slots: within 2 % of each other."""
    slotted, cands = P.assign_slot(V.pref_events(spark, d)).drop("label"), V.cands_e(spark, d)
    stored = materialize(H.distinct_sketches(slotted, cands), "sketches")
    found = H.estimated_counts(stored).withColumnsRenamed({"num_users": "users_about", "num_items": "items_about"})
    exact = P.num_users(slotted, cands).join(P.num_items(slotted, cands), "label").join(found, "label", "left")

    def close(about, of):
        return F.coalesce(F.abs(F.col(about) - F.col(of)) <= 0.02 * F.col(of), F.lit(False))

    return exact.select("label", "num_users", "num_items", close("users_about", "num_users").alias("users_close"), close("items_about", "num_items").alias("items_close"))
