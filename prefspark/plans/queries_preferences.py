"""Preference and candidate tables."""

from pyspark.sql import functions as F

from prefspark import views as V
from prefspark.functions.columns import id_remap
from prefspark.operators import candidates as C, preferences as P, splits as S
from prefspark.operators.factors import training_gate
from prefspark.plans.catalog import query, with_views
from prefspark.sources.files import scan_preferences as scan

NOW = "2024-01-20 13:00:00"


@query(
    "scan_preferences",
    with_views("pref_events", "SELECT user_id, item_id, preference FROM pref_events"),
)
def scan_preferences(spark, d):
    events = scan(spark, f"{d}/events.parquet")
    return V.events_to_preferences(events).select("user_id", "item_id", "preference")


# -- lookups -------------------------------------------------------------------------


@query(
    "id_remap",
    """SELECT o_orderkey, CASE WHEN x < 0 OR x > 2147483647 THEN abs(x % 2147483647) ELSE x END AS id
FROM (SELECT o_orderkey, (o_orderkey - 2000) * 715827883 AS x FROM orders) t""",
)
def remap(spark, d):
    wild = (F.col("o_orderkey") - 2000) * 715827883
    return V.table(spark, d, "orders").select("o_orderkey", id_remap(wild).alias("id"))


@query(
    "preference_lookup",
    with_views(
        "prefs_e",
        """SELECT p.* FROM prefs_e p JOIN (SELECT DISTINCT user_id, item_id FROM pref_events
WHERE label = 'purchase') k USING (user_id, item_id)""",
    ),
)
def preference_lookup(spark, d):
    bought = V.pref_events(spark, d).where("label = 'purchase'")
    return P.preference_lookup(V.prefs_e(spark, d), bought)


@query(
    "preference_time_lookup",
    with_views(
        "pref_events",
        """SELECT user_id, item_id, epoch_us(max(ts)) AS ts FROM pref_events
WHERE (user_id, item_id) IN (SELECT user_id, item_id FROM pref_events WHERE label = 'purchase') GROUP BY 1, 2""",
    ),
)
def preference_time_lookup(spark, d):
    log = V.pref_events(spark, d)
    found = P.preference_time_lookup(log, log.where("label = 'purchase'"))
    return found.withColumn("ts", F.unix_micros("ts"))


@query(
    "prefs_of_users",
    with_views(
        "prefs_o",
        """SELECT DISTINCT p.* FROM prefs_o p WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
AND item_id IN (SELECT p_partkey FROM part WHERE p_type = 'ECONOMY')""",
    ),
)
def prefs_of_users(spark, d):
    debtors = V.table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("user_id"))
    return P.prefs_of_users(V.prefs_o(spark, d), debtors, V.cands_o(spark, d), "ECONOMY")


@query(
    "prefs_of_items",
    with_views(
        "prefs_o",
        "SELECT DISTINCT p.* FROM prefs_o p WHERE item_id IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#2')",
    ),
)
def prefs_of_items(spark, d):
    branded = V.table(spark, d, "part").where("p_brand = 'Brand#2'").select(F.col("p_partkey").alias("item_id"))
    return P.prefs_of_items(V.prefs_o(spark, d), branded)


@query("preferences_for_label", with_views("label_prefs", "SELECT * FROM label_prefs"))
def preferences_for_label(spark, d):
    return P.preferences_for_label(V.prefs_o(spark, d), V.cands_o(spark, d))


@query(
    "label_join",
    with_views("prefs_o cands_o", "SELECT p.* FROM prefs_o p JOIN cands_o c USING (item_id) WHERE label = 'PROMO'"),
)
def label_join(spark, d):
    return P.preferences_for_label(V.prefs_o(spark, d), V.cands_o(spark, d), "PROMO").select(*P.TRIPLE)


@query(
    "heavy_users",
    with_views("prefs_o", "SELECT user_id, count(*) AS ratings FROM prefs_o GROUP BY 1 HAVING count(*) > 40"),
)
def heavy_users(spark, d):
    return P.heavy_users(V.prefs_o(spark, d), 40)


@query(
    "items_of_users",
    with_views(
        "prefs_o",
        """SELECT DISTINCT item_id FROM prefs_o WHERE user_id IN
(SELECT user_id FROM prefs_o GROUP BY 1 HAVING count(*) > 40)""",
    ),
)
def items_of_users(spark, d):
    prefs = V.prefs_o(spark, d)
    return P.items_of_users(prefs, P.heavy_users(prefs, 40))


# -- counts -----------------------------------------------------------------------------


@query("num_users", with_views("prefs_o", "SELECT count(DISTINCT user_id) AS num_users FROM prefs_o"))
def num_users(spark, d):
    return P.num_users(V.prefs_o(spark, d))


@query(
    "num_users_by_label",
    with_views("label_prefs", "SELECT label, count(DISTINCT user_id) AS num_users FROM label_prefs GROUP BY 1"),
)
def num_users_by_label(spark, d):
    return P.num_users(V.prefs_o(spark, d), V.cands_o(spark, d))


@query("num_items", with_views("prefs_o", "SELECT count(DISTINCT item_id) AS num_items FROM prefs_o"))
def num_items(spark, d):
    return P.num_items(V.prefs_o(spark, d))


@query(
    "num_items_by_label",
    with_views("label_prefs", "SELECT label, count(DISTINCT item_id) AS num_items FROM label_prefs GROUP BY 1"),
)
def num_items_by_label(spark, d):
    return P.num_items(V.prefs_o(spark, d), V.cands_o(spark, d))


@query("distinct_users", with_views("label_prefs", "SELECT DISTINCT label, user_id FROM label_prefs"))
def distinct_users(spark, d):
    return P.distinct_users(V.prefs_o(spark, d), V.cands_o(spark, d))


@query("distinct_items", with_views("label_prefs", "SELECT DISTINCT label, item_id FROM label_prefs"))
def distinct_items(spark, d):
    return P.distinct_items(V.prefs_o(spark, d), V.cands_o(spark, d)).select("label", "item_id")


@query("item_pref_count", with_views("prefs_o", "SELECT item_id, count(*) AS num_prefs FROM prefs_o GROUP BY 1"))
def item_pref_count(spark, d):
    return P.item_pref_count(V.prefs_o(spark, d))


@query(
    "preference_bounds",
    with_views(
        "pref_events",
        "SELECT min(preference) AS min_preference, max(preference) AS max_preference FROM pref_events",
    ),
)
def preference_bounds(spark, d):
    return P.preference_bounds(V.pref_events(spark, d))


@query(
    "num_entries",
    with_views(
        "pref_orders cands_o",
        """SELECT label, count(*) AS num_entries FROM (SELECT DISTINCT label, user_id, item_id, preference
FROM pref_orders JOIN cands_o USING (item_id)) t GROUP BY 1""",
    ),
)
def num_entries(spark, d):
    return P.num_entries(V.pref_orders(spark, d), V.cands_o(spark, d))


@query(
    "item_average_rating",
    with_views(
        "prefs_o",
        "SELECT item_id, round(avg(CAST(preference AS DOUBLE)), 6) AS average_rating FROM prefs_o GROUP BY 1",
    ),
)
def item_average_rating(spark, d):
    return P.item_average_rating(V.prefs_o(spark, d)).withColumn("average_rating", F.round("average_rating", 6))


@query(
    "training_gate",
    with_views(
        "label_prefs",
        """SELECT label, count(DISTINCT item_id) AS num_items, count(DISTINCT user_id) AS num_users
FROM label_prefs GROUP BY 1 HAVING count(DISTINCT item_id) >= 5 AND count(DISTINCT user_id) >= 10""",
    ),
)
def gate(spark, d):
    return training_gate(V.prefs_o(spark, d), V.cands_o(spark, d))


# -- maintenance --------------------------------------------------------------------------

_EVENT_PREF = "user_id", "item_id", "preference"


@query(
    "upsert_last",
    with_views(
        "pref_events",
        """SELECT user_id, item_id, preference, ingest_seq FROM (SELECT *, row_number() OVER
(PARTITION BY user_id, item_id ORDER BY ingest_seq DESC) AS r FROM pref_events) t WHERE r = 1""",
    ),
)
def upsert_last(spark, d):
    log = V.pref_events(spark, d).drop("label", "ts")
    split = F.lit("2024-01-15").cast("timestamp")
    stamped = V.pref_events(spark, d)
    old, new = (
        stamped.where(when).select("user_id", "item_id", "preference", "ingest_seq")
        for when in (F.col("ts") < split, F.col("ts") >= split)
    )
    return P.upsert_last(P.upsert_last(old), new).select(*log.columns)


@query("upsert_max", with_views("prefs_e", "SELECT * FROM prefs_e"))
def upsert_max(spark, d):
    log = V.pref_events(spark, d)
    state = P.upsert_max(log.where("label <> 'purchase'"))
    return P.upsert_max(state, log.where("label = 'purchase'"))


@query(
    "remove_preference",
    with_views(
        "prefs_e",
        """SELECT p.* FROM prefs_e p WHERE NOT EXISTS (SELECT 1 FROM pref_events k WHERE k.label = 'error'
AND k.user_id = p.user_id AND k.item_id = p.item_id)""",
    ),
)
def remove_preference(spark, d):
    failed = V.pref_events(spark, d).where("label = 'error'")
    return P.remove_preference(V.prefs_e(spark, d), failed)


_SLOTTED = "SELECT *, CAST(floor(floor(epoch(ts) / 3600) / 4) AS BIGINT) AS slot_seq FROM pref_events"


@query(
    "assign_slot",
    with_views(
        "pref_events",
        f"SELECT user_id, item_id, ingest_seq, slot_seq, CAST(slot_seq % 6 AS INTEGER) AS slot FROM ({_SLOTTED}) t",
    ),
)
def assign_slot(spark, d):
    return P.assign_slot(V.pref_events(spark, d), 24).select("user_id", "item_id", "ingest_seq", "slot_seq", "slot")


@query(
    "purge_old",
    with_views(
        "pref_events",
        f"""SELECT user_id, item_id, preference, ingest_seq, slot_seq FROM ({_SLOTTED}) t
WHERE slot_seq >= floor(floor(epoch(TIMESTAMP '{NOW}') / 3600) / 4) - 4""",
    ),
)
def purge_old(spark, d):
    slotted = P.assign_slot(V.pref_events(spark, d), 24)
    return P.purge_old(slotted, NOW, 24).select("user_id", "item_id", "preference", "ingest_seq", "slot_seq")


@query(
    "collapse_slots",
    with_views(
        "pref_events",
        f"""SELECT user_id, item_id, preference FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item_id
ORDER BY slot_seq DESC, ts DESC, ingest_seq DESC) AS r FROM ({_SLOTTED}) s) t WHERE r = 1""",
    ),
)
def collapse_slots(spark, d):
    return P.collapse_slots(P.assign_slot(V.pref_events(spark, d), 24), "last")


@query(
    "collapse_slots_max",
    with_views("prefs_e", "SELECT * FROM prefs_e"),
)
def collapse_slots_max(spark, d):
    return P.collapse_slots(P.assign_slot(V.pref_events(spark, d), 24), "max")


# -- candidates -----------------------------------------------------------------------------


@query("add_candidates", with_views("cands_e", "SELECT * FROM cands_e"))
def add_candidates(spark, d):
    pairs = V.pref_events(spark, d).select("label", "item_id")
    return C.add_candidates(pairs.where("label <> 'purchase'"), pairs.where("label IN ('purchase', 'view')"))[0]


@query(
    "add_candidates_labels",
    with_views("cands_o", "SELECT DISTINCT p_type AS label FROM part WHERE p_brand = 'Brand#2'"),
)
def add_candidates_labels(spark, d):
    new = V.table(spark, d, "part").where("p_brand = 'Brand#2'")
    new = new.select(F.col("p_type").alias("label"), F.col("p_partkey").alias("item_id"))
    return C.add_candidates(V.cands_o(spark, d), new)[1]


@query(
    "delete_candidates",
    with_views(
        "cands_e",
        """SELECT * FROM cands_e EXCEPT SELECT label, item_id FROM pref_events WHERE preference > 200""",
    ),
)
def delete_candidates(spark, d):
    gone = V.pref_events(spark, d).where("preference > 200")
    return C.delete_candidates(V.cands_e(spark, d), gone)[0]


@query(
    "delete_candidates_labels",
    with_views("cands_e", "SELECT DISTINCT label FROM pref_events WHERE preference > 200"),
)
def delete_candidates_labels(spark, d):
    """The labels whose models the deletion touches."""
    gone = V.pref_events(spark, d).where("preference > 200")
    return C.delete_candidates(V.cands_e(spark, d), gone)[1]


@query(
    "delete_all_candidates",
    with_views(
        "cands_o",
        """SELECT label, item_id FROM cands_o WHERE label NOT IN
(SELECT p_type FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)""",
    ),
)
def delete_all_candidates(spark, d):
    cands = V.cands_o(spark, d)
    largest = cands.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(1)
    return C.delete_all_candidates(cands, largest)


@query("get_candidates", with_views("cands_o", "SELECT item_id FROM cands_o WHERE label = 'STANDARD'"))
def get_candidates(spark, d):
    return C.get_candidates(V.cands_o(spark, d), "STANDARD")


@query("all_labels", with_views("cands_o", "SELECT DISTINCT label FROM cands_o"))
def all_labels(spark, d):
    return C.all_labels(V.cands_o(spark, d))


@query(
    "item_label",
    with_views(
        "cands_e",
        """SELECT p_partkey AS item_id, label FROM part LEFT JOIN
(SELECT item_id, min(label) AS label FROM cands_e GROUP BY 1) c ON c.item_id = p_partkey""",
    ),
)
def item_label(spark, d):
    parts = V.table(spark, d, "part").select(F.col("p_partkey").alias("item_id"))
    return C.item_label(V.cands_e(spark, d), parts)


@query("semantic_item_view", with_views("cands_e", "SELECT DISTINCT item_id FROM cands_e"))
def semantic_item_view(spark, d):
    return C.semantic_item_view(V.cands_e(spark, d))


@query(
    "merge_new_articles",
    with_views(
        "articles",
        """SELECT item_id, label, CASE WHEN item_id IN (SELECT doc_id FROM labels) THEN text || ' ' || sce_al1
ELSE text END AS text FROM articles""",
    ),
)
def merge_new_articles(spark, d):
    corpus = V.articles(spark, d)
    labelled = V.table(spark, d, "labels").select(F.col("doc_id").alias("item_id")).distinct()
    new = corpus.join(labelled, "item_id", "left_semi").withColumn("text", F.concat_ws(" ", "text", "sce_al1"))
    columns = ["item_id", "label", "text"]
    return C.merge_new_articles(corpus.select(*columns), new.select(*columns))


@query(
    "delete_articles",
    with_views(
        "articles",
        """SELECT item_id, label, text FROM articles WHERE item_id NOT IN
(SELECT doc_id FROM labels WHERE toxic = 1)""",
    ),
)
def delete_articles(spark, d):
    corpus = V.articles(spark, d).select("item_id", "label", "text")
    toxic = V.table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("item_id"))
    keys = corpus.join(toxic, "item_id", "left_semi").select("label", "item_id")
    return C.delete_articles(corpus, corpus.select("label", "item_id"), keys)[0]


@query(
    "delete_articles_candidates",
    with_views(
        "articles",
        "SELECT label, item_id FROM articles WHERE item_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    ),
)
def delete_articles_candidates(spark, d):
    corpus = V.articles(spark, d).select("item_id", "label", "text")
    toxic = V.table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("item_id"))
    keys = corpus.join(toxic, "item_id", "left_semi").select("label", "item_id")
    return C.delete_articles(corpus, corpus.select("label", "item_id"), keys)[1]


# -- splits ------------------------------------------------------------------------------------


@query(
    "kfold_split",
    with_views(
        "prefs_o",
        """, n AS (SELECT CAST(floor(count(*) * 0.3) AS BIGINT) AS bin FROM prefs_o),
r AS (SELECT p.*, row_number() OVER (ORDER BY md5(concat_ws(':', '20260', CAST(user_id AS VARCHAR),
  CAST(item_id AS VARCHAR)))) - 1 AS pos FROM prefs_o p)
SELECT user_id, item_id, preference, CAST(f AS INTEGER) AS fold, pos >= bin * f AND pos < bin * (f + 1) AS is_test
FROM r, n, (VALUES (0), (1), (2)) AS folds(f)""",
    ),
)
def kfold_split(spark, d):
    prefs = V.prefs_o(spark, d)
    parts = []
    for fold in range(S.FOLDS):
        train, test = S.kfold_split(prefs, fold)
        for part, is_test in ((train, False), (test, True)):
            parts.append(part.withColumn("fold", F.lit(fold)).withColumn("is_test", F.lit(is_test)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
