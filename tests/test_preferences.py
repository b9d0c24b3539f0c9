import datetime as dt

import pytest
from pyspark.sql import functions as F

from prefspark.functions.columns import id_remap, slot_hours
from prefspark.operators import candidates as C, preferences as P

PREFS = "user_id long, item_id long, preference float"
LOG = PREFS + ", ingest_seq long"


def test_id_remap(spark):
    ids = [-5, 0, 2147483647, 9876543210, -(2**63)]
    df = spark.createDataFrame([(i,) for i in ids], "id long").select("id", id_remap(F.col("id")).alias("out"))
    assert {r.id: r.out for r in df.collect()} == dict(zip(ids, [5, 0, 2147483647, 1286608622, 2]))


def test_upsert_modes(spark, rows):
    log = spark.createDataFrame([(1, 1, 1.0, 0), (1, 1, 5.0, 1), (1, 1, 2.0, 2)], LOG)
    assert rows(P.upsert_last(log).select("preference")) == [(2.0,)]
    assert rows(P.upsert_max(log).select("preference")) == [(5.0,)]


def test_upsert_in_steps_equals_upsert_at_once(spark, rows):
    data = [(u, i, float((u * 7 + i * 3 + s) % 11), s) for s, (u, i) in enumerate([(a % 5, a % 3) for a in range(60)])]
    log = spark.createDataFrame(data, LOG)
    old, new = log.where("ingest_seq < 25"), log.where("ingest_seq >= 25")
    assert rows(P.upsert_last(P.upsert_last(old), new)) == rows(P.upsert_last(log))
    assert rows(P.upsert_max(P.upsert_max(new), old)) == rows(P.upsert_max(log))


def ring(spark):
    start = dt.datetime(2024, 1, 10, 1)
    data = [(n, n, 1.0, start + dt.timedelta(hours=4 * n), n) for n in range(7)]
    return spark.createDataFrame(data, PREFS + ", ts timestamp, ingest_seq long")


def test_purge_keeps_current_and_four_before(spark):
    slotted = P.assign_slot(ring(spark), 24)
    kept = P.purge_old(slotted, "2024-01-11 01:00:00", 24)
    assert sorted(r.user_id for r in kept.collect()) == [2, 3, 4, 5, 6]
    last_hour = P.purge_old(slotted, "2024-01-11 03:59:59", 24)
    assert sorted(r.user_id for r in last_hour.collect()) == [2, 3, 4, 5, 6]
    next_slot = P.purge_old(slotted, "2024-01-11 04:00:00", 24)
    assert sorted(r.user_id for r in next_slot.collect()) == [3, 4, 5, 6]
    # A missed run drops everything that left the ring meanwhile.
    late = P.purge_old(slotted, "2024-01-20 00:00:00", 24)
    assert late.count() == 0


def test_slots_equal_the_modular_definition(spark):
    for window in (6, 12, 24, 48, 72):
        slots = P.assign_slot(ring(spark), window).select(
            "slot", F.floor((F.floor(F.unix_seconds("ts") / 3600) % window) / (window // 6)).alias("ring")
        )
        assert all(r.slot == r.ring for r in slots.collect())
    assert slot_hours(0) == slot_hours(25) == 4


def test_collapse_slots(spark, rows):
    ts = dt.datetime(2024, 1, 1)
    log = spark.createDataFrame(
        [(1, 1, 9.0, ts, 0), (1, 1, 3.0, ts + dt.timedelta(hours=5), 1)], PREFS + ", ts timestamp, ingest_seq long"
    )
    slotted = P.assign_slot(log)
    assert rows(P.collapse_slots(slotted, "last").select("preference")) == [(3.0,)]
    assert rows(P.collapse_slots(slotted, "max").select("preference")) == [(9.0,)]
    with pytest.raises(ValueError):
        P.collapse_slots(slotted, "min")


def test_lookup_and_remove(spark, rows):
    prefs = spark.createDataFrame([(1, 1, 1.0), (1, 2, 2.0), (2, 1, 3.0)], PREFS)
    keys = spark.createDataFrame([(1, 2), (9, 9)], "user_id long, item_id long")
    assert rows(P.preference_lookup(prefs, keys)) == [(1, 2, 2.0)]
    assert rows(P.remove_preference(prefs, keys)) == [(1, 1, 1.0), (2, 1, 3.0)]


def test_candidate_sets(spark, rows):
    pair = "label string, item_id long"
    cands = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], pair)
    merged, touched = C.add_candidates(cands, spark.createDataFrame([("a", 1), ("c", 5), ("c", 5)], pair))
    assert rows(merged) == [("a", 1), ("a", 2), ("b", 1), ("c", 5)]
    assert rows(touched) == [("a",), ("c",)]
    left, touched = C.delete_candidates(merged, spark.createDataFrame([("a", 2), ("b", 7)], pair))
    assert rows(left) == [("a", 1), ("b", 1), ("c", 5)]
    assert rows(touched) == [("a",), ("b",)]
    assert rows(C.delete_all_candidates(left, spark.createDataFrame([("a",)], "label string"))) == [("b", 1), ("c", 5)]
    items = spark.createDataFrame([(1,), (8,)], "item_id long")
    assert rows(C.item_label(cands, items)) == [(1, "a"), (8, None)]


def test_replacing_an_article(spark, rows):
    text = "item_id long, text string"
    corpus = spark.createDataFrame([(1, "old"), (2, "kept")], text)
    new = spark.createDataFrame([(1, "new"), (3, "added")], text)
    assert rows(C.merge_new_articles(corpus, new)) == [(1, "new"), (2, "kept"), (3, "added")]
