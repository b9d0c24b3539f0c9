import datetime as dt
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from prefspark.operators import pair_deltas as D, preferences as P, similarity as S, sketches as H
from prefspark.operators.factors import training_gate
from prefspark.streaming import preferences as SP, stateful as ST
from prefspark.streaming.deltas import read_table

LOG = "user_id long, item_id long, preference float, ingest_seq long"


@pytest.fixture
def inbox(spark, tmp_path):
    """A folder of files read as a stream, one file per micro-batch, that can be added to between runs."""

    class Inbox:
        def __init__(self, schema, name="in"):
            self.schema, self.path = schema, tmp_path / name
            self.path.mkdir()

        def put(self, *batches):
            for batch in batches:
                spark.createDataFrame(batch, self.schema).coalesce(1).write.mode("append").parquet(str(self.path))
                time.sleep(1.1)  # file order is by modification time

        def stream(self):
            return spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(str(self.path))

    return Inbox


def finish(query):
    assert query.awaitTermination(180)
    assert query.exception() is None


def writes(seed, start, n=40):
    rng = random.Random(seed)
    return [(rng.randint(0, 4), rng.randint(0, 3), float(rng.randint(1, 9)), start + k) for k in range(n)]


@pytest.mark.parametrize("mode", ["last", "max"])
def test_changes_equal_the_batch_upsert_and_survive_a_restart(spark, rows, inbox, tmp_path, mode):
    box, log, ck = inbox(LOG), str(tmp_path / "log"), str(tmp_path / "ck")
    batches = [writes(b, 100 * b) for b in range(3)] + [[(0, 0, 9.5, 1000), (0, 0, 1.0, 5), (7, None, 2.0, 1001), (7, 7, None, 1002)]]
    box.put(batches[0], batches[1])
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    finish(ST.stream_preference_changes(box.stream(), log, ck, mode, available_now=True))
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == provider
    box.put(batches[2], batches[3])
    finish(ST.stream_preference_changes(box.stream(), log, ck, mode, available_now=True))
    every = spark.createDataFrame([r for b in batches for r in b], LOG).where("preference is not null")
    want = P.upsert_last(every).drop("ingest_seq") if mode == "last" else P.upsert_max(every)
    changes = read_table(spark, log)
    assert rows(ST.preferences_after(changes)) == rows(want)
    # Every change names the value before it, and a write that changes nothing leaves no row.
    state = {}
    for r in changes.orderBy("batch_id").collect():
        assert r.before == state.get((r.user_id, r.item_id)) and r.before != r.after
        state[r.user_id, r.item_id] = r.after
    assert changes.groupBy("batch_id", "user_id", "item_id").count().where("count > 1").isEmpty()


def test_a_late_write_with_a_lower_sequence_loses(spark, inbox, tmp_path):
    box, log = inbox(LOG), str(tmp_path / "log")
    box.put([(1, 1, 5.0, 10)], [(1, 1, 7.0, 9)], [(1, 1, 5.0, 11)])
    finish(ST.stream_preference_changes(box.stream(), log, str(tmp_path / "ck"), available_now=True))
    assert [(r.before, r.after) for r in read_table(spark, log).collect()] == [(None, 5.0)]


def test_keys_leave_with_the_ring(spark, inbox, tmp_path):
    """Slots of four hours: a key is forgotten when its slot is no longer among the newest five."""
    box, log = inbox(LOG + ", ts timestamp"), str(tmp_path / "log")
    day = dt.datetime(2024, 1, 1)

    def at(hours):
        return day + dt.timedelta(hours=hours)

    box.put(
        [(1, 1, 5.0, 1, at(1)), (2, 2, 5.0, 2, at(1))],
        [(2, 2, 6.0, 3, at(9))],  # key (2, 2) moves two slots on
        [(3, 3, 1.0, 4, at(20))],  # slot 5: slot 0 leaves
        [(4, 4, 1.0, 5, at(20))],
    )
    finish(ST.stream_preference_changes(box.stream(), log, str(tmp_path / "ck"), window_hours=24, available_now=True))
    changes = read_table(spark, log)
    gone = changes.where("after is null").select("user_id", "item_id", "before").collect()
    assert [tuple(r) for r in gone] == [(1, 1, 5.0)]
    left = {(r.user_id, r.item_id): r.preference for r in ST.preferences_after(changes).collect()}
    assert left == {(2, 2): 6.0, (3, 3): 1.0, (4, 4): 1.0}
    folded = ST.fold_to_base(changes)
    assert folded.count() == 3


def test_unknown_mode(spark, inbox):
    with pytest.raises(ValueError):
        ST.preference_changes_of(inbox(LOG).stream(), "first")


@pytest.mark.parametrize("every_n", [3, 0])
def test_counters_pass_every_multiple_once_and_survive_a_restart(spark, rows, inbox, tmp_path, every_n):
    box, state, ck = inbox("label string, seq long"), str(tmp_path / "state"), str(tmp_path / "ck")
    box.put([("a", n) for n in range(7)] + [(None, 1)], [("a", 1), ("b", 1), (None, 2)])
    finish(ST.stream_retrain_counters(box.stream(), state, ck, every_n, available_now=True))
    box.put([("a", 1), ("b", 2), ("b", 3), (None, 3)])
    finish(ST.stream_retrain_counters(box.stream(), state, ck, every_n, available_now=True))
    want = [("a", 3), ("a", 6), ("a", 9), ("b", 3), (None, 3)] if every_n else []
    assert rows(SP.read_retrain_triggers(spark, state)) == sorted(want, key=repr)


def prefs_of(state, label=False):
    return [(("x", u, i, p) if label else (u, i, p)) for (u, i), p in sorted(state.items())]


@pytest.mark.parametrize("chunk_items", [1, 3, 512])
@pytest.mark.parametrize("label", [False, True])
def test_delta_leads_from_count_to_count(spark, chunk_items, label):
    schema = ("label string, " if label else "") + "user_id long, item_id long, preference float"
    rng = random.Random(chunk_items)
    old = {(u, i): float(rng.randint(1, 5)) for u in range(12) for i in range(9) if rng.random() < 0.5}
    new = {k: v for k, v in old.items() if rng.random() < 0.9}
    new |= {(u, i): float(rng.randint(1, 5)) for u in range(4) for i in range(12) if rng.random() < 0.3}
    new |= {(20, i): 2.0 for i in range(3)}
    for u in (6, 7):  # all of a user's ratings go
        new = {k: v for k, v in new.items() if k[0] != u}
    before, after = (spark.createDataFrame(prefs_of(s, label), schema) for s in (old, new))
    delta = D.pair_statistics_delta(before, D.preference_changes(before, after), chunk_items)
    merged = D.merge_pair_statistics(S.pair_statistics(before), delta)
    want = S.pair_statistics(after).select(*merged.columns)
    assert merged.exceptAll(want).isEmpty() and want.exceptAll(merged).isEmpty()


@pytest.mark.parametrize("chunk_items", [2, 512])
def test_packed_counts_and_deltas_merge_to_the_same(spark, chunk_items):
    """A pair that changed twice, a rating without a value, and users who come and go; a basket's pair is dealt once."""
    schema = "user_id long, item_id long, preference float"
    old = {(u, i): float(u + i) for u in range(5) for i in range(7)} | {(0, 10): None}
    new = {k: v + 1 if v and sum(k) % 3 == 0 else v for k, v in old.items() if sum(k) % 5 != 4} | {(7, i): 1.0 for i in range(3)}
    before, after = (spark.createDataFrame(prefs_of(s), schema) for s in (old, new))
    changes = D.preference_changes(before, after)
    delta = D.pair_statistics_delta(before, changes, chunk_items, packed=True)
    merged = D.merge_pair_statistics(S.pair_statistics(before, packed=True).materialize("pairs"), delta)
    plain = D.merge_pair_statistics(S.pair_statistics(before), D.pair_statistics_delta(before, changes, chunk_items))
    want = S.pair_statistics(after).select(*merged.columns)
    for got in (merged, plain):
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    made = sum(r.n for r in delta.rows.coalesce(1).collect())
    pairs = {(u, i, j) for s in (old, new) for u, i in s for w, j in s if u == w and i < j}
    assert made <= len(pairs)


def test_delta_of_one_rating_makes_its_own_pairs_only(spark):
    schema = "user_id long, item_id long, preference float"
    before = spark.createDataFrame([(u, i, 1.0) for u in range(3) for i in range(50)], schema)
    changes = spark.createDataFrame([(1, 7, 1.0, 4.0), (2, 9, 1.0, 1.0), (2, 8, None, None)], ST.CHANGE)
    delta = D.pair_statistics_delta(before, changes, chunk_items=8).collect()
    assert len(delta) == 49 and all(7 in (r.i, r.j) and r.both == 0 and r.sxy == 3.0 for r in delta)
    assert D.pair_statistics_delta(before, changes.where("user_id = 2")).isEmpty()
    none = before.where("false")
    assert D.pair_statistics_delta(none, changes.where("false")).isEmpty()


def test_streamed_pairs_equal_the_batch_count(spark, inbox, tmp_path):
    box, paths = inbox(LOG), [str(tmp_path / n) for n in ("log", "pairs", "ck")]
    batches = [writes(b, 100 * b, 25) for b in range(5)]
    for put in (batches[:3], batches[3:]):  # the second run starts from the checkpoint
        box.put(*put)
        finish(ST.stream_pair_statistics(box.stream(), *paths, available_now=True, compact_every=2))
    every = spark.createDataFrame([r for b in batches for r in b], LOG)
    want = S.pair_statistics(P.upsert_last(every))
    got = ST.read_pair_statistics(spark, paths[1]).select(*want.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def check_close(found, exact):
    for label, r in found.items():
        assert abs(r.num_users - exact[label].num_users) <= 0.02 * exact[label].num_users
        assert abs(r.num_items - exact[label].num_items) <= 0.02 * exact[label].num_items


def test_sketches_of_slots_merge_to_the_whole(spark):
    prefs = spark.range(60_000).select(
        (F.col("id") * 7919 % 20_011).alias("user_id"), (F.col("id") % 3_001).alias("item_id"), (F.col("id") % 5).alias("slot_seq")
    )
    cands = spark.range(3_001).select(F.when(F.col("id") < 2_000, "a").otherwise("b").alias("label"), F.col("id").alias("item_id"))
    cands = cands.unionByName(spark.createDataFrame([("few", 1), ("few", 1), ("few", 2), ("none", 99_999)], "label string, item_id long"))
    slots = H.distinct_sketches(prefs, cands)
    assert slots.groupBy("label").count().where("label = 'a'").first()["count"] == 5
    whole = H.distinct_sketches(prefs.drop("slot_seq"), cands)
    exact = {r.label: r for r in P.num_users(prefs, cands).join(P.num_items(prefs, cands), "label").collect()}
    for sketches in (slots, whole):
        found = {r.label: r for r in H.estimated_counts(sketches).collect()}
        assert found.keys() == exact.keys() == {"a", "b", "few"}
        check_close(found, exact)
    assert {r.label for r in H.estimated_gate(slots).collect()} == {r.label for r in training_gate(prefs, cands).collect()} == {"a", "b"}
    assert H.estimated_counts(H.distinct_sketches(prefs.where("false"), cands)).isEmpty()


@pytest.mark.parametrize("mode", ["last", "max"])
def test_a_bucket_is_asked_once_for_all_its_keys(mode):
    """A thousand keys of one bucket cost one read and one write of the state; what changes is what a dict would say."""

    class Handle:
        calls, held = 0, None

        def getValueState(self, *_):
            return self

        def get(self):
            Handle.calls += 1
            return Handle.held

        def update(self, value):
            Handle.calls += 1
            Handle.held = value

    processor, want, rng = ST.KeepWinner(mode, False), {}, random.Random(5)
    processor.init(Handle())
    for n in range(3):
        batch = [(rng.choice([None, *range(40)]), rng.randrange(25), float(rng.randint(1, 9)), 10_000 * n + k, 0) for k in range(1500)]
        frame = pd.DataFrame(batch, columns=["user_id", "item_id", "preference", "ingest_seq", "expires"])
        before = dict(want)
        for u, i, x, _, _ in batch:
            want[u, i] = max(want.get((u, i), 0), x) if mode == "max" else x
        Handle.calls = 0
        found = pd.concat(processor.handleInputRows((0,), iter([frame[:700], frame[700:]]), None))
        assert Handle.calls == 2
        got = {tuple(None if pd.isna(v) else v for v in r[:2]): tuple(None if pd.isna(v) else v for v in r[2:]) for r in found.itertuples(index=False)}
        assert len(got) == len(found) and got == {k: (before.get(k), x) for k, x in want.items() if before.get(k) != x}
