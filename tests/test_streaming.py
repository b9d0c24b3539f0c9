import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from prefspark.operators import preferences as P, text as X, topics as L
from prefspark.sources import models, sinks
from prefspark.plans.publish import expire, folders, new_version, publish, save, version_path
from prefspark.plans.training import train
from prefspark.streaming import content as W, deltas as D, preferences as SP

LOG = "user_id long, item_id long, preference float, ingest_seq long"


@pytest.fixture
def feed(spark, tmp_path):
    """Write batches of rows as files and read them as a stream, one file per micro-batch, in order."""

    def make(schema, batches, name="in"):
        path = tmp_path / name
        path.mkdir()
        for n, batch in enumerate(batches):
            one = spark.createDataFrame(batch, schema).coalesce(1)
            one.write.mode("append").parquet(str(path))
            if n + 1 < len(batches):
                time.sleep(1.1)  # file order is by modification time
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))

    return make


def finish(query):
    assert query.awaitTermination(120)
    assert query.exception() is None


@pytest.mark.parametrize("mode", ["last", "max"])
def test_stream_upsert_equals_batch(spark, rows, feed, tmp_path, mode):
    batches = [[(s % 3, s % 2, float((s * 7) % 5), s) for s in range(b * 10, b * 10 + 10)] for b in range(3)]
    log = str(tmp_path / "log")
    finish(SP.stream_preferences(feed(LOG, batches), log, str(tmp_path / "ck"), mode, available_now=True))
    every = spark.createDataFrame([r for b in batches for r in b], LOG)
    want = P.upsert_last(every).drop("ingest_seq") if mode == "last" else P.upsert_max(every)
    assert rows(SP.read_preference_state(spark, log, mode)) == rows(want)


def test_stream_remaps_ids_and_finds_labels(spark, feed, tmp_path):
    cands = spark.createDataFrame([("b", 5), ("a", 5)], "label string, item_id long")
    schema = LOG + ", label string"
    stream = feed(schema, [[(-1, 5, 1.0, 0, None), (2, 5, 1.0, 1, "own"), (3, 6, 1.0, 2, None)]])
    log = str(tmp_path / "log")
    finish(SP.stream_preferences(stream, log, str(tmp_path / "ck"), "max", cands, available_now=True))
    got = {r.user_id: r.label for r in spark.read.parquet(log).collect()}
    assert got == {1: "a", 2: "own", 3: None}


def test_repeated_batch_changes_nothing(spark, rows, tmp_path):
    path = str(tmp_path / "log")
    df = spark.createDataFrame([(1, 1, 2.0, 0)], LOG)
    for _ in range(2):
        D.write_batch(df, 4, path)
    assert spark.read.parquet(path).count() == 1


def test_retrain_triggers(spark, feed, rows, tmp_path):
    batches = [["a"] * 3 + ["b"], ["a"] * 9, ["b"] * 4 + ["c"]]
    stream = feed("label string", [[(x,) for x in b] for b in batches])
    state = str(tmp_path / "state")
    finish(SP.stream_retrain_triggers(stream, state, str(tmp_path / "ck"), 5, available_now=True))
    # a: 3 then 12 crosses 5 and 10 at once; b: 1 then 5; c: 1
    assert rows(SP.read_retrain_triggers(spark, state)) == [("a", 10), ("a", 5), ("b", 5)]
    counts = spark.read.parquet(f"{state}/counts")
    newest = counts.where(F.col("batch_id") == counts.agg(F.max("batch_id")).scalar())
    assert rows(newest.select("label", "changes")) == [("a", 12), ("b", 5), ("c", 1)]


def test_zero_never_fires(spark, feed, tmp_path):
    state = str(tmp_path / "state")
    stream = feed("label string", [[("a",)] * 20])
    finish(SP.stream_retrain_triggers(stream, state, str(tmp_path / "ck"), 0, available_now=True))
    assert SP.read_retrain_triggers(spark, state).count() == 0


START = dt.datetime(2024, 1, 10)
RING = "user_id long, ts timestamp"


def at(slot, user):
    return (user, START + dt.timedelta(hours=4 * slot + 1))


def test_slot_log_keeps_the_ring(spark, feed, tmp_path):
    batches = [[at(s, s) for s in range(4)], [at(4, 4), at(6, 6)], [at(7, 7), at(2, 99), at(3, 98)]]
    log = str(tmp_path / "log")
    finish(SP.stream_slot_log(feed(RING, batches), log, str(tmp_path / "ck"), 24, available_now=True))
    # current slot 7: slots 3..7 stay; the late row of slot 2 is dropped, the one of slot 3 kept
    assert sorted(r.user_id for r in spark.read.parquet(log).collect()) == [3, 4, 6, 7, 98]
    assert SP.drop_slots(spark, log, 0) == []


def test_a_row_from_the_future_leaves_the_ring_alone(spark, feed, tmp_path):
    batches = [[at(s, s) for s in range(4)], [at(4, 4), (34, dt.datetime(2034, 1, 1))], [at(5, 5)]]
    log = str(tmp_path / "log")
    clock = lambda: START + dt.timedelta(hours=4 * 5 + 3)
    finish(SP.stream_slot_log(feed(RING, batches), log, str(tmp_path / "ck"), 24, available_now=True, now=clock))
    assert sorted(r.user_id for r in spark.read.parquet(log).collect()) == [1, 2, 3, 4, 5]
    assert [r.user_id for r in spark.read.parquet(log + "_later").collect()] == [34]


def test_slot_counts_drop_what_left_the_ring(spark, feed, tmp_path):
    # Spark holds late rows against the watermark of the batch before.
    batches = [[at(0, 1), at(1, 1), at(1, 2)], [at(6, 1)], [at(6, 2)], [at(1, 3), at(2, 4), at(3, 5)], [at(20, 9)]]
    out = str(tmp_path / "out")
    counts = SP.stream_slots(feed(RING, batches), 24)
    writer = counts.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck"))
    finish(writer.trigger(availableNow=True).start())
    got = {(r.slot_start - START).total_seconds() / 14400: r.rows for r in spark.read.parquet(out).collect()}
    # with slot 6 current, rows for slots 1 and below are late; slots 2 and 3 still count
    assert got == {0: 1, 1: 2, 2: 1, 3: 1, 6: 2}


CAND = "label string, item_id long, op string, ts timestamp, seq long"


def test_candidate_events(spark, feed, rows, tmp_path):
    t = lambda n: START + dt.timedelta(minutes=n)
    batches = [
        [("a", 1, "add", t(0), 0), ("a", 2, "add", t(1), 1), ("b", 1, "add", t(1), 2)],
        [("a", 1, "delete", t(2), 3), ("b", None, "delete_all", t(3), 4), ("b", 9, "add", t(3), 5)],
        [("a", 1, "add", t(4), 6), ("a", 2, "delete", t(0), 7), ("c", 3, "add", t(5), 8), ("c", 3, "add", t(6), 9)],
    ]
    log = str(tmp_path / "log")
    finish(W.stream_candidates(feed(CAND, batches), log, str(tmp_path / "ck"), available_now=True))
    want = [("a", 1), ("a", 2), ("b", 9), ("c", 3)]
    assert rows(W.read_candidate_state(spark, log)) == want
    every = spark.createDataFrame([r for b in batches for r in b], CAND)
    assert rows(W.fold_candidate_events(every)) == want


def test_articles_end_to_end(spark, feed, rows, tmp_path):
    docs = spark.createDataFrame(
        [(d, " ".join((["sun", "moon"] if d % 2 else ["bread", "milk"]) * 4)) for d in range(10)], "item_id long, text string"
    )
    model = L.train_topics(docs, k=2, iters=10, max_df_sigma=-1, subsampling=1.0)
    root = str(tmp_path / "topics")
    models.save_topic_model(L.document_topics(model, docs), root)
    schema = "item_id long, label string, text string, sce_al1 string"
    stream = feed(schema, [[(50, "l", "Sun moon; sun", "sky"), (51, "l", "short", None)], [(-52, "m", "milk bread milk", None)]])
    corpus, cands = str(tmp_path / "corpus"), str(tmp_path / "cands")
    finish(W.stream_articles(stream, corpus, cands, root, model, str(tmp_path / "ck"), 3, available_now=True))
    topics, _ = models.load_topic_model(spark, root)
    assert sorted(r.item_id for r in topics.collect()) == [*range(10), 50, 52]
    assert rows(W.read_stream_candidates(spark, cands)) == [("l", 50), ("m", 52)]
    assert {(r.item_id, r.training_set) for r in sinks.read_article_variants(spark, corpus).collect()} == {
        (50, "pure"), (50, "stopwords"), (50, "SCEAL1"), (50, "processedSCEAL1"), (52, "pure"), (52, "stopwords"),
    }


def test_articles_after_a_restart_and_a_retraining(spark, tmp_path):
    """Each batch is inferred by the model in force; what was inferred under an older one is gone with it."""
    root, corpus, cands, ck = (str(tmp_path / n) for n in ("model", "corpus", "cands", "ck"))
    docs = spark.createDataFrame([(i, " ".join([["apple pear plum", "rock sand clay"][i % 2]] * 5)) for i in range(10)], "item_id long, text string")
    train = lambda k: L.train_topics(docs, k=k, iters=3, max_df_sigma=-1.0)
    schema = "item_id long, label string, text string"
    first = train(2)
    models.save_trained_topics(first, L.document_topics(first, docs), root)

    def stream(row, name):
        spark.createDataFrame([row], schema).write.parquet(str(tmp_path / name))
        return spark.readStream.schema(schema).parquet(str(tmp_path / name))

    finish(W.stream_articles(stream((50, "l", "apple pear apple plum"), "one"), corpus, cands, root, None, ck, 3, available_now=True))
    topics = {r.item_id: r.topics for r in models.load_topic_model(spark, root)[0].collect()}
    assert sorted(topics) == [*range(10), 50] and len(topics[50]) == 2
    second = train(3)
    models.save_trained_topics(second, L.document_topics(second, docs), root)
    later = str(tmp_path / "ck2")
    finish(W.stream_articles(stream((51, "l", "rock sand rock clay"), "two"), corpus + "2", cands, root, None, later, 3, available_now=True))
    topics = {r.item_id: r.topics for r in models.load_topic_model(spark, root)[0].collect()}
    assert sorted(topics) == [*range(10), 51] and {len(x) for x in topics.values()} == {3}


def test_a_row_of_the_next_slot_enters_when_it_comes(spark, tmp_path):
    """A producer whose clock is ahead loses nothing, and a repeated batch defers and takes up the same rows."""
    log, path, hours = str(tmp_path / "log"), str(tmp_path / "in"), [3]
    clock = lambda: START + dt.timedelta(hours=4 * 5 + hours[0])

    def run(rows_):
        spark.createDataFrame(rows_, RING).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(RING).option("maxFilesPerTrigger", 1).parquet(path)
        finish(SP.stream_slot_log(stream, log, str(tmp_path / "ck"), 24, available_now=True, now=clock))
        return sorted(r.user_id for r in spark.read.parquet(log).collect())

    assert run([at(4, 4), at(5, 5), at(6, 60), at(7, 70)]) == [4, 5]
    assert run([at(5, 55)]) == [4, 5, 55]
    hours[0] = 5  # slot 6
    assert run([at(1, 1), at(6, 6)]) == [4, 5, 6, 55, 60]
    hours[0] = 2  # back: still slot 6
    assert run([at(7, 71)]) == [4, 5, 6, 55, 60]
    hours[0] = 9  # slot 7
    assert run([at(3, 3)]) == [3, 4, 5, 6, 55, 60, 70, 71]
    # Spark repeats a batch that it did not commit: the same rows are taken up, whatever the clock says by then.
    last = max(int(n) for n in os.listdir(tmp_path / "ck" / "commits") if n.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        os.remove(tmp_path / "ck" / "commits" / name)
    hours[0] = 3
    assert run([at(3, 33)]) == [3, 4, 5, 6, 33, 55, 60, 70, 71]
    assert len(folders(spark, log + "_clock")) <= 5


def test_articles_before_the_first_model_and_during_a_retraining(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join([["apple pear plum", "rock sand clay"][i % 2]] * 5)) for i in range(6)], "item_id long, text string")
    first, second = (L.train_topics(docs, k=k, iters=2, max_df_sigma=-1) for k in (2, 3))
    root, corpus, cands = (str(tmp_path / n) for n in ("model", "corpus", "cands"))
    held = lambda: {r.item_id: len(r.topics) for r in models.load_topic_model(spark, root)[0].collect()}
    known = range(6)

    spark.createDataFrame([(50, "l", "apple pear rock")], "item_id long, label string, text string").write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema("item_id long, label string, text string").parquet(str(tmp_path / "in"))
    run = lambda: finish(W.stream_articles(source(), corpus, cands, root, None, str(tmp_path / "ck"), 3, available_now=True))
    more = lambda *new: spark.createDataFrame([(n, "l", "sand clay unheard") for n in new], "item_id long, label string, text string").write.mode("append").parquet(str(tmp_path / "in"))

    run()
    assert held() == {} and W.infer_backlog(spark, corpus, root) is None
    models.save_trained_topics(first, L.document_topics(first, docs), root)
    more(51, 3)  # 3 has topics from the training
    run()
    assert held() == {**dict.fromkeys(known, 2), 50: 2, 51: 2}

    append, calls = W.append_topics, []

    def late(topics, *rest):
        if not calls:
            models.save_trained_topics(second, L.document_topics(second, docs), root)
        calls.append(rest)
        return append(topics, *rest)

    monkeypatch.setattr(W, "append_topics", late)
    more(52)
    run()
    # What was inferred under the first training is gone, and everything is there under the second.
    assert len(calls) == 2 and held() == {**dict.fromkeys(known, 3), 50: 3, 51: 3, 52: 3}
    assert W.infer_backlog(spark, corpus, root) is not None and len(calls) == 2
    items = [r.item_id for r in models.load_topic_model(spark, root)[0].collect()]
    assert len(items) == len(set(items))


@pytest.mark.parametrize("mode", ["last", "max"])
def test_compaction_bounds_the_log(spark, rows, tmp_path, mode):
    path, log, ck = (str(tmp_path / n) for n in ("in", "log", "ck"))
    batches = [[(s % 5, s % 3, float((s * 7) % 11), s) for s in range(b * 10, b * 10 + 10)] for b in range(9)]
    listed, states, old = [], [], None
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, LOG).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(LOG).parquet(path)
        finish(SP.stream_preferences(stream, log, ck, mode, available_now=True, compact_every=2))
        listed.append(len([f for f in folders(spark, log) if f.startswith("batch_id=")]))
        every = spark.createDataFrame([r for b in batches[: n + 1] for r in b], LOG)
        want = P.upsert_last(every).drop("ingest_seq") if mode == "last" else P.upsert_max(every)
        states.append(rows(SP.read_preference_state(spark, log, mode)) == rows(want))
        if n == 6:
            old = SP.read_preference_state(spark, log, mode), rows(want)
    assert all(states) and max(listed) <= 5 and listed[-1] <= 5
    # A reader that began before the last compaction and expiry is not disturbed.
    assert rows(old[0]) == old[1]
    assert len([f for f in folders(spark, D.base_root(log)) if f.startswith("v=")]) == 2
    assert D.compact(spark, log, lambda r: r, 3) is None  # already in the base


def test_candidate_log_is_compacted(spark, feed, rows, tmp_path):
    t = lambda n: START + dt.timedelta(minutes=n)
    events = [("a", 1, "add", t(0), 0), ("b", 1, "add", t(1), 1), ("b", None, "delete_all", t(2), 2), ("a", 1, "delete", t(3), 3), ("b", 1, "add", t(1), 9), ("b", 2, "add", t(4), 4), ("c", 3, "add", t(5), 5)]
    log = str(tmp_path / "log")
    finish(W.stream_candidates(feed(CAND, [[e] for e in events]), log, str(tmp_path / "ck"), available_now=True, compact_every=2))
    assert rows(W.read_candidate_state(spark, log)) == [("b", 2), ("c", 3)]
    assert len(folders(spark, log)) < len(events)


def test_old_versions_expire(spark, tmp_path):
    root = str(tmp_path / "model")
    assert expire(spark, root) == []
    versions = []
    for n in range(4):
        versions.append(new_version())
        save(spark.range(n + 1), root, "rows", versions[-1])
        if n != 1:  # begun, never published
            publish(spark, root, versions[-1], f"k{n}")
    reader = spark.read.parquet(version_path(root, versions[2], "rows"))
    assert expire(spark, root, keep=2) == sorted(versions[:2])
    assert reader.count() == 3 and folders(spark, root) == ["published", *sorted(f"v={v}" for v in versions[2:])]
    assert expire(spark, root, keep=1) == [versions[2]] and expire(spark, root, keep=1) == []
    # A version in force stays, however many late ones follow it.
    late = [new_version() for _ in range(3)]
    for v in late:
        save(spark.range(1), root, "rows", v)
        publish(spark, root, v, "old key", retrained=False)
    expire(spark, root, keep=1)
    assert f"v={versions[3]}" in folders(spark, root) and f"v={late[0]}" not in folders(spark, root)


def test_clusters_follow_the_stream(spark, feed, tmp_path):
    fit = [(100 * (i % 2) + u, i) for i in range(10) for u in range(6)]
    later = [(100 * (i % 2) + u, i) for i in range(10, 14) for u in range(6)] + [(999, 77)]
    root = str(tmp_path / "model")
    stream = feed("user_id long, item_id long", [fit, later])
    finish(
        W.stream_kmeans(stream, str(tmp_path / "log"), root, str(tmp_path / "ck"), k=4, cutoff=5.0, min_ratings=2, available_now=True)
    )
    centroids, items = W.load_clusters(spark, root)
    groups = {}
    for r in items.collect():
        groups.setdefault(r.centroid_id, set()).add(r.item_id)
    # item 77 is known to a new user only and stays out
    assert sorted(sum(map(sorted, groups.values()), [])) == list(range(14))
    assert all(len({i % 2 for i in g}) == 1 for g in groups.values())
    assert centroids.select("centroid_id", "weight").distinct().agg(F.sum("weight")).first()[0] == 14


def test_clusters_read_only_the_buckets_of_a_batch(spark, feed, tmp_path):
    """A known item with new ratings changes its cluster, means stay those of the items, other buckets' files stay shut."""
    fit = [(100 * (i % 2) + u, i) for i in range(40) for u in range(6)]
    later = [(100, 0), *((100 + u, 0) for u in range(1, 6)), *((100 + u, 0) for u in range(6)), (3, None), (None, 4), (0, 2)]
    later += [(u, 50) for u in range(6)]
    root, log = str(tmp_path / "model"), str(tmp_path / "log")
    stream = feed("user_id long, item_id long", [fit, later])
    finish(W.stream_kmeans(stream, log, root, str(tmp_path / "ck"), k=2, cutoff=5.0, min_ratings=2, available_now=True, buckets=16))
    centroids, items = W.load_clusters(spark, root)
    of = {r.item_id: r.centroid_id for r in items.collect()}
    assert sorted(of) == [*range(40), 50] and of[50] == of[2] != of[1]
    held = {(r.centroid_id, r.dim): (r.weight, r.value) for r in centroids.collect()}
    rated = {(u, i) for u, i in fit + later if u is not None and i is not None}
    for c in set(of.values()):
        mine = [i for i in of if of[i] == c]
        for u in {u for u, i in rated if of[i] == c}:
            weight, value = held.pop((c, u))
            assert weight == len(mine) and value == pytest.approx(sum((u, i) in rated for i in mine) / weight)
    assert not held
    version = W.current(spark, root)[0]
    state = spark.read.schema(W.FIT).parquet(W.version_path(root, version, "fit")).first()
    assert state.batch_id == 1 and state.fit_batch == 0
    of_batch = spark.read.schema(W.PAIR).parquet(log).where("batch_id = 1")
    met = sorted({r.bucket for r in of_batch.collect()})
    assert 0 < len(met) <= 3
    # What lies in other buckets may be unreadable: it is not opened.
    whole = {tuple(r) for r in W.known_pairs(spark, log, root, state, 0).collect()}
    spoilt = [f for f in tmp_path.rglob("*.parquet") if "bucket=" in str(f) and int(str(f).split("bucket=")[1].split("/")[0]) not in met]
    assert len(spoilt) > len(met)
    for f in spoilt:
        f.write_bytes(b"spoilt")
    found = {tuple(r) for r in W.known_pairs(spark, log, root, state, 0, met).collect()}
    assert found < whole and {(u, i) for u, i in whole if i in (0, 2)} <= found
    with pytest.raises(Exception):
        W.known_pairs(spark, log, root, state, 0).collect()


def test_a_new_fit_folds_the_log(spark, feed, tmp_path):
    batches = [[(u, 10 * b + i) for u in range(4) for i in range(3)] for b in range(4)]
    root, log = str(tmp_path / "model"), tmp_path / "log"
    stream = feed("user_id long, item_id long", batches)
    finish(W.stream_kmeans(stream, str(log), root, str(tmp_path / "ck"), k=3, min_ratings=2, refit_seconds=1e-6, available_now=True, buckets=4))
    assert sorted(p.name for p in log.iterdir() if p.name.startswith("batch_id")) == ["batch_id=3"]
    assert len(W.folders(spark, f"{root}/fits")) == 2
    centroids, items = W.load_clusters(spark, root)
    assert sorted(r.item_id for r in items.collect()) == sorted(10 * b + i for b in range(4) for i in range(3))
    assert centroids.select("centroid_id", "weight").distinct().agg({"weight": "sum"}).first()[0] == 12


def test_clusters_trained_by_kind_are_loaded_and_followed(spark, feed, tmp_path):
    """`train` publishes centroids and items with their label and no fit of a stream; a stream begins with its own."""
    rows = [(100 * (i % 2) + u, i, 1.0) for i in range(10) for u in range(6)]
    prefs = spark.createDataFrame(rows, "user_id long, item_id long, preference float")
    cands = spark.createDataFrame([("a", i) for i in range(10)] + [("b", i) for i in range(4)], "label string, item_id long")
    root = str(tmp_path / "model")
    train("clusters", root, prefs, cands, min_ratings=1, k=2, cutoff=5.0)
    centroids, items = W.load_clusters(spark, root)
    assert sorted((r.label, r.item_id) for r in items.collect()) == [("a", i) for i in range(10)] + [("b", i) for i in range(4)]
    assert {r.label: r.w for r in centroids.select("label", "centroid_id", "weight").distinct().groupBy("label").agg(F.sum("weight").alias("w")).collect()} == {"a": 10, "b": 4}
    stream = feed("user_id long, item_id long", [[row[:2] for row in rows]])
    finish(W.stream_kmeans(stream, str(tmp_path / "log"), root, str(tmp_path / "ck"), k=2, cutoff=5.0, min_ratings=1, available_now=True))
    assert sorted(r.item_id for r in W.load_clusters(spark, root)[1].collect()) == list(range(10))
