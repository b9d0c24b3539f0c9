import random

import numpy as np
import pandas as pd
import pytest

from prefspark.operators import scoring as R, topics as T
from prefspark.operators.dispatch import recommend, route
from prefspark.operators.topics import recommend_topics

VEC = "id long, features array<double>"
PREFS = "user_id long, item_id long, preference float"


def world(spark, users=30, items=50, k=4, seed=1):
    rng = np.random.default_rng(seed)
    u, v = rng.normal(size=(users, k)), rng.normal(size=(items, k))
    pick = random.Random(seed)
    prefs = [(a, b, 1.0) for a in range(users) for b in range(items) if pick.random() < 0.2]
    cands = [("even", b) for b in range(0, items, 2)] + [("all", b) for b in range(items)]
    return (
        u,
        v,
        prefs,
        spark.createDataFrame([(n, list(map(float, x))) for n, x in enumerate(u)], VEC),
        spark.createDataFrame([(n, list(map(float, x))) for n, x in enumerate(v)], VEC),
        spark.createDataFrame(prefs, PREFS),
        spark.createDataFrame(cands, "label string, item_id long"),
    )


@pytest.mark.parametrize("chunk,block,n", [(1024, 4096, 5), (7, 6, 5), (1, 1, 3), (8, 16, 1000)])
def test_blocked_scoring_equals_brute_force(spark, chunk, block, n):
    u, v, prefs, uf, vf, p, cands = world(spark)
    asked = spark.createDataFrame([(a, l) for a in range(32) for l in ("even", "all")], "user_id long, label string")
    got = R.recommend_mf(asked, p, uf, vf, cands, n, digits=6, chunk_requests=chunk, block_candidates=block)
    lists = {}
    for r in got.collect():
        lists.setdefault((r.user_id, r.label), []).append((r["rank"], r.item_id, r.value))
    seen = {}
    for a, b, _ in prefs:
        seen.setdefault(a, set()).add(b)
    rated = {b for _, b, _ in prefs}
    for a in range(30):
        for label in ("even", "all"):
            pool = [b for b in range(50) if (label == "all" or b % 2 == 0) and b in rated and b not in seen[a]]
            best = sorted(pool, key=lambda b: (-round(float(u[a] @ v[b]), 6), b))[:n]
            assert [i for _, i, _ in sorted(lists[a, label])] == best
            assert [r for r, _, _ in sorted(lists[a, label])] == list(range(1, len(best) + 1))
    assert not {a for a, _ in lists} & {30, 31}


def long_tailed(spark, users=24, items=120, k=4, seed=3):
    """As `world`, but every item is a fifth shorter than the one before it, with repeats, a zero and no vector."""
    u, v, prefs, uf, _, p, cands = world(spark, users, items, k, seed)
    v = v / np.linalg.norm(v, axis=1, keepdims=True) * (0.8 ** (np.arange(items) // 2))[:, None]
    v[1], v[7] = v[0], 0.0
    vf = [(n, list(map(float, x))) for n, x in enumerate(v)] + [(items, None)]
    return u, v, prefs, uf, spark.createDataFrame(vf, VEC), p, cands


@pytest.mark.parametrize("make", [world, long_tailed])
@pytest.mark.parametrize("head,chunk,block,n,as_zero", [(1, 8, 6, 3, False), (20, 1024, 4096, 5, True), (9, 3, 4, 1000, False)])
def test_bounded_lists_equal_full_ones(spark, rows, make, head, chunk, block, n, as_zero):
    _, _, _, uf, vf, p, cands = make(spark)
    asked = spark.createDataFrame([(a, l) for a in range(26) for l in ("even", "all")], "user_id long, label string")
    sizes = {"chunk_requests": chunk, "block_candidates": block, "missing_as_zero": as_zero, "digits": 6}
    full = R.recommend_mf(asked, p, uf, vf, cands, n, **sizes)
    bounded = R.recommend_mf(asked, p, uf, vf, cands, n, bounds=True, head_candidates=head, **sizes)
    assert rows(bounded) == rows(full) and full.count() > 0


def test_short_candidates_are_skipped(spark):
    """With steeply falling lengths nearly no (request, block) beyond the head is left; with equal ones none may go."""
    for make, most in ((long_tailed, 0.3), (world, 1.0)):
        u, v, _, uf, vf, p, cands = make(spark)
        n = 3
        items = vf.where("features IS NOT NULL").withColumn("length", R.vector_length(R.F.col("features")))
        universe = cands.join(items.withColumnRenamed("id", "item_id"), "item_id")
        universe = universe.withColumn("band", R.length_band(R.F.col("length")))
        profile = R.band_profile(universe, 12, 4)
        requests = uf.select(R.F.col("id").alias("request_id"), R.F.lit("all").alias("label"), "features")
        held = {(r.label, b.band): b for r in profile.collect() for b in r.bands}
        head = {r.label: r.head for r in profile.collect()}["all"]
        blocks = {b: x.blocks for (label, b), x in held.items() if label == "all"}
        of = {r.item_id: r.band for r in universe.where("label = 'all'").collect()}
        first = [(a, "all", float(u[a] @ v[b])) for a in range(len(u)) for b in of if of[b] <= head]
        found = R.deeper_requests(
            spark.createDataFrame(first, "request_id long, label string, value double"), requests, profile, n
        )
        deepest = {r.request_id: r.hi for r in found.collect()}
        after = sum(n_blocks for band, n_blocks in blocks.items() if band > head) * len(u)
        met = sum(n_blocks for a in deepest for band, n_blocks in blocks.items() if head < band <= deepest[a])
        assert after > 0 and met <= most * after
        # What was skipped cannot be among the best.
        for a in range(len(u)):
            last = sorted((x for r, _, x in first if r == a), reverse=True)[n - 1]
            assert all(u[a] @ v[b] < last for b in of if of[b] > max(head, deepest.get(a, head)))


def test_lengths_without_a_number_come_first(spark):
    vectors = spark.createDataFrame(
        [(0, [3.0, 4.0]), (1, None), (2, [1.0, None]), (3, [float("nan")]), (4, [0.0]), (5, []), (6, [float("inf")])], VEC
    )
    length = R.vector_length(R.F.col("features"))
    got = {r.id: (r.length, r.band) for r in vectors.select("id", length.alias("length"), R.length_band(length).alias("band")).collect()}
    worst = (float("inf"), -R.LAST_BAND)
    assert got == {0: (5.0, -10), 1: (0.0, 200), 2: worst, 3: worst, 4: (0.0, 200), 5: (0.0, 200), 6: worst}


def test_cells_do_not_outgrow_the_tasks(spark, monkeypatch):
    """Chunks grow with the blocks they meet, and a user's history is one for all labels asked for."""
    monkeypatch.setattr(R, "CHUNK_REQUESTS", 1)
    requests = spark.range(400).select(
        R.F.col("id").alias("request_id"), R.F.explode(R.F.array(R.F.lit("a"), R.F.lit("b"))).alias("label"),
        R.F.array(R.F.lit(1.0)).alias("features"), R.F.lit(None).cast("double").alias("least"), R.F.lit(0).alias("lo"), R.F.lit(0).alias("hi"),
    )
    universe = spark.range(64).select(
        R.F.lit("a").alias("label"), R.F.col("id").alias("item_id"), R.F.array(R.F.lit(1.0)).alias("features"),
        R.F.lit(0.0).alias("length"), R.F.lit(0).alias("band"),
    )
    universe = universe.unionByName(universe.withColumn("label", R.F.lit("b")).where("item_id < 8"))
    # Item 70 is no candidate, request 900 asks for nothing, and a row comes twice.
    seen = spark.createDataFrame([(5, 3), (5, 3), (6, 50), (5, 70), (900, 3)], "request_id long, item_id long")

    def sizes(key, left, block):
        marks = left["seen_item"].notna()
        return pd.DataFrame({"label": [key[0]], "request_id": [int((~marks).sum())], "item_id": [int(marks.sum())], "value": [float(len(block))]})

    asked = requests.select("request_id", "label", "lo", "hi")
    cells = R._cells(requests, asked, seen, universe, R.band_profile(universe, 1, 8), sizes, None).collect()
    met = sum(r.request_id * r.value for r in cells if r.value)
    assert met == 400 * (64 + 8)
    assert len(cells) <= 2 * R.even_tasks(spark) and sum(r.item_id for r in cells) == 3


def test_given_items_replace_the_history(spark):
    u, v, prefs, uf, vf, p, cands = world(spark)
    asked = spark.createDataFrame([(0, "all")], "user_id long, label string")
    given = spark.createDataFrame([(0, 1), (0, 2)], "user_id long, item_id long")
    got = {r.item_id for r in R.recommend_mf(asked, p, uf, vf, cands, 1000, seen=given).collect()}
    assert got == {b for _, b, _ in prefs} - {1, 2}


def test_rescore_sees_every_score(spark):
    u, v, prefs, uf, vf, p, cands = world(spark)
    asked = spark.createDataFrame([(0, "all")], "user_id long, label string")
    flipped = R.recommend_mf(
        asked, p, uf, vf, cands, 3, rescore=lambda item, value: -value, block_candidates=8
    ).collect()
    mine = {b for a, b, _ in prefs if a == 0}
    pool = sorted({b for _, b, _ in prefs} - mine, key=lambda b: (u[0] @ v[b], b))
    assert [r.item_id for r in sorted(flipped, key=lambda r: r["rank"])] == pool[:3]


def test_blocks_hand_over_how_many_rows_whatever_the_ties():
    left = pd.DataFrame({"request_id": range(5), "features": [np.ones(2)] * 5, "seen_item": [None] * 5})
    block = pd.DataFrame({"item_id": [*range(200, 100, -1)], "features": [np.ones(2)] * 99 + [None]})
    out = R._best_of_block(10, 6, None)(("l", 0, 0), left, block)
    assert len(out) == 50 and sorted(set(out["item_id"])) == [*range(102, 112)]
    seen = pd.DataFrame({"request_id": [2], "features": [None], "seen_item": [103]})
    out = R._best_of_block(10, 6, lambda item, value: value - (item > 110))(("l", 0, 0), pd.concat([left, seen]), block)
    assert sorted(out[out["request_id"] == 2]["item_id"]) == [102, *range(104, 113)]


def test_unseen_items(spark, rows):
    prefs = spark.createDataFrame([(1, 1, 1.0), (2, 2, 1.0)], PREFS)
    cands = spark.createDataFrame([("l", 1), ("l", 2), ("l", 3)], "label string, item_id long")
    users = spark.createDataFrame([(1, "l"), (5, "l")], "user_id long, label string")
    # item 3 has no preference
    assert rows(R.unseen_items(users, prefs, cands)) == [("l", 1, 2), ("l", 5, 1), ("l", 5, 2)]


def test_fold_in(spark):
    items = spark.createDataFrame([(1, [1.0, -2.0]), (2, [3.0, 1.0]), (3, [0.0, 0.0])], VEC)
    sets = spark.createDataFrame(
        [(1, 1), (1, 2), (1, 99), (2, 98), (3, 3)], "request_id long, item_id long"
    )
    got = {r.request_id: r.features for r in R.fold_in_anonymous(sets, items).collect()}
    assert got == {1: [0.8, -0.2], 3: [None, None]}


def test_anonymous_recommendations(spark):
    u, v, prefs, uf, vf, p, cands = world(spark)
    sets = spark.createDataFrame([(9, "even", 0), (9, "even", 3), (8, "even", 777)], "request_id long, label string, item_id long")
    got = sorted(R.recommend_anonymous_mf(sets, vf, p, cands, 4).collect(), key=lambda r: r["rank"])
    folded = v[0] + v[3]
    folded = folded / np.abs(folded).sum()
    pool = [b for b in {b for _, b, _ in prefs} if b % 2 == 0 and b != 0]
    assert [r.item_id for r in got] == sorted(pool, key=lambda b: -(folded @ v[b]))[:4]
    assert {r.request_id for r in got} == {9}


def test_least_squares_fold_in(spark):
    _, v, _, _, vf, _, _ = world(spark)
    sets = spark.createDataFrame([(1, 3), (1, 4), (2, 10)], "request_id long, item_id long")
    rows = v @ np.linalg.inv(v.T @ v)
    got = {r.request_id: r.features for r in R.fold_in_least_squares(sets, vf).collect()}
    assert np.allclose(got[1], rows[3] + rows[4]) and np.allclose(got[2], rows[10])


def test_topic_recommendations(spark):
    topics = spark.createDataFrame([(1, [0.9, 0.1]), (2, [0.8, 0.2]), (3, [0.1, 0.9])], "item_id long, topics array<double>")
    cands = spark.createDataFrame([("l", i) for i in (1, 2, 3, 4)] + [("m", 5)], "label string, item_id long")
    seeds = spark.createDataFrame(
        [(1, "l", 0, 1), (2, "l", 0, 1), (2, "l", 1, 2), (3, "l", 0, 77)],
        "request_id long, label string, position int, item_id long",
    )
    got = {}
    for r in sorted(recommend_topics(seeds, topics, cands, digits=6).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.request_id, []).append((r.item_id, r.value))
    assert got == {1: [(2, 0.74), (3, 0.18), (4, 0.0)], 2: [(3, 0.18), (4, 0.0)]}


@pytest.mark.parametrize("long_list", [64, 3])
def test_requests_share_the_scores_of_their_first_item(spark, monkeypatch, long_list):
    """Many requests with few first items are scored per first item; lists over the limit on their own."""
    monkeypatch.setattr(T, "LONG_LIST", long_list)
    rng, pick = np.random.default_rng(5), random.Random(5)
    v = {n: rng.normal(size=3) for n in range(12)}
    topics = spark.createDataFrame([(n, list(map(float, x))) for n, x in v.items()], "item_id long, topics array<double>")
    pool = {"a": range(0, 40), "b": range(6, 90, 2)}
    cands = spark.createDataFrame([(label, i) for label, ids in pool.items() for i in ids], "label string, item_id long")
    given = {n: ("ab"[n % 2], [pick.randrange(4), *pick.sample(range(4, 20), n % 6)]) for n in range(60)}
    seeds = [(n, label, at, i) for n, (label, items) in given.items() for at, i in enumerate(items)]
    sizes = []
    monkeypatch.setattr(T, "top_unseen", lambda requests, *a, **k: sizes.append(requests.count()) or R.top_unseen(requests, *a, **k))
    got = {}
    frame = spark.createDataFrame(seeds, "request_id long, label string, position int, item_id long")
    for r in sorted(T.recommend_topics(frame, topics, cands, 5, digits=6).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.request_id, []).append((r["rank"], r.item_id, r.value))
    for n, (label, items) in given.items():
        score = {i: round(float(v[items[0]] @ v[i]), 6) if i in v else 0.0 for i in pool[label] if i not in items}
        best = sorted(score, key=lambda i: (-score[i], i))[:5]
        assert [(k, i) for k, i, _ in got[n]] == [*enumerate(best, 1)]
        assert np.allclose([x for _, _, x in got[n]], [score[i] for i in best], atol=1e-9)
    assert sizes[0] <= 8 and len(sizes) == (1 if long_list == 64 else 2)


def test_vectors_are_sent_to_few_large_cells(spark, monkeypatch):
    """Work for all tasks is all that chunks and blocks are cut for; lists are those of small cells."""
    monkeypatch.setattr(R, "TILE_SCORES", 1 << 14, raising=False)
    met = spark.sparkContext.accumulator(0)
    make = R._best_of_block

    def counting(*args):
        best = make(*args)

        def run(key, left, block):
            met.add(int(left["seen_item"].isna().sum()))
            return best(key, left, block)

        return run

    monkeypatch.setattr(R, "_best_of_block", counting)
    rng = np.random.default_rng(2)
    vectors = spark.createDataFrame([(n, [float(a), float(b)]) for n, (a, b) in enumerate(rng.integers(-9, 9, (5000, 2)))], VEC)
    cands = vectors.select(R.F.lit("all").alias("label"), R.F.col("id").alias("item_id"))
    requests = vectors.where("id < 20").select(R.F.col("id").alias("request_id"), R.F.lit("all").alias("label"), "features")
    seen = spark.createDataFrame([(a, b) for a in range(20) for b in range(a, 5000, 3)], "request_id long, item_id long")
    got = R.top_unseen(requests, seen, vectors, cands, 5, digits=6).collect()
    assert met.value == 20
    small = R.top_unseen(requests, seen, vectors, cands, 5, digits=6, chunk_requests=3, block_candidates=700).collect()
    assert sorted(got) == sorted(small) and len(got) == 100 and met.value == 20 + 8 * 20


REQ = "request_id long, user_id long, item_ids array<long>, label string, how_many int"


def test_routing(spark):
    df = spark.createDataFrame(
        [(1, 5, None, "l", None), (2, 5, [0], "l", 3), (3, 5, [1, 2], "l", 3), (4, None, [1], "l", 3), (5, None, None, "l", 3), (6, None, [0], "l", 1)],
        REQ,
    )
    got = {r.request_id: (r.path, r.how_many) for r in route(df).collect()}
    assert got == {
        1: ("user", 10), 2: ("user", 3), 3: ("user_items", 3), 4: ("items", 3), 5: ("error", 3), 6: ("items", 1),
    }


def test_dispatch_factorization(spark):
    u, v, prefs, uf, vf, p, cands = world(spark)
    requests = spark.createDataFrame(
        [(1, 3, None, "all", 4), (2, 3, [5, 6], "even", 2), (3, None, [1, 2], "all", 1), (4, None, None, "all", 2), (5, 999, None, "all", 2)],
        REQ,
    )
    got = recommend("factorization", requests, cands, p, user_factors=uf, item_factors=vf).collect()
    counts = {}
    for r in got:
        counts.setdefault(r.request_id, []).append(r)
    assert {k: len(x) for k, x in counts.items()} == {1: 4, 2: 2, 3: 1, 4: 1}
    assert counts[4][0].error and counts[4][0].item_id is None
    mine = {b for a, b, _ in prefs if a == 3}
    best = sorted({b for _, b, _ in prefs} - mine, key=lambda b: -(u[3] @ v[b]))[:4]
    assert [r.item_id for r in sorted(counts[1], key=lambda r: r["rank"])] == best


def test_dispatch_itembased(spark):
    prefs = spark.createDataFrame([(1, 1, 4.0), (1, 2, 2.0)], PREFS)
    sims = spark.createDataFrame([(1, 3, 0.5), (2, 4, 0.25), (1, 4, 0.1)], "item_id long, similar_item_id long, similarity double")
    cands = spark.createDataFrame([("a", 3), ("b", 3), ("b", 4)], "label string, item_id long")
    requests = spark.createDataFrame(
        [(1, 1, None, "a", 9), (2, 1, None, "b", 9), (3, 1, [4], "b", 9), (4, None, [1], "b", 1), (5, None, None, "b", 1)], REQ
    )
    got = recommend("itembased", requests, cands, prefs, sims=sims).collect()
    items = {}
    for r in sorted(got, key=lambda r: r["rank"] or 0):
        items.setdefault(r.request_id, []).append(r.item_id)
    assert items == {1: [3], 2: [3, 4], 3: [3], 4: [3], 5: [None]}


def test_an_answer_does_not_depend_on_other_requests(spark):
    prefs = spark.createDataFrame([(1, 1, 4.0), (1, 2, 2.0)], PREFS)
    sims = spark.createDataFrame([(10, 3, 0.5), (2, 4, 0.25), (1, 4, 0.1)], "item_id long, similar_item_id long, similarity double")
    cands = spark.createDataFrame([("a", 3), ("b", 3), ("b", 4)], "label string, item_id long")
    mine = (4, None, [10], "b", 5)
    answers = []
    for others in ([], [(1, 1, None, "a", 9)], [(1, 1, None, "b", 9)]):
        got = recommend("itembased", spark.createDataFrame([mine, *others], REQ), cands, prefs, sims=sims)
        answers.append([(r.item_id, r.value) for r in got.where("request_id = 4").collect()])
    assert answers[0] == answers[1] == answers[2] == [(3, 0.5)]


def test_cluster_requests_of_unknown_items_fail(spark):
    cands = spark.createDataFrame([("l", 1)], "label string, item_id long")
    vectors = spark.createDataFrame([(1, 10, 1.0)], "item_id long, dim long, value double")
    centroids = spark.createDataFrame([(0, 4.0, 10, 1.0)], "centroid_id long, weight double, dim long, value double")
    requests = spark.createDataFrame([(1, None, [7, 8], "l", 1), (2, None, [1, 8], "l", 1)], REQ)
    got = recommend("clusters", requests, cands, vectors=vectors, centroids=centroids).collect()
    assert sorted((r.request_id, r.item_id or 0, r.error or "") for r in got) == [(1, 0, "no item is known"), (2, 1, "")]


def test_dispatch_clusters_and_topics(spark):
    cands = spark.createDataFrame([("l", 1), ("l", 2)], "label string, item_id long")
    vectors = spark.createDataFrame([(1, 10, 1.0), (2, 20, 1.0)], "item_id long, dim long, value double")
    centroids = spark.createDataFrame(
        [(0, 4.0, 10, 1.0), (1, 1.0, 20, 1.0)], "centroid_id long, weight double, dim long, value double"
    )
    requests = spark.createDataFrame([(1, None, [2, 1, 9], "l", 1), (2, 3, None, "l", 1)], REQ)
    got = recommend("clusters", requests, cands, vectors=vectors, centroids=centroids).collect()
    assert sorted((r.request_id, r["rank"] or 0, r.item_id or 0, r.value or 0) for r in got) == [
        (1, 1, 2, 0.25), (1, 2, 1, 1.0), (2, 0, 0, 0),
    ]
    topics = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 0.5])], "item_id long, topics array<double>")
    got = recommend("lda", requests, cands, topics=topics).collect()
    # request 1 starts with item 2: item 1 is among the given ones, so nothing is left
    assert [(r.request_id, r.item_id) for r in got] == [(2, None)]


def test_equal_requests_are_scored_once(spark, monkeypatch):
    """Lists of the same known items, and a user's requests for one label, are one list; what differs stays apart."""
    asked = []
    real = R.top_unseen

    def spy(requests, *args, **options):
        asked.append(requests.count())
        return real(requests, *args, **options)

    monkeypatch.setattr(R, "top_unseen", spy)
    rng = np.random.default_rng(5)
    v = {i: rng.normal(size=3) for i in range(6)}
    factors = spark.createDataFrame([(i, x.tolist()) for i, x in v.items()], "id long, features array<double>")
    cands = spark.createDataFrame([(label, i) for label in "ab" for i in range(8)], "label string, item_id long")
    prefs = spark.createDataFrame([(u, i, 1.0) for u in (1, 2) for i in (u, 7)] + [(9, i, 1.0) for i in range(8)], PREFS)
    lists = {1: ("a", [0, 7]), 2: ("a", [0]), 3: ("a", [0, 1]), 4: ("b", [0]), 5: ("a", [7]), 6: ("a", [1, 0, 0, 99])}
    sets = spark.createDataFrame([(r, label, i) for r, (label, items) in lists.items() for i in items], "request_id long, label string, item_id long")
    got = {}
    for r in R.recommend_anonymous_mf(sets, factors, prefs, cands, 3, share=True).collect():
        got.setdefault(r.request_id, {})[r["rank"]] = (r.label, r.item_id, r.value)
    want = lambda u, seen: sorted((i for i in v if i not in seen), key=lambda i: -(u @ v[i]))[:3]
    assert asked == [3] and sorted(got) == [1, 2, 3, 4, 6]
    for r, places in got.items():
        known = {i for i in lists[r][1] if i in v}
        u = sum(v[i] for i in known)
        assert [places[n][1] for n in (1, 2, 3)] == want(u, known) and {x[0] for x in places.values()} == {lists[r][0]}
    asked.clear()
    requests = [(1, 1, None, "a", 3), (2, 1, None, "a", 2), (3, 2, None, "a", 3), (4, 1, [2], "a", 3), (5, 1, [2, 7, 99], "a", 3), (6, 1, [98], "a", 3), (7, 1, None, "b", 3)]
    found = {}
    answers = recommend("factorization", spark.createDataFrame(requests, REQ), cands, prefs, user_factors=factors, item_factors=factors)
    for r in answers.orderBy("rank").collect():
        found.setdefault(r.request_id, []).append(r.item_id)
    assert asked[0] == 5  # 1 and 2, 3, 4 and 5, 6, 7
    seen = {1: {1}, 2: {1}, 3: {2}, 4: {2}, 5: {2}, 6: set(), 7: {1}}
    assert found == {r: want(v[u], seen[r])[: n] for r, u, _, _, n in requests}
