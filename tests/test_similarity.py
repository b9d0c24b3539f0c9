import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from prefspark.functions.columns import MEASURES, register_measure
from prefspark.operators import itembased as I, pair_sums as Q, similarity as S
from prefspark.operators.topk import top_n

PREFS = "user_id long, item_id long, preference float"


def sample(seed=1, users=40, items=25, density=0.3):
    rng = random.Random(seed)
    return [(u, i, float(rng.randint(1, 5))) for u in range(users) for i in range(items) if rng.random() < density]


def brute(data):
    by_item = {}
    for u, i, p in data:
        by_item.setdefault(i, {})[u] = p
    for i, j in itertools.combinations(sorted(by_item), 2):
        common = by_item[i].keys() & by_item[j].keys()
        if common:
            yield i, j, [by_item[i][u] for u in common], [by_item[j][u] for u in common], by_item[i], by_item[j]


def xlogx(x):
    return x * math.log(x) if x > 0 else 0.0


def entropy_llr(k11, k12, k21, k22):
    rows = xlogx(k11 + k12) + xlogx(k21 + k22)
    cols = xlogx(k11 + k21) + xlogx(k12 + k22)
    return 2 * (sum(map(xlogx, (k11, k12, k21, k22))) - rows - cols + xlogx(k11 + k12 + k21 + k22))


@pytest.mark.parametrize("chunk_items", [512, 1, 4, 7])
def test_pair_statistics_whatever_the_chunks(spark, chunk_items):
    data = sample()
    got = {
        (r.i, r.j): (r.both, r.sxy, r.sx, r.sy, r.sxx, r.syy)
        for r in S.pair_statistics(spark.createDataFrame(data, PREFS), chunk_items).collect()
    }
    want = {
        (i, j): (len(x), sum(a * b for a, b in zip(x, y)), sum(x), sum(y), sum(a * a for a in x), sum(b * b for b in y))
        for i, j, x, y, _, _ in brute(data)
    }
    assert got == want


def test_one_user_owning_a_third_of_the_rows(spark):
    data = [(0, i, 1.0) for i in range(300)] + [(u, (u * 7 + k) % 300, 1.0) for u in range(1, 121) for k in range(5)]
    df = spark.createDataFrame(data, PREFS)
    plain = S.pair_cooccurrence(df, chunk_items=10_000)
    split = S.pair_cooccurrence(df, chunk_items=50)
    assert plain.exceptAll(split).count() == 0 and split.exceptAll(plain).count() == 0
    assert split.count() == 300 * 299 // 2


def test_copies_of_a_rating_follow_its_basket(spark):
    """A wide catalogue of short baskets copies nothing; a long basket copies by its own chunks."""
    data = [(u, u * 10 + k, 1.0) for u in range(200) for k in range(10)] + [(999, i, 1.0) for i in range(100)]
    baskets = S._baskets(spark.createDataFrame(data, PREFS), [])
    packed = S._packed(baskets, ["user_id"], 20)
    held = {}
    for r in packed.collect():
        held.setdefault(r.user_id, []).append(len(r.held))
        # A chunk meets every other chunk of its basket once, and no basket of one chunk is copied.
        assert r.chunks == (5 if r.user_id == 999 else 1)
    assert sum(held.pop(999)) == 100 and set(map(tuple, held.values())) == {(10,)}
    # Every pair is made once, and none is thrown away.
    made = {r.user_id: (r["count"], r.kinds) for r in S._pairs(packed, ["user_id"]).groupBy("user_id").agg(
        F.count("*").alias("count"), F.countDistinct("a.item_id", "b.item_id").alias("kinds")).collect()}
    assert made.pop(999) == (4950, 4950) and set(made.values()) == {(45, 45)}


def test_labels_are_kept_apart(spark):
    data = [("a", *r) for r in sample(1)] + [("b", *r) for r in sample(2)]
    both = S.pair_statistics(spark.createDataFrame(data, "label string, " + PREFS), chunk_items=5)
    for label, seed in (("a", 1), ("b", 2)):
        alone = S.pair_statistics(spark.createDataFrame(sample(seed), PREFS))
        mine = both.where(F.col("label") == label).drop("label")
        assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, alone.collect()))


@pytest.mark.parametrize("held,buckets", [(1_000_000, 4096), (40, 3), (7, 1)])
def test_packed_sums_are_grouped_sums(spark, rows, monkeypatch, held, buckets):
    """Whatever a task holds and however full a bucket is; null keys are keys, null figures are left out."""
    monkeypatch.setattr(Q, "HELD", held)
    monkeypatch.setattr(Q, "OUT", 16)
    rng = random.Random(4)
    some = lambda x: None if rng.random() < 0.1 else x
    data = [(some(rng.choice("ab")), some(rng.randrange(9)), some(rng.randrange(9)), rng.choice((1, -1)), some(float(rng.randrange(5))), some(rng.randrange(5))) for _ in range(600)]
    df = spark.createDataFrame(data, "label string, i long, j long, both long, sxy double, n_i long")
    want = df.groupBy("label", "i", "j").agg(F.sum("both").alias("both"), F.sum("sxy").alias("sxy"), F.max("n_i").alias("n_i"))
    got = Q.pair_sums(df, ["label", "i", "j"], ["n_i"], buckets)
    assert rows(got) == rows(want) and got.dtypes == want.dtypes
    assert Q.pair_sums(df.where("false"), ["label", "i", "j"], ["n_i"]).isEmpty()


def test_pairs_are_packed_before_they_are_shuffled(spark):
    """A pair that occurs once costs a few bytes of the shuffle."""
    data = [(u, i, float((u * i) % 5)) for u in range(40) for i in range(u * 50, u * 50 + 50)]
    plan = S.pair_statistics(spark.createDataFrame(data, PREFS))._jdf.queryExecution().toString()
    assert "hashpartitioning(bucket" in plan and "hashpartitioning(i" not in plan
    frame = spark.createDataFrame([(i, i + 1, 1, 1.0, 1.0) for i in range(40_000)], "i long, j long, both long, sx double, sy double")
    schema = Q.to_arrow_schema(frame.schema)
    packed = frame.coalesce(1).mapInArrow(lambda b: Q._packed(b, schema, ["i", "j"], [], 16), Q._ROW)
    assert packed.agg(F.sum(F.length("packed"))).first()[0] < 40_000 * 12


def test_log_likelihood_by_hand(spark):
    # users 1..4; item 1: {1,2,3}, item 2: {1,2}, item 3: {4}
    data = [(1, 1, 1.0), (2, 1, 1.0), (3, 1, 1.0), (1, 2, 1.0), (2, 2, 1.0), (4, 3, 1.0)]
    sims = S.item_similarity(spark.createDataFrame(data, PREFS)).collect()
    assert [(r.item_id, r.similar_item_id) for r in sims] == [(1, 2)]
    assert sims[0].similarity == pytest.approx(1 - 1 / (1 + entropy_llr(2, 1, 0, 1)))


@pytest.mark.parametrize("chunk_items", [512, 5])
def test_log_likelihood_in_range(spark, chunk_items):
    data = sample(3)
    users = len({u for u, _, _ in data})
    got = {(r.item_id, r.similar_item_id): r.similarity for r in S.item_similarity(spark.createDataFrame(data, PREFS), chunk_items=chunk_items).collect()}
    for i, j, x, _, ri, rj in brute(data):
        k11 = len(x)
        llr = max(0.0, entropy_llr(k11, len(ri) - k11, len(rj) - k11, users - len(ri) - len(rj) + k11))
        assert got[i, j] == pytest.approx(1 - 1 / (1 + llr), abs=1e-9)
        assert 0 <= got[i, j] < 1


def test_other_measures(spark):
    data = sample(4)
    df = spark.createDataFrame(data, PREFS)

    def pearson(x, y):
        n = len(x)
        mx, my = sum(x) / n, sum(y) / n
        sx, sy = sum((a - mx) ** 2 for a in x), sum((b - my) ** 2 for b in y)
        if sx < 1e-12 or sy < 1e-12:
            return None
        return sum((a - mx) * (b - my) for a, b in zip(x, y)) / math.sqrt(sx * sy)

    want = {m: {} for m in ("tanimoto", "cityblock", "cosine", "euclidean", "pearson")}
    for i, j, x, y, ri, rj in brute(data):
        n, a, b = len(x), len(ri), len(rj)
        want["tanimoto"][i, j] = n / (a + b - n)
        want["cityblock"][i, j] = 1 / (1 + a + b - 2 * n)
        norms = sum(v * v for v in ri.values()) * sum(v * v for v in rj.values())
        want["cosine"][i, j] = sum(p * q for p, q in zip(x, y)) / math.sqrt(norms)
        want["euclidean"][i, j] = 1 / (1 + math.sqrt(sum((p - q) ** 2 for p, q in zip(x, y))))
        if pearson(x, y) is not None:
            want["pearson"][i, j] = pearson(x, y)
    for measure, values in want.items():
        got = {(r.item_id, r.similar_item_id): r.similarity for r in S.item_similarity(df, measure).collect()}
        assert got == pytest.approx(values)


def test_registered_measure(spark):
    register_measure("shared", lambda: F.col("both").cast("double"))
    try:
        got = S.item_similarity(spark.createDataFrame(sample(5), PREFS), "shared")
        assert {(r.item_id, r.similar_item_id): r.similarity for r in got.collect()} == {
            (i, j): len(x) for i, j, x, *_ in brute(sample(5))
        }
    finally:
        del MEASURES["shared"]
    with pytest.raises(ValueError):
        S.item_similarity(spark.createDataFrame(sample(5), PREFS), "shared")


def test_model_is_symmetric_and_ranked(spark):
    model = S.similar_items_model(spark.createDataFrame(sample(6), PREFS), k=4, digits=6)
    by_item = {}
    for r in sorted(model.collect(), key=lambda r: (r.item_id, r.rank)):
        by_item.setdefault(r.item_id, []).append(r)
    for ranked in by_item.values():
        assert [r.rank for r in ranked] == list(range(1, len(ranked) + 1)) and len(ranked) <= 4
        assert all(a.similarity >= b.similarity for a, b in zip(ranked, ranked[1:]))


def test_top_n_ties_and_undefined(spark, rows):
    df = spark.createDataFrame(
        [("k", 3, 1.0), ("k", 1, 1.0), ("k", 2, float("nan")), ("k", 4, 2.0), ("k", 5, None), ("z", 9, 0.5)],
        "key string, item_id long, value double",
    )
    assert rows(top_n(df, "key", 2).select("key", "rank", "item_id")) == [("k", 1, 4), ("k", 2, 1), ("z", 1, 9)]
    assert top_n(df, "key", 100).count() == 4
    with pytest.raises(ValueError):
        top_n(df, "key", 0)


def test_top_n_limits_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 3 AS key", "id AS item_id", "cast(id AS double) AS value")
    plan = top_n(df, "key", 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_itembased_estimates(spark):
    prefs = spark.createDataFrame([(1, 1, 4.0), (1, 2, 2.0), (2, 3, 5.0)], PREFS)
    sims = spark.createDataFrame(
        [(1, 3, 0.5), (2, 3, 0.25), (1, 4, 1.0), (3, 1, 0.5), (1, 2, 0.9)],
        "item_id long, similar_item_id long, similarity double",
    )
    got = {(r.user_id, r.item_id): r.value for r in I.recommend_itembased(None, prefs, sims).collect()}
    assert got == {(1, 3): pytest.approx((0.5 * 4 + 0.25 * 2) / 0.75), (1, 4): 4.0, (2, 1): 5.0}
    cands = spark.createDataFrame([("l", 4)], "label string, item_id long")
    assert [r.item_id for r in I.recommend_itembased(None, prefs, sims, cands).collect()] == [4]
    both = I.recommend_itembased(None, prefs, sims, min_neighbours=2).collect()
    assert [(r.user_id, r.item_id) for r in both] == [(1, 3)]
    only = I.recommend_itembased(spark.createDataFrame([(2,)], "user_id long"), prefs, sims).collect()
    assert [r.user_id for r in only] == [2]
    turned = I.recommend_itembased(None, prefs, sims, rescore=lambda item, value: -value).collect()
    assert [r.item_id for r in sorted(turned, key=lambda r: r.rank) if r.user_id == 1] == [3, 4]


def test_items_for_items(spark):
    sims = spark.createDataFrame(
        [(1, 3, 0.5), (2, 3, 0.3), (1, 4, 0.35), (1, 2, 0.9), (2, 1, 0.9)],
        "item_id long, similar_item_id long, similarity double",
    )
    sets = spark.createDataFrame([(7, 1), (7, 2), (8, 99)], "request_id long, item_id long")
    got = I.recommend_items_for_items(sets, sims).collect()
    assert [(r.request_id, r.rank, r.item_id, round(r.value, 6)) for r in sorted(got, key=lambda r: r.rank)] == [
        (7, 1, 3, 0.4),
        (7, 2, 4, 0.35),
    ]


@pytest.mark.parametrize("heavy_history,list_length", [(4096, 256), (3, 2), (1, 1)])
def test_recommendations_by_brute_force(spark, monkeypatch, heavy_history, list_length):
    """Splitting histories and neighbour lists changes nothing."""
    monkeypatch.setattr(I, "LIST_LENGTH", list_length)
    data = sample(8, users=12, items=20)
    prefs = spark.createDataFrame(data, PREFS)
    sims = [(r.item_id, r.similar_item_id, r.similarity) for r in S.similar_items_model(prefs, k=6).collect()]
    table = spark.createDataFrame(sims, "item_id long, similar_item_id long, similarity double")
    history = {}
    for u, i, p in data:
        history.setdefault(u, {})[i] = p
    near = {}
    for i, j, s in sims:
        near.setdefault(i, {})[j] = s
    votes = {}
    for u, mine in history.items():
        for i, p in mine.items():
            for j, s in near.get(i, {}).items():
                if j not in mine:
                    votes.setdefault((u, j), []).append((s, p))
    got = I.recommend_itembased(None, prefs, table, how_many=100, heavy_history=heavy_history)
    assert {(r.user_id, r.item_id): round(r.value, 9) for r in got.collect()} == {
        k: round(sum(s * p for s, p in v) / sum(s for s, _ in v), 9) for k, v in votes.items()
    }
    reached = I.similar_candidates(None, prefs, table, heavy_history)
    assert sorted(map(tuple, reached.collect())) == sorted(votes)
    sets = prefs.select(F.col("user_id").alias("request_id"), "item_id")
    means = I.recommend_items_for_items(sets, table, how_many=100, heavy_history=heavy_history)
    assert {(r.request_id, r.item_id): round(r.value, 9) for r in means.collect()} == {
        k: round(sum(s for s, _ in v) / len(v), 9) for k, v in votes.items()
    }


def test_neighbours_travel_as_arrays_of_ids(spark, rows):
    """Users' lists are shuffled as ids alone; a neighbour without similarity counts as owned, null ids are ids."""
    prefs = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, 3), (3, None), (4, 9)], "user_id long, item_id long")
    sims = spark.createDataFrame(
        [(1, 2, 0.5), (1, 5, 0.5), (2, 5, 0.1), (2, 6, None), (3, None, 0.3), (3, 4, float("nan"))], "item_id long, similar_item_id long, similarity double"
    )
    for heavy in (4096, 1):
        found = I.similar_candidates(None, prefs, sims, heavy)
        assert rows(found) == sorted([(1, 5), (2, 4), (2, None)], key=repr)
    assert "array_except" in found._jdf.queryExecution().toString()


def test_sums_of_single_ratings_cost_little(spark, rows):
    """Products are told from the ratings they are made of; nulls, labels and odd numbers come back as they were."""
    data = [(i % 997, i // 997 + 1000, 1, float(i % 50) * (i % 7), float(i % 50), float(i % 7), float(i % 50) ** 2, float(i % 7) ** 2) for i in range(60_000)]
    schema = "i long, j long, both long, sxy double, sx double, sy double, sxx double, syy double"
    packed = Q.packed_sums(spark.createDataFrame(data, schema).coalesce(1), ["i", "j"], buckets=256)
    assert packed.rows.agg(F.sum(F.length("packed"))).first()[0] < len(data) * 8
    assert sorted(map(tuple, packed.materialize("sums").sums().collect())) == sorted(data)
    odd = [("a", 1, 2, 0, 1e-300, 3.5, None, 0.0, float("inf")), ("b", -5, 2, -1, -2.0, 1e300, 2.5, 1e300, 0.1), (None, None, 2, 2, None, 0.0, -0.0, 1.0, 2.0)]
    df = spark.createDataFrame(odd * 3, "label string, " + schema)
    want = df.groupBy("label", "i", "j").agg(*(F.sum(c).alias(c) for c in df.columns[3:]))
    assert rows(Q.pair_sums(df, ["label", "i", "j"])) == rows(want)


def test_pairs_are_made_in_parts(spark, monkeypatch):
    """Null ratings count and are left out of sums; an item rated twice is no pair with itself."""
    monkeypatch.setattr(Q, "MADE", 3)
    data = [(u, i, None if (u + i) % 5 == 0 else float(u + i)) for u in range(4) for i in range(6)] + [(0, 3, 2.0), (0, None, 1.0)]
    df = spark.createDataFrame(data, PREFS)
    a, b = (df.select("user_id", F.col("item_id").alias(n), F.col("preference").cast("double").alias(v)) for n, v in (("i", "x"), ("j", "y")))
    x, y = F.col("x"), F.col("y")
    want = a.join(b, "user_id").where("i < j").groupBy("i", "j").agg(
        F.count("*").alias("both"), F.sum(x * y).alias("sxy"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"))
    for chunk_items in (512, 4):
        got = S.pair_statistics(df.where("item_id is not null") if chunk_items < 7 else df, chunk_items)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("held_votes", [1, 40, 1_000_000])
def test_votes_are_summed_without_rows(spark, monkeypatch, held_votes):
    """Users come whole whatever a task holds; a vote without a similarity bars its item, one without a rating counts below alone."""
    monkeypatch.setattr(I, "HELD_VOTES", held_votes)
    rng = random.Random(7)
    prefs = [(u, i, None if rng.random() < 0.1 else float(rng.randint(1, 5))) for u in (*range(15), None) for i in range(12) if rng.random() < 0.4]
    sims = [(i, j, None if rng.random() < 0.05 else rng.choice((0.0, 0.25, 0.5))) for i in range(12) for j in range(14) if i != j and rng.random() < 0.5]
    got = I.recommend_itembased(
        None, spark.createDataFrame(prefs, PREFS), spark.createDataFrame(sims, "item_id long, similar_item_id long, similarity double"), how_many=3, digits=6
    )
    assert "inline(" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = []
    for user in (*range(15), None):
        own = {i: r for u, i, r in prefs if u == user}
        scored = []
        for j in {j for i, j, _ in sims if i in own} - own.keys():
            votes = [(s, own[i]) for i, k, s in sims if k == j and i in own]
            known = [(s, r) for s, r in votes if s is not None]
            rated = [s * r for s, r in known if r is not None]
            if len(known) == len(votes) and rated and sum(s for s, _ in known):
                scored.append((-round(sum(rated) / sum(s for s, _ in known), 6), j))
        want += [(user, rank, j, -v) for rank, (v, j) in enumerate(sorted(scored)[:3], 1)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
