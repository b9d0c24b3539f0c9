import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from prefspark.operators import clustering as K, factors as M, preferences as P, splits as S, text as X, topics as L, tuning as T
from prefspark.schemas import CENTROIDS
from prefspark.sources import sinks

PREFS = "user_id long, item_id long, preference float"


def block_prefs(spark, users=24, items=16):
    """Two groups of users who like two groups of items."""
    data = [
        (u, i, 5.0 if u % 2 == i % 2 else 1.0) for u in range(users) for i in range(items) if (u * 5 + i * 3) % 4
    ]
    return spark.createDataFrame(data, PREFS)


# -- splits ------------------------------------------------------------------------------


@pytest.mark.parametrize("n,sizes", [(10, [3, 3, 3]), (1, [0, 0, 0]), (1000, [300, 300, 300])])
def test_folds_are_exact_and_disjoint(spark, n, sizes):
    prefs = spark.createDataFrame([(a, a * 3, 1.0) for a in range(n)], PREFS)
    order = sorted(range(n), key=lambda a: hashlib.md5(f"20260:{a}:{a * 3}".encode()).hexdigest())
    bin_size = n * 3 // 10
    tested = set()
    for fold in range(3):
        train, test = S.kfold_split(prefs, fold)
        mine = {r.user_id for r in test.collect()}
        assert len(mine) == sizes[fold]
        assert mine == set(order[bin_size * fold : bin_size * (fold + 1)])
        assert not mine & tested
        tested |= mine
        assert {r.user_id for r in train.collect()} == set(range(n)) - mine
    with pytest.raises(ValueError):
        S.kfold_split(prefs, 3)


def test_split_does_not_move_the_rows(spark):
    prefs = spark.createDataFrame([(a, a, 1.0) for a in range(50)], PREFS)
    plan = S.assign_folds(prefs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan.split("scalar-subquery")[0]


# -- factors --------------------------------------------------------------------------------


def test_dense_index(spark):
    df = spark.createDataFrame([(i % 300 - 10**12,) for i in range(1000)], "id long")
    got = M.dense_index(df, ["id"], "idx").collect()
    assert sorted(r.idx for r in got) == list(range(300))
    assert len({r.id for r in got}) == 300


def test_explicit_als_beats_the_mean(spark):
    prefs = block_prefs(spark)
    users, items = M.train_als_explicit(prefs, rank=3, reg=0.01, iters=8)
    model = T.absolute_error(prefs, users, items).first()
    mean = prefs.agg(F.avg("preference")).first()[0]
    naive = prefs.select(F.avg(F.abs(F.col("preference") - mean))).first()[0]
    assert model.pairs == prefs.count() and model.mean_error < naive / 2


def test_implicit_als_separates_the_groups(spark):
    prefs = block_prefs(spark).where("preference = 5")
    users, items = M.train_als_implicit(prefs, rank=3, reg=0.05, iters=8)
    u = {r.id: np.array(r.features) for r in users.collect()}
    v = {r.id: np.array(r.features) for r in items.collect()}
    same = np.mean([u[a] @ v[b] for a in u for b in v if a % 2 == b % 2])
    other = np.mean([u[a] @ v[b] for a in u for b in v if a % 2 != b % 2])
    assert same > other + 0.5


def test_fits_share_written_ratings(spark, rows, monkeypatch):
    """The solver reads numbered ratings from files, and fits of one table number it once."""
    prefs, read = block_prefs(spark), []
    fit = M.fit_numbered
    monkeypatch.setattr(M, "fit_numbered", lambda ratings, *a: read.append(ratings.inputFiles()) or fit(ratings, *a))
    alone = M.train_als_explicit(prefs, rank=2, iters=2)
    numbered = M.number_ratings(prefs)
    monkeypatch.setattr(M, "number_ratings", None)
    shared = M.train_als_explicit(prefs, rank=2, iters=2, numbered=numbered)
    M.train_als_implicit(prefs, rank=2, iters=2, numbered=numbered)
    assert all(files and all("ratings-" in f for f in files) for files in read)
    assert read[1] == read[2] and numbered[2].count() == prefs.count()
    for a, b in zip(alone, shared):
        assert [r[0] for r in rows(a)] == [r[0] for r in rows(b)]
        assert np.allclose([r[1] for r in rows(a)], [r[1] for r in rows(b)], atol=1e-4)


def test_training_gate_and_label_models(spark):
    prefs = block_prefs(spark)
    cands = spark.createDataFrame(
        [("all", i) for i in range(16)] + [("even", i) for i in range(0, 16, 2)] + [("few", i) for i in range(4)],
        "label string, item_id long",
    )
    assert sorted(r.label for r in M.training_gate(prefs, cands).collect()) == ["all", "even"]
    for implicit in (False, True):
        users, items = M.train_all_labels(prefs, cands, rank=2, iters=3, implicit=implicit)
        sizes = {r.label: r["count"] for r in items.groupBy("label").count().collect()}
        assert sizes == {"all": 16, "even": 8}
        assert users.where("label = 'even'").count() == 24
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(len(batch))
            yield batch

    # The ratings are read once for the gate, the numbering and the fit.
    M.train_all_labels(prefs.mapInPandas(counted, prefs.schema), cands, rank=2, iters=1, implicit=False)
    assert reads.value == prefs.count()
    none = M.train_all_labels(prefs, cands.where("label = 'few'"), implicit=True)
    assert none[0].count() == none[1].count() == 0


def test_explicit_models_of_labels_do_not_touch(spark):
    """Errors of a label trained together with others are those of training it alone, up to the start."""
    prefs = block_prefs(spark)
    cands = spark.createDataFrame(
        [("low", i) for i in range(8)] + [("high", i) for i in range(8, 16)], "label string, item_id long"
    )
    users, items = M.train_all_labels(prefs, cands, rank=2, reg=0.05, iters=15, implicit=False)
    low = prefs.where("item_id < 8")
    together = T.absolute_error(
        low, users.where("label = 'low'").drop("label"), items.where("label = 'low'").drop("label")
    ).first()
    alone = T.absolute_error(low, *M.train_als_explicit(low, rank=2, reg=0.05, iters=15)).first()
    assert together.mean_error == pytest.approx(alone.mean_error, abs=0.05)


# -- tuning -----------------------------------------------------------------------------------


def test_absolute_error_by_hand(spark):
    vec = "id long, features array<double>"
    users = spark.createDataFrame([(1, [1.0, 2.0])], vec)
    items = spark.createDataFrame([(5, [1.0, 1.0]), (6, [0.5, 0.0])], vec)
    test = spark.createDataFrame([(1, 5, 4.0), (1, 6, 0.0), (1, 7, 9.0), (2, 5, 9.0)], PREFS)
    got = T.absolute_error(test, users, items).first()
    assert (got.error, got.pairs, got.mean_error) == (1.5, 2, 0.75)


def test_grid_search_rows(spark, tmp_path):
    prefs = block_prefs(spark)
    cands = spark.createDataFrame([("all", i) for i in range(16)], "label string, item_id long")
    results = T.grid_search_als(prefs, cands, "all", [2], [0.05, 0.5], [40.0], [2], parallelism=2)
    kinds = {(r["lambda"], r.iterations): r.n for r in results.groupBy("lambda", "iterations").agg(F.count("*").alias("n")).collect()}
    assert kinds == {(x, i): (1 if i < 0 else 3) for x in (0.05, 0.5) for i in (-1, 0, 1)}
    for row in results.where("iterations = -1").collect():
        last = results.where((F.col("iterations") == 1) & (F.col("lambda") == row["lambda"]))
        assert row.error == pytest.approx(last.agg(F.sum("error")).first()[0])
    path = str(tmp_path / "tuning")
    assert sinks.read_tuning_results(spark, path).count() == 0
    sinks.append_tuning_results(results, path)
    sinks.append_tuning_results(results, path)
    assert sinks.read_tuning_results(spark, path).count() == 2 * results.count()
    best = T.best_params(results).collect()
    assert len(best) == 1
    assert best[0].error == results.where("iterations = -1").agg(F.min("error")).first()[0]


def test_halving_keeps_the_better_half(spark):
    """Every rung keeps the better half of the one before; who gets to the last has the error the full grid gives it."""
    prefs = block_prefs(spark)
    cands = [("all", i) for i in range(16)] + [("half", i) for i in range(0, 16, 2)]
    cands = spark.createDataFrame(cands, "label string, item_id long")
    grid = {"features": [2], "lambdas": [0.01, 0.1, 1.0, 30.0], "alphas": [40.0]}
    for label in ("all", "half"):
        found = T.halving_search_als(prefs, cands, label, **grid, rungs=[1, 3], parallelism=3)
        rungs = {}
        for r in found.collect():
            rungs.setdefault(r.iterations, {})[r["lambda"]] = r.error
            assert r.label == label and r.spent == 3 * r.iterations
        assert sorted(rungs) == [1, 3] and len(rungs[1]) == 4 and len(rungs[3]) == 2
        assert set(rungs[3]) == set(sorted(rungs[1], key=lambda x: (rungs[1][x], x))[:2])
        full = T.grid_search_als(prefs, cands, label, **grid, iterations=[3], parallelism=3, curve=False)
        assert full.where("iterations <> -1").count() == 12
        errors = {r["lambda"]: r.error for r in full.where("iterations = -1").collect()}
        assert all(rungs[3][x] == pytest.approx(errors[x]) for x in rungs[3])
        mine = T.best_of_halving(found).first()
        assert mine["lambda"] == min(rungs[3], key=lambda x: (rungs[3][x], x)) and mine.error == rungs[3][mine["lambda"]]
        # The point that cannot win is gone early, and the winner is no worse than the grid's median.
        assert 30.0 not in rungs[3] and mine.error <= sorted(errors.values())[1]
        assert mine.spent == 4 * 3 + 2 * 9 < 4 * 9
    with pytest.raises(ValueError):
        T.halving_search_als(prefs, cands, "all", **grid, rungs=[3, 1])


def test_folds_are_numbered_once_for_all_fits(spark, monkeypatch):
    """Ids are numbered once per fold, whatever the number of fits, and errors are those of a fit on the plain tables."""
    numbered, plain = [], M.indexes
    monkeypatch.setattr(T, "indexes", lambda *a: numbered.append(1) or plain(*a))
    prefs, cands = block_prefs(spark), spark.createDataFrame([("all", i) for i in range(16)], "label string, item_id long")
    found = T.grid_search_als(prefs, cands, "all", [2], [0.05, 0.5], [40.0], [1], parallelism=2, curve=False)
    assert len(numbered) == S.FOLDS
    for r in found.where("iterations = -1").collect():
        alone = [T.absolute_error(test, *M.train_als_implicit(train, 2, r["lambda"], 1)).first().error for train, test in (S.kfold_split(prefs, f) for f in range(S.FOLDS))]
        assert r.error == pytest.approx(sum(alone), rel=1e-3)


# -- topics ------------------------------------------------------------------------------------


def test_topics_separate_two_vocabularies(spark):
    texts = [
        (d, " ".join((["sun", "moon", "star"] if d % 2 else ["bread", "milk", "salt"]) * 6 + [f"w{d}"])) for d in range(20)
    ]
    docs = spark.createDataFrame(texts, "item_id long, text string")
    def separates(model):
        topics = {r.item_id: np.array(r.topics) for r in L.document_topics(model, docs).collect()}
        assert all(abs(t.sum() - 1) < 1e-6 for t in topics.values())
        groups = [{int(topics[d].argmax()) for d in range(start, 20, 2)} for start in (0, 1)]
        return topics, len(groups[0]) == len(groups[1]) == 1 and groups[0] != groups[1]

    # The solver starts at random and may end in a poor optimum; it has four starts.
    for seed in range(4):
        model = L.train_topics(docs, k=2, iters=30, max_df_sigma=-1, subsampling=1.0, seed=seed)
        topics, separated = separates(model)
        if separated:
            break
    assert separated
    terms = sinks.topic_terms_dump(model, 3)
    assert [r["rank"] for r in terms.where("topic = 0").orderBy("rank").collect()] == [1, 2, 3]
    tops = {t: {r.term for r in terms.where(F.col("topic") == t).collect()} for t in (0, 1)}
    assert sorted(map(sorted, tops.values())) == [["bread", "milk", "salt"], ["moon", "star", "sun"]]
    dump = sinks.doc_topics_dump(model, docs, 1)
    assert dump.count() == 20 and all(r.topic == topics[r.item_id].argmax() for r in dump.collect())
    known = docs.where("item_id < 15")
    new = L.infer_topics(model, docs.unionByName(spark.createDataFrame([(99, "unheard of")], docs.schema)), known)
    assert sorted(r.item_id for r in new.collect()) == [15, 16, 17, 18, 19, 99]
    weighted = L.train_topics(docs, k=2, iters=3, max_df_sigma=-1, weighting="tfidf", subsampling=1.0)
    assert L.document_topics(weighted, docs).count() == 20
    with pytest.raises(ValueError):
        L.train_topics(docs, weighting="none")


def test_topics_are_fitted_in_even_tasks_on_texts_read_once(spark):
    """A fit's rounds have four tasks a core, however few the files; the training's documents need no second reading."""
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(len(batch))
            yield batch

    rows = [(i % 30, f"alpha w{i % 7} W{i % 7} v{i}") for i in range(40)] + [(50, None), (None, "alpha w1")]
    table = spark.createDataFrame(rows, "item_id long, text string").coalesce(1)
    model = L.train_topics(table.mapInPandas(counted, table.schema), k=2, iters=2, max_df_sigma=2.0, weighting="tfidf")
    alone = sorted(((r.item_id, *np.round(r.topics, 9)) for r in L.document_topics(model, table).collect()), key=repr)
    kept = sorted(((r.item_id, *np.round(r.topics, 9)) for r in L.document_topics(model).collect()), key=repr)
    assert kept == alone and len(kept) == 32
    assert reads.value == len(rows)
    assert L.evenly(model.vectors, 1).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    assert L.evenly(model.vectors) is model.vectors  # too few to deal
    model.vectors = None
    with pytest.raises(ValueError):
        L.document_topics(model)


def test_slots_of_the_hashed_space(spark):
    """Collisions are as rare as the width says, and terms that share a slot share its weight by their documents."""
    words = spark.range(20_000).select(F.concat(F.lit("term"), "id").alias("term"))
    used = words.select(L.term_slot(F.col("term"), 18).alias("slot")).distinct().count()
    # Throwing n terms into m slots fills m (1 - (1 - 1/m)^n) of them.
    m = 1 << 18
    assert abs(used - m * (1 - (1 - 1 / m) ** 20_000)) < 150 and used > 0.95 * 20_000
    docs = spark.createDataFrame([(i, "one two three") for i in range(6)] + [(9, "one"), (10, None), (11, "")], "item_id long, text string")
    narrow = L.train_topics(docs, k=2, iters=2, max_df_sigma=-1, bits=0)
    assert {tuple(r) for r in narrow.terms.collect()} == {("one", 0, 7), ("two", 0, 6), ("three", 0, 6)}
    terms = L.topic_terms(narrow, 5).where("topic = 0").orderBy("rank").collect()
    assert [r.term for r in terms] == ["one", "three", "two"]
    assert [r.weight for r in terms] == pytest.approx([7 / 19, 6 / 19, 6 / 19])
    topics = L.document_topics(narrow, docs).collect()
    assert sorted(r.item_id for r in topics) == [*range(6), 9, 10, 11]
    assert {r.item_id for r in topics if sum(r.topics) == 0} == {10, 11}
    # Frequent terms leave the dictionary, and texts with nothing else keep their row.
    pruned = L.train_topics(spark.createDataFrame([(i, f"all w{i % 4}") for i in range(8)] + [(8, "all")], "item_id long, text string"), k=2, iters=2, max_df_sigma=1.0)
    assert {r.term for r in pruned.terms.collect()} == {f"w{i}" for i in range(4)}
    assert L.document_topics(pruned, spark.createDataFrame([(1, "all"), (2, "w1 all new")], "item_id long, text string")).count() == 2


# -- clusters ------------------------------------------------------------------------------------


def group_vectors(spark):
    """30 items in three groups, each rated by its own ten users."""
    data = [(i, 100 * (i % 3) + u, 1.0) for i in range(30) for u in range(10) if (i + u) % 7]
    return spark.createDataFrame(data, "item_id long, dim long, value double")


def dense(vectors):
    out = {}
    for r in vectors.collect():
        out.setdefault(r[0], {})[r.dim] = r.value
    return out


def test_streaming_kmeans_finds_the_groups(spark):
    vectors = group_vectors(spark)
    centroids, assignment = K.fit_streaming_kmeans(vectors, k=6, cutoff=8.0)
    again, _ = K.fit_streaming_kmeans(vectors, k=6, cutoff=8.0)
    assert sorted(map(tuple, centroids.collect())) == sorted(map(tuple, again.collect()))
    weights = {r.centroid_id: r.weight for r in centroids.select("centroid_id", "weight").distinct().collect()}
    assert sum(weights.values()) == 30 and len(weights) <= 6
    by_cluster = {}
    for r in assignment.collect():
        by_cluster.setdefault(r.centroid_id, set()).add(r.item_id % 3)
    assert all(len(g) == 1 for g in by_cluster.values())
    assert centroids.columns == CENTROIDS.fieldNames()


def test_sketches_hold_only_slots_in_use(spark):
    """Sums by hashed dimension, a null counts nothing; as a matrix every other slot is 0."""
    data = [(1, 5, 1.0), (1, 6, 2.0), (1, 7, None), (2, 5, 0.5), (2, 900, 3.0), (3, 8, None)]
    vectors = spark.createDataFrame(data, "item_id long, dim long, value double")
    slot = {r.dim: r.b for r in vectors.select("dim", F.pmod(F.xxhash64("dim"), F.lit(3)).alias("b")).collect()}
    got = K.sketch_vectors(vectors, 3).toPandas().sort_values("item_id")
    expected = np.zeros((3, 3))
    for item, dim, value in data:
        expected[item - 1, slot[dim]] += value or 0.0
    assert (K._dense(got, 3) == expected).all()
    assert [len(x) for x in got["slots"]] == [len({slot[d] for i, d, _ in data if i == item}) for item in (1, 2, 3)]


def test_kmeans_query_writes_its_vectors_once(spark, tmp_path, monkeypatch):
    """The passes read written vectors, not the tables they come from."""
    spark.range(3).selectExpr("id AS o_orderkey", "id AS o_custkey", "timestamp '2024-01-01' AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    lines = spark.range(150).selectExpr("id % 3 AS l_orderkey", "id DIV 3 AS l_partkey", "1.0D AS l_quantity")
    lines.where("l_orderkey > 0 OR l_partkey < 40").write.parquet(f"{tmp_path}/lineitem.parquet")
    read = []
    monkeypatch.setattr(K, "fit_streaming_kmeans", lambda vectors, **k: read.append(vectors) or (vectors, None))
    got = entry.queries()["fit_streaming_kmeans"](spark, str(tmp_path))
    # User 0 has no more than 40 items.
    assert got.count() == 100 and {r.dim for r in got.collect()} == {1, 2}
    assert read and not any("lineitem" in f or "orders" in f for f in read[0].inputFiles())


def test_clusters_are_a_function_of_the_vectors(spark):
    """Session settings and the order of rows change nothing, every item is at its nearest centroid, k are found."""
    data = [(i, 50 * (i % 8) + u, 1.0) for i in range(160) for u in range(12) if (i * 7 + u) % 5]
    vectors = spark.createDataFrame(data, "item_id long, dim long, value double")
    before, models = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for parts, df in ((4, vectors), (8, vectors.repartition(3).sort(F.desc("dim")))):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            centroids, assignment = K.fit_streaming_kmeans(df, k=8, cutoff=5.0, rows_per_part=50)
            models.append((sorted((r[0], r[1], r[2], round(r[3], 9)) for r in centroids.collect()), sorted(map(tuple, assignment.collect()))))
            near = {r.item_id: r.centroid_id for r in K.nearest_centroid(df, centroids).collect()}
            assert near == dict(models[-1][1])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert models[0] == models[1]
    assert len({c for _, c in models[0][1]}) == 8 and sum({r[0]: r[1] for r in models[0][0]}.values()) == 160


def test_nearest_centroid_is_the_nearest(spark):
    vectors = group_vectors(spark)
    centroids = spark.createDataFrame(
        [(0, 4.0, 1, 0.5), (0, 4.0, 2, 1.0), (1, 9.0, 101, 0.9), (1, 9.0, 5, 0.1), (2, 1.0, 900, 0.05), (3, 2.0, 203, 1.0), (3, 2.0, 204, 1.0)],
        "centroid_id long, weight double, dim long, value double",
    )
    c, x = {}, dense(vectors)
    for r in centroids.collect():
        c.setdefault(r.centroid_id, {})[r.dim] = r.value
    got = {r.item_id: (r.centroid_id, r.distance) for r in K.nearest_centroid(vectors, centroids).collect()}
    for item, v in x.items():
        distances = {n: sum(abs(v.get(d, 0) - w.get(d, 0)) for d in v.keys() | w.keys()) for n, w in c.items()}
        best = min(distances, key=lambda n: (round(distances[n], 9), n))
        assert got[item] == (best, pytest.approx(distances[best]))


def test_cluster_stats_by_hand(spark):
    centroids = spark.createDataFrame(
        [(0, 4.0, 1, 3.0), (0, 4.0, 2, 4.0), (1, 2.0, 1, 1.0), (1, 2.0, 9, 0.0)],
        "centroid_id long, weight double, dim long, value double",
    )
    got = {r.centroid_id: r for r in K.cluster_stats(centroids).collect()}
    assert (got[0].l2_norm, got[0].non_zero, got[0].norm_weight, got[0].volume) == (5.0, 2, 1.0, 2.0)
    assert (got[1].l2_norm, got[1].non_zero, got[1].norm_weight, got[1].volume) == (1.0, 1, 0.5, 0.5)
    assert got[1].mean_volume == 1.25 and got[1].max_weight == 4.0


def test_merging_equals_fitting_the_union(spark):
    vectors = group_vectors(spark)
    member = vectors.select("item_id").distinct().withColumn("centroid_id", F.col("item_id") % 3)
    whole = K.centroids_of(vectors, member)
    first, later = F.col("item_id") < 20, F.col("item_id") >= 20
    old = K.centroids_of(vectors.where(first), member.where(first))
    merged = K.merge_into_centroids(old, vectors.where(later), member.where(later))
    key = lambda df: {(r.centroid_id, r.dim): (r.weight, round(r.value, 9)) for r in df.collect()}
    assert key(merged) == key(whole)


def test_vectors_of_new_items(spark, rows):
    prefs = spark.createDataFrame([(1, 1, 1.0), (1, 2, 1.0), (2, 2, 1.0), (3, 4, 1.0), (1, 3, 1.0)], PREFS)
    assert rows(K.item_user_vectors(prefs, 2)) == [(1, 1, 1.0), (2, 1, 1.0), (3, 1, 1.0)]
    users, known = P.heavy_users(prefs, 2), spark.createDataFrame([(1,), (2,)], "item_id long")
    assert rows(K.new_item_vectors(prefs, users, known)) == [(3, 1, 1.0)]
    cands = spark.createDataFrame([("l", 2)], "label string, item_id long")
    assert rows(K.item_user_vectors(prefs, 0, cands, "l")) == [(2, 1, 1.0), (2, 2, 1.0)]
