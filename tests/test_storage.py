import os

import pytest
from pyspark.errors import PySparkException

from prefspark.plans import session
from prefspark.plans.publish import current, new_version, publish
from prefspark.sources import files, models, sinks
from prefspark.operators.text import article_variants

FAC = "id long, features array<double>"


def lines(tmp_path, name, *content):
    path = tmp_path / name
    path.write_text("\n".join(content) + "\n", encoding="utf-8")
    return str(path)


def test_read_preferences(spark, rows, tmp_path):
    path = lines(tmp_path, "p.csv", "1\t2\t3.5", "9876543210,4,1.0,extra", "-5,6\t2")
    assert rows(files.read_preferences(spark, path)) == [(1, 2, 3.5), (1286608622, 4, 1.0), (5, 6, 2.0)]
    assert rows(files.read_preferences(spark, path, remap=False))[0] == (-5, 6, 2.0)


def test_bad_lines(spark, rows, tmp_path):
    path = lines(tmp_path, "p.csv", "1,2,3.5", "x,2,1", "7,8")
    with pytest.raises(PySparkException):
        files.read_preferences(spark, path).collect()
    good, rejected = files.read_preferences(spark, path, mode="quarantine")
    assert rows(good) == [(1, 2, 3.5)]
    assert rows(rejected.select("value")) == [("7,8",), ("x,2,1",)]
    with pytest.raises(ValueError):
        files.read_preferences(spark, path, mode="skip")


def test_read_candidates_and_stop_words(spark, rows, tmp_path):
    assert rows(files.read_candidates(spark, lines(tmp_path, "c.csv", "news\t1", "sport,2"))) == [("news", 1), ("sport", 2)]
    assert files.read_stop_words(spark, lines(tmp_path, "s.txt", "und ", "der", "", "und")) == ["der", "und"]


def test_read_articles(spark, rows, tmp_path):
    for name, text in (("11", "first\nline"), ("12.txt", "zwei")):
        (tmp_path / name).write_text(text, encoding="utf-8")
    assert rows(files.read_articles(spark, str(tmp_path))) == [(11, "first\nline"), (12, "zwei")]


def test_scan_preferences(spark, rows, tmp_path):
    prefs = spark.createDataFrame([(1, 2, 3.0)], "user_id long, item_id long, preference float")
    prefs.write.parquet(str(tmp_path / "prefs"))
    assert rows(files.scan_preferences(spark, str(tmp_path / "prefs"))) == [(1, 2, 3.0)]


def test_similarities_round_trip(spark, rows, tmp_path):
    sims = spark.createDataFrame([(1, 2, 0.5), (2, 1, 0.25)], "item_id long, similar_item_id long, similarity double")
    models.write_similarities(sims, str(tmp_path / "s"))
    assert rows(models.read_similarities(spark, str(tmp_path / "s"))) == rows(sims)


def test_labelled_similarities_keep_their_labels(spark, rows, tmp_path):
    schema = "item_id long, similar_item_id long, similarity double, label string"
    sims = spark.createDataFrame([(1, 2, 0.5, "a"), (1, 2, 0.25, "b c")], schema)
    models.write_similarities(sims, str(tmp_path / "s"))
    assert rows(models.read_similarities(spark, str(tmp_path / "s"), labelled=True)) == rows(sims)
    root = str(tmp_path / "versions")
    assert models.load_similarities(spark, root) is None
    models.save_similarities(sims.where("label = 'a'"), root)
    models.save_similarities(sims, root)
    assert rows(models.load_similarities(spark, root)) == rows(sims)


def test_factors_are_published_whole(spark, tmp_path):
    root = str(tmp_path / "factors")
    users, items = models.load_factors(spark, root)
    assert users.count() == items.count() == 0 and users.columns == ["id", "features"]
    one, two = (spark.createDataFrame([(n, [float(n)])], FAC) for n in (1, 2))
    models.save_factors(one, one, root)
    # written but never published: not seen
    two.write.parquet(f"{root}/v={new_version()}/items")
    assert [r.id for r in models.load_factors(spark, root)[1].collect()] == [1]
    models.save_factors(two, two, root)
    assert [r.id for r in models.load_factors(spark, root)[0].collect()] == [2]


def test_topic_model_key_guards_late_saves(spark, tmp_path):
    root = str(tmp_path / "topics")
    topics = lambda n: spark.createDataFrame([(n, [1.0])], "item_id long, topics array<double>")
    assert models.load_topic_model(spark, root)[1] is None
    first = models.save_topic_model(topics(1), root)
    assert models.save_topic_model(topics(2), root, expected_key=first) == first
    assert [r.item_id for r in models.load_topic_model(spark, root)[0].collect()] == [2]
    second = models.save_topic_model(topics(3), root)
    assert models.save_topic_model(topics(4), root, expected_key=first) is None
    got, key = models.load_topic_model(spark, root)
    assert [r.item_id for r in got.collect()] == [3] and key == second
    # even a save that passed the check just before the retraining was published is not taken
    publish(spark, root, "late", first, retrained=False)
    assert current(spark, root)[1] == second


def test_variants_are_replaced_per_item(spark, tmp_path):
    path = str(tmp_path / "variants")
    schema = "item_id long, label string, text string"
    old = spark.createDataFrame([(1, "l", "old"), (2, "l", "kept")], schema)
    new = spark.createDataFrame([(1, "l", "new")], schema)
    sinks.write_article_variants(article_variants(old), path, 0)
    sinks.write_article_variants(article_variants(new), path, 1)
    sinks.write_article_variants(article_variants(new), path, 1)
    got = {(r.item_id, r.text) for r in sinks.read_article_variants(spark, path, "pure").collect()}
    assert got == {(1, "new"), (2, "kept")}
    assert any(name.startswith("training_set=") for name in os.listdir(path))


def test_recommendations_as_json(spark):
    recs = spark.createDataFrame(
        [(7, 2, 20, 0.25), (7, 1, 10, 0.5), (8, 1, 5, 1.0)], "request_id long, rank int, item_id long, value double"
    )
    got = {r.request_id: r.recommendations for r in sinks.recommendations_json(recs).collect()}
    assert got == {7: '[{"itemID":10,"value":0.5},{"itemID":20,"value":0.25}]', 8: '[{"itemID":5,"value":1.0}]'}


def test_shared_folder_comes_from_the_session(spark):
    assert session.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    df = session.materialize(spark.range(5), "five")
    assert df.count() == 5 and all(session.shared_dir(spark) in f for f in df.inputFiles())
