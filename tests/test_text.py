from pyspark.sql import functions as F

from prefspark.functions.text import has_min_words, remove_stopwords, strip_bad_chars
from prefspark.operators import text as X


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("o")).first().o


def test_bad_characters(spark):
    assert one(spark, "ÀÈhere are som; b3d ch,,arcters", strip_bad_chars(F.col("t"))) == "ÀÈhere are som bd charcters"
    assert one(spark, "ça ê\tß\n1", strip_bad_chars(F.col("t"))) == "a \tß\n"


def test_minimum_words(spark):
    assert one(spark, "Hello my name is", has_min_words(F.col("t"), 3))
    assert not one(spark, "Hello", has_min_words(F.col("t"), 3))
    assert one(spark, "  a \t b\n\nc ", has_min_words(F.col("t"), 3))


def test_stop_words(spark):
    assert one(spark, "Das ist ein Test", remove_stopwords(F.col("t"))) == "test"
    assert one(spark, " X  y\tZ ", remove_stopwords(F.col("t"), ["y"])) == "x z"
    assert one(spark, "a b", remove_stopwords(F.col("t"), ["a", "b"])) == ""
    assert one(spark, "a b", remove_stopwords(F.col("t"), [])) == "a b"


def test_variants_follow_their_context(spark):
    articles = spark.createDataFrame(
        [(1, "l", "Das Haus; 3", "Ort", None), (2, "l", "ein Baum", None, "Zeit")],
        "item_id long, label string, text string, sce_al1 string, sce_al2 string",
    )
    got = {(r.item_id, r.training_set): r.text for r in X.article_variants(articles).collect()}
    assert got == {
        (1, "pure"): "Das Haus; 3",
        (1, "stopwords"): "haus",
        (1, "SCEAL1"): "Das Haus; 3 Ort",
        (1, "processedSCEAL1"): "haus ort",
        (2, "pure"): "ein Baum",
        (2, "stopwords"): "baum",
        (2, "SCEAL2"): "ein Baum Zeit",
        (2, "processedSCEAL2"): "baum zeit",
    }


def test_counts_weights_and_vocabulary(spark, rows):
    docs = spark.createDataFrame([(1, "a a b"), (2, "a c")], "item_id long, text string")
    tf = X.term_frequencies(docs)
    assert rows(tf) == [(1, "a", 2), (1, "b", 1), (2, "a", 1), (2, "c", 1)]
    weights = {(r.item_id, r.term): r.weight for r in X.tfidf(tf, digits=6).collect()}
    assert weights[(1, "a")] == 0.0 and weights[(1, "b")] == 0.405465
    assert rows(X.align_to_vocabulary(tf, spark.createDataFrame([("c",)], "term string"))) == [(2, "c", 1)]
    assert X.prune_max_df_sigma(tf, -1).count() == 4
    # document counts 2, 1, 1: standard deviation 0.4714, so sigma 2.5 cuts above 1.18
    assert {r.term for r in X.prune_max_df_sigma(tf, 2.5).collect()} == {"b", "c"}
