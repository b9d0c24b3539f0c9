"""Article texts: variants, term counts, weights, vocabulary."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from prefspark.functions.columns import rounded
from prefspark.functions.text import DEFAULT_STOP_WORDS, clean, has_min_words, words


def spread(docs: DataFrame, partitions: int | None) -> DataFrame:
    """`docs` dealt by item into `partitions` tasks: for tables of few large files, whose texts few tasks would read."""
    return docs if partitions is None else docs.repartition(partitions, "item_id")


def min_words(articles: DataFrame, n: int = 3, text: str = "text") -> DataFrame:
    """Articles whose raw text has at least n words."""
    return articles.where(has_min_words(F.col(text), n))


def article_variants(
    articles: DataFrame, stop_words: str | Iterable[str] = DEFAULT_STOP_WORDS, partitions: int | None = None
) -> DataFrame:
    """Up to six texts per article, by training set, made in `partitions` tasks where that is given.

    `pure` is the text as it came and `stopwords` its cleaned form. SCEAL1/2 add the article's
    first/second context (columns sce_al1, sce_al2), and processedSCEAL1/2 are those cleaned; they
    exist where the context does.
    """
    stop = stop_words if isinstance(stop_words, str) else list(stop_words)
    text = F.col("text")
    variants = [("pure", text), ("stopwords", clean(text, stop))]
    for n in (1, 2):
        if f"sce_al{n}" in articles.columns:
            joined = F.concat(text, F.lit(" "), F.col(f"sce_al{n}"))
            variants += [(f"SCEAL{n}", joined), (f"processedSCEAL{n}", clean(joined, stop))]
    named = F.array(*(F.struct(F.lit(name).alias("training_set"), t.alias("text")) for name, t in variants))
    return spread(articles, partitions).select("item_id", "label", F.inline(named)).where(F.col("text").isNotNull())


def term_frequencies(docs: DataFrame, text: str = "text", partitions: int | None = None) -> DataFrame:
    """(item_id, term, tf). Counted inside each task first, so a frequent term is no hot spot.

    With `partitions` texts are dealt by item into so many tasks, which then count without another shuffle.
    """
    return (
        spread(docs, partitions).select("item_id", F.explode(words(F.col(text))).alias("term"))
        .groupBy("item_id", "term")
        .agg(F.count("*").alias("tf"))
    )


def document_frequencies(tf: DataFrame) -> DataFrame:
    """(term, df): documents the term occurs in.

    The condition on tf keeps that column in this branch of a plan, so that the counted terms are the
    same exchange in all branches and Spark reuses it instead of reading the texts again.
    """
    return tf.where(F.col("tf") > 0).groupBy("term").agg(F.count("*").alias("df"))


def prune_vocabulary(df: DataFrame, sigma: float) -> DataFrame:
    """Terms in at most sigma standard deviations' worth of documents; a negative sigma keeps all."""
    if sigma < 0:
        return df
    return df.where(F.col("df") <= df.agg(F.lit(float(sigma)) * F.stddev_pop("df")).scalar())


def prune_max_df_sigma(tf: DataFrame, sigma: float) -> DataFrame:
    """Counts without the terms that are too frequent."""
    if sigma < 0:
        return tf
    kept = prune_vocabulary(document_frequencies(tf), sigma)
    return tf.join(kept.select("term"), "term", "left_semi").select(*tf.columns)


def tfidf(tf: DataFrame, digits: int | None = None) -> DataFrame:
    """tf * ln((N + 1) / (df + 1)) with N the number of documents that have any term."""
    documents = tf.where(F.col("tf") > 0).agg(F.countDistinct("item_id")).scalar()
    idf = document_frequencies(tf).select(
        "term", F.ln((documents + 1) / (F.col("df") + 1)).alias("idf")
    )
    weight = F.col("tf") * F.col("idf")
    if digits is not None:
        weight = rounded(weight, digits)
    return tf.join(idf, "term").select("item_id", "term", weight.alias("weight"))


def align_to_vocabulary(new_tf: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Counts of new documents over the trained dictionary; unknown terms are dropped."""
    return new_tf.join(vocabulary.select("term").distinct(), "term", "left_semi").select(*new_tf.columns)
