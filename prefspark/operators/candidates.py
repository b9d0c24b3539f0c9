"""Labelled candidate sets and the article corpus that goes with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

PAIR = ["label", "item_id"]


def add_candidates(cands: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidate set with the new pairs (a pair already there stays once), and the touched labels."""
    merged = cands.select(*PAIR).unionByName(new.select(*PAIR)).distinct()
    return merged, new.select("label").distinct()


def delete_candidates(cands: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    keys = keys.select(*PAIR).distinct()
    return cands.join(keys, PAIR, "left_anti").select(*PAIR), keys.select("label").distinct()


def delete_all_candidates(cands: DataFrame, labels: DataFrame) -> DataFrame:
    return cands.join(labels.select("label").distinct(), "label", "left_anti").select(*PAIR)


def get_candidates(cands: DataFrame, label: str) -> DataFrame:
    return cands.where(F.col("label") == label).select("item_id")


def all_labels(cands: DataFrame) -> DataFrame:
    return cands.select("label").distinct()


def item_label(cands: DataFrame, items: DataFrame) -> DataFrame:
    """First label of every asked item (in label order), null where it has none."""
    first = cands.groupBy("item_id").agg(F.min("label").alias("label"))
    return items.select("item_id").distinct().join(first, "item_id", "left")


def semantic_item_view(cands: DataFrame) -> DataFrame:
    """Item universe of the topic recommender: candidates of any label."""
    return cands.select("item_id").distinct()


def merge_new_articles(corpus: DataFrame, new: DataFrame) -> DataFrame:
    """Corpus with the new articles; a new article replaces the old one of the same item."""
    kept = corpus.join(new.select("item_id").distinct(), "item_id", "left_anti")
    return kept.select(*corpus.columns).unionByName(new.select(*corpus.columns))


def delete_articles(
    corpus: DataFrame, cands: DataFrame, keys: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Drop the (label, item) pairs from the candidates and the item's text from the corpus."""
    cands, _ = delete_candidates(cands, keys)
    texts = corpus.join(keys.select("item_id").distinct(), "item_id", "left_anti")
    return texts.select(*corpus.columns), cands
