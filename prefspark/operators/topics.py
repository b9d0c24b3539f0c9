"""Topic models over article texts, with Spark's online LDA in a hashed term space.

Terms are hashed into 2^bits slots, so what the solver keeps on the driver, k numbers per slot, is a parameter and
does not grow with the texts. The dictionary is a table (term, slot, df); nobody holds it whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.clustering import LDA
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from prefspark.functions.text import words
from prefspark.operators.scoring import top_unseen
from prefspark.operators.text import document_frequencies, prune_vocabulary, spread
from prefspark.operators.topk import top_n
from prefspark.plans.session import even_tasks, materialize, scratch_path

#: log2 of the slots: at 262,144 of them the solver keeps 2 MB per topic.
BITS = 18
#: Given items of a request up to which it shares scores with others.
LONG_LIST = 64


@dataclass
class TopicModel:
    """terms: (term, slot, df), the dictionary; weights: (slot, idf), or None where counts are taken as they are;
    vectors: (item_id, features) of the documents of the training, unless the model was loaded."""

    bits: int
    terms: DataFrame
    weights: DataFrame | None
    lda: object
    vectors: DataFrame | None = None


def term_slot(term: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(1 << bits)).cast("int")


def term_counts(docs: DataFrame, text: str = "text", partitions: int | None = None) -> DataFrame:
    """(item_id, term, tf); an item without words has one row with a null term. One row of input is one task's work."""
    exploded = spread(docs.select("item_id", F.col(text).alias("text")), partitions).select("item_id", F.explode_outer(words(F.col("text"))).alias("term"))
    return exploded.groupBy("item_id", "term").agg(F.count("term").alias("tf"))


def slot_vectors(counts: DataFrame, bits: int, weights: DataFrame | None = None) -> DataFrame:
    """(item_id, features): sparse vectors from (item_id, slot, tf), written once; null slots make no entry."""
    entries = counts.groupBy("item_id", "slot").agg(F.sum("tf").cast("double").alias("value"))
    if weights is not None:
        weighted = entries.join(weights, "slot", "left")
        entries = weighted.select("item_id", "slot", (F.col("value") * F.coalesce("idf", F.lit(0.0))).alias("value"))
    held = F.sort_array(F.collect_list(F.when(F.col("slot").isNotNull(), F.struct("slot", "value"))))
    listed = entries.groupBy("item_id").agg(held.alias("held"))
    # What Spark's sparse vectors look like in a file.
    sparse = F.struct(
        F.lit(0).cast("byte").alias("type"), F.lit(1 << bits).alias("size"), F.col("held.slot").alias("indices"), F.col("held.value").alias("values")
    )
    path = scratch_path(counts.sparkSession, "term-vectors")
    out = listed.select("item_id", sparse.alias("features"))
    out.write.parquet(path)
    schema = StructType([out.schema["item_id"]]).add("features", VectorUDT())
    return counts.sparkSession.read.schema(schema).parquet(path)


def train_topics(
    docs: DataFrame,
    k: int = 20,
    alpha: float = 0.1,
    eta: float = 0.1,
    iters: int = 20,
    max_df_sigma: float = 2.5,
    weighting: str = "counts",
    subsampling: float = 1.0,
    seed: int = 42,
    text: str = "text",
    bits: int = BITS,
    partitions: int | None = None,
) -> TopicModel:
    """Fit topics on (item_id, text). `max_df_sigma` prunes the dictionary as `prune_vocabulary` does.

    Texts are read once, in `partitions` tasks where that is given, and their term counts written. Terms of one slot
    are one term to the solver: with n distinct terms about n / 2^(bits + 1) of them share theirs with a certain other.
    Every iteration reads all documents; a smaller `subsampling` reads a random share of them each time.
    `eta` is the prior count of a term: the solver, which has slots no term fell into, gets as much in all.
    """
    if weighting not in ("counts", "tfidf"):
        raise ValueError("weighting must be 'counts' or 'tfidf'")
    counts = materialize(term_counts(docs, text, partitions), "term-counts")
    frequencies = materialize(document_frequencies(counts.where("term IS NOT NULL")), "document-frequencies")
    terms = prune_vocabulary(frequencies, max_df_sigma).select("term", term_slot(F.col("term"), bits).alias("slot"), "df")
    terms = materialize(terms, "dictionary")
    used = terms.agg(F.countDistinct("slot")).first()[0]
    if not used:
        raise ValueError("no term is left to train on")
    placed = counts.withColumn("slot", term_slot(F.col("term"), bits)).withColumn("slot", F.when(F.col("term").isNotNull(), F.col("slot")))
    if max_df_sigma >= 0:
        # Few terms are too frequent; the long table of the others is not joined.
        gone = frequencies.join(terms.select("term"), "term", "left_anti").select("term", F.lit(True).alias("gone"))
        placed = placed.join(materialize(gone, "pruned"), "term", "left").withColumn("slot", F.when(F.col("gone").isNull(), F.col("slot")))
    weights = None
    if weighting == "tfidf":
        documents = counts.agg(F.countDistinct("item_id")).scalar()
        by_slot = placed.where("slot IS NOT NULL").select("item_id", "slot").distinct().groupBy("slot").agg(F.count("*").alias("df"))
        weights = materialize(by_slot.select("slot", F.ln((documents + 1) / (F.col("df") + 1)).alias("idf")), "slot-weights")
    lda = LDA(
        k=k,
        maxIter=iters,
        seed=seed,
        optimizer="online",
        docConcentration=[alpha],
        topicConcentration=eta * used / (1 << bits),
        subsamplingRate=subsampling,
    )
    vectors = slot_vectors(placed, bits, weights)
    return TopicModel(bits, terms, weights, lda.fit(evenly(vectors)), vectors)


def evenly(vectors: DataFrame, least: int = 1000) -> DataFrame:
    """Vectors of a file dealt into equal tasks, four for every core, of `least` rows or more: a solver's round takes as long as
    its longest task, and files are read as about one task for each core. Few rows stay as they lie.

    Sorted, so that the solver's draws do not depend on who sent rows first.
    """
    tasks = min(even_tasks(vectors.sparkSession), vectors.count() // least)
    return vectors if tasks < 2 else vectors.repartition(tasks, "item_id").sortWithinPartitions("item_id")


def document_topics(model: TopicModel, docs: DataFrame | None = None, text: str = "text", partitions: int | None = None) -> DataFrame:
    """(item_id, topics): the topic distribution of every document; words outside the dictionary are dropped.

    Without `docs`: of the documents the model was trained on, whose vectors it still has.
    """
    if docs is None:
        if model.vectors is None:
            raise ValueError("a loaded model has no documents of its training: give docs")
        vectors = model.vectors
    else:
        known = term_counts(docs, text, partitions).join(model.terms.select("term", "slot"), "term", "left")
        vectors = slot_vectors(known, model.bits, model.weights)
    return model.lda.transform(evenly(vectors)).select("item_id", vector_to_array("topicDistribution").alias("topics"))


def topic_terms(model: TopicModel, n: int = 100) -> DataFrame:
    """(topic, rank, term, weight): the n heaviest terms of every topic.

    Terms of one slot share its weight in proportion to the documents that have them. Terms are looked up for each
    topic's 4n heaviest slots.
    """
    slots = model.lda.describeTopics(min(4 * n, 1 << model.bits))
    weighed = slots.select("topic", F.inline(F.arrays_zip(F.col("termIndices").alias("slot"), F.col("termWeights").alias("heaviness"))))
    of_slot = F.sum("df").over(Window.partitionBy("topic", "slot"))
    shared = weighed.join(model.terms, "slot").select("topic", "term", (F.col("heaviness") * F.col("df") / of_slot).alias("weight"))
    order = Window.partitionBy("topic").orderBy(F.desc("weight"), "term")
    return shared.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("topic", "rank", "term", "weight")


def infer_topics(
    model: TopicModel, new_docs: DataFrame, known: DataFrame, text: str = "text", partitions: int | None = None
) -> DataFrame:
    """Topic distributions of the documents not known yet, under the fixed dictionary and topics."""
    unknown = new_docs.join(known.select("item_id").distinct(), "item_id", "left_anti")
    return document_topics(model, unknown, text, partitions)


def recommend_topics(
    seed_items: DataFrame,
    topics: DataFrame,
    cands: DataFrame,
    how_many: int = 10,
    **options,
) -> DataFrame:
    """Top candidates by the product of topic vectors with the request's first item.

    seed_items: (request_id, label, position, item_id). All given items are left out. A candidate
    without topics scores 0; a request whose first item has none gets no rows.

    Requests of a label with the same first item have the same scores, so these are worked out once per first item: its
    best candidates, as many as a list has places and the longest given list items. A request takes its own from them. Requests
    with lists of over `LONG_LIST` items are scored each.
    """
    # One row per request and label, and all items given to the request.
    seen = seed_items.where("request_id IS NOT NULL").groupBy(F.col("request_id").alias("of")).agg(F.collect_set("item_id").alias("seen"))
    first = seed_items.groupBy("request_id", "label").agg(F.min_by("item_id", "position").alias("item_id"))
    vectors = topics.select("item_id", F.col("topics").alias("features"))
    answerable = first.join(vectors.select("item_id").distinct(), "item_id", "left_semi").where("label IS NOT NULL")
    asked = answerable.join(seen, F.col("request_id") == F.col("of"), "left").select(
        "request_id", "label", "item_id", F.coalesce("seen", F.slice(F.array("item_id"), 1, 0)).alias("seen")
    )
    asked = materialize(asked, "topic-requests")
    candidates = {"item_factors": vectors.withColumnRenamed("item_id", "id"), "cands": cands, "missing_as_zero": True, **options}
    short, long = asked.where(F.size("seen") <= LONG_LIST), asked.where(F.size("seen") > LONG_LIST)
    most = short.agg(F.max(F.size("seen"))).first()[0] or 0
    # An id that has several vectors is listed as often.
    copies = (vectors.groupBy("item_id").count().agg(F.max("count")).first()[0] or 1) ** 2
    key = F.concat_ws(":", F.col("item_id").cast("string"), "label").alias("question")
    questions = short.select(key, "item_id", "label").distinct().join(vectors, "item_id").select(F.col("question").alias("request_id"), "label", "features")
    nothing = questions.select("request_id", F.lit(None).cast("long").alias("item_id")).where("false")
    ranked = top_unseen(questions, nothing, how_many=how_many + copies * most, **candidates)
    lists = ranked.groupBy(F.col("request_id").alias("question"), "label").agg(
        F.array_sort(F.collect_list(F.struct("rank", "item_id", "value"))).alias("best")
    )
    own = short.select("request_id", "label", key, "seen").join(lists, ["question", "label"])
    unseen = F.filter("best", lambda x: ~F.coalesce(F.array_contains("seen", x["item_id"]), F.lit(False)))
    shared = own.select("label", "request_id", F.inline(F.slice(unseen, 1, how_many))).drop("rank")
    if long.isEmpty():
        scored = shared
    else:
        each = top_unseen(
            long.join(vectors, "item_id").select("request_id", "label", "features"),
            long.select("request_id", F.explode("seen").alias("item_id")).distinct(),
            how_many=how_many,
            **candidates,
        )
        scored = shared.unionByName(each.select(*shared.columns))
    return top_n(scored, "request_id", how_many).select("label", "request_id", "rank", "item_id", "value")
