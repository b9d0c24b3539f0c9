"""From raw documents to training sequences: five operators, each stage written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from prefspark.llm.common import read
from prefspark.llm.decontaminate import decontaminate
from prefspark.llm.line_dedup import dedup_lines
from prefspark.llm.ngram_join import keep_one
from prefspark.llm.packing import pack_documents
from prefspark.llm.quality import filter_quality
from prefspark.plans.session import materialize, tune


def ready(spark: SparkSession) -> None:
    """Settings of every stage: fewer rows at a time go to a Python worker, since whole texts are held there."""
    tune(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the forest, calibrated on the labelled ones among them.

    Null and empty texts fail the rules and go. Null ids and repeated rows are judged each, extra columns stay, an
    empty table stays empty; texts of any length are read whole.
    """
    ready(spark)
    return filter_quality(docs, read(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that five or more of them share but for one place.

    Null text becomes an empty one. A null id is below all others, rows that repeat an id are one document to the
    count and keep or lose the same lines. Of equal lines the largest id's stay. Extra columns stay, an empty table
    stays empty.
    """
    ready(spark)
    kept = dedup_lines(docs).select(*docs.columns)
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents: five words a shingle, a similarity of 0.8 or more.

    The smallest id stays; of rows that repeat it the least in the order of the columns. Texts without words are
    linked with nothing, rows without id stay all. Extra columns stay, an empty table stays empty.
    """
    ready(spark)
    return keep_one(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate.

    Null and empty texts have no words and stay, as do all rows where the benchmark is empty. Null ids and repeated
    rows are judged each. Extra columns stay, an empty table stays empty.
    """
    ready(spark)
    return decontaminate(docs, read(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences with their token ids.

    A null or empty text is its end token alone. Null ids and repeated rows are packed each, extra columns are left
    out, an empty table gives no pieces; a text of any length is cut, and every id is in one piece.
    """
    ready(spark)
    return pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("packing", packing),
]

#: A forest's verdicts and the tokenizer have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for all documents."""
    docs = read(tune(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
