"""Article texts."""

from pyspark.sql import functions as F

from prefspark import views as V
from prefspark.functions.text import KEPT_LETTERS, clean, remove_stopwords, stop_word_list, strip_bad_chars
from prefspark.operators import text as X
from prefspark.plans.catalog import query, with_views
from prefspark.plans.session import tasks

_STOP = ", ".join(f"'{w}'" for w in stop_word_list())
_BREAK = r"[ \t\n\r\f]+"


def _strip(text: str) -> str:
    return rf"regexp_replace({text}, '[^{KEPT_LETTERS} \t\n\x0B\f\r]', '', 'g')"


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{_BREAK}'), lambda w: w <> '')"


def _unstop(text: str) -> str:
    return f"array_to_string(list_filter({_words(f'lower({text})')}, lambda w: w NOT IN ({_STOP})), ' ')"


def _clean(text: str) -> str:
    return _unstop(_strip(text))


@query("strip_bad_chars", f"SELECT doc_id, {_strip('text')} AS text FROM documents")
def strip(spark, d):
    return V.documents(spark, d).select("doc_id", strip_bad_chars(F.col("text")).alias("text"))


@query("remove_stopwords", f"SELECT doc_id, {_unstop('text')} AS text FROM documents")
def unstop(spark, d):
    return V.documents(spark, d).select("doc_id", remove_stopwords(F.col("text")).alias("text"))


@query("min_words", f"SELECT doc_id FROM documents WHERE len({_words('text')}) >= 50")
def min_words(spark, d):
    return X.min_words(V.documents(spark, d), 50).select("doc_id")


@query(
    "article_variants",
    with_views(
        "articles",
        f"""SELECT item_id, label, training_set, t AS text FROM (
SELECT item_id, label, 'pure' AS training_set, text AS t FROM articles
UNION ALL SELECT item_id, label, 'stopwords', {_clean("text")} FROM articles
UNION ALL SELECT item_id, label, 'SCEAL1', text || ' ' || sce_al1 FROM articles
UNION ALL SELECT item_id, label, 'processedSCEAL1', {_clean("text || ' ' || sce_al1")} FROM articles) v""",
    ),
)
def article_variants(spark, d):
    return X.article_variants(V.articles(spark, d), partitions=tasks(spark)).select("item_id", "label", "training_set", "text")


@query(
    "article_variants_sceal2",
    with_views(
        "articles",
        f"""SELECT item_id, label, training_set, t AS text FROM (
SELECT item_id, label, 'SCEAL2' AS training_set, text || ' ' || label AS t FROM articles
UNION ALL SELECT item_id, label, 'processedSCEAL2', {_clean("text || ' ' || label")} FROM articles) v""",
    ),
)
def article_variants_sceal2(spark, d):
    """The second context, here the article's source."""
    articles = V.articles(spark, d).drop("sce_al1").withColumn("sce_al2", F.col("label"))
    found = X.article_variants(articles).where(F.col("training_set").endswith("SCEAL2"))
    return found.select("item_id", "label", "training_set", "text")


_TF = f"""tf AS (SELECT item_id, term, count(*) AS tf FROM
(SELECT doc_id AS item_id, unnest({_words(_clean("text"))}) AS term FROM documents) t GROUP BY 1, 2)"""


def cleaned(spark, d):
    docs = X.spread(V.documents(spark, d).withColumnRenamed("doc_id", "item_id"), tasks(spark))
    return docs.select("item_id", clean(F.col("text")).alias("text"))


def counts(spark, d):
    return X.term_frequencies(cleaned(spark, d))


@query("term_frequencies", f"WITH {_TF} SELECT * FROM tf")
def term_frequencies(spark, d):
    return counts(spark, d)


@query(
    "tfidf",
    f"""WITH {_TF}, n AS (SELECT count(DISTINCT item_id) AS n FROM tf),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)
SELECT item_id, term, round(tf * ln(CAST(n + 1 AS DOUBLE) / (df + 1)), 6) AS weight FROM tf JOIN df USING (term), n""",
)
def tfidf(spark, d):
    return X.tfidf(counts(spark, d), digits=6)


@query(
    "prune_max_df_sigma",
    f"""WITH {_TF}, df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)
SELECT * FROM tf WHERE term IN (SELECT term FROM df WHERE df <= (SELECT 2.5 * stddev_pop(df) FROM df))""",
)
def prune_max_df_sigma(spark, d):
    return X.prune_max_df_sigma(counts(spark, d), 2.5)


@query(
    "align_to_vocabulary",
    f"""WITH {_TF}, vocabulary AS (SELECT DISTINCT unnest({_words(_clean("text"))}) AS term FROM benchmark)
SELECT tf.* FROM tf JOIN vocabulary USING (term)""",
)
def align_to_vocabulary(spark, d):
    known = V.table(spark, d, "benchmark").select("item_id", clean(F.col("text")).alias("text"))
    return X.align_to_vocabulary(counts(spark, d), X.term_frequencies(known))
