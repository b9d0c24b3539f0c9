"""Every operator as a named query over the given tables, with its SQL definition where one exists.

A query is a function (spark, folder of parquet tables) -> DataFrame. The SQL next to it says the same
in plain set terms and is what the results are checked against.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from prefspark.plans.session import tune

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# Common table expressions the definitions share.
VIEWS = {
    "pref_events": (
        "SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id, "
        "CAST(value AS FLOAT) AS preference, ts, event_id AS ingest_seq, event_type AS label FROM events"
    ),
    "prefs_e": (
        "SELECT user_id, item_id, max(preference) AS preference FROM pref_events GROUP BY 1, 2"
    ),
    "cands_e": "SELECT DISTINCT label, item_id FROM pref_events",
    "pref_orders": (
        "SELECT o_custkey AS user_id, l_partkey AS item_id, CAST(l_quantity AS FLOAT) AS preference, "
        "o_orderdate AS ts FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
    ),
    "prefs_o": (
        "SELECT user_id, item_id, max(preference) AS preference FROM pref_orders GROUP BY 1, 2"
    ),
    "cands_o": "SELECT p_type AS label, p_partkey AS item_id FROM part",
    "label_prefs": (
        "SELECT label, user_id, item_id, preference FROM prefs_o JOIN cands_o USING (item_id)"
    ),
    "articles": (
        "SELECT doc_id AS item_id, source AS label, text, lang AS sce_al1 FROM documents"
    ),
    "factors": "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS features FROM embeddings",
}
_NEEDS = {
    "prefs_e": ["pref_events"],
    "cands_e": ["pref_events"],
    "prefs_o": ["pref_orders"],
    "label_prefs": ["prefs_o", "cands_o"],
}


def with_views(names: str, body: str) -> str:
    """`body` after the named common table expressions; a body that starts with a comma adds its own."""
    order: list[str] = []

    def add(name: str) -> None:
        for needed in _NEEDS.get(name, []):
            add(needed)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order) + "\n" + body


def query(name: str, sql: str | None = None):
    def add(function: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(tune(spark), sf_dir)

        run.__name__, run.__doc__ = name, function.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return function

    return add


def load_all() -> None:
    """Import the modules that register queries."""
    from prefspark.plans import (  # noqa: F401
        queries_facts,
        queries_incremental,
        queries_models,
        queries_preferences,
        queries_recommend,
        queries_streaming,
        queries_text,
    )
