"""Benchmark passages in documents, found by winnowed fingerprints. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from prefspark.llm.common import ascii_lower, bitmap_test, fresh
from prefspark.plans.session import materialize

#: Everything that parts words: ASCII other than digits and letters (A-Z are lower-cased before).
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BITS = 1 << 18


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _head(array: Column, n: Column) -> Column:
    return F.slice(array, 1, F.greatest(n, F.lit(0)))


def _combined(rows: DataFrame, name: str, left: str, right: str, shift: int, combine) -> DataFrame:
    """Adds combine(left[i], right[i + shift]) for every i; entries past the end combine with null."""
    return rows.withColumn(name, F.transform(left, lambda x, i: combine(x, F.get(F.col(right), i + shift))))


def _with_grams(rows: DataFrame, words: str, n: str, gram: int, name: str) -> DataFrame:
    """Adds the array of hashes of `gram` consecutive words; doubling takes about log2(gram) passes."""
    rows = rows.withColumn(f"{name}_1", F.transform(words, lambda w: F.xxhash64(w)))
    at, made = 1, [f"{name}_1"]
    for bit in bin(gram)[3:]:
        for step in [at, 1] if bit == "1" else [at]:
            rows = _combined(rows, f"{name}_{at + step}", f"{name}_{at}", f"{name}_{step}", at, F.xxhash64)
            at += step
            made.append(f"{name}_{at}")
    return rows.withColumn(name, _head(F.col(made[-1]), F.col(n) - (gram - 1))).drop(*made)


def _with_minima(rows: DataFrame, grams: str, width: int, name: str) -> DataFrame:
    """Adds the minimum of every `width` consecutive grams: the winnowed fingerprints of the text's windows."""
    current, at, made = grams, 1, []
    while at < width:
        step = min(at, width - at)
        rows = _combined(rows, f"{name}_{at + step}", current, current, step, F.least)
        at += step
        current = f"{name}_{at}"
        made.append(current)
    return rows.withColumn(name, _head(F.col(current), F.size(grams) - (width - 1))).drop(*made)


def item_windows(items: DataFrame, window: int, id_column: str, text_column: str) -> DataFrame:
    """(window: array of words, items: sorted ids as strings): every distinct window of the benchmark."""
    return (
        items.select(F.col(id_column).cast("string").alias("item"), words_of(F.col(text_column)).alias("words"))
        .where(F.size("words") > 0)
        .select(
            "item",
            F.explode(
                F.transform(
                    F.sequence(F.lit(1), F.greatest(F.size("words") - (window - 1), F.lit(1))),
                    lambda i: F.slice(F.col("words"), i, window),
                )
            ).alias("window"),
        )
        .groupBy("window")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    window: int = 13,
    gram: int = 8,
    percent: int = 5,
) -> DataFrame:
    """One row per row of `docs`: (doc_id, text_md5, n_words, n_hit, n_items, items, contaminated).

    A window is `window` consecutive words of a benchmark item; an item of fewer words, but not none, is
    one window. A document word inside any occurrence of a window is hit; a document is contaminated if
    some word and at least `percent` per cent of its words are hit.

    Winnowing: of every `window - gram + 1` consecutive grams of `gram` words the minimum hash is kept, in
    documents and in windows, so equal windows share a kept gram at the same offset. Kept document grams
    that a bitmap of fixed size lets pass are joined to the windows' by hash, and a shared gram is extended
    to both sides by comparing words: no hash decides a hit. Items shorter than a window get grams of
    their own length (at most `gram`), without winnowing.

    Null text has no words and is never contaminated, null item ids count for words but are not listed,
    repeated rows give repeated rows, empty tables give no rows or no hits, other columns are not read.
    """
    spark = docs.sparkSession
    width = window - gram + 1
    windows = materialize(item_windows(items, window, item_column, item_text_column).withColumn("n", F.size("window")), "bench-windows")
    lengths = sorted(r.n for r in windows.select("n").distinct().collect())  # at most `window` values
    tasks = [(gram, width, [window])] if window in lengths else []
    short: dict[int, list[int]] = {}
    for n in lengths:
        if n < window:
            short.setdefault(min(n, gram), []).append(n)
    tasks += [(g, 1, ns) for g, ns in short.items()]

    base = docs.select(
        F.col(id_column).alias("doc_id"),
        F.md5(F.coalesce(F.col(text_column), F.lit("")).cast("binary")).alias("text_md5"),
        words_of(F.col(text_column)).alias("words"),
    ).withColumn("n_words", F.size("words"))
    prints, found = [], []
    for t, (g, w, ns) in enumerate(tasks):
        kept = windows.where(F.col("n").isin(ns))
        kept = _with_grams(kept, "window", "n", g, "g")
        kept = (
            _with_minima(kept, "g", w, "m")
            .withColumn("fp", F.array_min("m"))
            .select("window", "items", "fp", F.explode(F.expr("filter(sequence(0, size(g) - 1), i -> g[i] = fp)")).alias("shift"))
            .withColumn("task", F.lit(t))
        )
        if w == 1:  # one gram at the window's start is enough
            kept = _with_grams(windows.where(F.col("n").isin(ns)), "window", "n", g, "g").select(
                "window", "items", F.col("g")[0].alias("fp"), F.lit(0).alias("shift"), F.lit(t).alias("task")
            )
        kept = materialize(kept, "bench-prints")
        prints.append(kept)
        base = _with_grams(base, "words", "n_words", g, f"g{t}")
        base = _with_minima(base, f"g{t}", w, f"m{t}")
        base = base.withColumn(
            f"s{t}", F.array_distinct(F.filter(f"m{t}", bitmap_test(kept, "fp", _BITS)))
        )
        left = window - g
        base = base.withColumn(
            f"h{t}",
            F.when(
                F.size(f"s{t}") > 0,
                F.expr(
                    f"transform(filter(transform(g{t}, (x, i) -> if(array_contains(s{t}, x), i, -1)), p -> p >= 0), p -> struct("
                    f"{t} AS task, g{t}[p] AS fp, p AS at, p - greatest(p - {left}, 0) AS before, "
                    f"slice(words, greatest(p - {left}, 0) + 1, p - greatest(p - {left}, 0) + {window}) AS around))"
                ),
            ),
        ).drop(f"g{t}", f"m{t}", f"s{t}")
        found.append(F.coalesce(F.col(f"h{t}"), F.array().cast(
            "array<struct<task:int,fp:bigint,at:int,before:int,around:array<string>>>")))
    hits = F.concat(*found) if found else F.array().cast("array<struct<task:int,fp:bigint,at:int,before:int,around:array<string>>>")
    scanned = materialize(base.select("doc_id", "text_md5", F.col("n_words").cast("long").alias("n_words"), hits.alias("hits")), "bench-scan")
    narrow = scanned.select("doc_id", "text_md5", "n_words")
    none = F.array().cast("array<string>")
    if not prints:
        per_doc = None
    else:
        table = prints[0]
        for more in prints[1:]:
            table = table.unionByName(more)
        # Rows that repeat (id and text) give the same hits, which count once.
        probes = scanned.where(F.size("hits") > 0).select("doc_id", "text_md5", F.inline("hits"))
        matched = (
            probes.join(table, ["task", "fp"])
            .where((F.col("before") >= F.col("shift")) & (F.slice("around", F.col("before") - F.col("shift") + 1, F.size("window")) == F.col("window")))
            .select(
                "doc_id",
                "text_md5",
                F.struct((F.col("at") - F.col("shift")).alias("a"), (F.col("at") - F.col("shift") + F.size("window")).alias("b")).alias("span"),
                "items",
            )
        )
        per_doc = (
            matched.groupBy("doc_id", "text_md5")
            .agg(F.sort_array(F.collect_set("span")).alias("spans"), F.collect_set("items").alias("lists"))
            .select(
                F.col("doc_id").alias("hit_id"),
                F.col("text_md5").alias("hit_md5"),
                # The length of the union of the spans, in the order of their starts.
                F.aggregate(
                    "spans",
                    F.struct(F.lit(0).alias("end"), F.lit(0).alias("total")),
                    lambda acc, s: F.struct(
                        F.greatest(acc["end"], s["b"]).alias("end"),
                        (acc["total"] + F.greatest(F.lit(0), s["b"] - F.greatest(acc["end"], s["a"]))).alias("total"),
                    ),
                    lambda acc: acc["total"],
                ).alias("hit"),
                F.sort_array(F.array_distinct(F.flatten("lists"))).alias("items"),
            )
        )
    if per_doc is None:
        out = narrow.withColumn("hit", F.lit(0)).withColumn("items", none)
    else:
        out = narrow.join(
            per_doc, narrow.doc_id.eqNullSafe(per_doc.hit_id) & (narrow.text_md5 == per_doc.hit_md5), "left"
        ).drop("hit_id", "hit_md5")
    n_hit = F.coalesce(F.col("hit"), F.lit(0)).cast("long")
    return out.select(
        "doc_id",
        "text_md5",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.coalesce("items", none).alias("items"),
        ((n_hit > 0) & (100 * n_hit >= percent * F.col("n_words"))).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The rows of `docs` that aren't contaminated, with all their columns; options as in `contamination`."""
    bad = (
        contamination(docs, items, id_column, text_column, **options)
        .where("contaminated")
        .select(F.col("doc_id").alias(fresh(docs, "bad_id")), F.col("text_md5").alias(fresh(docs, "bad_md5")))
        .distinct()
    )
    bad_id, bad_md5 = bad.columns
    md5 = F.md5(F.coalesce(docs[text_column], F.lit("")).cast("binary"))
    return docs.join(bad, docs[id_column].eqNullSafe(bad[bad_id]) & (md5 == bad[bad_md5]), "left_anti")
