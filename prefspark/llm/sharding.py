"""Shards of near equal bytes by sampled splitters. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from prefspark.plans.session import materialize

LAW = "bytes"


def _keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = F.coalesce(F.col(text_column), F.lit(""))
    return docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(text.cast("binary")).alias("key"),
    )


def _draw(rows: DataFrame, weight: Column, total: int, n: int, seed: int) -> list:
    """About `n` rows, drawn with chances in proportion to their weights, which add up to `total`.

    A row's chance is 1 - exp(-n * weight / total); it comes from a hash of the row, so that a repeated task
    draws the same rows, and no task returns more than its share.
    """
    u = (F.xxhash64("key", "doc_id", F.lit(seed)).bitwiseAND((1 << 53) - 1) + 1) / float(1 << 53)
    return rows.where(-F.log(u) * total <= weight * n).select("key", "doc_id", *(["part"] if "part" in rows.columns else [])).collect()


def _order(row) -> tuple:
    return (row.key, row.doc_id is not None, row.doc_id or 0)


def _quantiles(sample: list, parts: int) -> list:
    """At most parts - 1 distinct boundaries that cut the sorted sample into equal runs."""
    ordered = sorted(sample, key=_order)
    cut = [ordered[i * len(ordered) // parts] for i in range(1, parts)] if ordered else []
    return list({_order(r): r for r in cut}.values())


def _literal(boundaries: list) -> Column:
    made = [F.struct(F.lit(r.key).alias("key"), F.lit(r.doc_id).cast("long").alias("doc_id")) for r in boundaries]
    return F.array(*made) if made else F.array().cast("array<struct<key:string,doc_id:bigint>>")


def _below(boundaries: Column) -> Column:
    """How many boundaries are not above the row."""
    at = F.struct(F.col("key"), F.col("doc_id"))
    return F.size(F.filter(boundaries, lambda b: b <= at))


def _ranged(rows: DataFrame, boundaries: list) -> Column:
    """The row's range among sorted boundaries, found in two short steps: the stretch, then the place in it."""
    if not boundaries:
        return F.lit(0)
    width = max(1, int(len(boundaries) ** 0.5))
    stretches = [boundaries[i : i + width] for i in range(0, len(boundaries), width)]
    first = _literal([s[0] for s in stretches])
    inside = F.array(_literal([]), *[_literal(s) for s in stretches])
    step = _below(first)
    return F.when(step == 0, 0).otherwise((step - 1) * width + _below(F.get(inside, step)))


def sampled_ranges(rows: DataFrame, rows_per_range: int, draws_per_range: int, seed: int) -> DataFrame:
    """`rows` (key, doc_id, size) with their range `part` and `sub`, both in the order of (key, doc_id).

    Boundaries are quantiles of a size-weighted sample. A range of more than twice `rows_per_range`
    rows (many small rows) is divided again at quantiles of a sample of its rows. The sample grows with
    the number of ranges: `draws_per_range` keys for each `rows_per_range` rows reach the driver.
    """
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    parts = max(2, -(-n // rows_per_range))
    level1 = _quantiles(_draw(rows, F.col("size"), total, parts * draws_per_range, seed), parts)
    first = rows.withColumn("part", _ranged(rows, level1).cast("int"))
    counts = first.groupBy("part").count().where(F.col("count") > 2 * rows_per_range).collect()
    overfull = {r.part: -(-r["count"] // rows_per_range) for r in counts}
    crowd = sum(r["count"] for r in counts)
    if not overfull:
        return first.withColumn("sub", F.lit(0))
    inner = first.where(F.col("part").isin(list(overfull)))
    sample: dict[int, list] = {}
    for row in _draw(inner, F.lit(1), crowd, sum(overfull.values()) * draws_per_range, seed + 1):
        sample.setdefault(row.part, []).append(row)
    sub = F.lit(0)
    for part, pieces in overfull.items():
        sub = F.when(F.col("part") == part, _ranged(first, _quantiles(sample.get(part, []), pieces))).otherwise(sub)
    return first.withColumn("sub", sub.cast("int"))


def assign_shards(
    docs: DataFrame,
    n_shards: int = 8,
    id_column: str = "doc_id",
    text_column: str = "text",
    rows_per_range: int = 1_000_000,
    min_ranges: int = 64,
    draws_per_range: int = 32,
    whole_group_share: float = 0.01,
    seed: int = 17,
) -> DataFrame:
    """One row per row of `docs`: (doc_id, size, text_crc32, law, shard, slot, grown_shard).

    The law is `bytes`: rows in the order of (md5 of the text, doc_id) are cut where the sum of sizes
    passes a multiple of total / n_shards, so a shard's bytes are off by one row at most. Copies are
    neighbours in that order. Where a cut falls into a group of equal texts, the whole group goes to the
    side of its middle if it holds at most `whole_group_share` of a shard's bytes; larger groups are cut.

    Ranges come from sampled splitters (`sampled_ranges`), a window numbers and sums the rows of one
    range, and the totals of the ranges before it are added: no task sees more than a range.

    Null text counts as empty, null doc_id is an id below all others, repeated rows are kept as rows of
    their own, an empty table gives no rows, further columns of `docs` are not read.
    """
    spark = docs.sparkSession
    rows = materialize(_keyed(docs, id_column, text_column), "shard-keys")
    total_rows = rows.count()
    per_range = max(1, min(rows_per_range, -(-total_rows // min_ranges)))
    ranged = materialize(sampled_ranges(rows, per_range, draws_per_range, seed), "shard-ranges")

    ranges = ranged.groupBy("part", "sub").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    # One row per range: a sum over ranges, not over rows.
    before = W.orderBy("part", "sub").rowsBetween(W.unboundedPreceding, -1)
    offsets = ranges.select(
        "part",
        "sub",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
    )
    inside = W.partitionBy("part", "sub").orderBy("key", "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = (
        ranged.withColumn("until", F.sum("size").over(inside))
        .withColumn("nth", F.count("*").over(inside))
        .join(offsets, ["part", "sub"])
        .withColumn("start", F.col("bytes_before") + F.col("until") - F.col("size"))
        .withColumn("rank", F.col("rows_before") + F.col("nth") - 1)
    )
    total = ranges.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("total")).first().total

    def shard_of(start: Column, size: Column) -> Column:
        if not total:
            return F.lit(0)
        return F.least(F.expr(f"{n_shards - 1}L"), F.floor((2 * start + size) * n_shards / F.lit(2 * total).cast("decimal(38,0)")))

    placed = materialize(
        placed.select("doc_id", "size", "text_crc32", "key", "start", "rank", shard_of(F.col("start"), F.col("size")).cast("int").alias("cut")),
        "shard-places",
    )
    # The groups that a cut divides: the last of one shard and the first of the next, n_shards - 1 at most.
    edges = placed.groupBy("cut").agg(F.min("key").alias("first"), F.max("key").alias("last")).collect()
    held: dict[str, int] = {}
    for edge in edges:
        for key in {edge.first, edge.last}:
            held[key] = held.get(key, 0) + 1
    divided = [key for key, n in held.items() if n > 1]
    groups = (
        placed.where(F.col("key").isin(divided))
        .groupBy("key")
        .agg(F.sum("size").alias("size"), F.min("start").alias("start"))
        .select("key", "size", shard_of(F.col("start"), F.col("size")).cast("int").alias("shard"))
        .collect()
    )
    shard = F.col("cut")
    for group in groups:
        if group["size"] <= whole_group_share * total / n_shards:
            shard = F.when(F.col("key") == group.key, group.shard).otherwise(shard)
    sharded = placed.withColumn("shard", shard)
    first = {r.shard: r.least for r in sharded.groupBy("shard").agg(F.min("rank").alias("least")).collect()}
    least = F.create_map(*[F.lit(x) for pair in (first or {0: 0}).items() for x in pair])
    return sharded.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit(LAW).alias("law"),
        "shard",
        (F.col("rank") - least[F.col("shard")]).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
