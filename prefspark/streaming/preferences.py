"""Continuous preference writes: upserts, retention slots, retrain counters.

Every micro-batch writes one `batch_id` partition and replaces it when Spark repeats the batch, so a
lost executor or a restart changes nothing in the tables.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from prefspark.functions.columns import slot_hours, slot_seq
from prefspark.operators.candidates import item_label
from prefspark.operators.preferences import (
    assign_slot,
    remap_ids,
    upsert_last,
    upsert_max,
)
from prefspark.plans.publish import drop_folders, folders
from prefspark.sources.models import read_or_none
from prefspark.streaming.deltas import read_table, tidy, write_batch


def _start(stream: DataFrame, each_batch, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(each_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


# -- upserts ----------------------------------------------------------------------


def stream_preferences(
    stream: DataFrame,
    log_path: str,
    checkpoint: str,
    mode: str = "last",
    cands: DataFrame | None = None,
    available_now: bool = False,
    compact_every: int | None = None,
) -> StreamingQuery:
    """Upsert (user_id, item_id, preference, ingest_seq[, label]) rows into a log of folded batches.

    Rows are folded inside the micro-batch before they are written; `read_preference_state` folds
    over batches. With `cands` a missing label is looked up by item. With `compact_every`, every so many batches
    are folded into a base and removed (`deltas`).
    """
    if mode not in ("last", "max"):
        raise ValueError("mode must be 'last' or 'max'")

    def each(batch: DataFrame, batch_id: int) -> None:
        rows = remap_ids(batch)
        if mode == "max":
            folded = upsert_max(rows).withColumn("ingest_seq", F.lit(0).cast("long"))
        else:
            folded = upsert_last(rows)
        if cands is not None:
            labels = item_label(cands, folded).withColumnRenamed("label", "found")
            if "label" in batch.columns:
                asked = rows.groupBy("user_id", "item_id").agg(F.min("label").alias("label"))
                folded = folded.join(asked, ["user_id", "item_id"])
            else:
                folded = folded.withColumn("label", F.lit(None).cast("string"))
            folded = (
                folded.join(labels, "item_id", "left")
                .withColumn("label", F.coalesce("label", "found"))
                .drop("found")
            )
        write_batch(folded, batch_id, log_path)
        tidy(batch.sparkSession, log_path, lambda log: fold_preference_log(log, mode), batch_id, compact_every)

    return _start(stream, each, checkpoint, available_now)


def fold_preference_log(log: DataFrame, mode: str) -> DataFrame:
    """The row of each (user, item) that later folds need, with all columns."""
    order = F.struct("preference", "ingest_seq", "batch_id") if mode == "max" else F.struct("ingest_seq", "batch_id", "preference")
    rest = [c for c in log.columns if c not in ("user_id", "item_id")]
    newest = log.groupBy("user_id", "item_id").agg(F.max_by(F.struct(*rest), order).alias("row"))
    return newest.select("user_id", "item_id", "row.*")


def read_preference_state(spark: SparkSession, log_path: str, mode: str = "last") -> DataFrame:
    """(user_id, item_id, preference) after all batches written so far.

    The source's own sequence decides which write is last; batches break its ties.
    """
    log = read_table(spark, log_path)
    if mode == "max":
        return upsert_max(log)
    written = log.withColumn("written", F.struct("ingest_seq", "batch_id"))
    return upsert_last(written, order="written").drop("written")


# -- retention ring ------------------------------------------------------------------


def stream_slots(stream: DataFrame, window_hours: int = 24) -> DataFrame:
    """Rows per retention slot. A slot closes, and late rows for it are dropped, when it falls out of
    the current slot and the four before it."""
    hours = slot_hours(window_hours)
    return (
        stream.withWatermark("ts", f"{4 * hours} hours")
        .groupBy(F.window("ts", f"{hours} hours"))
        .agg(F.count("*").alias("rows"))
        .select(
            F.col("window.start").alias("slot_start"), F.col("window.end").alias("slot_end"), "rows"
        )
    )


def stream_slot_log(
    stream: DataFrame,
    log_path: str,
    checkpoint: str,
    window_hours: int = 24,
    available_now: bool = False,
    now: Callable[[], datetime] | None = None,
) -> StreamingQuery:
    """Keep the raw rows of the ring, partitioned by slot: rows already outside it are not written,
    and slots that leave it are removed.

    The slot of the clock bounds the ring: a row dated later neither moves it nor enters it yet, but waits below
    `<log_path>_later` and enters with the first batch that runs in its slot or later. `now` is the clock, the
    session's by default; it is read once for a batch and stored below `<log_path>_clock`, so that a batch
    that Spark repeats defers and takes up the same rows. A clock that goes back counts as standing still.
    """
    root = log_path.rstrip("/")

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before, today = _clock(spark, root, batch_id, window_hours, now)
        slotted = assign_slot(batch, window_hours)
        later = F.col("slot_seq") > today
        if not slotted.where(later).isEmpty():
            write_batch(slotted.where(later), batch_id, f"{root}_later", "slot_seq")
        slotted = slotted.where(~later)
        waiting = read_or_none(spark, f"{root}_later") if before is not None else None
        if waiting is not None:
            due = F.col("slot_seq").between(before + 1, today) & (F.col("batch_id") < batch_id)
            slotted = slotted.unionByName(waiting.where(due).select(*(F.col(c).cast(slotted.schema[c].dataType) for c in slotted.columns)))
        newest = slotted.agg(F.max("slot_seq")).first()[0]
        if newest is None:
            return
        log = read_or_none(spark, log_path)
        held = None if log is None else log.agg(F.max("slot_seq")).first()[0]
        newest = max(newest, held if held is not None else newest)
        write_batch(slotted.where(F.col("slot_seq") >= newest - 4), batch_id, log_path, "slot_seq")
        drop_slots(spark, log_path, newest - 4)
        if before is not None:
            # Taken up by a batch that is done.
            drop_slots(spark, f"{root}_later", before + 1)
            done = [n for n in folders(spark, f"{root}_clock") if n.startswith("batch_id=") and int(n[9:]) < batch_id - 1]
            drop_folders(spark, f"{root}_clock", done)

    return _start(stream, each, checkpoint, available_now)


def _clock(spark: SparkSession, root: str, batch_id: int, window_hours: int, now: Callable[[], datetime] | None) -> tuple[int | None, int]:
    """The slot of the clock in the batch before, None in the first one, and in this batch."""
    schema = "today long, batch_id long"
    stored = read_or_none(spark, f"{root}_clock", schema)
    known = {} if stored is None else {r.batch_id: r.today for r in stored.where(F.col("batch_id") <= batch_id).collect()}
    before = max((today for b, today in known.items() if b < batch_id), default=None)
    if batch_id not in known:
        clock = F.current_timestamp() if now is None else F.lit(now())
        today = spark.range(1).select(slot_seq(clock, window_hours)).first()[0]
        known[batch_id] = today if before is None else max(today, before)
        write_batch(spark.createDataFrame([(known[batch_id],)], "today long"), batch_id, f"{root}_clock")
    return before, known[batch_id]


def drop_slots(spark: SparkSession, log_path: str, first_kept: int) -> list[int]:
    """Remove the slot folders before `first_kept`; returns their numbers."""
    slots = sorted(int(n[9:]) for n in folders(spark, log_path) if n.startswith("slot_seq=") and int(n[9:]) < first_kept)
    drop_folders(spark, log_path, [f"slot_seq={n}" for n in slots])
    return slots


# -- retrain counters ------------------------------------------------------------------


def stream_retrain_triggers(
    stream: DataFrame, state_path: str, checkpoint: str, every_n: int, available_now: bool = False
) -> StreamingQuery:
    """Count changes per label; every multiple of `every_n` fires once. 0 never fires.

    Rows are counted per label inside each task, so one busy label is no hot spot. Each batch writes
    the counters of all labels and the triggers it crossed, below `state_path`.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        counts_path, triggers_path = f"{state_path}/counts", f"{state_path}/triggers"
        new = batch.groupBy("label").agg(F.count("*").alias("added"))
        old = read_or_none(spark, counts_path, "label string, changes long, batch_id long")
        if old is None:
            totals = new.select("label", F.lit(0).cast("long").alias("before"), "added")
        else:
            old = old.where(F.col("batch_id") < batch_id)
            old = old.where(F.col("batch_id") == old.agg(F.max("batch_id")).scalar())
            totals = old.join(new, "label", "full").select(
                "label", F.coalesce("changes", F.lit(0)).alias("before"), F.coalesce("added", F.lit(0)).alias("added")
            )
        totals = totals.withColumn("changes", F.col("before") + F.col("added"))
        write_batch(totals.select("label", "changes"), batch_id, counts_path)
        if every_n > 0:
            crossed = totals.where(
                F.floor(F.col("changes") / every_n) > F.floor(F.col("before") / every_n)
            ).select(
                "label",
                F.explode(
                    F.sequence(
                        F.floor(F.col("before") / every_n) + 1, F.floor(F.col("changes") / every_n)
                    )
                ).alias("multiple"),
            )
            write_batch(
                crossed.select("label", (F.col("multiple") * every_n).alias("changes")),
                batch_id,
                triggers_path,
            )

    return _start(stream, each, checkpoint, available_now)


def read_retrain_triggers(spark: SparkSession, state_path: str) -> DataFrame:
    schema = "label string, changes long, batch_id long"
    rows = read_or_none(spark, f"{state_path}/triggers", schema)
    if rows is None:
        rows = spark.createDataFrame([], schema)
    return rows.select("label", "changes")
