"""Keyed state in the state store: upserts that report what they changed, and retrain counters.

State lives in Spark's state store under the query's checkpoint, versioned by batch. Preferences are kept by buckets of
keys, each one value of the store: Spark asks Python once per bucket and batch, not once per key, and a batch costs what
the buckets of its keys cost. Rows of one key are folded inside the task that reads them (`mapInPandas`), so a
key that holds a third of all rows reaches its state as one row per task and Arrow batch.

Nulls: a row without user or item keeps its null key as a key of its own; a null preference is never written; a null
sequence or time is below all others. An empty batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from prefspark.functions.columns import slot_hours, slot_seq
from prefspark.operators.pair_deltas import merge_pair_statistics, pair_statistics_delta
from prefspark.operators.preferences import remap_ids
from prefspark.streaming.deltas import read_table, tidy, write_batch

CHANGE = "user_id long, item_id long, before float, after float"

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

HOUR_MS = 3_600_000


def _start(stream: DataFrame, mode: str, each_batch, checkpoint: str, available_now: bool) -> StreamingQuery:
    """Start with the state store that keyed state needs; the session's own choice is put back."""
    conf = stream.sparkSession.conf
    before = conf.get(_PROVIDER, None)
    conf.set(_PROVIDER, _ROCKSDB)
    try:
        writer = stream.writeStream.outputMode(mode).foreachBatch(each_batch).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()
    finally:
        if before is None:
            conf.unset(_PROVIDER)
        else:
            conf.set(_PROVIDER, before)


# -- upserts ---------------------------------------------------------------------------


def _winners(mode: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Of the rows of a key in one Arrow batch, the one that wins under `mode`."""
    order = ["preference"] if mode == "max" else ["ingest_seq", "preference"]

    def fold(batches):
        for rows in batches:
            ordered = rows.sort_values(order, kind="stable", na_position="first")
            yield ordered.drop_duplicates(["user_id", "item_id"], keep="last")

    return fold


# State of a bucket: a row per (user, item) in the order of `key`, which holds both ids, each plus one, and 0 for null.
_HELD = np.dtype([("key", "<u8"), ("preference", "<f4"), ("ingest_seq", "<i8"), ("expires", "<i8")])


def _rows_of(batch: pd.DataFrame) -> np.ndarray:
    """Rows of a batch as state rows; ids are below 2^31 by now (`remap_ids`), a null sequence or time is -1."""
    out = np.empty(len(batch), _HELD)
    user, item = (batch[c].fillna(-1).to_numpy(np.int64) + 1 for c in ("user_id", "item_id"))
    out["key"] = user.astype(np.uint64) << np.uint64(32) | item.astype(np.uint64)
    out["preference"] = batch["preference"].to_numpy(np.float32)
    for c in ("ingest_seq", "expires"):
        out[c] = batch[c].fillna(-1).to_numpy(np.int64)
    return out


def _fold_winners(held: np.ndarray, rows: np.ndarray, mode: str) -> np.ndarray:
    """The winner of every key; of equal ones the one held, or else the first. In mode max the newest time stays."""
    both = np.concatenate([held, rows])
    value, late = np.where(np.isnan(both["preference"]), -np.inf, both["preference"]), -np.arange(len(both))
    order = (late, value) if mode == "max" else (late, value, both["ingest_seq"])
    both = both[np.lexsort((*order, both["key"]))]
    starts = np.flatnonzero(np.diff(both["key"], prepend=~both["key"][:1]))
    out = both[np.append(starts[1:], len(both)) - 1]
    if mode == "max":
        out["expires"] = np.maximum.reduceat(both["expires"], starts)
    return out


class KeepWinner(StatefulProcessor):
    """The values in force of a bucket of (user, item) keys, read and written as one; emits a row for every key whose value
    changes, and one for every key that expires."""

    def __init__(self, mode: str, ring: bool):
        self.mode, self.ring = mode, ring

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("held", "rows binary")

    def _read(self) -> np.ndarray:
        stored = self.state.get()
        return np.empty(0, _HELD) if stored is None else np.frombuffer(stored[0], _HELD)

    def handleInputRows(self, key, rows, timerValues):
        before = held = self._read()
        for batch in rows:
            if len(batch):
                held = _fold_winners(held, _rows_of(batch), self.mode)
        self.state.update((held.tobytes(),))
        if self.ring:
            for at in np.setdiff1d(held["expires"], before["expires"]).tolist():
                if at > 0:
                    self.handle.registerTimer(at)
        at = np.searchsorted(before["key"], held["key"])
        known = np.isin(held["key"], before["key"])
        old = np.zeros(len(held), np.float32)
        old[known] = before["preference"][at[known]]
        changed = ~known | (old != held["preference"])
        if changed.any():
            yield _changes(held["key"][changed], old[changed], ~known[changed], held["preference"][changed], False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = self._read()
        gone = (held["expires"] > 0) & (held["expires"] <= expiredTimerInfo.getExpiryTimeInMs())
        if gone.any():
            if gone.all():
                self.state.clear()
            else:
                self.state.update((held[~gone].tobytes(),))
            yield _changes(held["key"][gone], held["preference"][gone], False, held["preference"][gone], True)

    def close(self) -> None:
        pass


def _changes(keys: np.ndarray, before: np.ndarray, new, after: np.ndarray, gone) -> pd.DataFrame:
    """Rows of changes; `new` and `gone` say where `before` and `after` are null."""
    columns = {}
    for name, ids in (("user_id", keys >> np.uint64(32)), ("item_id", keys & np.uint64(0xFFFFFFFF))):
        ids = ids.astype(np.int64)
        columns[name] = pd.arrays.IntegerArray(ids - 1, ids == 0)
    for name, values, null in (("before", before, new), ("after", after, gone)):
        columns[name] = pd.arrays.FloatingArray(values.copy(), np.broadcast_to(null, len(values)).copy())
    return pd.DataFrame(columns)


def preference_changes_of(
    stream: DataFrame, mode: str = "last", window_hours: int | None = None, delay: str = "0 seconds", buckets: int = 4096
) -> DataFrame:
    """(user_id, item_id, before, after): what writes (user_id, item_id, preference, ingest_seq[, ts]) change.

    `before` is null for a new key. Writes that lose against the value in force, or repeat it, emit nothing. With
    `window_hours` a key whose newest winning write left the retention ring (the slot of the watermark and
    the four before it) is forgotten, and a row with a null `after` says so; the stream needs `ts`, and rows later than
    `delay` behind the newest are dropped, as watermarks do. In mode max every write of a key that is not dropped
    keeps it in the ring. `buckets` is the number of hashed buckets of keys, which a checkpoint keeps for life.
    """
    if mode not in ("last", "max"):
        raise ValueError("mode must be 'last' or 'max'")
    ring = window_hours is not None
    rows = remap_ids(stream).where(F.col("preference").isNotNull())
    picked = ["user_id", "item_id", F.col("preference").cast("float").alias("preference"), F.col("ingest_seq").cast("long").alias("ingest_seq")]
    schema = "user_id long, item_id long, preference float, ingest_seq long, expires long"
    if ring:
        slot_ms = slot_hours(window_hours) * HOUR_MS
        rows = rows.select(*picked, ((slot_seq(F.col("ts"), window_hours) + 5) * slot_ms).alias("expires"), "ts")
        schema += ", ts timestamp"
    else:
        rows = rows.select(*picked, F.lit(0).cast("long").alias("expires"))
    # A key's rows of one slot could win without being the newest, so a ring's rows are folded by their state alone.
    folded = rows.withWatermark("ts", delay) if ring else rows.mapInPandas(_winners(mode), schema)
    bucketed = folded.withColumn("bucket", F.pmod(F.xxhash64("user_id", "item_id"), F.lit(buckets)).cast("int"))
    return bucketed.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=KeepWinner(mode, ring), outputStructType=CHANGE, outputMode="Update", timeMode="EventTime" if ring else "None"
    )


def fold_changes(changes: DataFrame) -> DataFrame:
    """The net change of each (user, item): its first `before` and its last `after`, with the last batch."""
    return (
        changes.groupBy("user_id", "item_id")
        .agg(F.min(F.struct("batch_id", "before")).alias("first"), F.max(F.struct("batch_id", "after")).alias("last"))
        .select("user_id", "item_id", "first.before", "last.after", "last.batch_id")
    )


def fold_to_base(changes: DataFrame) -> DataFrame:
    """A log folded from its beginning: keys that are gone need no row."""
    return fold_changes(changes).where(F.col("after").isNotNull())


def stream_preference_changes(
    stream: DataFrame,
    log_path: str,
    checkpoint: str,
    mode: str = "last",
    window_hours: int | None = None,
    delay: str = "0 seconds",
    available_now: bool = False,
    compact_every: int | None = None,
    then: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Write every batch's changes (`preference_changes_of`) to the log; nothing written before is read.

    `then(changes, batch_id)` is called with the batch's changes as written; it must bear repeats of a batch.
    With `compact_every`, every so many batches are folded into a base (`deltas`).
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        write_batch(batch, batch_id, log_path)
        if then is not None:
            written = spark.read.schema(CHANGE + ", batch_id long").parquet(log_path)
            then(written.where(F.col("batch_id") == batch_id).drop("batch_id"), batch_id)
        tidy(spark, log_path, fold_to_base, batch_id, compact_every, CHANGE + ", batch_id long")

    return _start(preference_changes_of(stream, mode, window_hours, delay), "update", each, checkpoint, available_now)


def preferences_after(changes: DataFrame) -> DataFrame:
    """(user_id, item_id, preference) after all changes of a log with batch_id; removed keys are gone."""
    last = fold_changes(changes)
    return last.where(F.col("after").isNotNull()).select("user_id", "item_id", F.col("after").alias("preference"))


# -- retrain counters -------------------------------------------------------------------


def _counted(batches):
    for rows in batches:
        counts = rows.groupby("label", dropna=False).size().reset_index(name="added")
        yield counts.assign(label=counts["label"].astype(object).where(counts["label"].notna(), None))


class CountChanges(StatefulProcessor):
    """The running number of changes of a label; emits the multiples of `every_n` it passes."""

    def __init__(self, every_n: int):
        self.every_n = every_n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "changes long")

    def handleInputRows(self, key, rows, timerValues):
        before = self.count.get()[0] if self.count.exists() else 0
        after = before + sum(int(batch["added"].sum()) for batch in rows)
        self.count.update((after,))
        if self.every_n > 0:
            passed = [n * self.every_n for n in range(before // self.every_n + 1, after // self.every_n + 1)]
            if passed:
                yield pd.DataFrame({"label": [key[0]] * len(passed), "changes": passed})

    def close(self) -> None:
        pass


def stream_retrain_counters(
    stream: DataFrame, state_path: str, checkpoint: str, every_n: int, available_now: bool = False
) -> StreamingQuery:
    """`stream_retrain_triggers` with the counters in the state store: a batch touches the labels it holds and
    writes the triggers alone, which `read_retrain_triggers` reads."""
    counted = stream.select(F.col("label").cast("string").alias("label")).mapInPandas(_counted, "label string, added long")
    passed = counted.groupBy("label").transformWithStateInPandas(
        statefulProcessor=CountChanges(every_n), outputStructType="label string, changes long", outputMode="Update", timeMode="None"
    )

    def each(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, batch_id, f"{state_path}/triggers")

    return _start(passed, "update", each, checkpoint, available_now)


# -- pair statistics ----------------------------------------------------------------------


def stream_pair_statistics(
    stream: DataFrame,
    log_path: str,
    pairs_path: str,
    checkpoint: str,
    mode: str = "last",
    sums: list[str] | None = None,
    available_now: bool = False,
    compact_every: int | None = None,
) -> StreamingQuery:
    """Keep `pair_statistics` of the preferences in force current while writes arrive.

    A batch's changes meet the other ratings of the users they belong to, and the signed sums are written
    beside the log; `read_pair_statistics` adds them up.
    """
    schema = CHANGE + ", batch_id long"

    def fold(rows: DataFrame) -> DataFrame:
        return merge_pair_statistics(rows.drop("batch_id")).withColumn("batch_id", F.lit(0).cast("long"))

    def then(changes: DataFrame, batch_id: int) -> None:
        log = read_table(changes.sparkSession, log_path, schema, upto=batch_id - 1)
        write_batch(pair_statistics_delta(preferences_after(log), changes, sums=sums), batch_id, pairs_path)
        tidy(changes.sparkSession, pairs_path, fold, batch_id, compact_every)

    return stream_preference_changes(stream, log_path, checkpoint, mode, available_now=available_now, compact_every=compact_every, then=then)


def read_pair_statistics(spark: SparkSession, pairs_path: str) -> DataFrame:
    return merge_pair_statistics(read_table(spark, pairs_path).drop("batch_id"))
