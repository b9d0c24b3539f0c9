"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters that part words and that a line is stripped of.
BLANK = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """`name`, changed until no column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def bitmap_test(hashes: DataFrame, column: str, bits: int):
    """A test on hash columns that every hash of `column` passes, and few others as long as the bitmap is not full.

    The bitmap of `bits` bits (a power of two) is a literal of the plan; its size is fixed whatever the table
    holds. A full bitmap lets everything pass: it saves work and decides nothing.
    """
    slot = F.col(column).bitwiseAND(bits - 1)
    words = np.zeros(bits // 64, np.int64)
    set_bits = hashes.select(
        F.shiftright(slot, 6).alias("word"), F.expr(f"shiftleft(1L, cast({column} & 63 AS INT))").alias("bit")
    )
    for row in set_bits.groupBy("word").agg(F.bit_or("bit").alias("held")).collect():
        words[row.word] = row.held
    bitmap = F.lit(words)

    def test(h: Column) -> Column:
        held = F.get(bitmap, F.shiftright(h.bitwiseAND(bits - 1), 6).cast("int"))
        return F.getbit(held, h.bitwiseAND(63).cast("int")) == 1

    return test


def process_cache(name: str, make):
    """A value kept for the life of a Python worker, which serves many tasks."""
    holder = sys.modules.setdefault("_prefspark_worker", types.ModuleType("_prefspark_worker"))
    if not hasattr(holder, name):
        setattr(holder, name, make())
    return getattr(holder, name)


def lean(function):
    """`function` over a task's batches; when the task ends, memory that is free goes back to the system.

    A Python worker lives on between tasks and stages, and so would all that its allocators keep, beside stages that
    need no Python at all.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:  # glibc's
                trim(0)

    return run


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose `column` holds about `limit` bytes at most (one row at least)."""
    for batch in batches:
        index = batch.schema.get_field_index(column)
        start, held = 0, 0
        sizes = [0 if v is None else v for v in pc.binary_length(batch.column(index)).to_pylist()]
        for i, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, from batches that are sorted by it; one key's rows are held at a time."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
        start = 0
        for i, key in enumerate(zip(*columns)):
            if key != now:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, now = [], i, key
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)
