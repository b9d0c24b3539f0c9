"""Sums over item pairs, packed before they are shuffled.

Most pairs of a large table occur in one or two baskets, so summing them inside a task saves little and a row per pair is
what costs. Here a task sums the pairs it has at hand and deals the sums into buckets by a hash of the pair; what
is shuffled is one compressed row per bucket and hundreds of pairs. A bucket's rows are added up where they meet, in as
many passes as keep few pairs in memory, so a bucket may be of any size.

Pairs are made where they are summed (`basket_sums`), by index arithmetic on whole batches of baskets. Packed sums may be kept
as they are (`PackedSums`): added up again they are not unpacked before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from prefspark.plans.session import materialize

#: Buckets of pairs, pairs that a task holds at a time, rows of an outgoing batch, and pairs made at a time.
BUCKETS, HELD, OUT, MADE = 4096, 1_000_000, 65_536, 250_000
_ROW = "bucket int, n long, raw long, packed binary"
_KINDS = {pa.int64(): np.int64, pa.float64(): np.float64}
#: Sums of products, which are guessed from the sums of one side each.
_GUESSED = {"sxy": ("sx", "sy"), "sxx": ("sx", "sx"), "syy": ("sy", "sy")}


def _hash(table: pa.Table) -> np.ndarray:
    """A hash of the pair; a null id is as good as any."""
    i, j = (pc.fill_null(table[c], -1).to_numpy().astype(np.uint64) for c in ("i", "j"))
    out = (i * np.uint64(0x9E3779B97F4A7C15) ^ j) * np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return out * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(16)


def _guess(name: str, read: dict[str, np.ndarray]) -> np.ndarray | None:
    """What a sum of products most often is, from sums read before it: the pair's only product. Bits that agree cost nothing."""
    sides = _GUESSED.get(name)
    if sides is None or any(c not in read for c in ("both", *sides)):
        return None
    a, b, n = (read[c] for c in (*sides, "both"))
    with np.errstate(all="ignore"):
        guess = a * b / n
    return np.where(np.isfinite(guess), guess, 0.0).view(np.uint64)


def _lanes(table: pa.Table) -> tuple[list[int], list[int]]:
    """Columns that are packed byte by byte, 64-bit ones without nulls, with those that guesses are made from first; and the others."""
    plain = [at for at, c in enumerate(table.columns) if c.type in _KINDS and not c.null_count]
    return sorted(plain, key=lambda at: table.schema.names[at] in _GUESSED), [at for at in range(table.num_columns) if at not in plain]


def _encoded(table: pa.Table, starts: np.ndarray, ends: np.ndarray) -> Iterator[bytes]:
    """Slices of the table without its schema: of every plain column all first bytes, all second bytes and so on, `i` as steps,
    sums of products as bits that differ from their guess; other columns as they are."""
    plain, others = _lanes(table)
    lanes, read = np.zeros((len(plain), table.num_rows), np.uint64), {}
    for lane, at in zip(lanes, plain):
        name = table.schema.names[at]
        read[name] = values = np.ascontiguousarray(table.column(at).to_numpy())
        guess = _guess(name, read)
        lane[:] = values.view(np.uint64) if guess is None else values.view(np.uint64) ^ guess
        if name == "i":
            first = lane[starts]
            lane[1:] = lane[1:] - lane[:-1]
            lane[starts] = first
    head, rest = bytes([len(others), *others]), table.select(others).combine_chunks().to_batches()
    planes = np.ascontiguousarray(lanes.astype("<u8", copy=False).view(np.uint8).reshape(*lanes.shape, 8).transpose(0, 2, 1))
    for start, end in zip(starts, ends):
        tail = rest[0].slice(start, end - start).serialize().to_pybytes() if others else b""
        yield head + planes[:, :, start:end].tobytes() + tail


def _decoded(parts: list[tuple[int, bytes]], schema: pa.Schema) -> pa.Table:
    """The rows (n, encoded) of slices whose other columns are the same ones."""
    others = list(parts[0][1][1 : 1 + parts[0][1][0]])
    plain = sorted((at for at in range(len(schema)) if at not in others), key=lambda at: schema.names[at] in _GUESSED)
    at, i, cuts, rest = 1 + len(others), schema.names.index("i"), [], []
    for n, data in parts:
        cut = np.frombuffer(data, np.uint8, 8 * n * len(plain), at).reshape(len(plain), 8, n)
        cut = np.array(cut.transpose(0, 2, 1), order="C").view("<u8").reshape(len(plain), n).astype(np.uint64, copy=False)
        if i in plain:
            lane = cut[plain.index(i)]
            np.cumsum(lane, out=lane)
        cuts.append(cut)
        if others:
            kept = pa.schema([schema.field(c) for c in others])
            rest.append(pa.ipc.read_record_batch(pa.py_buffer(data[at + cut.nbytes :]), kept))
    lanes, columns, read = np.concatenate(cuts, axis=1), {}, {}
    for lane, c in zip(lanes, plain):
        name = schema.names[c]
        guess = _guess(name, read)
        read[name] = values = (lane if guess is None else lane ^ guess).view(_KINDS[schema.field(c).type])
        columns[c] = pa.array(values)
    if others:
        columns |= dict(zip(others, pa.Table.from_batches(rest).columns))
    return pa.table([columns[c] for c in range(len(schema))], schema=schema)


def _added(table: pa.Table, schema: pa.Schema, keys: list[str], largest: list[str]) -> pa.Table:
    """One row per key; nulls are left out of sums and stay where there is nothing else."""
    how = {c: "max" if c in largest else "sum" for c in schema.names if c not in keys}
    out = table.group_by(keys, use_threads=False).aggregate(list(how.items()))
    return pa.table([out[c if c in keys else f"{c}_{how[c]}"] for c in schema.names], schema.names).cast(schema)


def _dealt(table: pa.Table, keys: list[str], buckets: int) -> pa.RecordBatch:
    """A row per bucket, of the sums that belong to it."""
    bucket = (_hash(table) % np.uint64(buckets)).astype(np.int32)
    by = [pc.fill_null(table[c], -1).to_numpy() for c in ("j", "i")]
    # What else keeps pairs apart, a label, changes least often.
    others = [table[c].combine_chunks().dictionary_encode().indices for c in keys if c not in ("i", "j")]
    order = np.lexsort((*by, *(pc.fill_null(c, -1).to_numpy() for c in others), bucket))
    table = table.take(pa.array(order)).combine_chunks()
    used, starts = np.unique(bucket[order], return_index=True)
    ends = np.append(starts[1:], len(order))
    raw, data = [], []
    for each in _encoded(table, starts, ends):
        raw.append(len(each))
        data.append(pa.compress(each, codec="zstd", asbytes=True))
    columns = [used, ends - starts, raw, data]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["bucket", "n", "raw", "packed"])


def _packed(batches: Iterable[pa.RecordBatch], schema: pa.Schema, keys: list[str], largest: list[str], buckets: int) -> Iterator[pa.RecordBatch]:
    held, n = [], 0

    def flush() -> pa.RecordBatch:
        return _dealt(_added(pa.Table.from_batches(held), schema, keys, largest), keys, buckets)

    for batch in batches:
        if batch.num_rows:
            held.append(batch.cast(schema))
            n += batch.num_rows
        if n >= HELD:
            yield flush()
            held, n = [], 0
    if held:
        yield flush()


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, int, bytes]]]]:
    """Rows (n, raw, packed) of each bucket, from batches sorted by it."""
    now, held = None, []
    for batch in batches:
        for bucket, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if bucket != now and held:
                yield now, held
                held = []
            now = bucket
            held.append(row)
    if held:
        yield now, held


def _parts(rows: list[tuple[int, int, bytes]], schema: pa.Schema) -> Iterator[pa.Table]:
    """The rows of a bucket, many packed ones at a time."""
    held, n = {}, 0
    for size, raw, packed in rows:
        data = pa.decompress(packed, raw, codec="zstd", asbytes=True)
        # By the columns that are packed as they are: those with nulls may differ.
        held.setdefault(data[: 1 + data[0]], []).append((size, data))
        n += size
        if n >= MADE:
            yield from (_decoded(parts, schema) for parts in held.values())
            held, n = {}, 0
    yield from (_decoded(parts, schema) for parts in held.values())


def _summed(batches: Iterable[pa.RecordBatch], schema: pa.Schema, keys: list[str], largest: list[str], buckets: int) -> Iterator[pa.Table]:
    for _, rows in _groups(batches):
        passes = -(-sum(n for n, _, _ in rows) // HELD)
        for turn in range(passes):
            held = []
            for part in _parts(rows, schema):
                if passes > 1:
                    part = part.filter(pa.array(_hash(part) // np.uint64(buckets) % np.uint64(passes) == turn))
                held.append(part)
            yield _added(pa.concat_tables(held), schema, keys, largest)


def _unpacked(batches: Iterable[pa.RecordBatch], schema: pa.Schema, keys: list[str], largest: list[str], buckets: int) -> Iterator[pa.RecordBatch]:
    for table in _summed(batches, schema, keys, largest, buckets):
        yield from table.combine_chunks().to_batches(OUT)


@dataclass
class PackedSums:
    """Sums over pairs as packed rows: `rows` are (bucket, n, raw, packed), `schema` is that of the sums. A pair may have several
    rows until they are added up."""

    rows: DataFrame
    schema: StructType
    keys: list[str]
    largest: list[str]
    buckets: int = BUCKETS

    def _by_bucket(self, task: Callable, out) -> DataFrame:
        schema, keys, largest, buckets = to_arrow_schema(self.schema), self.keys, self.largest, self.buckets
        return (
            self.rows.repartition("bucket")
            .sortWithinPartitions("bucket")
            .mapInArrow(lambda batches: task(batches, schema, keys, largest, buckets), out)
        )

    def sums(self) -> DataFrame:
        """One row per pair."""
        return self._by_bucket(_unpacked, self.schema)

    def materialize(self, name: str) -> PackedSums:
        """Added up, one entry per pair, and written as they are packed."""
        once = self._by_bucket(lambda batches, *how: (_dealt(t, how[1], how[-1]) for t in _summed(batches, *how) if t.num_rows), _ROW)
        return replace(self, rows=materialize(once, name))

    def union(self, other: PackedSums) -> PackedSums:
        if (self.schema, self.keys, self.largest, self.buckets) != (other.schema, other.keys, other.largest, other.buckets):
            raise ValueError("only sums of the same columns are added up")
        return replace(self, rows=self.rows.unionByName(other.rows))


def packed_sums(rows: DataFrame, keys: list[str], largest: list[str] | None = None, buckets: int = BUCKETS) -> PackedSums:
    """`rows` summed inside the tasks that hold them, and packed."""
    out, largest = StructType([StructField(f.name, f.dataType) for f in rows.schema]), largest or []
    schema = to_arrow_schema(out)
    return PackedSums(rows.mapInArrow(lambda batches: _packed(batches, schema, keys, largest, buckets), _ROW), out, keys, largest, buckets)


def pair_sums(rows: DataFrame, keys: list[str], largest: list[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """`rows` grouped by `keys`, which hold i and j: the largest value of the columns `largest`, the sum of all others."""
    return packed_sums(rows, keys, largest, buckets).sums()


# -- pairs of baskets ----------------------------------------------------------------------


class _Side:
    """The lists of one column of a batch, end to end, without entries that have no item: the row, item and fields of each entry."""

    def __init__(self, column: pa.ListArray, in_order: bool):
        entries, sizes = column.flatten(), pc.fill_null(pc.list_value_length(column), 0).to_numpy()
        row = np.repeat(np.arange(len(sizes)), sizes)
        item = entries.field("item_id")
        at = np.flatnonzero(item.is_valid().to_numpy(zero_copy_only=False))
        ids = pc.fill_null(item, 0).to_numpy()
        if in_order:
            at = at[np.lexsort((ids[at], row[at]))]
        self.row, self.item = row[at], ids[at]
        self.fields = pa.Table.from_arrays(entries.flatten(), [f.name for f in entries.type]).take(pa.array(at))
        self.sizes = np.bincount(self.row, minlength=len(sizes))
        self.starts = np.cumsum(self.sizes) - self.sizes


def _met(left: _Side, right: _Side | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Entries that meet, by their places, at most about MADE at a time: each with the later ones of its list or, where there is a
    right side, with all of its row there."""
    if right is None:
        first = np.arange(len(left.row)) + 1
        counts = (left.starts + left.sizes)[left.row] - first
    else:
        first, counts = right.starts[left.row], right.sizes[left.row]
    done = np.concatenate([[0], np.cumsum(counts)])
    start = 0
    while start < len(counts):
        end = max(start + 1, int(np.searchsorted(done, done[start] + MADE, "right")) - 1)
        n = counts[start:end]
        a = np.repeat(np.arange(start, end), n)
        yield a, np.arange(done[end] - done[start]) - np.repeat(done[start:end] - done[start] - first[start:end], n)
        start = end


def _pairs_of(batch: pa.RecordBatch, schema: pa.Schema, extra: list[str], figures: Callable) -> Iterator[pa.RecordBatch]:
    own = batch.filter(pc.is_null(batch["right"]))
    for part, crossed in ((own, False), (batch.filter(pc.is_valid(batch["right"])), True)):
        if not part.num_rows:
            continue
        left = _Side(part["left"], not crossed)
        right = _Side(part["right"], False) if crossed else None
        for a, b in _met(left, right):
            other = right or left
            differ = left.item[a] != other.item[b]
            a, b = a[differ], b[differ]
            if crossed:
                # The lower item first: both sides' entries in one table, the right side's after the left's.
                items, fields = np.concatenate([left.item, right.item]), pa.concat_tables([left.fields, right.fields])
                b = b + len(left.item)
                down = items[a] > items[b]
                i, j = np.where(down, b, a), np.where(down, a, b)
            else:
                items, fields, i, j = left.item, left.fields, a, b
            made, kept = figures(fields, i, j)
            keys = {c: part[c].take(pa.array(left.row[a])) for c in extra} | {"i": pa.array(items[i]), "j": pa.array(items[j])}
            out = pa.table([keys[c] if c in keys else made[c] for c in schema.names], schema.names).cast(schema)
            yield from (out if kept is None else out.filter(pa.array(kept))).combine_chunks().to_batches()


def basket_sums(met: DataFrame, schema: StructType, extra: list[str], figures: Callable, largest: list[str] | None = None, buckets: int = BUCKETS) -> PackedSums:
    """Sums over the pairs of baskets, summed inside the tasks that hold them.

    met: (extra, left, right), lists of structs with an item_id; each entry of `left` meets the others of its list or, if `right` is
    given, all entries there. `figures(fields, i, j)` returns the columns of pairs of entries, given by their places in
    the table `fields`, and which of the pairs count (None: all).
    """
    keys, largest = [*extra, "i", "j"], largest or []
    arrow = to_arrow_schema(schema)

    def task(batches):
        pairs = (p for batch in batches for p in _pairs_of(batch, arrow, extra, figures))
        return _packed(pairs, arrow, keys, largest, buckets)

    return PackedSums(met.select(*extra, "left", "right").mapInArrow(task, _ROW), schema, keys, largest, buckets)


def entry_type(met: DataFrame, field: str):
    """Type of a field of the lists' entries."""
    return met.schema["left"].dataType.elementType[field].dataType


def sums_type(met: DataFrame, extra: list[str], sums: list[str]) -> StructType:
    """The columns of pairs with the figures `sums`."""
    item = entry_type(met, "item_id")
    fields = [(c, met.schema[c].dataType) for c in extra] + [("i", item), ("j", item)]
    return StructType([StructField(*f) for f in [*fields, *((c, LongType() if c == "both" else DoubleType()) for c in sums)]])
