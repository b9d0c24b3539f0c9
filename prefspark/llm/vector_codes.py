"""Product codes of vectors: Lloyd rounds in which settled parts look at moved entries only."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from prefspark.llm.common import fresh
from prefspark.plans.session import materialize

#: Sums of squares below it are exact in double precision.
_EXACT = 1 << 53


# ---- one block of vectors ----


def distances(parts: np.ndarray, entries: np.ndarray, blas: bool) -> np.ndarray:
    """(parts, entries): exact squared distances of whole numbers; `blas` where they are exact in double precision."""
    if blas:
        x, c = parts.astype(float), entries.astype(float)
        return ((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    return np.stack([((parts - c) ** 2).sum(axis=1) for c in entries], axis=1)


def assign(parts: np.ndarray, book: np.ndarray, moved: np.ndarray, code: np.ndarray | None, stored: np.ndarray | None, blas: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """Each part's nearest entry (ties to the lower index), its squared distance, and how many distances were computed.

    A part whose entry has not moved keeps its stored distance, which no unmoved entry beats (an equal one only
    from a higher index), so it is compared with the moved entries only. All others are scanned anew.
    """
    if code is None:
        settled = np.zeros(len(parts), bool)
        code, stored = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    else:
        settled = ~moved[code]
        code, stored = code.copy(), stored.copy()
    active, stay, go = np.flatnonzero(moved), np.flatnonzero(settled), np.flatnonzero(~settled)
    if len(go):
        d = distances(parts[go], book, blas)
        code[go] = d.argmin(axis=1)
        stored[go] = d[np.arange(len(go)), code[go]]
    if len(stay) and len(active):
        d = distances(parts[stay], book[active], blas)
        best = d.argmin(axis=1)
        near, index = d[np.arange(len(stay)), best], active[best]
        better = (near < stored[stay]) | (near == stored[stay]) & (index < code[stay])
        code[stay[better]], stored[stay[better]] = index[better], near[better]
    return code, stored, len(go) * len(book) + len(stay) * len(active)


def updated(book: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Entries as the floors of their parts' means; unused ones stay."""
    return np.where(counts[..., None] > 0, sums // np.maximum(counts, 1)[..., None], book)


class Shape:
    """How whole numbers are held: parts, their length, and the types that hold components and distances."""

    def __init__(self, n_parts: int, longest: int, largest: int):
        self.parts, self.length = n_parts, -(-longest // n_parts)
        farthest = self.length * (2 * largest) ** 2
        if n_parts * farthest >= 1 << 63:
            raise ValueError(f"squared distances of components up to {largest} in {self.length} dimensions leave 63 bits")
        self.blas = 4 * self.length * largest * largest < _EXACT
        self.component = np.dtype("<i2" if largest < 1 << 15 else "<i4" if largest < 1 << 31 else "<i8")
        self.distance = np.dtype("<u4" if farthest < 1 << 32 else "<i8")


_BLOCK = "ids binary, labels binary, vectors binary, codes binary, distances binary, compared bigint, sums binary"
_NULL = pa.binary()


def _whole(values: np.ndarray, scale: int) -> np.ndarray:
    return np.floor(values.astype(float) * scale).astype(np.int64)


def _blocks(batches: Iterable[pa.RecordBatch], shape: Shape, scale: int, block_bytes: int) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    """Ids, labels and whole numbers (rows, parts, length), zeros behind short vectors."""
    width = shape.parts * shape.length
    step = max(1, block_bytes // max(8 * width, 1))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            rows = batch.slice(at, step)
            lists = rows.column(1)
            lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = _whole(lists.flatten().to_numpy(zero_copy_only=False), scale)
            whole = np.zeros((len(lengths), width), np.int64)
            whole[np.arange(width) < lengths[:, None]] = flat
            yield rows.column(0), rows.column(2), whole.reshape(len(lengths), shape.parts, shape.length)


def _packed(column: pa.Array) -> bytes:
    """A column as the bytes of an Arrow stream, nulls included."""
    batch = pa.RecordBatch.from_arrays([column], ["x"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Array:
    return pa.ipc.open_stream(data).read_all()["x"].combine_chunks()


def _row(ids: bytes, labels: bytes, whole: np.ndarray, codes: np.ndarray, stored: np.ndarray, compared: int, entries: int, shape: Shape) -> pa.RecordBatch:
    """A block as one row, with the sums and counts of its parts by entry."""
    sums = np.zeros((shape.parts, entries, shape.length + 1), np.int64)
    for p in range(shape.parts):
        np.add.at(sums[p, :, :-1], codes[:, p], whole[:, p])
        sums[p, :, -1] = np.bincount(codes[:, p], minlength=entries)
    values = [ids, labels, whole.astype(shape.component).tobytes(), codes.astype(np.uint8).tobytes(), stored.astype(shape.distance).tobytes(), compared, sums.tobytes()]
    kinds = [_NULL] * 5 + [pa.int64(), _NULL]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], [c.split()[0] for c in _BLOCK.split(", ")])


def _first(batches, shape: Shape, book: np.ndarray, scale: int, block_bytes: int) -> Iterator[pa.RecordBatch]:
    """Blocks of the table, assigned for the first time."""
    every = np.ones(book.shape[1], bool)
    for ids, labels, whole in _blocks(batches, shape, scale, block_bytes):
        found = [assign(whole[:, p], book[p], every, None, None, shape.blas) for p in range(shape.parts)]
        codes, stored = (np.stack([f[i] for f in found], axis=1) for i in (0, 1))
        yield _row(_packed(ids), _packed(labels), whole, codes, stored, sum(f[2] for f in found), book.shape[1], shape)


def _again(batches, shape: Shape, book: np.ndarray, moved: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Blocks assigned once more, from their stored codes and distances."""
    for batch in batches:
        for i in range(batch.num_rows):
            ids, labels, vectors, codes, stored = (batch.column(c)[i].as_py() for c in range(5))
            codes = np.frombuffer(codes, np.uint8).astype(np.int64).reshape(-1, shape.parts)
            whole = np.frombuffer(vectors, shape.component).astype(np.int64).reshape(len(codes), shape.parts, shape.length)
            stored = np.frombuffer(stored, shape.distance).astype(np.int64).reshape(-1, shape.parts)
            found = [assign(whole[:, p], book[p], moved[p], codes[:, p], stored[:, p], shape.blas) for p in range(shape.parts)]
            codes, stored = (np.stack([f[k] for f in found], axis=1) for k in (0, 1))
            yield _row(ids, labels, whole, codes, stored, sum(f[2] for f in found), book.shape[1], shape)


def _summed(batches) -> Iterator[pa.RecordBatch]:
    """A task's sums, one row per number that isn't 0."""
    total = None
    for batch in batches:
        for data in batch.column(0):
            one = np.frombuffer(data.as_buffer(), np.int64)
            total = one.astype(object) if total is None else total + one
    at = [] if total is None else np.flatnonzero(total)
    values = pa.array([str(total[i]) for i in at], pa.string())
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), values], ["at", "value"])


def _given_out(batches, shape: Shape, id_type: pa.DataType, label_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            ids, labels, codes, stored = (batch.column(c)[i].as_py() for c in range(4))
            rows = np.frombuffer(codes, np.uint8).reshape(-1, shape.parts)
            error = np.frombuffer(stored, shape.distance).astype(np.int64).reshape(-1, shape.parts).sum(axis=1)
            text = rows.tobytes().hex()
            width = 2 * shape.parts
            codes = pa.array([text[k * width : (k + 1) * width] for k in range(len(rows))], pa.string())
            yield pa.RecordBatch.from_arrays([_unpacked(ids).cast(id_type), _unpacked(labels).cast(label_type), codes, pa.array(error)], ["vec_id", "label", "code", "error"])


# ---- Spark ----


class Codes:
    """Codebooks of `entries` entries for `parts` consecutive parts of the vectors of a table, and the vectors' codes.

    Components x become floor(`scale` * x). Vectors that are null or hold null or non-finite components are left out.
    Every part position's codebook starts as that part of the vectors with the `entries` smallest ids, ascending (of
    rows that repeat an id the least vector; null ids have no part in it), and goes through `rounds` rounds:
    all parts go to their nearest entry, entries go to the floors of their parts' means, unused ones stay. Then parts
    are assigned once more. All numbers are whole and exact.

    A vector that is shorter than the longest, or of a length that `parts` doesn't divide, counts with zeros behind
    it, an empty one as zeros only. Components whose squared distances leave 63 bits raise a ValueError. Fewer kept
    ids than `entries` make smaller codebooks; without any there are no rows.

    Vectors are kept in blocks of about `block_bytes`, one row each, with codes and squared distances; a round reads the
    last round's blocks, compares what can have changed (`assign`), and writes them again with sums by entry, from
    which Spark adds up the new codebooks. No row leaves its task; the driver gets the codebooks, whose size is fixed.
    """

    def __init__(self, vectors: DataFrame, id_column: str, vector_column: str, label_column: str | None, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, block_bytes: int = 4 << 20):
        label = F.lit(None).cast("int") if label_column is None else F.col(label_column)
        bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
        rows = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).alias("x"), label.alias("label")).where(F.col("x").isNotNull() & ~bad)
        self.kinds = rows.schema["id"].dataType, rows.schema["label"].dataType
        size = rows.agg(
            F.coalesce(F.max(F.size("x")), F.lit(0)).alias("longest"),
            F.max(F.array_max(F.transform("x", lambda v: F.abs(F.floor(v.cast("double") * scale).cast("double"))))).alias("largest"),
        ).first()
        if (size.largest or 0) >= 1 << 62:
            raise ValueError("components leave 63 bits")
        self.shape = shape = Shape(parts, size.longest, int(size.largest or 0))
        firsts = rows.where("id IS NOT NULL").groupBy("id").agg(F.min("x").alias("x")).orderBy("id").limit(entries).collect()
        book = np.zeros((len(firsts), parts * shape.length), np.int64)
        for i, row in enumerate(firsts):
            book[i, : len(row.x)] = _whole(np.array(row.x, float), scale)
        self.book = book.reshape(len(firsts), parts, shape.length).transpose(1, 0, 2).copy()
        #: Distances computed in each pass.
        self.blocks, moved = None, None
        if not len(firsts):
            return
        for _ in range(rounds + 1):
            now, active, before = self.book, moved, self.blocks
            if before is None:
                step = rows.mapInArrow(lambda batches: _first(batches, shape, now, scale, block_bytes), _BLOCK)  # noqa: B023
            else:
                read = before.select("ids", "labels", "vectors", "codes", "distances")
                step = read.mapInArrow(lambda batches: _again(batches, shape, now, active), _BLOCK)  # noqa: B023
            self.blocks = materialize(step, "codes-blocks")
            if _ == rounds:
                return
            total = np.zeros(parts * now.shape[1] * (shape.length + 1), object)
            summed = self.blocks.select("sums").mapInArrow(_summed, "at int, value string")
            for row in summed.groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect():
                total[row["at"]] = int(row.value)
            sums = total.reshape(parts, now.shape[1], shape.length + 1)
            self.book = updated(now, sums[..., :-1], sums[..., -1]).astype(np.int64)
            moved = (self.book != now).any(axis=2)

    def digest(self) -> str:
        """SHA-256 of all entries' components by part, entry and position, as decimal numbers joined by commas."""
        return hashlib.sha256(",".join(map(str, self.book.reshape(-1).tolist())).encode()).hexdigest()

    def compared(self) -> int:
        """Distances that the last pass computed."""
        return self.blocks.agg(F.sum("compared")).first()[0] or 0

    def rows(self) -> DataFrame:
        """(vec_id, label, code, error): a row per kept vector."""
        from pyspark.sql.pandas.types import to_arrow_type
        from pyspark.sql.types import StructType

        schema = StructType().add("vec_id", self.kinds[0]).add("label", self.kinds[1]).add("code", "string").add("error", "long")
        shape, (id_type, label_type) = self.shape, map(to_arrow_type, self.kinds)
        if self.blocks is None:
            return None
        return self.blocks.select("ids", "labels", "codes", "distances").mapInArrow(lambda batches: _given_out(batches, shape, id_type, label_type), schema)


def encode_vectors(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", **options) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) for every kept row of `vectors`; see `Codes`.

    code: two hex digits for each part's entry; error: the final squared distances added up over the parts;
    label_error: the errors added up over rows with an equal label, nulls together. Repeated rows are coded each.
    Other columns are not read. An empty table gives no rows.
    """
    codes = Codes(vectors, id_column, vector_column, label_column, **options)
    if codes.blocks is None:
        empty = vectors.sparkSession.createDataFrame([], "code string, error bigint, label_error bigint, codebooks_sha256 string")
        return vectors.where("false").select(F.col(id_column).alias("vec_id")).join(empty, F.lit(True))
    rows = codes.rows()
    of = fresh(rows, "of_label")
    by_label = rows.groupBy(F.col("label").alias(of)).agg(F.sum("error").alias("label_error"))
    return rows.join(by_label, rows.label.eqNullSafe(by_label[of])).select("vec_id", "code", "error", "label_error", F.lit(codes.digest()).alias("codebooks_sha256"))
