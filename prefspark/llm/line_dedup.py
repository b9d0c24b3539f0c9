"""Lines that many documents share, found by probing a sharded minimal perfect hash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from prefspark.llm.common import BLANK, fresh, lean, runs, slices
from prefspark.plans.session import materialize

_U = np.uint64


# ---- lines ----


def line_key(line: str, min_chars: int) -> tuple[int, int] | None:
    """The 128-bit hash of a line's key as two signed longs; None for a key that is too short."""
    stripped = line.strip(BLANK)
    if len(stripped) < min_chars:
        return None
    # bytes.lower() changes A-Z only.
    high, low = divmod(xxhash.xxh3_128_intdigest(stripped.encode("utf-8", "surrogatepass").lower()), 1 << 64)
    return high - (1 << 63), low - (1 << 63)


def _keys_of(batches, min_chars: int):
    for batch in slices(batches, "text", 16 << 20):
        ids, high, low = [], [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            keys = {line_key(line, min_chars) for line in (text or "").split("\n")}
            keys.discard(None)
            ids += [doc] * len(keys)
            high += [k[0] for k in keys]
            low += [k[1] for k in keys]
        yield pa.RecordBatch.from_arrays(
            [pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(ids, pa.int64())], ["h1", "h2", "doc"]
        )


# ---- minimal perfect hash ----


def _places(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    x = h1 ^ (h2 * _U(0x9E3779B97F4A7C15))
    x = x + _U((level + 1) * 0xD6E8FEB86659FD93 % (1 << 64))
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> _U(32))) % _U(size)).astype(np.int64)


def build_index(h1: np.ndarray, h2: np.ndarray) -> tuple[list[int], bytes, np.ndarray]:
    """Bit levels of a minimal perfect hash of distinct keys, and each key's slot.

    A key takes the first level where it has a place of its own; its slot is the number of taken places
    before it. Two bits per pending key and level, so the keys left shrink by 0.4 from level to level.
    """
    slots = np.empty(len(h1), np.int64)
    pending, sizes, packed, base = np.arange(len(h1)), [], [], 0
    while len(pending):
        size = max(64, 2 * len(pending))
        place = _places(h1[pending], h2[pending], len(sizes), size)
        alone = np.bincount(place, minlength=size)[place] == 1
        bits = np.zeros(size, bool)
        bits[place[alone]] = True
        slots[pending[alone]] = base + np.cumsum(bits)[place[alone]] - 1
        base += int(alone.sum())
        sizes.append(size)
        packed.append(np.packbits(bits).tobytes())
        pending = pending[~alone]
    return sizes, b"".join(packed), slots


class Index:
    """A shard ready to be probed: levels of bits with their ranks, fingerprints, counts and keepers."""

    def __init__(self, sizes, bits, fingerprints, counts, keepers):
        self.levels, at, base = [], 0, 0
        for size in sizes:
            n = (size + 7) // 8
            level = np.unpackbits(np.frombuffer(bits[at : at + n], np.uint8))[:size].astype(bool)
            rank = np.cumsum(level, dtype=np.int64) + base
            self.levels.append((level, rank))
            at, base = at + n, base + int(level.sum())
        self.fingerprints = np.frombuffer(fingerprints, np.int64)
        self.counts = np.frombuffer(counts, np.int64)
        self.keepers = np.frombuffer(keepers, np.int64)

    def slots(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Each key's slot, -1 for a key the shard doesn't hold."""
        a, b = h1.view(_U), h2.view(_U)
        found, pending = np.full(len(h1), -1), np.arange(len(h1))
        for i, (level, rank) in enumerate(self.levels):
            place = _places(a[pending], b[pending], i, len(level))
            hit = level[place]
            found[pending[hit]] = rank[place[hit]] - 1
            pending = pending[~hit]
        at = np.flatnonzero(found >= 0)
        found[at[self.fingerprints[found[at]] != h2[at]]] = -1
        return found


_SHARD = "shard int, sizes array<bigint>, bits binary, fingerprints binary, counts binary, keepers binary"
#: Stands for a null doc_id, an id below all others.
_NO_ID = -(1 << 63)


def _build(batches):
    for rows in runs(batches, ["shard"]):
        h1, h2, n, keep = (rows.column(c).to_numpy() for c in ("h1", "h2", "n_docs", "keeper"))
        sizes, bits, slots = build_index(h1.view(_U), h2.view(_U))
        order = np.argsort(slots)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([rows.column("shard")[0].as_py()], pa.int32()),
                pa.array([sizes], pa.list_(pa.int64())),
                *(pa.array([x], pa.binary()) for x in (bits, h2[order].tobytes(), n[order].tobytes(), keep[order].tobytes())),
            ],
            ["shard", "sizes", "bits", "fingerprints", "counts", "keepers"],
        )


def _probe(batches, min_docs: int):
    """Rows come sorted by shard and salt, the shard's arrays first: one shard is held, requests pass through.

    A key is lost where its slot's count reaches `min_docs` and another document keeps it.
    """
    index, cell = None, None
    for batch in batches:
        column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        shard, salt, kind = (column[c].to_numpy() for c in ("shard", "salt", "kind"))
        if not len(kind):
            continue
        cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(salt) != 0) | (np.diff(kind) != 0) | (kind[1:] == 0)) + 1
        for start, end in zip([0, *cuts], [*cuts, len(kind)]):
            if kind[start] == 0:
                row = {c: column[c][int(start)].as_py() for c in ("sizes", "bits", "fingerprints", "counts", "keepers")}
                index, cell = Index(**row), (shard[start], salt[start])
                continue
            if index is None or cell != (shard[start], salt[start]):
                continue
            h1, h2, doc = (column[c].slice(start, end - start).to_numpy() for c in ("h1", "h2", "doc"))
            slot = index.slots(h1, h2)
            lost = np.flatnonzero((slot >= 0) & (index.counts[slot] >= min_docs) & (index.keepers[slot] != doc))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[lost], pa.int64()) for x in (doc, h1, h2)] + [pa.array(index.counts[slot[lost]], pa.int64())],
                ["doc", "h1", "h2", "n_docs"],
            )


def shared_lines(docs: DataFrame, id_column: str, text_column: str, min_chars: int, min_docs: int, keys_per_shard: int, requests_per_cell: int):
    """(doc, h1, h2, n_docs): the line keys each document loses."""
    keys = materialize(
        docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(_NO_ID)).alias("doc"), F.col(text_column).alias("text"))
        .mapInArrow(lean(lambda batches: _keys_of(batches, min_chars)), "h1 bigint, h2 bigint, doc bigint"),
        "line-keys",
    )
    counted = materialize(keys.distinct().groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc").alias("keeper")), "line-counts")
    n_shards = max(1, -(-counted.count() // keys_per_shard))
    salts = max(1, -(-keys.count() // (n_shards * requests_per_cell)))
    shard = F.pmod("h1", F.lit(n_shards)).cast("int").alias("shard")
    index = materialize(
        counted.withColumn("shard", shard).repartition("shard").sortWithinPartitions("shard").mapInArrow(lean(_build), _SHARD), "line-index"
    )
    nothing = {c: F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in _SHARD.split(", ")[1:])}
    arrays = index.select(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("kind"), *nothing,
        *(F.lit(0).cast("long").alias(c) for c in ("h1", "h2", "doc")),
    )
    requests = keys.select(
        shard, F.pmod(F.xxhash64("doc"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("kind"), *nothing.values(), "h1", "h2", "doc"
    )
    return (
        arrays.unionByName(requests)
        .repartition("shard", "salt")
        .sortWithinPartitions("shard", "salt", "kind")
        .mapInArrow(lean(lambda batches: _probe(batches, min_docs)), "doc bigint, h1 bigint, h2 bigint, n_docs bigint")
    )


def _strip(batches, text_at: int, lost_at: int, min_chars: int, lines_name: str, dropped_name: str):
    for batch in batches:
        texts, lines, dropped = [], [], []
        for text, lost in zip(batch.column(text_at).to_pylist(), batch.column(lost_at).to_pylist()):
            all_lines = (text or "").split("\n")
            if lost:
                gone = {(x["h1"], x["h2"]) for x in lost}
                kept = [line for line in all_lines if line_key(line, min_chars) not in gone]
            else:
                kept = all_lines
            texts.append("\n".join(kept))
            lines.append(len(all_lines))
            dropped.append(len(all_lines) - len(kept))
        columns = [pa.array(texts, pa.string()) if i == text_at else c for i, c in enumerate(batch.columns) if i != lost_at]
        names = [n for i, n in enumerate(batch.schema.names) if i != lost_at]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], [*names, lines_name, dropped_name]
        )


def dedup_lines(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    min_chars: int = 40,
    min_docs: int = 5,
    keys_per_shard: int = 100_000,
    requests_per_cell: int = 200_000,
    lines_column: str = "n_lines",
    dropped_column: str = "n_dropped",
) -> DataFrame:
    r"""`docs` without the lines they share with many others, and the numbers of lines and of dropped lines.

    A line's key is the line stripped of [\x20\x09-\x0D] at both ends, A-Z lower-cased. Keys of at least
    `min_chars` code points that `min_docs` documents hold lose their lines in all documents but the one
    with the largest id; there all of them stay. Other lines stay as they are, joined by \n.

    Distinct (key, document) pairs are counted with partial sums. All keys are cut into shards of
    about `keys_per_shard`; each becomes a minimal perfect hash with arrays of 64-bit fingerprints, counts
    and keepers, stored as one row of a table in the shared folder. Documents send their keys' hashes to
    the shards; a shard is repeated for every `requests_per_cell` of them, so that a line which a third of
    the documents hold is spread, and a task holds one shard and streams the requests. The answers, only
    lines to drop, are joined to the documents.

    Null and empty texts are one empty line; null becomes "". A null id is below all other ids, and rows
    with the same id are one document. An empty table gives no rows. Other columns are kept; result columns
    replace columns of the same name.
    """
    lost = fresh(docs, "lost")
    key = fresh(docs, "doc")
    drops = (
        shared_lines(docs, id_column, text_column, min_chars, min_docs, keys_per_shard, requests_per_cell)
        .groupBy(F.col("doc").alias(key))
        .agg(F.collect_set(F.struct("h1", "h2")).alias(lost))
    )
    kept = [c for c in docs.columns if c not in (lines_column, dropped_column)]
    joined = docs.join(drops, F.coalesce(docs[id_column].cast("long"), F.lit(_NO_ID)) == drops[key], "left").select(
        *(docs[c] for c in kept), drops[lost]
    )
    text_at, lost_at = kept.index(text_column), len(kept)
    schema = docs.select(*kept).schema.add(lines_column, "long").add(dropped_column, "long")
    return joined.mapInArrow(lean(lambda batches: _strip(batches, text_at, lost_at, min_chars, lines_column, dropped_column)), schema)
