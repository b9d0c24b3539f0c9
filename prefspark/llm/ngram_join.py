"""Documents that share most of their word shingles, found by T-occurrence search with DivideSkip."""

from __future__ import annotations

import heapq
import math
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from prefspark.llm.common import fresh, lean, runs, slices
from prefspark.llm.components import connected_components
from prefspark.plans.session import materialize

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_U = np.uint64


# ---- shingles ----


def shingles(text: str | None, size: int, words_seen: dict[bytes, int]) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles of `size` words; fewer words are one shingle.

    `words_seen` keeps words' hashes for other texts.
    """
    words = _WORD.findall((text or "").encode().lower())
    if not words:
        return np.zeros(0, _U)
    if len(words_seen) > 200_000:
        words_seen.clear()
    for word in set(words).difference(words_seen):
        words_seen[word] = xxhash.xxh3_64_intdigest(word)
    h = np.fromiter(map(words_seen.__getitem__, words), _U, len(words))
    width = min(size, len(words))
    last = len(words) - width + 1
    out = np.full(last, width * 0x9E3779B97F4A7C15 % (1 << 64), _U)
    for i in range(width):
        out = (out ^ h[i : i + last]) * _U(0xD6E8FEB86659FD93)
        out ^= out >> _U(32)
    return np.unique(out * _U(0xBF58476D1CE4E5B9))


def _sets(batches: Iterable[pa.RecordBatch], text_at: int, size: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    seen: dict[bytes, int] = {}
    for batch in slices(batches, "text", 4 << 20):
        yield batch, [shingles(text, size, seen) for text in batch.column(text_at).to_pylist()]


def _digest(found: np.ndarray) -> tuple[int, int]:
    high, low = divmod(xxhash.xxh3_128_intdigest(found.tobytes()), 1 << 64)
    return high - (1 << 63), low - (1 << 63)


# ---- how common a shingle is ----

#: log2 of the parts in which shingles are counted, of the bits that mark repeated shingles, and of the levels.
BUCKETS, BITS, LEVELS = 14, 26, 22


class Rarity:
    """What all tasks know of all shingles: a mark for those that two or more sets have, and a level for
    common ones, both by the first bits of the hash. Its size is fixed; a full table orders by hash alone.
    """

    def __init__(self, marks: np.ndarray, levels: np.ndarray):
        self.marks, self.levels = marks, levels

    @staticmethod
    def of(regions: dict[int, tuple[bytes, bytes]]) -> Rarity:
        marks, levels = np.zeros(1 << BITS - 3, np.uint8), np.zeros(1 << LEVELS, np.uint8)
        for bucket, (own_marks, own_levels) in regions.items():
            for whole, own in ((marks, own_marks), (levels, own_levels)):
                whole[bucket * len(own) : (bucket + 1) * len(own)] = np.frombuffer(own, np.uint8)
        return Rarity(marks, levels)

    def prefix(self, found: np.ndarray, percent: int) -> np.ndarray:
        """The shingles of a set's prefix that other sets may have.

        All sets are ordered alike: unmarked shingles, then marked ones by level and hash. Unmarked ones are
        in one set only and stand for themselves.
        """
        slot = (found >> _U(64 - BITS)).astype(np.int64)
        marked = (self.marks[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
        shared = found[marked]
        left = prefix_length(len(found), percent) - (len(found) - len(shared))
        if left <= 0:
            return shared[:0]
        level = self.levels[(shared >> _U(64 - LEVELS)).astype(np.int64)]
        return shared[np.lexsort((shared, level))[:left]]


def region(bucket: int, hashes: np.ndarray) -> tuple[bytes, bytes]:
    """The marks and levels of a bucket, from the shingles of all sets (a shingle as often as sets have it)."""
    marks, levels = np.zeros(1 << BITS - BUCKETS, bool), np.zeros(1 << LEVELS - BUCKETS, np.uint8)
    values, times = np.unique(hashes, return_counts=True)
    values, times = values[times > 1], times[times > 1]
    marks[(values >> _U(64 - BITS)).astype(np.int64) - (bucket << BITS - BUCKETS)] = True
    at = (values >> _U(64 - LEVELS)).astype(np.int64) - (bucket << LEVELS - BUCKETS)
    np.maximum.at(levels, at, (np.log2(times) * 2).astype(np.uint8))
    return np.packbits(marks, bitorder="little").tobytes(), levels.tobytes()


def _counted(batches, size: int) -> Iterator[pa.RecordBatch]:
    """A task's shingles by bucket, sorted and with their bytes in planes, so that equal leading bytes compress."""
    held, n, seen = [], 0, set()

    def flush():
        hashes = np.sort(np.concatenate(held))
        ends = np.searchsorted(hashes >> _U(64 - BUCKETS), np.arange((1 << BUCKETS) + 1, dtype=_U))
        used = np.flatnonzero(np.diff(ends))
        planes = [np.ascontiguousarray(hashes[ends[b] : ends[b + 1]].view(np.uint8).reshape(-1, 8).T).tobytes() for b in used]
        return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(planes, pa.binary())], ["bucket", "hashes"])

    for _, sets in _sets(batches, 0, size):
        for found in sets:
            digest = _digest(found)
            if len(found) and digest not in seen:
                seen.add(digest)
                held.append(found)
                n += len(found)
        if n > 1_000_000:
            yield flush()
            held, n = [], 0
    if held:
        yield flush()


def _regions(batches) -> Iterator[pa.RecordBatch]:
    for group in runs(batches, ["bucket"]):
        bucket = group.column("bucket")[0].as_py()
        planes = [np.frombuffer(x.as_buffer(), np.uint8).reshape(8, -1) for x in group.column("hashes")]
        marks, levels = region(bucket, np.ascontiguousarray(np.concatenate(planes, axis=1).T).reshape(-1).view(_U))
        columns = [pa.array([bucket], pa.int32()), pa.array([marks], pa.binary()), pa.array([levels], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["bucket", "marks", "levels"])


def rarity_of(texts: DataFrame, size: int) -> Rarity:
    """Count the shingles of all sets; the driver gets 2^BITS bits and 2^LEVELS bytes, whatever the corpus."""
    counted = (
        texts.mapInArrow(lean(lambda batches: _counted(batches, size)), "bucket int, hashes binary")
        .repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(lean(_regions), "bucket int, marks binary, levels binary")
        .toArrow()
    )
    return Rarity.of({b: (m, v) for b, m, v in zip(*(counted[c].to_pylist() for c in ("bucket", "marks", "levels")))})


# ---- search ----


def least_overlap(x: int, y: int, percent: int) -> int:
    """Shared shingles that sets of x and y need for 100 * shared >= percent * union."""
    return -(-percent * (x + y) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    """Sets that overlap enough share a shingle among so many first ones of a common order."""
    return n - -(-percent * n // 100) + 1 if n else 0


def merge_skip(lists: list[Sequence[int]], needed: int) -> Iterator[tuple[int, int]]:
    """(value, lists that hold it) for values in `needed` or more sorted lists.

    A heap has every list's next value. A value popped too seldom takes others with it until `needed` - 1
    lists are out; these jump by binary search to the next value on the heap.
    """
    heap = [(values[0], i, 0) for i, values in enumerate(lists) if values]
    heapq.heapify(heap)
    while len(heap) >= needed:
        value = heap[0][0]
        out = []
        while heap and heap[0][0] == value:
            out.append(heapq.heappop(heap))
        if len(out) >= needed:
            yield value, len(out)
            following = [(i, at + 1) for _, i, at in out]
        else:
            while heap and len(out) < needed - 1:
                out.append(heapq.heappop(heap))
            if not heap:
                return  # fewer than `needed` lists are left
            goal = heap[0][0]
            following = [(i, bisect_left(lists[i], goal, at)) for _, i, at in out]
        for i, at in following:
            if at < len(lists[i]):
                heapq.heappush(heap, (lists[i][at], i, at))


class Forest:
    """Union-find over small integers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def union(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def linked_pairs(
    sets: list[np.ndarray], sides: list[int] | None = None, percent: int = 85, spanning: bool = True, mu: float = 0.0085
) -> list[tuple[int, int]]:
    """Links among `sets`, sorted arrays without repeats (between the two sides only, if there are any).

    Every set is a query against the inverted lists of the sets before it in the order of sizes. DivideSkip
    leaves the query's longest lists out: the short ones are merged by `merge_skip` for candidates in enough
    of them, and a candidate is counted in the long ones by binary search. With `spanning`, candidates that are
    already connected with the query are not counted: the pairs returned span the same components.
    """
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), i))
    sizes = [len(sets[i]) for i in order]
    side = [0] * len(order) if sides is None else [sides[i] for i in order]
    # Only shingles of two or more sets can be shared; they are numbered and get their lists.
    values, inverse, times = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True, return_counts=True)
    number = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[inverse]
    common = [x[x >= 0] for x in np.split(number, np.cumsum(sizes)[:-1])]
    owner = np.repeat(np.arange(len(order)), [len(x) for x in common])
    flat = np.concatenate(common)
    ends = np.cumsum(times[times > 1])
    # Compact arrays: a list of numbers would take ten times their room.
    postings = [array("i", x.tobytes()) for x in np.split(owner[np.argsort(flat, kind="stable")].astype(np.intc), ends[:-1])] if len(ends) else []
    forest, pairs = Forest(len(order)), []
    for place, held in enumerate(common):
        n = sizes[place]
        low = bisect_left(sizes, -(-percent * n // 100))
        if low >= place:
            continue  # nothing before is large enough
        needed = least_overlap(sizes[low], n, percent)
        if len(held) < needed:
            continue
        by_length = sorted(held.tolist(), key=lambda v: len(postings[v]))
        skipped = min(int(needed / (mu * math.log2(len(postings[by_length[-1]])) + 1)), needed - 1)
        short, long_ = by_length[: len(by_length) - skipped], np.array(by_length[len(by_length) - skipped :], np.int64)
        lists = (postings[v][bisect_left(postings[v], low) : bisect_left(postings[v], place)] for v in short)
        for other, shared in merge_skip([x for x in lists if x], needed - skipped):
            if sides is not None and side[other] == side[place] or spanning and forest.find(other) == forest.find(place):
                continue
            if shared + _shared(long_, common[other]) >= least_overlap(sizes[other], n, percent):
                forest.union(other, place)
                pairs.append((order[other], order[place]))
    return pairs


def _shared(values: np.ndarray, found: np.ndarray) -> int:
    """How many of `values` are in the sorted array, by binary search."""
    if not len(found):
        return 0
    at = np.searchsorted(found, values)
    return int((found[np.minimum(at, len(found) - 1)] == values).sum())


# ---- Spark ----


_SCANNED = "doc bigint, n bigint, d1 bigint, d2 bigint, shingle bigint"


def _scanned(batches, size: int, percent: int, shared) -> Iterator[pa.RecordBatch]:
    """Every row's set by its size and 128-bit digest, and the prefixes of sets: (n, d1, shingle), once per task for copies."""
    rarity, seen = Rarity(*shared.value), set()
    names = [c.split()[0] for c in _SCANNED.split(", ")]
    for batch, sets in _sets(batches, 1, size):
        digests = [_digest(s) for s in sets]
        docs = batch.column(0).to_pylist()
        columns = [docs, [len(s) for s in sets], [d[0] for d in digests], [d[1] for d in digests], [None] * len(sets)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)
        firsts, keys, sizes = [], [], []
        for doc, found, digest in zip(docs, sets, digests):
            if doc is None or not len(found) or digest in seen:
                continue
            seen.add(digest)
            first = rarity.prefix(found, percent)
            firsts.append(first.view(np.int64))
            keys.append(np.full(len(first), digest[0]))
            sizes.append(np.full(len(first), len(found)))
        if firsts:
            first, key, n = (pa.array(np.concatenate(x), pa.int64()) for x in (firsts, keys, sizes))
            blank = pa.nulls(len(first), pa.int64())
            yield pa.RecordBatch.from_arrays([blank, n, key, blank, first], names)


_CELLS = "array<struct<key:bigint,low:int,high:int,side:int>>"
_PLACED = "key bigint, low int, high int, side int, node bigint, shingles binary"
_PLACED_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]


def _bitmap(members: DataFrame) -> tuple[bytes, int]:
    """A bit for the hash of every member's id, and the number of bits: 16 or more for each, 2^24 at most.

    It only saves the shuffle of other texts; a full one lets all of them pass.
    """
    bits = min(1 << 24, max(1 << 16, 1 << (16 * members.count()).bit_length()))
    slot = F.xxhash64("node").bitwiseAND(bits - 1)
    words = members.select(F.shiftright(slot, 6).alias("word"), F.expr("shiftleft(1L, cast(xxhash64(node) & 63 AS INT))").alias("bit"))
    held = words.groupBy("word").agg(F.bit_or("bit").alias("held")).toArrow()
    out = np.zeros(bits // 64, "<i8")
    out[held["word"].to_numpy()] = held["held"].to_numpy()
    return out.tobytes(), bits


def _candidates(batches, shared) -> Iterator[pa.RecordBatch]:
    bits = np.frombuffer(shared.value, np.uint8)
    for batch in batches:
        slot = batch.column(2).to_numpy()
        kept = bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1 == 1
        yield pa.RecordBatch.from_arrays(batch.columns[:2], ["doc", "text"]).filter(pa.array(kept))


def _placed(batches, size: int) -> Iterator[pa.RecordBatch]:
    """The sets of the rows that have the class's digest (a repeated id may have other texts), once for each of their cells."""

    def batch_of(rows):
        columns = list(zip(*rows)) if rows else [()] * len(_PLACED_TYPES)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _PLACED_TYPES)], [c.split()[0] for c in _PLACED.split(", ")])

    for batch, sets in _sets(batches, 4, size):
        rows, held = [], 0
        for node, d1, d2, cells, found in zip(*(batch.column(i).to_pylist() for i in range(4)), sets):
            if _digest(found) != (d1, d2):
                continue
            data = found.tobytes()
            for cell in cells:
                rows.append((*cell.values(), node, data))
                held += len(data)
                if held > 16 << 20:
                    yield batch_of(rows)
                    rows, held = [], 0
        yield batch_of(rows)


def _search(batches, percent: int, spanning: bool) -> Iterator[pa.RecordBatch]:
    a, b = [], []
    for cell in runs(batches, ["key", "low", "high"]):
        nodes, sides = cell.column("node").to_pylist(), cell.column("side").to_pylist()
        inner = cell.column("low")[0].as_py() == cell.column("high")[0].as_py()
        sets = [np.frombuffer(x.as_buffer(), _U) for x in cell.column("shingles")]
        for x, y in linked_pairs(sets, None if inner else sides, percent, spanning):
            a.append(nodes[x])
            b.append(nodes[y])
        if len(a) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
            a, b = [], []
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


class JaccardJoin:
    """Links between the documents of a table: 100 * shared shingles >= `percent` * shingles of either.

    A document's set is its distinct shingles of `size` words (`[^\\x20\\x09-\\x0D]+`, A-Z lower-cased); fewer
    words are one shingle, none are an empty set, which is linked with nothing. Rows without id are linked
    with nothing; rows that repeat an id are one document, whatever their texts.

    Rows with equal sets are one class. Sets of the size of a link share a shingle among their first ones
    in an order from rare to common, so each such shingle's list of classes holds the candidates. The order
    comes from counts of all shingles (`Rarity`); one that no other set has needs no list. Lists with the same least
    class are one cell, which gets each of their sets once. A cell of more than `cell_shingles` shingles or
    `cell_sets` sets is dealt into chunks, and every pair of chunks is a cell, so a task holds two chunks
    whatever the lists. A cell is searched by `linked_pairs`.
    """

    def __init__(
        self, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = 4, percent: int = 85, cell_shingles: int = 500_000, cell_sets: int = 1000
    ):
        self.size, self.percent, self.cell, self.cell_sets = size, percent, cell_shingles, cell_sets
        self.rows = docs.select(F.col(id_column).cast("long").alias("doc"), F.col(text_column).alias("text"))
        context = docs.sparkSession.sparkContext
        rarity = rarity_of(self.rows.where("doc IS NOT NULL").select("text"), size)
        # Plain arrays: the workers need not have this package.
        shared = context.broadcast((rarity.marks, rarity.levels))
        scanned = materialize(self.rows.mapInArrow(lean(lambda batches: _scanned(batches, size, percent, shared)), _SCANNED), "join-sets")
        shared.destroy()
        #: (doc, n, d1, d2) of every row.
        self.described = scanned.where("shingle IS NULL").select("doc", "n", "d1", "d2")
        #: (shingle, d1, n): the inverted lists' entries.
        self.prefixes = scanned.where("shingle IS NOT NULL").select("shingle", "d1", "n")
        #: (d1, d2, node): the smallest id with each set.
        self.classes = materialize(
            self.described.where("n > 0 AND doc IS NOT NULL").groupBy("d1", "d2").agg(F.min("doc").alias("node")), "join-classes"
        )

    def links(self, spanning: bool = False) -> DataFrame:
        """(a, b), a < b: linked class representatives; with `spanning` only enough of them to connect the same."""
        size, percent = self.size, self.percent
        members = materialize(self._cells(), "join-members")
        bits, slots = _bitmap(members)
        shared = members.sparkSession.sparkContext.broadcast(bits)
        texts = self.rows.select("doc", "text", F.xxhash64("doc").bitwiseAND(slots - 1).alias("slot")).mapInArrow(
            lean(lambda batches: _candidates(batches, shared)), "doc bigint, text string"
        )
        found = (
            members.join(texts, members.node == texts.doc)
            .select("node", "d1", "d2", "cells", "text")
            .mapInArrow(lean(lambda batches: _placed(batches, size)), _PLACED)
            .repartition("key", "low", "high")
            .sortWithinPartitions("key", "low", "high")
            .mapInArrow(lean(lambda batches: _search(batches, percent, spanning)), "a bigint, b bigint")
        )
        return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()

    def _cells(self) -> DataFrame:
        """(node, d1, d2, cells): the cells of every class that has candidates."""
        lists = self.prefixes.groupBy("shingle").agg(F.min("d1").alias("lowest"), F.max("d1").alias("highest")).where("lowest < highest").select("shingle", "lowest")
        entries = materialize(self.prefixes.join(lists, "shingle").select("lowest", "d1", "n").distinct(), "join-entries")
        chunks = F.ceil(F.greatest(F.sum("n") / self.cell, F.count("*") / self.cell_sets)).cast("int")
        side = F.pmod(F.xxhash64("d1"), F.col("chunks")).cast("int")
        cells = (
            entries.join(entries.groupBy("lowest").agg(chunks.alias("chunks")), "lowest")
            .withColumn("side", side)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
            .select("d1", F.struct(F.col("lowest").alias("key"), F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "side").alias("cell"))
            .groupBy("d1")
            .agg(F.collect_list("cell").cast(_CELLS).alias("cells"))
        )
        return self.classes.join(cells, "d1").select("node", "d1", "d2", "cells")

    def components(self) -> DataFrame:
        """(doc_id, n_shingles, class_id, component_id) for every row: the smallest id with the same set, and
        the smallest id reachable by links."""
        grouped = connected_components(self.links(spanning=True).unionByName(self._same_ids())).withColumnRenamed("node", "of")
        named = self.classes.join(grouped, F.col("node") == F.col("of"), "left").select(
            F.col("d1").alias("c1"), F.col("d2").alias("c2"), "node", F.coalesce("component", "node").alias("component")
        )
        known = (F.col("d1") == F.col("c1")) & (F.col("d2") == F.col("c2")) & F.col("doc").isNotNull()
        return self.described.join(named, known, "left").select(
            F.col("doc").alias("doc_id"),
            F.col("n").alias("n_shingles"),
            F.coalesce("node", "doc").alias("class_id"),
            F.coalesce("component", "doc").alias("component_id"),
        )

    def _same_ids(self) -> DataFrame:
        """Edges between the classes of ids that have several texts."""
        several = self.described.where("n > 0 AND doc IS NOT NULL").groupBy("doc").agg(F.count("*").alias("k")).where("k > 1")
        return (
            self.described.join(several.select(F.col("doc").alias("of")), F.col("doc") == F.col("of"))
            .where("n > 0")
            .join(self.classes, ["d1", "d2"])
            .select(F.col("doc").alias("a"), F.col("node").alias("b"))
            .where("a <> b")
            .distinct()
        )


def ngram_components(docs: DataFrame, **options) -> DataFrame:
    """One row per row of `docs`: (doc_id, n_shingles, class_id, component_id); see `JaccardJoin`. An empty table gives no rows."""
    return JaccardJoin(docs, **options).components()


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The rows of `docs` whose id is their component's smallest, one row per id, and all rows without id; all columns.

    Of rows that repeat an id the least in the order of the columns stays.
    """
    keeper = fresh(docs, "keeper")
    kept = (
        ngram_components(docs, id_column=id_column, text_column=text_column, **options)
        .where("doc_id = component_id")
        .select(F.col("doc_id").alias(keeper))
        .distinct()
    )
    named = docs.join(kept, docs[id_column].cast("long") == kept[keeper]).groupBy(keeper).agg(F.min(F.struct(*(docs[c] for c in docs.columns))).alias("row"))
    return named.select("row.*").unionByName(docs.where(F.col(id_column).isNull()))
