"""How far the sources of a language diverge: exact term counts recounted through sharded minimal perfect hashes."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from prefspark.llm.common import runs, slices
from prefspark.plans.session import materialize

_U = np.uint64
#: Letters stay, A-Z lower-cased, and so do all bytes of other alphabets; the rest of ASCII parts terms.
_LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """The runs of letters and of characters beyond ASCII in a UTF-8 text, A-Z lower-cased."""
    return (text or b"").translate(_LETTERS).split()


# ---- minimal perfect hashes ----


def digests(keys: list[bytes]) -> np.ndarray:
    """(keys, 2): 128-bit hashes."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), ">u8").astype(_U).reshape(-1, 2)


def _place(h: np.ndarray, level: int, size) -> np.ndarray:
    x = (h[:, 0] + _U((2 * level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) ^ (h[:, 1] * _U(2 * level + 3))
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return ((x ^ (x >> _U(33))) % size).astype(np.int64)


def build_block(keys: list[bytes]) -> tuple[list[int], bytes, list[bytes]]:
    """Level sizes and bits of a minimal perfect hash of distinct keys, and the keys in the order of their slots.

    On each level a key that has a place to itself stays there; the others go on to the next. Slots are the
    ranks of the bits set.
    """
    h, pending = digests(keys), np.arange(len(keys))
    sizes, bits, order = [], [], []
    while len(pending):
        if len(sizes) == 200:
            raise RuntimeError("keys can't be told apart")
        size = -(-max(64, 2 * len(pending)) // 8) * 8
        place = _place(h[pending], len(sizes), _U(size))
        alone = np.bincount(place, minlength=size)[place] == 1
        settled = pending[alone][np.argsort(place[alone])]
        mask = np.zeros(size, bool)
        mask[place[alone]] = True
        sizes.append(size)
        bits.append(np.packbits(mask).tobytes())
        order.append(settled)
        pending = pending[~alone]
    return sizes, b"".join(bits), [keys[i] for i in np.concatenate(order)] if order else []


class HashBlocks:
    """Consecutive blocks of perfect hashes, probed together; slots number the keys of all blocks in turn."""

    def __init__(self, first: int, sizes: list[list[int]], bits: list[bytes], keys: list[pa.Array]):
        self.first, levels = first, max(map(len, sizes), default=0)
        self.size = np.ones((levels, len(sizes)), _U)
        self.at = np.full((levels, len(sizes)), -1)
        at = 0
        for block, own in enumerate(sizes):
            for level, size in enumerate(own):
                self.size[level, block], self.at[level, block] = size, at
                at += size
        self.bits = np.unpackbits(np.frombuffer(b"".join(bits), np.uint8)).astype(bool)
        self.rank = np.cumsum(self.bits, dtype=np.int64) - 1
        self.keys = pa.concat_arrays(keys) if keys else pa.array([], pa.binary())
        #: Slots at which the blocks begin, and the end.
        self.starts = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int64)

    def slots(self, keys: pa.Array, block: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The slot of each key of the numbered block, -1 where the stored key is another or the block isn't here."""
        found, block = np.full(len(keys), -1), block - self.first
        pending = np.flatnonzero((block >= 0) & (block < len(self.starts) - 1))
        for level in range(len(self.at)):
            at = self.at[level, block[pending]]
            pending, at = pending[at >= 0], at[at >= 0]
            place = at + _place(h[pending], level, self.size[level, block[pending]])
            hit = self.bits[place]
            found[pending[hit]] = self.rank[place[hit]]
            pending = pending[~hit]
        held = np.flatnonzero(found >= 0)
        same = pc.equal(self.keys.take(pa.array(found[held])), keys.take(pa.array(held))).to_numpy(zero_copy_only=False)
        found[held[~same]] = -1
        return found


# ---- counts ----


def pack(counts: np.ndarray) -> bytes:
    """Whole numbers in the smallest of one, two, four and eight bytes, which the first byte names."""
    top = int(counts.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)
    return bytes([width]) + counts.astype(f"<u{width}").tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def shares(counts: np.ndarray, total: int, kinds: int, scale_steps: int = 3, add: int = 5) -> np.ndarray:
    """1 + floor(1000 ** scale_steps * (count + add) / (total + add * kinds)), exact while the divisor is below 9e15.

    Long division by steps of 1000, so that no product leaves 63 bits.
    """
    divisor = total + add * kinds
    if divisor >= 9 * 10**15:
        return np.array([1 + 1000**scale_steps * (int(c) + add) // divisor for c in counts], np.int64)
    rest, out = counts + add, np.zeros(len(counts), np.int64)
    for _ in range(scale_steps):
        rest = rest * 1000
        out = out * 1000 + rest // divisor
        rest = rest % divisor
    return out + 1


def _frequencies(batches: Iterable[pa.RecordBatch], most: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Documents by language and term, added up over many documents at a time."""
    held: dict[str, Counter] = defaultdict(Counter)

    def flush():
        for lang, counted in held.items():
            columns = [pa.array([lang] * len(counted), pa.string()), pa.array(list(counted), pa.binary()), pa.array(list(counted.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "term", "n_docs"])
        held.clear()

    for batch in slices(batches, "text", 8 << 20):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()):
            held[lang].update(set(terms(text)))
        if sum(map(len, held.values())) > most:
            yield from flush()
    yield from flush()


def _hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h = digests(batch.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(h[:, 0].view(np.int64))], [*batch.schema.names, "h"])


_INDEX = "block int, lang string, sizes array<bigint>, bits binary, keys array<binary>, weight bigint"


def _build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in runs(batches, ["block"]):
        sizes, bits, keys = build_block(rows.column("term").to_pylist())
        yield pa.RecordBatch.from_arrays(
            [
                rows.column("block").slice(0, 1).combine_chunks(), rows.column("lang").slice(0, 1).combine_chunks(), pa.array([sizes], pa.list_(pa.int64())),
                pa.array([bits], pa.binary()), pa.array([keys], pa.list_(pa.binary())), pa.array([sum(map(len, keys)) + len(bits)], pa.int64()),
            ],
            [c.split()[0] for c in _INDEX.split(", ")],
        )


_DENSE = "lang string, source string, block int, counts binary"


def _dense(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 4
    kinds = [pa.string(), pa.string(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["lang", "source", "block", "counts"])


def _recounted(batches: Iterable[pa.RecordBatch], shared, limit: int) -> Iterator[pa.RecordBatch]:
    """Occurrences of the broadcast keys by (language, source): dense slots, given out when they hold `limit` bytes."""
    first, sizes, bits, keys, langs = shared.value
    index = HashBlocks(first, sizes, bits, keys)
    dense: dict[tuple[str, str], np.ndarray] = {}

    def flush():
        for (lang, source), counts in dense.items():
            low = max(langs[lang][0] - first, 0)
            start, rows = index.starts[low], []
            for block in range(low, min(langs[lang][0] + langs[lang][1] - first, len(sizes))):
                own = counts[index.starts[block] - start : index.starts[block + 1] - start]
                if own.any():
                    rows.append((lang, source, first + block, pack(own)))
            yield _dense(rows)
        dense.clear()

    for batch in slices(batches, "text", 8 << 20):
        by_lang = defaultdict(list)
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()):
            base, n_blocks = langs.get(lang, (0, 0))
            if n_blocks and base < first + len(sizes) and base + n_blocks > first:
                by_lang[lang].append((source, terms(text)))
        for lang, rows in by_lang.items():
            base, n_blocks = langs[lang]
            distinct = pa.array([w for _, words in rows for w in words], pa.binary()).dictionary_encode()
            h = digests(distinct.dictionary.to_pylist())
            slot = index.slots(distinct.dictionary, base + np.mod(h[:, 0].view(np.int64), n_blocks), h)[distinct.indices.to_numpy()]
            low, high = (index.starts[min(max(b - first, 0), len(sizes))] for b in (base, base + n_blocks))
            number = {source: i for i, source in enumerate(dict.fromkeys(s for s, _ in rows))}
            group = np.repeat([number[s] for s, _ in rows], [len(words) for _, words in rows])
            flat, times = np.unique((group * (high - low) + slot - low)[slot >= 0], return_counts=True)
            for source, i in number.items():
                a, b = np.searchsorted(flat, [i * (high - low), (i + 1) * (high - low)])
                if a < b:
                    if (lang, source) not in dense:
                        dense[lang, source] = np.zeros(high - low, np.int64)
                    dense[lang, source][flat[a:b] - i * (high - low)] += times[a:b]
        if 8 * sum(map(len, dense.values())) > limit:
            yield from flush()
    yield from flush()


def _added(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Counts of equal keys, which come sorted, added up one row after the other; `total` is their sum."""
    now, held = None, None

    def out():
        names, first = ["lang", "source", "block"], dict(zip(keys, now))
        columns = [pa.array([first.get(n)], k) for n, k in zip(names, (pa.string(), pa.string(), pa.int32()))]
        return pa.RecordBatch.from_arrays([*columns, pa.array([pack(held)], pa.binary()), pa.array([int(held.sum())], pa.int64())], [*names, "counts", "total"])

    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
        for key, counts in zip(zip(*columns), batch.column(batch.schema.get_field_index("counts"))):
            more = unpack(counts.as_py())
            if key == now:
                held += more
            else:
                if now is not None:
                    yield out()
                now, held = key, more
    if now is not None:
        yield out()


def add_up(dense: DataFrame, keys: list[str]) -> DataFrame:
    """Dense counts summed by `keys`, and their totals."""
    return dense.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lambda batches: _added(batches, keys), _DENSE + ", total bigint")


def _pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of |p - q| over a block's terms for the pairs of sources of a cell, one chunk of sources against one."""
    for cell in runs(batches, ["block", "low", "high"]):
        inner = cell.column("low")[0].as_py() == cell.column("high")[0].as_py()
        sides = cell.column("side").to_numpy()
        sources, n_keys, kinds = cell.column("source").to_pylist(), cell.column("n_keys")[0].as_py(), cell.column("kinds")[0].as_py()
        p = np.stack([
            shares(np.zeros(n_keys, np.int64) if counts is None else unpack(counts), total, kinds)
            for counts, total in zip(cell.column("counts").to_pylist(), cell.column("total").to_pylist())
        ])
        a, b, value = [], [], []
        for i, source in enumerate(sources):
            others = np.flatnonzero(np.arange(len(sources)) > i if inner else (sides != sides[i]) & (sides[i] == cell.column("low")[0].as_py()))
            a += [source] * len(others)
            b += [sources[j] for j in others]
            value += np.abs(p[others] - p[i]).sum(axis=1).tolist()
        langs = pa.array([cell.column("lang")[0].as_py()] * len(a), pa.string())
        yield pa.RecordBatch.from_arrays([langs, pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(value, pa.int64())], ["lang", "a", "b", "value"])


def _leading(batches: Iterable[pa.RecordBatch], ranks: int) -> Iterator[pa.RecordBatch]:
    """Each block's `ranks` terms that a group has most above its language."""
    for batch in batches:
        column = lambda name: batch.column(batch.schema.get_field_index(name)).to_pylist()  # noqa: E731, B023
        out = [[], [], [], []]
        for lang, source, counts, total, of_lang, lang_total, kinds, keys in zip(*map(column, ("lang", "source", "counts", "total", "of_lang", "lang_total", "kinds", "keys"))):
            n = unpack(counts)
            excess = shares(n, total, kinds) - shares(unpack(of_lang), lang_total, kinds)
            above = np.flatnonzero((n > 0) & (excess > 0))
            if len(above) > ranks:
                least = np.partition(excess[above], -ranks)[-ranks]
                above = above[excess[above] >= least]
            best = sorted(zip((-excess[above]).tolist(), (keys[i] for i in above)))[:ranks]
            for held, values in zip(out, ([lang] * len(best), [source] * len(best), [k for _, k in best], [-v for v, _ in best])):
                held += values
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, (pa.string(), pa.string(), pa.binary(), pa.int64()))], ["lang", "source", "item", "value"])


# ---- Spark ----


def frequent_terms(rows: DataFrame, min_docs: int) -> DataFrame:
    """(lang, term, n_docs): terms of `min_docs` or more documents of a language."""
    counted = rows.mapInArrow(_frequencies, "lang string, term binary, n_docs bigint")
    return counted.groupBy("lang", "term").agg(F.sum("n_docs").alias("n_docs")).where(F.col("n_docs") >= min_docs)


def audit_sources(
    docs: DataFrame,
    lang_column: str = "lang",
    source_column: str = "source",
    text_column: str = "text",
    min_docs: int = 30,
    ranks: int = 50,
    keys_per_block: int = 8192,
    bytes_per_block: int = 1 << 20,
    bytes_per_pass: int = 64 << 20,
    dense_bytes: int = 64 << 20,
    chunk_sources: int = 128,
) -> DataFrame:
    r"""(lang, source, part, item, value, rank): how far the sources of each language diverge in their terms.

    Terms are matches of [^\x00-\x40\x5B-\x60\x7B-\x7F]+, A-Z lower-cased. A language keeps the V terms that
    `min_docs` of its documents have. A group is a (lang, source) that occurs; it and its language give each kept term
    p = 1 + floor(10^9 (count + 5) / (N + 5 V)), N the occurrences of kept terms. Part `pair`: every other source of
    the language, by the sum over kept terms of |p - p of the other|. Part `term`: the `ranks` terms of the group
    with the largest p - p of the language, above 0 only. Ranks are by value descending, then item by bytes.

    The first pass counts documents by term exactly, with partial sums. Kept terms are dealt by hash into blocks of
    about `keys_per_block`, each a minimal perfect hash with its stored keys. Blocks are broadcast in ranges of about
    `bytes_per_pass` (one block at least, itself of about `bytes_per_block`), and for each range the texts are read
    again: a task probes its distinct terms, compares the stored keys, and adds to dense slots of its groups, which
    hold about `dense_bytes`. Dense counts are added up in two steps, so that no task gets a row from every task of a
    large job. Sources are compared in cells of two chunks of about `chunk_sources` and one block.

    The driver holds one row per language and per block, and one range of blocks. Null text, lang and source count as
    ''. Repeated rows are documents each. Texts without terms make a group whose counts are 0; a language
    without kept terms has pairs of value 0 and no terms; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_column, "lang"), (source_column, "source"), (text_column, "text"))))
    groups = materialize(rows.groupBy("lang", "source").agg(F.count("*").alias("n_docs")), "audit-groups")
    kept = materialize(frequent_terms(rows, min_docs).mapInArrow(_hashed, "lang string, term binary, n_docs bigint, h bigint"), "audit-terms")

    langs, base = {}, 0
    for row in kept.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("term")).alias("size")).orderBy("lang").collect():
        n_blocks = max(-(-row.n // keys_per_block), -(-row["size"] // bytes_per_block))
        langs[row.lang] = (base, n_blocks, row.n)
        base += n_blocks
    placed = spark.createDataFrame([(lang, *x) for lang, x in langs.items()], "lang string, base int, n_blocks int, kinds bigint")
    index = materialize(
        kept.join(placed, "lang")
        .select("lang", "term", (F.col("base") + F.pmod("h", "n_blocks")).cast("int").alias("block"))
        .repartition("block")
        .sortWithinPartitions("block")
        .mapInArrow(_build, _INDEX),
        "audit-index",
    )

    passes: list[list[int]] = []
    held = 0
    for row in index.select("block", "weight").orderBy("block").collect():
        if not passes or held + row.weight > bytes_per_pass:
            passes.append([])
            held = 0
        passes[-1].append(row.block)
        held += row.weight
    where = {lang: x[:2] for lang, x in langs.items()}
    counted = None
    for blocks in passes:
        part = index.where(F.col("block").between(blocks[0], blocks[-1])).select("block", "sizes", "bits", "keys").toArrow().sort_by("block").combine_chunks()
        keys = [part["keys"][i].values for i in range(len(blocks))]
        shared = spark.sparkContext.broadcast((blocks[0], part["sizes"].to_pylist(), part["bits"].to_pylist(), keys, where))
        recounted = rows.mapInArrow(lambda batches, shared=shared: _recounted(batches, shared, dense_bytes), _DENSE)
        salted = add_up(recounted.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(32))), ["lang", "source", "block", "salt"])
        done = materialize(add_up(salted, ["lang", "source", "block"]), "audit-counts")
        shared.destroy()
        counted = done if counted is None else counted.unionByName(done)
    if counted is None:
        counted = spark.createDataFrame([], _DENSE + ", total bigint")

    totals = counted.groupBy("lang", "source").agg(F.sum("total").alias("total"))
    sized = groups.select("lang", "source").join(totals, ["lang", "source"], "left").na.fill(0, ["total"])
    sized = materialize(sized, "audit-totals")
    block_keys = index.select("lang", "block", F.size("keys").alias("n_keys"))
    pairs = _pair_values(sized, counted, block_keys, placed, chunk_sources)
    leading = _term_values(sized, counted, index, placed, ranks)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return (
        pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
        .unionByName(leading.select("lang", "source", F.lit("term").alias("part"), "item", "value", F.row_number().over(order).alias("rank")).where(F.col("rank") <= ranks))
    )


def _pair_values(sized: DataFrame, counted: DataFrame, block_keys: DataFrame, placed: DataFrame, chunk_sources: int) -> DataFrame:
    """(lang, source, item, value) for all ordered pairs of sources of a language."""
    per_lang = sized.groupBy("lang").agg(F.ceil(F.count("*") / chunk_sources).cast("int").alias("chunks"))
    cells = (
        sized.join(per_lang, "lang")
        .join(placed.select("lang", "kinds"), "lang")
        .join(block_keys, "lang")
        .join(counted.select("lang", "source", "block", "counts"), ["lang", "source", "block"], "left")
        .withColumn("side", F.pmod(F.xxhash64("source"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("lang", "source", "block", "n_keys", "kinds", "total", "counts", "side", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"))
    )
    summed = (
        cells.repartition("block", "low", "high")
        .sortWithinPartitions("block", "low", "high")
        .mapInArrow(_pairs, "lang string, a string, b string, value bigint")
        .groupBy("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .agg(F.sum("value").alias("value"))
    )
    listed = sized.select("lang", "source").join(sized.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    keyed = listed.withColumn("a", F.least("source", "item")).withColumn("b", F.greatest("source", "item"))
    return keyed.join(summed, ["lang", "a", "b"], "left").select("lang", "source", "item", F.coalesce("value", F.lit(0)).alias("value"))


def _term_values(sized: DataFrame, counted: DataFrame, index: DataFrame, placed: DataFrame, ranks: int) -> DataFrame:
    """(lang, source, item, value): at most `ranks` candidates of each group and block."""
    whole = add_up(counted.drop("total"), ["lang", "block"]).select("lang", "block", F.col("counts").alias("of_lang"))
    lang_totals = sized.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    known = whole.join(lang_totals, "lang").join(placed.select("lang", "kinds"), "lang").join(index.select("block", "keys"), "block")
    return (
        counted.join(sized, ["lang", "source"])
        .select("lang", "source", "block", "counts", sized.total)
        .join(known.drop("lang"), "block")
        .mapInArrow(lambda batches: _leading(batches, ranks), "lang string, source string, item binary, value bigint")
        .withColumn("item", F.col("item").cast("string"))
    )
