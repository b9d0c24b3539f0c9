"""Hidden Markov language model: Baum-Welch over all training documents, exact likelihood of whole texts."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from prefspark.llm.common import runs, slices
from prefspark.plans.session import materialize

#: The end of a text as a token; no word is empty.
END = b""
_MARKS = b".,;:!?\"'()[]"
_LOG10 = math.log(10)


def tokens(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased, then the end."""
    # bytes.split() parts at exactly [\x20\x09-\x0D], bytes.lower() changes A-Z only.
    return [*(text or "").encode().lower().split(), END]


def is_held_out(doc_id: int | None, folds: int, held: int) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % folds == held


def suffix_class(word: bytes, buckets: int) -> int:
    """A word without a class of its own shares one with words of the same ending."""
    return zlib.crc32(word.rstrip(_MARKS)[-3:]) % buckets


# ---- the chain ----


class Chain:
    """Start, transition and emission probabilities of a few states over a fixed number of word classes."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @staticmethod
    def first(prior: np.ndarray, states: int, stay: float, noise: float, seed: int) -> Chain:
        """States that tend to stay, each with class probabilities disturbed at random."""
        rng = np.random.default_rng(seed)
        emit = prior * np.exp(noise * rng.standard_normal((states, len(prior))))
        move = np.full((states, states), (1 - stay) / max(states - 1, 1))
        np.fill_diagonal(move, stay if states > 1 else 1.0)
        return Chain(np.full(states, 1 / states), move, emit / emit.sum(axis=1, keepdims=True))

    def likelihoods(self, classes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """log P of each column's classes by the scaled forward recursion.

        `classes` is (longest, texts); a text's classes are its first `lengths` entries, and the longest texts
        come first. Only the current step is kept, so memory doesn't grow with the length of a text.
        """
        emit = np.ascontiguousarray(self.emit.T)
        total = np.zeros(len(lengths))
        alpha = None
        for t, open_ in enumerate(_open(lengths)):
            alpha = (self.start if alpha is None else alpha[:open_] @ self.move) * emit[classes[t, :open_]]
            scale = alpha.sum(axis=1)
            alpha /= scale[:, None]
            total[:open_] += np.log(scale)
        return total

    def expected(self, classes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected start, transition and emission counts of the texts, and their log likelihood; texts as above."""
        seen, moves, log_likelihood = self.posteriors(classes, lengths)
        return seen[0].sum(axis=0, dtype=float), moves, by_state(classes, seen, self.emit.shape[1]), log_likelihood

    def posteriors(self, classes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Each token's state probabilities (0 behind a text's end), expected transitions, log likelihood.

        The recursions run in single precision, which scaling keeps from under- and overflow.
        """
        return self._backward(classes, lengths, None, None)[:3]

    def segments(self, classes: np.ndarray, segment: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, float]]:
        """One text's posteriors in pieces of `segment` tokens, the last first, with where each begins.

        The forward pass keeps its message at each cut; each piece is then run again between its two messages,
        so the counts are those of the whole text and memory is that of a piece.
        """
        cuts, before, after = range(0, len(classes), segment), [None], None
        for at in cuts[:-1]:
            _, alpha, _ = self._forward(classes[at : at + segment, None], np.array([segment]), before[-1])
            before.append(alpha[-1])
        for at, message in zip(reversed(cuts), reversed(before)):
            piece = classes[at : at + segment, None]
            *found, after = self._backward(piece, np.array([len(piece)]), message, after)
            yield at, *found

    def _forward(self, classes: np.ndarray, lengths: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Emissions, scaled forward messages and scales; `before` is the message of the token before."""
        move, ones = self.move.astype(np.float32), np.ones(len(self.start), np.float32)
        emit = np.ascontiguousarray(self.emit.T, np.float32)[classes]
        alpha, scales = np.zeros_like(emit), np.ones(classes.shape, np.float32)
        first = self.start.astype(np.float32) if before is None else before @ move
        for t, n in enumerate(_open(lengths)):
            step = emit[t, :n] * (first if t == 0 else alpha[t - 1, :n] @ move)
            scale = scales[t, :n]
            np.dot(step, ones, out=scale)
            np.divide(step, scale[:, None], out=alpha[t, :n])
        return emit, alpha, scales

    def _backward(self, classes: np.ndarray, lengths: np.ndarray, before: np.ndarray | None, after: np.ndarray | None):
        """`posteriors` between the messages of the tokens before and behind, and the message to the token before."""
        states, steps = len(self.start), _open(lengths)
        back = np.ascontiguousarray(self.move.T, np.float32)
        emit, alpha, scales = self._forward(classes, lengths, before)
        moves = np.zeros((states, states))
        beta = np.ones((steps[-1], states), np.float32) if after is None else after
        for t in range(len(steps) - 1, 0, -1):
            n = steps[t]
            ahead = beta * emit[t, :n]
            ahead /= scales[t, :n, None]
            moves += alpha[t - 1, :n].T @ ahead
            alpha[t, :n] *= beta
            # A text that ends at t - 1 has nothing ahead.
            beta = np.ones((steps[t - 1], states), np.float32)
            np.dot(ahead, back, out=beta[:n])
        message = None
        if before is not None:
            ahead = beta * emit[0] / scales[0, :, None]
            moves += before.T @ ahead
            message = ahead @ back
        alpha[0] *= beta
        return alpha, moves * self.move, float(np.log(scales, dtype=float).sum()), message

    def updated(self, start: np.ndarray, moves: np.ndarray, emitted: np.ndarray, prior: np.ndarray, weight: float) -> Chain:
        """The chain of the expected counts; `weight` counts of the prior keep every class possible."""
        start, moves = start + 1e-3, moves + 1e-3
        emitted = emitted + weight * prior
        return Chain(start / start.sum(), moves / moves.sum(axis=1, keepdims=True), emitted / emitted.sum(axis=1, keepdims=True))


def by_state(ids: np.ndarray, seen: np.ndarray, size: int) -> np.ndarray:
    """(states, size): the state probabilities `seen` of the tokens, summed by the tokens' `ids`."""
    flat, seen = ids.reshape(-1), seen.reshape(-1, seen.shape[-1])
    return np.stack([np.bincount(flat, seen[:, s], size) for s in range(seen.shape[1])])


def _open(lengths: np.ndarray) -> list[int]:
    """How many texts, the longest first, reach each step."""
    return [int(n) for n in len(lengths) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), side="right")]


def _blocks(rows: list[np.ndarray], cells: int) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Sequences of like length side by side, about `cells` entries (one sequence at least) at a time."""
    order = sorted(range(len(rows)), key=lambda i: -len(rows[i]))
    at = 0
    while at < len(order):
        longest = max(len(rows[order[at]]), 1)
        some = order[at : at + max(1, min(1024, cells // longest))]
        block = np.zeros((longest, len(some)), np.int64)
        for j, i in enumerate(some):
            block[: len(rows[i]), j] = rows[i]
        yield some, block, np.array([len(rows[i]) for i in some])
        at += len(some)


def _passes(chain: Chain, rows: list[np.ndarray], segment: int, cells: int) -> Iterator[tuple]:
    """Posteriors of whole texts: (text, offset) of each column, classes, state probabilities, starts, transitions, likelihood."""
    short = [i for i, row in enumerate(rows) if len(row) <= segment]
    for some, block, lengths in _blocks([rows[i] for i in short], cells):
        seen, moves, height = chain.posteriors(block, lengths)
        yield [(short[i], 0) for i in some], block, seen, seen[0].sum(axis=0, dtype=float), moves, height
    for i, row in enumerate(rows):
        if len(row) > segment:
            for at, seen, moves, height in chain.segments(row, segment):
                start = seen[0].sum(axis=0, dtype=float) * (at == 0)
                yield [(i, at)], row[at : at + segment, None], seen, start, moves, height


# ---- Spark ----


_BLOCK = (
    "block bigint, doc_id array<bigint>, held_out array<boolean>, lengths array<int>, codes binary, words binary, size bigint, buckets binary"
)


def _packed(data: bytes) -> bytes:
    return pa.compress(data, codec="zstd", asbytes=True)


def _unpacked(data: bytes, size: int) -> bytes:
    return pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True)


def _by_share(c: np.ndarray, e: np.ndarray) -> bytes:
    """Counts by state (states, words) as shares of the words' counts in half precision, one state after the other: 2^-11 of a share at most is lost."""
    return _packed((e / np.maximum(c, 1)).astype("<f2").tobytes())


def _from_share(c: np.ndarray, data: bytes, states: int) -> np.ndarray:
    if not states:
        return np.zeros((0, len(c)))
    return np.frombuffer(_unpacked(data, 2 * states * len(c)), "<f2").reshape(states, len(c)).astype(float) * c


def _blocked(batches: Iterable[pa.RecordBatch], buckets: int, folds: int, held: int, block_bytes: int) -> Iterator[pa.RecordBatch]:
    """Texts side by side as one row: distinct words once, and every token as the number of its word in the block."""
    index: dict[bytes, int] = {}
    codes, lengths, docs, rows, size = [], [], [], [], 0

    def out():
        words = b"\n".join(index)
        shared = np.array([suffix_class(w, buckets) for w in index], "<i4")
        values = [rows[0], docs, [is_held_out(d, folds, held) for d in docs], lengths, _packed(np.concatenate(codes).tobytes()), _packed(words), len(words), _packed(shared.tobytes())]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], [c.split()[0] for c in _BLOCK.split(", ")])

    for part in slices(batches, "text", min(block_bytes, 8 << 20)):
        if size and size + part.column(2).nbytes > block_bytes:
            yield out()
            size = 0
            for held_ in (index, codes, lengths, docs, rows):
                held_.clear()
        said = [tokens(text) for text in part.column(2).to_pylist()]
        lengths += map(len, said)
        coded = pa.array([w for words in said for w in words], pa.binary()).dictionary_encode()
        local = np.array([index.setdefault(w, len(index)) for w in coded.dictionary.to_pylist()], "<i4")
        codes.append(local[coded.indices.to_numpy()])
        rows.append(part.column(0)[0].as_py())
        docs += part.column(1).to_pylist()
        size += part.column(2).nbytes + 1
    if docs:
        yield out()


class Block:
    """A row of `_BLOCK` opened."""

    def __init__(self, row: dict):
        unpack = lambda name, size: _unpacked(row[name], size)
        self.number, self.docs, self.held = row["block"], row["doc_id"], np.array(row["held_out"], bool)
        self.lengths = np.array(row["lengths"], np.int64)
        self.codes = np.frombuffer(unpack("codes", 4 * int(self.lengths.sum())), "<i4")
        self.words = unpack("words", row["size"]).split(b"\n")
        self.buckets = np.frombuffer(unpack("buckets", 4 * len(self.words)), "<i4")

    def placed(self, known: Dictionary) -> tuple[np.ndarray, np.ndarray]:
        """Each word's place in the dictionary, -1 outside, and its class."""
        index = np.fromiter(map(known.index.get, self.words, repeat(-1)), np.int64, len(self.words))
        return index, np.where(index >= 0, known.classes[index], known.first + self.buckets)

    def texts(self, values: np.ndarray | None = None, training: bool = False) -> list[np.ndarray]:
        """The texts' tokens, as the numbers of their words or by `values` of these."""
        every = np.split(self.codes if values is None else values[self.codes], np.cumsum(self.lengths)[:-1])
        return [x for x, held in zip(every, self.held) if not held] if training else every

    def times(self) -> tuple[np.ndarray, np.ndarray]:
        """How often each word stands in training and in held-out texts."""
        held = np.repeat(self.held, self.lengths)
        return tuple(np.bincount(self.codes[side], minlength=len(self.words)) for side in (~held, held))


def _opened(batches: Iterable[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Block({name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)})


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's words with their counts in training and in held-out texts."""
    for block in _opened(batches):
        yield pa.RecordBatch.from_arrays([pa.array(block.words, pa.binary()), *map(pa.array, block.times())], ["word", "c", "other"])


def _frequent(counts: DataFrame, longest_word: int, most: int) -> dict[bytes, int]:
    """Training counts of the words most frequent in all texts, as many whole steps of frequency as `most` words hold."""
    total = F.col("c") + F.col("other")
    # Exact counts up to 4096, then 64 steps to the doubling: a bounded number of steps.
    step = F.when(total < 4096, total).otherwise(4096 + F.floor(F.log2(total) * 64)).cast("long")
    usable = counts.where((F.octet_length("word") > 0) & (F.octet_length("word") <= longest_word)).withColumn("step", step)
    held, least = 0, None
    for row in sorted(usable.groupBy("step").count().collect(), reverse=True):
        held += row["count"]
        if held > most:
            break
        least = row.step
    if least is None:
        return {}
    words = usable.where(F.col("step") >= least).select("word", "c", total.alias("n")).toArrow()
    rows = sorted(zip(words["n"].to_pylist(), words["word"].to_pylist(), words["c"].to_pylist()), key=lambda r: (-r[0], r[1]))
    return {word: c for _, word, c in rows}


def _most_trained(counts: DataFrame, longest_word: int, most: int) -> dict[bytes, int]:
    """The `most` words most frequent in training texts; held-out texts have no say."""
    length = F.octet_length("word")
    usable = counts.where((length > 0) & (length <= longest_word) & (F.col("c") > 0))
    rows = usable.select("word", "c").orderBy(F.desc("c"), "word").limit(max(most, 0)).collect()
    return {bytes(r.word): r.c for r in rows}


def _buckets(batches: Iterable[pa.RecordBatch], own: set[bytes], buckets: int) -> Iterator[pa.RecordBatch]:
    """Training tokens and distinct training words of each shared class."""
    totals = np.zeros((buckets, 2), np.int64)
    for batch in batches:
        for word, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if word not in own:
                totals[suffix_class(word, buckets)] += (c, 1)
    used = np.flatnonzero(totals[:, 1])
    yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(totals[used, i]) for i in (0, 1))], ["bucket", "n", "v"])


class Dictionary:
    """The end and the most frequent words, a bounded number, with what a text adds to its sums for each.

    The words of `own`, `own_classes` at most, have a class of their own; all others share the class of their
    ending. In a shared class a word has (c + 1) / (n + v + 1) of the class, with n tokens of v words in
    training: the share of one unseen word is left over.
    """

    def __init__(self, counts: dict[bytes, int], own: list[bytes], own_classes: int, bucket_totals: np.ndarray):
        self.given = (counts, own, own_classes, bucket_totals)
        buckets = len(bucket_totals)
        self.first, self.n_classes = own_classes, own_classes + buckets
        self.index = {word: i for i, word in enumerate(counts)}
        own_class = {word: i for i, word in enumerate(own)}
        self.counts = np.fromiter(counts.values(), np.int64, len(counts))
        self.classes = np.array([own_class.get(w, own_classes + suffix_class(w, buckets)) for w in counts], np.int64)
        self.totals = np.zeros(self.n_classes)
        self.totals[:own_classes] = np.bincount([own_class[w] for w in own], [counts[w] for w in own], own_classes)
        self.totals[own_classes:] = bucket_totals[:, 0]
        self.kinds = bucket_totals[:, 1]

    def prior(self) -> np.ndarray:
        return (self.totals + 1) / (self.totals + 1).sum()


_EXPECTED = "kind int, i int, j int, value double"


def _expected(groups: Iterable[list[np.ndarray]], chain: Chain, segment: int, cells: int) -> Iterator[pa.RecordBatch]:
    """A task's expected counts, summed over its texts, which come some at a time as their classes."""
    sums = [np.zeros((1, len(chain.start))), np.zeros_like(chain.move), np.zeros_like(chain.emit), np.zeros((1, 1))]
    for rows in groups:
        for _, block, seen, start, moves, log_likelihood in _passes(chain, rows, segment, cells):
            for total, part in zip(sums, (start, moves, by_state(block, seen, chain.emit.shape[1]), log_likelihood)):
                total += part
    for kind, total in enumerate(sums):
        i, j = np.nonzero(total)
        columns = [pa.array(np.full(len(i), kind, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])]
        yield pa.RecordBatch.from_arrays(columns, ["kind", "i", "j", "value"])


def train(
    blocks: DataFrame, prior: np.ndarray, shared, states: int, iterations: int, segment: int, cells: int, stay: float, noise: float, weight: float, seed: int
) -> tuple[Chain, list[float]]:
    """Baum-Welch over every training text of `blocks`; also the log likelihood before each round.

    Tasks add up the expected counts of their texts, Spark adds up the tasks'; the driver gets a number per
    state and class, whose number is a parameter. Texts of over `segment` tokens are run
    through in pieces, with the messages of their neighbours.
    """
    chain, heights = Chain.first(prior, states, stay, noise, seed), []
    for _ in range(iterations):
        now = chain
        sums = [np.zeros((1, states)), np.zeros((states, states)), np.zeros((states, len(prior))), np.zeros((1, 1))]

        def run(batches):
            known = Dictionary(*shared.value)
            return _expected((b.texts(b.placed(known)[1], training=True) for b in _opened(batches)), now, segment, cells)  # noqa: B023

        added = blocks.mapInArrow(run, _EXPECTED).groupBy("kind", "i", "j").agg(F.sum("value").alias("value")).toArrow()
        kind, i, j, value = (added[c].to_numpy() for c in ("kind", "i", "j", "value"))
        for k, total in enumerate(sums):
            total[i[kind == k], j[kind == k]] = value[kind == k]
        heights.append(float(sums[3][0, 0]))
        chain = chain.updated(sums[0][0], sums[1], sums[2], prior, weight)
    return chain, heights


# ---- every word's counts ----


_REQUEST = "bucket bigint, block bigint, n int, size bigint, places binary, words binary, c binary, e binary, sums binary"
_NAMES = [c.split()[0] for c in _REQUEST.split(", ")]
_KINDS = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 5]


def _row(*values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, _KINDS)], _NAMES)


def _requests(batches: Iterable[pa.RecordBatch], chain: Chain | None, shared, n_buckets: int, segment: int, cells: int) -> Iterator[pa.RecordBatch]:
    """A block's words outside the dictionary, with its counts of them, dealt by hash; at the end the task's other sums.

    With a chain the counts by state are among them: of the words, and as `sums` starts, transitions, likelihood,
    emissions by class and emissions of the dictionary's words.
    """
    known = Dictionary(*shared.value)
    states = 0 if chain is None else len(chain.start)
    parts = [] if chain is None else [np.zeros(states), np.zeros_like(chain.move), np.zeros(1), np.zeros_like(chain.emit), np.zeros((states, len(known.counts)))]
    for block in _opened(batches):
        index, classes = block.placed(known)
        size = len(block.words)
        found = np.zeros((states, size + 1))
        if states and not block.held.all():
            ids = block.texts(training=True)
            for some, wide, seen, start, moves, height in _passes(chain, [classes[x] for x in ids], segment, cells):
                id_ = np.full(wide.shape, size)
                for column, (i, at) in enumerate(some):
                    piece = ids[i][at : at + len(wide)]
                    id_[: len(piece), column] = piece
                found += by_state(id_, seen, size + 1)
                for total, more in zip(parts, (start, moves, height)):
                    total += more
            here = np.flatnonzero(index >= 0)
            for s in range(states):
                parts[3][s] += np.bincount(classes, found[s, :size], parts[3].shape[1])
                parts[4][s, index[here]] += found[s, here]
        c = block.times()[0]
        outside = np.flatnonzero(index < 0)
        bucket = np.array([xxhash.xxh3_64_intdigest(block.words[i]) % n_buckets for i in outside], np.int64)
        order = np.argsort(bucket, kind="stable")
        outside, bucket = outside[order], bucket[order]
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        for start, end in zip(cuts, [*cuts[1:], len(outside)]):
            at = outside[start:end]
            words = b"\n".join([block.words[i] for i in at])
            numbers = (_packed(x.astype("<i4").tobytes()) for x in (at, c[at]))
            yield _row(int(bucket[start]), block.number, len(at), len(words), next(numbers), _packed(words), next(numbers), _by_share(c[at], found[:, at]), None)
    if states:
        yield _row(-1, *[None] * 7, np.concatenate([x.reshape(-1) for x in parts]).astype("<f8").tobytes())


def _summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for data in batch.column(0):
            one = np.frombuffer(data.as_buffer(), "<f8")
            total = one.copy() if total is None else total + one
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])


_ANSWER = "block bigint, n int, places binary, c binary, e binary"


def _answers(batches: Iterable[pa.RecordBatch], states: int) -> Iterator[pa.RecordBatch]:
    """Whole counts of a bucket's words, given back to every block that asked."""
    for group in runs(batches, ["bucket"]):
        column = {name: group.column(name).to_pylist() for name in group.column_names}
        asked = [_unpacked(data, size).split(b"\n") for data, size in zip(column["words"], column["size"])]
        codes = pa.array([w for words in asked for w in words], pa.binary()).dictionary_encode().indices.to_numpy()
        own = [np.frombuffer(_unpacked(data, 4 * n), "<i4") for data, n in zip(column["c"], column["n"])]
        c = np.bincount(codes, np.concatenate(own)).astype(np.int64)
        e = np.concatenate([_from_share(x, data, states) for x, data in zip(own, column["e"])], axis=1)
        total = np.array([np.bincount(codes, e[s], len(c)) for s in range(states)]).reshape(states, len(c))
        at = 0
        for block, places, n in zip(column["block"], column["places"], column["n"]):
            mine = codes[at : at + n]
            at += n
            values = [block, n, places, _packed(c[mine].astype("<i8").tobytes()), _by_share(c[mine], total[:, mine])]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, (pa.int64(), pa.int32(), *[pa.binary()] * 3))], [x.split()[0] for x in _ANSWER.split(", ")])


def opened_answer(n: int, places: bytes, c: bytes, e: bytes, states: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, counts and counts by state (words, states) of an answer."""
    times = np.frombuffer(_unpacked(c, 8 * n), "<i8")
    return np.frombuffer(_unpacked(places, 4 * n), "<i4"), times, _from_share(times, e, states).T


def count_words(
    blocks: DataFrame, chain: Chain | None, shared, prior: np.ndarray, segment: int, cells: int, weight: float, words_per_bucket: int = 200_000
) -> tuple[Chain | None, np.ndarray | None, np.ndarray | None, DataFrame]:
    """Counts of the words outside the dictionary for every block that has them: (block, n, places, c, e), see `opened_answer`.

    A block asks once for each of its distinct words, with its own counts: training tokens, and with a chain one more
    round's expected counts by state. Requests are dealt by word into buckets of about `words_per_bucket`, added up there and
    answered as packed arrays. No word outside the dictionary is in very many blocks. The chain after that round,
    and expected counts (states, classes) and (states, dictionary), go to the driver, whose numbers are parameters.
    """
    known = Dictionary(*shared.value)
    n_words = blocks.agg(F.coalesce(F.sum(F.length("buckets")), F.lit(0))).first()[0]
    n_buckets = max(1, -(-n_words // words_per_bucket))
    asked = materialize(blocks.mapInArrow(lambda batches: _requests(batches, chain, shared, n_buckets, segment, cells), _REQUEST), "hmm-requests")
    states = 0 if chain is None else len(chain.start)
    answers = (
        asked.where("bucket >= 0")
        .repartition(n_buckets, "bucket")
        .sortWithinPartitions("bucket")
        .drop("sums")
        .mapInArrow(lambda batches: _answers(batches, states), _ANSWER)
    )
    if chain is None:
        return None, None, None, answers
    partly = asked.where("bucket < 0").select("sums").repartition(16).mapInArrow(_summed, "sums binary")
    whole = partly.repartition(1).mapInArrow(_summed, "sums binary").first()
    shapes = [(states,), (states, states), (1,), (states, len(prior)), (states, len(known.counts))]
    sizes = [int(np.prod(x)) for x in shapes]
    flat = np.zeros(sum(sizes)) if whole is None else np.frombuffer(whole.sums, "<f8")
    start, moves, _, emitted, of_known = (x.reshape(shape) for x, shape in zip(np.split(flat, np.cumsum(sizes)[:-1]), shapes))
    return chain.updated(start, moves, emitted, prior, weight), emitted, of_known, answers


class Emissions:
    """The states' emissions of words: (words, states).

    With expected counts by word a state emits a word of a shared class with (e + 1/S) / (n + (v + 1)/S) of the class, for e
    expected counts of the word and n of the class's v words in that state, and S states: the share of one unseen word
    is left over, and states that share all words evenly come to (c + 1) / (n + v + 1), which all of them
    have without expected counts.
    """

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray, known: tuple, emitted: np.ndarray | None, of_known: np.ndarray | None):
        self.known, self.start, self.move, self.of_known = Dictionary(*known), start, move, of_known
        self.one, self.factor, first = 1 / len(start), emit.T.copy(), self.known.first
        if emitted is None:
            self.factor[first:] /= (self.known.totals[first:] + self.known.kinds + 1)[:, None]
        else:
            self.factor[first:] /= emitted.T[first:] + (self.known.kinds[:, None] + 1) * self.one

    def chain(self, index: np.ndarray, classes: np.ndarray, c: np.ndarray, e: np.ndarray) -> Chain:
        """The chain over words with these places in the dictionary, classes and, outside it, counts."""
        inside = index >= 0
        if self.of_known is None:
            weights = (c + 1.0)[:, None]
        else:
            weights = e.astype(float) + self.one
            weights[inside] = self.of_known[:, index[inside]].T + self.one
        emit = self.factor[classes] * np.where((classes >= self.known.first)[:, None], weights, 1.0)
        return Chain(self.start, self.move, emit.T)


_SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, logs double, score double"


def _scored(batches: Iterable[pa.RecordBatch], shared, states: int, cells: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block, the answers before the block itself."""
    model = Emissions(*shared.value)
    held: list[tuple] = []
    for batch in batches:
        columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        for i, whole in enumerate(columns["whole"].to_pylist()):
            if not whole:
                held.append(tuple(columns[x][i].as_py() for x in ("n", "places", "c", "e")))
                continue
            block = Block({x: columns[x][i].as_py() for x in ("block", "doc_id", "held_out", "lengths", "codes", "words", "size", "buckets")})
            index, classes = block.placed(model.known)
            c, e = np.zeros(len(index), np.int64), np.zeros((len(index), states), np.float32)
            c[index >= 0] = model.known.counts[index[index >= 0]]
            for answer in held:
                at, times, by_state_ = opened_answer(*answer, states)
                c[at], e[at] = times, by_state_
            held.clear()
            texts, chain = block.texts(), model.chain(index, classes, c, e)
            score = np.zeros(len(texts))
            for some, wide, lengths in _blocks(texts, cells):
                score[some] = chain.likelihoods(wide, lengths) / _LOG10
            starts = np.cumsum(block.lengths) - block.lengths
            known, logs = (np.add.reduceat(x[block.codes], starts) for x in ((c > 0).astype(np.int64), np.log10(c + 1.0)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(block.docs, pa.int64()), pa.array(block.held), *map(pa.array, (block.lengths, known, logs, score))], [x.split()[0] for x in _SCORED.split(", ")]
            )


def score_documents(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    states: int = 8,
    iterations: int = 4,
    dictionary_words: int = 1 << 16,
    longest_word: int = 64,
    own_classes: int = 3072,
    buckets: int = 1024,
    folds: int = 7,
    held: int = 2,
    segment: int = 65_536,
    cells: int = 250_000,
    stay: float = 0.9,
    noise: float = 1.0,
    weight: float = 10.0,
    seed: int = 3,
    by_word: bool = False,
    block_bytes: int = 32 << 20,
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of `docs`.

    Texts whose crc32(doc_id as text) mod `folds` is not `held` are trained on. Tokens are words with A-Z
    lower-cased and one end. base_score is the sum of log10((c + 1) / (N + V + 1)). score is the log10
    probability under a hidden Markov model: its `states` emit word classes, and a word is drawn from its
    class by (c + 1) / (n + v + 1). The `own_classes` most frequent words are classes by themselves, all
    others share one of `buckets` classes by their last letters, so the chain's size is a parameter whatever
    the vocabulary. The forward recursion runs over whole texts.

    With `by_word` every training word has its own counts in every state: the last round sums them by word, which
    grows with the vocabulary (`Emissions` has the formula). The rounds
    before it, which only place the states, share the classes, and training counts alone decide which words have
    classes of their own; without it, held-out counts are added there.

    Texts are read once and kept as blocks of at most `block_bytes`: each distinct word once, tokens as numbers.
    Word counts are a table. Its most frequent words, at most `dictionary_words` of at most `longest_word` bytes,
    bounded by their product, are sent to the tasks; for the others every block asks once (`count_words`).
    Null text is only an end, a null id counts as the id "", repeated rows are scored and trained on each,
    an empty table gives no rows, other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("block"), F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    blocks = materialize(rows.mapInArrow(lambda batches: _blocked(batches, buckets, folds, held, block_bytes), _BLOCK), "hmm-blocks")
    counts = materialize(
        blocks.mapInArrow(_counts, "word binary, c bigint, other bigint").groupBy("word").agg(F.sum("c").alias("c"), F.sum("other").alias("other")), "hmm-words"
    )
    is_end = F.octet_length("word") == 0
    whole = counts.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n"),
        F.count_if(F.col("c") > 0).alias("v"),
        F.coalesce(F.sum(F.when(is_end, F.col("c"))), F.lit(0)).alias("ends"),
    ).first()
    known = {END: whole.ends} | _frequent(counts, longest_word, dictionary_words)
    own = list(known)[:own_classes]
    if by_word:
        trained = {END: whole.ends} | _most_trained(counts, longest_word, own_classes - 1)
        known, own = trained | known, list(trained)[:own_classes]
    own_set = set(own)
    totals = np.zeros((buckets, 2))
    bucketed = counts.where("c > 0").select("word", "c").mapInArrow(lambda batches: _buckets(batches, own_set, buckets), "bucket bigint, n bigint, v bigint")
    for row in bucketed.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        totals[row.bucket] = row.n, row.v
    dictionary = Dictionary(known, own, own_classes, totals)
    # Plain values: the workers need not have this package.
    shared = spark.sparkContext.broadcast(dictionary.given)
    prior, with_states = dictionary.prior(), states if by_word else 0
    chain, _ = train(blocks, prior, shared, states, iterations - bool(by_word), segment, cells, stay, noise, weight, seed)
    after, emitted, of_known, answers = count_words(blocks, chain if by_word else None, shared, prior, segment, cells, weight)
    chain = after or chain
    model = spark.sparkContext.broadcast((chain.start, chain.move, chain.emit, dictionary.given, emitted, of_known))
    nothing = lambda schema, names: [F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in schema.split(", ")) if c not in names]
    asked, held_back = {c.split()[0] for c in _ANSWER.split(", ")}, {c.split()[0] for c in _BLOCK.split(", ")}
    both = blocks.select(F.lit(True).alias("whole"), *sorted(held_back), *nothing(_ANSWER, held_back | {"block"})).unionByName(
        answers.select(F.lit(False).alias("whole"), *sorted(asked), *nothing(_BLOCK, asked))
    )
    n_blocks = blocks.count()
    scored = both.repartition(max(1, n_blocks), "block").sortWithinPartitions("block", "whole").mapInArrow(lambda batches: _scored(batches, model, with_states, cells), _SCORED)
    base = F.col("logs") - F.col("n_tokens") * math.log10(whole.n + whole.v + 1)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(whole.n).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
