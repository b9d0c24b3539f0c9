"""Token sequences of fixed length packed first-fit decreasing in random groups of documents."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from prefspark.llm.common import lean, process_cache, runs, slices

SEPARATOR = 1
SPECIAL = ("<|startoftext|>", "<|endoftext|>")
_CACHED_WORDS = 1_000_000
# The tokenizer's own split of lower-cased text, spelt out for characters up to U+00FF.
_L, _N = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\t-\r \x85\xa0{_L}{_N}]+")
_BLANK = re.compile(r"[\x20\x09-\x0D]+")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of whole texts, as 16-bit numbers, with the ids of words kept.

    The tokenizer drops white space and treats every word by itself, so a text's ids are those of its words
    in a row. Words are found here for characters up to U+00FF; a word with others goes to the tokenizer as
    it is, and so does a text with a special token's string. New words are encoded together, apart by blanks;
    the last token of a word is known by its end mark.
    """

    def __init__(self, path: str):
        # A task has one core; set before the library looks.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {}

    def _encode(self, text: str) -> np.ndarray:
        # Without the places of tokens in the text, which nobody reads.
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint16)

    def _learn(self, words: set[str]) -> None:
        new = list(words.difference(self.words))
        if len(self.words) + len(new) > _CACHED_WORDS:
            self.words, new = {}, list(words)
        for i in range(0, len(new), 5000):
            some = new[i : i + 5000]
            ids = self._encode(" ".join(some))
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(some):
                raise ValueError("the tokenizer does not end every word with an end mark")
            data, stops = ids.tobytes(), (2 * stops).tolist()
            self.words.update(zip(some, (data[a:b] for a, b in zip([0, *stops], stops))))

    def _pieces(self, text: str) -> list:
        """Known words as strings; what the tokenizer must see as it is as bytes of ids."""
        if any(s in text for s in SPECIAL):
            return [self._encode(text).tobytes()]
        try:
            text.encode("latin-1")
            return _PIECES.findall(text.lower())
        except UnicodeEncodeError:
            pieces: list = []
            for word in _BLANK.split(text):
                try:
                    word.encode("latin-1")
                    pieces += _PIECES.findall(word.lower())
                except UnicodeEncodeError:
                    pieces.append(self._encode(word).tobytes())
            return pieces

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self._pieces(text) for text in texts]
        self._learn({p for p in set(chain.from_iterable(split)) if type(p) is str})
        words, out = self.words, []
        for pieces in split:
            try:
                out.append(b"".join(map(words.__getitem__, pieces)))
            except KeyError:  # some pieces are ids already
                out.append(b"".join([p if type(p) is bytes else words[p] for p in pieces]))
        return out


# ---- bins ----


class Bins:
    """A tournament over bins: every inner node has the larger free room of its two sides."""

    def __init__(self, capacity: int, most: int):
        self.leaves = 1
        while self.leaves < max(most, 1):
            self.leaves *= 2
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """Puts `size` into the first bin with room for it, and returns the bin."""
        room, node = self.room, 1
        while node < self.leaves:
            node *= 2
            if room[node] < size:
                node += 1
        bin_ = node - self.leaves
        room[node] -= size
        node //= 2
        while node:
            left, right = room[2 * node], room[2 * node + 1]
            room[node] = left if left > right else right
            node //= 2
        return bin_


def pack_lengths(lengths: list[int], capacity: int, min_fill: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, start in the item, length) that hold every item, in whole or cut.

    First-fit decreasing places whole items. Gaps of `min_fill` or more are then filled from the last
    bins, cutting an item where needed, so that one bin at most is left far from full; it is cut into
    sequences of powers of two, which need no padding.
    """
    tree = Bins(capacity, len(lengths))
    bins: list[list[tuple[int, int, int]]] = []
    free: list[int] = []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        at = tree.place(lengths[item])
        if at == len(bins):
            bins.append([])
            free.append(capacity)
        bins[at].append((item, 0, lengths[item]))
        free[at] -= lengths[item]
    order = sorted(range(len(bins)), key=lambda b: (free[b], b))
    first, last = 0, len(order) - 1
    while first < last:
        to, source = order[first], order[last]
        if free[to] < min_fill:
            first += 1
        elif not bins[source]:
            last -= 1
        else:
            item, start, length = bins[source].pop()
            part = min(length, free[to])
            bins[to].append((item, start, part))
            free[to] -= part
            free[source] += part
            if part < length:
                bins[source].append((item, start + part, length - part))
    out = []
    for b in order:
        held = sum(piece[2] for piece in bins[b])
        if not held:
            continue
        if capacity - held < min_fill:
            out.append(bins[b])
            continue
        pieces = bins[b][::-1]
        while held:
            size = 1 << (held.bit_length() - 1)
            held -= size
            sequence = []
            while size:
                item, start, length = pieces.pop()
                part = min(length, size)
                sequence.append((item, start, part))
                size -= part
                if part < length:
                    pieces.append((item, start + part, length - part))
            out.append(sequence)
    return out


# ---- Spark ----

_CUT = "grp bigint, row bigint, doc_id bigint, start bigint, length bigint, doc_tokens bigint, ids binary"
_CUT_NAMES = [c.split()[0] for c in _CUT.split(", ")]


def _tokenized(batches: Iterable[pa.RecordBatch], path: str | None, capacity: int) -> Iterator[pa.RecordBatch]:
    """Every document's full pieces and its rest."""
    encoder = process_cache(f"encoder:{path}", lambda: Encoder(path or tokenizer_path()))
    for batch in slices(batches, "text", 4 << 20):
        rows = []
        ends = SEPARATOR.to_bytes(2, "little")
        encoded = encoder.encode([t or "" for t in batch.column(3).to_pylist()])
        for grp, row, doc, ids in zip(*(batch.column(i).to_pylist() for i in range(3)), encoded):
            ids += ends
            total = len(ids) // 2
            for start in range(0, total, capacity):
                piece = ids[2 * start : 2 * (start + capacity)]
                rows.append((grp, row, doc, start, len(piece) // 2, total, piece))
        kinds = [pa.int64()] * 6 + [pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], _CUT_NAMES)


def _wide(ids: bytes) -> bytes:
    return np.frombuffer(ids, "<u2").astype("<u4").tobytes()


def _packed(batches: Iterable[pa.RecordBatch], capacity: int, min_fill: int, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    for group in runs(batches, ["grp"]):
        columns = {c: group.column(c).to_pylist() for c in _CUT_NAMES}
        order = sorted(range(group.num_rows), key=lambda i: (columns["row"][i], columns["start"][i]))
        rests = [i for i in order if columns["length"][i] < capacity]
        sequences = [[(i, 0, capacity)] for i in order if columns["length"][i] == capacity]
        for sequence in pack_lengths([columns["length"][i] for i in rests], capacity, min_fill):
            sequences.append([(rests[item], start, length) for item, start, length in sequence])
        base = columns["grp"][0] << 32
        rows = []
        for nth, sequence in enumerate(sequences):
            offset = 0
            for i, start, length in sequence:
                wide = _wide(columns["ids"][i][2 * start : 2 * (start + length)])
                row = (columns["doc_id"][i], columns["start"][i] + start, length, zlib.crc32(wide), columns["doc_tokens"][i], base + nth, offset)
                rows.append((*row, wide) if keep_ids else row)
                offset += length
        kinds = [pa.int64()] * 7 + [pa.binary()] * keep_ids
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [*names, "ids"] if keep_ids else names
        )


def pack_documents(
    docs: DataFrame,
    capacity: int = 2048,
    docs_per_group: int = 1024,
    min_fill: int = 32,
    tokenizer: str | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
    keep_ids: bool = True,
    seed: int = 5,
) -> DataFrame:
    """One row per piece of a document: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]).

    A document's ids end with id 1. Pieces of `capacity` ids are sequences of their own; the rests of the
    documents are packed by `pack_lengths` in random groups of about `docs_per_group` documents, each group
    by itself, so a task holds one group's rests. A group's sequences are numbered from group * 2^32; ids are
    unsigned 32-bit little-endian. `tokenizer` is a path that every executor can read.

    Groups are drawn by the row's place in the input, not by its content: copies spread over all groups.
    Null text is empty and has the one id 1; null ids, repeated rows and empty texts are packed like others;
    an empty table gives no rows; other columns are not read.
    """
    groups = max(1, -(-docs.count() // docs_per_group))
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).withColumn(
        "row", F.monotonically_increasing_id()
    )
    grouped = rows.select(F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(groups)).alias("grp"), "row", "doc_id", "text")
    pieces = grouped.mapInArrow(lean(lambda batches: _tokenized(batches, tokenizer, capacity)), _CUT)
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return (
        pieces.repartition("grp")
        .sortWithinPartitions("grp")
        .mapInArrow(lean(lambda batches: _packed(batches, capacity, min_fill, keep_ids)), schema + (", ids binary" if keep_ids else ""))
    )
