"""Quality of documents: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from prefspark.llm.common import slices

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "stop": b".,;:", "loud": b"!?",
    "quote": b"\"'()-", "symbol": b"#*$%&|<>", "other": b"+/=@[\\]^_`{}~", "blank": b" \t\r\x0b\x0c", "line": b"\n",
}
_CHARS = np.zeros((256, len(_CLASSES) + 2))
for _i, _bytes in enumerate(_CLASSES.values()):
    _CHARS[list(_bytes), _i] = 1
_CHARS[192:, -2] = 1  # the first byte of a character beyond ASCII
_CHARS[[*range(9), *range(14, 32), 127], -1] = 1
#: Statistics of a text: rates, and logarithms of its sizes.
FEATURES = [
    *(f"{name}_chars" for name in _CLASSES), "beyond_ascii", "control_chars", "log_words", "word_chars", "longest_word", "short_words", "upper_words",
    "letterless_words", "spoilt_words", "distinct_words", "top_word", "repeated_pairs", "same_as_before", "words_per_line", "repeated_lines", "entropy", "letters_entropy", "links",
]
#: Letters and what lies beyond ASCII as one letter; deleting the rest leaves the words that have any.
_LETTER = bytes(97 if b >= 128 or 65 <= b <= 90 or 97 <= b <= 122 else b for b in range(256))
_NO_LETTER = bytes(b for b in range(128) if b not in b" \t\n\r\x0b\x0c" and not (65 <= b <= 90 or 97 <= b <= 122))
_LINK = re.compile(rb"https?:|www\.|@|\.com|\.org")
_SPOILT = re.compile(rb"[A-Za-z\x80-\xff][#*$%&|<>!]{2,}|[#*$%&|<>]{2,}|[A-Za-z][0-9]+[A-Za-z]")


def _entropy(counts: np.ndarray) -> float:
    n = counts.sum()
    p = counts[counts > 0] / max(n, 1)
    return float(-(p * np.log2(p)).sum())


def statistics(text: bytes | None) -> list[float]:
    """The values of `FEATURES` for a UTF-8 text; an empty one has zeros only."""
    text = text or b""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    classes = counts @ _CHARS
    chars = max(int(counts.sum() - counts[128:192].sum()), 1)
    words = text.split()
    n = max(len(words), 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    seen = Counter(words)
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    pairs = np.unique(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:], return_counts=True)[1]
    lines = [line for line in text.split(b"\n") if line.strip()]
    letters = counts[97:123].copy()
    letters += counts[65:91]
    return [
        *(classes / chars),
        np.log1p(len(words)),
        float(lengths.sum()) / n,
        np.log1p(float(lengths.max(initial=0))),
        float((lengths <= 3).sum()) / n,
        sum(map(bytes.isupper, words)) / n,
        (len(words) - len(text.translate(_LETTER, _NO_LETTER).split())) / n,
        len(_SPOILT.findall(text)) / n,
        len(seen) / n,
        max(seen.values(), default=0) / n,
        float(pairs[pairs > 1].sum()) / n,
        float((h[1:] == h[:-1]).sum()) / n,
        len(words) / max(len(lines), 1),
        (len(lines) - len(set(lines))) / max(len(lines), 1),
        _entropy(counts),
        _entropy(letters),
        len(_LINK.findall(text)) / n,
    ]


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.array([statistics(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]).reshape(-1, len(FEATURES))


# ---- the trees ----


class BoostedTrees:
    """Logistic boosting: complete binary trees in flat arrays, grown from histograms of binned features.

    `edges` has each feature's bin limits. Node k of a tree has the children 2k + 1 and 2k + 2: a row goes
    right if its bin is above the node's. An inner node that found no split sends all rows left.
    """

    def __init__(self, edges: list[np.ndarray], start: float, feature: np.ndarray, above: np.ndarray, value: np.ndarray):
        self.edges, self.start, self.feature, self.above, self.value = edges, start, feature, above, value

    def state(self) -> tuple:
        return self.edges, self.start, self.feature, self.above, self.value

    def bins(self, points: np.ndarray) -> np.ndarray:
        columns = [np.searchsorted(edges, points[:, i], side="right") for i, edges in enumerate(self.edges)]
        return np.stack(columns, axis=1).astype(np.int64) if len(points) else np.zeros((0, len(self.edges)), np.int64)

    def scores(self, points: np.ndarray) -> np.ndarray:
        """Probabilities, all rows of a tree at a time, one step to the level."""
        bins, total, row = self.bins(points), np.full(len(points), self.start), np.arange(len(points))
        inner = self.feature.shape[1]
        for feature, above, value in zip(self.feature, self.above, self.value):
            node = np.zeros(len(points), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (bins[row, feature[node]] > above[node])
            total += value[node - inner]
        return 1 / (1 + np.exp(-total))


def _quantiles(values: np.ndarray, bins: int) -> np.ndarray:
    """Limits between at most `bins` bins, in the middle between neighbouring values."""
    distinct = np.unique(values)
    if len(distinct) > bins:
        distinct = np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))
        return distinct
    return (distinct[1:] + distinct[:-1]) / 2


def fit(points: np.ndarray, good: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64, ridge: float = 1.0, least: float = 4.0) -> BoostedTrees:
    """Boost on the rows of `points` with labels 0 and 1.

    Every level of a tree takes one histogram of gradients and curvatures by (node, feature, bin), and every node the
    split with the largest gain of the second-order objective, the lowest feature and bin in a tie, among those that
    leave `least` rows on both sides. `ridge` draws leaves towards 0.
    """
    edges = [_quantiles(points[:, i], bins) for i in range(points.shape[1])]
    share = min(max(float(good.mean()), 1e-6), 1 - 1e-6) if len(good) else 0.5
    inner = (1 << depth) - 1
    model = BoostedTrees(edges, float(np.log(share / (1 - share))), np.zeros((0, inner), np.int64), np.zeros((0, inner), np.int64), np.zeros((0, inner + 1)))
    if not len(good) or good.min() == good.max():
        return model
    binned, n_features = model.bins(points), len(edges)
    flat = binned + np.arange(n_features) * bins
    total, grown = np.full(len(good), model.start), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        gradient, curve = p - good, np.maximum(p * (1 - p), 1e-12)
        node = np.zeros(len(good), np.int64)
        feature, above = np.zeros(inner, np.int64), np.full(inner, bins, np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            at = ((node - first)[:, None] * (n_features * bins) + flat).reshape(-1)
            shape = (width, n_features, bins)
            g, h, n = (np.bincount(at, np.repeat(w, n_features), width * n_features * bins).reshape(shape).cumsum(axis=2) for w in (gradient, curve, np.ones(len(good))))
            gain = g**2 / (h + ridge) + (g[..., -1:] - g) ** 2 / (h[..., -1:] - h + ridge) - g[..., -1:] ** 2 / (h[..., -1:] + ridge)
            gain[(n < least) | (n[..., -1:] - n < least)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            found = gain.reshape(width, -1)[np.arange(width), best] > 1e-9
            feature[first : first + width] = np.where(found, best // bins, 0)
            above[first : first + width] = np.where(found, best % bins, bins)
            node = 2 * node + 1 + (binned[np.arange(len(good)), feature[node]] > above[node])
        leaf = node - inner
        g, h = (np.bincount(leaf, w, inner + 1) for w in (gradient, curve))
        value = -rate * g / (h + ridge)
        total += value[leaf]
        grown.append((feature, above, value))
    model.feature, model.above, model.value = (np.stack(x) for x in zip(*grown))
    return model


# ---- Spark ----


def _held_out(id_column, folds: int, held: int):
    return F.pmod(F.crc32(F.coalesce(id_column.cast("string"), F.lit(""))), F.lit(folds)) == held


def training_rows(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, folds: int, held: int, sample: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most `sample` labelled documents outside the held-out fold, drawn by a hash of their ids."""
    h = F.xxhash64("doc_id", F.lit(seed)).bitwiseAND((1 << 53) - 1)
    usable = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").alias("good"))
        .where(~_held_out(F.col("doc_id"), folds, held))
        .withColumn("h", h)
    )
    share = min(1.0, 1.1 * sample / max(usable.count(), 1))
    drawn = sorted(usable.where(F.col("h") <= share * (1 << 53)).collect(), key=lambda r: (r.h, r.doc_id))[:sample]
    if not drawn:
        return np.zeros((0, len(FEATURES))), np.zeros(0)
    ids = F.broadcast(docs.sparkSession.createDataFrame([(r.doc_id,) for r in drawn], "drawn_id bigint"))
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).join(ids, F.col("doc_id") == F.col("drawn_id")).select("doc_id", "text")

    def run(batches):
        for batch in slices(batches, "text", 16 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(_matrix(batch)), pa.list_(pa.float64()))], ["doc_id", "x"])

    # Rows that repeat an id count once.
    found = rows.mapInArrow(run, "doc_id bigint, x array<double>").groupBy("doc_id").agg(F.min("x").alias("x")).collect()
    good = {r.doc_id: r.good for r in drawn}
    found.sort(key=lambda r: r.doc_id)
    return np.array([r.x for r in found]).reshape(-1, len(FEATURES)), np.array([float(good[r.doc_id] > 0) for r in found])


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    folds: int = 5,
    held: int = 0,
    cut: float = 0.3,
    sample: int = 20_000,
    seed: int = 17,
    **options,
) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of `docs`: how likely its quality label is 1.

    Boosted trees (`fit`) over statistics of whole texts. Labels are learnt from documents whose crc32(doc_id as text)
    mod `folds` is not `held`, at most `sample` of them, the bound on what is collected and broadcast; the model is
    grown on the driver from their statistics. Scoring reads every text once, without a shuffle.

    Null and empty texts have statistics of 0 and are scored like others; a null id counts as the id "" for the fold
    and has no label; rows that repeat an id are scored each. A document labelled both ways counts as 0, null labels don't
    count, and without labels, or with labels of one kind, every score is the share of ones among them (0.5 without).
    An empty table gives no rows; other columns are not read.
    """
    model = fit(*training_rows(docs, labels, id_column, text_column, folds, held, sample, seed), **options).state()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = BoostedTrees(*model)
        for batch in slices(batches, "text", 16 << 20):
            score = trees.scores(_matrix(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(score), pa.array((score >= cut).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"), _held_out(F.col(id_column), folds, held).alias("held_out"))
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")
