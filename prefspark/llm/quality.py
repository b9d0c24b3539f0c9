"""Rule statistics of documents, and an isolation forest over them with a threshold from labelled rows."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from prefspark.llm.common import BLANK, lean, slices
from prefspark.plans.session import materialize

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks"]
_BINS = 4096


def repeated_words(words: list[str]) -> int:
    """Words that stand in a 3-word window which the text has twice or more."""
    n = len(words)
    if n < 4:
        return 0
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    with np.errstate(over="ignore"):
        grams = (h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1]) * np.uint64(0xD6E8FEB86659FD93) + h[2:]
    ordered = np.sort(grams)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    # Hashes only choose the windows to look at.
    places = np.flatnonzero(np.isin(grams, twice)).tolist()
    seen = Counter((words[i], words[i + 1], words[i + 2]) for i in places)
    covered, until = 0, 0
    for i in places:
        if seen[words[i], words[i + 1], words[i + 2]] > 1:
            covered += i + 3 - max(i, until)
            until = i + 3
    return covered


def rule_counts(text: str | None) -> tuple[int, ...]:
    """The values of `COUNTS`; null counts as empty."""
    text = text or ""
    words = _WORD.findall(text)
    lines = [line for line in text.split("\n") if line.strip(BLANK)]
    return (
        len(words),
        sum(map(len, words)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        sum(map(str.isupper, words)),
        text.count("!") + text.count("?"),
    )


def failed(counts: np.ndarray) -> np.ndarray:
    """The base rules: under 50 words, or more than half of them in repeated windows."""
    n, repeat = counts[:, 0], counts[:, 4]
    return (n < 50) | (100 * repeat > 50 * n)


def features(counts: np.ndarray) -> np.ndarray:
    """Rates, which don't grow with a text: a long document is not odd for its length."""
    c = counts.astype(float)
    words, lines = np.maximum(c[:, 0], 1), np.maximum(c[:, 5], 1)
    return np.stack([c[:, 2] / words, c[:, 1] / words, c[:, 3] / lines, c[:, 4] / words, c[:, 6] / words, c[:, 7] / words], axis=1)


# ---- the forest ----


def expected_path(n: float) -> float:
    """Mean path length of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


class IsolationForest:
    """Trees of random splits on random features, each grown on its own draw of the sample.

    A tree is flat arrays: feature (-1 at a leaf), split value, left and right child, and at a leaf the
    path length, which counts the points left there by `expected_path`.
    """

    def __init__(self, sample: np.ndarray, trees: int, tree_size: int, seed: int):
        rng = np.random.default_rng(seed)
        size = min(tree_size, len(sample))
        self.scale = max(expected_path(size), 1e-9)
        self.trees = [
            self._grow(sample[rng.choice(len(sample), size, replace=False)], rng, math.ceil(math.log2(max(size, 2)))) for _ in range(trees)
        ]

    @staticmethod
    def _grow(points: np.ndarray, rng, limit: int):
        nodes: list[list[float]] = []

        def grow(rows: np.ndarray, depth: int) -> int:
            at = len(nodes)
            nodes.append([-1, 0.0, 0, 0, depth + expected_path(len(rows))])
            low, high = rows.min(axis=0), rows.max(axis=0)
            usable = np.flatnonzero(high > low)
            if depth < limit and len(usable):
                feature = rng.choice(usable)
                split = rng.uniform(low[feature], high[feature])
                less = rows[:, feature] < split
                if less.any() and not less.all():
                    left, right = grow(rows[less], depth + 1), grow(rows[~less], depth + 1)
                    nodes[at] = [feature, split, left, right, 0.0]
            return at

        grow(points, 0)
        kind, split, left, right, path = (np.array(x) for x in zip(*nodes))
        return kind.astype(np.int64), split, left.astype(np.int64), right.astype(np.int64), path

    def score(self, points: np.ndarray) -> np.ndarray:
        """2^-(mean path / expected path): near 1 for points that few splits isolate."""
        total = np.zeros(len(points))
        every = np.arange(len(points))
        for kind, split, left, right, path in self.trees:
            at = np.zeros(len(points), np.int64)
            open_ = every[kind[at] >= 0]
            while len(open_):
                node = at[open_]
                at[open_] = np.where(points[open_, kind[node]] < split[node], left[node], right[node])
                open_ = open_[kind[at[open_]] >= 0]
            total += path[at]
        return 2.0 ** (-total / len(self.trees) / self.scale)


# ---- the model ----


class QualityModel:
    """Ranges of the rates among good rows, the forest over what lies outside them, and the threshold."""

    def __init__(self, low: np.ndarray, high: np.ndarray, forest: IsolationForest | None, threshold: float):
        self.low, self.high, self.forest, self.threshold = low, high, forest, threshold

    def excess(self, counts: np.ndarray) -> np.ndarray:
        rates = features(counts)
        return np.maximum(rates - self.high, 0) + np.maximum(self.low - rates, 0)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        if self.forest is None or not len(counts):
            return np.zeros(len(counts))
        return self.forest.score(self.excess(counts))

    def keeps(self, counts: np.ndarray) -> np.ndarray:
        return ~failed(counts) & (self.scores(counts) <= self.threshold)


def _counted(batches: Iterable[pa.RecordBatch], text_at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        counts = np.array([rule_counts(text) for text in batch.column(text_at).to_pylist()], np.int64)
        yield batch, counts.reshape(-1, len(COUNTS))


def document_counts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, the columns of COUNTS) for every row; null text counts as empty."""

    def run(batches):
        for batch, counts in _counted(slices(batches, "text", 16 << 20), 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in counts.T)], ["doc_id", *COUNTS])

    schema = "doc_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS)
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(lean(run), schema)


def _matrix(rows: list) -> np.ndarray:
    return np.array([[r[c] for c in COUNTS] for r in rows], np.int64).reshape(-1, len(COUNTS))


def _bins(model: QualityModel):
    def run(batches):
        for batch in batches:
            counts = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in COUNTS], axis=1)
            bins = np.floor(model.scores(counts) * _BINS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("good")), pa.array(bins)], ["good", "bin"])

    return run


def best_threshold(good: np.ndarray, bad: np.ndarray, max_clean_loss: float, clean_weight: float) -> float:
    """From counts per score bin: the cut with the largest share of bad rows rejected less `clean_weight`
    times the share of good rows rejected.

    At most `max_clean_loss` of the good rows may go. The middle of the best cuts is taken.
    """
    lost_good = (good[::-1].cumsum()[::-1] - good) / max(good.sum(), 1)  # scores above the bin
    lost_bad = (bad[::-1].cumsum()[::-1] - bad) / max(bad.sum(), 1)
    gain = np.where(lost_good <= max_clean_loss, lost_bad - clean_weight * lost_good, -1.0)
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    # The run of equally good cuts that ends highest, so that unseen clean rows keep most room.
    run = best[np.flatnonzero(np.diff(best, prepend=best[0] - 2) > 1)[-1] == np.arange(len(best))]
    return (int(run[0]) + int(best[-1])) / 2 / _BINS + 1 / _BINS


def fit(
    counts: DataFrame,
    labels: DataFrame,
    trees: int = 100,
    tree_size: int = 256,
    good_sample: int = 4096,
    bad_share: float = 0.05,
    tail: float = 0.001,
    slack: float = 0.5,
    max_clean_loss: float = 0.001,
    clean_weight: float = 10.0,
    seed: int = 11,
) -> QualityModel:
    """Fit the forest on labelled rows of `counts` (see `document_counts`) and calibrate its threshold.

    The rates' ranges are the quantiles `tail` and 1 - `tail` of all rows labelled good that pass the base
    rules, widened by `slack` of their width to either side. The forest sees what lies outside them, on a sample of at most `good_sample` good rows and a
    share `bad_share` of bad ones (the bound on what the driver collects). The threshold is taken from the
    scores of all labelled rows that pass the base rules, as counts per bin.

    A document labelled both ways counts as bad, null labels and ids don't count. Without good rows there is
    no forest and the base rules decide alone; without bad rows the threshold is the highest.
    """
    verdicts = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("label_id")).agg(F.min("quality").alias("good"))
    passed = counts.where("n_words >= 50 AND 100 * n_repeat_words <= 50 * n_words")
    labelled = materialize(passed.join(verdicts, passed.doc_id == verdicts.label_id).select("doc_id", *COUNTS, "good"), "quality-labelled")
    rates = {
        "symbols": "n_symbols / n_words", "chars": "word_chars / n_words", "lines": "n_dup_lines / greatest(n_lines, 1)",
        "repeat": "n_repeat_words / n_words", "upper": "n_upper / n_words", "marks": "n_marks / n_words",
    }
    bounds = labelled.where("good = 1").agg(
        *(F.expr(f"percentile_approx({rate}, array({tail}D, {1 - tail}D), 10000)").alias(name) for name, rate in rates.items())
    ).first()
    if bounds.symbols is None:
        zeros = np.zeros(len(rates))
        return QualityModel(zeros, zeros, None, 1.0)
    low, high = (np.array([bounds[name][i] for name in rates]) for i in (0, 1))
    low, high = low - slack * (high - low), high + slack * (high - low)

    n_rows = {r.good: r["count"] for r in labelled.groupBy("good").count().collect()}

    def draw(good: int, n: int) -> np.ndarray:
        # Rows below a share of the hash's range that holds about n of them, so that no task returns more.
        h = F.xxhash64("doc_id", F.lit(seed)).bitwiseAND((1 << 53) - 1)
        share = min(1.0, 1.1 * n / max(n_rows.get(good, 0), 1))
        rows = labelled.where((F.col("good") == good) & (h <= share * (1 << 53))).withColumn("h", h).collect()
        return _matrix(sorted(rows, key=lambda r: (r.h, r[1:-2]))[:n])

    model = QualityModel(low, high, None, 1.0)
    sample = draw(1, good_sample)
    sample = np.concatenate([sample, draw(0, math.ceil(len(sample) * bad_share))])
    model.forest = IsolationForest(model.excess(sample), trees, tree_size, seed)
    good, bad = np.zeros(_BINS + 1), np.zeros(_BINS + 1)
    for row in labelled.mapInArrow(lean(_bins(model)), "good int, bin bigint").groupBy("good", "bin").count().collect():
        (good if row.good == 1 else bad)[row.bin] += row["count"]
    model.threshold = best_threshold(good, bad, max_clean_loss, clean_weight) if bad.sum() else 1.0
    return model


def judge(counts: DataFrame, model: QualityModel) -> DataFrame:
    """`counts` with base_failed, score and kept."""

    def run(batches):
        for batch in batches:
            matrix = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in COUNTS], axis=1)
            base, score = failed(matrix), model.scores(matrix)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(base), pa.array(score), pa.array(~base & (score <= model.threshold))],
                [*batch.schema.names, "base_failed", "score", "kept"],
            )

    return counts.mapInArrow(lean(run), counts.schema.simpleString()[7:-1].replace(":", " ") + ", base_failed boolean, score double, kept boolean")


def quality_verdicts(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, COUNTS, base_failed, score, kept) for every row of `docs`; see `fit` and `rule_counts`.

    Null text has no words and fails; null ids and repeated rows get rows of their own; an empty table gives
    no rows; other columns are not read.
    """
    counts = materialize(document_counts(docs), "quality-counts")
    return judge(counts, fit(counts, labels, **options))


def filter_quality(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The rows of `docs` that the verdict keeps, with all their columns: one pass to fit, one to filter, no shuffle of texts.

    Null and empty texts have no words and go. A null id has no label and is judged like others; rows that repeat
    an id, and equal texts, are judged each. Without good rows the base rules decide alone. An empty table stays empty.
    """
    model = fit(materialize(document_counts(docs, id_column, text_column), "quality-counts"), labels, **options)
    text_at = docs.columns.index(text_column)

    def run(batches):
        for batch, counts in _counted(slices(batches, text_column, 16 << 20), text_at):
            yield batch.filter(pa.array(model.keeps(counts)))

    return docs.mapInArrow(lean(run), docs.schema)
