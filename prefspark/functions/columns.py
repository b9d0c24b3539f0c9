"""Column expressions. All of them stay on the JVM side."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Fixed value: ids live in 0..2147483647 after ingest.
MAX_ID = 2147483647


def id_remap(c: Column) -> Column:
    """Fold ids outside 0..MAX_ID back into the range; others stay as they are."""
    return F.when((c < 0) | (c > MAX_ID), F.abs(c % F.lit(MAX_ID).cast("long"))).otherwise(c)


def dot(u: Column, v: Column) -> Column:
    """Inner product of two equally long double arrays."""
    return F.aggregate(F.zip_with(u, v, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)


def rounded(c: Column, digits: int) -> Column:
    """`c` to so many decimals, in plain double arithmetic: scores are rounded before they are ranked,
    so this runs once or more per scored row."""
    return F.rint(c * 10.0**digits) / 10.0**digits


def l1_norm(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + F.abs(x))


def epoch_hours(ts: Column) -> Column:
    return F.floor(F.unix_seconds(ts) / 3600).cast("long")


def slot_hours(window_hours: int) -> int:
    """Hours in one of the six retention slots; a window that does not divide by six means a day."""
    if window_hours <= 0 or window_hours % 6 != 0:
        window_hours = 24
    return window_hours // 6


def slot_seq(ts: Column, window_hours: int) -> Column:
    """Running number of the slot that holds `ts`; the ring position is this modulo six."""
    return F.floor(epoch_hours(ts) / slot_hours(window_hours)).cast("long")


def _g2_term(k: Column, row: Column, col: Column, n: Column) -> Column:
    """One cell of the G-squared sum, k * ln(k * n / (row * col)); an empty cell adds nothing."""
    k, row, col, n = (c.cast("double") for c in (k, row, col, n))
    return F.when(k > 0, k * F.ln(k * n / (row * col))).otherwise(0.0)


def log_likelihood_ratio(k11: Column, n_i: Column, n_j: Column, n: Column) -> Column:
    """Dunning's statistic for "rated i" against "rated j" among n users.

    Written per cell against its expected count, which avoids subtracting large sums.
    """
    k12, k21, k22 = n_i - k11, n_j - k11, n - n_i - n_j + k11
    total = (
        _g2_term(k11, n_i, n_j, n)
        + _g2_term(k12, n_i, n - n_j, n)
        + _g2_term(k21, n - n_i, n_j, n)
        + _g2_term(k22, n - n_i, n - n_j, n)
    )
    return F.greatest(2.0 * total, F.lit(0.0))


# Similarity measures over the statistics of one item pair. Names they may use:
#   both               users who rated i and j
#   n_i, n_j           users who rated i, users who rated j
#   norm_i, norm_j     sums of squares over all ratings of i, of j
#   n_users            all users
#   sxy, sx, sy, sxx, syy   sums over the users who rated both
MEASURES = {
    "loglikelihood": lambda: 1.0
    - 1.0
    / (
        1.0
        + log_likelihood_ratio(F.col("both"), F.col("n_i"), F.col("n_j"), F.col("n_users"))
    ),
    "tanimoto": lambda: F.col("both") / (F.col("n_i") + F.col("n_j") - F.col("both")),
    "cityblock": lambda: 1.0 / (1.0 + F.col("n_i") + F.col("n_j") - 2 * F.col("both")),
    "cosine": lambda: F.try_divide(F.col("sxy"), F.sqrt(F.col("norm_i") * F.col("norm_j"))),
    "euclidean": lambda: 1.0
    / (1.0 + F.sqrt(F.greatest(F.col("sxx") + F.col("syy") - 2 * F.col("sxy"), F.lit(0.0)))),
    "pearson": lambda: F.try_divide(
        F.col("both") * F.col("sxy") - F.col("sx") * F.col("sy"),
        F.sqrt(
            F.greatest(F.col("both") * F.col("sxx") - F.col("sx") * F.col("sx"), F.lit(0.0))
            * F.greatest(F.col("both") * F.col("syy") - F.col("sy") * F.col("sy"), F.lit(0.0))
        ),
    ),
}


# Measures that have a value for every co-rated pair; results of others are filtered, which evaluates
# the formula again.
ALWAYS_DEFINED = {"loglikelihood", "tanimoto", "cityblock", "euclidean"}


def register_measure(name: str, expression) -> None:
    """Add a similarity measure: `expression()` returns a Column over the names above."""
    MEASURES[name] = expression


def similarity(measure: str) -> Column:
    if measure not in MEASURES:
        raise ValueError(f"unknown similarity measure {measure!r}; known: {sorted(MEASURES)}")
    return MEASURES[measure]()


def uses(measure: str, name: str) -> bool:
    """Whether the measure reads that figure."""
    return re.search(rf"\b{name}\b", str(similarity(measure))) is not None
