"""Score, label and rounding expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def add_one(col) -> Column:
    return _c(col) + F.lit(1)


def above_one(col) -> Column:
    """1.0 where the value is greater than one, else 0.0."""
    return F.when(_c(col) > 1, F.lit(1.0)).otherwise(F.lit(0.0))


def score_to_label(score, cut: float) -> Column:
    """1.0 where the score is strictly above the cut, else 0.0."""
    return F.when(_c(score) > F.lit(float(cut)), F.lit(1.0)).otherwise(F.lit(0.0))


def score_to_bucket(score) -> Column:
    """Tenth of the score, truncated: 0.57 is bucket 5 and 1.0 is bucket 10."""
    return (_c(score) * 10).cast("int")


def to_decimal(col, places: int) -> Column:
    """Round half up to `places` decimals."""
    return F.round(_c(col), places)


def share(part, total) -> Column:
    """part / total as a double; NULL for a zero total."""
    return F.try_divide(_c(part).cast("double"), _c(total).cast("double"))


def rank_gain(rank) -> Column:
    """Discounted gain ln 2 / ln(rank + 1) of a hit at `rank`."""
    return F.log(F.lit(2.0)) / F.log(_c(rank).cast("double") + 1.0)


def squared_error(prediction, label) -> Column:
    diff = _c(prediction).cast("double") - _c(label).cast("double")
    return diff * diff


def cuts_below(score, cuts: int = 49, per_unit: float = 50.0) -> Column:
    """How many of the cut points 1/50 … 49/50 lie strictly below the score.

    The truncated product may be off by one in floating point, so it is compared once with
    the neighbouring cut points, which are formed the same way everywhere (i / 50.0).
    """
    score = _c(score)
    guess = F.floor(score * per_unit)
    exact = (
        F.when(score > (guess + 1) / F.lit(per_unit), guess + 1)
        .when(score > guess / F.lit(per_unit), guess)
        .otherwise(guess - 1)
    )
    return F.least(F.greatest(exact, F.lit(0)), F.lit(cuts)).cast("int")
