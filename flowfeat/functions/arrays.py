"""Array expressions: vectors, padding, nested lists, checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def length_of(array) -> Column:
    return F.size(_c(array))


def more_than_one(array) -> Column:
    return F.size(_c(array)) > 1


def same_length(a, b) -> Column:
    return F.size(_c(a)) == F.size(_c(b))


def _double_sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda total, x: total + x)


def dot(a, b) -> Column:
    """Dot product of two arrays; fails where the lengths differ."""
    products = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(same_length(a, b), _double_sum(products)).when(
        _c(a).isNotNull() & _c(b).isNotNull(),
        F.raise_error(F.lit("vectors differ in length")).cast("double"),
    )


def dot_fixed(a, b, size: int) -> Column:
    """Dot product of two arrays of known length, written out so that it is compiled."""
    terms = [F.get(_c(a), F.lit(i)).cast("double") * F.get(_c(b), F.lit(i)).cast("double") for i in range(size)]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total


def norm(a) -> Column:
    return F.sqrt(_double_sum(F.transform(_c(a), lambda x: x.cast("double") * x.cast("double"))))


def cosine(a, b) -> Column:
    """Cosine similarity; NULL where a vector is all zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def abs_cosine(a, b) -> Column:
    return F.abs(cosine(a, b))


def concat_vectors(a, b, size: int | None = None) -> Column:
    """One array of double from two; fails where the joined size is not `size`."""
    joined = F.transform(F.concat(_c(a), _c(b)), lambda x: x.cast("double"))
    if size is None:
        return joined
    return F.when(F.size(joined) == size, joined).when(
        joined.isNotNull(),
        F.raise_error(F.lit(f"joined vector does not have {size} values")).cast("array<double>"),
    )


def all_non_negative(array) -> Column:
    """The array itself; fails where a value is below zero."""
    array = _c(array)
    return F.when(F.exists(array, lambda x: x < 0), F.raise_error(F.lit("negative feature value"))).otherwise(array)


def last_category(paths) -> Column:
    """Last name of the first category path; NULL for null or empty lists."""
    return F.try_element_at(F.get(_c(paths), F.lit(0)), F.lit(-1))


def pad(array, length: int, value=0, side: str = "left", keep: str = "last") -> Column:
    """Exactly `length` values: cut to the last (or first) ones, padded on one side."""
    if length < 1:
        raise ValueError("length must be positive")
    if side not in ("left", "right") or keep not in ("first", "last"):
        raise ValueError("side is left or right, keep is first or last")
    array = _c(array)
    if keep == "last":
        kept = F.slice(array, F.greatest(F.size(array) - length + 1, F.lit(1)), F.lit(length))
    else:
        kept = F.slice(array, 1, length)
    fill = F.array_repeat(value if isinstance(value, Column) else F.lit(value), F.lit(length) - F.size(kept))
    return F.concat(fill, kept) if side == "left" else F.concat(kept, fill)


def mask_of(array, pad_value=0) -> Column:
    """1 where a padded value is above the padding value, else 0."""
    return F.transform(_c(array), lambda x: (x > F.lit(pad_value)).cast("int"))
