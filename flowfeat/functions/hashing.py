"""Repeatable uniform draws made from hashed keys instead of generator state."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _key_text(keys: tuple) -> list[Column]:
    return [F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("")) for k in keys]


def hash_long(*key, seed: int = 42, hash: str = "md5") -> Column:
    """Non-negative long from the key columns: 60 bits of md5 (portable), or xxhash64 (faster)."""
    parts = [*_key_text(key), F.lit(str(seed))]
    if hash == "md5":
        digits = F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15)
        return F.conv(digits, 16, 10).cast("bigint")
    if hash == "xxhash64":
        return F.xxhash64(*parts).bitwiseAND(F.lit((1 << 60) - 1))
    raise ValueError(f"unknown hash {hash!r}")


def hash_uniform(*key, n, seed: int = 42, hash: str = "md5") -> Column:
    """Uniform whole number in 0 … n-1 that depends on nothing but the key and the seed."""
    return hash_long(*key, seed=seed, hash=hash) % (n if isinstance(n, Column) else F.lit(int(n)))


PRIME = (1 << 31) - 1
HALF = (1 << 30) - 1
WIDE = 1 << 24  # above so many ids, 31 random bits are too few for an even draw
OTHER_BITS = 0x5DEECE66D3A5C69


def _spread(base: Column, k: Column) -> Column:
    """(a·k + b) mod 2^31-1 with a and b from the two halves of a row's 60-bit hash.

    Over random a, b any two draws of a row are uniform and independent of each other. Only
    whole-number arithmetic on one hash per row, so it stays cheap inside arrays.
    """
    return (F.shiftright(base, 30) * k.cast("bigint") + base.bitwiseAND(F.lit(HALF))) % F.lit(PRIME)


def other_than(value: Column, base: Column, k, n: int, start: int = 0) -> Column:
    """The k-th draw of a row from {start … start+n-1} without `value`; no rejection loop.

    `base` is the row's `hash_long`. A uniform step of 1 … n-1 ahead of `value`, around the
    circle of ids, reaches every other id with equal chance.
    """
    if n < 2:
        raise ValueError("a negative needs at least two ids to choose from")
    k = k if isinstance(k, Column) else F.lit(int(k))
    bits = _spread(base, k)
    if n > WIDE:
        bits = bits * F.lit(PRIME) + _spread(base.bitwiseXOR(F.lit(OTHER_BITS)), k)
    step = bits % F.lit(int(n) - 1) + F.lit(1)
    if start == 0:
        return (value.cast("bigint") + step) % F.lit(int(n))
    return (value.cast("bigint") - F.lit(int(start)) + step) % F.lit(int(n)) + F.lit(int(start))


def hash_fraction(*key, seed: int = 42) -> Column:
    """Repeatable uniform number in [0, 1) with a resolution of one millionth."""
    return hash_uniform(*key, n=1_000_000, seed=seed) / F.lit(1_000_000.0)
