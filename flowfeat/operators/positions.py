"""Dense positions in a total order, over a whole table or per key, without one-task sorts.

Small tables and small keys use a plain `row_number`. Anything above an estimated row count is
cut at literal borders of the *complete* order (so a single huge key is spread over many
tasks), numbered inside each bucket and shifted by the sizes of the buckets before it. Borders
are values inside the plan, so a row's bucket follows from the row alone: nothing is stored,
and lost executors recompute the same numbers.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowfeat.columns import as_list, need
from flowfeat.session import cut_lineage

SMALL_ROWS = 200_000  # a table of about so many rows may be ordered by one task
GROUP_ROWS = 100_000  # at most so many rows of one key may meet in one task
PART_ROWS = 2_000_000  # aimed rows per bucket
BROADCAST_ROWS = 100_000  # a key list of at most so many rows may be broadcast
SAMPLE_ROWS = 4096  # rows with the smallest hashes: they give the borders and the row count
MOST_PARTS = 8192  # borders are literals of the plan

_PART, _AT, _BASE, _HASH = "_ff_part", "_ff_at", "_ff_base", "_ff_hash"


@dataclass(frozen=True)
class Key:
    """One column of an order."""

    name: str
    down: bool = False
    nulls_last: bool = False

    @classmethod
    def of(cls, given: str | Column) -> Key:
        """From a name (rising, null first) or a sort column over a plain name."""
        if isinstance(given, str):
            return cls(given)
        text = re.fullmatch(r"Column<'(.*)'>", str(given), re.DOTALL).group(1)
        sort = re.fullmatch(r"(.*?) (ASC|DESC)(?: NULLS (FIRST|LAST))?", text, re.DOTALL)
        if sort is None:
            return cls(text)
        down = sort.group(2) == "DESC"
        return cls(sort.group(1), down, sort.group(3) == "LAST" if sort.group(3) else down)

    def column(self) -> Column:
        plain = F.col(self.name)
        if self.down:
            return plain.desc_nulls_last() if self.nulls_last else plain.desc_nulls_first()
        return plain.asc_nulls_last() if self.nulls_last else plain.asc_nulls_first()

    def follows(self, later: Column, earlier: Column) -> Column:
        """Does `later` come strictly behind `earlier`?"""
        beyond = later < earlier if self.down else later > earlier
        none, other = (later, earlier) if self.nulls_last else (earlier, later)
        return F.coalesce(beyond, none.isNull() & other.isNotNull())


def _reached(row: list[Column], border: Column, keys: list[Key]) -> Column:
    """Does `row` come at or behind the border?"""
    out = F.lit(True)
    for i in reversed(range(len(keys))):
        out = keys[i].follows(row[i], border[f"k{i}"]) | (row[i].eqNullSafe(border[f"k{i}"]) & out)
    return out


def _bucket(keys: list[Key], borders: list) -> Column:
    """Number of borders at or before a row, by binary search."""
    if not borders:
        return F.lit(0)
    listed = F.array(*[F.struct(*[F.lit(v).alias(f"k{i}") for i, v in enumerate(b)]) for b in borders])
    steps = F.array(*[F.lit(1 << s) for s in reversed(range(len(borders).bit_length()))])
    row = [F.col(k.name) for k in keys]

    def step(at: Column, width: Column) -> Column:
        ahead = at + width
        inside = (ahead <= len(borders)) & F.coalesce(_reached(row, F.get(listed, ahead - 1), keys), F.lit(False))
        return F.when(inside, ahead).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


class Borders:
    """How many rows a table has (about, exact below SAMPLE_ROWS), and where to cut its order."""

    def __init__(self, df: DataFrame, order: list):
        self.df, self.keys = df, [Key.of(k) for k in order]
        names = [k.name for k in self.keys]
        self.hashed = df.select(*dict.fromkeys(names), F.xxhash64(*names).alias(_HASH))
        self.sample = self._sorted(self.hashed.orderBy(_HASH).limit(SAMPLE_ROWS))
        self.rows = len(self.sample)
        if self.rows == SAMPLE_ROWS:
            hashes = {r[_HASH] for r in self.sample}
            # the k-th smallest of n even hashes lies at k / n of their range
            self.share = (max(hashes) + (1 << 63) + 1) / (1 << 64)
            self.rows = int(SAMPLE_ROWS / self.share) if 2 * len(hashes) > SAMPLE_ROWS else df.count()

    def _sorted(self, rows: DataFrame) -> list:
        return rows.orderBy(*[k.column() for k in self.keys]).collect()

    def cut(self, parts: int | None = None) -> Column:
        """The bucket of a row; about `parts` buckets of equal size, numbered in the order."""
        parts = parts or max(int(self.df.sparkSession.conf.get("spark.sql.shuffle.partitions")), self.rows // PART_ROWS + 1)
        parts, sample = min(parts, MOST_PARTS), self.sample
        if 8 * parts > len(sample) == SAMPLE_ROWS:  # more borders need more rows: those below a literal hash
            bound = int(min(1.0, 8 * parts / max(self.rows, 1)) * ((1 << 64) - 1)) - (1 << 63)
            sample = self._sorted(self.hashed.where(F.col(_HASH) <= F.lit(bound)).limit(64 * MOST_PARTS)) or sample
        picked = [tuple(sample[i * len(sample) // parts][k.name] for k in self.keys) for i in range(1, parts)] if sample else []
        return _bucket(self.keys, list(dict.fromkeys(picked)))

    def numbered(self, parts: int | None = None) -> DataFrame:
        """The table with its bucket, and the place of a row in the whole order."""
        rows = self.df.withColumn(_PART, self.cut(parts))
        order = [k.column() for k in self.keys]
        placed = rows.withColumn(_AT, F.row_number().over(W.partitionBy(_PART).orderBy(*order)).cast("long") - 1)
        # one row a bucket: at most MOST_PARTS rows meet in the window over them
        sizes = rows.groupBy(F.col(_PART).alias("_ff_p")).agg(F.count(F.lit(1)).alias("_ff_n"))
        before = F.sum("_ff_n").over(W.orderBy("_ff_p").rowsBetween(W.unboundedPreceding, -1))
        bases = sizes.select("_ff_p", F.coalesce(before, F.lit(0)).alias(_BASE))
        joined = placed.join(bases, F.col(_PART) == F.col("_ff_p"))
        return joined.withColumn(_AT, F.col(_AT) + F.col(_BASE)).drop("_ff_p", _BASE)


def global_positions(
    df: DataFrame,
    order: list,
    out: str = "idx",
    start: int = 0,
    small_rows: int = SMALL_ROWS,
    parts: int | None = None,
) -> DataFrame:
    """Add `out` = start, start+1, … in the order of `order` (names or sort columns).

    The order must be total; rows that tie on it get adjacent numbers in any order.
    """
    borders = Borders(df, order)
    if borders.rows <= small_rows:
        at = F.row_number().over(W.orderBy(*[k.column() for k in borders.keys])).cast("long") - 1 + start
        return df.withColumn(out, at)
    return borders.numbered(parts).withColumn(out, F.col(_AT) + start).drop(_PART, *([_AT] if out != _AT else []))


def hot_keys(df: DataFrame, key: str | list[str], limit: int = GROUP_ROWS) -> DataFrame | None:
    """Keys with more than `limit` rows (None if there are none), from one partial aggregate."""
    keys = as_list(key)
    need(df, *keys)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_ff_n"))
    hot = cut_lineage(counts.where(F.col("_ff_n") > limit).select(*keys))  # counted once; several jobs read it
    return None if hot.isEmpty() else hot


def split_hot(df: DataFrame, key: str | list[str], limit: int = GROUP_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ordinary keys, rows of keys above `limit` or None); together exactly `df`."""
    keys = as_list(key)
    hot = hot_keys(df, keys, limit)
    if hot is None:
        return df, None
    listed = hot.select(*[F.col(k).alias(f"_ff_hot_{k}") for k in keys])
    if listed.count() <= BROADCAST_ROWS:
        listed = F.broadcast(listed)
    same = [df[k].eqNullSafe(listed[f"_ff_hot_{k}"]) for k in keys]
    return df.join(listed, same, "left_anti"), df.join(listed, same, "left_semi")


def hot_positions(
    df: DataFrame, key: str | list[str], order: list, out: str, parts: int | None = None, size_out: str | None = None
) -> DataFrame:
    """Position inside each key (and the key's row count) when a key is too large for one task.

    Every (bucket, key) pair holds at most one bucket's rows, so the join that brings
    back a key's first number is balanced however many rows the key has.
    """
    keys = as_list(key)
    numbered = Borders(df, [*keys, *order]).numbered(parts)
    runs = numbered.groupBy(_PART, *keys).agg(F.min(_AT).alias("_ff_run"), F.count(F.lit(1)).alias("_ff_n"))
    # one row per bucket and key here, so a window group holds at most as many rows as there are buckets
    whole = W.partitionBy(*keys)
    starts = runs.select(
        F.col(_PART).alias("_ff_p"),
        *[F.col(k).alias(f"_ff_k_{k}") for k in keys],
        F.min("_ff_run").over(whole).alias("_ff_first"),
        F.sum("_ff_n").over(whole).alias("_ff_size"),
    )
    same = [numbered[_PART] == starts["_ff_p"]]
    same += [numbered[k].eqNullSafe(starts[f"_ff_k_{k}"]) for k in keys]
    placed = numbered.join(starts, same).withColumn(out, F.col(_AT) - F.col("_ff_first"))
    if size_out:
        placed = placed.withColumn(size_out, F.col("_ff_size"))
    return placed.select(*df.columns, out, *([size_out] if size_out else []))


def group_positions(
    df: DataFrame, key: str | list[str], order: list, out: str = "idx", limit: int = GROUP_ROWS, parts: int | None = None
) -> DataFrame:
    """Add `out` = 0, 1, … inside each key, in the order of `order`."""
    keys = as_list(key)
    cold, hot = split_hot(df, keys, limit)
    at = F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("long") - 1
    placed = cold.withColumn(out, at)
    if hot is None:
        return placed
    return placed.unionByName(hot_positions(hot, keys, order, out, parts))
