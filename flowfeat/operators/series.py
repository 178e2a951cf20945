"""Time series: scaling, calendar columns, windows and chronological splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowfeat.columns import as_list, need
from flowfeat.functions import dates
from flowfeat.operators.positions import GROUP_ROWS, SMALL_ROWS, global_positions, group_positions

CHUNK_ROWS = 4096  # least number of rows that one task cuts into windows at a time


def standard_scale(df: DataFrame, cols: str | list[str]) -> DataFrame:
    """Columns minus mean, over the population standard deviation; constant columns give 0.0.

    All statistics come from one aggregate, read back as a scalar subquery.
    """
    cols = as_list(cols)
    need(df, *cols)
    values = {c: F.col(c).cast("double") for c in cols}
    stats = df.agg(
        F.struct(
            *[F.avg(v).alias(f"mean_{c}") for c, v in values.items()],
            *[F.stddev_pop(v).alias(f"std_{c}") for c, v in values.items()],
        ).alias("stats")
    ).scalar()

    def scaled(c: str) -> Column:
        spread = stats[f"std_{c}"]
        centred = values[c] - stats[f"mean_{c}"]
        return F.when(spread == 0, centred * 0.0).otherwise(F.try_divide(centred, spread))

    return df.withColumns({c: scaled(c) for c in cols})


def calendar(df: DataFrame, ts: str) -> DataFrame:
    """Add hour, awake (hour 6 … 23), day_of_week (Monday = 1), month and day."""
    need(df, ts)
    time = dates.parse_timestamp(ts) if dict(df.dtypes)[ts] == "string" else F.col(ts)
    return df.withColumns(
        {
            "hour": F.hour(time),
            "awake": dates.awake_flag(F.hour(time)),
            "day_of_week": dates.day_of_week(time),
            "month": F.month(time),
            "day": F.dayofmonth(time),
        }
    )


def number_rows(
    df: DataFrame, order: str | list[str], key: str | None = None, out: str = "idx", small_rows: int = SMALL_ROWS
) -> DataFrame:
    """Dense 0-based position in time, over the whole series or per key."""
    order = as_list(order)
    need(df, *order, *as_list(key))
    if key is None:
        return global_positions(df, order, out, small_rows=small_rows)
    return group_positions(df, key, order, out, limit=min(small_rows, GROUP_ROWS))


def _chunks(rows: DataFrame, keys: list[str], payload: Column, chunk: int, halo: int) -> DataFrame:
    """(keys, _c, _rows, _own): rows of each chunk and the first `halo` of the next, in order.

    Every row goes to its own chunk and, if it is among the first `halo` of it, also to the
    chunk before, so a window never has to look across a border. Groups hold chunk + halo
    rows, whatever the length of the series.
    """
    own = F.floor(F.col("_idx") / chunk)
    ahead = F.when((F.col("_idx") % chunk < halo) & (own > 0), own - 1)
    spread = rows.select(
        *keys, "_idx", payload.alias("_v"), F.explode(F.array_compact(F.array(own, ahead))).alias("_c")
    )
    grouped = spread.groupBy(*keys, "_c").agg(F.sort_array(F.collect_list(F.struct("_idx", "_v"))).alias("_rows"))
    return grouped.withColumn("_own", F.least(F.size("_rows"), F.lit(chunk)))


def unroll(
    df: DataFrame,
    order: str | list[str],
    cols: str | list[str],
    length: int,
    step: int = 1,
    key: str | None = None,
    chunk: int | None = None,
    labelled: bool = True,
    keep_partial: bool = False,
    small_rows: int = SMALL_ROWS,
) -> DataFrame:
    """Sliding windows (idx, feature, label): rows idx … idx+length-1 of the value columns.

    The label is the first value column `step` rows after the window; a series of n rows has
    n - length - step + 1 labelled windows. With `labelled=False` windows start at the rows
    that precede the last `length` ones and end there too; those the end cuts short are
    kept only with `keep_partial`.
    """
    order, cols, keys = as_list(order), as_list(cols), as_list(key)
    need(df, *order, *cols, *keys)
    if length < 1 or step < 1:
        raise ValueError("length and step must be positive")
    halo = length - 1 + step if labelled else length - 1
    chunk = max(chunk or CHUNK_ROWS, halo + 1)
    rows = number_rows(df.select(*dict.fromkeys([*keys, *order, *cols])), order, key, "_idx", small_rows)
    if not labelled:
        rows = _before_tail(rows, keys, length)
    values = F.array(*[F.col(c).cast("double") for c in cols])
    packed = _chunks(rows, keys, values, chunk, halo)
    # starts in this chunk: its own rows, less those whose window or label is not complete
    starts = F.col("_own") if keep_partial and not labelled else F.least("_own", F.size("_rows") - halo)
    cut = packed.where(starts > 0).select(
        *keys, "_c", F.col("_rows._v").alias("_v"), F.explode(F.sequence(F.lit(1), starts)).alias("_at")
    )
    window = [
        *keys,
        (F.col("_c") * chunk + F.col("_at") - 1).alias("idx"),
        F.slice("_v", F.col("_at"), F.lit(length)).alias("feature"),
    ]
    if not labelled:
        return cut.select(*window)
    label = F.element_at(F.element_at("_v", F.col("_at") + length - 1 + step), 1)
    return cut.select(*window, label.alias("label"))


def _before_tail(rows: DataFrame, keys: list[str], length: int) -> DataFrame:
    """Rows before the last `length` ones, but never fewer than the first `length`."""
    last = F.max("_idx").alias("_last")
    sizes = rows.groupBy(*keys).agg(last) if keys else None
    if sizes is not None:
        rows = rows.join(sizes, keys)
    else:
        rows = rows.withColumn("_last", rows.agg(last).scalar())
    return rows.where(F.col("_idx") < F.greatest(F.lit(length), F.col("_last") + 1 - length)).drop("_last")


def flat_windows(windows: DataFrame, feature: str = "feature") -> DataFrame:
    """Add `flat` (the window as one array) and its shape (`steps`, `width`)."""
    need(windows, feature)
    return windows.withColumns(
        {"flat": F.flatten(feature), "steps": F.size(feature), "width": F.size(F.get(feature, F.lit(0)))}
    )


def strided(
    df: DataFrame, order: str | list[str], col: str, num_steps: int, key: str | None = None, small_rows: int = SMALL_ROWS
) -> DataFrame:
    """(idx, window): num_steps + 1 values every num_steps rows, full windows only.

    Neighbours share one value, so a row belongs to one window, or to two at a border; one
    shuffle on the window number puts them together.
    """
    order, keys = as_list(order), as_list(key)
    need(df, *order, col, *keys)
    rows = number_rows(df.select(*dict.fromkeys([*keys, *order, col])), order, key, "_idx", small_rows)
    own = F.floor(F.col("_idx") / num_steps)
    also = F.when((F.col("_idx") % num_steps == 0) & (own > 0), own - 1)
    spread = rows.select(*keys, "_idx", F.col(col).alias("_v"), F.explode(F.array_compact(F.array(own, also))).alias("_w"))
    windows = spread.groupBy(*keys, "_w").agg(F.sort_array(F.collect_list(F.struct("_idx", "_v"))).alias("_r"))
    return windows.where(F.size("_r") == num_steps + 1).select(
        *keys, (F.col("_w") * num_steps).alias("idx"), F.col("_r._v").alias("window")
    )


def time_split(df: DataFrame, idx: str, test_size: int, gap: int = 0, n: int | None = None) -> DataFrame:
    """Add `split`: the last `test_size` rows by `idx` are 'test', the others 'train'.

    `gap` rows before the cut are left out, so that no training window overlaps a test
    window. `idx` is dense from zero; pass `n` where the row count is known.
    """
    need(df, idx)
    total = F.lit(n) if n is not None else df.agg(F.max(idx) + 1).scalar()
    cut = total - test_size
    side = F.when(F.col(idx) >= cut, F.lit("test")).when(F.col(idx) < cut - gap, F.lit("train"))
    return df.withColumn("split", side).where(F.col("split").isNotNull())


def column_means(df: DataFrame, array: str) -> DataFrame:
    """(pos, mean): mean of every place of an array column."""
    need(df, array)
    return (
        df.select(F.posexplode(array).alias("pos", "value")).groupBy("pos").agg(F.avg("value").alias("mean"))
    )
