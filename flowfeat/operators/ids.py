"""Dense integer ids for natural keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowfeat.columns import as_list, need
from flowfeat.functions import arrays
from flowfeat.functions.hashing import hash_uniform  # noqa: F401  (part of the id surface)
from flowfeat.operators.positions import SMALL_ROWS, global_positions
from flowfeat.session import cut_lineage


def dense_index(
    df: DataFrame,
    col: str,
    out: str | None = None,
    start: int = 0,
    small_rows: int = SMALL_ROWS,
    buckets: int | None = None,
) -> DataFrame:
    """Dictionary (col, <col>_index) of the distinct non-null values, numbered in value order.

    The values are stored once: numbering reads them up to three times, and `df` behind them only once.
    """
    need(df, col)
    values = cut_lineage(df.select(col).where(F.col(col).isNotNull()).distinct())
    return global_positions(values, [col], out or f"{col}_index", start, small_rows, buckets)


def category_index(
    meta: DataFrame,
    col: str = "categories",
    start: int = 1,
    small_rows: int = SMALL_ROWS,
    buckets: int | None = None,
) -> DataFrame:
    """Dictionary (category, category_id) of every name inside the nested lists; 0 stays free."""
    need(meta, col)
    names = meta.select(F.explode(F.flatten(F.filter(col, lambda path: path.isNotNull()))).alias("category"))
    return dense_index(names, "category", "category_id", start, small_rows, buckets)


def index_categories(meta: DataFrame, dictionary: DataFrame, item: str, col: str = "categories") -> DataFrame:
    """(item, categories_index): id of the last name of the first path, 0 where there is none."""
    need(meta, item, col)
    named = meta.select(item, arrays.last_category(col).alias("category"))
    return named.join(dictionary, "category", "left").select(
        item, F.coalesce("category_id", F.lit(0)).cast("long").alias("categories_index")
    )


def frequency_dictionary(
    df: DataFrame, col: str, start: int = 0, small_rows: int = SMALL_ROWS, buckets: int | None = None
) -> DataFrame:
    """(col, count, id): distinct values numbered by falling frequency, ties in value order."""
    need(df, col)
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    return global_positions(counts, [F.desc("count"), F.asc(col)], "id", start, small_rows, buckets)


def frequency_index(
    df: DataFrame,
    cols: str | list[str],
    shift: dict[str, int] | None = None,
    small_rows: int = SMALL_ROWS,
    buckets: int | None = None,
) -> DataFrame:
    """Add `<col>_index` (most frequent value first) for each column.

    The dictionaries stay distributed tables; nothing is collected, so the number of
    distinct values is not limited by the driver. All of them are counted in one pass over
    `df`. Rows with a null value are kept with a null id.
    """
    cols = as_list(cols)
    need(df, *cols)
    pairs = [F.struct(F.lit(k).alias("_c"), F.col(col).cast("string").alias("_v")) for k, col in enumerate(cols)]
    counts = df.select(F.explode(F.array(*pairs)).alias("_p")).where("_p._v IS NOT NULL").groupBy("_p._c", "_p._v")
    counts = cut_lineage(counts.agg(F.count(F.lit(1)).alias("count")))
    coded = df
    for k, col in enumerate(cols):
        mine = counts.where(F.col("_c") == k).select(F.col("_v").cast(df.schema[col].dataType).alias(col), "count")
        order = [F.desc("count"), F.asc(col)]
        numbers = global_positions(mine, order, "id", (shift or {}).get(col, 0), small_rows, buckets)
        coded = coded.join(numbers.select(col, F.col("id").alias(f"{col}_index")), col, "left")
    return coded


def item_categories(df: DataFrame, item: str, category: str) -> DataFrame:
    """One category per item: the smallest, where an item has several."""
    need(df, item, category)
    return df.groupBy(item).agg(F.min(category).alias(category))
