"""Composed jobs: sequence features, sensor and taxi windows, text featurisation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowfeat.functions import dates
from flowfeat.operators import ids, sampling, sequence, series, text
from flowfeat.operators.positions import SMALL_ROWS
from flowfeat.session import cut_lineage
from flowfeat.sources import readers, writers


@dataclass(frozen=True)
class SequenceParams:
    """Settings of the sequence job."""

    his_len_min: int = 1  # least number of earlier events of a kept row
    his_len_max: int = 10  # length of the padded histories
    negative_num: int = 1  # negatives per row
    non_clk: int = 1  # negatives per history element
    max_targets: int | None = 100  # last events of a user that become rows
    history_len: int | None = None  # cap of the unpadded histories; None keeps them whole
    seed: int = 42
    hash: str = "md5"
    group_rows: int | None = None
    small_rows: int = SMALL_ROWS


def sequence_features(
    facts: DataFrame,
    meta: DataFrame,
    params: SequenceParams = SequenceParams(),
    item: str = "asin",
    user: str = "reviewerID",
    time: str = "unixReviewTime",
    tie: list[str] = (),
) -> DataFrame:
    """Ids, histories, negatives, negative histories, padding and masks in one table.

    Ids start at one, so that zero is free for padding. The indexed facts are stored once:
    ids, categories, the check for huge users and the histories all read them.
    """
    joined = sequence.join_facts(
        facts, meta, item, user, [time, *tie], start=1, small_rows=params.small_rows
    ).withColumnRenamed("categories_index", "cat_index")
    joined = cut_lineage(joined)
    item_id, user_id = f"{item}_index", f"{user}_index"
    categories = ids.item_categories(joined, item_id, "cat_index")
    n_items = joined.agg(F.max(item_id)).first()[0] or 0

    rows = sequence.history(
        joined, user_id, time, list(tie), [item_id, "cat_index"], params.max_targets, params.history_len,
        params.his_len_min, params.group_rows,
    ).withColumnsRenamed({f"{item_id}_history": f"{item}_history", "cat_index_history": "cat_history"})
    rows = sampling.negatives_per_row(
        rows, item_id, n_items, params.negative_num, seed=params.seed, key=[user_id, "pos"], start=1, hash=params.hash
    )
    rows = sequence.negative_history(
        rows, f"{item}_history", categories, n_items, params.non_clk, params.seed,
        [user_id, "pos", item_id, "label"], start=1, hash=params.hash,
    )
    histories = ["cat_history", f"{item}_history"]
    return sequence.mask(sequence.prepad(rows, histories, params.his_len_max), histories)


def sequence_job(spark: SparkSession, reviews: str, meta: str, out: str, params: SequenceParams = SequenceParams()) -> None:
    """Files to files: JSON reviews and item metadata in, a Parquet table out."""
    table = sequence_features(readers.reviews(spark, reviews), readers.item_meta(spark, meta), params)
    writers.to_parquet(table, out)


def series_windows(
    df: DataFrame, order: str, cols: list[str], length: int, test_size: int, step: int = 1, gap: int = 0,
    small_rows: int = SMALL_ROWS,
) -> DataFrame:
    """Scaled columns, unrolled to (idx, feature, label), the last `test_size` windows as test."""
    scaled = series.standard_scale(df.select(order, *cols), cols)
    windows = series.unroll(scaled, order, cols, length, step, small_rows=small_rows)
    count = df.count() - length - step + 1
    return series.time_split(windows, "idx", test_size, gap, n=count)


def taxi_windows(df: DataFrame, ts: str = "timestamp", value: str = "value", length: int = 50, test_size: int = 1000) -> DataFrame:
    """Value, hour and awake flag of a time-stamped series as scaled windows with a split."""
    time = dates.parse_timestamp(ts) if dict(df.dtypes)[ts] == "string" else F.col(ts)
    with_hour = df.select(F.col(ts), F.col(value).cast("double").alias(value), F.hour(time).alias("hour"))
    features = with_hour.withColumn("awake", dates.awake_flag("hour"))
    return series_windows(features, ts, [value, "hour", "awake"], length, test_size)


def sensor_windows(df: DataFrame, ts: str = "ts", length: int = 50, test_size: int = 500) -> DataFrame:
    """Per-file sensor means as scaled windows with a split."""
    return series_windows(df, ts, ["value"], length, test_size)


def text_features(
    docs: DataFrame,
    key: str,
    col: str,
    vectors: DataFrame,
    dim: int,
    max_words: int = 20_000,
    skip_top: int = 10,
    length: int = 500,
    small_rows: int = SMALL_ROWS,
) -> DataFrame:
    """(key, ids, vectors): vocabulary, padded token ids and one vector per place.

    `vectors` is (token, vector); ids without a vector, and padding, give zero vectors.
    """
    tokens = text.tokenize(docs.select(key, col), col).select(key, "tokens")
    vocab = text.vocabulary(tokens, "tokens", max_words, skip_top, small_rows)
    coded = text.pad_ids(text.token_ids(tokens, key, vocab), "ids", length)
    by_id = vectors.join(vocab.select("token", "id"), "token").select("id", "vector")
    return text.token_vectors(coded.where(F.col(key).isNotNull()), key, by_id, dim, pad=0, keep_ids=True)
