"""Exact deduplication of an incoming batch against immutable snapshots, screened by static binary-fuse filters.

A snapshot keeps its different texts in exact buckets (digest, bytes) and, for each shard of about SHARD_KEYS digests,
one binary-fuse filter. A new batch is grouped by itself; only its different texts meet the filters, and only those
that pass join the buckets, where the bytes are compared. New texts are grouped by digest and bytes; afterwards the digest
and a 64-bit mark of the bytes stand for a text, so two texts with one digest are merged only if their marks are equal too.

Defined cases: null text counts as empty and all empty texts are equal; a null doc_id is an ordinary row that is kept
only if nothing else can be (it sorts last); repeated rows count each and rank alike (the same id stays or goes); an empty batch or snapshot gives no rows or no
matches; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowfeat.llm import fuse
from flowfeat.llm.common import by_value, stored, tuned

by_value(__name__)

# Keys of one filter, and queries that meet it in one task: bounds a task however large the batch or snapshot is.
SHARD_KEYS = 200_000
BLANKS = "[\\x20\\x09-\\x0D]+"


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


@dataclass(frozen=True)
class Snapshot:
    """`buckets`: digest, mark, body, best, size of each different text. `filters`: shard, blob."""

    buckets: DataFrame
    filters: DataFrame
    shards: int


def rows(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """For every row: `best` (its rank: most code points, then smallest id), `body`, `digest` and a second hash `mark`."""
    text = F.coalesce("text", F.lit(""))
    out = docs.select(
        F.struct(
            (-F.char_length(text)).alias("less"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id")
        ).alias("best"),
        F.regexp_replace(text, BLANKS, "").alias("body"),
    )
    return out.select("best", "body", digest(F.col("body")).alias("digest"), F.xxhash64("body").alias("mark"))


def groups(table: DataFrame) -> DataFrame:
    """The different texts of a batch, with the row that stays and the number of rows. Stored."""
    return stored(
        table.groupBy("digest", "mark", "body").agg(F.min("best").alias("best"), F.count("*").alias("size"))
    )


def _key() -> Column:
    return F.xxhash64("digest", F.lit(1))


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("digest", F.lit(2)), F.lit(shards)).cast("int")


def snapshot(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> Snapshot:
    """Freeze `docs` (doc_id, text): store the exact buckets and one filter per shard."""
    tuned(docs.sparkSession)
    buckets = groups(rows(docs, digest))
    shards = max(1, -(-buckets.count() // SHARD_KEYS))

    def built(frame: pd.DataFrame) -> pd.DataFrame:
        blob = fuse.build(frame["key"].to_numpy(np.int64).view(np.uint64))
        return pd.DataFrame({"shard": frame["shard"].iloc[:1].to_numpy(), "blob": [blob]})

    keys = buckets.select(_shard(shards).alias("shard"), _key().alias("key")).distinct()
    filters = stored(keys.groupBy("shard").applyInPandas(built, "shard int, blob binary"))
    return Snapshot(buckets, filters, shards)


def screened(batch: DataFrame, held: Snapshot) -> DataFrame:
    """Those digests of `batch` that pass the snapshot's filters: all that it holds, and about 1 in 256 others."""
    parts = max(1, -(-batch.count() // (held.shards * SHARD_KEYS)))
    part = F.pmod(F.xxhash64("digest", F.lit(3)), F.lit(parts)).cast("int")
    asked = batch.select(_shard(held.shards).alias("shard"), part.alias("part"), _key().alias("key"), "digest").distinct()
    filters = held.filters.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def passed(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return left.iloc[:0][["digest"]]
        return left.loc[fuse.contains(right["blob"].iloc[0], left["key"].to_numpy(np.int64).view(np.uint64)), ["digest"]]

    return asked.groupBy("shard", "part").cogroup(filters.groupBy("shard", "part")).applyInPandas(passed, "digest string")


def classes(batch: DataFrame, snapshots: Sequence[Snapshot]) -> DataFrame:
    """All different texts of the batch and the snapshots: digest, mark, best, size over all of them."""
    names = ["digest", "mark", "best", "size"]
    matches = []
    for held in snapshots:
        asked = batch.join(screened(batch, held), "digest").select("digest", "mark", "body")
        matches.append(asked.join(held.buckets, ["digest", "mark", "body"]).select(names))  # here the bytes are compared
    found = batch.select(names)
    for match in matches:
        found = found.unionByName(match)
    # a text that no new row has stays as its snapshots have it
    for held, match in zip(snapshots, matches):
        found = found.unionByName(held.buckets.select(names).join(match.select("digest", "mark"), ["digest", "mark"], "left_anti"))
    return found.groupBy("digest", "mark").agg(F.min("best").alias("best"), F.sum("size").alias("size"))


def resolve(docs: DataFrame, found: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row for each row of `docs`: doc_id, keep_id, group_size, kept, digest."""
    mine = rows(docs, digest).select(F.col("best.id").alias("doc_id"), "best", "digest", "mark")
    return mine.join(found.withColumnRenamed("best", "chosen"), ["digest", "mark"]).select(
        "doc_id",
        F.col("chosen.id").alias("keep_id"),
        F.col("size").alias("group_size"),
        F.expr("best = chosen").alias("kept"),
        "digest",
    )


def dedup(docs: DataFrame, snapshots: Sequence[Snapshot], digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Judge the rows of a new batch against the snapshots and against each other.

    A row of the batch is `kept` if it ranks first among all equal texts of batch and snapshots.
    """
    tuned(docs.sparkSession)
    return resolve(docs, classes(groups(rows(docs, digest)), snapshots), digest)
