"""Benchmark decontamination by winnowing.

Every text keeps the minimum of each run of WINDOW neighbouring k-gram hashes; any span of K + WINDOW - 1 = 10 words
that a document shares with a benchmark item has a kept fingerprint in both. Fingerprints of documents and items are
joined, and the hits of each document and item are extended to whole windows of 10 item words, compared word by word.
Items of fewer than 10 words are one window; for each such length the fingerprints are all its word runs.

Defined cases: null or empty texts have no words; an item without words has no window; a null doc_id or item_id is an
ordinary value (a null item counts in `items` as null); repeated item rows count once; rows of one doc_id and one text
give equal rows; an empty benchmark leaves every document clean; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowfeat.llm.common import ALNUM, Words, by_value, grams, lists, map_arrow, mixed, stored, tuned, winnowed

by_value(__name__)

SPAN = 10
K = 5
WINDOW = SPAN - K + 1
# Fingerprints of the benchmark up to so many rows (24 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
_U = np.uint64


def fingerprints(block: pa.RecordBatch, lengths: list[int]) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words of the block, and (fingerprint, row) of its kept k-grams and of all runs of the short `lengths`."""
    words = Words(block.column("text"), ALNUM, lower=True)
    hashes = words.hashes()
    value, at = grams(hashes, words.doc, K)
    place = winnowed(value, at, words.doc, WINDOW)
    values, owners = [value[place]], [words.doc[at[place]]]
    for n in lengths:
        value, at = grams(hashes, words.doc, n)
        values.append(mixed(value + _U(n)))  # apart from the k-grams of long items
        owners.append(words.doc[at])
    values, owners = np.concatenate(values), np.concatenate(owners)
    order = np.lexsort((values, owners))
    values, owners = values[order], owners[order]
    new = np.r_[True, (values[1:] != values[:-1]) | (owners[1:] != owners[:-1])] if len(values) else np.zeros(0, bool)
    return words, values[new], owners[new]


def item_prints(benchmark: DataFrame) -> DataFrame:
    """`item_id`, `words` (number), `print`: the fingerprints of every item. An item of fewer than SPAN words has one."""

    def prints(block: pa.RecordBatch) -> dict:
        words, value, owner = fingerprints(block, [])
        long = np.flatnonzero(words.count >= SPAN)
        keep = np.isin(owner, long)
        value, owner = value[keep], owner[keep]
        short = np.flatnonzero((words.count > 0) & (words.count < SPAN))
        hashes = words.hashes()
        whole = [
            mixed(grams(hashes[words.first[i] : words.first[i + 1]], np.zeros(words.count[i]), int(words.count[i]))[0] + _U(words.count[i]))
            for i in short
        ]
        value, owner = np.concatenate([value, *whole]), np.r_[owner, short]
        return {
            "item_id": block.column("item_id").take(pa.array(owner)),
            "words": words.count[owner],
            "print": value.view(np.int64),
        }

    return map_arrow(benchmark.select("item_id", "text"), prints, "item_id bigint, words bigint, print bigint")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each row of `docs` (doc_id, text): doc_id, n_words, n_hit, items, spans.

    `items` are the ids of `benchmark` (item_id, text) with a window in the text, sorted; `spans` the hit words as
    [begin, end) word places, joined where they touch.
    """
    tuned(docs.sparkSession)
    items = stored(benchmark.select("item_id", "text").distinct())
    marks = stored(item_prints(items))
    lengths = [r[0] for r in marks.where(F.col("words") < SPAN).select("words").distinct().collect()]  # at most SPAN - 1
    small = marks.select("item_id", "print").distinct()
    if marks.count() <= BROADCAST_ROWS:
        small = F.broadcast(small)

    def prints(block: pa.RecordBatch) -> dict:
        _, value, owner = fingerprints(block, lengths)
        sizes = np.bincount(owner, minlength=block.num_rows)
        return {
            "doc": block.column("doc"),
            "mark": block.column("mark"),
            "prints": lists(value.view(np.int64), sizes, pa.int64()),
        }

    keyed = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("mark"), "text")
    shared = (
        map_arrow(keyed, prints, "doc bigint, mark bigint, prints array<bigint>")
        .select("doc", "mark", F.explode("prints").alias("print"))
        .join(small, "print")
        .select("doc", "mark", "item_id")
        .distinct()
        .join(items.select(F.col("item_id").alias("id"), F.col("text").alias("words")), F.col("item_id").eqNullSafe(F.col("id")))
        .groupBy("doc", "mark")
        .agg(F.collect_list(F.struct("id", "words")).alias("found"))
    )
    found = stored(shared).select(F.col("doc").alias("d"), F.col("mark").alias("m"), "found")
    paired = keyed.join(found, F.col("doc").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")), "left")
    return map_arrow(
        paired.select("doc", "text", "found"),
        extended,
        "doc_id bigint, n_words bigint, n_hit bigint, items array<bigint>, spans array<struct<begin: bigint, end: bigint>>",
    )


def extended(block: pa.RecordBatch) -> dict:
    """Extend the shared fingerprints of each text (`found`: its items) to the windows that really occur."""
    words = Words(block.column("text"), ALNUM, lower=True)
    hashes = words.hashes()
    hits, items, spans = np.zeros(block.num_rows, np.int64), [], []
    for row, found in enumerate(block.column("found").to_pylist()):
        lo, hi = words.first[row], words.first[row + 1]
        cover, ids = np.zeros(hi - lo, bool), set()
        if found:
            other = Words(pa.array([f["words"] for f in found], pa.string()), ALNUM, lower=True)
            codes = other.hashes()
            runs: dict[int, np.ndarray] = {}
            for j, item in enumerate(found):
                a, b = other.first[j], other.first[j + 1]
                n = int(min(SPAN, b - a))
                if n and n not in runs:
                    runs[n] = grams(hashes[lo:hi], np.zeros(hi - lo), n)[0]
                if not n:
                    continue
                windows = {other.joined(j, p, p + n) for p in range(a, b - n + 1)}
                for p in np.flatnonzero(np.isin(runs[n], grams(codes[a:b], np.zeros(b - a), n)[0])):
                    if words.joined(row, lo + p, lo + p + n) in windows:
                        cover[p : p + n] = True
                        ids.add(item["id"])
        edge = np.flatnonzero(np.diff(np.r_[False, cover, False].astype(np.int8)))
        hits[row] = cover.sum()
        items.append(sorted(ids, key=lambda x: (x is None, x)))
        spans.append([{"begin": x, "end": y} for x, y in edge.reshape(-1, 2).tolist()])
    return {"doc_id": block.column("doc"), "n_words": words.count, "n_hit": hits, "items": items, "spans": spans}
