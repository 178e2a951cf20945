"""Ranked lexical search, term at a time with limited accumulators.

Documents become postings once: a row per document with its length and its (query term, occurrences), stored without a
shuffle. One aggregate over them gives N, L and the df of every query term. Then each task takes its documents in
blocks, inverts the block, and works through the terms of an item from the rarest to the most frequent. A term gives
every document of its list an accumulator, until the terms that remain could not lift a document without one to the
k-th best score so far; from then on only documents that have one are updated, exactly. The k-th best score counts the
partial scores of the block and the finished ones of the blocks before it in the task. A task keeps the best k of an
item and nothing else, and the lists of all tasks are merged in two steps, the first one salted.

Items are handled in groups with at most GROUP_TERMS (item, term) rows, so what goes to the tasks is bounded; each group
reads the documents once. An item is never cut: one with more terms is a group of its own.

Defined cases: null and empty texts have no terms, and take no part in N; documents without any query term count in N
and L and score nothing; every row of `docs` is a document, so repeated rows rank next to each other; equal scores go
by ascending doc_id, null last; rows of one item_id (null is an ordinary one) are one item with the terms of all its texts;
an item without terms, and an empty table, give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from flowfeat.llm.common import ALNUM, Words, blocks, by_value, drop_stored, lists, map_arrow, stored, text_bytes, tuned

by_value(__name__)

GROUP_TERMS = 500_000  # (item, term) rows that go to the tasks at once, about 30 bytes each
BLOCK_POSTINGS = 1 << 19  # postings that are inverted at once, or one document
MERGE_SALTS = 64  # first step of the merge
_U = np.uint64


@dataclass
class Query:
    """Terms of a group of items: sorted hashes, the bytes of each, and the terms of each item (numbers into them)."""

    hashes: np.ndarray
    data: np.ndarray
    begin: np.ndarray
    items: list

    @classmethod
    def of(cls, rows: list) -> Query:
        """From (item number, term) rows; numbers count from 0."""
        terms = sorted({r["term"].encode() for r in rows})
        codes = Words(pa.array(terms, pa.binary()), np.ones(256, bool), lower=False).hashes()
        order = np.argsort(codes, kind="stable")
        terms = [terms[i] for i in order]
        number = {t: i for i, t in enumerate(terms)}
        items: dict[int, list[int]] = {}
        for r in rows:
            items.setdefault(r["item"], []).append(number[r["term"].encode()])
        data, begin = text_bytes(pa.array(terms, pa.binary()))
        return cls(codes[order], data, begin, sorted(items.items()))

    def numbers(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words that are terms, and the number of the term of each. Hash matches are compared byte by byte."""
        codes = words.hashes()
        if not len(codes) or not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        left = np.searchsorted(self.hashes, codes, "left")
        right = np.searchsorted(self.hashes, codes, "right")
        place, term = [], []
        most = int((right - left).max())  # 1, unless two terms share a hash
        for j in range(most):
            at = np.flatnonzero(left + j < right)
            number = left[at] + j
            size = words.end[at] - words.start[at]
            fits = size == np.diff(self.begin)[number]
            at, number, size = at[fits], number[fits], size[fits]
            step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            differs = words.data[np.repeat(words.start[at], size) + step] != self.data[np.repeat(self.begin[number], size) + step]
            bad = np.unique(np.repeat(np.arange(len(at)), size)[differs])
            place.append(np.delete(at, bad))
            term.append(np.delete(number, bad))
        return np.concatenate(place) if most else np.zeros(0, np.int64), np.concatenate(term) if most else np.zeros(0, np.int64)


def item_terms(items: DataFrame) -> DataFrame:
    """Distinct (item_id, term) of the table `items` (item_id, text)."""

    def cut(block: pa.RecordBatch) -> dict:
        words = Words(block.column("text"), ALNUM, lower=True)
        return {
            "item_id": block.column("item_id").take(pa.array(words.doc)),
            "term": [words.word(i).decode() for i in range(len(words.doc))],
        }

    kind = items.schema["item_id"].dataType.simpleString()
    return map_arrow(items.select("item_id", "text"), cut, f"item_id {kind}, term string").distinct()


def postings(docs: DataFrame, query: Query) -> DataFrame:
    """doc_id, n (terms of the text), terms (ascending numbers) and times (occurrences of each), for texts with a term."""

    def count(block: pa.RecordBatch) -> dict:
        words = Words(block.column("text"), ALNUM, lower=True)
        at, term = query.numbers(words)
        width = max(len(query.hashes), 1)
        cell, times = np.unique(words.doc[at].astype(np.int64) * width + term, return_counts=True)
        size = np.bincount(cell // width, minlength=block.num_rows)
        return {
            "doc_id": block.column("doc_id"),
            "n": words.count,
            "terms": lists((cell % width).astype(np.int32), size, pa.int32()),
            "times": lists(times, size, pa.int64()),
        }

    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = map_arrow(docs.select("doc_id", "text"), count, f"doc_id {kind}, n bigint, terms array<int>, times array<bigint>")
    return counted.where("n > 0")


def weights(df: np.ndarray, n: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(d) + 1))) for d in df], np.int64)


def impacts(times: np.ndarray, n: np.ndarray, docs: int, length: int) -> np.ndarray:
    """(1000000000 * tf) div (1000 * tf + 8 * m) with m = 10 + (90 * n * N) div L."""
    if len(n) and int(n.max()) * 90 * docs >= 1 << 63:  # beyond 64 bits: whole numbers of Python
        m = np.array([10 + 90 * int(x) * docs // length for x in n], np.int64)
    else:
        m = 10 + 90 * n * docs // length
    return (1_000_000_000 * times) // (1000 * times + 8 * m)


class Best:
    """The best k (score, doc_id) of an item so far; equal scores by ascending doc_id, null last."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids, self.floor = k, np.zeros(0, np.int64), None, 0

    def add(self, scores: np.ndarray, ids: pa.Array) -> None:
        if self.ids is not None:
            scores, ids = np.r_[self.scores, scores], pa.concat_arrays([self.ids, ids])
        order = pc.sort_indices(pa.table({"s": scores, "d": ids}), sort_keys=[("s", "descending"), ("d", "ascending")])[: self.k]
        self.scores, self.ids = scores[order.to_numpy()], ids.take(order)
        if len(self.scores) == self.k:
            self.floor = int(self.scores[-1])


def limited(lists_of: list, rest: np.ndarray, documents: int, k: int, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Accumulator-limited scores of one item over a block: (documents, their exact scores, accumulators made).

    `lists_of`: (documents, contributions) of each term, rarest first; `rest[i]`: the most that terms i, i + 1, … can add
    to one document; `floor`: a score that k documents seen before have at least.
    """
    total, open_ = np.zeros(documents, np.int64), np.zeros(documents, bool)
    held = np.zeros(0, np.int64)
    making = True
    for i, (docs, adds) in enumerate(lists_of):
        if making and rest[i] < floor:  # strictly: a document that ties with the k-th may still win by its id
            making, held = False, np.flatnonzero(open_)
            if not len(held):
                break
        if making:
            total[docs] += adds
            open_[docs] = True
            held = np.flatnonzero(open_)
            if len(held) >= k:
                scores = total[held]
                floor = max(floor, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
        else:
            hit = open_[docs]
            total[docs[hit]] += adds[hit]
    return held, total[held], len(held)


def search(stored_postings: DataFrame, query: Query, df: np.ndarray, docs: int, length: int, k: int) -> DataFrame:
    """item (number), doc_id, score: the best k of every item from each task."""
    weight = weights(df, docs)
    plans = [(item, np.array(sorted((t for t in terms if df[t]), key=lambda t: (-weight[t], df[t], t)), np.int64)) for item, terms in query.items]
    schema = StructType().add("item", "long").add(StructField("doc_id", stored_postings.schema["doc_id"].dataType)).add("score", "long")
    vocabulary = len(query.hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {item: Best(k) for item, _ in plans}
        for block in grouped(batches):
            ids, size = block.column("doc_id").combine_chunks(), pc.list_value_length(block.column("terms")).to_numpy().astype(np.int64)
            term = pc.list_flatten(block.column("terms")).to_numpy().astype(np.int64)
            doc = np.repeat(np.arange(len(size)), size)
            impact = impacts(pc.list_flatten(block.column("times")).to_numpy(), np.repeat(block.column("n").to_numpy(), size), docs, length)
            order = np.argsort(term, kind="stable")
            doc, add, term = doc[order], impact[order] * weight[term[order]], term[order]
            begin = np.searchsorted(term, np.arange(vocabulary + 1))
            most = np.zeros(vocabulary, np.int64)
            some = np.flatnonzero(begin[1:] > begin[:-1])
            if len(some):
                most[some] = np.maximum.reduceat(add, begin[some])
            for item, terms in plans:
                terms = terms[begin[terms + 1] > begin[terms]]
                if not len(terms):
                    continue
                rest = np.cumsum(most[terms][::-1])[::-1]
                mine = best[item]
                held, scores, _ = limited([(doc[begin[t] : begin[t + 1]], add[begin[t] : begin[t + 1]]) for t in terms], rest, len(size), k, mine.floor)
                good = (scores > 0) & (scores >= mine.floor)
                held, scores = held[good], scores[good]
                if len(held) > k:  # ties with the k-th stay until the ids are compared
                    good = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
                    held, scores = held[good], scores[good]
                if len(held):
                    mine.add(scores, ids.take(pa.array(held)))
        for item, mine in best.items():
            if len(mine.scores):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mine.scores), item)), mine.ids, pa.array(mine.scores)], names=["item", "doc_id", "score"])

    return stored_postings.mapInArrow(run, schema)


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of at most BLOCK_POSTINGS postings, or of one document."""
    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(pc.list_value_length(batch.column("terms")).to_numpy().astype(np.int64) + 1)
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            end = int(np.searchsorted(ends, done + BLOCK_POSTINGS - size, "right"))
            if end <= at and held:
                yield pa.Table.from_batches(held)
                held, size = [], 0
                continue
            end = max(end, at + 1)
            held.append(batch.slice(at, end - at))
            size += int(ends[end - 1] - done)
            at = end
    if held:
        yield pa.Table.from_batches(held)


def item_groups(terms: DataFrame, limit: int = GROUP_TERMS) -> list[DataFrame]:
    """The (item_id, term) rows in groups of whole items, of about `limit` rows each."""
    groups = terms.count() // limit + 1
    if groups == 1:
        return [terms]
    return [terms.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g) for g in range(groups)]


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, limit: int = GROUP_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the best k documents (doc_id, text) of every item (item_id, text)."""
    spark = tuned(docs.sparkSession)
    out = None
    terms = stored(item_terms(items))
    for group in item_groups(terms, limit):
        rows = group.collect()
        numbers: dict = {}
        for r in rows:
            numbers.setdefault(r["item_id"], len(numbers))
        query = Query.of([{"item": numbers[r["item_id"]], "term": r["term"]} for r in rows])
        table = stored(postings(docs, query))
        total = table.agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
        counts = table.select(F.explode("terms").alias("t")).groupBy("t").count().collect()  # one row for each query term
        df = np.zeros(len(query.hashes), np.int64)
        for t, c in counts:
            df[t] = c
        found = stored(search(table, query, df, total["n"], total["l"] or 1, k))
        drop_stored(table)
        best = merged(found, k)
        kind = StructType().add("number", "long").add(StructField("item_id", items.schema["item_id"].dataType))
        names = spark.createDataFrame([(i, item) for item, i in numbers.items()], kind)
        part = best.join(names, best["item"] == names["number"]).select("item_id", "rank", "doc_id", "score")
        out = part if out is None else out.unionByName(part)
    drop_stored(terms)
    return out


def merged(found: DataFrame, k: int) -> DataFrame:
    """item, rank, doc_id, score from the lists of all tasks: first in MERGE_SALTS parts of an item, then whole."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    parts = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(MERGE_SALTS)))
    parts = parts.withColumn("rank", F.row_number().over(W.partitionBy("item", "salt").orderBy(*order))).where(F.col("rank") <= k)
    whole = parts.drop("rank", "salt").withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*order)))
    return whole.where(F.col("rank") <= k)
