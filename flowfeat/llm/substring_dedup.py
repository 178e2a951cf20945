"""Removal of passages that an earlier document has, by suffix automata of reference shards.

Which texts meet which reference is found by fingerprints: a window of `span` words always has a winnowed K-gram, so
documents share a window only if they share a fingerprint, and only windows around fingerprints of several documents
are hashed and grouped. The earliest document of each repeated window is the reference; its passages are dealt into
shards of bounded size, each becomes one suffix automaton over words, and it is sent to all tasks that hold text for
it (several for a shard that many documents ask). Documents stream through the automata: the matching statistics say
where at least `span` words in a row occur in an earlier document, and the maximal spans of such words go. Copies
(equal word sequences) are settled at once: all but the earliest lose every word, if a window fits.

Defined cases: a null text has no words; texts shorter than `span` lose nothing; a null doc_id is neither earlier nor
later than another, so its row stays whole and removes nothing; rows of one doc_id do not remove each other's words;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowfeat.llm.automaton import SuffixAutomaton
from flowfeat.llm.common import NOT_SPACE, Words, by_value, grams, lists, map_arrow, stored, tuned, winnowed

by_value(__name__)

SPAN = 50
K = 20
# Words of one reference shard, and of the texts that meet it in one task (a single text may be longer).
SHARD_WORDS = 60_000
STREAM_WORDS = 400_000
# A long reference passage is dealt in parts of so many windows.
PART = 5_000


def _split(block: pa.RecordBatch) -> list[list[bytes]]:
    """The words `[^\x20\x09-\x0D]+` of each text; bytes.split cuts at exactly these six bytes."""
    return [(t or "").encode().split() for t in block.column("text").to_pylist()]


def _node(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _prints(words: Words, hashes: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of the winnowed K-grams; every window of `span` words has one."""
    k = min(K, span)
    value, at = grams(hashes, words.doc, k)
    place = winnowed(value, at, words.doc, span - k + 1)
    return value[place], at[place]


def read_words(docs: DataFrame, span: int) -> DataFrame:
    """`doc_id`, `node` (digest of the words), `n` (their number), `whole` (sha256 of the joined words), `prints`."""

    def read(block: pa.RecordBatch) -> dict:
        words = Words(block.column("text"), NOT_SPACE, lower=False)
        hashes = words.hashes()
        value, at = _prints(words, hashes, span)
        owner = words.doc[at]
        long = words.count[owner] >= span
        value, owner = value[long], owner[long]
        order = np.lexsort((value, owner))
        value, owner = value[order], owner[order]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        return {
            "doc_id": block.column("doc_id"),
            "node": [_node(hashes[lo:hi]) for lo, hi in zip(words.first[:-1], words.first[1:])],
            "n": words.count,
            "whole": [hashlib.sha256(b" ".join(w)).hexdigest() for w in _split(block)],
            "prints": lists(value[new].view(np.int64), np.bincount(owner[new], minlength=block.num_rows), pa.int64()),
        }

    return map_arrow(
        docs.select("doc_id", "text"), read, "doc_id bigint, node binary, n bigint, whole string, prints array<bigint>"
    )


def candidates(table: DataFrame, docs: DataFrame, span: int) -> DataFrame:
    """Texts with a repeated fingerprint, one row for each different text: `doc`, `node`, `text`, `prints`. Stored."""
    nodes = table.where(F.col("n") >= span).groupBy("node").agg(F.min("doc_id").alias("doc"), F.first("prints").alias("prints"))
    single = nodes.where("doc IS NOT NULL").select("doc", "node", F.explode("prints").alias("print"))
    repeated = single.groupBy("print").agg(F.count("*").alias("c")).where("c > 1").select("print")
    hot = single.join(repeated, "print").groupBy("doc", "node").agg(F.collect_list("print").alias("prints"))

    def own(block: pa.RecordBatch) -> dict:
        """Rows of one doc_id may have different texts; a text belongs to its node."""
        words = Words(block.column("text"), NOT_SPACE, lower=False)
        hashes = words.hashes()
        nodes = block.column("node").to_pylist()
        right = [_node(hashes[lo:hi]) == n for lo, hi, n in zip(words.first[:-1], words.first[1:], nodes)]
        out = block.filter(pa.array(right, pa.bool_()))
        return {c: out.column(c) for c in ("doc", "node", "text", "prints")}

    texts = docs.select(F.col("doc_id").alias("doc"), "text").join(hot, "doc")
    found = map_arrow(texts, own, "doc bigint, node binary, text string, prints array<bigint>")
    # rows with the same doc_id and words are one text
    return stored(found.withColumn("mark", F.xxhash64("node")).dropDuplicates(["doc", "mark"]))


def windows(held: DataFrame, span: int) -> DataFrame:
    """`doc`, `mark`, `start`, `hash` of the windows around repeated fingerprints."""

    def around(block: pa.RecordBatch) -> dict:
        words = Words(block.column("text"), NOT_SPACE, lower=False)
        hashes = words.hashes()
        value, at = _prints(words, hashes, span)
        window, first = grams(hashes, words.doc, span)
        sizes, starts, codes = [], [], []
        for row, prints in enumerate(block.column("prints").to_pylist()):
            lo, hi = words.first[row], words.first[row + 1]
            mine = slice(*np.searchsorted(at, [lo, hi]))
            picks = at[mine][np.isin(value[mine].view(np.int64), prints)]
            edge = np.zeros(hi - lo + 1, np.int64)
            np.add.at(edge, np.maximum(picks - lo - (span - min(K, span)), 0), 1)
            np.add.at(edge, picks - lo + 1, -1)
            inside = slice(*np.searchsorted(first, [lo, hi]))  # the windows of this text
            chosen = np.cumsum(edge)[first[inside] - lo] > 0
            starts.append(first[inside][chosen] - lo)
            codes.append(window[inside][chosen].view(np.int64))
            sizes.append(int(chosen.sum()))
        return {
            "doc": block.column("doc"),
            "mark": block.column("mark"),
            "starts": lists(np.concatenate(starts), np.array(sizes), pa.int32()),
            "codes": lists(np.concatenate(codes), np.array(sizes), pa.int64()),
        }

    arrays = stored(map_arrow(held, around, "doc bigint, mark bigint, starts array<int>, codes array<bigint>"))
    pairs = F.explode(F.arrays_zip(F.col("starts").alias("start"), F.col("codes").alias("hash")))
    return arrays.select("doc", "mark", pairs.alias("w")).select("doc", "mark", "w.start", "w.hash")


def _shard(shards: int, doc: str, mark: str, start: str) -> Column:
    part = F.floor(F.col(start) / PART)
    return F.pmod(F.xxhash64(doc, mark, part), F.lit(shards)).cast("int")


def pieces(held: DataFrame, asks: DataFrame, span: int) -> DataFrame:
    """The word runs that `asks` (doc, mark, shard, role, starts) name, as `words` of role 0 (reference) or 1 (query)."""
    by_text = asks.groupBy("doc", "mark").agg(F.collect_list(F.struct("shard", "role", "starts")).alias("asks"))

    def cut(block: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("shard", "role", "doc", "mark", "begin", "words")}
        texts = _split(block)
        ids = zip(block.column("doc").to_pylist(), block.column("mark").to_pylist(), block.column("asks").to_pylist(), texts)
        for doc, mark, asked, words in ids:
            for ask in asked:
                starts = np.unique(np.array(ask["starts"], np.int64))
                for run in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
                    lo, hi = int(run[0]), int(run[-1]) + span
                    row = (ask["shard"], ask["role"], doc, mark, lo, b" ".join(words[lo:hi]).decode())
                    for name, value in zip(out, row):
                        out[name].append(value)
        return out

    texts = held.select("doc", "mark", "text").join(by_text, ["doc", "mark"])
    return map_arrow(texts, cut, "shard int, role int, doc bigint, mark bigint, begin bigint, words string")


def spans(held: DataFrame, span: int) -> DataFrame:
    """`doc`, `mark`, `begin`, `end`: word runs that occur in an earlier document, from the automata."""
    every = windows(held, span)
    place = F.struct("doc", "mark", "start")
    repeated = stored(
        every.groupBy("hash")
        .agg(F.min(place).alias("first"), F.max("doc").alias("last"))
        .where("first.doc < last")
        .select("hash", F.col("first.doc").alias("rdoc"), F.col("first.mark").alias("rmark"), F.col("first.start").alias("rstart"))
    )
    shards = max(1, -(-repeated.count() // SHARD_WORDS))
    shard = _shard(shards, "rdoc", "rmark", "rstart").alias("shard")
    reference = repeated.select(F.col("rdoc").alias("doc"), F.col("rmark").alias("mark"), shard, F.lit(0).alias("role"), F.col("rstart").alias("start"))
    later = every.join(repeated, "hash").where("doc > rdoc").select("doc", "mark", shard, F.lit(1).alias("role"), "start")
    asks = reference.unionByName(later).groupBy("doc", "mark", "shard", "role").agg(F.collect_list("start").alias("starts"))
    runs = stored(pieces(held, asks, span))
    loads = runs.where("role = 1").groupBy("shard").agg(F.sum(F.length("words")).alias("size"))
    loads = loads.select("shard", F.ceil(F.col("size") / (6 * STREAM_WORDS)).cast("int").alias("parts"))
    dealt = runs.join(loads, "shard")
    ask_part = F.pmod(F.xxhash64("doc", "mark", "begin"), "parts").cast("int")
    queries = dealt.where("role = 1").select("shard", ask_part.alias("part"), "doc", "mark", "begin", "words")
    all_parts = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    shard_rows = dealt.where("role = 0").select(
        F.col("shard").alias("rshard"), all_parts.alias("rpart"), F.col("doc").alias("rdoc"), F.col("words").alias("rwords")
    )

    def stream(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        automaton = SuffixAutomaton((doc, words.split(" ")) for doc, words in zip(right["rdoc"].tolist(), right["rwords"]))
        found = []
        for doc, mark, begin, words in left[["doc", "mark", "begin", "words"]].itertuples(index=False):
            open_, until = None, -1
            for place, owner in automaton.matches(words.split(" "), span):
                if owner < doc:
                    if place - span + 1 > until:
                        if open_ is not None:
                            found.append((doc, mark, begin + open_, begin + until))
                        open_ = place - span + 1
                    until = place + 1
            if open_ is not None:
                found.append((doc, mark, begin + open_, begin + until))
        return pd.DataFrame(found, columns=["doc", "mark", "begin", "end"])

    return queries.groupBy("shard", "part").cogroup(shard_rows.groupBy("rshard", "rpart")).applyInPandas(
        stream, "doc bigint, mark bigint, begin bigint, end bigint"
    )


def remove_repeats(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """One row for each row of `docs` (doc_id, text): doc_id, n_words, n_removed, kept_sha256, spans.

    `spans` are the removed word runs as [begin, end) word places. The digest is of the kept words joined by a space.
    """
    tuned(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    table = stored(read_words(docs, span))
    held = candidates(table, docs, span)
    cut = spans(held, span).groupBy("doc", "mark").agg(F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("spans"))

    def kept(block: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"doc": block.column("doc"), "mark": block.column("mark"), "removed": [], "rest": []}
        for words, runs in zip(_split(block), block.column("spans").to_pylist()):
            stay = np.ones(len(words), bool)
            for run in runs:
                stay[run["begin"] : run["end"]] = False
            out["removed"].append(len(words) - int(stay.sum()))
            out["rest"].append(hashlib.sha256(b" ".join([w for w, s in zip(words, stay.tolist()) if s])).hexdigest())
        return out | {"spans": block.column("spans")}

    kind = "array<struct<begin: bigint, end: bigint>>"
    changed = map_arrow(
        held.select("doc", "mark", "text").join(cut, ["doc", "mark"]),
        kept,
        f"doc bigint, mark bigint, removed bigint, rest string, spans {kind}",
    )
    first = table.groupBy("node").agg(F.min("doc_id").alias("first"))
    rows = table.select("doc_id", "node", "n", "whole", F.xxhash64("node").alias("mark")).join(first, "node")
    rows = rows.join(changed.withColumnRenamed("doc", "doc_id"), ["doc_id", "mark"], "left")
    copy = (F.col("n") >= span) & F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    all_words = F.array(F.struct(F.lit(0).cast("bigint").alias("begin"), F.col("n").alias("end")))
    return rows.select(
        "doc_id",
        F.col("n").alias("n_words"),
        F.when(copy, F.col("n")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("rest", "whole")).alias("kept_sha256"),
        F.when(copy, all_words).otherwise(F.coalesce("spans", F.array().cast(kind))).alias("spans"),
    )
