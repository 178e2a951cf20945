"""MinHash near-duplicate groups with circulant signatures.

One permutation scatters the shingles of a text over a ring of 2**32 places; a second one, shifted by k places around
the ring, gives coordinate k of the signature as its minimum. Rows of coordinates are hashed into bands. In every
bucket of texts that share a band, each text is compared with one hub, by signature (not in a bucket of two) and then by
exact Jaccard similarity of the full shingle sets. Where that leaves a bucket in more than one component, the texts outside the hub's component
are compared with all others that met the same hub, block by block, again on full sets; a block gives only links that
join components, so what comes out grows with the texts and not with their pairs. Copies (equal word sequences) are one
node throughout.

Defined cases: a text with fewer than `words` words is one shingle; null, empty or blank texts have no shingles and are
linked with nothing; a null doc_id is an ordinary row, and the smallest id of a group is taken over its other rows;
rows of one doc_id count as one document in the answer; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowfeat.llm.common import NOT_SPACE, Words, by_value, drop_stored, grams, lists, map_arrow, mixed, span_sums, stored, tuned
from flowfeat.llm.components import components

by_value(__name__)

# Texts of one bucket that are compared with each other in one task.
BLOCK = 400
_U32, _U64 = np.uint32, np.uint64


@dataclass(frozen=True)
class Plan:
    """Similarity in percent, shingle length, rows of a band and number of bands."""

    percent: int = 80
    words: int = 5

    @property
    def rows(self) -> int:
        return 4 if self.percent < 85 else 5

    @property
    def bands(self) -> int:
        """So many that a pair at the threshold shares no band with a chance below 1e-7."""
        return math.ceil(math.log(1e-7) / math.log(1 - (self.percent / 100) ** self.rows))

    @property
    def coordinates(self) -> int:
        return self.rows * self.bands

    @property
    def screen(self) -> int:
        """Agreeing coordinates that a pair at the threshold falls short of by five standard deviations."""
        p, k = self.percent / 100, self.coordinates
        return math.floor(k * p - 5 * math.sqrt(k * p * (1 - p)))


def shingles(block: pa.RecordBatch, k: int) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """The words of the block, their hashes, and hash and owner of every shingle, repeated ones too."""
    words = Words(block.column("text"), NOT_SPACE, lower=True)
    hashes = words.hashes()
    value, at = grams(hashes, words.doc, k)
    owner = words.doc[at]
    few = np.flatnonzero((words.count > 0) & (words.count < k))
    if len(few):
        sums = span_sums(hashes, words.first[few], words.first[few + 1])
        value = np.r_[value, mixed(sums + words.count[few].astype(_U64))]
        owner = np.r_[owner, few]
        order = np.argsort(owner, kind="stable")
        value, owner = value[order], owner[order]
    return words, hashes, value, owner


def signatures(value: np.ndarray, begin: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant signature (coordinates x texts) of shingle hashes; `begin`: where each text's shingles start."""
    ring = (value ^ (value >> _U64(32))).astype(_U32)
    # first permutation of the ring
    ring ^= ring >> _U32(16)
    ring *= _U32(0x7FEB352D)
    ring ^= ring >> _U32(15)
    ring *= _U32(0x846CA68B)
    ring ^= ring >> _U32(16)
    out = np.empty((coordinates, len(begin)), _U32)
    place, high = np.empty_like(ring), np.empty_like(ring)
    for k in range(coordinates):
        # second permutation, shifted by k
        np.add(ring, _U32(k), out=place)
        np.right_shift(place, _U32(16), out=high)
        place ^= high
        place *= _U32(0x21F0AAAD)
        np.right_shift(place, _U32(15), out=high)
        place ^= high
        place *= _U32(0xD35A2D97)
        np.minimum.reduceat(place, begin, out=out[k])
    return out


def _node(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def sketches(docs: DataFrame, plan: Plan) -> DataFrame:
    """`doc_id`, `node` (digest of the word sequence), `n` (distinct shingles), `sketch` (a byte per coordinate), `bands`."""

    def sketch(block: pa.RecordBatch) -> dict:
        words, hashes, value, owner = shingles(block, plan.words)
        total = block.num_rows
        node = [_node(hashes[lo:hi]) for lo, hi in zip(words.first[:-1], words.first[1:])]
        size = np.bincount(owner, minlength=total)
        begin = np.r_[0, np.cumsum(size)]
        n = np.zeros(total, np.int64)
        for i in np.flatnonzero(size):
            sorted_ = np.sort(value[begin[i] : begin[i + 1]])
            n[i] = 1 + np.count_nonzero(sorted_[1:] != sorted_[:-1])
        some = np.flatnonzero(size)
        marks: list = [None] * total
        keys, counts = np.zeros(0, np.int64), np.zeros(total, np.int64)
        if len(some):
            table = signatures(value, begin[:-1][some], plan.coordinates)
            byte = np.ascontiguousarray((table & _U32(255)).astype(np.uint8).T)
            for row, i in enumerate(some):
                marks[i] = byte[row].tobytes()
            band = np.zeros((plan.bands, len(some)), _U64)
            for b in range(plan.bands):
                acc = np.full(len(some), b + 1, _U64)
                for r in range(plan.rows):
                    acc = mixed(acc * _U64(31) + table[b * plan.rows + r])
                band[b] = acc
            keys = np.ascontiguousarray(band.T).ravel().view(np.int64)
            counts[some] = plan.bands
        return {
            "doc_id": block.column("doc_id"),
            "node": node,
            "n": n,
            "sketch": marks,
            "bands": lists(keys, counts, pa.int64()),
        }

    return map_arrow(
        docs.select("doc_id", "text"), sketch, "doc_id bigint, node binary, n bigint, sketch binary, bands array<bigint>"
    )


def agreeing(pairs: DataFrame, nodes: DataFrame, plan: Plan) -> DataFrame:
    """Pairs (`a`, `b`) of nodes whose signatures agree in enough coordinates."""
    left = nodes.select(F.col("node").alias("a"), F.col("sketch").alias("sa"))
    right = nodes.select(F.col("node").alias("b"), F.col("sketch").alias("sb"))

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (_bytes(batch.column(c), plan.coordinates) for c in ("sa", "sb"))
                yield batch.filter(pa.array((x == y).sum(1) >= plan.screen)).select(["a", "b"])

    return pairs.join(left, "a").join(right, "b").mapInArrow(screen, "b binary, a binary").select("a", "b")


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def node_texts(docs: DataFrame, wanted: DataFrame, plan: Plan) -> DataFrame:
    """`node`, `text` of each node in `wanted` (node, low). Stored."""
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(wanted, F.col("id").eqNullSafe(F.col("low"))).select("node", "text")

    def own(block: pa.RecordBatch) -> dict:
        """A text belongs to the node only if it has its digest: several rows may share an id."""
        words = Words(block.column("text"), NOT_SPACE, lower=True)
        hashes = words.hashes()
        spans = zip(words.first[:-1], words.first[1:], block.column("node").to_pylist())
        out = block.filter(pa.array([_node(hashes[lo:hi]) == n for lo, hi, n in spans], pa.bool_()))
        return {"node": out.column("node"), "text": out.column("text")}

    return stored(map_arrow(texts, own, "node binary, text string").dropDuplicates(["node"]))


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    _, _, value, owner = shingles(pa.RecordBatch.from_arrays([texts], ["text"]), k)
    return [np.unique(v) for v in np.split(value, np.searchsorted(owner, np.arange(1, len(texts))))]


def confirmed(pairs: DataFrame, texts: DataFrame, plan: Plan) -> DataFrame:
    """Those pairs of nodes whose full shingle sets reach the similarity."""

    def jaccard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                good = []
                for x, y in zip(*(shingle_sets(part.column(c), plan.words) for c in ("ta", "tb"))):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(100 * both >= plan.percent * (len(x) + len(y) - both))
                yield part.filter(pa.array(good, pa.bool_())).select(["a", "b"])

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(jaccard, "a binary, b binary")


class Blocks:
    """The shingle sets of a cell as numbers, so that one set meets many others in one step."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], np.int64)
        self.begin = np.r_[0, np.cumsum(self.size)[:-1]]
        self.ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
        self.mark = np.zeros(len(self.ids) + 1, np.int32)

    def common(self, i: int, others: np.ndarray) -> np.ndarray:
        """The number of shingles that set i shares with each of `others`."""
        mine = self.ids[self.begin[i] : self.begin[i] + self.size[i]]
        self.mark[mine] = 1
        size = self.size[others]
        stops = np.cumsum(size)
        flat = np.arange(stops[-1]) + np.repeat(self.begin[others] - (stops - size), size)
        out = np.add.reduceat(self.mark[self.ids[flat]], stops - size)
        self.mark[mine] = 0
        return out


def joining_links(members: DataFrame, roots: DataFrame, texts: DataFrame, plan: Plan) -> DataFrame:
    """Links between components, given `members` (key, node, hub): enough of them to join what is linked in a bucket.

    All nodes of the open buckets of one hub are taken together. Those in the hub's component are not compared with
    each other; the others meet all nodes of the hub in cells of BLOCK x BLOCK, so a hub of any size is dealt over many
    tasks. A cell leaves out pairs that it has joined already.
    """
    own = roots.select("node", "root")
    hubs = roots.select(F.col("node").alias("hub"), F.col("root").alias("hub_root"))
    rooted = members.join(own, "node", "left").join(hubs, "hub", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "node"))
    rooted = stored(rooted.withColumn("rest", F.col("root") != F.coalesce("hub_root", "hub")).select("key", "hub", "node", "root", "rest"))
    # a bucket of two was settled by the comparison with the hub, on full sets
    open_ = rooted.groupBy("key").agg(F.count_if("rest").alias("u"), F.count("*").alias("m")).where("u > 0 AND m > 2").select("key")
    together = stored(rooted.join(open_, "key").select("hub", "node", "root", "rest").distinct())
    blocks = together.groupBy("hub").agg(
        F.ceil(F.count_if("rest") / BLOCK).cast("int").alias("nu"), F.ceil(F.count_if(~F.col("rest")) / BLOCK).cast("int").alias("nv")
    )
    dealt = together.join(blocks, "hub")
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("node"), F.when(F.col("rest"), F.col("nu")).otherwise(F.col("nv"))).cast("int"))

    def cell(kind: int, i, j):
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))

    mine = F.col("mine")
    to_base = F.transform(F.sequence(F.lit(0), F.col("nv") - 1), lambda j: cell(0, mine, j))  # the hub itself is there: nv > 0
    to_rest = F.transform(F.sequence(F.lit(0), F.col("nu") - 1), lambda j: cell(1, F.least(mine, j), F.greatest(mine, j)))
    to_left = F.transform(F.sequence(F.lit(0), F.col("nu") - 1), lambda i: cell(0, i, mine))
    cells = dealt.withColumn("cell", F.explode(F.when(F.col("rest"), F.concat(to_base, to_rest)).otherwise(to_left)))
    cells = cells.select("hub", "node", "root", "rest", "mine", "cell.*").join(texts, "node")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        sets = Blocks(shingle_sets(pa.array(frame["text"], pa.string()), plan.words))
        node, rest, place = frame["node"].to_numpy(), frame["rest"].to_numpy(), frame["mine"].to_numpy()
        root = np.unique(frame["root"].to_numpy(), return_inverse=True)[1]
        kind, left, right = frame[["kind", "i", "j"]].iloc[0]
        lefts = np.flatnonzero(rest & (place == left))
        rights = np.flatnonzero(~rest) if kind == 0 else np.flatnonzero(rest & (place == right))
        found = []
        for i in lefts:
            near = rights[root[rights] != root[i]]
            low, high = np.minimum(sets.size[near], sets.size[i]), np.maximum(sets.size[near], sets.size[i])
            near = near[100 * low >= plan.percent * high]
            if not len(near):
                continue
            both = sets.common(i, near)
            for j in near[100 * both >= plan.percent * (sets.size[near] + sets.size[i] - both)]:
                if root[j] != root[i]:
                    found.append((node[i], node[j]))
                    root[root == root[j]] = root[i]
        return pd.DataFrame(found, columns=["a", "b"])

    return cells.groupBy("hub", "kind", "i", "j").applyInPandas(compare, "a binary, b binary")


def near_duplicates(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """One row for each row of `docs` (doc_id, text): doc_id, n_shingles, component_id, kept."""
    tuned(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    table = stored(sketches(docs, plan))
    nodes = stored(
        table.where("n > 0")
        .groupBy("node")
        .agg(F.min("doc_id").alias("low"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands"))
    )
    banded = nodes.select("node", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("size")).where("size > 1")
    members = stored(banded.join(buckets, "key"))
    stars = members.where("node <> hub").groupBy(F.col("hub").alias("a"), F.col("node").alias("b")).agg(F.min("size").alias("size"))
    # a bucket of two has no other comparison, so its pair meets the full sets whatever the signatures say
    likely = agreeing(stars.where("size > 2").select("a", "b"), nodes, plan).unionByName(stars.where("size = 2").select("a", "b"))
    likely = stored(likely)
    texts = node_texts(docs, members.select("node").distinct().join(nodes.select("node", "low"), "node"), plan)
    links = stored(confirmed(likely, texts, plan))
    more = stored(joining_links(members, components(links), texts, plan))
    roots = components(links.unionByName(more))
    drop_stored(members, likely, texts, links, more)  # the roots are stored
    ids = roots.join(nodes.select("node", "low"), "node").groupBy("root").agg(F.min("low").alias("component_id"))
    final = nodes.select("node", "low").join(roots, "node", "left").join(ids, "root", "left")
    final = final.select("node", F.coalesce("component_id", "low").alias("component_id"))
    return table.join(final, "node", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.col("doc_id").eqNullSafe(F.coalesce("component_id", "doc_id")).alias("kept"),
    )
