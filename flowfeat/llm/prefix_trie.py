"""Prefix trie of conversations, kept as a z-fast trie whose edges are rows.

A prefix of a conversation is named by a key: two sums, modulo 2^60, of digests of its turns that include their places.
So keys of all prefixes are running sums, and equal keys mean equal prefixes but for a chance of about 2^-120 a pair.
A node of the compacted trie is an edge row: the key it hangs from (`head`), the depths (top, bottom] it covers with
the key of each, the conversation that brought it, and its handle: the key at the depth of (top, bottom] that is divisible
by the largest power of two.

Conversations are inserted in batches of ascending ids. For each conversation of a batch the handles are searched by
fat binary search, at most log2(turns) + 2 equi-joins for all at once; the edge below the deepest handle found is where
it leaves the trie. Keys beyond that place are new: each belongs to the smallest id that has it, which is one partial
aggregate, and the number of keys a conversation owns says where it leaves the other new ones. Edges are cut where a
conversation leaves or ends, old and new ones alike. In the end the edges are expanded to one row for every depth.

What all members of a node add up to comes from one aggregate over the prefixes of the different sequences, each with
the number of its copies; equal conversations are one sequence from the start. The path of a conversation is cut at depths
divisible by SEGMENT, so one row never holds more keys than that, however long a conversation is; a piece is a
string of its own below the key it begins with.

Defined cases: rows without a conv_id belong to no conversation; a null turn comes first, equal turns of a conversation go
by the digest of role and text, repeated rows are turns of their own; null role or text is empty; a table without
conversations gives no rows; other columns are ignored. The SHA-256 of a group of ids is sequential by definition, so the ids
of equal conversations stream, sorted, through one task in constant memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowfeat.llm.common import by_value, drop_stored, stored, tuned
from flowfeat.operators.positions import group_positions

by_value(__name__)

SEGMENT = 4096
BATCHES = (1 / 16, 1 / 4)  # shares of the conversations after which the next batch begins
_KEY = "struct<x:bigint,y:bigint>"
_EDGE = f"head {_KEY}, top bigint, bottom bigint, keys array<{_KEY}>, conv bigint, entry {_KEY}, handle {_KEY}, ext {_KEY}"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def root_key() -> Column:
    return F.struct(F.lit(0).cast("bigint").alias("x"), F.lit(0).cast("bigint").alias("y"))


def fattest(low: Column, high: Column) -> Column:
    """The number of (low, high] that is divisible by the largest power of two."""
    top = F.length(F.bin(low.bitwiseXOR(high))) - 1
    ones = F.lit(-1).cast("bigint")
    return F.call_function("shiftleft", ones, top).bitwiseAND(high)


def turn_digests(turns: DataFrame) -> DataFrame:
    """conv, turn, digest (16 bytes), points (code points of the text): narrow rows for all that follows."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    known = turns.where("conv_id IS NOT NULL")
    return known.select(F.col("conv_id").cast("bigint").alias("conv"), "turn", digest.alias("digest"), F.char_length(text).cast("bigint").alias("points"))


def ordered(rows: DataFrame) -> DataFrame:
    """`rows` with `place` = 0, 1, … in each conversation."""
    return group_positions(rows, "conv", [F.asc_nulls_first("turn"), F.asc("digest")], out="place")


def segments(sequences: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """conv, top, head, keys, points (running code points), before (those above `top`) of every piece of a path.

    `sequences` has conv, depth (1, 2, …), digest and points.
    """
    mark = F.md5(F.concat("digest", F.encode(F.col("depth").cast("string"), "UTF-8")))
    parts = [F.conv(F.substring(mark, at, 15), 16, 10).cast("decimal(20,0)").alias(name) for at, name in ((1, "x"), (17, "y"))]
    marked = sequences.select("conv", "depth", "points", F.expr(f"(depth - 1) div {segment}").alias("part"), *parts)
    sums = marked.groupBy("conv", "part").agg(F.sum("x").alias("x"), F.sum("y").alias("y"), F.sum("points").alias("p"))
    before = W.partitionBy("conv").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(
        F.col("conv").alias("c"), F.col("part").alias("s"),
        *[F.coalesce(F.sum(n).over(before), F.lit(0)).cast(f"decimal(38,0)").alias(f"{n}0") for n in ("x", "y")],
        F.coalesce(F.sum("p").over(before), F.lit(0)).alias("p0"),
    )
    upto = W.partitionBy("conv", "part").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    runs = marked.select("conv", "part", "depth", *[F.sum(n).over(upto).alias(n) for n in ("x", "y", "points")])
    joined = runs.join(offsets, (F.col("conv") == F.col("c")) & (F.col("part") == F.col("s")))
    modulus = F.lit(1 << 60).cast("decimal(38,0)")

    def key(x: Column, y: Column) -> Column:
        return F.struct((x % modulus).cast("bigint").alias("x"), (y % modulus).cast("bigint").alias("y"))

    one = F.struct("depth", key(F.col("x") + F.col("x0"), F.col("y") + F.col("y0")).alias("key"), (F.col("points") + F.col("p0")).alias("points"))
    listed = joined.groupBy("conv", "part").agg(
        F.sort_array(F.collect_list(one)).alias("l"), F.first("x0").alias("x0"), F.first("y0").alias("y0"), F.first("p0").alias("before")
    )
    return listed.select(
        "conv", (F.col("part") * segment).alias("top"), key(F.col("x0"), F.col("y0")).alias("head"),
        F.col("l.key").alias("keys"), F.col("l.points").alias("points"), "before",
    )


def _at(keys: str, place: Column) -> Column:
    """Key number `place` (from 1) of an array, null outside of it."""
    return F.get(F.col(keys), (place - 1).cast("int"))


def _slice(keys: str, after: Column, upto: Column) -> Column:
    return F.slice(F.col(keys), (after + 1).cast("int"), (upto - after).cast("int"))


def located(batch: DataFrame, edges: DataFrame, rounds: int) -> DataFrame:
    """`batch` with `leaves` (depth of the last prefix that the trie has) and `entry` and `bottom` of the edge it leaves inside."""
    state = batch.withColumns({"a": F.col("top"), "b": F.col("top") + F.size("keys")})
    handles = edges.select(F.col("handle").alias("h"), F.col("top").alias("upper"), F.col("bottom").alias("found"), F.col("ext").alias("last"))
    kept = state.columns
    for _ in range(rounds):
        going = F.col("a") < F.col("b")
        state = state.withColumn("f", F.when(going, fattest(F.col("a"), F.col("b"))))
        # a search that is over asks under its own last key, so that no value gathers the idle rows
        state = state.withColumn("ask", F.coalesce(_at("keys", F.col("f") - F.col("top")), F.element_at("keys", -1)))
        state = state.join(handles, (F.col("ask") == F.col("h")) & F.col("f").isNotNull(), "left")
        # an edge whose handle is a prefix, but not its end, is the one to leave: the search is over above it
        whole = F.coalesce(_at("keys", F.col("found") - F.col("top")) == F.col("last"), F.lit(False))
        a = F.when(F.col("found").isNull(), F.col("a")).when(whole, F.col("found")).otherwise(F.col("upper"))
        b = F.when(F.col("f").isNotNull() & F.col("found").isNull(), F.col("f") - 1).otherwise(F.col("b"))
        b = F.when(F.col("found").isNotNull() & ~whole, F.col("upper")).otherwise(b)
        state = state.select(*[c for c in kept if c not in ("a", "b")], a.alias("a"), b.alias("b"))
    below = edges.select(F.col("entry").alias("e"), F.col("keys").alias("inside"), "bottom")
    state = state.withColumn("ask", F.coalesce(_at("keys", F.col("a") - F.col("top") + 1), F.element_at("keys", -1)))
    open_ = F.col("a") < F.col("top") + F.size("keys")
    state = state.join(below, (F.col("ask") == F.col("e")) & open_, "left")
    rest = F.slice("keys", (F.col("a") - F.col("top") + 1).cast("int"), F.size("keys"))
    equal = F.size(F.filter(F.zip_with(rest, "inside", lambda p, q: p == q), lambda same: same))
    leaves = F.col("a") + F.when(F.col("e").isNull(), 0).otherwise(equal)
    return state.withColumn("leaves", leaves.cast("bigint")).select(*batch.columns, "leaves", F.col("e").alias("entry"), "bottom")


def cut(edges: DataFrame) -> DataFrame:
    """Edges (head, top, keys, conv, cuts) as one edge for each run between two of its cuts."""
    bottom = F.col("top") + F.size("keys")
    ends = F.array_sort(F.array_distinct(F.concat(F.filter("cuts", lambda d: (d > F.col("top")) & (d < bottom)), F.array(bottom))))
    edges = edges.withColumn("ends", ends)
    begins = F.concat(F.array("top"), F.slice("ends", 1, F.size("ends") - 1))
    pieces = edges.select("head", "top", "keys", "conv", F.explode(F.arrays_zip(begins.alias("lo"), F.col("ends").alias("hi"))).alias("run"))
    lo, hi, top = F.col("run.lo"), F.col("run.hi"), F.col("top")
    pieces = pieces.select(
        F.when(lo == top, F.col("head")).otherwise(_at("keys", lo - top)).alias("head"),
        lo.alias("top"), hi.alias("bottom"), _slice("keys", lo - top, hi - top).alias("keys"), "conv",
    )
    return pieces.withColumns({
        "entry": _at("keys", F.lit(1)),
        "handle": _at("keys", fattest(F.col("top"), F.col("bottom")) - F.col("top")),
        "ext": F.element_at("keys", -1),
    })


def inserted(edges: DataFrame | None, batch: DataFrame, segment: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """The edges with a batch of pieces (as `segments`) put in, and conv, top, shared: how deep each meets smaller ids.

    All ids of the batch must be above those in `edges`.
    """
    if edges is None:
        found = batch.withColumns({"leaves": F.col("top"), "entry": F.lit(None).cast(_KEY), "bottom": F.lit(None).cast("bigint")})
    else:
        longest = batch.agg(F.max(F.size("keys"))).first()[0] or 1
        found = located(batch, edges, longest.bit_length() + 1)
    found = stored(found)
    end = F.col("top") + F.size("keys")
    beyond = F.slice("keys", (F.col("leaves") - F.col("top") + 1).cast("int"), F.size("keys"))
    new = found.select("conv", "leaves", F.posexplode(beyond).alias("i", "key")).select("conv", "key", (F.col("leaves") + F.col("i") + 1).alias("depth"))
    owners = stored(new.groupBy("key").agg(F.min("conv").alias("owner"), F.first("depth").alias("depth")))
    piece = F.expr(f"(depth - 1) div {segment} * {segment}")
    owned = owners.groupBy(F.col("owner").alias("o"), piece.alias("t")).agg(F.count("*").alias("owned"))
    placed = found.join(owned, (F.col("conv") == F.col("o")) & (F.col("top") == F.col("t")), "left")
    shared = end - F.coalesce("owned", F.lit(0))
    placed = stored(placed.select(*found.columns, shared.alias("shared")))
    left = F.when(F.col("shared") == F.col("top"), F.col("head")).otherwise(_at("keys", F.col("shared") - F.col("top")))

    # a place where a conversation leaves another one of its batch, or ends on it: by the owner of the key there
    points = placed.where("shared > leaves").select(left.alias("k")).distinct()
    marks = owners.join(points, F.col("key") == F.col("k")).groupBy(F.col("owner").alias("o"), piece.alias("t"))
    marks = marks.agg(F.collect_list("depth").alias("cuts"))
    tails = placed.where(F.col("shared") < end).join(marks, (F.col("conv") == F.col("o")) & (F.col("top") == F.col("t")), "left")
    tails = tails.select(
        left.alias("head"), F.col("shared").alias("top"), _slice("keys", F.col("shared") - F.col("top"), F.size("keys") + F.lit(0).cast("bigint")).alias("keys"),
        "conv", F.coalesce("cuts", F.array().cast("array<bigint>")).alias("cuts"),
    )
    if edges is not None:
        inside = placed.where("shared = leaves AND entry IS NOT NULL AND leaves < bottom")
        marks = inside.groupBy(F.col("entry").alias("e")).agg(F.collect_set("leaves").alias("cuts"))
        old = edges.join(marks, F.col("entry") == F.col("e"), "left")
        tails = tails.unionByName(old.select("head", "top", "keys", "conv", F.coalesce("cuts", F.array().cast("array<bigint>")).alias("cuts")))
    out = stored(cut(tails))
    drop_stored(found, owners)
    return out, placed.select("conv", "top", "shared")


def group_digests(rows: DataFrame) -> DataFrame:
    """key, sha: SHA-256 of the ascending ids `conv`, joined by commas, of each `key`. Ids stream, none are gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            done = []
            for x, y, conv in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "conv"))):
                if (x, y) == last:
                    state.update(b",%d" % conv)
                else:
                    if last is not None:
                        done.append((*last, state.hexdigest()))
                    last, state = (x, y), hashlib.sha256(b"%d" % conv)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["x", "y", "sha"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*last, state.hexdigest())], names=["x", "y", "sha"])

    flat = rows.select("key.x", "key.y", "conv").repartition("x", "y").sortWithinPartitions("x", "y", "conv")
    return flat.mapInArrow(run, "x bigint, y bigint, sha string").select(F.struct("x", "y").alias("key"), "sha")


def nodes(sequences: DataFrame, members: DataFrame, batches: tuple = BATCHES, segment: int = SEGMENT) -> DataFrame:
    """One row for every node of the trie of `sequences` (conv, depth, digest, points); `members` lists all ids (conv).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    spark = tuned(sequences.sparkSession)
    paths = stored(segments(sequences, segment))
    tail = F.max(F.struct("top", F.element_at("keys", -1).alias("key"), (F.col("top") + F.size("keys")).alias("depth"), F.element_at("points", -1).alias("points")))
    ends = paths.groupBy("conv").agg(tail.alias("t")).select(F.col("conv").alias("c"), "t.key", "t.depth", "t.points")
    ends = members.select("conv").distinct().join(ends, F.col("conv") == F.col("c"), "left")
    ends = stored(ends.select("conv", F.coalesce("key", root_key()).alias("key"), F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("points", F.lit(0)).alias("points")))
    # equal conversations are one sequence, under the smallest id
    seqs = ends.groupBy("key").agg(F.min("conv").alias("rep"), F.count("*").alias("copies"), F.first("depth").alias("length"), F.first("points").alias("all_points"))
    seqs = stored(seqs)
    mine = stored(paths.join(seqs.select("rep"), F.col("conv") == F.col("rep"), "left_semi"))

    edges, shares, low = None, [], None
    for high in [*(seqs.approxQuantile("rep", list(batches), 0.01) if batches else []), None]:
        batch = mine.where(F.lit(True) if low is None else F.col("conv") > low).where(F.lit(True) if high is None else F.col("conv") <= high)
        edges, shared = inserted(edges, batch, segment)
        shares.append(shared)
        low = int(high) if high is not None else None
    shares = reduce(DataFrame.unionByName, shares)

    met = mine.select("conv", "top", "points", "before").join(
        shares.where("shared > top").select(F.col("conv").alias("c"), F.col("top").alias("t"), "shared"), (F.col("conv") == F.col("c")) & (F.col("top") == F.col("t"))
    )
    met = met.groupBy(F.col("conv").alias("m")).agg(F.max("shared").alias("shared"), F.max(_at("points", F.col("shared") - F.col("top"))).alias("met"))
    heads = edges.select(F.col("head").alias("h")).distinct()
    facts = seqs.join(met, F.col("rep") == F.col("m"), "left").join(heads, F.col("key") == F.col("h"), "left")
    facts = stored(
        facts.select(
            "rep", "copies", "length", "all_points", F.coalesce("shared", F.lit(0)).alias("shared"), F.coalesce("met", F.lit(0)).alias("met"),
            F.col("h").isNull().cast("bigint").alias("leaf"),
        )
    )

    def child(depth: Column) -> Column:  # does the sequence own the node below
        return ((depth >= F.col("shared")) & (depth < F.col("length"))).cast("bigint")

    def saved(above: Column) -> Column:  # code points from here on that a smaller id, or a copy, has as well
        return (F.col("copies") - 1) * (F.col("all_points") - above) + F.greatest(F.col("met") - above, F.lit(0))

    def sums(depth: Column, above: Column) -> list[Column]:
        return [F.sum("copies").alias("n_convs"), F.sum(child(depth)).alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum(saved(above)).alias("saved_tokens")]

    zero = F.lit(0).cast("bigint")
    top = facts.agg(F.min("rep").alias("conv_id"), *sums(zero, zero)).where("n_convs > 0")
    first = top.first()
    top = top.withColumns({"key": root_key(), "depth": zero, "parent_conv_id": F.lit(None).cast("bigint")})

    steps = mine.join(facts, F.col("conv") == F.col("rep")).select(
        "top", "before", "points", *facts.columns, F.posexplode("keys").alias("i", "key")
    )
    depth, above = F.col("top") + F.col("i") + 1, F.when(F.col("i") == 0, F.col("before")).otherwise(F.get("points", F.col("i") - 1))
    steps = steps.withColumns({"depth": depth, "above": above}).groupBy("key").agg(*sums(F.col("depth"), F.col("above")))

    # expand the edges: every depth a row; the first hangs from the edge that ends in its head
    owners = edges.select(F.col("ext").alias("x"), F.col("conv").alias("above_conv"))
    hung = edges.join(owners, F.col("head") == F.col("x"), "left")
    above_conv = F.when(F.col("top") == 0, F.lit(first["conv_id"] if first else None)).otherwise(F.col("above_conv")).cast("bigint")
    spread = hung.select("conv", "top", above_conv.alias("above_conv"), F.posexplode("keys").alias("i", "key")).select(
        F.col("key").alias("k"), F.col("conv").alias("conv_id"), (F.col("top") + F.col("i") + 1).alias("depth"),
        F.when(F.col("i") == 0, F.col("above_conv")).otherwise(F.col("conv")).alias("parent_conv_id"),
    )
    found = steps.join(spread, F.col("key") == F.col("k")).drop("k").unionByName(top)
    digests = group_digests(ends).select(F.col("key").alias("k"), "sha")
    found = found.join(digests, F.col("key") == F.col("k"), "left")
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    return found.select(*[F.col(c).cast("bigint").alias(c) for c in names], F.coalesce("sha", F.lit(EMPTY_SHA)).alias("ends_sha256"))


def rebuilt(turns: DataFrame, heads: Column, base: Column, longest: int) -> tuple[DataFrame, DataFrame]:
    """(conv, depth, digest, points) of conversations that begin with turns of another one, and all ids (conv).

    Of the conversation `base` (a column over `conv`) the first `heads` turns (at most `longest`, all if it has fewer)
    come first, then the own turns after as many.
    """
    rows = stored(ordered(turn_digests(turns)))
    ids = rows.groupBy("conv").agg(F.count("*").alias("n")).withColumns({"own": heads, "base": base})
    sizes = ids.select(F.col("conv").alias("b"), F.col("n").alias("n_base"))
    ids = ids.join(sizes, F.col("base") == F.col("b"), "left")
    ids = stored(ids.select("conv", "own", "base", F.least("own", F.coalesce("n_base", F.lit(0))).cast("bigint").alias("taken")))
    first = rows.where(F.col("place") < longest).select(F.col("conv").alias("b"), "place", "digest", "points")
    begin = ids.join(first, (F.col("base") == F.col("b")) & (F.col("place") < F.col("taken")))
    begin = begin.select("conv", (F.col("place") + 1).alias("depth"), "digest", "points")
    info = ids.select(F.col("conv").alias("c"), "own", "taken")
    rest = rows.join(info, F.col("conv") == F.col("c")).where("place >= own")
    rest = rest.select("conv", (F.col("place") - F.col("own") + F.col("taken") + 1).alias("depth"), "digest", "points")
    return begin.unionByName(rest), ids.select("conv")


def with_turns(found: DataFrame, sequences: DataFrame) -> DataFrame:
    """The nodes with the digest of their last turn, from the conversation that names them."""
    last = sequences.select(F.col("conv").alias("c"), F.col("depth").alias("d"), "digest")
    return found.join(last, (F.col("conv_id") == F.col("c")) & (F.col("depth") == F.col("d")), "left").drop("c", "d")
