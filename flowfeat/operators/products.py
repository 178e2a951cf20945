"""Exact best items by dot product, without scoring all pairs.

Items are ordered by falling length of their vectors and cut into groups of doubling size, up to a limit, in that order.
Inside a group near vectors share a block, and blocks are judged by two bounds: the user's length times the longest
vector of the block (Cauchy-Schwarz), and the sum of the largest products with the sides of the box around the block. A
block that cannot better a user's n-th best score, or equals it with larger ids only, is not scored for that user.

Users are dealt to teams once, with the pairs they have seen; every team gets a copy of each group and visits
them in order, so neither users nor results so far are shuffled again.
"""

from __future__ import annotations

import sys
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from flowfeat.columns import need
from flowfeat.functions import arrays
from flowfeat.operators.positions import global_positions
from flowfeat.operators.recommend import top_n
from flowfeat.session import cut_lineage

# functions go to the executors by value, so that they need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_USERS = 512
BLOCK_ITEMS = 1024
BROADCAST_BYTES = 64 << 20  # places of items up to so many bytes go to every task whole
GROUP_ITEMS = 1 << 16  # items of a group
GROUP_BYTES = 32 << 20  # and the bytes of their vectors
TEAM_USERS = 1 << 18  # users of a team
TEAM_BYTES = 256 << 20  # and the bytes of their vectors and best scores
TILE_ITEMS = 2048  # aimed items that a block of users is multiplied with at once
_SLACK = 1.0 + 1e-9  # a bound that rounding cannot undercut
_WHOLE = ("tinyint", "smallint", "int", "bigint")
_LAST = np.iinfo(np.int64).max


def _vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    rows = df.select(F.col(key), F.col(vector).cast("array<double>").alias("_v")).dropDuplicates([key])
    rows = rows.where(F.col("_v").isNotNull()).withColumn("_length", arrays.norm("_v"))
    return rows.where(F.col("_length").isNotNull() & ~F.isnan("_length"))  # no score is a number otherwise


def top_n_products(
    users: DataFrame,
    items: DataFrame,
    seen: DataFrame,
    n: int,
    user: str = "userIdIndex",
    item: str = "itemIdIndex",
    vector: str = "features",
    block_users: int = BLOCK_USERS,
    block_items: int = BLOCK_ITEMS,
    as_array: bool = True,
    report: list | None = None,
) -> DataFrame:
    """Best `n` items per user by dot product, ties by item, without the pairs of `seen`.

    One row per id is taken; rows without a vector are left out. Into the list `report` goes one
    dict per group that was looked at: its blocks, the users that took part and the pairs really scored.
    """
    need(users, user, vector)
    need(items, item, vector)
    need(seen, user, item)
    if n < 1:
        raise ValueError("n must be positive")
    known = cut_lineage(_vectors(users, user, vector))
    placed = cut_lineage(global_positions(_vectors(items, item, vector), [F.desc("_length"), F.asc(item)], "_at"))
    kinds = [users.schema[user].dataType.simpleString(), items.schema[item].dataType.simpleString()]
    size = placed.agg(F.count("*").alias("n"), F.max(F.size("_v")).alias("width"), F.count(item).alias("named")).first()
    width = size["width"] or 1
    plain = kinds[1] in _WHOLE and size["named"] == size["n"]  # the id itself tells which of two items comes first
    ranked = placed.withColumn("_tie", F.col(item).cast("long")) if plain else cut_lineage(global_positions(placed, [item], "_tie"))

    most = max(1, min(GROUP_ITEMS, GROUP_BYTES // (8 * width)) // block_items)
    group = _group_of(F.col("_at"), block_items, most.bit_length() - 1)
    asked = known.count()
    room = max(1, min(TEAM_USERS, TEAM_BYTES // (8 * width + 16 * n)))
    teams = max(asked // room, min(asked // block_users, 2 * users.sparkSession.sparkContext.defaultParallelism - 1)) + 1
    rows = _dealt(known, _packed(ranked, group, block_items), _had(seen, placed, user, item, size["n"], group), user, teams)
    schema = f"`{user}` {kinds[0]}, _tie bigint, score double, _group int, users bigint, pairs bigint"
    found = cut_lineage(rows.mapInArrow(lambda batches: _served(batches, user, n, width, block_users, block_items), schema))
    if report is not None:
        counted = found.where("_group IS NOT NULL").groupBy("_group").agg(F.sum("users").alias("users"), F.sum("pairs").alias("pairs"))
        blocks = placed.select(group.alias("_group"), F.expr(f"_at div {int(block_items)}").alias("_b")).groupBy("_group")
        blocks = blocks.agg(F.min("_b").alias("first_block"), F.count_distinct("_b").alias("blocks"))
        report += [r.asDict() for r in blocks.join(counted, "_group").orderBy("_group").drop("_group").collect()]
    best = found.where("_group IS NULL").select(user, "_tie", "score")
    if plain:
        best = best.withColumn(item, F.col("_tie").cast(kinds[1]))
    else:
        best = best.join(ranked.select("_tie", item), "_tie")
    return top_n(best, user, item, "score", n, as_array=as_array)


def _group_of(at: Column, block_items: int, doublings: int) -> Column:
    """Group of the item at a place: of 1, 2, 4 … blocks, and of 2 ** `doublings` blocks from there on."""
    block = F.floor(at / block_items) + 1
    return F.when(block < 1 << doublings, F.length(F.bin(block)) - 1).otherwise(doublings - 1 + F.floor(block / (1 << doublings))).cast("int")


def _packed(ranked: DataFrame, group: Column, block_items: int) -> DataFrame:
    """(_group, _longs, _v): the vectors of a group, block by block, as bytes; _longs has their ties and then their places."""
    listed = ranked.groupBy(group.alias("_group")).agg(F.sort_array(F.collect_list(F.struct("_tie", "_at", "_v"))).alias("_p"))
    listed = listed.select("_group", F.col("_p._tie").alias("_ties"), F.col("_p._at").alias("_ats"), F.flatten("_p._v").alias("_v"))

    def arranged(frames):
        for frame in frames:
            for row in frame.itertuples(index=False):
                ties, ats = np.asarray(row[1]), np.asarray(row[2])
                vectors = np.asarray(row[3]).reshape(len(ties), -1)
                order = _near_together(vectors, block_items)
                longs = np.concatenate([ties[order], ats[order]]).astype(np.int64)
                yield pd.DataFrame({"_group": [row[0]], "_longs": [longs.tobytes()], "_v": [vectors[order].astype(float).tobytes()]})

    return cut_lineage(listed.mapInPandas(arranged, "_group int, _longs binary, _v binary"))


def _had(seen: DataFrame, placed: DataFrame, user: str, item: str, items: int, group: Column) -> DataFrame:
    places = placed.select(F.col(item).alias("_i"), "_at")
    if items * 16 <= BROADCAST_BYTES:
        places = F.broadcast(places)
    return seen.select(user, item).join(places, F.col(item) == F.col("_i")).select(user, "_at", group.alias("_group"))


def _dealt(known: DataFrame, packed: DataFrame, had: DataFrame, user: str, teams: int) -> DataFrame:
    """One partition per team: its users, then group by group the seen pairs of the group and the group.

    What only some of the rows have are bytes: a null array costs far more on its way to Python.
    """
    to = F.pmod(F.xxhash64(F.col(user)), F.lit(teams)).cast("int").alias("_to")
    kind = known.schema[user].dataType
    if had.schema[user].dataType != kind:  # equal ids have equal hashes only in one type
        same = F.col(user).try_cast(kind)
        had = had.withColumn(user, F.when(same == F.col(user), same))
    no_at, no_longs, no_v = (F.lit(None).cast(t) for t in ("bigint", "binary", "binary"))
    raw = StructType([known.schema[user]]).add("_v", "binary")
    members = known.select(user, "_v").mapInArrow(_raw, raw).select(to, F.lit(0).alias("_late"), F.col(user).alias("_u"), no_at.alias("_at"), no_longs.alias("_longs"), "_v")
    pairs = had.select(to, (2 * F.col("_group") + 1).alias("_late"), F.col(user).alias("_u"), "_at", no_longs.alias("_longs"), no_v.alias("_v"))
    sent = packed.select(
        F.explode(F.sequence(F.lit(0), F.lit(teams - 1))).alias("_to"), (2 * F.col("_group") + 2).alias("_late"),
        F.lit(None).cast(kind).alias("_u"), no_at.alias("_at"), "_longs", "_v",
    )
    rows = members.union(pairs).union(sent)
    return rows.repartitionById(teams, F.col("_to")).sortWithinPartitions("_late")


def _raw(batches):
    """(id, vector) with the vector as bytes."""
    for batch in batches:
        lists = [x.tobytes() for x in batch.column(1).to_numpy(zero_copy_only=False)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.binary())], batch.schema.names)


def _near_together(vectors: np.ndarray, block: int) -> np.ndarray:
    """An order whose every `block` rows lie near together: halved across the widest side, equal ones left in their order."""
    open_, done = [np.arange(len(vectors))], []
    while open_:
        rows = open_.pop()
        if len(rows) <= block:
            done.append(rows)
            continue
        at = -(-len(rows) // block) // 2 * block
        side = np.ptp(vectors[rows], axis=0).argmax() if vectors.shape[1] else None
        rows = rows if side is None else rows[np.argsort(vectors[rows, side], kind="stable")]
        open_ += [np.sort(rows[at:]), np.sort(rows[:at])]
    return np.concatenate([np.empty(0, int), *done])


def _boxes(vectors: np.ndarray, block: int) -> tuple[np.ndarray, ...]:
    """(lower sides, upper sides, greatest length) of every `block` rows."""
    starts = np.arange(0, len(vectors), block)
    return np.minimum.reduceat(vectors, starts), np.maximum.reduceat(vectors, starts), np.maximum.reduceat(_lengths(vectors), starts) * _SLACK


def _lengths(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors * vectors).sum(axis=1)) + 1e-150  # squares of very small numbers are zero


def _served(batches, user: str, n: int, width: int, block_users: int, block_items: int):
    """Rows of `_dealt` to the best of each user; and one row per team and group with what was scored."""
    team, number = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        to, late = batch.column("_to").to_numpy(), batch.column("_late").to_numpy()
        cuts = np.flatnonzero((np.diff(to) != 0) | (np.diff(late) != 0)) + 1
        for begin, end in pairwise([0, *cuts.tolist(), len(to)]):
            if team is None or to[begin] != number:
                if team is not None:
                    yield from team.result()
                team, number = _Team(user, n, width, block_users, block_items), to[begin]
            team.take(int(late[begin]), batch.slice(begin, end - begin))
    if team is not None:
        yield from team.result()


class _Team:
    """The users of a team with their best n so far (scores, and the ties of the items)."""

    def __init__(self, user: str, n: int, width: int, block_users: int, block_items: int):
        self.user, self.n, self.width, self.block_users, self.block_items = user, n, width, block_users, block_items
        self.members, self.pairs, self.ids, self.counted = [], [], None, []

    def take(self, late: int, rows) -> None:
        if late == 0:
            self.members.append((rows.column("_u"), np.frombuffer(b"".join(rows.column("_v").to_pylist()))))
        elif late % 2:
            self.pairs.append((rows.column("_u"), rows.column("_at").to_numpy()))
        elif self.members:
            self.gather()
            longs, vectors = (np.frombuffer(rows.column(c)[0].as_py(), t) for c, t in (("_longs", np.int64), ("_v", float)))
            self.meet(late // 2 - 1, *longs.reshape(2, -1), vectors.reshape(len(longs) // 2, -1))
            self.pairs = []

    def gather(self) -> None:
        if self.ids is not None:
            return
        vectors = np.concatenate([v for _, v in self.members]).reshape(-1, self.width)
        order = _near_together(vectors, self.block_users)
        self.ids, self.vectors = pa.concat_arrays([u for u, _ in self.members]).take(pa.array(order)), vectors[order]
        self.lengths = _lengths(self.vectors)
        self.boxes = _boxes(self.vectors, self.block_users)
        self.scores = np.full((len(order), self.n), -np.inf)
        self.ties = np.full((len(order), self.n), _LAST)

    def seen(self, ats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Seen pairs with the group at hand: places of the users, in rising order, and of the items."""
        if not self.pairs:
            return np.empty(0, int), np.empty(0, int)
        at = pc.index_in(pa.concat_arrays([u for u, _ in self.pairs]), value_set=self.ids, skip_nulls=True)
        mine = np.asarray(at.is_valid())
        at = at.fill_null(0).to_numpy()[mine]
        places = np.empty(len(ats), int)
        places[ats - ats.min()] = np.arange(len(ats))
        of = places[np.concatenate([a for _, a in self.pairs])[mine] - ats.min()]
        order = np.argsort(at, kind="stable")
        return at[order], of[order]

    def meet(self, group: int, ties: np.ndarray, ats: np.ndarray, vectors: np.ndarray) -> None:
        block, low, high = self.block_items, *self.boxes[:2]
        i_low, i_high, i_length = _boxes(vectors, block)
        first = np.minimum.reduceat(ties, np.arange(0, len(ties), block))
        bounds = np.zeros((len(low), len(i_low)))
        for k in range(self.width):
            sides = [np.multiply.outer(a[:, k], b[:, k]) for a in (low, high) for b in (i_low, i_high)]
            bounds += np.maximum.reduce(sides)
        bounds = np.minimum(_number(bounds), _number(np.multiply.outer(self.boxes[2], i_length)))
        starts = np.arange(0, len(self.vectors), self.block_users)
        floors = np.minimum.reduceat(self.scores[:, -1], starts)
        crowds = np.flatnonzero(~(bounds.max(axis=1) < floors))
        if not len(crowds):
            return
        seen_u, seen_i = self.seen(ats)
        place, served, pairs = np.full(len(ties), -1), 0, 0
        for c in crowds:
            begin, end = starts[c], min(starts[c] + self.block_users, len(self.vectors))
            had = slice(*np.searchsorted(seen_u, [begin, end]))
            near = np.lexsort((first, -bounds[c]))
            took, at, step = np.zeros(end - begin, bool), 0, 1
            while at < len(near) and not bounds[c, near[at]] < self.scores[begin:end, -1].min():
                blocks, at, step = near[at : at + step], at + step, min(2 * step, max(1, TILE_ITEMS // block))
                rows, blocks = self.open(begin, end, blocks, i_low, i_high, i_length, first)
                if not len(rows):
                    continue
                cols = (blocks[:, None] * block + np.arange(block)).ravel()
                cols = cols[cols < len(ties)]
                place[cols] = np.arange(len(cols))
                self.score(rows, cols, vectors, ties, seen_u[had], place[seen_i[had]], i_length[blocks].max())
                place[cols] = -1
                took[rows - begin] = True
                pairs += len(rows) * len(cols)
            served += took.sum()
        self.counted.append((group, int(served), pairs))

    def open(self, begin, end, blocks, i_low, i_high, i_length, first) -> tuple[np.ndarray, np.ndarray]:
        """Users of begin … end and blocks with a pair that may still change a best list.

        Terms are added in the order of `exact`, so a rounded bound is never below a rounded score.
        """
        floors, last = self.scores[begin:end, -1:], self.ties[begin:end, -1:]
        bound = np.zeros((end - begin, len(blocks)))
        for k in range(self.width):
            x = self.vectors[begin:end, k]
            bound += np.maximum(np.multiply.outer(x, i_low[blocks, k]), np.multiply.outer(x, i_high[blocks, k]))
        bound = _number(bound)
        closed = (bound < floors) | ((bound == floors) & (first[blocks] > last))
        closed |= np.multiply.outer(self.lengths[begin:end], i_length[blocks]) < floors
        return begin + np.flatnonzero(~closed.all(axis=1)), blocks[~closed.all(axis=0)]

    def score(self, rows, cols, vectors, ties, seen_u, seen_at, length) -> None:
        """Score `rows` with the items at `cols` and keep the best; `seen_at` are columns of seen items, -1 for others."""
        product = self.vectors[rows] @ vectors[cols].T
        at = np.searchsorted(rows, seen_u)
        mine = (seen_at >= 0) & (at < len(rows))
        mine[mine] = rows[at[mine]] == seen_u[mine]
        product[at[mine], seen_at[mine]] = -np.inf
        floor = self.scores[rows, -1]
        bare = np.flatnonzero(floor == -np.inf)
        if len(bare) and len(cols) > self.n:
            floor[bare] = np.partition(product[bare], -self.n, axis=1)[:, -self.n]
        limit = floor - (8 * (self.width + 1) * np.finfo(float).eps) * self.lengths[rows] * length
        r, c = np.nonzero((product >= np.where(np.isnan(limit), -np.inf, limit)[:, None]) & (product > -np.inf))
        r, c = rows[r], cols[c]
        scores = np.zeros(len(r))
        for k in range(self.width):
            scores += self.vectors[r, k] * vectors[c, k]
        better = (scores > self.scores[r, -1]) | ((scores == self.scores[r, -1]) & (ties[c] < self.ties[r, -1]))
        r, c, scores = r[better], c[better], scores[better]
        if not len(r):
            return
        who = np.unique(r)
        r = np.concatenate([r, np.repeat(who, self.n)])
        scores = np.concatenate([scores, self.scores[who].ravel()])
        tied = np.concatenate([ties[c], self.ties[who].ravel()])
        order = np.lexsort((tied, -scores, r))
        first = np.searchsorted(r[order], who)
        kept = order[(first[:, None] + np.arange(self.n)).ravel()]
        self.scores[who], self.ties[who] = scores[kept].reshape(-1, self.n), tied[kept].reshape(-1, self.n)

    def result(self):
        """Record batches: the best of some users each, and one row per group."""
        size = max(1, (1 << 20) // self.n)
        for begin in range(0, len(self.ids) if self.ids is not None else 0, size):
            rows, cols = np.nonzero(self.scores[begin : begin + size] > -np.inf)
            at = rows + begin
            yield self.batch(self.ids.take(pa.array(at)), pa.array(self.ties[at, cols]), pa.array(self.scores[at, cols]), None, None, None)
        if self.counted:
            yield self.batch(None, None, None, *zip(*self.counted, strict=True))

    def batch(self, *columns):
        size = next(len(c) for c in columns if c is not None)
        names = [self.user, "_tie", "score", "_group", "users", "pairs"]
        kinds = [self.ids.type, pa.int64(), pa.float64(), pa.int32(), pa.int64(), pa.int64()]
        columns = [pa.nulls(size, t) if c is None else pa.array(c, t) if isinstance(c, tuple) else c for c, t in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names)


def _number(bounds: np.ndarray) -> np.ndarray:
    """Bounds of vectors that are not finite are no bounds."""
    return np.where(np.isnan(bounds), np.inf, bounds)
