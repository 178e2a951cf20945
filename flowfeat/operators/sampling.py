"""Negative sampling, splits and samples; every draw is a hash, so results repeat."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowfeat.columns import as_list, need
from flowfeat.functions.hashing import hash_fraction, hash_long, hash_uniform, other_than


def negatives_per_row(
    df: DataFrame,
    item: str,
    n_items: int,
    neg_num: int = 1,
    label_col: str = "label",
    seed: int = 42,
    key: str | list[str] = (),
    exclude_seen: bool = False,
    user: str | None = None,
    out_col: str | None = None,
    categories: DataFrame | None = None,
    category: str | None = None,
    start: int = 0,
    hash: str = "md5",
) -> DataFrame:
    """Each row becomes `neg_num` rows with another item (label 0) and itself (label 1).

    Row-local: no shuffle unless an option asks for a lookup. `key` names the columns that
    identify a row. By default a negative may be another positive of the user, and the other
    columns stay those of the positive; `exclude_seen` (with `user`) drops negatives the
    user has as positives, `categories` (item, category) refreshes the column `category`.
    """
    key = as_list(key)
    need(df, item, *key)
    out = out_col or item
    positive = F.col(item).cast("long")
    drawn = [
        F.struct(other_than(positive, F.col("_base"), j, n_items, start).alias("item"), F.lit(0).alias("label"))
        for j in range(neg_num)
    ]
    own = F.struct(positive.alias("item"), F.lit(1).alias("label"))
    rest = [c for c in df.columns if c != item]
    based = df.withColumn("_base", hash_long(*key, seed=seed, hash=hash))
    rows = based.select(*rest, F.explode(F.array(*drawn, own)).alias("_n")).select(
        *rest, F.col("_n.item").alias(out), F.col("_n.label").alias(label_col)
    )
    if exclude_seen:
        if user is None:
            raise ValueError("exclude_seen needs the user column")
        seen = df.select(user, F.col(item).cast("long").alias(out)).distinct().withColumn("_seen", F.lit(True))
        rows = rows.join(seen, [user, out], "left")
        rows = rows.where((F.col(label_col) == 1) | F.col("_seen").isNull()).drop("_seen")
    if categories is not None:
        known = categories.select(F.col(categories.columns[0]).alias(out), F.col(categories.columns[1]).alias("_cat"))
        rows = rows.join(known, out, "left").withColumn(category, F.col("_cat")).drop("_cat")
    return rows


def negatives_by_pair(
    df: DataFrame,
    user: str,
    item: str,
    amplifier: int = 1,
    seed: int = 42,
    include_positives: bool = False,
    pos_label: float | None = None,
    label: str = "label",
    n_users: int | None = None,
    n_items: int | None = None,
    hash: str = "md5",
) -> DataFrame:
    """Random (user, item) pairs that do not occur in `df`, with label 0.0.

    `amplifier` × row count draws over 1 … the largest id, made distinct; drawing again for
    the ones that collide is not attempted, so slightly fewer pairs come back. With
    `include_positives` the input pairs are added, labelled `pos_label` if it is given.
    """
    need(df, user, item)
    size = df.agg(F.count(F.lit(1)).alias("n"), F.max(user).alias("u"), F.max(item).alias("i")).first()
    users, items = int(n_users or size["u"] or 0), int(n_items or size["i"] or 0)
    if users < 1 or items < 1:
        raise ValueError("negatives need ids of at least one")
    draws = df.sparkSession.range(amplifier * size["n"]).select(
        (hash_uniform("id", F.lit("u"), n=users, seed=seed, hash=hash) + 1).alias(user),
        (hash_uniform("id", F.lit("i"), n=items, seed=seed, hash=hash) + 1).alias(item),
    )
    seen = df.select(F.col(user).cast("long").alias(user), F.col(item).cast("long").alias(item)).distinct()
    negatives = draws.distinct().join(seen, [user, item], "left_anti").withColumn(label, F.lit(0.0))
    if not include_positives:
        return negatives
    own = F.lit(float(pos_label)) if pos_label is not None else F.col(label).cast("double")
    positives = df.select(F.col(user).cast("long").alias(user), F.col(item).cast("long").alias(item), own.alias(label))
    return positives.unionByName(negatives)


ID_RANGE = 1 << 16  # ids that are looked at together; no group holds more rows than that
GROUPS = 10_000  # groups of users whose known pairs are added up by one task


def _cells_with_starts(known: DataFrame, users: int) -> DataFrame:
    """(cu, cc, before, prev): for every user and range of ids that holds a known pair, the known pairs before it, and
    the last known item of the user before it (0: none).

    Running sums take two steps: over at most GROUPS groups of users, then inside a group. There is a row for each cell
    that holds a pair and none for the others, so the work grows with the pairs and not with users times ids.
    """
    cells = known.groupBy("u", "c").agg(F.count(F.lit(1)).alias("taken"), F.max("i").alias("top"))
    cells = cells.withColumn("g", F.expr(f"u div {users // GROUPS + 1}"))
    before = lambda w: F.coalesce(F.sum("taken").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    groups = cells.groupBy("g").agg(F.sum("taken").alias("taken")).select(F.col("g").alias("g0"), before(W.orderBy("g")).alias("base"))
    inside = cells.withColumns({"own": before(W.partitionBy("g").orderBy("u", "c")), "last_u": F.lag("u").over(W.partitionBy("g").orderBy("u", "c"))})
    inside = inside.withColumn("last_top", F.lag("top").over(W.partitionBy("g").orderBy("u", "c")))
    prev = F.when(F.col("last_u") == F.col("u"), F.col("last_top")).otherwise(F.lit(0))
    joined = inside.join(groups, F.col("g") == F.col("g0"))
    return joined.select(F.col("u").alias("cu"), F.col("c").alias("cc"), (F.col("base") + F.col("own")).alias("before"), prev.alias("prev"))


def exact_negatives(
    df: DataFrame,
    user: str,
    item: str,
    amplifier: int = 1,
    seed: int = 42,
    include_positives: bool = False,
    pos_label: float | None = None,
    label: str = "label",
    n_users: int | None = None,
    n_items: int | None = None,
    hash: str = "md5",
    ids: int = ID_RANGE,
) -> DataFrame:
    """Exactly `amplifier` × row count different pairs that do not occur in `df`, with label 0.0.

    All pairs of 1 … the largest ids that do not occur are thought of in the order of (user, item)
    and cut into as many runs of (almost) equal length as pairs are wanted; a hash picks one pair of each
    run. So every free pair is equally likely but for rounding, no two draws meet, and none is rejected. A run is found from the gap
    between two neighbouring known items of a user by counting, so free pairs are never made, nothing
    is joined by range, and no group holds more rows than a range of `ids` item ids. Only if fewer
    pairs are free than wanted, all of them come back. Ids outside the range are not known pairs.
    """
    need(df, user, item)
    size = df.agg(F.count(F.lit(1)).alias("n"), F.max(user).alias("u"), F.max(item).alias("i")).first()
    users, items = int(n_users or size["u"] or 0), int(n_items or size["i"] or 0)
    if users < 1 or items < 1:
        raise ValueError("negatives need ids of at least one")
    known = df.select(F.col(user).cast("long").alias("u"), F.col(item).cast("long").alias("i")).distinct()
    known = known.where(F.col("u").between(1, users) & F.col("i").between(1, items))
    free = users * items - known.count()
    wanted = min(amplifier * size["n"], free)

    # a place behind the last id of each user closes the last gap; with it every user has a cell
    ends = df.sparkSession.range(1, users + 1).select(F.col("id").alias("u"), F.lit(items + 1).cast("bigint").alias("i"))
    places = known.unionByName(ends).withColumn("c", F.expr(f"(i - 1) div {int(ids)}"))
    ordered = W.partitionBy("u", "c").orderBy("i")
    cells = _cells_with_starts(places, users)
    gaps = places.withColumns({"last": F.lag("i").over(ordered), "at": F.row_number().over(ordered) - 1})
    gaps = gaps.join(cells, (F.col("u") == F.col("cu")) & (F.col("c") == F.col("cc")))
    first = F.coalesce("last", "prev") + 1  # ids first … i - 1 are free
    # places before, less the ends among them, are known pairs; what else lies before is free
    rank = (F.col("u") - 1) * items + first - 1 - (F.col("before") + F.col("at") - (F.col("u") - 1))
    gaps = gaps.select("u", first.alias("first"), (F.col("i") - first).alias("n"), rank.alias("rank"))
    gaps = gaps.where("n > 0")
    run = lambda rank: F.expr(f"cast({rank} as decimal(19,0)) * {max(wanted, 1)} div {max(free, 1)}")
    edge = lambda j: F.expr(f"cast({j} as decimal(19,0)) * {max(free, 1)} div {max(wanted, 1)}")
    runs = F.sequence(F.greatest(run("rank") - 1, F.lit(0)), F.least(run("rank + n - 1") + 1, F.lit(wanted - 1).cast("bigint")))
    tried = gaps.where(F.lit(wanted > 0)).withColumn("j", F.explode(runs))
    drawn = edge("j") + hash_uniform("j", n=edge("j + 1") - edge("j"), seed=seed, hash=hash)
    tried = tried.withColumn("at", drawn - F.col("rank")).where("at >= 0 AND at < n")
    negatives = tried.select(F.col("u").alias(user), (F.col("first") + F.col("at")).alias(item), F.lit(0.0).alias(label))
    if not include_positives:
        return negatives
    own = F.lit(float(pos_label)) if pos_label is not None else F.col(label).cast("double")
    return df.select(F.col(user).cast("long").alias(user), F.col(item).cast("long").alias(item), own.alias(label)).unionByName(negatives)


def reached(df: DataFrame, negatives: DataFrame, amplifier: int = 1) -> DataFrame:
    """One row (wanted, reached): how many negatives were asked for `df`, and how many came back."""
    asked = df.agg((F.count(F.lit(1)) * amplifier).alias("wanted"))
    return asked.withColumn("reached", F.lit(negatives.count()))


def require_unique(df: DataFrame, cols: str | list[str]) -> DataFrame:
    """`df` itself; raises if two rows agree on `cols`."""
    cols = as_list(cols)
    need(df, *cols)
    twice = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not twice.isEmpty():
        raise ValueError(f"duplicate rows for {cols}")
    return df


def mix_negatives(
    df: DataFrame, user: str, item: str, n_users: int | None = None, n_items: int | None = None, seed: int = 42,
    label: str = "label",
) -> DataFrame:
    """The input pairs and as many draws of unseen ones; raises if a pair occurs twice."""
    # draws are distinct and unseen by construction, so only the input can hold a pair twice
    require_unique(df.select(F.col(user).cast("long").alias(user), F.col(item).cast("long").alias(item)), [user, item])
    return negatives_by_pair(
        df, user, item, seed=seed, include_positives=True, label=label, n_users=n_users, n_items=n_items
    )


def random_split(df: DataFrame, weights: list[float], seed: int = 42, key: str | list[str] | None = None) -> list[DataFrame]:
    """Disjoint parts in about these proportions. With `key` a row's part follows from its key alone, however the rows are dealt out."""
    if key is None:
        return df.randomSplit(weights, seed)
    parts = hash_split(df, key, weights, seed, "_part")
    return [parts.where(F.col("_part") == k).drop("_part") for k in range(len(weights))]


def hash_split(df: DataFrame, key: str | list[str], weights: list[float], seed: int = 42, out: str = "split") -> DataFrame:
    """Add `out` = 0, 1, … by hashed key, so a key keeps its side when the data changes."""
    key = as_list(key)
    need(df, *key)
    total, at, bounds = float(sum(weights)), 0.0, []
    for weight in weights[:-1]:
        at += weight / total
        bounds.append(round(at, 6))
    u = hash_fraction(*key, seed=seed)
    side = F.lit(len(bounds))
    for i in reversed(range(len(bounds))):
        side = F.when(u < F.lit(bounds[i]), F.lit(i)).otherwise(side)
    return df.withColumn(out, side.cast("int"))


def poisson_steps(mean: float, bits: int = 60) -> list[int]:
    """At each of these numbers below 2^bits an even draw gets one more copy: the inverse of the Poisson distribution."""
    steps, term, below, k = [], math.exp(-mean), 0.0, 0
    while k <= mean or term * (1 << bits) >= 1:
        below += term
        steps.append(min(int(below * (1 << bits)), 1 << bits))
        k += 1
        term *= mean / k
    return steps


def sample(
    df: DataFrame, fraction: float, replacement: bool = False, seed: int = 42, key: str | list[str] | None = None, hash: str = "md5"
) -> DataFrame:
    """A sample of about `fraction` of the rows, with or without replacement.

    With `key` a hash of the key decides, so the sample is the same whatever the partitioning and whatever else is in
    the table: a row stays if its draw is below the fraction, or comes as often as a Poisson variable of
    that mean says. Rows of one key share their draw.
    """
    if key is None:
        return df.sample(withReplacement=replacement, fraction=fraction, seed=seed)
    key = as_list(key)
    need(df, *key)
    if fraction < 0 or (fraction > 1 and not replacement):
        raise ValueError(f"fraction {fraction}")
    draw = hash_long(*key, F.lit("sample"), seed=seed, hash=hash)
    if not replacement:
        return df.where(draw < F.lit(int(fraction * (1 << 60))))
    rows = df.withColumn("_draw", draw)
    steps = F.array(*[F.lit(s).cast("bigint") for s in poisson_steps(fraction)])
    copies = F.size(F.filter(steps, lambda s: s <= F.col("_draw")))
    rows = rows.withColumn("_copies", copies).where("_copies > 0")
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).drop("_draw", "_copies", "_copy")


def preview(df: DataFrame, order: list, n: int, out: str = "position") -> DataFrame:
    """The first `n` rows in a total order (names or sort columns), with their positions 1 … n: a top-k, no global sort."""
    at = F.row_number().over(W.orderBy(*order))  # over n rows
    return df.orderBy(*order).limit(n).withColumn(out, at).orderBy(out)


def shuffle_rows(df: DataFrame, key: str | list[str], seed: int = 42) -> DataFrame:
    """Random but repeatable row order."""
    return df.orderBy(F.xxhash64(*as_list(key), F.lit(seed)))
