import math

import pytest
from conftest import tuples
from pyspark.sql import functions as F

from flowfeat.operators import sampling


def test_negatives_per_row(spark):
    df = spark.createDataFrame([(1, 3, "a"), (2, 0, "b")], "row long, item long, other string")
    got = sampling.negatives_per_row(df, "item", 5, 2, key="row")
    assert got.columns == ["row", "other", "item", "label"]
    rows = tuples(got)
    assert len(rows) == 6 and [r for r in rows if r[3] == 1] == [(1, "a", 3, 1), (2, "b", 0, 1)]
    for row, _, item, label in rows:
        assert label == 1 or (0 <= item < 5 and item != {1: 3, 2: 0}[row])
    assert tuples(sampling.negatives_per_row(df, "item", 5, 2, key="row")) == rows
    renamed = sampling.negatives_per_row(df, "item", 5, 1, label_col="y", out_col="itemID", key="row")
    assert renamed.columns == ["row", "other", "itemID", "y"]
    with pytest.raises(ValueError):
        sampling.negatives_per_row(df, "item", 1)


def test_options_of_row_negatives(spark, events):
    cats = spark.range(50).select(F.col("id").alias("item"), (F.col("id") * 2).alias("cat"))
    rows = sampling.negatives_per_row(
        events.select("user", "event", "item", "cat"), "item", 50, 3, key="event", exclude_seen=True, user="user",
        categories=cats, category="cat",
    )
    seen = events.select("user", "item").distinct()
    assert rows.where("label = 0").join(seen, ["user", "item"]).count() == 0
    assert rows.where("label = 1").count() == 600 and rows.where("cat <> item * 2").count() == 0
    everything = sampling.negatives_per_row(events, "item", 50, 3, key="event")
    kept = everything.where("label = 0").join(seen, ["user", "item"], "left_anti").count()
    assert rows.where("label = 0").count() == kept
    with pytest.raises(ValueError):
        sampling.negatives_per_row(events, "item", 50, exclude_seen=True)


def test_pair_negatives(spark):
    df = spark.createDataFrame([(float(u), float(i), 1.0) for u in range(1, 21) for i in range(1, 11)], "u double, i double, label double")
    df = df.where("i <= 5 or u = 20")
    got = sampling.negatives_by_pair(df, "u", "i", amplifier=20)
    pairs = [(u, i) for u, i, _ in tuples(got)]
    assert len(set(pairs)) == len(pairs) and {label for *_, label in tuples(got)} == {0.0}
    known = {(int(u), int(i)) for u, i, _ in tuples(df)}
    assert not known & set(pairs)
    assert {u for u, _ in pairs} == set(range(1, 20)) and {i for _, i in pairs} == set(range(6, 11))
    both = sampling.negatives_by_pair(df, "u", "i", include_positives=True, pos_label=2)
    assert both.where("label = 2.0").count() == df.count()
    with pytest.raises(ValueError):
        sampling.negatives_by_pair(df.limit(0), "u", "i")


@pytest.mark.parametrize("amplifier, ids", [(1, 1 << 16), (3, 4), (2, 1), (500, 7)])
def test_exact_negatives(spark, amplifier, ids):
    rows = [(float(u), float(i), 1.0) for u in range(1, 31) for i in range(1, 21) if (u * i) % 3 == 0 or u == 30]
    rows += rows[:50] + [(7.0, float(i), 1.0) for i in range(1, 21)]
    df = spark.createDataFrame(rows, "u double, i double, label double")
    known = {(int(u), int(i)) for u, i, _ in rows}
    free = 30 * 20 - len(known)
    pairs = [(u, i) for u, i, _ in tuples(sampling.exact_negatives(df, "u", "i", amplifier, ids=ids))]
    assert len(pairs) == len(set(pairs)) == min(amplifier * len(rows), free)  # exactly as many as asked
    assert not known & set(pairs) and all(1 <= u <= 30 and 1 <= i <= 20 for u, i in pairs)
    assert pairs == [(u, i) for u, i, _ in tuples(sampling.exact_negatives(df.repartition(7), "u", "i", amplifier, ids=ids))]
    both = sampling.exact_negatives(df, "u", "i", amplifier, include_positives=True, pos_label=2, ids=ids)
    assert both.where("label = 2.0").count() == len(rows)


def test_exact_negatives_are_even(spark):
    """Every free pair is drawn about equally often, whichever the user, and other seeds draw other pairs."""
    df = spark.createDataFrame([(u, i, 1.0) for u in range(1, 5) for i in range(1, 11) if i <= u * 2], "u long, i long, label double")
    hits = {}
    for seed in range(60):
        for u, i, _ in sampling.exact_negatives(df, "u", "i", seed=seed, n_items=12).collect():
            hits[u, i] = hits.get((u, i), 0) + 1
    expected = 60 * df.count() / (4 * 12 - df.count())
    assert len(hits) == 4 * 12 - df.count() and all(expected * 0.5 < n < expected * 1.5 for n in hits.values())
    with pytest.raises(ValueError):
        sampling.exact_negatives(df.limit(0), "u", "i")


def test_mix_and_uniqueness(spark):
    df = spark.createDataFrame([(1, 1, 1.0), (2, 2, 1.0)], "u long, i long, label double")
    mixed = sampling.mix_negatives(df, "u", "i", n_users=3, n_items=3)
    pairs = [(u, i) for u, i, _ in tuples(mixed)]
    assert len(set(pairs)) == len(pairs) and {(1, 1), (2, 2)} <= set(pairs)
    with pytest.raises(ValueError, match="duplicate"):
        sampling.mix_negatives(df.unionByName(df), "u", "i")


def test_splits_and_samples(spark):
    df = spark.range(10_000)
    first = sampling.hash_split(df, "id", [0.8, 0.1, 0.1])
    sizes = dict(tuples(first.groupBy("split").count()))
    assert abs(sizes[0] - 8000) < 200 and abs(sizes[1] - 1000) < 150 and sum(sizes.values()) == 10_000
    more = sampling.hash_split(spark.range(12_000), "id", [0.8, 0.1, 0.1])
    assert more.join(first, ["id", "split"]).count() == 10_000  # membership is stable
    train, test = sampling.random_split(df, [0.8, 0.2])
    assert train.count() + test.count() == 10_000
    assert abs(sampling.sample(df, 0.2, True).count() - 2000) < 250
    shuffled = [r[0] for r in sampling.shuffle_rows(df.limit(100), "id").collect()]
    assert sorted(shuffled) == list(range(100)) != shuffled


def test_keyed_samples_repeat_whatever_the_partitioning(spark):
    df = spark.range(20_000)
    for options in ({"fraction": 0.3}, {"fraction": 0.3, "replacement": True}, {"fraction": 2.5, "replacement": True}):
        one = tuples(sampling.sample(df, key="id", **options))
        assert one == tuples(sampling.sample(df.repartition(13), key="id", **options))
        assert abs(len(one) - 20_000 * options["fraction"]) < 700
    times = [0] * 20_000
    for (i,) in tuples(sampling.sample(df, 1.0, True, key="id")):
        times[i] += 1
    shares = [times.count(k) / 20_000 for k in range(5)]
    assert all(abs(a - b) < 0.015 for a, b in zip(shares, [0.3679, 0.3679, 0.1839, 0.0613, 0.0153]))
    train, test = sampling.random_split(df, [0.8, 0.2], key="id")
    assert train.union(test).distinct().count() == 20_000 and train.join(test, "id").count() == 0
    assert tuples(test) == tuples(sampling.random_split(df.repartition(5), [0.8, 0.2], key="id")[1])
    with pytest.raises(ValueError):
        sampling.sample(df, 1.5, key="id")


def test_poisson_steps_are_the_distribution():
    steps = sampling.poisson_steps(0.7)
    below = 0.0
    for k, s in enumerate(steps[:10]):
        below += math.exp(-0.7) * 0.7**k / math.factorial(k)
        assert abs(s / 2**60 - below) < 1e-12
    assert sampling.poisson_steps(0.0)[0] == 2**60


def test_preview(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(50)], "a long, b long")
    got = [tuple(r) for r in sampling.preview(df, [F.desc("a"), F.asc("b")], 5).collect()]
    assert got == [(a, b, k + 1) for k, (a, b) in enumerate(sorted([(i % 7, i) for i in range(50)], key=lambda r: (-r[0], r[1]))[:5])]
    assert "TakeOrderedAndProject" in sampling.preview(df, ["b"], 5)._jdf.queryExecution().executedPlan().toString()


def test_exact_negatives_take_no_row_per_user_and_range(spark):
    """The rows that are made on the way grow with users and pairs, whatever the number of item ids."""
    df = spark.createDataFrame([(1, 3), (1, 900_000), (1, 5), (3, 1_000_000), (3, 1)], "u long, i long")
    known = df.withColumn("c", F.expr("(i - 1) div 4"))
    cells = sampling._cells_with_starts(known, 3)
    assert tuples(cells) == [(1, 0, 0, 0), (1, 1, 1, 3), (1, 224_999, 2, 5), (3, 0, 3, 0), (3, 249_999, 4, 1)]
    got = sampling.exact_negatives(df, "u", "i", 7, ids=4)
    assert tuples(got) == tuples(sampling.exact_negatives(df, "u", "i", 7))
    assert got.distinct().count() == 35 and got.join(df, ["u", "i"]).count() == 0
