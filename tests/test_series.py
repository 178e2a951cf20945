import pytest
from conftest import tuples
from pyspark.sql import functions as F

from flowfeat.operators import series
from flowfeat.plans import jobs


@pytest.fixture(scope="module")
def ten(spark):
    return spark.createDataFrame([(i, float(i)) for i in range(1, 11)], "t long, v double")


def test_scaling(spark, ten):
    got = [r["v"] for r in series.standard_scale(ten, "v").orderBy("t").collect()]
    assert got[0] == pytest.approx(-1.56670, abs=1e-5) and got[-1] == pytest.approx(1.56670, abs=1e-5)
    flat = series.standard_scale(ten.withColumn("v", F.lit(3.0)), "v")
    assert {r["v"] for r in flat.collect()} == {0.0}
    holes = series.standard_scale(ten.withColumn("v", F.when(F.col("t") > 1, F.col("v"))), "v")
    assert holes.where("t = 1").first()["v"] is None


def test_calendar(spark):
    df = spark.createDataFrame([("2018-05-23 00:00:00",), ("2018-05-23 06:30:00",)], "ts string")
    got = tuples(series.calendar(df, "ts").drop("ts"))
    assert got == [(0, 0, 3, 5, 23), (6, 1, 3, 5, 23)]


def flat(rows):
    return [(i, [x[0] for x in f], *rest) for i, f, *rest in rows]


def test_unroll(ten):
    got = flat(tuples(series.unroll(ten, "t", "v", 3)))
    assert got == [(i, [i + 1.0, i + 2.0, i + 3.0], i + 4.0) for i in range(7)]
    far = flat(tuples(series.unroll(ten, "t", "v", 3, step=4)))
    assert len(far) == 10 - 3 - 4 + 1 and far[0] == (0, [1.0, 2.0, 3.0], 7.0)
    assert series.unroll(ten, "t", "v", 10).count() == 0


def test_unlabelled_windows(ten):
    got = flat(tuples(series.unroll(ten, "t", "v", 3, labelled=False, keep_partial=True)))
    assert [i for i, _ in got] == list(range(7)) and got[-2:] == [(5, [6.0, 7.0]), (6, [7.0])]
    full = flat(tuples(series.unroll(ten, "t", "v", 3, labelled=False)))
    assert full == [g for g in got if len(g[1]) == 3]
    short = flat(tuples(series.unroll(ten.where("t <= 4"), "t", "v", 3, labelled=False, keep_partial=True)))
    assert short == [(0, [1.0, 2.0, 3.0]), (1, [2.0, 3.0]), (2, [3.0])]


@pytest.mark.parametrize("small_rows", [0, 10_000])
@pytest.mark.parametrize("chunk", [8, 33, 5000])
def test_chunked_windows_equal_the_whole_series(spark, chunk, small_rows):
    df = spark.range(300).select(((F.col("id") * 77) % 300).alias("t")).withColumn("v", F.col("t") * 1.5)
    got = series.unroll(df, "t", ["v", "t"], 6, 2, chunk=chunk, small_rows=small_rows)
    want = [(i, [[1.5 * j, float(j)] for j in range(i, i + 6)], 1.5 * (i + 7)) for i in range(300 - 7)]
    assert tuples(got) == want
    tail = series.unroll(df, "t", "v", 6, labelled=False, keep_partial=True, chunk=chunk, small_rows=small_rows)
    assert flat(tuples(tail)) == [(i, [1.5 * j for j in range(i, min(i + 6, 294))]) for i in range(294)]


@pytest.mark.parametrize("small_rows", [20, 10_000])
def test_keyed_windows(spark, events, small_rows):
    got = series.unroll(events, ["time", "event"], "item", 3, 1, key="user", chunk=16, small_rows=small_rows)
    by_user = {}
    for user, _, _, item, _ in sorted(tuple(r) for r in events.collect()):
        by_user.setdefault(user, []).append(float(item))
    want = [
        (u, i, [[x] for x in v[i : i + 3]], v[i + 3]) for u, v in by_user.items() for i in range(len(v) - 3)
    ]
    assert tuples(got) == sorted(want)
    loose = series.unroll(events, ["time", "event"], "item", 3, key="user", labelled=False, chunk=16, small_rows=small_rows)
    assert loose.count() == sum(max(len(v) - 3, 3) - 2 for v in by_user.values())


def test_strided(spark):
    df = spark.createDataFrame([(i, i) for i in range(1, 9)], "t long, v long")
    assert tuples(series.strided(df, "t", "v", 3)) == [(0, [1, 2, 3, 4]), (3, [4, 5, 6, 7])]
    keyed = df.withColumn("k", F.lit("a")).unionByName(df.where("t < 4").withColumn("k", F.lit("b")))
    assert tuples(series.strided(keyed, "t", "v", 2, key="k", small_rows=1)) == [
        ("a", 0, [1, 2, 3]), ("a", 2, [3, 4, 5]), ("a", 4, [5, 6, 7]), ("b", 0, [1, 2, 3])
    ]


def test_split(ten):
    windows = series.unroll(ten, "t", "v", 3)
    got = dict(tuples(series.time_split(windows, "idx", 2).select("idx", "split")))
    assert [i for i, s in got.items() if s == "test"] == [5, 6] and len(got) == 7
    gap = dict(tuples(series.time_split(windows, "idx", 2, gap=3, n=7).select("idx", "split")))
    assert sorted(gap) == [0, 1, 5, 6]


def test_flat_windows_and_means(spark, ten):
    row = series.flat_windows(series.unroll(ten, "t", ["v", "v"], 3)).where("idx = 0").first()
    assert (row["steps"], row["width"], row["flat"]) == (3, 2, [1.0, 1.0, 2.0, 2.0, 3.0, 3.0])
    df = spark.createDataFrame([([1.0, 2.0, 3.0],), ([4.0, 5.0, 6.0],)], "a array<double>")
    assert tuples(series.column_means(df, "a")) == [(0, 2.5), (1, 3.5), (2, 4.5)]


def test_taxi_and_sensor_jobs(spark):
    df = spark.range(200).select(
        F.date_format(F.timestamp_seconds(F.lit(1_400_000_000) + F.col("id") * 1800), "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        (F.col("id") % 9).cast("float").alias("value"),
    )
    rows = jobs.taxi_windows(df, length=10, test_size=30)
    assert dict(tuples(rows.groupBy("split").count())) == {"test": 30, "train": 160}
    first = rows.where("idx = 0").first()
    assert len(first["feature"]) == 10 and len(first["feature"][0]) == 3
    sensors = jobs.sensor_windows(df.withColumnRenamed("timestamp", "ts"), length=50, test_size=40)
    assert dict(tuples(sensors.groupBy("split").count())) == {"test": 40, "train": 110}
