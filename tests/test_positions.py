import pytest
from conftest import tuples
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowfeat.operators import ids, positions


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_range_numbering_equals_the_global_row_number(spark, events, parts):
    want = tuples(events.select("event", (F.row_number().over(W.orderBy("time", "event")) - 1).alias("i")))
    got = positions.global_positions(events.select("event", "time"), ["time", "event"], "i", small_rows=0, parts=parts)
    assert tuples(got.select("event", "i")) == want


def test_numbering_needs_no_stored_table(spark, monkeypatch):
    """Borders from a sample with more rows than are held, nulls and falling columns included; nothing is checkpointed."""
    monkeypatch.setattr(positions, "SAMPLE_ROWS", 64)
    monkeypatch.setattr("pyspark.sql.DataFrame.checkpoint", None)
    rows = [((i * 7919) % 1000 if i % 5 else None, i % 3, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "a long, b long, c long").repartition(5)
    for order in (["a", "c"], [F.desc("a"), F.asc("c")], [F.asc_nulls_last("a"), F.desc_nulls_first("b"), F.asc("c")], ["b", "a", F.desc("c")]):
        want = tuples(df.select("c", (F.row_number().over(W.orderBy(*order)) - 1).alias("i")))
        for parts in (7, 300):
            got = positions.global_positions(df, order, "i", small_rows=0, parts=parts)
            assert tuples(got.select("c", "i")) == want
        at = F.row_number().over(W.partitionBy("b").orderBy(*order)) - 1
        got = positions.group_positions(df, "b", order, "i", limit=50, parts=9)
        assert tuples(got.select("c", "i")) == tuples(df.select("c", at.alias("i")))
    borders = positions.Borders(df, ["c"])
    assert 1500 < borders.rows < 6000
    sizes = [r["count"] for r in df.withColumn("p", borders.cut(10)).groupBy("p").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 1000


def test_falling_order_and_start(spark, events):
    order = [F.desc("time"), F.asc("event")]
    small = positions.global_positions(events, order, "i", start=5)
    large = positions.global_positions(events, order, "i", start=5, small_rows=0, parts=4)
    assert tuples(small.select("event", "i")) == tuples(large.select("event", "i"))
    assert small.agg(F.min("i")).first()[0] == 5


@pytest.mark.parametrize("limit", [10, 100, 10_000])
def test_positions_inside_keys_with_a_hot_key(spark, events, limit):
    at = F.row_number().over(W.partitionBy("user").orderBy("time", "event")) - 1
    want = tuples(events.select("event", at.alias("i")))
    got = positions.group_positions(events, "user", ["time", "event"], "i", limit=limit, parts=8)
    assert tuples(got.select("event", "i")) == want


def test_hot_keys_and_split_keep_every_row(spark, events):
    hot = positions.hot_keys(events, "user", 100)
    assert tuples(hot) == [(1,)]
    cold, large = positions.split_hot(events, "user", 100)
    assert cold.count() + large.count() == events.count() and large.select("user").distinct().count() == 1
    assert positions.hot_keys(events, "user", 1000) is None
    with_null = events.withColumn("user", F.when(F.col("user") > 1, F.col("user")))
    cold, large = positions.split_hot(with_null, "user", 100)
    assert large.where("user is null").count() == large.count() == 200


def test_sizes_of_hot_keys(spark, events):
    placed = positions.hot_positions(events, "user", ["time", "event"], "i", parts=8, size_out="n")
    sizes = dict(tuples(events.groupBy("user").count()))
    assert all(n == sizes[u] for u, n in tuples(placed.select("user", "n")))


def test_dense_index(spark):
    df = spark.createDataFrame([("z",), ("x",), ("y",), ("x",), (None,)], "k string")
    assert tuples(ids.dense_index(df, "k")) == [("x", 0), ("y", 1), ("z", 2)]
    many = spark.range(3000).select(F.concat(F.lit("k"), (F.col("id") % 1000).cast("string")).alias("k"))
    assert tuples(ids.dense_index(many, "k", start=1)) == tuples(ids.dense_index(many, "k", start=1, small_rows=0, buckets=6))


def test_categories(spark):
    rows = [("p", [["a", "b"], ["c"]]), ("q", None), ("r", [["c"]]), ("s", []), ("t", [[]])]
    meta = spark.createDataFrame(rows, "asin string, categories array<array<string>>")
    dictionary = ids.category_index(meta)
    assert tuples(dictionary) == [("a", 1), ("b", 2), ("c", 3)]
    assert tuples(ids.index_categories(meta, dictionary, "asin")) == [("p", 2), ("q", 0), ("r", 3), ("s", 0), ("t", 0)]


def test_frequency_index(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",), (None,)], "n string")
    got = ids.frequency_index(df, "n", {"n": 1})
    assert {r["n"]: r["n_index"] for r in got.collect()} == {"c": 1, "a": 2, "b": 3, None: None}
    assert got.count() == 5


def test_item_categories_takes_the_smallest(spark):
    df = spark.createDataFrame([(1, 5), (1, 3), (2, 4)], "i long, c long")
    assert tuples(ids.item_categories(df, "i", "c")) == [(1, 3), (2, 4)]


def test_missing_columns_are_named(spark, events):
    with pytest.raises(ValueError, match="nope"):
        ids.dense_index(events, "nope")


def test_dictionaries_read_their_input_once(spark):
    """Numbering reads the values up to three times; the table behind them is not computed again."""
    from flowfeat.operators import ids

    made = ids.dense_index(spark.sql("SELECT IF(id % 3 = 0, NULL, id % 10) AS v FROM range(100)"), "v", small_rows=0, buckets=2)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Range" not in plan and "LogicalRDD" in plan
    assert sorted(map(tuple, made.collect())) == [(v, v) for v in range(10)]
