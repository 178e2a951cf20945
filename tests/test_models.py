from threading import Barrier

import pytest
from conftest import tuples
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from flowfeat.operators import features, metrics, models, series
from flowfeat.plans import queries


def test_index_and_threshold_pipeline(spark, tmp_path):
    rows = [("hello", 0.7), ("Mango", 0.2), ("from", 0.8), ("Spark", 0.33), ("hello", 0.4), ("Spark", 0.22)]
    df = spark.createDataFrame(rows, "test_string string, test_double double")
    model = models.index_binarize().fit(df)
    assert model.stages[0].labels == ["Spark", "hello", "Mango", "from"]
    models.save_pipeline(model, str(tmp_path / "p"))
    new = spark.createDataFrame([("hello", 0.6), ("Mango", 0.2)], "test_string string, test_double double")
    got = models.load_pipeline(str(tmp_path / "p")).transform(new).select("test_string_index", "test_double_bin")
    assert tuples(got) == [(1.0, 1.0), (2.0, 0.0)]


def test_linear_fits(spark):
    pts = [(1.0, 2.0), (2.0, 1.0), (3.0, 5.0), (4.0, 0.0), (0.0, 3.0), (2.0, 2.0)]
    df = spark.createDataFrame([(a, b, 0.1 * a + 0.3 * b) for a, b in pts], "x double, y double, label double")
    model = models.linear(df, ["x", "y"])
    assert list(model.coefficients) == pytest.approx([0.1, 0.3]) and model.intercept == pytest.approx(0, abs=1e-9)
    grid = spark.range(100).select((F.col("id") % 10 / 10).alias("x"), (F.col("id") / 100).alias("y"))
    model = models.linear(grid.withColumn("label", 0.4 + 2 * (F.col("x") + F.col("y"))), ["x", "y"])
    assert list(model.coefficients) == pytest.approx([2, 2]) and model.intercept == pytest.approx(0.4)


@pytest.fixture(scope="module")
def ratings(spark):
    rows = [(u, i, float(1 + (u + i) % 5)) for u in range(30) for i in range(20) if (u * i) % 3 != 1]
    return spark.createDataFrame(rows, "userId int, movieId int, rating float")


def test_als(ratings):
    report = models.als_report(ratings, ratings, max_iter=8, rank=6).first()
    spread = ratings.agg(F.stddev_pop("rating")).first()[0]
    assert report["rmse"] < spread and 0 <= report["accuracy"] <= 1 and report["n"] == ratings.count()
    assert models.als_implicit(ratings, max_iter=2).itemFactors.count() == 20


def test_grid(ratings):
    table = models.grid(
        ratings, ratings, lambda rows, **s: models.als(rows, max_iter=2, **s), {"rank": [2, 3], "reg": [0.01, 0.1]}, label="rating"
    )
    assert sorted(tuple(r) for r in table.select("rank", "reg").collect()) == [(2, 0.01), (2, 0.1), (3, 0.01), (3, 0.1)]
    assert table.where("rmse is null").count() == 0


def test_grid_fits_side_by_side(ratings):
    both = Barrier(2, timeout=60)

    def fit(rows, **chosen):
        both.wait()  # breaks where a fit begins only when the one before has ended
        return models.als(rows, max_iter=2, **chosen)

    choices = {"rank": [2, 3]}
    got = models.grid(ratings, ratings, fit, choices, label="rating")
    one_by_one = models.grid(ratings, ratings, lambda rows, **s: models.als(rows, max_iter=2, **s), choices, label="rating", at_once=1)
    want = {r["rank"]: r["rmse"] for r in one_by_one.collect()}
    assert {r["rank"]: r["rmse"] for r in got.collect()} == pytest.approx(want, rel=1e-4) and set(want) == {2, 3}
    assert not ratings.storageLevel.useMemory and models.grid(ratings, ratings, fit, {"rank": []}) is None


def test_grid_query_cuts_one_stored_table(spark, tmp_path, monkeypatch):
    orders = [(None if o == 7 else o, o % 9, "1995-01-01") for o in [*range(60), 5, 5]]  # a null key and a key that repeats
    lines = [(None if n == 3 and o == 8 else o, (o * n) % 11, n, float(1 + (o + n) % 50), "R") for o in range(70) for n in range(4)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate string").write.parquet(f"{tmp_path}/orders.parquet")
    made = spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_returnflag string")
    made.selectExpr("*", "1L AS l_suppkey", "2.0D AS l_extendedprice").write.parquet(f"{tmp_path}/lineitem.parquet")
    parts = []

    def seen(train, test, *_, **__):
        for part in (train, test):
            parts.append(tuples(part))
            assert "InMemoryTableScan" in part._jdf.queryExecution().executedPlan().toString()

    monkeypatch.setattr(models, "grid", seen)
    queries.QUERIES["grid"](spark, str(tmp_path))
    want = [tuples(part.select("user", "item", "rating")) for part in queries._ratings_split(spark, str(tmp_path))]
    assert parts == want and min(map(len, want)) > 20


def test_classifiers(spark):
    df = spark.range(200).select(
        F.array((F.col("id") % 2).cast("float"), F.lit(1.0).cast("float")).alias("a"),
        F.array(F.lit(0.5).cast("float")).alias("b"),
        (F.col("id") % 2).cast("double").alias("label"),
    )
    rows = features.embedding_rows(df, "a", "b", size=3)
    model = models.dense_classifier(rows, layers=(3, 4, 2), max_iter=50)
    assert metrics.confusion(model.transform(rows)).first()["accuracy"] == 1.0
    arrays = features.concat_embeddings(df, "a", "b", 3)
    doc = models.doc_classifier(arrays)
    assert models.exact_match(doc.transform(rows)).first()[0] == 1.0


def test_wide_and_deep(spark):
    ratings = spark.range(300).select((F.col("id") % 20).alias("userId"), (F.col("id") % 7).alias("itemId"), (F.col("id") % 20 % 2 + 1).alias("label"))
    users = spark.range(20).select(
        F.col("id").alias("userId"), F.when(F.col("id") % 2 == 0, "F").otherwise("M").alias("gender"),
        (F.col("id") + 20).alias("age"), F.lit(3).alias("occupation"),
    )
    items = spark.range(7).select(F.col("id").alias("itemId"), F.when(F.col("id") > 0, "Drama").otherwise("?").alias("genres"))
    table = features.wide_deep(ratings, users, items)
    assert table.columns == ["userId", "itemId", "label", "gender", "age", "occupation", "genres", "age-gender"]
    assert {r[0] for r in table.select("genres").distinct().collect()} == {0, 5}
    model = models.wide_deep_classifier(table, max_iter=20)
    assert metrics.rating_report(model.transform(table)).first()["accuracy"] == 1.0


def test_forecast(spark):
    df = spark.range(120).select("id", (F.sin(F.col("id") / 5) * 3).alias("v"))
    windows = series.time_split(series.unroll(df, "id", "v", 8), "idx", 20)
    got = models.forecast(windows.where("split = 'train'"), windows.where("split = 'test'"))
    assert got.count() == 20 and got.agg(F.max("error")).first()[0] < 0.01


def test_load_or_fit(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0)], "x double, label double")
    job = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features"), LinearRegression()])
    path = str(tmp_path / "warm")
    first = models.load_or_fit(path, job, df)
    again = models.load_or_fit(path, job, df.withColumn("label", F.lit(0.0)))  # stored, so not fitted again
    assert first.stages[-1].coefficients[0] == pytest.approx(2) == again.stages[-1].coefficients[0]


def test_pair_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0)], "u double, i double, label double")
    row = features.pair_features(df, "u", "i", shuffle_seed=1).first()
    assert row["label"] == 1.0 and list(row["features"]) == [1.0, 2.0]
    with pytest.raises(Exception, match="negative feature"):
        features.pair_features(df.withColumn("u", F.lit(-1.0)), "u", "i").collect()


def test_blocks_of_a_fit_grow_with_its_ratings(spark, monkeypatch):
    """Ten blocks as Spark has them, the same fit, up to the bound; above it none holds more ratings, and all pairs known are predicted."""
    from pyspark.ml.recommendation import ALS

    assert [models.als_blocks(n) for n in (0, 80_000_000, 80_000_001, 173_000_000)] == [10, 10, 11, 22]
    rows = spark.range(600).select(
        (F.col("id") % 40).cast("int").alias("user"), (F.col("id") * 7 % 30).cast("int").alias("item"), (F.col("id") % 5 + 1).cast("float").alias("rating")
    )
    plain = ALS(rank=3, maxIter=2, regParam=0.01, userCol="user", itemCol="item", ratingCol="rating", seed=42).fit(rows)
    same = models.als(rows, "user", "item", rank=3, max_iter=2)
    assert sorted(map(str, same.userFactors.collect())) == sorted(map(str, plain.userFactors.collect()))
    more = models.als(rows, "user", "item", rank=3, max_iter=2, blocks=13)
    assert more.itemFactors.rdd.getNumPartitions() == 13 and more.transform(rows).count() == 600
    asked = []
    monkeypatch.setattr(models, "BLOCK_RATINGS", 200)
    monkeypatch.setattr(models, "grid", lambda train, test, fit, settings, **s: asked.append(fit(train, rank=2).itemFactors.rdd.getNumPartitions()))
    spark_rows = spark.createDataFrame([(o, o % 9, k, 1.0 * k, "R", 1.0, 1, o % 20) for o in range(900) for k in range(4)], "l_orderkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_extendedprice double, x int, l_partkey long")
    monkeypatch.setattr(queries.src, "table", lambda s, f, name: spark_rows if name == "lineitem" else spark.range(900).select(
        F.col("id").alias("o_orderkey"), (F.col("id") % 50).alias("o_custkey"), F.lit("1995-01-01").cast("timestamp").alias("o_orderdate")))
    queries.QUERIES["grid"](spark, "")
    assert 12 <= asked[0] <= 16  # about 2,880 ratings in blocks of 200
