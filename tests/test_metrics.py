import math

import pytest
from conftest import tuples
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from flowfeat.operators import metrics


@pytest.fixture(scope="module")
def five(spark):
    rows = [(1.0, 1.0), (0.0, 1.0), (1.0, 0.0), (0.0, 0.0), (1.0, 1.0)]
    return spark.createDataFrame(rows, "prediction double, label double")


def test_confusion(five):
    got = metrics.confusion(five).first()
    assert tuple(got) == (2, 1, 1, 1, 0.6, 0.667, 0.667, 0.583, 0.656)


def test_areas_equal_the_library_evaluators(spark, five):
    many = spark.range(1000).select(
        (F.col("id") % 3 == 0).cast("double").alias("prediction"), (F.col("id") % 4 == 0).cast("double").alias("label")
    )
    none = many.withColumn("prediction", F.lit(0.0))
    for df in (five, many, none):
        got = metrics.confusion(df, places=None).first()
        for name, metric in (("auroc", "areaUnderROC"), ("aupr", "areaUnderPR")):
            want = BinaryClassificationEvaluator(rawPredictionCol="prediction", metricName=metric).evaluate(df)
            assert got[name] == pytest.approx(want)
        report = metrics.binary_report(df, places=None).first()
        for name, metric in (("accuracy", "accuracy"), ("weighted_precision", "weightedPrecision"), ("weighted_recall", "weightedRecall")):
            assert report[name] == pytest.approx(MulticlassClassificationEvaluator(metricName=metric).evaluate(df))
        assert report["auroc"] == pytest.approx(got["auroc"])


def test_zero_denominators_give_null(spark):
    df = spark.createDataFrame([(0.0, 0.0)], "prediction double, label double")
    got = metrics.confusion(df).first()
    assert got["precision"] is None and got["recall"] is None and got["accuracy"] == 1.0


def test_pr_curve(spark):
    df = spark.createDataFrame([(0.01, 0.0), (0.5, 1.0), (0.99, 1.0)], "score double, label double")
    rows = {round(r["cut"], 2): (r["precision"], r["recall"]) for r in metrics.pr_curve(df).collect()}
    assert len(rows) == 49 and rows[0.02] == (1.0, 1.0) and rows[0.5] == (1.0, 0.5)
    for cut in (0.02, 0.5, 0.98):
        assert tuple(metrics.pr_at_cut(df, cut).first())[1:] == rows[cut]
    low = metrics.pr_curve(spark.createDataFrame([(0.01, 1.0)], "score double, label double")).collect()
    assert len(low) == 49 and all(r["precision"] is None and r["recall"] == 0.0 for r in low)


def test_pr_curve_equals_the_direct_form(spark):
    df = spark.range(2000).select(((F.col("id") * 37) % 101 / 100.0).alias("score"), (F.col("id") % 3 == 0).cast("double").alias("label"))
    rows = metrics.pr_curve(df).collect()
    assert [r["recall"] for r in rows] == sorted((r["recall"] for r in rows), reverse=True)
    data = [tuple(r) for r in df.collect()]
    for i, r in enumerate(rows, 1):
        above = [label for score, label in data if score > i / 50.0]
        assert r["precision"] == pytest.approx(sum(above) / len(above))


@pytest.fixture(scope="module")
def ranked(spark):
    rows = [(1.0, 0.9, 0.0), (1.0, 0.8, 1.0), (2.0, 0.7, 0.0)]
    return spark.createDataFrame(rows, "userIdIndex double, score double, label double")


def test_abs_rank_and_hit_ratio(ranked):
    assert tuples(metrics.user_mean_rank(ranked, 2)) == [(1.0, 2.0), (2.0, 3.0)]
    assert tuples(metrics.abs_rank(ranked, 2)) == [(2, 1), (3, 1)]
    gain = math.log(2) / math.log(3)
    assert tuples(metrics.user_hit_gain(ranked, 2)) == [(1.0, 1, pytest.approx(gain)), (2.0, 0, 0.0)]
    assert tuple(metrics.hit_ndcg(ranked, 2).first()) == (0.5, pytest.approx(gain / 2))
    assert tuples(metrics.unlabelled_users(ranked)) == [(2.0,)]
    given = ranked.withColumn("rank", F.lit(5))
    assert tuples(metrics.abs_rank(given, 5)) == [(5, 1), (6, 1)]


def test_ranks_with_ties_and_a_hot_user_equal_brute_force(spark):
    rows = [(1 if e % 3 == 0 else e % 11, ((e * 7) % 5) / 5.0 if e % 2 else 0.5, [0.0, 1.0, None][e % 3 if e % 4 else 1]) for e in range(500)]
    df = spark.createDataFrame(rows, "userIdIndex long, score double, label double")
    k = 6
    by_user = {}
    for u, s, y in rows:
        by_user.setdefault(u, []).append((s, y))
    mean, gain = {}, {}
    for u, cells in by_user.items():
        top = [(1 + sum(s2 > s for s2, _ in cells), y) for s, y in cells]
        top = [(r, y) for r, y in top if r <= k]
        hits = [r for r, y in top if y == 1.0]
        mean[u] = sum(hits) / len(hits) if hits else k + 1.0
        label = max((y for _, y in top if y is not None), default=None)
        rank = min(r for r, y in top if y == label)
        gain[u] = (0 if label in (None, 0) else 1, math.log(2) / math.log(rank + 1) if label == 1 else 0.0)
    assert tuples(metrics.user_mean_rank(df, k)) == [(u, pytest.approx(m)) for u, m in sorted(mean.items())]
    got = {u: (h, pytest.approx(g)) for u, h, g in tuples(metrics.user_hit_gain(df, k))}
    assert got == gain
    assert metrics.top_k(df, k).count() == sum(
        sum(1 + sum(s2 > s for s2, _ in c) <= k for s, _ in c) for c in by_user.values()
    )


def test_score_buckets(spark):
    df = spark.createDataFrame([(0.05, 1.0), (0.55, 1.0), (0.59, 1.0), (0.9, 0.0)], "score double, label double")
    assert tuples(metrics.score_buckets(df)) == [(0, 1, pytest.approx(1 / 3)), (5, 2, pytest.approx(2 / 3))]


def test_rating_reports(spark):
    df = spark.createDataFrame([(1.4, 1.0), (2.6, 3.0), (4.0, 5.0)], "prediction double, label double")
    got = metrics.rating_report(df).first()
    assert got["mse"] == pytest.approx((0.16 + 0.16 + 1) / 3) and got["rmse"] == pytest.approx(got["mse"] ** 0.5)
    assert got["accuracy"] == 0.0 and got["n"] == 3
    whole = metrics.rating_report(df, whole=True, total=4).first()
    assert whole["accuracy"] == 0.5 and whole["mse"] == pytest.approx(1 / 3)
    assert tuple(metrics.mae(df).first()) == (pytest.approx((0.4 + 0.4 + 1) / 3), 0.0)
    listed = metrics.residuals(df.withColumn("idx", F.lit(7)))
    assert listed.columns == ["idx", "label", "prediction", "error"] and listed.first()["error"] == pytest.approx(0.4)
