import math

import pytest
from conftest import tuples
from pyspark.sql import functions as F

from flowfeat.functions import arrays, dates, scores
from flowfeat.functions.hashing import hash_fraction, hash_long, hash_uniform, other_than
from flowfeat.operators import features


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_score_expressions(spark):
    s = F.lit
    assert one(spark, scores.score_to_label(s(0.5), 0.5), scores.score_to_label(s(0.51), 0.5)) == (0.0, 1.0)
    assert one(spark, scores.score_to_bucket(s(1.0)), scores.score_to_bucket(s(0.57))) == (10, 5)
    assert one(spark, scores.to_decimal(s(2.0005), 3))[0] == 2.001
    assert one(spark, scores.above_one(s(1.0)), scores.above_one(s(1.5)), scores.add_one(s(0.1))) == (0.0, 1.0, 1.1)
    assert one(spark, scores.rank_gain(s(2)))[0] == pytest.approx(math.log(2) / math.log(3))
    assert one(spark, scores.share(s(1), s(0)))[0] is None


def test_cuts_below_equals_the_direct_count(spark):
    values = [i / 1000 for i in range(0, 1001)] + [i / 50.0 for i in range(51)] + [-0.5, 1.7]
    df = spark.createDataFrame([(v,) for v in values], "s double").select("s", scores.cuts_below("s").alias("n"))
    for score, n in df.collect():
        assert n == sum(score > i / 50.0 for i in range(1, 50)), score


def test_dates(spark):
    ts = F.lit("2018-05-23 00:00:00")
    time = dates.parse_timestamp(ts)
    got = one(spark, dates.day_of_week(time), dates.hour_of(time), F.month(time), F.dayofmonth(time))
    assert got == (3, 0, 5, 23)
    assert one(spark, dates.date_to_int(F.lit("07/04/2013 12:00:00 AM")))[0] == 20130704
    assert one(spark, *[dates.awake_flag(F.lit(h)) for h in (5, 6, 23)]) == (0, 1, 1)


def vec(*values):
    return F.array(*[F.lit(float(v)) for v in values])


def test_vectors(spark):
    assert one(spark, arrays.cosine(vec(1, 0), vec(1, 1)))[0] == pytest.approx(0.70710678)
    assert one(spark, arrays.abs_cosine(vec(1, 0), vec(-1, 0)))[0] == 1.0
    assert one(spark, arrays.dot(vec(1, 2), vec(3, 4)), arrays.dot_fixed(vec(1, 2), vec(3, 4), 2)) == (11.0, 11.0)
    assert one(spark, arrays.concat_vectors(vec(1), vec(2), 2))[0] == [1.0, 2.0]
    with pytest.raises(Exception, match="differ in length"):
        one(spark, arrays.dot(vec(1, 2), vec(1)))
    with pytest.raises(Exception, match="does not have 3"):
        one(spark, arrays.concat_vectors(vec(1), vec(2), 3))
    with pytest.raises(Exception, match="negative feature"):
        one(spark, arrays.all_non_negative(vec(1, -2)))


def test_nested_lists(spark):
    rows = [([["a", "b"], ["c"]],), (None,), ([],), ([[]],), ([["c"]],)]
    df = spark.createDataFrame(rows, "c array<array<string>>")
    assert [r[0] for r in df.select(arrays.last_category("c")).collect()] == ["b", None, None, None, "c"]
    flat = F.flatten(F.array(F.array(F.lit(0), F.lit(1), F.lit(2)), F.array(F.lit(1), F.lit(2), F.lit(3))))
    assert one(spark, flat)[0] == [0, 1, 2, 1, 2, 3]
    a = F.array(*[F.lit(v) for v in (1, 2, 3, 4, 2, 3, 6)])
    assert one(spark, F.size(F.array_distinct(a)), arrays.length_of(a), arrays.more_than_one(a)) == (5, 7, True)
    assert tuples(spark.range(1).select(F.explode(a).alias("v")).groupBy("v").count()) == [
        (1, 1), (2, 2), (3, 2), (4, 1), (6, 1)
    ]


def test_pad_and_mask(spark):
    short, long_ = F.array(*[F.lit(v) for v in (1, 2, 3)]), F.array(*[F.lit(v) for v in range(1, 8)])
    assert one(spark, arrays.pad(short, 5), arrays.pad(long_, 5)) == ([0, 0, 1, 2, 3], [3, 4, 5, 6, 7])
    assert one(spark, arrays.pad(short, 5, 9, "right"), arrays.pad(long_, 2, keep="first")) == ([1, 2, 3, 9, 9], [1, 2])
    assert one(spark, arrays.mask_of(arrays.pad(short, 5)))[0] == [0, 0, 1, 1, 1]
    assert one(spark, arrays.pad(F.array().cast("array<int>"), 2))[0] == [0, 0]


@pytest.mark.parametrize("hash", ["md5", "xxhash64"])
@pytest.mark.parametrize("start", [0, 1])
def test_draws_are_even_and_never_the_value(spark, hash, start):
    n, rows = 7, 21_000
    df = spark.range(rows).select(
        (F.col("id") % n + start).alias("v"), hash_long("id", hash=hash).alias("base")
    )
    df = df.select("v", *[other_than(F.col("v"), F.col("base"), k, n, start).alias(f"d{k}") for k in (0, 1, 2)])
    for k in (0, 1, 2):
        counts = df.groupBy("v", f"d{k}").count().collect()
        assert all(v != d and start <= d < start + n for v, d, _ in counts)
        assert len(counts) == n * (n - 1)
        assert all(abs(c - 500) < 130 for _, _, c in counts)
    same = df.where("d0 - v = d1 - v or d1 = d2").count()
    assert same < rows * 0.4  # two draws agree no more often than independent ones would
    wide = spark.range(1000).select(other_than(F.col("id"), hash_long("id"), 0, 1 << 30, 0).alias("d"))
    assert wide.agg(F.max("d")).first()[0] > 1 << 29
    with pytest.raises(ValueError):
        other_than(F.lit(0), F.lit(1), 0, 1)


def test_uniform_hash(spark):
    df = spark.range(10_000).select(hash_uniform("id", n=10).alias("u"), hash_fraction("id").alias("f"))
    counts = [r[1] for r in df.groupBy("u").count().collect()]
    assert len(counts) == 10 and all(abs(c - 1000) < 150 for c in counts)
    low, high = df.agg(F.min("f"), F.max("f")).first()
    assert 0 <= low and high < 1
    with pytest.raises(ValueError):
        hash_uniform("id", n=3, hash="none")


def test_vocabulary_codes(spark):
    df = spark.createDataFrame([("F",), ("M",), ("?",), (None,)], "g string")
    assert [r[0] for r in df.select(features.vocab_code("g", features.GENDERS)).collect()] == [1, 2, 0, 0]
    buckets = spark.range(500).select(features.cross_bucket("id", F.lit("F")).alias("b")).agg(F.min("b"), F.max("b")).first()
    assert 0 <= buckets[0] and buckets[1] < 100
