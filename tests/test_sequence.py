import re

import numpy as np
import pytest
from conftest import tuples
from pyspark.sql import functions as F

from flowfeat.operators import ids, sequence
from flowfeat.plans.jobs import SequenceParams, sequence_features


@pytest.fixture(scope="module")
def clicks(spark):
    rows = [(1, 12, 3), (1, 10, 1), (1, 11, 2), (2, 20, 1)]
    return spark.createDataFrame(rows, "user long, item long, time long")


def test_history(spark, clicks):
    got = sequence.history(clicks, "user", "time", [], ["item"])
    assert tuples(got.select("user", "item", "item_history")) == [(1, 11, [10]), (1, 12, [10, 11])]
    last = sequence.history(clicks, "user", "time", [], ["item"], max_targets=1)
    assert tuples(last.select("user", "item", "item_history")) == [(1, 12, [10, 11])]
    short = sequence.history(clicks, "user", "time", [], ["item"], history_len=1)
    assert tuples(short.select("item", "pos", "item_history")) == [(11, 1, [10]), (12, 2, [11])]


def brute(events, max_targets, history_len, min_history):
    by_user = {}
    for user, time, event, item, cat in sorted(tuple(r) for r in events.collect()):
        by_user.setdefault(user, []).append((time, event, item, cat))
    out = []
    for user, rows in by_user.items():
        for pos, (time, event, item, cat) in enumerate(rows):
            if pos < min_history or (max_targets is not None and pos < len(rows) - max_targets):
                continue
            before = rows[:pos] if history_len is None else rows[max(0, pos - history_len) : pos]
            out.append((user, time, pos, item, cat, [r[2] for r in before], [r[3] for r in before]))
    return sorted(out)


@pytest.mark.parametrize("limit", [20, 100, 10_000])
@pytest.mark.parametrize("max_targets,history_len,min_history", [(None, None, 1), (3, None, 1), (None, 4, 2), (5, 300, 1)])
def test_history_of_huge_users_equals_brute_force(spark, events, monkeypatch, limit, max_targets, history_len, min_history):
    monkeypatch.setattr(sequence, "BLOCK_ROWS", 16)
    got = sequence.history(
        events, "user", "time", "event", ["item", "cat"], max_targets, history_len, min_history, limit, parts=5
    )
    assert tuples(got) == brute(events, max_targets, history_len, min_history)


def test_history_does_not_depend_on_the_partition_count(spark, events):
    results = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(tuples(sequence.history(events, "user", "time", "event", ["item"], 10, limit=50)))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1]


def test_prepad_and_mask(spark):
    df = spark.createDataFrame([([1, 2, 3],), (list(range(1, 8)),), ([],)], "h array<long>")
    got = sequence.mask(sequence.prepad(df, "h", 5), "h").collect()
    assert [r["h_padded"] for r in got] == [[0, 0, 1, 2, 3], [3, 4, 5, 6, 7], [0] * 5]
    assert [r["h_mask"] for r in got] == [[0, 0, 1, 1, 1], [1] * 5, [0] * 5]


@pytest.mark.parametrize("start", [0, 1])
def test_negative_history(spark, start):
    items = spark.range(start, start + 9).select(F.col("id").alias("item"), (F.col("id") % 4 + 100).alias("cat"))
    rows = spark.createDataFrame([(1, [3, 1]), (2, [3, 1]), (3, [])], "row long, h array<long>")
    near = sequence.negative_history(rows, "h", items, 9, 2, key="row", start=start)
    far = sequence.negative_history(rows, "h", items, 9, 2, key="row", start=start, lookup_items=0)
    assert tuples(near) == tuples(far)
    lists = {r["row"]: r for r in near.collect()}
    assert lists[1]["noclk_item_list"] != lists[2]["noclk_item_list"]
    assert lists[3]["noclk_item_list"] == [] and lists[3]["noclk_cat_list"] == []
    for r in near.collect():
        assert [len(x) for x in r["noclk_item_list"]] == [2] * len(r["h"])
        for seen, drawn, cats in zip(r["h"], r["noclk_item_list"], r["noclk_cat_list"], strict=True):
            assert seen not in drawn and all(start <= d < start + 9 for d in drawn)
            assert cats == [d % 4 + 100 for d in drawn]
    with pytest.raises(ValueError):
        sequence.negative_history(rows, "h", items, 1)


def test_negative_history_of_awkward_rows(spark):
    """Repeated and missing keys, null and empty histories, gapped ids, categories of another type."""
    items = spark.createDataFrame([(i, f"c{i % 4}") for i in range(9) if i != 5], "item long, cat string")
    rows = [(1, [3, 1]), (1, [4]), (1, [4]), (None, [2, 2]), (None, [7]), (2, None), (3, [])]
    rows = spark.createDataFrame(rows, "row long, h array<long>")
    for keys in ((), "row"):
        for catalogue in (items, items.hint("merge")):
            got = sequence.negative_history(rows, "h", catalogue, 9, 2, key=keys).collect()
            assert len(got) == 7
            for r in got:
                if r["h"] is None:
                    assert r["noclk_item_list"] is None and r["noclk_cat_list"] is None
                    continue
                assert [len(x) for x in r["noclk_cat_list"]] == [2] * len(r["h"])
                want = [[None if d == 5 else f"c{d % 4}" for d in x] for x in r["noclk_item_list"]]
                assert r["noclk_cat_list"] == want


@pytest.mark.parametrize("most", [0, 10_000])
def test_categories_of_ids_that_repeat_or_are_missing(spark, monkeypatch, most):
    """The join by draws and the catalogue that meets the rows agree, whatever the ids."""
    monkeypatch.setattr(sequence, "MEETING_ITEMS", most)
    monkeypatch.setattr(sequence, "PACKED_ITEMS", 2)
    items = [(i, i % 4) for i in range(9) if i != 5] + [(3, 8), (3, None), (4, 0), (None, 7)]
    items = spark.createDataFrame(items, "item int, cat long")
    rows = [(1, [3, 1]), (1, [3, 1]), (2, [4, None, 6]), (3, None), (4, []), (5, [8] * 7)]
    rows = spark.createDataFrame(rows, "row long, h array<long>")
    cats = {}
    for i, c in items.collect():
        cats.setdefault(i, []).append(c)
    cats.pop(None)
    for r in sequence.negative_history(rows, "h", items, 9, 2, key="row", lookup_items=0).collect():
        if r["h"] is None:
            assert r["noclk_cat_list"] is None
            continue
        flat = [c for x in r["noclk_item_list"] for d in x for c in sorted(cats.get(d, [None]), key=lambda c: (c is not None, c))]
        assert r["noclk_cat_list"] == [flat[2 * k : 2 * k + 2] for k in range(len(r["h"]))]


def test_draws_of_a_large_catalogue_are_not_shuffled(spark):
    """The rows are dealt once, before their draws are made; the digest join dealt every draw."""
    items = spark.range(50).select(F.col("id").alias("item"), (F.col("id") % 4).alias("cat"))
    rows = spark.createDataFrame([(i, [i, i + 1]) for i in range(40)], "row long, h array<long>")
    got = sequence.negative_history(rows, "h", items, 50, 2, key="row", lookup_items=0)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "_digest" not in plan
    assert all(c == d % 4 for r in got.collect() for x, y in zip(r["noclk_item_list"], r["noclk_cat_list"]) for d, c in zip(x, y))


def test_rows_stay_where_they_are_for_a_large_catalogue(spark):
    """Only the catalogue is sent; it reaches every task that has rows, with the first of them."""
    items = spark.range(500).select(F.col("id").alias("item"), (F.col("id") % 7).alias("cat"))
    rows = spark.range(60, numPartitions=9).where("id % 20 < 13").select(F.col("id").alias("row"), F.expr("transform(sequence(0, id % 4), x -> int(x + id))").alias("h"))
    near = sequence.negative_history(rows, "h", items, 500, 2, key="row")
    far = sequence.negative_history(rows, "h", items, 500, 2, key="row", lookup_items=0)
    plan = far._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "Sort" not in plan
    assert tuples(near.select("row", "h", "noclk_item_list", "noclk_cat_list")) == tuples(far)


@pytest.mark.parametrize("start", [0, 1])
@pytest.mark.parametrize("n", [2, 50, 1 << 25])
def test_draws_of_batches_equal_the_expression(spark, n, start):
    import pyarrow as pa

    from flowfeat.functions.hashing import hash_long, other_than

    lists = [[start, n, None, 1], None, [], [n - 1] * 40, [-5, 7 * n]]
    rows = spark.createDataFrame(list(enumerate(lists)), "row long, h array<long>").withColumn("_base", hash_long("row"))
    draws = F.transform("h", lambda x, i: F.array(*[other_than(x, F.col("_base"), i * 3 + j, n, start) for j in range(3)]))
    want = rows.select("h", "_base", draws.alias("d")).collect()
    got = sequence._drawn(pa.array([r["h"] for r in want], pa.list_(pa.int64())), np.array([r["_base"] for r in want]), 3, n, start)
    assert got.to_pylist() == [r["d"] for r in want]


@pytest.fixture(scope="module")
def reviews(spark):
    rows = [(f"a{e % 7}", float(e % 5), f"u{e % 4}", 100 + (e * 11) % 40) for e in range(60)] + [("zz", 1.0, "u9", 5)]
    meta = [(f"a{i}", [["x", f"c{i % 3}"]] if i else None) for i in range(7)]
    return (
        spark.createDataFrame(rows, "asin string, overall double, reviewerID string, unixReviewTime long"),
        spark.createDataFrame(meta, "asin string, categories array<array<string>>"),
    )


def test_join_facts(spark, reviews):
    facts, meta = reviews
    got = sequence.join_facts(facts, meta)
    assert got.columns == ["overall", "unixReviewTime", "categories_index", "asin_index", "reviewerID_index"]
    assert got.count() == 60  # the item without metadata is dropped, and its reviewer gets no id
    assert sorted(r[0] for r in got.select("asin_index").distinct().collect()) == list(range(7))
    assert sorted(r[0] for r in got.select("reviewerID_index").distinct().collect()) == list(range(4))
    assert {r[0] for r in got.where("asin_index = 0").select("categories_index").collect()} == {0}
    doubled = sequence.join_facts(facts, meta.unionByName(meta.where("asin = 'a1'")))
    assert doubled.count() == 60 + facts.where("asin = 'a1'").count()


def test_pipeline(spark, reviews):
    facts, meta = reviews
    params = SequenceParams(his_len_max=6, negative_num=2, non_clk=3)
    rows = sequence_features(facts, meta, params, tie=["overall"]).collect()
    assert len(rows) == (60 - 4) * 3
    for r in rows:
        assert len(r["asin_history_padded"]) == len(r["cat_history_mask"]) == 6
        assert all(1 <= i <= 7 for i in r["asin_history"]) and len(r["asin_history"]) == r["pos"]
        assert len(r["noclk_item_list"]) == r["pos"] and all(len(x) == 3 for x in r["noclk_cat_list"])
        assert r["asin_history_mask"] == [int(x > 0) for x in r["asin_history_padded"]]
    capped = sequence_features(facts, meta, SequenceParams(his_len_min=3, max_targets=4, history_len=2), tie=["overall"])
    assert capped.agg(F.min("pos"), F.max(F.size("asin_history"))).first()[1] == 2
    assert capped.count() == 4 * 4 * 2
    hot = sequence_features(facts, meta, SequenceParams(group_rows=10, small_rows=0), tie=["overall"])
    assert tuples(hot.select("*")) == tuples(sequence_features(facts, meta, tie=["overall"]).select(*hot.columns))


def test_large_and_small_catalogues_agree(spark, reviews):
    _, meta = reviews
    assert tuples(ids.category_index(meta)) == tuples(ids.category_index(meta, small_rows=0, buckets=3))


@pytest.mark.parametrize("options", [{}, {"history_len": 7}, {"max_targets": 30}, {"max_targets": 9, "history_len": 25, "min_history": 3}])
def test_user_with_nine_tenths_of_the_rows(spark, monkeypatch, options):
    """Blocks of four events, two askers to a join key; every history equals the sorted events before it."""
    monkeypatch.setattr(sequence, "BLOCK_ROWS", 4)
    monkeypatch.setattr(sequence, "ASKING", 2)
    rows = [(1 if e % 10 else e % 3 + 2, (e * 37) % 101, e, (e * 13) % 50) for e in range(400)]
    df = spark.createDataFrame(rows, "user long, time long, event long, item long")
    want = []
    for user in {r[0] for r in rows}:
        mine = sorted(r[1:] for r in rows if r[0] == user)
        first = max(options.get("min_history", 1), len(mine) - options.get("max_targets", len(mine)))
        for p in range(first, len(mine)):
            back = mine[max(0, p - options.get("history_len", p)) : p]
            want.append((user, mine[p][0], p, mine[p][2], [x[2] for x in back]))
    got = sequence.history(df, "user", "time", "event", "item", limit=20, **options)
    assert sorted(map(tuple, got.select("user", "time", "pos", "item", "item_history").collect())) == sorted(want)


def test_hot_users_are_counted_once_and_single_blocks_are_not_sent_again(spark, events, monkeypatch):
    """User 1 has 200 events (four blocks), the others at most 40 (one block, all above the limit); block rows are grouped in one shuffle."""
    from flowfeat.operators import positions

    monkeypatch.setattr(sequence, "BLOCK_ROWS", 50)
    hot = positions.hot_keys(events, "user", 20)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in hot and "LogicalRDD" in hot
    rows = sequence.history(events, "user", "time", "event", ["item"], limit=1)
    want = []
    listed = sorted(events.select("user", "time", "event", "item").collect())
    for user in {r[0] for r in listed}:
        mine = [r for r in listed if r[0] == user]
        want += [(user, r[1], k, r[3], [x[3] for x in mine[:k]]) for k, r in enumerate(mine) if k]
    assert tuples(rows) == sorted(want)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()  # users of one block and of many go two ways
    assert re.search(r"_n#\d+L <= 50\)", plan) and re.search(r"_n#\d+L > 50\)", plan)
