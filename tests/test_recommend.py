import numpy as np
import pytest
from conftest import tuples
from pyspark.sql import functions as F

from flowfeat.operators import models, products, recommend

U, I = "userIdIndex", "itemIdIndex"


@pytest.fixture(scope="module")
def lists(spark):
    users = spark.range(12).select(F.col("id").alias(U))
    items = spark.range(40).select(F.col("id").alias(I), (F.col("id") % 3).alias("boost"))
    # user 0 has a third of all interactions, with repeats; user 11 has seen everything
    pairs = [(0, i % 20) for i in range(60)] + [(u, (u * 7 + k) % 40) for u in range(1, 11) for k in range(8)]
    pairs += [(11, i) for i in range(40)]
    return users, items, spark.createDataFrame(pairs, f"{U} long, {I} long")


def test_candidates_small(spark):
    users, items = spark.createDataFrame([(1,), (2,)], f"{U} long"), spark.createDataFrame([(10,), (11,)], f"{I} long")
    seen = spark.createDataFrame([(1, 10)], f"{U} long, {I} long")
    assert tuples(recommend.unseen_candidates(users, items, seen)) == [(1, 11), (2, 10), (2, 11)]


@pytest.mark.parametrize("block", [4, 512])
def test_candidates_equal_brute_force(lists, block):
    users, items, seen = lists
    known = set(tuples(seen))
    want = sorted((u, i) for u in range(12) for i in range(40) if (u, i) not in known)
    assert tuples(recommend.unseen_candidates(users, items, seen, block_items=block)) == want


@pytest.mark.parametrize("block", [4, 512])
@pytest.mark.parametrize("n", [1, 5, 100])
def test_pruned_top_n_equals_brute_force(lists, block, n):
    users, items, seen = lists
    known = set(tuples(seen))

    def score(u, i):  # many ties
        return ((u * 5 + i * 3) % 7 + i % 3) / 10.0

    want = []
    for u in range(12):
        best = sorted((-score(u, i), i) for i in range(40) if (u, i) not in known)[:n]
        want += [(u, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    got = recommend.top_n_unseen(
        users, items, seen, lambda i: ((F.col(U) * 5 + i[I] * 3) % 7 + i.boost) / F.lit(10.0), n, item_cols=["boost"],
        block_items=block, as_array=False,
    )
    assert tuples(got) == sorted(want)


@pytest.mark.parametrize("n", [1, 3])
def test_pairs_meet_in_cells(spark, lists, monkeypatch, n):
    """Many cells; scores that are all equal but for a few; no row per user and block of items before the cells."""
    monkeypatch.setattr(recommend, "GROUP_ITEMS", 7)
    monkeypatch.setattr(recommend, "CELL_USERS", 2)
    monkeypatch.setattr(recommend, "MOST_TOPS", 6)
    users, items, seen = lists
    known = set(tuples(seen))
    want = [(u, i) for u in range(12) for i in range(40) if (u, i) not in known]
    got = recommend.unseen_candidates(users, items, seen, block_items=3)
    assert tuples(got) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "_cell" in plan and "explode(sequence(0, 13" not in plan  # 14 blocks
    best = {u: sorted((-float((u + i) % 11 == 0), i) for v, i in want if v == u)[:n] for u in range(12)}
    got = recommend.top_n_unseen(
        users, items, seen, lambda i: F.when((F.col(U) + i[I]) % 11 == 0, 1.0).otherwise(0.0), n, block_items=1, as_array=False
    )
    assert tuples(got) == sorted((u, r + 1, i, -s) for u, rows in best.items() for r, (s, i) in enumerate(rows))


@pytest.mark.parametrize("n, tops, group", [(1, 512, 1 << 16), (3, 2, 4), (60, 512, 1 << 16)])
def test_classes_share_their_lists(spark, lists, monkeypatch, n, tops, group):
    """Users who have seen everything or much, repeated rows, missing ids and values, equal scores in several classes: as without classes."""
    monkeypatch.setattr(recommend, "CLASS_ITEMS", 1)
    monkeypatch.setattr(recommend, "CLASS_TOPS", tops)
    monkeypatch.setattr(recommend, "GROUP_ITEMS", group)
    users, items, seen = lists
    users = users.union(users.limit(3)).union(spark.createDataFrame([(None,), (77,)], f"{U} long"))
    items = items.union(items.limit(9)).union(spark.createDataFrame([(None, 1), (55, None), (56, 2)], f"{I} long, boost long"))
    seen = seen.union(spark.createDataFrame([(None, 3), (2, None), (500, 1), (3, 500)], f"{U} long, {I} long"))
    known = {tuple(r) for r in seen.collect()}
    ids = [(i, i % 3) for i in range(40)] + [(56, 2)]

    def score(u, i, b):
        return (u % 4 * 5 + (i * 3 + b) % 7) % 11 // 2 / 10.0

    want = []
    for u in [*range(12), 77]:
        best = sorted((-score(u, i, b), i) for i, b in ids if (u, i) not in known)[:n]
        want += [(u, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    part = (F.col(I) * 3 + F.col("boost")) % 7
    scored = []
    got = recommend.top_n_unseen(
        users, items, seen, lambda i: scored.append(i) or F.floor((F.col(U) % 4 * 5 + (i[I] * 3 + i.boost) % 7) % 11 / 2) / F.lit(10.0), n,
        item_cols=["boost"], as_array=False, alike=(F.col(U) % 4, part),
    )
    assert tuples(got) == sorted(want) and scored


def test_classes_are_scored_once(spark):
    """4,000 x 3,000 ids in 5 x 7 classes: the pairs are never looked at one by one."""
    from flowfeat.plans import queries

    users, items = spark.range(4000).select(F.col("id").alias(U)), spark.range(3000).select(F.col("id").alias(I))
    seen = spark.range(9000).select((F.col("id") % 4000).alias(U), (F.col("id") * 7 % 3000).alias(I))
    calls = spark.sparkContext.accumulator(0)

    @F.pandas_udf("double")
    def score(u, i):
        import pandas as pd

        calls.add(len(u))
        return pd.Series((u % 5 * 2 + i % 7) % 11, dtype="float64")

    got = recommend.top_n_unseen(users, items, seen, lambda i: score(F.col(U), i[I]), 2, as_array=False, alike=(F.col(U) % 5, F.col(I) % 7))
    assert got.count() == 8000 and 0 < calls.value < 1000
    # remainders decide a remainder of sums only where no part is below zero
    assert queries._remainders(users, items, F.col(U) * 3, F.col(I), 7) is not None
    assert queries._remainders(users, items, F.col(U) * 3, F.col(I) - 1, 7) is None
    assert queries._remainders(users, items.where("false"), F.col(U) * 3, F.col(I), 7) is not None


@pytest.mark.parametrize("n", [1, 4, 60])
def test_factor_top_n_equals_brute_force(spark, lists, n):
    users, items, seen = lists
    known = set(tuples(seen))
    rng = np.random.default_rng(3)
    fu, fi = rng.integers(-2, 3, (12, 3)).astype(float), rng.integers(-2, 3, (40, 3)).astype(float)
    left = spark.createDataFrame([(u, fu[u].tolist()) for u in range(12)], f"{U} int, features array<float>")
    right = spark.createDataFrame([(i, fi[i].tolist()) for i in range(40)], f"{I} int, features array<float>")
    want = []
    for u in range(12):
        best = sorted((-float(fu[u] @ fi[i]), i) for i in range(40) if (u, i) not in known)[:n]
        want += [(u, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    got = recommend.top_n_factors(left, right, seen, n, block_users=3, block_items=8, as_array=False)
    assert [(u, r, i, pytest.approx(s)) for u, r, i, s in sorted(want)] == tuples(got)


def test_top_n(spark):
    df = spark.createDataFrame([(1, 10, 0.2), (1, 11, 0.9), (1, 12, 0.5), (2, 10, 0.5), (2, 9, 0.5)], f"{U} long, {I} long, s double")
    got = recommend.top_n(df, U, I, "s", 2).orderBy("id").collect()
    assert [(r["id"], [tuple(x) for x in r["recommendations"]]) for r in got] == [
        (1, [(11, 0.9), (12, 0.5)]), (2, [(9, 0.5), (10, 0.5)])
    ]
    plan = recommend.top_n(df, U, I, "s", 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_recommendations_of_a_model(spark, lists):
    users, items, seen = lists
    rated = seen.dropDuplicates().withColumn("rating", ((F.col(U) + F.col(I)) % 5).cast("float"))
    model = models.als(rated, U, I, "rating", max_iter=2, rank=3)
    for_users = recommend.recommend_for_users(users, items, seen, model, 3).collect()
    known = set(tuples(seen))
    assert {r["id"] for r in for_users} == set(range(11))  # user 11 has nothing left
    for r in for_users:
        assert len(r["recommendations"]) == 3
        assert not {(r["id"], x[I]) for x in r["recommendations"]} & known
    for_items = recommend.recommend_for_items(users, items, seen, model, 2).collect()
    assert all(len(r["recommendations"]) <= 2 and (r["recommendations"][0][U], r["id"]) not in known for r in for_items)
    factors = recommend.top_n_factors(
        model.userFactors.withColumnRenamed("id", U), model.itemFactors.withColumnRenamed("id", I), seen, 3
    )
    pick = {r["id"]: [x[I] for x in r["recommendations"]] for r in for_users}
    assert pick == {r["id"]: [x[I] for x in r["recommendations"]] for r in factors.collect()}


@pytest.mark.parametrize("n, block_users, block_items, limit", [(1, 3, 4, 1 << 26), (4, 100, 7, 0), (60, 5, 1000, 0)])
def test_pruned_products_equal_brute_force(spark, lists, monkeypatch, n, block_users, block_items, limit):
    monkeypatch.setattr(products, "BROADCAST_BYTES", limit)
    _, _, seen = lists
    known = set(tuples(seen))
    rng = np.random.default_rng(5)
    fu, fi = rng.integers(-2, 3, (12, 3)).astype(float), rng.integers(-3, 4, (40, 3)).astype(float)
    fu[3], fi[8] = 0, 0  # nothing but ties; a vector of length zero
    left = spark.createDataFrame([(u, fu[u].tolist()) for u in range(12)] + [(50, None)], f"{U} long, features array<float>")
    right = spark.createDataFrame([(i, fi[i].tolist()) for i in range(40)] + [(50, None)], f"{I} long, features array<float>")
    want = []
    for u in range(12):
        best = sorted((-float(fu[u] @ fi[i]), i) for i in range(40) if (u, i) not in known)[:n]
        want += [(u, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    got = products.top_n_products(left, right, seen, n, block_users=block_users, block_items=block_items, as_array=False)
    assert tuples(got) == sorted(want)


def test_pruned_products_score_few_pairs(spark):
    """Lengths that fall off leave most of the items unscored; the result is that of the full product."""
    rng = np.random.default_rng(1)
    fu, fi = rng.normal(size=(300, 8)), rng.normal(size=(4000, 8)) * (1.0 / np.arange(1, 4001) ** 0.5)[:, None]
    left = spark.createDataFrame([(u, fu[u].tolist()) for u in range(300)], f"{U} long, features array<double>")
    right = spark.createDataFrame([(i, fi[i].tolist()) for i in range(4000)], f"{I} long, features array<double>")
    seen = spark.createDataFrame([(u, i) for u in range(300) for i in range(0, 60, 7)], f"{U} long, {I} long")
    report = []
    got = products.top_n_products(left, right, seen, 5, block_items=64, as_array=False, report=report)
    scores = fu @ fi.T
    scores[:, list(range(0, 60, 7))] = -np.inf
    want = np.argsort(-scores, axis=1)[:, :5]
    rows = {(r[U], r["rank"]): r[I] for r in got.collect()}
    assert all(rows[u, k + 1] == want[u, k] for u in range(300) for k in range(5))
    assert report[0]["users"] == 300 and sum(r["pairs"] for r in report) < 0.2 * 300 * 4000


def test_products_of_empty_tables(spark, lists):
    _, _, seen = lists
    left = spark.createDataFrame([(1, [1.0])], f"{U} long, features array<double>")
    right = spark.createDataFrame([(1, [1.0])], f"{I} long, features array<double>")
    assert products.top_n_products(left, right.where("false"), seen, 2).count() == 0
    assert products.top_n_products(left.where("false"), right, seen, 2).count() == 0


def test_products_of_equal_lengths_score_few_pairs(spark):
    """Where all lengths are alike the boxes around the blocks tell which pairs need no score; equal vectors are left by their ids."""
    rng = np.random.default_rng(7)
    fu, fi = rng.normal(size=(400, 3)), rng.normal(size=(12000, 3))
    fu, fi = fu / np.linalg.norm(fu, axis=1)[:, None], fi / np.linalg.norm(fi, axis=1)[:, None]
    fi[1500:2500] = fi[7]
    left = spark.createDataFrame([(u, fu[u].tolist()) for u in range(400)], f"{U} long, features array<double>")
    right = spark.createDataFrame([(i, fi[i].tolist()) for i in range(12000)], f"{I} long, features array<double>")
    seen = spark.createDataFrame([(u, i) for u in range(400) for i in (7, 1500, u)], f"{U} long, {I} long")
    report = []
    got = products.top_n_products(left, right, seen, 5, block_users=4, block_items=32, as_array=False, report=report)
    scores = sum(np.multiply.outer(fu[:, k], fi[:, k]) for k in range(3))
    scores[:, [7, 1500]] = -np.inf
    scores[range(400), range(400)] = -np.inf
    want = np.argsort(-scores, axis=1, kind="stable")[:, :5]
    assert tuples(got.select(U, "rank", I)) == [(u, k + 1, want[u, k]) for u in range(400) for k in range(5)]
    assert sum(r["pairs"] for r in report) < 0.3 * 400 * 12000


@pytest.mark.parametrize("group", [4, 1 << 16])
def test_products_of_other_ids_equal_brute_force(spark, monkeypatch, group):
    """String ids, a missing one, seen users of another type, vectors with holes and groups of a single block."""
    monkeypatch.setattr(products, "GROUP_ITEMS", group)
    rng = np.random.default_rng(9)
    fu, fi = rng.integers(-1, 2, (20, 2)).astype(float), rng.integers(-1, 2, (30, 2)).astype(float)
    names = [None, *[f"i{k}" for k in range(1, 30)]]
    left = spark.createDataFrame([(u, fu[u].tolist()) for u in range(20)] + [(None, [1.0, 0.0])], f"{U} int, features array<double>")
    right = spark.createDataFrame([(names[i], fi[i].tolist()) for i in range(30)] + [("hole", [None, 9.0]), ("nan", [float("nan"), 9.0])], f"{I} string, features array<double>")
    pairs = [(u, names[i]) for u in range(20) for i in range(1, 30) if (u * i) % 4 == 1] + [(1 << 40, "i1"), (None, "i1")]
    got = products.top_n_products(left, right, spark.createDataFrame(pairs, f"{U} long, {I} string"), 6, block_users=3, block_items=4, as_array=False)
    want = []
    for u, v in [*enumerate(fu), (None, np.array([1.0, 0.0]))]:
        best = sorted((-float(v @ fi[i]), names[i] or "", names[i]) for i in range(30) if u is None or (u, names[i]) not in pairs)[:6]
        want += [(-1 if u is None else u, r + 1, name or "", -s) for r, (s, _, name) in enumerate(best)]
    assert tuples(got.fillna(-1, [U]).fillna("", [I])) == sorted(want)
