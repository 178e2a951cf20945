"""Files whose lines are checked, numbered or grouped by directory, and tables that stay co-located."""

import numpy as np
import pytest
from conftest import tuples
from pyspark.sql import functions as F

from flowfeat.operators import models
from flowfeat.sources import files


def test_checked_csv_keeps_every_line_somewhere(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,x,note\n1,2.5,ok\n2,many,ok\n3,1.0\n4,7,"with, comma"\n5,6,ok,more\n')
    (tmp_path / "b.csv").write_text("id,x,note\n6,,\nseven,1,ok\n")
    good, bad = files.checked_csv(spark, str(tmp_path), "id int, x double, note string")
    assert tuples(good.where("x IS NOT NULL")) == [(1, 2.5, "ok"), (4, 7.0, "with, comma")] and good.where("id = 6").count() == 1
    assert tuples(bad.select("line")) == [("2,many,ok",), ("3,1.0",), ("5,6,ok,more",), ("seven,1,ok",)]
    assert {f.rsplit("/", 1)[1] for (f,) in tuples(bad.select("file"))} == {"a.csv", "b.csv"}
    assert tuples(files.quarantine_report(good, bad)) == [(7, 3, 4)]
    assert good.select("id").count() == 3  # judged by all fields, whichever are read


def test_line_numbers_over_blocks(spark, tmp_path):
    """Files cut into many blocks, dealt to tasks in any way: each line has its own place, lines of all lengths included."""
    want = []
    for name, n in (("one", 500), ("two", 3), ("empty", 0), ("dir/three", 1200)):
        lines = [f"{name} {i} " + "x" * ((i * 37) % 90) for i in range(n)]
        path = tmp_path / f"{name}.txt"
        path.parent.mkdir(exist_ok=True)
        path.write_text("".join(x + "\n" for x in lines))
        want += [(f"{name.split('/')[-1]}.txt", i, x) for i, x in enumerate(lines)]
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size, cost in (("1000", "0"), ("2000", "5000"), ("100m", "4m")):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", cost)
            got = files.numbered_lines(spark, str(tmp_path))
            assert tuples(got.select(F.element_at(F.split("file", "/"), -1), "line_no", "value")) == sorted(want)
        rest = files.without_header(got, 2)
        assert rest.count() == 498 + 1 + 1198 and rest.where("value LIKE 'two%'").first()["line_no"] == 0
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_tree_means_by_manifest(spark, tmp_path):
    rows = [(f"2020-01-0{1 + i % 4} 10:00", f"{i}\t{i * i}") for i in range(40)]
    df = spark.createDataFrame(rows, "ts string, text string").repartition(3)
    path = files.write_tree(df, str(tmp_path / "tree"), "ts", "text")
    listed = spark.createDataFrame([("_d=2020-01-01 10:00",), ("_d=2020-01-03 10:00",), ("absent",), ("absent",)], "name string")
    got = tuples(files.tree_means(spark, path, listed, 2))
    mine = lambda k: [i for i in range(40) if i % 4 == k]
    assert got == [(f"_d=2020-01-0{k + 1} 10:00", np.mean(mine(k)), np.mean([i * i for i in mine(k)])) for k in (0, 2)]


def test_indexed_tables_join_without_exchange(spark):
    facts = spark.range(5000).select((F.col("id") % 97).alias("user"), F.col("id").alias("x"))
    users = spark.range(97).select(F.col("id").alias("user"), (F.col("id") * 2).alias("y"))
    names = [files.save_indexed(df, "user", 4) for df in (facts, users)]
    left, right = (files.indexed(spark, n) for n in names)
    joined = left.join(right.hint("merge"), "user").groupBy("user", "y").agg(F.sum("x").alias("s"))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert tuples(joined) == tuples(facts.join(users, "user").groupBy("user", "y").agg(F.sum("x").alias("s")))
    for n in names:
        files.drop_indexed(spark, n)
    assert not any(spark.catalog.tableExists(n) for n in names)


def test_ridge_grid_equals_dense_solves(spark):
    r = np.random.default_rng(2)
    x, noise = r.normal(size=(300, 3)), r.normal(size=300)
    y = 1.5 + x @ [2.0, -1.0, 0.5] + noise
    rows = [(*map(float, a), float(b), i % 5 == 0) for i, (a, b) in enumerate(zip(x, y))] + [(None, 1.0, 1.0, 1.0, False)]
    df = spark.createDataFrame(rows, "a double, b double, c double, label double, held boolean").repartition(4)
    train, test = df.where("NOT held"), df.where("held")
    got = models.ridge_grid(train, test, ["a", "b", "c"], [0.0, 1.0, 50.0]).collect()
    inside = np.arange(300) % 5 != 0
    xc, yc = x[inside] - x[inside].mean(0), y[inside] - y[inside].mean()
    for row, penalty in zip(got, [0.0, 1.0, 50.0]):
        w = np.linalg.solve(xc.T @ xc + penalty * np.eye(3), xc.T @ yc)
        w0 = y[inside].mean() - x[inside].mean(0) @ w
        assert row["weights"] == pytest.approx(list(w)) and row["intercept"] == pytest.approx(w0)
        for part, name in ((inside, "train_rmse"), (~inside, "test_rmse")):
            assert row[name] == pytest.approx(np.sqrt(np.mean((w0 + x[part] @ w - y[part]) ** 2)))
    assert models.ridge_grid(train.where("false"), test, ["a"], [1.0]).first()["train_rmse"] is None


def test_fold_in_equals_dense_solves(spark):
    r = np.random.default_rng(3)
    v = r.normal(size=(30, 4))
    factors = spark.createDataFrame([(i, v[i].tolist()) for i in range(30)], "item int, features array<float>")
    v = np.float32(v).astype(float)
    rated = [(1 if k % 3 else k % 11 + 2, int(r.integers(0, 33)), float(r.integers(1, 6))) for k in range(400)] + [(5, 1, None)]
    got = {x["user"]: x for x in models.fold_in(spark.createDataFrame(rated, "user int, item int, rating double").repartition(5), factors, 0.1).collect()}
    for user in {u for u, i, _ in rated if i < 30}:
        mine = [(i, x) for u, i, x in rated if u == user and i < 30 and x is not None]
        a = v[[i for i, _ in mine]]
        want = np.linalg.solve(a.T @ a + 0.1 * len(mine) * np.eye(4), a.T @ np.array([x for _, x in mine]))
        assert got[user]["n"] == len(mine) and got[user]["features"] == pytest.approx(list(want))
    pairs = spark.createDataFrame([(1, 2), (1, 99), (99, 2)], "user int, item int")
    users = models.fold_in(spark.createDataFrame(rated, "user int, item int, rating double"), factors, 0.1)
    scored = models.factor_scores(pairs, users, factors).collect()
    assert len(scored) == 1 and scored[0]["prediction"] == pytest.approx(float(np.dot(got[1]["features"], v[2])))
    # an exact low-rank table is found again
    true = r.normal(size=4)
    exact = spark.createDataFrame([(7, i, float(v[i] @ true)) for i in range(30)], "user int, item int, rating double")
    assert models.fold_in(exact, factors, 0.0).first()["features"] == pytest.approx(list(true))
