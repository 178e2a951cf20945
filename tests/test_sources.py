import json

import pytest
from conftest import tuples
from pyspark.sql import functions as F

from flowfeat.operators import features, text
from flowfeat.plans.jobs import sequence_job
from flowfeat.sources import readers, writers


def write(folder, name, *lines, encoding="utf-8"):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes("\n".join(lines).encode(encoding) + b"\n")
    return str(path)


def test_rating_files(spark, tmp_path):
    path = write(tmp_path, "ratings.dat", "1::10::5::978300760", "2::11::3::978302109")
    assert tuples(readers.ratings(spark, path)) == [(1, 10, 5), (2, 11, 3)]
    assert tuples(readers.ratings(spark, path, doubles=True)) == [(1.0, 10.0, 5.0), (2.0, 11.0, 3.0)]
    assert tuples(readers.ratings_strict(spark, path)) == [(1, 10, 5.0, 978300760), (2, 11, 3.0, 978302109)]
    short = write(tmp_path, "short.dat", "1::10::5")
    assert readers.ratings(spark, short).count() == 1
    with pytest.raises(Exception, match="expected 4 fields"):
        readers.ratings_strict(spark, short).collect()
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        readers.ratings(spark, write(tmp_path, "bad.dat", "x::10::5")).collect()


def test_user_and_item_files(spark, tmp_path):
    users = write(tmp_path, "users.dat", "1::F::18::10::48067")
    items = write(tmp_path, "movies.dat", "1::Toy (1995)::Animation|Children's|Comedy", "2::Solo::Drama")
    assert tuples(readers.users(spark, users)) == [(1, "F", 18, 10)]
    assert tuples(readers.items(spark, items)) == [(1, "Toy (1995)", "Animation"), (2, "Solo", "Drama")]


def test_json_to_parquet_job(spark, tmp_path):
    reviews = [
        {"asin": f"a{e % 5}", "overall": 4.0, "reviewerID": f"u{e % 3}", "unixReviewTime": e, "other": "x"} for e in range(30)
    ]
    meta = [{"asin": f"a{i}", "categories": [["x", f"c{i % 2}"]]} for i in range(4)] + [{"asin": "a4"}]
    r = write(tmp_path, "reviews.json", *map(json.dumps, reviews))
    m = write(tmp_path, "meta.json", *map(json.dumps, meta))
    assert readers.item_meta(spark, m).where("categories is null").count() == 1
    sequence_job(spark, r, m, str(tmp_path / "out"))
    sequence_job(spark, r, m, str(tmp_path / "out"))  # replaces
    assert readers.indexed_pairs(spark, str(tmp_path / "out")).count() == (30 - 3) * 2


def test_card_file(spark, tmp_path):
    title = '"Year","Cardholder Last Name","Cardholder First Initial","Amount","Vendor","Transaction Date","Merchant Category Code (MCC)"'
    path = write(
        tmp_path, "cards.csv", title, "2014,Mason,C,890.00,NACAS,07/30/2013 12:00:00 AM,CLUBS",
        "2014,Mason,C,368.96,SHERATON,07/30/2013 12:00:00 AM,SHERATON", "2014,Massey,J,165.82,SHERATON,07/29/2013 12:00:00 AM,SHERATON",
        "2014,broken",
    )
    got = features.card_transactions(readers.card_csv(spark, path))
    assert got.columns == ["uid", "mid", "amount", "date", "mcc"]
    assert tuples(got) == [(1, 1, 368.96, 20130730, 0), (1, 2, 890.0, 20130730, 1), (2, 1, 165.82, 20130729, 0)]


def test_series_file(spark, tmp_path):
    path = write(tmp_path, "taxi.csv", "timestamp,value", "2014-07-01 00:00:00,10844", "2014-07-01 00:30:00,8127")
    assert tuples(readers.series_csv(spark, path)) == [("2014-07-01 00:00:00", 10844.0), ("2014-07-01 00:30:00", 8127.0)]


def test_sensor_files(spark, tmp_path):
    write(tmp_path, "timestamp.txt", "2004.03.04.09.27.46", "2004 03 04+09")
    write(tmp_path, "2004.03.04.09.27.46", "1.0\t5.0", "3.0\t7.0")
    write(tmp_path, "2004 03 04+09", "2.0\t1.0")
    write(tmp_path, "not.listed", "9.0\t9.0")
    assert tuples(readers.sensor_means(spark, str(tmp_path))) == [("2004 03 04+09", 2.0), ("2004.03.04.09.27.46", 2.0)]
    both = readers.sensor_means(spark, str(tmp_path), columns=2)
    assert tuples(both) == [("2004 03 04+09", 2.0, 1.0), ("2004.03.04.09.27.46", 2.0, 6.0)]
    assert tuples(readers.sensor_means(spark, str(tmp_path), columns=None)) == tuples(both)
    writers.to_lines(both, str(tmp_path / "means"), ["value_1", "value_2"], single_file=True)
    assert sorted(r[0] for r in readers.lines(spark, str(tmp_path / "means")).collect()) == ["2.0,1.0", "2.0,6.0"]


def test_labelled_corpus(spark, tmp_path):
    write(tmp_path, "sci/101", "café", "two", encoding="iso-8859-1")
    write(tmp_path, "alt/7", "x")
    write(tmp_path, "alt/readme", "skip")
    rows = tuples(readers.labelled_corpus(spark, str(tmp_path)).select("directory", "label", "file", "text"))
    assert rows == [("alt", 1, "7", "x\n"), ("sci", 2, "101", "café\ntwo\n")]


def test_word_vectors(spark, tmp_path):
    path = write(tmp_path, "glove.txt", "the 0.1 -0.5", "cat 1.0 2.0", "dog 3 4")
    vocab = spark.createDataFrame([("cat", 2, 1), ("the", 9, 2), ("owl", 1, 3)], "token string, count long, id long")
    got = text.word_vectors(readers.lines(spark, path), vocab)
    assert tuples(got) == [(1, "cat", [1.0, 2.0]), (2, "the", [0.1, -0.5])]
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        readers.lines(spark, str(tmp_path / "missing.txt")).count()


def test_rows_in_the_program(spark):
    got = readers.csv_rows(spark, ["a,1,2,3", "b,1,2,3", "c,2,2,3"], ["ts", "x", "y", "z"])
    assert tuples(got) == [("a", "1", "2", "3"), ("b", "1", "2", "3"), ("c", "2", "2", "3")]
    scored = readers.rows(spark, [(0, 0.1), (1, 0.8), (2, 0.2)], "id long, score double")
    assert [round(r[0], 3) for r in scored.select(F.col("score") + 1).collect()] == [1.1, 1.8, 1.2]
