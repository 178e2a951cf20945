import pytest
from conftest import tuples
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from flowfeat.operators import text
from flowfeat.plans import jobs


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc long, text string")


def test_tokens(spark):
    df = text.tokenize(docs(spark, "The cat's hat, été ABC123def xy", "", None), "text").orderBy("doc")
    assert [r["tokens"] for r in df.collect()] == [["the", "cat", "hat", "abc", "def"], [], None]


def test_vocabulary(spark):
    df = spark.createDataFrame([(["a", "a", "a", "b", "b", "c"],)], "tokens array<string>")
    assert tuples(text.vocabulary(df, max_words=3, skip_top=1)) == [("b", 2, 1), ("c", 1, 2)]
    assert tuples(text.vocabulary(df, max_words=2, skip_top=0)) == [("a", 3, 1), ("b", 2, 2)]
    many = spark.range(2000).select(F.array(F.concat(F.lit("w"), (F.col("id") % 300).cast("string"))).alias("tokens"))
    assert tuples(text.vocabulary(many, max_words=50)) == tuples(text.vocabulary(many, max_words=50, small_rows=10))


@pytest.fixture(scope="module")
def vocab(spark):
    return spark.createDataFrame([("a", 9, 1), ("b", 5, 2), ("c", 1, 3)], "token string, count long, id long")


def test_token_ids(spark, vocab):
    df = spark.createDataFrame([(1, ["b", "x", "a", "b"]), (2, ["x"]), (3, []), (4, None)], "doc long, tokens array<string>")
    assert tuples(text.token_ids(df, "doc", vocab)) == [(1, [2, 1, 2]), (2, []), (3, []), (4, [])]
    assert tuples(text.token_ids(df, "doc", vocab, unknown=0, shift=1)) == [(1, [3, 1, 2, 3]), (2, [1]), (3, []), (4, [])]


def test_pad_ids_and_vectors(spark):
    df = spark.createDataFrame([(1, [1, 2, 9]), (2, [])], "doc long, ids array<long>")
    assert tuples(text.pad_ids(df, length=2)) == [(1, [2, 9]), (2, [0, 0])]
    assert tuples(text.pad_ids(df, length=4, side="right", keep="first")) == [(1, [1, 2, 9, 0]), (2, [0] * 4)]
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 4.0])], "id long, vector array<float>")
    got = tuples(text.token_vectors(df, "doc", vectors, 2))
    assert got == [(1, [[1.0, 0.0], [0.0, 4.0], [0.0, 0.0]]), (2, [])]
    means = tuples(text.mean_vectors(df, "doc", vectors, 2))
    assert means == [(1, [pytest.approx(1 / 3), pytest.approx(4 / 3)]), (2, [0.0, 0.0])]


def test_sentences(spark):
    got = text.sentence_tokens(docs(spark, "One two.  Three!\nfour", "", "a?"), "doc", "text")
    assert tuples(got) == [
        (0, 0, ["<s>", "One", "two.", "</s>"]), (0, 1, ["<s>", "Three!", "</s>"]), (0, 2, ["<s>", "four", "</s>"]),
        (2, 0, ["<s>", "a?", "</s>"]),
    ]


def test_lines(spark, vocab):
    df = docs(spark, "x y", "a  b ", "", " ").orderBy("doc")
    assert [r[0] for r in df.select(text.line_words("text")).collect()] == [
        ["x", "y", "<eos>"], ["a", "", "b", "<eos>"], ["", "<eos>"], ["<eos>"]
    ]
    ids = text.corpus_ids(df.withColumnRenamed("text", "value"), "doc", vocab)
    assert tuples(ids)[:2] == [(0, [1, 1, 1]), (1, [2, 1, 3, 1])]
    assert spark.range(1).select(text.prompt_words(F.lit("go, now-then"))).first()[0] == ["go", "now", "then"]


def test_next_token_pairs(spark):
    df = spark.createDataFrame([([5, 6, 7],), ([5],), ([],)], "ids array<long>")
    got = [(r["input"], r["target"]) for r in text.next_token_pairs(df).collect()]
    assert got == [([5, 6], [6, 7]), ([], []), ([], [])]
    padded = text.next_token_pairs(df, length=4, feature_pad=2, label_pad=1).first()
    assert (padded["input"], padded["target"]) == ([5, 6, 2, 2], [6, 7, 1, 1])
    assert text.longest(df, "ids").first()[0] == 3


def test_one_hot(spark):
    df = spark.createDataFrame([(1, [0, 4]), (2, [])], "doc long, input array<long>")
    rows = text.one_hot(df, "doc", 5).select("doc", "pos", vector_to_array("vector").alias("v"))
    assert tuples(rows) == [(1, 0, [1.0, 0, 0, 0, 0]), (1, 1, [0.0, 0, 0, 0, 1])]


def test_text_job(spark):
    table = docs(spark, *["red red red blue blue green"] * 3, "nothing known here")
    vectors = spark.createDataFrame([("red", [1.0, 1.0]), ("blue", [2.0, 0.0])], "token string, vector array<double>")
    rows = jobs.text_features(table, "doc", "text", vectors, 2, max_words=3, skip_top=1, length=4).orderBy("doc").collect()
    assert rows[0]["ids"] == [0, 1, 1, 2] and rows[0]["vectors"] == [[0.0, 0.0], [2.0, 0.0], [2.0, 0.0], [0.0, 0.0]]
    assert rows[3]["ids"] == [0, 0, 0, 0] and len(rows) == 4


@pytest.mark.parametrize("small_rows", [10**6, 0])
@pytest.mark.parametrize("max_words, skip_top", [(1, 0), (7, 2), (150, 10), (399, 0), (5000, 3)])
def test_vocabulary_equals_a_full_sort(spark, small_rows, max_words, skip_top):
    """Ties at the last place, counts in classes of many numbers, and more words asked for than there are."""
    counts = {f"w{i}": [1, 1, 2, 3, 700, 701, 9000][i % 7] + (i == 300) * 20_000 for i in range(400)}
    df = spark.createDataFrame([([w] * (n % 1000),) for w, n in counts.items()] + [([w] * 1000,) for w, n in counts.items() for _ in range(n // 1000)] + [(None,)], "tokens array<string>")
    best = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:max_words][skip_top:]
    got = text.vocabulary(df, max_words=max_words, skip_top=skip_top, small_rows=small_rows).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(w, n, i + 1) for i, (w, n) in enumerate(best)]


def test_count_classes_keep_the_order(spark):
    numbers = spark.range(1, 5000).select("id", text._count_class(F.col("id")).alias("c")).orderBy("id").collect()
    assert all(a["c"] <= b["c"] for a, b in zip(numbers, numbers[1:])) and len({r["c"] for r in numbers if r["id"] < 128}) == 127
    top = spark.sql("SELECT 9223372036854775807L AS id").select(text._count_class(F.col("id")).alias("c")).first()[0]
    assert numbers[-1]["c"] < top < 4096


def test_vectors_stay_where_tokens_are(spark):
    """A small table of vectors goes to the tokens whatever the planner thinks of it: no vector is shuffled or sorted with a token."""
    df = spark.sql("SELECT 1L AS doc, array(1L, 2L, 0L, 9L) AS ids UNION ALL SELECT 2L, array() UNION ALL SELECT 3L, NULL")
    vectors = spark.sql("SELECT id, array(double(id), 2D) AS vector FROM range(3)")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for made in (text.token_vectors(df, "doc", vectors, 2, pad=0), text.mean_vectors(df, "doc", vectors, 2)):
            plan = made._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert "ObjectHashAggregate" not in plan  # which sorts the vectors of tokens from 128 keys on
        assert tuples(made) == [(1, [0.75, 1.5]), (2, [0.0, 0.0]), (3, [0.0, 0.0])]
        vocab = spark.sql("SELECT 'a' AS token, 1L AS id")
        coded = text.token_ids(spark.sql("SELECT 1L AS doc, array('a', 'b') AS tokens"), "doc", vocab)
        assert "SortMergeJoin" not in coded._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    both = text.token_vectors(df, "doc", vectors, 2, pad=0, keep_ids=True)
    zero = [0.0, 0.0]
    assert tuples(both) == [(1, [1, 2, 0, 9], [[1.0, 2.0], [2.0, 2.0], zero, zero]), (2, [], []), (3, [], [])]
    twice = text.token_vectors(df, "doc", vectors.unionByName(vectors), 2, pad=0, keep_ids=True).where("doc = 1").first()
    assert twice["ids"] == [1, 2, 0, 9] and len(twice["vectors"]) == 6  # an id twice in `vectors` has both of them
    with pytest.raises(Exception, match="does not have 3 values"):
        text.mean_vectors(df, "doc", vectors, 3).collect()
