"""The pipeline stage by stage against brute force, and the registration of all queries."""

import random

import pytest
from helpers import SCHEMA, awkward, corpus, frame
from test_dedup import near_brute, runs_brute
from test_text_ops import PATH, leaks_brute

import corpus_pipeline
from flowfeat.llm import bpe, common
from flowfeat.llm.oracles import ORACLES
from flowfeat.llm.queries import QUERIES


@pytest.fixture
def folder(spark, tmp_path):
    rows = awkward(corpus(seed=3))
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    items = [(1, " ".join(t.split()[2:20])) for _, t, *_ in rows if t and len(t.split()) > 60][:2]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), rows, items


def texts(df):
    return sorted([(r["doc_id"], r["text"]) for r in df.collect()], key=str)


def test_stages(spark, folder):
    path, rows, items = folder
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5
    docs = spark.read.parquet(f"{path}/documents.parquet")
    one = stages["language"](spark, docs, path).cache()
    assert one.schema == docs.schema
    lettered = sorted([(d, t) for d, t, *_ in rows if any(c.isalpha() for c in t or "")], key=str)
    assert set(texts(one)) <= set(lettered) and len(texts(one)) > 0.8 * len(lettered)  # but for a few of one or two syllables
    two = stages["lines"](spark, one, path).cache()
    assert two.columns == docs.columns
    kept = [(r["doc_id"], r["text"]) for r in one.collect()]
    assert texts(two) == sorted([r[:2] for r in runs_brute(kept)], key=str)
    assert two.where("n_chars <> char_length(text)").count() == 0
    three = stages["near_duplicates"](spark, two, path).cache()
    groups = near_brute([(r["doc_id"], r["text"]) for r in two.collect()], 80)
    stay = {r[0] for r in groups if r[3]}
    assert texts(three) == [x for x in texts(two) if x[0] in stay]
    four = stages["decontamination"](spark, three, path).cache()
    leaks = leaks_brute([(r["doc_id"], r["text"]) for r in three.collect()], items)
    clean = {r[0] for r in leaks if not r[2]}
    assert texts(four) == [x for x in texts(three) if x[0] in clean] and four.count() < three.count()
    five = stages["encoding"](spark, four, path)
    back = bpe.decode(five, PATH)
    assert sorted([(r["doc_id"], bytes(r["data"]).decode()) for r in back.collect()], key=str) == [(d, t or "") for d, t in texts(four)]
    assert five.where("n_tokens <> size(ids)").count() == 0


def test_run_equals_the_stages(spark, folder):
    path, *_ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
    held = len(common.scratch_folders(spark))
    run = corpus_pipeline.run(spark, path)
    assert len(common.scratch_folders(spark)) == held + 1  # only what the last stage reads
    assert run.columns == ["doc_id", "n_tokens", "ids", "n_split", "round_trip"]
    assert sorted(map(str, run.collect())) == sorted(map(str, docs.collect()))


def test_encoding_decodes_its_ids(spark, folder, monkeypatch):
    path, rows, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)["encoding"]
    assert stage(spark, docs, path).where("round_trip").count() == docs.count()
    whole = bpe.Coder.encode

    def lossy(self, texts):
        return whole(self, [t.replace("É", "E") for t in texts])

    monkeypatch.setattr(bpe.Coder, "encode", lossy)
    bad = stage(spark, docs, path).where("NOT round_trip").select("doc_id").collect()
    assert sorted((r[0] for r in bad), key=str) == sorted((d for d, t, *_ in rows if "É" in (t or "")), key=str)


def test_columns_of_any_name_pass(spark, folder):
    from pyspark.sql import functions as F

    path, *_ = folder
    names = ["__kept_id", "__hit_id", "asked", "row", "kept", "ids", "doc", "mark", "a.b"]
    docs = spark.read.parquet(f"{path}/documents.parquet").withColumns({c: F.lit(c) for c in names})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.select([F.col(f"`{c}`") for c in names]).distinct().collect() == [tuple(names)]


def test_wanted_languages(spark, monkeypatch):
    """Rejected languages go by what the text shows, whatever its label; a missing label is filled in."""
    r = random.Random(3)
    words = {"en": ["the", "with", "house", "street", "weather"], "fr": ["le", "avec", "maison", "rue", "soleil"]}
    rows = [(i, " ".join(r.choice(words[k]) for _ in range(60)), k if i % 3 else None, "s", 1) for i in range(60) for k in [["en", "fr"][i % 2]]]
    docs = spark.createDataFrame(rows, SCHEMA)
    stage = dict(corpus_pipeline.STAGES)["language"]
    assert {(x["doc_id"], x["lang"]) for x in stage(spark, docs, "").collect()} == {(i, ["en", "fr"][i % 2]) for i in range(60)}
    monkeypatch.setattr(corpus_pipeline, "LANGUAGES", ["fr"])
    assert {x["doc_id"] for x in stage(spark, docs, "").collect()} == set(range(1, 60, 2))


def test_stages_of_an_empty_table(spark, folder, tmp_path):
    path, *_ = folder
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
    assert docs.count() == 0


def test_registered_names():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)
    assert corpus_pipeline.ORACLE_SQL is None
