"""A training corpus from raw documents, in five stages, each on all that its predecessor kept.

Defined cases, in every stage: a null or empty text has no letter, so the first stage rejects it; given to a later stage
it stays as it is, has no lines, shingles or benchmark words, and is encoded as no ids. A null doc_id is an ordinary
value. Very long texts are handled whole. Repeated rows are kept or dropped alike. Columns besides those of
`documents`, whatever their names, pass through all stages but the last. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowfeat.llm import bpe, decontamination, language, line_dedup, minhash
from flowfeat.llm.common import drop_folders, scratch_folders, stored
from flowfeat.llm.queries import vocabulary

#: Languages to keep; None keeps every language that the labels teach.
LANGUAGES: list[str] | None = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Profiles of a bounded sample of the labelled documents; documents of no learned (or wanted) language go.

    A document without a language gets the one that was found.
    """
    profiles = language.learn(language.sampled(docs), language.EVIDENCE_DIM)
    return language.identified(docs, profiles, LANGUAGES)


def drop_line_chunks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of lines that an earlier document has go; every document stays, and `n_chars` follows its text."""
    out = line_dedup.drop_repeated(docs, report=None, whole=True)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))
    return out


def _matched(docs: DataFrame, ids: Column, found: DataFrame, how: str) -> DataFrame:
    """Rows of `docs` by their doc_id; a row is one struct meanwhile, so that no name of its columns can clash."""
    rows = docs.select(F.struct("*").alias("row"))
    asked = found.select(ids.alias("asked")).distinct()
    kept = rows.join(asked, F.col("row.doc_id").eqNullSafe(F.col("asked")), how)
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group linked at a similarity of 0.8 the document with the smallest id stays."""
    return _matched(docs, F.col("doc_id"), minhash.near_duplicates(docs).where("kept"), "left_semi")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten words in a row from a benchmark item go."""
    found = decontamination.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _matched(docs, F.col("doc_id"), found.where("n_hit > 0"), "left_anti")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text: doc_id, n_tokens, ids, n_split (ids with a part of a character), round_trip.

    All ids are decoded again; `round_trip` is false where the bytes are not those of the text.
    """
    out = bpe.encode(docs, vocabulary(), verify=True)
    return out.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "n_split", "round_trip")


STAGES = [
    ("language", identify_language),
    ("lines", drop_line_chunks),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("encoding", encode),
]

#: Languages and byte-level BPE have no SQL form; `tests/llm/test_pipeline.py` holds the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over the table `documents`.

    Each result but the last is stored; what a stage read and stored besides is deleted when its result is there.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = set(scratch_folders(spark))
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
        drop_folders(spark, [f for f in scratch_folders(spark)[:-1] if f not in before])
    return STAGES[-1][1](spark, docs, sf_dir)
