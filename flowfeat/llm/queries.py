"""The registered queries of the text operators. Each reads whole tables and passes through its operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowfeat.llm import bpe, decontamination, exact_dedup, hilbert, language, line_dedup, minhash, prefix_trie, ranked_search, substring_dedup, token_files, tool_calls, url_filter
from flowfeat.llm.common import documents, shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """All documents against all benchmark items."""
    found = decontamination.contaminated(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.sort_array(F.col("items").cast("array<string>")), ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


URL_RULES = [
    url_filter.Rule("block", "net", "/"),
    url_filter.Rule("allow", "example.net", "/en/"),
    url_filter.Rule("block", "example.com", "/de/"),
    url_filter.Rule("allow", "org", "/fr/"),
]


@query
def op2_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """All page URLs; those that a rule decides teach the models that judge the others."""
    return url_filter.judge(spark.read.parquet(f"{folder}/pages.parquet"), URL_RULES).drop("url")


@query
def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """All documents: about half of them, by a hash of the id, are the snapshot and the others the incoming batch."""
    docs = documents(spark, folder).select("doc_id", "text")
    old = F.xxhash64("doc_id") < 0
    held = exact_dedup.snapshot(docs.where(old))
    found = exact_dedup.classes(exact_dedup.groups(exact_dedup.rows(docs.where(~old))), [held])
    return exact_dedup.resolve(docs, found).withColumnRenamed("digest", "text_sha256")


@query
def op4_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """All documents, linked at a similarity of 0.85."""
    return minhash.near_duplicates(documents(spark, folder), minhash.Plan(percent=85))


def vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op5_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """All documents, encoded and decoded."""
    return bpe.digests(documents(spark, folder), vocabulary())


@query
def op6_language(spark: SparkSession, folder: str) -> DataFrame:
    """Profiles of the labelled documents outside the held-out fold; predictions for all documents."""
    docs = documents(spark, folder)
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2
    profiles = language.learn(docs.where(~held_out))
    return language.predict(docs, profiles).withColumn("held_out", held_out)


@query
def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """All documents, without the runs of several lines that an earlier document has."""
    out = line_dedup.drop_repeated(documents(spark, folder).select("doc_id", "text"), whole=True)
    text = F.coalesce("text", F.lit("")).cast("binary")
    return out.select("doc_id", "dedup.n_lines", "dedup.n_removed", F.sha2(text, 256).alias("kept_sha256"))


@query
def op8_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """All documents: words in windows of 50 that an earlier document has are removed."""
    return substring_dedup.remove_repeats(documents(spark, folder)).drop("spans")


TOOLS = {
    "configure": {"type": "object", "required": ["instructions"], "properties": {"instructions": {"type": "string", "minLength": 1}}},
    "reply": {
        "type": "object",
        "required": ["prompt", "words"],
        "properties": {"prompt": {"type": "string"}, "words": {"type": "integer", "minimum": 1}, "opening": {"type": "boolean"}},
        "additionalProperties": False,
    },
}


@query
def op9_tool_calls(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations as tool calls: each user turn asks for a reply, whose result is the next turn if that is the
    assistant's; system turns configure. Replies need the conversation's configuration and its first reply."""
    turns = spark.read.parquet(f"{folder}/conversations.parquet")
    call_id = F.concat_ws("-", F.lit("call"), F.col("turn"))
    words = F.size(F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != ""))
    reply = F.to_json(F.struct(F.col("text").alias("prompt"), words.alias("words"), (F.col("turn") == 0).alias("opening")))
    first = turns.groupBy("conv_id").agg(
        F.min(F.when(F.col("role") == "system", F.col("turn"))).alias("system"), F.min(F.when(F.col("role") == "user", F.col("turn"))).alias("user")
    )
    needs = F.filter(
        F.array(F.col("system"), F.col("user")), lambda t: t.isNotNull() & (t != F.col("turn")) & (F.col("role") == "user")
    )
    asked = turns.where(F.col("role").isin("user", "system")).join(first.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")))
    calls = asked.select(
        "conv_id",
        "turn",
        call_id.alias("call_id"),
        F.when(F.col("role") == "user", "reply").otherwise("configure").alias("name"),
        F.when(F.col("role") == "user", reply).otherwise(F.to_json(F.struct(F.col("text").alias("instructions")))).alias("arguments"),
        F.transform(needs, lambda t: F.concat_ws("-", F.lit("call"), t)).alias("needs"),
    )
    results = turns.where("role = 'assistant'").select(
        "conv_id", "turn", F.concat_ws("-", F.lit("call"), F.col("turn") - 1).alias("call_id"), F.col("text").alias("content")
    )
    return tool_calls.linked(calls, results, TOOLS).select(
        "conv_id", "call_id", "turn", "name", "level", "status", "n_calls", "n_results", F.sha2("message", 256).alias("message_sha256")
    )


@query
def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """All documents, encoded and written as flat token files, and the documents found again in these files."""
    separator = 50256
    out = shared_folder(spark)
    token_files.write_token_files(bpe.encode(documents(spark, folder), vocabulary()), out, separator)
    found = token_files.token_counts(spark, out, separator)
    return found.withColumn("file", F.regexp_extract("file", r"part-(\d+)", 1).cast("int"))


@query
def op11_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    """All documents, ranked for every benchmark item."""
    return ranked_search.ranked(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"), k=10)


SHARD_DIMENSIONS = ["lang", "source", "size"]


@query
def op12_hilbert_shards(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 40 runs of equal row counts along a curve through language, source and size."""
    placed = hilbert.assigned(documents(spark, folder), SHARD_DIMENSIONS, 40, law="rows")
    return placed.withColumn("grown_shard", F.lit(None).cast("int"))


@query
def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations, each rebuilt with the first turns of the conversation at the hundred below, as one trie."""
    turns = spark.read.parquet(f"{folder}/conversations.parquet")
    heads = F.crc32(F.col("conv").cast("string").cast("binary")) % 6
    sequences, members = prefix_trie.rebuilt(turns, heads, F.col("conv") - F.col("conv") % 100, longest=5)
    return prefix_trie.nodes(sequences, members)
