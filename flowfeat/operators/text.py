"""Text to tokens, vocabularies, ids, vectors and next-token pairs."""

from __future__ import annotations

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowfeat.columns import as_list, need
from flowfeat.functions import arrays
from flowfeat.operators.positions import BROADCAST_ROWS, SMALL_ROWS, global_positions
from flowfeat.session import cut_lineage

END_OF_LINE = "<eos>"
SENTENCE_START, SENTENCE_END = "<s>", "</s>"
BROADCAST_BYTES = 64 << 20  # a table of vectors up to so many bytes goes to every task whole


def words(text, min_length: int = 3) -> Column:
    """Runs of at least `min_length` ASCII letters of the lower-cased text."""
    col = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(col), F.lit(f"[a-z]{{{min_length},}}"), F.lit(0))


def tokenize(df: DataFrame, col: str, out: str = "tokens", min_length: int = 3) -> DataFrame:
    need(df, col)
    return df.withColumn(out, words(col, min_length))


def word_counts(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(token, count) over all token arrays."""
    need(df, tokens)
    # the outer form: a plain explode makes the optimizer test the size of the array in a
    # filter of its own, and so tokenizes every text again
    spread = df.select(F.explode_outer(tokens).alias("token")).where(F.col("token").isNotNull())
    return spread.groupBy("token").agg(F.count(F.lit(1)).alias("count"))


def _count_class(count) -> Column:
    """Whole numbers in classes that keep their order: 64 to each power of two, one number each below 128."""
    bits = F.length(F.bin(count))
    shift = F.greatest(bits - 7, F.lit(0))
    return (shift * 64 + F.call_function("shiftright", count, shift)).cast("int")


def vocabulary(
    df: DataFrame, tokens: str = "tokens", max_words: int = 20_000, skip_top: int = 10, small_rows: int = SMALL_ROWS
) -> DataFrame:
    """(token, count, id): the `max_words` most frequent tokens less the first `skip_top`.

    Ids start at one; equally frequent tokens are taken in alphabetical order. Counts are made once and stored; a
    histogram over at most 4,096 classes of counts tells below which class no chosen token can lie, and only tokens at
    or above it are ever put in order, by one task if they are few and over ranges of the order if not.
    """
    counts = cut_lineage(word_counts(df, tokens))
    classes = counts.groupBy(_count_class(F.col("count")).alias("class")).agg(F.count("*").alias("n"), F.min("count").alias("least"))
    least, chosen = 0, 0
    for row in sorted(classes.collect(), key=lambda r: -r["class"]):  # a row a class
        if chosen >= max_words:
            break
        least, chosen = row["least"], chosen + row["n"]
    order = [F.desc("count"), F.asc("token")]
    best = counts.where(F.col("count") >= least)
    if chosen <= small_rows:
        ranked = best.withColumn("id", F.row_number().over(W.orderBy(*order)).cast("long"))
    else:
        ranked = global_positions(best, order, "id", start=1, small_rows=0)
    ranked = ranked.where((F.col("id") <= max_words) & (F.col("id") > skip_top))
    return ranked.select("token", "count", (F.col("id") - skip_top).alias("id"))


def dictionary(df: DataFrame, tokens: str = "tokens", vocab_size: int = 10_000) -> DataFrame:
    """(token, count, id) of the `vocab_size` most frequent tokens."""
    return vocabulary(df, tokens, vocab_size, skip_top=0)


def token_ids(
    df: DataFrame,
    key: str | list[str],
    vocab: DataFrame,
    tokens: str = "tokens",
    out: str = "ids",
    unknown: int | None = None,
    shift: int = 0,
) -> DataFrame:
    """(key, ids): the ids of a row's tokens in order, one row per key.

    Unknown tokens are dropped, or become `unknown`; `shift` is added to every id. The
    vocabulary is counted: broadcast when small, so that tokens are sent once, else a sort-merge join.
    """
    key = as_list(key)
    need(df, *key, tokens)
    spread = df.select(*key, F.posexplode_outer(tokens).alias("_at", "token"))
    found = spread.join(_sent_whole(vocab.select("token", "id"), BROADCAST_ROWS), "token", "left")
    code = F.col("id") if unknown is None else F.coalesce("id", F.lit(unknown))
    pair = F.when(F.col("_at").isNotNull() & code.isNotNull(), F.struct("_at", (code + shift).cast("long").alias("id")))
    return (
        found.groupBy(*key)
        .agg(F.sort_array(F.collect_list(pair)).alias("_p"))
        .select(*key, F.col("_p.id").alias(out))
    )


def _sent_whole(df: DataFrame, rows: int) -> DataFrame:
    """`df`, to be broadcast if it has at most `rows` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _known_vectors(vectors: DataFrame, dim: int) -> DataFrame:
    """(id, _v double array) of a table (id, vector); broadcast if small, so that no vector travels with a token."""
    return _sent_whole(vectors.select("id", F.col("vector").cast("array<double>").alias("_v")), BROADCAST_BYTES // (8 * dim))


def pad_ids(
    df: DataFrame, ids: str = "ids", length: int = 500, pad: int = 0, side: str = "left", keep: str = "last",
    out: str | None = None,
) -> DataFrame:
    """Exactly `length` ids per row: the last ones by default, padded on the left."""
    need(df, ids)
    return df.withColumn(out or ids, arrays.pad(ids, length, F.lit(pad).cast("long"), side, keep))


def token_vectors(
    df: DataFrame, key: str | list[str], vectors: DataFrame, dim: int, ids: str = "ids", out: str = "vectors",
    pad: int | None = None, keep_ids: bool = False,
) -> DataFrame:
    """(key, vectors): one vector per id in order, the zero vector where `vectors` has none.

    `vectors` is (id, vector). Places of the id `pad` get the zero vector whatever `vectors` holds; their join key is
    spread and matches nothing, so padding is never a hot key. With `keep_ids` the ids come out beside their vectors.
    """
    key = as_list(key)
    need(df, *key, ids)
    zero = F.array_repeat(F.lit(0.0), dim)
    spread = df.select(*key, F.posexplode_outer(ids).alias("_at", "_own"))
    known = _known_vectors(vectors, dim)
    padding = F.lit(False) if pad is None else F.col("_own") == F.lit(pad)
    spread = spread.withColumn("_pad", F.coalesce(padding, F.lit(False)))
    spread = spread.withColumn("_spread", F.when(F.col("_pad"), F.xxhash64(*key, "_at")).otherwise(F.col("_own")))
    found = spread.join(known, (F.col("_spread") == F.col("id")) & ~F.col("_pad"), "left")
    own = [F.col("_own").alias("own")] if keep_ids else []
    once = F.filter("_p", lambda p, i: (i == 0) | (p["_at"] != F.get("_p", i - 1)["_at"]))  # `vectors` may hold an id twice
    pair = F.when(F.col("_at").isNotNull(), F.struct("_at", F.coalesce("_v", zero).alias("v"), *own))
    return (
        found.groupBy(*key)
        .agg(F.sort_array(F.collect_list(pair)).alias("_p"))
        .select(*key, *([F.transform(once, lambda p: p["own"]).alias(ids)] if keep_ids else []), F.col("_p.v").alias(out))
    )


def mean_vectors(
    df: DataFrame, key: str | list[str], vectors: DataFrame, dim: int, ids: str = "ids", out: str = "features"
) -> DataFrame:
    """(key, features): mean of the vectors of a row's ids, ids without a vector count as zero.

    One aggregate of plain sums, which are kept per key in place: vectors of tokens are neither sorted nor sent.
    """
    key = as_list(key)
    need(df, *key, ids)
    spread = df.select(*key, F.explode_outer(ids).alias("id"))
    found = spread.join(_known_vectors(vectors, dim), "id", "left")
    wrong = F.col("_v").isNotNull() & (F.size("_v") != dim)
    sums = [F.coalesce(F.sum(F.get("_v", F.lit(i))), F.lit(0.0)) for i in range(dim)]
    misfit = F.raise_error(F.lit(f"a vector does not have {dim} values")).cast("double")
    means = F.array(*[x / F.count(F.lit(1)) for x in sums])
    return found.groupBy(*key).agg(F.when(F.count_if(wrong) > 0, F.array(misfit)).otherwise(means).alias(out))


def sentence_tokens(df: DataFrame, key: str | list[str], text: str) -> DataFrame:
    """(key, sentence, tokens): sentences in order, between start and end markers.

    A sentence ends at . ! or ? followed by white space; tokens are split at white space.
    """
    key = as_list(key)
    need(df, *key, text)
    cut = F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\u0001"), "\u0001")
    sentences = df.select(*key, F.posexplode_outer(cut).alias("sentence", "_s"))  # outer: see word_counts
    tokens = F.filter(F.split("_s", r"\s+"), lambda t: t != "")
    return sentences.withColumn("_t", tokens).where(F.size("_t") > 0).select(
        *key,
        "sentence",
        F.concat(F.array(F.lit(SENTENCE_START)), F.col("_t"), F.array(F.lit(SENTENCE_END))).alias("tokens"),
    )


def line_words(text) -> Column:
    """Words of a line split at single spaces (trailing empty ones dropped), then `<eos>`."""
    col = F.col(text) if isinstance(text, str) else text
    bare = F.rtrim(col)
    parts = F.when((bare == "") & (col != ""), F.array().cast("array<string>")).otherwise(F.split(bare, " "))
    return F.concat(parts, F.array(F.lit(END_OF_LINE)))


def corpus_ids(lines: DataFrame, key: str | list[str], vocab: DataFrame, text: str = "value") -> DataFrame:
    """(key, ids): word ids plus one of every line, unknown words counting as id zero."""
    with_words = lines.withColumn("_words", line_words(text))
    return token_ids(with_words, key, vocab, "_words", unknown=0, shift=1)


def id_stream(lines: DataFrame, key: str | list[str], vocab: DataFrame, text: str = "value") -> DataFrame:
    """(key, place, id): the ids of `corpus_ids` as rows, one stream over all lines in the order of (key, place)."""
    key = as_list(key)
    need(lines, *key, text)
    spread = lines.select(*key, F.posexplode(line_words(text)).alias("place", "token"))
    found = spread.join(vocab.select("token", "id"), "token", "left")
    return found.select(*key, "place", (F.coalesce("id", F.lit(0)) + 1).cast("long").alias("id"))


def prompt_words(text) -> Column:
    """Words of a prompt line, split at runs of other characters."""
    return F.split(F.col(text) if isinstance(text, str) else text, r"\W+")


def longest(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """One row (longest): the largest number of tokens in a row."""
    need(df, tokens)
    return df.agg(F.max(F.size(tokens)).alias("longest"))


def next_token_pairs(
    df: DataFrame, ids: str = "ids", length: int | None = None, feature_pad: int = 0, label_pad: int = 0
) -> DataFrame:
    """Add `input` (all ids but the last) and `target` (all but the first), padded on the right.

    `length` is the fixed length both are padded to, an error if a row is longer; None leaves them as they are.
    """
    need(df, ids)
    n = F.greatest(F.size(ids) - 1, F.lit(0))
    if length is not None:  # nothing is ever cut
        n = F.when(n > length, F.raise_error(F.lit(f"a row has more than {length} pairs")).cast("int")).otherwise(n)
    source, target = F.slice(ids, F.lit(1), n), F.slice(ids, F.lit(2), n)
    if length is not None:
        kind = df.schema[ids].dataType.elementType
        source = arrays.pad(source, length, F.lit(feature_pad).cast(kind), "right", "first")
        target = arrays.pad(target, length, F.lit(label_pad).cast(kind), "right", "first")
    return df.withColumns({"input": source, "target": target})


def one_hot(df: DataFrame, key: str | list[str], width: int, ids: str = "input", out: str = "vector") -> DataFrame:
    """(key, pos, id, vector): a sparse one-hot vector of `width` places per id."""
    key = as_list(key)
    need(df, *key, ids)
    encoder = OneHotEncoder(inputCol="id", outputCol=out, dropLast=False)
    model = encoder.fit(df.sparkSession.range(width - 1, width))  # the width is the largest id plus one
    rows = df.select(*key, F.posexplode(ids).alias("pos", "_id"))
    return model.transform(rows.withColumn("id", F.col("_id").cast("double")).drop("_id"))


def word_vectors(lines: DataFrame, vocab: DataFrame, text: str = "value") -> DataFrame:
    """(id, token, vector) from lines `word f1 … fn`, for the words of the vocabulary."""
    need(lines, text)
    parts = F.split(text, " ")
    rows = lines.select(F.get(parts, F.lit(0)).alias("token"), F.slice(parts, F.lit(2), F.size(parts) - 1).alias("_v"))
    return rows.join(vocab.select("token", "id"), "token").select(
        "id", "token", F.col("_v").cast("array<double>").alias("vector")
    )
