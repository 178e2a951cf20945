"""Model input rows: pairs, joined embeddings, wide and deep features."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowfeat.columns import as_list, need
from flowfeat.functions import arrays
from flowfeat.functions.hashing import hash_uniform

# The code of a value is its place in these lists, counted from one.
GENDERS = ["F", "M"]
GENRES = [
    "Crime", "Romance", "Thriller", "Adventure", "Drama", "Children's", "War", "Documentary", "Fantasy",
    "Mystery", "Musical", "Animation", "Film-Noir", "Horror", "Western", "Comedy", "Action", "Sci-Fi",
]
CROSS_BUCKETS = 100


def pair_features(df: DataFrame, user: str, item: str, label: str = "label", shuffle_seed: int | None = None) -> DataFrame:
    """(label double, features vector [user, item]); ids must not be negative."""
    need(df, user, item, label)
    values = arrays.all_non_negative(F.array(F.col(user).cast("double"), F.col(item).cast("double")))
    rows = df.select(F.col(label).cast("double").alias("label"), array_to_vector(values).alias("features"))
    return rows if shuffle_seed is None else rows.orderBy(F.rand(shuffle_seed))


def concat_embeddings(df: DataFrame, left: str, right: str, size: int | None = None, out: str = "features") -> DataFrame:
    """Add the two arrays joined to one array of double; fails where the size is not `size`."""
    need(df, left, right)
    return df.withColumn(out, arrays.concat_vectors(left, right, size))


def embedding_rows(df: DataFrame, left: str, right: str, label: str = "label", size: int | None = None) -> DataFrame:
    """(label double, features vector) from two embedding columns."""
    need(df, left, right, label)
    vector = array_to_vector(arrays.concat_vectors(left, right, size))
    return df.select(F.col(label).cast("double").alias("label"), vector.alias("features"))


def cosine(df: DataFrame, left: str, right: str, out: str = "cosine", absolute: bool = True) -> DataFrame:
    need(df, left, right)
    return df.withColumn(out, (arrays.abs_cosine if absolute else arrays.cosine)(left, right))


def vocab_code(col, vocab: list[str]) -> Column:
    """Place in the list counted from one; 0 for values that are not in it."""
    listed = F.array(*[F.lit(v) for v in vocab])
    return F.coalesce(F.array_position(listed, F.col(col) if isinstance(col, str) else col), F.lit(0)).cast("int")


def cross_bucket(*cols, buckets: int = CROSS_BUCKETS, hash: str = "murmur3", seed: int = 42) -> Column:
    """Bucket of the joined column values."""
    if hash == "murmur3":
        return F.pmod(F.hash(*cols), F.lit(buckets)).cast("int")
    return hash_uniform(*cols, n=buckets, seed=seed, hash=hash).cast("int")


def wide_deep(
    ratings: DataFrame,
    users: DataFrame,
    items: DataFrame,
    user: str = "userId",
    item: str = "itemId",
    genders: list[str] = GENDERS,
    genres: list[str] = GENRES,
    buckets: int = CROSS_BUCKETS,
    hash: str = "murmur3",
) -> DataFrame:
    """Ratings joined with coded user and item columns.

    `gender` and `genres` become vocabulary codes, `age-gender` a hashed cross of the raw
    values; age and occupation pass through. Size of the joined sides decides the strategy.
    """
    need(ratings, user, item, "label")
    need(users, user, "gender", "age", "occupation")
    need(items, item, "genres")
    coded_users = users.select(
        user,
        vocab_code("gender", genders).alias("gender"),
        "age",
        "occupation",
        cross_bucket("age", "gender", buckets=buckets, hash=hash).alias("age-gender"),
    )
    coded_items = items.select(item, vocab_code("genres", genres).alias("genres"))
    joined = ratings.select(user, item, "label").join(coded_items, item).join(coded_users, user)
    return joined.select(user, item, "label", "gender", "age", "occupation", "genres", "age-gender")


def star_join(facts: DataFrame, *dims: tuple[DataFrame, str | list[str]]) -> DataFrame:
    """Facts joined with each (table, key) in turn."""
    for dim, key in dims:
        facts = facts.join(dim, as_list(key))
    return facts


def card_transactions(df: DataFrame, small_rows: int | None = None) -> DataFrame:
    """(uid, mid, amount, date, mcc) from card rows with the source's column titles.

    Cardholder and vendor ids start at one, category ids at zero, most frequent value first.
    """
    from flowfeat.functions.dates import date_to_int
    from flowfeat.operators.ids import frequency_index
    from flowfeat.operators.positions import SMALL_ROWS

    rows = df.select(
        F.concat("Cardholder Last Name", F.lit(" "), "Cardholder First Initial").alias("name"),
        F.col("Amount").try_cast("double").alias("amount"),
        F.col("Vendor").alias("vendor"),
        date_to_int("Transaction Date").alias("date"),
        F.col("Merchant Category Code (MCC)").alias("mccStr"),
    )
    coded = frequency_index(rows, ["name", "vendor", "mccStr"], {"name": 1, "vendor": 1}, small_rows or SMALL_ROWS)
    return coded.select(
        F.col("name_index").alias("uid"), F.col("vendor_index").alias("mid"), "amount", "date",
        F.col("mccStr_index").alias("mcc"),
    )
