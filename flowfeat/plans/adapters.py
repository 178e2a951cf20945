"""The driver's tables in the shapes the operators take. Whole tables, no row filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowfeat.operators import sampling

TIE = ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"]
DAY = 86_400


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def interactions(spark: SparkSession, folder: str, sides: list[float] | None = None) -> DataFrame:
    """One row per order line: user, item, time, rating 1 … 5, score, label and tie-breaks.

    `sides` are the weights of `sampling.hash_split`: `split` is added, worked out once per order and not once per line.
    """
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"),
        F.col("o_custkey").alias("user"),
        (F.datediff(F.col("o_orderdate"), F.lit("1970-01-01").cast("date")).cast("long") * DAY).alias("time"),
    )
    orders = sampling.hash_split(orders, "l_orderkey", sides) if sides else orders
    lines = table(spark, folder, "lineitem")
    mixed = F.col("l_orderkey") * 31 + F.col("item") * 17 + F.col("l_linenumber") * 7
    return (
        lines.join(orders, "l_orderkey")
        .withColumn("item", F.col("l_partkey"))
        .withColumn("rating", (1 + F.floor((F.col("l_quantity") - 1) / 10)).cast("long"))
        .withColumn("label", F.when(F.col("l_returnflag") == "R", F.lit(1.0)).otherwise(F.lit(0.0)))
        .withColumn("score", (mixed % 100) / F.lit(100.0))
        .select("user", "item", "time", "rating", "label", "score", *TIE, *(["split"] if sides else []))
    )


def reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Interactions under the names of the review files, with string keys."""
    return interactions(spark, folder).select(
        F.col("item").cast("string").alias("asin"),
        F.col("user").cast("string").alias("reviewerID"),
        F.col("rating").cast("double").alias("overall"),
        F.col("time").alias("unixReviewTime"),
        *TIE,
    )


def item_meta(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_partkey").cast("string").alias("asin"), F.array(F.array("p_type", "p_brand")).alias("categories")
    )


def scored(spark: SparkSession, folder: str) -> DataFrame:
    return interactions(spark, folder).select(F.col("user").alias("userIdIndex"), F.col("item").alias("itemIdIndex"), "score", "label")


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Hard predictions: score above one half."""
    flag = F.when(F.col("score") > 0.5, F.lit(1.0)).otherwise(F.lit(0.0))
    return scored(spark, folder).select(flag.alias("prediction"), "label")


def rating_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """True rating and a made-up predicted one."""
    return interactions(spark, folder).select(
        "user", "item", F.col("rating").alias("label"), (F.lit(1.0) + F.col("score") * 4).alias("prediction")
    )


def hourly(spark: SparkSession, folder: str) -> DataFrame:
    """Event counts per hour."""
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")
    return table(spark, folder, "events").groupBy(hour).agg(F.count(F.lit(1)).alias("value"))


def events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type", "value")


def cards(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as card transactions under the titles of the card files."""
    orders, lines = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    customers, parts, suppliers = (table(spark, folder, t) for t in ("customer", "part", "supplier"))
    # the lines are dealt by part and supplier while they are narrow, and meet the orders with their holders last
    held = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    joined = (
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(held, F.col("l_orderkey") == F.col("o_orderkey"))
    )
    return joined.select(
        F.substring_index("c_name", "#", -1).alias("Cardholder Last Name"),
        F.substring("c_mktsegment", 1, 1).alias("Cardholder First Initial"),
        F.col("l_extendedprice").cast("string").alias("Amount"),
        F.col("s_name").alias("Vendor"),
        F.concat(F.date_format(F.col("o_orderdate"), "MM/dd/yyyy"), F.lit(" 12:00:00 AM")).alias("Transaction Date"),
        F.col("p_type").alias("Merchant Category Code (MCC)"),
    )


def docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "text")


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings")


def vector_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector with the one that follows it, by an equi-join on the id."""
    left = vectors(spark, folder).select("vec_id", F.col("embedding").alias("userVec"), "label")
    right = vectors(spark, folder).select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("itemVec"))
    return left.join(right, "vec_id")


def rating_lines(spark: SparkSession, folder: str) -> DataFrame:
    return interactions(spark, folder).select(F.concat_ws("::", "user", "item", "rating", "time").alias("value"))


def wide_deep_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ratings, users and items in the columns of the wide and deep features."""
    ratings = interactions(spark, folder).select(
        F.col("user").alias("userId"), F.col("item").alias("itemId"), F.col("rating").alias("label")
    )
    users = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("userId"),
        F.when(F.col("c_acctbal") < 5000, "F").otherwise("M").alias("gender"),
        (F.col("c_nationkey") + 18).alias("age"),
        F.length("c_mktsegment").alias("occupation"),
    )
    items = table(spark, folder, "part").select(F.col("p_partkey").alias("itemId"), F.col("p_type").alias("genres"))
    return ratings, users, items
