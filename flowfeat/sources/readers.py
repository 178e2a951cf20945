"""Readers with explicit schemas; nothing is inferred and nothing is read on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowfeat.columns import need
from flowfeat.functions.arrays import length_of

REVIEWS = "asin string, overall double, reviewerID string, unixReviewTime long"
ITEM_META = "asin string, categories array<array<string>>"
SERIES = "timestamp string, value float"


def reviews(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REVIEWS).json(path)


def item_meta(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ITEM_META).json(path)


def split_records(lines: DataFrame, schema: str, sep: str = "::", text: str = "value", fields: int | None = None) -> DataFrame:
    """Lines of `sep`-separated fields as typed columns, in the order of `schema`.

    A field that does not parse, or is missing, fails the job. `fields` demands an exact
    number of fields; otherwise further fields are ignored.
    """
    need(lines, text)
    parts = F.split(text, rf"\Q{sep}\E")
    if fields is not None:
        bad = F.concat(F.lit(f"expected {fields} fields: "), F.col(text))
        parts = F.when(length_of(parts) == fields, parts).otherwise(F.raise_error(bad).cast("array<string>"))
    cols = T.StructType.fromDDL(schema).fields
    split = lines.select(parts.alias("_p"))
    return split.select(*[F.element_at("_p", i + 1).cast(c.dataType).alias(c.name) for i, c in enumerate(cols)])


def ratings(spark: SparkSession, path: str, doubles: bool = False) -> DataFrame:
    """`user::item::rating[::…]` as (userId, itemId, label) in ints, or as double ids and label."""
    schema = "userIdIndex double, itemIdIndex double, label double" if doubles else "userId int, itemId int, label int"
    return split_records(spark.read.text(path), schema)


def ratings_strict(spark: SparkSession, path: str) -> DataFrame:
    """`user::item::rating::time` with exactly four fields per line."""
    return split_records(spark.read.text(path), "userId int, movieId int, rating float, timestamp long", fields=4)


def users(spark: SparkSession, path: str) -> DataFrame:
    return split_records(spark.read.text(path), "userId int, gender string, age int, occupation int")


def items(spark: SparkSession, path: str) -> DataFrame:
    """`item::title::g1|g2|…`; only the first genre is kept."""
    rows = split_records(spark.read.text(path), "itemId int, title string, genres string")
    return rows.withColumn("genres", F.substring_index("genres", "|", 1))


def card_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, all columns strings, malformed rows left out.

    A row is judged by all its fields, whichever columns a query needs; with column pruning
    the parser would let a short row pass.
    """
    reader = spark.read.option("header", True).option("mode", "DROPMALFORMED")
    return reader.option("columnPruning", False).csv(path)


def series_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SERIES).option("header", True).csv(path)


def sensor_means(spark: SparkSession, folder: str, manifest: str = "timestamp.txt", columns: int | None = 1) -> DataFrame:
    """(ts, value) or (ts, value_1 …): column means of every tab-separated file in the manifest.

    The files are read by Spark as one table and averaged per file name, which is also the
    time stamp; the manifest decides which of them count. `columns=None` takes all there are,
    as many as the widest line has.
    """
    listed = spark.read.text(f"{folder}/{manifest}").select(F.trim("value").alias("ts")).where("ts <> ''").distinct()
    parts = F.split("value", "\t")
    lines = spark.read.text(folder).select(F.col("_metadata.file_name").alias("_f"), "value")
    lines = lines.where((F.col("_f") != manifest) & (F.trim("value") != ""))
    if columns is None:
        columns = lines.agg(F.max(F.size(parts))).first()[0] or 1
    values = [F.get(parts, F.lit(i)).cast("double").alias(f"value_{i + 1}") for i in range(columns)]
    decoded = F.url_decode(F.replace("_f", F.lit("+"), F.lit("%2B")))  # file names come percent-encoded
    names = lines.select(decoded.alias("ts"), *values)
    means = names.groupBy("ts").agg(*[F.avg(f"value_{i + 1}").alias(f"value_{i + 1}") for i in range(columns)])
    means = means.join(listed, "ts", "left_semi")
    return means.withColumnRenamed("value_1", "value") if columns == 1 else means


def labelled_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """(file, directory, label, text): one row per digit-named file of every sub-directory.

    The label is the 1-based place of the directory in name order; text is ISO-8859-1.
    """
    from flowfeat.operators.ids import dense_index

    files = spark.read.format("binaryFile").load(f"{folder}/*/*")
    named = files.select(
        F.element_at(F.split("path", "/"), -1).alias("file"),
        F.element_at(F.split("path", "/"), -2).alias("directory"),
        "content",
    )
    labels = dense_index(named.select("directory"), "directory", "label", start=1)
    texts = named.where(F.col("file").rlike("^[0-9]+$")).join(labels, "directory")
    return texts.select("file", "directory", "label", F.decode("content", "ISO-8859-1").alias("text"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file; a missing path is an error."""
    return spark.read.text(path)


def indexed_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def rows(spark: SparkSession, values: list, schema: str) -> DataFrame:
    """A small table from values in the program."""
    return spark.createDataFrame(values, schema)


def csv_rows(spark: SparkSession, values: list[str], names: list[str], sep: str = ",") -> DataFrame:
    """Separated lines held in the program as a table of strings."""
    table = spark.createDataFrame([(v,) for v in values], "value string")
    return split_records(table, ", ".join(f"`{n}` string" for n in names), sep=sep, fields=len(names))
