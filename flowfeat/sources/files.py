"""Files as tables where the place of a line, or the name of its file, carries meaning."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowfeat.columns import as_list, need

CORRUPT = "_corrupt_record"


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path that the driver and all executors reach: below `spark.checkpoint.dir`, else in the warehouse."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/flowfeat-{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def checked_csv(spark: SparkSession, path: str, schema: str, header: bool = True, sep: str = ",") -> tuple[DataFrame, DataFrame]:
    """(rows that fit `schema`, quarantine): every line is in one of the two.

    The quarantine has the `file` and the `line` as it is in the file. A line is judged by all its fields, whichever
    columns a query reads.
    """
    whole = f"{schema}, {CORRUPT} string"
    reader = spark.read.schema(whole).option("header", header).option("sep", sep).option("mode", "PERMISSIVE")
    rows = reader.option("columnNameOfCorruptRecord", CORRUPT).option("columnPruning", False).csv(path)
    # the parser judges a line by the columns that are asked for, so all of them always are
    fields = [F.col(f"`{c}`") for c in rows.columns if c != CORRUPT]
    rows = rows.withColumn("_file", F.col("_metadata.file_path")).where(F.xxhash64(*fields) >= F.lit(-(1 << 63)))
    bad = rows.where(F.col(CORRUPT).isNotNull()).select(F.col("_file").alias("file"), F.col(CORRUPT).alias("line"))
    return rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT, "_file"), bad


def quarantine_report(good: DataFrame, bad: DataFrame) -> DataFrame:
    """One row (read, kept, quarantined)."""
    one, none = F.count(F.lit(1)), F.lit(0).cast("bigint")
    both = good.agg(one.alias("kept"), none.alias("quarantined")).unionByName(bad.agg(none.alias("kept"), one.alias("quarantined")))
    sums = both.agg(F.sum("kept").alias("kept"), F.sum("quarantined").alias("quarantined"))
    return sums.select((F.col("kept") + F.col("quarantined")).alias("read"), "kept", "quarantined")


def numbered_lines(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(file, line_no, value): every line with its place in its file, counted from zero.

    Files are read in blocks, many at a time. A block knows where it begins, its lines come in order, and the number of
    lines of each block, summed along the file, says which number the first line of a block has. Only block counts
    are put in order; no file is read by one task, and nothing depends on how blocks are dealt to tasks.
    """
    lines = spark.read.option("recursiveFileLookup", recursive).text(path)
    lines = lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value",
    )
    blocks = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select(
        F.col("file").alias("f"), F.col("block").alias("b"), "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    )
    placed = lines.join(blocks, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b")))
    return placed.select("file", (F.col("at") - F.col("first") + F.col("base")).alias("line_no"), "value")


def without_header(numbered: DataFrame, rows: int = 1) -> DataFrame:
    """The lines behind the first `rows` of each file, numbered from zero again."""
    return numbered.where(F.col("line_no") >= rows).withColumn("line_no", F.col("line_no") - rows)


def tree_means(spark: SparkSession, folder: str, manifest: DataFrame, columns: int, sep: str = "\t", key: str = "name") -> DataFrame:
    """(name, value_1 …): column means over all files of each directory of `folder` that the manifest (`name`) lists.

    The directory of a line comes from the hidden file metadata. Lines are summed per directory before the manifest is
    joined, so the join has a row for a directory.
    """
    need(manifest, key)
    parts = F.split("value", sep)
    lines = spark.read.option("recursiveFileLookup", True).text(folder)
    decode = lambda c: F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    once = decode(F.element_at(F.split("_metadata.file_path", "/"), -2))
    # the value in a name like key=value has escapes of its own
    directory = F.when(F.contains(once, F.lit("=")), F.coalesce(decode(once), once)).otherwise(once)
    cells = [F.get(parts, F.lit(i)).cast("double").alias(f"value_{i + 1}") for i in range(columns)]
    named = lines.where(F.trim("value") != "").select(directory.alias(key), *cells)
    means = named.groupBy(key).agg(*[F.avg(f"value_{i + 1}").alias(f"value_{i + 1}") for i in range(columns)])
    return means.join(manifest.select(key).distinct(), key, "left_semi")


def write_tree(rows: DataFrame, folder: str, directory: str, text: str, order: list | None = None, header: str | None = None) -> str:
    """Lines of the column `text` as files, in one directory (named by the value alone) for each value of `directory`.

    With `order` a directory has one file, whose lines are in that order; else as many as there are tasks.
    """
    need(rows, directory, text)
    if order is not None:
        rows = rows.repartition(directory).sortWithinPartitions(directory, *order)
    out = rows.select(F.col(text).alias("value"), F.col(directory).cast("string").alias("_d"))
    if header is None:
        out.write.partitionBy("_d").text(folder)
    else:
        out.withColumnRenamed("value", header).write.partitionBy("_d").option("header", True).option("quote", "\u0000").csv(folder)
    return folder


def save_indexed(df: DataFrame, key: str | list[str], buckets: int, name: str | None = None, path: str | None = None) -> str:
    """Store `df` as a table whose rows lie in `buckets` buckets by `key`, sorted in each; returns the table's name.

    Tables with the same number of buckets join and group on the key without an exchange. Each task would write a file for
    every bucket, so the rows are dealt by the key first; that is the one shuffle, paid when the table is written.
    """
    key = as_list(key)
    need(df, *key)
    spark = df.sparkSession
    name = name or f"flowfeat_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, *key).write.bucketBy(buckets, *key).sortBy(*key).format("parquet").mode("overwrite")
    writer.option("path", path or shared_path(spark, "indexed")).saveAsTable(name)
    return name


def indexed(spark: SparkSession, name: str) -> DataFrame:
    """A table of `save_indexed`."""
    return spark.table(name)


def drop_indexed(spark: SparkSession, name: str) -> None:
    """Delete a table of `save_indexed` with its files."""
    place = spark.sql(f"DESCRIBE FORMATTED {name}").where("col_name = 'Location'").first()["data_type"]
    spark.sql(f"DROP TABLE {name}")
    delete(spark, place)
