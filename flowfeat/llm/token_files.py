"""Token counts of documents in flat token files without an index.

A token file is the ids of all documents in a row, each in WIDTH bytes (little end first), an end-of-document id after
each document. Files are read in blocks wherever Spark's text source happens to cut them; a block knows neither how
many bytes come before it nor whether it begins inside an id. Each block therefore searches its bytes once, at every
alignment, for the separator, and reports the matches of each alignment with its length; a prefix scan over the
blocks of a file gives every block's place, hence its alignment, and where the document that it begins in began.

Defined cases: an empty file has no documents; ids after the last separator are one more document; two separators in
a row enclose an empty document; bytes that do not fill an id at the end of a file belong to
no document; null or empty texts give empty documents when files are written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowfeat.llm.common import by_value, stored, tuned

by_value(__name__)

WIDTH = 2


def write_token_files(encoded: DataFrame, folder: str, separator: int) -> None:
    """Write `encoded` (ids) as flat token files of 16-bit ids: one file per partition, in the order of its rows.

    The text sink writes bytes as they are and a line end after each row; the line end is the separator's bytes.
    """
    mark = separator.to_bytes(WIDTH, "little").decode("latin-1")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            flat = ids.flatten().to_numpy(zero_copy_only=False)
            if len(flat) and (flat.min() < 0 or flat.max() >= 1 << 8 * WIDTH or (flat == separator).any()):
                raise ValueError("an id does not fit a token file, or is the separator")
            data = flat.astype("<u2").tobytes()
            sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64) * WIDTH
            ends = np.cumsum(sizes)
            rows = [data[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["value"])

    rows = encoded.select("ids").mapInArrow(packed, "value binary")
    rows = rows.select(F.col("value").cast("string"))
    rows.write.option("lineSep", mark).option("encoding", "ISO-8859-1").text(folder)


# Bytes that a task searches at once.
BLOCK_BYTES = 4 << 20
_MARK = b"\xef\xbb\xbf"


def _found(data: np.ndarray, separator: int) -> list[np.ndarray]:
    """Places of the separator in a block's bytes, for each alignment."""
    out = []
    for lead in range(WIDTH):
        n = (len(data) - lead) // WIDTH
        ids = data[lead : lead + WIDTH * n].view("<u2") if n > 0 else np.zeros(0, "<u2")
        out.append(np.flatnonzero(ids == separator) * WIDTH + lead)
    return out


def scan_blocks(spark: SparkSession, folder: str, separator: int) -> DataFrame:
    """A row for each block of the token files in `folder`: where it lies among the others, its length, first and last
    byte, and the separators at even and odd alignment (`even`, `odd`, as byte places in the block)."""
    rows = (
        spark.read.option("lineSep", "\n")
        .text(folder)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_size").alias("file_size"),
            F.col("_metadata.file_block_start").alias("split"),
            F.col("value").cast("binary").alias("value"),
        )
    )
    schema = (
        "file string, file_size bigint, split bigint, part int, length bigint, first int, last int, even array<bigint>, odd array<bigint>"
    )

    def block(key: tuple, part: int, data: bytes) -> pa.RecordBatch:
        even, odd = _found(np.frombuffer(data, np.uint8), separator)
        row = dict(zip(("file", "file_size", "split"), key))
        row |= {"part": part, "length": len(data), "first": data[0], "last": data[-1], "even": even, "odd": odd}
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32()] + [pa.list_(pa.int64())] * 2
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds)], list(row))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of one split follow each other; they and the line ends between them are the split's bytes."""
        key, part, held, size = None, 0, [], 0
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("file", "file_size", "split"))))
            for new, value in zip(keys, batch.column("value").to_pylist()):
                if key is not None and (new != key or size >= BLOCK_BYTES):
                    yield block(key, part, b"".join(held))
                    part = part + 1 if new == key else 0
                    held, size = [], 0
                key = new
                held += (value, b"\n")
                size += len(value) + 1
        if key is not None:
            yield block(key, part, b"".join(held))

    return stored(rows.mapInArrow(search, schema))


def placed(blocks: DataFrame, separator: int) -> DataFrame:
    """The prefix scan: for each block its `offset` in the file, the documents that ended before it (`before`), the id
    after the last separator before it (`carry`), and whether an id that straddles its beginning is the separator."""
    order = Window.partitionBy("file").orderBy("split", "part")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    low, high = separator & 255, separator >> 8
    narrow = blocks.select(
        "file", "file_size", "split", "part", "length", "first", "last",
        *[F.size(c).cast("bigint").alias(f"n_{c}") for c in ("even", "odd")],
        *[F.try_element_at(c, F.lit(-1)).alias(f"last_{c}") for c in ("even", "odd")],
    )
    # the reader takes a byte order mark away: then three bytes are missing at the beginning
    missing = F.when(F.col("file_size") - F.sum("length").over(Window.partitionBy("file")) >= 2, len(_MARK)).otherwise(0)
    out = narrow.withColumn("missing", missing)
    out = out.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0)) + F.col("missing"))
    before = F.coalesce(F.lag("last").over(order), F.when(F.col("missing") > 0, F.lit(_MARK[-1])))
    odd = F.col("offset") % WIDTH == 1
    straddles = F.coalesce(odd & (before == low) & (F.col("first") == high), F.lit(False))
    out = out.withColumn("straddles", straddles).withColumn("is_odd", odd)
    count = F.when(odd, F.col("n_odd")).otherwise(F.col("n_even")) + F.col("straddles").cast("int")
    last = F.coalesce(F.when(odd, F.col("last_odd")).otherwise(F.col("last_even")), F.when(F.col("straddles"), F.lit(-1)))
    out = out.withColumn("count", count).withColumn("end", F.floor((F.col("offset") + last) / WIDTH))
    marked = F.lit(1 if separator == int.from_bytes(_MARK[:2], "little") else 0)
    first = F.when(F.col("missing") > 0, marked).otherwise(0)  # a separator inside the mark
    return out.select(
        "file", "file_size", "split", "part", "offset", "is_odd", "straddles",
        (F.coalesce(F.sum("count").over(earlier), F.lit(0)) + first).alias("before"),
        F.coalesce(F.max("end").over(earlier) + 1, first.cast("bigint")).alias("carry"),
        first.alias("marked"),
    )


def token_counts(spark: SparkSession, folder: str, separator: int) -> DataFrame:
    """`file`, `doc_no` (from 0), `begin` (first id), `n_tokens` of every document in the token files of `folder`."""
    tuned(spark)
    blocks = scan_blocks(spark, folder, separator)
    scan = stored(placed(blocks, separator))
    inner = F.when(F.col("is_odd"), F.col("odd")).otherwise(F.col("even"))
    spots = F.when(F.col("straddles"), F.concat(F.array(F.lit(-1).cast("bigint")), inner)).otherwise(inner)
    ends = (
        blocks.drop("file_size")
        .join(scan, ["file", "split", "part"])
        .select("file", "file_size", "offset", "before", "carry", spots.alias("spots"))
        .select("*", F.posexplode(F.arrays_zip(F.col("spots").alias("p"), F.concat(F.array(F.lit(None).cast("bigint")), F.slice("spots", 1, F.greatest(F.size("spots") - 1, F.lit(0)))).alias("q"))))
        .select(
            "file",
            "file_size",
            (F.col("before") + F.col("pos")).alias("doc_no"),
            F.coalesce(F.floor((F.col("offset") + F.col("col.q")) / WIDTH) + 1, F.col("carry")).alias("begin"),
            F.floor((F.col("offset") + F.col("col.p")) / WIDTH).alias("end"),
        )
        .where((F.col("end") + 1) * WIDTH <= F.col("file_size"))  # the line end that the reader lends to the last row
    )
    first = scan.where("marked = 1").select("file", "file_size", F.lit(0).cast("bigint").alias("doc_no"), F.lit(0).cast("bigint").alias("begin"), F.lit(0).cast("bigint").alias("end")).distinct()
    ends = ends.unionByName(first)
    last = ends.groupBy("file").agg(F.max("end").alias("e"), F.count("*").alias("n"))
    total = F.floor(F.col("file_size") / WIDTH)
    rest = (
        scan.select("file", "file_size").distinct().join(last, "file", "left")
        .select("file", F.coalesce("n", F.lit(0)).alias("doc_no"), F.coalesce(F.col("e") + 1, F.lit(0)).alias("begin"), total.alias("end"))
        .where("end > begin")
    )
    return ends.drop("file_size").unionByName(rest).select("file", "doc_no", "begin", (F.col("end") - F.col("begin")).alias("n_tokens"))
