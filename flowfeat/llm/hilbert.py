"""Shards as runs of a Hilbert curve over several metadata dimensions.

Every dimension is quantised into 2^BITS cells of about equal row counts, the cell numbers of a row give its place on
the Hilbert curve, rows are sorted by it, and the sorted rows are cut into runs of equal row counts (law `rows`) or of
nearly equal bytes (law `bytes`). Rows that are close in all dimensions lie in few shards, so the smallest and largest values
that `manifest` keeps for every shard and dimension let a reader skip most shards whichever dimension it filters.

Nothing is sorted in one task. The curve has at most 2^(BITS * dimensions) cells, whatever is read; rows are counted by
cell, a cell with many rows is dealt into parts of about GROUP_ROWS by a hash, running totals over the counted parts (at
most cells + PARTS rows) say where each part begins, and rows are numbered inside their part. Borders come from the
counts of all values, above VALUES of them by running sums over ranges of the order. They decide only how well the curve
separates, never whether a row is placed. Only DataFrame functions are used.

Defined cases: a null text counts as empty (16 bytes, CRC 0); null in a dimension is the cell before all values; ties
on the curve go by part, CRC of the text and doc_id (null first), so equal texts of one cell and part are neighbours; rows
equal in id and text are interchangeable and meet in one part; an empty table gives no rows; a dimension that
is missing from the table is an error; all other columns are kept by `sharded`, with names that may clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowfeat.llm.common import shared_folder, stored, tuned

BITS = 5
VALUES = 4096
GROUP_ROWS = 100_000
PARTS = 1_000_000
OVERHEAD = 16  # bytes of a row besides its text


def curve(dims: int) -> tuple[list[int], int]:
    """Transitions of the Hilbert curve: at `state << dims | bits` the digit and the next state, `digit << 16 | state`.

    A state is an entry corner and a direction; in it the sub-cubes are visited in the order of a Gray code that is
    turned and mirrored to begin at the corner and to end one step along the direction.
    """
    full = (1 << dims) - 1

    def turned(x: int, by: int) -> int:
        by %= dims
        return ((x << by) | (x >> (dims - by))) & full

    def gray(i: int) -> int:
        return i ^ (i >> 1)

    def ones_below(i: int) -> int:
        return (~i & (i + 1)).bit_length() - 1  # trailing one bits

    rank = {gray(i): i for i in range(1 << dims)}
    states, table = {(0, 0): 0}, []
    todo = [(0, 0)]
    while todo:
        corner, axis = todo.pop(0)
        for bits in range(1 << dims):
            digit = rank[turned(bits ^ corner, -(axis + 1))]
            entry = gray(2 * ((digit - 1) // 2)) if digit else 0
            along = 0 if digit == 0 else ones_below(digit - 1 if digit % 2 == 0 else digit) % dims
            after = (corner ^ turned(entry, axis + 1), (axis + along + 1) % dims)
            if after not in states:
                states[after] = len(states)
                todo.append(after)
            table.append(digit << 16 | states[after])
    return table, len(states)


def curve_index(cells: list[Column], bits: int = BITS) -> Column:
    """Place on the curve of the cell with these coordinates, each 0 … 2^bits - 1."""
    dims = len(cells)
    table = F.array(*[F.lit(x) for x in curve(dims)[0]])
    levels = []
    for level in reversed(range(bits)):
        parts = [F.shiftleft(F.shiftright(c.cast("int"), level).bitwiseAND(F.lit(1)), j) for j, c in enumerate(cells)]
        corner = parts[0]
        for p in parts[1:]:
            corner = corner.bitwiseOR(p)
        levels.append(corner)

    def step(acc: Column, corner: Column) -> Column:
        state = acc.bitwiseAND(F.lit(0xFFFF)).cast("int")
        move = F.element_at(table, F.shiftleft(state, dims).bitwiseOR(corner) + 1)
        place = F.shiftleft(F.shiftright(acc, 16), dims).bitwiseOR(F.shiftright(move, 16).cast("bigint"))
        return F.shiftleft(place, 16).bitwiseOR(move.bitwiseAND(F.lit(0xFFFF)).cast("bigint"))

    return F.shiftright(F.aggregate(F.array(*levels), F.lit(0).cast("bigint"), step), 16)


def borders(rows: DataFrame, column: str, cells: int, values: int = VALUES) -> list:
    """Ascending first values of the cells of a dimension, from the counts of all its values; null lies before the first one.

    Up to `values` different values are added up here. More are sorted by Spark over ranges of the order and added up there: the
    ranges first, of which there are at most `values`, then the values of each; a row per border comes back.
    """
    counts = stored(rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("count")))
    picked = sorted(counts.limit(values + 1).collect())
    if len(picked) < cells:
        return [r["value"] for r in picked]
    if len(picked) > values:
        return _far_borders(counts, cells, values)
    total, done, out, last = sum(r["count"] for r in picked), 0, [], -1
    for r in picked:
        cell = done * (cells - 1) // total  # cell 0 belongs to null
        if cell > last:
            out.append(r["value"])
            last = cell
        done += r["count"]
    return out


def _far_borders(counts: DataFrame, cells: int, values: int) -> list:
    """The same borders, where the values are too many for one task."""
    parts = min(values, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = stored(counts.repartitionByRange(parts, "value").withColumn("part", F.spark_partition_id()))
    ranges = ranged.groupBy("part").agg(F.sum("count").alias("n"))
    before = lambda w, n: F.coalesce(F.sum(n).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = ranges.select(F.col("part").alias("p"), before(W.orderBy("part"), "n").alias("base"))  # at most `values` rows
    own = ranged.withColumn("own", before(W.partitionBy("part").orderBy("value"), "count"))
    placed = own.join(F.broadcast(bases), F.col("part") == F.col("p"))
    total = ranges.agg(F.sum("n")).first()[0]
    cell = F.expr(f"(base + own) * {cells - 1} div {total}")
    firsts = placed.groupBy(cell.alias("cell")).agg(F.min("value").alias("value"))  # a row a cell
    return sorted(r["value"] for r in firsts.collect())


def quantised(column: Column, edges: list, cells: int) -> Column:
    """Cell of a value: the number of borders that it reaches, spread over all cells."""
    if not edges:
        return F.lit(0)
    reached = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= column))
    return F.when(column.isNull(), 0).otherwise(F.floor(reached * cells / (len(edges) + 1)).cast("int"))


def measures() -> tuple[Column, Column]:
    """Size of a row, and the unsigned CRC of its text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return (F.octet_length(text) + OVERHEAD).cast("bigint"), F.crc32(text.cast("binary"))


class Layout:
    """Where every row of a table goes, learnt from the table (`size`, `crc`, `doc`, and the dimensions)."""

    def __init__(self, rows: DataFrame, dims: list[str], shards: int, law: str = "rows", bits: int = BITS, group_rows: int = GROUP_ROWS):
        if law not in ("rows", "bytes"):
            raise ValueError(f"law {law!r}: rows or bytes")
        self.shards, self.law, self.cells = shards, law, 1 << bits
        edges = {d: borders(rows, d, self.cells) for d in dims}
        self.cell = curve_index([quantised(F.col(d), edges[d], self.cells) for d in dims], bits)
        placed = stored(rows.select("doc", "size", "crc", self.cell.alias("cell")))
        counts = stored(placed.groupBy("cell").agg(F.count("*").alias("n"), F.sum("size").alias("b")))
        self.rows, self.bytes = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
        limit = max(group_rows, self.rows // PARTS)
        # at most 2^(bits * dimensions) rows of 16 bytes
        self.parts = F.broadcast(counts.select("cell", F.ceil(F.col("n") / limit).cast("int").alias("parts")))
        sums = self.dealt(placed).groupBy("cell", "part").agg(F.count("*").alias("n"), F.sum("size").alias("b"))
        before = W.orderBy("cell", "part").rowsBetween(W.unboundedPreceding, -1)
        self.starts = stored(
            sums.select(
                F.col("cell").alias("c"),
                F.col("part").alias("p"),
                F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"),
                F.coalesce(F.sum("b").over(before), F.lit(0)).alias("first_byte"),
            )
        )

    def dealt(self, rows: DataFrame) -> DataFrame:
        """Rows with a `cell`, and the part of it: by a hash of the id and the text, so that copies of a text spread."""
        return rows.join(self.parts, "cell").withColumn("part", F.pmod(F.xxhash64("doc", "crc"), F.col("parts")).cast("int")).drop("parts")

    def place(self, rows: DataFrame) -> DataFrame:
        """`rows` (doc, size, crc, the dimensions, …) with `shard` and `slot`."""
        group = W.partitionBy("cell", "part").orderBy("crc", F.asc_nulls_first("doc"), "size")
        parts = self.dealt(rows.withColumn("cell", self.cell))
        joined = parts.join(self.starts, (F.col("cell") == F.col("c")) & (F.col("part") == F.col("p")))
        at = F.col("first") + F.row_number().over(group) - 1
        if self.law == "rows":
            out = joined.withColumn("at", at).withColumn("shard", F.expr(f"int(at * {self.shards} div {self.rows})"))
            first = F.expr(f"(shard * {self.rows}L + {self.shards - 1}) div {self.shards}")
            return out.withColumn("slot", F.col("at") - first)
        own = F.coalesce(F.sum("size").over(group.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        run = -(-self.bytes // self.shards)
        out = joined.withColumns({"at": at, "before": F.col("first_byte") + own})
        out = out.withColumn("shard", F.expr(f"int(before div {max(run, 1)})"))
        first = out.groupBy("shard").agg(F.min("at").alias("lowest")).withColumnRenamed("shard", "s")  # a row a shard
        return out.join(first, F.col("shard") == F.col("s")).withColumn("slot", F.col("at") - F.col("lowest"))


def measured(docs: DataFrame, dims: list[str]) -> DataFrame:
    """doc, size, crc, and the dimensions as d0, d1, …; `size` is one that any table has."""
    missing = [d for d in dims if d != "size" and d not in docs.columns]
    if missing:
        raise ValueError(f"missing column(s) {missing}")
    size, crc = measures()
    return docs.select(
        F.col("doc_id").alias("doc"), size.alias("size"), crc.alias("crc"),
        *[(size if d == "size" else F.col(f"`{d}`")).alias(f"d{j}") for j, d in enumerate(dims)],
    )


def assigned(docs: DataFrame, dims: list[str], shards: int, law: str = "rows", bits: int = BITS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot of every row of `docs` (doc_id, text, the dimensions). Texts are read once."""
    tuned(docs.sparkSession)
    rows = stored(measured(docs, dims))
    layout = Layout(rows, [f"d{j}" for j in range(len(dims))], shards, law, bits, group_rows)
    return layout.place(rows).select(
        F.col("doc").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit(law).alias("law"), "shard", "slot"
    )


def sharded(docs: DataFrame, dims: list[str], shards: int, law: str = "rows", bits: int = BITS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """row (a struct of all columns of `docs`), size, d0, d1, … (the dimensions), shard and slot of every row."""
    tuned(docs.sparkSession)
    names = [f"d{j}" for j in range(len(dims))]
    layout = Layout(stored(measured(docs, dims)), names, shards, law, bits, group_rows)
    size, crc = measures()
    whole = docs.select(
        F.struct("*").alias("row"), F.col("doc_id").alias("doc"), size.alias("size"), crc.alias("crc"),
        *[(size if d == "size" else F.col(f"`{d}`")).alias(n) for d, n in zip(dims, names)],
    )
    return layout.place(whole).select("row", "size", *names, "shard", "slot")


def write_shards(rows: DataFrame, folder: str | None = None, files: int | None = None) -> str:
    """Write what `sharded` returns as one folder a shard, in the order of the curve; `files` tasks write. Returns the folder."""
    spark = rows.sparkSession
    folder = folder or shared_folder(spark)
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.select("row.*", F.col("shard").alias("_shard")).write.partitionBy("_shard").parquet(folder)
    return folder


def manifest(rows: DataFrame) -> DataFrame:
    """shard, n_rows, n_bytes, and lo and hi of every dimension with its number of nulls, a row a shard."""
    dims = [c for c in rows.columns if c.startswith("d") and c[1:].isdigit()]
    ends = [f for d in dims for f in (F.min(d).alias(f"{d}_lo"), F.max(d).alias(f"{d}_hi"), F.count_if(F.col(d).isNull()).alias(f"{d}_nulls"))]
    return rows.groupBy("shard").agg(F.count("*").alias("n_rows"), F.sum("size").alias("n_bytes"), *ends)


def touched(kept: DataFrame, ranges: dict[str, tuple]) -> DataFrame:
    """Rows of a manifest whose shards may hold a row inside all `ranges` (dimension: smallest and largest value)."""
    for d, (lo, hi) in ranges.items():
        kept = kept.where((F.col(f"{d}_lo") <= F.lit(hi)) & (F.col(f"{d}_hi") >= F.lit(lo)))
    return kept
