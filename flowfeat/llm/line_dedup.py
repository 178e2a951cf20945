"""Removal of repeated line chunks whose boundaries depend on content alone, and of repeated runs of lines.

Each line has a hash; a rolling hash over WINDOW neighbouring line hashes starts a new chunk where it falls into one
of DIVISOR classes, so boundaries move with the text when lines are put in or taken out elsewhere. Chunks of several
lines are grouped over all documents by their hash; each occurrence is compared, byte by byte, with the earliest one
(by doc_id, then place), and goes if it is equal. Only DataFrame functions are used.

Chunks leave part of a repeated passage: those of one line, and the ends that share a chunk with other text. With
`whole`, which the query and the pipeline use, they are only the coarse step: outside of repeated chunks, every two
neighbouring lines are compared with their earliest occurrence in the same way, under the rolling hash of both. A repeated
passage of several lines consists of such pairs, so all of its lines go, wherever they lie.

Rows of a hash that occurs very often are dealt over SALTS join keys. Texts are shuffled once, by document: bytes to compare
are cut out, and what stays is put together, from the same exchange.

Defined cases: a null text stays null and has no lines, an empty one has one empty line; a null doc_id is an ordinary
value that comes last; equal rows (same doc_id and text) are one occurrence and change alike; single lines, and
chunks and pairs of blank lines only, stay; a text of which everything goes becomes empty; an empty table gives no rows; all other
columns are kept as they are, and names that the operator uses inside may occur among them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowfeat.llm.common import stored, tuned

WINDOW = 2
DIVISOR = 2
MIN_LINES = 2
_HEX = "0123456789abcdef"
HOT_TIMES = 10_000  # a hash that occurs more often is dealt over SALTS join keys
HOT_KEYS = 10_000  # no more hashes are, so their list may be broadcast
SALTS = 64
_LEAST = -(1 << 63)


def _mark(text: Column) -> Column:
    """Digest that tells apart texts under one doc_id; never null, so joins on it need no filter that differs."""
    return F.coalesce(F.unhex(F.md5(text)), F.lit(bytearray()))


def _cuts(codes: Column, n: Column, window: int, divisor: int) -> Column:
    """Begin and end of each chunk of lines with the digests `codes`."""
    # one array shifted against the other: every step is linear in the number of lines
    rolled = codes
    for k in range(1, window):
        empty = F.transform(F.sequence(F.lit(1), F.least(F.lit(k), n)), lambda i: F.lit(None).cast("string"))
        earlier = F.concat(empty, F.slice(codes, 1, F.greatest(n - k, F.lit(0))))
        rolled = F.zip_with(earlier, rolled, lambda a, b: F.concat(a, b))  # null where the window leaves the text
    ends = list(_HEX[: 16 // divisor])
    places = F.transform(
        rolled, lambda r, i: F.when((i == 0) | F.coalesce(F.substring(F.md5(r), 32, 1).isin(ends), F.lit(False)), i)
    )
    starts = F.filter(places, lambda i: i.isNotNull())
    return F.zip_with(starts, F.concat(F.slice(starts, 2, F.size(starts)), F.array(n)), lambda b, e: F.struct(b.alias("begin"), e.alias("end")))


def _keyed(docs: DataFrame) -> DataFrame:
    """Columns c0, c1, … of `docs`, and `mark`: plain names, so that none can clash."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.withColumn("mark", _mark(F.col(f"c{docs.columns.index('text')}")))


def _spots(keyed: DataFrame, doc: str, text: str, window: int, divisor: int, min_lines: int, whole: bool) -> DataFrame:
    """`doc`, `mark`, `begin`, `end`, `hash`, `chunk`, `is_chunk` of every chunk of several lines and, if `whole`, every pair.

    A hash is that of the lines' digests; spots of blank lines only have none. `chunk` is where the chunk begins that a spot lies
    in whole. With `whole`, a chunk with two blank lines in a row is left to its pairs.
    """
    lines = keyed.where(F.col(text).isNotNull()).select(F.col(doc).alias("doc"), "mark", F.split(text, "\n", -1).alias("lines"))
    lines = lines.select("doc", "mark", F.transform("lines", lambda x: F.struct(F.md5(x).alias("code"), (F.trim(x) == "").alias("blank"))).alias("l"))
    following = F.slice("l", 2, F.size("l"))
    pairs = F.zip_with("l", following, lambda a, b: F.when(b.isNotNull() & ~(a["blank"] & b["blank"]), F.unhex(F.md5(F.concat(a["code"], b["code"])))))
    cut = lines.select("doc", "mark", "l", pairs.alias("pairs"), _cuts(F.col("l.code"), F.size("l"), window, divisor).alias("cuts"))

    def listed(c: Column) -> Column:
        begin, end = c["begin"], c["end"]
        inside = F.slice("pairs", begin + 1, end - begin - 1)
        enough = F.forall if whole else F.exists
        name = F.unhex(F.md5(F.array_join(F.slice(F.col("l.code"), begin + 1, end - begin), "")))
        name = F.when((end - begin >= max(min_lines, 2)) & enough(inside, lambda h: h.isNotNull()), name)
        chunk = F.array(F.struct(begin.alias("begin"), end.alias("end"), name.alias("hash"), begin.alias("chunk"), F.lit(True).alias("is_chunk")))
        if not whole:
            return chunk

        def pair(h: Column, i: Column) -> Column:
            at = begin + i
            return F.struct(at.alias("begin"), (at + 2).alias("end"), h.alias("hash"), F.when(at + 1 < end, begin).alias("chunk"), F.lit(False).alias("is_chunk"))

        return F.concat(chunk, F.transform(F.slice("pairs", begin + 1, end - begin), pair))

    spots = F.filter(F.flatten(F.transform("cuts", listed)), lambda s: s["hash"].isNotNull())
    spread = cut.select("doc", "mark", F.explode_outer(spots).alias("s")).where("s.hash IS NOT NULL")
    return spread.select("doc", "mark", "s.*")


def _asked(spots: DataFrame) -> DataFrame:
    """`d`, `m`, `asked`: of each text the spots to compare (begin, end, hash, is_first, often)."""
    place = F.struct(F.col("doc").isNull().alias("none"), "doc", "mark", "begin")
    spots = stored(spots)
    first = spots.groupBy("hash").agg(F.min(place).alias("first"), F.count("*").alias("times")).where("times > 1")
    first = stored(first)
    # at most HOT_KEYS hashes can occur so often
    hot = F.broadcast(first.where(F.col("times") > max(HOT_TIMES, spots.count() // HOT_KEYS)).select(F.col("hash").alias("o")))
    often = F.col("o").isNotNull()
    salt = F.when(often, F.pmod(F.xxhash64("doc", "mark", "begin"), F.lit(SALTS))).otherwise(0).cast("int")
    spots = spots.join(hot, F.col("hash") == F.col("o"), "left").withColumns({"salt": salt, "often": often}).drop("o")
    heads = first.join(hot, F.col("hash") == F.col("o"), "left")
    heads = heads.select(F.col("hash").alias("h"), "first", F.explode(_salts(often)).alias("s"))
    many = spots.join(heads, (F.col("hash") == F.col("h")) & (F.col("salt") == F.col("s")))
    many = many.select("doc", "mark", "begin", "end", "hash", "often", "chunk", "is_chunk", (F.col("first") == place).alias("is_first"))
    # a pair inside a chunk that is a copy need not be compared itself
    many = many.repartition("doc", "mark")
    copied = F.max(F.col("is_chunk") & ~F.col("is_first")).over(W.partitionBy("doc", "mark", "chunk"))
    many = many.withColumn("copied", F.col("chunk").isNotNull() & copied).where(F.col("is_first") | F.col("is_chunk") | ~F.col("copied"))
    asked = F.collect_list(F.struct("begin", "end", "hash", "is_first", "often"))
    return many.groupBy("doc", "mark").agg(asked.alias("asked")).select(F.col("doc").alias("d"), F.col("mark").alias("m"), "asked")


def _salts(often: Column) -> Column:
    return F.when(often, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))


def _same_text(doc: str) -> Column:
    return (F.col("mark") == F.col("m")) & F.col(doc).eqNullSafe(F.col("d"))


def _confirmed(keyed: DataFrame, asked: DataFrame, doc: str, text: str) -> DataFrame:
    """`d`, `m`, `gone`: of each text the asked spots whose lines equal those of the earliest spot, byte by byte, in order."""
    rows = keyed.join(asked, _same_text(doc))
    # reading every column, as what stays does, makes the exchange of the texts one for both
    others = [c for c in keyed.columns if c not in (doc, text, "mark")]
    lines = F.split(text, "\n", -1)
    lines = F.when(F.xxhash64(*others) >= F.lit(_LEAST), lines) if others else lines

    def cut(c: Column) -> Column:
        data = F.array_join(F.slice("lines", c["begin"] + 1, c["end"] - c["begin"]), "\n")
        return F.struct(*[c[name].alias(name) for name in ("begin", "end", "hash", "is_first", "often")], data.alias("bytes"))

    spot = F.explode(F.transform("asked", cut))
    texts = rows.select(F.col("d"), F.col("m"), lines.alias("lines"), "asked").select("d", "m", spot.alias("c")).select("d", "m", "c.*")
    heads = texts.where("is_first").dropDuplicates(["hash"]).select(F.col("hash").alias("h"), F.col("bytes").alias("head"), F.explode(_salts(F.col("often"))).alias("s"))
    salt = F.when(F.col("often"), F.pmod(F.xxhash64("d", "m", "begin"), F.lit(SALTS))).otherwise(0).cast("int")
    rest = texts.where("NOT is_first").withColumn("salt", salt)
    same = rest.join(heads, (F.col("hash") == F.col("h")) & (F.col("salt") == F.col("s"))).where(F.col("bytes") == F.col("head"))
    return same.groupBy("d", "m").agg(F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("gone"))


def drop_repeated(
    docs: DataFrame,
    window: int = WINDOW,
    divisor: int = DIVISOR,
    min_lines: int = MIN_LINES,
    report: str | None = "dedup",
    whole: bool = False,
) -> DataFrame:
    """All rows and columns of `docs` (doc_id, text, …), the text without its repeated chunks.

    With `whole`, every line goes that lies in a run of several lines which occurs earlier.
    `n_lines` and `n_removed` are added in a struct column `report`, which takes the place of a column of that name.
    """
    tuned(docs.sparkSession)
    keyed = _keyed(docs)
    doc, body = (f"c{docs.columns.index(c)}" for c in ("doc_id", "text"))
    asked = stored(_asked(_spots(keyed, doc, body, window, divisor, min_lines, whole)))
    gone = _confirmed(keyed, asked, doc, body)
    matched = keyed.join(gone, _same_text(doc), "left")
    text = F.col(body)
    matched = matched.select(*keyed.columns, "gone", F.split(text, "\n", -1).alias("lines"))
    runs = F.coalesce("gone", F.array().cast("array<struct<begin:int,end:int>>"))
    # what stays lies between two removed runs; none of them lies inside another
    begins = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["end"]))
    ends = F.concat(F.transform(runs, lambda r: r["begin"]), F.array(F.size("lines")))
    parts = F.zip_with(begins, ends, lambda b, e: F.slice("lines", b + 1, F.greatest(e - b, F.lit(0))))
    kept = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(F.flatten(parts), "\n"))
    # pairs overlap: of each run only what the one before has not removed counts
    sizes = F.zip_with(begins, ends, lambda b, e: F.greatest(e - b, F.lit(0)))
    removed = F.when(F.col("gone").isNull(), 0).otherwise(F.size("lines") - F.aggregate(sizes, F.lit(0), lambda acc, n: acc + n))
    n = F.when(text.isNull(), 0).otherwise(F.size("lines"))
    columns = [(kept if c == "text" else F.col(f"c{i}")).alias(c) for i, c in enumerate(docs.columns) if c != report]
    if report:
        columns.append(F.struct(n.cast("bigint").alias("n_lines"), removed.cast("bigint").alias("n_removed")).alias(report))
    return matched.select(*columns)
