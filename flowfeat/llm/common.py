"""Helpers of the text operators: session settings, stored tables, words and hashes over Arrow batches."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Runtime settings; a value that the caller set is never changed. Small Arrow batches bound the Python workers.
SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}
# A block of texts is at most so many bytes, or one text: numpy holds several words of 8 bytes for each byte.
BLOCK_BYTES = 1 << 20
_U = np.uint64


def by_value(name: str) -> None:
    """Send the functions of module `name` to the executors by value, so that they need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


by_value(__name__)


def tuned(spark: SparkSession) -> SparkSession:
    given = spark.sparkContext.getConf()
    for name, value in SETTINGS.items():
        if not given.contains(name):
            spark.conf.set(name, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below the one that the cluster names in `spark.checkpoint.dir`.

    Where none is named (local runs and tests), a folder `flowfeat-scratch` in the warehouse is used.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    root = root or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/flowfeat-scratch"
    folder = f"{root.rstrip('/')}/flowfeat-{uuid.uuid4().hex}"
    spark.__dict__.setdefault("flowfeat_folders", []).append(folder)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """Write `df` once as Parquet in the shared folder and read it back: lineage ends there, lost executors lose nothing."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_stored(*tables: DataFrame) -> None:
    """Delete tables made by `stored` whose last reader is done."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            _delete(df.sparkSession, folder)


def scratch_folders(spark: SparkSession) -> list[str]:
    """The folders made so far in this session and not deleted."""
    return list(spark.__dict__.get("flowfeat_folders", []))


def drop_folders(spark: SparkSession, folders: list[str]) -> None:
    """Delete some of them, once what reads them is done."""
    kept = spark.__dict__.get("flowfeat_folders", [])
    for folder in folders:
        _delete(spark, folder)
        if folder in kept:
            kept.remove(folder)


def drop_scratch(spark: SparkSession) -> None:
    """Delete all that the operators stored in this session, once their results have been written."""
    for folder in spark.__dict__.pop("flowfeat_folders", []):
        _delete(spark, folder)


def map_arrow(df: DataFrame, function: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """Apply `function` (batch to named columns) to every Arrow batch, in blocks of bounded bytes of the column `text`."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                columns = function(block)
                arrays = [
                    c.cast(f.type) if isinstance(c := columns[f.name], pa.Array) else pa.array(c, f.type) for f in target
                ]
                yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return df.mapInArrow(run, schema)


def blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most BLOCK_BYTES of `text`, or with one row."""
    if batch.num_rows == 0:
        return
    size = np.cumsum(np.diff(text_bytes(batch.column("text"))[1]))
    at = 0
    while at < batch.num_rows:
        done = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, done + BLOCK_BYTES, "right")))
        yield batch.slice(at, end - at)
        at = end


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and where each begins (one more entry than texts). Null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    begin = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[begin[0] : begin[-1]], begin - begin[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (shift-multiply finaliser)."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _powers(n: int, base: int) -> np.ndarray:
    """base ** 0 … base ** (n - 1), modulo 2 ** 64, by doubling."""
    out = np.ones(max(n, 1), _U)
    filled = 1
    while filled < n:
        step = _U(pow(base, filled, 1 << 64))
        take = min(filled, n - filled)
        out[filled : filled + take] = out[:take] * step
        filled += take
    return out


class _Tables:
    """Lazily grown power tables, one set per Python process."""

    base = 0x9E3779B97F4A7C15 | 1
    inverse = pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64)
    up = np.zeros(0, _U)
    down = np.zeros(0, _U)

    @classmethod
    def powers(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            if n > 4 * BLOCK_BYTES:  # for one very long text: not kept
                return _powers(n, cls.base), _powers(n, cls.inverse)
            size = max(n, BLOCK_BYTES + 1)
            cls.up, cls.down = _powers(size, cls.base), _powers(size, cls.inverse)
        return cls.up[:n], cls.down[:n]


def span_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each span the polynomial sum of its values, independent of where the span lies; modulo 2 ** 64."""
    if not len(starts):
        return np.zeros(0, _U)
    up, down = _Tables.powers(len(values))
    total = np.zeros(len(values) + 1, _U)
    np.cumsum(values * up, out=total[1:])
    return (total[ends] - total[starts]) * down[starts]


class Words:
    """The words of a block of texts: byte range of each, and the first word of each text (one more entry than texts)."""

    def __init__(self, texts: pa.Array, keep: np.ndarray, lower: bool):
        self.data, offsets = text_bytes(texts)
        if lower:
            self.data = LOWER[self.data]
        inside = keep[self.data]
        n = len(inside)
        begins, finishes = inside.copy(), inside.copy()
        if n:
            begins[1:] &= ~inside[:-1]
            finishes[:-1] &= ~inside[1:]
            edge = offsets[(offsets > 0) & (offsets < n)]
            begins[edge] = inside[edge]
            finishes[edge - 1] = inside[edge - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(finishes) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        sums = span_sums(BYTE_CODES[self.data], self.start, self.end)
        return mixed(sums + (self.end - self.start).astype(_U) * _U(0xD6E8FEB86659FD93))

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def joined(self, doc: int, lo: int | None = None, hi: int | None = None) -> bytes:
        """Words lo … hi-1 (counted over the block; all by default) of a text, with one space between."""
        lo = self.first[doc] if lo is None else lo
        hi = self.first[doc + 1] if hi is None else hi
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(self.start[lo:hi].tolist(), self.end[lo:hi].tolist()))


BYTE_CODES = mixed(np.arange(1, 257, dtype=_U) * _U(0xA0761D6478BD642F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words of `[^\x20\x09-\x0D]+`: all bytes but space, tab, line feed, vertical tab, form feed and carriage return.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Words of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`: digits, small ASCII letters and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def grams(hashes: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of k words inside one text, and the run's first word."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    place = np.arange(n)
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    sums = span_sums(hashes, place, place + k)[at] if k > 16 else _short_sums(hashes, k, n)[at]
    return mixed(sums + _U(k * 0x8EBC6AF09C88C6E3 % (1 << 64))), at


def _short_sums(hashes: np.ndarray, k: int, n: int) -> np.ndarray:
    out = np.zeros(n, _U)
    for j in range(k):
        out += hashes[j : j + n] * _U(pow(_Tables.base, j, 1 << 64))
    return out


def winnowed(values: np.ndarray, at: np.ndarray, doc: np.ndarray, window: int) -> np.ndarray:
    """Places (in `values`) of the minimum of each run of `window` neighbours in one text, the rightmost of equal ones.

    A text with fewer than `window` values gives the minimum of those it has.
    """
    n = len(values)
    if not n:
        return np.zeros(0, np.int64)
    owner = doc[at]
    edges = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    sizes = np.diff(np.r_[edges, n])
    short = [lo + size - 1 - np.argmin(values[lo : lo + size][::-1]) for lo, size in zip(edges, sizes) if size < window]
    picked = np.zeros(0, np.int64)
    if n >= window:
        best = values[window - 1 :].copy()
        place = np.arange(window - 1, n)
        for j in range(1, window):
            other = values[window - 1 - j : n - j]
            less = other < best
            best[less] = other[less]
            place[less] = np.flatnonzero(less) + window - 1 - j
        picked = place[owner[window - 1 :] == owner[: n - window + 1]]
    return np.unique(np.r_[picked, np.array(short, np.int64)])


def lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from flat values and the number for each row."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values).cast(kind))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


