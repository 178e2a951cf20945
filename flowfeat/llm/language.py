"""Language identification by hyperdimensional profiles.

Every letter has a random vector of DIM signs, made from its code point. A trigram is bound by multiplying its letters'
vectors, rotated by two, one and no places; a text is the bundle (sum) of its trigrams; a language is the bundle of its
training texts. A text gets the language whose profile has the largest cosine with it.

Defined cases: null texts and texts without a letter are `und` with score 0, and so is everything if nothing was
learned; a null language teaches nothing; ties go to the first language in order; repeated rows count each in training
and give equal rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowfeat.llm.common import blocks, by_value, map_arrow, tuned

by_value(__name__)

DIM = 1024
UNKNOWN = "und"
# The cosine of unrelated vectors has a standard deviation of 1 / sqrt(signs); below DEVIATIONS of it no language is shown. Real
# texts of a few words have best cosines from about 0.1, so texts that do not reach it in DIM signs are judged by more.
EVIDENCE_DIM = 4096
DEVIATIONS = 4
NO_EVIDENCE = DEVIATIONS / EVIDENCE_DIM**0.5
# Labelled texts that teach the profiles of `identified`, chosen by a hash; profiles of fewer letters hardly differ.
EXAMPLES = 50_000
# Cells of the trigram vectors that are held at a time.
CELLS = 1 << 25


def letter_vectors(codes: np.ndarray, dim: int) -> np.ndarray:
    """A row of random signs for each code point, the same on every machine; the blank (0) has one too."""
    out = np.empty((len(codes), dim), np.int8)
    for row, code in enumerate(codes.tolist()):
        bits = np.random.Generator(np.random.PCG64(code)).integers(0, 2, dim, np.int8)
        out[row] = 2 * bits - 1
    return out


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letters of the block, distinct trigrams (rows of letter numbers), and (text, trigram) of every trigram.

    Texts are lower-cased; every run of other characters is one blank, and each text begins and ends with one.
    """
    whole = " " + " ".join((t or "").lower() for t in texts) + " "
    code = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    sizes = np.array([len((t or "").lower()) for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    present = np.zeros(0x110000, bool)
    present[code] = True
    letters = np.array([c for c in np.flatnonzero(present).tolist() if chr(c).isalpha()], np.int64)
    number = np.zeros(0x110000, np.int64)
    number[letters] = np.arange(1, len(letters) + 1)
    sign = number[code]
    # a blank after a blank is dropped; owner[i] is the text of character i + 1, and of the blank that ends it
    keep = np.r_[True, (sign[1:] != 0) | (sign[:-1] != 0)]
    edge = np.r_[0, np.cumsum(sizes + 1)]
    keep[edge] = True
    owner = np.r_[0, owner][keep]
    sign = sign[keep]
    if len(sign) < 3:
        return letters, np.zeros((0, 3), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    base = len(letters) + 1
    gram = (sign[:-2] * base + sign[1:-1]) * base + sign[2:]
    # of one text: both the middle and the last character belong to it, and some letter is in it
    inside = (owner[1:-1] == owner[2:]) & ((sign[:-2] != 0) | (sign[1:-1] != 0) | (sign[2:] != 0))
    inside &= ~((sign[1:-1] == 0) & np.isin(np.flatnonzero(keep)[1:-1], edge))
    inside &= (sign[1:-1] != 0) | (sign[2:] != 0)  # a text that ends in a blank has no second one
    gram, text = gram[inside], owner[2:][inside]
    distinct, place = _numbered(gram, base**3)
    table = np.stack([distinct // base // base, distinct // base % base, distinct % base], 1)
    return letters, table, text, place


def _numbered(values: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and the place of each, by a table where the values are small."""
    if limit > 4_000_000:
        return np.unique(values, return_inverse=True)
    seen = np.zeros(limit, bool)
    seen[values] = True
    distinct = np.flatnonzero(seen)
    number = np.zeros(limit, np.int32)
    number[distinct] = np.arange(len(distinct))
    return distinct, number[values]


def bound(letters: np.ndarray, table: np.ndarray, dim: int, signs: int | None = None) -> np.ndarray:
    """The vector of each trigram, or its first `signs`."""
    base = letter_vectors(np.r_[0, letters], dim)
    once, twice = np.roll(base, 1, 1), np.roll(base, 2, 1)
    base, once, twice = (x[:, :signs] for x in (base, once, twice))
    return twice[table[:, 0]] * once[table[:, 1]] * base[table[:, 2]]


def bundles(texts: list[str | None], dim: int, group: np.ndarray | None = None, signs: int | None = None) -> np.ndarray:
    """The vector of each text, or of each group of texts: the sum of its trigrams; its first `signs` if that is given.

    Whole numbers in float64, so the order never matters.
    """
    letters, table, text, place = trigrams(texts)
    n = len(texts)
    if group is not None:
        text, n = group[text], int(group.max(initial=-1)) + 1
    out = np.zeros((n, signs or dim))
    width = max(1, CELLS // dim)
    if len(table) > width or group is not None:  # by slab of trigrams, then by text
        order = np.lexsort((text, place // width))
        text, place = text[order], place[order]
    edges = np.searchsorted(place // width, np.arange(-(-len(table) // width) + 1))
    for slab in range(len(edges) - 1):
        names = table[slab * width : (slab + 1) * width]
        owner, number = text[edges[slab] : edges[slab + 1]], place[edges[slab] : edges[slab + 1]] - slab * width
        vectors = bound(letters, names, dim, signs).astype(np.float32)
        step = max(1, 2_000_000 // len(names))
        begin = np.searchsorted(owner, np.arange(n + 1))
        for lo in range(0, n, step):
            hi = min(lo + step, n)
            part = slice(begin[lo], begin[hi])
            if begin[lo] < begin[hi]:
                counts = np.bincount((owner[part] - lo) * len(names) + number[part], minlength=(hi - lo) * len(names))
                out[lo:hi] += counts.reshape(hi - lo, -1).astype(np.float32) @ vectors
    return out


def learn(examples: DataFrame, dim: int = DIM) -> dict[str, np.ndarray]:
    """The unit profile of every language in `examples` (text, lang).

    A task sends one sum for each language, and the sums of all tasks are added in Spark; what reaches the driver is
    `dim` numbers for each language, and languages are bounded by their code list.
    """
    tuned(examples.sparkSession)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for block in blocks(batch):
                names, group = np.unique(np.array(block.column("lang").to_pylist(), object), return_inverse=True)
                for name, vector in zip(names, bundles(block.column("text").to_pylist(), dim, group)):
                    total[name] = total.get(name, 0) + vector
        for name, vector in total.items():
            n = range(dim)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * dim), pa.array(list(n), pa.int32()), pa.array(vector.astype(np.int64))], ["lang", "place", "value"]
            )

    known = examples.where("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang")
    rows = (
        known.mapInArrow(sums, "lang string, place int, value bigint")
        .groupBy("lang", "place")
        .agg(F.sum("value").alias("value"))
        .groupBy("lang")
        .agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("cells"))
        .collect()
    )
    raw = {r["lang"]: np.array([c["value"] for c in r["cells"]], float) for r in sorted(rows, key=lambda r: r["lang"])}
    return {k: v / np.linalg.norm(v) for k, v in raw.items() if v.any()}


def predict(docs: DataFrame, profiles: dict[str, np.ndarray]) -> DataFrame:
    """`doc_id`, `lang_pred`, `score` (the cosine, at least 0) of every row of `docs` (doc_id, text)."""
    spark = tuned(docs.sparkSession)
    names = list(profiles)
    dim = len(next(iter(profiles.values()))) if profiles else DIM
    held = spark.sparkContext.broadcast(np.stack(list(profiles.values()), 1) if profiles else np.zeros((dim, 0)))

    def judge(block: pa.RecordBatch) -> dict:
        vectors = bundles(block.column("text").to_pylist(), dim)
        size = np.linalg.norm(vectors, axis=1)
        found = size > 0
        if not names:
            return {"doc_id": block.column("doc_id"), "lang_pred": [UNKNOWN] * len(found), "score": np.zeros(len(found))}
        cosine = (vectors @ held.value) / np.where(found, size, 1)[:, None]
        best = cosine.argmax(1)
        score = np.where(found, np.clip(cosine[np.arange(len(best)), best], 0, 1), 0.0)
        return {
            "doc_id": block.column("doc_id"),
            "lang_pred": [names[b] if f else UNKNOWN for b, f in zip(best, found)],
            "score": score,
        }

    return map_arrow(docs.select("doc_id", "text"), judge, "doc_id bigint, lang_pred string, score double")


def sampled(examples: DataFrame, most: int = EXAMPLES) -> DataFrame:
    """About `most` labelled rows, chosen by a hash of text and language, or all if there are fewer."""
    known = examples.where("lang IS NOT NULL AND text IS NOT NULL")
    rows = known.count()
    if rows <= most:
        return known
    return known.where(F.pmod(F.xxhash64("text", "lang"), F.lit(1_000_000)) < int(1_000_000 * most / rows))


def identified(docs: DataFrame, profiles: dict[str, np.ndarray], wanted: list[str] | None = None, fill: str | None = "lang") -> DataFrame:
    """The rows of `docs` (text, …), with all their columns, whose language shows and is one of `wanted` (None: any learned one).

    The first DIM signs decide where the best cosine is at least DEVIATIONS standard deviations of unrelated
    vectors; the other texts, short or strange ones, are judged by all signs of the profiles in the same way, and go if no
    language shows there either. A null in the column `fill` becomes the language found. Rows are filtered where
    they are read; nothing is shuffled.
    """
    spark = tuned(docs.sparkSession)
    names = list(profiles)
    dim = len(profiles[names[0]]) if names else DIM
    held = spark.sparkContext.broadcast(np.stack(list(profiles.values()), 1) if names else np.zeros((dim, 0)))
    good = np.array([wanted is None or name in wanted for name in names], bool)
    # plain names on the way through Python, which takes no dots
    at = docs.columns.index(fill) if fill in docs.columns else None
    plain = docs.toDF(*["text" if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)])

    def best(texts: list[str | None], signs: int) -> tuple[np.ndarray, np.ndarray]:
        """Number of the best profile of each text, -1 if none shows."""
        vectors = bundles(texts, dim, signs=signs)
        part = held.value[:signs]
        length = np.linalg.norm(vectors, axis=1)[:, None] * np.linalg.norm(part, axis=0)
        cosine = np.where(length > 0, vectors @ part, -1) / np.where(length > 0, length, 1)
        top = cosine.argmax(1)
        shows = cosine[np.arange(len(top)), top] >= DEVIATIONS / signs**0.5
        return np.where(shows, top, -1)

    def judged(texts: list[str | None]) -> np.ndarray:
        if not names:
            return np.full(len(texts), -1)
        found = best(texts, min(DIM, dim))
        again = np.flatnonzero(found < 0)
        if len(again) and dim > DIM:
            found[again] = best([texts[i] for i in again], dim)
        return found

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                found = judged(block.column("text").to_pylist())
                stay = np.flatnonzero((found >= 0) & np.r_[good, False][found])
                out = block.take(pa.array(stay))
                if at is not None:
                    given = out.column(at)
                    named = pa.array([names[i] for i in found[stay]], pa.string()).cast(given.type)
                    out = out.set_column(at, out.schema.field(at), pc.coalesce(given, named))
                yield out

    return plain.mapInArrow(keep, plain.schema).toDF(*docs.columns)
