"""Byte-level BPE over Arrow batches with the tokenizers library: ids, character offsets, and the way back.

A rank file (base64 token and rank per line) becomes a `tokenizers` BPE model whose merges are all splits of each token
into two others, in rank order. Texts are cut by the pattern of `public_tokenizers`, worked out for a whole batch at
once from the class of every code point; each different piece is mapped to its byte characters and merged by the
library once per batch, and kept for later batches within a bound. Ids equal those of the tiktoken library.

Decoding turns the byte characters of the model's tokens back into bytes by the reversed table. A token may end inside a
character: its bytes are joined with those of its neighbours before they are read as text, both tokens then have the
whole character in their offsets, and `split` marks them.

Defined cases: a null text counts as empty, an empty text has no ids; a null doc_id is an ordinary value; repeated rows
give equal rows; an empty table gives no rows; other columns are ignored. Unpaired surrogates cannot occur in UTF-8.
"""

from __future__ import annotations

import base64
import json
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from flowfeat.llm.common import by_value, lists, map_arrow, tuned

by_value(__name__)

# Different pieces that a worker remembers in each of two generations. Bounds memory, never changes a result.
REMEMBERED = 150_000
LETTER, NUMBER, BLANK, OTHER = 0, 1, 2, 3


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 ones for themselves, the others from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def token_bytes(vocabulary: dict[str, int]) -> dict[bytes, int]:
    """A vocabulary of byte characters as one of bytes: the table of bytes, reversed."""
    byte = {c: b for b, c in enumerate(byte_characters())}
    return {bytes(byte[c] for c in token): i for token, i in vocabulary.items()}


def read_ranks(spark, path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file on the driver; a vocabulary has a fixed, small size."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def model_json(ranks: dict[bytes, int]) -> str:
    """The vocabulary and merges of a rank file as a BPE model of the tokenizers library."""
    sign = byte_characters()
    name = {token: "".join(sign[b] for b in token) for token in ranks}
    merges = [
        [name[token[:i]], name[token[i:]]]
        for token in sorted(ranks, key=ranks.__getitem__)
        for i in range(1, len(token))
        if token[:i] in ranks and token[i:] in ranks
    ]
    model = {"type": "BPE", "vocab": {name[t]: r for t, r in ranks.items()}, "merges": merges, "ignore_merges": True}
    return json.dumps({"version": "1.0", "model": model})


def character_classes() -> bytes:
    r"""LETTER (\p{L}), NUMBER (\p{N}), BLANK (\s) or OTHER for each code point."""
    import regex

    out = np.full(0x110000, OTHER, np.uint8)
    text = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+")):
        for run in regex.finditer(pattern, text):
            lo, hi = (x if x < 0xD800 else x + 0x800 for x in run.span())
            out[lo:hi] = kind
    out[0xD800:0xE000] = OTHER
    return out.tobytes()


def piece_starts(code: np.ndarray, first: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where pieces begin in the code points of several texts; `first`: where texts begin, one more entry than texts."""
    n = len(code)
    kind = classes[code]
    start = np.zeros(n + 1, bool)
    start[1:n] = kind[1:] != kind[:-1]
    start[first] = True
    ends_text = np.zeros(n + 1, bool)
    ends_text[first] = True
    # the last blank before something else stands alone, or goes with it if it is a space
    run_start = np.flatnonzero(start[:n])
    run_end = np.r_[run_start[1:], n] if n else run_start
    blank = (kind[run_start] == BLANK) & ~ends_text[run_end]
    last = run_end[blank] - 1
    start[last] = True
    start[last[code[last] == 0x20] + 1] = False
    # 's 't 'm 'd 're 've 'll at the beginning of a piece
    mark = np.flatnonzero(start[:n] & (code == 0x27))
    room = first[np.searchsorted(first, mark, "right")] - mark if len(mark) else mark
    at = lambda k: code[np.minimum(mark + k, n - 1)]
    one = (room >= 2) & np.isin(at(1), [ord(c) for c in "stmd"])
    two = np.zeros(len(mark), bool)
    for a, b in ("re", "ve", "ll"):
        two |= (room >= 3) & (at(1) == ord(a)) & (at(2) == ord(b))
    two &= ~one
    for chosen, size in ((mark[one], 2), (mark[two], 3)):
        start[chosen + 1] = False
        start[chosen + size] = True
    return np.flatnonzero(start[:n])


class Coder:
    """A tokenizer in a worker, made from the broadcast `parts`; keeps the pieces seen last."""

    def __init__(self, parts: dict):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(parts["model"]).model
        self.classes = np.frombuffer(parts["classes"], np.uint8)
        self.signs = str.maketrans({chr(b): c for b, c in enumerate(byte_characters())})
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @staticmethod
    def of(parts: dict) -> Coder:
        """One for each worker: the broadcast value lives as long as the worker."""
        if "coder" not in parts:
            parts["coder"] = Coder(parts)
        return parts["coder"]

    def ids(self, piece: str) -> bytes:
        """The ids of a piece as 32-bit words."""
        tokens = self.model.tokenize(piece.encode().decode("latin-1").translate(self.signs))
        return array("i", [t.id for t in tokens]).tobytes()

    def cut(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """All pieces of some texts, and the number for each text."""
        whole = "".join(texts)
        code = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        first = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=first[1:])
        start = piece_starts(code, first, self.classes)
        counts = np.diff(np.searchsorted(start, first))
        stops = start.tolist()
        return [whole[a:b] for a, b in zip(stops, stops[1:] + [len(whole)])], counts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the number for each text."""
        pieces, counts = self.cut(texts)
        if len(self.young) > REMEMBERED:  # what is still met moves on to the next generation
            self.old, self.young = self.young, {}
        known = self.young
        for piece in set(pieces).difference(known):
            known[piece] = self.old.get(piece) or self.ids(piece)
        parts = [known[p] for p in pieces]
        flat = np.frombuffer(b"".join(parts), np.int32)
        sizes = np.zeros(len(parts) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) // 4, out=sizes[1:])
        return flat, np.diff(sizes[np.r_[0, np.cumsum(counts)]])


class Table:
    """The bytes of every id, for decoding."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values(), default=-1) + 1
        token = [b""] * size
        for t, r in ranks.items():
            token[r] = t
        self.size = np.array([len(t) for t in token], np.int64)
        self.begin = np.r_[0, np.cumsum(self.size)]
        self.data = np.frombuffer(b"".join(token), np.uint8)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of some ids in a row; ids without a token have none."""
        known = (ids >= 0) & (ids < len(self.size))
        ids = ids[known]
        size = self.size[ids]
        end = np.cumsum(size)
        # position in the table = begin of the token + distance from the token's first output byte
        return self.data[np.arange(end[-1] if len(end) else 0) + np.repeat(self.begin[ids] - (end - size), size)]

    def offsets(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last + 1 character of each id in the decoded text; characters split over ids count for each."""
        begin, end, _ = self.placed(ids, self.decode(ids))
        return begin, end

    def placed(self, ids: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """`offsets` of ids with their bytes, and which of them have a part of a character only."""
        lead = np.r_[(data & 0xC0) != 0x80, True]
        number = np.r_[0, np.cumsum(lead[:-1])]
        end = np.cumsum(self.size[ids])
        begin = end - self.size[ids]
        # a token that begins inside a character has that character too
        inside = ~lead[begin]
        return number[begin] - inside, number[end], inside | ~lead[end]


def _parts(spark, path: str):
    ranks = read_ranks(spark, path)
    return spark.sparkContext.broadcast({"model": model_json(ranks), "classes": character_classes()})


def _table(parts: dict) -> Table:
    if "table" not in parts:
        parts["table"] = Table(token_bytes(json.loads(parts["model"])["model"]["vocab"]))
    return parts["table"]


def encode(docs: DataFrame, path: str, offsets: bool = False, verify: bool = False) -> DataFrame:
    """`doc_id`, `ids` of every row of `docs` (doc_id, text), and `begins`, `ends` (characters) if `offsets`.

    With `verify` the ids of each text are decoded in the same pass: `round_trip` tells whether the bytes are those of the
    text, and `n_split` how many ids have a part of a character only.
    """
    spark = tuned(docs.sparkSession)
    parts = _parts(spark, path)

    def run(block: pa.RecordBatch) -> dict:
        texts = [t or "" for t in block.column("text").to_pylist()]
        flat, counts = Coder.of(parts.value).encode(texts)
        out = {"doc_id": block.column("doc_id"), "ids": lists(flat, counts, pa.int32())}
        if verify or offsets:
            found = Decoded(_table(parts.value), flat, counts)
        if verify:
            out["round_trip"] = [data == text.encode() for data, text in zip(found.texts(), texts)]
            out["n_split"] = found.splits()
        if offsets:
            out["begins"], out["ends"] = lists(found.begin, counts, pa.int64()), lists(found.end, counts, pa.int64())
        return out

    more = ", round_trip boolean, n_split bigint" if verify else ""
    more += ", begins array<bigint>, ends array<bigint>" if offsets else ""
    return map_arrow(docs.select("doc_id", "text"), run, "doc_id bigint, ids array<int>" + more)


class Decoded:
    """The ids of several texts, decoded at once: bytes, character offsets in each text, and split characters."""

    def __init__(self, table: Table, flat: np.ndarray, counts: np.ndarray):
        flat = flat.astype(np.int64)
        self.data = table.decode(flat)
        begin, end, self.split = table.placed(flat, self.data)
        self.stop = np.r_[0, np.cumsum(counts)]
        self.byte = np.r_[0, np.cumsum(table.size[flat])][self.stop]
        # a text begins with a character of its own, so its first character is the number of those before
        first = np.repeat(np.r_[0, end][self.stop[:-1]], counts)
        self.begin, self.end = begin - first, end - first

    def texts(self) -> list[bytes]:
        whole = self.data.tobytes()
        edge = self.byte.tolist()
        return [whole[a:b] for a, b in zip(edge, edge[1:])]

    def splits(self) -> np.ndarray:
        return np.diff(np.r_[0, np.cumsum(self.split)][self.stop])

    def offset_words(self) -> list[bytes]:
        """Begins and then ends of each text as little-endian 64-bit words."""
        edge = self.stop.tolist()
        begin, end = self.begin.astype("<i8"), self.end.astype("<i8")
        return [begin[a:b].tobytes() + end[a:b].tobytes() for a, b in zip(edge, edge[1:])]


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """`doc_id`, `data` (bytes) of every row of `encoded` (doc_id, ids); null ids count as none."""
    spark = tuned(encoded.sparkSession)
    parts = _parts(spark, path)

    def run(batches):
        for batch in batches:
            table = _table(parts.value)
            data = [table.decode(np.array(ids or [], np.int64)).tobytes() for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(data, pa.binary())], ["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, data binary")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Encode every text and decode its ids, in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256, round_trip, n_split, offsets_sha256.

    The digests are of the decimal ids joined by commas, of the decoded bytes, and of the begins and then the ends of
    all ids as little-endian 64-bit words; `round_trip` tells whether the bytes are those of the text, `n_split` how many
    ids have a part of a character only.
    """
    import hashlib

    spark = tuned(docs.sparkSession)
    parts = _parts(spark, path)

    def sha(data: bytes) -> str:
        return hashlib.sha256(data).hexdigest()

    def run(block: pa.RecordBatch) -> dict:
        texts = [t or "" for t in block.column("text").to_pylist()]
        flat, counts = Coder.of(parts.value).encode(texts)
        table = _table(parts.value)
        names = parts.value.setdefault("names", [str(i) for i in range(len(table.size))])
        found = Decoded(table, flat, counts)
        data = found.texts()
        return {
            "doc_id": block.column("doc_id"),
            "n_tokens": counts,
            "ids_sha256": [sha(",".join([names[i] for i in ids.tolist()]).encode()) for ids in np.split(flat, np.cumsum(counts)[:-1])],
            "decoded_sha256": [sha(d) for d in data],
            "round_trip": [d == t.encode() for d, t in zip(data, texts)],
            "n_split": found.splits(),
            "offsets_sha256": [sha(w) for w in found.offset_words()],
        }

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, round_trip boolean, n_split bigint, offsets_sha256 string"
    return map_arrow(docs.select("doc_id", "text"), run, schema)
