"""Small tables with every awkward case, and brute-force forms of the text operators."""

import hashlib
import random
import re

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ascii_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def corpus(seed=1, n=40, vocabulary=60):
    """Texts with copies, near copies, shared passages, repeated lines, blanks of all kinds, other scripts, one long text."""
    r = random.Random(seed)
    words = [f"w{i}" if i % 7 else f"É{i}Ñ日" for i in range(vocabulary)]
    passage = [r.choice(words) for _ in range(70)]
    base = [r.choice(words) for _ in range(120)]
    texts = [None, "", " \t\n\x0b\x0c\r ", "one", "One", "a b c", "… x 　y", "🙂 é ½ ٣"]
    for i in range(n):
        kind = i % 5
        if kind == 0:
            near = list(base)
            for _ in range(r.randrange(0, 4)):
                near[r.randrange(len(near))] = r.choice(words)
            texts.append(" ".join(near))
        elif kind == 1:
            own = [r.choice(words) for _ in range(r.randrange(1, 60))]
            texts.append(" ".join(own + passage + own[:5]))
        elif kind == 2:
            lines = [" ".join(r.choice(words) for _ in range(4)) for _ in range(3)]
            texts.append("\n".join(lines + ["same one", "same two", "same three", "same four", "same five", "same six"] + lines[:1]))
        elif kind == 3:
            texts.append(" \t".join(r.choice(words).upper() for _ in range(r.randrange(1, 90))))
        else:
            texts.append(r.choice([t for t in texts if t]) + r.choice(["", "  ", "\n"]))
    texts.append(" ".join(r.choice(words) for _ in range(6000)))
    return [(i, t, ["en", "fr", None][i % 3], "s", len(t or "")) for i, t in enumerate(texts)]


def awkward(rows):
    """The rows with one repeated, and one without an id."""
    return [*rows, rows[12], (None, rows[12][1], None, None, None), (None, None, None, None, None)]


def frame(spark, rows, extra=True):
    """A documents table over several partitions, with columns of names that the operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    if extra:
        df = df.withColumns({c: F.lit("x") for c in ("mark", "node", "hash", "doc", "row", "gone", "dedup", "key", "n", "text_hash")})
    return df
