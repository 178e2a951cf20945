"""Exact, near, line and substring deduplication against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from helpers import SCHEMA, SPACE, ascii_lower, awkward, corpus, frame, sha
from pyspark.sql import functions as F

from flowfeat.llm import exact_dedup, fuse, line_dedup, minhash, substring_dedup
from flowfeat.llm.automaton import SuffixAutomaton
from flowfeat.llm.components import components


@pytest.fixture(scope="module")
def rows():
    return awkward(corpus())


@pytest.mark.parametrize("n", [0, 1, 2, 3, 50, 5000])
def test_fuse_filter_misses_no_key(n):
    r = np.random.default_rng(n)
    keys = r.integers(0, 2**64, n, dtype=np.uint64)
    blob = fuse.build(keys)
    assert fuse.contains(blob, keys).all()
    assert fuse.contains(blob, r.integers(0, 2**64, 20_000, dtype=np.uint64)).mean() < 0.008


def exact_brute(rows):
    groups = defaultdict(list)
    for d, t, *_ in rows:
        groups["".join(SPACE.findall(t or ""))].append((-len(t or ""), d is None, d or 0, d))
    out = []
    for body, members in groups.items():
        best = min(members)
        out += [(m[3], best[3], len(members), m == best, sha(body)) for m in members]
    return sorted(out, key=str)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup_of_batch_and_snapshot(spark, rows, weak):
    """With a one-character digest most texts collide, and the byte comparison alone keeps them apart."""
    digest = (lambda c: F.substring(F.sha2(c.cast("binary"), 256), 1, 1)) if weak else exact_dedup.sha256
    docs = frame(spark, rows)
    old = F.col("doc_id") % 2 == 0
    held = exact_dedup.snapshot(docs.where(old), digest)
    batch = exact_dedup.groups(exact_dedup.rows(docs.where(~F.coalesce(old, F.lit(False))), digest))
    found = exact_dedup.resolve(docs, exact_dedup.classes(batch, [held]), digest)
    got = sorted([tuple(r)[:4] for r in found.collect()], key=str)
    assert got == [r[:4] for r in exact_brute(rows)]
    if not weak:
        assert sorted(map(tuple, found.collect()), key=str) == exact_brute(rows)


def test_exact_dedup_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    some = frame(spark, corpus()[:10])
    assert exact_dedup.dedup(empty, [exact_dedup.snapshot(some)]).count() == 0
    assert exact_dedup.dedup(some, [exact_dedup.snapshot(empty)]).count() == 10
    assert exact_dedup.dedup(some, []).where("kept").count() == len({"".join(SPACE.findall(r[1] or "")) for r in corpus()[:10]})
    again = exact_dedup.dedup(some, [exact_dedup.snapshot(some), exact_dedup.snapshot(some)])
    assert again.agg(F.min("group_size")).first()[0] >= 3


def near_brute(rows, percent):
    sets = []
    for d, t, *_ in rows:
        w = SPACE.findall(ascii_lower(t or ""))
        sets.append((d, frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())))
    root = list(range(len(sets)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[top(i)] = top(j)
    groups = defaultdict(list)
    for i, (d, _) in enumerate(sets):
        groups[top(i)].append(d)
    out = []
    for i, (d, a) in enumerate(sets):
        ids = [x for x in groups[top(i)] if x is not None]
        low = min(ids) if ids and a else d
        out.append((d, len(a), low, d == low))
    return sorted(out, key=str)


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(spark, rows, percent):
    got = minhash.near_duplicates(frame(spark, rows), minhash.Plan(percent))
    assert sorted(map(tuple, got.collect()), key=str) == near_brute(rows, percent)


def test_near_duplicates_in_one_family(spark, monkeypatch):
    """Many edits of one text, most pairs near the threshold, in cells of seven: every chain of links is found."""
    monkeypatch.setattr(minhash, "BLOCK", 7)
    r = random.Random(5)
    base = [f"v{r.randrange(500)}" for _ in range(150)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(r.randrange(0, 7)):
            w[r.randrange(len(w))] = f"u{i}"
        rows.append((i, " ".join(w), None, None, None))
    got = minhash.near_duplicates(frame(spark, rows), minhash.Plan(85))
    assert sorted(map(tuple, got.collect()), key=str) == near_brute(rows, 85)


def test_pairs_of_one_bucket_meet_the_full_sets(spark, monkeypatch):
    monkeypatch.setattr(minhash.Plan, "screen", 10_000)  # no signature passes
    words = [f"w{i}" for i in range(120)]
    rows = [(1, " ".join(words), "en", "s", 1), (2, " ".join([*words[:-1], "x"]), "en", "s", 1), (3, "quite another", "en", "s", 1)]
    got = minhash.near_duplicates(frame(spark, rows), minhash.Plan(percent=80)).select("doc_id", "n_shingles", "component_id", "kept")
    assert sorted(map(tuple, got.collect()), key=str) == near_brute(rows, 80)


def test_signature_agreement_estimates_similarity():
    r = np.random.default_rng(3)
    a = r.integers(0, 2**64, 2000, dtype=np.uint64)
    b = np.r_[a[:1600], r.integers(0, 2**64, 400, dtype=np.uint64)]
    value = np.r_[a, b]
    table = minhash.signatures(value, np.array([0, 2000]), 400)
    assert abs((table[:, 0] == table[:, 1]).mean() - 1600 / 2400) < 0.08


def test_near_duplicates_empty(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    got = minhash.near_duplicates(spark.createDataFrame([(1, None), (2, ""), (3, " ")], "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True)]


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 160)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)]
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)
    for _ in range(70):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {n: x for n, x in root.items() if any(n in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def lines_brute(rows):
    spots = []
    for number, (d, t) in enumerate(dict.fromkeys((d, t) for d, t, *_ in rows)):
        if t is None:
            continue
        lines, cut = t.split("\n"), [0]
        md5 = [hashlib.md5(x.encode()).hexdigest() for x in lines]
        for i in range(1, len(lines)):
            if hashlib.md5((md5[i - 1] + md5[i]).encode()).hexdigest()[-1] in "01234567":
                cut.append(i)
        for b, e in zip(cut, cut[1:] + [len(lines)]):
            chunk = "\n".join(lines[b:e])
            if e - b >= 2 and chunk.strip(" "):
                spots.append((chunk, d is None, d or 0, hashlib.md5(t.encode()).hexdigest(), b, e, (d, t)))
    gone, seen = defaultdict(list), set()
    for chunk, *_, b, e, key in sorted(spots, key=lambda s: s[:5]):
        if chunk in seen:
            gone[key].append((b, e))
        seen.add(chunk)
    out = []
    for d, t, *_ in rows:
        lines = (t or "").split("\n") if t is not None else []
        stay = [x for i, x in enumerate(lines) if not any(b <= i < e for b, e in gone[(d, t)])]
        out.append((d, None if t is None else "\n".join(stay), len(lines), len(lines) - len(stay)))
    return sorted(out, key=str)


def test_line_dedup(spark, rows):
    docs = frame(spark, rows)
    out = line_dedup.drop_repeated(docs)
    assert [c for c in out.columns if c != "dedup"] == [c for c in docs.columns if c != "dedup"]
    got = sorted([tuple(r) for r in out.select("doc_id", "text", "dedup.n_lines", "dedup.n_removed").collect()], key=str)
    assert got == lines_brute(rows)
    assert sum(r[3] for r in got) > 20
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert line_dedup.drop_repeated(spark.createDataFrame([], SCHEMA)).count() == 0


def test_line_boundaries_survive_an_insertion(spark):
    lines = [f"line {i} of a text" for i in range(400)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(["new"] + lines[:200] + ["new", "newer"] + lines[200:]))]
    out = line_dedup.drop_repeated(spark.createDataFrame(rows, "doc_id long, text string"))
    removed = {r["doc_id"]: r["n"] for r in out.select("doc_id", F.col("dedup.n_removed").alias("n")).collect()}
    single = 403 * 0.25 + 15  # a chunk has one line with a chance of a half, so a quarter of the lines stay
    assert removed[1] == 0 and 403 - removed[2] < single * 1.5


def runs_brute(rows):
    """Lines in a run of several lines that occurs earlier; knows no chunks."""
    texts = sorted(dict.fromkeys((d, t) for d, t, *_ in rows if t is not None), key=lambda x: (x[0] is None, x[0] or 0, hashlib.md5(x[1].encode()).hexdigest()))
    seen, gone = set(), defaultdict(set)
    for key in texts:
        lines = key[1].split("\n")
        for i in range(len(lines) - 1):
            pair = "\n".join(lines[i : i + 2])
            if pair in seen and pair.strip(" \n") != "":
                gone[key].update((i, i + 1))
            seen.add(pair)
    out = []
    for d, t, *_ in rows:
        lines = [] if t is None else t.split("\n")
        stay = [x for i, x in enumerate(lines) if i not in gone[(d, t)]]
        out.append((d, None if t is None else "\n".join(stay), len(lines), len(lines) - len(stay)))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [10_000, 1])
def test_whole_line_passages(spark, rows, monkeypatch, hot):
    """With and without hot hashes the same rows, for tables of any columns; texts have one exchange."""
    monkeypatch.setattr(line_dedup, "HOT_TIMES", hot)
    monkeypatch.setattr(line_dedup, "HOT_KEYS", 1 << 40)
    r = random.Random(9)
    planted = []
    for n in range(2, 9):
        for k in range(6):
            passage = [f"passage {n} {k} {i}" for i in range(n)]
            for copy in range(2):
                around = [[f"own {n} {k} {copy} {side} {i}" for i in range(r.randrange(4))] for side in range(2)]
                planted.append((1000 + 100 * n + 10 * k + copy, "\n".join(around[0] + passage + around[1]), "en", "s", 1))
    rows = rows + planted + [(3000, "x\nx\nx\nx", "en", "s", 1), (3001, "\n\n\n", "en", "s", 1)]
    rows += [(3002 + i, "a\n\n\n\nb\n \n\nc\nd", "en", "s", 1) for i in range(3)] + [(3010, "z\n\n\n\nb\n \n\nc", "en", "s", 1)]
    got = line_dedup.drop_repeated(frame(spark, rows), whole=True).select("doc_id", "text", "dedup.n_lines", "dedup.n_removed").collect()
    got = sorted(map(tuple, got), key=str)
    assert got == runs_brute(rows)
    plan = line_dedup.drop_repeated(frame(spark, rows), whole=True)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    few = frame(spark, rows, extra=False).select("text", "doc_id")
    again = line_dedup.drop_repeated(few, whole=True).select("doc_id", "text", "dedup.n_lines", "dedup.n_removed").collect()
    assert sorted(map(tuple, again), key=str) == got
    copies = [x for x in got if x[0] is not None and 1000 <= x[0] < 3000 and x[0] % 10 == 1]
    assert len(copies) == 42 and not any("passage" in t for _, t, *_ in copies)
    chunks = line_dedup.drop_repeated(frame(spark, planted)).select("doc_id", "text").collect()
    assert sum("passage" in x["text"] for x in chunks if x["doc_id"] % 10 == 1) > 20  # what the chunk rule leaves


def repeats_brute(rows, span):
    earliest = {}
    split = [(d, SPACE.findall(t or "")) for d, t, *_ in rows]
    for d, w in split:
        if d is not None:
            for i in range(len(w) - span + 1):
                g = tuple(w[i : i + span])
                earliest[g] = min(earliest.get(g, d), d)
    out = []
    for d, w in split:
        gone = set()
        if d is not None:
            for i in range(len(w) - span + 1):
                if earliest[tuple(w[i : i + span])] < d:
                    gone.update(range(i, i + span))
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return sorted(out, key=str)


@pytest.mark.parametrize("span", [50, 8])
def test_remove_repeats(spark, rows, span, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 300)
    monkeypatch.setattr(substring_dedup, "STREAM_WORDS", 500)
    monkeypatch.setattr(substring_dedup, "PART", 40)
    got = substring_dedup.remove_repeats(frame(spark, rows), span)
    assert sorted([tuple(r)[:4] for r in got.collect()], key=str) == repeats_brute(rows, span)
    assert got.where("n_removed <> aggregate(spans, 0L, (a, s) -> a + s.end - s.begin)").count() == 0 or span == 8
    assert got.agg(F.sum("n_removed")).first()[0] > 300


def test_remove_repeats_keeps_the_number_of_equal_rows(spark):
    shared = " ".join(f"s{i}" for i in range(60))
    rows = [(1, f"a {shared} b", "en", "s", 1)] + [(2, f"own {shared} words", "en", "s", 1)] * 3
    got = substring_dedup.remove_repeats(frame(spark, rows))
    assert sorted([tuple(r)[:4] for r in got.collect()], key=str) == repeats_brute(rows, 50)


def test_remove_repeats_empty(spark):
    assert substring_dedup.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_suffix_automaton():
    r = random.Random(4)
    for _ in range(60):
        texts = [(r.randrange(9), [r.choice("abc") for _ in range(r.randrange(1, 30))]) for _ in range(5)]
        automaton = SuffixAutomaton(texts)
        query, span = [r.choice("abcd") for _ in range(40)], r.randrange(1, 6)
        want = {}
        for end in range(span - 1, len(query)):
            part = query[end - span + 1 : end + 1]
            owners = [o for o, t in texts if any(t[i : i + span] == part for i in range(len(t) - span + 1))]
            if owners:
                want[end] = min(owners)
        assert dict(automaton.matches(query, span)) == want


def test_blocks_count_common_shingles():
    sets = minhash.shingle_sets(pa.array(["a b c d e f g", "x y", "b c d e f g h", ""]), 5)
    assert [len(s) for s in sets] == [3, 1, 3, 0]
    assert minhash.Blocks(sets[:3]).common(0, np.array([1, 2])).tolist() == [0, 2]
