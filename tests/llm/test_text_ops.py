"""Decontamination, encoding, languages, URLs, tool calls and token files against brute force or held-out accuracy."""

import json
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import ALNUM, SCHEMA, ascii_lower, awkward, corpus, frame
from pyspark.sql import functions as F

from flowfeat.llm import bpe, decontamination, language, token_files, tool_calls, url_filter

tiktoken = pytest.importorskip("tiktoken")
public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def rows():
    return awkward(corpus())


def windows(text):
    w = ALNUM.findall(ascii_lower(text or ""))
    n = min(10, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def leaks_brute(rows, items):
    out = []
    for d, t, *_ in rows:
        w = ALNUM.findall(ascii_lower(t or ""))
        hit, ids = set(), set()
        for item, text in set(items):
            for g in windows(text):
                for i in range(len(w) - len(g) + 1):
                    if tuple(w[i : i + len(g)]) == g:
                        hit.update(range(i, i + len(g)))
                        ids.add(item)
        out.append((d, len(w), len(hit), sorted(ids, key=lambda x: (x is None, x))))
    return sorted(out, key=str)


@pytest.mark.parametrize("broadcast", [True, False])
def test_decontamination(spark, rows, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(decontamination, "BROADCAST_ROWS", -1)
    texts = [t for _, t, *_ in rows if t and len(t.split()) > 40]
    items = [(1, " ".join(texts[0].split()[3:30])), (2, " ".join(texts[5].split()[5:14]) + "?!"), (3, "w1 w2"), (4, "One"), (5, ""), (6, None)]
    items += [(7, " ".join(texts[2].split()[:12]).upper()), (7, " ".join(texts[2].split()[:12]).upper()), (8, "日"), (None, "w3-w4"), (9, "b.c")]
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit(1))
    got = decontamination.contaminated(frame(spark, rows), benchmark)
    found = got.collect()
    assert sorted([(r[0], r[1], r[2], r[3]) for r in found], key=str) == leaks_brute(rows, items)
    assert all(r["n_hit"] == sum(s["end"] - s["begin"] for s in r["spans"]) for r in found)
    assert sum(r["n_hit"] > 0 for r in found) > 10


def test_decontamination_empty(spark, rows):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contaminated(frame(spark, rows), none).agg(F.sum("n_hit")).first()[0] == 0
    assert decontamination.contaminated(spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0


@pytest.fixture(scope="module")
def coder():
    ranks = bpe.read_ranks(None, PATH)
    parts = {"model": bpe.model_json(ranks), "classes": bpe.character_classes(), "ranks": ranks}
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return bpe.Coder.of(parts), reference, bpe.Table(ranks)


def test_pieces_and_ids_equal_the_library(coder):
    own, reference, table = coder
    r = random.Random(1)
    signs = "abst' '\n\t  re've'll 12é… 　🙂'mdSTx!?.\r\x85\x1f\x1c​日本語 ½٣"
    texts = ["".join(r.choice(signs) for _ in range(r.randrange(0, 40))) for _ in range(20_000)]
    texts += [f"a{chr(c)}b1{chr(c)}2 {chr(c)}!{chr(c)}" for c in range(0, 0x3200)]
    texts += ["'s" * 50, "x" * 5000, " " * 3000, "é" * 3000, "<|endoftext|>"]
    ids, counts = own.encode(texts)
    for text, mine in zip(texts, np.split(ids, np.cumsum(counts)[:-1])):
        assert mine.tolist() == reference.encode_ordinary(text), text
        assert table.decode(mine).tobytes() == text.encode()


def test_offsets_cover_characters(coder):
    own, reference, table = coder
    for text in ["日本語 テスト 🙂🙂", "plain text", "é½…", "", "a🙂b"]:
        ids, _ = own.encode([text])
        begin, end = table.offsets(ids)
        for i, token in enumerate(ids.tolist()):
            data = table.decode(np.array([token])).tobytes()
            assert data in text[begin[i] : end[i]].encode()
        assert (np.diff(begin) >= 0).all() and (not len(ids) or (begin[0] == 0 and end[-1] == len(text)))


def test_encode_and_decode(spark, rows, coder):
    docs = frame(spark, rows)
    encoded = bpe.encode(docs, PATH, offsets=True).cache()
    want = sorted([(d, coder[1].encode_ordinary(t or "")) for d, t, *_ in rows], key=str)
    assert sorted([(r["doc_id"], r["ids"]) for r in encoded.collect()], key=str) == want
    assert encoded.where("size(ids) <> size(begins) or size(ids) <> size(ends)").count() == 0
    back = bpe.decode(encoded, PATH)
    assert sorted([(r["doc_id"], bytes(r["data"]).decode()) for r in back.collect()], key=str) == sorted([(d, t or "") for d, t, *_ in rows], key=str)
    sums = bpe.digests(docs, PATH)
    assert sums.where("round_trip").count() == len(rows)
    assert sums.agg(F.sum("n_tokens")).first()[0] == sum(len(i) for _, i in want)
    assert bpe.encode(spark.createDataFrame([], SCHEMA), PATH).count() == 0
    assert bpe.decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>"), PATH).where("length(data) = 0").count() == 2


def test_language_accuracy_and_cases(spark):
    r = random.Random(7)
    stems = {"en": ["the", "ing", "tion", "wh"], "fr": ["eau", "é", "que", "oi"], "de": ["sch", "ung", "ü", "ei"]}
    rows = []
    for i in range(300):
        lang = list(stems)[i % 3]
        text = " ".join("".join(r.choice(stems[lang]) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(3, 60)))
        rows.append((i, text, lang, "s", 1))
    profiles = language.learn(frame(spark, rows[:200] + [(999, None, "en", "s", 1), (998, "abc", None, "s", 1), (997, "", "xx", "s", 1)]))
    assert list(profiles) == ["de", "en", "fr"]
    odd = [(1000, None, "en", "s", 1), (1001, "", "en", "s", 1), (1002, " 12 !\n", "en", "s", 1), (None, rows[0][1], None, None, None), (1003, "日本語" * 2000, "en", "s", 1)]
    got = language.predict(frame(spark, rows[200:] + odd), profiles).collect()
    right = [p["lang_pred"] == list(stems)[p["doc_id"] % 3] for p in got if p["doc_id"] is not None and p["doc_id"] < 1000]
    assert np.mean(right) > 0.97 and all(0 <= p["score"] <= 1 for p in got)
    by = {p["doc_id"]: p for p in got}
    assert all(by[k]["lang_pred"] == "und" and by[k]["score"] == 0 for k in (1000, 1001, 1002))
    assert by[None]["lang_pred"] == "en" and by[1003]["score"] < language.NO_EVIDENCE
    kept = language.identified(frame(spark, rows[200:] + odd), profiles)
    assert kept.columns == frame(spark, rows).columns
    assert {x["doc_id"] for x in kept.collect()} == {x["doc_id"] for x in got} - {1000, 1001, 1002, 1003}
    assert {p["lang_pred"] for p in language.predict(frame(spark, rows[:5]), {}).collect()} == {"und"}
    assert language.learn(spark.createDataFrame([], SCHEMA)) == {}


def test_random_texts_of_unlearned_scripts_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text IS NOT NULL AND lang IS NOT NULL")
    profiles = language.learn(docs, language.EVIDENCE_DIM)
    assert len(profiles) > 2
    r = random.Random(5)
    rows = []
    for first, last in ((0x430, 0x450), (0x3B1, 0x3CA), (0x4E00, 0x5E00), (0x5D0, 0x5EB), (0x627, 0x64B), (0x30A1, 0x30F7)):
        for n in (5, 100) * 25:
            text = " ".join("".join(chr(r.randrange(first, last)) for _ in range(r.randrange(2, 9))) for _ in range(n))
            rows.append((len(rows), text, None, "s", 1))
    assert language.identified(frame(spark, rows), profiles).count() <= 2  # of 300
    short = docs.where("size(split(text, ' ')) < 12 AND text rlike '[a-z]'")
    assert short.count() > 0
    assert language.identified(short, profiles).count() == short.count()


def test_bundles_in_slabs_and_groups(monkeypatch):
    texts = ["Ab cd é", None, "日本語 text of more", "zz", "Ab"] * 3
    whole = language.bundles(texts, 64)
    monkeypatch.setattr(language, "CELLS", 64 * 3)
    assert (language.bundles(texts, 64) == whole).all()
    group = np.arange(15) % 4
    assert (language.bundles(texts, 64, group) == [whole[group == g].sum(0) for g in range(4)]).all()


def test_bundle_is_the_sum_of_bound_trigrams():
    a, b, blank = (language.letter_vectors(np.array([c]), 64)[0].astype(int) for c in (ord("a"), ord("b"), 0))
    roll = np.roll
    want = roll(blank, 2) * roll(a, 1) * b + roll(a, 2) * roll(b, 1) * blank
    assert (language.bundles(["Ab", None, "12"], 64) == [want, want * 0, want * 0]).all()


RULES = [url_filter.Rule("block", "net", "/"), url_filter.Rule("allow", "good.net", "/en/"), url_filter.Rule("block", "bad.com", "/")]


def url_scores(labelled, urls):
    """The two Markov models and the scores, by the definition."""
    alphabet = "abcdefghijklmnopqrstuvwxyz0/.-"

    def codes(url):
        text = ascii_lower((url or "").split("://", 1)[-1])
        text = "".join("0" if "1" <= c <= "9" else c for c in text)
        return [0] * 3 + [alphabet.index(c) + 2 if c in alphabet else 1 for c in text] + [0]

    counts = {True: defaultdict(Counter), False: defaultdict(Counter)}
    for url, accept in labelled:
        c = codes(url)
        for i in range(3, len(c)):
            for k in range(4):
                counts[accept][tuple(c[i - k : i])][c[i]] += 1

    def chance(accept, context, symbol):
        p = 1 / 32
        for k in range(4):
            seen = counts[accept].get(context[3 - k :])
            if seen:
                p = (seen[symbol] + len(seen) * p) / (sum(seen.values()) + len(seen))
        return p

    out = {}
    for url in urls:
        c = codes(url)
        steps = [(tuple(c[i - 3 : i]), c[i]) for i in range(3, len(c))]
        out[url] = sum(math.log(chance(True, *s) / chance(False, *s)) for s in steps) / len(steps)
    return out


def test_url_filter(spark):
    urls = [f"https://{h}.{d}/{p}/{i}" for i in range(12) for h in ("x", "WWW.y") for d in ("good.net", "bad.com", "net", "other.org") for p in ("en", "shop")]
    urls += [None, "", "no scheme", "http://NET", "http://net/", "http://a.net?x/", "ftp://é.bad.com/\n#f", "://good.net/en/", "http://x.bad.com/" + "a" * 5000, urls[0], "http://xnet/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("gram", F.lit(1)).withColumn("symbols", F.lit("s"))
    out = url_filter.judge(pages, RULES)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r["page_id"]: r for r in out.collect()}
    assert len(got) == len(urls) == out.count()
    labelled = []
    for i, url in enumerate(urls):
        rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
        host = ascii_lower(rest.replace("?", "/").replace("#", "/").split("/")[0])
        path = rest[len(host) :].split("?")[0].split("#")[0]
        fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = max(fits, key=lambda r: len(r.name), default=None)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule.name if rule else None), url
        if rule:
            assert got[i]["verdict"] == rule.verdict
            labelled.append((url, rule.verdict == "allow"))
    import zlib

    train = [x for x in labelled if zlib.crc32(x[0].encode()) % url_filter.FOLDS]
    want = url_scores(train, set(urls))
    assert all(abs(got[i]["score"] - want[u]) < 1e-6 for i, u in enumerate(urls))
    free = [r for r in got.values() if r["rule"] is None]
    assert {r["verdict"] for r in free} <= {"allow", "block"}
    empty = url_filter.judge(spark.createDataFrame([], "page_id long, url string"), RULES)
    assert empty.count() == 0


SCHEMAS = {"f": {"type": "object", "required": ["x"], "properties": {"x": {"type": "integer", "minimum": 0}}, "additionalProperties": False}}


def test_tool_calls(spark):
    calls = [
        (1, 5, "c", "f", '{"x": 3}', ["b", "a"]), (1, 1, "a", "f", '{ "x" :1.0}', None), (1, 3, "b", "f", '{"x":-1,"y":0}', ["a", "zz"]),
        (2, 0, "a", "g", "{}", []), (2, 1, "p", "f", '{"x":1}', ["q"]), (2, 2, "q", "f", '{"x":1}', ["p"]), (2, 3, "r", "f", '{"x":1}', ["q"]),
        (3, 0, "a", "f", "{oops", []), (3, 0, "a", "f", None, []), (3, 1, None, "f", None, ["a", None]), (None, 0, "a", "f", '{"x":NaN}', []),
        (3, 4, "é", "f", '{"x":2}', ["a", "a"]), (3, 4, "é", "f", '{"x":2}', ["a", "a"]),
    ]
    results = [(1, 2, "a", "ok"), (1, 9, "a", "later"), (1, 4, "b", None), (9, 9, "a", "orphan"), (3, 5, "é", "ü"), (None, 1, "a", "n"), (1, 6, "c", "x")]
    calls = spark.createDataFrame(calls, "conv_id long, turn long, call_id string, name string, arguments string, needs array<string>").withColumn("key", F.lit(0))
    results = spark.createDataFrame(results, "conv_id long, turn long, call_id string, content string").withColumn("result", F.lit(0))
    got = {(r["conv_id"], r["call_id"]): r for r in tool_calls.linked(calls, results, SCHEMAS).collect()}
    assert len(got) == 11
    state = {k: (r["level"], r["status"], r["n_calls"], r["n_results"]) for k, r in got.items()}
    assert state[1, "a"] == (0, "ok", 1, 2) and state[1, "b"] == (1, "invalid", 1, 1) and state[1, "c"] == (2, "ok", 1, 1)
    assert got[1, "b"]["errors"] == ["$.x: below minimum", "$.y: unknown"] and got[1, "b"]["missing"] == ["zz"]
    assert state[2, "a"] == (0, "invalid", 1, 0) and got[2, "a"]["errors"] == ["$: no such tool"]
    assert all(state[2, c][:2] == (None, "cycle") for c in "pqr")
    assert state[3, "a"] == (0, "invalid", 2, 0) and got[3, "a"]["errors"] == ["$: missing"]
    assert state[3, None][1] == "cycle"  # it needs itself
    assert state[3, "é"] == (1, "ok", 2, 1) and state[None, "a"][1] == "invalid"
    assert got[3, "é"]["message"] == '{"call":{"arguments":{"x":2},"id":"é","name":"f","turn":4},"level":1,"result":{"content":"ü","turn":5},"status":"ok"}'
    assert json.loads(got[1, "a"]["message"])["result"] == {"content": "ok", "turn": 2}
    assert [r["content"] for r in tool_calls.orphans(calls, results).collect()] == ["orphan"]
    assert tool_calls.linked(calls.limit(0), results, SCHEMAS).count() == 0


def calls_brute(calls, results, schemas):
    """Levels by recursion over one conversation at a time; messages by the rules of the docstring."""
    rows, answers, count, times = {}, {}, Counter(), Counter()
    low = lambda x: tuple((v is not None, v) for v in x)
    for c, t, i, name, arguments, needs in calls:
        key, one = (c, i), (t, name, arguments, sorted(needs, key=lambda x: (x is None, x or "")) if needs is not None else None)
        count[key] += 1
        if key not in rows or low(one[:3]) < low(rows[key][:3]):
            rows[key] = one
    for c, t, i, content in results:
        times[c, i] += 1
        if (c, i) not in answers or low((t, content)) < low(answers[c, i]):
            answers[c, i] = (t, content)
    out = []

    def level(key, above=()):
        if key in above:
            return None
        known = {(key[0], n) for n in rows[key][3] or [] if (key[0], n) in rows}
        below = [level(n, (*above, key)) for n in known]
        return None if None in below else max(below, default=-1) + 1

    for key, (t, name, arguments, needs) in rows.items():
        missing = sorted({n for n in needs or [] if (key[0], n) not in rows and n is not None})
        value, errors = arguments, []
        try:
            if arguments is None:
                raise ValueError("missing")
            value = json.loads(arguments, parse_float=lambda x: int(float(x)) if float(x).is_integer() else float(x))
            errors = tool_calls.complaints(value, schemas[name]) if name in schemas else ["$: no such tool"]
        except ValueError as e:
            value, errors = arguments, ["$: missing" if str(e) == "missing" else "$: not JSON"]
        deep = level(key)
        status = "cycle" if deep is None else "invalid" if errors else "ok" if times[key] else "pending"
        message = {"call": {"arguments": value, "id": key[1], "name": name, "turn": t}, "level": deep, "status": status}
        if times[key]:
            message["result"] = {"content": answers[key][1], "turn": answers[key][0]}
        text = json.dumps(message, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        out.append((*key, t, name, deep, status, tuple(errors), tuple(missing), count[key], times[key], text))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed, group", [(1, 10**5), (2, 0), (3, 6)])
def test_tool_calls_equal_brute_force(spark, seed, group):
    r = random.Random(seed)
    words = ['{"x":1}', '{"y":2,"x":1.0}', "{", "[1,2]", '{"x":0.1}', None, '{"x":"é"}', '{"x":1e2}']
    calls, results = [], []
    for c in [None, *range(14)]:
        ids = [f"c{k}" for k in range(r.randrange(1, 9))]
        for k, i in enumerate(ids):
            pool = ids if r.random() < 0.1 else ids[:k]  # now and then a cycle
            needs = [*r.sample(pool, min(len(pool), r.randrange(3))), *(["gone"] if r.random() < 0.2 else [])]
            calls.append((c, k, i, r.choice(["f", "g", "h"]), r.choice(words), needs if needs or r.random() < 0.5 else None))
            for _ in range(r.choice([0, 1, 1, 2])):
                results.append((c, r.choice([k, None]), i, r.choice(["a", "b", None])))
    calls += calls[:3]
    tables = (
        spark.createDataFrame(calls, "conv_id long, turn long, call_id string, name string, arguments string, needs array<string>"),
        spark.createDataFrame(results, "conv_id long, turn long, call_id string, content string"),
    )
    got = tool_calls.linked(*tables, SCHEMAS, group).collect()
    plain = [
        (x["conv_id"], x["call_id"], x["turn"], x["name"], x["level"], x["status"], tuple(x["errors"]), tuple(x["missing"]), x["n_calls"], x["n_results"], x["message"])
        for x in got
    ]
    assert sorted(plain, key=str) == calls_brute(calls, results, SCHEMAS)


def test_tool_calls_of_odd_arguments(spark):
    """Legal JSON that Python, Arrow or UTF-8 cannot carry as it is ends no job; equal numbers have one form."""
    odd = {
        "big": '{"x":1e400}', "deep": "[" * 100_000 + "]" * 100_000, "lone": '{"x":"\\ud800","\\udfff":1}', "digits": "9" * 5000,
        "quoted": '"' + "[" * 1000 + '"', "one": '{"x":1}', "point": '{"x":1.0}', "power": '{"x":10e-1}', "zero": '{"x":-0.0}', "wide": '{"x":1e22}',
    }
    calls = spark.createDataFrame([(1, k, i, "f", a, None) for k, (i, a) in enumerate(odd.items())], "conv_id long, turn long, call_id string, name string, arguments string, needs array<string>")
    results = spark.createDataFrame([], "conv_id long, turn long, call_id string, content string")
    got = {r["call_id"]: r for r in tool_calls.linked(calls, results, {"f": {"type": "object", "properties": {"x": {"type": "integer"}}}}).collect()}
    assert got["big"]["errors"] == ["$: number out of range"] == got["digits"]["errors"] and got["deep"]["errors"] == ["$: nested too deep"]
    assert got["lone"]["errors"] == ["$.x: not integer"] and '"\\ud800"' in got["lone"]["message"] and json.loads(got["lone"]["message"])
    assert got["quoted"]["errors"] == ["$: not object"]
    numbers = [json.dumps(json.loads(got[i]["message"])["call"]["arguments"]) for i in ("one", "point", "power")]
    assert len(set(numbers)) == 1 and '{"x":1}' in got["point"]["message"] and '{"x":0}' in got["zero"]["message"]
    assert '{"x":10000000000000000000000}' in got["wide"]["message"] and got["wide"]["errors"] == []


def test_long_chain_of_calls_is_ordered_in_one_step(spark):
    calls = spark.createDataFrame(
        [(1, k, f"c{k}", "f", "{}", [f"c{k - 1}", "c0"] if k else []) for k in range(1000)],
        "conv_id long, turn long, call_id string, name string, arguments string, needs array<string>",
    )
    results = spark.createDataFrame([], "conv_id long, turn long, call_id string, content string")
    assert sorted((r["turn"], r["level"]) for r in tool_calls.linked(calls, results, SCHEMAS).collect()) == [(k, k) for k in range(1000)]


def test_schema_complaints():
    schema = {"type": "array", "items": {"type": "object", "properties": {"k": {"enum": [1, "a"]}, "s": {"type": "string", "minLength": 2, "maxLength": 3}}}}
    assert tool_calls.complaints([{"k": 1, "s": "ab"}, {}], schema) == []
    assert tool_calls.complaints([{"k": 2, "s": "a"}, 3, {"s": "abcd"}], schema) == ["$[0].k: not in enum", "$[0].s: too short", "$[1]: not object", "$[2].s: too long"]
    assert tool_calls.complaints(True, {"type": "integer"}) == ["$: not integer"] and tool_calls.complaints(None, {"type": "null"}) == []


@pytest.mark.parametrize("separator", [50256, 0xBBEF, 0x0A0A])
def test_token_files(spark, tmp_path, separator, monkeypatch):
    """Files of every awkward kind, cut by the reader at odd places."""
    monkeypatch.setattr(token_files, "BLOCK_BYTES", 700)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3001")
    r, want = np.random.default_rng(separator), {}
    try:
        for kind in range(8):
            ids = r.integers(0, 50_257, r.integers(4, 6000)).astype("<u2")
            ids[r.random(len(ids)) < 0.02] = separator
            if kind == 1:
                ids[:3] = [0xBBEF, 0x50BF, 0x41C4]  # looks like a byte order mark
            elif kind == 2:
                ids[-1] = 0x0A0A
            elif kind == 3:
                ids[-1] = separator
            elif kind == 4:
                ids[::3], ids[1::7] = (separator & 255) << 8 | separator >> 8, separator  # false matches at odd places
            elif kind == 5:
                ids[:] = separator
            data = ids.tobytes() + (b"\x50" if kind == 6 else b"") if kind < 7 else b""
            (tmp_path / f"f{kind}.bin").write_bytes(data)
            ids = ids if kind < 7 else ids[:0]
            ends = np.flatnonzero(ids == separator)
            pairs = zip(np.r_[0, ends + 1], np.r_[ends, len(ids)])
            want[f"f{kind}.bin"] = [(i, int(x), int(y - x)) for i, (x, y) in enumerate(pairs) if i < len(ends) or y > x]
        got = defaultdict(list)
        for row in token_files.token_counts(spark, str(tmp_path), separator).collect():
            got[row["file"].rsplit("/", 1)[1]].append((row["doc_no"], row["begin"], row["n_tokens"]))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_token_files_round_trip(spark, tmp_path, rows):
    encoded = bpe.encode(frame(spark, rows), PATH)
    token_files.write_token_files(encoded, str(tmp_path / "out"), 50_256)
    got = token_files.token_counts(spark, str(tmp_path / "out"), 50_256)
    want = [r["n"] for r in encoded.select(F.size("ids").alias("n")).collect()]
    assert sorted(r["n_tokens"] for r in got.collect()) == sorted(want)
    with pytest.raises(Exception, match="does not fit"):
        token_files.write_token_files(spark.createDataFrame([([70_000],)], "ids array<int>"), str(tmp_path / "bad"), 50_256)
