"""The registered queries as SQL on the same tables, written independently of the operators."""

from __future__ import annotations

import math

SEED = 42
CATALOGUE = "(SELECT count(*) FROM part)"

INTER = """
inter AS (
  SELECT o_custkey AS u, l_partkey AS i,
         CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) * 86400 AS t,
         l_orderkey, l_linenumber, l_suppkey, l_extendedprice,
         CAST(1 + floor((l_quantity - 1) / 10) AS BIGINT) AS rating,
         CASE WHEN l_returnflag = 'R' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS label,
         CAST((l_orderkey * 31 + l_partkey * 17 + l_linenumber * 7) % 100 AS DOUBLE) / 100 AS score
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

IN_TIME = "PARTITION BY u ORDER BY t, l_orderkey, l_linenumber, l_suppkey, l_extendedprice, i, rating"

HIST = f"""{INTER},
placed AS (
  SELECT u, i, t, rating, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY u) AS n,
         list(i) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h,
         list(rating) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hr
  FROM inter WINDOW w AS ({IN_TIME})),
hist AS (SELECT * FROM placed WHERE pos >= 1)"""


BROKEN = "CAST(round(l_discount * 100) AS INTEGER) = 4"


def text_list(expr: str) -> str:
    return f"array_to_string({expr}, ',')"


def draw(n: str, *key: str, seed: int = SEED) -> str:
    """Uniform number below n from the hashed key."""
    parts = ", ".join(f"CAST({k} AS VARCHAR)" for k in key)
    return f"(CAST('0x' || substr(md5(concat_ws('|', {parts}, '{seed}')), 1, 15) AS BIGINT) % ({n}))"


def long_hash(*key: str, seed: int = SEED) -> str:
    """The 60-bit number of the hashed key."""
    parts = ", ".join(f"CAST({k} AS VARCHAR)" for k in key)
    return f"CAST('0x' || substr(md5(concat_ws('|', {parts}, '{seed}')), 1, 15) AS BIGINT)"


def poisson(rows: str, mean: float, seed: int, *key: str) -> str:
    """Each row as often as a Poisson variable says: one copy for each k with a draw of at least P(X <= k)."""
    terms, below = [], 0.0
    for k in range(60):
        below += math.exp(-mean) * mean**k / math.factorial(k)
        terms.append(int(below * 2**60))
    listed = ", ".join(f"CAST({min(t, 2**60)} AS BIGINT)" for t in terms)
    return f"""
WITH drawn AS (SELECT *, {long_hash(*key, "'sample'", seed=seed)} AS h FROM ({rows})),
copies AS (SELECT *, unnest(range(len(list_filter([{listed}], lambda t: t <= h)))) AS copy FROM drawn)"""


def other(value: str, n: str, base: str, k: str, start: int = 0) -> str:
    """The k-th draw of a row out of n ids, never `value`."""
    bits = f"((({base} >> 30) * CAST({k} AS BIGINT) + ({base} & 1073741823)) % 2147483647)"
    return f"(({value} - {start} + {bits} % ({n} - 1) + 1) % {n} + {start})"


def padded(lst: str, n: int) -> str:
    """Last n values, zeros on the left."""
    return (
        f"list_concat(list_transform(range(greatest({n} - len({lst}), 0)), lambda z: CAST(0 AS BIGINT)), "
        f"list_slice({lst}, greatest(len({lst}) - {n - 1}, 1), len({lst})))"
    )


def in_order(expr: str, by: str) -> str:
    return f"string_agg(CAST({expr} AS VARCHAR), ',' ORDER BY {by})"


HISTORY = f"""
WITH {HIST}
SELECT u AS "user", t AS "time", pos, i AS item, {text_list('h')} AS items, {text_list('hr')} AS ratings FROM hist"""

TOKENS = """
words AS (
  SELECT doc_id, unnest(w) AS token, unnest(range(1, len(w) + 1)) AS place
  FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]{3,}') AS w FROM documents)),
counts AS (SELECT token, count(*) AS count FROM words GROUP BY token),
vocab AS (
  SELECT token, count, id - 10 AS id
  FROM (SELECT token, count, row_number() OVER (ORDER BY count DESC, token) AS id FROM counts)
  WHERE id > 10 AND id <= 5000)"""

CODED = f"""{TOKENS},
coded AS (
  SELECT d.doc_id, coalesce(list(v.id ORDER BY w.place) FILTER (WHERE v.id IS NOT NULL), []) AS ids
  FROM documents d LEFT JOIN words w ON d.doc_id = w.doc_id LEFT JOIN vocab v ON w.token = v.token
  GROUP BY d.doc_id)"""

HOURLY = """
hourly AS (SELECT date_trunc('hour', ts) AS ts, count(*) AS value FROM events GROUP BY 1),
numbered AS (SELECT *, row_number() OVER (ORDER BY ts) - 1 AS idx, count(*) OVER () AS n FROM hourly)"""

WINDOWS = f"""{HOURLY},
windows AS (
  SELECT idx, n - 24 AS windows,
         list(value) OVER (ORDER BY idx ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING) AS feature,
         lead(value, 24) OVER (ORDER BY idx) AS label
  FROM numbered)"""

CENTS = "CAST(round(value * 100) AS BIGINT)"

CARDS = """
cards AS (
  SELECT split_part(c_name, '#', 2) || ' ' || substr(c_mktsegment, 1, 1) AS name, s_name AS vendor, p_type AS mcc,
         l_extendedprice AS amount, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS date
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""


def by_frequency(col: str, start: int) -> str:
    return f"SELECT {col}, row_number() OVER (ORDER BY count(*) DESC, {col}) + {start - 1} AS id FROM cards GROUP BY {col}"


SCALED = "CASE WHEN s_{c} = 0 THEN CAST(0 AS DOUBLE) ELSE ({c} - m_{c}) / s_{c} END"

SENTENCES = r"""
sentences AS (
  SELECT conv_id, turn, unnest(s) AS sentence_text, unnest(range(len(s))) AS sentence
  FROM (SELECT conv_id, turn,
               string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS s
        FROM conversations)),
cut AS (
  SELECT conv_id, turn, sentence,
         list_filter(regexp_split_to_array(sentence_text, '\s+'), lambda x: x <> '') AS w
  FROM sentences)"""


def line_words(col: str) -> str:
    return f"list_append(string_split(rtrim({col}), ' '), '<eos>')"


RANKED = f"""{INTER},
ranked AS (SELECT *, rank() OVER (PARTITION BY u ORDER BY score DESC) AS rk FROM inter)"""

PAIR_SEEN = f"""{INTER},
seen AS (SELECT u + 1 AS u, i + 1 AS i FROM inter),
size AS (SELECT count(*) AS n, max(u) AS mu, max(i) AS mi FROM seen)"""


def pair_draws(rows: str, seed: int, bounds: str = "size") -> str:
    return f"""
draws AS (
  SELECT DISTINCT {draw('mu', 'id', "'u'", seed=seed)} + 1 AS u, {draw('mi', 'id', "'i'", seed=seed)} + 1 AS i
  FROM (SELECT unnest(range({rows})) AS id, mu, mi FROM {bounds})),
negatives AS (
  SELECT d.u, d.i FROM draws d WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.u = d.u AND s.i = d.i))"""


def exact_draws(amplifier: int, seed: int) -> str:
    """All free pairs in order, and one of each of as many equal runs as pairs are wanted."""
    return f"""
free AS (
  SELECT a.u, b.i, row_number() OVER (ORDER BY a.u, b.i) - 1 AS r
  FROM (SELECT unnest(range(1, mu + 1)) AS u FROM size) a, (SELECT unnest(range(1, mi + 1)) AS i FROM size) b
  WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.u = a.u AND s.i = b.i)),
asked AS (SELECT least({amplifier} * (SELECT n FROM size), (SELECT count(*) FROM free)) AS w, (SELECT count(*) FROM free) AS c),
runs AS (SELECT j, j * c // w AS lo, (j + 1) * c // w AS hi FROM (SELECT unnest(range(w)) AS j, w, c FROM asked)),
negatives AS (
  SELECT free.u, free.i FROM (SELECT lo + {draw('hi - lo', 'j', seed=seed)} AS r FROM runs) d JOIN free ON free.r = d.r)"""


def best_products(key: str, other: str) -> str:
    return f"""
WITH {INTER},
users AS (
  SELECT c_custkey AS u, c_custkey * 13 % 7 - 3 AS a, c_custkey * 29 % 11 - 5 AS b, c_custkey * 3 % 5 - 2 AS c FROM customer),
items AS (
  SELECT p_partkey AS i, p_size AS s, p_partkey * 17 % 9 - 4 AS a, p_partkey * 5 % 13 - 6 AS b, p_partkey * 3 % 7 - 3 AS c FROM part),
scored AS (
  SELECT u, i, CAST(s * (users.a * items.a + users.b * items.b + users.c * items.c + 1) AS DOUBLE) AS score FROM users, items
  WHERE NOT EXISTS (SELECT 1 FROM inter WHERE inter.u = users.u AND inter.i = items.i)),
best AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, {other}) AS rank FROM scored)"""


def scored_pairs(score: str) -> str:
    return f"""
WITH {INTER},
unseen AS (
  SELECT c_custkey AS u, p_partkey AS i, p_size FROM customer, part
  WHERE NOT EXISTS (SELECT 1 FROM inter WHERE inter.u = c_custkey AND inter.i = p_partkey)),
scored AS (SELECT u, i, CAST({score} AS DOUBLE) / 10007 AS score FROM unseen)"""


USERS = """
users AS (
  SELECT c_custkey, CASE WHEN c_acctbal < 5000 THEN 'F' ELSE 'M' END AS gender, c_nationkey + 18 AS age,
         CAST(length(c_mktsegment) AS INTEGER) AS occupation FROM customer)"""

AUC_PARTS = """
cells AS (
  SELECT count(*) FILTER (score > 0.5 AND label = 1) AS tp, count(*) FILTER (score > 0.5 AND label = 0) AS fp,
         count(*) FILTER (score <= 0.5 AND label = 0) AS tn, count(*) FILTER (score <= 0.5 AND label = 1) AS fn
  FROM inter),
rates AS (
  SELECT *, CAST(tp AS DOUBLE) / (tp + fn) AS rec, CAST(tp AS DOUBLE) / (tp + fp) AS pre,
         CAST(tn AS DOUBLE) / (tn + fp) AS spec, CAST(tn AS DOUBLE) / (tn + fn) AS npre,
         CAST(tp + fn AS DOUBLE) / (tp + fp + tn + fn) AS base,
         CAST(tp + tn AS DOUBLE) / (tp + fp + tn + fn) AS acc
  FROM cells)"""

SEQ_KEY = ("uid", "pos", "item_id", "label")

SEQUENCE = f"""
WITH {INTER},
cat AS (SELECT c, row_number() OVER (ORDER BY c) AS id FROM (SELECT DISTINCT unnest([p_type, p_brand]) AS c FROM part)),
uids AS (SELECT u, row_number() OVER (ORDER BY CAST(u AS VARCHAR)) AS uid FROM (SELECT DISTINCT u FROM inter)),
iids AS (SELECT i, row_number() OVER (ORDER BY CAST(i AS VARCHAR)) AS iid FROM (SELECT DISTINCT i FROM inter)),
facts AS (
  SELECT uid, iid, cat.id AS cid, t, l_orderkey, l_linenumber, l_suppkey, l_extendedprice
  FROM inter JOIN uids ON inter.u = uids.u JOIN iids ON inter.i = iids.i
  JOIN part ON inter.i = p_partkey JOIN cat ON p_brand = c),
catalogue AS (SELECT list(cid ORDER BY iid) AS cats, count(*) AS n FROM (SELECT iid, min(cid) AS cid FROM facts GROUP BY iid)),
placed AS (
  SELECT uid, iid, cid, t, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY uid) AS cnt,
         list(iid) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h,
         list(cid) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hc
  FROM facts
  WINDOW w AS (PARTITION BY uid ORDER BY t, l_orderkey, l_linenumber, l_suppkey, l_extendedprice, iid, cid)),
targets AS (SELECT *, (SELECT n FROM catalogue) AS n, (SELECT cats FROM catalogue) AS cats
            FROM placed WHERE pos >= 1 AND pos >= cnt - 100),
labelled AS (
  SELECT *, iid AS item_id, 1 AS label FROM targets
  UNION ALL
  SELECT * EXCLUDE base, {other('iid', 'n', 'base', '0', start=1)} AS item_id, 0 AS label
  FROM (SELECT *, {long_hash('uid', 'pos')} AS base FROM targets)),
drawn AS (
  SELECT *, list_transform(h, lambda x, k: {other('x', 'n', 'base', 'k - 1', start=1)}) AS neg
  FROM (SELECT *, {long_hash(*SEQ_KEY, "'history'")} AS base FROM labelled))
SELECT uid AS user_id, pos, item_id, cid AS cat_index, t AS "unixReviewTime", label,
       {text_list('h')} AS items, {text_list('hc')} AS cats,
       array_to_string(neg, ';') AS neg_items,
       array_to_string(list_transform(neg, lambda x: cats[x]), ';') AS neg_cats,
       {text_list(padded('h', 10))} AS items_padded,
       {text_list('list_transform(' + padded('hc', 10) + ', lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END)')} AS cats_mask
FROM drawn"""

NEG_HISTORY = f"""
WITH {HIST},
size AS (SELECT count(*) AS items, list(CAST(split_part(p_brand, '#', 2) AS BIGINT) ORDER BY p_partkey) AS cats FROM part),
drawn AS (
  SELECT u, pos, cats,
         list_transform(h, lambda x, k: [{other('x', 'items', 'base', '(k - 1) * 2')}, {other('x', 'items', 'base', '(k - 1) * 2 + 1')}]) AS neg
  FROM (SELECT *, {long_hash('u', 'pos', "'history'")} AS base FROM hist), size)
SELECT u AS "user", pos,
       array_to_string(list_transform(neg, lambda p: array_to_string(p, ',')), ';') AS neg_items,
       array_to_string(list_transform(neg, lambda p: array_to_string(list_transform(p, lambda x: cats[x + 1]), ',')), ';') AS neg_cats
FROM drawn"""

DRAWN_ROWS = f"""{HIST},
size AS (SELECT count(*) AS items FROM part),
based AS (SELECT *, {long_hash('u', 'pos')} AS base FROM hist, size),
rows AS (
  SELECT u, pos, i AS item, 1 AS label FROM hist
  UNION ALL SELECT u, pos, {other('i', 'items', 'base', '0')}, 0 FROM based
  UNION ALL SELECT u, pos, {other('i', 'items', 'base', '1')}, 0 FROM based)"""

ORACLES: dict[str, str] = {
    "category_index": """
SELECT category, row_number() OVER (ORDER BY category) AS category_id
FROM (SELECT DISTINCT unnest([p_type, p_brand]) AS category FROM part)""",
    "item_category_codes": """
WITH cat AS (SELECT c, row_number() OVER (ORDER BY c) AS id FROM (SELECT DISTINCT unnest([p_type, p_brand]) AS c FROM part))
SELECT CAST(p_partkey AS VARCHAR) AS asin, id AS categories_index FROM part JOIN cat ON p_brand = c""",
    "dense_user_index": f"""
WITH {INTER}
SELECT k AS "reviewerID", row_number() OVER (ORDER BY k) - 1 AS "reviewerID_index"
FROM (SELECT DISTINCT CAST(u AS VARCHAR) AS k FROM inter)""",
    "dense_item_index": f"""
WITH {INTER}
SELECT k AS asin, row_number() OVER (ORDER BY k) AS asin_index FROM (SELECT DISTINCT CAST(i AS VARCHAR) AS k FROM inter)""",
    "dense_order_index": f"""
WITH {INTER}
SELECT l_orderkey, row_number() OVER (ORDER BY l_orderkey) - 1 AS l_orderkey_index FROM (SELECT DISTINCT l_orderkey FROM inter)""",
    "joined_facts": f"""
WITH {INTER},
cat AS (SELECT c, row_number() OVER (ORDER BY c) AS id FROM (SELECT DISTINCT unnest([p_type, p_brand]) AS c FROM part))
SELECT CAST(rating AS DOUBLE) AS overall, t AS "unixReviewTime", l_orderkey, l_linenumber, l_suppkey, l_extendedprice,
       id AS categories_index,
       dense_rank() OVER (ORDER BY CAST(i AS VARCHAR)) - 1 AS asin_index,
       dense_rank() OVER (ORDER BY CAST(u AS VARCHAR)) - 1 AS "reviewerID_index"
FROM inter JOIN part ON i = p_partkey JOIN cat ON p_brand = c""",
    "item_categories": f"""
WITH {INTER} SELECT u AS "user", min(p_brand) AS p_brand FROM inter JOIN part ON i = p_partkey GROUP BY u""",
    "history_seq": HISTORY,
    "history_large_users": HISTORY,
    "history_recent": f"""
WITH {HIST}
SELECT u AS "user", t AS "time", pos, i AS item,
       {text_list('list_slice(h, greatest(len(h) - 9, 1), len(h))')} AS items,
       {text_list('list_slice(hr, greatest(len(hr) - 9, 1), len(hr))')} AS ratings
FROM hist WHERE pos >= n - 5""",
    "prepad_mask": f"""
WITH {HIST},
pads AS (SELECT u, pos, {padded('h', 10)} AS a, {padded('hr', 10)} AS b FROM hist)
SELECT u AS "user", pos, {text_list('a')} AS items, {text_list('b')} AS ratings,
       {text_list('list_transform(a, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END)')} AS item_mask,
       {text_list('list_transform(b, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END)')} AS rating_mask
FROM pads""",
    "neg_rows": f"""
WITH {DRAWN_ROWS} SELECT u AS "user", pos, item, label FROM rows""",
    "neg_rows_unseen": f"""
WITH {DRAWN_ROWS},
pos_items AS (SELECT DISTINCT u, i FROM hist)
SELECT rows.u AS "user", pos, item, label, CAST(split_part(p_brand, '#', 2) AS BIGINT) AS brand
FROM rows JOIN part ON item = p_partkey
WHERE label = 1 OR NOT EXISTS (SELECT 1 FROM pos_items p WHERE p.u = rows.u AND p.i = item)""",
    "neg_history": NEG_HISTORY,
    "neg_history_joined": NEG_HISTORY,
    "sequence_pipeline": SEQUENCE,
    "neg_pairs": f"""
WITH {PAIR_SEEN}, {pair_draws('n', 42)}
SELECT u AS "userIdIndex", i AS "itemIdIndex", CAST(0 AS DOUBLE) AS label FROM negatives""",
    "neg_pairs_reached": f"""
WITH {PAIR_SEEN}, {pair_draws('n', 42)}
SELECT (SELECT n FROM size) AS wanted, count(*) AS reached FROM negatives""",
    "neg_pairs_amplified": f"""
WITH {PAIR_SEEN}, {pair_draws('3 * n', 7)}
SELECT u AS "userIdIndex", i AS "itemIdIndex", CAST(0 AS DOUBLE) AS label FROM negatives""",
    "neg_pairs_exact": f"""
WITH {PAIR_SEEN}, {exact_draws(1, 42)}
SELECT u AS "userIdIndex", i AS "itemIdIndex", CAST(0 AS DOUBLE) AS label FROM negatives""",
    "neg_pairs_exact_amplified": f"""
WITH {PAIR_SEEN}, {exact_draws(3, 7)}
SELECT u AS "userIdIndex", i AS "itemIdIndex", CAST(2 AS DOUBLE) AS label FROM seen
UNION ALL SELECT u, i, CAST(0 AS DOUBLE) FROM negatives""",
    "neg_pairs_exact_reached": f"""
WITH {PAIR_SEEN}, {exact_draws(2, 42)}
SELECT 2 * (SELECT n FROM size) AS wanted, count(*) AS reached FROM negatives""",
    "neg_pairs_mixed": f"""
WITH {PAIR_SEEN},
pairs AS (SELECT DISTINCT u, i FROM seen),
psize AS (SELECT count(*) AS n, max(u) AS mu, max(i) AS mi FROM pairs), {pair_draws('n', 42, 'psize')}
SELECT u AS "userIdIndex", i AS "itemIdIndex", CAST(1 AS DOUBLE) AS label FROM pairs
UNION ALL SELECT u, i, CAST(0 AS DOUBLE) FROM negatives""",
    "implicit_pairs": f"""
WITH {PAIR_SEEN}, {pair_draws('n', 42)}
SELECT u AS "userIdIndex", i AS "itemIdIndex", CAST(2 AS DOUBLE) AS label FROM seen
UNION ALL SELECT u, i, CAST(0 AS DOUBLE) FROM negatives""",
    "pair_features": f"""
WITH {INTER}
SELECT CAST(rating AS DOUBLE) AS label, CAST(u AS DOUBLE) AS user_value, CAST(i AS DOUBLE) AS item_value FROM inter""",
    "wide_deep_features": f"""
WITH {INTER}, {USERS}
SELECT u AS "userId", i AS "itemId", rating AS label, CASE gender WHEN 'F' THEN 1 ELSE 2 END AS gender, age, occupation,
       CAST(coalesce(list_position(['ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL'], p_type), 0) AS INTEGER) AS genres,
       CAST({draw('100', 'age', 'gender')} AS INTEGER) AS age_gender
FROM inter JOIN users ON u = c_custkey JOIN part ON i = p_partkey""",
    "star_join": f"""
WITH {INTER}, {USERS}
SELECT u AS "userId", i AS "itemId", rating AS label, p_type AS genres, gender, age, occupation
FROM inter JOIN users ON u = c_custkey JOIN part ON i = p_partkey""",
    "txn_ids": f"""
WITH {CARDS}, n AS ({by_frequency('name', 1)}), v AS ({by_frequency('vendor', 1)}), m AS ({by_frequency('mcc', 0)})
SELECT n.id AS uid, v.id AS mid, amount, date, m.id AS mcc
FROM cards JOIN n ON cards.name = n.name JOIN v ON cards.vendor = v.vendor JOIN m ON cards.mcc = m.mcc""",
    "merchant_counts": f"""
WITH {CARDS}
SELECT vendor, count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, vendor) AS id FROM cards GROUP BY vendor""",
    "concat_features": """
SELECT a.vec_id, CAST(len(f) AS INTEGER) AS n, round(list_sum(f), 5) AS total, round(f[-1], 6) AS last
FROM (SELECT a.vec_id, list_transform(list_concat(a.embedding, b.embedding), lambda x: CAST(x AS DOUBLE)) AS f
      FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) a""",
    "cosine_pairs": """
WITH p AS (
  SELECT a.vec_id, list_transform(a.embedding, lambda x: CAST(x AS DOUBLE)) AS x,
         list_transform(b.embedding, lambda x: CAST(x AS DOUBLE)) AS y
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
q AS (SELECT vec_id, list_dot_product(x, y) AS d, sqrt(list_dot_product(x, x)) AS nx, sqrt(list_dot_product(y, y)) AS ny FROM p)
SELECT vec_id, round(abs(d / (nx * ny)), 6) AS cosine, round(d, 6) AS dot, round(nx, 6) AS norm FROM q""",
    "candidates_unseen": f"""
{scored_pairs('0')}
SELECT u AS "userIdIndex", count(*) AS n, CAST(sum(i) AS BIGINT) AS id_sum, min(i) AS first_id FROM unseen GROUP BY u""",
    "topn_items": f"""
{scored_pairs('(u * 7919 + i * 104729 + p_size) % 10007')},
best AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY score DESC, i) AS rank FROM scored)
SELECT u AS "userIdIndex", CAST(rank AS INTEGER) AS rank, i AS "itemIdIndex", round(score, 9) AS score FROM best WHERE rank <= 5""",
    "topn_users": f"""
{scored_pairs('(u * 7919 + i * 104729) % 10007')},
best AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, u) AS rank FROM scored)
SELECT i AS "itemIdIndex", CAST(rank AS INTEGER) AS rank, u AS "userIdIndex", round(score, 9) AS score FROM best WHERE rank <= 5""",
    "topn_products": f"""
{best_products("u", "i")}
SELECT u AS "userIdIndex", CAST(rank AS INTEGER) AS rank, i AS "itemIdIndex", score FROM best WHERE rank <= 5""",
    "topn_products_users": f"""
{best_products("i", "u")}
SELECT i AS "itemIdIndex", CAST(rank AS INTEGER) AS rank, u AS "userIdIndex", score FROM best WHERE rank <= 5""",
    "topn_given": f"""
WITH {INTER},
best AS (SELECT u, i, max(score) AS score FROM inter GROUP BY u, i),
placed AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY score DESC, i) AS r FROM best)
SELECT u AS id, {in_order('i', 'r')} AS items FROM placed WHERE r <= 3 GROUP BY u""",
    "confusion": f"""
WITH {INTER}, {AUC_PARTS}
SELECT tp, fp, tn, fn, round(acc, 3) AS accuracy, round(pre, 3) AS precision, round(rec, 3) AS recall,
       round((rec + spec) / 2, 3) AS auroc, round(rec * pre + (1 - rec) * (pre + base) / 2, 3) AS aupr FROM rates""",
    "binary_report": f"""
WITH {INTER}, {AUC_PARTS}
SELECT round((rec + spec) / 2, 3) AS auroc, round(acc, 3) AS accuracy,
       round(pre * base + npre * (1 - base), 3) AS weighted_precision, round(acc, 3) AS weighted_recall FROM rates""",
    "pr_curve": f"""
WITH {INTER},
cuts AS (SELECT CAST(c AS DOUBLE) / 50 AS cut FROM (SELECT unnest(range(1, 50)) AS c)),
sums AS (
  SELECT cut, count(*) FILTER (score > cut) AS p, count(*) FILTER (score > cut AND label = 1) AS tp,
         count(*) FILTER (label = 1) AS y FROM inter, cuts GROUP BY cut)
SELECT cut, round(CAST(tp AS DOUBLE) / nullif(p, 0), 6) AS precision, round(CAST(tp AS DOUBLE) / y, 6) AS recall FROM sums""",
    "pr_at_cut": f"""
WITH {INTER}
SELECT CAST(0.3 AS DOUBLE) AS cut,
       round(CAST(count(*) FILTER (score > 0.3 AND label = 1) AS DOUBLE) / count(*) FILTER (score > 0.3), 6) AS precision,
       round(CAST(count(*) FILTER (score > 0.3 AND label = 1) AS DOUBLE) / count(*) FILTER (label = 1), 6) AS recall
FROM inter""",
    "cut_counts": f"""
WITH {INTER}, cuts AS (SELECT unnest(range(0, 50)) AS i)
SELECT cuts.i AS i, count(*) AS predicted, count(*) FILTER (label = 1) AS tp
FROM inter, cuts WHERE cuts.i = 0 OR score > CAST(cuts.i AS DOUBLE) / 50 GROUP BY cuts.i""",
    "abs_rank": f"""
WITH {RANKED},
per_user AS (SELECT u, coalesce(avg(rk) FILTER (label = 1), 11) AS m FROM ranked WHERE rk <= 10 GROUP BY u)
SELECT CAST(trunc(m) AS INTEGER) AS rank, count(*) AS count FROM per_user GROUP BY 1""",
    "mean_rank_per_user": f"""
WITH {RANKED}
SELECT u AS "userIdIndex", round(coalesce(avg(rk) FILTER (label = 1), CAST(11 AS DOUBLE)), 6) AS mean_rank
FROM ranked WHERE rk <= 10 GROUP BY u""",
    "abs_rank_given": f"""
WITH {INTER},
per_user AS (
  SELECT u, coalesce(avg(i % 20 + 1) FILTER (label = 1), CAST(11 AS DOUBLE)) AS m FROM inter WHERE i % 20 + 1 <= 10 GROUP BY u)
SELECT CAST(trunc(m) AS INTEGER) AS rank, count(*) AS count FROM per_user GROUP BY 1""",
    "hit_ndcg": f"""
WITH {RANKED},
best AS (SELECT u, label, rk, row_number() OVER (PARTITION BY u ORDER BY label DESC, rk) AS rn FROM ranked WHERE rk <= 10)
SELECT round(avg(CASE WHEN label = 0 THEN 0 ELSE 1 END), 6) AS hit_ratio,
       round(avg(CASE WHEN label = 1 THEN ln(2) / ln(rk + 1) ELSE 0 END), 6) AS ndcg
FROM best WHERE rn = 1""",
    "top_k_rows": f"""
WITH {RANKED}
SELECT u AS "userIdIndex", i AS "itemIdIndex", score, label, CAST(rk AS INTEGER) AS rank FROM ranked WHERE rk <= 3""",
    "unlabelled_users": f"""
WITH {INTER} SELECT u AS "userIdIndex" FROM inter GROUP BY u HAVING count(*) FILTER (label = 1) = 0""",
    "score_buckets": f"""
WITH {INTER}, b AS (SELECT CAST(trunc(score * 10) AS INTEGER) AS bucket, count(*) AS count FROM inter WHERE label = 1 GROUP BY 1)
SELECT bucket, count, round(CAST(count AS DOUBLE) / (SELECT sum(count) FROM b), 6) AS percent FROM b""",
    "rating_error": f"""
WITH {INTER}, e AS (SELECT 1 + score * 4 AS p, rating AS y FROM inter)
SELECT round(sqrt(avg((p - y) * (p - y))), 6) AS rmse, round(avg((p - y) * (p - y)), 6) AS mse,
       round(CAST(count(*) FILTER (p = y) AS DOUBLE) / count(*), 6) AS accuracy, count(*) AS n FROM e""",
    "rating_error_whole": f"""
WITH {INTER},
e AS (SELECT round(1 + a.score * 4) AS p, b.rating AS y FROM inter a JOIN inter b ON a.u = b.u AND a.i = b.i),
s AS (SELECT count(*) AS n FROM inter)
SELECT round(sqrt(avg((p - y) * (p - y))), 6) AS rmse, round(avg((p - y) * (p - y)), 6) AS mse,
       round(CAST(count(*) FILTER (p = y) AS DOUBLE) / max(n), 6) AS accuracy, max(n) AS n FROM e, s""",
    "mean_abs_error": f"""
WITH {INTER}, e AS (SELECT 1 + score * 4 AS p, rating AS y FROM inter)
SELECT round(avg(abs(p - y)), 6) AS mae, round(CAST(count(*) FILTER (p = y) AS DOUBLE) / count(*), 6) AS top1 FROM e""",
    "score_expressions": f"""
WITH {INTER}
SELECT u AS "user", i AS item, score + 1 AS plus_one,
       CASE WHEN rating > 1 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS above_one,
       CASE WHEN score > 0.5 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS predicted,
       CAST(trunc(score * 10) AS INTEGER) AS bucket, round(score / 8, 3) AS eighth,
       round(ln(2) / ln(rating + 1), 6) AS gain,
       CAST(len(list_filter(range(1, 50), lambda c: score > CAST(c AS DOUBLE) / 50)) AS INTEGER) AS cuts,
       CASE WHEN label = 0 THEN 0 ELSE 1 END AS hit
FROM inter""",
    "array_expressions": f"""
WITH {INTER}, a AS (SELECT u, list(rating ORDER BY rating) AS a FROM inter GROUP BY u)
SELECT u AS "user", CAST(len(a) AS INTEGER) AS n, CASE WHEN len(a) > 1 THEN 1 ELSE 0 END AS several,
       CAST(len(list_distinct(a)) AS INTEGER) AS different,
       {text_list('list_concat(list_slice(a, 1, 3), list_slice(a, 1, 2))')} AS flat FROM a""",
    "value_counts": f"""
WITH {INTER} SELECT rating AS value, count(DISTINCT i) AS n FROM inter GROUP BY rating""",
    "id_bounds": f"""
WITH {INTER}
SELECT min(u) AS min_user, max(u) AS max_user, max(i) AS max_item, count(DISTINCT u) AS users, count(DISTINCT i) AS items FROM inter""",
    "describe_totals": """
SELECT 'count' AS summary, CAST(count(o_totalprice) AS DOUBLE) AS value FROM orders
UNION ALL SELECT 'mean', round(avg(CAST(o_totalprice AS DOUBLE)), 4) FROM orders
UNION ALL SELECT 'stddev', round(stddev_samp(CAST(o_totalprice AS DOUBLE)), 4) FROM orders
UNION ALL SELECT 'min', round(min(CAST(o_totalprice AS DOUBLE)), 4) FROM orders
UNION ALL SELECT 'max', round(max(CAST(o_totalprice AS DOUBLE)), 4) FROM orders""",
    "date_int": f"""
WITH {CARDS} SELECT date, count(*) AS n FROM cards GROUP BY date""",
    "calendar": """
SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour, CASE WHEN hour(ts) BETWEEN 6 AND 23 THEN 1 ELSE 0 END AS awake,
       CAST(isodow(ts) AS INTEGER) AS day_of_week, CAST(month(ts) AS INTEGER) AS month, CAST(day(ts) AS INTEGER) AS day
FROM events""",
    "scale_series": f"""
WITH e AS (SELECT event_id, value, value * 2 + 1 AS size FROM events),
s AS (SELECT avg(value) AS m_value, stddev_pop(value) AS s_value, avg(size) AS m_size, stddev_pop(size) AS s_size FROM e)
SELECT event_id, round({SCALED.format(c='value')}, 6) AS value, round({SCALED.format(c='size')}, 6) AS size FROM e, s""",
    "unroll": f"""
WITH {WINDOWS} SELECT idx, {text_list('feature')} AS feature, label FROM windows WHERE idx < windows""",
    "unroll_chunks": f"""
WITH e AS (
  SELECT row_number() OVER w - 1 AS idx, count(*) OVER () AS n,
         list({CENTS} || ',' || user_id) OVER (w ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS feature,
         lead({CENTS}, 7) OVER w AS label
  FROM events WINDOW w AS (ORDER BY ts, event_id))
SELECT idx, {text_list('feature')} AS feature, label FROM e WHERE idx < n - 7""",
    "unroll_per_user": f"""
WITH e AS (
  SELECT user_id, row_number() OVER w - 1 AS idx, count(*) OVER (PARTITION BY user_id) AS n,
         list({CENTS}) OVER (w ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS feature, lead({CENTS}, 5) OVER w AS label
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, idx, {text_list('feature')} AS feature, label FROM e WHERE idx < n - 5""",
    "unroll_partial": f"""
WITH {HOURLY}
SELECT idx, {text_list('list(value) OVER (ORDER BY idx ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING)')} AS feature
FROM (SELECT * FROM numbered WHERE idx < greatest(24, n - 24))""",
    "flat_windows": f"""
WITH {WINDOWS}
SELECT idx, CAST(len(feature) AS INTEGER) AS steps, 1 AS width, CAST(list_sum(feature) AS BIGINT) AS total
FROM windows WHERE idx < windows""",
    "strided_windows": f"""
WITH e AS (
  SELECT row_number() OVER w - 1 AS idx, count(*) OVER () AS n,
         list(event_id) OVER (w ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS v
  FROM events WINDOW w AS (ORDER BY ts, event_id))
SELECT idx, {text_list('v')} AS "window" FROM e WHERE idx % 7 = 0 AND idx + 7 < n""",
    "time_split": f"""
WITH {WINDOWS}
SELECT idx, label, CASE WHEN idx >= windows - 100 THEN 'test' ELSE 'train' END AS split FROM windows WHERE idx < windows""",
    "time_split_gap": f"""
WITH {WINDOWS}
SELECT idx, CASE WHEN idx >= windows - 100 THEN 'test' ELSE 'train' END AS split
FROM windows WHERE idx < windows AND (idx >= windows - 100 OR idx < windows - 124)""",
    "taxi_windows": f"""
WITH {HOURLY},
f AS (SELECT idx, n, CAST(value AS DOUBLE) AS value, CAST(hour(ts) AS DOUBLE) AS hour,
             CASE WHEN hour(ts) >= 6 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS awake FROM numbered),
s AS (SELECT avg(value) AS m_value, stddev_pop(value) AS s_value, avg(hour) AS m_hour, stddev_pop(hour) AS s_hour,
             avg(awake) AS m_awake, stddev_pop(awake) AS s_awake FROM f),
z AS (SELECT idx, n, {SCALED.format(c='value')} AS value, {SCALED.format(c='hour')} AS hour, {SCALED.format(c='awake')} AS awake FROM f, s)
SELECT idx, CASE WHEN idx >= n - 12 - 100 THEN 'test' ELSE 'train' END AS split, round(label, 5) AS label,
       round(value, 5) AS value, round(hour, 5) AS hour, round(awake, 5) AS awake, 12 AS n
FROM (SELECT *, lead(value, 12) OVER (ORDER BY idx) AS label FROM z) WHERE idx < n - 12""",
    "sensor_windows": f"""
WITH d AS (SELECT CAST(ts AS DATE) AS ts, avg(value) AS value FROM events GROUP BY 1),
s AS (SELECT avg(value) AS m_value, stddev_pop(value) AS s_value, count(*) AS n FROM d),
z AS (SELECT row_number() OVER (ORDER BY ts) - 1 AS idx, n, {SCALED.format(c='value')} AS value FROM d, s),
w AS (SELECT idx, n, lead(value, 5) OVER (ORDER BY idx) AS label, lead(value, 4) OVER (ORDER BY idx) AS last FROM z)
SELECT idx, CASE WHEN idx >= n - 5 - 6 THEN 'test' ELSE 'train' END AS split, round(label, 5) AS label, round(last, 5) AS last
FROM w WHERE idx < n - 5""",
    "column_means": """
SELECT pos, round(avg(CAST(x AS DOUBLE)), 6) AS mean
FROM (SELECT unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM embeddings) GROUP BY pos""",
    "word_counts": f"WITH {TOKENS} SELECT token, count FROM counts",
    "vocab": f"WITH {TOKENS} SELECT token, count, id FROM vocab",
    "doc_tokens": f"WITH {CODED} SELECT doc_id, {text_list('ids')} AS ids FROM coded",
    "padded_tokens": f"WITH {CODED} SELECT doc_id, {text_list(padded('ids', 200))} AS ids FROM coded",
    "longest_doc": f"WITH {TOKENS} SELECT CAST(max(n) AS INTEGER) AS longest FROM (SELECT count(*) AS n FROM words GROUP BY doc_id)",
    "doc_vectors": f"""
WITH {CODED},
p AS (SELECT doc_id, {padded('ids', 50)} AS ids FROM coded),
x AS (SELECT doc_id, unnest(ids) AS id FROM p)
SELECT doc_id, 50 AS places, 3200 AS n,
       round(coalesce(sum(list_sum(list_transform(embedding, lambda e: CAST(e AS DOUBLE)))), 0), 4) AS total
FROM x LEFT JOIN embeddings ON id = vec_id + 1 GROUP BY doc_id""",
    "word_vectors": f"""
WITH {TOKENS}
SELECT id, token, CAST(len(embedding) AS INTEGER) AS n,
       round(list_sum(list_transform(embedding, lambda e: CAST(CAST(e AS VARCHAR) AS DOUBLE))), 4) AS total
FROM vocab JOIN embeddings ON id = vec_id + 1""",
    "text_features": f"""
WITH {CODED},
p AS (SELECT doc_id, {padded('ids', 50)} AS ids FROM coded),
x AS (SELECT doc_id, unnest(ids) AS id FROM p),
t AS (SELECT doc_id, round(coalesce(sum(list_sum(list_transform(embedding, lambda e: CAST(e AS DOUBLE)))), 0), 4) AS total
      FROM x LEFT JOIN embeddings ON id = vec_id + 1 GROUP BY doc_id)
SELECT p.doc_id, CASE WHEN {draw('1000000', 'p.doc_id')} / CAST(1000000 AS DOUBLE) < 0.8 THEN 0 ELSE 1 END AS split,
       {text_list('ids')} AS ids, 50 AS places, total
FROM p JOIN t ON p.doc_id = t.doc_id""",
    "linear_fit": """
SELECT CAST(2 AS DOUBLE) AS w0, CAST(2 AS DOUBLE) AS w1, CAST(0.4 AS DOUBLE) AS intercept""",
    "index_binarize": """
WITH ranked AS (SELECT p_type, row_number() OVER (ORDER BY count(*) DESC, p_type) - 1 AS k FROM part GROUP BY p_type)
SELECT part.p_type AS test_string, p_size / CAST(50 AS DOUBLE) AS test_double, CAST(k AS DOUBLE) AS test_string_index,
       CASE WHEN p_size / CAST(50 AS DOUBLE) > 0.5 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS test_double_bin
FROM part JOIN ranked ON part.p_type = ranked.p_type""",
    "doc_mean_vectors": f"""
WITH {CODED},
x AS (SELECT doc_id, unnest(ids) AS id FROM coded),
m AS (SELECT doc_id, sum(CAST(embedding[1] AS DOUBLE)) / count(*) AS a, sum(CAST(embedding[32] AS DOUBLE)) / count(*) AS b,
             sum(CAST(embedding[64] AS DOUBLE)) / count(*) AS c FROM x LEFT JOIN embeddings ON id = vec_id + 1 GROUP BY doc_id)
SELECT d.doc_id, round(coalesce(a, 0), 6) AS x0, round(coalesce(b, 0), 6) AS x31, round(coalesce(c, 0), 6) AS x63
FROM documents d LEFT JOIN m ON d.doc_id = m.doc_id""",
    "sentence_tokens": f"""
WITH {SENTENCES}
SELECT conv_id, turn, sentence, CAST(len(w) + 2 AS INTEGER) AS n, '<s> ' || array_to_string(w, ' ') || ' </s>' AS tokens
FROM cut WHERE len(w) > 0""",
    "corpus_ids": f"""
WITH known AS (
  SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) AS id
  FROM (SELECT unnest({line_words('text')}) AS token FROM benchmark) GROUP BY token),
w AS (SELECT conv_id, turn, unnest({line_words('text')}) AS token,
             unnest(range(len({line_words('text')}))) AS place FROM conversations)
SELECT conv_id, turn, {in_order('CASE WHEN id <= 500 THEN id + 1 ELSE 1 END', 'w.place')} AS ids
FROM w LEFT JOIN known ON w.token = known.token GROUP BY conv_id, turn""",
    "stream_windows": f"""
WITH known AS (
  SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) AS id
  FROM (SELECT unnest({line_words('text')}) AS token FROM benchmark) GROUP BY token),
w AS (SELECT conv_id, turn, unnest({line_words('text')}) AS token,
             unnest(range(len({line_words('text')}))) AS place FROM conversations),
e AS (SELECT conv_id, turn, place, CASE WHEN id <= 500 THEN id + 1 ELSE 1 END AS id FROM w LEFT JOIN known ON w.token = known.token),
r AS (SELECT row_number() OVER o - 1 AS idx, count(*) OVER () AS n, list(id) OVER (o ROWS BETWEEN CURRENT ROW AND 20 FOLLOWING) AS v
      FROM e WINDOW o AS (ORDER BY conv_id, turn, place))
SELECT idx, {text_list('v')} AS "window" FROM r WHERE idx % 20 = 0 AND idx + 20 < n""",
    "next_tokens": f"""
WITH {SENTENCES},
t AS (SELECT conv_id, turn, sentence, list_append(list_prepend('<s>', w), '</s>') AS k FROM cut WHERE len(w) > 0),
x AS (SELECT conv_id, turn, sentence, unnest(k) AS token, unnest(range(len(k))) AS place FROM t),
known AS (SELECT token, least(row_number() OVER (ORDER BY count(*) DESC, token), 1001) AS id FROM x GROUP BY token),
c AS (SELECT conv_id, turn, sentence, list(id ORDER BY place) AS ids, count(*) AS n
      FROM x JOIN known ON x.token = known.token GROUP BY conv_id, turn, sentence),
m AS (SELECT max(n) - 1 AS length FROM c),
e AS (SELECT max(id) FILTER (WHERE token = '</s>') AS e, max(id) FILTER (WHERE token = '<s>') AS s FROM known)
SELECT conv_id, turn, sentence,
       {text_list('list_concat(list_slice(ids, 1, n - 1), list_transform(range(length - n + 1), lambda z: e.e))')} AS input,
       {text_list('list_concat(list_slice(ids, 2, n), list_transform(range(length - n + 1), lambda z: e.s))')} AS target
FROM c, m, e""",
    "one_hot": f"""
WITH w AS (SELECT item_id, unnest({line_words('text')}) AS token, unnest(range(len({line_words('text')}))) AS place FROM benchmark),
known AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) AS id FROM w GROUP BY token)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY w.place) - 1 AS pos, 102 AS width, least(id, 101) AS place
FROM w JOIN known ON w.token = known.token""",
    "parse_ratings": f"""
WITH {INTER} SELECT CAST(u AS INTEGER) AS "userId", CAST(i AS INTEGER) AS "itemId", CAST(rating AS INTEGER) AS label FROM inter""",
    "parse_ratings_double": f"""
WITH {INTER} SELECT CAST(u AS DOUBLE) AS "userIdIndex", CAST(i AS DOUBLE) AS "itemIdIndex", CAST(rating AS DOUBLE) AS label FROM inter""",
    "parse_ratings_strict": f"""
WITH {INTER}
SELECT CAST(u AS INTEGER) AS "userId", CAST(i AS INTEGER) AS "movieId", CAST(rating AS FLOAT) AS rating, t AS timestamp FROM inter""",
    "parse_items": """
SELECT CAST(p_partkey AS INTEGER) AS "itemId", p_name AS title, p_type AS genres FROM part""",
    "hash_split": f"""
SELECT o_orderkey, CASE WHEN {draw('1000000', 'o_orderkey')} / CAST(1000000 AS DOUBLE) < 0.8 THEN 0 ELSE 1 END AS split FROM orders""",
    "checked_rows": f"""
SELECT l_orderkey, CAST(l_linenumber AS INTEGER) AS l_linenumber, CAST(l_quantity AS INTEGER) AS quantity FROM lineitem WHERE NOT ({BROKEN})""",
    "quarantined_lines": f"""
SELECT concat_ws(',', l_orderkey, l_linenumber, concat('about ', CAST(l_quantity AS INTEGER))) AS line FROM lineitem WHERE {BROKEN}""",
    "quarantine_counts": f"""
SELECT count(*) AS read, count(*) FILTER (WHERE NOT ({BROKEN})) AS kept, count(*) FILTER (WHERE {BROKEN}) AS quarantined FROM lineitem""",
    "file_line_numbers": """
SELECT strftime(o_orderdate, '%Y-%m') AS month,
       row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y-%m') ORDER BY o_orderkey) - 1 AS line_no,
       concat_ws('|', o_orderkey, o_custkey) AS value FROM orders""",
    "manifest_means": """
SELECT strftime(ts, '%Y-%m-%d') AS day, round(avg(CAST(value AS DOUBLE)), 6) AS mean_value, round(avg(CAST(user_id AS DOUBLE)), 6) AS mean_user
FROM events WHERE isodow(ts) < 6 GROUP BY ALL""",
    "indexed_join": f"""
WITH {INTER}
SELECT u AS "user", c_nationkey, count(*) AS n, CAST(sum(rating) AS BIGINT) AS total FROM inter JOIN customer ON u = c_custkey GROUP BY ALL""",
    "ridge_grid": f"""
WITH {INTER},
rows AS (
  SELECT score AS a, CAST(rating AS DOUBLE) AS b, 0.4 + 2 * score - 0.5 * rating + CAST(u % 10 AS DOUBLE) / 10.0 AS y,
         CASE WHEN {draw('1000000', 'l_orderkey')} / CAST(1000000 AS DOUBLE) < 0.8 THEN 0 ELSE 1 END AS part FROM inter),
mean AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM rows WHERE part = 0),
sums AS (
  SELECT sum((a - ma) ** 2) AS aa, sum((a - ma) * (b - mb)) AS ab, sum((b - mb) ** 2) AS bb, sum((a - ma) * (y - my)) AS ay,
         sum((b - mb) * (y - my)) AS by_ FROM rows, mean WHERE part = 0),
fit AS (
  SELECT l, ((bb + l) * ay - ab * by_) / ((aa + l) * (bb + l) - ab * ab) AS wa,
         ((aa + l) * by_ - ab * ay) / ((aa + l) * (bb + l) - ab * ab) AS wb
  FROM sums, (SELECT unnest([0.0, 0.1, 1, 3, 10, 30, 100, 300, 1000, 3000, 10000, 100000])::DOUBLE AS l)),
full_fit AS (SELECT l, wa, wb, my - wa * ma - wb * mb AS w0 FROM fit, mean)
SELECT l AS penalty, round(any_value(wa), 6) AS w_score, round(any_value(wb), 6) AS w_rating, round(any_value(w0), 6) AS intercept,
       round(sqrt(avg((w0 + wa * a + wb * b - y) ** 2) FILTER (WHERE part = 0)), 6) AS train_rmse,
       round(sqrt(avg((w0 + wa * a + wb * b - y) ** 2) FILTER (WHERE part = 1)), 6) AS test_rmse
FROM full_fit, rows GROUP BY l""",
    "random_split": f"""
SELECT o_orderkey, CASE WHEN {draw('1000000', 'o_orderkey')} / CAST(1000000 AS DOUBLE) < 0.8 THEN 'train' ELSE 'test' END AS split FROM orders""",
    "bootstrap_sample": f"""
{poisson('SELECT o_orderkey FROM orders', 0.2, SEED, 'o_orderkey')}
SELECT o_orderkey FROM copies""",
    "bootstrap_lines": f"""
{poisson('SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem', 1.0, 7, 'l_orderkey', 'l_linenumber')}
SELECT l_orderkey, l_linenumber, l_partkey FROM copies""",
    "preview_orders": """
SELECT o_orderkey, o_custkey, o_totalprice, CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS position
FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20""",
    "shuffled_rows": "SELECT o_orderkey, o_custkey FROM orders",
}
