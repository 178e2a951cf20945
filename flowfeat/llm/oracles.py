"""SQL forms (DuckDB) of the text queries that SQL can express."""

from flowfeat.llm.hilbert import curve

ORACLES: dict[str, str] = {}


def _crc32(hexes: str) -> str:
    """SQL for the CRC-32 (polynomial 0xEDB88320) of the bytes that the expression `hexes` spells in hexadecimal."""
    codes = f"list_transform(regexp_extract_all({hexes}, '..'), lambda h: CAST('0x' || h AS BIGINT))"
    bits = "list_reduce(list_prepend(xor(acc, b), range(8)), lambda v, i: xor(v >> 1, CAST(3988292384 AS BIGINT) * (v & 1)))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda acc, b: {bits}), 4294967295)"


ORACLES["op3_exact_dedup"] = r"""
WITH body AS (
    SELECT doc_id, length(coalesce(text, '')) AS points,
           regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS b
    FROM documents
),
ranked AS (
    SELECT doc_id, b, count(*) OVER (PARTITION BY b) AS group_size,
           first_value(doc_id) OVER (PARTITION BY b ORDER BY points DESC, doc_id) AS keep_id
    FROM body
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(b) AS text_sha256
FROM ranked
"""

ORACLES["op1_decontaminate"] = r"""
WITH doc AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
),
item AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
),
place AS (
    SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM item WHERE len(w) > 0
),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[p : p + n - 1], ' ') AS g FROM place),
lengths AS (SELECT DISTINCT n FROM win),
spot AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM doc, lengths WHERE len(w) >= n),
gram AS (SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS g FROM spot),
hit AS (SELECT doc_id, p, gram.n, item_id FROM gram JOIN win ON gram.n = win.n AND gram.g = win.g),
cover AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
names AS (
    SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id
)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN cover ON doc.doc_id = cover.doc_id LEFT JOIN names ON doc.doc_id = names.doc_id
"""

ORACLES["op4_minhash"] = r"""
WITH RECURSIVE doc AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x20\x09-\x0D]+') AS w
    FROM documents
),
shingle AS (
    SELECT DISTINCT doc_id, array_to_string(w[p : p + 4], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM doc WHERE len(w) > 0)
),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
common AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingle x JOIN shingle y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL
),
link AS (
    SELECT a, b FROM common JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)
),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (
    SELECT doc_id, doc_id AS root FROM doc
    UNION
    SELECT edge.b, reach.root FROM reach JOIN edge ON edge.a = reach.doc_id
),
root AS (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id)
SELECT root.doc_id, coalesce(n, 0) AS n_shingles, component_id, root.doc_id = component_id AS kept
FROM root LEFT JOIN size ON root.doc_id = size.doc_id
"""

ORACLES["op8_substring_dedup"] = r"""
WITH doc AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
    SELECT doc_id, p, array_to_string(w[p : p + 49], ' ') AS g
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM doc WHERE len(w) >= 50)
),
earliest AS (SELECT g, min(doc_id) AS d FROM win GROUP BY g),
gone AS (
    SELECT DISTINCT doc_id, q FROM (
        SELECT doc_id, unnest(range(p, p + 50)) AS q FROM win JOIN earliest ON win.g = earliest.g WHERE earliest.d < win.doc_id
    )
),
word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS q FROM doc),
kept AS (
    SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.q) AS s, count(*) AS n
    FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.q = gone.q
    WHERE gone.q IS NULL GROUP BY word.doc_id
)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) AS BIGINT) - coalesce(n, 0) AS n_removed,
       sha256(coalesce(s, '')) AS kept_sha256
FROM doc LEFT JOIN kept ON doc.doc_id = kept.doc_id
"""

ORACLES["op7_line_dedup"] = r"""
WITH doc AS (SELECT doc_id, coalesce(text, '') AS t, string_split(text, chr(10)) AS l FROM documents),
line AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM doc),
pair AS (SELECT doc_id, i, x, lead(x) OVER (PARTITION BY doc_id ORDER BY i) AS y FROM line),
gone AS (
    SELECT DISTINCT doc_id, unnest([i, i + 1]) AS i FROM (
        SELECT doc_id, i, row_number() OVER (PARTITION BY x, y ORDER BY doc_id, i) AS k
        FROM pair WHERE y IS NOT NULL AND (trim(x, ' ') <> '' OR trim(y, ' ') <> '')
    ) WHERE k > 1
),
kept AS (
    SELECT line.doc_id, string_agg(x, chr(10) ORDER BY line.i) AS s, count(*) AS n
    FROM line LEFT JOIN gone ON line.doc_id = gone.doc_id AND line.i = gone.i
    WHERE gone.i IS NULL GROUP BY line.doc_id
)
SELECT doc.doc_id, CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(l), 0) AS BIGINT) - coalesce(n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM doc LEFT JOIN kept ON doc.doc_id = kept.doc_id
"""

ORACLES["op11_ranked_search"] = r"""
WITH word AS (
    SELECT d, doc_id, unnest(w) AS term, len(w) AS n
    FROM (SELECT row_number() OVER () AS d, doc_id,
                 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
          FROM documents)
),
total AS (SELECT count(DISTINCT d) AS n_docs, count(*) AS n_terms FROM word),
posting AS (SELECT d, doc_id, n, term, count(*) AS tf FROM word GROUP BY ALL),
weight AS (
    SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM posting, total GROUP BY term, n_docs
),
ask AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark
),
part AS (
    SELECT d, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms))) AS s
    FROM posting JOIN weight USING (term), total
),
score AS (
    SELECT item_id, d, doc_id, sum(s) AS score FROM ask JOIN part ON ask.term = part.term GROUP BY ALL HAVING sum(s) > 0
),
placed AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM score)
SELECT item_id, CAST(r AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM placed WHERE r <= 10
"""

ORACLES["op13_prefix_trie"] = rf"""
WITH numbered AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p,
           md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS h, length(coalesce(text, '')) AS n
    FROM conversations WHERE conv_id IS NOT NULL
),
ids AS (SELECT conv_id, count(*) AS turns, conv_id - conv_id % 100 AS base, {_crc32("hex(CAST(conv_id AS VARCHAR))")} % 6 AS h FROM numbered GROUP BY conv_id),
plan AS (SELECT ids.*, least(ids.h, coalesce(b.turns, 0)) AS taken FROM ids LEFT JOIN ids b ON ids.base = b.conv_id),
path AS (
    SELECT plan.conv_id, p AS depth, numbered.h, n FROM plan JOIN numbered ON base = numbered.conv_id AND p <= taken
    UNION ALL
    SELECT plan.conv_id, p - plan.h + taken, numbered.h, n FROM plan JOIN numbered ON plan.conv_id = numbered.conv_id AND p > plan.h
),
whole AS (
    SELECT plan.conv_id, coalesce(list(path.h ORDER BY depth) FILTER (WHERE depth IS NOT NULL), []) AS hs,
           coalesce(list(n ORDER BY depth) FILTER (WHERE depth IS NOT NULL), []) AS ns
    FROM plan LEFT JOIN path ON plan.conv_id = path.conv_id GROUP BY plan.conv_id
),
prefix AS (SELECT conv_id, d AS depth, hs[1:d] AS k, hs[1:d - 1] AS up, coalesce(ns[d], 0) AS n, d = len(hs) AS ends
           FROM (SELECT *, unnest(range(0, len(hs) + 1)) AS d FROM whole)),
node AS (
    SELECT k, depth, any_value(up) AS up, any_value(n) AS n, min(conv_id) AS conv_id, count(*) AS n_convs,
           sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
    FROM prefix GROUP BY k, depth
),
kids AS (SELECT up AS k, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY up),
full_node AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids ON node.k = kids.k),
below AS (
    SELECT top, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * n) AS saved_tokens
    FROM (SELECT k[1:a] AS top, n_children, n_convs, n FROM (SELECT *, unnest(range(0, depth + 1)) AS a FROM full_node))
    GROUP BY top
)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, parent.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM full_node f JOIN below ON f.k = below.top LEFT JOIN node parent ON f.depth > 0 AND f.up = parent.k
"""

ORACLES["op12_hilbert_shards"] = rf"""
WITH RECURSIVE move AS MATERIALIZED (SELECT CAST({curve(3)[0]} AS BIGINT[]) AS m),
doc AS (
    SELECT doc_id, lang, source, strlen(coalesce(text, '')) + 16 AS size,
           CASE WHEN coalesce(text, '') = '' THEN 0 ELSE {_crc32("hex(encode(text))")} END AS c
    FROM documents
),
-- cells of a dimension: all values if they are fewer than 32, else about equal counts of rows
seen AS (
    SELECT j, v, s, row_number() OVER (PARTITION BY j ORDER BY v, s) AS r, count(*) OVER (PARTITION BY j) AS m,
           (coalesce(sum(n) OVER (PARTITION BY j ORDER BY v, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 31) // sum(n) OVER (PARTITION BY j) AS q
    FROM (SELECT 0 AS j, NULL AS v, lang AS s, count(*) AS n FROM doc WHERE lang IS NOT NULL GROUP BY lang
          UNION ALL SELECT 1, NULL, source, count(*) FROM doc WHERE source IS NOT NULL GROUP BY source
          UNION ALL SELECT 2, size, NULL, count(*) FROM doc GROUP BY size)
),
reach AS (
    SELECT j, v, s, CASE WHEN m < 32 THEN r ELSE dense_rank() OVER (PARTITION BY j ORDER BY q) END AS reached FROM seen
),
cell AS (
    SELECT j, v, s, (reached * 32) // (max(reached) OVER (PARTITION BY j) + 1) AS x FROM reach
),
spot AS (
    SELECT doc.*, coalesce(a.x, 0) AS x0, coalesce(b.x, 0) AS x1, coalesce(d.x, 0) AS x2
    FROM doc LEFT JOIN cell a ON a.j = 0 AND a.s = doc.lang LEFT JOIN cell b ON b.j = 1 AND b.s = doc.source
         LEFT JOIN cell d ON d.j = 2 AND d.v = doc.size
),
walk AS (
    SELECT doc_id, size, c, x0, x1, x2, 4 AS level, CAST(0 AS BIGINT) AS place, CAST(0 AS BIGINT) AS state FROM spot
    UNION ALL
    SELECT doc_id, size, c, x0, x1, x2, level - 1, place * 8 + (step >> 16), step & 65535
    FROM (SELECT walk.*, m[state * 8 + ((x0 >> level) & 1) + 2 * ((x1 >> level) & 1) + 4 * ((x2 >> level) & 1) + 1] AS step FROM walk, move WHERE level >= 0)
),
ranked AS (
    SELECT doc_id, size, c, row_number() OVER (ORDER BY place, c, doc_id NULLS FIRST, size) - 1 AS rank, count(*) OVER () AS n
    FROM walk WHERE level = -1
)
SELECT doc_id, size, c AS text_crc32, 'rows' AS law, CAST((rank * 40) // n AS INTEGER) AS shard,
       rank - (((rank * 40) // n) * n + 39) // 40 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM ranked
"""
