"""SQL of the operators that SQL can express."""

from __future__ import annotations

_WORD = r"'[^\x20\x09-\x0D]+'"

# 3: copies of a document at most; 4503599627370496: two to the power of 52.
PARETO_MIXING = f"""
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), {_WORD})) AS BIGINT) AS size FROM documents),
docs AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY source NULLS FIRST, size) AS row_no, length(bin(size)) AS bits FROM sized),
weighted AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM docs GROUP BY source),
levels AS (
  SELECT *, 3 * source_size AS cap, row_number() OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST) AS place,
    CAST(sum(source_size) OVER () AS BIGINT) AS total, CAST(sum(weight) OVER () AS BIGINT) AS weights FROM weighted),
steps AS (
  SELECT *, CAST(sum(cap) OVER (ORDER BY place) - cap AS BIGINT) AS capped, CAST(sum(weight) OVER (ORDER BY place) - weight AS BIGINT) AS used FROM levels),
fill AS (
  SELECT (total - capped) / (weights - used) AS level FROM steps WHERE (total - capped) / (weights - used) * weight <= cap ORDER BY place LIMIT 1),
targets AS (SELECT source, source_size, least(coalesce((SELECT level FROM fill), 0) * weight, CAST(cap AS DOUBLE)) AS target FROM levels),
classes AS (SELECT source, bits, CAST(sum(size) AS BIGINT) AS words FROM docs WHERE size > 0 GROUP BY source, bits),
rates AS (
  SELECT c.*, t.target, CAST(sum(words) OVER down - words AS BIGINT) AS above,
    CAST(sum(words * bits) OVER (PARTITION BY c.source) - sum(words * bits) OVER down + words * bits AS BIGINT) AS rest
  FROM classes c JOIN targets t ON c.source IS NOT DISTINCT FROM t.source WINDOW down AS (PARTITION BY c.source ORDER BY bits DESC)),
chosen AS (
  SELECT source, arg_max((target - above * 3) / rest, bits) AS rate FROM rates WHERE (target - above * 3) / rest * bits <= 3 GROUP BY source),
expected AS (
  SELECT r.source, r.bits, r.words, r.target, least(coalesce(c.rate * r.bits, 3), 3) AS e
  FROM rates r LEFT JOIN chosen c ON r.source IS NOT DISTINCT FROM c.source),
odds AS (
  SELECT source, bits, CAST(floor(e) AS BIGINT) AS certain, e - floor(e) AS chance,
    target - sum(words * CAST(floor(e) AS BIGINT)) OVER (PARTITION BY source) AS room FROM expected),
drawn AS (
  SELECT d.*, o.certain, o.room, (u / (1 - u)) / (o.chance / (1 - o.chance)) AS q FROM (
    SELECT *, (CAST(CAST('0x' || substr(md5(concat_ws('|', 'mix', coalesce(CAST(doc_id AS VARCHAR), ''), row_no)), 1, 13) AS BIGINT) AS DOUBLE) + 0.5)
      / 4503599627370496 AS u FROM docs WHERE size > 0) d
  JOIN odds o ON d.source IS NOT DISTINCT FROM o.source AND d.bits = o.bits WHERE o.chance > 0),
ranked AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q, doc_id, row_no) <= room AS sampled FROM drawn),
gaps AS (
  SELECT source, any_value(room) - coalesce(sum(size) FILTER (sampled), 0) AS gap FROM ranked GROUP BY source HAVING count(*) FILTER (NOT sampled) > 0),
first AS (
  SELECT * FROM (
    SELECT r.source, r.doc_id, r.row_no, r.size, row_number() OVER (PARTITION BY r.source ORDER BY abs(r.size - gap), q, doc_id, row_no) AS n
    FROM ranked r JOIN gaps g ON r.source IS NOT DISTINCT FROM g.source WHERE NOT sampled AND r.size <= gap) WHERE n = 1),
second AS (
  SELECT * FROM (
    SELECT r.source, r.doc_id, r.row_no, row_number() OVER (PARTITION BY r.source ORDER BY abs(r.size - gap + coalesce(f.size, 0)), q, r.doc_id, r.row_no) AS n
    FROM ranked r JOIN gaps g ON r.source IS NOT DISTINCT FROM g.source LEFT JOIN first f ON r.source IS NOT DISTINCT FROM f.source
    WHERE NOT sampled AND NOT (r.doc_id IS NOT DISTINCT FROM f.doc_id AND r.row_no IS NOT DISTINCT FROM f.row_no)
      AND abs(r.size - gap + coalesce(f.size, 0)) < gap - coalesce(f.size, 0)) WHERE n = 1),
extra AS (
  SELECT doc_id, row_no FROM ranked WHERE sampled UNION ALL SELECT doc_id, row_no FROM first UNION ALL SELECT doc_id, row_no FROM second)
SELECT d.doc_id, d.size, t.source_size, t.target,
  CAST((coalesce(o.certain, 0) + CASE WHEN x.row_no IS NULL THEN 0 ELSE 1 END) * d.size AS BIGINT) AS taken
FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
LEFT JOIN odds o ON d.source IS NOT DISTINCT FROM o.source AND d.bits = o.bits AND d.size > 0
LEFT JOIN extra x ON d.doc_id IS NOT DISTINCT FROM x.doc_id AND d.row_no = x.row_no"""

PREFIX_JOIN = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORD}) AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
SELECT w.doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, least(w.doc_id, min(r.b)) AS component_id
FROM words w LEFT JOIN sizes z ON w.doc_id = z.doc_id LEFT JOIN reach r ON r.a = w.doc_id GROUP BY w.doc_id"""



def _crc32(text: str) -> str:
    """crc32 of a text, bit by bit: every byte is followed by eight shifts."""
    steps = f"flatten(list_transform(range(1, 2 * strlen({text}) + 1, 2), lambda i: [CAST('0x' || substr(hex(encode({text})), i, 2) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"
    return f"xor(list_reduce({steps}, lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END, 4294967295), 4294967295)"


def _leaf(text: str) -> str:
    values = ["doc_id", "source", "lang", "n_chars", text]
    return "sha256(" + " || ".join(f"coalesce(strlen(CAST({v} AS VARCHAR)) || ':' || CAST({v} AS VARCHAR), '-')" for v in values) + ")"


def _tree(name: str, nodes: str) -> str:
    """Levels of the trees, and each node's siblings where its run has a parent."""
    return f"""
{name} AS (
  SELECT 0 AS level, key, i, node, count(*) OVER (PARTITION BY key) AS n FROM {nodes}
  UNION ALL
  SELECT level + 1, key, i // 3, sha256(string_agg(node, '' ORDER BY i)), (n + 2) // 3 FROM {name} WHERE n > 1 GROUP BY level, key, i // 3, n),
{name}_steps AS (
  SELECT a.level, a.key, a.i, coalesce(string_agg(b.node, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.node, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
  FROM {name} a JOIN {name} b ON a.level = b.level AND a.key = b.key AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY a.level, a.key, a.i)"""


# The divisor says which documents are tampered with; a text only loses its line feeds.
MERKLE_MANIFEST = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS key, {_leaf('text')} AS node,
    CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf('text')} END AS changed FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, node) - 1 AS i FROM leaves),{_tree('grown', 'placed')},
subroots AS (SELECT '' AS key, key AS name, node, row_number() OVER (ORDER BY encode(key)) - 1 AS i FROM grown WHERE n = 1),{_tree('united', 'subroots')},
climbed AS (
  SELECT doc_id, key, i AS leaf_i, i, 0 AS level, node AS leaf, changed AS h, '' AS proof FROM placed
  UNION ALL
  SELECT c.doc_id, c.key, c.leaf_i, c.i // 3, c.level + 1, c.leaf, sha256(s.l || c.h || s.r), c.proof || s.l || s.r
  FROM climbed c JOIN grown_steps s ON c.key = s.key AND c.i = s.i AND c.level = s.level),
tops AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key, leaf_i ORDER BY level DESC) AS last FROM climbed) WHERE last = 1),
crossed AS (
  SELECT t.doc_id, t.key, t.leaf_i, s.i, 0 AS level, t.leaf, s.node AS subroot, t.h, t.proof FROM tops t JOIN subroots s ON t.key = s.name
  UNION ALL
  SELECT c.doc_id, c.key, c.leaf_i, c.i // 3, c.level + 1, c.leaf, c.subroot, sha256(s.l || c.h || s.r), c.proof || s.l || s.r
  FROM crossed c JOIN united_steps s ON c.i = s.i AND c.level = s.level),
ended AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key, leaf_i ORDER BY level DESC) AS last FROM crossed) WHERE last = 1)
SELECT e.doc_id, e.leaf, e.subroot, u.node AS root, sha256(e.proof) AS proof_sha256, e.h AS folded_root, e.h = u.node AS verified
FROM ended e CROSS JOIN (SELECT node FROM united WHERE n = 1) u"""

_RUNS = "[A-Za-z\u00C0-\u00FF]+"
SPELLING_VARIANTS = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_RUNS}')) AS run FROM documents)
  WHERE length(run) >= 5 GROUP BY ALL),
hashed AS (SELECT run, n, {_crc32("(doc_id || ':' || run)")} AS h FROM runs),
typed AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM typed WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
holes AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words),
cut AS (SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest FROM holes),
pairs AS (
  SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.p = b.p AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON c.rest = w.word),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, encode(near)) AS form, max(near_n) AS form_n FROM pairs GROUP BY word),
forms AS (
  SELECT w.word, w.n, CASE WHEN b.form_n >= 2 * w.n THEN b.form END AS form, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.form_n >= 2 * w.n THEN b.form_n END AS form_n
  FROM words w LEFT JOIN best b USING (word)),
steps AS (
  SELECT word, word AS reached, 0 AS depth FROM forms
  UNION ALL SELECT s.word, f.form, s.depth + 1 FROM steps s JOIN forms f ON s.reached = f.word WHERE f.form IS NOT NULL),
roots AS (SELECT word, arg_max(reached, depth) AS root FROM steps GROUP BY word)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM forms JOIN roots USING (word)"""

THRESHOLD_SEARCH = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
numbered AS (SELECT *, row_number() OVER (ORDER BY vec_id, v) AS row_no FROM whole),
scored AS (
  SELECT q.row_no, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM numbered q JOIN numbered c ON q.vec_id % 100 = 0 AND q.row_no <> c.row_no AND len(q.v) = len(c.v)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY row_no ORDER BY score DESC, vec_id) AS place FROM scored)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM ranked WHERE place <= 10"""

ORACLES = {
    "op1_pareto_mixing": PARETO_MIXING,
    "op4_grouped_prefix_join": PREFIX_JOIN,
    "op11_merkle_manifest": MERKLE_MANIFEST,
    "op12_spelling_variants": SPELLING_VARIANTS,
    "op13_threshold_search": THRESHOLD_SEARCH,
}
