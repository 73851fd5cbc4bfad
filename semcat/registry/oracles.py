"""The registered queries as SQL over the same tables."""

from __future__ import annotations

from semcat.functions.ids import NAMESPACE
from semcat.functions.text import SPACES
from semcat.operators.normalise import TOPIC_URL
from semcat.registry.fixtures import DIM, EVENTS_PER_PAGE
from semcat.registry.queries import K

_BLANKS = f"'{SPACES}'"
_WORD = r"'[^ \t\n\f\r]+'"


def strip(x: str) -> str:
    return f"trim({x}, {_BLANKS})"


def uuid5(x: str) -> str:
    ns = NAMESPACE.replace("-", "")
    h = f"sha1(from_hex('{ns}') || encode({x}))"
    return (
        f"(SELECT substr(h,1,8)||'-'||substr(h,9,4)||'-5'||substr(h,14,3)||'-'"
        f"||translate(substr(h,17,1),'0123456789abcdef','89ab89ab89ab89ab')||substr(h,18,3)"
        f"||'-'||substr(h,21,12) FROM (SELECT {h} AS h))"
    )


def html(x: str) -> str:
    """Text of HTML that has only the entities and raw elements of ``pages``.

    A node may end in "&amp" cut off before its semicolon, which still counts.
    """
    bare = x
    for pattern in ("<!--.*?-->", "<script[^>]*>.*?</script>", "<style[^>]*>.*?</style>"):
        bare = f"regexp_replace({bare}, '{pattern}', '<!>', 'gis')"
    node = "n"
    entities = {"lt": "<", "gt": ">", "quot": '"', "nbsp": "\u00a0", "copy": "©", "middot": "·", "amp": "\x01"}
    for name, ch in entities.items():
        node = f"replace({node}, '&{name};', '{ch}')"
    node = f"replace(regexp_replace({node}, '&amp$', '&'), '\x01', '&')"
    nodes = f"list_transform(string_split_regex({bare}, '<[^>]*>'), lambda n: {strip(node)})"
    return (
        f"CASE WHEN coalesce({x}, '') = '' THEN 'N/A' "
        f"WHEN contains({x}, '<') AND contains({x}, '>') "
        f"THEN array_to_string(list_filter({nodes}, lambda t: t <> ''), ' ') "
        f"ELSE {strip(x)} END"
    )


def stamp(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S.%f')"


_PROGRAMMES = f"""prog AS (
  SELECT d.doc_id AS row_order, {uuid5("CAST(d.doc_id AS VARCHAR)")} AS uuid,
    CASE WHEN l.quality = 0 THEN 'N/A' ELSE 'doc/' || d.doc_id END AS id_url,
    'https://example.org/' || d.doc_id AS url,
    split_part(d.text, chr(10), 1) AS title, d.text AS description,
    CASE WHEN d.lang = 'fr' THEN 'N/A' ELSE d.source END AS short_description,
    CASE WHEN d.lang IN ('fr', 'es') THEN 'N/A' ELSE d.text END AS full_description,
    [d.source, d.lang] AS funding_area, [d.lang] AS funding_location,
    o.o_orderdate AS date_1, e.ts AS date_2, l.toxic = 1 AS deleted
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
  LEFT JOIN orders o ON o.o_orderkey = d.doc_id LEFT JOIN events e ON e.event_id = d.doc_id)"""

_POINTS = f"""points AS (
  SELECT vec_id, label, {uuid5("CAST(vec_id AS VARCHAR)")} AS uuid, embedding::DOUBLE[] AS v FROM embeddings)"""

_RANKED = f"""{_POINTS},
scored AS (
  SELECT CAST(q.vec_id AS VARCHAR) AS qid, p.uuid, p.vec_id, p.label,
    round(list_cosine_similarity(p.v, q.v), 12) AS score FROM points p, points q),
ranked AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, uuid) AS rank FROM scored)
  WHERE rank <= {K})"""

_ITEM_STATUS = "CASE WHEN value < 10 THEN '31094501' WHEN value < 25 THEN '31094502' WHEN value < 50 THEN '31094503' ELSE '31094509' END"
_ITEMS = f"""items AS (
  SELECT event_id // {EVENTS_PER_PAGE} + 1 AS page, event_id, event_type, user_id, ts, {_ITEM_STATUS} AS status,
    event_type <> 'view' AS english FROM events)"""
_CALL_KEPT = "status <> '31094509' AND english"


def _ingested(kept: str) -> str:
    return f"""WITH {_ITEMS}, calls AS (
  SELECT *, 'Event ' || event_type || ' of user ' || user_id AS full_text FROM items WHERE {kept})
SELECT {uuid5("CAST(user_id AS VARCHAR)")} AS uuid, md5(CAST(user_id AS VARCHAR)) AS id_hash, 'EV-' || event_id AS id_url, 'N/A' AS title,
  'event ' || event_type || chr(10) || chr(10) || full_text AS description, CAST(user_id AS VARCHAR) AS more_info,
  event_type || '|u' || user_id AS funding_area, status = '31094503' AS deleted, 'event ' || event_type AS project_short_description,
  strftime(ts, '%Y-%m-%d %H:%M:%S.%g') || '000' AS date_1, 'N/A' AS checksum
FROM calls WHERE length(full_text) >= 25"""


_TOPK = f"""WITH {_RANKED}
SELECT qid, rank, uuid, round(score, 5) AS score FROM ranked"""

_COLLAPSED = f"""{_RANKED},
matches AS (
  SELECT *, CASE WHEN label = 0 THEN uuid ELSE 'label/' || label END AS project_id, 'vec ' || vec_id AS title FROM ranked)"""


def _collapse(source: str, project: str) -> str:
    return f"""SELECT qid, min(rank) AS rank, {project} AS project_id, arg_min(title, rank) AS project_title,
  CAST(1 AS BIGINT) AS n_areas, round(max(score), 5) AS matching_score
FROM {source} GROUP BY qid, {project}"""


_SEARCH = f"""{_RANKED}, {_PROGRAMMES},
results AS (
  SELECT r.qid, min(r.rank) AS rank, p.id_url AS project_id, max(r.score) AS score, arg_min(p, r.rank) AS m
  FROM ranked r JOIN prog p ON p.uuid = r.uuid GROUP BY r.qid, p.id_url)"""
_HEADING = "'[' || m.title || '](' || m.url || ')'"
_SHOWN = "'%d %b %Y, %H:%M'"
_BOTH = "m.date_1 IS NOT NULL AND m.date_2 IS NOT NULL"
_PERCENT = "format('{:.1f} %', score * 100)"

_TOKENS = f"toks AS (SELECT doc_id, regexp_extract_all(text, {_WORD}) AS t FROM documents)"
_STARTS = "range(0, CAST(greatest(0, ceil((len(t) - {w}) / {s}.0)) AS BIGINT) * {s} + 1, {s})"
_WINDOWS = f"""{_TOKENS},
cuts AS (SELECT doc_id, t, unnest({_STARTS.format(w=384, s=288)}) AS s FROM toks WHERE len(t) > 0),
chunk AS (SELECT doc_id, s // 288 AS chunk_no, list_slice(t, s + 1, s + 384) AS w FROM cuts)"""


def _facets(values: str) -> str:
    """Representatives of (col, ord, pos, v) rows with ASCII values."""
    key = "trim(regexp_replace(regexp_replace(lower(trim(v, ' ')), '[\\s&/-]+', '_', 'g'), '[^\\w]', '', 'g'), '_')"
    return f"""WITH vals AS ({values}),
keyed AS (SELECT *, {key} AS k FROM vals WHERE v IS NOT NULL),
marked AS (
  SELECT *, (lower(trim(v, ' ')) IN ('none', 'nan', '', 'null') OR length(k) <= 2) AS bad,
    (CASE WHEN regexp_matches(v, '[A-Z]') THEN 2 ELSE 0 END) + (CASE WHEN contains(v, ' ') THEN 2 ELSE 0 END)
    - (CASE WHEN contains(v, '_') THEN 1 ELSE 0 END)
    - (CASE WHEN regexp_matches(v, '[a-z]') AND NOT regexp_matches(v, '[A-Z]') THEN 1 ELSE 0 END) AS score
  FROM keyed),
best AS (
  SELECT col, v, row_number() OVER (PARTITION BY col, k ORDER BY score DESC, ord, pos) AS n FROM marked WHERE NOT bad)
SELECT DISTINCT col AS "column", trim(v, ' ') AS value FROM best WHERE n = 1
UNION SELECT DISTINCT col, 'Unknown' FROM marked WHERE bad"""


_SPELLINGS = """SELECT 'names' AS col, p_partkey AS ord, x.pos, x.v FROM part, LATERAL (
    SELECT unnest([0, 1, 2, 3]) AS pos, unnest([replace(p_name, ' ', '_'),
      array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' '),
      upper(p_name), replace(p_name, ' ', '-')]) AS v) x"""
_VARIANTS = f"""{_SPELLINGS}
  UNION ALL SELECT 'kind', p_partkey, 0, CASE WHEN p_size > 25 THEN ' ' || p_type ELSE lower(p_type) END FROM part
  UNION ALL SELECT 'brand', p_partkey, 0, CASE WHEN p_size > 3 THEN p_brand WHEN p_size > 2 THEN ' NaN ' END FROM part
  UNION ALL SELECT 'odd', p_partkey, 0, CASE WHEN p_size < 10 THEN 'ab' END FROM part
  UNION ALL SELECT 'odd', p_partkey, 1, CASE WHEN p_size > 40 THEN 'N/A' END FROM part"""

_REMAINING = f"""{_PROGRAMMES}, existing AS (SELECT {uuid5("CAST(vec_id AS VARCHAR)")} AS uuid FROM embeddings),
gone AS (SELECT uuid FROM prog WHERE deleted),
remaining AS (SELECT uuid FROM existing WHERE uuid NOT IN (SELECT uuid FROM gone)),
fresh AS (SELECT * FROM prog WHERE NOT deleted AND uuid NOT IN (SELECT uuid FROM remaining))"""

_CALLS = """calls AS (
  SELECT d.doc_id AS row_order, ' ID-' || d.doc_id AS id, CASE WHEN d.lang <> 'es' THEN 'Title ' || d.doc_id END AS title,
    CASE WHEN l.quality = 0 THEN 'CALL-' || d.source END AS call_id, d.source AS programme,
    CASE WHEN l.toxic = 1 THEN '31094503' WHEN d.lang = 'fr' THEN '31094509'
         WHEN l.quality = 1 THEN '31094501' ELSE '31094502' END AS status_code,
    e.ts AS ts, 'https://example.org/' || d.doc_id AS url,
    CASE WHEN d.lang = 'de' THEN '<b>' || d.source || '</b> &amp;amp; x' WHEN d.lang = 'en' THEN d.text END AS summary,
    coalesce(p.html, d.text) AS description_html, d.source AS source, d.lang AS lang, d.doc_id AS doc_id
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN pages p ON p.page_id = d.doc_id
  LEFT JOIN events e ON e.event_id = d.doc_id)"""

_ORDER_TAGS = "CASE WHEN o_orderstatus = 'P' THEN [NULL] WHEN o_orderstatus = 'F' THEN [o_orderpriority, NULL, o_orderstatus] END"

ORACLES = {
    "q_uuid5": f"""SELECT doc_id, {uuid5("CAST(doc_id AS VARCHAR)")} AS uuid, {uuid5("text")} AS text_uuid FROM documents""",
    "q_idhash_fallback": """SELECT doc_id, source_id, md5(source_id) AS id_hash FROM (
  SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'CALL ' || d.source WHEN l.quality = 1 THEN 'ID-' || d.doc_id
    WHEN d.lang = 'en' THEN 'doc/' || d.doc_id ELSE 'title ' || d.doc_id END AS source_id
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)""",
    "q_html_text": f"SELECT page_id, {html('html')} AS text FROM pages",
    "q_html_text_parser": f"SELECT page_id, {html('html')} AS text FROM pages",
    "q_sections": r"""SELECT doc_id, nullif(regexp_extract(w, '<h3>\s*Kurztext\s*</h3>(.*?)<h3>\s*Volltext\s*</h3>', 1), '') AS short,
  nullif(regexp_extract(w, '<h3>\s*Volltext\s*</h3>(.*)$', 1), '') AS full_text
FROM (SELECT doc_id, '<h3>Kurztext</h3>' || source || ' ' || lang || '<h3> Volltext </h3>' || text AS w FROM documents)""",
    "q_null_default": "SELECT doc_id, CASE WHEN lang IN ('fr', 'es') THEN 'N/A' ELSE lang END AS lang FROM documents",
    "q_english": """SELECT doc_id, coalesce(lang <> 'es' AND starts_with(lang, 'en'), false) OR lang = 'de'
  OR starts_with(lower(source), 'en') AS english FROM documents""",
    "q_combine_desc": """SELECT doc_id, summary, CASE WHEN summary <> text THEN summary || chr(10) || chr(10) || text ELSE text END AS description
FROM (SELECT doc_id, text, CASE WHEN lang = 'de' THEN source ELSE text END AS summary FROM documents)""",
    "q_keywords": """SELECT doc_id, CASE WHEN lang = 'de' THEN lang || '|b' ELSE lang || '|' || source || '|b' END AS keywords FROM documents""",
    "q_parse_ts": f"""SELECT event_id,
  CASE event_type WHEN 'view' THEN {stamp("ts")} WHEN 'click' THEN strftime(ts, '%Y-%m-%d %H:%M:%S') || '.500000'
    WHEN 'purchase' THEN strftime(ts, '%Y-%m-%d %H:%M:%S') || '.250000' END AS call_time,
  CASE event_type WHEN 'view' THEN {stamp("ts")} WHEN 'click' THEN strftime(ts, '%Y-%m-%d %H:%M:%S') || '.500000'
    WHEN 'error' THEN strftime(ts, '%Y-%m-%d %H:%M:%S') || '.000000'
    WHEN 'purchase' THEN strftime(ts, '%Y-%m-%d %H:%M:%S') || '.250000' END AS iso_time
FROM events""",
    "q_json_first": """SELECT event_id, k, k AS nested, 'a|' || k || '|a' AS listed
FROM (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events)""",
    "q_topic_url": f"""SELECT n_nationkey, CASE WHEN n_regionkey > 1 THEN '{TOPIC_URL}' || n_name END AS url FROM nation""",
    "q_list_display": f"""SELECT o_orderkey,
  CASE WHEN tags IS NULL OR len(tags) = 0 THEN 'N/A' ELSE coalesce(array_to_string(list_filter(tags, lambda x: x IS NOT NULL), ', '), '') END AS joined,
  CAST(coalesce(len(tags), 1) AS BIGINT) AS n_api,
  CAST(coalesce(len(list_filter(tags, lambda x: x IS NOT NULL)), 0) AS BIGINT) AS n_compact,
  strftime(o_orderdate, {_SHOWN}) AS shown_date,
  format('{{:.1f}} %', CAST(trunc(o_totalprice) AS BIGINT) / 1000000.0 * 100) AS shown_score
FROM (SELECT *, {_ORDER_TAGS} AS tags FROM orders)""",
    "q_rename_conform": f"""SELECT CAST(o_orderkey AS VARCHAR) AS id_hash, o_orderpriority AS title, {stamp("o_orderdate")} AS date_1,
  CASE WHEN o_orderstatus = 'F' THEN {stamp("o_orderdate")} END AS date_2, o_orderstatus = 'F' AS deleted,
  CAST(NULL AS VARCHAR) AS id_url, CAST(-1 AS BIGINT) AS n_areas, CAST(29 AS BIGINT) AS n_columns FROM orders""",
    "q_status_filter": """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN '31094503' ELSE '31094502' END AS status,
  o_orderstatus = 'F' AS deleted FROM orders WHERE o_orderstatus IN ('F', 'O')""",
    "q_normalise_calls": f"""WITH {_CALLS},
cleaned AS (SELECT *, {html("description_html")} AS full_text, {html("summary")} AS clean_summary FROM calls),
short AS (SELECT *, CASE WHEN clean_summary = 'N/A' THEN full_text ELSE clean_summary END AS short_text,
  coalesce(call_id, 'ID-' || doc_id) AS source_id FROM cleaned)
SELECT row_order, md5(source_id) AS id_hash, 'ID-' || doc_id AS id_url, url, coalesce(title, 'N/A') AS title,
  CASE WHEN short_text <> full_text THEN short_text || chr(10) || chr(10) || full_text ELSE full_text END AS description,
  call_id AS more_info, 'Zuschuss' AS funding_type, source || '|' || lang AS funding_area, 'EU' AS funding_location,
  CAST(0 AS BIGINT) AS n_eligible, programme AS funding_body, {stamp("ts")} AS date_1, CAST(NULL AS VARCHAR) AS date_2,
  status_code = '31094503' AS deleted, short_text AS project_short_description, full_text AS project_full_description,
  source_id AS uuid_source_call_id
FROM short WHERE status_code <> '31094509' AND length({strip("full_text")}) >= 25""",
    "q_clean_programmes": f"""WITH raw AS (
  SELECT page_id, CASE WHEN page_id > 0 THEN ' ' || url END AS url, '<p>' || url || '</p>' || chr(9) AS short, html FROM pages)
SELECT page_id, {html("url")} AS url, {html("'<h3>Kurztext</h3>' || short || '<h3>Volltext</h3>' || html")} AS description,
  'N/A' AS more_info, {html("short")} AS project_short_description,
  {html("nullif(regexp_extract(html, '^.*$', 0), '')")} AS project_full_description,
  {uuid5(html("url"))} AS uuid FROM raw""",
    "q_clean_strings": f"""SELECT doc_id, {strip("text")} AS text, CASE WHEN lang = 'fr' THEN 'N/A' ELSE lang || ' <b>' END AS lang FROM documents""",
    "q_page_cut": f"""WITH counts AS (SELECT event_id // {EVENTS_PER_PAGE} + 1 AS page, count(*) FILTER (event_type = 'error') AS n FROM events GROUP BY 1)
SELECT event_id // {EVENTS_PER_PAGE} + 1 AS page, 'EV-' || event_id AS id FROM events
WHERE event_type = 'error' AND event_id // {EVENTS_PER_PAGE} + 1 < coalesce((SELECT min(page) FROM counts WHERE n = 0), 9223372036854775807)""",
    "q_requested_items": f"""WITH {_ITEMS} SELECT page, count(*) AS n_items FROM items
WHERE event_type = 'click' AND status <> '31094509' GROUP BY page""",
    "q_calls": f"""WITH {_ITEMS} SELECT page, 'EV-' || event_id AS id, CAST(user_id AS VARCHAR) AS call_id, status AS status_code,
  strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || '+0200' AS start_date, '{TOPIC_URL}EV-' || event_id AS url,
  'event ' || event_type AS summary, '<p>Event <b>' || event_type || '</b> of user ' || user_id || '</p>' AS description_html,
  event_type || '|u' || user_id AS keywords, CASE event_type WHEN 'click' THEN 'en' WHEN 'signup' THEN NULL ELSE 'EN' END AS language,
  CASE event_type WHEN 'signup' THEN 'de|en-GB' ELSE '' END AS metadata_languages
FROM items WHERE {_CALL_KEPT}""",
    "q_page_stats": f"""WITH {_ITEMS} SELECT page, count(*) AS raw, count(*) FILTER ({_CALL_KEPT}) AS kept,
  count(*) FILTER (status = '31094509') AS dropped_status, count(*) FILTER (status <> '31094509' AND NOT english) AS dropped_language
FROM items GROUP BY page""",
    "q_json_snapshot": f"""WITH {_CALLS} SELECT id, title, call_id, status_code, description_html, summary,
  source || '|' || lang || '|' || source || '|ID-' || doc_id AS keywords FROM calls""",
    "q_ingest_pages": _ingested(_CALL_KEPT),
    "q_ingest_asked_pages": _ingested(f"{_CALL_KEPT} AND event_type = 'click'"),
    "q_stream_calls": f"""WITH {_ITEMS} SELECT status AS status_code, count(*) AS n_calls, count(DISTINCT event_id) AS n_ids
FROM items WHERE {_CALL_KEPT} GROUP BY status""",
    "q_zip_scan": "SELECT doc_id, lang, source, text FROM documents",
    "q_read_archives": "SELECT doc_id, text FROM documents",
    "q_ingest_dump": f"""WITH {_PROGRAMMES} SELECT {uuid5("md5(url)")} AS uuid, md5(url) AS id_hash, {strip("title")} AS title,
  {strip("description")} AS description, 'N/A' AS project_short_description, {stamp("date_1")} AS date_1,
  coalesce(CAST(deleted AS VARCHAR), 'unknown') AS deleted FROM prog""",
    "q_facets": _facets("SELECT 'p_name' AS col, p_partkey AS ord, 0 AS pos, p_name AS v FROM part"),
    "q_facets_multi": _facets(_VARIANTS),
    "q_facet_options": "SELECT value FROM (" + _facets(_SPELLINGS) + ")",
    "q_chunks": f"""WITH {_WINDOWS} SELECT doc_id, chunk_no, array_to_string(w, ' ') AS chunk_text FROM chunk""",
    "q_chunks_codec": f"""WITH texts AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE text <> ''),
cuts AS (SELECT *, unnest({_STARTS.format(w=1000, s=900).replace("len(t)", "n")}) AS s FROM texts)
SELECT doc_id, s // 900 AS chunk_no, substr(text, s + 1, 1000) AS chunk_text FROM cuts""",
    "q_chunk_counts": f"""WITH {_TOKENS} SELECT doc_id, CAST(CASE WHEN len(t) = 0 THEN 0 ELSE len({_STARTS.format(w=50, s=30)}) END AS BIGINT) AS n_chunks FROM toks""",
    "q_embed_hash": f"""WITH {_WINDOWS},
words AS (SELECT doc_id, chunk_no, CAST('0x' || substr(md5(lower(unnest(w))), 1, 8) AS BIGINT) AS code FROM chunk),
cells AS (SELECT doc_id, chunk_no, (code >> 1) % 768 AS cell, sum(CASE WHEN code & 1 = 1 THEN 1 ELSE -1 END) AS n FROM words GROUP BY ALL)
SELECT doc_id, chunk_no, count(*) FILTER (n <> 0) AS n_values, CAST(coalesce(sum(sign(n) * (cell + 1)), 0) AS BIGINT) AS signature
FROM cells GROUP BY doc_id, chunk_no""",
    "q_withdrawn": f"WITH {_REMAINING} SELECT uuid FROM existing INTERSECT SELECT uuid FROM gone",
    "q_remaining": f"WITH {_REMAINING} SELECT uuid FROM remaining",
    "q_new_rows": f"WITH {_REMAINING} SELECT uuid, description FROM fresh",
    "q_ids_scan": f"SELECT DISTINCT {uuid5('CAST(vec_id AS VARCHAR)')} AS uuid FROM embeddings",
    "q_upsert": f"""WITH {_PROGRAMMES}, {_POINTS}, docs AS (SELECT uuid FROM prog WHERE deleted IS NOT NULL)
SELECT uuid, CAST(0 AS BIGINT) AS chunk_no, round(v[1], 5) AS first_value FROM points WHERE uuid NOT IN (SELECT uuid FROM docs)
UNION ALL SELECT uuid, 7, 1.0 FROM docs""",
    "q_delete": f"WITH {_REMAINING} SELECT uuid, CAST(0 AS BIGINT) AS chunk_no FROM remaining",
    "q_sync": f"""WITH {_REMAINING}, toks AS (SELECT uuid, regexp_extract_all(description, {_WORD}) AS t FROM fresh)
SELECT uuid, CAST(len({_STARTS.format(w=384, s=288)}) AS BIGINT) AS n_points FROM toks WHERE len(t) > 0
UNION ALL SELECT uuid, 1 FROM remaining""",
    "q_sync_stats": f"""WITH {_REMAINING}, toks AS (SELECT uuid, regexp_extract_all(description, {_WORD}) AS t FROM fresh),
cut AS (SELECT uuid, CAST(len({_STARTS.format(w=384, s=288)}) AS BIGINT) AS n FROM toks WHERE len(t) > 0)
SELECT (SELECT count(*) FROM existing WHERE uuid IN (SELECT uuid FROM gone)) AS deleted,
  2 * (SELECT count(*) FROM fresh) AS new_rows, (SELECT count(*) FROM cut) AS embedded_programmes,
  CAST((SELECT coalesce(sum(n), 0) FROM cut) AS BIGINT) AS embedded_chunks, (SELECT count(*) FROM fresh) AS duplicate_uuids,
  (SELECT count(*) FROM fresh) - (SELECT count(*) FROM cut) AS without_vectors,
  (SELECT count(*) FROM prog WHERE uuid IS NULL) AS null_uuids""",
    "q_stream_refresh": f"WITH {_PROGRAMMES} SELECT uuid, description FROM prog WHERE NOT deleted AND regexp_matches(description, '\\S')",
    "q_stream_points": f"""WITH {_PROGRAMMES}, toks AS (SELECT uuid, regexp_extract_all(description, {_WORD}) AS t FROM prog WHERE NOT deleted)
SELECT uuid, CAST(len({_STARTS.format(w=384, s=288)}) - 1 AS BIGINT) AS chunk_no FROM toks WHERE len(t) > 0""",
    "q_search_text": f"""WITH {_PROGRAMMES},
toks AS (SELECT uuid AS id, regexp_extract_all(description, {_WORD}) AS t FROM prog WHERE NOT deleted),
cuts AS (SELECT id, t, unnest({_STARTS.format(w=384, s=288)}) AS s FROM toks WHERE len(t) > 0),
texts AS (
  SELECT 'p' AS side, id, s // 288 AS chunk_no, list_slice(t, s + 1, s + 384) AS w FROM cuts
  UNION ALL SELECT 'q', conv_id || '-' || turn, 0, regexp_extract_all(text, {_WORD})
  FROM conversations WHERE role = 'user' AND text <> ''),
words AS (SELECT side, id, chunk_no, CAST('0x' || substr(md5(lower(unnest(w))), 1, 8) AS BIGINT) AS code FROM texts),
cells AS (
  SELECT side, id, chunk_no, (code >> 1) % 768 AS cell, sum(CASE WHEN code & 1 = 1 THEN 1 ELSE -1 END) AS n FROM words GROUP BY ALL),
vals AS (
  SELECT side, id, chunk_no, cell,
    CAST(CAST(n / sqrt(sum(n * n) OVER (PARTITION BY side, id, chunk_no)) AS FLOAT) AS DOUBLE) AS x FROM cells WHERE n <> 0),
lens AS (SELECT side, id, chunk_no, sqrt(sum(x * x)) AS len FROM vals GROUP BY ALL),
dots AS (SELECT q.id AS qid, p.id AS uuid, p.chunk_no, sum(q.x * p.x) AS dot FROM vals q JOIN vals p ON q.cell = p.cell
  WHERE q.side = 'q' AND p.side = 'p' GROUP BY ALL),
scored AS (
  SELECT q.id AS qid, p.id AS uuid, p.chunk_no, round(coalesce(dot / (ql.len * pl.len), 0), 12) AS score
  FROM texts q JOIN texts p ON q.side = 'q' AND p.side = 'p'
  LEFT JOIN dots d ON d.qid = q.id AND d.uuid = p.id AND d.chunk_no = p.chunk_no
  LEFT JOIN lens ql ON ql.side = 'q' AND ql.id = q.id
  LEFT JOIN lens pl ON pl.side = 'p' AND pl.id = p.id AND pl.chunk_no = p.chunk_no),
ranked AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, uuid, chunk_no) AS rank FROM scored) WHERE rank <= 20),
results AS (
  SELECT r.qid, min(r.rank) AS rank, p.id_url AS project_id, max(r.score) AS score, arg_min(p, r.rank) AS m
  FROM ranked r JOIN prog p ON p.uuid = r.uuid GROUP BY r.qid, p.id_url)
SELECT qid, rank, project_id, m.title AS project_title, array_to_string(m.funding_area, '|') AS funding_area,
  round(score, 5) AS matching_score FROM results
WHERE len(list_intersect(m.funding_location, ['en', 'fr', 'de'])) > 0
  AND len(list_intersect(m.funding_area, ['en', 'src1', 'src2', 'de'])) > 0
  AND NOT (m.short_description = 'N/A' AND m.full_description = 'N/A')""",
    "q_topk_single": f"""WITH {_POINTS}, one AS (SELECT list_transform(range({DIM}), lambda i: CAST(i % 5 - 2 AS DOUBLE)) AS q)
SELECT uuid, round(score, 5) AS score FROM (SELECT uuid, list_cosine_similarity(v, q) AS score FROM points, one)
ORDER BY score DESC, uuid LIMIT 50""",
    "q_topk_batch": _TOPK,
    "q_topk_blocked": _TOPK,
    "q_collapse_hits": f"WITH {_COLLAPSED} {_collapse('matches', 'project_id')}",
    "q_collapse_again": f"""WITH {_COLLAPSED},
merged AS (SELECT *, CASE WHEN project_id IN ('label/1', 'label/2') THEN 'label/1' WHEN project_id <> 'label/3' THEN project_id END AS merged_id
  FROM matches)
{_collapse("(SELECT * FROM merged WHERE merged_id IS NOT NULL)", "merged_id")}""",
    "q_search_filtered": f"""WITH {_SEARCH}
SELECT qid, rank, project_id, m.title AS project_title, array_to_string(m.funding_area, '|') AS funding_area,
  round(score, 5) AS matching_score FROM results
WHERE len(list_intersect(m.funding_location, ['en', 'fr', 'de'])) > 0
  AND len(list_intersect(m.funding_area, ['en', 'src1', 'src2', 'de'])) > 0
  AND NOT (m.short_description = 'N/A' AND m.full_description = 'N/A')""",
    "q_search_by_key": f"""WITH {_SEARCH}
SELECT qid, rank, project_id, upper(m.funding_location[1][1]) || m.funding_location[1][2:] AS funding_location FROM results
WHERE len(list_intersect(m.funding_location, ['en', 'fr'])) > 0""",
    "q_render": f"""WITH {_SEARCH}
SELECT qid, rank, {_HEADING} AS heading, m.short_description AS short_description, m.full_description AS full_description,
  CASE WHEN {_BOTH} THEN strftime(m.date_1, {_SHOWN}) END AS on_website_since,
  CASE WHEN {_BOTH} THEN strftime(m.date_2, {_SHOWN}) END AS last_updated,
  'Zuschuss' AS type_of_funding, array_to_string(m.funding_location, ', ') AS target_area,
  array_to_string(m.funding_area, ', ') AS funding_area, 'N/A' AS eligible_applicants, {_PERCENT} AS score FROM results""",
    "q_render_calls": f"""WITH {_SEARCH}
SELECT qid, rank, {_HEADING} AS heading, m.full_description AS description, strftime(m.date_1, {_SHOWN}) AS planned_opening_date,
  strftime(m.date_2, {_SHOWN}) AS deadline, {_PERCENT} AS score FROM results""",
    "q_query_validation": """SELECT conv_id || '-' || turn AS qid, text FROM conversations WHERE role = 'user' AND length(text) > 60
UNION ALL SELECT 'd' || doc_id, text FROM documents WHERE length(text) > 60""",
    "q_normalise_string": f"""SELECT conv_id, turn, CASE WHEN role = 'user' THEN nullif({strip("text")}, '') END AS text FROM conversations""",
}

# The store gives what the same search gives without one.
ORACLES["q_search_store"] = ORACLES["q_search_text"]
ORACLES["q_result_counts"] = f"""WITH found AS ({ORACLES["q_search_text"]}),
asked AS (SELECT concat_ws('-', conv_id, turn) AS qid FROM conversations WHERE role = 'user' AND text <> '')
SELECT a.qid, count(f.qid) AS n_results FROM asked a LEFT JOIN found f ON f.qid = a.qid GROUP BY a.qid"""
