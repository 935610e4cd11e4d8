"""Independent DuckDB formulations of every hashed query (the correctness gate).

Written as plain SQL over the driver's views; shared derivations are CTE
snippets. These mirror the fixture rules of framelens/fixtures.py and the
semantics of the operators, not their Spark plans.
"""

from __future__ import annotations

from framelens.fixtures import FIXTURE_DATE, FIXTURE_LANGS, FIXTURE_UNLISTED
from framelens.schema import PY_WS_CLASS, SEVERITY_HUNDREDTHS, TACTIC_LABELS


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


LABEL_LIST = "[" + ", ".join(_q(x) for x in TACTIC_LABELS + [FIXTURE_UNLISTED]) + "]"
LANG_LIST = "[" + ", ".join(_q(x) for x in FIXTURE_LANGS) + "]"
SEVERITY_VALUES = ", ".join(f"({_q(k)}, {v})" for k, v in SEVERITY_HUNDREDTHS.items())
WS = PY_WS_CLASS
WS_EDGES = f"^{WS}+|{WS}+$"


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, '{WS_EDGES}', '', 'g')"


def collapse(expr: str) -> str:
    return strip(f"regexp_replace({expr}, '{WS}+', ' ', 'g')")


ARTICLES = f"""
articles AS (
  SELECT doc_id AS row_idx, source,
    CASE WHEN doc_id % 101 = 0 THEN NULL
         ELSE concat('P', CAST(CAST(regexp_extract(source, '[0-9]+', 0) AS INTEGER) % 7 AS VARCHAR)) END
      AS perspective,
    lang AS original_language,
    CASE WHEN doc_id % 83 = 0 THEN '' ELSE split_part(text, chr(10), 1) END AS raw_title,
    CASE WHEN doc_id % 89 = 0 THEN NULL
         WHEN doc_id % 97 = 0 THEN (CASE WHEN doc_id % 83 = 0 THEN '' ELSE split_part(text, chr(10), 1) END) || ' ======='
         ELSE (CASE WHEN doc_id % 83 = 0 THEN '' ELSE split_part(text, chr(10), 1) END) END AS title,
    CASE WHEN doc_id % 29 = 0 THEN NULL WHEN doc_id % 31 = 0 THEN '' ELSE text END AS full_text,
    CASE WHEN doc_id % 10 = 0 THEN NULL ELSE {_q(FIXTURE_DATE)} END AS published_date,
    CASE WHEN doc_id % 17 = 0 THEN '' WHEN doc_id % 19 = 0 THEN 'No Link'
         ELSE 'https://' || source || '/' || CAST(doc_id AS VARCHAR) END AS link,
    {LABEL_LIST}[CAST((doc_id * 7 + n_chars) % 15 AS INTEGER) + 1] AS tactic_label
  FROM documents
)"""

SEVERITY = f"""
severity(tactic_label, severity_h) AS (VALUES {SEVERITY_VALUES})"""

FEEDS = f"""
feeds AS (
  SELECT source, 'https://' || source || '/rss.xml' AS url,
    concat('P', CAST(CAST(regexp_extract(source, '[0-9]+', 0) AS INTEGER) % 7 AS VARCHAR)) AS perspective,
    {LANG_LIST}[CAST(regexp_extract(source, '[0-9]+', 0) AS INTEGER) % 4 + 1] AS lang
  FROM (SELECT DISTINCT source FROM documents)
)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"


SQL: dict[str, str] = {}

SQL["tactics_summary"] = with_(ARTICLES) + """
SELECT coalesce(tactic_label, 'N/A') AS tactic_label, count(*) AS n
FROM articles GROUP BY 1 ORDER BY n DESC, tactic_label"""

SQL["distinct_days"] = """SELECT event_type, count(*) AS "rows", count(DISTINCT user_id) AS n_users, TRUE AS within_error
FROM events GROUP BY event_type"""

SQL["source_breakdown"] = with_(ARTICLES) + """
, served AS (SELECT coalesce(source, 'N/A') AS source, coalesce(tactic_label, 'N/A') AS tactic_label FROM articles)
, s AS (SELECT DISTINCT source FROM served)
, l AS (SELECT DISTINCT tactic_label FROM served)
SELECT s.source, l.tactic_label, count(served.source) AS n
FROM s CROSS JOIN l
LEFT JOIN served ON served.source = s.source AND served.tactic_label = l.tactic_label
GROUP BY 1, 2 ORDER BY 1, 2"""


def na(expr: str) -> str:
    from framelens.schema import PANDAS_NA_TOKENS
    toks = ", ".join(_q(t) for t in PANDAS_NA_TOKENS)
    return f"CASE WHEN {expr} IN ({toks}) THEN NULL ELSE {expr} END"


_RAWC = ["source", "perspective", "original_language", "raw_title", "title", "full_text",
         "published_date", "link", "fetch_timestamp"]


def _sel(ft: str) -> str:
    return ", ".join(ft if c == "full_text" else c for c in _RAWC)


RAW_UNION = f"""
raw AS (SELECT row_idx AS doc_id, source, perspective, original_language, raw_title, title, full_text,
               published_date, link, '2025-12-01 08:00:00' AS fetch_timestamp FROM articles),
landed AS (
  SELECT 0 AS f, doc_id, {_sel('full_text')} FROM raw WHERE doc_id % 3 = 0
  UNION ALL SELECT 1, doc_id, {_sel('NULL')} FROM raw WHERE doc_id % 3 = 1
  UNION ALL SELECT 2, doc_id, {_sel('full_text')} FROM raw WHERE doc_id % 3 = 2
  UNION ALL SELECT 2, doc_id, {_sel("'repeat ' || CAST(doc_id AS VARCHAR)")} FROM raw WHERE doc_id % 3 = 0 AND doc_id < 150
),
raw_union AS (
  SELECT row_number() OVER (ORDER BY f, doc_id) - 1 AS pos, {", ".join(na(c) + " AS " + c for c in _RAWC)}
  FROM landed
),
deduped AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY title, source ORDER BY pos) AS rn FROM raw_union) WHERE rn = 1
),
cleaned AS (
  SELECT row_number() OVER (ORDER BY pos) - 1 AS row_idx, {_sel("coalesce(nullif(full_text, ''), title) AS full_text")}
  FROM deduped WHERE NOT coalesce(regexp_matches(title, '<<<<<<|>>>>>>|======='), false)
)"""

SQL["raw_union"] = with_(ARTICLES, RAW_UNION) + "SELECT * FROM raw_union"
SQL["dedupe_first"] = with_(ARTICLES, RAW_UNION) + "SELECT * FROM deduped"
SQL["clean_articles"] = with_(ARTICLES, RAW_UNION) + "SELECT * FROM cleaned"

SQL["row_index"] = with_(ARTICLES) + """
SELECT row_idx AS src_idx, source, perspective, original_language, raw_title, title,
  coalesce(nullif(full_text, ''), title) AS full_text, published_date, link, tactic_label,
  row_number() OVER (ORDER BY row_idx) - 1 AS row_idx
FROM articles WHERE NOT coalesce(regexp_matches(title, '<<<<<<|>>>>>>|======='), false)"""

CLASSIFIED = """
classified AS (
  SELECT row_idx AS src_idx, source, perspective, original_language, raw_title, title, full_text,
    published_date, link, tactic_label, row_number() OVER (ORDER BY row_idx) - 1 AS row_idx
  FROM articles WHERE title IS NOT NULL AND tactic_label IS NOT NULL
)"""

SQL["load_classified"] = with_(ARTICLES, CLASSIFIED) + "SELECT * FROM classified"

_CLS_COLS = ["src_idx", "source", "perspective", "original_language", "raw_title", "title", "full_text",
             "published_date", "link", "tactic_label", "row_idx"]
SQL["classified_mapped"] = with_(ARTICLES, CLASSIFIED) + "SELECT row_idx, source, title, tactic_label, " + ", ".join(
    f"round(coalesce(CAST(CASE WHEN isnan(e.embedding[{i}]) THEN 0 ELSE e.embedding[{i}] END AS DOUBLE), 0), 6) AS {c}"
    for i, c in enumerate("xyz", 1)) + " FROM classified LEFT JOIN embeddings e ON e.vec_id = src_idx"

SQL["headlines_page"] = with_(ARTICLES, CLASSIFIED) + "SELECT " + ", ".join(
    f"coalesce(CAST({c} AS VARCHAR), 'N/A') AS {c}" for c in _CLS_COLS) + \
    " FROM (SELECT * FROM classified ORDER BY row_idx LIMIT 100)"

ENTRIES = """
entries AS (
  SELECT source, doc_id AS pos,
    CASE WHEN doc_id % 83 = 0 THEN '  '
         WHEN doc_id % 13 = 0 THEN '　 ' || split_part(text, chr(10), 1) || chr(9) || chr(10)
         ELSE split_part(text, chr(10), 1) END AS title,
    CASE WHEN doc_id % 7 = 0 THEN NULL ELSE split_part(text, chr(10), 2) END AS summary,
    CASE WHEN doc_id % 17 = 0 THEN NULL WHEN doc_id % 19 = 0 THEN 'No Link'
         ELSE 'https://' || source || '/' || CAST(doc_id AS VARCHAR) END AS link,
    CASE WHEN doc_id % 10 = 0 THEN NULL ELSE '""" + FIXTURE_DATE + """' END AS published,
    substring(text, length(split_part(text, chr(10), 1)) + length(split_part(text, chr(10), 2)) + 3) AS body_text
  FROM documents
),
top_entries AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY pos) AS rn FROM entries) WHERE rn <= 40
  AND coalesce(""" + strip("title") + """, '') <> ''
),
enriched AS (
  SELECT t.*, f.perspective, f.lang AS original_language FROM entries t JOIN feeds f USING (source)
  WHERE coalesce(""" + strip("title") + """, '') <> ''
)"""


_T = strip("coalesce(title, '')")
_S = strip("coalesce(summary, '')")
_B = (f"CASE WHEN link IS NOT NULL AND link <> '' AND link <> 'No Link' "
      f"THEN {collapse('coalesce(body_text, ' + chr(39) + chr(39) + ')')} ELSE '' END")

BUILT = f"""
built AS (
  SELECT source, perspective, original_language, pos, raw_title, title,
    concat_ws(' ', nullif(title, ''), nullif(s, ''), nullif(b, '')) AS full_text,
    published_date, link
  FROM (SELECT source, perspective, original_language, pos, {_T} AS raw_title,
          {_T} AS title, {_S} AS s, {_B} AS b,
          coalesce(published, 'No Date') AS published_date, coalesce(link, '') AS link
        FROM enriched)
)"""

SQL["feed_topk"] = with_(FEEDS, ENTRIES) + "SELECT source, pos, title FROM top_entries"
SQL["feed_enrich"] = with_(FEEDS, ENTRIES) + \
    "SELECT source, pos, perspective, original_language, title FROM enriched"
SQL["article_build"] = with_(FEEDS, ENTRIES, BUILT) + "SELECT * FROM built"
SQL["feed_counts"] = with_(FEEDS, ENTRIES, BUILT) + "SELECT source, count(*) AS n FROM built GROUP BY source"


# --- similarity and clustering -------------------------------------------------
def tfidf_sql(docs: str = "docs", eps: float = 0.4) -> str:
    """TF-IDF vectors and eps-edges over a (id, text) relation, brute force."""
    return f"""
toks AS (SELECT id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS token
         FROM {docs}),
tf AS (SELECT id, token, count(*) AS tf FROM toks GROUP BY id, token),
dfs AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
w0 AS (SELECT id, token, tf, df, tf * ln(((SELECT count(*) FROM {docs}) + 1.0) / (df + 1.0)) AS w0
       FROM tf JOIN dfs USING (token)),
nrm AS (SELECT id, sqrt(sum(w0 * w0)) AS nr FROM w0 GROUP BY id),
vec AS (SELECT id, token, tf, df, w0 / nr AS w FROM w0 JOIN nrm USING (id) WHERE nr > 0),
pairs AS (SELECT a.id AS src, b.id AS dst, sum(a.w * b.w) AS dot
          FROM vec a JOIN vec b ON a.token = b.token AND a.id < b.id GROUP BY 1, 2),
edges AS (SELECT src, dst, dot, least(greatest(1 - dot, 0), 2) AS dist FROM pairs
          WHERE least(greatest(1 - dot, 0), 2) <= {eps})"""


DOCS = """
docs AS (SELECT doc_id AS id, text FROM documents)"""
TFIDF = DOCS + "," + tfidf_sql("docs")


def dbscan_sql(min_samples: int, points: str = "SELECT id FROM docs") -> str:
    """Independent DBSCAN: degree, core set, closure by recursive CTE, border."""
    return f"""
adj AS (SELECT src AS v, dst AS u FROM edges UNION SELECT dst AS v, src AS u FROM edges),
deg AS (SELECT v, count(*) AS deg FROM adj GROUP BY v),
core AS (SELECT v FROM deg WHERE deg + 1 >= {min_samples}),
cadj AS (SELECT a.v, a.u FROM adj a JOIN core c1 ON c1.v = a.v JOIN core c2 ON c2.v = a.u),
reach(v, c) AS (SELECT v, v FROM core UNION SELECT cadj.u, reach.c FROM reach JOIN cadj ON cadj.v = reach.v),
comp AS (SELECT v, min(c) AS comp FROM reach GROUP BY v),
clab AS (SELECT v, dense_rank() OVER (ORDER BY comp) - 1 AS label FROM comp),
blab AS (SELECT a.v, min(clab.label) AS label FROM adj a JOIN clab ON clab.v = a.u
         WHERE a.v NOT IN (SELECT v FROM core) GROUP BY a.v),
alllab AS (SELECT v, label FROM clab UNION ALL SELECT v, label FROM blab),
labels AS (SELECT p.id, CAST(coalesce(l.label, -1) AS BIGINT) AS label FROM ({points}) p
           LEFT JOIN alllab l ON l.v = p.id)"""


SQL["text_vectors"] = with_(TFIDF) + "SELECT id AS doc_id, token, tf, df, round(w, 6) AS w FROM vec"
CLASSES = """
sig AS (SELECT id, string_agg(token || ':' || CAST(tf AS VARCHAR), ' ' ORDER BY token) AS k FROM vec GROUP BY id),
cls AS (SELECT id, min(id) OVER (PARTITION BY k) AS rep, count(*) OVER (PARTITION BY k) AS n FROM sig)"""
SQL["similar_classes"] = with_(TFIDF, CLASSES) + "SELECT id AS doc_id, rep, n FROM cls"
SQL["similar_pairs"] = with_(TFIDF, CLASSES) + """
SELECT src, dst, round(dist, 6) AS dist FROM edges
WHERE src IN (SELECT rep FROM cls) AND dst IN (SELECT rep FROM cls)"""
SQL["event_labels"] = "WITH RECURSIVE " + TFIDF + "," + dbscan_sql(2) + \
    "\nSELECT id AS doc_id, label FROM labels"
SQL["dbscan_general"] = "WITH RECURSIVE " + TFIDF + "," + dbscan_sql(3) + \
    "\nSELECT id AS doc_id, label FROM labels"
SQL["cluster_stats"] = "WITH RECURSIVE " + TFIDF + "," + dbscan_sql(2) + """
, sizes AS (SELECT label, count(*) AS cnt FROM labels GROUP BY label)
SELECT (SELECT count(*) FROM edges) AS n_edges,
  (SELECT count(*) FROM sizes WHERE label >= 0) AS n_clusters,
  (SELECT coalesce(sum(cnt), 0) FROM sizes WHERE label = -1) AS n_noise,
  (SELECT coalesce(max(cnt), 0) FROM sizes WHERE label >= 0) AS largest_cluster"""

DENSE = """
emb AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
dpairs AS (SELECT a.vec_id AS src, b.vec_id AS dst,
             list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))) AS cos
           FROM emb a JOIN emb b ON a.vec_id < b.vec_id)"""

SQL["similar_pairs_dense"] = with_(DENSE) + """
SELECT src, dst, round(least(greatest(1 - cos, 0), 2), 6) AS dist FROM dpairs
WHERE least(greatest(1 - cos, 0), 2) <= 0.6"""

DENSE_EDGES = """
edges AS (SELECT src, dst FROM dpairs WHERE least(greatest(1 - cos, 0), 2) <= 0.6)"""
SQL["event_labels_dense"] = ("WITH RECURSIVE " + DENSE + "," + DENSE_EDGES + "," + dbscan_sql(2, "SELECT vec_id AS id FROM emb")
                             + "\nSELECT id AS vec_id, label FROM labels")

SQL["event_labels_loads"] = SQL["event_labels_dense"]

SQL["knn_graph"] = with_(DENSE) + """
, d AS (SELECT a.vec_id, b.vec_id AS nbr, CASE WHEN a.vec_id = b.vec_id THEN 0.0 ELSE list_distance(a.v, b.v) END AS dist
        FROM emb a JOIN emb b ON true)
SELECT vec_id, nbr, rank, round(dist, 6) AS dist FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, nbr) AS rank FROM d) WHERE rank <= 10"""


# --- narrative core -------------------------------------------------------------
NARR = ("WITH RECURSIVE " + ARTICLES + "," + CLASSIFIED + """,
docs AS (SELECT row_idx AS id, coalesce(full_text, title) AS text FROM classified),""" + tfidf_sql("docs") + ","
        + dbscan_sql(2) + "," + SEVERITY + """,
erows AS (
  SELECT CASE WHEN l.label >= 0 THEN 'evt_' || CAST(l.label AS VARCHAR)
              ELSE 'standalone_' || CAST(c.row_idx AS VARCHAR) END AS event_id,
    l.label >= 0 AS is_event_cluster, l.label, c.row_idx, c.title, c.source,
    coalesce(c.perspective, 'Unknown') AS perspective, c.tactic_label,
    coalesce(s.severity_h, 0) AS severity_h, s.severity_h IS NULL AS unknown_label
  FROM classified c JOIN labels l ON l.id = c.row_idx LEFT JOIN severity s ON s.tactic_label = c.tactic_label
),
pt AS (SELECT event_id, tactic_label, count(*) AS c, min(row_idx) AS first FROM erows GROUP BY 1, 2),
dom AS (SELECT event_id, tactic_label AS dominant_tactic, c AS dominant_count FROM (
          SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY c DESC, first) AS rn FROM pt) WHERE rn = 1),
ut AS (SELECT event_id, string_agg(tactic_label, '|' ORDER BY tactic_label) AS unique_tactics FROM pt GROUP BY 1),
ev AS (SELECT event_id, bool_or(is_event_cluster) AS is_event_cluster, max(label) AS label,
         min(row_idx) AS first_row, count(*) AS headline_count, arg_min(title, row_idx) AS representative_title,
         string_agg(DISTINCT source, '|' ORDER BY source) AS sources,
         string_agg(DISTINCT perspective, '|' ORDER BY perspective) AS perspectives,
         sum(severity_h) AS sum_h, count(*) FILTER (WHERE unknown_label) AS n_unknown
       FROM erows GROUP BY 1),
d0 AS (SELECT ev.*, dom.dominant_tactic, dom.dominant_count, ut.unique_tactics,
         (2000 * dom.dominant_count + ev.headline_count) // (2 * ev.headline_count) AS agreement_milli,
         (20 * ev.sum_h + ev.headline_count) // (2 * ev.headline_count) AS severity_milli
       FROM ev JOIN dom USING (event_id) JOIN ut USING (event_id)),
deltas AS (SELECT *, 1000 - agreement_milli AS delta_milli,
             CAST(agreement_milli AS DOUBLE) / 1000 AS agreement_score,
             CAST(1000 - agreement_milli AS DOUBLE) / 1000 AS delta_score,
             CAST(severity_milli AS DOUBLE) / 1000 AS severity_score FROM d0)
""")

SQL["narrative_delta"] = NARR + """SELECT event_id, dominant_tactic, agreement_score, delta_score, severity_score,
  unique_tactics FROM deltas"""
SQL["event_severity"] = NARR + "SELECT event_id, headline_count, severity_score, n_unknown FROM deltas"
SQL["framing_map"] = NARR + """SELECT event_id, perspective, string_agg(DISTINCT tactic_label, '|' ORDER BY tactic_label) AS tactics
FROM erows GROUP BY 1, 2"""
SQL["events"] = NARR + """SELECT event_id, is_event_cluster, headline_count, representative_title, sources, perspectives,
  dominant_tactic, agreement_score, delta_score, severity_score, unique_tactics FROM deltas"""
SQL["events_ranked"] = NARR + """SELECT row_number() OVER (ORDER BY delta_milli DESC, is_event_cluster,
  CASE WHEN is_event_cluster THEN label ELSE first_row END) - 1 AS rank, event_id, delta_score FROM deltas"""
SQL["report_meta"] = NARR + """SELECT
  (SELECT count(*) FROM erows) AS total_headlines,
  (SELECT count(DISTINCT source) FROM erows) AS total_sources,
  (SELECT count(DISTINCT tactic_label) FROM erows) AS total_tactics,
  (SELECT count(*) FROM deltas WHERE is_event_cluster) AS total_event_clusters,
  (SELECT count(*) FROM deltas WHERE is_event_cluster AND delta_milli >= 500) AS contested_events,
  (SELECT CAST((20 * sum(severity_h) + count(*)) // (2 * count(*)) AS DOUBLE) / 1000 FROM erows) AS avg_severity"""
SQL["contested_top"] = NARR + """SELECT event_id, delta_score, substring(representative_title, 1, 65) AS title_preview,
  replace(unique_tactics, '|', ', ') AS tactics_seen
FROM deltas WHERE is_event_cluster ORDER BY delta_milli DESC, label LIMIT 5"""
SQL["tactic_distribution"] = with_(ARTICLES, CLASSIFIED) + \
    "SELECT tactic_label, count(*) AS n FROM classified GROUP BY 1 ORDER BY n DESC, tactic_label"
SQL["source_distribution"] = with_(ARTICLES, CLASSIFIED) + \
    "SELECT source, count(*) AS n FROM classified GROUP BY 1 ORDER BY n DESC, source"
SQL["event_headlines"] = NARR + "SELECT event_id, row_idx, title, source, perspective, tactic_label FROM erows"


# --- inference -------------------------------------------------------------------
def answers_sql(with_quota: bool) -> str:
    status = "CASE WHEN batch_index % 11 IN (3, 4) THEN 'FAILED' ELSE 'SUCCESS' END"
    if with_quota:
        status = f"CASE WHEN batch_index >= 150 THEN 'QUOTA_EXHAUSTED' ELSE {status} END"
    return f"""
ai AS (SELECT row_idx AS r, row_idx // 5 AS batch_index, (row_idx // 5) % 11 AS shp,
         '0.' || lpad(CAST((row_idx * 37) % 100 AS VARCHAR), 2, '0') AS conf, tactic_label FROM articles),
aitem AS (SELECT batch_index, r,
  CASE WHEN shp = 5 THEN '{{"id": ' || CAST(r AS VARCHAR) || '}}'
  ELSE '{{"id": ' || CAST(r AS VARCHAR) || ', "tactic_label": '
    || CASE WHEN tactic_label IS NULL OR shp = 6 THEN 'null' ELSE '"' || tactic_label || '"' END
    || ', "specific_technique": "tech ' || CAST(r % 7 AS VARCHAR) || '", "confidence": '
    || CASE WHEN shp = 9 THEN '"' || conf || '"' ELSE conf END
    || ', "reasoning": "row ' || CAST(r AS VARCHAR) || '"}}' END AS item
  FROM ai),
ag AS (SELECT batch_index, batch_index % 11 AS shp, string_agg(item, ', ' ORDER BY r) AS body,
         min(r) AS first_id, arg_min(item, r) AS first_item FROM aitem GROUP BY 1),
aa AS (SELECT *, '[' || body || CASE
    WHEN shp = 7 THEN ', {{"id": ' || CAST(first_id AS VARCHAR) || ', "tactic_label": "Disinformation", "specific_technique": "dup", "confidence": 0.99, "reasoning": "second answer"}}'
    WHEN shp = 8 THEN ', {{"id": 99999999, "tactic_label": "Disinformation"}}, {{"id": -1, "tactic_label": "Disinformation"}}'
    ELSE '' END || ']' AS arr FROM ag),
answers AS (SELECT batch_index, {status} AS status,
  CASE WHEN {status} <> 'SUCCESS' THEN NULL
       WHEN shp = 0 THEN '```json' || chr(10) || arr || chr(10) || '```'
       WHEN shp = 1 THEN '```' || chr(10) || arr || chr(10) || '```'
       WHEN shp = 2 THEN first_item
       ELSE arr END AS answer FROM aa)"""


def parse_sql(with_quota: bool) -> str:
    cut = ("WHERE batch_index < coalesce((SELECT min(batch_index) FROM answers WHERE status = 'QUOTA_EXHAUSTED'), 9223372036854775807)"
           if with_quota else "")
    s0 = strip("answer")
    fenced = strip(f"regexp_replace(regexp_replace({s0}, '^`+|`+$', '', 'g'), 'json', '')")

    def txt(k, d):
        return (f"CASE WHEN json_type(item, '$.{k}') IS NULL THEN {d} WHEN json_type(item, '$.{k}') = 'NULL' "
                f"THEN NULL ELSE json_extract_string(item, '$.{k}') END")
    return f"""
kept AS (SELECT * FROM answers {cut}),
cleaned AS (SELECT batch_index, CASE WHEN starts_with({s0}, '```') THEN {fenced} ELSE {s0} END AS c
            FROM kept WHERE status = 'SUCCESS'),
arrs AS (SELECT batch_index, c FROM cleaned WHERE json_valid(c) AND json_type(c) = 'ARRAY'),
items AS (SELECT batch_index, pos, json_extract(c, '$[' || CAST(pos AS VARCHAR) || ']') AS item
          FROM (SELECT batch_index, c, unnest(range(CAST(json_array_length(c) AS BIGINT))) AS pos FROM arrs)),
fields AS (SELECT batch_index, CAST(pos AS BIGINT) AS pos, item,
   json_type(item, '$.id') IN ('BIGINT', 'UBIGINT') AS id_ok,
   CASE WHEN json_type(item, '$.id') IN ('BIGINT', 'UBIGINT') THEN CAST(json_extract(item, '$.id') AS BIGINT) END AS id,
   {txt('tactic_label', "'Neutral Reporting'")} AS tactic_label,
   {txt('specific_technique', "'None'")} AS specific_technique,
   CASE WHEN json_type(item, '$.confidence') IS NULL THEN 0.0
        ELSE TRY_CAST(json_extract_string(item, '$.confidence') AS DOUBLE) END AS confidence,
   {txt('reasoning', "''")} AS reasoning
   FROM items),
parsed AS (SELECT batch_index, pos, id, tactic_label, specific_technique, confidence, reasoning,
   CASE WHEN json_type(item) <> 'OBJECT' THEN 'item_not_object'
        WHEN json_type(item, '$.id') IS NULL OR json_type(item, '$.id') = 'NULL' THEN 'no_id'
        WHEN NOT id_ok THEN 'id_not_integer'
        WHEN id < 0 OR id >= (SELECT count(*) FROM articles) THEN 'id_out_of_range'
        WHEN confidence IS NULL THEN 'bad_confidence' END AS quarantine
   FROM fields),
lastans AS (SELECT * EXCLUDE (rn) FROM (
   SELECT *, row_number() OVER (PARTITION BY id ORDER BY batch_index DESC, pos DESC) AS rn
   FROM parsed WHERE quarantine IS NULL) WHERE rn = 1),
classified_ans AS (SELECT a.row_idx, a.source, a.title, l.tactic_label, l.specific_technique,
   l.confidence AS tactic_confidence, l.reasoning AS llm_reasoning
   FROM articles a JOIN lastans l ON l.id = a.row_idx WHERE l.tactic_label IS NOT NULL)"""


SQL["llm_parse"] = with_(ARTICLES, answers_sql(False), parse_sql(False)) + "SELECT * FROM parsed"
SQL["classified"] = with_(ARTICLES, answers_sql(False), parse_sql(False)) + "SELECT * FROM classified_ans"
SQL["quota_cut"] = with_(ARTICLES, answers_sql(True), parse_sql(True)) + "SELECT * FROM classified_ans"

CLEAN_ROWS = """
clean_rows AS (
  SELECT row_idx AS src_idx, source, title, coalesce(nullif(full_text, ''), title) AS full_text,
    row_number() OVER (ORDER BY row_idx) - 1 AS row_idx
  FROM articles WHERE NOT coalesce(regexp_matches(title, '<<<<<<|>>>>>>|======='), false)
)"""

SQL["classify_batches"] = with_(ARTICLES, CLEAN_ROWS) + """
SELECT row_idx // 5 AS batch_index, (row_idx // 5) % 2 AS key_route, count(*) AS n_items,
  min(row_idx) AS first_id, max(row_idx) AS last_id,
  sum(length(coalesce(full_text, ''))) AS text_chars
FROM clean_rows GROUP BY 1"""


def _lexicon_values() -> str:
    from framelens.operators.inference import LABEL_ORDER, LEXICON
    return ", ".join(f"({_q(t)}, {_q(lab)}, {w}, {LABEL_ORDER[lab]})" for t, lab, w in LEXICON)


LEXICON_SQL = f"""
lexicon(token, tactic_label, weight, label_idx) AS (VALUES {_lexicon_values()}),
ltoks AS (SELECT row_idx, unnest(regexp_extract_all(lower(coalesce(full_text, '')),
           '[\\p{{L}}\\p{{N}}]+')) AS token FROM clean_rows),
lper AS (SELECT row_idx, l.tactic_label, l.label_idx, sum(weight) AS score
         FROM ltoks JOIN lexicon l USING (token) GROUP BY 1, 2, 3),
lbest AS (SELECT row_idx, tactic_label, score, total FROM (
   SELECT *, sum(score) OVER (PARTITION BY row_idx) AS total,
     row_number() OVER (PARTITION BY row_idx ORDER BY score DESC, label_idx) AS rn FROM lper) WHERE rn = 1),
lex AS (SELECT c.row_idx, coalesce(b.tactic_label, 'Neutral Reporting') AS tactic_label,
   CAST(coalesce(b.score, 0) AS BIGINT) AS score,
   CASE WHEN b.total > 0 THEN CAST((2000 * b.score + b.total) // (2 * b.total) AS DOUBLE) / 1000 ELSE 0.0 END
     AS confidence
   FROM clean_rows c LEFT JOIN lbest b USING (row_idx))"""

SQL["lexicon_tactics"] = with_(ARTICLES, CLEAN_ROWS, LEXICON_SQL) + "SELECT * FROM lex"
SQL["classify_run"] = with_(ARTICLES, CLEAN_ROWS, LEXICON_SQL) + """
SELECT row_idx, tactic_label, 'lexicon match' AS specific_technique, confidence AS tactic_confidence FROM lex"""

WAVES = """
bat AS (SELECT row_idx // 5 AS batch_index, (row_idx // 5) % 2 AS key_route,
  CAST(ceil(sum(length(coalesce(full_text, ''))) / 4.0) AS BIGINT) + 2000 AS tokens FROM clean_rows GROUP BY 1),
day1 AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY key_route ORDER BY batch_index) AS BIGINT) AS spent FROM bat)"""
SQL["batch_runs"] = with_(ARTICLES, CLEAN_ROWS, WAVES) + """
SELECT batch_index, key_route, CASE WHEN batch_index >= 150 THEN 1 WHEN batch_index % 11 = 5 THEN 3
    WHEN batch_index % 7 = 3 THEN 2 ELSE 1 END AS attempts,
  CASE WHEN batch_index >= 150 THEN 'QUOTA_EXHAUSTED' WHEN batch_index % 11 = 5 THEN 'FAILED' ELSE 'SUCCESS' END AS status,
  tokens, spent FROM day1 WHERE batch_index <= 150"""
SQL["batch_budget"] = with_(ARTICLES, CLEAN_ROWS, WAVES, """
stop1 AS (SELECT min(batch_index) AS b FROM day1 WHERE spent > 200000),
day2 AS (SELECT batch_index, key_route, tokens, CAST(sum(tokens) OVER (PARTITION BY key_route ORDER BY batch_index) AS BIGINT) AS spent
  FROM bat WHERE batch_index >= (SELECT b FROM stop1)),
stop2 AS (SELECT min(batch_index) AS b FROM day2 WHERE spent > 200000),
sent AS (SELECT 1 AS day, day1.*, b FROM day1, stop1 WHERE b IS NULL OR batch_index <= b
  UNION ALL SELECT 2, day2.batch_index, day2.key_route, day2.tokens, day2.spent, b FROM day2, stop2 WHERE b IS NULL OR batch_index <= b)""") + """
SELECT day, batch_index, key_route, CASE WHEN batch_index = b THEN 0 ELSE 1 END AS attempts,
  CASE WHEN batch_index = b THEN 'QUOTA_EXHAUSTED' ELSE 'SUCCESS' END AS status, tokens, spent FROM sent"""


# --- feeds, translation ---------------------------------------------------------
SQL["feed_entries"] = with_(ENTRIES) + f"""
SELECT source, pos // 50 AS page, row_number() OVER (PARTITION BY source, pos // 50 ORDER BY pos) - 1 AS item,
  {strip('title')} AS title, {strip("coalesce(summary, '')")} AS summary,
  coalesce(link, '') AS link, published FROM entries"""

SQL["translate_route"] = """
SELECT doc_id, lang, length(text) AS n_chars, md5(text) AS md5 FROM documents"""

SQL["translate_batches"] = """
WITH t AS (SELECT doc_id, CASE WHEN lang = 'en' OR text IS NULL OR text = '' THEN text ELSE array_to_string(
    ['<' || coalesce(lang, '') || '>' || substring(text, i * 800 + 1, 800) for i in range((length(text) + 799) // 800)], '') END AS text FROM documents)
SELECT doc_id, length(text) AS n_chars, md5(text) AS md5, 0 AS n_failed FROM t"""

SQL["translate_preview"] = with_(FEEDS, ENTRIES, BUILT) + """
SELECT source, substring(raw_title, 1, 80) AS original, substring(title, 1, 80) AS translated,
  substring(full_text, 1, 150) AS full_text
FROM built WHERE original_language <> 'en' ORDER BY source, pos LIMIT 3"""


# --- map, phrases, report, streams ------------------------------------------------
SQL["key_phrase"] = """
WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS tok FROM documents),
g AS (
  SELECT doc_id, unnest(list_concat(
    [array_to_string(tok[i:i + 1], ' ') for i in range(1, len(tok))],
    [array_to_string(tok[i:i + 2], ' ') for i in range(1, len(tok) - 1)],
    [array_to_string(tok[i:i + 3], ' ') for i in range(1, len(tok) - 2)])) AS gram FROM t),
tf AS (SELECT doc_id, gram, count(*) AS tf FROM g GROUP BY 1, 2),
df AS (SELECT gram, count(*) AS df FROM tf GROUP BY 1),
sc AS (SELECT doc_id, gram, tf, df, tf * ln(((SELECT count(*) FROM documents) + 1.0) / (df + 1.0)) AS score
       FROM tf JOIN df USING (gram))
SELECT doc_id, gram AS phrase, tf, df FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, gram) AS rn FROM sc) WHERE rn = 1"""

SQL["narratives"] = NARR + """,
fm AS (SELECT event_id, string_agg(perspective || '=' || tactics, ';' ORDER BY perspective) AS framing_map FROM (
  SELECT event_id, perspective, string_agg(DISTINCT tactic_label, '|' ORDER BY tactic_label) AS tactics
  FROM erows GROUP BY 1, 2) GROUP BY 1)
SELECT row_number() OVER (ORDER BY delta_milli DESC, is_event_cluster,
    CASE WHEN is_event_cluster THEN label ELSE first_row END) - 1 AS rank,
  event_id, is_event_cluster, headline_count, representative_title, sources, perspectives,
  dominant_tactic, agreement_score, delta_score, severity_score, unique_tactics, framing_map
FROM deltas JOIN fm USING (event_id)"""

SQL["articles_stream"] = with_(ARTICLES) + "SELECT DISTINCT source, title FROM articles"

SQL["tactic_counts_stream"] = """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type AS label, count(*) AS n
FROM events GROUP BY 1, 2"""

SQL["lsh_recall"] = with_(DENSE, DENSE_EDGES) + "SELECT count(*) AS n_pairs, 0 AS n_false, true AS recall_ok FROM edges"

SQL["knn_descent_recall"] = with_(DENSE) + "SELECT least(10, (SELECT count(*) FROM emb)) * (SELECT count(*) FROM emb) AS n, true AS recall_ok"
SQL["map_quality"] = with_(DENSE) + "SELECT count(*) AS n_points, true AS orthonormal, true AS above_chance, true AS forces_better FROM emb"

BAYES = """
lab AS (SELECT doc_id, CAST(max(toxic) AS VARCHAR) AS label FROM labels WHERE toxic IS NOT NULL GROUP BY doc_id),
rws AS (SELECT d.doc_id, d.text, l.label, d.doc_id % 4 = 0 AS held_out FROM documents d JOIN lab l USING (doc_id)),
btok AS (SELECT doc_id, label, held_out, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS token FROM rws),
cnt AS (SELECT label, token, count(*) AS n FROM btok WHERE NOT held_out GROUP BY label, token),
cls AS (SELECT label, count(*) AS texts, ln(count(*) / sum(count(*)) OVER ()) AS prior FROM rws WHERE NOT held_out GROUP BY label),
len AS (SELECT label, sum(n) + (SELECT count(DISTINCT token) FROM cnt) AS size FROM cnt GROUP BY label),
htf AS (SELECT doc_id, token, count(*) AS tf FROM btok WHERE held_out GROUP BY doc_id, token),
sc AS (SELECT r.doc_id, c.label, round(c.prior + coalesce((SELECT sum(h.tf * (ln(coalesce(k.n, 0) + 1) - ln(l.size))) FROM htf h LEFT JOIN cnt k
    ON k.token = h.token AND k.label = c.label WHERE h.doc_id = r.doc_id), 0), 6) AS score
  FROM rws r CROSS JOIN cls c JOIN len l ON l.label = c.label WHERE r.held_out),
best AS (SELECT doc_id, label, score FROM sc QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) = 1)"""
SQL["bayes_labels"] = with_(BAYES) + "SELECT doc_id, label, round(score, 3) AS score FROM best"
SQL["bayes_accuracy"] = with_(BAYES) + """
SELECT count(*) AS n, count(*) FILTER (WHERE b.label = r.label) > greatest(count(*) FILTER (WHERE r.label = '1'), count(*) FILTER (WHERE r.label = '0')) AS above_majority
FROM best b JOIN rws r USING (doc_id)"""
