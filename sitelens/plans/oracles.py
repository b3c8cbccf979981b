"""DuckDB statements of every registered query (the correctness oracle).

They run on the driver's pre-registered views; the derived ``requests`` and
``site_files`` views are inlined as CTEs from the same expression text the
Spark side uses.
"""

from __future__ import annotations

from sitelens.functions import constants as C
from sitelens.plans.syntax_oracle import HOOK_LIST, SYNTAX_CTE
from sitelens.sources import driver as D

TTL_US = C.DEFAULT_TTL_SECONDS * 1_000_000
BOT_RE = C.bot_alternation()
PATH_RE = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"
STATIC_RE = r"\.(" + "|".join(C.STATIC_ASSET_EXTENSIONS) + ")$"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def requests_cte() -> str:
    return f"requests AS ({D.requests_sql()})"


def site_files_cte() -> str:
    return f"site_files AS ({D.site_files_sql('duckdb')})"


def norm_url(u: str) -> str:
    noq = f"regexp_replace(regexp_replace({u}, '[?#].*$', ''), ';[^/]*$', '')"
    scheme = f"regexp_extract({noq}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)"
    return f"concat(lower({scheme}), substr({noq}, length({scheme}) + 1))"


def is_bot(ua: str) -> str:
    return f"coalesce(regexp_matches(lower({ua}), {q(BOT_RE)}), false)"


def starts_any(x: str, prefixes) -> str:
    return "(" + " OR ".join(f"starts_with({x}, {q(p)})" for p in prefixes) + ")"


URL_OK = "(starts_with(url, 'http://') OR starts_with(url, 'https://'))"

LOG_CTE = f"""log AS (
  SELECT sha256({norm_url('url')}) AS cache_key, epoch_us(ts) AS t, event_id AS id,
         coalesce(forced, false) AS forced, (status IS NOT NULL AND status < 400) AS ok,
         ts, url, user_agent, {norm_url('url')} AS norm_url
  FROM requests WHERE {URL_OK})"""

INV_CTE = f"""inv AS (SELECT sha256({norm_url('url')}) AS cache_key, epoch_us(ts) AS t FROM requests WHERE event_type = 'purchase')"""


def walk_cte(rows: str) -> str:
    """Anchored TTL walk, one key at a time in (t, id) order; a row with a
    null ``ok`` empties the cache."""
    return f"""seq AS (
  SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY t, id) AS rn FROM ({rows})),
walk(cache_key, rn, id, anchor, outcome) AS (
  SELECT cache_key, rn, id, CASE WHEN ok THEN t END, CASE WHEN ok THEN 'MISS' WHEN NOT ok THEN 'ERROR' END
  FROM seq WHERE rn = 1
  UNION ALL
  SELECT s.cache_key, s.rn, s.id,
    CASE WHEN s.ok IS NULL THEN NULL
         WHEN NOT s.forced AND w.anchor IS NOT NULL AND s.t - w.anchor <= {TTL_US} THEN w.anchor
         WHEN s.ok THEN s.t ELSE w.anchor END,
    CASE WHEN s.ok IS NULL THEN NULL
         WHEN NOT s.forced AND w.anchor IS NOT NULL AND s.t - w.anchor <= {TTL_US} THEN 'HIT'
         WHEN s.ok THEN 'MISS' ELSE 'ERROR' END
  FROM walk w JOIN seq s ON s.cache_key = w.cache_key AND s.rn = w.rn + 1)"""


TTL_CTE = INV_CTE + ", " + walk_cte("""SELECT cache_key, t, id, forced, ok FROM log
  UNION ALL SELECT cache_key, t, 9223372036854775807, false, CAST(NULL AS BOOLEAN) FROM inv""")

BOTS_VALUES = "bots(version, token) AS (VALUES " + ", ".join(
    f"({q(C.BOT_LIST_VERSION)}, {q(t)})" for t in C.BOT_TOKENS) + ")"

PATH = f"regexp_extract(url, {q(PATH_RE)}, 1)"

TRAFFIC = {
    "bot_requests": f"""WITH {requests_cte()}
SELECT event_id, user_agent, {is_bot('user_agent')} AS is_bot FROM requests""",

    "bot_tokens_joined": f"""WITH {requests_cte()}, {BOTS_VALUES}
SELECT b.version, b.token, CAST(count(*) AS BIGINT) AS hits, CAST(count(DISTINCT r.user_id) AS BIGINT) AS users
FROM requests r JOIN bots b ON contains(lower(r.user_agent), b.token)
GROUP BY b.version, b.token""",

    "prerender_routing": f"""WITH {requests_cte()},
x AS (SELECT event_id, url, method = 'GET' AS is_get, {is_bot('user_agent')} AS bot, {PATH} AS path FROM requests)
SELECT event_id, {URL_OK} AS url_ok,
  NOT {starts_any('path', C.ROBOTS_DISALLOW)} AS crawl_allowed,
  is_get AND bot AND NOT starts_with(path, '/api/') AND NOT (starts_with(path, '/_next/') OR starts_with(path, '/static/'))
    AND NOT regexp_matches(path, {q(STATIC_RE)}, 'i') AND NOT regexp_matches(path, '^/(_next/static|_next/image|favicon.ico)') AS vercel,
  is_get AND bot AND NOT starts_with(path, '/api/') AND NOT regexp_matches(path, {q(STATIC_RE)}, 'i') AS cloudflare,
  is_get AND bot AND NOT starts_with(path, '/api/') AND NOT regexp_matches(path, {q(STATIC_RE)}, 'i') AS express,
  bot AS nginx
FROM x""",

    "blocked_resources": f"""WITH {requests_cte()}
SELECT event_id, resource_type,
  resource_type IN {in_list(C.BLOCKED_RESOURCE_TYPES)} OR ({' OR '.join(f"contains(lower(url), {q(s)})" for s in C.BLOCKED_URL_SUBSTRINGS)}) AS blocked
FROM requests""",

    "failed_fetches": f"""WITH {requests_cte()}
SELECT event_id, status, status IS NULL OR status >= 400 AS failed FROM requests""",

    "crawl_allowed": f"""SELECT page_id, CAST(len(l) AS INTEGER) AS n_links,
  CAST(len(list_filter(l, lambda x: NOT {starts_any('x', C.ROBOTS_DISALLOW)})) AS INTEGER) AS n_allowed
FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l FROM ({D.pages_sql()}))""",

    "url_keys": f"""SELECT page_id, url, {norm_url('url')} AS norm_url, sha256({norm_url('url')}) AS cache_key FROM ({D.pages_sql()})""",

    "snapshot_latest": f"""WITH {requests_cte()}, {LOG_CTE},
w AS (SELECT cache_key, CAST(count(*) AS BIGINT) AS writes, arg_max(norm_url, t) AS norm_url,
             arg_max(id, t) AS stored_event_id, max(t) AS stored_us FROM log WHERE ok GROUP BY cache_key),
inv AS (SELECT sha256({norm_url('url')}) AS cache_key, max(epoch_us(ts)) AS inv_us FROM requests WHERE event_type = 'purchase' GROUP BY 1)
SELECT w.* FROM w LEFT JOIN inv USING (cache_key) WHERE inv.inv_us IS NULL OR inv.inv_us < w.stored_us""",

    "snapshot_asof": f"""WITH {requests_cte()}, {LOG_CTE}, {INV_CTE},
m0 AS (SELECT *, last_value(CASE WHEN ok THEN id END IGNORE NULLS) OVER w AS sid,
               last_value(CASE WHEN ok THEN t END IGNORE NULLS) OVER w AS st
      FROM log WINDOW w AS (PARTITION BY cache_key ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT m0.cache_key, m0.id, m0.t, CASE WHEN i.t IS NULL OR i.t < st THEN sid END AS sid, CASE WHEN i.t IS NULL OR i.t < st THEN st END AS st
      FROM m0 ASOF LEFT JOIN inv i ON i.cache_key = m0.cache_key AND m0.t > i.t)
SELECT id AS event_id, cache_key, sid AS snapshot_event_id, t - st AS age_us,
       coalesce(t - st <= {TTL_US}, false) AS fresh FROM m""",

    "snapshot_stats": f"""WITH {requests_cte()}, {LOG_CTE},
w AS (SELECT cache_key, max(t) AS stored_us FROM log WHERE ok GROUP BY cache_key),
inv AS (SELECT sha256({norm_url('url')}) AS cache_key, max(epoch_us(ts)) AS inv_us FROM requests WHERE event_type = 'purchase' GROUP BY 1),
k AS (SELECT w.stored_us, inv.inv_us IS NULL OR inv.inv_us < w.stored_us AS kept FROM w LEFT JOIN inv USING (cache_key)),
n AS (SELECT max(t) AS now_us FROM log)
SELECT CAST(count_if(kept) AS BIGINT) AS total_entries,
       CAST(count_if(kept AND now_us - stored_us < {TTL_US}) AS BIGINT) AS fresh_entries,
       CAST(count_if(kept) - count_if(kept AND now_us - stored_us < {TTL_US}) AS BIGINT) AS stale_entries,
       CAST(count_if(NOT kept) AS BIGINT) AS deleted_entries,
       {C.DEFAULT_TTL_SECONDS} AS ttl_seconds
FROM k, n""",

    "ttl_hits": f"""WITH RECURSIVE {requests_cte()}, {LOG_CTE}, {TTL_CTE}
SELECT id AS event_id, cache_key, outcome FROM walk WHERE outcome IS NOT NULL""",

    "snapshot_clear": f"""WITH {requests_cte()}, {LOG_CTE}, {INV_CTE},
w AS (SELECT cache_key, max(t) AS t FROM log WHERE ok GROUP BY 1)
SELECT count(*) AS deleted_entries FROM w
WHERE NOT EXISTS (SELECT 1 FROM inv WHERE inv.cache_key = w.cache_key AND inv.t >= w.t)""",

    "service_metrics": f"""WITH RECURSIVE {requests_cte()}, {LOG_CTE}, {TTL_CTE},
o AS (SELECT l.*, w.outcome FROM walk w JOIN log l ON l.id = w.id),
g AS (SELECT strftime(ts, '%Y-%m-%d') AS day, CAST(count(*) AS BIGINT) AS requests,
        CAST(count_if({is_bot('user_agent')}) AS BIGINT) AS bot_requests,
        CAST(count_if(outcome <> 'HIT') AS BIGINT) AS render_count,
        CAST(count_if(outcome = 'HIT') AS BIGINT) AS cache_hit_count,
        CAST(count_if(outcome = 'ERROR') AS BIGINT) AS error_count,
        CAST(trunc((max(t) - min(t)) / 1000000) AS BIGINT) AS uptime_seconds
      FROM o GROUP BY 1)
SELECT *, CASE WHEN render_count + cache_hit_count > 0
  THEN round_even(CAST(cache_hit_count AS DOUBLE) * 100.0 / (render_count + cache_hit_count), 1) ELSE 0.0 END AS cache_hit_rate_pct
FROM g""",
}




# ------------------------------------------------------------------ html
from sitelens.functions import patterns as P  # noqa: E402
from sitelens.functions.text import SPLITLINES  # noqa: E402


def has_keyword(t: str) -> str:
    return "(" + " OR ".join(f"contains({t}, {q(k)})" for k in C.METADATA_KEYWORDS) + ")"


def strip_ws(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def doc_title_lines(t: str) -> str:
    return f"list_filter(string_split_regex({t}, {q(SPLITLINES)}), lambda l: contains(l, 'document.title'))"


def dynamic_assign(line: str) -> str:
    v = strip_ws(f"regexp_extract({line}, {q(P.DOCUMENT_TITLE_ASSIGN)}, 1)")
    return f"(regexp_matches({line}, {q(P.DOCUMENT_TITLE_ASSIGN)}) AND NOT regexp_matches({v}, {q(P.STATIC_QUOTED)}))"


def flags_sql(t: str) -> dict[str, str]:
    titles = f"regexp_extract_all({t}, {q(P.TITLE)}, 1)"
    dl = doc_title_lines(t)
    return {
        "sets_title": f"(len({titles}) > 0 OR len({dl}) > 0)",
        "sets_description": f"regexp_matches({t}, {q(P.DESCRIPTION)})",
        "sets_og_tags": f"regexp_matches({t}, {q(P.OG_META)})",
        "sets_canonical": f"regexp_matches({t}, {q(P.CANONICAL)})",
        "title_is_dynamic": f"(len(list_filter({titles}, lambda x: regexp_matches(x, {q(P.DYNAMIC_VALUE)}))) > 0"
                            f" OR len(list_filter({dl}, lambda l: {dynamic_assign('l')})) > 0)",
        "has_document_title": f"(len({dl}) > 0)",
    }


def img_without_dims(t: str) -> str:
    return (f"len(list_filter(regexp_extract_all({t}, {q(P.IMG_TAG)}, 0), "
            f"lambda x: NOT regexp_matches(x, {q(P.WIDTH_OR_HEIGHT)})))")


def count_matches(t: str, pattern: str) -> str:
    return f"len(regexp_extract_all({t}, {q(pattern)}, 0))"


def clean_sql(h: str) -> str:
    for pattern in P.STRIP_SCRIPTS:
        h = f"regexp_replace({h}, {q(pattern)}, '', 'g')"
    return (f"(CASE WHEN instr({h}, '<head>') > 0 THEN concat(substr({h}, 1, instr({h}, '<head>') - 1), "
            f"'<head>', chr(10), {q(C.PRERENDER_MARKER)}, substr({h}, instr({h}, '<head>') + 6)) "
            f"ELSE concat({q(C.PRERENDER_MARKER)}, chr(10), {h}) END)")


_F = flags_sql("html")
_F_SRC = flags_sql("content")
HTML = {
    "html_metadata": "SELECT page_id, " + has_keyword("html") + " AS has_keywords, " + ", ".join(
        f"{has_keyword('html')} AND {_F[c]} AS {c}" for c in
        ["sets_title", "sets_description", "sets_og_tags", "sets_canonical", "title_is_dynamic"]) + f" FROM ({D.pages_sql()})",
    "html_counts": f"""SELECT page_id, CAST(length(html) AS INTEGER) AS html_chars,
  CAST({img_without_dims('html')} AS INTEGER) AS images_without_dimensions,
  CAST({count_matches('html', P.THIRD_PARTY_SCRIPT)} AS INTEGER) AS third_party_scripts,
  CAST({count_matches('html', P.IMPORT_STMT)} AS INTEGER) AS import_statements FROM ({D.pages_sql()})""",
    "html_clean": f"""SELECT page_id, sha256(c) AS html_sha256, CAST(length(c) AS INTEGER) AS clean_chars
FROM (SELECT page_id, {clean_sql('html')} AS c FROM ({D.pages_sql()}))""",
}


# ------------------------------------------------------------------ audit
def basename_sql(p: str) -> str:
    return f"string_split({p}, '/')[-1]"


EXTS = "|".join(e.lstrip(".") for e in C.JS_EXTENSIONS)
STATUS_CTE = f"""status AS (
  SELECT p.project_id,
    CASE WHEN m.ok IS NULL THEN 'no_package_json' WHEN NOT m.ok THEN 'invalid_json'
         WHEN NOT (json_exists(m.content, '$.dependencies.react') OR json_exists(m.content, '$.devDependencies.react')) THEN 'not_react'
         ELSE 'ok' END AS status
  FROM (SELECT DISTINCT project_id FROM site_files) p
  LEFT JOIN (SELECT project_id, json_valid(content) AS ok, content FROM site_files WHERE path = 'package.json') m USING (project_id))"""

SOURCES_CTE = f"""roots AS (SELECT project_id, bool_or(starts_with(path, 'src/')) AS has_src FROM site_files GROUP BY project_id),
sources AS (
  SELECT f.project_id, f.path, f.content,
    {basename_sql('f.path')} IN {in_list(C.ENTRY_NAMES)} AS is_entry,
    {basename_sql('f.path')} IN {in_list(C.ROUTER_NAMES)} AS is_router
  FROM site_files f JOIN roots r USING (project_id) JOIN status s USING (project_id)
  WHERE s.status = 'ok' AND (NOT r.has_src OR starts_with(f.path, 'src/'))
    AND NOT list_has_any(string_split(f.path, '/'), [{', '.join(q(d) for d in C.EXCLUDE_DIRS)}])
    AND NOT ({' OR '.join(f"contains({basename_sql('f.path')}, {q(x)})" for x in C.SKIP_NAME_FRAGMENTS)})
    AND regexp_matches(lower({basename_sql('f.path')}), '^.+\\.({EXTS})$'))"""


def has_dep_sql(n: str) -> str:
    return f"(list_contains(dk, {q(n)}) OR list_contains(ddk, {q(n)}))"


def dep_version_sql(n: str) -> str:
    return (f"coalesce(json_extract_string(content, '$.devDependencies.\"{n}\"'), "
            f"json_extract_string(content, '$.dependencies.\"{n}\"'))")


def major_sql(v: str) -> str:
    return f"nullif(regexp_extract(regexp_replace({v}, '^[ \\t]+', ''), '^[\\^~]?([0-9]+)\\.', 1), '')"


def any_dep_sql(names) -> str:
    return "(" + " OR ".join(has_dep_sql(n) for n in names) + ")"


BUNDLE_CTE = f"""man AS (
  SELECT project_id, content, json_valid(content) AS ok,
    CASE WHEN json_valid(content) THEN coalesce(json_keys(content, '$.dependencies'), []) END AS dk,
    CASE WHEN json_valid(content) THEN coalesce(json_keys(content, '$.devDependencies'), []) END AS ddk,
    CASE WHEN json_valid(content) THEN coalesce(json_extract_string(content, '$.scripts.*'), []) END AS sv
  FROM site_files WHERE path = 'package.json'),
entry AS (SELECT project_id, arg_min(path, string_split(path, '/')) AS entry_point FROM sources WHERE is_entry GROUP BY 1),
cfg AS (SELECT project_id, arg_min(o, path) AS cfg_outdir FROM (
          SELECT project_id, path, nullif(regexp_extract(content, {q("outDir\\s*:\\s*[\"']([^\"']+)[\"']")}, 1), '') AS o
          FROM site_files WHERE path IN {in_list(C.CONFIG_NAMES)}) WHERE o IS NOT NULL GROUP BY 1),
top AS (SELECT project_id, bool_or(t = 'build') AS has_build, bool_or(t = 'dist') AS has_dist FROM (
          SELECT project_id, string_split(path, '/')[1] AS t FROM site_files) WHERE t IN ('build', 'dist') GROUP BY 1),
bundle AS (
  SELECT man.project_id,
    CASE WHEN NOT ok THEN 'unknown' WHEN {has_dep_sql('next')} THEN 'nextjs'
         WHEN {has_dep_sql('@craco/craco')} OR len(list_filter(sv, lambda v: contains(v, 'react-scripts'))) > 0 THEN 'cra'
         WHEN {has_dep_sql('vite')} THEN 'vite' WHEN {has_dep_sql('webpack')} OR {has_dep_sql('webpack-cli')} THEN 'webpack'
         ELSE 'unknown' END AS framework,
    CASE WHEN ok THEN {major_sql(dep_version_sql('react'))} END AS react_version,
    CASE WHEN NOT ok THEN NULL WHEN {has_dep_sql('react-router-dom')} THEN {major_sql(dep_version_sql('react-router-dom'))}
         WHEN {has_dep_sql('react-router')} THEN {major_sql(dep_version_sql('react-router'))} END AS react_router_version,
    coalesce(ok AND {any_dep_sql(C.SSR_PACKAGES)}, false) AS has_ssr_setup,
    coalesce(ok AND {any_dep_sql(C.SSG_PACKAGES)}, false) AS has_ssg_setup,
    coalesce(ok AND {has_dep_sql('react-helmet')}, false) AS has_helmet,
    coalesce(ok AND {has_dep_sql('react-helmet-async')}, false) AS has_helmet_async,
    coalesce(ok AND {any_dep_sql(C.REACT_QUERY_PACKAGES)}, false) AS has_react_query,
    coalesce(ok AND {has_dep_sql('swr')}, false) AS has_swr,
    coalesce(ok AND {any_dep_sql(C.PRERENDER_PACKAGES)}, false) AS has_existing_prerender,
    CASE WHEN ok THEN entry.entry_point END AS entry_point,
    CASE WHEN ok THEN coalesce(cfg.cfg_outdir, CASE WHEN top.has_build THEN 'build' END, CASE WHEN top.has_dist THEN 'dist' END) END AS build_output_dir,
    CASE WHEN ok THEN CAST(len(list_distinct(list_concat(dk, ddk))) AS INTEGER) ELSE 0 END AS total_dependencies,
    CASE WHEN NOT ok THEN 'unknown' WHEN {any_dep_sql(C.SSG_PACKAGES)} THEN 'ssg' WHEN {any_dep_sql(C.SSR_PACKAGES)} THEN 'ssr' ELSE 'csr' END AS rendering_type
  FROM man LEFT JOIN entry USING (project_id) LEFT JOIN cfg USING (project_id) LEFT JOIN top USING (project_id))"""

AUDIT = {
    "project_status": f"WITH {site_files_cte()}, {STATUS_CTE} SELECT * FROM status",
    "source_files": f"WITH {site_files_cte()}, {STATUS_CTE}, {SOURCES_CTE}, {SYNTAX_CTE} SELECT project_id, path, is_entry, is_router FROM sources",
    "bundle_info": f"WITH {site_files_cte()}, {STATUS_CTE}, {SOURCES_CTE}, {SYNTAX_CTE}, {BUNDLE_CTE} SELECT * FROM bundle",
}


# ------------------------------------------------------------ audit II
def nl(x: str) -> str:
    return f"(length({x}) - length(replace({x}, chr(10), '')))"


def match_lines(t: str, pattern: str) -> str:
    """1-based start lines of every match (same split/extract construction)."""
    ms = f"regexp_extract_all({t}, {q(pattern)}, 0)"
    pcs = f"string_split_regex({t}, {q(pattern)})"
    return (f"list_transform(range(1, len({ms}) + 1), lambda k: CAST(1 + coalesce(list_sum(list_transform({pcs}[1:k], "
            f"lambda p: {nl('p')})), 0) + coalesce(list_sum(list_transform({ms}[1:k - 1], lambda p: {nl('p')})), 0) AS INTEGER))")


def ordered_distinct(lst: str) -> str:
    return (f"list_filter(list_transform(range(1, len({lst}) + 1), lambda i: CASE WHEN list_position({lst}, {lst}[i]) = i "
            f"THEN {lst}[i] END), lambda x: x IS NOT NULL)")


META_CTE = f"""mi AS (
  SELECT project_id, path, list(substr(e, length(split_part(e, '|', 2)) + 4) ORDER BY k) AS srcs,
    list(CAST(1 + {nl("substr(content, 1, CAST(split_part(e, '|', 2) AS BIGINT))")} AS INTEGER) ORDER BY k) AS ilines
  FROM ev JOIN sources USING (project_id, path) WHERE starts_with(e, 'I|') GROUP BY 1, 2),
mf AS (
  SELECT s.project_id, s.path AS file_path, content, coalesce(srcs, []) AS srcs, coalesce(ilines, []) AS ilines,
    string_split_regex(content, {q(SPLITLINES)}) AS ls
  FROM sources s LEFT JOIN mi ON mi.project_id = s.project_id AND mi.path = s.path WHERE {has_keyword('content')}),
mf2 AS (
  SELECT *, coalesce(list_position(srcs, 'react-helmet-async'), 0) AS fa, coalesce(list_position(srcs, 'react-helmet'), 0) AS fh,
    list_filter(list_transform(range(1, len(ls) + 1), lambda i: CASE WHEN contains(ls[i], 'document.title') THEN CAST(i AS INTEGER) END),
                lambda x: x IS NOT NULL) AS dl
  FROM mf),
meta AS (
  SELECT project_id, file_path,
    CASE WHEN fa > 0 THEN 'react_helmet_async' WHEN fh > 0 THEN 'react_helmet' WHEN len(dl) > 0 THEN 'document_title_direct' ELSE 'none' END AS strategy,
    {_F_SRC['sets_title']} AS sets_title, {_F_SRC['sets_description']} AS sets_description,
    {_F_SRC['sets_og_tags']} AS sets_og_tags, {_F_SRC['sets_canonical']} AS sets_canonical,
    {_F_SRC['title_is_dynamic']} AS title_is_dynamic,
    array_to_string(list_sort(list_distinct(list_concat(
      list_filter(list_transform(range(1, len(srcs) + 1), lambda k: CASE WHEN srcs[k] = 'react-helmet-async' THEN ilines[k] END), lambda x: x IS NOT NULL),
      CASE WHEN fh > 0 AND (fa = 0 OR fh < fa) THEN [ilines[fh]] ELSE [] END,
      {match_lines('content', P.HELMET_BLOCK)}, dl, {match_lines('content', P.TITLE)}))), ',') AS line_numbers
  FROM mf2)"""

from sitelens.operators import components as K  # noqa: E402

COMP_CTE = f"""cc AS (
  SELECT project_id, path AS file_path, content,
    coalesce((SELECT list(substr(e, 3) ORDER BY k) FROM ev WHERE ev.project_id = sources.project_id AND ev.path = sources.path AND starts_with(e, 'H|')), []) AS calls
  FROM sources),
cc2 AS (
  SELECT *, {ordered_distinct('calls')} AS hooks,
    contains(content, 'useQuery') OR contains(content, 'useMutation') AS rq, contains(content, 'useSWR') AS swr,
    regexp_matches(content, 'useEffect\\s*\\([\\s\\S]*?fetch\\s*\\(') AS eff
  FROM cc),
cc3 AS (
  SELECT *, list_concat(list_transform(hooks, lambda h: concat('Uses ', h, '()')),
      list_filter([{', '.join(f"CASE WHEN regexp_matches(content, {q(P.word(g))}) THEN {q('Accesses browser global: ' + g)} END" for g in sorted(C.CLIENT_GLOBALS))}], lambda x: x IS NOT NULL),
      CASE WHEN regexp_matches(content, {q(K.EVENT_HANDLER)}) THEN [{q(K.HANDLER_REASON)}] ELSE [] END) AS reasons
  FROM cc2),
comps AS (
  SELECT project_id, file_path,
    CASE WHEN len(reasons) > 0 THEN 'client' ELSE 'server' END AS component_type,
    CASE WHEN len(reasons) > 0 THEN array_to_string(reasons, ' | ') ELSE {q(K.SERVER_REASON)} END AS reasons,
    array_to_string(list_concat(hooks, CASE WHEN rq AND contains(content, 'useQuery') AND NOT list_contains(hooks, 'useQuery') THEN ['useQuery']
                                        WHEN NOT rq AND swr AND NOT list_contains(hooks, 'useSWR') THEN ['useSWR'] ELSE [] END), ', ') AS client_hooks_found,
    rq OR swr OR eff AS has_data_fetching,
    CASE WHEN rq THEN 'react_query' WHEN swr THEN 'swr' WHEN eff THEN 'useEffect_fetch' ELSE 'none' END AS data_fetch_pattern,
    array_to_string(list_filter([
      CASE WHEN rq THEN {q(K.NOTE_REACT_QUERY)} WHEN swr THEN {q(K.NOTE_SWR)} WHEN eff THEN {q(K.NOTE_EFFECT)} END,
      CASE WHEN len(reasons) > 0 AND list_contains(hooks, 'useEffect') AND (rq OR swr OR eff) THEN {q(K.NOTE_SPLIT)}
           WHEN len(reasons) = 0 AND (rq OR swr OR eff) THEN {q(K.NOTE_PURE)} END], lambda x: x IS NOT NULL), chr(10)) AS migration_notes
  FROM cc3)"""


def priority_sql(path: str) -> str:
    base = basename_sql(path)
    return "CASE " + " ".join(f"WHEN {base} = {q(k)} THEN {v}" for k, v in C.FILE_PRIORITIES.items()) + \
        f" ELSE {C.DEFAULT_FILE_PRIORITY} END"


def chunk_sql(files_cte: str, t: int = C.DEFAULT_CHUNK_TARGET_CHARS) -> str:
    return f"""{files_cte},
o AS (SELECT project_id, path, CAST(length(content) AS BIGINT) AS chars, CAST({priority_sql('path')} AS INTEGER) AS priority,
        row_number() OVER (PARTITION BY project_id ORDER BY {priority_sql('path')} DESC, path DESC) AS rn FROM cf),
walk(project_id, rn, path, part, cur) AS (
  SELECT project_id, rn, path, 1, chars FROM o WHERE rn = 1
  UNION ALL
  SELECT o.project_id, o.rn, o.path,
    CASE WHEN w.cur + o.chars > {t} THEN w.part + 1 ELSE w.part END,
    CASE WHEN w.cur + o.chars > {t} THEN o.chars ELSE w.cur + o.chars END
  FROM walk w JOIN o ON o.project_id = w.project_id AND o.rn = w.rn + 1),
j AS (SELECT o.*, CAST(w.part AS BIGINT) AS part_number FROM o JOIN walk w ON w.project_id = o.project_id AND w.rn = o.rn),
chunks AS (SELECT project_id, part_number, path, chars, priority, CAST(rn AS BIGINT) AS file_order,
  CAST(max(part_number) OVER (PARTITION BY project_id) AS BIGINT) AS total_parts,
  CAST(sum(chars) OVER (PARTITION BY project_id, part_number) AS BIGINT) AS part_chars
FROM j)"""


_F_SRC_PLACEHOLDER = None
AUDIT.update({
    "metadata_findings": f"""WITH {site_files_cte()}, {STATUS_CTE}, {SOURCES_CTE}, {SYNTAX_CTE}, {META_CTE}
SELECT * FROM meta WHERE strategy <> 'none' OR sets_title OR sets_description OR sets_og_tags OR sets_canonical""",
    "components": f"WITH {site_files_cte()}, {STATUS_CTE}, {SOURCES_CTE}, {SYNTAX_CTE}, {COMP_CTE} SELECT * FROM comps",
    "chunks": "WITH RECURSIVE " + chunk_sql(f"{site_files_cte()}, {STATUS_CTE}, {SOURCES_CTE}, {SYNTAX_CTE}, cf AS (SELECT project_id, path, content FROM sources)") + " SELECT * FROM chunks",
    "document_chunks": "WITH RECURSIVE " + chunk_sql(
        "cf AS (SELECT source AS project_id, concat('docs/doc', CAST(doc_id AS VARCHAR), '.md') AS path, text AS content FROM documents)") + " SELECT * FROM chunks",
})


# ------------------------------------------------------------ routes
def sws(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def strip_value(x: str) -> str:
    return (f"regexp_replace(regexp_replace({sws(x)}, '^[{{}}]+|[{{}}]+$', '', 'g'), "
            f"'^[''\"`]+|[''\"`]+$', '', 'g')")


def ref_sql(raw: str) -> str:
    return (f"coalesce(nullif(regexp_extract({raw}, {q(P.JSX_COMPONENT_REF)}, 1), ''), "
            f"nullif(regexp_extract({raw}, {q(P.IDENT_COMPONENT_REF)}, 1), ''))")


def idents_sql(c: str) -> str:
    before = sws(f"regexp_replace(split_part({c}, '{{', 1), '[, ]+$', '')")
    named = (f"list_transform(list_filter(list_transform(string_split(regexp_extract({c}, '^[^{{]*\\{{([^}}]*)', 1), ','), "
             f"lambda x: {sws('x')}), lambda x: x <> ''), lambda n: CASE WHEN contains(n, ' as ') "
             f"THEN {sws("regexp_extract(n, '^.*? as (.*)$', 1)")} ELSE n END)")
    return (f"(CASE WHEN starts_with({c}, '* as ') THEN [string_split_regex({c}, '\\s+')[-1]] "
            f"WHEN contains({c}, '{{') AND contains({c}, '}}') THEN list_concat(CASE WHEN {before} <> '' THEN [{before}] ELSE [] END, {named}) "
            f"WHEN {c} <> '' THEN list_filter([{sws(f'split_part({c}, chr(44), 1)')}], lambda x: x <> '') ELSE [] END)")


EXT_SORTED = sorted(C.JS_EXTENSIONS)


def _attr_event(name: str) -> str:
    """The raw value of the first attribute of that name, or the name itself."""
    e = f"'|' || v.start || {q('|' + name)}"
    return (f"coalesce((SELECT arg_min(substr(content, CAST(split_part(e, '|', 4) AS BIGINT) + 1, CAST(split_part(e, '|', 5) AS BIGINT) - CAST(split_part(e, '|', 4) AS BIGINT)), k) "
            f"FROM ev WHERE ev.project_id = v.project_id AND ev.path = v.file AND starts_with(e, 'V' || {e} || '|')), "
            f"(SELECT {q(name)} FROM ev WHERE ev.project_id = v.project_id AND ev.path = v.file AND e = 'N' || {e} LIMIT 1))")


ROUTES_CTE = f"""rb AS (
  SELECT project_id, path AS file, is_router, content,
    regexp_extract_all(content, {q(P.LAZY_DECL)}, 1) AS lazy_names,
    contains(content, 'React.lazy(') OR contains(content, 'lazy(() => import(') AS any_lazy,
    ({' OR '.join(f"contains(content, {q(g)})" for g in C.ROUTER_OBJECT_GUARDS)}) AS guard,
    regexp_extract_all(content, {q(P.CONFIG_ROUTE)}, 1) AS cp, regexp_extract_all(content, {q(P.CONFIG_ROUTE)}, 2) AS ce,
    regexp_extract_all(content, {q(P.CONFIG_ROUTE)}, 3) AS cc, {match_lines('content', P.CONFIG_ROUTE)} AS cl,
    regexp_extract_all(content, {q(P.ROUTE_PATH_FALLBACK)}, 1) AS fp, {match_lines('content', P.ROUTE_PATH_FALLBACK)} AS fl
  FROM sources),
jx0 AS (SELECT rb.project_id, file, is_router, lazy_names, any_lazy, content, CAST(split_part(e, '|', 2) AS BIGINT) AS start, split_part(e, '|', 3) AS mark
        FROM rb JOIN ev ON ev.project_id = rb.project_id AND ev.path = rb.file WHERE starts_with(e, 'E|')),
jx2 AS (SELECT *, {strip_value(_attr_event('path'))} AS path, {strip_value(_attr_event('component'))} AS comp, {strip_value(_attr_event('element'))} AS elem FROM jx0 v),
jx AS (SELECT project_id, file, is_router, start AS pos, CASE WHEN mark = '/>' THEN 1 ELSE 0 END AS kind, 1 + {nl('substr(content, 1, start)')} AS line, path,
         {ref_sql("(CASE WHEN comp IS NOT NULL AND comp <> '' THEN comp WHEN elem IS NOT NULL AND elem <> '' THEN elem ELSE '' END)")} AS ref,
         lazy_names, any_lazy
       FROM jx2 WHERE path IS NOT NULL AND path <> '' AND starts_with(path, '/')),
jx_l AS (SELECT project_id, file, is_router, pos, kind, line, path, ref,
           CASE WHEN ref IS NOT NULL THEN list_contains(lazy_names, ref) ELSE any_lazy END AS lazy_decl FROM jx),
cf0 AS (SELECT project_id, file, is_router, k AS pos, 2 AS kind, cl[k] AS line, cp[k] AS path,
          coalesce(nullif(ce[k], ''), nullif(cc[k], '')) AS ref, false AS lazy_decl
        FROM (SELECT *, unnest(generate_series(1, len(cp))) AS k FROM rb WHERE guard AND len(cp) > 0)),
found AS (SELECT * FROM jx_l UNION ALL SELECT * FROM cf0 WHERE starts_with(path, '/')),
fb AS (SELECT project_id, file, is_router, k AS pos, 3 AS kind, fl[k] AS line, fp[k] AS path, CAST(NULL AS VARCHAR) AS ref, false AS lazy_decl
       FROM (SELECT *, unnest(generate_series(1, len(fp))) AS k FROM rb WHERE len(fp) > 0)
       WHERE starts_with(path, '/') AND (project_id, file) NOT IN (SELECT project_id, file FROM found)),
cand AS (SELECT * FROM found UNION ALL SELECT * FROM fb),
lz AS (SELECT project_id, path AS file, k AS idx, n[k] AS name, s[k] AS source FROM (
         SELECT *, unnest(generate_series(1, len(n))) AS k FROM (
           SELECT project_id, path, regexp_extract_all(content, {q(P.LAZY_ASSIGN)}, 1) AS n,
                  regexp_extract_all(content, {q(P.LAZY_ASSIGN)}, 2) AS s FROM sources) WHERE len(n) > 0)),
im0 AS (SELECT project_id, path AS file, k AS idx, {sws('cl0[k]')} AS clause, s[k] AS source FROM (
         SELECT *, unnest(generate_series(1, len(cl0))) AS k FROM (
           SELECT project_id, path, regexp_extract_all(content, {q(P.IMPORT_CLAUSE)}, 1) AS cl0,
                  regexp_extract_all(content, {q(P.IMPORT_CLAUSE)}, 2) AS s FROM sources) WHERE len(cl0) > 0)),
im AS (SELECT project_id, file, idx, source, j AS sub, ids[j] AS name FROM (
         SELECT *, unnest(generate_series(1, len(ids))) AS j FROM (
           SELECT *, {idents_sql('clause')} AS ids FROM im0 WHERE starts_with(source, '.')) WHERE len(ids) > 0)),
pairs AS (SELECT DISTINCT project_id, file, source FROM (SELECT project_id, file, source FROM lz UNION ALL SELECT project_id, file, source FROM im)),
nb AS (SELECT *, list_reduce(list_prepend('', string_split(concat(CASE WHEN contains(file, '/') THEN regexp_replace(file, '/[^/]*$', '') ELSE '' END, '/', source), '/')),
         lambda acc, p: CASE WHEN starts_with(acc, '#ESC#') THEN acc WHEN p = '' OR p = '.' THEN acc
                             WHEN p = '..' THEN CASE WHEN acc = '' THEN '#ESC#' ELSE regexp_replace(acc, '/?[^/]*$', '') END
                             WHEN acc = '' THEN p ELSE concat(acc, '/', p) END) AS acc FROM pairs),
nb2 AS (SELECT project_id, file, source, acc AS base,
          CASE WHEN contains(acc, '/') THEN regexp_replace(acc, '/[^/]*$', '/') ELSE '' END AS dir,
          string_split(acc, '/')[-1] AS nm
        FROM nb WHERE acc <> '' AND NOT starts_with(acc, '#ESC#')),
cands AS (SELECT project_id, file, source, c.rank AS rank, c.path AS path FROM (
  SELECT *, unnest([
    {{'rank': 0, 'path': CASE WHEN regexp_matches(lower(nm), '^.+\\.({EXTS})$') THEN base END}},
    {', '.join(f"{{'rank': {1 + i}, 'path': concat(dir, regexp_replace(nm, '^(.+)\\.[^.]+$', '\\1'), {q(e)})}}" for i, e in enumerate(EXT_SORTED))},
    {', '.join(f"{{'rank': {7 + i}, 'path': concat(base, {q('/index' + e)})}}" for i, e in enumerate(EXT_SORTED))}]) AS c FROM nb2)
  WHERE c.path IS NOT NULL),
resolved AS (SELECT c.project_id, c.file, c.source, arg_min(c.path, c.rank) AS resolved
             FROM cands c JOIN site_files f ON f.project_id = c.project_id AND f.path = c.path GROUP BY 1, 2, 3),
lmap AS (SELECT lz.project_id, lz.file, lz.name, arg_max(r.resolved, lz.idx) AS lazy_file
         FROM lz JOIN resolved r USING (project_id, file, source) GROUP BY 1, 2, 3),
imap AS (SELECT im.project_id, im.file, im.name, arg_max(r.resolved, im.idx * 1000000 + im.sub) AS import_file
         FROM im JOIN resolved r USING (project_id, file, source) GROUP BY 1, 2, 3),
rc AS (SELECT c.*, l.lazy_file, i.import_file,
         CASE WHEN c.kind < 3 THEN coalesce(l.lazy_file, i.import_file) END AS res,
         CASE WHEN c.kind < 2 THEN l.lazy_file IS NOT NULL OR c.lazy_decl WHEN c.kind = 2 THEN l.lazy_file IS NOT NULL ELSE false END AS is_lazy
       FROM cand c LEFT JOIN lmap l ON l.project_id = c.project_id AND l.file = c.file AND l.name = c.ref
       LEFT JOIN imap i ON i.project_id = c.project_id AND i.file = c.file AND i.name = c.ref),
rfirst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id, path
             ORDER BY NOT is_router, string_split(file, '/'), kind, pos) AS rk FROM rc) WHERE rk = 1),
rfull AS (
  SELECT r.project_id, r.path, coalesce(r.res, r.file) AS component_file, regexp_matches(r.path, '[:*]') AS is_dynamic, r.is_lazy,
    CASE WHEN r.res IS NULL OR t.content IS NULL THEN 'none'
         {' '.join(f"WHEN contains(t.content, {q(tok)}) THEN {q(pat)}" for tok, pat in C.FETCH_HOOKS)}
         WHEN regexp_matches(t.content, {q(P.USE_EFFECT_FETCH_ROUTE)}) THEN 'useEffect_fetch' ELSE 'none' END AS data_fetch_pattern,
    CAST(r.line AS INTEGER) AS line_number, NOT r.is_router AS o1, string_split(r.file, '/') AS o2, r.kind AS o3, r.pos AS o4
  FROM rfirst r LEFT JOIN site_files t ON t.project_id = r.project_id AND t.path = r.res
  UNION ALL
  SELECT s.project_id, '/*', NULL, true, false, 'none', NULL, NULL, NULL, NULL, NULL
  FROM status s WHERE s.status = 'ok' AND s.project_id NOT IN (SELECT project_id FROM rfirst)),
routes AS (SELECT project_id, path, component_file, is_dynamic, is_lazy, data_fetch_pattern, line_number,
  CAST(row_number() OVER (PARTITION BY project_id ORDER BY o1 NULLS FIRST, o2 NULLS FIRST, o3 NULLS FIRST, o4 NULLS FIRST, path) AS INTEGER) AS route_order
  FROM rfull)"""

AUDIT["routes"] = f"WITH {site_files_cte()}, {STATUS_CTE}, {SOURCES_CTE}, {SYNTAX_CTE}, {ROUTES_CTE} SELECT * FROM routes"



def py_round1_sql(num: str, den: str) -> str:
    qd = f"CAST(floor(({num}) * 10 / ({den})) AS BIGINT)"
    r = f"(({num}) * 10 - {qd} * ({den}))"
    odd = f"(2 * {qd} + 1)"
    sv = f"(52 - CAST(floor(log2({odd} / 20.0)) AS BIGINT))"
    pm = f"(CASE {sv} % 4 WHEN 0 THEN 16 WHEN 1 THEN 12 WHEN 2 THEN 4 ELSE 8 END)"
    tie = f"(CASE WHEN {odd} % 5 = 0 THEN {qd} % 2 = 1 ELSE (({odd} % 20) * {pm}) % 20 >= 10 END)"
    up = f"(2 * {r} > ({den}) OR (2 * {r} = ({den}) AND {tie}))"
    return f"(({qd} + CASE WHEN {up} THEN 1 ELSE 0 END) / 10.0)"


CWV_CTE = f"""cwf AS (SELECT project_id, CAST(sum({count_matches('content', P.IMPORT_STMT)}) AS BIGINT) AS total_imports,
          CAST(sum({img_without_dims('content')}) AS BIGINT) AS imgs, count(*) AS n_files FROM sources GROUP BY 1),
shells AS (SELECT project_id, CAST(sum({count_matches('content', P.THIRD_PARTY_SCRIPT)}) AS BIGINT) AS third
           FROM site_files WHERE path IN {in_list(C.HTML_SHELLS)} GROUP BY 1),
rr AS (SELECT project_id, count(*) AS n_routes, CAST(count_if(is_lazy) AS BIGINT) AS lazy FROM routes GROUP BY 1),
cx AS (SELECT rr.project_id, lazy, coalesce(total_imports, 0) AS imp, coalesce(imgs, 0) AS img, coalesce(n_files, 0) AS nf,
         coalesce(third, 0) AS third, greatest(n_routes, 1) AS tr
       FROM rr LEFT JOIN cwf USING (project_id) LEFT JOIN shells USING (project_id)),
cx2 AS (SELECT *, {py_round1_sql('imp', 'tr')} AS ipr, (imp > tr * 10 OR nf > 100) AS large FROM cx),
cwv AS (SELECT project_id,
    CASE WHEN large THEN 'high' WHEN imp > tr * 6 THEN 'medium' ELSE 'low' END AS lcp_risk,
    CASE WHEN img > 3 THEN 'high' WHEN img > 0 THEN 'medium' ELSE 'low' END AS cls_risk,
    CASE WHEN lazy * 2 > tr THEN 'high' WHEN lazy > 0 THEN 'medium' ELSE 'low' END AS fid_risk,
    ipr AS estimated_js_imports_per_route, img AS images_without_dimensions, lazy AS lazy_loaded_routes,
    third AS third_party_scripts, large AS large_bundle_risk,
    array_to_string(list_filter([
      CASE WHEN large THEN concat('LCP high: about ', printf('%.1f', ipr), ' imports for each route; much script runs before anything shows.')
           WHEN imp > tr * 6 THEN concat('LCP medium: about ', printf('%.1f', ipr), ' imports for each route; check how routes are split.') END,
      CASE WHEN img > 3 THEN printf('CLS high: %d images lack a width or height.', img)
           WHEN img > 0 THEN printf('CLS medium: %d images lack a width or height.', img) END,
      CASE WHEN lazy * 2 > tr THEN printf('INP high: %d of %d routes load on demand; fetch the main ones ahead.', lazy, tr)
           WHEN lazy > 0 THEN printf('INP medium: %d of %d routes load on demand.', lazy, tr) END,
      CASE WHEN third > 0 THEN printf('Scripts from other hosts in index.html: %d.', third) END],
      lambda x: x IS NOT NULL), chr(10)) AS notes,
    imp AS total_imports
  FROM cx2)"""

from sitelens.operators import issues as IS  # noqa: E402

FACTS_CTE = f"""fmeta AS (SELECT * FROM meta WHERE strategy <> 'none' OR sets_title OR sets_description OR sets_og_tags OR sets_canonical),
fr AS (SELECT project_id, count(*) AS total_routes, CAST(count_if(is_dynamic) AS BIGINT) AS dynamic_routes,
         CAST(count_if(is_lazy) AS BIGINT) AS lazy_routes, bool_or(path <> '/*') AS has_real_route FROM routes GROUP BY 1),
ff AS (SELECT project_id, count(*) AS n_findings, count_if(strategy IN {in_list(IS.HELMET_STRATEGIES)}) AS n_helmet,
         bool_or(sets_og_tags) AS any_og, bool_or(sets_canonical) AS any_canonical,
         array_to_string(list(file_path ORDER BY string_split(file_path, '/')) FILTER (WHERE strategy IN {in_list(IS.HELMET_STRATEGIES)})[1:{IS.AFFECTED_FILES_SHOWN}], ', ') AS helmet_files
       FROM fmeta GROUP BY 1),
dyn AS (SELECT project_id, array_to_string(list(path ORDER BY route_order)[1:3], ', ') AS dynamic_paths FROM routes WHERE is_dynamic GROUP BY 1),
rcm AS (SELECT r.project_id, count(*) AS routes_with_client_metadata FROM routes r
        WHERE (r.project_id, r.component_file) IN (SELECT project_id, file_path FROM fmeta WHERE strategy IN {in_list(IS.CLIENT_STRATEGIES)}) GROUP BY 1),
assets AS (SELECT project_id, bool_or(ends_with(path, 'sitemap.xml')) AS has_sitemap, bool_or(ends_with(path, 'robots.txt')) AS has_robots
           FROM site_files WHERE path IN ('public/sitemap.xml', 'sitemap.xml', 'public/robots.txt', 'robots.txt') GROUP BY 1),
facts AS (SELECT fr.*, b.rendering_type, coalesce(ff.n_findings, 0) AS n_findings, coalesce(ff.n_helmet, 0) AS n_helmet,
            coalesce(ff.any_og, false) AS any_og, coalesce(ff.any_canonical, false) AS any_canonical, ff.helmet_files, dyn.dynamic_paths,
            coalesce(rcm.routes_with_client_metadata, 0) AS routes_with_client_metadata,
            coalesce(a.has_sitemap, false) AS has_sitemap, coalesce(a.has_robots, false) AS has_robots,
            w.lcp_risk, w.images_without_dimensions
          FROM fr LEFT JOIN bundle b USING (project_id) LEFT JOIN ff USING (project_id) LEFT JOIN dyn USING (project_id) LEFT JOIN rcm USING (project_id)
          LEFT JOIN assets a USING (project_id) LEFT JOIN cwv w USING (project_id)),
iss0 AS (
  {' UNION ALL '.join(
      f"SELECT project_id, {n} AS rule, {q(sev)} AS severity, {q(cat)} AS category, "
      + (f"concat(CAST(dynamic_routes AS VARCHAR), {q(' ' + t)})" if n == 4 else
         f"concat({q(t + ': ')}, CAST(images_without_dimensions AS VARCHAR))" if n == 9 else q(t)) + " AS title, "
      + (f"concat({q(d)}, coalesce(dynamic_paths, ''))" if n == 4 else q(d)) + f" AS description, {q(rec)} AS recommendation, {q(url)} AS docs_url, "
      + ("helmet_files" if n == 3 else "CAST(NULL AS VARCHAR)") + " AS affected_files, "
      + ("dynamic_routes" if n == 4 else "CAST(0 AS BIGINT)") + " AS affected_routes FROM facts WHERE "
      + {1: "rendering_type = 'csr'", 2: "n_findings = 0", 3: "n_helmet > 0 AND rendering_type = 'csr'",
         4: "dynamic_routes > 0", 5: "NOT has_sitemap", 6: "NOT any_og", 7: "NOT any_canonical",
         8: "lcp_risk = 'high'", 9: "images_without_dimensions > 0", 10: "NOT has_robots"}[n]
      for n, sev, cat, t, d, rec, url in IS.RULES)}),
issues AS (SELECT project_id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY rule) AS INTEGER) AS issue_no,
             CAST(rule AS INTEGER) AS rule, severity, category, title, description, recommendation, docs_url, affected_files, affected_routes FROM iss0),
cnt AS (SELECT project_id, CAST(count_if(severity = 'critical') AS BIGINT) AS critical_count, CAST(count_if(severity = 'high') AS BIGINT) AS high_count,
          CAST(count_if(severity = 'medium') AS BIGINT) AS medium_count, CAST(count_if(severity = 'low') AS BIGINT) AS low_count
        FROM issues GROUP BY 1),
scored AS (SELECT f.project_id, f.total_routes, f.dynamic_routes, f.lazy_routes, CAST(f.routes_with_client_metadata AS BIGINT) AS routes_with_client_metadata,
             coalesce(c.critical_count, 0) AS critical_count, coalesce(c.high_count, 0) AS high_count,
             coalesce(c.medium_count, 0) AS medium_count, coalesce(c.low_count, 0) AS low_count,
             CAST(greatest({C.SCORE_START} - CASE WHEN f.rendering_type = 'csr' THEN {C.SCORE_CSR_PENALTY} ELSE 0 END
               - CASE WHEN NOT f.has_real_route AND f.total_routes = 1 THEN {C.SCORE_NO_ROUTES_PENALTY} ELSE 0 END
               - CASE WHEN f.n_findings > 0 AND f.rendering_type = 'csr' THEN {C.SCORE_CLIENT_METADATA_PENALTY} ELSE 0 END
               - least(coalesce(c.critical_count, 0) * {C.SCORE_CRITICAL_EACH}, {C.SCORE_CRITICAL_CAP})
               - least(coalesce(c.high_count, 0) * {C.SCORE_HIGH_EACH}, {C.SCORE_HIGH_CAP})
               - least(coalesce(c.medium_count, 0) * {C.SCORE_MEDIUM_EACH}, {C.SCORE_MEDIUM_CAP}), 0) AS INTEGER) AS seo_score
           FROM facts f LEFT JOIN cnt c USING (project_id)),
score AS (SELECT s.project_id, s.status, x.total_routes, x.dynamic_routes, x.lazy_routes, x.routes_with_client_metadata,
            x.critical_count, x.high_count, x.medium_count, x.low_count, x.seo_score,
            CASE WHEN x.seo_score IS NULL THEN NULL WHEN x.seo_score >= 80 THEN 'good' WHEN x.seo_score >= 50 THEN 'needs_work' ELSE 'critical' END AS score_band,
            CASE WHEN s.status <> 'ok' THEN 1 WHEN x.critical_count > 0 THEN 2 ELSE 0 END AS gate
          FROM status s LEFT JOIN scored x USING (project_id))"""

_AUD = f"WITH {site_files_cte()}, {STATUS_CTE}, {SOURCES_CTE}, {SYNTAX_CTE}, {BUNDLE_CTE}, {ROUTES_CTE}, {CWV_CTE}"
AUDIT["cwv_estimate"] = f"{_AUD} SELECT * FROM cwv"
AUDIT["issues"] = f"{_AUD}, {META_CTE}, {FACTS_CTE} SELECT * FROM issues"
AUDIT["issue_routes"] = f"{_AUD} SELECT project_id, 4 AS rule, route_order, path FROM routes WHERE is_dynamic"
AUDIT["audit_score"] = f"{_AUD}, {META_CTE}, {FACTS_CTE} SELECT * FROM score"


STREAMING = {
    "stream_dedup": f"WITH RECURSIVE {requests_cte()}, {LOG_CTE}, {walk_cte('SELECT cache_key, t, id, false AS forced, true AS ok FROM log')} "
                    "SELECT id AS event_id, cache_key FROM walk WHERE outcome = 'MISS'",
    "stream_service": f"""WITH RECURSIVE {requests_cte()}, {LOG_CTE}, {TTL_CTE}
SELECT strftime(date_trunc('hour', l.ts), '%Y-%m-%d %H:%M') AS hour, count(*) AS requests,
       CAST(count_if(outcome <> 'HIT') AS BIGINT) AS render_count, CAST(count_if(outcome = 'HIT') AS BIGINT) AS cache_hit_count,
       CAST(count_if(outcome = 'ERROR') AS BIGINT) AS error_count
FROM walk w JOIN log l ON l.id = w.id GROUP BY 1""",
    "stream_bot_tags": TRAFFIC["bot_requests"],
    "stream_ttl": TRAFFIC["ttl_hits"],
    "stream_snapshots": TRAFFIC["snapshot_latest"],
    "stream_live": f"""SELECT cache_key, norm_url, stored_event_id, stored_us FROM ({TRAFFIC['snapshot_latest']})
WHERE stored_us + CAST(6 AS BIGINT) * 3600 * 1000000 >= (SELECT max(epoch_us(ts)) FROM ({D.requests_sql()}) WHERE {URL_OK} AND (status < 400 OR event_type = 'purchase'))""",
    "stream_metrics": f"""WITH {requests_cte()}
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, CAST(count(*) AS BIGINT) AS requests,
       CAST(count_if({is_bot('user_agent')}) AS BIGINT) AS bot_requests
FROM requests GROUP BY 1""",
}


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for group in (TRAFFIC, HTML, AUDIT, STREAMING):
        out.update(group)
    return out


AUDIT["imports_resolved"] = (
    f"WITH {site_files_cte()}, {STATUS_CTE}, {SOURCES_CTE}, {SYNTAX_CTE}, {ROUTES_CTE} "
    "SELECT project_id, file, name, lazy_file AS resolved, 'lazy' AS kind FROM lmap "
    "UNION ALL SELECT project_id, file, name, import_file AS resolved, 'import' AS kind FROM imap")


# ------------------------------------------------------------ sitemap / bundles
from sitelens.plans import reports as RP  # noqa: E402


def xml_escape_sql(x: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = f"replace({x}, {q(a)}, {q(b)})"
    return x


def sitemap_cte(most: int = RP.SITEMAP_MAX_URLS) -> str:
    return f"""sm AS (
  SELECT project_id, CAST(1 + floor((row_number() OVER (PARTITION BY project_id ORDER BY route_order) - 1) / {most}) AS INTEGER) AS part, route_order,
    concat('  <url>' || chr(10) || '    <loc>',
      {xml_escape_sql("concat('https://', project_id, '.example.com', path)")},
      '</loc>' || chr(10) || '    <changefreq>weekly</changefreq>' || chr(10) || '    <priority>',
      CASE WHEN path = '/' THEN '1.0' ELSE '0.8' END, '</priority>' || chr(10) || '  </url>' || chr(10)) AS line
  FROM routes WHERE NOT is_dynamic),
smp AS (SELECT project_id, part, count(*) AS n, string_agg(line, '' ORDER BY route_order) AS body FROM sm GROUP BY 1, 2),
smd AS (SELECT project_id, count_if(is_dynamic) AS n_dynamic FROM routes GROUP BY 1),
sitemap AS (SELECT project_id, coalesce(part, 1) AS part, CAST(coalesce(n, 0) AS BIGINT) AS url_count,
  concat({q(RP.SITEMAP_HEAD)}, coalesce(body, ''),
    CASE WHEN coalesce(part, 1) = 1 AND n_dynamic > 0 THEN printf('  <!-- %d dynamic routes left out: list their real addresses to include them. -->' || chr(10), n_dynamic) ELSE '' END,
    {q(RP.SITEMAP_TAIL)}) AS xml
  FROM smd LEFT JOIN smp USING (project_id))"""


AUDIT["sitemap"] = f"{_AUD}, {sitemap_cte()} SELECT * FROM sitemap"
AUDIT["sitemap_index"] = f"""{_AUD}, {sitemap_cte(20)}
SELECT project_id, CAST(count(*) AS INTEGER) AS parts, CAST(sum(url_count) AS BIGINT) AS url_count,
  concat({q(RP.SITEMAP_HEAD.replace('urlset', 'sitemapindex'))}, string_agg(concat('  <sitemap>' || chr(10) || '    <loc>',
    {xml_escape_sql("concat('https://', project_id, '.example.com/sitemap-', part, '.xml')")}, '</loc>' || chr(10) || '  </sitemap>' || chr(10)), '' ORDER BY part),
    {q(RP.SITEMAP_TAIL.replace('urlset', 'sitemapindex'))}) AS xml
FROM sitemap GROUP BY 1 HAVING count(*) > 1"""
AUDIT["document_parts"] = "WITH RECURSIVE " + chunk_sql(
    f"cf AS (SELECT source AS project_id, {D.PART_PATH} AS path, text AS content FROM documents)", 20_000) + " SELECT * FROM chunks"

_BUNDLE_AUD = f"{_AUD.replace('WITH ', 'WITH RECURSIVE ', 1)}, {META_CTE}, {FACTS_CTE}, {COMP_CTE}"
CONTEXT_CTE = f"""okp AS (SELECT s.project_id, s.seo_score, s.critical_count, b.framework, b.react_router_version, b.has_helmet, b.has_helmet_async,
    (SELECT count(*) FROM comps k WHERE k.project_id = s.project_id AND component_type = 'server') AS n_server,
    (SELECT count(*) FROM comps k WHERE k.project_id = s.project_id AND component_type = 'client') AS n_client
  FROM score s LEFT JOIN bundle b USING (project_id) WHERE s.status = 'ok'),
cl AS (
  SELECT project_id, 0 AS section, 0 AS place, [] AS item, concat('## Project' || chr(10) || '- name: `', project_id, '`' || chr(10) || '- framework: ', framework, chr(10) || '- router: ',
    coalesce(react_router_version, '-'), chr(10) || '- score before: ', seo_score, ' of 100' || chr(10) || '- critical issues: ', critical_count, chr(10)) AS line FROM okp
  UNION ALL SELECT project_id, 1, 0, [], '## Routes' || chr(10) || '| Route | File | Dynamic | Hooks | Data |' || chr(10) || '|---|---|---|---|---|' || chr(10) FROM okp
  UNION ALL SELECT project_id, 2, 0, [], concat('## Server components (', n_server, ')' || chr(10)) FROM okp
  UNION ALL SELECT project_id, 3, 0, [], concat('## Client components (', n_client, ')' || chr(10)) FROM okp
  UNION ALL SELECT project_id, 4, 0, [], '## Notes' || chr(10) FROM okp
  UNION ALL SELECT r.project_id, 1, r.route_order, [], concat('| `', r.path, '` | `', coalesce({basename_sql('r.component_file')}, 'unknown'), '` | ',
      CASE WHEN r.is_dynamic THEN 'Y' ELSE '-' END, ' | ', coalesce(nullif(k.client_hooks_found, ''), '-'), ' | ', r.data_fetch_pattern, ' |' || chr(10))
    FROM routes r LEFT JOIN comps k ON k.project_id = r.project_id AND k.file_path = r.component_file
  UNION ALL SELECT project_id, 2, 1, string_split(file_path, '/'), concat('- `', {basename_sql('file_path')}, '`' || chr(10)) FROM comps WHERE component_type = 'server'
  UNION ALL SELECT project_id, 3, 1, string_split(file_path, '/'), concat('- `', {basename_sql('file_path')}, '`: ', replace(reasons, ' | ', ', '), chr(10)) FROM comps WHERE component_type = 'client'
  UNION ALL SELECT project_id, 4, 1, string_split(file_path, '/'), concat('**`', {basename_sql('file_path')}, '`**' || chr(10) || '- ', replace(migration_notes, chr(10), chr(10) || '- '), chr(10))
    FROM comps WHERE migration_notes <> ''
  UNION ALL SELECT project_id, 5, 0, [], concat('## Dependencies' || chr(10) || '- remove: react-router-dom', CASE WHEN has_helmet THEN ', react-helmet' ELSE '' END,
    CASE WHEN has_helmet_async THEN ', react-helmet-async' ELSE '' END, CASE WHEN framework = 'cra' THEN ', react-scripts' ELSE '' END,
    chr(10) || '- add: next@14, @types/node, @types/react, @types/react-dom' || chr(10)) FROM okp),
cn AS (SELECT *, strlen(line) AS b, row_number() OVER (PARTITION BY project_id ORDER BY section, place, item) AS i FROM cl),
pw(project_id, i, page, cur) AS (
  SELECT project_id, i, CAST(1 AS BIGINT), b FROM cn WHERE i = 1
  UNION ALL SELECT cn.project_id, cn.i, CASE WHEN cur + b > 2000 THEN page + 1 ELSE page END, CASE WHEN cur + b > 2000 THEN b ELSE cur + b END
  FROM pw JOIN cn ON cn.project_id = pw.project_id AND cn.i = pw.i + 1),
pages AS (SELECT project_id, page, count(*) AS n_lines, CAST(sum(b) AS BIGINT) AS bytes, string_agg(line, '' ORDER BY i) AS text FROM pw JOIN cn USING (project_id, i) GROUP BY 1, 2)"""
AUDIT["bundle_context"] = f"{_BUNDLE_AUD}, {CONTEXT_CTE} SELECT * FROM pages"

TEXTS_CTE = f"""{CONTEXT_CTE}, {chunk_sql("cf AS (SELECT project_id, path, content FROM sources)", 20_000)},
pt AS (SELECT DISTINCT project_id, part_number, total_parts FROM chunks),
texts AS (
  SELECT pt.*, 0 AS kind, page AS place, text FROM pt JOIN pages USING (project_id)
  UNION ALL SELECT pt.*, 1, 0, concat('## Files' || chr(10), CASE WHEN total_parts > 1 THEN
    printf('> Part %d of %d; the project context above holds for every part.' || chr(10), part_number, total_parts) ELSE '' END, chr(10)) FROM pt
  UNION ALL SELECT c.project_id, c.part_number, c.total_parts, 2, c.file_order,
    concat('### `', {basename_sql('c.path')}, '`' || chr(10) || '**Type:** ', upper(coalesce(k.component_type, 'unknown')), chr(10),
      CASE WHEN k.reasons IS NOT NULL AND k.reasons <> '' THEN concat('**Reason:** ', k.reasons, chr(10)) ELSE '' END,
      CASE WHEN k.migration_notes IS NOT NULL AND k.migration_notes <> '' THEN concat('**Migration notes:**' || chr(10) || '- ',
           replace(k.migration_notes, chr(10), chr(10) || '- '), chr(10)) ELSE '' END,
      chr(10) || '```jsx' || chr(10), s.content, chr(10) || '```' || chr(10) || chr(10))
  FROM chunks c LEFT JOIN comps k ON k.project_id = c.project_id AND k.file_path = c.path
  JOIN sources s ON s.project_id = c.project_id AND s.path = c.path)"""
AUDIT["bundle_texts"] = f"{_BUNDLE_AUD}, {TEXTS_CTE} SELECT * FROM texts"
AUDIT["bundle_tokens"] = f"""{_BUNDLE_AUD}, {TEXTS_CTE},
bt AS (SELECT project_id, part_number, any_value(total_parts) AS total_parts, CAST(count_if(kind = 2) AS BIGINT) AS n_files, CAST(sum(length(text)) AS BIGINT) AS chars
       FROM texts GROUP BY 1, 2)
SELECT project_id, part_number, total_parts, CASE WHEN total_parts = 1 THEN 'bundle.md' ELSE printf('bundle-part%d.md', part_number) END AS bundle_name,
  n_files, chars, chars // 4 AS estimated_tokens FROM bt
UNION ALL SELECT project_id, NULL, max(total_parts), 'bundle', CAST(sum(n_files) AS BIGINT), CAST(sum(chars) AS BIGINT), CAST(sum(chars // 4) AS BIGINT) FROM bt GROUP BY 1"""


REPORT_MD_SQL = f"""{_AUD}, {META_CTE}, {FACTS_CTE},
il AS (SELECT project_id, string_agg(concat('### ', issue_no, '. ', title, chr(10), chr(10), '- severity: ', severity, chr(10), '- category: ', category,
          chr(10), '- see: ', docs_url, chr(10), chr(10), description, chr(10), chr(10), recommendation, chr(10)), chr(10) ORDER BY issue_no) AS lines
       FROM issues GROUP BY 1)
SELECT s.project_id, concat('# Audit of `', s.project_id, '`', chr(10), chr(10), 'Score: ', s.seo_score, ' of 100 (',
  CASE s.score_band WHEN 'good' THEN 'good' WHEN 'needs_work' THEN 'needs work' ELSE 'critical' END, ')', chr(10), chr(10),
  '| Fact | Value |', chr(10), '|---|---|', chr(10),
  '| Framework | ', b.framework, ' |', chr(10), '| Rendering | ', b.rendering_type, ' |', chr(10),
  '| React | ', coalesce(b.react_version, '-'), ' |', chr(10), '| Router | ', coalesce(b.react_router_version, '-'), ' |', chr(10),
  '| Entry | ', coalesce(b.entry_point, '-'), ' |', chr(10), '| Build folder | ', coalesce(b.build_output_dir, '-'), ' |', chr(10),
  '| Dependencies | ', b.total_dependencies, ' |', chr(10),
  '| Routes | ', s.total_routes, ' |', chr(10), '| Dynamic routes | ', s.dynamic_routes, ' |', chr(10), '| Lazy routes | ', s.lazy_routes, ' |', chr(10),
  chr(10), '| Vital | Risk |', chr(10), '|---|---|', chr(10), '| LCP | ', w.lcp_risk, ' |', chr(10), '| CLS | ', w.cls_risk, ' |', chr(10),
  '| INP | ', w.fid_risk, ' |', chr(10), chr(10), w.notes, CASE WHEN w.notes = '' THEN '' ELSE chr(10) || chr(10) END,
  '| Severity | Issues |', chr(10), '|---|---|', chr(10), '| critical | ', s.critical_count, ' |', chr(10), '| high | ', s.high_count, ' |', chr(10),
  '| medium | ', s.medium_count, ' |', chr(10), '| low | ', s.low_count, ' |', chr(10), chr(10), coalesce(il.lines, '')) AS markdown
FROM score s LEFT JOIN bundle b USING (project_id) LEFT JOIN cwv w USING (project_id) LEFT JOIN il USING (project_id)
WHERE s.status = 'ok'"""
AUDIT["report_md"] = REPORT_MD_SQL

BUNDLE_FIELDS = """framework react_version react_router_version has_ssr_setup has_ssg_setup has_helmet has_helmet_async
has_react_query has_swr has_existing_prerender entry_point build_output_dir total_dependencies rendering_type""".split()
CWV_FIELDS = """lcp_risk cls_risk fid_risk estimated_js_imports_per_route images_without_dimensions lazy_loaded_routes
third_party_scripts large_bundle_risk notes total_imports""".split()
SCORE_FIELDS = """status total_routes dynamic_routes lazy_routes routes_with_client_metadata critical_count high_count
medium_count low_count seo_score score_band gate""".split()


def _fields(alias: str, names: list[str], special: dict[str, str] | None = None) -> str:
    return ", ".join(f"{n}: {(special or {}).get(n, f'{alias}.{n}')}" for n in names)


AUDIT["report_json"] = f"""{_AUD}, {META_CTE}, {FACTS_CTE},
ia AS (SELECT project_id, list({{'issue_no': issue_no, 'rule': rule, 'severity': severity, 'category': category, 'title': title,
         'description': description, 'recommendation': recommendation, 'docs_url': docs_url,
         'affected_files': affected_files, 'affected_routes': affected_routes}} ORDER BY issue_no) AS issues FROM issues GROUP BY 1),
ba AS (SELECT project_id, to_json({{{_fields('b', BUNDLE_FIELDS)}}}) AS j FROM bundle b),
wa AS (SELECT project_id, to_json({{{_fields('w', CWV_FIELDS, {'notes': "CASE WHEN w.notes = '' THEN [] ELSE string_split(w.notes, chr(10)) END"})}}}) AS j FROM cwv w)
SELECT s.project_id, concat('{{"project_id":', to_json(s.project_id), ',',
  {", ',', ".join(f"{q(f'"{c}":')}, coalesce(CAST(to_json(s.{c}) AS VARCHAR), 'null')" for c in SCORE_FIELDS)},
  ',"bundle":', coalesce(CAST(ba.j AS VARCHAR), 'null'), ',"cwv":', coalesce(CAST(wa.j AS VARCHAR), 'null'),
  ',"issues":', coalesce(CAST(to_json(ia.issues) AS VARCHAR), 'null'), ',"analysed_at":"2024-01-01T00:00:00Z"}}') AS json
FROM score s LEFT JOIN ba USING (project_id) LEFT JOIN wa USING (project_id) LEFT JOIN ia USING (project_id)"""

AUDIT["report_lines"] = f"""{_AUD}, {META_CTE}, {FACTS_CTE}
SELECT project_id, 'routes' AS section, path AS item,
  concat('| `', path, '` | ', coalesce(component_file, '-'), ' | ', CASE WHEN is_dynamic THEN 'yes' ELSE 'no' END, ' | ',
         CASE WHEN is_lazy THEN 'yes' ELSE 'no' END, ' | ', data_fetch_pattern, ' |') AS line FROM routes
UNION ALL
SELECT project_id, 'metadata', file_path,
  concat('| `', file_path, '` | ', strategy, ' | ', array_to_string(list_filter([
    CASE WHEN sets_title THEN 'title' END, CASE WHEN sets_description THEN 'description' END, CASE WHEN sets_og_tags THEN 'og' END,
    CASE WHEN sets_canonical THEN 'canonical' END], lambda x: x IS NOT NULL), ', '), ' |') FROM fmeta"""
