"""SQL for DuckDB with the same rows as the core's queries. Written apart from the column functions; only fixed values are shared."""

from __future__ import annotations

from pagewright.constants import BOILERPLATE, NOISE, PRIVATE_HOSTS, TRACKING_KEYS

_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?(\[[0-9A-Fa-f:.]+\]|[^/?#:\[\]@ ]+)(?::[0-9]{1,5})?(?:[/?#].*)?$"
_WS = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def _q(literal: str) -> str:
    return "'" + literal.replace("'", "''") + "'"


def _host(url: str) -> str:
    return f"regexp_replace(lower(regexp_extract(trim({url}), {_q(_URL)}, 2)), '[\\[\\]]', '', 'g')"


def _scheme(url: str) -> str:
    return f"lower(regexp_extract(trim({url}), {_q(_URL)}, 1))"


def _http(url: str) -> str:
    return f"coalesce({_host(url)} <> '' AND {_scheme(url)} IN ('http', 'https'), false)"


def _private(url: str) -> str:
    names = "|".join(p for p in PRIVATE_HOSTS if p != "^fd")
    return f"(regexp_matches({_host(url)}, {_q(names)}) OR ({_host(url)} LIKE '%:%' AND starts_with({_host(url)}, 'fd')))"


def _strip(url: str) -> str:
    keys = "|".join(TRACKING_KEYS)
    kept = f"array_to_string(list_filter(string_split(regexp_extract({url}, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: NOT regexp_matches(p, '^(?:{keys})(?:=|$)') AND p <> ''), '&')"
    return (
        f"CASE WHEN {_host(url)} = '' OR NOT contains({url}, '?') THEN {url} ELSE regexp_extract({url}, '^([^?#]*)', 1) || "
        f"CASE WHEN {kept} = '' THEN '' ELSE '?' || {kept} END || regexp_extract({url}, '(#.*)$', 1) END"
    )


def _path(url: str) -> str:
    raw = f"regexp_extract(trim({url}), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
    return f"CASE WHEN {raw} = '' THEN '/' ELSE {raw} END"


def _canonical(url: str) -> str:
    clean = f"regexp_replace({_strip(url)}, '#.*$', '')"
    query = f"regexp_extract({clean}, '\\?(.*)$', 1)"
    return (
        f"CASE WHEN {_host(url)} = '' THEN {url} ELSE 'https://' || regexp_replace({_host(url)}, '^(?:www|m|amp)\\.', '') || regexp_replace({_path(clean)}, '/+$', '') || "
        f"CASE WHEN {query} = '' THEN '' ELSE '?' || {query} END END"
    )


def _value(url: str, key: str) -> str:
    return f"nullif(url_decode(replace(regexp_extract({url}, '[?&]{key}=([^&#]*)', 1), '+', '%20')), '')"


def _unwrap(url: str) -> str:
    return f"CASE WHEN {_host(url)} <> '' AND {_path(url)} = '/url' THEN coalesce({_value(url, 'q')}, {_value(url, 'url')}, {url}) ELSE {url} END"


def _domain(url: str) -> str:
    return f"coalesce(nullif(regexp_replace({_host(url)}, '^www\\.', ''), ''), 'unknown')"


def _collapse(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '{_WS}+', ' ', 'g'), '^ | $', '', 'g')"


def _trim(text: str) -> str:
    return f"regexp_replace({text}, '^{_WS}+|{_WS}+$', '', 'g')"


def _tag_text(markup: str) -> str:
    return _collapse(f"regexp_replace(coalesce({markup}, ''), '<[^>]*>', '', 'g')")


def _density(markup: str) -> str:
    anchors = f"regexp_extract_all(coalesce({markup}, ''), '(?is)<a(?:\\s[^>]*)?>(.*?)</a>', 1)"
    linked = f"coalesce(list_sum(list_transform({anchors}, lambda a: length({_tag_text('a')}))), 0)"
    total = f"length({_tag_text(markup)})"
    return f"CASE WHEN {total} = 0 THEN 0.0 ELSE round(least(1.0, {linked} / {total}::DOUBLE), 6) END"


def _sentences(text: str) -> str:
    return f"len(regexp_extract_all({text}, '[.!?]+(?:{_WS}|$)'))::BIGINT"


def _hits(text: str) -> str:
    return "(" + " + ".join(f"regexp_matches({text}, {_q(f'(?i){chr(92)}b(?:{p}){chr(92)}b')})::BIGINT" for p in BOILERPLATE) + ")"


def _noise(pattern: str, prefix: str = "") -> str:
    body = pattern.replace(r"\s", r"[ \t\n\r\f]").replace(r"\d", "[0-9]")
    return _q(f"(?{'s' if pattern.startswith('©') else 'is'}){prefix}({body})")


def _scored(key: str, source: str) -> str:
    """Scores over a relation with the columns key, said, density and four flags."""
    average = "(text_length / sentences::DOUBLE)"
    return f"""
    WITH rows AS ({source}),
    features AS (
      SELECT {key}, length(said)::BIGINT AS text_length, {_sentences("said")} AS sentences, density AS link_density, {_hits("said")} AS boilerplate_hits,
        has_title, has_byline, has_excerpt, has_date FROM rows),
    points AS (
      SELECT *, least(100, greatest(0,
        CASE WHEN text_length >= 5000 THEN 40 WHEN text_length >= 2000 THEN 30 WHEN text_length >= 1000 THEN 20 WHEN text_length >= 300 THEN 10 WHEN text_length >= 50 THEN 5 ELSE 0 END
        + CASE WHEN sentences <= 0 THEN 0 WHEN {average} BETWEEN 40 AND 200 THEN 25 WHEN {average} BETWEEN 20 AND 300 THEN 12 ELSE 0 END
        + CASE WHEN link_density > 0.5 THEN -20 WHEN link_density > 0.3 THEN -10 WHEN link_density > 0.15 THEN -5 ELSE 0 END
        + greatest(-15, -3 * boilerplate_hits)
        + CASE WHEN has_title THEN 7 ELSE 0 END + CASE WHEN has_byline THEN 4 ELSE 0 END + CASE WHEN has_excerpt THEN 4 ELSE 0 END + CASE WHEN has_date THEN 5 ELSE 0 END + 15))::INTEGER AS page_score
      FROM features)
    SELECT *, CASE WHEN page_score >= 85 THEN 'excellent' WHEN page_score >= 70 THEN 'good' WHEN page_score >= 50 THEN 'fair' WHEN page_score >= 30 THEN 'poor' ELSE 'failed' END AS page_label,
      page_score < 45 OR (text_length < 300 AND link_density > 0.35) OR text_length < 120 AS is_weak FROM points"""


_PAGE_ROWS = f"""SELECT result_id, coalesce(text_content, '') AS said, {_density("cleaned_html")} AS density, title IS NOT NULL AS has_title, byline IS NOT NULL AS has_byline,
  excerpt IS NOT NULL AS has_excerpt, published_date IS NOT NULL AS has_date FROM extraction_results"""
_DOC_ROWS = """SELECT doc_id, coalesce(text, '') AS said, 0.0::DOUBLE AS density, agenda_item IS NOT NULL AS has_title, speaker IS NOT NULL AS has_byline,
  false AS has_excerpt, sitting_date IS NOT NULL AS has_date FROM documents"""

_LATEST = f"""SELECT {_canonical("url")} AS canonical, arg_max(result_id, struct_pack(a := fetched_at, b := -result_id)) AS result_id, count(*) AS copies
  FROM extraction_results WHERE url IS NOT NULL GROUP BY 1"""
_SHAPED = """SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY rank_no, url) AS result_rank FROM (
  SELECT search_id, rank_no, url, any_value(title) AS title, any_value(snippet) AS snippet FROM search_results WHERE NOT coalesce(is_ad, false) GROUP BY search_id, rank_no, url)"""
_LINKED = f"""
  shaped AS (SELECT * FROM ({_SHAPED}) WHERE result_rank <= 5),
  results AS (SELECT search_id, result_rank, title, {_unwrap("url")} AS url, snippet FROM shaped),
  keyed AS (SELECT *, {_canonical("url")} AS page FROM results),
  latest AS (SELECT l.canonical, e.* FROM ({_LATEST}) l JOIN extraction_results e ON e.result_id = l.result_id)"""
_LINES = """SELECT min(log_id) AS log_id, lower(trim(log_level)) AS log_level, logged_at, min(received_at) AS received_at, request_id, tool_name, query_text, url, elapsed_ms, extraction_score,
  result_count, warning_count, error_code, message FROM log_entries
  GROUP BY lower(trim(log_level)), logged_at, request_id, tool_name, query_text, url, elapsed_ms, extraction_score, result_count, warning_count, error_code, message"""
_REQUESTS = f"""SELECT request_id, min(tool_name) AS tool_name, count(*) AS lines, min(logged_at) AS started_at, max(elapsed_ms) AS elapsed_ms, max(extraction_score) AS extraction_score,
  max(result_count) AS result_count, min(error_code) AS error_code FROM ({_LINES}) WHERE request_id IS NOT NULL GROUP BY request_id"""


def _noise_rows() -> str:
    one = "SELECT result_id, {lit} AS noise_pattern, regexp_extract(said, {hit}, 1) AS matched_text, said, length(regexp_extract(said, {lead}, 1)) AS ahead FROM texts WHERE regexp_matches(said, {hit})"
    union = " UNION ALL ".join(one.format(lit=_q(p), hit=_noise(p), lead=_noise(p, "^(.*?)")) for p in NOISE)
    return f"""WITH texts AS (SELECT result_id, coalesce(text_content, '') AS said FROM extraction_results), hits AS ({union})
      SELECT result_id, noise_pattern, matched_text, replace(substr(said, greatest(ahead - 40, 0)::BIGINT + 1, (ahead - greatest(ahead - 40, 0) + length(matched_text) + 40)::BIGINT), chr(10), ' ') AS near_text FROM hits"""


def _truncated(text: str, limit: int) -> str:
    chunk = f"substr({text}, 1, {limit})"
    return (
        f"CASE WHEN length({text}) <= {limit} THEN {text} WHEN regexp_matches(substr({text}, {limit + 1}, 1), '{_WS}') THEN regexp_replace({chunk}, '{_WS}+$', '') "
        f"ELSE regexp_replace(regexp_extract({chunk}, '(?s)^(.+)[ \\n\\r\\t]', 1), '{_WS}+$', '') END"
    )


_FLAT = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[ \t\x0B\f\r\x{00A0}]+', ' ', 'g'), '\n{3,}', E'\n\n', 'g'), ' *\n *', E'\n', 'g'), '^ +| +$', '', 'g')"
_SAMPLE_STOP = "cookie|subscribe|newsletter|privacy policy|terms of service|advertisement|sign up|follow us|all rights reserved|copyright"
_SAMPLE = _collapse("regexp_replace(regexp_replace(regexp_replace(coalesce(cleaned_html, ''), '(?is)<script\\b.*?</script>', '', 'g'), '(?is)<style\\b.*?</style>', '', 'g'), '<[^>]+>', ' ', 'g')")


_EVENTS = f"""lines AS (SELECT *, epoch_us(logged_at) // 1000 AS at_ms FROM ({_LINES}) WHERE request_id IS NOT NULL AND logged_at IS NOT NULL),
  events AS (SELECT request_id AS page_id, CAST(at_ms - elapsed_ms AS BIGINT) AS t_ms, log_id * 2 AS seq, 1 AS delta FROM lines WHERE elapsed_ms IS NOT NULL
    UNION ALL SELECT request_id, at_ms, log_id * 2 + 1, -1 FROM lines WHERE elapsed_ms IS NOT NULL UNION ALL SELECT request_id, at_ms, log_id * 2, 1 FROM lines WHERE elapsed_ms IS NULL),
  summed AS (SELECT *, sum(delta) OVER (PARTITION BY page_id ORDER BY t_ms, seq) AS total FROM events),
  flights AS (SELECT page_id, t_ms, seq, CAST(total - least(0, min(total) OVER (PARTITION BY page_id ORDER BY t_ms, seq)) AS INTEGER) AS in_flight FROM summed)"""
#: Polls of the settling query, with the running figures that its rule compares.
_POLLS = f"""{_EVENTS},
  counts AS (SELECT page_id, t_ms, arg_max(in_flight, seq) AS in_flight FROM flights GROUP BY 1, 2),
  seen AS (SELECT request_id AS page_id, at_ms AS t_ms, coalesce(max(length(message)), 0) AS length, bool_or(error_code IS NOT NULL) AS mutated FROM lines GROUP BY 1, 2),
  polled AS (SELECT s.*, coalesce(c.in_flight, 0) AS in_flight, row_number() OVER w - 1 AS poll, s.t_ms - first_value(s.t_ms) OVER w AS elapsed, coalesce(s.length <> lag(s.length) OVER w, false) AS changed
    FROM seen s LEFT JOIN counts c USING (page_id, t_ms) WINDOW w AS (PARTITION BY page_id ORDER BY t_ms)),
  figures AS (SELECT *, sum(changed::INTEGER) OVER w AS run, elapsed - coalesce(max(CASE WHEN mutated THEN elapsed END) OVER w, 0) AS quiet, elapsed - coalesce(max(CASE WHEN in_flight > 0 THEN elapsed END) OVER w, 0) AS idle
    FROM polled WINDOW w AS (PARTITION BY page_id ORDER BY t_ms)),
  streaks AS (SELECT *, row_number() OVER (PARTITION BY page_id, run ORDER BY t_ms) - CASE WHEN run = 0 THEN 1 ELSE 0 END AS streak FROM figures),
  judged AS (SELECT *, poll = 0 AND length >= 60 AS fast, poll > 0 AND streak >= 1 AND quiet >= 300 AND length >= 10 AND in_flight = 0 AND idle >= 500 AS ready FROM streaks WHERE poll = 0 OR elapsed <= 60000),
  ended AS (SELECT page_id, min(struct_pack(e := elapsed, l := length)) FILTER (fast) AS f, min(struct_pack(e := elapsed, l := length)) FILTER (ready) AS r, max(struct_pack(e := elapsed, l := length)) AS z FROM judged GROUP BY page_id)"""
_ROWS = """SELECT search_id, rank_no, any_value(title) AS title, any_value(url) AS url, any_value(display_url) AS display_url, any_value(snippet) AS snippet, any_value(coalesce(is_ad, false)) AS ad
  FROM search_results WHERE title IS NOT NULL AND url IS NOT NULL GROUP BY search_id, rank_no"""


_SAMPLED = f"""array_to_string(list_filter(list_transform(regexp_extract_all({_SAMPLE}, '[^.!?]+[.!?]+'), lambda x: trim(x)),
          lambda x: length(x) > 30 AND length(x) < 300 AND NOT regexp_matches(lower(x), '{_SAMPLE_STOP}'))[1:5], ' | ')"""


def statements() -> dict[str, str]:
    terms = " + ".join(f"((length(t) - length(replace(t, '{w}', ''))) // {len(w)})" for w in ("harbour", "pensions", "railway"))
    return {
        "url_policy": f"SELECT result_id, {_host('url')} AS host, {_http('url')} AS is_http, {_private('url')} AS is_private, CASE WHEN NOT {_http('url')} OR {_private('url')} THEN 'INVALID_URL' END AS error_code FROM extraction_results",
        "strip_tracking": f"SELECT result_id, {_strip('url')} AS clean_url FROM extraction_results",
        "canonical_dedupe": _LATEST,
        "unwrap_redirect": f"SELECT search_id, rank_no, {_unwrap('url')} AS target FROM search_results",
        "domain_counts": f"SELECT {_domain('url')} AS domain, count(*) AS pages FROM extraction_results GROUP BY 1",
        "search_urls": f"""SELECT search_id, 'https://www.google.com/search?q=' || replace(url_encode({_collapse("q")}), '%20', '+') || '&num=10' || coalesce('&hl=' || url_encode(l), '') || coalesce('&gl=' || url_encode(r), '') || '&udm=web' AS address
          FROM (SELECT search_id, min(query_text) AS q, min(locale) AS l, min(region_code) AS r FROM search_results GROUP BY search_id)""",
        "page_titles": f"SELECT result_id, nullif({_collapse('title')}, '') AS clean_title, nullif(lower(regexp_extract(lang, '^([A-Za-z]{{2,3}})', 1)), '') AS base_lang FROM extraction_results",
        "page_link_density": f"SELECT result_id, {_density('cleaned_html')} AS link_density FROM extraction_results",
        "page_quality": _scored("result_id", _PAGE_ROWS),
        "label_histogram": f"SELECT page_label, count(*) AS pages, min(page_score) AS least_score, max(page_score) AS most_score FROM ({_scored('result_id', _PAGE_ROWS)}) GROUP BY page_label",
        "recorded_scores": "SELECT score_label, count(*) AS pages, count(*) FILTER (weak_extraction) AS weak_pages, sum(len(warnings))::BIGINT AS warning_count FROM extraction_results GROUP BY score_label",
        "doc_quality": _scored("doc_id", _DOC_ROWS),
        "boilerplate_hits": f"SELECT result_id, {_hits('said')} AS hits FROM (SELECT result_id, coalesce(text_content, '') AS said FROM extraction_results)",
        "noise_hits": "SELECT result_id, (" + " + ".join(f"regexp_matches(said, {_noise(p)})::BIGINT" for p in NOISE) + ") AS noise_hits FROM (SELECT result_id, coalesce(text_content, '') AS said FROM extraction_results)",
        "noise_context": _noise_rows(),
        "paragraph_stats": f"""SELECT result_id, len(list_filter(regexp_split_to_array(said, '\\n\\n+'), lambda p: length({_trim("p")}) > 50))::BIGINT AS paragraphs,
          CASE WHEN len(s) = 0 THEN 0 ELSE floor(list_sum(list_transform(s, lambda x: len(regexp_split_to_array({_trim("x")}, '{_WS}+')))) / len(s)::DOUBLE + 0.5) END::BIGINT AS avg_sentence_words
          FROM (SELECT result_id, said, regexp_extract_all(said, '[^.!?]+[.!?]+') AS s FROM (SELECT result_id, coalesce(text_content, '') AS said FROM extraction_results))""",
        "text_sample": f"SELECT result_id, {_SAMPLED} AS sample FROM extraction_results",
        "snapshot_records": f"""SELECT {_domain('url')} || '-' || substr(sha256(url), 1, 8) AS snapshot, url, {_domain('url')} AS domain, {_SAMPLED} AS wanted,
          'cookie | subscribe | newsletter | privacy policy | terms of service' AS unwanted, 40 AS min_quality FROM extraction_results WHERE url IS NOT NULL AND length(cleaned_html) >= 500 AND {_SAMPLED} <> ''""",
        "short_hash": f"SELECT result_id, {_domain('url')} || '-' || substr(sha256(url), 1, 8) AS snapshot FROM extraction_results",
        "search_corpus_topk": f"SELECT * FROM (SELECT doc_id, ({terms})::BIGINT AS hits FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)) WHERE hits > 0 ORDER BY hits DESC, doc_id LIMIT 10",
        "search_ranks": f"SELECT search_id, result_rank::INTEGER AS result_rank, rank_no, {_unwrap('url')} AS target FROM ({_SHAPED}) WHERE result_rank <= 5",
        "open_result_rank": f"WITH {_LINKED} SELECT k.search_id, l.result_id, l.score FROM keyed k JOIN latest l ON l.canonical = k.page WHERE k.result_rank = 1",
        "fetch_search_extract": f"""WITH {_LINKED} SELECT k.search_id, k.result_rank::INTEGER AS rank, CASE WHEN l.result_id IS NULL OR l.text_content IS NULL THEN k.title ELSE l.title END AS title,
          coalesce(length(l.text_content), 0)::BIGINT AS content_length, coalesce(CASE WHEN l.text_content IS NOT NULL THEN l.score END, 0)::BIGINT AS extraction_score,
          CASE WHEN l.text_content IS NULL THEN 'EXTRACTION_FAILED: NAVIGATION_FAILED' ELSE coalesce(array_to_string(l.warnings, ','), '') END AS warnings
          FROM keyed k LEFT JOIN latest l ON l.canonical = k.page""",
        "failed_extractions": f"WITH {_LINKED} SELECT DISTINCT page AS canonical FROM keyed WHERE page NOT IN (SELECT canonical FROM latest)",
        "tier_audit": """SELECT tier, count(*) AS entries, count(*) FILTER (ok) AS succeeded, count(*) FILTER (ok AND d.score >= 65 AND d.noise_hits = 0) AS good, count(*) FILTER (ok AND d.noise_hits > 0) AS noisy,
          count(*) FILTER (ok AND d.weak_extraction) AS weak, count(*) FILTER (NOT ok) AS failed, floor(count(*) FILTER (ok AND d.score >= 65 AND d.noise_hits = 0) * 100.0 / count(*) + 0.5)::BIGINT AS pass_rate
          FROM (SELECT tier, coalesce(success, false) AS ok, diagnostics AS d FROM audit_entries) GROUP BY tier""",
        "latest_audits": """SELECT url, audit_id, tier, success, diagnostics.score AS score, diagnostics.noise_hits AS noise_hits, audits FROM (
          SELECT *, row_number() OVER (PARTITION BY url ORDER BY audited_at DESC, audit_id DESC) AS n, count(*) OVER (PARTITION BY url) AS audits FROM audit_entries WHERE url IS NOT NULL) WHERE n = 1""",
        "audit_rollup": "SELECT tier, category, count(*) AS entries, count(*) FILTER (success) AS succeeded, grouping(tier, category)::INTEGER AS grouping_level FROM audit_entries GROUP BY ROLLUP (tier, category)",
        "log_levels": "SELECT lower(trim(log_level)) AS level_name, error_code, count(*) AS lines FROM log_entries WHERE lower(trim(log_level)) IN ('warn', 'error') GROUP BY 1, 2",
        "log_requests": _REQUESTS,
        "tool_report": f"""SELECT tool_name, count(*) AS requests, count(*) FILTER (error_code IS NOT NULL) AS failed, count(*) FILTER (elapsed_ms > 15000) AS late,
          floor(sum(elapsed_ms) / count(elapsed_ms)::DOUBLE)::BIGINT AS mean_elapsed_ms FROM ({_REQUESTS}) GROUP BY tool_name""",
        "error_messages": f"SELECT log_id, '[' || error_code || '] ' || coalesce(message, '') AS client_message FROM ({_LINES}) WHERE error_code IS NOT NULL",
        "search_gaps": """SELECT search_id, region_code, gap_us FROM (SELECT search_id, region_code, epoch_us(searched_at) - epoch_us(lag(searched_at) OVER (PARTITION BY searched_at::DATE, region_code ORDER BY searched_at, search_id)) AS gap_us
          FROM (SELECT search_id, min(searched_at) AS searched_at, min(region_code) AS region_code FROM search_results GROUP BY search_id)) WHERE gap_us < 3600000000""",
        "serp_roundtrip": f"""SELECT search_id, (row_number() OVER (PARTITION BY search_id ORDER BY rank_no))::INTEGER AS position, {_collapse("title")} AS title, target FROM (
          SELECT search_id, rank_no, any_value(title) AS title, any_value({_unwrap("url")}) AS target, any_value(coalesce(is_ad, false)) AS ad FROM search_results WHERE title IS NOT NULL AND url IS NOT NULL GROUP BY search_id, rank_no)
          WHERE NOT ad AND {_http("target")}""",
        "serp_cards": f"""SELECT search_id, (row_number() OVER (PARTITION BY search_id ORDER BY rank_no))::INTEGER AS position, {_collapse("title")} AS title, target,
          CASE WHEN rank_no % 3 = 2 THEN NULL ELSE nullif({_collapse("display_url")}, '') END AS display_url, CASE WHEN length({_collapse("snippet")}) BETWEEN 40 AND 360 THEN {_collapse("snippet")} END AS snippet
          FROM (SELECT *, {_unwrap("url")} AS target FROM ({_ROWS})) WHERE NOT ad AND {_http("target")}""",
        "serp_blocks": f"""SELECT search_id AS query, CASE search_id % 8 WHEN 4 THEN 'SERP_PARSE_FAILED' WHEN 5 THEN 'SERP_NO_RESULTS' WHEN 6 THEN 'SERP_NO_RESULTS' WHEN 7 THEN 'SERP_NO_RESULTS' ELSE 'SERP_BLOCKED' END AS error_code,
          CASE search_id % 8 WHEN 0 THEN 'Google returned a /sorry/ anti-bot page' WHEN 1 THEN 'Google reCAPTCHA challenge detected' WHEN 2 THEN 'Google CAPTCHA form detected'
            WHEN 3 THEN 'Google block/rate-limit signal detected: unusual traffic' ELSE 'No results' END AS error_message
          FROM (SELECT search_id, bool_or(NOT ad AND {_http("target")}) AS any_row FROM (SELECT *, {_unwrap("url")} AS target FROM ({_ROWS})) GROUP BY search_id) WHERE search_id % 8 < 6 OR NOT any_row""",
        "open_result_outcomes": f"""WITH {_LINKED} SELECT q.search_id, l.result_id, l.score, CASE WHEN k.search_id IS NULL THEN 'SERP_NO_RESULTS' WHEN l.result_id IS NULL THEN 'NAVIGATION_FAILED' END AS error_code,
          CASE WHEN k.search_id IS NULL THEN 'No result found at rank 5. Only ' || (SELECT count(*) FROM keyed c WHERE c.search_id = q.search_id) || ' results returned.' END AS error_message
          FROM (SELECT DISTINCT search_id FROM search_results) q LEFT JOIN (SELECT * FROM keyed WHERE result_rank = 5) k ON k.search_id = q.search_id LEFT JOIN latest l ON l.canonical = k.page""",
        "search_web": f"""WITH typed AS (SELECT DISTINCT query_text AS query, lower({_collapse("query_text")}) AS key, greatest(1, least(10, length(query_text) % 13)) AS n FROM search_results WHERE length(query_text) BETWEEN 1 AND 500),
          keyed AS (SELECT *, lower({_collapse("query_text")}) AS key FROM search_results),
          last AS (SELECT key, max(struct_pack(a := searched_at, b := search_id)).b AS search_id FROM keyed GROUP BY key),
          rows AS (SELECT DISTINCT t.query, t.n, k.rank_no, k.title, {_unwrap("k.url")} AS url, k.snippet, k.source FROM typed t JOIN last USING (key) JOIN keyed k ON k.key = t.key AND k.search_id = last.search_id WHERE NOT coalesce(k.is_ad, false))
          SELECT query, rank::INTEGER AS rank, title, url, snippet, source FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rank_no, url) AS rank FROM rows) WHERE rank <= n""",
        "sub_resources": f"""SELECT result_id, resource_type, ok AND resource_type NOT IN ('image', 'media', 'font') AS may_load, ok AS may_load_all FROM (
          SELECT result_id, resource_type, {_http("address")} AND NOT {_private("address")} AS ok FROM (SELECT result_id, 'image' AS resource_type, image_url AS address FROM extraction_results
            UNION ALL SELECT result_id, 'document', url FROM extraction_results UNION ALL SELECT result_id, 'font', canonical_url FROM extraction_results
            UNION ALL SELECT result_id, 'script', canonical_url FROM extraction_results) WHERE address IS NOT NULL)""",
        "nested_results": f"""WITH {_LINKED}, one AS (SELECT k.search_id, k.result_rank, k.url, l.text_content, l.score FROM keyed k LEFT JOIN latest l ON l.canonical = k.page)
          SELECT q.search_id, count(one.search_id)::BIGINT AS listed, coalesce(string_agg(result_rank || ':' || url, ' ' ORDER BY result_rank), '') AS ranks,
            coalesce(string_agg(result_rank || ':' || coalesce(length(text_content), 0) || ':' || CASE WHEN text_content IS NULL THEN 0 ELSE coalesce(score, 0) END, ' ' ORDER BY result_rank), '') AS extracted
          FROM (SELECT DISTINCT search_id FROM search_results) q LEFT JOIN one ON one.search_id = q.search_id GROUP BY q.search_id""",
        "unextracted_urls": f"""WITH {_LINKED} SELECT DISTINCT page AS canonical FROM (SELECT page FROM keyed UNION ALL SELECT {_canonical("url")} FROM log_entries WHERE url IS NOT NULL)
          WHERE page NOT IN (SELECT canonical FROM latest)""",
        "open_requests": f"WITH {_EVENTS} SELECT page_id, t_ms, seq, in_flight FROM flights",
        "settle_requests": f"""WITH {_POLLS} SELECT page_id, CASE WHEN f IS NOT NULL THEN 'precheck' WHEN r IS NOT NULL THEN 'stabilized' ELSE 'timeout' END AS reason, coalesce(f, r, z).e AS waited_ms, coalesce(f, r, z).l AS text_length FROM ended""",
        "health": "SELECT 'ok' AS status, '0.1.0' AS version, true AS search_ready",
    }
