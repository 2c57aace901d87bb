"""The queries of this package for the driver: name to callable of (spark, base folder)."""

from __future__ import annotations

from pagewright.llm.bodies import p3_body, p3_found
from pagewright.llm.filters import p4_found, p4_validation, p5_found
from pagewright.llm.lines import p2_all_lines, p2_clean, p2_found
from pagewright.llm.mixing import p7_checks, p7_mix, p7_shares
from pagewright.llm.packing import p6_checks, p6_fill, p6_pack
from pagewright.llm.pii import p8_found, p8_redacted
from pagewright.llm.quality import p1_found, p1_stats


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_stats, p2_found, p2_clean, p2_all_lines, p3_found, p3_body, p4_found, p4_validation, p5_found, p6_pack, p6_fill, p6_checks, p7_mix, p7_shares, p7_checks, p8_found, p8_redacted)}


def oracle_sql() -> dict:
    """SQL where DuckDB can state the rows: lines over all records, and what must hold of packing and mixing whatever the tokenizer says."""
    site = r"regexp_replace(regexp_extract(lower(trim(coalesce(url, ''))), '^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)', 1), '^(?:www|m|amp)\.', '')"
    unified = r"regexp_replace(regexp_replace(lower(upper(translate(line, chr(8203) || chr(8204) || chr(8205) || chr(8288) || chr(65279) || chr(173), ''))), '\p{Nd}+', '0', 'g'), '[\s\p{Z}\x{1C}-\x{1F}\x{85}\x{0B}]+', '', 'g')"
    source = r"regexp_replace(regexp_replace(lower(source), '^[\s\x{A0}]+|[\s\x{A0}]+$', '', 'g'), '[\s\x{A0}-]+', '_', 'g')"
    return {
        "p2_all_lines": f"""WITH lines AS (SELECT result_id, {site} AS site, unnest(string_split(text_content, chr(10))) AS line, generate_subscripts(string_split(text_content, chr(10)), 1) AS line_no FROM extraction_results WHERE result_id IS NOT NULL),
          keyed AS (SELECT result_id, site, line_no, {unified} AS key FROM lines), often AS (SELECT site, key FROM keyed WHERE key <> '' GROUP BY site, key HAVING count(DISTINCT result_id) >= 5)
          SELECT DISTINCT result_id, line_no::INTEGER AS line_no FROM keyed JOIN often USING (site, key)""",
        "p6_checks": """SELECT spec_id, capacity_tokens, 0::BIGINT AS over_capacity, 0::BIGINT AS with_gaps, (SELECT count(DISTINCT doc_id) FROM documents) AS texts, 0::BIGINT AS needless_splits, 0::BIGINT AS incomplete
          FROM container_specs WHERE capacity_tokens > 0""",
        "p7_checks": f"""SELECT t.source, count(d.doc_id)::BIGINT AS source_records, true AS within_repeats, true AS share_met
          FROM (SELECT DISTINCT {source} AS source FROM mix_targets WHERE source IS NOT NULL) t LEFT JOIN (SELECT doc_id, {source} AS source FROM documents) d ON d.source = t.source GROUP BY t.source""",
    }
