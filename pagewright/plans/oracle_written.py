"""SQL for DuckDB that states what must come out of the pages of `written`, from the columns they were written from."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pagewright.plans.oracle import _FLAT, _collapse, _hits, _q, _scored, _trim, _truncated
from pagewright.plans.written import STANDING


@lru_cache(maxsize=1)
def compatibility() -> dict[str, str]:
    """Characters that NFKC changes but NFC does not, by the rule of the Unicode tables."""
    both = ((chr(c), unicodedata.normalize("NFKC", chr(c))) for c in range(0x80, 0x20000) if not 0xD800 <= c < 0xE000)
    return {a: b for a, b in both if a != b and unicodedata.normalize("NFC", a) == a}


def nfkc(text: str) -> str:
    """NFKC of a text: compatibility characters by a map, only where a text has any, then NFC."""
    points, ranges = sorted(map(ord, compatibility())), []
    for p in points:
        if ranges and ranges[-1][1] == p - 1:
            ranges[-1][1] = p
        else:
            ranges.append([p, p])
    some = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"
    table = "MAP {" + ", ".join(f"{_q(a)}: {_q(b)}" for a, b in compatibility().items()) + "}"
    return f"nfc_normalize(CASE WHEN regexp_matches({text}, '{some}') THEN array_to_string(list_transform(string_split({text}, ''), lambda c: coalesce({table}[c], c)), '') ELSE {text} END)"


def _literal(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '([*\\[\\]`])', '\\\\\\1', 'g'), '^#', '\\\\#')"


def _escape(text: str) -> str:
    return f"replace(replace(replace({text}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


#: Blocks of the piece, before and after boilerplate is dropped: a short block with one such phrase, or one with two.
_BLOCKS = f"""lines AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {_collapse("x")}), lambda x: x <> '') AS said,
    nullif({_collapse("agenda_item")}, '') AS heading, sitting_date, speaker, lang, sitting_no FROM documents WHERE doc_id IS NOT NULL),
  counted AS (SELECT *, list_transform(said, lambda x: {_hits("x")}) AS hits,
    {_hits("coalesce(heading, '') || array_to_string(said, '') || " + _q(STANDING + "Another piece of theirsJoin in"))} AS whole_hits FROM lines),
  kept AS (SELECT *, whole_hits >= 2 AS gone, list_filter(said, lambda x, i: NOT (hits[i] >= 2 OR hits[i] = 1 AND length(x) < 100)) AS good FROM counted)"""
_TEXT = f"array_to_string(list_filter([heading], lambda x: x IS NOT NULL) || good || [{_q(STANDING)}], chr(10) || chr(10))"


def statements() -> dict[str, str]:
    rows = f"""WITH {_BLOCKS} SELECT doc_id AS page_id, CASE WHEN gone THEN '' ELSE {nfkc(_TEXT)} END AS said, 0.0::DOUBLE AS density, true AS has_title, false AS has_byline, true AS has_excerpt,
      sitting_date IS NOT NULL AS has_date FROM kept"""
    number = "doc_id::VARCHAR"
    sitting = f"coalesce({_collapse('sitting_no')}, '-')"
    gap = " || chr(10) || chr(10) || "
    blocks = [
        f"'> As in number ' || {number}", f"'- First of ' || {number} || chr(10) || '- **Second**' || chr(10) || '1. Below'",
        f"'| Sitting | Speech |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || {_literal(sitting)} || ' | ' || {number} || ' |'", f"'```sql' || chr(10) || 'select ' || {number} || chr(10) || '```'",
        f"'Read *as* [speech ' || {number} || '](https://record.test/' || {number} || ') or `x\\[' || {number} || '\\]`.'", f"'![Seal](https://img.test/' || {number} || '.png)'", _q(STANDING),
    ]
    title = f"coalesce('# ' || {_literal('heading')}, '')"
    body = f"array_to_string(list_filter([{title}], lambda x: x <> '') || list_transform(good, lambda x: {_literal('x')}) || [{gap.join(blocks)}], chr(10) || chr(10))"
    markup = (
        f"'<div><article>' || coalesce('<h1>' || {_escape('heading')} || '</h1>', '') || array_to_string(list_transform(good, lambda x: '<p>' || {_escape('x')} || '</p>'), '') || '<blockquote><p>As in number ' || {number}"
        f" || '</p></blockquote><ul><li>First of ' || {number} || '</li><li><strong>Second</strong><ol><li>Below</li></ol></li></ul><table><tr><th>Sitting</th><th>Speech</th></tr><tr><td>' || {_escape(sitting)}"
        f" || '</td><td>' || {number} || '</td></tr></table><pre><code>select ' || {number} || '</code></pre><p>Read <em>as</em> <a href=\"https://record.test/' || {number} || '\">speech ' || {number}"
        f" || '</a> or <code>x[' || {number} || ']</code>.</p><img alt=\"Seal\" src=\"https://img.test/' || {number} || '.png\"><p>{STANDING}</p></article></div>'"
    )
    # Whole pages that match two phrases are dropped; here the quotation, list, table and code are part of the page, but hold no phrase.
    empty = "CASE WHEN gone THEN 'READABILITY_EMPTY' END AS error_code"
    long = "(SELECT sum(length(x)) FROM unnest(said || [" + _q(STANDING) + "]) AS u(x) WHERE length(x) >= 140)"
    flat = f"(SELECT doc_id, {_trim(_FLAT)} AS flat FROM (SELECT doc_id, {nfkc('text')} AS text FROM documents))"
    return {
        "normalize_docs": f"SELECT doc_id, {_truncated('flat', 400)} AS short_text FROM {flat}",
        "normalize_texts": f"SELECT doc_id, flat AS normal_text FROM {flat}",
        "written_text": f"""WITH scored AS ({_scored("page_id", rows)}), {_BLOCKS}
          SELECT page_id, CASE WHEN gone THEN '' ELSE {nfkc(_TEXT)} END AS text_content, CASE WHEN NOT gone THEN page_score END AS score, CASE WHEN NOT gone THEN page_label END AS score_label,
            CASE WHEN NOT gone THEN is_weak END AS weak_extraction,
            array_to_string(list_filter([CASE WHEN {long} < 500 THEN 'READABILITY_UNCERTAIN' END, CASE WHEN gone OR len(good) < len(said) THEN 'BOILERPLATE_REMOVED' END, CASE WHEN NOT gone THEN 'LINK_DENSE_BLOCKS_REMOVED' END],
              lambda x: x IS NOT NULL), ',') AS warnings, {empty}
          FROM kept JOIN scored ON scored.page_id = kept.doc_id""",
        "written_fields": f"""WITH {_BLOCKS} SELECT doc_id AS page_id, coalesce(heading, 'Record of the House') AS title, NULL::VARCHAR AS byline, coalesce(said[1], {_q(STANDING)}) AS excerpt, 'Record' AS site_name,
            nullif({_collapse("lang")}, '') AS lang, nullif({_collapse("speaker")}, '') AS author, 'Speech ' || {number} AS description, sitting_date::VARCHAR AS published_date,
            'https://img.test/' || {number} || '.png' AS image_url, 'https://record.test/' || {number} AS canonical_url, 'text' AS output_format, 21::BIGINT AS keys FROM kept""",
        "written_markdown": f"WITH {_BLOCKS} SELECT doc_id AS page_id, CASE WHEN gone THEN '' ELSE {nfkc(f'''regexp_replace({body}, '<[^>]+>', '', 'g')''')} END AS content_body, {empty} FROM kept",
        "written_html": f"WITH {_BLOCKS} SELECT doc_id AS page_id, CASE WHEN gone THEN '' ELSE {markup} END AS content_body, {empty} FROM kept",
    }
