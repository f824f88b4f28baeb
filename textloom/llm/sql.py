"""SQL for DuckDB where a query of this subpackage can be expressed in it."""

from __future__ import annotations

from .repetition import PHRASE, PHRASE_HAN

_SPACE = r"\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_QUOTES = "''\u2019\u2018\u02bc`"

_STATISTICS = f"""
WITH t AS (SELECT doc_id, text, lower(text) AS low, string_split(text, chr(10)) AS ls FROM documents),
u AS (SELECT doc_id, regexp_extract_all(regexp_replace(low, '([\u3400-\u9fff\u3040-\u30ff])', ' \\1 ', 'g'), '[\\p{{L}}\\p{{N}}]+(?:[''\u2019-][\\p{{L}}\\p{{N}}]+)*') AS w,
    length(regexp_replace(text, '[{_SPACE}]+', '', 'g')) AS solid,
    len(list_filter(ls, lambda x: regexp_matches(x, '[^{_SPACE}]'))) AS lines,
    len(list_filter(ls, lambda x: regexp_matches(x, '[.!?\u2026\u3002\uff01\uff1f]["''\u201d\u2019\u00bb)\\]]*[ \t\r]*$'))) AS ends FROM t),
v AS (SELECT doc_id, coalesce(len(w), 0) AS n, coalesce(length(array_to_string(w, '')), 0) AS letters, coalesce(solid, 0) AS solid, lines, ends,
    coalesce(len(list_filter(w, lambda x: list_contains(cw, x))), 0) AS common FROM u, (SELECT list(DISTINCT lower(word)) AS cw FROM common_words WHERE word IS NOT NULL))
SELECT doc_id, CASE WHEN solid = 0 THEN 0 ELSE n END::BIGINT AS n_words,
    CASE WHEN solid = 0 OR n = 0 THEN 0.0 ELSE round(letters / n::DOUBLE, 6) END::DOUBLE AS mean_word_len,
    CASE WHEN solid = 0 THEN 0.0 ELSE round(greatest(0, solid - letters) / solid::DOUBLE, 6) END::DOUBLE AS symbol_ratio,
    CASE WHEN solid = 0 THEN 0.0 ELSE round(least(1.0, ends / lines::DOUBLE), 6) END::DOUBLE AS punct_line_share,
    CASE WHEN solid = 0 OR n = 0 THEN 0.0 ELSE round(common / n::DOUBLE, 6) END::DOUBLE AS common_share FROM v"""

_REPEATED = f"""
WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(lower(text), '[{_QUOTES}]', '', 'g'), '([\u3400-\u9fff])', ' \\1 ', 'g') AS low FROM documents),
ws AS (SELECT doc_id, list_transform(regexp_extract_all(low, '\\p{{Nd}}+|[\\p{{L}}\\p{{Nl}}\\p{{No}}]+'), lambda x: CASE WHEN regexp_matches(x, '^\\p{{Nd}}') THEN '0' ELSE x END) AS w FROM t),
size AS (SELECT doc_id, coalesce(len(w), 0) AS n, CASE WHEN 2 * len(list_filter(w, lambda x: regexp_matches(x, '^[\u3400-\u9fff]'))) > len(w) THEN {PHRASE_HAN} ELSE {PHRASE} END AS k FROM ws),
word AS (SELECT doc_id, unnest(range(len(w))) AS pos, unnest(w) AS w FROM ws),
gram AS (SELECT doc_id, pos, k, n, CASE WHEN k = {PHRASE} THEN concat_ws(' ', {", ".join(f"lead(w, {i}) OVER o" for i in range(PHRASE))}) ELSE concat_ws(' ', {", ".join(f"lead(w, {i}) OVER o" for i in range(PHRASE_HAN))}) END AS g
    FROM word JOIN size USING (doc_id) WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
later AS (SELECT doc_id, pos, k FROM (SELECT doc_id, pos, k, row_number() OVER (PARTITION BY doc_id, g ORDER BY pos) AS nth FROM gram WHERE pos + k <= n) WHERE nth > 1),
marked AS (SELECT doc_id, count(DISTINCT p) AS m FROM (SELECT doc_id, unnest(range(pos, pos + k)) AS p FROM later) GROUP BY 1)
SELECT doc_id, n::BIGINT AS n_words, CASE WHEN n = 0 THEN 0.0 ELSE round(coalesce(m, 0) / n::DOUBLE, 6) END::DOUBLE AS repeated_share FROM size LEFT JOIN marked USING (doc_id)"""

_SHARES = """
WITH have AS (SELECT source, count(*) AS documents FROM documents WHERE source IS NOT NULL GROUP BY 1),
want AS (SELECT source, coalesce(max(max_repeats), 1) AS max_repeats FROM mix_targets WHERE source IS NOT NULL GROUP BY 1)
SELECT coalesce(h.source, w.source) AS source, coalesce(documents, 0)::BIGINT AS documents, max_repeats, TRUE AS cap_kept, TRUE AS share_kept FROM have h FULL JOIN want w ON h.source = w.source"""

SQL = {"p4_text_statistics": _STATISTICS, "p9_repeated_share": _REPEATED, "p8_share_check": _SHARES}
