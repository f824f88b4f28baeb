"""The core queries in SQL for DuckDB, over the same tables."""

from __future__ import annotations

from ..functions import html, masking
from ..functions.text import LINE_END, PUNCTUATION, SPACE
from ..operators import minhash, naive_bayes
from ..operators import quality_rules as q
from .pipeline import CLASSES, LANGUAGES, VARIANTS


def _q(s: str) -> str:
    return s.replace("'", "''")


_STATS = f"""
stats0 AS (SELECT doc_id, text, lang, regexp_extract_all(coalesce(text, ''), '[^{SPACE}]+') AS w,
    regexp_split_to_array(coalesce(text, ''), '{LINE_END}') AS l0 FROM documents),
stats1 AS (SELECT doc_id, text, lang, w, list_filter(w, lambda x: regexp_matches(x, '[a-zA-Z]')) AS a,
    CASE WHEN l0[-1] = '' THEN l0[1:len(l0)-1] ELSE l0 END AS l FROM stats0),
stats AS (SELECT doc_id, text, lang, len(w)::BIGINT AS n_words, len(a)::BIGINT AS n_alpha,
    length(array_to_string(a, ''))::BIGINT AS sum_alpha_len, len(l)::BIGINT AS n_lines,
    len(list_filter(l, lambda x: regexp_matches(x, '\\.\\.\\.[{SPACE}]*$')))::BIGINT AS n_ellipsis FROM stats1),
ruled AS (SELECT *, CASE WHEN n_words = 0 THEN 'empty'
    WHEN n_alpha < {q.MIN_WORDS} OR n_alpha > {q.MAX_WORDS} THEN 'word_count'
    WHEN sum_alpha_len / n_alpha::DOUBLE < {q.MIN_MEAN_LENGTH} OR sum_alpha_len / n_alpha::DOUBLE > {q.MAX_MEAN_LENGTH} THEN 'mean_word_length'
    WHEN n_ellipsis / n_lines::DOUBLE > {q.MAX_ELLIPSIS_SHARE} THEN 'ellipsis_lines'
    WHEN n_alpha / n_words::DOUBLE < {q.MIN_LETTER_SHARE} THEN 'letter_words' END AS drop_reason FROM stats)"""

_D = masking.D


def _guarded(text: str, pattern: str, mark: str) -> str:
    """A replacement between figures' borders without look-around; twice, as neighbours share a border."""
    one = lambda x: f"regexp_replace({x}, '(^|[^{_D}])({_q(pattern)})($|[^{_D}])', '\\1{mark}\\3', 'g')"
    return one(one(text))


def _emails(text: str) -> str:
    return f"regexp_replace({text}, '{_q(masking.EMAIL)}', '{masking.EMAIL_MARK}', 'g')"


def _phones(text: str) -> str:
    return _guarded(text, masking.PHONE, masking.PHONE_MARK)


def _ips(text: str) -> str:
    return _guarded(text, masking.IPV4, masking.IP_MARK)


def _masked(expr: str, mark: str) -> str:
    n = f"((length(m) - length(replace(m, '{mark}', ''))) - (length(text) - length(replace(text, '{mark}', '')))) // {len(mark)}"
    return f"SELECT doc_id, md5(m) AS masked_md5, ({n})::BIGINT AS n FROM (SELECT doc_id, text, {expr} AS m FROM documents)"


_LINES = """
parts AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL),
lines0 AS (SELECT doc_id, unnest(range(len(p))) AS pos, unnest(p) AS line, len(p) - 1 AS last FROM parts),
lines AS (SELECT doc_id, pos, CASE WHEN pos < last THEN line || chr(10) ELSE line END AS line FROM lines0 WHERE NOT (pos = last AND line = ''))"""

_NORMAL = f"trim(regexp_replace(regexp_replace(lower(regexp_replace(strip_accents(coalesce(text, '')), '\\p{{Mn}}', '', 'g')), '[{_q(''.join(chr(92) + c for c in PUNCTUATION))}]', '', 'g'), '[{SPACE}]+', ' ', 'g'))"

_P = minhash.PRIME


def _half(side: int) -> str:
    """One 31-bit half of a shingle's hash: its words' hashes, each with a factor, modulo the prime."""
    terms = [f"lead(h{side}, {k}) OVER o * {f[side]}::BIGINT % {_P}" if k else f"h{side} * {f[side]}::BIGINT % {_P}" for k, f in enumerate(minhash.ngram_factors(minhash.NGRAM))]
    return f"({' + '.join(terms)}) % {_P}"


_SHINGLES = f"""
norm AS MATERIALIZED (SELECT doc_id, {_NORMAL} AS t FROM documents),
ws AS (SELECT doc_id, string_split(t, ' ') AS w FROM norm WHERE t <> ''),
word AS (SELECT doc_id, unnest(range(len(w))) AS pos, unnest(w) AS w, len(w) AS n FROM ws),
hashed AS (SELECT doc_id, pos, n, ('0x' || substr(md5(w), 1, 8))::BIGINT % {_P} AS h0, ('0x' || substr(md5(w), 9, 8))::BIGINT % {_P} AS h1 FROM word),
gram AS (SELECT doc_id, pos, n, {_half(0)} AS g0, {_half(1)} AS g1 FROM hashed WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, g0 * 2147483648 + g1 AS h FROM gram WHERE pos + {minhash.NGRAM} <= n),
sets AS MATERIALIZED (SELECT d.doc_id, coalesce(s.hs, '') AS hs, coalesce(s.n, 0) AS n FROM documents d
    LEFT JOIN (SELECT doc_id, string_agg(h::VARCHAR, ',' ORDER BY h) AS hs, count(*) AS n FROM sh GROUP BY 1) s USING (doc_id)),
reps AS MATERIALIZED (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(hs)) AS rep, n FROM sets)"""


def _hashes(k: int) -> str:
    return ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(minhash.coefficients(k)))


def _signatures(k: int, only: str) -> str:
    return f"""
hs(i, a, b) AS (VALUES {_hashes(k)}),
sig AS (SELECT doc_id, i, min((a::BIGINT * (h >> 31) + b) % {minhash.PRIME}) AS m FROM sh, hs {only} GROUP BY 1, 2)"""


_R = minhash.HASHES // minhash.BANDS
_PAIRS = f"""{_SHINGLES},{_signatures(minhash.HASHES, "WHERE doc_id IN (SELECT rep FROM reps)")},
band AS (SELECT doc_id, i // {_R} AS band, md5(string_agg(m::VARCHAR, ',' ORDER BY i)) AS bucket FROM sig GROUP BY 1, 2),
cand AS MATERIALIZED (SELECT DISTINCT x.doc_id AS id_a, y.doc_id AS id_b FROM band x JOIN band y ON x.band = y.band AND x.bucket = y.bucket AND x.doc_id < y.doc_id),
common AS (SELECT id_a, id_b, count(*) AS c FROM cand JOIN sh x ON x.doc_id = id_a JOIN sh y ON y.doc_id = id_b AND y.h = x.h GROUP BY 1, 2),
pairs AS MATERIALIZED (SELECT id_a, id_b, c / (x.n + y.n - c)::DOUBLE AS jaccard FROM common JOIN reps x ON x.doc_id = id_a JOIN reps y ON y.doc_id = id_b
    WHERE c / (x.n + y.n - c)::DOUBLE >= {minhash.THRESHOLD})"""

_CLUSTERS = f"""{_PAIRS},
edges AS (SELECT id_a AS s, id_b AS t FROM pairs UNION ALL SELECT id_b, id_a FROM pairs),
reach(node, seen) AS (SELECT s, s FROM edges UNION SELECT r.node, e.t FROM reach r JOIN edges e ON e.s = r.seen),
comp AS (SELECT node, min(seen) AS component FROM reach GROUP BY 1),
links AS (SELECT s, count(*) AS n_links FROM edges GROUP BY 1),
clusters AS (SELECT r.doc_id, coalesce(c.component, r.rep) AS cluster_id, coalesce(l.n_links, 0)::BIGINT AS n_links
    FROM reps r LEFT JOIN comp c ON c.node = r.rep LEFT JOIN links l ON l.s = r.rep)"""

def _features(name: str, rows: str) -> str:
    """Buckets of words and word pairs, from ``rows(id, text)``."""
    bucket = f"('0x' || substr(md5(f), 1, 8))::BIGINT % {naive_bayes.BUCKETS}"
    return f"""
{name}_words AS (SELECT id, unnest(range(len(w))) AS pos, unnest(w) AS w FROM (SELECT id, regexp_extract_all(lower(text), '{naive_bayes.TOKEN}') AS w FROM ({rows}))),
{name} AS MATERIALIZED (SELECT id, {bucket} AS token, count(*) AS n FROM
    (SELECT id, w AS f FROM {name}_words UNION ALL SELECT id, w || ' ' || next FROM (SELECT id, w, lead(w) OVER (PARTITION BY id ORDER BY pos) AS next FROM {name}_words) WHERE next IS NOT NULL)
    GROUP BY 1, 2)"""


_TALLY = _features("tally", "SELECT doc_id AS id, text FROM documents")
_SAMPLE_TALLY = _features("samples", "SELECT sample_id AS id, text FROM lang_samples")


def _bayes(name: str, truth: str, classes: list[str], empty: tuple[str, float] = ("unknown", 0.0), learn: str = "tally") -> str:
    k = range(len(classes))
    c = ", ".join(f"sum(CASE WHEN label = '{x}' THEN n ELSE 0 END) AS c{i}" for i, x in enumerate(classes))
    t = ", ".join(f"sum(c{i}) AS t{i}" for i in k)
    d = ", ".join(f"count(*) FILTER (label = '{x}') AS d{i}" for i, x in enumerate(classes))
    s = ", ".join(f"sum(n * ln((c{i} + 1.0::DOUBLE) / (t{i} + v))) AS s{i}" for i in k)
    p = ", ".join(f"s{i} + ln((d{i} + 1.0::DOUBLE) / (d + {len(classes)})) AS s{i}" for i in k)
    top = f"greatest({', '.join(f's{i}' for i in k)})"
    label = "CASE " + " ".join(f"WHEN s{i} = top THEN '{x}'" for i, x in enumerate(classes)) + " END"
    spread = " + ".join(f"exp(s{i} - top)" for i in k)
    return f"""
{name}_truth AS ({truth}),
{name}_model AS MATERIALIZED (SELECT token, {c} FROM {learn} JOIN {name}_truth USING (id) GROUP BY 1),
{name}_totals AS (SELECT * FROM (SELECT count(*) AS v, {t} FROM {name}_model), (SELECT count(*) AS d, {d} FROM {name}_truth)),
{name}_sums AS (SELECT id, {s} FROM tally JOIN {name}_model USING (token), {name}_totals GROUP BY 1),
{name}_full AS (SELECT id, {p} FROM {name}_sums, {name}_totals),
{name}_top AS (SELECT *, {top} AS top FROM {name}_full),
{name}_pred AS MATERIALIZED (SELECT doc_id, coalesce({label}, '{empty[0]}') AS label, coalesce(round(1.0::DOUBLE / ({spread}), 6), {empty[1]}) AS score FROM documents LEFT JOIN {name}_top ON id = doc_id)"""


_REMAPPED = "CASE lower(trim(lang)) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in VARIANTS.items()) + " ELSE lower(trim(lang)) END"
_LANG = f"{_SAMPLE_TALLY},{_bayes('language', f'SELECT sample_id AS id, {_REMAPPED} AS label FROM lang_samples WHERE text IS NOT NULL', LANGUAGES, learn='samples')}"


def _judged(name: str, column: str, empty: tuple[str, float] = ("unknown", 0.0)) -> str:
    yes, no = CLASSES[column]
    truth = f"SELECT doc_id AS id, CASE WHEN v = 1 THEN '{yes}' ELSE '{no}' END AS label FROM (SELECT doc_id, max({column}) AS v FROM labels GROUP BY 1) JOIN documents USING (doc_id) WHERE v IS NOT NULL"
    return _bayes(name, truth, [yes, no], empty)


_TOXIC = _judged("toxic", "toxic")
_NSFW = _judged("nsfw", "nsfw")
_QUALITY = _judged("quality", "quality", ("cc", 1.0))

_DECIDED = f"""{_STATS},{_TALLY},{_LANG},{_NSFW},{_TOXIC},{_QUALITY},
decided AS (SELECT doc_id, r.text, CASE WHEN drop_reason IS NOT NULL THEN 'rules'
    WHEN l.label <> 'en' OR l.score < 0.65 THEN 'language'
    WHEN s.label = 'nsfw' AND s.score > 0.5 THEN 'nsfw'
    WHEN t.label = 'toxic' AND t.score > 0.5 THEN 'toxic'
    WHEN NOT (CASE WHEN u.label = 'wiki' THEN u.score ELSE 1 - u.score END >= 0.5) THEN 'quality' ELSE 'kept' END AS stage
    FROM ruled r JOIN language_pred l USING (doc_id) JOIN nsfw_pred s USING (doc_id) JOIN toxic_pred t USING (doc_id) JOIN quality_pred u USING (doc_id))"""

_ALL = _ips(_phones(_emails("text")))


def _html() -> str:
    out = "html"
    for pattern, by in html.CHAIN:
        out = f"regexp_replace({out}, '{_q(pattern)}', '{_q(by)}', 'g')"
    return out


SQL = {
    "doc_word_stats": f"WITH {_STATS} SELECT doc_id, n_words, n_alpha, sum_alpha_len, n_lines, n_ellipsis FROM stats",
    "quality_rules": f"WITH {_STATS} SELECT doc_id, drop_reason IS NULL AS keep, drop_reason FROM ruled",
    "quality_rule_summary": f"WITH {_STATS} SELECT coalesce(drop_reason, 'kept') AS drop_reason, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT greatest(count(*), 1) FROM documents), 4) AS pct FROM ruled GROUP BY 1",
    "mask_emails": _masked(_emails("text"), masking.EMAIL_MARK),
    "mask_phones": _masked(_phones("text"), masking.PHONE_MARK),
    "mask_ips": _masked(_ips("text"), masking.IP_MARK),
    "mask_all": f"SELECT doc_id, md5({_ALL}) AS masked_md5 FROM documents",
    "line_frequencies": f"WITH {_LINES} SELECT md5(line) AS line, count(*) AS n FROM lines GROUP BY 1 HAVING count(*) > 1",
    "dedup_lines": f"""WITH {_LINES}, single AS (SELECT md5(line) AS h, min(doc_id) AS doc_id, min(pos) AS pos, min(line) AS line FROM lines GROUP BY 1 HAVING count(*) = 1),
        built AS (SELECT doc_id, string_agg(line, '' ORDER BY pos) AS t, count(*) AS k FROM single GROUP BY 1)
        SELECT doc_id, md5(coalesce(t, '')) AS text_md5, coalesce(k, 0)::BIGINT AS kept_lines FROM documents LEFT JOIN built USING (doc_id)""",
    "exact_doc_groups": "SELECT md5(text) AS text_md5, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "normalized_text": f"SELECT doc_id, md5({_NORMAL}) AS normalized_md5 FROM documents",
    "doc_shingles": f"WITH {_SHINGLES} SELECT r.doc_id, r.n::BIGINT AS n_shingles, m.h AS min_hash FROM reps r LEFT JOIN (SELECT doc_id, min(h) >> 31 AS h FROM sh GROUP BY 1) m USING (doc_id)",
    "minhash_signatures": f"WITH {_SHINGLES},{_signatures(20, '')} SELECT doc_id, md5(coalesce(s, '{','.join('0' * 20)}')) AS signature_md5 FROM documents LEFT JOIN (SELECT doc_id, string_agg(m::VARCHAR, ',' ORDER BY i) AS s FROM sig GROUP BY 1) USING (doc_id)",
    "shingle_set_members": f"WITH {_SHINGLES} SELECT doc_id, rep FROM reps",
    "lsh_candidates": f"WITH {_PAIRS} SELECT id_a, id_b FROM cand",
    "near_duplicate_pairs": f"""WITH {_SHINGLES}, one AS (SELECT doc_id, h, n FROM sh JOIN reps USING (doc_id) WHERE doc_id = rep),
common AS (SELECT x.doc_id AS id_a, y.doc_id AS id_b, x.n AS na, y.n AS nb, count(*) AS c FROM one x JOIN one y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY 1, 2, 3, 4)
        SELECT id_a, id_b, round(c / (na + nb - c)::DOUBLE, 6) AS jaccard FROM common WHERE c / (na + nb - c)::DOUBLE >= {minhash.THRESHOLD}""",
    "duplicate_clusters": f"WITH RECURSIVE {_CLUSTERS} SELECT doc_id, cluster_id, n_links FROM clusters",
    "cluster_sizes": f"WITH RECURSIVE {_CLUSTERS} SELECT cluster_id, count(*) AS n, min(doc_id) AS kept FROM clusters GROUP BY 1 HAVING count(*) > 1",
    "dedup_fuzzy_seeded": f"WITH RECURSIVE {_CLUSTERS} SELECT doc_id FROM clusters QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY md5(doc_id::VARCHAR || '/42'), doc_id) = 1",
    "dedup_fuzzy": f"WITH RECURSIVE {_CLUSTERS} SELECT doc_id FROM clusters WHERE doc_id = cluster_id",
    "language_id": f"WITH {_TALLY},{_LANG} SELECT doc_id, label, score FROM language_pred",
    "toxicity": f"WITH {_TALLY},{_TOXIC} SELECT doc_id, label, score FROM toxic_pred",
    "nsfw": f"WITH {_TALLY},{_NSFW} SELECT doc_id, label, score FROM nsfw_pred",
    "quality_class": f"WITH {_TALLY},{_QUALITY} SELECT doc_id, label, score FROM quality_pred",
    "classifier_metrics": f"""WITH {_TALLY},{_TOXIC}, both_ AS (SELECT p.label AS got, t.label AS truth FROM toxic_pred p JOIN toxic_truth t ON p.doc_id = t.id),
        classes AS (SELECT DISTINCT got AS l FROM both_ UNION SELECT DISTINCT truth FROM both_),
        m AS (SELECT l AS label, count(*) FILTER (got = l AND truth = l) AS tp, count(*) FILTER (got = l AND truth <> l) AS fp, count(*) FILTER (got <> l AND truth = l) AS fn FROM classes, both_ GROUP BY 1)
        SELECT label, tp, fp, fn, round(tp / greatest(tp + fp, 1)::DOUBLE, 6) AS precision, round(tp / greatest(tp + fn, 1)::DOUBLE, 6) AS recall FROM m""",
    "html_text": f"SELECT page_id, md5({_html()}) AS text_md5 FROM pages",
    "filter_pipeline": f"WITH {_DECIDED} SELECT doc_id, md5({_ALL}) AS masked_md5 FROM decided WHERE stage = 'kept'",
    "filter_stats": f"WITH {_DECIDED} SELECT stage, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT greatest(count(*), 1) FROM documents), 4) AS pct FROM decided GROUP BY 1",
    "filter_stats_by_source": f"""WITH {_DECIDED}, s AS (SELECT source, stage, count(*) AS n FROM decided JOIN (SELECT doc_id, source FROM documents) USING (doc_id) GROUP BY 1, 2)
        SELECT source, stage, n, round(100.0::DOUBLE * n / sum(n) OVER (PARTITION BY source), 4) AS pct FROM s""",
    "english_documents": f"WITH {_TALLY},{_LANG} SELECT doc_id FROM language_pred WHERE label = 'en' AND score >= 0.7",
    "label_variants": f"SELECT coalesce({_REMAPPED}, '') AS label, count(*) AS n FROM documents GROUP BY 1",
    "training_rows": f"""WITH {_STATS}, t AS (SELECT doc_id, CASE WHEN v = 1 THEN 'wiki' ELSE 'cc' END AS label FROM (SELECT doc_id, max(quality) AS v FROM labels GROUP BY 1) WHERE v IS NOT NULL),
        c AS (SELECT doc_id, label, regexp_replace(replace(r.text, chr(10), ' '), '^[{SPACE}]+|[{SPACE}]+$', '', 'g') AS text FROM ruled r JOIN t USING (doc_id) WHERE label <> 'wiki' OR drop_reason IS NULL)
        SELECT doc_id, label, md5(text) AS text_md5 FROM c WHERE text <> ''""",
    "kept_text_share": f"""WITH {_STATS} SELECT coalesce(lang, '') AS lang, sum(CASE WHEN drop_reason IS NULL THEN length(text) ELSE 0 END)::BIGINT AS kept_chars, sum(length(text))::BIGINT AS total_chars,
        round(sum(CASE WHEN drop_reason IS NULL THEN length(text) ELSE 0 END) / greatest(sum(length(text)), 1)::DOUBLE, 6) AS share FROM ruled GROUP BY 1""",
    "conversion_records": "SELECT file_id, count(*) AS records, sum(n_chars)::BIGINT AS n_chars, sum(n_bytes)::BIGINT AS n_bytes FROM (SELECT DISTINCT record_id, file_id, length(payload) AS n_chars, strlen(payload) AS n_bytes FROM wet_records WHERE record_type = 'conversion') GROUP BY 1",
    "long_conversions": "SELECT DISTINCT record_id FROM wet_records WHERE record_type = 'conversion' AND length(payload) >= 200",
    "byte_stream": "SELECT doc_id, (coalesce(strlen(text), 0) + 1)::BIGINT AS n_tokens, 50256 AS last_id FROM documents",
    "token_totals": "SELECT count(*) AS documents, sum(n)::BIGINT AS tokens, (2 * sum(n))::BIGINT AS bytes, round(avg(n), 6) AS mean_tokens FROM (SELECT coalesce(strlen(text), 0) + 1 AS n FROM documents)",
    "document_lines": r"""WITH p AS (SELECT doc_id, regexp_split_to_array(text, '\r\n|\r|\n') AS p FROM documents WHERE text IS NOT NULL), q AS (SELECT doc_id, CASE WHEN p[-1] = '' THEN p[1:len(p) - 1] ELSE p END AS p FROM p)
        SELECT doc_id, unnest(range(len(p)))::INT AS pos, md5(unnest(p)) AS line_md5 FROM q""",
    "document_blocks": f"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: regexp_replace(x, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')), lambda x: x <> '') AS p FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, unnest(range(len(p)))::INT AS pos, md5(unnest(p)) AS block_md5 FROM p""",
    "http_urls": f"SELECT DISTINCT url FROM (SELECT regexp_replace(target_uri, '^[{SPACE}]+|[{SPACE}]+$', '', 'g') AS url FROM wet_records) WHERE starts_with(url, 'http')",
    "file_catalogue": "SELECT n, path, n // 4 AS chunk FROM (SELECT row_number() OVER (ORDER BY path) - 1 AS n, path FROM (SELECT DISTINCT wet_path AS path FROM crawl_files WHERE wet_path IS NOT NULL))",
    "output_names": r"SELECT file_id, regexp_replace(regexp_replace(wet_path, '^.*/', ''), '(\.warc)?(\.wet)?(\.txt)?(\.gz)?$', '') || '.txt' AS name FROM crawl_files",
    "rule_stats_by_file": f"""WITH {_STATS.replace('FROM documents', "FROM (SELECT DISTINCT record_id AS doc_id, file_id AS lang, payload AS text FROM wet_records WHERE record_type = 'conversion')")}
        SELECT lang AS file_id, coalesce(drop_reason, 'kept') AS drop_reason, count(*) AS n FROM ruled GROUP BY 1, 2""",
    "warc_scan": "SELECT coalesce(file_id::VARCHAR, 'none') AS file, target_uri, md5(payload) AS text_md5, strlen(payload)::INT AS n_bytes FROM (SELECT DISTINCT record_id, file_id, target_uri, warc_date, payload FROM wet_records WHERE record_type = 'conversion' AND payload IS NOT NULL)",
    "sampled_negatives": "SELECT doc_id FROM documents WHERE length(text) >= 100 ORDER BY md5(doc_id::VARCHAR || '/336'), doc_id LIMIT 100",
}
