"""The functions under SQL names.  Those of built-ins become SQL functions that Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators import quality_rules as q
from .html import html_to_text
from .masking import _JAVA, EMAIL_MARK, IP_MARK, PHONE_MARK
from .text import LINE_END, SPACE


def _q(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def _rules() -> str:
    """The first rule a text breaks, or null; lists are bound by lambdas, so each is made once."""
    words, lines = f"regexp_extract_all(coalesce(s, ''), '[^{_q(SPACE)}]+', 0)", f"split(coalesce(s, ''), '{_q(LINE_END)}')"
    lists = f"array(named_struct('w', {words}, 'l', {lines}))"
    alpha = f"transform({lists}, x -> named_struct('w', x.w, 'a', filter(x.w, y -> y RLIKE '[a-zA-Z]'), 'l', CASE WHEN element_at(x.l, -1) = '' THEN slice(x.l, 1, size(x.l) - 1) ELSE x.l END))"
    mean = "(char_length(array_join(x.a, '')) / size(x.a))"
    case = (
        f"CASE WHEN size(x.w) = 0 THEN 'empty' WHEN size(x.a) < {q.MIN_WORDS} OR size(x.a) > {q.MAX_WORDS} THEN 'word_count' "
        f"WHEN {mean} < {q.MIN_MEAN_LENGTH} OR {mean} > {q.MAX_MEAN_LENGTH} THEN 'mean_word_length' "
        f"WHEN size(filter(x.l, y -> y RLIKE '{_q(chr(92) + '.')}{{3}}[{_q(SPACE)}]*$')) / size(x.l) > {q.MAX_ELLIPSIS_SHARE} THEN 'ellipsis_lines' "
        f"WHEN size(x.a) / size(x.w) < {q.MIN_LETTER_SHARE} THEN 'letter_words' END"
    )
    return f"element_at(transform({alpha}, x -> {case}), 1)"


def register(spark: SparkSession, models: dict | None = None) -> None:
    """``mask_emails``, ``mask_phones``, ``mask_ips``, ``mask_all``, ``strip_text``, ``clean_text``, ``quality_drop_reason``,
    ``passes_quality_rules`` and ``html_to_text``, each of a string; with models by name ``classify_<name>``, a struct of
    label and score.

    The removal of repeated lines and of near-duplicates works on tables and has no scalar form.
    """

    def sql(name: str, body: str, kind: str = "STRING"):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(s STRING) RETURNS {kind} RETURN {body}")

    masked = "s"
    for name, mark in (("mask_emails", EMAIL_MARK), ("mask_phones", PHONE_MARK), ("mask_ips", IP_MARK)):
        sql(name, f"regexp_replace(s, '{_q(_JAVA[mark])}', '{mark}')")
        masked = f"regexp_replace({masked}, '{_q(_JAVA[mark])}', '{mark}')"
    sql("mask_all", masked)
    ends = f"'^[{_q(SPACE)}]+|[{_q(SPACE)}]+$'"
    sql("strip_text", f"regexp_replace(s, {ends}, '')")
    sql("clean_text", f"regexp_replace(translate(s, '\\n', ' '), {ends}, '')")
    sql("quality_drop_reason", _rules())
    sql("passes_quality_rules", f"({_rules()}) IS NULL", "BOOLEAN")
    spark.udf.register("html_to_text", html_to_text)
    for name, model in (models or {}).items():
        from ..operators.naive_bayes import scorer

        spark.udf.register(f"_classify_{name}", scorer(spark, {"v": model}))
        sql(f"classify_{name}", f"named_struct('label', _classify_{name}(lower(s)).v_label, 'score', _classify_{name}(lower(s)).v_score)", "STRUCT<label: STRING, score: DOUBLE>")
