"""E-mail addresses, phone numbers and IPv4 addresses replaced by placeholders, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE

# What is masked, and by what.  Figures and white space are those of Unicode.
D = r"\p{Nd}"
S = f"[{SPACE}.\\-]"
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,6}"
PHONE = rf"(?:{D}{{10}}|(?:\+?1{S}?)?(?:\({D}{{3}}\){S}?|{D}{{3}}{S}){D}{{3}}{S}?{D}{{4}})"
OCTET = rf"(?:25[0-5]|2[0-4]{D}|[01]?{D}{D}?)"
IPV4 = rf"(?:{OCTET}\.){{3}}{OCTET}"
EMAIL_MARK, PHONE_MARK, IP_MARK = "|||EMAIL_ADDRESS|||", "|||PHONE_NUMBER|||", "|||IP_ADDRESS|||"

_JAVA = {
    EMAIL_MARK: rf"(?<!\|\|\|){EMAIL}",
    PHONE_MARK: rf"(?<!{D}){PHONE}(?!{D})",
    IP_MARK: rf"(?<!{D}){IPV4}(?!{D})",
}


def _mask(text: Column, mark: str) -> Column:
    pattern = _JAVA[mark]
    return F.struct(F.regexp_replace(text, pattern, mark).alias("text"), F.regexp_count(text, F.lit(pattern)).alias("n"))


def mask_emails(text: Column) -> Column:
    """``struct<text, n>``: the text with e-mail addresses masked, and how many there were."""
    return _mask(text, EMAIL_MARK)


def mask_phones(text: Column) -> Column:
    """``struct<text, n>`` for phone numbers of ten figures."""
    return _mask(text, PHONE_MARK)


def mask_ips(text: Column) -> Column:
    """``struct<text, n>`` for IPv4 addresses."""
    return _mask(text, IP_MARK)


def mask_all(text: Column) -> Column:
    """E-mail addresses, then phone numbers, then IP addresses, each on what the one before left."""
    for mark in (EMAIL_MARK, PHONE_MARK, IP_MARK):
        text = F.regexp_replace(text, _JAVA[mark], mark)
    return text
