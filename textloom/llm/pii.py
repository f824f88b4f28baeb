"""Problem 1: personal information inside free text.

Bootstrapped contextual extraction.  One pass over the texts yields mentions of
the right build: figures, numbers in words, addresses, e-mail addresses, an
initial with a surname.  A mention is an instance (the build of a figure, a
first name, a kind of street, a way to write the at sign) in lexical patterns
(the words before it).  Spark counts the graph of patterns and instances over
all documents and scores it iteratively: seed instances and seed patterns have
fixed scores, each other pattern gets the mean score of its instances and each
other instance the mean score of its patterns.

The mentions are then joined with the scores of their patterns and instances
and judged by both.  Names are found by the first names that the graph trusts:
a second, light pass yields the words that may be one, by a bitmap of fixed
size in which every trusted first name has its bit, and a join settles them.
No list of nodes goes to the executors or the driver.

A check of each mention's build belongs to it.  Placeholders are typed and the
rest of the text is left as it is.

Defined results: null and blank texts have no mentions; a text without mentions
is unchanged; overlapping mentions count once, the longer one first, then the
earlier; repeated rows give rows of their own in :func:`masked` and one in
:func:`mentions`; other columns are ignored whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from functools import partial

import numpy as np
import xxhash
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import map_rows, pick

KINDS = ("email", "phone", "id_number", "address", "person")
ROUNDS = 3
#: From what score on a mention is taken; most names stand in patterns that other words share.
TRUST = {"figure": 0.25, "address": 0.4, "mail": 0.3, "name": 0.05}
#: A node speaks from this score on and from so many occurrences on.
LEAST, SUPPORT = 0.05, 3
#: Bits of the map of first names.
BITS = 22

#: Seeds.  Patterns are the lower-case words before a mention, figures as 9 and names as X.
SEED_PATTERNS = {
    "phone": "tel. tel phone phone: telephone telefon teléfono téléphone tél tél. call mobile handy móvil portable rufnummer".split(),
    "id_number": ["passport", "ssn:", "ssn", "security number", "insurance number", "tax id", "steuernummer", "versicherungsnummer", "sécurité sociale", "dni", "d'identité n°", "de identidad", "personal number", "ausweisnummer", "steuernummer lautet", "dni es", "id no.", "personalausweis", "ausweis"],
    "person": ["name is", "ich heiße", "je m'appelle", "me llamo", "mr", "mrs", "ms", "dr.", "dr", "frau", "herr", "madame", "monsieur", "mme", "señora", "señor", "prof.", "name:", "mi chiamo", "signora", "signor"],
    "email": ["e-mail", "e-mail:", "email", "email:", "mailto", "mail", "courriel :", "correo:", "schreiben an", "write to"],
    "address": ["live at", "address:", "adresse :", "adresse:", "adresse ist", "dirección:", "moved to", "flat at", "wohne in", "vivimos en", "habite au"],
}
SEED_NONE = ["part no.", "order number", "tracking code", "isbn", "unix time", "build", "version", "section", "total:", "score was", "between", "server at", "article no.", "invoice no.", "item no.", "the", "in"]
SEED_SHAPES = {
    "phone": ["(999) 999-9999", "+9 999 999 9999", "9-999-999-9999", "999.999.9999", "+99 99 99999-999", "+99 (9)99 9999 9999", "+99 99 99999999", "+99 9 99 99 99 99", "999 9999 9999", "(999) 99999 999", "999/99999999"],
    "id_number": ["XX 99 99 99 X", "X99999999", "99999999X", "9 99 99 99 999 999 99"],
    "address": ["street", "road", "avenue", "straße", "rue", "calle", "avenida"],
    "email": ["@", "&#64;", "%40"],
    "person": [],
}

_FULLWIDTH = {0xFF10 + d: 48 + d for d in range(10)} | {0xFF20: "@", 0xFF0B: "+", 0xFF08: "(", 0xFF09: ")", 0xFF0D: "-", 0xFF0E: ".", 0x2010: "-", 0x2011: "-", 0x2012: "-", 0x2013: "-", 0x2014: "-", 0xA0: " ", 0x202F: " ", 0x2009: " ", 0x2019: "'"}

_UNUSUAL = re.compile("[" + "".join(map(chr, _FULLWIDTH)) + "]")

_LOCAL = r"[A-Za-z0-9À-ÿ](?:[A-Za-z0-9À-ÿ._%+\-]*[A-Za-z0-9À-ÿ_])?"
_DOT = r"(?:\.|\s?[\[({]\s?(?:dot|punkt|point|punto)\s?[\])}]\s?|\s(?:dot|DOT|punkt)\s)"
_SIGN = r"(?:@|\s?[\[({]\s?(?:at|@|arobase|arroba)\s?[\])}]\s?|&#64;|%40|\s@\s|\sat\s(?=\S+(?:\s(?:dot|punkt)\s|\s?[\[({]\s?(?:dot|punkt|point|punto)|\.(?:test|example|invalid|com|org|net|de|fr|es|it|pt|ru|co|info|eu)\b)))"
#: What a text in lower case must hold for an at sign: a sign itself, or one of these.
_SIGNS = ("@", "&#64;", "%40")
_AT = re.compile(r"[\[({]\s?(?:at|arobase|arroba)\s?[\])}]|at\s(?=\S+(?:\s(?:dot|punkt)\s|\s?[\[({]\s?(?:dot|punkt|point|punto)|\.(?:test|example|invalid|com|org|net|de|fr|es|it|pt|ru|co|info|eu)\b))")
_EMAIL = re.compile(
    rf"{_LOCAL}({_SIGN})"
    rf"[A-Za-z0-9À-ÿ](?:[A-Za-z0-9À-ÿ-]*[A-Za-z0-9À-ÿ])?(?:{_DOT}[A-Za-z0-9À-ÿ](?:[A-Za-z0-9À-ÿ-]*[A-Za-z0-9À-ÿ])?)*{_DOT}[A-Za-z]{{2,}}",
    re.I,
)
_NOT_MAIL = re.compile(r"@\d+x\.|\.(?:png|jpe?g|gif|svg|webp|css|js)$", re.I)
_FIGURE = re.compile(
    r"(?<![\w.,@#+/-])(?:\+|\((?=\d{2,5}\)))?(?:[A-Z]{1,2} ?(?=\d))?\d(?:[\d]|[ ]?[-/.()][ ]?(?=[\d(])|\)? (?=[\d(])|\) ?[-.]? ?(?=\d)|(?<=\d) (?=[A-Z] \d)|(?<= )[A-Z] (?=\d))*\d(?: ?[A-Z](?![\w]))?(?![\w@]|[.,]\d|-\d)"
)
_DIGITS = re.compile(r"\d")
_NUMERALS = "zero|oh|one|two|three|four|five|six|seven|eight|nine|double|null|eins|zwei|drei|vier|fünf|sechs|sieben|acht|neun"
_SPELLED = re.compile(rf"(?i)\b(?:(?:{_NUMERALS})\b[ -]?){{7,}}")
_NUMERAL = frozenset(_NUMERALS.split("|"))
_PHONE = re.compile(
    r"(?:\+?1[ .-]{0,3})?(?:\(\d{3}\)[ .-]{0,3}|\d{3}(?: ?[-.] ?| ?))\d{3}(?: ?[-.] ?| ?)\d{4}"
    r"|(?:\+44 ?(?:\(0\) ?)?|0)20 ?\d{4} ?\d{4}|(?:\+49|0049) ?(?:\(0\) ?)?30[ /-]?\d{4,6}[ -]?\d{2,4}|\(?030\)?[ /-]?\d{4,6}[ -]?\d{2,4}"
    r"|(?:\+33 ?(?:\(0\) ?)?|0)[1-9](?:[ .-]?\d\d){4}|(?:\+34 ?)?[679]\d\d(?:[ .-]?\d{3}){2}|\+\d{1,3}(?:[ ./()-]{0,2}\d{1,5}){2,6}|0\d{2,4}[ /-]\d{3,}(?:[ -]?\d{2,})*"
)
_ID = re.compile(
    r"9?\d{2}[- ]?\d{2}[- ]?\d{4}|\d{3}[- ]?\d{2}[- ]?\d{4}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z]|[A-Z]{1,2}\d{6,9}|\d{7,8}[- ]?[A-Z]|\d{6,8}-\d{4}"
    r"|[1-4] ?\d{2} ?\d{2} ?\d{2} ?\d{3} ?\d{3} ?\d{2}|\d{2} ?\d{6} ?[A-Z] ?\d{3}|\d{2} ?\d{3} ?\d{3} ?\d{3}|[A-Z]\d{8}|\d{9,11}"
)

_CAP = r"[A-ZÀ-ÖØ-ÞČŠŽŁ][\w'À-ÿ]*[a-zà-ÿ][\w'À-ÿ]*"
_NAME = re.compile(rf"(?<![\w@.-])({_CAP}) (?:[A-Z]\. ){{0,2}}({_CAP}(?:-{_CAP})?)(?![\w@])")

#: What the two patterns of names need first; complete, as either goes on with a capital behind the space.
_TWO_CAPITALS = re.compile(r"[A-ZÀ-ÖØ-ÞČŠŽŁ][\w'À-ÿ]* [A-ZÀ-ÖØ-ÞČŠŽŁ]")
_CAPITAL_DOT = re.compile(r"[A-Z]\. [A-ZÀ-ÖØ-ÞČŠŽŁ]")

_STREETS_EN = r"(?:Street|St\.?|Road|Rd\.?|Avenue|Ave\.?|Lane|Ln\.?|Close|Terrace|Drive|Dr\.?|Way|Court|Ct\.?|Place|Pl\.?|Crescent|Square|Row|Walk|Gardens|Grove|Hill|Boulevard|Blvd\.?)"
_HOUSE = r"\d{1,4}(?:[A-Za-z]\b)?(?: ?[-/] ?\d{1,4}[A-Za-z]?)?"
_ADDRESS_EN = re.compile(rf"(?<![\w.,/-])({_HOUSE}) (?!(?:the|of|and|an?|in|to|for|per|g)\b)((?:(?:[NSEW]\.|North|South|East|West|Old|New|Upper|Lower|Great|Little|Saint|St\.?) ){{0,2}}[A-Z][\w'-]+(?: [A-Z][\w'-]+)?) ({_STREETS_EN})(?![\w])", re.I)
_ADDRESS_DE = re.compile(rf"(?<![\w-])((?:[A-ZÄÖÜ][\wäöüß]*[- ])?[A-ZÄÖÜ][a-zäöüß]+[- ]?)([Ss]traße|[Ss]trasse|[Ss]tr\.?|weg|Weg|gasse|Gasse|allee|Allee|platz|Platz|ring|Ring|damm|Damm|ufer|Ufer|steig|pfad)[, ] ?(?:Nr\.? ?)?({_HOUSE})(?![\w.,]*\d)")
_ADDRESS_FR = re.compile(rf"(?<![\w.,/-])({_HOUSE}(?: ?(?:bis|ter|quater)\b)?),? (rue|impasse|quai|avenue|av\.|allée|place|boulevard|bd|chemin|cours|passage|route|square|sentier|ruelle)((?: (?:de|du|des|de la|de l'|la|le|les|d'))*) ?[A-ZÀ-Þ][\w'À-ÿ-]+", re.I)
_ADDRESS_ES = re.compile(rf"(?<![\w-])(Calle|C/|Avenida|Avda\.?|Av\.|Paseo|Plaza|Camino|Ronda|Carrera|Travesía|Callejón|Via|Viale|Piazza|Corso|Rua|Largo|Travessa|Praça|ул\.|улица)((?: (?:de|del|de la|de los|da|do|das|dos|della|di))*) ?[A-ZÀ-ÞА-Я][\w'À-ÿ-]+(?: [A-ZÀ-Þ][\w'À-ÿ-]+)?,? (?:n\.?º ?|núm\.? ?|nº ?)?({_HOUSE})(?![\w.,]*\d)", re.I)

_QUOTE = "\"'“”‘’«»([<{*>"


def plain(text: str) -> str:
    """The text with wide figures and dashes made usual, character by character."""
    return text if text.isascii() else _UNUSUAL.sub(lambda m: _FULLWIDTH[ord(m.group())] if isinstance(_FULLWIDTH[ord(m.group())], str) else chr(_FULLWIDTH[ord(m.group())]), text)


def _token(w: str) -> str:
    if not w:
        return ""
    if any(c.isdigit() for c in w):
        return "9"
    core = w.strip(_QUOTE)
    if "@" in w:
        return "@"
    if core[:1].isupper() and core.lower() not in _KEEP:
        return "X" + (core[-1] if core[-1:] in ",:;.!?" else "")
    return core.lower() or w[0]


_KEEP = frozenset(w for ws in SEED_PATTERNS.values() for p in ws for w in p.split()) | frozenset("mail adresse dirección ssn id no nr phone tel telefon mobile fax call ring rufen sie appelez llame nummer number isbn order part tracking build total".split())


def before(text: str, at: int, n: int = 2) -> list[str]:
    """The patterns of the last n, n - 1, .. words before a position."""
    reach = 80
    while True:
        words = text[max(0, at - reach) : at].split()
        if len(words) > n or reach >= at:
            break
        reach *= 4
    tokens = list(map(_token, words[-n:]))
    return [" ".join(filter(None, tokens[k:])) for k in range(max(1, len(tokens)))] + [""] * (n - max(1, len(tokens)))


def shape(figure: str) -> str:
    return re.sub(r"[A-Z]", "X", re.sub(r"\d", "9", figure))


_HEX = re.compile(r"\b[0-9a-f]{2} +[0-9a-f]{2} +$")
_HEX_NEXT = re.compile(r"(?: [0-9a-f]{2}){2}\b")


def figures(text: str):
    """(start, end, shape, whether it has the build of a phone number, of an identity number)."""
    for m in _FIGURE.finditer(text):
        s = m.group()
        if (6 if s[0].isalpha() else 7) <= len(_DIGITS.findall(s)) <= 19:
            phone = _PHONE.fullmatch(s)
            if not phone and (head := _PHONE.match(s)) and s[head.end() : head.end() + 1] == " " and len(_DIGITS.findall(head.group())) >= 10:
                s, phone = head.group(), head  # another figure follows the number
            if not phone and s[-1:].isalpha() and s[-2:-1] == " ":
                phone = _PHONE.fullmatch(s[:-2])
                if phone:
                    s = s[:-2]
            ident = _ID.fullmatch(m.group()) if len(s) >= len(m.group()) - 2 else None
            if not ident and s[-1:].isalpha() and s[-2:-1] == " " and _ID.fullmatch(s[:-2]):
                ident, s = True, s[:-2]
            if (phone or ident) and not (_HEX.search(text, max(0, m.start() - 12), m.start()) or _HEX_NEXT.match(text, m.start() + len(s))):
                yield m.start(), m.start() + len(s), shape(s), bool(phone), bool(ident)


_NUMBER = re.compile(r"(?<![\w.,/-])\d{1,4}(?=[ ,A-Za-z/-])")
_RUN = re.compile(r"(?<=[ ,.rR])\d")
_GERMAN = tuple("straße strasse str. str weg gasse allee platz ring damm ufer steig pfad".split())
_ROMANCE = tuple("calle c/ avenida avda av. paseo plaza camino ronda carrera travesía callejón via viale piazza corso rua largo travessa praça ул. улица".split())
_DETERMINER = frozenset("the this dem den der das die ein eine einen la le les el los las il lo os as uma un una".split())


def addresses(text: str, low: str):
    """(start, end, kind of street) of mentions with street and house number."""
    for m in _NUMBER.finditer(text):
        got = _ADDRESS_EN.match(text, m.start())
        if got:
            yield got.start(), got.end(), got.group(3).lower().rstrip(".")
        else:
            got = _ADDRESS_FR.match(text, m.start())
            if got:
                yield got.start(), got.end(), got.group(2).lower().rstrip(".")
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    if any(low[max(0, m.start() - 16) : m.start()].rstrip(" ,").removesuffix(".").removesuffix("nr").rstrip(" ,.").endswith(_GERMAN) for m in _RUN.finditer(text)):
        for m in _ADDRESS_DE.finditer(text):
            yield m.start(), m.end(), m.group(2).lower().rstrip(".")
    last = set()
    for w in _ROMANCE:
        at = low.find(w)
        while at >= 0:
            m = _ADDRESS_ES.match(text, at)
            if m and m.span() not in last:
                last.add(m.span())
                yield m.start(), m.end(), m.group(1).lower().rstrip(".")
            at = low.find(w, at + 1)


#: Rows of mentions, one for each node they ask, and of edges (family, pattern as node, instance, n).
_SCHEMA = "family STRING, what STRING, k BIGINT, h BIGINT, a INT, b INT, phone BOOLEAN, ident BOOLEAN, small BOOLEAN, side STRING, node STRING, weight DOUBLE, instance STRING, n BIGINT"


def text_hash(text: str) -> int:
    """The text's hash as Spark's ``xxhash64`` has it: with the key it names a row whose key recurs with another text."""
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed=42)
    return h - (1 << 64) if h >> 63 else h


def seen(text: str, edges: Counter):
    """(family, what, start, end, phone, ident, small, nodes) for the mentions of a text; the nodes that speak for one are
    (side, node, weight).  Their edges (family, pattern, instance) are added to ``edges``."""

    def patterns(family, at, inst, weights):
        found = before(text, at, len(weights))
        for p in dict.fromkeys(found):
            edges[family, p, inst] += 1
        return [("pattern", p, w) for p, w in zip(found, weights, strict=True) if p] + [("instance", inst, 1.0)]

    low = text.lower()
    if any(x in text for x in _SIGNS) or _AT.search(low):
        for m in _EMAIL.finditer(text):
            if not _NOT_MAIL.search(m.group()) and not m.group().lower().endswith("localhost"):
                sign = m.group(1).strip().lower()
                if sign not in _SIGNS:
                    sign = f" {sign} " if m.group(1)[0].isspace() else sign
                yield "mail", "mail", m.start(), m.end(), False, False, False, patterns("mail", m.start(), sign, (1.0, 0.8))
    for a, b, inst, phone, ident in figures(text):
        yield "figure", "figure", a, b, phone, ident, False, patterns("figure", a, inst, (1.0, 1.0, 0.8))
    if sum(map(_NUMERAL.__contains__, low.replace("-", " ").split())) >= 5:  # at least the inner ones stand free
        for m in _SPELLED.finditer(text):
            inst = f"words {len(re.findall('[^ -]+', m.group()))}"
            yield "figure", "figure", m.start(), m.end() - (m.group()[-1] in " -"), True, False, False, patterns("figure", m.start(), inst, (1.0, 1.0, 0.8))
    for a, b, inst in addresses(text, low):
        nodes = patterns("address", a, inst, (1.0, 1.0))
        word = text[max(0, a - 12) : a].split()
        if not (word and text[a - 1].isspace() and word[-1].lower() in _DETERMINER):
            small = not any(c.isupper() for c in text[a:b])
            yield "address", "address", a, b, False, False, small, nodes
    for m in _NAME.finditer(text) if _TWO_CAPITALS.search(text) else ():
        inst = m.group(1).lower()
        two, one = before(text, m.start())
        if one[:1].islower() or one[-1:] == "," or one in ("9", "-", "*") or not one:
            edges["name", two, inst] += 1
            edges["name", one, inst] += 1
        edges["ending", inst, _ending(m.group(2))] += 1
    for m in _INITIAL.finditer(text) if _CAPITAL_DOT.search(text) else ():
        two, one = before(text, m.start())
        yield "name", "initial", m.start(), m.end(), False, False, False, [("pattern", two, 1.0), ("pattern", one, 0.9), ("ending", _ending(m.group(1)), 1.0)]


def _mentioned():
    def work(docs, texts):
        edges: Counter = Counter()
        for d, t in zip(docs, texts, strict=True):
            if t and t.strip():
                h = text_hash(t)
                for family, what, a, b, phone, ident, small, nodes in seen(plain(t), edges):
                    for side, node, weight in nodes:
                        yield family, what, d, h, a, b, phone, ident, small, side, node, weight, None, None
        for (family, pattern, inst), n in edges.items():
            yield family, "edge", None, None, None, None, None, None, None, None, pattern, None, inst, n

    return work


def graph(found: DataFrame) -> DataFrame:
    """``family, pattern, instance, n``: how often each pattern stands before each instance, over all documents."""
    rows = found.where(F.col("what") == "edge").select("family", F.col("node").alias("pattern"), "instance", "n")
    return rows.groupBy("family", "pattern", "instance").agg(F.sum("n").alias("n"))


def endings(edges: DataFrame, first: DataFrame, least: int = SUPPORT) -> DataFrame:
    """``ending``: surname endings that follow trusted first names at least half the time."""
    own = edges.where(F.col("family") == "ending").join(first.select(F.col("node").alias("pattern"), F.lit(1).alias("yes")), "pattern", "left")
    rows = own.groupBy(F.col("instance").alias("ending")).agg(F.sum(F.when(F.col("yes") == 1, F.col("n")).otherwise(0)).alias("yes"), F.sum("n").alias("n"))
    return rows.where((F.col("yes") >= least) & (F.col("yes") >= 0.5 * F.col("n"))).select(F.col("ending").alias("node"))


#: What a family's mentions can be, besides nothing.
FAMILIES = {"figure": ("phone", "id_number"), "name": ("person",), "address": ("address",), "mail": ("email",)}


def _seeds(spark) -> DataFrame:
    rows = {}
    for family, kinds in FAMILIES.items():
        rows |= {(family, "pattern", p): "none" for p in SEED_NONE}
        for kind in kinds:
            rows |= {(family, "pattern", p): kind for p in SEED_PATTERNS[kind]} | {(family, "instance", s): kind for s in SEED_SHAPES[kind]}
    return spark.createDataFrame([(*k, v) for k, v in rows.items()], "family STRING, side STRING, node STRING, seed STRING")


def score(edges: DataFrame, rounds: int = ROUNDS) -> dict[str, DataFrame]:
    """For patterns and instances ``family, node, n`` and a score for each kind: iterated mean scores over the graph; seeds keep theirs.

    Each round is one join of the edges with the scores of their one side and one aggregation by the other; what it
    gives is cut from its lineage.
    """
    seeds = _seeds(edges.sparkSession)
    base = edges.where((F.col("pattern") != "") & (F.col("family") != "ending"))
    for side in ("pattern", "instance"):  # some dozens of seeds
        own = seeds.where(F.col("side") == side).select("family", F.col("node").alias(side), F.col("seed").alias(f"{side}_seed"))
        base = base.join(F.broadcast(own), ["family", side], "left")
    base = _cut(base)
    pinned = lambda seed, kind, free: F.when(F.col(seed).isNotNull(), (F.col(seed) == kind).cast("double")).otherwise(free).alias(kind)
    current = seeds.where(F.col("side") == "pattern").select("family", "node", *[(F.col("seed") == k).cast("double").alias(k) for k in KINDS])
    done = {}
    for k in range(2 * rounds):
        side, other = ("instance", "pattern") if k % 2 == 0 else ("pattern", "instance")
        rows = base.join(current.drop("n").withColumnRenamed("node", other), ["family", other], "left")
        sums = rows.groupBy("family", F.col(side).alias("node")).agg(F.sum("n").alias("n"), F.first(f"{side}_seed").alias("seed"), *[F.sum(F.col("n") * F.coalesce(c, F.lit(0.0))).alias(c) for c in KINDS])
        # what no pattern or instance speaks for counts as half a mention of nothing
        mean = lambda c: F.when(F.col(c) / (F.col("n") + 0.5) > LEAST, F.col(c) / (F.col("n") + 0.5)).otherwise(0.0)
        current = _cut(sums.select("family", "node", "n", *[pinned("seed", c, mean(c)) for c in KINDS]).where(F.greatest(*KINDS) > 0))
        done[side] = current
    return done


def _cut(df: DataFrame) -> DataFrame:
    """checkpoint() where a folder for it is set, in the session or its configuration; otherwise kept as it is."""
    sc = df.sparkSession.sparkContext
    where = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if where and not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return df.checkpoint() if sc.getCheckpointDir() else df.persist()


def trusted(edges: DataFrame) -> DataFrame:
    """``family, side, node`` with a score for each kind: the nodes that may speak, seed patterns, and surname endings.

    Seed patterns of nothing have a score of ``none``.
    """
    parts = [df.where(F.col("n") >= SUPPORT).select("family", F.lit(side).alias("side"), "node", *KINDS, F.lit(0.0).alias("none")) for side, df in score(edges).items()]
    seeds = _seeds(edges.sparkSession).where(F.col("side") == "pattern").select("family", "side", "node", *[(F.col("seed") == k).cast("double").alias(k) for k in (*KINDS, "none")])
    nodes = parts[0].unionByName(parts[1]).unionByName(seeds)
    return _cut(nodes.groupBy("family", "side", "node").agg(*[F.max(k).alias(k) for k in (*KINDS, "none")]))


def by_kind(scores: DataFrame) -> DataFrame:
    """``family, side, node, kind, score`` with a column for each kind."""
    return scores.groupBy("family", "side", "node").agg(*[F.max(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0)).alias(k) for k in (*KINDS, "none")])


def judged(found: DataFrame, nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """``k, h, a, b, kind`` of the mentions that their patterns and instances speak for: one join and one aggregation.

    A figure is of the kind that scores best, unless a pattern of nothing scores better; where no pattern is known its
    build alone must say more.  Addresses written small need their pattern, initials theirs or a known surname ending.
    """
    place = ["what", "k", "h", "a", "b", "phone", "ident", "small"]
    kinds = [*KINDS, "none"]
    ended = ends.select(F.lit("name").alias("family"), F.lit("ending").alias("side"), "node", *[F.lit(float(k == "person")).alias(k) for k in kinds])
    said = nodes.unionByName(ended).select("family", "side", "node", F.struct(*kinds).alias("s"))
    asked = found.where(F.col("a").isNotNull()).select("family", *place, "side", "node", "weight").join(said, ["family", "side", "node"], "left")
    of = lambda side, k: F.coalesce(F.max(F.when(F.col("side") == side, F.col("weight") * F.col(f"s.{k}"))), F.lit(0.0))
    used = {("pattern", k) for k in kinds} | {("instance", k) for k in ("phone", "id_number", "address", "email")} | {("ending", "person")}
    rows = asked.groupBy(*place).agg(F.max(F.when(F.col("side") == "pattern", F.col("s").isNotNull())).alias("known"), *[of(side, k).alias(f"{side}_{k}") for side, k in sorted(used)])
    at = lambda side, k: F.col(f"{side}_{k}")
    total = lambda k: F.when(F.col("known"), 0.6 * at("pattern", k) + 0.4 * at("instance", k)).otherwise(0.75 * at("instance", k))
    rows = rows.withColumns({"_phone": F.when(F.col("phone"), total("phone")).otherwise(-1.0), "_id": F.when(F.col("ident"), total("id_number")).otherwise(-1.0)})
    best = F.greatest("_phone", "_id")
    kind = (
        F.when((F.col("what") == "figure") & (best >= TRUST["figure"]) & (best > 0.6 * at("pattern", "none")), F.when(F.col("_phone") >= F.col("_id"), "phone").otherwise("id_number"))
        .when((F.col("what") == "address") & (F.greatest(at("pattern", "address"), F.when(F.col("small"), 0.0).otherwise(at("instance", "address"))) >= TRUST["address"]), "address")
        .when((F.col("what") == "mail") & (F.greatest(at("pattern", "email"), at("instance", "email")) >= TRUST["mail"]), "email")
        .when((F.col("what") == "initial") & ((at("pattern", "person") >= 0.5) | (at("ending", "person") > 0)), "person")
    )
    return rows.select("k", "h", "a", "b", kind.alias("kind")).where(F.col("kind").isNotNull())


def first_names(nodes: DataFrame) -> DataFrame:
    """``node``: the first names that are trusted."""
    return nodes.where((F.col("family") == "name") & (F.col("side") == "instance") & (F.col("person") >= TRUST["name"])).select("node")


def bitmap(first: DataFrame) -> bytes:
    """A bit for each first name; the driver gets at most 2**BITS places."""
    places = [r[0] for r in first.select(F.pmod(F.xxhash64("node"), F.lit(1 << BITS)).alias("x")).distinct().collect()]
    bits = np.zeros(1 << BITS, np.uint8)
    bits[places] = 1
    return np.packbits(bits).tobytes()


class _Maybe(dict):
    """Whether a word may be a first name; the answers are remembered, up to a number."""

    def __init__(self, packed: bytes):
        super().__init__()
        self.bits = np.unpackbits(np.frombuffer(packed, np.uint8))

    def __missing__(self, word: str) -> bool:
        if len(self) > 500_000:
            self.clear()
        low = word.lower()
        got = self[word] = bool(self.bits[text_hash(low) & ((1 << BITS) - 1)])
        return got


def _named(packed: bytes):
    maybe = _Maybe(packed)

    def work(docs, texts):
        for d, t in zip(docs, texts, strict=True):
            if t:
                p, h = plain(t), None
                if not any(maybe[w] or w.endswith("'s") and maybe[w[:-2]] for w in set(_ANY.findall(p))):
                    continue
                for m in _FIRST.finditer(p):
                    word = m.group()
                    name = word if maybe[word] else word[:-2] if word.endswith("'s") and maybe[word[:-2]] else None
                    if name is not None:
                        for a, b in people(p, m.start(), m.start() + len(name)):
                            h = text_hash(t) if h is None else h
                            yield d, h, a, b, name.lower()

    return work


_SURNAME = r"[\w'À-ÿ]{3,}(?:-[\w'À-ÿ]{3,})?"
_INITIAL = re.compile(rf"(?<![\w@.-])[A-Z]\. (?:[A-Z]\. )?({_CAP}(?:-{_CAP})?)(?![\w@])")


_FIRST = re.compile(r"(?<![\w@.+-])[^\W\d_][\w']*")
_ANY = re.compile(r"[^\W\d_][\w']*")
_REST = re.compile(rf"\s(?:([A-Z]\.)(?:\s|(?=\W|$))){{0,2}}({_SURNAME})?(?![\w@]|\.\w+@)", re.I)
_AFTER_TURNED = re.compile(r"(?:\s[A-Z]\.)?(?![\w@]|-\w)", re.I)
_SURNAME_ONLY = re.compile(_SURNAME)


def people(t: str, a: int, b: int):
    """(start, end) of the names whose first name stands from a to b: with a surname or an initial behind it, or behind its surname and a comma."""
    first = t[a:b]
    m = _REST.match(t, b)
    if m:
        if m.group(2) and _surname(m.group(2), first):
            yield a, m.end()
        elif not m.group(2) and m.group(1) and first[0].isupper():
            yield a, m.end(1)
    if a >= 5 and t[a - 2] == "," and t[a - 1].isspace():
        c = a - 2
        while c and (t[c - 1].isalnum() or t[c - 1] in "_'-"):
            c -= 1
        surname, m = t[c : a - 2], _AFTER_TURNED.match(t, b)
        if m and (not c or t[c - 1] not in "@.") and _SURNAME_ONLY.fullmatch(surname) and _surname(surname, first):
            yield c, m.end()


def _ending(surname: str) -> str:
    """The last four letters, by which surnames are recognised beside an initial."""
    return surname.removesuffix("'s")[-4:].lower()


def _surname(surname: str, first: str) -> bool:
    """A surname is written like the first name: with a capital, in capitals, or all lower case and no usual word."""
    if first.isupper():
        return surname.isupper()
    if first[0].isupper():
        return surname[0].isupper() and not surname.isupper()
    return surname.islower() and surname not in _KEEP and len(surname) >= 5


def _settled():
    """Of overlapping mentions the longer one first, then the earlier."""

    def work(docs, hashes, found):
        for d, h, xs in zip(docs, hashes, found, strict=True):
            starts: list[int] = []
            kept: list[tuple] = []
            for x in sorted(((x["a"], x["b"], x["kind"]) for x in xs), key=lambda x: (x[0] - x[1], x)):
                at = bisect_right(starts, x[0])
                if (not at or kept[at - 1][1] <= x[0]) and (at == len(kept) or kept[at][0] >= x[1]):
                    starts.insert(at, x[0])
                    kept.insert(at, x)
            yield d, h, [{"a": a, "b": b, "kind": kind} for a, b, kind in kept]

    return work


def spans(documents: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``k, h, found``: by key and hash of its text the mentions of each document that has any, as (a, b, kind)."""
    texts = pick(documents, doc, text)
    found = map_rows(texts, _SCHEMA, _mentioned).persist(StorageLevel.MEMORY_AND_DISK)
    edges = _cut(graph(found))
    nodes = trusted(edges)
    first = first_names(nodes)
    return extracted(texts, found, nodes, endings(edges, first))


def extracted(texts: DataFrame, found: DataFrame, nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """:func:`spans` from mentions and trusted nodes."""
    first = first_names(nodes)
    named = map_rows(texts, "k BIGINT, h BIGINT, a INT, b INT, node STRING", partial(_named, bitmap(first)))
    names = named.join(first, "node").select("k", "h", "a", "b", F.lit("person").alias("kind"))
    every = judged(found, nodes, ends).unionByName(names)
    one = every.groupBy("k", "h").agg(F.collect_set(F.struct("a", "b", "kind")).alias("found"))
    return map_rows(one, "k BIGINT, h BIGINT, found ARRAY<STRUCT<a: INT, b: INT, kind: STRING>>", _settled)


def mentions(documents: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc, kind, start_char`` of every piece of personal information, once each."""
    return spans(documents, doc, text).select(F.col("k").alias(doc), F.explode("found").alias("x")).select(doc, "x.kind", F.col("x.a").alias("start_char")).distinct()


def _mask():
    def work(docs, texts, found):
        for d, t, xs in zip(docs, texts, found, strict=True):
            out, last = [], 0
            for x in xs or ():
                out += [t[last : x["a"]], f"[{x['kind'].upper()}]"]
                last = x["b"]
            yield d, t if t is None else "".join((*out, t[last:])), len(xs or ())

    return work


def masked(documents: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc, masked, n_masked``: each text with typed placeholders for its personal information."""
    base = pick(documents, doc, text).withColumn("h", F.xxhash64("c0"))
    rows = base.join(spans(documents, doc, text).withColumnRenamed("k", "kk").withColumnRenamed("h", "hh"), (F.col("k") == F.col("kk")) & (F.col("h") == F.col("hh")), "left")
    return map_rows(rows.select("k", "c0", "found"), f"`{doc}` BIGINT, masked STRING, n_masked INT", _mask)
