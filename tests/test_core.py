"""The core operators on small inputs, with their border cases."""

import gzip
import math
import random
import re
import unicodedata
from collections import Counter
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.__main__ import main as cli
from textloom.functions.html import decode, extract, html_to_text
from textloom.functions.masking import mask_all, mask_emails, mask_ips, mask_phones
from textloom.functions.register import register
from textloom.functions.text import lines, normalized, words
from textloom.operators import lines as line_ops
from textloom.operators import minhash, naive_bayes, quality_rules, similar
from textloom.io import materialised
from textloom.operators.components import components
from textloom.plans import folders, pipeline
from textloom.plans import queries as core
from textloom.sinks import tokens
from textloom.sources import files, storage, warc
from textloom.streaming.rowlevel import first_seen, ruled_and_masked


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t STRING").select(expr(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    ("mask", "text", "masked", "n"),
    [
        (mask_emails, "to test@example.org now", "to |||EMAIL_ADDRESS||| now", 1),
        (mask_emails, "a@b.org, c@d.org", "|||EMAIL_ADDRESS|||, |||EMAIL_ADDRESS|||", 2),
        (mask_emails, "a@b.photography", "|||EMAIL_ADDRESS|||raphy", 1),
        (mask_phones, "2831823829", "|||PHONE_NUMBER|||", 1),
        (mask_phones, "(283)-182-3829", "|||PHONE_NUMBER|||", 1),
        (mask_phones, "call (283) 182 3829", "call |||PHONE_NUMBER|||", 1),
        (mask_phones, "283-182-3829", "|||PHONE_NUMBER|||", 1),
        (mask_phones, "12831823829", "12831823829", 0),
        (mask_ips, "at 192.0.2.146.", "at |||IP_ADDRESS|||.", 1),
        (mask_ips, "256.1.1.1", "256.1.1.1", 0),
        (mask_ips, None, None, None),
    ],
)
def test_masks(spark, mask, text, masked, n):
    assert tuple(one(spark, text, mask)) == (masked, n)


def test_masking_twice_changes_nothing(spark):
    text = "a@b.org 283-182-3829 192.0.2.1 " * 3
    assert one(spark, one(spark, text, mask_all), mask_all) == one(spark, text, mask_all)


def test_words_lines_and_normal_form_as_in_python(spark):
    texts = ["", " ", "a\u0085b c", "x\r\ny\n\nz", "last\n", "Żółw, ÉTÉ é İ ß Ł!", "tab\tand　wide\x1fspace"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING")
    for r in df.select("i", words(F.col("t")).alias("w"), lines(F.col("t")).alias("l"), normalized(F.col("t")).alias("n")).collect():
        t = texts[r.i]
        assert r.w == t.split()
        assert r.l == (t.splitlines() or [])
        bare = "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn").lower()
        assert r.n == " ".join(re.sub(r"[!-/:-@\[-`{-~]", "", bare).split())


def reason(spark, text):
    return quality_rules.rules(spark.createDataFrame([(text,)], "text STRING")).first().drop_reason


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("word " * 50, None),
        ("word " * 49, "word_count"),
        ("", "empty"),
        ("  \n ", "empty"),
        (None, "empty"),
        ("ab " * 60, "mean_word_length"),
        ("abc " * 60, None),
        ("abcdefghij " * 60, None),
        ("abcdefghijk " * 60, "mean_word_length"),
        ("word " * 80 + "12 " * 20, None),
        ("word " * 79 + "12 " * 21, "letter_words"),
        ("\n".join(["word " * 20 + "..."] * 3 + ["word " * 20] * 7), None),
        ("\n".join(["word " * 20 + "..."] * 4 + ["word " * 20] * 6), "ellipsis_lines"),
        ("\n".join(["word " * 20 + "…"] * 10), None),
    ],
)
def test_rules_at_their_bounds(spark, text, expected):
    assert reason(spark, text) == expected


def test_rules_with_too_many_words(spark):
    assert reason(spark, "word " * 100_001) == "word_count"


def test_repeated_lines(spark):
    docs = [(1, "a\nb\n"), (2, "a\nb\n"), (3, "- home\n- back\nown\n"), (4, "- home\nmine"), (5, "mine\nx\n"), (6, ""), (7, None)]
    df = spark.createDataFrame(docs, "doc_id BIGINT, text STRING")
    got = {r.doc_id: (r.text, r.kept_lines) for r in line_ops.dedup(df).collect()}
    # a last line without its line feed is another line
    assert got == {1: ("", 0), 2: ("", 0), 3: ("- back\nown\n", 2), 4: ("mine", 1), 5: ("mine\nx\n", 2), 6: ("", 0), 7: ("", 0)}


def test_near_duplicates_classes_and_copies(spark):
    base = [f"w{i}" for i in range(120)]
    near = [*base[:118], "x", "y"]
    docs = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(base).upper()), (4, "too short"), (5, "other few"), (6, None), (7, " ".join(f"z{i}" for i in range(80)))]
    df = spark.createDataFrame(docs, "doc_id BIGINT, text STRING")
    got = {r.doc_id: (r.cluster_id, r.n_links) for r in minhash.clusters(df).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 1), 4: (4, 0), 5: (4, 0), 6: (4, 0), 7: (7, 0)}
    assert sorted(r.doc_id for r in minhash.dedup(df).collect()) == [1, 4, 7]
    assert minhash.dedup(df.limit(0)).count() == 0


def test_components_of_chains_and_cycles(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (102, 100)] + [(200, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "src BIGINT, dst BIGINT")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 102: 100}


def test_bayes_learns_and_falls_back(spark):
    rows = [(1, "good kind words", "ok"), (2, "good kind day", "ok"), (3, "bad foul words", "no"), (4, "foul bad day", "no"), (5, "kind good", None), (6, "!!", None), (7, None, None), (8, "unheard things", "other")]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, label STRING")
    got = {r.doc_id: (r.label, r.score) for r in naive_bayes.classify(df, df, ["ok", "no"]).collect()}
    assert got[5][0] == "ok" and got[5][1] > 0.5
    assert got[6] == got[7] == got[8] == ("unknown", 0.0)
    assert naive_bayes.classify(df.limit(0), df, ["ok", "no"]).count() == 0
    assert {r.label for r in naive_bayes.classify(df, df.limit(0), ["ok", "no"]).collect()} == {"unknown"}


def test_bayes_word_pairs_equal_brute_force(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice("ab cd ef gh".split()) for _ in range(rng.randrange(1, 12))), rng.choice(["x", "y", None])) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id BIGINT, text STRING, label STRING")
    feats = lambda t: t.split() + [f"{a} {b}" for a, b in zip(t.split(), t.split()[1:])]
    counts = {c: Counter(f for _, t, y in docs if y == c for f in feats(t)) for c in "xy"}
    known = set(counts["x"]) | set(counts["y"])
    n = Counter(y for _, _, y in docs if y)
    for r in naive_bayes.classify(df, df, ["x", "y"]).collect():
        f = [g for g in feats(docs[r.doc_id][1]) if g in known]
        s = {c: math.log((n[c] + 1) / (n["x"] + n["y"] + 2)) + sum(math.log((counts[c][g] + 1) / (sum(counts[c].values()) + len(known))) for g in f) for c in "xy"}
        best = max("xy", key=lambda c: s[c])
        assert (r.label, r.score) == (best, pytest.approx(1 / sum(math.exp(v - s[best]) for v in s.values()), abs=1e-6))


def test_models_are_saved_and_loaded(spark, tmp_path):
    df = spark.createDataFrame([("good kind words", "ok", "b"), ("foul bad day", "no", "a"), (None, "no", None)], "text STRING, label STRING, other STRING")
    models = naive_bayes.fit(df, {"label": ["ok", "no"], "other": ["a", "b"]}, empty={"label": ("no", 1.0)})
    assert models["label"].texts.tolist() == [1, 2] and models["other"].texts.tolist() == [1, 1]
    for m in models.values():
        m.save(spark, str(tmp_path / "m"))
        got = naive_bayes.Model.load(spark, str(tmp_path / "m"))
        assert got.classes == m.classes and (got.counts == m.counts).all() and (got.texts == m.texts).all() and got.empty == m.empty
    assert [x[1:] for x in naive_bayes.sanity(spark, got, [("kind words", "b"), ("bad day", "b")])][1][2] is False
    with pytest.raises(Exception, match="(?i)path"):
        naive_bayes.Model.load(spark, str(tmp_path / "none"))


def test_language_labels(spark):
    rows = [("zh-Hant", "en", 0.7), (" EN ", "en", 0.69), ("zh_hans", "de", 0.9), (None, None, None)]
    df = spark.createDataFrame(rows, "l STRING, label STRING, score DOUBLE").select(pipeline.remapped(F.col("l")).alias("l"), pipeline.is_english(F.col("label"), F.col("score")).alias("e"))
    assert [tuple(r) for r in df.collect()] == [("zh", True), ("en", False), ("zh", False), (None, False)]


def test_pipeline_stages(spark):
    good = "The quiet river town kept its old mill and the people were glad of that good work every single day. "
    docs = spark.createDataFrame([(1, good * 4, "f1"), (2, "few words", "f1"), (3, "Die alte Stadt am Fluss hat eine Mühle und die Leute sind froh über die gute Arbeit jeden Tag. " * 4, "f2"), (4, "stupid vile moron trash talk here " * 12, "f2"), (5, None, None)], "doc_id BIGINT, text STRING, file STRING")
    labels = spark.createDataFrame([(1, 1, 0, 0), (1, None, 0, 0), (4, 0, 1, 0), (3, 1, 0, None)], "doc_id BIGINT, quality INT, toxic INT, nsfw INT")
    samples = spark.createDataFrame([("en", good), ("en", "stupid moron trash talk here"), ("de", "Die alte Stadt am Fluss hat eine Mühle und die Leute"), ("zh-hans", "古老的城市"), (None, "x")], "lang STRING, text STRING")
    models = pipeline.fit_models(docs, labels, samples)
    stages = {r.doc_id: r.stage for r in pipeline.decided(docs, models).collect()}
    assert stages == {1: "kept", 2: "rules", 3: "language", 4: "toxic", 5: "rules"}
    by = {(r.file, r.stage): (r.n, r.pct) for r in pipeline.filter_stats(docs, models, by="file").collect()}
    assert by[("f1", "kept")] == (1, 50.0) and by[(None, "rules")] == (1, 100.0)
    assert pipeline.filter_documents(docs.limit(0), models).count() == 0
    rows = pipeline.training_rows(docs, labels).collect()
    assert [(r.doc_id, r.label) for r in rows] == [(1, "wiki"), (3, "wiki"), (4, "cc")] and "\n" not in rows[0].text
    assert len(pipeline.training_rows(docs, labels, seed=42).collect()) == 3


def test_html(spark):
    page = "<html><head><title>t</title><script>if(a<b){'</p>'}</script></head><body><h1>Head</h1><p>One  &amp; two <a href=x>link</a>.</p><ul><li>a</li><li>b</ul><img src=y></body>"
    assert extract(page) == "Head\n\nOne & two link.\n\n  • a\n  • b"
    assert decode("é".encode("latin-1")) == "é"
    assert decode("<meta charset=windows-1251>Да".encode("cp1251")).endswith("Да")
    rows = spark.createDataFrame([(page,), (None,), ("",)], "h STRING").select(html_to_text("h").alias("t")).collect()
    assert [r.t for r in rows] == [extract(page), None, ""]


def record(kind, body, uri=b"http://x.test/", length=None):
    return b"WARC/1.0\r\nWARC-Type: " + kind + b"\r\nWARC-Target-URI: " + uri + b"\r\nWARC-Date: 2024-01-02T03:04:05Z\r\nContent-Type: text/plain\r\nContent-Length: " + (length or str(len(body)).encode()) + b"\r\n\r\n" + body + b"\r\n\r\n"


def test_warc_source(spark, tmp_path):
    raw = record(b"warcinfo", b"software: x") + record(b"conversion", "é body".encode() + b"\xff") + record(b"response", b"<html>")
    (tmp_path / "a.warc.wet.gz").write_bytes(gzip.compress(raw[:200]) + gzip.compress(raw[200:]))
    (tmp_path / "b.warc").write_bytes(record(b"conversion", b"lost", length=b"many") + raw + b"WARC/1.0\r\nContent-Length: 99\r\n\r\ncut")
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(raw * 50)[:-40])
    (tmp_path / "d.warc.gz").write_bytes(b"\x1f\x8bnothing of the kind")
    warc.register(spark)
    df = spark.read.format("warc").option("path", str(tmp_path)).load()
    first = df.where("file like '%a.warc%' or file like '%b.warc'")
    assert first.where("record_type <> 'broken'").count() == 6
    got = warc.conversions(first).select("text", "target_uri", F.col("date").cast("string").alias("d")).distinct().collect()
    assert [tuple(r) for r in got] == [("é body\ufffd", "http://x.test/", "2024-01-02 03:04:05")]
    broken = {(r.file[-9:], r.error.split(":")[0]) for r in df.where("record_type = 'broken'").select("file", "error").collect()}
    assert {e.split(" at ")[0] for f, e in broken if f.endswith("b.warc")} == {"no content length", "cut off"}
    assert {f for f, _ in broken if "gz" in f} == {"c.warc.gz", "d.warc.gz"}
    one_file = spark.read.format("warc").option("path", f"file://{tmp_path}/a*.gz").load()
    assert one_file.count() == 3
    assert spark.read.format("warc").option("path", str(tmp_path / "none")).load().count() == 0


PAGE = b"<html><body><h1>Head</h1><p>" + b"A paragraph of some length stands here. " * 4 + b"</p></body></html>"


def test_responses_to_text(spark, tmp_path):
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    chunked = b"".join(b"%x\r\n" % len(c) + c + b"\r\n" for c in (PAGE[:50], PAGE[50:])) + b"0\r\n\r\n"
    bodies = [
        head + b"\r\n" + PAGE,
        head + b"Content-Encoding: gzip\r\n\r\n" + gzip.compress(PAGE),
        head + b"Transfer-Encoding: chunked\r\n\r\n" + chunked,
        head + b"Transfer-Encoding: chunked\r\n\r\n" + PAGE,
        b"HTTP/1.1 200 OK\r\nContent-Type: application/json\r\n\r\n{}",
        head + b"\r\n<p>short</p>",
        b"no head at all",
        b"",
    ]
    raw = b"".join(record(b"response", b, b"http://x.test/%d" % n) for n, b in enumerate(bodies)) + record(b"conversion", b"plain text " * 20, b"http://x.test/c") + record(b"request", PAGE)
    (tmp_path / "r.warc").write_bytes(raw)
    warc.register(spark)
    archive = spark.read.format("warc").option("path", str(tmp_path)).load()
    got = {r.target_uri[-1]: r.text for r in warc.response_texts(archive).collect()}
    assert set(got) == set("0123c") and len({got[k] for k in "0123"}) == 1 and got["0"].startswith("Head\n\nA paragraph")
    assert warc.response_texts(archive, limit=2).count() == 2 and warc.response_texts(archive, least=3).count() == 6


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n\n\n\n three \n\n")
    assert [r.text for r in files.read_blocks(spark, str(tmp_path / "a.txt")).collect()] == ["one\ntwo", "three"]
    assert files.read_whole(spark, str(tmp_path / "a.txt")).first().text.startswith("one")
    assert files.read_lines(spark, str(tmp_path / "a.txt")).count() == 7
    line = "x &lt;ref&gt [http://a.test/b see] and https://c.test. &lt;/ref&gt;"
    assert one(spark, line, files.reference_urls) == ["http://a.test/b", "https://c.test"]
    # the whole reference is searched: an address may run into its closing mark
    assert one(spark, "&lt;ref&gt http://a.test/b&lt;/ref&gt;", files.reference_urls) == ["http://a.test/b&lt"]
    with gzip.open(tmp_path / "p.gz", "wt") as f:
        f.write("b/x.gz\na/y.gz\n\n")
    assert [r.wet_path for r in files.read_paths(spark, str(tmp_path / "p.gz")).collect()] == ["b/x.gz", "a/y.gz"]
    with gzip.open(tmp_path / "u.gz", "wt") as f:
        f.write(" http://a.test \nftp://b.test\n\nhttps://c.test\n")
    assert [r.url for r in files.read_urls(spark, str(tmp_path / "u.gz")).collect()] == ["http://a.test", "https://c.test"]
    page = '<a href="s2.gz">s2</a><a href="s1.gz">s1</a><a href="s2.gz">again</a>'
    assert one(spark, page, lambda c: files.index_names(c, 'href="(s[0-9]\\.gz)"')) == ["s1.gz", "s2.gz"]
    got = files.catalogue(spark.createDataFrame([(f"p{i:02d}",) for i in range(10)] + [("p03",), (None,)], "path STRING")).collect()
    assert sorted((r.n, r.path, r.chunk) for r in got) == [(i, f"p{i:02d}", i // 4) for i in range(10)]


def test_storage_lists_sorted(tmp_path):
    for n in ("b/x.gz", "a/y.gz", "a/z.txt", "a/.hidden", "a/_SUCCESS"):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_text("")
    names = lambda p: [x.removeprefix(f"file://{tmp_path}/").removeprefix(f"{tmp_path}/") for x in storage.found(p)]
    assert names(f"{tmp_path}/a") == ["a/y.gz", "a/z.txt"]
    assert names(f"file://{tmp_path}/*/*.gz") == ["a/y.gz", "b/x.gz"]
    assert names(f"{tmp_path}/b/x.gz,{tmp_path}/a,{tmp_path}/none") == ["a/y.gz", "a/z.txt", "b/x.gz"]


def test_token_stream_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(3, "c"), (1, "hello world"), (2, None)], "doc_id BIGINT, text STRING")
    ids = {r.doc_id: r.ids for r in tokens.tokenized(df).collect()}
    folder = tmp_path / "s"
    parts = tokens.write_stream(tokens.tokenized(df), str(folder)).collect()
    assert sum(p.n_tokens for p in parts) == sum(map(len, ids.values())) == tokens.totals(tokens.tokenized(df)).first().tokens
    got = [x for r in tokens.read_stream(spark, str(folder)).orderBy("part").collect() for x in r.ids]
    assert got == ids[1] + ids[2] + ids[3]
    before = sorted(p.name for p in folder.iterdir())
    with pytest.raises(Exception, match="16 bits"):
        tokens.write_stream(spark.createDataFrame([(1, [65536])], "doc_id BIGINT, ids ARRAY<INT>"), str(folder))
    assert sorted(p.name for p in folder.iterdir()) == before  # a failed job leaves nothing and removes nothing
    tokens.write_stream(spark.createDataFrame([(1, [0, 65535])], "doc_id BIGINT, ids ARRAY<INT>"), str(folder))
    assert [r.ids for r in tokens.read_stream(spark, str(folder)).collect()] == [[0, 65535]]


def test_a_missing_vocabulary_fails(spark):
    df = spark.createDataFrame([(1, "é")], "doc_id BIGINT, text STRING")
    with pytest.raises(OSError):
        tokens.tokenized(df, path="/nowhere/vocabulary")
    assert tokens.tokenized(df, path=None).first().ids == [*"é".encode(), tokens.END_OF_TEXT]


def test_text_files_per_input(spark, tmp_path):
    rows = [("in/x.warc.wet.gz", " a\nb \u3000\n", 2), ("in/x.warc.wet.gz", "first", 1), ("in/y.txt", " \n ", 1), ("in/y.txt", None, 2)]
    tokens.write_texts(spark.createDataFrame(rows, "file STRING, text STRING, n INT"), str(tmp_path / "t"), order="n")
    assert {p.name: p.read_text() for p in (tmp_path / "t").iterdir() if p.suffix == ".txt"} == {"x.txt": "first\n\na\nb\n\n"}
    tokens.write_urls(spark.createDataFrame([("http://a.test",), (None,)], "url STRING"), str(tmp_path / "u"))
    assert [r.url for r in files.read_urls(spark, str(tmp_path / "u")).collect()] == ["http://a.test"]


def test_archives_are_written_and_read(spark, tmp_path):
    rows = [("http://a.test", datetime(2024, 1, 2, 3, 4, 5), bytearray("é\r\n".encode()), "one.warc.wet.gz"), (None, None, None, "two.warc.wet.gz")]
    tokens.write_archive(spark.createDataFrame(rows, "target_uri STRING, date TIMESTAMP, payload BINARY, f STRING"), str(tmp_path / "w"), "f")
    got = warc.conversions(spark.read.format("warc").option("path", str(tmp_path / "w")).load()).orderBy("file").collect()
    assert [(r.target_uri, r.text, r.file[-15:]) for r in got] == [("http://a.test", "é\r\n", "one.warc.wet.gz"), (None, "", "two.warc.wet.gz")]
    assert got[0].date == datetime(2024, 1, 2, 3, 4, 5)


def contents(folder):
    return {p.name: p.read_text() for p in folder.iterdir() if p.is_file() and not p.name.startswith((".", "_", "manifest"))}


def test_folders_without_repeated_lines(spark, tmp_path):
    given = {"a.txt": "menu\nsame\n", "b.txt": "menu\nsame\n", "c.txt": "- home\r\n- back\r\nown text\r\n", "d.txt": "- home\nmine\nlast", "e.txt": "alone\n\nhere\n"}
    (tmp_path / "in").mkdir()
    for n, t in given.items():
        (tmp_path / "in" / n).write_bytes(t.encode())
    folders.dedup_lines(spark, str(tmp_path / "out"), str(tmp_path / "in"))
    assert contents(tmp_path / "out") == {"a.txt": "", "b.txt": "", "c.txt": "- back\nown text\n", "d.txt": "mine\nlast", "e.txt": "alone\n\nhere\n"}


def test_folders_without_near_duplicates(spark, tmp_path):
    words = [f"term{i}" for i in range(160)]
    given = {"x.txt": " ".join(words), "y.txt": " ".join([*words[:150], "other", *words[151:]]).upper(), "z.txt": " ".join(words[::-1])}
    (tmp_path / "in").mkdir()
    for n, t in given.items():
        (tmp_path / "in" / n).write_text(t)
    folders.dedup_fuzzy(spark, str(tmp_path / "out"), str(tmp_path / "in"), k=500, b=50)
    assert contents(tmp_path / "out") == {n: given[n] for n in ("x.txt", "z.txt")}


def test_english_archives(spark, tmp_path):
    english, german = b"the mill of the town was near the river", "die Mühle der Stadt war nahe dem Fluss".encode()
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "m.warc.wet.gz").write_bytes(gzip.compress(record(b"warcinfo", b"x") + record(b"conversion", english) + record(b"conversion", german)))
    (tmp_path / "in" / "g.warc.wet.gz").write_bytes(gzip.compress(record(b"conversion", german)))
    model = naive_bayes.fit(spark.createDataFrame([(english.decode(), "en"), (german.decode(), "de")], "text STRING, label STRING"), {"label": ["de", "en"]})["label"]
    folders.english_archives(spark, str(tmp_path / "out"), str(tmp_path / "in"), model)
    assert [p.name for p in (tmp_path / "out").glob("*.gz")] == ["m.warc.wet.gz"]
    got = warc.conversions(spark.read.format("warc").option("path", str(tmp_path / "out")).load()).collect()
    assert [(r.text, r.target_uri) for r in got] == [(english.decode(), "http://x.test/")]


def test_command_lines(spark, tmp_path, capsys):
    long = "The quiet river town kept its old mill and the people were glad. " * 6
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc.wet.gz").write_bytes(gzip.compress(record(b"conversion", f"{long}write to a@b.org".encode()) + record(b"conversion", b"few")))
    (tmp_path / "in" / "b.warc.wet.gz").write_bytes(gzip.compress(record(b"conversion", b"few")))
    cli(["filter", "--input-dir", str(tmp_path / "in"), "--output-dir", str(tmp_path / "out")], spark)
    assert [p.name for p in (tmp_path / "out").glob("*.txt")] == ["a.txt"] and "EMAIL_ADDRESS" in (tmp_path / "out" / "a.txt").read_text()
    assert "rules" in capsys.readouterr().out
    cli(["tokenize", "--input-dir", str(tmp_path / "out"), "--output-path", str(tmp_path / "tok")], spark)
    assert int(capsys.readouterr().out.split()[0]) > 50
    (tmp_path / "list").write_text("\n".join(f"p{i}" for i in range(9)))
    cli(["paths", "--list", str(tmp_path / "list"), "--output-dir", str(tmp_path / "urls"), "--n-files", "3", "--base", "http://h.test/"], spark)
    assert files.read_urls(spark, str(tmp_path / "urls")).count() == 3


def test_tables_are_kept_by_configuration(spark, tmp_path):
    made = []
    build = lambda: made.append(1) or spark.range(3).toDF("x")
    for config in ({"a": 1}, {"a": 1}, {"a": 2}):
        assert materialised(spark, str(tmp_path), "t", config, build).count() == 3
    assert len(made) == 2


def test_first_seen_on_a_stream(spark, tmp_path):
    rows = [("same", datetime(2024, 1, 1)), ("same", datetime(2024, 1, 1, 0, 1)), ("other", datetime(2024, 1, 1))]
    spark.createDataFrame(rows, "text STRING, t TIMESTAMP").write.parquet(str(tmp_path / "in"))
    q = first_seen(spark.readStream.schema("text STRING, t TIMESTAMP").parquet(str(tmp_path / "in")), "t").writeStream.format("memory").queryName("seen_out").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.text for r in spark.sql("select text from seen_out").collect()) == ["other", "same"]


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(1, "word " * 60 + "a@b.org"), (2, "few words"), (3, None)], "doc_id BIGINT, text STRING")
    df.write.parquet(str(tmp_path / "in"))
    batch = {tuple(r) for r in ruled_and_masked(spark.read.parquet(str(tmp_path / "in"))).collect()}
    q = ruled_and_masked(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("rows_out").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {tuple(r) for r in spark.sql("select * from rows_out").collect()} == batch and len(batch) == 1


def test_sql_functions(spark):
    model = naive_bayes.fit(spark.createDataFrame([("good words", "ok"), ("foul day", "no")], "text STRING, label STRING"), {"label": ["ok", "no"]})["label"]
    register(spark, {"tone": model})
    assert spark.sql("SELECT mask_phones('call 283-182-3829') AS x").first().x == "call |||PHONE_NUMBER|||"
    assert spark.sql("SELECT mask_all('a@b.org 192.0.2.1') AS x").first().x == "|||EMAIL_ADDRESS||| |||IP_ADDRESS|||"
    assert spark.sql("SELECT classify_tone('Good').label AS x").first().x == "ok"
    texts = ["word " * 50, "word " * 49, "", None, "ab " * 60, "\n".join(["word " * 20 + "..."] * 4 + ["word " * 20] * 6), "word " * 79 + "12 " * 21]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, text STRING").createOrReplaceTempView("some_texts")
    got = {r.i: (r.x, r.y) for r in spark.sql("SELECT i, quality_drop_reason(text) AS x, passes_quality_rules(text) AS y FROM some_texts").collect()}
    want = {r.i: (r.drop_reason, r.keep) for r in quality_rules.rules(spark.table("some_texts")).collect()}
    assert got == want
    assert spark.sql("SELECT clean_text(' a\\nb ') AS x, strip_text(' c ') AS y").first()[:] == ("a b", "c")


def test_hot_buckets_are_split_and_lose_no_pair(spark, monkeypatch):
    """Many different texts of one template share their buckets; blocks of three still verify every pair."""
    monkeypatch.setattr(minhash, "BLOCK", 3)
    base = [f"w{i}" for i in range(200)]
    docs = [(i, " ".join([*base, f"own{i}"])) for i in range(30)] + [(100, None)]
    pairs, _ = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id BIGINT, text STRING"))
    assert {(r.id_a, r.id_b) for r in pairs.collect()} == {(a, b) for a in range(30) for b in range(a + 1, 30)}


def test_banding_finds_what_all_pairs_find(spark):
    rng = random.Random(9)
    docs, words = [], [f"v{i}" for i in range(3000)]
    for i in range(60):
        base = [rng.choice(words) for _ in range(150)]
        docs.append((3 * i, base))
        for k in (1, 2):
            near = list(base)
            for _ in range(rng.randrange(1, 6)):
                near[rng.randrange(150)] = rng.choice(words)
            docs.append((3 * i + k, near))
    grams = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for k, w in docs}
    want = {(a, b) for a in grams for b in grams if a < b and len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])}
    pairs, _ = minhash.near_duplicates(spark.createDataFrame([(k, " ".join(w)) for k, w in docs], "doc_id BIGINT, text STRING"))
    got = {(r.id_a, r.id_b) for r in pairs.collect()}
    assert got <= want and len(got) >= 0.97 * len(want) > 30


def _edges(rng, n):
    """Texts of which some are just at, some just above and some just below a similarity of 0.8; some are short, some share a footer."""
    docs, words = [], [f"v{i}" for i in range(4000)]
    footer = [f"f{i}" for i in range(30)]
    for i in range(n):
        base = [rng.choice(words) for _ in range(rng.choice([5, 6, 8, 13, 49, 94, 150]))] + footer * (i % 3 == 0)
        docs.append(base)
        for cut in (1, 2, 3):
            docs.append(base[: len(base) - cut])
        for changes in (1, 2, 3, 4):
            near = list(base)
            for _ in range(changes):
                near[rng.randrange(len(near))] = rng.choice(words)
            docs.append(near)
    rng.shuffle(docs)
    return list(enumerate(docs))


def _unbanded():
    """Two texts with a similarity of 0.8 that share no band of MinHash."""
    one, low = minhash._sets(5), minhash.minima(minhash.HASHES)
    for i in range(100_000):
        words = [f"u{i}x{k}" for k in range(13)]
        sides = [[f"left{i}", *words[1:]], [f"right{i}", *words[1:]]]  # of 9 shingles each, 8 are common
        a, b = (minhash._buckets(low(one(" ".join(x))), minhash.BANDS) for x in sides)
        if not (a == b).any():
            return sides
    raise AssertionError("none found")


def test_similar_pairs_leave_none_out(spark, tmp_path):
    """All pairs at the threshold, also those that no band of MinHash shares; the same from the query and its SQL."""
    import duckdb

    docs = [*_edges(random.Random(4), 60), *zip((8000, 8001), _unbanded(), strict=True)]
    first: dict[frozenset, int] = {}
    for k, w in docs:
        first.setdefault(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)), k)
    sets = list(first.items())
    want = {tuple(sorted((a, b))) for i, (x, a) in enumerate(sets) for y, b in sets[:i] if x and y and 5 * len(x & y) >= 4 * len(x | y)}
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in docs] + [(9000, None), (9001, "")], "doc_id BIGINT, text STRING")
    banded = {(r.id_a, r.id_b) for r in minhash.near_duplicates(df)[0].collect()}
    assert banded < want
    df.write.parquet(str(tmp_path / "documents.parquet"))
    rows = core.near_duplicate_pairs(spark, str(tmp_path)).collect()
    assert len(rows) == len(want) > 200 and {(r.id_a, r.id_b) for r in rows} == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(con.execute(core.SQL["near_duplicate_pairs"]).fetchall()) == sorted(map(tuple, rows))


def test_similar_pairs_of_hot_shingles_and_of_no_texts(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 3)
    base = [f"w{i}" for i in range(200)]
    df = spark.createDataFrame([(i, " ".join([*base, f"own{i}"])) for i in range(30)] + [(40, " ".join([*base, "own3"]))], "doc_id BIGINT, text STRING")
    assert sorted((r.id_a, r.id_b) for r in similar.similar_pairs(df).collect()) == [(a, b) for a in range(30) for b in range(a + 1, 30)]
    assert similar.similar_pairs(df.limit(0)).count() == 0


def test_membership_is_read_where_the_sets_are(spark):
    """The sets are shuffled once; who represents whom takes no join of the sets with themselves."""
    df = spark.createDataFrame([(i, f"the same few words stand in these {i % 2}") for i in range(6)], "doc_id BIGINT, text STRING")
    rep = minhash.near_duplicates(df)[1]
    assert "Join" not in rep._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in rep.collect()} == {(i, i % 2) for i in range(6)}


def test_seeded_choice_of_a_class(spark):
    df = spark.createDataFrame([(i, "the same few words stand in all of these") for i in range(20)], "doc_id BIGINT, text STRING")
    kept = {seed: [r.doc_id for r in minhash.dedup(df, seed=seed).collect()] for seed in (None, 1, 2, 3)}
    assert kept[None] == [0] and all(len(v) == 1 for v in kept.values()) and len({v[0] for v in kept.values()}) > 1


def test_signature_is_the_minimum_per_hash(spark):
    hashes = [5, 77, 123456]
    got = spark.createDataFrame([([h << 31 for h in hashes],), ([],), (None,)], "h ARRAY<BIGINT>").select(minhash.signature(7)("h").alias("s")).collect()
    want = [min((a * h + b) % minhash.PRIME for h in hashes) for a, b in minhash.coefficients(7)]
    assert [list(r.s) for r in got] == [want, [0] * 7, [0] * 7] and np.all(np.array(want) >= 0)
