"""The text operators: border cases that each must take, and small truths."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("textloom.llm")
from textloom.llm import abuse, boilerplate, language, leakage, mixture, mojibake, pii, repetition, text_form  # noqa: E402

SENTENCES = {
    "en": ["The old mill was near the river and the miller knew it.", "Nobody could say when the storm would come to the town.", "She wrote a long letter to the council about the bridge.", "In the morning the children walked to school with their teacher."],
    "de": ["Die alte Mühle stand am Fluss und der Müller wusste es.", "Niemand konnte sagen, wann der Sturm in die Stadt kommt.", "Sie schrieb einen langen Brief an den Rat über die Brücke.", "Am Morgen gingen die Kinder mit ihrer Lehrerin zur Schule."],
    "fr": ["Le vieux moulin était près de la rivière et le meunier le savait.", "Personne ne pouvait dire quand la tempête viendrait dans la ville.", "Elle écrivit une longue lettre au conseil à propos du pont.", "Le matin, les élèves allaient à l'école avec leur maîtresse."],
    "ru": ["Старая мельница стояла у реки, и мельник знал это.", "Никто не мог сказать, когда буря придёт в город.", "Она написала длинное письмо совету о мосте.", "Утром дети шли в школу вместе с учительницей."],
}
WORDS = {"en": "the of and to in was a", "de": "die der und in den das zu", "fr": "de la le et les des à", "ru": "в и не на с что у"}
EMPTY = [None, "", "  \n ", "!"]


@pytest.fixture(scope="module")
def tables(spark):
    samples = spark.createDataFrame([(i, c, t) for c, ts in SENTENCES.items() for i, t in enumerate(ts)], "sample_id BIGINT, lang STRING, text STRING")
    common = spark.createDataFrame([(c, w, i) for c, ws in WORDS.items() for i, w in enumerate(ws.split())], "lang STRING, word STRING, word_rank INT")
    return samples, common


def frame(spark, texts, start=1):
    """With extra columns whose names the operators also use inside."""
    rows = [(start + i, t, "kept", 1, None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id BIGINT, text STRING, k STRING, c0 INT, votes STRING")


def all_samples():
    return [t for ts in SENTENCES.values() for t in ts]


@pytest.mark.parametrize("wrong", ["cp1252", "latin-1", "cp437", "mac_roman", "cp1251"])
def test_encoding_round_trip(wrong):
    cost = mojibake.CostModel(all_samples())
    for text in SENTENCES["de"][:1] + SENTENCES["fr"]:
        try:
            bad = text.encode("utf-8").decode(wrong)
        except UnicodeDecodeError:
            continue
        fixed, lines = mojibake.repair_payload("plain\n" + bad, cost)
        assert fixed == "plain\n" + text and lines == [1]
        assert mojibake.repair_payload(text, cost) == (text, [])


def test_encoding_layers_and_losses():
    cost = mojibake.CostModel(all_samples())
    twice = "à la rivière près".encode().decode("cp1252", "replace").encode().decode("cp1252", "replace")
    assert mojibake.repair_payload(twice, cost)[1] == [0]
    assert mojibake.repair_payload("caf� au lait", cost) == ("caf� au lait", [0])
    russian = SENTENCES["ru"][0].encode("koi8-r").decode("cp1251")
    assert mojibake.repair_payload(russian, cost)[0] == SENTENCES["ru"][0]


def test_encoding_frames(spark, tables):
    bad = SENTENCES["fr"][0].encode().decode("cp1252")
    df = frame(spark, [bad, bad, *EMPTY, "plain"])
    got = mojibake.garbled_records(df.unionByName(df), tables[0], "doc_id", "text")
    assert sorted(r.doc_id for r in got.collect()) == [1, 2]
    assert mojibake.repair(df, tables[0], "doc_id", "text").where("doc_id = 1").first().restored == SENTENCES["fr"][0]
    assert mojibake.garbled_records(df.limit(0), tables[0], "doc_id", "text").count() == 0


def test_leaks_equal_brute_force():
    rng = random.Random(1)
    vocab = [f"v{i}" for i in range(12)]
    stock = "Please answer the question below with one word."
    items = [(i, (f"{stock} " if i % 2 else "") + " ".join(rng.choice(vocab) for _ in range(30)) + ".") for i in range(12)]
    docs = []
    for _ in range(60):
        w = [rng.choice(vocab) for _ in range(80)]
        own = rng.choice(items)[1].split()
        a, n = rng.randrange(len(own) - 12), rng.randrange(5, 12)
        w[10 : 10 + n] = own[a : a + n]
        docs.append(" ".join(w))
    vocabulary, automata, keys, _ = leakage._build(items, 8)
    own = leakage.own_words(items)
    windows = Counter(k for _, w in own for k in {tuple(w[i : i + 8]) for i in range(len(w) - 7)})
    for d in docs:
        w = leakage.words(d)
        mine = {tuple(w[i : i + 8]) for i in range(len(w) - 7)}
        want = {i for i, ws in own for k in range(len(ws) - 7) if (g := tuple(ws[k : k + 8])) in mine and windows[g] == 1}
        got = {keys[s[0]] for a in automata for s in a.spans([vocabulary.get(x) for x in w])}
        assert got == want
    assert all(not " ".join(w).startswith("please answer") for _, w in own)


def test_own_words_are_not_stock(spark):
    """Shared initials and figures at the beginning and copies of one item's row leave its own words in."""
    starts = [f"According to the U.S. {x}" for x in ("census of that year most people lived near rivers", "code a mill may be closed by its town", "army the bridge was lost in one night")]
    figures = [f"It takes a keeper about 3.5 {x}" for x in ("hours to wind up the clock tower", "days to walk to the northern lighthouse", "weeks to mend one old fishing net")]
    texts = starts + figures
    own = leakage.own_words(list(enumerate(texts)))
    assert [w for _, w in own] == [leakage.words(t) for t in texts]
    bench = spark.createDataFrame([(9, starts[0]), (9, starts[0]), (9, starts[0]), (8, figures[0])], "item_id BIGINT, text STRING")
    rows = leakage.leaks(spark.createDataFrame([(1, f"So {starts[0]}, they say.")], "doc_id BIGINT, text STRING"), bench).collect()
    assert [tuple(r) for r in rows] == [(9, 1, 1, 14, 1.0)]


def test_leaks_ignore_writing(spark):
    item = "The quick brown fox doesn't jump over nine lazy dogs today"
    texts = ["x THE  QUICK, brown\nfox doesnt jump over-nine lazy dogs! y", "the quick brown fox jumped over nine", *EMPTY]
    bench = spark.createDataFrame([(9, item), (10, None), (11, "short")], "item_id BIGINT, text STRING")
    assert [tuple(r) for r in leakage.leaked_pairs(frame(spark, texts), bench).collect()] == [(9, 1)]
    clean = {r.doc_id: r.clean for r in leakage.decontaminated(frame(spark, texts), bench).collect()}
    assert clean[1] == "x ! y" and clean[2] == texts[1] and clean[3] is None and clean[4] == ""


PROSE = "The old mill was near the river and the miller knew it. Nobody in the town could say when the storm would come to them. It was a cold day and the people of the town went to the market. "


@pytest.mark.parametrize(
    ("text", "form"),
    [
        (PROSE * 3, "prose"),
        ("A title\n\n" + PROSE, "prose"),
        ("\n".join(f"- old mill {i}" for i in range(9)), "list"),
        ("\n".join(f"{i}. old river" for i in range(1, 9)), "list"),
        ("| a | b | c |\n" + "\n".join(f"| x{i} | {i}.5 | 19{i:02d} |" for i in range(9)), "table"),
        ("name,price,year\n" + "\n".join(f"mill,{i}.25,19{i:02d}" for i in range(9)), "table"),
        ("=/$~\\+#!%$.\n_\\_|=!%<<\\$$ \\>\\\\+\n>|#~~!#^*" * 5, "junk"),
        ("\n".join("QVZ3a29Xb2RrZmpFd0s4ZkpXa2xTZGpma0xLSkRsa2pmbDNrNA" for _ in range(6)), "junk"),
    ],
)
def test_forms(text, form):
    common = frozenset(" ".join(WORDS.values()).split()) | frozenset("it would they them could when knew near".split())
    letters = text_form.Letters(all_samples())
    votes = text_form.votes(text, text_form.statistics(text, common), common, letters)
    assert text_form.posterior_maps([(votes, 5), ("0" * 10 + "1111", 50)])[0][votes] == form


def test_forms_frames(spark, tables):
    df = frame(spark, [PROSE, *EMPTY, PROSE * 300])
    got = {r.doc_id: r for r in text_form.text_forms(df, tables[1], all_samples()).collect()}
    assert got[2].form is None and got[3].n_words == 0 and got[4].form is None and got[6].form == "prose"
    assert text_form.text_forms(df.limit(0), tables[1], all_samples()).count() == 0


def test_every_function_votes(spark, tables):
    """Prose, too, gets the votes of all functions, not those that prose usually has."""
    common = frozenset(" ".join(WORDS.values()).split()) | frozenset("it would they them could when knew near".split())
    letters = text_form.Letters(all_samples())
    text = PROSE + "v1.2.x-3 4.5 6.7 8,9 10:11 12 13 14 15 16 17 18 19 20."
    got = text_form.votes(text, text_form.statistics(text, common), common, letters)
    assert len(got) == 14 and got[10:12] == "11" and got[13] == "0"


def test_statistics():
    assert text_form.statistics("The mill.\nno end, x", frozenset(["the"])) == (5, 13 / 5, 2 / 15, 0.5, 0.2)


def test_languages(spark, tables):
    model = language.load(*tables)
    mixed = f"{SENTENCES['en'][0]} {SENTENCES['en'][1]}\n\n{SENTENCES['ru'][1]} {SENTENCES['ru'][2]}"
    texts = [SENTENCES["de"][0], SENTENCES["fr"][1] + " " + SENTENCES["fr"][2], mixed, *EMPTY, "⠞⠺▧┢ ▲⠇"]
    labels = ["DE_at", "en", "en", "en", None, "und", "xx", "en"]
    df = spark.createDataFrame([(i, t, c, 5) for i, (t, c) in enumerate(zip(texts, labels))], "doc_id BIGINT, text STRING, lang STRING, found_lang INT")
    got = sorted((r.doc_id, r.found_lang) for r in language.mislabelled(df, model).collect())
    assert got == [(1, "fr"), (2, "en"), (2, "ru")]
    seg = [r for r in language.segments(df, model).collect() if r.doc_id == 2]
    assert [s.found_lang for s in sorted(seg, key=lambda s: s.segment)] == ["en", "ru"]
    assert language.mislabelled(df.limit(0), model).count() == 0


def test_remembered_words_start_clean():
    model = language.train([(c, t) for c, ts in SENTENCES.items() for t in ts], [(c, w) for c, ws in WORDS.items() for w in ws.split()])
    want = model.words(["banana", "river"]).copy()
    other = language.train([(c, t) for c, ts in SENTENCES.items() for t in ts], [(c, w) for c, ws in WORDS.items() for w in ws.split()])
    other.REMEMBERED = 1
    other.words(["the", "of", "und"])
    assert (other.words(["banana", "river"]) == want).all()


@pytest.mark.parametrize(("label", "code"), [("en-US", "en"), ("English", "en"), ("deu", "de"), ("pt_BR", "pt"), ("zh-Hans", "zh"), ("und", None), ("", None), (None, None), ("unknown", None), (" FR ", "fr")])
def test_label_codes(label, code):
    assert language.label_code(label) == code


def test_repeated_words_equal_brute_force():
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcde") for _ in range(rng.randrange(0, 60))) for _ in range(80)] + [None, "", "one two three four. One, two THREE four!", "x 1 y 2 x 9 y 8"]
    tokens = repetition.Tokens(repetition.Vocabulary({}), texts)
    got = repetition.repeated_words(tokens)
    for t, n in zip(texts, got, strict=True):
        w = ["0" if x.isdigit() else x for x in re.findall(r"[^\W\d_]+|\d+", (t or "").lower())]
        seen, mark = set(), set()
        for i in range(len(w) - 3):
            g = tuple(w[i : i + 4])
            mark |= set(range(i, i + 4)) if g in seen else set()
            seen.add(g)
        assert n == len(mark)


def test_repetitive_documents(spark, tables):
    rng = random.Random(4)
    usual = WORDS["en"].split() + [a + b + c for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    varied = [" ".join(rng.choice(usual) for _ in range(150)) for _ in range(30)]
    phrase = "the mill of the old town was near "
    df = frame(spark, [*varied, phrase * 20, *EMPTY])
    assert [r.doc_id for r in repetition.repetitive(df, tables[1], all_samples()).collect()] == [31]
    rows = {r.doc_id: r for r in repetition.repetition(df, tables[1]).collect()}
    assert rows[32].repeated_share == 0 and rows[32].perplexity is None and rows[31].repeated_share > 0.9
    assert repetition.repetition(df.limit(0), tables[1]).count() == 0


def _fitted(spark, texts, parts, **k):
    return repetition.fit(spark.createDataFrame([(t,) for t in texts], "text STRING").repartition(parts), **k)


def test_trigram_model_is_the_same_for_any_partitions(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcdefgh") * rng.choice((1, 2)) for _ in range(40)) for _ in range(50)] + EMPTY
    for size in (1 << 20, 64):
        one, four = (_fitted(spark, texts, n, size=size) for n in (1, 4))
        for a, b in zip(one.grams + one.contexts, four.grams + four.contexts, strict=True):
            assert (a.keys == b.keys).all() and (a.values == b.values).all()
            assert len(a.keys) <= size
    tokens = repetition.Tokens(repetition.Vocabulary({}), texts)
    assert (one.probability(tokens) == four.probability(tokens)).all()


@pytest.mark.parametrize("size", [1 << 20, 40])
def test_trigram_probabilities_add_up(spark, size):
    rng = random.Random(7)
    words = [a + b for a in "bdfg" for b in "aeiou"]
    texts = [" ".join(rng.choice(words[: rng.randrange(3, 20)]) for _ in range(30)) for _ in range(60)]
    model = _fitted(spark, texts, 3, size=size)
    vocab = repetition.Vocabulary({})
    for u, v in (("ba", "be"), ("da", "zz"), ("zz", "yy")):
        tokens = repetition.Tokens(vocab, [f"{u} {v} {w}" for w in [*words, "unseen"]])
        p = model.probability(tokens)[2::3]
        assert np.isclose(p[:-1].sum() + p[-1] * (1 / model.unseen - len(words)), 1, atol=1e-5)


def test_scores_leave_no_trigram_out(spark, tables, monkeypatch):
    """Scores come from all n-grams, however few of all counts one has, and are the same for any partitions."""
    rng = random.Random(8)
    words = [a + b for a in "bdfgk" for b in "aeiou"]
    texts = [" ".join(rng.choice(words[: rng.randrange(3, 25)]) for _ in range(40)) for _ in range(60)] + ["ba be ba be ba be", *EMPTY]
    model = _fitted(spark, texts, 2, size=1 << 20)
    tokens = repetition.Tokens(repetition.Vocabulary({}), texts)
    plain = tokens.per_text(-np.log(model.probability(tokens))) / np.maximum(tokens.sizes, 1)
    monkeypatch.setattr(repetition.fit, "__defaults__", ("text", 16))
    runs = []
    for parts in (1, 5):
        rows = repetition.scored(frame(spark, texts).repartition(parts), tables[1]).collect()
        runs.append({r.doc_id: (r.n_words, r.surprisal, r.plain_surprisal, r.repeated_share) for r in rows})
        assert len(rows) == len(texts)
    assert runs[0] == runs[1]
    for n, (size, value) in enumerate(zip(tokens.sizes, plain, strict=True), 1):
        assert runs[0][n][0] == size and (np.isclose(runs[0][n][2], value, atol=1e-6) if size else runs[0][n][2] is None)
    assert runs[0][61][1] < runs[0][61][2]


def _shuffled(spark):
    """Rows written to shuffles so far."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty(30_000)
    stages = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(n).shuffleWriteRecords() for n in range(stages.size()))


def test_trigrams_are_shuffled_once(spark, tables):
    rng = random.Random(9)
    words = [a + b for a in "bdfgk" for b in "aeiou"]
    df = frame(spark, [" ".join(rng.choice(words) for _ in range(100)) for _ in range(150)]).repartition(1).persist()
    texts = [["<", "<", *r.text.split()] for r in df.collect()]
    trigrams = len({g for w in texts for g in zip(w, w[1:], w[2:], strict=False)})
    setting = "spark.sql.autoBroadcastJoinThreshold"
    before, kept = spark.conf.get(setting), spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition")
    spark.conf.set(setting, "-1")  # as with tables too large to broadcast
    try:
        start = _shuffled(spark)
        repetition.scored(df, tables[1]).unpersist()
        rows = _shuffled(spark) - start
    finally:
        spark.conf.set(setting, before)
        df.unpersist()
    assert trigrams < rows < 2 * trigrams, (trigrams, rows)
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == kept


def test_blocks_count_trigrams_whose_hashes_begin_alike():
    """Trigrams that the order by parts of hashes mixes have several rows, of which the counts and the places add up."""
    u, v = np.zeros(5, np.uint64), np.ones(5, np.uint64)
    w = np.array([5, 6, 5, 6, 6], np.uint64)
    places = np.array([0, 0, 4, 2, 10], np.uint16)
    got, seen = Counter(), Counter()
    for batch in repetition._block(7, [(u, v, w, places)]):
        for r in batch.to_pylist():
            assert r["id"] == 7 and (r["u"], r["v"]) == (0, 1)
            got[r["w"]] += r["c"]
            seen.update((r["w"], x) for x in np.frombuffer(r["places"], np.uint16).tolist())
    assert got == {5: 2, 6: 1} and seen == Counter(zip(w.tolist(), places.tolist(), strict=True))


@pytest.mark.parametrize("docs", [3, 400])
def test_replies_add_up(docs):
    """Sums of surprisals by document, or the words' probabilities where the sums would be longer, give the same."""
    rng = random.Random(10)
    grams = [(block, [rng.randrange(docs) * 4 + rng.randrange(3) for _ in range(rng.randrange(1, 9))], rng.random()) for block in (0, 1 << 14, 1 << 33) for _ in range(100)]
    rng.shuffle(grams)
    batches = [pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*[(b, np.array(places, np.uint16).tobytes(), p) for b, places, p in part], strict=True), (pa.int64(), pa.binary(), pa.float64()), strict=True)], names=["id", "places", "p"]) for part in (grams[:170], grams[170:])]
    replies = list(repetition._replies(iter(batches)))
    rows = [r for x in replies for r in x.to_pylist()]
    assert len(rows) == 3 and all((r["p"] is None) == (docs == 3) for r in rows)
    own, plain = Counter(), Counter()
    for block, places, p in grams:
        for place in places:
            q = {2: repetition.CACHE + (1 - repetition.CACHE) * p, 1: (1 - repetition.CACHE) * p}.get(place & 3, p)
            own[block + place // 4] += round(-np.log(q) * repetition.UNIT)
            plain[block + place // 4] += round(-np.log(p) * repetition.UNIT)
    got = [r for x in repetition._added(iter(replies)) for r in x.to_pylist()]
    assert len(got) == len(own) and all(abs(r["own"] - own[r["id"]]) <= 64 and abs(r["plain"] - plain[r["id"]]) <= 64 for r in got)


def test_trigram_counts_equal_brute_force(spark):
    texts = ["a b c a b d", "a b c", "x a b c x a b c", "b c d e"]
    seen = Counter()
    for t in texts:
        w = ["<", "<", *t.split()]
        seen.update({tuple(w[i : i + 3]) for i in range(len(w) - 2)})
    got = repetition._summed([(np.zeros(1, np.uint64),) * 4 + (np.ones(1),)])
    assert got[4].tolist() == [1]
    rows = spark.createDataFrame([(t,) for t in texts], "text STRING").repartition(2).mapInArrow(repetition._count, "u BIGINT, v BIGINT, w BIGINT, c BIGINT")
    counts = sorted(r["sum(c)"] for r in rows.groupBy("u", "v", "w").sum("c").collect())
    assert counts == sorted(seen.values())


def test_main_content():
    rng = random.Random(5)
    pages = []
    for i in range(120):
        nav = [rng.choice(["Home", "Contact", "Shop", "Search"]) for _ in range(4)]
        body = [f"Notes on the mill {i}"] + [" ".join(rng.choice("river town mill stone keeper letter bridge".split()) for _ in range(25)) + "." for _ in range(4)]
        foot = ["Related articles", f"Notes on the mill {i + 7}", "Copyright 2020 Mill Group"]
        pages.append((nav + body + foot, [False] * 4 + [True] * 5 + [False] * 3))
    model = boilerplate.fit(pages[:90])
    wrong = sum(bad != [n for n, m in enumerate(main) if not m] for (_, bad), (_, main) in zip(boilerplate.main_lines(model, ["\n".join(p) for p, _ in pages[90:]]), pages[90:], strict=True))
    assert wrong <= 2
    assert boilerplate.main_lines(model, [None, "", " \n "]) == [([""], []), ([""], []), ([" ", " "], [])]


def test_html_regions(spark):
    page = "<nav><a>Home</a></nav><h1>Title here</h1><p>A long paragraph of text that says something.<div>Advertisement</div><footer>All rights</footer>"
    lines, main = boilerplate.html_main(page)
    assert [x for x, m in zip(lines, main) if m] == ["Title here", "A long paragraph of text that says something."]
    df = spark.createDataFrame([(1, page, 0), (2, None, 0), (3, "", 0)], "page_id BIGINT, html STRING, main INT")
    assert {r.page_id: r.main for r in boilerplate.html_content(df).collect()}[2] is None
    empty = boilerplate.fit(*boilerplate.training_pages(df.limit(0)))
    assert boilerplate.boilerplate_lines(df, empty, "page_id", "html").count() >= 0


def test_every_page_counts(spark):
    """The border and the line model learn from all pages, in whatever partitions they come."""
    own = ["".join(chr(97 + int(d)) for d in f"{n:04d}") for n in range(1600)]
    html = [f"<nav><a>Home</a></nav><p>{w} {'says the mill ' * (n % 9 + 3)}.</p><footer>{w}s</footer>" for n, w in enumerate(own)]
    df = spark.createDataFrame(list(enumerate(html)), "page_id BIGINT, html STRING")
    models = []
    for parts in (1, 5):
        models.append(boilerplate.fit(*boilerplate.training_pages(df.repartition(parts))))
    ratios = np.concatenate([boilerplate.tag_ratio(boilerplate.html_lines(h)) for h in html])
    assert abs(models[0].border - boilerplate.threshold(ratios, 100)) < 1e-6
    assert all(models[0].weights[boilerplate._hash(w)] for w in own)
    assert models[0].border == models[1].border and models[0].cut == models[1].cut
    assert (models[0].weights == models[1].weights).all() and all((a == b).all() for a, b in zip(models[0].layers, models[1].layers, strict=True))


ARTICLE = "The old mill was near the river and the miller knew it, although nobody in the town could say when the storm would come. " * 4


@pytest.mark.parametrize(
    ("page", "main"),
    [
        (f"<div><a>Home</a></div><div>{ARTICLE}</div><div>Advertisement</div><div>{ARTICLE}</div><div>Copyright 2020</div>", [ARTICLE.strip()] * 2),
        (f"<nav><ul><li>Home</li><li>Contact us</li><li>Search pages</li></ul></nav><h1>A title here</h1><p>{ARTICLE}</p><ul><li>one long item</li><li>two long items</li></ul><p>{ARTICLE}</p>", ["A title here", ARTICLE.strip(), "one long item", "two long items", ARTICLE.strip()]),
        (f"<table><tr><td>{ARTICLE}</td></tr></table><footer>{ARTICLE[:110]}</footer>", [ARTICLE.strip()]),
        ("<nav><a>Home</a><li><a>Shop</a></nav>", []),
        ("", []),
        ("<p>Only this one sentence stands here", ["Only this one sentence stands here"]),
    ],
)
def test_text_to_tag_ratio(page, main):
    lines, keep = boilerplate.html_main(page)
    assert [x for x, m in zip(lines, keep) if m] == main


def test_pages_of_records_decide(spark):
    """A line that nothing but its page's tags can place; a null page, a page without record and a second page change nothing."""
    payload = f"Riverside notes\n{ARTICLE}\nRiverside notes"
    html = f"<h1>Riverside notes</h1><p>{ARTICLE}</p><footer><a>Riverside notes</a></footer>"
    records = spark.createDataFrame([(1, payload, "x"), (1, payload, "x"), (2, None, "x"), (3, "", "y"), (None, payload, "y")], "record_id BIGINT, payload STRING, sides STRING")
    pages = spark.createDataFrame([(7, 1, html), (8, 1, f"<footer>{payload}</footer>"), (9, 2, None), (10, None, html), (11, 99, html)], "page_id BIGINT, record_id BIGINT, html STRING")
    model = boilerplate.fit(*boilerplate.training_pages(pages.limit(0)))
    got = sorted(tuple(r) for r in boilerplate.boilerplate_lines(records, model, pages=pages).where("record_id = 1").collect())
    assert got == [(1, 2)]
    main = {r.record_id: r.main for r in boilerplate.main_text(records, model, pages=pages).collect()}
    assert main[1] == f"Riverside notes\n{ARTICLE}" and main[2] is None and main[3] == ""


@pytest.mark.parametrize(("raw", "normal"), [("1d10t", "idiot"), ("iiidiot", "idiot"), ("idiot!!", "idiot"), ("i****t", "i*t"), ("tr@$h", "trash"), ("10th", "10th"), ("2013", "0"), ("dоwn", "down")])
def test_disguises(raw, normal):
    assert abuse.normal(raw) == normal


def test_marginals_equal_brute_force():
    rng = np.random.default_rng(0)
    emit, trans = rng.normal(size=(1, 4, 3)), rng.normal(size=(3, 3))
    post, _, _ = abuse.marginals(emit, np.ones((1, 4), bool), trans)
    want = np.zeros((4, 3))
    for path in np.ndindex(3, 3, 3, 3):
        p = np.exp(sum(emit[0, t, s] for t, s in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:], strict=False)))
        for t, s in enumerate(path):
            want[t, s] += p
    assert np.allclose(post[0], want / want.sum(1, keepdims=True))


def test_units_left_out_have_no_spans():
    """Spans with the bound on leaning are those of the recursions over all units."""
    rng = np.random.default_rng(1)
    for _ in range(20):
        trans = rng.normal(0, 2, (3, 3))
        least = abuse.least_lean(trans)
        emit = rng.normal(0, 3, (200, 12, 3))
        emit[..., 1:] += emit[..., :1] + least - (emit[..., 1:] - emit[..., :1]).max((1, 2), keepdims=True) - emit[..., :1]
        assert (emit[..., 1:] - emit[..., :1]).max() < 40
        lean = (emit[..., 1:].max(2) - emit[..., 0]).max(1)
        low = emit[lean <= least]
        if len(low):
            post, _, _ = abuse.marginals(low, np.ones(low.shape[:2], bool), trans)
            assert post[..., 1:].max() <= 0.5
    texts = [f"the mill of the town and the {'worthless moron nobody wants you ' * (i % 3 == 0)} river." for i in range(150)]
    field = abuse.fit(texts, np.array([[int(i % 3 == 0), 0] for i in range(150)]))
    some = texts[:9] + ["you worthless town moron and the mill", "river wants nobody"]
    with_bound = abuse.spans(*field.tag(some))
    field.least = -1e9
    assert abuse.spans(*field.tag(some)) == with_bound and with_bound


def test_abusive_passages(spark):
    rng = random.Random(2)
    plain = lambda: " ".join(rng.choice("river town mill stone keeper letter bridge storm".split()) for _ in range(9)) + ". "
    bad = "you are a worthless moron and nobody wants you. "
    texts = [plain() + (bad if i % 3 == 0 else plain()) + plain() for i in range(150)]
    field = abuse.fit(texts, np.array([[int(i % 3 == 0), 0] for i in range(150)]))
    df = frame(spark, [plain() + bad + plain(), plain() * 3, plain() + "You are a w0rthless MORON and nobody wants you. " + plain(), *EMPTY])
    assert sorted((r.doc_id, r.category) for r in abuse.offending(df, field).collect()) == [(1, "toxic"), (3, "toxic")]
    span = [r for r in abuse.offsets(df, field).collect() if r.doc_id == 1][0]
    assert "worthless moron" in df.where("doc_id = 1").first().text[span.start_char : span.end_char]
    got = {r.doc_id: (r.toxic_score, r.nsfw_score) for r in abuse.scores(df, field).collect()}
    assert got[4] == (0.0, 0.0) and len(got) == 7
    assert abuse.scores(df.limit(0), field).count() == 0
    assert abuse.offending(df, abuse.fit([], np.zeros((0, 2)))).count() == 0


SCORES = [("name", "instance", "vera", "person", 0.4), ("name", "instance", "o'dell", "person", 0.4), ("figure", "pattern", "call", "phone", 0.9), ("figure", "instance", "999-999-9999", "phone", 0.8), ("figure", "pattern", "ssn:", "id_number", 1.0), ("figure", "pattern", "part no.", "none", 1.0), ("address", "instance", "street", "address", 1.0), ("address", "instance", "weg", "address", 0.5), ("address", "instance", "rue", "address", 1.0)]
SCORES += [("mail", "instance", x, "email", 0.9) for x in ("@", "(at)", " (at) ", " (arobase) ", " (arroba) ")] + [("figure", "instance", f"words {n}", "phone", 0.9) for n in (8, 9)]
MENTIONS = [
    ("write to a.b+c@mail.test.", [("a.b+c@mail.test", "email")]),
    ("at kim (at) host [dot] test now", [("kim (at) host [dot] test", "email")]),
    ("jean.d (arobase) exemple.fr", [("jean.d (arobase) exemple.fr", "email")]),
    ("jean.d (arroba) ejemplo.es", [("jean.d (arroba) ejemplo.es", "email")]),
    ("logo@2x.png and user@localhost and @night_owl", []),
    ("one two three four one two three four one", [("one two three four one two three four one", "phone")]),
    ("zwei drei vier sechs sieben acht neun zwei", [("zwei drei vier sechs sieben acht neun zwei", "phone")]),
    ("call 212-555-0101 now", [("212-555-0101", "phone")]),
    ("call ２１２-５５５-０１０１ now", [("２１２-５５５-０１０１", "phone")]),
    ("SSN: 912-34-5678.", [("912-34-5678", "id_number")]),
    ("Part no. 912-34-5678 fits", []),
    ("Mr Vera D. Dyrkska, left", [("Vera D. Dyrkska", "person")]),
    ("asked Dyrkska, Vera today", [("Dyrkska, Vera", "person")]),
    ("asked vera dyrkska today", [("vera dyrkska", "person")]),
    ("met O'Dell Brown there", [("O'Dell Brown", "person")]),
    ("we live at 12 Old Mill Street now", [("12 Old Mill Street", "address")]),
    ("The 12 Mill Street project", []),
    ("auf dem Marktweg 85 Leute", []),
    ("ging an Waldweg 14 zurück", [("Waldweg 14", "address")]),
    ("Adresse : 5 bis, rue des Moulins", [("5 bis, rue des Moulins", "address")]),
    ("", []),
    (None, []),
]


@pytest.mark.parametrize("more_names", [0, 600])
def test_personal_information(spark, more_names):
    """The same mentions however many first names are trusted."""
    names = [("name", "instance", f"zz{i}name", "person", 0.4) for i in range(more_names)]
    nodes = pii.by_kind(spark.createDataFrame(SCORES + names, "family STRING, side STRING, node STRING, kind STRING, score DOUBLE"))
    texts = pii.pick(frame(spark, [t for t, _ in MENTIONS]), "doc_id", "text")
    found = pii.map_rows(texts, pii._SCHEMA, pii._mentioned)
    rows = {r.k: sorted(r.found) for r in pii.extracted(texts, found, nodes, spark.createDataFrame([], "node STRING")).collect()}
    for n, (text, want) in enumerate(MENTIONS, 1):
        assert [(text[x.a : x.b], x.kind) for x in rows.get(n, [])] == want


def test_patterns_reach_back_as_far_as_the_words_go():
    assert pii.before("call " + "x" * 500 + " ", 506, 2) == ["call " + "x" * 500, "x" * 500]
    assert pii.before("", 0, 3) == ["", "", ""] and pii.before("call ", 5, 3) == ["call", "", ""]


def test_bootstrapping(spark):
    firsts = ["Vera", "Otto", "Lin", "Kofi"]
    texts = [f"My name is {f} Dyrkska{i} and I left. We met {f} Noltwald there." for i in range(4) for f in firsts] + [f"In {p} Harbour the mill was closed. We saw the Grand Mill." for p in ("North", "South") * 6]
    texts += ["Part no. 123-45-6789 fits. SSN: 912-34-5678 is hers. She met Otto Brummel.", *EMPTY, "x" * 100_000]
    df = frame(spark, texts)
    got = {(r.doc_id, r.kind) for r in pii.mentions(df).collect()}
    assert {(i, "person") for i in range(1, 17)} <= got and not any(d in range(17, 29) for d, _ in got)
    assert (29, "person") in got and (29, "id_number") in got
    masked = {r.doc_id: r.masked for r in pii.masked(df).collect()}
    assert masked[29] == "Part no. 123-45-6789 fits. SSN: [ID_NUMBER] is hers. She met [PERSON]."
    assert masked[30] is None and masked[34] == texts[33]
    assert pii.mentions(df.limit(0)).count() == 0


def test_mixture(spark):
    rows = [(i, "word " * (1 + i % 7), "big") for i in range(3000)] + [(5000 + i, "word word", "small") for i in range(40)] + [(9000, None, "small"), (9001, "lost", None), (9002, "other", "none")]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id BIGINT, text STRING, source STRING, rate DOUBLE")
    targets = spark.createDataFrame([("big", 0.9, 1), ("small", 0.1, 3), ("absent", 0.2, 2)], "source STRING, target_share DOUBLE, max_repeats INT")
    mixed, report = mixture.mixture(docs, targets)
    got = {r.source: r for r in report.collect()}
    assert abs(got["small"].actual_share - 0.1) < 0.01 and abs(got["big"].actual_share - 0.9) < 0.01
    assert got["absent"].mixed_tokens == 0 and got["none"].mixed_tokens == 0 and got["small"].most_copies <= 3 and got["big"].most_copies <= 1
    assert mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    assert mixed.orderBy("doc_id", "copy").collect() == mixture.mixture(docs.repartition(7), targets)[0].orderBy("doc_id", "copy").collect()
    assert mixture.mixture(docs.limit(0), targets)[0].count() == 0


def test_fitted_models_are_saved_and_loaded(spark, tmp_path):
    texts = [f"the mill of the town and the {'worthless moron nobody wants you ' * (i % 3 == 0)} river." for i in range(90)]
    field = abuse.fit(texts, np.array([[int(i % 3 == 0), 0] for i in range(90)]))
    field.save(spark, str(tmp_path / "field"))
    again = abuse.Field.load(spark, str(tmp_path / "field"))
    assert (again.tag(texts)[1] == field.tag(texts)[1]).all()
    pages = [(["Home", "Shop", f"A long line about the mill {i} and the river, and so on.", "Imprint"], [False, False, True, False]) for i in range(20)]
    line = boilerplate.fit(pages, border=1.5)
    line.save(spark, str(tmp_path / "line"))
    same = boilerplate.LineModel.load(spark, str(tmp_path / "line"))
    payloads = ["\n".join(p) for p, _ in pages]
    assert boilerplate.main_lines(same, payloads) == boilerplate.main_lines(line, payloads) and same.border == 1.5
    with pytest.raises(Exception, match="(?i)path"):
        abuse.Field.load(spark, str(tmp_path / "none"))
