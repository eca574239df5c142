"""URL judgements, licence scans and page languages against plain code."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from bookloom.llm import language, licenses, url_reputation


def url_parts(url):
    if url is None or "://" not in url:
        return "", ""
    after = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", after, re.S)[0]
    path = re.match(r"[^?#]*", after[len(host) :], re.S)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path, rules):
    fitting = []
    for rule, verdict in rules:
        name, rest = rule.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
            fitting.append((rule, verdict))
    return max(fitting, key=lambda r: len(r[0]), default=(None, None))


def judged(pages, rules, good=None):
    """The same estimates in plain Python."""
    rows = [(i, *url_parts(url)) for i, url in pages]
    rows = [(i, h, p, *rule_of(h, p, rules)) for i, h, p in rows]
    label = {r[0]: (None if r[4] is None else int(r[4] == "allow")) for r in rows}
    if good is not None:
        label = good
    levels = [lambda h: h, lambda h: ".".join(h.split(".")[-2:]), lambda h: h.split(".")[-1]]
    counts = [{}, {}, {}]
    for i, h, *_ in rows:
        for level, table in zip(levels, counts):
            k, n = table.get(level(h), (0, 0))
            if label[i] is not None:
                k, n = k + label[i], n + 1
            table[level(h)] = (k, n)
    k, n = map(sum, zip(*counts[2].values()))
    mean = k / n if n else 0.5

    def strength(table):
        seen = [(k, n) for k, n in table.values() if n]
        total = sum(n for _, n in seen)
        spread = sum(n * (k / n - mean) ** 2 for k, n in seen) / total if total else 0
        value = mean * (1 - mean) / spread - 1 if spread else 1000.0
        return min(max(value, 1.0), 1000.0)

    strengths = [strength(t) for t in counts]
    found = []
    for i, h, p, rule, verdict in rows:
        prior = mean
        for level in (2, 1, 0):
            k, n = counts[level][levels[level](h)]
            a, b = strengths[level] * prior + k, strengths[level] * (1 - prior) + n - k
            prior = a / (a + b)
        deviation = math.sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))
        upper = prior + 1.645 * deviation
        found.append((i, h, p, rule, verdict or ("block" if upper < 0.5 else "allow"), upper))
    return found


KIND = "page_id bigint, url string, host string, rule string, salt int, suffix string, html string"


def pages_table(spark, rows):
    return spark.createDataFrame([(i, u, "x", "y", 1, "z", None) for i, u in rows], KIND)


URLS = [
    "http://EXAMPLE.org/es/1", "https://a.example.org/en/12?x=1", "http://example.org/en/2#t", "x://org/",
    "http://org", "http://notorg/es/", "http://b.com/fr/?", "HTTP://b.com/de/1", "http://b.com/fr", "nothing",
    None, "", "://", "http:///path", "http://user@H.net:80/p?q#f", "http://é.com/fr/é", "a://b://c/d", "http://c.net\n/x",
]


def test_urls_rules_and_reputations(spark):
    rng = random.Random(1)
    hosts = ["good.net", "bad.net", "a.bad.net", "b.com", "c.com", "x.example.org", "y.example.org", "lone.info"]
    rows = list(enumerate(URLS + [None, "http://b.com/de/1"]))
    rows += [(100 + i, f"http://{rng.choice(hosts)}/{rng.choice(['fr', 'de', 'es', 'en/1', 'x'])}/{i}") for i in range(400)]
    found = url_reputation.judge_urls(pages_table(spark, rows)).collect()
    wanted = judged(rows, url_reputation.RULES)
    key = lambda r: (r[0], r[1])
    got = sorted([(r.page_id, r.host, r.path, r.rule, r.verdict, r.upper) for r in found], key=key)
    assert [r[:5] for r in got] == [r[:5] for r in sorted(wanted, key=key)]
    assert [r[5] for r in got] == pytest.approx([r[5] for r in sorted(wanted, key=key)])


def test_bad_hosts_are_blocked_and_doubt_is_not(spark):
    rows, good = [], {}
    for i in range(300):
        host = ["bad.a.com", "fine.a.com", "rare.b.com"][i % 3] if i < 290 else "new.c.com"
        rows.append((i, f"http://{host}/{i}"))
        good[i] = {"bad.a.com": 0, "fine.a.com": 1, "rare.b.com": None, "new.c.com": None}[host]
    labels = F.create_map(*[F.lit(x) for i, g in good.items() if g is not None for x in (i, g)])
    df = pages_table(spark, rows)
    judged_rows = url_reputation.judge_urls(df, rules=(), good=F.try_element_at(labels, F.col("page_id").cast("int")))
    verdicts = {(r.host, r.verdict) for r in judged_rows.collect()}
    assert verdicts == {("bad.a.com", "block"), ("fine.a.com", "allow"), ("rare.b.com", "allow"), ("new.c.com", "allow")}


def test_urls_of_nothing_and_without_python(spark):
    assert url_reputation.judge_urls(pages_table(spark, [])).collect() == []
    plan = url_reputation.judge_urls(pages_table(spark, [(1, "http://a.b/")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan


def test_long_suffixes(spark):
    df = spark.createDataFrame([("a.b.co.uk",), ("a.b.com",), ("co.uk",)], "h string")
    rows = df.select(url_reputation.domain_of(F.col("h"), ["co.uk"]), url_reputation.suffix_of(F.col("h"), ["co.uk"]))
    assert [tuple(r) for r in rows.collect()] == [("b.co.uk", "co.uk"), ("b.com", "com"), ("co.uk", "co.uk")]


def plain_scan(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    starts, labels = [], set()
    for phrase, label in {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


TEXTS = {
    1: ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc-4.0"),
    2: ("x Licensed under the Apache License, Version 2.0. All rights reserved, all RIGHTS reserved", "apache-2.0,reserved"),
    3: ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0"),
    4: ("Released under the MIT License", "mit"),
    5: ("the general public license we all know", "gpl"),
    6: ("the mitten license under which all are released, apache and mit", ""),
    7: ("License MIT the under released", ""),
    8: ("Permission is hereby granted, free of charge, to any person obtaining a copy of it", "mit-text"),
    9: (None, ""), 10: ("", ""), 11: ("cc" , ""), 12: ("cc by", "cc-by"), 13: ("éCC by çç cc BY{cc by", "cc-by"),
    14: ("word " * 200_000 + "cc by " + "word " * 10, "cc-by"),
    15: ("\x7fcc_by\x00cc:by İcc by", "cc-by"), 16: ("license mit", ""), 17: ("redistribution and use of", ""),
}
DOCUMENTS = "doc_id bigint, text string, labels string, score int, n_words string"


def test_licence_scans(spark):
    rows = [(i, t, "", 0, "") for i, (t, _) in TEXTS.items()] + [(None, "cc by cc by", "", 0, ""), (12, "cc by", "", 0, "")]
    rows += [(1000 + i, "the work is under version 2 of all that we know by now", "", 0, "") for i in range(60)]
    found = licenses.scan_licenses(spark.createDataFrame(rows, DOCUMENTS)).collect()
    assert len(found) == len(rows)
    for r in found:
        text = TEXTS[r.doc_id][0] if r.doc_id in TEXTS else dict((a, b) for a, b, *_ in rows)[r.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_scan(text)
        if r.doc_id in TEXTS:
            assert r.labels == TEXTS[r.doc_id][1], r.doc_id
        assert 0 <= r.score <= 1
    assert licenses.scan_licenses(spark.createDataFrame([], DOCUMENTS)).collect() == []


def test_no_place_of_a_template_is_missed(spark):
    rng = random.Random(14)
    names = sorted(licenses.TEMPLATES)
    rows = []
    for i in range(400):
        words = []
        for _ in range(rng.randrange(1, 4)):
            own = licenses.TEMPLATES[rng.choice(names)][0].split()
            own = [rng.choice(["the", "license", "or", "x"]) if rng.random() < rng.choice([0, 0.2, 0.5]) else w for w in own]
            if rng.random() < 0.3:
                own = own[rng.randrange(len(own)) :]
            words += own + rng.choices(["the", "under", "of", "y"], k=rng.randrange(4))
        rows.append((i, " ".join(words), "", 0, ""))
    df = spark.createDataFrame(rows, DOCUMENTS)
    weights = licenses.word_weights(df, sorted({w.encode() for t, _ in licenses.TEMPLATES.values() for w in t.split()}))
    hit = 0
    for r in licenses.scan_licenses(df).collect():
        words, labels, best = rows[r.doc_id][1].split(), set(plain_scan(rows[r.doc_id][1])[4].split(",")) - {""}, 0.0
        for label, (text, key) in licenses.TEMPLATES.items():
            own, key = text.split(), key.split()
            at = next(k for k in range(len(own)) if own[k : k + len(key)] == key)
            each = [weights[w.encode()] + 1e-9 for w in own]
            for begin in range(-at, len(words)):
                if words[begin + at : begin + at + len(key)] != key:
                    continue
                there = sum(e for k, (w, e) in enumerate(zip(own, each)) if 0 <= begin + k < len(words) and words[begin + k] == w)
                score = min(1.0, there / sum(each))
                if score >= licenses.MIN_SCORE:
                    labels.add(label)
                    best, hit = max(best, score), hit + 1
        assert r.labels == ",".join(sorted(labels)) and r.score == pytest.approx(best), r.doc_id
    assert hit > 200


def test_weights_count_documents(spark):
    df = spark.createDataFrame([("mit mit",), ("MIT x",), (None,), ("the",)], "text string")
    weights = licenses.word_weights(df, [b"mit", b"the", b"bsd"])
    assert weights == pytest.approx({b"mit": math.log(5 / 3), b"the": math.log(5 / 2), b"bsd": math.log(5)})


WORDS = {"en": "the and of that with from this".split(), "fr": "le les dans pour avec qui une".split(),
         "de": "der die und nicht mit auch eine".split()}
PAGES = "page_id bigint, url string, html string, lang string, host string, n int, p double"


def text_in(rng, lang, count=60):
    return " ".join(rng.choices(WORDS[lang], k=count))


@pytest.fixture(scope="module")
def text_model(spark):
    rng = random.Random(2)
    rows = [(i, text_in(rng, l), l) for i, l in enumerate(rng.choices(list(WORDS), k=300))]
    rows += [(1000, None, "en"), (1001, "x", None), (1002, "", "fr")]
    return language.fit_text(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))


def test_languages_of_pages(spark, text_model):
    assert text_model.languages == ["de", "en", "fr"]
    rng = random.Random(3)
    page = lambda declared, text: f'<html lang="{declared}"><script>the the der</script><p>{text}</p></html>'
    rows, truth = [], {}
    for i in range(300):
        lang = rng.choice(["en", "fr"] if i % 3 else ["de"])
        declared = lang if rng.random() < 0.9 else "en"
        host = "www.site.de" if lang == "de" else f"h{i % 5}.site.com"
        rows.append((i, f"http://{host}/{i}", page(declared, text_in(rng, lang)), "", "", 0, 0.0))
        truth[i] = lang
    rows += [(1000, "http://www.site.de/x", "<html><body></body></html>", "", "", 0, 0.0),  # the host decides
             (1001, "http://h1.site.com/", '<html lang="fr"></html>', "", "", 0, 0.0),  # the declaration decides
             (1002, None, None, "", "", 0, 0.0), (None, "http://a.b/", page("fr", text_in(rng, "fr")), "", "", 0, 0.0)]
    found = language.identify(spark.createDataFrame(rows, PAGES), text_model).collect()
    by_id = {r.page_id: r for r in found}
    assert len(found) == len(rows)
    assert all(by_id[i].lang == lang for i, lang in truth.items())
    assert by_id[1000].lang == "de" and by_id[1000].text_lang is None and by_id[1000].confidence > 0.6
    assert by_id[1001].lang == "fr" and by_id[1001].declared == "fr"
    assert by_id[1002].lang in WORDS and by_id[None].lang == "fr"


SOUNDS = ["ba", "co", "du", "fe", "gi", "ho", "ju", "ka", "li"]


def test_no_language_is_left_out(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE_ROWS", 100)
    rng = random.Random(8)
    text = lambda k: " ".join(rng.choices([f"{a}{b}{k}" for a in SOUNDS for b in SOUNDS], k=20))
    tags = [f"{a}{b}" for a in SOUNDS for b in SOUNDS][:80]
    spoken = ["en"] * 3000 + [t for t in tags for _ in range(2)] + [None] * 3000
    docs = [(i, text(t), t) for i, t in enumerate(spoken)]
    model = language.fit_text(spark.createDataFrame(docs, "doc_id bigint, text string, lang string"))
    assert model.languages == sorted({"en", *tags})
    pages = [(i, f"http://h{i}.x{t}/", f"<html lang={t}><p>{text(t)}</p>", "", "", 0, 0.0) for i, t in enumerate(tags)]
    found = language.identify(spark.createDataFrame(pages, PAGES), model).collect()
    assert sum(r.lang == tags[r.page_id] for r in found) >= 76


def test_languages_of_nothing(spark, text_model):
    assert language.identify(spark.createDataFrame([], PAGES), text_model).collect() == []
    none = language.fit_text(spark.createDataFrame([], "doc_id bigint, text string, lang string"))
    rows = language.identify(spark.createDataFrame([(1, "http://a.b/", "<p>x</p>", "", "", 0, 0.0)], PAGES), none)
    assert [(r.page_id, r.lang) for r in rows.collect()] == [(1, None)]


def test_markup():
    assert language.declared_language("<HTML class=x LANG='de-AT'>") == "de"
    assert language.declared_language("<p lang=fr>") is None
    assert language.visible_text("<style>a</style>x &amp; <b>y</b><!-- z -->").split() == ["x", "&", "y"]
