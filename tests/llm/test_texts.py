"""Language, licenses, quality, chat, pages, toxicity and search: small cases with known results."""

import hashlib
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from tallyfold.llm import exact_topk, html_text, language, licenses, quality, reply_trees, textkit, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_words_are_split_as_stated():
    texts = ["", "a B\tc\x0bd\n", "été  x", None, "one", " "]
    hashes, first = textkit.words(*textkit.utf8(pa.array(texts, pa.string())))
    assert np.diff(first).tolist() == [0, 4, 2, 0, 1, 0]
    alone, _ = textkit.words(*textkit.utf8(pa.array(["b", "B", "x"])))
    assert alone[0] == alone[1] == hashes[1] and alone[2] == hashes[5]
    sliced = pa.array(["zz", "a b", "c"]).slice(1)
    assert np.diff(textkit.words(*textkit.utf8(sliced))[1]).tolist() == [2, 1]


def test_languages(spark):
    rng = random.Random(4)
    vocabulary = {"en": "the of and house tree water with that".split(), "fr": "le la une maison arbre leau avec que".split()}
    rows = [(i, " ".join(rng.choice(vocabulary[k]) for _ in range(40)), k, f"s{i % 3}", "x") for i, k in enumerate(rng.choices(["en", "fr"], k=120))]
    rows += [(500, None, "en", "s0", "x"), (501, "", None, None, "x"), (502, "le la une maison arbre avec que leau " * 4, "en", "s0", "x"), (503, "0" * 300 + "中" * 200, None, None, "x"), (0, rows[0][1], rows[0][2], "s0", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, language string")
    pages = spark.createDataFrame([(1, "http://a.example.fr/x", "<html lang='fr'><body><script>the of and</script>une maison avec la arbre que</body></html>"), (2, None, None), (3, "nonsense", "")], "page_id long, url string, html string")
    found = language.identify_corpus(docs, pages).collect()
    by_doc = {r.doc_id: r for r in found if r.doc_id is not None}
    by_page = {r.page_id: r for r in found if r.page_id is not None}
    assert len(found) == len(rows) + 3
    assert all(by_doc[i].language == lang and by_doc[i].kept for i, _, lang, _, _ in rows[:120])
    assert by_doc[500].language == "en" and by_doc[502].language == "fr" and not by_doc[503].kept
    assert by_page[1].language == "fr" and by_page[1].declared == "fr"
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns and {r.language for r in kept.collect()} == {"x"}
    assert dict((r.doc_id, r.lang) for r in kept.collect())[502] == "fr"
    assert language.identify_corpus(docs.limit(0), pages.limit(0)).collect() == []


def test_six_of_twenty_thousand_are_kept(spark):
    """A language that few documents declare loses none of them."""
    rng = random.Random(1)
    english, french = "the of and house tree water with that which green".split(), "le la une maison arbre avec que dans les des".split()
    rows = [(i, " ".join(rng.choices(english, k=12)), "en", f"s{i % 5}") for i in range(20_000)]
    rows += [(50_000 + i, " ".join(rng.choices(french, k=12)), "fr", f"s{i % 5}") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = language.keep_identified(docs).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in kept} == {"en": 20_000, "fr": 6}


def _with_lang(spark, share, names, seed=3):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    rng = random.Random(seed)
    return spark.createDataFrame([(r.doc_id, r.text, rng.choice(names) if r.lang == "en" and rng.random() < share else r.lang, r.source) for r in docs], "doc_id long, text string, lang string, source string"), {r.doc_id: r.lang for r in docs}


@pytest.mark.parametrize("share,names", [(0.05, ["eng"]), (0.05, ["xx", "qqq"]), (0.05, ["la"])])
def test_other_names_make_no_other_language(spark, share, names):
    """Another name of a language is that language; a name of none, or of another language on its texts, makes no new one."""
    docs, right = _with_lang(spark, share, names)
    kept = {r.doc_id: r.lang for r in language.keep_identified(docs).select("doc_id", "lang").collect()}
    assert set(kept.values()) == {"en", "fr", "de", "es"}
    assert sum(kept.get(k) == v for k, v in right.items()) >= 0.99 * len(right)


def test_names_of_none_lose_no_documents(spark):
    rng = random.Random(8)
    rows = [(i, "the house of the water and that green tree with it", rng.choice(["zz", "qqq", "xx", "abc"]) if i < 40 else "en", "s") for i in range(540)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert [tuple(r) for r in language.keep_identified(docs).groupBy("lang").count().collect()] == [("en", 540)]


def test_very_long_texts_of_a_language(spark):
    rng = random.Random(6)
    words = "the of and house tree water with that".split(), "le la une maison arbre leau avec que".split()
    rows = [(i, " ".join(rng.choices(words[i % 2], k=30)), ("en", "fr")[i % 2], "s") for i in range(40)] + [(90, " ".join(rng.choices(words[1], k=400_000)), None, "s"), (91, "x" * 2_000_000, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = {r.doc_id: r.lang for r in language.keep_identified(docs).select("doc_id", "lang").collect()}
    assert found[90] == "fr" and all(found[i] == ("en", "fr")[i % 2] for i in range(40))


def test_fusion_by_brute_force(spark):
    """Posteriors against the formulas written out record by record."""
    rng = random.Random(2)
    words = {"en": "the of and house tree".split(), "fr": "le la une maison arbre".split(), "de": "der die und haus baum".split()}
    rows = []
    for i in range(60):
        k = rng.choice(list(words))
        text = rng.choice([None, ""]) if i % 20 == 0 else " ".join(rng.choices(words[k], k=rng.choice([1, 2, 9])))
        host = rng.choice([None, "a.x.de", "b.x.de", "c.y.fr"])
        rows.append((i, text, rng.choice([k, k, "en", None]), host and host[-2:], host, host and host[2:]))
    records = spark.createDataFrame(rows, "doc_id long, text string, declared string, suffix string, host string, domain string")
    model = language.learn(records)
    found = {r.doc_id: r for r in language.identify(records, ["doc_id"]).collect()}
    ll = model.likelihoods(pa.array([r[1] for r in rows], pa.string()))

    def softmax(x):
        e = np.exp(x - x.max())
        return e / e.sum()

    size, unit = len(model.languages), language.UNIT
    own = np.array([np.round(softmax(x) * unit) for x in ll])
    root = (own.sum(axis=0) + unit) / (own.sum() + size * unit)
    for i, r in enumerate(rows):
        total = ll[i].copy()
        for at in (2, 3):
            if r[at] is not None:
                mine = own[[j for j, q in enumerate(rows) if q[at] == r[at]]].sum(axis=0)
                weight = language.TABLE_WEIGHT * unit
                total += np.log((mine + weight * (mine.sum() + 1) / (own.sum() + 1)) / (own.sum(axis=0) + weight))
        domain = own[[j for j, q in enumerate(rows) if q[5] == r[5]]].sum(axis=0)
        parent = (domain + language.HOST_WEIGHT * unit * root) / (domain.sum() + language.HOST_WEIGHT * unit)
        others = own[[j for j, q in enumerate(rows) if q[4] == r[4] and j != i]].sum(axis=0)
        total += np.log((others + language.HOST_WEIGHT * unit * parent) / (np.sum(others) + language.HOST_WEIGHT * unit))
        post = softmax(total)
        assert found[i].confidence == pytest.approx(post.max(), abs=2e-4)
        if np.sort(post)[-1] - np.sort(post)[-2] > 1e-6:
            assert found[i].language == model.languages[int(post.argmax())]


def test_rare_and_many_languages_have_models(spark):
    """Languages come from all records: one with few among many texts, and more than 64 of them."""
    rows = [(f"the house number of tree {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}", "en") for i in range(6000)]
    rows += [(f"ett hus med grannar och skogar {c}", "sv") for c in "abcde"] + [("the house of trees", "und")] * 9
    frame = spark.createDataFrame(rows, "text string, declared string")
    model = language.learn(frame, 40)
    assert model.languages == ["en", "sv", language.UNKNOWN]
    assert np.argmax(model.likelihoods(pa.array(["ett hus och skogar", "the number of trees"])), axis=1).tolist() == [1, 0]
    many = [(f"word{chr(97 + k // 10)}{chr(97 + k % 10)} text {c}", f"l{k:02d}") for k in range(70) for c in "abc"]
    assert len(language.learn(spark.createDataFrame(many, frame.schema)).languages) == 71


def test_licenses(spark):
    mit = licenses.TEXTS["MIT"]
    british = "Copyright (c) 2019 Someone\n\n" + mit.upper().replace(",", " ,").replace("\n\n", "\n")
    rows = [(1, british), (2, "text\n  released under the MIT Licence!\nmore"), (3, None), (4, ""), (5, "All rights reserved"), (5, "All rights reserved"), (6, mit + " and more")]
    found = sorted((r.doc_id, r.scope, r.line, r.license) for r in licenses.scan(spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, license string")).collect())
    both = [(5, "line", 1, "all-rights-reserved"), (5, "text", 0, "all-rights-reserved")]
    # A run of paragraphs that is a license is found in a longer text; the last one of text 6 is longer than the license's.
    assert found == sorted([(1, "text", 0, "MIT"), (2, "line", 2, "MIT"), *both, *both])
    rows = [(1, f"About this program.\n\n{mit}\n\nThe end."), (2, 'Licensed under the Apache License, Version 2.0 (the "License");'), (3, "/* SPDX-License-Identifier: MIT */"), (4, "Copyright 2020 Foo. All rights reserved."), (5, "a\n(c) third item\nb"), (6, "x " * 400_000 + f"\n\n{mit}"), (7, mit.split("\n\n")[1])]
    found = {(r.doc_id, r.scope, r.line, r.license) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {(1, "span", 2, "MIT"), (2, "line", 1, "Apache-2.0"), (2, "text", 0, "Apache-2.0"), (3, "line", 1, "MIT"), (3, "text", 0, "MIT"), (4, "line", 1, "all-rights-reserved"), (4, "text", 0, "all-rights-reserved"), (6, "span", 2, "MIT")}
    third = spark.createDataFrame([("x", "b\n(c) third item")], "name string, text string")
    assert [r.scope for r in licenses.scan(spark.createDataFrame([(1, "B\n(C) third item!")], "doc_id long, text string"), third).collect()] == ["text"]
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_whole_licenses(spark):
    """Whole licenses with a holder's line, with or without their title; other known texts as a table."""
    folder = Path(licenses.__file__).parent / "license_texts"
    named = {n: (folder / f"{n}.txt").read_text() for n in licenses.WHOLE}
    rows = list(named.items())
    rows += [("MIT", f"MIT License\n\nCopyright (c) 2020 A B\n\n{licenses.TEXTS['MIT']}\n"), ("ISC", f"ISC License\n\nCopyright 2020, A B\n\n{licenses.TEXTS['ISC']}")]
    rows += [("BSD-3-Clause", f"BSD 3-Clause License\n\nCopyright (c) 2023, X\nAll rights reserved.\n\n{named['BSD-3-Clause']}"), ("BSD-2-Clause", named["BSD-2-Clause"].replace("1. ", "* ").replace("2. ", "* "))]
    rows += [("Apache-2.0", named["Apache-2.0"].split("APPENDIX")[0]), ("GPL-3.0", "\n".join(named["GPL-3.0"].split("\n")[2:]))]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    found = {r.doc_id: r.license for r in licenses.scan(docs).where("scope = 'text'").collect()}
    assert found == {i: n for i, (n, _) in enumerate(rows)}
    own = spark.createDataFrame([("own", "Do what\nyou like, whilst here."), ("blank", " \n")], "name string, text string")
    mine = spark.createDataFrame([(1, "DO what you like -- while here"), (2, rows[0][1]), (3, "")], "doc_id long, text string")
    assert [(r.doc_id, r.scope, r.license) for r in licenses.scan(mine, own).orderBy("scope").collect()] == [(1, "line", "own"), (1, "text", "own")]


def quality_of(text):
    text = text or ""
    words = WORD.findall(text)
    runs = Counter(zip(words, words[1:], words[2:]))
    repeated = {k + j for k in range(len(words) - 2) if runs[tuple(words[k : k + 3])] > 1 for j in range(3)}
    seen, twice = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            twice += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), twice, len(repeated), failed)


def test_quality(spark):
    rng = random.Random(9)
    prose = [" ".join(rng.choice("the of and to in is house river walking green".split()) + ("." if rng.random() < 0.1 else "") + str(rng.randrange(10**6) if rng.random() < 0.05 else "") + rng.choice("abcdefghij") * 2 for _ in range(150)) for _ in range(30)]
    texts = [*prose, None, "", " \n\x0b ", "a b c a b c a b", "x\ny\nx\n\nx", "#" * 5 + " |é", " ".join(f"{w}###" for w in prose[0].split())]
    docs = spark.createDataFrame([(i, t, "en" if i % 7 else None, "k") for i, t in enumerate(texts)], "doc_id long, text string, lang string, kept string")
    found = {r.doc_id: r for r in quality.verdicts(docs).collect()}
    for i, t in enumerate(texts):
        r = found[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == quality_of(t)
    good = quality.keep_good(docs)
    assert good.columns == docs.columns and {r.kept for r in good.collect()} == {"k"}
    assert len(texts) - 1 not in {r.doc_id for r in good.collect()} and len(good.collect()) >= 28
    assert quality.verdicts(docs.limit(0)).collect() == []


def test_jensen_shannon(spark):
    from pyspark.sql import functions as F

    def arrays(*xs):
        return [F.array(*[F.lit(float(v)) for v in x]) for x in xs]

    row = spark.range(1).select(quality.distance(*arrays([1, 2], [2, 4])).alias("a"), quality.distance(*arrays([1, 0], [0, 9])).alias("b"), quality.distance(*arrays([0, 0], [1, 1])).alias("c")).first()
    assert row.a == pytest.approx(0) and row.b == pytest.approx(1) and row.c == 0


def test_chat_formatting(spark):
    rows = [(1, 0, "user", "hi [INST] </s> ~0 <s>["), (1, 1, "assistant", "yes ~1]\n"), (1, 2, "assistant", None), (2, 5, None, "é"), (2, 5, None, "é"), (2, None, "user", "last"), (None, 0, "user", "n"), (None, 1, "user", "m"), (3, 0, "assistant", ""), (-(2**63), 0, "user", "least"), (4, 0, "assistant", "long [text] " * 50_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r.conv_id: r for r in reply_trees.digests(turns).collect()}

    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    def check(conv, said):
        r = found[conv]
        loss = "".join(t for role, t in said if role == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(said), sha("".join(f"{role}\n{t}\n" for role, t in said)), len(loss), sha(loss))

    check(1, [("user", "hi [INST] </s> ~0 <s>["), ("assistant", "yes ~1]\n"), ("assistant", "")])
    check(2, [("", "é"), ("", "é"), ("user", "last")])
    assert sorted(r.turns_sha256 for r in reply_trees.digests(turns).where("conv_id is null").collect()) == sorted([sha("user\nn\n"), sha("user\nm\n")])
    check(3, [("assistant", "")])
    check(-(2**63), [("user", "least")])
    check(4, [("assistant", "long [text] " * 50_000)])
    assert reply_trees.digests(turns.limit(0)).collect() == []


def test_reply_trees_rank_branches(spark):
    #      1(0)
    #     /    \
    #  2(5)    3(1)
    #   |       |  \
    #  4(1)   5(9)  6(9)
    nodes = [(1, 1, None, 0.0), (1, 2, 1, 5.0), (1, 3, 1, 1.0), (1, 4, 2, 1.0), (1, 5, 3, 9.0), (1, 6, 3, 9.0), (2, 1, 99, 1.0), (3, 1, 2, 0.0), (3, 2, 1, 0.0)]
    frame = spark.createDataFrame([(*n, "user", f"m{n[1]}") for n in nodes], "tree long, node long, parent long, score double, role string, text string")
    paths = {}
    for r in reply_trees.best_paths(frame, keep=2).collect():
        paths.setdefault((r.tree, r.leaf), {})[r.up] = r.node
    assert paths == {(1, 5): {0: 5, 1: 3, 2: 1}, (1, 6): {0: 6, 1: 3, 2: 1}, (2, 1): {0: 1}}
    chain = spark.range(70).selectExpr("1L AS tree", "id AS node", "nullif(id - 1, -1) AS parent", "0D AS score")
    assert sorted((r.up, r.node) for r in reply_trees.best_paths(chain).collect()) == [(k, 69 - k) for k in range(70)]


def test_main_text(spark):
    page = '<html><head><title>t</title><script>var a="</p>";</script></head><body><nav><a href=x>menu</a></nav><div class="cookie-notice">c</div><article><h1>Title &amp; more</h1><p>One  two&nbsp;three<br><p><b>Four</b> five<aside>side</aside></article><div id="comments"><p>bad</p></div><footer>f</footer>'
    assert html_text.main_text(page) == "Title & more\nOne two three\nFour five"
    plain = "<div><a href=x>Home</a> <a href=y>About</a> <a href=z>More</a></div>" + "<p>" + "long text here. " * 20 + "</p><p>short</p><p>" + "more text again. " * 20 + "</p><div><a>1</a><a>2</a><a>3</a></div>"
    assert html_text.main_text(plain).split("\n")[0].startswith("long") and "short" in html_text.main_text(plain) and "Home" not in html_text.main_text(plain)
    rows = [(1, "u", page, 7), (2, None, None, 7), (3, "u", "", 7), (1, "u", page, 7), (4, "u", "<b" + "x" * 100_000, 7)]
    found = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text long")).collect()
    assert len(found) == 5 and all(r.n_chars == len(r.text) for r in found)
    assert [r.text for r in found if r.page_id in (2, 3)] == ["", ""]
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_main_text_is_not_hidden():
    """Optional end tags, hyphenated names inside an article, and forms and named parts around the whole page hide no text."""
    text = "A sentence of the article, long enough to be text. " * 4
    said = text.strip()
    assert html_text.main_text(f"<html><head><title>t</title><body><p>{text}</p>") == said
    assert html_text.main_text(f"<head><title>t</title><p>{text}</p>") == said
    assert html_text.main_text(f"<body><form action=x><nav>menu</nav><div class=sidebar>side</div><p>{text}</p></form>") == said
    assert html_text.main_text(f"<div class='elementor-widget-container'><p>{text}</p></div><form><p>mail</p></form>") == said
    inside = f"<article><div class='entry-header'><h1>Title</h1></div><div class='elementor-widget-container'><p>{text}</p></div><div class='share-widget'>share</div></article>"
    assert html_text.main_text(inside) == f"Title\n{said}"
    for row in (f"<table><tr><td hidden>no<td>{text}</table>", f"<table><tr hidden><td>no<tr><td>{text}</table>", f"<table><tbody hidden><tr><td>no<tbody><tr><td>{text}</table>", f"<dl><dt hidden>no<dd>{text}</dl>"):
        assert html_text.main_text(row) == said


def test_main_text_is_found_by_its_lines():
    """Articles keep their text and headline whatever marks them: other tags, unlucky names, a form around the page, an unclosed menu."""
    paragraphs = [f"Paragraph {k}, " + "with the ordinary words of an article, " * (1 + k % 3) + "to the end." for k in range(12)]
    menu = "<ul>" + "".join(f"<li><a href=x{k}>item {k}</a></li>" for k in range(9)) + "</ul>"
    article = "<h1>Headline of the day</h1>" + "".join(f"<p>{p}</p>" for p in paragraphs)
    said = "\n".join(["Headline of the day", *paragraphs])

    def page(body, nav="</nav>"):
        return f"<html><head><title>t</title></head><body><nav>{menu}{nav}<div class='ad'>Buy things.</div>{body}<footer>About us</footer></body></html>"

    bodies = [f"<article>{article}</article>", f"<div>{article}</div>", article, f"<form>{article}</form>"]
    bodies += [f"<div id='{name}'>{article}</div>" for name in ("legal", "related-work", "social-history", "widget", "notice-board", "side", "share-prices", "promotion", "comments-section")]
    bodies.append(f"<div><div><h1>Headline of the day</h1></div><div class='text'>{article.split('</h1>')[1]}</div></div><div class='comment-list'><p>{paragraphs[0]}</p></div>")
    for body in bodies:
        assert html_text.main_text(page(body)) == said, body[:60]
    assert said in html_text.main_text(page(f"<article>{article}</article>", nav=""))
    assert html_text.main_text(page(article).replace("<body>", "<body><form>").replace("</body>", "</form></body>")) == said


def test_content_lines_by_brute_force():
    """Smoothing and threshold against sums written out."""
    rng = random.Random(3)
    for n in (1, 2, 5, 40):
        ratios = np.array([rng.random() * rng.choice([1, 8]) for _ in range(n)])
        kernel = {d: np.exp(-(d**2) / 2) for d in range(-3, 4)}
        level = [sum(kernel[j - k] * ratios[j] for j in range(n) if abs(j - k) <= 3) / sum(kernel[j - k] for j in range(n) if abs(j - k) <= 3) for k in range(n)]
        assert html_text.smoothed(ratios) == pytest.approx(level)
        cut = sum(level) / n
        for _ in range(100):
            high, low = [x for x in level if x >= cut], [x for x in level if x < cut]
            if not high or not low:
                break
            cut = (sum(high) / len(high) + sum(low) / len(low)) / 2
        assert html_text.content(ratios).tolist() == [x >= cut for x in level]


BROKEN = ["<![foo bar", "<![", "<!", "<![if !IE]>", "<![CDATA[ x ]]>", "<!--", "<", "</", "<a b=\"", "<a b='x", "&#", "&#x;", "<p a=b=c", "<script>", "<?php", "<!doctype", "</>", "<title>"]


def test_broken_markup_ends_no_run(spark):
    """A page that breaks off anywhere keeps the text before it."""
    text = "One long paragraph with quite a few words in it, which is the text of the page. " * 3
    rows = [(k, "u", f"<p>{text}</p>{b}") for k, b in enumerate(BROKEN)] + [(100 + k, "u", f"<p>{text}</p>{b}<p>{text}</p>") for k, b in enumerate(BROKEN)] + [(200 + k, "u", b) for k, b in enumerate(BROKEN)]
    found = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(found) == len(rows)
    assert all(found[k].startswith(text.strip()) for k in range(len(BROKEN)))
    assert all(text.strip() in found[100 + k] for k in range(len(BROKEN)))


@pytest.mark.parametrize("part", ["<a ", "<![foo ", "<!-- ", "<!--a>", "</ ", "<p ", "<nav>x", "<div class=ads>x", "&", "&#", "<a b='", "< ", "<script>", "<![CDATA["])
def test_repeated_broken_markup_takes_time_in_proportion(part):
    import time

    began = time.process_time()
    html_text.main_text(part * 40_000)
    html_text.main_text("<p>text</p>" + part * 40_000 + ">")
    assert time.process_time() - began < 12


@pytest.mark.parametrize("name", ["user-comments", "reader-comments", "fb-comments", "comment-thread", "discussion", "wp-block-comments", "adsbygoogle", "google-ad", "author-bio"])
def test_doubtful_parts_are_left_out(name):
    text = ["The first paragraph has quite a few words in it, which say something about a thing.", "The second paragraph goes on about it in as many words as the first one had before."]
    said = "I read this and must say that I have quite another view of these things, as all do."
    article = "".join(f"<p>{t}</p>" for t in text)
    for page in (f"<main>{article}<div class='{name}'><p>{said}</p></div></main>", f"<article>{article}<section class='{name} x1'><p>{said}</p></section></article>"):
        assert html_text.main_text(f"<html><body><h1>Title</h1>{page}</body></html>") == "\n".join(["Title", *text])
    whole = f"<div class='with-{name}'>{article}</div>"
    assert html_text.main_text(f"<html><body>{whole}</body></html>") == "\n".join(text)


def test_hostile_page_takes_time_in_proportion():
    import time

    took = []
    for n in (4000, 16000):
        began = time.process_time()
        html_text.main_text("<div>" * n + "<i>" * n + "text" + "</b></u><p>x" * n)
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 1


def test_one_long_paragraph_cuts_no_others():
    """A page without article tags: paragraphs far from a very long one stay, menus go."""
    menu = "".join(f"<div><a href=x{k}><b>m{k}</b></a></div>" for k in range(8))
    texts = [f"{k} " + "ordinary words of an article " * 7 for k in range(20)]
    texts[10] = "very long paragraph " * 500
    assert html_text.main_text(menu + "".join(f"<p>{t}</p>" for t in texts) + menu).split("\n") == [t.strip() for t in texts]


def test_toxicity_learns_pairs(spark):
    """Neither word tells alone; both together do, which no sum of weights can say."""
    rng = random.Random(8)
    filler = [f"w{k}" for k in range(40)]
    rows = []
    for i in range(1600):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = rng.choices(filler, k=8) + ["foolish!"] * a + ["Neighbours"] * b
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(a == b)))
    docs = spark.createDataFrame([(i, t, 1.0) for i, t, _ in rows] + [(9001, None, 0.0), (9002, "", 0.0), (None, "w1", 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(5, None)], "doc_id long, toxic int")
    found = {r.doc_id: r for r in toxicity.score(docs, toxicity.learn(docs, labels)).collect()}
    held = [(y, found[i].score >= 0.5) for i, _, y in rows if found[i].held_out]
    assert all(found[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in rows)
    assert np.mean([y == p for y, p in held]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found.values()) and len(found) == len(rows) + 3
    none = toxicity.score(docs.limit(3), toxicity.learn(docs.limit(0), labels.limit(0))).collect()
    assert all(r.predicted == 0 for r in none)


def test_exact_topk(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "GROUP", 50)
    monkeypatch.setattr(exact_topk, "CHUNK", 3)
    monkeypatch.setattr(exact_topk, "BLOCK", 8)
    rng = np.random.default_rng(1)
    rows = [(int(i * 10), rng.normal(0, 0.02, 6).round(3).tolist()) for i in range(150)]
    rows += [(1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (50 * 77, [float("inf")]), (5, [0.1]), (7, rows[3][1]), (7, rows[3][1]), (None, [0.5])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int")
    found = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in exact_topk.top_products(frame).collect())
    fine = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    expected = []
    for q, a in fine:
        if q % 50 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in fine if i != q)[:5]
            expected += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    assert found == sorted(expected)
    assert exact_topk.top_products(frame.limit(0)).collect() == []


def test_topk_prunes_across_groups(spark, monkeypatch):
    """Clustered vectors whose ids are mixed: exact results from a small share of the blocks."""
    monkeypatch.setattr(exact_topk, "GROUP", 128)
    monkeypatch.setattr(exact_topk, "CHUNK", 16)
    monkeypatch.setattr(exact_topk, "BLOCK", 16)
    monkeypatch.setattr(exact_topk, "PIVOTS", 64)
    rng = np.random.default_rng(5)
    centers = rng.normal(0, 1, (24, 16))
    vectors = (centers[rng.integers(0, 24, 6000)] + rng.normal(0, 0.03, (6000, 16))).round(3)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    scored = spark.sparkContext.accumulator(0)
    found = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in exact_topk.top_products(frame, scored=scored).collect())
    whole = np.floor(256 * vectors).astype(np.int64)
    expected = []
    for q in range(0, 6000, 50):
        score = whole @ whole[q]
        first = [i for i in np.lexsort((np.arange(6000), -score)).tolist() if i != q][:5]
        expected += [(q, k + 1, i, int(score[i])) for k, i in enumerate(first)]
    assert found == sorted(expected)
    assert scored.value < 0.2 * 120 * 6000 / 16


def test_block_bounds_prune():
    """With queries near one block, most blocks are never scored."""
    rng = np.random.default_rng(2)
    groups = [rng.integers(0, 5, (64, 8)) + 40 * np.eye(8, dtype=int)[k % 8] * (1 + k // 8) for k in range(16)]
    c = np.concatenate(groups)
    ids, scores, there, scored = exact_topk._search(np.array([-1]), c[:1] * 0 + np.eye(8, dtype=int)[0] * 9, np.arange(len(c)), c, 5, 64)
    assert there.all() and scored <= 3 and scores[0, 0] == (c @ (np.eye(8, dtype=int)[0] * 9)).max()
