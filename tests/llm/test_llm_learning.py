"""Language profiles, the subword classifier, wrappers, mixing and the pipeline."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import language_profiles as lp, poisson_mix, queries, subword_classifier as sc, wrapper_extraction as we

SF = "/root/testdata/sf0.001"


def test_languages_held_out(spark):
    rows = queries.op2_language_profiles(spark, "/root/testdata/sf0.01").collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == r.held_out for r in rows)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.98 * len(held)


def test_profiles_and_distance_by_hand(spark):
    train = spark.createDataFrame([(1, "aab", "x"), (2, "aab ab", "x"), (3, "ccd", "y"), (4, None, "x"), (5, "zz", None)], "doc_id bigint, text string, lang string")
    profiles = lp.learn_profiles(train, "text", "lang")

    def grams(words):
        counts = Counter()
        for w in words:
            for n in (1, 2, 3):
                counts.update(g for g in (f"_{w}_"[i:i + n] for i in range(len(w) + 3 - n)) if g != "_")
        return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], sum(ord(c) << 21 * (len(x[0]) - 1 - i) for i, c in enumerate(x[0]))))]

    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    assert profiles == {"x": [code(g) for g in grams(["aab", "aab", "ab"])], "y": [code(g) for g in grams(["ccd"])]}
    own, ranks = grams(["ab", "b"]), {g: i for i, g in enumerate(grams(["aab", "aab", "ab"]))}
    distance = sum(abs(i - ranks[g]) if g in ranks else lp.PROFILE for i, g in enumerate(own))
    assert lp.Profiles(profiles).predict("ab b") == ("x", 1 - distance / (lp.PROFILE * len(own)))
    edges = spark.createDataFrame([(1, None, "q"), (2, "", "q"), (3, "12 ½ Ⅷ ... !", "q"), (4, "ab " * 20000, "q"), (4, "ab", "q"), (None, "漢字", "q")],
                                  "doc_id bigint, text string, lang_pred string")
    got = [(r.doc_id, r.lang_pred) for r in lp.identify(edges, profiles, kept=["doc_id"]).collect()]
    assert got == [(1, "und"), (2, "und"), (3, "und"), (4, "x"), (4, "x"), (None, "x")]
    assert lp.identify(edges.limit(0), profiles).count() == 0 and lp.identify(edges, {}).filter("lang_pred <> 'und'").count() == 0


def test_classifier_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op8_subword_quality(spark, sf).collect()
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in rows if r.held_out and r.doc_id in label]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert sum(r.predicted == label[r.doc_id] for r in held) >= 0.95 * len(held)


def test_word_numbers_equal_the_document_vector():
    text = "Some words, some other words and words again " * 3
    model = sc.train_on(sc.Counter().counted([text, "b c d e"]), [1, 0], epochs=3)
    [(buckets, counts)] = sc.Counter().counted([text])
    hidden = (counts / counts.sum()) @ model.vectors[buckets].astype(float)
    logits = model.output.astype(float) @ hidden + model.bias
    want = math.exp(logits[1]) / np.exp(logits).sum()
    assert sc.Scorer(model, 1).scores([text])[0] == pytest.approx(want, abs=1e-6)


def test_classifier_edges(spark):
    docs = spark.createDataFrame([(1, None, 5.0), (2, "", 5.0), (3, "a " * 30000, 5.0), (3, "x", 5.0), (None, "x", 5.0)], "doc_id bigint, text string, score double")
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert sc.fit(docs, none, "doc_id", "text", "quality") is None
    assert {r.score for r in sc.classify(docs, None, kept=["doc_id"]).collect()} == {0.5}
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (3, 1), (None, 0), (9, 1)], "doc_id bigint, quality int")
    model = sc.fit(docs, labels, "doc_id", "text", "quality")
    rows = sc.classify(docs, model, kept=["doc_id"]).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows) and sc.classify(docs.limit(0), model).count() == 0
    assert sc.keep_positive(docs, model, threshold=0.0).schema == docs.schema


PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var t="</p>";</script><style>p{{}}</style></head><body><nav><ul><li><a>m{n}</a></ul></nav>
<div class="cookie-notice">We use cookies</div><aside>side</aside><article><h1>Head {n}</h1><p>One &amp; two\n  three <b>bold</b>er<br>x<p>Open {n}
<ul><li>i1<li>i2</ul><form>f</form><div class="comments"><p>reader {n}</p></div></article><footer>&copy; f</footer></body></html>"""


def test_extraction(spark):
    rows = [(i, f"http://h{i % 2}.org/x", PAGE.format(n=i)) for i in range(6)] + [(6, None, None), (7, "", ""), (8, "http://h0.org", "<p"), (0, "http://h0.org/x", PAGE.format(n=0))]
    pages = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id bigint, url string, html string, text string, host int").repartition(3)
    got = {r.page_id: r for r in we.extract(pages).collect()}
    assert got[3].text == "Head 3\nOne & two three bolder x\nOpen 3\ni1\ni2" and got[3].n_chars == len(got[3].text)
    assert [got[i].text for i in (6, 7, 8)] == ["", "", ""] and we.extract(pages).count() == len(rows) and we.extract(pages.limit(0)).count() == 0


def test_template_texts_go_where_there_is_no_article(spark):
    rows = [(i, "http://h.org/", f"<body><div>Site name</div><div><p>Story {i}</p></div><div>All rights</div></body>") for i in range(5)]
    rows += [(i, "http://copies.org/", "<body><div>same</div></body>") for i in range(5, 8)]
    got = {r.page_id: r.text for r in we.extract(spark.createDataFrame(rows, "page_id int, url string, html string").repartition(3)).collect()}
    assert got[2] == "Story 2" and got[6] == "same"


def test_texts_of_few_pages_are_no_template(spark):
    rows = [(0, "http://one.org/", "<body><h1>Title</h1><p>a</p><p>b</p></body>")]
    rows += [(i, "http://h.org/", f"<body><div>Site name</div><h2>Story {i}</h2><p>text {i}</p><p>more {i}</p></body>") for i in range(1, 20)]
    rows += [(20, "http://h.org/", "<body><div>Site name</div><blockquote>Only quote</blockquote><p>x <b>bold</b> y</p><p>z</p></body>")]
    for parts in (1, 5):
        got = {r.page_id: r.text for r in we.extract(spark.createDataFrame(rows, "page_id int, url string, html string").repartition(parts)).collect()}
        assert got[0] == "Title\na\nb" and got[7] == "Story 7\ntext 7\nmore 7" and got[20] == "Only quote\nx bold y\nz"


def test_wrapper_decides_inside_articles(spark):
    page = ("<body><article><h1>Head {n}</h1><p>Same words</p><p>Text {n}</p><ul class='x'><li><a href='#'>Tweet</a><li><a href='#'>Mail</a></ul>"
            "<ul><li><a href='#'>Link {n}</a><li><a href='#'>Link {n} b</a></ul><div>Get our letter</div></article><div>Same words</div></body>")
    rows = [(i, "http://h.org/", page.format(n=i)) for i in range(12)] + [(i, "http://copies.org/", page.format(n=0)) for i in range(12, 30)]
    rows += [(30, "http://h.org/", "<body><article><h1>Head</h1><blockquote>Tweet</blockquote><p>Mail</p></article></body>")]
    for parts in (1, 4):
        got = {r.page_id: r.text for r in we.extract(spark.createDataFrame(rows, "page_id int, url string, html string").repartition(parts)).collect()}
        # A paragraph that all articles share stays, containers of template texts go.
        assert got[5] == "Head 5\nSame words\nText 5\nLink 5\nLink 5 b"
        assert got[30] == "Head\nTweet\nMail"
        assert got[20] == "Head 0\nSame words\nText 0\nTweet\nMail\nLink 0\nLink 0 b\nGet our letter"


def test_template_texts_are_counted_over_all_pages(spark):
    """The pages with the lowest hashes lack one text that nearly all others have, and all have one that a fifth of the others lack."""
    def page(n, *fixed):
        return f"<body><p>Text {n}</p>" + "".join(f"<div class='{f}'>Site {f}</div>" for f in fixed) + "</body>"

    def by_hash(start, *fixed):
        return sorted((page(n, *fixed) for n in range(start, start + 1000)), key=lambda p: we.page_hash(we.parse(p)))

    chosen = by_hash(0, "b")[:10] + by_hash(1000, "a", "b")[400:550] + by_hash(2000, "a")[-40:]
    rows = [(i, "http://h.org/", p) for i, p in enumerate(chosen * 2)]  # copies count once
    got = [r.text for r in we.extract(spark.createDataFrame(rows, "page_id int, url string, html string").repartition(3)).collect()]
    assert len(got) == 400 and not any("Site a" in t for t in got)
    assert sum("Site b" in t for t in got) == 320


@pytest.mark.parametrize("part", ['<section id="discussion"><p>x</p></section>', '<section class="discussion"><p>x</p></section>', '<h2 id="search-methods">x</h2>',
                                  '<h2 id="related-work">x</h2>', '<div class="social-history">x</div>', '<p id="form">x</p>', '<p title="the hidden cost">x</p>',
                                  '<a title="a hidden gem">x</a>', '<p data-class="ad" data-id="comments">x</p>', '<div class="section" id="comments">x</div>',
                                  "<p title='class=ad'>x</p>", '<p title="style=display:none">x</p>', '<div class="ad-hoc">x</div>', '<div class="header">x</div>'])
def test_parts_of_articles_stay(part):
    assert we.main_text(we.parse(f"<article><p>a</p>{part}<p>b</p></article>")) == "a\nx\nb"


@pytest.mark.parametrize("part", ['<div class="big ad">x</div>', '<section class="comments">x</section>', '<article class="comment">x</article>', '<div id="comments">x</div>',
                                  '<ul class="share-buttons"><li>x</ul>', '<p hidden>x</p>', '<p hidden="">x</p>', "<p aria-hidden='true'>x</p>", '<p style="color:red;display: none">x</p>',
                                  '<div role="search">x</div>', '<DIV CLASS=ADVERT>x</DIV>', '<div class="notice">x</div>', '<ul class="menu"><li>x</ul>',
                                  '<div id="related"><a>x</a> <a>x</a></div>', "<div>" * 150 + "<nav><div>x</div></nav>" + "</div>" * 150])
def test_furniture_of_articles_goes(part):
    assert we.main_text(we.parse(f"<article><p>a</p>{part}<p>b</p></article>")) == "a\nb"


def test_part_words_need_the_wrapper(spark):
    rows = [(i, "http://h.org/", f"<article><p>Text {i}</p><div class='notice'>All rights</div><div id='related'><a>r {i}</a><a>s</a></div>"
             f"<section id='notice'>Own notice {i}</section></article>") for i in range(3)]
    got = {r.page_id: r.text for r in we.extract(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert got[1] == "Text 1\nOwn notice 1"


def test_quotes_count_after_equals_only():
    page = "<p title=it's>one</p><p>two</p><p>don't three</p><p data-x = 'a>b' y=\"c>d\">four</p><p x='>five</p>"
    assert we.main_text(we.parse(page)) == "one\ntwo\ndon't three\nfour\nfive"


def test_long_constant_lists_and_shared_headings(spark):
    menu = "".join(f"<li><a href='#'>Constant {i}</a>" for i in range(100))
    rows = [(i, "http://h.org/", f"<body><ul>{menu}</ul><p>Story {i}</p></body>") for i in range(30)]
    rows += [(100 + i, "http://a.org/", f"<article><h2>Ingredients</h2><p>Dear reader,</p><section><h3>Abstract</h3><p>Own {i}</p></section>"
              "<div><p>Share</p><p>this</p></div></article>") for i in range(20)]
    for parts in (1, 4):
        got = {r.page_id: r.text for r in we.extract(spark.createDataFrame(rows, "page_id int, url string, html string").repartition(parts)).collect()}
        assert got[7] == "Story 7" and got[104] == "Ingredients\nDear reader,\nAbstract\nOwn 4"


def test_deep_pages():
    deep = "<div>" * 300 + "<p>a<nav>MENU<div>more</div></nav>b" + "</div>" * 300 + "<p>end"
    assert we.main_text(we.parse(deep)).split() == ["a", "b", "end"]
    assert we.main_text(we.parse("<nav>" + "<div>" * 300 + "x" + "</div>" * 300 + "</nav><p>y")) == "y"


def test_wrapper_is_union_free():
    pages = ["<ul><li><a>1</a></li><li><a>2</a></li></ul><p>x</p>", "<ul><li><a>3</a></li></ul><b>new</b><p>y</p>", "<ul></ul><p>z</p><p>w</p>"]
    wrapper = we.infer(we.parse(pages[0]))
    for page in pages[1:]:
        wrapper = we._merge_node(wrapper, we.infer(we.parse(page)))
    assert we.expression(wrapper) == "<> <ul> (<li> <a> TEXT </> </>)* </> (<b> '=" + we._text_key("new")[:6] + "' </>)? (<p> TEXT </>)+ </>"


@pytest.mark.parametrize("page", ["", None, "<", "<p", "a<b", "<<>>", "</p></p>", "<div>" * 3000 + "x", "<li>" * 3000, "<script>", "&#xZZ;&am", "<a b='c>d", "x" * 50000])
def test_broken_pages(page):
    root = we.parse(page)
    we.infer(root)
    assert isinstance(we.main_text(root), str)


def test_poisson_draws(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "big" if i % 10 else "small") for i in range(4000)], "doc_id bigint, text string, source string").repartition(6)
    rows = poisson_mix.replicate(docs, weights={"big": 0.5, "small": 0.5}).collect()
    size = Counter()
    for r in rows:
        size[r.source] += len(r.text) + 1
    assert abs(size["big"] / sum(size.values()) - 0.5) < 0.03
    counts = Counter(r.doc_id for r in rows if r.source == "small")
    mean = sum(counts.values()) / 400
    variance = sum((counts[i] - mean) ** 2 for i in range(0, 4000, 10)) / 400
    assert abs(mean - 5) < 0.4 and abs(variance / mean - 1) < 0.25
    assert sorted(rows) == sorted(poisson_mix.replicate(docs.repartition(3), weights={"big": 0.5, "small": 0.5}).collect())
    keys = [r.order_key for r in rows]
    assert keys == sorted(keys)
    plan = poisson_mix.replicate(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Cartesian"))


def test_poisson_inversion_matches_the_distribution(spark):
    row = spark.range(1).select(poisson_mix.cumulative(F.lit(3.5)).alias("c")).first()
    total, term = 0.0, math.exp(-3.5)
    for k, c in enumerate(row.c):
        total += term
        term = term * 3.5 / (k + 1)
        assert c == pytest.approx(total, abs=1e-14)


def test_mixing_edges(spark):
    schema = "doc_id bigint, text string, source string, copy int, n string, doc string"
    assert poisson_mix.mix(spark.createDataFrame([], schema)).count() == 0
    docs = spark.createDataFrame([(1, None, None, 7, "n", "d"), (2, "", "a", 7, "n", "d"), (2, "", "a", 7, "n", "d"), (None, "x " * 20000, "b", 7, "n", "d")], schema)
    rows = poisson_mix.mix(docs, epochs=50.0)
    assert rows.columns == docs.columns
    assert {r.copy for r in rows.collect()} == {7} and len({(r.doc_id, r.source) for r in rows.collect()}) == 3
    counts = Counter(r.doc_id for r in rows.collect())
    assert counts[2] % 2 == 0


def test_pipeline_stages(spark):
    """Each stage against a direct version on its own input."""
    from tidemark.llm import repetition

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    original = docs.collect()
    ruled = corpus_pipeline.quality_rules(spark, docs, SF)
    assert sorted(ruled.collect()) == sorted(r for r in original if repetition.measure(r.text)[6])
    good = corpus_pipeline.quality_classifier(spark, ruled, SF)
    model = queries.quality_model(spark, SF)
    assert sorted(good.collect()) == sorted(r for r in ruled.collect() if sc.Scorer(model, 1).scores([r.text])[0] >= 0.5)
    single = corpus_pipeline.near_duplicates(spark, good, SF)
    sets = {r.doc_id: frozenset(zip(*(r.text.split()[i:] for i in range(5)))) for r in good.collect()}
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = {i: min(x, y) if r in (x, y) else r for i, r in root.items()}
    assert sorted(r.doc_id for r in single.collect()) == sorted(i for i, r in root.items() if i == r)
    mixed = corpus_pipeline.mixing(spark, single, SF)
    assert mixed.columns == docs.columns and set(mixed.collect()) <= set(single.collect())
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert sum(r.length for r in pieces) == sum(r.length for r in corpus_pipeline.pack(spark, mixed, SF).collect())
    assert {r.doc_id for r in pieces} == {r.doc_id for r in mixed.collect()}
