import html
import re
import time
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from arborfolio.llm import embedding_dedup, html_text, language, neighbours, simhash, toxicity
from arborfolio.llm.components import components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string"
ODD = [(1, None, None, None, None, 1.0, "x"), (2, "", "en", "s", 0, None, None), (None, "12 34", "en", "s", 1, None, None), (4, "the idiot " * 9000, "en", "s", 2, None, None), (4, "the idiot " * 9000, "en", "s", 2, None, None), (5, "Été", "fr", None, 3, None, None)]


# HTML

PAGE = """<html><head><title>t</title><style>p{}</style></head><body><nav><a href=/>Home</a></nav>
<div class="ad">Buy this now and here</div><header>Site name</header><article><h1>A  title &amp; more</h1><p>One <b>bold</b>
 word<p>Two <a href=x>linked</a> words, and a long enough sentence to be text.<br>Three</p><aside>Side</aside>
<script>var x="</p>"</script><!-- note --><form><input value=q></form></article><div id="comments"><p>Great article, thank you very much indeed!</p></div>
<footer>&copy; all</footer>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "A title & more\nOne bold word\nTwo linked words, and a long enough sentence to be text.\nThree"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<script>x</script>") == ""
    assert html_text.main_text("<p>caf&eacute; &lt;b&gt;</div></i>") == "café <b>"
    many_links = "<body><div>" + "<a href=x>Some link text</a> " * 40 + "</div><div><p>" + "Plain words of the article go on. " * 5 + "</p><p>" + "More of it here. " * 5 + "</p></div></body>"
    assert html_text.main_text(many_links).startswith("Plain words") and "link" not in html_text.main_text(many_links)


def _section(name, count, tag="section"):
    return f"<{tag}>" + "".join(f"<p>{name} {i}: " + "plain words of it " * 11 + "</p>" for i in range(count)) + f"</{tag}>"


@pytest.mark.parametrize("tag", ["section", "div"])
@pytest.mark.parametrize("outer", ["article", "div"])
@pytest.mark.parametrize("counts", [(10, 10), (10, 10, 10), (10, 4)])
def test_main_text_of_several_sections(tag, outer, counts):
    links = "<div>" + "<a href=x>Some link text</a> " * 40 + "</div>"
    page = f"<body>{links}<{outer}><h1>The title</h1>" + "".join(_section(f"s{k}", n, tag) for k, n in enumerate(counts)) + f"</{outer}></body>"
    lines = html_text.main_text(page).split("\n")
    assert [x.split(":")[0] for x in lines if x != "The title"] == [f"s{k} {i}" for k, n in enumerate(counts) for i in range(n)]
    assert lines[0] == "The title"


def test_main_text_of_lists():
    paragraphs, items = "".join(f"<p>Paragraph {i} " + "has plain words " * 12 + "</p>" for i in range(3)), "".join(f"<li>item {i} with some words</li>" for i in range(60))
    lines = html_text.main_text(f"<body><article><h1>T</h1>{paragraphs}<ul>{items}</ul></article></body>").split("\n")
    assert len(lines) == 64 and lines[0] == "T" and lines[-1].startswith("item 59")


@pytest.mark.parametrize("name", ["content has-sidebar", "no-header", "article-header", "search-results", "legal-text", "widget-body", "header", "widget"])
@pytest.mark.parametrize("inner", ["article", "div"])
def test_wrappers_keep_their_article(name, inner):
    rest = '<div class="site-header">Name of the site</div><div class="sidebar">Short words beside it</div><div class="cookie-notice">We use them</div>'
    page = f'<body>{rest}<div class="{name}"><{inner}>{_section("a", 3)}</{inner}></div><div id="mainNav">Go here</div></body>'
    assert [x.split(":")[0] for x in html_text.main_text(page).split("\n")] == ["a 0", "a 1", "a 2"]


def test_whole_page_form():
    page = f'<body><form id="aspnetForm"><input type=hidden value=q><div class="header">Name of the site</div><div>{_section("a", 4)}</div><select><option>One</select></form></body>'
    assert [x.split(":")[0] for x in html_text.main_text(page).split("\n")] == ["a 0", "a 1", "a 2", "a 3"]
    comments = "".join(f'<article class="comment-body">{_section("c", 9)}</article>' for _ in range(3))
    page = f'<body><article>{_section("a", 3)}</article><div id="comments" class="comments-area">{comments}</div></body>'
    assert [x.split(":")[0] for x in html_text.main_text(page).split("\n")] == ["a 0", "a 1", "a 2"]


REPLY_NAMES = ['id="disqus_thread"', 'class="comment-thread"', 'class="fb-comments"', 'class="comments-section"', 'id="comments"', 'class="post-comments"', 'class="user-comment"', 'class="author-comments"', 'class="comment-text"']
OTHER_NAMES = ["google-ads", "share-tools", "related-stories", "related-articles", "subscribe-cta", "breadcrumb-trail", "most-read"]


@pytest.mark.parametrize("holder", ["article", 'div class="story"'])
@pytest.mark.parametrize("name", REPLY_NAMES)
def test_long_comments_are_never_the_article(holder, name):
    story, comments = _section("story", 2), "".join(_section(f"reply{k}", 6) for k in range(5))
    want = ["The headline", "story 0", "story 1"]
    lines = lambda page: [x.split(":")[0] for x in html_text.main_text(page).split("\n")]
    tag = holder.split()[0]
    assert lines(f"<body><nav><a href=/>Home</a></nav><{holder}><h1>The headline</h1>{story}</{tag}><section {name}>{comments}</section></body>") == want
    assert lines(f"<body><{holder}><h1>The headline</h1>{story}<div {name}>{comments}</div></{tag}><footer>end</footer></body>") == want
    assert lines(f"<body><{holder}>{story}</{tag}><section {name}>{comments}</section></body>") == want[1:]


@pytest.mark.parametrize("holder", ["article", 'div class="story"'])
@pytest.mark.parametrize("name", OTHER_NAMES)
def test_adverts_menus_and_related_parts_go(holder, name):
    tag = holder.split()[0]
    other = f'<div class="{name}"><p>Something else to look at, to read or to buy.</p><a href=x>Here</a></div>'
    page = f"<body><{holder}><h1>The headline</h1>{_section('a', 2)}{other}{_section('b', 2)}</{tag}>{other}</body>"
    assert [x.split(":")[0] for x in html_text.main_text(page).split("\n")] == ["The headline", "a 0", "a 1", "b 0", "b 1"]


def test_own_header_of_an_article_and_named_wrappers_stay():
    page = f"<body><header>Name of the site</header><article><header><h1>The headline</h1><p>By a writer</p></header>{_section('a', 3)}</article></body>"
    assert [x.split(":")[0] for x in html_text.main_text(page).split("\n")] == ["The headline", "By a writer", "a 0", "a 1", "a 2"]
    for name in ("comments-open", "has-comments", "ad-free", "social-post"):
        for inner in (f"<article>{_section('a', 3)}</article>", f"<h1>a</h1>{_section('a', 3)}", f"<div>{_section('a', 3)}</div>"):
            page = f'<body><div class="{name}">{inner}</div><div class="footer">All rights</div></body>'
            assert [x.split(":")[0] for x in html_text.main_text(page).split("\n")][-3:] == ["a 0", "a 1", "a 2"], (name, inner)


def test_an_article_goes_before_longer_text_beside_it():
    page = f"<body><article><h1>The headline</h1>{_section('a', 1)}</article><div><ul>" + "<li>short entry in a list of words</li>" * 200 + "</ul></div></body>"
    lines = html_text.main_text(page).split("\n")
    assert [x.split(":")[0] for x in lines[:2]] == ["The headline", "a 0"]


def test_extract_rows(spark):
    rows = [(1, "u", PAGE, "x"), (None, None, None, None), (3, "u", "", "x"), (3, "u", "", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_text.extract(pages).collect()
    assert [len(r.text) for r in got] == [r.n_chars for r in got] and len(got) == 4 and sum(r.text == "" for r in got) == 3
    assert html_text.extract(pages.where("false")).count() == 0


def test_op1_equals_articles(spark):
    pages = {r.page_id: r for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    got = html_text.op1_html_text(spark, "/root/testdata/sf0.01")
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    rows = got.collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search("<article>(.*?)</article>", pages[r.page_id].html, re.S)[1]
        want = html.unescape(re.sub(r"<[^>]*>", "", article))
        assert "".join(r.text.split()) == "".join(want.split()) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_densities_equal_brute_force():
    page = PAGE + "<div><ul><li><a href=x>Link <b>one</b></a> and more<li>two<ul><li><a>deep</a></ul></ul></div>" + _section("s", 3)
    builder = html_text.TreeBuilder()
    builder.feed(page)
    order = html_text.measure(builder.root)
    body = next(n for n in order if n.tag == "body")
    html_text.set_densities(order, body)

    def kids(n):
        return [c for c in n.children if not isinstance(c, str)]

    def below(n):
        return [m for c in kids(n) for m in (c, *below(c))]

    def chars(n, linked=False):
        linked = linked or n.tag == "a"
        own = sum(len("".join(c.split())) for c in n.children if isinstance(c, str))
        parts = [chars(c, linked) for c in kids(n)]
        return own + sum(p[0] for p in parts), own * linked + sum(p[1] for p in parts)

    for n in order:
        c, lc = chars(n)
        t, lt = max(1, len(below(n))), max(1, 1 if n.tag == "a" else sum(m.tag == "a" for m in below(n)))
        bc, blc = chars(body)
        want = 0.0
        if 0 < c and lc < c:
            want = c / t * max(0.0, np.log(c * t / (max(1, lc) * lt))) / np.log(c * lc / (c - lc) + blc / bc * c + np.e)
        assert abs(n.density - want) < 1e-9
        assert abs(n.sum - (sum(k.density for k in kids(n)) or n.density)) < 1e-9


@pytest.mark.parametrize(
    "page",
    ["<div>" * 8000 + "</x>" * 8000, "<!--" * 250_000, "<a x=" * 200_000, "<p><button>" + "<i>" * 80_000 + "<hr>" * 80_000, "<" * 1_000_000, "<a x='" * 100_000 + '"', "<article>" + "<div><p>some words</p>" * 20_000],
)
def test_long_and_deep_pages_take_seconds(page):
    start = time.time()
    html_text.main_text(page)
    assert time.time() - start < 20


def test_page_with_unclosed_and_odd_markup():
    assert html_text.main_text("<body><p>1 < 2 and 3 <4 words</p><p>go on &amp; on<!-- never closed <p>x") == "1 < 2 and 3 <4 words\ngo on & on"
    assert html_text.main_text("<body><SCRIPT>a</b></Script ><P>Words of <B>it</b>.<BR/>More</P><script>x") == "Words of it.\nMore"
    assert html_text.main_text('<body><p title="a > b" class=\'c>\'>Words</p></><?x y?><!DOCTYPE html><p>and more') == "Words\nand more"


# Language and toxicity


def test_language_learns_and_takes_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, lang, None, 0, None, None) for i, (t, lang) in enumerate([("the house is green and old", "en"), ("das haus ist alt und schön", "de")] * 5)], DOCS)
    model = language.fit(docs)
    asked = spark.createDataFrame([*ODD, (7, "the green houses", "de", None, 0, None, None), (8, "schönes altes", None, None, 0, None, None)], DOCS)
    got = language.identify(asked, model).collect()
    told = {r.doc_id: r.lang_pred for r in got}
    assert len(got) == 8 and told[7] == "en" and told[8] == "de" and told[1] == told[2] == told[None] == "und"
    assert all(0 <= r.score <= 1 for r in got)
    nothing = language.fit(docs.where("false"))
    assert {r.lang_pred for r in language.identify(asked, nothing).collect()} == {"und"}


def test_language_held_out_accuracy(spark):
    got = language.op4_language_id(spark, "/root/testdata/sf0.01")
    assert got.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    got = got.join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.98


def brute_language(train, asked):
    """(language, probability at temperature one) by dicts, straight from the definition."""
    counts = defaultdict(Counter)
    for lang, text in train:
        for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
            counts[lang, 0][w] += 1
            for n in range(1, 5):
                counts[lang, n].update(f" {w} "[i : i + n] for i in range(len(w) + 3 - n))
    langs = sorted({lang for lang, _ in counts})
    total = {k: sum(c.values()) for k, c in counts.items()}
    floor = {n: -np.log10(max(t for (_, m), t in total.items() if m == n)) - 1 for n in range(5)}

    def term(n, t):
        return np.array([np.log10(counts[x, n][t] / total[x, n]) if counts[x, n][t] else floor[n] for x in langs])

    def word(w):
        if any(counts[x, 0][w] for x in langs):
            return term(0, w)
        for n in range(4, 0, -1):
            known = [g for g in (f" {w} "[i : i + n] for i in range(len(w) + 3 - n)) if any(counts[x, n][g] for x in langs)]
            if known:
                return np.mean([term(n, g) for g in known], axis=0)
        return np.zeros(len(langs))

    found = []
    for text in asked:
        sums = sum(word(w) for w in re.findall(r"[^\W\d_]+", text.lower()))
        odds = np.exp(np.log(10) * (sums - sums.max()))
        found.append((langs[int(sums.argmax())], odds.max() / odds.sum()))
    return found


def test_language_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit_language(docs)
    train = [r for r in docs.where(~language.held_out(5, 0) & F.col("lang").isNotNull()).withColumn("tries", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)) == 0).collect() if not r.tries]
    asked = [r.text for r in docs.orderBy("doc_id").limit(40).collect()] + ["zzz dess", "unes", "thereof ungst", "a"]
    frame = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string")
    got = {r.doc_id: r for r in language.identify(frame, {**model, "temperature": 1.0}).collect()}
    for i, (lang, score) in enumerate(brute_language([(r.lang, r.text) for r in train], asked)):
        assert got[i].lang_pred == lang and abs(got[i].score - score) < 1e-3


def test_language_sample_is_bounded_and_holds_hot_rows(spark):
    rows = [(i % 900 if i % 3 else 7, f"text {i}", "en" if i % 10 else "de") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.sample_of(docs, 50).collect()
    sizes = Counter(r.lang for r in got)
    assert sizes["en"] == 50 and 40 <= sizes["de"] <= 50 and len({(r.doc_id, r.lang) for r in got}) == len(got)
    assert sum(len(r.text) for r in language.sample_of(docs, 50, 100).collect()) <= 200


def test_language_sample_of_repeated_rows_is_full(spark):
    repeated = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"), F.lit("en").alias("lang"))
    repeated = repeated.crossJoin(spark.range(200).select()).unionByName(spark.range(100, 130).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"), F.lit("de").alias("lang")))
    got = Counter(r.lang for r in language.sample_of(repeated, 50).collect())
    assert got == {"en": 50, "de": 30}


def dense_votes(query, examples, k):
    scores = [(sum(w * e.get(t, 0.0) for t, w in query.items()), i) for i, e in enumerate(examples)]
    return sorted(((s, i) for s, i in scores if s > 0), key=lambda x: (-round(x[0], 12), x[1]))[:k]


@pytest.mark.parametrize("block,common", [(16, 2.0), (16, 0.3), (512, 0.3)])
def test_block_max_is_exact(monkeypatch, block, common):
    monkeypatch.setattr(toxicity, "COMMON", common)
    rng = np.random.default_rng(3)
    vectors = []
    for i in range(400):
        terms = np.sort(rng.choice(60, rng.integers(1, 9), replace=False)) if i % 5 else np.array([3, 7])  # ties
        w = rng.random(len(terms)) + 0.01 if i % 5 else np.ones(2)
        vectors.append((terms.astype(np.int32), w / np.linalg.norm(w)))
    index = toxicity.BlockMaxIndex(vectors, 60, block=block)
    plain = [dict(zip(t.tolist(), w.tolist())) for t, w in vectors]
    queries = vectors[::7]
    for (terms, w), near in zip(queries, index.nearest(queries, 10)):
        want = dense_votes(dict(zip(terms.tolist(), w.tolist())), plain, 10)
        assert [(i, round(s, 9)) for s, i in near] == [(i, round(s, 9)) for s, i in want]


def test_toxicity_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    examples = sorted(toxicity.examples_of(docs, labels).collect(), key=lambda r: r.doc_id)
    known = labels.where(~language.held_out(4, 2)).agg(F.count("*"), F.sum("toxic")).first()
    assert (len(examples), sum(r.toxic for r in examples)) == tuple(known) and {r.stands_for for r in examples} == {1.0}

    def counts(text):
        words = re.findall(r"[^\W\d_]+", (text or "").lower())
        return Counter(words + [w[:5] + "-" for w in words if len(w) > 5])

    held = [counts(r.text) for r in examples]
    n, a = Counter(t for c in held for t in c), Counter(t for c, r in zip(held, examples) if r.toxic for t in c)
    texts = docs.orderBy("doc_id").collect()
    df, p = Counter(t for r in texts for t in counts(r.text) if t in n), sum(r.toxic for r in examples) / len(examples)

    def weight(t):
        x, y = a[t], n[t] - a[t]
        lean = (x * np.log(x / (n[t] * p)) if x else 0) + (y * np.log(y / (n[t] * (1 - p))) if y else 0)
        return np.log(1 + len(texts) / df[t]) * (1 + lean / np.log(len(n)))

    weights = {t: weight(t) for t in n}

    def vector(c):
        v = {t: (1 + np.log(k)) * weights[t] for t, k in c.items() if t in weights}
        norm = np.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    plain, curve = [vector(c) for c in held], toxicity.fit(docs, labels)["curve"]
    got = {r.doc_id: r for r in toxicity.op5_toxicity(spark, sf).collect()}
    assert len(got) == len(texts)
    for r in texts[::25]:
        near = dense_votes(vector(counts(r.text)), plain, 15)
        own = 0.2
        vote = (sum(s * s for s, i in near if examples[i].toxic) + own * p) / (sum(s * s for s, _ in near) + own)
        want = 1 / (1 + np.exp(-(curve[0] * np.log(vote / (1 - vote)) + curve[1])))
        assert abs(got[r.doc_id].score - want) < 1e-6 and got[r.doc_id].predicted == int(want >= 0.3)


def test_toxicity_curve():
    rng = np.random.default_rng(1)
    votes = rng.random(4000)
    toxic = (rng.random(4000) < 1 / (1 + np.exp(-(0.5 * np.log(votes / (1 - votes)) - 1)))).astype(int)
    a, b = toxicity.fit_curve(votes, toxic, np.ones(4000))
    assert abs(a - 0.5) < 0.15 and abs(b + 1) < 0.15
    assert toxicity.fit_curve(votes, np.zeros(4000), np.ones(4000)) == (1.0, 0.0)


def test_toxicity_finds_marked_words(spark):
    rng = np.random.default_rng(0)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    rows = [(i, " ".join([word() for _ in range(12)] + (["vilest"] if i % 5 == 0 else [])), None, None, 0, None, None) for i in range(600)]
    docs = spark.createDataFrame([*rows, *((100_000 + (r[0] or 0), *r[1:]) for r in ODD)], DOCS)
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(500)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all(got[i].predicted == int(i % 5 == 0) for i in range(600))
    assert got[100_001].predicted == got[100_002].predicted == 0 and got[595].evidence[0].cosine > 0.8
    empty = toxicity.fit(docs, labels.where("false"))
    assert {r.score for r in toxicity.score(docs, empty).collect()} == {0.0}


def test_toxicity_examples_are_bounded_and_stand_for_the_rest(spark):
    rows = [(i % 400 if i % 3 else 5, f"text {i} " + "w" * (i % 7)) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(8, 0)], "doc_id long, toxic int")
    known = labels.where(~language.held_out(4, 2)).select("doc_id").distinct().count()
    got = toxicity.examples_of(docs, labels, per_label=60).collect()
    sizes = Counter(r.toxic for r in got)
    assert len({r.doc_id for r in got}) == len(got) and max(sizes.values()) <= 60
    assert abs(sum(r.stands_for for r in got) - known) < 1e-6
    assert sum(len(r.text) for r in toxicity.examples_of(docs, labels, label_bytes=200).collect()) <= 400


# SimHash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_groups(items, linked):
    parent = list(range(len(items)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(items))]


def test_simhash_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    prints = [brute_fingerprint(d.text) for d in docs]
    roots = brute_groups(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    got = {r.doc_id: r for r in simhash.op10_simhash(spark, SF).collect()}
    for d, p, root in zip(docs, prints, roots):
        assert got[d.doc_id].fingerprint == f"{p:016x}" and got[d.doc_id].component_id == docs[root].doc_id


def test_simhash_odd_rows(spark):
    docs = spark.createDataFrame(ODD, DOCS)
    got = simhash.near_copies(docs).collect()
    told = {r.doc_id: r.component_id for r in got}
    assert len(got) == 6 and told[2] == told[1] == 1 and told[4] == 4
    assert simhash.near_copies(docs.where("false")).count() == 0


@pytest.mark.parametrize("crowd", [50, 4096])
def test_simhash_links_crowded_shards(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "SHARD_ROWS", crowd)
    rng = np.random.default_rng(1)
    prints = {int(x) for x in rng.integers(0, 2**62, 200)}
    base = 0x0123456789ABCDEF
    for _ in range(300):
        p = base
        for b in rng.integers(0, 64, rng.integers(0, 9)):
            p ^= 1 << int(b)
        prints.add(p)
    prints = sorted(prints)
    roots = brute_groups(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    frame = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p,) for p in prints], "fp long")
    from arborfolio.llm.shared import Workspace

    found = components(simhash.links(frame, len(prints), Workspace(spark, "t")))
    label = {r.node % 2**64: r.component % 2**64 for r in found.collect()}
    groups, want = defaultdict(set), defaultdict(set)
    for p, r in zip(prints, roots):
        groups[label.get(p, p)].add(p)
        want[r].add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_components_of_hubs(spark, monkeypatch):
    monkeypatch.setattr("arborfolio.llm.components.HUB_EDGES", 20)
    edges = spark.createDataFrame([(7, 100 + i) for i in range(90)] + [(150, 3), (300, 301)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert all(got[x] == 3 for x in (7, 3, *range(100, 190))) and got[301] == 300 and len(got) == 94


def test_one_of_each_keeps_rows_with_equal_ids(spark):
    rows = [(1, "one text of some words here", "a"), (1, "another text with other words", "b"), (1, "one text of some words here", "a"), (2, "one text of some words here", "c"), (None, "a third text that has no id", "d"), (None, "another text with other words", "e")]
    got = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, __turn string")).collect()
    assert sorted((r.doc_id or 0, r["__turn"]) for r in got) == [(0, "d"), (1, "a"), (1, "b")]
    assert simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, k string").where("false")).count() == 0


def test_components_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[101] == 100


# Vectors


def vectors(spark, n=900, copies=120):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((n, 64)).astype(np.float32)
    x[200:320] = x[7] + 0.15 * rng.standard_normal((120, 64)).astype(np.float32)
    x[400 : 400 + copies] = x[9]
    rows = [(i, v.tolist(), i % 3, "z") for i, v in enumerate(x)]
    rows += [(2000, None, 0, None), (2001, [0.0] * 64, 0, None), (2002, [float("nan")] * 64, 1, None), (2003, [None] * 64, 1, None), (2004, [], 1, None), (None, x[1].tolist(), 1, None), (2005, [1.0, 2.0], 1, None)]
    return x, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n_links string")


@pytest.mark.parametrize("cell,part", [(4096, 4096), (100, 40)])
def test_embedding_links_equal_brute_force(spark, monkeypatch, cell, part):
    monkeypatch.setattr(embedding_dedup, "CELL_ROWS", cell)
    monkeypatch.setattr(embedding_dedup, "PART_ROWS", part)
    x, frame = vectors(spark)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    roots = brute_groups(range(len(x)), lambda i, j: near[i, j])
    got = {r.vec_id: r for r in embedding_dedup.link_near(frame).collect()}
    assert len(got) == len(x) + 7
    for i in range(len(x)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (near[i].sum(), roots[i], roots[i] == i)
    assert all(got[i].n_links == 0 and got[i].kept for i in range(2000, 2006)) and not got[None].kept
    assert embedding_dedup.link_near(frame.where("false")).count() == 0


def test_nearest_neighbours_recall(spark):
    x, frame = vectors(spark)
    got = defaultdict(dict)
    for r in neighbours.nearest(frame, F.col("vec_id") % 100 == 0).collect():
        got[r.query_id][r.rank] = (r.vec_id, r.score)
    hits = 0
    queries = range(0, 900, 100)
    for q in queries:
        far = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        far[q] = np.inf
        want = np.lexsort((np.arange(len(x)), far))[:10]
        assert sorted(got[q]) == list(range(1, 11))
        assert all(abs(far[v] - s) < 1e-9 for v, s in got[q].values())
        hits += len(set(want.tolist()) & {v for v, _ in got[q].values()})
    assert hits / (10 * len(queries)) >= 0.95
    assert [v for v, _ in sorted(got[400].values(), key=lambda p: (p[1], p[0]))] == [9, *range(401, 410)]
    assert neighbours.nearest(frame.where("false"), F.col("vec_id") % 100 == 0).count() == 0


def test_nearest_neighbours_recall_of_many_vectors(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((20_000, 64)).astype(np.float32)
    x[10_000:] = rng.standard_normal((50, 64)).astype(np.float32)[rng.integers(0, 50, 10_000)] + 0.3 * x[10_000:]
    frame = spark.createDataFrame(pd.DataFrame({"vec_id": range(len(x)), "embedding": list(map(np.ndarray.tolist, x))}), "vec_id long, embedding array<float>")
    got = neighbours.nearest(frame, F.col("vec_id") % 100 == 0).toPandas()
    wide = x.astype(float)
    hits = 0
    for q, rows in got.groupby("query_id"):
        far = ((wide - wide[q]) ** 2).sum(axis=1)
        far[q] = np.inf
        hits += len(set(np.argpartition(far, 10)[:10].tolist()) & set(rows.vec_id))
    assert len(got) == 2000 and hits / 2000 >= 0.9


def test_nearest_neighbours_query(spark):
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    got = neighbours.op2_nearest_neighbours(spark, SF).collect()
    assert {r.query_id for r in got} == {v for v in rows if v % 100 == 0}
    for r in got:
        assert abs(np.linalg.norm(np.array(rows[r.query_id], float) - np.array(rows[r.vec_id], float)) - r.score) < 1e-9


def test_embedding_query_equals_its_sql(spark):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.op3_embedding_dedup(spark, SF).collect()}
    assert got == set(duck.sql(embedding_dedup.OP3_SQL).fetchall())


# Pipeline


def test_pipeline_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "near_copies", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.unionByName(spark.createDataFrame([(900_001, None, "en", "s", 0), (900_002, "123 $$", "en", "s", 0), (900_003, "", None, None, None)], docs.schema))
    told = corpus_pipeline.keep_known_language(spark, odd, SF)
    assert told.columns == docs.columns and told.count() == docs.count()
    clean = corpus_pipeline.drop_toxic(spark, told, SF)
    assert clean.columns == docs.columns and 0.8 * docs.count() < clean.count() <= docs.count()
    kept = corpus_pipeline.drop_near_copies(spark, clean, SF)
    groups = Counter(r.component_id for r in simhash.near_copies(clean).collect())
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(groups)
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(groups)
    assert sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0)
