"""Page extraction, the language network, and the pipeline against plain Python."""

import html
import random
import re

import brute
import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from pyspark.sql import functions as F

import corpus_pipeline
from tidewave.llm import language, wrapper
from tidewave.llm.queries import op4_wrapper_induction, op6_language
from tidewave.llm.words import LETTERS, NOT_SPACE, pieces, words_of


def page(body, **more):
    return f"<html><head><title>T</title></head><body><nav><a>Home</a></nav>{body}<footer>F</footer></body></html>"


def texts_of(spark, rows, **options):
    df = spark.createDataFrame([(*r, "old") for r in rows], "page_id long, url string, html string, text string")
    return {r.page_id: r.text for r in wrapper.extract(df, **options).collect()}


def test_pages_query_against_the_article_element(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in op4_wrapper_induction(spark, SF).collect():
        body = re.search("<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        want = " ".join(html.unescape(re.sub("<[^>]*>", "", re.sub("</?(p|h1|br)>", " ", body))).split())
        assert r.text == want and r.n_chars == len(want)


def test_pieces_that_are_not_content(spark):
    body = """<header><h1>Site</h1></header><div class="cookie notice">We use cookies</div><aside>Side</aside>
    <article><header><h1>Head &amp; line</h1></header><p>One <b>bold</b>er&nbsp;x<br>two<p>Three &lt;4&gt;<script>var t="<p>no";</script>
    <form><p>Sign up</p></form><div class="ad">Buy</div><table><tr><td>a<td>b</table></article>
    <section id="comments"><article>First!</article></section><style>p{}</style><!-- <p>no</p> -->"""
    got = texts_of(spark, [(1, "http://a/1", page(body)), (2, None, None), (3, "http://a/2", ""), (4, "x", "plain &eacute; text"), (5, "http://b", "<p>un<p>closed <div")])
    assert got == {1: "Head & line One bolder x two Three <4> a b", 2: "", 3: "", 4: "plain é text", 5: "un closed"}


def test_constant_nodes_become_template_and_slots_content(spark):
    rows = [(i, f"https://Host.example/{i}", f"<body><div class=top><p>Welcome to our site</p></div><div class=story><h2>Title {i}</h2><p>Body {i} {'word ' * 30}</p>"
             f"<div class=note><p>Read more on our site</p></div></div></body>") for i in range(12)]
    for limit in (0, 1 << 20):
        got = texts_of(spark, rows, broadcast_bytes=limit)
        assert all(got[i] == f"Title {i} Body {i} {'word ' * 30}".strip() for i in range(12))


def test_copies_do_not_make_an_article_template(spark):
    story = "<h1>One title</h1><p>One lead</p><p>One body " + "word " * 30 + "</p>"
    want = "One title One lead One body " + "word " * 29 + "word"
    for body in (f"<article>{story}</article>", f"<div class=story>{story}</div>"):
        for advert in ("<nav>Menu {}</nav>", "<div class=ad>Buy {}</div>"):
            got = texts_of(spark, [(i, f"http://copies/{i}", f"<body>{advert.format(i)}{body}</body>") for i in range(5)])
            assert set(got.values()) == {want}


def test_nodes_of_a_few_copies_are_kept(spark):
    own = "<h1>Long title</h1><p>Long text</p><table><tr><td>Cell</table><h2>Later</h2>"
    rows = [(100 * h + i, f"http://h{h}/{i}", f"<body><div>Welcome</div><article>{own if i < 3 else f'<h1>Title {i}</h1><p>Text {i}</p>'}</article></body>")
            for h in range(40) for i in range(15)]
    got = texts_of(spark, rows)
    assert all(got[k] == ("Long title Long text Cell Later" if k % 100 < 3 else f"Title {k % 100} Text {k % 100}") for k in got) and len(got) == 600


def test_no_part_of_an_article_is_lost(spark):
    body = " ".join(["word"] * 40)
    shapes = {
        "lead": "<h1>Title {i}</h1><p class=lead>Lead {i}</p><div class=text>Body {i} {body}</div>",
        "parts": "<div class=page><div class=part1>One {i}</div><div class=part2>Two {i} {body}</div></div>",
        "articles": "<article class=a>One {i}</article><article class=b>Two {i} {body}</article>",
    }
    for name, shape in shapes.items():
        top = "<div class=welcome>Welcome</div>"
        got = texts_of(spark, [(i, f"http://{name}/{i}", f"<body>{top}{shape.format(i=i, body=body)}</body>") for i in range(6)])
        assert all(got[i] == " ".join(re.sub("<[^>]*>", " ", shape.format(i=i, body=body)).split()) for i in got)


def test_layouts_of_a_host(spark):
    body = " ".join(["word"] * 40)
    rows = [(i, f"http://h/{i}", f"<body><div>Hello</div><article class=x>Text {i} {body}</article></body>" if i % 3 else
             f"<body><div>Other hello</div><article class=x>Teaser {i}</article><div class=story>Story {i} {body}</div></body>") for i in range(30)]
    got = texts_of(spark, rows)
    assert all(got[i] == (f"Text {i} {body}" if i % 3 else f"Teaser {i} Story {i} {body}") for i in got)


def test_tree_matching():
    a = wrapper.Shape(wrapper.Page("<div class=x><h1>t</h1><p>a<p>b</div><div class=y>c</div>"))
    b = wrapper.Shape(wrapper.Page("<div class=x><p>a</div><div class=z>q</div><div class=y>c</div>"))
    matched = {(a.labels[i], b.labels[j]) for i, j in wrapper.match_trees(a, b).items()}
    assert matched == {("#root", "#root"), ("div.x", "div.x"), ("p", "p"), ("div.y", "div.y")}


def test_deep_and_long_pages(spark):
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    wide = "".join(f"<p>{i}</p><ul><li>{i}</li></ul>" for i in range(600))
    got = texts_of(spark, [(1, "http://d/1", deep), (2, "http://d/2", wide), (3, "http://d/3", "<p>" + "x" * 500_000 + "<p")])
    assert got[1] == "deep" and got[2].startswith("0 0 1 1") and len(got[3]) == 500_000
    assert texts_of(spark, []) == {}


def test_deep_pages_keep_what_follows_and_drop_boilerplate(spark):
    for depth in (160, 5000):
        nest = "<div>" * depth + "deep<nav>Menu</nav><form>Form</form><div class=comment>No</div>" + "</div>" * depth
        source = f"<body><div class=page><article><h1>Head</h1>{nest}<p>rest</p></article></div></body>"
        assert set(texts_of(spark, [(i, f"http://d/{i}", source) for i in range(4)]).values()) == {"Head deep rest"}


def test_words_match_the_patterns():
    rng = random.Random(3)
    texts = ["", None, "A", " a ", "Éa\xa0b"] + ["".join(rng.choice("aB9 \t\x1cé日-\n") for _ in range(rng.randint(0, 30))) for _ in range(300)]
    for marked, pattern in ((NOT_SPACE, brute.SPACED), (LETTERS, re.compile(r"[a-z\x80-\U0010ffff]+"))):
        column = pa.array(texts)
        for a, b in pieces(column, 50):
            found = words_of(column.slice(a, b - a), marked)
            for i, t in enumerate(texts[a:b]):
                own = [bytes(found.data[s:e]).decode() for s, e in zip(found.starts[found.first[i]:found.first[i + 1]], found.ends[found.first[i]:found.first[i + 1]])]
                assert own == pattern.findall((t or "").translate(brute.LOWER))


def test_gradients_through_time():
    rng = np.random.default_rng(0)
    network = language.Network(3, hidden=4, seed=1)
    for d in (network.ahead, network.back):
        d.w, d.u = d.w.astype(float), d.u.astype(float)
    x, y = rng.integers(0, 256, (5, 7)), rng.integers(0, 3, 7)
    _, given = network.gradients(x, y)
    parameters = network.parameters()
    for k, p in enumerate(parameters):
        for _ in range(4):
            at = tuple(int(rng.integers(0, s)) for s in p.shape) if k not in (0, 2) else (int(x[rng.integers(0, 5), 0]), int(rng.integers(0, 12)))
            keep, losses = p[at], []
            for step in (1e-2, -1e-2):
                p[at] = keep + step
                losses.append(network.gradients(x, y)[0])
            p[at] = keep
            assert (losses[0] - losses[1]) / 2e-2 == pytest.approx(float(given[k][at]), abs=2e-3)


def test_language_of_held_out_documents(spark):
    got = op6_language(spark, "/root/testdata/sf0.01").toPandas()
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas()
    both = got.merge(truth, on="doc_id")
    held = both[both.held_out]
    assert len(got) == len(truth) and (held.lang_pred == held.lang).mean() > 0.98
    assert got.score.between(0, 1).all()


def test_language_edges(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, "the house", "en"), (4, "das haus", "de"),
            (5, None, "en"), (6, "", None), (7, "123 !?", None), (8, "THE DOG", None), (9, "x" * 5000, None), (10, "日本", None)]
    df = spark.createDataFrame([(*r, "old") for r in rows], "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in language.predict(df, language.fit(df.where("doc_id < 5"))).collect()}
    assert [got[i].lang_pred for i in (1, 2, 8)] == ["en", "de", "en"]
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (5, 6, 7))
    assert got[9].lang_pred in ("en", "de") and got[10].lang_pred in ("en", "de")
    nothing = language.fit(df.limit(0))
    assert {r.lang_pred for r in language.predict(df, nothing).collect()} == {"und"}
    assert language.predict(df.limit(0), nothing).count() == 0


def test_pipeline_against_plain_python(spark):
    from tidewave.llm import bpe
    from tidewave.llm.queries import held_out, vocabulary

    sf = SF
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    model = language.fit(rows.where(~held_out()))
    docs = sorted((r.doc_id, r.text) for r in rows.collect())
    p = language.probabilities(model, pa.array([t for _, t in docs]))
    docs = [d for d, q in zip(docs, p) if d[1] and re.search(r"[^\W\d_]", d[1]) and q.max() >= corpus_pipeline.LEAST_SCORE]
    docs = [(d, t) for (d, _), (t, n, gone) in zip(docs, brute.line_dedup(docs)) if not gone or n > gone]
    groups = brute.components(dict(docs))
    docs = [(d, t) for d, t in docs if groups[d][1] == d]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = []
    for d, t in docs:
        n, hit, _ = brute.hits(t, items)
        if not (hit and 20 * hit >= n):
            kept.append((d, t))
    assert sorted(got) == [d for d, _ in kept]
    encoder = bpe.PrefixEncoder(vocabulary())
    for d, t in kept[:50]:
        assert bytes(got[d].ids) == encoder.plain(t)


def test_pipeline_stages_keep_columns_and_take_edges(spark):
    rows = [(1, "the and of to in that is was for with", "en", "s", 37, "x"), (None, None, None, None, None, None), (3, "", "en", "s", 0, "y"),
            (1, "the and of to in that is was for with", "en", "s", 37, "x"), (4, "der die und das ist nicht ein zu von mit", "de", None, 40, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_removed string")
    for name, stage in corpus_pipeline.STAGES:
        for given in (docs, docs.limit(0)):
            out = stage(spark, given, SF)
            if name != "tokens":
                assert out.columns == docs.columns
            assert out.count() <= given.count()
    assert corpus_pipeline.STAGES[2][1](spark, docs, SF).count() == 4
    assert corpus_pipeline.STAGES[0][1](spark, docs, SF).where(F.col("text").isNull()).count() == 0
