import itertools
import random

import numpy as np

from drumlin.llm import extract


def test_held_out_accuracy():
    model, rng = extract.trained_model(), random.Random(12345)
    right = total = 0
    for _ in range(200):
        blocks, labels = extract.labelled_blocks(rng)
        right += sum(a == b for a, b in zip(model.decode(blocks), labels, strict=True))
        total += len(labels)
    assert right / total >= 0.99


def test_viterbi_against_all_labellings():
    rng = np.random.default_rng(4)
    model = extract.Field({f: tuple(rng.normal(size=2)) for f in "abcdef"}, rng.normal(size=(2, 2)))
    score = lambda page, ys: sum(model.weights[f][y] for block, y in zip(page, ys, strict=True) for f in block) + sum(model.moves[a, b] for a, b in itertools.pairwise(ys))
    for _ in range(60):
        page = [list(rng.choice(list("abcdef"), size=2)) for _ in range(rng.integers(1, 7))]
        best = max(itertools.product((0, 1), repeat=len(page)), key=lambda ys: score(page, ys))
        assert abs(score(page, model.decode(page)) - score(page, best)) < 1e-9


def test_training_raises_likelihood():
    rng = random.Random(6)
    pages = [p for p in (extract.labelled_blocks(rng) for _ in range(40)) if p[0]]

    def loss(model):
        out = 0.0
        for blocks, labels in pages:
            s = [np.array([sum(model.weights.get(f, (0, 0))[y] for f in b) for y in (0, 1)]) for b in blocks]
            a, gold = s[0], s[0][labels[0]]
            for t in range(1, len(s)):
                gold += model.moves[labels[t - 1], labels[t]] + s[t][labels[t]]
                a = np.logaddexp.reduce(a[:, None] + model.moves, axis=0) + s[t]
            out += np.logaddexp.reduce(a) - gold
        return out

    assert loss(extract.train(pages, rounds=80)) < 0.3 * loss(extract.train(pages, rounds=3))


def test_blocks():
    page = '<title>x</title><p>a  b&nbsp;c<p>d <b>e</b>f<br>g<ul><li>h<li>i &amp; &#233;&lt;</ul><script>var t="</p>";</script><!-- > -->j<div class="k>l">m<style>q</style>'
    assert [b.text for b in extract.leaf_blocks(page)] == ["a b c", "d ef g", "h", "i & é<", "j", "m"]
    for odd in ("", "<", "<p", "a<b", "</p></p>", "<script>never closed", "<!-- never", "<p title='>'>x", "<li>" * 3000 + "x"):
        extract.leaf_blocks(odd)


def page(body):
    return f'<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body>{body}</body></html>'


def test_pages(spark):
    article = "<article><h1>The head&amp;line</h1><p><b>First of it.<br><p>Second   part, with <a href=x>a link</a> in it.</p></article>"
    text = "The head&line\nFirst of it.\nSecond part, with a link in it."
    nav, ad, foot = "<nav><ul><li><a href=/a>One</a></li><li><a href=/b>Two</a></li></ul></nav>", '<div class="ad">Buy this now.</div>', "<footer>&copy; x &middot; All of it.</footer>"
    comments = '<section class="comments"><h3>Comments</h3><div class="comment"><p>I like this text a lot, really.</p></div></section>'
    cases = [
        (1, "u", page(nav + ad + article + foot), text), (2, "u", page(nav + article + comments + foot), text), (3, None, page("<header><p>Our site</p></header>" + article + '<aside class="sidebar"><p>More of it here.</p></aside>'), text),
        (4, "u", None, ""), (5, "u", "", ""), (6, "u", page(nav + foot), ""), (None, "u", page('<div class="cookie-notice"><p>We use cookies.</p></div>' + article + "<form><label>Mail</label><button>Go</button></form>"), text),
        (8, "u", page(nav + article + foot)[:-20], text),
    ]
    frame = spark.createDataFrame([(*c[:3], "z") for c in cases], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in extract.extract_pages(frame).collect()}
    for i, url, _, want in cases:
        assert (got[i].url, got[i].text, got[i].n_chars) == (url, want, len(want)), i
    assert extract.extract_pages(frame.limit(0)).collect() == []


def test_one_very_long_page(spark):
    long = page("<nav><a href=/x>Home</a></nav><article>" + "<p>Some words of a paragraph, and more of them.</p>" * 20_000 + "</article>")
    frame = spark.createDataFrame([(1, "u", long)], "page_id long, url string, html string")
    assert extract.extract_pages(frame).first().text.count("\n") == 19_999


def test_parts_beside_the_article_in_any_place():
    model = extract.trained_model()
    article = "<h1>A head of it</h1><p>Some first words | of it, 3%%% of all</p><p>And then a second paragraph of prose, with more words in it.</p>"
    want = "A head of it\nSome first words | of it, 3%%% of all\nAnd then a second paragraph of prose, with more words in it."
    parts = [("nav", ""), ("aside", ""), ("header", ""), ("footer", ""), ("form", ""), ("div", "sidebar"), ("div", "ad"), ("section", "comments"), ("div", "cookie-notice"), ("div", "newsletter"), ("ul", "menu")]
    for tag, name in parts:
        for inner in ("<p>Whole prose that stands beside the article, as long as any of its own.</p>", "Short words", "<p>One.</p><p>Two of them, and three.</p>"):
            box = f"<{tag}" + (f' class="{name}"' if name else "") + f">{inner}</{tag}>"
            for body in (f"{box}<article>{article}</article>", f"<article>{article}{box}</article>", f'<div class="content">{article}</div>{box}', f"<main>{box}{article}</main>"):
                assert extract.main_text(page(body), model) == want, (tag, name, inner, body[:40])


ARTICLE = "<h1>A head line of it</h1><p>Some first words of it, and then a few more of them to read.</p><p>And then a second paragraph of prose, with more words in it.</p>"
TEXT = "A head line of it\nSome first words of it, and then a few more of them to read.\nAnd then a second paragraph of prose, with more words in it."
# Pages written by hand: names of states and wrappers that hold the article.
WRAPPED = [
    '<body class="post-template single-post comments-open"><nav><a href=/>Home</a></nav><article>%s</article></body>', '<body class="has-sidebar"><div class="content">%s</div></body>',
    '<body><div class="content-with-sidebar"><div class="content">%s</div><div class="sidebar"><p>Other things to read here today.</p></div></div></body>', '<body><div class="content-with-sidebar">%s</div></body>',
    '<body><form id="aspnetForm" method=post action=/x><input type=hidden><nav><a href=/>Home</a></nav><article>%s</article><footer><p>All of it is ours.</p></footer></form></body>', "<body><form><div>%s</div></form></body>",
    "<body>%s</body>", "<body><div id=page><div id=wrap>%s</div></div></body>", "<body><article><header>%s</header></article></body>", '<body><div class="newsletter-page no-comments"><main>%s</main></div></body>',
    '<body class="cookie-notice-open"><div class="cookie-notice">We set cookies, do you mind?</div><div class="layout-with-ads"><section class="story">%s</section><div class="ads">Buy one of these.</div></div></body>',
    '<body><table><tr><td class="menu"><a href=/a>One</a><a href=/b>Two</a></td><td>%s</td></tr></table></body>', '<body><div class="information platform inside">%s</div><section id=comments><article class="comment"><p>I do not think that this is so.</p></article></section></body>',
]


def test_wrappers_and_states_are_no_parts():
    model = extract.trained_model()
    for body in WRAPPED:
        assert extract.main_text("<html><head><title>T</title></head>" + body % ARTICLE + "</html>", model) == TEXT, body


def test_formulas_and_inline_parts_stay():
    body = "<article><h1>On x</h1><p>Where <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds, <code>f(x)</code> &lt; 3&nbsp;is <sub>true</sub>.</p><figure><img src=a><figcaption>A picture of it.</figcaption></figure><pre>a  b\nc</pre></article>"
    assert extract.main_text(page(body), extract.trained_model()) == "On x\nWhere x=2 holds, f(x) < 3 is true.\nA picture of it.\na b c"


def test_names():
    assert [extract.cues_of(x) for x in ("has-sidebar", "content-with-sidebar", "comments-open", "inside information platform", "sidebar-content", "post-comments", "site-header")] == [(), ("main",), (), (), ("side",), ("comment",), ("head",)]
