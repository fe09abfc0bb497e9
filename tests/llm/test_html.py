import itertools
import random
import time

import numpy as np
import pytest

from kinweave.llm.html import N_KINDS, TEXT, Forest, Model, extract_text, labelled_pages, op10_html, read, train

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><!-- ad --><div class="ad">Buy now.</div>
<article><h1>Head &amp; line</h1><p><b>First   part<br>of &lt;text&gt;.<p>Second\n\tone.</p></article>
<section class="comments"><h3>Comments</h3><div class="comment"><p>I disagree with all of this, and here is a long reason why.</p></div></section>
<footer>&copy; me &middot; imprint</footer></body></html>"""


@pytest.fixture(scope="module")
def model():
    return train(labelled_pages())


def test_page(model):
    assert model.extract([PAGE, None, "", "<nav><a href=x>y</a></nav>"])[:3] == [
        "Head & line\nFirst part of <text>.\nSecond one.",
        "",
        "",
    ]


def test_held_out_pages(model):
    pages = labelled_pages(200, seed=77)
    right = sum(
        set(t.split("\n")) - {""} == good for t,
        (_, good) in zip(model.extract([p for p, _ in pages]), pages, strict=True)
    )
    assert right >= 0.97 * len(pages)


def test_marginals_equal_enumeration():
    g = np.random.default_rng(1)
    parents = [-1, 0, 0, 1, 1, 2, 4]
    firsts = ("tag div", TEXT, "tag nav", "tag li", "tag article", TEXT, "tag p")
    features = [[firsts[i], f"f{i}"] for i in range(7)]
    names = {f"f{i}": i for i in range(7)}
    m = Model(names, g.normal(size=7), g.normal(size=(N_KINDS, 2, 2)))
    f = Forest.of([(parents, features)], names)
    assert f.kind.tolist() == [0, 1, 2, 3, 4, 1, 0]
    total, ones, pair = 0.0, np.zeros(7), np.zeros((7, 2, 2))
    for y in itertools.product((0, 1), repeat=7):
        e = sum(m.weights[i] * y[i] for i in range(7))
        e += sum(m.pairs[int(f.kind[i])][y[parents[i]]][y[i]] for i in range(1, 7))
        w = np.exp(e)
        total += w
        ones += w * np.array(y)
        for i in range(1, 7):
            pair[i][y[parents[i]]][y[i]] += w
    p, both = m.marginals(f)
    assert np.allclose(p, ones / total) and np.allclose(both[1:], pair[1:] / total)


def test_reader_survives_broken_markup():
    for html in (
        "<",
        "</p>",
        "<p>a<p>b</div></div>c",
        "<li>a<li>b",
        "<table><tr><td>x<td>y",
        "a<script>b",
        "<!-- a",
        "&#x110000; &bad; &amp",
        "<p " * 500,
        "<div>" * 3000 + "deep",
    ):
        parents, features, texts = read(html)
        assert len(parents) == len(features) and all(
            p < i for i,
            p in enumerate(parents)
        ) and set(texts) <= set(range(len(parents)))
    assert [t for t in read("<p>a<b>b</b>c <i>d</i><br>e<p>f")[2].values()] == ["abc d e", "f"]


def test_query(spark, tmp_path, model):
    pages = spark.createDataFrame(
        [(1, "u", PAGE), (2, None, None), (1, "u", PAGE)],
        "page_id long, url string, html string",
    )
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    rows = sorted(op10_html(spark, str(tmp_path)).collect(), key=lambda r: r.page_id)
    assert [r.page_id for r in rows] == [1, 1, 2] and rows[0].text == rows[1].text and rows[2].text == ""
    assert rows[0].n_chars == len(rows[0].text) > 20 and rows[2].n_chars == 0
    clash = pages.selectExpr("*", "7 as text", "8 as extra")
    assert extract_text(clash, model=model).columns == ["page_id", "url", "html", "extra", "text"]
    assert extract_text(pages.limit(0), model=model).count() == 0


def test_words_behind_a_long_class_list_count():
    long = " ".join(f"u{chr(97 + k % 26)}-x" for k in range(300))
    short, full = (read(f'<div class="{c}" id="comments">text</div>')[1] for c in ("ua-x", long))
    assert {f for own in short for f in own if "comment" in f} <= {f for own in full for f in own}
    assert any("comment" in f for own in full for f in own)


def other_pages(n, seed):
    """Pages of layouts that the training generator doesn't make, with their texts; words are drawn from a list."""
    r = random.Random(seed)
    vocabulary = "river market stone letter winter garden signal copper window harbour lantern meadow".split()

    def say(lo, hi, end="."):
        return " ".join(r.choices(vocabulary, k=r.randint(lo, hi))).capitalize() + end

    def menu():
        items = [f'<a href="/{k}">{say(1, 2, "")}</a>' for k in range(r.randint(4, 8))]
        return r.choice(
            (
                "<div class='top-menu'>" + " | ".join(items) + "</div>",
                "<nav>" + "".join(f"<span>{i}</span>" for i in items) + "</nav>",
                "<table class=navigation><tr>" + "".join(f"<td>{i}" for i in items) + "</table>",
            )
        )

    def page(kind):
        good = [say(3, 8, "")] + [say(12, 60) for _ in range(r.randint(3, 7))]
        h, ps = good[0], good[1:]
        foot = f"<div id=footer>&copy; {say(2, 5)} <a href=/i>{say(1, 2, '')}</a></div>"
        notice = f'<div class="cookie-bar" role="alert">{say(5, 12)}<button>OK</button></div>'
        if kind == "bare":
            return f"<title>x</title><h1>{h}</h1>" + "".join(f"<p>{p}" for p in ps), good
        if kind == "plain":
            inner = f"<h1>{h}</h1>" + "".join(f"<p>{p}</p>" for p in ps)
            return f"<html><body>{menu()}<div>{inner}</div>{foot}</body></html>", good
        if kind == "prose":
            inner = f"<h1>{h}</h1><div class='prose'>" + "".join(f"<p>{p}</p>" for p in ps) + "</div>"
            return f"<body>{notice}{menu()}<main><div><div>{inner}</div></div></main>{foot}", good
        if kind == "button":
            return f"<body>{menu()}<h1>{h}</h1><p>{ps[0]}<button>Share" + "".join(f"<p>{p}" for p in ps[1:]) + foot, good
        text = f"{ps[0]} Let <math><mi>a</mi><mo>=</mo><mi>b</mi></math> hold."
        inner = f"<h2>{h}</h2><p>{text}</p><object><p>{ps[1]}</p></object>" + "".join(f"<p>{p}</p>" for p in ps[2:])
        good = [h, f"{ps[0]} Let a=b hold.", *ps[1:]]
        return f"<body>{menu()}<section class=story>{inner}</section><aside class=promo>{say(6, 12)}</aside>{foot}", good

    return [page(r.choice(("bare", "plain", "prose", "button", "formula"))) for _ in range(n)]


def test_pages_of_another_generator(model):
    pages = other_pages(200, 9)
    got = [t.split("\n") for t in model.extract([p for p, _ in pages])]
    assert sum(a == b for a, (_, b) in zip(got, pages, strict=True)) >= 0.95 * len(pages)


def test_formulas_scripts_and_open_elements_keep_a_line_whole():
    def lines(html):
        return list(read(html)[2].values())

    assert lines("<p>Let <math><mi>a</mi><mo>=</mo><mn>2</mn></math> as shown</p>") == ["Let a=2 as shown"]
    assert lines("<p>a <script>x</script> b <button>y</button> c</p>") == ["a b c"]
    assert lines("<object><p>inside</p></object>") == ["inside"]
    assert lines("<p>a<button>Share<p>next<p>more") == ["a", "next", "more"]
    assert lines("<head><title>t</title>text<p>b") == ["text", "b"]
    assert lines("<select><option>a<p>b") == ["b"]
    assert lines("<table><tr><td>a<td>b<tr><td>c</table>d<svg><g><path/></g></svg>e") == ["a", "b", "c", "de"]


def test_reading_takes_linear_time():
    def seconds(k):
        html = "<b>" * k + "<div>" * k + "<li>" * k + "</x>" * k + "<p>" * k + "</b>" * k + "<td>" * k
        start = time.perf_counter()
        read(html)
        return time.perf_counter() - start

    seconds(500)
    assert seconds(8000) < 12 * seconds(2000)
