import numpy as np
import pytest

from quern.llm import html_extract as H


def texts(page):
    return [b.text for b in H.page_blocks(page)]


def test_blocks():
    assert texts("<p>a <b>b</b>c<br>d&amp;&eacute;&#x41;\n\t e</p>f<div>g<p>h") == ["a bc d&éA e", "f", "g", "h"]
    assert texts('<script>var t="</p>x<p>";</script><style>p{}</style><!-- <p>no</p> --><p title="a>b">yes') == ["yes"]
    assert texts("<p>cut &am") == ["cut &am"] and texts("<p>x<a href='y") == ["x"] and texts("a < b") == ["a < b"]
    assert texts("") == [] and texts("<head><title>t</title></head><body>b") == ["b"] and texts("</p></div>x") == ["x"]
    assert [b.path[-1] for b in H.page_blocks('<ul><li class="A b-c">x<li>y</ul>')] == ["li a b c", "li"]
    assert texts("<p>x</P ><P>y<textarea>no</textarea>") == ["x", "y"]


def test_many_open_tags():
    assert texts("<div>" * 20_000 + "x") == ["x"]


@pytest.fixture(scope="module")
def model():
    return H.trained()


def test_generated_pages_held_out(model):
    g = H.Generator(4711)
    examples = [x for x in (g.example() for _ in range(150)) if x[0]]
    found = model.label([b for b, _ in examples])
    right = np.concatenate([(p >= 0.5) == (y > 0) for p, (_, y) in zip(found, examples)])
    assert right.mean() > 0.98


PAGE = """<!DOCTYPE html><html><head><title>t</title></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
<div class="ad">Buy the new thing now. It is cheap.</div><article><h1>A title of it</h1><p>The first &amp; foremost sentence of the
text. It goes on.</p><p>A second paragraph, which is longer and says more. It ends here.</p></article>
<section class="comments"><p class="comment">I like this text. It is good.</p></section><footer>&copy; site.example.com &middot; All rights.</footer></body></html>"""
WANT = "A title of it\n\nThe first & foremost sentence of the text. It goes on.\n\nA second paragraph, which is longer and says more. It ends here."


def test_pages(spark, model):
    rows = [(1, "u", PAGE, "x"), (2, None, None, "x"), (3, "u", "", "x"), (1, "u", PAGE, "x"), (None, "u", "<nav><a href=x>y</a></nav>", "x")]
    found = H.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), model).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, [(1, "u", WANT, len(WANT)), (1, "u", WANT, len(WANT)), (2, None, "", 0), (3, "u", "", 0), (None, "u", "", 0)]))
    assert H.extract_pages(spark.createDataFrame([], "page_id long, url string, html string"), model).count() == 0


def test_gradient(model):
    fresh = H.Labeller(9)
    examples = [x for x in (H.Generator(3).example() for _ in range(3)) if x[0]]
    x, mask, _, _ = fresh.batch([H.page_features(b) for b, _ in examples])
    for side in "fb":
        keep = []
        out = fresh.lstm(x, mask, side, keep)
        d_x, more = fresh.lstm_back(np.ones_like(out), x, side, keep)
        p = fresh.p["u" + side]
        old = p[1, 7]
        p[1, 7] = old + 1e-2
        up = fresh.lstm(x, mask, side).sum()
        p[1, 7] = old - 1e-2
        down = fresh.lstm(x, mask, side).sum()
        p[1, 7] = old
        assert (up - down) / 2e-2 == pytest.approx(more["u" + side][1, 7], rel=0.05, abs=0.02)
