import html
import re

import numpy as np
import pytest
from tables import SF, frame

from stratocast.llm import extraction as x
from stratocast.llm.blocks import split_blocks
from stratocast.llm.common import documents
from stratocast.llm.layouts import make_page
from stratocast.llm.recurrent import Labeller, padded


def texts(page):
    return [b.text for b in split_blocks(page)]


@pytest.mark.parametrize(
    "page, want",
    [
        ("<p>a <b>b</b>c&amp;d<br>e</p>\n f", ["a bc&d", "e", "f"]),
        ("<script>var t='</p>';</script><style>p{}</style><p>x</p>", ["x"]),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", ["a", "b", "c", "d"]),
        ("<p>a<p>b<div>c</div>", ["a", "b", "c"]),
        ("a &lt;b&gt; &#233;&#x41;&nbsp;&copy &am", ["a <b> éA © &am"]),
        ("<p title='>'>x<!-- <p>no</p> -->y</p><!-- open <p>z", ["xy"]),
        ("<p>cut <b>off</b> <a hr", ["cut off"]),
        ("1 < 2 <3 & 4", ["1 < 2 <3 & 4"]),
        ("<title>no</title><textarea>no</textarea><h1>yes</h1></div></p>end", ["yes", "end"]),
        ("", []),
        (None, []),
        ("  \n ", []),
    ],
)
def test_blocks(page, want):
    assert texts(page) == want


def test_paths_and_links():
    (b,) = split_blocks('<div class="Side bar" id=x><p>see <a href="/">this</a></p></div>')
    assert b.path == (("div", "side bar x"), ("p", "")) and b.link_chars == 4


def test_gradients():
    m = Labeller(5, 3, 1)
    m.weights = {k: v.astype(np.float64) for k, v in m.weights.items()}
    rng = np.random.default_rng(0)
    data = padded([(rng.normal(size=(n, 5)), rng.integers(0, 2, n).astype(float)) for n in (4, 1, 6)], 5)
    data = [d.astype(np.float64) for d in data]
    grads = m.gradients(*data)[1]
    for name, w in m.weights.items():
        for at in np.ndindex(w.shape) if w.size < 20 else [tuple(rng.integers(0, s) for s in w.shape) for _ in range(20)]:
            keep = w[at]
            w[at] = keep + 1e-4
            up = m.gradients(*data)[0]
            w[at] = keep - 1e-4
            down = m.gradients(*data)[0]
            w[at] = keep
            assert abs((up - down) / 2e-4 - grads[name][at]) < 1e-4


def test_sequences_do_not_influence_each_other():
    m = Labeller(4, 3, 2)
    rng = np.random.default_rng(1)
    seqs = [rng.normal(size=(n, 4)).astype(np.float32) for n in (3, 0, 7, 1, 40)]
    together = m.label(seqs)
    assert all((m.label([s])[0] == t).all() and len(t) == len(s) for s, t in zip(seqs, together))


@pytest.fixture(scope="module")
def model():
    return x.fitted()


def test_held_out_pages(model):
    wrong = total = 0
    for seed in range(9_000_000, 9_000_200):
        blocks, main = x.labelled(seed)
        kept = model.label(x.features([blocks]))[0]
        wrong += int((kept != (main > 0)).sum())
        total += len(blocks)
    assert wrong < 0.01 * total


def test_made_up_page_comes_back_whole(model):
    pages = [make_page(s) for s in range(8_000_000, 8_000_050)]
    got = x.main_texts([p for p, _ in pages], model)
    assert sum(g == " ".join(t.split()) for g, (_, t) in zip(got, pages)) >= 45


PARTS = {
    "subheads": "<h3>Soil and water</h3><p>The paragraph after the subhead says more.</p><h4>Notes</h4><p>More notes.</p>",
    "table": "<table><tr><th>Kind</th><th>Days</th></tr><tr><td>Roma</td><td>75</td></tr></table>",
    "code": "<pre>x = plant(3)\ny = water(x)</pre>",
    "lists": "<ol><li>Sow the seeds.</li><li>Wait.</li></ol><dl><dt>Truss</dt><dd>A group of fruits.</dd></dl>",
    "figure": "<figure><img src=a><figcaption>A ripe fruit.</figcaption></figure>",
    "formula": "<p>Energy is <math><mi>E</mi><mo>=</mo><mi>m</mi></math> here.</p>",
    "section": "<section><h3>One more part</h3><p>It has some words.</p></section><div>Loose text in a division.</div>",
    "open drawing": "<svg><path d=x><p>After an open drawing.</p>",
    "drawing": "<svg><text>label</text></svg><p>After a drawing.</p>",
}


@pytest.mark.parametrize("part", [*PARTS, "all"])
def test_what_articles_hold_comes_back(model, part):
    inner = "".join(PARTS.values()) if part == "all" else PARTS[part]
    inner = f"<h1>Growing tomatoes at home</h1><p>First paragraph of the article, with some words.</p>{inner}<p>The last paragraph ends it.</p>"
    around = "<nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li><li><a href=/s>Shop</a></li></ul></nav><article>{}</article>"
    around += "<aside><h3>Related</h3><ul><li><a href=/x>Other</a></li></ul></aside><section class=comments><h3>Comments</h3><p>Nice one!</p></section><footer>&copy; x</footer>"
    page = "<html><head><title>T</title></head><body>" + around.format(inner) + "</body></html>"
    plain = re.sub(r"<svg><text>.*?</svg>", "", inner)
    plain = re.sub(r"</?(?:h\d|p|table|tr|th|td|pre|ol|li|dl|dt|dd|figure|figcaption|section|div|svg|path|img)\b[^>]*>", " ", plain)
    assert x.main_texts([page], model) == [" ".join(re.sub(r"<[^>]*>", "", plain).split())]


def test_elements_without_an_end_hide_nothing_more():
    for tag in ("svg", "iframe", "object", "title", "textarea", "template", "noscript"):
        texts = [b.text for b in split_blocks(f"<p>a</p><{tag}>hidden<p>b</p><p>c</p>")]
        assert texts == ["a", "b", "c"], tag
    assert [b.text for b in split_blocks("<p>a</p><script>var x = '<p>b</p>'")] == ["a"]
    assert [b.text for b in split_blocks("<p>a</p><svg>hidden")] == ["a"]
    assert split_blocks("<ul><li><a href=/>Home</a></li></ul>")[0].link_chars == 4


def article(page):
    inner = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)
    parts = re.split(r"</?(?:h1|p|br)[^>]*>", re.sub(r"<[^>]*\Z", "", inner[1])) if inner else []
    return " ".join(" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)) for p in parts).split())


def test_whole_table(spark, model):
    pages = {r.page_id: r.html for r in documents(spark, SF, "pages").collect()}
    got = x.op9_extraction(spark, SF).collect()
    assert len(got) == len(pages)
    assert sum(r.text == article(pages[r.page_id]) for r in got) == len(pages)
    assert all(r.n_chars == len(r.text) for r in got)


def test_awkward_rows(spark, model):
    page = make_page(3)[0]
    rows = [(1, "u", None), (1, "u", None), (None, None, page), (2, "v", ""), (3, "w", "<p>"), (4, "x", "plain"), (5, "y", "<article>" + "<p>word word word word.</p>" * 20_000)]
    out = x.extract(frame(spark, rows, columns="page_id long, url string, html string"), model).collect()
    by = {}
    for r in out:
        by.setdefault(r.page_id, []).append(r.text)
    assert by[1] == ["", ""] and by[2] == [""] and by[3] == [""] and len(by[None]) == 1 and len(out) == len(rows)
    assert by[5][0].count("word word word word.") == 20_000


def test_empty_table(spark, model):
    assert x.extract(frame(spark, [], columns="page_id long, url string, html string"), model).count() == 0
