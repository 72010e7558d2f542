"""The block reader, the random field against enumeration, and extraction on held-out layouts."""

import itertools
import time

import numpy as np
import pytest

from pixelloom.llm import crf, main_text, page_samples
from pixelloom.llm.html_blocks import read_blocks


@pytest.fixture(scope="module")
def model():
    return main_text.learn(page_samples.pages(main_text.MAX_PAGES, main_text.SEED))


# ---------------------------------------------------------------- the reader
@pytest.mark.parametrize("html, texts", [
    ("<p>a<p>b</p></p>c", ["a", "b", "c"]),
    ("<ul><li>a<li>b<ul><li>c</ul>d</ul>", ["a", "b", "c", "d"]),
    ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
    ("a &lt;b&gt; &amp;amp; &#233;&#x41;&nbsp;x &am &amp", ["a <b> &amp; éA x &am &"]),
    ("x <!-- <p>no</p> --> y<!--> z", ["x y z"]),
    ("<p>one\n  two<br>three <b>four</b>five</p>", ["one two three fourfive"]),
    ("<script>if (a < b) '</p>'</script>t<style>p{}</style>u<title>no</title>", ["tu"]),
    ("<SCRIPT>x</SCRIPT >t", ["t"]),
    ("<p hidden>no</p><div style='display: none'>no<p>no</div>yes<template><p>no</p></template>", ["yes"]),
    ("a < b <3 <>c</ >d", ["a < b <3 <>cd"]),
    ('<div class="a > b" id=\'c\'>t</div><p title="unclosed>x</p>', ["t", "x"]),
    ("<div><article>a</div>b", ["a", "b"]),
    ("<button>no</button>yes <select><option>no</select>too", ["yes too"]),
    ("<my-card>a</my-card>b<h1>c", ["a", "b", "c"]),
    ("<p>a</p>\x0b  \n<p></p>", ["a"]),
    ("<script>never closed <p>x", []), ("<!-- never closed <p>x", []), ("", []), ("<", ["<"]), ("<p", []), ("</", []),
])
def test_blocks(html, texts):
    assert [leaf.text for leaf in read_blocks(html)] == texts


def test_null_page():
    assert read_blocks(None) == []


def test_names_and_links():
    (leaf,) = read_blocks('<div class="siteNav main-menu" role=navigation><p><a href="/x">ab</a> cd</p></div>')
    assert leaf.node.tag == "p" and leaf.node.parent.words == ("site", "nav", "main", "menu", "navigation") and leaf.linked == 2


def test_reading_takes_linear_time():
    start = time.time()
    for html in ("<" * 300_000, "<a b='" * 100_000, "<p>" * 200_000, "</p>" * 200_000, "<!--" * 200_000, "<div>" * 50_000 + "x" + "</div>" * 50_000,
                 "&" * 300_000, "<p>word " * 100_000, 'x="' * 100_000, "<x " + "a " * 200_000):
        read_blocks(html)
    assert time.time() - start < 60


# ---------------------------------------------------------------- the random field
def sample_chains(rng, n=6):
    rows = []
    for _ in range(n):
        rows.append([(rng.choice(9, size=3, replace=False).tolist(), int(rng.integers(3)), int(rng.integers(2))) for _ in range(int(rng.integers(1, 7)))])
    return rows


def score(row, labels, weights, steps):
    total = sum(weights[f].sum() * y for (f, _, _), y in zip(row, labels))
    return total + sum(steps[row[t][1], labels[t - 1], labels[t]] for t in range(1, len(row)))


def test_likelihood_and_gradient():
    rng = np.random.default_rng(2)
    rows, weights, steps = sample_chains(rng), rng.normal(size=9), rng.normal(size=(3, 2, 2))
    data = crf.chains_of([*rows, []])
    value, by_weight, by_step = crf.likelihood(data, weights, steps)

    def plain(w, s):
        total = 0.0
        for row in rows:
            every = [score(row, y, w, s) for y in itertools.product((0, 1), repeat=len(row))]
            total += score(row, [b[2] for b in row], w, s) - np.log(np.exp(every).sum())
        return total

    assert value == pytest.approx(plain(weights, steps), abs=1e-9)
    for k in range(9):
        more = weights.copy()
        more[k] += 1e-6
        assert by_weight[k] == pytest.approx((plain(more, steps) - plain(weights, steps)) / 1e-6, abs=1e-4)
    for at in itertools.product(range(3), range(2), range(2)):
        more = steps.copy()
        more[at] += 1e-6
        assert by_step[at] == pytest.approx((plain(weights, more) - plain(weights, steps)) / 1e-6, abs=1e-4)


def test_decoding_against_every_labelling():
    rng = np.random.default_rng(4)
    for _ in range(40):
        (row,), weights, steps = sample_chains(rng, 1), rng.normal(size=9), rng.normal(size=(3, 2, 2))
        got = crf.decode([float(weights[f].sum()) for f, _, _ in row], [k for _, k, _ in row], steps.tolist())
        best = max(itertools.product((0, 1), repeat=len(row)), key=lambda y: score(row, y, weights, steps))
        assert tuple(got) == best
    assert crf.decode([], [], steps.tolist()) == []


def test_training_raises_the_likelihood():
    rng = np.random.default_rng(6)
    data = crf.chains_of(sample_chains(rng, 30))
    before = crf.likelihood(data, np.zeros(9), np.zeros((2 + 1, 2, 2)))[0]
    weights, steps = crf.train(data, 9, 3, rounds=60)
    assert crf.likelihood(data, weights, steps)[0] > before


# ---------------------------------------------------------------- extraction
def test_held_out_layouts(model):
    right = blocks = 0
    for html, text in page_samples.pages(300, seed=99):
        leaves = read_blocks(html)
        want = main_text.labels_of(leaves, text)
        got = model.labels(leaves)
        right += sum(a == b for a, b in zip(want, got))
        blocks += len(want)
    assert right / blocks > 0.98


PROSE = ["It was a long day in the old town, and nobody had seen the river so high.", "Later, the mayor said that the bridge would stay closed until spring.", "Nobody complained."]


def paragraphs(lines):
    return "".join(f"<p>{line}</p>" for line in lines)


@pytest.mark.parametrize("html", [
    "<header><a href=/>The paper</a></header><nav><a href=/a>Home</a> <a href=/b>News</a></nav><main><article><h1>High water</h1>{}</article></main>"
    "<aside><h3>Related</h3><ul><li><a href=/c>Another story</a></li></ul></aside><footer>© 2024 The paper</footer>",
    "<div id=header><div class=logo>The paper</div></div><div class=menu><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></div>"
    "<div class=post-content><h1>High water</h1>{}</div><div class=sidebar><h3>Popular posts</h3><p><a href=/c>Another story</a></p></div>"
    "<div class=footer><p>© 2024 The paper. All rights reserved.</p></div>",
    "<div class='cookie-notice'><p>We use cookies to improve this site.</p><button>Accept</button></div><article><h1>High water</h1>{}</article>"
    "<section id=comments><h2>3 comments</h2><div class=comment><p>I was there and saw it all, it was terrible.</p></div>"
    "<div class=comment><p>Thank you for this article!</p></div><form><label>Your name</label><input><p>Leave a reply</p></form></section>",
    "<header><h1>The Daily</h1><nav><ul><li><a href=a>Home</a></li></ul></nav></header><main><h1>High water</h1>{}</main>",
    "<nav><ul><li><a href=a>Home</a></li></ul></nav><h1>High water</h1>{}<footer>&copy; me</footer>",
    "<nav><a href=/>Home</a></nav><article><h1>High water</h1>{}<section class=comments><p>I was there and saw it all.</p></section></article>",
    "<article><h1>High water</h1>{}<div class=advert>Buy a boat today!</div></article><div class=newsletter><form><p>Subscribe to our newsletter</p></form></div>",
])
def test_pages_of_other_makes(model, html):
    assert model.text(html.format(paragraphs(PROSE))) == "\n".join(["High water", *PROSE])


def test_rows(spark, model):
    page = "<nav><a href=/>Home</a></nav><article><h1>T</h1><p>One &amp; two, three and four go on for a while here.</p></article>"
    long = "<nav><a href=/>Home</a></nav><article>" + "<p>A sentence that goes on for some time, and then it ends here.</p>" * 30_000 + "</article>"
    rows = [(1, "u", page, "x", 1), (2, None, None, "x", 1), (3, "v", "", None, 1), (None, "w", page, "x", 1), (1, "u", page, "x", 1), (4, "l", long, "x", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int").repartition(3)
    got = main_text.extract(df, model)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    text = "T\nOne & two, three and four go on for a while here."
    by_id = {}
    for r in got.collect():
        by_id.setdefault(r.page_id, []).append((r.url, r.text, r.n_chars))
    assert by_id[1] == [("u", text, len(text))] * 2 and by_id[None] == [("w", text, len(text))]
    assert by_id[2] == [(None, "", 0)] and by_id[3] == [("v", "", 0)]
    assert by_id[4][0][1].count("\n") == 29_999
    assert main_text.extract(df.limit(0), model).count() == 0


def test_own_labelled_pages(spark):
    """A user's labels decide: here only list items are main text."""
    pages = [(f"<div><p>word{k} words here</p><ul><li>item {k} one</li><li>item two</li></ul></div>", f"item {k} one\nitem two") for k in range(60)]
    odd = [(None, "x"), ("<p>a</p>", "no such block"), ("", None)]
    df = spark.createDataFrame(pages + odd, "html string, text string")
    own = main_text.fit(spark, df)
    assert own.text("<div><p>some words here</p><ul><li>item 7 one</li><li>item two</li></ul></div>") == "item 7 one\nitem two"
    assert main_text.fit(spark, df.limit(0)).text("<p>a</p>") in ("", "a")
