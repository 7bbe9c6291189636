"""Block labeller: gradients against differences, extraction against the markup of made-up pages."""

import random

import numpy as np
import pytest

from burdenflow.llm import main_text
from burdenflow.llm.blocks import blocks_of

PAGES = "page_id long, url string, html string, text string, n_chars string"


def paragraph():
    return " ".join(random.choices("alpha beta gamma delta omega one two three".split(), k=random.randint(4, 30))).capitalize() + "."


def page(kind):
    body = [paragraph() for _ in range(random.randint(2, 6))]
    inner = f"<h1>{body[0]}</h1>" + "".join(f"<p>{b}</p>" for b in body[1:])
    noise = ["<nav><ul><li><a href=/>Home</a></li><li><a href=/x>News</a></li></ul></nav>", f'<div class="ad">{paragraph()}</div>', f"<footer>&copy; {paragraph()}</footer>"]
    if kind == "article":
        holder = f"<article>{inner}</article>"
    else:
        holder = f'<div class="content">{inner}<section class="comments"><h3>Comments</h3><p>{paragraph()}</p></section></div><aside><p>{paragraph()}</p></aside><form><label>Mail</label></form>'
    return f"<!DOCTYPE html><html><head><title>T</title><script>var x='<p>no</p>'</script></head><body>{noise[0]}{noise[1]}{holder}{noise[2]}</body></html>", "\n\n".join(body)


@pytest.fixture(scope="module")
def pages(spark):
    random.seed(21)
    made = [(i, *page("article" if i % 4 else "other")) for i in range(160)]
    df = spark.createDataFrame([(i, f"u{i}", h, "x", "y") for i, h, _ in made], PAGES).repartition(4)
    return made, df


def test_text_of_every_page(pages):
    made, df = pages
    got = {r.page_id: r for r in main_text.main_text(df, sample=100).collect()}
    assert len(got) == 160 and all(r.n_chars == len(r.text) and r.url == f"u{i}" for i, r in got.items())
    wrong = [i for i, _, text in made if got[i].text != text]
    assert not [i for i in wrong if i % 4], "pages with an article element"
    assert len(wrong) <= 4


def test_nulls_empty_odd_and_long_pages(pages, spark):
    labeller = main_text.learn_from(pages[1])
    long = "<article>" + "".join(f"<p>word {i}.</p>" for i in range(3000)) + "</article>"
    rows = [(1, None), (2, ""), (None, "<article><p>a</p></article>"), (3, "just text"), (4, long), (5, "<p <b"), (6, "<article><p>x<br>y &amp;\n z&#33;<p>q")]
    rows += [(6, rows[-1][1])] * 2
    df = spark.createDataFrame([(i, None, h, "t", "n") for i, h in rows], PAGES)
    got = main_text.extract(df, labeller).collect()
    texts = {}
    for r in got:
        texts.setdefault(r.page_id, set()).add(r.text)
    assert len(got) == len(rows) and all(len(v) == 1 for v in texts.values())
    assert texts[1] == texts[2] == {""} and texts[4] == {"\n\n".join(f"word {i}." for i in range(3000))}
    assert texts[6] == {"x y & z!\n\nq"}
    assert main_text.main_text(df.limit(0)).count() == 0


def test_blocks_and_paths():
    found = blocks_of('<div class="post body"><p>One <b>two</b><br>three<p>Four<ul><li><a href="x>y">Five</a><li>Six</ul></div><style>p{}</style>tail &eacute;')
    assert [(b.text, [t for t, _ in b.path], b.linked) for b in found] == [
        ("One two three", ["div", "p"], 0),
        ("Four", ["div", "p"], 0),
        ("Five", ["div", "ul", "li"], 4),
        ("Six", ["div", "ul", "li"], 0),
        ("tail é", [], 0),
    ]
    assert found[0].path[0][1] == ("post", "body")


def test_gradients_are_those_of_the_loss():
    draw = np.random.default_rng(3)
    net = main_text.Labeller(hidden=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    matrices = [draw.normal(size=(n, main_text.WIDTH)) * 0.3 for n in (4, 2, 1)]
    x, mask = main_text.padded(matrices)
    x, mask = x.astype(float), mask.astype(float)
    y = (draw.random(mask.shape[:2]) < 0.5).astype(float)

    def loss():
        p = net.chances(x, mask)
        return float((-(y * np.log(p) + (1 - y) * np.log(1 - p)) * mask[:, :, 0]).sum() / mask.sum())

    for name, g in net.gradients(x, mask, y).items():
        for _ in range(6):
            at = tuple(int(draw.integers(n)) for n in net.p[name].shape)
            net.p[name][at] += 1e-5
            up = loss()
            net.p[name][at] -= 2e-5
            slope = (up - loss()) / 2e-5
            net.p[name][at] += 1e-5
            assert abs(slope - g[at]) < 1e-4 + 0.02 * abs(slope), name


def test_padding_and_batches_change_nothing():
    draw = np.random.default_rng(5)
    net = main_text.Labeller()
    made = [draw.normal(size=(n, main_text.WIDTH)).astype(np.float32) for n in (5, 0, 1, 9, 5, 30)]
    alone = [net.label([m])[0] for m in made]
    together = net.label(made, most=40)
    assert all((a == b).all() and len(a) == len(m) for a, b, m in zip(alone, together, made))


def test_open_tags_take_time_in_proportion():
    import time

    for text in ("<a " * 100_000, "<script " * 50_000, "<p title=\"x" * 50_000, "<a " * 100_000 + ">", "<!-- " * 50_000):
        start = time.process_time()
        blocks_of("<p>before</p>" + text)
        assert time.process_time() - start < 1


def test_what_has_no_end():
    text = lambda page: [b.text for b in blocks_of(page)]
    assert text("<p>a</p>b <!-- c") == ["a", "b"]
    assert text("<p>a</p><script>if (a > b) x") == ["a"]
    assert text("<p>a</p><!-- <b>c</b> d") == ["a"]
    assert text("<p>a</p>b < c") == ["a", "b < c"]
    assert text("<p>a <br>b") == ["a b"]
