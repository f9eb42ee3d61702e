import html
import random
import re

import numpy as np
import pytest

from hushframe.llm import html_text
from hushframe.llm.html_blocks import blocks
from hushframe.llm.lstm import BiLSTM, fit, padded

PATH = "/root/testdata/sf0.01/pages.parquet"


def texts(page):
    return [b.text for b in blocks(page)]


def test_blocks_of_pages():
    assert texts("") == texts("<p></p> \n") == []
    assert texts("plain &amp; simple") == ["plain & simple"]
    assert texts("<p>one <b>two</b>\n three<br>four<p>five</p>six") == ["one two three four", "five", "six"]
    assert texts("<title>no</title><script>var t='</p>';</script><style>p{}</style><p>a<!-- <p>b -->c") == ["ac"]
    assert texts("<script>never closed <p>x</p>") == []
    assert texts("a < b and 1<2 <p title='x > y'>c</p>") == ["a < b and 1<2", "c"]
    assert texts('<p class="open>a</p><p>b</p>')[-1] == "b"
    assert texts("<ul><li>a<li>b</ul><div>&nbsp;&#233;&copy d</div") == ["a", "b", "é© d"]
    assert texts("<TD>x</TD><!DOCTYPE html><P>y") == ["x", "y"]


def test_paths_and_links():
    found = blocks('<body><nav class="mainMenu top-bar"><ul><li><a href="/x">go</a></li></ul></nav><div id=content><p>see <a>here</a></p></div>')
    assert found[0].path == (("body",), ("nav", ".main", ".menu", ".top", ".bar"), ("ul",), ("li",)) and found[0].linked == 1
    assert found[1].path == (("body",), ("div", ".content"), ("p",)) and 0 < found[1].linked < 1


def test_odd_pages_do_not_stall():
    assert len(blocks("<p>x" * 50_000)) == 50_000
    assert blocks('<a href="' * 3000) is not None
    assert texts("<" * 10_000) == ["<" * 10_000]
    assert texts("w " * 1_000_000)[0].count("w") == 1_000_000


def test_gradients_are_right():
    rng = np.random.default_rng(1)
    model = BiLSTM(5, 3)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    x, mask, y = (a.astype(np.float64) for a in padded([(rng.normal(size=(n, 5)), rng.integers(0, 2, n)) for n in (4, 1, 6)]))
    _, grads = model.gradients(x, mask, y)
    for name, w in model.weights.items():
        for at in list(np.ndindex(w.shape))[:: max(1, w.size // 7)]:
            old, step = w[at], 1e-6
            w[at] = old + step
            up = model.gradients(x, mask, y)[0]
            w[at] = old - step
            down = model.gradients(x, mask, y)[0]
            w[at] = old
            assert grads[name][at] == pytest.approx((up - down) / (2 * step), rel=1e-3, abs=1e-6)


def test_context_of_the_whole_sequence_is_learned():
    rng = np.random.default_rng(2)
    data = []
    for _ in range(300):  # a step is 1 if the last step of its sequence is marked
        x = rng.normal(size=(6, 3))
        x[-1, 0] = rng.choice([-3, 3])
        data.append((x, np.full(6, float(x[-1, 0] > 0))))
    model = BiLSTM(3, 6)
    losses = fit(model, data[:250], 12)
    assert losses[-1] < 0.2 < losses[0]
    p = model.probabilities(*padded(data[250:])[:2])
    assert np.mean((p >= 0.5) == padded(data[250:])[2]) > 0.95


def main_text(page):
    """The article of a page of the given tables, cut out with patterns alone."""
    m = re.search(r"<article>(.*?)(?:</article>|\Z)", page or "", re.S)
    parts = re.split(r"</?(?:p|h1)>", m[1] if m else "")
    folded = [" ".join(html.unescape(re.sub(r"<[^>]*(?:>|\Z)", "", x.replace("<br>", " "))).split()) for x in parts]
    return "\n".join(x for x in folded if x)


def test_extraction_of_the_given_pages(spark):
    pages = spark.read.parquet(PATH)
    model = html_text.train(pages)
    got = {r["page_id"]: r for r in html_text.extract(pages, model).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    same = [got[r["page_id"]]["text"] == main_text(r["html"]) for r in rows]
    assert np.mean(same) > 0.98
    extra = spark.createDataFrame([(1, None, "u", "x"), (2, "", None, "x"), (None, "<p>", "u", "x"), (3, "<nav>a</nav>", "u", "x"), (3, "<nav>a</nav>", "u", "x")], "page_id long, html string, url string, text string")
    assert [r["text"] for r in html_text.extract(extra, model).collect()] == [""] * 5
    assert html_text.extract(pages.where("false"), model).count() == 0


def test_held_out_layouts(spark):
    pages = [r["html"] for r in spark.read.parquet(PATH).collect()]
    model = BiLSTM(html_text._WIDTH, html_text._HIDDEN)
    fit(model, html_text.training_sequences(pages[:120], 700), 4)
    rng, other = random.Random(77), [b.text for p in pages[150:] for b in blocks(p) if len(b.text.split()) > 4]
    made = [html_text.made_up_page(rng, other) for _ in range(300)]
    parsed = [blocks(p) for p, _, _ in made]
    right = total = 0
    for (page, a, b), own, p in zip(made, parsed, html_text.label(parsed, model)):
        wanted = np.zeros(len(own), bool)
        wanted[len(blocks(page[:a])) : len(blocks(page[:b]))] = True
        right, total = right + int(((p >= 0.5) == wanted).sum()), total + len(own)
    assert right / total > 0.97


def test_parts_inside_the_article_are_left_out(spark):
    pages = [r["html"] for r in spark.read.parquet(PATH).collect()]
    model = BiLSTM(html_text._WIDTH, html_text._HIDDEN)
    fit(model, html_text.training_sequences(pages[:120], 700), 4)
    rng, other = random.Random(78), [b.text for p in pages[150:] for b in blocks(p) if len(b.text.split()) > 4]
    made = [html_text.mixed_page(rng, other) for _ in range(300)]
    found = html_text.label([blocks(p) for p, _ in made], model)
    wanted, got = np.concatenate([y for _, y in made]) > 0.5, np.concatenate(found) >= 0.5
    assert np.mean(wanted == got) > 0.95


def test_labels_of_sampled_pages():
    page = "<main><h1>t</h1><p>a</p><div class='reader-comments'><p>no</p></div><form><p>no</p></form><aside>no</aside><section class=intro>b</section></main><p>no"
    assert [b.text for b in blocks(page) if html_text.in_article(b)] == ["t", "a", "b"]
    page, labels = html_text.mixed_page(random.Random(5), ["one two three four five six seven"])
    assert len(labels) == len(blocks(page)) and 0 < labels.sum() < len(labels)


def test_training_without_pages(spark):
    model = html_text.train(spark.createDataFrame([], "page_id long, url string, html string"), made_up=60, epochs=1)
    assert model.weights["out"].shape == (2 * html_text._HIDDEN,)


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        ("<article><p>one</p><math/><p>two</article>", ["one", "two"]),
        ('<article><p>one</p><svg class="i"/><p>two</article>', ["one", "two"]),
        ('<main><object data="x"><p>fallback</p><p>after</p></main>', ["fallback", "after"]),
        ("<p>one<iframe src=a><p>two", ["one", "two"]),
        ("<p>one<iframe src=a/><p>two<iframe>no</iframe><p>three", ["one", "two", "three"]),
        ("<p>one<svg><text>no</text></svg> more<p>two<script>var a", ["one more", "two"]),
        ("<p>one<textarea>typed</textarea><p>two <textarea>open", ["one", "two open"]),
    ],
)
def test_no_text_is_lost_after_embedded_parts(page, expected):
    assert [b.text for b in blocks(page)] == expected
