"""Extraction against hand-marked pages: ``[[ ]]`` marks the main text."""

import re
import time

import numpy as np
import pytest

from funnelkit.llm import page_text

LONG = "The river rose for three days and nobody in the lower town could remember water standing that high before, not even the oldest of the millers."
MORE = "On the fourth morning the rain stopped, the carts came back over the ridge, and people began to carry their chairs and beds out into the sun to dry."
COMMENT = "I remember that flood very well because my grandmother lost two goats and a whole winter of hay, and she told us about it each time that it rained."

PAGES = {
    "article": f"<nav><a href=/>Home</a> <a href=/n>News</a></nav><article><h1>[[Flood]]</h1><p>[[{LONG}]]</p><p>[[No.]]</p></article><footer>{COMMENT}</footer>",
    "plain blocks": f"<div>Valley Post</div><div><a>Home</a> <a>News</a> <a>Sport</a></div><div>[[{LONG}]]</div><div>[[A heading]]</div><div>[[{MORE}]]</div><div>[[{LONG}]]</div>"
                    "<div><a>Terms</a> <a>Privacy</a></div><div>Copyright 2020 all rights are reserved by us</div>",
    "plain paragraphs in a table": f"<table><tr><td><a>One</a><td><a>Two</a><td><a>Three</a></table><p>[[{MORE}]]<p>[[{LONG}]]<table><tr><td><a>Imprint</a></table>",
    "misleading names": f'<div class="search content"><h1>[[Flood]]</h1><p>[[{LONG}]]</p><p>[[They left.]]</p><p>[[{MORE}]]</p></div>',
    "telling names": f'<div class="post-content"><h2>[[Flood]]</h2><p>[[Short.]]</p><p>[[{LONG}]]</p></div><div id="comments"><p>{COMMENT}</p><p>{COMMENT}</p></div>',
    "side blocks in the article": f'<article><p>[[{LONG}]]</p><aside><p>{COMMENT}</p></aside><div class="advert">Buy three pumps and pay for two of them only today</div><p>[[{MORE}]]</p>'
                                  "<ul><li><a>Rain</a></li><li><a>Hay prices</a></li><li><a>Goats</a></li></ul></article>",
    "references and spaces": f"<article><p>[[A &lt;b&gt; &amp;\n\n  c &#233;]]</p><p> <b>[[{LONG}</b><br>x]]</p><p>&nbsp;</p></article>",
    "math stays": f"<article><p>[[Let <math><mi>x</mi></math> be deep. {LONG}]]</p></article>",
    "an open head": f"<head><title>t</title><meta x><p>[[{LONG}]]<p>[[{MORE}]]",
    "raw elements": f"<article><script>if (a < b) '</p>'</script><style>p{{}}</style><p>[[{LONG}]]</p><!-- <p>{COMMENT}</p> --><textarea><p>{COMMENT}</textarea><noscript><p>{COMMENT}</p></noscript></article>",
}


@pytest.mark.parametrize("name", PAGES)
def test_hand_marked_pages(name):
    marked = PAGES[name]
    wanted = re.findall(r"\[\[(.*?)\]\]", marked, re.S)
    import html

    wanted = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<br>", " ", re.sub(r"</?(?:b|math|mi)>", "", w)))).strip() for w in wanted]
    assert page_text.main_text(marked.replace("[[", "").replace("]]", "")) == "\n\n".join(wanted)


@pytest.mark.parametrize("tag", ["button", "svg", "select", "iframe", "object", "noscript"])
def test_unclosed_elements_end_at_the_next_block(tag):
    assert page_text.main_text(f"<article><p>{LONG} <{tag} x=1>press <i>here</i></p><p>{MORE}</p><p>End <{tag}>no</{tag}>.</p></article>") == f"{LONG}\n\n{MORE}\n\nEnd ."


def test_time_grows_with_the_length():
    def seconds(page):
        t = time.perf_counter()
        page_text.main_text(page)
        return time.perf_counter() - t

    for make in (lambda n: "<div>" * n + "x", lambda n: "<div>" * n + "</p>" * n, lambda n: "<button>" * n, lambda n: "<svg>" * n + "<p>x", lambda n: "<p>x <b>" * n):
        small, large = min(seconds(make(25_000)) for _ in range(2)), seconds(make(100_000))
        assert large < 10 * small + 1


def test_the_tree_uses_words_and_links():
    """Own words and link density, and those of a neighbour, decide in the fitted tree."""
    m = page_text.model()
    nodes = np.flatnonzero(m.left[0] != np.arange(m.left.shape[1]))
    used = set(m.feature[0, nodes].tolist())
    assert {0, 1} <= used and used & {2, 3, 4, 5}
    rows = np.array([[float(v) for v in line.split()] for line in page_text.LABELLED.split("\n") if line])
    assert np.mean((m.raw(rows[:, :-1]) > 0) == rows[:, -1]) > 0.97


def test_the_given_pages(spark):
    """Every paragraph of a page's article, and nothing else."""
    from funnelkit.llm import queries

    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = queries.queries()["op3_page_text"](spark, sf).collect()
    assert len(rows) == len(pages)
    import html

    for r in rows:
        body = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        parts = re.split(r"</?(?:p|h1)[^>]*>", re.sub(r"<!--.*?-->", "", body, flags=re.S))
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"</?b>", "", x.replace("<br>", " ")))).strip() for x in parts]
        assert r.text == "\n\n".join(x for x in parts if x) and r.n_chars == len(r.text)
