import html as stdlib_html
import random
import time

import numpy as np
import pytest

from fathomline.llm import html_extract as he

PAGES = [
    ("", ""),
    ("just text", "just text"),
    ("<p>One\n two</p><p>three</p>", "One two three"),
    ("<body><nav><ul><li><a href=x>Menu</a></ul></nav><div class='ad'>Buy this now please</div><article><h1>T &amp; U</h1><p><b>Long text here<br><p>A.</article><footer>&copy; me</footer>", "T & U Long text here A."),
    ("<article><p>in<b>li</b>ne</p><script>var t='</p>';</script><style>p{}</style><form>mail <input name=a></form><aside>side</aside><div id=comments>reader</div></article>", "inline"),
    ("<main><p>" + "word " * 50 + "</p><p>x &quo", "word " * 50 + "x &quo"),
    ("<article><p>cut off<p cla", "cut off"),
    ("<!DOCTYPE html><!-- c --><article>a&nbsp;b &#233;&hellip;</article>", "a b é…"),
    ("<div role=navigation>n</div><div>" + "long words " * 20 + "</div><div class='site-footer'>f</div>", ("long words " * 20).strip()),
]


@pytest.mark.parametrize(("page", "want"), PAGES)
def test_pages(page, want):
    assert he.extract(page) == want


def test_made_pages_keep_the_article_only():
    rng = random.Random(4)
    for _ in range(200):
        line = lambda n: " ".join("".join(rng.choices("abcdé&<", k=rng.randint(1, 8))) for _ in range(rng.randint(1, n)))
        blocks = [line(rng.choice([1, 5, 80])) for _ in range(rng.randint(1, 12))]
        body = "".join(f"<p>{stdlib_html.escape(b)}</p>" for b in blocks)
        page = f"<html><head><title>t</title></head><body><nav><a>{'m' * 40}</a></nav><div class=\"ad\">{line(60).replace('<', '')}</div><article>{body}</article><footer>{'f ' * 40}</footer></body></html>"
        assert he.extract(page) == " ".join(" ".join(b.split()) for b in blocks)


def test_smoothing_matches_a_plain_loop():
    x = np.random.default_rng(0).random(9)
    w = {k: np.exp(-0.5 * (k / he.SIGMA) ** 2) for k in range(-he.RADIUS, he.RADIUS + 1)}
    want = [sum(w[k] * x[i + k] for k in w if 0 <= i + k < 9) / sum(w[k] for k in w if 0 <= i + k < 9) for i in range(9)]
    assert np.allclose(he.smoothed(x), want)


def test_table(spark):
    rows = [(1, "u", "<p>a", 5), (None, None, None, 6), (1, "u", "<p>a", 5), (2, "v", "<p>" + "w " * 100000, 7)]
    out = he.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert sorted([(str(r.page_id), r.n_chars) for r in out]) == [("1", 1), ("1", 1), ("2", 199999), ("None", 0)]
    assert he.main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_hostile_pages_take_time_in_proportion():
    for page in (lambda n: "<a>" * n + "</b>" * n, lambda n: "<ul>" + "<b>" * n + "<li></li>" * n, lambda n: "<div><p>" * n + "x" + "</i>" * n):
        spent = []
        for n in (16000, 64000):
            began = time.perf_counter()
            he.extract(page(n))
            spent.append(time.perf_counter() - began)
        assert spent[1] < 8 * spent[0] + 0.2


STORY = "A long sentence of the story that goes on and on for a while, as stories do. " * 4


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<div><p>{STORY}</p><p>{STORY}</p></div><article><h3>Teaser</h3><p>{STORY}</p></article>", f"{STORY}{STORY}Teaser {STORY}"),
        (f"<div class='content no-sidebar'><article><p>{STORY}</article></div><div class=sidebar>links</div>", STORY),
        (f"<div class='with-sidebar'><div class='has_menu' id=without-ads><p>{STORY}</p></div></div><div class='piano-menu'>links</div>", STORY),
        (f"<div class='content with-sidebar'><p>{STORY}</div><div id=left-sidebar>links</div>", STORY),
        (f"<article class='post comment-open ad'><p>{STORY}</article><ul class='comment-list'><li>{STORY}</ul>", STORY),
        (f"<p class=notice>x<p>{STORY}<p class='advert_box'>{STORY}", STORY),
        (f"<div class=widget><p>{STORY}</div><nav>{STORY}</nav>", STORY),
        (f"<p>{STORY}<span class=share>Share <b>this</b></span> end", f"{STORY}end"),
        (f"<article><p class=ad>Buy now<p>{STORY}<p class=ad>Buy <b>more<div>{STORY}</div></article>", f"{STORY}{STORY}"),
        (f"<article><ul><li class=promo>Buy<ul><li>this</ul><li>{STORY}<li class=promo>Buy</ul><p>{STORY}</article>", f"{STORY}{STORY}"),
        (f"<article><dl><dt class=ad>Buy<dd>{STORY}</dl></article>", STORY),
    ],
)
def test_clusters_beside_elements_layout_names_and_implied_ends(page, want):
    assert he.extract(page) == " ".join(want.split())
