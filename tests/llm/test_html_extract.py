import html
import re

import pytest

from leadlane.llm import html_extract as H
from tests.conftest import SMOKE


def article_of(page):
    """Brute force for the given pages, whose article element is marked: its blocks without any scoring."""
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>|<br>", " ", body))
    return "\n".join(x for x in (" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in parts) if x)


def test_given_pages(spark):
    got = {r.page_id: r for r in H.html_extract(spark, SMOKE).collect()}
    pages = spark.read.parquet(f"{SMOKE}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        r = got[p.page_id]
        assert r.text == article_of(p.html) and r.n_chars == len(r.text) and r.url == p.url


TEXT = "This is a sentence of the article, with commas, and it goes on for a while. "


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("just text", "just text"), ("a &lt; b &amp;&nbsp; c &#233; &eacute;", "a < b & c é é"),
    ("<p>cut off <b>here", "cut off here"), ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"),
    ("<p>a<!-- <p>no</p> -->b</p><p>c<!-- open", "ab\nc"), ("<script>var t='</p>' </script>x", "x"),
    ("<p>one<br>two\n\n three</p></div></p><p>four</b> five", "one two three\nfour five"),
    (f"<div id=top-menu><ul><li><a href=/>Home</a></ul></div><div class='text'><h2>Title</h2><p>{TEXT * 3}</p><p>{TEXT}<p>Short.</div>"
     f"<div class='reader-comments'><p>{TEXT * 4}</p></div><div class='cookie notice'>{TEXT}</div>",
     f"Title\n{(TEXT * 3).strip()}\n{TEXT.strip()}\nShort."),
    (f"<header><p>{TEXT}</p></header><main><p>{TEXT}</p><form>{TEXT}<input value='a'></form><table><tr><td>a<td>b</table></main><aside>{TEXT * 9}</aside>",
     f"{TEXT.strip()}\na\nb"),
    (f"<div><a href=1>one</a> | <a href=2>two</a> | <a href=3>three</a></div><div><p>{TEXT * 2}</p><p>{TEXT}</p></div><div><a href=4>link</a> <a href=5>other</a></div>",
     f"{(TEXT * 2).strip()}\n{TEXT.strip()}"),
    (f"<div class='page has-sidebar'><p>{TEXT}</p><div class=sidebar>{TEXT * 2}</div></div>", TEXT.strip()),
    (f"<div id=overlay><nav>x</nav><p>{TEXT}</p></div>", TEXT.strip()),
])
def test_pages(page, text):
    assert H.main_text(page) == text


@pytest.mark.parametrize("page, text", [
    (f"<article><h1>T</h1><div class=body><p>{TEXT * 9}</p></div></article>", f"T\n{(TEXT * 9).strip()}"),
    (f"<div><div class=lead>Short lead.</div><div class=body><p>{TEXT * 9}</p><p>{TEXT * 9}</p></div></div>", f"Short lead.\n{(TEXT * 9).strip()}\n{(TEXT * 9).strip()}"),
    (f"<div id=page><div><h1>T</h1></div><section><p>{TEXT * 40}</p></section><section><p>{TEXT}</p></section></div>", f"T\n{(TEXT * 40).strip()}\n{TEXT.strip()}"),
    (f"<article><h2><a href=1>Linked heading</a></h2><p>{TEXT * 5}</p><ul><li><a href=2>Reference one</a><li><a href=3>Reference two</a></ul></article>",
     f"Linked heading\n{(TEXT * 5).strip()}\nReference one\nReference two"),
    (f"<h1>T</h1><article><p>{TEXT * 5}</p></article><div>Not of the article.</div>", f"T\n{(TEXT * 5).strip()}"),
])
def test_whole_article_stays(page, text):
    assert H.main_text(page) == text


@pytest.mark.parametrize("page, text", [
    (f"<article><section id='social-history'><h2 id=search-and-rescue>Search</h2><p>{TEXT}</p></section><p>{TEXT * 3}</p></article>",
     f"Search\n{TEXT.strip()}\n{(TEXT * 3).strip()}"),
    (f"<article><div class='entry-header'><h1>T</h1></div><p>{TEXT * 3}</p><div class='note alert'>Mind this.</div></article>", f"T\n{(TEXT * 3).strip()}\nMind this."),
    (f"<article><p>{TEXT * 3}</p><div class='social share'><a href=1>One</a> <a href=2>Two</a></div><div class=ad>Buy this.</div></article>", (TEXT * 3).strip()),
    (f"<div class=entry-header>Slogan</div><h2 id=related-work>Related</h2><p>{TEXT * 3}</p>", f"Related\n{(TEXT * 3).strip()}"),
])
def test_names_in_an_article_need_ratios(page, text):
    assert H.main_text(page) == text


BARE = [
    (f"<div>Welcome to our site</div><div><p>{TEXT * 3}</p><p>{TEXT * 2}</p></div><div>Imprint and contact</div>", f"{(TEXT * 3).strip()}\n{(TEXT * 2).strip()}"),
    (f"<table><tr><td>Mon<td>Tue<td>Wed</table><div><h2>Title</h2><p>{TEXT * 4}</p><ul><li>Point</ul><p>{TEXT * 4}</p></div><div><b>Sign in</b></div>",
     f"Title\n{(TEXT * 4).strip()}\nPoint\n{(TEXT * 4).strip()}"),
    (f"<div><div>Today 12 degrees</div><div><div><p>{TEXT * 5}</p></div></div></div><ul>" + "<li>Short item" * 9 + "</ul>", (TEXT * 5).strip()),
]


@pytest.mark.parametrize("page, text", BARE[:2])
def test_ratios_decide_where_nothing_is_marked(page, text, monkeypatch):
    """No article, class or id: only the scores tell the text from what is around it, so equal scores must fail."""
    assert H.main_text(page) == text
    monkeypatch.setattr(H, "path_scores", lambda blocks, spread=1.0: {b.element.path: b.prior for b in blocks})
    assert H.main_text(page) != text


def test_items_outside_the_content_go():
    got = H.main_text(BARE[2][0])
    assert BARE[2][1] in got and "Short item" not in got


def test_given_pages_without_marks(spark):
    """The given pages with article and the advert's class taken off: the ratios find nearly all articles."""
    pages = [r.html for r in spark.read.parquet(f"{SMOKE}/pages.parquet").collect()]
    bare = [re.sub(r"(</?)article>", r"\1div>", p).replace(' class="ad"', "") for p in pages]
    assert sum(H.main_text(b) == article_of(p) for p, b in zip(pages, bare)) >= 0.9 * len(pages)


@pytest.mark.parametrize("page, text", [
    # A doubtful name lowers a score but a whole text stands against it; a sure one, and kinds of elements, weigh more.
    (f"<h1>T</h1><div class=search-content><p>{TEXT * 40}</p></div>", f"T\n{(TEXT * 40).strip()}"),
    (f"<div><p>{TEXT}</p></div><div class=comments><p>{TEXT * 400}</p></div><aside>{TEXT * 400}</aside>", TEXT.strip()),
    (f"<footer>{TEXT * 3}</footer>", ""), (f"<nav><a href=1>x</a></nav><div class=ad>{TEXT}</div><article></article><footer>{TEXT}</footer>", ""),
    (f"<article><p>{TEXT}</p><div class=comment>{TEXT * 50}</div></article>", TEXT.strip()),
])
def test_evidence_lowers_scores(page, text):
    assert H.main_text(page) == text


def test_hostile_pages():
    assert H.main_text("<div>" * 50000 + "deep") == "deep"
    assert H.main_text("<" * 100000).count("<") == 100000
    assert H.main_text("<p " + "a=\"" * 20000) is not None
    assert len(H.main_text("<p>" + TEXT * 50000)) == len(TEXT) * 50000 - 1


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, None, None, 2), (1, None, None, 2), (None, "u", "<p>x", 3)], "page_id long, url string, html string, text int")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in H.extract(df).collect()) == [(0, "x", 1), (1, "", 0), (1, "", 0)]
    assert H.extract(df.limit(0)).count() == 0
