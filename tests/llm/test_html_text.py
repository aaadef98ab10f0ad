"""Main text of pages: what goes, what stays, and how blocks are joined."""

import html
import re
import time

import pytest

from corpuscle.llm import html_text
from corpuscle.llm.html_text import extract, main_text

PARAS = [f"This is paragraph number {k} of the article and it says a thing or two at some length." for k in range(4)]
BODY = "".join(f"<p>{p}</p>" for p in PARAS)


@pytest.mark.parametrize(
    "junk",
    [
        "<nav><ul><li><a href='/'>Home page of the site with many words in it</a></li></ul></nav>",
        "<div class='cookie-notice'>We use cookies to improve your experience on this website, please accept all of them now.</div>",
        "<aside>Related reading which is quite long and tempting to take for content of the page</aside>",
        "<form><p>Write us your name and a long message here please</p><input name=a><button>Send it</button></form>",
        "<section id='comments'><p>A reader says that this article is very long and interesting and so on.</p></section>",
        "<div class='ad'>Buy this now, it is cheap and it is good and it is here for you only today.</div>",
        "<div class='sideBar left'>Long text in the sidebar which is not the article and goes on.</div>",
        "<script>if (a < b) document.write('<p>script text that is long enough</p>');</script>",
        "<style>p{margin:0}</style><noscript>Please turn on scripts to see this page as it should be</noscript>",
        "<div role='complementary'>Another sidebar by its role with quite a bit of text in it</div>",
        "<!-- a comment with <p>markup</p> -->",
        "<footer><p>Copyright of the site, all rights reserved, imprint and so on and so on</p></footer>",
        "<div hidden>hidden text that no reader ever sees on the page at all</div>",
    ],
)
@pytest.mark.parametrize("frame", ["<article>{}</article>", "<main>{}</main>", "<div class='story'>{}</div>", "<div class='page has-sidebar no-ads'><div id='x'>{}</div></div>"])
def test_junk_goes_and_paragraphs_stay(junk, frame):
    inside = "<h1>A title</h1>" + BODY + junk
    page = "<html><head><title>t</title></head><body><header><h2>Site name and a slogan</h2></header>" + junk + frame.format(inside) + junk + "</body></html>"
    assert main_text(page) == "\n".join(["A title", *PARAS])


def test_blocks():
    assert main_text("<article><p>a &amp; b&nbsp;&eacute;&#x41;\n  c<br>d <b>e</b>f<p>g<ul><li>h<li>i</ul>j</article>") == "a & b éA c d ef\ng\nh\ni\nj"
    assert main_text("just text &lt;here&gt;") == "just text <here>"
    assert main_text(None) == main_text("") == main_text("<p> \n </p>") == ""
    assert main_text("<article><p>" + "x " * 200_000 + "</p></article>") == ("x " * 200_000).strip()
    assert main_text("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>") == "deep"
    assert main_text("<body><div class='page-header'>site</div><article><header class='entry-header'><h1>t</h1></header><p>one</p></article>") == "t\none"
    assert main_text("</p></div><article><p>one</p></b></article><p>&am") == "one"


LONG = "This is the greater part of the page's text, and it goes on for a good while. " * 12


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<body><p>An introduction of some words.</p><blockquote>{LONG}</blockquote><p>An end of some words.</p></body>", ["An introduction of some words.", LONG.strip(), "An end of some words."]),
        (f"<body><h1>A title</h1><div>{LONG}</div></body>", ["A title", LONG.strip()]),
        (f"<body><div>{LONG}</div><div>{LONG[:158]}</div></body>", [LONG.strip(), LONG[:158].strip()]),
        (f"<main><h1>A title</h1><article><p>{LONG}</p></article><p>{LONG[:158]}</p></main>", ["A title", LONG.strip(), LONG[:158].strip()]),
    ],
)
def test_all_main_text_stays(page, want):
    assert main_text(page) == "\n".join(want)


def test_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r for r in extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1].replace("<br>", " ")
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)\b[^>]*>", inner))
        assert got[r.page_id].text == "\n".join(b for b in blocks if b)
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


def test_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, None, "x"), (None, "u", "<p>one</p>", "y"), (1, "u", "", "z")], "page_id long, url string, html string, text string")
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in extract(pages).collect()) == [("1", "", 0), ("1", "", 0), ("None", "one", 3)]
    assert extract(pages.where("false")).count() == 0


#: Pages without article, main or telling names: only ratios can tell text from the rest.
PLAIN_PAGES = [
    ("<body><div class='x1'><a href=1>Home of all</a><a href=2>Other places</a><a href=3>Third one of them</a></div><div class='q'><h1>A title</h1>{}<p>Short.</p></div><div class='z9'><span>2020</span><span>City</span><span>Town</span></div></body>", True),
    ("<table><tr><td><a href=1>One</a></td><td><a href=2>Two</a></td></tr><tr><td><div><h2>A title</h2>{}<p>Short.</p></div></td></tr><tr><td><i>x</i><i>y</i></td></tr></table>", True),
    ("<div><ul><li><b>1</b><li><b>2</b><li><b>3</b></ul></div><div><div><h1>A title</h1></div>{}<p>Short.</p></div><div><em>a</em> <em>b</em> <em>c</em></div>", True),
]


@pytest.mark.parametrize("page, _", PLAIN_PAGES)
def test_ratios_decide(page, _, monkeypatch):
    want = "\n".join(["A title", *PARAS, "Short."])
    assert main_text(page.format(BODY)) == want
    for constant in (0.0, 1.0):
        monkeypatch.setattr(html_text, "ratios", lambda lines, out, c=constant: [c] * len(lines))
        assert main_text(page.format(BODY)) != want


@pytest.mark.parametrize(
    "page, want",
    [
        ("<nav>menu of it</nav><article class='legal-analysis'><h1>A title</h1>{}</article><footer>foot</footer>", ["A title", *PARAS]),
        ("<nav>menu of it</nav><div id='search-history'><h1>A title</h1>{}</div><footer>foot</footer>", ["A title", *PARAS]),
        ("<article><h1>A title</h1><div id='search-history'>{}</div><div class='share-buttons'>Send it on</div></article>", ["A title", *PARAS]),
        ("<form id='page'><div>{}</div></form>", PARAS),
        ("<main>{}<div hidden='hidden'>never seen at all by anyone</div><p style='color: red; display: none'>nor this one</p></main>", PARAS),
        ("<article>{}</article><article><h3><a href='/2'>Another article to read</a></h3><p>It has a line too.</p></article>", PARAS),
        ("<article></article><div class='ad'>Only an advert is on this page, nothing else.</div>{}".replace("{}", ""), []),
    ],
)
def test_names_are_evidence_only(page, want):
    assert main_text(page.format(BODY)) == "\n".join(want)


@pytest.mark.parametrize("page", ["<div>" * 20_000 + "deep text", "<div><i class=k>" * 20_000 + "deep text", "<b id=x>" * 20_000 + "deep text" + "</p></i></a>" * 20_000, "<p>deep text" + "<ul><li>" * 20_000])
def test_deep_pages_take_linear_time(page):
    began = time.perf_counter()
    assert main_text(page) == "deep text"
    assert time.perf_counter() - began < 3


@pytest.mark.parametrize(
    "inner, want",
    [
        (f"<div class='share-economy'>{BODY}</div>", PARAS),
        (f"{BODY}<p class='legal-note'>A note on the law which belongs to the text of this article.</p>", [*PARAS, "A note on the law which belongs to the text of this article."]),
        (f"{BODY}<div class='related-work'><h2>Related work</h2>{BODY}</div>", [*PARAS, "Related work", *PARAS]),
        (f"{BODY}<blockquote class='comment'>Somebody said this at some length, and the article quotes it.</blockquote>", [*PARAS, "Somebody said this at some length, and the article quotes it."]),
        (f"{BODY}<div class='share-buttons'>Send it on</div>", PARAS),
    ],
)
def test_names_delete_no_main_text(inner, want):
    junk = "<nav><a href=1>One of many</a><a href=2>Two of many</a></nav>"
    assert main_text(f"<body>{junk}<article><h1>A title</h1>{inner}</article><footer>The foot of the page</footer></body>") == "\n".join(["A title", *want])


def articles(rows):
    out = {}
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1].replace("<br>", " ")
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)\b[^>]*>", inner))
        out[r.page_id] = [b for b in blocks if b]
    return out


def test_clusters_find_articles_without_names(spark, sf, monkeypatch):
    """On pages whose elements are all ``div`` and have no classes, and where names mean nothing, all blocks of articles stay."""
    rows = spark.read.parquet(sf.replace("0.001", "0.01") + "/pages.parquet").collect()
    want = articles(rows)
    whole = lambda text, k: set(want[k]) <= set(text.split("\n"))
    bare = {r.page_id: re.sub(r"<(article|nav|footer|h1|ul|li|div)\b[^>]*>", "<div>", re.sub(r"</(article|nav|footer|h1|ul|li)>", "</div>", r.html)) for r in rows}
    assert sum(whole(main_text(h), k) for k, h in bare.items()) >= 0.98 * len(rows)
    for name in ("MAIN", "ASIDE", "ROLES", "MARKS"):
        monkeypatch.setattr(html_text, name, frozenset())
    assert sum(whole(main_text(r.html), r.page_id) for r in rows) >= 0.98 * len(rows)


@pytest.mark.parametrize("constant", [0.0, 1.0])
def test_results_come_through_the_ratios(spark, sf, monkeypatch, constant):
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    before = [main_text(r.html) for r in rows]
    monkeypatch.setattr(html_text, "ratios", lambda lines, out: [constant] * len(lines))
    assert sum(main_text(r.html) != b for r, b in zip(rows, before)) >= 0.9 * len(rows)
