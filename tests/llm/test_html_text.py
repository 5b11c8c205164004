"""Main text of pages: the article of every test page, consensus over a host, and broken markup."""

import html
import re
import time

import pytest

from fleetline.llm import html_text as h
from fleetline.llm import queries


def article(page):
    inner = re.search(r"<article>(.*?)</article>", page or "", re.S)
    parts = re.split(r"</?(?:h1|p)>|<br>", inner[1]) if inner else []
    found = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", "", p))).strip() for p in parts]
    return "\n\n".join(p for p in found if p)


def test_whole_table(spark, sf_dir):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = queries.queries()["op2_html"](spark, sf_dir).collect()
    assert sorted(r["page_id"] for r in got) == sorted(pages)
    for r in got:
        assert r["text"] == article(pages[r["page_id"]]["html"]) and r["n_chars"] == len(r["text"])
        assert r["url"] == pages[r["page_id"]]["url"]


LONG = "A sentence of the story, told at some length so that it counts. " * 4


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("  just  text ", "just text"), ("<p>One<p>Two", "One\n\nTwo"),
    (f"<body><div class='nav'>Menu</div><div class='post'><p>{LONG}</p><p>a<b>b</b> c&amp;d &lt;x&gt;</p></div><footer>f</footer></body>",
     LONG.strip() + "\n\nab c&d <x>"),
    (f"<main><h1>T</h1><p>{LONG}<br>x</p><aside>side</aside><form>f<input></form><section class='comments'><p>{LONG}</p></section></main>",
     "T\n\n" + LONG.strip() + " x"),
    (f"<article><header><h1>T</h1></header><p>{LONG}</p><script>if (a < b) '</p>'</script><style>p {{}}</style><!-- <p>no</p> --></article>",
     "T\n\n" + LONG.strip()),
    (f"<article><p>{LONG}</p><div id=cookie-notice>We use cookies</div><ul class=share><li>x</li></ul><ul><li>one<li>two</ul></article>",
     LONG.strip() + "\n\none\n\ntwo"),
    (f"<div><p>{LONG}</p><p>un<i>closed</p></div></b><p>after", LONG.strip() + "\n\nunclosed"),
    (f"<article><p>{LONG}</p><p>1 < 2 & 3 > 2 &nbsp; &#233;&eacute;</article", LONG.strip() + "\n\n1 < 2 & 3 > 2 éé"),
])
def test_pages(page, text):
    assert h.main_text(page, None) == text


def test_hosts_vote(spark):
    def page(story, side):
        return f"<body><div class='c{story[1]}'><p>{story[0]}</p></div><div class='x'><p>{side}</p></div></body>"

    # One page has more text beside the story than in it; its host's other pages say which container is the story.
    rows = [(i, f"http://h.example/{i}", page((LONG, i), "short"), "old") for i in range(5)]
    rows += [(9, "https://H.example:80/x", page(("Brief story.", 9), LONG), "old"), (10, None, None, None), (10, None, None, None),
             (11, "no host", page((LONG, 1), ""), "old")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = h.extract(df)
    assert out.columns == ["page_id", "url", "html", "text", "n_chars"]
    got = [(r["page_id"], r["text"]) for r in out.collect()]
    assert dict(got)[9] == "Brief story." and dict(got)[0] == LONG.strip() and dict(got)[11] == LONG.strip()
    assert got.count((10, "")) == 2 and h.extract(df.limit(0)).count() == 0


def test_deep_and_long_pages_are_read_whole():
    deep = "<div>" * 20_000 + f"<p>{LONG}</p>" + "</div>" * 20_000
    assert h.main_text(deep, None) == LONG.strip()
    long = "<article>" + "".join(f"<p>{LONG}{i}</p>" for i in range(3000)) + "</article>"
    assert h.main_text(long, None).count("\n\n") == 2999


MENU = "<div class='main-nav'><p>Menu words</p></div><div class='site-footer'>Foot words</div><div id='left-sidebar'><p>Side words</p></div>"


@pytest.mark.parametrize("start, end", [
    ("<html class='no-sidebar'><body class='right-sidebar'><div>", "</div></body></html>"), ("<body class='no-sidebar'><div class=post>", "</div></body>"),
    ("<body><div class='content-with-sidebar'>", "</div></body>"), ("<body><article class='post category-social'>", "</article></body>"),
    ("<body><main class='search-results'>", "</main></body>"), ("<body><main><article class='teaser-large post'>", "</article></main></body>"),
    ("<body><p class='page-header-wide'>", "</p></body>"), ("<body><div class='widget'>", "</div></body>")])
def test_layout_names_do_not_drop_the_article(spark, start, end):
    inner = "" if "<p class" in start else f"<p>{LONG}</p>"
    page = f"{start}{inner or LONG}{end}"
    assert h.main_text(page, None) == LONG.strip()
    if "class='widget'" not in start and "<p class" not in start:
        assert h.main_text(f"{start}{inner}{MENU}{end}", None) == LONG.strip()


def test_named_boilerplate_stays_out():
    """Comments never count, however long, nor does what a word heads."""
    for name in ("comments", "post-comments", "comments-area", "cookie-notice", "sidebar-left"):
        assert h.main_text(f"<body><div class=post><p>{LONG}</p></div><div class='{name}'><p>{LONG * 5}</p></div></body>", None) == LONG.strip()
    nested = f"<article class='post'><p>{LONG}</p><article class='comment'><p>{LONG * 5}</p></article></article>"
    assert h.main_text(nested, None) == LONG.strip()


PARTS = [("<h1>T</h1>" + f"<p>{LONG * 2}</p>", "T\n\n" + (LONG * 2).strip()), (f"<section class=a><p>{LONG * 8}</p></section>", (LONG * 8).strip()),
         (f"<section class=b><p>{LONG * 8}</p></section>", (LONG * 8).strip())]
NESTED = "\n\n".join(t for _, t in PARTS)


@pytest.mark.parametrize("page, text", [
    (f"<article>{''.join(p for p, _ in PARTS)}</article>", NESTED),
    (f"<article>{''.join(p for p, _ in PARTS)}</article>".replace(" class=a", "").replace(" class=b", ""), NESTED),
    (f"<main>{''.join(p for p, _ in PARTS)}</main>", NESTED),
    (f"<div class=story><div class=lead><p>{LONG}</p></div><div class=body><p>{LONG * 6}</p></div></div>", LONG.strip() + "\n\n" + (LONG * 6).strip()),
    (f"<div class=lead><p>{LONG}</p></div><div class=body><p>{LONG * 6}</p></div><div class=x><p>{LONG}</p></div>", LONG.strip() + "\n\n" + (LONG * 6).strip()),
    (f"<article><p>{LONG}</p><blockquote><p>{LONG * 5}</p></blockquote><p>End.</p></article>", LONG.strip() + "\n\n" + (LONG * 5).strip() + "\n\nEnd."),
    (f"<article><p>{LONG}</p><table><tr><td>{LONG * 3}<td class=n>12</table></article>", LONG.strip() + "\n\n" + (LONG * 3).strip() + "\n\n12"),
    (f"<div class=wrap><div class=c><p>{LONG * 3}</p></div><div class=x><p>{LONG}</p></div></div>", (LONG * 3).strip()),
])
def test_the_article_is_whole(spark, page, text):
    page = f"<body><nav>Menu</nav>{page}<footer>Foot</footer></body>"
    assert h.main_text(page, None) == text
    df = spark.createDataFrame([(i, f"http://h.example/{i}", page) for i in range(3)], "page_id long, url string, html string")
    assert [r["text"] for r in h.extract(df).collect()] == [text] * 3


@pytest.mark.parametrize("inner", [
    "<section id='social-science'><p>{}</p></section>", "<section id='search-engines'><p>{}</p></section>",
    "<section id='notice-of-hearing'><p>{}</p></section>", "<h2 id='reply-to-critics'>{}</h2>", "<p class='header'>{}</p>",
    "<div class='text-notice-block'><p>{}</p></div>", "<div class='header'><h1>{}</h1></div>", "<div id='related-work'><p>{}</p></div>",
    "<h3 class='share'>{}</h3>", "<p id='search'>{}</p>"])
@pytest.mark.parametrize("start, end", [("<article>", "</article>"), ("<div class='post'>", "</div>")])
def test_names_do_not_drop_parts_of_an_article(inner, start, end):
    page = f"<body><nav>Menu</nav>{start}<p>{LONG}</p>{inner.format('A part of it.')}<p>{LONG}</p>{end}<footer>Foot</footer></body>"
    assert h.main_text(page, None) == f"{LONG.strip()}\n\nA part of it.\n\n{LONG.strip()}"


@pytest.mark.parametrize("inner", [
    "<div class='ad'>Buy</div>", "<p class='ad'>Buy</p>", "<div class='share-bar'>Share</div>", "<section class='comments'><p>First!</p></section>",
    "<div class='related-posts'><p><a href=x>More</a></p></div>", "<div class='social-science-links'><a href=x>One more</a></div>",
    "<div class='newsletter'><p>Sign up</p></div>", "<div id='cookie-notice'>We use</div>", "<div class='sidebar-right'>Side</div>"])
def test_furniture_inside_an_article_is_dropped(inner):
    page = f"<body><article><p>{LONG}</p>{inner}<p>{LONG}</p></article></body>"
    assert h.main_text(page, None) == f"{LONG.strip()}\n\n{LONG.strip()}"


@pytest.mark.parametrize("page", [
    "<a " * 350_000, "<a \"" * 250_000, "<a '\" " * 150_000 + ">", "<div>" * 20_000 + "</p>" * 100_000, "<b>" * 20_000 + "<hr>" * 50_000,
    "<b>" * 10_000 + "<div>" * 10_000 + "</b>" * 10_000, "<!--" * 200_000, "<script>" * 100_000, "<p><b>" * 50_000, "<" * 1_000_000])
def test_broken_markup_takes_linear_time(page):
    start = time.perf_counter()
    h.parse(page)
    assert time.perf_counter() - start < 10
