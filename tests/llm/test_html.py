import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import html

LONG = "Some plain sentence, with a comma, that is long enough to count as a paragraph of an article. "


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t=\"</p>\";</script></head><body>{body}</body></html>"


@pytest.mark.parametrize(
    "body,want",
    [
        (f"<nav><a href=x>Menu</a></nav><article><h1>Head</h1><p>{LONG}</p><p>Short.</p></article><footer>Foot, of the page</footer>", f"Head {LONG.strip()} Short."),
        (f"<div id=page><div class='content'><p>{LONG}</p><p>{LONG}</p></div><div class='sidebar'><p>{LONG}</p></div><div class=comments><p>{LONG}{LONG}</p></div></div>", f"{LONG.strip()} {LONG.strip()}"),
        (f"<header><p>{LONG}</p></header><main><p>a<b>b</b> c<br>d\n\n e&amp;&lt;&#233;&nbsp;f</p><p>{LONG}</p></main>", f"ab c d e&<é f {LONG.strip()}"),
        (f"<article><p><b>One<br><p>Two<ul><li>x<li>y</ul>{LONG}<form><p>{LONG}</p></form></article>", f"One Two x y {LONG.strip()}"),
        (f"<div role=dialog><p>{LONG}</p></div><div class='cookie-notice'>{LONG}</div><!-- {LONG} --><section><p>{LONG}</p></section><aside>{LONG}</aside>", LONG.strip()),
        ("<article><h1>Tiny</h1><p>Text.</p></article><div class=ad>" + LONG + "</div>", "Tiny Text."),
        ("plain text only", "plain text only"),
    ],
)
def test_pages(body, want):
    assert html.main_text(page(body)) == want


def test_odd_pages():
    assert html.main_text(None) == html.main_text("") == html.main_text("<p>") == ""
    assert html.main_text("<p>a < b</p>") == "a < b"
    assert html.main_text("<div>" * 3000 + "deep") == "deep"
    assert html.main_text("</p></div>text<script>never closed") == "text"
    assert len(html.main_text(page("<article>" + f"<p>{LONG}</p>" * 2000 + "</article>"))) == 2000 * len(LONG) - 1


def test_table_against_its_articles(spark):
    """The pages' articles, cut out by hand: all their text and nothing else."""
    import html as references

    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").withColumn("text", F.lit(1)).select("page_id", "html", html.extract_main_text(F.col("html")).alias("main")).collect()
    assert len(rows) == 250
    for r in rows:
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        want = " ".join(references.unescape(re.sub(r"</?(b|i)>", "", re.sub(r"</?(p|h1|br)>", " ", article))).split())
        assert r.main == want, r.page_id


@pytest.mark.parametrize("name", ["class='content with-sidebar'", "id=page class='no-comments'", "class='related-work'", "class='has-widgets'"])
def test_containers_named_after_their_layout_stay(name):
    assert html.main_text(page(f"<div {name}><p>{LONG}</p><p>{LONG}</p></div><div class=sidebar><p>{LONG}</p></div>")) == f"{LONG.strip()} {LONG.strip()}"


def test_compounds_that_are_noise_go():
    main = f"<div class=content><p>{LONG}</p></div>"
    for name in ("comment-list", "sidebar-left", "cookie-notice"):
        assert html.main_text(page(f"{main}<div class='{name}'><p>Other, text.</p></div>")) == LONG.strip()
    assert html.main_text(page(f"{main}<div class='comment-list'><p>{LONG}</p><p>{LONG}</p></div>")) == LONG.strip()
    assert html.main_text(page(f"<article><p>{LONG}</p></article><div class='related-work'><p>{LONG}</p><p>{LONG}</p></div>")) == LONG.strip()


def test_headers_and_short_siblings_stay():
    assert html.main_text(page(f"<div><div class='post-header'><h1>Head</h1></div><div class=text><p>{LONG}</p><p>{LONG}</p></div></div>")) == f"Head {LONG.strip()} {LONG.strip()}"
    rest = "<p>Why?</p><pre>code</pre><h4>Four</h4><table><tr><td>cell</td></tr></table>"
    for tag, item in (("ul", "li"), ("section", "p")):
        body = f"{rest}<{tag}>" + f"<{item}>{LONG}</{item}>" * 4 + f"</{tag}><p>Yes!</p>"
        for outer in ("div", "main"):
            assert html.main_text(page(f"<{outer}>{body}</{outer}>")) == f"Why? code Four cell {' '.join([LONG.strip()] * 4)} Yes!"


def test_scores_decide_within_articles_too():
    links = "".join(f"<p><a href=x{i}>Another story {i}</a></p>" for i in range(12))
    for tag in ("article", "section", "div"):
        assert html.main_text(page(f"<{tag}><p>{LONG}</p><p>{LONG}</p>{links}</{tag}>")) == f"{LONG.strip()} {LONG.strip()}"
        menu = f"<ul>{''.join(f'<li><a href={i}>item {i}</a></li>' for i in range(5))}</ul>"
        assert html.main_text(page(f"<{tag}>{menu}<p>{LONG}</p><p><a href=y>One link</a></p><p>{LONG}</p></{tag}>")) == f"{LONG.strip()} One link {LONG.strip()}"
    some = f"<p>{LONG} <a href=x>a</a>, <a href=y>b</a> and <a href=z>c</a>.</p>"
    assert html.main_text(page(f"<article>{some}</article>")) == f"{LONG.strip()} a, b and c."


@pytest.mark.parametrize("story", ["".join(f"<p>{'word ' * 18}{i}</p>" for i in range(4)), "".join(f"<p>{'word ' * 57}{i}</p>" for i in range(2))])
def test_a_teaser_is_not_the_article(story):
    got = html.main_text(page(f"<article>teaser, one.</article><div id=story>{story}</div>"))
    assert got == " ".join(re.sub("<[^>]*>", " ", story).split())


@pytest.mark.parametrize("name", ["layout has-sidebar", "post-header-wrap", "page with-footer"])
def test_wrappers_of_the_whole_page_stay(name):
    for inner in ("article", "div"):
        body = f'<div class="{name}"><{inner}><p>{LONG}</p><p>{LONG}</p></{inner}></div>'
        assert html.main_text(page(body)) == f"{LONG.strip()} {LONG.strip()}"


@pytest.mark.parametrize("odd", ["<a ", "<div>", "<", "<b><p>", "</b>", "<li><ul>", "<blockquote>x", "<div class=comment-list>", '<a "', "<noscript>", "<table><tr><td>", "&", "<!-", "<p><a>x</a>", "<div class='a"])
def test_long_broken_pages_take_no_time(odd):
    import time

    began = time.process_time()
    html.main_text(odd * 100_000)
    assert time.process_time() - began < 5


def test_math_is_text():
    assert html.main_text(f"<article><p>{LONG}<math><mi>x</mi><mo>=</mo><mn>1</mn></math></p></article>") == f"{LONG}x=1"


def test_no_article_needed(spark):
    """The same text where the element is called otherwise; repeated rows, empty and null pages, an empty table."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html")
    renamed = F.regexp_replace("html", "(</?)article", "$1div")
    both = pages.select("page_id", html.extract_main_text(F.col("html")).alias("a"), html.extract_main_text(renamed).alias("b")).collect()
    assert len(both) == 250 and all(r.a == r.b and r.a for r in both)
    odd = spark.createDataFrame([(1, None), (1, None), (2, ""), (3, "<p>x, y</p>"), (3, "<p>x, y</p>")], "page_id long, html string")
    got = odd.select("page_id", html.extract_main_text(F.col("html")).alias("text")).collect()
    assert sorted(map(tuple, got)) == [(1, ""), (1, ""), (2, ""), (3, "x, y"), (3, "x, y")]
    assert odd.limit(0).select(html.extract_main_text(F.col("html"))).count() == 0


BODY = "<p>" + "A long paragraph of the article, with some commas, that says what it has to say. " * 4 + "</p>"


@pytest.mark.parametrize("name", ["commentlist", "commentList", "comments-area", "comment-thread", "post-comments", "reader-responses", "readerResponses", "replies", "reply-list", "user-reviews", "adsbygoogle"])
@pytest.mark.parametrize("inside", [True, False])
def test_what_readers_write_is_no_text_of_the_article(name, inside):
    theirs = f'<ol class="{name}"><li><p>I disagree, and here is why, in some words of mine. {"Really, I do. " * 20}</p></li></ol>'
    page = f"<body><article><h1>Head</h1>{BODY}{BODY}{theirs if inside else ''}</article>{'' if inside else theirs}</body>"
    text = html.main_text(page)
    assert "disagree" not in text and text.count("A long paragraph") == 8 and text.startswith("Head")


@pytest.mark.parametrize("name", ["commentary", "no-comments", "has-comments", "commentator-box", "with-reply", "responding"])
def test_names_that_only_look_like_readers(name):
    assert html.main_text(f"<body><div class='{name}'>{BODY}{BODY}</div></body>").count("A long paragraph") == 8


@pytest.mark.parametrize("attribute", ['style="display:none"', "style='color: red; display : none !important'", 'STYLE="visibility: hidden"', "hidden", 'aria-hidden="true"'])
def test_hidden_elements(attribute):
    assert "unseen" not in html.main_text(f"<article>{BODY}<p {attribute}>unseen words</p>{BODY}</article>")


@pytest.mark.parametrize("attribute", ['style="display:block"', 'style="--x: display:none-ish"', 'data-style="display:none"', 'data-hidden="1"', 'style=""'])
def test_elements_that_are_seen(attribute):
    assert "seen words" in html.main_text(f"<article>{BODY}<p {attribute}>seen words</p>{BODY}</article>")


END = "This is how the story ends: with a sentence that stands in a division of its own, some way below the rest of it."


def test_bodies_that_are_split():
    """Divisions beside the best one that read like text stay, such as are made of links or of a few words go."""
    parts = f"<div class=a>{f'<p>{LONG}</p>' * 6}</div><div class=b><p>{END}</p></div>"
    want = " ".join([LONG.strip()] * 6 + [END])
    assert html.main_text(page(parts)) == want
    assert html.main_text(page(f"<div class=x>{parts}</div><div><p>Just a few words.</p></div>")) == want
    links = "".join(f"<a href=/{k}>{END}</a> " for k in range(2))
    assert html.main_text(page(f"{parts}<div class=more><p>{links}</p></div><div class=ad><p>{END}</p></div>")) == want
    assert html.main_text(page(f"{parts}<div class=last><p>{END[:-1]} and no stop, nor any other end</p></div>")) == want


def test_articles_side_by_side():
    """A page's text may be in several articles; a teaser beside it isn't it."""
    one, two = f"<article><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></article>", f"<article><p>{LONG}{END}</p><p>{LONG}</p><p>{LONG}</p></article>"
    both = " ".join([LONG.strip()] * 3 + [f"{LONG}{END}", LONG.strip(), LONG.strip()])
    assert html.main_text(page(f"<div>{one}<p>Between.</p>{two}</div>")) == both
    assert html.main_text(page(f"{one}{two}<article><p>Read more, soon.</p></article><article><p><a href=x>{LONG}{LONG}</a></p></article>")) == both


def test_split_bodies_take_no_time():
    import time

    for odd in (f"<div>{'<blockquote>' * 20000}{END[:-1]}", f"<div><p>{END[:-1]}" + "<table><td><p>x" * 20000, f"<div><p>{END[:-1]}</div>" * 20000):
        began = time.perf_counter()
        html.main_text(page(f"<div>{f'<p>{LONG}</p>' * 6}</div>{odd}"))
        assert time.perf_counter() - began < 10
