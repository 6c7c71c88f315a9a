"""Main text of pages whose names, tags or lengths mislead."""

import random

import pytest

from retention.llm import html_extract

LONG = "The harvest came late that year and the whole village worked until dark to bring it in before the rain."
MORE = "Nobody had seen so much grain in the barns since the old mill closed its doors many winters before."
NAV = "<nav><ul><li><a href='/'>Home</a></li><li><a href='/x'>News</a></li></ul></nav>"
FOOT = "<footer><p>All rights reserved by the publisher of this page and its partners</p></footer>"
WHOLE = f"{LONG} {MORE}"
BODY = f"<p>{LONG}</p><p>{MORE}</p>"


@pytest.mark.parametrize("page", [
    f"<body>{NAV}<div class='layout has-sidebar'><article>{BODY}</article></div>{FOOT}</body>",
    f"<body>{NAV}<div class='post with-comments'>{BODY}</div>{FOOT}</body>",
    f"<body>{NAV}<div id='related-wrapper'><main>{BODY}</main></div>{FOOT}</body>",
    f"<body>{NAV}<div id='comments-wrapper'>{BODY}</div>{FOOT}</body>",
    f"<body><div aria-label='Article about social change'>{BODY}</div></body>",
    f"<body><div class='sidebar-layout'><article>{BODY}</article><aside><p>{MORE}</p></aside></div></body>",
    f"<body>{NAV}<article>{BODY}</article><article class='comment'><p>{LONG}</p></article></body>",
    f"<body><article>{BODY}</article><section class='comments'><article class='comment'><p>{MORE}</p></article></section></body>",
    f"<body><article>{BODY}</article><div class='related'><article><p>{LONG}</p></article></div></body>",
    f"<body><article>{BODY}</article><div role='search' aria-label='Site search'><p>{LONG}</p></div></body>",
    f"<body><input list=x><datalist id=x><option>A<option>B</datalist>{BODY}</body>",
    f"<body><button>Press{BODY}</body>",
    f"<body><article><p>{LONG}</p><button>Press<p>{MORE}</p></article><button>Send</button></body>",
    f"<body><iframe src='x'>{BODY}</body>",
    f"<body><noscript><div>{MORE}</div></noscript>{BODY}</body>",
    f"<body><select><option>A</option><option>B</option></select>{BODY}<script>var a = '<p>{MORE}</p>'</script></body>",
    f"<body>{NAV}{BODY}<div class='cookie-notice'><p>{LONG}</p></div></body>",
    f"<body>{BODY}<script>unclosed <p>{MORE}</p>",
])
def test_whole_article(page):
    assert html_extract.extract_text(page) == WHOLE


@pytest.mark.parametrize("page,text", [
    ("<body><p>Hello world</p></body>", "Hello world"),
    ("<p>One</p>", "One"),
    (f"<body>{NAV}<h1>Late harvest</h1>{BODY}</body>", f"Late harvest {WHOLE}"),
    (f"<body><h1>Late harvest</h1>{BODY}</body>", f"Late harvest {WHOLE}"),
    (f"<body>{BODY}<h3>More stories</h3><ul><li><a href=a>First one</a></li><li><a href=b>Second one</a></li></ul></body>", WHOLE),
    (f"<body><div class='cookie-notice'><p>{LONG}</p></div></body>", ""),
    (f"<body>{NAV}{FOOT}</body>", ""),
    ("", ""), (None, ""), ("<div class='x", ""), ("<!-- only", ""),
    ("<p>a &amp; b&nbsp;&#65;</p>", "a & b A"),
])
def test_text(page, text):
    assert html_extract.extract_text(page) == text


def test_neighbours_decide():
    """The tree was grown on, and uses, the neighbours on both sides."""
    used = set()

    def walk(node):
        if isinstance(node, tuple):
            used.add(html_extract.FEATURES[node[0]])
            walk(node[2])
            walk(node[3])

    walk(html_extract.TREE)
    assert {"words", "links", "prev_words", "next_words"} <= used and used & {"prev_links", "next_links"}


def test_generated_pages_without_article(spark):
    """The main text of pages made of paragraphs, menus and notices, in any order of parts."""
    rnd = random.Random(3)
    words = lambda n: " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9))) for _ in range(n))
    rows = []
    for k in range(60):
        paragraphs = [words(rnd.randint(15, 60)) for _ in range(rnd.randint(2, 6))]
        title = words(rnd.randint(2, 5))
        menu = "".join(f"<li><a href='/{j}'>{words(1)}</a></li>" for j in range(rnd.randint(3, 7)))
        page = (f"<html><head><title>{words(3)}</title></head><body><div class='{rnd.choice(['menu', 'site-nav', 'top'])}'><ul>{menu}</ul></div>"
                f"<h1>{title}</h1>" + "".join(f"<p>{p}</p>" for p in paragraphs) + f"<div class='{rnd.choice(['comments', 'newsletter', 'share'])}'><p>{words(20)}</p></div></body></html>")
        rows.append((k, page, "old", " ".join([title, *paragraphs])))
    pages = spark.createDataFrame(rows, "page_id long, html string, text string, words string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()}
    assert got == {r[0]: r[3] for r in rows}
    assert html_extract.extract(pages).columns == ["page_id", "html", "words", "text"]
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_very_long_page():
    page = f"<body>{NAV}" + BODY * 20000 + "</body>"
    assert html_extract.extract_text(page) == " ".join([WHOLE] * 20000)


@pytest.mark.parametrize("tag", ["option", "iframe", "button", "noscript"])
def test_many_unclosed_elements(tag):
    page = "<body>" + f"<{tag}>x<div>" * 30000 + BODY
    assert html_extract.extract_text(page).endswith(WHOLE)
