"""Pages whose main text must not get lost."""

import pytest

from forumlake.llm import html


@pytest.mark.parametrize("page, want", [
    ('<p>a</p><svg class="i"/><p>main text</p>', ["a", "main text"]),
    ("<p>a</p><button>x<p>main</p>", ["a", "x", "main"]),
    ('<div><object data="x"></div><p>main', ["main"]),
    ("<title-block>main</title-block>", ["main"]),
    ("<title>a<p>main", ["a", "main"]),
    ('<p>one <svg><path d="M"/><title>no</title></svg>line</p>', ["one line"]),
    ("<select><option>a<option>b</select>main<noscript><p>n</p></noscript>", ["main"]),
    ('<script>var t="</p>";</script>main<script>x', ["main"]),
])
def test_hidden_elements_end_where_they_end(page, want):
    assert [n.text() for n in html.parse(page) if n.tag == "text"] == want


ARTICLE = "<h1>A title of this text</h1><p>First paragraph of the text, long enough.</p><p>Second paragraph, with more words in it.</p>"
KEPT = "A title of this text\nFirst paragraph of the text, long enough.\nSecond paragraph, with more words in it."
AROUND = ('<nav><ul><li><a href=/x>Home page of all</a></li></ul></nav><div class="ad">Buy this now, please, all of you.</div>',
          '<div id=comments><p>I liked it, and you would too.</p></div><footer>&copy; of the owner of this</footer>')


def page(before, after, body="<body>"):
    return f"<html>{body}{AROUND[0]}{before}{ARTICLE}{after}{AROUND[1]}</body></html>"


def test_tokens_do_not_overrule_the_trees(spark):
    """Wrappers of the whole article may carry a token of the list as a part of their name."""
    known = spark.createDataFrame([(i, page("<article>", "</article>") if i % 2 else page("<div>", "</div>"), KEPT)
                                   for i in range(40)], "page_id long, html string, article string")
    model = html.train(known, "html", "article", known.page_id)
    pages = [
        page("<article>", "</article>"),
        page("<article>", "</article>", '<body class="single has-sidebar">'),
        page('<article class="post comments-open">', "</article>"),
        page('<div id="content-sidebar-wrap"><article>', "</article></div>"),
        page("<article>", "</article>", "<body><form id=f>").replace("</body>", "</form></body>"),
        page('<div class="widget-wrap">', "</div>"),
    ]
    assert html.main_texts(pages, model) == [KEPT] * len(pages)
