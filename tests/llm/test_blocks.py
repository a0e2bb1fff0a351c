"""Which lines of a page are its article, and broken pages in linear time."""

import time

import pytest

from turnloom.llm.blocks import main_text

PAGES = [
    ("<div class='has-sidebar'><article><p>Body text", "Body text"),
    ("<div class='search-results'><article><p>Body text</article></div>", "Body text"),
    ("<body class='x'><div class='page header-fixed'><article><p>Body text", "Body text"),
    ("<div class='post share-buttons-wrap'><p>Body text here</div>", "Body text here"),
    ("<article><p>a</p><figure><figcaption>cap</figcaption></figure><p>b <math><mi>y</mi></math></article>", "a\ncap\nb y"),
    ("<article><fieldset><p>f</p></fieldset><p>x</p><textarea>t &lt;b></textarea></article>", "f\nx\nt <b>"),
    ("<article><p>Real body</p></article><article class='comment'><p>Nice post</p></article>", "Real body"),
    ("<article><p>Real body</p></article><div class='responses'><article><p>me too, much longer</p></article></div>", "Real body"),
    ("<article><p>Real body</p><div class='reader-comments'><p>first</div><p>end</article>", "Real body\nend"),
    ("<div class='sidebar'><article>Side</article></div><article><p>main</p></article>", "main"),
    ("<aside><article>Side</article></aside>", ""),
    ("<article><h1><a href=x>Title</a></h1><p>Some text</p><p><a href=y>One link</a></p><nav>menu</nav><p>end</p></article>", "Title\nSome text\nOne link\nend"),
    ("<article><p>" + "long text " * 50 + "</p></article><article><p>teaser</p></article>", ("long text " * 50).strip()),
    ("<article><p>one article</p></article><article><p>two article</p></article>", "one article\ntwo article"),
    ("<article><p title=\"a > b\">text <c and <p a=\"x</article>", "text"),
    ("<p>a <![CDATA[b < c]]> d</p>", "a b < c d"),
    ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"),
    ("<p>never closed <b", "never closed <b"),
    ("<!-- a --><p>text<!-- never closed", "text"),
    ("<script>var a = '<p>no</p>'</script><p>yes</p><style>no", "yes"),
]


@pytest.mark.parametrize("page,text", PAGES)
def test_main_text(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize(
    "unit",
    ['<p a="', "<div class='x", "<c ", "<", "</div>", "<div>", "<svg>", "<svg/>", "<![CDATA[", "<p \">\" ", "<p '>\" \"", "<head>", "<article>x</article>", "<p>x"],
)
def test_broken_pages_take_time_in_proportion(unit):
    page = "<div>" * 2000 + unit * (300_000 // len(unit))
    started = time.time()
    main_text(page)
    assert time.time() - started < 5
