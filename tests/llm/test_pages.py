"""Names of ordinary pages keep their article; side matter goes; the cut decides blocks by their neighbours."""

import duckdb
import pytest

from fleetgauge.llm import html_text

LINE = "The river rose quickly last night, and many people left their homes."
BODY = "".join(f"<p>{LINE}</p>" for _ in range(5))
WANT = "\n".join([LINE] * 5)


@pytest.mark.parametrize("page", [
    '<body class="single no-sidebar"><article>{}</article></body>', '<div class="has-sidebar"><article>{}</article></div>',
    '<html class="no-js header-fixed nav-open"><body><article>{}</article></body></html>',
    '<article class="post related-enabled share-buttons">{}</article>', '<body class="menu search footer"><main>{}</main></body>',
    '<div class="modal sidebar"><div id="menu"><article>{}</article></div></div>', '<div class="sidebar-layout">{}</div>', '<div class="popup">{}</div>',
])
def test_names_of_wrappers_lose_no_article(page):
    assert html_text.main_text(page.format(BODY)) == WANT


@pytest.mark.parametrize("side", [
    '<div class="cookie-notice">{}</div>', '<ol class="comment-list"><li class="comment"><article class="comment-body">{}</article></li></ol>',
    '<div id="sidebar-left-2" class="sidebar">{}</div>', '<div class="ad">{}</div>', '<nav class="content">{}</nav>', '<div class="main-nav">{}</div>',
    '<section class="related-links">{}</section>', '<footer><article>{}</article></footer>', '<div role="contentinfo">{}</div>',
])
def test_side_matter_goes(side):
    other = side.format("<p>Nice words, by a reader, of no matter here. And some more of them, too.</p>" * 3)
    for page in (f"<article>{BODY}</article>{other}", f"{other}<div class=story>{BODY}</div>", f"<div class=page><div>{BODY}</div>{other}</div>"):
        assert html_text.main_text(page) == WANT, page


def test_the_cut_decides_short_blocks_by_their_neighbours():
    """Short list items score against content each; between paragraphs they stay, in a list of their own they go."""
    items = "<ul><li>Eggs</li><li>Milk</li></ul>"
    found = html_text.blocks(f"<div><p>{LINE}</p>{items}<p>{LINE}</p></div>")
    signs = [html_text.score(t, o, l) > 0 for t, o, l, _ in found]
    assert signs == [True, False, False, True]
    assert html_text.main_text(f"<div><p>{LINE}</p>{items}<p>{LINE}</p></div>") == f"{LINE}\nEggs\nMilk\n{LINE}"
    assert "Eggs" not in html_text.main_text(f"<div><p>{LINE}</p></div><div><div>{'<ul>' + '<li>Eggs</li>' * 9 + '</ul>'}</div></div>")


def test_given_pages_keep_their_articles_whole():
    import re

    for (page,) in duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall():
        article = re.search("<article>(.*?)</article>", page, re.S)
        assert html_text.main_text(page) == html_text.main_text(article[0])
        assert len(html_text.main_text(page).split()) >= 0.98 * len(re.sub("<[^>]+>", " ", article[1]).split())


def test_deep_pages_take_linear_time():
    page = "<div class=x>" * 20_000 + f"<p>{LINE}</p>" * 2000
    assert len(html_text.blocks(page)) == 2000
