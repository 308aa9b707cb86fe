"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into blocks, the text between block-level tags. A linear classifier gives each
block a log-odds of being content from its tags, names, link share and prose; its positive and
negative parts are the block's capacities to source and sink. Smoothness edges join blocks
that follow each other and blocks whose DOM paths are close, so that an odd block among content
stays content. The minimum cut, by maximum flow over that graph, labels all blocks at once.

Names count by whole class, id and role tokens: what a token calls its element ("cookie-notice" a notice,
"comment-list" a comment), not what it says of its state ("no-sidebar", "nav-open"). What enclosing elements
say together is bounded, and bad names do not count on elements that hold the page's article.

Edge cases: a null or empty page has empty text; broken or cut-off markup is read as far as it
goes; character references are decoded after the markup is cut, also unknown ones (as written);
white space inside a block is one blank; repeated pages give equal rows; pages of any size are
read whole; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgauge.llm.common import map_rows

#: Elements that end the line they stand in.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select "
    "summary table tbody td tfoot th thead tr ul".split()
)
#: Elements without content, and elements whose content is no text of the page.
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN_TAGS = frozenset("script style noscript template head title iframe object svg math select textarea button".split())
#: Log-odds of an ancestor by tag, and by a word of its class, id or role.
TAG_ODDS = {
    "article": 3.0, "main": 2.5, "p": 0.8, "blockquote": 0.5, "pre": 0.5, "h1": 0.5,
    "nav": -6.0, "footer": -6.0, "aside": -6.0, "form": -6.0, "header": -3.0, "menu": -5.0, "dialog": -5.0,
}
NAME_ODDS = {
    "article": 1.5, "content": 1.0, "story": 1.0, "post": 0.5, "entry": 0.5, "main": 1.0,
    "ad": -6.0, "ads": -6.0, "advert": -6.0, "advertisement": -6.0, "sponsor": -6.0, "sponsored": -6.0, "promo": -5.0,
    "nav": -6.0, "navbar": -6.0, "menu": -6.0, "breadcrumb": -5.0, "breadcrumbs": -5.0, "header": -3.0, "masthead": -5.0,
    "footer": -6.0, "sidebar": -6.0, "aside": -5.0, "cookie": -6.0, "cookies": -6.0, "consent": -6.0, "notice": -6.0,
    "banner": -5.0, "popup": -6.0, "modal": -6.0, "newsletter": -6.0, "subscribe": -6.0, "comment": -6.0,
    "comments": -6.0, "disqus": -6.0, "reply": -5.0, "share": -5.0, "social": -5.0, "related": -5.0,
    "recommended": -5.0, "widget": -5.0, "form": -5.0, "login": -5.0, "search": -5.0, "copyright": -5.0,
    "navigation": -6.0, "contentinfo": -6.0, "complementary": -6.0, "alert": -5.0, "disclaimer": -5.0,
}
#: Parts of a name that tell a state, not what an element is; a token with one of them says nothing.
STATE_WORDS = frozenset(
    "no not non has with without is js enabled disabled open opened closed fixed sticky active inactive hidden visible shown "
    "single full left right page home layout theme scroll loaded ready below above after before under".split()
)
#: Last parts of a name that only say "a piece of".
PIECE_WORDS = frozenset(
    "list item items box bar block blocks area section wrapper wrap container inner outer group row col column content contents "
    "body text links link buttons button icons panel region zone slot unit holder bottom top main".split()
)
#: Names that keep an `article` element from being the page's article.
SIDE_NAMES = frozenset("ad ads advert sponsor sponsored promo comment comments reply related recommended widget".split())
#: Bounds of the log-odds that all enclosing elements give a block together.
LEAST_ODDS, MOST_ODDS = -6.0, 4.0
#: Share of the page's text from which an element is the page itself, where no article is marked.
WHOLE = 0.9
#: Log-odds of a block's own text: bias, its words up to 30, each sentence mark up to 3, its link share.
BIAS, PER_WORD, PER_MARK, LINKED = -0.5, 0.05, 0.3, -4.0
#: Smoothness: neighbours in the page, and blocks whose DOM paths part at depth d from the leaf.
ADJACENT, PROXIMITY = 0.8, 1.0
#: Enclosing elements, from the innermost, that bind blocks.
DEPTH = 4
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.S)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
NAME_WORD = re.compile(r"[a-z]+")
TOKEN = re.compile(r"\S+")
END_OF = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in ("script", "style", "noscript", "template", "iframe", "title", "textarea", "svg", "math")}

SCHEMA = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


def heads(attributes: str) -> set[str]:
    """What the class, id and role tokens of an element call it: the last telling part of each."""
    found = set()
    for groups in NAMES.findall(attributes):
        for token in TOKEN.findall("".join(groups)):
            parts = NAME_WORD.findall(token.lower())
            if not parts or STATE_WORDS.intersection(parts):
                continue
            while len(parts) > 1 and parts[-1] in PIECE_WORDS:
                parts.pop()
            found.add(parts[-1])
    return found


class Elements:
    """The elements of a page: their parents, own log-odds and text, each after its parent."""

    def __init__(self) -> None:
        self.parent: list[int] = [-1]
        self.tag: list[str] = [""]
        self.good: list[float] = [0.0]
        self.bad: list[float] = [0.0]
        self.side: list[bool] = [False]
        self.chars: list[int] = [0]

    def add(self, tag: str, parent: int, attributes: str) -> int:
        odds = [TAG_ODDS.get(tag, 0.0)]
        names: set[str] = set()
        if "=" in attributes:
            names = heads(attributes)
            odds += [NAME_ODDS.get(n, 0.0) for n in names]
        self.parent.append(parent)
        self.tag.append(tag)
        self.good.append(max(0.0, *odds))
        # Names say nothing bad about the page as a whole; tags do, wherever they stand.
        self.bad.append(min(0.0, *odds))
        self.side.append(bool(names & SIDE_NAMES))
        self.chars.append(0)
        return len(self.parent) - 1

    def odds(self) -> list[float]:
        """Log-odds that all elements from the page down to each give together.

        Bad names do not count on elements that hold the page's article (the largest `article` or
        `main` outside of menus and comments), on html and body, or, where none is marked, on what holds
        nearly all text.
        """
        n = len(self.parent)
        chars = list(self.chars)
        for e in range(n - 1, 0, -1):
            chars[self.parent[e]] += chars[e]
        # Whether an element lies in a menu, footer, comment or the like by tag or as a side article.
        aside = [False] * n
        for e in range(1, n):
            aside[e] = aside[self.parent[e]] or TAG_ODDS.get(self.tag[e], 0.0) < -3 or self.side[e] and self.tag[e] in ("article", "main")
        found = [e for e in range(1, n) if self.tag[e] in ("article", "main") and not aside[e] and chars[e]]
        spared = {e for e in range(1, n) if self.tag[e] in ("html", "body")}
        if found:
            e = max(found, key=lambda x: chars[x])
            while e > 0:
                spared.add(e)
                e = self.parent[e]
        else:
            spared.update(e for e in range(1, n) if chars[e] >= WHOLE * chars[0])
        total = [0.0] * n
        for e in range(1, n):
            bad = min(0.0, TAG_ODDS.get(self.tag[e], 0.0)) if e in spared else self.bad[e]
            total[e] = max(LEAST_ODDS, min(MOST_ODDS, total[self.parent[e]] + self.good[e] + bad))
        return total


def blocks(page: str | None) -> list[tuple[str, float, float, tuple[int, ...]]]:
    """(text, log-odds of the ancestors, share of linked text, the innermost elements' numbers) of each block."""
    page = page or ""
    found: list[tuple[str, int, float, tuple[int, ...]]] = []
    elements = Elements()
    open_: list[tuple[str, int]] = []  # tag, number
    hidden, links = 0, 0
    text: list[str] = []
    linked: list[str] = []

    def inner_path() -> tuple[int, ...]:
        path: list[int] = []
        for tag, n in reversed(open_):
            if tag in BLOCK_TAGS:
                path.append(n)
                if len(path) == DEPTH:
                    break
        return tuple(path)

    def flush() -> None:
        joined = " ".join(html.unescape("".join(text)).split())
        if joined:
            of_links = len(" ".join(html.unescape("".join(linked)).split()))
            at = open_[-1][1] if open_ else 0
            elements.chars[at] += len(joined)
            found.append((joined, at, min(1.0, of_links / len(joined)), inner_path()))
        text.clear()
        linked.clear()

    at, end = 0, len(page)
    while at < end:
        m = MARKUP.search(page, at)
        raw = page[at : m.start()] if m else page[at:]
        if raw and not hidden:
            text.append(raw)
            if links:
                linked.append(raw)
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag in BLOCK_TAGS and not hidden:
            flush()
        if tag == "br" and not hidden:
            text.append(" ")
        if m[1]:
            for i in range(len(open_) - 1, -1, -1):
                if open_[i][0] == tag:
                    for gone, _ in open_[i:]:
                        hidden -= gone in HIDDEN_TAGS
                        links -= gone == "a"
                    del open_[i:]
                    break
                # A closing tag does not reach out of the block element it stands in.
                if open_[i][0] in BLOCK_TAGS and tag not in BLOCK_TAGS:
                    break
            continue
        if tag in VOID_TAGS or m[3].endswith("/"):
            continue
        if tag in ("p", "li", "tr", "td", "th", "dt", "dd", "option") and open_ and open_[-1][0] == tag:
            open_.pop()
        elif tag in BLOCK_TAGS:  # inline elements, and a paragraph, end where a block begins
            while open_ and (open_[-1][0] == "p" or open_[-1][0] not in BLOCK_TAGS | HIDDEN_TAGS):
                links -= open_.pop()[0] == "a"
            if open_ and open_[-1][0] == "head":
                hidden -= 1
                open_.pop()
        if tag in END_OF:
            stop = END_OF[tag].search(page, at)
            at = stop.end() if stop else end
            continue
        open_.append((tag, elements.add(tag, open_[-1][1] if open_ else 0, m[3])))
        hidden += tag in HIDDEN_TAGS
        links += tag == "a"
    flush()
    odds = elements.odds()
    return [(t, odds[e], share, path) for t, e, share, path in found]


def score(text: str, odds: float, linked: float) -> float:
    """Log-odds of a block being content."""
    marks = sum(map(text.count, ".!?,;"))
    return odds + BIAS + PER_WORD * min(30, text.count(" ") + 1) + PER_MARK * min(3, marks) + LINKED * linked


def min_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node lies on the source side of a minimum cut (Dinic's maximum flow).

    A node's positive log-odds is its capacity from the source, a negative one its capacity to
    the sink; an edge has its capacity both ways.
    """
    n = len(odds)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def add(a: int, b: int, there: float, back: float) -> None:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((there, back))

    for i, o in enumerate(odds):
        if o > 0:
            add(source, i, o, 0.0)
        elif o < 0:
            add(i, sink, -o, 0.0)
    for a, b, c in edges:
        add(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        tried = [0] * (n + 2)
        path: list[int] = []
        at = source
        while True:
            if at == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                first = next(i for i, e in enumerate(path) if room[e] <= 1e-9)
                at = to[path[first] ^ 1]
                del path[first:]
            while tried[at] < len(out[at]):
                e = out[at][tried[at]]
                if room[e] > 1e-9 and level[to[e]] == level[at] + 1:
                    break
                tried[at] += 1
            else:
                if at == source:
                    break
                level[at] = -1
                at = to[path.pop() ^ 1]
                continue
            path.append(e)
            at = to[e]


def smoothness(paths: list[tuple[int, ...]]) -> list[tuple[int, int, float]]:
    """Edges of neighbours, and of each block with the last one before it in the same element.

    A close common ancestor binds more: an edge halves with every step up the tree.
    """
    edges = [(i, i + 1, ADJACENT) for i in range(len(paths) - 1)]
    last: dict[int, int] = {}
    for i, path in enumerate(paths):
        for up, element in enumerate(path):
            if element in last and up:
                edges.append((last[element], i, PROXIMITY / 2 ** (up - 1)))
            last[element] = i
    return edges


def main_text(page: str | None) -> str:
    """The content blocks of a page, one a line."""
    found = blocks(page)
    odds = [score(t, o, l) for t, o, l, _ in found]
    if not any(o > 0 for o in odds):
        return ""
    kept = min_cut(odds, smoothness([p for *_, p in found]))
    return "\n".join(t for (t, *_), k in zip(found, kept) if k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    def one(page_id, url, page):
        text = main_text(page)
        return page_id, url, text, len(text)

    return map_rows(pages.select(F.col(id_col).cast("long"), F.col(url_col), F.col(html_col)), one, SCHEMA)
