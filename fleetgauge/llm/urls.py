"""URL filters: rules by host and path, and a weighted vocabulary for the rest.

An Aho-Corasick automaton finds every vocabulary term in a lower-cased url in one pass. A hit
counts where no letter or digit touches it. One distinct strict term rejects, and so do
several distinct soft ones. Where a rule fits, the rule decides: the longest one, and of equal
ones a block.

Edge cases: a null url, or one without `://`, has empty host and path and no rule; a null url
has no hit and is allowed; repeated rows are judged alike; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgauge.llm.common import map_rows

#: Terms that reject by themselves.
STRICT = (
    "adult", "betting", "casino", "escort", "gambling", "hentai", "jackpot", "malware", "nude", "phishing", "poker",
    "porn", "sex", "slots", "spam", "viagra", "warez", "xxx",
)
#: Terms that reject together.
SOFT = (
    "ads", "bet", "bets", "bonus", "cheap", "click", "coupon", "crack", "dating", "deal", "discount", "farm", "free",
    "girls", "hot", "keygen", "loan", "lottery", "odds", "pills", "popup", "promo", "torrent", "track", "tracker", "win",
)
#: Distinct soft terms that reject.
SOFT_LIMIT = 2

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_PARTS = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_ALNUM = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")

SCHEMA = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("host", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("rule", T.StringType()),
        T.StructField("verdict", T.StringType()),
        T.StructField("strict_hits", T.LongType()),
        T.StructField("soft_hits", T.LongType()),
    ]
)


def split_url(url: str | None) -> tuple[str, str]:
    """Host, A-Z lower-cased, and path."""
    found = _PARTS.search(url or "")
    return (found[1].translate(ASCII_LOWER), found[2]) if found else ("", "")


@lru_cache(maxsize=4)
def automaton(strict: tuple[str, ...], soft: tuple[str, ...]):
    """The automaton of a vocabulary; one per worker."""
    made = ahocorasick.Automaton()
    for term in {*strict, *soft}:
        made.add_word(term, (term, term in strict))
    made.make_automaton()
    return made


def hits(url: str | None, strict: tuple[str, ...], soft: tuple[str, ...]) -> tuple[int, int]:
    """Distinct strict and soft terms that stand alone in a url."""
    text = (url or "").translate(ASCII_LOWER)
    found: set[tuple[str, bool]] = set()
    if not strict and not soft:
        return 0, 0
    for last, (term, is_strict) in automaton(strict, soft).iter(text):
        first = last - len(term) + 1
        if (first == 0 or text[first - 1] not in _ALNUM) and (last + 1 == len(text) or text[last + 1] not in _ALNUM):
            found.add((term, is_strict))
    n_strict = sum(s for _, s in found)
    return n_strict, len(found) - n_strict


def by_host(rules: Iterable[tuple[str, str, str]]) -> dict[str, list[tuple[str, str]]]:
    """Rules (action, host, path) as host -> [(path, action)], the longest path first."""
    table: dict[str, dict[str, str]] = {}
    for action, host, path in rules:
        if action not in ("allow", "block"):
            raise ValueError(f"a rule allows or blocks, not: {action}")
        paths = table.setdefault(host, {})
        paths[path] = "block" if "block" in (action, paths.get(path)) else "allow"
    return {h: sorted(p.items(), key=lambda x: (-len(x[0]), x[0])) for h, p in table.items()}


def fitting(host: str, path: str, table: dict[str, list[tuple[str, str]]]) -> tuple[str, str] | None:
    """The longest rule for a host, its parent domains included, and its action."""
    best, labels = None, host.split(".")
    for i in range(len(labels)):
        domain = ".".join(labels[i:])
        for prefix, action in table.get(domain, ()):
            if path.startswith(prefix):
                key = (len(domain) + len(prefix), action == "block")
                if best is None or key > best[0]:
                    best = (key, domain + prefix, action)
                break
    return best and best[1:]


def judge(
    pages: DataFrame, rules: Iterable[tuple[str, str, str]] = (), strict: tuple[str, ...] = STRICT,
    soft: tuple[str, ...] = SOFT, soft_limit: int = SOFT_LIMIT, id_col: str = "page_id", url_col: str = "url",
) -> DataFrame:
    """Host, path, rule, verdict and hits of every url."""
    table = by_host(rules)

    def one(page_id, url):
        host, path = split_url(url)
        n_strict, n_soft = hits(url, strict, soft)
        rule = fitting(host, path, table)
        verdict = rule[1] if rule else "block" if n_strict or n_soft >= soft_limit else "allow"
        return page_id, host, path, rule and rule[0], verdict, n_strict, n_soft

    return map_rows(pages.select(F.col(id_col).cast("long"), F.col(url_col)), one, SCHEMA)
