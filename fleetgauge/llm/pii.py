"""Personal data: patterns, and boosted trees over the candidates of high-recall generators.

Patterns with a check of their own (email, ip, card, phone) are always found. Generators then
propose spans that overlap freely: numbers in groups, account numbers, masked addresses,
dates, street addresses, capitalised names and user names. Each candidate is described by its
format and by the words around it, boosted trees score it, a logistic calibration turns scores
into probabilities, and the threshold is the lowest one that keeps the wanted precision. Rows
for calibration and threshold are held out by description: no row of them has a twin among
the rows the trees are fitted on. Accepted candidates that overlap no pattern span become spans
of kind `likely`.

The trees learn from candidates of the corpus whose label is certain (a pattern span with a
right check is personal, one with a wrong checksum or range is not), all of them,
and from a rule-made list of typical contexts; checks themselves are no features.

Edge cases: a null text is empty; a corpus without labelled candidates leaves the rule-made
list; texts of any length are read whole; equal rows get equal rows; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgauge.llm.common import cut, fit_logistic, map_rows

#: Kinds in the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone", "likely")
#: Distinct labelled descriptions that are fitted on the driver; tasks add up the sums over more.
GATHERED = 20_000
#: Share of accepted candidates that must be right on unseen rows.
PRECISION = 0.95
TREES, DEPTH, RATE, BINS = 40, 3, 0.2, 32
#: Whole units of a slope in sums, and steps of a score.
UNITS, STEPS = 1 << 24, 1024

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Runs of digits are taken whole, so nothing is tried twice.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

IBAN = re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
MONTH = "(?:jan|feb|fév|mar|mär|apr|avr|abr|ma[yi]|jun|juin|jul|juil|aug|ago|aoû|sep|oct|okt|nov|dec|déc|dez|dic|ene)[^\\W\\d_]*+"
TITLE = "(?:Mr|Mrs|Ms|Miss|Dr|Herr|Frau|Mme|Monsieur|Madame|Señor|Señora)"
#: What begins with a digit or a capital tests the letter before it second, so that the search can skip to such letters.
GENERATORS = (
    re.compile(r"(?<![\w.+-])\(?[0-9](?:[ ().-]*+[0-9])+(?!\w)"),
    re.compile(r"(?<![\w.+-])\(?[0-9](?:(?:\) ?|[ .-])?[0-9])+(?!\w)"),
    re.compile(r"(?<![\w.+-])[0-9]{6,}+(?!\w)"),
    re.compile(r"(?<![\w.+(-])\(?[0-9]{2,4}[ ).-]{1,2}[0-9]{2,4}[ .-][0-9]{3,4}(?:[ .-][0-9]{2,4})?(?!\w)"),
    IBAN,
    re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[(\[{] ?at ?[)\]}] ?[A-Za-z0-9-]+(?: ?(?:[(\[{] ?dot ?[)\]}]|\.) ?[A-Za-z0-9-]+)+", re.I),
    # dates
    re.compile(r"[0-9](?<![\w./-][0-9])[0-9]{0,3}([./-])[0-9]{1,2}\1[0-9]{1,4}(?!\w)"),
    re.compile(rf"[0-9](?<![\w./-][0-9])[0-9]?(?:st|nd|rd|th|er|\.)? (?:de )?{MONTH}\.?,? (?:de )?[0-9]{{4}}(?!\w)", re.I),
    re.compile(rf"[JFMASOND](?<!\w.)[a-z]{2,}+ [0-9]{{1,2}}(?:st|nd|rd|th)?, [0-9]{{4}}(?!\w)"),
    # streets and house numbers
    re.compile(r"[0-9](?<![\w.,][0-9])[0-9]{0,4}[a-z]?,? (?:[A-Z][\w'.-]*+ ){1,4}(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Boulevard|Blvd|Way|Court|Ct|Place|Square|Terrace)(?!\w)"),
    re.compile(r"[0-9](?<![\w.,][0-9])[0-9]{0,4}[a-z]?,? (?:rue|avenue|boulevard|place|chemin|allée) (?:(?:de|du|des|la|le) |l'|d')*[A-ZÀ-Þ][\w'-]*+(?: [A-ZÀ-Þ][\w'-]*+)*"),
    re.compile(r"[A-ZÄÖÜ](?<![\w-].)[\w-]*+(?:(?<=straße)|(?<=strasse)|(?<=weg)|(?<=platz)|(?<=allee)|(?<=gasse)) [0-9]{1,4}[a-z]?(?!\w)"),
    re.compile(r"(?:Calle|Avenida|Plaza|Paseo) (?:(?:de|del|la|los|las) )*[A-ZÁÉÍÓÚÑ]\w*+(?: [A-ZÁÉÍÓÚÑ]\w*+){0,5},? [0-9]{1,4}(?!\w)"),
    # names, and names users go by
    re.compile(r"[A-ZÀ-Þ](?<!\w.)[a-zß-ÿ]++(?: (?:(?:de|von|van|la) )?[A-ZÀ-Þ](?:\.|[a-zß-ÿ'-]++)(?!\w))++"),
    re.compile(rf"{TITLE}(?!\w)\.?(?: [A-ZÀ-Þ][\w'-]++)++"),
    re.compile(r"@(?<![\w.%+-]@)[A-Za-z0-9_]{3,}+"),
)
#: Shortest span that is proposed.
LEAST_SPAN = 6
#: Words around a candidate, as features; the last two groups speak against it.
CONTEXT = (
    frozenset("phone tel telephone call mobile cell fax text sms whatsapp telefon tél teléfono".split()),
    frozenset("ssn social security passport licence license iban account tax id national insurance konto compte cuenta".split()),
    frozenset("mail email contact write reach address".split()),
    frozenset("card visa mastercard amex credit debit payment".split()),
    frozenset("order invoice ticket version isbn issn doi model part serial item ref reference build release chapter page".split()),
    frozenset("usd eur total price kg km cm mm miles percent years year population votes rows bytes score points".split()),
    frozenset("born birth birthday dob geboren geburtsdatum né née naissance nacido nacida nacimiento".split()),
    frozenset("lives live living home residence resident ship deliver wohnt wohne adresse habite demeurant vive domicilio dirección".split()),
    frozenset("user username handle follow twitter instagram login nick dm message".split()),
    frozenset("published released updated posted since deadline meeting concert museum shop store hotel office city river statue css annotation decorator import".split()),
)
#: Words right before a name that tell it is a person's.
INTRODUCED = re.compile(r"(?:(?<!\w)(?:name(?: is)?|named|i am|i'm|mr|mrs|ms|miss|dr|herr|frau|mme|monsieur|madame|señora?|heiße|m'appelle|me llamo|signed|regards|sincerely|contact))[.:,]? ?$", re.I)
MONTHS = re.compile(rf"(?<!\w){MONTH}", re.I)
STREETS = re.compile(r"(?<!\w)(?:street|st|road|rd|avenue|ave|lane|ln|drive|boulevard|blvd|way|court|ct|place|square|terrace|rue|chemin|allée|calle|avenida|plaza|paseo)(?!\w)|(?:straße|strasse|weg|platz|allee|gasse) [0-9]", re.I)
TITLED = re.compile(rf"{TITLE}(?!\w)")
WORDS = re.compile(r"[^\W\d_]+")
BEFORE, AFTER = 48, 24


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban(text: str) -> bool:
    bare = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """Each address starts where the characters before its @ allow, the previous one's end at the earliest."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            found.append((start, m.end()))
            free = m.end()
        at = text.find("@", free if m else at + 1)
    return found


def patterns(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """Spans (start, kind number, end) that pass their check, and spans that fail it."""
    good, bad = [(s, 0, e) for s, e in emails(text)], []
    for m in IP.finditer(text):
        if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) < 4 for p in m[0].split(".")):
            good.append((m.start(), 1, m.end()))
        else:
            bad.append(m.span())
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19:
            if luhn(digits):
                good.append((m.start(), 2, m.end()))
            else:
                bad.append(m.span())
    for m in PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m[0])) <= 15:
            good.append((m.start(), 3, m.end()))
        else:
            bad.append(m.span())
    return sorted(good), bad


def describe(text: str, start: int, end: int) -> list[float]:
    """Format and context of a candidate."""
    span = text[start:end]
    groups = re.findall(r"[0-9]+", span)
    before = set(WORDS.findall(text[max(0, start - BEFORE) : start].lower()))
    after = set(WORDS.findall(text[end : end + AFTER].lower()))
    left, right = text[start - 1 : start], text[end : end + 1]
    words = WORDS.findall(span)
    year = any(len(g) == 4 and "1900" <= g <= "2029" for g in groups)
    return [
        float(min(len(span), 200)), float(min(sum(map(len, groups)), 100)), float(min(len(groups), 20)),
        float(min(max(map(len, groups), default=0), 50)), float(len(groups[0]) if groups else 0),
        float(len(groups[-1]) if groups else 0), float("(" in span), float(span.count("-")), float(span.count(".")),
        float(span.count(" ")), float(sum(c.isalpha() for c in span)), float(" at " in span.lower() or "at]" in span.lower() or "at)" in span.lower()),
        float(left.isalnum()), float(left in "$€£#"if left else 0), float(left == ":"), float(right.isalnum()), float(right == "%"),
        float(text[max(0, start - 2) : start].rstrip()[-1:] == ":"),
        float(span.count("/")), float(year), float(span[0] == "@"), float(min(sum(w[0].isupper() for w in words), 10)),
        float(bool(words and groups and MONTHS.search(span))), float(bool(words and groups and STREETS.search(span))),
        float(bool(words and (INTRODUCED.search(text, max(0, start - 16), start) or TITLED.match(span)))),
        *(float(not group.isdisjoint(before)) + 0.5 * (not group.isdisjoint(after)) for group in CONTEXT),
    ]


def candidates(text: str, good: list, bad: list) -> list[tuple[int, int, int, list[float]]]:
    """(start, end, label or -1, features); overlapping spans are all proposed."""
    spans = {m.span() for g in GENERATORS for m in g.finditer(text) if m.end() - m.start() >= LEAST_SPAN}
    checked, failed = {(s, e) for s, _, e in good}, set(bad)
    out = []
    for s, e in sorted(spans | checked | failed):
        if (s, e) in checked:
            label = 1
        elif (s, e) in failed:
            label = 0
        elif IBAN.fullmatch(text, s, e):
            label = int(iban(text[s:e]))
        else:
            label = -1
        out.append((s, e, label, describe(text, s, e)))
    return out


#: Rule-made contexts by kind: forms, personal phrases, impersonal phrases.
TYPICAL = (
    (
        ["(555) 013-{0}{1}", "555-01{0}-{1}{0}", "555 01{0} {1}{0}", "{0}{1}-{0}1-{1}{0}{1}2", "0{0}{1}5 {1}{0}7{0}{1}8", "0{0}{1}55{1}{0}45", "{1}{0}3{0}{1}", "0{0} {1}{0} 6{1} 7{0} 89"],
        [
            "call me at {}", "phone: {}", "tel. {} after six", "my mobile is {} thanks", "fax {}", "SSN: {}", "social security number {}",
            "passport no. {}", "telefon {}", "text {} for details", "tax id {}", "reach me: {}", "account {}",
        ],
        [
            "order {} shipped", "invoice {}", "version {}", "ISBN {}", "between {} and more", "total {} USD", "score {} points",
            "see page {}", "item {} in stock", "population {}", "the {} of", "part {}", "{} years", "reference {}", "is {}. And",
        ],
    ),
    (["{0}ann[at]mail{1}.org", "bob{0} (at) host{1}.net", "eve{0}{1} [at] site [dot] com"], ["write to {} today", "{}", "my mail: {}"], []),
    (
        ["1{0}/0{1}/198{0}", "0{0}.0{1}.19{1}{0}", "19{1}{0}-0{1}-1{0}", "1{0} March 198{1}", "May 1{0}, 19{1}5", "{0} mai 197{1}"],
        ["born {} in", "born on {}", "date of birth: {}", "DOB {}", "birthday {}", "geboren am {}", "née le {}", "nacido el {}", "her birth, {}, was"],
        ["published {}", "released on {}", "updated {}.", "posted {}", "on {} the", "since {}", "deadline: {}", "the meeting of {} was", "invoice of {}", "{} and", "version {}", "({})"],
    ),
    (
        ["{0}{1} Oak Street", "{0}4{1} Old Mill Road", "Lindenstraße {0}{1}", "{0}{1} rue de la Paix", "Calle Mayor {0}{1}", "1{0} Elm Ave"],
        ["lives at {}", "I live at {} now", "my home: {}", "ship it to {}", "wohnt {} in", "j'habite {}", "vive en {}", "address: {}", "deliver to {}"],
        ["the museum at {}", "the shop, {}", "a store at {} opened", "hotel {}", "the concert at {}", "our office, {}", "from {} to the", "near {}", "{} was built"],
    ),
    (
        ["Mary Smith", "Jean Luc Picard", "Otto von Berg", "New York", "Anna B. Cole", "Rosa Maria Luz Vega"],
        ["my name is {}", "Name: {}", "I am {} and", "I'm {}", "dear Mr. {}", "Mrs {} said", "Herr {}", "je m'appelle {}", "me llamo {}", "regards, {}", "signed {}", "contact {}"],
        [
            "in {} they", "the {} was", "a statue of {}", "{} is a city", "from {} to", "the {} museum", "released by {}", "{}", "visit {} now", "about {}: a",
            "published by {}", "the name of a river. {} is", "contact the office in {}", "the user read {}", "born in {}", "she lives in {}",
            "call at noon. {} is", "his phone, a {} model", "at home {} is", "account of {}s", "an address. {} was", "write to follow {} news", "{}:",
        ],
    ),
    (["Sea Sea Sea Sea Sea", "To Be Or Not To Be So", "One Two Three Four Five Six Seven"], [], ["{}", "name: {}", "in {} they", "born {}", "contact {}", "follow {}"]),
    (["Mr. Smith", "Dr. Cole", "Frau Berger", "Mme Dupont"], ["dear {}", "with {} on", "ask {} for", "{}", "met {} at the museum"], []),
    (
        ["@ann_{0}{1}", "@bobby{0}", "@cole_smith"],
        ["follow {}", "my handle is {}", "username {}", "twitter: {}", "message me {}", "login {}"],
        ["the {} annotation", "use {} in css", "the decorator {}", "import {}", "{} rules", "as {} was", "a {} b"],
    ),
)


def typical() -> tuple[list[list[float]], list[int]]:
    """Rule-made contexts: every form in every personal and impersonal phrase of its kind, at either end of a text and within one."""
    kinds = []
    for forms, personal, other in TYPICAL:
        rows = []
        for value in sorted({form.format(a, b) for form in forms for a in (1, 4) for b in (5, 8)}):
            for phrases, label in ((personal, 1), (other, 0)):
                for phrase in phrases:
                    for before, after in (("", ""), ("And so it was. ", ", as we know")):
                        text = before + phrase.format(value) + after
                        at = text.index(value)
                        rows.append((describe(text, at, at + len(value)), label))
        kinds.append(rows)
    most = max(map(len, kinds))
    rows = [row for kind in kinds for row in kind * max(1, most // len(kind) // 2)]  # kinds of few forms count as well
    return [x for x, _ in rows], [y for _, y in rows]


def held_out(x: np.ndarray) -> np.ndarray:
    """Which rows are kept for calibration: equal descriptions are on one side."""
    return np.array([zlib.crc32(row.tobytes()) % 4 == 3 for row in x.astype(np.float32)], bool)


@dataclass
class Trees:
    """Boosted regression trees on the logistic loss, as flat arrays of complete trees."""

    start: float
    feature: np.ndarray  # [tree, inner node]
    cut: np.ndarray
    leaf: np.ndarray  # [tree, leaf]
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 2.0

    def nodes(self, x: np.ndarray, tree: int, depth: int = DEPTH) -> np.ndarray:
        """The node of a tree in which each row is at a depth."""
        rows, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        for _ in range(depth):
            node = 2 * node + 1 + (x[rows, self.feature[tree][node]] > self.cut[tree][node])
        return node

    def grown(self, x: np.ndarray, tree: int) -> np.ndarray:
        """What a tree adds to each row."""
        return self.leaf[tree][self.nodes(x, tree) - self.feature.shape[1]]

    def total(self, x: np.ndarray, trees: int) -> np.ndarray:
        """Sum of the first trees."""
        out = np.full(len(x), self.start)
        for t in range(trees):
            out += self.grown(x, t)
        return out

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Scores in whole steps, so that a corpus of any size has a bounded number of them."""
        return np.rint(self.total(x, len(self.leaf)) * STEPS) / STEPS

    def chance(self, x: np.ndarray) -> np.ndarray:
        return self.chance_of(self.raw(x))

    def chance_of(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * raw + self.shift, -30, 30)))


def feature_cuts(values: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Cuts of a feature: quantiles of its values, each counted `times`."""
    order = np.argsort(values, kind="stable")
    values, ends = values[order], np.cumsum(times[order])
    at = np.linspace(0, 1, BINS + 1)[1:-1] * (ends[-1] - 1)
    low = np.floor(at)
    below = values[np.searchsorted(ends, low, side="right")]
    above = values[np.searchsorted(ends, np.minimum(low + 1, ends[-1] - 1), side="right")]
    return np.unique(below + (at - low) * (above - below))


def level_sums(x: np.ndarray, y: np.ndarray, times: np.ndarray, cuts: list, model: Trees, tree: int, depth: int, value: np.ndarray) -> np.ndarray:
    """[rows, slope, curve] by (node of the level, feature, bin), in whole units: parts add up to the same in any order."""
    p = 1 / (1 + np.exp(-value))
    node = model.nodes(x, tree, depth) - (2**depth - 1)
    out = np.zeros((3, 2**depth, len(cuts), BINS), np.int64)
    parts = (times, times * np.rint((y - p) * UNITS), times * np.rint(p * (1 - p) * UNITS))
    for f, c in enumerate(cuts):
        at = node * BINS + np.searchsorted(c, x[:, f], side="left")
        for k, part in enumerate(parts):
            out[k, :, f] = np.bincount(at, part, 2**depth * BINS).astype(np.int64).reshape(-1, BINS)
    return out


def boost(cuts: list, share: float, sums: Callable[[Trees, int, int], np.ndarray], trees: int = TREES) -> Trees:
    """Fit trees by binned greedy splits; `sums` gives the sums of a level of a tree over all rows."""
    inner = 2**DEPTH - 1
    share = float(np.clip(share, 0.01, 0.99))
    model = Trees(
        float(np.log(share / (1 - share))), np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    )
    for t in range(trees):
        for depth in range(DEPTH):
            level = sums(model, t, depth)
            for i, n in enumerate(range(2**depth - 1, 2 ** (depth + 1) - 1)):
                rows, grad, hess = level[0, i], level[1, i] / UNITS, level[2, i] / UNITS
                g, h = grad[0].sum(), hess[0].sum()
                best, left = (1e-6, 0, np.inf), (g, h)
                if rows[0].sum() >= 20:
                    for f, c in enumerate(cuts):
                        if not len(c):
                            continue
                        gl, hl = np.cumsum(grad[f])[: len(c)], np.cumsum(hess[f])[: len(c)]
                        gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                        at = int(gain.argmax())
                        if gain[at] > best[0]:
                            best, left = (float(gain[at]), f, float(c[at])), (gl[at], hl[at])
                _, model.feature[t, n], model.cut[t, n] = best
                if depth == DEPTH - 1:
                    model.leaf[t, 2 * i] = RATE * left[0] / (left[1] + 1)
                    model.leaf[t, 2 * i + 1] = RATE * (g - left[0]) / (h - left[1] + 1)
    return model


def calibrate(model: Trees, raw: np.ndarray, truth: np.ndarray, times: np.ndarray, precision: float = PRECISION) -> Trees:
    """Logistic calibration and threshold from all rows that no tree has seen, by score and label."""
    model.shift, model.slope = fit_logistic(np.column_stack([np.ones(len(raw)), raw]), truth, ridge=1e-3, times=times)
    chance = model.chance_of(raw)
    order = np.argsort(-chance, kind="stable")
    right = np.cumsum((truth * times)[order]) / np.cumsum(times[order])
    last = np.append(chance[order][1:] != chance[order][:-1], True)
    fit = np.flatnonzero((right >= precision) & last)
    model.threshold = float(max(0.5, chance[order][fit[-1]])) if len(fit) else 2.0
    return model


def by_score(model: Trees, x: np.ndarray, y: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, label, rows), one each."""
    pairs, at = np.unique(np.column_stack([model.raw(x), y]), axis=0, return_inverse=True)
    return pairs[:, 0], pairs[:, 1], np.bincount(at.ravel(), times, len(pairs))


def train(x: np.ndarray, y: np.ndarray, precision: float = PRECISION, times: np.ndarray | None = None) -> Trees:
    """Trees on three quarters of the descriptions, calibration and threshold on the rest; a row counts `times`."""
    times = np.ones(len(y)) if times is None else times
    unseen = held_out(x)
    fx, fy, ft = x[~unseen], y[~unseen], times[~unseen]
    cuts, value = [feature_cuts(c, ft) for c in fx.T], np.zeros(len(fy))

    def sums(model: Trees, tree: int, depth: int) -> np.ndarray:
        if depth == 0:
            value[:] = value + model.grown(fx, tree - 1) if tree else model.start
        return level_sums(fx, fy, ft, cuts, model, tree, depth, value)

    model = boost(cuts, (fy * ft).sum() / ft.sum(), sums)
    return calibrate(model, *by_score(model, x[unseen], y[unseen], times[unseen]), precision)


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(float)
    y, times = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("label", "times"))
    return x.reshape(len(y), -1), y, times


def train_by_tasks(counted: DataFrame, x: np.ndarray, y: np.ndarray) -> Trees:
    """What `train` does over the rows of `counted` (x, label, times, unseen) and the given ones, with the sums of rows worked out by tasks.

    The driver holds sums by node, feature and bin, counts of a feature's values and counts by score.
    """
    unseen = held_out(x)
    fx, fy, ones = x[~unseen], y[~unseen], np.ones(len(y))
    fitted, kept = counted.where("NOT unseen"), counted.where("unseen")
    seen = fitted.select("times", F.posexplode("x")).groupBy("pos", "col").agg(F.sum("times").alias("n")).toArrow().to_pydict()
    pos, col, n = (np.array(seen[c], float) for c in ("pos", "col", "n"))
    cuts = [
        feature_cuts(np.append(v, col[pos == f]), np.append(np.ones(len(v)), n[pos == f])) for f, v in enumerate(fx.T)
    ]
    counts = fitted.agg(F.sum(F.col("label") * F.col("times")), F.sum("times")).first()

    def sums(model: Trees, tree: int, depth: int) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((3, 2**depth, len(cuts), BINS), np.int64)
            for batch in batches:
                bx, by, times = _arrays(batch)
                total += level_sums(bx, by, times, cuts, model, tree, depth, model.total(bx, tree))
            flat = total.reshape(3, -1)
            at = np.flatnonzero(flat[0])
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in (at, *flat[:, at])], names=["at", "n", "g", "h"])

        added = fitted.mapInArrow(run, "at long, n long, g long, h long").groupBy("at").agg(F.sum("n"), F.sum("g"), F.sum("h")).collect()
        total = level_sums(fx, fy, ones[: len(fy)], cuts, model, tree, depth, model.total(fx, tree))
        for at, *parts in added:
            total.reshape(3, -1)[:, at] += parts
        return total

    model = boost(cuts, (fy.sum() + (counts[0] or 0)) / (len(fy) + (counts[1] or 0)), sums)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in by_score(model, *_arrays(batch))], names=["raw", "label", "times"])

    held = kept.mapInArrow(scores, "raw double, label double, times double").groupBy("raw", "label").agg(F.sum("times").alias("times")).toArrow()
    parts = zip(by_score(model, x[unseen], y[unseen], ones[unseen]), (held.column(c).to_numpy() for c in ("raw", "label", "times")))
    raw, truth, times = (np.concatenate(p) for p in parts)
    order = np.lexsort((truth, raw))
    return calibrate(model, raw[order], truth[order], times[order])


_CANDIDATE = T.StructType(
    [
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("x", T.ArrayType(T.FloatType())),
    ]
)
_COUNTED = T.StructType(
    [
        T.StructField("x", T.ArrayType(T.FloatType())),
        T.StructField("label", T.IntegerType()),
        T.StructField("times", T.LongType()),
        T.StructField("unseen", T.BooleanType()),
    ]
)
_PROPOSED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("base", T.StringType()),
        T.StructField("candidates", T.ArrayType(_CANDIDATE)),
    ]
)
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS],
        T.StructField("base_sha256", T.StringType()),
        T.StructField("spans", T.StringType()),
    ]
)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def propose(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pattern spans and described candidates of every text, one narrow row each."""

    def one(doc_id, text):
        text = text or ""
        good, bad = patterns(text)
        found = candidates(text, good, bad)
        return doc_id, joined(good), [{"start": s, "end": e, "label": y, "x": x} for s, e, y, x in found]

    return map_rows(docs.select(F.col(id_col).cast("long"), F.col(text_col)), one, _PROPOSED)


def learn(proposed: DataFrame, max_rows: int | None = None, gathered: int = GATHERED) -> Trees:
    """Fit on all labelled candidates and the rule-made list; on a sample of `max_rows` only where a caller asks for one.

    Candidates of one description and label are one row that counts as often as there are any. Up to
    `gathered` such rows are fitted on the driver; the sums over more are added up by tasks, with the same result.
    """
    labelled = proposed.select("doc_id", F.explode("candidates").alias("c")).where("c.label >= 0")
    x, y = typical()
    if max_rows is not None:
        rows = _least(labelled, max_rows)
        x += [list(r["x"]) for r in rows]
        y += [r["label"] for r in rows]
        return train(np.array(x, np.float32).astype(float), np.array(y, float))
    counted = cut(_counted(labelled))
    x, y = np.array(x, np.float32).astype(float), np.array(y, float)
    if len(counted.select("times").take(gathered + 1)) > gathered:
        return train_by_tasks(counted, x, y)
    rows = counted.collect()
    if not rows:
        return train(x, y)
    more = np.array([r["x"] for r in rows], np.float32).astype(float)
    return train(
        np.concatenate([x, more]), np.append(y, [float(r["label"]) for r in rows]), times=np.append(np.ones(len(y)), [float(r["times"]) for r in rows])
    )


def _counted(labelled: DataFrame) -> DataFrame:
    """(x, label, times, unseen): each description and label once; `unseen` ones are held out."""

    def one(x, label, times):
        return x, label, times, bool(held_out(np.array([x], np.float32))[0])

    counts = labelled.groupBy(F.col("c.x").alias("x"), F.col("c.label").alias("label")).agg(F.count(F.lit(1)).alias("times"))
    return map_rows(counts, one, _COUNTED)


def _least(labelled: DataFrame, max_rows: int) -> list:
    """The sample of least hash; a bound on the hash, which more than enough rows meet, keeps
    what tasks send from growing with their number."""
    labelled = labelled.select("c.x", "c.label", F.xxhash64("doc_id", "c.start", "c.end").alias("h"))
    share = (max_rows + 10 * max_rows**0.5 + 100) / max(1, labelled.count())
    if share < 1:
        labelled = labelled.where(F.col("h") < int(share * 2**64) - 2**63)
    return labelled.orderBy("h", "x", "label").limit(max_rows).collect()


def select(candidates_: list[dict], base: list[tuple[int, int, int]], model: Trees) -> list[tuple[int, int, int]]:
    """Accepted spans: the likeliest first, of equal ones the earliest and longest, none that overlaps a pattern span or an accepted one."""
    free = [c for c in candidates_ if c["label"] != 0]  # a wrong check is certain
    if not free:
        return []
    chance = model.chance(np.array([c["x"] for c in free], np.float32).astype(float))
    taken: list[tuple[int, int]] = []  # disjoint and sorted
    for s, _, e in sorted(base):
        if taken and s < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(e, taken[-1][1]))
        else:
            taken.append((s, e))
    found = []
    for _, s, far in sorted((-p, c["start"], -c["end"]) for p, c in zip(chance, free) if p >= model.threshold):
        e = -far
        at = bisect_left(taken, (e, 0))  # the spans before it begin before the end
        if not at or taken[at - 1][1] <= s:
            insort(taken, (s, e))
            found.append((s, 4, e))
    return found


def redactions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, digest of the pattern spans and all spans of every text."""
    proposed = cut(propose(docs, id_col, text_col))
    model = learn(proposed)

    def one(doc_id, base_text, found):
        parts = [p.split(":") for p in base_text.split(",") if p]
        base = [(int(s), KINDS.index(k), int(e)) for k, s, e in parts]
        spans = sorted(base + select(found, base, model))
        counts = [sum(k == kind for _, k, _ in spans) for kind in range(len(KINDS))]
        return doc_id, *counts, hashlib.sha256(base_text.encode()).hexdigest(), joined(spans)

    return map_rows(proposed, one, SCHEMA)
