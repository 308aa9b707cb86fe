"""Shell-style patterns (`*`, `?`, `[seq]`, `[!seq]`) as regular expressions.

The translation is a column expression, so it runs on the pattern side wherever that
lives; names are then tested with `rlike`. Matching is case-sensitive and whole-string.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# One token: a bracket class, or any single character (an unclosed bracket is literal).
_TOKEN = r"(\[!?+\]?+[^\]]*+\]|[\s\S])"


def has_glob(pattern: Column) -> Column:
    """Whether the text has any pattern character."""
    return pattern.rlike(r"[*?\[]")


def _class(token: Column) -> Column:
    """A bracket class. A range that runs backwards holds nothing."""
    body = F.substring(token, F.lit(2), F.length(token) - 2)
    negated = body.startswith("!")
    body = F.when(negated, F.substring(body, F.lit(2), F.length(body))).otherwise(body)
    # Inside a Java class these would otherwise nest, intersect, negate or make ranges.
    escaped = lambda c: F.regexp_replace(c, r"([\\\[\]&^-])", r"\\$1")
    at = lambda t, i: F.substring(t, F.lit(i), F.lit(1))
    members = F.transform(
        F.regexp_extract_all(body, F.lit(r"([\s\S]-[\s\S]|[\s\S])"), F.lit(1)),
        lambda t: F.when(F.length(t) == 1, escaped(t))
        .when(at(t, 1) <= at(t, 3), F.concat(escaped(at(t, 1)), F.lit("-"), escaped(at(t, 3))))
        .otherwise(""),
    )
    inside = F.array_join(members, "")
    some = F.concat(F.when(negated, F.lit("[^")).otherwise(F.lit("[")), inside, F.lit("]"))
    return F.when(inside != "", some).when(negated, F.lit(".")).otherwise(F.lit("(?!)"))


def _literal(token: Column) -> Column:
    return F.regexp_replace(token, r"([^A-Za-z0-9_])", r"\\$1")


def glob_to_regex(pattern: Column) -> Column:
    """An anchored regular expression equal to the pattern."""
    tokens = F.regexp_extract_all(pattern, F.lit(_TOKEN), F.lit(1))
    parts = F.transform(
        tokens,
        lambda t: F.when(t == "*", F.lit(".*"))
        .when(t == "?", F.lit("."))
        .when(F.length(t) > 1, _class(t))
        .otherwise(_literal(t)),
    )
    return F.concat(F.lit("(?s)^"), F.array_join(parts, ""), F.lit(r"\z"))


# Marks of a name's beginning and end, and of what a pattern leaves open.
_BEGIN, _END, _OPEN = "\x02", "\x03", "\x01"
#: Letters of a gram, for literal pieces of at least so many; shorter pieces are grams as they are.
SHORT_GRAM, LONG_GRAM = 3, 8
GRAM_LENGTHS = (*range(1, SHORT_GRAM + 1), LONG_GRAM)


def marked(name: Column) -> Column:
    """The name between marks of its beginning and its end."""
    return F.concat(F.lit(_BEGIN), name, F.lit(_END))


def literal_pieces(pattern: Column) -> Column:
    """The literal pieces of a pattern, with the marks where they touch an end.

    A marked name that matches holds every piece. A pattern without literal characters has none.
    """
    tokens = F.regexp_extract_all(pattern, F.lit(_TOKEN), F.lit(1))
    kept = F.transform(tokens, lambda t: F.when((F.length(t) > 1) | t.isin("*", "?"), F.lit(_OPEN)).otherwise(t))
    pieces = F.split(marked(F.array_join(kept, "")), _OPEN)
    return F.filter(pieces, lambda p: ~p.isin("", _BEGIN, _END))


def gram_length(piece: Column) -> Column:
    """How long the grams of a piece are."""
    n = F.length(piece)
    return F.when(n >= LONG_GRAM, LONG_GRAM).when(n >= SHORT_GRAM, SHORT_GRAM).otherwise(n)


def no_grams() -> Column:
    return F.array().cast("array<string>")


def grams(text: Column, length: Column) -> Column:
    """The distinct runs of so many characters in a text."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - length + 1))
    found = F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, length)))
    return F.when(F.length(text) >= length, found).otherwise(no_grams())


def pattern_grams(pattern: Column) -> Column:
    """The distinct grams of a pattern's pieces."""
    return F.array_distinct(F.flatten(F.transform(literal_pieces(pattern), lambda p: grams(p, gram_length(p)))))
