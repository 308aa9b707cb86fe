"""Secrets that patterns cover in part."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fleetgauge.llm import secret_scan


@pytest.mark.parametrize("text, left", [
    ('password="abcdef!G7$kq%9Zx" end', '<assign>" end'),
    ('password="Xk9,mQ2;pL7|vB4" x', 'password="<credential>" x'),
    ("password = 'my very long pass phrase 9X!'.", "password = '<credential>'."),
    ('password="abcdef, G7$kq" x', '<assign>" x'),
    ('secret: "Xk9,mQ2;pL7\n', 'secret: "Xk9,mQ2;pL7\n'),  # no closing quote, eleven characters in two short parts
    ("redis://:xK9!pQ2$vLm7@host", "redis://:<credential>@host"),
    ("redis://" + "u" * 80 + ":xK9!pQ2$vLm7@host", "redis://" + "u" * 80 + ":<credential>@host"),
])
def test_no_part_of_a_secret_is_left(text, left):
    assert secret_scan.redacted(text) == left


def test_a_value_that_patterns_cover_is_listed_once():
    assert secret_scan.find("password=abcdefG7kq9Zx")[:2] == ([(0, 0, 22)], [])


@pytest.mark.parametrize("text", ["auth = os.environ[TOKEN_NAME]", "pwd: ${DB_PASSWORD_FILE}", "auth=get_token(user_name)", "pwd = $DB_PASSWORD_2"])
def test_references_are_no_secrets(text):
    assert secret_scan.find(text)[1] == []


def cheapest(value, spans):
    """The cheapest segmentation by trying all of them."""
    def rest(at):
        if at == len(value):
            return 0.0
        here = [1.0 + rest(at + 1)]
        here += [cost + (math.log10(2) if at else 0.0) + rest(j) for i, j, cost in spans if i == at]
        return min(here)

    return rest(0)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["pass", "word", "P@ss", "1990-12-31", "2001", "aa", "abab", "qwe", "z", "9", "!", "love", "é"]), max_size=5).map("".join))
def test_costs_equal_exhaustive_segmentation(value):
    assert math.isclose(secret_scan.guess_cost(value), cheapest(value, secret_scan.pieces(value)), abs_tol=1e-9)


def test_only_the_method_finds_these():
    texts = ["db_pwd := 'Zr8 kQ!z 9vLm'", "Authorization: Bearer q9.Zt7~kLm2", "passphrase='correct horse staple 77'", "ftp://me:Vx9!kq2Z@host"]
    for text in texts:
        base, more, _ = secret_scan.find(text)
        assert not base and len(more) == 1
