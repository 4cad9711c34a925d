"""Selector texts, without Spark."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from domspark.plans.errors import SelectorError
from domspark.plans.selectors import classify_simple_selector, is_valid_selector, normalize_selector, nth, parse_selector, parse_selectors


@pytest.mark.parametrize(
    "text, want",
    [
        ("div", "div"),
        ("DIV.A#b", "div.A#b"),
        ("div>span", "div > span"),
        ("a  b", "a b"),
        ("a+b~c", "a + b ~ c"),
        ("a , b", "a, b"),
        ("[a='b']", '[a="b"]'),
        ("[ A ~= b ]", '[a~="b"]'),
        ("p:nth-child(2n+1)", "p:nth-child(2n+1)"),
        ("a:not(.b, #c)", "a:not(.b, #c)"),
        ("a:has(> b)", "a:has(> b)"),
        ("p::first-line", "p::first-line"),
        ("a/* x */b", "ab"),
        ("*", "*"),
        ("été", "été"),
    ],
)
def test_spelling(text, want):
    assert str(parse_selector(text)) == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("*", (0, 0, 0, 0)),
        ("#a .b c", (0, 1, 1, 1)),
        ("a:where(#b)", (0, 0, 0, 1)),
        ("a:is(#b, c)", (0, 1, 0, 1)),
        ("a:not(.b)", (0, 0, 1, 1)),
        ("a:has(> #b.c)", (0, 1, 1, 1)),
        ("p::before", (0, 0, 0, 2)),
        ("p:first-child[x]", (0, 0, 2, 1)),
        ("a, #b", (0, 1, 0, 0)),
    ],
)
def test_specificity(text, want):
    assert parse_selector(text).specificity == want


@pytest.mark.parametrize("text", ["", "a >", "a:unknown", "a[", "[a=5]", "[a='x' i]", ".5", "a:not(", "p::x", "a)", "a:not(:x)", "ns|a", "a || b"])
def test_invalid(text):
    assert not is_valid_selector(text)
    with pytest.raises(SelectorError):
        parse_selector(text)


@pytest.mark.parametrize("text, want", [("a:unknown", "a"), ("div[x=5]", "div"), ("a, b:", "a, b")])
def test_lenient_selectors_count_as_far_as_they_go(text, want):
    found = parse_selector(text, on_error="lenient")
    assert str(found) == want and found.errors


@pytest.mark.parametrize("text, want", [("odd", (2, 1)), ("even", (2, 0)), (" 3 ", (0, 3)), ("-n+3", (-1, 3)), ("2n - 1", (2, -1)), ("n", (1, 0)), ("+3", None), ("ODD", None), ("x", None)])
def test_nth(text, want):
    assert nth(text) == want


def test_helpers():
    assert classify_simple_selector(" #a ") == ("id", "a") and classify_simple_selector("a b") is None
    assert normalize_selector("  DIV   > P[a='X  Y'] ") == "div > p[a='X  Y']"
    assert [str(s) for s in parse_selectors(["a", "b"])] == ["a", "b"]
    assert parse_selector("a:not([b='x'])").selectors[0].parts[1].argument == "[b='x']"


@settings(max_examples=800, deadline=None)
@given(st.lists(st.sampled_from(["a", ".b", "#c", "[d]", "[d='e']", "[", "]", ":not(", ":has(>", ":is(", ")", ":nth-child(2n+1)", ":x", "::before", " ", ">", "+", "~", ",", "*", "'", "5", "\\", "/*", "*/", "é"]), max_size=12).map("".join))
def test_any_text_is_read_or_refused(text):
    found = parse_selector(text, on_error="lenient", cache=False)
    assert is_valid_selector(text) == (not found.errors)
    if found and not found.errors:
        assert str(parse_selector(str(found))) == str(found) and parse_selector(str(found)).specificity == found.specificity
