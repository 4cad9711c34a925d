"""CSS selectors: text -> a tree of plain values, with specificity and a canonical spelling.

A selector list is parsed once on the driver; plans.matching turns it into columns.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from collections import OrderedDict

from domspark.functions.text import HTML_SPACE, collapse_spaces, fold
from domspark.options import Options

from .errors import SelectorError

_COMMENT = re.compile(r"(\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*')|/\*.*?(?:\*/|\Z)", re.S)
_IDENT = r"(?:[A-Za-z_]|[^\x00-\x7f])(?:[A-Za-z0-9_-]|[^\x00-\x7f])*"
_LEX = re.compile(
    rf"(?P<space>[ \t\n\r\f]+)|\#(?P<hash>{_IDENT})|(?P<ident>{_IDENT})|(?P<number>[0-9][0-9.]*)"
    r"|(?P<string>\"(?:\\.|[^\"\\])*\"?|'(?:\\.|[^'\\])*'?)|(?P<op>[*^$~|]=|\|\||::|[.*\[\]=~|>+,:()-])|(?P<bad>.)",
    re.S,
)
_SIMPLE = re.compile(rf"([#.]?)({_IDENT})")
_NTH = re.compile(r"[ \t\n\r\f]*([+-]?[0-9]*)n[ \t\n\r\f]*([+-][ \t\n\r\f]*[0-9]+)?[ \t\n\r\f]*")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}

# The pseudo-classes and pseudo-elements that are known.
PLAIN_PSEUDO = ("first-child", "last-child", "first-of-type", "last-of-type", "only-child", "only-of-type", "empty", "root", "hover", "active", "focus", "visited", "link", "disabled", "enabled", "checked")
NTH_PSEUDO = ("nth-child", "nth-last-child", "nth-of-type", "nth-last-of-type")
LIST_PSEUDO = ("not", "is", "where", "has")
PSEUDO_ELEMENTS = ("before", "after", "first-line", "first-letter")
ATTRIBUTE_OPERATORS = ("=", "*=", "^=", "$=", "~=", "|=")

Specificity = tuple[int, int, int, int]
_NONE: Specificity = (0, 0, 0, 0)


def _plus(a: Specificity, b: Specificity) -> Specificity:
    return tuple(x + y for x, y in zip(a, b, strict=True))  # type: ignore[return-value]


@dataclass(frozen=True)
class Universal:
    specificity = _NONE

    def __str__(self) -> str:
        return "*"


@dataclass(frozen=True)
class Tag:
    name: str
    specificity = (0, 0, 0, 1)

    def __str__(self) -> str:
        return self.name


@dataclass(frozen=True)
class Class:
    name: str
    specificity = (0, 0, 1, 0)

    def __str__(self) -> str:
        return "." + self.name


@dataclass(frozen=True)
class Id:
    name: str
    specificity = (0, 1, 0, 0)

    def __str__(self) -> str:
        return "#" + self.name


@dataclass(frozen=True)
class Attr:
    name: str
    op: str = ""
    value: str = ""
    specificity = (0, 0, 1, 0)

    def __str__(self) -> str:
        return f'[{self.name}{self.op}"{self.value}"]' if self.op else f"[{self.name}]"


@dataclass(frozen=True)
class Pseudo:
    """argument is the text between the parentheses, inner the selectors it holds: pairs of a leading combinator and a list."""

    name: str
    argument: str = ""
    inner: tuple[tuple[str, SelectorList], ...] = ()

    @property
    def specificity(self) -> Specificity:
        if self.name == "where":
            return _NONE
        if self.name in LIST_PSEUDO:
            return max((s.specificity for _, s in self.inner), default=_NONE)
        return (0, 0, 1, 0)

    def __str__(self) -> str:
        return f":{self.name}({self.argument})" if self.name in NTH_PSEUDO + LIST_PSEUDO else f":{self.name}"


@dataclass(frozen=True)
class PseudoElement:
    name: str
    specificity = (0, 0, 0, 1)

    def __str__(self) -> str:
        return "::" + self.name


@dataclass(frozen=True)
class Compound:
    parts: tuple

    @property
    def specificity(self) -> Specificity:
        out = _NONE
        for p in self.parts:
            out = _plus(out, p.specificity)
        return out

    def __str__(self) -> str:
        return "".join(map(str, self.parts))


@dataclass(frozen=True)
class Combined:
    """left, then right; how is one of " ", ">", "+" and "~"."""

    left: object
    how: str
    right: object

    @property
    def specificity(self) -> Specificity:
        return _plus(self.left.specificity, self.right.specificity)

    def __str__(self) -> str:
        return f"{self.left}{' ' if self.how == ' ' else f' {self.how} '}{self.right}"


@dataclass(frozen=True)
class SelectorList:
    selectors: tuple = ()
    errors: tuple[str, ...] = ()

    @property
    def specificity(self) -> Specificity:
        """The highest of its selectors."""
        return max((s.specificity for s in self.selectors), default=_NONE)

    def __str__(self) -> str:
        return ", ".join(map(str, self.selectors))

    def __bool__(self) -> bool:
        return bool(self.selectors)


def without_comments(text: str) -> str:
    return _COMMENT.sub(lambda m: m[1] or "", text)


def _string(raw: str) -> str:
    body = raw[1:-1] if len(raw) > 1 and raw[-1] == raw[0] else raw[1:]
    return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), body, flags=re.S)


class _Stop(Exception):
    """The part being read can't go on; what was read before it counts."""


class _Reader:
    """Recursive descent over the tokens (kind, value, start, end)."""

    def __init__(self, text: str):
        self.text = without_comments(text)
        self.tokens = []
        for m in _LEX.finditer(self.text):
            kind = m.lastgroup
            self.tokens.append((m[0] if kind == "op" else kind, m[kind], m.start(), m.end()))
        self.at, self.errors = 0, []

    def kind(self) -> str:
        return self.tokens[self.at][0] if self.at < len(self.tokens) else "end"

    def next(self) -> tuple:
        token = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "", len(self.text), len(self.text))
        self.at += 1
        return token

    def wrong(self, message: str) -> _Stop:
        self.errors.append(message)
        return _Stop()

    def skip(self) -> bool:
        start = self.at
        while self.kind() == "space":
            self.at += 1
        return self.at > start

    def list(self) -> SelectorList:
        found = []
        while True:
            self.skip()
            if self.kind() == "end":
                break
            if (one := self.complex()) is not None:
                found.append(one)
            self.skip()
            if self.kind() != ",":
                if self.kind() != "end":
                    self.errors.append(f"Unexpected {self.tokens[self.at][1]!r}")
                break
            self.at += 1
        if not found and not self.errors:
            self.errors.append("Empty selector")
        return SelectorList(tuple(found), tuple(self.errors))

    def complex(self):
        left = self.compound()
        while left is not None:
            spaced = self.skip()
            how = self.kind()
            if how in (">", "+", "~"):
                self.at += 1
            elif spaced and how not in (",", "end"):
                how = " "
            else:
                break
            self.skip()
            right = self.compound()
            if right is None:
                if how != " ":
                    self.errors.append("Expected selector after combinator")
                break
            left = Combined(left, how, right)
        return left

    def compound(self):
        parts = []
        while True:
            try:
                part = self.simple()
            except _Stop:
                part = None
            if part is None:
                break
            parts.append(part)
        return None if not parts else parts[0] if len(parts) == 1 else Compound(tuple(parts))

    def simple(self):
        kind = self.kind()
        if kind == "ident":
            return Tag(self.next()[1].lower())
        if kind == "hash":
            return Id(self.next()[1])
        if kind == "*":
            self.at += 1
            return Universal()
        if kind == ".":
            self.at += 1
            return Class(self.need("ident", "Expected identifier after '.' in class selector"))
        if kind == "[":
            self.at += 1
            return self.attribute()
        if kind == ":":
            self.at += 1
            return self.pseudo()
        if kind == "::":
            self.at += 1
            name = self.need("ident", "Expected pseudo-element name after '::'")
            if name not in PSEUDO_ELEMENTS:
                raise self.wrong(f"Unsupported pseudo-element: {name}")
            return PseudoElement(name)
        return None

    def need(self, kind: str, message: str) -> str:
        got = self.next()
        if got[0] != kind:
            raise self.wrong(message)
        return got[1]

    def attribute(self) -> Attr:
        self.skip()
        name = self.need("ident", "Expected attribute name in attribute selector").lower()
        self.skip()
        op = value = ""
        if self.kind() != "]":
            op = self.next()[0]
            if op not in ATTRIBUTE_OPERATORS:
                raise self.wrong("Expected an attribute operator")
            self.skip()
            kind, raw, _, _ = self.next()
            if kind not in ("string", "ident"):
                raise self.wrong("Expected value after attribute operator")
            value = _string(raw) if kind == "string" else raw
            self.skip()
        if self.kind() != "]":
            self.errors.append("Expected ']'")
        else:
            self.at += 1
        return Attr(name, op, value)

    def pseudo(self) -> Pseudo:
        # A name may hold hyphens, which identifiers have inside.
        name = self.need("ident", "Expected pseudo-class name after ':'")
        argument = ""
        if self.kind() == "(":
            start, depth = self.next()[3], 1
            while depth:
                kind, _, at, end = self.next()
                if kind == "end":
                    raise self.wrong("Unexpected end of input in pseudo-class arguments")
                depth += (kind == "(") - (kind == ")")
            argument = self.text[start:at].lstrip(HTML_SPACE)
        if name in PLAIN_PSEUDO:
            return Pseudo(name)
        if name in NTH_PSEUDO:
            return Pseudo(name, argument)
        if name not in LIST_PSEUDO:
            raise self.wrong(f"Unsupported pseudo-class: {name}")
        return Pseudo(name, argument, self.inner(name, argument))

    def inner(self, name: str, argument: str) -> tuple[tuple[str, SelectorList], ...]:
        if name != "has":
            found = _Reader(argument).list() if argument else SelectorList()
            self.errors += [f"in :{name}(): {e}" for e in found.errors]
            return ((" ", found),) if found else ()
        out = []
        for part in split_arguments(argument):
            part = part.strip(HTML_SPACE)
            how = part[:1] if part[:1] in (">", "+", "~") and part else " "
            found = _Reader(part if how == " " else part[1:].strip(HTML_SPACE)).list()
            self.errors += [f"in :has(): {e}" for e in found.errors]
            if found:
                out.append((how, found))
        return tuple(out)


def split_arguments(text: str) -> list[str]:
    """The parts between commas that are in no parentheses, brackets or strings."""
    out, depth, start = [], 0, 0
    for m in _LEX.finditer(text):
        if m.lastgroup == "op":
            depth += (m[0] in "([") - (m[0] in ")]")
            if m[0] == "," and depth == 0:
                out.append(text[start : m.start()])
                start = m.end()
    return [*out, text[start:]]


_cache: OrderedDict[str, SelectorList] = OrderedDict()


def _parsed(text: str, size: int = Options.max_css3_cache_size) -> SelectorList:
    """From the cache, which keeps the `size` selectors that were used last."""
    found = _cache.pop(text, None) or _Reader(text).list()
    _cache[text] = found
    while len(_cache) > max(0, size):
        _cache.popitem(last=False)
    return found


def parse_selector(text: str, on_error: str = "raise", cache: bool = True, cache_size: int = Options.max_css3_cache_size) -> SelectorList:
    """The selectors of a list. on_error is raise, or lenient: then what could be read counts, and errors are listed in the result."""
    found = _parsed(text, cache_size) if cache else _Reader(text).list()
    if found.errors and on_error == "raise":
        raise SelectorError("; ".join(found.errors))
    return found


def parse_selectors(texts: list[str], on_error: str = "raise") -> list[SelectorList]:
    return [parse_selector(t, on_error) for t in texts]


def is_valid_selector(text: str) -> bool:
    return not _parsed(text).errors


def normalize_selector(text: str) -> str:
    """White space collapsed and letters lower-cased outside of strings. Class names change too: this is for display only."""
    parts = re.split(r"(\"[^\"]*\"?|'[^']*'?)", text)
    return "".join(p if i % 2 else fold(collapse_spaces(p)) for i, p in enumerate(parts)).strip(" ")


def classify_simple_selector(text: str) -> tuple[str, str] | None:
    """("id" | "class" | "type", name) of a selector that is one of these alone."""
    m = _SIMPLE.fullmatch(text.strip(HTML_SPACE))
    return ({"#": "id", ".": "class", "": "type"}[m[1]], m[2]) if m else None


def nth(argument: str) -> tuple[int, int] | None:
    """a and b of an+b; None for what matches nothing."""
    text = argument.strip(HTML_SPACE)
    if text in ("odd", "even"):
        return 2, int(text == "odd")
    if text and all("0" <= c <= "9" for c in text):
        return 0, int(text)
    m = _NTH.fullmatch(text)
    if not m:
        return None
    a = {"": 1, "+": 1, "-": -1}.get(m[1])
    return int(m[1]) if a is None else a, int(re.sub(r"[ \t\n\r\f]", "", m[2])) if m[2] else 0
