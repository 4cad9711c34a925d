"""Selectors -> columns over the element rows of a node table.

What a selector asks of one element is a plain column. Relations become columns as well, so that any nesting of them composes without
ever multiplying rows:

* an ancestor that matches: the greatest subtree_end of the matching elements before this one, in document order, reaches it;
* a descendant that matches: the next matching element in document order is still in this one's subtree;
* siblings: windows over the elements of one parent;
* a parent or child that matches: an equi-join on (page_id, node_id).

All windows start from page_id, so one exchange by page_id serves them all; a page is never larger than the parser's limits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from domspark.functions.text import to_lower

from .selectors import Attr, Class, Combined, Compound, Id, Pseudo, PseudoElement, SelectorList, Tag, Universal, nth

# The element classes of pseudo-classes and pseudo-elements.
FORM_TAGS = ("button", "input", "select", "textarea", "option", "optgroup", "fieldset")
REPLACED_TAGS = ("img", "input", "textarea", "select", "option", "br", "hr", "area", "base", "col", "embed", "link", "meta", "param", "source", "track", "wbr")
BLOCK_TAGS = ("div", "p", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "header", "footer", "main", "aside", "nav", "blockquote", "pre", "address")

_BEFORE, _AFTER = (Window.unboundedPreceding, -1), (1, Window.unboundedFollowing)


def _page():
    return Window.partitionBy("page_id").orderBy("node_id")


def _family():
    return Window.partitionBy("page_id", "parent_id").orderBy("node_id")



def attribute(name: str) -> Column:
    """The value of an attribute, whatever the case of its name; null without it."""
    return F.get(F.filter("attrs", lambda a: to_lower(a["name"]) == name), F.lit(0))["value"]


def has_attribute(name: str) -> Column:
    return F.exists("attrs", lambda a: to_lower(a["name"]) == name)


def _attr(s: Attr) -> Column:
    if not s.op:
        return has_attribute(s.name)
    value = attribute(s.name)
    test = {
        "=": lambda: value == s.value,
        "*=": lambda: F.contains(value, F.lit(s.value)),
        "^=": lambda: F.startswith(value, F.lit(s.value)),
        "$=": lambda: F.endswith(value, F.lit(s.value)),
        "~=": lambda: F.array_contains(F.split(value, r"[ \t\n\r\f]+"), s.value) if s.value else F.lit(False),
        "|=": lambda: (value == s.value) | F.startswith(value, F.lit(s.value + "-")),
    }[s.op]()
    return F.coalesce(test, F.lit(False))


def _nth(argument: str, place: Column) -> Column:
    found = nth(argument)
    if found is None:
        return F.lit(False)
    a, b = found
    if a == 0:
        return place == b
    side = place >= b if a > 0 else place <= b
    return side & ((place - b) % abs(a) == 0)


def _plain_pseudo(name: str) -> Column:
    tag = F.col("tag_lc")
    ticked = (tag == "input") & to_lower(F.coalesce(attribute("type"), F.lit(""))).isin("checkbox", "radio") & has_attribute("checked")
    return {
        "first-child": lambda: F.col("elem_pos") == 1,
        "last-child": lambda: F.col("elem_rpos") == 1,
        "only-child": lambda: F.col("elem_cnt") == 1,
        "first-of-type": lambda: F.col("type_pos") == 1,
        "last-of-type": lambda: F.col("type_rpos") == 1,
        "only-of-type": lambda: F.col("type_cnt") == 1,
        "empty": lambda: F.col("is_empty"),
        "root": lambda: F.col("parent_id") == 0,
        "link": lambda: (tag == "a") & has_attribute("href"),
        "disabled": lambda: has_attribute("disabled"),
        "enabled": lambda: tag.isin(*FORM_TAGS) & ~has_attribute("disabled"),
        "checked": lambda: ticked | ((tag == "option") & has_attribute("selected")),
    }.get(name, lambda: F.lit(False))()


class Matcher:
    """Adds to `rows`, which must hold all elements of their pages, the columns that relations need."""

    def __init__(self, rows: DataFrame):
        self.rows, self.base, self.made = rows, rows.columns, {}

    def _add(self, key: object, column: Column) -> Column:
        if key not in self.made:
            self.made[key] = f"_m{len(self.made)}"
            self.rows = self.rows.withColumn(self.made[key], column)
        return F.col(self.made[key])

    def _joined(self, key: object, flag: Column, own: str, theirs: str) -> Column:
        """Whether the element whose `theirs` is this row's `own` has the flag."""
        if key not in self.made:
            self.made[key] = f"_m{len(self.made)}"
            hits = self.rows.where(flag).select(F.col("page_id"), F.col(theirs).alias(own), F.lit(True).alias(self.made[key])).distinct()
            self.rows = self.rows.join(hits, ["page_id", own], "left")
        return F.coalesce(F.col(self.made[key]), F.lit(False))

    def _related(self, how: str, left: object, flag: Column) -> Column:
        """Whether an ancestor (" "), the parent (">"), the sibling before ("+") or any before ("~") has the flag."""
        key = (how, str(left), type(left).__name__, "back")
        if how == " ":
            return F.coalesce(self._add(key, F.max(F.when(flag, F.col("subtree_end"))).over(_page().rowsBetween(*_BEFORE))) >= F.col("node_id"), F.lit(False))
        if how == ">":
            return self._joined(key, flag, "parent_id", "node_id")
        if how == "+":
            return F.coalesce(self._add(key, F.lag(flag).over(_family())), F.lit(False))
        return F.coalesce(self._add(key, F.max(flag).over(_family().rowsBetween(*_BEFORE))), F.lit(False))

    def _has(self, how: str, right: object, flag: Column) -> Column:
        key = (how, str(right), type(right).__name__, "ahead")
        if how == " ":
            return F.coalesce(self._add(key, F.min(F.when(flag, F.col("node_id"))).over(_page().rowsBetween(*_AFTER))) <= F.col("subtree_end"), F.lit(False))
        if how == ">":
            return self._joined(key, flag, "node_id", "parent_id")
        if how == "+":
            return F.coalesce(self._add(key, F.lead(flag).over(_family())), F.lit(False))
        return F.coalesce(self._add(key, F.max(flag).over(_family().rowsBetween(*_AFTER))), F.lit(False))

    def flag(self, s: object) -> Column:
        if isinstance(s, SelectorList):
            return self._any([self.flag(x) for x in s.selectors])
        if isinstance(s, Compound):
            out = F.lit(True)
            for part in s.parts:
                out = out & self.flag(part)
            return out
        if isinstance(s, Combined):
            right = self.flag(s.right)
            return right & self._related(s.how, s.left, self.flag(s.left))
        if isinstance(s, Universal):
            return F.lit(True)
        if isinstance(s, Tag):
            return F.col("tag_lc") == s.name
        if isinstance(s, Class):
            return F.array_contains("classes", s.name)
        if isinstance(s, Id):
            return F.coalesce(F.col("id_attr") == s.name, F.lit(False))
        if isinstance(s, Attr):
            return _attr(s)
        if isinstance(s, PseudoElement):
            return ~F.col("tag_lc").isin(*REPLACED_TAGS) if s.name in ("before", "after") else F.col("tag_lc").isin(*BLOCK_TAGS)
        assert isinstance(s, Pseudo)
        if s.name == "has":
            return self._any([self._has(how, inner, self.flag(inner)) for how, inner in s.inner])
        if s.name in ("is", "where"):
            return self._any([self.flag(inner) for _, inner in s.inner])
        if s.name == "not":
            return ~self.flag(s.inner[0][1]) if s.inner else F.lit(False)
        if s.name.startswith("nth-"):
            place = ("type_" if s.name.endswith("type") else "elem_") + ("rpos" if "last" in s.name else "pos")
            return _nth(s.argument, F.col(place))
        return _plain_pseudo(s.name)

    @staticmethod
    def _any(flags: list[Column]) -> Column:
        out = F.lit(False)
        for f in flags:
            out = out | f
        return out


def is_local(s: object) -> bool:
    """Whether a selector asks nothing of other elements."""
    if isinstance(s, SelectorList):
        return all(map(is_local, s.selectors))
    if isinstance(s, Compound):
        return all(map(is_local, s.parts))
    if isinstance(s, Pseudo):
        return s.name != "has" and all(is_local(inner) for _, inner in s.inner)
    return not isinstance(s, Combined)


def _steps(s: object) -> bool:
    """Whether a selector asks for the very next or previous sibling, so that all elements must be there."""
    if isinstance(s, SelectorList):
        return any(map(_steps, s.selectors))
    if isinstance(s, Compound):
        return any(map(_steps, s.parts))
    if isinstance(s, Combined):
        return s.how == "+" or _steps(s.left) or _steps(s.right)
    return isinstance(s, Pseudo) and any(how == "+" or _steps(inner) for how, inner in s.inner)


def _parties(matcher: Matcher, s: object) -> list[Column]:
    """Local conditions, one of which every element has that can match the selector or a part of it."""
    if isinstance(s, SelectorList):
        return [c for x in s.selectors for c in _parties(matcher, x)]
    if isinstance(s, Combined):
        return _parties(matcher, s.left) + _parties(matcher, s.right)
    parts = s.parts if isinstance(s, Compound) else (s,)
    own = F.lit(True)
    for p in parts:
        if is_local(p):
            own = own & matcher.flag(p)
    return [own] + [c for p in parts if not is_local(p) for _, inner in p.inner for c in _parties(matcher, inner)]


def matching(nodes: DataFrame, selector: SelectorList) -> DataFrame:
    """The elements of `nodes` that match, as rows of nodes.

    A local selector stays a filter that reaches the scan. Otherwise only elements that can play a part in the selector are shuffled.
    """
    elements = nodes.where(F.col("node_type") == "element")
    matcher = Matcher(elements)
    if not is_local(selector) and not _steps(selector):
        matcher = Matcher(elements.where(matcher._any(_parties(matcher, selector))))
    flag = matcher.flag(selector)
    return matcher.rows.where(flag).select(*nodes.columns)
