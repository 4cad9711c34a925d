"""Ordered sets of elements per page, as lazy DataFrames.

A NodeSet's rows are element rows of the node table and `pos`, the 0-based place within the page's set. Nothing runs before an action;
a chain of methods is one plan. Methods that give a DataFrame of scalars have a row for each page of the set's pages.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from domspark.functions.nodes import texts_of
from domspark.functions.text import fold
from domspark.options import Options
from domspark.plans.matching import attribute, has_attribute, matching
from domspark.plans.selectors import SelectorList, classify_simple_selector, parse_selector

_BEFORE, _AFTER = (Window.unboundedPreceding, -1), (1, Window.unboundedFollowing)


def _page():
    return Window.partitionBy("page_id")


def compiled(selector: str | SelectorList, on_error: str, cache_size: int = Options.max_css3_cache_size) -> SelectorList:
    return selector if isinstance(selector, SelectorList) else parse_selector(selector, on_error, cache_size=cache_size)


class NodeSet:
    """rows: the node table's columns and pos. nodes: the node table."""

    def __init__(self, rows: DataFrame, nodes: DataFrame, on_error: str = "raise", filtered: bool = False):
        self._rows, self.nodes, self.on_error, self._filtered = rows, nodes, on_error, filtered

    # ---- making ----

    @classmethod
    def document(cls, nodes: DataFrame, on_error: str = "raise") -> Document:
        return Document(nodes, on_error)

    def _with(self, rows: DataFrame, filtered: bool = False) -> NodeSet:
        return NodeSet(rows, self.nodes, self.on_error, filtered)

    def _kept(self, condition: Column) -> NodeSet:
        """A filter keeps the order; places are counted again only when a method needs them."""
        return self._with(self._rows.where(condition), True)

    @property
    def rows(self) -> DataFrame:
        """The elements with gapless places."""
        if self._filtered:
            self._rows, self._filtered = self._ranked(self._rows, "pos"), False
        return self._rows

    def _ranked(self, rows: DataFrame, *order: str | Column) -> DataFrame:
        return rows.withColumn("pos", F.row_number().over(_page().orderBy(*order)) - 1)

    def _reached(self, found: DataFrame) -> NodeSet:
        """Elements by (page_id, node_id, o): each once, at its first place by o."""
        first = found.groupBy("page_id", "node_id").agg(F.min("o").alias("o"))
        rows = first.join(self.nodes.where(F.col("node_type") == "element"), ["page_id", "node_id"])
        return self._with(self._ranked(rows, "o", "node_id").select(*self.nodes.columns, "pos"))

    @property
    def keys(self) -> DataFrame:
        return self.rows.select("page_id", "pos", "node_id")

    # ---- access ----

    def elements(self) -> DataFrame:
        return self.rows

    def size(self) -> DataFrame:
        """(page_id, size), also for pages without elements in the set."""
        counted = self._rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))
        return self._pages().join(counted, "page_id", "left").select("page_id", F.coalesce("n", F.lit(0)).cast("long").alias("size"))

    def empty(self) -> DataFrame:
        return self.size().select("page_id", (F.col("size") == 0).alias("empty"))

    def _pages(self) -> DataFrame:
        return self.nodes.where(F.col("node_type") == "document").select("page_id")

    def at(self, i: int) -> NodeSet:
        return self._with(self.rows.where(F.col("pos") == i), True)

    __getitem__ = eq = at

    def first_element(self) -> NodeSet:
        return self.at(0)

    def last_element(self) -> NodeSet:
        return self.last(1)

    def __iter__(self) -> Iterator:
        """Rows in page and set order, fetched partition by partition."""
        return self.rows.orderBy("page_id", "pos").toLocalIterator()

    # ---- filters ----

    def has_attribute(self, name: str, value: str | None = None) -> NodeSet:
        return self._kept(has_attribute(fold(name)) if value is None else F.coalesce(attribute(fold(name)) == value, F.lit(False)))

    def has_attribute_contains(self, name: str, text: str) -> NodeSet:
        return self._kept(F.coalesce(F.contains(attribute(fold(name)), F.lit(text)), F.lit(False)))

    def has_class(self, name: str) -> NodeSet:
        return self._kept(F.array_contains("classes", name))

    def has_tag(self, tag: str) -> NodeSet:
        return self._kept(F.col("tag_lc") == fold(tag))

    def _text_filter(self, test: Callable[[Column], Column]) -> NodeSet:
        rows = self.with_text("_text")._rows.where(test(F.col("_text"))).drop("_text")
        return self._with(rows, True)

    def has_text(self, text: str) -> NodeSet:
        """Elements whose whole text equals `text`."""
        return self._text_filter(lambda c: c == text)

    def containing_text(self, text: str) -> NodeSet:
        return self._text_filter(lambda c: F.contains(c, F.lit(text)))

    has_text_contains = containing_text

    def matching_text(self, test: Callable) -> NodeSet:
        """test takes the text column and gives a condition; a pandas UDF serves as well as built-in functions."""
        return self._text_filter(test)

    def filter(self, condition: Column | Callable[[DataFrame], Column]) -> NodeSet:
        return self._kept(condition if isinstance(condition, Column) else condition(self._rows))

    def _matches(self, selector: str | SelectorList) -> DataFrame | None:
        found = compiled(selector, self.on_error) if not isinstance(selector, str) or selector.strip() else SelectorList()
        return matching(self.nodes, found).select("page_id", "node_id") if found else None

    def not_(self, selector: str | SelectorList) -> NodeSet:
        """Drops what matches; an empty selector drops nothing."""
        hits = self._matches(selector)
        return self if hits is None else self._with(self._rows.join(hits, ["page_id", "node_id"], "left_anti"), True)

    def matching(self, selector: str | SelectorList) -> NodeSet:
        hits = self._matches(selector)
        return self._kept(F.lit(False)) if hits is None else self._with(self._rows.join(hits, ["page_id", "node_id"], "left_semi"), True)

    def _per_page(self, flags: DataFrame, name: str) -> DataFrame:
        found = flags.groupBy("page_id").agg(F.lit(True).alias("f"))
        return self._pages().join(found, "page_id", "left").select("page_id", F.coalesce("f", F.lit(False)).alias(name))

    def is_(self, selector: str | SelectorList) -> DataFrame:
        """(page_id, matches): whether any element matches."""
        return self._per_page(self.matching(selector)._rows.select("page_id"), "matches")

    def contains(self, what: str | NodeSet) -> DataFrame:
        """(page_id, contains): whether any element's text has the string, or the sets share an element."""
        if isinstance(what, str):
            return self._per_page(self.containing_text(what)._rows.select("page_id"), "contains")
        return self._per_page(self._rows.join(what._rows.select("page_id", "node_id"), ["page_id", "node_id"], "left_semi").select("page_id"), "contains")

    # ---- slices ----

    def _sliced(self, condition: Column) -> NodeSet:
        return self._with(self.rows.where(condition), True)

    def slice(self, start: int, end: int) -> NodeSet:
        return self._sliced((F.col("pos") >= start) & (F.col("pos") < end))

    def first(self, n: int) -> NodeSet:
        return self._sliced(F.col("pos") < n)

    limit = first

    def last(self, n: int) -> NodeSet:
        rows = self.rows.withColumn("_n", F.count(F.lit(1)).over(_page()))
        return self._with(rows.where(F.col("pos") >= F.col("_n") - n).drop("_n"), True)

    def skip(self, n: int) -> NodeSet:
        return self._sliced(F.col("pos") >= n)

    def even(self) -> NodeSet:
        return self._sliced(F.col("pos") % 2 == 0)

    def odd(self) -> NodeSet:
        return self._sliced(F.col("pos") % 2 == 1)

    def gt(self, i: int) -> NodeSet:
        return self._sliced(F.col("pos") > i)

    def lt(self, i: int) -> NodeSet:
        return self._sliced(F.col("pos") < i)

    # ---- navigation ----

    def _elements(self) -> DataFrame:
        return self.nodes.where(F.col("node_type") == "element")

    def children(self, selector: str | SelectorList = "") -> NodeSet:
        parents = self.keys.select("page_id", F.col("pos").alias("o"), F.col("node_id").alias("parent_id"))
        rows = parents.join(self._elements(), ["page_id", "parent_id"])
        out = self._with(self._ranked(rows, "o", "node_id").select(*self.nodes.columns, "pos"))
        return out if isinstance(selector, str) and not selector.strip() else out.matching(selector)

    def parent(self) -> NodeSet:
        return self._reached(self.rows.where("parent_id > 0").select("page_id", F.col("parent_id").alias("node_id"), F.struct("pos").alias("o")))

    def _upward(self, own: bool) -> DataFrame:
        line = F.concat(F.array("node_id"), F.col("ancestors")) if own else F.col("ancestors")
        return self.rows.select("page_id", "pos", F.posexplode(line).alias("k", "node_id"))

    def parents(self) -> NodeSet:
        return self._reached(self._upward(False).select("page_id", "node_id", F.struct("pos", "k").alias("o")))

    def closest(self, selector: str | SelectorList) -> NodeSet:
        """For each element itself or its nearest ancestor that matches."""
        hits = self._matches(selector)
        if hits is None:
            return self._kept(F.lit(False))
        near = self._upward(True).join(hits, ["page_id", "node_id"], "left_semi").groupBy("page_id", "pos").agg(F.min_by("node_id", "k").alias("node_id"))
        return self._reached(near.select("page_id", "node_id", F.struct("pos").alias("o")))

    def _step(self, column: str) -> NodeSet:
        return self._reached(self.rows.where(F.col(column).isNotNull()).select("page_id", F.col(column).alias("node_id"), F.struct("pos").alias("o")))

    def next_sibling(self) -> NodeSet:
        return self._step("next_elem_id")

    def prev_sibling(self) -> NodeSet:
        return self._step("prev_elem_id")

    def _family(self, *sides: tuple[int, int], descending: bool = False) -> NodeSet:
        """Elements that have one of the set on one of the sides (rows before or after) within their parent, by the first such place.

        Windows see each element once, so a family of any size costs no pairs.
        """
        own = self.rows.select("page_id", "node_id", F.col("pos").alias("_pos"))
        beside = Window.partitionBy("page_id", "parent_id").orderBy("node_id")
        rows = self._elements().join(own, ["page_id", "node_id"], "left")
        near = [F.min("_pos").over(beside.rowsBetween(*side)) for side in sides]
        rows = rows.withColumn("_o", F.least(*near) if len(near) > 1 else near[0]).where(F.col("_o").isNotNull())
        order = F.col("node_id").desc() if descending else F.col("node_id").asc()
        return self._with(self._ranked(rows, "_o", order).select(*self.nodes.columns, "pos"))

    def next_siblings(self) -> NodeSet:
        return self._family(_BEFORE)

    def prev_siblings(self) -> NodeSet:
        """Nearest first."""
        return self._family(_AFTER, descending=True)

    def siblings(self) -> NodeSet:
        return self._family(_BEFORE, _AFTER)

    def _below(self, hits: DataFrame, first: bool = False) -> NodeSet:
        """The nodes of hits (page_id, node_id) below each element, set element by set element, each once; of each element the first one only, if so asked."""
        found = self.nodes.join(hits, ["page_id", "node_id"], "left_semi").select("page_id", "node_id", F.explode("ancestors").alias("above"))
        own = self.keys.select("page_id", "pos", F.col("node_id").alias("above"))
        found = found.join(own, ["page_id", "above"])
        if first:
            found = found.groupBy("page_id", "pos").agg(F.min("node_id").alias("node_id"))
        return self._reached(found.select("page_id", "node_id", F.struct("pos").alias("o")))

    def get_element_by_id(self, name: str) -> NodeSet:
        """For each element the first one below it with the id."""
        return self._below(self.nodes.where((F.col("id_attr") == name) & F.lit(name != "")).select("page_id", "node_id"), first=True)

    def get_elements_by_tag_name(self, tag: str) -> NodeSet:
        return self._below(self.nodes.where(F.col("tag_lc") == fold(tag)).select("page_id", "node_id"))

    def get_elements_by_class_name(self, name: str) -> NodeSet:
        return self._below(self.nodes.where(F.array_contains("classes", name)).select("page_id", "node_id"))

    def css_first(self, selector: str | SelectorList) -> NodeSet:
        """For each element the first match below it."""
        hits = self._matches(selector)
        return self._kept(F.lit(False)) if hits is None else self._below(hits, first=True)

    query_selector = css_first

    def css(self, selector: str | SelectorList) -> NodeSet:
        """The matching elements below each element, set element by set element, each once."""
        hits = self._matches(selector)
        if hits is None:
            return self._kept(F.lit(False))
        return self._below(hits)

    query_selector_all = css
    find = css

    # ---- extraction ----

    def with_text(self, name: str = "text_content") -> NodeSet:
        """Adds the whole text of each element: all text below it, in document order."""
        kept = [c for c in self._rows.columns if c != name]
        rows = self._rows.join(texts_of(self.nodes), "page_id", "left")
        text = F.coalesce(F.substring(F.col("page_text"), F.col("text_start") + 1, F.col("text_len")), F.lit(""))
        return self._with(rows.select(*kept, text.alias(name)), self._filtered)

    def extract_attributes(self, name: str) -> DataFrame:
        """(page_id, pos, value) of the elements that have the attribute."""
        return self.rows.where(has_attribute(fold(name))).select("page_id", "pos", attribute(fold(name)).alias("value"))

    def extract_texts(self) -> DataFrame:
        self.rows  # noqa: B018  places first
        return self.with_text()._rows.select("page_id", "pos", F.col("text_content").alias("value"))

    def extract_own_texts(self) -> DataFrame:
        return self.rows.select("page_id", "pos", F.col("own_text").alias("value"))

    @staticmethod
    def collected(values: DataFrame) -> DataFrame:
        """(page_id, values): (page_id, pos, value) as one array for each page, in order."""
        pairs = F.array_sort(F.collect_list(F.struct("pos", "value")))
        return values.groupBy("page_id").agg(F.transform(pairs, lambda x: x["value"]).alias("values"))

    def map(self, fn: Callable[[DataFrame], Column], name: str = "value") -> DataFrame:
        """(page_id, pos, name): fn takes the rows and gives a column."""
        rows = self.rows
        return rows.select("page_id", "pos", fn(rows).alias(name))

    def each(self, fn: Callable, in_order: bool = False) -> NodeSet:
        """Calls fn(row), or fn(pos, row) if it takes two arguments, for each element, for its side effects: on the executors, or, in_order, on the
        driver by page and place, which fetches the rows partition by partition."""
        two = len(inspect.signature(fn).parameters) > 1

        def visit(rows) -> None:
            for row in rows:
                fn(row["pos"], row) if two else fn(row)

        visit(iter(self)) if in_order else self.rows.foreachPartition(visit)
        return self


class Document:
    """All pages of a node table; selections start here."""

    def __init__(self, nodes: DataFrame, on_error: str = "raise", options: Options = Options()):
        self.nodes, self.on_error, self.options = nodes, on_error, options

    def _set(self, rows: DataFrame) -> NodeSet:
        ranked = rows.withColumn("pos", F.row_number().over(_page().orderBy("node_id")) - 1)
        return NodeSet(ranked, self.nodes, self.on_error)

    def all(self) -> NodeSet:
        return self._set(self.nodes.where(F.col("node_type") == "element"))

    def css(self, selector: str | SelectorList) -> NodeSet:
        """All matching elements in document order. An id alone gives the first element that has it."""
        simple = classify_simple_selector(selector) if isinstance(selector, str) else None
        found = compiled(selector, self.on_error, self.options.max_css3_cache_size)
        rows = matching(self.nodes, found) if found else self.nodes.where(F.lit(False))
        out = self._set(rows)
        return out.at(0) if simple and simple[0] == "id" else out

    query_selector_all = css

    def css_first(self, selector: str | SelectorList) -> NodeSet:
        return self.css(selector).at(0)

    query_selector = css_first

    def get_element_by_id(self, name: str) -> NodeSet:
        return self._set(self.nodes.where((F.col("id_attr") == name) & F.lit(name != ""))).at(0)

    def get_elements_by_tag_name(self, tag: str) -> NodeSet:
        return self._set(self.nodes.where(F.col("tag_lc") == fold(tag)))

    def get_elements_by_class_name(self, name: str) -> NodeSet:
        return self._set(self.nodes.where(F.array_contains("classes", name)))
