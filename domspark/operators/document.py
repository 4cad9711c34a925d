"""Page-level operators: a row for each page. Pages are those of `texts` or `pages`, so pages without a match have their row as well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from domspark.functions.text import to_lower, trim_whitespace
from domspark.plans.matching import attribute, has_attribute


def _first(pages: DataFrame, found: DataFrame, value: Column, name: str) -> DataFrame:
    """The value of the first found node of each page, or the empty string."""
    first = found.groupBy("page_id").agg(F.min_by(value, F.col("node_id")).alias("v"))
    return pages.select("page_id").join(first, "page_id", "left").select("page_id", F.coalesce("v", F.lit("")).alias(name))


def _is(c: Column, text: str) -> Column:
    return to_lower(trim_whitespace(F.coalesce(c, F.lit("")))) == text.strip(" \t\n\r\f").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def title(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, title): the text of the first title element. A title's content is text, so its own text is all of it."""
    return _first(pages, nodes.where(F.col("tag_lc") == "title"), F.col("own_text"), "title")


def charset(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """(page_id, charset): of the first meta element that names one."""
    meta = nodes.where(F.col("tag_lc") == "meta")
    content = trim_whitespace(F.coalesce(attribute("content"), F.lit("")))
    told = F.regexp_extract(content, r"(?is)^.*?charset=([^; \t\n\r]*)", 1)
    kind = F.when(has_attribute("charset"), trim_whitespace(attribute("charset"))).when(_is(attribute("http-equiv"), "content-type") & F.contains(to_lower(content), F.lit("charset=")), told)
    return _first(pages, meta.withColumn("_c", kind).where(F.col("_c").isNotNull()), F.col("_c"), "charset")


def source_html(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.col("html").alias("source_html"))


def get_meta_content(pages: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """(page_id, content) of the first meta element with that name."""
    found = nodes.where((F.col("tag_lc") == "meta") & _is(attribute("name"), name))
    return _first(pages, found, F.coalesce(attribute("content"), F.lit("")), "content")


def get_meta_property(pages: DataFrame, nodes: DataFrame, prop: str) -> DataFrame:
    found = nodes.where((F.col("tag_lc") == "meta") & _is(attribute("property"), prop))
    return _first(pages, found, F.coalesce(attribute("content"), F.lit("")), "content")


def _values(nodes: DataFrame, tag: str, name: str) -> DataFrame:
    return nodes.where((F.col("tag_lc") == tag) & has_attribute(name)).select("page_id", "node_id", attribute(name).alias("value"))


def get_all_links(nodes: DataFrame) -> DataFrame:
    """(page_id, node_id, value): the href of every a element that has one."""
    return _values(nodes, "a", "href")


def get_all_images(nodes: DataFrame) -> DataFrame:
    return _values(nodes, "img", "src")


def root(nodes: DataFrame) -> DataFrame:
    """The html element of each page, or else its first top-level element, as node rows."""
    top = nodes.where((F.col("parent_id") == 0) & (F.col("node_type") == "element"))
    pick = top.groupBy("page_id").agg(F.min_by("node_id", F.struct(F.col("tag_lc") != "html", F.col("node_id"))).alias("node_id"))
    return nodes.join(pick, ["page_id", "node_id"], "left_semi")


def html(nodes: DataFrame) -> DataFrame:
    """The first top-level html element of each page, as node rows."""
    pick = nodes.where((F.col("parent_id") == 0) & (F.col("tag_lc") == "html")).groupBy("page_id").agg(F.min("node_id").alias("node_id"))
    return nodes.join(pick, ["page_id", "node_id"], "left_semi")
