"""Accessors of single nodes, as columns over node-table rows, and relations between nodes of any kind, as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from domspark.functions.text import fold, trim_whitespace
from domspark.plans.matching import attribute
from domspark.plans.matching import has_attribute as _has

NAMESPACE_URIS = {"html": "http://www.w3.org/1999/xhtml", "svg": "http://www.w3.org/2000/svg", "mathml": "http://www.w3.org/1998/Math/MathML"}


def _family():
    return Window.partitionBy("page_id", "parent_id").orderBy("node_id")


def tag_name() -> Column:
    return F.col("tag")


def namespace_kind() -> Column:
    return F.col("ns")


def namespace_uri() -> Column:
    return F.create_map(*[F.lit(x) for kv in NAMESPACE_URIS.items() for x in kv])[F.col("ns")]


def has_attribute(name: str) -> Column:
    return F.coalesce(_has(fold(name)), F.lit(False))


def get_attribute(name: str) -> Column:
    """The value, or the empty string."""
    return F.coalesce(attribute(fold(name)), F.lit(""))


def attribute_count() -> Column:
    return F.size("attrs")


def element_id() -> Column:
    return F.coalesce("id_attr", F.lit(""))


def class_name() -> Column:
    return get_attribute("class")


def class_names() -> Column:
    return F.col("classes")


def has_class(name: str) -> Column:
    return F.coalesce(F.array_contains("classes", name), F.lit(False))


def own_text() -> Column:
    return F.coalesce("own_text", F.lit(""))


def text_value() -> Column:
    """The value of a text or comment node."""
    return F.coalesce("text", F.lit(""))


def text_trim() -> Column:
    return trim_whitespace(text_value())


def text_empty() -> Column:
    return text_value() == ""


def text_length() -> Column:
    """In bytes."""
    return F.octet_length(text_value())


def text_content(page_text: Column | str = "page_text") -> Column:
    """Of rows joined with the page's text. A comment has none."""
    page_text = F.col(page_text) if isinstance(page_text, str) else page_text
    return F.when(F.col("node_type") == "comment", "").otherwise(F.substring(page_text, F.col("text_start") + 1, F.col("text_len")))


def texts_of(nodes: DataFrame) -> DataFrame:
    """(page_id, page_text): the text of each page, which text_start and text_len of the node table point into. The document rows hold it."""
    return nodes.where(F.col("node_type") == "document").select("page_id", F.col("text").alias("page_text"))


def is_element() -> Column:
    return F.col("node_type") == "element"


def is_text() -> Column:
    return F.col("node_type") == "text"


def is_comment() -> Column:
    return F.col("node_type") == "comment"


def is_document() -> Column:
    return F.col("node_type") == "document"


def as_element(nodes: DataFrame) -> DataFrame:
    return nodes.where(is_element())


def as_text(nodes: DataFrame) -> DataFrame:
    return nodes.where(is_text())


def as_comment(nodes: DataFrame) -> DataFrame:
    return nodes.where(is_comment())


def as_document(nodes: DataFrame) -> DataFrame:
    return nodes.where(is_document())


def has_parent() -> Column:
    """True of all nodes but documents."""
    return F.col("parent_id").isNotNull()


def has_children() -> Column:
    return F.col("subtree_end") > F.col("node_id")


def attribute_to_string(a: Column) -> Column:
    """name="value", or the bare name of an attribute without a value."""
    return F.when(a["has_value"], F.concat(a["name"], F.lit('="'), a["value"], F.lit('"'))).otherwise(a["name"])


def attribute_less(a: Column, b: Column) -> Column:
    """Attributes compare by name, value and has_value, as their structs do."""
    return a < b


def with_siblings(nodes: DataFrame) -> DataFrame:
    """Adds prev_sibling_id and next_sibling_id: the neighbours of any kind."""
    return nodes.withColumns({"prev_sibling_id": F.lag("node_id").over(_family()), "next_sibling_id": F.lead("node_id").over(_family())})


def parents(nodes: DataFrame, of: DataFrame) -> DataFrame:
    """The parent rows of the rows `of`, once each; the document is the parent of top-level nodes."""
    return nodes.join(of.select("page_id", F.col("parent_id").alias("node_id")).distinct(), ["page_id", "node_id"], "left_semi")


def children(nodes: DataFrame, of: DataFrame) -> DataFrame:
    """The child rows, of any kind, of the rows `of`."""
    return nodes.join(of.select("page_id", F.col("node_id").alias("parent_id")).distinct(), ["page_id", "parent_id"], "left_semi")


def end_children(nodes: DataFrame) -> DataFrame:
    """(page_id, node_id, first_child_id, last_child_id) of all nodes with children."""
    ends = nodes.where(has_parent()).groupBy("page_id", "parent_id").agg(F.min("node_id").alias("first_child_id"), F.max("node_id").alias("last_child_id"))
    return ends.withColumnRenamed("parent_id", "node_id")


def siblings(nodes: DataFrame, of: DataFrame) -> DataFrame:
    """The nodes, of any kind, that have one of the rows `of` beside them under their parent, once each. A family of any size makes no pairs."""
    marked = nodes.join(of.select("page_id", "node_id", F.lit(1).alias("_of")), ["page_id", "node_id"], "left")
    others = F.count("_of").over(Window.partitionBy("page_id", "parent_id")) - F.when(F.col("_of").isNotNull(), 1).otherwise(0)
    return marked.withColumn("_n", F.when(has_parent(), others)).where("_n > 0").select(*nodes.columns)
