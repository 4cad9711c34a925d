"""Streams of pages. Parsing keeps no state between pages, so it is the same function on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from domspark.options import Options
from domspark.plans.matching import Matcher, is_local
from domspark.plans.selectors import parse_selector
from domspark.sources.html import parse_html

PAGES = "page_id long, url string, html string"


def read_pages(spark: SparkSession, path: str, schema: str = PAGES, files_per_trigger: int = 64) -> DataFrame:
    """A stream over the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_nodes(pages: DataFrame, options: Options = Options()) -> DataFrame:
    return parse_html(pages, options, fail=False)


def stream_select(pages: DataFrame, selector: str, options: Options = Options()) -> DataFrame:
    """The matching elements of a stream, for selectors that ask nothing of other elements. Others need foreachBatch and Document.css."""
    found = parse_selector(selector)
    if not is_local(found):
        raise ValueError("a selector with combinators or :has() needs the whole page: use foreachBatch")
    nodes = stream_nodes(pages, options).where(F.col("node_type") == "element")
    return nodes.where(Matcher(nodes).flag(found))


def counted(nodes: DataFrame) -> DataFrame:
    """Running counts of elements by tag."""
    return nodes.where(F.col("node_type") == "element").groupBy("tag_lc").agg(F.count(F.lit(1)).alias("n"))
