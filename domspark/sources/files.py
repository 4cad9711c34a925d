"""HTML files -> pages."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from domspark.functions.encoding import decoded, encoding_hint
from domspark.plans.errors import FileReadError


def read_html_files(spark: SparkSession, path: str, glob: str = "*.htm*", encodings: str = "utf-8") -> DataFrame:
    """(page_id, path, html, error) of the files below path.

    With encodings="utf-8" only UTF-8 files are read, as single files are by default: others have a null html and the error
    UnsupportedEncoding. With encodings="any" every encoding that can be sniffed and decoded is. A path that isn't there raises, as
    Spark's readers do. page_id is a hash of the path.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content")
    rows = files.withColumn("hint", encoding_hint("content"))
    label = F.col("hint.canonical_label")
    text = F.when((label == "utf-8") | F.lit(encodings == "any"), decoded("content", label))
    rows = rows.select(F.xxhash64("path").alias("page_id"), "path", text.alias("html"), "hint")
    return rows.withColumn("error", F.when(F.col("html").isNull(), "UnsupportedEncoding"))


def parse_file(spark: SparkSession, path: str, encodings: str = "utf-8", glob: str = "*", fail: bool = True) -> DataFrame:
    """read_html_files for a file or folder that may be missing or unreadable: then it raises FileReadError, or, with fail=False, gives one row of an
    empty page with that error, as a lenient parse of a single file does. What html.parse_html makes of that row is an empty document."""
    try:
        rows = read_html_files(spark, path, glob, encodings)
        if not rows.isEmpty():
            return rows if fail else rows.withColumn("html", F.coalesce("html", F.lit("")))
        reason = "no file there"
    except (AnalysisException, Py4JJavaError) as e:
        reason = str(e).splitlines()[0]
    if fail:
        raise FileReadError(f"{path}: {reason}")
    row = spark.range(1).select(F.lit(path).alias("path"), F.lit("").alias("html"), F.lit(FileReadError.code).alias("error"))
    return row.select(F.xxhash64("path").alias("page_id"), "path", "html", "error")


def write_nodes(nodes: DataFrame, path: str, by: int | None = None) -> None:
    """The node table as Parquet, its rows sorted by page and document order within files; `by` sets the number of files by page."""
    rows = nodes if by is None else nodes.repartition(by, "page_id")
    rows.sortWithinPartitions("page_id", "node_id").write.mode("overwrite").parquet(path)
