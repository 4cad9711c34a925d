"""Pages -> node, text, token and error tables. Each page is parsed by itself, so parsing needs no shuffle and runs on streams as well."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from domspark.functions.nodes import texts_of
from domspark.functions.text import fold
from domspark.options import Options
from domspark.plans.columns import NodeColumns, attribute_lists, lists, node_rows
from domspark.plans.errors import HtmlError
from domspark.plans.scanner import CLOSE, DOCTYPE, FRAGMENT_TEXT, TEXT, Scanner
from domspark.plans.tree import Tree, parse

ATTRS = "array<struct<name: string, value: string, has_value: boolean>>"
NODES = (
    "page_id long, node_id int, parent_id int, subtree_end int, depth int, ancestors array<int>, node_type string, tag string, tag_lc string, ns string, "
    f"attrs {ATTRS}, id_attr string, classes array<string>, text string, elem_pos int, elem_rpos int, elem_cnt int, type_pos int, type_rpos int, "
    "type_cnt int, prev_elem_id int, next_elem_id int, is_empty boolean, text_start int, text_len int, own_text string"
)
TOKENS = f"page_id long, token_seq int, type string, name string, value string, attrs {ATTRS}, public_id string, system_id string, force_quirks boolean"
ERRORS = "page_id long, err_seq int, code string, message string, position int, line int, col int"
_NODE = NODES.removeprefix("page_id long, ").replace(" int", ": int").replace(" string", ": string").replace(" boolean", ": boolean").replace(" array", ": array").replace("::", ":")
_ERROR = ERRORS.removeprefix("page_id long, ").replace(" int", ": int").replace(" string", ": string")
WHOLE = f"page_id long, nodes array<struct<{_NODE}>>, errors array<struct<{_ERROR}>>"
CHUNK = 20_000  # rows of an output batch
PAGES = 64  # pages of an output batch whose rows are pages
CHARS = 8 << 20  # characters of html after which an output batch is put out, however few rows it has
_EMPTY = Tree()


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType.fromDDL(ddl))


def _uncollected(run: Callable) -> Callable:
    """Trees hold no reference cycles, and scanning millions of live objects for some would take a third of the time, so the cycle collector rests
    while a batch is worked on. Between batches it is as it was."""

    def made(*args):
        on = gc.isenabled()
        gc.disable()
        try:
            return run(*args)
        finally:
            if on:
                gc.enable()

    return made


def _pages(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The rows of a batch, each made when it is asked for: a batch may hold 64 MB of pages, of which only one at a time is a Python string."""
    for i in range(batch.num_rows):
        yield tuple(c[i].as_py() for c in batch.columns)


def _batches(batches: Iterator[pa.RecordBatch], size: int, take: Callable, held: Callable, give: Callable) -> Iterator[pa.RecordBatch]:
    """Hands each (page, html, context) to take, and puts out a batch by give whenever held says that there are `size` rows, or CHARS were taken."""
    chars = 0

    @_uncollected
    def some(rows: Iterator) -> pa.RecordBatch | None:
        nonlocal chars
        for page, html, context in rows:
            take(page, html or "", context)
            chars += len(html or "")
            if held() >= size or chars >= CHARS:
                chars = 0
                return give()
        return None

    for b in batches:
        rows = _pages(b)
        while (made := some(rows)) is not None:
            yield made
    yield give()


def _tuples(ddl: str, rows_of: Callable[[str, object], list[tuple]]):
    """A function for mapInArrow that puts out tuples behind their page_id; attribute lists become one array."""
    schema = _arrow(ddl)

    def column(values: tuple, field: pa.Field) -> pa.Array:
        return attribute_lists(values) if field.name == "attrs" else pa.array(values, field.type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def give() -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [()] * len(schema)
            out = pa.RecordBatch.from_arrays([column(c, f).cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
            rows.clear()
            return out

        return _batches(batches, CHUNK, lambda page, html, context: rows.extend((page, *r) for r in rows_of(html, context)), lambda: len(rows), give)

    return run


def _shaped(columns: dict[str, pa.Array], fields) -> list[pa.Array]:
    return [columns[f.name].cast(f.type) for f in fields]


def _nodes(ddl: str, parsed: Callable):
    """A function for mapInArrow that puts out the node table."""
    schema = _arrow(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [NodeColumns()]

        def give() -> pa.RecordBatch:
            columns, _ = held[0].columns()
            held[0] = NodeColumns()
            return pa.RecordBatch.from_arrays(_shaped(columns, schema), schema=schema)

        return _batches(batches, CHUNK, lambda page, html, context: held[0].add(page, *parsed(html, context)[:2]), lambda: len(held[0]), give)

    return run


def _wholes(ddl: str, parsed: Callable):
    """A function for mapInArrow that puts out a row for each page: its nodes and its errors."""
    schema = _arrow(ddl)
    nodes, errors = schema.field("nodes").type.value_type, schema.field("errors").type.value_type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = [NodeColumns(), []]

        def take(page, html: str, context) -> None:
            tree, root, found = parsed(html, context)
            held[0].add(page, tree, root)
            held[1].append([dict(zip([f.name for f in errors], (i, *e), strict=True)) for i, e in enumerate(found)])

        def give() -> pa.RecordBatch:
            columns, sizes = held[0].columns(in_order=True)
            rows = pa.StructArray.from_arrays(_shaped(columns, list(nodes)), fields=list(nodes))
            made = {"page_id": pa.array(held[0].pages, pa.int64()), "nodes": lists(sizes, rows), "errors": pa.array(held[1], pa.list_(errors))}
            held[:] = [NodeColumns(), []]
            return pa.RecordBatch.from_arrays(_shaped(made, schema), schema=schema)

        return _batches(batches, PAGES, take, lambda: len(held[1]), give)

    return run


def _over(pages: DataFrame, ddl: str, run, page_id: str, html: str, context: str | None) -> DataFrame:
    given = F.lit(None).cast("string") if context is None else F.coalesce(F.col(context).cast("string"), F.lit(""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(html).cast("string").alias("html"), given.alias("context"))
    return rows.mapInArrow(run, ddl)


def _parser(options: Options, fail: bool) -> Callable:
    """In strict mode a page's first error ends it; it fails the job only if that is asked for."""

    def run(html: str, context):
        try:
            return parse(html, options, context)
        except HtmlError as e:
            if fail:
                raise
            return _EMPTY, 0, [(e.code, e.message, e.position, e.line, e.col)]

    return run


def parse_html(pages: DataFrame, options: Options = Options(), page_id: str = "page_id", html: str = "html", context: str | None = None, fail: bool = True) -> DataFrame:
    """The node table of whole documents, or, with `context` naming a column of context tags, of fragments.

    Each page has a document row (node 0), whose text is all text of the page, and a row for each node below it. A null html is an empty one. In strict mode the first error raises HtmlError; with fail=False such a page has only its document row, and
    its error is in parse_errors().
    """
    return _over(pages, NODES, _nodes(NODES, _parser(options, fail)), page_id, html, context)


def parse_errors(pages: DataFrame, options: Options = Options(), page_id: str = "page_id", html: str = "html", context: str | None = None) -> DataFrame:
    """The error table: the scanner's errors of a page come before those of its tree."""
    parsed = _parser(options, False)
    return _over(pages, ERRORS, _tuples(ERRORS, lambda h, c: [(i, *e) for i, e in enumerate(parsed(h, c)[2])]), page_id, html, context)


def parse_whole(pages: DataFrame, options: Options = Options(), page_id: str = "page_id", html: str = "html", context: str | None = None, fail: bool = True) -> DataFrame:
    """(page_id, nodes, errors): a row for each page with all that its parse gives."""
    return _over(pages, WHOLE, _wholes(WHOLE, _parser(options, fail)), page_id, html, context)


def token_rows(html: str, options: Options, context: str | None = None, state: str | None = None) -> list[tuple]:
    last, rows = "", []
    if context is not None:
        last = fold(context) or "div"
    scanner = Scanner(html.encode("utf-8", "replace"), options, state or FRAGMENT_TEXT.get(last, "data"), last)
    for i, (kind, name, value, attrs, _, quirks) in enumerate(scanner):
        rows.append((i, kind, name, value, () if kind in (TEXT, CLOSE, DOCTYPE) else attrs, "", "", quirks))
    return rows


def tokenize_html(pages: DataFrame, options: Options = Options(), page_id: str = "page_id", html: str = "html", context: str | None = None, state: str | None = None) -> DataFrame:
    """The token table. A context tag sets the state in which the tokens of a fragment are read; `state` sets it directly: data, raw, rcdata, script,
    plain or cdata."""
    return _over(pages, TOKENS, _tuples(TOKENS, lambda h, c: token_rows(h, options, c, state)), page_id, html, context)


def work_dir(spark) -> str:
    """The shared folder that spark.checkpoint.dir names. A temporary one is set only in local mode, where there is but one machine."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master or ""
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="domspark-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


class Parsed:
    """The tables of parsed pages. They are lazy, so each use of `nodes` parses again; staged() and save() parse once and write, so that
    a query that reads the nodes several times, or many queries, share the parse."""

    def __init__(self, nodes: DataFrame, errors: DataFrame, pages: DataFrame, whole: DataFrame | None = None):
        self.nodes, self.errors, self.pages, self._whole = nodes, errors, pages, whole

    @property
    def texts(self) -> DataFrame:
        return texts_of(self.nodes)

    @classmethod
    def of(cls, pages: DataFrame, options: Options = Options(), page_id: str = "page_id", html: str = "html", context: str | None = None, fail: bool = True) -> Parsed:
        own = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(html).alias("html"))
        given = (options, page_id, html, context)
        return cls(parse_html(pages, *given, fail), parse_errors(pages, *given), own, parse_whole(pages, *given, fail))

    def staged(self) -> Parsed:
        """The same with the node table written once to the shared work folder."""
        spark = self.nodes.sparkSession
        path = f"{work_dir(spark)}/nodes-{uuid.uuid4().hex}"
        self.nodes.write.parquet(path)
        return Parsed(spark.read.schema(self.nodes.schema).parquet(path), self.errors, self.pages)

    def save(self, path: str) -> Parsed:
        """Writes the tables below path. Parsing costs more than writing, so its rows are staged in path/whole and split from there."""
        spark = self.nodes.sparkSession
        tables = {"nodes": self.nodes, "errors": self.errors, "pages": self.pages}
        if self._whole is not None:
            self._whole.write.mode("overwrite").parquet(f"{path}/whole")
            whole = spark.read.parquet(f"{path}/whole")
            tables |= {"nodes": whole.select("page_id", F.inline("nodes")), "errors": whole.select("page_id", F.inline("errors"))}
        for name, table in tables.items():
            table.write.mode("overwrite").parquet(f"{path}/{name}")
        return Parsed.load(spark, path)

    @classmethod
    def load(cls, spark, path: str) -> Parsed:
        return cls(*(spark.read.parquet(f"{path}/{n}") for n in ("nodes", "errors", "pages")))

    def persist(self) -> Parsed:
        self.nodes.persist()
        return self


def register_parse_html(spark, name: str = "parse_html") -> None:
    """parse_html(html) as a table function for SQL: a row for each node, without page_id."""
    from pyspark.sql.functions import udtf

    kinds = NODES.replace("page_id long, ", "")

    class ParseHtml:
        def eval(self, html: str):
            yield from node_rows(*parse(html or "", Options())[:2])[0]

    spark.udtf.register(name, udtf(ParseHtml, returnType=kinds))


def version() -> str:
    return "0.1.0"
