"""The registered queries over `pages`, and the SQL that gives the same rows.

The pages of the test tables come from one template, so plain string functions can say what the engine must find in them; queries on fixtures
of markup that those pages lack are held against the rows that are stated here.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from domspark.functions import encoding, nodes as N, text as X, tokens as K
from domspark.operators import document as D
from domspark.operators.nodeset import Document, NodeSet
from domspark.options import Options
from domspark.plans.selectors import classify_simple_selector, is_valid_selector, normalize_selector, parse_selector, parse_selectors
from domspark.sources.files import parse_file
from domspark.sources.html import Parsed, parse_errors, parse_html, tokenize_html, work_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages, dealt out over all cores where the files have fewer splits: parsing costs far more than moving a small table."""
    df, cores = spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def parsed(spark: SparkSession, sf_dir: str, options: Options = Options()) -> Parsed:
    return Parsed.of(pages(spark, sf_dir), options)


def document(spark: SparkSession, sf_dir: str) -> Document:
    """The pages, parsed once: a selection reads the node table more than once."""
    return Document(parsed(spark, sf_dir).staged().nodes)


def edited(spark: SparkSession, sf_dir: str, old: str, new: str) -> DataFrame:
    """The pages with a piece of their markup replaced: the tables lack ids, images and most metadata. `@` in `new` stands for the page's id."""
    put = F.concat_ws("", *[x for k, part in enumerate(new.split("@")) for x in ([F.col("page_id").cast("string")] if k else []) + [F.lit(part)]])
    return pages(spark, sf_dir).withColumn("html", F.replace(F.col("html"), F.lit(old), put))


def query(sql: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


TAG, PLACE, TEXT, HREF = "tag_lc", "concat(tag_lc, elem_pos)", "own_text", "get(filter(attrs, a -> a.name = 'href'), 0).value"


def _elements(name: str, select: Callable[[Document], NodeSet], shown: str, sql: str) -> None:
    """A query for the elements of each page in the order of the set, each shown by a column expression, and an SQL expression over html for the same list."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = NodeSet.collected(select(document(spark, sf_dir)).map(lambda rows: F.expr(shown)))
        return found.select("page_id", F.size("values").cast("long").alias("n"), F.array_join("values", " ").alias("elements"))

    QUERIES[name] = run
    SQL[name] = f"SELECT page_id, CAST(len(e) AS BIGINT) AS n, array_to_string(e, ' ') AS elements FROM (SELECT page_id, {sql} AS e FROM pages) WHERE len(e) > 0"


def _found(pattern: str) -> str:
    return f"len(regexp_extract_all(html, '{pattern}'))"


def _all(pattern: str) -> str:
    return f"regexp_extract_all(html, '{pattern}', 1)"


def _numbered(tag: str, first: str, last: str, step: int = 1) -> str:
    """The tags with the places from first to last, which may be SQL."""
    return f"list_transform(range({first}, {last} {'+' if step > 0 else '-'} 1, {step}), lambda i: '{tag}' || i)"


LI, P, B, TAGS = _found("<li>"), _found("<p>"), _found("<b>"), _found("<[a-z][a-z0-9]*[ >]")
ARTICLE = "regexp_extract(html, '<article>([\\s\\S]*?)(</article>|$)', 1)"
TOP_P = f"(len(regexp_extract_all(split_part({ARTICLE}, '<p><b>', 1), '<p>')) + CASE WHEN contains({ARTICLE}, '<p><b>') THEN 1 ELSE 0 END)"
LINKS = _all('<a href="[^"]*">([^<]*)</a>')
HREFS = _all('<a href="([^"]*)"')
ALL_LI, LATER_LI = _numbered("li", "1", LI), _numbered("li", "2", LI)
FIRST_P = f"CASE WHEN regexp_matches({ARTICLE}, '</h1><p>') THEN ['p2'] ELSE [] END"
ONE_B = f"list_transform(range({B}), lambda i: 'b')"

# ---- selectors, by kind ----
for _name, _selector, _shown, _sql in (
    ("css_universal", "*", TAG, _all("<([a-z][a-z0-9]*)[ >]")),
    ("css_type", "LI", PLACE, ALL_LI),
    ("css_class", ".ad", TAG, "['div']"),
    ("css_compound", "div.ad", TEXT, "[regexp_extract(html, '<div class=\"ad\">([^<]*)', 1)]"),
    ("css_attr_exists", "[href]", HREF, HREFS),
    ("css_attr_equals", "[class='ad']", PLACE, "['div2']"),
    ("css_attr_prefix", "a[href^='/th']", HREF, _all('href="(/th[^"]*)"')),
    ("css_attr_suffix", "a[href$='e']", HREF, _all('href="([^"]*e)"')),
    ("css_attr_contains", "a[href*='an']", HREF, _all('href="([^"]*an[^"]*)"')),
    ("css_attr_word", "[class~='ad']", TAG, "['div']"),
    ("css_attr_lang", "[lang|='en']", TAG, """CASE WHEN contains(html, 'html lang="en"') THEN ['html'] ELSE [] END"""),
    ("css_list", "li, b, footer", TAG, _all("<(li|b|footer)>")),
    ("css_descendant", "nav li a", TEXT, LINKS),
    ("css_child", "article > p", PLACE, _numbered("p", "2", f"{TOP_P} + 1")),
    ("css_adjacent", "li + li", PLACE, LATER_LI),
    ("css_sibling", "nav ~ article, h1 ~ p:first-of-type", PLACE, f"list_concat(['article3'], {FIRST_P})"),
    ("css_long", "html > body nav ul > li:not(:first-child) > a[href]", TEXT, f"{LINKS}[2:]"),
    ("css_first_child", "li:first-child", PLACE, "['li1']"),
    ("css_last_child", "li:last-child", PLACE, f"['li' || {LI}]"),
    ("css_nth_child", "li:nth-child(2n+1)", PLACE, _numbered("li", "1", LI, 2)),
    ("css_nth_child_number", "li:nth-child(2)", PLACE, "['li2']"),
    ("css_nth_last_child", "li:nth-last-child(-n+3)", PLACE, _numbered("li", f"{LI} - 2", LI)),
    ("css_nth_of_type", "ul > li:nth-of-type(even)", PLACE, _numbered("li", "2", LI, 2)),
    ("css_nth_last_of_type", "li:nth-last-of-type(2)", PLACE, f"['li' || ({LI} - 1)]"),
    ("css_first_of_type", "article > p:first-of-type", PLACE, FIRST_P),
    ("css_last_of_type", "article > p:last-of-type", PLACE, f"CASE WHEN {TOP_P} > 0 THEN ['p' || ({TOP_P} + 1)] ELSE [] END"),
    ("css_only_child", "li > a:only-child", TEXT, LINKS),
    ("css_only_of_type", "body > nav:only-of-type", PLACE, "['nav1']"),
    ("css_empty", "meta:empty", PLACE, "['meta1']"),
    ("css_root", ":root", TAG, "['html']"),
    ("css_not", "li:not(:nth-child(1))", PLACE, LATER_LI),
    ("css_is", ":is(h1, .ad)", PLACE, "['div2', 'h11']"),
    ("css_where", "ul :where(li, a)", TAG, _all("<(li|a)[ >]")),
    ("css_has", "p:has(br)", TAG, f"list_transform(range({B}), lambda i: 'p')"),
    ("css_has_child", "ul:has(> li), p:has(> b)", TAG, f"list_concat(['ul'], list_transform(range({B}), lambda i: 'p'))"),
    ("css_has_adjacent", "li:has(+ li)", PLACE, _numbered("li", "1", f"{LI} - 1")),
    ("css_has_sibling", "li:has(~ li:last-child)", PLACE, _numbered("li", "1", f"{LI} - 1")),
    ("css_link", "a:link", HREF, HREFS),
    ("css_pseudo_element", "li::before, h1::first-line", TAG, _all("<(li|h1)>")),
):
    _elements(_name, lambda d, s=_selector: d.css(s), _shown, _sql)

# ---- node sets ----
for _name, _make, _shown, _sql in (
    ("ns_has_attribute", lambda d: d.css("*").has_attribute("href"), HREF, HREFS),
    ("ns_has_attribute_value", lambda d: d.css("*").has_attribute("class", "ad"), TAG, "['div']"),
    ("ns_has_attribute_contains", lambda d: d.css("a").has_attribute_contains("href", "an"), HREF, _all('href="([^"]*an[^"]*)"')),
    ("ns_has_class", lambda d: d.css("div").has_class("ad"), PLACE, "['div2']"),
    ("ns_has_tag", lambda d: d.css("nav *").has_tag("A"), TEXT, LINKS),
    ("ns_has_text", lambda d: d.css("style").has_text("p{margin:0}"), TAG, "['style']"),
    ("ns_containing_text", lambda d: d.css("a").containing_text("an"), TEXT, _all('<a href="[^"]*">([^<]*an[^<]*)</a>')),
    ("ns_matching_text", lambda d: d.css("a").matching_text(lambda t: t.rlike("^[A-Z]")), TEXT, _all('<a href="[^"]*">([A-Z][^<]*)</a>')),
    ("ns_filter", lambda d: d.css("li").filter(F.col("elem_rpos") > 1), PLACE, _numbered("li", "1", f"{LI} - 1")),
    ("ns_not", lambda d: d.css("li").not_("li:first-child"), PLACE, LATER_LI),
    ("ns_slice", lambda d: d.css("li").slice(1, 3), PLACE, "['li2', 'li3']"),
    ("ns_first", lambda d: d.css("li").first(3), PLACE, "['li1', 'li2', 'li3']"),
    ("ns_last", lambda d: d.css("a").last(2), TEXT, f"{LINKS}[-2:]"),
    ("ns_skip", lambda d: d.css("a").skip(2), TEXT, f"{LINKS}[3:]"),
    ("ns_even", lambda d: d.css("li").even(), PLACE, _numbered("li", "1", LI, 2)),
    ("ns_odd", lambda d: d.css("li").odd(), PLACE, _numbered("li", "2", LI, 2)),
    ("ns_gt_lt", lambda d: d.css("li").gt(0).lt(2), PLACE, "['li2', 'li3']"),
    ("ns_children", lambda d: d.css("ul").children(), PLACE, ALL_LI),
    ("ns_children_matching", lambda d: d.css("ul").children("li:last-child"), PLACE, f"['li' || {LI}]"),
    ("ns_parent", lambda d: d.css("a").parent(), PLACE, ALL_LI),
    ("ns_parents", lambda d: d.css("ul > li").parents(), TAG, "['ul', 'nav', 'body', 'html']"),
    ("ns_closest", lambda d: d.css("a, li").closest("li"), PLACE, ALL_LI),
    ("ns_next_sibling", lambda d: d.css("li").next_sibling(), PLACE, LATER_LI),
    ("ns_prev_sibling", lambda d: d.css("li:last-child").prev_sibling(), PLACE, f"['li' || ({LI} - 1)]"),
    ("ns_next_siblings", lambda d: d.css("li:first-child").next_siblings(), PLACE, LATER_LI),
    ("ns_prev_siblings", lambda d: d.css("li:last-child").prev_siblings(), PLACE, _numbered("li", f"{LI} - 1", "1", -1)),
    ("ns_siblings", lambda d: d.css("li:nth-child(2)").siblings(), PLACE, f"list_concat(['li1'], {_numbered('li', '3', LI)})"),
    ("ns_find", lambda d: d.css("nav, ul").find("a"), TEXT, LINKS),
    ("ns_find_by_tag", lambda d: d.css("ul").get_elements_by_tag_name("A"), TEXT, LINKS),
    ("ns_find_by_class", lambda d: d.css("body, nav").get_elements_by_class_name("ad"), PLACE, "['div2']"),
    ("ns_find_first", lambda d: d.css("ul, li:last-child").css_first("a"), TEXT, f"[{LINKS}[1], {LINKS}[-1]]"),
    ("ns_by_tag", lambda d: d.get_elements_by_tag_name("LI"), PLACE, ALL_LI),
    ("ns_by_class", lambda d: d.get_elements_by_class_name("ad"), TEXT, "[regexp_extract(html, '<div class=\"ad\">([^<]*)', 1)]"),
    ("ns_css_first", lambda d: d.css_first("a"), TEXT, f"{LINKS}[1:1]"),
    ("ns_at", lambda d: d.css("a").at(3), TEXT, f"{LINKS}[4:4]"),
    ("ns_first_element", lambda d: d.css("li").first_element(), PLACE, "['li1']"),
    ("ns_last_element", lambda d: d.css("li").last_element(), PLACE, f"['li' || {LI}]"),
    ("ns_chain", lambda d: d.css("nav").find("li").not_(":first-child").has_tag("li").children("a").closest("ul").parent(), PLACE, "['nav1']"),
):
    _elements(_name, _make, _shown, _sql)


def _ids(d: Document, how: str) -> NodeSet:
    return {"alone": lambda: d.css("#item"), "within": lambda: d.css("ul #item"), "lookup": lambda: d.get_element_by_id("item"), "below": lambda: d.css("nav").get_element_by_id("item")}[how]()


for _how, _sql in (("alone", "['li1']"), ("within", ALL_LI), ("lookup", "['li1']"), ("below", "['li1']")):
    # Every list item has the id `item`: alone it gives the first, within a larger selector all.
    def _run(spark: SparkSession, sf_dir: str, how: str = _how) -> DataFrame:
        d = Document(Parsed.of(edited(spark, sf_dir, "<li>", "<li id='item'>")).staged().nodes)
        found = NodeSet.collected(_ids(d, how).map(lambda rows: F.concat("tag_lc", "elem_pos")))
        return found.select("page_id", F.array_join("values", " ").alias("elements"))

    QUERIES[f"id_{_how}"] = _run
    SQL[f"id_{_how}"] = f"SELECT page_id, array_to_string({_sql}, ' ') AS elements FROM pages"


# ---- tables ----
@query(
    f"""SELECT page_id, CAST({TAGS} AS BIGINT) AS n_elements, CAST({_found("<!--")} AS BIGINT) AS n_comments,
        CAST({_found(">[^<]+")} - 1 AS BIGINT) AS n_texts FROM pages"""
)
def parse_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda kind: F.count(F.when(F.col("node_type") == kind, 1))
    return parsed(spark, sf_dir).nodes.where(~N.is_document()).groupBy("page_id").agg(n("element").alias("n_elements"), n("comment").alias("n_comments"), n("text").alias("n_texts"))


@query(
    f"""WITH t AS (SELECT {TAGS} AS tags, {_found("<(meta|br)[ >]")} AS void, {_found("</[a-z0-9]+>")} - 1 AS ends, {_found("<!--")} AS comments, {_found(">[^<]+")} - 1 AS texts FROM pages)
    SELECT 'open' AS type, CAST(sum(tags - void) AS BIGINT) AS n FROM t UNION ALL SELECT 'close_self', CAST(sum(void) AS BIGINT) FROM t UNION ALL SELECT 'close', CAST(sum(ends) AS BIGINT) FROM t
    UNION ALL SELECT 'comment', CAST(sum(comments) AS BIGINT) FROM t UNION ALL SELECT 'text', CAST(sum(texts) AS BIGINT) FROM t UNION ALL SELECT 'doctype', count(*) FROM t"""
)
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize_html(pages(spark, sf_dir)).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT page_id, CAST({LI} * 2 AS BIGINT) AS li_tags, CAST({_found('<(meta|br)[ >]')} AS BIGINT) AS closed_selves, CAST(1 AS BIGINT) AS doctypes, CAST(0 AS BIGINT) AS quirks FROM pages")
def token_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda c: F.count(F.when(c, 1))
    found = (n(K.is_tag("LI")).alias("li_tags"), n(K.is_close_self()).alias("closed_selves"), n(K.is_doctype()).alias("doctypes"), n(K.is_force_quirks()).alias("quirks"))
    return tokenize_html(pages(spark, sf_dir)).groupBy("page_id").agg(*found)


@query("SELECT tag, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)[ >]', 1)) AS tag FROM pages) GROUP BY tag")
def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(spark, sf_dir).nodes.where(N.is_element()).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT page_id, sha256(replace(regexp_replace(replace(replace(html, '<title>' || raw || '</title>', '<title>' || t || '</title>'), '"</p>"', '"' || chr(1) || '/p>"'), '<[^>]*>', '', 'g'), chr(1), '<')) AS text_sha256
    FROM (SELECT *, replace(replace(replace(replace(raw, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&') AS t FROM (SELECT page_id, html, regexp_extract(html, '<title>([\\s\\S]*?)</title>', 1) AS raw FROM pages))"""
)
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of a title is decoded, other text isn't."""
    return parsed(spark, sf_dir).texts.select("page_id", F.sha2("page_text", 256).alias("text_sha256"))


@query(
    """SELECT page_id, replace(replace(replace(replace(regexp_extract(html, '<title>([\\s\\S]*?)</title>', 1), '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&') AS title FROM pages"""
)
def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parsed(spark, sf_dir)
    return D.title(p.nodes, p.pages)


@query("SELECT page_id, regexp_extract(html, '<meta charset=\"([^\"]*)\"', 1) AS charset FROM pages")
def charsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parsed(spark, sf_dir)
    return D.charset(p.pages, p.nodes)


@query("SELECT page_id, 'author ' || page_id AS content FROM pages")
def meta_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Parsed.of(edited(spark, sf_dir, "</head>", "<meta name=' Author' content='author @'></head>"))
    return D.get_meta_content(p.pages, p.nodes, "author")


@query("SELECT page_id, 'title ' || page_id AS content FROM pages")
def meta_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Parsed.of(edited(spark, sf_dir, "</head>", "<meta property=og:title content='title @'></head>"))
    return D.get_meta_property(p.pages, p.nodes, "og:title")


@query("SELECT page_id, CAST(unnest(range(len(h))) AS INT) AS pos, unnest(h) AS value FROM (SELECT page_id, regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1) AS h FROM pages)")
def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document(spark, sf_dir).css("a[href]").extract_attributes("href")


@query("SELECT unnest(h) AS value, page_id FROM (SELECT page_id, regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1) AS h FROM pages)")
def all_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.get_all_links(parsed(spark, sf_dir).nodes).select("page_id", "value")


@query("SELECT page_id, '/' || page_id || '.png' AS value FROM (SELECT page_id, unnest(regexp_extract_all(html, '<br>')) FROM pages)")
def all_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.get_all_images(Parsed.of(edited(spark, sf_dir, "<br>", "<img src=/@.png>")).nodes).select("page_id", "value")


@query("SELECT page_id, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang, 'html' AS tag FROM pages")
def roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.root(parsed(spark, sf_dir).nodes).select("page_id", N.get_attribute("LANG").alias("lang"), "tag")


@query("SELECT page_id, 'html' AS tag, 'http://www.w3.org/1999/xhtml' AS uri FROM pages")
def html_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.html(parsed(spark, sf_dir).nodes).select("page_id", N.tag_name().alias("tag"), N.namespace_uri().alias("uri"))


@query("SELECT page_id, html AS source_html FROM pages")
def source_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.source_html(parsed(spark, sf_dir).pages)


@query("SELECT page_id, array_to_string(regexp_extract_all(html, '<a href=\"[^\"]*\">([^<]*)</a>', 1), '|') AS texts FROM pages")
def extract_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = NodeSet.collected(document(spark, sf_dir).css("nav a").extract_texts())
    return found.select("page_id", F.array_join("values", "|").alias("texts"))


@query("SELECT page_id, regexp_extract(html, '<h1>([\\s\\S]*?)</h1>', 1) AS heading FROM pages")
def extract_own_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document(spark, sf_dir).css("h1").extract_own_texts().select("page_id", F.col("value").alias("heading"))


@query("SELECT page_id, CAST(octet_length(encode(unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)))) AS INT) AS size FROM pages")
def map_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document(spark, sf_dir).css("a").map(lambda r: F.octet_length(N.get_attribute("href")), "size").select("page_id", "size")


@query("SELECT page_id, contains(html, '<br>') AS matches FROM pages")
def is_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document(spark, sf_dir).css("article *").is_("br")


@query("SELECT page_id, contains(regexp_extract(html, '<h1>([\\s\\S]*?)</h1>', 1), 'an') AS contains FROM pages")
def contains_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document(spark, sf_dir).css("h1").contains("an")


@query("SELECT page_id, NOT contains(html, '<footer>') AS empty FROM pages")
def is_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document(spark, sf_dir).css("footer").empty()


@query("SELECT page_id, len(regexp_extract_all(html, '<b>')) AS size FROM pages")
def set_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document(spark, sf_dir).css("b").size()


@query("SELECT page_id, true AS contains FROM pages")
def contains_element(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = document(spark, sf_dir)
    return d.css("li").contains(d.css("ul > :last-child"))


@query("SELECT page_id, 'document' AS kind, 'html' AS top, CAST(0 AS INT) AS node_id FROM pages")
def documents_and_tops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document node of each page and its only child."""
    n = parsed(spark, sf_dir).staged().nodes
    top = N.children(n, N.as_document(n)).select("page_id", F.col("tag").alias("top"))
    return N.as_document(n).select("page_id", F.col("node_type").alias("kind"), "node_id").join(top, "page_id")


@query("SELECT page_id, 'body' AS tag FROM pages")
def node_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parent of the comment."""
    n = parsed(spark, sf_dir).staged().nodes
    return N.parents(n, n.where(N.is_comment())).select("page_id", "tag")


@query("SELECT page_id, CASE WHEN contains(html, '<footer>') THEN '#comment article div footer nav' ELSE '#comment article div nav' END AS tags FROM pages")
def node_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The children of the body, of any kind but text."""
    n = parsed(spark, sf_dir).staged().nodes
    kids = N.children(n, n.where("tag = 'body'")).where(~N.is_text()).select("page_id", F.coalesce("tag", F.lit("#comment")).alias("t"))
    return kids.groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_list("t")), " ").alias("tags"))


@query("SELECT page_id, CASE WHEN contains(html, '<footer>') THEN 'article div footer nav' ELSE 'article div nav' END AS tags FROM pages")
def node_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The siblings of the comment."""
    n = parsed(spark, sf_dir).staged().nodes
    kids = N.siblings(n, n.where(N.is_comment())).where(~N.is_text()).select("page_id", "tag")
    return kids.groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_list("tag")), " ").alias("tags"))


@query("SELECT page_id, 'x' || page_id AS id, 'ad b' AS class_name, 'ad' AS first_class, true AS ordered FROM pages")
def ids_and_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Parsed.of(edited(spark, sf_dir, '<div class="ad">', "<div id='x@' class='ad b'>")).nodes.where("tag = 'div'")
    first, second = F.get("attrs", F.lit(0)), F.get("attrs", F.lit(1))
    return d.select("page_id", N.element_id().alias("id"), N.class_name().alias("class_name"), F.get(N.class_names(), F.lit(0)).alias("first_class"), N.attribute_less(second, first).alias("ordered"))


@query("SELECT page_id, trim(regexp_extract(html, '<!--([\\s\\S]*?)-->', 1)) AS comment, CAST(octet_length(encode(regexp_extract(html, '<!--([\\s\\S]*?)-->', 1))) AS INT) AS size FROM pages")
def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.as_comment(parsed(spark, sf_dir).nodes).select("page_id", N.text_trim().alias("comment"), N.text_length().alias("size"))


@query("SELECT page_id, 'html' AS parent, 'head' AS first, 'body' AS last FROM pages")
def first_and_last_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = parsed(spark, sf_dir).staged().nodes.select("page_id", "parent_id", "node_id", "tag")
    ends = N.end_children(n).join(n.where("tag = 'html'").select("page_id", "node_id", F.col("tag").alias("parent")), ["page_id", "node_id"])
    one = lambda c, to: n.select("page_id", F.col("node_id").alias(c), F.col("tag").alias(to))
    return ends.join(one("first_child_id", "first"), ["page_id", "first_child_id"]).join(one("last_child_id", "last"), ["page_id", "last_child_id"]).select("page_id", "parent", "first", "last")


@query("SELECT page_id, 'ul' AS before_comment, 'div' AS after_comment FROM pages")
def node_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comment lies between the nav element, whose only child is ul, and the div."""
    n = parsed(spark, sf_dir).staged().nodes
    c = N.with_siblings(n).where(N.is_comment()).select("page_id", "prev_sibling_id", "next_sibling_id")
    child = n.select("page_id", F.col("parent_id").alias("prev_sibling_id"), F.col("tag").alias("before_comment")).where("before_comment = 'ul'")
    return c.join(child, ["page_id", "prev_sibling_id"]).join(n.select("page_id", F.col("node_id").alias("next_sibling_id"), F.col("tag").alias("after_comment")), ["page_id", "next_sibling_id"]).select("page_id", "before_comment", "after_comment")


@query("SELECT page_id, 'class=\"ad\"' AS spelled, CAST(1 AS INT) AS n, 'ad' AS class FROM pages")
def attribute_accessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = parsed(spark, sf_dir).nodes.where("tag = 'div'")
    return d.select("page_id", F.array_join(F.transform("attrs", N.attribute_to_string), " ").alias("spelled"), N.attribute_count().alias("n"), F.array_join(N.class_names(), " ").alias("class"))


# ---- options ----
@query(f"SELECT page_id, CAST({TAGS} AS BIGINT) AS n FROM pages")
def parse_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without text and comment nodes."""
    return parse_html(pages(spark, sf_dir), Options.performance()).where(~N.is_document()).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT page_id, replace(replace(replace(replace(regexp_extract(html, '<h1>([\\s\\S]*?)</h1>', 1), '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&') AS heading FROM pages")
def parse_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_html(pages(spark, sf_dir), Options(decode_entities=True)).where("tag = 'h1'").select("page_id", F.col("own_text").alias("heading"))


@query("SELECT page_id, regexp_replace(regexp_extract(html, '<footer>([\\s\\S]*?)(</footer>|$)', 1), '[ \\t\\n\\r\\f]+', ' ', 'g') AS footer FROM pages WHERE contains(html, '<footer>')")
def parse_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_html(pages(spark, sf_dir), Options(whitespace_mode="normalize")).where("tag = 'footer'").select("page_id", F.col("own_text").alias("footer"))


# ---- strings and encodings ----
@query("SELECT page_id, replace(replace(replace(replace(html, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&') AS decoded FROM pages")
def decode_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", X.decode_html_entities(F.col("html")).alias("decoded"))


@query(
    """SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered, regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g') AS collapsed,
    trim(text, ' ' || chr(9) || chr(10) || chr(12) || chr(13)) AS trimmed FROM documents"""
)
def string_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", X.to_lower(c).alias("lowered"), X.normalize_whitespace(c).alias("collapsed"), X.trim_whitespace(c).alias("trimmed"))


@query("SELECT page_id, 'utf-8' AS detected, 'utf-8' AS canonical, 'meta_charset' AS source, true AS supported, html AS text FROM pages")
def encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pages(spark, sf_dir).select("page_id", F.encode("html", "UTF-8").alias("content")).withColumn("h", encoding.encoding_hint("content"))
    return rows.select("page_id", F.col("h.detected_label").alias("detected"), F.col("h.canonical_label").alias("canonical"), F.col("h.source").alias("source"), F.col("h.helper_supported").alias("supported"), encoding.decoded("content", "h.canonical_label").alias("text"))


@query("SELECT page_id, html AS text FROM pages")
def decode_utf16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", encoding.decoded(F.encode("html", "UTF-16LE"), F.lit("utf-16")).alias("text"))


# ---- fixtures ----
def _fixture(name: str, rows: list[tuple[int, str]], make: Callable[[DataFrame], DataFrame], columns: str, want: list[tuple]) -> None:
    """Markup that the pages don't hold; `want` states the rows."""
    QUERIES[name] = lambda spark, sf_dir: make(spark.createDataFrame(rows, "page_id long, html string"))
    spell = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    SQL[name] = f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(spell, w)) + ')' for w in want)}) AS t({columns})"


def _outline(options: Options = Options()) -> Callable[[DataFrame], DataFrame]:
    """(page_id, path): the tags from the root of each element and text below body."""

    def make(df: DataFrame) -> DataFrame:
        n = parse_html(df, options)
        own = n.select("page_id", "node_id", "tag")
        up = n.where("depth > 2").select("page_id", F.col("node_id").alias("at"), F.coalesce("tag", F.concat(F.lit("'"), "text", F.lit("'"))).alias("leaf"), F.posexplode(F.reverse("ancestors")).alias("k", "node_id"))
        lines = up.join(own, ["page_id", "node_id"]).where("k > 1").groupBy("page_id", "at").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "tag"))), lambda x: x["tag"]), ">").alias("above"))
        ends = n.where("depth > 2 AND node_type <> 'comment'").select("page_id", F.col("node_id").alias("at"), F.coalesce("tag", F.concat(F.lit("'"), "text", F.lit("'"))).alias("leaf"))
        return ends.join(lines, ["page_id", "at"], "left").select("page_id", F.concat_ws(">", "above", "leaf").alias("path"))

    return make


_fixture(
    "fixture_tables",
    [(1, "<body><table><td>a<td>b</table>"), (2, "<body><table>loose<th>kept</table>"), (3, "<body><table><col><tbody><tr><th>h</table>")],
    _outline(),
    "page_id, path",
    [(1, p) for p in ("table", "table>tbody", "table>tbody>tr", "table>tbody>tr>td", "table>tbody>tr>td>'a'", "table>tbody>tr>td", "table>tbody>tr>td>'b'")]
    + [(2, p) for p in ("'loose'", "table", "table>tbody", "table>tbody>tr", "table>tbody>tr>th", "table>tbody>tr>th>'kept'")]
    + [(3, p) for p in ("table", "table>colgroup", "table>colgroup>col", "table>tbody", "table>tbody>tr", "table>tbody>tr>th", "table>tbody>tr>th>'h'")],
)
_fixture(
    "fixture_formatting",
    [(1, "<body><p><b><i>x</b>y</i>z"), (2, "<body><a href=/n>north<a href=/s>south</a>"), (3, "<body><select><optgroup><option>a<optgroup><option>b</select>")],
    _outline(),
    "page_id, path",
    [(1, p) for p in ("p", "p>b", "p>b>i", "p>b>i>'x'", "p>i", "p>i>'y'", "p>'z'")]
    + [(2, p) for p in ("a", "a>'north'", "a", "a>'south'")]
    + [(3, p) for p in ("select", "select>optgroup", "select>optgroup>option", "select>optgroup>option>'a'", "select>optgroup", "select>optgroup>option", "select>optgroup>option>'b'")],
)
_fixture(
    "fixture_errors",
    [(1, "</div"), (2, "<div a=></div>"), (3, "<br/ >"), (4, "<!DOCTYPE html"), (5, "<p>x</b>"), (6, "<form><form>"), (7, "é<!-- c")],
    lambda df: parse_errors(df).select("page_id", "err_seq", "code", "position", "line", "col"),
    "page_id, err_seq, code, position, line, col",
    [(1, 0, "UnexpectedEOF", 5, 1, 6), (2, 0, "InvalidToken", 7, 1, 8), (3, 0, "InvalidToken", 4, 1, 5), (4, 0, "UnexpectedEOF", 14, 1, 15), (5, 0, "MismatchedTag", 0, 1, 1), (6, 0, "InvalidNesting", 12, 1, 13), (6, 1, "UnclosedTag", 12, 1, 13), (7, 0, "UnexpectedEOF", 8, 1, 9)],
)
_fixture(
    "fixture_form_states",
    [(1, "<input type=CHECKBOX checked><input type=text disabled><select><option selected>x<option>y</select><button>b</button>")],
    lambda df: _states(df),
    "selector, n",
    [(":checked", 2), (":disabled", 1), (":enabled", 5), ("option:first-child:checked", 1), ("#none", 0)],
)
_fixture(
    "fixture_fragments",
    [(1, "<td>a<td>b"), (2, "x<li>y")],
    lambda df: parse_html(df.withColumn("ctx", F.when(F.col("page_id") == 1, "tr").otherwise("ul")), context="ctx").where(~N.is_document()).select("page_id", F.coalesce("tag", "text").alias("what"), "depth"),
    "page_id, what, depth",
    [(1, "td", 1), (1, "a", 2), (1, "td", 1), (1, "b", 2), (2, "x", 1), (2, "li", 1), (2, "y", 2)],
)
_fixture(
    "fixture_namespaces",
    [(1, "<body><svg viewBox='0'><g/></svg><math><mi>y</mi></math><p>z")],
    lambda df: parse_html(df).where("depth > 2 AND tag IS NOT NULL").select("tag", "ns", N.namespace_uri().alias("uri")),
    "tag, ns, uri",
    [("svg", "svg", "http://www.w3.org/2000/svg"), ("math", "mathml", "http://www.w3.org/1998/Math/MathML"), ("mi", "mathml", "http://www.w3.org/1998/Math/MathML"), ("p", "html", "http://www.w3.org/1999/xhtml")],
)


def _states(df: DataFrame) -> DataFrame:
    d = Document(parse_html(df))
    out = None
    for s in (":checked", ":disabled", ":enabled", "option:first-child:checked", "#none"):
        n = d.css(s)._rows.agg(F.count(F.lit(1)).cast("int").alias("n")).select(F.lit(s).alias("selector"), "n")
        out = n if out is None else out.union(n)
    return out


def _tool(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for s in ("div>span#a.b", "a:is(#x, .y) , p", "ul  li[ A = 'b' ]", "a:unknown", "#id"):
        found = parse_selector(s, on_error="lenient")
        simple = classify_simple_selector(s)
        rows.append((s, str(found), is_valid_selector(s), normalize_selector(s), *found.specificity, simple[0] if simple else ""))
    return spark.createDataFrame(rows, "selector string, spelled string, valid boolean, normalized string, inline int, ids int, classes int, elements int, simple string")


QUERIES["selector_tools"] = _tool
SQL["selector_tools"] = """SELECT * FROM (VALUES
    ('div>span#a.b', 'div > span#a.b', true, 'div>span#a.b', 0, 1, 1, 2, ''),
    ('a:is(#x, .y) , p', 'a:is(#x, .y), p', true, 'a:is(#x, .y) , p', 0, 1, 0, 1, ''),
    ('ul  li[ A = ''b'' ]', 'ul li[a="b"]', true, 'ul li[ a = ''b'' ]', 0, 0, 1, 2, ''),
    ('a:unknown', 'a', false, 'a:unknown', 0, 0, 0, 1, ''),
    ('#id', '#id', true, '#id', 0, 1, 0, 0, 'id')) AS t(selector, spelled, valid, normalized, inline, ids, classes, elements, simple)"""

_fixture(
    "fixture_tokens",
    [(1, "<script>a</p></SCRIPT >b"), (2, "<title>x&lt;y</title>"), (3, "<![CDATA[a<b]]>c"), (4, "<style>p</styleX></style>"), (5, "<plaintext>a</b>"), (6, "<svg><g/></svg>"), (7, "<?x?>1 < 2<!DOCTYPE Html><!foo-->"), (8, "<a B=c d e='f'g/>")],
    lambda df: tokenize_html(df).select("page_id", "token_seq", "type", "name", "value", F.array_join(F.transform("attrs", N.attribute_to_string), " ").alias("attrs")),
    "page_id, token_seq, type, name, value, attrs",
    [(1, 0, "open", "script", "", ""), (1, 1, "text", "", "a</p>", ""), (1, 2, "close", "script", "", ""), (1, 3, "text", "", "b", "")]
    + [(2, 0, "open", "title", "", ""), (2, 1, "text", "", "x<y", ""), (2, 2, "close", "title", "", "")]
    + [(3, 0, "text", "", "a<b", ""), (3, 1, "text", "", "c", "")]
    + [(4, 0, "open", "style", "", ""), (4, 1, "text", "", "p</styleX>", ""), (4, 2, "close", "style", "", "")]
    + [(5, 0, "open", "plaintext", "", ""), (5, 1, "text", "", "a</b>", "")]
    + [(6, 0, "open", "svg", "", ""), (6, 1, "text", "", "<g/>", ""), (6, 2, "close", "svg", "", "")]
    + [(7, 0, "text", "", "1 ", ""), (7, 1, "text", "", "<", ""), (7, 2, "text", "", " 2", ""), (7, 3, "doctype", "html", "", ""), (7, 4, "comment", "", "foo", "")]
    + [(8, 0, "close_self", "a", "", 'b="c" d e="f" g')],
)


def _codes(*cases: tuple[str, Options]) -> Callable[[DataFrame], DataFrame]:
    def make(df: DataFrame) -> DataFrame:
        out = None
        for name, options in cases:
            got = parse_errors(df.where(F.col("page_id") == int(name)), options).select("page_id", "err_seq", "code")
            out = got if out is None else out.union(got)
        return out

    return make


_fixture(
    "fixture_limits",
    [(1, "<ul><li><u>k</u></li></ul>"), (2, "<br a b c>"), (3, "<br abc=1>"), (4, "<br a=xyz>"), (5, "<p>abc</p>"), (6, "<a></a><b></b>"), (7, "x"), (8, "<p></b><i>")],
    _codes(
        ("1", Options(max_depth=2)), ("2", Options(max_attributes=2)), ("3", Options(max_attribute_name_length=2)), ("4", Options(max_attribute_value_length=2)),
        ("5", Options(max_text_length=2)), ("6", Options(max_tokens=3)), ("7", Options(max_tokens=0)), ("8", Options.strict()),
    ),
    "page_id, err_seq, code",
    [(1, 0, "TooDeep"), (2, 0, "TooManyAttributes"), (3, 0, "AttributeTooLong"), (4, 0, "AttributeTooLong"), (5, 0, "TextTooLong"), (6, 0, "TooManyElements"), (6, 1, "UnclosedTag"), (7, 0, "InvalidHTML"), (8, 0, "MismatchedTag")],
)


def _texts(*cases: tuple[int, Options]) -> Callable[[DataFrame], DataFrame]:
    def make(df: DataFrame) -> DataFrame:
        out = None
        for page, options in cases:
            got = parse_html(df.where(F.col("page_id") == page), options).where(N.is_text()).select("page_id", "node_id", "text")
            out = got if out is None else out.union(got)
        return out

    return make


_fixture(
    "fixture_text_options",
    [(1, "<p> a \n b </p>"), (2, "<p> a </p> "), (3, "<p>a<br>b"), (4, "<p>a<br>b"), (5, "<p>&lt;&#65;&nbsp;"), (6, "<p>&lt;</p>"), (7, "<p>gone")],
    _texts((1, Options(whitespace_mode="normalize")), (2, Options(whitespace_mode="trim")), (3, Options(br_handling="insert_newline")), (4, Options(br_handling="insert_custom", br_text="|")), (5, Options(text_processing_mode="decode")), (6, Options()), (7, Options(whitespace_mode="remove"))),
    "page_id, node_id, text",
    [(1, 5, " a b "), (2, 5, "a"), (3, 5, "a\n"), (3, 7, "b"), (4, 5, "a|"), (4, 7, "b"), (5, 5, "<A "), (6, 5, "&lt;")],
)
_fixture(
    "fixture_preserve_case",
    [(1, "<UL><INPUT TYPE='RADIO' Checked></UL>")],
    lambda df: Document(parse_html(df, Options(preserve_case=True))).css("input:checked").rows.select("tag", "tag_lc", F.array_join(F.transform("attrs", N.attribute_to_string), " ").alias("attrs")),
    "tag, tag_lc, attrs",
    [("INPUT", "input", 'TYPE="RADIO" Checked')],
)
_fixture(
    "fixture_void_elements",
    [(1, "<body><x>a<y>b")],
    lambda df: parse_html(df, Options(void_elements=frozenset({"x"}))).where("depth > 2").select("node_id", F.coalesce("tag", "text").alias("what"), "parent_id"),
    "node_id, what, parent_id",
    [(4, "x", 3), (5, "a", 3), (6, "y", 3), (7, "b", 6)],
)
_fixture(
    "fixture_encodings",
    [(1, "EFBBBF78"), (2, "FFFE7800"), (3, "3C6D65746120636861727365743D226762323331322220>D6D0".replace(">", "3E")), (4, "FF"), (5, "C3A9"), (6, "3C6D65746120636861727365743D6C6174696E313E80")],
    lambda df: df.withColumn("content", F.unhex("html")).withColumn("h", encoding.encoding_hint("content")).select(
        "page_id", F.col("h.detected_label").alias("detected"), F.col("h.canonical_label").alias("canonical"), F.col("h.source").alias("source"), F.col("h.helper_supported").alias("supported"),
        F.coalesce(encoding.decoded("content", "h.canonical_label"), F.lit("-")).alias("text"), encoding.canonical_label(F.col("h.detected_label")).alias("column_label"),
    ),
    "page_id, detected, canonical, source, supported, text, column_label",
    [
        (1, "utf-8", "utf-8", "utf8_bom", True, "x", "utf-8"), (2, "utf-16le", "utf-16le", "utf16le_bom", True, "x", "utf-16le"), (3, "gb2312", "gbk", "meta_charset", True, '<meta charset="gb2312" >中', "gbk"),
        (4, "", "", "none", False, "-", ""), (5, "utf-8", "utf-8", "utf8_heuristic", True, "é", "utf-8"), (6, "latin1", "windows-1252", "meta_charset", True, "<meta charset=latin1>€", "windows-1252"),
    ],
)
_fixture(
    "fixture_metadata",
    [(1, '<title>A &amp; B</title><meta name=" Author " content="me"><meta property="og:x" content="y"><img src=i.png><a href=/1>a</a>'), (2, '<meta http-equiv="Content-Type" content="text/html; charset=gbk; x"><p>')],
    lambda df: _metadata(df),
    "page_id, title, charset, author, og, images",
    [(1, "A & B", "", "me", "y", 1), (2, "", "gbk", "", "", 0)],
)


_fixture(
    "fixture_states",
    [(1, "</>k"), (2, "</1>k"), (3, "<p 'x>"), (4, "<p =x>"), (5, "<p a=1 A=2 b>"), (6, "<main><table><u>k<tr><td>l")],
    lambda df: parse_html(df).where("tag IN ('p', 'u') OR node_type = 'text'").select("page_id", "node_id", F.coalesce("tag", "text").alias("what"), F.coalesce(F.array_join(F.transform("attrs", N.attribute_to_string), " "), F.lit("-")).alias("attrs")),
    "page_id, node_id, what, attrs",
    [(1, 4, "k", "-"), (2, 4, "1>k", "-"), (3, 4, "x>", "-"), (4, 4, "x>", "-"), (5, 4, "p", 'a="2" b'), (6, 5, "u", ""), (6, 6, "k", "-"), (6, 11, "l", "-")],
)
_fixture(
    "fixture_contexts",
    [(1, "<i>4"), (2, "3 &lt; 4<i>"), (3, "<i>4"), (4, "<i>4"), (5, "<i>4</i>")],
    lambda df: parse_html(df.withColumn("ctx", F.get(F.array(*[F.lit(c) for c in ("SCRIPT", "title", "xmp", "plaintext", "")]), (F.col("page_id") - 1).cast("int"))), context="ctx").where("depth > 0").select("page_id", F.coalesce("tag", "text").alias("what")),
    "page_id, what",
    [(1, "<i>4"), (2, "3 < 4<i>"), (3, "<i>4"), (4, "<i>4"), (5, "i"), (5, "4")],
)
_fixture(
    "fixture_start_states",
    [(1, "k<i>l]]>m")],
    lambda df: tokenize_html(df, state="cdata").select("token_seq", "type", "value"),
    "token_seq, type, value",
    [(0, "text", "k<i>l"), (1, "text", "m")],
)
_fixture(
    "fixture_malformed_utf16",
    [(1, "00D87800"), (2, "00780079"), (3, "3DD800DE"), (4, "780079")],
    lambda df: df.select("page_id", encoding.decoded(F.unhex("html"), F.when(F.col("page_id") == 2, "utf-16be").otherwise("utf-16le")).alias("text")),
    "page_id, text",
    [(1, "\ufffdx"), (2, "xy"), (3, "\U0001f600"), (4, "x\ufffd")],
)
_fixture(
    "fixture_characters",
    [(1, "a"), (2, "7"), (3, "G"), (4, " "), (5, "é")],
    lambda df: df.select("page_id", *(f(F.col("html")).alias(name) for name, f in (("letter", X.is_letter), ("digit", X.is_digit), ("hex", X.is_hex_digit), ("alnum", X.is_alnum), ("blank", X.is_whitespace)))),
    "page_id, letter, digit, hex, alnum, blank",
    [(1, True, False, True, True, False), (2, False, True, True, True, False), (3, True, False, False, True, False), (4, False, False, False, False, True), (5, False, False, False, False, False)],
)
_fixture(
    "fixture_strings",
    [(1, "Fig  fig\tDATE"), (2, "SCRIPT"), (3, "Élan")],
    lambda df: df.select("page_id", X.to_upper(F.col("html")).alias("upper"), F.array_join(X.split_class_names(F.col("html")), "|").alias("names"), X.is_raw_text_tag(F.col("html")).alias("raw"), X.starts_with_ignore_case(F.col("html"), F.lit("FIG")).alias("starts"), X.equals_ignore_case(F.col("html"), F.lit("sCript")).alias("same")),
    "page_id, upper, names, raw, starts, same",
    [(1, "FIG  FIG\tDATE", "Fig|fig|DATE", False, True, False), (2, "SCRIPT", "SCRIPT", True, False, True), (3, "ÉLAN", "Élan", False, False, False)],
)
_fixture(
    "fixture_selector_lists",
    [(1, "<ul><li id=k>1<li class=l>2</ul>")],
    lambda df: _lists(df),
    "selector, n",
    [("#k", 1), (".l, #k", 2), ("li/* c */:first-child", 1)],
)


def _lists(df: DataFrame) -> DataFrame:
    """Selectors that were read in one batch, and sets that are walked in order."""
    d, rows = Document(parse_html(df)), []
    for found in parse_selectors(["#k", ".l, #k", "li/* c */:first-child"]):
        rows.append((len(list(d.css(found))),))
    texts = ("#k", ".l, #k", "li/* c */:first-child")
    return df.sparkSession.createDataFrame([(t, n) for t, (n,) in zip(texts, rows, strict=True)], "selector string, n int")


@query("SELECT page_id, title, '' AS error FROM (VALUES (1, 'fig'), (2, 'date')) AS t(page_id, title) UNION ALL VALUES (3, '', 'FileReadError')")
def file_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files that are there and one that isn't."""
    home = f"{work_dir(spark)}/files-{uuid.uuid4().hex}"
    for i, name in enumerate(("fig", "date"), 1):
        spark.createDataFrame([(f"<title>{name}</title>",)], "value string").coalesce(1).write.text(f"{home}/{i}")
    out = None
    for i in (1, 2, 3):
        pages = parse_file(spark, f"{home}/{i}", glob="*.txt", fail=False)
        nodes = parse_html(pages)
        row = D.title(nodes, pages).join(pages.select("page_id", F.coalesce("error", F.lit("")).alias("error")), "page_id").select(F.lit(i).alias("page_id"), "title", "error")
        out = row if out is None else out.union(row)
    return out


def _metadata(df: DataFrame) -> DataFrame:
    p = Parsed.of(df)
    images = D.get_all_images(p.nodes).groupBy("page_id").agg(F.count(F.lit(1)).cast("int").alias("images"))
    named = lambda d, name: d.toDF("page_id", name)
    out = D.title(p.nodes, p.texts).join(D.charset(p.pages, p.nodes), "page_id").join(named(D.get_meta_content(p.pages, p.nodes, "author"), "author"), "page_id")
    out = out.join(named(D.get_meta_property(p.pages, p.nodes, "OG:X"), "og"), "page_id").join(images, "page_id", "left")
    return out.withColumn("images", F.coalesce("images", F.lit(0)))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each page its title and the targets of its navigation links."""
    p = parsed(spark, sf_dir).staged()
    found = NodeSet.collected(Document(p.nodes).css("nav ul > li a[href^='/']").extract_attributes("href"))
    return D.title(p.nodes, p.pages).join(found.withColumnRenamed("values", "links"), "page_id", "left")
