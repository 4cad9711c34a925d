"""Selections and node sets over the node table."""

import pytest
from pyspark.sql import functions as F

from domspark.functions import nodes as N
from domspark.operators import document as D
from domspark.operators.nodeset import Document, NodeSet
from domspark.options import Options
from domspark.sources.html import Parsed

PAGES = [
    (1, "<div id=root class='x y'><p class=a>one</p><p>two <b>bold</b></p>tail<span><p lang=en-US>three</p></span></div><div id=root></div>"),
    (2, '<div class=card><h2>t</h2><span class="target">a</span></div><div class=card><em>b</em><p></p></div>'),
    (3, "<DIV><INPUT TYPE='CHECKBOX' CHECKED><input type=text disabled data-val='hello world'><select><option selected>x</option></select><a href='#'>l</a></DIV>"),
    (4, ""),
    (5, "<div><p>1</p><span>2</span><p>3</p><span>4</span><p>5</p><!-- c --><i> </i></div>"),
]
META = '<html lang=en><head><title>A &amp; B</title><meta charset="utf-8"><meta name=" Author " content="me"><meta property="og:x" content="y"></head><body><a href="/1">a</a><a>n</a><img src="i.png"><a href="/2">b</a></body></html>'


@pytest.fixture(scope="module")
def doc(spark):
    parsed = Parsed.of(spark.createDataFrame(PAGES, "page_id long, html string")).persist()
    return Document(parsed.nodes)


def listed(found: NodeSet, what="text"):
    """(page_id, tag or text) in order."""
    rows = found.with_text("t").rows.orderBy("page_id", "pos").select("page_id", "tag_lc", "t").collect()
    return [(r.page_id, r.t if what == "text" else r.tag_lc) for r in rows]


@pytest.mark.parametrize(
    "selector, want",
    [
        ("p.a", [(1, "one")]),
        ("#root", [(1, "onetwo boldtailthree")]),
        ("div#root", [(1, "onetwo boldtailthree"), (1, "")]),
        ("div > p", [(1, "one"), (1, "two bold"), (2, ""), (5, "1"), (5, "3"), (5, "5")]),
        ("#root p b", [(1, "bold")]),
        ("div b", [(1, "bold")]),
        ("p + p", [(1, "two bold")]),
        ("p ~ span", [(1, "three"), (5, "2"), (5, "4")]),
        ("span p, p b", [(1, "bold"), (1, "three")]),
        ("p:nth-of-type(odd)", [(1, "one"), (1, "three"), (2, ""), (5, "1"), (5, "5")]),
        ("p:nth-child(2)", [(1, "two bold"), (2, "")]),
        ("div > :nth-last-child(1)", [(1, "three"), (2, "a"), (2, ""), (3, "l"), (5, " ")]),
        ("div > :last-of-type:not(p)", [(1, "three"), (2, "t"), (2, "a"), (2, "b"), (3, "x"), (3, "l"), (3, ""), (5, "4"), (5, " ")]),
        (".card:has(> .target)", [(2, "ta")]),
        ("h2:has(+ span)", [(2, "t")]),
        ("h2:has(~ span)", [(2, "t")]),
        ("div:has(b)", [(1, "onetwo boldtailthree")]),
        ("div:has(em, b)", [(1, "onetwo boldtailthree"), (2, "b")]),
        ("div.card:not(:has(em))", [(2, "ta")]),
        ("div:is(.card, #nothing) > em", [(2, "b")]),
        ("p:where(.a)", [(1, "one")]),
        ("input:checked", [(3, "")]),
        ("option:checked", [(3, "x")]),
        ("input:disabled", [(3, "")]),
        ("input:enabled", [(3, "")]),
        ("a:link", [(3, "l")]),
        ("a:visited, a:hover", []),
        ("i:empty", [(5, " ")]),
        ("[lang|=en]", [(1, "three")]),
        ("[data-val~=world]", [(3, "")]),
        ("[data-val^='hello']", [(3, "")]),
        ("[data-val$='world'], [data-val*='zz']", [(3, "")]),
        ("[class~='y']", [(1, "onetwo boldtailthree")]),
        ("body > div:first-child > p:only-of-type", []),
        (":root", [(1, "onetwo boldtailthree"), (2, "tab"), (3, "xl"), (5, "12345 ")]),
        ("em::before, p::first-line", [(1, "one"), (1, "two bold"), (1, "three"), (2, "b"), (2, ""), (5, "1"), (5, "3"), (5, "5")]),
    ],
)
def test_selectors(doc, selector, want):
    got = listed(doc.css(selector))
    assert sorted(got) == sorted(want) and [g[0] for g in got] == [w[0] for w in sorted(want)]


def test_selection_is_one_filter_when_local(doc):
    plan = doc.css("p.a[x]")._rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_first_and_lookups(doc):
    assert listed(doc.css_first("p")) == [(1, "one"), (2, ""), (5, "1")]
    assert listed(doc.get_element_by_id("root")) == [(1, "onetwo boldtailthree")]
    assert listed(doc.get_element_by_id("")) == []
    assert len(listed(doc.get_elements_by_tag_name("P"))) == 7
    assert listed(doc.get_elements_by_class_name("y"), "tag") == [(1, "div")]


def test_sizes_include_empty_pages(doc):
    assert {r.page_id: r.size for r in doc.css("p").size().collect()} == {1: 3, 2: 1, 3: 0, 4: 0, 5: 3}
    assert {r.page_id for r in doc.css("p").empty().where("empty").collect()} == {3, 4}


def test_filters(doc):
    p = doc.css("p")
    assert listed(p.has_class("a")) == [(1, "one")]
    assert listed(p.has_attribute("LANG")) == [(1, "three")]
    assert listed(p.has_attribute("lang", "en")) == []
    assert listed(p.has_attribute_contains("lang", "US")) == [(1, "three")]
    assert listed(p.has_text("one")) == [(1, "one")]
    assert listed(p.containing_text("bold")) == [(1, "two bold")]
    assert listed(p.matching_text(lambda t: F.length(t) == 1)) == [(5, "1"), (5, "3"), (5, "5")]
    assert listed(p.filter(F.size("classes") > 0)) == [(1, "one")]
    assert listed(p.not_(".a, div > p")) == [(1, "three")]
    assert listed(p.not_("")) == listed(p)
    assert listed(doc.css("div > *").has_tag("EM"), "tag") == [(2, "em")]
    assert {r.page_id for r in p.is_("[lang]").where("matches").collect()} == {1}
    assert {r.page_id for r in p.contains("bold").where("contains").collect()} == {1}
    assert {r.page_id for r in p.contains(doc.css("div > p")).where("contains").collect()} == {1, 2, 5}


def test_slices(doc):
    p = doc.css("p").filter(F.col("page_id") == 5)
    assert [t for _, t in listed(p.slice(1, 3))] == ["3", "5"]
    assert [t for _, t in listed(p.first(2))] == ["1", "3"]
    assert [t for _, t in listed(p.last(2))] == ["3", "5"]
    assert [t for _, t in listed(p.skip(1).first(1))] == ["3"]
    assert [t for _, t in listed(p.even())] == ["1", "5"]
    assert [t for _, t in listed(p.odd())] == ["3"]
    assert [t for _, t in listed(p.eq(2))] == ["5"] == [t for _, t in listed(p.last_element())]
    assert [t for _, t in listed(p.gt(0))] == ["3", "5"] and [t for _, t in listed(p.lt(1))] == ["1"]
    assert listed(p.slice(5, 9)) == listed(p.slice(2, 1)) == []
    assert [t for _, t in listed(p.not_(":first-child").first_element())] == ["3"]


def test_navigation(doc):
    five = doc.css("span").filter(F.col("page_id") == 5)
    assert [t for _, t in listed(five.next_sibling())] == ["3", "5"]
    assert [t for _, t in listed(five.prev_sibling())] == ["1", "3"]
    assert [t for _, t in listed(five.eq(1).prev_siblings())] == ["3", "2", "1"]
    assert [t for _, t in listed(five.eq(1).next_siblings())] == ["5", " "]
    assert [t for _, t in listed(five.siblings())] == ["1", "3", "4", "5", " ", "2"]
    assert listed(five.parent(), "tag") == [(5, "div")]
    assert listed(doc.css("b").parents(), "tag") == [(1, "p"), (1, "div"), (1, "body"), (1, "html")]
    assert listed(doc.css("b, #root").closest("p, div"), "tag") == [(1, "div"), (1, "p"), (1, "div")]
    assert listed(doc.css("span").closest("span.target"), "tag") == [(2, "span")]
    assert [t for _, t in listed(doc.css("#root").children())] == ["one", "two bold", "three"]
    assert [t for _, t in listed(doc.css("#root").children(".a"))] == ["one"]
    assert [t for _, t in listed(doc.css("div, span").find("p").filter(F.col("page_id") == 1))] == ["one", "two bold", "three"]
    assert listed(doc.css("p").find("p")) == []


def test_extraction(doc):
    values = NodeSet.collected(doc.css("p").extract_texts()).collect()
    assert {r.page_id: r["values"] for r in values} == {1: ["one", "two bold", "three"], 2: [""], 5: ["1", "3", "5"]}
    assert [r.value for r in doc.css("p").extract_own_texts().where("page_id = 1").orderBy("pos").collect()] == ["one", "two ", "three"]
    assert [(r.pos, r.value) for r in doc.css("input").extract_attributes("data-val").collect()] == [(1, "hello world")]
    assert [r.n for r in doc.css("b").map(lambda r: F.length(r["own_text"]), "n").collect()] == [4]
    assert len(list(doc.css("p"))) == 7
    assert doc.css("p").each(print) is not None


def test_page_operators(spark):
    pages = spark.createDataFrame([(1, META), (2, "<p>x"), (3, '<meta http-equiv="Content-Type" content="text/html; charset=gbk; x">')], "page_id long, html string")
    p = Parsed.of(pages)
    one = lambda df: {r.page_id: r[1] for r in df.collect()}
    assert one(D.title(p.nodes, p.texts)) == {1: "A & B", 2: "", 3: ""}
    assert one(D.charset(p.pages, p.nodes)) == {1: "utf-8", 2: "", 3: "gbk"}
    assert one(D.get_meta_content(p.pages, p.nodes, "AUTHOR"))[1] == "me"
    assert one(D.get_meta_property(p.pages, p.nodes, "og:x")) == {1: "y", 2: "", 3: ""}
    assert [r.value for r in D.get_all_links(p.nodes).orderBy("node_id").collect()] == ["/1", "/2"]
    assert [r.value for r in D.get_all_images(p.nodes).collect()] == ["i.png"]
    assert {r.tag for r in D.root(p.nodes).collect()} == {"html"} == {r.tag for r in D.html(p.nodes).collect()}
    assert one(D.source_html(p.pages))[2] == "<p>x"


def test_fragments_errors_and_strict_pages(spark):
    pages = spark.createDataFrame([(1, "<td>a", "tr"), (2, "</p>x", "div"), (3, None, None)], "page_id long, html string, ctx string")
    p = Parsed.of(pages, context="ctx")
    assert [(r.page_id, r.tag) for r in p.nodes.where("tag is not null").collect()] == [(1, "td")]
    assert [(r.page_id, r.code) for r in p.errors.collect()] == [(2, "MismatchedTag")]
    strict = Parsed.of(pages, Options.strict(), context="ctx", fail=False)
    assert {r.page_id for r in strict.nodes.where("node_id > 0").collect()} == {1} and strict.texts.count() == 3
    with pytest.raises(Exception, match="MismatchedTag"):
        Parsed.of(pages, Options.strict(), context="ctx").nodes.collect()


def test_node_accessors(doc):
    rows = doc.nodes.where("page_id = 5")
    assert rows.where(N.is_comment()).select(N.text_trim(), N.text_length()).first()[:] == ("c", 3)
    assert rows.where("tag = 'div'").select(N.namespace_uri(), N.has_children(), N.attribute_count()).first()[:] == ("http://www.w3.org/1999/xhtml", True, 0)
    one = doc.nodes.where("tag_lc = 'input'").select(N.get_attribute("TYPE"), N.has_attribute("checked"), N.class_name(), F.transform("attrs", N.attribute_to_string)).first()
    assert one[:] == ("CHECKBOX", True, "", ['type="CHECKBOX"', "checked"])
    assert N.with_siblings(rows).where("tag = 'span'").select("prev_sibling_id").count() == 2
    assert N.siblings(rows, rows.where(N.is_comment())).count() == 6
    assert N.children(rows, rows.where("tag = 'div'")).count() == 7 and N.parents(rows, rows.where("tag = 'i'")).first().tag == "div"
    assert N.end_children(rows).count() > 3


def test_lookups_below_elements(doc):
    for tag in ("li", "p"):
        below = doc.css("body").get_elements_by_tag_name(tag)
        assert [tuple(r) for r in below.keys.collect()] == [tuple(r) for r in doc.css(f"body {tag}").keys.collect()]


def test_each_in_order_and_on_executors(doc):
    seen = []
    doc.css("*").each(lambda pos, row: seen.append((row["page_id"], pos)), in_order=True)
    assert seen == sorted(seen) and seen
    one = []
    doc.css("*").each(lambda row: one.append(row["node_id"]), in_order=True)
    assert len(one) == len(seen)


def test_sibling_plans_make_no_pairs(doc):
    for s in (doc.css("li").siblings(), doc.css("li").next_siblings(), doc.css("li").prev_siblings()):
        plan = s.rows._jdf.queryExecution().optimizedPlan().toString()
        joins = [line for line in plan.splitlines() if "Join" in line]
        assert joins and not any("parent_id" in line for line in joins)
