"""The scanner and the tree, without Spark."""

import time
import tracemalloc

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from domspark.options import Options
from domspark.plans.errors import HtmlError
from domspark.plans.scanner import tokenize
from domspark.plans.columns import node_rows
from domspark.plans.tree import parse
from domspark.sources.html import CHARS, CHUNK, _batches


def outline(html, options=Options(), context=None):
    """The tree as nested text: tag(children), 'text', <!comment>."""
    tree, root, _ = parse(html, options, context)
    kids = tree.children(root)

    def show(node):
        if tree.kind[node] == "text":
            return repr(tree.text[node])
        if tree.kind[node] == "comment":
            return f"<!{tree.text[node]}>"
        return f"{tree.tag(node)}({' '.join(map(show, kids.get(node, ())))})"

    return " ".join(map(show, kids.get(root, ())))


def found(tree, tag):
    return next(i for i in range(1, len(tree.kind)) if tree.tag(i) == tag)


def body(html, options=Options()):
    return outline(html, options).removeprefix("html(head() body(").removesuffix("))")


def codes(html, options=Options(), context=None):
    return [e[0] for e in parse(html, options, context)[2]]


def kinds(html, options=Options()):
    return [(t[0], t[1] or t[2]) for t in tokenize(html, options)[0]]


@pytest.mark.parametrize(
    "html, want",
    [
        ("<section>Plum</section>", "html(head() body(section('Plum')))"),
        ("<base href='/x'><style>i{}</style><h2>Kiwi", "html(head(base() style('i{}')) body(h2('Kiwi')))"),
        ("<head>stray<link rel=x></head><h2>Kiwi", "html(head() body('stray' link() h2('Kiwi')))"),
        ("<svg id=s><circle r=2></circle></svg><h2>end", "html(head() body(svg('<circle r=2></circle>') h2('end')))"),
        ("\n<html><head><meta name=m>", "html(head() body('\\n' meta()))"),
        ("<body></body><!-- late --><h2>more", "html(head() body(h2('more')) <! late >)"),
        ("<head></head><!--x--><base>", "html(head(base()) <!x>)"),
    ],
)
def test_documents(html, want):
    assert outline(html) == want


@pytest.mark.parametrize(
    "html, want",
    [
        ("<textarea>5 &gt; 4</textarea>", "textarea('5 > 4')"),
        ("<table><th>fig<td>date</table>", "table(tbody(tr(th('fig') td('date'))))"),
        ("<table><tr><td>3<table><td>4</table>5</table>", "table(tbody(tr(td('3' table(tbody(tr(td('4')))) '5'))))"),
        ("<table><col span=2><td>7</table>", "table(colgroup(col()) tbody(tr(td('7'))))"),
        ("<table><caption>sums<tfoot><td>9<tbody><th>8</table>", "table(caption('sums') tfoot(tr(td('9'))) tbody(tr(th('8'))))"),
        ("<select><optgroup label=warm><option>red<optgroup label=cold><option>blue</select>", "select(optgroup(option('red')) optgroup(option('blue')))"),
        ("<select><option>red<select><option>blue</select>", "select(option('red')) select(option('blue'))"),
        ("<nav><a href=/n>north<a href=/s>south</a></nav>", "nav(a('north') a('south'))"),
        ("<form name=f>7<form name=g>8</form>9", "form('78') '9'"),
        ("<main><table>loose<th>kept</table></main>", "main('loose' table(tbody(tr(th('kept')))))"),
        ("<main>so<table>far<tr>,<td>in</table></main>", "main('sofar,' table(tbody(tr(td('in')))))"),
        ("<main><table><em>loose<th>kept</table></main>", "main(em('loose') table(tbody(tr(th('kept')))))"),
        ("<table><td><table>x<i>y<td>z</table>w", "table(tbody(tr(td('x' i('y') table(tbody(tr(td('z')))) 'w'))))"),
        ("<h2><u><s>k</u>l</s>m", "h2(u(s('k')) s('l') 'm')"),
        ("<p><em>k<br><p>l", "p(em('k' br() p('l')))"),
        ("<p>k<pre>l", "p('k') pre('l')"),
        ("<ol><li>k<li>l</ol>", "ol(li('k') li('l'))"),
        ("<dl><dt>k<dd>l<dt>m</dl>", "dl(dt('k') dd('l') dt('m'))"),
        ("<aside/>k", "aside() 'k'"),
        ("<h2><style/>k<u>l</u>", "h2(style() 'k' u('l'))"),
        ("<x-tag data.k=1 @l='m'>n</x-tag>", "x-tag('n')"),
        ("k<!-- l --><!---->m", "'k' <! l > 'm'"),
        ("<![CDATA[k>l]]>m", "'k>lm'"),
        ("3 < 4", "'3 < 4'"),
        ("<?xml k ?>l", "'l'"),
        ("<h2><!k>l--><u>", "h2(<!k>l> u())"),
        ("<button>k<button>l", "button('k') button('l')"),
    ],
)
def test_bodies(html, want):
    assert body(html) == want


def test_doctype_in_any_case_is_no_comment():
    assert outline("<!Doctype html><p>x") == "html(head() body(p('x')))"
    assert tokenize("<!DOCTYPE html")[0][0][5]
    assert [e[0] for e in tokenize("<!DOCTYPE html")[1]] == ["UnexpectedEOF"]


def test_math_and_svg_namespaces():
    tree, _, _ = parse("<math><mn>4</mn></math><h2>z")
    assert {tree.tag(i): tree.ns.get(i, "html") for i in range(1, len(tree.kind)) if tree.rule[i]} == {"html": "html", "head": "html", "body": "html", "math": "mathml", "mn": "mathml", "h2": "html"}


@pytest.mark.parametrize(
    "html, context, want",
    [
        ("fig<u>date</u>", "div", "'fig' u('date')"),
        ("<th>fig<td>date", "tr", "th('fig') td('date')"),
        ("fig<u>", "title", "'fig<u>'"),
        ("<circle/>", "svg", "'<circle/>'"),
        ("3 &lt; 4", "textarea", "'3 < 4'"),
        ("<i>4", "script", "'<i>4'"),
        ("<i>4", "plaintext", "'<i>4'"),
        ("fig<h2>date", "", "'fig' h2('date')"),
        ("fig<tr><th>date", "table", "'fig' tbody(tr(th('date')))"),
        ("<head><body>fig", "div", "head(body('fig'))"),
    ],
)
def test_fragments(html, context, want):
    assert outline(html, context=context) == want


def test_attributes():
    attrs = tokenize('<input checked data-empty="" A=b/c A=\'d\' x=a?b=c>')[0][0][3]
    assert attrs == [("checked", "", False), ("data-empty", "", True), ("a", "b/c", True), ("a", "d", True), ("x", "a?b=c", True)]
    tree, _, _ = parse('<p a=1 A=2 b="&amp;">')
    assert tree.attrs[found(tree, "p")] == [("a", "2", True), ("b", "&amp;", True)]


def test_text_elements():
    assert kinds("<script>a</SCRIPT >b") == [("open", "script"), ("text", "a"), ("close", "script"), ("text", "b")]
    assert kinds("<script>var t='</p>'</script>")[1] == ("text", "var t='</p>'")
    assert kinds("<style>a</styleX></style>")[1] == ("text", "a</styleX>")
    assert kinds("<title>a&lt;b</title>")[1] == ("text", "a<b")
    assert kinds("<plaintext>a</plaintext>")[1] == ("text", "a</plaintext>")
    assert kinds("<script>abc </script ") == [("open", "script"), ("text", "abc ")]


@pytest.mark.parametrize(
    "html, want",
    [
        ("</div", ["UnexpectedEOF"]),
        ("<div a=>", ["InvalidToken", "UnclosedTag"]),
        ("<br/ >", ["InvalidToken"]),
        ("</>", ["InvalidToken"]),
        ("</ x>", ["InvalidToken"]),
        ("<!-- x", ["UnexpectedEOF"]),
        ("<div", ["UnexpectedEOF"]),
        ("</p>", ["MismatchedTag"]),
        ("<b><i>x</b></i>", []),
        ("<div><em>x</div>", ["MismatchedTag"]),
        ("<a b='c'd=e></a>", ["InvalidToken"]),
        ("<p x=a'b></p>", ["InvalidToken"]),
    ],
)
def test_error_codes(html, want):
    assert codes(html) == want


def test_error_places_count_bytes():
    assert tokenize("é\n<b></")[1] == []
    code, _, position, line, col = tokenize("é\n<!-- x")[1][0]
    assert (code, position, line, col) == ("UnexpectedEOF", 9, 2, 7)


def test_strict_raises_the_first_error():
    with pytest.raises(HtmlError) as e:
        parse("<div></p></div>", Options.strict())
    assert e.value.code == "MismatchedTag"


def test_limits():
    assert "TooDeep" in codes("<ul><li><u>k</u></li></ul>", Options(max_depth=2))
    assert body("<ul><li><u>k</u></li></ul>", Options(max_depth=2)) == "ul(li())"
    assert codes("<i></i><u></u><s></s>", Options(max_tokens=3))[0] == "TooManyElements"
    assert codes("<br a b c>", Options(max_attributes=2)) == ["TooManyAttributes"]
    assert codes("<br abc=1>", Options(max_attribute_name_length=2)) == ["AttributeTooLong"]
    assert tokenize('<br a="xyz">', Options(max_attribute_value_length=2))[0][0][3] == [("a", "xy", True)]
    assert tokenize("aéb", Options(max_text_length=2))[0][0][2] == "a"
    assert parse("x", Options(max_depth=0))[2][0][0] == "InvalidHTML"


def test_text_options():
    entities = "<p>&amp;&lt;&gt;&quot;&apos;&nbsp;&#65;&#x41;&#0;&bogus;</p>"
    assert body(entities, Options(decode_entities=True)) == "p('&<>\"\\' AA&#0;&bogus;')"
    assert body(entities) == f"p({entities[3:-4]!r})"
    assert body("<p> a \n b </p>", Options(whitespace_mode="normalize")) == "p(' a b ')"
    assert body("<p> a </p> ", Options(whitespace_mode="trim")) == "p('a')"
    assert body("<p>a<!-- c --></p>", Options.performance()) == "p()"
    assert body("<p>a<br>b", Options(br_handling="insert_newline")) == "p('a\\n' br() 'b')"
    assert body("<p>a<br>b", Options(br_handling="insert_custom", br_text="|")) == "p('a|' br() 'b')"
    assert outline("<title>&amp;lt;</title><script>&lt;</script>", Options(decode_entities=True)) == "html(head(title('&lt;') script('&lt;')))"


def test_preserve_case():
    tree, _, _ = parse("<UL><Option VALUE='k' Selected></UL>", Options(preserve_case=True))
    assert found(tree, "UL") and [a[0] for a in tree.attrs[found(tree, "Option")]] == ["VALUE", "Selected"]


def test_custom_void_elements_replace_the_defaults():
    assert body("<x>a", Options(void_elements=frozenset({"x"}))) == "x() 'a'"
    assert Options().with_void_element("x").void_elements == {"x"}


def test_node_rows_are_in_document_order():
    rows, text = node_rows(*parse("<ul><li>a<b>b</b></li><!--c--><li> </li></ul>")[:2])
    assert text == "ab "
    assert [r[0] for r in rows] == list(range(1, len(rows) + 1))
    by = {(r[6], r[0]): r for r in rows if r[5] == "element"}
    first, second = (r for k, r in by.items() if k[0] == "li")
    assert first[13:19] == (1, 2, 2, 1, 2, 2) and second[13:19] == (2, 1, 2, 2, 1, 2)
    assert first[20] == second[0] and second[19] == first[0]
    assert (first[21], second[21]) == (False, True)
    assert text[first[22] : first[22] + first[23]] == "ab" and first[24] == "a"
    ul = next(r for r in rows if r[6] == "ul")
    assert ul[2] == len(rows) and first[4][0] == ul[0]


def test_deep_pages_do_not_recurse():
    rows, _ = node_rows(*parse("<i>" * 5000, Options(max_depth=10_000))[:2])
    assert len(rows) == 5003


def test_misplaced_content_and_errors_take_linear_time():
    for html in ("<table>" + "<i>k</i>" * 40_000, "</>\n" * 40_000):
        start = time.perf_counter()
        node_rows(*parse(html)[:2])
        assert time.perf_counter() - start < 20  # a square takes minutes


def test_a_batch_of_pages_is_not_copied_to_python_as_a_whole():
    pages = pa.RecordBatch.from_pydict({"page_id": range(3000), "html": [str(i) * 2500 for i in range(3000)], "context": pa.nulls(3000, pa.string())})
    taken = []
    tracemalloc.start()
    list(_batches(iter([pages]), CHUNK, lambda page, html, context: taken.append((page, len(html))), lambda: 0, lambda: True))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert taken == [(i, len(str(i)) * 2500) for i in range(3000)]
    assert pages.nbytes > 25e6 and most < 2e6


def test_long_pages_are_put_out_before_there_are_many_rows():
    pages = pa.RecordBatch.from_pydict({"page_id": range(40), "html": ["x" * (1 << 20)] * 40, "context": pa.nulls(40, pa.string())})
    taken, given = [], []

    def give():
        given.append(len(taken))
        taken.clear()
        return given[-1]

    assert list(_batches(iter([pages]), CHUNK, lambda page, *_: taken.append(page), lambda: len(taken), give)) == [*[CHARS >> 20] * (40 // (CHARS >> 20)), 0]


PIECES = ["<", ">", "/", "a", "b ", "=", '"', "'", "!", "--", "[CDATA[", "]]>", "?", "\0", "\n", "é", "&amp;", "<table>", "<td>", "</tr>", "<select>", "<option>", "<p>", "</p>", "<script>", "</script", "<title>", "<svg>", "<b>", "</b>", "<i>", "<br>", "<html x>", "<body>", "<head>", "<form>", "<li>", "<!DOCTYPE", "<col>", "<caption>", "</table>", "<a>"]


@settings(max_examples=1500, deadline=None)
@given(
    st.lists(st.sampled_from(PIECES), max_size=25).map("".join),
    st.sampled_from([Options(), Options(error_handling="ignore"), Options(preserve_case=True, decode_entities=True), Options(max_depth=3, max_text_length=3), Options(whitespace_mode="trim", br_handling="insert_newline")]),
    st.sampled_from([None, "div", "table", "tr", "select", "title"]),
)
def test_any_input_gives_a_consistent_tree(html, options, context):
    tree, root, errors = parse(html, options, context)
    rows, text = node_rows(tree, root)
    assert [r[12] for r in rows if r[5] == "text"] == [tree.text[i] for i in tree.order(root) if tree.kind[i] == "text"]
    assert all(0 <= e[2] <= len(html.encode()) and e[3] >= 1 and e[4] >= 1 for e in errors)
    by = {r[0]: r for r in rows}
    for r in rows:
        up = by.get(r[1])
        assert (r[1] == 0 and r[3] == 1) or (up[5] == "element" and up[3] == r[3] - 1 and up[0] < r[0] <= r[2] <= up[2])
        assert r[4] == ([up[0], *up[4]] if up else [])
        if r[5] == "text":
            assert text[r[22] : r[22] + r[23]] == r[12]
    assert parse(html, options, context)[2] == errors
