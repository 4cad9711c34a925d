"""String functions, encodings, files, streams and the table function."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from domspark.functions import encoding as E
from domspark.functions import text as X
from domspark.options import Options
from domspark.plans.errors import FileReadError
from domspark.sources.files import parse_file, read_html_files, write_nodes
from domspark.sources.html import Parsed, parse_html, register_parse_html, tokenize_html, version
from domspark.streaming import pages as S

TEXTS = ["", "&amp;lt;", "&#65;&#x41;&#X1F600;", "&#0;&#xD800;&#1114112;&#;", "&nope; &amp &;", "a&lt;b&gt;c&quot;&apos;&nbsp;|", "&&amp;;", "é&copy;&euro;&hellip;", "&#0000000065;&#x000041;", "&amp"]


def test_entities_in_python_and_as_a_column(spark):
    assert X.decode_entities("&amp;lt;") == "&lt;" and X.decode_entities("&#x41;&#0;&nope;") == "A&#0;&nope;"
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", X.decode_html_entities(F.col("t")).alias("d")).collect()
    assert {r.t: r.d for r in rows} == {t: X.decode_entities(t) for t in TEXTS}


@settings(deadline=None, max_examples=200)
@given(st.text("&#x;ampltA0 1", max_size=24))
def test_decoding_leaves_what_is_no_entity(text):
    out = X.decode_entities(text)
    assert ("&" not in text) <= (out == text)


def test_string_columns(spark):
    row = spark.createDataFrame([(" \t Ab\n cÉ \f", "AB")], "s string, t string").select(
        X.to_lower(F.col("s")), X.to_upper(F.col("s")), X.trim_whitespace(F.col("s")), X.normalize_whitespace(F.col("s")),
        X.equals_ignore_case(F.col("t"), F.lit("ab")), X.starts_with_ignore_case(F.col("t"), F.lit("a")), X.split_class_names(F.lit(" b a\tb ")),
        X.is_letter(F.lit("x")), X.is_digit(F.lit("x")), X.is_hex_digit(F.lit("f")), X.is_alnum(F.lit("5")), X.is_whitespace(F.lit("\f")), X.is_alpha(F.lit("é")), X.is_raw_text_tag(F.lit("SCRIPT")),
    ).first()
    assert row[:] == (" \t ab\n cÉ \f", " \t AB\n CÉ \f", "Ab\n cÉ", " Ab cÉ ", True, True, ["b", "a"], True, False, True, True, True, False, True)


@pytest.mark.parametrize(
    "data, want",
    [
        (b"\xef\xbb\xbfx", ("utf-8", "utf-8", "utf8_bom", True)),
        (b"\xff\xfex\x00", ("utf-16le", "utf-16le", "utf16le_bom", True)),
        (b"\xfe\xff\x00x", ("utf-16be", "utf-16be", "utf16be_bom", True)),
        (b"<META charset='GB2312'>", ("gb2312", "gbk", "meta_charset", True)),
        (b'<meta http-equiv=x content="text/html; charset=windows-31j">', ("windows-31j", "shift_jis", "meta_charset", True)),
        (b"<meta charset=koi8-r>", ("koi8-r", "koi8-r", "meta_charset", False)),
        ("é".encode(), ("utf-8", "utf-8", "utf8_heuristic", True)),
        (b"\xff\xff", ("", "", "none", False)),
        (b" " * 5000 + b"<meta charset=gbk>", ("utf-8", "utf-8", "utf8_heuristic", True)),
    ],
)
def test_sniffing(data, want):
    assert E.sniff_html_encoding(data) == want


def test_decoding():
    assert E.decode_html_bytes(b"\xef\xbb\xbfx", "UTF8") == "x"
    assert E.decode_html_bytes("中".encode("gbk"), "gb18030") == "中"
    assert E.decode_html_bytes(b"\x80\x81", "iso-8859-1") == "€\x81"
    assert E.decode_html_bytes("あ".encode("cp932"), "sjis") == "あ"
    assert E.decode_html_bytes("é".encode("utf-16-le") + b"\x00", "utf-16") == "é�"
    assert E.decode_html_bytes(b"\x00\xd8", "utf-16le") == "�"
    assert E.decode_html_bytes(b"\xc0\x80", "utf-8") is None and E.decode_html_bytes(b"x", "koi8-r") is None


def test_encoding_columns(spark):
    df = spark.createDataFrame([(bytearray("<meta charset=gbk>中".encode("gbk")),), (None,)], "c binary")
    rows = df.select(E.encoding_hint("c").alias("h"), E.decoded("c", F.lit("gbk")).alias("t"), E.bom(F.col("c")).alias("b")).collect()
    assert rows[0].h.canonical_label == "gbk" and rows[0].t.endswith("中") and rows[0].b is None and rows[1].t is None
    labels = spark.createDataFrame([(" Latin1;x",), ("UTF-16",), ("zz",)], "l string").select(E.canonical_label(F.col("l")))
    assert [r[0] for r in labels.collect()] == ["windows-1252", "utf-16le", "zz"]


def test_files(spark, tmp_path):
    (tmp_path / "a.html").write_bytes(b"\xef\xbb\xbf<p>one")
    (tmp_path / "b.htm").write_bytes("<meta charset=gbk>中".encode("gbk"))
    (tmp_path / "c.txt").write_text("no")
    rows = {r.path.rsplit("/", 1)[1]: r for r in read_html_files(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.html", "b.htm"} and rows["a.html"].html == "<p>one"
    assert (rows["b.htm"].html, rows["b.htm"].error) == (None, "UnsupportedEncoding")
    every = {r.html for r in read_html_files(spark, str(tmp_path), encodings="any").collect()}
    assert "<meta charset=gbk>中" in every
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        read_html_files(spark, str(tmp_path / "none"))


def test_saved_tables_and_table_function(spark, tmp_path):
    pages = spark.createDataFrame([(1, "<p>a<b>b")], "page_id long, html string")
    p = Parsed.of(pages).save(str(tmp_path / "p"))
    assert p.nodes.count() == 8 and p.texts.first().page_text == "ab"
    write_nodes(p.nodes, str(tmp_path / "n"), 2)
    assert spark.read.parquet(str(tmp_path / "n")).count() == 8
    register_parse_html(spark)
    assert [r.tag for r in spark.sql("SELECT tag FROM parse_html('<p>x') WHERE tag IS NOT NULL ORDER BY node_id").collect()] == ["html", "head", "body", "p"]
    assert version()


def test_tokens(spark):
    rows = tokenize_html(spark.createDataFrame([(1, "<!DOCTYPE html><a b=c>x</a><br><!-- y -->"), (2, None)], "page_id long, html string")).orderBy("token_seq").collect()
    assert [(r.type, r.name, r.value) for r in rows] == [("doctype", "html", ""), ("open", "a", ""), ("text", "", "x"), ("close", "a", ""), ("close_self", "br", ""), ("comment", "", " y ")]
    assert rows[1].attrs[0][:] == ("b", "c", True)


def test_streams(spark, tmp_path):
    pages = [(1, "u", "<ul><li class=a>x<li>y</ul>"), (2, "u", "<p class=a>z")]
    spark.createDataFrame(pages, S.PAGES).write.parquet(str(tmp_path / "in"))
    stream = S.read_pages(spark, str(tmp_path / "in"))
    for name, df, mode in (("selected", S.stream_select(stream, "li.a, p"), "append"), ("tags", S.counted(S.stream_nodes(stream)), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert {r.tag for r in spark.table("selected").collect()} == {"li", "p"}
    assert {r.tag_lc: r.n for r in spark.table("tags").collect()}["li"] == 2
    with pytest.raises(ValueError):
        S.stream_select(stream, "ul > li")


def test_plans_prune_and_push_down(spark, tmp_path):
    pages = spark.createDataFrame([(1, "<p class=a>x")], "page_id long, html string")
    from domspark.operators.nodeset import Document

    d = Document(Parsed.of(pages).save(str(tmp_path / "p")).nodes)
    plan = d.get_elements_by_tag_name("p").rows.select("page_id", "node_id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(tag_lc,p)" in plan and "own_text" not in plan


def test_positions_agree_with_window_functions(spark):
    from pyspark.sql import Window

    html = "<ul><li>a<li>b<p>c</p></ul><table><tr><td>x<td>y</table>" * 3
    n = parse_html(spark.createDataFrame([(1, html)], "page_id long, html string"), Options()).where("node_type = 'element'")
    w = Window.partitionBy("page_id", "parent_id").orderBy("node_id")
    t = Window.partitionBy("page_id", "parent_id", "tag_lc").orderBy("node_id")
    bad = n.withColumns({"a": F.row_number().over(w), "b": F.row_number().over(t), "p": F.lag("node_id").over(w), "q": F.lead("node_id").over(w)}).where(
        "a <> elem_pos OR b <> type_pos OR NOT (p <=> prev_elem_id) OR NOT (q <=> next_elem_id) OR elem_pos + elem_rpos <> elem_cnt + 1 OR type_pos + type_rpos <> type_cnt + 1"
    )
    assert bad.count() == 0


def test_missing_files(spark, tmp_path):
    with pytest.raises(FileReadError):
        parse_file(spark, str(tmp_path / "none.html"))
    row = parse_file(spark, str(tmp_path / "none.html"), fail=False).first()
    assert (row.html, row.error) == ("", "FileReadError")


def test_the_cache_of_selectors_has_a_size():
    from domspark.plans import selectors

    for i in range(5):
        selectors.parse_selector(f".k{i}", cache_size=3)
    assert list(selectors._cache) == [".k2", ".k3", ".k4"]
    selectors.parse_selector(".k2", cache_size=3)
    selectors.parse_selector(".k5", cache_size=3)
    assert list(selectors._cache) == [".k4", ".k2", ".k5"]
    assert str(selectors.parse_selector(".k9", cache_size=0)) == ".k9" and not selectors._cache


def test_the_cycle_collector_is_as_it_was_between_batches():
    import gc

    from domspark.sources.html import _batches

    states = []
    for on in (True, False):
        (gc.enable if on else gc.disable)()
        try:
            for _ in _batches(iter([]), 1, lambda *a: None, lambda: 0, lambda: states.append(gc.isenabled())):
                pass
            assert gc.isenabled() == on
        finally:
            gc.enable()
