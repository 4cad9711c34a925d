"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]. Prints one JSON line; each query's time is the better of two runs."""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

os.environ["PYTHONPATH"] = os.pathsep.join([os.path.dirname(os.path.abspath(__file__)), os.environ.get("PYTHONPATH", "")])

from domspark import queries as Q  # noqa: E402
from domspark.operators.nodeset import Document, NodeSet  # noqa: E402
from domspark.options import Options  # noqa: E402
from domspark.sources.html import Parsed, parse_html, tokenize_html  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
# The selectors of the reference numbers.
SELECTORS = {
    "div": "div", "class": ".container", "id": "#main-content", "attr": "[type='text']", "attr_href": "a[href='#']", "child": "div > p", "descendant": "ul li a", "adjacent": "h1 + nav",
    "first_child": "li:first-child", "nth_child": "li:nth-child(2)", "checked": "input:checked", "disabled": "button:disabled",
    "long": "div.container > header nav ul li a.active", "section": "section.section h2 + p.description",
}


def selector_page(blocks: int = 355) -> str:
    """Half a megabyte of repeated blocks in which the selectors find as many elements as in the reference numbers."""
    block = (
        '<div id="wrapper-{i}"><div class="container"><header id="main-content"><h1>Title {i}</h1><nav><ul><li><a href="#" class="active">Home</a></li><li><a href="#">Docs</a></li>'
        '</ul></nav></header><section class="section"><h2>Section {i}</h2><p class="description">Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore '
        'et dolore magna aliqua. Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris.</p><ul><li>one <a href="#">a</a></li><li>two</li></ul><form><input type="text" name="q"><input type="checkbox" '
        'checked><button disabled>Go</button></form></section><footer class="footer"><div class="row"><span>Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla '
        "pariatur. Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum. {pad}</span></div></footer></div></div>"
    )
    return "<!DOCTYPE html><html><head><title>bench</title></head><body>" + "".join(block.format(i=i, pad="x" * 280) for i in range(blocks)) + "</body></html>"


def main() -> None:
    home = tempfile.mkdtemp(prefix="bench-")
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.files.maxPartitionBytes", "1m").config("spark.sql.files.openCostInBytes", "64k")
        .config("spark.checkpoint.dir", f"{home}/shared").config("spark.sql.warehouse.dir", f"{home}/warehouse").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name: str, make, runs: int = 2) -> None:
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            spent = time.perf_counter() - start
            best = spent if best is None else min(best, spent)
        times[name] = round(best, 4)

    pages = Q.pages(spark, SF_DIR).repartition(int(CPUS)).cache()
    size = pages.agg(F.sum(F.octet_length("html"))).first()[0] / 2**20
    timed("tokenize", lambda: tokenize_html(pages))
    timed("tokenize_count", lambda: tokenize_html(pages).groupBy("type").count())
    timed("parse", lambda: parse_html(pages))
    timed("parse_performance", lambda: parse_html(pages, Options.performance()))
    timed("flagship", lambda: Q.flagship(spark, SF_DIR))
    saved = Parsed.of(pages).save(f"{home}/pages")
    d = Document(saved.nodes)
    timed("select_child", lambda: d.css("article > p").rows)
    timed("select_descendant", lambda: d.css("nav ul li a[href]").rows)
    timed("select_has", lambda: d.css("p:has(b)").rows)
    timed("closest", lambda: d.css("a").closest("ul").rows)
    timed("find_texts", lambda: NodeSet.collected(d.css("nav").find("a").extract_texts()))
    one = Parsed.of(spark.createDataFrame([(1, selector_page())], "page_id long, html string")).save(f"{home}/one")
    nodes = one.nodes.coalesce(1).cache()
    nodes.count()
    found = {}
    for name, selector in SELECTORS.items():
        timed(f"match_{name}", lambda s=selector: Document(nodes).css(s)._rows.select("node_id"))
        found[name] = Document(nodes).css(selector)._rows.count()
    try:
        from domspark.llm.queries import QUERIES
    except ImportError:
        QUERIES = {}
    for name, run in QUERIES.items():
        timed(name, lambda f=run: f(spark, SF_DIR), 1)
    mib = {k: round(size / times[k], 2) for k in ("tokenize", "parse", "parse_performance")}
    print(json.dumps({"metric": "total query time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": SF_DIR, "mib_per_s": mib, "matches": found}))
    spark.stop()
    shutil.rmtree(home, ignore_errors=True)


if __name__ == "__main__":
    main()
