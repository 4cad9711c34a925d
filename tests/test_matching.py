"""Compiled selectors against a matcher that walks the tree, on random pages and random selectors."""

import random

import pytest
from pyspark.sql import functions as F

from domspark.functions.text import HTML_SPACE
from domspark.operators.nodeset import Document
from domspark.plans.matching import matching
from domspark.plans.selectors import Attr, Class, Combined, Compound, Id, Pseudo, PseudoElement, SelectorList, Tag, Universal, nth, parse_selector
from domspark.plans.tree import parse
from domspark.sources.html import parse_html


class Walker:
    """Matching by definition, over one parsed page."""

    def __init__(self, html):
        self.t, _, _ = parse(html)
        self.kids = self.t.children(0)
        self.order = []
        todo = [0]
        while todo:
            n = todo.pop()
            self.order.append(n)
            todo += reversed(self.kids.get(n, []))
        self.elements = [n for n in self.order if self.t.kind[n] == "element"]
        self.number = {n: i for i, n in enumerate(self.order)}

    def family(self, n):
        return [k for k in self.kids[self.t.parent[n]] if self.t.kind[k] == "element"]

    def attr(self, n, name):
        return next((v for k, v, _ in self.t.attrs.get(n, ()) if k == name), None)

    def below(self, n):
        todo, out = list(self.kids.get(n, [])), []
        while todo:
            k = todo.pop()
            out += [k] * (self.t.kind[k] == "element")
            todo += self.kids.get(k, [])
        return out

    def fits(self, n, s):
        t = self.t
        if isinstance(s, SelectorList):
            return any(self.fits(n, x) for x in s.selectors)
        if isinstance(s, Compound):
            return all(self.fits(n, x) for x in s.parts)
        if isinstance(s, Combined):
            own, at = self.family(n), self.family(n).index(n)
            up, above = t.parent[n], []
            while up > 0:
                above.append(up)
                up = t.parent[up]
            near = {" ": above, ">": above[:1], "+": own[max(0, at - 1) : at], "~": own[:at]}[s.how]
            return self.fits(n, s.right) and any(self.fits(x, s.left) for x in near)
        if isinstance(s, (Universal, PseudoElement)):
            return True
        if isinstance(s, Tag):
            return t.rule[n].low == s.name
        if isinstance(s, Class):
            return s.name in (self.attr(n, "class") or "").split()
        if isinstance(s, Id):
            return self.attr(n, "id") == s.name
        if isinstance(s, Attr):
            v = self.attr(n, s.name)
            return v is not None and {"": True, "=": v == s.value, "*=": s.value in v, "^=": v.startswith(s.value), "$=": v.endswith(s.value), "~=": s.value != "" and s.value in v.split(), "|=": v == s.value or v.startswith(s.value + "-")}[s.op]
        assert isinstance(s, Pseudo)
        own = self.family(n)
        same = [k for k in own if t.rule[k].low == t.rule[n].low]
        if s.name == "has":
            at = own.index(n)
            kids = [k for k in self.kids.get(n, []) if t.kind[k] == "element"]
            return any(any(self.fits(k, inner) for k in {" ": self.below(n), ">": kids, "+": own[at + 1 : at + 2], "~": own[at + 1 :]}[how]) for how, inner in s.inner)
        if s.name in ("is", "where", "not"):
            return any(self.fits(n, inner) for _, inner in s.inner) != (s.name == "not")
        if s.name.startswith("nth"):
            group = same if s.name.endswith("type") else own
            place = len(group) - group.index(n) if "last" in s.name else group.index(n) + 1
            a, b = nth(s.argument)
            return any(a * k + b == place for k in range(60))
        return {
            "first-child": own[0] == n, "last-child": own[-1] == n, "only-child": len(own) == 1, "first-of-type": same[0] == n, "last-of-type": same[-1] == n, "only-of-type": len(same) == 1,
            "root": t.parent[n] == 0, "empty": all(t.kind[k] != "element" and not (t.kind[k] == "text" and t.text[k].strip(HTML_SPACE)) for k in self.kids.get(n, [])),
        }[s.name]


R = random.Random(20)
SIMPLE = ["div", "span", "em", "*", ".a", ".b", "#i", "[x]", "[x=y]", "[x^=y]", "[x~=z]", "[x|=y]", "[x*='']"]
PSEUDO = [":first-child", ":last-child", ":only-child", ":nth-child(2n+1)", ":nth-last-child(-n+2)", ":nth-of-type(2)", ":nth-last-of-type(odd)", ":first-of-type", ":last-of-type", ":only-of-type", ":empty", ":root"]


def selector(depth=2):
    def compound():
        out = R.choice(SIMPLE) + (R.choice(SIMPLE[4:]) if R.random() < 0.3 else "") + (R.choice(PSEUDO) if R.random() < 0.3 else "")
        if depth and R.random() < 0.4:
            kind = R.choice([":not", ":is", ":where", ":has"])
            out += f"{kind}({R.choice(['', '> ', '+ ', '~ ']) if kind == ':has' else ''}{selector(depth - 1)})"
        return out

    text = compound()
    for _ in range(R.choice([0, 1, 1, 2])):
        text += R.choice([" ", " > ", " + ", " ~ "]) + compound()
    return text + (f", {compound()}" if R.random() < 0.2 else "")


def page():
    def node(depth):
        tag = R.choice(["div", "span", "em"])
        attrs = "".join(f" {a}" for a in R.sample(["class='a'", "class='b a'", "id=i", "x=y", "x='y-1 z'", "x"], R.randrange(3)))
        inner = "".join(R.choice([lambda: node(depth - 1), lambda: "t", lambda: " ", lambda: "<!--c-->"])() for _ in range(R.randrange(5))) if depth else ""
        return f"<{tag}{attrs}>{inner}</{tag}>"

    return "".join(node(4) for _ in range(R.randrange(1, 4)))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    pages = {i: page() for i in range(60)}
    path = str(tmp_path_factory.mktemp("nodes"))
    parse_html(spark.createDataFrame(list(pages.items()), "page_id long, html string")).write.mode("overwrite").parquet(path)
    return {i: Walker(h) for i, h in pages.items()}, spark.read.parquet(path)


def test_random_selectors(corpus):
    walkers, nodes = corpus
    texts = list(dict.fromkeys(selector() for _ in range(24)))
    for at in range(0, len(texts), 6):
        part, found = texts[at : at + 6], None
        for i, s in enumerate(part):
            one = matching(nodes, parse_selector(s)).select(F.lit(i).alias("s"), "page_id", "node_id")
            found = one if found is None else found.union(one)
        got = {tuple(r) for r in found.collect()}
        want = {(i, p, w.number[n]) for i, s in enumerate(part) for p, w in walkers.items() for n in w.elements if w.fits(n, parse_selector(s))}
        assert got == want, [part[i] for i in {x[0] for x in got ^ want}]


def test_sets_follow_document_order(corpus):
    _, nodes = corpus
    rows = Document(nodes).css("div span, em").keys.orderBy("page_id", "pos").collect()
    assert rows == sorted(rows, key=lambda r: (r.page_id, r.node_id))
