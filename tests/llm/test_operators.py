"""Each operator on small tables against a brute-force version, and on the odd cases that its docstring defines."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from domspark.llm import chat_format, decontaminate, exact_dedup, license_scan, line_dedup, near_dup, packing, pii, quality, url_filter
from domspark.llm._shared import shingles
from domspark.llm.queries import SQL, URL_RULES, op1_line_dedup, op2_license_scan, op4_url_filter, tokenizer_path

DOCS = "doc_id long, text string"
#: Columns whose names clash with those that the operators make.
CLASH = ("key", "bucket", "text_sha256", "digest", "component", "kept", "n", "place", "data", "score", "line", "host")


def docs(spark, rows, clash=True):
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit("x") for c in CLASH}) if clash else df


def by_id(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def documents(spark, folder, texts):
    """A folder with a table of documents, for registered queries."""
    rows = [(i, t, "en", "src", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def prose(seed, words, vocabulary=3000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(words))


def edited(text, seed, changes):
    r, words = random.Random(seed), text.split()
    for _ in range(changes):
        words[r.randrange(len(words))] = f"x{r.randrange(10**6)}"
    return " ".join(words)


def corpus():
    rows = [(i, prose(i, 20 + i)) for i in range(40)]
    rows += [(100 + i, rows[i % 5][1]) for i in range(30)]
    rows += [(200 + i, edited(rows[30][1], i, i % 9)) for i in range(60)]
    rows += [(300, ""), (301, None), (302, " \n "), (303, "one"), (304, "ONE"), (305, "a b"), (306, "a b"), (307, prose(9, 3000)), (307, prose(9, 3000))]
    return rows


EMPTY = [
    (lambda d: line_dedup.line_dedup(d)),
    (lambda d: near_dup.near_dup(d)),
    (lambda d: pii.personal_data(d)),
    (lambda d: exact_dedup.exact_dedup(d)),
    (lambda d: packing.pack(d, tokenizer_path())),
    (lambda d: decontaminate.leaks(d, d.sparkSession.createDataFrame([], "item_id long, text string"))),
    (lambda d: decontaminate.decontaminated(d, d.sparkSession.createDataFrame([(1, "a b c")], "item_id long, text string"))),
    (lambda d: quality.quality_scores(d, d.sparkSession.createDataFrame([], "doc_id long, quality int"))),
    (lambda d: license_scan.license_scan(d.withColumn("path", F.col("doc_id").cast("string")))),
    (lambda d: url_filter.url_filter(d.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url")), url_filter.rules_frame(d.sparkSession, URL_RULES))),
    (lambda d: chat_format.chat_format(chat_format.thread_messages(d.select(F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), "text")))),
]


@pytest.mark.parametrize("make", EMPTY)
def test_empty_tables_give_empty_results(spark, make):
    assert make(docs(spark, [])).count() == 0


# ---- 1: line dedup ----


def lines_by_hand(rows, divisor):
    hashed = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:8], 16)
    chunks = {}
    for i, (doc, text) in enumerate(rows):
        lines, out, now, before = (text or "").split("\n"), [], [], 0
        for line in lines:
            now.append(line)
            h = hashed(line)
            if (h + before * line_dedup.BASE) % line_dedup.MODULUS % divisor == 0:
                out.append(now)
                now = []
            before = h
        chunks[i] = [c for c in [*out, now] if c]
    seen = set()
    left = {}
    for i in sorted(chunks, key=lambda i: (rows[i][0] is None, rows[i][0] or 0)):
        kept = []
        for c in chunks[i]:
            text = "\n".join(c)
            if len(c) > 1 and rows[i][0] is not None and text in seen:
                continue
            if len(c) > 1 and rows[i][0] is not None:
                seen.add(text)
            kept.append(text)
        left[i] = "\n".join(kept)
    return sorted(((rows[i][0], left[i]) for i in left), key=repr)


def test_line_dedup_is_what_a_loop_gives(spark):
    r = random.Random(3)
    lines = [prose(i, 9) for i in range(60)]
    shared = "\n".join(lines[:12])
    rows = [(i, "\n".join([*r.choices(lines, k=r.randrange(1, 9)), shared, *r.choices(lines, k=r.randrange(1, 9))])) for i in range(50)]
    rows += [(None, shared), (900, None), (901, ""), (902, "\n\n"), (903, shared + "\n" + shared)]
    out = line_dedup.line_dedup(docs(spark, rows), 3)
    assert by_id(out, "doc_id", "text") == lines_by_hand(rows, 3)
    assert {r.doc_id: (r.n_lines, r.removed_chunks) for r in out.where("doc_id >= 900 AND doc_id < 902").collect()} == {900: (1, 0), 901: (1, 0)}


def test_a_moved_passage_goes_and_repeated_rows_are_alike(spark):
    passage = "\n".join(prose(1000 + i, 8) for i in range(30))
    rows = [(1, passage), (2, "other start\n" + passage + "\nother end"), (3, "only here\n" + prose(5, 9)), (1, passage)]
    got = {r.doc_id: (r.removed_lines, r.text) for r in line_dedup.line_dedup(docs(spark, rows)).collect()}
    assert got[1] == (0, passage) and got[2][0] > 15 and got[2][1].startswith("other start") and got[3][0] == 0


def test_native_operators_run_no_python(spark):
    d = docs(spark, corpus()[:20], False)
    for out in (line_dedup.line_dedup(d), license_scan.license_scan(d.withColumn("path", F.lit("a/b")))):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def runs_by_hand(rows):
    """What is left of each row, by one pass over all pairs of neighbouring lines."""
    place = {d: i for i, d in enumerate(sorted({(d, hashlib.md5((t or "").encode()).hexdigest()) for d, t in rows if d is not None}))}
    first, out = {}, []
    for d, t in sorted({(d, t or "") for d, t in rows if d is not None}, key=lambda r: place[r[0], hashlib.md5(r[1].encode()).hexdigest()]):
        lines, gone = t.split("\n"), set()
        for i, pair in enumerate(zip(lines, lines[1:])):
            doc, j = first.setdefault(pair, ((d, t), i))
            gone |= {i, i + 1} if doc != (d, t) or i > j + 1 else set()
        out.append((d, t, len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone)))
    left = {(d, t): (n, x) for d, t, n, x in out}
    return sorted(((d, *left.get((d, t or ""), (0, t or ""))) for d, t in rows), key=repr)


def test_run_dedup_is_what_a_loop_gives(spark):
    r = random.Random(4)
    lines = [prose(i, 6) for i in range(40)] + ["", ""]
    rows = [(i, "\n".join(r.choices(lines, k=r.randrange(1, 12)))) for i in range(60)]
    rows += [(100 + i, "\n".join([prose(2000 + i, 4), *lines[a : a + r.randrange(2, 5)], prose(3000 + i, 4)])) for i, a in enumerate(r.choices(range(36), k=30))]
    rows += [(7, rows[9][1]), (8, rows[8][1]), (None, rows[3][1]), (900, None), (901, ""), (902, "\n\n"), (903, "a\na\na"), (904, "b\nb\nb\nb"), (905, "a\na"), (906, "\n".join(lines))]
    out = line_dedup.run_dedup(docs(spark, rows))
    assert by_id(out, "doc_id", "removed_lines", "text") == runs_by_hand(rows)
    got = {r.doc_id: (r.removed_lines, r.text) for r in out.where("doc_id > 902 AND doc_id < 906").collect()}
    assert got == {903: (0, "a\na\na"), 904: (2, "b\nb"), 905: (2, "")}


def test_short_repeated_runs_go_wherever_chunks_end(spark, tmp_path):
    shared = [[prose(4000 + 10 * i + k, 8) for k in range(2 + i % 3)] for i in range(30)]
    texts = ["\n".join([prose(5000 + i, 8), *shared[i % 30], prose(6000 + i, 8)]) for i in range(60)] + ["\n".join(s) for s in shared]
    got = {r.doc_id: (r.removed_lines, r.n_chars, r.removed_chunks <= r.n_chunks) for r in op1_line_dedup(spark, documents(spark, tmp_path, texts)).collect()}
    own = {i: len(prose(5000 + i, 8)) + 1 + len(prose(6000 + i, 8)) for i in range(60)}
    assert got == {i: (0, len(t), True) if i < 30 else (len(shared[i % 30]), own.get(i, 0), True) for i, t in enumerate(texts)}
    plan = line_dedup.run_dedup(docs(spark, corpus()[:20], False))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---- 2: license scans ----


def similar_by_hand(texts, least):
    """The best line and licence of each text."""
    vocabulary = {w for _, t in license_scan.TEMPLATES for w in license_scan.plain_words(t)}
    df = Counter(w for t in texts for w in set(license_scan.plain_words(t)) & vocabulary)
    idf = {w: math.log((len(texts) + 1) / (df[w] + 1)) + 1 for w in vocabulary}
    weigh = lambda ws: {w: n * idf.get(w, math.log(len(texts) + 1) + 1) for w, n in Counter(ws).items()}
    out = []
    for t in texts:
        best = None
        for i, line in enumerate(t.split("\n")):
            v = weigh(license_scan.plain_words(line))
            for j, (name, template) in enumerate(license_scan.TEMPLATES):
                u = weigh(license_scan.plain_words(template))
                both = sum(x * v.get(w, 0) for w, x in u.items())
                if both:
                    cos = round(both / math.sqrt(sum(x * x for x in u.values()) * sum(x * x for x in v.values())), 6)
                    if cos >= least and (best is None or (cos, -i, -j) > best[0]):
                        best = (cos, -i, -j), name, i
        out.append(best and (best[1], best[0][0], best[2]))
    return out


def test_headers_are_what_a_loop_gives(spark):
    notices = [t for _, t in license_scan.TEMPLATES]
    texts = [prose(i, 30) + "\n" + edited(notices[i % len(notices)], i, i % 4) + "\n" + prose(i + 1, 5) for i in range(60)] + ["", "license", "version 2.0 of the license", notices[0] * 2]
    rows = [(f"p/{i}", t) for i, t in enumerate(texts)]
    got = license_scan.license_scan(spark.createDataFrame(rows, "path string, text string"), least=0.7).collect()
    want = {f"p/{i}": w for i, w in enumerate(similar_by_hand(texts, 0.7))}
    assert {r.path: r.licence and (r.licence, r.similarity, r.line) for r in got} == want
    assert sum(w is not None for w in want.values()) > 20


def test_licences_come_from_the_nearest_directory(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [("LICENSE", mit), ("a/b/COPYING.txt", gpl), ("a/b/c/x.py", "code"), ("a/y.py", None), ("a/b/z.py", "Licensed under CC BY-NC 4.0.\ncode"), ("w", ""), (None, "q"), ("d/LICENSE", "nothing"), ("d/e", "x")]
    got = {r.path: (r.licence, r.origin, r.from_dir) for r in license_scan.license_scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {
        "LICENSE": ("MIT", "header", None), "a/b/COPYING.txt": ("GPL-3.0", "header", None), "a/b/c/x.py": ("GPL-3.0", "directory", "a/b"), "a/y.py": ("MIT", "directory", ""),
        "a/b/z.py": ("CC-BY-NC-4.0", "header", None), "w": ("MIT", "directory", ""), "": ("MIT", "directory", ""), "d/LICENSE": ("MIT", "directory", ""), "d/e": ("MIT", "directory", ""),
    }


def test_plain_notices_pass_where_the_other_words_of_their_templates_are_rare(spark, tmp_path):
    plain = [("all rights reserved", "All rights reserved."), ("MIT", "Released under the MIT License."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.")]
    sf = documents(spark, tmp_path, [prose(i, 30) + "\n" + plain[i % 10][1] if i % 10 < 5 else prose(i, 30) for i in range(400)])
    got = {r.doc_id: (r.licence, r.similarity, r.line, r.origin) for r in op2_license_scan(spark, sf).collect()}
    assert all(got[i] == (plain[i % 10][0], 1.0, 1, "header") for i in range(400) if i % 10 < 5)


def test_wrapped_notices_and_whole_licence_files(spark):
    gpl = " * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version."
    apache = '# Licensed under the Apache License, Version 2.0 (the "License");\n#\n# you may not use this file except in compliance\n# with the License.'
    bsd = "// Copyright 2020 Somebody. All rights reserved.\n// All rights reserved.\n// Redistribution and use in source and binary forms, with or\n// without modification, are permitted."
    whole = {name: f"Copyright (c) 2020 Somebody\nAll rights reserved.\n\n{text}" for name, text in license_scan.TEXTS}
    rows = [("a/x.c", prose(1, 9) + "\n" + gpl + "\n" + prose(2, 9)), ("a/y.py", apache + "\n" + prose(3, 9)), ("a/z.js", bsd), ("a/r", "All rights reserved.\n" + prose(4, 9))]
    rows += [(f"{name}/LICENSE", text) for name, text in whole.items()] + [(f"{name}/x", prose(5, 9)) for name in whole] + [(f"p/{i}", prose(i, 30)) for i in range(200)]
    got = {r.path: (r.licence, r.line, r.origin) for r in license_scan.license_scan(spark.createDataFrame(rows, "path string, text string"), license_scan.NOTICES).collect()}
    assert (got["a/x.c"], got["a/y.py"], got["a/z.js"], got["a/r"]) == (("GPL-3.0", 1, "header"), ("Apache-2.0", 0, "header"), ("BSD-3-Clause", 2, "header"), ("all rights reserved", 0, "header"))
    assert {n: got[f"{n}/LICENSE"] for n in whole} == {n: (n, 0, "header") for n in whole} and {n: got[f"{n}/x"] for n in whole} == {n: (n, None, "directory") for n in whole}


# ---- 3: near duplicates ----


def groups_by_hand(rows, size, percent):
    sets = defaultdict(list)
    for doc, text in rows:
        words = (text or "").encode().lower().split()
        sets[doc].append({tuple(words[i : i + size]) for i in range(len(words) - size + 1)} or ({tuple(words)} if words else set()))
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in ids}


@pytest.mark.parametrize("size", [2, 5])
def test_near_dup_is_what_all_pairs_give(spark, size):
    rows = corpus()
    out = near_dup.near_dup(docs(spark, rows), size, 80).collect()
    want = groups_by_hand(rows, size, 80)
    assert len(out) == len(rows)
    assert {r.doc_id: r.component_id for r in out} == want
    assert all(r.kept == (r.doc_id == r.component_id) and r.n_shingles >= 0 for r in out)


def test_blocks_change_nothing(spark, monkeypatch):
    base = prose(77, 120)
    rows = [(i, edited(base, i, i % 31)) for i in range(150)] + [(1000 + i, prose(3, 30) + " " + prose(100 + i, 30)) for i in range(60)]
    want = groups_by_hand(rows, 2, 80)
    assert 20 < len(set(want.values())) < 200
    for block, size in ((1024, 32_000_000), (7, 3000)):
        monkeypatch.setattr(near_dup, "BLOCK", block)
        monkeypatch.setattr(near_dup, "BLOCK_BYTES", size)
        assert {r.doc_id: r.component_id for r in near_dup.near_dup(docs(spark, rows), 2, 80).collect()} == want


def test_near_dup_of_null_ids_and_chains(spark):
    words = [f"w{i}" for i in range(400)]
    chain = [(i, " ".join(words[8 * i : 8 * i + 100])) for i in range(30)]
    out = {r.doc_id: (r.component_id, r.kept) for r in near_dup.near_dup(docs(spark, [*chain, (None, chain[0][1]), (None, None)]), 2).collect()}
    assert {v[0] for k, v in out.items() if k is not None} == {0} and out[None] == (None, True)


def test_components_of_paths_and_stars(spark):
    n = 200
    edges = [(i + 1, i) for i in range(n)] + [(1000 + i, 1000) for i in range(1, 50)] + [(5000, 4000), (4000, 5000), (7, 7)]
    got = {r.node: r.component for r in near_dup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(n + 1)) and got[1049] == 1000 and got[5000] == 4000


def test_minhash_agreement_follows_similarity():
    r = np.random.default_rng(1)
    a = np.unique(r.integers(0, 2**63, 1000).astype(np.uint64))
    b = np.concatenate([a[:800], np.unique(r.integers(0, 2**63, 200).astype(np.uint64))])
    agree = (near_dup.minhashes(a, 2000) == near_dup.minhashes(b, 2000)).mean()
    assert abs(agree - 2 / 3) < 0.05
    assert shingles(b"", 2).size == 0 and shingles(b"A b", 5).tolist() == shingles(b"a  B\n", 5).tolist()


# ---- 4: url filters ----


def judged_by_hand(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for v, h, p in rules if f".{host}".endswith(f".{h}") and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def test_url_filter_is_what_a_loop_gives(spark):
    r = random.Random(5)
    hosts = ["com", "example.com", "EXAMPLE.com", "www.example.com", "badexample.com", "a.b.example.net", "net", "x.org", "example.com:80", "com.", ""]
    paths = ["", "/", "/en/", "/en/7", "/en/71/x", "/de/8", "/de", "/EN/", "/en?x=/en/", "/a/b/c/d", "#/en/"]
    urls = [f"https://{r.choice(hosts)}{r.choice(paths)}" for _ in range(400)] + [None, "", "no scheme", "a://b://c/en/", "http://com/en/\nx"]
    urls += ["http://a,b.example.com/en/", "http://😀.example.com/en/7", "http://example.com\x01/en/"]
    more = [("block", "b.a.example.com", "/"), ("block", "com/example", ""), ("allow", "com", "/"), ("block", "example.com", ""), ("allow", "a.b.example.net", "/a/b"), ("block", "a.b.example.net", "/a/b"), ("block", "b.example.net", "/a/b/c")]
    rows = [(i, u) for i, u in enumerate(urls)] + [(None, urls[0]), (3, urls[3])]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("x") for c in ("host", "path", "range", "kind", "verdict")})
    for rules in (URL_RULES, URL_RULES + more, []):
        frame = url_filter.rules_frame(spark, rules) if rules else spark.createDataFrame([], "host string, path string, verdict string")
        got = by_id(url_filter.url_filter(pages, frame), "page_id", "host", "path", "rule", "verdict")
        assert got == sorted(((i, *judged_by_hand(u, rules)) for i, u in rows), key=repr)


def test_the_url_query_and_its_sql_have_the_rules_of_the_contract(spark, tmp_path):
    rules = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
    urls = [f"https://{h}{p}" for h in ("a.com", "x.example.com", "a.net", "x.example.net", "example.org") for p in ("/en/1", "/en/71", "/de/1", "/de/81", "/es/1", "/fr/8")]
    rows = [*enumerate([*urls, None, "x"])]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    want = sorted(((i, *judged_by_hand(u, rules)) for i, u in rows), key=repr)
    assert by_id(op4_url_filter(spark, str(tmp_path)), "page_id", "host", "path", "rule", "verdict") == want
    duckdb = pytest.importorskip("duckdb")
    found = duckdb.sql(SQL["op4_url_filter"].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'")).fetchall()
    assert sorted(found, key=repr) == want


@given(st.lists(st.text("ab/", max_size=6), max_size=8, unique=True), st.text("ab/", max_size=10))
def test_longest_prefix(paths, path):
    table = sorted((p, len(p), "block") for p in paths)
    want = max((p for p in paths if path.startswith(p)), key=len, default=None)
    got = url_filter.longest(table, path)
    assert (got and got[1]) == want


# ---- 5: personal data ----

BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def spans_by_hand(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 12 <= len(digits) <= 19 and pii.luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]()
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.text("a0159.@+-() %_é\n", max_size=60))
def test_base_spans_are_the_patterns(text):
    assert pii.base_spans(text) == spans_by_hand(text)


def test_base_spans_of_made_up_texts_and_long_runs():
    for text, _ in pii.examples(500, seed=99):
        assert pii.base_spans(text) == spans_by_hand(text)
    assert pii.base_spans("a" * 200_000) == pii.base_spans("1" * 200_000) == []


#: Written by hand, apart from the generator that the field was trained on: the entity of each line stands between ⟦ and ⟧, its kind before it.
WRITTEN = """
phone Please ring ⟦(212) 555-0187⟧ after six and ask for Dana.
phone Her new mobile is ⟦917-555-0142⟧, the old one is dead.
phone Unser Büro: Tel. ⟦030 9018 2077⟧ (werktags).
phone The clinic can be reached on ⟦020 7946 0958⟧ at any time.
phone Contact reception at ⟦555.867.5309⟧ for keys
phone tél. ⟦01 42 68 53 00⟧ le matin
phone llama al ⟦0034 91 123 4567⟧ por favor
phone Fax: ⟦(0171) 555 0199⟧. No calls.
phone I left a message on ⟦1-800-555-0134⟧ twice.
phone Toll free ⟦800 555 0175⟧; leave your name.
phone Zimmer 12, Apparat ⟦0621/5550123⟧
phone whatsapp me: ⟦+44 7700 900123⟧ cheers
phone office line ⟦(503)555-0110⟧ ext later
phone he said his number was ⟦646 555 0121⟧ I think
phone Phone ⟦312-555-0190⟧, or write.
email Send the form to ⟦jo.smith@mail.example.com⟧ by Friday.
email questions? ⟦help-desk@uni-bonn.de⟧
email Kontakt: ⟦m_weber79@web.de⟧, Danke!
email cc ⟦a@b.co⟧ and file it
email escribe a ⟦ventas@tienda.com.mx⟧ hoy
email (⟦first.last+lists@dept.example.org⟧)
card paid with ⟦4539 1488 0343 6467⟧ exp 09/27
card My visa is ⟦4556-7375-8689-9855⟧, don't tell.
card card no ⟦5500005555555559⟧ was declined
card Karte: ⟦6011 0009 9013 9424⟧ gesperrt
ip the request came from ⟦203.0.113.77⟧ at noon
ip ping ⟦10.20.30.40⟧ failed again
ip server ⟦192.168.1.254⟧ is down, reboot it
ip Deny all from ⟦198.51.100.23⟧, thanks
ip gateway=⟦172.16.0.1⟧ mask below
phone Dr. Lund answers ⟦(415) 555-0101⟧ on weekdays
phone the plumber, ⟦0161 496 0753⟧, comes tomorrow
phone dial ⟦503.555.0166⟧ and wait
phone ring Tom at ⟦604-555-0149⟧!
phone neue Nummer ⟦089/5550177⟧ ab Mai
email reply to ⟦k.ito_22@example.ne.jp⟧ soon
email <⟦root@db-7.internal.example⟧>
card charge ⟦3714 4963 5398 4310⟧ today
ip log: ⟦8.8.4.4⟧ timed out, retry
ip from ⟦100.64.12.9⟧ to nowhere
""".strip()
CLEAN = """
The meeting on 2021-03-14 15:09 was moved to 16:30.
Invoice 20210314-000123 covers 12,345,678.90 euros.
ISBN 978-3-16-148410-0 is out of print.
Build 10.4.19041.1237.22 fixes it; see ticket #123456789.
sha1 da39a3ee5e6b4b0d3255bfef95601890afd80709 matches
Pi is 3.14159265358979 and e is 2.718281828.
lat 48.85837009, lon 2.29448100 from the map
scores: 10 12 14 16 18 20 22 24 26
Order 1234567890123 shipped in 3 boxes.
follow @someone and meet @ noon, room 5
population 8,804,190 in 2020, 8,175,133 in 2010
Part no. 555-11223344-9987-1 fits.
""".strip().split("\n")


def test_the_field_alone_on_texts_that_it_was_not_generated_from():
    field, found, false = pii.field(), [], []
    for line in WRITTEN.split("\n"):
        kind, text = line.split(" ", 1)
        a, b = text.index("⟦"), text.index("⟧") - 1
        text = text.replace("⟦", "").replace("⟧", "")
        got = [x for lo, hi in pii.stretches(text) for x in field.best(text, lo, hi)]
        found.append((a, pii.KINDS.index(kind), b) in got)
    for text in CLEAN:
        false += [text[x:y] for lo, hi in pii.stretches(text) for x, _, y in field.best(text, lo, hi)]
    assert sum(found) / len(found) >= 0.9, [line for line, ok in zip(WRITTEN.split("\n"), found) if not ok]
    assert len(false) <= 1, false


def test_the_field_finds_held_out_entities_and_leaves_other_numbers():
    field, hit, made, false = pii.field(), 0, 0, 0
    for text, gold in pii.examples(400, seed=1234):
        got = {x for lo, hi in pii.stretches(text) for x in field.best(text, lo, hi)}  # the field's own, without the base patterns
        hit += len(set(gold) & got)
        made += len(gold)
        false += len(got - set(gold))
    assert hit / made > 0.9 and false / made < 0.1


def test_decoding_is_linear_and_stretches_are_whole():
    r = random.Random(1)
    text = " ".join(f"({r.randint(200, 900)}) {r.randint(200, 900)}-{r.randint(1000, 9999)}" for _ in range(2000))
    assert pii.stretches(text) == [(0, len(text))]  # not cut at any length
    whole = pii.all_spans(text, pii.field())
    half = pii.all_spans(text[: 16 * 1000 - 1], pii.field())
    assert [x for x in whole[1] if x[2] < 15_900] == [x for x in half[1] if x[2] < 15_900]  # what comes later changes nothing far before it
    long = "x" * 100 + "@" + "y" * 100 + ".com"
    assert pii.stretches("a " * 50 + long + " b" * 50)[0] == (100 - pii.MARGIN, 100 + len(long) + pii.MARGIN)


def test_segmentation_is_the_best_of_all(spark):
    field = pii.field()
    for text, _ in pii.examples(40, seed=5):
        cuts, spans = pii.candidates(text, 0, len(text))
        if not spans or len(spans) > 14:
            continue
        value, best = field.scores(spans).max(axis=1), 0.0
        for pick in range(1 << len(spans)):
            chosen = [i for i in range(len(spans)) if pick >> i & 1]
            places = sorted((spans[i][0], spans[i][1]) for i in chosen)
            if all(x[1] <= y[0] for x, y in zip(places, places[1:])):
                best = max(best, sum(value[i] for i in chosen))
        by = {(cuts[i], cuts[j]): v for (i, j, _), v in zip(spans, value)}
        assert math.isclose(sum(by[a, b] for a, _, b in field.best(text, 0, len(text))), best, abs_tol=1e-9)


def test_personal_data_rows(spark):
    rows = [(1, "é mail a.b@c.de, +1 (415) 555-2671; 10.0.0.1"), (2, None), (3, ""), (None, "x@y.zz"), (1, "4111 1111 1111 1111")]
    got = by_id(pii.personal_data(docs(spark, rows)), "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    assert got == sorted(((i, *[sum(k == n for _, k, _ in spans_by_hand(t or "")) for n in range(4)], sha(pii.spelled(spans_by_hand(t or "")))) for i, t in rows), key=repr)
    assert by_id(pii.masked(docs(spark, rows[:1])), "text") == [("é mail <email>, <phone>; <ip>",)]


# ---- 6: chat formatting ----


@settings(deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "[:]"]), st.text("ab<[]/\\ sINST>:\n", max_size=20)), max_size=6))
def test_chats_read_back(turns):
    text, mask = chat_format.write_chat(turns)
    assert chat_format.read_chat(text) == turns
    assert [chat_format.unescape(text[a:b]) for a, b in mask] == [t for r, t in turns if r == "assistant"]


def test_best_branches_of_reply_trees(spark):
    rows = [
        (1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 1.0), (1, 3, 1, "assistant", "good", 5.0), (1, 4, 3, "user", "more", 1.0), (1, 5, 3, "user", "else", 2.0),
        (2, 1, 9, "user", "parent is missing", None), (3, 1, 2, "user", "cycle", 1.0), (3, 2, 1, "user", "cycle", 1.0), (None, 1, None, "user", "x", 1.0), (4, 1, None, None, None, 1.0), (4, 1, None, None, None, 1.0),
    ]
    messages = spark.createDataFrame(rows, "conv_id long, msg_id long, parent_id long, role string, text string, score double")
    got = {(r.conv_id, r.branch): [t for _, t in chat_format.read_chat(r.formatted)] for r in chat_format.chat_format(messages, branches=2).collect()}
    assert got == {(1, 1): ["q", "good", "else"], (1, 2): ["q", "good", "more"], (2, 1): ["parent is missing"], (4, 1): [""]}


def test_each_tree_of_a_conversation_has_its_best_branches(spark):
    rows = [(1, 1, None, "a", 1.0), (1, 2, 1, "b", 1.0), (1, 3, 1, "c", 2.0), (1, 4, None, "d", 9.0), (1, 5, 4, "e", 8.0), (1, 6, 4, "f", 7.0), (1, 7, 99, "g", 0.0)]
    rows += [(1, 100 + i, 99 + i if i else None, f"t{i}", 0.5) for i in range(11)]
    messages = spark.createDataFrame([(c, m, p, "user", t, s) for c, m, p, t, s in rows], "conv_id long, msg_id long, parent_id long, role string, text string, score double")
    told = lambda n: {r.branch: "".join(t for _, t in chat_format.read_chat(r.formatted)) for r in chat_format.chat_format(messages, branches=n).collect()}
    long = "".join(f"t{i}" for i in range(11))
    assert told(1) == {1: "de", 2: "ac", 3: long, 4: "g"}
    assert told(2) == {1: "de", 2: "df", 3: "ac", 4: "ab", 5: long, 6: "g"}


def test_long_conversations_and_digests(spark):
    turns = [(1, i, "user" if i % 2 == 0 else "assistant", None if i == 7 else f"t{i} <s>") for i in range(70)] + [(2, None, "assistant", "x"), (2, 1, "user", "y"), (2, 1, "user", "y")]
    messages = chat_format.thread_messages(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in chat_format.chat_digests(chat_format.chat_format(messages)).collect()}
    assert got[1].n_turns == 70 and got[1].turns_sha256 == sha("".join(f"{r}\n{t or ''}\n" for _, _, r, t in turns[:70]))
    loss = "".join(t or "" for _, _, r, t in turns[:70] if r == "assistant")
    assert (got[1].loss_chars, got[1].loss_sha256) == (len(loss), sha(loss))
    assert (got[2].n_turns, got[2].loss_chars) == (3, 1)


# ---- 7: decontamination ----

ITEMS = [(i, prose(500 + i, 12 + i) + ". " + prose(600 + i, 6) + ".") for i in range(30)] + [(90, None), (91, ""), (92, "two words"), (93, prose(1, 200)), (1, "again " + prose(77, 9))]


def leaks_by_hand(rows, items, size, percent):
    """Every window as long as the passages of the operator, at every word."""
    out = set()
    longest = max(len(decontaminate.plain_words((t or "").encode())) for _, t in items)
    parts = [(item, [set(decontaminate.runs(decontaminate.plain_words(x.encode()), size)) for x in (t, *decontaminate.question_and_answer(t))]) for item, t in items if t]
    for doc, text in rows:
        words = decontaminate.plain_words((text or "").encode())
        for at in range(0, max(1, len(words) - longest), longest):
            window = words[at : at + 2 * longest]
            own = {tuple(window[i : i + n]) for n in range(1, size + 1) for i in range(len(window) - n + 1)}
            out |= {(doc, item) for item, needles in parts if needles[0] and all(100 * len(x & own) >= percent * len(x) for x in needles)}
    return out


def test_a_question_without_its_answer_is_no_leak(spark):
    asked, told = prose(1, 60) + "?", prose(2, 6) + "."
    items = spark.createDataFrame([(1, f"{asked} {told}"), (2, prose(3, 25) + ".")], "item_id long, text string")
    rows = [(1, asked), (2, f"{asked} {told}"), (3, told), (4, f"{prose(4, 9)} {asked} {prose(5, 9)}"), (5, prose(3, 25)), (6, f"{asked} {edited(told, 1, 4)}")]
    find = lambda **k: {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs(spark, rows), items, **k).collect()}
    assert find() == {(2, 1), (5, 2)}
    assert find(answer_percent=0) == {(1, 1), (2, 1), (4, 1), (5, 2), (6, 1)}


def test_an_index_is_bounded_in_memory():
    import tracemalloc

    items, chars = [], 0
    while chars < decontaminate.SHARD_CHARS // 8:  # words that no other item has: the largest vocabulary for a length
        items.append((len(items), " ".join(f"{len(items):x}{k:x}z" for k in range(200))))
        chars += len(items[-1][1])
    df = Counter(w for _, t in items for w in decontaminate.plain_words(t.encode()))
    tracemalloc.start()
    index = decontaminate.Index(items, 5, 80, len(items), df, 200.0)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert index.bounds.nbytes <= decontaminate.BOUNDS_BYTES + 4 * len(index.vocabulary)
    assert held < 64_000_000 + 200 * chars and held * 8 < 1_000_000_000


def test_leaks_are_what_a_loop_finds(spark):
    rows = [(i, prose(i, 300)) for i in range(30)]
    rows += [(100 + i, prose(i, i * 7) + " " + (ITEMS[i][1]).upper() + "! " + prose(i + 1, 150)) for i in range(30)]
    rows += [(200 + i, prose(i, 40) + " " + edited(ITEMS[i][1], i, 1) + " " + prose(i, 40)) for i in range(30)]
    rows += [(300, ITEMS[33][1] + " x"), (301, None), (302, ""), (None, ITEMS[0][1]), (303, " ".join(t for _, t in ITEMS[:30])), (304, prose(3, 30_000) + " " + ITEMS[7][1]), (305, "the two, WORDS here"), (306, "two other words")]
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("score", F.lit("x"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs(spark, rows), items).collect()}
    want = leaks_by_hand(rows, ITEMS, 5, 80)
    assert got == want and len(want) > 60 and (305, 92) in got
    whole = {r.item_id: r for r in decontaminate.leaks(docs(spark, [(1, f"x {ITEMS[0][1]} y")]), items).collect()}[0]
    assert (whole.overlap, whole.question_overlap, whole.answer_overlap) == (1.0, 1.0, 1.0)
    kept = decontaminate.decontaminated(docs(spark, rows), items)
    assert kept.columns == docs(spark, []).columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((i for i, _ in rows if i not in {d for d, _ in want}), key=repr)


def test_shards_change_nothing(spark, monkeypatch):
    rows = [(i, prose(i, 30) + " " + ITEMS[i][1]) for i in range(30)]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    whole = by_id(decontaminate.leaks(docs(spark, rows), items), "doc_id", "item_id")
    monkeypatch.setattr(decontaminate, "SHARD_ITEMS", 7)
    assert by_id(decontaminate.leaks(docs(spark, rows), items), "doc_id", "item_id") == whole


def test_wand_retrieves_all_above_the_threshold():
    r = random.Random(2)
    items = [(i, " ".join(f"w{int(r.expovariate(0.05))}" for _ in range(r.randrange(3, 25)))) for i in range(150)]
    df = Counter(w for _, t in items for w in set(t.encode().split()))
    index = decontaminate.Index(items, 5, 80, 150, df, 12.0)
    for _ in range(200):
        terms = sorted(set(r.sample(range(len(index.postings)), 12)))
        score = defaultdict(float)
        for t in terms:
            for item, x in zip(*index.postings[t][:2], strict=True):
                score[item] += x
        for least in (0.3, 1.0):
            got = dict(index.retrieve(terms, least))
            assert set(got) == {i for i, x in score.items() if x >= least}
            assert all(math.isclose(got[i], score[i]) for i in got)


# ---- 8: quality ----


def test_field_marginals_are_what_all_labelings_give():
    r = np.random.default_rng(4)
    for n in (1, 2, 6):
        emit, trans = r.normal(size=n) * 2, r.normal(size=(2, 2))
        total, good = 0.0, np.zeros(n)
        for code in range(1 << n):
            y = [code >> i & 1 for i in range(n)]
            weight = math.exp(sum(e for e, s in zip(emit, y) if s) + sum(trans[a, b] for a, b in zip(y, y[1:])))
            total += weight
            good += weight * np.array(y)
        assert np.allclose(quality.chain_marginals(emit.tolist(), trans), good / total)
        many, pairs = quality.batch_marginals(emit[None], trans, np.ones((1, n), dtype=bool))
        assert np.allclose(many[0], good / total) and np.allclose(pairs.sum(axis=(2, 3)), 1)


def test_quality_on_held_out_documents(spark):
    clean = [(i, "\n".join(prose(i * 9 + k, 12).capitalize() + "." for k in range(1 + i % 7))) for i in range(200)]
    junk = [(1000 + i, "\n".join(prose(i * 9 + k, 12).upper().replace(" ", "!! ") for k in range(1 + i % 7))) for i in range(100)]
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in clean] + [(i, 0, 0) for i, _ in junk] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    rows = clean + junk + [(5000, None), (5001, ""), (None, clean[0][1])]
    out = quality.quality_scores(docs(spark, rows), labels, 50).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    held = [r for r in out if r.held_out and r.doc_id < 2000]
    assert held and all((zlib.crc32(str(r.doc_id).encode()) % 3 == 1) == r.held_out for r in out if r.doc_id is not None)
    assert sum(r.predicted == (r.doc_id < 1000) for r in held) / len(held) > 0.97
    kept = {r.doc_id for r in quality.quality_filter(docs(spark, rows), labels, 50).collect()}
    assert kept == {r.doc_id for r in out if r.predicted}


def mixed_document(seed, good):
    """Lines with the label of each: good ones are sentences, bad ones shouts or menus, in runs of two to five; `good` is the share of good runs."""
    r, lines = random.Random(seed), []
    while len(lines) < 16:
        kind = r.random() < good
        for _ in range(r.randrange(2, 6)):
            body = prose(r.randrange(10**6), 10, 50_000)
            lines.append((body.capitalize() + ".", 1) if kind else (body.upper().replace(" ", r.choice([" > ", "!!! ", " # "])), 0))
    return [x for x, _ in lines], [y for _, y in lines]


def test_lines_of_mixed_documents_get_their_own_labels():
    chains, lengths = [], []
    for i in range(240):
        lines, kinds = mixed_document(i, 0.85 if i % 2 else 0.15)
        own, weight = quality.line_features("\n".join(lines))
        chains.append((own, int((np.array(kinds) * weight).sum() * 2 > weight.sum())))
        lengths.append(weight)
    field = quality.LineField.fit(chains, lengths)
    right = lone = seen = alone = 0
    for i in range(1000, 1060):
        lines, kinds = mixed_document(i, 0.5)
        good = field.marginals(quality.line_features("\n".join(lines))[0]) >= 0.5
        right += sum(good == np.array(kinds))
        seen += len(kinds)
        lone += sum(g == k for g, k, share in zip(good, kinds, [np.mean(kinds)] * len(kinds)) if (share > 0.5) != k)
        alone += sum((np.mean(kinds) > 0.5) != k for k in kinds)
    assert right / seen > 0.95 and lone / alone > 0.9  # the lines against their document's kind too
    stay, change = np.diag(field.transitions).sum(), field.transitions.sum() - np.diag(field.transitions).sum()
    assert stay > change


def test_quality_without_labels_is_a_half(spark):
    out = quality.quality_scores(docs(spark, [(1, "a")]), spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert [(r.score, r.predicted) for r in out] == [(0.5, 1)]


# ---- 9: exact dedup ----


@settings(max_examples=30, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=300))
def test_fuse_filters_hold_their_keys(keys):
    built = exact_dedup.BinaryFuse.load(exact_dedup.BinaryFuse.build(np.array(sorted(keys), dtype=np.uint64)).dump())
    assert all(k in built for k in keys)


def test_fuse_filters_hold_little_else():
    r = np.random.default_rng(8)
    built = exact_dedup.BinaryFuse.build(r.integers(0, 2**63, 5000).astype(np.uint64))
    assert built.contains(r.integers(0, 2**63, 100_000).astype(np.uint64)).mean() < 0.001
    assert built.prints.nbytes < 5000 * 3


def test_exact_dedup_is_what_a_dictionary_gives(spark):
    rows = corpus() + [(None, "a b"), (None, "null only"), (None, "null only"), (400, "A b"), (401, "a b ")]
    best, size = {}, Counter()
    for doc, text in rows:
        size[text or ""] += 1
        best[text or ""] = max((x for x in (best.get(text or ""), doc) if x is not None), default=None)
    want = sorted(((d, best[t or ""], size[t or ""], best[t or ""] is None or d == best[t or ""], sha(t or "")) for d, t in rows), key=repr)
    frame = docs(spark, rows)
    for split in (None, F.col("doc_id") < 100, F.lit(True), F.lit(False)):
        assert by_id(exact_dedup.exact_dedup(frame, split), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want


# ---- 10: packing ----


def test_packing_places_every_id_once(spark):
    from tokenizers import Tokenizer

    rows = corpus() + [(500, prose(1, 20_000)), (None, "x"), (501, "<|endoftext|> é\n\n  "), (502, "\u00a0\ufeff 1234 don't")]
    whole = Tokenizer.from_file(tokenizer_path())
    want = Counter((d, tuple([*whole.encode(t or "", add_special_tokens=False).ids, 0])) for d, t in rows)
    pieces = packing.pack(docs(spark, rows).repartition(3), tokenizer_path()).collect()
    places = defaultdict(list)
    for p in pieces:
        places[p.sequence_id].append((p.offset, p.length))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    used = sum(p.length for p in pieces)
    assert used == sum(len(ids) * n for (_, ids), n in want.items())
    assert sum(sum(n for _, n in s) < 1000 for s in places.values()) <= 3
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id, p.doc_tokens].append((p.start, p.length, p.ids_crc32))
    for (doc, ids), n in want.items():
        data = np.array(ids, dtype="<u4")
        mine = [x for x in by_doc[doc, len(ids)]]
        assert all(zlib.crc32(data[a : a + m].tobytes()) == c for a, m, c in mine)
        assert sum(m for _, m, _ in mine) == len(ids) * n


@given(st.integers(0, 5000), st.sampled_from([64, 1024]))
def test_cuts_cover_and_fill(n, capacity):
    parts = packing.cuts(n, capacity, 1 / 64)
    assert sum(parts) == n and all(0 < p <= capacity for p in parts)
    assert all(capacity - capacity // p * p <= max(capacity / 64, capacity // p) for p in parts)
