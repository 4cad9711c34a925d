"""The pipeline's stages, one after the other, on a small corpus with cases planted in it."""

import random

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("sf"))
    r = random.Random(1)
    prose = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(n)).capitalize() + "."
    item = prose(30)
    rows = [(i, "\n".join(prose(20) for _ in range(4))) for i in range(120)]
    near = rows[3][1].split()
    near[40] = "changed"
    rows += [(200, rows[0][1]), (201, rows[0][1]), (202, " ".join(near)), (203, rows[7][1] + "\n" + item), (204, None), (205, "")]
    rows += [(300 + i, "\n".join(prose(20).upper().replace(" ", "!! ") for _ in range(4))) for i in range(60)]
    docs = [(i, t, "en", "src", len(t or "")) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, int(i < 300), 0) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    return sf


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, kept = docs.columns, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.written(stage(spark, docs, tables), f"test-{i}")
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            kept.append({r.doc_id for r in docs.collect()})
    quality, exact, near, clean = kept
    assert not {i for i in quality if i >= 300} and len([i for i in quality if i < 200]) >= 118
    assert quality - exact == ({0, 200} | ({204} if {204, 205} <= quality else set()))
    assert exact - near == {202}
    assert near - clean == {203}
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == clean
    assert corpus_pipeline.run(spark, tables).count() == docs.count()


def test_rows_that_share_a_doc_id_or_have_none(spark):
    r = random.Random(5)
    prose = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    a, b, c, d, e = (prose(60) for _ in range(5))
    near = lambda t: t.rsplit(" ", 1)[0] + " changed"
    rows = [(1, a), (2, a), (1, b), (3, c), (3, c), (None, d), (4, d), (None, e), (None, e)]
    frame = lambda rows: spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    left = lambda df: sorted(((x.doc_id, x.text) for x in df.collect()), key=repr)
    stages = dict(corpus_pipeline.STAGES)
    assert left(stages["exact dedup"](spark, frame(rows), "")) == sorted([(2, a), (1, b), (3, c), (4, d), (None, e)], key=repr)
    rows = [(1, a), (2, near(a)), (2, b), (3, c), (None, near(c)), (None, d), (None, near(d))]
    got = left(stages["near dedup"](spark, frame(rows), ""))
    assert [x for x in got if x[0] is not None] == sorted([(1, a), (2, b), (3, c)], key=repr) and len(got) == 4


CLASH = ("_key", "_row", "_again", "key", "kept", "text_sha256", "score", "digest", "hub", "n")


def test_stages_on_empty_tables_and_clashing_columns(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").withColumns({c: F.lit("x") for c in CLASH})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(40), tables)
        assert out.columns == docs.columns and out.count() > 0, name
        assert stage(spark, docs.where("false"), tables).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.where("false"), tables).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(5), tables).select("doc_id").distinct().count() == 5


def shingled(text, size):
    words = (text or "").lower().split()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} or ({tuple(words)} if words else set())


def test_stages_are_what_loops_give(spark, tmp_path):
    r = random.Random(8)
    prose = lambda n: " ".join(f"w{r.randrange(4000)}" for _ in range(n))
    items = [(i, prose(25) + ". " + prose(8) + ".") for i in range(6)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(i, prose(r.randrange(5, 120))) for i in range(80)]
    for k in range(60):
        words = rows[k % 12][1].split()
        for _ in range(k % 4):
            words[r.randrange(len(words))] = "other"
        rows.append((r.choice([None, 100 + k, 7]), " ".join(words)))
    rows += [(300 + i, prose(30) + " " + items[i % 6][1].split(". ")[i % 2] + " " + prose(30)) for i in range(6)] + [(400 + i, prose(30) + " " + t + " " + prose(30)) for i, t in items] + [(500, None), (501, ""), (None, None), (502, " ")]
    frame = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    stages, place = dict(corpus_pipeline.STAGES), lambda d: (d is None, d or 0)
    kept = lambda name, df: sorted(((x.doc_id, x.text) for x in stages[name](spark, df, str(tmp_path)).collect()), key=repr)
    # exact: of each text the largest doc_id
    best = {}
    for d, t in rows:
        if (t or "") not in best or best[t or ""][0] is None or (d is not None and d > best[t or ""][0]):
            best[t or ""] = (d, t)
    exact = kept("exact dedup", frame)
    assert [(d, t or "") for d, t in exact] == [(d, t or "") for d, t in sorted(((d, t or "") for d, t in best.values()), key=repr)] or sorted((repr(d), t or "") for d, t in exact) == sorted((repr(d), t or "") for d, t in best.values())
    # near: of each group of linked texts the smallest doc_id
    left = sorted(exact, key=lambda x: place(x[0]))
    sets, root = [shingled(t, 5) for _, t in left], list(range(len(left)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(left)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    first = {find(i) for i in range(len(left))}
    near = kept("near dedup", spark.createDataFrame([(d, t, "en") for d, t in exact], frame.schema))
    assert sorted(repr(d) for d, _ in near) == sorted(repr(left[i][0]) for i in first)
    # decontamination: texts without a whole item
    clean = kept("decontamination", spark.createDataFrame([(d, t, "en") for d, t in near], frame.schema))
    assert sorted(map(repr, clean)) == sorted(repr((d, t)) for d, t in near if not any(item in (t or "") for _, item in items))
    # packing: each document's tokens once, in sequences of at most 1024
    from tokenizers import Tokenizer

    from domspark.llm.queries import tokenizer_path

    tokens = Tokenizer.from_file(tokenizer_path())
    packed = stages["packing"](spark, spark.createDataFrame([(d, t, "en") for d, t in clean if d is not None], frame.schema), str(tmp_path)).collect()
    per, full = {}, {}
    for x in packed:
        per.setdefault((x.doc_id, x.doc_tokens), []).append(x.length)
        full[x.sequence_id] = full.get(x.sequence_id, 0) + x.length
    assert max(full.values()) <= 1024
    want = sorted(len(tokens.encode(t or "", add_special_tokens=False).ids) + 1 for d, t in clean if d is not None)
    assert sum(sum(v) for v in per.values()) == sum(want)


def test_near_stage_broadcasts_no_more_rows_than_documents(spark):
    r = random.Random(9)
    prose = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    texts = [prose(60) for _ in range(240)]
    rows = [(i, t, "en") for i, t in enumerate(texts + [t.rsplit(" ", 1)[0] + " changed" for t in texts[:60]])]
    docs = corpus_pipeline.written(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "test-broadcasts")
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsparkSession.sharedState().statusStore()
    listed = lambda seq: [seq.apply(i) for i in range(seq.size())]
    old = {e.executionId() for e in listed(store.executionsList())}
    left = dict(corpus_pipeline.STAGES)["near dedup"](spark, docs, "")
    assert sorted(x.doc_id for x in left.collect()) == list(range(240))
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    sizes = []
    for e in listed(store.executionsList()):
        if e.executionId() not in old:
            values = store.executionMetrics(e.executionId())
            kept = [m for n in listed(store.planGraph(e.executionId()).allNodes()) if n.name() == "BroadcastExchange" for m in listed(n.metrics())]
            found = [values.get(m.accumulatorId()) for m in kept if m.name() == "number of output rows"]
            sizes += [int(v.get().replace(",", "")) for v in found if v.isDefined()]
    assert sizes and max(sizes) <= len(rows)


def test_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
