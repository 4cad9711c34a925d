"""MinHash near-dedup with tensored banding, every link confirmed on the full shingle sets.

Two collections of `tables` short codes each are computed per document, a code being `width` minhashes. Every pair of a code of the
first and a code of the second collection is the key of one table, so `tables` squared tables of 2 * width minhashes each cost
2 * tables * width minhashes instead of tables squared times that many. With the default 10 and 2, a pair of similarity 0.8 misses
all 100 tables once in about 13,000 cases, a pair of 0.9 once in some eight million.

Equal shingle sets are one class from the start, represented by their smallest doc_id. The classes that share a key are compared
with the first of the key, its hub, and confirmed links are contracted to components. A class's full set is kept by the hub's set: as bits
of what it has of it, and the rest. Where the classes of a hub still are several components, those outside the largest are compared with
all others of the hub by these, in blocks, and only links that join components come out. So no bucket is expanded into all its pairs as
rows, no text is read again for it, and no link between components is left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import mixed, shingles, written

BLOCK, BLOCK_BYTES = 1024, 32_000_000  # members of a hub, and bytes of their sets, in a block; a comparing task holds two blocks


def minhashes(hashes: np.ndarray, count: int) -> np.ndarray:
    """The upper 32 bits of the least of each of `count` permutations of a set of 64-bit hashes."""
    with np.errstate(over="ignore"):
        seeds = mixed(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]
        odd = mixed(seeds) | np.uint64(1)
        least = None
        for at in range(0, len(hashes), 4096):
            part = ((hashes[None, at : at + 4096] ^ seeds) * odd).min(axis=1)
            least = part if least is None else np.minimum(least, part)
    return (least >> np.uint64(32)).astype(np.uint32)


def codes(sketch: np.ndarray, tables: int, width: int) -> np.ndarray:
    """The codes of both collections: `width` minhashes each, and the place of the code."""
    with np.errstate(over="ignore"):
        out = np.arange(1, 2 * tables + 1, dtype=np.uint64)
        for column in sketch.reshape(2 * tables, width).T:
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + column.astype(np.uint64))
    return out.view(np.int64)


_SIGNED = "doc_id long, n_shingles long, digest binary, sketch binary, left array<long>, right array<long>"


def _sign(size: int, tables: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs = pa.list_(pa.int64())
        for batch in batches:
            rows = {n: [] for n in ("n", "digest", "sketch", "left", "right")}
            for text in batch.column(1):
                s = shingles(text.as_py(), size)
                made = (len(s), None, None, None, None)
                if len(s):
                    sketch = minhashes(s, 2 * tables * width)
                    both = codes(sketch, tables, width)
                    made = (len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), sketch.tobytes(), both[:tables], both[tables:])
                for name, value in zip(rows, made, strict=True):
                    rows[name].append(value)
            kinds = (pa.int64(), pa.binary(), pa.binary(), longs, longs)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True))], names=["doc_id", "n_shingles", "digest", "sketch", "left", "right"])

    return run


def sharing(reps: DataFrame) -> DataFrame:
    """(id, hub) of the ids that share a key, the hub being the least of them.

    A row of reps makes tables squared keys, which Spark's size estimate leaves out: it would broadcast them through the driver, hence the hint.
    """
    keys = reps.select("id", F.explode("left").alias("l"), "right").select("id", "l", F.explode("right").alias("r")).select(F.xxhash64("l", "r").alias("key"), "id")
    first = keys.groupBy("key").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "first")
    return keys.join(first.hint("merge"), "key").select("id", F.col("first").alias("hub")).distinct()


_MEASURED = "hub long, frame long, id long, n long, both long, bits binary, rest binary"


def framed(own: np.ndarray, frame: np.ndarray) -> tuple[int, bytes, bytes]:
    """A set by a frame set: how many of the frame's members it has, which of them as bits, and its other members."""
    inside = np.isin(frame, own, assume_unique=True)
    return int(inside.sum()), np.packbits(inside).tobytes(), np.setdiff1d(own, frame, assume_unique=True).tobytes()


def _measure(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(),) * 5 + (pa.binary(),) * 2
        names = [c.split()[0] for c in _MEASURED.split(", ")]
        last = (None, None, 0)
        for batch in batches:
            out: list[tuple] = []
            for a, b, ta, tb in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if last[0] != tb:
                    s = shingles(tb, size)
                    last = (tb, s, int(np.bitwise_xor.reduce(mixed(s)).view(np.int64)))
                own = last[1] if a == b else shingles(ta, size)
                out.append((b, last[2], a, len(own), *framed(own, last[1])))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    return run


def measured(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """Each id's full set by its hub's, for pairs (id, hub). The hub recurs, so its text is joined last and isn't shuffled once a pair.

    Neither pairs nor texts are broadcast: Spark takes them for as small as their compressed files.
    """
    first = pairs.join(texts.select(F.col("doc_id").alias("id"), F.col("data").alias("data_id")).hint("merge"), "id")
    both = first.join(texts.select(F.col("doc_id").alias("hub"), F.col("data").alias("data_hub")).hint("merge"), "hub")
    return both.select("id", "hub", "data_id", "data_hub").mapInArrow(_measure(size), _MEASURED)


def links(stars: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the ids that are linked with their hub."""
    sizes = stars.where("id = hub").select("hub", "frame", F.col("n").alias("hub_n")).distinct()
    rows = stars.where("id <> hub").join(sizes, ["hub", "frame"])
    return rows.where(F.col("both") * 100 >= (F.col("n") + F.col("hub_n") - F.col("both")) * percent).select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of edges (a, b); component is the smallest node that can be reached.

    In each round every node points to the least of its neighbours and itself, and the edges are contracted. The order is by
    number in even rounds, which finishes stars around their smallest node at once, and by a hash in odd ones, which keeps long
    chains from taking more than a logarithmic number of rounds.
    """
    live = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels, turn = live.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct(), 0
    while not live.isEmpty():
        rank = (lambda c: F.col(c)) if turn % 2 == 0 else (lambda c, t=turn: F.xxhash64(c, F.lit(t)))
        least = live.groupBy("a").agg(F.min(F.struct(rank("b").alias("r"), F.col("b").alias("to"))).alias("m"))
        to = least.select("a", F.when(F.struct(rank("a").alias("r"), F.col("a").alias("to")) < F.col("m"), F.col("a")).otherwise(F.col("m.to")).alias("to"))
        to = written(to, "pointers")
        labels = written(labels.join(to.withColumnRenamed("a", "label"), "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        ends = live.join(to, "a").select(F.col("to").alias("x"), F.col("b").alias("a")).join(to, "a").select(F.col("x").alias("a"), F.col("to").alias("b"))
        live, turn = written(ends.where("a <> b").distinct(), "edges"), turn + 1
    least = labels.groupBy("label").agg(F.min("node").alias("component"))
    return written(labels.join(least, "label").select("node", "component"), "components")


def joined_components(comp: DataFrame, edges: DataFrame) -> DataFrame:
    """comp (node, component) after edges (a, b) between nodes that may be in it or not: only the components that the edges touch are worked on."""
    ends = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    fresh = ends.join(comp, "node", "left_anti").select("node", F.col("node").alias("component"))
    comp = comp.union(fresh)
    names = comp.select(F.col("node"), F.col("component"))
    over = edges.join(names.toDF("a", "x"), "a").join(names.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    moved = components(over).toDF("component", "to")
    return written(comp.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "components")


_MEMBER = "hub long, frame long, across int, part int, id long, comp long, n long, bits binary, rest binary, sketch binary, outside boolean"


def _compare(percent: int, hashes: int, thorough: bool):
    """The links between components among the members of a hub: those of a block of outsiders with a block of members.

    Pairs whose sizes differ too much can't be linked. Unless thorough is set, pairs that agree in less than the expected minhashes by five deviations are
    passed over. For the rest the hub's frame gives what they share within it, and at most the smaller remainder beyond it; where that could
    suffice, the remainders are intersected. A link between components that already are one by links found here isn't looked for.
    """
    sure = percent / 100
    least = -1 if thorough else int(np.floor(hashes * sure - 5 * np.sqrt(hashes * sure * (1 - sure))))

    def unpacked(pdf: pd.DataFrame):
        sketches = np.frombuffer(b"".join(pdf.sketch), dtype=np.uint32).reshape(len(pdf), -1)
        bits = np.frombuffer(b"".join(pdf.bits), dtype=np.uint8).reshape(len(pdf), -1)
        rest = [np.frombuffer(r, dtype=np.uint64) for r in pdf.rest]
        return sketches, bits, rest, np.array([len(r) for r in rest]), pdf.id.to_numpy(), pdf.comp.to_numpy(), pdf.n.to_numpy()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        aside, home = pdf[pdf.outside], pdf[~pdf.outside]
        if not len(aside) or not len(home):
            return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
        own_sketch, own_bits, own_rest, own_spare, own_ids, own_comps, own_n = unpacked(aside)
        sketches, bits, rest, spare, ids, comps, n = unpacked(home)
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while (up := root.get(c, c)) != c:
                c = up
            return c

        out = []
        for i in range(len(aside)):
            at = np.flatnonzero((comps != own_comps[i]) & (np.minimum(n, own_n[i]) * 100 >= percent * np.maximum(n, own_n[i])))
            if least >= 0:
                at = at[(sketches[at] == own_sketch[i]).sum(axis=1) >= least]
            inside = np.bitwise_count(bits[at] & own_bits[i]).sum(axis=1, dtype=np.int64)
            most = inside + np.minimum(spare[at], own_spare[i])
            fits = most * 100 >= percent * (n[at] + own_n[i] - most)
            at, inside, most = at[fits], inside[fits], most[fits]
            order = np.argsort(-most, kind="stable")
            for j, shared in zip(at[order].tolist(), inside[order].tolist()):
                a, b = find(own_comps[i]), find(comps[j])
                if a == b:
                    continue
                shared += len(np.intersect1d(own_rest[i], rest[j], assume_unique=True))
                if shared * 100 >= percent * (own_n[i] + n[j] - shared):
                    root[max(a, b)] = min(a, b)
                    out.append((own_ids[i], ids[j]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def outsider_links(stars: DataFrame, comp: DataFrame, reps: DataFrame, percent: int, hashes: int, thorough: bool = False) -> DataFrame:
    """(a, b): links across components within the stars that hold several components and more than one pair.

    Outsiders and members are both cut into blocks, and every block of outsiders meets every block of members in a task of its own, so no task
    holds more than two blocks however large a hub is.
    """
    rows = stars.join(comp.select(F.col("node").alias("id"), F.col("component").alias("c")), "id", "left").withColumn("comp", F.coalesce("c", "id"))
    size = F.octet_length("bits") + F.octet_length("rest")
    sizes = rows.groupBy("hub", "frame", "comp").agg(F.count(F.lit(1)).alias("m"), F.sum(size).alias("size"))
    hubs = sizes.groupBy("hub", "frame").agg(F.count(F.lit(1)).alias("comps"), F.sum("m").alias("members"), F.sum("size").alias("size"), F.max(F.struct("m", "comp", "size")).alias("top"))
    blocks = lambda members, size: F.greatest(F.ceil(members / BLOCK), F.ceil(size / BLOCK_BYTES), F.lit(1)).cast("int")
    parts, acrosses = blocks(F.col("members"), F.col("size")), blocks(F.col("members") - F.col("top.m"), F.col("size") - F.col("top.size"))
    hubs = hubs.where("comps > 1 AND members > 2").select("hub", "frame", F.col("top.comp").alias("main"), parts.alias("parts"), acrosses.alias("acrosses"))
    rows = rows.join(hubs, ["hub", "frame"]).join(reps.select("id", "sketch").hint("merge"), "id")
    block = lambda count: F.pmod(F.xxhash64("id"), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    columns = [c.split()[0] for c in _MEMBER.split(", ")]
    home = rows.withColumn("part", block("parts")).withColumn("across", every("acrosses")).withColumn("outside", F.lit(False)).select(*columns)
    aside = rows.where(F.col("comp") != F.col("main")).withColumn("across", block("acrosses")).withColumn("part", every("parts")).withColumn("outside", F.lit(True)).select(*columns)
    return home.union(aside).groupBy("hub", "frame", "across", "part").applyInPandas(_compare(percent, hashes, thorough), "a long, b long")


def near_dup(docs: DataFrame, size: int = 5, percent: int = 80, tables: int = 10, width: int = 2, thorough: bool = False) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; a document's set are its distinct runs of `size` words, or with fewer words the
    whole sequence. Documents are linked if 100 * intersection >= percent * union. component_id is the smallest doc_id that links
    reach, kept says that it is the document's own. Pairs come from the tables, which miss a pair of similarity 0.8 once in about 13,000 cases; more tables
    miss fewer. thorough also compares the members of a hub whose minhashes agree in unlikely few places.

    A null text or one without words has an empty set, links with nothing and is kept. A row with a null doc_id links with
    nothing, is kept and has a null component. Rows that repeat a doc_id count as one document with the links of all of them. An empty
    table gives an empty result; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    signed = written(docs.mapInArrow(_sign(size, tables, width), _SIGNED), "signed")
    classes = signed.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("rep")).where("rep IS NOT NULL")
    classes = written(classes, "classes")
    reps = signed.join(classes.withColumnRenamed("rep", "doc_id"), ["digest", "doc_id"]).withColumnRenamed("doc_id", "id")
    reps = written(reps.dropDuplicates(["id", "digest"]), "reps")
    shared = sharing(reps)
    stars = written(measured(written(shared, "shared"), docs, size), "stars")
    comp = components(links(stars, percent))
    found = written(outsider_links(stars, comp, reps, percent, 2 * tables * width, thorough), "links")
    if not found.isEmpty():
        comp = joined_components(comp, found)
    roots = classes.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("root"))
    # A doc_id that repeats with other texts belongs to several classes; what links them is the doc_id itself.
    rows = signed.select("doc_id", "n_shingles", "digest").join(roots, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
