"""Line dedup over content-defined chunks of lines, in DataFrame functions only.

Each line gets a hash; a rolling hash over the hashes of the last two lines ends a chunk wherever it falls on a multiple of
`divisor`. A boundary so depends on two lines only, and a passage that moved within a document or to another one is cut alike.
Chunks of two lines or more that occur more than once in the corpus are removed except for their first occurrence.

Chunks are grouped by their whole text, which is the byte comparison, and copies are counted before anything is shuffled. Where a
chunk occurs is then joined by digests without its text, and the texts meet the list of what goes from them in one join.

Chunks cut at a divisor miss repeats that don't fill a chunk: single-line chunks never go, and the ends of a passage fall into chunks with
other lines. run_dedup, which the registered query uses, therefore looks at all pairs of neighbouring lines: each repeated run of two lines or
more consists of repeated pairs, wherever chunks end. What chunk dedup removes, it removes as well. Pairs are equal if their SHA-256 are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import joined_hot, written

BASE, MODULUS = 1_000_003, 2_147_483_647


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")


def chunked(docs: DataFrame, divisor: int) -> DataFrame:
    """doc_id, digest of the text, n_lines, chunks (array of texts; the lines of a chunk are joined by newlines), sizes (lines of each)."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.select("doc_id", F.md5("text").alias("digest"), F.split("text", "\n", -1).alias("lines"))
    d = d.select("doc_id", "digest", "lines", F.size("lines").alias("n_lines"), F.transform("lines", line_hash).alias("hashes"))
    before = F.concat(F.array(F.lit(0).cast("long")), F.slice("hashes", F.lit(1), F.greatest(F.size("hashes") - 1, F.lit(0))))
    rolled = F.zip_with("hashes", before, lambda now, old: (now + old * F.lit(BASE)) % F.lit(MODULUS))
    d = d.select("doc_id", "digest", "lines", "n_lines", rolled.alias("rolled"))
    ends = F.filter(F.transform("rolled", lambda x, i: F.when(x % F.lit(divisor) == 0, i + 1)), lambda x: x.isNotNull())
    d = d.select("doc_id", "digest", "lines", "n_lines", F.array_distinct(F.concat(ends, F.array("n_lines"))).alias("ends"))
    starts = F.concat(F.array(F.lit(0)), F.slice("ends", F.lit(1), F.size("ends") - 1))
    spans = F.zip_with(starts, "ends", lambda a, b: F.struct(a.alias("a"), (b - a).alias("n")))
    d = d.select("doc_id", "digest", "lines", F.size("lines").alias("n_lines"), spans.alias("spans"))
    # `lines` is read twice in what follows, so that the optimizer doesn't move the split into the lambda
    texts = F.transform("spans", lambda s: F.array_join(F.slice("lines", s.a + 1, s.n), "\n"))
    return d.select("doc_id", "digest", F.size("lines").alias("n_lines"), texts.alias("chunks"), F.transform("spans", lambda s: s.n).alias("sizes"))


def chunk_key(text: Column) -> Column:
    return F.sha2(text, 256)


def repeated_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks of several lines that occur more than once: chunk (digest), chars, times, keep_doc (the smallest doc_id with it)."""
    rows = chunks.where("doc_id IS NOT NULL").select("doc_id", F.posexplode(F.arrays_zip("chunks", "sizes")).alias("place", "c"))
    rows = rows.where("c.sizes > 1").select(F.col("c.chunks").alias("chunk_text"), "doc_id")
    found = rows.groupBy("chunk_text").agg(F.count(F.lit(1)).alias("times"), F.min("doc_id").alias("keep_doc"))
    return found.where("times > 1").select(chunk_key(F.col("chunk_text")).alias("chunk"), F.length("chunk_text").alias("chars"), "times", "keep_doc")


def line_dedup(docs: DataFrame, divisor: int = 3) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_lines, n_chunks, removed_chunks, removed_lines, text (what is left).

    Of a repeated chunk the first occurrence stays: that of the smallest doc_id, and there the first. What is left are the other chunks,
    joined by newlines. A null text counts as empty, which is one line. Rows with a null doc_id keep their text and don't count as
    occurrences; rows that repeat a doc_id and a text are treated alike. An empty table gives an empty result; other columns are ignored.
    """
    chunks = chunked(docs, divisor)
    repeated = repeated_chunks(chunks)
    places = chunks.where("doc_id IS NOT NULL").select("doc_id", "digest", F.posexplode(F.transform(F.arrays_zip("chunks", "sizes"), lambda c: F.struct(chunk_key(c.chunks).alias("chunk"), F.length(c.chunks).alias("chars"), c.sizes.alias("size")))).alias("place", "c"))
    places = places.where("c.size > 1").select("doc_id", "digest", "place", "c.*")
    found = places.join(repeated, ["chunk", "chars"]).groupBy("doc_id", "digest", "chunk", "chars", "keep_doc", "size").agg(F.sort_array(F.collect_set("place")).alias("at"))
    gone = F.when(F.col("doc_id") == F.col("keep_doc"), F.slice("at", F.lit(2), F.size("at"))).otherwise(F.col("at"))
    gone = found.select("doc_id", "digest", gone.alias("gone"), "size").where(F.size("gone") > 0)
    gone = gone.groupBy("doc_id", "digest").agg(F.flatten(F.collect_list("gone")).alias("gone"), F.sum(F.col("size") * F.size("gone")).alias("removed_lines"))
    rows = chunks.join(gone.hint("shuffle_hash"), ["doc_id", "digest"], "left")
    kept = F.filter("chunks", lambda c, i: ~F.array_contains("gone", i))
    left = F.when(F.col("gone").isNull(), F.array_join("chunks", "\n")).otherwise(F.array_join(kept, "\n"))
    return rows.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size("chunks").cast("long").alias("n_chunks"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("removed_chunks"), F.coalesce("removed_lines", F.lit(0)).cast("long").alias("removed_lines"), left.alias("text"))


def repeated_pairs(docs: DataFrame) -> DataFrame:
    """doc_id, digest, gone (places of lines, from 0): the lines of pairs of neighbouring lines that occurred before. docs: doc_id, digest, lines.

    Pairs are ordered by doc_id, digest and place. A pair that shares a line with its first occurrence (as in three equal lines) isn't a repeat.
    """
    n = F.size("lines") - 1
    both = F.zip_with(F.slice("lines", F.lit(1), n), F.slice("lines", F.lit(2), n), lambda a, b: F.unhex(F.sha2(F.concat(a, F.lit("\n"), b), 256)))
    pairs = docs.where("doc_id IS NOT NULL").select("doc_id", "digest", F.posexplode(both).alias("place", "pair"))
    found = pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("doc_id", "digest", "place")).alias("first")).where("times > 1")
    found = written(found, "line-pairs")
    total = found.agg(F.sum("times")).first()[0] or 0
    later = (F.col("doc_id") != F.col("first.doc_id")) | (F.col("digest") != F.col("first.digest")) | (F.col("place") > F.col("first.place") + 1)
    at = joined_hot(pairs, found, "pair", "times", total, how="inner").where(later).groupBy("doc_id", "digest").agg(F.collect_set("place").alias("at"))
    return at.select("doc_id", "digest", F.array_union("at", F.transform("at", lambda i: i + 1)).alias("gone"))


def run_dedup(docs: DataFrame, divisor: int = 3) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_lines, n_chunks, removed_chunks, removed_lines, text (what is left).

    Each run of two lines or more that occurred before goes, whatever the chunks: by smaller doc_id, then digest of the text, then place. The first
    occurrence of a line in the corpus always stays. Chunks are those of line_dedup; removed_chunks counts those of which no line is left. What is
    left are the other lines, joined by newlines. Nulls, repeated rows, empty tables and other columns are as in line_dedup.
    """
    chunks = chunked(docs, divisor)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    gone = repeated_pairs(d.select("doc_id", F.md5("text").alias("digest"), F.split("text", "\n", -1).alias("lines")))
    rows = chunks.join(gone.hint("shuffle_hash"), ["doc_id", "digest"], "left")
    lines = F.split(F.array_join("chunks", "\n"), "\n", -1)
    left = F.when(F.col("gone").isNull(), F.array_join("chunks", "\n")).otherwise(F.array_join(F.filter(lines, lambda _, i: ~F.array_contains("gone", i)), "\n"))
    none = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"))
    whole = lambda at, size: F.forall(F.sequence(at, at + size - 1), lambda i: F.array_contains("gone", i)).cast("int")
    removed = F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.aggregate("sizes", none, lambda x, size: F.struct((x.at + size).alias("at"), (x.n + whole(x.at, size)).alias("n")), lambda x: x.n))
    return rows.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size("chunks").cast("long").alias("n_chunks"), removed.cast("long").alias("removed_chunks"), F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("long").alias("removed_lines"), left.alias("text"))
