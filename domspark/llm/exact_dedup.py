"""Exact dedup: a static binary-fuse filter for each bucket of an immutable snapshot screens the incoming digests.

A snapshot is the set of distinct digests of the texts already held. It is cut into buckets by the first bits of the digest, so
that a bucket holds a bounded number of keys however large the snapshot is, and each bucket gets one filter with 16-bit
fingerprints. Incoming rows are first grouped by digest, which keeps a hot group of copies in one row; the distinct digests
meet the filter of their bucket. Those that the filter lets through join the exact bucket by the whole digest; the others are new
and group among themselves. Every group of more than one row is then checked byte by byte: its texts are grouped by their bytes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import HOT_SHARE, joined_hot, mixed, work_dir, written

BUCKET_KEYS = 512  # keys that a bucket's filter is meant to hold


class BinaryFuse:
    """Three-wise binary-fuse filter over distinct 64-bit keys (Graf and Lemire, 2022): no false negatives, about 2**-16 false positives."""

    def __init__(self, seed: int, segment: int, segments: int, prints: np.ndarray):
        self.seed, self.segment, self.segments, self.prints = seed, segment, segments, prints

    @staticmethod
    def slots(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
        """The three slots of each key, in three neighbouring segments, and its fingerprint."""
        with np.errstate(over="ignore"):
            h = mixed(keys + np.uint64(seed) * np.uint64(0xD1342543DE82EF95))
            g = mixed(h + np.uint64(0x9E3779B97F4A7C15))
        first = ((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
        mask = np.uint64(segment - 1)
        at = [(first + np.uint64(k)) * np.uint64(segment) + ((g >> np.uint64(20 * k)) & mask) for k in range(3)]
        return np.stack(at).astype(np.int64), (h & np.uint64(0xFFFF)).astype(np.uint16)

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuse:
        keys = np.unique(keys.astype(np.uint64))
        n = len(keys)
        segment = 1 << max(2, int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25)))
        size = int(n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))) + segment
        segments = max(1, -(-size // segment) - 2)
        for seed in range(1, 1000):
            at, prints = cls.slots(keys, seed, segment, segments)
            cells = (segments + 2) * segment
            count, held = np.bincount(at.ravel(), minlength=cells), np.zeros(cells, dtype=np.int64)
            for row in at:
                np.bitwise_xor.at(held, row, np.arange(n))
            order, done, todo = [], np.zeros(n, dtype=bool), np.flatnonzero(count == 1)
            while len(todo):  # peel, a wave at a time, the keys that are alone in a slot
                todo = todo[count[todo] == 1]
                alone, slot = held[todo], todo
                alone, first = np.unique(alone, return_index=True)
                slot = slot[first]
                slot, alone = slot[~done[alone]], alone[~done[alone]]
                if not len(alone):
                    break
                done[alone] = True
                order.append((alone, slot))
                touched = at[:, alone]
                for row in touched:
                    np.subtract.at(count, row, 1)
                    np.bitwise_xor.at(held, row, alone)
                todo = np.unique(touched)
                todo = todo[count[todo] == 1]
            if done.all():
                table = np.zeros(cells, dtype=np.uint16)
                for alone, slot in reversed(order):
                    a, b, c = at[:, alone]
                    table[slot] = prints[alone] ^ table[a] ^ table[b] ^ table[c] ^ table[slot]
                return cls(seed, segment, segments, table)
        raise RuntimeError("no seed peels this bucket")

    def __contains__(self, key: int) -> bool:
        return bool(self.contains(np.array([key], dtype=np.uint64))[0])

    def contains(self, keys: np.ndarray) -> np.ndarray:
        (a, b, c), prints = self.slots(keys.astype(np.uint64), self.seed, self.segment, self.segments)
        return (self.prints[a] ^ self.prints[b] ^ self.prints[c]) == prints

    def dump(self) -> bytes:
        return np.array([self.seed, self.segment, self.segments], dtype="<u4").tobytes() + self.prints.astype("<u2").tobytes()

    @classmethod
    def load(cls, data: bytes) -> BinaryFuse:
        seed, segment, segments = np.frombuffer(data[:12], dtype="<u4").tolist()
        return cls(seed, segment, segments, np.frombuffer(data[12:], dtype="<u2"))


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"bucket": pdf.bucket[:1], "filter": [BinaryFuse.build(pdf.key.to_numpy().view(np.uint64)).dump()]})


def _screen(incoming: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
    if not len(incoming):
        return pd.DataFrame({"text_sha256": pd.Series(dtype=str), "seen": pd.Series(dtype=bool)})
    seen = BinaryFuse.load(held["filter"].iloc[0]).contains(incoming.key.to_numpy().view(np.uint64)) if len(held) else np.zeros(len(incoming), dtype=bool)
    return pd.DataFrame({"text_sha256": incoming.text_sha256, "seen": seen})


def digested(docs: DataFrame) -> DataFrame:
    """doc_id and the digest of each row's text; a null text counts as empty."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.sha2(text, 256).alias("text_sha256"))


def distinct_digests(rows: DataFrame) -> DataFrame:
    """A row for each digest, with the number of its rows, their largest doc_id and its 64-bit key."""
    key = F.conv(F.substring("text_sha256", 1, 15), 16, 10).cast("long")
    return rows.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").cast("long").alias("keep_id")).withColumn("key", key)


def bucketed(digests: DataFrame, buckets: int) -> DataFrame:
    return digests.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))


def snapshot_filters(digests: DataFrame, buckets: int) -> DataFrame:
    """(bucket, filter) for the distinct digests of a snapshot. A bucket's keys are distinct, so no group of copies can swell it."""
    return bucketed(digests, buckets).select("bucket", "key").groupBy("bucket").applyInPandas(_build, "bucket int, filter binary")


def screened(incoming: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """(text_sha256, seen): seen says that the snapshot may hold the digest."""
    left = bucketed(incoming, buckets).select("bucket", "key", "text_sha256").groupBy("bucket")
    return left.cogroup(filters.groupBy("bucket")).applyInPandas(_screen, "text_sha256 string, seen boolean")


class Snapshot:
    """An immutable set of texts by their digests, below a path: `digests` (text_sha256, n, keep_id, key, bucket) and `filters` (bucket, filter).

    It is built once and read as often as batches come in.
    """

    def __init__(self, digests: DataFrame, filters: DataFrame, buckets: int):
        self.digests, self.filters, self.buckets = digests, filters, buckets

    @classmethod
    def build(cls, docs: DataFrame, path: str) -> Snapshot:
        """Writes the snapshot of docs (doc_id, text). The path must be in a folder that all executors share, and must not be there yet."""
        spark = docs.sparkSession
        distinct_digests(digested(docs)).write.parquet(f"{path}/digests")
        held = spark.read.parquet(f"{path}/digests")
        buckets = max(1, -(-held.count() // BUCKET_KEYS))
        snapshot_filters(held, buckets).write.parquet(f"{path}/filters")
        spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(f"{path}/buckets")
        return cls.open(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Snapshot:
        buckets = spark.read.schema("buckets int").parquet(f"{path}/buckets").first().buckets
        digests = spark.read.schema("text_sha256 string, n long, keep_id long, key long").parquet(f"{path}/digests")
        return cls(digests, spark.read.schema("bucket int, filter binary").parquet(f"{path}/filters"), buckets)


def known(snapshot: Snapshot, new: DataFrame) -> DataFrame:
    """(text_sha256) of the distinct digests `new` that the snapshot holds: those that pass their bucket's filter and are in the exact bucket."""
    positive = screened(new, snapshot.filters, snapshot.buckets).where("seen").select("text_sha256")
    return snapshot.digests.select("text_sha256").join(positive, "text_sha256", "left_semi")


def exact_groups(docs: DataFrame, part: Column) -> tuple[DataFrame, int]:
    """Groups of more than one equal text among the rows of docs (doc_id, text), and the number of rows: text_sha256, keep_id, group_size.

    The rows of `part` are the snapshot, the others the incoming batch. Of equal texts the largest doc_id stays. Rows with a null doc_id count in
    group_size and are kept only by no one else. Texts are only moved where their digest is repeated: those of hot digests are summed up, byte for
    byte, within each task before anything is shuffled, the others meet by digest and are then summed up in place.
    """
    spark = docs.sparkSession
    snapshot = Snapshot.build(docs.where(part), f"{work_dir(spark)}/exact-snapshot-{uuid.uuid4().hex}")
    new = written(distinct_digests(digested(docs.where(~part))), "exact-batch")
    both = known(snapshot, new)
    old = snapshot.digests
    counts = old.select("text_sha256", "n").union(new.select("text_sha256", "n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    repeated = both.union(old.where("n > 1").select("text_sha256")).union(new.where("n > 1").select("text_sha256")).distinct()
    least = max(2, -(-total // HOT_SHARE))
    hot = counts.where(F.col("n") * 2 >= least).select("text_sha256").distinct()  # by halves, as a digest may be in both parts
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_sha256", F.sha2("text", 256))
    summed = lambda df: df.groupBy("text_sha256", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    often = summed(rows.join(F.broadcast(hot), "text_sha256", "left_semi"))
    seldom = summed(rows.join(F.broadcast(hot), "text_sha256", "left_anti").join(repeated.hint("shuffle_hash"), "text_sha256", "left_semi"))
    return often.union(seldom).where("group_size > 1").select("text_sha256", "keep_id", "group_size"), total


def new_texts(batch: DataFrame, snapshot: Snapshot) -> DataFrame:
    """The rows of batch (doc_id, text and any others) whose text neither the snapshot nor another row of the batch with a larger doc_id has.

    Of rows that repeat a doc_id and a text one stays; a row without a doc_id stays only where no other has its text. The snapshot holds no texts, so
    here equality with it is that of SHA-256 digests.
    """
    rows = batch.withColumn("_sha", F.sha2(F.coalesce("text", F.lit("")), 256))
    new = written(distinct_digests(batch.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))), "exact-batch")
    old = known(snapshot, new).select(F.col("text_sha256").alias("_sha"))
    first = Window.partitionBy("_sha").orderBy(F.col("doc_id").desc_nulls_last(), F.xxhash64(*batch.columns))
    left = rows.join(old.hint("shuffle_hash"), "_sha", "left_anti")
    return left.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(*batch.columns)


def exact_dedup(docs: DataFrame, in_snapshot=None) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    in_snapshot is a predicate over docs that tells the rows of the immutable snapshot from those of the incoming batch; without
    it, rows whose doc_id hashes to an even number form the snapshot. The result does not depend on it.

    A null text is an empty text, and empty texts are equal. A row with a null doc_id never wins over one with a doc_id; if no row of a
    group has a doc_id, keep_id is null and all its rows are kept. Rows that repeat a doc_id and a text are kept together or
    dropped together. An empty table gives an empty result; other columns of docs are ignored.
    """
    docs = docs.select("doc_id", "text")
    part = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0, F.lit(True)) if in_snapshot is None else F.coalesce(in_snapshot, F.lit(False))
    groups, total = exact_groups(docs, part)
    rows = joined_hot(digested(docs), written(groups, "exact-groups"), "text_sha256", "group_size", total)
    return rows.select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("group_size").isNull() | (F.col("doc_id") == F.col("keep_id")), F.col("keep_id").isNull()).alias("kept"),
        "text_sha256",
    )
