"""What the operators share: work tables, row identity and word shingles."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIX = np.uint64(0x9E3779B97F4A7C15)


HOT_SHARE = 1000  # a key is hot if it has at least one of so many parts of all rows; so there are never more hot keys than this


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Where it is unset, a temporary one is set in local mode only: a cluster's machines wouldn't share it."""
    conf = spark.sparkContext.getConf()
    where = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master or ""):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="domspark-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage is cut, and losing an executor loses nothing."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def joined_hot(rows: DataFrame, table: DataFrame, key: str, times: str, total: int, how: str = "left", spread: str = "doc_id") -> DataFrame:
    """rows joined (how: left or inner) with table, which has each key once and in `times` how many of the `total` rows have it.

    The keys of at least a HOT_SHARE-th of all rows, at most HOT_SHARE of them, are broadcast; no other key has enough rows to hold up a task. Rows with
    a hot key are spread over the tasks of the other join by `spread`, as they find nothing there.
    """
    least = max(2, -(-total // HOT_SHARE))
    columns = [c for c in table.columns if c != key]
    hot = table.where(F.col(times) >= least).select(F.col(key), F.struct(*columns).alias("_hot"))
    cold = table.where(F.col(times) < least).select(F.col(key).alias("_key"), F.struct(*columns).alias("_cold"))
    apart = F.when(F.col("_hot").isNull(), F.col(key)).otherwise(F.concat(F.lit("-"), F.coalesce(F.col(spread).cast("string"), F.lit(""))).cast(rows.schema[key].dataType))
    both = rows.join(F.broadcast(hot), key, "left").withColumn("_key", apart).join(cold.hint("shuffle_hash"), "_key", "left")
    found = F.coalesce("_hot", "_cold")
    out = both.select(*rows.columns, found.alias("_found"))
    if how == "inner":
        out = out.where(F.col("_found").isNotNull())
    return out.select(*rows.columns, *[F.col("_found")[c].alias(c) for c in columns])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(data: bytes) -> list[bytes]:
    """Words of [^\\x20\\x09-\\x0D]+ with A-Z lower-cased."""
    return data.lower().split()


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: close inputs become unrelated outputs."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), dtype=np.uint64, count=len(tokens))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` words, in text order; of the whole sequence if it is shorter; none without words."""
    if not len(hashes):
        return hashes
    size = min(size, len(hashes))
    n = len(hashes) - size + 1
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = mixed(out + hashes[k : k + n] * np.uint64(2 * k + 1) + MIX)
    return out


def shingles(data: bytes, size: int) -> np.ndarray:
    """The sorted set of 64-bit shingle hashes of a text."""
    return np.unique(windows(word_hashes(words(data)), size))
