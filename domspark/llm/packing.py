"""Harmonic packing: pieces of tokenized documents fill sequences of a fixed capacity.

A piece of length n belongs to class k = capacity // n, and a bin of class k takes exactly k pieces. Each task fills the bins of its
own rows and closes a bin as soon as it has its k pieces, so tasks don't talk to each other and hold at most k - 1 open pieces for each
class. A document is cut first into whole sequences; its rest is cut at reciprocal capacities (capacity // k) only as long as an
uncut rest would waste more than `slack` of its bin. What is left open when a task ends is bounded by the classes, not by the
rows; those pieces are gathered by fixed numbers of tasks, laid end to end and cut at the capacity, which leaves one short sequence for each gathering task.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import written

END_ID = 0
GATHER = 64  # tasks whose open pieces meet in one gathering task
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
PIECES = PIECE + ", task long, ids binary"


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """texts -> lists of ids, as the tokenizers library gives them for the file at `path` with add_special_tokens=False.

    Where the same vocabulary lies beside it as ranks, texts without special strings go through the faster byte-pair library,
    which gives the same ids; the tests hold it to that.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    special = [t.content for t in whole.get_added_tokens_decoder().values()]
    ranks = path.removesuffix(".json") + ".tiktoken"
    fast = None
    if path.endswith(".json") and os.path.exists(ranks):
        import base64

        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if fast is None or any(s in text for s in special):
            ids = whole.encode(text, add_special_tokens=False).ids
        else:
            ids = fast.encode_ordinary(text)
        return np.array([*ids, END_ID], dtype="<u4")

    return encode


def cuts(n: int, capacity: int, slack: float) -> list[int]:
    """Lengths of the pieces of a document of n ids."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        k = capacity // rest
        if capacity - k * rest <= slack * capacity:
            out.append(rest)
            break
        out.append(capacity // (k + 1))
        rest -= out[-1]
    return out


def _record(rows: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(rows, schema=schema)


_SCHEMA = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "task")] + [("ids", pa.binary())])
_NAMES = _SCHEMA.names


def pack_tasks(path: str, capacity: int, slack: float):
    """Batches of (doc_id, text) -> pieces: placed ones, and at the end those of open bins, with their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(path), TaskContext.get().partitionId()
        bins: dict[int, list] = {}
        made, out = task << 40, {n: [] for n in _NAMES}

        def put(piece: list, sequence: int | None, offset: int | None, ids: bytes | None) -> None:
            for name, value in zip(_NAMES, [*piece, sequence, offset, task, ids], strict=True):
                out[name].append(value)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "")
                start = 0
                for n in cuts(len(ids), capacity, slack):
                    data = ids[start : start + n].tobytes()
                    piece = [doc, start, n, zlib.crc32(data), len(ids)]
                    start += n
                    k = capacity // n
                    held = bins.setdefault(k, [])
                    held.append((piece, data))
                    if len(held) == k:
                        at = 0
                        for p, _ in held:
                            put(p, made, at, None)
                            at += p[2]
                        made += 1
                        bins[k] = []
                if len(out["doc_id"]) > 20_000:
                    yield _record(out, _SCHEMA)
                    out = {n: [] for n in _NAMES}
        for held in bins.values():
            for p, data in held:
                put(p, None, None, data)
        yield _record(out, _SCHEMA)

    return run


def gather_tasks(capacity: int):
    """Open pieces -> placed pieces, laid end to end and cut at the capacity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence, at = (1 << 62) + (TaskContext.get().partitionId() << 40), 0
        for batch in batches:
            out = {n: [] for n in _NAMES}
            for row in batch.to_pylist():
                ids, start = np.frombuffer(row["ids"], dtype="<u4"), row["start"]
                while len(ids):
                    take = min(len(ids), capacity - at)
                    values = [row["doc_id"], start, take, zlib.crc32(ids[:take].tobytes()), row["doc_tokens"], sequence, at, row["task"], None]
                    for name, value in zip(_NAMES, values, strict=True):
                        out[name].append(value)
                    ids, start, at = ids[take:], start + take, at + take
                    if at == capacity:
                        sequence, at = sequence + 1, 0
            yield _record(out, _SCHEMA)

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, slack: float = 1 / 64) -> DataFrame:
    """One row per piece of docs (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are those of the tokenizer and a closing id 0, so that every document, also one with a null or empty text, has
    at least one id. Pieces of a sequence lie without gaps from offset 0. A row with a null doc_id is packed too and carries the
    null; rows that repeat a doc_id are packed once each. An empty table gives an empty result; other columns are ignored.
    sequence_id is unique and not contiguous: its upper bits name the task that filled it.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    first = written(rows.mapInArrow(pack_tasks(tokenizer, capacity, slack), PIECES), "packed")
    tasks = max(1, -(-rows.rdd.getNumPartitions() // GATHER))
    rest = first.where("sequence_id IS NULL").repartition(tasks).sortWithinPartitions("task", "doc_id", "start", "length")
    rest = written(rest.mapInArrow(gather_tasks(capacity), PIECES), "gathered")
    return first.where("sequence_id IS NOT NULL").union(rest).select(*[c.split()[0] for c in PIECE.split(", ")])


def token_ids(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and its ids, for training files: join pieces of pack() on doc_id and slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            ids = [encode(t.as_py() or "").tolist() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")
