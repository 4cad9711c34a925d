"""Benchmark decontamination: every passage of the training texts queries a BM25 index of the test items by block-max WAND.

A passage is a window of twice the longest item's words, and windows step by that item's length, so every copy of an item lies
whole in some passage. The impacts of an item's words are divided by the item's own threshold: the score of a copy that has lost
the most telling fifth of its words, the least that a copy with 80 % of the item's word runs can have. Retrieval so asks for scores of 1 or
more, and loses none of the copies that the check on word runs would confirm.

Postings lie in blocks with their greatest impact; blocks of items also have a greatest impact for each word, and a passage whose sum of these
stays under 1 in all blocks has no pivot and is passed over at once. For the others the pivot search runs, with block maxima.
"""

from __future__ import annotations

import math
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import written

K1, B = 1.2, 0.75
POSTING_BLOCK = 8
ITEM_BLOCKS = 64  # blocks of items that the first bound looks at
SHARD_ITEMS = 20_000  # items of one broadcast index; more items take several passes over the texts
SHARD_CHARS = 4_000_000
BOUNDS_BYTES = 64_000_000  # of the bounds of an index
HELD_ITEMS = 2_000  # items whose runs a task keeps
SEGMENT = 256  # passages that are bounded at once
_PLAIN = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def plain_words(data: bytes) -> list[bytes]:
    """Words of ASCII letters and digits and of any other characters beyond ASCII, A-Z lower-cased."""
    return data.translate(_PLAIN).split()


def runs(words: list, size: int) -> list[tuple]:
    """All runs of `size` words; the whole sequence if it is shorter; none without words."""
    return [tuple(words[i : i + size]) for i in range(len(words) - size + 1)] if len(words) >= size else [tuple(words)] * bool(words)


def question_and_answer(text: str) -> tuple[str, str]:
    """An item's last sentence is its answer, what comes before it the question; an item of one sentence has no answer."""
    parts = text.rstrip().rstrip(".!?。")
    at = max(parts.rfind(c) for c in ".!?。")
    return (text[: at + 1], text[at + 1 :]) if at > 0 and parts[at + 1 :].strip() else (text, "")


class Index:
    """BM25 impacts of one shard of items, with statistics over all items.

    Postings are packed arrays of item numbers and impacts. The bounds of blocks of items are one array of at most BOUNDS_BYTES, whatever the size of the
    vocabulary. The runs of an item are made from its text when a passage retrieves it, so that the index holds texts, not their runs.
    """

    def __init__(self, items: list[tuple[int, str]], size: int, percent: int, n_items: int, df: dict[bytes, int], mean_words: float, question_percent: int | None = None, answer_percent: int | None = None):
        self.size, self.percent = size, percent
        self.question_percent = percent if question_percent is None else question_percent
        self.answer_percent = percent if answer_percent is None else answer_percent
        self.ids, self.texts, self.longest = [], [], 1
        self.lengths: set[int] = {size}  # of runs; short questions, answers and items have shorter ones
        lists: dict[bytes, tuple[array, array]] = {}
        for item_id, text in items:
            words = plain_words((text or "").encode())
            if not words:
                continue
            at = len(self.ids)
            self.ids.append(item_id)
            self.texts.append(text)
            self.longest = max(self.longest, len(words))
            for part in (text, *question_and_answer(text)):
                n = len(plain_words(part.encode()))
                if 0 < n < size:
                    self.lengths.add(n)
            every = runs(words, size)
            impact = {w: math.log(1 + (n_items - df[w] + 0.5) / (df[w] + 0.5)) * n * (K1 + 1) / (n + K1 * (1 - B + B * len(words) / mean_words)) for w, n in Counter(words).items()}
            lost = len(every) - -(-len(set(every)) * percent // 100)  # each missing word costs a run at least
            self_score = sum(impact.values())
            floor = self_score - sum(sorted(impact.values(), reverse=True)[:lost])
            floor = max(floor, 1e-6 * self_score)  # an item that could lose all its words is always retrieved
            for w, x in impact.items():
                own = lists.get(w)
                if own is None:
                    own = lists[w] = (array("i"), array("d"))
                own[0].append(at)
                own[1].append(x / floor)
        self.vocabulary = {w: i for i, w in enumerate(lists)}
        blocks = max(1, min(ITEM_BLOCKS, BOUNDS_BYTES // (4 * max(1, len(lists)))))
        per = max(1, -(-len(self.ids) // blocks))
        self.bounds = np.zeros((len(lists), -(-max(1, len(self.ids)) // per)), dtype=np.float32)
        self.postings = []
        for i, (docs, scores) in enumerate(lists.values()):
            np.maximum.at(self.bounds[i], np.frombuffer(docs, dtype=np.int32) // per, np.nextafter(np.frombuffer(scores).astype(np.float32), np.float32(np.inf)))
            starts = range(0, len(docs), POSTING_BLOCK)
            ends = array("i", [docs[min(k + POSTING_BLOCK, len(docs)) - 1] for k in starts])
            self.postings.append((docs, scores, ends, array("d", [max(scores[k : k + POSTING_BLOCK]) for k in starts]), max(scores)))
        self.held: dict[int, tuple[frozenset, frozenset, frozenset]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"held": {}}

    def needles(self, item: int) -> tuple[frozenset, frozenset, frozenset]:
        """The runs of an item, of its question and of its answer."""
        made = self.held.get(item)
        if made is None:
            if len(self.held) >= HELD_ITEMS:
                self.held.clear()
            made = self.held[item] = tuple(frozenset(runs(plain_words(x.encode()), self.size)) for x in (self.texts[item], *question_and_answer(self.texts[item])))
        return made

    def retrieve(self, terms: list[int], least: float = 1 - 1e-9) -> list[tuple[int, float]]:
        """Block-max WAND: all items whose score for the distinct terms is at least `least`."""
        cursors = [[0, self.postings[t]] for t in terms]  # place in the posting list, the list
        found = []
        while cursors:
            cursors.sort(key=lambda c: c[1][0][c[0]])
            total, pivot = 0.0, None
            for k, (_, post) in enumerate(cursors):
                total += post[4]
                if total >= least:
                    pivot = k
                    break
            if pivot is None:
                break
            item = cursors[pivot][1][0][cursors[pivot][0]]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][1][0][cursors[pivot + 1][0]] == item:
                pivot += 1
            moved = cursors[: pivot + 1]
            bound, upto = 0.0, math.inf
            for at, (_, _, ends, most, _) in moved:  # what the blocks in which the pivot would be can give
                block = at // POSTING_BLOCK
                if ends[block] < item:
                    block = bisect_left(ends, item, block + 1)
                if block < len(ends):
                    bound += most[block]
                    upto = min(upto, ends[block])
            if bound < least:
                if pivot + 1 < len(cursors):
                    upto = min(upto, cursors[pivot + 1][1][0][cursors[pivot + 1][0]] - 1)
                target = max(item, upto) + 1 if upto < math.inf else item + 1
            else:
                score = 0.0
                for c in moved:
                    docs = c[1][0]
                    if docs[c[0]] < item:
                        self._seek(c, item)
                    if c[0] < len(docs) and docs[c[0]] == item:
                        score += c[1][1][c[0]]
                if score >= least:
                    found.append((item, score))
                target = item + 1
            for c in moved:
                docs = c[1][0]
                if c[0] < len(docs) and docs[c[0]] < target:
                    self._seek(c, target)
            cursors = [c for c in cursors if c[0] < len(c[1][0])]
        return found

    @staticmethod
    def _seek(cursor: list, item: int) -> None:
        """From a posting before item to the first one that isn't: over whole blocks by their last items, then within one."""
        at, (docs, _, ends, _, _) = cursor
        at += 1  # most often the next one
        if at < len(docs) and docs[at] < item:
            block = at // POSTING_BLOCK
            if ends[block] < item:
                block = bisect_left(ends, item, block + 1)
                if block == len(ends):
                    cursor[0] = len(docs)
                    return
                at = block * POSTING_BLOCK
            at = bisect_left(docs, item, at, min(len(docs), (block + 1) * POSTING_BLOCK))
        cursor[0] = at

    def leaks(self, data: bytes) -> list[tuple[int, float, float, float, float]]:
        """(item_id, score, overlap, question_overlap, answer_overlap) of the items that a text holds."""
        if not self.ids:
            return []
        words = plain_words(data)
        terms = np.array(list(map(self.vocabulary.get, words, repeat(-1))), dtype=np.int64)
        at = np.flatnonzero(terms >= 0)
        terms = terms[at]
        step = self.longest
        starts = np.arange(0, max(1, len(words) - step), step)
        best: dict[int, tuple] = {}
        for s in range(0, len(starts), SEGMENT):
            part = starts[s : s + SEGMENT]
            lo, hi = np.searchsorted(at, part), np.searchsorted(at, part + 2 * step)
            sums = np.zeros((hi[-1] - lo[0] + 1, self.bounds.shape[1]))
            sums[1:] = self.bounds[terms[lo[0] : hi[-1]]]
            np.cumsum(sums, axis=0, out=sums)
            may = sums[hi - lo[0]] - sums[lo - lo[0]] >= 1 - 1e-5
            for k in np.flatnonzero(may.any(axis=1)):
                own = np.unique(terms[lo[k] : hi[k]])
                own = own[self.bounds[own][:, may[k]].any(axis=1)]  # terms of no item of these blocks add nothing to a hit
                hits = self.retrieve(own.tolist())
                if not hits:
                    continue
                window = words[part[k] : part[k] + 2 * step]
                own = {tuple(window[i : i + n]) for n in self.lengths for i in range(len(window) - n + 1)}
                for item, score in hits:
                    share, question, answer = (len(x & own) / len(x) if x else 1.0 for x in self.needles(item))
                    enough = share * 100 >= self.percent and question * 100 >= self.question_percent and answer * 100 >= self.answer_percent
                    if enough and (item not in best or (share, score) > best[item][:2]):
                        best[item] = (share, score, question, answer)
        return [(self.ids[i], score, share, q, a) for i, (share, score, q, a) in sorted(best.items())]


def _search(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = index.value
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.float64())
        names = ("doc_id", "item_id", "score", "overlap", "question_overlap", "answer_overlap")
        for batch in batches:
            out = [(doc.as_py(), *hit) for doc, data in zip(batch.column(0), batch.column(1), strict=True) for hit in held.leaks(data.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    return run


def shards(items: DataFrame) -> Iterator[list]:
    """The items by item_id, in lists of a bounded number of items and characters. Items are read one shard at a time."""
    part, chars = [], 0
    for r in items.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        if part and (len(part) >= SHARD_ITEMS or chars + len(r.text or "") > SHARD_CHARS):
            yield part
            part, chars = [], 0
        part.append((r.item_id, r.text))
        chars += len(r.text or "")
    if part:
        yield part


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, items): the distinct words of each item; the null word counts all words of an item, and the item itself if it has some."""
    for batch in batches:
        words: Counter = Counter()
        n = items = 0
        for data in batch.column(0):
            own = plain_words(data.as_py())
            n, items = n + len(own), items + bool(own)
            words.update(set(own))
        rows = [*words.items(), (None, items)]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.binary()), pa.array([k for _, k in rows], pa.int64()), pa.array([0] * len(words) + [n], pa.int64())], names=["word", "items", "words"])


def indexes(spark, items: DataFrame, size: int, percent: int, question_percent: int | None = None, answer_percent: int | None = None) -> Iterator:
    """A broadcast index for each shard of the items, with statistics over all of them.

    A shard is bounded by SHARD_ITEMS and SHARD_CHARS; the driver holds one shard, and of the document frequencies those of its words.
    """
    texts = items.select(F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    counted = texts.mapInArrow(_item_words, "word binary, items long, words long").groupBy("word").agg(F.sum("items").alias("items"), F.sum("words").alias("words"))
    counted = written(counted, "item-words")
    whole = counted.where("word IS NULL").first()
    for part in shards(items):
        own = {w for _, text in part for w in plain_words((text or "").encode())}
        words = spark.createDataFrame([(bytearray(w),) for w in own], "word binary") if own else None
        df = {bytes(r.word): r["items"] for r in counted.join(words, "word", "left_semi").select("word", "items").collect()} if own else {}
        yield spark.sparkContext.broadcast(Index(part, size, percent, whole["items"], df, whole.words / max(1, whole["items"]), question_percent, answer_percent))


def leaks(docs: DataFrame, items: DataFrame, size: int = 5, percent: int = 80, question_percent: int | None = None, answer_percent: int | None = None) -> DataFrame:
    """(doc_id, item_id, score, overlap, question_overlap, answer_overlap) for every text that holds an item.

    docs: doc_id, text; items: item_id, text. A text holds an item if one of its passages has at least `percent` % of the item's distinct
    runs of `size` words, and of those of its question and of its answer as many (question_percent and answer_percent, by default the same): the question
    alone doesn't count. An item's last sentence is its answer; an item of one sentence is a question without an answer, whose overlap is 1. What
    has fewer words counts as one run. score is the BM25 score over the item's threshold. Null and empty texts hold nothing, and null and empty items are
    held by nothing. Rows that repeat a doc_id or an item_id give rows of their own. Empty tables give an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    kinds = "doc_id long, item_id long, score double, overlap double, question_overlap double, answer_overlap double"
    out = None
    for index in indexes(spark, items, size, percent, question_percent, answer_percent):
        found = docs.mapInArrow(_search(index), kinds)
        out = found if out is None else out.union(found)
    return spark.createDataFrame([], kinds) if out is None else out


def _without(index, text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = index.value
        for batch in batches:
            clean = [not held.leaks((t.as_py() or "").encode()) for t in batch.column(text)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return run


def decontaminated(docs: DataFrame, items: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that hold no item, with all their columns; each row is judged by its own text, and nothing is shuffled."""
    at, schema = docs.columns.index("text"), docs.schema
    for index in indexes(docs.sparkSession, items, size, percent):
        docs = docs.mapInArrow(_without(index, at), schema)
    return docs
