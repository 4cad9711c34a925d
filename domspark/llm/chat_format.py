"""Chat formatting over reply trees.

Messages form trees by their parent ids. Iterative self-joins with doubling steps find, for every message, the sum of scores up to
its root and the root itself, in as many joins as the logarithm of the greatest depth; the same steps, backwards, list the messages
of the chosen paths. Branches of a tree are ranked by their score; each chosen path is written as one conversation.

The template is `<s>[INST] user [/INST] assistant</s>`, with `<<SYS>>...<</SYS>>` for a system message and `[ROLE name]...[/ROLE]` for
any other role. Control strings inside texts are escaped: a backslash goes before each backslash and each `<` or `[`, so no
control string, which all begin with one of those two unescaped, can arise from a text, and unescaping restores the text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import written

_MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
_ESCAPE = re.compile(r"[\\<\[]")
_UNESCAPE = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def write_chat(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the loss mask as spans of code points: the escaped text of each assistant turn."""
    out, mask, at = [], [], 0
    for role, text in turns:
        body = escape(text)
        if role in _MARKS:
            before, after = _MARKS[role]
        else:
            before, after = f"[ROLE {escape(role)}[:]", "[/ROLE]"
        if role == "assistant":
            mask.append((at + len(before), at + len(before) + len(body)))
        out.append(before + body + after)
        at += len(out[-1])
    return "".join(out), mask


def read_chat(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation. Raises ValueError if it isn't one."""
    turns, at = [], 0
    while at < len(text):
        kind = next((k for k, (b, _) in _MARKS.items() if text.startswith(b, at)), None)
        before, after = _MARKS[kind] if kind else ("[ROLE ", "[/ROLE]")
        if kind is None and not text.startswith(before, at):
            raise ValueError(f"no turn at {at}")
        role = kind
        at += len(before)
        if kind is None:
            end = _plain_end(text, at, "[:]")
            role, at = unescape(text[at:end]), end + 3
        end = _plain_end(text, at, after)
        turns.append((role, unescape(text[at:end])))
        at = end + len(after)
    return turns


_CONTROL = re.compile(r"\\.|[<\[]", re.S)


def _plain_end(text: str, at: int, mark: str) -> int:
    """Where the unescaped mark stands; it holds the first unescaped control character from `at` on."""
    lead = min(i for i in (mark.find("<"), mark.find("[")) if i >= 0)
    for m in _CONTROL.finditer(text, at):
        if m[0][0] != "\\":
            if text.startswith(mark, m.start() - lead) and m.start() - lead >= at:
                return m.start() - lead
            break
    raise ValueError(f"no {mark!r} after {at}")


def reply_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(conv_id, branch, path_score, step, role, text) for the best `branches` root-to-leaf paths of every tree.

    messages: conv_id, msg_id, parent_id (null for a root), role, text, score. A branch's score is the mean score of its messages, a
    null score being 0; ties go to the leaf with the smaller msg_id. A parent that isn't there makes its reply a root. Messages on a
    cycle of parents belong to no root and are left out. msg_id must be unique within a conversation; of repeated rows the first by
    (parent_id, role, text) counts. A null conv_id or msg_id drops the message.
    """
    m = messages.select("conv_id", "msg_id", "parent_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    m = m.where("conv_id IS NOT NULL AND msg_id IS NOT NULL")
    m = m.groupBy("conv_id", "msg_id").agg(F.min(F.struct("parent_id", "role", "text", "score")).alias("m")).select("conv_id", "msg_id", "m.*")
    said = written(m, "chat-messages")
    # From here on only numbers move; role and text meet the chosen paths once, at the end.
    ids = said.select("conv_id", "msg_id", "parent_id", "score")
    there = ids.select("conv_id", F.col("msg_id").alias("parent_id"), F.lit(True).alias("there"))
    m = ids.join(there, ["conv_id", "parent_id"], "left").withColumn("parent_id", F.when(F.col("there"), F.col("parent_id"))).select("conv_id", "msg_id", "parent_id", "score")
    m = written(m, "chat-tree")
    # up: the ancestor 2**k steps up; top: the last message reached, in the end the root; total, depth: score and number of the messages passed, itself included.
    # Messages that have reached their root stay as they are, so long conversations alone have rows to move in many rounds.
    live = m.select("conv_id", "msg_id", F.col("parent_id").alias("up"), F.col("score").alias("total"), F.lit(1).cast("long").alias("depth"), F.coalesce("parent_id", "msg_id").alias("top"))
    levels, size = [], m.count()
    while True:
        live = written(live, "chat-jump")
        levels.append(live)
        moving = live.where("up IS NOT NULL")
        if 1 << (len(levels) - 1) > size or moving.isEmpty():
            break
        upper = live.select("conv_id", F.col("msg_id").alias("up"), F.col("up").alias("up2"), F.col("total").alias("total2"), F.col("depth").alias("depth2"), F.col("top").alias("top2"))
        moved = moving.join(upper, ["conv_id", "up"]).select("conv_id", "msg_id", F.col("up2").alias("up"), (F.col("total") + F.col("total2")).alias("total"), (F.col("depth") + F.col("depth2")).alias("depth"), F.col("top2").alias("top"))
        live = live.where("up IS NULL").union(moved)
    rooted = live.where("up IS NULL")
    parents = m.where("parent_id IS NOT NULL").select("conv_id", F.col("parent_id").alias("msg_id")).distinct()
    leaves = rooted.join(parents, ["conv_id", "msg_id"], "left_anti").withColumn("path_score", F.col("total") / F.col("depth"))
    order = F.col("path_score").desc(), "msg_id"
    chosen = leaves.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id", "top").orderBy(*order))).where(F.col("rank") <= branches)
    chosen = chosen.withColumn("branch", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)))  # the trees of a conversation share the numbers
    path = chosen.select("conv_id", "branch", "path_score", "msg_id", F.col("depth").alias("step"))
    for k in range(len(levels) - 2, -1, -1):  # from each listed message also the one 2**k steps up: every step once
        upper = levels[k].where("up IS NOT NULL").select("conv_id", "msg_id", "up")
        more = path.join(upper, ["conv_id", "msg_id"]).select("conv_id", "branch", "path_score", F.col("up").alias("msg_id"), (F.col("step") - F.lit(1 << k)).alias("step"))
        path = written(path.union(more), "chat-path")
    return path.join(said.select("conv_id", "msg_id", "role", "text"), ["conv_id", "msg_id"]).select("conv_id", "branch", "path_score", "step", "role", "text")


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = {n: [] for n in ("conv_id", "branch", "path_score", "formatted", "loss_mask")}
        for r in batch.to_pylist():
            text, mask = write_chat([(t["role"], t["text"]) for t in r["turns"]])
            for name, value in zip(rows, (r["conv_id"], r["branch"], r["path_score"], text, mask), strict=True):
                rows[name].append(value)
        rows["loss_mask"] = [[{"start": a, "end": b} for a, b in m] for m in rows["loss_mask"]]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([pa.array(rows["conv_id"], pa.int64()), pa.array(rows["branch"], pa.int32()), pa.array(rows["path_score"], pa.float64()), pa.array(rows["formatted"], pa.string()), pa.array(rows["loss_mask"], kind)], names=list(rows))


def chat_format(messages: DataFrame, branches: int = 1) -> DataFrame:
    """One row per chosen path: conv_id, branch, path_score, formatted, loss_mask (code points of `formatted`). See reply_paths.

    A path is one output text, so one task holds the turns of a path, as it must. Empty tables give an empty result; other columns are ignored.
    """
    paths = reply_paths(messages, branches)
    turns = paths.groupBy("conv_id", "branch", "path_score").agg(F.sort_array(F.collect_list(F.struct("step", "role", "text"))).alias("turns"))
    kinds = "conv_id long, branch int, path_score double, formatted string, loss_mask array<struct<start: long, end: long>>"
    return turns.mapInArrow(_format, kinds)


def thread_messages(turns: DataFrame) -> DataFrame:
    """Linear conversations (conv_id, turn, role, text) as reply trees: each turn answers the one before it; the score is 0.

    Turns that share a number follow each other by role and text, so that repeated rows are turns of their own. A null turn comes first.
    """
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return turns.select("conv_id", F.row_number().over(w).cast("long").alias("msg_id"), "role", "text").withColumn("parent_id", F.when(F.col("msg_id") > 1, F.col("msg_id") - 1)).withColumn("score", F.lit(0.0))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    for batch in batches:
        out = {n: [] for n in names}
        for r in batch.to_pylist():
            turns = read_chat(r["formatted"])
            loss = "".join(unescape(r["formatted"][s["start"] : s["end"]]) for s in r["loss_mask"])
            spelled = "".join(f"{role}\n{text}\n" for role, text in turns)
            for name, value in zip(names, (r["conv_id"], len(turns), hashlib.sha256(spelled.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(r["formatted"])), strict=True):
                out[name].append(value)
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]))


def chat_digests(formatted: DataFrame) -> DataFrame:
    """conv_id and digests, read back from formatted conversations and their masks."""
    return formatted.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
