"""Personal data by a semi-Markov conditional random field over whole spans.

The text is cut into tokens; a segmentation covers a stretch of them with single outside tokens and with entity spans of a bounded
number of tokens, each of a kind. A span is scored as a whole: its digits, groups, separators, checksum, the characters around it and the
word before it. Dynamic programming over all segmentations finds the best one, boundaries and kinds at once. The field was trained
on generated stretches of known segmentation (see `examples`), as the corpus has no labelled spans; its weights are in pii_weights.py.

A span of less than seven digits and without an at sign can't be an entity, so the program only runs on the stretches around
such candidates; elsewhere the all-outside segmentation is the only one. The whole text is searched for stretches, and a stretch is as long as it is.

Spans of the fixed base patterns always stay. The field's spans are added where they overlap no base span and no other span.
"""

from __future__ import annotations

import functools
import hashlib
import os
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
# The base patterns, as they are fixed.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

MAX_TOKENS = 15  # of a span
MARGIN = 24  # characters of context on both sides of a stretch
_DIGITS = re.compile(r"(?<![0-9])[0-9](?:[\x20().\-/]{0,3}[0-9]){6,}")
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\s|.", re.S)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """The leftmost matches of the email pattern, found from the at signs, which keeps long words linear."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((start, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(done, at + 1))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the base patterns' matches that pass their checks, by start and kind."""
    out = [(a, 0, b) for a, b in emails(text)]
    if "." in text:
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


_NAMES = [
    "bias", "digits<7", "digits7", "digits8-9", "digits10", "digits11", "digits12", "digits13-15", "digits16", "digits17-19", "digits>19",
    "luhn", "luhn fails", "plus", "paren", "octets", "four parts, not octets", "dots", "dashes", "spaces", "slash", "mixed separators",
    "letters", "letters and digits touch", "at", "domain", "at without domain", "no separator", "joined before", "joined after",
    "starts with separator", "ends with separator", "short groups", "phone groups", "card groups", "year first", "cue phone", "cue card", "cue ip", "cue email",
    "trunk zero", "even groups", "groups of two", "one group", "phone length", "plus and phone length", "inner comma",
    "trunk zero in groups", "three phone groups",
]
_AT = {n: i for i, n in enumerate(_NAMES)}
_CUES = {"cue phone": ("phone", "tel", "call", "mobile", "fax"), "cue card": ("card", "visa", "credit"), "cue ip": ("ip", "host", "address", "server"), "cue email": ("email", "mail", "contact")}


def span_features(text: str, a: int, b: int) -> list[int]:
    """The features that hold for the span text[a:b] as a whole; none if it can't be an entity."""
    s = text[a:b]
    digits = "".join(c for c in s if "0" <= c <= "9")
    n, has_at = len(digits), "@" in s
    if n < 7 and not has_at:
        return []
    on = ["bias"]
    on.append("digits<7" if n < 7 else "digits7" if n == 7 else "digits8-9" if n < 10 else "digits10" if n == 10 else "digits11" if n == 11 else "digits12" if n == 12 else "digits13-15" if n < 16 else "digits16" if n == 16 else "digits17-19" if n < 20 else "digits>19")
    groups = [g for g in re.split(r"[^0-9]+", s) if g]
    if 12 <= n <= 19:
        on.append("luhn" if luhn(digits) else "luhn fails")
    letters = any(c.isalpha() for c in s)
    if has_at:
        on.append("at")
        local, _, domain = s.partition("@")
        on.append("domain" if local and re.fullmatch(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", domain) else "at without domain")
    parts = s.split(".")
    if len(parts) == 4 and all(p.isdigit() for p in parts):
        on.append("octets" if all(len(p) < 4 and int(p) < 256 for p in parts) else "four parts, not octets")
    seps = {c for c in s if not c.isalnum()} - {"(", ")", "+", "@"}
    on += [name for name, c in (("plus", "+"), ("paren", "("), ("dots", "."), ("dashes", "-"), ("spaces", " "), ("slash", "/")) if c in s]
    if len(seps) > 1:
        on.append("mixed separators")
    if not seps:
        on.append("no separator")
    if letters:
        on.append("letters")
        if re.search(r"[0-9][^\W\d_]|[^\W\d_][0-9]", s):
            on.append("letters and digits touch")
    before, after = text[a - 1 : a] if a else "", text[b : b + 1]
    if before and (before.isalnum() or before in "@+_=$#" or before in ".-" and text[a - 2 : a - 1].isalnum()):
        on.append("joined before")
    if after and (after.isalnum() or after in "@_%" or after in ".-" and text[b + 1 : b + 2].isalnum()):
        on.append("joined after")
    if not (s[0].isalnum() or s[0] in "(+"):
        on.append("starts with separator")
    if not s[-1].isalnum():
        on.append("ends with separator")
    sizes = [len(g) for g in groups]
    if sizes and max(sizes) < 3 and n >= 7:
        on.append("short groups")
    if sizes[-2:] == [3, 4] and len(sizes) >= 2:
        on.append("phone groups")
    if len(sizes) > 2 and set(sizes[:-1]) == {4}:
        on.append("card groups")
    if sizes and sizes[0] == 4 and digits[:2] in ("19", "20"):
        on.append("year first")
    if digits.startswith("0"):
        on.append("trunk zero")
    if len(sizes) > 1 and min(sizes[1:]) >= 2 and max(sizes) <= 4:
        on.append("even groups")
    if digits.startswith("0") and 9 <= n <= 14 and 1 < len(sizes) < 6 and len(seps) < 2:
        on.append("trunk zero in groups")
    if sizes[-3:] == [3, 3, 4] and len(sizes) < 5 and len(seps) < 3:
        on.append("three phone groups")
    if len(sizes) > 3 and set(sizes[1:]) == {2}:
        on.append("groups of two")
    if len(sizes) == 1:
        on.append("one group")
    if 9 <= n <= 13:
        on.append("plus and phone length" if s[0] == "+" else "phone length")
    if "," in s:
        on.append("inner comma")
    lead = text[max(0, a - 16) : a].lower()
    on += [name for name, cues in _CUES.items() if any(c in lead for c in cues)]
    return [_AT[x] for x in on]


class Tokens:
    """The tokens of text[lo:hi], with running counts that tell at once which spans of them can be entities."""

    def __init__(self, text: str, lo: int, hi: int):
        self.text, self.cuts = text, [m.start() for m in _TOKEN.finditer(text, lo, hi)] + [hi]
        self.n = len(self.cuts) - 1
        self.opens = [text[c].isalnum() or text[c] in "+(" for c in self.cuts[:-1]]
        self.digits, self.ats = [0], [0]
        for i in range(self.n):
            token = text[self.cuts[i] : self.cuts[i + 1]]
            self.digits.append(self.digits[-1] + (sum("0" <= c <= "9" for c in token) if token[0].isdigit() else 0))
            self.ats.append(self.ats[-1] + (token == "@"))

    def spans(self, i: int) -> Iterator[tuple[int, list[int]]]:
        """(token after the last, features) of the spans from token i on that can be entities. A span has at most MAX_TOKENS tokens and one line."""
        if not self.opens[i]:
            return
        text, cuts, digits, ats = self.text, self.cuts, self.digits, self.ats
        for j in range(i + 1, min(self.n, i + MAX_TOKENS) + 1):
            last = text[cuts[j] - 1]
            if last == "\n":
                return
            if (digits[j] - digits[i] >= 7 or ats[j] > ats[i]) and last.isalnum() and (f := span_features(text, cuts[i], cuts[j])):
                yield j, f


def candidates(text: str, lo: int, hi: int) -> tuple[list[int], list[tuple[int, int, list[int]]]]:
    """Token starts (and the end) of text[lo:hi], and its spans (first token, token after the last, features)."""
    tokens = Tokens(text, lo, hi)
    return tokens.cuts, [(i, j, f) for i in range(tokens.n) for j, f in tokens.spans(i)]


class SpanField:
    """Semi-Markov field: weights (kind, feature) of spans; an outside token scores 0."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def scores(self, spans: list) -> np.ndarray:
        return np.array([self.weights[:, f].sum(axis=1) for _, _, f in spans]).reshape(-1, len(KINDS))

    @classmethod
    def fit(cls, chains: list[tuple[str, list[tuple[int, int, int]]]], rounds: int = 140, ridge: float = 0.001) -> SpanField:
        """Gradient ascent on the mean log-likelihood; the expectations come from forward and backward sums over all segmentations."""
        field, made = cls(np.zeros((len(KINDS), len(_NAMES)))), []
        for text, gold in chains:
            cuts, spans = candidates(text, 0, len(text))
            true = {(a, b): k for a, k, b in gold}
            want = [true.get((cuts[i], cuts[j]), -1) for i, j, _ in spans]
            made.append((len(cuts) - 1, spans, want))
        speed = np.zeros_like(field.weights)
        for _ in range(rounds):
            slope = -ridge * len(made) * field.weights
            for n, spans, want in made:
                if not spans:
                    continue
                for (_, _, f), p, w in zip(spans, field.expected(n, spans), want, strict=True):
                    q = -p
                    if w >= 0:
                        q[w] += 1
                    slope[:, f] += q[:, None]
            speed = 0.8 * speed + slope / len(made) * 5
            field.weights = field.weights + speed
        return field

    def expected(self, n: int, spans: list) -> np.ndarray:
        """P(span is a segment of the kind) for all spans."""
        scores = self.scores(spans)
        total = np.logaddexp.reduce(scores, axis=1)
        ends: dict[int, list[int]] = {}
        starts: dict[int, list[int]] = {}
        for s, (i, j, _) in enumerate(spans):
            ends.setdefault(j, []).append(s)
            starts.setdefault(i, []).append(s)
        ahead, back = [0.0] * (n + 1), [0.0] * (n + 1)
        for t in range(1, n + 1):
            at = [ahead[t - 1]] + [ahead[spans[s][0]] + total[s] for s in ends.get(t, ())]
            ahead[t] = at[0] if len(at) == 1 else float(np.logaddexp.reduce(at))
        for t in range(n - 1, -1, -1):
            at = [back[t + 1]] + [back[spans[s][1]] + total[s] for s in starts.get(t, ())]
            back[t] = at[0] if len(at) == 1 else float(np.logaddexp.reduce(at))
        around = np.array([ahead[i] + back[j] - ahead[n] for i, j, _ in spans])
        return np.exp(scores + around[:, None])

    def best(self, text: str, lo: int, hi: int) -> list[tuple[int, int, int]]:
        """(start, kind, end) of the entities of the best segmentation of text[lo:hi].

        Time and memory grow with the number of tokens, as a span has at most MAX_TOKENS of them; spans are scored as they are met and not kept.
        """
        tokens = Tokens(text, lo, hi)
        top, how, columns = [0.0] + [-1.0] * tokens.n, [None] * (tokens.n + 1), self.weights.T.tolist()
        for i in range(tokens.n):
            for j, f in tokens.spans(i):
                value, kind = max((sum(scores), -k) for k, scores in enumerate(zip(*(columns[x] for x in f))))
                if value > 0 and top[i] + value > top[j]:
                    top[j], how[j] = top[i] + value, (i, -kind)
            if top[i] >= top[i + 1]:
                top[i + 1], how[i + 1] = top[i], None
        out, t = [], tokens.n
        while t > 0:
            if how[t] is None:
                t -= 1
            else:
                i, kind = how[t]
                out.append((tokens.cuts[i], kind, tokens.cuts[t]))
                t = i
        return out[::-1]


def examples(count: int, seed: int = 7) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Generated stretches with their entities: numbers in the forms that people write, and numbers that are none of them."""
    r = random.Random(seed)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(2, 9)))

    def card() -> str:
        body = r.choice("3456") + d(14)
        body += next(c for c in "0123456789" if luhn(body + c))
        sep = r.choice(["", "", " ", "-"])
        return sep.join(body[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        area, mid, last = str(r.randint(200, 989)), d(3), d(4)
        sep = r.choice(" -.")
        return r.choice([
            f"+1 ({area}) {mid}-{last}", f"({area}) {mid}-{last}", f"({area}){sep}{mid}{sep}{last}", f"{area}-{mid}-{last}", f"{area}{sep}{mid}{sep}{last}", f"+{r.randint(20, 99)} {d(3)} {d(3)} {d(4)}", f"+{r.randint(20, 99)} {d(4)} {d(6)}", f"+1{area}{mid}{last}",
            f"1{sep}{area}{sep}{mid}{sep}{last}", f"0{d(2)}{sep}{d(4)}{sep}{d(4)}", f"0{d(3)}{r.choice(' /-')}{d(6)}", f"(0{d(2)}) {d(4)} {d(4)}", f"0{d(1)}{sep}{d(2)}{sep}{d(2)}{sep}{d(2)}{sep}{d(2)}", f"00{r.randint(20, 99)} {d(2)} {d(3)} {d(4)}",
        ])

    forms = [
        (0, lambda: f"{word()}{r.choice(['', '.', '_'])}{d(r.randint(0, 3))}@{word()}{d(r.randint(0, 1))}.{r.choice(['example.com', 'org', 'net', 'co.uk'])}"),
        (1, lambda: ".".join(str(r.randint(10, 255)) for _ in range(4))),
        (2, card),
        (3, phone),
    ]

    def junk() -> str:
        hexes = "".join(r.choice("0123456789abcdef") for _ in range(r.choice([16, 18, 32, 40])))
        return r.choice([hexes, f'"{hexes}"', f"={hexes}", d(r.randint(7, 24)), f"20{d(2)}-{d(2)}-{d(2)} {d(2)}:{d(2)}", f"{d(2)}/{d(2)}/20{d(2)} {d(4)}", f"{d(1)}.{d(2)}.{d(4)}.{d(3)}.{d(2)}", f"{r.randint(300, 999)}.{d(3)}.{d(3)}.{r.randint(300, 999)}", f"${d(3)},{d(3)},{d(3)}.{d(2)}", f"{d(5)}-{d(5)}-{d(5)}", f"@{word()} {word()}", f"{word()} @ {word()}", f"{d(3)} {d(2)} {d(1)} {d(4)} {d(2)}", " ".join(d(2) for _ in range(r.randint(7, 10))), f"{d(1)},{d(3)},{d(3)} {r.randint(1, 99)}", f"{d(2)}.{d(8)}", f"{d(4)} {d(4)} {d(4)}", f"#{d(9)}", f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}"])

    out = []
    for _ in range(count):
        text, gold = word() + " ", []
        lead = {0: ("mail", "e-mail:", "contact"), 1: ("host", "server", "ip:"), 2: ("card", "visa"), 3: ("call", "tel.", "phone:", "fax", "mobile")}
        for _ in range(r.choice([1, 1, 2])):
            if r.random() < 0.55:
                k, make = r.choice(forms)
                s = make()
                text += f"{r.choice(lead[k])} " if r.random() < 0.3 else ""
                plain = re.sub("[^0-9]", "", s)
                if k == 3 and 12 <= len(plain) <= 19 and luhn(plain):  # could be a card
                    continue
                gold.append((len(text), k, len(text) + len(s)))
            else:
                s = junk()
                plain = s.replace(" ", "").replace("-", "")
                if plain.isdigit() and 12 <= len(plain) <= 19 and luhn(plain):
                    continue
            text += s + r.choice([" ", ". ", ", ", "\n"]) + word() + " "
        out.append((text, gold))
    return out


def trained(count: int = 500) -> SpanField:
    """The field, fitted on `count` generated stretches."""
    return SpanField.fit(examples(count))


@functools.lru_cache(maxsize=1)
def field() -> SpanField:
    """The field that `trained()` gave, from pii_weights.py; `python -m domspark.llm.pii` makes that file anew."""
    from .pii_weights import WEIGHTS

    return SpanField(np.array([WEIGHTS[k] for k in KINDS]))


def stretches(text: str) -> list[tuple[int, int]]:
    """Where entities may be: around runs of seven digits or more and around words with an at sign, with MARGIN characters on both sides, which is more
    than any feature looks at. What overlaps is one stretch, however long."""
    marks, at, done = [m.span() for m in _DIGITS.finditer(text)], text.find("@"), 0
    while at >= 0:
        a, b = at, at + 1
        while a > done and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        marks.append((a, b))
        done = b
        at = text.find("@", b)
    out: list[list[int]] = []
    for a, b in sorted(marks):
        a, b = max(0, a - MARGIN), min(len(text), b + MARGIN)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def all_spans(text: str, field: SpanField) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base spans, and those of the field that overlap no base span."""
    base = base_spans(text)
    cover: list[list[int]] = []  # disjoint, ascending
    for a, _, b in base:
        if cover and a < cover[-1][1]:
            cover[-1][1] = max(cover[-1][1], b)
        else:
            cover.append([a, b])
    added: list[tuple[int, int, int]] = []
    at = 0
    for lo, hi in stretches(text):
        for a, k, b in field.best(text, lo, hi):
            while at < len(cover) and cover[at][1] <= a:
                at += 1
            if at == len(cover) or b <= cover[at][0]:
                added.append((a, k, b))
    return base, added


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def _find(field: SpanField):
    names = ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
    kinds = (pa.int64(),) * 5 + (pa.string(),) * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                base, added = all_spans(text.as_py(), field)
                n = [0] * len(KINDS)
                for _, k, _ in base:
                    n[k] += 1
                out.append((doc.as_py(), *n, hashlib.sha256(spelled(base).encode()).hexdigest(), spelled(base + added)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    return run


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    The counts and the digest are those of the base patterns, `spans` lists base spans and the field's as kind:start:end by start, then
    kind; positions are code points. A null text is empty and has none. Null and repeated doc_ids pass through. An empty table
    gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    kinds = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return rows.mapInArrow(_find(field()), kinds)


def masked(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id and the text with each span replaced by its kind in angle brackets; overlapping spans go as one,
    under the first's kind.

    A null text gives an empty one. Null and repeated doc_ids pass through. An empty table gives an empty result; other columns are ignored.
    """
    found = field()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text in batch.column(1):
                s, out, at = text.as_py(), [], 0
                for a, k, b in sorted(sum(all_spans(s, found), [])):
                    if a >= at:
                        out += [s[at:a], f"<{KINDS[k]}>"]
                    at = max(at, b)
                texts.append("".join([*out, s[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, text string")


def _write_weights() -> None:
    rows = trained().weights.round(3).tolist()
    lines = [f'    "{kind}": {row},' for kind, row in zip(KINDS, rows, strict=True)]
    with open(os.path.join(os.path.dirname(__file__), "pii_weights.py"), "w") as out:
        out.write('"""Weights of the features of `pii._NAMES`, in their order, by kind. Made by `python -m domspark.llm.pii`."""\n\nWEIGHTS = {\n' + "\n".join(lines) + "\n}\n")


if __name__ == "__main__":
    _write_weights()
