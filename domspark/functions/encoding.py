"""Encodings of HTML bytes: sniffing and decoding."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

HINT = "struct<detected_label: string, canonical_label: string, source: string, helper_supported: boolean>"
PREFIX = 4096  # bytes that are searched for a meta charset

# Labels and what they mean.
ALIASES = {
    "utf-8": ("utf-8", "utf8", "unicode-1-1-utf-8"),
    "utf-16le": ("utf-16", "utf-16le"),
    "utf-16be": ("utf-16be",),
    "gbk": ("gbk", "gb2312", "gb-2312", "gb_2312", "gb18030", "gb-18030", "gb_18030", "cp936", "ms936", "x-gbk"),
    "windows-1252": ("windows-1252", "cp1252", "x-cp1252", "iso-8859-1", "iso8859-1", "iso_8859-1", "latin1", "l1"),
    "shift_jis": ("shift_jis", "shift-jis", "sjis", "cp932", "ms932", "windows-31j", "x-sjis", "csshiftjis"),
}
CANONICAL = {label: name for name, labels in ALIASES.items() for label in labels}
_CODECS = {"gbk": "gbk", "windows-1252": "cp1252", "shift_jis": "cp932", "utf-16le": "utf-16-le", "utf-16be": "utf-16-be"}
_META = re.compile(rb"<meta\b[^>]*?charset\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'/>;]+))")


def normalize_label(label: str) -> str:
    """The canonical label of the leading letters, digits, hyphens and underscores; one that isn't known stays as it is, lower-cased."""
    name = re.match(r"[A-Za-z0-9_-]*", label.strip(" \t\r\n\f"))[0].lower()
    return CANONICAL.get(name, name)


def meta_charset(data: bytes) -> str | None:
    m = _META.search(data[:PREFIX].lower())
    label = (m[1] or m[2] or m[3] or b"").decode("ascii", "ignore").strip() if m else ""
    if m and (nested := re.search(r"charset\s*=\s*([^\s;]+)", label)):
        label = nested[1]
    return label or None


def is_valid_utf8(data: bytes) -> bool:
    try:
        data.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def sniff_html_encoding(data: bytes) -> tuple[str, str, str, bool]:
    """(detected label, canonical label, source, whether decode_html_bytes knows it); the source is utf8_bom, utf16le_bom, utf16be_bom, meta_charset, utf8_heuristic or none."""
    for mark, label, source in ((b"\xef\xbb\xbf", "utf-8", "utf8_bom"), (b"\xff\xfe", "utf-16le", "utf16le_bom"), (b"\xfe\xff", "utf-16be", "utf16be_bom")):
        if data.startswith(mark):
            return label, label, source, True
    if (label := meta_charset(data)) is not None:
        name = normalize_label(label)
        return label, name, "meta_charset", name == "utf-8" or name in _CODECS
    if is_valid_utf8(data):
        return "utf-8", "utf-8", "utf8_heuristic", True
    return "", "", "none", False


def decode_html_bytes(data: bytes, label: str) -> str | None:
    """The text, without its BOM; None for an unknown label or malformed bytes. Broken UTF-16 gets replacement characters."""
    name = normalize_label(label)
    try:
        if name == "utf-8":
            return data.removeprefix(b"\xef\xbb\xbf").decode("utf-8")
        if name not in _CODECS:
            return None
        if name.startswith("utf-16"):
            return data.removeprefix(b"\xff\xfe" if name == "utf-16le" else b"\xfe\xff").decode(_CODECS[name], "replace")
        if name == "windows-1252":  # the five unassigned bytes are control characters, as browsers have it
            return "".join(bytes((b,)).decode("cp1252", "ignore") or chr(b) for b in data) if any(b in data for b in b"\x81\x8d\x8f\x90\x9d") else data.decode("cp1252")
        return data.decode(_CODECS[name])
    except UnicodeDecodeError:
        return None


def _sniff(data: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([sniff_html_encoding(bytes(d) if d is not None else b"") for d in data], columns=["detected_label", "canonical_label", "source", "helper_supported"])


def _decode(data: pd.Series, label: pd.Series) -> pd.Series:
    return pd.Series([None if d is None or n is None else decode_html_bytes(bytes(d), n) for d, n in zip(data, label)], dtype=object)


def encoding_hint(content: Column | str) -> Column:
    return F.pandas_udf(_sniff, HINT)(content)


def decoded(content: Column | str, label: Column | str) -> Column:
    return F.pandas_udf(_decode, "string")(content, label)


def canonical_label(label: Column) -> Column:
    """normalize_label as a column."""
    plain = F.lower(F.regexp_extract(label, r"^[ \t\r\n\f]*([A-Za-z0-9_-]*)", 1))
    known = F.create_map(*[F.lit(x) for kv in CANONICAL.items() for x in kv])
    return F.coalesce(F.try_element_at(known, plain), plain)


def bom(content: Column) -> Column:
    """utf-8, utf-16le or utf-16be by the byte order mark, else null."""
    head = F.hex(F.substring(content, 1, 3))
    return F.when(head == "EFBBBF", "utf-8").when(head.startswith("FFFE"), "utf-16le").when(head.startswith("FEFF"), "utf-16be")
