"""String functions, for Python code in the parser and as Spark columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

HTML_SPACE = " \t\n\r\f"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(_UPPER, _LOWER)
_SPACES = re.compile("[ \t\n\r\f]+")

# The named entities that are decoded. A no-break space becomes a plain one.
ENTITIES = {
    "amp": "&",
    "lt": "<",
    "gt": ">",
    "quot": '"',
    "apos": "'",
    "nbsp": " ",
    "copy": "©",
    "reg": "®",
    "trade": "™",
    "mdash": "—",
    "ndash": "–",
    "hellip": "…",
    "middot": "·",
    "bull": "•",
    "euro": "€",
    "laquo": "«",
    "raquo": "»",
    "iexcl": "¡",
    "cent": "¢",
    "pound": "£",
    "yen": "¥",
    "sect": "§",
    "para": "¶",
    "deg": "°",
    "times": "×",
    "divide": "÷",
}
_ENTITY = re.compile("&(?:#(?:[xX]([0-9A-Fa-f]+)|([0-9]+))|(" + "|".join(ENTITIES) + "));")


def fold(s: str) -> str:
    """A-Z as a-z."""
    return s.lower() if s.isascii() else s.translate(_FOLD)


def _decoded(m: re.Match) -> str:
    if m[3]:
        return ENTITIES[m[3]]
    digits = (m[1] or m[2]).lstrip("0")
    if not digits or len(digits) > 7:
        return m[0]
    value = int(digits, 16 if m[1] else 10)
    return m[0] if value > 0x10FFFF or 0xD800 <= value < 0xE000 else chr(value)


def decode_entities(s: str) -> str:
    """One pass over named, decimal and hexadecimal entities that end with a semicolon; any others stay as they are."""
    return _ENTITY.sub(_decoded, s) if "&" in s else s


def collapse_spaces(s: str) -> str:
    return _SPACES.sub(" ", s)


def class_set(value: str) -> list[str]:
    return list(dict.fromkeys(x for x in _SPACES.split(value) if x)) if value else []


# ---- the same as columns ----


def to_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def to_upper(c: Column) -> Column:
    return F.translate(c, _LOWER, _UPPER)


def trim_whitespace(c: Column) -> Column:
    return F.regexp_replace(c, r"^[ \t\n\r\f]+|[ \t\n\r\f]+$", "")


def normalize_whitespace(c: Column) -> Column:
    """Runs of HTML white space as one space; the ends are not trimmed."""
    return F.regexp_replace(c, r"[ \t\n\r\f]+", " ")


def equals_ignore_case(a: Column, b: Column) -> Column:
    return to_lower(a) == to_lower(b)


def starts_with_ignore_case(c: Column, prefix: Column) -> Column:
    return F.startswith(to_lower(c), to_lower(prefix))


def split_class_names(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(c, r"[ \t\n\r\f]+"), lambda x: x != ""))


def is_letter(c: Column) -> Column:
    return c.rlike("^[A-Za-z]$")


is_alpha = is_letter


def is_digit(c: Column) -> Column:
    return c.rlike("^[0-9]$")


def is_hex_digit(c: Column) -> Column:
    return c.rlike("^[0-9A-Fa-f]$")


def is_alnum(c: Column) -> Column:
    return c.rlike("^[A-Za-z0-9]$")


def is_whitespace(c: Column) -> Column:
    return c.rlike(r"^[ \t\n\r\f]$")


# Elements whose content is not markup.
RAW_TEXT_TAGS = ("script", "style", "textarea", "title", "noscript", "iframe", "noembed", "noframes", "xmp", "plaintext")


def is_raw_text_tag(c: Column) -> Column:
    return to_lower(c).isin(*RAW_TEXT_TAGS)


def decode_html_entities(c: Column) -> Column:
    """decode_entities for a column, without Python.

    The string is cut before every `&`; a piece that opens with an entity has it replaced, and the pieces are joined again. No
    replaced character is read a second time.
    """
    pieces = F.split(c, "&", -1)
    named = F.create_map(*[x for k, v in ENTITIES.items() for x in (F.lit(k), F.lit(v))])

    def one(p: Column, i: Column) -> Column:
        head = F.substring_index(p, ";", 1)
        rest = F.substr(p, F.length(head) + 2)
        hexes = F.regexp_extract(head, "^#[xX]0*([0-9A-Fa-f]{1,6})$", 1)
        decimals = F.regexp_extract(head, "^#0*([0-9]{1,7})$", 1)
        code = F.when(hexes != "", F.conv(hexes, 16, 10)).when(decimals != "", decimals).cast("int")
        fits = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        utf8 = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        put = F.when(fits, utf8).otherwise(F.try_element_at(named, head))
        whole = F.contains(p, F.lit(";")) & put.isNotNull()
        return F.when(i == 0, p).when(whole, F.concat(put, rest)).otherwise(F.concat(F.lit("&"), p))

    return F.array_join(F.transform(pieces, one), "")
