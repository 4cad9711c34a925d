"""HTML text -> tokens, by one pass over the bytes with compiled patterns.

A token is a tuple (type, name, value, attrs, end, quirks): type is open, close, close_self, text, comment or doctype, attrs a list of
(name, value, has_value), end the byte offset after the token. Text values also say how they may be decoded: see RCDATA and RAW.
Byte offsets are kept throughout, as limits and error positions count bytes.
"""

from __future__ import annotations

import re
from functools import lru_cache

from domspark.functions.text import decode_entities
from domspark.options import VOID_TAGS, Options

from .errors import Notes

OPEN, CLOSE, CLOSE_SELF, TEXT, COMMENT, DOCTYPE = "open", "close", "close_self", "text", "comment", "doctype"
# How a text token came about: from ordinary data, from an element whose entities were decoded already, or from one whose entities are none.
DATA, RCDATA, RAW = 0, 1, 2

# Elements whose content is read as text, in documents, and by the context element in fragments.
DOCUMENT_TEXT = {"script": "script", "svg": "raw", "style": "raw", "noscript": "raw", "textarea": "rcdata", "title": "rcdata", "plaintext": "plain"}
FRAGMENT_TEXT = {"svg": "raw", "title": "rcdata", "textarea": "rcdata", "style": "raw", "xmp": "raw", "iframe": "raw", "noembed": "raw", "noframes": "raw", "script": "script", "plaintext": "plain"}
_LABEL = {"script": "script", "raw": "RAWTEXT", "rcdata": "RCDATA"}
_AT_END = {"script": "script data", "raw": "RAWTEXT", "rcdata": "RCDATA"}

_SPACE = rb"[ \t\n\r\f]*"
_NAME = re.compile(rb"[^ \t\n\r\f/>\x00]+")
_BLANK = re.compile(_SPACE)
_ATTR_NAME = re.compile(rb"[^ \t\n\r\f/>\x00=\"']+")
_UNQUOTED = re.compile(rb"[^ \t\n\r\f>]*")
_ODD = re.compile(rb"[\"'=`<]")
_LETTERS = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
# A plain tag: nothing but quoted attributes with ordinary names.
_QUICK = re.compile(rb"<(?:/([A-Za-z][A-Za-z0-9]*)>|([A-Za-z][A-Za-z0-9]*)((?:[ \t\n\r\f]+[A-Za-z_:][A-Za-z0-9_:-]*=(?:\"[^\"\x00]*\"|'[^'\x00]*'))*)[ \t\n\r\f]*>)")
_PLAIN_ATTR = re.compile(rb"([A-Za-z_:][A-Za-z0-9_:-]*)=(?:\"([^\"]*)\"|'([^']*)')")


def _text(data: bytes) -> str:
    return data.decode("utf-8", "replace")


@lru_cache(maxsize=256)
def _closing(tag: str) -> re.Pattern:
    """What ends the text of an element."""
    return re.compile(rb"</" + re.escape(tag.encode()) + _SPACE + rb"(?:(?:/" + _SPACE + rb")?(>)|/?\Z)", re.I)


class _Spelled(dict):
    """Names as they are decoded and folded, made once. Pages may make up names without end, so it is emptied now and then."""

    def __missing__(self, name: bytes) -> str:
        if len(self) > 10_000:
            self.clear()
        made = self[name] = _text(name.lower())
        return made


_SPELLED = _Spelled()


def cut(data: bytes, limit: int) -> bytes:
    """At most `limit` bytes, without a broken character at the end."""
    return data[:limit].decode("utf-8", "ignore").encode()


class Scanner:
    def __init__(self, source: bytes, options: Options, state: str = "data", last_tag: str = ""):
        self.source, self.options, self.state, self.last_tag = source, options, state, last_tag
        self.notes = Notes(source, options.error_handling == "strict")
        self._note = self.notes.add
        self.at = 0

    @property
    def errors(self) -> list[tuple[str, str, int, int, int]]:
        return self.notes.rows

    @property
    def position(self) -> int:
        """Bytes of the source that the tokens so far come from."""
        return self.at

    @property
    def has_more(self) -> bool:
        return self.at < len(self.source)

    def _quick(self):
        """Runs of plain text and plain tags, which most pages consist of, up to whatever needs a closer look."""
        src, size, options = self.source, len(self.source), self.options
        find, plain, spelled, voids = src.find, _QUICK.match, _SPELLED, options.void_elements or VOID_TAGS
        longest = options.max_text_length
        checked = options.max_attributes, options.max_attribute_name_length, options.max_attribute_value_length
        at = self.at
        while at < size:
            if src[at] != 60:
                end = find(b"<", at)
                if end < 0:
                    end = size
                if end - at > longest:
                    break
                self.at = end
                yield (TEXT, "", src[at:end].decode("utf-8", "replace"), DATA, end, False)
                at = end
                continue
            m = plain(src, at)
            if m is None:
                break
            close, name, raw = m.groups()
            at = m.end()
            if close is not None:
                self.at = at
                yield (CLOSE, spelled[close], "", (), at, False)
                continue
            name = spelled[name]
            attrs = []
            if raw:
                pairs = _PLAIN_ATTR.findall(raw)
                if len(pairs) > checked[0] or any(len(n) > checked[1] or len(a or b) > checked[2] for n, a, b in pairs):
                    break
                attrs = [(spelled[n], (a or b).decode("utf-8", "replace"), True) for n, a, b in pairs]
            self.at = at
            self.last_tag = name
            if name in voids:
                yield (CLOSE_SELF, name, "", attrs, at, False)
                continue
            state = DOCUMENT_TEXT.get(name)
            if state:
                self.state = state
            yield (OPEN, name, "", attrs, at, False)
            if state:
                break

    # ---- tokens ----

    def __iter__(self):
        size = len(self.source)
        quick = not self.options.preserve_case
        while self.at < size:
            if self.state == "data":
                if quick:
                    yield from self._quick()
                    if self.state != "data" or self.at >= size:
                        continue
                if self.source[self.at] == 60:
                    made = self._markup()
                else:
                    made = self._data()
            elif self.state == "plain":
                made, self.at = self._made_text(self.source[self.at :], size, DATA), size
            elif self.state == "cdata":
                end = self.source.find(b"]]>", self.at)
                stop = size if end < 0 else end
                data, self.at = self.source[self.at : stop], min(size, stop + 3)
                self.state = "data"
                made = self._made_text(data, self.at, DATA)
            else:
                made = self._element_text()
            if made is not None:
                yield made

    def _made_text(self, data: bytes, end: int, how: int):
        if not data:
            return None
        if len(data) > self.options.max_text_length:
            self._note("TextTooLong", "Text node length limit exceeded", end)
            data = cut(data, self.options.max_text_length)
        return (TEXT, "", _text(data), how, end, False)

    def _data(self):
        start = self.at
        end = self.source.find(b"<", start)
        self.at = len(self.source) if end < 0 else end
        return self._made_text(self.source[start : self.at], self.at, DATA)

    def _markup(self):
        src, at = self.source, self.at + 1
        if at >= len(src):
            self.at = at
            return None
        c = src[at]
        if c in _LETTERS:
            return self._start_tag(at)
        if c == 47:
            return self._end_tag(at + 1)
        if c == 33:
            at += 1
            if src[at : at + 7].lower() == b"doctype":
                return self._doctype(at + 7)
            if src.startswith(b"[CDATA[", at):
                end = src.find(b"]]", at + 7)
                data, self.at = (src[at + 7 :], len(src)) if end < 0 else (src[at + 7 : end], end + 2 + (src[end + 2 : end + 3] == b">"))
                return self._made_text(data, self.at, DATA)
            return self._comment(at)
        if c == 63:
            end = src.find(b">", at)
            self.at = len(src) if end < 0 else end + 1
            return None
        self.at = at
        return (TEXT, "", "<", DATA, at, False)

    def _comment(self, at: int):
        src = self.source
        at += 2 * src.startswith(b"--", at)
        end = src.find(b"-->", at)
        if end < 0:
            self.at = len(src)
            if at < len(src):
                self._note("UnexpectedEOF", "Unexpected EOF in comment", self.at)
                return (COMMENT, "", _text(src[at:]), (), self.at, False)
            return None
        self.at = end + 3
        return (COMMENT, "", _text(src[at:end]), (), self.at, False)

    def _doctype(self, at: int):
        src = self.source
        at = _BLANK.match(src, at).end()
        stop = at
        while stop < len(src) and src[stop] not in b"> \t\n\r\f":
            stop += 1
        name = _text(src[at:stop].lower())
        end = src.find(b">", stop)
        self.at = len(src) if end < 0 else end + 1
        if end < 0:
            self._note("UnexpectedEOF", "Unexpected EOF in DOCTYPE", self.at)
        return (DOCTYPE, name, "", (), self.at, end < 0)

    def _end_tag(self, at: int):
        src = self.source
        if at >= len(src):
            self.at = at
            return None
        if src[at] == 62:
            self._note("InvalidToken", "Empty end tag", at)
            self.at = at + 1
            return None
        if src[at] not in _LETTERS:
            self._note("InvalidToken", "Invalid character after </", at)
            self.at = at
            return None
        m = _NAME.match(src, at)
        name = m[0] if self.options.preserve_case else m[0].lower()
        at = _BLANK.match(src, m.end()).end()
        if src[at : at + 1] == b">":
            self.at = at + 1
            return (CLOSE, _text(name), "", (), self.at, False)
        if at >= len(src) or src[at] == 0:
            self._note("UnexpectedEOF", "Unexpected EOF in end tag name", at)
            # what begins with NUL is text again; a mode that goes on steps over it
            self.at = at if self.options.error_handling == "lenient" else at + 1
            return None
        self._note("InvalidToken", "Invalid character in end tag", at)
        end = src.find(b">", at)
        self.at = len(src) if end < 0 else end + 1
        return (CLOSE, _text(name), "", (), self.at, False)

    def _opened(self, name: str, attrs: list, kind: str):
        """A start tag that ends here. It may switch the state: the content of some elements is text."""
        if kind == OPEN:
            if self.options.is_void(name):
                kind = CLOSE_SELF
            self.last_tag = name
            if kind == OPEN:
                self.state = DOCUMENT_TEXT.get(name.lower(), "data")
        return (kind, name, "", attrs, self.at, False)

    def _start_tag(self, at: int):
        src, options = self.source, self.options
        m = _NAME.match(src, at)
        name = _text(m[0] if options.preserve_case else m[0].lower())
        attrs: list[tuple[str, str, bool]] = []
        at, where = m.end(), "in tag name"
        while True:
            blank = _BLANK.match(src, at).end()
            c = src[blank] if blank < len(src) else 0
            if c == 62:
                self.at = blank + 1
                return self._opened(name, attrs, OPEN)
            if c == 0:
                return self._broken(blank, where if blank == at else "before attribute name")
            if c == 47:
                if src[blank + 1 : blank + 2] == b">":
                    self.at = blank + 2
                    return self._opened(name, attrs, CLOSE_SELF)
                if blank + 1 >= len(src) or src[blank + 1] == 0:
                    return self._broken(blank + 1, "in self-closing tag")
                self._note("InvalidToken", "Unexpected character after '/' in self-closing start tag", blank + 1)
                at, where = blank + 1, "before attribute name"
                continue
            if c in b"\"'=":
                self._note("InvalidToken", "Unexpected character before attribute name", blank)
                at, where = blank + 1, "before attribute name"
                if options.error_handling == "lenient":
                    self.at = at
                    return None
                continue
            at, where, lost = self._attribute(blank, attrs)
            if lost:
                return None

    def _broken(self, at: int, where: str):
        """The source ends, or holds a NUL, within a tag: the tag is lost."""
        self._note("UnexpectedEOF", f"Unexpected EOF {where}", at)
        self.at = at if self.options.error_handling == "lenient" else at + 1
        return None

    def _attribute(self, at: int, attrs: list) -> tuple[int, str, bool]:
        """Where the attribute ends, what to say if the source ends there, and whether the tag is lost with it."""
        src = self.source
        m = _ATTR_NAME.match(src, at)
        name, at = m[0], m.end()
        after = _BLANK.match(src, at).end()
        c = src[after] if after < len(src) else 0
        if c == 0:
            self._broken(after, "after attribute name" if after > at else "in attribute name")
            return after, "", True
        if c != 61:
            self._keep(attrs, name, None, after)
            return after, "before attribute name", False
        at = _BLANK.match(src, after + 1).end()
        c = src[at] if at < len(src) else 0
        if at >= len(src):
            self._broken(at, "in attribute value")
            return at, "", True
        if c == 62:
            self._note("InvalidToken", "Missing attribute value", at)
            self._keep(attrs, name, None, at)
            return at, "", False
        if c in b"\"'":
            end = src.find(bytes((c,)), at + 1)
            if end < 0:
                self._broken(len(src), "in attribute value")
                return len(src), "", True
            self._keep(attrs, name, src[at + 1 : end], end)
            at = end + 1
            if at < len(src) and src[at] not in b"\x00 \t\n\r\f>/":
                self._note("InvalidToken", "Missing whitespace between attributes", at)
            return at, "before attribute name", False
        end = _UNQUOTED.match(src, at + 1).end()
        for odd in _ODD.finditer(src, at + 1, end):
            self._note("InvalidToken", "Unexpected character in unquoted attribute value", odd.start())
        if end >= len(src):
            self._broken(end, "in attribute value")
            return end, "", True
        self._keep(attrs, name, src[at:end], end)
        return end, "before attribute name", False

    def _keep(self, attrs: list, name: bytes, value: bytes | None, at: int) -> None:
        options = self.options
        if len(attrs) >= options.max_attributes:
            return self._note("TooManyAttributes", "Attribute count limit exceeded", at)
        if len(name) > options.max_attribute_name_length:
            return self._note("AttributeTooLong", "Attribute name length limit exceeded", at)
        if value is not None and len(value) > options.max_attribute_value_length:
            self._note("AttributeTooLong", "Attribute value length limit exceeded", at)
            value = cut(value, options.max_attribute_value_length)
        attrs.append((_text(name if options.preserve_case else name.lower()), "" if value is None else _text(value), value is not None))
        return None

    def _element_text(self):
        """The text up to the end tag of the last start tag, then that end tag."""
        src, kind, start = self.source, self.state, self.at
        tag = self.last_tag or ("script" if kind == "script" else "")
        if not tag:
            self.state = "data"
            return None
        how = RCDATA if kind == "rcdata" else RAW
        close = _closing(tag).search(src, start)
        if close and close[1]:
            if close.start() > start:
                self.at = close.start()
                return self._element_made(src[start : self.at], how)
            self.at, self.state = close.end(), "data"
            return (CLOSE, tag, "", (), self.at, False)
        self.state, self.at = "data", len(src)
        if close and len(close[0]) > 2 + len(tag):  # white space or a slash follows the name, and then nothing
            self._note("UnexpectedEOF", f"Unexpected EOF in {_LABEL[kind]} end tag", self.at)
            return self._element_made(src[start : close.start()], how)
        return self._element_made(src[start:], how)

    def _element_made(self, data: bytes, how: int):
        if how == RCDATA:
            data = decode_entities(_text(data)).encode()
        return self._made_text(data, self.at, how)


def tokenize(html: str, options: Options = Options(), state: str = "data", last_tag: str = "") -> tuple[list[tuple], list[tuple]]:
    """All tokens and all errors of a text."""
    scanner = Scanner(html.encode("utf-8", "replace"), options, state, last_tag)
    return list(scanner), scanner.errors
