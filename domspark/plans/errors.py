"""Diagnostics of parsing and of selectors."""

from __future__ import annotations

import re
from bisect import bisect_left


class HtmlError(Exception):
    """Raised in strict mode."""

    def __init__(self, code: str, message: str, position: int = 0, line: int = 1, col: int = 1):
        super().__init__(f"{code} at line {line}, column {col}: {message}")
        self.code, self.message, self.position, self.line, self.col = code, message, position, line, col

    def __reduce__(self):
        return type(self), (self.code, self.message, self.position, self.line, self.col)


class FileReadError(OSError):
    """A file that can't be read; `code` is FileReadError."""

    code = "FileReadError"


class SelectorError(ValueError):
    """A selector that can't be read; `code` is InvalidSelector."""

    code = "InvalidSelector"


class Notes:
    """The errors of one source, as (code, message, position, line, column). Line breaks are looked up once, however many errors there are."""

    def __init__(self, source: bytes, strict: bool):
        self.source, self.strict, self.rows = source, strict, []
        self._breaks: list[int] | None = None

    def located(self, position: int) -> tuple[int, int, int]:
        """position, line and column of a byte offset; lines and columns start at 1, columns count bytes."""
        position = min(position, len(self.source))
        if not position:
            return 0, 1, 1
        if self._breaks is None:
            self._breaks = [m.start() for m in re.finditer(b"\n", self.source)]
        line = bisect_left(self._breaks, position)
        return position, line + 1, position - (self._breaks[line - 1] if line else -1)

    def add(self, code: str, message: str, at: int = 0) -> None:
        row = (code, message, *self.located(at))
        self.rows.append(row)
        if self.strict:
            raise HtmlError(*row)
