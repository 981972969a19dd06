"""Strict, bounded JSON parsing that keeps numbers as text and names the first error.

The C decoder of the standard library reads well-formed input within the limits; anything it or the
limits object to is read again by a scanner that finds the first error from the left.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

# The reasons of a quarantine.
SIZE = "size_exceeded"
DEPTH = "depth_exceeded"
FIELDS = "field_count_exceeded"
KEY_LENGTH = "key_length_exceeded"
DUPLICATE = "duplicate_key"
SYNTAX = "parse_error"
UTF8 = "utf8_error"


@dataclass(frozen=True)
class Limits:
    """Bounds of one record; the defaults are those of a stream of events."""

    max_bytes: int = 1 << 20
    max_depth: int = 32
    max_fields: int = 1024
    max_key_bytes: int = 256
    max_string_bytes: int = 64 << 10
    max_elements: int = 4096


class Number(str):
    """A JSON number as its source text."""

    __slots__ = ()


class Array(list):
    """A JSON array; ``truncated`` if elements beyond the limit were checked and left out."""

    truncated = False


class Rejected(Exception):
    def __init__(self, reason: str):
        super().__init__(reason)
        self.reason = reason


class _Slow(Exception):
    """The fast path gives way."""


def _pairs(found: list[tuple[str, object]]) -> dict:
    out = dict(found)
    if len(out) != len(found):
        raise _Slow
    return out


def _constant(_: str) -> object:
    raise _Slow


_fast = json.JSONDecoder(object_pairs_hook=_pairs, parse_int=Number, parse_float=Number, parse_constant=_constant)


def _within(node: object, depth: int, limits: Limits) -> bool:
    """Whether a decoded value keeps all limits, with ``depth`` containers around it."""
    if isinstance(node, dict):
        if depth >= limits.max_depth or len(node) > limits.max_fields:
            return False
        return all(len(k.encode()) <= limits.max_key_bytes and _within(v, depth + 1, limits) for k, v in node.items())
    if isinstance(node, list):
        return depth < limits.max_depth and len(node) <= limits.max_elements and all(_within(v, depth + 1, limits) for v in node)
    if isinstance(node, str) and not isinstance(node, Number):
        return len(node) * 4 <= limits.max_string_bytes or len(node.encode()) <= limits.max_string_bytes
    return True


def parse(data: bytes, limits: Limits = Limits()) -> object:
    """The value of a document, or ``Rejected`` with the first reason."""
    if len(data) > limits.max_bytes:
        raise Rejected(SIZE)
    try:
        text = data.decode()
        if "\\u" not in text:
            node = _fast.decode(text)
            if _within(node, 0, limits):
                return node
    except (_Slow, ValueError, RecursionError):
        pass
    return _Scanner(data, limits).document()


_SPACE = re.compile(rb"[ \t\n\r]*")
_NUMBER = re.compile(rb"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
_PLAIN = re.compile(rb'[^"\\\x00-\x1f]*')
_ESCAPES = {0x22: '"', 0x5C: "\\", 0x2F: "/", 0x62: "\b", 0x66: "\f", 0x6E: "\n", 0x72: "\r", 0x74: "\t"}
_WORDS = {b"null": None, b"true": True, b"false": False}


class _Scanner:
    """Reads from the left and stops at the first error."""

    def __init__(self, data: bytes, limits: Limits):
        self.data, self.limits, self.at = data, limits, 0

    def document(self) -> object:
        self._space()
        node = self._value(0, True)
        self._space()
        if self.at != len(self.data):
            raise Rejected(SYNTAX)
        return node

    def _space(self) -> None:
        self.at = _SPACE.match(self.data, self.at).end()

    def _peek(self) -> int:
        return self.data[self.at] if self.at < len(self.data) else -1

    def _take(self, byte: int) -> None:
        if self._peek() != byte:
            raise Rejected(SYNTAX)
        self.at += 1

    def _value(self, depth: int, keep: bool) -> object:
        """``keep`` is false in the tail of an array that is too long: syntax, depth and lengths count there, keys' repetition and number do not."""
        c = self._peek()
        if c in (0x7B, 0x5B):
            if depth + 1 > self.limits.max_depth:
                raise Rejected(DEPTH)
            self.at += 1
            return self._object(depth + 1, keep) if c == 0x7B else self._array(depth + 1, keep)
        if c == 0x22:
            return self._string(self.limits.max_string_bytes, SIZE)
        for word, value in _WORDS.items():
            if self.data.startswith(word, self.at):
                self.at += len(word)
                return value
        m = _NUMBER.match(self.data, self.at)
        if not m:
            raise Rejected(SYNTAX)
        self.at = m.end()
        # What cannot follow a number, such as a digit after 0 or a bare point, is an error here already.
        if self.at < len(self.data) and self.data[self.at] in b"0123456789.eE+-":
            raise Rejected(SYNTAX)
        return Number(m[0].decode())

    def _object(self, depth: int, keep: bool) -> dict:
        out: dict = {}
        self._space()
        if self._peek() == 0x7D:
            self.at += 1
            return out
        while True:
            self._space()
            if self._peek() != 0x22:
                raise Rejected(SYNTAX)
            key = self._string(self.limits.max_key_bytes, KEY_LENGTH)
            if keep and key in out:
                raise Rejected(DUPLICATE)
            self._space()
            self._take(0x3A)
            self._space()
            out[key] = self._value(depth, keep)
            if keep and len(out) > self.limits.max_fields:
                raise Rejected(FIELDS)
            self._space()
            if self._peek() == 0x7D:
                self.at += 1
                return out
            self._take(0x2C)

    def _array(self, depth: int, keep: bool) -> Array:
        out = Array()
        self._space()
        if self._peek() == 0x5D:
            self.at += 1
            return out
        while True:
            self._space()
            room = len(out) < self.limits.max_elements
            node = self._value(depth, keep and room)
            if room:
                out.append(node)
            else:
                out.truncated = True
            self._space()
            if self._peek() == 0x5D:
                self.at += 1
                return out
            self._take(0x2C)

    def _string(self, most: int, reason: str) -> str:
        self._take(0x22)
        parts: list[str] = []
        while True:
            end = _PLAIN.match(self.data, self.at).end()
            try:
                parts.append(self.data[self.at : end].decode())
            except UnicodeDecodeError:
                raise Rejected(UTF8) from None
            self.at = end
            c = self._peek()
            if c == 0x22:
                self.at += 1
                text = "".join(parts)
                if len(text.encode()) > most:
                    raise Rejected(reason)
                return text
            if c != 0x5C:
                raise Rejected(SYNTAX)
            self.at += 1
            e = self._peek()
            self.at += 1
            if e in _ESCAPES:
                parts.append(_ESCAPES[e])
            elif e == 0x75:
                parts.append(self._unicode())
            else:
                raise Rejected(SYNTAX)

    def _hex(self) -> int:
        digits = self.data[self.at : self.at + 4]
        if len(digits) < 4 or any(c not in b"0123456789abcdefABCDEF" for c in digits):
            raise Rejected(SYNTAX)
        self.at += 4
        return int(digits, 16)

    def _unicode(self) -> str:
        high = self._hex()
        if 0xD800 <= high < 0xDC00:
            if self.data[self.at : self.at + 2] != b"\\u":
                raise Rejected(SYNTAX)
            self.at += 2
            low = self._hex()
            if not 0xDC00 <= low < 0xE000:
                raise Rejected(SYNTAX)
            return chr(0x10000 + ((high - 0xD800) << 10) + (low - 0xDC00))
        if 0xDC00 <= high < 0xE000:
            raise Rejected(UTF8)
        return chr(high)
