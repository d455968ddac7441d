"""Cursors of keyset pagination, as short strings.

25 bytes, big-endian: a tag, eight bytes for the key, sixteen for the record's uuid; base64 for URLs without padding.
Tag 0 is a relevance (single precision, behind four zero bytes), 1 the 64 bits of an integer, 2 a double. A signed integer
that is negative is read back as unsigned; ``signed`` turns it back.
"""

from __future__ import annotations

import base64
import binascii
import struct
import uuid
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

RELEVANCE, INTEGER, DOUBLE = 0, 1, 2
_SIZE = 25


class InvalidCursor(ValueError):
    """Not a cursor."""


class UnknownCursor(LookupError):
    """A cursor of a record that isn't stored."""


class CursorMismatch(ValueError):
    """A cursor of another sort."""


def signed(value: int) -> int:
    """The signed integer of the same 64 bits."""
    return value - (1 << 64) if value >= 1 << 63 else value


def integer_cursors(key: Column, uuid_: Column) -> Column:
    """What ``Cursor(INTEGER, key, uuid).encode()`` gives, for whole columns."""
    raw = F.unhex(F.concat(F.lit("01"), F.lpad(F.hex(key.cast("long")), 16, "0"), F.regexp_replace(uuid_, "-", "")))
    return F.rtrim(F.translate(F.base64(raw), "+/", "-_"), F.lit("="))


@dataclass(frozen=True)
class Cursor:
    tag: int
    value: float | int
    uuid: uuid.UUID

    def encode(self) -> str:
        if self.tag == RELEVANCE:
            key = struct.pack(">4xf", self.value)
        elif self.tag == INTEGER:
            if not -(1 << 63) <= self.value < 1 << 64:
                raise InvalidCursor(f"{self.value} doesn't fit 64 bits")
            key = struct.pack(">Q", self.value & 0xFFFFFFFFFFFFFFFF)
        elif self.tag == DOUBLE:
            key = struct.pack(">d", self.value)
        else:
            raise InvalidCursor(f"no tag {self.tag}")
        return base64.urlsafe_b64encode(bytes([self.tag]) + key + self.uuid.bytes).rstrip(b"=").decode("ascii")

    @staticmethod
    def decode(text: str) -> Cursor:
        try:
            plain = text.encode("ascii")
            raw = base64.b64decode(plain + b"=" * (-len(plain) % 4), altchars=b"-_", validate=True)
        except (UnicodeEncodeError, binascii.Error, AttributeError) as e:
            raise InvalidCursor("no base64 text") from e
        if len(raw) != _SIZE:
            raise InvalidCursor(f"{len(raw)} bytes instead of {_SIZE}")
        kind = {RELEVANCE: ">4xf", INTEGER: ">Q", DOUBLE: ">d"}.get(raw[0])
        if kind is None or raw[0] == RELEVANCE and any(raw[1:5]):
            raise InvalidCursor("an unknown kind of key")
        return Cursor(raw[0], struct.unpack_from(kind, raw, 1)[0], uuid.UUID(bytes=raw[9:]))
