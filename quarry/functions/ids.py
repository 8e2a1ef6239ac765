"""Identifiers that sort by time: milliseconds first, then random bits, in base 32 without look-alikes."""

from __future__ import annotations

import secrets
import time
from datetime import UTC, datetime

#: Fixed value: digits of the base.
DIGITS = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def _encoded(value: int, length: int) -> str:
    return "".join(DIGITS[value >> 5 * k & 31] for k in reversed(range(length)))


def request_id(milliseconds: int | None = None) -> str:
    """26 digits: 48 bits of time and 80 random ones."""
    now = time.time_ns() // 1_000_000 if milliseconds is None else milliseconds
    return _encoded(now << 80 | secrets.randbits(80), 26)


def sync_id(milliseconds: int | None = None) -> str:
    """A prefix and 16 digits: 48 bits of time and 32 random ones."""
    now = time.time_ns() // 1_000_000 if milliseconds is None else milliseconds
    return "sync_" + _encoded(now << 32 | secrets.randbits(32), 16)


def made_at(identifier: str) -> datetime:
    """The time of an identifier."""
    value, digits = 0, identifier.removeprefix("sync_")
    for c in digits:
        value = value << 5 | DIGITS.index(c)
    return datetime.fromtimestamp((value >> (80 if len(digits) == 26 else 32)) / 1000, UTC)
