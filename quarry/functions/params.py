"""Typed request parameters. Unknown parameters are ignored by callers; bad ones raise ParameterError."""

from __future__ import annotations

#: Bounds of a page and of a query text in bytes.
LIMIT_DEFAULT, LIMIT_MAX, SUGGEST_MAX, QUERY_BYTES = 20, 100, 200, 200


class ParameterError(ValueError):
    """A parameter that doesn't have its type or lies out of bounds."""


def limit(value: str | None, most: int = LIMIT_MAX) -> int:
    if value is None or value == "":
        return LIMIT_DEFAULT
    if not (value.isascii() and value.isdigit()) or not 1 <= int(value) <= most:
        raise ParameterError(f"limit must be a number from 1 to {most}")
    return int(value)


def boolean(value: str | None) -> bool | None:
    if value is None or value == "":
        return None
    table = {"true": True, "1": True, "false": False, "0": False}
    if value.strip().lower() not in table:
        raise ParameterError("a boolean must be true, false, 1 or 0")
    return table[value.strip().lower()]


def enum(value: str | None, allowed: dict[str, str]) -> str | None:
    if value is None or value.strip() == "":
        return None
    if value.strip().lower() not in allowed:
        raise ParameterError("must be one of " + ", ".join(sorted(allowed)))
    return allowed[value.strip().lower()]


def query_text(value: str | None) -> str:
    text = (value or "").strip()
    if len(text.encode()) > QUERY_BYTES:
        raise ParameterError(f"a query has at most {QUERY_BYTES} bytes")
    return text


def code(value: str, *lengths: int) -> str:
    if not (value.isascii() and value.isdigit()) or len(value) not in lengths:
        raise ParameterError("a code has " + " or ".join(map(str, lengths)) + " digits")
    return value


def sections(value: str | None, allowed: tuple[str, ...]) -> tuple[str, ...]:
    """Sections named by include=a,b; ``all`` stands for all of them."""
    names = [n.strip() for n in (value or "").split(",") if n.strip()]
    if "all" in names:
        return allowed
    if unknown := [n for n in names if n not in allowed]:
        raise ParameterError("unknown section " + ", ".join(unknown))
    return tuple(n for n in allowed if n in names)
