"""Typed settings from environment variables; all that is wrong is reported at once."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from datetime import timedelta
from typing import Any
from urllib.parse import urlsplit

from quarry.operators import cron

#: Shortest key, log levels, units of durations in seconds.
KEY_LENGTH = 32
LEVELS = {"debug": "DEBUG", "info": "INFO", "warn": "WARN", "warning": "WARN", "error": "ERROR"}
UNITS = {"h": 3600.0, "m": 60.0, "s": 1.0, "ms": 0.001}
#: Fixed values too: defaults of all settings but the keys, which have none.
DEFAULTS = {"ADDR": ":8080", "DATA_DIR": "/data", "SYNC_CRON": "0 4 * * *", "SYNC_JITTER": "30m", "SYNC_ON_START": "true", "RATE_LIMIT": "100", "RATE_BURST": "200", "MAX_REJECT_RATIO": "0.01", "SNAPSHOT_KEEP": "3", "LOG_LEVEL": "info"}


class ConfigError(ValueError):
    """Settings that can't be used; ``problems`` names them all, without any key's text."""

    def __init__(self, problems: list[str]):
        super().__init__("; ".join(problems))
        self.problems = problems


@dataclass(frozen=True)
class Config:
    addr: str
    data_dir: str
    api_keys: tuple[str, ...] = field(repr=False)
    admin_key: str = field(repr=False)
    sync_cron: cron.Schedule | None
    sync_jitter: timedelta
    sync_on_start: bool
    rate_limit: int
    rate_burst: int
    cors_origins: tuple[str, ...]
    max_reject_ratio: float
    snapshot_keep: int
    log_level: str


def duration(text: str) -> timedelta:
    """A duration such as 30m or 1h30m."""
    parts = re.findall(r"([0-9]+(?:\.[0-9]+)?)(ms|h|m|s)", text)
    if not parts or "".join(n + u for n, u in parts) != text:
        if text == "0":
            return timedelta()
        raise ValueError("not a duration of 0 or more, such as 30m")
    return timedelta(seconds=sum(float(n) * UNITS[u] for n, u in parts))


def _address(text: str) -> str:
    host, colon, port = text.rpartition(":")
    if not colon or not port.isdigit() or int(port) > 65535 or ":" in host and not host.startswith("["):
        raise ValueError("not host:port with a port up to 65535")
    return text


def _keys(text: str) -> tuple[str, ...]:
    if not text:
        raise ValueError("needed, at least one key")
    wrong, found = [], {}
    for n, key in enumerate((k.strip() for k in text.split(",")), 1):
        if not key:
            wrong.append(f"key {n} is empty")
        elif len(key) < KEY_LENGTH:
            wrong.append(f"key {n} has fewer than {KEY_LENGTH} characters")
        elif key in found:
            wrong.append(f"key {n} repeats key {found[key]}")
        else:
            found[key] = n
    if wrong:
        raise ValueError(", ".join(wrong))
    return tuple(found)


def _origins(text: str) -> tuple[str, ...]:
    out = []
    for n, origin in enumerate((o.strip() for o in text.split(",")), 1) if text else ():
        try:
            url = urlsplit(origin)
            good = url.scheme in ("http", "https") and url.netloc and not (url.path or url.query or url.fragment)
        except ValueError:
            good = False
        if not good:
            raise ValueError(f"origin {n} is not a plain http or https origin")
        out.append(origin)
    return tuple(out)


def _one_of(table: Mapping[str, Any]) -> Callable[[str], Any]:
    def read(text: str) -> Any:
        if text.lower() not in table:
            raise ValueError("not one of " + ", ".join(table))
        return table[text.lower()]

    return read


def _number(kind: type, low: float, high: float = float("inf")) -> Callable[[str], Any]:
    def read(text: str) -> Any:
        try:
            value = kind(text)
        except ValueError as e:
            raise ValueError("not a number") from e
        if not low <= value <= high:
            raise ValueError(f"not a number from {low} to {high}")
        return value

    return read


def load(env: Mapping[str, str], prefix: str = "QUARRY_", serving: bool = True) -> Config:
    """Settings of variables with this prefix; blank ones count as absent, but for the schedule, where blank means never.

    Without ``serving``, as for loads alone, no key is needed.
    """
    wrong: list[str] = []

    def read(name: str, parse: Callable[[str], Any]) -> Any:
        text = env.get(prefix + name, "").strip() or DEFAULTS.get(name, "")
        if name == "SYNC_CRON" and prefix + name in env:
            text = env[prefix + name]
        try:
            return parse(text)
        except ValueError as e:
            wrong.append(f"{prefix}{name}: {e}")
            return None

    flags = _one_of({"true": True, "1": True, "t": True, "false": False, "0": False, "f": False})
    keys = read("API_KEYS", _keys) if serving or env.get(prefix + "API_KEYS", "").strip() else ()
    admin = env.get(prefix + "ADMIN_KEY", "").strip()
    if admin and len(admin) < KEY_LENGTH:
        wrong.append(f"{prefix}ADMIN_KEY: fewer than {KEY_LENGTH} characters")
    if admin and admin in (keys or ()):
        wrong.append(f"{prefix}ADMIN_KEY: must differ from the other keys")
    limit, burst = read("RATE_LIMIT", _number(int, 1)), read("RATE_BURST", _number(int, 1))
    if limit and burst and burst < limit:
        wrong.append(f"{prefix}RATE_BURST: below the rate limit")
    found = Config(
        read("ADDR", _address), read("DATA_DIR", str), keys, admin, read("SYNC_CRON", cron.parse), read("SYNC_JITTER", duration), read("SYNC_ON_START", flags), limit, burst,
        read("CORS_ORIGINS", _origins), read("MAX_REJECT_RATIO", _number(float, 0, 1)), read("SNAPSHOT_KEEP", _number(int, 1)), read("LOG_LEVEL", _one_of(LEVELS)),
    )
    if wrong:
        raise ConfigError(wrong)
    return found
