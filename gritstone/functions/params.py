"""What a query asks for: windows, limits, statuses, family keys and cursors, checked before any plan is made."""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from datetime import datetime, timedelta

from ..schema import STATUSES

DEFAULT_LIMIT, MOST_LIMIT = 50, 200
#: Units of a duration, in microseconds.
UNITS = {"us": 1, "ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000}


class QueryError(ValueError):
    """code: bad_request or over_limit."""

    def __init__(self, code: str, detail: str):
        super().__init__(detail)
        self.code, self.detail = code, detail


def duration(text: str) -> timedelta:
    """Parts of a number and a unit like 1h30m or 250ms; or whole days, 7d."""
    if re.fullmatch(r"[+-]?\d+d", text):
        return timedelta(days=int(text[:-1]))
    parts = re.findall(r"(\d+(?:\.\d*)?|\.\d+)(us|ms|s|m|h)", text)
    if not parts or "".join(a + b for a, b in parts) != text.lstrip("+-") or len(text) - len(text.lstrip("+-")) > 1:
        raise QueryError("bad_request", f"invalid duration {text}")
    total = timedelta(microseconds=sum(float(a) * UNITS[b] for a, b in parts))
    return -total if text.startswith("-") else total


def instant(text: str) -> datetime:
    """RFC 3339; of the fraction, what lies beyond microseconds is cut off. In UTC, without a zone."""
    m = re.fullmatch(r"(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d)(\.\d+)?(Z|[+-]\d\d:\d\d)", text)
    if not m:
        raise QueryError("bad_request", f"invalid time {text}")
    zone = "+00:00" if m[3] == "Z" else m[3]
    try:
        at = datetime.fromisoformat(m[1] + zone)
    except ValueError as bad:
        raise QueryError("bad_request", f"invalid time {text}") from bad
    return (at - at.utcoffset()).replace(tzinfo=None) + timedelta(microseconds=int(((m[2] or ".0")[1:] + "000000")[:6]))


@dataclass(frozen=True)
class Params:
    since: datetime
    until: datetime
    limit: int = DEFAULT_LIMIT
    statuses: tuple[str, ...] = ()
    suppressed: bool = False

    @classmethod
    def parse(
        cls, query: Mapping[str, str], now: datetime, usual: timedelta = timedelta(hours=1), most: timedelta | None = None, extra: Iterable[str] = ()
    ) -> Params:
        """since, until, window, limit, status and include_suppressed, and what `extra` names; a name that is none of these is an error."""
        if unknown := sorted(set(query) - {"since", "until", "window", "limit", "status", "include_suppressed", *extra}):
            raise QueryError("bad_request", f"unknown query parameter: {unknown[0]}")
        most = most or usual
        since, until = window(query.get("since", ""), query.get("until", ""), query.get("window", ""), now, usual, most)
        statuses = tuple(s.strip() for s in query["status"].split(",")) if query.get("status") else ()
        if set(statuses) - set(STATUSES):
            raise QueryError("bad_request", "invalid status")
        flag = query.get("include_suppressed", "") or "false"
        if flag.lower() not in ("1", "t", "true", "0", "f", "false"):
            raise QueryError("bad_request", "invalid include_suppressed")
        return cls(since, until, limit(query.get("limit", "")), statuses, flag.lower() in ("1", "t", "true"))


def limit(text: str) -> int:
    if not text:
        return DEFAULT_LIMIT
    if not re.fullmatch(r"[+-]?\d+", text) or int(text) <= 0:
        raise QueryError("bad_request", "invalid limit")
    if int(text) > MOST_LIMIT:
        raise QueryError("over_limit", f"limit must be <= {MOST_LIMIT}")
    return int(text)


def window(since: str, until: str, length: str, now: datetime, usual: timedelta, most: timedelta) -> tuple[datetime, datetime]:
    """Explicit ends, or a length up to now. An end alone starts the longest window before it; a start older than the longest window is refused."""
    if since or until:
        end = instant(until) if until else now
        start = instant(since) if since else end - most
        if since and start < now - most:
            raise QueryError("over_limit", "since is older than the hot window")
        if start > end:
            raise QueryError("bad_request", "since must be <= until")
        return start, end
    span = duration(length) if length else usual
    if span <= timedelta(0):
        raise QueryError("bad_request", "invalid window")
    if span > most:
        raise QueryError("over_limit", "window exceeds hot window")
    return now - span, now


def format_family(service: str, step: str, code: str) -> str:
    return ":".join(p.replace(":", "\\:") for p in (service, step, code))


def parse_family(text: str) -> tuple[str, str, str]:
    """Three parts, none empty, with \\: and \\\\ for a colon and a backslash within them."""
    parts, rest = [""], iter(text)
    for c in rest:
        if c == "\\":
            c = next(rest, "")
            if c not in (":", "\\"):
                raise QueryError("bad_request", "invalid error family")
            parts[-1] += c
        elif c == ":":
            parts.append("")
        else:
            parts[-1] += c
    if len(parts) != 3 or not all(parts):
        raise QueryError("bad_request", "invalid error family")
    return parts[0], parts[1], parts[2]


def blast_key(query: Mapping[str, str]) -> tuple[str | None, str | None, str]:
    """(service, step, code): from a family, from all three names, or from a bare code for every family of it."""
    if query.get("error_family"):
        return parse_family(query["error_family"])
    names = [query.get(n) or None for n in ("service", "step", "error_code")]
    if not names[2] or (names[0] is None) != (names[1] is None):
        raise QueryError("bad_request", "service and step go together with error_code")
    return names[0], names[1], names[2]


def cursor(values: Mapping[str, object]) -> str:
    return base64.urlsafe_b64encode(json.dumps(values, default=str, separators=(",", ":")).encode()).rstrip(b"=").decode()


def parse_cursor(text: str, names: Iterable[str]) -> dict:
    """The values of a cursor with exactly those names, none of them blank."""
    try:
        got = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
    except ValueError as bad:
        raise QueryError("bad_request", "invalid cursor") from bad
    if not isinstance(got, dict) or set(got) != set(names) or any(v in (None, "") for v in got.values()):
        raise QueryError("bad_request", "invalid cursor")
    return got


def traceparent(text: str) -> tuple[str, str, bool] | None:
    """(trace, span, sampled) of a W3C header, or None."""
    m = re.fullmatch(r"00-([0-9a-f]{32})-([0-9a-f]{16})-([0-9a-f]{2})", text)
    return (m[1], m[2], bool(int(m[3], 16) & 1)) if m and set(m[1]) != {"0"} and set(m[2]) != {"0"} else None


def format_traceparent(trace: str, span: str, sampled: bool = True) -> str:
    return f"00-{trace}-{span}-{int(sampled):02x}"
