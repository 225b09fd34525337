"""Cutoffs of point-in-time replay, checked before a plan is built."""

from __future__ import annotations

import datetime as dt
import re


def parse_cutoff(text: str) -> tuple[dt.datetime, bool]:
    """The cutoff in UTC and whether it lies within a day.

    A date is the end of that day in UTC. A timestamp must name its offset, as a
    cutoff without one could mean two instants; anything else is an error.
    """
    text = text.strip()
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        day = dt.date.fromisoformat(text)
        return dt.datetime.combine(day, dt.time(23, 59, 59, 999_999), dt.UTC), False
    try:
        at = dt.datetime.fromisoformat(text)
    except ValueError as e:
        raise ValueError(f"not a date or timestamp: {text!r}") from e
    if at.tzinfo is None:
        raise ValueError(f"a cutoff within a day needs an offset: {text!r}")
    return at.astimezone(dt.UTC), True


def tighter(outer: str | None, inner: str | None) -> str | None:
    """The earlier of two nested cutoffs; a replay never sees more than its caller."""
    given = [c for c in (outer, inner) if c]
    return min(given, key=lambda c: parse_cutoff(c)[0]) if given else None
