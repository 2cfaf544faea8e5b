"""Occurrences of calendar events from ICS texts, in the zones that they state."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator
from zoneinfo import ZoneInfo

import pandas as pd
from dateutil.rrule import rrulestr
from pyspark.sql import DataFrame

OCCURRENCES = "feed long, uid string, summary string, start timestamp, end timestamp, all_day boolean, status string, transparent boolean, problem string"
#: So many occurrences of a feed are given out; that there are more is told.
MOST = 10_000
DURATION = re.compile(r"([+-]?)P(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?$")
Property = tuple[str, dict[str, str]]


def _zone(name: str | None, otherwise: ZoneInfo) -> ZoneInfo:
    try:
        return ZoneInfo(name) if name else otherwise
    except (KeyError, ValueError, OSError):  # a zone that only the feed knows
        return otherwise


def _moment(value: Property, zone: ZoneInfo) -> tuple[dt.datetime, bool]:
    """The wall time with its zone, and whether it is a whole day. A time without a zone is that of ``zone``."""
    text, parameters = value
    if len(text) == 8:
        return dt.datetime.strptime(text, "%Y%m%d").replace(tzinfo=zone), True
    at = dt.datetime.strptime(text.removesuffix("Z"), "%Y%m%dT%H%M%S")
    return at.replace(tzinfo=dt.UTC if text.endswith("Z") else _zone(parameters.get("TZID"), zone)), False


def _length(text: str) -> dt.timedelta:
    found = DURATION.match(text)
    if not found:
        raise ValueError(f"duration {text}")
    weeks, days, hours, minutes, seconds = (int(x or 0) for x in found.groups()[1:])
    return (-1 if found[1] == "-" else 1) * dt.timedelta(weeks=weeks, days=days, hours=hours, minutes=minutes, seconds=seconds)


def _events(text: str) -> Iterator[dict[str, list[Property]]]:
    """Properties of each event with their parameters, folded lines joined. Parts of an event (alarms) aren't its own."""
    event: dict[str, list[Property]] | None = None
    inside = 0
    for line in re.sub(r"\r?\n[ \t]", "", text).splitlines():
        head, _, value = line.partition(":")
        name, *given = head.upper().split(";") if '"' not in head else [head.split(";")[0].upper()]
        parameters = dict(p.split("=", 1) for p in head.split(";")[1:] if "=" in p)
        if name == "BEGIN":
            inside += event is not None
            event = {} if event is None and value.strip().upper() == "VEVENT" else event
        elif name == "END" and event is not None:
            if not inside:
                yield event
                event = None
            inside = max(0, inside - 1)
        elif event is not None and not inside:
            for one in value.split(",") if name in ("EXDATE", "RDATE") else [value]:
                event.setdefault(name, []).append((one.strip(), {k.upper(): v.strip('"') for k, v in parameters.items()}))


def _starts(event: dict[str, list[Property]], first: dt.datetime, until: dt.datetime, zone: ZoneInfo) -> Iterator[dt.datetime]:
    """Starts up to ``until``, by wall time: nine o'clock stays nine o'clock when the clocks change."""
    added = [_moment(r, zone)[0] for r in event.get("RDATE", ())]
    if "RRULE" not in event:
        yield from sorted({first, *added}, key=lambda s: s.astimezone(dt.UTC))
        return
    yield from added

    def local(found: re.Match[str]) -> str:
        end = _moment((found[1], {}), zone)[0] if len(found[1]) > 8 else dt.datetime.strptime(found[1], "%Y%m%d").replace(hour=23, minute=59, tzinfo=first.tzinfo)
        return f"UNTIL={end.astimezone(first.tzinfo):%Y%m%dT%H%M%S}"

    rule = rrulestr(re.sub(r"UNTIL=([0-9TZ]+)", local, event["RRULE"][0][0].upper()), dtstart=first.replace(tzinfo=None))
    for wall in rule:
        start = wall.replace(tzinfo=first.tzinfo)
        if start.astimezone(dt.UTC) >= until:
            return
        yield start


def _occurrences(text: str, low: dt.datetime, high: dt.datetime, zone: ZoneInfo) -> Iterator[tuple]:
    """Rows of a feed (all but its number); what can't be read gives a row that says so, and no more than that is lost."""

    def problem(uid: str | None, what: object) -> tuple:
        return (uid, None, None, None, None, None, None, str(what)[:200])

    if not text.lstrip("﻿ \r\n\t").upper().startswith("BEGIN:VCALENDAR"):
        yield problem(None, "not a calendar")
        return
    events, moved, count = [], set(), 0
    for event in _events(text):
        uid = event.get("UID", [("", {})])[0][0]
        try:
            first, whole = _moment(event["DTSTART"][0], zone)
            if "RECURRENCE-ID" in event:
                moved.add((uid, _moment(event["RECURRENCE-ID"][0], zone)[0].astimezone(dt.UTC)))
            events.append((uid, first, whole, event))
        except (KeyError, ValueError) as wrong:
            yield problem(uid, wrong)
    for uid, first, whole, event in events:
        said = lambda name: event.get(name, [("", {})])[0][0]  # noqa: B023, E731
        try:
            if "DTEND" in event:
                length = _moment(event["DTEND"][0], zone)[0].replace(tzinfo=None) - first.replace(tzinfo=None) if whole else _moment(event["DTEND"][0], zone)[0] - first
            else:
                length = _length(said("DURATION")) if "DURATION" in event else dt.timedelta(days=int(whole))
            out = {_moment(x, zone)[0].astimezone(dt.UTC) for x in event.get("EXDATE", ())}
            for start in _starts(event, first, high, zone):
                at = start.astimezone(dt.UTC)
                end = (start + length).astimezone(dt.UTC) if whole else at + length
                if at >= high or (end <= low and at < low) or at in out or ("RECURRENCE-ID" not in event and (uid, at) in moved):
                    continue
                if count == MOST:
                    yield problem(uid, f"more than {MOST} occurrences")
                    return
                count += 1
                yield (uid, said("SUMMARY"), at, end, whole, said("STATUS").upper(), said("TRANSP").upper() == "TRANSPARENT", None)
        except (ValueError, OverflowError, TypeError) as wrong:
            yield problem(uid, wrong)


def occurrences(feeds: DataFrame, start: str, end: str, text_col: str = "ics", feed_col: str | None = None, zone: str = "UTC") -> DataFrame:
    """Occurrences that touch a window; moved ones stand for those that they replace, excluded ones are left out.

    Rules are those of RFC 5545, in the zone of the event's start; ``zone`` is that of times without one, and of whole
    days. An event that can't be read, a feed that is none, and the rest of a feed of over 10,000 occurrences give a
    row with a problem and no start. A null text gives no rows. ``feed_col`` (a long) tells feeds apart.
    """
    viewer = ZoneInfo(zone)
    low, high = (dt.datetime.fromisoformat(t).replace(tzinfo=dt.UTC) for t in (start, end))

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in OCCURRENCES.split(", ")]
        for batch in batches:
            feeds = batch[feed_col] if feed_col else pd.Series([None] * len(batch), index=batch.index)
            rows = [(feed, *row) for feed, text in zip(feeds, batch[text_col], strict=True) if isinstance(text, str) for row in _occurrences(text, low, high, viewer)]
            told = pd.DataFrame(rows, columns=names)
            yield told.astype({"feed": "Int64", "all_day": "boolean", "transparent": "boolean", "start": "datetime64[us, UTC]", "end": "datetime64[us, UTC]"})

    return feeds.select(*([feed_col] if feed_col else []), text_col).mapInPandas(expand, OCCURRENCES)
