"""Dates in free text: publication dates, deadlines and event ranges.

Loose dates of feeds are parsed by built-in functions. Deadlines and ranges of free text are read by a small
grammar: a text becomes tokens (numbers, months, marks), `_point` reads one date from some place on, with
whatever of day, month and year stands there, and a range is two points with a joining word or dash between
them, each completed from the other. It runs in Arrow-batched helpers, behind a built-in test that few pages
pass. Decisions: a number is a whole run of digits; month names are whole words; a day that a month doesn't have
is no date; a range over new year starts in the year before.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import UTC, date, datetime, time, timedelta
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names, English and German.
MONTHS = {
    "jan": 1, "january": 1, "januar": 1,
    "feb": 2, "february": 2, "februar": 2,
    "mar": 3, "march": 3, "märz": 3, "maerz": 3,
    "apr": 4, "april": 4,
    "may": 5, "mai": 5,
    "jun": 6, "june": 6, "juni": 6,
    "jul": 7, "july": 7, "juli": 7,
    "aug": 8, "august": 8,
    "sep": 9, "sept": 9, "september": 9,
    "oct": 10, "october": 10, "oktober": 10, "okt": 10,
    "nov": 11, "november": 11,
    "dec": 12, "december": 12, "dezember": 12, "dez": 12,
}
# What stands before a closing date.
DEADLINE_WORDS = (
    r"deadline|closing date|closes|apply by|apply until|application (?:period|window|due)|applications? (?:close|are open until)|"
    r"submit(?:ted)? by|until|bewerbungsfrist|bewerbungsschluss|frist|bewerben bis|bis zum"
)
REACH = 90

# Ordinal endings, and what joins the two ends of a range.
ORDINALS = ("st", "nd", "rd", "th")
JOINS = ("-", "–", "—", "to", "until", "bis")

_KEY = re.compile(DEADLINE_WORDS, re.IGNORECASE)
_PLAIN_KEY = re.compile(DEADLINE_WORDS)
_TOKENS = re.compile(r"(\s*)(\d+|[^\W\d_]+|[^\w\s]|_)")


class Point(NamedTuple):
    """What is written of one date, the form it is written in, and the token behind it."""

    day: int
    month: int | None
    year: int | None
    form: int
    end: int


#: Forms of a date, in the order in which `dates_in` lists them.
DOTTED, ISO, DAY_FIRST, MONTH_FIRST, BARE = range(5)
#: In which forms a range may end, by the form in which it begins.
FOLLOWS = {BARE: (DAY_FIRST, DOTTED), DAY_FIRST: (DAY_FIRST,), MONTH_FIRST: (BARE, MONTH_FIRST), DOTTED: (), ISO: ()}


class _Reader:
    """The grammar over the tokens of one text: numbers, words, marks. Each rule takes the place where it begins; only
    numbers and months begin a date, so these places alone are tried (`starts`)."""

    def __init__(self, text: str):
        found = _TOKENS.findall(text)
        self.texts = [t.lower() for _, t in found]
        self.spaced = [bool(space) for space, _ in found]  # white space before it
        # a letter, digit or underscore right before it
        self.after_word = [bool(i) and not space and (found[i - 1][1][-1].isalnum() or found[i - 1][1] == "_") for i, (space, _) in enumerate(found)]
        self.starts = [i for i, t in enumerate(self.texts) if t in MONTHS or t.isdecimal()]

    def has(self, i: int, *texts: str) -> bool:
        return i < len(self.texts) and self.texts[i] in texts

    def close(self, i: int, *texts: str) -> bool:
        """One of the texts without white space before it."""
        return self.has(i, *texts) and not self.spaced[i]

    def glued(self, i: int) -> bool:
        return i < len(self.texts) and self.after_word[i] and (self.texts[i][0].isalnum() or self.texts[i] == "_")

    def apart(self, i: int) -> bool:
        return i < len(self.texts) and self.spaced[i]

    def number(self, i: int, least: int, most: int) -> int | None:
        """A number of so many digits."""
        if i < len(self.texts) and least <= len(self.texts[i]) <= most and self.texts[i].isdecimal():
            return int(self.texts[i])
        return None

    def year(self, i: int) -> tuple[int | None, int]:
        """A year of this century, perhaps behind a comma; nothing is taken where there is none."""
        at = i + self.has(i, ",")
        y = self.number(at, 4, 4)
        return (y, at + 1) if y is not None and 2000 <= y < 2100 else (None, i)

    def day(self, i: int) -> tuple[int | None, int]:
        """A day with or without an ordinal ending."""
        d = self.number(i, 1, 2)
        if d is None:
            return None, i
        return d, i + 1 + self.close(i + 1, *ORDINALS)

    def month(self, i: int) -> tuple[int | None, int]:
        m = MONTHS.get(self.texts[i]) if i < len(self.texts) else None
        return (None, i) if m is None else (m, i + 1 + self.close(i + 1, "."))

    def digits(self, i: int, mark: str, widths: tuple[int, int, int], spaces: bool) -> tuple[list[int], int] | None:
        """Three numbers of at most these widths with a mark between them."""
        if not (self.has(i + 1, mark) and self.has(i + 3, mark)):
            return None
        found = [self.number(i + 2 * k, w if w > 2 or mark == "-" else 1, w) for k, w in enumerate(widths)]
        if None in found:
            return None
        if not spaces and any(self.spaced[i + 1 : i + 5]) or self.glued(i + 5):
            return None
        return found, i + 5

    def point(self, i: int, inner: bool = False) -> Point | None:
        """The date that begins at token i. An inner one is an end of a range: it may be a bare day, and spaces may
        stand in its dotted form."""
        if i >= len(self.texts) or self.after_word[i] and not inner:
            return None
        if got := self.digits(i, ".", (2, 2, 4), inner):
            (d, m, y), end = got
            return Point(d, m, y, DOTTED, end)
        if not inner and (got := self.digits(i, "-", (4, 2, 2), False)):
            (y, m, d), end = got
            return Point(d, m, y, ISO, end) if 2000 <= y < 2100 else None
        m, at = self.month(i)
        if m is not None:
            d, at = self.day(at) if self.apart(at) else (None, at)
            y, at = self.year(at)
            return None if d is None else Point(d, m, y, MONTH_FIRST, at)
        d, at = self.day(i)
        if d is None:
            return None
        at += self.close(at, ".")
        of = self.apart(at) and self.has(at, "of")
        m, end = self.month(at + of)
        if m is not None and self.apart(at + of):
            y, end = self.year(end)
            return Point(d, m, y, DAY_FIRST, end)
        y, end = self.year(at)
        return Point(d, None, y, BARE, end) if inner else None

    def spans(self) -> Iterator[tuple[Point, Point]]:
        """Every first and last point that the text allows; a single date is both."""
        for i in self.starts:
            first = None if self.after_word[i] else self.point(i, inner=True)
            if first is None:
                continue
            if first.form != BARE:
                yield first, first
            if self.has(first.end, *JOINS) and (last := self.point(first.end + 1, inner=True)) and last.form in FOLLOWS[first.form]:
                yield first, last


def _day(y: int, m: int, d: int) -> date | None:
    try:
        return date(y, m, d)
    except ValueError:
        return None


def _end_of(d: date) -> datetime:
    return datetime.combine(d, time(23, 59, 59), UTC)


def dates_in(snippet: str, now: datetime) -> list[datetime]:
    """All dates of a snippet by form, then place, each at the end of its day. One without a year is the next to come."""
    reader = _Reader(snippet)
    points = [p for i in reader.starts if (p := reader.point(i))]
    out = []
    for p in sorted(points, key=lambda p: p.form):
        days = [_day(y, p.month, p.day) for y in ([p.year] if p.year else [now.year, now.year + 1])]
        out += [_end_of(d) for d in days if d and (p.year or _end_of(d) >= now)][:1]
    return out


def _moment(value: object) -> datetime | None:
    """An ISO time; one without a zone is UTC."""
    try:
        at = datetime.fromisoformat(str(value).strip().replace("Z", "+00:00"))
    except ValueError:
        return None
    return at.replace(tzinfo=at.tzinfo or UTC)


_LD_BLOCK = re.compile(r"<script[^>]+ld\+json[^>]*>(.*?)</script>", re.IGNORECASE | re.DOTALL)
_HIDDEN = re.compile(r"<(script|style|nav|footer|header)\b.*?</\1>|<[^>]+>|&nbsp;|&#160;", re.IGNORECASE | re.DOTALL)


def _stated(html: str) -> Iterator[datetime]:
    """Closing dates in the structured data of a page, in document order: an object before what it holds."""
    if html.isascii() and "ld+json" not in html.lower():
        return
    for block in _LD_BLOCK.findall(html):
        try:
            waiting = [json.loads(block)]
        except (ValueError, RecursionError):
            continue
        while waiting:
            node = waiting.pop()
            if isinstance(node, dict):
                at = _moment(node.get("validThrough") or node.get("applicationDeadline") or "")
                if at:
                    yield at
                node = list(node.values())
            if isinstance(node, list):
                waiting += reversed(node)


def _written(html: str, now: datetime) -> Iterator[datetime]:
    """Dates of the visible text close behind a keyword."""
    text = " ".join(_HIDDEN.sub(" ", html).split())
    plain = text.isascii()  # then no letter has another spelling than its lower case
    for key in (_PLAIN_KEY.finditer(text.lower()) if plain else _KEY.finditer(text)):
        yield from dates_in(text[key.start() : key.start() + REACH], now)


def find_deadline(html: str | None, now: datetime) -> datetime | None:
    """Closing date of a page: as stated in its structured data; else among the dates close behind a keyword
    the nearest to come, else the latest."""
    if not html:
        return None
    stated = next(_stated(html), None)
    if stated:
        return stated
    written = sorted(_written(html, now))
    return next((d for d in written if d >= now), written[-1] if written else None)


def event_range(text: str | None, now: datetime) -> tuple[datetime, datetime] | None:
    """Earliest date range with a year that ended at most a day ago: start of its first and end of its last day."""
    best = None
    for a, b in _Reader(text or "").spans():
        y, m = b.year or a.year, b.month or a.month
        if not (y and m):
            continue
        first, last = _day(y, a.month or m, a.day), _day(y, m, b.day)
        if first and last and first > last:
            first = _day(y - 1, a.month or m, a.day)
        if first and last and _end_of(last) + timedelta(days=1) >= now and (best is None or first < best[0]):
            best = first, last
    return best and (datetime.combine(best[0], time(), UTC), _end_of(best[1]))


# ------------------------------------------------------------------ on columns


def _naive(at: datetime | None) -> datetime | None:
    return at.astimezone(UTC).replace(tzinfo=None) if at else None


def _series(values: list) -> pd.Series:
    return pd.to_datetime(pd.Series(values, dtype=object))


def deadline_column(html: Column, now: datetime) -> Column:
    """`find_deadline` on a column; only pages with a keyword or structured data reach the helper.

    To Spark it is not deterministic, here and in the range below, so that a filter on the result stays where it is
    written: pushed below a join it would read every page, and the pages that pass once more."""

    @F.pandas_udf("timestamp")
    def helper(pages: pd.Series) -> pd.Series:
        return _series([_naive(find_deadline(p, now)) for p in pages])

    return helper.asNondeterministic()(F.when(html.rlike(f"(?i)ld\\+json|{DEADLINE_WORDS}"), html))


def first_date_column(text: Column, now: datetime) -> Column:
    """The first date of a snippet in pattern order."""

    @F.pandas_udf("timestamp")
    def helper(texts: pd.Series) -> pd.Series:
        return _series([_naive(next(iter(dates_in(t or "", now)), None)) for t in texts])

    return helper(F.when(text.rlike("[0-9]"), text))


def event_range_column(text: Column, now: datetime) -> Column:
    """struct(start, end) of `event_range`, or null."""

    @F.pandas_udf("struct<start:timestamp,end:timestamp>")
    def helper(texts: pd.Series) -> pd.DataFrame:
        found = [event_range(t, now) or (None, None) for t in texts]
        return pd.DataFrame({"start": _series([_naive(a) for a, _ in found]), "end": _series([_naive(b) for _, b in found])})

    got = F.array(helper.asNondeterministic()(F.when(text.rlike("20[0-9][0-9]"), text)))
    return F.get(F.filter(got, lambda r: r["start"].isNotNull()), F.lit(0))  # the helper is named once, so it runs once


_FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX", "yyyy-MM-dd'T'HH:mm:ss[.SSS]", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd",
    "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss xx", "d MMM yyyy HH:mm z", "d MMM yyyy HH:mm xx", "d MMM yyyy HH:mm:ss", "d MMM yyyy", "d MMMM yyyy", "MMMM d, yyyy", "MMM d, yyyy", "yyyy/MM/dd", "MM/dd/yyyy",
)


def parse_date(text: Column) -> Column:
    """Timestamp of a loose date (RFC 822, ISO, date only), or null. The session's zone should be UTC. The way a
    value begins decides which formats are tried."""
    bare = F.trim(F.regexp_replace(text, r"^\s*[A-Za-z]{3,9}\.?,?\s+(?=\d)", ""))
    begins = ((r"^\d{4}-", _FORMATS[:4]), (r"^\d{1,2}\s", _FORMATS[4:11]), ("^[A-Za-z]", _FORMATS[11:13]))
    out = F.coalesce(*[F.try_to_timestamp(bare, F.lit(f)) for f in _FORMATS[13:]])
    for pattern, formats in begins:
        out = F.when(bare.rlike(pattern), F.coalesce(*[F.try_to_timestamp(bare, F.lit(f)) for f in formats])).otherwise(out)
    return out


def parse_date_range(text: Column) -> Column:
    """struct(start, end) of "28 Jun - 3 Jul 2027", "11-15 Jan 2027" or "4 May 2027", or null. One pattern takes all
    three; what the first day lacks is that of the last."""
    pattern = r"(?:(\d{1,2})(?:\s+([A-Za-z]{3})\w*)?\s*[-–]\s*)?(\d{1,2})\s+([A-Za-z]{3})\w*\s+(\d{4})"
    parts = F.split(F.regexp_replace(F.regexp_substr(text, F.lit(pattern)), pattern, "$1/$2/$3/$4/$5"), "/")
    months = F.create_map(*[F.lit(x) for k, i in {name[:3]: i for name, i in MONTHS.items()}.items() for x in (k, i)])
    part = lambda i: F.nullif(F.get(parts, F.lit(i)), F.lit(""))
    month = lambda name: F.try_element_at(months, F.lower(name))

    def at(year: Column, month_: Column, day: Column) -> Column:
        return F.try_to_timestamp(F.when(month_.isNotNull(), F.format_string("%04d-%02d-%02d", year, month_, day.try_cast("int"))), F.lit("yyyy-MM-dd"))

    y, m2, d2 = part(4).try_cast("int"), month(part(3)), part(2)
    m1, d1 = F.when(part(1).isNull(), m2).otherwise(month(part(1))), F.coalesce(part(0), d2)
    start, end = at(y, m1, d1), at(y, m2, d2)
    start = F.when(start > end, at(y - 1, m1, d1)).otherwise(start)
    return F.when(start.isNotNull() & end.isNotNull(), F.struct(start.alias("start"), end.alias("end")))
