"""Published dates: raw strings to ISO timestamps in UTC, in the kernel and as columns."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta
from email.utils import parsedate_to_datetime
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens of rule formats, longest first, and their strptime forms; text in [brackets] stays.
FORMAT_TOKENS = {
    "YYYY": "%Y",
    "MMMM": "%B",
    "dddd": "%A",
    "HHmm": "%H%M",
    "YY": "%y",
    "MMM": "%b",
    "ddd": "%a",
    "HH": "%H",
    "hh": "%I",
    "mm": "%M",
    "ss": "%S",
    "DD": "%d",
    "MM": "%m",
    "ZZ": "%z",
    "SSS": "%f",
    "M": "%m",
    "D": "%d",
    "H": "%H",
    "h": "%I",
    "m": "%M",
    "s": "%S",
    "A": "%p",
    "a": "%p",
    "Z": "%z",
    "z": "",
}
# Formats tried in order when a rule gives none.
PLAIN_FORMATS = [
    "%Y-%m-%dT%H:%M:%S",
    "%Y-%m-%dT%H:%M",
    "%Y-%m-%d %H:%M:%S",
    "%Y-%m-%d %H:%M",
    "%Y-%m-%d",
    "%Y/%m/%d",
    "%Y %m %d",
    "%B %d, %Y",
    "%b %d, %Y",
    "%b %d, %Y %H:%M",
]
UTC_ONLY_FORMATS = ["%Y-%m-%dT%H:%M:%S.%f", "%B %d, %Y %I:%M %p", "%a, %d %b %Y %H:%M:%S"]
#: Free forms, tried last; ours to choose.
FREE_FORMATS = [
    "%B %d %Y", "%b %d %Y", "%d %B %Y", "%d %b %Y", "%d %B %Y %H:%M", "%d %b %Y %H:%M", "%d %B %Y %H:%M:%S", "%d %b %Y %H:%M:%S",
    "%B %d, %Y %H:%M", "%B %d, %Y %H:%M:%S", "%b %d, %Y %I:%M %p", "%B %d, %Y, %I:%M %p", "%b %d, %Y, %I:%M %p",
    "%B %d, %Y at %I:%M %p", "%b %d, %Y %H:%M:%S", "%b %d %Y %H:%M", "%b %d %Y %I:%M %p", "%m/%d/%Y", "%m/%d/%Y %H:%M", "%m/%d/%Y %I:%M %p",
    "%m/%d/%y", "%m-%d-%Y", "%d.%m.%Y", "%Y.%m.%d", "%Y/%m/%d %H:%M", "%Y/%m/%d %H:%M:%S", "%Y%m%d", "%a %b %d %H:%M:%S %Y", "%Y %b %d", "%Y %B %d",
    "%Y年%m月%d日", "%Y年%m月%d日 %H:%M", "%Y年%m月%d日%H時%M分",
]
# Patterns of relative times, offsets and the pieces of a date.
_AGO = re.compile(r"(?i)(\d+)\s+(seconds?|minutes?|hours?|days?|weeks?|months?|years?)\s+ago")
_NOW = re.compile(r"^\s*(just|right)?\s*now\s*")
_OFFSET = re.compile(r"-\d{3,4}\Z")
_PIECES = re.compile(
    r"(?i)([0-9]{1,2}:[0-9]{2,2}( ?[ap]\.?m\.?)?)|([0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4})|(-[0-9]{3,4}\Z)|([0-9]{1,4})"
    r"|(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
)
_MERIDIAN = re.compile(r"(.*\d)(am|pm)(.*)")


def rule_format(moment: str) -> str:
    """A rule's format as a strptime one."""
    token = "|".join(FORMAT_TOKENS)
    return re.sub(
        rf"\[([^\]]*)\]|({token})|(%)",
        lambda m: m[1].replace("%", "%%") if m[1] is not None else FORMAT_TOKENS[m[2]] if m[2] else "%%",
        moment,
    )


def _parse(text: str, pattern: str) -> datetime | None:
    try:
        return datetime.strptime(text, pattern)
    except ValueError:
        return None


def _in_zone(local: datetime, zone: ZoneInfo) -> datetime | None:
    """The instant of a local time; None where clocks show it twice or never."""
    early, late = (local.replace(tzinfo=zone, fold=k) for k in (0, 1))
    if early.utcoffset() != late.utcoffset():
        return None
    return _in_utc(early)


def _in_utc(moment: datetime) -> datetime | None:
    """The moment in UTC, which a moment without an offset is in; None beyond the years 1 to 9999."""
    try:
        return moment.astimezone(UTC) if moment.tzinfo else moment.replace(tzinfo=UTC)
    except OverflowError:
        return None


def _free(text: str) -> datetime | None:
    """Texts with an offset, and free forms in UTC; dates alone are midnight."""
    try:
        return _in_utc(datetime.fromisoformat(text.strip()))
    except ValueError:
        pass
    compact = " ".join(text.split())
    for pattern in ("%Y-%m-%d %H:%M:%S %z", "%Y-%m-%d %H:%M %z", "%Y-%m-%dT%H:%M:%S%z", "%Y-%m-%dT%H:%M%z", "%Y-%m-%d%z", "%a %b %d %H:%M:%S %z %Y"):
        if found := _parse(compact, pattern):
            return _in_utc(found)
    for pattern in FREE_FORMATS:
        if found := _parse(compact, pattern):
            return found.replace(tzinfo=UTC)
    try:
        return _in_utc(parsedate_to_datetime(compact))
    except (ValueError, TypeError, IndexError, OverflowError):
        return None


def _back(now: datetime, n: int, unit: str) -> datetime:
    if unit.startswith(("month", "year")):
        months = now.year * 12 + now.month - 1 - n * (12 if unit.startswith("year") else 1)
        year, month = divmod(months, 12)
        last = (datetime(year + (month == 11), (month + 1) % 12 + 1, 1) - timedelta(days=1)).day
        return now.replace(year=year, month=month + 1, day=min(now.day, last))
    return now - timedelta(**{unit.rstrip("s") + "s": n})


def _create(text: str, zone: str | None, pattern: str | None, now: datetime) -> datetime | None:
    if _OFFSET.search(text):
        return _free(text)
    if ago := _AGO.search(text):
        try:
            return _back(now, int(ago[1]), ago[2].lower())
        except (OverflowError, ValueError):
            return None
    if _NOW.search(text):
        return now
    if zone is not None:
        try:
            tz = ZoneInfo(zone)
        except (KeyError, ValueError):
            return None
        place = lambda found: _in_zone(found, tz)
    else:
        place = lambda found: found.replace(tzinfo=UTC)
    if pattern is not None:
        found = _parse(text, rule_format(pattern))
        return None if found is None else place(found)
    for form in PLAIN_FORMATS + (UTC_ONLY_FORMATS if zone is None else []):
        if (found := _parse(text, form)) and (placed := place(found)):
            return placed
    return _free(text)


def rejoin_pieces(text: str) -> str:
    """The date-like pieces of a text, a space between each, the meridian set apart."""
    joined = " ".join(m[0] for m in _PIECES.finditer(text)).replace(".m.", "m")
    return _MERIDIAN.sub(r"\1 \2 \3", joined).strip()


def iso(moment: datetime) -> str:
    return moment.replace(tzinfo=None).isoformat(timespec="milliseconds") + "Z"


def clean_date(text: str, zone: str | None = None, pattern: str | None = None, now: datetime | None = None) -> str | None:
    """The ISO timestamp of a raw date, or None. ``now`` is what relative times count from."""
    now = now or datetime.now(UTC)
    if re.fullmatch(r"\d{13}|\d{10}", text):
        try:
            return iso(datetime.fromtimestamp(0, UTC) + timedelta(milliseconds=int(text) * (1 if len(text) == 13 else 1000)))
        except OverflowError:
            return None
    found = _create(text, zone, pattern, now) or _create(rejoin_pieces(text), zone, pattern, now)
    return None if found is None else iso(found)


#: Spark's patterns for the plain formats.
_SPARK_FORMATS = [
    "yyyy-MM-dd'T'HH:mm:ss.SSS",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
    "yyyy/MM/dd",
    "yyyy MM dd",
    "MMMM d, yyyy",
    "MMM d, yyyy",
    "MMM d, yyyy HH:mm",
    "MMMM d, yyyy h:mm a",
]


#: What a value must look like before Spark's pattern of the same place is tried: most values cost one parse.
_SHAPES = [
    r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}\z", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\z", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}\z",
    r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\z", r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}\z", r"^\d{4}-\d{2}-\d{2}\z", r"^\d{4}/\d{2}/\d{2}\z", r"^\d{4} \d{2} \d{2}\z",
    r"^\p{L}+ \d{1,2}, \d+\z", r"^\p{L}+ \d{1,2}, \d+\z", r"^\p{L}+ \d{1,2}, \d+ \d{2}:\d{2}\z", r"^\p{L}+ \d{1,2}, \d+ \d{1,2}:\d{2} \p{L}+\z",
]


def iso_date(raw: Column, zone: str | None = None) -> Column:
    """clean_date for the explicit formats, as one column expression; anything else is null."""
    seconds = F.when(raw.rlike(r"^[0-9]{13}\z"), F.timestamp_millis(raw.try_cast("bigint")))
    seconds = seconds.when(raw.rlike(r"^[0-9]{10}\z"), F.timestamp_seconds(raw.try_cast("bigint")))
    tries = [F.when(raw.rlike(shape), F.try_to_timestamp(raw, F.lit(form))) for shape, form in zip(_SHAPES, _SPARK_FORMATS)]
    parsed = F.coalesce(*tries)
    if zone:
        parsed = F.to_utc_timestamp(parsed, zone)
    return F.date_format(F.coalesce(seconds, parsed), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
