"""Small column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def in_window(minute: Column, window: str) -> Column:
    """``"HH:MM-HH:MM"`` in UTC, half open; wraps past midnight."""
    low, high = parse_window(window)
    return (minute >= low) & (minute < high) if low <= high else (minute >= low) | (minute < high)


def parse_window(window: str) -> tuple[int, int]:
    try:
        ends = [tuple(map(int, p.split(":"))) for p in window.split("-")]
        (a, b), (x, y) = ends
    except ValueError as e:
        raise ValueError(f"not a time window: {window}") from e
    if not (0 <= a < 24 and 0 <= x < 24 and 0 <= b < 60 and 0 <= y < 60):
        raise ValueError(f"not a time window: {window}")
    return a * 60 + b, x * 60 + y


def seconds_of(text: str) -> int:
    """``"7d"``, ``"48h"``, ``"15m"``, ``"30s"``."""
    unit = {"d": 86400, "h": 3600, "m": 60, "s": 1}[text[-1]]
    return int(text[:-1]) * unit


def rfc3339(ts: Column) -> Column:
    """UTC, to milliseconds."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def json_number(text: Column, path: str, default: float = 0.0) -> Column:
    """The number at a path of a JSON text; the default where there is none."""
    return F.coalesce(F.get_json_object(text, path).try_cast("double"), F.lit(default))


def json_text(text: Column, path: str, default: str = "") -> Column:
    return F.coalesce(F.get_json_object(text, path), F.lit(default))


def merge_counts(a: Column, b: Column) -> Column:
    """Two maps of counts as one, values of equal keys summed; null is an empty map."""
    none = F.create_map().cast("map<string,bigint>")
    return F.map_zip_with(F.coalesce(a, none), F.coalesce(b, none), lambda k, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def weight(key: Column, seed: int, low: float = 0.5, high: float = 1.5) -> Column:
    """A uniform weight from a key's hash: the same on every run and engine."""
    h = F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")).cast("binary")), 1, 8), 16, 10).cast("double")
    return low + (high - low) * h / float(1 << 32)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
