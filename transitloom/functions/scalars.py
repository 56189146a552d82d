"""Scalar column helpers: identifiers, times, bins, labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: labels, limits and zones the analyses are defined with ----------------
LOCAL_ZONE = "America/Vancouver"
BUS = "3"
PERIOD_ORDER = ["Night", "Morning Rush", "Midday", "Evening Rush", "Evening"]
DELAY_EDGES = [-7.0, -3.0, 3.0, 7.0]
DELAY_SEVERITY = [
    "Severe Early (<-7)",
    "Minor Early (-7 to -3)",
    "On Time (±3)",
    "Minor Late (3 to 7)",
    "Severe Late (>7)",
]
DELAY_CATEGORY = [
    "Severe Early (<-7 min)",
    "Minor Early (-7 to -3 min)",
    "On Time (±3 min)",
    "Minor Late (3 to 7 min)",
    "Severe Late (>7 min)",
]
HEADWAY_EDGES = [3.0, 10.0, 20.0]
HEADWAY_CATEGORY = [
    "Bunched (<3 min)",
    "Good (3-10 min)",
    "Acceptable (10-20 min)",
    "Gap (>20 min)",
]
DENSITY_EDGES = [1000.0, 5000.0, 10000.0]
DENSITY_CATEGORY = ["Low (<1k)", "Medium (1k-5k)", "High (5k-10k)", "Very High (>10k)"]
MODE_NAMES = {
    "0": "Streetcar",
    "1": "Subway",
    "2": "Rail",
    "3": "Bus",
    "4": "Ferry",
    "5": "Cable",
    "6": "Aerial",
    "7": "Funicular",
}
REPORT_MODE_NAMES = {
    "0": "streetcar",
    "1": "subway",
    "2": "rail",
    "3": "bus",
    "4": "ferry",
    "11": "trolley",
}
CLOCK_PATTERN = r"^(\d{1,2}):(\d{2})(?::(\d{2}))?$"
# -------------------------------------------------------------------------------------------


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: Column | str) -> Column:
    c = _col(c)
    return F.when(F.trim(c) != "", c)


def normalise_time(c: Column | str) -> Column:
    """``H:MM``, ``HH:MM`` or ``H:MM:SS`` with outer blanks to ``HH:MM:SS``; other text is only trimmed."""
    text = F.regexp_replace(_col(c), r"^\s+|\s+$", "")
    part = lambda i: F.regexp_extract(text, CLOCK_PATTERN, i)
    seconds = F.coalesce(F.nullif(part(3), F.lit("")), F.lit("00"))
    clock = F.concat_ws(":", F.lpad(part(1), 2, "0"), part(2), seconds)
    return F.when(text.rlike(CLOCK_PATTERN), clock).otherwise(text)


def service_seconds(c: Column | str) -> Column:
    """``HH:MM:SS`` to seconds of the service day; hours may pass 24, unreadable text gives NULL."""
    field = lambda i: F.regexp_extract(_col(c), r"^\s*(\d+):(\d{1,2}):(\d{1,2})\s*$", i).try_cast("int")
    return field(1) * 3600 + field(2) * 60 + field(3)


def service_instant(date: Column | str, seconds: Column | str) -> Column:
    """Midnight of the date plus a service-day offset."""
    days = F.unix_date(_col(date).cast("date")).cast("long")
    return F.timestamp_seconds(days * 86400 + _col(seconds))


def parse_service_date(c: Column | str) -> Column:
    """``YYYYMMDD`` to a date; anything else gives NULL."""
    text = _col(c)
    return F.when(text.rlike(r"^\d{8}$"), F.try_to_timestamp(text, F.lit("yyyyMMdd")).cast("date"))


def parse_iso(c: Column | str) -> Column:
    """ISO text, ``Y-m-d`` or ``Y-m-d H:M:S``; a value without zone is read as UTC, bad text gives NULL."""
    return _col(c).try_cast("timestamp")


def trip_instance_id(trip_id: Column, start_date: Column, start_time: Column,
                     vehicle_id: Column, fallback: Column) -> Column:
    """Identity of one physical run, from whatever parts the feed supplies."""
    has_text = lambda c: F.nullif(c, F.lit(""))
    stamp = F.date_format(fallback, "yyyyMMdd'T'HHmmss")
    run = F.concat_ws(
        "_",
        has_text(trip_id),
        F.date_format(start_date, "yyyyMMdd"),
        F.regexp_replace(has_text(start_time), ":", ""),
    )
    return F.coalesce(
        has_text(run),
        F.concat(has_text(vehicle_id), F.lit("_"), stamp),
        F.concat(F.lit("trip_"), stamp),
    )


def entity_time(*epochs: Column, fallback: Column) -> Column:
    """First non-zero epoch as an instant, else the fallback."""
    return F.coalesce(*[F.timestamp_seconds(F.nullif(e, F.lit(0))) for e in epochs], fallback)


def service_date(start_date: Column | str, instant: Column | str) -> Column:
    return F.coalesce(_col(start_date), F.to_date(_col(instant)))


def local_hour(ts: Column | str, tz: str = LOCAL_ZONE) -> Column:
    return F.hour(F.from_utc_timestamp(_col(ts), tz))


def local_dow(ts: Column | str, tz: str = LOCAL_ZONE) -> Column:
    """Day of week in local time, 0 = Sunday."""
    return F.dayofweek(F.from_utc_timestamp(_col(ts), tz)) - 1


def day_type(dow: Column | str) -> Column:
    return F.when(_col(dow).isin(0, 6), "Weekend").otherwise("Weekday")


def time_period(hour: Column | str) -> Column:
    """First matching label wins: both rush windows take precedence over the wider ones."""
    h = _col(hour)
    return (
        F.when(h.between(7, 9), "Morning Rush")
        .when(h.between(16, 18), "Evening Rush")
        .when(h.between(10, 15), "Midday")
        .when(h.between(19, 22), "Evening")
        .otherwise("Night")
    )


def speed_kmh(metres: Column | str, seconds: Column | str) -> Column:
    return F.try_divide(_col(metres), _col(seconds)) * 3.6


def epoch_diff(later: Column | str, earlier: Column | str) -> Column:
    """Seconds between two instants, to the microsecond."""
    return (F.unix_micros(_col(later)) - F.unix_micros(_col(earlier))) / 1e6


def segment_key(*parts: Column | str) -> Column:
    """Plain concatenation, NULL when a part is NULL. Different parts may give the same text."""
    return F.concat(*[_col(p).cast("string") for p in parts])


def segment_struct(*parts: str) -> Column:
    """Collision-free form of the segment key."""
    return F.struct(*parts)


def bin_right_closed(c: Column | str, edges: Sequence[float], labels: Sequence[str],
                     low: float | None = None) -> Column:
    """Right-closed bins ``(e0, e1]``; an optional lower limit is open and gives NULL below."""
    x = _col(c)
    out = F.when(x.isNull(), F.lit(None).cast("string"))
    if low is not None:
        out = out.when(x <= low, F.lit(None).cast("string"))
    for edge, label in zip(edges, labels):
        out = out.when(x <= edge, label)
    return out.otherwise(labels[-1])


def headway_category(c: Column | str) -> Column:
    return bin_right_closed(c, HEADWAY_EDGES, HEADWAY_CATEGORY, low=0.0)


def clip(c: Column | str, low: float, high: float) -> Column:
    x = _col(c)
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high)), F.lit(low)))


def mode_name(route_type: Column | str) -> Column:
    table = F.create_map(*[F.lit(v) for pair in MODE_NAMES.items() for v in pair])
    return F.coalesce(F.try_element_at(table, _col(route_type)), F.lit("Other"))


def truncate_label(c: Column | str, n: int, ellipsis: str = "") -> Column:
    text = _col(c)
    short = F.substring(text, 1, n)
    return F.when(F.length(text) > n, F.concat(short, F.lit(ellipsis))).otherwise(text) if ellipsis else short


def on_time_flags(df: DataFrame, delay: str = "delay_minutes") -> DataFrame:
    d = F.col(delay)
    return df.withColumns({"on_time": (d >= -3) & (d <= 3), "early": d < -3, "late": d > 3})
