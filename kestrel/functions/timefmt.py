"""Timestamp parsing and time formatting as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names by their first letters, and zone names with their offset in hours.
MONTH_STARTS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
ZONE_HOURS = {"z": 0, "ut": 0, "utc": 0, "gmt": 0, "est": -5, "edt": -4, "cst": -6, "cdt": -5, "mst": -7, "mdt": -6,
              "pst": -8, "pdt": -7}

# The grammar of written dates, as one pattern with named groups. Blanks may be no-break ones.
_S = r"[\s\x{A0}\x{202F}]"
_MONTH = "(?:" + "|".join(MONTH_STARTS) + ")"
_WEEKDAY = rf"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?{_S}+)?"
_DATES = [  # group names end in the number of the alternative
    r"(?<y1>\d{4})[/-](?<m1>\d{1,2})[/-](?<d1>\d{1,2})",
    r"(?<m2>\d{1,2})[/-](?<d2>\d{1,2})[/-](?:(?<y2>\d{4})|(?<s2>\d{2}))",
    rf"(?<m3>{_MONTH})[a-z]*[\s.-]{{1,3}}(?<d3>\d{{1,2}})(?:[\s,-]{{1,3}}(?:(?<y3>\d{{4}})|(?<s3>\d{{2}}))(?![\d:]))?",
    rf"(?<d4>\d{{1,2}})[\s-]{{1,3}}(?<m4>{_MONTH})[a-z]*[\s.,-]{{1,3}}(?:(?<y4>\d{{4}})|(?<s4>\d{{2}}))",
]
_CLOCK = rf"(?<h>\d{{1,2}}):(?<i>\d{{2}})(?::(?<s>\d{{2}})(?:[.,](?<f>\d{{1,9}}))?)?(?:{_S}*(?<a>[ap])m\b)?"
_ZONE = rf"(?:{_S}*(?<z>" + "|".join(sorted(ZONE_HOURS, key=len, reverse=True)) + r")(?![a-z]))?"
_OFFSET = rf"(?:{_S}*(?<o>[+-])(?<oh>\d{{1,2}}):?(?<om>\d{{2}})?)?"
TIME_SHAPE = (rf"(?i)^{_WEEKDAY}(?:{'|'.join(_DATES)})(?:(?:,?{_S}+|t){_CLOCK}{_ZONE}{_OFFSET})?"
              rf"(?:{_S}+(?<y5>\d{{4}}))?(?:{_S}+(?:utc|gmt|z))?(?:{_S}*\([^()]*\))?$")
# What the pattern puts in the place of a written date: its parts, each ended by a mark.
_MARK = "\u0001"
_PARTS = ["${y1}${y2}${y3}${y4}${y5}", "${s2}${s3}${s4}", "${m1}${m2}", "${m3}${m4}", "${d1}${d2}${d3}${d4}", "${h}", "${i}",
          "${s}", "${f}", "${a}", "${z}", "${o}", "${oh}", "${om}"]
ISO_SHAPE = r"^[+-]?\d{4,}(-|$)"


def time_parts(s: Column) -> Column:
    """Text -> struct of ``iso``, what a cast reads, and for other texts ``parts``, the parts of a
    written date (see ``_PARTS``), one element where the text is no such date."""
    t = F.trim(s)
    # A cast alone would read a bare time of day as today.
    iso = F.when(t.rlike(ISO_SHAPE), t.try_cast("timestamp"))
    parts = F.when(iso.isNull(), F.split(F.regexp_replace(t, TIME_SHAPE, _MARK.join(_PARTS)), _MARK))
    return F.struct(iso.alias("iso"), parts.alias("parts"))


def _assembled(parts: Column) -> Column:
    """The timestamp that the parts name; NULL for impossible dates, hours or offsets."""
    part = lambda i: F.get(parts, i)
    num = lambda i: part(i).try_cast("int")
    or0 = lambda i: F.when(part(i) == "", F.lit(0)).otherwise(num(i))
    year = F.coalesce(num(0), (num(1) + 50) % 100 + 1950)  # two digits: 1950 to 2049
    named = F.array_position(F.array(*[F.lit(m) for m in MONTH_STARTS]), F.lower(part(3))).cast("int")
    month = F.when(part(3) == "", num(2)).otherwise(named)
    hour = F.when(part(9) == "", or0(5)).when(or0(5) <= 12, or0(5) % 12 + F.when(F.lower(part(9)) == "p", 12).otherwise(0))
    second = F.concat(F.when(part(7) == "", "0").otherwise(part(7)), F.lit("."), F.rpad(F.substring(part(8), 1, 3), 3, "0"))
    local = F.try_make_timestamp(year, month, num(4), hour, or0(6), second.try_cast("decimal(16,6)"))
    zone = F.lit(0)
    for name, hours in ZONE_HOURS.items():
        if hours:
            zone = F.when(F.lower(part(10)) == name, hours * 60).otherwise(zone)
    ahead = F.when(or0(12) * 60 + or0(13) < 1440, or0(12) * 60 + or0(13))
    minutes = F.when(part(11) == "", zone).when(part(11) == "-", -ahead).otherwise(ahead)
    return F.when(F.size(parts) == len(_PARTS), F.timestamp_millis(F.unix_millis(local) - minutes * 60_000))


def parse_ts(s: Column, parts: Column | None = None) -> Column:
    """Text -> TIMESTAMP at millisecond precision, NULL when unparseable.

    The ISO family (date, date-time with ``T`` or space, fraction, ``Z`` or
    offset) goes through ``try_cast``. Other written dates are read by one
    pattern: year, month and day in figures or with a month's name, an optional
    week day, a 12- or 24-hour clock, a zone name, an offset and a remark in
    brackets. Text without a zone is UTC. A time without a date is no time, and
    a day that its month lacks is no date. A ``YYYY-MM-DD HH:MM:SS`` prefix
    followed by junk is read as that prefix in UTC. Sub-millisecond digits are
    dropped. ``parts`` may be ``time_parts(s)`` from an earlier projection, so
    that the pattern runs once per text.
    """
    t = F.trim(s)
    read = time_parts(s) if parts is None else parts
    prefix = F.regexp_extract(t, r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})", 1)
    fallback = F.when(prefix != "", prefix.try_cast("timestamp"))
    ts = F.coalesce(read["iso"], _assembled(read["parts"]), fallback)
    return F.when((t.isNull()) | (t == ""), F.lit(None).cast("timestamp")).otherwise(
        F.timestamp_millis(F.unix_millis(ts)))


def iso_utc(ts: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SS.sssZ`` (session zone is UTC)."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def fmt_elapsed(seconds: Column) -> Column:
    """Seconds -> ``Hh MMm SSs`` / ``Mm SSs`` / ``Ss``, rounding half to even."""
    total = F.bround(seconds.cast("double"), 0).cast("long")
    h = F.floor(total / 3600).cast("long")
    rem = total - h * 3600
    m = F.floor(rem / 60).cast("long")
    s = rem - m * 60
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return (F.when(h > 0, F.concat(h.cast("string"), F.lit("h "), two(m), F.lit("m "), two(s), F.lit("s")))
            .when(m > 0, F.concat(m.cast("string"), F.lit("m "), two(s), F.lit("s")))
            .otherwise(F.concat(s.cast("string"), F.lit("s"))))
