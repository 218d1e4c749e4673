"""One UTC instant for times written in mixed formats, precisions and zones.

A value is matched against an ordered cascade of anchored patterns. The first that fits rewrites it
into one canonical row of parts, which are then checked strictly: a month has its own number of days,
a 12-hour clock runs from 1 to 12, a named weekday must be that of the date, offsets stay within 18
hours. What is no existing date and time gives null. All of it is JVM expressions; the only join is
with the table of sources.

Zone policy, in this order: an offset, Z, UTC or GMT in the value; an abbreviation as it is used in the
zone of the row's source at the value's date; a bracketed zone name; the zone of the source. A local time shown twice is
the earlier instant, one never shown gives null.
"""

from __future__ import annotations

from bisect import bisect_right
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo, available_timezones

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: English month and weekday names
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
WEEKDAYS = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]

_B = r"[\s\u00a0\u2000-\u200a\u202f\u3000]"
_TIME = rf"(\d{{1,2}}):(\d{{2}})(?::(\d{{2}})(?:[.,](\d+))?)?(?:{_B}*([AaPp])\.?[Mm]\.?)?"
_ZONE = rf"(?:{_B}*\(?((?:[Uu][Tt][Cc]|[Gg][Mm][Tt])?[+-]\d{{1,2}}(?::?\d{{2}})?|[A-Za-z]{{1,5}})\)?)?(?:\[([A-Za-z0-9_+/-]+)\])?"
_SPLIT = rf"(?:[Tt]|,?{_B}+)"
_DAY = rf"(?:(Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*,?{_B}+)?"
_MONTH = r"(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)(?:uary|ruary|ch|il|e|y|ust|t|tember|ober|ember)?\.?"
_OUTER = rf"^{_B}+|{_B}+$"

# (pattern, canonical parts: kind|weekday|a|b|c|hour|minute|second|fraction|half|zone|region)
CASCADE = [
    (rf"^(\d{{4}})([-/.])(\d{{1,2}})\2(\d{{1,2}}){_SPLIT}{_TIME}{_ZONE}$", "ymd||$1|$3|$4|$5|$6|$7|$8|$9|$10|$11"),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})[Tt](\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d+))?)?{_ZONE}$", "ymd||$1|$2|$3|$4|$5|$6|$7||$8|$9"),
    (r"^(\d{10}|\d{13}|\d{16}|\d{19})(?:[.,](\d+))?$", "epoch||$1||||||$2|||"),
    (rf"^{_TIME}{_ZONE}$", "time|||||$1|$2|$3|$4|$5|$6|$7"),
    (rf"^(\d{{1,2}})([-/.])(\d{{1,2}})\2(\d{{4}}|\d{{1,2}}){_SPLIT}{_TIME}{_ZONE}$", "numeric||$1|$3|$4|$5|$6|$7|$8|$9|$10|$11"),
    (rf"(?i)^{_DAY}(\d{{1,2}})(?:-|{_B}+){_MONTH}(?:-|,?{_B}+)(\d{{4}}|\d{{2}}){_SPLIT}{_TIME}{_ZONE}$", "dmy|$1|$2|$3|$4|$5|$6|$7|$8|$9|$10|$11"),
    (rf"(?i)^{_DAY}{_MONTH}{_B}+(\d{{1,2}}),?{_B}+(\d{{4}}|\d{{2}}){_SPLIT}{_TIME}{_ZONE}$", "mdy|$1|$2|$3|$4|$5|$6|$7|$8|$9|$10|$11"),
]
PARTS = ["kind", "weekday", "a", "b", "c", "hour", "minute", "second", "fraction", "half", "zone", "region"]


@lru_cache(None)
def zone_names(jvm: frozenset[str] | None = None) -> tuple[str, ...]:
    """Names of the public time zone database, about 600: of those, the ones that `jvm` holds too."""
    names = available_timezones()
    return tuple(sorted(names if jvm is None else names & jvm))


def known_zones(spark: SparkSession) -> tuple[str, ...]:
    """Names that both the database and the session's virtual machine know."""
    jvm = spark.sparkContext._jvm
    names = jvm.java.lang.String.join(",", jvm.java.time.ZoneId.getAvailableZoneIds()).split(",")
    short = jvm.java.lang.String.join(",", jvm.java.time.ZoneId.SHORT_IDS.keySet()).split(",")
    return zone_names(frozenset([*names, *short]))


STEP = timedelta(days=7)


@lru_cache(None)
def abbreviations(zone: str, since: int = 1970, until: int = 2038) -> dict[str, list[tuple[int, int]]]:
    """What a zone's abbreviations stand for: (first second on the local clock, offset in seconds), in order of time.

    A meaning holds until the next one begins, and the first one holds for all time before it.
    """
    info = ZoneInfo(zone)

    def at(second: int) -> tuple[str, int]:
        local = datetime.fromtimestamp(second, timezone.utc).astimezone(info)
        return local.tzname().upper(), int(local.utcoffset().total_seconds())

    out: dict[str, list[tuple[int, int]]] = {}
    low = int(datetime(since, 1, 1, tzinfo=timezone.utc).timestamp())
    end, step, now, begun = int(datetime(until, 1, 1, tzinfo=timezone.utc).timestamp()), int(STEP.total_seconds()), None, low
    while low < end:
        if at(low) != now:
            # the first second of the new state lies within the last step
            past, begun = (low - step, low) if now else (low - 1, low)
            while begun - past > 1:
                mid = (begun + past) // 2
                past, begun = (mid, begun) if at(mid) == now else (past, mid)
            now = at(begun)
            name, offset = now
            uses = out.setdefault(name, []) if name.isalpha() else []
            if not uses or uses[-1][1] != offset:
                uses.append((begun + offset, offset))
        low += step
    return out


def meaning(zone: str, name: str, local: int) -> int | None:
    """The offset that an abbreviation stands for at a second of the local clock of a zone, None where it is none of that zone."""
    uses = abbreviations(zone).get(name.upper())
    return uses[max(0, bisect_right(uses, local, key=lambda u: u[0]) - 1)][1] if uses else None


def _known(column: str, zones: tuple[str, ...]) -> Column:
    """Whether a column holds one of the names; one parsed text instead of a call per name."""
    return F.expr(f"{column} in ({', '.join(repr(z) for z in zones)})")


def source_zones(sources: DataFrame, zones: tuple[str, ...]) -> tuple[DataFrame, dict[str, dict[str, list[tuple[int, int]]]]]:
    """One row (src_key, tz, date_order) per source, and the abbreviations of the zones that occur.

    Names are compared without letter case and outer blanks. A zone the database doesn't know counts as
    unknown; a source stated more than once takes the smallest value of each column. Only zone names of
    the database reach the driver, so their number is bounded by it.
    """
    name = F.lower(F.regexp_replace("src", _OUTER, ""))
    sources = sources.withColumn("tz_name", F.regexp_replace("tz_name", _OUTER, ""))
    known = _known("tz_name", zones)
    table = sources.where(F.col("src").isNotNull()).groupBy(name.alias("src_key")).agg(F.min(F.when(known, F.col("tz_name"))).alias("tz"), F.min(F.lower(F.trim("date_order"))).alias("date_order"))
    used = [r[0] for r in sources.where(known).select("tz_name").distinct().collect()]
    return table, {z: abbreviations(z) for z in used}


def _int(c: Column) -> Column:
    return F.when(c != "", c).cast("int")


def _index(names: list[str], c: Column) -> Column:
    return F.when(F.array_position(F.array(*map(F.lit, names)), F.lower(c)) > 0, F.array_position(F.array(*map(F.lit, names)), F.lower(c)))


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a date of the Gregorian calendar, null where there is no such date."""
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    length = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    ok = y.between(1, 9999) & m.between(1, 12) & (d >= 1) & (d <= length)
    return F.when(ok, F.unix_date(F.make_date(y, m, F.lit(1))) + d - 1)


def _settled(df: DataFrame, keep: list, new: dict[str, Column]) -> DataFrame:
    """Adds columns as the output of a generator of one row, so that a filter on them isn't pushed below, which would repeat their expressions at every step."""
    return df.select(*keep, F.inline(F.array(F.struct(*(e.alias(k) for k, e in new.items())))))


def _named_offset(uses: dict[str, dict[str, list[tuple[int, int]]]]) -> Column:
    """The offset of zone|abbreviation in `_named` at `_local`; the names with more than one meaning are looked up by the time."""
    single = {f"{z}|{n}": u[0][1] for z, names in uses.items() for n, u in names.items() if len(u) == 1}
    several = {f"{z}|{n}": u for z, names in uses.items() for n, u in names.items() if len(u) > 1}
    key = F.col("_named")
    out = F.try_element_at(F.expr(f"map({', '.join(f"'{k}', {v}" for k, v in single.items())})"), key) if single else F.lit(None).cast("int")
    if several:
        listed = ", ".join(f"'{k}', array({', '.join(f'named_struct("a", {a}L, "o", {o})' for a, o in u)})" for k, u in several.items())
        of = F.try_element_at(F.expr(f"map({listed})"), key)
        begun = F.filter(of, lambda u: u["a"] * 1_000_000 <= F.col("_local"))
        out = F.coalesce(out, F.when(F.size(begun) > 0, F.element_at(begun, -1)["o"]).otherwise(F.try_element_at(of, F.lit(1))["o"]))
    return out


def to_instants(rows: DataFrame, columns: list[str], sources: DataFrame, keep: list[str], source: str = "src", flight_date: str = "flight_date") -> DataFrame:
    """One row (keep..., field_name, utc_us) per value of `columns` that denotes an instant.

    Null, empty and meaningless values, and values whose zone or date order would have to come from an
    unknown source, give no row. Repeated rows give repeated results. `sources` must have src, tz_name
    and date_order; it may be empty. Values of any length are matched whole.
    """
    zones = known_zones(rows.sparkSession)
    table, uses = source_zones(sources, zones)
    own = rows.select(
        F.struct(*keep).alias("_keep"), F.lower(F.regexp_replace(source, _OUTER, "")).alias("src_key"), F.col(flight_date).cast("string").alias("_date"),
        F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.regexp_replace(F.col(c).cast("string"), _OUTER, "").alias("value")) for c in columns))).alias("_f"),
    )
    parsed = own.where("_f.value is not null").join(table, "src_key", "left")
    # the first pattern that fits rewrites a value, so those after it are never tried; most values fit an early one
    value, canonical = F.col("_f.value"), F.lit(None).cast("string")
    for pattern, parts in reversed(CASCADE):
        canonical = F.when(value.rlike(pattern), F.regexp_replace(value, pattern, parts)).otherwise(canonical)
    parsed = parsed.withColumn("_p", F.split(canonical, r"\|"))
    parsed = _settled(parsed, ["_keep", "tz", "date_order", "_date", F.col("_f.name").alias("field_name")], {f"_{k}": F.col("_p")[i] for i, k in enumerate(PARTS)})
    kind, a, b, c, half, weekday = (F.col(f"_{k}") for k in ("kind", "a", "b", "c", "half", "weekday"))
    stated = F.regexp_extract(F.col("_date"), r"^\s*(\d{4}-\d{1,2}-\d{1,2})(?:[T ].*)?$", 1)
    # every step names what the next one uses more than once, which keeps the generated code small
    parsed = parsed.withColumns({
        "_order": F.when(kind != "numeric", kind).when(F.col("date_order").isin("ymd", "mdy", "dmy"), F.col("date_order")),
        "_stated": F.split(F.when(stated != "", stated), "-"),
        "_zone": F.upper("_zone"),
        "_hour": _int(F.col("_hour")),
        "_minute": _int(F.col("_minute")),
        "_second": F.coalesce(_int(F.col("_second")), F.lit(0)),
        "_micros": F.substring(F.rpad(F.col("_fraction"), 6, "0"), 1, 6).cast("long"),
    })
    order, stated, hour, zone = (F.col(x) for x in ("_order", "_stated", "_hour", "_zone"))
    parsed = parsed.withColumns({
        "_year_text": F.when(kind == "time", stated[0]).when(order == "ymd", a).when(order.isin("mdy", "dmy"), c),
        "_month_text": F.when(kind == "time", stated[1]).when(order == "mdy", a).when(order.isin("ymd", "dmy"), b),
        "_day_text": F.when(kind == "time", stated[2]).when(order == "dmy", a).when(order == "mdy", b).when(order == "ymd", c),
        "_hour": F.when(half == "", F.when(hour <= 23, hour)).when(hour.between(1, 12), hour % 12 + F.when(F.lower(half) == "p", 12).otherwise(0)),
        "_signed": F.regexp_extract(zone, r"^(?:UTC|GMT)?([+-]\d{1,2}(?::?\d{2})?)$", 1),
    })
    year, month, day, signed = (F.col(x) for x in ("_year_text", "_month_text", "_day_text", "_signed"))
    parsed = parsed.withColumns({
        "_y": F.when(F.length(year) == 4, _int(year)).when(F.length(year) == 2, _int(year) + 2000),
        "_m": F.when(kind.isin("dmy", "mdy"), _index(MONTHS, month).cast("int")).when(F.length(month) <= 2, _int(month)),
        "_d": F.when(F.length(day) <= 2, _int(day)),
        "_digits": F.regexp_replace(F.substring(signed, 2, 6), ":", ""),
    })
    digits = F.col("_digits")
    parsed = _settled(parsed, ["*"], {
        "_days": _days(F.col("_y"), F.col("_m"), F.col("_d")),
        "_off_h": _int(F.when(F.length(digits) > 2, F.expr("substring(_digits, 1, length(_digits) - 2)")).otherwise(digits)),
        "_off_m": F.coalesce(_int(F.when(F.length(digits) > 2, F.substring(digits, -2, 2))), F.lit(0)),
    })
    days, off_h, off_m, minute, second = (F.col(x) for x in ("_days", "_off_h", "_off_m", "_minute", "_second"))

    right_day = (weekday == "") | (F.pmod(days + 3, F.lit(7)) + 1 == _index(WEEKDAYS, F.substring(weekday, 1, 3)))
    clock = F.when((minute <= 59) & (second <= 59), ((F.col("_hour") * 60 + minute) * 60 + second).cast("long") * 1_000_000 + F.col("_micros"))
    numeric = F.when((off_m <= 59) & (off_h * 60 + off_m <= 18 * 60), (off_h * 60 + off_m) * 60 * F.when(F.substring(signed, 1, 1) == "-", -1).otherwise(1))
    region = F.when(F.col("_region") == "", F.col("tz")).when(F.upper("_region").isin("Z", "UTC", "GMT"), F.lit("UTC")).when(_known("_region", zones), F.col("_region"))
    # of an epoch number the digits beyond the point count as far as they reach a microsecond
    number = F.when(kind == "epoch", a)
    epoch = (
        F.when(F.length(number) == 10, number.cast("long") * 1_000_000 + F.col("_micros"))
        .when(F.length(number) == 13, number.cast("long") * 1_000 + F.floor(F.col("_micros") / 1000))
        .when(F.length(number) == 16, number.cast("long"))
        .when(F.length(number) == 19, F.substring(number, 1, 16).cast("long"))
    )
    named = F.when((zone != "") & ~zone.isin("Z", "UTC", "GMT") & (signed == "") & F.col("tz").isNotNull(), F.concat_ws("|", "tz", "_zone"))
    parsed = parsed.select(
        "_keep", "field_name", "_kind", "_zone", epoch.alias("_epoch"), F.when(right_day, days.cast("long") * 86_400_000_000 + clock).alias("_local"),
        F.when(zone.isin("Z", "UTC", "GMT"), 0).when(signed != "", numeric).alias("_offset"), named.alias("_named"), F.when(zone == "", region).alias("_region"),
    )
    parsed = parsed.withColumn("_offset", F.coalesce("_offset", _named_offset(uses)))
    parsed = parsed.withColumn("_utc", F.to_utc_timestamp(F.timestamp_micros("_local"), F.col("_region")))
    shown = F.when(F.from_utc_timestamp("_utc", F.col("_region")) == F.timestamp_micros("_local"), F.unix_micros("_utc"))
    instant = F.when(F.col("_kind") == "epoch", F.col("_epoch")).when(F.col("_zone") != "", F.col("_local") - F.col("_offset").cast("long") * 1_000_000).otherwise(shown)
    return _settled(parsed, ["_keep.*", "field_name"], {"utc_us": instant}).where("utc_us is not null")
