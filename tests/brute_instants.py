"""A plain reading of mixed timestamps, one value at a time, to test the operator against."""

import re
from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

EPOCH = datetime(1970, 1, 1)
DAYS = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]
MONTHS = "january february march april may june july august september october november december".split()


def offset_of_abbreviation(name, tz):
    for year in range(2037, 1999, -1):
        for month in (1, 4, 7, 10):
            at = datetime(year, month, 15, tzinfo=timezone.utc).astimezone(ZoneInfo(tz))
            if at.tzname() == name.upper():
                return at.utcoffset()
    return None


def local_to_utc(naive, tz):
    """Earlier of two, None where the clock never shows it."""
    info = ZoneInfo(tz)
    found = []
    for fold in (0, 1):
        utc = naive.replace(tzinfo=info, fold=fold).astimezone(timezone.utc)
        if utc.astimezone(info).replace(tzinfo=None) == naive:
            found.append(utc.replace(tzinfo=None))
    return min(found) if found else None


def instant(value, src, flight_date, sources):
    if value is None:
        return None
    v = re.sub(r"\s+", " ", value.strip())
    tz, order = sources.get(src.strip().lower() if src else None, (None, None))
    if re.fullmatch(r"\d{10}(\.\d+)?|\d{13}|\d{16}", v):
        whole, _, part = v.partition(".")
        return int(whole) * {10: 10**6, 13: 1000, 16: 1}[len(whole)] + (int((part + "000000")[:6]) if part else 0)
    zone = None  # an offset or a zone name
    m = re.search(r"\[([^\]]+)\]$", v)
    if m:
        zone, v = m[1], v[: m.start()]
    m = re.search(r" ?\(?(?:UTC|GMT)?([+-]\d{1,2}(?::?\d\d)?)\)?$", v) if re.search(r"\d:\d\d.*[+-]\d|(UTC|GMT)[+-]|T\d{4,6}[+-]", v) else None
    if m:
        digits = m[1][1:].replace(":", "")
        h, mi = (digits, "0") if len(digits) < 3 else (digits[:-2], digits[-2:])
        if int(mi) > 59 or int(h) * 60 + int(mi) > 18 * 60:
            return None
        zone, v = (1 if m[1][0] == "+" else -1) * timedelta(hours=int(h), minutes=int(mi)), v[: m.start()]
    elif re.search(r"(\d|[Mm]\.?)[zZ]$", v):
        zone, v = timedelta(0), v[:-1]
    else:
        m = re.search(r" \(?([A-Za-z]{2,5})\)?$", v)
        if m and not re.fullmatch(r"[AaPp][Mm]", m[1]) and re.search(r"\d", v):
            v = v[: m.start()]
            zone = timedelta(0) if m[1] in ("UTC", "GMT") else (offset_of_abbreviation(m[1], tz) if tz else None)
            if zone is None:
                return None
    v = v.strip()
    m = re.search(r"(?:^|[ T])(\d{1,2}):(\d\d)(?::(\d\d)(?:[.,](\d+))?)? ?(?:([ap])\.?m\.?)?$", v, re.I)
    if m:
        h, mi, s, f, half = m.groups()
        v = v[: m.start()].strip().rstrip(",")
    else:
        m = re.fullmatch(r"(\d{8})T(\d\d)(\d\d)(\d\d)?", v)
        if not m:
            return None
        h, mi, s, f, half = m[2], m[3], m[4], None, None
        v = f"{m[1][:4]}-{m[1][4:6]}-{m[1][6:]}"
    h, mi, s, us = int(h), int(mi), int(s or 0), int(((f or "") + "000000")[:6])
    if half:
        if not 1 <= h <= 12:
            return None
        h = h % 12 + 12 * (half.lower() == "p")
    if h > 23 or mi > 59 or s > 59:
        return None
    try:
        if not v:
            day = date.fromisoformat(flight_date)
        elif m := re.fullmatch(r"(\d{4})([-/.])(\d{1,2})\2(\d{1,2})", v):
            day = date(int(m[1]), int(m[3]), int(m[4]))
        elif m := re.fullmatch(r"(\d{1,2})([-/.])(\d{1,2})\2(\d{4}|\d\d?)", v):
            got = dict(zip(order or "", (m[1], m[3], m[4])))
            if not got or len(got["y"]) not in (2, 4) or len(got["d"]) > 2:
                return None
            day = date(int(got["y"]) + 2000 * (len(got["y"]) == 2), int(got["m"]), int(got["d"]))
        else:
            words = re.findall(r"[A-Za-z]+|\d+", v)
            weekday = words.pop(0) if words[0].lower()[:3] in DAYS else None
            if words[0].isdigit():
                d, mon, y = words
            else:
                mon, d, y = words
            month = next(i + 1 for i, n in enumerate(MONTHS) if mon.lower() in (n, n[:3]))
            day = date(int(y) + 2000 * (len(y) == 2), month, int(d))
            if weekday and DAYS[day.weekday()] != weekday.lower()[:3]:
                return None
    except (ValueError, TypeError, StopIteration, IndexError):
        return None
    naive = datetime(day.year, day.month, day.day, h, mi, s, us)
    if isinstance(zone, timedelta):
        utc = naive - zone
    else:
        utc = local_to_utc(naive, zone or tz) if zone or tz else None
    return None if utc is None else (utc - EPOCH) // timedelta(microseconds=1)
