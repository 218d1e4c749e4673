"""Mixed timestamps against a plain reading of one value at a time."""

import itertools
import random
from datetime import datetime, timezone

from brute_instants import instant

from cellmend.operators.instants import meaning, to_instants

SOURCES = [("ny", "America/New_York", "mdy"), ("Berlin ", "Europe/Berlin", "dmy"), ("lh", "Australia/Lord_Howe", "ymd"), ("none", None, "dmy"), ("bad", "Mars/Phobos", "dmy"), ("kolkata", "Asia/Kolkata", "dmy"), ("cn", "Asia/Shanghai", "ymd")]
ZONES = ["", "Z", "z", "+05:45", "-0330", "+02", " UTC", " GMT", " UTC+5:30", " GMT-4", " EST", " (EDT)", " CET", " CST", " IST", "[Europe/Athens]", "+03:00[Europe/Athens]", " XYZ", "+25:00", "+05:99"]
DATES = ["2021-03-14", "2021/3/14", "14.03.2021", "3/4/21", "21-3-4", "29 Feb 2021", "29 Feb 2024", "Mar 14, 2021", "Sun 14-MAR-2021", "Mon 14-MAR-2021", "March 4, 2022", "2021-02-30", "13/13/2020", ""]
TIMES = ["02:30:15", "02:30", "1:05 p.m.", "12:00 AM", "12:59am", "0:30 pm", "25:70", "9:75 p.m.", "23:59:59.123456789", "01:30:00,5", "2:30 AM"]
ODD = [None, "", "  ", "n/a", "cancelled", "20210314T0230", "20210314T023000Z", "20210229T0230", "1615689000", "1615689000.25", "1615689000123", "1615689000123456", "123", "x" * 50_000, "Tue, 27 Jun 2023 03:10:30 +0200", "Wed, 27 Jun 2023 03:10:30 +0200", "2021-10-31T02:30:00", "2021-04-04T01:45:00", "2021-10-03T02:15:00"]


def test_against_plain_reading(spark):
    values = [f"{d}{' ' if d else ''}{t}{z}".strip() for d, t, z in itertools.product(DATES, TIMES, ZONES)] + ODD
    values += [v.replace(" ", "T", 1) for v in values if v and v[:4].isdigit()]
    rng = random.Random(1)
    rows = [(i, rng.choice(["ny", " NY", "berlin", "lh", "none", "bad", "kolkata", "cn", None, "unknown"]), rng.choice(["2021-03-14", "2021-10-31", "2020-02-29", None, "2021-02-30"]), v, None) for i, v in enumerate(values)]
    plain = {s.strip().lower(): (z if z != "Mars/Phobos" else None, o) for s, z, o in SOURCES}
    expected = {(i, "t"): u for i, s, f, v, _ in rows if (u := instant(v, s, f, plain)) is not None}
    df = spark.createDataFrame(rows, "row_id long, src string, flight_date string, t string, u string").selectExpr("*", "1 as tz", "2 as value", "3 as _p")
    got = {(r[0], r[1]): r[2] for r in to_instants(df, ["t", "u"], spark.createDataFrame(SOURCES, "src string, tz_name string, date_order string"), ["row_id"]).collect()}
    wrong = {k: (values[k[0]], rows[k[0]][1:3], expected.get(k), got.get(k)) for k in expected.keys() | got.keys() if expected.get(k) != got.get(k)}
    assert not wrong, dict(itertools.islice(wrong.items(), 20))


def test_empty_tables(spark):
    df = spark.createDataFrame([], "row_id long, src string, flight_date string, t string")
    assert to_instants(df, ["t"], spark.createDataFrame([], "src string, tz_name string, date_order string"), ["row_id"]).collect() == []


def test_zone_names_without_slash_and_dated_abbreviations(spark):
    sources = [("u", "UTC", "ymd"), ("j", "Japan", "ymd"), ("e", " EST ", "ymd"), ("m", "Europe/Moscow", "ymd"), ("x", "Nowhere", "ymd"), ("p", "Asia/Pyongyang", "ymd")]
    cases = {
        ("u", "2024-05-06 10:00"): "2024-05-06 10:00", ("j", "2024-05-06 10:00"): "2024-05-06 01:00", ("e", "2024-05-06 10:00"): "2024-05-06 15:00", ("x", "2024-05-06 10:00"): None,
        ("x", "2024-05-06T10:00[UTC]"): "2024-05-06 10:00", ("x", "2024-05-06T10:00[Z]"): "2024-05-06 10:00", ("x", "2024-05-06T10:00[Japan]"): "2024-05-06 01:00", ("x", "2024-05-06T10:00[Nowhere]"): None,
        ("m", "2010-01-15 12:00 MSK"): "2010-01-15 09:00", ("m", "2012-06-01 12:00 MSK"): "2012-06-01 08:00", ("m", "2020-06-01 12:00 MSK"): "2020-06-01 09:00", ("m", "2008-07-01 12:00 MSD"): "2008-07-01 08:00",
        ("p", "2017-01-01 12:00 KST"): "2017-01-01 03:30", ("p", "2020-01-01 12:00 KST"): "2020-01-01 03:00", ("u", "2024-05-06 10:00 MSK"): None, ("u", "a|b 2024-05-06 10:00"): None,
    }
    rows = [(i, s, v) for i, (s, v) in enumerate(cases)]
    df = spark.createDataFrame(rows, "row_id long, src string, t string").selectExpr("*", "null as flight_date")
    got = {r[0]: r[2] for r in to_instants(df, ["t"], spark.createDataFrame(sources, "src string, tz_name string, date_order string"), ["row_id"]).collect()}
    epoch = datetime(1970, 1, 1)
    expected = {i: int((datetime.fromisoformat(u) - epoch).total_seconds()) * 10**6 for i, u in enumerate(cases.values()) if u}
    assert got == expected


def test_meanings_change_at_the_very_second():
    change = datetime(2014, 10, 26, 2, tzinfo=timezone.utc).timestamp()  # the local clock of Moscow on which it went back by an hour
    assert [meaning("Europe/Moscow", "msk", int(change) + s) for s in (-3 * 3600, 3 * 3600)] == [4 * 3600, 3 * 3600]
    assert meaning("Europe/Moscow", "EST", 0) is None
