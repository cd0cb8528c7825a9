"""Timestamps against zoneinfo, and defined results for odd inputs."""

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest

from codestrata.operators import timestamps as T

UTC = timezone.utc


def us(*a):
    return int((datetime(*a, tzinfo=UTC) - datetime(1970, 1, 1, tzinfo=UTC)) / timedelta(microseconds=1))


CASES = [
    ("2024-01-02T03:04:05Z", None, us(2024, 1, 2, 3, 4, 5)),
    ("2024-01-02t03:04:05.123456789z", None, us(2024, 1, 2, 3, 4, 5, 123456)),
    ("2024-01-02 03:04:05,7", None, us(2024, 1, 2, 3, 4, 5, 700000)),
    ("2024-01-02T03:04Z", None, us(2024, 1, 2, 3, 4)),
    ("2024-01-02T03:04:05+05:30", None, us(2024, 1, 1, 21, 34, 5)),
    ("2024-01-02 03:04:05 -0800", None, us(2024, 1, 2, 11, 4, 5)),
    ("2024-01-02T03:04:05+11", None, us(2024, 1, 1, 16, 4, 5)),
    ("2024-01-02T03:04:05.1-05:00[America/New_York]", None, us(2024, 1, 2, 8, 4, 5, 100000)),
    ("20240102T030405Z", None, us(2024, 1, 2, 3, 4, 5)),
    ("1/2/2024 12:04:05 AM", None, us(2024, 1, 2, 0, 4, 5)),
    ("1/2/2024 12:04:05 PM", None, us(2024, 1, 2, 12, 4, 5)),
    ("02.01.2024, 03:04", None, us(2024, 1, 2, 3, 4)),
    ("Tue, 02 Jan 2024 03:04:05 GMT", None, us(2024, 1, 2, 3, 4, 5)),
    ("Tue, 02 Jan 2024 03:04:05 -0400", None, us(2024, 1, 2, 7, 4, 5)),
    ("Tue Jan  2 03:04:05 2024", "Asia/Tokyo", us(2024, 1, 1, 18, 4, 5)),
    ("Jan 2, 2024 3:04:05 pm", "Europe/Berlin", us(2024, 1, 2, 14, 4, 5)),
    ("2024/01/02 03:04:05", "Asia/Kathmandu", us(2024, 1, 1, 21, 19, 5)),
    ("2024-01-02 03:04:05 JST", None, us(2024, 1, 1, 18, 4, 5)),
    (" \t2024-01-02T03:04:05Z\n", None, us(2024, 1, 2, 3, 4, 5)),
    ("1704164645", None, 1704164645 * 10**6),
    ("1704164645123", None, 1704164645123000),
    ("1704164645123456", None, 1704164645123456),
    ("1704164645.1234567", None, 1704164645123456),
    ("2024-02-29 10:00:00", "Nowhere/Land", us(2024, 2, 29, 10)),
    *[(x, None, None) for x in (None, "", "-", "unknown", "null", "N/A", "2024-13-04 08:00:00", "2025-02-29T10:11:12Z", "2025-06-31 25:61:00", "0000-00-00 00:00:00", "T12:30:00Z", "yesterday 14:05", "2024-01-02T24:00:00Z", "2024-01-02 03:04:60", "13/13/2024 1:00:00 PM", "2024-01-02 03:04:05 XYZ")],
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, t, z, "mine") for i, (t, z, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, timestamp string, zone string, status string")
    return {r.i: r for r in T.normalise(df, "timestamp", "zone").collect()}


@pytest.mark.parametrize("i", range(len(CASES)), ids=[repr(c[0]) for c in CASES])
def test_formats(found, i):
    assert found[i].utc_us == CASES[i][2]
    assert (found[i].status == "none") == (CASES[i][2] is None)


def test_changes_of_the_clock(spark):
    zones = ["America/New_York", "Europe/London", "Australia/Sydney", "America/Sao_Paulo", "Asia/Kolkata", "Pacific/Apia", "Africa/Casablanca"]
    rows, want = [], {}
    for zone in zones:
        z = ZoneInfo(zone)
        for year in (1801, 1885, 1901, 1965, 1972, 2011, 2024, 2025, 2087, 2150, 2500, 2501, 9990):
            for month in (3, 4, 10, 11, 12):
                for day in range(1, 32, 3):
                    for hour in (0, 1, 2, 3, 12):
                        try:
                            local = datetime(year, month, day, hour, 30)
                        except ValueError:
                            continue
                        key = f"{zone}|{local:%Y-%m-%d %H:%M:%S}"
                        rows.append((key, f"{local:%Y-%m-%d %H:%M:%S}", zone))
                        # fold=0: first occurrence; in a gap the offset before the change
                        off = local.replace(tzinfo=z, fold=0).utcoffset()
                        want[key] = int((local - off - datetime(1970, 1, 1)) / timedelta(microseconds=1))
    got = T.normalise(spark.createDataFrame(rows, "k string, t string, z string"), "t", "z").collect()
    assert {r.k: r.utc_us for r in got} == want
    status = {r.k: r.status for r in got}
    df = spark.createDataFrame([("a", "2024-03-10 02:30:00"), ("b", "2024-11-03 01:30:00")], "k string, t string").selectExpr("k", "t", "'America/New_York' as z")
    assert {r.k: r.status for r in T.normalise(df, "t", "z").collect()} == {"a": "nonexistent", "b": "ambiguous"}
    assert set(status.values()) <= {"exact", "ambiguous", "nonexistent"}


def test_relations(spark):
    cm = spark.createDataFrame([("a", "2024-07-01 10:00:00", "s1", 1), ("b", "2024-07-01 10:00:00", None, 1), ("c", None, "s1", 1), ("a", "2024-07-01 10:00:00", "s1", 1)], "id string, timestamp string, session_id string, utc_us int")
    cc = spark.createDataFrame([(7, "2024-07-01 10:00:00", "s2"), (8, "2024-07-01 10:00:00", "unknown")], "change_id bigint, timestamp string, session_id string")
    ss = spark.createDataFrame([("s1", "Europe/Berlin"), ("s2", None)], "session_id string, client_zone string")
    got = sorted(map(tuple, T.found(cm, cc, ss).collect()))
    ten, eight = us(2024, 7, 1, 10), us(2024, 7, 1, 8)
    assert got == [("code_change", "7", ten), ("code_change", "8", ten), ("code_memory", "a", eight), ("code_memory", "a", eight), ("code_memory", "b", ten)]
    assert T.found(cm.limit(0), cc.limit(0), ss.limit(0)).count() == 0
