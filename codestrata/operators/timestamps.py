"""Mixed timestamp texts to one instant in UTC.

Texts are parsed by built-in expressions into a local wall-clock time and, if
the text has one, an offset. Texts without an offset take the zone of their
session. Zones become intervals of constant offset, exploded by the years that
occur; each local time meets the intervals of its (zone, year) in one equi-join
and the matching intervals decide:

* one matches: its offset holds (``status = 'exact'``),
* two match: the local time occurs twice; the first occurrence is taken
  (``'ambiguous'``),
* none matches: the local time was skipped; the offset before the change is
  used (``'nonexistent'``).

Defined results for odd inputs: null, empty and unparsable texts and dates or
times that do not exist (month 13, 30 February, hour 24, second 60) give a null
instant with ``status = 'none'``; an unknown zone name counts as UTC; digits
finer than microseconds are cut off; bare numbers count from 1970 in seconds,
milliseconds, microseconds or nanoseconds by their magnitude. Rows are never
dropped or merged, so repeated rows stay repeated. The helper columns have the
prefix ``__ts_`` so that columns of the input keep their names and values.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone, tzinfo
from functools import lru_cache
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Offsets in minutes of zone abbreviations (RFC 2822 and common usage).
ABBREVIATIONS = {
    "Z": 0, "UT": 0, "UTC": 0, "GMT": 0, "WET": 0,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "AKST": -540, "AKDT": -480, "HST": -600, "BRT": -180, "BRST": -120, "ART": -180,
    "BST": 60, "WEST": 60, "CET": 60, "MEZ": 60, "CEST": 120, "MESZ": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "IST": 330, "NPT": 345, "JST": 540, "KST": 540, "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660,
    "NZST": 720, "NZDT": 780,
}
MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]

_ZONE = r"(Z|[A-Z]{2,4}|(?:UTC|GMT)?[+-]\d{1,2}(?::?\d{2})?)?(?:\[[^\]]*\])?"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_DAY = r"(?:MON|TUE|WED|THU|FRI|SAT|SUN)[A-Z]*"
_MON = r"(JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)[A-Z]*"

#: name -> (pattern on the upper-cased text, groups of y, mo, d, h, mi, s, fraction, am/pm, zone; 0 for none).
FORMATS: dict[str, tuple[str, tuple[int, ...]]] = {
    "ymd": (rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})[T ,]+{_CLOCK} ?([AP]M)? ?{_ZONE}$", (1, 2, 3, 4, 5, 6, 7, 8, 9)),
    "compact": (rf"^(\d{{4}})(\d{{2}})(\d{{2}})[T ]?(\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d{{1,9}}))?)? ?{_ZONE}$", (1, 2, 3, 4, 5, 6, 7, 0, 8)),
    "dmy": (rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}),? +{_CLOCK} ?([AP]M)? ?{_ZONE}$", (3, 2, 1, 4, 5, 6, 7, 8, 9)),
    "mdy": (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}),? +{_CLOCK} ?([AP]M)? ?{_ZONE}$", (3, 1, 2, 4, 5, 6, 7, 8, 9)),
    "rfc": (rf"^(?:{_DAY},? )?(\d{{1,2}})[ -]{_MON}[ -](\d{{4}}),? +{_CLOCK} ?([AP]M)? ?{_ZONE}$", (3, 2, 1, 4, 5, 6, 7, 8, 9)),
    "ctime": (rf"^(?:{_DAY},? )?{_MON} +(\d{{1,2}}) {_CLOCK} (?:{_ZONE} )?(\d{{4}})$", (8, 1, 2, 3, 4, 5, 6, 0, 7)),
    "long": (rf"^(?:{_DAY},? )?{_MON} (\d{{1,2}}),? (\d{{4}}),? +(?:AT )?{_CLOCK} ?([AP]M)? ?{_ZONE}$", (3, 1, 2, 4, 5, 6, 7, 8, 9)),
}
_NUMBER = r"^(-?)(\d{1,19})(?:\.(\d{1,12}))?$"
#: Before the first of these years every zone keeps its first offset; after the last one the
#: calendar and the rules in force repeat every 400 years. So the table of intervals is
#: bounded (IANA zones x 701 years) and any year has its place in it.
FIRST_YEAR, LAST_YEAR = 1800, 2500
_CYCLE_US = 146_097 * 86_400_000_000


def _clean(text: Column) -> Column:
    t = F.regexp_replace(text, r"[\s  ​﻿]+", " ")
    return F.upper(F.trim(t))


def _once(x: Column, fn) -> Column:  # noqa: ANN001
    """``fn(x)`` with ``x`` evaluated once. Higher-order functions stay out of
    whole-stage code generation; the long pattern chains would exceed the size
    of one generated method."""
    return F.transform(F.array(x), fn)[0]


def _number(t: Column) -> Column:
    """Microseconds of a bare number; its magnitude tells the unit."""
    whole = F.regexp_extract(t, _NUMBER, 2)
    frac = F.regexp_extract(t, _NUMBER, 3)
    digits = F.length(F.regexp_replace(whole, "^0+", ""))
    power = F.when(digits <= 11, 6).when(digits <= 14, 3).when(digits <= 17, 0).otherwise(-3)
    # the fraction's digits move in front of the point, so no floating point is involved
    s = F.struct(whole.alias("w"), frac.alias("f"), power.alias("p"))
    out = F.transform(
        F.array(s),
        lambda x: F.when(x["p"] < 0, F.substring(x["w"], F.lit(1), F.length(x["w"]) - 3).try_cast("bigint")).otherwise(
            F.concat(x["w"], F.substring(F.rpad(x["f"], 12, "0"), F.lit(1), x["p"])).try_cast("bigint")
        ),
    )[0]
    return F.when(F.regexp_extract(t, _NUMBER, 1) == "-", -out).otherwise(out)


def _canonical(t: Column) -> Column:
    """``y|mo|d|h|mi|s|fraction|am/pm|zone`` of the first format that fits, else null."""
    out = F.lit(None).cast("string")
    for pattern, groups in reversed(list(FORMATS.values())):
        out = F.when(t.rlike(pattern), F.regexp_replace(t, pattern, "|".join(f"${g}" if g else "" for g in groups))).otherwise(out)
    return out


def parse(df: DataFrame, column: str) -> DataFrame:
    """Add ``__ts_num`` (instant of a bare number), ``__ts_local`` (wall-clock
    microseconds as if UTC) and ``__ts_off`` (offset in minutes, null if none)."""
    t = F.col("__ts_t")
    df = df.withColumn("__ts_t", _clean(F.col(f"`{column}`")))
    df = df.withColumn("__ts_r", _once(t, lambda x: F.split(F.when(~x.rlike(_NUMBER), _canonical(x)), "[|]")))
    raw = {k: F.col("__ts_r")[i] for i, k in enumerate(("y", "mo", "d", "h", "mi", "s", "frac", "ap", "zone"))}
    n = lambda k: raw[k].try_cast("int")
    month = F.coalesce(n("mo"), F.array_position(F.array(*[F.lit(m) for m in MONTHS]), raw["mo"]).cast("int"))
    hour = F.when(raw["ap"] == "", n("h")).when(n("h").between(1, 12), n("h") % 12 + F.when(raw["ap"] == "PM", 12).otherwise(0))
    df = df.withColumns({"__ts_mo": month, "__ts_h": hour, "__ts_s": F.coalesce(n("s"), F.lit(0)), "__ts_z": F.regexp_replace(raw["zone"], r"^(UTC|GMT)(?=[+-])", "")})
    date = F.expr("try_to_date(concat(__ts_r[0], '-', lpad(cast(__ts_mo as string), 2, '0'), '-', lpad(__ts_r[2], 2, '0')), 'yyyy-MM-dd')")
    h, sec, zone = F.col("__ts_h"), F.col("__ts_s"), F.col("__ts_z")
    fits = h.between(0, 23) & n("mi").between(0, 59) & sec.between(0, 59) & (n("y") > 0)
    clock = F.unix_date(date).cast("bigint") * 86400 + h * 3600 + n("mi") * 60 + sec
    local = F.when(fits, clock * 1000000 + F.substring(F.rpad(raw["frac"], 6, "0"), 1, 6).cast("bigint"))
    abbr = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])

    def minutes(z: Column) -> Column:
        oh = F.regexp_extract(z, r"^[+-](\d{1,2})", 1).try_cast("int")
        om = F.coalesce(F.regexp_extract(z, r"^[+-]\d{1,2}:?(\d{2})$", 1).try_cast("int"), F.lit(0))
        signed = F.when(z.startswith("-"), -1).otherwise(1) * (oh * 60 + om)
        return F.when(z.rlike(r"^[+-]"), F.when((oh <= 18) & (om <= 59), signed)).when(z != "", F.try_element_at(abbr, z))

    off = _once(zone, minutes)
    df = df.withColumns({"__ts_num": F.when(t.rlike(_NUMBER), _number(t)), "__ts_off": off.cast("int"), "__ts_local": local})
    df = df.withColumn("__ts_local", F.when((zone == "") | F.col("__ts_off").isNotNull(), F.col("__ts_local")))
    return df.drop("__ts_t", "__ts_r", "__ts_mo", "__ts_h", "__ts_s", "__ts_z")


@lru_cache(maxsize=1024)
def _zone(name: str) -> tzinfo:
    try:
        return ZoneInfo(name)
    except Exception:  # no such zone
        return timezone.utc


def zone_intervals(name: str, year: int) -> list[tuple[int, int, int]]:
    """(start, end, offset) in seconds of UTC of the intervals that touch a local year; the outer ends are open."""
    zone = _zone(name)
    epoch = datetime(1970, 1, 1, tzinfo=timezone.utc)
    off = lambda s: int((epoch + timedelta(seconds=s)).astimezone(zone).utcoffset().total_seconds())
    lo, hi = (int((datetime(y, 1, 1, tzinfo=timezone.utc) - epoch).total_seconds()) + d * 86400 for y, d in ((year, -2), (year + 1, 2)))
    cuts, cur = [], off(lo)
    for at in range(lo, hi, 86400):
        nxt = at + 86400
        while (o := off(nxt)) != cur:
            a, b = at, nxt  # the change lies in (a, b]
            while b - a > 1:
                m = (a + b) // 2
                a, b = (m, b) if off(m) == cur else (a, m)
            o = off(b)
            cuts.append((b, cur, o))
            cur, at = o, b
    big = 1 << 42
    out, start, o = [], -big, cuts[0][1] if cuts else cur
    for when, before, after in cuts:
        out.append((start, when, before))
        start, o = when, after
    return [*out, (start, big, o)]


def offset_intervals(zones: DataFrame) -> DataFrame:
    """(zone, year) -> array of the intervals that touch that local year.

    ``zones`` has the columns ``zone`` and ``year``, each pair once. ``reach`` is where
    the interval ends or, before a gap, where the gap ends.
    """

    def gen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, year in zip(pdf["zone"], pdf["year"], strict=True):
                iv = zone_intervals(name, int(year))
                us = lambda s: s * 10**6
                reach = [max(e + o, e + iv[i + 1][2]) if i + 1 < len(iv) else e + o for i, (_, e, o) in enumerate(iv)]
                rows.append((name, year, [{"start": us(s + o), "end": us(e + o), "reach": us(r), "off": o} for (s, e, o), r in zip(iv, reach, strict=True)]))
            yield pd.DataFrame(rows, columns=["zone", "year", "iv"])

    return zones.mapInPandas(gen, "zone string, year int, iv array<struct<start:bigint,end:bigint,reach:bigint,off:int>>")


def normalise(df: DataFrame, column: str, zone: str | None = None) -> DataFrame:
    """Add ``utc_us`` (bigint, microseconds since 1970) and ``status``.

    ``zone`` names a column with the IANA zone of texts that carry none; null
    means UTC. Existing columns ``utc_us`` and ``status`` are replaced.
    """
    df = parse(df, column).withColumn("__ts_zone", F.coalesce(F.col(f"`{zone}`") if zone else F.lit(None).cast("string"), F.lit("UTC")))
    year = F.year(F.timestamp_micros("__ts_local"))
    cycles = F.when(year > LAST_YEAR, F.ceil((year - LAST_YEAR) / 400.0)).otherwise(0)
    need = F.col("__ts_local").isNotNull() & F.col("__ts_off").isNull()
    df = df.withColumns({
        "__ts_key": F.when(need, F.col("__ts_zone")),
        "__ts_year": F.when(need, F.greatest(year - 400 * cycles, F.lit(FIRST_YEAR)).cast("int")),
        "__ts_loc": F.col("__ts_local") - cycles * _CYCLE_US,
    })
    zones = df.select(F.col("__ts_key").alias("zone"), F.col("__ts_year").alias("year")).where("zone is not null").distinct()
    iv = offset_intervals(zones).select(F.col("zone").alias("__ts_key"), F.col("year").alias("__ts_year"), F.col("iv").alias("__ts_iv"))
    # bounded by zones x years of the cycle (about 600 x 701 short arrays), whatever the number of rows
    df = df.join(F.broadcast(iv), ["__ts_key", "__ts_year"], "left")
    loc = F.col("__ts_loc")
    hit = F.filter("__ts_iv", lambda x: (loc >= x["start"]) & (loc < x["end"]))
    prev = F.filter("__ts_iv", lambda x: (loc >= x["start"]) & (loc < x["reach"]))
    df = df.withColumns({"__ts_hit": hit, "__ts_prev": prev})
    first = F.array_max(F.transform(F.when(F.size("__ts_hit") > 0, F.col("__ts_hit")).otherwise(F.col("__ts_prev")), lambda x: x["off"]))
    off = F.coalesce(F.col("__ts_off").cast("bigint") * 60, first.cast("bigint"))
    utc = F.coalesce("__ts_num", F.col("__ts_local") - off * 1000000)
    status = (
        F.when(utc.isNull(), "none")
        .when(F.col("__ts_num").isNotNull() | F.col("__ts_off").isNotNull(), "exact")
        .when(F.size("__ts_hit") > 1, "ambiguous")
        .when(F.size("__ts_hit") == 0, "nonexistent")
        .otherwise("exact")
    )
    return df.withColumns({"utc_us": utc, "status": status}).drop(*[c for c in df.columns if c.startswith("__ts_")])


def found(code_memory: DataFrame, code_change: DataFrame, sessions: DataFrame) -> DataFrame:
    """(rel, row_id, utc_us) of every row whose text names an existing time."""
    rows = code_memory.select(F.lit("code_memory").alias("rel"), F.col("id").cast("string").alias("row_id"), "timestamp", "session_id").unionByName(
        code_change.select(F.lit("code_change").alias("rel"), F.col("change_id").cast("string").alias("row_id"), "timestamp", "session_id")
    )
    return normalise(with_zone(rows, sessions), "timestamp", "client_zone").where("utc_us is not null").select("rel", "row_id", "utc_us")


def with_zone(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """Rows with the ``client_zone`` of their session. Null keys would pile up in one task of the
    join: each gets a key of its own text's hash, which no session has."""
    own = F.coalesce("session_id", F.concat(F.lit("\0"), F.xxhash64("timestamp").cast("string")))
    zones = sessions.where("session_id is not null").select(F.col("session_id").alias("__ts_session"), "client_zone")
    return rows.withColumn("__ts_session", own).join(zones, "__ts_session", "left").drop("__ts_session")


def timed(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """Rows (timestamp, session_id, ...) with ``at_us``, their instant: what everything that orders or
    compares by time uses instead of the text."""
    return normalise(with_zone(rows, sessions), "timestamp", "client_zone").withColumnRenamed("utc_us", "at_us").drop("status", "client_zone")
