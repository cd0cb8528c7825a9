"""SQL for DuckDB that reads the mixed timestamp texts: its own date parser and time zones, no table of ours."""

from __future__ import annotations


def clock(rel: str, key: str, name: str = "clk") -> str:
    """Common table expressions that end in ``name`` (k, us, status): the instant of each row of ``rel``
    in microseconds, null if its text names none, and how it was found. ``key`` is an expression on the row."""
    return rf"""t0 AS (SELECT {key} AS k, upper(trim(regexp_replace(timestamp, '\s+', ' ', 'g'))) AS t, coalesce(client_zone, 'UTC') AS zone FROM {rel} LEFT JOIN sessions USING (session_id)),
  t1 AS (SELECT *, regexp_full_match(t, '-?\d{{1,19}}(\.\d{{1,12}})?') AS num, regexp_replace(t, '\[[^\]]*\]$', '') AS u FROM t0),
  t2 AS (SELECT *, regexp_extract(u, '(?:\d|[AP]M) ?(Z|UTC|GMT|[A-LN-Z][A-Z]{{1,3}}|M[A-Z]{{2,3}}|(?:UTC|GMT)?[+-]\d{{1,2}}(?::?\d\d)?)$', 1) AS z FROM t1),
  t3 AS (SELECT *, CASE WHEN z ~ '^[A-Z]+$' AND z NOT IN ('AM', 'PM') OR z ~ '[+-]' AND (u ~ ':\d\d' OR u ~ 'T\d{{6}}') THEN z ELSE '' END AS zz FROM t2),
  t4 AS (SELECT *, trim(left(u, length(u) - length(zz))) AS w FROM t3),
  t5 AS (SELECT *, regexp_extract(w, ':\d\d[.,](\d{{1,9}})', 1) AS frac, try_strptime(regexp_replace(w, '(:\d\d)[.,]\d{{1,9}}', '\1'), ['%Y-%m-%dT%H:%M:%S', '%Y-%m-%d %H:%M:%S', '%Y-%m-%dT%H:%M', '%Y-%m-%d %H:%M', '%Y/%m/%d %H:%M:%S', '%Y%m%dT%H%M%S', '%b %d, %Y %I:%M:%S %p', '%m/%d/%Y %I:%M:%S %p', '%d.%m.%Y %H:%M:%S', '%d.%m.%Y, %H:%M', '%a, %d %b %Y %H:%M:%S', '%a %b %d %H:%M:%S %Y']) AS b,
    regexp_replace(zz, '^(UTC|GMT)([+-])', '\2') AS o FROM t4),
  t6 AS (SELECT *, epoch_us(b) + rpad(frac, 6, '0')[1:6]::BIGINT AS lus, CASE WHEN o ~ '^[+-]' THEN (CASE WHEN o[1] = '-' THEN -1 ELSE 1 END) * (regexp_extract(o, '(\d{{1,2}})', 1)::BIGINT * 60 + coalesce(try_cast(regexp_extract(o, '[+-]\d{{1,2}}:?(\d\d)$', 1) AS BIGINT), 0))
    ELSE MAP {{'Z': 0, 'UTC': 0, 'GMT': 0, 'EST': -300, 'EDT': -240, 'CST': -360, 'CDT': -300, 'MST': -420, 'MDT': -360, 'PST': -480, 'PDT': -420, 'BST': 60, 'CET': 60, 'CEST': 120, 'IST': 330, 'JST': 540, 'AEST': 600, 'AEDT': 660}}[o] END AS mins FROM t5),
  t7 AS (SELECT *, lus - (epoch_us((b - INTERVAL 1 DAY) AT TIME ZONE 'UTC' AT TIME ZONE zone) - epoch_us(b - INTERVAL 1 DAY)) AS u1, lus - (epoch_us((b + INTERVAL 1 DAY) AT TIME ZONE 'UTC' AT TIME ZONE zone) - epoch_us(b + INTERVAL 1 DAY)) AS u2 FROM t6),
  t8 AS (SELECT *, epoch_us(make_timestamp(u1) AT TIME ZONE 'UTC' AT TIME ZONE zone) = lus AS ok1, epoch_us(make_timestamp(u2) AT TIME ZONE 'UTC' AT TIME ZONE zone) = lus AS ok2, regexp_extract(t, '^-?0*(\d+)', 1) AS whole FROM t7),
  {name} AS (SELECT k, CASE WHEN num THEN trunc(t::DECIMAL(38, 12) * CASE WHEN length(whole) <= 11 THEN 1000000 WHEN length(whole) <= 14 THEN 1000 WHEN length(whole) <= 17 THEN 1 ELSE 0.001 END)::BIGINT
    WHEN zz <> '' THEN lus - mins * 60000000 WHEN ok1 AND ok2 THEN least(u1, u2) WHEN ok2 THEN u2 ELSE u1 END AS us,
    CASE WHEN NOT num AND (lus IS NULL OR zz <> '' AND mins IS NULL) OR t IS NULL THEN 'none' WHEN num OR zz <> '' THEN 'exact' WHEN ok1 AND ok2 AND u1 <> u2 THEN 'ambiguous' WHEN NOT ok1 AND NOT ok2 THEN 'nonexistent' ELSE 'exact' END AS status FROM t8)"""
