"""DuckDB SQL for each registered query, over the driver's raw tables.

The fixture views of ``millrun.sources.fixtures`` are restated as CTEs, then
each query's semantics are written independently in plain SQL (window
``lead``, ``generate_series`` for the fill, ``CASE`` chains for buckets).
Parameters come from ``millrun.plans.params`` so both sides use one source.
"""

from __future__ import annotations

import json

from millrun.plans import params as P
from millrun.sources import fixtures as FX
from millrun.sources import registry as R

ORACLE: dict[str, str] = {}


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _ts(s: str) -> str:
    return f"TIMESTAMP {_q(s)}"


def _list(xs) -> str:
    return ", ".join(_q(x) for x in xs)


HOLIDAY_SQL = ", ".join(f"DATE {_q(d.isoformat())}" for d in FX.holidays())

READINGS = f"""readings AS (
  SELECT 'EVT' AS plant, CAST(user_id % 8 AS INTEGER) AS TagIndex,
         date_trunc('milliseconds', ts) AS DateAndTime, value AS Val,
         CASE event_id % 50 WHEN 0 THEN 'E' WHEN 1 THEN 'U' WHEN 2 THEN 'S'
              WHEN 3 THEN NULL ELSE 'G' END AS Status,
         event_id AS seq
  FROM events)"""

TAGS = """tags AS (
  SELECT 'EVT' AS plant, CAST(i AS INTEGER) AS TagIndex, 'TAG_' || CAST(i AS VARCHAR) AS TagName
  FROM range(7) r(i))"""

REQUEST = f"""request AS (
  SELECT plant, TagIndex FROM tags UNION SELECT 'EVT', CAST({P.UNKNOWN_TAG} AS INTEGER))"""


def window_cte(name="w", tbf=P.TBF, taf=P.TAF, bad=P.BAD, known=True) -> str:
    semi = "AND (plant, TagIndex) IN (SELECT plant, TagIndex FROM tags)" if known else ""
    return f"""{name} AS (
  SELECT * FROM readings
  WHERE DateAndTime BETWEEN {_ts(tbf)} AND {_ts(taf)}
    AND Status IS NOT NULL AND Status NOT IN ({_list(bad)}) {semi})"""


def filled_ctes(src="w", cadence=P.CADENCE_S, cap=P.CAP_S, tol=P.TOLERANCE,
                series="plant, TagIndex", cad_expr=None, enabled=None) -> str:
    """succ -> cls -> filled: lead, classify, explode the bridged gaps."""
    cad = cad_expr or f"CAST({cadence} AS DOUBLE)"
    off = f"nts IS NULL OR NOT ({enabled})" if enabled else "nts IS NULL"
    return f"""succ AS (
  SELECT *, lead(DateAndTime) OVER win AS nts, lead(Val) OVER win AS nval
  FROM {src} WINDOW win AS (PARTITION BY {series} ORDER BY DateAndTime, seq)),
cls0 AS (
  SELECT *, {cad} * 1000.0 AS cad_ms, CAST({cap} AS DOUBLE) * 1000.0 AS cap_ms,
         epoch_ms(nts) - epoch_ms(DateAndTime) AS gap_ms
  FROM succ),
cls AS (
  SELECT *, CASE WHEN {off} THEN NULL
                 WHEN gap_ms <= cad_ms * 1.5 THEN 'normal'
                 WHEN gap_ms <= cap_ms
                      AND abs(Val - nval) / greatest(abs(Val), abs(nval), 1e-6) <= {tol}
                      THEN 'bridged'
                 WHEN gap_ms > cap_ms THEN 'exceeds cap'
                 ELSE 'value mismatch across gap' END AS gap_kind
  FROM cls0),
filled AS (
  SELECT * EXCLUDE (DateAndTime, k),
         DateAndTime + to_milliseconds(CAST(trunc(k * cad_ms) AS BIGINT)) AS DateAndTime,
         k > 0 AS Filled,
         CASE WHEN k > 0 THEN NULL ELSE gap_kind END AS fkind,
         CASE WHEN k > 0 THEN NULL ELSE gap_ms END AS fgap_ms
  FROM (SELECT *, unnest(generate_series(0, CASE WHEN gap_kind = 'bridged'
                         THEN CAST(ceil(gap_ms / cad_ms) AS BIGINT) - 1 ELSE 0 END)) AS k
        FROM cls))"""


BUCKET = f"""CASE WHEN (CAST(DateAndTime AS DATE) IN ({HOLIDAY_SQL}) OR dayofweek(DateAndTime) IN (0, 6))
     THEN CASE WHEN hour(DateAndTime) * 3600 + minute(DateAndTime) * 60 + second(DateAndTime)
                    BETWEEN {R.HOLIDAY_DAY_START_S} AND {R.HOLIDAY_DAY_END_S} THEN 'C' ELSE 'D' END
     ELSE CASE WHEN hour(DateAndTime) * 3600 + minute(DateAndTime) * 60 + second(DateAndTime)
                    BETWEEN {R.WORKDAY_PEAK_START_S} AND {R.WORKDAY_PEAK_END_S} THEN 'A' ELSE 'B' END END"""

FLAGGED = "fkind IN ('exceeds cap', 'value mismatch across gap')"


def _run_hours_sql(select: str, pph=P.POINTS_PER_HOUR, thr=P.THRESHOLD) -> str:
    return f"""WITH {READINGS}, {TAGS}, {REQUEST}, {window_cte()}, {filled_ctes()},
b AS (SELECT *, {BUCKET} AS bucket, Val > {thr} AS hit FROM filled),
agg AS (
  SELECT plant, TagIndex, count_if(hit) AS n,
         count_if(hit AND bucket = 'A') AS nA, count_if(hit AND bucket = 'B') AS nB,
         count_if(hit AND bucket = 'C') AS nC, count_if(hit AND bucket = 'D') AS nD,
         count_if(NOT Filled) AS realReadings, count_if(Filled) AS filledReadings,
         count_if({FLAGGED}) AS flaggedGaps,
         coalesce(sum(CASE WHEN {FLAGGED} THEN fgap_ms END), 0) / 1000.0 AS flagged_s,
         count(*) AS nrows
  FROM b GROUP BY plant, TagIndex),
res AS (
  SELECT q.plant, q.TagIndex,
         CASE WHEN coalesce(a.nrows, 0) > 0 THEN t.TagName END AS tagName,
         {_q(P.TBF)} AS date_before, {_q(P.TAF)} AS date_after,
         coalesce(a.n, 0) AS "count", coalesce(a.n / {pph}, 0.0) AS hour,
         coalesce(a.nA / {pph}, 0.0) AS A, coalesce(a.nB / {pph}, 0.0) AS B,
         coalesce(a.nC / {pph}, 0.0) AS C, coalesce(a.nD / {pph}, 0.0) AS D,
         coalesce(a.n / {pph}, 0.0) AS total,
         coalesce(a.realReadings, 0) AS realReadings, coalesce(a.filledReadings, 0) AS filledReadings,
         coalesce(a.flaggedGaps, 0) AS flaggedGaps, coalesce(a.flagged_s, 0.0) AS flagged_s
  FROM request q LEFT JOIN tags t USING (plant, TagIndex) LEFT JOIN agg a USING (plant, TagIndex))
SELECT {select} FROM res"""


ORACLE["run_hours"] = _run_hours_sql(
    'plant, TagIndex, tagName, date_before, date_after, "count", hour, '
    "realReadings, filledReadings, flaggedGaps, flagged_s")
ORACLE["tariff_hours"] = _run_hours_sql("plant, TagIndex, tagName, A, B, C, D, total")


# ------------------------------------------------------------ more views

WL_TAG_ROWS = ", ".join(
    f"({i + 1}, {_q(n)})" for i, n in enumerate([t for t, _ in R.WEIGHING_TAGS] + FX.WEIGHING_OTHER_TAGS))

WL = f"""wl_readings AS (
  SELECT 'WL' AS plant, CAST(l.l_linenumber AS INTEGER) AS TagIndex,
         o.o_orderdate + to_seconds(o.o_orderkey) AS DateAndTime,
         CASE WHEN max(l.l_quantity) <= 5 THEN CAST(0 AS DOUBLE) ELSE max(l.l_quantity) END AS Val,
         'G' AS Status, o.o_orderkey AS seq
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  GROUP BY o.o_orderdate, o.o_orderkey, l.l_linenumber),
wl_tags AS (
  SELECT 'WL' AS plant, CAST(i AS INTEGER) AS TagIndex, n AS TagName FROM (VALUES {WL_TAG_ROWS}) v(i, n))"""

PLANT_ROWS = ", ".join(f"({_q(p)}, {_q(d)})" for p, d in
                       list(R.PLANT_DESCRIPTIONS) + [(FX.READINGS_PLANT, "Synthetic event plant")])

ALARMS = f"""alarms AS (
  SELECT CAST(event_id AS VARCHAR) AS EventID,
         date_trunc('milliseconds', ts) AS EventTimeStamp,
         (epoch_us(ts) + {R.FILETIME_EPOCH_OFFSET_MS * 1000}) * 10 AS TicksTimeStamp,
         'SRC_' || CAST(user_id % 40 AS VARCHAR) AS SourceName,
         CASE event_type WHEN 'error' THEN 'TRIP' WHEN 'signup' THEN 'TRIP_L'
              WHEN 'purchase' THEN 'HI' WHEN 'click' THEN 'LO' ELSE 'EVENT' END AS ConditionName,
         CASE event_type WHEN 'error' THEN 'TRIP' WHEN 'signup' THEN 'TRIP_L'
              WHEN 'purchase' THEN 'HI' WHEN 'click' THEN 'LO' ELSE 'EVENT' END AS SubConditionName,
         CASE event_id % 10 WHEN 0 THEN 'Alarm fault: quality is bad' WHEN 1 THEN NULL
              WHEN 2 THEN 'Input quality is bad' ELSE 'Event ' || event_type END AS Message,
         'Area ' || CAST(user_id % 4 AS VARCHAR) || '.Alarm_Main' AS GroupPath,
         CAST(floor(value) AS INTEGER) AS Severity, CAST(event_id % 5 AS INTEGER) AS Priority,
         value AS InputValue,
         CAST(CASE WHEN event_id % 4 = 0 THEN NULL ELSE 100 END AS DOUBLE) AS LimitValue,
         event_id % 3 <> 0 AS Active, event_id % 2 = 0 AS Acked
  FROM events)"""

GOOD = lambda bad=P.BAD: f"Status IS NOT NULL AND Status NOT IN ({_list(bad)})"


def _win(tbf, taf) -> str:
    return f"DateAndTime BETWEEN {_ts(tbf)} AND {_ts(taf)}"


def _big(expr: str) -> str:
    """A double as an exact integer of 2**-60."""
    return f"CAST(({expr}) * {float(2 ** 60)!r} AS HUGEINT)"


def _r2(expr: str) -> str:
    """Two decimals by the binary value; an exact tie goes up (values are not negative)."""
    return f"(CAST(({_big(expr)} * 100 + {2 ** 59}) // {2 ** 60} AS DOUBLE) / 100.0)"


def _sum(expr: str) -> str:
    """The exact sum of doubles, rounded once (the text of an integer is parsed to the nearest double)."""
    return f"(CAST(CAST(sum({_big(expr)}) AS VARCHAR) AS DOUBLE) / {float(2 ** 60)!r})"


def _d(expr: str) -> str:
    return f"CAST({expr} AS DOUBLE)"


# ------------------------------------------------------ catalogue, listings

ORACLE["tag_catalog"] = f"""WITH {WL},
evt AS (SELECT DISTINCT CAST(user_id % 8 AS INTEGER) AS TagIndex FROM events),
tags_all AS (
  SELECT 'EVT' AS plant, TagIndex, 'TAG_' || CAST(TagIndex AS VARCHAR) AS TagName FROM evt WHERE TagIndex < 7
  UNION ALL
  SELECT plant, TagIndex, TagName FROM wl_tags
  WHERE TagIndex IN (SELECT DISTINCT CAST(l_linenumber AS INTEGER) FROM lineitem)),
plants AS (SELECT * FROM (VALUES {PLANT_ROWS}) v(plant, description))
SELECT t.plant, p.description, t.TagIndex, t.TagName FROM tags_all t JOIN plants p USING (plant)"""


def _listing(src, tags, tbf, taf, bad=P.BAD):
    return f"""SELECT r.plant, r.DateAndTime, r.Val, r.TagIndex, t.TagName
FROM {src} r JOIN {tags} t ON r.plant = t.plant AND r.TagIndex = t.TagIndex
WHERE r.DateAndTime BETWEEN {_ts(tbf)} AND {_ts(taf)} AND r.Status IS NOT NULL
  AND r.Status NOT IN ({_list(bad)})"""


ORACLE["readings_window"] = f"WITH {READINGS}, {TAGS} " + _listing("readings", "tags", P.TBF, P.TAF)
ORACLE["counter_window"] = f"WITH {READINGS}, {TAGS} " + _listing(
    "readings", "tags", P.TBF, P.TAF, P.COUNTER_BAD)
ORACLE["readings_window_asc"] = f"WITH {WL} " + _listing("wl_readings", "wl_tags", P.WL_TBF, P.WL_TAF)
ORACLE["readings_long"] = f"""WITH {WL}
SELECT r.plant, r.DateAndTime, t.TagName, r.Val
FROM wl_readings r JOIN wl_tags t ON r.plant = t.plant AND r.TagIndex = t.TagIndex
WHERE r.DateAndTime BETWEEN {_ts(P.WL_TBF)} AND {_ts(P.WL_TAF)} AND {GOOD()}"""

ORACLE["readings_newest"] = f"""WITH {READINGS}, {TAGS}
SELECT plant, DateAndTime, Val, TagIndex, TagName FROM (
  SELECT r.*, t.TagName,
         row_number() OVER (PARTITION BY r.plant ORDER BY r.DateAndTime DESC, r.seq DESC) AS rn
  FROM readings r JOIN tags t ON r.plant = t.plant AND r.TagIndex = t.TagIndex
  WHERE r.Status IS NOT NULL AND r.Status NOT IN ({_list(P.BAD)}))
WHERE rn <= {R.NEWEST_READINGS}"""

ORACLE["readings_latest_per_tag"] = f"""WITH {READINGS}, {TAGS}
SELECT plant, DateAndTime, Val, TagIndex, TagName FROM (
  SELECT r.*, t.TagName,
         row_number() OVER (PARTITION BY r.plant, r.TagIndex ORDER BY r.DateAndTime DESC, r.seq DESC) AS rn
  FROM readings r JOIN tags t ON r.plant = t.plant AND r.TagIndex = t.TagIndex
  WHERE r.Status IS NOT NULL AND r.Status NOT IN ({_list(P.BAD)}))
WHERE rn = 1"""

# --------------------------------------------------------------- statistics

_ECHO = f"{_q(P.TBF)} AS date_before, {_q(P.TAF)} AS date_after"

ORACLE["window_stats"] = f"""WITH {READINGS}, {TAGS}, {REQUEST}, {window_cte()},
agg AS (SELECT plant, TagIndex, min(Val) AS minVal, max(Val) AS maxVal, {_sum('Val')} / count(Val) AS avgVal,
               count(*) AS n FROM w GROUP BY plant, TagIndex)
SELECT q.plant, q.TagIndex, CASE WHEN coalesce(a.n, 0) > 0 THEN t.TagName END AS tagName, {_ECHO},
       a.maxVal, a.minVal, a.avgVal, coalesce(a.n, 0) AS n
FROM request q LEFT JOIN tags t USING (plant, TagIndex) LEFT JOIN agg a USING (plant, TagIndex)"""

ORACLE["capacity_total"] = f"""WITH {READINGS}, {TAGS}, {REQUEST}, {window_cte()},
agg AS (SELECT plant, TagIndex, min(Val) AS minVal, max(Val) AS maxVal, {_sum('Val')} AS s,
               count(*) AS n FROM w GROUP BY plant, TagIndex)
SELECT q.plant, q.TagIndex, CASE WHEN coalesce(a.n, 0) > 0 THEN t.TagName END AS tagName, {_ECHO},
       a.maxVal, a.minVal, a.s / {R.CAPACITY_DIVISOR} AS cap
FROM request q LEFT JOIN tags t USING (plant, TagIndex) LEFT JOIN agg a USING (plant, TagIndex)"""

ORACLE["weighing_stats"] = f"""WITH {WL},
w AS (SELECT * FROM wl_readings WHERE {_win(P.WL_TBF, P.WL_TAF)} AND {GOOD()}
        AND (plant, TagIndex) IN (SELECT plant, TagIndex FROM wl_tags)),
agg AS (SELECT plant, TagIndex, max(Val) AS maxVal, min(Val) AS minVal, {_sum('Val')} AS sumVal,
               {_sum('Val')} / count(Val) * 2 AS avg2, count_if(Val <> 0) AS nz, count(*) AS n
        FROM w GROUP BY plant, TagIndex)
SELECT q.plant, q.TagIndex, CASE WHEN coalesce(a.n, 0) > 0 THEN q.TagName END AS tagName,
       {_q(P.WL_TBF)} AS date_before, {_q(P.WL_TAF)} AS date_after,
       a.maxVal, a.minVal, a.sumVal,
       coalesce(a.avg2, 0.0) AS avgVal, coalesce(a.nz, 0) AS "count"
FROM wl_tags q LEFT JOIN agg a USING (plant, TagIndex)"""

# ----------------------------------------------------------------- gap fill

_FILLED = f"WITH {READINGS}, {TAGS}, {window_cte()}, {filled_ctes()}"

ORACLE["flagged_gaps"] = f"""{_FILLED}
SELECT plant, TagIndex, DateAndTime AS from_ts, nts AS to_ts, {_d('gap_ms')} / 1000.0 AS gap_s,
       gap_kind AS reason
FROM cls WHERE gap_kind IN ('exceeds cap', 'value mismatch across gap')"""

ORACLE["gap_filled_readings"] = f"""{_FILLED}
SELECT f.plant, f.TagIndex, t.TagName, f.DateAndTime, f.Val, f.Filled
FROM filled f JOIN tags t ON f.plant = t.plant AND f.TagIndex = t.TagIndex"""

ORACLE["gap_fill_audit"] = f"""{_FILLED}
SELECT plant, TagIndex, count_if(NOT Filled) AS realReadings, count_if(Filled) AS filledReadings,
       count(*) AS totalReadings, count_if({FLAGGED}) AS flaggedGaps,
       {_d(f'coalesce(sum(CASE WHEN {FLAGGED} THEN fgap_ms END), 0)')} / 1000.0 AS flagged_s
FROM filled GROUP BY plant, TagIndex"""

# ------------------------------------------------------------ counts, hours

_CMP = [("n_gt", ">"), ("n_lt", "<"), ("n_ge", ">="), ("n_le", "<="), ("n_eq", "="), ("n_seq", "="),
        ("n_ne", "<>"), ("n_sne", "<>")]
ORACLE["threshold_counts"] = f"""WITH {READINGS}, {TAGS}, {REQUEST}, {window_cte()},
agg AS (SELECT plant, TagIndex, {", ".join(f"count_if(Val {o} {P.THRESHOLD}) AS {n}" for n, o in _CMP)}
        FROM w GROUP BY plant, TagIndex)
SELECT q.plant, q.TagIndex, t.TagName AS tagName,
       {", ".join(f"coalesce(a.{n}, 0) AS {n}" for n, _ in _CMP)}
FROM request q LEFT JOIN tags t USING (plant, TagIndex) LEFT JOIN agg a USING (plant, TagIndex)"""


def _plain_hours(select: str, bad=P.BAD, thr=P.THRESHOLD, pph=P.POINTS_PER_HOUR, divide=True) -> str:
    """Run-hours without gap fill (audit columns NULL)."""
    div = lambda e: f"{_d(e)} / {pph}" if divide else e
    zero = "0.0" if divide else "0"
    return f"""WITH {READINGS}, {TAGS}, {REQUEST}, {window_cte(bad=bad)},
b AS (SELECT *, {BUCKET.replace('DateAndTime', 'w.DateAndTime')} AS bucket, Val > {thr} AS hit FROM w),
agg AS (SELECT plant, TagIndex, count_if(hit) AS n, count_if(hit AND bucket = 'A') AS nA,
               count_if(hit AND bucket = 'B') AS nB, count_if(hit AND bucket = 'C') AS nC,
               count_if(hit AND bucket = 'D') AS nD, count(*) AS nrows
        FROM b GROUP BY plant, TagIndex),
res AS (
  SELECT q.plant, q.TagIndex, CASE WHEN coalesce(a.nrows, 0) > 0 THEN t.TagName END AS tagName,
         coalesce(a.n, 0) AS "count", coalesce({_d('a.n')} / {pph}, 0.0) AS hour,
         coalesce({div('a.nA')}, {zero}) AS A, coalesce({div('a.nB')}, {zero}) AS B,
         coalesce({div('a.nC')}, {zero}) AS C, coalesce({div('a.nD')}, {zero}) AS D,
         coalesce({div('a.n')}, {zero}) AS total,
         CAST(NULL AS BIGINT) AS realReadings, CAST(NULL AS BIGINT) AS filledReadings
  FROM request q LEFT JOIN tags t USING (plant, TagIndex) LEFT JOIN agg a USING (plant, TagIndex))
SELECT {select} FROM res"""


ORACLE["run_hours_raw"] = _plain_hours(
    'plant, TagIndex, tagName, "count", hour, realReadings, filledReadings')
ORACLE["counter_run_hours"] = _plain_hours(
    'plant, TagIndex, tagName, "count", hour, A, B, C, D, total', bad=P.COUNTER_BAD,
    thr=P.COUNTER_THRESHOLD, pph=P.COUNTER_POINTS_PER_HOUR)

ORACLE["tariff_hours_raw"] = _run_hours_sql(
    'plant, TagIndex, tagName, "count", CAST(A AS BIGINT) AS A, CAST(B AS BIGINT) AS B, '
    'CAST(C AS BIGINT) AS C, CAST(D AS BIGINT) AS D, CAST(total AS BIGINT) AS total', pph=1.0)


def _era_hours(select: str, era_split=True, cad=P.CADENCE_S, pph_forced=R.FORCED_ERA_POINTS_PER_HOUR):
    (e0, c0, p0), (e1, c1, p1) = FX.FIXTURE_ERAS
    change = _ts(FX.FIXTURE_ERA_CHANGE.isoformat(sep=" "))
    if era_split:
        we = f"""we AS (SELECT *, CASE WHEN DateAndTime <= {change} THEN {e0} ELSE {e1} END AS era,
              CASE WHEN DateAndTime <= {change} THEN {c0} ELSE {c1} END AS cad_s,
              CASE WHEN DateAndTime <= {change} THEN {p0} ELSE {p1} END AS pph FROM w)"""
    else:
        we = f"we AS (SELECT *, 0 AS era, {cad} AS cad_s, {pph_forced} AS pph FROM w)"
    return f"""WITH {READINGS}, {TAGS}, {REQUEST}, {window_cte()}, {we},
{filled_ctes(src='we', series='plant, TagIndex, era', cad_expr='CAST(cad_s AS DOUBLE)')},
b AS (SELECT *, {BUCKET} AS bucket, Val > {P.THRESHOLD} AS hit FROM filled),
per_era AS (
  SELECT plant, TagIndex, era, pph, count_if(hit) AS n,
         count_if(hit AND bucket = 'A') AS nA, count_if(hit AND bucket = 'B') AS nB,
         count_if(hit AND bucket = 'C') AS nC, count_if(hit AND bucket = 'D') AS nD,
         count_if(NOT Filled) AS realReadings, count_if(Filled) AS filledReadings,
         count_if({FLAGGED}) AS flaggedGaps,
         {_d(f'coalesce(sum(CASE WHEN {FLAGGED} THEN fgap_ms END), 0)')} / 1000.0 AS flagged_s,
         count(*) AS nrows
  FROM b GROUP BY plant, TagIndex, era, pph),
agg AS (
  SELECT plant, TagIndex, CAST(sum(n) AS BIGINT) AS n, sum(n / pph) AS hour,
         sum(nA / pph) AS A, sum(nB / pph) AS B, sum(nC / pph) AS C, sum(nD / pph) AS D,
         CAST(sum(realReadings) AS BIGINT) AS realReadings,
         CAST(sum(filledReadings) AS BIGINT) AS filledReadings,
         CAST(sum(flaggedGaps) AS BIGINT) AS flaggedGaps, sum(flagged_s) AS flagged_s,
         sum(nrows) AS nrows
  FROM per_era GROUP BY plant, TagIndex),
res AS (
  SELECT q.plant, q.TagIndex, CASE WHEN coalesce(a.nrows, 0) > 0 THEN t.TagName END AS tagName,
         coalesce(a.n, 0) AS "count", coalesce(a.hour, 0.0) AS hour,
         coalesce(a.A, 0.0) AS A, coalesce(a.B, 0.0) AS B, coalesce(a.C, 0.0) AS C,
         coalesce(a.D, 0.0) AS D, coalesce(a.hour, 0.0) AS total,
         a.realReadings, a.filledReadings, a.flaggedGaps, a.flagged_s
  FROM request q LEFT JOIN tags t USING (plant, TagIndex) LEFT JOIN agg a USING (plant, TagIndex))
SELECT {select} FROM res"""


ORACLE["run_hours_eras"] = _era_hours(
    'plant, TagIndex, tagName, "count", hour, A, B, C, D, total, realReadings, filledReadings, '
    'flaggedGaps, flagged_s')
ORACLE["run_hours_forced_era"] = _era_hours(
    'plant, TagIndex, tagName, "count", hour, total, realReadings, filledReadings, flaggedGaps',
    era_split=False)

ORACLE["gap_correction_report"] = f"""{_FILLED}
SELECT plant, TagIndex,
       {_d('count_if(Val > ' + str(P.THRESHOLD) + ' AND NOT Filled)')} / {P.POINTS_PER_HOUR} AS raw_hour,
       {_d('count_if(Val > ' + str(P.THRESHOLD) + ')')} / {P.POINTS_PER_HOUR} AS filled_hour,
       count_if(NOT Filled) AS realReadings, count_if(Filled) AS filledReadings,
       count_if({FLAGGED}) AS flaggedGaps,
       {_d(f'coalesce(sum(CASE WHEN {FLAGGED} THEN fgap_ms END), 0)')} / 1000.0 AS flagged_s
FROM filled GROUP BY plant, TagIndex"""

# ------------------------------------------------------------------ reports

_UP = f"""WITH {READINGS}, {TAGS}, {window_cte()},
succ AS (SELECT *, lead(DateAndTime) OVER win AS nts, lead(Val) OVER win AS nval
         FROM w WINDOW win AS (PARTITION BY plant, TagIndex ORDER BY DateAndTime, seq)),
p AS (SELECT *, epoch_ms(nts) - epoch_ms(DateAndTime) AS dt_ms,
             Val >= {P.UPTIME_THRESHOLD} AS sa, nval >= {P.UPTIME_THRESHOLD} AS sb
      FROM succ WHERE nts IS NOT NULL),
c AS (SELECT *, dt_ms <= {P.CADENCE_S * 1000.0 * R.GAP_NORMAL_FACTOR} AS normal FROM p),
c2 AS (SELECT *, NOT normal AND dt_ms <= {P.CAP_S * 1000.0} AND sa = sb AS bridge FROM c),
c3 AS (SELECT *, NOT normal AND NOT bridge AS unm FROM c2)"""

ORACLE["uptime_accounting"] = f"""{_UP},
agg AS (SELECT plant, TagIndex,
               CAST(coalesce(sum(CASE WHEN (normal OR bridge) AND sa THEN dt_ms END), 0) AS BIGINT) AS run,
               CAST(coalesce(sum(CASE WHEN (normal OR bridge) AND NOT sa THEN dt_ms END), 0) AS BIGINT) AS stp,
               CAST(coalesce(sum(CASE WHEN bridge THEN dt_ms END), 0) AS BIGINT) AS fil,
               CAST(coalesce(sum(CASE WHEN unm THEN dt_ms END), 0) AS BIGINT) AS um,
               count_if(unm) AS flagged_gaps
        FROM c3 GROUP BY plant, TagIndex)
SELECT plant, TagIndex, {_d('run + stp + um')} / 1000.0 AS span_s, {_d('run')} / 1000.0 AS running_s,
       {_d('stp')} / 1000.0 AS stopped_s, {_d('fil')} / 1000.0 AS filled_s,
       {_d('um')} / 1000.0 AS unmeasured_s,
       CASE WHEN {_d('run')} / 1000.0 + {_d('stp')} / 1000.0 > 0
            THEN {_d('run')} / 1000.0 / ({_d('run')} / 1000.0 + {_d('stp')} / 1000.0) * 100.0
            ELSE 0.0 END AS uptime_pct,
       flagged_gaps
FROM agg"""

ORACLE["uptime_gaps"] = f"""{_UP}
SELECT plant, TagIndex, DateAndTime AS from_ts, nts AS to_ts, {_d('dt_ms')} / 1000.0 AS gap_s,
       sa AS state_before, sb AS state_after,
       CASE WHEN dt_ms > {P.CAP_S * 1000.0} THEN 'exceeds cap' ELSE 'state mismatch across gap' END AS reason
FROM c3 WHERE unm"""

_EXP = 86400.0 / P.CADENCE_S
ORACLE["logging_completeness"] = f"""WITH {READINGS}, {TAGS}, {window_cte()},
pd AS (SELECT plant, TagIndex, CAST(DateAndTime AS DATE) AS day, count(*) AS samples
       FROM w GROUP BY plant, TagIndex, CAST(DateAndTime AS DATE)),
sp AS (SELECT plant, TagIndex, min(day) AS d0, max(day) AS d1 FROM pd GROUP BY plant, TagIndex),
days AS (SELECT plant, TagIndex,
                CAST(unnest(generate_series(CAST(d0 AS TIMESTAMP), CAST(d1 AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day
         FROM sp)
SELECT d.plant, d.TagIndex, d.day, CAST({_EXP} AS DOUBLE) AS expected,
       coalesce(pd.samples, 0) AS samples,
       CAST({_EXP} AS DOUBLE) - coalesce(pd.samples, 0) AS missing,
       coalesce(pd.samples, 0) / CAST({_EXP} AS DOUBLE) * 100.0 AS completeness_pct
FROM days d LEFT JOIN pd USING (plant, TagIndex, day)"""

# ----------------------------------------------------------------- weighing

_PIVOT = ",\n         ".join(
    f"arg_max(Val, seq) FILTER (WHERE TagName = {_q(name)}) AS {col}" for name, col in R.WEIGHING_TAGS)
_CYC = f"""WITH {WL},
j AS (SELECT r.*, t.TagName FROM wl_readings r JOIN wl_tags t ON r.plant = t.plant AND r.TagIndex = t.TagIndex
      WHERE r.DateAndTime BETWEEN {_ts(P.WL_TBF)} AND {_ts(P.WL_TAF)}
        AND r.Status IS NOT NULL AND r.Status NOT IN ({_list(P.BAD)}) AND (r.Val IS NULL OR r.Val <> 0)),
cyc AS (SELECT plant, DateAndTime,
         {_PIVOT}
        FROM j GROUP BY plant, DateAndTime)"""

_FORMAT = f"SELECT plant, DateAndTime, id, WL_No, coalesce({_r2('Weight')}, 0.0) AS Weight, Silo, Material"
_RANGE = (f"coalesce(Weight, 0) >= {P.MIN_WEIGHT} AND coalesce(Weight, 0) <= {P.MAX_WEIGHT} "
          f"AND coalesce(id, 0) >= {P.MIN_ID} AND coalesce(id, 0) <= {P.MAX_ID}")

ORACLE["weighing_pivot"] = f"{_CYC}\n{_FORMAT} FROM cyc"
ORACLE["weighing_pivot_filtered"] = f"{_CYC}\n{_FORMAT} FROM cyc WHERE {_RANGE}"
ORACLE["weighing_pivot_silo"] = f"{_CYC}\n{_FORMAT} FROM cyc WHERE Silo = {P.SILO}"
ORACLE["weighing_summary"] = f"""{_CYC},
f AS (SELECT * FROM cyc WHERE {_RANGE}),
s AS (SELECT plant, count(*) AS cycles, {_sum('coalesce(Weight, 0.0)')} AS total FROM f GROUP BY plant)
SELECT plant, cycles, {_r2('coalesce(total, 0.0)')} AS totalWeight,
       CASE WHEN cycles > 0 THEN {_r2('total / cycles')} ELSE 0.0 END AS avgWeight
FROM s"""

# -------------------------------------------------------------------- alarms

def _alarm_bounds():
    import datetime as dt

    from millrun.functions.time import file_ticks_py, local_to_utc
    lo_hours = file_ticks_py(P.AS_OF - dt.timedelta(hours=P.MAX_HOURS))
    f, t = local_to_utc(P.FROM_LOCAL), local_to_utc(P.TO_LOCAL)
    lo_win, hi_win = file_ticks_py(f), file_ticks_py(t) + R.TICKS_UPPER_PAD
    local_today = (P.AS_OF + dt.timedelta(hours=R.PLANT_TZ_OFFSET_HOURS)).date()
    start = dt.datetime.combine(local_today - dt.timedelta(days=P.MAX_DAYS), dt.time()) \
        - dt.timedelta(hours=R.PLANT_TZ_OFFSET_HOURS)
    lo_edge = file_ticks_py(P.EDGE_AS_OF - dt.timedelta(hours=P.EDGE_HOURS))
    return lo_hours, lo_win, hi_win, file_ticks_py(start), lo_edge


_LO_H, _LO_W, _HI_W, _LO_DAILY, _LO_EDGE = _alarm_bounds()
_SHIFT = f"INTERVAL {R.PLANT_TZ_OFFSET_HOURS} HOUR"
_NOT_NOISE = "(Message IS NULL OR NOT starts_with(Message, 'Alarm fault'))"
_FAMILY = lambda c: f"(ConditionName = {_q(c)} OR starts_with(ConditionName, {_q(c + '_')}))"
_RECENT_COLS = ("SourceName, ConditionName, SubConditionName, Severity, Priority, Message, "
                "InputValue, LimitValue, Active, Acked")
_SOURCE_COLS = ("ConditionName, SubConditionName, Severity, Message, InputValue, LimitValue, "
                "Active, Acked")
_NEWEST = "ORDER BY TicksTimeStamp DESC, EventID DESC"

ORACLE["alarm_recent"] = f"""WITH {ALARMS}
SELECT EventTimeStamp + {_SHIFT} AS EventTimeStamp, {_RECENT_COLS}
FROM alarms WHERE {_NOT_NOISE} {_NEWEST} LIMIT 5000"""

ORACLE["alarm_recent_filtered"] = f"""WITH {ALARMS}
SELECT EventTimeStamp + {_SHIFT} AS EventTimeStamp, {_RECENT_COLS}
FROM alarms
WHERE TicksTimeStamp >= {_LO_W} AND TicksTimeStamp <= {_HI_W}
  AND {_FAMILY(P.CONDITION)} AND GroupPath = {_q(P.GROUP)}
{_NEWEST} LIMIT 5000"""

ORACLE["alarm_source_history"] = f"""WITH {ALARMS}
SELECT EventTimeStamp + {_SHIFT} AS EventTimeStamp, {_SOURCE_COLS}
FROM alarms WHERE SourceName = {_q(P.SOURCE)} AND TicksTimeStamp >= {_LO_H}
{_NEWEST} LIMIT 5000"""

ORACLE["alarm_source_window"] = f"""WITH {ALARMS}
SELECT EventTimeStamp + {_SHIFT} AS EventTimeStamp, {_SOURCE_COLS}
FROM alarms
WHERE SourceName = {_q(P.SOURCE)} AND TicksTimeStamp >= {_LO_W} AND TicksTimeStamp <= {_HI_W}
  AND {_FAMILY('TRIP_L')}
{_NEWEST} LIMIT 5000"""


def _active(extra_before="", extra_after=""):
    return f"""WITH {ALARMS},
f AS (SELECT * FROM alarms WHERE {_NOT_NOISE} AND TicksTimeStamp >= {_LO_H} {extra_before}),
l AS (SELECT *, row_number() OVER (PARTITION BY SourceName, ConditionName
                                   ORDER BY TicksTimeStamp DESC, EventID DESC) AS rn FROM f)
SELECT EventTimeStamp + {_SHIFT} AS EventTimeStamp, SourceName, ConditionName, SubConditionName,
       Severity, Priority, Message, InputValue, LimitValue, Active, Acked, GroupPath
FROM l WHERE rn = 1 AND Active {extra_after}"""


ORACLE["alarm_active"] = _active()
ORACLE["alarm_active_unacked"] = _active(f"AND {_FAMILY(P.CONDITION)}", "AND Acked = false")

ORACLE["alarm_daily"] = f"""WITH {ALARMS}
SELECT CAST(EventTimeStamp + {_SHIFT} AS DATE) AS event_date,
       count_if(NOT coalesce(starts_with(Message, 'Alarm fault'), false)) AS real_events,
       count_if(coalesce(starts_with(Message, 'Alarm fault'), false)) AS fault_events,
       count(*) AS total_events
FROM alarms WHERE TicksTimeStamp >= {_LO_DAILY}
GROUP BY CAST(EventTimeStamp + {_SHIFT} AS DATE)"""


def _noisy(group=None, since=_LO_H):
    g = f"AND GroupPath = {_q(group)}" if group else ""
    return f"""WITH {ALARMS}
SELECT SourceName, ConditionName, count(*) AS event_count,
       min(EventTimeStamp) + {_SHIFT} AS first_event, max(EventTimeStamp) + {_SHIFT} AS last_event
FROM alarms WHERE TicksTimeStamp >= {since} {g}
GROUP BY SourceName, ConditionName
ORDER BY event_count DESC, SourceName ASC NULLS FIRST, ConditionName ASC NULLS FIRST LIMIT 50"""


ORACLE["alarm_noisy"] = _noisy()
ORACLE["alarm_noisy_group"] = _noisy(P.GROUP)

ORACLE["alarm_groups"] = f"""WITH {ALARMS}
SELECT GroupPath, split_part(GroupPath, '.', 1) AS plant_area, count(*) AS event_count,
       max(EventTimeStamp) + {_SHIFT} AS last_event
FROM alarms GROUP BY GroupPath"""

def _faults(since=_LO_H):
    return f"""WITH {ALARMS}
SELECT SourceName, count(*) AS fault_count, min(EventTimeStamp) + {_SHIFT} AS first_fault,
       max(EventTimeStamp) + {_SHIFT} AS last_fault
FROM alarms WHERE contains(Message, 'quality is bad') AND TicksTimeStamp >= {since}
GROUP BY SourceName
ORDER BY fault_count DESC, SourceName ASC NULLS FIRST LIMIT 50"""


ORACLE["alarm_faults"] = _faults()

ORACLE["alarm_heartbeat"] = f"""WITH {ALARMS},
h AS (SELECT arg_max(EventTimeStamp, TicksTimeStamp) AS newest, count(*) AS total_rows FROM alarms),
m AS (SELECT *, date_diff('minute', date_trunc('minute', newest),
                          date_trunc('minute', {_ts(P.AS_OF.isoformat(sep=' '))})) AS mins FROM h)
SELECT newest + {_SHIFT} AS newest_event, mins AS minutes_since_last, total_rows,
       coalesce(mins < {R.HEARTBEAT_OK_MINUTES}, false) AS logging_ok
FROM m"""

# The same results from kept state and from daily partial aggregates.
ORACLE["alarm_active_state"] = _active("", "AND Acked = false")
ORACLE["readings_latest_state"] = ORACLE["readings_latest_per_tag"]
ORACLE["alarm_daily_rollup"] = ORACLE["alarm_daily"]
ORACLE["alarm_noisy_rollup"] = _noisy(since=_LO_EDGE)
ORACLE["alarm_groups_rollup"] = ORACLE["alarm_groups"]
ORACLE["alarm_faults_rollup"] = _faults(_LO_EDGE)


# ---------------------------------------------------------- per-plant policy

ORACLE["run_hours_by_plant"] = f"""WITH {READINGS}, {TAGS}, {WL},
allr AS (SELECT * FROM readings UNION ALL SELECT * FROM wl_readings),
alltags AS (SELECT * FROM tags UNION ALL SELECT * FROM wl_tags),
request AS (SELECT plant, TagIndex FROM alltags UNION SELECT 'EVT', CAST({P.UNKNOWN_TAG} AS INTEGER)),
w AS (SELECT *, CASE plant WHEN 'EVT' THEN 600.0 ELSE {R.GAP_CADENCE_S} END AS cad_s,
             CASE plant WHEN 'EVT' THEN 6.0 ELSE 360.0 END AS pph, plant = 'EVT' AS fill_on
      FROM allr
      WHERE DateAndTime BETWEEN {_ts(P.ALL_TBF)} AND {_ts(P.ALL_TAF)} AND {GOOD()}
        AND (plant, TagIndex) IN (SELECT plant, TagIndex FROM alltags)),
{filled_ctes(cad_expr='CAST(cad_s AS DOUBLE)', enabled='fill_on')},
b AS (SELECT *, {BUCKET} AS bucket, Val > {P.THRESHOLD} AS hit FROM filled),
agg AS (
  SELECT plant, TagIndex, count_if(hit) AS n, sum(CASE WHEN hit THEN 1.0 / pph END) AS h,
         count_if(hit AND bucket = 'A') / any_value(pph) AS A,
         count_if(hit AND bucket = 'B') / any_value(pph) AS B,
         count_if(hit AND bucket = 'C') / any_value(pph) AS C,
         count_if(hit AND bucket = 'D') / any_value(pph) AS D,
         count_if(hit) / any_value(pph) AS total,
         count_if(NOT Filled) AS realReadings, count_if(Filled) AS filledReadings,
         count_if({FLAGGED}) AS flaggedGaps,
         {_d(f'coalesce(sum(CASE WHEN {FLAGGED} THEN fgap_ms END), 0)')} / 1000.0 AS flagged_s,
         count(*) AS nrows
  FROM b GROUP BY plant, TagIndex)
SELECT q.plant, q.TagIndex, CASE WHEN coalesce(a.nrows, 0) > 0 THEN t.TagName END AS tagName,
       coalesce(a.n, 0) AS "count", coalesce(a.total, 0.0) AS hour,
       coalesce(a.A, 0.0) AS A, coalesce(a.B, 0.0) AS B, coalesce(a.C, 0.0) AS C,
       coalesce(a.D, 0.0) AS D, coalesce(a.total, 0.0) AS total,
       CASE WHEN q.plant = 'EVT' THEN coalesce(a.realReadings, 0) END AS realReadings,
       CASE WHEN q.plant = 'EVT' THEN coalesce(a.filledReadings, 0) END AS filledReadings,
       CASE WHEN q.plant = 'EVT' THEN coalesce(a.flaggedGaps, 0) END AS flaggedGaps,
       CASE WHEN q.plant = 'EVT' THEN coalesce(a.flagged_s, 0.0) END AS flagged_s
FROM request q LEFT JOIN alltags t USING (plant, TagIndex) LEFT JOIN agg a USING (plant, TagIndex)"""


# ------------------------------------------------------------- result types

def _bigint_counts(sql: str) -> str:
    """DuckDB's ``count_if`` returns HUGEINT; Spark's returns BIGINT. Wrap
    every ``count_if(...)`` in ``CAST(... AS BIGINT)`` so the result schemas
    agree (balanced-parenthesis scan over this module's own SQL)."""
    out, i, tok = [], 0, "count_if("
    while True:
        j = sql.find(tok, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 1, j + len(tok)
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        out.append(sql[i:j])
        out.append(f"CAST({sql[j:k]} AS BIGINT)")
        i = k


ORACLE = {name: _bigint_counts(sql) for name, sql in ORACLE.items()}

# The same results by another route through the engine.
ORACLE["run_hours_by_plant_eras"] = ORACLE["run_hours_eras"]
ORACLE["tariff_hours_calendar"] = ORACLE["tariff_hours"]

ORACLE["weighing_pivot_material"] = f"{_CYC}\n{_FORMAT} FROM cyc WHERE Material = {P.MATERIAL}"
ORACLE["weighing_pivot_loader"] = f"{_CYC}\n{_FORMAT} FROM cyc WHERE WL_No = {P.LOADER}"
ORACLE["weighing_pivot_id"] = f"{_CYC}\n{_FORMAT} FROM cyc WHERE id = {P.CYCLE_ID}"
ORACLE["alarm_active_acked"] = _active("", "AND Acked = true")
ORACLE["alarm_recent_source"] = f"""WITH {ALARMS}
SELECT EventTimeStamp + {_SHIFT} AS EventTimeStamp, {_RECENT_COLS}
FROM alarms WHERE {_NOT_NOISE} AND SourceName = {_q(P.SOURCE)} AND TicksTimeStamp >= {_LO_H}
{_NEWEST} LIMIT 5000"""
ORACLE["alarm_groups_window"] = f"""WITH {ALARMS}
SELECT GroupPath, split_part(GroupPath, '.', 1) AS plant_area, count(*) AS event_count,
       max(EventTimeStamp) + {_SHIFT} AS last_event
FROM alarms WHERE TicksTimeStamp >= {_LO_H} GROUP BY GroupPath"""

_CHANGE = _ts(FX.FIXTURE_ERA_CHANGE.isoformat(sep=" "))
ORACLE["fill_options"] = f"""WITH {READINGS}, {TAGS}, {REQUEST}, {window_cte()}
SELECT DISTINCT plant, TagIndex,
       CAST(CASE WHEN DateAndTime <= {_CHANGE} THEN {FX.FIXTURE_ERAS[0][0]} ELSE {FX.FIXTURE_ERAS[1][0]} END AS INTEGER) AS era_id,
       CAST(CASE WHEN DateAndTime <= {_CHANGE} THEN {FX.FIXTURE_ERAS[0][1]} ELSE {FX.FIXTURE_ERAS[1][1]} END AS DOUBLE) AS cadence_s,
       CAST({P.CAP_S} AS DOUBLE) AS cap_s, CAST({P.TOLERANCE} AS DOUBLE) AS tolerance
FROM w"""

ORACLE["weighing_summary_echo"] = ORACLE["weighing_summary"].replace(
    "SELECT plant, cycles,", f"SELECT {_q(json.dumps(P.WL_FILTERS))} AS filters, plant, cycles,")

_CLOCK = f"(DateAndTime + INTERVAL {P.CLOCK_OFFSET_MINUTES} MINUTE)"
_ODD_DAYS = BUCKET.replace(f"(CAST(DateAndTime AS DATE) IN ({HOLIDAY_SQL}) OR dayofweek(DateAndTime) IN (0, 6))",
                           "(day(DateAndTime) % 2 = 1)").replace("DateAndTime", _CLOCK)
ORACLE["run_hours_text"] = _bigint_counts(_run_hours_sql(
    'plant, TagIndex, tagName, "count", hour, A, B, C, D, total, realReadings, filledReadings').replace(BUCKET, _ODD_DAYS))
