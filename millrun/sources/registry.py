"""Plant registry, calendars and labels as data.

The values in the FIXED VALUES block must equal the service this package
replaces, or results differ. They are stated as text, in natural order.
"""

from __future__ import annotations

import datetime as dt

# ---------------------------------------------------------------- FIXED VALUES
# Plant areas and their descriptions.
PLANT_DESCRIPTIONS = [
    ("BM2_con", "BallMill2 Conveyor"),
    ("BM2", "BallMill2"),
    ("CT6_con", "Coating6 Conveyor"),
    ("CT6_heater", "Coating6 Heater"),
    ("CT7_con", "Coating7 Conveyor"),
    ("CT7_heater", "Coating7 Heater"),
    ("CSH", "Crushing"),
    ("FeedRaw", "FeedRaw Material VM/BM1/BM2"),
    ("HYD", "Hydraulics Vertical Roller Mill"),
    ("RMM1", "Raymond Mill1"),
    ("RMM2", "Raymond Mill2"),
    ("WL", "Wheel Loader Weight"),
    ("RRM", "RingRollerMill"),
    ("LC_CSH", "Loadcell Crushing"),
    ("Hour_OFIL", "Hour OFIL"),
]

# Per plant: bad status codes, logging cadence (s, None = on change),
# samples per hour for run-hours, gap fill on window routes, gap fill on counts.
PLANT_POLICY = [
    ("BM2_con", ["E"], 10.0, 360.0, True, True),
    ("BM2", ["E"], 10.0, 360.0, True, True),
    ("CT6_con", ["E"], 10.0, 360.0, True, True),
    ("CT6_heater", ["E"], 10.0, 360.0, True, True),
    ("CT7_con", ["E"], 10.0, 360.0, True, True),
    ("CT7_heater", ["E"], 10.0, 360.0, True, True),
    ("RRM", ["E"], 10.0, 360.0, True, True),
    ("LC_CSH", ["E"], None, 360.0, True, False),
    ("Hour_OFIL", ["E", "U", "S"], 60.0, 360.0, False, False),
    ("CSH", ["E"], 10.0, 360.0, True, True),
    ("FeedRaw", ["E"], 10.0, 360.0, True, True),
    ("HYD", ["E"], 10.0, 360.0, True, True),
    ("RMM1", ["E"], 15.0, 360.0, True, True),
    ("RMM2", ["E"], 10.0, 360.0, True, True),
    ("WL", ["E"], None, 360.0, False, False),
]

# RMM1 changed its logging interval at this plant-local instant; the row at the
# instant belongs to the earlier era.
RMM1_CADENCE_CHANGE = dt.datetime(2026, 7, 9, 9, 18, 12)
RMM1_ERAS = [
    # (era_id, cadence_s, points_per_hour)
    (0, 10.0, 360.0),
    (1, 15.0, 240.0),
]
# A caller-given cadence or divisor forces one era with these defaults.
FORCED_ERA_CADENCE_S = 15.0
FORCED_ERA_POINTS_PER_HOUR = 240.0

# Public holidays, 2025-2027 (weekends are holidays by rule, not listed).
HOLIDAYS = [
    "2025-01-01", "2025-02-12", "2025-04-15", "2025-04-14",
    "2025-05-01", "2025-06-03", "2025-07-10", "2025-07-11",
    "2025-08-12", "2025-10-13", "2025-10-23", "2025-12-05",
    "2025-12-10", "2025-12-31",
    "2026-01-01", "2026-03-03", "2026-04-06", "2026-04-13",
    "2026-04-14", "2026-04-15", "2026-05-01", "2026-05-04",
    "2026-06-03", "2026-07-28", "2026-07-29", "2026-07-30",
    "2026-08-12", "2026-10-13", "2026-10-23",
    "2026-12-07",
    "2026-12-10", "2026-12-31",
    "2027-01-01", "2027-02-22", "2027-04-06", "2027-04-13",
    "2027-04-14", "2027-04-15", "2027-05-04", "2027-05-20",
    "2027-06-03", "2027-07-19", "2027-07-20", "2027-07-28",
    "2027-08-12", "2027-10-13", "2027-10-25",
    "2027-12-06",
    "2027-12-10", "2027-12-31",
]

# Weighing-cycle pivot: PLC tag name -> output column.
WEIGHING_TAGS = [
    ("[PLC_Crushing]BRS_INT[14]", "id"),
    ("[PLC_Crushing]BRS_INT[08]", "WL_No"),
    ("[PLC_Crushing]BRS_REAL[26]", "Weight"),
    ("[PLC_Crushing]BRS_DINT[3]", "Silo"),
    ("[PLC_Crushing]BRS_DINT[4]", "Material"),
]

# Gap-fill defaults: cadence 10 s, cap 90 s, relative tolerance 0.2; a gap is
# normal up to 1.5 x cadence; values agree within tolerance of max(|a|,|b|,1e-6).
GAP_CADENCE_S = 10.0
GAP_CAP_S = 90.0
GAP_TOLERANCE = 0.2
GAP_NORMAL_FACTOR = 1.5
GAP_SCALE_FLOOR = 1e-6
REASON_EXCEEDS_CAP = "exceeds cap"
REASON_MISMATCH = "value mismatch across gap"
REASON_STATE_MISMATCH = "state mismatch across gap"

# Run-hours: default samples per hour (10 s cadence).
DEFAULT_POINTS_PER_HOUR = 360.0
# Capacity divisor of the calCap route.
CAPACITY_DIVISOR = 6.0
# Uptime accounting: running means Val >= this.
UPTIME_THRESHOLD = 10.0

# Tariff buckets on the plant-local clock, both ends inclusive, seconds grain:
# holiday 06:00-18:00 -> C else D; other days 09:00-22:00 -> A else B.
HOLIDAY_DAY_START_S = 6 * 3600
HOLIDAY_DAY_END_S = 18 * 3600
WORKDAY_PEAK_START_S = 9 * 3600
WORKDAY_PEAK_END_S = 22 * 3600

# Alarm log: stored in UTC, shown in plant time (UTC+7, no DST).
PLANT_TZ_OFFSET_HOURS = 7
FAULT_PREFIX = "Alarm fault"
FAULT_CONTAINS = "quality is bad"
FILETIME_EPOCH_OFFSET_MS = 11644473600000     # 1601-01-01 -> 1970-01-01
TICKS_PER_MS = 10000
TICKS_UPPER_PAD = 9999                        # inclusive upper bound on ms bounds
HEARTBEAT_OK_MINUTES = 120
# Parameter ranges (checked, never clamped).
LIMIT_RANGE = (1, 5000)
HOURS_RANGE = (1, 720)
DAYS_RANGE = (1, 90)
TOP_RANGE = (1, 50)
# Defaults per route.
RECENT_LIMIT = 50
SOURCE_LIMIT = 100
SOURCE_HOURS = 168
ACTIVE_HOURS = 168
DAILY_DAYS = 14
NOISY_HOURS, NOISY_TOP = 24, 10
FAULTS_HOURS, FAULTS_TOP = 24, 20
# Rows returned by the newest-readings listing.
NEWEST_READINGS = 1000
# ------------------------------------------------------------ end FIXED VALUES


def holiday_dates(extra: list[str] | None = None) -> list[dt.date]:
    """The listed holidays (plus ``extra`` ISO dates) as ``date`` objects."""
    return [dt.date.fromisoformat(s) for s in HOLIDAYS + list(extra or [])]
