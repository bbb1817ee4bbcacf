"""Parameters of the registered queries (FIXTURES.md section 3).

Windows and look-backs are chosen to cover the whole fixture tables: the
readings window spans every event, and alarm look-backs use the maximum
allowed hours/days measured from ``AS_OF``, which reach back past the first
event. Only the top-N and newest-N reports keep a limit, because the limit is
the feature.
"""

import datetime as dt

from millrun.sources.fixtures import FIXTURE_AS_OF

# Readings window (plant-local, inclusive): all of the fixture data.
TBF = "2024-01-01 00:00:00"
TAF = "2024-01-31 00:00:00"
# Weighing data window: all orders. A cycle's time is its order's date plus its key
# in seconds, so the end leaves room for keys that grow with the data.
WL_TBF = "1992-01-01 00:00:00"
WL_TAF = "9999-12-31 23:59:59"

# Both fixture plants at once.
ALL_TBF = WL_TBF
ALL_TAF = WL_TAF

# Gap fill and run-hours.
CADENCE_S = 600.0
CAP_S = 7200.0
TOLERANCE = 0.5
POINTS_PER_HOUR = 6.0
THRESHOLD = 25.0
UPTIME_THRESHOLD = 10.0
BAD = ("E",)
COUNTER_BAD = ("E", "U", "S")
COUNTER_POINTS_PER_HOUR = 60.0
COUNTER_THRESHOLD = 40.0
UNKNOWN_TAG = 7
CLOCK_OFFSET_MINUTES = 90

# Alarms.
AS_OF: dt.datetime = FIXTURE_AS_OF
MAX_HOURS = 720
MAX_DAYS = 90
SOURCE = "SRC_7"
CONDITION = "TRIP"
GROUP = "Area 1.Alarm_Main"
# Plant-local from/to covering the whole log (UTC 2024-01-01 00:00 onwards).
FROM_LOCAL = "2024-01-01 07:00:00"
TO_LOCAL = "2024-01-31 07:00:00.5"

# Days up to which kept state and the rollup have been advanced, and a window that
# starts inside the first day, 1 ms after its midnight (before the first event).
BATCH_DAYS = (dt.date(2024, 1, 9), dt.date(2024, 1, 22))
ROLLED_TO = dt.date(2024, 1, 25)
EDGE_AS_OF = dt.datetime(2024, 1, 30, 17, 0, 0, 1000)
EDGE_HOURS = 713

# Weighing pivot filters.
MIN_WEIGHT = 20.0
MAX_WEIGHT = 45.0
MIN_ID = 0
MAX_ID = 40
WL_FILTERS = {"minWeight": MIN_WEIGHT, "maxWeight": MAX_WEIGHT, "minId": MIN_ID, "maxId": MAX_ID}
SILO = 30
MATERIAL = 47
LOADER = 49
CYCLE_ID = 50
