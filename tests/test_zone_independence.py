"""Results must not depend on the session time zone (all time is NTZ)."""

import pytest

from conftest import SF_SMALL
from millrun.plans.queries import REGISTRY

NAMES = ["run_hours_eras", "tariff_hours", "readings_window", "alarm_daily", "alarm_heartbeat",
         "alarm_recent_filtered", "logging_completeness", "weighing_summary"]


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Tokyo"])
def test_same_results_in_other_session_zones(spark, zone):
    def rows(name):
        return sorted(map(tuple, REGISTRY[name](spark, SF_SMALL).collect()), key=repr)
    base = {n: rows(n) for n in NAMES}
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        for n in NAMES:
            assert rows(n) == base[n], n
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
