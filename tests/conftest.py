import datetime as dt
import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from millrun import schemas  # noqa: E402
from millrun.session import checkpoint_dir, get_session  # noqa: E402
from millrun.sources.local import local_table  # noqa: E402

BASE = dt.datetime(2026, 1, 1, 0, 0, 0)
SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = get_session("local[*]", shuffle_partitions=8,
                    extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="millrun-ckpt-")})
    checkpoint_dir(s)
    yield s


def readings_df(spark, pts, tag=0, plant="P", status="G", base=BASE):
    """Readings from ``(offset_seconds, Val)`` pairs; seq = position."""
    rows = [(plant, tag, base + dt.timedelta(seconds=o), float(v) if v is not None else None, status, i)
            for i, (o, v) in enumerate(pts)]
    return local_table(spark, rows, schemas.READINGS)


def tags_df(spark, plant="P", n=8):
    return local_table(spark, [(plant, i, f"T{i}") for i in range(n)], schemas.TAGS)
