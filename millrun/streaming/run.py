"""Starting streaming queries so they survive failures.

Every query gets a ``checkpointLocation`` under the cluster's shared
``spark.checkpoint.dir`` (offsets, commits and state-store snapshots), so a
restarted query resumes where it stopped; with a replayable file source and a
transactional sink (Parquet/Delta file sink, or ``foreachBatch`` writing by
batch id) output is exactly-once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from millrun.session import checkpoint_dir


def start(df: DataFrame, name: str, *, mode: str = "append", fmt: str = "parquet",
          path: str | None = None, trigger: dict | None = None,
          checkpoint_location: str | None = None) -> StreamingQuery:
    """Start ``df`` as a named streaming query with a durable checkpoint.
    ``fmt="memory"`` is for tests and dashboards on the driver."""
    loc = checkpoint_location or f"{checkpoint_dir(df.sparkSession)}/streams/{name}"
    w = df.writeStream.queryName(name).outputMode(mode).format(fmt).option("checkpointLocation", loc)
    if trigger:
        w = w.trigger(**trigger)
    return w.start(path) if path else w.start()
