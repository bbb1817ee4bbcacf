"""millrun: plant time-series and alarm-log analytics as Spark DataFrame jobs.

Every operator is a function ``f(df, ...) -> DataFrame``: lazy, no ``collect``,
no Python UDF. Readings are processed for all plants and tags at once; a single
tag or window is just a filter.
"""

from millrun.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
