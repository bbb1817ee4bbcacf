"""Small parameter tables (registry rows, calendars, eras) as JVM-local relations.

``createDataFrame`` on a Python list yields an RDD of pickled rows that every
scan must send through Python workers. A ``VALUES`` relation with bound
parameters stays in the JVM (``LocalTableScan``), costs nothing to size-check
and folds into the plan like any literal.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def local_table(spark: SparkSession, rows: Sequence[Sequence], schema: T.StructType) -> DataFrame:
    names = [f.name for f in schema.fields]
    if not rows:
        return spark.createDataFrame([], schema)
    args: dict[str, object] = {}
    tuples = []
    for i, row in enumerate(rows):
        if len(row) != len(names):
            raise ValueError(f"row {i} has {len(row)} values, schema has {len(names)}")
        marks = []
        for j, v in enumerate(row):
            key = f"p{i}_{j}"
            if isinstance(v, tuple):
                v = list(v)
            elif isinstance(v, (dt.datetime, dt.date)):
                v = v.isoformat(sep=" ") if isinstance(v, dt.datetime) else v.isoformat()
            args[key] = v            # text, cast below: no time zone is consulted
            marks.append(f":{key}")
        tuples.append("(" + ", ".join(marks) + ")")
    cols = ", ".join(f"CAST(`c{j}` AS {f.dataType.simpleString()}) AS `{f.name}`"
                     for j, f in enumerate(schema.fields))
    aliases = ", ".join(f"c{j}" for j in range(len(names)))
    return spark.sql(f"SELECT {cols} FROM VALUES {', '.join(tuples)} AS t({aliases})", args=args)
