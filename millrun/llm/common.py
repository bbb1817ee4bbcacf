"""Helpers shared by the operators: shared scratch tables, package shipping, splits."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import millrun

#: Scratch folders that this process has made.
_MADE: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name under the cluster's shared ``spark.checkpoint.dir``.

    Only where the session names none (local tests) is a private folder made.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        base = tempfile.mkdtemp(prefix="millrun-llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    folder = f"{base.rstrip('/')}/llm-{uuid.uuid4().hex[:12]}"
    _MADE.append(folder)
    return f"{folder}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back.

    A lost executor then costs a re-read, and steps that number or pack rows in
    arrival order see the same rows on every retry."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of any cluster."""
    sc = spark.sparkContext
    if getattr(sc, "_millrun_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(millrun.__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="millrun-zip-"), "millrun_workers.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(top):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("millrun", os.path.relpath(full, top)))
    sc.addPyFile(target)
    sc._millrun_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column, mod: int) -> Column:
    """``crc32(doc_id as text) mod n``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def utf8(text: Column) -> Column:
    """The text's UTF-8 bytes; null is empty."""
    return F.coalesce(text.cast("string"), F.lit("")).cast("binary")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names for columns beside those of ``df``, whatever these are called."""
    tail = "_" * (1 + max(map(len, df.columns), default=0))
    return [n + tail for n in names]


def clear_scratch(spark: SparkSession) -> None:
    """Remove the scratch tables of this process. Results that were not consumed yet need them."""
    for path in _MADE:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _MADE.clear()


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def by_doc(batch, n: int = 256):
    """Slices of an Arrow batch, so that only some texts at a time become Python objects."""
    for i in range(0, batch.num_rows, n):
        yield batch.slice(i, n)


def numbered_cells(df: DataFrame, key: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows dealt out by ranges of ``key`` and ``order``, and the cells (range, key) that they fall in.

    A row carries ``_part``, its range, and ``_nth``, its place in its cell from 1. A cell carries
    ``_before``, the rows of its key in earlier ranges, and ``_all``, all rows of its key. So a
    key's rows are numbered ``_nth + _before`` without ever being in one task: a hot key, equal
    rows included, takes as many ranges as it fills. Nulls come first."""
    rows = df.withColumn("_tie", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(parts(df.sparkSession), *key, *order, "_tie").withColumn("_part", F.spark_partition_id())
    rows = written(rows, "ranges")
    own = Window.partitionBy("_part", *key).orderBy(*order, "_tie")
    cells = rows.groupBy("_part", *key).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("_part", *key, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
                         F.sum("_n").over(Window.partitionBy(*key)).alias("_all"))
    return rows.withColumn("_nth", F.row_number().over(own).cast("long")).drop("_tie"), cells
