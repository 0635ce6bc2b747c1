"""Cutting lineage in iterative plans: tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []
#: Folders of sessions that have no ``spark.checkpoint.dir``, by their context.
_own: dict[int, str] = {}


def fresh(spark: SparkSession) -> str:
    """A new folder's name under ``spark.checkpoint.dir``, removed when the driver ends; a temporary folder serves only where none is set (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or _own.get(id(spark.sparkContext))
    if not at:
        at = _own[id(spark.sparkContext)] = f"file://{tempfile.mkdtemp(prefix='lodestar-')}"
    path = f"{at.rstrip('/')}/lodestar-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_sweep)
    _made.append((spark, path))
    return path


def settle(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    path = fresh(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, *order, name: str) -> DataFrame:
    """``df`` with its rows numbered from 0 in a total order, by ranges: nothing is sorted in one place."""
    at = settle(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    base = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = at.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", base.alias("_base"))  # a row per partition
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    out = at.withColumn("_place", place).join(F.broadcast(before), "_part")
    return out.withColumn(name, (F.col("_place") + F.col("_base")).cast("long")).drop("_part", "_place", "_base")


def _sweep() -> None:
    for spark, path in _made:
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the session is gone
            return
