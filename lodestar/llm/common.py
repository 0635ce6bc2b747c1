"""Shared folder, staged tables and size-checked joins."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: what lies between ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes that a side may have to be broadcast, by the estimate below.
BROADCAST_BYTES = 32 << 20
_made: list[tuple[SparkSession, str]] = []
#: Folders of sessions that have no ``spark.checkpoint.dir``, by their context.
_own: dict[int, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one only where none is set (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or _own.get(id(spark.sparkContext))
    if not found:
        found = _own[id(spark.sparkContext)] = f"file://{tempfile.mkdtemp(prefix='lodestar-')}"
    return found.rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    """A fresh folder name under the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/lodestar-{tag}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_sweep)
    _made.append((spark, path))
    return path


def drop_folder(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _sweep() -> None:
    for spark, path in _made:
        try:
            drop_folder(spark, path)
        except Exception:  # noqa: BLE001  the session is gone: nothing can be removed any more
            return


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts the lineage, and survives the loss of executors."""
    spark = df.sparkSession
    path = new_folder(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    release(spark)
    return out


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fits(df: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``most`` bytes: a row counts 48, 16 for each column, and what its strings, binaries and arrays hold as text."""
    row = 48 + 16 * len(df.columns)
    loose = [F.coalesce(F.octet_length(F.col(f"`{f.name}`").cast("string")), F.lit(0)) for f in df.schema.fields if f.dataType.typeName() in ("string", "binary", "array", "struct", "map")]
    extra = F.sum(sum(loose[1:], loose[0]).cast("long")) if loose else F.lit(0).cast("long")
    got = df.limit(most // row + 1).agg(F.count("*").alias("n"), extra.alias("b")).first()
    return got.n * row + (got.b or 0) <= most


def checked_broadcast(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if it fits, else unchanged (then Spark shuffles both sides)."""
    return F.broadcast(df) if fits(df, most) else df


def unused(df: DataFrame, tag: str) -> str:
    """A column name that ``df`` does not have."""
    name, taken = f"__{tag}", {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Arrow batches of few rows, as one text may have megabytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def held_in(doc_id, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus
