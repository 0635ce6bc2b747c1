"""Staged versions and their rollback, caches by content, queues of changes, the rebuild of what changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.store import settle
from .rag import publish, reconcile, verified
from .upkeep import same_topology


def stage_version(staged: DataFrame | None, rows: DataFrame, version: str) -> DataFrame:
    """Rows of a version beside those of others; staging a version again replaces it."""
    mine = rows.withColumns({"version": F.lit(version), "active": F.lit(False)})
    return mine if staged is None else staged.where(F.col("version") != version).unionByName(mine)


def activate(staged: DataFrame, source: str, version: str) -> DataFrame:
    """The version becomes the active one of its source, older ones of the source go."""
    other = staged.where(F.col("source_id") != source)
    return other.unionByName(staged.where((F.col("source_id") == source) & (F.col("version") == version)).withColumn("active", F.lit(True)))


def roll_back(staged: DataFrame, source: str, version: str) -> DataFrame:
    """What was staged as ``version`` goes; the active version stays as it was."""
    return staged.where((F.col("source_id") != source) | (F.col("version") != version) | F.col("active"))


def delete_source(active: DataFrame, source: str) -> DataFrame:
    return active.where(F.col("source_id") != source)


def run_source(active: DataFrame, incoming: DataFrame, expected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(table after, report ``source_id, action, ok``): changed sources are published if their rows are as many as expected, else kept as they were."""
    h = lambda df: df.groupBy("source_id").agg(F.sum(F.xxhash64(F.to_json(F.struct(*sorted(df.columns)))).cast("decimal(38,0)")).cast("string").alias("content_hash"))
    told = reconcile(h(active), h(incoming)).join(verified(incoming, expected).select("source_id", "ok"), "source_id", "left")
    told = settle(told.withColumn("ok", F.coalesce("ok", F.lit(True))))
    take = told.where("action in ('add', 'replace') and ok").select("source_id")
    return publish(active, incoming.join(take, "source_id", "left_semi")), told


# --- caches

#: Columns of a cache entry.
KEY = ("content_hash", "path", "prompt", "version")


def fingerprint(prompt: str) -> str:
    """A short stable hash of a prompt, blanks at line ends and line breaks of other systems aside."""
    import hashlib

    flat = "\n".join(line.rstrip() for line in prompt.replace("\r\n", "\n").split("\n")).strip()
    return hashlib.sha256(flat.encode()).hexdigest()[:12]


def keyed(files: DataFrame, prompt: str, version: str) -> DataFrame:
    """Files (``path, content``) with the key of their cache entry; of Markdown only the body below the front matter counts."""
    body = F.when(F.col("path").endswith(".md"), F.regexp_replace("content", r"^---\n(?s:.*?)\n---\n", "")).otherwise(F.col("content"))
    return files.withColumns({"content_hash": F.sha2(F.concat(body, F.lit("\0"), F.col("path")), 256), "prompt": F.lit(fingerprint(prompt)), "version": F.lit(version)})


def cached(files: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries found, files that have none) of keyed files."""
    return cache.join(files.select(*KEY), list(KEY), "left_semi"), files.join(cache.select(*KEY), list(KEY), "left_anti")


def pruned_cache(cache: DataFrame, files: DataFrame) -> DataFrame:
    """The cache without entries of files that are gone or have changed."""
    return cache.join(files.select("path", "content_hash").distinct(), ["path", "content_hash"], "left_semi")


def stale(entries: DataFrame, sources: DataFrame) -> DataFrame:
    """``id, stale`` of entries (``id, path, hash``): whether their source (``path, hash``) has changed or is gone."""
    now = sources.select("path", F.col("hash").alias("now"))
    return entries.join(now, "path", "left").select("id", (~F.col("hash").eqNullSafe(F.col("now"))).alias("stale"))


def may_hide_rewrite(mtime, stored_mtime, scanned_at, tick: float = 2.0):
    """Whether a file with an unchanged time may have been rewritten: it was changed within a tick of being scanned, so its content must be hashed."""
    return (mtime == stored_mtime) & (F.abs(scanned_at - stored_mtime) <= tick)


# --- queue and rebuild


def enqueue(spark: SparkSession, queue: str, paths: DataFrame) -> None:
    """Appends changed paths (``path``) to a queue folder."""
    paths.select("path").withColumn("at", F.current_timestamp()).write.mode("append").parquet(queue)


def drain(spark: SparkSession, queue: str, worker: Callable[[DataFrame], None], checkpoint: str) -> None:
    """Gives what was queued since the last time to ``worker``, each path once; what it got is not given again, even after a failure elsewhere."""
    schema = "path string, at timestamp"
    stream = spark.readStream.schema(schema).parquet(queue)
    run = stream.writeStream.foreachBatch(lambda batch, _: worker(batch.groupBy("path").agg(F.max("at").alias("at")))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()


def rebuild(nodes: DataFrame, edges: DataFrame, changed: DataFrame, extract: Callable[[DataFrame], tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame, bool]:
    """Nodes and edges with those of the changed files (``path, content``; a null content is a deleted file) replaced, and whether anything differs.

    ``nodes`` and ``edges`` have ``source_file``. Edges whose ends are gone go too.
    """
    gone = changed.select(F.col("path").alias("source_file")).distinct()
    new_nodes, new_edges = extract(changed.where("content is not null"))
    n = settle(nodes.join(gone, "source_file", "left_anti").select(nodes.columns).unionByName(new_nodes.select(nodes.columns)))
    e = edges.join(gone, "source_file", "left_anti").select(edges.columns).unionByName(new_edges.select(edges.columns))
    ids = n.select("id").distinct()
    e = settle(e.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").select(edges.columns))
    same = [same_topology(a, b, columns).first().same for a, b, columns in ((nodes, n, ["id"]), (edges, e, ["src", "dst", "relation"]))]
    return n, e, not all(same)
