"""Vector memory and chat memory as tables: entries with the vectors of one embedder, searched within one workspace."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .retrieval import cosine
from .vectors import embed

#: Name of the embedder that vectors of this module are made with; only vectors of one embedder are compared.
EMBEDDER = "hashing-v2"
#: Least score of a hit, hits if no number is given.
FLOOR, HITS = 0.07, 5
ENTRY = "id string, kind string, title string, text string, source string, created_at timestamp, embedder string, dim int, embedding array<double>"


def slug(x: Column, most: int = 40) -> Column:
    return F.regexp_replace(F.left(F.regexp_replace(F.regexp_replace(F.lower(x), r"[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(most)), "-+$", "")


def entries(rows: DataFrame) -> DataFrame:
    """Entries of ``kind, title, text, source, created_at``: their id from kind, title and time, their vector from title and text."""
    own = rows.withColumn("id", F.concat_ws("-", "kind", slug(F.col("title")), F.unix_micros(F.col("created_at")).cast("string"))).dropDuplicates(["id"])
    own = own.withColumn("body", F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit(""))))
    got = embed(own, "id", "body")
    return own.join(got, "id").select("id", "kind", "title", "text", "source", "created_at", F.lit(EMBEDDER).alias("embedder"), F.size("embedding").alias("dim"), "embedding")


def add(memory: DataFrame | None, rows: DataFrame) -> DataFrame:
    """The memory with new entries; one whose id is there already is left as it is."""
    new = entries(rows)
    return new if memory is None else memory.unionByName(new.join(memory.select("id"), "id", "left_anti").select(memory.columns))


def search(memory: DataFrame, query: str, kind: str = "", k: int = 0, embedder: str = EMBEDDER) -> DataFrame:
    """``id, title, score``: the ``k`` best entries of this embedder that score at least FLOOR; none for a blank query."""
    if not query.strip():
        return memory.select("id", "title", F.lit(0.0).alias("score")).where("false")
    asked = memory.sparkSession.createDataFrame([("q", query)], "id string, text string")
    q = F.broadcast(embed(asked, "id").select(F.col("embedding").alias("q")))  # one row
    own = memory.where((F.col("embedder") == embedder) & (F.lit(True) if not kind else F.col("kind") == kind))
    scored = own.crossJoin(q).select("id", "title", F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("score"))
    return scored.where(F.col("score") >= FLOOR).orderBy(F.desc("score"), "id").limit(k or HITS)


def listed(memory: DataFrame, kind: str = "") -> DataFrame:
    return memory.where(F.lit(True) if not kind else F.col("kind") == kind).orderBy(F.desc("created_at"), "id")


def get(memory: DataFrame, entry_id: str) -> DataFrame:
    return memory.where(F.col("id") == entry_id).limit(1)


def remove(memory: DataFrame, entry_id: str) -> DataFrame:
    return memory.where(F.col("id") != entry_id)


def chat_entries(turns: DataFrame) -> DataFrame:
    """Entries of chat turns (``workspace_id, thread_id, turn_id, seq, title, text, created_at``); a turn has one id, however often it is added."""
    own = turns.withColumn("id", F.substring(F.sha2(F.concat_ws("\0", "workspace_id", "thread_id", "turn_id"), 256), 1, 32)).where(F.trim("text") != "").dropDuplicates(["id"])
    own = own.withColumn("body", F.concat_ws("\n", "title", "text"))
    return own.join(embed(own, "id", "body"), "id").withColumn("embedder", F.lit(EMBEDDER)).drop("body")


def chat_search(memory: DataFrame, workspace: str, query: str, k: int = HITS) -> DataFrame:
    """As :func:`search`, in one workspace only."""
    return search(memory.where(F.col("workspace_id") == workspace).withColumn("kind", F.lit("chat")), query, k=k)


def archive(turns: DataFrame, path: str, checkpoint: str, fail: Callable[[str], None] = lambda _: None):
    """Streams turns into the chat memory at ``path``; batches that can't be written are reported through ``fail`` and the stream goes on."""

    def write(batch: DataFrame, number: int) -> None:
        try:
            chat_entries(batch).write.mode("append").parquet(path)
        except Exception as e:  # noqa: BLE001  an archive must not end the chat
            fail(f"batch {number}: {e}")

    return turns.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
