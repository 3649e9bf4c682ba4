"""Structured Streaming counterparts: change feeds, windows, staleness, idempotent replay."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillspark.functions.text import file_hash

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def daily(events: DataFrame, late: str = "2 days") -> DataFrame:
    """(day, event_type, n, total) per tumbling day; works on streams and tables alike."""
    e = _timed(events, late)
    return e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.to_date("w.start").alias("day"), "event_type", "n", "total")


def sliding(events: DataFrame, late: str = "2 days") -> DataFrame:
    """(day, n): the seven days that start with a day."""
    return _timed(events, late).groupBy(F.window("ts", "7 days", "1 day").alias("w")).agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    return _timed(events, late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def staleness(events: DataFrame, as_of, recent: int = 7, cold: int = 30) -> DataFrame:
    last = events.groupBy("user_id").agg(F.max("ts").alias("last_seen"))
    age = F.datediff(as_of.cast("date"), F.to_date("last_seen"))
    return last.select("user_id", "last_seen", age.alias("age_days"), F.when(age <= recent, "recent").when(age > cold, "cold").otherwise("idle").alias("state"))


def unique(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Each event once, however often it is replayed within the lateness."""
    return _timed(events, late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def _timed(events: DataFrame, late: str) -> DataFrame:
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return e.withWatermark("ts", late) if events.isStreaming else e


def read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).parquet(folder)


def run_available(stream: DataFrame, checkpoint: str, write_batch) -> None:
    """Process all that is there, once; write_batch(batch, id) must be idempotent, as a batch is repeated
    after a failure. Files that were changed in place need state.scan() inside it."""
    stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


CHANGES = "path string, mtime timestamp, hash string, status string"


def _status(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The status of a path's versions in the order of their mtime, against the last one that counted."""
    rows = list(parts)  # of one path in one batch
    rows = rows[0] if len(rows) == 1 else pd.concat(rows)
    if len(rows) > 1:  # mostly one file a path
        rows = rows.sort_values(["mtime", "hash"], kind="stable")
    old, found = (state.get if state.exists else None), []
    for mtime, digest in zip(rows["mtime"], rows["hash"], strict=True):
        at = mtime.value
        status = "new" if old is None else "same" if at <= old[0] else "changed" if digest != old[1] else "drift"
        if status != "same":
            old = (at, digest)
        found.append(status)
    state.update(old)
    yield pd.DataFrame({"path": key[0], "mtime": rows["mtime"].to_numpy(), "hash": rows["hash"].to_numpy(), "status": found})


def changes(snapshots: DataFrame) -> DataFrame:
    """A stream of files (path, mtime timestamp, text) as (path, mtime, hash, status), each against what was seen before.

    status is new, changed, drift (a later mtime alone) or same, as state.scan() has it for tables. What is remembered of a path
    is its mtime and hash, in the query's checkpoint: after a restart, or after any number of missed runs, the next
    files are compared with the last ones that were committed. Texts are hashed where they are read. Rows without a
    path or mtime are left out.
    """
    rows = snapshots.where("path is not null and mtime is not null").select("path", "mtime", file_hash(F.coalesce("text", F.lit(""))).alias("hash"))
    return rows.groupBy("path").applyInPandasWithState(_status, CHANGES, "mtime long, hash string", "append", GroupStateTimeout.NoTimeout)
