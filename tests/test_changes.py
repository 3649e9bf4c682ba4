"""Change detection over a stream, damaged versions, and writing what changed."""

import datetime as dt
import os
from pathlib import Path

from pyspark.sql import functions as F

from quillspark.operators import state
from quillspark.streaming import events

FILES = "path string, mtime timestamp, text string"


def day(n):
    return dt.datetime(2024, 1, n)


RUNS = [
    [("a", day(1), "one"), ("b", day(1), "two"), (None, day(1), "lost")],
    [("a", day(2), "one"), ("b", day(1), "new text, old time"), ("c", day(2), None)],
    [("a", day(3), "three"), ("c", day(3), "more"), ("c", day(4), "more"), ("d", day(1), "d")],
]
WANT = [{("a", "new"), ("b", "new")}, {("a", "drift"), ("b", "same"), ("c", "new")}, {("a", "changed"), ("c", "changed"), ("c", "drift"), ("d", "new")}]


def test_changes_survive_restarts_and_missed_runs(spark, tmp_path):
    def run(folder, checkpoint):
        got = []
        stream = events.changes(spark.readStream.schema(FILES).option("maxFilesPerTrigger", 1).parquet(folder))
        q = stream.writeStream.foreachBatch(lambda df, _: got.append({(r["path"], r["status"]) for r in df.collect()})).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
        return [x for x in got if x]

    each, whole = str(tmp_path / "each"), []
    for k, rows in enumerate(RUNS):  # a restart after every run
        spark.createDataFrame(rows, FILES).coalesce(1).write.mode("append").parquet(each)
        whole += run(each, str(tmp_path / "c1"))
    assert whole == WANT
    assert run(each, str(tmp_path / "c1")) == []  # nothing is repeated
    old, batch = spark.createDataFrame([], state.EMPTY_STATE), []
    for rows in RUNS[:2]:
        snapshot = spark.createDataFrame([(p, t, x or "") for p, t, x in rows if p], FILES).withColumn("mtime", F.col("mtime").cast("timestamp_ntz"))
        scanned = state.scan(snapshot, old, "daily")
        batch.append({(r["path"], r["status"]) for r in scanned.collect()})
        old = state.committed(scanned, old, "daily", F.lit("2024-01-05").cast("timestamp_ntz"))
    assert batch == WANT[:2]


def test_a_damaged_version_is_passed_over(spark, tmp_path):
    path = str(tmp_path / "state")
    rows = lambda n: spark.createDataFrame([("daily", f"p{n}", day(n), "h", day(n))], state.EMPTY_STATE)
    state.publish(rows(1), path, 1)
    state.publish(rows(2), path, 2)
    assert [r["path"] for r in state.read_state(spark, path).collect()] == ["p2"]
    newest = max(p for p in os.listdir(path) if p.startswith("v"))
    for p in Path(path, newest).glob("*.parquet"):
        p.write_bytes(b"PAR1 damaged PAR1")
        p.with_name(f".{p.name}.crc").unlink(missing_ok=True)
    assert [r["path"] for r in state.read_state(spark, path).collect()] == ["p1"]
    assert state.read_state(spark, str(tmp_path / "none")).count() == 0


def test_only_changed_buckets_are_written(spark, tmp_path):
    path = str(tmp_path / "cards")
    table = lambda **over: spark.createDataFrame([(f"k{i}", over.get(f"k{i}", "text")) for i in range(40) if over.get(f"k{i}", "") is not None], "path string, text string")
    files = lambda: {p: p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}
    back = lambda: {r["path"]: r["text"] for r in spark.read.parquet(path).collect()}
    assert len(state.write_changed(table(), path, "path", 16)) > 8
    before = files()
    assert state.write_changed(table(), path, "path", 16) == [] and files() == before
    assert len(state.write_changed(table(k3="other", k4=None), path, "path", 16)) in (1, 2)
    assert back() == {f"k{i}": "other" if i == 3 else "text" for i in range(40) if i != 4}
    assert len(before.keys() & files().keys()) >= len(before) - 2
    gone = next(iter(files()))
    gone.unlink()
    state.write_changed(table(k3="other", k4=None), path, "path", 16)
    assert len(back()) == 39
    state.write_changed(table().limit(0), path, "path", 16)
    assert files() == {}


def test_large_tables_in_few_files_are_dealt(spark, tmp_path, monkeypatch):
    """A file's row group is one task's, so that a large table in one file is dealt into parts of a bounded size."""
    from quillspark.sources import notes

    spark.range(20_000).selectExpr("id doc_id", "md5(cast(id as string)) text").coalesce(1).write.parquet(f"{tmp_path}/t.parquet")
    monkeypatch.setattr(notes, "SPREAD_BYTES", 1000)
    monkeypatch.setattr(notes, "PART_BYTES", 50_000, raising=False)
    df = notes.table(spark, f"{tmp_path}/t.parquet")
    assert df.rdd.getNumPartitions() > 4 and df.count() == 20_000
