"""Incremental state and the classification catalog, as versioned tables.

State rows are (task, path, mtime, hash, last_run_at). A new version is computed from a full snapshot and
the last version, and published only after the results are written: reruns repeat work, none is lost.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException as SparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import file_hash

EMPTY_STATE = "task string, path string, mtime timestamp_ntz, hash string, last_run_at timestamp_ntz"


def scan(snapshot: DataFrame, state: DataFrame, task: str, always_hash: bool = False) -> DataFrame:
    """snapshot (path, mtime, text) with status new, changed, drift or same, and the hash to remember.

    A file whose mtime has not moved on is the same; else its content decides, and drift is a moved
    mtime alone. always_hash compares content whatever the mtime, which also sees restored old files.
    """
    old = state.where(F.col("task") == task).select("path", F.col("mtime").alias("old_mtime"), F.col("hash").alias("old_hash"))
    rows = snapshot.join(old, "path", "left")
    now = file_hash(F.col("text"))
    kept = F.col("mtime") <= F.col("old_mtime")
    skip = F.lit(False) if always_hash else kept
    rows = rows.withColumn("hash", F.when(F.col("old_hash").isNotNull() & skip, F.col("old_hash")).otherwise(now))
    status = F.when(F.col("old_hash").isNull(), "new").when(skip, "same").when(F.col("hash") != F.col("old_hash"), "changed").when(kept, "same").otherwise("drift")
    return rows.withColumn("status", status).withColumn("state_mtime", F.when(F.col("status") == "same", F.col("old_mtime")).otherwise(F.col("mtime")))


def incremental(scanned: DataFrame) -> DataFrame:
    return scanned.where(F.col("status").isin("new", "changed"))


def committed(scanned: DataFrame, state: DataFrame, task: str, now: Column) -> DataFrame:
    """The next state version: this task's rows are those of the scan, so vanished files drop out."""
    mine = scanned.select(F.lit(task).alias("task"), "path", F.col("state_mtime").alias("mtime"), "hash", now.alias("last_run_at"))
    return state.where(F.col("task") != task).unionByName(mine)


def reset(state: DataFrame, task: str) -> DataFrame:
    return state.where(F.col("task") != task)


def last_run(state: DataFrame) -> DataFrame:
    return state.groupBy("task").agg(F.max("last_run_at").alias("last_run_at"))


def read_state(spark: SparkSession, path: str, schema: str = EMPTY_STATE) -> DataFrame:
    """The newest whole version under a folder; an empty table if there is none. A version that was not finished, or of which a
    file cannot be read, counts for nothing."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    versions = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    for v in sorted((v for v in versions if v.startswith("v") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{v}/_SUCCESS"))), reverse=True):
        found = spark.read.schema(schema).parquet(f"{path}/{v}")
        try:
            found.write.format("noop").mode("overwrite").save()
        except (SparkException, Py4JJavaError):  # a damaged file
            continue
        return found
    return spark.createDataFrame([], schema)


def publish(state: DataFrame, path: str, version: int) -> None:
    """Write a version beside the older ones: a path that is being read is never overwritten."""
    state.write.parquet(f"{path}/v{version:012d}")


def since(notes: DataFrame, as_of: Column, days: int) -> DataFrame:
    return notes.where(F.col("mtime") >= as_of - F.expr(f"make_interval(0, 0, 0, {int(days)})"))


def upsert(catalog: DataFrame, new: DataFrame, key: str = "path", source: str = "category_source") -> DataFrame:
    """New rows win, except that a manual row yields to manual rows alone. Same columns on both sides."""
    o, n = catalog.alias("o"), new.alias("n")
    keep = (F.col(f"o.{source}") == "manual") & (F.col(f"n.{source}") != "manual")
    use_old = F.col(f"n.{key}").isNull() | F.coalesce(keep, F.lit(False))
    cols = [F.when(use_old, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in catalog.columns]
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full").select(*cols)


def prune(catalog: DataFrame, present: DataFrame, key: str = "path") -> DataFrame:
    return catalog.join(present.select(key), key, "left_semi")


def missing(catalog: DataFrame, present: DataFrame, key: str = "path") -> DataFrame:
    return catalog.join(present.select(key), key, "left_anti")


def by_category(catalog: DataFrame, other: str) -> DataFrame:
    """(category, n) of the catalog view; rows without categories count as other."""
    cats = F.when(F.size("categories") > 0, F.col("categories")).otherwise(F.array(F.lit(other)))
    return catalog.select(F.explode(cats).alias("category")).groupBy("category").agg(F.count("*").alias("n"))


def category_rank(category: Column, known: list[str], other: str) -> Column:
    """Known categories in their order, then other, then unknown ones; ties go by name."""
    order = [*known, other]
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for i, k in enumerate(order) for x in (k, i))), category), F.lit(len(order)))


def document_hash(text: Column, most: int = 12_000) -> Column:
    """md5 of the text as far as it is read for classification."""
    return F.md5(F.left(text, F.lit(most)))


def pending(classified: DataFrame, other: str) -> DataFrame:
    """(path, name, reason) of notes for review: no_match if no type fits, else llm_proposal if there are
    proposals (a column proposals, if classified has one)."""
    proposed = F.size("proposals") > 0 if "proposals" in classified.columns else F.lit(False)
    reason = F.when(F.array_contains("categories", other), "no_match").when(proposed, "llm_proposal")
    return classified.select("path", "name", reason.alias("reason")).where("reason is not null")


def queued(queue: DataFrame, new: DataFrame) -> DataFrame:
    """The review queue with new rows in place of older ones of the same path."""
    return queue.join(new.select("path"), "path", "left_anti").unionByName(new)


def first_with_rest(rows: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows in an order, each with the number of rows left out."""
    n = rows.agg(F.greatest(F.count("*") - k, F.lit(0)).alias("rest")).withColumn("one", F.lit(1))
    return rows.orderBy(*order).limit(k).withColumn("one", F.lit(1)).join(n, "one").drop("one")  # one row


def resolve_pending(queue: DataFrame, classified: DataFrame, other: str) -> DataFrame:
    """The queue without those that have since found a type."""
    done = classified.where(~F.array_contains("categories", other)).select("path")
    return queue.join(done, "path", "left_anti")


def write_changed(rows: DataFrame, path: str, key: str, buckets: int = 64) -> list[int]:
    """Bring a stored table up to date, and give the buckets that were written.

    Keys are dealt into buckets, one folder each. A bucket is compared by its number of rows and a digest of all their
    cells; only those that differ (with new, changed or removed keys, or with files that are gone) are written, by dynamic
    partition overwrite. An unchanged table is not touched. The buckets' digests are all that reaches the driver.
    """
    spark = rows.sparkSession
    dealt = rows.withColumn("bucket_", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    digest = lambda df: {r["bucket_"]: (r["n"], r["a"], r["b"]) for r in df.groupBy("bucket_").agg(F.count("*").alias("n"), F.expr(f"sum(cast(xxhash64({', '.join(f'`{c}`' for c in rows.columns)}) as decimal(38,0)))").alias("a"), F.expr(f"sum(cast(xxhash64(1, {', '.join(f'`{c}`' for c in rows.columns)}) as decimal(38,0)))").alias("b")).collect()}  # noqa: E731  a row a bucket
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    there = fs.exists(at) and any(s.getPath().getName().startswith("bucket_=") for s in fs.listStatus(at))
    old = digest(spark.read.schema(dealt.schema).parquet(path)) if there else {}
    new = digest(dealt)
    differ = sorted(k for k in new if new[k] != old.get(k))
    if differ:
        dealt.where(F.col("bucket_").isin(differ)).repartition("bucket_").write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("bucket_").parquet(path)
    gone = sorted(set(old) - set(new))
    for k in gone:  # no row is left to overwrite it with
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket_={k}"), True)
    return sorted(differ + gone)
