"""Queries over incremental state, catalog, windows and verdicts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillspark.operators import state, verdicts
from quillspark.shared import shared_dir
from quillspark.sources import notes as src
from quillspark.streaming import events as ev

from . import sql
from .registry import query

_DAY = "to_days(1)"
_SNAP = f"""WITH {sql.NOTES}, a AS (SELECT path, mtime, md5(left(text, 1000000)) AS hash FROM (SELECT * REPLACE (CASE WHEN doc_id % 10 = 0 THEN 'gone/' || path ELSE path END AS path) FROM notes)),
b AS (SELECT CASE WHEN doc_id % 13 = 0 THEN 'new/' || path ELSE path END AS path, CASE WHEN doc_id % 7 IN (0, 1) THEN mtime + {_DAY} ELSE mtime END AS mtime, CASE WHEN doc_id % 7 = 0 THEN text || ' edited' ELSE text END AS text FROM notes),
s AS (SELECT b.path, CASE WHEN a.path IS NULL THEN 'new' WHEN b.mtime <= a.mtime THEN 'same' WHEN md5(b.text) <> a.hash THEN 'changed' ELSE 'drift' END AS status, b.mtime, md5(b.text) AS hash FROM b LEFT JOIN a USING (path))"""


def before(spark, d):
    """All notes, some under paths that after() no longer has."""
    n = src.notes(spark, d).withColumn("path", F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("gone/"), "path")).otherwise(F.col("path")))
    return n.select(F.lit("daily").alias("task"), "path", "mtime", F.md5(F.substring(F.col("text").cast("binary"), 1, 1_000_000)).alias("hash"), F.lit("2024-04-01").cast("timestamp_ntz").alias("last_run_at"))


def after(spark, d):
    moved = F.when((F.col("doc_id") % 7).isin(0, 1), F.col("mtime") + F.expr("make_interval(0, 0, 0, 1)")).otherwise(F.col("mtime"))
    text = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" edited"))).otherwise(F.col("text"))
    path = F.when(F.col("doc_id") % 13 == 0, F.concat(F.lit("new/"), "path")).otherwise(F.col("path"))
    return src.notes(spark, d).select(path.alias("path"), moved.alias("mtime"), text.alias("text"))


@query(f"{_SNAP} SELECT path, status FROM s")
def state_incremental(spark, d):
    return state.scan(after(spark, d), before(spark, d), "daily").select("path", "status")


@query(f"{_SNAP} SELECT path, hash, mtime FROM s")
def state_commit(spark, d):
    old = before(spark, d)
    return state.committed(state.scan(after(spark, d), old, "daily"), old, "daily", F.lit("2024-05-01").cast("timestamp_ntz")).select("path", "hash", "mtime")


@query(f"{_SNAP} SELECT status, count(*) AS n FROM s GROUP BY status")
def state_status_counts(spark, d):
    return state.scan(after(spark, d), before(spark, d), "daily").groupBy("status").agg(F.count("*").alias("n"))


@query(f"{_SNAP} SELECT path, status FROM s")
def stream_changes(spark, d):
    """The same statuses from a stream: both snapshots arrive as files, one run of the query after the other."""
    at = f"{shared_dir(spark)}/changes-{uuid.uuid4().hex}"
    first = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("gone/"), "path")).otherwise(F.col("path")).alias("path")
    for k, snapshot in enumerate((src.notes(spark, d).select(first, "mtime", "text"), after(spark, d))):
        snapshot.withColumn("mtime", F.col("mtime").cast("timestamp")).write.mode("append").parquet(f"{at}/files")
        found = ev.changes(spark.readStream.schema("path string, mtime timestamp, text string").parquet(f"{at}/files"))
        ev.run_available(found, f"{at}/checkpoint", lambda df, n, k=k: df.write.mode("overwrite").parquet(f"{at}/found/run={k}/batch={n}"))
    return spark.read.parquet(f"{at}/found/run=1").select("path", "status")


@query(f"WITH {sql.NOTES} SELECT path FROM notes WHERE mtime >= TIMESTAMP '2024-05-01' - to_days(30)")
def state_time_window(spark, d):
    return state.since(src.notes(spark, d), F.lit("2024-05-01").cast("timestamp_ntz"), 30).select("path")


_CATALOG = "o AS (SELECT 'd' || doc_id AS path, CASE WHEN quality = 1 THEN 'keep' ELSE 'drop' END AS category, CASE WHEN doc_id % 2 = 0 THEN 'manual' ELSE 'keyword' END AS category_source FROM labels), n AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'd' ELSE 'x' END || doc_id AS path, lang AS category, CASE WHEN doc_id % 5 = 0 THEN 'manual' ELSE 'llm' END AS category_source FROM documents)"


def catalogs(spark, d):
    path = F.concat(F.lit("d"), "doc_id").alias("path")
    o = spark.read.parquet(f"{d}/labels.parquet").select(path, F.when(F.col("quality") == 1, "keep").otherwise("drop").alias("category"), F.when(F.col("doc_id") % 2 == 0, "manual").otherwise("keyword").alias("category_source"))
    n = spark.read.parquet(f"{d}/documents.parquet").select(F.concat(F.when(F.col("doc_id") % 3 == 0, "d").otherwise("x"), "doc_id").alias("path"), F.col("lang").alias("category"), F.when(F.col("doc_id") % 5 == 0, "manual").otherwise("llm").alias("category_source"))
    return o, n


@query(f"WITH {_CATALOG} SELECT coalesce(n.path, o.path) AS path, CASE WHEN n.path IS NULL OR (o.category_source = 'manual' AND n.category_source <> 'manual') THEN o.category ELSE n.category END AS category, CASE WHEN n.path IS NULL OR (o.category_source = 'manual' AND n.category_source <> 'manual') THEN o.category_source ELSE n.category_source END AS category_source FROM o FULL JOIN n USING (path)")
def catalog_upsert_manual_guard(spark, d):
    return state.upsert(*catalogs(spark, d))


@query(f"WITH {_CATALOG} SELECT path, category FROM o WHERE path IN (SELECT path FROM n)")
def catalog_prune(spark, d):
    o, n = catalogs(spark, d)
    return state.prune(o, n).select("path", "category")


@query(f"WITH {_CATALOG} SELECT path FROM o WHERE path NOT IN (SELECT path FROM n)")
def join_anti_missing(spark, d):
    o, n = catalogs(spark, d)
    return state.missing(o, n).select("path")


@query(f"WITH {_CATALOG} SELECT path FROM n EXCEPT SELECT path FROM o")
def set_except_missing(spark, d):
    o, n = catalogs(spark, d)
    return n.select("path").subtract(o.select("path"))


@query(f"WITH {_CATALOG} SELECT path, category FROM o UNION ALL SELECT path, category FROM n")
def set_union_corpus(spark, d):
    o, n = catalogs(spark, d)
    return o.select("path", "category").unionByName(n.select("path", "category"))


@query(f"{_SNAP} SELECT s.path, a.hash AS known FROM s LEFT JOIN a USING (path)")
def join_left_state(spark, d):
    return after(spark, d).select("path").join(before(spark, d).select("path", F.col("hash").alias("known")), "path", "left")


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 AND quality IS NOT NULL THEN CASE quality WHEN 1 THEN 'yes' ELSE 'no' END ELSE 'rule' END AS verdict FROM documents LEFT JOIN labels USING (doc_id)")
def join_backfill(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.lit("rule").alias("verdict"))
    v = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", F.when(F.col("quality") == 1, "yes").otherwise("no").alias("value"))
    return verdicts.backfill(docs, v, "doc_id", "verdict", F.col("doc_id") % 4 == 0)


@query("SELECT md5(concat_ws('|', 's1', 'v1', 'm', text)) AS key, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def llm_cache_keys(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select(verdicts.cache_key("s1", "v1", "m", F.col("text")).alias("key"), "doc_id").groupBy("key").agg(F.min("doc_id").alias("doc_id"))


@query(
    """WITH RECURSIVE d AS (SELECT source, doc_id, coalesce(length(text), 0) + 64 AS s, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
b AS (SELECT source, i, 0 AS batch, 1 AS n, s AS c FROM d WHERE i = 1
 UNION ALL SELECT d.source, d.i, CASE WHEN b.n >= 8 OR b.c + d.s > 12000 THEN b.batch + 1 ELSE b.batch END, CASE WHEN b.n >= 8 OR b.c + d.s > 12000 THEN 1 ELSE b.n + 1 END, CASE WHEN b.n >= 8 OR b.c + d.s > 12000 THEN d.s ELSE b.c + d.s END FROM b JOIN d ON d.source IS NOT DISTINCT FROM b.source AND d.i = b.i + 1)
SELECT d.source, batch, doc_id FROM b JOIN d ON d.source IS NOT DISTINCT FROM b.source AND d.i = b.i"""
)
def llm_batches(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("source", "doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    return verdicts.batches(docs, "source", "doc_id", F.col("n"))


_FIELDS = "WITH v AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'null' WHEN 1 THEN ' ' WHEN 2 THEN NULL ELSE 'said ' || lang END AS inputs, CASE doc_id % 6 WHEN 0 THEN '7' WHEN 1 THEN '-3' WHEN 2 THEN ' 4 ' WHEN 3 THEN 'many' ELSE NULL END AS steps FROM documents)"


@query(f"{_FIELDS} SELECT doc_id, CASE WHEN inputs <> 'null' AND trim(inputs) <> '' THEN inputs ELSE 'rule' END AS inputs, CASE WHEN inputs <> 'null' AND trim(inputs) <> '' THEN 'ai_infer' ELSE 'regex' END AS inputs_source, CASE doc_id % 6 WHEN 0 THEN 7 WHEN 1 THEN 0 WHEN 2 THEN 4 ELSE 1 END AS steps FROM v")
def llm_overwritten_fields(spark, d):
    i = F.col("doc_id")
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang")
    said = F.when(i % 5 == 0, "null").when(i % 5 == 1, " ").when(i % 5 >= 3, F.concat(F.lit("said "), "lang"))
    steps = F.when(i % 6 == 0, "7").when(i % 6 == 1, "-3").when(i % 6 == 2, " 4 ").when(i % 6 == 3, "many")
    base = rows.select("doc_id", F.lit("rule").alias("inputs"), F.lit("regex").alias("inputs_source"), F.lit(1).alias("steps"))
    return verdicts.overwritten(base, rows.select("doc_id", said.alias("inputs"), steps.alias("steps")), "doc_id", ["inputs"], "steps")


@query(f"WITH {sql.NOTES}, f AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS i FROM notes WHERE layer = 'output' ORDER BY doc_id LIMIT 50) SELECT string_agg(i || '. ' || name || chr(10) || left(text, 300), chr(10) || chr(10) ORDER BY i) AS prompt FROM f")
def llm_prompt(spark, d):
    return verdicts.numbered_prompt(src.notes(spark, d).where("layer = 'output'"), "doc_id", "name", "text")


@query("SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, strftime(date_trunc('quarter', ts), '%Y-%m-%d') AS quarter, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_calendar_buckets(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    day = lambda unit: F.date_format(F.date_trunc(unit, "ts"), "yyyy-MM-dd")
    return e.groupBy(day("week").alias("week"), day("quarter").alias("quarter"), "event_type").agg(F.count("*").alias("n"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_daily_window(spark, d):
    return ev.daily(spark.read.parquet(f"{d}/events.parquet")).withColumn("day", F.col("day").cast("string"))


@query("WITH e AS (SELECT CAST(date_trunc('day', ts) AS DATE) AS day FROM events), k AS (SELECT day - CAST(i AS INTEGER) AS day FROM e, range(7) r(i)) SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS n FROM k GROUP BY day")
def stream_sliding_7d(spark, d):
    return ev.sliding(spark.read.parquet(f"{d}/events.parquet")).withColumn("day", F.col("day").cast("string"))


@query("WITH l AS (SELECT user_id, max(ts) AS last_seen FROM events GROUP BY user_id) SELECT user_id, last_seen, date_diff('day', CAST(last_seen AS DATE), DATE '2024-02-03') AS age_days, CASE WHEN date_diff('day', CAST(last_seen AS DATE), DATE '2024-02-03') <= 7 THEN 'recent' WHEN date_diff('day', CAST(last_seen AS DATE), DATE '2024-02-03') > 30 THEN 'cold' ELSE 'idle' END AS state FROM l")
def stream_staleness(spark, d):
    return ev.staleness(spark.read.parquet(f"{d}/events.parquet"), F.lit("2024-02-03"))


_STAMP = "'%Y-%m-%d %H:%M:%S.%f'"


@query(
    f"""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
i AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS nth FROM e WHERE ts IS NOT NULL)
SELECT user_id, strftime(min(ts), {_STAMP}) AS start, strftime(max(ts) + INTERVAL 30 MINUTE, {_STAMP}) AS "end", count(*) AS n FROM i GROUP BY user_id, nth"""
)
def stream_sessions(spark, d):
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return ev.sessions(spark.read.parquet(f"{d}/events.parquet")).select("user_id", stamp("start"), stamp("end"), "n")


@query()
def ext_approx_distinct(spark, d):
    return src.notes(spark, d).groupBy("layer").agg(F.approx_count_distinct("bucket", 0.01).alias("buckets"))


@query(f"WITH {sql.NOTES} SELECT layer, bucket, count(*) AS n FROM notes GROUP BY ROLLUP (layer, bucket)")
def ext_rollup_layer_bucket(spark, d):
    return src.notes(spark, d).rollup("layer", "bucket").agg(F.count("*").alias("n"))
