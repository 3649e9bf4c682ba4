"""State, graph, similarity, verdicts and streaming on small tables."""

import datetime as dt

from pyspark.sql import functions as F

from quillspark.functions import taxonomy as tx
from quillspark.operators import graph, similarity, state, verdicts
from quillspark.sources import notes as src
from quillspark.streaming import events

T0, T1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 5)
SNAP = "path string, mtime timestamp_ntz, text string"


def test_change_detection(spark):
    md5 = lambda t: __import__("hashlib").md5(t.encode()).hexdigest()
    old = spark.createDataFrame([("t", p, T0 if p != "older" else T1, md5("x"), T0) for p in ("same", "drift", "changed", "older", "gone")] + [("other", "p", T0, "h", T0)], state.EMPTY_STATE)
    snap = spark.createDataFrame([("new", T1, "n"), ("same", T0, "x"), ("drift", T1, "x"), ("changed", T1, "y"), ("older", T0, "y")], SNAP)
    got = {r["path"]: r["status"] for r in state.scan(snap, old, "t").collect()}
    assert got == {"new": "new", "same": "same", "drift": "drift", "changed": "changed", "older": "same"}
    assert {r["path"] for r in state.scan(snap, old, "t", always_hash=True).where("status = 'changed'").collect()} == {"changed", "older"}
    now = F.lit("2024-02-01").cast("timestamp_ntz")
    nxt = state.committed(state.scan(snap, old, "t"), old, "t", now)
    assert {r["path"] for r in nxt.where("task = 't'").collect()} == {"new", "same", "drift", "changed", "older"}
    assert state.incremental(state.scan(snap.where("path <> 'older'"), nxt, "t")).count() == 0
    assert state.reset(nxt, "t").count() == 1


def test_state_versions(spark, tmp_path):
    path = str(tmp_path / "state")
    assert state.read_state(spark, path).count() == 0
    s = spark.createDataFrame([("t", "p", T0, "h", T0)], state.EMPTY_STATE)
    state.publish(s, path, 1)
    state.publish(state.read_state(spark, path).unionByName(s), path, 2)
    assert state.read_state(spark, path).count() == 2
    assert state.last_run(state.read_state(spark, path)).first()["last_run_at"] == T0


def test_manual_rows_stay(spark):
    schema = "path string, category string, category_source string"
    o = spark.createDataFrame([("a", "m", "manual"), ("b", "k", "keyword"), ("c", "m", "manual"), ("z", "k", "keyword")], schema)
    n = spark.createDataFrame([("a", "n", "keyword"), ("b", "n", "llm"), ("c", "n", "manual"), ("d", "n", "llm")], schema)
    assert {r["path"]: r["category"] for r in state.upsert(o, n).collect()} == {"a": "m", "b": "n", "c": "n", "d": "n", "z": "k"}


def test_folder_reader(spark, tmp_path):
    (tmp_path / "a" / ".git").mkdir(parents=True)
    (tmp_path / "a" / "n.md").write_text("héllo")
    (tmp_path / "a" / "x.txt").write_text("no")
    (tmp_path / "a" / ".git" / "m.md").write_text("no")
    got = src.read_folder(spark, str(tmp_path)).collect()
    assert [(r["name"], r["text"]) for r in got] == [("n", "héllo")]


def test_backlinks_and_health(spark):
    rows = [("a", "[[b]] [[b|x]] [[a]] [[nope]]"), ("b", "text"), ("README", "[[b]]"), ("c", "")]
    n = spark.createDataFrame([(k, f"{k}.md", "inbox" if k != "c" else "skills", "x", T0, t) for k, t in rows], "name string, path string, layer string, bucket string, mtime timestamp_ntz, text string")
    got = {r["name"]: r for r in graph.assets(n, F.lit("2024-01-06")).collect()}
    assert (got["b"]["backlinks"], got["b"]["curated_backlinks"], got["a"]["backlinks"]) == (3, 2, 1)
    assert got["c"]["orphan"]
    assert not got["README"]["orphan"]
    stats = {r["layer"]: r for r in graph.layer_stats(graph.assets(n, F.lit("2024-01-06")), spark).collect()}
    assert stats["output"]["health"] == "空"
    assert stats["skills"]["health"] == "需整理"
    assert len(stats) == 5


def test_small_tfidf(spark):
    bag = spark.createDataFrame([("1", "alpha"), ("1", "beta"), ("2", "alpha"), ("2", "gamma")], "key string, term string")
    got = {r["term"]: (round(r["idf"], 6), round(r["mean_idf"], 6)) for r in similarity.idf(bag).collect()}
    assert got["alpha"] == (1.0, 1.27031)
    assert got["beta"][0] == 1.405465
    s = similarity.shared_terms(bag.where("key = '1'"), bag.where("key = '2'"), similarity.idf(bag))
    assert s.select(similarity.keyword_points(s).alias("p"), similarity.keyword_points(s, "legacy").alias("q")).first()[:] == (2, 2)


def test_pruned_pairs_equal_the_product(spark):
    words = ["the", "der", "license", "dans", "los", "ein", "con", "was", "avec"]
    mk = lambda k, n: [(f"{k}{i}", f"DRAFT_n{i}" if i % 3 else f"n{i * 7 % 11}", list(tx.SAMPLE["contentTypes"])[i % 4], " ".join(words[(i * j) % 9] for j in range(1, 5))) for i in range(n)]
    schema = "key string, name string, ctype string, text string"
    c, i = spark.createDataFrame(mk("c", 14), schema), spark.createDataFrame(mk("i", 17), schema)
    pc, pi = similarity.profile(c, tx.SAMPLE, "clip"), similarity.profile(i, tx.SAMPLE, "idea")
    got = similarity.scored_pairs(c, i, tx.SAMPLE, threshold=34)
    x = pc.select(F.col("key").alias("a"), F.col("name").alias("an"), "ctype", F.col("themes").alias("ct"), F.col("domains").alias("cd")).crossJoin(pi.select(F.col("key").alias("b"), F.col("name").alias("bn"), F.col("themes").alias("it"), F.col("domains").alias("id")))
    d = sum((F.get(F.zip_with("cd", "id", lambda p, q: p * q), F.lit(k)) * r["score"] for k, r in enumerate(tx.SAMPLE["domainRules"])), F.lit(0))
    base = similarity.title_points(F.col("an"), F.col("bn")) + similarity.theme_points(F.col("ct"), F.col("it")) + similarity.bridge_points(F.col("ctype"), F.col("it"), tx.SAMPLE["bridges"]) + d
    least = x.where("an <> bn").select("a", "b", base.alias("base")).where("base >= 34").collect()
    found = {(r["a"], r["b"]): r["base"] for r in got.collect()}
    assert least
    assert all(found[r["a"], r["b"]] == r["base"] for r in least)


def test_batches_and_verdicts(spark):
    pack = lambda sizes: [r["batch"] for r in verdicts.batches(spark.createDataFrame([("g", k, n) for k, n in enumerate(sizes)], "g string, k long, n int"), "g", "k", F.col("n")).orderBy("k").collect()]
    assert pack([10] * 9) == [0] * 8 + [1]
    assert pack([7000, 7000]) == [0, 1]
    rows = spark.createDataFrame([("a", "?"), ("b", "ok"), ("c", "?")], "k string, v string")
    v = spark.createDataFrame([("a", "yes"), ("b", "no"), ("c", "null")], "k string, value string")
    assert {r["k"]: r["v"] for r in verdicts.backfill(rows, v, "k", "v", F.col("v") == "?").collect()} == {"a": "yes", "b": "ok", "c": "?"}
    j = spark.createDataFrame([('{"a":1}',), ('x ```json\n{"a":2}\n``` y',), ('say {"a":3} end',), ("none",)], "r string").select(verdicts.json_block(F.col("r")).alias("j"))
    assert [r["j"] for r in j.collect()] == ['{"a":1}', '{"a":2}', '{"a":3}', None]


def test_approved_lines(spark):
    lines = ["# report", "- [x] → [[lost]] · no heading", "### [[A]]", "- [x] → [[B]] · good", "- [ ] → [[C]] · no", "### [[D]]", "- [X] → [[E]] · fine"]
    df = spark.createDataFrame([("r", k, x) for k, x in enumerate(lines)], "report string, pos int, line string")
    got = graph.approved(df).orderBy("pos").collect()
    assert [(r["source"], r["target"], r["reason"]) for r in got] == [("A", "B", "good"), ("D", "E", "fine")]
    notes = spark.createDataFrame([("A", "text")], "name string, text string")
    rows, missing = graph.apply_approved(notes, graph.approved(df))
    assert [r["changed"] for r in rows.collect()] == [True]
    assert [r["name"] for r in missing.collect()] == ["D"]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1 + i % 3, i % 24), i % 4, "click", float(i), "{}") for i in range(60)]
    df = spark.createDataFrame(rows, events.SCHEMA)
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    got = {}

    def keep(batch, _):
        for r in events.daily(batch).collect():
            got[r["day"], r["event_type"]] = got.get((r["day"], r["event_type"]), 0) + r["n"]

    events.run_available(events.unique(events.read(spark, str(tmp_path / "in"))), str(tmp_path / "cp"), keep)
    assert got == {(r["day"], r["event_type"]): r["n"] for r in events.daily(df).collect()}
    events.run_available(events.unique(events.read(spark, str(tmp_path / "in"))), str(tmp_path / "cp"), keep)
    assert sum(got.values()) == 60


def test_no_python_in_plans(spark):
    from quillspark.plans import registry

    for name in ("cls_multilabel", "span_points", "txt_clean_clipping", "sim_tfidf", "agg_assets"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
        assert "Python" not in plan
        assert "ArrowEval" not in plan
    assert "CartesianProduct" not in registry.QUERIES["join_bridge"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_methods_are_found_once(spark):
    """A filter on their number, pushed below the texts' repartition, would find them twice."""
    from quillspark.plans import classify_queries

    count = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("验证|使用|运行")
    rows = classify_queries.agg_methods_excerpt(spark, "/root/testdata/sf0.001")
    assert count(rows) == count(classify_queries.analysed(spark, "/root/testdata/sf0.001").select("methods")) > 0
    assert rows.where("method is null").count() == 0 < rows.count() <= 15
