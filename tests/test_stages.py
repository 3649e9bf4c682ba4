import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillspark.functions import schedule
from quillspark.operators import state
from quillspark.plans import stages

NOTES = "path string, name string, layer string, bucket string, mtime timestamp_ntz, text string"


def test_all_stages(spark, tmp_path):
    t = dt.datetime(2024, 4, 20)
    body = "先建立输入清单，再整理输出结果，最后复盘流程。真正重要的不是努力，而是选择方向。the der nicht license"
    rows = [(f"in/{k}.md", f"note{k}", "inbox", "ideas" if k % 2 else "clippings", t, f"{body} {k} [[note{k - 1}]]") for k in range(8)]
    rows += [("out/p.md", "p", "output", "x", t, "小红书 发布链接"), ("s/d.md", "DRAFT_d", "skills", "y", dt.datetime(2024, 1, 1), "- [ ] todo")]
    n = spark.createDataFrame(rows, NOTES)
    as_of = F.lit("2024-05-01 00:00:00")
    out = stages.run(spark, n, spark.createDataFrame([], state.EMPTY_STATE), as_of)
    stages.write({k: out[k] for k in ("daily_items", "clippings", "audit_layers", "published_platforms")}, str(tmp_path))
    for df in out.values():
        assert df.columns
    assert spark.read.parquet(str(tmp_path / "daily_items")).count() == 8
    assert spark.read.parquet(str(tmp_path / "clippings")).count() == 4
    assert spark.read.parquet(str(tmp_path / "audit_layers")).count() == 5
    assert spark.read.parquet(str(tmp_path / "published_platforms")).first()["platform"] == "小红书"
    state.publish(out["next_state"], str(tmp_path / "state"), 1)
    again = stages.run(spark, n, state.read_state(spark, str(tmp_path / "state")), as_of)
    assert again["daily_items"].count() == 0
    cards = stages.cards_to_write(out["clippings"], out["clippings"].limit(0))
    names = [r["name"] for r in cards.collect()]
    written = out["clippings"].where(F.col("name") != names[0]) if names else out["clippings"]
    assert [r["name"] for r in stages.cards_to_write(out["clippings"], written).collect()] == names[:1]


def test_schedules():
    now = dt.datetime(2024, 3, 30, 12, 0)
    assert schedule.next_run({"schedule": "daily", "hour": 9}, now) == dt.datetime(2024, 3, 31, 9)
    assert schedule.next_run({"schedule": "weekly", "dayOfWeek": 1, "hour": 9}, now) == dt.datetime(2024, 4, 1, 9)
    assert schedule.next_run({"schedule": "quarterly", "hour": 9}, now) == dt.datetime(2024, 3, 31, 9)
    assert schedule.next_run({"schedule": "daily", "enabled": False}, now) is None
    assert schedule.parse_hhmm("08:05") == (8, 5)
    with pytest.raises(ValueError, match="time of day"):
        schedule.parse_hhmm("24:00")
    assert schedule.problems({"schedule": "hourly", "hour": 30}) != []
