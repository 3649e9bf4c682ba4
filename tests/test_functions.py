"""Literal cases of the text, taxonomy and rubric functions."""

from functools import reduce

import pytest
from pyspark.sql import functions as F

from quillspark.functions import scoring, spans, text, tokens
from quillspark.functions import taxonomy as tx


def value(spark, column, **given):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in given.items())) if given else spark.range(1)
    return row.select(column.alias("out")).first()["out"]


C = F.col


@pytest.mark.parametrize(
    ("given", "want"),
    [("---\ntitle: x\n---\nbody", "body"), ("---\nno close", "---\nno close"), ("plain\n---\nx\n---", "plain\n---\nx\n---"), ("", ""), ("---", "---"), ("---\n---", "")],
)
def test_frontmatter(spark, given, want):
    assert value(spark, text.strip_frontmatter(C("t")), t=given) == want


def test_normalize_and_sentences(spark):
    assert value(spark, text.normalize(C("t")), t="A_B-C｜D") == "a b c d"
    assert value(spark, text.split_sentences(C("t")), t="短句！This one is long enough? tail piece here.") == ["This one is long enough?", "tail piece here."]
    assert value(spark, text.preview(C("t"), 5), t="abcdefg") == "abcde..."
    assert value(spark, text.first_paragraph(C("t")), t="<b>short</b>\n\n" + "x" * 40) == "x" * 40


def test_noise_lines(spark):
    for line, noisy in (("just a plain line", True), ("with, a comma", False), ("", True), ("作者：某人", True), ("**Description**", True), ("方法，很好", False)):
        assert value(spark, text.is_noise_line(C("t")), t=line) is noisy


def test_tokens(spark):
    assert value(spark, tokens.mixed_tokens(F.lit("n"), C("t")), t="工作流自动化搭建") == ["工作流自动化", "搭建"]
    assert value(spark, tokens.link_tokens(C("t")), t="foo_bar Éauouon AI") == ["foo", "bar", "auouon"]
    long = "这是一个很长的中文句子用来测试分块的行为是否正确"
    assert value(spark, tokens.link_tokens(C("t")), t=long)[0] == "这是"


RULES = {
    "contentTypes": {"行业情报": {"keywords": ["行业", "趋势"], "priority": 2.4}, "信息源清单": {"keywords": ["信息源", "博主"], "priority": 3.0}},
    "typeShortcuts": [{"type": "信息源清单", "score": 16, "all": ["信息源"], "any": ["博主", "推荐"]}],
}


def test_classification(spark):
    hay = tx.haystack(F.lit("n"), C("t"))
    for t, want in (("行业 趋势", ["行业情报"]), ("趋势", ["行业情报"]), ("zzz", [tx.OTHER])):
        assert value(spark, tx.categories(hay, RULES), t=t) == want
    for t, want in (("信息源 博主", ("信息源清单", 16)), ("zzz", ("待判断", 0)), ("趋势", ("行业情报", 4))):
        got = value(spark, tx.content_type(hay, F.lit("n"), RULES), t=t)
        assert (got["type"], got["score"]) == want


def test_taxonomy_merge_and_check(tmp_path):
    over = tmp_path / "t.json"
    over.write_text('{"themes": {"new": ["x"]}, "bridges": {"_replace": {"english": ["new"]}}}')
    t = tx.load(str(over))
    assert t["themes"]["new"] == ["x"]
    assert "german" in t["themes"]
    assert t["bridges"] == {"english": ["new"]}
    assert tx.problems(tx.SAMPLE) == ["bridges.spanish: unknown theme absent"]


def test_idea_rubric(spark):
    low = value(spark, scoring.idea_scores(F.lit("n"), C("t")), t="")
    assert (low["clarity"], low["total"]) == (1, 3)
    everything = "\n".join(["一句话 目标 系统目标 更新方式 下一步 系统 商业 小红书 案例 喜欢 [[a]] [[b]] [[c]] [[d]] [[e]]"] + [f"line {i}" for i in range(25)])
    high = value(spark, scoring.idea_scores(F.lit("n"), C("t")), t=everything)
    assert (high["clarity"], high["evidence"], high["total"]) == (5, 5, 72)
    level = value(spark, scoring.idea_level(F.struct(F.lit(72).alias("total"), F.lit(3).alias("actionability"), F.lit(4).alias("asset_value"), F.lit(26).alias("line_count"), F.lit(False).alias("done"))))
    assert level == "mature"


def test_methods_reject_contained_ones(spark):
    t = "- 先建立输入清单再整理输出结果\n- 建立输入清单再整理输出结果\n- 每周复盘并记录失败案例和原因\n- run the step list now"
    assert value(spark, spans.methods(text.clean_content(C("t"))), t=t) == ["先建立输入清单再整理输出结果", "每周复盘并记录失败案例和原因"]


def test_quotes(spark):
    score = spans.quote_score(C("t"), F.lit("body"), F.lit(0.5))
    assert value(spark, score, t="真正重要的不是努力，而是选择方向。") == 6
    assert value(spark, score, t="is this a question, really?") == -99
    got = value(spark, spans.quotes(C("t")), t="**真正重要的不是努力，而是选择方向。**\n\n其他的话。真正重要的不是努力，而是选择方向。")
    assert [q["source"] for q in got] == ["bold"]
    assert value(spark, spans.similar_quotes(F.lit("abc def ghi jkl"), F.lit("abc def ghi xyz")))


def test_links(spark):
    assert value(spark, spans.wiki_links(C("t")), t="[[A|x]] [[B#s]] [[ ]]") == ["A", "B"]
    links = F.array(F.struct(F.lit("B").alias("target"), F.lit("why  so").alias("reason")), F.struct(F.lit("B ").alias("target"), F.lit("again").alias("reason")))
    once = value(spark, spans.apply_links(C("t"), links), t="# A\n\nbody\n")
    assert once.count("[[B]]") == 1
    assert "## 相关链接" in once
    assert value(spark, spans.apply_links(C("t"), links), t=once) == once
    under = value(spark, spans.apply_links(C("t"), links), t="x\n## 相关链接\nold")
    assert under.index(spans.MARKS[0]) < under.index("old")


def test_skill_rubric(spark):
    for yes, want in enumerate(["green", "green", "yellow", "yellow", "red", "red"]):
        assert value(spark, scoring.conclusion(F.lit(yes))) == want
    level = lambda c, *x: value(spark, scoring.card_level(F.lit(c), *map(F.lit, x)))
    assert level("yellow", 2, 0, 0, 0) == 1
    assert [level("red", 4, 5, 6, 0), level("red", 4, 3, 3, 0), level("red", 4, 1, 3, 3), level("red", 4, 1, 3, 1), level("red", 4, 1, 3, 0)] == [2, 3, 3, 4, 5]
    dims = value(spark, scoring.skill_dimensions(C("t"), F.lit("n")), t="这个工作流可复用，工具和平台都有。输出一份报告，实测有效。")
    assert dims["yes_count"] == 4
    assert value(spark, scoring.platform(C("t")), t="B站 xhs") == "小红书"


def test_prompts_and_steps(spark):
    t = "```\n请你帮我 write a summary of this text\n```\n1. 建立一个输入清单，然后整理\n- no action, here at all"
    assert value(spark, spans.steps(C("t")), t=t) == ["1. 建立一个输入清单，然后整理"]
    assert len(value(spark, spans.prompts(C("t")), t=t)) >= 1


def test_any_of_nothing(spark):
    assert value(spark, reduce(lambda a, b: a | b, [text.any_of([])])) is False


def test_english_words_end_at_letters_beyond_ascii(spark):
    """As in the SQL of span_quote_scores, whose word boundaries know ASCII alone."""
    row = spark.createDataFrame([("Cosas de la ciónlosesñ y losesñ ñlose.", "Cosas de la ciónloses y xloses nada.")], "a string, b string")
    got = row.select(*(spans.quote_score(F.col(c), F.lit("body"), F.lit(0.5)).alias(c) for c in "ab")).first()
    assert got["a"] - got["b"] == 3


def test_questions_of_long_runs_without_a_mark(spark):
    """A run that ends in no question mark is read once, not again from each of its characters."""
    import time

    row = spark.createDataFrame([("ab cd " * 15_000 + "。 " + "x" * 90 + "wie geht es dir denn？ abcdefgh? abcdefg? 。",)], "t string")
    row.select(spans.questions(F.col("t"))).first()
    start = time.time()
    got = row.select(spans.questions(F.col("t")).alias("q")).first()["q"]
    assert got == ["x" * 60 + "wie geht es dir denn？"]
    assert time.time() - start < 3


@pytest.mark.parametrize("given", ["a  b", " a\n b\t", "\n\n", "a b", " ", "", "a \x0b\f\rb c", "中 文\n 字"])
def test_white_space_runs_become_one_space(spark, given):
    import re

    assert value(spark, text.spaced(C("t")), t=given) == re.sub("[ \t\n\x0b\f\r]+", " ", given)


def test_quick_alternations_match_as_plain_ones(spark):
    """Words of both alphabets and digits: the same finds, in the same places."""
    given = "步骤 skill 方法论 12分钟 3万 Skill 框架x prompt 系 系统目标"
    for words in (scoring.ASSET, scoring.REAL_CASE, scoring.REUSABLE, spans.METHOD, spans.CONTRARIAN, *scoring.SITUATION["target_user"]):
        find = lambda p: F.regexp_extract_all(C("t"), F.lit(p), F.lit(0))
        assert value(spark, find(text.quick(words)), t=given) == value(spark, find(f"(?:{words})"), t=given)
    assert "(?=[" in text.quick("步|a") and text.quick("a|步").startswith("(?:(?=[a])")


@pytest.mark.parametrize(("given", "want"), [("a\n\n # x\n \t#y\n z \n\r\n", 2), ("", 0), ("#", 0), ("---\nk: v\n---\na\n-", 2)])
def test_counted_lines(spark, given, want):
    assert value(spark, text.count_lines(C("t")), t=given) == want


def test_scores_are_found_once(spark, tmp_path):
    """Neither a filter nor an order makes the plan read texts twice."""
    import __spark_entry__

    spark.createDataFrame([(k, "方法 步骤 1. 流程 模板 方法论。 the end of it all", "s") for k in range(8)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("cls_skill_candidates", "win_position"):
        df = __spark_entry__.queries()[name](spark, str(tmp_path))
        assert df._jdf.queryExecution().optimizedPlan().toString().count("小红书") <= 1
        assert df.count() == 8
