"""Evaluation cards: what a card's Markdown says about a skill's feasibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of the dimensions, and labels of the fields with the names of their gaps.
DIMENSIONS = {"内容可复用": "reusable", "输入稳定": "input_stable", "步骤清晰": "steps_clear", "输出可验证": "output_verifiable", "真实案例": "has_case"}
SITUATION_FIELDS = {"目标用户": "目标用户", "触发场景": "触发场景", "用户痛点": "用户痛点", "使用后应达到": "预期效果", "不适合场景": "不适合场景"}
FORM_FIELDS = {"形态": "形态", "输入": "输入", "输出": "输出", "关键动作数": "步骤", "需要的工具/账号": "工具/账号", "不需要的": "反面清单"}
CONCLUSIONS = {"🔴": "red", "🟡": "yellow", "🟢": "green"}
ORIGINS = "原文抽取|AI 推测|待补充|none"
OPEN = "待补充"


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _gaps(text: Column, fields: dict[str, str]) -> Column:
    """Names of the fields that are missing or still open."""
    found = {label: _first(text, rf"-\s*\*\*{label}\*\*[:：]\s*([^\n]+)") for label in fields}
    return F.array_compact(F.array(*(F.when(found[label].isNull() | found[label].contains(OPEN), F.lit(name)) for label, name in fields.items())))


def card(text: Column, name: Column) -> Column:
    """struct(title, conclusion, yes_count, status, situation_gaps, form_gaps, step_count, todos) of a card's text.

    Whatever a card lacks has a default: its file name, green, 0, gaps for all fields, no todos. An empty list of
    todos reads on into the section that follows.
    """
    row = rf"\|\s*{{}}\s*\|\s*([✅⚠️❌])\s*\|\s*[^|]*?\s*\|\s*(?:{ORIGINS})\s*\|"
    sign = F.coalesce(_first(text, "评估结论[:：]\\s*([🔴🟡🟢])"), F.lit("🟢"))
    yes = F.coalesce(_first(text, r"\(([0-9]+)/5\s*项\s*✅\)"), _first(text, r"([0-9]+)/5\s*项\s*✅"), F.lit("0")).cast("int")
    section = F.regexp_extract(text, r"(?s)##\s*4\x{FE0F}?\x{20E3}?\s*Gap\s*清单\s*(.*?)(?=\n##|\z)", 1)
    todo = F.transform(F.split(section, "\n"), lambda x: F.btrim(F.regexp_extract(x, r"^\s*-\s*\[\s*[ x]\s*\]\s*(.+)", 1)))
    return F.struct(
        F.coalesce(F.btrim(_first(text, r"(?m)^#\s+.*?[:：]\s*(.+)$")), name).alias("title"),
        F.create_map(*(F.lit(x) for kv in CONCLUSIONS.items() for x in kv))[sign].alias("conclusion"),
        yes.alias("yes_count"),
        F.struct(*(_first(text, row.format(label)).alias(key) for label, key in DIMENSIONS.items())).alias("status"),
        _gaps(text, SITUATION_FIELDS).alias("situation_gaps"),
        _gaps(text, FORM_FIELDS).alias("form_gaps"),
        F.coalesce(_first(text, r"\*\*关键动作数\*\*[:：]\s*([0-9]+)\s*步"), F.lit("0")).cast("int").alias("step_count"),
        F.filter(todo, lambda x: x != "").alias("todos"),
    )


def collect(notes: DataFrame) -> DataFrame:
    """The notes (name, text, ..) that are cards, in the order of their names, with what their texts say in a column card."""
    return notes.where(is_card(F.col("name"))).withColumn("card", card(F.col("text"), F.col("name"))).orderBy("name")


def is_card(name: Column) -> Column:
    return name.startswith("EVAL_")
