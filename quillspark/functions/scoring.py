"""Rubrics: idea maturity, clipping quality, skill feasibility, upgrade level, layer health."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import spans
from .text import any_of, compact, count_body_lines, let, normalize, quick, strip_frontmatter

#: Rule patterns of the idea rubric.
IDEA_THEMES = {
    "女性内容 IP": ["女性", "女性主义", "中女", "小红书", "账号", "博主", "栏目", "视频", "内容"],
    "美业经营": ["美业", "客户", "资产", "运营", "复购", "私域", "风险", "投资", "门店"],
    "AI 工作流": ["ai", "agent", "codex", "claude", "prompt", "提示词", "自动化", "工作流", "工具"],
    "创意叙事": ["街头采访", "30年", "游戏", "冲突", "立场", "心智", "梦", "小猫", "蝴蝶", "爷爷", "奶奶", "故事", "创意"],
    "生活设计": ["家居", "收纳", "空间", "整理", "设计"],
}
CLEAR_BACKGROUND = "背景|来源|概述|目标|问题|为什么|核心概念|系统目标|功能|商业模式"
CLEAR_CORE = "一句话|核心|方向|草案|架构"
ACTIONABLE = "下一步|行动|计划|todo|步骤|流程|每天|发布|执行|拆解|做成|尝试|记录|跟进|运营|规划|计算|匹配|搭建|更新方式|继续补充"
ASSET = "系统|框架|方法论|模板|skill|prompt|工作流|原则|清单|栏目|企划|引擎|体系|模型|架构|规划"
BUSINESS = "商业|变现|客户|运营|增长|复购|投资|风险|账号|收入|赚钱|产品|门店|消费|客单|留存|咨询|盈利|盈亏"
CONTENT = "小红书|视频|栏目|选题|采访|故事|表达|观点|账号|发布|创意|叙事|共学|成长|反思"
EVIDENCE = "案例|数据|来源|共学营|资料|clipping|链接"
ENERGY = "喜欢|触动|梦|爷爷|奶奶|成长|身体|关系|反思|心智|自己|生活"
BOOST_BUSINESS = "系统目标|核心功能|商业模式|客户分层|运营体系|铁三角"
BOOST_CONTENT = "更新方式|每天发|内容方向|一句话简介|气质关键词"
DONE = "已发表|已发布|已完成|已落地|上线|发布链接|成果"
WEIGHTS = {"clarity": 2, "actionability": 3, "asset_value": 3, "business_value": 2, "content_value": 2, "evidence": 2, "personal_energy": 1}
VALUE_WORDS = "方法|流程|步骤|案例|数据|研究|对比|框架|模板|prompt|提示词|技巧|指南|系统|实操"
NOISE_LABELS = (
    ("含 iframe/HTML 残留", "(?i)iframe|frameborder|allowfullscreen"),
    ("含评论区采集", "(?i)前[ \t]*[0-9]+[ \t]*条评论|评论/回复|评论数"),
    ("含 ASR 逐字稿", "(?i)Transcript|视频音频逐字稿|ASR"),
    ("含平台元数据", "(?i)点赞数|收藏数|发布时间|采集时间|原始分享链接"),
)
SKILL_WORDS = ("方法", "方法论", "流程", "步骤", "模板", "框架", "prompt", "提示词", "工作流", "指南", "教程", "技巧", "系统")
SKILL_TYPES = {
    "工具调用型": ["api", "工具", "调用", "接口", "请求", "命令行", "cli", "mcp"],
    "工作流型": ["工作流", "流程", "步骤", "自动化", "编排", "流水线"],
    "判断诊断型": ["判断", "诊断", "评估", "打分", "检查", "审核", "筛选"],
    "内容生成型": ["生成", "写作", "创作", "内容", "文案", "脚本", "输出"],
    "知识梳理型": ["知识", "整理", "梳理", "归纳", "总结", "分类", "体系"],
}
REUSABLE = "模板化|可复用|复用|照做|直接套|通用方法|SOP|标准流程|工作流|标准化|规范化|方法论|框架|实践|skill|Skill|harness|Harness"
STABLE = (r"输入[：:][ \t]*[^\n]+?[\n。]", "给定|传入|参数|API|配置|安装|部署|工具|平台|仓库|repo|github")
VERIFIABLE = "产出|输出|生成|完成|做完[^\n]*?后|最终[^\n]*?得到|得到[^\n]*?一个|交付|交付物|得到[^\n]*?结果"
REAL_CASE = "月入[0-9]|万粉|[0-9]+万|[0-9]+分钟|[0-9]+小时|[0-9]+%|案例|实测|亲测|我自己|我试|真实|演示|实战|Demo|demo"
STEP_PATTERNS = (
    r"(?:(?:^|\n)[ \t\n]*(?:步骤[ \t]*[0-9]+|第[一二三四五六七八九十]+步)[：:][^\n]+){2,}",
    r"(?s)(?:第[一二三四五六七八九十]+步.+?){2,}",
    r"(?s)流程[：:].+?\n.+?\n.+",
    r"(?:(?:^|\n)[ \t\n]*[0-9]+[.)、][ \t\n]+[^\n]+?(?:" + spans.ACTION + r")[^\n]+\n[^\n]+){2,}",
)
#: How the origin of a field is shown.
SOURCE_LABELS = {"原文抽取": "原文抽取", "regex": "原文抽取", "ai_infer": "AI 分析结果", "AI 推测": "AI 分析结果", "llm": "AI 分析结果", "待补充": "待补充", "none": "待补充"}
PLATFORMS = {
    "小红书": ["xiaohongshu", "小红书", "xhs", "点点"],
    "公众号": ["mp.weixin", "微信公众号", "gongzhonghao"],
    "即刻": ["okjike", "即刻"],
    "知乎": ["zhihu", "知乎"],
    "B站": ["bilibili", "b23.tv", "B站"],
    "抖音": ["douyin", "抖音"],
    "推特": ["twitter", "x.com"],
}
GENERATED = ("知识蒸馏", "每周复盘", "Clippings总览报告", "提炼_", "想法成熟度全景", "知识资产审计", "DRAFT_", "README", "Skill 可行性评估索引")


def source_label(source: Column) -> Column:
    """The shown name of a field's origin; an unknown one stays as it is."""
    shown = F.create_map(*(F.lit(x) for kv in SOURCE_LABELS.items() for x in kv))
    return F.coalesce(F.try_element_at(shown, source), source)


def flag(test: Column) -> Column:
    return test.cast("int")


def idea_scores(name: Column, text: Column) -> Column:
    """struct of the seven dimensions (0-5), line_count, total and done."""

    def base(x: Column) -> Column:
        body, t, n, links = x["body"], x["t"], x["n"], x["links"]
        up_b, up_c = flag(t.rlike(quick(BOOST_BUSINESS))), flag(t.rlike(quick(BOOST_CONTENT)))
        cap = lambda c: F.least(F.lit(5), c)
        return F.struct(
            cap(1 + flag(n >= 5) + flag(n >= 12) + flag(body.rlike(quick(CLEAR_BACKGROUND))) + flag(body.rlike(quick(CLEAR_CORE)))).alias("clarity"),
            cap(flag(t.rlike(quick(ACTIONABLE))) + up_b + up_c).alias("actionability"),
            cap(flag(t.rlike(quick(ASSET))) + 2 * up_b + up_c).alias("asset_value"),
            cap(flag(t.rlike(quick(BUSINESS))) + 2 * up_b).alias("business_value"),
            cap(flag(t.rlike(quick(CONTENT))) + 2 * up_c).alias("content_value"),
            cap(links + flag(t.rlike(quick(EVIDENCE))) + flag(n >= 20)).alias("evidence"),
            flag(t.rlike(quick(ENERGY))).alias("personal_energy"),
            n.alias("line_count"),
            t.rlike(quick(DONE)).alias("done"),
        )

    def total(s: Column) -> Column:
        raw = sum((s[k] * w for k, w in WEIGHTS.items()), F.lit(0))
        return F.struct(*(s[k].alias(k) for k in [*WEIGHTS, "line_count", "done"]), F.bround(raw / (5 * sum(WEIGHTS.values())) * 100, 0).cast("int").alias("total"))

    parts = let(strip_frontmatter(text), lambda b: F.struct(b.alias("body"), normalize(F.concat_ws(" ", name, b)).alias("t"), count_body_lines(b).alias("n"), F.regexp_count(text, F.lit(r"\[\[.+?\]\]")).alias("links")))
    return let(let(parts, base), total)


def idea_level(s: Column) -> Column:
    mature = (s["total"] >= 72) & (s["actionability"] >= 3) & (s["asset_value"] >= 3)
    return F.when(s["done"], "done").when(mature, "mature").when((s["total"] >= 38) | (s["line_count"] >= 10), "sprout").otherwise("seed")


def idea_priority(s: Column) -> Column:
    return F.when(s["total"] >= 72, "P0").when(s["total"] >= 50, "P1").when(s["total"] >= 32, "P2").otherwise("P3")


def chosen(*pairs) -> Column:
    """Texts whose test holds, in order, each once."""
    return F.array_distinct(F.array_compact(F.array(*(F.when(test, F.lit(x)) for test, x in pairs))))


def idea_signals(s: Column) -> Column:
    return chosen(
        (s["business_value"] >= 3, "有商业/增长线索"), (s["content_value"] >= 3, "适合转成内容栏目或选题"), (s["asset_value"] >= 3, "可沉淀为方法论或 Skill"),
        (s["personal_energy"] >= 3, "有明显个人情绪/叙事能量"), (s["evidence"] >= 3, "已有一定资料或关联支撑"),
    )


def idea_risks(s: Column) -> Column:
    return chosen(
        (s["clarity"] < 3, "想法边界还不清楚"), (s["actionability"] < 3, "下一步动作不够具体"), (s["evidence"] < 2, "缺少案例、资料或链接支撑"),
        ((s["business_value"] >= 3) & (s["actionability"] < 3), "有商业潜力但缺执行路径"),
    )


def idea_next_actions(s: Column) -> Column:
    out = chosen(
        (s["clarity"] < 3, "补一句话定义：它解决什么问题，给谁用。"), (s["actionability"] < 3, "写 3 个下一步动作，最好能在 30 分钟内启动。"), (s["evidence"] < 3, "链接 2-3 篇相关 Clippings 或真实案例。"),
        (s["asset_value"] >= 3, "整理成框架：输入、步骤、输出、判断标准。"), (s["content_value"] >= 3, "拆 3 个标题/栏目样稿，验证表达方向。"), (s["business_value"] >= 3, "补充目标用户、价值主张和最小可验证场景。"),
    )
    return let(out, lambda x: F.when(F.size(x) > 0, F.slice(x, 1, 5)).otherwise(F.array(F.lit("保留观察，等更多材料或触发场景出现。"))))


def idea_asset_type(hay: Column, themes: Column) -> Column:
    return (
        F.when(hay.rlike("系统|流程|框架|方法|步骤|模板|prompt|提示词|工作流"), "方法论 / Skill 候选").when(hay.rlike("账号|小红书|视频|栏目|采访|故事|创意"), "内容企划 / 输出选题")
        .when(F.array_contains(themes, "美业经营"), "商业运营框架").when(F.array_contains(themes, "生活设计"), "设计原则 / 实用清单").otherwise("想法观察")
    )


def noise_signals(text: Column) -> Column:
    return chosen(*((text.rlike("(?i)" + quick(p.removeprefix("(?i)"))), label) for label, p in NOISE_LABELS))


def quality_score(clean: Column, n_points: Column, n_methods: Column, n_quotes: Column, type_score: Column, n_noise: Column) -> Column:
    """0 to 100 from length, spans, type and signals."""
    n = F.length(clean)
    total = (
        F.when(n > 2500, 25).when(n > 1000, 18).when(n > 400, 10).otherwise(0) + F.least(n_points * 5, F.lit(20)) + F.least(n_methods * 5, F.lit(25)) + F.least(n_quotes * 3, F.lit(12)) + F.least(type_score * 3, F.lit(15))
        + F.when(clean.rlike(r"(?i)(?=[0-9t])(?:[0-9]++(?:%|\.[0-9]|[ \t]*倍)|Top[ \t]*[0-9])"), 5).otherwise(0) + F.when(F.lower(clean).rlike(quick(VALUE_WORDS)), 8).otherwise(0) - F.least(n_noise * 3, F.lit(10))
    )
    return F.greatest(F.lit(0), F.least(total, F.lit(100)))


def quality_tier(score: Column) -> Column:
    return F.when(score >= 70, "excellent").when(score >= 50, "good").otherwise("normal")


def asset_suggestion(asset: Column, score: Column, n_methods: Column) -> Column:
    return F.when((score >= 70) & (n_methods > 0), F.concat(F.lit("优先沉淀为："), asset)).when(score >= 50, F.concat(F.lit("可提炼为："), asset)).otherwise("先暂存；除非与当前项目强相关，否则不建议立刻深挖。")


#: Follow-ups by type, tag and content.
TYPE_ACTIONS = {
    "信息源清单": "把文中提到的博主/媒体逐个拆行，写成“源头 + 适用场景 + 抢看频率”的信息源卡片（进想法追踪）。",
    "案例拆解": "拆一个自己的对照案例，验证原文方法在你手上的成功条件和失败信号。",
    "观点文章": "提炼作者的核心判断为一句话，写成想法追踪条目，并附上你同意 / 不同意的一句话反驳。",
    "商业投研": "提炼一张 客户分层 / 变现链路 / 风险清单 的商业方法论卡片。",
    "内容方法论": "将方法套到自己的账号上：同一主题写 3 个样稿标题，判断物料性。",
    "创意素材": "拓展成一个小企划：一句话概念 + 受众 + 呈现形式 + 3 个样稿标题。",
}


def clipping_actions(ctype: Column, tags: Column, score: Column, n_methods: Column, n_questions: Column, n_quotes: Column, n_noise: Column, core: Column) -> Column:
    draft = ctype.isin("工作流教程", "工具教程", "Prompt/模板") | F.array_contains(tags, "Prompt/工作流")
    out = chosen(
        *((ctype == k, v) for k, v in TYPE_ACTIONS.items()), (draft, "把原文里的步骤抽成 Skill 草稿：输入 / 步骤 / 输出 / 适用与不适用。"),
        ((n_methods >= 3) & (score >= 55), "方法列表已比较完整，可直接临摩成 SOP。"), (n_questions > 0, "将“关键问题”中 1-2 道写入自己的 想法/灵感集，当作下一次思考入口。"),
        (n_quotes > 0, "从“原文金句”挑 1 句写成选题候选（需自己重新造句）。"), (n_noise > 0, "正式沉淀前，清理原文中的 iframe / 评论 / 采集字段，避免污染推荐连接。"), (F.length(core) > 80, "将作者 description 重写为你自己的一句话缩写。"),
    )
    return F.slice(out, 1, 6)


def skill_candidate_score(text: Column) -> Column:
    low = F.lower(text)
    n = sum((flag(low.contains(k)) for k in SKILL_WORDS), F.lit(0))
    listed = text.rlike(quick(r"[0-9]\. |第一|第二|第三|步骤"))
    total = n + 2 * flag(listed) + 2 * flag(F.size(spans.steps(text)) > 0) + 2 * flag(F.size(spans.prompts(text)) > 0)
    return F.least(total, F.lit(10))


def evidence(text: Column, patterns, n: int = 200) -> Column:
    """The first pattern's first match, compacted and cut; null if none matches."""
    found = F.coalesce(*(F.nullif(F.regexp_extract(text, p, 0), F.lit("")) for p in patterns))
    return let(compact(found), lambda x: F.when(F.length(x) > n, F.concat(F.left(x, F.lit(n)), F.lit("…"))).otherwise(x))


def skill_dimensions(text: Column, name: Column) -> Column:
    """struct of five booleans (yes or unclear) with yes_count and conclusion."""
    title = F.coalesce(F.nullif(F.btrim(F.regexp_extract(text, r'(?m)^title:[ \t]*"?([^\n]+?)"?[ \t]*$', 1)), F.lit("")), name)
    asks = any_of(title.contains(x) for x in ("？", "?", "吗", "到底", "真的", "是不是"))
    seen = lambda p: F.coalesce(F.length(evidence(text, p)) >= 2, F.lit(False))
    stable = sum((F.regexp_count(text, F.lit(quick(p))) for p in STABLE), F.lit(0)) >= 2
    step_text = evidence(text, STEP_PATTERNS, 400)
    clear = F.coalesce(F.regexp_count(step_text, F.lit("[0-9]+[.)、]|第[一二三四五六七八九十]+步")) >= 2, F.lit(False))
    row = F.struct((seen([quick(REUSABLE)]) & ~asks).alias("reusable"), stable.alias("stable_input"), clear.alias("clear_steps"), seen([quick(VERIFIABLE)]).alias("verifiable_output"), seen([quick(REAL_CASE)]).alias("real_case"))
    names = ("reusable", "stable_input", "clear_steps", "verifiable_output", "real_case")
    return let(row, lambda r: F.struct(*(r[k].alias(k) for k in names), sum((flag(r[k]) for k in names), F.lit(0)).alias("yes_count")))


def conclusion(yes: Column) -> Column:
    return F.when(yes >= 4, "red").when(yes >= 2, "yellow").otherwise("green")


GAPS = {
    "reusable": "补充可复用的场景描述（谁、什么时候、用什么输入）", "stable_input": "补充典型输入示例（至少 2 个一致的输入格式）", "clear_steps": "补充 ≥3 个明确的编号步骤",
    "verifiable_output": "补充可验证的产出描述（做完后能得到什么）", "real_case": "补充一个真实执行案例（含时间/结果数据）",
}


def skill_gaps(d: Column) -> Column:
    return chosen(*((~d[k], v) for k, v in GAPS.items()), (d["yes_count"] < 5, "补充失败/不适用场景"))


def skill_type(name: Column, text: Column) -> Column:
    low = F.lower(F.concat_ws(" ", name, text))
    rows = F.array(*(F.struct(sum((flag(low.contains(k)) for k in kws), F.lit(0)).alias("h"), F.lit(t).alias("t")) for t, kws in SKILL_TYPES.items()))
    return F.coalesce(F.get(F.sort_array(F.filter(rows, lambda x: x["h"] > 0), asc=False), F.lit(0))["t"], F.lit("待判断"))


#: Patterns of the fields of a skill's situation and form.
SITUATION = {
    "target_user": ("目标用户|目标人群|适用人群|适用对象|面向|推荐给|适用于", "如果你是|你是一名|你是做|从事[^\n]+?的|做[^\n]+?的人"),
    "trigger_scene": ("当你需要|当你想|如果你想|每次需要|每次都要|每次[^\n]*?都",),
    "pain_point": ("痛点|头疼|最难|最烦|花很多时间|老是|总是|苦于|困扰|效率低|太慢|太麻烦",),
    "expected_effect": ("最终得到|最终产出|做完[^\n]*?后|完成后|预期[^\n]*?结果|预期[^\n]*?效果",),
    "unsuitable_scene": ("不适合|不适用|不建议用|不要用|不推荐用|别用|前提是|限制|局限",),
}
FORM = {
    "inputs": ("输入[：:][ \t]*([^\n]+)", "需要[：:][ \t]*([^\n]+)", "(?:准备|前置)[：:][ \t]*([^\n]+)"),
    "outputs": ("输出[：:][ \t]*([^\n]+)", "产出[：:][ \t]*([^\n]+)", "交付物?[：:][ \t]*([^\n]+)", "(?:最终|得到)[：:]?[ \t]*([^\n]+)"),
    "tools": ("(?:工具|需要的工具|所需工具)[：:][ \t]*([^\n]+)", "(?:依赖|前置依赖|技术栈)[：:][ \t]*([^\n]+)"),
    "not_required": ("不需要[：:][ \t]*([^\n]+)", "(?:无需|免|不用|不依赖)[：:]?[ \t]*([^\n]+)"),
}
UNKNOWN = "待补充"


def skill_situation(text: Column) -> Column:
    return F.struct(*(F.coalesce(evidence(text, map(quick, p), 100), F.lit(UNKNOWN)).alias(k) for k, p in SITUATION.items()))


def skill_form(text: Column, name: Column) -> Column:
    def field(patterns) -> Column:
        tried = [F.btrim(compact(F.regexp_extract(text, p, 1)), F.lit("：: 　-*")) for p in patterns]
        return F.coalesce(*(F.when(F.length(x).between(2, 80), x) for x in tried), F.lit(UNKNOWN))

    return F.struct(skill_type(name, text).alias("skill_type"), F.size(spans.steps(text)).alias("step_count"), *(field(p).alias(k) for k, p in FORM.items()))


def card_level(conclusion_key: Column, yes: Column, s2_gaps: Column, s3_gaps: Column, todos: Column) -> Column:
    """Upgrade level 0-5 of an evaluation card: counts of open gaps and todos."""
    return (
        F.when((conclusion_key == "green") | (yes <= 1), 0).when(yes == 2, 1).when(6 - s3_gaps < 2, 2).when((5 - s2_gaps < 3) | (todos >= 3), 3).when(todos >= 1, 4).otherwise(5)
    )


def card_actions(level: Column, conclusion_key: Column, s3_missing: Column, step_count: Column) -> Column:
    has = lambda *x: any_of(F.array_contains(s3_missing, k) for k in x)
    out = chosen(
        (level == 5, "✅ 已就绪：可提交 skill_workshop 或转成正式 Skill。"), ((level <= 1) & (conclusion_key == "green"), "先判断「继续投入价值」：低价值想法可归档，不必强行升 Level。"),
        ((level <= 1) & (conclusion_key != "green"), "确认这是不是「一次性观察」——若能预见未来会再遇同类需求，才继续升级。"), (level <= 2, "把可复用性/输入稳定性写清楚，或用一次真实执行补足证据。"),
        ((level <= 3) & has("输入"), "明确 Skill 输入：需要什么材料/参数？"), ((level <= 3) & has("输出"), "明确 Skill 输出：产物形式是什么？"), ((level <= 3) & has("工具", "工具/账号"), "列出必需的工具、API、账号权限。"),
        ((level <= 3) & has("步骤") & (step_count < 3), "补充 ≥3 个明确编号步骤。"), (level == 4, "补齐后跑一次真实场景，把结果作为 Level 5 的「验证证据」。"),
    )
    return let(out, lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(F.lit("继续把下一 Level 需要的条件补齐。"))))


def platform(text: Column) -> Column:
    low, out = F.lower(text), F.lit("未标注")
    for name, hints in reversed(PLATFORMS.items()):
        out = F.when(any_of(low.contains(h.lower()) for h in hints), name).otherwise(out)
    return out


def is_generated(name: Column) -> Column:
    return any_of(name.contains(m) for m in GENERATED)


def is_draft(path: Column, name: Column, text: Column) -> Column:
    return name.startswith("DRAFT_") | path.contains("待整理") | F.left(text, F.lit(3000)).contains("[ ]")


def is_published(path: Column, text: Column) -> Column:
    return path.contains("已发表") | text.rlike("(?i)发布链接|已发布|published")


def is_package_doc(path: Column, package: str) -> Column:
    rel = F.concat(F.lit("/"), path)
    return rel.contains(package) & (any_of(rel.contains(x) for x in ("/references/", "/templates/", "/assets/", "/examples/")) | rel.endswith("/SKILL.md"))


def health(layer: Column, n: Column, generated: Column, orphans: Column, avg_curated: Column, recent: Column) -> Column:
    return (
        F.when(n == 0, "空").when((generated / n > 0.75) & (layer == "distilled"), "自动产物偏多").when((orphans / n > 0.65) & ~layer.isin("inbox", "output"), "需整理")
        .when((layer == "inbox") & (avg_curated < 1), "待蒸馏").when((avg_curated >= 1.5) | (recent >= F.greatest(F.lit(1), F.floor(n / 5))), "健康").otherwise("可优化")
    )
