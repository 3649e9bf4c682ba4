"""Queries over classification, rubrics and distributions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import cards as cards_
from quillspark.functions import scoring, spans, text
from quillspark.functions import taxonomy as tx
from quillspark.operators import containment
from quillspark.shared import store
from quillspark.sources import notes as src

from . import sql
from .registry import query

T = tx.SAMPLE
HAY = sql.normalize("name || ' ' || text")


def _hay():
    return tx.haystack(F.col("name"), F.col("text"))


def _hits(kws, c="hay") -> str:
    return "(" + " + ".join(f"contains({c}, {sql.lit(tx.plain(k))})::INT" for k in kws) + ")"


def _table(rules: dict) -> str:
    return "(VALUES " + ", ".join(f"({sql.lit(k)}, {sql.lit(tx.plain(w))})" for k, ws in rules.items() for w in ws) + ") k(category, keyword)"


TYPES = {k: v["keywords"] for k, v in T["contentTypes"].items()}
_H = f"WITH {sql.NOTES}, h AS (SELECT doc_id, name, path, mtime, bucket, layer, text, {HAY} AS hay FROM notes)"
_HM = _H.replace(sql.NOTES, sql.MARKED_NOTES)
_CATS = f"{_H}, m AS (SELECT doc_id, category, count(*) AS hits FROM h JOIN {_table(TYPES)} ON contains(hay, keyword) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, category) AS rn, max(hits) OVER (PARTITION BY doc_id) AS top FROM m), c AS (SELECT doc_id, category, rn FROM r WHERE hits >= 2 OR (top < 2 AND rn = 1))"


def categories(spark, d):
    return src.notes(spark, d).select("doc_id", "name", "path", tx.categories(_hay(), T).alias("categories"))


@query(f"{_CATS} SELECT h.doc_id, coalesce(string_agg(category, '、' ORDER BY rn), '{tx.OTHER}') AS categories FROM h LEFT JOIN c USING (doc_id) GROUP BY h.doc_id")
def cls_multilabel(spark, d):
    return categories(spark, d).select("doc_id", F.array_join("categories", "、").alias("categories"))


@query(f"{_CATS}, a AS (SELECT h.doc_id, coalesce(category, '{tx.OTHER}') AS category FROM h LEFT JOIN c USING (doc_id)) SELECT category, count(*) AS n FROM a GROUP BY category")
def cat_by_category(spark, d):
    return categories(spark, d).select(F.explode("categories").alias("category")).groupBy("category").agg(F.count("*").alias("n"))


@query(f"{_CATS}, a AS (SELECT CASE WHEN h.doc_id % 40 = 0 THEN 'zz' ELSE coalesce(category, '{tx.OTHER}') END AS category, h.doc_id FROM h LEFT JOIN c USING (doc_id)), g AS (SELECT category, count(DISTINCT doc_id) AS n FROM a GROUP BY category) SELECT category, n, row_number() OVER (ORDER BY coalesce(list_position([{', '.join(map(sql.lit, [*TYPES, tx.OTHER]))}], category), 999), category) AS place FROM g")
def cat_order(spark, d):
    """Categories of the catalog view in its order: known ones, other, unknown ones."""
    from quillspark.operators import state

    c = categories(spark, d).withColumn("categories", F.when(F.col("doc_id") % 40 == 0, F.array(F.lit("zz"))).otherwise(F.col("categories")))
    n = state.by_category(c, tx.OTHER)
    return n.withColumn("place", F.row_number().over(W.orderBy(state.category_rank(F.col("category"), list(TYPES), tx.OTHER), "category")).cast("long"))  # one row a category


@query(f"WITH {sql.NOTES} SELECT doc_id, md5(left(text, 12000)) AS hash FROM notes")
def cat_document_hash(spark, d):
    from quillspark.operators import state

    return src.notes(spark, d).select("doc_id", state.document_hash(F.col("text")).alias("hash"))


@query(f"WITH {sql.NOTES} SELECT count(*) AS files, count(*) FILTER (doc_id % 3 = 0) AS ideas, count(*) FILTER (doc_id % 3 <> 0) AS clippings, min(mtime) AS first_edit, max(mtime) AS last_edit FROM notes WHERE layer = 'inbox'")
def agg_inbox_counts(spark, d):
    """Files of the inbox, by the folder that they lie in, and the range of their dates."""
    n = src.notes(spark, d).where("layer = 'inbox'").withColumn("folder", F.when(F.col("doc_id") % 3 == 0, "ideas").otherwise("clippings"))
    count = lambda k: F.count(F.when(F.col("folder") == k, 1)).alias(k)
    return n.agg(F.count("*").alias("files"), count("ideas"), count("clippings"), F.min("mtime").alias("first_edit"), F.max("mtime").alias("last_edit"))


@query(f"WITH {sql.NOTES}, i AS (SELECT path, mtime FROM notes WHERE layer = 'inbox') SELECT path, greatest((SELECT count(*) FROM i) - 7, 0) AS rest FROM (SELECT path FROM i ORDER BY mtime DESC, path LIMIT 7)")
def sort_limit_rest(spark, d):
    from quillspark.operators import state

    n = src.notes(spark, d).where("layer = 'inbox'").select("path", "mtime")
    return state.first_with_rest(n, [F.desc("mtime"), F.asc("path")], 7).select("path", "rest")


@query(f"{_CATS}, f AS (SELECT DISTINCT doc_id FROM c), q AS (SELECT path, name, CASE WHEN doc_id NOT IN (SELECT doc_id FROM f) THEN 'no_match' WHEN doc_id % 3 = 0 THEN 'llm_proposal' END AS reason, doc_id FROM h) SELECT path, reason FROM q WHERE reason IS NOT NULL UNION ALL SELECT h.path, 'older' FROM h JOIN q USING (doc_id) WHERE h.doc_id % 4 = 0 AND q.reason IS NULL")
def catalog_queue(spark, d):
    """The review queue after a run: new reasons in place of older entries of the same path."""
    from quillspark.operators import state

    c = categories(spark, d).withColumn("proposals", F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("new type"))).otherwise(F.array().cast("array<string>")))
    older = c.where("doc_id % 4 = 0").select("path", "name", F.lit("older").alias("reason"))
    return state.queued(older, state.pending(c, tx.OTHER)).select("path", "reason")


@query(f"{_CATS} SELECT count(*) AS docs, count(c.doc_id) AS classified, count(*) - count(c.doc_id) AS other FROM (SELECT DISTINCT doc_id FROM h) h LEFT JOIN (SELECT DISTINCT doc_id FROM c) c USING (doc_id)")
def cat_stats(spark, d):
    other = F.array_contains("categories", tx.OTHER)
    return categories(spark, d).agg(F.count("*").alias("docs"), F.count(F.when(~other, 1)).alias("classified"), F.count(F.when(other, 1)).alias("other"))


@query(f"{_CATS} SELECT path, name, 'no_match' AS reason FROM h WHERE doc_id NOT IN (SELECT doc_id FROM c)")
def catalog_pending(spark, d):
    from quillspark.operators import state

    return state.pending(categories(spark, d), tx.OTHER)


@query(f"{_H} SELECT doc_id, category, count(*) AS hits FROM h JOIN {_table(TYPES)} ON contains(hay, keyword) GROUP BY ALL")
def join_theta_keyword(spark, d):
    """The join form of keyword matching, for taxonomies too large to compile: texts meet keywords by grams."""
    k = tx.keyword_table(spark, T)
    n = src.notes(spark, d).select(F.col("doc_id").alias("key"), _hay().alias("text"))
    found = containment.keywords_in(n, k).join(k, "keyword")
    return found.groupBy(F.col("key").alias("doc_id"), F.col("type").alias("category")).agg(F.count("*").alias("hits"))


@query(f"{_H} SELECT doc_id, coalesce(array_to_string(list_filter([{', '.join(f'CASE WHEN {_hits(w)} > 0 THEN {sql.lit(k)} END' for k, w in T['themes'].items())}], lambda x: x IS NOT NULL), '、'), '') AS themes FROM h")
def cls_themes(spark, d):
    return src.notes(spark, d).select("doc_id", F.array_join(tx.themes(_hay(), T), "、").alias("themes"))


@query(f"{_HM} SELECT doc_id, coalesce(array_to_string(list_filter([{', '.join(f'CASE WHEN {_hits(w)} > 0 THEN {sql.lit(k)} END' for k, w in scoring.IDEA_THEMES.items())}], lambda x: x IS NOT NULL), '、'), '') AS themes FROM h")
def cls_idea_themes(spark, d):
    return src.marked_notes(spark, d).select("doc_id", F.array_join(tx.matching(_hay(), scoring.IDEA_THEMES), "、").alias("themes"))


def _weighted(kws) -> str:
    n = sql.normalize("name")
    return "(" + " + ".join(f"contains(hay, {sql.lit(tx.plain(k))})::INT * (1 + 2 * contains({n}, {sql.lit(tx.plain(k))})::INT)" for k in kws) + ")"


WEEK_THEMES = {**T["themes"], "numbers": ["doc", "doc 1", "doc 7"]}
_WEEK = f"{_H}, s AS (" + " UNION ALL ".join(f"SELECT {sql.lit(k)} AS theme, doc_id, name, mtime, {_weighted(w)} AS score FROM h" for k, w in WEEK_THEMES.items()) + ")"


def theme_scores(spark, d):
    """(theme, doc_id, name, mtime, score): three points for a keyword in the name, one elsewhere."""
    hay, name = _hay(), text.normalize(F.col("name"))
    rows = []
    for k, kws in WEEK_THEMES.items():
        s = sum(((hay.contains(tx.plain(w)).cast("int") * (1 + 2 * name.contains(tx.plain(w)).cast("int"))) for w in kws), F.lit(0))
        rows.append(F.struct(F.lit(k).alias("theme"), s.alias("score")))
    return src.notes(spark, d).select("doc_id", "name", "mtime", F.explode(F.array(*rows)).alias("x")).select("x.theme", "doc_id", "name", "mtime", "x.score").where("score > 0")


@query(f"{_WEEK} SELECT theme, sum(score)::BIGINT AS score, count(*) AS n FROM s WHERE score > 0 GROUP BY theme")
def cls_theme_weighted(spark, d):
    return theme_scores(spark, d).groupBy("theme").agg(F.sum("score").alias("score"), F.count("*").alias("n"))


@query(f"{_WEEK}, r AS (SELECT *, row_number() OVER (PARTITION BY theme ORDER BY score DESC, mtime DESC, doc_id) AS rank FROM s WHERE score > 0) SELECT theme, rank, doc_id, score FROM r WHERE rank <= 5")
def win_topk_theme(spark, d):
    w = W.partitionBy("theme").orderBy(F.desc("score"), F.desc("mtime"), "doc_id")
    return theme_scores(spark, d).withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("theme", "rank", "doc_id", "score")


@query(f"{_WEEK}, a AS (SELECT theme, sum(score) AS score, count(*) AS n FROM s WHERE score > 0 GROUP BY theme), t AS (SELECT theme, row_number() OVER (ORDER BY score DESC, n DESC, theme) AS rank FROM a) SELECT coalesce(string_agg(theme, ' + ' ORDER BY rank) FILTER (rank <= 3), '') AS themes, CASE WHEN (SELECT count(*) FROM h) = 0 THEN 'no input' WHEN count(*) = 0 THEN 'scattered' ELSE 'themes' END AS state FROM t")
def sort_week_judgement(spark, d):
    """The three leading themes by rank; without themes the input is scattered, without notes there is none."""
    a = theme_scores(spark, d).groupBy("theme").agg(F.sum("score").alias("score"), F.count("*").alias("n"))
    ranked = a.agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), (-F.col("n")).alias("n"), "theme"))).alias("r"))  # one row a theme
    names = F.array_join(F.transform(F.slice("r", 1, 3), lambda x: x["theme"]), " + ")
    state = F.when(F.size("r") > 0, "themes").when(F.lit(src.notes(spark, d).isEmpty()), "no input").otherwise("scattered")
    return ranked.select(names.alias("themes"), state.alias("state"))


@query(f"{_H}, p AS (SELECT doc_id, mtime, {_hits(['doc 1', '9', '42'], sql.normalize('name'))} AS priority FROM h WHERE layer = 'inbox') SELECT doc_id, priority FROM p ORDER BY priority DESC, mtime DESC, doc_id LIMIT 5")
def sort_promising(spark, d):
    n = src.notes(spark, d).where("layer = 'inbox'")
    return n.select("doc_id", "mtime", tx.hits(text.normalize(F.col("name")), ["doc 1", "9", "42"]).alias("priority")).orderBy(F.desc("priority"), F.desc("mtime"), "doc_id").limit(5).select("doc_id", "priority")


def _type_sql(src_cte: str) -> str:
    parts = []
    for k, m in T["contentTypes"].items():
        titled = "(" + " + ".join(f"(contains(hay, {sql.lit(tx.plain(w))}) AND contains({sql.normalize('name')}, {sql.lit(tx.plain(w))}))::INT" for w in m["keywords"]) + ")"
        parts.append(f"SELECT doc_id, {sql.lit(k)} AS type, {_hits(m['keywords'])} AS hits, 2 * {_hits(m['keywords'])} + 2 * {titled} + {m['priority']}::DOUBLE AS score FROM h")
    rule = T["typeShortcuts"][0]
    fits = f"{_hits(rule['all'])} = {len(rule['all'])} AND {_hits(rule['any'])} > 0"
    return (
        f"{src_cte}, t AS ({' UNION ALL '.join(parts)}), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, hits DESC, type DESC) AS rn FROM t WHERE hits > 0), "
        f"x AS (SELECT h.doc_id, CASE WHEN {fits} THEN {sql.lit(rule['type'])} ELSE coalesce(b.type, '待判断') END AS type, CASE WHEN {fits} THEN {rule['score']} ELSE coalesce(round_even(b.score, 0)::INT, 0) END AS score FROM h LEFT JOIN b ON h.doc_id = b.doc_id AND b.rn = 1)"
    )


@query(_type_sql(_H) + " SELECT doc_id, type, score FROM x")
def cls_content_type(spark, d):
    return src.notes(spark, d).select("doc_id", tx.content_type(_hay(), F.col("name"), T).alias("x")).select("doc_id", "x.*")


@query(_type_sql(_H) + " SELECT type, count(*) AS n, round(avg(score), 6) AS avg_score FROM x GROUP BY type")
def agg_type_dist(spark, d):
    return cls_content_type(spark, d).groupBy("type").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("avg_score"))


@query(_type_sql(_H) + ", r AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY score DESC, doc_id) AS rank FROM x WHERE score >= 10) SELECT type, rank, doc_id, score FROM r WHERE rank <= 12")
def agg_top_by_type(spark, d):
    w = W.partitionBy("type").orderBy(F.desc("score"), "doc_id")
    return cls_content_type(spark, d).where("score >= 10").withColumn("rank", F.row_number().over(w)).where("rank <= 12").select("type", "rank", "doc_id", "score")


_TAGS = f"{_H}, m AS (SELECT doc_id, category AS tag, count(*) AS hits FROM h JOIN {_table(T['tagRules'])} ON contains(hay, keyword) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, tag DESC) AS rn FROM m)"


@query(f"{_TAGS} SELECT h.doc_id, coalesce(string_agg(tag, '、' ORDER BY rn), '') AS tags FROM h LEFT JOIN (SELECT * FROM r WHERE rn <= 4) r USING (doc_id) GROUP BY h.doc_id")
def cls_auto_tags(spark, d):
    return src.notes(spark, d).select("doc_id", F.array_join(tx.auto_tags(_hay(), T), "、").alias("tags"))


@query(f"{_TAGS} SELECT tag, count(*) AS n FROM r WHERE rn <= 4 GROUP BY tag")
def agg_tag_dist(spark, d):
    return src.notes(spark, d).select(F.explode(tx.auto_tags(_hay(), T)).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def _flag(p: str, c: str = "t") -> str:
    return f"regexp_matches({c}, {sql.lit(p)})::INT"


_IDEA = f"""WITH {sql.MARKDOWN}, b AS (SELECT doc_id, name, text, {sql.frontless('text')} AS body FROM notes),
u AS (SELECT doc_id, body, {sql.normalize("name || ' ' || body")} AS t, len(regexp_extract_all(text, '\\[\\[.+?\\]\\]')) AS links, len(list_filter({sql.lines('body')}, lambda x: trim(x, {sql.TRIM}) <> '' AND NOT starts_with(trim(x, {sql.TRIM}), '#'))) AS n FROM b),
s AS (SELECT doc_id, n, regexp_matches(t, {sql.lit(scoring.DONE)}) AS done,
 least(5, 1 + (n >= 5)::INT + (n >= 12)::INT + {_flag(scoring.CLEAR_BACKGROUND, 'body')} + {_flag(scoring.CLEAR_CORE, 'body')}) AS clarity,
 least(5, {_flag(scoring.ACTIONABLE)} + {_flag(scoring.BOOST_BUSINESS)} + {_flag(scoring.BOOST_CONTENT)}) AS actionability,
 least(5, {_flag(scoring.ASSET)} + 2 * {_flag(scoring.BOOST_BUSINESS)} + {_flag(scoring.BOOST_CONTENT)}) AS asset_value,
 least(5, {_flag(scoring.BUSINESS)} + 2 * {_flag(scoring.BOOST_BUSINESS)}) AS business_value, least(5, {_flag(scoring.CONTENT)} + 2 * {_flag(scoring.BOOST_CONTENT)}) AS content_value,
 least(5, links + {_flag(scoring.EVIDENCE)} + (n >= 20)::INT) AS evidence, {_flag(scoring.ENERGY)} AS personal_energy FROM u),
i AS (SELECT *, round_even((2 * clarity + 3 * actionability + 3 * asset_value + 2 * business_value + 2 * content_value + 2 * evidence + personal_energy)::DOUBLE / 75 * 100, 0)::INT AS total FROM s),
l AS (SELECT *, CASE WHEN done THEN 'done' WHEN total >= 72 AND actionability >= 3 AND asset_value >= 3 THEN 'mature' WHEN total >= 38 OR n >= 10 THEN 'sprout' ELSE 'seed' END AS level,
 CASE WHEN total >= 72 THEN 'P0' WHEN total >= 50 THEN 'P1' WHEN total >= 32 THEN 'P2' ELSE 'P3' END AS priority FROM i)"""


def ideas(spark, d):
    return src.markdown_notes(spark, d).select("doc_id", "name", scoring.idea_scores(F.col("name"), F.col("text")).alias("s"))


@query(f"{_IDEA} SELECT doc_id, clarity, actionability, asset_value, business_value, content_value, evidence, personal_energy, total FROM l")
def cls_idea_scores(spark, d):
    return ideas(spark, d).select("doc_id", *(F.col(f"s.{k}").cast("long").alias(k) for k in [*scoring.WEIGHTS, "total"]))


@query(f"{_IDEA} SELECT doc_id, level, priority, n AS line_count FROM l")
def cls_idea_level(spark, d):
    s = F.col("s")
    return ideas(spark, d).select("doc_id", scoring.idea_level(s).alias("level"), scoring.idea_priority(s).alias("priority"), s["line_count"].cast("long").alias("line_count"))


@query(
    f"{_IDEA} SELECT v.level, count(l.doc_id) AS n, round(100.0 * count(l.doc_id) / (SELECT count(*) FROM l), 6) AS pct FROM (VALUES ('done'), ('mature'), ('sprout'), ('seed')) v(level) LEFT JOIN l USING (level) GROUP BY v.level"
)
def agg_level_hist(spark, d):
    """Levels without ideas keep a row."""
    levels = spark.createDataFrame([(x,) for x in ("done", "mature", "sprout", "seed")], "level string")
    found = ideas(spark, d).select(scoring.idea_level(F.col("s")).alias("level")).groupBy("level").agg(F.count("*").alias("n"))
    rows = levels.join(found, "level", "left").na.fill(0)
    return rows.select("level", "n", F.round(100.0 * F.col("n") / F.sum("n").over(W.partitionBy()), 6).alias("pct"))


_RISK = "list_filter([CASE WHEN clarity < 3 THEN '想法边界还不清楚' END, CASE WHEN actionability < 3 THEN '下一步动作不够具体' END, CASE WHEN evidence < 2 THEN '缺少案例、资料或链接支撑' END, CASE WHEN business_value >= 3 AND actionability < 3 THEN '有商业潜力但缺执行路径' END], lambda x: x IS NOT NULL)"
_SIGNAL = "list_filter([CASE WHEN business_value >= 3 THEN '有商业/增长线索' END, CASE WHEN content_value >= 3 THEN '适合转成内容栏目或选题' END, CASE WHEN asset_value >= 3 THEN '可沉淀为方法论或 Skill' END, CASE WHEN personal_energy >= 3 THEN '有明显个人情绪/叙事能量' END, CASE WHEN evidence >= 3 THEN '已有一定资料或关联支撑' END], lambda x: x IS NOT NULL)"


@query(f"{_IDEA} SELECT doc_id, coalesce(array_to_string({_SIGNAL}, '|'), '') AS signals, coalesce(array_to_string({_RISK}, '|'), '') AS risks FROM l")
def cls_idea_signals(spark, d):
    s = F.col("s")
    return ideas(spark, d).select("doc_id", F.array_join(scoring.idea_signals(s), "|").alias("signals"), F.array_join(scoring.idea_risks(s), "|").alias("risks"))


_ACTS = "list_filter([CASE WHEN clarity < 3 THEN '补一句话定义：它解决什么问题，给谁用。' END, CASE WHEN actionability < 3 THEN '写 3 个下一步动作，最好能在 30 分钟内启动。' END, CASE WHEN evidence < 3 THEN '链接 2-3 篇相关 Clippings 或真实案例。' END, CASE WHEN asset_value >= 3 THEN '整理成框架：输入、步骤、输出、判断标准。' END, CASE WHEN content_value >= 3 THEN '拆 3 个标题/栏目样稿，验证表达方向。' END, CASE WHEN business_value >= 3 THEN '补充目标用户、价值主张和最小可验证场景。' END], lambda x: x IS NOT NULL)"
_HAY_TEXT = sql.normalize("name || ' ' || text")
_KIND = (
    "CASE WHEN regexp_matches(hay, '系统|流程|框架|方法|步骤|模板|prompt|提示词|工作流') THEN '方法论 / Skill 候选' WHEN regexp_matches(hay, '账号|小红书|视频|栏目|采访|故事|创意') THEN '内容企划 / 输出选题' "
    f"WHEN {_hits(scoring.IDEA_THEMES['美业经营'])} > 0 THEN '商业运营框架' WHEN {_hits(scoring.IDEA_THEMES['生活设计'])} > 0 THEN '设计原则 / 实用清单' ELSE '想法观察' END"
)


@query(f"{_IDEA}, hh AS (SELECT doc_id, {_HAY_TEXT} AS hay FROM notes) SELECT l.doc_id, CASE WHEN len({_ACTS}) > 0 THEN array_to_string({_ACTS}[:5], '|') ELSE '保留观察，等更多材料或触发场景出现。' END AS actions, {_KIND} AS asset_type FROM l JOIN hh USING (doc_id)")
def cls_idea_actions(spark, d):
    n = src.markdown_notes(spark, d).select("doc_id", scoring.idea_scores(F.col("name"), F.col("text")).alias("s"), _hay().alias("hay"))
    return n.select("doc_id", F.array_join(scoring.idea_next_actions(F.col("s")), "|").alias("actions"), scoring.idea_asset_type(F.col("hay"), tx.matching(F.col("hay"), scoring.IDEA_THEMES)).alias("asset_type"))


@query(f"SELECT page_id, coalesce(array_to_string(list_filter([{', '.join(f'CASE WHEN regexp_matches(html, {sql.lit(p)}) THEN {sql.lit(k)} END' for k, p in scoring.NOISE_LABELS)}], lambda x: x IS NOT NULL), '|'), '') AS noise FROM pages")
def cls_noise_signals(spark, d):
    return src.clippings(spark, d).select("page_id", F.array_join(scoring.noise_signals(F.col("text")), "|").alias("noise"))


def analysed(spark, d):
    """Clipping analysis of the Markdown notes: every span is extracted once."""
    n = src.markdown_notes(spark, d).select("doc_id", "name", "path", "text", text.clean_content(F.col("text")).alias("clean"))
    n = n.withColumns({"points": spans.key_points(F.col("clean")), "methods": spans.methods(F.col("clean")), "quotes": spans.quotes(F.col("text")), "questions": spans.questions(F.col("clean")), "noise": scoring.noise_signals(F.col("text"))})
    n = n.withColumn("hay", tx.haystack(F.col("name"), F.col("clean"))).withColumns({"ct": tx.content_type(F.col("hay"), F.col("name"), T), "tags": tx.auto_tags(F.col("hay"), T)})
    score = scoring.quality_score(F.col("clean"), F.size("points"), F.size("methods"), F.size("quotes"), F.col("ct.score"), F.size("noise"))
    return n.withColumn("score", score)


@query()
def cls_quality(spark, d):
    a = analysed(spark, d)
    asset = F.create_map(*(F.lit(x) for k, m in T["contentTypes"].items() for x in (k, m["asset"])))
    said = scoring.asset_suggestion(F.coalesce(asset[F.col("ct.type")], F.lit("想法追踪 / 暂存观察")), F.col("score"), F.size("methods"))
    acts = scoring.clipping_actions(F.col("ct.type"), F.col("tags"), F.col("score"), F.size("methods"), F.size("questions"), F.size("quotes"), F.size("noise"), spans.summary(F.col("text"), F.col("clean"))["core"])
    return a.select("doc_id", "score", scoring.quality_tier(F.col("score")).alias("tier"), F.size("points").alias("n_points"), F.size("methods").alias("n_methods"), F.size("quotes").alias("n_quotes"), said.alias("suggestion"), F.array_join(acts, "|").alias("actions"))


@query()
def agg_quality_tiers(spark, d):
    return cls_quality(spark, d).groupBy("tier").agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("avg_score"))


@query()
def agg_methods_excerpt(spark, d):
    """With an inner explode, Spark would filter texts by the size of their methods first: found twice, and before texts are dealt over cores."""
    a = analysed(spark, d).select("doc_id", "score", F.posexplode_outer("methods").alias("pos", "method")).where("pos is not null")
    return a.orderBy(F.desc("score"), "doc_id", "pos").limit(15)


@query(
    f"WITH {sql.MARKED_NOTES}, h AS (SELECT doc_id, md5({sql.clean_content('text')}) AS hash, length(text) AS score, name FROM notes), r AS (SELECT *, row_number() OVER w AS rn, first_value(name) OVER w AS first FROM h WINDOW w AS (PARTITION BY hash ORDER BY score DESC, name)) SELECT first, name AS later FROM r WHERE rn > 1"
)
def agg_dups(spark, d):
    n = src.marked_notes(spark, d).select("name", text.content_hash(F.col("text")).alias("hash"), F.length("text").alias("score"))
    w = W.partitionBy("hash").orderBy(F.desc("score"), "name")
    return n.withColumns({"rn": F.row_number().over(w), "first": F.first("name").over(w)}).where("rn > 1").select("first", F.col("name").alias("later"))


@query()
def cls_skill_candidates(spark, d):
    """Scores are found once: a filter on them, or ranges of them that are sampled for the order, would read the texts again."""
    score = F.filter(F.array(scoring.skill_candidate_score(F.col("text"))), lambda x: x >= 3)
    n = store(src.markdown_notes(spark, d).select("doc_id", F.explode(score).alias("score")), "candidates")
    return n.orderBy(F.desc("score"), "doc_id")


@query()
def cls_skill_dims(spark, d):
    n = src.markdown_notes(spark, d).select("doc_id", "name", "text", scoring.skill_dimensions(F.col("text"), F.col("name")).alias("s"))
    return n.select("doc_id", "s.*", scoring.conclusion(F.col("s.yes_count")).alias("conclusion"), F.array_join(scoring.skill_gaps(F.col("s")), "|").alias("gaps"), scoring.skill_type(F.col("name"), F.col("text")).alias("skill_type"))


_ORIGINS = ("原文抽取", "regex", "ai_infer", "AI 推测", "llm", "待补充", "none", "manual")


@query("WITH d AS (SELECT doc_id, ['原文抽取', 'regex', 'ai_infer', 'AI 推测', 'llm', '待补充', 'none', 'manual'][doc_id % 8 + 1] AS origin FROM documents) SELECT doc_id, origin, CASE WHEN origin IN ('原文抽取', 'regex') THEN '原文抽取' WHEN origin IN ('ai_infer', 'AI 推测', 'llm') THEN 'AI 分析结果' WHEN origin IN ('待补充', 'none') THEN '待补充' ELSE origin END AS label FROM d")
def cls_source_label(spark, d):
    n = src.notes(spark, d).select("doc_id", F.get(F.array(*map(F.lit, _ORIGINS)), (F.col("doc_id") % 8).cast("int")).alias("origin"))
    return n.withColumn("label", scoring.source_label(F.col("origin")))


@query()
def cls_skill_fields(spark, d):
    n = src.markdown_notes(spark, d).select("doc_id", scoring.skill_situation(F.col("text")).alias("a"), scoring.skill_form(F.col("text"), F.col("name")).alias("b"))
    return n.select("doc_id", "a.*", "b.*")


def card_texts(spark, d):
    """A card for each document, with fields that are filled in, open or missing by its id."""
    i = F.col("doc_id")
    field = lambda label, k: F.when(F.floor(i / k) % 3 == 0, "").otherwise(F.concat(F.lit(f"- **{label}**：" + ("3 步 " if label == "关键动作数" else "")), F.when(F.floor(i / k) % 3 == 1, "待补充").otherwise("known"), F.lit("\n")))
    dims = [F.concat(F.lit(f"| {label} | "), F.when(i % k == 0, "✅").otherwise("❌"), F.lit(" | why | 原文抽取 |\n")) for k, label in enumerate(cards_.DIMENSIONS, 2)]
    fields = [field(label, k) for k, label in enumerate([*cards_.SITUATION_FIELDS, *cards_.FORM_FIELDS], 1)]
    todos = F.repeat(F.lit("- [ ] todo\n- [x] did\nplain\n"), (i % 4).cast("int"))
    text = F.concat(
        F.when(i % 5 == 0, F.lit("no heading\n")).otherwise(F.concat(F.lit("# EVAL："), "name", F.lit("\n"))), F.when(i % 4 == 0, "").otherwise(F.concat(F.lit("评估结论："), F.when(i % 3 == 0, "🔴").when(i % 3 == 1, "🟡").otherwise("🟢"), F.lit(" ("), (i % 6).cast("string"), F.lit("/5 项 ✅)\n"))),
        *dims, *fields, F.lit("## 4\ufe0f\u20e3 Gap 清单\n"), todos, F.lit("\n## 5 end\n- [ ] not a gap\n"),
    )
    return src.notes(spark, d).select("doc_id", "name", text.alias("text"))


def _gap_sql(fields: dict, start: int) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN (doc_id // {k}) % 3 < 2 THEN {sql.lit(v)} END" for k, v in enumerate(fields.values(), start)) + "], lambda x: x IS NOT NULL), '|')"


_GAPS_OF = lambda fields, start: "(" + " + ".join(f"((doc_id // {k}) % 3 < 2)::INT" for k, _ in enumerate(fields, start)) + ")"
_PARSED = (
    "SELECT doc_id, CASE WHEN doc_id % 4 = 0 OR doc_id % 3 = 2 THEN 'green' WHEN doc_id % 3 = 0 THEN 'red' ELSE 'yellow' END AS conclusion, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE doc_id % 6 END AS yes, "
    f"{_GAPS_OF(cards_.SITUATION_FIELDS, 1)} AS s2, {_GAPS_OF(cards_.FORM_FIELDS, 6)} AS s3, CASE WHEN (doc_id // 9) % 3 = 0 THEN 0 ELSE 3 END AS step_count, CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 2 * (doc_id % 4) END AS todos FROM documents"
)
_CARD = f"c AS ({_PARSED}), v AS (SELECT *, CASE WHEN conclusion = 'green' OR yes <= 1 THEN 0 WHEN yes = 2 THEN 1 WHEN 6 - s3 < 2 THEN 2 WHEN 5 - s2 < 3 OR todos >= 3 THEN 3 WHEN todos >= 1 THEN 4 ELSE 5 END AS level FROM c)"


def cards(spark, d):
    """Cards parsed from their texts, with levels."""
    c = card_texts(spark, d).select("doc_id", cards_.card(F.col("text"), F.col("name")).alias("c"))
    level = scoring.card_level(F.col("c.conclusion"), F.col("c.yes_count"), F.size("c.situation_gaps"), F.size("c.form_gaps"), F.size("c.todos"))
    return c.select("doc_id", "c.*", level.alias("level"))


@query(f"WITH {_CARD} SELECT doc_id, yes, CASE WHEN yes >= 4 THEN 'red' WHEN yes >= 2 THEN 'yellow' ELSE 'green' END AS conclusion, conclusion AS written FROM v")
def cls_skill_conclusion(spark, d):
    """The conclusion that a card's number of signs leads to, beside the one it states."""
    return cards(spark, d).select("doc_id", F.col("yes_count").alias("yes"), scoring.conclusion(F.col("yes_count")).alias("conclusion"), F.col("conclusion").alias("written"))


@query(f"WITH {_CARD} SELECT doc_id, level FROM v")
def cls_level(spark, d):
    return cards(spark, d).select("doc_id", "level")


@query(f"WITH {_CARD} SELECT g.level, count(v.doc_id) AS n FROM (VALUES (0), (1), (2), (3), (4), (5)) g(level) LEFT JOIN v USING (level) GROUP BY g.level")
def agg_card_levels(spark, d):
    every = spark.createDataFrame([(k,) for k in range(6)], "level int")
    return every.join(cards(spark, d).groupBy("level").agg(F.count("*").alias("n")), "level", "left").na.fill(0)


@query(f"WITH {_CARD} SELECT conclusion, count(*) AS n FROM v WHERE yes >= 2 GROUP BY conclusion")
def agg_card_index(spark, d):
    return cards(spark, d).where("yes_count >= 2").groupBy("conclusion").agg(F.count("*").alias("n"))


@query(
    f"SELECT doc_id, 'doc_' || doc_id AS title, CASE WHEN doc_id % 4 = 0 OR doc_id % 3 = 2 THEN 'green' WHEN doc_id % 3 = 0 THEN 'red' ELSE 'yellow' END AS conclusion, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE doc_id % 6 END AS yes_count, CASE WHEN doc_id % 2 = 0 THEN '✅' ELSE '❌' END AS reusable, "
    f"coalesce({_gap_sql(cards_.SITUATION_FIELDS, 1)}, '') AS situation_gaps, coalesce({_gap_sql(cards_.FORM_FIELDS, 6)}, '') AS form_gaps, CASE WHEN (doc_id // 9) % 3 = 0 THEN 0 ELSE 3 END AS step_count, CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 2 * (doc_id % 4) END AS n_todos FROM documents"
)
def cls_card_fields(spark, d):
    c = card_texts(spark, d).select("doc_id", cards_.card(F.col("text"), F.col("name")).alias("c"))
    return c.select("doc_id", "c.title", "c.conclusion", "c.yes_count", "c.status.reusable", F.array_join("c.situation_gaps", "|").alias("situation_gaps"), F.array_join("c.form_gaps", "|").alias("form_gaps"), "c.step_count", F.size("c.todos").alias("n_todos"))


_OPEN = lambda name: f"(doc_id // {6 + list(cards_.FORM_FIELDS.values()).index(name)}) % 3 < 2"
_ACTIONS = (
    ("level = 5", "✅ 已就绪：可提交 skill_workshop 或转成正式 Skill。"), ("level <= 1 AND conclusion = 'green'", "先判断「继续投入价值」：低价值想法可归档，不必强行升 Level。"),
    ("level <= 1 AND conclusion <> 'green'", "确认这是不是「一次性观察」——若能预见未来会再遇同类需求，才继续升级。"), ("level <= 2", "把可复用性/输入稳定性写清楚，或用一次真实执行补足证据。"),
    (f"level <= 3 AND {_OPEN('输入')}", "明确 Skill 输入：需要什么材料/参数？"), (f"level <= 3 AND {_OPEN('输出')}", "明确 Skill 输出：产物形式是什么？"), (f"level <= 3 AND {_OPEN('工具/账号')}", "列出必需的工具、API、账号权限。"),
    (f"level <= 3 AND {_OPEN('步骤')} AND step_count < 3", "补充 ≥3 个明确编号步骤。"), ("level = 4", "补齐后跑一次真实场景，把结果作为 Level 5 的「验证证据」。"),
)


@query(f"WITH {_CARD} SELECT doc_id, coalesce(nullif(array_to_string(list_filter([{', '.join(f'CASE WHEN {test} THEN {sql.lit(said)} END' for test, said in _ACTIONS)}], lambda x: x IS NOT NULL), '|'), ''), '继续把下一 Level 需要的条件补齐。') AS actions FROM v")
def cls_card_actions(spark, d):
    return cards(spark, d).select("doc_id", F.array_join(scoring.card_actions(F.col("level"), F.col("conclusion"), F.col("form_gaps"), F.col("step_count")), "|").alias("actions"))


def _platform_sql(c: str) -> str:
    tests = " ".join(f"WHEN {' OR '.join(f'contains({c}, {sql.lit(h.lower())})' for h in hs)} THEN {sql.lit(k)}" for k, hs in scoring.PLATFORMS.items())
    return f"CASE {tests} ELSE '未标注' END"


@query(f"WITH {sql.MARKED_NOTES} SELECT {_platform_sql('lower(text)')} AS platform, count(*) AS n FROM notes GROUP BY 1")
def cls_platform(spark, d):
    return src.marked_notes(spark, d).groupBy(scoring.platform(F.col("text")).alias("platform")).agg(F.count("*").alias("n"))


@query(f"WITH {sql.NOTES} SELECT strftime(mtime, '%Y-%m') AS month, count(*) AS n, sum(strlen(text))::BIGINT AS bytes FROM notes WHERE layer = 'output' GROUP BY 1")
def agg_monthly(spark, d):
    n = src.notes(spark, d).where("layer = 'output'")
    return n.groupBy(F.date_format("mtime", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))


_ASSET = f"CASE WHEN regexp_matches(hay, '步骤|流程|prompt|提示词|工作流|教程|指南') THEN 'Skill 候选 / 工作流' WHEN layer = 'inbox' AND regexp_matches(hay, '账号|选题|视频|栏目|创意') THEN '输出选题 / 内容企划' WHEN {_hits(T['themes']['french'])} > 0 THEN 'french notes' ELSE '暂存观察' END"


@query(f"{_HM} SELECT doc_id, {_ASSET} AS asset FROM h")
def cls_asset(spark, d):
    n = src.marked_notes(spark, d).withColumn("hay", _hay())
    h = F.col("hay")
    themed = F.size(tx.matching(h, {"french": T["themes"]["french"]})) > 0
    asset = F.when(h.rlike("步骤|流程|prompt|提示词|工作流|教程|指南"), "Skill 候选 / 工作流").when((F.col("layer") == "inbox") & h.rlike("账号|选题|视频|栏目|创意"), "输出选题 / 内容企划").when(themed, "french notes").otherwise("暂存观察")
    return n.select("doc_id", asset.alias("asset"))
