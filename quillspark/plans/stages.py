"""The nine stages as functions that return frames, and a runner for all of them.

notes: (path, name, layer, bucket, mtime, text), layer being inbox, distilled, skills or output; within the
inbox, bucket "ideas" or "clippings" tells the two kinds of input apart. Every result is a lazy frame;
nothing is collected. as_of is a timestamp column, so that runs can be repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import scoring, spans, text, tokens
from quillspark.functions import taxonomy as tx
from quillspark.operators import graph, similarity, state

IDEAS, CLIPPINGS = "ideas", "clippings"


def _hay(body: str = "text") -> Column:
    return tx.haystack(F.col("name"), F.col(body))


def daily(new: DataFrame, taxonomy: dict) -> dict[str, DataFrame]:
    """Digest of new inputs: items with themes, asset class, next action and preview; keywords; themes; categories."""
    n = new.withColumn("text", F.left("text", F.lit(12000)))
    n = n.withColumn("clean", text.clean_text(F.col("text"))).withColumn("hay", _hay("clean"))
    themes = tx.themes(F.col("hay"), taxonomy)
    told = taxonomy.get("themeTexts", {})
    texts = lambda what, other: F.create_map(*(F.lit(x) for k in taxonomy["themes"] for x in (k, told.get(k, {}).get(what) or other(k)))) if taxonomy["themes"] else F.create_map()
    assets, following = texts("asset", lambda k: f"{k} notes"), texts("next", lambda k: f"next: {k}")
    first = F.get(F.col("themes"), F.lit(0))
    flow, plan = F.col("hay").rlike("步骤|流程|prompt|提示词|工作流|教程|指南"), F.col("hay").rlike("账号|选题|视频|栏目|创意")
    asset = F.when(flow, "Skill 候选 / 工作流").when((F.col("bucket") == IDEAS) & plan, "输出选题 / 内容企划").when(first.isNotNull(), assets[first]).otherwise("暂存观察")
    action = F.when(first.isNotNull(), following[first]).when(F.col("bucket") == IDEAS, "补充：为什么重要、目标受众、下一步动作。").otherwise("先判断是否值得提炼：核心观点、可复用方法、是否关联当前项目。")
    items = n.withColumn("themes", themes)
    items = items.select("path", "name", "bucket", "mtime", "themes", asset.alias("asset"), action.alias("action"), text.preview(F.col("clean")).alias("preview"), spans.bullets(F.col("text")).alias("bullets"), tx.categories(F.col("hay"), taxonomy).alias("categories"), F.md5("text").alias("hash"))
    counts = items.select(F.explode("themes").alias("theme")).groupBy("theme").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "theme").limit(5)
    return {"daily_items": items, "daily_keywords": tokens.daily_keywords(n), "daily_themes": counts}


def weekly(new: DataFrame, taxonomy: dict) -> dict[str, DataFrame]:
    """Title-weighted themes with examples, the directions of clippings, promising ideas, keywords."""
    hay, name = _hay(), text.normalize(F.col("name"))
    rows = []
    for k, kws in taxonomy["themes"].items():
        rows.append(F.struct(F.lit(k).alias("theme"), sum((hay.contains(tx.plain(w)).cast("int") * (1 + 2 * name.contains(tx.plain(w)).cast("int")) for w in kws), F.lit(0)).alias("score")))
    scored = new.select("path", "name", "bucket", "mtime", F.explode(F.array(*rows)).alias("x")).select("path", "name", "bucket", "mtime", "x.*").where("score > 0")
    themes = scored.groupBy("theme").agg(F.sum("score").alias("score"), F.count("*").alias("n"))
    best = scored.withColumn("rank", F.row_number().over(W.partitionBy("theme").orderBy(F.desc("score"), F.desc("mtime"), "path"))).where("rank <= 5")
    top = themes.orderBy(F.desc("score"), F.desc("n"), "theme").limit(5)
    directions = best.where(F.col("bucket") == CLIPPINGS).join(top.select("theme"), "theme").groupBy("theme").agg(F.slice(F.sort_array(F.collect_list(F.struct("rank", "name"))), 1, 3)["name"].alias("examples"))
    ideas = new.where(F.col("bucket") == IDEAS).select("path", "name", "mtime", tx.hits(name, ["系统", "运营", "风险", "账号", "创意", "方法", "商业", "客户", "ai"]).alias("priority"))
    return {"weekly_themes": themes, "weekly_examples": best, "weekly_directions": directions, "weekly_ideas": ideas.orderBy(F.desc("priority"), F.desc("mtime"), "path").limit(5), "weekly_keywords": tokens.weekly_keywords(new)}


def ideas(all_notes: DataFrame) -> dict[str, DataFrame]:
    n = all_notes.where(F.col("bucket") == IDEAS).select("path", "name", scoring.idea_scores(F.col("name"), F.col("text")).alias("s"), _hay().alias("hay"))
    s, themes = F.col("s"), tx.matching(F.col("hay"), scoring.IDEA_THEMES)
    rows = n.select("path", "name", "s", scoring.idea_level(s).alias("level"), scoring.idea_priority(s).alias("priority"), themes.alias("themes"), scoring.idea_signals(s).alias("signals"), scoring.idea_risks(s).alias("risks"), scoring.idea_next_actions(s).alias("next_actions"), scoring.idea_asset_type(F.col("hay"), themes).alias("asset_type"))
    return {"ideas": rows, "idea_levels": rows.groupBy("level").agg(F.count("*").alias("n"))}


def clippings(all_notes: DataFrame, taxonomy: dict) -> dict[str, DataFrame]:
    """Quality, type, tags, points, methods, quotes and questions of each clipping; duplicates; distributions."""
    c = F.col("clean")
    n = all_notes.where(F.col("bucket") == CLIPPINGS).select("path", "name", "text", text.clean_content(F.col("text")).alias("clean"))
    n = n.withColumns({"points": spans.key_points(c), "methods": spans.methods(c), "quotes": spans.quotes(F.col("text")), "questions": spans.questions(c), "noise": scoring.noise_signals(F.col("text")), "hay": tx.haystack(F.col("name"), c)})
    n = n.withColumns({"t": tx.content_type(F.col("hay"), F.col("name"), taxonomy), "tags": tx.auto_tags(F.col("hay"), taxonomy), "summary": spans.summary(F.col("text"), c)})
    score = scoring.quality_score(c, F.size("points"), F.size("methods"), F.size("quotes"), F.col("t.score"), F.size("noise"))
    rows = n.select("path", "name", score.alias("score"), F.col("t.type").alias("type"), "tags", "summary", spans.author(F.col("text")).alias("author"), spans.core_thesis(F.col("text"), c).alias("core_thesis"), "points", "methods", "quotes", "questions", "noise", F.md5(c).alias("content_hash"), F.length(c).alias("chars"))
    w = W.partitionBy("content_hash").orderBy(F.desc("score"), "name")
    dups = rows.withColumns({"first": F.first("name").over(w), "rn": F.row_number().over(w)}).where("rn > 1").select("first", F.col("name").alias("later"))
    return {"clippings": rows, "clipping_duplicates": dups, "clipping_types": rows.groupBy("type").agg(F.count("*").alias("n")), "clipping_tags": rows.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))}


def skills(all_notes: DataFrame, min_score: int = 3) -> dict[str, DataFrame]:
    """Candidate cards: five dimensions, conclusion, gaps, situation and form."""
    t, n = F.col("text"), F.col("name")
    c = all_notes.where("layer = 'inbox'").withColumn("score", F.explode(F.filter(F.array(scoring.skill_candidate_score(t)), lambda x: x >= min_score)))
    cards = c.select("path", "name", "score", scoring.skill_dimensions(t, n).alias("dims"), scoring.skill_situation(t).alias("situation"), scoring.skill_form(t, n).alias("form"), F.substring(F.md5("text"), 1, 12).alias("content_key"))
    cards = cards.withColumn("conclusion", scoring.conclusion(F.col("dims.yes_count"))).withColumn("gaps", scoring.skill_gaps(F.col("dims")))
    return {"skill_cards": cards, "skill_index": cards.groupBy("conclusion").agg(F.count("*").alias("n"))}


def roadmap(cards: DataFrame, min_yes: int = 2) -> dict[str, DataFrame]:
    """Levels and next actions of cards, from how many of their fields are still open."""
    open_of = lambda s, names: F.filter(F.array(*(F.when(F.col(f"{s}.{k}") == scoring.UNKNOWN, F.lit(label)) for k, label in names.items())), lambda x: x.isNotNull())
    labels = {"inputs": "输入", "outputs": "输出", "tools": "工具", "not_required": "不需要"}
    rows = cards.withColumns({"s2": open_of("situation", {k: k for k in scoring.SITUATION}), "s3": open_of("form", labels)})
    level = scoring.card_level(F.col("conclusion"), F.col("dims.yes_count"), F.size("s2"), F.size("s3"), F.size("gaps"))
    rows = rows.withColumn("level", level)
    rows = rows.withColumn("actions", scoring.card_actions(F.col("level"), F.col("conclusion"), F.col("s3"), F.col("form.step_count")))
    return {"roadmap": rows.where(F.col("dims.yes_count") >= min_yes).select("path", "name", "level", "conclusion", "s2", "s3", "actions"), "roadmap_levels": rows.groupBy("level").agg(F.count("*").alias("n"))}


def links(all_notes: DataFrame, clips: DataFrame, taxonomy: dict, backend: str = "tfidf", threshold: int = 34) -> dict[str, DataFrame]:
    """Suggestions in both directions: three ideas for a clipping, five clippings for an idea."""
    c = clips.where("score >= 50").select(F.col("path").alias("key"), "name", F.col("type").alias("ctype"), F.left(F.concat_ws("\n", "name", "type", F.concat_ws(" ", "tags"), "summary.core", F.concat_ws(" ", "points"), F.concat_ws(" ", "methods")), F.lit(1800)).alias("text"))
    i = all_notes.where(F.col("bucket") == IDEAS).select(F.col("path").alias("key"), "name", F.lit("").alias("ctype"), F.concat_ws("\n", "name", text.first_paragraph(F.col("text"), 1200)).alias("text"))
    found = lambda k, back: similarity.top_links(c, i, taxonomy, k, threshold, backend, back)
    return {"links_clip_to_idea": found(3, False), "links_idea_to_clip": found(5, True).select(F.col("b").alias("a"), F.col("a").alias("b"), "score", "rank")}


def feedback(all_notes: DataFrame) -> dict[str, DataFrame]:
    p = all_notes.where("layer = 'output'")
    return {"published_platforms": p.groupBy(scoring.platform(F.col("text")).alias("platform")).agg(F.count("*").alias("n")), "published_months": p.groupBy(F.date_format("mtime", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")), "published_words": tokens.published_words(p)}


def audit(spark: SparkSession, all_notes: DataFrame, as_of: Column) -> dict[str, DataFrame]:
    rows = graph.assets(all_notes, as_of)
    stats = graph.layer_stats(rows, spark)
    return {"audit_assets": rows, "audit_layers": stats, "audit_buckets": graph.bucket_stats(rows), "audit_totals": graph.vault_totals(rows), "audit_top": graph.top_assets(rows, 8, False), "audit_curated": graph.top_assets(rows, 8, True), "audit_cold": graph.cold_assets(rows), "audit_orphans": graph.orphans(rows), "audit_advice": graph.recommendations(stats)}


def run(spark: SparkSession, all_notes: DataFrame, old_state: DataFrame, as_of: Column, taxonomy: dict = tx.SAMPLE) -> dict[str, DataFrame]:
    """All stages. Daily and weekly see what is new or changed under their own task; publish next_state
    after the other results are written."""
    inbox = all_notes.where("layer = 'inbox'")
    out, nxt = {}, old_state
    for task, stage in (("daily", daily), ("weekly", weekly)):
        scanned = state.scan(inbox, old_state, task)
        out |= stage(state.incremental(scanned), taxonomy)
        nxt = state.committed(scanned, nxt, task, as_of.cast("timestamp_ntz"))
    out |= ideas(all_notes) | clippings(all_notes, taxonomy) | skills(all_notes)
    out |= roadmap(out["skill_cards"]) | links(all_notes, out["clippings"], taxonomy) | feedback(all_notes) | audit(spark, all_notes, as_of)
    return out | {"next_state": nxt}


def cards_to_write(cards: DataFrame, written: DataFrame, key: str = "path", digest: str = "content_hash") -> DataFrame:
    """Cards whose content changed, or whose file is gone."""
    return cards.join(written.select(key, digest), [key, digest], "left_anti")


def write(results: dict[str, DataFrame], folder: str) -> None:
    """Each result as a table of its own; next_state is left to state.publish()."""
    for name, df in results.items():
        if name != "next_state":
            df.write.mode("overwrite").parquet(f"{folder}/{name}")
