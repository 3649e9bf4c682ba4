"""Queries over links, audit and similarity."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import scoring, spans, tokens
from quillspark.functions import taxonomy as tx
from quillspark.operators import graph, similarity
from quillspark.sources import notes as src

from . import sql
from .registry import query

T = tx.SAMPLE
_LINKED = f"WITH {sql.MARKED_NOTES}, w AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'DRAFT_' || name ELSE name END AS name, CASE WHEN doc_id % 26 = 0 THEN 'skills/p/references/' || path ELSE path END AS path, layer, bucket, mtime, text || CASE WHEN doc_id % 13 = 0 THEN '' ELSE ' [[doc_' || (doc_id * 7 % 1000) || '|x]] [[doc_' || (doc_id * 3 % 1500) || '#s]] [[ ]]' END || CASE WHEN doc_id % 5 = 0 THEN chr(10) || '- [ ] task' ELSE '' END AS text FROM notes)"
_TARGETS = "list_filter(list_transform(regexp_extract_all(text, '\\[\\[(.+?)\\]\\]', 1), lambda x: trim(split_part(split_part(x, '|', 1), '#', 1))), lambda x: x <> '')"
_GEN = "(" + " OR ".join(f"contains(name, {sql.lit(m)})" for m in scoring.GENERATED) + ")"
_EDGES = f"{_LINKED}, g AS (SELECT *, {_GEN} AS generated, {_TARGETS} AS targets FROM w), e AS (SELECT name, generated, unnest(targets) AS target FROM g)"
_BACK = f"{_EDGES}, k AS (SELECT target AS name, count(*) AS backlinks, count(*) FILTER (NOT generated) AS curated_backlinks FROM e WHERE target IN (SELECT name FROM g) GROUP BY target)"
_ASSETS = f"""{_BACK}, a AS (SELECT g.name, g.path, g.layer, g.bucket, date_diff('day', mtime, TIMESTAMP '2024-05-01') AS age_days, len(targets) AS link_count, coalesce(backlinks, 0) AS backlinks, coalesce(curated_backlinks, 0) AS curated_backlinks, length(text) AS chars, generated,
 (starts_with(g.name, 'DRAFT_') OR contains(path, '待整理') OR contains(left(text, 3000), '[ ]')) AS draft, (contains(path, '已发表') OR regexp_matches(text, '(?i)发布链接|已发布|published')) AS published,
 contains('/' || path, 'skills/') AND (regexp_matches('/' || path, '/(references|templates|assets|examples)/') OR ends_with('/' || path, '/SKILL.md')) AS package_doc FROM g LEFT JOIN k USING (name)),
r AS (SELECT *, link_count + backlinks AS total_links, CASE WHEN generated THEN 0 ELSE link_count END + curated_backlinks AS curated_links FROM a), t AS (SELECT *, NOT generated AND NOT package_doc AND curated_links = 0 AS orphan FROM r)"""


def linked(spark, d):
    """Marked notes with links to other notes, some to none, some without links, some drafts and package documents."""
    i = F.col("doc_id")
    some = F.when(i % 13 == 0, "").otherwise(F.concat(F.lit(" [[doc_"), (i * 7 % 1000), F.lit("|x]] [[doc_"), (i * 3 % 1500), F.lit("#s]] [[ ]]")))
    extra = F.concat(some, F.when(i % 5 == 0, "\n- [ ] task").otherwise(""))
    path = F.when(i % 26 == 0, F.concat(F.lit("skills/p/references/"), "path")).otherwise(F.col("path"))
    return src.marked_notes(spark, d).withColumns({"path": path, "text": F.concat("text", extra), "name": F.when(i % 9 == 0, F.concat(F.lit("DRAFT_"), "name")).otherwise(F.col("name"))})


def assets(spark, d):
    return graph.assets(linked(spark, d), F.lit(src.AS_OF))


@query(f"{_EDGES} SELECT name, target, count(*) AS n FROM e GROUP BY ALL")
def span_links(spark, d):
    n = linked(spark, d).withColumn("generated", scoring.is_generated(F.col("name")))
    return graph.links(n).groupBy("name", "target").agg(F.count("*").alias("n"))


@query(f"{_BACK} SELECT * FROM k")
def join_semi_backlinks(spark, d):
    n = linked(spark, d).withColumn("generated", scoring.is_generated(F.col("name")))
    return graph.backlinks(graph.links(n), n)


@query("WITH e AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS href FROM pages), u AS (SELECT DISTINCT url FROM pages) SELECT href, count(*) AS n, count(u.url) AS n_known FROM e LEFT JOIN u ON u.url = e.href GROUP BY href")
def join_page_links(spark, d):
    """Links of pages, and how many of them lead to a page of the table."""
    p = src.clippings(spark, d)
    e = p.select(F.explode(F.regexp_extract_all("text", F.lit('href="([^"]+)"'), F.lit(1))).alias("href"))
    known = p.select(F.col("url").alias("href")).where("href is not null").distinct().withColumn("known", F.lit(1))
    return e.join(known, "href", "left").groupBy("href").agg(F.count("*").alias("n"), F.count("known").alias("n_known"))


@query(f"{_ASSETS} SELECT name, age_days, link_count, backlinks, total_links, curated_links, orphan, draft, published FROM t")
def agg_assets(spark, d):
    return assets(spark, d).select("name", F.col("age_days").cast("long").alias("age_days"), F.col("link_count").cast("long").alias("link_count"), "backlinks", "total_links", "curated_links", "orphan", "draft", "published")


_HEALTH = "CASE WHEN n = 0 THEN '空' WHEN generated / n > 0.75 AND layer = 'distilled' THEN '自动产物偏多' WHEN orphans / n > 0.65 AND layer NOT IN ('inbox', 'output') THEN '需整理' WHEN layer = 'inbox' AND avg_curated < 1 THEN '待蒸馏' WHEN avg_curated >= 1.5 OR recent >= greatest(1, n // 5) THEN '健康' ELSE '可优化' END"
_LAYERS = f"{_ASSETS}, s AS (SELECT v.layer, count(t.name) AS n, count(*) FILTER (age_days <= 7) AS recent, count(*) FILTER (age_days > 30) AS cold, count(*) FILTER (generated) AS generated, count(*) FILTER (draft) AS drafts, count(*) FILTER (orphan) AS orphans, coalesce(avg(curated_links), 0) AS avg_curated, coalesce(avg(total_links), 0) AS avg_total FROM (VALUES ('inbox'), ('distilled'), ('skills'), ('output'), ('other')) v(layer) LEFT JOIN t USING (layer) GROUP BY v.layer)"


@query(f"{_LAYERS} SELECT layer, n, recent, cold, generated, drafts, orphans, round(avg_curated, 6) AS avg_curated, round(avg_total, 6) AS avg_total, {_HEALTH} AS health FROM s")
def agg_layer_health(spark, d):
    return graph.layer_stats(assets(spark, d), spark).select("layer", "n", "recent", "cold", "generated", "drafts", "orphans", F.round("avg_curated", 6).alias("avg_curated"), F.round("avg_total", 6).alias("avg_total"), "health")


@query(f"{_ASSETS} SELECT bucket, count(*) AS n, count(*) FILTER (generated) AS generated, round(avg(curated_links), 6) AS avg_curated, count(*) FILTER (age_days <= 7) AS recent FROM t GROUP BY bucket")
def agg_bucket(spark, d):
    return graph.bucket_stats(assets(spark, d)).select("bucket", "n", "generated", F.round("avg_curated", 6).alias("avg_curated"), "recent")


@query(f"{_ASSETS} SELECT count(*) AS n, sum(chars)::BIGINT AS chars, count(*) FILTER (orphan) AS orphans, count(*) FILTER (draft) AS drafts, round(count(*) FILTER (orphan) / nullif(count(*), 0), 6) AS orphan_rate, round(count(*) FILTER (published) / nullif(count(*) FILTER (draft), 0), 6) AS conversion FROM t")
def agg_vault_totals(spark, d):
    return graph.vault_totals(assets(spark, d)).select("n", "chars", "orphans", "drafts", F.round("orphan_rate", 6).alias("orphan_rate"), F.round("conversion", 6).alias("conversion"))


@query(f"{_ASSETS} SELECT path, curated_links, chars FROM t ORDER BY curated_links DESC, chars DESC, path LIMIT 8")
def sort_topk_assets(spark, d):
    return graph.top_assets(assets(spark, d), 8, True).select("path", "curated_links", F.col("chars").cast("long").alias("chars"))


@query(f"{_ASSETS}, c AS (SELECT * FROM t WHERE age_days > 30 ORDER BY age_days DESC, path LIMIT 20) SELECT path, age_days FROM c WHERE NOT generated ORDER BY age_days DESC, path LIMIT 10")
def sort_cold_assets(spark, d):
    return graph.cold_assets(assets(spark, d)).select("path", F.col("age_days").cast("long").alias("age_days"))


@query(f"{_ASSETS} SELECT layer, path FROM t WHERE orphan ORDER BY layer, path LIMIT 12")
def sort_orphans(spark, d):
    return graph.orphans(assets(spark, d)).select("layer", "path")


_ADVICE = {
    "inbox_unlinked": "max(orphans) FILTER (layer = 'inbox')", "distilled_generated": "CASE WHEN max(generated / nullif(n, 0)) FILTER (layer = 'distilled') > 0.6 THEN max(n) FILTER (layer = 'distilled') ELSE 0 END",
    "skill_drafts": "max(drafts) FILTER (layer = 'skills')", "output_empty": "CASE WHEN max(n) FILTER (layer = 'output') = 0 THEN 1 ELSE 0 END", "unlinked": "sum(orphans) FILTER (layer NOT IN ('inbox', 'output'))",
    "cold": "sum(cold)", "outside": "max(n) FILTER (layer = 'other')",
}


@query(f"{_LAYERS} SELECT code, n FROM ({' UNION ALL '.join(f'SELECT {sql.lit(k)} AS code, CAST({v} AS BIGINT) AS n FROM s' for k, v in _ADVICE.items())}) WHERE n > 0")
def agg_recommendations(spark, d):
    return graph.recommendations(graph.layer_stats(assets(spark, d), spark))


def report_lines(spark, d):
    """A link report for each source: a heading, then lines of which some are checked."""
    n = src.notes(spark, d).select(F.col("bucket").alias("report"), "doc_id", "name")
    line = F.when(F.col("doc_id") % 6 == 0, F.concat(F.lit("### [["), "name", F.lit("]]"))).when(F.col("doc_id") % 2 == 0, F.concat(F.lit("- [x] → [["), "name", F.lit("]] · why "), "doc_id")).otherwise(F.concat(F.lit("- [ ] → [["), "name", F.lit("]] · no")))
    return n.select("report", F.col("doc_id").alias("pos"), line.alias("line"))


_REPORT = f"WITH {sql.NOTES}, l AS (SELECT bucket AS report, doc_id AS pos, name, doc_id % 6 = 0 AS head, doc_id % 2 = 0 AS checked FROM notes), f AS (SELECT *, last_value(CASE WHEN head THEN name END IGNORE NULLS) OVER (PARTITION BY report ORDER BY pos ROWS UNBOUNDED PRECEDING) AS source FROM l), p AS (SELECT report, pos, source, name AS target, 'why ' || pos AS reason FROM f WHERE checked AND NOT head AND source IS NOT NULL)"


@query(f"{_REPORT} SELECT * FROM p")
def span_approved(spark, d):
    return graph.approved(report_lines(spark, d))


@query(f"{_REPORT} SELECT source, count(*) AS n FROM p GROUP BY source")
def win_ffill_heading(spark, d):
    return graph.approved(report_lines(spark, d)).groupBy("source").agg(F.count("*").alias("n"))


@query(f"{_REPORT}, s AS (SELECT source, count(*) AS n FROM p GROUP BY source) SELECT (SELECT sum(n)::BIGINT FROM s WHERE source IN (SELECT name FROM notes)) AS applied_links, (SELECT count(*) FROM s WHERE source IN (SELECT name FROM notes)) AS changed_files, (SELECT count(*) FROM s WHERE source NOT IN (SELECT name FROM notes)) AS missing_sources")
def span_apply_counts(spark, d):
    return graph.applied_counts(src.notes(spark, d), graph.approved(report_lines(spark, d)))


@query()
def span_apply_links(spark, d):
    rows, _ = graph.apply_approved(src.notes(spark, d), graph.approved(report_lines(spark, d)))
    return rows.select("name", "changed", F.length("updated").alias("chars"), F.md5("updated").alias("hash"))


_STOP = ", ".join(map(sql.lit, tokens.LINK_STOPWORDS))


def _bag(text: str, key: str, table: str) -> str:
    return f"SELECT DISTINCT {key} AS key, unnest(list_filter(regexp_extract_all({sql.normalize(text)}, {sql.lit(tokens.LINKED)}), lambda x: x NOT IN ({_STOP}))) AS term FROM {table}"


def _assets(spark, d):
    clips = src.clippings(spark, d).select(F.concat(F.lit("c"), "page_id").alias("key"), "name", F.element_at(F.array(*map(F.lit, T["contentTypes"])), (F.col("page_id") % 4 + 1).cast("int")).alias("ctype"), F.concat_ws(" ", F.coalesce("url", F.lit("")), F.left("text", F.lit(1800))).alias("text"))
    clips = clips.withColumn("text", F.concat_ws(" ", "name", "ctype", "text"))
    ideas = src.notes(spark, d).select(F.concat(F.lit("i"), "doc_id").alias("key"), F.when(F.col("doc_id") % 50 == 0, F.concat(F.lit("DRAFT_page_"), "doc_id")).otherwise(F.col("name")).alias("name"), F.lit("").alias("ctype"), F.left("text", F.lit(1200)).alias("text"))
    return clips, ideas.withColumn("text", F.concat_ws(" ", "name", "text"))


_TYPES = list(T["contentTypes"])
_PAIR_BASE = f"""WITH c AS (SELECT 'c' || page_id AS key, 'page_' || page_id AS name, ['{"', '".join(_TYPES)}'][page_id % 4 + 1] AS ctype, 'page_' || page_id || ' ' || ['{"', '".join(_TYPES)}'][page_id % 4 + 1] || ' ' || coalesce(url, '') || ' ' || left(html, 1800) AS text FROM pages),
i AS (SELECT 'i' || doc_id AS key, CASE WHEN doc_id % 50 = 0 THEN 'DRAFT_page_' || doc_id ELSE 'doc_' || doc_id END AS name, CASE WHEN doc_id % 50 = 0 THEN 'DRAFT_page_' || doc_id ELSE 'doc_' || doc_id END || ' ' || left(text, 1200) AS text FROM documents),
cb AS ({_bag('text', 'key', 'c')}), ib AS ({_bag('text', 'key', 'i')}), b AS (SELECT * FROM cb UNION ALL SELECT * FROM ib),
f AS (SELECT term, count(*) AS df FROM b WHERE length(term) >= 2 GROUP BY term), w AS (SELECT term, ln((1 + (SELECT count(DISTINCT key) FROM b)) / (1 + df)) + 1 AS idf FROM f), m AS (SELECT avg(idf) AS mean_idf FROM w),
sh AS (SELECT cb.key AS a, ib.key AS b, count(*) AS n_shared, round(sum(idf), 9) AS weight FROM cb JOIN ib USING (term) JOIN w USING (term) GROUP BY ALL)"""


@query(f"{_PAIR_BASE} SELECT a, b, n_shared, least(n_shared * 2, 25)::INT AS points FROM sh")
def sim_legacy(spark, d):
    return similarity.shared_pairs(*_assets(spark, d), "legacy")


@query(f"{_PAIR_BASE} SELECT a, b, round(weight, 6) AS weight, least(round_even(round(2 * weight / (SELECT mean_idf FROM m), 6), 0), 25)::INT AS points FROM sh")
def sim_tfidf(spark, d):
    return similarity.shared_pairs(*_assets(spark, d), "tfidf", 6)


@query(f"{_PAIR_BASE} SELECT term, df FROM f")
def sim_df(spark, d):
    c, i = _assets(spark, d)
    b = tokens.bag(c, "key").unionByName(tokens.bag(i, "key"))
    return b.where(F.length("term") >= 2).groupBy("term").agg(F.count("*").alias("df"))


def _theme_list(c: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {' OR '.join(f'contains({c}, {sql.lit(tx.plain(k))})' for k in ks)} THEN {sql.lit(n)} END" for n, ks in T["themes"].items()) + "], lambda x: x IS NOT NULL)"


_BR = "CASE ctype " + " ".join(f"WHEN {sql.lit(k)} THEN [{', '.join(map(sql.lit, v))}]" for k, v in T["bridges"].items()) + " END"
_BARE = lambda c: f"regexp_replace({c}, '^(DRAFT_|提炼_)', '')"
_SCORED = f"""{_PAIR_BASE}, cp AS (SELECT *, {_theme_list(sql.normalize('text'))} AS th, {sql.normalize('text')} AS hay FROM c), ip AS (SELECT *, {_theme_list(sql.normalize('text'))} AS th, {sql.normalize('text')} AS hay FROM i),
x AS (SELECT cp.key AS a, ip.key AS b, CASE WHEN {_BARE('cp.name')} = {_BARE('ip.name')} THEN 60 WHEN contains({_BARE('cp.name')}, {_BARE('ip.name')}) OR contains({_BARE('ip.name')}, {_BARE('cp.name')}) THEN 35 ELSE 0 END
 + least(8 * len(list_intersect(cp.th, ip.th)), 25) + CASE WHEN len(list_intersect({_BR}, ip.th)) > 0 THEN 18 + least(4 * len(list_intersect({_BR}, ip.th)), 12) ELSE 0 END
 + CASE WHEN contains(ip.hay, 'license') AND regexp_matches(cp.hay, 'the|der') THEN 16 ELSE 0 END + CASE WHEN regexp_matches(ip.hay, 'ein|une') AND regexp_matches(cp.hay, 'con|avec') THEN 12 ELSE 0 END AS base FROM cp, ip WHERE cp.name <> ip.name),
z AS (SELECT x.a, x.b, base + CASE WHEN weight IS NULL THEN 0 ELSE least(round_even(round(2 * weight / (SELECT mean_idf FROM m), 6), 0), 25)::INT END AS score FROM x LEFT JOIN sh ON x.a = sh.a AND x.b = sh.b)"""


@query(f"{_SCORED} SELECT a, b, score::INT AS score FROM z WHERE score >= 34")
def join_bridge(spark, d):
    return similarity.scored_pairs(*_assets(spark, d), T).select("a", "b", "score")


@query(f"{_SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rank FROM z WHERE score >= 34) SELECT a, b, score::INT AS score, rank FROM r WHERE rank <= 3")
def sim_topk(spark, d):
    return similarity.top_links(*_assets(spark, d), T, 3)


@query(f"{_SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY score DESC, a) AS rank FROM z WHERE score >= 34) SELECT b AS a, a AS b, score::INT AS score, rank FROM r WHERE rank <= 5")
def sim_topk_ideas(spark, d):
    """The other direction: five clippings for an idea."""
    return similarity.top_links(*_assets(spark, d), T, 5, from_ideas=True)


@query(f"{_PAIR_BASE} SELECT DISTINCT term FROM cb INTERSECT SELECT DISTINCT term FROM ib")
def set_intersect_terms(spark, d):
    c, i = _assets(spark, d)
    return tokens.bag(c, "key").select("term").intersect(tokens.bag(i, "key").select("term"))


@query()
def span_similar_quotes(spark, d):
    """Each benchmark text against the next one and against a part of itself."""
    n = spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", F.col("text").alias("a"))
    nth = F.row_number().over(W.partitionBy(F.col("item_id").cast("string").substr(1, 2)).orderBy("item_id", "a"))
    b = n.select("item_id", "a", F.when(nth % 2 == 0, F.substring("a", 20, 400)).otherwise(F.lead("a").over(W.partitionBy(F.col("item_id").cast("string").substr(1, 2)).orderBy("item_id", "a"))).alias("b"))
    return b.select("item_id", spans.similar_quotes(F.col("a"), F.col("b")).alias("similar"))
