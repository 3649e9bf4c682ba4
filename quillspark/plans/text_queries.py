"""Queries over text normalisation, tokens and spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import spans, text, tokens
from quillspark.sources import notes as src

from . import sql
from .registry import query


def stop(c: str, words) -> str:
    return f"(regexp_matches({c}, '^[0-9]*$') OR length({c}) < 2 OR {c} IN ({', '.join(map(sql.lit, words))}))"


_PLACED = f"WITH {sql.NOTES}, p AS (SELECT doc_id, mtime, CASE doc_id % 7 WHEN 0 THEN '.git/' || path WHEN 1 THEN 'a/node_modules/' || path WHEN 2 THEN path || '.tmp' WHEN 3 THEN 'a/~$' || name WHEN 4 THEN 'a/.gitx/' || path ELSE path END AS path FROM notes)"


@query(f"{_PLACED} SELECT doc_id, path, len(list_intersect(string_split(path, '/'), ['.git', '.obsidian', '.trash', 'node_modules', '.vscode', '__pycache__'])) > 0 OR regexp_matches(path, '([.]baiduyun[.]uploading[.]cfg|[.]tmp|[.]temp|[.]swp)$') OR regexp_matches(path, '(^|/)~[$][^/]*$') AS skipped FROM p")
def src_path_filter(spark, d):
    n, path = src.notes(spark, d), F.col("path")
    put = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit(".git/"), path)).when(F.col("doc_id") % 7 == 1, F.concat(F.lit("a/node_modules/"), path)).when(F.col("doc_id") % 7 == 2, F.concat(path, F.lit(".tmp")))
    put = put.when(F.col("doc_id") % 7 == 3, F.concat(F.lit("a/~$"), "name")).when(F.col("doc_id") % 7 == 4, F.concat(F.lit("a/.gitx/"), path)).otherwise(path)
    n = n.select("doc_id", put.alias("path"))
    return n.select("doc_id", "path", src.ignored(F.col("path")).alias("skipped"))


ROOTS = {"inbox": "v/00 In", "distilled": "v/10 Out/d", "skills": "v/20", "output": "v/30"}
SUBFOLDERS = {"v/00 In/clips": "Clippings", "v/00 In/ideas": "Ideas", "v/20/drafts": "Drafts"}
_VAULT = f"WITH {sql.NOTES}, p AS (SELECT doc_id, ['v/00 In/clips/', 'v/00 In/', 'v/00 Inner/', 'v/10 Out/d/', 'v/20/drafts/x/', 'v/20/', 'v/30/', 'v/old/', 'w/'][doc_id % 9 + 1] || name || '.md' AS path FROM notes)"
_UNDER = lambda root: f"(path = '{root}' OR starts_with(path, '{root}/'))"
_LAYER_OF = "CASE " + " ".join(f"WHEN {_UNDER(r)} THEN '{k}'" for k, r in ROOTS.items()) + " ELSE 'other' END"
_BUCKET_OF = "CASE " + " ".join(f"WHEN {_UNDER(r)} THEN '{k}'" for r, k in SUBFOLDERS.items()) + " WHEN layer = 'other' THEN 'unmapped/' || split_part(rel, '/', 1) ELSE layer END"


@query(f"{_VAULT}, q AS (SELECT doc_id, path, CASE WHEN starts_with(path, 'v/') THEN path[3:] ELSE path END AS rel, {_LAYER_OF} AS layer FROM p) SELECT doc_id, rel, layer, {_BUCKET_OF} AS bucket FROM q")
def src_roots(spark, d):
    """Layer and bucket by the longest known folder a path lies under, and the path inside the vault."""
    folders = ("v/00 In/clips/", "v/00 In/", "v/00 Inner/", "v/10 Out/d/", "v/20/drafts/x/", "v/20/", "v/30/", "v/old/", "w/")
    put = F.concat(F.get(F.array(*map(F.lit, folders)), (F.col("doc_id") % 9).cast("int")), "name", F.lit(".md"))
    n = src.notes(spark, d).select("doc_id", put.alias("path"))
    n = n.withColumns({"rel": src.relative(F.col("path"), "v"), "layer": src.layer_of(F.col("path"), ROOTS)})
    return n.select("doc_id", "rel", "layer", src.bucket_of(F.col("path"), F.col("layer"), "v", SUBFOLDERS).alias("bucket"))


@query(f"WITH {sql.NOTES} SELECT layer, bucket, count(*) AS n, min(mtime) AS first_edit, max(mtime) AS last_edit FROM notes GROUP BY ALL")
def src_layer_bucket(spark, d):
    return src.notes(spark, d).groupBy("layer", "bucket").agg(F.count("*").alias("n"), F.min("mtime").alias("first_edit"), F.max("mtime").alias("last_edit"))


@query(f"WITH {sql.NOTES} SELECT path, mtime, strlen(text) AS bytes FROM notes WHERE layer = 'output'")
def src_published(spark, d):
    return src.notes(spark, d).where("layer = 'output'").select("path", "mtime", F.octet_length("text").cast("long").alias("bytes")).orderBy(F.desc("mtime"), "path")


@query(f"WITH {sql.NOTES} SELECT count(*) AS n, sum(strlen(text))::BIGINT AS bytes, strftime(min(mtime), '%Y-%m-%d') AS first_day, strftime(max(mtime), '%Y-%m-%d') AS last_day FROM notes WHERE layer = 'output'")
def agg_published_total(spark, d):
    """Published notes in one row: number, bytes, first and last day."""
    p = src.notes(spark, d).where("layer = 'output'")
    day = lambda c, name: F.date_format(c, "yyyy-MM-dd").alias(name)
    return p.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"), day(F.min("mtime"), "first_day"), day(F.max("mtime"), "last_day"))


@query(f"WITH {sql.NOTES} SELECT doc_id, left(text, 12000) AS head FROM notes")
def src_truncated(spark, d):
    return src.notes(spark, d).select("doc_id", F.left("text", F.lit(12000)).alias("head"))


@query(f"WITH {sql.MARKDOWN} SELECT doc_id, {sql.normalize('name')} AS name, md5({sql.normalize('text')}) AS normal FROM notes")
def txt_normalize(spark, d):
    return src.markdown_notes(spark, d).select("doc_id", text.normalize(F.col("name")).alias("name"), F.md5(text.normalize(F.col("text"))).alias("normal"))


@query(f"WITH {sql.MARKDOWN} SELECT doc_id, {sql.frontless('text')} AS body FROM notes")
def txt_frontmatter(spark, d):
    return src.markdown_notes(spark, d).select("doc_id", text.strip_frontmatter(F.col("text")).alias("body"))


@query(f"WITH {sql.MARKDOWN} SELECT doc_id, {sql.clean_text('text')} AS clean FROM notes")
def txt_clean_daily(spark, d):
    return src.markdown_notes(spark, d).select("doc_id", text.clean_text(F.col("text")).alias("clean"))


@query(f"SELECT page_id, {sql.clean_text('html')} AS clean FROM pages")
def txt_clean_pages(spark, d):
    return src.clippings(spark, d).select("page_id", text.clean_text(F.col("text")).alias("clean"))


@query(f"WITH {sql.MARKDOWN} SELECT doc_id, {sql.clean_content('text')} AS clean FROM notes")
def txt_clean_clipping(spark, d):
    return src.markdown_notes(spark, d).select("doc_id", text.clean_content(F.col("text")).alias("clean"))


@query(f"WITH {sql.NOTES} SELECT doc_id, len(list_filter({sql.lines('text')}, lambda x: {sql.noise('x')})) AS noise FROM notes")
def txt_noise_lines(spark, d):
    return src.notes(spark, d).select("doc_id", F.size(F.filter(text.lines(F.col("text")), text.is_noise_line)).cast("long").alias("noise"))


@query(f"WITH {sql.MARKED_NOTES} SELECT doc_id, len({sql.sentences('text')}) AS n, array_to_string({sql.sentences('text')}, '|') AS said FROM notes")
def txt_sentences(spark, d):
    s = src.marked_notes(spark, d).select("doc_id", text.split_sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n"), F.array_join("s", "|").alias("said"))


@query(f"WITH {sql.MARKED_NOTES} SELECT doc_id, md5(array_to_string({sql.sentences('text')}, '|')) AS said, round(list_sum(list_transform({sql.sentences('text')}, lambda x, i: (i - 1) / greatest(len({sql.sentences('text')}) - 1, 1))), 6) AS places FROM notes WHERE len({sql.sentences('text')}) > 0")
def win_position(spark, d):
    found = F.array(text.positioned(text.split_sentences(F.col("text"))))
    s = src.marked_notes(spark, d).select("doc_id", F.explode(F.filter(found, lambda x: F.size(x) > 0)).alias("s"))  # a filter would split texts once more
    return s.select("doc_id", F.md5(F.array_join(F.transform("s", lambda x: x["text"]), "|")).alias("said"), F.round(F.aggregate("s", F.lit(0.0), lambda a, x: a + x["position"]), 6).alias("places"))


@query(f"WITH {sql.NOTES}, c AS (SELECT doc_id, {sql.clean_text('text')} AS clean FROM notes) SELECT doc_id, CASE WHEN length(clean) > 220 THEN left(clean, 220) || '...' ELSE clean END AS preview FROM c")
def txt_preview(spark, d):
    return src.notes(spark, d).select("doc_id", text.preview(text.clean_text(F.col("text"))).alias("preview"))


@query(
    f"WITH {sql.MARKDOWN} SELECT doc_id, length(text) AS chars, strlen(text) AS bytes, len(regexp_extract_all(text, '(?m)^#{{1,6}}[ \\t]+')) AS headings, len(regexp_extract_all(text, '- \\[[ xX]\\]')) AS tasks, "
    f"len(list_filter({sql.lines(sql.frontless('text'))}, lambda x: trim(x, {sql.TRIM}) <> '' AND NOT starts_with(trim(x, {sql.TRIM}), '#'))) AS body_lines FROM notes"
)
def txt_counts(spark, d):
    t = F.col("text")
    return src.markdown_notes(spark, d).select(
        "doc_id", F.length(t).cast("long").alias("chars"), F.octet_length(t).cast("long").alias("bytes"), F.regexp_count(t, F.lit(r"(?m)^#{1,6}[ \t]+")).cast("long").alias("headings"),
        F.regexp_count(t, F.lit(r"- \[[ xX]\]")).cast("long").alias("tasks"), text.count_lines(t).cast("long").alias("body_lines"),
    )


_FRONTED = "SELECT page_id, regexp_replace(CASE WHEN page_id % 3 = 0 THEN 'x' || chr(10) || '---' || chr(10) || 'title: a title that is long enough' || chr(10) || chr(10) || '---' || html ELSE html END, '---.*?---', ' ', 's') AS html FROM pages"
_PARA = f"list_filter(list_transform(regexp_split_to_array(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\n[ \\t\\x0b\\f\\r]*\\n'), lambda p: {sql.compact('p')}), lambda p: length(p) > 30)"


@query(f"SELECT page_id, left(coalesce({_PARA}[1], {sql.compact(chr(114) + 'egexp_replace(html, ' + sql.lit('<[^>]+>') + ', ' + sql.lit(' ') + ', ' + sql.lit('g') + ')')}), 600) AS para FROM ({_FRONTED})")
def txt_first_paragraph(spark, d):
    """Pages, a third of them with a block between --- lines, which is left out."""
    block = F.concat(F.lit("x\n---\ntitle: a title that is long enough\n\n---"), "text")
    return src.clippings(spark, d).withColumn("text", F.when(F.col("page_id") % 3 == 0, block).otherwise(F.col("text"))).select("page_id", text.first_paragraph(F.col("text")).alias("para"))


@query(f"WITH {sql.MARKDOWN} SELECT doc_id, md5({sql.clean_content('text')}) AS content_hash, left(md5(left(text, 12000)), 12) AS short FROM notes")
def txt_md5(spark, d):
    return src.markdown_notes(spark, d).select("doc_id", text.content_hash(F.col("text")).alias("content_hash"), F.left(F.md5(F.left("text", F.lit(12000))), F.lit(12)).alias("short"))


@query(f"WITH {sql.NOTES} SELECT doc_id, CASE WHEN length(text) > 8000 THEN left(text, 7800) || chr(10) || '...' || chr(10) || right(text, 180) ELSE text END AS prepared FROM notes")
def txt_prompt_content(spark, d):
    return src.notes(spark, d).select("doc_id", text.prompt_content(F.col("text")).alias("prepared"))


@query(f"WITH {sql.MARKED_NOTES} SELECT doc_id, regexp_matches(text, '[一-龥]') AS chinese, len(regexp_extract_all(text, '[A-Za-z][A-Za-z''’\\-]+')) >= 3 AS english, regexp_replace('DRAFT_' || name, '^(DRAFT_|提炼_)', '') AS bare FROM notes")
def txt_scripts(spark, d):
    n = src.marked_notes(spark, d)
    return n.select("doc_id", text.has_chinese(F.col("text")).alias("chinese"), text.has_english_sentence(F.col("text")).alias("english"), text.bare_name(F.concat(F.lit("DRAFT_"), "name")).alias("bare"))


_MIXED = sql.lit(tokens.MIXED)
_STRIP = sql.lit(tokens.STRIP)


def _keywords(body: str, noise, k: int) -> str:
    t = f"unnest(list_transform(regexp_extract_all({sql.normalize(chr(110) + 'ame || ' + sql.lit(' ') + ' || ' + body)}, {_MIXED}), lambda x: trim(x, {_STRIP})))"
    return f"WITH {sql.MARKED_NOTES}, t AS (SELECT {t} AS token FROM notes) SELECT token, count(*) AS n FROM t WHERE NOT {stop('token', tokens.STOPWORDS)} AND token NOT IN ({', '.join(map(sql.lit, noise))}) GROUP BY token ORDER BY n DESC, token LIMIT {k}"


@query(_keywords(f"({sql.clean_text('text')})", tokens.CAPTURE_NOISE, 12))
def kw_daily(spark, d):
    n = src.marked_notes(spark, d)
    return tokens.daily_keywords(n.select("name", text.clean_text(F.col("text")).alias("clean")))


@query(_keywords("text", [*tokens.CAPTURE_NOISE, "asr"], 20))
def kw_weekly(spark, d):
    return tokens.weekly_keywords(src.marked_notes(spark, d))


@query(f"WITH t AS (SELECT unnest(regexp_extract_all(lower(text), {sql.lit(tokens.PUBLISHED)})) AS token FROM conversations) SELECT token, count(*) AS n FROM t WHERE NOT {stop('token', tokens.STOPWORDS)} GROUP BY token ORDER BY n DESC, token LIMIT 20")
def kw_feedback(spark, d):
    return tokens.published_words(spark.read.parquet(f"{d}/conversations.parquet"))


_NO = f"NOT IN ({', '.join(map(sql.lit, tokens.LINK_STOPWORDS))})"
_PIECES = f"CASE WHEN length(x) > 18 AND regexp_matches(x, '^[一-龥]+$') THEN list_filter(list_transform(range(1, least(length(x), 24), 2), lambda i: substr(x, i, 2)), lambda y: y {_NO}) ELSE [x] END"
_LINK = f"flatten(list_transform(list_filter(regexp_extract_all({sql.normalize('text')}, {sql.lit(tokens.LINKED)}), lambda x: x {_NO}), lambda x: {_PIECES}))"
_RUNS = "CASE doc_id % 3 WHEN 0 THEN ' 一个知识系统需要清楚的步骤和可以复用的流程以及真实的案例才能长久' WHEN 1 THEN ' 十八个字的一段话不会被切开来的对吗是' ELSE '' END"
_RUN_NOTES = sql.MARKED_NOTES.replace(" AS text FROM documents)", f" || {_RUNS} AS text FROM documents)")


def run_notes(spark, d):
    """Marked notes, some of which end in Chinese runs longer than is kept whole, some in shorter ones."""
    i = F.col("doc_id") % 3
    run = F.when(i == 0, " 一个知识系统需要清楚的步骤和可以复用的流程以及真实的案例才能长久").when(i == 1, " 十八个字的一段话不会被切开来的对吗是").otherwise("")
    return src.marked_notes(spark, d).withColumn("text", F.concat("text", run))


@query(f"WITH {_RUN_NOTES}, t AS (SELECT doc_id, unnest({_LINK}) AS term FROM notes) SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL")
def kw_link_tokens(spark, d):
    return tokens.bag(run_notes(spark, d), "doc_id")


@query(
    f"WITH {_RUN_NOTES}, t AS (SELECT doc_id, unnest({_LINK}) AS term FROM notes), c AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, term) AS rank FROM c) SELECT doc_id, term, tf, rank FROM r WHERE rank <= 18"
)
def kw_top_terms(spark, d):
    return tokens.top_terms(run_notes(spark, d), "doc_id", 18)


_BULLETS = f"list_filter(list_transform(regexp_extract_all({sql.frontless('text')}, '(?m)^[ \\t]*(?:[-*•]|[0-9]+[.)、])[ \\t]+([^\\n]+)$', 1), lambda x: {sql.compact('x')}), lambda x: length(x) >= 6)"


@query(f"WITH {sql.MARKDOWN} SELECT doc_id, coalesce({sql.first_distinct(_BULLETS, 5)}, '') AS bullets FROM notes")
def kw_bullets(spark, d):
    return src.markdown_notes(spark, d).select("doc_id", F.array_join(spans.bullets(F.col("text")), "|").alias("bullets"))


_LISTED = (
    f"list_filter(list_transform(list_filter(list_transform({sql.lines('clean')}, lambda x: trim(x)), lambda x: regexp_matches(x, {sql.lit(spans.POINT_LINE)}) AND NOT {sql.comment('x')}), "
    f"lambda x: {sql.compact('regexp_replace(regexp_replace(x, ' + sql.lit(spans.BULLET + chr(91) + ' ' + chr(92) + 't]*') + ', ' + sql.lit('') + '), ' + sql.lit(r'(?i)^\*+[ \t]*Description[ \t]*\*+[ \t]*') + ', ' + sql.lit('') + ')')}), "
    f"lambda x: NOT {sql.comment('x')} AND length(x) BETWEEN 12 AND 160 AND NOT {sql.noise('x')})"
)
_SAID = f"list_filter(list_transform(list_filter({sql.sentences('clean')}, lambda x: NOT {sql.comment('x')} AND regexp_matches(x, {sql.lit(spans.POINT)})), lambda x: left(x, 160)), lambda x: NOT {sql.noise('x')})"


@query(f"WITH {sql.MARKDOWN}, c AS (SELECT doc_id, {sql.clean_content('text')} AS clean FROM notes), p AS (SELECT doc_id, list_concat({_LISTED}, {_SAID}) AS p FROM c) SELECT doc_id, coalesce({sql.first_distinct('p', 5)}, '') AS points FROM p")
def span_points(spark, d):
    n = src.markdown_notes(spark, d).select("doc_id", text.clean_content(F.col("text")).alias("clean"))
    return n.select("doc_id", F.array_join(spans.key_points(F.col("clean")), "|").alias("points"))


_QUESTIONS = f"list_filter(list_transform(regexp_extract_all(clean, 'Q[0-9]+[：:][^\\n]|[^。！？!?\\n]{{8,80}}[？?]'), lambda q: {sql.compact('q')}), lambda q: NOT {sql.noise('q')} AND NOT ({' OR '.join(f'starts_with(q, {sql.lit(x)})' for x in spans.STARTS)}) AND regexp_matches(q, '[？?]') AND NOT regexp_matches(q, '^[0-9]+[.)、][ \\t]*[^：:]{{1,20}}[：:][^\\n]+[？?]'))"


@query(f"WITH {sql.MARKDOWN}, c AS (SELECT doc_id, {sql.clean_content('text')} AS clean FROM notes), q AS (SELECT doc_id, {_QUESTIONS} AS q FROM c) SELECT doc_id, coalesce({sql.first_distinct('q', 5)}, '') AS questions FROM q")
def span_questions(spark, d):
    n = src.markdown_notes(spark, d).select("doc_id", text.clean_content(F.col("text")).alias("clean"))
    return n.select("doc_id", F.array_join(spans.questions(F.col("clean")), "|").alias("questions"))


@query()
def span_methods(spark, d):
    n = src.markdown_notes(spark, d).select("doc_id", text.clean_content(F.col("text")).alias("clean"))
    return n.select("doc_id", F.array_join(spans.methods(F.col("clean")), "|").alias("methods"))


@query()
def span_quotes(spark, d):
    return src.markdown_notes(spark, d).select("doc_id", F.explode(spans.quotes(F.col("text"))).alias("q")).select("doc_id", "q.*")


@query()
def span_steps(spark, d):
    n = src.markdown_notes(spark, d)
    return n.select("doc_id", F.array_join(spans.steps(F.col("text")), "|").alias("steps"), F.size(spans.prompts(F.col("text"))).alias("n_prompts"))


@query()
def span_summary(spark, d):
    n = src.markdown_notes(spark, d).select("doc_id", "name", "text", text.clean_content(F.col("text")).alias("clean"))
    s = spans.summary(F.col("text"), F.col("clean"))
    return n.select("doc_id", s["core"].alias("core"), spans.core_thesis(F.col("text"), F.col("clean")).alias("thesis"), text.one_liner(F.col("text"), F.col("name")).alias("purpose"), spans.author(F.col("text")).alias("author"))


_QUOTE = (
    "CASE WHEN t = '' OR {noise} OR {comment} OR {starts} OR ends_with(t, '：') OR ends_with(t, ':') OR ends_with(t, '?') OR ends_with(t, '？') OR regexp_matches(t, '^Q[0-9]+[：:]') "
    "OR regexp_matches(t, '(?i)^(description|tags|title|source|url|link)[ \\t]*[：:]') OR length(t) NOT BETWEEN 12 AND 220 OR (NOT cn AND len(regexp_extract_all(t, '[A-Za-z][A-Za-z''’\\-]+')) < 3) THEN -99 ELSE "
    "CASE WHEN cn THEN 3 * regexp_matches(t, {insight})::INT + 2 * regexp_matches(t, {contrarian})::INT + regexp_matches(t, {transition})::INT ELSE 3 * regexp_matches(t, {english})::INT END "
    "+ 2 * regexp_matches(t, {numbers})::INT + CASE WHEN length(t) BETWEEN 25 AND 80 THEN 2 WHEN length(t) BETWEEN 18 AND 24 OR length(t) BETWEEN 81 AND 120 THEN 1 ELSE 0 END "
    "+ regexp_matches(t, '[。！？.!][ ]*$')::INT - 3 * regexp_matches(t, {residue})::INT END"
).format(
    noise=sql.noise("t"), comment=sql.comment("t"), starts="(" + " OR ".join(f"starts_with(t, {sql.lit(x)})" for x in spans.STARTS) + ")", insight=sql.lit(spans.INSIGHT), contrarian=sql.lit(spans.CONTRARIAN),
    transition=sql.lit(spans.TRANSITION), english=sql.lit(spans.ENGLISH), numbers=sql.lit(spans.NUMBERS), residue=sql.lit(spans.RESIDUE),
)


@query(f"WITH {sql.MARKED_NOTES}, s AS (SELECT doc_id, unnest({sql.sentences('text')}) AS said FROM notes), u AS (SELECT doc_id, {sql.compact('said')} AS t FROM s), v AS (SELECT *, regexp_matches(t, '[一-龥]') AS cn FROM u) SELECT doc_id, t AS said, {_QUOTE} AS score FROM v")
def span_quote_scores(spark, d):
    s = src.marked_notes(spark, d).select("doc_id", F.explode(text.split_sentences(F.col("text"))).alias("said"))
    return s.select("doc_id", text.compact(F.col("said")).alias("said"), spans.quote_score(F.col("said"), F.lit("body"), F.lit(0.5)).alias("score"))
