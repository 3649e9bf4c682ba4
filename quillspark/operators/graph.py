"""The wiki-link graph, layer audit and health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import scoring, spans

LAYER_ORDER = ("inbox", "distilled", "skills", "output", "other")


def links(notes: DataFrame) -> DataFrame:
    """(name, target, generated) of every link, repeats kept."""
    return notes.select("name", "generated", F.explode(spans.wiki_links(F.col("text"))).alias("target"))


def backlinks(edges: DataFrame, notes: DataFrame) -> DataFrame:
    """(name, backlinks, curated_backlinks): links that reach a note; curated ones come from notes that
    are not generated. Repeated links and links to oneself count."""
    reached = edges.join(notes.select(F.col("name").alias("target")).distinct(), "target", "left_semi")
    return reached.groupBy(F.col("target").alias("name")).agg(F.count("*").alias("backlinks"), F.count(F.when(~F.col("generated"), 1)).alias("curated_backlinks"))


def assets(notes: DataFrame, as_of: Column, package: str = "skills/") -> DataFrame:
    """Audit rows: (name, path, layer, bucket, age_days, link_count, backlinks, curated_backlinks, chars,
    headings, tasks, generated, draft, published, package_doc, total_links, curated_links, orphan). Documents
    that belong to a package (its references, templates and the like) need no links.

    notes: name, path, layer, bucket, mtime, text. The text is read once and left behind before joins.
    """
    text = F.col("text")
    flat = notes.select(
        "name", "path", "layer", "bucket",
        F.floor((F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(F.col("mtime").cast("timestamp"))) / 86400).cast("int").alias("age_days"),
        spans.wiki_links(text).alias("targets"), F.length(text).alias("chars"),
        F.regexp_count(text, F.lit(r"(?m)^#{1,6}[ \t]+")).alias("headings"), F.regexp_count(text, F.lit(r"- \[[ xX]\]")).alias("tasks"),
        scoring.is_generated(F.col("name")).alias("generated"), scoring.is_draft(F.col("path"), F.col("name"), text).alias("draft"), scoring.is_published(F.col("path"), text).alias("published"),
        scoring.is_package_doc(F.col("path"), package).alias("package_doc"),
    )
    edges = flat.select("generated", F.explode("targets").alias("target"))
    back = backlinks(edges, flat.select("name"))
    rows = flat.withColumn("link_count", F.size("targets")).drop("targets").join(back, "name", "left").na.fill(0, ["backlinks", "curated_backlinks"])
    curated = F.when(F.col("generated"), 0).otherwise(F.col("link_count")) + F.col("curated_backlinks")
    rows = rows.withColumns({"total_links": F.col("link_count") + F.col("backlinks"), "curated_links": curated})
    return rows.withColumn("orphan", ~F.col("generated") & ~F.col("package_doc") & (F.col("curated_links") == 0))


def layer_stats(rows: DataFrame, spark: SparkSession) -> DataFrame:
    """A row for each of the five layers, empty ones kept, with its health."""
    n_if = lambda c: F.count(F.when(c, 1))
    agg = rows.groupBy("layer").agg(
        F.count("*").alias("n"), F.sum("chars").alias("chars"), n_if(F.col("age_days") <= 7).alias("recent"), n_if(F.col("age_days") > 30).alias("cold"), n_if(F.col("generated")).alias("generated"),
        n_if(F.col("draft")).alias("drafts"), n_if(F.col("orphan")).alias("orphans"), F.sum("curated_links").alias("curated"), F.sum("total_links").alias("total"),
    )
    every = spark.createDataFrame([(k,) for k in LAYER_ORDER], "layer string").join(agg, "layer", "left").na.fill(0)
    share = lambda c: F.when(F.col("n") > 0, F.col(c) / F.col("n")).otherwise(0.0)
    every = every.withColumns({"avg_curated": share("curated"), "avg_total": share("total"), "orphan_rate": share("orphans")})
    return every.withColumn("health", scoring.health(F.col("layer"), F.col("n"), F.col("generated"), F.col("orphans"), F.col("avg_curated"), F.col("recent")))


def bucket_stats(rows: DataFrame) -> DataFrame:
    return rows.groupBy("bucket").agg(F.count("*").alias("n"), F.count(F.when(F.col("generated"), 1)).alias("generated"), F.avg("curated_links").alias("avg_curated"), F.avg("total_links").alias("avg_total"), F.count(F.when(F.col("age_days") <= 7, 1)).alias("recent"))


def vault_totals(rows: DataFrame) -> DataFrame:
    """One row: counts and ratios, with the share of drafts that got published as an extra."""
    n_if = lambda c: F.count(F.when(c, 1))
    t = rows.agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), n_if(F.col("generated")).alias("generated"), n_if(F.col("draft")).alias("drafts"), n_if(F.col("published")).alias("published"), n_if(F.col("orphan")).alias("orphans"), F.sum("curated_links").alias("curated"), F.sum("total_links").alias("total"))
    return t.withColumns({k: F.col(c) / F.nullif(F.col(d), F.lit(0)) for k, c, d in (("generated_rate", "generated", "n"), ("orphan_rate", "orphans", "n"), ("avg_curated", "curated", "n"), ("avg_total", "total", "n"), ("conversion", "published", "drafts"))})


def top_assets(rows: DataFrame, k: int, curated: bool) -> DataFrame:
    by = "curated_links" if curated else "total_links"
    return rows.orderBy(F.desc(by), F.desc("chars"), "path").limit(k)


def cold_assets(rows: DataFrame, first: int = 20, then: int = 10) -> DataFrame:
    """The coldest, of which generated ones go after the first limit, as in the report."""
    cold = rows.where("age_days > 30").orderBy(F.desc("age_days"), "path").limit(first)
    return cold.where("not generated").orderBy(F.desc("age_days"), "path").limit(then)


def orphans(rows: DataFrame, k: int = 12) -> DataFrame:
    return rows.where("orphan").orderBy("layer", "path").limit(k)


def recommendations(stats: DataFrame) -> DataFrame:
    """(code, n): which advice applies, with its count, from layer_stats()."""
    s = {k: F.max(F.when(F.col("layer") == k, F.col("n"))) for k in LAYER_ORDER}
    g = F.max(F.when(F.col("layer") == "distilled", F.col("generated") / F.nullif(F.col("n"), F.lit(0))))
    row = stats.agg(
        F.max(F.when(F.col("layer") == "inbox", F.col("orphans"))).alias("inbox_unlinked"), F.when(g > 0.6, s["distilled"]).otherwise(0).alias("distilled_generated"), F.max(F.when(F.col("layer") == "skills", F.col("drafts"))).alias("skill_drafts"),
        F.when(s["output"] == 0, 1).otherwise(0).alias("output_empty"), F.sum(F.when(~F.col("layer").isin("inbox", "output"), F.col("orphans")).otherwise(0)).alias("unlinked"), F.sum("cold").alias("cold"), s["other"].alias("outside"),
    )
    names = row.columns
    return row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("code"), F.col(c).cast("long").alias("n")) for c in names))).alias("x")).select("x.*").where("n > 0")


#: Lines of a report that are filled forward in one place.
FILL_LINES = 4096


def filled(rows: DataFrame, group: str, order: str, value: str, lines: int = FILL_LINES) -> DataFrame:
    """rows with value, where it is null, taken from the last row above it in its group.

    order is a whole number. A group is cut into blocks of that many numbers, so that one of any length uses all tasks; what a
    block begins with is carried over from the last value of the blocks above, one row each.
    """
    dealt = rows.withColumn("_block", F.floor(F.col(order) / lines))
    inside = W.partitionBy(group, "_block").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    above = W.partitionBy("_group").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    ends = dealt.groupBy(F.col(group).alias("_group"), "_block").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_end"))
    carry = ends.withColumn("_carry", F.last("_end", ignorenulls=True).over(above)).select("_group", F.col("_block").alias("_at"), "_carry")
    out = dealt.withColumn(value, F.last(value, ignorenulls=True).over(inside))
    met = F.col(group).eqNullSafe(F.col("_group")) & (F.col("_block") == F.col("_at"))
    return out.join(carry, met, "left").withColumn(value, F.coalesce(value, "_carry")).drop("_block", "_at", "_group", "_carry")


def approved(lines: DataFrame) -> DataFrame:
    """(source, target, reason) of checked lines (report, pos, line), under the heading above them."""
    head = F.nullif(F.btrim(F.regexp_extract(F.btrim("line"), r"^###[ \t]+\[\[(.+?)\]\]", 1)), F.lit(""))
    checked = r"^-[ \t]*\[[xX]\][ \t]*→[ \t]*\[\[(.+?)\]\][ \t]*·[ \t]*(.+)$"
    rows = filled(lines.withColumn("source", head), "report", "pos", "source")
    rows = rows.withColumns({"target": F.btrim(F.regexp_extract(F.btrim("line"), checked, 1)), "reason": F.btrim(F.regexp_extract(F.btrim("line"), checked, 2))})
    return rows.where("target <> '' and source is not null").select("report", "pos", "source", "target", "reason")


def applied_counts(notes: DataFrame, approved_links: DataFrame) -> DataFrame:
    """One row, without any change: applied_links, changed_files, missing_sources, as a dry run tells them."""
    rows, missing = apply_approved(notes, approved_links)
    found = approved_links.join(notes.select(F.col("name").alias("source")).distinct(), "source", "left_semi")
    applied = found.agg(F.count("*").alias("applied_links")).withColumn("one", F.lit(1))
    changed = rows.agg(F.count(F.when(F.col("changed"), 1)).alias("changed_files")).withColumn("one", F.lit(1))
    lost = missing.agg(F.count("*").alias("missing_sources")).withColumn("one", F.lit(1))
    return applied.join(changed, "one").join(lost, "one").drop("one")  # one row each


def apply_approved(notes: DataFrame, approved_links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(notes with updated text and flag changed, sources that are no note)."""
    per = approved_links.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("report", "pos", "target", "reason"))).alias("l"))
    per = per.select(F.col("source").alias("name"), F.transform("l", lambda x: F.struct(x["target"].alias("target"), x["reason"].alias("reason"))).alias("l"))
    new = spans.apply_links(F.col("text"), F.col("l"))
    rows = notes.join(per, "name").withColumn("updated", new).withColumn("changed", F.col("updated") != F.col("text")).drop("l")
    return rows, per.select("name").join(notes.select("name"), "name", "left_anti")
