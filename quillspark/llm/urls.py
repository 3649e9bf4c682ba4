"""URL filtering with host and path rules, and block decisions passed along redirect equivalence.

A page's aliases are its own address without scheme, fragment and tracking parameters, the target of
its canonical link, and the target of its refresh redirect. Pages that share an alias, directly or
through others, are one component. A page with a rule keeps it. Other pages are blocked if a page of
their component is blocked by a rule, unless a page of it is allowed by a rule: explicit allow wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, store
from .components import connected_components

#: (verdict, host, path): rules of the query.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
TRACKING = r"^(?:utm_[a-z]+|ref|fbclid|gclid)="


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest fitting rule, or null. One expression: rules are a parameter, not data."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def alias_of(url: Column) -> Column:
    """Host, path and what is left of the query; null if the url has no ://."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(TRACKING)), "&")
    path = F.regexp_replace(path_of(url), "/$", "")
    return F.when(F.instr(url, "://") > 0, F.concat(host_of(url), path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def _resolved(target: Column, base: Column) -> Column:
    """A link target made absolute against its page's url."""
    t = F.regexp_replace(F.btrim(target), "&amp;", "&")
    origin = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    return F.when(F.instr(t, "://") > 0, t).when(t.startswith("//"), F.concat(F.lit("http:"), t)).when(t.startswith("/") & (origin != ""), F.concat(origin, t))


def link_targets(url: Column, html: Column) -> Column:
    """Targets of canonical links and refresh redirects in a page."""
    attr = r"""\s*=\s*["']?"""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))
    canonical = F.filter(tags, lambda t: t.rlike(rf"(?is)^<link\b[^>]*\brel{attr}canonical\b"))
    refresh = F.filter(tags, lambda t: t.rlike(rf"(?is)^<meta\b[^>]*\bhttp-equiv{attr}refresh\b"))
    found = F.concat(
        F.transform(canonical, lambda t: F.regexp_extract(t, r"""(?is)\bhref\s*=\s*["']?([^"'>\s]*)""", 1)),
        F.transform(refresh, lambda t: F.regexp_extract(t, r"""(?is)\burl\s*=\s*["']?([^"'>\s]*)""", 1)),
    )
    has = F.coalesce(html, F.lit("")).rlike("(?i)canonical|refresh")
    return F.when(has, F.filter(F.transform(found, lambda t: _resolved(t, url)), lambda t: t.isNotNull())).otherwise(F.array().cast("array<string>"))


def aliases(pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, alias) rows; redirects has columns source and target (urls)."""
    links = F.concat(F.array("url"), link_targets(F.col("url"), F.col("html")))
    rows = pages.where("page_id is not null").select("page_id", F.explode(links).alias("x"))
    own = rows.select("page_id", alias_of(F.col("x")).alias("alias")).where("alias is not null").distinct()
    if redirects is None:
        return own
    ends = redirects.select(alias_of(F.col("source")).alias("alias"), alias_of(F.col("target")).alias("to")).where("alias is not null and `to` is not null").distinct()
    return own.unionByName(own.join(ends, "alias").select("page_id", F.col("to").alias("alias"))).distinct()


def judge(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """A row for each page: page_id, host, path, rule, verdict, component.

    Null urls and urls without :// have empty host and path, no rule and no alias of their own; without
    other links they are allowed. Null html has no links. Rows with a null page_id are judged by rules
    alone. Repeated page_ids are one node, so their aliases are joined. Other columns are ignored. An
    empty table gives no rows.
    """
    base = pages.select("page_id", "url", "html")
    own = base.select("page_id", "url").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    own = own.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("by_rule"))
    keys = store(aliases(base, redirects), "aliases")
    hubs = store(keys.groupBy("alias").agg(F.min("page_id").alias("hub"), F.count("*").alias("n")).where("n > 1"), "hubs")
    parts = connected_components(keys.join(hubs, "alias").select(F.col("page_id").alias("u"), F.col("hub").alias("v")))
    parts = store(parts.select(F.col("node").alias("page_id"), "component"), "parts")
    votes = own.where("by_rule is not null").join(parts, "page_id").groupBy("component").agg(F.max(F.col("by_rule") == "allow").alias("allowed"), F.max(F.col("by_rule") == "block").alias("blocked"))
    votes = store(votes, "votes")
    out = own.join(parts, "page_id", "left").join(votes, "component", "left")
    passed = F.when(F.coalesce("blocked", F.lit(False)) & ~F.coalesce("allowed", F.lit(False)), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", passed).alias("verdict"), F.coalesce("component", "page_id").alias("component"))
