"""A configurable taxonomy, compiled to column expressions.

A taxonomy is a dict: contentTypes {name: {keywords, asset, priority}}, typeShortcuts [{type, score, all,
any}], tagRules, themes and bridges {name: [..]}, themeTexts {theme: {asset, next}} (what a theme's notes are good for, and what to do
with them), domainRules [{idea_contains, idea_regex, clip_regex,
score}]. User files are merged into a base deeply. Matching is by literal substring of normalised text.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import any_of, let, normalize

OTHER = "其他"
#: A taxonomy for the sample texts: frequent words of their four languages.
SAMPLE = {
    "contentTypes": {
        "english": {"keywords": ["the", "and", "that", "with", "for", "was"], "asset": "reading list", "priority": 2.0},
        "german": {"keywords": ["der", "die", "und", "nicht", "von", "das"], "asset": "Leseliste", "priority": 2.4},
        "french": {"keywords": ["que", "les", "dans", "une", "pour", "avec"], "asset": "liste", "priority": 1.7},
        "spanish": {"keywords": ["el", "los", "por", "para", "con", "del"], "asset": "lista", "priority": 1.5},
    },
    "typeShortcuts": [{"type": "german", "score": 16, "all": ["der"], "any": ["nicht", "von"]}],
    "tagRules": {"en": ["the", "that", "was"], "de": ["der", "und"], "fr": ["que", "une", "avec"], "es": ["los", "por"], "license": ["license"]},
    "themes": {"english": ["the", "was"], "german": ["der", "nicht"], "french": ["dans", "avec"], "spanish": ["los", "del"], "legal": ["license"]},
    "bridges": {"english": ["german", "french", "legal"], "german": ["german"], "french": ["french", "spanish"], "spanish": ["spanish", "absent"]},
    "domainRules": [{"idea_contains": "license", "clip_regex": "the|der", "score": 16}, {"idea_regex": "ein|une", "clip_regex": "con|avec", "score": 12}],
}


def merged(base: dict, over: dict) -> dict:
    """Deep merge; a value {"_replace": x} replaces instead."""
    out = dict(base)
    for k, v in over.items():
        if isinstance(v, dict) and "_replace" in v:
            out[k] = v["_replace"]
        elif isinstance(v, dict) and isinstance(out.get(k), dict):
            out[k] = merged(out[k], v)
        else:
            out[k] = v
    return out


def problems(t: dict) -> list[str]:
    """What is wrong with a taxonomy: missing keywords, and names that rules use but nothing defines."""
    out = [f"contentTypes.{k}: no keywords" for k, v in t.get("contentTypes", {}).items() if not v.get("keywords")]
    out += [f"typeShortcuts: unknown type {r.get('type')}" for r in t.get("typeShortcuts", []) if r.get("type") not in t.get("contentTypes", {})]
    out += [f"bridges.{k}: unknown theme {x}" for k, v in t.get("bridges", {}).items() for x in v if x not in t.get("themes", {})]
    return out


def load(path: str | None = None, base: dict = SAMPLE) -> dict:
    if path is None:
        return base
    with open(path, encoding="utf-8") as f:
        return merged(base, json.load(f))


def plain(keyword: str) -> str:
    return keyword.lower().translate(str.maketrans("｜_-", "   "))


def hits(haystack: Column, keywords: list[str]) -> Column:
    """How many of the keywords are substrings of a normalised text."""
    total = F.lit(0)
    for k in keywords:
        total = total + haystack.contains(plain(k)).cast("int")
    return total


def haystack(name: Column, text: Column) -> Column:
    return normalize(F.concat_ws(" ", name, text))


def matching(hay: Column, rules: dict[str, list[str]]) -> Column:
    """Names of the rules with any keyword in the text, in rule order."""

    def test(h: Column) -> Column:
        return F.array_compact(F.array(*(F.when(any_of(h.contains(plain(k)) for k in kws), F.lit(name)) for name, kws in rules.items())))

    return let(hay, test)


def _ranked(hay: Column, rules: dict[str, list[str]], descending_name: bool) -> Column:
    """struct(hits, name) with hits, most hits first; ties by name."""
    rows = let(hay, lambda t: F.array(*(F.struct(hits(t, kws).alias("h"), F.lit(n).alias("n")) for n, kws in rules.items())))
    rows = F.filter(rows, lambda x: x["h"] > 0)
    if descending_name:
        return F.sort_array(rows, asc=False)
    return F.transform(F.sort_array(F.transform(rows, lambda x: F.struct((-x["h"]).alias("m"), x["n"].alias("n")))), lambda x: F.struct((-x["m"]).alias("h"), x["n"].alias("n")))


def categories(hay: Column, taxonomy: dict, min_hits: int = 2) -> Column:
    """All types with min_hits keywords or more; else the single best; else OTHER."""
    rules = {k: v["keywords"] for k, v in taxonomy["contentTypes"].items()}

    def pick(rows: Column) -> Column:
        strong = F.transform(F.filter(rows, lambda x: x["h"] >= min_hits), lambda x: x["n"])
        best = F.when(F.size(rows) > 0, F.array(F.get(rows, F.lit(0))["n"])).otherwise(F.array(F.lit(OTHER)))
        return F.when(F.size(strong) > 0, strong).otherwise(best)

    return let(_ranked(hay, rules, False), pick)


def content_type(hay: Column, name: Column, taxonomy: dict) -> Column:
    """struct(type, score): two points for each keyword, two more if it is in the name, and the type's
    priority, rounded half to even; shortcut rules come first."""
    return let(F.struct(hay.alias("h"), normalize(name).alias("n")), lambda x: _content_type(x["h"], x["n"], taxonomy))


def _content_type(hay: Column, plain_name: Column, taxonomy: dict) -> Column:
    rows = []
    for ctype, meta in taxonomy["contentTypes"].items():
        n = hits(hay, meta["keywords"])
        titled = F.lit(0)
        for k in meta["keywords"]:
            titled = titled + (hay.contains(plain(k)) & plain_name.contains(plain(k))).cast("int")
        rows.append(F.struct((2 * n + 2 * titled + F.lit(float(meta.get("priority", 1.0)))).alias("score"), n.alias("h"), F.lit(ctype).alias("type")))
    none = F.struct(F.lit("待判断").alias("type"), F.lit(0).alias("score"))
    best = F.get(F.sort_array(F.filter(F.array(*rows), lambda x: x["h"] > 0), asc=False), F.lit(0))
    out = let(best, lambda x: F.when(x.isNotNull(), F.struct(x["type"].alias("type"), F.bround(x["score"], 0).cast("int").alias("score"))).otherwise(none))
    for rule in reversed(taxonomy.get("typeShortcuts", [])):
        fits = F.lit(True)
        for k in rule.get("all", []):
            fits = fits & hay.contains(plain(k))
        if rule.get("any"):
            fits = fits & any_of(hay.contains(plain(k)) for k in rule["any"])
        out = F.when(fits, F.struct(F.lit(rule["type"]).alias("type"), F.lit(int(rule.get("score", 16))).alias("score"))).otherwise(out)
    return out


def auto_tags(hay: Column, taxonomy: dict, limit: int = 4) -> Column:
    return F.slice(F.transform(_ranked(hay, taxonomy["tagRules"], True), lambda x: x["n"]), 1, limit)


def themes(hay: Column, taxonomy: dict) -> Column:
    return matching(hay, taxonomy["themes"])


def keyword_table(spark, taxonomy: dict):
    """(type, keyword) rows: for taxonomies too large to compile, matched by a join."""
    return spark.createDataFrame([(t, plain(k)) for t, m in taxonomy["contentTypes"].items() for k in m["keywords"]], "type string, keyword string")
