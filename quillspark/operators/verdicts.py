"""Model verdicts as tables: cache keys, batches, and guarded back-fill. No service is called here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions.text import TRIM
from quillspark.shared import store


def cache_key(purpose: str, version: str, model: str, content: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(purpose), F.lit(version), F.lit(model), content))


def misses(items: DataFrame, cache: DataFrame) -> DataFrame:
    """Items (key, ..) that the cache (key, json) lacks, each key once."""
    return items.join(cache.select("key"), "key", "left_anti").dropDuplicates(["key"])


def batches(items: DataFrame, group: str, order: str, size: Column, most: int = 8, chars: int = 12_000, overhead: int = 64) -> DataFrame:
    """(group, batch, order) by greedy packing in order: a new batch begins where the next item would pass a limit.

    An item's batch, if it began one, would end within the next `most` items, which are gathered for it. So each item has a
    next start; the starts that are reached from a group's first item are found by pointer doubling, in as many rounds as
    the number of batches has binary digits. Every step is a join or an aggregation on (group, position), so that a group
    of any length is spread over all tasks; only its positions are numbered by one sorted pass. Orders are unique in a
    group; a null group is a group.
    """
    w = W.partitionBy(group)
    rows = items.select(group, order, (size + overhead).cast("long").alias("_s")).withColumns({"_i": F.row_number().over(w.orderBy(order)).cast("long")})
    rows = store(rows.withColumn("_g", F.xxhash64(F.col(group).cast("string"), F.col(group).isNull())), "items")
    ahead = rows.select(F.col("_g").alias("g"), F.col("_i").alias("i"), F.col("_s").alias("s"), F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("k"))
    lists = ahead.where(F.col("i") > F.col("k")).groupBy("g", (F.col("i") - F.col("k")).alias("i")).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "s"))), lambda x: x["s"]).alias("l"))
    fits = F.aggregate("l", F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("c"), F.lit(False).alias("full")), lambda a, x: F.struct((a["n"] + F.when(a["full"] | ((a["n"] > 0) & (a["c"] + x > chars)), 0).otherwise(1)).alias("n"), (a["c"] + x).alias("c"), (a["full"] | ((a["n"] > 0) & (a["c"] + x > chars))).alias("full")), lambda a: a["n"])
    jump = store(lists.select("g", "i", (F.col("i") + fits).alias("to"), F.lit(1).cast("long").alias("far")), "jumps")
    ends = jump.groupBy("g").agg(F.max("i").alias("last"))
    reached = store(ends.select("g", F.lit(1).cast("long").alias("i"), F.lit(0).cast("long").alias("batch")), "starts")
    while True:
        onward = reached.join(jump, ["g", "i"]).select("g", F.col("to").alias("i"), (F.col("batch") + F.col("far")).alias("batch"))
        fresh = store(onward.join(ends, "g").where("i <= last").drop("last"), "fresh")
        if fresh.isEmpty():
            break
        reached = store(reached.unionByName(fresh), "starts")
        far = jump.select("g", F.col("i").alias("to"), F.col("to").alias("to2"), F.col("far").alias("far2"))
        jump = store(jump.join(far, ["g", "to"]).select("g", "i", F.col("to2").alias("to"), (F.col("far") + F.col("far2")).alias("far")), "jumps")
    starts = reached.join(store(lists.select("g", "i", fits.alias("n")), "lengths"), ["g", "i"])
    each = starts.select("g", F.col("batch").cast("int").alias("batch"), F.explode(F.sequence(F.col("i"), F.col("i") + F.col("n") - 1)).alias("i"))
    each = each.select(F.col("g").alias("_g"), F.col("i").alias("_i"), F.col("batch").alias("_b"))
    return rows.join(each, ["_g", "_i"]).select(group, F.col("_b").alias("batch"), order)


def backfill(rows: DataFrame, verdicts: DataFrame, key: str, column: str, unclear: Column) -> DataFrame:
    """rows with column taken from the verdicts (key, value) where it is unclear; "null" is no verdict."""
    v = verdicts.select(key, F.nullif(F.col("value"), F.lit("null")).alias("_v"))
    return rows.join(v, key, "left").withColumn(column, F.when(unclear & F.col("_v").isNotNull(), F.col("_v")).otherwise(F.col(column))).drop("_v")


def overwritten(rows: DataFrame, verdicts: DataFrame, key: str, fields: list[str], number: str) -> DataFrame:
    """rows with fields taken from the verdicts (key, fields, number as text) wherever these say something:
    not null, "null" or blank. Each field gets a column {field}_source, ai_infer if it was taken. number is
    taken if it reads as a whole number; one below 0 counts as 0."""
    v = verdicts.select(key, *(F.col(c).cast("string").alias(f"_{c}") for c in [*fields, number]))
    out = rows.join(v, key, "left")
    for c in fields:
        says = F.col(f"_{c}").isNotNull() & ~F.col(f"_{c}").isin("null") & (F.btrim(F.col(f"_{c}"), F.lit(TRIM)) != "")
        out = out.withColumns({c: F.when(says, F.col(f"_{c}")).otherwise(F.col(c)), f"{c}_source": F.when(says, "ai_infer").otherwise(F.col(f"{c}_source"))})
    n = F.regexp_extract(F.btrim(F.col(f"_{number}"), F.lit(TRIM)), "^[+-]?[0-9]{1,9}$", 0)
    out = out.withColumn(number, F.when(n != "", F.greatest(n.try_cast("int"), F.lit(0))).otherwise(F.col(number)))
    return out.drop(*(f"_{c}" for c in [*fields, number]))


def allowed_labels(proposed: Column, allowed: list[str], fallback: Column) -> Column:
    """Proposed labels that are allowed; those of the keyword classifier if none is."""
    ok = F.array_intersect(proposed, F.array(*map(F.lit, allowed)))
    return F.when(F.size(ok) > 0, ok).otherwise(fallback)


def proposals(proposed: Column, limit: int = 2) -> Column:
    """The first new labels that a model proposes, without nulls and blank ones."""
    return F.slice(F.filter(proposed, lambda x: F.btrim(x, F.lit(TRIM)) != ""), 1, limit)


def json_block(reply: Column) -> Column:
    """The JSON of a reply: the whole, a fenced block, or what stands between its outer braces."""
    fenced = F.regexp_extract(reply, r"(?s)```(?:json)?[ \t]*\n?(.*?)```", 1)
    braces = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    valid = lambda c: F.when(F.get_json_object(c, "$").isNotNull(), c)
    return F.coalesce(*(valid(F.btrim(x, F.lit(TRIM))) for x in (reply, fenced, braces)))


def numbered_prompt(items: DataFrame, order: str, name: str, text: str, most: int = 50, chars: int = 300) -> DataFrame:
    """One prompt text: numbered blocks with previews of the first items in order."""
    first = items.orderBy(order).limit(most).select(F.col(order).alias("o"), name, text)
    block = lambda x: F.format_string("%s\n%s", x["n"], x["t"])
    rows = first.agg(F.sort_array(F.collect_list(F.struct("o", F.col(name).alias("n"), F.left(text, F.lit(chars)).alias("t")))).alias("l"))
    return rows.select(F.array_join(F.transform("l", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), block(x))), "\n\n").alias("prompt"))
