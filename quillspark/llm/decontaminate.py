"""Benchmark decontamination with a distributed positional inverted index.

The index stores (term, dkey, pos) of every training token whose term occurs in the benchmark, as a
table. Each test window asks for its rarest term's list first, adjusted by the term's offset; the list
of the second-rarest term is intersected with it, and what survives is confirmed term by term against
the index. dkey is a 64-bit hash of document id and text, term a 64-bit hash of the word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, bounded, store

#: Runs of characters that are in no word, after A-Z are lower-cased.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Vocabularies of at most this many terms (8 bytes each) are broadcast; larger ones are joined by shuffle.
BROADCAST_TERMS = 1_000_000
#: Likewise of the windows with their two rarest terms (40 bytes each): so the lists of frequent terms stay where they are.
BROADCAST_WINDOWS = 200_000


def _parts(text: Column) -> Column:
    return F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAKS)


def _tokens(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, term, pos, p, n_words) of rows (keys, text); pos counts words from 0. Every row has one row
    with p = 0, whose term stands for no word (pos below 0, or an empty word) if its text does not start with one."""
    parts = rows.select(*keys, _parts(F.col("text")).alias("w"))
    lead, tail = F.col("w")[0] == "", F.get("w", F.size("w") - 1) == ""
    words = F.size("w") - lead.cast("int") - (tail & ~(lead & (F.size("w") == 1))).cast("int")
    flat = parts.select(*keys, lead.cast("int").alias("lead"), words.cast("long").alias("n_words"), F.posexplode("w").alias("p", "word"))
    return flat.where("word <> '' or p = 0").select(*keys, F.when(F.col("word") != "", F.xxhash64("word")).alias("term"), (F.col("p") - F.col("lead")).alias("pos"), "p", "n_words")


def _dkey() -> Column:
    return F.xxhash64("doc_id", "text")


def read_terms(docs: DataFrame, vocabulary: DataFrame, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """The stored postings (term, dkey, pos) of the vocabulary's terms in all documents, and a row (doc_id,
    dkey, n_words) for each document; one pass over the texts gives both."""
    base = docs.select("doc_id", _dkey().alias("dkey"), "text")
    known = bounded(vocabulary.select("term", F.lit(True).alias("known")), BROADCAST_TERMS)
    met = _tokens(base, "doc_id", "dkey").join(known, "term", "left").where("known or p = 0")
    once = lambda c: F.when(F.col("p") == 0, F.col(c)).alias(c)
    rows = (scratch or Scratch(docs.sparkSession)).store(met.select("known", "term", "dkey", "pos", "p", once("doc_id"), once("n_words")), "postings")
    return rows.where("known").select("term", "dkey", "pos"), rows.where("p = 0").select("doc_id", "dkey", "n_words")


def build_index(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The stored postings (term, dkey, pos) of the vocabulary's terms in all documents."""
    return read_terms(docs, vocabulary)[0]


def windows_of(items: DataFrame, size: int) -> DataFrame:
    """(ikey, ws, o, term, n): the terms of each window of items (ikey, pos, term, length)."""
    n = F.least(F.col("length"), F.lit(size))
    first = F.greatest(F.lit(0), F.col("pos") - n + 1)
    last = F.least(F.col("pos"), F.col("length") - n)
    return items.select("ikey", "term", "pos", n.alias("n"), F.explode(F.sequence(first, last)).alias("ws")).select("ikey", "ws", (F.col("pos") - F.col("ws")).alias("o"), "term", "n")


def rarest_terms(windows: DataFrame, index: DataFrame) -> DataFrame:
    """(ikey, ws, t1, o1, t2, o2) of each window all of whose terms are indexed, rarest first; t2 null for one word."""
    freq = index.groupBy("term").agg(F.count("*").alias("f"))
    w = W.partitionBy("ikey", "ws").orderBy("f", "o")
    r = windows.join(freq, "term", "left").withColumns({"r": F.row_number().over(w), "known": F.count("f").over(W.partitionBy("ikey", "ws"))})
    pick = lambda k, c: F.max(F.when(F.col("r") == k, F.col(c)))
    return r.where("known = n and r <= 2").groupBy("ikey", "ws").agg(pick(1, "term").alias("t1"), pick(1, "o").alias("o1"), pick(2, "term").alias("t2"), pick(2, "o").alias("o2"))


def phrase_hits(index: DataFrame, items: DataFrame, size: int) -> DataFrame:
    """(dkey, ikey, pos): document positions inside exact occurrences of the items' windows."""
    wanted = store(rarest_terms(windows_of(items, size), index), "wanted")
    at = (F.col("pos") - F.col("ws") - F.col("o1")).alias("start")
    lists = index.join(bounded(wanted.select(F.col("t1").alias("term")).distinct(), BROADCAST_TERMS), "term", "left_semi")
    started = lists.join(bounded(wanted, BROADCAST_WINDOWS), lists["term"] == wanted["t1"]).select("dkey", "ikey", "ws", "t2", "o2", (at + F.col("ws")).alias("start")).where("start >= 0")
    second = index.join(bounded(wanted.select(F.col("t2").alias("term")).where("term is not null").distinct(), BROADCAST_TERMS), "term", "left_semi")
    second = second.select("dkey", F.col("term").alias("t2"), F.col("pos").alias("p2"))
    need = started.withColumn("p2", F.col("start") + F.col("o2"))
    met = need.where("t2 is not null").join(second, ["dkey", "t2", "p2"], "left_semi").unionByName(need.where("t2 is null"))
    lines = store(met.select("dkey", "ikey", (F.col("start") - F.col("ws")).alias("diag")).distinct(), "lines")
    asked = lines.join(items, "ikey").select("dkey", "ikey", "diag", "term", F.col("pos").alias("ipos"), F.least("length", F.lit(size)).alias("n"), (F.col("diag") + F.col("pos")).alias("pos"))
    near = index.join(bounded(store(lines.select("dkey").distinct(), "near"), BROADCAST_TERMS), "dkey", "left_semi")
    same = asked.where("pos >= 0").join(near, ["dkey", "pos", "term"], "left_semi")  # repeated rows repeat their postings
    w = W.partitionBy("dkey", "ikey", "diag")
    runs = same.withColumn("run", F.col("ipos") - F.row_number().over(w.orderBy("ipos"))).withColumn("got", F.count("*").over(W.partitionBy("dkey", "ikey", "diag", "run")))
    return runs.where("got >= n").select("dkey", "ikey", "pos")


def proximity_hits(index: DataFrame, items: DataFrame, within: int) -> DataFrame:
    """(dkey, ikey, pos): places of an item's rarest term with all the item's other terms at most
    within positions away, in any order. Lists are met in position blocks, so no document is paired whole."""
    terms = items.select("ikey", "term").distinct()
    freq = index.groupBy("term").agg(F.count("*").alias("f"))
    w = W.partitionBy("ikey").orderBy("f", "term")
    known = terms.join(freq, "term", "left").withColumns({"r": F.row_number().over(w), "n": F.count("*").over(W.partitionBy("ikey")), "k": F.count("f").over(W.partitionBy("ikey"))}).where("n = k")
    known = store(known, "near-terms")
    anchors = index.join(known.where("r = 1").select("ikey", "term", "n"), "term").select("dkey", "ikey", "n", F.col("pos").alias("at"))
    alone = anchors.where("n = 1").select("dkey", "ikey", F.col("at").alias("pos"))
    block = lambda c: F.floor(F.col(c) / within)
    wide = anchors.where("n > 1").withColumn("b", F.explode(F.sequence(block("at") - 1, block("at") + 1)))
    others = wide.join(known.where("r > 1").select("ikey", "term"), "ikey")
    met = others.join(index.withColumn("b", block("pos")), ["dkey", "term", "b"]).where(F.abs(F.col("pos") - F.col("at")) <= within)
    met = met.groupBy("dkey", "ikey", "at").agg(F.count_distinct("term").alias("c"), F.max("n").alias("n")).where("c = n - 1")
    return alone.unionByName(met.select("dkey", "ikey", F.col("at").alias("pos")))


def item_terms(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored (ikey, term, pos, length) and (ikey, item_id) of a benchmark table."""
    rows = benchmark.select("item_id", "text").distinct().withColumn("ikey", F.xxhash64("item_id", "text"))
    t = _tokens(rows.select("ikey", "text"), "ikey").where("term is not null").select("ikey", "term", "pos")
    t = t.withColumn("length", F.count("*").over(W.partitionBy("ikey")).cast("int"))
    return store(t, "items"), rows.select("ikey", "item_id")


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """A row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and wordless texts have no words and no hits; items without words are never found. Items with
    a null id hit words but are not counted or listed. Repeated rows of either table give repeated or
    equal results. Other columns are ignored. Empty tables give no rows, or rows without hits.
    """
    own = docs.select("doc_id", "text")
    items, names = item_terms(benchmark)
    index, base = read_terms(own, store(items.select("term").distinct(), "vocabulary"))
    hits = store(phrase_hits(index, items, size).distinct(), "hits")
    places = hits.select("dkey", "pos").distinct().groupBy("dkey").agg(F.count("*").alias("n_hit"))
    found = hits.select("dkey", "ikey").distinct().join(names, "ikey").where("item_id is not null").select("dkey", F.col("item_id").cast("string").alias("item")).distinct()
    listed = found.groupBy("dkey").agg(F.count("*").alias("n_items"), F.array_join(F.sort_array(F.collect_list("item")), ",").alias("items"))
    result = store(places.join(listed, "dkey", "left"), "contaminated")
    out = base.join(result, "dkey", "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """The documents without any window of the benchmark, with all their columns."""
    own = docs.select("doc_id", "text")
    items, _ = item_terms(benchmark)
    scratch = Scratch(docs.sparkSession)
    index, _ = read_terms(own, store(items.select("term").distinct(), "vocabulary"), scratch)
    bad = store(phrase_hits(index, items, size).select("dkey").distinct(), "bad")
    scratch.clear()
    return docs.withColumn("_dkey", _dkey()).join(bounded(bad.withColumnRenamed("dkey", "_dkey"), BROADCAST_TERMS), "_dkey", "left_anti").select(*docs.columns)
