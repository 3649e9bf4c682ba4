"""Quality rules with thresholds learned per language and source from mergeable quantile sketches.

Base counts are plain text statistics. The adaptive part turns them into integer features, keeps a
log-linear histogram of each feature for every (language, source), and reads quantiles from it. Such
a histogram is a quantile sketch with a relative error of 1/32: it is a set of bucket counts, so it
merges by addition, is the same for any partitioning, and never grows beyond a few hundred buckets.
Every group's sketch is merged with those of its language and of all documents, each scaled to the
weight of a few documents: small groups lean on them, large ones hardly. A document is rejected if a
feature lies outside its group's fence.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE_RUN, SPACES, let, store, words_of


@dataclass(frozen=True)
class QualityParams:
    """min_words, repeat_percent: the base rules. fences: for each feature two percentages and how many times the distance
    of these quantiles a value may lie beyond the upper one (or, for two-sided features, below the lower one). Most documents
    have nothing of what the first three features count, so these take high quantiles, or a limit would say nothing
    of its group. A distance spans the buckets of both quantiles, so it is never below what the sketch can tell. prior: documents that the sketches of the language, and of all documents, weigh in each group's."""

    min_words: int = 20
    repeat_percent: int = 30
    window: int = 8
    fences: tuple[tuple[str, int, int, int], ...] = (("symbols", 50, 90, 2), ("dup_lines", 95, 99, 1), ("repeats", 95, 99, 1), ("word_length", 25, 75, 8))
    two_sided: tuple[str, ...] = ("word_length",)
    prior: tuple[int, int] = (30, 10)


def _repeat_words(hashes: Column, window: int) -> Column:
    """Words inside windows that occur at least twice; linear-logarithmic in the text's length."""

    def covered(win: Column) -> Column:
        def spans(s: Column) -> Column:
            same = lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | (F.get(s, i + 1)["h"] == x["h"])
            at = F.sort_array(F.transform(F.filter(s, lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["i"]))
            return let(at, lambda p: F.coalesce(F.aggregate(F.transform(p, lambda x, i: F.least(F.coalesce(F.get(p, i + 1) - x, F.lit(window)), F.lit(window))), F.lit(0), lambda a, b: a + b), F.lit(0)))

        pairs = F.sort_array(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(win)) == F.size(win), F.lit(0)).otherwise(let(pairs, spans))

    starts = F.sequence(F.lit(1), F.size(hashes) - (window - 1))
    return F.when(F.size(hashes) < window + 1, F.lit(0)).otherwise(let(F.transform(starts, lambda i: F.xxhash64(F.slice(hashes, i, window))), covered))


def text_counts(text: Column, p: QualityParams) -> Column:
    """struct(n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words), all long."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    of_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d")))
    of_words = let(words_of(text), lambda w: F.struct(F.size(w).alias("n"), let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: _repeat_words(h, p.window)).alias("r")))
    return let(
        F.struct(of_words.alias("w"), of_lines.alias("l")),
        lambda x: F.struct(
            x["w"]["n"].cast("long").alias("n_words"),
            F.length(F.regexp_replace(text, SPACE_RUN, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
            x["l"]["n"].cast("long").alias("n_lines"),
            x["l"]["d"].cast("long").alias("n_dup_lines"),
            x["w"]["r"].cast("long").alias("n_repeat_words"),
        ),
    )


def _ratio(a: str, b: str) -> Column:
    return F.floor(F.when(F.col(b) > 0, F.col(a) * 10_000 / F.col(b)).otherwise(0)).cast("long")


def _surely(a: str, b: str) -> Column:
    """The share of a count less twice its root: what it surely is, were its text drawn anew. One to four are none."""
    n = F.col(a).cast("double")
    return F.floor(F.when(F.col(b) > 0, F.greatest(n - 2 * F.sqrt(n), F.lit(0.0)) * 10_000 / F.col(b)).otherwise(0)).cast("long")


FEATURES = {"symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"), "word_length": ("word_chars", "n_words")}


def with_counts(docs: DataFrame, p: QualityParams = QualityParams()) -> DataFrame:
    """docs plus a struct column _q: counts, features, base_failed. Other columns stay as they are."""
    c = docs.withColumn("_q", text_counts(F.col("text"), p))
    q = {k: F.col(f"_q.{k}") for k in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")}
    failed = (q["n_words"] < p.min_words) | (100 * q["n_repeat_words"] > p.repeat_percent * q["n_words"])
    feats = [(_ratio if k in p.two_sided else _surely)(f"_q.{a}", f"_q.{b}").alias(k) for k, (a, b) in FEATURES.items()]
    return c.withColumn("_q", F.struct(*(v.alias(k) for k, v in q.items()), *feats, failed.alias("base_failed")))


def bucket(v: Column) -> Column:
    """Log-linear bucket: exact below 64, then 32 equal steps for each doubling."""
    e = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    return (e * 32 + F.floor(v / F.pow(F.lit(2), e))).cast("long")


def bucket_top(b: Column) -> Column:
    """The largest value of a bucket."""
    e = F.greatest(F.floor(b / 32) - 1, F.lit(0))
    return ((b - e * 32 + 1) * F.pow(F.lit(2), e) - 1).cast("long")


def sketches(counted: DataFrame) -> DataFrame:
    """Bucket counts (lang, source, feature, b, n) of the documents that pass the base rules."""
    rows = counted.where(~F.col("_q.base_failed")).select("lang", "source", F.explode(F.array(*(F.struct(F.lit(k).alias("feature"), bucket(F.col(f"_q.{k}")).alias("b")) for k in FEATURES))).alias("x"))
    return rows.groupBy("lang", "source", "x.feature", "x.b").agg(F.count("*").alias("n"))


#: Scale of the weights in merged sketches; they are whole numbers, so that any order of addition agrees.
UNIT = 1000


def merged(sketch: DataFrame, p: QualityParams = QualityParams()) -> DataFrame:
    """(lang, source, feature, b, n) of every group: its own counts, and those of its language and of all
    documents scaled to p.prior documents; all times UNIT."""
    groups = sketch.select("lang", "source", "feature").distinct()
    by_lang = sketch.groupBy("lang", "feature", "b").agg(F.sum("n").alias("n"))
    by_lang = by_lang.withColumn("t", F.sum("n").over(W.partitionBy("lang", "feature"))).withColumnsRenamed({"lang": "lang_", "feature": "feature_"})
    of_all = sketch.groupBy("feature", "b").agg(F.sum("n").alias("n")).withColumn("t", F.sum("n").over(W.partitionBy("feature")))
    same = F.col("lang").eqNullSafe(F.col("lang_")) & (F.col("feature") == F.col("feature_"))
    scaled = lambda weight: F.expr(f"n * {weight * UNIT} div t").alias("n")
    keys = ("lang", "source", "feature", "b")
    every = sketch.select(*keys, (F.col("n") * UNIT).alias("n")).unionByName(groups.join(by_lang, same).select(*keys, scaled(p.prior[0]))).unionByName(groups.join(of_all, "feature").select(*keys, scaled(p.prior[1])))
    return every.groupBy(*keys).agg(F.sum("n").alias("n"))


def thresholds(sketch: DataFrame, p: QualityParams = QualityParams()) -> DataFrame:
    """(lang, source, and for each feature struct(lo, hi)) of every group; lo is null for one-sided features."""
    w = W.partitionBy("lang", "source", "feature")
    run = merged(sketch, p).withColumn("c", F.sum("n").over(w.orderBy("b").rowsBetween(W.unboundedPreceding, 0))).withColumn("t", F.sum("n").over(w))
    low, high, times = (F.create_map(*(F.lit(x) for f in p.fences for x in (f[0], f[i])))[F.col("feature")] for i in (1, 2, 3))
    at = lambda k: F.min(F.when(100 * F.col("c") >= k * F.col("t"), F.col("b")))
    q = run.groupBy("lang", "source", "feature").agg(at(low).alias("b1"), at(high).alias("b3"))
    least = F.when(F.col("b1") > 0, bucket_top(F.col("b1") - 1) + 1).otherwise(0)  # of the bucket
    q = q.select("lang", "source", "feature", least.alias("q1"), bucket_top(F.col("b3")).alias("q3"), (times * (bucket_top(F.col("b3")) - least)).alias("reach"))
    reach = F.col("reach")
    q = q.withColumn("x", F.struct(F.when(F.col("feature").isin(*p.two_sided), F.col("q1") - reach).alias("lo"), (F.col("q3") + reach).alias("hi")))
    return q.groupBy("lang", "source").agg(*(F.max(F.when(F.col("feature") == k, F.col("x"))).alias(k) for k in FEATURES))


def judged(counted: DataFrame, p: QualityParams = QualityParams()) -> DataFrame:
    """counted plus column kept. counted must be a stored table, as it is read twice.

    Groups are joined by (lang, source), null-safe. The thresholds have one short row a group; the
    planner broadcasts them when their measured size allows it, and splits a hot group otherwise.
    """
    limits = store(thresholds(store(sketches(counted), "sketches"), p), "limits")
    t = limits.select(F.struct(*FEATURES).alias("_t"), F.col("lang").alias("_lang"), F.col("source").alias("_source"))
    joined = counted.join(t, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    out = F.lit(False)
    for k in FEATURES:
        v = F.col(f"_q.{k}")
        out = out | F.coalesce(v > F.col(f"_t.{k}.hi"), F.lit(False)) | F.coalesce(v < F.col(f"_t.{k}.lo"), F.lit(False))
    return joined.withColumn("kept", ~F.col("_q.base_failed") & ~out).drop("_t", "_lang", "_source")


def quality(docs: DataFrame, p: QualityParams = QualityParams()) -> DataFrame:
    """A row for each document: doc_id, the counts, base_failed, kept.

    Null and blank texts have zero words and fail. Null lang or source is a group of its own.
    Repeated rows give repeated results. Only doc_id, text, lang and source are read, whatever other
    columns there are. An empty table gives an empty result.
    """
    counted = store(with_counts(docs.select("doc_id", "text", "lang", "source"), p).drop("text"), "quality")
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return judged(counted, p).select("doc_id", *(f"_q.{c}" for c in cols), "kept")


def keep_good(docs: DataFrame, p: QualityParams = QualityParams()) -> DataFrame:
    """The documents that quality() keeps, with all their columns."""
    counted = store(with_counts(docs, p), "quality")
    return judged(counted, p).where("kept").select(*docs.columns)
