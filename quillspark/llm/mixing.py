"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Documents fall into hashed blocks of their source. A source's target decides how often its blocks
are drawn: whole passes over all blocks, then a last pass over permuted blocks up to the target, whose
last block is cut between two documents. The draws of all sources are dealt to output shards by a
binary tree: at each node the left half of the shards gets a multivariate-hypergeometric share of
every source's remaining draws, so each shard's mixture is as if drawn without replacement from all.
Each shard draws as many of a source's permuted blocks as the tree allots to it, disjoint from those of
other shards, and is shuffled locally by a hash. Only per-source totals reach the driver; the tree
has a row for each shard there.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import count_words, store


@dataclass(frozen=True)
class MixParams:
    """weights: repeated over the sources in code-point order, null last. most: times a source's size
    that a target may reach. blocks: per source, at least, and block_words: words of a block of the
    largest source, at most about; shards and shard_words: likewise of the output. seed: of hashes and draws."""

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    most: float = 3.0
    blocks: int = 1024
    block_words: int = 2_000_000
    shards: int = 64
    shard_words: int = 40_000_000
    seed: int = 17

    def grown(self, sizes: list[int]) -> MixParams:
        """With as many blocks and shards as sources of these sizes need."""
        most, total = max(sizes, default=0), sum(sizes)
        return replace(self, blocks=max(self.blocks, -(-most // self.block_words)), shards=max(self.shards, -(-total // self.shard_words)))


def targets(sizes: list[int], p: MixParams = MixParams()) -> list[float]:
    """Target words of each source, in order: shares by weight of the total, at most p.most times a
    source's size; what is over goes to the others by weight until none is above."""
    size = [float(x) for x in sizes]
    weight = [p.weights[i % len(p.weights)] for i in range(len(size))]
    capped: set[int] = set()
    total = sum(size)
    while True:
        rest = total - sum(p.most * size[i] for i in capped)
        open_weight = sum(w for i, w in enumerate(weight) if i not in capped)
        out = [p.most * size[i] if i in capped else rest * weight[i] / open_weight for i in range(len(size))]
        above = {i for i in range(len(size)) if i not in capped and out[i] > p.most * size[i]}
        if not above:
            return out
        capped |= above


def split_tree(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Draws of each shard from each source: (shards, sources), columns sum to quotas, and rows differ
    by at most one draw in total."""
    out = np.zeros((shards, len(quotas)), dtype=np.int64)

    def share(left: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[lo] = left
            return
        mid = (lo + hi) // 2
        take = int(left.sum()) * (mid - lo) // (hi - lo)
        rng = np.random.Generator(np.random.PCG64([seed, lo, hi]))
        part = rng.multivariate_hypergeometric(left, take, method="marginals") if take else np.zeros_like(left)
        share(part, lo, mid)
        share(left - part, mid, hi)

    share(np.asarray(quotas, dtype=np.int64), 0, shards)
    return out


def _hash(p: MixParams, *cols: str | Column) -> Column:
    return F.xxhash64(F.lit(p.seed), *cols)


def _sources(sized: DataFrame, p: MixParams) -> tuple[DataFrame, MixParams]:
    """(source, source_size, target) from rows (source, _size), and the parameters grown to them."""
    totals = sized.groupBy("source").agg(F.sum("_size").alias("n")).collect()  # one row a source
    order = sorted(totals, key=lambda r: (r["source"] is None, r["source"] or ""))
    wanted = targets([r["n"] for r in order], p)
    schema = T.StructType([T.StructField("source", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType())])
    rows = [(r["source"], int(r["n"]), float(t)) for r, t in zip(order, wanted, strict=True)]
    return sized.sparkSession.createDataFrame(rows, schema), p.grown([r["n"] for r in order])


def plan(sized: DataFrame, sources: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """From rows (source, _block, _size), the draws: source, block, pass, shard, cut, where cut is null for a
    whole block, else the number of words to take from it."""
    spark = sized.sparkSession
    blocks = store(sized.groupBy("source", F.col("_block").alias("block")).agg(F.sum("_size").alias("words")), "blocks")
    w = W.partitionBy("source").orderBy(F.col("rank"), F.col("block"))
    b = blocks.withColumn("rank", _hash(p, F.lit("permute"), "source", "block"))
    b = b.withColumn("nth", F.row_number().over(w) - 1).withColumn("end", F.sum("words").over(w))
    b = b.join(sources.withColumnRenamed("source", "s_"), F.col("source").eqNullSafe(F.col("s_"))).drop("s_")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    rest = F.col("target") - passes * F.col("source_size")
    whole = b.select("source", "block", "nth", F.explode(F.when(passes > 0, F.sequence(F.lit(0), passes - 1)).otherwise(F.array().cast("array<int>"))).alias("pass"), F.lit(None).cast("double").alias("cut"))
    start = F.col("end") - F.col("words")
    last = b.where((rest > start) & (F.col("words") > 0)).select("source", "block", "nth", passes.alias("pass"), F.when(rest < F.col("end"), rest - start).alias("cut"))
    place = F.row_number().over(W.partitionBy("source").orderBy("pass", "nth"))
    draws = store(whole.unionByName(last).withColumn("place", place), "draws")
    quotas = draws.groupBy("source").agg(F.count("*").alias("k")).collect()  # one row a source
    quotas = sorted(quotas, key=lambda r: (r["source"] is None, r["source"] or ""))
    ends = split_tree(np.array([r["k"] for r in quotas], dtype=np.int64), p.shards, p.seed).cumsum(axis=0)
    schema = T.StructType([T.StructField("s_", T.StringType()), T.StructField("ends", T.ArrayType(T.LongType()))])
    runs = spark.createDataFrame([(r["source"], [0, *ends[:, i].tolist()]) for i, r in enumerate(quotas)], schema)
    runs = runs.select("s_", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("ends") - 1), lambda k: F.struct((F.get("ends", k - 1) + 1).alias("first"), F.get("ends", k).alias("last")))).alias("shard", "run"))
    allotted = runs.where("run.last >= run.first").select("s_", "shard", F.explode(F.sequence("run.first", "run.last")).alias("place_"))
    draws = draws.join(allotted, F.col("source").eqNullSafe(F.col("s_")) & (F.col("place") == F.col("place_")))
    return store(draws.select("source", "block", "pass", "shard", "cut"), "dealt")


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_size", count_words(F.col("text")))


def _blocked(sized: DataFrame, p: MixParams) -> DataFrame:
    return sized.withColumn("_block", F.pmod(_hash(p, F.lit("block"), "doc_id", "_size"), F.lit(p.blocks)).cast("int"))


def _within(rows: DataFrame, p: MixParams) -> DataFrame:
    """Rows of the cut blocks with column _in: the last pass takes documents in hash order, as long as
    the middle of the next one is not beyond the cut."""
    w = W.partitionBy("source", "_block").orderBy(_hash(p, F.lit("cut"), "doc_id"), "doc_id", "_size").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("_in", F.sum("_size").over(w) - F.col("_size") / 2 <= F.col("_cut"))


def _same() -> Column:
    return F.col("source").eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_b"))


def taken(docs: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """A row for each document: doc_id, size, source_size, target, taken, shards.

    shards: the numbers of the shards that drew the document, one for each time, in order, comma-joined; taken is
    size times their number. size counts words (null text: 0). A null source is a source of its own, the last. Repeated rows
    are documents of their own. Sources without words have target 0. Only doc_id, source and text are
    read. An empty table gives no rows. The result depends on the rows and p alone.
    """
    sized = store(_sized(docs.select("doc_id", "source", "text")).drop("text"), "sized")
    sources, p = _sources(sized, p)
    sized = _blocked(sized, p)
    shard = F.col("shard").cast("string")
    met = plan(sized, sources, p).groupBy(F.col("source").alias("_s"), F.col("block").alias("_b"))
    blocks = met.agg(F.collect_list(F.when(F.col("cut").isNull(), shard)).alias("_whole"), F.max("cut").alias("_cut"), F.max(F.when(F.col("cut").isNotNull(), shard)).alias("_last"))
    rows = sized.join(store(blocks, "copies"), _same(), "left").drop("_s", "_b")
    rows = rows.where("_cut is null").withColumn("_in", F.lit(False)).unionByName(_within(rows.where("_cut is not null"), p))
    drawn = F.concat(F.coalesce("_whole", F.array().cast("array<string>")), F.when(F.col("_in"), F.array("_last")).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("_drawn", F.sort_array(F.transform(drawn, lambda x: x.cast("int"))))
    rows = rows.join(sources.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left")
    times = (F.col("_size") * F.size("_drawn")).cast("long").alias("taken")
    return rows.select("doc_id", F.col("_size").alias("size"), "source_size", "target", times, F.array_join(F.transform("_drawn", lambda x: x.cast("string")), ",").alias("shards"))


def mix(docs: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """The mixture itself: all columns of docs, a row for each time that a document is drawn, dealt to
    p.shards shards and put in hash order within each. Nulls, repeats and empty tables as in taken()."""
    sized = store(_sized(docs.select("doc_id", "source", "text")).drop("text"), "sized")
    sources, p = _sources(sized, p)
    draws = plan(_blocked(sized, p), sources, p)
    d = draws.select(F.col("source").alias("_s"), F.col("block").alias("_b"), F.col("cut").alias("_cut"), F.col("pass").alias("_pass"), F.col("shard").alias("_shard"))
    rows = _blocked(_sized(docs), p)
    whole = rows.join(d.where("_cut is null"), _same()).withColumn("_in", F.lit(True))
    last = _within(rows.join(d.where("_cut is not null"), _same()), p)
    out = whole.unionByName(last).where("_in").withColumn("_order", _hash(p, F.lit("order"), "doc_id", "_pass"))
    return out.repartitionById(p.shards, "_shard").sortWithinPartitions("_order").select(*docs.columns)
