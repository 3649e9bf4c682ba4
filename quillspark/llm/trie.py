"""A trie of conversations: every distinct beginning of conversations is a node.

Construction is level-synchronous. Per depth, live conversations are grouped by parent node and next turn, and a
group is named by its least conv_id; a conversation stays live while members of its node differ. Once the
members of a node have equal whole sequences (or there is one member), what follows is a chain, whose rows need no
grouping. Levels are taken in blocks of 4, 8, 16, ... levels, a job a block: inside a block the turns since the
block's node name a parent as its conv_id would. Long shared beginnings so cost few jobs. Leaves and savings
are rolled up block by block from the deepest to the root.

Turns are rows from beginning to end, so that one long conversation is spread over tasks; only digests and
word counts are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, count_words

SHARED = 20  # conversations c to c + 19 may begin with turns of c
MOST = 3  # so many of them at most
FIRST_BLOCK, LARGEST_BLOCK = 4, 64  # levels
PIECE_BITS = 8  # conv_ids of 2^8 values are listed together
NUMBERED = "conv long, part int, idx long, cum long, digest binary, words long"
OUT = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
PRINTS = ("f1", "f2", "f3")


def _digest(*parts: Column) -> Column:
    """16 bytes of a SHA-256."""
    return F.substring(F.unhex(F.sha2(F.concat(*parts), 256)), 1, 16)


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the sorted turns of each conversation within a task and run up their words."""
    last, at, total = None, 0, 0
    for b in batches:
        if not b.num_rows:
            continue
        conv, words = b.column("conv").to_numpy(), b.column("words").to_numpy()
        starts = np.r_[conv[0] != last, conv[1:] != conv[:-1]]
        here = np.arange(len(conv))
        begun = np.maximum.accumulate(np.where(starts, here, -1))
        run = np.cumsum(words)
        idx = np.where(begun >= 0, here - begun + 1, at + here + 1)
        cum = np.where(begun >= 0, run - (run - words)[np.maximum(begun, 0)], total + run)
        last, at, total = conv[-1], idx[-1], cum[-1]
        yield pa.RecordBatch.from_arrays([b.column("conv"), b.column("part"), pa.array(idx), pa.array(cum), b.column("digest"), b.column("words")], names=["conv", "part", "idx", "cum", "digest", "words"])


def ordered(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv, pos, digest, words, cum): turns numbered from 1 by turn, role and text; cum: words up to and with the turn.

    Turns are sorted over all tasks at once; what earlier tasks hold of a conversation is added to its numbers, one row a
    task at most. Role and text are sorted only where turns of different content tie.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    base = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), "turn", F.struct(role.alias("role"), text.alias("text")).alias("said"),
        _digest(F.octet_length(role).cast("string"), F.lit(":"), role, text).alias("digest"), count_words(text).alias("words"),
    )
    ties = base.groupBy("conv", "turn").agg((F.min("digest") != F.max("digest")).alias("tie")).where("tie")
    ties = scratch.store(ties.select(F.col("conv").alias("c_"), F.col("turn").alias("t_"), "tie"), "ties")
    if ties.isEmpty():
        rows = base.withColumn("said", F.lit(None).cast("string"))
    else:
        rows = base.join(ties, (F.col("conv") == F.col("c_")) & F.col("turn").eqNullSafe(F.col("t_")), "left").withColumn("said", F.when(F.col("tie"), F.col("said")))
    keys = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("said"), F.col("digest")]
    n = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # equal rows are spread by where they were read
    placed = rows.select("conv", "turn", "said", "digest", "words", F.spark_partition_id().alias("from")).repartitionByRange(n, *keys, F.col("from")).sortWithinPartitions(*keys)
    placed = placed.select("conv", F.spark_partition_id().alias("part"), "digest", "words").mapInArrow(_number, NUMBERED)
    placed = scratch.store(placed, "placed")
    ends = placed.groupBy("conv", "part").agg(F.max("idx").alias("n"), F.max("cum").alias("w"))
    earlier = W.partitionBy("conv").orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row a task
    before = ends.withColumns({"n0": F.sum("n").over(earlier), "w0": F.sum("w").over(earlier)}).where(F.col("n0").isNotNull()).select("conv", "part", "n0", "w0")
    before = F.broadcast(scratch.store(before, "before"))  # a task goes on with one conversation at most
    out = placed.join(before, ["conv", "part"], "left").na.fill(0, ["n0", "w0"])
    return scratch.store(out.select("conv", (F.col("idx") + F.col("n0")).alias("pos"), "digest", "words", (F.col("cum") + F.col("w0")).alias("cum")), "turns")


def rebuilt(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rows as ordered() gives them and (conv, len, total, f1, f2, f3) of all conversations, each begun by another's turns.

    A conversation c starts with the first h turns of c - c % 20, followed by its own without its first h; h is
    crc32(c) % 4. len may be 0. f1 to f3 are a 192-bit fingerprint of the whole sequence.
    """
    heads = [F.coalesce(F.max(F.when(F.col("pos") <= k, F.col("cum"))), F.lit(0)) if k else F.lit(0) for k in range(MOST + 1)]
    convs = scratch.store(turns.groupBy("conv").agg(F.max("pos").alias("n"), F.max("cum").alias("all"), F.array(*[x.cast("long") for x in heads]).alias("heads")), "convs")
    info = convs.withColumns({"base": F.col("conv") - F.col("conv") % SHARED, "h": (F.crc32(F.col("conv").cast("string").cast("binary")) % (MOST + 1)).cast("int")})
    lead = convs.select(F.col("conv").alias("base"), F.col("n").alias("bn"), F.col("heads").alias("bh"))
    info = info.join(lead, "base", "left").withColumn("kept", F.least("h", F.coalesce("bn", F.lit(0))).cast("int"))
    head = lambda of: F.coalesce(F.get(of, F.col("h")), F.lit(0))
    info = scratch.store(info.select("conv", "base", "h", "kept", head("bh").alias("lead_words"), head("heads").alias("own_words"), "n", "all"), "info")
    few = turns.where(F.col("pos") <= MOST).withColumnRenamed("conv", "base")
    one = few.join(info.select("base", "conv", "h"), "base").where("pos <= h").select("conv", "pos", "digest", "words", "cum")
    mine = info.select("conv", "h", "kept", (F.col("lead_words") - F.col("own_words")).alias("shift"))
    two = turns.join(mine, "conv").where("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("kept")).alias("pos"), "digest", "words", (F.col("cum") + F.col("shift")).alias("cum"))
    rows = scratch.store(one.unionByName(two), "rebuilt")
    prints = [F.expr(f"bit_xor(xxhash64({k}, pos, digest))").alias(f) for k, f in enumerate(PRINTS)]
    whole = info.select("conv", (F.col("kept") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("long").alias("len"), (F.col("lead_words") + F.col("all") - F.col("own_words")).alias("total"))
    members = whole.join(rows.groupBy("conv").agg(*prints), "conv", "left").na.fill(0, list(PRINTS))
    return rows, scratch.store(members, "members")


def _block(rows: DataFrame, live: DataFrame, depth: int, size: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Group the levels depth + 1 to depth + size of live conversations (conv, node, len, f1, f2, f3).

    Gives the steps (node, k, path, conv, ...), where path has the keys of the turns since depth, and the groups (node, k, key,
    path, child, n, words, open) of which every one has an open parent, with parent.
    """
    near = rows.where((F.col("pos") > depth) & (F.col("pos") <= depth + size)).select("conv", "pos", "digest", "words")
    each = near.join(live, "conv").groupBy("conv", "node", "len", *PRINTS).agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "words"))).alias("next"))  # size turns at most
    key = lambda acc, x: F.concat(acc, F.array(_digest(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(b"")), x["digest"])))
    paths = each.withColumn("keys", F.aggregate("next", F.array().cast("array<binary>"), key))
    steps = paths.select("conv", "node", "len", *PRINTS, "keys", F.posexplode(F.col("next.words")).alias("k", "words"))
    steps = steps.withColumns({"k": F.col("k") + 1, "path": F.slice("keys", 1, F.col("k") + 1)}).drop("keys")
    steps = scratch.store(steps.withColumn("key", F.element_at("path", -1)), "steps")
    open_ = F.min(F.struct(*PRINTS)) != F.max(F.struct(*PRINTS))
    groups = steps.groupBy("node", "k", "key").agg(F.min("conv").alias("child"), F.count("*").alias("n"), F.max("words").alias("words"), F.max("path").alias("path"), open_.alias("open"))
    groups = scratch.store(groups, "groups")
    above = groups.where("open").select("node", (F.col("k") + 1).alias("k"), F.col("key").alias("above"), F.col("child").alias("parent"))
    top = groups.where("k = 1").withColumn("parent", F.col("node"))
    lower = groups.where("k > 1").withColumn("above", F.element_at("path", -2)).join(above, ["node", "k", "above"]).drop("above")
    return steps, scratch.store(top.unionByName(lower).withColumn("depth", (F.col("k") + depth).cast("long")), "nodes")


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each sequence's lists of conv_ids, which come in order, with the first conv_id."""
    at, first, length, h = None, None, None, hashlib.sha256()
    for b in batches:
        rows = []
        for f1, f2, f3, n, least, ids in zip(*(b.column(c).to_pylist() for c in (*PRINTS, "len", "least", "ids")), strict=True):
            if (f1, f2, f3, n) != at:
                if at is not None:
                    rows.append((first, length, h.hexdigest()))
                at, first, length, h = (f1, f2, f3, n), least, n, hashlib.sha256(ids.encode())
            else:
                h.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["conv", "len", "ends"])
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([length], pa.int64()), pa.array([h.hexdigest()])], names=["conv", "len", "ends"])


def _ends(members: DataFrame, reached: DataFrame) -> DataFrame:
    """(depth, conv_id, ends): the hash of the conv_ids that end at a node. reached: (conv, node) of those that end at an open one."""
    bucket = F.shiftright("conv", PIECE_BITS)
    listed = F.sort_array(F.collect_list("conv"))
    pieces = members.groupBy(*PRINTS, "len", bucket.alias("bucket")).agg(F.min("conv").alias("least"), F.array_join(listed.cast("array<string>"), ",").alias("ids"))
    placed = pieces.repartition(*PRINTS, "len").sortWithinPartitions(*PRINTS, "len", "bucket")
    found = placed.mapInArrow(_hash_pieces, "conv long, len long, ends string")
    return found.join(reached, "conv", "left").select(F.col("len").alias("depth"), F.coalesce("node", "conv").alias("conv_id"), "ends")


def nodes(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations (conv_id, turn, role, text): OUT.

    Turns are ordered by turn, nulls first, then by role and text; a null role or text is empty, equal rows are
    turns of their own. Rows without a conv_id belong to no conversation. A conversation left without turns is
    a member of the root alone. saved_tokens counts the words that members of a node share. Other columns are ignored. An empty
    table gives no rows.
    """
    spark = conversations.sparkSession
    scratch = Scratch(spark)
    rows, members = rebuilt(ordered(conversations.select("conv_id", "turn", "role", "text"), scratch), scratch)
    root = members.agg(F.min("conv").alias("conv"), F.count("*").alias("n")).first()
    if not root["n"]:
        return spark.createDataFrame([], OUT)
    live, depth, size, blocks = members.select("conv", F.lit(root["conv"]).alias("node"), "len", *PRINTS), 0, FIRST_BLOCK, []
    reached = members.where("len = 0").select("conv", F.lit(root["conv"]).alias("node"))
    while True:
        steps, found = _block(rows, live, depth, size, scratch)
        blocks.append(found)
        names = found.where("open").select("node", "k", "key", F.col("child"))
        reached = reached.unionByName(steps.where(F.col("len") == F.col("k") + depth).join(names, ["node", "k", "key"]).select("conv", F.col("child").alias("node")))
        if found.where((F.col("k") == size) & F.col("open")).isEmpty():
            break
        last = steps.where((F.col("k") == size) & (F.col("len") > depth + size)).drop("words", "path")
        live = scratch.store(last.join(names, ["node", "k", "key"]).select("conv", F.col("child").alias("node"), "len", *PRINTS), "live")
        depth, size = depth + size, min(2 * size, LARGEST_BLOCK)

    total = members.select(F.col("conv").alias("child"), "len", "total")
    chains = [b.where("NOT open").select("child", F.col("depth").alias("head"), "parent", "n") for b in blocks]
    chain = scratch.store(_union(chains).join(total, "child"), "chains")
    whole = rows.withColumnRenamed("conv", "child").join(chain, "child").where("pos >= head")
    saved = (F.col("n") - 1) * (F.col("total") - F.col("cum") + F.col("words"))
    whole = whole.select(F.col("child").alias("conv_id"), F.col("pos").alias("depth"), F.when(F.col("pos") == F.col("head"), F.col("parent")).otherwise(F.col("child")).alias("parent_conv_id"), F.col("n").alias("n_convs"), (F.col("pos") < F.col("len")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), saved.alias("saved_tokens"))

    heads = rows.withColumnRenamed("conv", "child").join(chain.select("child", F.col("head").alias("pos"), "n", "total"), ["child", "pos"])
    heads = scratch.store(heads.select("child", F.col("pos").alias("depth"), saved.alias("saved"), F.lit(1).alias("leaves")), "chain-heads")
    rolled, below = [], None
    for found in reversed(blocks):
        own = found.where("open").withColumns({"saved": (F.col("n") - 1) * F.col("words"), "leaves": F.lit(0)})
        if below is not None:
            own = own.join(below, ["child", "depth"], "left").withColumns({"saved": F.col("saved") + F.coalesce("s_", F.lit(0)), "leaves": F.col("leaves") + F.coalesce("l_", F.lit(0))}).drop("s_", "l_")
        closed = found.where("NOT open").join(heads, ["child", "depth"])
        items = scratch.store(own.unionByName(closed.select(own.columns)), "items")
        sums = [F.sum("saved").cast("long").alias("s_"), F.sum("leaves").cast("long").alias("l_")]
        under = items.select("node", "saved", "leaves", F.posexplode("path").alias("k", "key")).withColumn("k", F.col("k") + 1).groupBy("node", "k", "key").agg(*sums)
        rolled.append(items.where("open").join(under, ["node", "k", "key"]).select(F.col("child").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("l_").alias("n_leaves"), F.col("s_").alias("saved_tokens")))
        first = items.groupBy(F.col("node").alias("child"), (F.col("depth") - F.col("k")).alias("depth")).agg(*sums)
        below = scratch.store(first, "below")
    inner = _union(rolled)
    top = spark.range(1).select(F.lit(root["conv"]).alias("child"), F.lit(0).cast("long").alias("depth")).join(below, ["child", "depth"], "left")
    top = top.select(F.col("child").alias("conv_id"), "depth", F.lit(None).cast("long").alias("parent_conv_id"), F.lit(root["n"]).cast("long").alias("n_convs"), F.coalesce("l_", F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("s_", F.lit(0)).cast("long").alias("saved_tokens"))
    kids = _union([b.select(F.col("parent").alias("conv_id"), (F.col("depth") - 1).alias("depth")) for b in blocks]).groupBy("conv_id", "depth").agg(F.count("*").alias("n_children"))
    inner = inner.unionByName(top).join(kids, ["conv_id", "depth"], "left").na.fill(0, ["n_children"])
    ends = _ends(members, reached)
    return inner.unionByName(whole).join(ends, ["conv_id", "depth"], "left").select(*[x.split()[0] for x in OUT.split(", ")[:-1]], F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
