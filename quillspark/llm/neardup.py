"""Near-duplicates by SetSketch registers: banded, estimated by likelihood, then verified on full sets.

Texts with equal shingle sets are one node, stood for by one document. A register is the truncated
integer logarithm, to base B, of the least exponential value that a set's shingles draw for it; sketches
merge by the maximum. Bands of registers propose links. Every document is first compared with those heads of
its bands' buckets with which it shares most bands, which settles large groups of copies with a link for
each. Members of buckets that still hold several components then meet in blocks, with their sketches:
pairs of different components that the likelihood estimate does not rule out are verified on their
sets, in the first band that they share, and a block gives a spanning forest of its links instead of
all of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, bounded, sliced
from .components import connected_components
from .shingles import mix, shingle_set


@dataclass(frozen=True)
class NearParams:
    """percent: least similarity of linked sets. bands x rows registers. base, top: registers hold
    0..top. slack: standard deviations below the threshold at which an estimate rules a pair out.
    heads: bucket heads with which a document is compared first. block, load: members, and shingles of
    members, of a bucket compared at once, about."""

    percent: int = 85
    bands: int = 24
    rows: int = 5
    base: float = 1.05
    top: int = 1000
    slack: float = 5.0
    heads: int = 3
    block: int = 512
    load: int = 400_000
    seed: int = 77

    @property
    def registers(self) -> int:
        return self.bands * self.rows


def _multipliers(p: NearParams) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(p.seed)).integers(0, 2**64, p.registers, dtype=np.uint64) | np.uint64(1)


def sketch(shingles: np.ndarray, p: NearParams = NearParams()) -> np.ndarray:
    """Registers (uint16) of a set of shingle hashes: clip(floor(1 - log_B(min x)), 0, top), with x
    exponential at the rate 2^-20, so that small and very large sets stay within the range."""
    least = np.full(p.registers, np.iinfo(np.uint64).max)
    a = _multipliers(p)
    for at in range(0, len(shingles), 256):
        np.minimum(least, (shingles[at : at + 256, None] * a).min(axis=0), out=least)
    u = (least.astype(np.float64) + 0.5) / 2.0**64
    x = -np.log1p(-np.minimum(u, 1 - 2.0**-53)) * 2.0**20
    return np.clip(np.floor(1 - np.log(x) / np.log(p.base)) + p.top // 2, 0, p.top).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def equal_share(j: np.ndarray, p: NearParams) -> np.ndarray:
    """About the chance that registers of two sets agree, given their similarity j: the same minimum, or
    different ones in the same logarithmic step."""
    return j + (1 - j) * np.log(p.base) / 4


def log_likelihood(less: np.ndarray, same: np.ndarray, more: np.ndarray, n: np.ndarray, m: np.ndarray, j: float, p: NearParams) -> np.ndarray:
    """Of similarity j, given how many registers of the first set are below, equal to and above those of the
    second, and the sets' sizes. With similarity j, a share of the union is in the first set alone, and a
    register is larger there if the union's least value is one of those."""
    union = (n + m) / (1 + j)
    a, b = np.clip((union - m) / union, 1e-9, 1), np.clip((union - n) / union, 1e-9, 1)
    step = (a + b) * np.log(p.base) / 4
    eq = np.clip(1 - a - b + step, 1e-9, 1)
    return more * np.log(a * (1 - np.log(p.base) / 4)) + less * np.log(b * (1 - np.log(p.base) / 4)) + same * np.log(eq)


GRID = np.linspace(0.02, 1.0, 50)


def estimate(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, p: NearParams = NearParams()) -> np.ndarray:
    """The joint maximum-likelihood similarity of pairs of sketches (rows of x and y) with set sizes n and m."""
    less, same, more = (x < y).sum(axis=-1), (x == y).sum(axis=-1), (x > y).sum(axis=-1)
    most = np.minimum(n, m) / np.maximum(np.maximum(n, m), 1)
    best, out = np.full(len(x), -np.inf), np.zeros(len(x))
    for j in GRID:
        at = np.where(j <= most + 0.02, log_likelihood(less, same, more, n, m, min(j, 1 - 1e-9), p), -np.inf)
        out = np.where(at > best, j, out)
        best = np.maximum(at, best)
    return out


def least_equal(p: NearParams) -> int:
    """Equal registers below which a similarity at the threshold is ruled out, by p.slack standard deviations."""
    j = p.percent / 100
    return int(p.registers * j - p.slack * np.sqrt(p.registers * j * (1 - j)))


#: Id tables of at most this many rows (some 30 bytes each) are broadcast; larger ones are joined by shuffle.
BROADCAST_IDS = 1_000_000
SKETCHED = "doc_id long, th long, node long, n long, regs binary, keys array<long>"


def node_of(shingles: np.ndarray) -> int:
    """A 64-bit digest of a set of shingle hashes: its place in the graph of links."""
    parts = [shingles.sum(), np.bitwise_xor.reduce(shingles), mix(shingles * np.uint64(0xD6E8FEB86659FD93)).sum(), len(shingles)]
    return int.from_bytes(hashlib.blake2b(np.array(parts, np.uint64).tobytes(), digest_size=8).digest(), "little", signed=True)


def _sketch_all(p: NearParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = np.random.Generator(np.random.PCG64(p.seed + 1)).integers(0, 2**64, p.rows, dtype=np.uint64) | np.uint64(1)
        band = mix(np.arange(p.bands, dtype=np.uint64) + np.uint64(1))
        for b in sliced(batches):
            n, regs, keys, nodes = [], [], [], []
            for t in b.column("text"):
                s = shingle_set(t.as_py())
                n.append(len(s))
                r = sketch(s, p) if len(s) else None
                nodes.append(node_of(s) if len(s) else None)
                regs.append(r.tobytes() if len(s) else None)
                keys.append(mix((r.reshape(p.bands, p.rows).astype(np.uint64) * slot).sum(axis=1) + band).view(np.int64) if len(s) else [])
            cols = [b.column("doc_id"), b.column("th"), pa.array(nodes, pa.int64()), pa.array(n, pa.int64()), pa.array(regs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "th", "node", "n", "regs", "keys"])

    return run


def _set_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches):
        sets = [shingle_set(t).tobytes() for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(sets, pa.binary())], ["node", "set"])


@dataclass(frozen=True)
class Corpus:
    """docs: (doc_id, th, text). reps: the document that stands for each node, (node, doc_id, th, n, regs).
    unique: no doc_id has several rows. scratch: for tables that are read on the way alone."""

    docs: DataFrame
    reps: DataFrame
    unique: bool
    scratch: Scratch

    def sets(self, nodes: DataFrame) -> DataFrame:
        """(node, set) of the given nodes, stored; a set is its sorted hashes, 8 bytes each."""
        wanted = self.scratch.store(self.reps.select("node", "doc_id", "th").join(nodes.distinct(), "node", "left_semi"), "wanted")
        sets = self.docs.join(bounded(wanted, BROADCAST_IDS), ["doc_id", "th"]).select("node", "text").mapInArrow(_set_of, "node long, set binary")
        return self.scratch.store(sets if self.unique else sets.dropDuplicates(["node"]), "sets")


def _similar(percent: int):
    """Rows (a, b, x, y) to the pairs (a, b) whose sets x and y are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "x"):
            good = []
            for x, y in zip(b.column("x"), b.column("y"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True)) if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) else 0
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def verify(pairs: DataFrame, corpus: Corpus, p: NearParams) -> DataFrame:
    """The pairs (a, b) of nodes whose full shingle sets are similar enough. Each set is built once; a
    pair meets its two sets in two joins on evenly dealt keys, a busy one split as skew."""
    sets = corpus.sets(pairs.select(F.explode(F.array("a", "b")).alias("node")))
    x = pairs.join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    x = x.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a")
    return x.select("a", "b", "x", "y").mapInArrow(_similar(p.percent), "a long, b long")


def _candidates(k: int, ids, comp, n, regs, chunk, band: int, p: NearParams) -> np.ndarray:
    """Members after the k-th by id, of other components (and the other block, if there are two), that share
    this band with it as their first and whose estimate does not rule out a link; likeliest first."""
    hit = (comp != comp[k]) & (ids > ids[k]) & (100 * np.minimum(n[k], n) >= p.percent * np.maximum(n[k], n))
    hit = np.flatnonzero(hit if (chunk == chunk[0]).all() else hit & (chunk != chunk[k]))
    if not len(hit):
        return hit
    same = regs[hit] == regs[k]
    equal = same.sum(axis=1)
    shared = same.reshape(len(hit), p.bands, p.rows).all(axis=2).argmax(axis=1)
    hit, equal = hit[(equal >= least_equal(p)) & (shared == band)], equal[(equal >= least_equal(p)) & (shared == band)]
    if not len(hit):
        return hit
    least = p.percent / 100 - p.slack * np.sqrt(0.01 * p.percent * (1 - 0.01 * p.percent) / p.registers)
    likely = equal >= p.registers * p.percent / 100  # needs no estimate
    rest = hit[~likely]
    if len(rest):
        likely[~likely] = estimate(np.broadcast_to(regs[k], regs[rest].shape), regs[rest], np.full(len(rest), n[k]), n[rest], p) >= least
    return hit[likely][np.argsort(-equal[likely], kind="stable")]


def _in_question(ids, comp, n, regs, chunk, sets, band: int, p: NearParams) -> list[tuple[int, int]]:
    """Each member that has a candidate, or is one, of one or two blocks of a bucket."""
    met: set[int] = set()
    for k in range(len(ids)):
        found = _candidates(k, ids, comp, n, regs, chunk, band, p).tolist()
        met.update([k, *found] if found else [])
    return [(int(ids[k]), band) for k in sorted(met)]


def forest(ids, comp, n, regs, chunk, sets, band: int, p: NearParams) -> list[tuple[int, int]]:
    """Verified links that join different components among one or two blocks of a bucket, as a forest."""
    out, first = [], {}
    parent = [first.setdefault(int(c), k) for k, c in enumerate(comp)]

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k in range(len(ids)):
        for j in _candidates(k, ids, comp, n, regs, chunk, band, p):
            x, y = find(k), find(int(j))
            if x == y:
                continue
            both = len(np.intersect1d(sets[k], sets[j], assume_unique=True))
            if 100 * both >= p.percent * (n[k] + n[j] - both):
                parent[y] = x
                out.append((int(ids[k]), int(ids[j])))
    return out


PLACE = ("key", "lo", "hi")


def _blocks(p: NearParams, what, names: tuple[str, str]):
    """Rows of blocks, all of one block or pair of blocks after another, to what() finds in each."""

    def found(t: pa.Table) -> pa.RecordBatch:
        ids, comp, n, chunk, band, key, lo, hi = (t.column(c).to_numpy() for c in ("node", "component", "n", "chunk", "band", *PLACE))
        regs = np.frombuffer(b"".join(t.column("regs").to_pylist()), np.uint16).reshape(len(ids), -1)
        sets = [np.frombuffer(x, np.uint64) for x in t.column("set").to_pylist()] if "set" in t.column_names else [None] * len(ids)
        cut = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1), len(ids)]
        rows = [(*x, int(key[i])) for i, j in zip(cut, cut[1:], strict=False) if j - i > 1 for x in what(ids[i:j], comp[i:j], n[i:j], regs[i:j], chunk[i:j], sets[i:j], int(band[i]), p)]
        return pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows], pa.int64()) for c in range(3)], [*names, "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for b in sliced(batches, "regs"):
            place = np.stack([b.column(c).to_numpy() for c in PLACE])
            last = np.flatnonzero((place != place[:, -1:]).any(axis=0))
            start = int(last[-1]) + 1 if len(last) else 0  # of the block that may go on in the next batch
            if kept and (start or any(kept[-1].column(c)[-1].as_py() != b.column(c)[0].as_py() for c in PLACE)):
                yield found(pa.Table.from_batches([*kept, b.slice(0, start)]))
                kept = []
            elif start:
                yield found(pa.Table.from_batches([b.slice(0, start)]))
            kept.append(b.slice(start))
        if kept:
            yield found(pa.Table.from_batches(kept))

    return run


def _components(nodes: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    parts = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")), scratch)
    return nodes.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _open_links(buckets: DataFrame, links: DataFrame, corpus: Corpus, p: NearParams) -> DataFrame:
    """Links between members of different components in buckets with several. Buckets are cut into blocks,
    and two blocks at a time meet in a task, so that no task holds a whole bucket. Sketches meet first;
    sets go to those places alone where a member has a candidate."""
    store = corpus.scratch.store
    comp = store(_components(corpus.reps.select("node", "n", "regs"), links, corpus.scratch), "component")
    b = buckets.join(comp.select("node", "component", "n"), "node")
    mixed = b.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size"), F.sum("n").alias("total")).where("lo <> hi")
    chunks = F.greatest(F.ceil(F.col("size") / p.block), F.ceil(F.col("total") / p.load)).cast("int")
    m = store(b.join(store(mixed.select("key", chunks.alias("chunks")), "mixed"), "key"), "members")
    m = m.withColumn("chunk", F.pmod(F.xxhash64("node", "key"), F.col("chunks")).cast("int"))
    m = m.join(comp.select("node", "regs"), "node").select("key", "band", "chunks", "node", "component", "n", "regs", "chunk")
    parts = int(corpus.docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def met(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        rows = rows.withColumns({"lo": F.least("chunk", "other"), "hi": F.greatest("chunk", "other")}).drop("chunks", "other")
        return rows.repartition(parts, *PLACE).sortWithinPartitions(*PLACE)

    open_rows = met(m).mapInArrow(_blocks(p, _in_question, ("node", "band")), "node long, band long, key long").select("key", "node").distinct()
    m = store(m.join(store(open_rows, "in-question"), ["key", "node"]), "members")
    sets = corpus.sets(m.select("node"))
    return met(m.join(sets, "node")).mapInArrow(_blocks(p, forest, ("a", "b")), "a long, b long, key long").select("a", "b").distinct()


def components(docs: DataFrame, p: NearParams = NearParams(), kept: Scratch | None = None) -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id, kept, class_id.

    class_id: the least doc_id with an equal shingle set. Documents without words have no shingles and are
    linked with nothing; so are those with a null doc_id, whose component is null and which are kept.
    Rows that repeat a doc_id are one document with the links of all its texts. Other columns are
    ignored. An empty table gives no rows. Sets are told apart by 64-bit digests. A pair at the threshold
    shares no band with a chance of (1 - 0.85^rows)^bands, under one in a million. kept: gets the tables
    that the result is read from; all others are deleted before it returns.
    """
    kept, scratch = kept or Scratch(docs.sparkSession), Scratch(docs.sparkSession)
    store = scratch.store
    base = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    sk = kept.store(base.mapInArrow(_sketch_all(p), SKETCHED), "sketches")
    rows = sk.where("doc_id is not null and n > 0")
    heads = store(rows.groupBy("node").agg(F.min("doc_id").alias("id")), "heads")
    per_id = rows.groupBy("doc_id").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("k"))
    several = store(per_id.where("k > 1"), "several")
    unique = several.isEmpty()
    reps = rows.join(heads.withColumnRenamed("id", "doc_id"), ["node", "doc_id"], "left_semi")
    reps = store(reps if unique else reps.dropDuplicates(["node"]), "reps")
    corpus = Corpus(base, reps, unique, scratch)
    twice = rows.join(several.where("lo < hi"), "doc_id").where("node <> lo").select(F.col("lo").alias("a"), F.col("node").alias("b"))
    flat = reps.select("node", F.posexplode("keys").alias("band", "key"))
    busy = store(flat.groupBy("key").agg(F.min("node").alias("head"), F.count("*").alias("size")).where("size > 1"), "busy")
    buckets = store(flat.join(busy, "key").select("key", "band", "node", "head"), "buckets")
    shared = buckets.where("node <> head").groupBy("node", "head").agg(F.count("*").alias("bands"))
    nearest = F.row_number().over(W.partitionBy("node").orderBy(F.desc("bands"), "head"))  # a row for each band at most
    first = shared.withColumn("nth", nearest).where(F.col("nth") <= p.heads).select(F.col("head").alias("a"), F.col("node").alias("b"))
    links = store(verify(store(first, "first"), corpus, p).unionByName(twice), "links")
    more = _open_links(buckets.select("key", "band", "node"), links, corpus, p)
    links = links.unionByName(store(more, "links"))
    parts = store(_components(heads, links, scratch), "all-parts")
    least = parts.groupBy("component").agg(F.min("id").alias("component_id"))
    named = kept.store(parts.join(store(least, "least"), "component").select("node", "id", "component_id"), "named")
    scratch.clear()
    out = sk.withColumn("node", F.when(F.col("doc_id").isNotNull(), F.col("node"))).join(named, "node", "left")
    comp = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(comp == F.col("doc_id"), F.lit(True)).alias("kept"), F.coalesce("id", "doc_id").alias("class_id"))


def keep_first(docs: DataFrame, p: NearParams = NearParams()) -> DataFrame:
    """One document of each component, that with the least id, with all its columns; of rows that repeat
    a kept doc_id, that with the least text hash. Documents without words or with a null id all stay."""
    kept = Scratch(docs.sparkSession)
    found = components(docs, p, kept)
    ids = found.where("doc_id is not null").groupBy("doc_id").agg(F.bool_and("kept").alias("kept"), F.count("*").alias("rows"))
    ids = Scratch(docs.sparkSession).store(ids.where("not kept or rows > 1").select(F.col("doc_id").alias("_id"), (F.col("kept")).alias("_kept")), "gone")
    kept.clear()
    same = F.col("doc_id") == F.col("_id")
    once = docs.join(bounded(ids, BROADCAST_IDS), same, "left_anti")
    again = docs.join(ids.where("_kept"), same, "left_semi").withColumn("_n", F.row_number().over(W.partitionBy("doc_id").orderBy(F.xxhash64("text"))))
    return once.unionByName(again.where("_n = 1").select(*docs.columns))
