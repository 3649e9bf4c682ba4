"""Language-model scoring by logistic context mixing, with a unigram base score.

Texts are coded byte by byte along Huffman trees of the training bytes, one tree for each preceding byte,
so that a byte costs a few binary decisions. Several predictors, each keyed by a hash of another context
(two bytes, four bytes, the word so far) and the tree node, give the chance of a 1. Their counts are
gathered from all training text and added up across tasks; their tables have more slots the more training
text there is. A mixer, gated by the tree node, adds the predictors' log-odds with weights that are
adapted online as a text is read, and an adaptive stage refines its output. The cost in bits of all
decisions is the text's.

The weights that a text starts with, and the refining table, are fitted on all training text: tasks count its
decisions by node, outcome and the levels of the predictors' log-odds, each without the decision's own
count; the sums of these counts, a table whose size is fixed, are what logistic regression needs.

A text is read in steps: bytes up to 64, 128, 256, 512, 1,024 and 2,048, then 2,048 at a time. After each
step the text's weights and bias move; they are carried to its end and start anew with the next text, so
the result depends on the text and the model alone, whatever else is in the batch.

The base score needs the corpus count of every token. Chunks of documents list their distinct tokens by
64-bit hash, in ascending order, cut into buckets; a bucket adds up the counts of all chunks, and answers
each chunk's list with as many counts. No text and no token string is moved.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, store
from .shingles import word_hashes

#: Ends of the first steps, and the length of each further one; a window is read at once.
FIRST_STEPS, STEP, WINDOW = (64, 128, 256, 512, 1024, 2048), 2048, 1 << 18
#: What stands before every text: contexts never reach into another text.
LEAD = b"\n" * 4
#: Bytes of a text before a window that its contexts see.
BACK = 64
ORDERS = ("two", "four", "word")
CELLS = 48
#: Log-odds are kept as whole numbers of this size, a byte each.
GRAIN = 0.1
PAGE = 1 << 13
#: Least log-odds, in GRAINs, of each level but the first, and the level of each log-odds from -128 on.
LEVELS = np.array([-66, -46, -32, -22, -14, -7, -2, 3, 8, 15, 23, 33, 47, 67])
LEVEL = np.searchsorted(LEVELS, np.arange(-128, 128), side="right").astype(np.uint8)
#: The final log-odds of a decision are rounded to 1 / FINE; costs and errors (bit less its chance) by bit and place.
FINE, REACH = 64, 14
PLACES = 2 * REACH * FINE + 1
_at = (np.arange(PLACES) / FINE - REACH) * np.array([[-1], [1]])
COST = np.log1p(np.exp(-_at)).astype(np.float32).ravel()
ERROR = (np.array([[-1], [1]]) / (1 + np.exp(_at))).astype(np.float32).ravel()


@dataclass(frozen=True)
class MixParams:
    """bits, most_bits: the predictors' tables have 2^bits slots an order, or more, about one for each per_slot
    bytes of training text, up to 2^most_bits (the model is broadcast). rate, refine: steps of the online
    updates. block: bytes of text whose tokens are listed together, about. bucket: likewise, whose tokens
    a bucket adds up."""

    bits: int = 18
    most_bits: int = 22
    per_slot: int = 256
    rate: float = 0.5
    refine: float = 0.5
    block: int = 8_000_000
    bucket: int = 32_000_000

    def grown(self, size: int) -> MixParams:
        """For so many bytes of text."""
        return replace(self, bits=max(self.bits, min(self.most_bits, math.ceil(math.log2(size / self.per_slot + 1)))))


def huffman(counts: np.ndarray) -> list[list[tuple[int, int]]]:
    """For each byte its (node, bit) path. Every byte has one, as each count is raised by one."""
    heap = [(int(c) + 1, i, i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    children, n = {}, 256
    while len(heap) > 1:
        (ca, _, a), (cb, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        children[n] = (a, b)
        heapq.heappush(heap, (ca + cb, n, n))
        n += 1
    out: list[list[tuple[int, int]]] = [[] for _ in range(256)]
    todo = [(heap[0][2], [])]
    while todo:
        at, path = todo.pop()
        if at < 256:
            out[at] = path
        else:
            todo += [(child, [*path, (at - 256, b)]) for b, child in enumerate(children[at])]
    return out


@dataclass
class Trees:
    """Paths of all (preceding byte, byte) pairs, one after another: first and length by pair, node and bit."""

    first: np.ndarray
    length: np.ndarray
    node: np.ndarray
    bit: np.ndarray

    def wide(self) -> Trees:
        """With numbers that index arrays as they are."""
        return Trees(*(x.astype(np.intp) for x in (self.first, self.length, self.node, self.bit)))

    @classmethod
    def of(cls, pairs: np.ndarray) -> Trees:
        """pairs: 256 x 256 counts."""
        plain = huffman(pairs.sum(axis=0))
        paths = [path for row in pairs for path in (huffman(row) if row.any() else plain)]
        length = np.array([len(x) for x in paths], np.int32)
        flat = np.array([step for path in paths for step in path], np.int32)
        return cls((np.cumsum(length) - length).astype(np.int32), length, flat[:, 0].copy(), flat[:, 1].astype(np.uint8))


def text_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


@dataclass
class Laid:
    """Windows in one array, each behind what its contexts see: pair of each byte, and hash of each context."""

    pair: np.ndarray
    ctx: list[np.ndarray]
    size: np.ndarray


def before(text: bytes, at: int) -> bytes:
    """What the contexts of a window that starts at a place see before it."""
    return text[at - BACK : at] if at else LEAD


_P = np.uint64(0x9E3779B97F4A7C15)
_powers: list[np.ndarray] = [np.ones(1, np.uint64)] * 2


def powers(n: int) -> list[np.ndarray]:
    """_P^0, _P^1, ... and their inverses, n or more."""
    if len(_powers[0]) < n:
        for k, base in enumerate((int(_P), pow(int(_P), -1, 1 << 64))):
            x = np.full(2 * n, base, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers


def lay_out(parts: list[tuple[bytes, bytes]], bits: int) -> Laid:
    """parts: (before, window), of which the windows are coded."""
    data = np.frombuffer(b"".join(x for part in parts for x in part), np.uint8)
    size = np.array([len(x) for _, x in parts], np.int64)
    lead = np.array([len(x) for x, _ in parts], np.int64)
    start = np.cumsum(size + lead) - size
    at = np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)
    mul = [np.uint32(k) for k in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F)]
    shift = np.uint32(32 - bits)
    # contexts of all places from the fifth on; every window has four bytes before it
    d = data.astype(np.uint32)
    two = d[3:-1] * mul[0] + d[2:-2] * mul[1]
    four = two + d[1:-3] * mul[2] + d[:-4] * mul[3]
    four = (four ^ (four >> np.uint32(15))) * mul[3]
    two = (two ^ (two >> np.uint32(15))) * mul[2]
    # letters weighted by powers: sums over the whole array, less what is before the word, over the power at its start
    fresh = np.concatenate([[True], data[:-1] <= 32])
    fresh[start - lead] = True
    w = np.maximum.accumulate(np.where(fresh, np.arange(len(data)), 0)).take(at)
    power, inverse = powers(len(data))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(data * power[: len(data)], dtype=np.uint64)])
    word = (total.take(at) - total.take(w)) * inverse.take(w)
    word = ((word >> np.uint64(32)).astype(np.uint32) + (at - w).astype(np.uint32) * mul[1]) * mul[0]
    at -= 4
    pair = (d[3:-1] * np.uint32(256) + d[4:]).take(at).astype(np.intp)
    return Laid(pair, [(x >> shift).astype(np.intp) for x in (two.take(at), four.take(at), word)], size)


def _steps(trees: Trees, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(decisions of each byte; byte, and place in the trees, of every decision, in order)."""
    n = trees.length.take(pair)
    ends = np.cumsum(n)
    opens = np.zeros(int(ends[-1]) if len(n) else 0, np.int8)
    opens[ends[:-1]] = 1  # no path is empty
    byte = np.cumsum(opens, dtype=np.intp)
    leaf = (trees.first.take(pair) - (ends - n)).take(byte)
    leaf += np.arange(len(leaf))
    return n, byte, leaf


def _slots(ctx: np.ndarray, byte: np.ndarray, node: np.ndarray, bits: int) -> np.ndarray:
    """Where a predictor keeps the decisions: a context's nodes follow one another."""
    at = ctx.take(byte)
    at += node
    at &= (1 << bits) - 1
    return at


def _read(batches: Iterator[pa.RecordBatch], trees: Trees, bits: int) -> Iterator[tuple[Laid, np.ndarray, np.ndarray]]:
    """All decisions of texts, part by part: contexts, and byte and place in the trees of each decision."""
    for b in sliced(batches, size=60_000):
        texts = [text_bytes(t) for t in b.column("text").to_pylist()]
        cut = [(before(t, at), t[at : at + WINDOW]) for t in texts for at in range(0, len(t), WINDOW)]
        for part in ([cut] if sum(map(len, texts)) <= 2 * WINDOW else [[x] for x in cut]):
            if part:
                laid = lay_out(part, bits)
                yield laid, *_steps(trees, laid.pair)[1:]


@dataclass
class Model:
    """trees, the predictors' log-odds in GRAINs, starting weights by node, and the refining table."""

    trees: Trees
    odds: np.ndarray
    p: MixParams
    weights: np.ndarray = field(default=None)
    refined: np.ndarray = field(default=None)

    @classmethod
    def of(cls, pairs: np.ndarray, odds: np.ndarray, p: MixParams) -> Model:
        """odds: (orders, 2^bits) from log_odds()."""
        start = np.full((len(ORDERS), 256), 0.4, np.float32)
        return cls(Trees.of(pairs), odds, p, start, np.tile(np.linspace(-12, 12, CELLS + 1, dtype=np.float32), (256, 1)))

    @cached_property
    def wide(self) -> Trees:
        return self.trees.wide()

    def bits_of(self, texts: list[bytes]) -> np.ndarray:
        """Bits that each text costs."""
        out = np.zeros(len(texts))
        state = np.zeros((len(ORDERS) + 1, len(texts)), np.float32)  # what is added to a text's gated weights, and its bias
        for at in range(0, max(map(len, texts), default=0), WINDOW):
            rows = np.array([k for k, t in enumerate(texts) if len(t) > at])
            own = state[:, rows]
            out[rows] += self._window([(before(texts[k], at), texts[k][at : at + WINDOW]) for k in rows], at, own)
            state[:, rows] = own
        return out / math.log(2)

    def _window(self, parts: list[tuple[bytes, bytes]], at: int, state: np.ndarray) -> np.ndarray:
        """Natural-log costs of windows that start at the same place of their texts; moves state."""
        bits, trees = self.p.bits, self.wide
        laid = lay_out(parts, bits)
        out = np.zeros(len(parts))
        place = at + np.arange(len(laid.pair)) - np.repeat(np.cumsum(laid.size) - laid.size, laid.size)
        step = (np.searchsorted(FIRST_STEPS, place, side="right") + np.maximum(place - FIRST_STEPS[-1], 0) // STEP).astype(np.uint16 if at < 1 << 26 else np.int64)
        owner = np.repeat(np.arange(len(parts)), laid.size)
        order = np.argsort(step, kind="stable")
        starts = np.unique(step[order], return_index=True)[1]
        weights, refined = self.weights * np.float32(GRAIN), self.refined.ravel()
        for i, j in zip(starts, [*starts[1:], len(order)], strict=True):
            rows = order[i:j]
            n, byte, leaf = _steps(trees, laid.pair.take(rows))
            own = owner.take(rows)
            cut = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            mine, first = own[cut], (np.cumsum(n) - n)[cut]
            many = np.diff(np.concatenate([first, [len(leaf)]]))
            node = trees.node.take(leaf)
            z, xs = np.zeros(len(leaf), np.float32), []
            for o in range(len(ORDERS)):
                x = self.odds[o].take(_slots(laid.ctx[o].take(rows), byte, node, bits)).astype(np.float32)
                xs.append(x)
                w = weights[o].take(node)
                w += np.repeat(state[o][mine] * np.float32(GRAIN), many)
                w *= x
                z += w
            cell = np.clip((z + 12) * (CELLS / 24) + np.float32(0.5), 0, CELLS).astype(np.intp)
            cell += node * (CELLS + 1)
            z += refined.take(cell)
            z *= np.float32(0.5)
            z += np.repeat(state[-1][mine], many)
            place = np.clip(z * FINE + np.float32(REACH * FINE + 0.5), 0, PLACES - 1).astype(np.intp)
            place += trees.bit.take(leaf) * PLACES
            err = ERROR.take(place)
            out += np.bincount(mine, np.add.reduceat(COST.take(place), first, dtype=np.float64), len(parts))
            for o in range(len(ORDERS)):  # a bound of the curvature keeps steps from running away
                slope, curve = np.add.reduceat(err * xs[o], first), np.add.reduceat(xs[o] * xs[o], first)
                state[o][mine] += np.float32(self.p.rate * GRAIN) * slope / (np.float32(0.25 * GRAIN**2) * curve + 16)
            state[-1][mine] += np.float32(self.p.refine) * np.add.reduceat(err, first) / (0.25 * many + 16)
        return out

    def fit(self, texts: list[bytes]) -> Model:
        """Starting weights and refining table from texts at hand."""
        b = pa.RecordBatch.from_arrays([pa.array([t.decode("utf-8", "surrogatepass") for t in texts], pa.string())], ["text"])
        levels = LEVEL[self.odds.astype(np.int16) + 128]
        return self.fit_counts(count_levels([b], self.trees, levels | levels << 4, self.p.bits))

    def fit_counts(self, counts: np.ndarray) -> Model:
        """Starting weights and refining table from the counts of all training decisions by count_levels(): Newton
        steps from the plain weights, which have the weight of few decisions."""
        counts = counts.reshape(256, 2, -1)
        node, cell = np.nonzero(counts.any(axis=1))
        zeros, ones = (counts[node, k, cell].astype(np.float64) for k in (0, 1))
        every = zeros + ones
        edges = np.concatenate([[-100], LEVELS, [100]])
        value = (edges[:-1] + edges[1:] - 1) / 2 * GRAIN
        x = [value[cell >> (4 * o) & 15] for o in range(len(ORDERS))]
        chance = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        start, w = self.weights.astype(np.float64), self.weights.astype(np.float64)
        for _ in range(12):
            p = chance(sum(w[o][node] * x[o] for o in range(len(ORDERS))))
            err, curve = ones - every * p, every * p * (1 - p)
            slope = np.array([np.bincount(node, err * x[o], 256) for o in range(len(ORDERS))]) - 20 * (w - start)
            bend = np.array([[np.bincount(node, curve * x[o] * x[q], 256) for q in range(len(ORDERS))] for o in range(len(ORDERS))])
            step = np.linalg.solve(bend.transpose(2, 0, 1) + 20 * np.eye(len(ORDERS)), slope.T[:, :, None])[:, :, 0].T
            w += np.clip(step, -0.3, 0.3)
        self.weights = w.astype(np.float32)
        z = sum(w[o][node] * x[o] for o in range(len(ORDERS)))
        at = node * (CELLS + 1) + np.clip(np.rint((z + 12) * (CELLS / 24)), 0, CELLS).astype(np.int64)
        middle = self.refined.ravel().astype(np.float64)
        refined = middle.copy()
        for _ in range(12):
            p = chance(0.5 * z + 0.5 * refined[at])
            slope = 0.5 * np.bincount(at, ones - every * p, len(middle)) - (refined - middle)
            bend = 0.25 * np.bincount(at, every * p * (1 - p), len(middle)) + 1
            refined += np.clip(slope / bend, -0.5, 0.5)
        self.refined = refined.reshape(256, -1).astype(np.float32)
        return self


def log_odds(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Of a 1, in GRAINs, drawn to 0 where there are few counts."""
    sure = (zeros + ones) / (zeros + ones + 1.5)
    return np.clip(np.rint(np.log((ones + 0.4) / (zeros + 0.4)) * sure / GRAIN), -120, 120).astype(np.int8)


def parts_of(texts: list[bytes], most: int) -> Iterator[tuple[int, int]]:
    """(from, to) runs of texts of about most bytes, or one text."""
    at = 0
    while at < len(texts):
        end, n = at + 1, len(texts[at])
        while end < len(texts) and n + len(texts[end]) <= most:
            n += len(texts[end])
            end += 1
        yield at, end
        at = end


def paged(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Counts in pages, without empty ones."""
    press, pages = zstandard.ZstdCompressor(level=1), total.reshape(-1, 2 * PAGE)
    for i in np.flatnonzero(pages.any(axis=1)).tolist():
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([press.compress(pages[i].tobytes())], pa.binary())], ["page", "counts"])


def _gather(trees: Trees, p: MixParams):
    """Each task's decision counts, in pages of PAGE slots of all orders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, one = np.zeros((len(ORDERS), 2 << p.bits), np.uint32), np.uint32(1)
        tree = trees.wide()
        slot = tree.node * 2 + tree.bit
        for laid, byte, leaf in _read(batches, tree, p.bits):
            own = slot.take(leaf)
            for o in range(len(ORDERS)):
                np.add.at(total[o], _slots(laid.ctx[o] * 2, byte, own, p.bits + 1), one)
        yield from paged(total)

    return run


def count_levels(batches: Iterator[pa.RecordBatch], trees: Trees, levels: np.ndarray, bits: int) -> np.ndarray:
    """How many decisions have each node, outcome and level of every order (4 bits each). levels: of each order's
    slots, that for decisions of 0 in the lower half of a byte, for those of 1 in the upper."""
    tree, total, one = trees.wide(), np.zeros(512 << 4 * len(ORDERS), np.uint32), np.uint32(1)
    base, half = (tree.node * 2 + tree.bit) << 4 * len(ORDERS), (tree.bit * 4).astype(np.uint8)
    for laid, byte, leaf in _read(batches, tree, bits):
        code, node, shift = base.take(leaf), tree.node.take(leaf), half.take(leaf)
        for o in range(len(ORDERS)):
            x = levels[o].take(_slots(laid.ctx[o], byte, node, bits))
            x >>= shift
            x &= np.uint8(15)
            code += x.astype(np.intp) << 4 * o
        np.add.at(total, code, one)
    return total


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """Pages in order, several of each, to each page's sums; one page is held at a time."""
    opener, at, total = zstandard.ZstdDecompressor(), None, None
    for b in batches:
        for page, counts in zip(b.column("page").to_pylist(), b.column("counts"), strict=True):
            if page != at:
                if at is not None:
                    yield at, total
                at, total = page, np.zeros(2 * PAGE)
            total += np.frombuffer(opener.decompress(counts.as_buffer()), np.uint32)
    if at is not None:
        yield at, total


def _add_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages in order to each page's log-odds, and their levels without one decision of 0, and of 1."""
    for page, total in _sums(batches):
        zeros, ones = total.reshape(-1, 2).T
        low, high = (LEVEL[log_odds(np.maximum(zeros - k, 0), np.maximum(ones - 1 + k, 0)).astype(np.int16) + 128] for k in (1, 0))
        cols = [pa.array([x.tobytes()], pa.binary()) for x in (log_odds(zeros, ones), low | high << 4)]
        yield pa.RecordBatch.from_arrays([pa.array([page], pa.int32()), *cols], ["page", "odds", "levels"])


def _sum_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=1)
    for page, total in _sums(batches):
        yield pa.RecordBatch.from_arrays([pa.array([page], pa.int32()), pa.array([press.compress(total.tobytes())], pa.binary())], ["page", "counts"])


def train(texts: DataFrame, pairs: np.ndarray, p: MixParams = MixParams()) -> Model:
    """The model of a table of training texts (column text) with its byte pair counts. Counts come from
    all of it, and so do the mixer's starting weights; the driver gets the tables of log-odds and their levels,
    len(ORDERS) x 2^bits bytes each, and 2^21 counts at most."""
    rows, spark = texts.select("text"), texts.sparkSession
    parts, trees = int(spark.conf.get("spark.sql.shuffle.partitions")), Trees.of(pairs)
    by_page = lambda run: rows.mapInArrow(run, "page int, counts binary").repartition(parts, "page").sortWithinPartitions("page")
    odds = np.zeros((len(ORDERS) << p.bits) // PAGE * PAGE, np.int8).reshape(-1, PAGE)
    levels = np.full(odds.shape, LEVEL[128] * 17, np.uint8)
    for r in store(by_page(_gather(trees, p)).mapInArrow(_add_pages, "page int, odds binary, levels binary"), "odds").toLocalIterator():
        odds[r["page"]] = np.frombuffer(r["odds"], np.int8)
        levels[r["page"]] = np.frombuffer(r["levels"], np.uint8)
    shared = spark.sparkContext.broadcast((trees, levels.reshape(len(ORDERS), -1)))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from paged(count_levels(batches, *shared.value, p.bits))

    counts = np.zeros(512 << 4 * len(ORDERS), np.int64).reshape(-1, 2 * PAGE)
    for r in store(by_page(counted).mapInArrow(_sum_pages, "page int, counts binary"), "levels").toLocalIterator():
        counts[r["page"]] = np.frombuffer(zstandard.ZstdDecompressor().decompress(r["counts"]), np.float64)
    shared.destroy()
    return Model.of(pairs, odds.reshape(len(ORDERS), -1), p).fit_counts(counts)


LISTED = "chunk long, bucket int, hashes binary, trained binary, dkeys array<long>, doc_ids array<long>, held array<boolean>, sizes array<long>, at binary, pairs array<int>, pair_counts array<long>"
LISTED_ARROW = pa.schema([
    ("chunk", pa.int64()), ("bucket", pa.int32()), ("hashes", pa.binary()), ("trained", pa.binary()), ("dkeys", pa.list_(pa.int64())), ("doc_ids", pa.list_(pa.int64())),
    ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())), ("at", pa.binary()), ("pairs", pa.list_(pa.int32())), ("pair_counts", pa.list_(pa.int64())),
])


def packed(x: np.ndarray) -> bytes:
    """Whole numbers below 2^32, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(x.astype(np.uint32).tobytes())


def unpacked(x: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint32)


def _list_tokens(buckets: int, p: MixParams):
    """Documents (dkey, doc_id, held_out, text) to rows by chunk: for each bucket, the ascending hashes of the
    chunk's distinct words and their counts in texts that are learned from; and one row (bucket null) with
    the documents, the places of all their words among the hashes, and the byte pairs learned from."""
    from pyspark import TaskContext

    def listed(chunk: int, docs: list[tuple]) -> Iterator[pa.RecordBatch]:
        words = [word_hashes(data) for *_, data in docs]
        size = np.array([len(w) for w in words], np.int64)
        learned = np.array([not held for _, _, held, _ in docs], bool)
        hashes, at = np.unique(np.concatenate([np.empty(0, np.uint64), *words]), return_inverse=True)
        trained = np.bincount(at[np.repeat(learned, size)], minlength=len(hashes))
        cut = np.searchsorted(bucket_of(hashes, buckets), np.arange(buckets + 1))
        full = np.flatnonzero(np.diff(cut)).tolist()
        none = lambda i, n: pa.nulls(n, LISTED_ARROW.types[i])
        for i in range(0, len(full), 256):
            part = [(cut[k], cut[k + 1]) for k in full[i : i + 256]]
            cols = [pa.array([chunk] * len(part), pa.int64()), pa.array(full[i : i + 256], pa.int32()), pa.array([hashes[x:y].tobytes() for x, y in part], pa.binary()), pa.array([packed(trained[x:y]) for x, y in part], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols + [none(c, len(part)) for c in range(4, 11)], schema=LISTED_ARROW)
        pairs = np.zeros(65536, np.int64)
        for i, j in parts_of([data for *_, data in docs], 1_000_000):
            d = np.frombuffer(b"".join(LEAD + data + LEAD for _, _, held, data in docs[i:j] if not held), np.uint8).astype(np.int32)
            pairs += np.bincount(d[:-1] * 256 + d[1:], minlength=65536)
        met = np.flatnonzero(pairs)
        row = {"chunk": chunk, "dkeys": [d[0] for d in docs], "doc_ids": [d[1] for d in docs], "held": [d[2] for d in docs], "sizes": size.tolist(), "at": packed(at), "pairs": met.tolist(), "pair_counts": pairs[met].tolist()}
        yield pa.RecordBatch.from_pylist([row], LISTED_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, docs, size = TaskContext.get().partitionId() << 32, [], 0
        for b in sliced(batches):
            for dkey, doc_id, held, t in zip(*(b.column(c).to_pylist() for c in ("dkey", "doc_id", "held_out", "text")), strict=True):
                docs.append((dkey, doc_id, held, text_bytes(t)))
                size += len(docs[-1][-1])
                if size >= p.block:
                    yield from listed(chunk, docs)
                    chunk, docs, size = chunk + 1, [], 0
        if docs:
            yield from listed(chunk, docs)

    return run


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Follows the order of the hashes."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def _add_up(t: pa.Table) -> pa.Table:
    """A bucket's lists from all chunks to the corpus counts of the hashes in each, with the bucket's sums once."""
    chunks, lists = t.column("chunk").to_pylist(), [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("hashes")]
    every = np.concatenate(lists)
    distinct, at = np.unique(every, return_inverse=True)
    trained = np.concatenate([unpacked(x.as_buffer()) for x in t.column("trained")])
    count = np.bincount(at, trained, len(distinct)).astype(np.int64)
    stops = np.cumsum([len(x) for x in lists])
    replies = [zstandard.ZstdCompressor(level=1).compress(count[at[stop - len(x) : stop]].tobytes()) for x, stop in zip(lists, stops, strict=True)]
    once = [1] + [0] * (len(chunks) - 1)
    return pa.table({
        "chunk": pa.array(chunks, pa.int64()), "bucket": t.column("bucket").cast(pa.int32()), "counts": pa.array(replies, pa.binary()),
        "total": pa.array([int(count.sum()) * k for k in once], pa.int64()), "distinct": pa.array([int((count > 0).sum()) * k for k in once], pa.int64()),
    })


BASE = "dkey long, doc_id long, held_out boolean, n_tokens long, n_known long, logs double"


def _base(ends: int):
    """A chunk's documents and the answers to its lists to a row for each document; ends: texts learned from."""

    def run(t: pa.Table) -> pa.Table:
        order = sorted((bucket, k) for k, bucket in enumerate(t.column("bucket").to_pylist()) if bucket is not None)
        docs = next(r for r in t.select(["bucket", "dkeys", "doc_ids", "held", "sizes", "at"]).to_pylist() if r["bucket"] is None)
        opener = zstandard.ZstdDecompressor()
        count = np.concatenate([np.empty(0, np.int64)] + [np.frombuffer(opener.decompress(t.column("counts")[k].as_buffer()), np.int64) for _, k in order])
        at, size = unpacked(docs["at"]), np.array(docs["sizes"], np.int64)
        before = np.concatenate([[0], np.cumsum(size)])
        logs = np.concatenate([[0], np.cumsum(np.log10(count + 0.5)[at])])
        known = np.concatenate([[0], np.cumsum(count[at] > 0)])
        per = lambda x: x[before[1:]] - x[before[:-1]]
        return pa.table({
            "dkey": pa.array(docs["dkeys"], pa.int64()), "doc_id": pa.array(docs["doc_ids"], pa.int64()), "held_out": pa.array(docs["held"], pa.bool_()), "n_tokens": pa.array(size + 1, pa.int64()),
            "n_known": pa.array(per(known) + (ends > 0), pa.int64()), "logs": pa.array(per(logs) + math.log10(ends + 0.5), pa.float64()),
        })

    return run


def score(docs: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """A row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    bits_per_byte (null for an empty text).

    Documents with crc32(doc_id as text) mod 5 other than 1 are learned from; a null doc_id has no crc32
    and is held out. Null text is empty: one token, its end. Repeated rows are learned from, and scored,
    each by itself. Other columns are ignored. An empty table gives no rows. Tokens are told apart by
    64-bit hashes.
    """
    spark = docs.sparkSession
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(True))
    base = docs.select(F.xxhash64("doc_id", "text").alias("dkey"), "doc_id", held.alias("held_out"), "text")
    learned = F.when(~F.col("held_out"), 1)
    whole = base.agg(F.sum(F.octet_length("text")).alias("all"), F.sum(learned * F.octet_length("text")).alias("train"), F.count(learned).alias("ends")).first()
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(whole["all"] or 0) // p.bucket))
    p, ends = p.grown(whole["train"] or 0), int(whole["ends"])
    listed = store(base.mapInArrow(_list_tokens(buckets, p), LISTED), "tokens")
    pairs = np.zeros(65536, np.int64)
    met = listed.where("bucket is null").select(F.explode(F.arrays_zip("pairs", "pair_counts")).alias("x"))
    for r in met.groupBy("x.pairs").agg(F.sum("x.pair_counts").alias("n")).collect():  # 65,536 rows at most
        pairs[r["pairs"]] = r["n"]
    lists = listed.where("bucket is not null").select("chunk", "bucket", "hashes", "trained")
    answers = store(lists.groupBy("bucket").applyInArrow(_add_up, "chunk long, bucket int, counts binary, total long, distinct long"), "answers")
    sums = answers.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n"), F.coalesce(F.sum("distinct"), F.lit(0)).alias("v")).first()
    total, vocabulary = int(sums["n"]) + ends, int(sums["v"]) + (ends > 0)
    chunks = listed.where("bucket is null").select("chunk", "bucket", "dkeys", "doc_ids", "held", "sizes", "at")
    rows = chunks.unionByName(answers.select("chunk", "bucket", "counts"), allowMissingColumns=True)
    scored = store(rows.groupBy("chunk").applyInArrow(_base(ends), BASE), "base-scores")

    shared = spark.sparkContext.broadcast(train(base.where("not held_out"), pairs.reshape(256, 256), p))

    def mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in sliced(batches):
            data = [text_bytes(t) for t in b.column("text").to_pylist()]
            order, out = sorted(range(len(data)), key=lambda k: len(data[k])), np.zeros(len(data))
            for i, k in parts_of([data[x] for x in order], WINDOW):
                out[order[i:k]] = m.bits_of([data[x] for x in order[i:k]])
            per = [x / len(d) if d else None for x, d in zip(out.tolist(), data, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("dkey"), pa.array(-out * math.log10(2), pa.float64()), pa.array(per, pa.float64())], ["dkey", "score", "bits_per_byte"])

    bits = store(base.select("dkey", "text").mapInArrow(mixed, "dkey long, score double, bits_per_byte double"), "mixed-scores")
    bits = bits.groupBy("dkey").agg(F.first("score").alias("score"), F.first("bits_per_byte").alias("bits_per_byte"))
    spread = F.col("logs") - F.col("n_tokens") * math.log10(total + 0.5 * (vocabulary + 1))
    out = scored.join(bits, "dkey")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), spread.alias("base_score"), "score", "bits_per_byte")
