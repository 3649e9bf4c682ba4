"""Secret scanning: fixed formats, and formats learned from labelled credentials by grammar inference.

Labelled credentials (values that the fixed formats find) of each kind form a prefix tree with counts.
States whose outgoing frequencies are statistically compatible (Hoeffding bound, recursively) are
merged, which gives a probabilistic automaton. Every other token in the text that is long enough and
holds a digit is a candidate: it is scored by its likelihood under each automaton against that under an
automaton of ordinary tokens. Automata read classes of characters, so they know a format, not its values.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, store

KINDS = ("assign", "access", "hex", "learned")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_HINTS = (b"password", b"passwd", b"secret", b"token", b"api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]+(?:\.[A-Za-z0-9+/_=-]+)*")
DIGIT = re.compile("[0-9]")


@dataclass(frozen=True)
class SecretParams:
    """least: characters of a candidate, at least; shorter ones, and those without a digit, are left to the
    fixed formats. alpha: of the merge test. samples: labelled values of each kind, and ordinary tokens,
    that are fitted at most, those with the least hashes, of at most longest characters; everything is
    scored. margin: natural-log likelihood ratio per character from which a candidate counts. min_count:
    visits below which a state is compatible with any."""

    least: int = 12
    alpha: float = 0.05
    samples: int = 2000
    longest: int = 200
    margin: float = 0.15
    min_count: int = 4
    end: str = "\x00"


def base_spans(text: str, least: int = 12) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """(start, kind number, end) of the fixed formats by start and kind; (start, end) of other candidates.

    Formats and candidates have no white space, so only words that are long enough are looked into.
    Offsets are code points.
    """
    out, candidates = [], []
    low = text.encode("utf-8", "surrogatepass").lower()
    if any(h in low for h in ASSIGN_HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    at = 0
    for word in text.split():
        if len(word) < min(least, 20):
            continue
        if len(word) >= 24 or DIGIT.search(word) or "AKIA" in word:
            at = text.index(word, at)
            out += [(at + m.start(), 1, at + m.end()) for m in ACCESS.finditer(word) if m.end() - m.start() >= 20]
            out += [(at + m.start(), 2, at + m.end()) for m in HEX.finditer(word)]
            candidates += [(at + m.start(), at + m.end()) for m in RUN.finditer(word) if m.end() - m.start() >= least and DIGIT.search(m.group())]
            at += len(word)
    return sorted(out), [c for c in candidates if not any(s < c[1] and c[0] < e for s, _, e in out)]


#: Classes of characters that the automata read; a mark is a class of its own.
SYMBOLS = {c: k for k, chars in (("d", "0123456789"), ("h", "abcdef"), ("l", "ghijklmnopqrstuvwxyz"), ("H", "ABCDEF"), ("U", "GHIJKLMNOPQRSTUVWXYZ")) for c in chars}


def symbols(value: str) -> list[str]:
    return [SYMBOLS.get(c, c) for c in value]


class Automaton:
    """A probabilistic automaton inferred from values by merging compatible prefix-tree states."""

    def __init__(self, values: list[str], p: SecretParams):
        self.p = p
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [defaultdict(int)]
        for v in values:
            at = 0
            for c in symbols(v):
                self.count[at][c] += 1
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.count.append(defaultdict(int))
                at = self.next[at][c]
            self.count[at][p.end] += 1
        self._merge_all()
        self.total = [sum(c.values()) for c in self.count]

    def _differ(self, a: int, b: int) -> bool:
        """Whether the two states' frequencies, here or further on, are too far apart."""
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            n, m = sum(self.count[x].values()), sum(self.count[y].values())
            if n < self.p.min_count or m < self.p.min_count:
                continue
            bound = math.sqrt(0.5 * math.log(2 / self.p.alpha)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if any(abs(self.count[x].get(c, 0) / n - self.count[y].get(c, 0) / m) > bound for c in self.count[x].keys() | self.count[y].keys()):
                return True
            todo += [(self.next[x][c], self.next[y][c]) for c in self.next[x].keys() & self.next[y].keys() if self.next[x][c] != self.next[y][c]]
        return False

    def _fold(self, into: int, tree: int) -> None:
        """Add a subtree's counts to a state and those it leads to."""
        todo = [(into, tree)]
        while todo:
            x, y = todo.pop()
            for c, n in self.count[y].items():
                self.count[x][c] += n
            for c, child in self.next[y].items():
                if c in self.next[x]:
                    todo.append((self.next[x][c], child))
                else:
                    self.next[x][c] = child

    def _merge_all(self) -> None:
        kept, seen = [0], {0}
        edge = [(0, c) for c in self.next[0]]
        while edge:
            edge.sort(key=lambda e: (-self.count[e[0]][e[1]], e))
            at, c = edge.pop(0)
            child = self.next[at].get(c)
            if child is None or child in seen:
                continue
            twin = next((k for k in kept if not self._differ(k, child)), None)
            if twin is None:
                kept.append(child)
                seen.add(child)
                edge += [(child, d) for d in self.next[child]]
            else:
                self.next[at][c] = twin
                self._fold(twin, child)
                edge += [(k, d) for k in kept for d, to in self.next[k].items() if to not in seen and (k, d) not in edge]

    def log_likelihood(self, value: str) -> float:
        """Natural log of the value's smoothed probability."""
        at, out = 0, 0.0
        for c in [*symbols(value), self.p.end]:
            if at is None:
                out -= math.log(20.0)
                continue
            n = self.count[at].get(c, 0)
            out += math.log((n + 0.1) / (self.total[at] + 0.1 * 12))
            at = self.next[at].get(c) if n else None
        return out


def fit(labelled: dict[str, list[str]], ordinary: list[str], p: SecretParams = SecretParams()) -> dict[str, Automaton]:
    return {k: Automaton(sorted(v), p) for k, v in [*sorted(labelled.items()), ("", ordinary)] if v or not k}


def score(value: str, model: dict[str, Automaton]) -> float:
    """Log-likelihood ratio per character of the best credential automaton against ordinary tokens."""
    best = max((a.log_likelihood(value) for k, a in model.items() if k), default=-math.inf)
    return (best - model[""].log_likelihood(value)) / (len(value) + 1)


FOUND = "doc_id long, spans array<struct<s:int,k:int,e:int,v:string>>, candidates array<struct<s:int,e:int,v:string>>"


def _find(least: int):
    span = pa.list_(pa.struct([("s", pa.int32()), ("k", pa.int32()), ("e", pa.int32()), ("v", pa.string())]))
    other = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("v", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            spans, candidates = [], []
            for t in b.column("text"):
                t = t.as_py() or ""
                found, rest = base_spans(t, least)
                spans.append([{"s": s, "k": k, "e": e, "v": ASSIGN.match(t, s).group(2) if k == 0 else t[s:e]} for s, k, e in found])
                candidates.append([{"s": s, "e": e, "v": t[s:e]} for s, e in rest])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(spans, span), pa.array(candidates, other)], ["doc_id", "spans", "candidates"])

    return run


def _least(rows: DataFrame, n: int) -> list:
    """The n distinct (k, v) with the least hashes: a bounded sample, the same for any partitioning."""
    return rows.distinct().orderBy(F.xxhash64("k", "v"), "k", "v").limit(n).collect()


OUT = "doc_id long, n_assign long, n_access long, n_hex long, n_learned long, base_sha256 string, spans string"


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, p: SecretParams = SecretParams()) -> DataFrame:
    """A row for each document: doc_id, n_assign, n_access, n_hex, n_learned, base_sha256, spans.

    Null and empty texts have no spans (the digest of an empty string). Repeated rows give repeated
    results. Other columns are ignored. An empty table gives no rows. Without labelled credentials
    nothing is learned, and the fixed formats remain.
    """
    found = store(docs.select("doc_id", "text").mapInArrow(_find(p.least), FOUND), "secrets")
    labelled = found.select(F.explode("spans").alias("x")).select("x.k", "x.v").where(F.length("v") <= p.longest)
    groups = {KINDS[k]: [r["v"] for r in _least(labelled.where(F.col("k") == k), p.samples)] for k in range(3)}
    ordinary = found.select(F.explode("candidates").alias("x")).select(F.lit(3).alias("k"), "x.v").where(F.length("v") <= p.longest)
    model = fit({k: v for k, v in groups.items() if v}, [r["v"] for r in _least(ordinary, p.samples)], p)
    margin = p.margin

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
            rows = []
            for doc_id, spans, candidates in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                base = sorted((x["s"], x["k"], x["e"]) for x in spans)
                more = [(x["s"], 3, x["e"]) for x in candidates if len(model) > 1 and score(x["v"], model) >= margin]
                n = [sum(k == i for _, k, _ in base) for i in range(3)]
                rows.append((doc_id, *n, len(more), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(sorted(base + more))))
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            types = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [x.split()[0] for x in OUT.split(", ")])

    return found.mapInArrow(rate, OUT)
