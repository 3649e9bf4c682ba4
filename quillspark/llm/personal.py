"""Personal data: fixed formats, and a character-level bidirectional LSTM with CRF transitions.

The network is trained in numpy from labelled spans (those of the fixed formats in a bounded sample, each
also in disguise: an address with "(at)", a number with other marks) and decodes every stretch of text
that can hold a span. A span must hold a digit, an @ sign or a written-out "at" with a "dot" or brackets,
so the stretches are all text within reach of one: elsewhere the only admissible path is "no span".
Long stretches are cut into overlapping windows. Their emissions are blended, each window's weight
falling towards its edges, and one Viterbi pass over the whole stretch reconciles them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, store

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
ZONE = re.compile(r"[0-9][0-9 .-]*")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: What a span of any kind must hold.
ANCHOR = re.compile(r"[0-9@]+|[\[({<] ?(?i:at) ?[\])}>]|\b(?i:at) (?=[A-Za-z0-9-]{1,63}(?: (?i:dot) ?| ?[\[({<] ?(?i:dot)))")
AT = re.compile(r"@|[\[({<] ?at ?[\])}>]|\bat\b", re.IGNORECASE)
DOT = re.compile(r"\.|\bdot\b", re.IGNORECASE)
WINDOW, STRIDE = 96, 48
CLASSES = {c: i for i, c in enumerate("@.-_+()%/: \n[]{}<>aAtTdDoO")}
N_CLASSES = len(CLASSES) + 6
N_LABELS = 1 + 2 * len(KINDS)


@dataclass(frozen=True)
class PersonalParams:
    """samples: stretches with, and as many without, labelled spans that are fitted at most; longest: their
    length at most. reach: characters on either side of an anchor that are decoded. likely: the tagger's
    log-odds per character, against no span, from which a decoded span counts."""

    samples: int = 300
    longest: int = 400
    reach: int = 64
    hidden: int = 16
    epochs: int = 16
    rate: float = 0.02
    likely: float = 0.0
    seed: int = 11


#: Ways to write a span of each kind that the fixed formats do not know.
DISGUISES = (
    (
        lambda v: v.replace("@", " (at) "), lambda v: v.replace("@", " [at] "), lambda v: v.replace("@", " at ").replace(".", " dot "),
        lambda v: v.replace("@", "(at)").replace(".", "(dot)"), lambda v: v.replace("@", " AT ").replace(".", " DOT "), lambda v: v.replace("@", "@ "), lambda v: v.replace("@", " @ "),
    ),
    (lambda v: v.replace(".", " . "), lambda v: v.replace(".", "[.]"), lambda v: v.replace(".", "(.)"), lambda v: v.replace(".", ". ")),
    (lambda v: "/".join(plain(v, 4)), lambda v: ".".join(plain(v, 4)), lambda v: " - ".join(plain(v, 4)), lambda v: "  ".join(plain(v, 4))),
    (lambda v: v[1:], lambda v: "00" + v[1:], lambda v: v[1:].replace(" ", "-"), lambda v: v[1:].replace(" ", "."), lambda v: "(" + v[1:].replace(" ", ") ", 1), lambda v: "+ " + v[1:].replace(" ", "/")),
)


def plain(number: str, size: int) -> list[str]:
    digits = "".join(c for c in number if c.isdigit())
    return [digits[i : i + size] for i in range(0, len(digits), size)]


def disguise(text: str, spans: list[tuple[int, int, int]], rng: np.random.Generator, forms=DISGUISES) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with each of its spans written in another way, and where they then are."""
    out, found, at = "", [], 0
    for s, k, e in sorted(spans):
        if s >= at:
            v = forms[k][int(rng.integers(len(forms[k])))](text[s:e])
            out += text[at:s]
            found.append((len(out), k, len(out) + len(v)))
            out, at = out + v, e
    return out + text[at:], found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed formats by start, then kind. Linear in the text.

    Every format is found from a character it must hold: emails from their @, numbers inside runs of
    digits and separators, phones from their +.
    """
    out = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, 0, m.end()))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", at + 1)
    for zone in ZONE.finditer(text):
        s, z = zone.start(), zone.group()
        if len(z) >= 7:
            out += [(s + m.start(), 1, s + m.end()) for m in IP.finditer(z) if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m.group().split("."))]
        if len(z) >= 12:
            for m in CARD.finditer(z):
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((s + m.start(), 2, s + m.end()))
    at = text.find("+")
    while at >= 0:
        m = PHONE.match(text, at)
        if m and 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((at, 3, m.end()))
        at = text.find("+", m.end() if m else at + 1)
    return sorted(out)


def stretches(text: str, reach: int = 64) -> list[tuple[int, int]]:
    """Merged (start, end) within reach of an anchor."""
    out: list[list[int]] = []
    for m in ANCHOR.finditer(text):
        s, e = max(0, m.start() - reach), min(len(text), m.end() + reach)
        if out and s <= out[-1][1]:
            out[-1][1] = e
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def classes(text: str) -> np.ndarray:
    k = len(CLASSES)
    cls = lambda c: CLASSES[c] if c in CLASSES else k if "0" <= c <= "9" else k + 1 if "a" <= c <= "z" else k + 2 if "A" <= c <= "Z" else k + 3 if c > "\x7f" else k + 4
    return np.fromiter(map(cls, text), np.int64, len(text))


def labels(length: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    y = np.zeros(length, np.int64)
    for s, k, e in spans:
        if not y[s:e].any():
            y[s] = 1 + 2 * k
            y[s + 1 : e] = 2 + 2 * k
    return y


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def admissible(kind: int, span: str) -> bool:
    """What a decoded span must be: one line, that starts and ends with a letter, digit, + or (, and holds an
    @ or "at" and a dot, four numbers of at most 255, 12 to 19 digits, or 9 to 15."""
    if "\n" in span or not span or not (span[0].isalnum() or span[0] in "+(") or not span[-1].isalnum():
        return False
    numbers = re.findall("[0-9]+", span)
    digits = sum(map(len, numbers))
    if kind == 0:
        return len(AT.findall(span)) == 1 and DOT.search(span, AT.search(span).end()) is not None
    if re.search("[A-Za-z]", span):
        return False
    if kind == 1:
        return len(numbers) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in numbers)
    return 12 <= digits <= 19 and luhn("".join(numbers)) if kind == 2 else 9 <= digits <= 15


class Tagger:
    """BiLSTM emissions and CRF transitions; all arrays are (batch, time, ...). Class N_CLASSES - 1 pads."""

    def __init__(self, p: PersonalParams):
        self.p, h = p, p.hidden
        rng = np.random.Generator(np.random.PCG64(p.seed))
        init = lambda *s: rng.standard_normal(s).astype(np.float32) * 0.3
        self.w = {f"{k}{d}": init(*s) for d in "fb" for k, s in (("x", (N_CLASSES, 4 * h)), ("h", (h, 4 * h)))}
        self.w |= {f"c{d}": np.zeros(4 * h, np.float32) for d in "fb"}
        self.w |= {"o": init(2 * h, N_LABELS), "bias": np.zeros(N_LABELS, np.float32), "t": np.zeros((N_LABELS, N_LABELS), np.float32)}
        self.allowed = np.zeros((N_LABELS, N_LABELS), np.float32)
        for k in range(len(KINDS)):  # an inside label follows its own kind alone
            self.allowed[[i for i in range(N_LABELS) if i not in (1 + 2 * k, 2 + 2 * k)], 2 + 2 * k] = -1e4

    def _lstm(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        n, length, h = len(x), x.shape[1], self.p.hidden
        hs, hid, cell = np.empty((n, length, h), np.float32), np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        for t in range(length) if d == "f" else reversed(range(length)):
            z = self.w["x" + d][x[:, t]] + hid @ self.w["h" + d] + self.w["c" + d]
            gates = _sigmoid(z[:, : 3 * h])
            g = np.tanh(z[:, 3 * h :])
            before, last = cell, hid
            cell = gates[:, :h] * before + gates[:, h : 2 * h] * g
            tc = np.tanh(cell)
            hid = gates[:, 2 * h :] * tc
            hs[:, t] = hid
            if keep is not None:
                keep.append((t, gates, g, before, tc, last))
        return hs

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._lstm(x, "f"), self._lstm(x, "b")], axis=2) @ self.w["o"] + self.w["bias"]

    def _gradient(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> dict[str, np.ndarray]:
        n, length, h = len(x), x.shape[1], self.p.hidden
        kf, kb = [], []
        hs = np.concatenate([self._lstm(x, "f", kf), self._lstm(x, "b", kb)], axis=2)
        e = (hs @ self.w["o"] + self.w["bias"]) * mask[:, :, None]
        trans = self.w["t"] + self.allowed
        lse = lambda a, axis: (m := a.max(axis=axis)) + np.log(np.exp(a - np.expand_dims(m, axis)).sum(axis=axis))
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        start = np.where(np.arange(N_LABELS) % 2 + (np.arange(N_LABELS) == 0) > 0, 0, -1e4)
        alpha[:, 0] = e[:, 0] + start
        for t in range(1, length):
            step = lse(alpha[:, t - 1, :, None] + trans, 1) + e[:, t]
            alpha[:, t] = np.where(mask[:, t, None] > 0, step, alpha[:, t - 1])
        for t in range(length - 2, -1, -1):
            step = lse(trans + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(mask[:, t + 1, None] > 0, step, beta[:, t + 1])
        z = lse(alpha[:, -1], 1)
        d_e = np.exp(alpha + beta - z[:, None, None])
        d_e[np.arange(n)[:, None], np.arange(length)[None, :], y] -= 1
        d_e *= mask[:, :, None] / n
        d_t = np.zeros_like(trans)
        for t in range(1, length):
            pair = np.exp(alpha[:, t - 1, :, None] + trans + (e[:, t] + beta[:, t])[:, None, :] - z[:, None, None]) * mask[:, t, None, None]
            d_t += pair.sum(axis=0)
            np.add.at(d_t, (y[:, t - 1], y[:, t]), -mask[:, t])
        grad = {"o": np.einsum("nth,ntl->hl", hs, d_e), "bias": d_e.sum(axis=(0, 1)), "t": d_t / n}
        d_hs = d_e @ self.w["o"].T
        for d, kept, part in (("f", kf, d_hs[:, :, :h]), ("b", kb, d_hs[:, :, h:])):
            gx, gh, gc = (np.zeros_like(self.w[k + d]) for k in "xhc")
            dh, dc = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
            for t, gates, g, before, tc, last in reversed(kept):
                dh = dh + part[:, t]
                forget, inp, out = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
                dc = dc + dh * out * (1 - tc * tc)
                dz = np.concatenate([dc * before * forget * (1 - forget), dc * g * inp * (1 - inp), dh * tc * out * (1 - out), dc * inp * (1 - g * g)], axis=1)
                np.add.at(gx, x[:, t], dz)
                gh += last.T @ dz
                gc += dz.sum(axis=0)
                dh, dc = dz @ self.w["h" + d].T, dc * forget
            grad |= {"x" + d: gx, "h" + d: gh, "c" + d: gc}
        return grad

    def fit(self, data: list[tuple[str, list[tuple[int, int, int]]]]) -> Tagger:
        """Adam over (text, spans) windows, in a fixed order."""
        if not data:
            return self
        length = max(len(t) for t, _ in data)
        x = np.full((len(data), length), N_CLASSES - 1)
        y, mask = np.zeros((len(data), length), np.int64), np.zeros((len(data), length), np.float32)
        for i, (t, spans) in enumerate(data):
            x[i, : len(t)], y[i, : len(t)], mask[i, : len(t)] = classes(t), labels(len(t), spans), 1
        rng = np.random.Generator(np.random.PCG64(self.p.seed))
        m, v, step = {k: np.zeros_like(a) for k, a in self.w.items()}, {k: np.zeros_like(a) for k, a in self.w.items()}, 0
        for _ in range(self.p.epochs):
            order = rng.permutation(len(data))
            for i in range(0, len(order), 48):
                b, step = order[i : i + 48], step + 1
                for k, g in self._gradient(x[b], y[b], mask[b]).items():
                    g = np.clip(g, -1, 1)
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.w[k] -= (self.p.rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def viterbi(self, e: np.ndarray) -> np.ndarray:
        """The best label path for (time, labels) emissions."""
        trans = self.w["t"] + self.allowed
        score, back = e[0] + np.where((np.arange(N_LABELS) % 2 == 1) | (np.arange(N_LABELS) == 0), 0, -1e4), np.zeros(e.shape, np.int64)
        for t in range(1, len(e)):
            step = score[:, None] + trans
            back[t] = step.argmax(axis=0)
            score = step.max(axis=0) + e[t]
        path = np.empty(len(e), np.int64)
        path[-1] = score.argmax()
        for t in range(len(e) - 1, 0, -1):
            path[t - 1] = back[t][path[t]]
        return path

    def decode(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """Spans of each stretch: windows of all stretches in batches, blended, then one path a stretch."""
        plain = [classes(t) for t in texts]
        places = [(i, s) for i, t in enumerate(texts) for s in range(0, max(1, len(t) - WINDOW + STRIDE), STRIDE)]
        ramp = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)[:, None]
        total, weight = [np.zeros((len(t), N_LABELS), np.float32) for t in texts], [np.zeros((len(t), 1), np.float32) for t in texts]
        for at in range(0, len(places), 512):
            part = places[at : at + 512]
            x = np.full((len(part), WINDOW), N_CLASSES - 1)
            for j, (i, s) in enumerate(part):
                x[j, : len(plain[i][s : s + WINDOW])] = plain[i][s : s + WINDOW]
            for (i, s), e in zip(part, self.emissions(x), strict=True):
                n = len(total[i][s : s + WINDOW])
                total[i][s : s + n] += e[:n] * ramp[:n]
                weight[i][s : s + n] += ramp[:n]
        out = []
        for t, e, w in zip(texts, total, weight, strict=True):
            e = e / w
            spans, path = [], self.viterbi(e)
            for j in np.flatnonzero(path % 2 == 1):
                k, end = (path[j] - 1) // 2, j + 1
                while end < len(path) and path[end] == 2 + 2 * k:
                    end += 1
                sure = (e[np.arange(j, end), path[j:end]] - e[j:end, 0]).mean()
                if sure >= self.p.likely and admissible(k, t[j:end]):
                    spans.append((int(j), int(k), int(end)))
            out.append(spans)
        return out


FOUND = "doc_id long, spans array<struct<s:int,k:int,e:int>>, parts array<struct<s:int,v:string>>"


def _find(reach: int):
    span = pa.list_(pa.struct([("s", pa.int32()), ("k", pa.int32()), ("e", pa.int32())]))
    part = pa.list_(pa.struct([("s", pa.int32()), ("v", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            spans, parts = [], []
            for t in b.column("text"):
                t = t.as_py() or ""
                spans.append([{"s": s, "k": k, "e": e} for s, k, e in base_spans(t)])
                parts.append([{"s": s, "v": t[s:e]} for s, e in stretches(t, reach)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(spans, span), pa.array(parts, part)], ["doc_id", "spans", "parts"])

    return run


def training_windows(found: DataFrame, p: PersonalParams) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Windows of stretches with and without labelled spans: those with the least hashes, p.samples of each;
    then those with spans again, in disguise. Unlabelled stretches that could hold a span, by their digits or
    an "at" in brackets, teach nothing."""
    rows = found.select("spans", F.explode("parts").alias("part"))
    inside = F.filter("spans", lambda x: (x["s"] >= F.col("part.s")) & (x["e"] <= F.col("part.s") + F.length("part.v")))
    rows = rows.select(F.transform(inside, lambda x: F.struct((x["s"] - F.col("part.s")).alias("s"), x["k"].alias("k"), (x["e"] - F.col("part.s")).alias("e"))).alias("spans"), F.col("part.v").alias("v"))
    rows, out = rows.where(F.length("v") <= p.longest), []
    unsure = (F.regexp_count("v", F.lit("[0-9]")) >= 9) | F.col("v").rlike(r"(?i)@|[\[({<] ?at ?[\])}>]")
    for test in (F.size("spans") > 0, (F.size("spans") == 0) & ~unsure):
        for r in rows.where(test).distinct().orderBy(F.xxhash64("v"), "v").limit(p.samples).collect():
            v = r["v"]
            for s in range(0, max(1, len(v) - WINDOW + STRIDE), STRIDE):
                own = [(x["s"] - s, x["k"], x["e"] - s) for x in r["spans"] if x["s"] >= s and x["e"] <= min(s + WINDOW, len(v))]
                cut = [x for x in r["spans"] if x["s"] < min(s + WINDOW, len(v)) and x["e"] > s and (x["s"] - s, x["k"], x["e"] - s) not in own]
                if not cut:
                    out.append((v[s : s + WINDOW], own))
    return disguised(out, p)


def disguised(data: list[tuple[str, list[tuple[int, int, int]]]], p: PersonalParams, forms=DISGUISES) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """The windows, and after them those with spans again, in disguise."""
    rng = np.random.Generator(np.random.PCG64(p.seed))
    return data + [disguise(t, spans, rng, forms) for t, spans in data if spans]


OUT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_added long, n_spans long, base_sha256 string, spans string"


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, p: PersonalParams = PersonalParams()) -> DataFrame:
    """A row for each document: doc_id, n_email, n_ip, n_card, n_phone, n_added, n_spans (the sum of these five),
    base_sha256, spans.

    Spans that the tagger decodes are added if they touch none of the fixed formats' spans. Null and
    empty texts have no spans. Repeated rows give repeated results. Other columns are ignored. An empty
    table gives no rows. Without any labelled span nothing is trained, and the fixed formats remain.
    """
    found = store(docs.select("doc_id", "text").mapInArrow(_find(p.reach), FOUND), "personal")
    data = training_windows(found, p)
    tagger = Tagger(p).fit(data) if any(s for _, s in data) else None

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            rows = []
            ids, spans, parts = (b.column(i).to_pylist() for i in range(3))
            flat = [x["v"] for row in parts for x in row] if tagger else []
            decoded = iter(tagger.decode(flat)) if flat else iter(())
            for doc_id, own, part in zip(ids, spans, parts, strict=True):
                base = sorted((x["s"], x["k"], x["e"]) for x in own)
                more = [(x["s"] + s, k, x["s"] + e) for x in part for s, k, e in (next(decoded) if tagger else ())]
                more = [m for m in more if not any(s < m[2] and m[0] < e for s, _, e in base)]
                n = [sum(k == i for _, k, _ in base) for i in range(4)]
                rows.append((doc_id, *n, len(more), len(base) + len(more), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(sorted(base + more))))
            cols = list(zip(*rows, strict=True)) or [[]] * 9
            types = [pa.int64()] * 7 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [x.split()[0] for x in OUT.split(", ")])

    return found.mapInArrow(decode, OUT)
