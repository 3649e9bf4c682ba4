"""Token ids in a content-addressed store.

Files, all Parquet, in one folder:
    packs/     (pack, doc_id, seq, n_tokens, chunks, owned, root): documents in ascending doc_id order.
               chunks lists the digests of the document's chunks (its recipe); owned holds the ids of those
               chunks that are stored here: of each distinct chunk, the first document in order stores it,
               and notes whether others share it.
    manifest/  (pack, n_docs, n_tokens, root): the Merkle root over a pack's documents.
A document's ids are cut where a rolling hash over the last ids says so, hence equal passages give equal
chunks wherever they start. A chunk's digest addresses it. A document's root is the Merkle root of its
chunks' digests. Reading fetches chunks that other documents own by a join on their digests, rebuilds
the ids, and verifies chunk digests and roots.
"""

from __future__ import annotations

import codecs
import hashlib
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, new_path, sliced, store

#: Bytes of text, about, whose distinct pieces are encoded together.
PART = 8_000_000
#: Ids that are hashed together.
BLOCK = 1 << 15
#: Distinct pieces, and distinct words of pieces, whose ids a worker remembers, about.
REMEMBERED = 300_000
REMEMBERED_WORDS = 800_000
#: Pieces that go to the library as one text.
JOINED = 50
#: Characters that make a token run of their own after a word.
MARKS = ".,;:!?)%$&*#|"
#: Letters below U+0250.
LATIN = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
#: White space as the library and Python see it.
BLANK = "[\\t-\\r\\x1c-\\x20\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Stand in words for the space before a word, and for the begin of a word without one; neither is in LATIN or MARKS.
SPACED, BARE = "_", "~"


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself, or the next
    one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


@dataclass(frozen=True)
class StoreParams:
    """window: ids under the rolling hash. least, mean, most: chunk lengths in ids; least is at least window,
    mean a power of two. end: the id that ends a document. packs: of the order, at least; 0 for one for
    each shuffle partition. pack_ids, pack_docs: a pack's ids and documents, about; more make more packs."""

    window: int = 8
    least: int = 32
    mean: int = 256
    most: int = 2048
    end: int = 0
    packs: int = 0
    pack_ids: int = 64_000_000
    pack_docs: int = 1_000_000


class Pool:
    """Ids of pieces, words and texts, one after another; first and size: where each begins, and its length.
    known: the strings that are remembered, which come first."""

    def __init__(self):
        self.ids, self.first, self.size = np.empty(0, np.uint32), np.empty(0, np.int32), np.empty(0, np.int32)
        self.known = pa.array([], pa.string())

    def find(self, strings: pa.Array) -> np.ndarray:
        """Places of distinct strings, -1 for those not known. The given ones are hashed, as they are fewer than the known."""
        out, met = np.full(len(strings), -1, np.int32), pc.index_in(self.known, value_set=strings)
        out[met.drop_null().to_numpy()] = np.flatnonzero(met.is_valid().to_numpy(zero_copy_only=False))
        return out

    def gathered(self, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids at places, one after another, and the number of ids before each place and after the last."""
        size = self.size[seq]
        before = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat((self.first[seq] - before[:-1]).astype(np.int32), size)
        at += np.arange(before[-1], dtype=np.int32)
        return self.ids[at], before

    def keep(self, ids: np.ndarray, size: np.ndarray, skip: np.ndarray | int = 0) -> np.ndarray:
        """Add runs of ids, each without its first skip; gives their places."""
        at = np.arange(len(self.first), len(self.first) + len(size), dtype=np.int32)
        self.first = np.concatenate([self.first, (len(self.ids) + np.cumsum(size) - size + skip).astype(np.int32)])
        self.size, self.ids = np.concatenate([self.size, (size - skip).astype(np.int32)]), np.concatenate([self.ids, ids])
        return at

    def remember(self, strings: pa.Array, places: np.ndarray, most: int) -> None:
        """Keep the known strings and new ones, or the given ones alone if all are too many; forget all else."""
        if len(self.known) + len(strings) > most:
            kept, seq = strings, places
        else:
            new = places >= len(self.known)
            kept, seq = pa.concat_arrays([self.known, strings.filter(pa.array(new))]), np.concatenate([np.arange(len(self.known)), places[new]])
        ids, before = self.gathered(seq)
        self.known, self.ids, self.first, self.size = kept, ids, before[:-1].astype(np.int32), np.diff(before).astype(np.int32)


class Encoder:
    """Ids of whole texts. A pre-tokeniser of the byte-level kind never joins a space that stands between
    other characters to what is before it, so a text without runs of white space around a space is
    encoded piece by piece, each piece starting at a space. Distinct pieces of a batch that are not remembered
    from those before go to the library together, many as one text that is cut again where a token begins
    with a space, and the batch's ids are gathered from all. Other texts are encoded whole.

    A piece of Latin letters, marks after them, and lines of such after single line ends, falls into runs for
    the pre-tokeniser: letters, marks and line ends. These words are remembered too, as many pieces share them.
    New ones are written as the pre-tokeniser would write them, and only its model is asked."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer, pre_tokenizers

        self.t = Tokenizer.from_file(path)
        self.model = Tokenizer(self.t.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.letters = "".join({" ": " ", SPACED: "Ġ"}.get(chr(i), x) for i, x in enumerate(byte_letters()))
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary = self.t.get_vocab()
        pre = spec.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        self.by_piece = bool(plain) and all(self.t.decode([i]).isspace() for x, i in vocabulary.items() if "Ġ" in x[1:])
        self.unsafe = "|".join([f"{BLANK} {BLANK}", *(re.escape(x["content"]) for x in spec.get("added_tokens", []))])
        lines = f"[{LATIN}]+[{re.escape(MARKS)}]*"
        self.plain = rf"\A{lines}(\n{lines})*\z"
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[i for x, i in vocabulary.items() if x[0] == "Ġ"]] = True
        self.opens_word = self.opens.copy()
        self.opens_word[[i for x, i in vocabulary.items() if x == BARE]] = True
        self.pieces, self.words = Pool(), Pool()

    @property
    def known(self) -> pa.Array:
        return self.pieces.known

    def _library(self, texts: list[str], plain: bool = False) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in (self.model if plain else self.t).encode_batch_fast(texts, add_special_tokens=False)]

    def _each(self, texts: list[str], pool: Pool) -> np.ndarray:
        """Places of texts that the library encodes one by one."""
        got = self._library(texts)
        return pool.keep(np.concatenate([np.empty(0, np.uint32), *got]), np.array([len(x) for x in got], np.int64))

    def _runs(self, texts: list[str], opens: np.ndarray, plain: bool = False) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of texts that the library encodes many at once, and how many each has; None if these cannot be told apart."""
        lead = "" if plain else " "
        joined = [lead + " ".join(texts[i : i + JOINED]) for i in range(0, len(texts), JOINED)]
        ids = np.concatenate([np.empty(0, np.uint32), *self._library([codecs.charmap_decode(x.encode(), "strict", self.letters)[0] for x in joined] if plain else joined, plain)])
        first = np.flatnonzero(opens[ids])
        return (ids, np.diff(np.concatenate([first, [len(ids)]]))) if len(first) == len(texts) else None

    def _learn_words(self, words: list[str]) -> np.ndarray:
        """Places of words, of which those that begin with SPACED have a space before them."""
        spaced = np.array([w[0] == SPACED for w in words], bool)
        got = self._runs([w if s else f"{BARE} {w}" for w, s in zip(words, spaced.tolist(), strict=True)], self.opens_word, True)
        if got is None:
            return self._each([" " + w[1:] if w[0] == SPACED else w for w in words], self.words)
        return self.words.keep(*got, ~spaced)

    def _learn_plain(self, pieces: pa.Array) -> np.ndarray:
        """Places of pieces of letters, marks and line ends, each with a space before it."""
        apart = pc.replace_substring(pc.replace_substring_regex(pieces, f"([{re.escape(MARKS)}]+)", r" \1"), "\n", " \n ")
        lists = pc.split_pattern(pc.binary_join_element_wise(SPACED, apart, ""), " ")
        coded, offsets = lists.values.dictionary_encode(), lists.offsets.to_numpy()
        words = coded.dictionary
        places = self.words.find(words)
        new = places < 0
        places[new] = self._learn_words(_plain(words.filter(pa.array(new))))
        ids, before = self.words.gathered(places[coded.indices.to_numpy()])
        self.words.remember(words, places, REMEMBERED_WORDS)
        return self.pieces.keep(ids, np.diff(before[offsets]))

    def _learn(self, pieces: list[str]) -> np.ndarray:
        """Places of pieces, each with a space before it."""
        out, texts = np.empty(len(pieces), np.int32), pa.array(pieces, pa.string())
        plain = pc.match_substring_regex(texts, self.plain)
        kind = np.where(plain.to_numpy(zero_copy_only=False), 0, 2)
        out[kind == 0] = self._learn_plain(texts.filter(plain))
        kind[[i for i in np.flatnonzero(kind).tolist() if pieces[i] != "" and pieces[i] == pieces[i].strip()]] = 1
        some = [pieces[i] for i in np.flatnonzero(kind == 1)]
        got = self._runs(some, self.opens)
        out[kind == 1] = self._each([" " + x for x in some], self.pieces) if got is None else self.pieces.keep(*got)
        out[kind == 2] = self._each([" " + pieces[i] for i in np.flatnonzero(kind == 2)], self.pieces)
        return out

    def encode_all(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: empty), one text after another, each with the end id if one is given,
        and how many each has."""
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, self.unsafe).to_numpy(zero_copy_only=False) if self.by_piece else np.ones(len(texts), bool)
        lists = pc.split_pattern(texts.filter(pa.array(~whole)), " ")
        offsets, coded = lists.offsets.to_numpy(), lists.values.dictionary_encode()
        pieces = coded.dictionary
        places = self.pieces.find(pieces)
        new = places < 0
        places[new] = self._learn(_plain(pieces.filter(pa.array(new))))
        found = places[coded.indices.to_numpy()]
        found[offsets[:-1]] = self._each(lists.values.take(pa.array(offsets[:-1])).to_pylist(), self.pieces)  # no space before a text's first
        many = np.ones(len(texts), np.int64)
        many[~whole] = np.diff(offsets)
        stop = np.cumsum(many + (end is not None))
        start = stop - many - (end is not None)
        seq = np.empty(int(stop[-1]) if len(stop) else 0, np.int32)
        by_piece = np.ones(len(seq), bool)
        by_piece[start[whole]] = False
        seq[start[whole]] = self._each(texts.filter(pa.array(whole)).to_pylist(), self.pieces)
        if end is not None:
            by_piece[stop - 1] = False
            seq[stop - 1] = self.pieces.keep(np.array([end], np.uint32), np.array([1]))
        seq[by_piece] = found
        ids, before = self.pieces.gathered(seq)
        self.pieces.remember(pieces, places, REMEMBERED)
        return ids, before[stop] - before[start]

    def whole(self, text: str) -> bytes:
        return np.array(self.t.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        return self.encode_all(pa.array([text], pa.string()))[0].tobytes()


_loaded: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def cut_all(ids: np.ndarray, sizes: np.ndarray, p: StoreParams) -> list[list[int]]:
    """Ends of the chunks of id streams that follow one another: after an id at which the rolling hash of the
    last p.window ids has its low bits clear, at least p.least and at most p.most ids after the last cut."""
    marks = [np.empty(0, np.int64)]
    for at in range(0, len(ids), BLOCK):
        back = min(at, p.window - 1)
        h = _mix(ids[at - back : at + BLOCK].astype(np.uint64) + np.uint64(1))
        rolling = np.zeros(len(h), np.uint64)
        for k in range(min(p.window, len(h))):
            rolling[k:] += h[: len(h) - k] * np.uint64(2 * k + 1)
        marks.append(np.flatnonzero((_mix(rolling[back:]) & np.uint64(p.mean - 1)) == 0) + at + 1)
    marks = np.concatenate(marks)
    stop = np.cumsum(sizes)
    parts = np.searchsorted(marks, np.concatenate([[0], stop]), side="right")
    out = []
    for k, n in enumerate(sizes.tolist()):
        row, last = [], 0
        for mark in [*(marks[parts[k] : parts[k + 1]] - (stop[k] - n)).tolist(), n]:
            while mark - last > p.most:
                last += p.most
                row.append(last)
            if mark - last >= p.least:
                last = mark
                row.append(last)
        if last < n:
            row.append(n)
        out.append(row)
    return out


def cuts(ids: np.ndarray, p: StoreParams = StoreParams()) -> list[int]:
    """Ends of the chunks of one id stream."""
    return cut_all(ids, np.array([len(ids)]), p)[0]


def digest(ids: bytes) -> bytes:
    return hashlib.sha256(ids).digest()[:20]


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary tree over digests; an odd one out moves up as it is. Leaves and nodes are told apart."""
    level = [hashlib.sha256(b"\x00" + x).digest() for x in leaves] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\x01" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


ENCODED = "o long, doc_id long, key binary, n_tokens long, chunks array<binary>, ends array<int>, ids binary"
OWNED = "array<struct<nth:int,shared:boolean,ids:binary>>"
OWNED_ARROW = [pa.field("nth", pa.int32()), pa.field("shared", pa.bool_()), pa.field("ids", pa.binary())]
PACK = f"pack int, doc_id long, seq long, n_tokens long, chunks array<binary>, owned {OWNED}, root binary"


def _lists(rows: list[list], kind: pa.DataType) -> pa.ListArray:
    """A list array of rows of plain values."""
    offsets = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array([x for row in rows for x in row], kind))


def _plain(x: pa.Array) -> list:
    """As to_pylist(), quicker; not for numbers with nulls."""
    return x.to_numpy(zero_copy_only=False).tolist()


def small(ids: np.ndarray) -> bytes:
    """Ids as stored: two bytes each if that is enough, told by a leading byte; little-endian."""
    return b"\x02" + ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 65536 else b"\x04" + ids.astype("<u4").tobytes()


def large(stored: bytes) -> np.ndarray:
    return np.frombuffer(stored, "<u2" if stored[:1] == b"\x02" else "<u4", offset=1).astype("<u4")


def _encode(path: str, p: StoreParams):
    """Rows (o, doc_id, key, text) to recipes and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, press = encoder(path), zstandard.ZstdCompressor(level=1)
        for b in sliced(batches, size=PART):
            ids, n = e.encode_all(b.column("text"), p.end)
            ends, raw, stop = cut_all(ids, n, p), memoryview(ids).cast("B"), np.cumsum(n)
            chunks, packed = [], []
            for end, last, own in zip(stop.tolist(), n.tolist(), ends, strict=True):
                at = end - last
                chunks.append([digest(raw[4 * (at + i) : 4 * (at + j)]) for i, j in zip([0, *own], own)])
                packed.append(press.compress(small(ids[at:end])))
            yield pa.RecordBatch.from_arrays(
                [b.column("o"), b.column("doc_id"), b.column("key"), pa.array(n, pa.int64()), _lists(chunks, pa.binary()), _lists(ends, pa.int32()), pa.array(packed, pa.binary())],
                ["o", "doc_id", "key", "n_tokens", "chunks", "ends", "ids"],
            )

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A pack's rows from those of a partition, in order: for each document, first the row that lists the
    chunks it owns (without ids), if it owns any, then its own."""
    from pyspark import TaskContext

    pack, seq, opener = TaskContext.get().partitionId(), 0, zstandard.ZstdDecompressor()
    at_key, mine = None, {}

    def built(rows: list[tuple]) -> pa.RecordBatch:
        doc_ids, seqs, n, chunks, owned, roots = zip(*rows, strict=True)
        flat = [x for row in owned for x in row]
        values = pa.StructArray.from_arrays([pa.array([x[i] for x in flat], f.type) for i, f in enumerate(OWNED_ARROW)], fields=OWNED_ARROW)
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, owned)]), pa.int32()), values)
        cols = [pa.array([pack] * len(rows), pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(seqs, pa.int64()), pa.array(n, pa.int64()), _lists(chunks, pa.binary()), lists, pa.array(roots, pa.binary())]
        return pa.RecordBatch.from_arrays(cols, ["pack", "doc_id", "seq", "n_tokens", "chunks", "owned", "root"])

    for b in batches:
        rows, size = [], 0
        lists = {c: b.column(c) for c in ("chunks", "ends", "mine")}
        at = {c: x.offsets.to_pylist() for c, x in lists.items()}
        digests, stop, nth, shared = map(_plain, (lists["chunks"].values, lists["ends"].values, lists["mine"].values.field("nth"), lists["mine"].values.field("shared")))
        own = lambda c, k, values: values[at[c][k] : at[c][k + 1]]
        ids = b.column("ids")
        for k, (doc_id, key, n, held) in enumerate(zip(b.column("doc_id").to_pylist(), _plain(b.column("key")), b.column("n_tokens").to_pylist(), _plain(ids.is_valid()), strict=True)):
            if not held:
                at_key, mine = key, dict(zip(own("mine", k, nth), own("mine", k, shared), strict=True))
                continue
            chunks, owned = own("chunks", k, digests), []
            if key == at_key:  # of equal rows, the first owns
                at_key, whole, stops = None, opener.decompress(ids[k].as_py()), [0, *own("ends", k, stop)]
                wide, kind = whole[0], whole[:1]
                owned = [(i, mine[i], kind + whole[1 + wide * stops[i] : 1 + wide * stops[i + 1]]) for i in sorted(mine)]
            rows.append((doc_id, seq, n, chunks, owned, merkle(chunks)))
            seq, size = seq + 1, size + n
            if size > 300_000:
                yield built(rows)
                rows, size = [], 0
        if rows:
            yield built(rows)


def write(docs: DataFrame, tokenizer_path: str, path: str | None = None, p: StoreParams = StoreParams()) -> str:
    """Store the ids of all documents (doc_id, text); gives the folder.

    Texts are encoded where they are read. Only digests are compared to find each distinct chunk's owner,
    the least document in order; compressed ids are moved once, to their doc_id range, and written there.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "token-store")
    order = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    base = docs.select(order.alias("o"), "doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("key"), "text")
    scratch = Scratch(spark)
    encoded = scratch.store(base.mapInArrow(_encode(tokenizer_path, p), ENCODED), "encoded")
    whole = encoded.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("ids"), F.count("*").alias("docs")).first()
    packs = max(p.packs or int(spark.conf.get("spark.sql.shuffle.partitions")), -(-whole["ids"] // p.pack_ids), -(-whole["docs"] // p.pack_docs))
    each = encoded.select("o", "key", F.posexplode("chunks").alias("nth", "digest"))
    owners = each.groupBy("digest").agg(F.min(F.struct("o", "key", "nth")).alias("x"), (F.count("*") > 1).alias("shared"))
    owners = owners.groupBy("x.o", "x.key").agg(F.collect_list(F.struct("x.nth", "shared")).alias("mine"))
    rows = encoded.unionByName(scratch.store(owners, "owners"), allowMissingColumns=True)
    placed = rows.repartitionByRange(packs, "o", "key").sortWithinPartitions("o", "key", F.col("ids").isNotNull()).drop("o")
    placed.mapInArrow(_pack, PACK).write.option("compression", "zstd").parquet(f"{path}/packs")
    scratch.clear()
    packed = spark.read.schema(PACK).parquet(f"{path}/packs")
    tops = packed.select("pack", "seq", "n_tokens", "root").groupBy("pack").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("seq", "root"))).alias("docs"))
    tops.select("pack", "n_docs", "n_tokens", F.transform("docs", lambda x: x["root"]).alias("roots")).mapInArrow(_roots, "pack int, n_docs long, n_tokens long, root binary").write.parquet(f"{path}/manifest")
    return path


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), pa.array([merkle(x.as_py()) for x in b.column("roots")], pa.binary())], ["pack", "n_docs", "n_tokens", "root"])


READ = "pack int, doc_id long, seq long, n_tokens long, ids binary, verified boolean"
READ_CRC = "pack int, doc_id long, seq long, n_tokens long, ids_crc32 long, verified boolean"


def _rebuild(checksum: bool):
    """Rows with all their chunks to ids, or to the checksums of their ids."""

    def parts(b: pa.RecordBatch, column: str) -> tuple[list, list, list]:
        lists = pc.fill_null(b.column(column), [])
        return lists.offsets.to_pylist(), _plain(lists.values.field("nth")), _plain(lists.values.field("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                kept, good = [], []
                sources = [parts(b, c) for c in ("owned", "others")]
                at_chunk, digests = b.column("chunks").offsets.to_pylist(), _plain(b.column("chunks").values)
                for k, (root, n) in enumerate(zip(b.column("root").to_pylist(), b.column("n_tokens").to_pylist(), strict=True)):
                    own = digests[at_chunk[k] : at_chunk[k + 1]]
                    found = [b""] * len(own)
                    for offsets, nth, ids in sources:
                        for j in range(offsets[k], offsets[k + 1]):
                            found[nth[j]] = large(ids[j]).tobytes()
                    good.append([digest(x) for x in found] == own and merkle(own) == root and sum(map(len, found)) == 4 * n)
                    kept.append(zlib.crc32(b"".join(found)) if checksum else b"".join(found))
                name, kind = ("ids_crc32", pa.int64()) if checksum else ("ids", pa.binary())
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("pack", "doc_id", "seq", "n_tokens")), pa.array(kept, kind), pa.array(good)], ["pack", "doc_id", "seq", "n_tokens", name, "verified"])

    return run


def _complete(spark: SparkSession, path: str, scratch: Scratch) -> DataFrame:
    """The packs' rows with the chunks that others own in a column others; read from scratch tables too."""
    packs = spark.read.schema(PACK).parquet(f"{path}/packs")
    recipe = packs.select("pack", "seq", F.posexplode("chunks").alias("nth", "digest"), F.transform("owned", lambda x: x["nth"]).alias("mine"))
    needed = recipe.where(~F.array_contains("mine", F.col("nth"))).select(F.col("pack").alias("p_"), F.col("seq").alias("s_"), "nth", "digest")
    shared = packs.select("chunks", F.explode(F.filter("owned", lambda x: x["shared"])).alias("x")).select(F.get("chunks", F.col("x.nth")).alias("digest"), F.col("x.ids").alias("ids"))
    met = scratch.store(needed, "needed").join(scratch.store(shared, "shared"), "digest")
    others = met.groupBy("p_", "s_").agg(F.collect_list(F.struct("nth", F.lit(True).alias("shared"), "ids")).alias("others"))
    alone = F.size("owned") == F.size("chunks")
    full = packs.where(alone).withColumn("others", F.lit(None).cast(OWNED))
    mixed = packs.where(~alone).join(others, (F.col("pack") == F.col("p_")) & (F.col("seq") == F.col("s_"))).drop("p_", "s_")
    return full.unionByName(mixed)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(pack, doc_id, seq, n_tokens, ids, verified) of every stored document; ids are little-endian
    unsigned 32-bit. Only chunks that other documents own are moved."""
    return _complete(spark, path, Scratch(spark)).mapInArrow(_rebuild(False), READ)


def summary(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, verified) of every stored document, from the ids read back."""
    scratch = Scratch(spark)
    rows = store(_complete(spark, path, scratch).mapInArrow(_rebuild(True), READ_CRC), "read")
    scratch.clear()
    ends = spark.read.parquet(f"{path}/manifest").select(F.col("pack").alias("p_"), "n_tokens")
    before = ends.select("p_", (F.sum("n_tokens").over(W.orderBy("p_")) - F.col("n_tokens")).alias("before"))  # one row a pack
    run = F.sum("n_tokens").over(W.partitionBy("pack").orderBy("seq")) - F.col("n_tokens")
    out = rows.withColumn("run", run).join(store(before, "before"), F.col("pack") == F.col("p_"))
    return out.select("doc_id", (F.col("before") + F.col("run")).alias("start"), "n_tokens", "ids_crc32", "verified")


def round_trip(docs: DataFrame, tokenizer_path: str, p: StoreParams = StoreParams()) -> DataFrame:
    """Write all documents and read them back: doc_id, start, n_tokens, ids_crc32, verified.

    A null or empty text is its end id alone. Documents with a null doc_id come first. Rows that repeat a
    doc_id follow one another by a digest of their text; equal rows are stored each, their chunks once.
    Other columns are ignored. An empty table gives no rows.
    """
    return summary(docs.sparkSession, write(docs.select("doc_id", "text"), tokenizer_path, None, p))
