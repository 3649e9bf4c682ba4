"""Token counts from a digest cache: only distinct texts that the cache lacks are encoded.

The cache is a Parquet table (tokenizer, digest, n_tokens), added to by appending. A text's key is the
SHA-256 of its normalised content (null becomes empty, nothing else changes, as counts must be exact);
the tokenizer's key is the SHA-256 of its vocabulary file and options.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path

#: Word counts that a Python worker remembers at most.
MEMO = 400_000
_loaded: dict[str, object] = {}
CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"


def tokenizer_digest(path: str, options: str = "plain-v1") -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + options.encode()).hexdigest()


class Counter:
    """Counts a text's tokens as the library of its vocabulary file does.

    A sentencepiece model whose pieces have word marks only in front encodes each space-separated word
    alone: a text without empty words is counted as the sum of its words, of which many repeat. Other
    texts, and models of another kind, are encoded whole.
    """

    def __init__(self, path: str):
        self.json = path.endswith(".json")
        self.memo: dict[str, int] = {}
        if self.json:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.t = Tokenizer.from_file(path)
            self.t.encode_special_tokens = False
            self.by_word = False
        else:
            import sentencepiece

            self.t = sentencepiece.SentencePieceProcessor(model_file=path)
            pieces = (self.t.id_to_piece(i) for i in range(self.t.get_piece_size()))
            joined = any("▁" in x.lstrip("▁") for x in pieces)
            kept = all(self.t.normalize(x) == y for x, y in (("a  b ", "▁a▁▁b▁"), (" a\n\ta", "▁▁a\n\ta"), ("ﬁ  x", "▁ﬁ  x")))
            self.by_word = kept and not joined

    def whole(self, text: str) -> int:
        if self.json:
            return len(self.t.encode(text, add_special_tokens=False).ids)
        return len(self.t.encode(text))

    def count(self, text: str) -> int:
        if not self.by_word or "▁" in text:
            return self.whole(text)
        words, memo = text.split(" "), self.memo
        if "" in words:
            return self.whole(text)
        if new := [w for w in dict.fromkeys(words) if w not in memo]:
            if len(memo) + len(new) > MEMO:
                memo.clear()
                new = list(dict.fromkeys(words))
            memo.update(zip(new, map(len, self.t.encode(new, num_threads=1)), strict=True))
        return sum(map(memo.__getitem__, words))


def counter(path: str) -> Counter:
    if path not in _loaded:
        _loaded[path] = Counter(path)
    return _loaded[path]


def _encode_misses(path: str, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in batches:
            n = [c.count(x.as_py() or "") for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(n), pa.string()), b.column("digest").cast(pa.binary()), pa.array(n, pa.int64())], ["tokenizer", "digest", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, tokenizer_path: str, cache: str | None = None, limit: int = 4096) -> DataFrame:
    """A row for each document: doc_id, n_bytes, n_tokens, over_limit, digest.

    cache: the cache table's path, created if it is not there; without one, a new cache in the shared
    folder. A null text counts as empty. Repeated rows give repeated results, encoded once. Other
    columns are ignored. An empty table gives no rows and leaves the cache as it is. A task that fails
    after appending is repeated by Spark's committer, so that no count is stored twice; counts that two
    runs have appended at once are the same, and are read once.
    """
    spark = docs.sparkSession
    cache = cache or new_path(spark, "token-cache")
    key = tokenizer_digest(tokenizer_path)
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", text.alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))

    def known() -> DataFrame:
        at = spark._jvm.org.apache.hadoop.fs.Path(cache)
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return None
        return spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == key).select("digest", "n_tokens")

    missing = base.select("digest", "text")
    if (old := known()) is not None:
        missing = missing.join(old, "digest", "left_anti")
    missing = missing.groupBy("digest").agg(F.first("text").alias("text"))
    missing.mapInArrow(_encode_misses(tokenizer_path, key), CACHE_SCHEMA).write.mode("append").parquet(cache)
    counts = known()
    if old is not None:  # two writers may both have appended a digest
        counts = counts.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    mine = base.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    return mine.join(counts, "digest", "left").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), F.hex("digest").alias("digest"))
