"""WARC archives of captures: written by Spark, read back, and assembled into one nested row a capture.

A capture has three records. The response (or, for a payload that another capture has, a revisit of that
capture's response) has an id of its own; the request and the metadata record name it in WARC-Concurrent-To.
Records are built as columns and written by Spark's text writer, whose line separator is the two line ends that
close a WARC record: archives appear as whole files when their tasks commit. Only digests are shuffled to decide
which capture of a payload is the response.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bounded, new_path

END = "\r\n"
CLOSE = END + END
RECORD = "kind string, record_id string, concurrent_to string, refers_to string, target_uri string, date string, content_type string, payload_digest string, payload_bytes long, digest_holds boolean, payload binary"
HEADS_BROADCAST = 200_000  # rows of some 60 bytes, counted
COPIES = 1_000  # copies of one row that a task writes
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(value: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a string's or binary's bytes: eight times 20 bits as four digits."""
    hexed = F.sha1(value)
    parts = [F.lpad(F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", _ALPHABET)


def _urn(kind: str, *values: Column) -> Column:
    """A record id that follows from the capture alone, so that a task that runs again writes the same."""
    h = F.sha2(F.concat_ws("\x1f", F.lit(kind), *[F.coalesce(v.cast("string"), F.lit("\x00")) for v in values]), 256)
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(kind: str, id_: Column, date: str, content_type: str, block: Column, url: Column | None = None, more: tuple = ()) -> Column:
    """Header, an empty line and the block. Null header values are left out; line ends in them become spaces."""
    fields = [("WARC-Type", F.lit(kind)), ("WARC-Record-ID", id_), ("WARC-Date", F.lit(date))]
    fields += ([("WARC-Target-URI", url)] if url is not None else []) + list(more)
    fields += [("Content-Type", F.lit(content_type)), ("Content-Length", F.octet_length(block).cast("string"))]
    lines = [F.concat(F.lit(f"{name}: "), F.regexp_replace(v.cast("string"), r"[\r\n]", " ")) for name, v in fields]
    return F.concat(F.concat_ws(END, F.lit("WARC/1.1"), *lines), F.lit(CLOSE), block)


def decided(pages: DataFrame, scratch: Scratch, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, copy, sha, payload_digest, payload_bytes, head_id, head_url, revisit) of every capture.

    Of captures with equal payloads the one with the least page_id (nulls last), then url, is the response. Rows equal
    in all three columns are numbered by copy; they are counted, not sorted, and only the first copy carries its html.
    """
    html = F.coalesce("html", F.lit(""))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha2(html, 256).alias("sha"), base32_sha1(html).alias("payload_digest"), F.octet_length(html).cast("long").alias("payload_bytes"))
    order = F.struct(F.col("page_id").isNull().alias("n"), "page_id", F.col("url").isNull().alias("m"), "url")
    key = ["page_id", "url", "sha", "payload_digest", "payload_bytes"]
    rows = scratch.store(base.groupBy(*key).agg(F.count("*").alias("copies")), "captures")
    heads = rows.where(F.col("payload_bytes") >= least_bytes).groupBy("sha").agg(F.min(order).alias("head"), F.sum("copies").alias("all")).where(F.col("all") > 1)
    heads = bounded(scratch.store(heads.select("sha", F.col("head.page_id").alias("head_id"), F.col("head.url").alias("head_url")), "heads"), HEADS_BROADCAST)
    again = rows.where(F.col("copies") > 1)
    one = F.lit(0).cast("long")
    if again.isEmpty():
        whole = base.withColumn("copy", one)
    else:
        again = scratch.store(again, "repeats")
        named = again.select(F.col("page_id").alias("p_"), F.col("url").alias("u_"), F.col("sha").alias("s_"))
        meets = F.col("page_id").eqNullSafe(F.col("p_")) & F.col("url").eqNullSafe(F.col("u_")) & (F.col("sha") == F.col("s_"))
        alone = base.join(named, meets, "left_anti").withColumn("copy", one)
        first = base.join(named, meets, "left_semi").groupBy(*key).agg(F.first("html").alias("html")).withColumn("copy", one)
        blocks = again.withColumn("block", F.explode(F.sequence(F.lit(0), F.expr(f"(copies - 1) div {COPIES}"))))
        rest = blocks.repartition("page_id", "url", "sha", "block").withColumn("copy", F.explode(F.sequence(F.col("block") * COPIES, F.least(F.col("block") * COPIES + (COPIES - 1), F.col("copies") - 1))))
        rest = rest.where("copy > 0").withColumn("html", F.lit(""))
        if least_bytes > 0:  # short payloads are responses, whose copies need their html
            short = first.where(F.col("payload_bytes") < least_bytes).select("sha", F.col("html").alias("h_")).distinct()
            rest = rest.join(short, "sha", "left").withColumn("html", F.coalesce("h_", "html")).drop("h_")
        whole = alone.unionByName(first).unionByName(rest.select(alone.columns))
    found = whole.join(heads.withColumn("shared", F.lit(True)), "sha", "left")
    is_head = F.col("page_id").eqNullSafe(F.col("head_id")) & F.col("url").eqNullSafe(F.col("head_url")) & (F.col("copy") == 0)
    return found.withColumn("revisit", F.col("shared").isNotNull() & ~is_head)


def write(pages: DataFrame, path: str | None = None, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", per_file: int = 10_000) -> str:
    """Write three records for every row of pages (page_id, url, html) as gzipped WARC files; gives the folder.

    per_file: records a file holds at most. Files follow the partitions of pages; html is not shuffled unless more
    than HEADS_BROADCAST payloads are shared.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    scratch = Scratch(spark)
    c = decided(pages, scratch, least_bytes)
    me = [F.col("page_id"), F.col("url"), F.col("sha"), F.col("copy")]
    head = [F.col("head_id"), F.col("head_url"), F.col("sha"), F.lit(0)]
    answer = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CLOSE))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest")))
    url, mine = F.col("url"), F.col("response_id")
    revisit = _record("revisit", mine, date, "application/http; msgtype=response", answer, url, (digest, ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), ("WARC-Refers-To", _urn("response", *head)), ("WARC-Refers-To-Target-URI", F.col("head_url"))))
    response = _record("response", mine, date, "application/http; msgtype=response", F.concat(answer, F.col("html")), url, (digest,))
    host = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1)
    asked = F.concat(F.lit("GET "), F.regexp_replace(F.coalesce(url, F.lit("*")), r"[\r\n\x20]", "%20"), F.lit(f" HTTP/1.1{END}Host: "), F.regexp_replace(host, r"[\r\n]", ""), F.lit(CLOSE))
    request = _record("request", _urn("request", *me), date, "application/http; msgtype=request", asked, url, (("WARC-Concurrent-To", mine),))
    about = F.to_json(F.struct("page_id", "url", "copy"))
    metadata = _record("metadata", _urn("metadata", *me), date, "application/json", about, url, (("WARC-Concurrent-To", mine),))
    kinds = F.array(request, F.when(F.col("revisit"), revisit).otherwise(response), metadata)
    built = c.withColumn("response_id", _urn("response", *me)).select(F.explode(kinds).alias("value"))
    built.write.option("lineSep", CLOSE).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)
    scratch.clear()
    return path


def _inflated(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a plain or gzipped file (of one member or many), in parts of size."""
    if data[:2] != b"\x1f\x8b":
        yield from (data[at : at + size] for at in range(0, len(data), size))
        return
    view, at, d = memoryview(data), 0, zlib.decompressobj(31)
    while at < len(data):
        piece: bytes | memoryview = view[at : at + size]
        at += size
        while len(piece):
            out = d.decompress(piece, size)
            if out:
                yield out
            if d.eof:
                piece, d = d.unused_data, zlib.decompressobj(31)
            else:
                piece = d.unconsumed_tail


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of each record of a WARC file. A broken file raises."""
    parts, held, at = _inflated(data), bytearray(), 0

    def more() -> bool:
        nonlocal held, at
        part = next(parts, None)
        if part is None:
            return False
        held, at = held[at:], 0
        held += part
        return True

    while True:
        while (stop := held.find(b"\r\n\r\n", at)) < 0:
            if not more():
                if bytes(held[at:]).strip():
                    raise ValueError("a WARC record ends in its header")
                return
        lines = bytes(held[at:stop]).decode("utf-8", "surrogateescape").split(END)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record starts at {lines[0][:40]!r}")
        fields = {}
        for line in lines[1:]:
            name, _, value = line.partition(":")
            fields[name.strip().lower()] = value.strip()
        need = int(fields["content-length"])
        at = stop + 4
        while len(held) < at + need + 4:
            if not more():
                raise ValueError("a WARC record is shorter than its Content-Length")
        block = bytes(held[at : at + need])
        at += need
        if held[at : at + 4] != b"\r\n\r\n":
            raise ValueError("a WARC record is longer than its Content-Length")
        at += 4
        yield fields, block


def _read(payloads: bool):
    """Records of files: a response's payload is what follows its HTTP header; request and metadata keep their block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        types = [{"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}.get(x.split()[1], pa.string()) for x in RECORD.split(", ")]
        built = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        for b in batches:
            for content in b.column("content"):
                rows, size = [], 0
                for f, block in parse(content.as_py()):
                    kind, said = f.get("warc-type"), f.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    digest, n, holds, kept = said, None, None, block
                    if kind == "response":
                        payload = block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else block
                        digest, n = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
                        holds, kept = said is None or said == digest, payload if payloads else None
                    elif kind == "revisit":
                        kept = None
                    rows.append((kind, f.get("warc-record-id"), f.get("warc-concurrent-to"), f.get("warc-refers-to"), f.get("warc-target-uri"), f.get("warc-date"), f.get("content-type"), digest, n, holds, kept))
                    size += 200 + len(kept or b"")
                    if size > 4_000_000:
                        yield built(rows)
                        rows, size = [], 0
                if rows:
                    yield built(rows)

    return run


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of the WARC files (.gz or plain) of a folder: RECORD.

    payload_bytes and payload_digest of a response are of the payload read; digest_holds tells whether its header says the
    same. A revisit has the digest of its header. payloads = False leaves out the payloads of responses.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_read(payloads), RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row a capture: (capture_id, target_uri, date, response, request, metadata, n_requests, n_metadata).

    Requests and metadata meet the response or revisit that they name in WARC-Concurrent-To. Of several requests (or metadata
    records) of a capture, the one with the least record id is taken and the number told; those that name no response are
    left out, and a capture without them has nulls. A response record that comes twice is two captures.
    """
    main = records.where(F.col("kind").isin("response", "revisit")).select(
        F.col("record_id").alias("capture_id"), "target_uri", "date",
        F.struct("kind", "content_type", "payload_digest", "payload_bytes", "digest_holds", "refers_to", "payload").alias("response"),
    )

    def part(kind: str, count: str) -> DataFrame:
        own = records.where((F.col("kind") == kind) & F.col("concurrent_to").isNotNull())
        one = F.min(F.struct("record_id", "content_type", F.col("payload").alias("block"))).alias(kind)
        return own.groupBy(F.col("concurrent_to").alias("capture_id")).agg(one, F.count("*").alias(count))

    both = main.join(part("request", "n_requests"), "capture_id", "left").join(part("metadata", "n_metadata"), "capture_id", "left")
    return both.na.fill(0, ["n_requests", "n_metadata"])


def resolve(captures: DataFrame, scratch: Scratch) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, digest_holds) of assembled captures.

    A revisit gets the payload's figures and refers_to from the response that it refers to; digest_holds is false where
    its own header says another digest, and null where no such response is in the archives.
    """
    about = F.from_json(F.col("metadata.block").cast("string"), "page_id long, url string, copy long")
    flat = scratch.store(captures.select("capture_id", about["page_id"].alias("page_id"), "response.kind", "response.payload_bytes", "response.payload_digest", "response.digest_holds", "response.refers_to"), "captures")
    called = flat.where(F.col("refers_to").isNotNull()).select(F.col("refers_to").alias("capture_id")).distinct()
    named = scratch.store(flat.where("kind = 'response'").join(called, "capture_id", "left_semi").select(F.col("capture_id").alias("refers_to"), F.col("page_id").alias("r_id"), F.col("payload_bytes").alias("r_bytes"), F.col("payload_digest").alias("r_digest")), "named")
    found = flat.join(bounded(named, HEADS_BROADCAST), "refers_to", "left")
    again = F.col("kind") == "revisit"
    return found.select(
        "page_id", F.when(again, F.col("r_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"), F.when(again, F.col("r_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        F.col("kind").alias("record_type"), F.when(again, F.col("r_id")).alias("refers_to"), F.when(again, F.col("r_digest") == F.col("payload_digest")).otherwise(F.col("digest_holds")).alias("digest_holds"),
    )


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write all pages (page_id, url, html) and read them back: a row each, as resolve() gives them.

    A null html is an empty payload. A null page_id comes after all others, and equal page_ids are ordered by url (nulls
    last); of equal rows one is the response. Other columns are ignored. An empty table gives no rows.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark)
    records = scratch.store(read_records(spark, write(pages.select("page_id", "url", "html"), None, least_bytes), payloads=False), "records")
    return resolve(assemble(records), scratch)
