import random
import zlib

import numpy as np
from texts import DOCS, awkward

from quillspark.llm import token_store as ts
from quillspark.llm.queries import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")
P = ts.StoreParams(packs=3, mean=64, most=256)


def brute(rows):
    e, out, at = ts.Encoder(PATH), [], 0
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, __import__("hashlib").sha256((r[1] or "").encode()).digest()))
    for r in rows:
        ids = e.whole(r[1] or "") + bytes(4)
        out.append(str((r[0], at, len(ids) // 4, zlib.crc32(ids))))
        at += len(ids) // 4
    return sorted(out)


def corpus():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    passage = " ".join(word() for _ in range(300))
    return awkward() + [(700 - i, " ".join(word() for _ in range(rng.randrange(200))) + " " + passage, "en", "s", 0, "c", 1, "c", "c", "c") for i in range(12)]


def test_round_trip(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, DOCS)
    path = ts.write(docs.select("doc_id", "text"), PATH, None, P)
    got = ts.summary(spark, path).collect()
    assert all(r["verified"] for r in got)
    assert sorted(str(tuple(r)[:4]) for r in got) == brute(rows)
    packs = spark.read.parquet(f"{path}/packs")
    owned = packs.selectExpr("chunks", "explode(owned) as x").selectExpr("chunks[x.nth] as d").collect()
    distinct = packs.selectExpr("explode(chunks) as d").distinct().count()
    assert len(owned) == len({bytes(r["d"]) for r in owned}) == distinct
    assert packs.selectExpr("explode(chunks) as d").count() > distinct + 30
    order = [(r["pack"], r["seq"], -(2**63) if r["doc_id"] is None else r["doc_id"]) for r in packs.orderBy("pack", "seq").collect()]
    assert [x[2] for x in order] == sorted(x[2] for x in order)
    ids = {r["seq"]: r for r in ts.read(spark, path).where("pack = 0").collect()}
    assert all(len(r["ids"]) == 4 * r["n_tokens"] for r in ids.values())
    assert ts.round_trip(docs.limit(0), PATH).count() == 0


def test_damage_is_found(spark, tmp_path):
    docs = spark.createDataFrame(corpus(), DOCS).select("doc_id", "text")
    path = ts.write(docs, PATH, str(tmp_path / "a"), P)
    bad = str(tmp_path / "b")
    harm = "transform(owned, x -> named_struct('nth', x.nth, 'shared', x.shared, 'ids', if(doc_id = 7, overlay(x.ids placing X'7777' from 4), x.ids)))"
    spark.read.schema(ts.PACK).parquet(f"{path}/packs").selectExpr("pack", "doc_id", "seq", "n_tokens", "chunks", f"{harm} as owned", "root").write.parquet(f"{bad}/packs")
    assert {r["doc_id"] for r in ts.read(spark, bad).where("not verified").collect()} >= {7}
    assert {r["doc_id"] for r in ts.read(spark, path).where("not verified").collect()} == set()


def test_pieces_encode_as_whole_texts():
    e, rng = ts.Encoder(PATH), random.Random(8)
    assert e.by_piece
    bits = ["The", "word", " ", " ", " ", "\n", ".", ",", "'s", "é", "12", "\t", " ", "don't", "x.", "y,", "A.,", "😀", "<|endoftext|>"]
    for t in [r[1] or "" for r in awkward()] + ["".join(rng.choice(bits) for _ in range(rng.randrange(25))) for _ in range(3000)]:
        assert e.encode(t) == e.whole(t), repr(t)


def test_cuts_follow_content():
    rng = np.random.default_rng(2)
    p = ts.StoreParams()
    tail = rng.integers(0, 50000, 6000).astype(np.uint32)
    a, b = np.concatenate([rng.integers(0, 50000, 501).astype(np.uint32), tail]), np.concatenate([rng.integers(0, 50000, 77).astype(np.uint32), tail])
    chunks = lambda x: {x[i:j].tobytes() for i, j in zip([0, *ts.cuts(x, p)], ts.cuts(x, p), strict=False)}
    assert len(chunks(a) & chunks(b)) > 8
    for x in (a, np.zeros(9000, np.uint32), a[:1], a[:0]):
        ends = ts.cuts(x, p)
        assert (ends or [0])[-1] == len(x)
        assert all(0 < j - i <= p.most for i, j in zip([0, *ends], ends, strict=False))


def test_pieces_are_learned_once(monkeypatch):
    e, asked = ts.Encoder(PATH), []
    learn = e._learn
    monkeypatch.setattr(e, "_learn", lambda pieces: asked.append(sorted(pieces)) or learn(pieces))
    first, second = "one two three, é two", "x two three, four é"
    assert [e.encode(t) for t in (first, second)] == [e.whole(t) for t in (first, second)]
    assert asked == [["one", "three,", "two", "é"], ["four", "x"]]
    monkeypatch.setattr(ts, "REMEMBERED", 7)  # too few for both: the second batch's stay
    assert e.encode("five six two") == e.whole("five six two") and e.known.to_pylist() == ["five", "six", "two"]
    for t in (second, "six five", "", " ", "six five\n \n"):
        assert e.encode(t) == e.whole(t)


def test_words_are_learned_once(monkeypatch):
    e, asked = ts.Encoder(PATH), []
    library = e._library
    monkeypatch.setattr(e, "_library", lambda texts, plain=False: asked.append(" ".join(texts)) or library(texts, plain))
    texts = ["x donor, donor. ĠĀɏ\nDonor", "x donor donor&&&\nDonor Donor_ ~.", "x donor.\nDonor, ĠĀɏ.\nªµº", "x ĠĀɏ!\n\ndonor ×÷ a_b a~b donor\n.\ndonor _\n~"]
    assert [e.encode(t) for t in texts] == [e.whole(t) for t in texts]
    assert sum(x.count("Ġdonor") for x in asked) == 1 and sum(x.count("~ Donor") for x in asked) == 1
    monkeypatch.setattr(ts, "REMEMBERED_WORDS", 2)  # too few: the last batch's stay
    assert e.encode("x five five.") == e.whole("x five five.") and e.words.known.to_pylist() == ["_five", "."]
    rng, bits = random.Random(4), ["ab", "Ġ", "_", "~", "É", "ß", "ĊĀ", "\n", "\n", " ", " ", ".", ",", "$%", "x1", "ɐ", "\x1c", "\x85", "　", "​"]
    for t in ["".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(3000)]:
        assert e.encode(t) == e.whole(t), repr(t)
