import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from texts import DOCS, awkward

from quillspark.llm import lm_score as lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def test_scores(spark):
    rows = awkward()
    docs = spark.createDataFrame(rows, DOCS)
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 5 == 1
    tokens = lambda t: [*WORD.findall(low(t)), ""]
    c = Counter(w for r in rows if not held(r[0]) for w in tokens(r[1]))
    n, v = sum(c.values()), len(c)
    want = sorted((str(r[0]), held(r[0]), len(tokens(r[1])), sum(c[w] > 0 for w in tokens(r[1])), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(r[1])), 5)) for r in rows)
    got = lm.score(docs, lm.MixParams(bits=13, most_bits=13, block=4000, bucket=3000)).collect()
    assert want == sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got)
    again = lm.score(docs.repartition(5), lm.MixParams(bits=13, most_bits=13, block=4000, bucket=3000)).collect()
    assert sorted(str((r["doc_id"], r["score"])) for r in got) == sorted(str((r["doc_id"], r["score"])) for r in again)
    assert all(r["score"] <= 0 and (r["score"] < 0) == (r["bits_per_byte"] is not None) for r in got)
    assert lm.score(docs.limit(0)).count() == 0


def trained(texts, p):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([t.decode() for t in texts])], ["text"])
    pairs = np.zeros(65536, np.int64)
    for t in texts:
        d = np.frombuffer(lm.LEAD + t + lm.LEAD, np.uint8).astype(np.int64)
        pairs += np.bincount(d[:-1] * 256 + d[1:], minlength=65536)
    pairs = pairs.reshape(256, 256)
    pages = pa.Table.from_batches(lm._gather(lm.Trees.of(pairs), p)([batch])).to_batches()
    odds = np.zeros((len(lm.ORDERS) << p.bits) // lm.PAGE * lm.PAGE, np.int8).reshape(-1, lm.PAGE)
    for r in lm._add_pages(pages):
        odds[r.column(0)[0].as_py()] = np.frombuffer(r.column(1)[0].as_py(), np.int8)
    return lm.Model.of(pairs, odds.reshape(len(lm.ORDERS), -1), p).fit(texts[:50])


def prose(seed, n):
    rng = random.Random(seed)
    words = ["".join(random.Random(k).choice("etaoinshrdlu") for _ in range(2 + k % 6)) for k in range(80)]
    return [" ".join(words[int(79 * rng.random() ** 2)] for _ in range(rng.randrange(20, 400))).encode() for _ in range(n)]


def test_mixing_predicts_held_out_text():
    p = lm.MixParams(bits=16)
    model, held = trained(prose(1, 150), p), prose(2, 40)
    size = sum(map(len, held))
    counts = np.bincount(np.frombuffer(b"".join(held), np.uint8), minlength=256) / size
    entropy = -sum(x * math.log2(x) for x in counts if x)
    assert model.bits_of(held).sum() / size < 0.6 * entropy
    noise = [bytes(random.Random(3).choices(range(33, 127), k=2000))]
    assert model.bits_of(noise)[0] / 2000 > 5


def test_text_costs_the_same_in_any_batch():
    model = trained(prose(1, 30), lm.MixParams(bits=13))
    texts = [b"", *prose(5, 20), b"x", b"y" * 3000, b"never seen " * 30_000]
    assert np.allclose(model.bits_of(texts), [model.bits_of([t])[0] for t in texts], rtol=1e-12)


def test_what_a_text_teaches_is_carried_to_its_end():
    model, n = trained(prose(1, 30), lm.MixParams(bits=13)), 2 * lm.WINDOW + 9000
    odd = bytes(random.Random(4).choices(b"etaoinshrdlu ", k=n))  # known letters in an unknown order: less trust pays
    cost = [model.bits_of([odd[:k]])[0] for k in (64, 2048, n - 4096, n)]
    assert (cost[3] - cost[2]) / 4096 < 0.9 * cost[0] / 64
    model.p = lm.replace(model.p, rate=0.0, refine=0.0)
    fixed = [model.bits_of([odd[:k]])[0] for k in (n - 4096, n)]
    assert cost[3] - cost[2] < 0.95 * (fixed[1] - fixed[0])


def test_tables_grow_with_the_text():
    p = lm.MixParams()
    assert [p.grown(x).bits for x in (0, 10**7, 10**8, 5 * 10**8, 10**9, 10**12)] == [18, 18, 19, 21, 22, 22]


def test_next_byte_chances_sum_to_one():
    model = trained(prose(1, 30), lm.MixParams(bits=14))
    for lead in (b"", b"the", b"soon ti"):
        base = model.bits_of([lead])[0]
        total = sum(2 ** (base - x) for x in model.bits_of([lead + bytes([k]) for k in range(256)]))
        assert abs(total - 1) < 1e-3


def test_starting_weights_come_from_all_training_text(spark):
    import pyarrow as pa

    p, texts = lm.MixParams(bits=13), prose(7, 260) + [b" ".join(prose(8, 120))]
    assert len(texts[-1]) > 100_000
    pairs = sum(np.bincount(d[:-1] * 256 + d[1:], minlength=65536) for d in (np.frombuffer(lm.LEAD + t + lm.LEAD, np.uint8).astype(np.int64) for t in texts)).reshape(256, 256)
    batch = pa.RecordBatch.from_arrays([pa.array([t.decode() for t in texts])], ["text"])
    trees = lm.Trees.of(pairs)
    odds, levels = np.zeros((3, 1 << 13), np.int8), np.full((3, 1 << 13), lm.LEVEL[128] * 17, np.uint8)
    for r in lm._add_pages(pa.Table.from_batches(lm._gather(trees, p)([batch])).to_batches()):
        for into, column in ((odds, 1), (levels, 2)):
            into.reshape(-1, lm.PAGE)[r.column(0)[0].as_py()] = np.frombuffer(r.column(column)[0].as_py(), into.dtype)
    counts = lm.count_levels([batch], trees, levels, p.bits)
    laid = lm.lay_out([(lm.LEAD, t) for t in texts], p.bits)
    assert counts.sum() == trees.length[laid.pair].sum()
    want = lm.Model.of(pairs, odds, p).fit_counts(counts)
    rows = [(t.decode(),) for t in texts]
    got = lm.train(spark.createDataFrame(rows, "text string").repartition(7), pairs, p)
    assert np.array_equal(got.odds, odds) and np.allclose(got.weights, want.weights) and np.allclose(got.refined, want.refined)
    longest = lm.train(spark.createDataFrame(rows[-1:], "text string"), pairs, p)
    assert np.abs(longest.weights - 0.4).max() > 0.05
    assert lm.train(spark.createDataFrame([], "text string"), np.zeros((256, 256), np.int64), p).weights.max() == np.float32(0.4)
