import random
import re

import numpy as np
from texts import DOCS, awkward

from quillspark.llm import neardup, shingles

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_tuples(t):
    w = [re.sub("[A-Z]", lambda m: m.group().lower(), x) for x in WORD.findall(t or "")]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows, percent=85):
    sets = {}
    for r in rows:
        if r[0] is not None:
            sets[r[0]] = shingle_tuples(r[1])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return sorted(str((r[0], len(shingle_tuples(r[1])), find(r[0]) if r[0] is not None else None, r[0] is None or find(r[0]) == r[0])) for r in rows)


def corpus():
    rng = random.Random(4)
    vocab = [f"Word{i}" for i in range(400)]
    rows, i = list(awkward()), 1000
    for g in range(12):
        text = [rng.choice(vocab) for _ in range(rng.randrange(6, 260))]
        for c in range(rng.randrange(1, 9)):
            t = list(text)
            for _ in range(c * len(t) // 120):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            rows.append((i, (" " if c % 2 else "\n").join(t).upper() if c % 3 == 0 else " ".join(t), "en", "s", 0, "c", 1, "c", "c", "c"))
            i += rng.randrange(1, 4)
    walk = [rng.choice(vocab) for _ in range(200)]  # a chain whose ends are far apart
    for _ in range(30):
        walk[rng.randrange(200)] = rng.choice(vocab)
        rows.append((i, " ".join(walk), "en", "s", 0, "c", 1, "c", "c", "c"))
        i += 1
    rng.shuffle(rows)
    return rows


def test_shingle_sets_are_those_of_words():
    for r in corpus():
        assert len(shingles.shingle_set(r[1])) == len(shingle_tuples(r[1]))
    same = [shingles.shingle_set(t) for t in ("A b  c d e f", "a B\nc\td e f ", "\x0ba b c d e f")]
    assert all((x == same[0]).all() for x in same)


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    p = neardup.NearParams()
    for j in (0.2, 0.5, 0.85, 0.95):
        got = []
        for _ in range(30):
            pool = rng.integers(0, 2**64, 1000, dtype=np.uint64)
            k = int(1000 * (1 - j) / 2)
            a, b = pool[k:], pool[: 1000 - k]
            x, y = neardup.sketch(a, p), neardup.sketch(b, p)
            assert (neardup.merge(x, y) == neardup.sketch(pool, p)).all()
            got.append(neardup.estimate(x[None], y[None], np.array([len(a)]), np.array([len(b)]), p)[0])
        assert abs(np.mean(got) - j) < 0.03
        assert np.std(got) < 0.08


def test_components_equal_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, DOCS)
    got = neardup.components(docs)
    assert sorted(str(tuple(r)[:4]) for r in got.collect()) == brute(rows)
    small = neardup.NearParams(block=3)
    assert sorted(str(tuple(r)[:4]) for r in neardup.components(docs.repartition(3), small).collect()) == brute(rows)


def test_keep_first_and_empty(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, DOCS)
    kept = neardup.keep_first(docs)
    assert kept.columns == docs.columns
    got = [r["doc_id"] for r in kept.collect()]
    want = {int(s.split(",")[0][1:]) for s in brute(rows) if s.endswith("True)") and not s.startswith("(None")}
    assert sorted(x for x in got if x is not None) == sorted(want)
    assert neardup.components(docs.limit(0)).count() == 0


def test_repeated_ids_with_other_texts(spark):
    rng = random.Random(9)
    t, u = (" ".join(rng.choice("abcdefghijkl") * 3 + str(rng.randrange(99)) for _ in range(40)) for _ in range(2))
    rows = [(5, t), (5, u), (7, t + " x"), (8, u + " y"), (9, u)]
    got = {r["doc_id"]: r["component_id"] for r in neardup.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict.fromkeys((5, 7, 8, 9), 5)
    again = [(5, t), (5, u), (5, u + " z"), (5, u), (7, t + " x"), (8, u + " y"), (None, t), (None, t)]
    found = neardup.components(spark.createDataFrame(again, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in found if r["doc_id"]} == {5}
    assert [(r["component_id"], r["kept"]) for r in found if r["doc_id"] is None] == [(None, True)] * 2
