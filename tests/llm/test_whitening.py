import math
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from quillspark.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, label int, n long, key string, component string"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 0, 1, "k", "c") for i, v in vectors], SCHEMA)


def brute(vectors, k=16):
    """{(vec_id, nth equal row): ...} by exact fractions and numpy's eigh."""
    kept = [(i, tuple(math.floor(64 * c) + 1_000_000 for c in v)) for i, v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({x for _, x in kept})
    n, d = len(fit), len(fit[0])
    s = [sum(x[j] for x in fit) for j in range(d)]
    mean = [Fraction(a, n) for a in s]
    cov = np.array([[float(sum((x[a] - mean[a]) * (x[b] - mean[b]) for x in fit) / n) for b in range(d)] for a in range(d)])
    e, q = np.linalg.eigh(cov)
    order = np.argsort(-e)[:k]
    rows = [(i, sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True)), [float(a - b) for a, b in zip(x, mean, strict=True)]) for i, x in kept]
    return n, e[order], q[:, order], float(np.trace(cov)), rows


def compare(got, vectors, tolerance=1e-9):
    n, e, q, trace, rows = brute(vectors)
    assert len(got) == len(rows) * len(e)
    assert {r["n"] for r in got} == {n}
    assert max(r["identity_error"] for r in got) < 1e-9
    for j in range(len(e)):
        mine = [r for r in got if r["component"] == j + 1]
        assert Counter((r["vec_id"], r["deviation"]) for r in mine) == Counter((i, dev) for i, dev, _ in rows)
        assert all(abs(r["explained"] * trace / e[j] - 1) < 1e-9 for r in mine)
        want = {(i, dev): np.dot(c, q[:, j]) / math.sqrt(e[j]) for i, dev, c in rows}
        first = max(mine, key=lambda r: abs(r["whitened"]))
        sign = np.sign(first["whitened"] * want[first["vec_id"], first["deviation"]])
        assert all(abs(r["whitened"] - sign * want[r["vec_id"], r["deviation"]]) < tolerance for r in mine)


def test_against_fractions(spark):
    rng = np.random.default_rng(3)
    mixing = rng.normal(size=(20, 20))
    vectors = [(i, [float(x) for x in rng.normal(size=20) @ mixing]) for i in range(300)]
    vectors += [vectors[4], (900, vectors[4][1]), (None, vectors[5][1]), (901, vectors[6][1])]
    broken = [(902, None), (903, []), (904, [None, *vectors[0][1][1:]]), (905, [math.nan, *vectors[0][1][1:]]), (906, [*vectors[0][1][1:], math.inf]), (907, [1.0, 2.0])]
    compare(whitening.whiten(frame(spark, vectors + broken)).collect(), vectors)


def test_large_entries_stay_exact(spark):
    """Entries near 2^55 with small differences: doubles alone would lose them."""
    rng = np.random.default_rng(4)
    vectors = [(i, [float(2**49) + float(a), float(b) * 2**18, float(c)]) for i, (a, b, c) in enumerate(rng.integers(-1000, 1000, size=(200, 3)))]
    got = whitening.whiten(frame(spark, vectors)).collect()
    n, e, q, trace, rows = brute(vectors)
    assert {r["deviation"] for r in got} == {None}
    assert len(got) == 600 and max(r["identity_error"] for r in got) < 1e-9
    x = [[math.floor(64 * c) for c in v] for _, v in vectors]
    total, cross = whitening.exact_sums(np.array(x, np.int64))
    assert [int(a) for a in total] == [sum(r[j] for r in x) for j in range(3)]
    assert [[int(a) for a in r] for r in cross] == [[sum(r[a] * r[b] for r in x) for b in range(3)] for a in range(3)]
    # the components span the axes: variances of the exact integers, whatever their size
    m = whitening.fit(whitening.packed(frame(spark, vectors)))
    for j in range(3):
        mean = Fraction(sum(r[j] for r in x), n)
        assert m.scatter[j][j] == n * n * sum((r[j] - mean) ** 2 for r in x) / n
    assert np.allclose(sorted(m.values), sorted(e), rtol=1e-4)  # the plain eigenvalues are the less exact


def test_degenerate_tables(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [(1, None), (2, []), (3, [math.nan])])).count() == 0
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0  # no variance
    flat = [(i, [float(i), 5.0, -2.0 * i]) for i in range(10)]  # one component has all of it
    got = whitening.whiten(frame(spark, flat)).collect()
    assert {r["component"] for r in got} == {1} and len(got) == 10
    assert all(abs(r["explained"] - 1) < 1e-12 for r in got)
    huge = [(i, [1e300 * (-1) ** i, float(i)]) for i in range(6)]
    got = whitening.whiten(frame(spark, huge)).collect()
    assert {r["deviation"] for r in got} == {None} and max(r["identity_error"] for r in got) < 1e-6


def test_whole_table(spark):
    from quillspark.llm.queries import QUERIES

    got = QUERIES["op11_whitening"](spark, "/root/testdata/sf0.001").collect()
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    compare(got, [(r["vec_id"], r["embedding"]) for r in rows], 1e-7)


def test_many_copies_count_once(spark):
    rng = np.random.default_rng(6)
    vectors = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(60)]
    vectors += [(1000 + i, vectors[0][1]) for i in range(3000)]
    got = whitening.whiten(frame(spark, vectors)).collect()
    assert len(got) == 4 * 3060 and {r["n"] for r in got} == {60}
    assert pytest.approx(0, abs=1e-12) == max(r["identity_error"] for r in got)
