import hashlib
import random
import re

from texts import DOCS, awkward

from quillspark.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string, doc_id string, pos int, term string"


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


def brute(docs, items):
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for k, x in items:
            v = words(x)
            n = min(10, len(v))
            for s in range(len(v) - n + 1) if v else ():
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == v[s : s + n]:
                        hit.update(range(j, j + n))
                        found |= {str(k)} if k is not None else set()
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(map(str, out))


def corpus():
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(25)] + ["Été", "don't", "X9"]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(1, prose(30)), (2, prose(12)), (10, prose(10)), (3, "w1 w2"), (4, "W3"), (5, None), (6, " ,. "), (7, "same same same same same same same same same same same"), (None, prose(11)), (1, prose(14)), (2, "w1 w2")]
    docs = [(r[0], r[1]) for r in awkward()]
    for k in range(60):
        i = rng.choice(items)[1] or ""
        w = i.split()
        s = rng.randrange(max(1, len(w) - 9))
        docs.append((100 + k, prose(rng.randrange(9)) + (", " if k % 2 else "\n") + " ".join(w[s : s + rng.choice([8, 10, 12])]).upper() + " " + prose(rng.randrange(9))))
    return docs + [(300, "same " * 40), (301, ",w3"), (302, "w3,")], items


def frames(spark):
    docs, items = corpus()
    return docs, items, spark.createDataFrame([(i, t, "en", "s", 0, "c", 1, "c", "c", "c") for i, t in docs], DOCS), spark.createDataFrame([(k, t, "c", 1, "c") for k, t in items], ITEMS)


def test_contamination(spark):
    docs, items, df, bench = frames(spark)
    assert sorted(str(tuple(r)) for r in d.contamination(df, bench).collect()) == brute(docs, items)
    kept = d.drop_contaminated(df, bench)
    assert kept.columns == df.columns
    bad = {r["doc_id"] for r in d.contamination(df, bench).where("contaminated").collect()}
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, _ in docs if i not in bad)


def test_repeated_rows_hold_a_passage(spark):
    passage = " ".join(f"p{i}" for i in range(10))
    longer = " ".join(f"q{i}" for i in range(14))
    items = [(1, passage), (2, longer)]
    docs = [(1, "a " + passage)] * 2 + [(None, passage + " b")] * 3 + [(2, longer)] * 2 + [(3, "a " + passage), (4, "none of it")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(str(tuple(r)) for r in d.contamination(df, bench).collect()) == brute(docs, items)
    assert [r["doc_id"] for r in d.drop_contaminated(df, bench).collect()] == [4]


def test_empty_tables(spark):
    docs, items, df, bench = frames(spark)
    assert d.contamination(df.limit(0), bench).count() == 0
    assert d.contamination(df, bench.limit(0)).where("contaminated").count() == 0
    assert d.contamination(df, bench.limit(0)).count() == len(docs)


def test_proximity(spark):
    df = spark.createDataFrame([(1, "a x b y c"), (2, "c a b"), (3, "a b"), (4, "a z z z z z b c"), (5, "q")], "doc_id long, text string")
    items, names = d.item_terms(spark.createDataFrame([(1, "a b c"), (2, "q")], "item_id long, text string"))
    index = d.build_index(df, items.select("term").distinct())
    keys = {r["k"]: r["doc_id"] for r in df.selectExpr("xxhash64(doc_id, text) k", "doc_id").collect()}
    got = {(keys[r["dkey"]], r["item_id"]) for r in d.proximity_hits(index, items, 4).join(names, "ikey").collect()}
    assert got == {(1, 1), (2, 1), (5, 2)}
