"""Substring joins and the top-k link join, against plain loops."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark.functions import cards, tokens
from quillspark.functions import taxonomy as tx
from quillspark.operators import containment, graph, similarity, tiles, verdicts

NASTY = ["", "a", "ab", "abc", "aaaa", "漢字", "漢", "x😀y", "😀", "the cat", "cat", None, "ca", "t", "at s"]


def test_contained_pairs(spark):
    rng = random.Random(4)
    names = NASTY + ["".join(rng.choice("abc漢") for _ in range(rng.randrange(9))) for _ in range(150)]
    one, two = names[:90] + names[:3], names[60:] + NASTY
    got = containment.contained_pairs(spark.createDataFrame([(x,) for x in one], "short string"), spark.createDataFrame([(x,) for x in two], "long string")).collect()
    want = {(x, y) for x in one for y in two if x is not None and y is not None and x in y}
    assert Counter(tuple(r) for r in got) == Counter(want)


def test_many_keywords(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefghij ü漢") for _ in range(n))
    keywords = list({word(rng.randrange(1, 9)) for _ in range(50_000)}) + ["", None, "abc"]
    texts = [(i, word(rng.randrange(300))) for i in range(40)] + [(98, None), (99, "")]
    t, k = spark.createDataFrame(texts, "key long, text string"), spark.createDataFrame([(x,) for x in keywords], "keyword string")
    want = Counter((i, x) for i, text in texts for x in set(keywords) if x and text and x in text)
    assert len(want) > 2000
    assert Counter(tuple(r) for r in containment.keywords_in(t, k).collect()) == want
    plan = containment.keywords_in(t, k)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    monkeypatch.setattr(containment, "ANCHORS_BROADCAST", 10)
    assert Counter(tuple(r) for r in containment.keywords_in(t, k).collect()) == want


def link_tables(spark, n):
    rng = random.Random(n)
    words = ["the", "der", "license", "dans", "los", "ein", "con", "was", "avec"] + [f"word{i}" for i in range(40)]
    names = [*"abcd", "DRAFT_a", "提炼_b", "DRAFT_", "DRAFT_long name", "long"]
    mk = lambda k, m: [(f"{k}{i}", rng.choice(names) if i % 4 else f"n{i}", rng.choice(list(tx.SAMPLE["contentTypes"])), " ".join(rng.choice(words) for _ in range(rng.randrange(25)))) for i in range(m)]
    schema = "key string, name string, ctype string, text string"
    return spark.createDataFrame(mk("c", n), schema), spark.createDataFrame(mk("i", 2 * n), schema)


@pytest.mark.parametrize("backend,threshold,seeds", [("tfidf", 34, (8, 12)), ("legacy", 40, (7,)), ("tfidf", 20, (9,))])
def test_top_links_equal_all_pairs(spark, backend, threshold, seeds):
    c, i = link_tables(spark, 60)
    pairs = similarity.scored_pairs(c, i, tx.SAMPLE, threshold, backend).select("a", "b", "score")
    want = similarity.top_k(pairs, "a", "b", 3).collect(), similarity.top_k(pairs, "b", "a", 3).collect()
    got = similarity.top_links(c, i, tx.SAMPLE, 3, threshold, backend, seeds=seeds).collect()
    back = similarity.top_links(c, i, tx.SAMPLE, 3, threshold, backend, from_ideas=True, seeds=seeds).collect()
    cells = lambda rows, a, b: Counter((r[a], r[b], r["score"], r["rank"]) for r in rows)
    assert len(got) > 60 and cells(got, "a", "b") == cells(want[0], "a", "b")
    assert cells(back, "a", "b") == cells(want[1], "b", "a")


def test_top_links_without_rows(spark):
    c, i = link_tables(spark, 4)
    assert similarity.top_links(c.limit(0), i, tx.SAMPLE, 3).count() == 0
    assert similarity.top_links(c, i.limit(0), tx.SAMPLE, 3).count() == 0


def test_batches_follow_one_another(spark):
    rng = random.Random(3)
    items = [(g, i, rng.choice([0, 100, 1500, 3000, 11_936, 20_000])) for g in ("a", "b", None, "hot") for i in range(300 if g == "hot" else rng.randrange(1, 30))]
    got = verdicts.batches(spark.createDataFrame(items, "g string, k long, n int"), "g", "k", F.col("n")).collect()
    want, last = [], {}
    for g, k, n in items:
        b, count, size = last.get(g, (0, 0, 0))
        b, count, size = (b + 1, 1, n + 64) if count and (count >= 8 or size + n + 64 > 12_000) else (b, count + 1, size + n + 64)
        last[g] = b, count, size
        want.append((g, b, k))
    assert Counter(tuple(r) for r in got) == Counter(want)
    p = spark.createDataFrame([(["a", " ", None, "b", "c"],), ([],), (None,)], "p array<string>").select(verdicts.proposals(F.col("p")).alias("p"))
    assert [r["p"] for r in p.collect()] == [["a", "b"], [], None]


def test_cards_are_collected_by_name(spark):
    rows = [("EVAL_b", "评估结论：🔴 (4/5 项 ✅)"), ("b", "评估结论：🔴"), ("EVAL_a", "# EVAL：title\n- [ ] x"), ("EVAL", ""), ("xEVAL_c", "")]
    got = cards.collect(spark.createDataFrame(rows, "name string, text string")).collect()
    assert [(r["name"], r["card"]["conclusion"], r["card"]["yes_count"]) for r in got] == [("EVAL_a", "green", 0), ("EVAL_b", "red", 4)]


def test_values_are_filled_across_blocks(spark):
    rng = random.Random(9)
    rows = [(g, i, rng.choice([None] * 9 + ["x", "y", "z"])) for g in ("a", None, "long") for i in range(500 if g == "long" else 40)]
    got = graph.filled(spark.createDataFrame(rows, "g string, i long, v string"), "g", "i", "v", lines=16).collect()
    want, last = [], {}
    for g, i, v in rows:
        last[g] = v or last.get(g)
        want.append((g, i, last[g]))
    assert Counter((r["g"], r["i"], r["v"]) for r in got) == Counter(want)


def test_grams_of_a_long_text_are_found_in_one_pass(spark):
    """By their places, they would be sought from the text's beginning each: quadratic in its length."""
    import time

    from pyspark.sql import functions as F

    from quillspark.operators import containment

    short = spark.createDataFrame([("ab\ncä\U0001f600d",)], "t string").select(containment.grams(F.col("t"), (3,)).alias("g")).first()["g"]
    assert {"ab\n", "b\nc", "\ncä", "cä\U0001f600", "ä\U0001f600d"} <= set(short)
    texts = spark.createDataFrame([(k, "wörter ohne ende " * 12_000 + "stichwort") for k in range(2)], "key long, text string")
    words = spark.createDataFrame([("stichwort",), ("stichwörter",), ("ende w",), ("e",), ("",)], "keyword string")
    start = time.time()
    assert sorted(map(tuple, containment.keywords_in(texts, words).collect())) == sorted((k, w) for k in range(2) for w in ("stichwort", "ende w", "e"))
    assert time.time() - start < 20


@pytest.mark.parametrize("backend", ["tfidf", "legacy"])
def test_tiles_equal_a_join_on_terms(spark, monkeypatch, backend):
    """Several tiles a side, terms by columns and by postings, assets without terms."""
    c, i = link_tables(spark, 40)
    bags = tokens.bag(c, "key"), tokens.bag(i, "key")
    joined = similarity.shared_terms(*bags, similarity.idf(bags[0].unionByName(bags[1])))
    value = "n_shared" if backend == "legacy" else "weight"
    want = Counter((r["a"], r["b"], round(r[value], 6), r["p"]) for r in joined.select("a", "b", value, similarity.keyword_points(joined, backend).alias("p")).collect())
    for left, right in ((2048, 4096), (25, 30)):
        monkeypatch.setattr(tiles, "LEFT", left)
        monkeypatch.setattr(tiles, "RIGHT", right)
        got = similarity.shared_pairs(c, i, backend)
        assert len(want) > 1000 and Counter((r["a"], r["b"], round(r[value], 6), r["points"]) for r in got.collect()) == want
    assert similarity.shared_pairs(c.limit(0), i, backend).count() == 0


def test_scores_are_the_same_in_any_tiles(spark, monkeypatch):
    c, i = link_tables(spark, 40)
    want = Counter(tuple(r) for r in similarity.scored_pairs(c, i, tx.SAMPLE, 30).collect())
    monkeypatch.setattr(tiles, "LEFT", 25)
    monkeypatch.setattr(tiles, "RIGHT", 30)
    assert len(want) > 100 and Counter(tuple(r) for r in similarity.scored_pairs(c, i, tx.SAMPLE, 30).collect()) == want


def test_rows_are_sent_once_for_many_blocks(spark, monkeypatch):
    """A row that is sent to each tile of its block makes disk grow with the square of the tables."""
    c, i = link_tables(spark, 100)
    want = Counter(tuple(r) for r in similarity.scored_pairs(c, i, tx.SAMPLE, 30).collect()), Counter(tuple(r) for r in similarity.shared_pairs(c, i).collect())
    best = Counter(tuple(r) for r in similarity.top_links(c, i, tx.SAMPLE, 3, 20, seeds=(4,)).collect())
    for name, n in (("LEFT", 10), ("RIGHT", 10), ("SPAN", 4), ("TASKS_A_CORE", 0)):
        monkeypatch.setattr(tiles, name, n, raising=False)
    ids = lambda df: df.select("key", F.array(F.lit(1)).alias("ids"), F.array(F.lit(1.0)).alias("idf"))
    assert tiles.tiled(ids(c), ids(i)).count() == 100 * 5 + 200 * 3
    assert tiles.spans((63, 126), 32) == (4, 4) and tiles.spans((1, 1), 0) == (1, 1)
    assert Counter(tuple(r) for r in similarity.scored_pairs(c, i, tx.SAMPLE, 30).collect()) == want[0]
    assert Counter(tuple(r) for r in similarity.shared_pairs(c, i).collect()) == want[1]
    assert Counter(tuple(r) for r in similarity.top_links(c, i, tx.SAMPLE, 3, 20, seeds=(4,)).collect()) == best


def test_pairs_are_not_shuffled(spark):
    """Every pair of these shares every word: a join on words would shuffle 40 rows a pair."""
    words = " ".join(f"word{i}" for i in range(40))
    c, i = (spark.range(600).select(F.concat(F.lit(k), "id").alias("key"), F.lit(words).alias("text")) for k in "ci")
    got = similarity.shared_pairs(c, i, "legacy")
    assert got.count() == 360_000
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan[: plan.index("FlatMapGroupsInArrow")] and got.where("n_shared <> 40").count() == 0


def test_the_rest_of_a_search_is_scored_in_tiles(spark):
    """Not by postings, whose candidates are shuffled one by one."""
    c, i = link_tables(spark, 30)
    got = similarity.top_links(c, i, tx.SAMPLE, 3, seeds=(4,))
    assert "FlatMapGroupsInArrow" in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.count() > 30


def test_terms_are_counted_where_texts_are_read(spark):
    rows = [(1, "cat cat dog"), (2, "dog"), (2, "dog ape dog"), (None, "ape"), (None, "ape cat"), (3, None), (4, "")]
    notes = spark.createDataFrame(rows, "k long, text string")
    want = {(1, "cat", 2), (1, "dog", 1), (2, "dog", 3), (2, "ape", 1), (None, "ape", 2), (None, "cat", 1)}
    assert Counter(tuple(r) for r in tokens.bag(notes, "k").collect()) == Counter(want)
    assert Counter(tuple(r) for r in tokens.top_terms(notes, "k", 1).collect()) == Counter([(1, "cat", 2, 1), (2, "dog", 3, 1), (None, "ape", 2, 1)])
    plan = tokens.bag(notes.where("k = 1"), "k")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan
