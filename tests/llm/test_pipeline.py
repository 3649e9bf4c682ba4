import random
from collections import Counter

from test_counts_and_rules import WORD, brute_quality
from test_decontaminate import words
from test_neardup import brute as brute_components

import corpus_pipeline
from quillspark.llm import neardup, token_store
from quillspark.llm.queries import tokenizer_path


def corpus():
    rng = random.Random(12)
    vocab = [f"word{i}" for i in range(300)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    bench = [(k, prose(25)) for k in range(4)]
    docs = [(i, prose(rng.randrange(30, 120)), "en", f"s{i % 3}") for i in range(60)]
    docs += [(100 + i, docs[i][1] + " tail", "en", "s0") for i in range(8)] + [(200 + i, docs[i][1], "de", "s1") for i in range(5)]
    docs += [(300 + i, prose(30) + " " + bench[i % 4][1] + " " + prose(9), "en", "s2") for i in range(6)]
    docs += [(400, "too short", "en", "s0"), (401, prose(9) * 9, "en", "s0"), (402, None, "en", None), (403, "", None, "s1"), (404, "### $$$ " * 60, "en", "s1")]
    return [(i, t, g, s, len(t or "")) for i, t, g, s in docs], bench


def test_stages_match_brute_force(spark, tmp_path):
    docs, bench = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    frame, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, str(tmp_path))
        out.write.parquet(path := str(tmp_path / name.replace(" ", "-")))
        before, frame = frame, spark.read.parquet(path)
        seen[name] = frame.collect()
        if name != "token store":
            assert frame.columns == before.columns
    rows = {r[0]: r for r in docs}
    good = [r for r in docs if not brute_quality(r[1])[-1]]
    kept = {r["doc_id"] for r in seen["quality rules"]}
    assert kept <= {r[0] for r in good}
    assert {r[0] for r in good} - kept <= {404}
    left = [rows[i] for i in sorted(kept)]
    first = {int(s.split(",")[0][1:]) for s in brute_components(left) if s.endswith("True)")}
    assert {r["doc_id"] for r in seen["near-duplicates"]} == first
    windows = {tuple(words(t)[k : k + 10]) for _, t in bench for k in range(len(words(t)) - 9)}
    clean = {i for i in first if not any(tuple(words(rows[i][1])[k : k + 10]) in windows for k in range(len(words(rows[i][1])) - 9))}
    assert {r["doc_id"] for r in seen["decontamination"]} == clean
    drawn = Counter(r["doc_id"] for r in seen["source mixing"])
    assert set(drawn) <= clean
    assert max(drawn.values()) <= 3
    total = sum(len(WORD.findall(rows[i][1])) for i in clean)
    assert abs(sum(n * len(WORD.findall(rows[i][1])) for i, n in drawn.items()) - total) < 0.1 * total
    e, at = token_store.Encoder(tokenizer_path("byte_bpe_50k.json")), 0
    got = sorted((r["doc_id"], r["start"], r["n_tokens"]) for r in seen["token store"])
    for i, start, n in got:
        assert (start, n) == (at, len(e.whole(rows[i][1])) // 4 + 1)
        at += n
    assert Counter(i for i, _, _ in got) == drawn
    assert sorted(str(tuple(r)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(str(tuple(r)) for r in seen["token store"])


def test_near_duplicates_count_from_four_fifths(spark):
    rows = []
    for g, more in enumerate((20, 25, 26)):  # of 100 shingles: similarities of 0.833, 0.8 and 0.794
        text = [f"g{g}w{k}" for k in range(104 + more)]
        rows += [(10 * g, " ".join(text[:104])), (10 * g + 1, " ".join(text))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.neardup_stage(spark, docs, "").collect()}
    assert kept == {int(s.split(",")[0][1:]) for s in brute_components(rows, 80) if s.endswith("True)")} == {0, 10, 20, 21}
    assert neardup.keep_first(docs).count() == len(rows)  # op6_neardup: from 0.85
    assert (1 - 0.8**corpus_pipeline.NEAR.rows) ** corpus_pipeline.NEAR.bands < 1e-6
