import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from quillspark.llm import trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id long, turn long, role string, text string, depth long, node long, path string, conv int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "p", 3) for r in rows], SCHEMA)


def brute(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    seqs = {}
    for c in own:
        h, base = zlib.crc32(str(c).encode()) % 4, c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        seqs[c] = own.get(base, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c in sorted(seqs):
        for d in range(len(seqs[c]) + 1):
            members[tuple(seqs[c][:d])].append(c)
    kids, leaves, saved = Counter(), Counter(), Counter()
    for k, m in members.items():
        if k:
            kids[k[:-1]] += 1
    for k, m in members.items():
        cost = (len(m) - 1) * len(WORD.findall(k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] += cost
            leaves[k[:d]] += k not in kids
    ends = lambda k, m: hashlib.sha256(",".join(str(c) for c in m if len(seqs[c]) == len(k)).encode()).hexdigest()
    return Counter((m[0], len(k), members[k[:-1]][0] if k else None, len(m), kids[k], leaves[k], saved[k], ends(k, m)) for k, m in members.items())


def random_rows(rng, convs, depth, words=3):
    turns = [("user", " ".join(rng.choice("ab") for _ in range(1 + i % 3))) for i in range(words)]
    return [(c, t, *rng.choice(turns)) for c in convs for t in range(rng.randrange(depth))]


def cases():
    rng = random.Random(2)
    yield "random", random_rows(rng, range(80), 9)
    yield "deep", [(c, t, "user", f"turn {t if t < 30 + c % 7 * 9 else (t, c)}") for c in range(0, 140, 5) for t in range(100)]
    odd = [(c, None if t == 3 else t, None if t == 1 else "user", None if t == 2 else f"say {c // 3} {t}") for c in range(-45, 45) for t in range(5)]
    odd += [(7, 2, "a", "x"), (7, 2, "a", "w"), (7, None, "b", None), (7, 2, "a", "x"), (None, 0, "user", "lost"), (None, 1, None, None), (103, 0, "u", "one turn"), (2**62, 5, "u", "漢 Ü 😀"), (-(2**62), 5, "", "")]
    yield "odd", odd
    yield "copies", [(c, t, "user", f"hot {t}") for c in range(600) for t in range(3)] + [(c, t, "user", f"own {c} {t}") for c in range(1000, 1040) for t in range(4)]
    yield "one", [(41, t, "u", "w " * 50) for t in range(300)]
    yield "equal rows", [(3, 0, "u", "same")] * 200 + [(4, 1, "u", "same")] * 199 + [(5, 0, "u", "same")] * 200
    yield "turnless", [(23, 0, "u", "x"), (24, 0, "u", "x"), (25, 0, "u", "x"), (22, 0, "u", "x")]
    yield "long text", [(0, 0, "u", "word " * 1_000_000), (1, 0, "u", "word " * 1_000_000), (1, 1, "u", "y")]
    yield "empty", []


@pytest.mark.parametrize("name,rows", list(cases()), ids=[n for n, _ in cases()])
def test_against_brute_force(spark, name, rows):
    got = Counter(tuple(r) for r in trie.nodes(frame(spark, rows).repartition(3) if rows else frame(spark, rows)).collect())
    assert got == brute(rows)


def test_sql_agrees(spark):
    import duckdb

    from quillspark.llm.queries import ORACLE, QUERIES

    got = QUERIES["op13_trie"](spark, "/root/testdata/sf0.01").collect()
    db = duckdb.connect()
    db.sql("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.01/conversations.parquet'")
    names = ", ".join(got[0].asDict())
    assert Counter(tuple(r) for r in got) == Counter(db.sql(f"SELECT {names} FROM ({ORACLE['op13_trie']})").fetchall())
    rows = db.sql("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    assert Counter(tuple(r) for r in got) == brute(rows)
