import random

from quillspark.llm import urls
from quillspark.llm.components import connected_components

PAGES = "page_id long, url string, html string, verdict string, component string, alias string"


def page(i, url, html="<p>x</p>"):
    return (i, url, html, "c", "c", "c")


def judged(spark, rows, **kw):
    return {r["page_id"]: r for r in urls.judge(spark.createDataFrame(rows, PAGES), **kw).collect()}


def test_rules_and_nulls(spark):
    got = judged(spark, [
        page(1, "http://A.Example.COM/en/1?x#y"), page(2, "http://www.example.com/en/2"), page(3, "https://q.net/es/"), page(4, "x.net/es/"),
        page(5, None, None), page(6, ""), page(7, "http://foo.com"), page(8, "http://notexample.com/en/"), page(9, "a://b.net/fr/?u=http://c.com/"),
        page(10, "http://net/es/1"), page(11, "http://q.NET/ES/"),
    ])
    assert {k: (r["host"], r["path"], r["rule"], r["verdict"]) for k, r in got.items()} == {
        1: ("a.example.com", "/en/1", "example.com/en/", "block"), 2: ("www.example.com", "/en/2", "www.example.com/en/", "allow"), 3: ("q.net", "/es/", "net/es/", "block"),
        4: ("", "", None, "allow"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("foo.com", "", None, "allow"), 8: ("notexample.com", "/en/", "com/", "allow"),
        9: ("b.net", "/fr/", "net/fr/", "block"), 10: ("net", "/es/1", "net/es/", "block"), 11: ("q.net", "/ES/", None, "allow"),
    }


def test_blocks_pass_to_aliases(spark):
    link = lambda u: f'<html><LINK href="{u}" rel="canonical"><body>'
    got = judged(spark, [
        page(1, "http://q.net/es/1"), page(2, "http://mirror.org/a", link("https://q.net/es/1?utm_source=z")), page(3, "http://mirror.org/b", '<meta http-equiv="refresh" content="0;url=/a">'),
        page(4, "http://mirror.org/b#frag"), page(5, "http://good.org/"), page(6, "http://x.org/1", link("http://y.com/1")), page(7, "http://y.com/1", link("http://q.net/fr/9")), page(8, "http://q.net/fr/9"),
    ])
    assert [got[i]["verdict"] for i in range(1, 9)] == ["block", "block", "block", "block", "allow", "allow", "allow", "block"]
    assert [got[i]["component"] for i in range(1, 9)] == [1, 1, 1, 1, 5, 6, 6, 6]
    assert judged(spark, [])  == {}


def test_redirect_table(spark):
    red = spark.createDataFrame([("http://q.net/es/1", "http://m.org/1"), (None, "x")], "source string, target string")
    got = judged(spark, [page(1, "http://q.net/es/1"), page(2, "http://m.org/1"), page(2, "http://m.org/1")], redirects=red)
    assert got[2]["verdict"] == "block"


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5, None), (None, 6), (7, 7)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_sql_agrees_where_links_pass_blocks(spark):
    import duckdb
    import pandas as pd

    from quillspark.llm.oracle import ORACLE

    link = lambda u: f'<html><LINK href="{u}" rel="canonical"><body>'
    rows = [
        (1, "http://q.net/es/1", "x"), (2, "http://mirror.org/a", link("https://q.net/es/1?utm_source=z")), (3, "http://mirror.org/b", '<meta http-equiv="refresh" content="0;url=/a">'), (4, "http://mirror.org/b#frag", ""),
        (6, "http://x.org/1", link("http://y.com/1")), (7, "http://y.com/1", link("//q.net/fr/9?a=1&amp;ref=2")), (8, "http://q.net/fr/9?a=1", link("nowhere")), (9, None, link("http://q.net/es/1")), (10, "http://alone.org/", None),
    ]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string"))
    db = duckdb.connect()
    db.register("pages", pd.DataFrame(rows, columns=["page_id", "url", "html"]))
    want = db.sql(ORACLE["op9_urls"]).fetchall()
    columns = [d[0] for d in db.sql(ORACLE["op9_urls"]).description]
    assert sorted(str(dict(zip(columns, r, strict=True))) for r in want) == sorted(str({c: r[c] for c in columns}) for r in got.collect())
    assert sum(r["verdict"] == "block" for r in got.collect()) == 6
