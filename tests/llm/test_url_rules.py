from llm_tables import clashing
from pyspark.sql import functions as F

from kgloom.llm import url_rules as U

PAGES, LABELS = "page_id long, url string, html string", "doc_id long, quality int, toxic int"


def tokens(spark, url):
    return spark.createDataFrame([(url,)], "u string").select(U.url_tokens(F.col("u"))).first()[0]


def test_tokens(spark):
    assert tokens(spark, "HTTPS://blog.Spam-Farm.example.org/en/728.html?utm_source=feed&page=2#top") == ["h:blog", "h:spam", "h:farm", "n:example", "d:example.org", "p:en", "x:html", "q:utm_source=feed", "q:page=2", "f:top"]
    assert tokens(spark, None) == [] and tokens(spark, "") == [] and tokens(spark, "nonsense") == []
    assert tokens(spark, "http://a.com") == ["n:a", "d:a.com"]


def brute(rows, min_count, min_confidence):
    """Minimal rules of (tokens, bad) rows by counting every subset."""
    from itertools import combinations

    have, bad = {}, {}
    for t, b in rows:
        for k in range(1, len(t) + 1):
            for c in combinations(sorted(t), k):
                have[c] = have.get(c, 0) + 1
                bad[c] = bad.get(c, 0) + b
    ok = {c: bad[c] / have[c] for c in have if bad[c] >= min_count and bad[c] / have[c] >= min_confidence}
    return {c: v for c, v in ok.items() if not any(ok.get(p, 0) >= v for k in range(1, len(c)) for p in combinations(c, k))}


def test_rules_and_matches_equal_brute_force(spark):
    import random

    r = random.Random(4)
    rows = [(r.sample("abcdef", r.randint(1, 5)), 0) for _ in range(120)]
    rows = [(t, int(("a" in t and "b" in t) or ("e" in t and r.random() < 0.6))) for t, _ in rows]
    df = spark.createDataFrame([(t, bool(b)) for t, b in rows], "tokens array<string>, bad boolean")
    rules = U.mine(df, 0.0, 0.6, 6)
    want = brute(rows, 6, 0.6)
    got = {tuple(x["rule"]): x["confidence"] for x in rules.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got) and got
    urls = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "id long, tokens array<string>")
    hits = {x["id"]: (x["confidence"], x["rules"]) for x in U.match(urls, rules).collect()}
    for i, (t, _) in enumerate(rows):
        m = sorted(" ".join(c) for c in want if set(c) <= set(t))
        assert (hits[i][1] if i in hits else []) == m
        assert not m or abs(hits[i][0] - max(want[tuple(x.split())] for x in m)) < 1e-9


def test_filter(spark):
    pages = [(i, f"http://{'www.cheap-pills' if i % 3 == 0 else 'blog.fine'}.example.com/en/{i}?x=1", "") for i in range(60)]
    pages += [(100, None, None), (None, "http://www.cheap-pills.example.com/en/5", ""), (101, "", ""), (102, "http://www.cheap-pills.example.com/en/99999", None), (103, "x" * 200_000, ""), (102, "http://blog.fine.example.com/de/1", "")]
    labels = [(i, int(i % 3 != 0), 0) for i in range(45)] + [(None, 0, 0), (50, None, None)]
    got = U.filter_urls(clashing(spark.createDataFrame(pages, PAGES)), spark.createDataFrame(labels, LABELS), 0.01, 0.9, 5).collect()
    assert len(got) == len(pages)
    by = {}
    for r in got:
        by.setdefault(r["page_id"], []).append((r["blocked"], r["confidence"]))
    assert all(by[i][0][0] == (i % 3 == 0) for i in range(60))
    assert by[100] == by[101] == by[103] == [(False, None)] and by[None] == [(False, None)]
    assert by[102] == [(True, 0.9375)] * 2  # of 16 labelled pages one, without an id, is good


def test_empty_tables(spark):
    none_p, none_l = spark.createDataFrame([], PAGES), spark.createDataFrame([], LABELS)
    assert U.filter_urls(none_p, none_l).collect() == []
    one = U.filter_urls(spark.createDataFrame([(1, "http://a.b/c/1", "")], PAGES), none_l).collect()
    assert [(r["blocked"], r["rules"]) for r in one] == [(False, [])]
