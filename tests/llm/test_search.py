import math

import numpy as np
from pyspark.sql import functions as F

from canopy.llm import ball_tree, url_filter
from canopy.llm.queries import URL_RULES


def best(rows, query, k=5):
    found = [(sum(a * b for a, b in zip(query[1], x)), i) for i, x in rows if i != query[0] and len(x) == len(query[1])]
    return sorted(found, key=lambda s: (-s[0], s[1]))[:k]


def test_tree_against_brute_force():
    rng = np.random.default_rng(0)
    for trial in range(40):
        n, d = rng.integers(1, 300), rng.integers(1, 6)
        x = np.floor(rng.normal(size=(n, d)) * rng.choice([1, 3, 50]))
        if trial % 3 == 0:
            x[: n // 2] = x[0]
        ids = rng.permutation(1000)[:n]
        tree = ball_tree.BallTree(x, ids, leaf=4)
        for q in range(0, n, 7):
            want = best([(int(i), r.tolist()) for i, r in zip(ids, x)], (int(ids[q]), x[q].tolist()))
            floor = want[-1][0] if trial % 2 and len(want) == 5 else -np.inf
            assert tree.search(x[q], int(ids[q]), 5, floor) == want


def test_large_components_are_exact():
    x = np.array([[3e15, 1.0], [3e15, 2.0], [-3e15, 5.0]])
    tree = ball_tree.BallTree(x, np.array([1, 2, 3]))
    assert tree.search(np.array([1000.0, 1.0]), 9, 2) == [(3 * 10**18 + 2, 2), (3 * 10**18 + 1, 1)]


def test_operator(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, rng.normal(size=8).round(3).tolist()) for i in range(400)]
    vectors += [(i, vectors[0][1]) for i in range(400, 520)]  # one very common vector
    odd = [(600, None), (650, []), (700, [1.0, None, *[0.0] * 6]), (750, [float("nan")] * 8), (800, [float("inf")] * 8), (850, [1.0, 2.0]), (851, [0.5, 0.5]), (None, [1.0] * 8), (3, vectors[3][1])]
    df = spark.createDataFrame([(i, x, "clash") for i, x in vectors + odd], "vec_id long, embedding array<float>, x string").repartition(3)
    whole = [(i, [math.floor(256 * float(np.float32(v))) for v in x]) for i, x in vectors + [odd[5], odd[6], odd[8]]]
    want = {(q[0], r + 1, i, s) for q in whole if q[0] % 50 == 0 for r, (s, i) in enumerate(best(whole, q))}
    for shard in (64, 8192):
        got = ball_tree.top_k(df, F.col("vec_id") % 50 == 0, 5, shard_rows=shard)
        assert {tuple(r) for r in got.collect()} == want
    assert ball_tree.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_clusters_are_left_out(spark):
    """Of clustered vectors, queries reach few shards, and nothing is lost."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(16, 6)) * 4
    x = centres[rng.integers(0, 16, 3000)] + rng.normal(size=(3000, 6)) * 0.05
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    visits = []
    got = {tuple(r) for r in ball_tree.top_k(df, F.col("vec_id") % 50 == 0, 5, shard_rows=128, visits=visits).collect()}
    whole = np.floor(256 * x)
    want = set()
    for q in range(0, 3000, 50):
        score = whole @ whole[q]
        order = [i for i in np.lexsort((np.arange(3000), -score)) if i != q][:5]
        want |= {(q, r + 1, int(i), int(score[i])) for r, i in enumerate(order)}
    assert got == want
    queries, shards = 60, 3000 / 128
    assert visits[0] == queries and sum(visits) < 0.4 * queries * shards


def _verdicts(spark, outcomes):
    """The method's verdict for each host of outcomes."""
    hosts = sorted({h for h, _ in outcomes})
    pages = spark.createDataFrame([(i, f"http://{h}/") for i, h in enumerate(hosts)], "page_id long, url string")
    judged = url_filter.judge(pages, spark.createDataFrame(outcomes, "host string, bad int"), ())
    return {r.host: r.verdict for r in judged.collect()}


def test_noise_alone_blocks_no_host(spark):
    """Hosts of one true rate draw outcomes by chance: none stands out, whatever the rate and the number of outcomes; a table that is bad as a whole does not pass."""
    rng = np.random.default_rng(4)
    for rate, n in ((0.02, 40), (0.25, 40), (0.25, 400), (0.4, 40)):
        outcomes = [(f"h{i}.net", int(b)) for i in range(300) for b in rng.random(n) < rate]
        assert set(_verdicts(spark, outcomes).values()) == {"allow"}, (rate, n)
    assert set(_verdicts(spark, [(f"h{i}.net", int(b)) for i in range(100) for b in rng.random(40) < 0.9]).values()) == {"block"}


def test_worse_hosts_are_blocked(spark):
    rng = np.random.default_rng(5)
    outcomes = [(f"h{i}.net", int(b)) for i in range(100) for b in rng.random(60) < (0.6 if i < 10 else 0.1)]
    assert {h for h, v in _verdicts(spark, outcomes).items() if v == "block"} == {f"h{i}.net" for i in range(10)}


def test_limit():
    assert url_filter.limit(0.2) == 0.25 and url_filter.limit(0.9) == url_filter.MOST_BAD and url_filter.limit(0.2, 0.1, 0.25) == 0.25


def test_suffix_table(spark):
    hosts = {"a.b.city.example": ("b.city.example", "city.example"), "x.example": ("x.example", "example"), "city.example": ("city.example", "city.example"), "q.r.other": ("r.other", "other"), "10.0.0.1": ("10.0.0.1", "10.0.0.1")}
    table = spark.createDataFrame([("city.example",), ("example",)], "suffix string")
    rows = url_filter.with_domains(spark.createDataFrame([(h,) for h in hosts], "host string"), table).collect()
    assert {r.host: (r.domain, r.suffix) for r in rows} == hosts
    outcomes = spark.createDataFrame([("a.b.city.example", 1), ("x.example", 0)] * 30, "host string, bad int")
    pages = spark.createDataFrame([(i, f"http://{h}/") for i, h in enumerate(hosts)], "page_id long, url string")
    got = {r.page_id: r.p_bad_low for r in url_filter.judge(pages, outcomes, (), suffixes=table).collect()}
    assert len(got) == 5 and got[0] > got[1]


RULED = {
    "http://a.ORG/x": ("a.org", "/x", "org/", "allow"), "https://www.example.org/es/1": ("www.example.org", "/es/1", "example.org/es/", "block"),
    "http://example.org/en/12?q": ("example.org", "/en/12", "example.org/en/1", "block"), "http://example.org/en/2": ("example.org", "/en/2", "org/", "allow"),
    "http://myexample.org/es/1": ("myexample.org", "/es/1", "org/", "allow"), "http://b.com/fr/#x": ("b.com", "/fr/", "com/fr/", "allow"),
    "http://b.com/de/": ("b.com", "/de/", "com/de/", "block"), "http://com/de/x": ("com", "/de/x", "com/de/", "block"), "http://b.com?x=/de/": ("b.com", "", None, "allow"),
    "no scheme": ("", "", None, "allow"), "": ("", "", None, "allow"), None: ("", "", None, "allow"), "http://org": ("org", "", None, "allow"), "x://": ("", "", None, "allow"),
}


def test_rules(spark):
    pages = spark.createDataFrame([(i, u, "h", "clash") for i, u in enumerate(RULED)], "page_id long, url string, html string, host string")
    none = spark.createDataFrame([], "host string, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, none, URL_RULES).collect()}
    assert got == dict(enumerate(RULED.values()))
    assert url_filter.judge(pages.limit(0), none, URL_RULES).count() == 0
    assert url_filter.judge(pages, none, ()).filter("rule is not null").count() == 0


def test_reputation(spark):
    seen = [("good.net", 0)] * 60 + [("bad.farm.net", 1)] * 58 + [("bad.farm.net", 0)] * 2 + [("once.net", 1)]
    outcomes = spark.createDataFrame(seen, "host string, bad int")
    urls = ["http://good.net/", "http://bad.farm.net/a", "http://once.net/", "http://new.farm.net/", "http://unknown.info/"]
    pages = spark.createDataFrame([(i, f"{u}") for i, u in enumerate(urls * 2)], "page_id long, url string")
    got = {r.page_id: (r.verdict, r.p_bad_low) for r in url_filter.judge(pages, outcomes, ()).collect()}
    assert [got[i][0] for i in range(3)] == ["allow", "block", "allow"]  # one bad outcome is no proof
    assert got[3][1] > got[0][1] and got[4][0] == "allow" and all(got[i] == got[i + 5] for i in range(5))


def test_domains(spark):
    hosts = {"a.b.co.uk": ("b.co.uk", "co.uk"), "www.x.example.com:80": ("example.com", "com"), "localhost": ("localhost", "localhost"), "10.0.0.1": ("10.0.0.1", "10.0.0.1"), "co.uk": ("co.uk", "co.uk"), "": ("", "")}
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    d, s = url_filter.domains(F.col("host"))
    assert {r.host: (r.d, r.s) for r in df.select("host", d.alias("d"), s.alias("s")).collect()} == hosts
