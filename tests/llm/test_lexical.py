import math
import random
import re
from collections import Counter

from canopy.llm import lexical
from tests.llm.conftest import ROWS

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string, doc_id long, row long"


def terms(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def ranked(docs, items, k):
    """Every item against every document."""
    own = [(d, Counter(w), len(w)) for d, w in ((d, terms(t)) for d, t in docs) if w]
    n_docs, n_terms = len(own), sum(n for *_, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c, n in own:
            m = 100 - 25 + 25 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(found, key=lambda f: f[:3])[:k])]
    return sorted(out, key=str)


def test_against_brute_force(spark, docs):
    rng = random.Random(3)
    texts = [r[1] for r in ROWS if r[1]]
    items = [(i, " ".join(rng.choice(texts).split(" ")[:40])) for i in range(12)]
    items += [(20, None), (21, ""), (22, "nowhereatall"), (23, "line LINE"), (24, items[0][1]), (0, "one two"), (None, "MIT license")]
    df = spark.createDataFrame([(i, t, 5, 6) for i, t in items], ITEMS).repartition(2)
    for k in (1, 3, 20):
        got = lexical.search(docs, df, k)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted((tuple(r) for r in got.collect()), key=str) == ranked([r[:2] for r in ROWS], items, k)


def test_items_beyond_the_broadcast(spark, docs, monkeypatch):
    monkeypatch.setattr(lexical, "ITEM_BYTES", 0)
    items = [(i, r[1]) for i, r in enumerate(ROWS[:6])]
    df = spark.createDataFrame([(i, t, 5, 6) for i, t in items], ITEMS)
    assert sorted((tuple(r) for r in lexical.search(docs, df, 5).collect()), key=str) == ranked([r[:2] for r in ROWS], items, 5)


def test_frequent_terms_generate_no_candidates(spark):
    """Terms that nearly all documents hold are left out, and nothing is lost."""
    rng = random.Random(4)
    common, rare = [f"c{i}" for i in range(20)], [f"r{i}" for i in range(3000)]
    rows = [(i, " ".join(rng.choices(common, k=40) + rng.choices(rare, k=8))) for i in range(1500)]
    items = [(i, rows[i * 50][1] + " " + rows[i * 50 + 1][1]) for i in range(10)]
    scored = []
    got = lexical.search(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), 5, scored=scored)
    assert sorted((tuple(r) for r in got.collect()), key=str) == ranked(rows, items, 5)
    assert scored[1] < 1500 * 10 / 5


def test_empty(spark, none):
    empty = spark.createDataFrame([], ITEMS)
    some = spark.createDataFrame([(1, "one", 1, 1)], ITEMS)
    assert lexical.search(none, some).count() == lexical.search(none, empty).count() == 0
