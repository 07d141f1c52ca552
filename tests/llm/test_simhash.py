import random
import re
from collections import Counter

import xxhash

from canopy.llm import components, simhash

from .conftest import ROWS


def plain(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for r in ROWS:
        assert simhash.fingerprint(r[1]) == plain(r[1])


def test_blocks_do_not_matter(monkeypatch):
    text = ROWS[57][1] or "a b c d e f g h"
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash._word_blocks, "__defaults__", (37,))
    assert simhash.fingerprint(text) == whole


def groups_of(rows):
    fps = [plain(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return [(r[0], f"{fps[i]:016x}", least.get(find(i))) for i, r in enumerate(rows)]


def test_groups_against_brute_force(docs):
    got = simhash.near_duplicates(docs)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert Counter(map(tuple, got.collect())) == Counter(groups_of(ROWS))


def test_keep_first(docs, none):
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter({c for _, _, c in groups_of(ROWS)})
    assert simhash.keep_first(none).count() == 0 and simhash.near_duplicates(none).count() == 0


def test_null_ids_stay_one_a_group(spark):
    rows = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (None, "entirely other words here")], "doc_id long, text string")
    assert simhash.keep_first(rows).count() == 2


def test_links_within_two_bits(spark):
    rng = random.Random(0)
    base = [rng.getrandbits(64) for _ in range(30)]
    values = {v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for v in base for _ in range(6)} | set(base)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = {(r.u, r.v) for r in simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()}
    reach = components.components(spark.createDataFrame(list(found), "u long, v long"))
    root = {r.node: r.root for r in reach.collect()}
    for a in signed:
        for b in signed:
            if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2:
                assert root[a] == root[b]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1200)] + [(5000, 5000), (7, 6)]
    root = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert len({root[i] for i in range(201)}) == 1 and len({root[i] for i in range(1000, 1200)}) == 1 and root[0] != root[1000] and 5000 not in root


def test_keep_first_takes_what_balls_find(spark, monkeypatch):
    """Without any bands, near copies whose fingerprints are within two bits are found, and only those that share enough."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(500)]
    texts = []
    for _ in range(6):
        own = rng.choices(words, k=400)
        copies = ([*own[:at], f"new{at}", *own[at + 1 :]] for at in range(400))
        near = next(c for c in copies if 1 <= (simhash.fingerprint(" ".join(c), 5) ^ simhash.fingerprint(" ".join(own), 5)).bit_count() <= 2)
        texts += [" ".join(own), " ".join(near), " ".join(own[::-1])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(simhash, "bands", lambda shingles: shingles[:0])
    assert sorted(r.doc_id for r in simhash.keep_first(df, 5, 0.8).collect()) == [i for i in range(18) if i % 3 != 1]
    assert simhash.keep_first(df, 5, 0.999).count() == 18
