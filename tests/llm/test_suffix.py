import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from canopy.llm import scratch, suffix_dedup
from canopy.llm.run_index import RunIndex

from .conftest import ROWS


def test_matching_statistics_against_brute_force():
    rng = random.Random(5)
    for t in range(150):
        strings = [bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 5))]
        strings = [s * rng.randint(1, 3) for s in strings] + strings[:1] if t % 2 else strings
        index = RunIndex(strings)
        found = index.matching_statistics()
        suffixes = [(s[i:], k, i) for k, s in enumerate(strings) for i in range(len(s))]
        for a, k, i in suffixes:
            want = max((next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for b, k2, i2 in suffixes if (k2, i2) != (k, i)), default=0)
            assert found[index.starts[k] + i] == want
        # the same of wider symbols
        wide = RunIndex([np.frombuffer(s, np.uint8).astype("<u4").tobytes() for s in strings], 4)
        assert (wide.matching_statistics() == found).all() and (wide.starts == index.starts).all()
    assert len(RunIndex([]).matching_statistics()) == len(RunIndex([], 4).matching_statistics()) == 0


def test_union_of_runs():
    rng = random.Random(9)
    for _ in range(200):
        parts = [(a := rng.randint(0, 40), a + rng.randint(1, 6)) for _ in range(rng.randint(0, 9))]
        gone = {i for a, b in parts for i in range(a, b)}
        got = suffix_dedup.union(np.array([a for a, _ in parts], np.int64), np.array([b for _, b in parts], np.int64))
        assert {i for a, b in got for i in range(a, b)} == gone and all(b < c for (_, b), (c, _) in zip(got, got[1:]))


def removed(rows, least=400):
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    times = Counter(b[i : i + least] for _, b in texts for i in range(len(b) - least + 1))
    out = []
    for doc_id, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - least + 1):
            if times[b[i : i + least]] > 1:
                gone[i : i + least] = b"\1" * least
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((doc_id, len(b), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


def awkward():
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdé fgh") for _ in range(n))
    shared = [word(rng.randint(300, 700)) for _ in range(6)]
    part = lambda: rng.choice([word(rng.randint(1, 200)), rng.choice(shared), rng.choice(shared)[: rng.randint(1, 600)], "ab" * rng.randint(1, 900), "x" * rng.randint(1, 1500)])
    rows = [(i, "".join(part() for _ in range(rng.randint(0, 4)))) for i in range(60)]
    return [*rows, (0, rows[0][1]), (3, rows[4][1]), (None, rows[7][1]), (200, "y" * 399), (201, "z" * 400), (202, "q" * 401)]


@pytest.mark.parametrize("variants", [1, 2048])
def test_digests_against_brute_force(spark, docs, variants, monkeypatch):
    monkeypatch.setattr(suffix_dedup.repeated_starts, "__defaults__", (variants, suffix_dedup.BUCKET_BYTES))
    odd = awkward()
    for rows, df in ((ROWS, docs), (odd, spark.createDataFrame(odd, "doc_id long, text string").repartition(4))):
        got = suffix_dedup.digests(df).collect()
        assert sorted([tuple(r)[:5] for r in got], key=str) == sorted(removed(rows), key=str)
        # without passages, the text is what the digest is of, but for characters of which a part went
        for r in suffix_dedup.digests(df, words=None).collect():
            assert r.n_cut == r.n_removed and (len(r.text.encode()) < r.n_bytes - r.n_removed or hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256)


def test_blocks(monkeypatch):
    data = (ROWS[57][1] or "").encode() * 2
    whole = suffix_dedup.stretches(data)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 3000)
    first, size, _ = suffix_dedup.stretches(data)
    assert sum(size) == sum(whole[1]) == len(data) - 399 and all(a + n == b for a, n, b in zip(first, size, first[1:]))


def test_remove_repeats(docs, none):
    out = suffix_dedup.remove_repeats(docs)
    assert out.columns == docs.columns
    gone = Counter((d, n) for d, _, n, _, _ in removed(ROWS))
    sizes = Counter()
    for r in out.collect():
        before = [x for x in ROWS if x[0] == r.doc_id and (x[1] == r.text or r.text is not None)]
        assert before
        if r.text is not None and r.n_chars is not None:
            assert r.n_chars == len(r.text)
        sizes[r.doc_id] += 1
    assert sizes == Counter(r[0] for r in ROWS) and any(n for _, n in gone)
    assert suffix_dedup.remove_repeats(none).columns == none.columns and suffix_dedup.digests(none).count() == 0


def passages_cut(rows, words=51, least=400):
    """doc_id, bytes cut and text left, without repeated strings and repeated passages of so many words, by brute force."""
    word = re.compile(rb"[^\x20\x09-\x0D]+")
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    parts = [word.findall(t) for _, t in texts]
    times = Counter(t[i : i + least] for _, t in texts for i in range(len(t) - least + 1))
    runs = Counter(tuple(p[i : i + words]) for p in parts for i in range(len(p) - words + 1))
    out = []
    for (doc_id, t), p in zip(texts, parts):
        gone, places = bytearray(len(t)), [m.span() for m in word.finditer(t)]
        for i in range(len(t) - least + 1):
            if times[t[i : i + least]] > 1:
                gone[i : i + least] = b"\1" * least
        for i in range(len(p) - words + 1):
            if runs[tuple(p[i : i + words])] > 1:
                a, b = places[i][0], places[i + words - 1][1]
                gone[a:b] = b"\1" * (b - a)
        kept = "".join(bytes(t[m.start() : m.end()]).decode("utf-8", "ignore") for m in re.finditer(rb"\0+", bytes(gone)))
        out.append((doc_id, sum(gone), kept))
    return out


def test_passages_against_brute_force(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5)))
    shared = [[word() for _ in range(rng.randint(45, 70))] for _ in range(8)]
    rows = []
    for i in range(40):
        text = ""
        for _ in range(rng.randint(0, 4)):
            own = rng.choice([[word() for _ in range(rng.randint(1, 60))], rng.choice(shared), rng.choice(shared)[3:], ["x"] * rng.randint(1, 60)])
            text += "".join(w + rng.choice(" \n\t") for w in own)
        rows.append((i, text))
    rows += [(3, rows[4][1]), (None, rows[5][1]), (5, rows[5][1]), (50, None), (51, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.n_cut, r.text) for r in suffix_dedup.digests(df).collect()]
    assert sorted(got, key=str) == sorted(passages_cut(rows), key=str) and any(0 < n < len(t) for _, n, t in got)
    kept = [(r.doc_id, r.text or "") for r in suffix_dedup.remove_repeats(df, words=51).collect()]
    assert sorted(kept, key=str) == sorted([(d, t) for d, _, t in passages_cut(rows)], key=str)


def test_repeated_rows_are_cut_once(spark, monkeypatch):
    """Rows equal in doc_id and text make as many contexts as one of them."""
    rng = random.Random(7)
    text = "".join(rng.choice("abcdefgh ") for _ in range(900))
    made = []
    monkeypatch.setattr(scratch.Steps, "saved", lambda self, df, name, f=scratch.Steps.saved: made.append((name, out := f(self, df, name))) or out)
    monkeypatch.setattr(scratch.Steps, "clear", lambda self: None)
    sizes = []
    for n in (1, 1000):
        made.clear()
        rows = [(1, text)] * n + [(2, text[:450] + "X" + text[451:])]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        starts = suffix_dedup.repeated_starts(df).collect()
        sizes.append(sum(df.count() for name, df in made if name == "contexts"))
        assert len(starts) == 2 and all(len({tuple(s) for s in r.starts}) == len(r.starts) for r in starts)
        assert sorted({tuple(r)[:5] for r in suffix_dedup.digests(df).collect()}) == sorted(set(removed(rows)))
    assert sizes[0] and sizes[1] <= sizes[0]


def test_any_names(spark):
    names = ["_repeated_starts", "_repeated_passages", "starts", "passages", "_row", "_id", "_hash", "_text", "a.b", "lo", "n"]
    text = "".join(random.Random(2).choice("abcdefgh ") for _ in range(500))
    rows = spark.createDataFrame([(i, text, *[7] * len(names)) for i in range(2)], f"doc_id long, text string, {', '.join(f'`{n}` int' for n in names)}")
    out = suffix_dedup.remove_repeats(rows, words=51)
    assert out.columns == rows.columns and [tuple(r) for r in out.collect()] == [(i, "", *[7] * len(names)) for i in range(2)]
    assert suffix_dedup.remove_repeats(rows.limit(0), words=51).count() == 0
