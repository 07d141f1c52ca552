import hashlib
import math

import numpy as np
import pytest

from canopy.llm import codebooks

SCHEMA = "vec_id long, embedding array<float>, label int, x string, code string"


def lloyd(vectors, rounds=4):
    """Codes, errors and codebooks of (id, whole vector) rows of one length, by full scans in Python integers."""
    rows = sorted(vectors, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dim = len(rows[0][1])
    cuts = [i * dim // 4 for i in range(5)]
    parts = [[r[1][a:b] for r in rows] for a, b in zip(cuts, cuts[1:])]
    books = [[list(x) for x in p[:256]] for p in parts]
    dist = lambda a, b: sum((i - j) ** 2 for i, j in zip(a, b))
    assign = lambda: [[min(range(len(b)), key=lambda e: (dist(x, b[e]), e)) for x in p] for p, b in zip(parts, books)]
    for _ in range(rounds):
        for p, (part, own) in enumerate(zip(parts, assign())):
            for e in range(len(books[p])):
                mine = [x for x, o in zip(part, own) if o == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    final = assign()
    digest = hashlib.sha256(",".join(str(v) for b in books for x in b for v in x).encode()).hexdigest()
    return [(rows[i][0], "".join(f"{final[p][i]:02x}" for p in range(4)), sum(dist(parts[p][i], books[p][final[p][i]]) for p in range(4)), digest) for i in range(len(rows))]


def expected(rows):
    kept = [(i, [math.floor(1024 * float(np.float32(v))) for v in x], label) for i, x, label in rows if x is not None and all(v is not None and math.isfinite(v) for v in x)]
    found, errors = [], {}
    for dim in {len(x) for _, x, _ in kept}:
        own = [r for r in kept if len(r[1]) == dim]
        labels = [r[2] for r in sorted(own, key=lambda r: (r[0] is None, r[0] or 0, r[1]))]
        for label, row in zip(labels, lloyd([r[:2] for r in own])):
            found.append((row[0], label, *row[1:]))
            errors[label] = errors.get(label, 0) + row[2]
    return sorted(((i, label, code, error, errors[label], digest) for i, label, code, error, digest in found), key=str)


def compressed(spark, rows, **how):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in codebooks.compress(df, **how).collect()), key=str)


def test_against_full_scans(spark):
    rng = np.random.default_rng(0)
    rows = [(i, (rng.normal(size=8) * 0.3).tolist(), int(rng.integers(0, 4))) for i in range(420)]
    rows += [(i, rows[0][1], None) for i in range(420, 520)]  # one very common vector
    rows += [(3, rows[3][1], 1), (4, rows[9][1], 1), (None, rows[5][1], None)]
    odd = [(600, None, 1), (601, [1.0, None, *[0.0] * 6], 1), (602, [math.nan] * 8, 1), (603, [math.inf] * 8, 1), (604, [], 2), (605, [1.0, 2.0, 3.0, 4.0, 5.0], 2), (606, [1.5, 2.0, 3.0, 4.0, 5.0], 9), (607, [3.0], None)]
    assert compressed(spark, rows + odd) == expected(rows + odd)


def test_grids_tie(spark):
    """Vectors on a small grid make many equal distances; the lower index wins in each round."""
    rng = np.random.default_rng(1)
    rows = [(int(i), (rng.integers(-2, 3, 4) / 1024).tolist(), 0) for i in rng.permutation(600)]
    assert compressed(spark, rows) == expected(rows)


def test_few_parts_are_scanned_again(spark, monkeypatch):
    """Of clustered vectors, most keep their entries without another scan."""
    monkeypatch.setattr(codebooks, "BLOCK", 500)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(256, 8)) * 50
    rows = [(i, (centres[i % 256] + rng.normal(size=8) * 0.01).tolist(), 0) for i in range(3000)]
    scanned = []
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(2)
    assert codebooks.compress(df, scanned=scanned).count() == 3000
    assert scanned[0] == 4 * 3000 and sum(scanned[1:]) < 4 * 3000 / 2
    small = rows[:700]
    assert compressed(spark, small) == expected(small)


def test_large_components_are_exact(spark):
    rows = [(i, [float(v) for v in x], 1) for i, x in enumerate([[3e5, 1, 2, 3], [3.5e5, 1, 2, 3], [-3e5, 9, 9, 9], [2e5, 0, 0, 0]] * 80)]
    assert compressed(spark, rows) == expected(rows)


def test_heaps():
    rng = np.random.default_rng(3)
    heaps = codebooks.Heaps.of([[], [(1.0, 0), (2.0, 1)], [(0.5, 2)]])
    popped, left = heaps.pop(np.array([9.0, 1.5, 0.1]))
    assert popped == [0] and left == {1: [(2.0, 1)]}
    moved = heaps.push(left, [0], [4.0], [0])
    assert moved.heap(0) == [(4.0, 0)] and moved.heap(1) == [(2.0, 1)] and moved.heap(2) == [(0.5, 2)]
    x, entries = np.floor(rng.normal(size=(50, 3)) * 4), np.floor(rng.normal(size=(9, 3)) * 4)
    own, slack = codebooks.scan(x, entries, rows=7)
    for i, row in enumerate(x):
        d = [((row - e) ** 2).sum() for e in entries]
        assert own[i] == d.index(min(d)) and np.isclose(slack[i], math.sqrt(sorted(d)[1]) - math.sqrt(min(d)))


def test_bounds_and_empty(spark, monkeypatch):
    df = spark.createDataFrame([(1, [1.0] * 8, 1)], "vec_id long, embedding array<float>, label int")
    assert codebooks.compress(df.limit(0)).count() == 0
    monkeypatch.setattr(codebooks, "MOST_VALUES", 4)
    with pytest.raises(ValueError):
        codebooks.compress(df)
