import hashlib
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from canopy.llm import mixing

SCHEMA = "doc_id long, text string, source string, size long, target string, place int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shares(sizes):
    """Targets of sources in their order: the excess above three times a size is shared out again until none is above."""
    total, capped = sum(sizes), set()
    while True:
        rest, weighed = total - sum(3 * sizes[i] for i in capped), sum(i % 3 + 1 for i in range(len(sizes)) if i not in capped)
        out = [3 * s if i in capped else (i % 3 + 1) * rest / weighed for i, s in enumerate(sizes)]
        more = {i for i, s in enumerate(sizes) if i not in capped and out[i] > 3 * s}
        if not more:
            return out
        capped |= more


def mixed(rows):
    sizes = [(d, len(WORD.findall(t or "")), s) for d, t, s in rows]
    sources = sorted({s for *_, s in sizes}, key=lambda s: (s is None, (s or "").encode()))
    totals = [sum(n for _, n, s in sizes if s == own) for own in sources]
    goal = shares(totals) if sum(totals) else [0.0] * len(sources)
    out = []
    for own, size, target in zip(sources, totals, goal):
        draw = lambda r: (hashlib.md5("/".join(["0"] + [str(r[0])] * (r[0] is not None)).encode()).hexdigest(), r[0] is not None, r[0] or 0, r[1])
        at = 0
        for d, n, _ in sorted((r for r in sizes if r[2] == own), key=draw):
            taken = sum(max(0, min(n, int(target + 0.5) - turn * size - at)) for turn in range(3))
            out.append((d, n, size, round(target, 6), taken))
            at += n
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, "clash", 1) for r in rows], SCHEMA).repartition(3)


ROWS = [(i, " ".join(["w"] * (i * 7 % 23)), f"s{i % 5}") for i in range(120)]
ROWS += [(200, None, "s0"), (201, "", None), (202, "a b c", None), (203, "w " * 3000, "hot"), (203, "w " * 3000, "hot"), (204, "x", "Z"), (204, "x y", "Z"), (None, "n n", "Z"), (205, "\x1cy\x0bz", "é")]
ROWS += [(300 + i, "h " * 40, "hot") for i in range(60)]


def test_against_brute_force(spark):
    got = [(r[0], r[1], r[2], round(r[3], 6), r[4]) for r in mixing.taken(table(spark, ROWS)).collect()]
    assert sorted(got, key=str) == mixed(ROWS)


def test_reruns_agree(spark):
    once, again = (sorted((tuple(r) for r in mixing.taken(df).collect()), key=str) for df in (table(spark, ROWS), table(spark, ROWS[::-1]).repartition(7)))
    assert once == again


def test_pieces_are_the_mix(spark):
    """Slots are filled without gaps, sources stand in proportion in every stretch, and pieces read each word of a pass once."""
    block = 16
    pieces, documents = mixing.mix(table(spark, ROWS), block=block)
    rows, docs = [r.asDict() for r in pieces.collect()], {r["row"]: r.asDict() for r in documents.collect()}
    assert all(0 <= r["start"] and r["start"] + r["length"] <= docs[r["row"]]["size"] and r["length"] > 0 for r in rows)
    slots: dict = {}
    for r in sorted(rows, key=lambda r: (r["slot"], r["at"])):
        own = slots.setdefault(r["slot"], [r["place"], 0])
        assert own == [r["place"], r["at"]]
        own[1] += r["length"]
    by_place: dict = {}
    for slot, (place, n) in slots.items():
        by_place.setdefault(place, []).append((slot, n))
    # all blocks but one of a source are full
    assert all(sum(n != block for _, n in own) <= 1 for own in by_place.values())
    wide = 1 << (max(slots) - 1).bit_length()
    for own in by_place.values():
        for a in range(0, wide, wide // 4):
            inside = sum(a <= slot < a + wide // 4 for slot, _ in own)
            assert abs(inside - len(own) / 4) <= 2


def test_targets(spark):
    sizes = [5, 100, 1000, 3, 40, 0, 7]
    df = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    assert [round(got[f"s{i}"], 9) for i in range(7)] == [round(t, 9) for t in shares(sizes)]


@given(st.integers(0, 20), st.data())
def test_reversed_bits_is_its_own_inverse(bits, data):
    n = data.draw(st.integers(0, (1 << bits) - 1))
    back = lambda v: int(format(v, f"0{bits}b")[::-1], 2) if bits else 0
    assert back(back(n)) == n


def test_reversed_bits(spark):
    got = spark.range(16).select(mixing.reversed_bits(F.col("id"), 4).alias("r")).collect()
    assert [r[0] for r in got] == [int(format(i, "04b")[::-1], 2) for i in range(16)]


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "a", None)], [(1, "", "a"), (2, " ", "b")]])
def test_small(spark, rows):
    got = [(r[0], r[1], r[2], round(r[3], 6), r[4]) for r in mixing.taken(table(spark, rows)).collect()]
    assert sorted(got, key=str) == mixed(rows)
