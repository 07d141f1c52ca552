"""The climb by the sets around each edge, against interchanges scored one by one."""

import copy
import random

import numpy as np
import pytest

from canopy.operators import build
from canopy.sources import newick


def grown(rng, names, top):
    """A tree of pairs with so many children below the root."""
    parts = [newick.Clade(name=n) for n in names]
    while len(parts) > top:
        a = parts.pop(rng.randrange(len(parts)))
        b = parts.pop(rng.randrange(len(parts)))
        parts.append(newick.Clade(children=[a, b]))
    return newick.Clade(children=parts)


@pytest.mark.parametrize("top", [2, 3])
def test_climb_takes_the_same_steps(top):
    rng = random.Random(top)
    for n in (2, 3, 4, 5, 9, 25, 40):
        for letters, width in (("A", 3), ("AC", 9), ("ACGT-", 14), ("".join(map(chr, range(60, 160))), 7)):
            if n < top:
                continue
            seqs = {f"s{i:02}": "".join(rng.choice(letters) for _ in range(width)) for i in range(n)}
            clade = grown(rng, list(seqs), top)
            states = build.symbol_sets(seqs)
            start, want = build.fitch(clade, states), []
            for _ in build.interchanges(clade):
                want.append(build.fitch(clade, states) - start)
            scored = build.Interchanges(clade, seqs)
            assert [g for c in scored.order() for g, *_ in scored.gains(c)] == want
            slow, changes = build.climb_by_paths(copy.deepcopy(clade), states)
            fast, found = build.climb(clade, seqs)
            assert (newick.write(fast), found) == (newick.write(slow), changes)


def test_climb_of_many_sequences(monkeypatch):
    """500 random sequences: no interchange is scored along its way to the root (before, some million were)."""
    monkeypatch.setattr(build.Changes, "rescored", lambda *_: pytest.fail("scored along the way to the root"))
    rng = random.Random(1)
    names = [f"s{i:03}" for i in range(500)]
    seqs = {n: "".join(rng.choice("0123456789abcdef") for _ in range(32)) for n in names}
    clade = build.agglomerate(names, build.difference(list(seqs.values()), list(seqs.values())))
    before = build.fitch(clade, build.symbol_sets(seqs))
    assert np.less(build.climb(clade, seqs)[1], before)
