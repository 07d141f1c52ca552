"""Merges of averaging and neighbour joining on profiles, for datasets whose matrix no task holds.

The share of columns in which two sequences differ is 1 less the product of their columns' symbols, and both ways of merging take means of distances, less a height in
neighbour joining. So a cluster is the mean of its members' symbols (a profile) and a height, and any distance is a product of two profiles: memory grows with the
sequences, not with their pairs. Each cluster lists its nearest few and a bound that no other falls below; rows are scanned anew only where the bound is reached.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd

from canopy.operators.matrices import symbols

#: Neighbours that a cluster lists, at most, and at least after a scan.
LISTED, SOUGHT = 32, 24
#: Cells of a block of rows that are scanned at once.
CELLS = 2_000_000
#: What products of single precision may be off.
OFF = 1e-5


def one_hot(seqs: Sequence[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Equally long sequences as profiles, a place for each symbol of a column, and the bits of their symbols as planes of words, so that all symbols of 64 columns are compared at once."""
    width = len(seqs[0])
    table = symbols(seqs, width, 0)
    codes = np.empty(table.shape, np.int64)
    places, at = [], 0
    for c in range(width):
        known, codes[:, c] = np.unique(table[:, c], return_inverse=True)
        places.append(at)
        at += len(known)
    out = np.zeros((len(seqs), at))
    for c, start in enumerate(places):
        out[np.arange(len(seqs)), start + codes[:, c]] = 1
    kind, each = (np.uint32, 32) if width <= 32 else (np.uint64, 64)
    bits = max(int(codes.max(initial=0)).bit_length(), 1)
    planes = []
    for first in range(0, width, each):
        own = codes[:, first : first + each].astype(kind)
        planes.append(np.stack([np.bitwise_or.reduce((own >> kind(b) & kind(1)) << np.arange(own.shape[1], dtype=kind), axis=1) for b in range(bits)]))
    return out, planes


class Clusters:
    """The clusters of a round, a row each; equal sequences that are not merged yet are copies of one row. names are numbers in their order."""

    def __init__(self, seqs: Sequence[str], joining: bool, weighted: bool = False):
        groups: dict[str, list[int]] = {}
        for at, s in enumerate(seqs):
            groups.setdefault(s, []).append(at)
        self.joining, self.weighted, self.width, n = joining, weighted and not joining, len(seqs[0]), len(groups)
        self.scale, self.turn, self.out = max(self.width, 1), 0, []
        self.p, self.planes = one_hot(list(groups))
        self.q = self.p.astype(np.float32)
        self.square = np.full(n, float(self.width))
        self.name = np.array([g[0] for g in groups.values()])
        self.height, self.size, self.alive = np.zeros(n), np.ones(n), np.ones(n, bool)
        self.spare: list[list[int]] = [[] for _ in range(n)]
        if joining:
            self.spare = [g[:0:-1] for g in groups.values()]  # the next one is the last
        else:  # equal sequences are nearest to each other, and their mean is as they are
            self.out = [(t, g[0], x, 0.0) for g in groups.values() for t, x in enumerate(g[1:])]
            self.turn, self.size = max(map(len, groups.values())) - 1, np.array([float(len(g)) for g in groups.values()])
        self.copies = np.array([len(s) + 1 for s in self.spare])
        self.other, self.far = np.zeros((n, LISTED), np.int32), np.full((n, LISTED), np.inf, np.float32)
        self.bound, self.moved = np.full(n, -np.inf), 0.0
        self.u = np.zeros(n)

    def totals(self) -> None:
        """u: what a row's sum of distances takes off its scores, without the heights, which cancel out."""
        before = self.u
        if self.joining:
            m, own = self.copies[self.alive].sum(), self.copies * self.alive
            sums = self.p @ (own @ self.p)
            rest = (m - 1) * (self.width > 0) - self.height[self.alive].sum() - (sums - self.square) / self.scale
            self.u = np.where(self.alive, rest / (m - 2) if m > 2 else self.height, -np.inf)
        else:
            self.u = np.where(self.alive, 0.0, -np.inf)
        if self.alive.any():
            # no score falls by more than this
            self.moved += float((self.u[self.alive] - before[self.alive]).max())

    def products(self, rows: np.ndarray) -> np.ndarray:
        """The distances (without heights) of rows to all."""
        if self.planes is None:
            out = self.q[rows] @ self.q.T
            out *= np.float32(-1 / self.scale)
            out += np.float32(self.width / self.scale)
            return out
        out = np.zeros((len(rows), len(self.p)), np.float32)
        for own in self.planes:  # no merge so far
            step = max(1, 65_536 // len(self.p))
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                unlike = own[0, part, None] ^ own[0]
                for plane in own[1:]:
                    unlike |= plane[part, None] ^ plane
                out[at : at + step] += np.bitwise_count(unlike)
        out /= self.scale
        return out

    def exact(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        for at in range(0, len(x), 4096):
            out[at : at + 4096] = np.einsum("ij,ij->i", self.p[x[at : at + 4096]], self.p[y[at : at + 4096]])
        return (self.width - out) / self.scale

    def first(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of pairs by x, each x with its best y and the score; equal scores go by the names."""
        score = np.round(self.exact(x, y) - self.u[x] - self.u[y], 9) if self.joining else np.round(self.exact(x, y), 12)
        a, b = self.name[x], self.name[y]
        order = np.lexsort((np.maximum(a, b), np.minimum(a, b), score, x))
        order = order[np.unique(x[order], return_index=True)[1]]
        return x[order], y[order], score[order]

    def listed(self, rows: np.ndarray, v: np.ndarray) -> None:
        """Lists the nearest of rows by their scores v to all, and the bound of the others."""
        n = v.shape[1]
        if n > 4 * LISTED:
            parts = max(2 * LISTED, n // 64)
            least = v[:, : n // parts * parts].reshape(len(rows), -1, parts).min(axis=1)
            most = np.partition(least, SOUGHT, axis=1)[:, SOUGHT]
        else:
            most = np.full(len(rows), np.inf, np.float32)
        found = np.flatnonzero(v <= most[:, None])
        row, col = np.divmod(found, n)
        value = v.ravel()[found]
        kept = np.isfinite(value)
        row, col, value = row[kept], col[kept], value[kept]
        order = np.lexsort((value, row))
        row, col, value = row[order], col[order], value[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        bound = most.astype(float)
        over = place == LISTED
        bound[row[over]] = value[over]
        self.bound[rows] = bound + self.moved
        self.far[rows] = np.inf
        kept = place < LISTED
        row, col, place, value = row[kept], col[kept], place[kept], value[kept]
        self.other[rows[row], place] = col
        self.far[rows[row], place] = value + self.u[col]

    def scanned(self, rows: np.ndarray):
        """Blocks of rows with their distances and scores (less their own u) to all; rows scan no row that is gone, nor themselves."""
        step = max(1, CELLS // len(self.p))
        for at in range(0, len(rows), step):
            own = rows[at : at + step]
            g = self.products(own)
            v = g - self.u.astype(np.float32)
            v[np.arange(len(own)), own] = np.inf
            yield own, g, v

    def nearest(self) -> tuple[np.ndarray, np.ndarray]:
        """Each row's best other row (its own number where it has none), and the scores of rows that have copies."""
        rows = np.flatnonzero(self.alive)
        best, score = np.arange(len(self.p)), np.full(len(self.p), np.inf)
        v = self.far[rows] - self.u[self.other[rows]].astype(np.float32)
        v[np.isnan(v)] = np.inf
        least = v.min(axis=1)
        known = least + 2 * OFF < self.bound[rows] - self.moved
        known |= np.isinf(self.bound[rows]) & (self.bound[rows] > 0)

        def settle(own: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
            """x and y are candidates, those of own in their order."""
            n = np.bincount(np.searchsorted(own, x), minlength=len(own))
            many = np.repeat((n > 1) | (self.copies[own] > 1), n)
            best[x[~many]] = y[~many]
            if many.any():
                a, b, s = self.first(x[many], y[many])
                best[a], score[a] = b, s

        own, v, least = rows[known], v[known], least[known]
        x, place = np.nonzero((v <= least[:, None] + OFF) & np.isfinite(v))
        settle(own, own[x], self.other[own[x], place])
        for own, _, v in self.scanned(rows[~known]):
            self.listed(own, v)
            least = v.min(axis=1)
            found = np.flatnonzero((v <= least[:, None] + OFF) & np.isfinite(v))
            x, y = np.divmod(found, v.shape[1])
            settle(own, own[x], y)
        return best, score

    def merge(self) -> None:
        """A round: all that are each other's best."""
        best, score = self.nearest()
        copied = np.flatnonzero(self.alive & (self.copies > 1))
        for x in copied:  # two copies of a row, unless another row is as near and its name comes before
            y, a, b = best[x], self.name[x], self.spare[x][-1]
            own = (float(np.round(-2 * self.u[x], 9)), a, b)
            if y == x or own <= (score[x], min(a, self.name[y]), max(a, self.name[y])):
                best[x] = x
        m = int(self.copies[self.alive].sum())
        rows = np.flatnonzero(self.alive)
        i = rows[(best[best[rows]] == rows) & (self.name[rows] < self.name[best[rows]])]
        j = best[i]
        same = copied[best[copied] == copied]
        g = self.exact(i, j)
        if self.joining:
            own, r = g - self.height[i] - self.height[j], self.u - self.height
            half = (own + r[i] - r[j]) / 2
            self.out += [(self.turn, x, y, None if m == 2 else h, d if m == 2 else d - h) for x, y, d, h in zip(self.name[i], self.name[j], own, half)]
            self.out += [(self.turn, self.name[x], self.spare[x].pop(), None if m == 2 else 0.0, 0.0) for x in same]
            self.copies[same] -= 1
            self.height[i] = (self.height[i] + self.height[j] + own) / 2
        else:
            self.out += [(self.turn, x, y, d) for x, y, d in zip(self.name[i], self.name[j], g)]
        self.turn += 1
        share = self.size[i] / (self.size[i] + self.size[j]) if self.weighted else np.full(len(i), 0.5)
        leaves = [(y, x if self.copies[x] > 1 else y) for x, y in zip(i, j) if self.copies[x] > 1 or self.copies[y] > 1]
        rest = [(to, self.spare[at], self.p[at].copy()) for to, at in leaves]  # copies that stay behind take the second row
        for at in range(0, len(i), 4096):
            x, y, s = i[at : at + 4096], j[at : at + 4096], share[at : at + 4096, None]
            self.p[x] = self.p[x] * s + self.p[y] * (1 - s)
            self.q[x] = self.p[x]
            self.square[x] = np.einsum("ij,ij->i", self.p[x], self.p[x])
        self.size[i] += self.size[j]
        for x in i:
            self.spare[x] = []
        self.copies[i], self.copies[j], self.alive[j] = 1, 1, False
        for to, spare, p in rest:
            self.p[to], self.q[to], self.square[to], self.height[to], self.alive[to] = p, p, float(self.width), 0.0, True
            self.name[to], self.spare[to], self.copies[to] = spare[-1], spare[:-1], len(spare)
        changed = np.concatenate([i, np.array([to for to, *_ in rest], np.int64)]).astype(np.int64)
        if len(changed):
            self.planes = None
        self.renewed(changed, np.setdiff1d(j, changed))

    def renewed(self, changed: np.ndarray, gone: np.ndarray) -> None:
        """Lists and bounds after a round: changed rows are scanned, and stand in the lists of others where they are within the bounds."""
        old = np.zeros(len(self.p), bool)
        old[changed] = old[gone] = True
        self.far[old[self.other]] = np.inf
        if self.alive.sum() < 0.8 * len(self.p):
            changed = self.moved_up(changed)
            old = np.zeros(len(self.p), bool)
            old[changed] = True
        self.totals()
        quiet = self.alive & ~old
        for own, g, v in self.scanned(changed):
            self.listed(own, v)
            g -= self.u[own].astype(np.float32)[:, None]
            most = np.where(quiet, self.bound - self.moved, -np.inf).astype(np.float32)
            found = np.flatnonzero(g < most)
            new, row = np.divmod(found, g.shape[1])
            self.entered(row, own[new], g.ravel()[found])

    def entered(self, row: np.ndarray, new: np.ndarray, value: np.ndarray) -> None:
        """Rows list new neighbours in place of those that are gone, or of their farthest."""
        order = np.argsort(row, kind="stable")
        row, new, value = row[order], new[order], value[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        for at in range(int(place.max(initial=-1)) + 1):
            now = place == at
            x, y, v = row[now], new[now], value[now]
            own = self.far[x] - self.u[self.other[x]].astype(np.float32)
            own[np.isnan(own)] = np.inf
            worst = own.argmax(axis=1)
            most = own[np.arange(len(x)), worst]
            # what is left out is no nearer than the bound
            dropped = np.maximum(most, v).astype(float)
            self.bound[x] = np.where(np.isinf(dropped), self.bound[x], np.minimum(self.bound[x], dropped + self.moved))
            taken = v < most
            x, y, v, worst = x[taken], y[taken], v[taken], worst[taken]
            self.other[x, worst] = y
            self.far[x, worst] = v + self.u[y]

    def moved_up(self, changed: np.ndarray) -> np.ndarray:
        """Only rows that are left stay, moved up in place; returns where changed are now."""
        rows = np.flatnonzero(self.alive)
        to = np.zeros(len(self.p), np.int64)
        to[rows] = np.arange(len(rows))
        for table in (self.p, self.q, self.other, self.far):
            for at in range(0, len(rows), 1024):
                table[at : at + 1024][: len(rows) - at] = table[rows[at : at + 1024]]
        self.p, self.q, self.far = self.p[: len(rows)], self.q[: len(rows)], self.far[: len(rows)]
        self.other = to[self.other[: len(rows)]].astype(np.int32)
        for key in ("square", "name", "height", "size", "copies", "bound", "u", "alive"):
            setattr(self, key, getattr(self, key)[rows])
        self.spare = [self.spare[x] for x in rows]
        return to[changed]

    def left(self) -> int:
        return int(self.copies[self.alive].sum())


def profile_merges(names: Sequence[str], seqs: Sequence[str], method: str, weighted: bool = False) -> pd.DataFrame:
    """The merges of ``averaged`` or ``joined`` (round, a, b and dist, or length_a and length_b) for sorted names and their equally long sequences, without a matrix."""
    columns = ["round", "a", "b", "dist"] if method == "upgma" else ["round", "a", "b", "length_a", "length_b"]
    if len(names) < 2:
        return pd.DataFrame([], columns=columns)
    clusters = Clusters(seqs, method == "nj", weighted)
    clusters.totals()
    while clusters.left() > 1:
        clusters.merge()
    out = pd.DataFrame(clusters.out, columns=columns)
    names = np.array(names, object)
    return out.assign(a=names[out["a"].to_numpy(np.int64)], b=names[out["b"].to_numpy(np.int64)])
