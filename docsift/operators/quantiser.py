"""K3's coarse quantiser: nearest centroids by a tree of two levels, exactly.

The centroids are grouped around about the square root of their number of centres. A row
first meets the centroids of its ``BEAM`` nearest groups, which bounds its m-th distance;
a group then is skipped for a row if its centre's distance less its radius is beyond that
(triangle inequality). So the result is that of comparing with every centroid, while memory
is a tile of rows times the larger of a group and the number of groups, whatever the number
of centroids. Order is by squared distance rounded to 1e-9, then by number. Up to ``FLAT`` centroids a
tile of rows meets them all in one product, which the same bound on memory allows.
"""

from __future__ import annotations

import math

import numpy as np

RANK_DECIMALS = 9
TILE, BEAM, SPARE = 512, 3, 4
FLAT = 2048
# Numbers in a temporary array of differences.
NUMBERS = 1 << 21


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances by products: fast, and exact to about 1e-13 of the squared lengths."""
    d = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", c, c)[None, :] - 2.0 * (x @ c.T)
    return np.maximum(d, 0.0, out=d)


def by_differences(x: np.ndarray, c: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Squared distances of row i to ``c[at[i, j]]``, from differences."""
    out = np.empty(at.shape)
    step = max(1, NUMBERS // max(1, at.shape[1] * c.shape[1]))
    for a in range(0, len(x), step):
        out[a : a + step] = ((x[a : a + step, None, :] - c[at[a : a + step]]) ** 2).sum(axis=2)
    return out


class CentroidTree:
    def __init__(self, centroids: np.ndarray, rounds: int = 5):
        c = np.ascontiguousarray(centroids, dtype=np.float64)
        self.centroids, n = c, len(c)
        groups = max(1, math.isqrt(n))
        centres = c[np.linspace(0, n - 1, groups).astype(int)].copy()
        for _ in range(rounds):
            own = self._own(c, centres)
            count = np.bincount(own, minlength=groups)
            sums = np.zeros_like(centres)
            np.add.at(sums, own, c)
            some = count > 0
            centres[some] = sums[some] / count[some, None]
        own = self._own(c, centres)
        used = np.unique(own)
        self.centres = centres[used]
        self.members = [np.flatnonzero(own == g) for g in used]
        self.radius = np.array([np.sqrt(((c[m] - s) ** 2).sum(axis=1).max()) for m, s in zip(self.members, self.centres, strict=True)])
        self.compared = 0  # pairs (row, centroid) looked at

    @staticmethod
    def _own(c: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return np.concatenate([np.argmin(squared(c[a : a + TILE], centres), axis=1) for a in range(0, len(c), TILE)])

    def nearest(self, x: np.ndarray, m: int = 1) -> np.ndarray:
        """[n, min(m, number of centroids)] numbers of each row's nearest centroids, in order."""
        m = min(m, len(self.centroids))
        out = np.empty((len(x), m), dtype=np.int64)
        for a in range(0, len(x), TILE):
            out[a : a + TILE] = self._flat(x[a : a + TILE], m) if len(self.centroids) <= FLAT else self._tile(x[a : a + TILE], m)
        return out

    def _flat(self, x: np.ndarray, m: int) -> np.ndarray:
        c, keep = self.centroids, min(m + SPARE, len(self.centroids))
        self.compared += len(x) * len(c)
        d = np.round(squared(x, c), RANK_DECIMALS)
        if keep < len(c):
            name = np.sort(np.argpartition(d, keep - 1, axis=1)[:, :keep], axis=1)
            last = np.take_along_axis(d, name, axis=1).max(axis=1)
            tied = np.flatnonzero(np.count_nonzero(d <= last[:, None], axis=1) > keep)
            if len(tied):  # the least numbers of those as far as the last
                name[tied] = np.argsort(d[tied], axis=1, kind="stable")[:, :keep]
        else:
            name = np.broadcast_to(np.arange(len(c)), d.shape)
        exact = np.round(by_differences(x, c, name), RANK_DECIMALS)
        order = np.lexsort((name, exact), axis=1)[:, :m]
        return np.take_along_axis(name, order, axis=1)

    def _tile(self, x: np.ndarray, m: int) -> np.ndarray:
        keep, n = min(m + SPARE, len(self.centroids)), len(x)
        to_centre = np.sqrt(squared(x, self.centres))
        slack = 1e-6 * (1 + to_centre.max(initial=0))  # of products, and of the root near 0
        least = to_centre - self.radius[None, :] - slack
        dist, name = np.full((n, keep), np.inf), np.full((n, keep), -1, dtype=np.int64)
        done = np.zeros(least.shape, dtype=bool)
        beam = min(BEAM, least.shape[1])
        first = np.argpartition(least, beam - 1, axis=1)[:, :beam]
        done[np.arange(n)[:, None], first] = True
        for g in np.unique(first):
            self._meet(x, np.flatnonzero((first == g).any(axis=1)), g, dist, name)
        # Nearer groups first, so that bounds are small when far ones are reached.
        for g in np.argsort(least.mean(axis=0), kind="stable"):
            rows = np.flatnonzero(~done[:, g] & (np.maximum(least[:, g], 0.0) ** 2 <= dist[:, -1] + 2e-9))
            if len(rows):
                self._meet(x, rows, g, dist, name)
        exact = by_differences(x, self.centroids, np.maximum(name, 0))
        exact[name < 0] = np.inf
        order = np.lexsort((name, np.round(exact, RANK_DECIMALS)), axis=1)[:, :m]
        return np.take_along_axis(name, order, axis=1)

    def _meet(self, x, rows, g, dist, name) -> None:
        """Compare ``rows`` with the centroids of a group; ``dist`` and ``name`` keep the best."""
        members, keep = self.members[g], dist.shape[1]
        self.compared += len(rows) * len(members)
        step = max(1, NUMBERS // (keep + len(members)))
        for a in range(0, len(rows), step):
            r = rows[a : a + step]
            d = np.concatenate([dist[r], squared(x[r], self.centroids[members])], axis=1)
            who = np.concatenate([name[r], np.broadcast_to(members, (len(r), len(members)))], axis=1)
            order = np.lexsort((who, np.round(d, RANK_DECIMALS)), axis=1)[:, :keep]
            dist[r], name[r] = np.take_along_axis(d, order, axis=1), np.take_along_axis(who, order, axis=1)
