"""Vantage-point trees over 64-bit fingerprints: dealing by Hamming distance, triangle bounds, exact links.

A node has a vantage point v from the data and a cut c: points with d(x, v) <= c lie inside, the others outside. Whatever
lies within r of x has a distance to v that differs by r at most, so x asks the other side only if its own distance is
within r of the cut; any other branch is pruned. Over all 64 bits distances of unrelated points are 32 give or take 4, and
with r = 4 nearly every point straddles every cut. Two points within 4 bits differ in one bit at most in one of three
disjoint blocks, so there are three trees, each over the distance in one block, with r = 1; a node whose points a block
doesn't part any more goes on over all 64 bits with r = 4.

``plant`` builds the trees from a bounded sample, as deep as the number of points asks. ``Tree.route`` gives each point its
own leaf (home) and the leaves across the boundaries that it overlaps (as a guest). ``links`` searches one leaf: the same
splitting goes on between homes and guests until few are left, which are then compared. A stretch whose points all are in
one component already is left out, so a dense group costs about a spanning tree and not its square.
"""

from __future__ import annotations

import numpy as np

RADIUS = 4
BLOCKS = 3
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Points of the sample in a leaf, and pairs that are compared at once.
LEAF, PAIRS = 32, 1 << 17


def block_masks(blocks: int = BLOCKS) -> list[int]:
    """Bit masks of disjoint blocks that cover 64 bits."""
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]


def distances(fp: np.ndarray, point: np.ndarray | np.uint64, mask: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count((fp ^ point) & mask).astype(np.int64)


def best_split(fp: np.ndarray, mask: np.uint64, reach: int, tries: int = 3) -> tuple[np.uint64, int] | None:
    """(vantage point, cut) with the fewest pairs left to compare; None if no try leaves clearly fewer."""
    n, best, found = len(fp), 0.85, None
    for k in range(min(tries, n)):
        point = fp[k * n // min(tries, n)]
        upto = np.cumsum(np.bincount(distances(fp, point, mask), minlength=65)) / n
        home = upto[:64]
        guests = upto[np.minimum(np.arange(64) + reach, 64)]  # asked inside
        outer = 1 - np.where(np.arange(64) >= reach, upto[np.maximum(np.arange(64) - reach, 0)], 0)  # asked outside
        left = home * guests + (1 - home) * outer
        left[(home == 0) | (home == 1)] = 1
        cut = int(left.argmin())
        if left[cut] < best:
            best, found = left[cut], (point, cut)
    return found


def any_split(fp: np.ndarray, mask: np.uint64, reach: int, radius: int = RADIUS):
    """(vantage point, cut, mask, reach) within the block, else over all bits, else None."""
    for m, r in ((mask, reach), (ALL, radius)) if mask != ALL else ((mask, reach),):
        if found := best_split(fp, m, r):
            return (*found, m, r)
    return None


class Tree:
    """A tree from a sample; children are node numbers, or -1 - leaf."""

    def __init__(self, sample: np.ndarray, mask: int, reach: int = RADIUS // BLOCKS, leaf: int = LEAF):
        self.leaves = 0
        nodes: list[list] = []

        def new_leaf() -> int:
            self.leaves += 1
            return -self.leaves

        todo = [(np.sort(sample), np.uint64(mask), reach, None, 0)]
        self.root = None
        while todo:
            fp, m, r, parent, side = todo.pop()
            cut = any_split(fp, m, r) if len(fp) > leaf else None
            if cut is None:
                at = new_leaf()
            else:
                at = len(nodes)
                nodes.append([cut[0], cut[1], cut[2], cut[3], 0, 0])
                inside = distances(fp, cut[0], cut[2]) <= cut[1]
                todo += [(fp[inside], cut[2], cut[3], at, 4), (fp[~inside], cut[2], cut[3], at, 5)]
            if parent is None:
                self.root = at
            else:
                nodes[parent][side] = at
        kinds = (np.uint64, np.int64, np.uint64, np.int64, np.int64, np.int64)
        self.point, self.cut, self.mask, self.reach, self.inner, self.outer = (np.array([x[k] for x in nodes], t) for k, t in enumerate(kinds))

    def route(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
        """(leaf, place in ``fp``, whether at home) of each point in its leaves; branches met and branches pruned."""
        node, at, home = np.full(len(fp), self.root, np.int64), np.arange(len(fp)), np.ones(len(fp), bool)
        out, met, pruned = [], 0, 0
        while len(node):
            done = node < 0
            if done.any():
                out.append((-1 - node[done], at[done], home[done]))
                node, at, home = node[~done], at[~done], home[~done]
                if not len(node):
                    break
            d, cut, reach = distances(fp[at], self.point[node], self.mask[node]), self.cut[node], self.reach[node]
            inside, go_in, go_out = d <= cut, d <= cut + reach, d > cut - reach
            met += 2 * len(node)
            pruned += 2 * len(node) - int(go_in.sum()) - int(go_out.sum())
            node, at, home = np.concatenate([self.inner[node][go_in], self.outer[node][go_out]]), np.concatenate([at[go_in], at[go_out]]), np.concatenate([(home & inside)[go_in], (home & ~inside)[go_out]])
        leaf, place, own = (np.concatenate([x[k] for x in out]) for k in range(3)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
        return leaf, place, own, met, pruned


def plant(sample: np.ndarray, leaf: int = LEAF) -> list[Tree]:
    """The three trees of a sample."""
    return [Tree(sample, mask, leaf=leaf) for mask in block_masks()]


class Forest:
    """Components of the points of a leaf."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, i: np.ndarray) -> np.ndarray:
        r = self.parent[i]
        while not np.array_equal(up := self.parent[r], r):
            r = up
        self.parent[i] = r
        return r

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.roots(a), self.roots(b)
        differ = a != b
        if not differ.any():
            return
        n, parent = len(self.parent), self.parent
        for key in np.unique(np.minimum(a, b)[differ] * n + np.maximum(a, b)[differ]).tolist():
            x, y = divmod(key, n)
            while parent[x] != x:
                x = parent[x]
            while parent[y] != y:
                y = parent[y]
            parent[max(x, y)] = min(x, y)


def links(fp: np.ndarray, home: np.ndarray, mask: int, reach: int = RADIUS // BLOCKS, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray, int]:
    """(a, b) that connect every home point of a leaf to all within ``radius``, and how many pairs were compared."""
    forest, compared = Forest(len(fp)), 0
    order = np.argsort(fp, kind="stable")
    todo = [(order[home[order]], order, np.uint64(mask), reach)]

    def compare(h: np.ndarray, q: np.ndarray) -> int:
        wide = len(q) if len(h) * len(q) <= PAIRS else 256
        step, n = max(1, PAIRS // max(1, wide)), 0
        for a in range(0, len(h), step):
            for b in range(0, len(q), wide):
                x, y = h[a : a + step], q[b : b + wide]
                r = forest.roots(np.concatenate([x, y]))
                if (r == r[0]).all():
                    continue
                hit = np.flatnonzero(np.bitwise_count(fp[x][:, None] ^ fp[y][None, :]).ravel() <= radius)
                n += len(x) * len(y)
                i, j = x[hit // len(y)], y[hit % len(y)]
                if (i != j).any():
                    forest.join(i, j)
        return n

    while todo:
        h, q, m, r = todo.pop()
        if not len(h) or len(q) < 2:
            continue
        cut = None
        if len(h) * len(q) > PAIRS:
            some = forest.roots(q)
            if (some == some[0]).all():
                continue
            cut = any_split(fp[h] if len(h) <= 2048 else fp[h[:: len(h) // 1024]], m, r, radius)
        if cut is None:
            compared += compare(h, q)
            continue
        point, c, m, r = cut
        dh, dq = distances(fp[h], point, m), distances(fp[q], point, m)
        todo += [(h[dh <= c], q[dq <= c + r], m, r), (h[dh > c], q[dq > c - r], m, r)]
    root = forest.roots(np.arange(len(fp)))
    own = np.flatnonzero(root != np.arange(len(fp)))
    return fp[own], fp[root[own]], compared
