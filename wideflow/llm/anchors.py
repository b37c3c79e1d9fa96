"""Anchors-hierarchy metric trees over points with integer coordinates (numpy only).

Built from the middle out: about sqrt(n) anchors are set one by one, each the
point furthest from the anchor of the largest ball, taking over the points that
are nearer to it than to their own; every anchor's points become a tree in the
same way, and the anchors' trees are merged bottom up, always the two whose
common ball is smallest.  A ball has a centre, a radius that no point of it
exceeds, and the cached sum and number of its points.
"""

from __future__ import annotations

import numpy as np

#: Points of a ball that is not split further.
LEAF = 24
#: Relative slack on distances, far above rounding and far below one unit.
SLACK = 1e-9


class Tree:
    """Balls as arrays: ``centre``, ``radius``, ``total`` (sum of the points),
    ``number`` (of points, copies counted), ``left`` and ``right`` (-1: a leaf)
    and ``first`` .. ``last``: the ball's points in ``order``."""

    FIELDS = ("order", "centre", "radius", "total", "number", "left", "right", "first", "last", "root")

    def __init__(self, **arrays):
        for k in self.FIELDS:
            setattr(self, k, arrays[k])

    def arrays(self) -> dict[str, np.ndarray]:
        return {k: np.asarray(getattr(self, k)) for k in self.FIELDS}


def distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    d = points - to
    return np.sqrt(np.einsum("ij,ij->i", d, d))


def _anchors(points: np.ndarray, k: int) -> list[np.ndarray]:
    """Members of up to k anchors."""
    owner = [np.arange(len(points))]
    away = [distances(points, points[0])]
    pivots = [0]
    while len(owner) < k:
        widest = max(range(len(owner)), key=lambda i: away[i].max(initial=0.0))
        if away[widest].max(initial=0.0) == 0.0:
            break                                        # every point is at its anchor
        pivot = owner[widest][away[widest].argmax()]
        mine, far = [], []
        for i in range(len(owner)):
            gap = float(np.linalg.norm(points[pivots[i]] - points[pivot]))
            # a point nearer to its anchor than half the gap can't change
            ask = np.flatnonzero(away[i] > gap / 2)
            if not len(ask):
                continue
            d = distances(points[owner[i][ask]], points[pivot])
            go = d < away[i][ask]
            mine.append(owner[i][ask[go]])
            far.append(d[go])
            stay = np.ones(len(owner[i]), dtype=bool)
            stay[ask[go]] = False
            owner[i], away[i] = owner[i][stay], away[i][stay]
        owner.append(np.concatenate(mine))
        away.append(np.concatenate(far))
        pivots.append(pivot)
    return [o for o in owner if len(o)]


def build(points: np.ndarray, weight: np.ndarray) -> Tree:
    """The tree of distinct integer ``points`` (n x dims, n > 0), each of which
    stands for ``weight`` equal ones."""
    exact = points.astype(np.float64)
    centre, radius, total, number, left, right, size = [], [], [], [], [], [], []

    def ball(members, a, b):
        w = weight[members]
        total.append((points[members] * w[:, None]).sum(axis=0))
        number.append(int(w.sum()))
        centre.append(total[-1] / number[-1])
        radius.append(distances(exact[members], centre[-1]).max() * (1 + SLACK))
        left.append(a)
        right.append(b)
        size.append(len(members))
        return len(centre) - 1

    def grow(members) -> tuple[int, np.ndarray]:
        """A ball of the members, and the members as its leaves have them."""
        if len(members) <= LEAF:
            return ball(members, -1, -1), members
        trees = [grow(members[g]) for g in _anchors(exact[members], int(len(members) ** 0.5))]
        mid = np.array([centre[t] for t, _ in trees])
        rad = np.array([radius[t] for t, _ in trees])
        alive = np.ones(len(trees), dtype=bool)

        def common(i):
            """Radius of the smallest ball around ball i and each other."""
            both = np.maximum((distances(mid, mid[i]) + rad + rad[i]) / 2, np.maximum(rad, rad[i]))
            both[~alive] = np.inf
            both[i] = np.inf
            return both

        both = np.array([common(i) for i in range(len(trees))])
        at = 0
        for _ in range(len(trees) - 1):
            at, other = divmod(int(both.argmin()), len(trees))
            (a, own), (b, more) = trees[at], trees[other]
            joined = np.concatenate((own, more))
            trees[at] = (ball(joined, a, b), joined)
            mid[at], rad[at] = centre[-1], radius[-1]
            alive[other] = False
            both[other], both[:, other] = np.inf, np.inf
            both[at] = both[:, at] = common(at)
        return trees[at]

    root, order = grow(np.arange(len(points)))
    first = np.zeros(len(centre), dtype=np.int64)
    for b in range(root, -1, -1):               # a ball is made after its halves
        if left[b] >= 0:
            first[left[b]], first[right[b]] = first[b], first[b] + size[left[b]]
    return Tree(order=order, centre=np.array(centre), radius=np.array(radius),
                total=np.array(total, dtype=np.int64), number=np.array(number, dtype=np.int64),
                left=np.array(left), right=np.array(right), first=first,
                last=first + np.array(size, dtype=np.int64), root=np.int64(root))


def owners(tree: Tree, points: np.ndarray, weight: np.ndarray, entries: np.ndarray,
           place: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sum and number of the points nearest to each of the integer ``entries``
    (ties to the lower index).  ``place``, if given, receives every point's entry.

    A ball inherits the entries that can own a point of the ball above it, and
    drops those further from its centre than the nearest by more than its
    diameter.  A ball with one entry left is wholly owned: its cached sum and
    number count, and nothing below it is visited.
    """
    exact = entries.astype(np.float64)
    sums = np.zeros(entries.shape, dtype=np.int64)
    counts = np.zeros(len(entries), dtype=np.int64)
    stack = [(int(tree.root), np.arange(len(entries)))]
    while stack:
        b, can = stack.pop()
        d = distances(exact[can], tree.centre[b])
        can = can[d <= (d.min() + 2 * tree.radius[b]) * (1 + SLACK) + SLACK]
        if len(can) == 1:
            sums[can[0]] += tree.total[b]
            counts[can[0]] += tree.number[b]
            if place is not None:
                place[tree.order[tree.first[b]:tree.last[b]]] = can[0]
        elif tree.left[b] >= 0:
            stack += [(int(tree.left[b]), can), (int(tree.right[b]), can)]
        else:
            at = tree.order[tree.first[b]:tree.last[b]]
            gap = points[at][:, None, :] - entries[can][None]
            own = can[(gap * gap).sum(axis=2).argmin(axis=1)]
            np.add.at(sums, own, points[at] * weight[at][:, None])
            np.add.at(counts, own, weight[at])
            if place is not None:
                place[at] = own
    return sums, counts
