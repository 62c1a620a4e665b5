"""Random-projection forest searched through one priority queue over the leaves of all its trees.

The trees are fitted on a bounded sample (``ForestConfig.sample_rows``); every row of the table is
routed.  A node of more than ``leaf_max`` expected rows is always cut, so that the work of a vector does
not grow with the group that it lies in; a node of more than ``leaf_rows`` is cut where a plane lowers the
expected work.  A plane lies between the means of two random groups of the node's sample; of several
such planes the one that promises the least work is taken.

The queue of a vector holds the leaves of all trees.  A leaf's priority is the chance that a
neighbour lies in it: over the planes of its path, the product of the chances that a neighbour lies
on the leaf's side.  That follows from the vector's distance to the plane and the standard deviation of the
step to a neighbour along any one direction: ``step`` over the root of the number of dimensions that steps take,
which is estimated from the sample (:func:`dimensions`).  Leaves are popped, the home in the first tree
first, until the chance that the popped leaves of all trees lack a neighbour is at most ``miss``.
There is no limit on the number of leaves; a vector far from all planes visits one.  The search goes down all
trees at once and only where a chance is left, so it costs a product with the planes, one for each leaf, and few steps
down.

In a leaf, the visitors are compared with the rows at home there, not with each other, and a pair counts for
both its rows.  A leaf with many visitors is several tasks, each with all rows at home and a part of the
visitors, so no task outgrows a bound.  What no plane can part are copies of one vector; see
:mod:`winnow.llm.buckets`.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: The slope at which the logistic curve is nearest to the normal distribution.
LOGISTIC = 1.702


@dataclass(frozen=True)
class ForestConfig:
    """Parameters of the forest.

    ``sample_rows`` and ``sample_most`` bound what the driver sees: the sample has ``sample_rows`` vectors, or
    ``leaf_sample`` for each leaf that the table needs, up to ``sample_most``.  ``step`` is the distance of two unit vectors that are to be
    neighbours, 0.4 at a cosine of 0.92.
    """

    dim: int = 64
    trees: int = 2
    step: float = 0.4
    miss: float = 0.1
    sample_rows: int = 20_000
    sample_most: int = 200_000
    leaf_sample: int = 48
    leaf_rows: int = 4_096
    leaf_max: int = 8_192
    planes: int = 24
    min_sample: int = 24
    gain: float = 0.9
    copy_cost: float = 0.35
    max_depth: int = 60
    seed: int = 7


#: Elements of the table of distances to planes that routing holds at once.
ELEMENTS = 16_000_000


@dataclass
class Forest:
    """The trees: for each plane its two children, the one on the plane's side first, a plane's number or, below
    zero, -1 - leaf; and for each tree its root, given likewise."""

    planes: np.ndarray
    offsets: np.ndarray
    children: np.ndarray
    roots: np.ndarray
    tree_of_leaf: np.ndarray
    expected_rows: np.ndarray
    expected_visits: np.ndarray
    spread: float
    config: ForestConfig = field(default_factory=ForestConfig)

    @property
    def leaves(self) -> int:
        return len(self.tree_of_leaf)

    def route(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, home) of every visit; home tells whether the leaf is the vector's own in its tree, the one on
        whose side of every plane it lies."""
        step = max(1, ELEMENTS // max(1, len(self.planes)))
        parts = [self._route(x[at : at + step]) for at in range(0, len(x), step)]
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        rows, leaves, homes = zip(*parts, strict=True)
        return np.concatenate([r + k * step for k, r in enumerate(rows)]), np.concatenate(leaves), np.concatenate(homes)

    def _route(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, leaf, chance, home = self._candidates(x)
        chance = np.exp(chance, dtype=np.float64)
        tree = self.tree_of_leaf[leaf]
        first = home & (tree == 0)
        order = np.lexsort((-chance, ~first, row))
        row, leaf, chance, home, tree = row[order], leaf[order], chance[order], home[order], tree[order]
        start = np.maximum.accumulate(np.where(np.r_[True, row[1:] != row[:-1]], np.arange(len(row)), 0))
        lacking = np.ones(len(row))
        for t in range(len(self.roots)):
            own = np.where(tree == t, chance, 0.0)
            before = np.cumsum(own) - own
            lacking *= np.maximum(1 - (before - before[start]), 0.0)
        popped = (start == np.arange(len(row))) | (lacking > self.config.miss)
        return row[popped], leaf[popped], home[popped]

    def _candidates(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, logarithm of the chance, home) of the leaves whose chance is not below a twentieth of ``miss``,
        and of all homes.  All rows go down the trees together, a level at a time, and only where a chance is left."""
        n = len(x)
        z = (x @ self.planes.T - self.offsets) * np.float32(LOGISTIC / self.spread)
        np.clip(z, -60, 60, out=z)
        least = np.float32(np.log(self.config.miss / 20)) if self.config.miss > 0 else np.float32(-np.inf)
        row = np.tile(np.arange(n), len(self.roots))
        node = np.repeat(self.roots, n)
        chance, own = np.zeros(len(row), np.float32), np.ones(len(row), bool)
        found = []
        while len(row):
            done = node < 0
            found.append((row[done], -1 - node[done], chance[done], own[done]))
            row, node, chance, own = row[~done], node[~done], chance[~done], own[~done]
            d = z[row, node]
            right = chance - np.log1p(np.exp(-d))
            left = right - d
            on = d >= 0
            a, b = (right >= least) | (own & on), (left >= least) | (own & ~on)
            row = np.r_[row[a], row[b]]
            chance = np.r_[right[a], left[b]]
            own = np.r_[(own & on)[a], (own & ~on)[b]]
            node = np.r_[self.children[node[a], 0], self.children[node[b], 1]]
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def fit_forest(sample: np.ndarray, rows: int, config: ForestConfig) -> Forest:
    """Fit the trees on a sample of unit vectors of a table of ``rows`` rows."""
    sample = np.ascontiguousarray(sample, np.float32)
    planes: list[np.ndarray] = []
    offsets: list[float] = []
    children: list[list[int]] = []
    roots: list[int] = []
    trees: list[int] = []
    expected: list[float] = []
    scale = rows / max(1, len(sample))
    spread = max(1e-6, config.step / np.sqrt(dimensions(sample)))
    for tree in range(config.trees):
        rng = np.random.default_rng(config.seed + 1000 * tree)
        stack: list[tuple[np.ndarray, int, int, int]] = [(np.arange(len(sample)), 0, -1, 0)]  # rows, depth, parent, side
        while stack:
            members, depth, parent, side = stack.pop()
            cut = None
            if len(members) * scale > config.leaf_rows and len(members) >= config.min_sample and depth < config.max_depth:
                cut = _best_cut(sample[members], rng, config, spread, len(members) * scale > config.leaf_max)
            if cut is None:
                node = -1 - len(trees)
                trees.append(tree)
                expected.append(len(members) * scale)
            else:
                node = len(planes)
                right = sample[members] @ cut[0] >= cut[1]
                planes.append(cut[0])
                offsets.append(cut[1])
                children.append([0, 0])
                stack.append((members[right], depth + 1, node, 0))
                stack.append((members[~right], depth + 1, node, 1))
            if parent < 0:
                roots.append(node)
            else:
                children[parent][side] = node
    dim = sample.shape[1] if sample.ndim == 2 and sample.shape[1] else config.dim
    forest = Forest(
        np.array(planes, np.float32).reshape(len(planes), dim),
        np.array(offsets, np.float32),
        np.array(children, np.int64).reshape(len(planes), 2),
        np.array(roots),
        np.array(trees),
        np.array(expected),
        np.array(expected),
        spread,
        config,
    )
    visits = np.zeros(forest.leaves)
    for at in range(0, len(sample), 4096):
        visits += np.bincount(forest.route(sample[at : at + 4096])[1], minlength=forest.leaves)
    forest.expected_visits = visits * scale
    return forest


def dimensions(sample: np.ndarray, most: int = 1_000) -> float:
    """The number of dimensions that the steps to nearest neighbours take in a sample of unit vectors, by the
    participation ratio of their covariance; copies take none."""
    if len(sample) < 2:
        return float(max(1, sample.shape[1] if sample.ndim == 2 else 1))
    few = sample[:: max(1, len(sample) // most)]
    s = few @ sample.T
    s[s > 1 - 1e-6] = -2.0  # itself and copies
    step = sample[np.argmax(s, axis=1)] - few
    step = step[s.max(axis=1) > -2.0].astype(np.float64)
    length = np.sqrt((step**2).sum(axis=1))
    step = step[length > 0] / length[length > 0, None]
    if not len(step):
        return float(sample.shape[1])
    values = np.linalg.eigvalsh(step.T @ step / len(step))
    return float(max(1.0, values.sum() ** 2 / (values**2).sum()))


def _best_cut(x: np.ndarray, rng: np.random.Generator, config: ForestConfig, spread: float, always: bool):
    """The plane with the least expected work of the children, or None if none is worth it.  With ``always`` any
    plane is, if it puts a fifth of the rows on either side."""
    best, found = np.inf if always else config.gain, None
    n = len(x)
    reach = 1.5 * spread
    for _ in range(config.planes):
        part = x[rng.choice(n, min(n, 256), replace=False)]
        means = part[rng.choice(len(part), 2, replace=False)]
        for _ in range(3):
            side = part @ (means[0] - means[1]) > (means[0] @ means[0] - means[1] @ means[1]) / 2
            if side.all() or not side.any():
                break
            means = np.stack([part[side].mean(0), part[~side].mean(0)])
        normal = means[0] - means[1]
        length = np.linalg.norm(normal)
        if length < 1e-6:
            continue
        normal = (normal / length).astype(np.float32)
        z = np.sort(x @ normal)
        at = np.r_[np.linspace(z[0], z[-1], 66)[1:-1], np.quantile(z, [0.3, 0.4, 0.5, 0.6, 0.7])].astype(np.float32)
        below = np.searchsorted(z, at) / n
        low, high = np.searchsorted(z, at - reach) / n, np.searchsorted(z, at + reach) / n
        work = high**2 + (1 - low) ** 2 + config.copy_cost * (high - low)
        if always:
            work[(below < 0.2) | (below > 0.8)] = np.inf
        k = int(np.argmin(work))
        if work[k] < best:
            best, found = work[k], (normal, at[k])
    return found
