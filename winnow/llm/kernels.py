"""Exact comparison of the vectors of one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Elements of one block of the similarity matrix; it stays in a core's share of the cache.
BLOCK = 1_000_000
#: Parts of a similarity that is rounded to six decimals.
MICRO = 1_000_000
#: More than the error of a single-precision product of unit vectors.
SLACK = 1e-5


def exact(a: np.ndarray, b: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Cosines of the pairs (row of a, col of b), unit vectors in double precision."""
    out = np.empty(len(row))
    for at in range(0, len(row), 100_000):
        s = slice(at, at + 100_000)
        out[s] = np.einsum("ij,ij->i", a[row[s]], b[col[s]])
    return out


def best(a: np.ndarray, b: np.ndarray, k: int, floor: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, col) of candidates: for each row of a at least its k most similar rows of b.

    Single-precision unit vectors.  Only pairs of at least ``floor`` count.  If ``same``, a and b are
    the same rows and a row is no neighbour of itself.  The k-th largest of the maxima over groups of
    columns is a lower bound for the k-th largest value, so only groups that reach it are looked into.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return
    groups = int(min(256, max(k + 1, m // 8)))
    deep = -(-m // groups)
    step = max(16, BLOCK // (deep * groups))
    buffer = np.full((step, deep * groups), -2.0, np.float32)
    bt = np.ascontiguousarray(b.T)
    for at in range(0, n, step):
        c = min(step, n - at)
        s = buffer[:c]
        np.matmul(a[at : at + c], bt, out=s[:, :m]) if m == s.shape[1] else s.__setitem__((slice(None), slice(0, m)), a[at : at + c] @ bt)
        if same:
            s[np.arange(c), np.arange(at, at + c)] = -2.0
        cube = s.reshape(c, deep, groups)
        top = cube.max(axis=1)
        bound = np.full(c, floor - SLACK, np.float32)
        if groups > k:
            np.maximum(bound, np.partition(top, groups - k, axis=1)[:, groups - k] - SLACK, out=bound)
        r, g = np.nonzero(top >= bound[:, None])
        for part in range(0, len(r), max(1, BLOCK // deep)):
            rr, gg = r[part : part + max(1, BLOCK // deep)], g[part : part + max(1, BLOCK // deep)]
            hit, d = np.nonzero(cube[rr, :, gg] >= bound[rr][:, None])
            yield rr[hit] + at, d * groups + gg[hit]


def ordered(ids: np.ndarray, others: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The order by id, falling value, other.  Whole numbers of few bits are sorted as one number."""
    columns = (ids, value, others)
    if len(ids) and all(c.dtype.kind in "iu" for c in columns):
        low, high = zip(*((int(c.min()), int(c.max())) for c in columns), strict=True)
        bits = [(h - n).bit_length() for n, h in zip(low, high, strict=True)]
        if sum(bits) < 63:
            key = ((ids - low[0]).astype(np.int64) << bits[1] | (high[1] - value)) << bits[2] | (others - low[2])
            return np.argsort(key)
    return np.lexsort((others, -value, ids))


def ranked(ids: np.ndarray, others: np.ndarray, value: np.ndarray, k: int) -> np.ndarray:
    """Places of the entries that are among the k best of their id, best first; ties go to the smaller other.
    Of equal entries one counts."""
    order = ordered(ids, others, value)
    if not len(order):
        return order
    a, b = ids[order], others[order]
    order = order[np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]]
    a = ids[order]
    place = np.arange(len(order))
    first = np.maximum.accumulate(np.where(np.r_[True, a[1:] != a[:-1]], place, 0))
    return order[place - first < k]


def copies(single: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first row of each class, class of each row) of rows that are equal bit by bit."""
    n = len(single)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    odd = np.random.default_rng(5).integers(0, 2**63, single.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    key = (np.ascontiguousarray(single).view(np.uint32).astype(np.uint64) * odd).sum(axis=1)
    _, first, own = np.unique(key ^ (key >> np.uint64(29)), return_index=True, return_inverse=True)
    wrong = (single != single[first[own]]).any(axis=1)
    if wrong.any():  # two vectors of one hash: take each row for itself
        return np.arange(n), np.arange(n)
    return first, own


def crossing(
    a: np.ndarray, b: np.ndarray, k: int, floor: float, least: np.ndarray
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, col) of candidates between different rows a and b.

    For each row of a at least its k most similar rows of b, as in :func:`best`; and all pairs of at least
    ``least`` of the column, what a column has to exceed to be of use to it.  One product serves both.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return
    groups = int(min(256, max(k + 1, m // 8)))
    deep = -(-m // groups)
    step = max(16, BLOCK // (deep * groups))
    buffer = np.full((step, deep * groups), -2.0, np.float32)
    bt = np.ascontiguousarray(b.T)
    need = np.full(deep * groups, 3.0, np.float32)
    need[:m] = np.maximum(least, floor - SLACK) - SLACK
    for at in range(0, n, step):
        c = min(step, n - at)
        s = buffer[:c]
        s[:, :m] = a[at : at + c] @ bt
        top = s.reshape(c, deep, groups).max(axis=1)
        bound = np.full(c, floor - SLACK, np.float32)
        if groups > k:
            np.maximum(bound, np.partition(top, groups - k, axis=1)[:, groups - k] - SLACK, out=bound)
        hit = np.flatnonzero((s >= np.minimum(need[None, :], bound[:, None])).ravel())
        r, col = hit // s.shape[1], hit % s.shape[1]
        for part in range(0, len(r), BLOCK):
            rr, cc = r[part : part + BLOCK], col[part : part + BLOCK]
            real = cc < m
            rr, cc = rr[real], cc[real]
            yield rr + at, cc


def top_rows(
    x: np.ndarray, home: np.ndarray | None, k: int, floor: float, scale: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, col, similarity) of the k most similar rows of each row, ties to the smaller row.

    ``x`` are unit vectors in double precision.  Compared are the rows at home with each other and the
    visitors with the rows at home, a pair counting for both its rows; without ``home`` all are.  Equal vectors
    are equally at home.  Similarities are rounded to whole parts of ``scale`` and given in them, but held
    against the floor before.  Copies are compared once for all, so thousands of them cost no more than their
    output.
    """
    rep, own = copies(x.astype(np.float32))
    members = np.argsort(own, kind="stable")
    size = np.bincount(own, minlength=len(rep))
    start = np.cumsum(size) - size
    ones = x[rep].astype(np.float32)
    at_home = np.ones(len(rep), bool) if home is None else home[rep]
    inside, visit = np.flatnonzero(at_home), np.flatnonzero(~at_home)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]

    def keep(row: np.ndarray, col: np.ndarray, sim: np.ndarray) -> None:
        if len(row) > 64 * k * BLOCK // max(1, len(inside)):  # many ties
            few = ranked(row, rep[col], sim, k)
            row, col, sim = row[few], col[few], sim[few]
        found.append((row, col, sim))

    def measured(row: np.ndarray, col: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sim = exact(x, x, rep[row], rep[col])
        ok = sim >= floor
        return row[ok], col[ok], np.rint(sim[ok] * scale).astype(np.int64)

    for row, col in best(ones[inside], ones[inside], k, floor, True):
        keep(*measured(inside[row], inside[col]))
    if len(visit):
        row, col, sim = (np.concatenate(c) for c in zip(*found, strict=True))
        few = ranked(row, rep[col], sim, k)
        found = [(row[few], col[few], sim[few])]
        least = np.full(len(rep), np.inf)
        np.minimum.at(least, row[few], (sim[few] - 1) / scale)
        least[np.bincount(row[few], minlength=len(rep)) < k] = -2.0
        for row, col in crossing(ones[visit], ones[inside], k, floor, least[inside]):
            row, col, sim = measured(visit[row], inside[col])
            keep(row, col, sim)
            keep(col, row, sim)
    row, col, sim = (np.concatenate(c) for c in zip(*found, strict=True))
    few = ranked(row, rep[col], sim, k)
    found = [(row[few], col[few], sim[few])]
    several = np.flatnonzero(size > 1)
    found.append((several, several, np.full(len(several), scale)))
    row, col, sim = (np.concatenate(c) for c in zip(*found, strict=True))
    row, col, sim = _repeated(row, col, sim, np.minimum(size[col], k + 1))  # smallest members of each class
    first = np.flatnonzero(_starts(row, col))
    turn = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))
    col = members[start[col] + turn] if len(col) else col
    best_ = ranked(row, col, sim, k + 1)
    row, col, sim = row[best_], col[best_], sim[best_]
    entry = np.repeat(np.arange(len(row)), size[row]) if len(row) else row
    nth = np.arange(len(entry)) - np.repeat(np.cumsum(size[row]) - size[row], size[row]) if len(row) else row
    row, col, sim = (members[start[row[entry]] + nth] if len(entry) else row), col[entry], sim[entry]
    other = row != col
    row, col, sim = row[other], col[other], sim[other]
    best_ = ranked(row, col, sim, k)
    return row[best_], col[best_], sim[best_]


def _starts(row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Marks of the first of equal neighbouring pairs."""
    return np.r_[True, (row[1:] != row[:-1]) | (col[1:] != col[:-1])] if len(row) else np.zeros(0, bool)


def _repeated(row: np.ndarray, col: np.ndarray, sim: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each pair, once if it was given more often, as often as told."""
    order = np.lexsort((col, row))
    order = order[_starts(row[order], col[order])]
    return tuple(np.repeat(v[order], times[order]) for v in (row, col, sim))


def neighbours(
    ids: np.ndarray, x: np.ndarray, home: np.ndarray | None, k: int, floor: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, other, micro): the k most similar of each id, similarity in millionths; ids ascend."""
    row, col, micro = top_rows(x, home, k, floor, MICRO)
    return ids[row], ids[col], micro.astype(np.int32)
