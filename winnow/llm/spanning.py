"""Borůvka's minimum spanning forest: over the vectors of one task, and over a table of edges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.functions.lineage import cut
from winnow.llm.kernels import BLOCK, SLACK, exact, top_rows

#: Distances 1 - cosine are whole numbers of this part.
SCALE = 1 << 26


def spanning_forest(
    x: np.ndarray, home: np.ndarray | None, floor: float, k: int = 8
) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """((row, col, distance) of the k nearest of each row, the same of a minimum spanning forest, component).

    Counted are the pairs of at least ``floor`` of which one row is at home.  The k nearest of each row answer
    most questions for the lightest edge out of a component; where they can't, the rows concerned are
    compared once more.  The largest component never asks, the others find their edges to it; its own choice
    counts only if it is sure.
    """
    n = len(x)
    u, v, sim = top_rows(x, home, k, floor, SCALE)
    w = SCALE - sim
    lists = (u, v, w)
    bound = np.full(n, np.inf)
    full = np.bincount(u, minlength=n) >= k
    last = np.zeros(n)
    np.maximum.at(last, u, w)
    bound[full] = last[full]
    single = x.astype(np.float32)
    at_home = np.ones(n, bool) if home is None else home
    comp = np.arange(n)
    picked: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while n:
        alive = comp[u] != comp[v]
        u, v, w = u[alive], v[alive], w[alive]
        order = np.lexsort((np.maximum(u, v), np.minimum(u, v), w))
        u, v, w = u[order], v[order], w[order]
        lightest = np.full(n, len(u))
        for end in (u, v):
            which, first = np.unique(comp[end], return_index=True)
            lightest[which] = np.minimum(lightest[which], first)
        weight = np.append(w, np.inf)[lightest]
        largest = np.argmax(np.bincount(comp, minlength=n))
        ask = np.flatnonzero((bound < weight[comp]) & (comp != largest))
        if len(ask):
            a, b = _outside(single, at_home, comp, ask, floor)
            bound[ask] = np.inf
            s = exact(x, x, a, b)
            ok = s >= floor
            a, b, d = a[ok], b[ok], SCALE - np.rint(s[ok] * SCALE).astype(np.int64)
            bound[a] = d
            if len(a):
                u, v, w = np.r_[u, a], np.r_[v, b], np.r_[w, d]
                continue
        if ((bound < weight[comp]) & (comp == largest)).any():
            lightest[largest] = len(u)  # it hasn't asked, so a lighter edge may be unknown
        pick = np.unique(lightest[lightest < len(u)])
        if not len(pick):
            break
        took, comp = _joined(comp, u[pick], v[pick])
        picked.append((u[pick[took]], v[pick[took]], w[pick[took]]))
    forest = tuple(np.concatenate(c) for c in zip(*picked, strict=True)) if picked else (u[:0], v[:0], w[:0])
    return lists, forest, comp


def _joined(comp: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the edges that join two components, components after them); a component is named by its
    smallest row."""
    parent = dict.fromkeys(np.unique(np.r_[comp[a], comp[b]]).tolist())
    parent = {c: c for c in parent}

    def find(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    took = []
    for place, (i, j) in enumerate(zip(comp[a].tolist(), comp[b].tolist(), strict=True)):
        i, j = find(i), find(j)
        if i != j:
            parent[max(i, j)] = min(i, j)
            took.append(place)
    to = np.arange(len(comp))
    for c in parent:
        to[c] = find(c)
    return np.array(took, np.int64), to[comp]


def _outside(single: np.ndarray, home: np.ndarray, comp: np.ndarray, ask: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """The nearest row outside its component of each row in ``ask``, if any reaches the floor.  Visitors are
    compared with the rows at home only."""
    rows, cols = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    inside = np.flatnonzero(home)
    for asking, others in ((ask[home[ask]], np.arange(len(single))), (ask[~home[ask]], inside)):
        columns = np.ascontiguousarray(single[others].T)
        names = comp[others]
        step = max(16, BLOCK // max(1, len(others)))
        for at in range(0, len(asking), step):
            part = asking[at : at + step]
            s = single[part] @ columns
            near = s >= floor - SLACK
            if np.count_nonzero(near) > 0.03 * near.size:  # mostly within one dense component
                s[~near | (comp[part][:, None] == names[None, :])] = -2.0
                c = np.argmax(s, axis=1)
                r = np.flatnonzero(s[np.arange(len(part)), c] > -2.0)
                rows.append(part[r])
                cols.append(others[c[r]])
                continue
            hit = np.flatnonzero(near.ravel())
            r, c = hit // len(others), hit % len(others)
            out = comp[part[r]] != names[c]
            r, c = r[out], c[out]
            order = np.lexsort((c, -s[r, c], r))
            first = order[np.r_[True, r[order][1:] != r[order][:-1]]] if len(order) else order
            rows.append(part[r[first]])
            cols.append(others[c[first]])
    return np.concatenate(rows), np.concatenate(cols)


def _remaining_rounds(table: pa.Table) -> pa.Table:
    """Borůvka's rounds over the edges (ra, rb, w, a, b) between components: (taken, a, b, w) of the edges taken, and
    of each component with the one of those it has become one with that stands for them."""
    ra, rb, w, a, b = (table.column(c).to_numpy() for c in ("ra", "rb", "w", "a", "b"))
    nodes, ends = np.unique(np.r_[ra, rb], return_inverse=True)
    at = np.lexsort((b, a, w))
    u, v = ends[: len(ra)][at], ends[len(ra) :][at]
    comp = np.arange(len(nodes))
    picked = [at[:0]]
    while len(u):
        lightest = np.full(len(nodes), len(u))
        for end in (u, v):
            np.minimum.at(lightest, comp[end], np.arange(len(u)))
        own = np.flatnonzero(lightest < len(u))
        pick = lightest[own]
        picked.append(at[np.unique(pick)])
        up = np.arange(len(nodes))
        up[own] = comp[u[pick]] + comp[v[pick]] - own
        first = own[(up[up[own]] == own) & (own < up[own])]  # two that took the same edge
        up[first] = first
        while (up != up[up]).any():
            up = up[up]
        comp = up[comp]
        alive = comp[u] != comp[v]
        u, v, at = u[alive], v[alive], at[alive]
    e = np.concatenate(picked)
    taken = np.arange(len(e) + len(nodes)) < len(e)
    columns = [np.r_[a[e], nodes], np.r_[b[e], nodes[comp]], np.r_[w[e], np.zeros(len(nodes), np.int64)]]
    return pa.Table.from_arrays([pa.array(c) for c in (taken, *columns)], names=["taken", "a", "b", "w"])


def followed(pointers: DataFrame, task_rows: int = 1_000_000) -> DataFrame:
    """(r, up) with the end of the path of pointers (r, up) from each r; an end points to itself.

    By doubling pointers, in one task if there are at most ``task_rows``."""
    if pointers.count() <= task_rows:

        def ends(table: pa.Table) -> pa.Table:
            r, up = (table.column(c).to_numpy() for c in ("r", "up"))
            order = np.argsort(r)
            r, up = r[order], np.searchsorted(r[order], up[order])
            while (up != up[up]).any():
                up = up[up]
            return pa.table({"r": r, "up": r[up]})

        return cut(pointers.select(F.lit(0).alias("task"), "r", "up").groupBy("task").applyInArrow(ends, "r long, up long"))
    while True:
        above = pointers.select(F.col("r").alias("up"), F.col("up").alias("upper"))
        higher = cut(pointers.join(above, "up").select("r", F.col("upper").alias("up"), (F.col("up") != F.col("upper")).alias("moved")))
        pointers = higher.select("r", "up")
        if higher.where("moved").isEmpty():
            return pointers


def minimum_forest(edges: DataFrame, task_edges: int = 1_000_000) -> tuple[DataFrame | None, DataFrame]:
    """((a, b, w) of the minimum spanning forest, (id, root) of its vertices) of the edges (a, b, w), a < b.

    Borůvka's rounds: every component takes its lightest edge to another one, ties to the smaller ends; the
    components so hooked to each other become one, by doubling pointers; edges within a component fall
    away, and of several between the same two the lightest stays.  All steps are aggregations with partial
    results and joins on components, whose number at least halves with each round.  Once at most
    ``task_edges`` edges between components are left, one task goes through the remaining rounds; as no two edges
    rank the same, the forest is the same.  root is the smallest vertex of its component.  The forest is
    None if there are no edges.
    """
    edges = cut(edges.select("a", "b", "w"))
    left = edges.select(F.col("a").alias("ra"), F.col("b").alias("rb"), F.struct("w", "a", "b").alias("e"))
    taken: DataFrame | None = None
    maps: list[DataFrame] = []
    while count := left.count():
        if count <= task_edges:
            flat = left.select(F.lit(0).alias("task"), "ra", "rb", "e.w", "e.a", "e.b")
            rest = cut(flat.groupBy("task").applyInArrow(_remaining_rounds, "taken boolean, a long, b long, w long"))
            own = rest.where("taken").select("a", "b", "w")
            taken = own if taken is None else taken.unionAll(own)
            maps.append(rest.where("not taken").select(F.col("a").alias("r"), F.col("b").alias("up")))
            break
        both = F.array(*(F.struct(F.col(r).alias("r"), F.struct("e", F.col(to).alias("to")).alias("x")) for r, to in (("ra", "rb"), ("rb", "ra"))))
        ends = left.select(F.explode(both).alias("end")).select("end.r", "end.x")
        best = cut(ends.groupBy("r").agg(F.min("x").alias("x")).select("r", "x.to", "x.e"))
        own = best.select("e.a", "e.b", "e.w")
        taken = own if taken is None else taken.unionAll(own)
        back = best.select(F.col("r").alias("to"), F.col("to").alias("back"))
        up = F.when((F.col("back") == F.col("r")) & (F.col("r") < F.col("to")), F.col("r")).otherwise(F.col("to"))
        hooks = followed(cut(best.select("r", "to").join(back, "to").select("r", up.alias("up"))), task_edges)
        maps.append(hooks)
        a, b = (hooks.select(F.col("r").alias(f"r{x}"), F.col("up").alias(f"n{x}")) for x in "ab")
        among = left.join(a, "ra").join(b, "rb").where("na <> nb").select(F.least("na", "nb").alias("ra"), F.greatest("na", "nb").alias("rb"), "e")
        left = cut(among.groupBy("ra", "rb").agg(F.min("e").alias("e")))
    if taken is None:
        return None, edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
    labels = maps[-1]
    for earlier in reversed(maps[:-1]):
        later = labels.select(F.col("r").alias("up"), F.col("up").alias("upper"))
        labels = earlier.join(later, "up", "left").select("r", F.coalesce("upper", "up").alias("up"))
    named = labels.groupBy("up").agg(F.min("r").alias("root"))
    labels = cut(labels.join(named, "up").select(F.col("r").alias("id"), "root"))
    return cut(taken.distinct()), labels
