"""Vector operators against brute force, with what may be wrong in the rows."""

import inspect
from dataclasses import replace
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from winnow.llm import clusters, kernels, near_duplicates, neighbours, queries, varied
from winnow.llm.components import components
from winnow.llm.forest import ForestConfig, fit_forest
from winnow.llm.hierarchy import condensed, topmost
from winnow.llm.packs import mix, pack, unit, unpack, usable
from winnow.llm.spanning import SCALE, minimum_forest

DIM = 64
SCHEMA = "id long, embedding array<float>, rank string, side int"


def _groups(seed=0, sizes=(160, 90, 40, 12, 5, 3), lone=30, noise=0.05):
    rng = np.random.default_rng(seed)
    x = [c + noise * rng.normal(size=(n, DIM)) for n in sizes for c in [_unit(rng)]] + [rng.normal(size=(lone, DIM))]
    x = np.vstack(x)
    x[3] = x[2]
    x[200] = x[201] * 2.5
    x = (x / np.linalg.norm(x, axis=1)[:, None] * rng.uniform(0.5, 9, size=(len(x), 1))).astype(np.float32)
    return np.arange(len(x)) * 7 + 3, x


def _unit(rng):
    v = rng.normal(size=DIM)
    return v / np.linalg.norm(v)


def _table(spark, ids, x, dirty=True):
    rows = [(int(i), [float(v) for v in r], "a", 1) for i, r in zip(ids, x, strict=True)]
    if dirty:
        good = rows[0][1]
        rows += [rows[5], rows[5], (999_001, None, None, None), (999_002, good[:63], "b", 2), (999_003, [0.0] * DIM, "b", 2), (999_004, [float("nan")] + good[1:], "b", 2),
                 (999_005, [None] + good[1:], "b", 2), (999_006, [float("inf")] + good[1:], "b", 2), (None, good, "b", 2), (rows[0][0], None, "b", 3)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def _cosines(x):
    y = x.astype(float)
    y /= np.linalg.norm(y, axis=1)[:, None]
    s = y @ y.T
    np.fill_diagonal(s, -2)
    return s


SMALL = [ForestConfig(leaf_rows=60, leaf_max=120, min_sample=10, miss=0.01), ForestConfig(trees=1, leaf_rows=40, leaf_max=40, min_sample=10, miss=0.01), ForestConfig(trees=3, leaf_rows=60, leaf_max=90, min_sample=10, miss=0.005)]


@pytest.mark.parametrize("config", SMALL)
def test_most_similar(spark, config):
    ids, x = _groups()
    s = _cosines(x)
    micro = np.rint(s * 1e6)
    want = set()
    for i in range(len(ids)):
        order = np.lexsort((ids, -micro[i]))[:5]
        want |= {(int(ids[i]), int(ids[j])) for j in order if s[i, j] >= 0.7}
    out = neighbours.most_similar(_table(spark, ids, x), 5, 0.7, config).collect()
    got = {(r.id, r.neighbor_id) for r in out}
    assert len(got) == len(out)
    assert len(want & got) >= 0.97 * len(want)
    at = {int(i): k for k, i in enumerate(ids)}
    assert all(abs(r.similarity - s[at[r.id], at[r.neighbor_id]]) < 1e-6 for r in out)


def test_leaves_hold_dissimilar_neighbours():
    rng = np.random.default_rng(3)
    groups = np.vstack([c + 0.04 * rng.normal(size=(100, DIM)) for c in (_unit(rng) for _ in range(40))])
    x = np.vstack([groups, rng.normal(size=(300, DIM))])
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    used = inspect.signature(neighbours.most_similar).parameters["config"].default
    forest = fit_forest(x, len(x), replace(used, leaf_rows=400, leaf_max=800))
    row, leaf, _ = forest.route(x)
    at = np.zeros((len(x), forest.leaves), bool)
    at[row, leaf] = True
    best = np.argsort(-_cosines(x)[4000:], axis=1)[:, :5]
    assert (at[4000:, None] & at[best]).any(2).mean() >= 0.9  # lone vectors, cosines of about 0.4


@pytest.mark.parametrize("config", SMALL)
def test_linked(spark, config):
    ids, x = _groups(1)
    s = _cosines(x) >= 0.75
    root = list(range(len(ids)))
    for i, j in zip(*np.nonzero(s), strict=True):
        a, b = sorted((root[i], root[j]))
        root = [a if r == b else r for r in root]
    want = {(int(ids[i]), int(ids[r])) for i, r in enumerate(root)}
    got = {(r.id, r.cluster_id) for r in clusters.linked(_table(spark, ids, x), 0.75, config).collect()}
    assert got == want
    big = clusters.at_least(clusters.linked(_table(spark, ids, x), 0.75, config), 5)
    assert min(r["count"] for r in big.groupBy("cluster_id").count().collect()) >= 5


@pytest.mark.parametrize("config", SMALL)
def test_near_pairs(spark, config):
    ids, x = _groups(2, noise=0.02)
    s = _cosines(x)
    want = {(int(ids[i]), int(ids[j])) for i, j in zip(*np.nonzero(s >= 0.975), strict=True) if i < j}
    got = {(r.id_a, r.id_b) for r in near_duplicates.near_pairs(_table(spark, ids, x), 0.975, config=config).collect()}
    assert got <= want and len(got) >= 0.97 * len(want)


def test_near_pairs_on_both_sides_of_planes(spark):
    rng = np.random.default_rng(6)
    x = np.zeros((1500, DIM), np.float32)
    x[:, :3] = rng.normal(size=(1500, 3))
    s = _cosines(x)
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(s >= 0.98), strict=True) if i < j}
    config = ForestConfig(trees=1, miss=0.02, leaf_rows=60, leaf_max=200, min_sample=10)
    got = {(r.id_a, r.id_b) for r in near_duplicates.near_pairs(_table(spark, np.arange(1500), x), config=config).collect()}
    assert got <= want and len(got) >= 0.99 * len(want)


def test_chosen_paths_with_many_copies():
    rng = np.random.default_rng(0)
    x = np.vstack([np.tile(_unit(rng), (300, 1)), [_unit(rng) for _ in range(300)]])
    row, col, _ = near_duplicates.chosen_paths(x, 0.98, bucket=50)
    assert len(row) == 300 * 299 // 2 and (row < col).all()


def test_chosen_paths_find_near_vectors_beside_copies():
    rng = np.random.default_rng(0)
    ball = _unit(rng) + 0.018 * rng.normal(size=(6000, DIM))
    x = np.vstack([np.tile(_unit(rng), (1500, 1)), ball, ball[:2]])
    x /= np.linalg.norm(x, axis=1)[:, None]
    row, col, sim = near_duplicates.chosen_paths(x, 0.985, bucket=50)
    s = np.triu(x @ x.T >= 0.985, 1)
    near = s.copy()
    near[:1500, :1500] = False
    assert s[row, col].all() and (row < col).all() and len(np.unique(row * len(x) + col)) == len(row)
    assert ((row < 1500) & (col < 1500)).sum() == s[:1500, :1500].sum()
    assert near.sum() > 1000 and near[row, col].sum() >= 0.99 * near.sum()


def test_repeated_runs_alone_reach_the_recall():
    """What runs of split sets find, without comparing all."""
    rng = np.random.default_rng(0)
    ball = _unit(rng) + 0.05 * rng.normal(size=(6000, DIM))
    x = np.vstack([ball, ball[:900] + 0.008 * rng.normal(size=(900, DIM))])
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    want = set(zip(*(v.tolist() for v in np.nonzero(np.triu(x @ x.T >= 0.98, 1))), strict=True))
    found, sizes = set(), []
    for seed in range(8):
        codes = near_duplicates._run(x, 0.98, 96, np.random.default_rng(seed))
        found |= {(int(c) // len(x), int(c) % len(x)) for c in codes}
        sizes.append(len(found & want))
    assert len(want) > 700 and sizes[0] < sizes[-1] and sizes[-1] >= 0.99 * len(want)


def test_contradictions(spark):
    pairs = spark.createDataFrame([(1, 2, 1.0), (1, 3, 1.0), (1, 4, 1.0), (1, 5, 1.0), (1, 6, 1.0), (1, 7, 1.0), (1, 99, 1.0)], "id_a long, id_b long, similarity double")
    records = spark.createDataFrame(
        [(1, "K00001+10", [0, 0]), (1, "K00001+10", [0, 0]), (2, " k00001%2B10", [64, 64]), (3, "K00002+10", [0, 0]), (4, None, [65, 0]), (5, "mosaic_K00001-10", [None, 900]), (6, "?", None), (7, "K00001", [900])],
        "id long, mosaic_name string, position array<int>",
    )
    got = near_duplicates.compatible_pairs(pairs, records)
    assert sorted(r.id_b for r in got.collect()) == [2, 5, 6, 7, 99]
    assert {(r.id, r.group_id, r.links) for r in near_duplicates.groups(got).collect()} == {(1, 1, 5)} | {(k, 1, 1) for k in (2, 5, 6, 7, 99)}


def test_cores_over_all_tasks(spark):
    """Cores count the neighbours of all leaves, also where a leaf is several tasks."""
    ids, x = _groups(3, sizes=(150, 60), lone=20)
    s = _cosines(x)
    core = 1 - np.sort(s, axis=1)[:, -5]
    core[np.sort(s, axis=1)[:, -5] < 0.5] = 0.5
    at = {int(i): k for k, i in enumerate(ids)}
    config = ForestConfig(leaf_rows=20, leaf_max=20, min_sample=10, miss=0.0)
    edges = clusters.reachability_graph(_table(spark, ids, x), 5, 0.5, config).collect()
    assert len(edges) > 5 * 200
    for r in edges:
        a, b = at[r.a], at[r.b]
        assert abs(r.w / SCALE - max(1 - s[a, b], core[a], core[b])) < 1e-6


def _forest_weight(edges):
    """Edges and weight of a minimum spanning forest of (distance, a, b)."""
    root, weights = {}, []

    def top(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    for d, a, b in sorted(edges):
        a, b = top(a), top(b)
        if a != b:
            root[a] = b
            weights.append(d)
    return len(weights), sum(weights)


def test_forest_spans_groups_that_planes_part(spark):
    rng = np.random.default_rng(8)
    q = np.linalg.qr(rng.normal(size=(DIM, 9)))[0].T
    x = np.vstack([np.sqrt(0.6) * q[0] + np.sqrt(0.4) * q[k] + 0.02 * rng.normal(size=(60, DIM)) for k in range(1, 9)]).astype(np.float32)
    s = _cosines(x)
    core = 1 - np.sort(s, axis=1)[:, -5]
    d = np.maximum(np.maximum(1 - s, core[:, None]), core[None, :])
    want = _forest_weight((d[i, j], i, j) for i, j in zip(*np.nonzero(s >= 0.5), strict=True) if i < j)
    config = ForestConfig(leaf_rows=60, leaf_max=120, min_sample=10, miss=0.0)
    edges = clusters.reachability_graph(_table(spark, np.arange(480), x, dirty=False), 5, 0.5, config)
    forest, roots = minimum_forest(edges)
    got = _forest_weight((r.w / SCALE, r.a, r.b) for r in forest.collect())
    assert forest.count() == want[0] == 479 and got[0] == want[0] and abs(got[1] - want[1]) < 1e-5
    assert {(r.id, r.root) for r in roots.collect()} == {(k, 0) for k in range(480)}


def _hierarchy(edges, n, least, far):
    """Condensed hierarchy of a spanning forest by the definition: cuts at every distance, from the top.

    Gives the members of the selected clusters, as sets of points, by recursion over thresholds.
    """
    levels = sorted({w for _, _, w in edges if w <= far}, reverse=True)

    def parts(points, below):
        root = {p: p for p in points}

        def top(p):
            while root[p] != p:
                p = root[p]
            return p

        for a, b, w in edges:
            if w < below and a in root and b in root:
                root[top(a)] = top(b)
        out = {}
        for p in points:
            out.setdefault(top(p), set()).add(p)
        return list(out.values())

    def grown(points, birth):
        """(stability, members) of the best selection within a cluster that begins at density ``birth``."""
        now, stable = set(points), 0.0
        for w in levels:
            pieces = [p for p in parts(now, w)]
            if len(pieces) == 1:
                continue
            large = [p for p in pieces if len(p) >= least]
            left = sum(len(p) for p in pieces if len(p) < least)
            stable += left * (SCALE / w - birth)
            if len(large) > 1 or not large:
                stable += sum(map(len, large)) * (SCALE / w - birth)
                below = [grown(p, SCALE / w) for p in large]
                worth = sum(b[0] for b in below)
                if below and worth > stable:
                    return worth, [m for b in below for m in b[1]]
                return stable, [frozenset(points)]
            now = large[0]
        return stable, [frozenset(points)]

    out = []
    for p in parts(set(range(n)), far + 1):
        if len(p) >= least:
            out += grown(p, SCALE / far)[1]
    return set(out)


@pytest.mark.parametrize("task_edges", [10_000, 40])
def test_hierarchy_by_the_definition(spark, task_edges):
    """All merges, in one task for each tree and in bands of distances, against cuts at every distance."""
    rng = np.random.default_rng(4)
    tree = [(0, 0, 0)]
    while len(tree) < 241:  # a random tree of 200 vertices with groups, and one of 40
        k = len(tree)
        other = int(rng.integers(max(0, k - 25), k)) if k != 200 else -1
        w = int(rng.integers(1, 1000) ** 2) + 1 if k % 25 else int(rng.integers(900_000, 1_500_000))
        tree.append((other, k, w * 10 + k % 7))
    edges = [(a, b, w * 64) for a, b, w in tree[1:] if a >= 0]
    far = 1_200_000 * 640
    kept = [e for e in edges if e[2] <= far]
    forest, roots = minimum_forest(spark.createDataFrame(kept, "a long, b long, w long"))
    joins, ends = condensed(forest, roots, 5, far, task_edges)
    taken = joins.join(topmost(ends), "cluster").collect()
    got = {}
    for r in taken:
        got.setdefault(r.taken, set()).add(r.id)
    assert len({r.id for r in taken}) == len(taken)
    assert {frozenset(v) for v in got.values()} == _hierarchy(kept, 241, 5, far)


def test_density_clusters(spark):
    ids, x = _groups(3, sizes=(120, 60, 30), lone=20)
    out = clusters.density_clusters(_table(spark, ids, x), least=8, neighbours=3, floor=0.5).collect()
    of = {r.id: r.cluster_id for r in out}
    blobs = [{of.get(int(i)) for i in part} - {None} for part in (ids[:120], ids[120:180], ids[180:210])]
    assert len(set.union(*blobs)) == sum(map(len, blobs))  # no cluster spans two groups
    assert not any(int(i) in of for i in ids[210:])  # no cosine of theirs reaches the floor
    assert sum(int(i) in of for i in ids[:210]) >= 200
    for c in set(of.values()):
        own = [r for r in out if r.cluster_id == c]
        assert {r.size for r in own} == {len(own)} and sum(r.exemplar for r in own) == 3
        assert min(r.persistence for r in own if r.exemplar) >= max(r.persistence for r in own if not r.exemplar)


@pytest.mark.parametrize("task_edges", [500_000, 20])
def test_level_clusters(spark, task_edges):
    """The hierarchy's clusters at a similarity, in one task and by rounds and bands, with copies that no task compares."""
    ids, x = _groups(1)
    x = np.vstack([x, np.tile(x[40], (150, 1))])
    ids = np.arange(len(x)) * 7 + 3
    s = _cosines(x) >= 0.75
    root = np.arange(len(ids))
    for i, j in zip(*np.nonzero(s), strict=True):
        if root[i] != root[j]:
            root[np.isin(root, (root[i], root[j]))] = min(root[i], root[j])
    sizes = np.bincount(root, minlength=len(ids))
    want = {(int(ids[i]), int(ids[r])) for i, r in enumerate(root) if sizes[r] >= 5}
    out = clusters.level_clusters(_table(spark, ids, x), 0.75, 5, task_edges, replace(SMALL[0], miss=0.001)).collect()
    assert len(out) == len(want) and {(r.id, r.cluster_id) for r in out} == want
    none = spark.createDataFrame([], SCHEMA)
    assert clusters.level_clusters(none, 0.75, 5, task_edges).count() == 0


def test_forest_is_the_same_by_rounds_and_in_one_task(spark):
    rng = np.random.default_rng(6)
    pairs = {(int(a), int(b)) for a, b in np.sort(rng.integers(0, 300, (900, 2)), axis=1) if a < b}
    edges = [(a, b, int(rng.integers(0, 40))) for a, b in sorted(pairs)]  # with many equal weights
    table = spark.createDataFrame(edges, "a long, b long, w long")
    found = []
    for task_edges in (1_000_000, 100, 0):
        forest, roots = minimum_forest(table, task_edges)
        found.append((sorted(map(tuple, forest.collect())), sorted(map(tuple, roots.collect()))))
    assert found[0] == found[1] == found[2]
    assert (len(found[0][0]), sum(w for _, _, w in found[0][0])) == _forest_weight((w, a, b) for a, b, w in edges)


def test_p3_found_comes_from_the_forest_and_the_hierarchy(spark, tmp_path, monkeypatch):
    called = []
    for name in ("minimum_forest", "condensed"):
        step = getattr(clusters, name)
        monkeypatch.setattr(clusters, name, lambda *a, _step=step, _name=name: called.append(_name) or _step(*a))
    ids, x = _groups(5)
    _table(spark, ids, x).write.parquet(str(tmp_path / "features.parquet"))
    assert queries.queries()["p3_found"](spark, str(tmp_path)).count() > 250
    assert called == ["minimum_forest", "condensed"]


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert neighbours.most_similar(none).count() == 0
    assert clusters.linked(none, 0.8).count() == 0
    assert clusters.density_clusters(none).count() == 0
    assert near_duplicates.near_pairs(none).count() == 0
    records = spark.createDataFrame([(1, "K00001+01")], "id long, mosaic_name string")
    requests = spark.createDataFrame([(1, 5, 1, "r")], REQUESTS)
    assert varied.varied_subset(none, records, requests).count() == 0
    some = _table(spark, *_groups())
    assert varied.varied_subset(some, records.limit(0), requests).count() == 0
    assert varied.varied_subset(some, records, requests.limit(0)).count() == 0
    assert near_duplicates.compatible_pairs(near_duplicates.near_pairs(some), records.withColumn("position", F.lit(None).cast("array<int>")).limit(0)).count() > 0


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(100, 99), (98, 99), (7, 7), (5, 6), (None, 4)] + [(50, k) for k in range(200, 260)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {k: 0 for k in range(31)} | {98: 98, 99: 98, 100: 98, 50: 50} | {k: 50 for k in range(200, 260)}
    assert components(edges.limit(0)).count() == 0


def test_packs():
    ids, x = np.array([5, -1, 2**60]), np.arange(12, dtype=np.float32).reshape(3, 4)
    a, b = unpack(pack(ids, x), [(np.int64, 0), (np.float32, 4)])
    assert (a == ids).all() and (b == x).all()
    assert unpack(pack(ids[:0], x[:0]), [(np.int64, 0), (np.float32, 4)])[1].shape == (0, 4)
    assert len(set(mix(np.arange(1000)) % np.uint64(7))) == 7


def test_routing_without_planes():
    f = fit_forest(np.zeros((0, DIM), np.float32), 0, ForestConfig())
    row, leaf, home = f.route(np.ones((2, DIM), np.float32))
    assert list(row) == [0, 1] and set(leaf) == {0} and home.all()
    assert not list(kernels.best(np.zeros((0, 4), np.float32), np.zeros((0, 4), np.float32), 3, 0, True))


REQUESTS = "request_id int, target_size long, multiplier int, sampling_strategy string"


def test_varied_subset(spark):
    ids, x = _groups(4, sizes=(900, 60, 40), lone=50)
    records = spark.createDataFrame([(int(i), f"K{k % 20 if k % 3 else 0:05d}+01") for k, i in enumerate(ids)] + [(-1, "K00009+01")], "id long, mosaic_name string")
    requests = spark.createDataFrame([(1, 100, 1, "r"), (2, 5000, 1, None), (3, 1500, 2, "c"), (4, None, 1, "c"), (5, -3, 1, "c"), (6, 0, None, None)], REQUESTS)
    out = varied.varied_subset(_table(spark, ids, x), records, requests).collect()
    count = {k: sum(r.request_id == k for r in out) for k in range(1, 7)}
    assert count == {1: 100, 2: 1050, 3: 1500, 4: 0, 5: 0, 6: 0}
    assert len({(r.request_id, r.id, r.replica) for r in out}) == len(out)
    first = [r.id for r in out if r.request_id == 1]
    share = np.isin(first, ids[:900]).mean()
    assert share < 0.6  # the group holds 86 per cent of the rows
    again = varied.varied_subset(_table(spark, ids, x), records, requests.where("request_id = 1"))
    assert sorted(r.id for r in again.collect()) == sorted(first)


def test_smallest_by_percentiles(spark):
    from pyspark.sql import functions as F

    keyed = spark.range(5000).selectExpr("id", "1.0D AS weight", "double((id * 7919) % 5000) AS key", "1.0D AS same")
    wanted = [(1, 0, 1234), (2, 3, 300), (3, 0, 4999)]
    got = varied._smallest(keyed, wanted, [F.col("key"), F.col("same"), F.col("key")], 5000, exact=100).collect()
    key = {k: (k * 7919) % 5000 for k in range(5000)}
    assert sorted(key[r.id] for r in got if r.request_id == 1) == list(range(1234))
    assert sorted(r.id for r in got if r.request_id == 2 and r.replica == 3) == list(range(300))
    assert sorted(key[r.id] for r in got if r.request_id == 3) == list(range(4999))


def test_densities_do_not_depend_on_unrelated_rows(spark):
    ids, x = _groups(5, sizes=(300,), lone=300)
    rows = [(r.id, r.density) for r in varied.densities(_table(spark, ids, x)).collect()]
    got = dict(rows)
    assert len(got) == len(rows) == len(ids)
    assert np.mean([got[int(i)] for i in ids[300:]]) < 1.2  # a lone vector meets nothing
    assert np.mean([got[int(i)] for i in ids[:300]]) > 3


def test_heavy_copies_are_not_moved(spark):
    """A vector that most rows are copies of: lists, links and edges of the copies follow from a few of them."""
    rng = np.random.default_rng(7)
    x = np.vstack([np.tile(_unit(rng), (400, 1)), [_unit(rng) for _ in range(60)]]).astype(np.float32)
    order = rng.permutation(len(x))
    ids, x = np.arange(len(x)) * 3 + 1, x[order]
    config = ForestConfig(leaf_rows=60, leaf_max=100, min_sample=10)
    table = _table(spark, ids, x)
    copies = ids[order < 400]
    out = neighbours.most_similar(table, 5, 0.5, config).collect()
    for i in copies:
        near = [r.neighbor_id for r in sorted((r for r in out if r.id == i), key=lambda r: r.rank)]
        assert near == [int(c) for c in copies[:6] if c != i][:5]
    linked = {r.id: r.cluster_id for r in clusters.linked(table, 0.9, config).collect()}
    assert {linked[int(i)] for i in copies} == {int(copies[0])} and len(linked) == len(ids)
    members = clusters.density_clusters(table, least=8, neighbours=3, floor=0.5, config=config).collect()
    assert {r.id for r in members} == set(map(int, copies)) and {r.size for r in members} == {400}


def test_rows_with_many_copies():
    rng = np.random.default_rng(2)
    one = _unit(rng)
    x = np.vstack([np.tile(one, (4000, 1)), [_unit(rng) for _ in range(50)], one + 0.05 * rng.normal(size=(1, DIM)), np.tile(_unit(rng), (3, 1))])
    order = rng.permutation(len(x))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32).astype(float)[order]
    x /= np.linalg.norm(x, axis=1)[:, None]
    first = kernels.copies(x.astype(np.float32))
    for home in (None, (first[1] % 2) > 0):
        row, col, micro = kernels.top_rows(x, home, 5, 0.5, 1_000_000)
        s = np.rint(x @ x.T * 1e6)
        np.fill_diagonal(s, -2)
        if home is not None:
            s[(~home[:, None] & ~home[None, :]) & (first[1][:, None] != first[1][None, :])] = -2
        for i in (*rng.choice(len(x), 60), *np.flatnonzero(np.isin(order, [4000, 4050, 4051, 4052, 4053]))):
            want = [j for j in np.lexsort((np.arange(len(x)), -s[i]))[:5] if s[i, j] >= 5e5]
            assert sorted(col[row == i]) == sorted(want)


def _duck(folder):
    import duckdb

    con = duckdb.connect()
    for f in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    """The queries against all pairs of vectors in SQL."""
    folder = Path("/root/testdata/sf0.01")
    if not folder.exists():
        pytest.skip("needs the test tables")
    got = queries.queries()[name](spark, str(folder))
    columns = ", ".join(got.columns)
    want = _duck(folder).execute(f"SELECT {columns} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and want


def test_recall_of_the_found_neighbours(spark):
    """The 5 nearest of the ids divisible by 100 against brute force, with production parameters, where leaves are cut."""
    folder = Path("/root/testdata/sf0.1")
    if not folder.exists():
        pytest.skip("needs the test tables")
    features = spark.read.parquet(str(folder / "features.parquet"))
    ids, x = [], []
    for batch in features.select("id", "embedding").toArrow().combine_chunks().to_batches():
        i, v = usable(batch, DIM)
        ids.append(i)
        x.append(v)
    ids, at = np.unique(np.concatenate(ids), return_index=True)
    x = unit(np.concatenate(x)[at])
    asked = np.flatnonzero(ids % 100 == 0)
    micro = np.rint(x[asked] @ x.T * 1e6)
    micro[np.arange(len(asked)), asked] = -2e6
    for floor, config in ((0.82, neighbours.ALIKE), (-1.0, neighbours.ANY)):
        lists = neighbours.most_similar(features, 5, floor, config).where("id % 100 = 0").collect()
        got = {(r.id, r.neighbor_id) for r in lists}
        want = set()
        for row, k in enumerate(asked):
            best = np.lexsort((ids, -micro[row]))[:5]
            want |= {(int(ids[k]), int(ids[j])) for j in best if micro[row, j] >= floor * 1e6}
        assert len(want) > 1000 and len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)
