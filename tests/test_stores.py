"""What is written and read again: samples, neighbour lists, hierarchies, steps of clustering, swapped folders."""

import os

import numpy as np
import pytest

from winnow.functions.files import recovered, swap
from winnow.operators import kmeans as K
from winnow.operators.pipeline import keep_steps, latest_step
from winnow.operators.registry import copied_rows
from winnow.sources import arrays, manifests
from winnow.sources.errors import SourceNotFoundError


def _points(spark, n=240, dim=6, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, dim))
    return spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "id long, embedding array<double>").repartition(3), x


def test_lloyd_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    points, _ = _points(spark)
    start = K.random_init(points, 5, 1)
    want = K.lloyd(points, start, 7).rows
    folder = str(tmp_path / "lloyd")
    K.lloyd(points, start, 4, folder=folder, every=2)
    assert latest_step(spark, folder) == 4
    updates, update = [], K.update
    monkeypatch.setattr(K, "update", lambda *a: updates.append(1) or update(*a))
    got = K.lloyd(points, start, 7, folder=folder, every=2).rows
    assert len(updates) == 3 and np.allclose(got, want) and latest_step(spark, folder) == 7
    assert keep_steps(spark, folder, 2) == [6, 7] and latest_step(spark, str(tmp_path / "none")) is None


def test_latest_of_many_steps(spark, tmp_path):
    for k in (1, 9_999, 10_000, 10_001, 10_002):
        os.makedirs(tmp_path / f"step={k}")
        if k != 10_002:
            (tmp_path / f"step={k}" / "_SUCCESS").touch()
    assert latest_step(spark, str(tmp_path)) == 10_001


def test_seeding_keeps_distances_and_resumes(spark, tmp_path):
    points, x = _points(spark, 60, 3)
    c = K.plus_plus_init(points, 9, 3).rows
    assert len({tuple(r) for r in c}) == 9
    assert all((np.abs(x - r).sum(axis=1) < 1e-12).any() for r in c)
    folder = str(tmp_path / "seeds")
    K.plus_plus_init(points, 6, 3, folder, every=3)
    again = K.plus_plus_init(points, 9, 3, folder, every=3).rows
    assert np.allclose(again, c)
    assert len(K.plus_plus_init(points.limit(4), 9, 3).rows) == 4 and not len(K.plus_plus_init(points.limit(0), 2).rows)


def test_levels_resume(spark, tmp_path, monkeypatch):
    points, _ = _points(spark)
    tree = K.hierarchical(points, [9, 4, 2], 2, folder=str(tmp_path / "tree"))
    monkeypatch.setattr(K, "kmeans", lambda *a, **k: pytest.fail("a finished level was computed again"))
    again = K.hierarchical(points, [9, 4, 2], 2, folder=str(tmp_path / "tree"))
    assert [t.rows.shape for t in tree] == [(9, 6), (4, 6), (2, 6)]
    assert all(np.allclose(a.rows, b.rows) for a, b in zip(tree, again, strict=True))
    rows = K.levels(points, tree).collect()
    assert len(rows) == 240 and len({(r.level_1, r.level_2) for r in rows}) == len({r.level_1 for r in rows})


def test_lists_in_chunks(spark):
    assignment = spark.createDataFrame([(k * 3 % 100, 0 if k < 90 else k) for k in range(100)], "id long, cluster_id long")
    rows = K.list_chunks(assignment, 25).orderBy("cluster_id", "chunk").collect()
    big = [r for r in rows if r.cluster_id == 0]
    assert [r.chunk for r in big] == [0, 1, 2, 3] and max(len(r.members) for r in rows) <= 25
    assert [i for r in big for i in r.members] == sorted(k * 3 % 100 for k in range(90)) and len(rows) == 14


def test_samples(spark, tmp_path):
    sample = spark.createDataFrame([(5,), (2,), (2,), (9,)], "id long")
    path = str(tmp_path / "s" / "sample.npy")
    assert arrays.write_npy_sample(sample, path) == 4
    assert [(r.position, r.id) for r in arrays.read_sample(spark, path).orderBy("position").collect()] == [(0, 2), (1, 2), (2, 5), (3, 9)]
    folder = arrays.write_sample(sample, str(tmp_path), "3r_mul1_4_balanced_selection")
    assert sorted(r.id for r in arrays.read_sample(spark, folder).collect()) == [2, 2, 5, 9]
    with pytest.raises(ValueError):
        arrays.write_npy_sample(sample, path, most=3)
    for wrong in (np.zeros((2, 2), int), np.zeros(3)):
        np.save(tmp_path / "wrong.npy", wrong)
        with pytest.raises(ValueError):
            arrays.read_sample(spark, str(tmp_path / "wrong.npy"))
    with pytest.raises(SourceNotFoundError):
        arrays.read_sample(spark, str(tmp_path / "none.npy"))


def test_matrices(spark, tmp_path):
    points, x = _points(spark, 50, 4)
    files = arrays.npy_files(points, str(tmp_path / "m"), rows=20).collect()
    assert sorted(r.rows for r in files) == [10, 20, 20]
    back = arrays.read_features(spark, files[0].path).collect()
    assert len(back) in (10, 20)
    spark.dataSource.register(arrays.NpySource)
    whole = {r.id: r.embedding for r in spark.read.format("npy").load(str(tmp_path / "m")).collect()}
    assert len(whole) == 50 and np.allclose([whole[k] for k in range(50)], x, atol=1e-6)


def test_neighbour_lists(spark, tmp_path):
    lists = spark.createDataFrame([(1, 1, 2, 0.5)], "id long, rank int, neighbor_id long, distance double")
    arrays.write_neighbours(lists, str(tmp_path / "knn"), {"k": 5, "metric": "cos"})
    rows, params = arrays.read_neighbours(spark, str(tmp_path / "knn"))
    assert rows.collect() == lists.collect() and params == {"k": 5, "metric": "cos"}
    with pytest.raises(SourceNotFoundError):
        arrays.read_neighbours(spark, str(tmp_path / "none"))


def test_level_folders(spark, tmp_path):
    below = [[3, 0], [], [1, 2, 4]]
    for level, lists in ((1, below), (2, [[2, 0, 1]])):
        os.makedirs(tmp_path / f"level{level}")
        boxed = np.empty(len(lists), object)
        boxed[:] = [np.array(v, int) for v in lists] if len(lists) > 1 else [np.array(lists[0])]
        np.save(tmp_path / f"level{level}" / "sorted_clusters.npy", boxed, allow_pickle=True)
        np.save(tmp_path / f"level{level}" / "centroids.npy", np.full((len(lists), 2), level, float))
    edges, centroids = arrays.read_level_folders(spark, str(tmp_path))
    got = {(r.level, r.parent_id, r.child_id, r.rank_in_cluster) for r in edges.collect()}
    assert got == {(1, 0, 3, 1), (1, 0, 0, 2), (1, 2, 1, 1), (1, 2, 2, 2), (1, 2, 4, 3), (2, 0, 2, 1), (2, 0, 0, 2), (2, 0, 1, 3)}
    assert {(r.level, r.cluster_id, *r.centroid) for r in centroids.collect()} == {(1, 0, 1, 1), (1, 1, 1, 1), (1, 2, 1, 1), (2, 0, 2, 2)}
    with pytest.raises(SourceNotFoundError):
        arrays.read_level_folders(spark, str(tmp_path / "none"))


def test_table_of_a_run(spark, tmp_path):
    runs = spark.createDataFrame(
        [("a", {"merged_cutouts_info_filename": "all.json", "cutouts_info_filename": "one.json", "clusters_folder": "tree"}), ("b", None)], "run_id string, params map<string,string>"
    )
    os.makedirs(tmp_path / "a")
    (tmp_path / "a" / "all.json").write_text('{"0": {"file_path": "x.npy", "position": [1, 2]}}')
    (tmp_path / "a" / "one.json").write_text("{}")
    assert [r.file_path for r in arrays.load_of_run(spark, runs, "a", str(tmp_path), "cutouts").collect()] == ["x.npy"]
    edges = spark.createDataFrame([(1, 0, 5), (2, 0, 0)], "level int, parent_id long, child_id long")
    arrays.write_clustering(edges, spark.createDataFrame([(1, 0, [0.5]), (2, 0, [1.5])], "level int, cluster_id long, centroid array<double>"), str(tmp_path / "a" / "tree"))
    low, centroids = arrays.load_of_run(spark, runs, "a", str(tmp_path), "clusters")
    assert low.count() == 2 and centroids.where("level = 2").first().centroid == [1.5]
    assert arrays.read_clustering(spark, str(tmp_path / "a" / "tree"), 1)[0].count() == 1
    for run, kind in (("b", "cutouts"), ("c", "cutouts"), ("a", "features")):
        with pytest.raises(SourceNotFoundError):
            arrays.load_of_run(spark, runs, run, str(tmp_path), kind)
    with pytest.raises(ValueError):
        arrays.load_of_run(spark, runs, "a", str(tmp_path), "other")


def test_rows_of_a_copied_run(spark):
    metrics = spark.createDataFrame([("a", "loss", 0.5, 1), ("a", "loss", 0.4, 2), ("b", "loss", 9.0, 1)], "run_id string, key string, value double, step int")
    assert sorted(tuple(r) for r in copied_rows(metrics, "a", "n").collect()) == [("n", "loss", 0.4, 2), ("n", "loss", 0.5, 1)]


def test_misnamed_manifests(spark, tmp_path):
    for name in ("a/info_old.json", "b/info.json", "b/info2.json", "c/info1.json", "c/info2.json", "d/other.json"):
        os.makedirs(tmp_path / name.split("/")[0], exist_ok=True)
        (tmp_path / name).write_text("{}")
    got = manifests.misnamed(spark, str(tmp_path)).collect()
    assert [(r.path.rpartition("/a/")[2], r.new_path.rpartition("/a/")[2]) for r in got] == [("info_old.json", "info.json")]


def test_swap_recovers(spark, tmp_path):
    final = str(tmp_path / "store")
    os.makedirs(f"{final}.replaced")
    (tmp_path / "store.replaced" / "x").write_text("old")
    assert recovered(spark, final) and (tmp_path / "store" / "x").read_text() == "old"
    os.makedirs(f"{final}.replaced")
    assert recovered(spark, final) and not os.path.exists(f"{final}.replaced")
    os.makedirs(tmp_path / "new")
    (tmp_path / "new" / "x").write_text("new")
    swap(spark, str(tmp_path / "new"), final)
    assert (tmp_path / "store" / "x").read_text() == "new" and not os.path.exists(f"{final}.replaced")
    assert not recovered(spark, str(tmp_path / "none"))
