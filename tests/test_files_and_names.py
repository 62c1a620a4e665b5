import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from winnow.functions import names as N
from winnow.functions.npy import canonical, patch_name, read_npy
from winnow.operators import labels as L
from winnow.operators import registry as R
from winnow.operators.pipeline import ClusteringConfig, latest_step, memoised, run_stages
from winnow.operators.small_files import consolidate, idle
from winnow.sources.arrays import parse_fits, read_features, read_fits
from winnow.sources.errors import SourceNotFoundError
from winnow.sources.manifests import folders_without, mosaic_folders, read_manifest


def _npy(a, version=None):
    out = io.BytesIO()
    np.lib.format.write_array(out, a, version)
    return out.getvalue()


def test_layouts_of_one_array_are_equal():
    a = np.arange(6, dtype="<f4").reshape(2, 3)
    same = [_npy(a), _npy(a.astype(">f4")), _npy(np.asfortranarray(a)), _npy(a.astype("f8"), (2, 0)), _npy(a) + b"more"]
    assert len({canonical(read_npy(p)) for p in same}) == 1
    assert canonical(read_npy(_npy(a.reshape(3, 2)))) != canonical(a)
    assert canonical(np.array([0.0, np.nan])) == canonical(np.array([-0.0, np.nan]))


@pytest.mark.parametrize("payload", [None, b"", b"\x93NUMPY", b"text", _npy(np.zeros(9))[:-1], b"\x93NUMPY\x01\x00\x02\x00{}", b"\x93NUMPY\x09\x00\x02\x00{}"])
def test_incomplete_payloads(payload):
    assert read_npy(payload) is None


@pytest.mark.parametrize(
    "path",
    [
        "cut_ab12/K00024+09/npy/patch_12_3.npy", "./cut_ab12/K00024+09/npy/../npy/patch_12_3.NPY ", "archive/cut_ab12/_retry_1/K00024+09/npy/patch_0012_03-copy.npy",
        "cut_ab12\\K00024+09\\npy\\patch_12_3 (2).npy", "cut_ab12/K00024%2B09/npy//patch_12_3.npy.bak", "cut_ab12/K00024+09/_tmp_12345f/npy/patch_12_3.npy",
    ],
)
def test_spellings_of_one_patch(path):
    assert patch_name(path) == ("cut_ab12", "00024", 12, 3)


def test_paths_that_name_no_patch():
    assert patch_name(None) is patch_name("") is patch_name("cut_ab12/K00024+09/info.json") is None


FILES = "file_id long, file_path string, payload binary, extra string"


def test_consolidation(spark, tmp_path):
    a, b = np.ones((2, 2), "f4"), np.zeros((2, 2), "f4")
    p = "cut_ab/K00001+01/npy/patch_{}_0.npy"
    rows = [
        (5, p.format(1), _npy(a), "x"), (3, "./" + p.format(1), _npy(a.astype("f8")), None), (9, p.format(1), _npy(b), None), (1, p.format(2), None, None),
        (2, p.format(2), _npy(a)[:-3], None), (4, None, _npy(a), None), (6, None, _npy(b), None), (9, p.format(1), _npy(b), None),
    ]
    files = spark.createDataFrame(rows, FILES)
    folder = str(tmp_path / "store")
    for _ in range(2):  # the second run replaces the first
        classified = consolidate(files, folder, target_bytes=300)
    store = spark.read.parquet(folder)
    assert sorted(r.file_id for r in store.collect()) == [3, 4, 6, 9]
    assert {r.file_id for r in idle(classified, store).collect()} == {1, 2, 5}
    assert consolidate(spark.createDataFrame([], FILES), str(tmp_path / "none")).count() == 0


def test_consolidation_of_a_version_with_very_many_files(spark, tmp_path):
    a, b = _npy(np.ones((2, 2), "f4")), _npy(np.zeros((2, 2), "f4"))
    p = "cut_ab/K00001+01/npy/patch_{}_0.npy"
    rows = [(k, p.format(1), a, None) for k in range(50, 1300)] + [(k, p.format(k), b, None) for k in range(2000, 2040)] + [(7, p.format(1), b, None), (8, None, b, None)]
    folder = str(tmp_path / "store")
    classified = consolidate(spark.createDataFrame(rows, FILES).repartition(6), folder, target_bytes=2000)
    store = spark.read.parquet(folder)
    assert sorted(r.file_id for r in store.collect()) == [7, 8, 50, *range(2000, 2040)]
    assert idle(classified, store).count() == 1249
    places = [[(r.run or "", r.mosaic or "", r.pos_row or 0) for r in spark.read.parquet(str(f)).collect()] for f in (tmp_path / "store").glob("*.parquet")]
    assert len(places) > 1 and all(x == sorted(x) for x in places)


def test_label_literals(spark):
    cases = {"['a', \"b c\"]": ["a", "b c"], "[]": [], "": [], "['a": [], "nothing": [], "{'a'}": [], " ['x'] ": ["x"]}
    df = spark.createDataFrame([(k,) for k in [*cases, None]], "s string")
    got = {r.s: r.c for r in df.select("s", L.categories(F.col("s")).alias("c")).collect()}
    assert got == {**cases, None: []}


def test_hosts_and_parameters(spark):
    row = spark.range(1).select(N.hosts(F.lit("n[1-2,08]")).alias("h"), N.hosts(F.lit("x")).alias("x"), N.parameters(F.array(F.lit("a=1"), F.lit("b"), F.lit("c=d=e"))).alias("p")).first()
    assert row.h == ["n1", "n2", "n08"] and row.x == ["x"] and row.p == {"a": "1", "c": "d=e"}


def test_runs(spark):
    runs = spark.createDataFrame(
        [("r1", "cut", {"k": "1"}, {"stage": "1"}), ("r2", "feat", {"k": "2"}, {"parent_run": "r1", "mlflow.x": "y"})], "run_id string, experiment string, params map<string,string>, tags map<string,string>"
    ).withColumn("start_time", F.lit("2024-01-01").cast("timestamp_ntz"))
    assert R.unique_run(runs, params={"k": 2}) == "r2"
    with pytest.raises(R.AmbiguousRun):
        R.unique_run(runs, tags={"stage": "9"})
    with pytest.raises(ValueError):
        R.matching(runs)
    assert R.copied(runs, "r2", "n").first().tags == {"parent_run": "r1", "copied_from_run_id": "r2"}
    assert [tuple(r) for r in R.lineage(runs).collect()] == [("r2", 1, "r1", "cut")]
    assert R.record(runs, "r3", "cut", {"n": 3}).count() == 3
    assert R.config_hash({"a": 1, "t": 2}, ("t",)) == R.config_hash({"a": 1})


def test_config_and_stages(spark, tmp_path):
    assert ClusteringConfig(2, [10, 3]).n_splits == [1, 1]
    with pytest.raises(ValueError):
        ClusteringConfig(2, [10])
    with pytest.raises(ValueError):
        ClusteringConfig(1, [10], n_splits=[2], n_resampling_steps=[3])
    assert run_stages({"b": (["a"], lambda x: x + 1), "a": ([], lambda: 1)})["b"] == 2
    with pytest.raises(ValueError):
        run_stages({"a": (["b"], id)})
    calls = []

    def make():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert memoised(spark, str(tmp_path), {"x": 1}, make).count() == 3
    assert len(calls) == 1
    spark.range(1).write.parquet(str(tmp_path / "steps/step=0"))
    assert latest_step(spark, str(tmp_path / "steps")) == 0


def test_readers(spark, tmp_path):
    (tmp_path / "info.json").write_text('{"0": {"file_path": "a", "position": [1, 2], "size": 4}, "1": {"file_path": "b"}}')
    assert sorted(r.id for r in read_manifest(spark, str(tmp_path / "info.json")).collect()) == [0, 1]
    with pytest.raises(SourceNotFoundError):
        read_manifest(spark, str(tmp_path / "nothing.json"))
    np.save(tmp_path / "f.npy", np.arange(12, dtype="f4").reshape(4, 3))
    out = read_features(spark, str(tmp_path / "f.npy")).orderBy("id").collect()
    assert [r.embedding for r in out] == [[0, 1, 2], [3, 4, 5], [6, 7, 8], [9, 10, 11]]
    with pytest.raises(ValueError):
        read_features(spark, "x.txt")
    for name in ("image", "other"):
        (tmp_path / "mosaics" / name).mkdir(parents=True)
    (tmp_path / "mosaics/image/mosaic-blanked.fits").write_bytes(b"x")
    (tmp_path / "mosaics/image/mosaic.pybdsmmask.fits").write_bytes(b"x")
    (tmp_path / "mosaics/other/mosaic-blanked.fits").write_bytes(b"x")
    assert [r.mosaic_name for r in mosaic_folders(spark, str(tmp_path)).collect()] == ["image"]
    assert folders_without(spark, str(tmp_path / "mosaics")).count() == 2


def test_fits(spark, tmp_path):
    cards = ["SIMPLE  =                    T", "BITPIX  =                   16", "NAXIS   =                    2", "NAXIS1  =                    3", "NAXIS2  =                    2", "BLANK   =                   -1", "BSCALE  =                  2.0", "END"]
    head = "".join(c.ljust(80) for c in cards).ljust(2880).encode()
    data = head + np.array([[1, 2, -1], [4, 5, 6]], ">i2").tobytes().ljust(2880, b"\0")
    assert np.array_equal(parse_fits(data), [[2, 4, np.nan], [8, 10, 12]], equal_nan=True)
    (tmp_path / "a.fits").write_bytes(data)
    assert sorted(r.row for r in read_fits(spark, str(tmp_path / "a.fits")).collect()) == [0, 1]


def test_stream(spark, tmp_path):
    from winnow.operators.kmeans import Centroids
    from winnow.streaming.ingest import assign_stream

    schema = "id long, embedding array<double>"
    spark.createDataFrame([(1, [0.0, 0.1]), (2, [1.0, 1.0])], schema).write.parquet(str(tmp_path / "in"))
    centres = Centroids(np.array([0, 1]), np.array([[0.0, 0.0], [1.0, 1.0]]))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        assign_stream(stream, centres, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert sorted((r.id, r.cluster_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, 0), (2, 1)]
