"""The inline examples with answers worked out by hand, and edges."""

from winnow.operators import manifest as M

SCHEMA = "id long, mosaic_name string, pos_row int, pos_col int, size int"
SIX = [(0, "A", 128, 3072, 256), (1, "A", 128, 3200, 256), (2, "A", 128, 3328, 256), (3, "A", 128, 3456, 256), (4, "A", 256, 3072, 256), (5, "A", 384, 3072, 256)]
SEVEN = [(k, "B", r, c, 256) for k, (r, c) in enumerate([(128, 3968), (128, 4096), (128, 4224), (128, 4352), (128, 4480), (384, 4096), (384, 4352)])]


def test_non_overlapping(spark):
    kept = M.non_overlapping(spark.createDataFrame(SIX, SCHEMA))
    assert sorted(r.id for r in kept.collect()) == [0, 2, 5]


def test_non_overlapping_nulls_and_empty(spark):
    odd = spark.createDataFrame([*SIX, (6, "A", None, 3072, 256), (7, None, 128, 3072, None)], SCHEMA)
    assert sorted(r.id for r in M.non_overlapping(odd).collect()) == [0, 2, 5, 7]
    assert M.non_overlapping(spark.createDataFrame([], SCHEMA)).count() == 0


def test_four_and_diagonal_neighbours(spark):
    e = spark.createDataFrame(SEVEN, SCHEMA)

    def near(offsets):
        out = {k: set() for k in range(7)}
        for r in M.neighbours(e, offsets).collect():
            out[r.id].add(r.neighbor_id)
        return out

    assert near(M.four(256, 128)) == {0: {1}, 1: {0, 2, 5}, 2: {1, 3}, 3: {2, 4, 6}, 4: {3}, 5: {1}, 6: {3}}
    assert near(M.diagonal(256, 128)) == {0: {5}, 1: set(), 2: {5, 6}, 3: set(), 4: {6}, 5: {0, 2}, 6: {2, 4}}


def test_windows_of_a_mosaic_that_is_too_small(spark):
    m = spark.createDataFrame([("A", 10, 10), ("B", 3, 10), ("C", None, 10)], "mosaic_name string, height int, width int")
    assert {r.mosaic_name for r in M.windows(m, 4).collect()} == {"A"}
    assert M.windows(m, 4).count() == 16


def test_blank_filter_against_all_pairs(spark):
    m = spark.createDataFrame([("A", 12, 9)], "mosaic_name string, height int, width int")
    blanks = [("A", 3, 3, None), ("A", 11, 8, float("nan")), ("A", 0, 0, 1.0)]
    px = spark.createDataFrame(blanks, "mosaic_name string, row int, col int, value double")
    got = {(r.pos_row, r.pos_col) for r in M.without_blanks(M.windows(m, 4), px, 4).collect()}
    bad = [(3, 3), (11, 8)]
    want = {(r, c) for r in range(0, 9, 2) for c in range(0, 6, 2) if not any(r <= y < r + 4 and c <= x < c + 4 for y, x in bad)}
    assert got == want


def test_numbers_are_dense_and_in_order(spark):
    df = spark.range(1000).selectExpr("(id * 37) % 1000 AS k").repartition(7)
    out = sorted((r.k, r.new_id) for r in M.numbered(df, "k").collect())
    assert out == [(k, k) for k in range(1000)]
    assert M.numbered(df.limit(0), "k").count() == 0


def test_merged_keeps_the_order_of_the_arguments(spark):
    a = spark.createDataFrame([(5, "x"), (2, "y")], "id long, file_path string")
    b = spark.createDataFrame([(1, "z")], "id long, file_path string")
    assert [(r.new_id, r.file_path) for r in M.merged([a, b]).orderBy("new_id").collect()] == [(0, "y"), (1, "x"), (2, "z")]
