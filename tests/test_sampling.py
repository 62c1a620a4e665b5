"""Allocations against the definition, samples against their invariants."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from winnow.operators import hierarchy as H
from winnow.operators import sampling as S

CHILDREN = "parent_id long, child_id long, a long, target long"


def _cut(sizes, target):
    if sum(sizes) <= target:
        return max(sizes)
    x = 0
    while sum(min(x + 1, a) for a in sizes) <= target:
        x += 1
    return x


def test_cuts_and_quotas(spark):
    rng = random.Random(4)
    cases = [([rng.randrange(0, 30) for _ in range(rng.randrange(1, 12))], rng.randrange(0, 150)) for _ in range(150)]
    rows = [(p, 100 * p + k, a, t) for p, (sizes, t) in enumerate(cases) for k, a in enumerate(sizes)]
    df = spark.createDataFrame(rows, CHILDREN)
    cuts = {r.parent_id: r.cut for r in S.cuts(df).collect()}
    quotas = {}
    for r in S.allocations(df, 1).collect():
        quotas.setdefault(r.parent_id, []).append((r.quota, r.a))
    for p, (sizes, t) in enumerate(cases):
        assert cuts[p] == _cut(sizes, t)
        assert sum(q for q, _ in quotas[p]) == min(t, sum(sizes))
        assert all(min(cuts[p], a) <= q <= min(cuts[p] + 1, a) for q, a in quotas[p])


def _tree(spark):
    rng = random.Random(1)
    points = [(1, rng.randrange(0, 9), i) for i in range(200)]
    edges = spark.createDataFrame(points, "level int, parent_id long, child_id long").withColumn("rank_in_cluster", F.col("child_id"))
    upper = spark.createDataFrame([(2, k % 3, k) for k in range(12)], "level int, parent_id long, child_id long").withColumn("rank_in_cluster", F.lit(None).cast("long"))
    nodes = spark.createDataFrame([(1, k) for k in range(12)] + [(2, k) for k in range(3)], "level int, cluster_id long")
    return edges.unionByName(upper), nodes


def test_hierarchical_sample(spark):
    edges, nodes = _tree(spark)
    sizes = H.sizes(edges, nodes, 2).cache()
    for target, multiplier, strategy in ((50, 1, "r"), (50, 1, "c"), (500, 3, "r"), (10_000, 2, "c")):
        out = S.hierarchical_sample(edges, sizes, 2, target, multiplier, strategy, 5).collect()
        assert len(out) == min(target, 200 * multiplier)
        assert len(set(out)) == len(out)
        assert max(r.replica for r in out) < multiplier


def test_sizes_count_empty_clusters(spark):
    edges, nodes = _tree(spark)
    sizes = {(r.level, r.cluster_id): r.flat_size for r in H.sizes(edges, nodes, 2).collect()}
    assert sizes[1, 9] == sizes[1, 10] == 0
    assert sum(v for (level, _), v in sizes.items() if level == 2) == 200


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 20), min_size=1, max_size=8), st.integers(0, 100))
def test_definition_of_the_cut(sizes, target):
    cut = _cut(sizes, target)
    assert sum(min(cut, a) for a in sizes) <= max(target, sum(sizes) if sum(sizes) <= target else target)


def test_turns_of_a_large_cluster(spark):
    """Only about as many points as are drawn are ranked, and they are the ones a full sort gives."""
    from winnow.functions.draws import draw_order

    points = spark.range(3000).select(F.lit(1).cast("long").alias("cluster_id"), "id", F.lit(100).cast("long").alias("quota"), F.lit(3000).cast("long").alias("flat_size"))
    turns = S._turns(points, 1, 9)
    assert turns.count() == 3000 and 100 <= turns.where("turn < 2147483647").count() < 500
    want = {r.id for r in points.orderBy(draw_order(9, F.col("id")), "id").limit(100).collect()}
    assert {r.id for r in turns.where("turn <= 100").collect()} == want


def test_running_draws(spark):
    weights = spark.createDataFrame([(3, 5), (1, 2), (2, 0), (7, 3)], "cluster_id long, flat_size long")
    draws = spark.createDataFrame([(0, 0.0), (1, 0.2), (2, 0.21), (3, 0.7), (4, 0.71), (5, 0.999)], "draw long, u double")
    got = {r.draw: r.cluster_id for r in S.running_draws(weights, draws).collect()}
    assert got == {0: 1, 1: 1, 2: 3, 3: 3, 4: 7, 5: 7}
    assert S.running_draws(weights.limit(0), draws).count() == 0
