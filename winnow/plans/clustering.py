"""Queries on k-means, its hierarchies and their look-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from winnow.operators import hierarchy as H
from winnow.operators import kmeans as K
from winnow.plans.common import TREE, VECTORS, rounded, tree, vectors

SEED = 0


def _start(spark, folder, k=8):
    points = vectors(spark, folder).select("id", "embedding")
    return points, K.random_init(points, k, SEED)


def k4_random_init(spark, folder):
    _, c = _start(spark, folder)
    return rounded(c.table(spark).select("cluster_id", F.posexplode("centroid").alias("pos", "x")), "x")


def k5_assign_l2(spark, folder):
    points, c = _start(spark, folder)
    return rounded(K.assign(points, c), "dist")


def k5_assign_cos(spark, folder):
    points, c = _start(spark, folder)
    return rounded(K.assign(points, c, "cos"), "dist")


def k5_assign_expression(spark, folder):
    points, c = _start(spark, folder)
    return rounded(K.assign_sql(points, c.table(spark)), "dist")


def a2_update_centroids(spark, folder):
    points, c = _start(spark, folder)
    return rounded(K.update(points, c).table(spark).select("cluster_id", F.posexplode("centroid").alias("pos", "x")), "x")


def k7_lloyd(spark, folder):
    points, c = _start(spark, folder)
    return rounded(K.assign(points, K.lloyd(points, c, 3)), "dist")


def a6_potential(spark, folder):
    points, c = _start(spark, folder)
    c = K.lloyd(points, c, 2)
    return rounded(K.potential(points, K.assign(points, c), c.table(spark)), "potential")


def a4_cluster_lists(spark, folder):
    points, c = _start(spark, folder)
    lists = K.cluster_lists(K.assign(points, c), c.table(spark))
    return lists.select("cluster_id", F.size("members").alias("size"), F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


def w2_sort_by_distance(spark, folder):
    points, c = _start(spark, folder)
    return rounded(K.sorted_by_distance(points, K.assign(points, c), c.table(spark)), "dist")


def l3_closest_n(spark, folder):
    points, c = _start(spark, folder)
    return rounded(K.closest(K.sorted_by_distance(points, K.assign(points, c), c.table(spark)), 5), "dist")


def k10_two_level(spark, folder):
    points = vectors(spark, folder).select("id", "embedding")
    return K.levels(points, K.hierarchical(points, [16, 4], 2, SEED))


def k10_three_level(spark, folder):
    points = vectors(spark, folder).select("id", "embedding")
    return K.levels(points, K.hierarchical(points, [24, 8, 3], 2, SEED))


def k11_resample_step(spark, folder):
    points, c = _start(spark, folder)
    return rounded(K.assign(points, K.resampled(points, K.lloyd(points, c, 1), 1, 10, 1, "c", SEED)), "dist")


def k1_kmeanspp(spark, folder):
    points = vectors(spark, folder).select("id", "embedding")
    c = K.plus_plus_init(points, 8, SEED)
    return rounded(K.assign(points, c), "dist")


def k8_best_of(spark, folder):
    points = vectors(spark, folder).select("id", "embedding")
    return rounded(K.assign(points, K.kmeans(points, 8, 2, starts=2, seed=SEED)), "dist")


def k13_split(spark, folder):
    points, c = _start(spark, folder)
    return rounded(K.split(points, K.assign(points, c), 3), "dist")


def k16_ml_kmeans(spark, folder):
    """Spark ML's k-means, the quick way where parity is not asked for."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = vectors(spark, folder).select("id", array_to_vector("embedding").alias("features"))
    model = KMeans(k=10, seed=1, maxIter=10).fit(data)
    return model.transform(data).select("id", F.col("prediction").alias("cluster_id"))


def j10_flatten(spark, folder):
    return H.flattened(tree(spark, folder)[0], 3)


def j11_trace(spark, folder):
    return H.traced(tree(spark, folder)[0], 3)


def _sized(spark, folder):
    edges, nodes = tree(spark, folder)
    return H.sizes(edges, nodes, 3)


def a5_sizes(spark, folder):
    return _sized(spark, folder)


def w4_size_order(spark, folder):
    return H.size_order(_sized(spark, folder))


def a14_level_sizes(spark, folder):
    return rounded(H.level_sizes(_sized(spark, folder)), "mean_size")


def _lists(spark, folder):
    edges, nodes = tree(spark, folder)
    one = edges.where("level = 1").select(F.col("parent_id").alias("cluster_id"), F.col("child_id").alias("id"))
    return K.cluster_lists(one, nodes.where("level = 1"))


def j12_trace_members(spark, folder):
    """Each order with its customer and the customer's orders."""
    lists = _lists(spark, folder).select(F.col("cluster_id").alias("level_1"), F.array_join(F.slice(F.transform("members", lambda x: x.cast("string")), 1, 25), ",").alias("members"))
    return H.traced(tree(spark, folder)[0], 3).join(lists, "level_1").select("id", "level_1", "level_2", "level_3", "members")


def j17_positions(spark, folder):
    return H.positions(_lists(spark, folder))


def a21_max_index(spark, folder):
    return _lists(spark, folder).agg(F.max(F.array_max("members")).alias("max_index"))


def queries():
    names = [
        k4_random_init, k5_assign_l2, k5_assign_cos, k5_assign_expression, a2_update_centroids, k7_lloyd, a6_potential, a4_cluster_lists,
        w2_sort_by_distance, l3_closest_n, k10_two_level, k10_three_level, k11_resample_step, k1_kmeanspp, k8_best_of, k13_split, k16_ml_kmeans, j10_flatten, j11_trace,
        a5_sizes, w4_size_order, a14_level_sizes, j12_trace_members, j17_positions, a21_max_index,
    ]
    return {f.__name__: f for f in names}


class _Sql:
    """Common table expressions, one after the other."""

    def __init__(self, *first: str):
        self.parts = list(first)

    def add(self, name: str, body: str) -> str:
        self.parts.append(f"{name} AS MATERIALIZED ({body})")
        return name

    def init(self, name: str, points: str, k: int, seed=SEED) -> str:
        return self.add(
            name,
            f"SELECT row_number() OVER (ORDER BY id) - 1 AS cluster_id, v AS c FROM (SELECT id, v FROM {points} ORDER BY md5(concat_ws('|', '{seed}', id)), id LIMIT {k})",
        )

    def assign(self, name: str, points: str, centres: str, kind: str = "l2") -> str:
        d = "list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - k.c[i]) * (p.v[i] - k.c[i])))" if kind == "l2" else "2 - 2 * list_inner_product(p.v, k.c)"
        return self.add(
            name, f"SELECT id, cluster_id, dist FROM (SELECT p.id, k.cluster_id, {d} AS dist FROM {points} p, {centres} k) QUALIFY row_number() OVER (PARTITION BY id ORDER BY dist, cluster_id) = 1"
        )

    def update(self, name: str, points: str, assignment: str, centres: str) -> str:
        return self.add(
            name,
            f"""SELECT k.cluster_id, coalesce(n.c, k.c) AS c FROM {centres} k LEFT JOIN (SELECT cluster_id, list(x ORDER BY pos) AS c FROM
(SELECT cluster_id, pos, avg(x) AS x FROM (SELECT a.cluster_id, unnest(p.v) AS x, generate_subscripts(p.v, 1) AS pos FROM {points} p JOIN {assignment} a USING (id)) GROUP BY ALL) GROUP BY 1) n USING (cluster_id)""",
        )

    def lloyd(self, name: str, points: str, centres: str, iterations: int) -> str:
        for t in range(iterations):
            a = self.assign(f"{name}_a{t}", points, centres)
            centres = self.update(f"{name}_c{t}", points, a, centres)
        return centres

    def select(self, body: str) -> str:
        return "WITH " + ",\n".join(self.parts) + "\n" + body


def _cells(centres: str) -> str:
    return f"SELECT cluster_id, CAST(pos - 1 AS INT) AS pos, round(c[pos], 6) AS x FROM (SELECT cluster_id, c, unnest(range(1, 65)) AS pos FROM {centres})"


def _clustering(make) -> str:
    s = _Sql(VECTORS)
    return s.select(make(s, s.init("k0", "f", 8)))


def _ranked(s: _Sql, k: str) -> str:
    a = s.assign("a", "f", k)
    s.add("r", f"SELECT a.cluster_id, a.id, sqrt(a.dist) AS dist, row_number() OVER (PARTITION BY a.cluster_id ORDER BY sqrt(a.dist), a.id) AS rank_in_cluster FROM {a} a")
    return "r"


def _potential(s: _Sql, k: str) -> str:
    c = s.lloyd("l", "f", k, 2)
    a = s.assign("a", "f", c)
    m = s.update("m", "f", a, c)
    return f"SELECT round(sum(list_sum(list_transform(range(1, 65), lambda i: (f.v[i] - m.c[i]) * (f.v[i] - m.c[i])))), 6) AS potential FROM f JOIN {a} a USING (id) JOIN {m} m USING (cluster_id)"


def _two_level() -> str:
    s = _Sql(VECTORS)
    one = s.lloyd("l1", "f", s.init("k1", "f", 16), 2)
    s.add("up", f"SELECT cluster_id AS id, c AS v FROM {one}")
    two = s.lloyd("l2", "up", s.init("k2", "up", 4), 2)
    a, b = s.assign("a1", "f", one), s.assign("a2", "up", two)
    return s.select(f"SELECT a.id, a.cluster_id AS level_1, b.cluster_id AS level_2 FROM {a} a JOIN {b} b ON b.id = a.cluster_id")


def _three_level() -> str:
    s = _Sql(VECTORS)
    centres, points = [], "f"
    for n, k in enumerate((24, 8, 3)):
        c = s.lloyd(f"l{n}", points, s.init(f"k{n}", points, k), 2)
        centres.append((points, c))
        points = s.add(f"up{n}", f"SELECT cluster_id AS id, c AS v FROM {c}")
    a = [s.assign(f"a{n}", p, c) for n, (p, c) in enumerate(centres)]
    return s.select(
        f"SELECT x.id, x.cluster_id AS level_1, y.cluster_id AS level_2, z.cluster_id AS level_3 FROM {a[0]} x JOIN {a[1]} y ON y.id = x.cluster_id JOIN {a[2]} z ON z.id = y.cluster_id"
    )


def _best_of() -> str:
    """Two starts; of the centroids with the smaller sum of distances the assignment."""
    s = _Sql(VECTORS)
    found = []
    for n in range(2):
        c = s.lloyd(f"b{n}", "f", s.init(f"bk{n}", "f", 8, SEED + n), 2)
        found.append(s.assign(f"ba{n}", "f", c))
    a, b = found
    return s.select(
        f"SELECT id, cluster_id, round(dist, 6) AS dist FROM {a} WHERE (SELECT sum(dist) FROM {a}) <= (SELECT sum(dist) FROM {b}) UNION ALL "
        f"SELECT id, cluster_id, round(dist, 6) FROM {b} WHERE (SELECT sum(dist) FROM {a}) > (SELECT sum(dist) FROM {b})"
    )


def _resampled(s: _Sql, k: str) -> str:
    c = s.lloyd("l", "f", k, 1)
    a = s.assign("ra", "f", c)
    s.add("smp", f"SELECT id FROM {a} QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY dist, id) <= 10")
    s.add("pts", "SELECT f.id, f.v FROM f JOIN smp USING (id)")
    n = s.lloyd("rl", "pts", s.init("rk", "pts", 8), 1)
    return f"SELECT id, cluster_id, round(dist, 6) AS dist FROM {s.assign('fin', 'f', n)}"


_LISTS = "ls AS (SELECT n.cluster_id, list(e.child_id ORDER BY e.child_id) FILTER (e.child_id IS NOT NULL) AS members FROM n LEFT JOIN e ON e.level = 1 AND e.parent_id = n.cluster_id WHERE n.level = 1 GROUP BY 1)"
_TRACE = "tr AS (SELECT a.child_id AS id, a.parent_id AS level_1, b.parent_id AS level_2, d.parent_id AS level_3 FROM e a JOIN e b ON b.level = 2 AND b.child_id = a.parent_id JOIN e d ON d.level = 3 AND d.child_id = b.parent_id WHERE a.level = 1)"


def oracle_sql():
    rows = "SELECT id, cluster_id, round(dist, 6) AS dist FROM {}"
    return {
        "k4_random_init": _clustering(lambda s, k: _cells(k)),
        "k5_assign_l2": _clustering(lambda s, k: rows.format(s.assign("a", "f", k))),
        "k5_assign_cos": _clustering(lambda s, k: rows.format(s.assign("a", "f", k, "cos"))),
        "k5_assign_expression": _clustering(lambda s, k: rows.format(s.assign("a", "f", k))),
        "a2_update_centroids": _clustering(lambda s, k: _cells(s.lloyd("l", "f", k, 1))),
        "k7_lloyd": _clustering(lambda s, k: rows.format(s.assign("a", "f", s.lloyd("l", "f", k, 3)))),
        "a6_potential": _clustering(_potential),
        "a4_cluster_lists": _clustering(
            lambda s, k: f"SELECT k.cluster_id, CAST(count(a.id) AS INT) AS size, coalesce(string_agg(CAST(a.id AS VARCHAR), ',' ORDER BY a.id), '') AS members FROM {k} k LEFT JOIN {s.assign('a', 'f', k)} a USING (cluster_id) GROUP BY 1"
        ),
        "w2_sort_by_distance": _clustering(lambda s, k: f"SELECT cluster_id, id, round(dist, 6) AS dist, rank_in_cluster FROM {_ranked(s, k)}"),
        "l3_closest_n": _clustering(lambda s, k: f"SELECT cluster_id, id, round(dist, 6) AS dist, rank_in_cluster FROM {_ranked(s, k)} WHERE rank_in_cluster <= 5"),
        "k10_two_level": _two_level(),
        "k10_three_level": _three_level(),
        "k8_best_of": _best_of(),
        "k11_resample_step": _clustering(_resampled),
        "j10_flatten": f"WITH {TREE}, {_TRACE} SELECT 1 AS level, level_1 AS cluster_id, id FROM tr UNION ALL SELECT 2, level_2, id FROM tr UNION ALL SELECT 3, level_3, id FROM tr",
        "j11_trace": f"WITH {TREE}, {_TRACE} SELECT * FROM tr",
        "a5_sizes": f"WITH {TREE} SELECT * FROM s",
        "w4_size_order": f"WITH {TREE} SELECT level, cluster_id, row_number() OVER (PARTITION BY level ORDER BY children DESC, cluster_id DESC) AS size_place, row_number() OVER (PARTITION BY level ORDER BY flat_size DESC, cluster_id DESC) AS flat_place FROM s",
        "a14_level_sizes": f"WITH {TREE} SELECT level, round(avg(children), 6) AS mean_size, max(children) AS max_size FROM s GROUP BY 1",
        "j12_trace_members": f"WITH {TREE}, {_TRACE}, {_LISTS} SELECT id, level_1, level_2, level_3, array_to_string(members[1:25], ',') AS members FROM tr JOIN ls ON ls.cluster_id = level_1",
        "j17_positions": f"WITH {TREE}, {_LISTS} SELECT unnest(members) AS id, cluster_id, CAST(len(members) AS INT) AS cluster_size, CAST(generate_subscripts(members, 1) - 1 AS INT) AS position FROM ls",
        "a21_max_index": f"WITH {TREE}, {_LISTS} SELECT max(list_max(members)) AS max_index FROM ls",
    }
