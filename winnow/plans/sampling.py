"""Queries on sampling."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from winnow.functions.draws import uniform
from winnow.operators import hierarchy as H
from winnow.operators import sampling as S
from winnow.plans.common import TREE, table, tree

SEED = 3


def _customers(spark, folder):
    """The children of the nations: customers with twice their orders in work, 40 wanted of each nation."""
    edges, nodes = tree(spark, folder)
    sized = H.sizes(edges, nodes, 3).where("level = 1").select(F.col("cluster_id").alias("child_id"), (F.col("flat_size") * 2).alias("a"))
    return edges.where("level = 2").select("parent_id", "child_id").join(sized, "child_id").select("parent_id", "child_id", "a", F.lit(40).cast("long").alias("target"))


def m1_cut(spark, folder):
    return S.cuts(_customers(spark, folder)).select("parent_id", "target", F.col("cut").cast("long").alias("cut"))


def m4_allocation(spark, folder):
    return S.allocations(_customers(spark, folder), SEED)


def _sample(target, multiplier, strategy):
    def query(spark, folder):
        edges, nodes = tree(spark, folder)
        return S.hierarchical_sample(edges, H.sizes(edges, nodes, 3), 3, target, multiplier, strategy, SEED)

    return query


def _members(spark, folder):
    edges, _ = tree(spark, folder)
    return edges.where("level = 1").select(F.col("parent_id").alias("cluster_id"), F.col("child_id").alias("id"), "rank_in_cluster")


def m2_random_n(spark, folder):
    return S.per_cluster(_members(spark, folder), 2, SEED).select("cluster_id", "id")


def m3_closest_n(spark, folder):
    return _members(spark, folder).where("rank_in_cluster <= 2").select("cluster_id", "id")


def _ids(spark, folder):
    return table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"))


def m7_remap(spark, folder):
    """A sample of ordinals of the orders in work, back to their keys."""
    valid = _members(spark, folder).select("id")
    n = F.broadcast(valid.agg(F.count("*").alias("n")))
    sample = table(spark, folder, "customer").join(n, F.lit(True)).where("c_custkey < n").select(F.col("c_custkey").cast("long").alias("ordinal"), (F.col("c_custkey") % 2).alias("replica"))
    return S.remapped(sample, valid)


def m8_random_sample(spark, folder):
    return S.flat(_ids(spark, folder), 500, SEED)


def m9_fraction(spark, folder):
    return S.fraction(_ids(spark, folder), 5, SEED)


def m10_random_pairs(spark, folder):
    return S.random_pairs(_ids(spark, folder), 400, SEED)


def m11_neighbour_pairs(spark, folder):
    from winnow.plans.manifest import u3_unordered_pairs

    return S.some_pairs(u3_unordered_pairs(spark, folder), 200, SEED)


def m12_equalised(spark, folder):
    o = table(spark, folder, "orders")
    return S.equalised(o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id")), o.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id")), SEED)


def m13_preview(spark, folder):
    return S.preview(_members(spark, folder), _sample(200, 1, "r")(spark, folder))


def m14_background(spark, folder):
    return S.background(_ids(spark, folder), 7, 300, SEED)


def m15_spot_check(spark, folder):
    return S.spot_check(_ids(spark, folder), SEED)


def l4_config_rank(spark, folder):
    c = S.nearest_to_total(S.configurations(500, 3, SEED, spark), 150_000, 10)
    return c.select("config_id", "images")


def j6_sampled_flag(spark, folder):
    return S.marked(_members(spark, folder), _sample(300, 1, "c")(spark, folder))


def w5_running_draw(spark, folder):
    """The first customer whose running share of the flat sizes reaches each of 20 drawn numbers."""
    sized = H.sizes(*tree(spark, folder), 3).where("level = 2").select("cluster_id", "flat_size")
    return S.running_draws(sized, spark.range(20).select(F.col("id").alias("draw"), uniform(SEED, F.col("id")).alias("u")))


def queries():
    names = [m1_cut, m4_allocation, m2_random_n, m3_closest_n, m7_remap, m8_random_sample, m9_fraction, m10_random_pairs, m11_neighbour_pairs, m12_equalised, m13_preview, m14_background, m15_spot_check, l4_config_rank, j6_sampled_flag, w5_running_draw]
    return {f.__name__: f for f in names} | {
        "m6_hier_sample_r": _sample(300, 1, "r"),
        "m6_hier_sample_c": _sample(300, 1, "c"),
        "m6_hier_sample_mul": _sample(5_000, 3, "r"),
    }


def _allocate(name: str, children: str) -> str:
    """CTEs that allocate the quotas of ``children`` (parent_id, child_id, a, target) as ``name``."""
    return f"""{name}_w AS (SELECT *, coalesce(sum(a) OVER (PARTITION BY parent_id ORDER BY a, child_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p,
  count(*) OVER (PARTITION BY parent_id) - row_number() OVER (PARTITION BY parent_id ORDER BY a, child_id) + 1 AS r FROM {children}),
{name}_c AS (SELECT parent_id, target, CAST(CASE WHEN sum(a) <= target THEN max(a)
  ELSE arg_min(CASE WHEN p + r * a > target THEN (target - p) // r END, CASE WHEN p + r * a > target THEN p END) END AS BIGINT) AS cut FROM {name}_w GROUP BY 1, 2),
{name}_b AS (SELECT x.*, c.cut, least(c.cut, x.a) AS base,
  least(x.target, sum(x.a) OVER (PARTITION BY x.parent_id)) - sum(least(c.cut, x.a)) OVER (PARTITION BY x.parent_id) AS rest,
  row_number() OVER (PARTITION BY x.parent_id ORDER BY CAST(x.a > c.cut AS INT) DESC, md5(concat_ws('|', '{SEED}', x.child_id)), x.child_id) AS turn
  FROM {children} x JOIN {name}_c c USING (parent_id)),
{name} AS (SELECT parent_id, child_id, a, CAST(base + CASE WHEN a > cut AND turn <= rest THEN 1 ELSE 0 END AS BIGINT) AS quota FROM {name}_b)"""


def _sample_sql(target: int, multiplier: int, strategy: str) -> str:
    order = f"md5(concat_ws('|', '{SEED}', e.child_id)), e.child_id" if strategy == "r" else "e.rank_in_cluster, e.child_id"
    return f"""{TREE},
ch3 AS (SELECT CAST(-1 AS BIGINT) AS parent_id, cluster_id AS child_id, flat_size * {multiplier} AS a, CAST({target} AS BIGINT) AS target FROM f3), {_allocate("q3", "ch3")},
ch2 AS (SELECT e.parent_id, e.child_id, f2.flat_size * {multiplier} AS a, q.quota AS target FROM e JOIN q3 q ON q.child_id = e.parent_id JOIN f2 ON f2.cluster_id = e.child_id WHERE e.level = 3), {_allocate("q2", "ch2")},
ch1 AS (SELECT e.parent_id, e.child_id, f1.flat_size * {multiplier} AS a, q.quota AS target FROM e JOIN q2 q ON q.child_id = e.parent_id JOIN f1 ON f1.cluster_id = e.child_id WHERE e.level = 2), {_allocate("q1", "ch1")},
dr AS (SELECT e.child_id AS id, q.quota, f1.flat_size, row_number() OVER (PARTITION BY e.parent_id ORDER BY {order}) AS turn
  FROM e JOIN q1 q ON q.child_id = e.parent_id JOIN f1 ON f1.cluster_id = e.parent_id WHERE e.level = 1),
tm AS (SELECT id, least(quota // flat_size, {multiplier}) AS whole, quota % flat_size AS extra, turn FROM dr),
sm AS (SELECT id, unnest(range(0, whole + CASE WHEN whole < {multiplier} AND turn <= extra THEN 1 ELSE 0 END)) AS replica FROM tm)"""


_CHILDREN = f"{TREE}, ch AS (SELECT e.parent_id, e.child_id, f1.flat_size * 2 AS a, CAST(40 AS BIGINT) AS target FROM e JOIN f1 ON f1.cluster_id = e.child_id WHERE e.level = 2), {_allocate('q', 'ch')}"


def _draw(n: str, where: str = "true") -> str:
    return f"SELECT o_orderkey AS id FROM orders WHERE {where} ORDER BY md5(concat_ws('|', '{SEED}', o_orderkey)), o_orderkey LIMIT {n}"


def oracle_sql():
    from winnow.plans import manifest

    u3 = manifest.oracle_sql()["u3_unordered_pairs"]
    pairs = " JOIN ".join(
        f"(SELECT o_orderkey AS {c}, row_number() OVER (ORDER BY md5(concat_ws('|', '{SEED}|{c}', o_orderkey)), o_orderkey) AS rn FROM orders QUALIFY rn <= 400) {c}_" for c in "xy"
    )
    words = ", ".join(
        f"{lo} + CAST('0x' || substr(md5('{SEED}|{n}|{j}|' || i), 1, 8) AS BIGINT) % {hi - lo + 1} AS {n}{j}" for n, lo, hi in (("k", 50, 5000), ("r", 0, 10), ("m", 2, 30)) for j in range(3)
    )
    return {
        "m1_cut": f"WITH {_CHILDREN} SELECT * FROM q_c",
        "m4_allocation": f"WITH {_CHILDREN} SELECT * FROM q",
        "m2_random_n": f"WITH {TREE} SELECT parent_id AS cluster_id, child_id AS id FROM e WHERE level = 1 QUALIFY row_number() OVER (PARTITION BY parent_id ORDER BY md5(concat_ws('|', '{SEED}', child_id)), child_id) <= 2",
        "m3_closest_n": f"WITH {TREE} SELECT parent_id AS cluster_id, child_id AS id FROM e WHERE level = 1 AND rank_in_cluster <= 2",
        "m7_remap": f"""WITH {TREE}, vd AS (SELECT child_id AS id, row_number() OVER (ORDER BY child_id) - 1 AS ordinal FROM e WHERE level = 1)
SELECT id, c_custkey % 2 AS replica FROM customer JOIN vd ON ordinal = c_custkey""",
        "m8_random_sample": _draw("500"),
        "m9_fraction": _draw("(SELECT greatest(1, count(*) // 5) FROM orders)"),
        "m10_random_pairs": f"SELECT DISTINCT least(x, y) AS id_a, greatest(x, y) AS id_b FROM {pairs} ON x_.rn = y_.rn WHERE x <> y",
        "m11_neighbour_pairs": f"SELECT id_a, id_b FROM ({u3}) ORDER BY md5(concat_ws('|', '{SEED}', id_a, id_b)), id_a, id_b LIMIT 200",
        "m12_equalised": f"""WITH n AS (SELECT least(count(*) FILTER (o_orderstatus = 'F'), count(*) FILTER (o_orderstatus = 'P')) AS n FROM orders)
SELECT id, 'a' AS side FROM ({_draw("(SELECT n FROM n)", "o_orderstatus = 'F'")}) UNION ALL SELECT id, 'b' FROM ({_draw("(SELECT n FROM n)", "o_orderstatus = 'P'")})""",
        "m13_preview": f"""WITH {_sample_sql(200, 1, "r")}, fl AS (SELECT parent_id AS cluster_id, child_id AS id, rank_in_cluster, child_id IN (SELECT id FROM sm) AS is_sampled FROM e WHERE level = 1)
SELECT cluster_id, id, is_sampled FROM fl QUALIFY count(*) OVER (PARTITION BY cluster_id) <= 6 OR row_number() OVER (PARTITION BY cluster_id, is_sampled ORDER BY rank_in_cluster, id) <= 3""",
        "m14_background": f"SELECT id FROM ({_draw('300')}) UNION SELECT o_orderkey FROM orders WHERE o_orderkey = 7",
        "m15_spot_check": f"SELECT min(o_orderkey) AS id FROM orders UNION SELECT max(o_orderkey) FROM orders UNION SELECT id FROM ({_draw('3')})",
        "l4_config_rank": f"""WITH t AS (SELECT i AS config_id, {words} FROM range(500) r(i))
SELECT config_id, k0 * r0 * m0 + k1 * r1 * m1 + k2 * r2 * m2 AS images FROM t ORDER BY abs(images - 150000), config_id LIMIT 10""",
        "j6_sampled_flag": f"WITH {_sample_sql(300, 1, 'c')} SELECT child_id AS id, child_id IN (SELECT id FROM sm) AS is_sampled FROM e WHERE level = 1",
        "w5_running_draw": f"""WITH {TREE}, r AS (SELECT cluster_id, sum(flat_size) OVER (ORDER BY cluster_id) AS cum, sum(flat_size) OVER () AS total FROM f2),
d AS (SELECT i AS draw, CAST('0x' || substr(md5('{SEED}|' || i), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM range(20) x(i))
SELECT draw, min(cluster_id) AS cluster_id FROM d JOIN r ON cum >= u * total GROUP BY 1""",
        "m6_hier_sample_r": f"WITH {_sample_sql(300, 1, 'r')} SELECT id, CAST(replica AS INT) AS replica FROM sm",
        "m6_hier_sample_c": f"WITH {_sample_sql(300, 1, 'c')} SELECT id, CAST(replica AS INT) AS replica FROM sm",
        "m6_hier_sample_mul": f"WITH {_sample_sql(5000, 3, 'r')} SELECT id, CAST(replica AS INT) AS replica FROM sm",
    }
