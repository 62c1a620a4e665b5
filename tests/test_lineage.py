"""Ancestors of runs, however long their chain."""

from winnow.operators import registry


def test_lineage_of_long_chains_and_cycles(spark, rows):
    parents = {f"r{k}": f"r{k + 1}" for k in range(9)} | {"a": "b", "b": "a", "self": "self"}
    data = [(r, {"parent_run": p}, {}, "e") for r, p in parents.items()] + [("r9", {}, {}, "e")]
    runs = spark.createDataFrame(data, "run_id string, params map<string,string>, tags map<string,string>, experiment string")
    want = [(f"r{k}", j - k, f"r{j}", "e") for k in range(9) for j in range(k + 1, 10)] + [("a", 1, "b", "e"), ("b", 1, "a", "e")]
    assert rows(registry.lineage(runs)) == sorted(want, key=repr)
