"""Graph queries over whole key ranges."""

from leafweave.plans import registry

SF = "/root/testdata/sf0.001"


def test_components_of_every_row(spark):
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_partkey").collect()
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for o, p in rows:
        a, b = sorted((find(o), find(-1 - p)))
        root[b] = a
    got = {r["node"]: r["root"] for r in registry.QUERIES["connected_components"](spark, SF).collect()}
    assert got == {i: find(i) for i in root} and len(got) > len({o for o, _ in rows})


def test_ends_over_all_customers(spark):
    most = spark.read.parquet(f"{SF}/customer.parquet").agg({"c_custkey": "max"}).first()[0]
    e = registry._graph(spark, SF)[0].collect()
    assert {r["source"] for r in e} == {r["o_custkey"] for r in spark.read.parquet(f"{SF}/orders.parquet").select("o_custkey").collect()}
    assert all(r["target"] == most - r["source"] for r in e)
