import os

import pytest
from pyspark.sql import functions as F

from declgraph.functions.text import build_matches, excludes_folder, interface_candidate
from declgraph.operators import kernels as K
from declgraph.plans import driver

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(driver.QUERIES))
def test_queries_equal_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    cur = con.execute(driver.SQL[name])
    names = [c[0] for c in cur.description]
    df = driver.QUERIES[name](spark, SF)
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in df.collect()))) == sorted(map(repr, cur.fetchall()))


def test_division_needs_every_element(spark):
    req = spark.createDataFrame([("Store", "Get"), ("Store", "Put"), ("Store", "Put"), ("Closer", "Close")], "i string, m string")
    have = spark.createDataFrame([("Mem", "Get"), ("Mem", "Put"), ("Partial", "Get"), ("File", "Close"), ("File", "Close")], "t string, m string")
    assert {(r.i, r.t) for r in K.divide(req, have, "i", "t", ["m"]).collect()} == {("Store", "Mem"), ("Closer", "File")}


def test_shallower_members_hide_and_equal_depths_are_ambiguous(spark):
    edges = spark.createDataFrame([("A", "B", 0), ("A", "C", 1), ("C", "D", 0), ("D", "A", 0)], "src string, dst string, ord int")
    paths = K.reach(edges, spark.createDataFrame([("A",)], "root string"))
    own = spark.createDataFrame([("B", "Run", "method"), ("C", "Run", "method"), ("B", "Stop", "method"), ("D", "Stop", "method"), ("C", "Name", "field")], "node string, m string, kind string")
    got = {r.m: (r.depth, r.n, r.callable) for r in K.min_depth_unique(paths.join(own, "node"), ["root"], "m").collect()}
    assert got == {"Run": (1, 2, False), "Stop": (1, 1, True), "Name": (1, 1, False)}


def test_aliases_on_a_cycle_have_no_end(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "name string, target string")
    assert {(r.name, r.terminal) for r in K.fixpoint(links, rounds=5).collect()} == {("a", "c"), ("b", "c")}


def test_text_functions(spark):
    frame = spark.createDataFrame([("a/vendor/b", "type S interface { Get(k string) }"), ("a/vend", "\tGet(k string) error"), (None, "x.Get(1)")], "d string, t string")
    rows = frame.select(excludes_folder(F.col("d"), ["ven*r"]).alias("x"), interface_candidate(F.col("t"), "Get").alias("c"), build_matches(F.lit(None).cast("boolean")).alias("b")).collect()
    assert [(r.x, r.c, r.b) for r in rows] == [(True, True, True), (False, True, True), (False, False, True)]


def test_loose_equal_takes_every_event(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (499_999, "b"), (500_000, "c"), (7_000_000_000, "d")], "event_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    assert {r.event_id for r in driver.loose_equal(spark, str(tmp_path)).collect()} == {1, 499_999, 500_000, 7_000_000_000}
