"""Build conditions, go.mod, signatures, generics, exclusions and the change feed, on own texts."""

import pytest
from pyspark.sql import functions as F

from declgraph.functions import build, signatures, text
from declgraph.operators import kernels as K
from declgraph.plans import go, structural
from declgraph.sources import golang, gomod
from declgraph.streaming import changes

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(go.QUERIES))
def test_go_queries_equal_sql(spark, name):
    import os

    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    cur = con.execute(go.SQL[name])
    names = [c[0] for c in cur.description]
    df = go.QUERIES[name](spark, SF)
    assert sorted(names) == sorted(df.columns)
    got = sorted(map(repr, (tuple(r[c] for c in names) for r in df.collect())))
    assert got and got == sorted(map(repr, cur.fetchall()))


def test_build_conditions():
    c = build.Context("linux", "amd64", frozenset({"mine"}))
    name = {"a.go": True, "a_linux.go": True, "a_windows.go": False, "a_linux_arm64.go": False, "a_amd64.go": True, "a_windows_amd64.go": False, "linux.go": True, "windows.go": False, "a_windows_test.go": False}
    assert {n: build.name_matches(f"x/{n}", c) for n in name} == name
    said = {"linux": True, "windows": False, "!windows && mine": True, "other": True, "!other": True, "windows && other": False, "windows || other": True, "(linux || windows) && !amd64": False, "unix": True, "((": True, "": True}
    assert {e: build.evaluate(e, c) for e in said} == said
    assert build.legacy_matches("linux,!windows darwin", c) and not build.legacy_matches("windows darwin", c)
    assert build.legacy_matches("custom,windows", c) and not build.legacy_matches("windows,custom", c)
    assert not build.included("a.go", "// x\n//go:build windows\n\npackage a", c) and build.included("a.go", "package a\n//go:build windows", c)
    assert build.included("a.go", None, c) and not build.included("a.go", "// +build windows\n// +build linux\npackage a", c)


def test_included_files(spark):
    files = spark.createDataFrame([("a.go", "package a"), ("a_windows.go", "package a"), ("b.go", "//go:build ignore && windows\npackage a"), ("c.go", None)], "file string, text string")
    assert {r.file for r in build.only_included(files).collect()} == {"a.go", "c.go"}


def test_go_mod():
    m = gomod.parse('module "example.org/app"\n\nrequire example.org/One v1.2.0 // note\nrequire (\n\texample.org/two v0.3.0 // indirect\n\texample.org/three v3.0.0\n)\nreplace example.org/two => ../two\nreplace (\n\texample.org/three => example.org/fork v3.1.0\n)\nexclude example.org/one v1.0.0\n')
    assert m.path == "example.org/app" and m.requires == {"example.org/One": "v1.2.0", "example.org/three": "v3.1.0"} and m.local == {"example.org/two": "../two"}
    assert gomod.locked_directories(m, "/c", "/w") == [("example.org/two", "/w/../two"), ("example.org/One", "/c/example.org/!one@v1.2.0"), ("example.org/three", "/c/example.org/three@v3.1.0"), ("example.org/three", "/c/example.org/fork@v3.1.0")]
    assert gomod.parse(None).path is None


def test_imports_go_to_the_longest_module(spark):
    imports = spark.createDataFrame([(p,) for p in ("a.b/c", "a.b/c/d", "a.b/cd", "a.b/../c", "x", "a.b/c/e/f")], "import_path string")
    modules = spark.createDataFrame([("a.b/c", "/m/c"), ("a.b/c/e", "/m/e")], "module string, directory string")
    assert {tuple(r) for r in gomod.import_directories(imports, modules).collect()} == {("a.b/c", "/m/c"), ("a.b/c/d", "/m/c/d"), ("a.b/c/e/f", "/m/e/f")}
    locks = gomod.read_locks(spark.createDataFrame([("/w", "require a.b/X v1")], "dir string, text string"), "/c")
    assert [tuple(r) for r in locks.collect()] == [("/w", "a.b/X", "/c/a.b/!x@v1")]


def test_slots_references_and_unification():
    assert signatures.split_slots("a,map[b,c]d,func(x,y)(z,w),") == ["a", "map[b,c]d", "func(x,y)(z,w)"] and signatures.split_slots("a)") is None
    assert signatures.split_signature("(int,func(a,b)c)(error)") == (["int", "func(a,b)c"], ["error"]) and signatures.split_signature("x") is None
    assert signatures.named_reference("*@{a.b/c}.T[int,map[x]y]") == ("T", "a.b/c", True, ["int", "map[x]y"]) and signatures.named_reference("[]T") is None
    assert signatures.substitute("f($0,$1)", {"$0": "$1", "$1": "string"}) == "f($1,string)"
    assert signatures.infer(["($0)($0)", "(map[$0]$1)()"], ["(int)(int)", "(map[int][]string)()"], 2) == {"$0": "int", "$1": "[]string"}
    assert signatures.infer(["($0)($0)"], ["(int)(string)"], 1) is None and signatures.infer(["(func($0)$1)()"], ["(func(a,b)c)()"], 2) is None
    known = {"@{p}.N": "int", "@{p}.S": "[]int", "@{p}.L": "@{p}.L"}
    assert [signatures.comparable(v, known) for v in ("int", "[]int", "[3]int", "[2]@{p}.S", "@{p}.N", "@{q}.X", "struct{a:int;b:@{p}.S}", "*T")] == [True, False, True, False, True, None, False, True]
    assert signatures.in_type_set("@{p}.N", ["~int", "string"], known) and not signatures.in_type_set("@{p}.N", ["int"], known) and not signatures.in_type_set("@{p}.S", ["comparable"], known)


def index_of(spark, files):
    frame = spark.createDataFrame([(f, t, p) for f, (t, p) in files.items()], "file string, text string, import_path string")
    return structural.build(golang.declarations(frame))


def test_loose_pass_links_packages_without_a_module(spark):
    index = index_of(spark, {
        "/w/a/a.go": ("package a\n\ntype Item struct{}\ntype Store interface {\n\tGet(k string) Item\n\tother.Thing\n}\ntype Keeper interface { Keep(i Item) error }\n", None),
        "/w/b/b.go": ("package b\n\ntype Item struct{}\ntype Mem struct{}\nfunc (Mem) Keep(x Item) error { return nil }\ntype Bad struct{}\nfunc (Bad) Keep(x int) error { return nil }\n", None),
    })
    assert {r.name for r in structural.implementations(index, "Keeper", "/w/a/a.go").collect()} == {"Mem"}
    assert structural.implementations(index, "Keeper", "a.go").count() == 0  # the whole path, not its end


def test_promoted_methods_are_located_and_generics_inferred(spark):
    index = index_of(spark, {
        "/w/m.go": ("package m\n\ntype I interface { Get() int; Put() }\ntype Base struct{}\nfunc (Base) Get() int { return 1 }\ntype Full struct{ Base }\nfunc (Full) Put() {}\ntype Lit = interface { Only() }\nfunc (t *Loose) Only() {}\n", "e.org/m"),
        "/w/g.go": ("package m\n\ntype Task[T any] interface { Run(in T) (T, error) }\ntype Num[T ~int | string] interface { Add(a T) T }\ntype Good struct{}\nfunc (Good) Run(in []string) ([]string, error) { return in, nil }\ntype Mixed struct{}\nfunc (Mixed) Run(in int) (string, error) { return \"\", nil }\ntype Own int\ntype A struct{}\nfunc (A) Add(a Own) Own { return a }\ntype B struct{}\nfunc (*B) Add(a string) string { return a }\ntype C struct{}\nfunc (C) Add(a float64) float64 { return a }\n", "e.org/m"),
    })
    assert {(r.name, r.line) for r in structural.method_implementations(index, "I", "Get", "/w/m.go").collect()} == {("Base", 4)}
    named = lambda i, f: {r.name for r in structural.implementations(index, i, f).collect()}
    assert named("I", "/w/m.go") == {"Full"} and named("Lit", "/w/m.go") == {"*Loose"}
    assert named("Task", "/w/g.go") == {"Good"} and named("Num", "/w/g.go") == {"A", "*B"}
    assert structural.has_interface(index, "Full", "Get", "/w/m.go") and not structural.has_interface(index, "Mixed", "Run", "/w/g.go")


def test_exclusions_and_candidates(spark):
    d = spark.createDataFrame([("a.b/mock", "_T", "type S interface {\n\tGet(k string)\n}"), ("a.b/x", "*MockT", "func (s S)\n  Get (k string) {}"), (None, "T", None)], "p string, t string, s string")
    rows = d.select(text.excludes_package(F.col("p"), ["*/mock"]).alias("p"), text.excludes_type(F.col("t"), ["Mock"]).alias("t"), text.interface_candidate(F.col("s"), "Get").alias("i"), text.implementation_candidate(F.col("s"), "Get").alias("m")).collect()
    assert [tuple(r) for r in rows] == [(True, True, True, False), (False, True, False, True), (False, False, False, False)]


def test_change_feed_equals_batch(spark, tmp_path):
    log, state = str(tmp_path / "log"), str(tmp_path / "state")
    first = [("a.go", "disk", 1, "upsert", "a1"), ("b.go", "disk", 1, "upsert", "b1"), ("a.go", "overlay", 2, "upsert", "a2")]
    second = [("b.go", "disk", 3, "delete", None), ("a.go", "overlay", 4, "delete", None), ("a.go", "disk", 5, "upsert", "a5"), ("c.go", "disk", 6, "upsert", "c")]
    seen = []
    for part in (first, second):
        spark.createDataFrame(part, changes.SCHEMA).coalesce(1).write.mode("append").parquet(log)
        changes.upsert_stream(spark, log, state, str(tmp_path / "ck")).awaitTermination()
        seen.append({(r.file, r.text) for r in changes.effective(changes.read_state(spark, state)).collect()})
    assert seen == [{("a.go", "a2"), ("b.go", "b1")}, {("a.go", "a5"), ("c.go", "c")}]
    whole = changes.effective(changes.fold(spark.read.schema(changes.SCHEMA).parquet(log)))
    assert {(r.file, r.text) for r in whole.collect()} == seen[1]
    old, new = (spark.createDataFrame(x, "file string, text string") for x in ([("p/a.go", "1"), ("q/b.go", "1"), ("r/c.go", "1")], [("p/a.go", "2"), ("q/b.go", "1"), ("s/d.go", "1")]))
    assert {r.dir for r in changes.changed_packages(old, new).collect()} == {"p", "r", "s"}


def test_parse_cache_parses_what_changed(spark):
    parsed = spark.sparkContext.accumulator(0)
    files = spark.createDataFrame([("a", "1"), ("b", "2"), ("b", "2")], "file string, stamp string")
    cached = spark.createDataFrame([("a", "1", "old"), ("b", "1", "stale")], "file string, stamp string, found string")
    out = changes.parse_with_cache(files, cached, lambda f: f.withColumn("found", F.lit("new")))
    assert {tuple(r) for r in out.collect()} == {("a", "1", "old"), ("b", "2", "new")} and parsed.value == 0


def test_closures_without_path_lists(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(80)], "src long, dst long").withColumn("ord", F.lit(0))
    roots = spark.createDataFrame([(0,)], "root long")
    assert K.reach(links.drop("ord"), roots).count() == 81 and K.first_paths(links.where("src < 20"), roots).count() == 21
    diamond = spark.createDataFrame([("a", "b", 0), ("a", "c", 1), ("b", "d", 0), ("c", "d", 0), ("d", "a", 0)], "src string, dst string, ord int")
    got = {(r.node, r.depth, r.ways) for r in K.reach(diamond, spark.createDataFrame([("a",)], "root string")).collect()}
    assert got == {("a", 0, 1), ("b", 1, 1), ("c", 1, 1), ("d", 2, 2)}
    paths = {r.node: r.path for r in K.first_paths(diamond, spark.createDataFrame([("a",)], "root string")).collect()}
    assert paths == {"a": [], "b": [0], "c": [1], "d": [0, 0]}
