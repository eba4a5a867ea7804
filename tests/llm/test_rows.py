"""Names of rows, flags that come back to them, reruns over other files, crowded segments, the whole pipeline."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from declgraph.llm import mixing, simhash
from declgraph.llm.common import Stored, new_path, split_words


@pytest.mark.parametrize("most_bytes", [None, 1])
def test_flags_come_back_to_their_rows(spark, most_bytes):
    path = new_path(spark, "rows")
    spark.range(0, 9000, 1, 5).selectExpr("id", "id as __uid", "cast(id as string) as __Value").write.parquet(path)
    stored = Stored(spark.read.parquet(path))
    rows = stored.pick("id")
    assert rows.select("uid").distinct().count() == 9000
    found = stored.flagged(rows.where("id % 7 = 0").select("uid", (F.col("id") % 4).alias("value")), bits=2, most_bytes=most_bytes)
    assert found.where("__value <> if(__c0 % 7 = 0, __c0 % 4, 0)").count() == 0 and found.count() == 9000
    kept = stored.without(rows.where("id > 9").select("uid"))
    assert kept.columns == ["id", "__uid", "__Value"] and sorted(r[0] for r in kept.collect()) == list(range(10))
    assert stored.without(rows.where("false").select("uid")).count() == 9000


def test_mix_agrees_over_other_files(spark, docs):
    found = []
    for n in (1, 4):
        path = new_path(spark, "layout")
        docs.repartition(n, F.rand(n)).write.parquet(path)
        found.append(Counter(tuple(r)[1:] for r in mixing.mix(spark.read.parquet(path)).collect()))
    assert found[0] == found[1]


@pytest.mark.parametrize("crowded", [64, 2])
def test_segment_tables_miss_no_near_fingerprint(spark, crowded):
    r = random.Random(8)
    fps = {r.getrandbits(64) for _ in range(60)} | {(12345 << 32) | r.getrandbits(5) for _ in range(20)}
    for f in list(fps):
        fps.add(f ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)))
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    root = {f: f for f in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    got = [(e.u, e.v) for e in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), crowded).collect()]
    near = [(a, b) for a in signed for b in signed if a > b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2]
    assert set(got) <= set(near)
    for u, v in got:
        root[max(find(u), find(v))] = min(find(u), find(v))
    assert all(find(a) == find(b) for a, b in near)


def test_words_are_those_of_bytes_split():
    import pyarrow as pa

    texts = [None, "", " a  b ", "x", "\t\x0b\x0c\r\n", "a\x1cb\x85c\xa0d É", "A a"]
    (lo, hi, offsets, codes, words), = split_words(pa.array(texts, pa.string()), lower=True)
    listed = [words[int(c)].as_py().encode() for c in codes]
    assert [listed[a:b] for a, b in zip(offsets, offsets[1:])] == [(t or "").encode().lower().split() for t in texts]


def test_pipeline_runs_whole(spark, docs):
    import corpus_pipeline

    path = new_path(spark, "corpus")
    docs.withColumn("lang", F.lit("en")).write.parquet(f"{path}/documents.parquet")
    out = corpus_pipeline.run(spark, path)
    assert out.count() > 0 and out.where("not round_trip").count() == 0
