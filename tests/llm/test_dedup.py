import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from declgraph.llm import exact, graph, mixing, sharding, simhash
from declgraph.llm.common import new_path

WS = "[\x20\x09-\x0d]+"


def roots(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(up)}


@pytest.mark.parametrize("block", [7, 64, 16384])
def test_exact_dedup_equals_brute_force(spark, docs, block):
    rows = [(r.doc_id, re.sub(WS, " ", r.text or "")) for r in docs.collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    keep = {t: min((i for i in g if i is not None), default=None) for t, g in groups.items()}
    want = Counter((i, keep[t], len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)
    got = exact.exact_dedup(docs, block).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_a_key_over_many_partitions_has_one_name(spark):
    frame = spark.range(0, 3000, 1, 7).select(F.col("id").alias("doc_id"), F.expr("if(id % 3 = 0, 'hot', cast(id as string))").alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ids = exact.identities(frame).groupBy("n", "name").count()
        assert ids.where("count > 1").collect()[0]["count"] == 1000 and ids.count() == 2001
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_drop_copies_keeps_one_row_of_each_text(spark, docs):
    kept = exact.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(re.sub(WS, " ", r.text or "") for r in kept.collect()) == sorted({re.sub(WS, " ", r.text or "") for r in docs.collect()})


def test_empty_tables(spark, docs):
    none = docs.where("false")
    assert exact.exact_dedup(none).count() == 0
    assert simhash.near_dedup(none).count() == 0
    assert mixing.mix(none).count() == 0
    path = new_path(spark, "none")
    sharding.shuffle_to_shards(none, path)


def test_components_equal_union_find(spark):
    import random

    r = random.Random(1)
    edges = [(a, b) for a, b in ((r.randint(0, 400), r.randint(0, 400)) for _ in range(330)) if a != b] + [(i + 1000, i + 1001) for i in range(60)]
    frame = spark.createDataFrame([(max(e), min(e)) for e in edges], "u long, v long")
    want = {k: v for k, v in roots(edges).items() if k != v}
    assert {x.node: x.root for x in graph.components(frame).collect()} == want


def plain_fingerprint(text, width):
    import xxhash

    words = [w for w in re.split(WS, re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def test_fingerprints_and_components_equal_brute_force(spark, docs):
    rows = [(r.doc_id, plain_fingerprint(r.text, 3)) for r in docs.collect()]
    got = simhash.near_dedup(docs).collect()
    assert Counter((r.doc_id, r.fp % 2**64) for r in got) == Counter(rows)
    edges = [(i, j) for i in range(len(rows)) for j in range(i) if (rows[i][1] ^ rows[j][1]).bit_count() <= 2]
    root = roots(edges)
    reach = defaultdict(list)
    for i in range(len(rows)):
        reach[root.get(i, i)].append(i)
    want = Counter()
    for members in reach.values():
        least = min((rows[i][0] for i in members if rows[i][0] is not None), default=None)
        want.update((rows[i][0], least) for i in members)
    assert Counter((r.doc_id, r.component_id) for r in got) == want
    assert sum(r.kept for r in got) == len(reach)


def test_links_miss_no_near_fingerprints(spark):
    import random

    r = random.Random(5)
    fps = {r.getrandbits(64) for _ in range(30)}
    for f in list(fps):
        for _ in range(12):
            f ^= 1 << r.randrange(64)
            fps.add(f)
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    found = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()
    assert all((e.u ^ e.v) & (2**64 - 1) and ((e.u ^ e.v) & (2**64 - 1)).bit_count() <= 2 for e in found)
    brute = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2]
    assert roots([(e.u, e.v) for e in found]) == roots(brute)


def water(totals, weights=(5, 2, 1), most=3):
    order = sorted(totals, key=lambda s: (s is None, s))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    whole, capped = sum(totals.values()), set()
    while True:
        left = whole - sum(most * totals[s] for s in capped)
        weight = sum(w[s] for s in order if s not in capped)
        target = {s: most * totals[s] if s in capped else left * w[s] / weight for s in order}
        over = {s for s in order if s not in capped and target[s] > most * totals[s]}
        if not over:
            return target
        capped |= over


def test_mix_meets_targets(spark, docs):
    rows = [(r.doc_id, r.source, len(re.findall("[^\x20\x09-\x0d]+", r.text or ""))) for r in docs.collect()]
    totals = Counter()
    for _, s, n in rows:
        totals[s] += n
    want = water(totals)
    got = mixing.mix(docs).collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, n) for i, _, n in rows)
    assert sorted({(r.source_size, round(r.target, 6)) for r in got}) == sorted({(totals[s], round(want[s], 6)) for s in totals})
    assert all(0 <= r.taken <= 3 * r["size"] and r.taken % max(1, r["size"]) == 0 for r in got)
    assert Counter(map(tuple, mixing.mix(docs).collect())) == Counter(map(tuple, got))
    assert mixing.emit(docs).count() == sum(r.copies for r in got)


@pytest.mark.parametrize("slice_rows", [50, 10**6])
def test_mix_is_close_in_large_sources(spark, slice_rows):
    frame = spark.range(0, 6000, 1, 5).select(F.col("id").alias("doc_id"), F.expr("case when id % 3 = 0 then 'a' when id % 7 = 0 then null else concat('b', id % 4) end").alias("source"), F.expr("repeat('w ', cast(pmod(hash(id), 90) as int))").alias("text"))
    for r in mixing.mix(frame, slice_rows=slice_rows).groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect():
        assert abs(r.taken - r.target) < 0.02 * r.target + 200
        assert r.target <= 3 * r.source_size


def test_targets_equal_repeated_capping(spark):
    import random

    r = random.Random(9)
    for n in (1, 2, 5, 9):
        totals = {f"s{i:02}": r.choice([0, 3, 10, 500, 4000]) for i in range(n)} | {None: 7}
        frame = spark.createDataFrame(list(totals.items()), "source string, source_size long")
        got = {x.source: x.target for x in mixing.targets(frame).collect()}
        assert got == pytest.approx(water(totals))


def test_shards_hold_every_row_once(spark, docs):
    def run(**more):
        path = new_path(spark, "t")
        sharding.shuffle_to_shards(docs, path, **more)
        return spark.read.parquet(path).collect()

    for size in (2000, 1 << 24):
        got, again, other = run(bucket_bytes=size), run(bucket_bytes=size), run(bucket_bytes=size, seed=8)
        key = lambda x: (x.doc_id is None, x.doc_id or 0, x.text or "", x["size"])
        assert Counter((r.doc_id, r.text, r.size_in) for r in got) == Counter((r.doc_id, r.text, r["size"]) for r in docs.collect())
        counts = Counter(r.shard for r in got)
        assert len(counts) == 8 and max(counts.values()) - min(counts.values()) <= 1
        for s, n in counts.items():
            assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
        assert all(r["size"] == len((r.text or "").encode()) + 1 for r in got)
        order = lambda rows: [key(r) for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
        assert order(got) == order(again) != order(other)
        assert order(got) != sorted(order(got))
