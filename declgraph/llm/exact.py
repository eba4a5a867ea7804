"""Exact dedup by deterministic block naming."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from declgraph.llm.common import Stored, cut, lean, table

BLOCK_BYTES = 16384
_PART = 1 << 40  # names of one sorted partition


def normalise(data: bytes) -> bytes:
    """Each run of white space becomes one space, also at either end."""
    core = b" ".join(data.split())
    if not core:
        return b" " if data else b""
    return b" " * data[:1].isspace() + core + b" " * data[-1:].isspace()


def _to_blocks(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids, ids, rows, held = batch["uid"].to_pylist(), batch["doc_id"].to_pylist(), [], 0
            for uid, doc, text in zip(uids, ids, batch["text"], strict=True):
                data = normalise((text.as_py() or "").encode())
                sha, n = hashlib.sha256(data).digest(), max(1, -(-len(data) // size))
                for ix in range(n):
                    block = data[ix * size : (ix + 1) * size]
                    rows.append((uid, doc, ix, n, sha if ix == 0 else None, block))
                    held += len(block)
                    if held > 8 << 20:
                        yield _block_batch(rows)
                        rows, held = [], 0
            if rows:
                yield _block_batch(rows)

    return run


def _block_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["uid", "doc_id", "ix", "n", "sha", "key"])


def _rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (h, key) -> each with its key's integer name; at the end the keys of the first and the last h."""
    base = TaskContext.get().partitionId() * _PART
    count, prev, first, last = 0, None, {}, {}
    first_h = last_h = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        h, key = batch["h"], batch["key"]
        new = np.ones(n, bool)
        if n > 1:
            new[1:] = ~pc.and_(pc.equal(h[1:], h[:-1]), pc.equal(key[1:], key[:-1])).to_numpy(zero_copy_only=False)
        new[0] = prev != (h[0].as_py(), key[0].as_py())
        ranks = count + np.cumsum(new)
        hs = h.to_numpy()
        if first_h is None:
            first_h = hs[0]
        for i in np.flatnonzero(new & ((hs == first_h) | (hs == hs[-1]))):
            name, k = int(base + ranks[i]), key[int(i)].as_py()
            if hs[i] == first_h:
                first[name] = (int(hs[i]), k)
            if hs[i] == hs[-1]:
                if last_h != hs[-1]:
                    last, last_h = {}, hs[-1]
                last[name] = (int(hs[i]), k)
        count, prev = int(ranks[-1]), (h[n - 1].as_py(), key[n - 1].as_py())
        none = pa.nulls(n, pa.int64())
        yield pa.RecordBatch.from_arrays([batch["uid"], batch["doc_id"], batch["ix"], batch["n"], batch["sha"], pa.array(base + ranks), none, pa.nulls(n, pa.binary())], names=_NAMED)
    edge = first | last
    if edge:
        e = len(edge)
        none = pa.nulls(e, pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(e, pa.binary()), pa.array(list(edge), pa.int64()), pa.array([v[0] for v in edge.values()], pa.int64()), pa.array([v[1] for v in edge.values()], pa.binary())], names=_NAMED)


_NAMED = ["uid", "doc_id", "ix", "n", "sha", "name", "edge_h", "edge_key"]


def _name(keyed: DataFrame, what: str) -> DataFrame:
    """(uid, doc_id, ix, n, sha, key) -> the same with the integer `name` of the key in place of it.

    One range exchange on (hash, uid), sorted by (hash, key): equal keys lie next to each other and get one number, and a
    key with very many rows spreads over several partitions. Only there can one key have two numbers, so each partition
    also reports the keys of its first and last hash; the smallest number of a key holds. Keys are compared in full.
    """
    ranged = keyed.withColumn("h", F.xxhash64("key")).repartitionByRange("h", "uid").sortWithinPartitions("h", "key", "uid")
    named = cut(ranged.mapInArrow(lean(_rank), "uid long, doc_id long, ix long, n long, sha binary, name long, edge_h long, edge_key binary"), what)
    edge = named.where("edge_h is not null").select("edge_h", "edge_key", "name")
    least = edge.groupBy("edge_h", "edge_key").agg(F.min("name").alias("least"))
    # A few rows for each partition of the exchange, whatever the input: the bound that allows the broadcast.
    other = F.broadcast(edge.join(least, ["edge_h", "edge_key"]).where("name <> least").select("name", "least"))
    rows = named.where("edge_h is null").select("uid", "doc_id", "ix", "n", "sha", "name")
    return rows.join(other, "name", "left").select("uid", "doc_id", "ix", "n", "sha", F.coalesce("least", "name").alias("name"))


def identities(docs: DataFrame | Stored, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """uid, doc_id, sha, n, name: rows of docs have equal (n, name) if and only if their normalised texts are equal."""
    stored = docs if isinstance(docs, Stored) else Stored(docs)
    rows = stored.pick("doc_id", "text").select("uid", F.col("doc_id").cast("long"), "text")
    blocks = rows.mapInArrow(lean(_to_blocks(block_bytes)), "uid long, doc_id long, ix long, n long, sha binary, key binary")
    level = _name(blocks, "names")
    done, left, width = [], level, 1
    longest = level.agg(F.max("n")).first()[0] or 1
    while width < longest:
        done.append(left.where(F.col("n") <= width))
        pairs = left.where(F.col("n") > width).groupBy("uid", F.expr("ix div 2").alias("ix")).agg(
            F.max("doc_id").alias("doc_id"), F.max("n").alias("n"), F.max("sha").alias("sha"),
            F.encode(F.concat_ws(",", F.max(F.expr("if(ix % 2 = 0, name, null)")), F.max(F.expr("if(ix % 2 = 1, name, null)"))), "utf-8").alias("key"),
        )
        left, width = _name(pairs.select("uid", "doc_id", "ix", "n", "sha", "key"), "pair-names"), width * 2
    for part in done:
        left = left.unionByName(part)
    return left.select("uid", "doc_id", "sha", "n", "name")


def exact_dedup(docs: DataFrame | Stored, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of docs(doc_id, text): uid, doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty, and empty texts as equal. Of equal texts the smallest doc_id stays, a null id only where
    there is no other; of rows that also share the id one stays. keep_id is null where only null ids have the text.
    Other columns are not looked at; an empty table gives an empty result.
    """
    ids = identities(docs, block_bytes)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "uid"))
    groups = cut(ids.groupBy("n", "name").agg(best.alias("best"), F.count("*").alias("group_size")).where("group_size > 1"), "groups")
    joined = ids.join(groups, ["n", "name"], "left")
    return joined.select(
        "uid", "doc_id",
        F.expr("if(best is null, doc_id, best.doc_id)").alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.expr("best is null or best.uid = uid").alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns, whatever their names. Kept texts are not exchanged."""
    stored = Stored(docs)
    return stored.without(exact_dedup(stored).where("not kept").select("uid"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("uid")


OP10_SQL = r"""
with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as n from documents),
g as (select n, min(doc_id) as keep_id, count(*) as group_size from t group by n)
select t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id as kept, sha256(t.n) as text_sha256 from t join g on t.n = g.n
"""
