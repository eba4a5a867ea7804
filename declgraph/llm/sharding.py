"""Sharding by a two-pass external shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from declgraph.llm.common import Stored, guard, new_path, table

SEED = 7
BUCKET_BYTES = 16 << 20
MOST_BUCKETS = 50_000  # beyond, buckets grow: 2 GB of text each at 100 TB


def _fisher_yates(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        bucket = rows["__bucket"][0].as_py()
        # Rows come from the exchange in any order; sorted first, a rerun gives the same order.
        start = pc.sort_indices(rows.select(["__id", "__tie"]), sort_keys=[("__id", "ascending"), ("__tie", "ascending")]).to_numpy()
        order = start[np.random.Generator(np.random.PCG64([seed, bucket])).permutation(len(start))]
        place = rows["__before"][0].as_py() + np.arange(len(order))
        out = rows.drop_columns(["__bucket", "__before", "__tie", "__id"])
        for at in range(0, len(order), 512):
            part = out.take(pa.array(order[at : at + 512])).append_column("__place", pa.array(place[at : at + 512], pa.int64()))
            yield from part.combine_chunks().to_batches()

    return run


def shuffle_to_shards(docs: DataFrame, path: str, shards: int = 8, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> None:
    """Writes all rows of docs(doc_id, text, ...) in a seeded random order to `path`/shard=0.. as Parquet, with their slots.

    Pass one scatters rows by a seeded hash of doc_id and the row's own name (its file and place) into buckets of about
    `bucket_bytes` of text, so that repeated ids and texts spread like any rows; pass two shuffles each
    bucket in memory (Fisher-Yates) and writes it at the bucket's place in the whole order, known from counts alone. Shards
    are equal runs of that order: their counts differ by one at most. All columns are written; input columns named shard,
    size or slot get `_in` appended. Null texts have size 1, null ids are scattered like others. A rerun over the same files gives the same order.
    An empty table writes no rows.
    """
    stored = Stored(docs)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    key = stored.pick("doc_id", "text").select("uid", F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"))
    total = key.agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).first()
    n, buckets = total["n"], min(MOST_BUCKETS, max(1, -(-(total["bytes"] or 0) // bucket_bytes)))
    bucket = lambda uid, doc: F.pmod(F.xxhash64(F.lit(seed), doc, uid), F.lit(buckets)).cast("long")
    counts = key.groupBy(bucket(F.col("uid"), F.col("doc_id")).alias("__b")).count()
    until = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each bucket, MOST_BUCKETS at most: the bound of the broadcast and of the window's one task.
    before = F.broadcast(counts.select("__b", F.coalesce(F.sum("count").over(until), F.lit(0).cast("long")).alias("__before")))
    rows = stored.rows()
    place = {c: F.col(f"__c{i}") for i, c in enumerate(stored.columns)}
    named = guard(stored.df, "shard", "slot", "size").columns
    text, doc = place["text"], place["doc_id"].cast("long")
    scattered = rows.select(*(F.col(f"__c{i}") for i in range(len(named))), F.col("__uid").alias("__tie"), (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("__size"), doc.alias("__id"), bucket(F.col("__uid"), doc).alias("__bucket"))
    scattered = scattered.join(before, F.col("__bucket") == F.col("__b")).drop("__b").repartitionById(buckets, F.col("__bucket").cast("int"))
    schema = StructType([f for f in scattered.schema.fields if f.name not in ("__bucket", "__before", "__tie", "__id")] + [StructField("__place", LongType())])
    shuffled = scattered.mapInArrow(_fisher_yates(seed), schema)
    shard = F.expr(f"cast(__place * {shards} div {max(1, n)} as int)")
    slot = F.expr(f"__place - ((__place * {shards} div {max(1, n)}) * {n} + {shards - 1}) div {shards}")
    out = shuffled.select(*(F.col(f"__c{i}") for i in range(len(named))), "__size", slot.alias("__slot"), shard.alias("__shard"))
    out.toDF(*named, "size", "slot", "shard").write.partitionBy("shard").parquet(path)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "shards")
    docs = table(spark, sf_dir, "documents")
    shuffle_to_shards(docs, path)
    schema = StructType([*guard(docs, "shard", "slot", "size").schema.fields, StructField("size", LongType()), StructField("slot", LongType()), StructField("shard", IntegerType())])
    stored = spark.read.schema(schema).parquet(path)
    return stored.select("doc_id", "size", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
