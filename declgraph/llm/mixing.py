"""Mixing sources to target weights by systematic sampling; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from declgraph.llm.common import WORD, Stored, cut, table

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
SEED = 20240229
SLICE_ROWS = 500


def targets(totals: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """totals(source, source_size) -> source, source_size, target: the size of all, shared by weight under the caps.

    Capping and resharing until none is above ends where each source has min(cap, level * weight) and these add up to
    the whole. Sources sorted by cap/weight reach their caps in this order, so running sums give the level at once.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighted = totals.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * float(most))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest)
    # The sources before the first whose cap is above the level are the capped ones; that source's level holds for all.
    levelled = weighted.withColumn("level", level).withColumn("open", F.col("level") * F.col("w") <= F.col("cap"))
    at = F.min(F.when(F.col("open"), F.struct((F.col("cap") / F.col("w")).alias("r"), F.col("level").alias("level")))).over(whole)
    return levelled.withColumn("at", at).select("source", "source_size", F.least("cap", F.coalesce(F.col("at.level") * F.col("w"), F.col("cap"))).alias("target"))


def sizes(docs: DataFrame | Stored, seed: int = SEED) -> DataFrame:
    """uid, doc_id, source, size and h, a hash of what a row holds: the same wherever the row is stored."""
    rows = (docs if isinstance(docs, Stored) else Stored(docs)).pick("doc_id", "source", "text").select("uid", F.col("doc_id").cast("long"), F.col("source").cast("string"), "text")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
    return cut(rows.select("uid", "doc_id", "source", size.alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("h")), "sizes")


def mix(docs: DataFrame | Stored, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, seed: int = SEED, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """One row for each row of docs(doc_id, source, text): uid, doc_id, size, source_size, target, copies, taken.

    Within a source each document expects target / source_size copies. Documents stand in an order by size class, so
    every class is sampled evenly and the words taken come near the target; the running sum of expected copies plus one
    seeded offset of the source gives a copy at each integer it crosses. The order is cut into slices (source, size
    class, hash), numbered within and added up across, so no task sorts a whole source however large it is.
    Null texts have size 0; the null source comes last; a source of size 0 has target 0 and is not taken. The order is by
    what rows hold, so that reruns agree however the table is stored; only rows equal in id, source and text are told
    apart by their place, and their results as a whole do not depend on it. An empty table gives no rows.
    """
    sized = sizes(docs, seed).withColumn("class", F.floor(F.log2(F.col("size") + 1.0) * 8).cast("int"))
    # A crowded size class has as many slices as its rows ask for.
    many = cut(sized.groupBy("source", "class").agg(F.ceil(F.count("*") / F.lit(slice_rows)).alias("slices")), "classes").toDF("ms", "mc", "slices")
    placed = sized.join(many, F.col("source").eqNullSafe(F.col("ms")) & (F.col("class") == F.col("mc"))).drop("ms", "mc")
    placed = placed.withColumn("slice", F.floor(F.shiftrightunsigned("h", 32) * F.col("slices") / F.lit(4294967296.0)).cast("long")).drop("slices")
    # One row for each slice and source: far fewer than documents; joined on null-safe keys.
    counts = placed.groupBy("source", "class", "slice").agg(F.count("*").alias("rows"), F.sum("size").alias("words"))
    totals = cut(targets(cut(counts.groupBy("source").agg(F.sum("words").alias("source_size")), "totals"), weights, most), "targets")
    until = Window.partitionBy("source").orderBy("class", "slice").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("source", "class", "slice", F.coalesce(F.sum("rows").over(until), F.lit(0).cast("long")).alias("before"))
    wide = cut(before.join(totals.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s"), "slices")
    wide = wide.select(F.col("source").alias("s"), F.col("class").alias("c"), F.col("slice").alias("l"), "before", "source_size", "target")
    rank = F.row_number().over(Window.partitionBy("source", "class", "slice").orderBy("h", F.col("doc_id").asc_nulls_last(), "uid"))
    ranked = placed.withColumn("rank", rank)
    joined = ranked.join(wide, F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("c")) & (F.col("slice") == F.col("l")))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = F.pmod(F.xxhash64(F.lit(seed), F.lit("offset"), "source"), F.lit(1 << 20)) / float(1 << 20)
    upto = lambda i: F.floor(each * i + offset)
    place = F.col("before") + F.col("rank")
    copies = F.least(F.lit(most).cast("long"), upto(place) - upto(place - 1))
    return joined.select("uid", "doc_id", "size", "source_size", "target", copies.alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def emit(docs: DataFrame, most: int = MOST, **options) -> DataFrame:
    """The mixed table: every row of docs as often as mix() says, with its own columns, whatever their names. Rows stay where
    they are stored and get their copies there; null texts, being of size 0, are taken like others; no rows give none."""
    stored = Stored(docs)
    copies = mix(stored, most=most, **options).where("copies > 0").select("uid", F.col("copies").alias("value"))
    rows = stored.flagged(copies, bits=most.bit_length()).where("__value > 0")
    return stored.own(rows.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col("__value")))))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
