"""A log of changes to files, folded into the state of all files, batch or stream.

A change is (file, source, version, op, text): source 'disk' or 'overlay', op 'upsert' or 'delete'. The text of a file is
that of its overlay while there is one, else what the disk has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from declgraph.operators.kernels import latest_per_key

SCHEMA = "file string, source string, version long, op string, text string"


def fold(changes: DataFrame) -> DataFrame:
    """The last change of each file and source; deletions stay as tombstones, so that folding again is safe."""
    return latest_per_key(changes.select("file", "source", "version", "op", "text"), ["file", "source"], ["version", "op", "text"])


def effective(state: DataFrame) -> DataFrame:
    """file, version, text as a query sees them: overlays over disk, deleted files gone."""
    alive = state.where("op = 'upsert'").withColumn("rank", F.expr("if(source = 'overlay', 1, 0)"))
    return latest_per_key(alive.select("file", "rank", "version", "text"), ["file"], ["rank", "version"]).select("file", "version", "text")


def upsert_stream(spark: SparkSession, log: str, state: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Folds new files of the log into `state`/v=N, a complete version for each micro-batch N; a batch that is run again after a failure
    writes its version again from the one before it, so nothing is counted twice. The default trigger takes all there is and ends;
    processingTime='150 milliseconds' makes bursts one change."""

    def step(batch: DataFrame, n: int) -> None:
        before = read_state(batch.sparkSession, state, below=n)
        rows = batch if before is None else before.unionByName(batch)
        fold(rows).write.mode("overwrite").parquet(f"{state}/v={n}")

    feed = spark.readStream.schema(SCHEMA).parquet(log)
    return feed.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def versions(spark: SparkSession, state: str) -> list[int]:
    """Versions that were written completely."""
    path = spark._jvm.org.apache.hadoop.fs.Path(state)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    done = [f.getPath() for f in fs.listStatus(path) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    return sorted(int(p.getName()[2:]) for p in done if p.getName().startswith("v="))


def read_state(spark: SparkSession, state: str, below: int | None = None) -> DataFrame | None:
    """The newest version, below one if given; a reader keeps the version that it began with."""
    found = [v for v in versions(spark, state) if below is None or v < below]
    return spark.read.schema(SCHEMA).parquet(f"{state}/v={found[-1]}") if found else None


def changed_packages(old: DataFrame, new: DataFrame) -> DataFrame:
    """dir of every file that appeared, went, or has another text: only these packages are parsed again."""
    side = lambda d: d.select("file", F.xxhash64("text").alias("h"))
    a, b = side(old).withColumnRenamed("h", "a"), side(new).withColumnRenamed("h", "b")
    return a.join(b, "file", "full_outer").where("not (a <=> b)").select(F.regexp_replace("file", "/[^/]*$", "").alias("dir")).distinct()


def parse_with_cache(files: DataFrame, cached: DataFrame | None, parse) -> DataFrame:
    """files(file, stamp, ...) -> parse() of those that the cache has not at this stamp, with the cached rows of the others. Rows
    have file and stamp; one parse for each (file, stamp), however often it is listed."""
    files = files.dropDuplicates(["file", "stamp"])
    if cached is None:
        return parse(files)
    hit = cached.join(files.select("file", "stamp"), ["file", "stamp"], "left_semi")
    missing = files.join(cached.select("file", "stamp").distinct(), ["file", "stamp"], "left_anti")
    return hit.unionByName(parse(missing))
