"""What the operators share: column picking, written tables in the shared folder, names of rows, words, per-worker caches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words in every contract of this package; exactly what ``bytes.split()`` splits on.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the context's. A local session without
    either (tests) gets one of its own; on a cluster there is no folder to fall back to."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="declgraph-"))
        path = spark.sparkContext.getCheckpointDir()
    return f"{path.rstrip('/')}/declgraph/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:10]}"


BATCH_ROWS = 1000  # rows that a Python worker gets, and that a scan holds, at once: texts are long
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_SCAN = "spark.sql.parquet.columnarReaderBatchSize"


def cut(df: DataFrame, name: str, codec: str = "zstd", batch_rows: int = BATCH_ROWS) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends here, and lost executors cost nothing before it."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    was, scan = spark.conf.get(_BATCH), spark.conf.get(_SCAN)
    try:
        spark.conf.set(_BATCH, str(min(batch_rows, int(was) if int(was) > 0 else batch_rows)))
        spark.conf.set(_SCAN, str(min(BATCH_ROWS, int(scan))))
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(_BATCH, was)
        spark.conf.set(_SCAN, scan)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*written: DataFrame) -> None:
    """Deletes tables of cut() that nothing reads any more."""
    for df in written:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/declgraph/" in path:
                delete(df.sparkSession, path)


def drop_work(spark: SparkSession) -> None:
    """Deletes every table this application wrote with cut(); results that read them must have been stored before."""
    delete(spark, shared_dir(spark))


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Exactly these columns, by position: other columns may have any name, even one that differs in case only."""
    at = [df.columns.index(n) for n in names]
    plain = df.toDF(*(f"__c{i}" for i in range(len(df.columns))))
    return plain.select(*(F.col(f"__c{i}").alias(n) for i, n in zip(at, names, strict=True)))


def guard(df: DataFrame, *reserved: str) -> DataFrame:
    """Renames columns whose names an operator needs for its own: `x` becomes `x_in` (or `x_in_in` ...)."""
    taken = {r.lower() for r in reserved}
    names: list[str] = []
    for c in df.columns:
        while c.lower() in taken:
            c += "_in"
        taken.add(c.lower())
        names.append(c)
    return df.toDF(*names)


def fresh(columns: list[str], name: str) -> str:
    """A column name that is not taken, in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


ROW_BITS = 36  # of a row's name: its place in its file; the bits above are the file's place among the table's
CHUNK = 4096  # rows that one mask covers
MASK_BYTES = 256 << 20  # masks that are sent to all executors at once


class Stored:
    """A table of Parquet files whose rows have names that hold in every read of it, under any settings: `uid`, from the
    file and the place in it. What is not read straight from Parquet is written first.

    Decisions on rows come back to them as bit masks by file and place, so that no row is exchanged for the sake of its
    flag. Masks are broadcast up to MASK_BYTES (a bit for each row of a chunk that has a flag, thus 2 billion rows at one
    bit); beyond, the files are read in runs, each with the masks that concern it.
    """

    def __init__(self, df: DataFrame):
        self.df = df if self._is_scan(df) else cut(df, "input")
        self.spark, self.columns = df.sparkSession, self.df.columns
        meta = self.df.metadataColumn("_metadata")
        self.raw = self.df.select("*", meta["file_path"], meta["row_index"]).toDF(*(f"__c{i}" for i in range(len(self.columns))), "__file", "__row")
        # As many rows as files, whose list the driver holds anyway.
        self.files = sorted(r[0] for r in self.raw.select("__file").distinct().collect())

    @staticmethod
    def _is_scan(df: DataFrame) -> bool:
        plan = df._jdf.queryExecution().analyzed()
        while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
            plan = plan.children().head()
        return plan.nodeName() == "LogicalRelation" and "parquet" in plan.simpleString(1).lower()

    def _rows(self, low: int, high: int) -> DataFrame:
        """The rows of files low to high, with `__uid`."""
        rows = self.raw
        if (low, high) != (0, len(self.files)):
            rows = rows.where((F.col("__file") >= self.files[low]) & (F.col("__file") <= self.files[high - 1]))
        if len(self.files) <= 1:
            return rows.withColumn("__uid", F.col("__row"))
        order = self.spark.createDataFrame([(f, i) for i, f in enumerate(self.files)], "__file string, __ord long")
        return rows.join(F.broadcast(order), "__file").withColumn("__uid", F.shiftleft("__ord", ROW_BITS) + F.col("__row"))

    def rows(self) -> DataFrame:
        """All rows: the table's columns as __c0.., and __uid."""
        return self._rows(0, len(self.files))

    def pick(self, *names: str) -> DataFrame:
        """uid and exactly these columns."""
        rows = self.rows()
        return rows.select(F.col("__uid").alias("uid"), *(F.col(f"__c{self.columns.index(n)}").alias(n) for n in names))

    def flagged(self, flags: DataFrame, bits: int = 1, most_bytes: int | None = None) -> DataFrame:
        """flags(uid, value), values below 2 ** bits, each uid once -> the table's columns as __c0.., __uid and __value (0 where there is none)."""
        per = 64 // bits
        at = F.col("uid") % CHUNK
        words = flags.select(F.expr(f"uid div {CHUNK}").alias("chunk"), F.floor(at / per).cast("int").alias("word"), F.expr(f"shiftleft(cast(value as long), cast({bits} * (uid % {CHUNK} % {per}) as int))").alias("m")).groupBy("chunk", "word").agg(F.bit_or("m").alias("m"))
        filled = F.transform(F.sequence(F.lit(0), F.lit(-(-CHUNK // per) - 1)), lambda i: F.coalesce(F.try_element_at(F.col("by_word"), i), F.lit(0).cast("long")))
        masks = cut(words.groupBy("chunk").agg(F.map_from_entries(F.collect_list(F.struct("word", "m"))).alias("by_word")).select("chunk", filled.alias("words")), "masks")
        sizes = {r["o"]: r["n"] * (8 * -(-CHUNK // per) + 64) for r in masks.groupBy(F.shiftright("chunk", ROW_BITS - 12).alias("o")).agg(F.count("*").alias("n")).collect()}  # a row a file
        runs, low, held = [], 0, 0
        for i in range(len(self.files)):
            if held and held + sizes.get(i, 0) > (MASK_BYTES if most_bytes is None else most_bytes):
                runs.append((low, i))
                low, held = i, 0
            held += sizes.get(i, 0)
        runs.append((low, len(self.files)))
        out = None
        for low, high in runs:
            here = masks.where((F.col("chunk") >= low << (ROW_BITS - 12)) & (F.col("chunk") < high << (ROW_BITS - 12))) if len(runs) > 1 else masks
            rows = self._rows(low, high)
            joined = rows.join(F.broadcast(here), F.expr(f"__uid div {CHUNK}") == F.col("chunk"), "left")
            value = F.expr(f"coalesce(shiftrightunsigned(words[cast(__uid % {CHUNK} div {per} as int)], cast({bits} * (__uid % {CHUNK} % {per}) as int)) & {(1 << bits) - 1}, 0)")
            part = joined.select(*(f"__c{i}" for i in range(len(self.columns))), "__uid", value.cast("int").alias("__value"))
            out = part if out is None else out.unionByName(part)
        return out

    def own(self, rows: DataFrame) -> DataFrame:
        """Rows of flagged() with the table's own columns only."""
        return rows.select(*(f"__c{i}" for i in range(len(self.columns)))).toDF(*self.columns)

    def without(self, uids: DataFrame) -> DataFrame:
        """The table's rows but those of uids(uid), each uid once."""
        return self.own(self.flagged(uids.select("uid", F.lit(1).alias("value"))).where("__value = 0"))

    def only(self, uids: DataFrame, *names: str) -> DataFrame:
        """uid and these columns of the rows of uids(uid), each uid once."""
        rows = self.flagged(uids.select("uid", F.lit(1).alias("value"))).where("__value = 1")
        return rows.select(F.col("__uid").alias("uid"), *(F.col(f"__c{self.columns.index(n)}").alias(n) for n in names))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def worker_cache(name: str) -> dict:
    """A dict that lives as long as this worker process; code shipped by value has no module of its own to keep it in."""
    import sys
    import types

    home = sys.modules.setdefault("_declgraph_worker_cache", types.ModuleType("_declgraph_worker_cache"))
    return home.__dict__.setdefault(name, {})


def lean(run, keep: str | None = None):
    """`run` for mapInArrow, in a worker that holds little else: the caches of other operators go before it, and what it
    allocated goes back to the system after it. Workers outlive their tasks, and an executor's memory counts them all."""

    def wrapped(batches):
        import ctypes
        import gc
        import sys

        import pyarrow as pa

        home = sys.modules.get("_declgraph_worker_cache")
        for name, held in list(vars(home).items()) if home else ():
            if isinstance(held, dict) and not name.startswith("__") and name != keep:
                held.clear()
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            gc.collect()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # no glibc: memory stays with the worker
                pass

    return wrapped


GROUP_BYTES = 8 << 20


def split_words(texts: pa.Array, lower: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, pa.Array]]:
    """Words (as bytes.split() has them) of runs of texts of some megabytes: first row, last row + 1, offsets of the rows,
    number of each word, and the distinct words that the numbers stand for. Nulls have no words; `lower` turns A-Z only."""
    texts = texts.fill_null("")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + GROUP_BYTES, "right")))
        part = texts.slice(lo, hi - lo)
        lists = pc.ascii_split_whitespace(pc.ascii_lower(part) if lower else part)
        coded = lists.flatten().dictionary_encode()
        offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
        codes, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        none = pc.index(words, pa.scalar("", words.type)).as_py()
        if none is not None and none >= 0:  # white space at either end leaves empty words
            real = codes != none
            offsets = np.concatenate([[0], np.cumsum(real)])[offsets]
            codes = codes[real]
        yield lo, hi, offsets, codes, words
        lo = hi


def hashed_words(texts: pa.Array, lower: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """split_words() with two independent 64-bit hashes of each word in place of the numbers."""
    for lo, hi, offsets, codes, words in split_words(texts, lower):
        data = words.cast(pa.binary()).to_pylist()
        both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, data)), "<u8").reshape(-1, 2) if data else np.empty((0, 2), np.uint64)
        yield lo, hi, offsets, both[codes, 0], both[codes, 1]


_ODD = np.uint64(0x9E3779B97F4A7C15)


def rolled(h: np.ndarray, width: int) -> np.ndarray:
    """A mixed polynomial hash of each run of `width` words' hashes."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = h[:n].copy()
    for i in range(1, width):
        out *= _ODD
        out += h[i : i + n]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return out


def smallest(rows: DataFrame, n: int) -> list:
    """At most n rows of rows(h, ...) with the smallest h: found on h alone, so that little else reaches the driver."""
    last = rows.select("h").orderBy("h").limit(n).agg({"h": "max"}).first()[0]
    return [] if last is None else rows.where(rows["h"] <= last).orderBy(*rows.columns).limit(n).collect()
