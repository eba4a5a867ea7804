"""Substring dedup over a log-structured index of fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from declgraph.llm.common import cut, delete, discard, hashed_words, new_path, pick, rolled, table

WINDOW = 20
GRAM = 8
BATCHES = 3  # of one full load: the third finds FAN_IN runs, which are compacted before it
FAN_IN = 2  # runs that the index keeps before it compacts them
BUCKETS = 64


def anchors(h: np.ndarray, window: int, gram: int) -> np.ndarray:
    """For each window its fingerprint: the smallest hash of a run of `gram` words within it. Equal windows have equal
    ones, and neighbouring windows mostly share theirs, so an index of them is a fraction of one of all windows."""
    g = rolled(h, gram)
    left = window - gram + 1  # runs in a window; the smallest of them by doubling
    if len(g) < left:
        return g[:0]
    done = 1
    while done < left:
        step = min(done, left - done)
        g = np.minimum(g[: len(g) - step], g[step:])
        done += step
    return g


def _documents(texts: pa.Array, window: int, gram: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text its number of words, and of each window the two halves of a hash and the fingerprint. The halves come
    from independent halves of the words' own 128-bit hashes, so they are equal for equal sequences of words only."""
    for lo, hi, offsets, h, k in hashed_words(texts):
        every = rolled(h, window), rolled(k, window), anchors(h, window, gram)
        for i in range(hi - lo):
            a, n = offsets[i], offsets[i + 1] - offsets[i]
            yield int(n), *(x[a : a + max(0, n - window + 1)] for x in every)


def _first_local(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each window (a, b) the first start of its word sequence in the document."""
    s = np.sort(a)
    if not (s[1:] == s[:-1]).any():
        return np.arange(len(a))
    order = np.lexsort((b, a))  # stable: equal windows stay in order of start
    x, y = a[order], b[order]
    new = np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])]
    first = np.empty(len(a), np.int64)
    first[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    return first


def _outcome(words: list[bytes], removed_starts: np.ndarray, window: int) -> tuple[int, str]:
    """Words that the windows cover, and the sha256 of the others joined by one space."""
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, removed_starts, 1)
    np.add.at(edge, removed_starts + window, -1)
    kept = np.cumsum(edge[:-1]) == 0
    n = len(words) - int(kept.sum())
    return n, hashlib.sha256(b" ".join(compress(words, kept.tolist()) if n else words)).hexdigest()


def _marks(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                out: list[tuple] = []
                for text, (n, wa, wb, marks) in zip(part["text"], _documents(part["text"], window, gram), strict=True):
                    first = _first_local(wa, wb)
                    words = (text.as_py() or "").encode().split()
                    removed, sha = _outcome(words, np.flatnonzero(first != np.arange(len(first))), window)
                    a, b = np.frombuffer(xxhash.xxh3_128_digest(b" ".join(words)), "<i8")
                    marks = np.unique(marks[np.r_[True, marks[1:] != marks[:-1]]]) if len(marks) else marks
                    out.append((n, removed, sha, int(a), int(b), marks.view(np.int64)))
                n, removed, sha, a, b, marks = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([part["uid"], part["doc_id"], pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(marks, pa.list_(pa.int64()))], names=["uid", "doc_id", "n_words", "removed", "sha", "wa", "wb", "anchors"])

    return run


def _governed(window: int, gram: int):
    """Windows whose fingerprint is shared, each at its first start in the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (_, wa, wb, marks) in enumerate(_documents(batch["text"], window, gram)):
                shared = np.sort(batch["shared"][i].values.to_numpy().view(np.uint64))
                hit = shared[np.minimum(np.searchsorted(shared, marks), len(shared) - 1)] == marks if len(shared) else np.zeros(len(marks), bool)
                at = np.flatnonzero(hit & (_first_local(wa, wb) == np.arange(len(wa))))
                if len(at):
                    n = len(at)
                    yield pa.RecordBatch.from_arrays([pa.array(wa[at].view(np.int64)), pa.array(wb[at].view(np.int64)), pa.repeat(batch["place"][i], n), pa.array(at.astype(np.int32))], names=["a", "b", "place", "start"])

    return run


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (a, b, place) -> those that are not the first of their window. The first rows of the windows of
    the partition's first and last `a` are marked `edge`: the window may have rows in a neighbouring partition."""
    prev, first_a, tail = None, None, []

    def rows(a, b, place, start, edge):
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(place), pa.array(start), pa.array(edge)], names=["a", "b", "place", "start", "edge"])

    for batch in batches:
        if not batch.num_rows:
            continue
        a, b, place, start = (batch[c].to_numpy() for c in ("a", "b", "place", "start"))
        new = np.r_[prev != (a[0], b[0]), (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        if first_a is None:
            first_a = a[0]
        at_first = new & (a == first_a)
        out = ~new | at_first
        if out.any():
            yield rows(a[out], b[out], place[out], start[out], at_first[out])
        heads = [x for x in zip(a[new & (a == a[-1])], b[new & (a == a[-1])], place[new & (a == a[-1])], start[new & (a == a[-1])], strict=True)]
        tail = (tail if tail and tail[0][0] == a[-1] else []) + heads
        prev = (a[-1], b[-1])
    if tail and tail[0][0] != first_a:
        a, b, place, start = (np.asarray(c) for c in zip(*tail, strict=True))
        yield rows(a.astype(np.int64), b.astype(np.int64), place.astype(np.int64), start.astype(np.int32), np.ones(len(a), bool))


def _finish(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, starts, (_, wa, wb, _) in zip(batch["text"], batch["starts"], _documents(batch["text"], window, window), strict=True):
                words = (text.as_py() or "").encode().split()
                first = _first_local(wa, wb)
                gone = np.zeros(len(first), bool)
                gone[starts.values.to_numpy()] = True
                out.append(_outcome(words, np.flatnonzero(gone[first] | (first != np.arange(len(first)))), window))
            removed, sha = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([batch["place"], pa.array(removed, pa.int64()), pa.array(sha, pa.string())], names=["place", "gone", "gone_sha"])

    return run


class FingerprintIndex:
    """Sorted immutable runs of the window fingerprints of all documents seen so far.

    add(docs) takes the next batch, whose documents all count as later than those before. It writes the batch's run,
    merge-joins it with the older runs and itself on the fingerprint (runs share buckets and order, so nothing is
    exchanged), and verifies what is shared against the texts of both sides: the windows concerned, by a 128-bit hash
    of their whole sequences of `window` words. FAN_IN runs and more are compacted to one first.

    Texts with equal word sequences are one class, kept in the index as its first document: the others have their
    windows earlier there as a whole, and no large group of copies meets in any join.
    """

    def __init__(self, spark: SparkSession, window: int = WINDOW, gram: int = GRAM, buckets: int = BUCKETS, fan_in: int = FAN_IN):
        self.spark, self.window, self.gram, self.buckets, self.fan_in = spark, window, gram, buckets, fan_in
        self.runs: list[DataFrame] = []
        self.tables: list[str] = []
        self.marks: DataFrame | None = None
        self.texts: DataFrame | None = None

    def _run(self, rows: DataFrame) -> DataFrame:
        """Writes fingerprint, class as a bucketed, sorted table."""
        path = new_path(self.spark, "run")
        name = "declgraph_" + path.rsplit("/", 1)[1].replace("-", "_")
        placed = rows.distinct().repartitionById(self.buckets, F.expr(f"pmod(hash(fp), {self.buckets})"))
        placed.write.bucketBy(self.buckets, "fp").sortBy("fp").option("path", path).option("compression", "zstd").saveAsTable(name)
        self.tables.append(name)
        return self.spark.table(name)

    def compact(self) -> None:
        """Merges all runs into one."""
        if len(self.runs) > 1:
            whole = self.runs[0]
            for r in self.runs[1:]:
                whole = whole.unionByName(r)
            old, self.tables = self.tables, []
            self.runs = [self._run(whole)]
            for name in old:
                self._delete(name)

    def _delete(self, name: str) -> None:
        path = self.spark.sql(f"describe formatted {name}").where("col_name = 'Location'").first()["data_type"]
        self.spark.sql(f"drop table {name}")
        delete(self.spark, path)

    def close(self) -> None:
        for name in self.tables:
            self._delete(name)
        self.tables, self.runs = [], []

    def add(self, docs: DataFrame) -> DataFrame:
        """docs(place, uid, doc_id, text): place is the order of documents, above that of all before -> place, uid,
        doc_id, n_words, n_removed, kept_sha256."""
        if len(self.runs) >= self.fan_in:
            self.compact()
        window, gram = self.window, self.gram
        marks = docs.select("place", "doc_id", "text").withColumnRenamed("place", "uid").mapInArrow(_marks(window, gram), "uid long, doc_id long, n_words long, removed long, sha string, wa long, wb long, anchors array<long>")
        marks = cut(marks.withColumnRenamed("uid", "place"), "marks")
        run = self._run(marks.select(F.explode("anchors").alias("fp"), F.col("wa").alias("class")))
        slim = marks.drop("anchors")
        self.marks = slim if self.marks is None else self.marks.unionByName(slim)
        self.texts = docs if self.texts is None else self.texts.unionByName(docs)
        classes = cut(self.marks.groupBy("wa", "wb").agg(F.min("place").alias("place")), "classes")

        ends = lambda r, s: r.groupBy("fp").agg(F.min("class").alias(f"lo{s}"), F.max("class").alias(f"hi{s}"))
        met, test = ends(run, ""), "lo <> hi"
        for i, old in enumerate(self.runs):
            met = met.join(ends(old, i), "fp", "left")
            test += f" or (lo{i} is not null and (lo{i} <> lo or hi{i} <> hi))"
        shared = met.where(test).select("fp")
        hits = run.join(shared, "fp", "left_semi")
        for old in self.runs:
            hits = hits.unionByName(old.join(shared, "fp", "left_semi"))
        self.runs.append(run)
        by_class = cut(hits.distinct().groupBy("class").agg(F.collect_list("fp").alias("shared")), "hits")
        concerned = cut(classes.join(by_class, F.col("wa") == F.col("class")).select("place", "shared"), "concerned")
        texts = cut(self.texts.select("place", "text").join(concerned, "place"), "texts")

        # Written first: the range exchange reads its input twice, and would hash the texts twice.
        windows = cut(texts.mapInArrow(_governed(window, gram), "a long, b long, place long, start int"), "windows")
        ordered = windows.repartitionByRange("a", "place").sortWithinPartitions("a", "b", "place")
        later = cut(ordered.mapInArrow(_later, "a long, b long, place long, start int, edge boolean"), "later")
        edge = later.where("edge")  # a few rows for each partition of the exchange
        least = edge.groupBy("a", "b").agg(F.min("place").alias("least"))
        rest = edge.join(F.broadcast(least), ["a", "b"]).where("place > least").select("place", "start")
        here = slim.agg(F.min("place").alias("m")).first()["m"]
        gone = later.where("not edge").select("place", "start").unionByName(rest).where(F.col("place") >= (here or 0))
        starts = cut(gone.groupBy("place").agg(F.collect_list("start").alias("starts")), "starts")
        discard(windows, later, by_class, concerned)
        done = cut(texts.select("place", "text").join(starts, "place").mapInArrow(_finish(window), "place long, gone long, gone_sha string"), "done")
        whole = classes.select(F.col("wa").alias("ca"), F.col("wb").alias("cb"), F.col("place").alias("first"))
        out = slim.join(whole, (F.col("wa") == F.col("ca")) & (F.col("wb") == F.col("cb"))).join(done, "place", "left")
        copy = (F.col("place") > F.col("first")) & (F.col("n_words") >= window)
        return out.select(
            "place", "doc_id", "n_words",
            F.when(copy, F.col("n_words")).otherwise(F.coalesce("gone", "removed")).alias("n_removed"),
            F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("gone_sha", "sha")).alias("kept_sha256"),
        )


def in_order(docs: DataFrame) -> DataFrame:
    """place, doc_id, text: place follows doc_id, then the row's own place in the table; null ids come last.

    Ids that are distinct and not null (the usual case) are their own places; otherwise places are counted, by ranges
    of ids first and within them after.
    """
    rows = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("uid", F.monotonically_increasing_id())
    ids = rows.select("doc_id", "uid")
    many = ids.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count()
    if not many:
        return rows.select(F.col("doc_id").alias("place"), "doc_id", "text")
    from pyspark.sql import Window

    sorted_ = cut(ids.repartitionByRange(F.col("doc_id").asc_nulls_last(), "uid").withColumn("p", F.spark_partition_id()), "ids")
    sizes = sorted_.groupBy("p").count()
    before = F.broadcast(sizes.select("p", F.coalesce(F.sum("count").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")))
    rank = F.row_number().over(Window.partitionBy("p").orderBy(F.col("doc_id").asc_nulls_last(), "uid"))
    places = cut(sorted_.withColumn("rank", rank).join(before, "p").select("uid", (F.col("before") + F.col("rank")).cast("long").alias("place")), "places")
    return cut(rows.join(places, "uid").select("place", "doc_id", "text"), "placed")


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES, fan_in: int = FAN_IN, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of docs(doc_id, text).

    A word goes if a window of `window` words over it has a word sequence that also starts earlier: in a smaller
    doc_id (then an earlier row; null ids last) or earlier in the document. The rows go through a FingerprintIndex in
    `batches` ranges of place; the number changes no result. Null texts have no words; fewer words than a window are
    all kept; other columns are not looked at; no rows give none. `gram` must not exceed `window`.
    """
    spark = docs.sparkSession
    placed = in_order(docs)
    index = FingerprintIndex(spark, window, gram, buckets, fan_in)
    shares = [i / batches for i in range(1, batches)]
    bounds = sorted(set(placed.agg(F.percentile_approx("place", shares, 1000)).first()[0] or [])) if shares else []
    out = None
    for low, high in zip([None, *bounds], [*bounds, None], strict=True):
        batch = placed
        if low is not None:
            batch = batch.where(F.col("place") > low)
        if high is not None:
            batch = batch.where(F.col("place") <= high)
        found = cut(index.add(batch), "deduped")
        out = found if out is None else out.unionByName(found)
    index.close()
    return out.drop("place")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))
