"""Approximate nearest neighbours with an inverted multi-index."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from declgraph.llm.common import cut, pick, table

CENTROIDS = 64  # of each half: 4,096 cells
SAMPLE_ROWS = 8192  # rows that the centroids are fitted on
PROBE = 0.5  # share of all rows that a query's cells hold at least
QUERY_BLOCK = 2048  # queries sent to all tasks at once: 1 MB of vectors and 8 MB of cells
SEED = 11


def fit(sample: np.ndarray, k: int = CENTROIDS, rounds: int = 12, seed: int = SEED) -> list[np.ndarray]:
    """Centroids of the two halves of the sample's vectors, by Lloyd's method."""
    rng, halves = np.random.default_rng(seed), []
    for half in _halves(sample):
        distinct = np.unique(half, axis=0)
        centres = distinct[rng.permutation(len(distinct))[:k]]
        for _ in range(rounds):
            at = _nearest(half, centres)
            sums = np.zeros_like(centres)
            np.add.at(sums, at, half)
            n = np.bincount(at, minlength=len(centres))
            centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        halves.append(centres)
    return halves


def _halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = x.shape[1] // 2
    return x[:, :h], x[:, h:]


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None]


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([_squares(x[i : i + 4096], c).argmin(1) for i in range(0, len(x), 4096)]) if len(x) else np.empty(0, int)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def traverse(first: np.ndarray, second: np.ndarray, counts: np.ndarray, wanted: int) -> list[int]:
    """Cells in order of summed distance (multi-sequence algorithm) until they hold `wanted` rows.

    first, second: distances of a query's halves to the centroids. A heap holds the frontier of pairs of ranks.
    """
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    m, found, have = len(b), [], 0
    heap, seen = [(float(first[a[0]] + second[b[0]]), 0, 0)], {(0, 0)}
    while heap and have < wanted:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]) * m + int(b[j])
        if counts[cell]:
            found.append(cell)
            have += int(counts[cell])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < m and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (float(first[a[x]] + second[b[y]]), x, y))
    return found


def _assign(centres: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (_nearest(h, c) for h, c in zip(_halves(_matrix(batch["embedding"])), centres, strict=True))
                yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["embedding"], pa.array((a * len(centres[1]) + b).astype(np.int32))], names=["vec_id", "embedding", "cell"])

    return run


def _cells(centres: list[np.ndarray], counts: np.ndarray, wanted: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            d = [_squares(h, c) for h, c in zip(_halves(_matrix(batch["embedding"])), centres, strict=True)]
            marks = []
            for x, y in zip(*d, strict=True):
                visited = np.zeros(len(counts), np.uint8)
                visited[traverse(x, y, counts, wanted)] = 1
                marks.append(np.packbits(visited).tobytes())
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["embedding"], pa.array(marks, pa.binary())], names=["vec_id", "embedding", "cells"])

    return run


def _rerank(queries, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q, visited = queries.value
        best = [np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)]

        def keep(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
            at, score, vec = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((vec, score, at))
            at, score, vec = at[order], score[order], vec[order]
            starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.empty(0, int)
            rank = np.arange(len(at)) - np.repeat(starts, np.diff(np.r_[starts, len(at)]))
            return [x[rank < k] for x in (at, score, vec)]

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, vecs, cells = batch["vec_id"].to_numpy(), _matrix(batch["embedding"]), batch["cell"].to_numpy()
            order = np.argsort(cells, kind="stable")
            found = [best]
            for part in np.split(order, np.flatnonzero(np.diff(cells[order])) + 1):
                who = np.flatnonzero(visited[:, cells[part[0]]])
                step = max(1, (1 << 21) // (q.shape[1] * max(1, len(part)) + 1))
                for lo in range(0, len(who), step):
                    mine = who[lo : lo + step]
                    for rows in np.array_split(part, -(-len(part) // 8192)):
                        score = np.sqrt(((q[mine][:, None, :] - vecs[rows][None]) ** 2).sum(-1))
                        score[qids[mine][:, None] == ids[rows][None]] = np.inf
                        by_id = np.argsort(ids[rows], kind="stable")  # so that ties go to the smaller id
                        near = by_id[np.argsort(score[:, by_id], axis=1, kind="stable")[:, :k]]
                        s = np.take_along_axis(score, near, 1)
                        ok = np.isfinite(s)
                        found.append([np.repeat(mine, near.shape[1])[ok.ravel()], s[ok], ids[rows][near][ok]])
            best = keep(found)
        yield pa.RecordBatch.from_arrays([pa.array(qids[best[0]]), pa.array(best[2]), pa.array(best[1])], names=["query_id", "vec_id", "score"])

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding of the rows that take part: a vector of the usual length, finite throughout, not zero."""
    rows = pick(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    fine = "embedding is not null and vec_id is not null and size(embedding) > 1 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"
    rows = rows.where(fine)
    length = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("embedding") == (length["n"] if length else 0))


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, centroids: int = CENTROIDS, probe: float = PROBE, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found (Euclidean) to each row whose vec_id is divisible by `every`.

    Centroids are fitted on at most SAMPLE_ROWS rows (those of smallest id hash); every row is indexed. Each query
    visits cells by summed distance until they hold `probe` of all rows (and more than k), and all rows of these cells
    are reranked with their original vectors in double precision; ties go to the smaller vec_id. The index is sorted by
    (cell, id), a crowded cell over several partitions. Queries go to the tasks in blocks; each task returns k rows a
    query. Rows without an id, or whose vector is null, zero, of another length or not finite, take no part. Rows that
    share an id are all candidates, and one row of an id that is a query asks. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    sample = rows.orderBy(F.xxhash64("vec_id"), "embedding").limit(SAMPLE_ROWS).select("embedding").collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sample:
        return spark.createDataFrame([], schema)
    centres = fit(np.asarray([r["embedding"] for r in sample]), centroids)
    indexed = rows.mapInArrow(_assign(centres), "vec_id long, embedding array<double>, cell int")
    index = cut(indexed.repartitionByRange("cell", "vec_id").sortWithinPartitions("cell", "vec_id"), "multi-index")
    n_cells = len(centres[0]) * len(centres[1])
    counts = np.zeros(n_cells, np.int64)
    for r in index.groupBy("cell").count().collect():  # a row for each cell at most
        counts[r["cell"]] = r["count"]
    wanted = max(k + 1, int(np.ceil(probe * counts.sum())))
    asking = index.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = cut(asking.mapInArrow(_cells(centres, counts, wanted), "vec_id long, embedding array<double>, cells binary"), "queries")
    blocks = max(1, -(-asked.count() // query_block))
    parts = []
    for block in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64(F.lit(SEED), "vec_id"), F.lit(blocks)) == block).collect()
        if not mine:
            continue
        visited = np.unpackbits(np.frombuffer(b"".join(bytes(r["cells"]) for r in mine), np.uint8).reshape(len(mine), -1), axis=1)[:, :n_cells].astype(bool)
        queries = spark.sparkContext.broadcast((np.asarray([r["vec_id"] for r in mine], np.int64), np.asarray([r["embedding"] for r in mine]), visited))
        parts.append(cut(index.mapInArrow(_rerank(queries, k), "query_id long, vec_id long, score double"), "near"))
    found = parts[0] if parts else spark.createDataFrame([], "query_id long, vec_id long, score double")
    for part in parts[1:]:
        found = found.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
