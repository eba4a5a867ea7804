"""SimHash near-dedup with multi-index hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from declgraph.llm.common import Stored, cut, hashed_words, lean, rolled, table
from declgraph.llm.graph import components

SEED = 42
RADIUS = 2
SEGMENT = 32  # bits; a fingerprint has two, and one of them differs in RADIUS // 2 bits at most
CROWDED = 64  # fingerprints of one segment's value; beyond, whole balls stand in for the table of that value
LEAST = 0.8
PARITY_BITS = 1024
SHORT_BITS = 512  # of the parities that go with a row into its buckets, at least
SHORT_MOST = 8192  # and at most, as a long text has many buckets: longer ones only bound more tightly
STARS = 4  # rows that a row is first compared with; what these do not join, the blocks of its buckets do
BLOCK_ROWS = 2000  # rows of a bucket that are compared with each other in one task
SLICES = 1024  # tasks that the pairs of one row are dealt to, at most
#: Shingles that many documents have come last in the order of shingles. Which ones do is read off a sample; any order finds all pairs.
SAMPLE_ROWS, SAMPLE_LEAST, SAMPLE_TOP = 10_000, 4, 100_000
BEFORE = 4  # buckets of a row that go with it into its next one, to tell pairs that have met already
SLACK = 1e-9  # bounds give way by so much for rounding


def shingle_hashes(words: list[bytes], width: int) -> Iterator[int]:
    """XXH64 of each run of `width` words joined by a space; of the whole sequence if there are fewer."""
    joined = b" ".join(words)
    if not words:
        return
    if len(words) <= width:
        yield xxhash.xxh64_intdigest(joined, SEED)
        return
    ends = list(accumulate((len(w) + 1 for w in words), initial=0))
    digest = xxhash.xxh64_intdigest
    for a, b in zip(ends, ends[width:]):
        yield digest(joined[a : b - 1], SEED)


def majority(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half the hashes; zero without any."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounded memory for texts of any length
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0]) if len(hashes) else 0


def fingerprint(text: str | None, width: int = 3) -> int:
    words = (text or "").encode().lower().split()
    return majority(np.fromiter(shingle_hashes(words, width), np.uint64)) if words else 0


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), width) for t in batch["text"]), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch["uid"], batch["doc_id"], pa.array(fps.view(np.int64))], names=["uid", "doc_id", "fp"])

    return run


def _segment(fp: Column, s: int) -> Column:
    return (F.shiftrightunsigned(fp, SEGMENT * s)).bitwiseAND(F.lit((1 << SEGMENT) - 1))


def links(fps: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """fps(fp), distinct -> (u, v), u > v: links that join all fingerprints at RADIUS or fewer differing bits.

    Multi-index hashing: a table for each of the two segments holds the fingerprints by that segment's value. Two
    fingerprints at most two bits apart differ in one bit at most in one segment, so each fingerprint looks up the ball of
    radius one around either segment, and complete distances of the matches are verified.
    A value that many fingerprints share (families of near copies) would make its matches the square of them. Those who
    look up such a value are linked another way, which is as complete: each enters the points of its whole ball of radius one; two are at most two bits
    apart exactly if their balls share a point; a point has 65 fingerprints at most, which are linked to its smallest.
    """
    fps = cut(fps.select("fp"), "distinct-fps")
    entries = fps.select("fp", F.posexplode(F.array(*(_segment(F.col("fp"), s) for s in (0, 1)))).alias("seg", "value"))
    full = cut(entries.groupBy("seg", "value").count().where(F.col("count") > crowded).select("seg", "value"), "crowded")
    # Of two values one bit apart, the one without the bit looks up the other.
    ball = lambda s: F.expr(f"filter(transform(sequence(-1, {SEGMENT - 1}), i -> if(i < 0, s{s}, s{s} | shiftleft(1L, i))), (x, i) -> i = 0 or x <> s{s})")
    both = fps.select("fp", *(_segment(F.col("fp"), s).alias(f"s{s}") for s in (0, 1)))
    probes = both.select("fp", ball(0).alias("b0"), ball(1).alias("b1")).select("fp", F.posexplode(F.array("b0", "b1")).alias("seg", "values")).select("fp", "seg", F.explode("values").alias("value"))
    light = entries.join(full, ["seg", "value"], "left_anti").withColumnRenamed("fp", "v")
    distance = F.bit_count(F.col("u").bitwiseXOR(F.col("v")))
    near = probes.withColumnRenamed("fp", "u").join(light, ["seg", "value"]).where((F.col("u") != F.col("v")) & (distance <= RADIUS)).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    inside = cut(probes.join(full, ["seg", "value"], "left_semi").select("fp").distinct(), "inside-crowded")
    whole = F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")
    points = inside.select("fp", F.explode(whole).alias("z")).groupBy("z").agg(F.collect_list("fp").alias("near")).where(F.size("near") > 1)
    star = points.select(F.array_min("near").alias("v"), F.explode("near").alias("u")).where((F.col("u") != F.col("v")) & (distance <= RADIUS)).select("u", "v")
    return cut(near.unionByName(star).distinct(), "fp-links")


def near_dedup(docs: DataFrame | Stored, width: int = 3) -> DataFrame:
    """One row for each row of docs(doc_id, text): uid, doc_id, fp, component_id (smallest doc_id reached over links).

    Null texts count as empty; texts without words have fingerprint zero and link like any other. component_id is null
    only where every document reached has a null id. Other columns are not looked at; an empty table gives no rows.
    """
    rows = (docs if isinstance(docs, Stored) else Stored(docs)).pick("doc_id", "text").select("uid", F.col("doc_id").cast("long"), "text")
    marked = cut(rows.mapInArrow(lean(_fingerprints(width)), "uid long, doc_id long, fp long"), "fps")
    roots = components(links(marked.select("fp").distinct()))
    rooted = cut(marked.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("uid", "doc_id", "fp", F.coalesce("root", "fp").alias("root")), "rooted")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "uid")).alias("best")
    least = cut(rooted.groupBy("root").agg(best), "least")
    return rooted.join(least, "root").select("uid", "doc_id", "fp", F.col("best.doc_id").alias("component_id"), F.expr("best.uid = uid").alias("kept"))


def prefix(shingles: np.ndarray, least: float, often: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a sorted set, in the order of (sample's count, hash): as many as make sure that any two sets with
    a Jaccard similarity of `least` or more have one of these in common (at least * n of n are shared, so one of the others is not enough)."""
    n = len(shingles)
    if not n:
        return shingles
    if len(often):
        at = np.minimum(np.searchsorted(often, shingles), len(often) - 1)
        shingles = shingles[np.argsort(np.where(often[at] == shingles, counts[at], 0), kind="stable")]
    return shingles[: n - math.ceil(least * n - SLACK) + 1]


def parity(shingles: np.ndarray) -> bytes:
    """Bit i: whether an odd number of shingles fall on it. Two sets' bits differ in no more places than the sets do in
    members. Large sets have more bits, so that they do not fill them; halves laid over each other give the shorter form."""
    bits = max(PARITY_BITS, 1 << max(0, len(shingles) - 1).bit_length())
    return np.packbits(np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def fold(u: np.ndarray, bits: int) -> np.ndarray:
    """Parities (of one length, along the last axis) as ones of `bits`: halves laid over each other bound the distance just
    as well, only less tightly."""
    while u.shape[-1] > bits // 64:
        half = u.shape[-1] // 2
        u = u[..., :half] ^ u[..., half:]
    return u


def short_parity(bits: bytes) -> bytes:
    """The parity that goes into the buckets: half as many bits as the set's own has, within SHORT_BITS and SHORT_MOST. With
    a fixed length, sets far larger than it would fill it, and every two of them would seem alike."""
    return fold(np.frombuffer(bits, np.uint64), min(SHORT_MOST, max(SHORT_BITS, len(bits) * 4))).tobytes()


class Parities:
    """Short parities of some rows, each folded to every length from SHORT_BITS to its own: two rows compare at the shorter's."""

    def __init__(self, short: list[bytes]):
        self.bits = np.fromiter((len(b) * 8 for b in short), np.int64, len(short))
        own = {b: np.frombuffer(b"".join(s for s in short if len(s) * 8 == b), np.uint64).reshape(-1, b // 64) for b in np.unique(self.bits).tolist()}
        self.levels = {}
        for b in own:
            at = np.flatnonzero(self.bits >= b)
            level = np.empty((len(at), b // 64), np.uint64)
            for longer, rows in own.items():
                if longer >= b:
                    level[self.bits[at] == longer] = fold(rows, b)
            place = np.zeros(len(short), np.int64)
            place[at] = np.arange(len(at))
            self.levels[b] = level, place

    def near(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Whether rows i and j differ in `most` bits at most, pair by pair."""
        ok, both = np.zeros(len(i), bool), np.minimum(self.bits[i], self.bits[j])
        for b, (level, place) in self.levels.items():
            mine = np.flatnonzero(both == b)
            step = max(1, (1 << 22) // b)  # bounded memory
            for lo in range(0, len(mine), step):
                at = mine[lo : lo + step]
                ok[at] = np.bitwise_count(level[place[i[at]]] ^ level[place[j[at]]]).sum(1) <= most[at]
        return ok


def parity_distance(a: bytes, b: bytes) -> int:
    u, v = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(u) != len(v):
        if len(u) < len(v):
            u, v = v, u
        u = u[: len(u) // 2] ^ u[len(u) // 2 :]
    return int(np.bitwise_count(u ^ v).sum())


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text, as 64-bit hashes of their words (A-Z in lower case)."""
    for lo, hi, offsets, hashes, _ in hashed_words(texts, lower=True):
        every = rolled(hashes, width)
        for i in range(hi - lo):
            a, b = offsets[i], offsets[i + 1]
            yield np.unique(every[a : b - width + 1] if b - a >= width else rolled(hashes[a:b], int(b - a)) if b > a else every[:0])


def shingle_set(text: str | None, width: int) -> np.ndarray:
    return next(shingle_sets(pa.array([text], pa.string()), width))


def _signed(width: int, least: float, often: np.ndarray, counts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                n, fp, same, bits, short, keys = [], [], [], [], [], []
                for shingles in shingle_sets(part["text"], width):
                    n.append(len(shingles))
                    fp.append(majority(shingles))
                    same.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                    bits.append(parity(shingles))
                    short.append(short_parity(bits[-1]))
                    keys.append(prefix(shingles, least, often, counts).view(np.int64))
                yield pa.RecordBatch.from_arrays([part["uid"], part["doc_id"], pa.array(n, pa.int32()), pa.array(np.asarray(fp, np.uint64).view(np.int64)), pa.array(same, pa.binary()), pa.array(bits, pa.binary()), pa.array(short, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["uid", "doc_id", "n", "fp", "same", "bits", "short", "keys"])

    return run


def _shingles(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                sets = list(shingle_sets(batch["text"].slice(lo, 256), width))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64), pa.int64())], names=["s"])

    return run


def _often(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of several documents of a sample, sorted, and in how many they are. Only speed depends on them."""
    share = max(1, rows.count() // SAMPLE_ROWS)
    some = rows.where(F.pmod(F.xxhash64("uid"), F.lit(share)) == 0).select("text").mapInArrow(lean(_shingles(width)), "s long")
    found = some.groupBy("s").agg(F.count("*").alias("c")).where(f"c >= {SAMPLE_LEAST}").orderBy(F.desc("c"), "s").limit(SAMPLE_TOP).toArrow()
    s, c = (np.asarray(found[i].to_numpy()) for i in ("s", "c"))
    order = np.argsort(s.view(np.uint64))
    return s.view(np.uint64)[order], c[order].astype(np.int32)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets; two empty ones are alike."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _apart(least: float):
    """Of n + m shingles of two alike sets, the share that only one of them has, at most."""
    return (1 - least) / (1 + least)


def _may_be_alike(n, m, pos_n, pos_m, least: float):
    """By their sizes, and by what is left of both from a shared shingle on, if it is the first that they share (if it is not,
    they meet there as well). Takes arrays or columns."""
    left, both = least / (1 + least), n + m
    return (n >= least * m - SLACK) & (m >= least * n - SLACK) & (n - pos_n >= left * both - SLACK) & (m - pos_m >= left * both - SLACK)


def _met(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (bucket, lo, hi, n, uid) -> pairs of rows of blocks lo and hi with different roots that may be alike
        by sizes, places and short parities.

        Two rows that share one of the BEFORE buckets before this one have met there, with bounds no tighter than here, so they
        are left to it. The first bucket that two rows share comes first for both, so each pair has one where it is not left."""
        held = None  # the last group so far, and its parities

        def pairs(rows: np.ndarray, short: list[bytes]) -> Iterator[pa.RecordBatch]:
            bucket, lo, hi, uid, root, n, pos, block, *_ = rows
            before = rows[-BEFORE:].T
            parities = Parities(short)
            new = np.r_[True, (rows[:3, 1:] != rows[:3, :-1]).any(0)]
            rank = np.arange(len(uid)) - np.maximum.accumulate(np.where(new, np.arange(len(uid)), 0))
            at, k = np.flatnonzero(rank >= 1), 1
            while len(at):  # each row with the one k before it in its group, for all rows at once
                to = at - k
                # Sizes grow within a group: those further back are smaller still, so a row that finds one too small is done.
                fits = n[to] >= least * n[at] - SLACK
                at, to = at[fits], to[fits]
                ok = (root[at] != root[to]) & ((lo[at] == hi[at]) | (block[at] != block[to])) & _may_be_alike(n[at], n[to], pos[at], pos[to], least)
                i, j = at[ok], to[ok]
                new_here = ~(before[i][:, :, None] == before[j][:, None, :]).any((1, 2))
                i, j = i[new_here], j[new_here]
                close = parities.near(i, j, (n[i] + n[j]) * _apart(least) + SLACK)
                if close.any():
                    x, y = uid[i[close]], uid[j[close]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], names=["x", "y"])
                k += 1
                at = at[rank[at] >= k]

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch[c].to_numpy().astype(np.int64) for c in ("bucket", "lo", "hi", "uid", "root", "n", "pos", "block", *(f"p{k}" for k in range(BEFORE)))])
            short = batch["short"].to_pylist()
            if held is not None:
                rows, short = np.concatenate([held[0], rows], axis=1), held[1] + short
            starts = int(np.argmax((rows[:3] == rows[:3, -1:]).all(0)))  # of the last group, which may go on
            if starts:
                yield from pairs(rows[:, :starts], short[:starts])
            held = rows[:, starts:], short[starts:]
        if held is not None:
            yield from pairs(*held)

    return run


def _alike(width: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (y, slice, x), y's own text first (x null) -> the pairs whose similarity is `least` or more."""
        mine = None
        for batch in batches:
            left, right = [], []
            for y, x, shingles in zip(batch["y"].to_pylist(), batch["x"].to_pylist(), shingle_sets(batch["text"], width), strict=True):
                if x is None:
                    mine = shingles
                elif jaccard(mine, shingles) >= least:
                    left.append(x)
                    right.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["x", "y"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, uid, n, pos) sorted by (bucket, uid) -> those of buckets with several rows, with the bucket's row of the
    smallest uid: y, y_n, y_pos.

    A bucket may go on in the next partition. So the rows of a partition's first bucket, and its last row if that is
    alone in its bucket here, have edge 1: whether they are shared, and with whom, is not known yet; edge 2 only reports
    the smallest uid of the last bucket.
    """
    first = None
    rest = None  # the last bucket so far: bucket, y, and its row if there is one only

    def out(rows: np.ndarray, y: np.ndarray, edge: np.ndarray) -> pa.RecordBatch:
        every = [*rows, *y, edge]
        return pa.RecordBatch.from_arrays([pa.array(c if i in (0, 1, 4) else c.astype(np.int32)) for i, c in enumerate(every)], names=["bucket", "uid", "n", "pos", "y", "y_n", "y_pos", "edge"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([batch[c].to_numpy().astype(np.int64) for c in ("bucket", "uid", "n", "pos")])
        if first is None:
            first = rows[0, 0]
        goes_on = rest is not None and rest[0] == rows[0, 0]
        if rest is not None and rest[2] is not None:
            if goes_on or rest[0] == first:
                rows = np.concatenate([rest[2], rows], axis=1)
        starts = np.flatnonzero(np.r_[True, rows[0, 1:] != rows[0, :-1]])
        sizes = np.diff(np.r_[starts, rows.shape[1]])
        y = np.repeat(rows[1:, starts], sizes, axis=1)
        known = np.repeat(sizes > 1, sizes)
        if goes_on and rest[2] is None:
            y[:, : sizes[0]], known[: sizes[0]] = rest[1], True
        edge = rows[0] == first
        last = rows[0] == rows[0, -1]
        held = last & ~known  # one row at most, not known to be shared
        show = (known | edge) & ~held
        if show.any():
            yield out(rows[:, show], y[:, show], edge[show])
        rest = rows[0, -1], y[:, -1:], rows[:, held] if held.any() else None
    if rest is not None:
        if rest[2] is not None:
            yield out(rest[2], rest[2][1:], np.ones(1, np.int64))
        else:
            yield out(np.concatenate([np.full((1, 1), rest[0]), rest[1]]), rest[1], np.full(1, 2))


def _near(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = (batch["x_n"].to_numpy().astype(np.int64) + batch["y_n"].to_numpy()) * _apart(least) + SLACK
            ok = np.fromiter((parity_distance(x.as_buffer(), y.as_buffer()) <= m for x, y, m in zip(batch["x_bits"], batch["y_bits"], most, strict=True)), bool, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch["x"].filter(pa.array(ok)), batch["y"].filter(pa.array(ok))], names=["x", "y"])

    return run


def _possible(pairs: DataFrame, marked: DataFrame, least: float) -> DataFrame:
    """The pairs(x, y) that may be alike by a lower bound of how many shingles only one of them has.

    Alike sets of n and m shingles differ in (1 - least) / (1 + least) * (n + m) of them at most, and their parities in no
    more bits, so the bound drops no alike pair.
    """
    side = lambda c: marked.select(F.col("uid").alias(c), F.col("bits").alias(f"{c}_bits"), F.col("n").alias(f"{c}_n"))
    return pairs.join(side("x"), "x").join(side("y"), "y").select("x", "y", "x_n", "y_n", "x_bits", "y_bits").mapInArrow(lean(_near(least)), "x long, y long")


def _verified(close: DataFrame, stored: Stored, width: int, least: float) -> DataFrame:
    """The pairs(x, y) whose shingles are alike.

    Only texts of these pairs are exchanged. The pairs of one y are dealt to SLICES tasks at most, with y's text once for
    each, so a y of very many pairs spreads over tasks, and a task holds the shingles of two texts at a time.
    """
    dealt = close.select(F.col("x").alias("uid"), "x", "y", F.pmod(F.xxhash64("x"), F.lit(SLICES)).cast("int").alias("slice"))
    own = dealt.select(F.col("y").alias("uid"), F.lit(None).cast("long").alias("x"), "y", "slice").distinct()
    asked = cut(dealt.unionByName(own), "asked")
    texts = stored.only(asked.select("uid").distinct(), "text").join(asked, "uid").select("y", "slice", "x", "text")
    ordered = texts.repartition("y", "slice").sortWithinPartitions("y", "slice", F.col("x").asc_nulls_first())
    return cut(ordered.mapInArrow(lean(_alike(width, least)), "x long, y long"), "alike", batch_rows=64)


def similar(docs: DataFrame | Stored, width: int = 5, least: float = LEAST) -> DataFrame:
    """One row for each row of docs(doc_id, text): uid, doc_id, kept. Documents whose sets of `width`-word shingles have
    a Jaccard similarity of `least` or more are linked, and of each component of links the smallest doc_id stays.

    First the fingerprints of the sets go through multi-index hashing, links(), which finds the closest copies. No radius
    that is worth looking up holds all pairs at `least`, so what fingerprints miss is found by a prefix filter: in one order of all
    shingles, two alike sets share one of their first few, so a document's bucket keys are these, and every linked pair
    shares a bucket, whatever the number and the size of the documents. Equal sets are one node. Of the first rows of
    its buckets, the STARS it meets most often, each row is verified against the smallest that may be alike; then all
    pairs of a bucket that are in different components by then are, block by block, so that a large group of copies costs no square, and no pair is left out. Pairs are verified
    on the shingles themselves. The result depends on doc_ids and texts only, where doc_ids differ. Null texts count as
    empty, and texts without words as alike; no rows give none.
    """
    stored = docs if isinstance(docs, Stored) else Stored(docs)
    rows = stored.pick("doc_id", "text").select("uid", F.col("doc_id").cast("long"), "text")
    often, counts = _often(rows, width)
    signed = cut(rows.mapInArrow(lean(_signed(width, least, often, counts)), "uid long, doc_id long, n int, fp long, same binary, bits binary, short binary, keys array<long>"), "signed")
    node = cut(signed.groupBy("same", "n").agg(F.min("uid").alias("node"), F.min("fp").alias("fp"), F.count("*").alias("rows")), "nodes")
    equal = cut(signed.select("uid", "same").join(node.where("rows > 1").select("same", "node"), "same").where("uid <> node").select(F.col("uid").alias("u"), F.col("node").alias("v")), "equal")
    marked = signed.select("uid", "n", "bits")

    # Near fingerprints: the smallest row of each, linked as the fingerprints are; rows of one fingerprint with its smallest.
    of_fp = cut(node.groupBy("fp").agg(F.min("node").alias("head"), F.count("*").alias("sets")), "heads")
    near = links(of_fp.select("fp"))
    head = lambda c: of_fp.select(F.col("fp").alias(c), F.col("head").alias(f"{c}_head"))
    across = near.join(head("u"), "u").join(head("v"), "v").select(F.greatest("u_head", "v_head").alias("x"), F.least("u_head", "v_head").alias("y"))
    within = node.select("fp", F.col("node").alias("x")).join(of_fp.where("sets > 1").select("fp", F.col("head").alias("y")), "fp").where("x <> y").select("x", "y")

    keyed = signed.join(equal.select(F.col("u").alias("uid")), "uid", "left_anti").select("uid", "n", F.posexplode("keys").alias("pos", "bucket"))
    ordered = keyed.select("bucket", "uid", "n", "pos").repartitionByRange("bucket", "uid").sortWithinPartitions("bucket", "uid")
    runs = cut(ordered.mapInArrow(_shared, "bucket long, uid long, n int, pos int, y long, y_n int, y_pos int, edge int"), "shared")
    ends = runs.where("edge > 0").groupBy("bucket").agg(F.min(F.struct("uid", "n", "pos")).alias("least"), F.max("uid").alias("most")).where("least.uid < most").select("bucket", "least")
    # Buckets at the ends of partitions, two each at most: the bound that allows the broadcast.
    at_ends = runs.where("edge = 1").join(F.broadcast(ends), "bucket").select("bucket", "uid", "n", "pos", F.col("least.uid").alias("y"), F.col("least.n").alias("y_n"), F.col("least.pos").alias("y_pos"))
    shared = runs.where("edge = 0").drop("edge").unionByName(at_ends)
    star = shared.where((F.col("uid") != F.col("y")) & _may_be_alike(F.col("n"), F.col("y_n"), F.col("pos"), F.col("y_pos"), least)).select(F.col("uid").alias("x"), "y")
    often_met = F.row_number().over(Window.partitionBy("x").orderBy(F.desc("c"), "y"))
    star = star.repartition("x").groupBy("x", "y").agg(F.count("*").alias("c")).withColumn("rank", often_met).where(F.col("rank") <= STARS).select("x", "y")
    star = _possible(star, marked, least).groupBy("x").agg(F.min("y").alias("y"))
    first = cut(_possible(across.unionByName(within), marked, least).unionByName(star).distinct(), "first")
    edge = lambda p: p.select(F.col("x").alias("u"), F.col("y").alias("v"))
    edges = cut(equal.unionByName(edge(_verified(first, stored, width, least))), "edges")

    roots = components(edges)
    rooted = shared.join(roots.withColumnRenamed("node", "uid"), "uid", "left").select("bucket", "uid", "n", "pos", F.coalesce("root", "uid").alias("root"))
    mixed = cut(rooted.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("m")).where("a < b").select("bucket", F.ceil(F.col("m") / BLOCK_ROWS).cast("int").alias("blocks")), "mixed")
    # Its uid stands for what a row does not have before: no two rows share it.
    in_order = Window.partitionBy("uid").orderBy("pos")
    inside = rooted.join(mixed, "bucket").select("*", *(F.coalesce(F.lag("bucket", k + 1).over(in_order), "uid").alias(f"p{k}") for k in range(BEFORE)))
    placed = inside.join(signed.select("uid", "short"), "uid").withColumn("block", F.pmod(F.xxhash64("uid"), "blocks").cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    ordered = dealt.select("bucket", "lo", "hi", "uid", "root", "n", "pos", "block", *(f"p{k}" for k in range(BEFORE)), "short").repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi", "n", "uid")
    # Each pair once, and none that was among the first: one exchange, with the pair's buckets merged before it.
    met = ordered.mapInArrow(lean(_met(least)), "x long, y long").withColumn("old", F.lit(False)).unionByName(first.withColumn("old", F.lit(True)))
    met = met.groupBy("x", "y").agg(F.bool_or("old").alias("old")).where("not old").select("x", "y")
    met = cut(_possible(met, marked, least), "met")
    roots = components(edges.unionByName(edge(_verified(met, stored, width, least))))
    rooted = cut(signed.select("uid", "doc_id").join(roots.withColumnRenamed("node", "uid"), "uid", "left").select("uid", "doc_id", F.coalesce("root", "uid").alias("root")), "rooted")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "uid")).alias("best")
    groups = cut(rooted.groupBy("root").agg(best, F.count("*").alias("n")).where("n > 1"), "least")
    return rooted.join(groups, "root", "left").select("uid", "doc_id", F.expr("best is null or best.uid = uid").alias("kept"))


def drop_near_copies(docs: DataFrame, width: int = 5, least: float = LEAST) -> DataFrame:
    """The rows of docs that similar() keeps, with all their columns, whatever their names. Kept texts are not exchanged."""
    stored = Stored(docs)
    return stored.without(similar(stored, width, least).where("not kept").select("uid"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
