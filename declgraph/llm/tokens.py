"""Token-ID output: documents as zstandard frames under one shared dictionary, in blocks with an offset index."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterable, Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from declgraph.llm.common import new_path, pick, smallest, split_words, table, worker_cache

END_ID = 2
SAMPLE_DOCS = 1000  # documents that the dictionary is trained on, and the characters of each
SAMPLE_CHARS = 8192
DICT_BYTES = 64 << 10
PART_BYTES = 32 << 20  # text of one file
MOST_PARTS = 100_000
BLOCK_BYTES = 4 << 20  # frames of one block
LEVEL = 3
CACHED_WORDS = 400_000
TAILS = ".,!?;:*#%&$"  # what may follow a letter and is a piece of its own
BLOCK_SCHEMA = "part int, first_doc long, last_doc long, n_docs long, rel_start long, n_tokens long, dict_sha256 string, index binary, payload binary"


#: Byte-level BPE writes printable bytes as themselves and numbers the others from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = dict(zip([*_PRINTED, *(b for b in range(256) if b not in set(_PRINTED))], [*_PRINTED, *range(256, 512)], strict=False))


class Encoder:
    """Token ids of texts as little-endian uint32 bytes, the library's own, remembered by word.

    The tokenizer never joins characters across ASCII white space, lower-cases, and starts a new piece at a mark of TAILS
    after a letter, so ids of a text are those of its words put together. Arrow numbers the words of some megabytes of text,
    each distinct one is looked up once, and NumPy gathers the ids. Texts that may hold a special token's string go to the library whole.
    """

    def __init__(self, tokenizer_json: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json.decode())
        self.words: dict[str, bytes] = {}

    @staticmethod
    def _plain(text: str) -> bool:
        """Latin letters: one piece, which normalisation only turns to lower case."""
        return text.isalpha() and (text.isascii() or (max(text) < "\u0250" and "\u0130" not in text))

    def _learn(self, missing: list[str]) -> None:
        known, tokenize, plain = self.words, self.tokenizer.model.tokenize, self._plain
        if len(known) > CACHED_WORDS:
            known.clear()
        ended: list[tuple[str, str, str]] = []
        others: dict[str, None] = {}
        for word in missing:
            core = word.rstrip(TAILS)
            if core and core is not word and len(core) < len(word) and core[-1].isalpha() and core[-1] < "\u0250":
                ended.append((word, core, word[len(core) :]))
                if ended[-1][2] not in known:
                    others[ended[-1][2]] = None
            else:
                core = word
            if core not in known:
                if plain(core):
                    shown = core if core.isascii() else core.lower().encode().decode("latin-1").translate(_BYTE_CHARS)
                    ids = [t.id for t in tokenize(shown)]
                    known[core] = pack(f"<{len(ids)}I", *ids)
                else:
                    others[core] = None
        for word, found in zip(others, self.tokenizer.encode_batch_fast(list(others), add_special_tokens=False), strict=True):
            known[word] = np.asarray(found.ids, "<u4").tobytes()
        for word, core, tail in ended:
            known[word] = known[core] + known[tail]

    def encode(self, texts: pa.Array | list[str]) -> Iterator[bytes]:
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        for lo, hi, offsets, codes, words in split_words(texts, lower=True):
            known = words.to_pylist()
            ids = list(map(self.words.get, known))
            missing = [w for w, x in zip(known, ids, strict=True) if x is None]
            if missing:
                self._learn(missing)
                ids = [self.words[w] if x is None else x for w, x in zip(known, ids, strict=True)]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            pool, starts = np.frombuffer(b"".join(ids), "<u4"), np.concatenate([[0], np.cumsum(sizes)])[:-1]
            n = sizes[codes]
            ends = np.concatenate([[0], np.cumsum(n)])
            data = pool[np.repeat(starts[codes] - ends[:-1], n) + np.arange(ends[-1])].tobytes()
            cuts = (4 * ends[offsets]).tolist()
            special = pc.match_substring(texts.slice(lo, hi - lo).fill_null(""), "<|").to_pylist()
            for i in range(hi - lo):
                if special[i]:
                    yield np.asarray(self.tokenizer.encode(texts[lo + i].as_py(), add_special_tokens=False).ids, "<u4").tobytes()
                else:
                    yield data[cuts[i] : cuts[i + 1]]


def _frames(tokenizer, dictionary: bytes, bounds: np.ndarray, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache("tokens")
        key = hashlib.sha256(tokenizer.value).digest()
        if key not in cache:
            cache[key] = Encoder(tokenizer.value)
        encoder, end = cache[key], np.asarray([end_id], "<u4").tobytes()
        squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dict(dictionary), write_checksum=True, write_content_size=True)
        for batch in batches:
            ids = batch["doc_id"]
            known = ids.fill_null(-(1 << 63)).to_numpy()
            parts = np.searchsorted(bounds, known, "left").astype(np.int32)
            at, held, counts = 0, [], []
            for i, x in enumerate(encoder.encode(batch["text"])):
                counts.append(len(x) // 4 + 1)
                held.append(squeeze.compress(x + end))
                if len(held) == 512 or i == batch.num_rows - 1:
                    n = len(held)
                    yield pa.RecordBatch.from_arrays([ids[at : at + n], batch["uid"][at : at + n], pa.array(parts[at : at + n]), pa.array(counts, pa.int64()), pa.array(held, pa.binary())], names=["doc_id", "uid", "part", "n_tokens", "frame"])
                    at, held, counts = at + n, [], []

    return run


def _dict(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def train(samples: Iterable[bytes], size: int = DICT_BYTES) -> bytes:
    """A zstandard dictionary of serialized ids; empty (no dictionary) where the samples are too few or too short."""
    samples = [s for s in samples if len(s) >= 8]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def pack_index(ids: list[int | None], n_tokens: list[int], lengths: list[int]) -> bytes:
    """Header of a block: counts, then int64 doc ids, ids' presence (one byte each), token counts, n + 1 offsets."""
    offsets = np.concatenate([[0], np.cumsum(np.asarray(lengths, "<i8"))]).astype("<i8")
    return b"".join([b"TIDX1\0\0\0", np.asarray([len(ids)], "<i8").tobytes(), np.asarray([i or 0 for i in ids], "<i8").tobytes(), np.asarray([i is not None for i in ids], "u1").tobytes(), np.asarray(n_tokens, "<i8").tobytes(), offsets.tobytes()])


def unpack_index(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    if data[:8] != b"TIDX1\0\0\0":
        raise ValueError("not a token-id index")
    n = int(np.frombuffer(data, "<i8", 1, 8)[0])
    at = 16
    ids = np.frombuffer(data, "<i8", n, at)
    known = np.frombuffer(data, "u1", n, at + 8 * n).astype(bool)
    counts = np.frombuffer(data, "<i8", n, at + 9 * n)
    return ids, known, counts, np.frombuffer(data, "<i8", n + 1, at + 17 * n)


def _blocks(dict_sha: str, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        ids, counts, frames, size = [], [], [], 0

        def block() -> pa.RecordBatch:
            known = [i for i in ids if i is not None]
            row = {"part": part, "first_doc": min(known, default=None), "last_doc": max(known, default=None), "n_docs": len(ids), "rel_start": before, "n_tokens": sum(counts), "dict_sha256": dict_sha, "index": pack_index(ids, counts, list(map(len, frames))), "payload": b"".join(frames)}
            types = {"part": pa.int32(), "dict_sha256": pa.string(), "index": pa.binary(), "payload": pa.binary()}
            return pa.RecordBatch.from_arrays([pa.array([v], types.get(k, pa.int64())) for k, v in row.items()], names=list(row))

        for batch in batches:
            for i, n, frame in zip(batch["doc_id"].to_pylist(), batch["n_tokens"].to_pylist(), batch["frame"], strict=True):
                ids.append(i)
                counts.append(n)
                frames.append(frame.as_py())
                size += len(frames[-1])
                if size >= block_bytes:
                    yield block()
                    before += sum(counts)
                    ids, counts, frames, size = [], [], [], 0
        if ids:
            yield block()

    return run


def write_ids(docs: DataFrame, path: str, tokenizer_json: bytes, end_id: int = END_ID, block_bytes: int = BLOCK_BYTES, part_bytes: int = PART_BYTES) -> None:
    """Encodes every whole text of docs(doc_id, text) and writes `path`/dict and `path`/blocks, by ascending doc_id.

    The dictionary is trained once on at most SAMPLE_DOCS documents (those of smallest id hash, SAMPLE_CHARS of each); it
    changes sizes, never contents. Documents meet in files of neighbouring ids: the bounds come from the ids alone, so
    the texts are read and encoded once, and what is exchanged is compressed. Null texts are empty documents; null ids
    come first; rows with one id follow each other. Other columns are not written. An empty table writes no block.
    """
    spark = docs.sparkSession
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    sample = smallest(rows.select(F.xxhash64("doc_id").alias("h"), F.substring("text", 1, SAMPLE_CHARS).alias("text")), SAMPLE_DOCS)
    dictionary = train(Encoder(tokenizer_json).encode([r["text"] for r in sample]))
    dict_sha = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(dict_sha, bytearray(dictionary))], "dict_sha256 string, dictionary binary").coalesce(1).write.parquet(f"{path}/dict")

    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = min(MOST_PARTS, max(1, -(-total // part_bytes)))
    shares = [i / n for i in range(1, n)]
    bounds = rows.agg(F.percentile_approx("doc_id", shares, max(10_000, 10 * n))).first()[0] if shares else []
    tokenizer = spark.sparkContext.broadcast(tokenizer_json)
    frames = rows.withColumn("uid", F.monotonically_increasing_id()).mapInArrow(_frames(tokenizer, dictionary, np.asarray(bounds or [], np.int64), end_id), "doc_id long, uid long, part int, n_tokens long, frame binary")
    sorted_ = frames.repartitionById(n, F.col("part")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "uid")
    sorted_.select("doc_id", "n_tokens", "frame").mapInArrow(_blocks(dict_sha, block_bytes), BLOCK_SCHEMA).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def _read(dictionaries: dict[str, bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = {k: zstandard.ZstdDecompressor(dict_data=_dict(v)) for k, v in dictionaries.items()}
        for batch in batches:
            for row in range(batch.num_rows):
                ids, known, counts, offsets = unpack_index(batch["index"][row].as_py())
                payload, plain = batch["payload"][row].as_buffer(), unpack[batch["dict_sha256"][row].as_py()]
                start = batch["start"][row].as_py() + np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
                for lo in range(0, len(ids), 256):
                    hi = min(len(ids), lo + 256)
                    raw = [plain.decompress(payload[int(a) : int(b)]) for a, b in zip(offsets[lo:hi], offsets[lo + 1 : hi + 1], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi], mask=~known[lo:hi]), pa.array(start[lo:hi]), pa.array([len(x) // 4 for x in raw], pa.int64()), pa.array(raw, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return run


def read_ids(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids (uint32 little-endian); of `doc_ids` only, if given.

    Single documents cost the blocks that may hold them (Parquet's column bounds) and, there, only their own frames.
    """
    blocks = spark.read.parquet(f"{path}/blocks")
    ends = blocks.groupBy("part").agg(F.max(F.col("rel_start") + F.col("n_tokens")).alias("tokens"))
    until = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each file, MOST_PARTS at most.
    first = F.broadcast(ends.select(F.col("part").alias("p"), F.coalesce(F.sum("tokens").over(until), F.lit(0)).cast("long").alias("first")))
    if doc_ids is not None:
        near = F.lit(False)
        for i in doc_ids:
            near = near | ((F.col("first_doc") <= i) & (F.col("last_doc") >= i))
        blocks = blocks.where(near)
    placed = blocks.join(first, F.col("part") == F.col("p")).select("dict_sha256", (F.col("first") + F.col("rel_start")).alias("start"), "index", "payload")
    dictionaries = {r["dict_sha256"]: bytes(r["dictionary"]) for r in spark.read.parquet(f"{path}/dict").collect()}
    out = placed.mapInArrow(_read(dictionaries), "doc_id long, start long, n_tokens long, ids binary")
    return out if doc_ids is None else out.where(F.col("doc_id").isin(doc_ids))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        tokenizer = f.read()
    path = new_path(spark, "ids")
    write_ids(table(spark, sf_dir, "documents"), path, tokenizer)
    return read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
