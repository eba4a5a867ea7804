"""SentencePiece encoding and decoding; giant documents by a max-plus parallel scan."""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from declgraph.llm.common import cut, lean, pick, table, worker_cache

GIANT_CHARS = 65536  # longer texts are split
CHUNK_CHARS = 16384
GROUP = 64  # chunks whose matrices are combined first
CACHED_UNITS = 150_000
SPACE = "▁"
NONE = -np.inf


class Coder:
    """Ids of a BPE model as the library gives them, and the lattice that gives the same ids chunk by chunk.

    BPE has no scores to add, yet fits the scan: a sequence of pieces is the encoding of its text if and only if each
    piece and each pair of neighbours is encoded as itself. With weight 0 for such neighbours and -inf for others, the
    best path through the lattice of pieces is the only one above -inf, and is the encoding.
    """

    def __init__(self, model: bytes):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = sp.get_piece_size()
        plain = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.score = {sp.id_to_piece(i): (sp.get_score(i), i) for i in plain}
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(size) if sp.is_byte(i)}
        self.longest = max(map(len, self.score))
        self.shown = _shown(sp)
        probe = sp.encode("a  b")
        fine = len(self.bytes) == 256 and "\n" not in "".join(self.score) and not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.score)
        if not fine or sp.decode(probe) != "a  b" or len(sp.encode("\n")) != 2 or sp.encode("Åﬁ") == sp.encode("Åfi"):
            raise ValueError("the model must be BPE with byte fallback, keep white space, and join no piece over its start")
        self.units: dict[str, bytes] = {}
        self.own: dict[str, bool] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    # whole texts -----------------------------------------------------------------------------------------------

    def unit(self, unit: str) -> bytes:
        """Ids of a run of spaces and what follows it, or of what a line starts with."""
        ids = self.sp.encode(unit[1:]) if unit[:1] == " " and len(unit) > 1 else self.sp.encode("\n" + unit)[2:]
        found = np.asarray(ids, "<u4").tobytes()
        if len(unit) <= 64:
            if len(self.units) > CACHED_UNITS:
                self.units.clear()
            self.units[unit] = found
        return found

    def encode(self, text: str) -> bytes:
        """No piece crosses a line break or the start of a run of spaces: the units between are encoded once each."""
        if not text:
            return b""
        out, get = [], self.units.get
        newline = np.asarray([self.bytes[10]], "<u4").tobytes()
        for i, line in enumerate((" " + text).replace(SPACE, " ").split("\n")):
            if i:
                out.append(newline)
            if line:
                for u in _units(line):
                    out.append(get(u) or self.unit(u))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return _text(self.shown, ids)

    # the lattice -----------------------------------------------------------------------------------------------

    def merge(self, text: str) -> list[str]:
        """BPE of a short text: the pair of best score first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((self.score[p][0], -i) for i, p in enumerate(map(str.__add__, parts, parts[1:])) if p in self.score), default=None)
            if best is None:
                break
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def valid(self, piece: str) -> bool:
        if piece not in self.score:
            return False
        ok = self.own.get(piece)
        if ok is None:
            ok = self.own[piece] = self.merge(piece) == [piece]
        return ok

    def follows(self, left: str, right: str) -> bool:
        key = left, right
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) > CACHED_UNITS:
                self.pairs.clear()
            # A character outside the vocabulary is a piece of its own that nothing merges with.
            ok = self.pairs[key] = not left or left not in self.score or right not in self.score or self.merge(left + right) == [left, right]
        return ok

    def at(self, text: str, p: int) -> list[str]:
        """Pieces that may start at p; the character itself if it is none."""
        found = [text[p : p + n] for n in range(1, min(self.longest, len(text) - p) + 1) if self.valid(text[p : p + n])]
        return found if text[p] in self.score else [text[p], *found]

    def states(self, text: str, a: int, first: bool) -> list[tuple[str, int]]:
        """What may lie over the boundary before a: a piece that starts before it, and how far it reaches behind it."""
        if first:
            return [("", 0)]
        return [(p, s + len(p) - a) for s in range(max(0, a - self.longest), a) for p in self.at(text, s) if s + len(p) >= a]

    def transfer(self, text: str, a: int, b: int, first: bool) -> tuple[list, list, np.ndarray]:
        """Best weight from each state before a to each state before b, for the pieces that start in [a, b)."""
        starts = self.states(text, a, first)
        nodes: dict[int, dict[str, np.ndarray]] = {}
        for i, (p, over) in enumerate(starts):
            row = nodes.setdefault(a + over, {}).setdefault(p, np.full(len(starts), NONE))
            row[i] = 0.0
        for p in range(a, b):
            lefts = nodes.pop(p, None)
            rights = self.at(text, p) if lefts else ()
            for left, row in (lefts or {}).items():
                for right in rights:
                    if self.follows(left, right):
                        here = nodes.setdefault(p + len(right), {})
                        old = here.get(right)
                        here[right] = row if old is None else np.maximum(old, row)
        ends = [(piece, p - b) for p, here in nodes.items() for piece in here]
        matrix = np.stack([here[piece] for here in nodes.values() for piece in here], 1) if ends else np.empty((len(starts), 0))
        return starts, ends, matrix

    def trace(self, text: str, a: int, b: int, start: tuple[str, int], end: tuple[str, int]) -> list[int]:
        """Ids of the pieces that start in [a, b) on the path between two states."""
        back: dict[tuple[int, str], tuple[int, str] | None] = {(a + start[1], start[0]): None}
        todo: dict[int, list[str]] = {a + start[1]: [start[0]]}
        for p in range(a, b):
            lefts = todo.pop(p, ())
            rights = self.at(text, p) if lefts else ()
            for left in lefts:
                for right in rights:
                    node = (p + len(right), right)
                    if node not in back and self.follows(left, right):
                        back[node] = (p, left)
                        todo.setdefault(node[0], []).append(right)
        node, out = (b + end[1], end[0]), []
        while back[node] is not None:
            out.append(node[1])
            node = back[node]
        return [i for piece in reversed(out) for i in ([self.score[piece][1]] if piece in self.score else [self.bytes[c] for c in piece.encode()])]


def _shown(sp) -> list[bytes]:
    """What each id stands for in a text."""
    return [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else sp.id_to_piece(i).replace(SPACE, " ").encode() for i in range(sp.get_piece_size())]


def _text(shown: list[bytes], ids: bytes) -> str:
    data = b"".join(map(shown.__getitem__, np.frombuffer(ids, "<u4").tolist()))
    return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


def _units(line: str) -> list[str]:
    if "  " in line or line[-1] == " ":
        return re.findall(" *[^ ]+| +", line)
    words = line.split(" ")
    return [*([words[0]] if words[0] else []), *[" " + w for w in words[1:]]]


def compose(x: tuple[list, list, np.ndarray], y: tuple[list, list, np.ndarray]) -> tuple[list, list, np.ndarray]:
    """The max-plus product of two neighbours' matrices; associative."""
    at = {s: i for i, s in enumerate(y[0])}
    out = np.full((len(x[0]), len(y[1])), NONE)
    for j, s in enumerate(x[1]):
        if s in at:
            out = np.maximum(out, x[2][:, j, None] + y[2][at[s]][None])
    return x[0], y[1], out


def boundary_path(matrices: list[tuple[list, list, np.ndarray]], start, end) -> list:
    """States at all boundaries of the best path through the matrices, from `start` to `end` (None: no overhang)."""
    best, backs = {start: 0.0}, []
    for starts, ends, m in matrices:
        here, back = {}, {}
        for i, s in enumerate(starts):
            if s in best:
                for j in np.flatnonzero(m[i] > NONE):
                    v = best[s] + m[i, j]
                    if v > here.get(ends[j], NONE):
                        here[ends[j]], back[ends[j]] = v, s
        best = here
        backs.append(back)
    if end is None:
        end = max((s for s in best if s[1] == 0), key=best.__getitem__)
    path = [end]
    for back in reversed(backs):
        path.append(back[path[-1]])
    return path[::-1]


def _coder(model) -> Coder:
    cache = worker_cache("pieces")
    key = hash(model.value)
    if key not in cache:
        cache[key] = Coder(model.value)
    return cache[key]


def _encode(model, decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [coder.encode(t.as_py() or "") for t in part["text"]]
                more = [pa.array([coder.decode(x) for x in ids], pa.string())] if decoded else []
                yield pa.RecordBatch.from_arrays([part["uid"], part["doc_id"], part["sha"], pa.array(ids, pa.binary()), *more], names=["uid", "doc_id", "sha", "ids", "decoded"][: 4 + decoded])

    return run


def _split(longest: int, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, doc, sha, text in zip(*(batch[c].to_pylist() for c in ("uid", "doc_id", "sha", "text")), strict=True):
                text = SPACE + text.replace(" ", SPACE)
                n = -(-len(text) // chunk)
                for ix in range(n):
                    a, b = ix * chunk, min(len(text), (ix + 1) * chunk)
                    # A last chunk shorter than a piece is no chunk: it joins the one before it.
                    if ix and b - a < longest:
                        continue
                    if 0 < len(text) - b < longest:
                        b = len(text)
                    lo = max(0, a - longest)
                    yield pa.RecordBatch.from_pylist([{"uid": uid, "doc_id": doc, "sha": sha, "ix": ix, "text": text[lo : b + longest], "a": a - lo, "b": b - lo}], schema=_CHUNK)

    return run


_CHUNK = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("sha", pa.string()), ("ix", pa.int64()), ("text", pa.string()), ("a", pa.int64()), ("b", pa.int64())])


def _matrices(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(model)
        for batch in batches:
            for r in batch.to_pylist():
                m = coder.transfer(r["text"], r["a"], r["b"], r["ix"] == 0)
                yield pa.RecordBatch.from_arrays([pa.array([r["uid"]]), pa.array([r["ix"]]), pa.array([pickle.dumps(m)], pa.binary())], names=["uid", "ix", "m"])

    return run


def _combined(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("ix")
    whole = None
    for m in map(pickle.loads, rows["m"]):
        whole = m if whole is None else compose(whole, m)
    return pd.DataFrame({"uid": [rows["uid"].iloc[0]], "g": [rows["g"].iloc[0]], "m": [pickle.dumps(whole)]})


def _group_ends(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("g")
    path = boundary_path([pickle.loads(m) for m in rows["m"]], ("", 0), None)
    return pd.DataFrame({"uid": rows["uid"], "g": rows["g"], "ends": [pickle.dumps((a, b)) for a, b in zip(path, path[1:], strict=False)]})


def _chunk_ends(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("ix")
    path = boundary_path([pickle.loads(m) for m in rows["m"]], *pickle.loads(rows["ends"].iloc[0]))
    return pd.DataFrame({"uid": rows["uid"], "ix": rows["ix"], "ends": [pickle.dumps((a, b)) for a, b in zip(path, path[1:], strict=False)]})


def _traces(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(model)
        for batch in batches:
            for r in batch.to_pylist():
                ids = coder.trace(r["text"], r["a"], r["b"], *pickle.loads(r["ends"]))
                yield pa.RecordBatch.from_arrays([pa.array([r["uid"]]), pa.array([r["doc_id"]], pa.int64()), pa.array([r["sha"]], pa.string()), pa.array([r["ix"]]), pa.array([np.asarray(ids, "<u4").tobytes()], pa.binary())], names=["uid", "doc_id", "sha", "ix", "ids"])

    return run


def encode(docs: DataFrame, model: bytes, giant: int = GIANT_CHARS, chunk: int = CHUNK_CHARS, decoded: bool = False) -> DataFrame:
    """docs(doc_id, text) -> uid, doc_id, sha (sha256 of the text), ids (uint32 little-endian): the library's ids.

    Texts over `giant` characters are split into chunks at any place. Each chunk gives a matrix from the states at its
    start to those at its end (pieces over the boundary); the matrices of GROUP chunks are combined to one, a document's
    groups are walked once, then each group's chunks, and every chunk is traced on its own between its two states.
    Other texts are one chunk, which has nothing to combine. Null texts are empty and have no ids; other columns are
    not looked at; no rows give none. With `decoded`, the decoded text follows, by the worker that holds the ids anyway.
    """
    spark = docs.sparkSession
    longest = Coder(model).longest
    chunk = max(chunk, longest)
    shared = spark.sparkContext.broadcast(model)
    rows = pick(docs, "doc_id", "text").select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("sha", F.sha2("text", 256))
    short = rows.where(F.length("text") <= giant).mapInArrow(lean(_encode(shared, decoded), "pieces"), "uid long, doc_id long, sha string, ids binary" + ", decoded string" * decoded)
    chunks = rows.where(F.length("text") > giant).mapInArrow(lean(_split(longest, chunk), "pieces"), "uid long, doc_id long, sha string, ix long, text string, a long, b long")
    chunks = cut(chunks, "chunks")
    # A few chunks to a task: they are small to send and long to work on.
    tasks = max(1, -(-chunks.count() // 4))
    matrices = cut(chunks.repartition(tasks, "uid", "ix").mapInArrow(lean(_matrices(shared), "pieces"), "uid long, ix long, m binary"), "matrices").withColumn("g", F.floor(F.col("ix") / GROUP).cast("long"))
    groups = cut(matrices.groupBy("uid", "g").applyInPandas(_combined, "uid long, g long, m binary"), "groups")
    ends = cut(groups.groupBy("uid").applyInPandas(_group_ends, "uid long, g long, ends binary"), "group-ends")
    ends = cut(matrices.join(ends, ["uid", "g"]).groupBy("uid", "g").applyInPandas(_chunk_ends, "uid long, ix long, ends binary"), "chunk-ends")
    traced = chunks.join(ends, ["uid", "ix"]).repartition(tasks, "uid", "ix").mapInArrow(lean(_traces(shared), "pieces"), "uid long, doc_id long, sha string, ix long, ids binary")
    # A document's ids come together in the row that holds them.
    whole = traced.groupBy("uid").agg(F.max("doc_id").alias("doc_id"), F.max("sha").alias("sha"), F.array_sort(F.collect_list(F.struct("ix", "ids"))).alias("parts"))
    joined = whole.select("uid", "doc_id", "sha", F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
    return short.unionByName(decode(joined, model) if decoded else joined)


def _decode(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        # Only the table of pieces: a decoder runs beside every encoder.
        cache, key = worker_cache("pieces"), ("shown", hash(model.value))
        if key not in cache:
            cache[key] = _shown(sentencepiece.SentencePieceProcessor(model_proto=model.value))
        shown = cache[key]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = pa.array([_text(shown, x.as_buffer()) for x in part["ids"]], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*part.schema.names, "decoded"])

    return run


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """encoded(ids, ...) -> the same with `decoded`: pieces put together, bytes as UTF-8, the first space left out."""
    from pyspark.sql.types import StringType, StructType

    shared = encoded.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*encoded.schema.fields]).add("decoded", StringType())
    return encoded.mapInArrow(lean(_decode(shared), "pieces"), schema)


def model_bytes() -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def round_trip(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, decoded_sha256, round_trip of every document, encoded and decoded."""
    model = model_bytes()
    both = encode(docs, model, decoded=True)
    sha = F.sha2("decoded", 256)
    found = both.select("doc_id", F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"), sha.alias("decoded_sha256"), (sha == F.col("sha")).alias("round_trip"))
    return cut(found, "round-trip")  # workers get small batches there


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
