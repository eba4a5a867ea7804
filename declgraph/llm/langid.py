"""Language identification by Bayesian evidence fusion."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from declgraph.llm.common import Stored, cut, lean, pick, table

SAMPLE_DOCS = 4000  # labelled rows that the text model is trained on, whole
BINS = 1 << 15  # of hashed byte trigrams
EVIDENCE = 120  # trigrams that a text counts for at most: they are not independent
SMOOTH_HOST = 8.0  # pseudo-documents of the domain in a host's prior, of the whole in a domain's
SMOOTH = 1.0  # pseudo-documents in the tables of declared languages and suffixes
LEAST = 0.5  # posterior below which a document is rejected
SEED = 5

_TAGS = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")
_LETTER = re.compile(r"[^\W\d_]")


def _bins(data: bytes) -> np.ndarray:
    a = np.frombuffer(data, np.uint8).astype(np.uint32)
    return (a[:-2] * np.uint32(40503) + a[1:-1] * np.uint32(2531) + a[2:] * np.uint32(151)) % np.uint32(BINS)


def _log(counts: np.ndarray) -> np.ndarray:
    counts = counts + 0.5
    return np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32)


def _counts(data: bytes) -> np.ndarray:
    """Trigrams of a text by bin, in bounded memory."""
    out = np.zeros(BINS, np.int64)
    for at in range(0, max(0, len(data) - 2), 1 << 20):
        out += np.bincount(_bins(data[at : at + (1 << 20) + 2]), minlength=BINS)
    return out


def train(rows: list[tuple[str, str]]) -> tuple[list[str], np.ndarray]:
    """(lang, text) -> languages and log P(trigram | language), smoothed by half a count."""
    langs = sorted({lang for lang, _ in rows})
    counts = np.zeros((len(langs), BINS))
    for lang, text in rows:
        counts[langs.index(lang)] += _counts(text.lower().encode())
    return langs, _log(counts)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, text -> a task's trigram counts of each language."""
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            found = _counts(text.as_py().lower().encode())
            held[lang.as_py()] = held.get(lang.as_py(), 0) + found
    for lang, counts in held.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1)), pa.array([-1, *at.tolist()], pa.int32()), pa.array([0, *counts[at].tolist()], pa.int64())], names=["lang", "bin", "n"])


def train_on(documents: DataFrame) -> tuple[list[str], np.ndarray]:
    """The model of at most SAMPLE_DOCS labelled rows of documents(doc_id, text, lang), those of smallest id hash (more only
    where ids repeat), counted where they lie: what reaches the driver is a table of languages by BINS."""
    rows = pick(documents, "doc_id", "text", "lang").where("lang is not null and text is not null")
    rows = rows.select(F.xxhash64(F.lit(SEED), "doc_id").alias("h"), F.col("lang").cast("string").alias("lang"), "text")
    last = rows.select("h").orderBy("h").limit(SAMPLE_DOCS).agg({"h": "max"}).first()[0]
    if last is None:
        return [], np.empty((0, BINS), np.float32)
    found = rows.where(F.col("h") <= last).select("lang", "text").mapInArrow(lean(_counted), "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(found["lang"].to_pylist()))
    counts = np.zeros((len(langs), BINS))
    lang, at, n = np.searchsorted(langs, found["lang"].to_pylist()) if langs else np.empty(0, int), found["bin"].to_numpy(), found["n"].to_numpy()
    real = at >= 0
    counts[lang[real], at[real]] = n[real]
    return langs, _log(counts)


def _likelihoods(model, markup: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = np.ascontiguousarray(model.value.T)
        for batch in batches:
            out, letters = [], []
            for text in batch["text"]:
                text = text.as_py() or ""
                if markup:
                    text = _TAGS.sub(" ", text)
                letters.append(bool(_LETTER.search(text)))
                data, total, n = text.lower().encode(), np.zeros(logs.shape[1]), 0
                for at in range(0, max(0, len(data) - 2), 1 << 20):
                    bins = _bins(data[at : at + (1 << 20) + 2])
                    total += logs[bins].sum(0, dtype=np.float64)
                    n += len(bins)
                out.append(total * min(1.0, EVIDENCE / n) if n else total)
            names = batch.schema.names
            cols = [batch[c] for c in names if c != "text"] + [pa.array([list(x) for x in out], pa.list_(pa.float64())), pa.array(letters)]
            yield pa.RecordBatch.from_arrays(cols, names=[c for c in names if c != "text"] + ["loglik", "letters"])

    return run


def _softmax(logs: Column, n: int) -> Column:
    top = F.array_max(logs)
    exps = F.transform(logs, lambda x: F.exp(x - top))
    whole = F.aggregate(exps, F.lit(0.0), lambda a, x: a + x)
    return F.transform(exps, lambda x: x / whole) if n else F.array().cast("array<double>")


def _sums(rows: DataFrame, key: str, n: int, of: str = "soft") -> DataFrame:
    """Expected documents by language for each key: partial sums first, a row for each key and task in the exchange."""
    return rows.groupBy(key).agg(F.array(*(F.sum(F.col(of)[i]) for i in range(n))).alias("c"))


def _smoothed(c: Column, base: Column, weight: float) -> Column:
    whole = F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(c, base, lambda x, b: (x + weight * b) / (whole + weight))


def identify(rows: DataFrame, langs: list[str], logs: np.ndarray, markup: bool = False) -> DataFrame:
    """rows(uid, id, text, declared, suffix, host, domain) -> uid, id, lang, confidence, text_lang, accepted.

    log posterior = text + log P(declared | L) + log P(suffix | L) + log prior(L | host). The tables of the last three
    are grouped sums of the text's own posterior over all rows; a host's prior is smoothed by its domain's, that by the
    whole's, and a row's own part is taken out of its host's counts, so no text vouches for itself. Null evidence is
    the value ''. A text without a letter, or whose best language has a posterior under LEAST, is not accepted
    (lang 'und'). Without a trained language nothing is accepted. Equal rows get equal answers; no rows give none.
    """
    n = len(langs)
    spark = rows.sparkSession
    model = spark.sparkContext.broadcast(logs)
    clean = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("declared", "suffix", "host", "domain")]
    scored = rows.select("uid", "id", "text", *clean).mapInArrow(lean(_likelihoods(model, markup)), "uid long, id long, declared string, suffix string, host string, domain string, loglik array<double>, letters boolean")
    scored = cut(scored, "text-likelihoods")
    if not n:
        return scored.select("uid", "id", F.lit("und").alias("lang"), F.lit(0.0).alias("confidence"), F.lit("und").alias("text_lang"), F.lit(False).alias("accepted"))
    soft = scored.withColumn("soft", _softmax(F.col("loglik"), n))
    sure = soft.where("letters")  # a text without letters says nothing of its host
    even = F.array(*[F.lit(1.0 / n)] * n)
    hosts = sure.groupBy("host", "domain").agg(F.array(*(F.sum(F.col("soft")[i]) for i in range(n))).alias("c"))
    hosts = cut(hosts, "host-counts")
    added = lambda key: hosts.groupBy(*key).agg(F.array(*(F.sum(F.col("c")[i]) for i in range(n))).alias("up"))
    whole = F.broadcast(added([]).select(F.col("up").alias("whole")))  # one row
    domains = cut(added(["domain"]).crossJoin(whole).select("domain", _smoothed(F.coalesce("up", F.array(*[F.lit(0.0)] * n)), _smoothed(F.coalesce("whole", F.array(*[F.lit(0.0)] * n)), even, float(n)), SMOOTH_HOST).alias("base")), "domain-priors")
    priors = cut(hosts.join(domains, "domain").select("host", "domain", "c", "base"), "host-priors")

    def table_of(key: str) -> DataFrame:
        """P(value | language), smoothed towards the value's share of all."""
        c = cut(_sums(sure, key, n), f"{key}-counts")
        all_ = F.broadcast(c.agg(F.array(*(F.sum(F.col("c")[i]) for i in range(n))).alias("all"), F.count("*").alias("kinds")))
        share = lambda x, a, k: (x + SMOOTH) / (a + SMOOTH * k)
        return cut(c.crossJoin(all_).select(F.col(key).alias(f"k_{key}"), F.zip_with("c", "all", lambda x, a: F.log(share(x, a, F.col("kinds")))).alias(f"l_{key}")), f"{key}-table")

    declared, suffix = table_of("declared"), table_of("suffix")
    near = priors.select(F.col("host").alias("k_host"), F.col("domain").alias("k_domain"), "c", "base")
    joined = soft.join(near, (F.col("host") == F.col("k_host")) & (F.col("domain") == F.col("k_domain")), "left")
    joined = joined.join(declared, F.col("declared") == F.col("k_declared"), "left").join(suffix, F.col("suffix") == F.col("k_suffix"), "left")
    zero = F.array(*[F.lit(0.0)] * n)
    own = F.when(F.col("letters"), F.col("soft")).otherwise(zero)
    others = F.zip_with(F.coalesce("c", zero), own, lambda a, b: F.greatest(a - b, F.lit(0.0)))
    prior = F.transform(_smoothed(others, F.coalesce("base", even), SMOOTH_HOST), lambda x: F.log(F.greatest(x, F.lit(1e-6))))
    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    total = plus(plus(F.col("loglik"), prior), plus(F.coalesce("l_declared", zero), F.coalesce("l_suffix", zero)))
    fused = joined.select("uid", "id", "letters", "soft", _softmax(total, n).alias("post"))
    best = lambda c: F.element_at(F.array(*map(F.lit, langs)), F.array_position(c, F.array_max(c)).cast("int"))
    accepted = F.col("letters") & (F.array_max("post") >= LEAST)
    return fused.select("uid", "id", F.when(accepted, best(F.col("post"))).otherwise("und").alias("lang"), F.when(F.col("letters"), F.array_max("post")).otherwise(0.0).alias("confidence"), F.when(F.col("letters"), best(F.col("soft"))).otherwise("und").alias("text_lang"), accepted.alias("accepted"))


def page_evidence(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> rows for identify(): the language that the first html tag declares, without its region, the host's
    last label and the first path segment of two letters as suffix, the host, and its last two labels as domain."""
    p = Stored(pages).pick("page_id", "url", "html")
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    path = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/([a-zA-Z]{2})(?:[/?#]|$)", 1))
    declared = F.lower(F.regexp_extract(F.regexp_extract("html", r"(?is)<html\b[^>]*", 0), r"(?is)<html\b[^>]*\blang\s*=\s*[\"']?([a-z]+)", 1))
    return p.select(
        "uid", F.col("page_id").cast("long").alias("id"), F.col("html").alias("text"), declared.alias("declared"),
        F.concat_ws("/", F.substring_index(host, ".", -1), path).alias("suffix"), host.alias("host"), F.substring_index(host, ".", -2).alias("domain"),
    )


def document_evidence(docs: DataFrame | Stored) -> DataFrame:
    """docs(doc_id, text, source) -> rows for identify(); the source stands for the host, there is no markup."""
    none, stored = F.lit(""), docs if isinstance(docs, Stored) else Stored(docs)
    return stored.pick("doc_id", "text", "source").select("uid", F.col("doc_id").cast("long").alias("id"), "text", none.alias("declared"), none.alias("suffix"), F.col("source").alias("host"), none.alias("domain"))


def drop_unidentified(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """The rows of docs that identify() accepts, with all their columns, whatever their names. Null and empty texts and
    texts without a letter go; rows that are equal stay or go together; no rows give none."""
    model, stored = train_on(labelled), Stored(docs)
    return stored.without(identify(document_evidence(stored), *model).where("not accepted").select("uid"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    langs, logs = train_on(table(spark, sf_dir, "documents"))
    found = identify(page_evidence(table(spark, sf_dir, "pages")), langs, logs, markup=True)
    return found.select(F.col("id").alias("page_id"), "lang", F.round("confidence", 6).alias("confidence"), "text_lang", "accepted")
