"""Language identification by nearest centroids.

A text is its letter n-grams of one to three characters, lower-cased, with word ends, hashed to
``BINS`` bins; 1 + log of the counts times the inverse document frequency, at length one. A language
has up to ``CLUSTERS`` centroids from spherical k-means; those of less than ``LEAST`` of its texts,
which are junk or texts with a wrong label, are left out. A text takes the language of the centroid
with the largest cosine, and is rejected if that cosine is below the language's limit for texts of its
length: ``SLACK`` times the ``TAIL`` quantile of the cosines of training texts, whole and cut to
``CUTS`` characters, with as many n-grams to a power of two.

Counts for the inverse document frequency cover every training row. The centroids are fitted on a
bounded sample of the labelled rows: those ``SAMPLE`` of a language whose hashes of doc_id and text are
smallest, so that one group of vectors has a fixed size. The model is CLUSTERS vectors a language.

Defined cases: a null text, or one without letters, is ``und`` with score 0 and rejected; a null
language isn't learned; a null doc_id isn't learned from and isn't held out; without any labelled
row all texts are ``und``; ties go to the first language by name; other columns are ignored.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import mapped, rows

BINS, CLUSTERS, SAMPLE, TAIL, SLACK, LEAST = 4_096, 4, 2_000, 0.01, 0.7, 0.01
#: Lengths of the pieces that limits of short texts come from, the powers of two that n-grams of a text can reach, and the pieces that a limit needs.
CUTS, POWERS, ENOUGH = (8, 16, 32, 64, 128, 256, 512, 1024), 64, 20
#: Characters counted at a time.
_PIECE = 100_000
_SPACE = np.uint64(32)
#: Hashes by which the sample is picked.
_PLACES = 1_000_003
_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)
    return _letters


def _bin(code: np.ndarray) -> np.ndarray:
    code = code * np.uint64(0x9E3779B97F4A7C15)
    return ((code ^ (code >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)


def _add(counts: np.ndarray, texts: list[str], owners: list[int]) -> None:
    """Adds the n-grams of texts to the rows of counts that own them."""
    lowered = [x.lower() for x in texts]
    joined = " " + " ".join(lowered) + " "
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    owner = np.concatenate([[0], np.repeat(owners, [len(x) + 1 for x in lowered])])
    code[~_is_letter()[code.astype(np.int64)]] = _SPACE
    keep = np.concatenate([[True], (code[1:] != _SPACE) | (code[:-1] != _SPACE)])
    code, owner = code[keep], owner[keep] * BINS
    if len(code) < 3:
        return
    letter = code != _SPACE
    size = counts.size
    flat = counts.reshape(-1)
    flat += np.bincount((owner + _bin(code))[letter], minlength=size)
    pair = (code[:-1] << np.uint64(21)) | code[1:]
    flat += np.bincount(np.where(letter[:-1], owner[:-1], owner[1:]) + _bin(pair | np.uint64(1 << 63)), minlength=size)
    middle = letter[1:-1]
    triple = ((pair[:-1] << np.uint64(21)) | code[2:])[middle]
    flat += np.bincount(owner[1:-1][middle] + _bin(triple), minlength=size)


def ngram_counts(texts: list[str | None]) -> np.ndarray:
    """Counts (int64, len(texts) x BINS); long texts are counted piece by piece."""
    counts = np.zeros((len(texts), BINS), dtype=np.int64)
    pieces: list[str] = []
    owners: list[int] = []
    size, first = 0, 0
    for k, text in enumerate(texts):
        for at in range(0, len(text or ""), _PIECE):
            pieces.append(text[at : at + _PIECE])
            owners.append(k - first)
            size += len(pieces[-1])
            if size >= 4 * _PIECE:
                _add(counts[first : k + 1], pieces, owners)
                pieces, owners, size, first = [], [], 0, k
    if pieces:
        _add(counts[first:], pieces, owners)
    return counts


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF rows; a row without n-grams stays zero."""
    out = np.zeros(counts.shape)
    r, c = np.nonzero(counts)
    out[r, c] = (1 + np.log(counts[r, c])) * idf[c]
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norms > 0, norms, 1)


def _cosines(counts: np.ndarray, idf: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Cosines with each centroid, rounded: their last digits depend on how many texts are multiplied at a time."""
    return np.round(vectors(counts, idf) @ centroids.T, 6)


def powers(counts: np.ndarray) -> np.ndarray:
    """The power of two that the n-grams of each row reach."""
    return np.log2(np.maximum(counts.sum(axis=1), 1)).astype(np.int64)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids and each row's own; the first is the mean's nearest row, each next the farthest row."""
    k = min(k, len(x))
    chosen = [int(np.argmax(x @ x.mean(axis=0)))]
    near = x @ x[chosen[0]]
    for _ in range(1, k):
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[chosen[-1]])
    centroids = x[chosen].copy()
    own = np.full(len(x), -1)
    for _ in range(rounds):
        now = np.argmax(x @ centroids.T, axis=1)
        if np.array_equal(now, own):
            break
        own = now
        for j in range(k):
            if np.any(own == j):
                mean = x[own == j].mean(axis=0)
                centroids[j] = mean / max(np.linalg.norm(mean), 1e-12)
    return centroids, own


@dataclass(frozen=True)
class Model:
    """Centroids of all languages, by language name, with the limits of each by powers of two of n-grams."""

    langs: list[str]
    centroids: np.ndarray
    limits: np.ndarray
    idf: np.ndarray

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """Language, cosine and whether it is too far from every centroid, for each text."""
        counts = ngram_counts(texts)
        if not self.langs:
            return [("und", 0.0, True)] * len(texts)
        cosines = _cosines(counts, self.idf, self.centroids)
        best = np.argmax(cosines, axis=1)
        some = counts.any(axis=1).tolist()
        values = np.clip(cosines[np.arange(len(texts)), best], 0, 1)
        return [(self.langs[b], v, bool(v < t)) if s else ("und", 0.0, True) for b, v, t, s in zip(best.tolist(), values.tolist(), self.limits[best, powers(counts)].tolist(), some, strict=True)]


def _document_frequencies(train: DataFrame) -> tuple[int, np.ndarray]:
    """Training texts, and how many of them have each bin; bins of a task are added up before they are shuffled."""

    def count(batches):
        import pyarrow as pa

        total = np.zeros(BINS + 1, dtype=np.int64)
        for part in rows(batches, "text"):
            total[:BINS] += (ngram_counts([t for (t,) in part]) > 0).sum(axis=0)
            total[BINS] += len(part)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bin", "n"])

    totals = np.zeros(BINS + 1, dtype=np.int64)
    for r in mapped(train.select("text"), count, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():  # BINS rows
        totals[r["bin"]] = r["n"]
    return int(totals[BINS]), totals[:BINS]


def fit(train: DataFrame, sample: int = SAMPLE, clusters: int = CLUSTERS) -> Model:
    """The model of labelled rows: doc_id, text and lang."""
    train = train.select("doc_id", "text", "lang").filter("text is not null and lang is not null and doc_id is not null")
    spark = train.sparkSession
    train = train.withColumn("place", F.pmod(F.xxhash64("doc_id", "text"), F.lit(_PLACES)))
    sizes = train.groupBy("lang").agg(F.count("*").alias("n"), F.min("place").alias("least")).collect()  # a row a language
    n, df = _document_frequencies(train)
    idf = np.log((1 + n) / (1 + df)) + 1
    if not sizes:
        return Model([], np.zeros((0, BINS)), np.zeros((0, POWERS)), idf)
    # by their hashes more rows than are wanted are likely, so that few are ordered; the rank is the bound
    likely = [(r["lang"], max(r["least"], int(2 * sample / r["n"] * _PLACES))) for r in sizes]
    last = F.broadcast(spark.createDataFrame(likely, "lang string, last long"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id", "text"))
    picked = train.join(last, "lang").filter(F.col("place") <= F.col("last")).withColumn("rank", rank).filter(F.col("rank") <= sample).select("doc_id", "lang", "text")

    def vectorise(batches):
        import pyarrow as pa

        for part in rows(batches, "doc_id", "lang", "text"):
            d, lang, t = zip(*part, strict=True)
            x = vectors(ngram_counts(list(t)), idf)
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(lang, pa.string()), pa.array([v.astype(np.float32).tobytes() for v in x], pa.binary())], names=["doc_id", "lang", "v"])

    def cluster(pdf):
        import pandas as pd

        pdf = pdf.sort_values("doc_id")
        x = np.stack([np.frombuffer(v, dtype=np.float32).astype(np.float64) for v in pdf["v"]])
        lang, x = pdf["lang"].iloc[0], x[np.any(x, axis=1)]
        if not len(x):
            return pd.DataFrame([], columns=["lang", "k", "centroid"])
        centroids, own = spherical_kmeans(x, clusters)
        made = []
        for k, c in enumerate(centroids):
            if np.any(own == k) and np.mean(own == k) >= LEAST:
                made.append((lang, k, c.tobytes()))
        return pd.DataFrame(made, columns=["lang", "k", "centroid"])

    found = mapped(picked, vectorise, "doc_id long, lang string, v binary").groupBy("lang").applyInPandas(cluster, "lang string, k int, centroid binary").collect()  # CLUSTERS rows a language
    found.sort(key=lambda r: (r["lang"], r["k"]))
    centroids = np.stack([np.frombuffer(r["centroid"]) for r in found]) if found else np.zeros((0, BINS))
    langs = [r["lang"] for r in found]
    return Model(langs, centroids, _limits(picked, langs, centroids, idf), idf)


def _limits(picked: DataFrame, langs: list[str], centroids: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The limit of each centroid's language for each power of two; where there are too few pieces, that of the nearest power, of two the smaller."""
    shared = picked.sparkSession.sparkContext.broadcast((langs, centroids, idf))

    def measure(batches):
        import pyarrow as pa

        names, every, weights = shared.value
        for part in rows(batches, "lang", "text"):
            for at in range(0, len(part), 32):
                pieces = [(lang, p) for lang, t in part[at : at + 32] for p in (*(t[:c] for c in CUTS if c < len(t)), t)]
                counts = ngram_counts([p for _, p in pieces])
                cosines = _cosines(counts, weights, every)
                own = np.array([[lang == name for name in names] for lang, _ in pieces])
                near = np.where(own, cosines, -1).max(axis=1, initial=-1)
                keep = counts.any(axis=1) & (near >= 0)
                yield pa.RecordBatch.from_arrays([pa.array([lang for (lang, _), k in zip(pieces, keep, strict=True) if k], pa.string()), pa.array(powers(counts)[keep].astype(np.int32)), pa.array(near[keep].astype(np.float64))], names=["lang", "power", "near"])

    tails = mapped(picked.select("lang", "text"), measure, "lang string, power int, near double").groupBy("lang", "power").agg(F.count("*").alias("n"), F.percentile("near", F.lit(TAIL)).alias("tail")).collect()  # POWERS rows a language
    out = np.zeros((len(langs), POWERS))
    for k, lang in enumerate(langs):
        own = [r for r in tails if r["lang"] == lang]
        known = {r["power"]: r["tail"] for r in own if r["n"] >= ENOUGH} or {r["power"]: r["tail"] for r in own}
        for power in range(POWERS if known else 0):
            out[k, power] = SLACK * known[min(known, key=lambda x: (abs(x - power), x))]
    return out


def held_out() -> Column:
    """Rows that training never sees: crc32 of doc_id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def predictions(docs: DataFrame, model: Model) -> DataFrame:
    """docs' columns and lang_pred, score and rejected of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        known = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                lang, score, rejected = zip(*known.predict(part.column("text").to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=[*part.schema.names, "lang_pred", "score", "rejected"])

    schema = StructType([*docs.schema.fields, *StructType.fromDDL("lang_pred string, score double, rejected boolean").fields])
    return mapped(docs, run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every row; learned from the rows that aren't held out."""
    model = fit(docs.filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    return predictions(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text"), model).drop("text")


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose language is recognised."""
    model = fit(docs.filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    kept = docs.withColumns({f"_oc_{k}": F.col(c) for k, c in enumerate(docs.columns)}).select(*(f"_oc_{k}" for k in range(len(docs.columns))), F.col("text").alias("text"))
    out = predictions(kept, model).filter(~F.col("rejected"))
    return out.select(*(F.col(f"_oc_{k}").alias(c) for k, c in enumerate(docs.columns)))
