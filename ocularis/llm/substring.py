"""Substring deduplication of windows of words, with a count-min prefilter.

A word goes if it lies in a window of ``WINDOW`` words that also starts in a document with a smaller
doc_id. Every window has an anchor, the smallest hash of its ``GRAM``-word grams, which its copies
share; a run is a stretch of windows of one document with one anchor.

1. One pass over the texts gives the runs, as slices: a row for the runs of some documents.
2. Each slice counts its anchors in a count-min sketch of ``DEPTH`` rows and sends the cells that it
   touched, cell range by cell range. Where a range's counts meet they are added up: a cell's sum is
   at least the number of documents with any anchor that falls there, so at least that of any window
   with that anchor. Each slice gets back a bit for each cell that it sent: two or more. The sketch
   has as many cells as the input asks for and is never in one place.
3. Runs whose anchor is estimated in two documents or more pass. Those that agree in all words are
   grouped exactly: all but the first document's lose all their windows. Where an anchor has several
   different runs, the windows of each one's first document go through a sketch of their own, and
   those estimated twice are grouped exactly, one by one.

Windows and runs are compared by their anchor and a second 64-bit hash, 128 bits together. What rows
are joined with is a written table, so that the rows of a hot key can be split over tasks.

Defined cases: a null text has no words; texts of fewer words than a window lose none; rows with
one doc_id are one document, none smaller than the other; a null doc_id is larger than all others,
and null ones are equal; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, rows, written

WINDOW, GRAM = 50, 12
DEPTH, CELLS_EACH, LEAST_BITS = 2, 8, 18
#: Least and largest powers of two of cells in a range, and of the ranges of a row until these are the largest.
_RANGE_BITS, _RANGES_BITS = (18, 26), 12
#: Hashes at which a slice ends.
_SLICE = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_hashes: dict[bytes, int] = {}


def _mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = x ^ np.uint64(salt)
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    known, digest = _hashes, xxhash.xxh64_intdigest
    if len(known) > 400_000:
        known.clear()
    out = []
    for w in words:
        h = known.get(w)
        if h is None:
            h = digest(w, 7)
            if len(w) <= 64:
                known[w] = h
        out.append(h)
    return np.array(out, dtype=np.uint64)


class _Powers:
    """Powers of the base and of its inverse, as far as they were asked for."""

    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 2 * len(cls.up))
            cls.up = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, _BASE, dtype=np.uint64))])
            cls.down = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, _BASE_INVERSE, dtype=np.uint64))])
        return cls.up, cls.down


def _prefix(words: np.ndarray) -> np.ndarray:
    """Running sums from which the hash of any span follows."""
    up, _ = _Powers.to(len(words) + 1)
    return np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(words * up[: len(words)], dtype=np.uint64)])


def _span_hashes(sums: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    _, down = _Powers.to(len(sums))
    return (sums[stop] - sums[first]) * down[first]


def _smallest(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each width neighbours, by doubling."""
    have = 1
    while have * 2 <= width:
        x, have = np.minimum(x[:-have], x[have:]), have * 2
    rest = width - have
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def runs(text: str | None, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """Anchor, first window and number of windows of each run of a text, and its running sums; None for a text without windows."""
    words = (text or "").encode().split()
    if len(words) < window:
        return None
    sums = _prefix(_word_hashes(words))
    at = np.arange(len(words) - gram + 1)
    anchors = _smallest(_mixed(_span_hashes(sums, at, at + gram)), window - gram + 1)
    first = np.concatenate([[0], np.flatnonzero(anchors[1:] != anchors[:-1]) + 1])
    return anchors[first], first, np.diff(np.concatenate([first, [len(anchors)]])), sums


def _cells(anchors: np.ndarray, bits: int) -> list[np.ndarray]:
    return [_mixed(anchors, 0x5851F42D4C957F2D * (d + 1) & (1 << 64) - 1) >> np.uint64(64 - bits) for d in range(DEPTH)]


#: A slice: documents, the number of runs of each, and for each run its anchor, the hash of its words, its first window, its
#: number of windows and, where they are asked for, the hashes of these.
_SLICE_SCHEMA = "slice long, doc_ids array<long>, ths array<long>, runs array<int>, anchors binary, wholes binary, firsts binary, sizes binary, windows binary"
_RUN_COLUMNS = {"anchors": np.uint64, "wholes": np.uint64, "firsts": np.int32, "sizes": np.int32}


class _Slices:
    """Gathers documents' runs into slices with numbers of their own."""

    def __init__(self):
        from pyspark import TaskContext

        self.number = TaskContext.get().partitionId() << 32
        self._begin()

    def _begin(self) -> None:
        self.docs: list[tuple] = []
        self.parts: dict[str, list[np.ndarray]] = {c: [] for c in (*_RUN_COLUMNS, "windows")}
        self.held = 0

    def add(self, doc_id: int | None, th: int, windows: np.ndarray | None = None, **runs: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.docs.append((doc_id, th, len(runs["anchors"])))
        for c, x in runs.items():
            self.parts[c].append(x.astype(_RUN_COLUMNS[c]))
        if windows is not None:
            self.parts["windows"].append(windows.astype(np.uint64))
        self.held += len(runs["anchors"] if windows is None else windows)
        if self.held >= _SLICE:
            yield from self.close()

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.docs:
            d, t, n = zip(*self.docs, strict=True)
            packed = {c: b"".join(x.tobytes() for x in parts) for c, parts in self.parts.items()}
            columns = [pa.array([self.number], pa.int64()), pa.array([list(d)], pa.list_(pa.int64())), pa.array([list(t)], pa.list_(pa.int64())), pa.array([list(n)], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array([x], pa.binary()) for x in packed.values())], names=["slice", "doc_ids", "ths", "runs", *packed])
            self.number += 1
        self._begin()


def _unpacked(row: dict) -> dict[str, np.ndarray]:
    """The run columns of a slice, with the place of each run's document."""
    out = {c: np.frombuffer(row[c], dtype=kind) for c, kind in _RUN_COLUMNS.items()}
    return out | {"windows": np.frombuffer(row["windows"], dtype=np.uint64), "doc": np.repeat(np.arange(len(row["runs"])), row["runs"])}


def _counted(row: dict, windows: bool) -> tuple[np.ndarray, np.ndarray]:
    """The different hashes of a slice and how often each counts: a window as often as it is there, an anchor once a document."""
    runs = _unpacked(row)
    if windows:
        return np.unique(runs["windows"], return_counts=True)
    order = np.lexsort((runs["anchors"], runs["doc"]))
    anchors, doc = runs["anchors"][order], runs["doc"][order]
    new = np.concatenate([[True], (anchors[1:] != anchors[:-1]) | (doc[1:] != doc[:-1])]) if len(anchors) else np.zeros(0, dtype=bool)
    return np.unique(anchors[new], return_counts=True)


def _ranges(hashes: np.ndarray, bits: int, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each range of cells, over all rows of the sketch: its number, the hashes' cells there and the places of these hashes."""
    for d, cells in enumerate(_cells(hashes, bits)):
        order = np.argsort(cells, kind="stable")
        cells = cells[order]
        where = (cells >> np.uint64(width)).astype(np.int64)
        for at in np.split(np.arange(len(cells)), np.flatnonzero(np.diff(where)) + 1):
            if len(at):
                yield (d << (bits - width)) + int(where[at[0]]), (cells[at] & np.uint64((1 << width) - 1)).astype("<u4"), order[at]


def estimated_twice(slices: DataFrame, expected: int, windows: bool, emit: Callable[[dict, np.ndarray], dict[str, pa.Array]], schema: str) -> DataFrame:
    """What emit(slice, mask) gives for each slice, mask telling which of its anchors or windows the sketch counts twice or more; slices is read twice."""
    bits = max(LEAST_BITS, math.ceil(math.log2(max(1, expected) * CELLS_EACH)))
    width = min(bits, max(_RANGE_BITS[0], min(_RANGE_BITS[1], bits - _RANGES_BITS)))

    def touched(batches):
        for (row,) in ([x] for b in batches for x in b.to_pylist()):
            hashes, counts = _counted(row, windows)
            out = [(k, cells.tobytes(), np.minimum(counts[at], 2).astype(np.uint8).tobytes()) for k, cells, at in _ranges(hashes, bits, width)]
            if out:
                k, cells, n = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array([row["slice"]] * len(k), pa.int64()), pa.array(cells, pa.binary()), pa.array(n, pa.binary())], names=["range", "slice", "cells", "counts"])

    def answered(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, asked = np.zeros(1 << width, dtype=np.uint8), []
        for batch in batches:
            for s, cells, counts in zip(*(batch.column(c).to_pylist() for c in ("slice", "cells", "counts")), strict=True):
                at, n = np.frombuffer(cells, dtype="<u4"), np.frombuffer(counts, dtype=np.uint8)
                np.add.at(sums, at, n)
                sums[at] = np.minimum(sums[at], 2)
                asked.append((s, at))
        for first in range(0, len(asked), 1024):
            part = asked[first : first + 1024]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in part], pa.int64()), pa.array([key[0].as_py()] * len(part), pa.int64()), pa.array([np.packbits(sums[at] >= 2, bitorder="little").tobytes() for _, at in part], pa.binary())], names=["slice", "range", "bits"])

    def passed(left: pa.Table, right: pa.Table) -> pa.Table:
        (row,) = left.to_pylist()
        answers = dict(zip(right.column("range").to_pylist(), right.column("bits").to_pylist(), strict=True))
        hashes, _ = _counted(row, windows)
        keep = np.ones(len(hashes), dtype=bool)
        for k, cells, at in _ranges(hashes, bits, width):
            keep[at] &= np.unpackbits(np.frombuffer(answers[k], dtype=np.uint8), count=len(cells), bitorder="little").astype(bool)
        own = _unpacked(row)["windows" if windows else "anchors"]
        return pa.table(emit(row, keep[np.searchsorted(hashes, own)] if len(hashes) else np.zeros(0, dtype=bool)))

    asked = mapped(slices, touched, "range long, slice long, cells binary, counts binary")
    replies = asked.groupBy("range").applyInArrow(answered, "slice long, range long, bits binary")
    return slices.groupBy("slice").cogroup(replies.groupBy("slice")).applyInArrow(passed, schema)


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x, pa.int64())


def _of_docs(row: dict, column: str, doc: np.ndarray) -> pa.Array:
    return pa.array(row[column], pa.int64()).take(pa.array(doc))


def repeated_runs(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, th, anchor, run (hash of all its words), first and n of each run whose anchor is estimated in two documents."""

    def slice_up(batches):
        slices = _Slices()
        for part in rows(batches, "doc_id", "th", "text"):
            for doc_id, th, text in part:
                if found := runs(text, window, gram):
                    anchors, first, n, sums = found
                    whole = _mixed(_span_hashes(sums, first, first + n + window - 1), 3) ^ _mixed(n.astype(np.uint64))
                    yield from slices.add(doc_id, th, anchors=anchors, wholes=whole, firsts=first, sizes=n)
        yield from slices.close()

    table = written(mapped(docs, slice_up, _SLICE_SCHEMA), "substring-slices")
    expected = table.agg(F.sum(F.octet_length("anchors") / 8)).first()[0] or 0

    def emit(row: dict, mask: np.ndarray) -> dict[str, pa.Array]:
        r = _unpacked(row)
        doc = r["doc"][mask]
        return {"doc_id": _of_docs(row, "doc_ids", doc), "th": _of_docs(row, "ths", doc), "anchor": _longs(r["anchors"][mask]), "run": _longs(r["wholes"][mask]), "first": pa.array(r["firsts"][mask], pa.int32()), "n": pa.array(r["sizes"][mask], pa.int32())}

    return estimated_twice(table, int(expected), False, emit, "doc_id long, th long, anchor long, run long, first int, n int")


#: Null ids come after all others.
_LAST = 2**63 - 1


def repeated_windows(docs: DataFrame, owned: DataFrame, window: int = WINDOW) -> DataFrame:
    """id, th, anchor, hash and first of the windows of runs (doc_id, th, anchor, first, n) that are estimated twice."""
    of_doc = owned.groupBy("doc_id", "th").agg(F.collect_list(F.struct("anchor", "first", "n")).alias("_runs")).select(F.col("doc_id").alias("_d"), F.col("th").alias("_h"), "_runs")
    # rows with one id and one text are one document
    texts = docs.join(of_doc, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_h"))).select("doc_id", "th", "text", "_runs.anchor", "_runs.first", "_runs.n")

    def slice_up(batches):
        slices = _Slices()
        for part in rows(batches, "doc_id", "th", "text", "anchor", "first", "n"):
            for doc_id, th, text, anchor, first, n in part:
                sums = _prefix(_word_hashes((text or "").encode().split()))
                first, n = np.array(first, dtype=np.int64), np.array(n, dtype=np.int64)
                starts = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                each = _mixed(_span_hashes(sums, starts, starts + window), 5)
                yield from slices.add(doc_id, th, windows=each, anchors=np.array(anchor, dtype=np.int64).view(np.uint64), wholes=np.zeros(len(n), dtype=np.uint64), firsts=first, sizes=n)
        yield from slices.close()

    table = written(mapped(texts, slice_up, _SLICE_SCHEMA), "substring-open")
    expected = table.agg(F.sum(F.octet_length("windows") / 8)).first()[0] or 0

    def emit(row: dict, mask: np.ndarray) -> dict[str, pa.Array]:
        r = _unpacked(row)
        n = r["sizes"].astype(np.int64)
        run = np.repeat(np.arange(len(n)), n)
        start = (np.repeat(r["firsts"].astype(np.int64), n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))[mask]
        run = run[mask]
        doc = r["doc"][run]
        return {"doc_id": _of_docs(row, "doc_ids", doc), "th": _of_docs(row, "ths", doc), "anchor": _longs(r["anchors"][run]), "hash": _longs(r["windows"][mask]), "first": pa.array(start.astype(np.int32), pa.int32())}

    found = estimated_twice(table, int(expected), True, emit, "doc_id long, th long, anchor long, hash long, first int")
    return found.select(F.coalesce("doc_id", F.lit(_LAST)).alias("id"), "th", "anchor", "hash", "first")


def removed_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, th (hash of the text), first and stop: word spans to remove; spans may overlap."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    found = written(repeated_runs(docs, window, gram), "substring-runs").withColumn("id", F.coalesce("doc_id", F.lit(_LAST)))
    firsts = written(found.groupBy("anchor", "run").agg(F.min("id").alias("owner")), "substring-firsts")
    owned = found.join(firsts, ["anchor", "run"])
    whole = owned.filter("owner < id").select("doc_id", "th", "first", (F.col("first") + F.col("n") + window - 1).alias("stop"))
    several = written(firsts.groupBy("anchor").agg(F.count("*").alias("c")).filter("c > 1").select("anchor"), "substring-several")
    open_runs = owned.filter("owner = id").join(several, "anchor", "left_semi").select("doc_id", "th", "anchor", "first", "n")
    own = written(repeated_windows(docs, open_runs.distinct(), window), "substring-windows")
    earliest = written(own.groupBy("anchor", "hash").agg(F.min("id").alias("owner"), F.max("id").alias("other")).filter("owner < other").drop("other"), "substring-earliest")
    single = own.join(earliest, ["anchor", "hash"]).filter("owner < id").select(F.nullif("id", F.lit(_LAST)).alias("doc_id"), "th", "first")
    return whole.unionByName(single.select("doc_id", "th", "first", (F.col("first") + window).alias("stop")))


def _kept(words: list[bytes], firsts: list[int], stops: list[int]) -> tuple[bytes, int]:
    """The words outside the spans, joined by spaces, and the number inside."""
    depth = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(depth, firsts, 1)
    np.add.at(depth, stops, -1)
    inside = np.cumsum(depth[:-1]) > 0
    return b" ".join([w for w, gone in zip(words, inside.tolist(), strict=True) if not gone]), int(inside.sum())


def deduplicated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row, and with texts kept, its remaining words."""
    spans = removed_spans(docs, window, gram).groupBy("doc_id", "th").agg(F.collect_set(F.struct("first", "stop")).alias("spans")).select(F.col("doc_id").alias("d"), F.col("th").alias("h"), "spans.first", "spans.stop")
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    joined = every.join(written(spans, "substring-spans"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h")), "left").select("doc_id", "text", "first", "stop")

    def cut(batches):
        for part in rows(batches, "doc_id", "text", "first", "stop"):
            made = []
            for doc_id, text, first, stop in part:
                words = (text or "").encode().split()
                kept, n = _kept(words, first, stop) if first else (b" ".join(words), 0)
                made.append((doc_id, len(words), n, hashlib.sha256(kept).hexdigest(), *([kept.decode()] if texts else [])))
            cols = list(zip(*made, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=False)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"][: len(cols)])

    return mapped(joined, cut, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts)
