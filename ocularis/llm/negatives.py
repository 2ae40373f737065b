"""Hard negatives by exact integer scores with the method of the Four Russians.

Components become integers, floor(256 x). A candidate's integers are cut into bit planes, and in each
plane the bits of eight dimensions make a byte; an anchor has, for each eight dimensions, a table of the
sums of all 256 subsets of its components. A score is then a sum of table entries, looked up by
the bytes and shifted by their planes (the highest plane counts negative), and is the whole
inner product: nothing is estimated and no candidate is left out.

Candidates and anchors are packed into blocks; a few blocks of candidates make a slab. Every
block of anchors meets every slab by an equi-join of block numbers, and the rows of a pair of blocks
never exist as rows: a block is scored in a task and only the best five of each anchor leave it. First,
slabs of one label meet anchors of that label and give the positives; then all slabs meet all
anchors, which carry their positives' scores as limits, and give the negatives.

Defined cases: rows with a null label or vector or with a null or non-finite component take no part;
shorter vectors count as if filled up with zeros; a null vec_id is no anchor and comes last among equal scores; repeated
rows are rows of their own, as anchors, positives and negatives; equal scores and ids are in no order
(they give equal rows); no anchors, positives or negatives give no rows; other columns are ignored.
Components so large that scores and places don't fit 63 bits raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped, written

SCALE, EVERY, POSITIVES, NEGATIVES = 256, 100, 5, 5
#: Negatives score between LOW percent of the positive's score and all of it.
LOW = 80
#: Candidates of a block, blocks of a slab, anchors of a block.
BLOCK, SLAB, ANCHORS = 2048, 8, 512
#: Candidates that are scored at a time; blocks have fewer than 2^_PLACE.
_STRIP, _PLACE = 128, 11


def _relabelled(label: Column, vec_id: Column) -> Column:
    return F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)


def prepared(vectors: DataFrame) -> DataFrame:
    """serial, vec_id, label and parts (integers) of the rows that take part, as a table of its own."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    fit = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(2.0**40)))
    beyond = F.coalesce(F.exists(x, lambda v: ~F.isnan(v) & (F.abs(v) >= F.lit(2.0**40)) & (F.abs(v) != F.lit(float("inf")))), F.lit(False))
    good = F.when(beyond, F.raise_error(F.lit("components are too large for exact scores"))).otherwise(fit)
    vec_id = F.col("vec_id").cast("long")
    kept = vectors.filter(good.cast("boolean")).select(F.monotonically_increasing_id().alias("serial"), vec_id.alias("vec_id"), _relabelled(F.col("label").cast("long"), vec_id).alias("label"), F.transform(x, lambda v: F.floor(v * SCALE)).alias("parts"))
    return written(kept, "negatives-vectors")


class Shape:
    """Dimensions, bit planes and number types that hold all vectors of a table."""

    def __init__(self, size: int, low: int, high: int) -> None:
        self.groups = max(1, -(-size // 8))
        self.most = max(abs(low), abs(high), 1)
        self.planes = max((-low - 1).bit_length() if low < 0 else 0, high.bit_length()) + 1
        if 8 * self.groups * self.most**2 >= 1 << (62 - _PLACE):
            raise ValueError("components are too large for exact scores")
        sums = 8 * self.groups * self.most
        self.kind = "int16" if sums < 1 << 15 else "int32" if sums < 1 << 31 else "int64"

    def array(self, parts: list[list[int]]):
        import numpy as np

        out = np.zeros((len(parts), 8 * self.groups), np.int64)
        for row, values in zip(out, parts, strict=True):
            row[: len(values)] = values
        return out

    def packed(self, array):
        """Bytes of bit planes: rows x planes x groups; bit k of a byte is that of the k-th of its eight dimensions."""
        import numpy as np

        bits = (array[:, None, :] >> np.arange(self.planes)[None, :, None]) & 1
        return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little")

    def tables(self, array):
        """Subset sums of each eight components: groups x 256 x rows."""
        import numpy as np

        parts = array.reshape(len(array), self.groups, 8).astype(self.kind).transpose(1, 2, 0)
        out = np.zeros((self.groups, 256, len(array)), self.kind)
        for k in range(8):
            out[:, 1 << k : 2 << k] = out[:, : 1 << k] + parts[:, k, None]
        return out

    def scores(self, tables, packed):
        """Exact inner products, candidates x anchors: table rows looked up by bytes, added over groups, shifted by planes."""
        import numpy as np

        total = np.zeros((len(packed), tables.shape[2]), np.int64)
        for plane in range(self.planes):
            found = tables[0].take(packed[:, plane, 0], axis=0)
            for group in range(1, self.groups):
                found += tables[group].take(packed[:, plane, group], axis=0)
            if plane < self.planes - 1:
                total += found.astype(np.int64) << plane
            else:
                total -= found.astype(np.int64) << plane
        return total


def shape_of(vectors: DataFrame) -> tuple[Shape, int]:
    """The shape of a prepared table and its number of anchors, from one aggregate."""
    row = vectors.agg(F.max(F.array_size("parts")), F.min(F.array_min("parts")), F.max(F.array_max("parts")), F.count_if(F.col("vec_id") % EVERY == 0)).first()
    return Shape(row[0] or 0, row[1] or 0, row[2] or 0), row[3]


_CANDIDATES = "slab string, label long, n int, serials binary, ids binary, known binary, labels binary, planes binary"


def candidate_blocks(vectors: DataFrame, shape: Shape) -> DataFrame:
    """Blocks of candidates of one label, in order of vec_id (nulls last); SLAB blocks that follow each other have one slab."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        label, held, number = None, [], 0

        def block():
            held.sort(key=lambda r: (r[1] is None, r[1] or 0, r[0]))
            ids = np.array([r[1] or 0 for r in held], np.int64)
            planes = shape.packed(shape.array([r[3] for r in held]))
            columns = [f"{part}:{label}:{number // SLAB}", label, len(held), np.array([r[0] for r in held], np.int64).tobytes(), ids.tobytes(), np.array([r[1] is not None for r in held]).tobytes(), np.full(len(held), label, np.int64).tobytes(), planes.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int32(), *[pa.binary()] * 5), strict=True)], names=["slab", "label", "n", "serials", "ids", "known", "labels", "planes"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("serial", "vec_id", "label", "parts")), strict=True):
                if held and (row[2] != label or len(held) == BLOCK):
                    yield block()
                    held, number = [], number + 1 if row[2] == label else 0
                label = row[2]
                held.append(row)
        if held:
            yield block()

    ordered = vectors.repartitionByRange("label", "vec_id", "serial").sortWithinPartitions("label", "vec_id", "serial")
    return mapped(ordered, run, _CANDIDATES)


def anchor_blocks(anchors: DataFrame, number: int, within_label: bool) -> DataFrame:
    """block and members (an array of rows of anchors, about ANCHORS of them) by a hash; those of one label where within_label."""
    count = max(1, -(-number // ANCHORS))
    dealt = anchors.withColumn("block", F.pmod(F.xxhash64(F.lit(5), "serial"), F.lit(count)).cast("int"))
    by = ["label", "block"] if within_label else ["block"]
    return dealt.groupBy(*by).agg(F.collect_list(F.struct(*anchors.columns)).alias("members"))


def _best(arrays: list, groups: int, keep: int):
    """Of parallel arrays (group, score, place, ...), the rows with the highest scores of each group, ties by place."""
    import numpy as np

    group, score, place = arrays[:3]
    order = np.lexsort((place, -score, group))
    group = group[order]
    starts = np.searchsorted(group, np.arange(groups))
    kept = order[np.arange(len(order)) - starts[group] < keep]
    return [a[kept] for a in arrays]


def _run(shape: Shape, positives: bool):
    """The kernel over rows of (members, block of candidates): per anchor (and positive), the best of the rows that follow each other."""

    def strip(scores, first, labels, serials, a):
        import numpy as np

        same = labels[:, None] == a["label"][None, :]
        if positives:
            same &= serials[:, None] != a["serial"][None, :]
            if len(scores) > POSITIVES:
                # all scores at or above the fifth of the strip
                ranked = np.where(same, scores, np.iinfo(np.int64).min)
                same &= scores >= np.partition(ranked, len(scores) - POSITIVES, axis=0)[len(scores) - POSITIVES][None, :]
            place, anchor = np.nonzero(same)
            yield anchor, scores[place, anchor], place + first
            return
        near = ~same & (scores <= a["highest"][None, :]) & (100 * scores >= LOW * a["lowest"][None, :])
        place, anchor = np.nonzero(near)
        if not len(place):
            return
        score = scores[place, anchor]
        for k in range(POSITIVES):
            limit = a["limits"][anchor, k]
            fit = a["has"][anchor, k] & (LOW * limit <= 100 * score) & (score <= limit)
            yield anchor[fit] * POSITIVES + k, score[fit], place[fit] + first

    def anchors(members):
        import numpy as np

        column = lambda name: np.array([m[name] for m in members], np.int64)
        out = {"serial": column("serial"), "label": column("label"), "vec_id": column("vec_id"), "tables": shape.tables(shape.array([m["parts"] for m in members]))}
        if not positives:
            scores = [[p["score"] for p in m["positives"]] for m in members]
            out["limits"] = np.array([s + [0] * (POSITIVES - len(s)) for s in scores], np.int64)
            out["has"] = np.array([[k < len(s) for k in range(POSITIVES)] for s in scores])
            out["highest"], out["lowest"] = np.array([max(s) for s in scores], np.int64), np.array([min(s) for s in scores], np.int64)
        return out

    def kernel(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        now, a, best = None, None, None
        per, keep = (1, POSITIVES) if positives else (POSITIVES, NEGATIVES)

        def flush():
            group, score, _, serial, ids, known = best
            anchor = group // per
            arrays = [pa.array(a["serial"][anchor]), pa.array(a["vec_id"][anchor]), pa.array(group % per, pa.int32()), pa.array(score), pa.array(serial), pa.array(ids, mask=~known)]
            return pa.RecordBatch.from_arrays(arrays, names=["anchor", "anchor_id", "slot", "score", "serial", "vec_id"])

        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in ("run", "n", "serials", "ids", "known", "labels", "planes")}
                if row["run"].as_py() != now:
                    if best is not None and len(best[0]):
                        yield flush()
                    now, best = row["run"].as_py(), None
                    a = anchors(batch.column("members")[k].as_py())
                n = row["n"].as_py()
                array = lambda name, kind, row=row: np.frombuffer(row[name].as_buffer(), kind)
                planes = array("planes", np.uint8).reshape(n, shape.planes, shape.groups)
                serials, ids, known, labels = array("serials", np.int64), array("ids", np.int64), array("known", np.bool_), array("labels", np.int64)
                found = [s for at in range(0, n, _STRIP) for s in strip(shape.scores(a["tables"], planes[at : at + _STRIP]), at, labels[at : at + _STRIP], serials[at : at + _STRIP], a)]
                if not found:
                    continue
                group, score, place = (np.concatenate(x) for x in zip(*found, strict=True))
                # ids of a block ascend, unknown ones last: a place stands for an id, and across blocks the ids themselves do
                rank = np.where(known, ids, np.iinfo(np.int64).max)[place]
                new = [group, score, rank, serials[place], ids[place], known[place]]
                best = _best(new if best is None else [np.concatenate(x) for x in zip(best, new, strict=True)], len(a["serial"]) * per, keep)
        if best is not None and len(best[0]):
            yield flush()

    return kernel


def _scored(pairs: DataFrame, blocks: DataFrame, shape: Shape, positives: bool) -> DataFrame:
    """The best of each anchor (and positive): pairs has slab, run (a name for this pair of block and slab) and members; ties by vec_id."""
    met = pairs.join(blocks.drop("label"), "slab").select("run", "members", "n", "serials", "ids", "known", "labels", "planes")
    found = mapped(met, _run(shape, positives), "anchor long, anchor_id long, slot int, score long, serial long, vec_id long")
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "serial")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= (POSITIVES if positives else NEGATIVES))


def mined(vectors: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score; vectors: vec_id, embedding, label."""
    table = prepared(vectors)
    shape, number = shape_of(table)
    blocks = written(candidate_blocks(table, shape), "negatives-blocks")
    slabs = blocks.select("slab", "label").distinct()
    anchors = table.filter(F.col("vec_id") % EVERY == 0)
    own = anchor_blocks(anchors, number, True).join(slabs, "label").withColumn("run", F.concat_ws("/", "label", "block", "slab"))
    best = _scored(own, blocks, shape, True)
    ranked = F.transform(F.sort_array(F.collect_list(F.struct("rank", "score", "vec_id"))), lambda p: F.struct(p["score"].alias("score"), p["vec_id"].alias("vec_id")))
    positives = written(best.groupBy(F.col("anchor").alias("serial")).agg(ranked.alias("positives")), "negatives-positives")
    limited = anchor_blocks(anchors.join(positives, "serial"), number, False)
    count = max(1, -(-number // ANCHORS))
    every = slabs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).join(limited, "block").withColumn("run", F.concat_ws("/", "block", "slab"))
    negatives = _scored(every, blocks, shape, False).drop("serial")
    chosen = negatives.join(positives, negatives["anchor"] == positives["serial"]).withColumn("p", F.get("positives", F.col("slot")))
    return chosen.select("anchor_id", F.col("p.vec_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"))
