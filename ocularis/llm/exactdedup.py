"""Exact deduplication by composable polynomial fingerprints, confirmed chunk by chunk.

A text is its UTF-8 bytes with A-Z in lower case. The fingerprint of bytes b_0 .. b_(n-1) is the value
of the polynomial sum b_i r^(n-1-i) modulo 2^61 - 1 for two bases r, beside the length n. It composes:
f(AB) = f(A) r^|B| + f(B). So a text over ``HUGE`` bytes is cut into chunks, other tasks hash these,
each chunk's hash is shifted by the number of bytes after it, and a sum modulo the prime joins them; shorter texts are hashed where
they are read. Only lengths, fingerprints and ids are grouped.

Documents with equal fingerprints then meet their texts: the chunks of a group are sorted by place and
document and each is compared, byte by byte, with the one before; nothing larger than a chunk is
held. Groups that differ somewhere (a collision) are grouped again by the bytes of their chunks,
so the result is exact whatever the fingerprints do. A group of over 1/256 of all rows is dealt to several shares, each
compared within itself and then by its first document; there are at most 256 such groups and 512 shares.

Of equal texts the row with the largest doc_id stays.

Defined cases: a null text is empty; a null doc_id is below all others; of equal rows with one doc_id
exactly one stays; an empty table gives an empty result; other columns stay in ``unique`` and don't matter otherwise.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped, rows, written

PRIME = (1 << 61) - 1
#: Two bases of the polynomials: any numbers below the prime will do.
BASES = (0x1B873593CC9E2D51 % PRIME, 0x0C2B2AE3D27D4EB4 % PRIME)
#: Bytes of a chunk, and of a text from which its chunks are hashed in tasks of their own.
CHUNK, HUGE = 1 << 18, 1 << 22
#: A group of over 1/SHARES of all rows is dealt out.
SHARES = 256
_BLOCK = 1 << 12
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_KEY = ["size", "f1", "f2"]


class Hasher:
    """Polynomial hashes of bytes modulo a prime below 2^61; combine and shift are exact."""

    def __init__(self, prime: int = PRIME, bases: tuple[int, int] = BASES) -> None:
        import numpy as np

        self.prime, self.bases = prime, [b % prime for b in bases]
        powers = []
        for base in self.bases:
            p = [1]
            while len(p) < _BLOCK:
                p.append(p[-1] * base % prime)
            powers += [[x & 0x7FFFFFFF for x in reversed(p)], [x >> 31 for x in reversed(p)]]
        self.powers = np.array(powers, np.float64).T.copy()  # sums of 2^12 products below 2^39 are exact
        self.step = [pow(b, _BLOCK, prime) for b in self.bases]

    def hash(self, data: bytes) -> tuple[int, int]:
        """Values of both polynomials; blocks are products with a table of powers, joined from left to right."""
        import numpy as np

        head = len(data) % _BLOCK
        f1 = f2 = 0
        array = np.frombuffer(data, np.uint8)
        if head:
            low1, high1, low2, high2 = map(int, array[:head].astype(np.float64) @ self.powers[_BLOCK - head :])
            f1, f2 = ((high1 << 31) + low1) % self.prime, ((high2 << 31) + low2) % self.prime
        if len(data) > head:
            for low1, high1, low2, high2 in (array[head:].reshape(-1, _BLOCK).astype(np.float64) @ self.powers).astype(np.int64).tolist():
                f1 = (f1 * self.step[0] + (high1 << 31) + low1) % self.prime
                f2 = (f2 * self.step[1] + (high2 << 31) + low2) % self.prime
        return f1, f2

    def shifted(self, f: tuple[int, int], after: int) -> tuple[int, int]:
        """What f adds to the fingerprint of a text in which that many bytes follow."""
        return tuple(x * pow(b, after, self.prime) % self.prime for x, b in zip(f, self.bases, strict=True))

    def combined(self, left: tuple[int, int], right: tuple[int, int], right_size: int) -> tuple[int, int]:
        """The fingerprint of two texts one after the other."""
        return tuple((x + y) % self.prime for x, y in zip(self.shifted(left, right_size), right, strict=True))


def normalised(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)


_PIECE = "serial long, doc_id long, size long, f1 long, f2 long, sha binary, at int, after long, content binary"


def _pieces(docs: DataFrame, prime: int, chunk: int, huge: int, contents: bool = False, digests: bool = True) -> DataFrame:
    """Rows of _PIECE. Without contents: one row with a fingerprint for a text up to huge bytes, rows of chunks without one for longer texts. With: all chunks of all texts, with fingerprints."""

    def run(batches):
        import pyarrow as pa

        hasher = Hasher(prime)
        schema = pa.schema([("serial", pa.int64()), ("doc_id", pa.int64()), ("size", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("sha", pa.binary()), ("at", pa.int32()), ("after", pa.int64()), ("content", pa.binary())])

        def chunks(data: bytes):
            return ((k, max(0, len(data) - (k + 1) * chunk), data[k * chunk : (k + 1) * chunk]) for k in range(max(1, -(-len(data) // chunk))))

        out, held = [], 0
        for part in rows(batches, "serial", "doc_id", "text"):
            for serial, doc, text in part:
                data = normalised(text)
                head = (serial, doc, len(data))
                if contents:
                    f = hasher.hash(data)
                    sha = hashlib.sha256(data).digest() if digests else None
                    each = ((*head, *f, sha, k, after, piece) for k, after, piece in chunks(data))
                elif len(data) <= huge:
                    each = iter([(*head, *hasher.hash(data), hashlib.sha256(data).digest(), 0, 0, None)])
                else:
                    sha = hashlib.sha256(data).digest()
                    each = ((*head, None, None, sha, k, after, piece) for k, after, piece in chunks(data))
                for row in each:
                    out.append(row)
                    held += len(row[-1] or b"") + 64
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                        out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    keyed = docs.select(F.monotonically_increasing_id().alias("serial"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return mapped(keyed, run, _PIECE)


def _joined_chunks(pieces: DataFrame, prime: int) -> DataFrame:
    """One row with a fingerprint for each text in chunks: hashed in parallel, shifted, summed."""

    def run(batches):
        import pyarrow as pa

        hasher = Hasher(prime)
        for batch in batches:
            found = [hasher.shifted(hasher.hash(c), a) for c, a in zip(batch.column("content").to_pylist(), batch.column("after").to_pylist(), strict=True)]
            rest = [batch.column(c) for c in ("serial", "doc_id", "size", "sha")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["serial", "doc_id", "size", "sha", "s1", "s2"])

    dealt = pieces.filter("content is not null").repartition("serial", "at")
    hashed = mapped(dealt, run, "serial long, doc_id long, size long, sha binary, s1 long, s2 long")
    total = lambda c: (F.sum(F.col(c).cast("decimal(20,0)")) % F.lit(prime).cast("decimal(20,0)")).cast("long")
    return hashed.groupBy("serial", "doc_id", "size").agg(total("s1").alias("f1"), total("s2").alias("f2"), F.first("sha").alias("sha"))


def fingerprints(docs: DataFrame, prime: int = PRIME, chunk: int = CHUNK, huge: int = HUGE) -> DataFrame:
    """serial, doc_id, size, f1, f2 and sha (SHA-256) of the normalised text of every row."""
    pieces = written(_pieces(docs, prime, chunk, huge), "exact-pieces")
    columns = ["serial", "doc_id", *_KEY, "sha"]
    return pieces.filter("f1 is not null").select(columns).unionByName(_joined_chunks(pieces, prime).select(columns))


def _shared(df: DataFrame, large: DataFrame) -> DataFrame:
    """df with share, 0 but for members of large groups (at most SHARES rows), whose rows are dealt over their shares."""
    named = large.select(*(F.col(c).alias(f"_l_{c}") for c in _KEY), "shares")
    on = [F.col(c) == F.col(f"_l_{c}") for c in _KEY]
    joined = df.join(F.broadcast(named), on, "left")
    return joined.withColumn("share", F.when(F.col("shares").isNull(), 0).otherwise(F.pmod(F.xxhash64("serial"), "shares"))).drop(*(f"_l_{c}" for c in _KEY), "shares")


def _differing(docs: DataFrame, groups: DataFrame, large: DataFrame, prime: int, chunk: int) -> DataFrame:
    """Keys of the groups whose texts aren't all equal."""
    chunks = _shared(_pieces(docs, prime, chunk, 0, contents=True, digests=False).drop("sha", "after"), large)
    dealt = groups.select(*_KEY, "shares", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    members = chunks.join(dealt.hint("shuffle_merge"), [*_KEY, "share"])
    before = F.lag("content").over(Window.partitionBy(*_KEY, "share", "at").orderBy("serial"))
    seen = members.select(*_KEY, "at", "share", "shares", "content", before.alias("before"))
    odd = seen.filter("(before is null and shares > 1) or content != before").select(*_KEY, "at", "share", F.col("before").isNotNull().alias("differs"), F.when(F.col("before").isNull(), F.col("content")).alias("content"))
    odd = written(odd, "exact-odd")
    firsts = odd.filter("not differs").withColumn("before", F.lag("content").over(Window.partitionBy(*_KEY, "at").orderBy("share")))
    return odd.filter("differs").select(_KEY).unionByName(firsts.filter("content != before").select(_KEY)).distinct()


def _told_apart(docs: DataFrame, bad: DataFrame, prime: int, chunk: int) -> DataFrame:
    """The rows of the keys in bad with a class, equal for equal texts and for no others: chunks are grouped by their bytes."""
    chunks = written(_pieces(docs, prime, chunk, 0, contents=True).join(bad, _KEY, "left_semi"), "exact-collisions")
    kinds = chunks.groupBy(*_KEY, "at", "content").agg(F.min("serial").alias("kind"))
    marked = chunks.join(kinds, [*_KEY, "at", "content"]).groupBy("serial", "doc_id", *_KEY)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("at", "kind"))), lambda s: s["kind"])
    return marked.agg(F.first("sha").alias("sha"), F.to_json(listed).alias("class"))


def groups(docs: DataFrame, prime: int = PRIME, chunk: int = CHUNK, huge: int = HUGE) -> DataFrame:
    """doc_id, keep_id, group_size, kept, size and sha of every row; prime, chunk and huge change how, not what."""
    prints = written(fingerprints(docs, prime, chunk, huge), "exact-prints").withColumn("class", F.lit(""))
    order = F.struct(F.col("doc_id").isNotNull().alias("n"), "doc_id", "serial")

    def grouped(of: DataFrame) -> DataFrame:
        sums = of.groupBy(*_KEY, "class").agg(F.count("*").alias("group_size"), F.max(order).alias("keep")).filter("group_size > 1")
        return written(sums.crossJoin(F.broadcast(of.agg(F.count("*").alias("n")))).withColumn("shares", F.ceil(F.col("group_size") * SHARES / F.col("n"))).drop("n"), "exact-groups")

    found = grouped(prints)
    large = lambda of: of.filter("shares > 1").groupBy(_KEY).agg(F.max("shares").cast("int").alias("shares"))
    bad = written(_differing(docs, found, large(found), prime, chunk), "exact-bad")
    if not bad.isEmpty():
        classes = written(_told_apart(docs, bad, prime, chunk), "exact-classes")
        prints = prints.join(bad, _KEY, "left_anti").unionByName(classes)
        found = grouped(prints)
    big = large(found)
    over = found.drop("shares").join(F.broadcast(big), _KEY, "left").withColumn("share", F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1))).drop("shares")
    joined = _shared(prints, big).join(over, [*_KEY, "class", "share"], "left")
    keep = F.coalesce("keep", order)
    return joined.select("doc_id", keep["doc_id"].alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), (keep["serial"] == F.col("serial")).alias("kept"), "size", "sha")


def unique(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, all columns: those with a kept doc_id and text, one of each set of equal rows with one doc_id."""
    kept = groups(docs.select("doc_id", "text")).filter("kept").select(F.col("doc_id").alias("_oc_d"), F.col("sha").alias("_oc_s"))
    lower = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    keyed = docs.withColumn("_oc_h", F.unhex(F.sha2(lower, 256)))
    met = keyed.join(kept, F.col("doc_id").eqNullSafe(F.col("_oc_d")) & (F.col("_oc_h") == F.col("_oc_s")), "left_semi")
    return met.dropDuplicates(["doc_id", "_oc_h"]).select(*docs.columns)


def report(docs: DataFrame, prime: int = PRIME, chunk: int = CHUNK, huge: int = HUGE) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row."""
    found = groups(docs.select("doc_id", "text"), prime, chunk, huge)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))
