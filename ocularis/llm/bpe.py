"""BPE encoding and decoding of whole texts by tree concatenation.

A text of at most ``LONG`` characters is encoded in the task that reads it. A longer one is cut at
fixed places into leaves, which Spark deals over all tasks and encodes in parallel. The ids of
neighbouring leaves are then joined pairwise, as a tree: a window around each join is encoded again
and grows until its tokens agree with both sides, so that a cut inside a word leaves no trace.

The ids are those of the tokenizers library. For a vocabulary whose pre-tokenizer drops white space
and splits words in a known way, ids are memoised for each space-delimited chunk, as white space never
crosses a token, or for its pieces; the memo is bounded and kept for the life of the Python worker.
Other vocabularies are encoded text by text.

Defined cases: a null text is the empty text, which has no ids; repeated rows give repeated results;
a null doc_id is kept; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import mapped, rows

#: Characters of a leaf, and of the longest text that isn't cut.
LEAF, LONG = 32_768, 65_536
#: Entries of the memo, and the longest chunk that it takes.
MEMO, MEMO_CHARS = 500_000, 64
#: Characters of the first window on either side of a join, and the agreeing tokens that end its growth inside a word.
WINDOW, AGREE = 64, 8

_SAFE = re.compile(r"[!-~¡¿À-ÖØ-öø-įı-ɏ]*")
_SAFE_TEXT = re.compile(r"[ \n\t\r!-~¡¿À-ÖØ-öø-įı-ɏ]*")
_PIECES = re.compile(r"[^\W\d_]+|\d|'(?:s|t|re|ve|m|ll|d)|(?:[^\w\s]|_)+")
_encoders: dict[str, Encoder] = {}


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    """A tokenizers vocabulary with memos; ids are bytes of little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.tokens = [self.library.id_to_token(i) or "" for i in range(size)]
        spec = json.loads(self.library.to_str())
        steps = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        #: Whether white space is dropped, texts are lower-cased and words are split as _PIECES does.
        self.by_chunk = steps == ["NFC", "Replace", "Lowercase"] and split.get("behavior") == "Removed" and split.get("invert") is True and split["pattern"].get("Regex") == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        self.decoder = spec.get("decoder")
        self.letters = str.maketrans(_byte_letters())
        # two generations: what is used again moves from the old one to the young one, and the rest is dropped with it
        self.chunks: dict[str, bytes] = {"": b""}
        self.old_chunks: dict[str, bytes] = {}

    @staticmethod
    def packed(ids) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _remembered(self, chunk: str, ids: bytes) -> bytes:
        if len(chunk) <= MEMO_CHARS:
            if len(self.chunks) >= MEMO // 2:
                self.old_chunks, self.chunks = self.chunks, {"": b""}
            self.chunks[chunk] = ids
        return ids

    def _piece(self, piece: str) -> bytes:
        """Ids of one piece in lower case, by the memo or the vocabulary's merges."""
        if (ids := self.chunks.get(piece)) is not None:
            return ids
        if (ids := self.old_chunks.get(piece)) is None:
            ids = self.packed([t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))])
        return self._remembered(piece, ids)

    def _plain(self, chunk: str) -> bytes:
        """Ids of a chunk in lower case and safe letters."""
        if chunk.isalpha():
            return self._piece(chunk)
        if (ids := self.old_chunks.get(chunk)) is None:
            pieces = (chunk[:-1], chunk[-1]) if chunk[:-1].isalpha() else _PIECES.findall(chunk)
            ids = b"".join(map(self._piece, pieces))
        return self._remembered(chunk, ids)

    def _other(self, chunk: str) -> bytes:
        """Ids of any chunk; what isn't in lower case and safe letters has a key that no such chunk has."""
        if "<|" not in chunk and _SAFE.fullmatch(chunk):
            chunk = chunk.lower()
            return self.chunks.get(chunk) or self._plain(chunk)
        key = f" {chunk}"
        ids = self.chunks.get(key)
        if ids is None and (ids := self.old_chunks.get(key)) is None:
            ids = self.packed(self.library.encode(chunk, add_special_tokens=False).ids)
        return self._remembered(key, ids)

    def encode(self, text: str) -> bytes:
        if not self.by_chunk:
            return self.packed(self.library.encode(text, add_special_tokens=False).ids)
        # the memo grows, and may be replaced, while a text is encoded: look it up anew
        if "<|" not in text and _SAFE_TEXT.fullmatch(text):
            return b"".join([self.chunks.get(c) or self._plain(c) for c in text.lower().split()])
        return b"".join([self._other(c) for c in text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") if c])

    def decode(self, ids: bytes) -> str:
        listed = np.frombuffer(ids, dtype="<u4").tolist()
        if self.decoder is not None:
            return self.library.decode(listed, skip_special_tokens=False)
        return " ".join(map(self.tokens.__getitem__, listed))


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _spans(enc: Encoder, text: str) -> list[tuple[int, int, int]]:
    found = enc.library.encode(text, add_special_tokens=False)
    return [(i, a, b) for i, (a, b) in zip(found.ids, found.offsets, strict=True)]


def _joined(enc: Encoder, left: tuple[str, list[int]], right: tuple[str, list[int]]) -> tuple[str, list[int]]:
    """The text and ids of two neighbours: the window about their join grows until it agrees with both."""
    (lt, a), (rt, b) = left, right
    size = WINDOW
    while size < len(lt) or size < len(rt):
        head, tail = lt[max(0, len(lt) - size) :], rt[:size]
        before, after, both = _spans(enc, head), _spans(enc, tail), _spans(enc, head + tail)
        k = 0  # tokens at the end of the left window that the left side has too
        while k < min(len(before), len(a)) and before[-1 - k][0] == a[-1 - k]:
            k += 1
        m = 0
        while m < min(len(after), len(b)) and after[m][0] == b[m]:
            m += 1
        k, m = (len(before) if len(head) == len(lt) else k), (len(after) if len(tail) == len(rt) else m)
        left_run = 0  # tokens, from the first that the left side is sure of, which the window has as well
        start = len(before) - k
        at = {x[1]: j for j, x in enumerate(both)}
        p = at.get(before[start][1], -1) if start < len(before) else -1
        while p >= 0 and start + left_run < len(before) and p + left_run < len(both) and before[start + left_run] == both[p + left_run]:
            left_run += 1
        shift = len(head)
        ends = {x[2]: j for j, x in enumerate(both)}
        q = ends.get(after[m - 1][2] + shift, -1) if m else -1
        right_run = 0
        while q - right_run >= 0 and m - 1 - right_run >= 0 and (after[m - 1 - right_run][0], after[m - 1 - right_run][1] + shift) == both[q - right_run][:2]:
            right_run += 1
        # an agreement that holds a word's end, or many tokens, can't be a coincidence
        word_end = lambda run: any(enc.tokens[x[0]].endswith("</w>") for x in run[:-1])
        left_ok = len(head) == len(lt) or left_run >= AGREE or (left_run > 1 and word_end(both[p : p + left_run]))
        right_ok = len(tail) == len(rt) or right_run >= AGREE or (right_run > 1 and word_end(both[q - right_run + 1 : q + 1]))
        if left_ok and right_ok:
            first = 0 if len(head) == len(lt) else p
            last = len(both) if len(tail) == len(rt) else q + 1
            keep = [] if len(head) == len(lt) else a[: len(a) - k]
            rest = [] if len(tail) == len(rt) else b[m:]
            if first <= last:
                return lt + rt, keep + [x[0] for x in both[first:last]] + rest
        size *= 2
    whole = lt + rt
    return whole, np.frombuffer(enc.encode(whole), dtype="<u4").tolist()


def concatenated(enc: Encoder, leaves: list[tuple[str, bytes]]) -> bytes:
    """The ids of the text whose leaves these are, joined as a balanced tree."""
    level = [(t, np.frombuffer(i, dtype="<u4").tolist()) for t, i in leaves]
    while len(level) > 1:
        level = [_joined(enc, *level[k : k + 2]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return enc.packed(level[0][1]) if level else b""


def encoded(docs: DataFrame, path: str, result: str, digest, leaf: int = LEAF, long: int = LONG) -> DataFrame:
    """A row of ``result`` (a schema with doc_id first) for each document: doc_id and digest(encoder, ids)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    names = [x.split()[0] for x in result.split(",")]
    kinds = to_arrow_schema(StructType.fromDDL(result))

    def whole(batches):
        import pyarrow as pa

        enc = encoder(path)
        for part in rows(batches, "doc_id", "text"):
            made = [dict(zip(names, (d, *digest(enc, enc.encode(t))), strict=True)) for d, t in part]
            yield pa.RecordBatch.from_pylist(made, schema=kinds)

    def leaf_ids(batches):
        import pyarrow as pa

        enc = encoder(path)
        for part in rows(batches, "doc_id", "row", "n", "text"):
            d, r, n, t = zip(*part, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(r, pa.int64()), pa.array(n, pa.int32()), pa.array(t, pa.string()), pa.array([enc.encode(x) for x in t], pa.binary())], names=["doc_id", "row", "n", "text", "ids"])

    def tree(pdf):
        import pandas as pd

        enc = encoder(path)
        pdf = pdf.sort_values("n")
        ids = concatenated(enc, list(zip(pdf["text"], pdf["ids"], strict=True)))
        return pd.DataFrame([(pdf["doc_id"].iloc[0], *digest(enc, ids))], columns=names)

    short = mapped(docs.filter(F.length("text") <= long), whole, result)
    leaves = (
        docs.filter(F.length("text") > long)
        .withColumn("row", F.monotonically_increasing_id())
        .select("doc_id", "row", "text", F.explode(F.sequence(F.lit(0), F.ceil(F.length("text") / leaf).cast("int") - 1)).alias("n"))
        .select("doc_id", "row", "n", F.expr(f"substring(text, n * {leaf} + 1, {leaf})").alias("text"))
        .repartition("row", "n")
    )
    cut = mapped(leaves, leaf_ids, "doc_id long, row long, n int, text string, ids binary")
    return short.unionByName(cut.groupBy("row").applyInPandas(tree, result))


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of long) and decoded (string) of every document."""

    def both(enc, ids):
        return np.frombuffer(ids, dtype="<u4").astype("int64").tolist(), enc.decode(ids)

    return encoded(docs, path, "doc_id long, ids array<long>, decoded string", both)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """encode_decode, with the ids and the decoded text as digests made where they are."""

    def short(enc, ids):
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(enc.decode(ids).encode()).hexdigest()

    return encoded(docs, path, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", short)
