"""Benchmark decontamination by winnowing, with DataFrame functions only.

A window is ``WINDOW`` words of a benchmark item. In every window of a text the smallest hash of its
``GRAM``-word grams is kept, at its leftmost place. Two texts that share a window keep the same gram
of it, so a join of the kept grams finds every shared span of WINDOW words or more. Each hit is then
extended word by word, up to a window's width on either side, and counts if WINDOW words agree.
Items of fewer words are one window; their hashes are looked up at every word.

Texts are split and hashed in place, and a document's word hashes stay in the row while its grams
meet those of the benchmark: only hits are shuffled. The benchmark's grams are broadcast while
there are at most ``BROADCAST_ROWS``; beyond that the grams are joined by shuffle, first to find the
documents that share any, then with their surroundings for those documents alone.

Words are compared by 64-bit hashes, so an agreement is that of ten such hashes in a row.

Defined cases: a null text or item has no words and no hits; repeated rows give repeated results;
null doc_ids are kept; items with a null item_id mark words but aren't listed; repeated item_ids
count once; with an empty benchmark nothing is contaminated; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

WINDOW, GRAM = 10, 5
BROADCAST_ROWS = 500_000
_SPAN = WINDOW - GRAM
_SEPARATORS = "".join(chr(c) for c in range(128) if chr(c) not in string.ascii_letters + string.digits)
_SPLIT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def _words(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(_SEPARATORS))
    return F.array_remove(F.split(trimmed, _SPLIT), "")


def n_words(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(_SEPARATORS))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, _SPLIT))).cast("long")


def word_hashes(text: Column) -> Column:
    return F.transform(_words(_lowered(text)), lambda w: F.xxhash64(w))


def _at(i: int) -> Column:
    return F.get("words", F.col("pos") + i)


def _grams(texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, words, pos, g1 to g6 and gram (the smallest of them) of each window of texts (keys, words: array of long).

    An outer explode, since of a plain one the optimiser infers a filter that splits every text again."""
    placed = texts.select(*keys, "words", F.posexplode_outer("words").alias("pos", "_w"))
    wide = placed.filter(F.col("pos") + WINDOW <= F.size("words")).select(*keys, "words", "pos", *(_at(i).alias(f"w{i + 1}") for i in range(WINDOW)))
    hashed = wide.select(*keys, "words", "pos", *(F.xxhash64(*(F.col(f"w{j + k}") for k in range(GRAM))).alias(f"g{j}") for j in range(1, _SPAN + 2)))
    return hashed.withColumn("gram", F.least(*(f"g{j}" for j in range(1, _SPAN + 2))))


def _kept(windows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, gram, pos (its leftmost place) and around (the word hashes from _SPAN before it to _SPAN after it, null beyond the text)."""
    at = F.lit(_SPAN)
    for j in reversed(range(_SPAN)):
        at = F.when(F.col(f"g{j + 1}") == F.col("gram"), F.lit(j)).otherwise(at)
    placed = windows.select(*keys, "words", "gram", (F.col("pos") + at).alias("pos"))
    return placed.select(*keys, "gram", "pos", F.array(*(_at(i) for i in range(-_SPAN, GRAM + _SPAN))).alias("around"))


def _extended(joined: DataFrame) -> DataFrame:
    """Hits of joined gram pairs: runs of equal words about the gram, of a window's length or more."""
    same = lambda i: F.coalesce(F.get("around", F.lit(i + _SPAN)) == F.get("item_around", F.lit(i + _SPAN)), F.lit(False))
    left, right = F.lit(_SPAN), F.lit(_SPAN)
    for k in reversed(range(_SPAN)):
        left = F.when(~same(-1 - k), F.lit(k)).otherwise(left)
        right = F.when(~same(GRAM + k), F.lit(k)).otherwise(right)
    core = same(0)
    for i in range(1, GRAM):
        core = core & same(i)
    runs = joined.filter(core).select("doc_id", "th", "item_id", (F.col("pos") - left).alias("first"), (F.col("pos") + GRAM + right).alias("stop"))
    return runs.filter(F.col("stop") - F.col("first") >= WINDOW)


def _short_hits(texts: DataFrame, short: DataFrame, lengths: list[int], small: bool) -> DataFrame:
    """Hits of items of fewer words than a window."""
    placed = texts.select("doc_id", "th", "words", F.posexplode("words").alias("pos", "_w"))
    runs = F.array(*(F.when(F.col("pos") + n <= F.size("words"), F.struct(F.lit(n).alias("n"), F.xxhash64(F.lit(n), *(_at(i) for i in range(n))).alias("gram"))) for n in lengths))
    grams = placed.select("doc_id", "th", "pos", F.explode(runs).alias("r")).filter("r is not null").select("doc_id", "th", "pos", "r.n", "r.gram")
    listed = short.select("item_id", F.col("n_item").alias("n"), _item_gram(lengths).alias("gram"))
    return grams.join(F.broadcast(listed) if small else listed, ["n", "gram"]).select("doc_id", "th", "item_id", F.col("pos").alias("first"), (F.col("pos") + F.col("n")).alias("stop"))


def _item_gram(lengths: list[int]) -> Column:
    out = F.lit(None).cast("long")
    for n in lengths:
        out = F.when(F.col("n_item") == n, F.xxhash64(F.lit(n), *(F.get("words", F.lit(i)) for i in range(n)))).otherwise(out)
    return out


def hits(docs: DataFrame, benchmark: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, th (hash of the text), item_id, first and stop: word spans of documents that hold windows of items; spans may overlap."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), word_hashes(F.col("text")).alias("words"))
    items = benchmark.select("item_id", word_hashes(F.col("text")).alias("words"))
    items = written(items.withColumn("n_item", F.size("words")).filter("n_item > 0").distinct(), "winnow-items")
    grams = written(_kept(_grams(items, ["item_id"]), ["item_id"]).select("item_id", "gram", F.col("around").alias("item_around")).distinct(), "winnow-grams")
    lengths = sorted(r["n_item"] for r in items.filter(F.col("n_item") < WINDOW).select("n_item").distinct().collect())  # nine at most
    keys = ["doc_id", "th"]
    small = grams.count() <= broadcast_rows
    if small:
        # the few windows that meet a gram become a table, which ends the generated code here: with the
        # extension in it the loop over words would be too long a method for the JVM to compile
        met = _kept(_grams(texts, keys).join(F.broadcast(grams.select("gram").distinct()), "gram"), keys).repartition(*keys).distinct()
    else:
        some = _grams(texts, keys).select(*keys, "gram").distinct().join(grams.select("gram").distinct(), "gram", "left_semi").select(*keys).distinct()
        some = written(some.select(F.col("doc_id").alias("d"), F.col("th").alias("h")), "winnow-some")
        left = texts.join(some, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h")), "left_semi")
        met = _kept(_grams(left, keys), keys).distinct()
    met = written(met, "winnow-met")
    found = _extended(met.join(F.broadcast(grams) if small else grams, "gram"))
    if lengths:
        short = items.filter(F.col("n_item") < WINDOW)
        found = found.unionByName(_short_hits(texts, short, lengths, short.count() <= broadcast_rows))
    return found


def by_document(found: DataFrame) -> DataFrame:
    """doc_id, th, n_hit and items (sorted strings) of every document with a hit; found is read twice, so a table."""
    spans = found.groupBy("doc_id", "th", "first").agg(F.max("stop").alias("stop"))
    before = Window.partitionBy("doc_id", "th").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), F.col("stop") - F.greatest("first", F.coalesce(F.max("stop").over(before), F.lit(0))))
    counts = spans.withColumn("new", new).groupBy("doc_id", "th").agg(F.sum("new").cast("long").alias("n_hit"))
    items = found.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    return counts.join(items, counts["doc_id"].eqNullSafe(items["doc_id"]) & (counts["th"] == items["th"])).select(counts["doc_id"], counts["th"], "n_hit", "items")


def report(docs: DataFrame, benchmark: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    marked = by_document(written(hits(docs, benchmark, broadcast_rows), "winnow-hits")).select(F.col("doc_id").alias("d"), F.col("th").alias("h"), "n_hit", "items")
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), n_words(F.col("text")).alias("n_words"))
    joined = every.join(marked, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h")), "left")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, without a word inside a benchmark window."""
    marked = hits(docs, benchmark).select(F.col("doc_id").alias("_oc_d"), F.col("th").alias("_oc_h")).distinct()
    keyed = docs.withColumn("_oc_hash", F.xxhash64("text"))
    on = F.col("doc_id").eqNullSafe(F.col("_oc_d")) & (F.col("_oc_hash") == F.col("_oc_h"))
    return keyed.join(marked, on, "left_anti").drop("_oc_hash")
