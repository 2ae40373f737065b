"""Line deduplication by the number of distinct sites that have a line.

Lines are compared by 128 bits of hash, without the blanks at their ends. Each line's sites go into
a HyperLogLog sketch; sketches are merged by aggregation, first within tasks. An estimate clearly
below ``MIN_SITES`` clears a line and one clearly above condemns it; lines whose estimate is within
``BAND`` of the limit get an exact count of their distinct sites, from the (line, site) pairs of
these lines alone. A condemned line stays in one place, the first of the document with the smallest
doc_id, and goes everywhere else.

Every line that isn't blank counts, at any length and in any script. Every step groups by a hash
with partial sums; a very frequent line is one row a task.

Defined cases: a null text stays null and has no lines; null sites don't count; rows with one doc_id
are told apart by their texts, and repeated rows are one document, so the one place is kept in each;
a null doc_id comes after all others; an empty table gives an empty result; other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, written

MIN_SITES, BAND, LG_K = 10, 0.4, 12
_BLANKS = " \t\r\x0b\x0c"
_SOME = r"[^\x20\x09-\x0D]"


def _key(line: Column) -> list[Column]:
    trimmed = F.btrim(line, F.lit(_BLANKS))
    return [F.xxhash64(trimmed).alias("a"), F.xxhash64(F.lit(11), trimmed).alias("b")]


def lines(docs: DataFrame, site: str = "source") -> DataFrame:
    """doc_id, th, site, pos and the key (a, b) of every line that can be boilerplate."""
    each = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col(site).alias("site"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return each.filter(F.col("line").rlike(_SOME)).select("doc_id", "th", "site", "pos", *_key(F.col("line")))


def boilerplate(table: DataFrame, min_sites: int = MIN_SITES, band: float = BAND) -> DataFrame:
    """a, b and the place to keep (n, doc_id, th, pos) of the lines on min_sites or more distinct sites; table: lines, read twice."""
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "th", "pos")
    sums = table.groupBy("a", "b").agg(F.count("*").alias("c"), F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("sites"), F.min(place).alias("place"))
    likely = written(sums.filter((F.col("c") >= min_sites) & (F.col("sites") >= min_sites * (1 - band))), "lines-likely")
    near = likely.filter(F.col("sites") < min_sites * (1 + band)).select("a", "b")
    exact = table.join(near, ["a", "b"], "left_semi").groupBy("a", "b", "site").agg(F.lit(1).alias("one")).groupBy("a", "b").agg(F.count("site").alias("exact"))
    decided = likely.join(exact, ["a", "b"], "left")
    return decided.filter(F.coalesce(F.col("exact"), F.col("sites")) >= min_sites).select("a", "b", "place")


def removals(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """doc_id, th and gone (places of lines to remove) of the documents that lose any."""
    table = lines(docs, site)
    found = written(boilerplate(table, min_sites), "lines-boilerplate")
    kept = (F.col("place.doc_id").eqNullSafe(F.col("doc_id"))) & (F.col("place.th") == F.col("th")) & (F.col("place.pos") == F.col("pos"))
    gone = table.drop("site").join(found, ["a", "b"]).filter(~kept)
    return gone.groupBy("doc_id", "th").agg(F.collect_set("pos").alias("gone"))


def _joined(docs: DataFrame, site: str, min_sites: int) -> DataFrame:
    marks = removals(docs, site, min_sites).select(F.col("doc_id").alias("_oc_d"), F.col("th").alias("_oc_h"), F.col("gone").alias("_oc_gone"))
    keyed = docs.withColumn("_oc_hash", F.xxhash64("text"))
    return keyed.join(marks, F.col("doc_id").eqNullSafe(F.col("_oc_d")) & (F.col("_oc_hash") == F.col("_oc_h")), "left").drop("_oc_d", "_oc_h", "_oc_hash")


def _remaining() -> Column:
    """The text without the lines at _oc_gone."""
    left = lambda ls: F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("_oc_gone"))
    return let(F.split("text", "\n"), lambda ls: F.array_join(F.transform(left(ls), lambda i: F.get(ls, i)), "\n"))


def cleaned(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """docs, all columns, with boilerplate lines taken out of text; n_chars follows where there is one."""
    joined = _joined(docs, site, min_sites)
    text = F.when(F.col("_oc_gone").isNull(), F.col("text")).otherwise(_remaining())
    out = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def report(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """doc_id, n_lines, n_removed and kept_sha256 (of the remaining text) of every row."""
    joined = _joined(docs.select("doc_id", "text", site), site, min_sites)
    text = F.when(F.col("_oc_gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(_remaining())
    return joined.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.array_size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.array_size("_oc_gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.sha2(text, 256).alias("kept_sha256"),
    )
