"""Line-first cleaning, with DataFrame functions only.

Every line is judged by itself, and goes if a rule says so:

* punctuation: fewer than ten words, and no mark that ends a sentence in any of the scripts of ``ENDS``;
* navigation: three or more of the symbols ``#*$%&|<>``, and more than one in twenty characters;
* boilerplate: a phrase of licences, notices, cookie banners and page furniture in one of four languages;
* shouting: twenty or more letters, most of them capitals.

A document is rejected when what its lines lose is more than half of its characters, lines without a
word aside, or when the base measures fail: fewer than 50 words, or more than half of the words in
3-word windows that the text has twice.

All is computed within the row, in steps that the optimiser can't merge (``fixed``), so that a filter
on the verdict doesn't make it compute a step anew for every element of an array. A text whose window
hashes all differ has no repeated window; the others' candidates are compared word by word.

Defined cases: a null text is empty: no words, not kept; repeated rows give repeated results; a null
doc_id is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fixed, let

SYMBOLS = "[#*$%&|<>]"
BLANKS = " \t\n\x0b\x0c\r"
BLANK = r"[\x20\x09-\x0D]+"
WORDY = r"[^\x20\x09-\x0D]"
#: Ends of sentences, and the marks that may follow them.
ENDS = ".!?:;…。！？؟।)]»”\"'’"
#: English, German, French and Spanish; compared in lower case.
PHRASES = (
    "licensed under", "general public license", "all rights reserved", "copyright (c)", "privacy policy", "terms of use", "terms of service", "cookie policy", "accept cookies", "use of cookies", "enable javascript", "sign up for our newsletter", "lorem ipsum", "click here", "skip to content",
    "lizenziert unter", "alle rechte vorbehalten", "datenschutzerkl", "nutzungsbedingungen", "cookies akzeptieren", "zum inhalt springen",
    "sous licence", "tous droits réservés", "politique de confidentialité", "conditions d'utilisation", "accepter les cookies", "cliquez ici",
    "bajo licencia", "todos los derechos reservados", "política de privacidad", "condiciones de uso", "aceptar cookies", "haga clic aquí",
)
MIN_WORDS, SHORT_LINE, MOST_LOST = 50, 10, 0.5
_LONG = rf"^[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]++){{{SHORT_LINE - 1}}}[^\x20\x09-\x0D]"
_THREE_SYMBOLS = r"(?:[#*$%&|<>][^#*$%&|<>]*+){3}"
#: Of letters most of which are capitals, two neighbours are.
_TWO_CAPITALS = r"\p{Lu}\P{L}*+\p{Lu}"


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _line_fails(line: Column) -> Column:
    ends = lambda x: F.instr(F.lit(ENDS), F.right(x, F.lit(1))) > 0
    unended = ~ends(line) & ~ends(F.rtrim(line, F.lit(BLANKS))) & ~line.rlike(_LONG)
    navigation = line.rlike(_THREE_SYMBOLS) & (_count(line, SYMBOLS) * 20 > F.char_length(line))
    phrase = let(F.lower(line), lambda low: _any([F.contains(low, F.lit(p)) for p in PHRASES]))
    letters = _count(line, r"\p{L}")
    shouting = line.rlike(_TWO_CAPITALS) & (letters >= 20) & (_count(line, r"\p{Lu}") * 2 > letters)
    return unended | navigation | phrase | shouting


def _any(tests: list[Column]) -> Column:
    found = tests[0]
    for t in tests[1:]:
        found = found | t
    return found


def _covered(windows: Column) -> Column:
    """Words in those 3-word windows that a text has twice; needs the columns words and mask.

    Hashes and places share a long, the places in the lowest bits, so that one sort of numbers finds
    the candidates; only these are compared word by word."""
    place = lambda x: x.bitwiseAND(F.bitwise_not("mask")).cast("int")
    hashed = lambda x: x.bitwiseAND(F.col("mask"))
    packed = F.sort_array(F.transform(windows, lambda h, i: hashed(h).bitwiseOR(i.cast("long"))))

    def candidates(marks: Column) -> Column:
        return F.filter(marks, lambda x, k: F.coalesce(hashed(x) == hashed(F.get(marks, k - 1)), F.lit(False)) | F.coalesce(hashed(x) == hashed(F.get(marks, k + 1)), F.lit(False)))

    def worded(marks: Column) -> Column:
        return F.sort_array(F.transform(marks, lambda x: let(place(x), lambda i: F.struct(*(F.get("words", i + k).alias(f"w{k}") for k in range(3)), i.alias("i")))))

    def repeated(keys: Column) -> Column:
        same = lambda p, o: F.coalesce((p["w0"] == o["w0"]) & (p["w1"] == o["w1"]) & (p["w2"] == o["w2"]), F.lit(False))
        return F.filter(keys, lambda p, k: same(p, F.get(keys, k - 1)) | same(p, F.get(keys, k + 1)))

    places = F.array_sort(F.transform(let(worded(let(packed, candidates)), repeated), lambda p: p["i"]))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    return F.aggregate(places, start, lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n")), lambda acc: acc["n"])


def measured(docs: DataFrame) -> DataFrame:
    """The measures of every row: doc_id, text, the base measures, base_failed, line counts and lengths, cleaned text and kept."""
    text = F.coalesce(F.col("text"), F.lit(""))
    split = fixed(
        docs,
        F.col("doc_id").alias("doc_id"),
        F.col("text").alias("text"),
        F.array_remove(F.split(F.btrim(text, F.lit(BLANKS)), BLANK), "").alias("words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(WORDY)).alias("lines"),
        _count(text, SYMBOLS).cast("long").alias("n_symbols"),
    )
    n = F.size("words")
    # the lowest bits, as many as the number of words asks for, hold the place of a window
    mask = (-F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(n, F.lit(2)))))).cast("long")
    hashes = F.transform("words", lambda w: F.xxhash64(w))
    windows = let(hashes, lambda h: F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2))))
    hashed = fixed(split, *split.columns, F.when(n >= 3, windows).otherwise(F.array().cast("array<bigint>")).alias("windows"), mask.alias("mask"), F.filter("lines", lambda x: ~_line_fails(x)).alias("good"))
    distinct = F.size(F.array_distinct("windows")) == F.size("windows")
    counted = fixed(
        hashed,
        "doc_id",
        "text",
        n.cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(distinct, F.lit(0)).otherwise(_covered(F.col("windows"))).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("good")).cast("long").alias("n_failed_lines"),
        F.char_length(F.array_join("lines", "")).alias("line_chars"),
        F.array_join("good", "\n").alias("cleaned"),
        F.char_length(F.array_join("good", "")).alias("good_chars"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    lost = (F.col("line_chars") - F.col("good_chars")) > MOST_LOST * F.col("line_chars")
    return counted.withColumn("base_failed", failed).withColumn("kept", ~failed & ~lost)


def cleaned(docs: DataFrame) -> DataFrame:
    """doc_id and text, without the failing lines, of the documents that are kept."""
    return measured(docs).filter("kept").select("doc_id", F.col("cleaned").alias("text"))


def report(docs: DataFrame) -> DataFrame:
    """The measures of every row and the verdict, without texts."""
    return measured(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_failed_lines")
