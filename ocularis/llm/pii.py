"""Personal data by patterns, and by bootstrapped contextual extraction.

Seeds are the valid addresses, card and phone numbers found by pattern, and provisional ones: tokens
that look drawn at random (``_random``), of kind secret. Every token with a digit or an at sign is an
instance, and so is every run of such tokens with only blanks, brackets and hyphens between, at any
length. What is about and in it are its contexts: the two words before, the one before with the one after, the
one before a label mark such as ``:`` or ``=``, the one before or the one before that with the
instance's shape, and for what is long enough to identify somebody its form: letters as one ``a``, digits as so many ``9`` or as one, and whether a card's check digit holds.
Contexts and instances form a graph, weighted by the number of documents. Scores go
back and forth over it for ``ROUNDS`` rounds as Spark joins: a context's score for a kind is the
weighted mean of its instances' scores, drawn to zero by ``PRIOR``; an unseen instance's is that of
its contexts. Instances that look like a kind but fail its check (a wrong check digit, a part over 255) count
against their contexts and are never added; in a form, instances of which nothing is known count a quarter. What the patterns missed is added where instance and context reach ``LIMIT`` and
``SUPPORT`` different seeds, or instances that reached ``LIMIT`` in the round before, have the
context; so each round's finds bring new contexts. A provisional seed is added only by a context too.
Added spans never overlap those that patterns found, and a span within another added one is not added.

``holdout`` measures this: half of the pattern-found spans, by a hash, are hidden from the seeds, and the graph has to find them.

One pass reads the texts, in time linear in their length; the graph has only the tokens with a digit or an at sign. Tokens over ``_WORD``
characters stand in it as their digests, longer words about them by the nearest ``_WORD`` characters.

Defined cases: a null text is empty; repeated rows give repeated results and count as one document
in the graph; a null doc_id is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped, rows, written

#: The first four have patterns.
KINDS = ("email", "ip", "card", "phone", "secret")
PATTERNS, SECRET = 4, 4
#: Instead of a kind: nothing is known of an instance, or it failed the check of what it looks like.
UNKNOWN, FAILED = -1, -2
#: Contexts with a shape and forms are broad: their scores are drawn to zero by SHAPE_PRIOR. Unknown instances count UNKNOWN_IN_FORM in forms.
ROUNDS, PRIOR, SHAPE_PRIOR, LIMIT, SUPPORT = 3, 0.5, 4.0, 0.8, 5
UNKNOWN_IN_FORM = 0.25

_ANY = re.compile(r"[0-9@]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9](?<![0-9]{2})[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")
_GAP = re.compile(r"[\x20\t\xa0()\[\]-]+")
_OPEN, _SHUT = "([{<", ")]}>"
_MARKS = "\"'()[]{}<>,;:!?.=|*#$%&"


def _emails(text: str) -> list[tuple[int, int]]:
    """As finditer would find them; each at sign is looked at once."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        first = at
        while first > done and text[first - 1] in _LOCAL:
            first -= 1
        if first < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((first, m.end()))
            done = m.end()
        at = text.find("@", at + 1)
    return found


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of what the patterns find, in order of start and kind."""
    if not _ANY.search(text):
        return []
    found = [(a, 0, b) for a, b in _emails(text)]
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _DIGITS.sub("", m[0])
            if 14 <= len(digits) <= 19 and _luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_DIGITS.sub("", m[0])) <= 15]
    return sorted(found)


def _bounds(text: str, at: int) -> tuple[int, int]:
    """The white-space-delimited token that holds the character at."""
    first = at
    while first and not text[first - 1].isspace():
        first -= 1
    stop = at + 1
    while stop < len(text) and not text[stop].isspace():
        stop += 1
    return first, stop


#: Longer words and tokens stand in the graph as digests.
_WORD = 128
#: Least length of a provisional seed, and its least number of changes between digits and letters.
_RANDOM_LENGTH, _RANDOM_CHANGES = 20, 4
_KEYED = re.compile(rf"[A-Za-z0-9+/_=-]{{{_RANDOM_LENGTH},}}+")
_CHANGE = re.compile(r"(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]")


def _random(token: str) -> bool:
    """Whether a token looks drawn at random: long, in the letters of keys, digits and letters well mixed."""
    return _KEYED.fullmatch(token) is not None and sum(1 for _ in _CHANGE.finditer(token)) >= _RANDOM_CHANGES


def _name(token: str) -> str:
    """What stands for a token or word in the graph."""
    token = token.lower()
    return token if len(token) <= _WORD else hashlib.sha256(token.encode("utf-8", "surrogatepass")).hexdigest()


def _before(text: str, at: int, n: int) -> list[str]:
    """At most n words before a place, in order; of one over _WORD characters its end, and none before it."""
    found: list[str] = []
    while len(found) < n:
        while at and text[at - 1].isspace():
            at -= 1
        stop, least = at, max(0, at - _WORD)
        while at > least and not text[at - 1].isspace():
            at -= 1
        if at == stop:
            break
        found.append(text[at:stop].lower())
        if at and not text[at - 1].isspace():
            break
    return found[::-1]


def _after(text: str, at: int) -> str:
    """The word after a place, of one over _WORD characters its beginning."""
    while at < len(text) and text[at].isspace():
        at += 1
    stop, most = at, min(len(text), at + _WORD)
    while stop < most and not text[stop].isspace():
        stop += 1
    return text[at:stop].lower()


def shape(token: str) -> str:
    """A token with 9 for digits, a for letters, and blanks and marks as they are; long ones as digests."""
    return _name("".join("9" if c.isdigit() else "a" if c.isalpha() else c for c in token))


_LETTERS, _NINES = re.compile(r"[^\W\d_]+"), re.compile(r"\d+")
#: Digits of an instance from which its form is a context, if it has no at sign and no three points.
_FORM_DIGITS = 9


def _forms(token: str) -> list[str]:
    """What an instance looks like, for one with an at sign, three points or _FORM_DIGITS digits: with its digits' numbers and without."""
    if len(token) > _WORD or not ("@" in token or token.count(".") == 3 or sum(c.isdigit() for c in token) >= _FORM_DIGITS):
        return []
    like = _LETTERS.sub("a", token)
    digits = [c for c in token if c.isdigit()]
    if 14 <= len(digits) <= 19 and _luhn("".join(digits)):
        like += " checked"
    return sorted({"form " + _NINES.sub(lambda m: "9" * len(m[0]), like), "form " + _NINES.sub("9", like)})


def _fails(token: str) -> bool:
    """Whether a token looks like a kind and fails its check."""
    if _IP.fullmatch(token):
        return True
    digits = len(_DIGITS.sub("", token))
    return bool(14 <= digits <= 19 and _CARD.fullmatch(token)) or _PHONE.fullmatch(token) is not None


def _contexts(text: str, first: int, stop: int, kind: int) -> list[str]:
    before, after = _before(text, first, 2), _after(text, stop)
    found = [] if kind == SECRET else _forms(text[first:stop])
    if len(before) == 2:
        found.append("2 " + " ".join(before))
    if before and after:
        found.append(f"1 {before[-1]} _ {after}")
    if before and before[-1][-1] in ":=":
        found.append("label " + " ".join(before) if before[-1] in (":", "=") else "label " + before[-1])
    if before:
        like = shape(text[first:stop])
        found.append(f"shape {before[-1]} _ {like}")
        if len(before) == 2:
            found.append(f"shape {before[0]} * _ {like}")
    return found


def _stripped(text: str, first: int, stop: int) -> tuple[int, int]:
    """The bounds without the marks at the ends, but for a bracket whose partner is inside; each kind of bracket is looked for once from each end."""
    opened: dict[str, int] = {}
    while stop > first and text[stop - 1] in _MARKS:
        c = text[stop - 1]
        if c in _SHUT:
            if c not in opened:
                opened[c] = text.rfind(_OPEN[_SHUT.index(c)], first, stop)
            if opened[c] > first:
                break
        stop -= 1
    shut: dict[str, int] = {}
    while first < stop and text[first] in _MARKS:
        c = text[first]
        if c in _OPEN:
            if c not in shut:
                shut[c] = text.find(_SHUT[_OPEN.index(c)], first, stop)
            if first < shut[c] < stop - 1:
                break
        first += 1
    return first, stop


def instances(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, str, int, list[str]]]:
    """(start, end, name, number of the kind, UNKNOWN or FAILED, contexts) of every token with a digit or an at sign and every run of them."""
    found = [(a, b, _name(text[a:b]), k, _contexts(text, a, b, k)) for a, k, b in base]
    taken = sorted((a, b) for a, _, b in base)
    at, next_taken = 0, 0
    tokens: list[tuple[int, int]] = []
    unseen: set[tuple[int, int]] = set()

    def close() -> None:
        if len(tokens) > 1:
            unseen.add(_stripped(text, tokens[0][0], tokens[-1][1]))
        unseen.update(_stripped(text, *t) for t in tokens)
        tokens.clear()

    while m := _ANY.search(text, at):
        first, stop = _bounds(text, m.start())
        while next_taken < len(taken) and taken[next_taken][1] <= first:
            next_taken += 1
        bare, end = first, stop
        while bare < end and text[bare] in _MARKS:
            bare += 1
        while end > bare and text[end - 1] in _MARKS:
            end -= 1
        at = stop
        if next_taken < len(taken) and taken[next_taken][0] < end and bare < taken[next_taken][1]:
            close()
            at = max(at, taken[next_taken][1])
            continue
        if tokens and not (_GAP.fullmatch(text, tokens[-1][1], first)):
            close()
        tokens.append((first, stop))
    close()
    for a, b in sorted(unseen):
        if a < b:
            kind = SECRET if _random(text[a:b]) else FAILED if _fails(text[a:b]) else UNKNOWN
            found.append((a, b, _name(text[a:b]), kind, _contexts(text, a, b, kind)))
    return found


def extracted(docs: DataFrame) -> DataFrame:
    """doc_id, th, base (spans) and found (instances with contexts) of every row."""
    span = "struct<start:int,kind:int,stop:int>"
    inst = "struct<start:int,stop:int,token:string,kind:int,contexts:array<string>>"

    def run(batches):
        import pyarrow as pa

        spans = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32())]))
        insts = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("token", pa.string()), ("kind", pa.int32()), ("contexts", pa.list_(pa.string()))]))
        for part in rows(batches, "doc_id", "th", "text"):
            base = [base_spans(t or "") for *_, t in part]
            found = [instances(t, b) if t and _ANY.search(t) else [] for (*_, t), b in zip(part, base, strict=True)]
            d, h, _ = zip(*part, strict=True)
            as_dicts = [[{"start": a, "kind": k, "stop": b} for a, k, b in x] for x in base]
            as_found = [[{"start": a, "stop": b, "token": t, "kind": k, "contexts": c} for a, b, t, k, c in x] for x in found]
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(h, pa.int64()), pa.array(as_dicts, spans), pa.array(as_found, insts)], names=["doc_id", "th", "base", "found"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    return mapped(keyed, run, f"doc_id long, th long, base array<{span}>, found array<{inst}>")


#: Rows of occurrences or edges that patterns of their own didn't find.
_UNSEEN = f"kind = {UNKNOWN} or kind >= {PATTERNS}"


def learned(found: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, limit: float = LIMIT) -> tuple[DataFrame, DataFrame]:
    """(context, kind) and (token, kind) that reach the limit; found: doc_id, th, token, kind (or UNKNOWN, FAILED) and context of each occurrence."""
    edges = written(found.groupBy("context", "token").agg(F.countDistinct(F.struct("doc_id", "th")).alias("n"), F.max("kind").alias("kind")), "pii-edges")
    seeds = edges.filter("kind >= 0").groupBy("token").agg(F.max("kind").alias("kind")).withColumn("score", F.lit(1.0))
    form = F.col("context").startswith("form ")
    totals = edges.groupBy("context").agg(F.sum(F.when(form & (F.col("kind") == UNKNOWN), F.col("n") * UNKNOWN_IN_FORM).otherwise(F.col("n"))).alias("total"))
    prior = F.when(F.col("context").startswith("shape ") | form, SHAPE_PRIOR).otherwise(PRIOR)
    scores = seeds
    contexts = None
    for _ in range(rounds):
        hit = edges.drop("kind").join(scores.withColumnRenamed("kind", "of"), "token")
        sums = hit.groupBy("context", "of").agg(F.sum(F.col("n") * F.col("score")).alias("got"), F.count_if(F.col("score") >= limit).alias("backers")).filter(F.col("backers") >= support)
        contexts = written(sums.join(totals, "context").select("context", "of", (F.col("got") / (F.col("total") + prior)).alias("score")), "pii-contexts")
        unseen = edges.filter(_UNSEEN).join(contexts, "context").groupBy("token", F.col("of").alias("kind")).agg(F.max("score").alias("score"))
        scores = written(seeds.unionByName(unseen.join(seeds.select("token"), "token", "left_anti")), "pii-scores")
    good = contexts.filter(F.col("score") >= limit).select("context", F.col("of").alias("kind"))
    return good, scores.filter(F.col("score") >= limit).select("token", "kind")


def spans(docs: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, limit: float = LIMIT) -> DataFrame:
    """doc_id, base and added (spans: start, kind, stop) of every row."""
    table = written(extracted(docs), "pii-found")
    each = _occurrences(table)
    contexts, tokens = learned(each, rounds, support, limit)
    new = each.filter(_UNSEEN).drop("kind").join(contexts, "context").join(tokens, ["token", "kind"])
    one = new.groupBy("doc_id", "th", "start", "stop").agg(F.min("kind").alias("kind"))
    wider = F.max("stop").over(Window.partitionBy("doc_id", "th").orderBy("start", F.desc("stop")).rowsBetween(Window.unboundedPreceding, -1))
    one = one.withColumn("reach", wider).filter("reach is null or reach < stop")
    added = one.groupBy("doc_id", "th").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "stop"))).alias("added")).select(F.col("doc_id").alias("d"), F.col("th").alias("h"), "added")
    joined = table.select("doc_id", "th", "base").join(added, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h")), "left")
    return joined.select("doc_id", "base", F.coalesce("added", F.array().cast("array<struct<start:int,kind:int,stop:int>>")).alias("added"))


def _occurrences(table: DataFrame) -> DataFrame:
    """A row for each context of each instance."""
    return table.select("doc_id", "th", F.explode("found").alias("f")).select("doc_id", "th", "f.start", "f.stop", "f.token", "f.kind", F.explode("f.contexts").alias("context"))


def holdout(docs: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, limit: float = LIMIT) -> DataFrame:
    """kind, hidden, right, wrong, recall and precision: the pattern-found identifiers that are hidden from the seeds (half, by a hash), and of what the graph
    adds of a kind what the patterns call so and what not. Identifiers count once."""
    each = _occurrences(written(extracted(docs), "pii-found"))
    by_pattern = (F.col("kind") >= 0) & (F.col("kind") < PATTERNS)
    hidden = by_pattern & (F.pmod(F.xxhash64(F.lit(3), "token"), F.lit(2)) == 0)
    marked = written(each.withColumns({"truth": F.col("kind"), "kind": F.when(hidden, UNKNOWN).otherwise(F.col("kind"))}), "pii-hidden")
    contexts, tokens = learned(marked.drop("truth"), rounds, support, limit)
    added = marked.filter(_UNSEEN).select("token", "truth", "context").join(contexts, "context").join(tokens, ["token", "kind"]).select("token", "truth", "kind").distinct()
    sums = added.groupBy("kind").agg(F.count_if(F.col("truth") == F.col("kind")).alias("right"), F.count_if(F.col("truth") != F.col("kind")).alias("wrong"))
    wanted = marked.filter((F.col("truth") >= 0) & (F.col("truth") < PATTERNS) & (F.col("kind") == UNKNOWN)).groupBy(F.col("truth").alias("kind")).agg(F.countDistinct("token").alias("hidden"))
    both = wanted.join(sums, "kind", "left").fillna(0, ["right", "wrong"])
    return both.select(F.get(F.array(*map(F.lit, KINDS)), F.col("kind")).alias("kind"), "hidden", "right", "wrong", (F.col("right") / F.col("hidden")).alias("recall"), F.try_divide(F.col("right"), F.col("right") + F.col("wrong")).alias("precision"))


def _listed(of: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.sort_array(of), lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, the number of spans of each kind that patterns find, their digest, all spans, and the numbers of added and of all spans."""
    found = spans(docs)

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:PATTERNS])]
    return found.select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"), (F.size("base") + F.size("added")).cast("long").alias("n_spans"))


def digest_of(text: str) -> str:
    """base_sha256 of one text."""
    return hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in base_spans(text)).encode()).hexdigest()
