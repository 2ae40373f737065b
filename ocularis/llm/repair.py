"""Repair of conversation structure: the cheapest edits that make roles alternate, ties by the edits' letters.

Rows of a conversation, in order, are kept, given another role or deleted, and turns without text are
inserted, until the initials of the roles read ``(s?(ua)+)?``. The states are: nothing yet, after a
system turn, after a user's, after an assistant's; an edit of row k leads from a state before it to
one after it, so edits are the edges of an acyclic graph. A path's weight is one integer: the high
digits are its cost and the low ones, of a fixed width, are the letters of its edits, first edit
highest, with zeros after the last. The least integer is then the cheapest path and among these the one
whose letters come first in ASCII, a prefix before what it begins; a plain minimum over
edges from the last row to the first decides everything. The state fixes the role of each inserted or changed turn, so the letters
say all.

Rows are dealt by ranges of (conversation, turn) and sorted, so each task sees whole conversations, but
for the first and the last of its range, which may go on in another task. Conversations inside a range are repaired
where they lie. Those at the edges, of any length, are repaired in segments: each segment
gives the least weights from every state to every other (edits before a row belong to it, so no
segment's letters are a prefix of another's, and weights of segments join), they are joined from the last to the first,
and the letters go back to the segments' rows.

Order within a conversation: turn (nulls first), then role, then a hash of the text; conversations are told apart by
conv_id, null is one of them. Faults: a row is blank, else a duplicate of an earlier one's role and text, else truncated
(ends without a full stop, exclamation or question mark). Defined cases: null roles and texts are one space; a role's initial is its first character, and a
role that is empty or starts with another letter than s, u or a can't be kept; of repeated rows all but the first are
duplicates; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped, written

NONE, SYSTEM, USER, ASSISTANT = range(4)
#: Letters as digits of three bits: 0 is padding.
LETTERS = " DIKR"
DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4
#: Most rows of a segment, 2^12.
_PIECE_BITS = 12
PIECE = 1 << _PIECE_BITS
_BITS = 3
#: Where a user's or an assistant's turn leads, and where a kept initial leads.
_NEXT = {NONE: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_KEPT = {(NONE, "s"): SYSTEM, (NONE, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_BLANK = re.compile(r"[\x20\x09-\x0D]*")
_TAIL = "\x20\t\n\x0b\x0c\r"
_FINE = frozenset(("su", "ua", "au"))
BLANK, DUPLICATE, TRUNCATED, WHOLE = range(4)


def fault(role: str, text: str, seen: set) -> int:
    """The first fault of a row; seen: digests of roles and texts before, which it joins."""
    key = hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
    again = key in seen
    seen.add(key)
    if _BLANK.fullmatch(text):
        return BLANK
    if again:
        return DUPLICATE
    return WHOLE if text.rstrip(_TAIL)[-1] in ".!?" else TRUNCATED


class Weights:
    """Integers for the paths over n rows: cost above width digits of letters."""

    def __init__(self, n: int) -> None:
        self.width = _BITS * (3 * n + 2)
        self.mask = (1 << self.width) - 1

    def led(self, cost: int, letter: int, rest: int) -> int:
        """The weight of an edit and what follows it."""
        return ((rest >> self.width) + cost << self.width) | (letter << self.width - _BITS) | (rest & self.mask) >> _BITS

    def parts(self, weight: int) -> tuple[int, str]:
        """Cost and letters."""
        low = weight & self.mask
        return weight >> self.width, "".join(LETTERS[int(d)] for d in format(low, f"0{self.width // _BITS}o").rstrip("0")) if low else ""

    def joined(self, cost: int, letters: str, rest: int) -> int:
        """The weight of letters at a cost and what follows them."""
        low = int("".join(str(LETTERS.index(c)) for c in letters) or "0", 8) << self.width - _BITS * len(letters)
        return ((rest >> self.width) + cost << self.width) | low | (rest & self.mask) >> _BITS * len(letters)


def _inserted(w: Weights, best: list[int | None]) -> list[int | None]:
    """The least weights where up to two turns may be inserted first; more lead back to a state at a cost."""
    for _ in range(2):
        best = [min((x for x in (here, None if there is None else w.led(2, INSERT, there)) if x is not None), default=None) for here, there in ((best[s], best[_NEXT[s]]) for s in range(4))]
    return best


def ended(w: Weights) -> list[int | None]:
    """Least weights after the last row."""
    return _inserted(w, [0, None, None, 0])


def preceded(w: Weights, rows: list[tuple[str, int]], best: list[int | None]) -> list[int | None]:
    """Least weights before rows (initial, fault), given those after them."""
    for initial, kind in reversed(rows):
        extra = 1 if kind == TRUNCATED else 0
        now = []
        for state in range(4):
            options = []
            if best[state] is not None:
                options.append(w.led(3, DELETE, best[state]))
            if kind > DUPLICATE:
                kept = _KEPT.get((state, initial))
                if kept is not None and best[kept] is not None:
                    options.append(w.led(extra, KEEP, best[kept]))
                if best[_NEXT[state]] is not None:
                    options.append(w.led(2 + extra, REROLE, best[_NEXT[state]]))
            now.append(min(options, default=None))
        best = _inserted(w, now)
    return best


def segment(rows: list[tuple[str, int]]) -> tuple[list[int | None], list[str | None]]:
    """Cost and letters of the least paths over rows, to each state (outer) from each state (inner)."""
    w = Weights(len(rows))
    found = [(None, None) if x is None else w.parts(x) for end in range(4) for x in preceded(w, rows, [0 if s == end else None for s in range(4)])]
    return [c for c, _ in found], [x for _, x in found]


def joined(parts: list[tuple[int, list, list]]) -> tuple[int, str, list[tuple[int, str]]]:
    """Cost and letters of the least path over segments (rows, costs, letters), and for each its first state and letters."""
    w = Weights(sum(n for n, *_ in parts))
    best, ways = ended(w), []
    for _, cost, letters in reversed(parts):
        options = [[(w.joined(cost[4 * e + s], letters[4 * e + s], best[e]), e) for e in range(4) if cost[4 * e + s] is not None and best[e] is not None] for s in range(4)]
        least = [min(o, default=(None, None)) for o in options]
        best = [x for x, _ in least]
        ways.append([e for _, e in least])
    total, audit = w.parts(best[NONE])
    state, used, shares = NONE, 0, []
    for (_, _, letters), way in zip(parts, reversed(ways), strict=True):
        mine = letters[4 * way[state] + state]
        shares.append((state, mine))
        used, state = used + len(mine), way[state]
    shares[-1] = (shares[-1][0], shares[-1][1] + audit[used:])
    return total, audit, shares


def solved(rows: list[tuple[str, int]], piece: int = 0) -> tuple[int, str]:
    """Cost and letters of the repair of a whole conversation; a long one in pieces, since a path's integer is as long as its rows are many."""
    piece = piece or PIECE
    if len(rows) <= piece:
        w = Weights(len(rows))
        return w.parts(preceded(w, rows, ended(w))[NONE])
    cut = [rows[k : k + piece] for k in range(0, len(rows), piece)]
    return joined([(len(c), *segment(c)) for c in cut])[:2]


def applied(rows: list[tuple[str, str]], letters: str, state: int = NONE) -> tuple[list[tuple[str, str, str]], int]:
    """(role, text, letter) of the turns that the letters leave, and the state after them."""
    out, at = [], 0
    for c in letters:
        if c == "I":
            state = _NEXT[state]
            out.append((_ROLE[state], "", c))
            continue
        role, text = rows[at]
        at += 1
        if c == "K":
            state = _KEPT[state, role[:1]]
            out.append((role, text, c))
        elif c == "R":
            state = _NEXT[state]
            out.append((_ROLE[state], text, c))
    return out, state


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after the test damage: a twentieth dropped, emptied, stripped of sentence ends, repeated, and made a user's each, by a checksum of conv_id:turn."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn"))) % 20
    some = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return some.filter("kind != 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies).drop("copy")


_ROW = "kind int, conv_id long, part long, at long, turn long, role string, text string, edit string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, sha string"
#: Kinds of rows that the first pass gives: verdicts and repaired turns of conversations inside a range, rows of those at its edges.
VERDICT, TURN, EDGE = range(3)


def _gaps(turns: list[int | None]) -> int:
    known = {t for t in turns if t is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in _FINE for a, b in zip(initials, initials[1:], strict=False))


def _pass(turns: bool):
    """The kernel over sorted rows: repairs conversations that begin and end inside the task; gives the rows of the others."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        names = [c.split()[0] for c in _ROW.split(", ")]
        types = [{"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[c.split()[1]] for c in _ROW.split(", ")]
        out: list[tuple] = []
        size = 0

        def table():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

        def whole(conv, rows):
            seen: set = set()
            marks = [(role[:1], fault(role, text, seen)) for _, role, text in rows]
            cost, letters = solved(marks)
            left, _ = applied([r[1:] for r in rows], letters)
            if turns:
                for k, (role, text, letter) in enumerate(left):
                    yield (TURN, conv, part, k, None, role, text, letter, *[None] * 8)
                return
            sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t, _ in left).encode("utf-8", "surrogatepass")).hexdigest()
            counts = [sum(f == kind for _, f in marks) for kind in (BLANK, DUPLICATE, TRUNCATED)]
            yield (VERDICT, conv, part, None, None, None, None, None, _gaps([r[0] for r in rows]), *counts, _illegal([i for i, _ in marks]), cost, letters, sha)

        def edge(conv, at, row):
            return (EDGE, conv, part << 32 | at >> _PIECE_BITS, at, row[0], row[1], row[2], *[None] * 9)

        now, held, at, first = None, [], 0, True
        for batch in batches:
            for conv, *row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True):
                if now != (conv,):
                    if now is not None and not first:
                        out.extend(whole(now[0], held))
                        size += sum(len(r[2]) for r in held) if turns else 200
                    first, now, held, at = now is None, (conv,), [], 0
                if first:
                    out.append(edge(conv, at, row))
                    at, size = at + 1, size + len(row[2])
                else:
                    held.append(row)
                if size > 2 << 20 or len(out) > 4096:
                    if out:
                        yield table()
                    out, size = [], 0
        for k, row in enumerate(held):
            out.append(edge(now[0], k, row))
            if len(out) > 1024:
                yield table()
                out = []
        if out:
            yield table()

    return run


def _sorted(rows: DataFrame) -> DataFrame:
    """Rows dealt by ranges and sorted; equal rows, which are alike, may lie in several ranges."""
    keys = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    numbered = rows.withColumn("place", F.monotonically_increasing_id())
    return numbered.repartitionByRange(*keys[:3], F.xxhash64("text"), "place").sortWithinPartitions(*keys[:3], F.xxhash64("text"), "place")


def _edges(edge: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verdicts (without sha) of conversations in segments, and their rows with the letters and the state before them; edge: kept table of EDGE rows."""
    same = lambda a, b: a["conv_id"].eqNullSafe(b["_c"])
    keyed = edge.select("conv_id", "part", "at", "turn", "role", "text", F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(7), F.lit(0), "text", "role").alias("h2"))
    seat = F.struct("part", "at")
    firsts = keyed.groupBy("conv_id", "h1", "h2").agg(F.min(seat).alias("first"), F.count("*").alias("n")).filter("n > 1").select(F.col("conv_id").alias("_c"), F.col("h1").alias("_1"), F.col("h2").alias("_2"), "first")
    met = keyed.join(firsts, same(keyed, firsts) & (F.col("h1") == F.col("_1")) & (F.col("h2") == F.col("_2")), "left")
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    ends = F.substring(F.btrim("text", F.lit(_TAIL)), -1, 1).isin(".", "!", "?")
    kind = F.when(blank, BLANK).when(seat > F.col("first"), DUPLICATE).when(ends, WHOLE).otherwise(TRUNCATED)
    marked = written(met.select("conv_id", "part", "at", "turn", F.substring("role", 1, 1).alias("initial"), kind.alias("fault")), "repair-marked")

    names = "conv_id part n head tail illegal blank duplicate truncated cost letters".split()

    def segments_of(batches):
        import pyarrow as pa

        now, held = None, []
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 4, pa.list_(pa.int64()), pa.list_(pa.string())]

        def closed():
            initials = [i for i, _ in held]
            values = [*now, len(held), initials[0], initials[-1], _illegal(initials), *(sum(f == k for _, f in held) for k in (BLANK, DUPLICATE, TRUNCATED)), *segment(held)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=names)

        for batch in batches:
            for conv, part, initial, f in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "initial", "fault")), strict=True):
                if now is not None and now != (conv, part):
                    yield closed()
                    held = []
                now = (conv, part)
                held.append((initial, f))
        if held:
            yield closed()

    ordered = marked.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "at")
    segments = mapped(ordered, segments_of, "conv_id long, part long, n long, head string, tail string, illegal long, blank long, duplicate long, truncated long, cost array<long>, letters array<string>")

    def decided_of(batches):
        import pyarrow as pa

        share = pa.list_(pa.struct([("part", pa.int64()), ("state", pa.int32()), ("letters", pa.string())]))
        schema = pa.schema([("conv_id", pa.int64()), *((k, pa.int64()) for k in ("blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("shares", share)])
        for batch in batches:
            for row in batch.to_pylist():
                parts = sorted(row["segments"], key=lambda s: s["part"])
                cost, audit, shares = joined([(s["n"], s["cost"], s["letters"]) for s in parts])
                illegal = sum(s["illegal"] for s in parts) + sum(a["tail"] + b["head"] not in _FINE for a, b in zip(parts, parts[1:], strict=False))
                sums = {k: sum(s[k] for s in parts) for k in ("blank", "duplicate", "truncated")}
                places = [{"part": s["part"], "state": state, "letters": x} for s, (state, x) in zip(parts, shares, strict=True)]
                yield pa.RecordBatch.from_pylist([{"conv_id": row["conv_id"], **sums, "illegal": illegal, "cost": cost, "audit": audit, "shares": places}], schema=schema)

    per = segments.groupBy("conv_id").agg(F.collect_list(F.struct(*segments.columns[1:])).alias("segments"))
    decided = mapped(per, decided_of, "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, shares array<struct<part:bigint,state:int,letters:string>>")
    decided = written(decided, "repair-decided")
    spread = marked.groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps")).withColumnRenamed("conv_id", "_c")
    verdicts = decided.drop("shares").join(spread, same(decided, spread)).drop("_c")
    shares = decided.select(F.col("conv_id").alias("_c"), F.explode("shares").alias("s")).select("_c", F.col("s.part").alias("_p"), "s.state", "s.letters")
    return verdicts, shares


def _edge_turns(edge: DataFrame, shares: DataFrame) -> DataFrame:
    """Repaired turns of conversations in segments: conv_id, part, at, role, text, edit, in order of part and at."""

    def run(batches):
        import pyarrow as pa

        now, place, state, letters, out = None, 0, NONE, "", []

        def took(row):
            """Turns up to and with the next letter that takes a row."""
            nonlocal place, state
            stop = place
            while letters[stop] == "I":
                stop += 1
            left, state = applied([row], letters[place : stop + 1], state)
            place = stop + 1
            return left

        def rest():
            nonlocal place, state
            left, state = applied([], letters[place:], state)
            place = len(letters)
            return left

        def table():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], names=["conv_id", "part", "at", "role", "text", "edit"])

        count = 0
        for batch in batches:
            for conv, part, role, text, begin, mine in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "role", "text", "state", "letters")), strict=True):
                if now != (conv, part):
                    if now is not None:
                        for x in rest():
                            out.append((*now, count, *x))
                            count += 1
                    now, place, state, letters, count = (conv, part), 0, begin, mine, 0
                for x in took((role, text)):
                    out.append((conv, part, count, *x))
                    count += 1
            if out:
                yield table()
                out = []
        if now is not None:
            out = [(*now, count + k, *x) for k, x in enumerate(rest())]
            if out:
                yield table()

    met = edge.select("conv_id", "part", "at", "role", "text").join(shares, edge["conv_id"].eqNullSafe(shares["_c"]) & (edge["part"] == shares["_p"]))
    ordered = met.drop("_c", "_p").repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "at")
    return mapped(ordered, run, "conv_id long, part long, at long, role string, text string, edit string")


def _edge_digests(turns: DataFrame) -> DataFrame:
    """_c and sha: running digests over each conversation's turns in order; a digest is one chain, so a conversation is one task's, a batch at a time."""

    def run(batches):
        import pyarrow as pa

        now, digest, done = None, None, []
        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                line = f"{role}:{text}".encode("utf-8", "surrogatepass")
                if now != (conv,):
                    if now is not None:
                        done.append((now[0], digest.hexdigest()))
                    now, digest = (conv,), hashlib.sha256(line)
                else:
                    digest.update(b"\n" + line)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.int64(), pa.string()), strict=True)], names=["_c", "sha"])
                done = []
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([digest.hexdigest()])], names=["_c", "sha"])

    ordered = turns.select("conv_id", "part", "at", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "part", "at")
    return mapped(ordered, run, "_c long, sha string")


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, at (place in the repaired conversation's order, within part), part, role, text and edit of every turn that is left; rows: conv_id, turn, role, text, no nulls in role and text."""
    found = written(mapped(_sorted(rows), _pass(True), _ROW), "repair-turns")
    edge = found.filter(F.col("kind") == EDGE)
    _, shares = _edges(edge)
    columns = ["conv_id", "part", "at", "role", "text", "edit"]
    return found.filter(F.col("kind") == TURN).select(columns).unionByName(_edge_turns(edge, shares).select(columns))


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def verdicts(rows: DataFrame) -> DataFrame:
    """conv_id, the counts of faults, cost, audit and repaired_sha256 of every conversation in rows."""
    found = written(mapped(_sorted(rows), _pass(False), _ROW), "repair-verdicts")
    columns = ["conv_id", *_COUNTS, "audit", F.col("sha").alias("repaired_sha256")]
    edge = found.filter(F.col("kind") == EDGE)
    decided, shares = _edges(edge)
    digests = _edge_digests(_edge_turns(edge, shares))
    late = decided.join(digests, decided["conv_id"].eqNullSafe(digests["_c"]), "left").withColumn("sha", F.coalesce("sha", F.sha2(F.lit(""), 256)))
    return found.filter(F.col("kind") == VERDICT).select(columns).unionByName(late.select(columns))


def report(conversations: DataFrame) -> DataFrame:
    """verdicts of the damaged conversations, and a row of zeros for each conversation of which no row is left."""
    found = verdicts(damaged(conversations))
    every = conversations.select(F.col("conv_id").cast("long").alias("_c")).distinct()
    joined = every.join(found, every["_c"].eqNullSafe(found["conv_id"]), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in _COUNTS]
    return joined.select(F.col("_c").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
