"""Item parameters by marginal maximum likelihood, and links between calibrations by their curves.

``calibrate`` is the EM algorithm over a grid of ability. A round takes the log-likelihood of each
person's responses at every node, from it the person's posterior, and each item's expected numbers of
persons and of successes at every node. An item's slope and intercept then follow from its own 2 x nodes numbers, in its row.
The marginal log-likelihood, a sum over persons, never falls and is the stopping rule.

Responses are written once, in ranges of persons: a row has ``CHUNK`` responses of whole persons, as numbers of items and of persons
that a round's kernel takes as arrays. Items are broadcast as arrays by their number; a task adds up all of its chunks, and only its
sums an item are shuffled. Persons with more than ``LONG`` responses, or all if there are more than ``ITEMS`` items, stay plain rows,
which meet items and posteriors by shuffles in every round.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import pairwise

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import finite
from ..functions.ranks import joined_null_safe
from ..functions.rounds import Table
from .irt import probability_2pl

NODES, LOW, HIGH = 21, -4.0, 4.0
#: Responses that a person in a chunk may have, items that may be broadcast, responses that a kernel takes together, and parts of persons that are counted to find long ones.
LONG, ITEMS, CHUNK, PARTS = 100_000, 1_000_000, 1 << 17, 1 << 16


def grid(low: float = LOW, high: float = HIGH, nodes: int = NODES) -> tuple[list[float], list[float]]:
    """Equally spaced nodes and their shares of a standard normal distribution."""
    at = [low + (high - low) * k / (nodes - 1) for k in range(nodes)]
    mass = [math.exp(-t * t / 2) for t in at]
    return at, [m / sum(mass) for m in mass]


def tabulated(items: DataFrame, item: str, thetas: Sequence[float], slope: str = "slope", intercept: str = "intercept") -> DataFrame:
    """item, ``_right`` and ``_wrong``: logarithms of the probabilities of both responses at every node."""
    nodes = F.array(*map(F.lit, thetas))
    eta = F.transform(nodes, lambda t: F.col(slope) * t + F.col(intercept))
    log_expit = lambda e: F.least(e, F.lit(0.0)) - F.log1p(F.exp(-F.abs(e)))
    return items.select(item, F.transform(eta, log_expit).alias("_right"), F.transform(eta, lambda e: log_expit(-e)).alias("_wrong"))


def _summed(of: str, n: int) -> Column:
    """Sums of n values as an array; of has a place for their number."""
    return F.expr("array(" + ", ".join(f"sum({of.format(k)})" for k in range(n)) + ")")


def posteriors(rows: DataFrame, tables: DataFrame, person: str, item: str, weights: Sequence[float]) -> DataFrame:
    """person, n, ``_w`` (posterior over the nodes) and ``_ll`` (marginal log-likelihood); rows: person, item, ``_y``."""
    met = joined_null_safe(rows, tables, [item]).withColumn("_l", F.when(F.col("_y") > 0.5, F.col("_right")).otherwise(F.col("_wrong")))
    sums = met.groupBy(person).agg(F.count("*").alias("n"), _summed("_l[{}]", len(weights)).alias("_l"))
    logs = sums.withColumn("_l", F.zip_with("_l", F.array(*(F.lit(math.log(w)) for w in weights)), lambda x, w: x + w)).withColumn("_top", F.array_max("_l"))
    parts = logs.withColumn("_w", F.transform("_l", lambda x: F.exp(x - F.col("_top"))))
    total = parts.withColumn("_z", F.aggregate("_w", F.lit(0.0), lambda a, x: a + x))
    return total.select(person, "n", F.transform("_w", lambda x: x / F.col("_z")).alias("_w"), (F.col("_top") + F.ln("_z")).alias("_ll"))


def _improved(thetas: Sequence[float], rasch: bool, item: str):
    """The kernel over items with their expected numbers: a few Newton steps for slope and intercept, from where they are. The row without an item keeps its first number as slope."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        t = np.array(thetas)
        for batch in batches:
            for total in batch.filter(batch.column(item).is_null()).column("_s"):
                yield pa.RecordBatch.from_arrays([pa.nulls(1, batch.column(item).type), pa.array([total[0].as_py()]), pa.array([None], pa.float64())], names=[item, "slope", "intercept"])
            batch = batch.filter(batch.column(item).is_valid())
            if not batch.num_rows:
                continue
            n, r = np.split(batch.column("_s").flatten().to_numpy().reshape(batch.num_rows, -1), 2, axis=1)
            a, d = (batch.column(c).to_numpy() for c in ("slope", "intercept"))

            def value(a, d, n=n, r=r):
                eta = a[:, None] * t + d[:, None]
                return (r * eta - n * np.logaddexp(0, eta)).sum(axis=1)

            now = value(a, d)
            for _ in range(8):
                p = 1 / (1 + np.exp(-(a[:, None] * t + d[:, None])))
                e, v = r - n * p, n * p * (1 - p)
                g0, g1 = e.sum(axis=1), (e * t).sum(axis=1)
                h0, h1, h2 = v.sum(axis=1), (v * t).sum(axis=1), (v * t * t).sum(axis=1)
                det = np.maximum(h0 * h2 - h1 * h1, 1e-300)
                step = (np.zeros_like(a), g0 / np.maximum(h0, 1e-300)) if rasch else ((h0 * g1 - h1 * g0) / det, (h2 * g0 - h1 * g1) / det)
                size = np.ones_like(a)
                for _ in range(20):
                    trial = value(a + size * step[0], d + size * step[1])
                    worse = ~(trial >= now - 1e-12 * np.abs(now))
                    if not worse.any():
                        break
                    size = np.where(worse, size / 2, size)
                size = np.where(worse, 0.0, size)
                a, d = a + size * step[0], d + size * step[1]
                if np.abs(size * step).max() < 1e-8:  # the next step would be in the last digit
                    break
                now = value(a, d)
            yield pa.RecordBatch.from_arrays([batch.column(item), pa.array(a), pa.array(d)], names=[item, "slope", "intercept"])

    return run


def _whole_persons(batches):
    """Arrays of persons' arrays with about CHUNK responses together."""
    import numpy as np
    import pyarrow as pa

    held, n = [], 0
    for batch in batches:
        held.append(batch.column(0))
        n += len(held[-1].flatten())
        if n < CHUNK:
            continue
        of = pa.concat_arrays(held)
        lengths = of.value_lengths().to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff((np.cumsum(lengths) - lengths) // CHUNK)) + 1)]
        yield from (of.slice(a, b - a) for a, b in pairwise(cuts))
        held, n = [of.slice(cuts[-1])], int(lengths[cuts[-1] :].sum())
    if n:
        yield pa.concat_arrays(held)


def _packed(batches):
    """A row for each chunk of whole persons: ``_code``, twice the number of a response's item and one more if it is right, ``_who``, its person's number in the row, both as bytes, and the
    number of persons. The first responses of all persons come first, then the second ones, so that sums by person don't wait for each other."""
    import numpy as np
    import pyarrow as pa

    for of in _whole_persons(batches):
        lengths = of.value_lengths().to_numpy()
        who = np.repeat(np.arange(len(of)), lengths)
        order = np.argsort(np.arange(len(who)) - np.repeat(np.cumsum(lengths) - lengths, lengths), kind="stable")
        columns = [[x[order].astype(np.int32).tobytes()] for x in (of.flatten().to_numpy(), who)]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.binary()) for c in columns), pa.array([len(of)])], names=["_code", "_who", "_persons"])


def _scored(thetas: Sequence[float], weights: Sequence[float], item: str, known: Broadcast, errors: bool):
    """The kernel over chunks with slopes and intercepts by number of item: ``_s`` of an item has its expected numbers of persons and of successes over all of the task's chunks, that without an
    item the log-likelihood first; with errors, sums of squares and products of person scores by the slopes and intercepts that follow in known."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        t, mass = np.array(thetas), np.log(np.array(weights))
        nodes, items = range(len(t)), known.value.shape[1]

        def by_code(slope, intercept, wrong_and_right):
            out = np.empty((len(t), 2 * items))
            for k in nodes:
                out[k, ::2], out[k, 1::2] = wrong_and_right(slope * t[k] + intercept)
            return out

        def logs(eta):
            tail = np.log1p(np.exp(-np.abs(eta)))
            return np.minimum(-eta, 0) - tail, np.minimum(eta, 0) - tail

        def misses(eta):
            p = 1 / (1 + np.exp(-eta))
            return -p, 1 - p

        def packed(numbers, sums):
            each = pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1) * sums.shape[1], pa.int32()), pa.array(sums.ravel()))
            return pa.RecordBatch.from_arrays([numbers, each], names=[item, "_s"])

        total = table = None
        likelihood = 0.0
        for row in (row for batch in batches for row in zip(*batch.columns, strict=True)):
            if table is None:
                table = by_code(*known.value[:2], logs)
                total, seen = np.zeros((3 if errors else len(t), 2 * items)), np.zeros(2 * items, bool)
                miss = by_code(*known.value[2:], misses) if errors else None
            code, who = (np.frombuffer(x.as_buffer(), np.int32).astype(np.int64) for x in row[:2])
            seen[code] = True
            persons = row[2].as_py()
            each, top, z = np.empty(len(code)), np.full(persons, -np.inf), np.zeros(persons)
            shares = [np.bincount(who, np.take(table[k], code, out=each, mode="clip"), persons) for k in nodes]
            for k in nodes:
                shares[k] += mass[k]
                np.maximum(top, shares[k], out=top)
            for share in shares:
                share -= top
                z += np.exp(share, out=share)
            likelihood += float((top + np.log(z)).sum())
            z = 1 / z
            for share in shares:
                share *= z
            if errors:
                d, a = np.zeros(len(code)), np.zeros(len(code))
                for k in nodes:
                    np.take(shares[k], who, out=each, mode="clip")
                    each *= miss[k][code]
                    d += each
                    a += each * t[k]
            for k, of in enumerate((a * a, a * d, d * d) if errors else shares):
                np.add.at(total[k], code, of if errors else np.take(of, who, out=each, mode="clip"))
        if total is None:
            return
        found = np.flatnonzero(seen[::2] | seen[1::2])
        for k in range(0, len(found), 8192):
            some = found[k : k + 8192]
            wrong, right = total[:, 2 * some], total[:, 2 * some + 1]
            yield packed(pa.array(some.astype(np.int32)), np.vstack([wrong + right, *([] if errors else [right])]).T)
        if not errors:
            yield packed(pa.nulls(1, pa.int32()), np.array([[likelihood] + [0.0] * (2 * len(t) - 1)]))

    return run


@dataclass(frozen=True)
class _Responses:
    """Responses of items that are estimated: chunks of whole persons, and plain rows of the other persons."""

    nested: DataFrame | None
    plain: DataFrame | None
    person: str
    item: str
    thetas: list[float]
    weights: list[float]

    def known(self, items: DataFrame, *columns: str) -> Broadcast | None:
        """Those columns, slope and intercept at least, as arrays by number of item."""
        if not self.nested:
            return None
        found = items.select(self.item, "slope", "intercept", *columns).toArrow()
        import numpy as np

        out = np.empty((found.num_columns - 1, found.num_rows))
        out[:, found[0].to_numpy()] = [c.to_numpy() for c in found.columns[1:]]
        return self.nested.sparkSession.sparkContext.broadcast(out)

    def _kernel(self, known: Broadcast, errors: bool) -> DataFrame:
        return self.nested.mapInArrow(_scored(self.thetas, self.weights, self.item, known, errors), f"`{self.item}` int, _s array<double>")

    def posteriors(self, items: DataFrame) -> DataFrame | None:
        return posteriors(self.plain, tabulated(items, self.item, self.thetas), self.person, self.item, self.weights) if self.plain else None

    def expected(self, items: DataFrame, known: Broadcast | None, posterior: DataFrame | None) -> DataFrame:
        """item and ``_s``, the expected numbers of persons and of successes at every node; in the row without an item, the log-likelihood and zeros."""
        n = len(self.thetas)
        parts = [self._kernel(known, False)] if known else []
        if posterior:
            met = joined_null_safe(self.plain, posterior.select(self.person, "_w"), [self.person])
            sums = met.groupBy(self.item).agg(_summed("_w[{}]", n).alias("_n"), _summed("_y * _w[{}]", n).alias("_r"))
            parts.append(sums.select(self.item, F.concat("_n", "_r").alias("_s")))
            total = posterior.agg(F.sum("_ll").alias("_ll")).dropna()
            parts.append(total.select(F.lit(None).cast(dict(items.dtypes)[self.item]).alias(self.item), F.concat(F.array("_ll"), F.array_repeat(F.lit(0.0), 2 * n - 1)).alias("_s")))
        return reduce(DataFrame.union, parts).groupBy(self.item).agg(_summed("_s[{}]", 2 * n).alias("_s"))

    def squares(self, before: DataFrame, items: DataFrame) -> Table:
        """item, aa, ad and dd: sums over persons of squares and products of their scores at items, with their posteriors at the items before."""
        later = items.select(self.item, F.col("slope").alias("_slope"), F.col("intercept").alias("_intercept"))
        known = self.known(joined_null_safe(before, later, [self.item]), "_slope", "_intercept")
        parts = [self._kernel(known, True)] if known else []
        if self.plain:
            met = joined_null_safe(joined_null_safe(self.plain, later, [self.item]), self.posteriors(before).select(self.person, "_w"), [self.person])
            nodes = F.array(*map(F.lit, self.thetas))
            miss = met.withColumn("_e", F.transform(nodes, lambda t: F.col("_y") - probability_2pl(t, F.col("_slope"), -F.col("_intercept") / F.col("_slope"))))
            dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
            scored = miss.select(self.item, dot("_w", F.col("_e")).alias("_d"), dot("_w", F.zip_with("_e", nodes, lambda e, t: e * t)).alias("_a"))
            parts.append(scored.groupBy(self.item).agg(F.expr("array(sum(_a * _a), sum(_a * _d), sum(_d * _d))").alias("_s")))
        sums = reduce(DataFrame.union, parts).groupBy(self.item).agg(_summed("_s[{}]", 3).alias("_s"))
        found = Table(sums.select(self.item, *(F.col("_s")[k].alias(c) for k, c in enumerate(("aa", "ad", "dd")))), "calibration-squares")
        if known:
            known.destroy()
        return found


def _laid_out(rows: DataFrame, number: int, person: str, item: str, many: bool, thetas: list[float], weights: list[float]) -> _Responses:
    """rows, about number of them: person, item (its number, unless many) and ``_y``. many: more items than may be broadcast."""
    if many:
        return _Responses(None, Table(rows, "calibration-used").df, person, item, thetas, weights)
    # a long person is in a part with many responses, and mostly there is none
    part = F.pmod(F.hash(person), F.lit(PARTS))
    large = Table(rows.groupBy(part.alias("_part")).count().filter(F.col("count") > LONG).select("_part"), "calibration-parts").df
    short, plain = rows, None
    if not large.isEmpty():
        near = rows.withColumn("_part", part).join(F.broadcast(large), "_part")
        long = Table(near.groupBy(person).count().filter(F.col("count") > LONG).select(person), "calibration-long").df
        if not long.isEmpty():
            marked = joined_null_safe(rows, long.withColumn("_long", F.lit(True)), [person], "left")
            short, plain = marked.filter("_long IS NULL").drop("_long"), Table(marked.filter("_long").drop("_long"), "calibration-used").df
    code = (F.col(item) * 2 + F.col("_y").cast("int")).alias("_code")
    # as many ranges for each core, of at most some 32 chunks, so that the tasks of a round end together
    cores, pieces = rows.sparkSession.sparkContext.defaultParallelism, number // CHUNK + 1
    ranges = pieces if pieces < cores else cores * math.ceil(pieces / (32 * cores))
    chunks = short.select(person, code).repartitionByRange(ranges, person).groupBy(person).agg(F.collect_list("_code").alias("_of")).select("_of").mapInArrow(_packed, "_code binary, _who binary, _persons long")
    return _Responses(Table(chunks, "calibration-persons").df, plain, person, item, thetas, weights)


@dataclass(frozen=True)
class Calibration:
    """items: item, n, status, a, b and their standard errors; log_likelihoods: of each round; converged."""

    items: DataFrame
    log_likelihoods: list[float]
    converged: bool


def calibrate(responses: DataFrame, person: str, item: str, response: str = "response", rasch: bool = False, least: int = 10, tolerance: float = 1e-6, rounds: int = 60, nodes: int = NODES) -> Calibration:
    """Two-parameter logistic items (slope 1 with rasch) for standard normal ability, from responses of 0 and 1 in long form.

    Persons and items may have any part of the responses. Missing and non-finite responses and null items take no part; null persons are one person. Items with fewer than least responses are
    ``insufficient_data``, items that all or none solve ``extreme``; neither takes part in the rounds. It ends where a round gains less than tolerance times
    the log-likelihood. Standard errors come from the sums of squared person scores of each item alone (the other items held fixed)."""
    thetas, weights = grid(nodes=nodes)
    every = Table(responses.select(person, item, finite(response).alias("_y")).filter(F.col("_y").isin(0.0, 1.0) & F.col(item).isNotNull()), "calibration-rows")
    counts = every.df.groupBy(item).agg(F.count("*").alias("n"), F.avg("_y").alias("_p"))
    status = F.when(F.col("n") < least, "insufficient_data").when(F.col("_p").isin(0.0, 1.0), "extreme").otherwise("estimated")
    counts = Table(counts.withColumn("status", status), "calibration-items")
    good = counts.df.filter("status = 'estimated'").select(item, "n", "_p")
    many, number = good.agg(F.count("*") > ITEMS, F.coalesce(F.sum("n"), F.lit(0))).first()
    key = item
    if not many:  # items have numbers from zero in their order
        key, each = "_number", good.agg(F.sort_array(F.collect_list(F.struct(item, "_p"))).alias("_of"))
        good = Table(each.select(F.posexplode("_of").alias(key, "_i")).select(key, f"_i.`{item}`", "_i._p"), "calibration-numbers").df
    numbers = good.select(*{item: 0, key: 0})
    met = joined_null_safe(every.df, numbers, [item]) if many else every.df.join(F.broadcast(numbers), item)
    rows = _laid_out(met.select(person, key, "_y"), number, person, key, many, thetas, weights)
    every.drop()
    states = [Table(good.select(key, F.lit(1.0).alias("slope"), F.ln(F.col("_p") / (1 - F.col("_p"))).alias("intercept")), "calibration-state")]
    items = before = states[0].df
    found: list[float] = []
    converged = False
    schema = f"`{key}` {dict(items.dtypes)[key]}, slope double, intercept double"
    for _ in range(rounds):
        # a round's table: the improved items, and in the row without an item the log-likelihood of those before
        posterior = Table(rows.posteriors(items), "calibration-posterior") if rows.plain else None
        known = rows.known(items)
        sums = rows.expected(items, known, posterior.df if posterior else None)
        new = Table(joined_null_safe(sums, items, [key], "left").mapInArrow(_improved(thetas, rasch, key), schema), "calibration-state")
        if known:
            known.destroy()
        for old in [*([posterior] if posterior else []), *states[:-1]]:
            old.drop()
        states = [states[-1], new]
        total = new.df.filter(F.col(key).isNull()).agg(F.sum("slope")).first()[0]
        before = items
        if total is None:
            converged = True
            break
        found.append(total)
        if len(found) > 1 and abs(found[-1] - found[-2]) < tolerance * abs(found[-1]):
            converged = True
            break
        items = new.df.filter(F.col(key).isNotNull())
    errors = _standard_errors(rows.squares(before, items).df, items, key, rasch) if found else items.select(key, F.lit(None).cast("double").alias("a_se"), F.lit(None).cast("double").alias("b_se"))
    fitted = joined_null_safe(items.select(key, F.col("slope").alias("a"), (-F.col("intercept") / F.col("slope")).alias("b")), errors, [key])
    fitted = fitted if many else fitted.join(numbers, key).drop(key)
    return Calibration(joined_null_safe(counts.df.select(item, "n", "status"), fitted, [item], "left"), found, converged)


def _standard_errors(squares: DataFrame, items: DataFrame, item: str, rasch: bool) -> DataFrame:
    sums = joined_null_safe(squares, items, [item])
    if rasch:
        return sums.select(item, F.lit(None).cast("double").alias("a_se"), F.try_divide(F.lit(1.0), F.sqrt("dd")).alias("b_se"))
    det = F.col("aa") * F.col("dd") - F.col("ad") * F.col("ad")
    va, vd, c = F.try_divide("dd", det), F.try_divide("aa", det), F.try_divide(-F.col("ad"), det)
    # b = -d / a: its variance by the delta method
    a, d = F.col("slope"), F.col("intercept")
    vb = (d * d / (a * a) * va + vd - 2 * d / a * c) / (a * a)
    return sums.select(item, F.when(va > 0, F.sqrt(va)).alias("a_se"), F.when(vb > 0, F.sqrt(vb)).alias("b_se"))


def curve_link(reference: DataFrame, focal: DataFrame, item: str, method: str = "stocking_lord", low: float = LOW, high: float = HIGH, nodes: int = 41, rounds: int = 60) -> DataFrame:
    """One row: A and B of the line that puts focal abilities on the reference scale, by the curves of the items that both have.

    ``stocking_lord`` compares the tests' curves and ``haebara`` every item's, in squared differences weighted by a standard normal grid. Gauss-Newton with halved steps from
    mean and sigma: a round is one aggregate over items and nodes. Items with a null or non-finite parameter take no part; with fewer than two items, or none that differ in difficulty, A and B are null."""
    if method not in ("stocking_lord", "haebara"):
        raise ValueError(f"unknown method: {method}")
    thetas, weights = grid(low, high, nodes)
    named = lambda df, x: df.select(item, finite("a").alias(f"{x}a"), finite("b").alias(f"{x}b"))
    both = Table(named(reference, "r").join(named(focal, "f"), item).dropna(), "link-items").df
    start = both.agg(F.count("*"), F.try_divide(F.stddev_samp("rb"), F.stddev_samp("fb")), F.avg("rb"), F.avg("fb")).first()
    spark = both.sparkSession
    schema = "method string, n_anchors long, A double, B double, loss double, rounds int"
    if start[0] < 2 or not start[1]:
        return spark.createDataFrame([(method, start[0], None, None, None, 0)], schema)
    node = F.explode(F.arrays_zip(F.array(*map(F.lit, thetas)).alias("t"), F.array(*map(F.lit, weights)).alias("w")))

    def sums(a: float, b: float):
        """Loss, gradient and Gauss-Newton matrix at A, B: the focal item has slope fa / A and difficulty A fb + B on the reference scale."""
        x = both.withColumn("_n", node).select("*", F.col("_n.t").alias("t"), F.col("_n.w").alias("w"))
        slope = F.col("fa") / a
        p = probability_2pl(F.col("t"), slope, a * F.col("fb") + b)
        v = p * (1 - p)
        # derivatives of fa (t - B) / A - fa fb by A and B
        da, db = v * F.col("fa") * -(F.col("t") - b) / (a * a), v * -slope
        gap = probability_2pl(F.col("t"), F.col("ra"), F.col("rb")) - p
        rows = x.select("t", "w", gap.alias("g"), da.alias("da"), db.alias("db"))
        if method == "stocking_lord":
            rows = rows.groupBy("t", "w").agg(*(F.sum(c).alias(c) for c in ("g", "da", "db")))
        g, u, s, w = (F.col(c) for c in ("g", "da", "db", "w"))
        return rows.agg(F.sum(w * g * g), F.sum(w * g * u), F.sum(w * g * s), F.sum(w * u * u), F.sum(w * u * s), F.sum(w * s * s)).first()

    a, b = start[1], start[2] - start[1] * start[3]
    now = sums(a, b)
    done = 0
    for done in range(1, rounds + 1):
        _, ga, gb, aa, ab, bb = now
        det = aa * bb - ab * ab
        if det <= 1e-14 * aa * bb:
            break
        step = ((bb * ga - ab * gb) / det, (aa * gb - ab * ga) / det)
        size = 1.0
        while True:
            trial = (a + size * step[0], b + size * step[1])
            new = sums(*trial) if trial[0] > 0 else None
            if (new and new[0] <= now[0]) or size < 1e-6:
                break
            size /= 2
        if new is None or new[0] > now[0]:
            break
        moved = max(abs(trial[0] - a), abs(trial[1] - b))
        (a, b), now = trial, new
        if moved < 1e-9:
            break
    return spark.createDataFrame([(method, start[0], a, b, now[0], done)], schema)
