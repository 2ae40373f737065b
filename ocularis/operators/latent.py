"""Latent classes and hidden states by expectation and maximisation.

A mixture's responsibilities are computed in the row and its next parameters are one aggregate a round.
Hidden states need the whole sequence: sequences are cut into pieces of neighbouring rows, each piece gives the
product of its steps (states x states), the products of a sequence are joined to messages at the
bounds of its pieces, and every piece then runs forward and backward between its messages. So one long
recording is the work of many tasks and the result is that of the whole sequence. Parameters are a few numbers and
live in the driver; expected counts come as sums.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import finite
from ..functions.ranks import bucketed, joined_null_safe, seeded_digest
from ..functions.rounds import Table

#: Least variance of a standardised variable within a class or state.
FLOOR = 1e-4


@dataclass(frozen=True)
class Mixture:
    """Classes in order of the first variable's mean: shares, means and variances (of standardised variables), log-likelihoods of each round."""

    variables: tuple[str, ...]
    centre: tuple[float, ...]
    scale: tuple[float, ...]
    shares: tuple[float, ...]
    means: tuple[tuple[float, ...], ...]
    variances: tuple[tuple[float, ...], ...]
    log_likelihoods: tuple[float, ...]
    n: int
    converged: bool

    @property
    def parameters(self) -> int:
        k, p = len(self.shares), len(self.variables)
        return k - 1 + 2 * k * p

    @property
    def aic(self) -> float:
        return -2 * self.log_likelihoods[-1] + 2 * self.parameters

    @property
    def bic(self) -> float:
        return -2 * self.log_likelihoods[-1] + math.log(self.n) * self.parameters

    def classified(self, df: DataFrame) -> DataFrame:
        """df with ``class`` (from 1; null where a variable is missing; of equal probabilities the first) and ``probabilities``."""
        z = [(finite(v) - c) / s for v, c, s in zip(self.variables, self.centre, self.scale, strict=True)]
        met = df.withColumns({f"_z{k}": x for k, x in enumerate(z)}).withColumn("_l", F.array(*_log_densities(self.shares, self.means, self.variances)))
        whole = F.lit(True)
        for k in range(len(z)):
            whole = whole & F.col(f"_z{k}").isNotNull()
        met = met.withColumn("_w", F.transform("_l", lambda x: F.exp(x - F.array_max("_l"))))
        total = F.aggregate("_w", F.lit(0.0), lambda a, x: a + x)
        found = {"class": F.when(whole, F.array_position("_l", F.array_max("_l")).cast("int")), "probabilities": F.when(whole, F.transform("_w", lambda x: x / total))}
        return met.withColumns(found).drop("_l", "_w", *(f"_z{k}" for k in range(len(z))))

    def summary(self, spark) -> DataFrame:
        """class, share, and mean and sd of every variable on its own scale."""
        rows = [(k + 1, self.shares[k], v, self.means[k][j] * self.scale[j] + self.centre[j], math.sqrt(self.variances[k][j]) * self.scale[j]) for k in range(len(self.shares)) for j, v in enumerate(self.variables)]
        return spark.createDataFrame(rows, "class int, share double, variable string, mean double, sd double")


def _log_densities(shares, means, variances) -> list[Column]:
    """Of each class, the logarithm of its share times the density at the columns _z0, _z1, ..."""
    out = []
    for w, m, v in zip(shares, means, variances, strict=True):
        constant = math.log(max(w, 1e-300)) - sum(math.log(2 * math.pi * x) for x in v) / 2
        out.append(sum((-(F.col(f"_z{k}") - a) * (F.col(f"_z{k}") - a) / (2 * x) for k, (a, x) in enumerate(zip(m, v, strict=True))), F.lit(constant)))
    return out


def standardised(df: DataFrame, variables: Sequence[str], keep: Sequence[str] = ()) -> tuple[DataFrame, list[float], list[float], int]:
    """Rows that have all variables with ``_z0``, ``_z1``, ... as a table, centres, scales and their number; a variable that doesn't vary raises an error."""
    rows = df.select(*keep, *(finite(v).alias(f"_v{k}") for k, v in enumerate(variables))).dropna(subset=[f"_v{k}" for k in range(len(variables))])
    row = rows.agg(F.count("*"), *(f(f"_v{k}") for k in range(len(variables)) for f in (F.avg, F.stddev_samp))).first()
    n, centre, scale = row[0], list(row[1::2]), list(row[2::2])
    if n == 0 or any(not s for s in scale):
        raise ValueError("every variable must vary")
    scaled = rows.select(*keep, *((F.col(f"_v{k}") - centre[k]).__truediv__(scale[k]).alias(f"_z{k}") for k in range(len(variables))))
    return Table(scaled, "latent-rows").df, centre, scale, n


def _round(rows: DataFrame, models: list[tuple], p: int) -> list[tuple[float, list]]:
    """For several models at once (shares, means, variances): log-likelihood and, by class, sums of responsibilities, of them times the variables, and times their squares."""
    columns = {f"_d{m}_{c}": d for m, model in enumerate(models) for c, d in enumerate(_log_densities(*model))}
    sized = [len(model[0]) for model in models]
    met = rows.withColumns(columns)
    met = met.withColumns({f"_t{m}": F.greatest(*(F.col(f"_d{m}_{c}") for c in range(k))) for m, k in enumerate(sized)})
    met = met.withColumns({f"_s{m}": F.col(f"_t{m}") + F.ln(sum((F.exp(F.col(f"_d{m}_{c}") - F.col(f"_t{m}")) for c in range(k)), F.lit(0.0))) for m, k in enumerate(sized)})
    met = met.withColumns({f"_r{m}_{c}": F.exp(F.col(f"_d{m}_{c}") - F.col(f"_s{m}")) for m, k in enumerate(sized) for c in range(k)})
    sums = []
    for m, k in enumerate(sized):
        sums.append(f"sum(_s{m})")
        for c in range(k):
            sums += [f"sum(_r{m}_{c})", *(f"sum(_r{m}_{c} * _z{j})" for j in range(p)), *(f"sum(_r{m}_{c} * _z{j} * _z{j})" for j in range(p))]
    row = iter(met.selectExpr(*sums).first())
    return [(next(row), [[next(row) for _ in range(1 + 2 * p)] for _ in range(k)]) for k in sized]


def _next(sums: list, n: int, p: int) -> tuple:
    shares, means, variances = [], [], []
    for s in sums:
        w = max(s[0], 1e-12)
        mean = [s[1 + j] / w for j in range(p)]
        shares.append(w / n)
        means.append(mean)
        variances.append([max(s[1 + p + j] / w - mean[j] ** 2, FLOOR) for j in range(p)])
    return shares, means, variances


def fit_mixture(df: DataFrame, variables: Sequence[str], classes: int, key: str, seed: int = 1, starts: int = 4, tries: int = 5, rounds: int = 200, tolerance: float = 1e-8) -> Mixture:
    """A mixture of classes normal with independent variables (standardised by all rows).

    Every start takes as its means the rows with the smallest seeded hashes of key among different values; all starts share the first rounds' aggregates, and the best goes on
    until a round gains less than tolerance of the log-likelihood. Rows with a null or non-finite variable take no part; fewer rows than four a class raise an error."""
    p = len(variables)
    rows, centre, scale, n = standardised(df, variables, [key])
    if n < 4 * classes:
        raise ValueError("too few complete rows for the number of classes")
    models = []
    for s in range(starts):
        ordered = rows.withColumn("_digest", seeded_digest(seed + s, key)).orderBy("_digest", key, *(f"_z{j}" for j in range(p))).limit(classes * 8).collect()
        different: list[list[float]] = []
        for r in ordered:
            z = [r[f"_z{j}"] for j in range(p)]
            if z not in different and len(different) < classes:
                different.append(z)
        if len(different) == classes:
            models.append(([1 / classes] * classes, different, [[1.0] * p] * classes))
    if not models:
        raise ValueError("too few different rows for the number of classes")
    for _ in range(tries):
        found = _round(rows, models, p)
        models = [_next(sums, n, p) for _, sums in found]
    model = models[max(range(len(found)), key=lambda m: found[m][0])]
    history: list[float] = []
    converged = False
    for _ in range(rounds):
        (value, sums), = _round(rows, [model], p)
        history.append(value)
        if len(history) > 1 and history[-1] - history[-2] < tolerance * abs(value):
            converged = True
            break
        model = _next(sums, n, p)
    order = sorted(range(classes), key=lambda c: (model[1][c], model[0][c]))
    pick = lambda part: tuple(tuple(model[part][c]) if part else model[part][c] for c in order)
    return Mixture(tuple(variables), tuple(centre), tuple(scale), pick(0), pick(1), pick(2), tuple(history), n, converged)


def compare_mixtures(df: DataFrame, variables: Sequence[str], numbers: Sequence[int], key: str, seed: int = 1) -> DataFrame:
    """classes, parameters, log_likelihood, aic and bic for several numbers of classes."""
    fits = [fit_mixture(df, variables, k, key, seed) for k in numbers]
    return df.sparkSession.createDataFrame([(len(f.shares), f.parameters, f.log_likelihoods[-1], f.aic, f.bic) for f in fits], "classes int, parameters int, log_likelihood double, aic double, bic double")


# --- hidden states


@dataclass(frozen=True)
class States:
    """Hidden states in order of the first variable's mean; means and sds are of standardised variables."""

    variables: tuple[str, ...]
    centre: tuple[float, ...]
    scale: tuple[float, ...]
    initial: tuple[float, ...]
    transition: tuple[tuple[float, ...], ...]
    means: tuple[tuple[float, ...], ...]
    sds: tuple[tuple[float, ...], ...]
    log_likelihoods: tuple[float, ...]
    converged: bool


#: Most rows of a piece of a sequence of up to DEPTHS times as many rows; longer sequences have proportionally longer pieces.
PIECE = 2048
_SMALL = 1e-6


def _emissions(x, means, sds):
    """Logarithms of the densities, rows x states."""
    import numpy as np

    z = (x[:, None, :] - means[None]) / sds[None]
    return -(z * z + math.log(2 * math.pi)).sum(axis=2) / 2 - np.log(sds).sum(axis=1)[None]


def sequence_pieces(df: DataFrame, sequence: str, order: str, variables: Sequence[str], piece: int = PIECE) -> tuple[DataFrame, list[float], list[float]]:
    """One row a piece: sequence, ``_piece``, ``_last`` (number of the sequence's last piece), ``_orders`` and ``_x`` (arrays of rows in order), as a table; centres and scales.

    Rows without a sequence, a finite order or a variable are left out; of equal orders the smaller variables come first."""
    p = len(variables)
    known = df.filter(F.col(sequence).isNotNull() & finite(order).isNotNull()).withColumn("_order", finite(order))
    rows, centre, scale, _ = standardised(known, variables, [sequence, "_order"])
    counts = rows.groupBy(sequence).agg(F.count("*").alias("_n"))
    met = joined_null_safe(rows, counts.filter(F.col("_n") > piece), [sequence], "left")
    # buckets are of equal depth: neighbouring ones make a piece; short sequences need none
    placed = bucketed(met.filter("_n is not null"), "_order", [sequence])
    long = placed.withColumn("_p", F.floor(F.col("_bucket") * F.least(F.ceil(F.col("_n") / piece), F.lit(256)) / 256).cast("int")).drop("_bucket")
    merged = long.unionByName(met.filter("_n is null").withColumn("_p", F.lit(0)))
    one = F.struct("_order", *(f"_z{j}" for j in range(p)))
    cells = merged.groupBy(sequence, "_p").agg(F.sort_array(F.collect_list(one)).alias("_rows"))
    numbered = Window.partitionBy(sequence).orderBy("_p")
    ranked = cells.withColumns({"_piece": F.row_number().over(numbered) - 1, "_last": F.count("*").over(Window.partitionBy(sequence)) - 1})
    values = F.transform("_rows", lambda r: F.array(*(r[f"_z{j}"] for j in range(p))))
    return Table(ranked.select(sequence, "_piece", F.col("_last").cast("int").alias("_last"), F.transform("_rows", lambda r: r["_order"]).alias("_orders"), values.alias("_x")), "states-pieces").df, centre, scale


#: Steps times pieces of a chunk that the kernels go through at once.
CHUNK = 1 << 18


def _chunks(column, p: int):
    """Pieces of a batch's ``_x`` by falling length, in chunks: their numbers, values (steps x pieces x variables, with zeros behind a piece's end) and for each step how many go on there."""
    import numpy as np

    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    at = 0
    while at < len(order):
        steps = int(lengths[order[at]])
        part = order[at : at + max(1, CHUNK // max(steps, 1))]
        at += len(part)
        inside = np.arange(steps)[:, None] < lengths[part]
        x = np.zeros((steps, len(part), p))
        x[inside] = flat[(np.arange(steps)[:, None] + starts[part])[inside]]
        yield part, x, inside.sum(axis=1)


def _products(model, best: bool):
    """The kernel over pieces of sequences that have several: the scaled product of a piece's steps, or of its best steps, by entering and leaving state."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        initial, transition, means, sds = (np.array(x) for x in model)
        k, p = means.shape
        with np.errstate(divide="ignore"):
            log_step = np.log(transition)
        for batch in batches:
            products, totals = np.zeros((batch.num_rows, k, k)), np.zeros(batch.num_rows)
            start = batch.column("_piece").to_numpy(zero_copy_only=False) == 0
            for part, x, active in _chunks(batch.column("_x"), p):
                logs = _emissions(x.reshape(-1, p), means, sds).reshape(*x.shape[:2], k)
                m = np.tile(np.where(np.eye(k) > 0, 0.0, -np.inf) if best else np.eye(k), (len(part), 1, 1))
                for t, n in enumerate(active):
                    row = logs[t, :n]
                    moved = (m[:n, :, :, None] + log_step).max(axis=2) if best else m[:n] @ transition
                    if t == 0:
                        moved = np.where(start[part][:, None, None], m, moved)
                    if best:
                        m[:n] = moved + row[:, None]
                        continue
                    top = row.max(axis=1)
                    moved = moved * np.exp(row - top[:, None])[:, None]
                    size = moved.max(axis=(1, 2))
                    m[:n] = moved / size[:, None, None]
                    totals[part[:n]] += top + np.log(size)
                products[part] = m
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column("_piece"), pa.array(products.reshape(batch.num_rows, -1).tolist(), pa.list_(pa.float64())), pa.array(totals)], names=[batch.schema.names[0], "_piece", "_m", "_s"])

    return run


def _messages(model, best: bool):
    """The kernel over sequences with their pieces' products: what each piece gets from before and after it."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        initial = np.array(model[0])
        k = len(initial)
        for batch in batches:
            out = []
            for name, parts in zip(batch.column(0).to_pylist(), batch.column("_parts").to_pylist(), strict=True):
                parts.sort(key=lambda r: r["_piece"])
                ms = [np.array(r["_m"]).reshape(k, k) for r in parts]
                if best:
                    with np.errstate(divide="ignore"):
                        scores = [np.log(initial)]
                    backs = []
                    for m in ms:
                        each = scores[-1][:, None] + m
                        backs.append(each.argmax(axis=0))
                        scores.append(each.max(axis=0))
                    leave = int(scores[-1].argmax())
                    states = []
                    for r, back in zip(reversed(parts), reversed(backs), strict=True):
                        enter = int(back[leave])
                        states.append((name, r["_piece"], [float(enter), float(leave)], [], 0.0))
                        leave = enter
                    out += states
                    continue
                forward, total = [initial], 0.0
                for m, r in zip(ms, parts, strict=True):
                    f = forward[-1] @ m
                    total += math.log(f.sum()) + r["_s"]
                    forward.append(f / f.sum())
                back = [np.ones(k)]
                for m in reversed(ms):
                    b = m @ back[-1]
                    back.append(b / b.max())
                back.reverse()
                out += [(name, r["_piece"], forward[i].tolist(), back[i + 1].tolist(), total if i == 0 else 0.0) for i, r in enumerate(parts)]
            kinds = [batch.schema.field(0).type, pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], names=[batch.schema.names[0], "_piece", "_forward", "_back", "_total"])

    return run


def _with_messages(pieces: DataFrame, sequence: str, model, best: bool = False) -> DataFrame:
    """pieces with ``_forward``, ``_back`` and ``_total``, null for sequences of one piece."""
    kind = dict(pieces.dtypes)[sequence]
    products = pieces.filter("_last > 0").select(sequence, "_piece", "_x").mapInArrow(_products(model, best), f"`{sequence}` {kind}, _piece int, _m array<double>, _s double")
    per = products.groupBy(sequence).agg(F.collect_list(F.struct("_piece", "_m", "_s")).alias("_parts"))
    messages = per.mapInArrow(_messages(model, best), f"`{sequence}` {kind}, _piece int, _forward array<double>, _back array<double>, _total double")
    return joined_null_safe(pieces, messages, [sequence, "_piece"], "left")


def _rows_of(batch, parts: list, k: int):
    """Values by row of a batch's pieces, in their order, from chunks (numbers, steps x pieces x k values)."""
    import numpy as np

    lengths = batch.column("_x").value_lengths().to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    out = np.zeros((int(lengths.sum()), k))
    for part, values in parts:
        inside = np.arange(len(values))[:, None] < lengths[part]
        out[(np.arange(len(values))[:, None] + starts[part])[inside]] = values[inside]
    return out, np.repeat(np.arange(len(lengths)), lengths)


def _counts(model, posterior: bool):
    """The kernel over pieces with their messages: forward and backward, many pieces a step; expected counts summed over a batch, or the rows' posteriors."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        initial, transition, means, sds = (np.array(x) for x in model)
        k, p = means.shape
        for batch in batches:
            sums = np.zeros(1 + k + k * k + k + 2 * k * p)
            parts = []
            start = batch.column("_piece").to_numpy(zero_copy_only=False) == 0
            enter = np.array([initial if f is None else f for f in batch.column("_forward").to_pylist()]).reshape(-1, k)
            leave = np.array([np.ones(k) if f is None else f for f in batch.column("_back").to_pylist()]).reshape(-1, k)
            totals = batch.column("_total").to_pylist()
            for part, x, active in _chunks(batch.column("_x"), p):
                logs = _emissions(x.reshape(-1, p), means, sds).reshape(*x.shape[:2], k)
                top = logs.max(axis=2)
                b = np.exp(logs - top[:, :, None])
                first = start[part]
                alpha, beta, scale = np.zeros_like(b), np.zeros_like(b), np.ones(top.shape)
                now = enter[part]
                for t, n in enumerate(active):
                    moved = now[:n] @ transition
                    if t == 0:
                        moved = np.where(first[:, None], now, moved)
                    moved = moved * b[t, :n]
                    scale[t, :n] = moved.sum(axis=1)
                    alpha[t, :n] = now[:n] = moved / scale[t, :n, None]
                for t in range(len(x) - 1, -1, -1):
                    on = active[t + 1] if t + 1 < len(x) else 0
                    beta[t, on : active[t]] = leave[part[on : active[t]]]
                    if on:
                        beta[t, :on] = (b[t + 1, :on] * beta[t + 1, :on]) @ transition.T / scale[t + 1, :on, None]
                gamma = alpha * beta
                inside = np.arange(len(part)) < active[:, None]
                gamma[inside] /= gamma[inside].sum(axis=1, keepdims=True)
                if posterior:
                    parts.append((part, gamma))
                    continue
                before = np.concatenate([enter[part][None], alpha[:-1]])
                counted = inside.copy()
                counted[0] &= ~first
                xi = before[counted][:, :, None] * transition * (b * beta)[counted][:, None, :]
                steps = (xi / xi.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
                values = (np.where(inside, np.log(scale) + top, 0.0)).sum(axis=0)
                value = sum(v if totals[i] is None else totals[i] for i, v in zip(part, values, strict=True))
                g, y = gamma[inside], x[inside]
                sums += np.concatenate([[value], gamma[0][first].sum(axis=0), steps.ravel(), g.sum(axis=0), (g.T @ y).ravel(), (g.T @ (y * y)).ravel()])
            if posterior:
                rows, of = _rows_of(batch, parts, k)
                shares = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * k, pa.int32()), pa.array(rows.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), batch.column("_orders").flatten(), shares], names=[batch.schema.names[0], "_order", "probabilities"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array([sums.tolist()], pa.list_(pa.float64()))], names=["_sums"])

    return run


def _step(pieces: DataFrame, sequence: str, model) -> tuple[float, list[float]]:
    size = 1 + len(model[0]) * (2 + len(model[0]) + 2 * len(model[2][0]))
    found = _with_messages(pieces, sequence, model).mapInArrow(_counts(model, False), "_sums array<double>")
    row = found.selectExpr(*(f"sum(_sums[{k}])" for k in range(size))).first()
    return row[0], list(row[1:])


def fit_states(df: DataFrame, sequence: str, order: str, variables: Sequence[str], states: int, key: str | None = None, seed: int = 1, rounds: int = 60, tolerance: float = 1e-7, piece: int = PIECE) -> tuple[States, DataFrame]:
    """Gaussian hidden states by Baum and Welch, and the table of pieces that paths and posteriors read.

    It starts from the means and deviations of a mixture of as many classes after a few rounds, even initial shares and transitions that stay with probability 0.8. A round's
    log-likelihood never falls but for the least count (1e-6) that keeps every transition possible; it ends where a round gains less than tolerance of it."""
    pieces, centre, scale = sequence_pieces(df, sequence, order, variables, piece)
    start = fit_mixture(df.filter(F.col(sequence).isNotNull() & finite(order).isNotNull()), variables, states, key or order, seed, starts=2, tries=3, rounds=5)
    stay = 0.8 if states > 1 else 1.0
    model = ([1 / states] * states, [[stay if i == j else (1 - stay) / max(states - 1, 1) for j in range(states)] for i in range(states)], [list(m) for m in start.means], [[math.sqrt(v) for v in row] for row in start.variances])
    history: list[float] = []
    converged = False
    k, p = states, len(variables)
    for _ in range(rounds):
        value, sums = _step(pieces, sequence, model)
        history.append(value)
        if len(history) > 1 and abs(history[-1] - history[-2]) < tolerance * abs(value):
            converged = True
            break
        first, steps, weight, one, two = sums[:k], sums[k : k + k * k], sums[k + k * k : 2 * k + k * k], sums[2 * k + k * k : 2 * k + k * k + k * p], sums[2 * k + k * k + k * p :]
        initial = [v + _SMALL for v in first]
        matrix = [[steps[i * k + j] + _SMALL for j in range(k)] for i in range(k)]
        means = [[one[i * p + j] / max(weight[i], 1e-8) for j in range(p)] for i in range(k)]
        sds = [[math.sqrt(max(two[i * p + j] / max(weight[i], 1e-8) - means[i][j] ** 2, FLOOR)) for j in range(p)] for i in range(k)]
        model = ([v / sum(initial) for v in initial], [[v / sum(row) for v in row] for row in matrix], means, sds)
    rank = sorted(range(k), key=lambda i: (model[2][i], model[3][i]))
    ordered = (tuple(model[0][i] for i in rank), tuple(tuple(model[1][i][j] for j in rank) for i in rank), tuple(tuple(model[2][i]) for i in rank), tuple(tuple(model[3][i]) for i in rank))
    return States(tuple(variables), tuple(centre), tuple(scale), *ordered, tuple(history), converged), pieces


def _model(fit: States) -> tuple:
    return ([*fit.initial], [[*r] for r in fit.transition], [[*r] for r in fit.means], [[*r] for r in fit.sds])


def posteriors(fit: States, pieces: DataFrame, sequence: str, order: str) -> DataFrame:
    """sequence, order and ``probabilities`` of the states at every row."""
    kind = dict(pieces.dtypes)[sequence]
    found = _with_messages(pieces, sequence, _model(fit)).mapInArrow(_counts(_model(fit), True), f"`{sequence}` {kind}, _order double, probabilities array<double>")
    return found.withColumnRenamed("_order", order)


def occupancy(fit: States, pieces: DataFrame, sequence: str, order: str) -> DataFrame:
    """A row a sequence: n and the mean probability of each state."""
    rows = posteriors(fit, pieces, sequence, order)
    return rows.groupBy(sequence).agg(F.count("*").alias("n"), *(F.avg(F.get("probabilities", F.lit(k))).alias(f"state_{k + 1}_occupancy") for k in range(len(fit.initial))))


def transition_summary(fit: States, spark) -> DataFrame:
    return spark.createDataFrame([(i + 1, j + 1, p) for i, row in enumerate(fit.transition) for j, p in enumerate(row)], "from_state int, to_state int, probability double")


def paths(fit: States, pieces: DataFrame, sequence: str, order: str) -> DataFrame:
    """sequence, order and ``state`` (from 1) of the most probable path (Viterbi) of every sequence; of equal ones that with the lower states from the end."""
    model = _model(fit)
    kind = dict(pieces.dtypes)[sequence]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        initial, transition, means, sds = (np.array(x) for x in model)
        k = len(initial)
        with np.errstate(divide="ignore"):
            log_start, log_step = np.log(initial), np.log(transition)
        for batch in batches:
            parts = []
            start = batch.column("_piece").to_numpy(zero_copy_only=False) == 0
            # between the states of the joined path, if the sequence has several pieces
            ends = batch.column("_forward").to_pylist()
            for part, x, active in _chunks(batch.column("_x"), means.shape[1]):
                logs = _emissions(x.reshape(-1, means.shape[1]), means, sds).reshape(*x.shape[:2], k)
                now = np.array([log_start if ends[i] is None else np.where(np.arange(k) == int(ends[i][0]), 0.0, -np.inf) for i in part])
                backs, path = np.zeros(logs.shape, int), np.zeros(logs.shape[:2], int)
                for t, n in enumerate(active):
                    each = now[:n, :, None] + log_step
                    backs[t, :n], moved = each.argmax(axis=1), each.max(axis=1)
                    if t == 0:
                        moved = np.where(start[part][:, None], now, moved)
                    now[:n] = moved + logs[t, :n]
                state = np.array([m if ends[i] is None else int(ends[i][1]) for i, m in zip(part, now.argmax(axis=1), strict=True)])
                for t in range(len(x) - 1, -1, -1):
                    n = active[t]
                    path[t, :n] = state[:n]
                    if t:
                        state[:n] = backs[t, np.arange(n), state[:n]]
                parts.append((part, path[:, :, None]))
            states, of = _rows_of(batch, parts, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), batch.column("_orders").flatten(), pa.array(states[:, 0].astype(np.int32) + 1, pa.int32())], names=[batch.schema.names[0], "_order", "state"])

    found = _with_messages(pieces, sequence, model, best=True).mapInArrow(run, f"`{sequence}` {kind}, _order double, state int")
    return found.withColumnRenamed("_order", order)
