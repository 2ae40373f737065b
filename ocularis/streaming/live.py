"""Structured Streaming forms of the windowed, session and stateful operators. Each is checked against its batch form."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import finite


def sliding_windows(stream: DataFrame, ts: str, by: list[str], value: str, width: str, step: str, late: str) -> DataFrame:
    """Count and mean of a value in sliding event-time windows; rows later than the watermark are left out."""
    grouped = stream.withWatermark(ts, late).groupBy(*by, F.window(ts, width, step).alias("w"))
    return grouped.agg(F.count("*").alias("n"), F.avg(finite(value)).alias("mean")).select(*by, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "mean")


def session_visits(stream: DataFrame, ts: str, by: list[str], aoi: str, gap: str, late: str) -> DataFrame:
    """Visits to an AOI: sessions of its rows with no pause longer than the gap."""
    grouped = stream.filter(F.col(aoi).isNotNull()).withWatermark(ts, late).groupBy(*by, aoi, F.session_window(ts, gap).alias("s"))
    return grouped.agg(F.count("*").alias("n_samples"), F.min(ts).alias("start_time"), F.max(ts).alias("last_time")).drop("s")


def streaming_eap(responses: DataFrame, person: str, low: float = -4.0, high: float = 4.0, points: int = 81) -> DataFrame:
    """Ability after each batch of responses (person, a, b, response), kept as a person's log-posterior on a grid."""
    import numpy as np
    import pandas as pd

    grid = np.linspace(low, high, points)

    def update(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, logs = (state.get[0], np.frombuffer(state.get[1])) if state.exists else (0, -(grid**2) / 2)
        for pdf in batches:
            for a, b, x in zip(pdf["a"], pdf["b"], pdf["response"], strict=True):
                p = 1 / (1 + np.exp(-a * (grid - b)))
                logs = logs + np.log(p if x > 0 else 1 - p)
                n += 1
        state.update((n, logs.tobytes()))
        w = np.exp(logs - logs.max())
        w = w / w.sum()
        mean = float((w * grid).sum())
        yield pd.DataFrame({person: [key[0]], "n_items": [n], "theta": [mean], "se": [float(np.sqrt(max(0.0, (w * grid**2).sum() - mean**2)))]})

    kind = dict(responses.dtypes)[person]
    return responses.groupBy(person).applyInPandasWithState(update, f"{person} {kind}, n_items long, theta double, se double", "n long, logs binary", "update", "NoTimeout")
