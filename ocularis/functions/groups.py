"""Small groups in a sorted stream of Arrow batches: one call of a task for all of its groups, instead of one a group."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

_NAN = float("nan")


def grouped_rows(batches, keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Key and other values of consecutive rows with equal first columns; a group may go on in the next batch. Nulls are equal, and so are NaNs."""
    key: tuple | None = None
    rows: list[tuple] = []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for k in range(keys):
            columns[k] = [_NAN if v != v else v for v in columns[k]]
        rest = list(zip(*columns[keys:], strict=True))
        names = zip(*columns[:keys], strict=True) if keys else [()] * len(rest)
        for name, row in zip(names, rest, strict=True):
            if key is None or name != key:
                if key is not None:
                    yield key, rows
                key, rows = name, []
            rows.append(row)
    if key is not None:
        yield key, rows


def by_group(df: DataFrame, keys: Sequence[str], run: Callable[[list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """The keys with what run makes of each group's other columns. Rows of a group lie in one partition, together and in order; schema is that of all columns."""
    n = len(keys)
    described = StructType.fromDDL(schema)
    fields, types = described.names, [to_arrow_type(f.dataType) for f in described.fields]

    def kernel(batches):
        import pyarrow as pa

        def packed(out: list[tuple]):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=fields)

        out: list[tuple] = []
        for key, rows in grouped_rows(batches, n):
            out += [(*key, *r) for r in run(rows)]
            if len(out) >= 8192:
                yield packed(out)
                out = []
        if out:
            yield packed(out)

    return df.mapInArrow(kernel, schema)
