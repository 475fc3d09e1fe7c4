"""Small helpers the operators of this package share."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# The ASCII white space every operator here splits at or deletes: space, \t \n \v \f \r.
BLANK = b" \t\n\x0b\x0c\r"


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column; null counts as empty."""
    return [b"" if value is None else value for value in column.cast(pa.binary()).to_pylist()]


ROWS_AT_ONCE = 1000


def few_rows_at_once(df: DataFrame) -> DataFrame:
    """``df``, with the session set to hand at most ``ROWS_AT_ONCE`` rows to a Python worker at a time.

    Texts can be long; this bounds the buffers on both sides. It is a setting of the session
    (``spark.sql.execution.arrow.maxRecordsPerBatch``) and only ever made smaller.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(df.sparkSession.conf.get(key))
    if now <= 0 or now > ROWS_AT_ONCE:
        df.sparkSession.conf.set(key, str(ROWS_AT_ONCE))
    return df


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, with as many ``_`` behind them as it takes to clash with no column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def small(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that few texts are Python objects at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
        pa.default_memory_pool().release_unused()


def digest(value: bytes) -> bytes:
    return hashlib.sha256(value).digest()


def rows_of(schema: pa.Schema, columns: list, at_most: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Columns as record batches of a bounded number of rows."""
    batch = pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)],
        schema=schema,
    )
    for start in range(0, batch.num_rows, at_most):
        yield batch.slice(start, at_most)
