"""Shared plumbing of the training-data operators: table access, written intermediates, size checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomatch.sources.intermediate import written as written

#: A side of a join is broadcast only if it was counted and has at most this many rows.
BROADCAST_ROWS = 100_000

#: ASCII white space that separates words, as a regular-expression character class body.
WS = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a written table if its counted rows are within the bound; else leave the join to Spark."""
    return F.broadcast(df) if df.count() <= bound else df


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each made longer until no column of df has it (upper and lower case are one to Spark)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_slices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """First columns and texts (second columns, null as empty) of batches, in slices of about `size` bytes
    of text, or of one row. The cast comes before the slice: kernels misread a cast slice's offsets."""
    for batch in batches:
        texts = pc.fill_null(batch.column(1).cast(pa.large_string()), "")
        n = np.cumsum(np.asarray(pc.binary_length(texts)).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(n, (n[at - 1] if at else 0) + size)))
            yield batch.column(0).slice(at, end - at), texts.slice(at, end - at)
            at = end
