"""Ingest of arriving documents into a catalog as micro-batches (an upsert per batch)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from foliomatch.sources.catalog import Catalog


def upsert_stream(arriving: DataFrame, catalog: Catalog, checkpoint: str):
    """A streaming query that upserts every batch, each once: the catalog keeps the number of the last batch of this checkpoint, and a
    batch that Spark repeats after a restart isn't written again."""
    return arriving.writeStream.foreachBatch(lambda rows, i: catalog.upsert(rows, batch=(checkpoint, i))).option("checkpointLocation", checkpoint).start()
