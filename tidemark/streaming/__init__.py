"""Streams as a source of changes: each micro-batch is one statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..engine import ViewEngine


def inserts_into(engine: ViewEngine, table: str, source: str = "stream") -> Callable[[DataFrame, int], None]:
    """For writeStream.foreachBatch: inserts each batch of a source once, whatever is retried or
    restarted, as a batch's number is published with its rows."""

    def run(batch: DataFrame, number: int) -> None:
        with engine.transaction():
            if engine.begin_batch(table, source, number):
                engine.insert(table, batch)

    return run
