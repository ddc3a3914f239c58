"""Micro-batches of facts into the warehouse, by the same rule as batch loads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from millrace.operators import increments
from millrace.operators.warehouse import Change, Increment, Warehouse


def stream_into(
    warehouse: Warehouse, facts: DataFrame, checkpoint: str, name: str = "fact_sales", maintain: Callable[[Increment], dict[str, Change]] | None = increments.star_tables, folders: int = 50, **trigger
) -> StreamingQuery:
    """Load each micro-batch of a streaming DataFrame of facts, and bring the tables that depend on them up to date.

    A batch that runs again after a failure inserts nothing twice, since rows are found by key.
    Beyond so many folders the table becomes one folder again.
    """

    def load(batch: DataFrame, _: int) -> None:
        warehouse.load_incremental(batch, name, maintain=maintain)
        warehouse.compact(name, folders)

    return facts.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
