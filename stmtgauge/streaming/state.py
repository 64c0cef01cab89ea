"""Tables that grow batch by batch, as logs of changes.

Each micro-batch writes what it adds and nothing else; after every so many batches the changes are merged into a base.
What a batch writes follows the batch, not the table, and what a reader merges is one base and a bounded number of
changes. A repeated batch replaces its own folder and reads what the first attempt read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from stmtgauge.sources.storage import if_present, remove


class ChangeLog:
    """A table under ``path``: ``merge`` gives the sum of two tables of ``schema``, in any order and grouping."""

    def __init__(self, path: str, schema: str, merge: Callable[[DataFrame, DataFrame], DataFrame], every: int = 8):
        self.path, self.schema, self.merge, self.every = path.rstrip("/"), schema, merge, every

    def _folder(self, kind: str, batch_id: int) -> str:
        return f"{self.path}/{kind}/batch={batch_id}"

    def _read(self, spark: SparkSession, kind: str, batch_id: int) -> DataFrame:
        found = if_present(lambda: spark.read.schema(self.schema).parquet(self._folder(kind, batch_id)))
        if found is None:
            raise FileNotFoundError(f"no {kind} of batch {batch_id} under {self.path}")
        return found

    def before(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """The table before a batch: the base of the batch before the last multiple of ``every``, and the changes since."""
        first = batch_id // self.every * self.every
        table = self._read(spark, "base", first - 1) if first else spark.createDataFrame([], self.schema)
        changes = None
        for b in range(first, batch_id):
            found = self._read(spark, "changes", b)
            changes = found if changes is None else changes.unionByName(found)
        return table if changes is None else self.merge(table, changes)

    def append(self, change: DataFrame, batch_id: int) -> None:
        """Write what a batch adds; the last batch before a multiple of ``every`` also writes a base.

        The batch before is committed by then, so what only earlier ones read goes.
        """
        spark, done = change.sparkSession, batch_id + 1
        change.write.mode("overwrite").parquet(self._folder("changes", batch_id))
        if done % self.every == 0:
            first = done - self.every
            table = self._read(spark, "base", first - 1) if first else spark.createDataFrame([], self.schema)
            for b in range(first, done):
                found = self._read(spark, "changes", b)
                changes = found if b == first else changes.unionByName(found)
            self.merge(table, changes).write.mode("overwrite").parquet(self._folder("base", batch_id))
            for b in range(first - self.every, first):
                remove(spark, self._folder("changes", b))
            remove(spark, self._folder("base", first - 1 - self.every))


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """Keep a batch result for the steps that share it; partitions lost with an executor are computed again."""
    df = df.persist()
    try:
        yield df
    finally:
        df.unpersist()
