"""Hooks to other systems: connectors, exports and notifications of a stream's batches."""

from __future__ import annotations

import hashlib
import hmac
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource


class Connectors:
    """The management systems that a session knows, by name; each is a data source of Spark, so rows are pushed by df.write and pulled by spark.read."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self._known = spark, {}

    def register(self, name: str, source: type[DataSource]) -> None:
        """A source that can be read and written; else a TypeError. A second one of a name takes its place."""
        if not (isinstance(source, type) and issubclass(source, DataSource)) or source.reader is DataSource.reader or source.writer is DataSource.writer:
            raise TypeError(f"{name}: a connector is a data source with a reader and a writer")
        self.spark.dataSource.register(source)
        self._known[name] = source.name()

    def names(self) -> list[str]:
        return sorted(self._known)

    def push(self, name: str, policies: DataFrame, mode: str = "append", **options: str) -> None:
        policies.write.format(self._known[name]).mode(mode).options(**options).save()

    def pull(self, name: str, **options: str) -> DataFrame:
        return self.spark.read.format(self._known[name]).options(**options).load()


def export(df: DataFrame, path: str, by: str, form: str = "csv") -> None:
    """Rows in a folder for each value of ``by``."""
    df.write.mode("overwrite").partitionBy(by).option("header", True).format(form).save(path)


def signature(secret: bytes, body: bytes) -> str:
    return "sha256=" + hmac.new(secret, body, hashlib.sha256).hexdigest()


def dispatcher(send: Callable[[str, dict[str, str], bytes], bool], targets: dict[str, list[str]], secret: bytes, kind: str = "event_type", attempts: int = 3) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: each event goes, signed, to all targets of its type; a target is tried ``attempts`` times.

    Partitions send on their executors; an event that no attempt delivers fails its task, which Spark runs again.
    """

    def dispatch(batch: DataFrame, batch_id: int) -> None:
        names = batch.columns

        def deliver(rows) -> None:
            for row in rows:
                event = dict(zip(names, row, strict=True))
                body = json.dumps(event, default=str, sort_keys=True).encode()
                headers = {"X-Signature": signature(secret, body), "X-Batch": str(batch_id)}
                for url in targets.get(event[kind], []):
                    if not any(send(url, headers, body) for _ in range(attempts)):
                        raise ConnectionError(f"{url} did not take an event")

        batch.foreachPartition(deliver)

    return dispatch
