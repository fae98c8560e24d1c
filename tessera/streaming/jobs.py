"""Progress of jobs as a stream with state and timers: what a client that follows a job is told, and when."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_STATE = "completed long, failed long, skipped long, told long, paused boolean, beat long, seen long, over boolean"
_TOLD = "key {0}, kind string, at_us long, processed long, completed long, failed long, skipped long, total long, percent int, status string"
_PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def micros(at: Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone is."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), at.cast("timestamp_ntz"))


class Follower(StatefulProcessor):
    """Rows for the client of one job.

    ``connected`` with its first event; ``progress`` whenever the number of processed queries differs from what was told last (at
    first: in any case); ``heartbeat`` at each full ``every`` microseconds after the first event; ``paused`` once until it goes
    on; ``complete`` when all queries of the job are processed, and nothing after that. Events of a batch are taken by
    (at_us, seq); those of one job in one batch are held together, so the stream's reader bounds them. A heartbeat that no
    event brings comes from a timer, when the watermark has passed it. An event that is older than one of an earlier
    batch counts, at the time of that one.
    """

    def __init__(self, every: int) -> None:
        self.every = every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("job", _STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803  Spark's names
        s = self._known()
        if s and s["over"]:
            return
        armed = s["beat"] if s else None
        for row in sorted(rows, key=lambda r: (r.at_us, r.seq)):
            if s is None:
                s = {"completed": 0, "failed": 0, "skipped": 0, "told": -1, "paused": False, "beat": row.at_us + self.every, "seen": row.at_us, "over": False}
                yield self._row(key, "connected", row.at_us)
            at = max(row.at_us, s["seen"])
            yield from self._beats(key, s, at)
            s["seen"] = at
            if row.outcome in ("completed", "failed", "skipped"):
                s[row.outcome] += 1
            processed = s["completed"] + s["failed"] + s["skipped"]
            if processed != s["told"]:
                s["told"] = processed
                yield self._row(key, "progress", at, s, row.total, "paused" if row.outcome == "paused" else "running")
            if processed >= row.total:
                s["over"] = True
                yield self._row(key, "complete", at, s, row.total, "completed_with_errors" if s["failed"] else "completed")
                break
            if row.outcome == "paused" and not s["paused"]:
                yield self._row(key, "paused", at, s, row.total, "paused")
            s["paused"] = row.outcome == "paused"
        self._keep(s, armed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        s = self._known()
        if s and not s["over"]:
            armed = s["beat"]
            yield from self._beats(key, s, timerValues.getCurrentWatermarkInMs() * 1000)
            self._keep(s, armed)

    def _known(self) -> dict | None:
        return dict(zip([x.split()[0] for x in _STATE.split(", ")], self.state.get(), strict=True)) if self.state.exists() else None

    def _keep(self, s: dict, armed: int | None) -> None:
        if armed is not None and (s["over"] or armed != s["beat"]):
            self.handle.deleteTimer(-(-armed // 1000))
        if not s["over"]:
            self.handle.registerTimer(-(-s["beat"] // 1000))
        self.state.update(tuple(s.values()))

    def _beats(self, key, s: dict, until: int) -> Iterator[Row]:
        while s["beat"] <= until:
            yield self._row(key, "heartbeat", s["beat"])
            s["seen"] = max(s["seen"], s["beat"])
            s["beat"] += self.every

    @staticmethod
    def _row(key, kind: str, at: int, s: dict | None = None, total: int | None = None, status: str | None = None) -> Row:
        names = ("key", "kind", "at_us", "processed", "completed", "failed", "skipped", "total", "percent", "status")
        if s is None:
            return Row(*names)(key[0], kind, at, None, None, None, None, None, None, None)
        processed = s["completed"] + s["failed"] + s["skipped"]
        percent = processed * 100 // total if total else 0
        return Row(*names)(key[0], kind, at, processed, s["completed"], s["failed"], s["skipped"], total, percent if kind == "progress" else None, status)


def follow(events: DataFrame, every: str = "INTERVAL 1 DAY", late: str = "10 minutes") -> DataFrame:
    """What clients are told about the stream ``events`` (key, at timestamp_ntz, seq, outcome, total), one row for each message.

    outcome: completed, failed or skipped for a query that ended so, paused while the job rests, anything else (null too)
    for other news. Rows without key or time are dropped, and rows that are older than the watermark; a null total is
    0, and a job without queries is complete at once.
    """
    spark = events.sparkSession
    beat = spark.sql(f"SELECT timestampdiff(MICROSECOND, timestamp'1970-01-01', timestamp'1970-01-01' + {every}) AS x").first().x
    rows = events.filter("key IS NOT NULL AND at IS NOT NULL").select("key", micros(F.col("at")).alias("at_us"), F.coalesce(F.col("seq").cast("long"), F.lit(0)).alias("seq"), "outcome", F.coalesce(F.col("total").cast("long"), F.lit(0)).alias("total"))
    rows = rows.withColumn("time", F.timestamp_micros("at_us")).withWatermark("time", late)
    return rows.groupBy("key").transformWithState(Follower(beat), _TOLD.format(rows.schema["key"].dataType.simpleString()), "Append", "EventTime")


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """State with timers needs this provider; the session's own setting comes back."""
    before = spark.conf.get(_PROVIDER[0], None)
    spark.conf.set(*_PROVIDER)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER[0])
        else:
            spark.conf.set(_PROVIDER[0], before)
