"""What a running query counts and what goes wrong in it."""

from __future__ import annotations

import logging
import threading
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQueryListener

from loglens.operators.stats import running_sums
from loglens.plans import collector
from loglens.plans.collector import TOTALS, CollectorConfig
from loglens.sources import tail
from loglens.streaming.streams import Hook

log = logging.getLogger(__name__)


READ, WRITTEN = "loglens_read", "loglens_written"


# --- counters --------------------------------------------------------------------------------

def counted_sink(config: CollectorConfig, sink: Hook, state_dir: str, counters_dir: str) -> Hook:
    """A sink that collects every micro-batch, hands the entries to ``sink``, and keeps the batch's five totals.

    The totals come from the batch's own write. They are stored as one row per batch under ``counters_dir``, which a
    repeated batch replaces, so ``counter_totals`` is right after any failure. ``sink`` has to write the entries once.
    """
    def on_batch(batch: DataFrame, batch_id: int) -> None:
        rows, counted = collector.collect_counted(batch, config, state_dir, batch_id)
        sink(rows, batch_id)
        totals = counted.totals()
        batch.sparkSession.createDataFrame(
            [tuple(totals[n] for n in TOTALS)], ", ".join(f"{n} bigint" for n in TOTALS)).coalesce(1).write.mode(
            "overwrite").parquet(f"{counters_dir}/batch={batch_id}")

    return on_batch


def counter_totals(spark: SparkSession, counters_dir: str) -> DataFrame:
    """``batch``, its five totals, and those of all batches up to it as ``all_...``."""
    schema = ", ".join(f"{n} bigint" for n in TOTALS) + ", batch bigint"
    batches = spark.read.schema(schema).parquet(counters_dir).select("batch", *TOTALS)
    return running_sums(batches, F.col("batch"), TOTALS).select(
        "batch", *TOTALS, *[(F.col(f"before_{n}") + F.col(n)).alias(f"all_{n}") for n in TOTALS])


class CounterListener(StreamingQueryListener):
    """Totals of running queries whose plans observe them (``observed``), by query and in memory of the driver.

    ``hook(query, batch, totals)`` hears of every finished micro-batch; ``totals(query)`` gives the sums since the listener was added.
    """

    def __init__(self, hook: Callable[[str, int, dict[str, int]], None] | None = None) -> None:
        self._hook, self._lock = hook, threading.Lock()
        self._sums: dict[str, dict[str, int]] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        rows = [progress.observedMetrics.get(n) for n in (READ, WRITTEN)]
        if None in rows or not progress.numInputRows:  # a trigger without a batch tells the last one's metrics again
            return
        counted = {k: v for row in rows for k, v in row.asDict().items()} | {"dropped_lines": 0}
        counted = {n: int(counted[n]) for n in TOTALS}
        query = progress.name or str(progress.id)
        with self._lock:
            own = self._sums.setdefault(query, dict.fromkeys(TOTALS, 0))
            for n in TOTALS:
                own[n] += counted[n]
        if self._hook:
            self._hook(query, progress.batchId, counted)

    def totals(self, query: str) -> dict[str, int]:
        with self._lock:
            return dict(self._sums.get(query, dict.fromkeys(TOTALS, 0)))


def observed(lines: DataFrame, config: CollectorConfig) -> DataFrame:
    """``collector.collect`` of streaming lines without a limit, in a plan whose totals a ``CounterListener`` hears."""
    read = lines.observe(READ, *collector.read_metrics())
    return collector.collect(read, config).observe(WRITTEN, *collector.written_metrics())


# --- errors ----------------------------------------------------------------------------------

@dataclass(frozen=True)
class Problem:
    """``kind``: ``failed`` (a query died of an error), ``ended`` (it ended without one), ``hook`` (a hook's error, which
    disturbs nothing) or ``missing`` (a followed path that isn't there)."""

    kind: str
    query: str
    source: str
    message: str
    at: float


ErrorHook = Callable[[Problem], None]
_FIELDS = "kind string, query string, source string, message string, at double"


def told(hook: ErrorHook, kind: str, query: str = "", source: str = "", message: str = "") -> None:
    """Call the hook; an error in it is logged and goes no further."""
    try:
        hook(Problem(kind, query, source, message, time.time()))
    except Exception:
        log.exception("an error hook failed")


class ErrorListener(StreamingQueryListener):
    """Tells ``hook`` of queries that end, and of followed ``paths`` that are gone, once each time they go.

    Paths are looked at when a query makes progress or idles, at most every ``every`` seconds, all of them in one call per file system.
    """

    def __init__(self, hook: ErrorHook, paths: list[str] = (), *, ended: bool = False, every: float = 1.0) -> None:
        self._hook, self._paths, self._ended, self._every = hook, list(paths), ended, every
        self._names: dict[str, str] = {}
        self._gone: set[str] = set()
        self._looked, self._lock = 0.0, threading.Lock()

    def onQueryStarted(self, event) -> None:
        self._names[str(event.id)] = event.name or str(event.id)
        self._look(event.id)

    def onQueryProgress(self, event) -> None:
        self._look(event.progress.id)

    def onQueryIdle(self, event) -> None:
        self._look(event.id)

    def onQueryTerminated(self, event) -> None:
        name = self._names.pop(str(event.id), str(event.id))
        if event.exception:
            told(self._hook, "failed", name, message=event.exception)
        elif self._ended:
            told(self._hook, "ended", name)

    def _look(self, query) -> None:
        with self._lock:
            if not self._paths or time.monotonic() - self._looked < self._every:
                return
            self._looked = time.monotonic()
            gone = set(tail.missing(self._paths))
            new, self._gone = sorted(gone - self._gone), gone
        for path in new:
            told(self._hook, "missing", self._names.get(str(query), ""), path, "no such file")


class ProblemLog:
    """An error hook that keeps problems until they are written to a table (``kind, query, source, message, at``)."""

    def __init__(self) -> None:
        self._lock, self._kept = threading.Lock(), []

    def __call__(self, problem: Problem) -> None:
        with self._lock:
            self._kept.append(problem)

    def problems(self) -> list[Problem]:
        with self._lock:
            return list(self._kept)

    def write(self, spark: SparkSession, path: str) -> None:
        """Append what came since the last write."""
        with self._lock:
            kept, self._kept = self._kept, []
        try:
            spark.createDataFrame([tuple(asdict(p).values()) for p in kept], _FIELDS).coalesce(1).write.mode("append").parquet(path)
        except Exception:
            with self._lock:
                self._kept = kept + self._kept
            raise


def newest(spark: SparkSession, path: str, n: int = 100) -> DataFrame:
    """The last ``n`` problems of a table that ``ProblemLog`` wrote."""
    return spark.read.schema(_FIELDS).parquet(path).orderBy(F.desc("at")).limit(n)
