"""The metric-log monitor as a stream with keyed state.

The state of a run is one value in a RocksDB state store: its baseline (the first logged
entropy) and the last step seen.  A micro-batch reads and writes the state of the runs it holds, whatever
came before; a restarted stream goes on from its checkpoint, and the file sink
commits a batch once.  Entropy, KL and advantage are found by Catalyst; the processor only sees those numbers,
in Arrow batches.

A run's rows of one micro-batch may come in any order: they are held until the baseline is known (their number is
bounded by what a trigger reads), afterwards they pass through.  Between micro-batches arrival order counts, as in a
callback.  Of several entropies at the first step the smallest is the baseline.  A run silent for
``idle_ms`` is closed by a timer: its state goes, and a row with ``closed`` true reports its last step."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from quadrant import schemas
from quadrant.operators import evaluate as ev
from quadrant.streaming.state import stateful_session

OUTPUT = "run string, step long, entropy double, kl double, adv double, entropy_pct double, closed boolean"


class RunMonitor(StatefulProcessor):
    """Prices the entropies of a run by its baseline."""

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run_state = handle.getValueState("run_state", "entropy0 double, last_step long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        baseline, last = self.run_state.get() if self.run_state.exists() else (None, None)
        held: list[pd.DataFrame] = []
        for frame in rows:
            steps = frame["step"].max()
            last = last if pd.isna(steps) else int(steps) if last is None else max(last, int(steps))
            if baseline is None:
                held.append(frame)
            else:
                yield self._priced(frame, baseline)
        if held:
            frame = pd.concat(held)
            logged = frame[frame["entropy"].notna()].sort_values(["step", "entropy"])
            baseline = float(logged["entropy"].iloc[0]) if len(logged) else None
            yield self._priced(frame, baseline)
        self.run_state.update((baseline, last))
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, last = self.run_state.get()
        self.run_state.clear()
        yield pd.DataFrame({"run": [key[0]], "step": pd.array([last], "Int64"), "entropy": [None], "kl": [None],
                            "adv": [None], "entropy_pct": [None], "closed": [True]})

    @staticmethod
    def _priced(frame: pd.DataFrame, baseline: float | None) -> pd.DataFrame:
        pct = 100.0 * frame["entropy"] / (baseline + ev.ENTROPY_EPS) if baseline is not None else None
        return frame[["run", "step", "entropy", "kl", "adv"]].assign(entropy_pct=pct, closed=False)

    def close(self) -> None:
        pass


def monitored(logs: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """A stream of (run, step, logs) -> the monitored rows of ``OUTPUT``."""
    numbers = ev.metric_columns(logs).select("run", "step", "entropy", "kl", "adv")
    return numbers.groupBy("run").transformWithStateInPandas(
        RunMonitor(idle_ms), OUTPUT, "Append", "None" if idle_ms is None else "ProcessingTime")


def start(spark: SparkSession, log_dir: str, output: str, checkpoint: str, source: str = "json",
          trigger_once: bool = True, files_per_batch: int | None = None, idle_ms: int | None = None,
          interval: str = "10 seconds") -> StreamingQuery:
    """Stream a folder of metric logs to Parquet files; started again, it goes on where it ended.

    ``trigger_once`` consumes what is there and ends.  Timers of silent runs need a stream that goes on (one
    with open timers has always another batch to run), so ``idle_ms`` is for ``trigger_once=False``."""
    if trigger_once and idle_ms is not None:
        raise ValueError("idle_ms needs trigger_once=False")
    reader = stateful_session(spark).readStream.schema(schemas.METRIC_LOG).format(source)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    w = (monitored(reader.load(log_dir), idle_ms).writeStream.format("parquet").outputMode("append")
         .option("path", output).option("checkpointLocation", checkpoint))
    return (w.trigger(availableNow=True) if trigger_once else w.trigger(processingTime=interval)).start()


def replay(log: DataFrame, folder: str, slices: int = 4) -> DataFrame:
    """A stored log run through the stream: its steps are dealt into ``slices`` ranges of equal width,
    each written to the watched folder and consumed, in order, by a stream that is started anew and finds
    its state in the checkpoint.  The result is that of one stream over the log as it grew."""
    spark = log.sparkSession
    low, high = log.agg(F.min("step"), F.max("step")).first()
    output = f"{folder}/monitored"
    if low is None:
        return spark.createDataFrame([], OUTPUT)
    width = -(-(high - low + 1) // slices)
    for k in range(slices):
        part = log.where(F.col("step").between(low + k * width, low + (k + 1) * width - 1))
        part.write.mode("append").parquet(f"{folder}/log")
        start(spark, f"{folder}/log", output, f"{folder}/checkpoint", "parquet").awaitTermination()
    return spark.read.schema(OUTPUT).parquet(output)
