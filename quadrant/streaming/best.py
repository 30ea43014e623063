"""Score completions as they arrive and log strict improvements of the
best multiplication count, with Structured Streaming.

Each micro-batch is scored once (a batch job inside ``foreachBatch``) and reduced, in the
same pass, to its first row per count.  The running best is global, so it is one row, not keyed state:
a batch writes the best after it to a folder of its own and reads that of the batch before, whatever the stream's
age.  Improvements and state go to paths of the batch, overwritten, so a replayed micro-batch
writes what it wrote before and nothing twice; a batch without improvements writes none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrant import schemas
from quadrant.operators import score as sc
from quadrant.session import materialize
from quadrant.streaming.state import read_if_there

STATE = "best int"


def stored_best(spark: SparkSession, state: str, batch_id: int) -> int | None:
    """The best count after the batch before ``batch_id``."""
    known = read_if_there(spark, f"{state}/after={batch_id - 1}", STATE)
    return known.first().best if known is not None else None


def improvements(batch: DataFrame, best: int | None) -> DataFrame:
    """Rows of a scored batch that strictly improve on ``best`` and on every
    earlier row of the batch (order: prompt_id, gen_idx)."""
    ok = batch.where(F.col("correct"))
    if best is not None:
        ok = ok.where(F.col("n_mults") < best)
    return sc.improvements(ok, ("prompt_id", "gen_idx"), ("script",))


def on_batch(completions: DataFrame, batch_id: int, prompts: DataFrame, discoveries: str, version: int = 2) -> None:
    """Score one micro-batch; write its improvements and the best after it."""
    spark = completions.sparkSession
    state = f"{discoveries}_state"
    best = stored_best(spark, state, batch_id)
    found = materialize(improvements(sc.score(completions, prompts, version=version), best))
    reached = found.agg(F.min("n_mults").alias("best")).first().best
    if reached is not None:
        (found.select("prompt_id", "gen_idx", F.col("n_mults").cast("int").alias("n_mults"), "script",
                      F.current_timestamp().alias("found_at"))
              .write.mode("overwrite").parquet(f"{discoveries}/batch_id={batch_id}"))
    after = best if reached is None else reached
    spark.createDataFrame([(after,)], STATE).coalesce(1).write.mode("overwrite").parquet(f"{state}/after={batch_id}")


def start(spark: SparkSession, completions_dir: str, prompts: DataFrame, discoveries: str, checkpoint: str,
          version: int = 2, trigger_once: bool = True, files_per_batch: int | None = None, source: str = "json"):
    """Stream completions (prompt_id, gen_idx, completion) from a folder of JSON or Parquet files."""
    reader = spark.readStream.schema(schemas.COMPLETIONS).format(source)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def each(df: DataFrame, batch_id: int) -> None:
        on_batch(df, batch_id, prompts, discoveries, version)

    w = reader.load(completions_dir).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger_once else w.trigger(processingTime="10 seconds")
    return w.start()


def replay(completions: DataFrame, prompts: DataFrame, folder: str, slices: int = 3, version: int = 2) -> DataFrame:
    """Stored completions run through the stream: prompts are dealt into ``slices`` key ranges of equal
    width, each written to the watched folder and consumed, in order, by a stream started anew."""
    spark = completions.sparkSession
    low, high = completions.agg(F.min("prompt_id"), F.max("prompt_id")).first()
    discoveries = f"{folder}/discoveries"
    if low is not None:
        width = -(-(high - low + 1) // slices)
        for k in range(slices):
            part = completions.where(F.col("prompt_id").between(low + k * width, low + (k + 1) * width - 1))
            part.write.mode("append").parquet(f"{folder}/completions")
            start(spark, f"{folder}/completions", prompts, discoveries, f"{folder}/checkpoint", version,
                  source="parquet").awaitTermination()
    found = read_if_there(spark, discoveries, schemas.DISCOVERY)
    return spark.createDataFrame([], schemas.DISCOVERY) if found is None else found
