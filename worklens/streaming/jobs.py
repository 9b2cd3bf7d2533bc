"""Arriving proposals and review decisions as Structured Streaming jobs over the batch functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from worklens.params import Params
from worklens.plans import audit
from worklens.plans.screening import History, score_by_mean, score_by_median
from worklens.sources.staging import settle


def file_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def _into(batch: DataFrame, number: int, path: str) -> None:
    """One folder per batch number, overwritten on a retry: a repeated batch leaves the same rows."""
    batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


def screen_stream(proposals: DataFrame, past: History, out: str, checkpoint: str, by_mean: bool = False, p: Params = Params()) -> StreamingQuery:
    """Screen each micro-batch with the batch formulas; history is prepared once."""
    formula: Callable = score_by_mean if by_mean else score_by_median

    def each(batch: DataFrame, number: int) -> None:
        _into(formula(settle(batch, "arrived"), past, p), number, out)

    return (
        proposals.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


#: Stands for "an entry of this id is valid" beside the digests of its entries.
_FIRST = ""


def review_stream(entries: DataFrame, log: str, rejected: str, checkpoint: str) -> StreamingQuery:
    """Validated append of review decisions, each to the log or to the rejected entries, however late it comes.

    The first valid entry of an id is logged. An entry delivered again is dropped. Invalid entries are rejected, and a valid one that
    corrects them later is logged; so is an entry that differs from the logged one of its id: it is rejected, not lost. Within a batch the
    earliest by review_timestamp comes first. What was delivered before is kept as state, without a watermark, so a batch reads
    neither the log nor the rejected entries: a key for each different entry of an id, and one for an id that has a valid entry. What is left
    of a batch is its new entries, and a mark for each id whose first valid ones are among them. Entries without an id can't be told
    apart and all go to the log or the rejected.
    """
    spark = entries.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    digest = F.sha2(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in entries.columns])), 256)
    keys = F.when(audit.is_valid(), F.array(digest, F.lit(_FIRST))).otherwise(F.array(digest))
    whole = F.struct(*entries.columns)
    named = entries.where(F.col("log_id").isNotNull()).select(F.col("log_id").alias("entry_id"), whole.alias("entry"), F.explode(keys).alias("entry_key"))
    named = named.withColumn("entry", F.when(F.col("entry_key") != _FIRST, F.col("entry"))).dropDuplicates(["entry_id", "entry_key"])
    no_key = F.lit(None).cast("string")
    nameless = entries.where(F.col("log_id").isNull()).select(no_key.alias("entry_id"), whole.alias("entry"), no_key.alias("entry_key"))

    def each(batch: DataFrame, number: int) -> None:
        arrived = settle(batch, "reviews")
        new = arrived.where(F.col("entry").isNotNull()).select("entry_id", "entry_key", "entry.*")
        valid = new.where(audit.is_valid())
        opened = arrived.where(F.col("entry_key") == _FIRST).select("entry_id")
        when = F.struct(F.col("review_timestamp").isNull(), "review_timestamp", "entry_key")
        earliest = valid.join(opened, "entry_id", "left_semi").groupBy("entry_id").agg(F.min(when)["entry_key"].alias("entry_key"))
        first = settle(earliest, "first-reviews")
        without = valid.where(F.col("entry_id").isNull())
        logged = valid.join(first, ["entry_id", "entry_key"], "left_semi").unionByName(without)
        refused = new.where(F.col("entry_id").isNotNull()).join(first, ["entry_id", "entry_key"], "left_anti").unionByName(
            new.where(F.col("entry_id").isNull() & ~audit.is_valid())
        )
        _into(audit.prepared(logged.drop("entry_id", "entry_key")), number, log)
        _into(refused.drop("entry_id", "entry_key"), number, rejected)

    marked = named.unionByName(nameless)
    return marked.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def status_stream(entries: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Latest status per work, kept in stream state; each trigger emits the works that changed."""
    when = F.struct("review_timestamp", "log_id")
    latest = entries.where(audit.is_valid()).groupBy("work_id").agg(
        F.max("review_timestamp").alias("review_timestamp"), F.max_by("review_status", when).alias("review_status")
    )

    def each(batch: DataFrame, number: int) -> None:
        _into(batch, number, name)

    return (
        latest.writeStream.outputMode("update")
        .foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_status(spark: SparkSession, path: str) -> DataFrame:
    """The last emitted status per work from the update batches."""
    rows = spark.read.parquet(path)
    return rows.groupBy("work_id").agg(
        F.max("review_timestamp").alias("review_timestamp"),
        F.max_by("review_status", F.struct("review_timestamp", "batch")).alias("review_status"),
    )
