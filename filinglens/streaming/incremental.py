"""Incremental processing (rows J1, J2): batch anti-joins, and the same as a stream over a folder of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

KEYS = ["ticker", "form_type", "filing_date"]


def unprocessed(records: DataFrame, processed: DataFrame, keys: list[str] = KEYS, overwrite: bool = False, version: str | None = None) -> DataFrame:
    """Records whose keys aren't processed yet (with ``version``: not by that version); all of them with ``overwrite``."""
    if overwrite:
        return records
    done = processed if version is None else processed.where(processed["version"] == version)
    return records.join(done.select(*keys).distinct(), keys, "left_anti")


def stale(processed: DataFrame, version: str) -> DataFrame:
    """Outputs that another version made."""
    return processed.where((processed["version"] != version) | processed["version"].isNull())


def process_new_files(
    spark: SparkSession, source: str, schema: str | StructType, process: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, form: str = "parquet",
) -> None:
    """Process every file of ``source`` that came since the last call, once, and append the results to ``sink``.

    A file stream with the availableNow trigger: its checkpoint remembers the files, so a rerun after a failure
    repeats no finished batch.
    """
    stream = spark.readStream.schema(schema).format(form).load(source)
    query = process(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def process_new_records(
    spark: SparkSession, source: str, schema: str | StructType, process: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, keys: list[str] = KEYS,
    form: str = "parquet", event_time: str | None = None, delay: str = "365 days",
) -> None:
    """Process every record of ``source`` whose ``keys`` haven't been seen by an earlier call, and write the results to ``sink``.

    A stateful deduplication by key: a record that is delivered again, in the same file or a later one, is dropped. With ``event_time`` the
    state forgets keys that lie ``delay`` behind the newest record (and drops records that come later than that); without it all keys stay.
    Each batch overwrites its own partition (``batch``) of the sink, so a batch that runs again after a failure leaves no row twice.
    """
    stream = spark.readStream.schema(schema).format(form).load(source)
    if event_time:
        stream = stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)
    else:
        stream = stream.dropDuplicates(keys)

    def write(batch: DataFrame, number: int) -> None:
        out = process(batch).withColumn("batch", F.lit(number))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(sink)

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
