"""Loads as a stream: deliveries are announced by files, every one is loaded once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.quality import Gates
from quarry.plans import ingest


def load_deliveries(spark: SparkSession, inbox: str, root: str, checkpoint: str, gates: Gates | None = None, keep: int = 5) -> list[str]:
    """Loads all deliveries announced since the last call, and ends; what became of each, in order.

    A file in ``inbox`` announces deliveries, a source folder a line; it must
    appear complete, by a rename. The stream's checkpoint remembers which files
    were seen. Deliveries of a micro-batch are loaded in order of file time,
    name and line, and the manifest says which batch and delivery it comes
    from: a batch that is run again, as its load or the driver died half-way,
    skips what was published and never publishes twice. A delivery whose gate
    fails ends the call with that error and is tried again by the next one.
    """
    done: list[str] = []

    def load(batch: DataFrame, number: int) -> None:
        # A line a delivery: few, as each is a load of its own.
        for place, row in enumerate(batch.withColumn("line", F.monotonically_increasing_id()).orderBy("at", "file", "line").collect()):
            done.append(ingest.sync(spark, row["value"], root, gates, keep=keep, batch=(number, place)))

    m = F.col("_metadata")
    lines = spark.readStream.text(inbox).select(F.trim("value").alias("value"), m["file_modification_time"].alias("at"), m["file_name"].alias("file")).where("value <> ''")
    query = lines.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return done
