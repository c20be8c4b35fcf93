"""Use-limited keys over streams of attempts.

A key has a number of fuses and a last valid epoch. An attempt in time with fuses left is granted and
burns one; others are told why not. An exhausted key stays so whatever comes late; an attempt id that was
seen before gets the same answer and burns nothing. A key's state is its counter and the answers given.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "key long, attempt_id long, ts timestamp, decision string, remaining int"


def decide(remaining: int, epoch: int, valid_until: int | None) -> str:
    if valid_until is not None and epoch > valid_until:
        return "expired"
    return "granted" if remaining > 0 else "exhausted"


class Fuses(StatefulProcessor):
    def __init__(self, fuses: int, epoch_seconds: int, valid_until: int | None):
        self.fuses, self.epoch_seconds, self.valid_until = fuses, epoch_seconds, valid_until

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "remaining int, origin long")
        self.answers = handle.getMapState("answers", "attempt_id long", "decision string, remaining int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        remaining, origin = self.state.get() if self.state.exists() else (self.fuses, None)
        out = []
        for row in sorted((r for b in rows for r in b.itertuples(index=False)), key=lambda r: (r.ts, r.attempt_id)):
            seconds = int(row.ts.timestamp())
            origin = seconds if origin is None else origin
            if self.answers.containsKey((row.attempt_id,)):
                decision, left = self.answers.getValue((row.attempt_id,))
            else:
                decision = decide(remaining, max(0, (seconds - origin) // self.epoch_seconds), self.valid_until)
                remaining -= decision == "granted"
                left = remaining
                self.answers.updateValue((row.attempt_id,), (decision, left))
            out.append((key[0], row.attempt_id, row.ts, decision, left))
        self.state.update((remaining, origin))
        yield pd.DataFrame(out, columns=["key", "attempt_id", "ts", "decision", "remaining"])

    def close(self) -> None:
        pass


def consume(attempts: DataFrame, *, fuses: int, epoch_seconds: int = 3600, valid_until: int | None = None) -> DataFrame:
    """Decisions for a stream of attempts (key, attempt_id, ts)."""
    return attempts.groupBy("key").transformWithStateInPandas(Fuses(fuses, epoch_seconds, valid_until), OUT, "Append", "None")


def epoch_counts(attempts: DataFrame, *, epoch: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Attempts per key and epoch of a stream, once the watermark has passed the epoch."""
    return attempts.withWatermark("ts", late).groupBy("key", F.window("ts", epoch)).count().select("key", F.col("window.start").alias("epoch_start"), "count")


def epoch_counts_of_stream(spark: SparkSession, folder: str, name: str, *columns: Column, epoch: str = "1 hour") -> DataFrame:
    """key, epoch_start, count of the files called name in a folder, read as a stream to its end.

    The result is what the last batch wrote, beside the stream's checkpoint in the folder that the session shares.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="stratalog-")
    place = f"{shared.rstrip('/')}/stratalog/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{folder}/{name}").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder).select(*columns)
    counted = rows.groupBy("key", F.window("ts", epoch)).count().select("key", F.col("window.start").alias("epoch_start"), "count")
    write = lambda batch, _: batch.write.mode("overwrite").parquet(f"{place}/counts")
    counted.writeStream.outputMode("complete").option("checkpointLocation", f"{place}/state").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{place}/counts")
