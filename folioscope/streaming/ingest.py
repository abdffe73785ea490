"""Streams into the keyed tables: an extension of the batch operators by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.stores import upsert


def upsert_stream(rows: DataFrame, folder: str, keys: list[str], newest: str, checkpoint: str) -> StreamingQuery:
    """Keeps the newest row of each key below ``folder``.

    A batch reads version n and writes version n + 1 whole before the next one counts: a batch that is
    repeated after a failure writes the same version again, so its rows are taken once."""

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        jvm = spark.sparkContext._jvm
        path = lambda n: f"{folder.rstrip('/')}/v={n}"
        store = jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        last = next((n for n in range(number - 1, -1, -1) if store.exists(jvm.org.apache.hadoop.fs.Path(f"{path(n)}/_SUCCESS"))), None)
        old = spark.read.schema(batch.schema).parquet(path(last)) if last is not None else batch.limit(0)
        upsert(old, batch, keys, newest).write.mode("overwrite").parquet(path(number))

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(rows: DataFrame, folder: str) -> DataFrame:
    """The newest version of a table kept by ``upsert_stream``; ``rows`` gives session and schema."""
    spark = rows.sparkSession
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    store = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = [int(s.getPath().getName()[2:]) for s in store.listStatus(root) if s.getPath().getName().startswith("v=") and store.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return spark.read.schema(rows.schema).parquet(f"{folder.rstrip('/')}/v={max(done)}")


def daily_calls(events: DataFrame, late: str = "1 day") -> DataFrame:
    """user_id, day, calls of a stream (user_id, ts, calls) by UTC day; rows later than ``late`` are left out."""
    day = F.window("ts", "1 day")
    counted = events.withWatermark("ts", late).groupBy("user_id", day.alias("w")).agg(F.sum("calls").alias("calls"))
    return counted.select("user_id", F.to_date("w.start").alias("day"), "calls")
