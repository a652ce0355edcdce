"""Incremental ingest of delivery / match exports with Structured Streaming.

Exports arrive as files in a landing folder (one file per match or per day).
A file-source stream with the declared schema picks up only files it has not
seen, and a file sink appends them to the parquet table the reports read.
The source's seen-file log and the sink's commit log live in the query's
checkpoint folder, so a restarted or failed run neither skips nor duplicates
a file (exactly-once into the table).  The stream is stateless -- no
aggregation state grows with the data; the reports stay batch jobs over the
table.

``trigger(availableNow=True)`` processes everything present and stops, so the
same code serves a scheduled job and a continuous one (``processing_time``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.schemas import DELIVERIES_SCHEMA, MATCHES_SCHEMA


def read_stream(spark: SparkSession, landing: str, schema, fmt: str = "csv", *,
                null_value: str | None = "NA", max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame over new files in ``landing`` (CSV with header, or parquet)."""
    reader = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("enforceSchema", False)
        if null_value is not None:
            reader = reader.option("nullValue", null_value)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(landing)


def append_to_table(stream: DataFrame, table: str, checkpoint: str, *,
                    available_now: bool = True, processing_time: str | None = None,
                    name: str | None = None) -> StreamingQuery:
    """Append a stream to a parquet table; returns the started query."""
    w = stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint)
    if name:
        w = w.queryName(name)
    w = w.trigger(processingTime=processing_time) if processing_time else w.trigger(availableNow=available_now)
    return w.outputMode("append").start()


def ingest(spark: SparkSession, landing: str, table: str, kind: str = "deliveries", fmt: str = "csv",
           checkpoint: str | None = None, **kw) -> StreamingQuery:
    """Start the ingest of ``landing/*`` into ``table`` for ``kind`` in {deliveries, matches}.

    ``checkpoint`` defaults to ``<table>/_ingest``: the file log belongs to the
    table it fills, so two tables never share one and a restart, in whatever
    application, finds it again.
    """
    schema = {"deliveries": DELIVERIES_SCHEMA, "matches": MATCHES_SCHEMA}[kind]
    ckpt = checkpoint or f"{table.rstrip('/')}/_ingest"
    return append_to_table(read_stream(spark, landing, schema, fmt, **kw), table, ckpt, name=f"ingest_{kind}")
