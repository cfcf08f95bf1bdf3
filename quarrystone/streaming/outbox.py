"""The outbox loop: a stream over an outbox table in bounded batches, and sinks that write a repeated batch once.

`Outbox` is a Python data source. Its offset is (created_at, event_id), so rows of one time are neither skipped nor
repeated; a batch admits at most `limit` rows. The driver looks only at the keys behind the offset, rows are read by
tasks. A sink is keyed by the batch id: a batch that ran before a failure and runs again replaces what it wrote.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

EPOCH = datetime.datetime(1970, 1, 1)


class Outbox(DataSource):
    """format("outbox"): options `path` (a folder of Parquet files on storage that driver and executors reach), `limit` (100), `since` (ISO time).

    The table has event_id, created_at and status; only PENDING rows count. Rows that come later with an earlier time than the offset are not seen.
    """

    @classmethod
    def name(cls) -> str:
        return "outbox"

    def streamReader(self, schema):
        return _Reader(self.options, schema)


def _as(column, kind):
    """A column in Spark's Arrow type: Spark's times are microseconds, of a zone or of none."""
    import pyarrow as pa

    if pa.types.is_timestamp(kind) and pa.types.is_timestamp(column.type):
        column = column.cast(pa.timestamp("us", column.type.tz), safe=False).cast(pa.timestamp("us", "UTC") if kind.tz else pa.timestamp("us"))
    return column.cast(kind)


class _Slice(InputPartition):
    def __init__(self, files: list[str], start: dict, end: dict):
        self.files, self.start, self.end = files, start, end


class _Reader(DataSourceStreamReader):
    def __init__(self, options, schema):
        self.path, self.limit, self.since = options["path"], int(options.get("limit", 100)), options.get("since")
        self.schema, self.at = schema, None

    def _files(self) -> list[str]:
        import pyarrow.dataset as ds

        return sorted(ds.dataset(self.path, format="parquet", exclude_invalid_files=False).files)

    def _rows(self, files: list[str], columns: list[str], start: dict, end: dict | None):
        """The pending rows of files behind `start` and up to `end`."""
        import pyarrow as pa
        import pyarrow.dataset as ds
        from pyarrow.fs import FileSystem

        fs = FileSystem.from_uri(self.path)[0]
        data = ds.dataset(files, format="parquet", filesystem=fs)
        kind = data.schema.field("created_at").type
        time = lambda o: pa.scalar(o["us"], pa.int64()).cast(pa.timestamp("us")).cast(pa.timestamp(kind.unit, kind.tz))
        at, id_ = ds.field("created_at"), ds.field("event_id")
        keep = ds.field("status") == "PENDING"
        if start["id"] is not None:
            keep &= (at > time(start)) | ((at == time(start)) & (id_ > start["id"]))
        elif start["us"] is not None:
            keep &= at >= time(start)
        if end is not None:
            keep &= (at < time(end)) | ((at == time(end)) & (id_ <= end["id"]))
        return data.scanner(columns=columns, filter=keep)

    def initialOffset(self) -> dict:
        since = (datetime.datetime.fromisoformat(self.since) - EPOCH) // datetime.timedelta(microseconds=1) if self.since else None
        return {"us": since, "id": None}

    def latestOffset(self) -> dict:
        """The offset of the `limit`-th pending row behind the last batch."""
        import pyarrow as pa

        start, files = self.at or self.initialOffset(), self._files()
        best = None
        for batch in self._rows(files, ["created_at", "event_id"], start, None).to_batches() if files else []:  # keeps the first rows only
            table = pa.table(batch) if best is None else pa.concat_tables([best, pa.table(batch)])
            best = table.sort_by([("created_at", "ascending"), ("event_id", "ascending")]).slice(0, self.limit)
        if best is None or not best.num_rows:
            self.at = start
            return start
        last = best.column("created_at")[-1].cast(pa.timestamp("us", best.column("created_at").type.tz)).value
        self.at = {"us": last, "id": best.column("event_id")[-1].as_py()}
        return self.at

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if self.at is None:
            self.at = end  # after a restart the last batch is planned before the next offset is asked for
        return [] if start == end else [_Slice([f], start, end) for f in self._files()]

    def read(self, partition: _Slice) -> Iterator:
        from pyspark.sql.pandas.types import to_arrow_schema

        want = to_arrow_schema(self.schema)
        for batch in self._rows(partition.files, self.schema.names, partition.start, partition.end).to_batches():
            cols = [c if c.type == f.type else _as(c, f.type) for c, f in zip(batch.columns, want)]
            yield batch.from_arrays(cols, schema=want)


def outbox(spark: SparkSession, path: str, schema: str, limit: int = 100, since: str | None = None) -> DataFrame:
    """The outbox as a stream of at most `limit` pending rows a batch, oldest first."""
    spark.dataSource.register(Outbox)
    reader = spark.readStream.format("outbox").schema(schema).option("path", path).option("limit", limit)
    return (reader.option("since", since) if since else reader).load()


def write_once(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that keeps each batch in a folder of its own, replaced when the batch runs again. Read it back with `written`."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return sink


def written(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of all batches with `batch`, the number of the batch that wrote them; no rows where no batch has been written."""
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(base):
        return spark.createDataFrame([], schema).withColumn("batch", F.lit(None).cast("long"))
    return spark.read.option("basePath", path).schema(schema).parquet(f"{path}/batch=*").withColumn("batch", F.regexp_extract(F.input_file_name(), r"/batch=(\d+)/", 1).cast("long"))


def run_idle(df: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> None:
    """Work off all that is there in batches, then stop. A source that admits a part of it at a time is asked until it has no more."""
    query: StreamingQuery = df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def mark_processed(outbox_rows: DataFrame, done: DataFrame, now) -> DataFrame:
    """The outbox with rows whose events are written marked PROCESSED."""
    seen = done.select("event_id").distinct().withColumn("_done", F.lit(True))
    both = outbox_rows.join(seen, "event_id", "left").withColumn("_hit", F.coalesce("_done", F.lit(False)) & (F.col("status") == "PENDING"))
    before = F.col("processed_at") if "processed_at" in outbox_rows.columns else F.lit(None).cast("timestamp")
    return both.withColumn("processed_at", F.when(F.col("_hit"), now).otherwise(before)).withColumn("status", F.when(F.col("_hit"), "PROCESSED").otherwise(F.col("status"))).drop("_done", "_hit")
