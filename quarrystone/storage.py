"""Tables that cut lineage: written once to a folder all executors share, then read back.

The folder is `spark.checkpoint.dir` of the session. Where that is unset a session in local mode (tests,
notebooks) uses a temporary folder of this process; on a cluster that would be another folder on every machine,
so there it is an error. Each application writes below a folder of its own; what a step can delete it deletes with
`forget`, and `clear` removes the rest once results are written.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []
_named: dict[str, str] = {}  # path of a sorted run -> its table's name
MARK = "quarrystone"
_ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder; nothing is created yet."""
    return f"{_own(spark)}/{label}-{uuid.uuid4().hex}"


def _own(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="quarrystone-"))
        base = f"file://{_local[0]}"
    return f"{base.rstrip('/')}/{MARK}/{spark.sparkContext.applicationId}"


def stored(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and return the table read back.

    Survives lost executors (the files are in shared storage, not in executor memory) and gives
    Spark exact sizes for its join choice.
    """
    spark = df.sparkSession
    path = shared_dir(spark, label)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """`df` as a side of a join that shuffles it. A loop's tables are small when compressed, so that Spark would send them through the driver, each round again."""
    return df.hint("merge")


def sorted_run(df: DataFrame, label: str, buckets: int, *cols: str, then: Sequence[str] = (), dealt_so: bool = False) -> DataFrame:
    """Like `stored`, in one file for each of `buckets` buckets of the columns' hash, sorted by them and `then`, and known to Spark as such.

    A merge join on `cols` with rows that a shuffle of as many partitions has dealt by them neither shuffles nor sorts a run. With `dealt_so` the rows
    have come out of such a shuffle and are not shuffled again; joins on their way, on `cols` and `then`, leave runs as they lie, too.
    """
    spark = df.sparkSession
    path, name = shared_dir(spark, label), f"run_{uuid.uuid4().hex}"
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")  # one file a bucket, so the order can be used
    rows = df if dealt_so else df.repartition(buckets, *cols)
    every = spark.conf.get(_ALL_KEYS)
    try:
        if dealt_so:
            spark.conf.set(_ALL_KEYS, "false")  # rows with equal keys meet where only some of the keys deal them
        rows.write.bucketBy(buckets, *cols).sortBy(*cols, *then).option("path", path).saveAsTable(name)
    finally:
        spark.conf.set(_ALL_KEYS, every)
    _named[path] = name
    return spark.table(name)


def parts_for(rows: DataFrame, each: int = 50_000) -> int:
    """In how many buckets a loop over `rows` keeps its runs: one for `each` rows, and enough for all cores."""
    spark = rows.sparkSession
    return max(min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), rows.count() // each)


def plain(run: DataFrame) -> DataFrame:
    """The rows of a `sorted_run` without what Spark knows of their order: a union of bucketed tables would pass for a bucketed one."""
    files = run.inputFiles()
    return run.sparkSession.read.schema(run.schema).parquet(files[0].rpartition("/")[0]) if files else run


def forget(*tables: DataFrame) -> None:
    """Delete the files behind `stored` tables that nothing will read again."""
    for df in tables:
        files = df.inputFiles()
        if files:
            root, _, rest = files[0].partition(f"/{MARK}/")
            app, label = rest.split("/")[:2]
            path = f"{root}/{MARK}/{app}/{label}"
            for known in [k for k in _named if k.endswith(f"/{MARK}/{app}/{label}")]:
                df.sparkSession.sql(f"DROP TABLE IF EXISTS {_named.pop(known)}")
            _delete(df.sparkSession, path)


class Gathered:
    """Rows that a loop gathers, a stored table a round. No round is written again but when `most` of them become one table.

    With `own` the rounds' tables are this object's and go then; else only what it wrote itself does.
    """

    def __init__(self, first: DataFrame, *cols: str, own: bool = False, most: int = 8):
        self.cols, self.own, self.most, self.parts, self.made = cols, own, most, [first], []

    def rows(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [p.select(*self.cols) for p in self.parts])

    def add(self, rows: DataFrame) -> None:
        self.parts.append(rows)
        if len(self.parts) > self.most:
            old, last = self.parts[:-1], self.parts[-1]  # the last is what the loop goes on with
            whole = stored(reduce(DataFrame.unionByName, [p.select(*self.cols) for p in old]), "gathered")
            forget(*(old if self.own else self.made))
            self.parts, self.made = [whole, last], [whole]

    def forget(self) -> None:
        forget(*(self.parts if self.own else self.made))


def clear(spark: SparkSession) -> None:
    """Delete all that this application has stored. For the end of a job: DataFrames over stored tables fail afterwards."""
    _delete(spark, _own(spark))


def _delete(spark: SparkSession, at: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
