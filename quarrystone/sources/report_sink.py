"""Reports as one document per task under a known name, written by a Python data source.

Tasks write their documents below a staging folder of the job; the commit, which gets the names of all that succeeded,
moves them to `<task>/<stage>.<ending>` and drops the staging folder. So a failed or repeated attempt leaves no file, and a
job that fails leaves none at all. The folder has to be on storage that driver and executors reach by pyarrow.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from quarrystone.functions import expr as X

STAGING, OPEN = "_staging", "job"


@dataclass
class Written(WriterCommitMessage):
    attempt: str
    names: list[str]


class ReportDocuments(DataSource):
    """format("report_documents"): rows (task, stage, document) as files; options `path` and `ending` (sarif.json). Documents that are there are replaced."""

    @classmethod
    def name(cls) -> str:
        return "report_documents"

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], self.options.get("ending", "sarif.json"))


class _Writer(DataSourceWriter):
    def __init__(self, path: str, ending: str):
        self.path, self.ending, self.run = path.rstrip("/"), ending, uuid.uuid4().hex
        fs, _, staging = self._place()
        fs.create_dir(staging, recursive=True)
        with fs.open_output_stream(f"{staging}/{OPEN}") as out:  # gone as soon as the job is over
            out.write(b"open")

    def _place(self):
        from pyarrow.fs import FileSystem

        fs, base = FileSystem.from_uri(self.path)
        return fs, base, f"{base}/{STAGING}/{self.run}"

    def write(self, iterator: Iterator) -> Written:
        from pyarrow.fs import FileType

        fs, _, staging = self._place()
        attempt, names = uuid.uuid4().hex, []
        for row in iterator:
            for part in (row["task"], row["stage"]):
                if not part or "/" in part or part.startswith("."):
                    raise ValueError(f"not a name for a folder or file: {part!r}")
            name = f"{row['task']}/{row['stage']}.{self.ending}"
            fs.create_dir(f"{staging}/{attempt}/{row['task']}", recursive=True)
            with fs.open_output_stream(f"{staging}/{attempt}/{name}") as out:
                out.write(row["document"].encode())
            names.append(name)
        if fs.get_file_info(f"{staging}/{OPEN}").type == FileType.NotFound:  # the job has failed meanwhile
            self._drop(fs, staging)
            raise RuntimeError("the job is over")
        return Written(attempt, names)

    def commit(self, messages: list[Written | None]) -> None:
        fs, base, staging = self._place()
        done = [m for m in messages if m is not None]
        every = [n for m in done for n in m.names]
        if len(set(every)) < len(every):
            self._drop(fs, staging)
            raise ValueError("more than one document of a task and stage")
        for m in done:
            for name in m.names:
                fs.create_dir(f"{base}/{name.split('/')[0]}", recursive=True)
                fs.move(f"{staging}/{m.attempt}/{name}", f"{base}/{name}")
        self._drop(fs, staging)

    def abort(self, messages: list[Written | None]) -> None:
        fs, _, staging = self._place()
        self._drop(fs, staging)

    @staticmethod
    def _drop(fs, staging: str) -> None:
        """Delete the job's staging folder, and the folder of all jobs' where no other is writing. Tasks that are still writing may get in between."""
        from pyarrow.fs import FileSelector, FileType

        for _ in range(3):
            try:
                if fs.get_file_info(f"{staging}/{OPEN}").type == FileType.File:
                    fs.delete_file(f"{staging}/{OPEN}")
                if fs.get_file_info(staging).type == FileType.Directory:
                    fs.delete_dir(staging)
                above = staging.rsplit("/", 1)[0]
                if fs.get_file_info(above).type == FileType.Directory and not fs.get_file_info(FileSelector(above)):
                    fs.delete_dir(above)
                return
            except OSError:
                continue


def write_documents(docs: DataFrame, path: str, ending: str = "sarif.json") -> None:
    """docs: (task, stage, document)."""
    docs.sparkSession.dataSource.register(ReportDocuments)
    docs.select("task", "stage", "document").write.format("report_documents").mode("append").option("path", path).option("ending", ending).save()


def sarif_documents(findings: DataFrame, stage: str, prefix: str) -> DataFrame:
    """(task, stage, document): a task's findings as one SARIF document in the order of report, run and place, URIs brought under `prefix`/task. A document is the unit: a task's findings meet in one row."""
    place = F.struct(F.struct(X.rewrite_uri(F.col("file"), F.concat(F.lit(prefix.rstrip("/") + "/"), F.col("task_id"))).alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region"))
    result = F.struct(
        F.col("rule_id").alias("ruleId"), F.struct(F.col("message").alias("text")).alias("message"), F.array(F.struct(place.alias("physicalLocation"))).alias("locations"),
        F.create_map(F.lit("primary"), F.col("fingerprint")).alias("fingerprints"), F.struct(F.col("severity").alias("severity")).alias("properties"),
    )
    listed = F.array_sort(F.collect_list(F.struct("report", "run", "pos", F.to_json(result).alias("json"))))
    body = F.concat(F.lit('{"version":"2.1.0","runs":[{"results":['), F.array_join(F.transform(listed, lambda x: x["json"]), ","), F.lit("]}]}"))
    return findings.groupBy(F.col("task_id").alias("task")).agg(body.alias("document")).select("task", F.lit(stage).alias("stage"), "document")


def graph_documents(nodes: DataFrame, edges: DataFrame, stage: str) -> DataFrame:
    """(task, stage, document): a task's dependency graph as a CycloneDX document. nodes: (task_id, node, label); edges: (task_id, source, target)."""
    parts = nodes.groupBy("task_id").agg(F.array_sort(F.collect_set(F.struct(F.col("node").alias("bom-ref"), F.col("label").alias("name")))).alias("components"))
    each = edges.groupBy("task_id", "source").agg(F.array_sort(F.collect_set("target")).alias("dependsOn"))
    on = each.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct(F.col("source").alias("ref"), "dependsOn"))).alias("dependencies"))
    doc = F.to_json(F.struct(F.lit("CycloneDX").alias("bomFormat"), "components", "dependencies"))
    return parts.join(on, "task_id", "left").select(F.col("task_id").alias("task"), F.lit(stage).alias("stage"), doc.alias("document"))
