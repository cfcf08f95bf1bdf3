"""The extension surface: named agents that turn a row into any number of rows, and code enrichers.

An agent has `supports(row) -> bool` and `run(row) -> list of (severity, summary)`; it is registered by name or
found as `module:Class`. Where it also has `where`, a SQL condition that holds for every row it supports, other rows are left out before
Python sees them. From SQL agents are called by the table function `review_agents`. They run over Arrow batches, the outputs of all agents side by side. This is the hook for code
of users' own that takes one row at a time; what a column expression can say needs no agent.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


class Agent(Protocol):
    def supports(self, row: dict) -> bool: ...

    def run(self, row: dict) -> list[tuple[str, str]]: ...


AGENTS: dict[str, Callable[[], Agent]] = {}


def agent(name: str):
    """Register an agent class under a name."""

    def add(cls):
        AGENTS[name] = cls
        return cls

    return add


def load(name: str) -> Agent:
    """A registered agent, or the class that `module:Class` names."""
    if name in AGENTS:
        return AGENTS[name]()
    module, _, cls = name.partition(":")
    if not cls:
        raise KeyError(f"no agent is named {name}")
    return getattr(importlib.import_module(module), cls)()


def run_agents(events: DataFrame, names: list[str], key: str) -> DataFrame:
    """(key, agent, severity, summary): what the agents say about the rows they support."""
    made = [(n, load(n)) for n in names]
    kind = events.schema[key].dataType.simpleString()
    conditions = [getattr(a, "where", None) for _, a in made]
    if conditions and all(conditions):
        events = events.where(" OR ".join(f"coalesce({c}, false)" for c in conditions))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(row[key], n, s, t) for row in b.to_dict("records") for n, a in made if a.supports(row) for s, t in a.run(row)]
            yield pd.DataFrame(out, columns=[key, "agent", "severity", "summary"])

    return events.mapInPandas(run, f"{key} {kind}, agent string, severity string, summary string")


class ReviewAgents:
    """review_agents(TABLE(...) [PARTITION BY ...], key, names): what the agents named, a comma between two, say about the table's rows.

    Its rows are (key, agent, severity, summary), the key being the table's column of that name in its own type. A name that is no agent or no column is an
    error before anything runs.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, names: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or key.value is None or names.value is None:
            raise ValueError("review_agents takes a table, a column's name and agents' names")
        if key.value not in rows.dataType.names:
            raise ValueError(f"the table has no column {key.value}")
        for n in names.value.split(","):
            load(n.strip())
        return AnalyzeResult(StructType().add(key.value, rows.dataType[key.value].dataType).add("agent", "string").add("severity", "string").add("summary", "string"))

    def __init__(self):
        self.made = None

    def eval(self, rows: Row, key: str, names: str) -> Iterator[tuple]:
        if self.made is None:
            self.made = [(n.strip(), load(n.strip())) for n in names.split(",")]
        row = rows.asDict()
        for n, a in self.made:
            if a.supports(row):
                for severity, summary in a.run(row):
                    yield row[key], n, severity, summary


def register_sql(spark: SparkSession, name: str = "review_agents") -> None:
    """Make the agents callable from this session's SQL. Where workers import this module, agents of users' own modules are found as `module:Class`."""
    spark.udtf.register(name, udtf(ReviewAgents))


def enriched(df: DataFrame, enrichers: list[tuple[Callable[[str], bool], Callable[[pd.Series], pd.Series]]], path: str, code: str) -> DataFrame:
    """Code snippets through every enricher that supports the row's path, in order.

    `supports` is asked for one path at a time, `enrich` is given the snippets of the supported rows of a batch, and is not
    called for a batch without any. A null path is supported by none.
    """

    @F.pandas_udf("string")
    def run(paths: pd.Series, codes: pd.Series) -> pd.Series:
        for supports, enrich in enrichers:
            mine = paths.map(lambda p: p is not None and bool(supports(p))).astype(bool)
            if mine.any():
                codes = codes.copy()
                codes[mine] = enrich(codes[mine])
        return codes

    return df.withColumn(code, run(path, code)) if enrichers else df
