"""Mutations that rewrite only the folders they touch."""

import os

import pytest
from pyspark.sql import functions as F

from quarrystone.operators import upsert as U
from quarrystone.operators.snapshots import PART, Snapshot

SCHEMA = "id long, owner string, status string, updated_at timestamp"


def files(path):
    return {f"{os.path.basename(d)}/{f}" for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def test_untouched_files_keep_their_names(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([(i, f"o{i % 9}", "OPEN") for i in range(200)], "id long, owner string, status string").withColumn("updated_at", F.lit(None).cast("timestamp"))
    table = Snapshot(spark, path, SCHEMA, ["id"], parts=16)
    table.create(first)
    before = files(path)
    updates = spark.createDataFrame([(5, "new"), (6, "new"), (1000, "new")], "id long, owner string").withColumn("status", F.lit("FIXED")).withColumn("updated_at", F.lit(None).cast("timestamp"))
    want = {tuple(r) for r in U.upsert(first, updates, ["id"], [F.col("owner")]).collect()}
    parts = table.mutate(updates, lambda rows, new: U.upsert(rows, new, ["id"], [F.col("owner")]))
    after = files(path)
    assert {tuple(r) for r in table.read().collect()} == want
    assert 0 < len(parts) <= 3 and {f.split("/")[0] for f in before ^ after} == {f"{PART}={p}" for p in parts}
    # by another key: a status change of one owner, looked up by that column
    change = lambda rows, new: rows.withColumn("status", F.when(F.col("owner") == "o3", "CLOSED").otherwise(F.col("status")))
    owners = spark.createDataFrame([("new",)], "owner string")
    assert table.touched(owners, ["owner"]) == sorted(parts)
    table.mutate(spark.createDataFrame([("o3",)], "owner string"), change, ["owner"])
    assert table.read().where("owner = 'o3' and status <> 'CLOSED'").count() == 0 and table.read().count() == 201
    # a folder that loses all its rows goes; nothing to do rewrites nothing; keys may not move
    gone = table.mutate(updates.where("id = 1000"), lambda rows, new: rows.where("false"))
    assert len(gone) == 1 and not any(f.startswith(f"{PART}={gone[0]}/") for f in files(path))
    assert table.mutate(updates.where("false"), U.upsert) == []
    with pytest.raises(ValueError):
        table.mutate(updates.where("id = 5"), lambda rows, new: rows.withColumn("id", F.col("id") + 1))
