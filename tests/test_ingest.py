"""Ingest by version: any order of arrival gives the same table, and only changes are written."""

import itertools

import pytest
from pyspark.sql import functions as F

from foldwise.sources.results import upsert_results
from foldwise.streaming import ingest as I

SCHEMA = "dataset string, split string, rho double, version long"
FILES = [
    [("a", "s", 1.0, 1), ("b", "s", 1.0, 1), (None, "s", 1.0, 1)],
    [("a", "s", 5.0, 5), ("b", "t", 2.0, 2), ("a", "s", 4.0, 4)],
    [("a", "s", 3.0, 3), ("b", "s", 1.0, 1), ("b", "s", 9.0, None), ("c", "t", None, 1), ("c", "t", 7.0, 1)],
]
WANT = {("a", "s", 5.0, 5), ("b", "s", 1.0, 1), (None, "s", 1.0, 1), ("b", "t", 2.0, 2), ("c", "t", 7.0, 1)}


def feed(spark, folder, order):
    source = f"{folder}/in"
    for i in order:
        spark.createDataFrame(FILES[i], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    return source, spark.read.parquet(source).schema


@pytest.mark.parametrize("order", list(itertools.permutations(range(3))))
def test_changes_in_any_order(spark, tmp_path, order):
    target, progress, written = f"{tmp_path}/out", f"{tmp_path}/progress", 0
    for i in order:  # a file arrives, a run takes it in
        source, schema = feed(spark, tmp_path, [i])
        I.ingest_changes(spark, source, schema, target, progress, ["dataset", "split"]).awaitTermination()
        before, written = written, spark.read.parquet(f"{target}/batch=*").count()
        assert written - before <= len({r[:2] for r in FILES[i]})
    assert {tuple(r) for r in I.current_results(spark, target, schema, ["dataset", "split"]).collect()} == WANT
    if order == (1, 2, 0):  # the last file brings one new key, the null one; older rows of the others change nothing
        assert written - before == 1


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0), (1, 0, 2)])
def test_partitioned_table_in_any_order(spark, tmp_path, order):
    source, schema = feed(spark, tmp_path, order)
    target = f"{tmp_path}/table"
    I.ingest_results(spark, source, schema, target, f"{tmp_path}/progress", ["dataset", "split"], ["split"], files_per_trigger=1).awaitTermination()
    assert {tuple(r) for r in spark.read.schema(schema).parquet(target).select("dataset", "split", "rho", "version").collect()} == WANT


def test_older_version_does_not_win(spark, tmp_path):
    at = f"{tmp_path}/t"
    for v in (5, 1):
        upsert_results(spark.createDataFrame([("a", "s", float(v), v)], SCHEMA), at, ["dataset"], ["split"], "version")
    assert spark.read.parquet(at).first()["version"] == 5
    upsert_results(spark.createDataFrame([("a", "s", 2.0, 2)], SCHEMA), at, ["dataset"], ["split"])
    assert spark.read.parquet(at).first()["version"] == 2  # without versions the later batch wins


def test_nothing_arrived(spark, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema
    assert I.current_results(spark, f"{tmp_path}/none", schema, ["dataset"]).count() == 0


def test_monitor_state_ends(spark, tmp_path):
    source, target, progress = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/progress"
    rows = []
    for run in ([("x", f"d{i}") for i in range(3)] + [("y", "d0"), ("y", None), (None, "d0")], [("x", f"d{i}") for i in range(2, 9)] + [("y", "d0")],
                [("x", f"e{i}") for i in range(40)] + [("y", f"f{i}") for i in range(40)]):
        spark.createDataFrame(run, "split string, dataset string").repartition(2).write.mode("append").parquet(source)
        I.monitor_completeness(spark, source, spark.read.parquet(source).schema, target, progress, ["split"], 6, salts=2).awaitTermination()
        rows.append({r["split"]: (r["n_datasets"], r["complete"]) for r in I.completeness_so_far(spark, target, ["split"], 6).collect()})
    assert rows == [{"x": (3, False), "y": (1, False), None: (1, False)}, {"x": (6, True), "y": (1, False), None: (1, False)},
                    {"x": (6, True), "y": (6, True), None: (1, False)}]
    assert spark.read.parquet(f"{target}/batch=*").agg(F.max("n")).first()[0] <= 6
