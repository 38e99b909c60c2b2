"""Result tables by key: runs that are lost go on where they stopped."""

import pytest
from pyspark.sql import functions as F

from cohortloom.plans.lineage import scratch_path
from cohortloom.sources import measurements as m

SCHEMA = "n long, model string"


def table(spark, path):
    return sorted(tuple(r) for r in m.read_results(spark, path, SCHEMA).collect())


def worker(spark, calls, fail_at=None):
    def results(keys):
        names = [r["model"] for r in keys.collect()]
        calls.append(names)
        if fail_at is not None and len(calls) == fail_at:
            raise RuntimeError("lost")
        rows = spark.range(3).select(F.col("id").alias("n")).crossJoin(keys).where("model IS NULL OR model <> 'empty'")
        return rows.select("n", "model")

    return results


def keys_of(spark, names):
    return spark.createDataFrame([(n,) for n in names], "model string")


@pytest.fixture
def names():
    return [f"m{i}" for i in range(12)] + ["empty", "a/b=c"]


def test_a_lost_run_goes_on(spark, names):
    path, calls = scratch_path(spark, "resume"), []
    with pytest.raises(RuntimeError):
        m.write_resumable(keys_of(spark, names), worker(spark, calls, fail_at=3), path, "model", batches=5)
    done = {r["model"] for r in m.finished_keys(spark, path, "model").collect()}
    assert done == set(calls[0]) | set(calls[1])
    again = []
    ran = m.write_resumable(keys_of(spark, names), worker(spark, again), path, "model", batches=5)
    assert ran == len(again) and not done & {k for batch in again for k in batch}
    assert done | {k for batch in again for k in batch} == set(names)
    assert table(spark, path) == sorted((i, k) for k in names if k != "empty" for i in range(3))
    assert m.write_resumable(keys_of(spark, names), worker(spark, again), path, "model", batches=5) == 0
    rows = {r["model"]: r["rows"] for r in m.finished_keys(spark, path, "model").collect()}
    assert rows["empty"] == 0 and rows["m3"] == 3 and len(rows) == len(names)


def test_what_a_lost_run_left_behind_is_replaced(spark):
    """Folders that were written without their manifest are written anew, others are left alone."""
    path, calls = scratch_path(spark, "resume"), []
    m.write_resumable(keys_of(spark, ["a", "b"]), worker(spark, calls), path, "model", batches=1)
    half = spark.createDataFrame([(77, "c"), (78, "c")], SCHEMA)
    m.write_results(half, path, ["model"], mode="replace_keys")
    assert (77, "c") in table(spark, path) and (0, "a") in table(spark, path)
    m.write_resumable(keys_of(spark, ["a", "b", "c"]), worker(spark, calls), path, "model", batches=1)
    assert table(spark, path) == sorted((i, k) for k in "abc" for i in range(3)) and calls[-1] == ["c"]


def test_nothing_to_do_and_repeated_keys(spark):
    path, calls = scratch_path(spark, "resume"), []
    assert m.write_resumable(keys_of(spark, []), worker(spark, calls), path, "model") == 0 and not calls
    assert m.write_resumable(keys_of(spark, ["a", "a"]), worker(spark, calls), path, "model") == 1 and calls == [["a"]]


def test_writers_follow_size(spark):
    """A small key is one file; the plan leaves the number of writers to the sizes at run time."""
    path = scratch_path(spark, "sizes")
    df = spark.range(5000).select("id", (F.col("id") % 3).cast("string").alias("model"))
    m.write_results(df, path, ["model"])
    files = spark.read.parquet(path).select("model", F.input_file_name().alias("f")).distinct().groupBy("model").count().collect()
    assert len(files) == 3 and all(r["count"] == 1 for r in files)
