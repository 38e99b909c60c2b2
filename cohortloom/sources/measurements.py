"""Reading measurement files and keeping result tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.functions import fixed_values as fixed
from cohortloom.functions.scalars import log10_of
from cohortloom.plans.lineage import cut


def read_measurements(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    file_format: str = "csv",
    null_token: str = fixed.NULL_TOKEN,
    sentinels: Sequence[str] = tuple(fixed.SENTINELS),
    numeric: Sequence[str] = (),
    log10: dict[str, str] | None = None,
    zero: str = "-inf",
) -> DataFrame:
    """Read CSV, TSV or Parquet with a given schema.

    ``numeric`` names string columns that hold numbers or sentinel words; sentinels and
    anything unreadable become null.  ``log10`` maps source columns to derived columns.
    """
    if file_format == "parquet":
        df = spark.read.schema(schema).parquet(path)
    elif file_format in ("csv", "tsv"):
        df = _text_options(spark.read.schema(schema), file_format, null_token).csv(path)
    else:
        raise ValueError(f"unknown file format {file_format!r}")
    cleaned = {c: clean_numeric(c, sentinels, null_token) for c in numeric}
    df = df.withColumns(cleaned) if cleaned else df
    derived = {name: log10_of(F.col(c).cast("double"), zero) for c, name in (log10 or {}).items()}
    return df.withColumns(derived) if derived else df


def _text_options(io, file_format: str, null_token: str):
    sep = "\t" if file_format == "tsv" else ","
    return io.option("header", True).option("sep", sep).option("nullValue", null_token)


def clean_numeric(column: str, sentinels: Sequence[str], null_token: str = fixed.NULL_TOKEN):
    text = F.col(column).cast("string")
    return F.when(~text.isin(*sentinels, null_token), text.try_cast("double"))


def write_results(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] = (),
    file_format: str = "parquet",
    mode: str = "overwrite",
) -> None:
    """Write a result table; one folder per key takes the place of one file per model.

    Rows of one key are brought together before writing, so that a key gets few files; a key of many
    rows is split over as many writers as its size asks for.  ``mode="overwrite"`` replaces the whole table,
    ``mode="replace_keys"`` only the folders of keys that occur in ``df``.
    """
    if partition_by:
        df = df.hint("rebalance", *[F.col(c) for c in partition_by])
    writer = df.write.mode("overwrite" if mode == "replace_keys" else mode)
    if mode == "replace_keys":
        writer = writer.option("partitionOverwriteMode", "dynamic")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if file_format == "parquet":
        writer.parquet(path)
    elif file_format in ("csv", "tsv"):
        _text_options(writer, file_format, fixed.NULL_TOKEN).csv(path)
    else:
        raise ValueError(f"unknown file format {file_format!r}")


#: Folder of the manifest inside a result table; readers of the table skip names that start like this.
MANIFEST = "_manifest"


def finished_keys(spark: SparkSession, path: str, key: str, key_type: str = "string") -> DataFrame:
    """``key`` and ``rows`` of every key whose results are complete; none where nothing was written yet."""
    schema = f"`{key}` {key_type}, rows long"
    try:
        return spark.read.schema(schema).parquet(f"{path.rstrip('/')}/{MANIFEST}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_resumable(
    keys: DataFrame, results: Callable[[DataFrame], DataFrame], path: str, key: str, batches: int = 8, file_format: str = "parquet"
) -> int:
    """Work out and write the results of all ``keys`` that are not complete yet; returns the number of batches that ran.

    ``keys`` has one column, ``key``; ``results`` turns some of the keys into their rows, which carry ``key``.  Keys are dealt into
    ``batches`` by a hash.  A batch writes the folders of its keys, replacing what a lost run left there,
    and last of all its keys and their numbers of rows to a manifest.  So a run that is lost between or inside
    batches is repeated with the same call, which skips every key of the manifest.  A key without rows is complete too.
    """
    spark = keys.sparkSession
    key_type = keys.schema[key].dataType.simpleString()
    wanted = keys.select(key).distinct()
    ran = 0
    for batch in range(batches):
        done = finished_keys(spark, path, key, key_type)
        mine = wanted.where(F.pmod(F.xxhash64(key), F.lit(batches)) == batch).join(done, [F.equal_null(wanted[key], done[key])], "left_anti")
        todo = cut(mine)
        if todo.isEmpty():
            continue
        found = cut(results(todo))
        write_results(found, path, [key], file_format, mode="replace_keys")
        counts = found.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
        complete = todo.join(counts, F.equal_null(todo[key], counts["_k"]), "left").select(key, F.coalesce("_n", F.lit(0).cast("long")).alias("rows"))
        complete.write.mode("append").parquet(f"{path.rstrip('/')}/{MANIFEST}")
        ran += 1
    return ran


def read_results(spark: SparkSession, path: str, schema: T.StructType | str, file_format: str = "parquet") -> DataFrame:
    """Read a result table back; partition keys come from the folder names."""
    reader = spark.read.schema(schema)
    if file_format == "parquet":
        return reader.parquet(path)
    return _text_options(reader, file_format, fixed.NULL_TOKEN).csv(path)
