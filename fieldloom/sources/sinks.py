"""Reports and contracts to files."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.text import file_safe_name
from fieldloom.operators.compare import wide_report
from fieldloom.session import shared_folder


def write_record_report(differences: DataFrame, record_key: str, path: str) -> None:
    """One CSV file, ``path``, of one record, sorted by field: ``fields, <record key>``."""
    rows = (
        differences.filter(F.col("record_key") == record_key)
        .select(F.col("field").alias("fields"), F.col("message").alias(record_key))
        .orderBy("fields")
    )
    # One record is one document, so one task is enough.
    _write_single(rows.coalesce(1), path)


def write_wide_report(differences: DataFrame, record_keys: Sequence[str], path: str) -> None:
    """One CSV file, ``path``, with one column per named record, sorted both ways, blank where they agree."""
    wide = wide_report(differences, sorted(record_keys)).withColumnRenamed("field", "fields")
    # As many rows as the named records have fields.
    _write_single(wide.orderBy("fields").coalesce(1), path)


def _write_single(rows: DataFrame, path: str) -> None:
    staged = shared_folder(rows.sparkSession, "staged")
    rows.withColumn("_file", F.lit("report")).write.partitionBy("_file").csv(staged, header=True, escape='"', emptyValue="")
    folder, _, name = path.rstrip("/").rpartition("/")
    if not publish(rows.sparkSession, staged, folder, {"report": name}):
        # Without differences Spark writes no folder of a file: the header alone.
        staged = shared_folder(rows.sparkSession, "staged")
        rows.limit(0).coalesce(1).write.csv(f"{staged}/_file=report", header=True, escape='"')
        publish(rows.sparkSession, staged, folder, {"report": name})


def publish(spark: SparkSession, staged: str, folder: str, names: Mapping[str, str] | None = None) -> int:
    """Second phase of writing single files: move ``staged/_file=<name>/part-...`` to ``folder/<name>``.

    The first phase is Spark's own commit of the staged folder, so a file appears whole or not at
    all; a file that is there is replaced. ``names`` gives other names. Works on any path that Spark
    writes to and moves names only, one for each file; it returns their number.
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join(parts))
    source, target = path(staged).getFileSystem(conf), path(folder).getFileSystem(conf)
    target.mkdirs(path(folder))
    count = 0
    for holder in source.listStatus(path(staged)):
        name = unquote(holder.getPath().getName().partition("=")[2])
        parts = [f.getPath() for f in source.listStatus(holder.getPath())] if holder.isDirectory() else []
        parts = [p for p in parts if p.getName().startswith("part-")]
        if not parts:
            continue
        if len(parts) > 1:
            raise ValueError(f"{len(parts)} rows want to be the file {name}")
        to = path(folder, (names or {}).get(name, name))
        # A copy beside the target first: stores may hold the two folders in different places.
        fresh = path(folder, f".{to.getName()}.{uuid.uuid4().hex}")
        moved = source.rename(parts[0], fresh) if source.equals(target) else (
            jvm.org.apache.hadoop.fs.FileUtil.copy(source, parts[0], target, fresh, False, conf))
        if moved and target.exists(to):
            target.delete(to, False)
        if not (moved and target.rename(fresh, to)):
            raise OSError(f"{to.toString()} can't be written")
        count += 1
    source.delete(path(staged), True)
    return count


def write_long_report(differences: DataFrame, path: str) -> None:
    """Differences as they are, one row each: the report for any number of records."""
    differences.write.csv(path, header=True, escape='"')


def contract_file_name(contracts: DataFrame) -> DataFrame:
    """Add ``file``: ``<id>_<clean title>_schema.json``."""
    return contracts.withColumn(
        "file",
        F.concat_ws("_", F.col("template_id").cast("string"), file_safe_name(F.col("title")),
                    F.lit("schema.json")),
    )


def export_contracts(contracts: DataFrame, path: str) -> None:
    """One file per contract, ``<id>_<clean title>_schema.json`` in the folder ``path``, with its text."""
    spark = contracts.sparkSession
    staged = shared_folder(spark, "staged")
    (
        contract_file_name(contracts)
        .select(F.col("file").alias("_file"), F.col("contract").alias("value"))
        .write.partitionBy("_file")
        .text(staged)
    )
    publish(spark, staged, path)
