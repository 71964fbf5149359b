"""Templates, guidelines and record pairs from files. Any Hadoop path works (``s3a://`` too)."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.text import blank, lenient_id
from fieldloom.operators.compare import STORED_RECORD
from fieldloom.operators.templates import read_templates_frame
from fieldloom.plans.joins import lookup_join
from fieldloom.plans.layout import TemplateLayout
from fieldloom.session import stored


def read_json_texts(
    spark: SparkSession, path: str, glob: str = "*.json", one_per_line: bool = False
) -> DataFrame:
    """JSON documents as text: one per file, or one per line for bulk data.

    Columns: ``file, loaded_at, doc``. Folders are not searched recursively.
    """
    reader = spark.read.option("pathGlobFilter", glob)
    texts = reader.text(path, wholetext=not one_per_line)
    return texts.select(
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_modification_time").alias("loaded_at"),
        F.col("value").alias("doc"),
    )


def read_templates(
    spark: SparkSession,
    path: str,
    layout: TemplateLayout,
    catalog: DataFrame | None = None,
    **options,
) -> DataFrame:
    """Templates ready to flatten. A catalog (``file, template_id``) overrides the ids in the files."""
    texts = read_json_texts(spark, path, **options)
    if catalog is not None:
        texts = texts.join(catalog.select("file", "template_id"), "file")
    return read_templates_frame(texts, layout)


def find_column(columns: list[str], name: str, case_insensitive: bool = False) -> str:
    """The header that is meant, or a ``KeyError`` that lists what there is."""
    if name in columns:
        return name
    if case_insensitive:
        # Of headers that differ in case only, the last one is taken.
        found = [c for c in columns if c.lower() == name.lower()]
        if found:
            return found[-1]
    raise KeyError(f"column {name!r} not found, there are {columns}")


#: Row numbers leave this many places to each file.
_FILE_ROWS = 1 << 40


def read_key_values(
    spark: SparkSession,
    path: str,
    key_col: str,
    value_col: str,
    case_insensitive: bool = False,
    multi_line: bool = True,
) -> DataFrame:
    """Rows of guideline CSVs: ``file, row_no, key, value``.

    Every file has a header of its own, in which the two columns are looked up. ``row_no`` orders
    the rows by the path of their file, then by their place in it. Quoted texts, those of the header
    too, may hold line breaks and doubled quotes, a byte order mark is skipped, empty cells are null,
    files without any text are left out.

    Each file is opened once, by one task, and what it holds is kept in the shared folder. Use
    ``multi_line=False`` for bulk files without line breaks: only those are split among tasks, after
    a pass that reads their headers, one line for each file.
    """
    if not multi_line:
        return _read_bulk(spark, path, key_col, value_col, case_insensitive)
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    rows = stored(
        texts.mapInArrow(_csv_rows(key_col, value_col, case_insensitive),
                         "file string, place long, key string, value string, fault string"),
        "guidelines")
    # A header is a row at place -1; of all faults, the one of the first file is raised.
    headers, fault = rows.filter("place = -1").agg(F.count("*"), F.min_by("fault", F.when(F.col("fault").isNotNull(), F.col("file")))).first()
    if fault is not None:
        raise KeyError(fault)
    if not headers:
        raise ValueError(f"no header row in {path}")
    # The driver has listed the files to read them; they are numbered from that list.
    files = sorted({*spark.read.text(path, wholetext=True).inputFiles()})
    numbers = spark.createDataFrame([(_same_path(f), i) for i, f in enumerate(files)], "_path string, _file_no long")
    numbered = rows.filter("place >= 0").withColumn("_path", _plain_path(F.col("file")))
    return lookup_join(numbered, numbers, ["_path"], "inner").select(
        "file", (F.col("_file_no") * _FILE_ROWS + F.col("place")).alias("row_no"), "key", "value")


def _same_path(file: str) -> str:
    """A path without the slashes that renderings of it differ in."""
    return re.sub("^([A-Za-z0-9+.-]+):/+", r"\1:/", file)


def _plain_path(file: Column) -> Column:
    return F.regexp_replace(file, "^([A-Za-z0-9+.-]+):/+", "$1:/")


def _csv_rows(key_col: str, value_col: str, case_insensitive: bool):
    names = ["file", "place", "key", "value", "fault"]

    def rows_of(file: str, text: str) -> Iterator[tuple]:
        lines = csv.reader(io.StringIO(text.removeprefix("\ufeff"), newline=""))
        header = next((line for line in lines if line), None)
        if header is None:
            return
        try:
            key, value = (header.index(find_column(header, c, case_insensitive)) for c in (key_col, value_col))
        except KeyError as error:
            yield file, -1, None, None, error.args[0]
            return
        yield file, -1, None, None, None
        for place, line in enumerate(line for line in lines if line):
            cell = lambda at: line[at] or None if at < len(line) else None  # noqa: B023, E731
            yield file, place, cell(key), cell(value), None

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(1 << 62)
        for batch in batches:
            for file, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                # Some rows at a time, so that a large file needs no second copy of itself.
                rows = rows_of(file, text or "")
                while part := list(islice(rows, 10_000)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.int64() if n == "place" else pa.string()) for n, c in zip(names, zip(*part))], names=names)

    return parse


def _read_bulk(spark: SparkSession, path: str, key_col: str, value_col: str, case_insensitive: bool) -> DataFrame:
    headers = _csv_headers(spark, path)
    if not headers:
        raise ValueError(f"no header row in {path}")
    columns = {
        tuple(names): (find_column(names, key_col, case_insensitive), find_column(names, value_col, case_insensitive))
        for _, names in headers
    }
    number = {file: i for i, (file, _) in enumerate(headers)}
    numbers = spark.createDataFrame(list(number.items()), "file string, _file_no long")
    out = None
    for names, (key, value) in columns.items():
        own = [file for file, found in headers if tuple(found) == names]
        # Names are given by place, as a header may repeat one or leave it empty.
        schema = ", ".join(f"_c{i} string" for i in range(len(names)))
        frame = spark.read.schema(schema).csv(own, header=True, escape='"', enforceSchema=True)
        rows = frame.select(
            F.col("_metadata.file_path").alias("file"),
            (F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).alias("_place"),
            F.col(f"_c{names.index(key)}").alias("key"),
            F.col(f"_c{names.index(value)}").alias("value"),
        )
        out = rows if out is None else out.unionByName(rows)
    return lookup_join(out, numbers, ["file"], "inner").select(
        "file", (F.col("_file_no") * _FILE_ROWS + F.col("_place")).alias("row_no"), "key", "value")


def _csv_headers(spark: SparkSession, path: str) -> list[tuple[str, list[str]]]:
    """Path and header of every file with text in it, by path."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value")
    first = lines.filter("at = 0").groupBy("file").agg(F.first("value").alias("line")).collect()
    found = []
    for file, line in sorted((r["file"], r["line"]) for r in first):
        names = next(csv.reader([line.removeprefix("\ufeff")]), [])
        if names:
            found.append((file, names))
    return found


def parse_pairs(texts: DataFrame, left: str = "chart", right: str = "stored") -> DataFrame:
    """Record pairs out of JSON texts (``file, doc``), with a ``problem`` where parts are missing.

    ``left`` and ``right`` name the two branches: the filled document and the stored record.
    Columns: ``file, internal, template_id, table_name, state, record_id, patient_id,
    facility_id, stored, problem``. Ids are texts; whole numbers are written without zeros in front.
    """
    q = lambda name: "`" + name.replace("`", "``") + "`"
    schema = (
        f"{q(left)} struct<schema_id:string,table_name:string,state:string,"
        "json_internal_filled:array<struct<internal_json:string>>>,"
        f"{q(right)} struct<ehr_patient_id:string,facility_id:string,"
        "assessments:struct<items:map<string,string>>>"
    )
    # The explode of one item keeps later filters from being moved in front of the parse, where
    # they would parse every text again.
    opened = texts.select("*", F.explode_outer(F.array(F.from_json("doc", schema))).alias("_b"))
    chart, stored = F.col("_b").getField(left), F.col("_b").getField(right)
    first = F.get(F.map_entries(stored["assessments"]["items"]), F.lit(0))
    fallback = F.get_json_object(F.col("_first.value"), "$.fac_id")
    facility = F.when(_falsy(F.col("_facility")), fallback).otherwise(F.col("_facility"))
    parts = opened.select(
        *texts.columns,
        F.get(chart["json_internal_filled"], F.lit(0))["internal_json"].alias("internal"),
        chart["schema_id"].alias("_schema"),
        F.coalesce(chart["table_name"], F.lit("")).alias("table_name"),
        F.coalesce(chart["state"], F.lit("")).alias("state"),
        first.alias("_first"),
        stored["ehr_patient_id"].alias("_patient"),
        stored["facility_id"].alias("_facility"),
        (chart.isNull() & stored.isNull() & F.json_object_keys("doc").isNull()).alias("_broken"),
        stored.isNull().alias("_alone"),
    )
    problem = (
        F.when(F.col("_broken"), "no JSON object")
        .when(_falsy(F.col("internal")) | (F.col("internal") == "{}"), "no filled document")
        .when(F.col("_alone"), "no stored record")
        .when(F.col("_first").isNull(), "stored record has no items")
    )
    return parts.select(
        *[c for c in texts.columns if c != "doc"],
        "internal",
        lenient_id(F.col("_schema")).alias("template_id"),
        "table_name",
        "state",
        lenient_id(F.col("_first.key")).alias("record_id"),
        lenient_id(F.col("_patient")).alias("patient_id"),
        lenient_id(facility).alias("facility_id"),
        F.from_json("_first.value", STORED_RECORD).alias("stored"),
        problem.alias("problem"),
    )


def _falsy(text: Column) -> Column:
    return blank(text) | (text == "0")


def read_pairs(
    spark: SparkSession, path: str, left: str = "chart", right: str = "stored",
    glob: str = "*.json", one_per_line: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Record pairs of a folder: the usable ones, and the files that are left out with the reason."""
    parsed = parse_pairs(read_json_texts(spark, path, glob, one_per_line), left, right)
    return parsed.filter("problem is null").drop("problem"), parsed.filter(
        "problem is not null"
    ).select("file", "problem")
