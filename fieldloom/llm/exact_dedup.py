"""Exact duplicates by a stream with keyed state on disk, checked byte by byte."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fieldloom.llm.common import bitmap, likely_in
from fieldloom.session import shared_folder, stored

_ROCKS = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # One pool of memory for all states of an executor; the rest of a state lies on its disk.
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # Else every state takes megabytes of disk in advance, however little it holds.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def squeezed(text: Column) -> Column:
    """The text without space, tab, line feed, vertical tab, form feed and carriage return."""
    text = F.coalesce(text, F.lit(""))
    for code in (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D):
        text = F.replace(text, F.lit(chr(code)), F.lit(""))
    return text


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def _located(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    """Digest, size and place of each row. The place (file and row in it) is the content locator."""
    return docs.select(
        F.col(id_col).alias("id"),
        F.concat_ws("#", "_metadata.file_path", F.lpad(F.col("_metadata.row_index").cast("string"), 12, "0")).alias("place"),
        digest(squeezed(F.col(text_col))).alias("digest"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("points"),
    )


def run_dedup_stream(
    spark: SparkSession,
    path: str,
    schema: StructType,
    checkpoint: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256,
    max_bytes: int = 64 << 30,
) -> None:
    """Take all files of ``path`` that the checkpoint has not seen into the state.

    Micro-batches of up to ``max_bytes`` of files. The state lies in RocksDB and in the checkpoint
    folder, keyed by digest, and never expires: later calls go on from it, and a lost executor's
    part is read again from the checkpoint. A value is the best row so far (most code points, then
    smallest id, then place) with its locator, and the count of rows.
    """
    before = {k: spark.conf.get(k, None) for k in _ROCKS}
    for k, v in _ROCKS.items():
        spark.conf.set(k, v)
    try:
        # As a pattern the path may be one file as well as a folder of files.
        folder, _, name = path.rstrip("/").rpartition("/")
        files = f"{folder}/{{{name}}}"
        stream = spark.readStream.schema(schema).option("maxBytesPerTrigger", str(max_bytes)).parquet(files)
        rows = _located(stream, id_col, text_col, digest)
        state = rows.groupBy("digest").agg(
            F.max(_rank()).alias("best"), F.count("*").alias("size"))
        query = (
            state.writeStream.outputMode("update").trigger(availableNow=True)
            .option("checkpointLocation", checkpoint).format("noop").start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _rank() -> Column:
    """Greatest for the row that stays. Ids are integers; a null id comes last."""
    return F.struct(
        F.col("points").alias("points"), (-F.col("id")).alias("minus_id"),
        # The first place wins: the bits of its text are turned over.
        F.translate("place", _PLACES, _PLACES[::-1]).alias("ecalp"), F.col("place").alias("place"))


#: Printable ASCII, in the order of its codes.
_PLACES = "".join(map(chr, range(0x20, 0x7F)))


def read_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """What the state holds: digest, keep_id, keep_place, size."""
    state = spark.read.format("statestore").load(checkpoint)
    value = state.schema["value"].dataType.fieldNames()
    best = next(n for n in value if n.startswith("max"))
    count = next(n for n in value if n.startswith("count"))
    return state.select(
        F.col("key.digest").alias("digest"), (-F.col(f"value.{best}.minus_id")).alias("keep_id"),
        F.col(f"value.{best}.place").alias("keep_place"), F.col(f"value.{count}").alias("size"))


def exact_dedup(
    spark: SparkSession,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256,
    max_bytes: int = 64 << 30,
    checkpoint: str | None = None,
) -> DataFrame:
    """One row for each row of the Parquet files at ``path``: ``id, keep_id, group_size, kept, digest``.

    Texts are equal when they are after :func:`squeezed`; null counts as empty. Of equal texts the
    row with the most code points stays, then the one with the smallest id (null last), then, of
    repeated rows, the first by place, so exactly one row of a group has ``kept``.

    A stream keeps the state (:func:`run_dedup_stream`). Each row is then joined to its digest's
    state; every row that hits another is checked: its bytes are compared with those found at the
    state's locator. Rows whose bytes differ under the same digest are grouped by their whole texts
    instead, so that a weak digest changes nothing but the work. An empty table gives no rows.

    Only ids, places and digests are shuffled for all rows; texts are shuffled for rows that hit
    (found by a bitmap of fixed size, then a join). A hot digest is one row of state and a skewed
    side of a plain join, which Spark splits.
    """
    checkpoint = checkpoint or shared_folder(spark, "state")
    docs = spark.read.parquet(path)
    run_dedup_stream(spark, path, docs.schema, checkpoint, id_col, text_col, digest, max_bytes)
    state = read_state(spark, checkpoint)
    rows = _located(docs, id_col, text_col, digest)
    joined = stored(rows.join(state, "digest"), "joined")
    hits = joined.filter("size > 1")
    texts = docs.select(
        F.concat_ws("#", "_metadata.file_path", F.lpad(F.col("_metadata.row_index").cast("string"), 12, "0")).alias("place"),
        F.encode(squeezed(F.col(text_col)), "UTF-8").alias("bytes"))
    full = bitmap(hits.select(F.xxhash64("place").alias("id")))
    texts = texts.filter(likely_in(spark, full, F.xxhash64("place")))
    found = hits.select("place", "keep_place").join(texts, "place")
    kept = hits.filter("place = keep_place").select("place").join(texts, "place").select(
        F.col("place").alias("keep_place"), F.col("bytes").alias("kept_bytes"))
    wrong = stored(
        found.filter("place <> keep_place").join(kept, "keep_place").filter("bytes <> kept_bytes").select("place"),
        "wrong")
    if not wrong.isEmpty():
        joined = _regrouped(joined, wrong, texts)
    return joined.select(
        "id", "keep_id", F.col("size").alias("group_size"),
        (F.col("place") == F.col("keep_place")).alias("kept"), "digest")


def _regrouped(joined: DataFrame, wrong: DataFrame, texts: DataFrame) -> DataFrame:
    """Group sizes and kept rows anew, by whole texts, where a digest stands for several texts."""
    mixed = joined.join(wrong, "place", "left_semi").select("digest").distinct()
    sound = joined.join(mixed, "digest", "left_anti")
    again = joined.join(mixed, "digest", "left_semi").drop("keep_id", "keep_place", "size").join(texts, "place")
    groups = again.groupBy("digest", "bytes").agg(F.max(_rank()).alias("best"), F.count("*").alias("size"))
    new = again.join(groups, ["digest", "bytes"]).select(
        "digest", "id", "place", "points", (-F.col("best.minus_id")).alias("keep_id"),
        F.col("best.place").alias("keep_place"), "size")
    return sound.select(*new.columns).union(new)
