"""What several of the operators share: reading tables, set filters of fixed size, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.session import stored

_MIX_1, _MIX_2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_SHIFT = np.uint64(33)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def set_aside(frame: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``frame`` with new names for the columns that begin with an underscore, as all names of helper
    columns do; and the new name of every column by its old one, for :func:`put_back`."""
    taken = {c.lower() for c in frame.columns}
    names = {c: c for c in frame.columns}
    for i, c in enumerate(frame.columns):
        if c.startswith("_"):
            new = f"aside_{i}"
            while new in taken:
                new += "_"
            names[c] = new
    return frame.toDF(*names.values()), names


def put_back(frame: DataFrame, names: dict[str, str]) -> DataFrame:
    """Old names for the columns of :func:`set_aside`; others, new ones included, keep theirs."""
    return frame.withColumnsRenamed({new: old for old, new in names.items() if new != old})


def row_key(*columns: str) -> Column:
    """128 bits that stand for these values of a row; null is told apart from empty."""
    parts = [F.concat(F.when(F.col(c).isNull(), "-").otherwise(F.lit("+")), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]
    return F.unhex(F.md5(F.encode(F.concat_ws("\0", *parts), "UTF-8")))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x ^ (x >> _SHIFT)
    x = x * _MIX_1
    x = x ^ (x >> _SHIFT)
    x = x * _MIX_2
    return x ^ (x >> _SHIFT)


def spans(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of these lengths laid end to end: the run of each item and its place in the run."""
    run = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    return run, np.arange(len(run)) - first[run]


# --- sets of numbers as bitmaps of fixed size ------------------------------------------------

_CHUNK = 1 << 16  # bytes


def bitmap(ids: DataFrame, bits: int = 26) -> np.ndarray:
    """Bitmap of ``2**bits`` places with the place of each id (a long column named ``id``) set.

    Its size is fixed (8 MB by default), so it may go to the driver and to every executor. Ids
    that share a place pass the filter without being in the set: what follows must check again.
    """
    mask = np.uint64((1 << bits) - 1)

    def marks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            at = mixed(batch["id"].to_numpy(np.int64).view(np.uint64)) & mask
            chunk = (at // np.uint64(8 * _CHUNK)).astype(np.int64)
            inside = (at % np.uint64(8 * _CHUNK)).astype(np.int64)
            for c in np.unique(chunk):
                page = seen.setdefault(int(c), np.zeros(_CHUNK, np.uint8))
                x = inside[chunk == c]
                np.bitwise_or.at(page, x >> 3, (1 << (x & 7)).astype(np.uint8))
        yield pd.DataFrame({"chunk": list(seen), "page": [p.tobytes() for p in seen.values()]})

    def merged(chunk: pd.DataFrame) -> pd.DataFrame:
        page = np.zeros(_CHUNK, np.uint8)
        for p in chunk["page"]:
            page |= np.frombuffer(p, np.uint8)
        return pd.DataFrame({"chunk": chunk["chunk"].iloc[:1], "page": [page.tobytes()]})

    schema = "chunk int, page binary"
    rows = ids.select("id").filter("id is not null").mapInPandas(marks, schema)
    full = np.zeros(-(-(1 << bits) // (8 * _CHUNK)) * _CHUNK, np.uint8)
    for chunk, page in rows.groupBy("chunk").applyInPandas(merged, schema).toLocalIterator():
        full[chunk * _CHUNK : (chunk + 1) * _CHUNK] = np.frombuffer(page, np.uint8)
    return full


def in_bitmap(ids: np.ndarray, full: np.ndarray, bits: int = 26) -> np.ndarray:
    at = mixed(ids.view(np.uint64)) & np.uint64((1 << bits) - 1)
    return (full[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def likely_in(spark: SparkSession, full: np.ndarray, column: Column, bits: int = 26) -> Column:
    """Whether a long column may be in the set (never false for a member)."""
    shared = spark.sparkContext.broadcast(full)

    @F.pandas_udf("boolean")
    def test(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        values = ids.fillna(0).to_numpy(np.int64)
        return pd.Series(in_bitmap(values, shared.value, bits) & known)

    return test(column)


# --- connected components --------------------------------------------------------------------


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Rows (node, root) for every node of the edges (a, b): root is the smallest node reachable.

    Alternates large-star and small-star steps. Each step is an aggregate and a join, written to
    the shared folder, so neither a hub nor a long chain ends up in one task or on the driver.
    """
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = stored(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        near = both(edges)
        least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = near.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a")
        edges = stored(
            small.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(least.select("a", F.col("m").alias("b")))
            .filter("a <> b").distinct(),
            "edges",
        )
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components have not settled in {most_rounds} rounds")
    roots = edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return roots.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


# --- the same filter in built-in functions only ----------------------------------------------

#: Words of 64 bits: a table of as many rows at most, whatever the set.
_WORDS = 1 << 18


def bit_table(hashes: DataFrame) -> DataFrame:
    """The set of a long column ``id`` as rows (_word, _bits): at most ``2**18``, so it may be
    broadcast. Ids that share a bit pass the filter as well: what follows must check again."""
    return hashes.filter("id is not null").groupBy(F.pmod("id", F.lit(_WORDS)).cast("int").alias("_word")).agg(
        F.bit_or(_bit(F.col("id"))).alias("_bits"))


def _bit(hash_: Column) -> Column:
    place = F.pmod(F.shiftright(hash_, 40), F.lit(64)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def with_hit(frame: DataFrame, bits: DataFrame, hash_: Column) -> DataFrame:
    """``frame`` with ``_hit``: whether the hash may be in the set (never false for a member)."""
    columns = frame.columns
    marked = frame.withColumn("_h", hash_).withColumn("_word", F.pmod("_h", F.lit(_WORDS)).cast("int"))
    return marked.join(F.broadcast(bits), "_word", "left").select(
        *columns, (F.coalesce("_bits", F.lit(0)).bitwiseAND(_bit(F.col("_h"))) != 0).alias("_hit"))


def without(frame: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``frame`` whose keys are not in ``gone`` (a stored table of these columns).

    Only rows that the table of bits doesn't clear are shuffled, so wide rows mostly stay where
    they are. Rows with a null key stay.
    """
    columns = frame.columns
    marked = with_hit(frame, bit_table(gone.select(F.xxhash64(*keys).alias("id"))), F.xxhash64(*keys))
    clear = marked.filter("not _hit").select(*columns)
    return clear.union(marked.filter("_hit").select(*columns).join(gone, keys, "left_anti").select(*columns))
