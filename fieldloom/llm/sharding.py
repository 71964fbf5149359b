"""Shards in the order of a Hilbert curve over metadata, so that files can be skipped by any of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import partitions, put_back, set_aside

#: Bits of each dimension: 2**BITS steps, so 4,096 cells for three dimensions.
BITS = 4


def hilbert_index(dims: Sequence[Column], bits: int = BITS) -> Column:
    """Place on the Hilbert curve through the grid of ``2**bits`` steps in each dimension.

    Built-in functions only: the bits are folded one by one over an array of the coordinates, from
    the highest to the lowest; each step reflects or exchanges the lower bits of two dimensions,
    then Gray decoding gives the index. Null coordinates count as 0.
    """
    n = len(dims)
    point = F.array(*(F.coalesce(d.cast("int"), F.lit(0)) for d in dims))

    # One fold over (bit, dimension) pairs keeps the expression small.
    steps = F.array(*(F.struct(F.lit(1 << b).alias("bit"), F.lit(i).alias("dim"))
                      for b in range(bits - 1, 0, -1) for i in range(n)))

    def one(x: Column, s: Column) -> Column:
        bit, dim = s["bit"], s["dim"]
        low = bit - 1
        first, other = x[0], F.get(x, dim)
        swap = first.bitwiseXOR(other).bitwiseAND(low)
        turn = other.bitwiseAND(bit) != 0
        return F.transform(
            x,
            lambda v, i: F.when(turn, F.when(i == 0, v.bitwiseXOR(low)).otherwise(v))
            .otherwise(F.when((i == 0) | (i == dim), v.bitwiseXOR(swap)).otherwise(v)),
        )

    x = F.aggregate(steps, point, one)
    # Gray decoding: each coordinate takes the exclusive or of those up to it.
    x = F.transform(F.array(x), lambda v: F.transform(
        v, lambda w, k: F.aggregate(F.slice(v, 1, k), w, lambda t, u: t.bitwiseXOR(u))))[0]
    flips = F.array(*(F.lit(1 << b) for b in range(bits - 1, 0, -1)))
    turn = F.transform(F.array(x), lambda v: F.aggregate(
        flips, F.lit(0), lambda t, bit: F.when(v[n - 1].bitwiseAND(bit) != 0, t.bitwiseXOR(bit - 1)).otherwise(t)))[0]
    x = F.transform(F.array(F.struct(x.alias("x"), turn.alias("t"))),
                    lambda s: F.transform(s["x"], lambda w: w.bitwiseXOR(s["t"])))[0]
    # The index takes one bit of each dimension in turn, the highest first.
    places = F.array(*(F.struct(F.lit(b).alias("b"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)))
    bit_of = lambda v, s: F.get(v, s["i"]).bitwiseAND(F.element_at(powers, s["b"] + 1)) != 0
    powers = F.array(*(F.lit(1 << b) for b in range(bits)))
    return F.transform(F.array(x), lambda v: F.aggregate(
        places, F.lit(0).cast("bigint"),
        lambda acc, s: acc * 2 + F.when(bit_of(v, s), 1).otherwise(0)))[0]


def _prefix_number(text: Column, skip: Column) -> Column:
    """Six bytes of a text, after ``skip`` characters, as a number in the order of the text."""
    piece = F.substring(F.hex(F.encode(F.substr(text, skip + 1), "UTF-8")), 1, 12)
    return F.conv(F.rpad(F.coalesce(piece, F.lit("")), 12, "0"), 16, 10).cast("bigint")


def quantised(docs: DataFrame, dims: Sequence[str], bits: int = BITS) -> DataFrame:
    """Columns ``_q0, _q1, …`` with each dimension in ``2**bits`` steps of its order.

    Steps are cut at quantiles, so that about as many rows lie in each; a value that is more often
    than that has a step of its own and leaves those behind it empty, so few values are still far
    apart on the curve. Texts are taken by the
    six bytes after the prefix that all of them share. Null lies in step 0. Least, greatest and
    quantiles are aggregates of bounded size.
    """
    steps = 1 << bits
    kinds = dict(docs.dtypes)
    texts = [d for d in dims if kinds[d] == "string"]
    ends = docs.agg(F.count("*"), *(f(d).alias(f"{n}{texts.index(d)}") for d in texts for n, f in (("lo", F.min), ("hi", F.max)))).first()
    values = []
    for d in dims:
        if d not in texts:
            values.append(F.col(d).cast("double"))
            continue
        low, high = (ends[f"{n}{texts.index(d)}"] or "" for n in ("lo", "hi"))
        skip = next((k for k, (x, y) in enumerate(zip(low, high, strict=False)) if x != y), min(len(low), len(high)))
        values.append(F.when(F.col(d).isNotNull(), _prefix_number(F.col(d), F.lit(skip))))
    shares = F.array(*(F.lit(k / steps) for k in range(1, steps)))
    cuts = docs.agg(*(F.percentile_approx(v, shares, 10_000).alias(f"c{i}") for i, v in enumerate(values))).first()
    out = docs
    for i, value in enumerate(values):
        step = F.lit(0)
        for cut in cuts[i] or []:
            step = step + (value > F.lit(cut)).cast("int")
        out = out.withColumn(f"_q{i}", F.coalesce(step, F.lit(0)).cast("int"))
    return out


def hilbert_shards(
    docs: DataFrame,
    dims: Sequence[str] = ("lang", "source", "n_chars"),
    shards: int = 16,
    id_col: str = "doc_id",
    text_col: str = "text",
    bits: int = BITS,
) -> DataFrame:
    """``docs`` with ``size, text_crc32, hilbert, shard`` (0 to ``shards`` - 1) and ``slot`` (from 0).

    Rows are ordered by their cell's place on the curve and cut into runs whose row counts differ
    by one at most (law ``rows``). ``size`` is the UTF-8 bytes of the text plus 1.

    A cell may hold a third of all rows, so each is dealt over as many parts as there are shuffle
    partitions, by the id. Counts of (cell, part) give each part the place at which it begins: at
    most ``2**(bits * dims)`` cells times the parts, summed up in two steps whose windows hold the
    cells, and the parts of a cell. Only rows of one part are numbered together. Within a part rows
    go by id, checksum and size. Null ids and texts, empty texts and repeated rows are rows like
    others (a null text has size 1 and the checksum of no bytes); an empty table gives no rows.
    Texts of any length are only measured. Columns of ``docs`` named like a new one are replaced, those
    named like helpers pass through.
    """
    spark = docs.sparkSession
    parts = partitions(spark)
    docs, names = set_aside(docs.drop("size", "text_crc32", "hilbert", "shard", "slot"))
    id_col, text_col, dims = names[id_col], names[text_col], [names[d] for d in dims]
    bytes_of = F.coalesce(F.encode(F.col(text_col), "UTF-8"), F.lit(b""))
    cells = quantised(docs, dims, bits)
    cell = F.lit(0)
    for i in range(len(dims)):
        cell = F.shiftleft(cell, bits) + F.col(f"_q{i}")
    rows = cells.select(
        *docs.columns,
        (F.octet_length(bytes_of) + 1).cast("long").alias("size"),
        F.crc32(bytes_of).alias("text_crc32"),
        cell.alias("_cell"),
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(parts)).cast("int").alias("_part"),
    )
    counts = rows.groupBy("_cell", "_part").agg(F.count("*").alias("_n"))
    by_cell = counts.groupBy("_cell").agg(F.sum("_n").alias("_cell_n"))
    mask = (1 << bits) - 1
    coordinates = [F.shiftright("_cell", bits * (len(dims) - 1 - i)).bitwiseAND(mask) for i in range(len(dims))]
    curve = by_cell.withColumn("hilbert", hilbert_index(coordinates, bits))
    whole = Window.orderBy("hilbert").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # One row for each cell: a bounded table.
    placed = curve.select(
        "_cell", "hilbert",
        (F.sum("_cell_n").over(whole) - F.col("_cell_n")).alias("_cell_at"),
        F.sum("_cell_n").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"),
    )
    in_cell = Window.partitionBy("_cell").orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begins = counts.withColumn("_part_at", F.sum("_n").over(in_cell) - F.col("_n")).join(F.broadcast(placed), "_cell")
    in_part = Window.partitionBy("_cell", "_part").orderBy(F.col(id_col), "text_crc32", "size")
    numbered = rows.withColumn("_rank", F.row_number().over(in_part) - 1)
    at = F.col("_cell_at") + F.col("_part_at") + F.col("_rank")
    each, longer = F.expr(f"_all div {shards}"), F.expr(f"_all % {shards}")
    edge = longer * (each + 1)
    shard = F.when(F.col("_at") < edge, F.expr(f"_at div (_all div {shards} + 1)")).otherwise(
        longer + F.expr(f"(_at - (_all % {shards}) * (_all div {shards} + 1)) div greatest(1, _all div {shards})"))
    begin = F.col("shard") * each + F.least(F.col("shard").cast("long"), longer)
    return put_back(
        numbered.join(begins, ["_cell", "_part"])
        .withColumn("_at", at)
        .withColumn("shard", shard.cast("int"))
        .withColumn("slot", (F.col("_at") - begin).cast("long"))
        .select(*docs.columns, "size", "text_crc32", "hilbert", "shard", "slot"),
        names)


def write_shards(sharded: DataFrame, path: str, shards: int = 16, files: int = 4) -> None:
    """``sharded`` as Parquet, one folder for each shard, of some ``files`` files in curve order: readers
    skip files by the ranges of any of the dimensions."""
    (
        sharded.repartitionByRange(shards * files, "shard", "slot")
        .sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard").parquet(path)
    )
