"""Joining wide fact tables with lookup tables of unknown size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest lookup table (measured, in bytes of its JSON rendering) that is sent to every task.
BROADCAST_BYTES = 64 * 1024 * 1024
#: Number of parts a hot key is cut into when the lookup table is too large to broadcast.
SALTS = 32
#: Number of keys that are treated as hot at most. More can't each hold a large share of the rows.
HOT_KEYS = 256


def fits_broadcast(frame: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Measure the rows themselves: true only if the whole table stays below the limit."""
    row_bytes = F.octet_length(F.to_json(F.struct(*frame.columns))) + 64
    # Maps and arrays cost a word per item on top of the text, hence the factor.
    size = frame.agg(F.sum(row_bytes).alias("bytes")).first()["bytes"] or 0
    return 2 * size <= limit


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    limit: int = BROADCAST_BYTES,
    salts: int = SALTS,
) -> DataFrame:
    """Join facts with a lookup table that has one row per key.

    The lookup side is cached and measured. Below the limit it is broadcast: no shuffle of the
    facts, and no skew whatever the keys look like. Above it, both sides are shuffled; hot keys are
    found with a sketch, their facts spread over ``salts`` parts and only their lookup rows
    copied to each part, so a key that holds a third of the facts is still worked on by many tasks.
    """
    if how not in ("left", "inner", "leftsemi", "leftanti"):
        raise ValueError(f"lookup_join keeps the facts, so it cannot do a {how} join")
    keys = list(keys)
    lookup = lookup.persist(StorageLevel.MEMORY_AND_DISK)
    if fits_broadcast(lookup, limit):
        return facts.join(F.broadcast(lookup), keys, how)
    lookup.unpersist()
    return salted_join(facts, lookup, keys, how, salts)


def salted_join(
    facts: DataFrame, lookup: DataFrame, keys: Sequence[str], how: str = "left", salts: int = SALTS,
    hot: Sequence[int] | None = None,
) -> DataFrame:
    """Shuffle join with the facts of hot keys cut into ``salts`` parts.

    Only the lookup rows of hot keys are copied to the parts. ``hot`` has hashes of keys (see
    :func:`hot_keys`); without it every key is cut, as for streams, which can't be counted beforehand.
    A cold key whose hash is that of a hot one is cut as well; the result is the same either way.
    """
    keys = list(keys)
    if hot is None and not facts.isStreaming:
        hot = hot_keys(facts, keys)
    # Hashes depend on types: both sides take those of the facts.
    kinds = {k: facts.schema[k].dataType for k in keys}

    def is_hot(side: DataFrame) -> Column:
        if hot is None or not hot:
            return F.lit(hot is None)
        return F.xxhash64(*(side[k].try_cast(kinds[k]) if side.schema[k].dataType != kinds[k] else side[k] for k in keys)).isin(list(hot))

    # The hash covers the whole row, so equal keys spread evenly and retried tasks agree.
    part = F.when(is_hot(facts), F.pmod(F.xxhash64(*_hashable(facts)), F.lit(salts)).cast("int")).otherwise(0)
    parts = F.when(is_hot(lookup), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    left = facts.withColumn("_part", part)
    right = lookup.withColumn("_part", F.explode(parts))
    return left.join(right, [*keys, "_part"], how).drop("_part")


def hot_keys(facts: DataFrame, keys: Sequence[str], partitions: int | None = None, most: int = HOT_KEYS) -> list[int]:
    """Hashes of the keys that hold more rows than half a shuffle partition should: ``most`` at most.

    One pass over the keys with a sketch of frequent items. It is of fixed size and merged task by task,
    so neither the keys nor their counts are collected. Rows without a key count as one more key. What the
    sketch misses by its error (a few times 1 / ``8 * most`` of all rows) is no hot key.
    """
    partitions = partitions or int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashes = facts.select(F.xxhash64(*keys).alias("k"))
    found = hashes.agg(
        F.count("*").alias("n"), F.call_function("approx_top_k", F.col("k"), F.lit(most), F.lit(8 * most)).alias("top")
    ).first()
    least = max(found["n"] / (2 * max(partitions, 2)), found["n"] / (2 * most))
    return [row["item"] for row in found["top"] or () if row["count"] > least]


def _hashable(frame: DataFrame) -> list[str]:
    plain = [
        name
        for name, kind in frame.dtypes
        if not any(word in kind for word in ("map<", "variant"))
    ]
    return plain or [frame.columns[0]]
