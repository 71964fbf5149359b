"""Sampling to target weights of source, language and topic by iterative proportional fitting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.llm.common import put_back, set_aside

OTHER = "(other)"
#: Cells up to which their probabilities are broadcast (16 bytes each).
BROADCAST_CELLS = 1 << 20

#: Topics by words that speak for them, in the order in which ties are settled.
TOPICS: dict[str, str] = {
    "licence": r"(?i)\b(?:licen[sc]ed?|copyright|rights)\b",
    "access": r"(?i)\b(?:token|password|secret|api)\b",
    "contact": r"@|(?i:\b(?:phone|mail|call)\b)",
}


def topic_of(text: Column, topics: Mapping[str, str] = TOPICS) -> Column:
    """The topic whose pattern is found most often in the whole text; ``general`` if none is."""
    counts = [F.struct(F.regexp_count(text, F.lit(p)).alias("n"), F.lit(-i).alias("o"), F.lit(t).alias("topic"))
              for i, (t, p) in enumerate(topics.items())]
    best = F.array_max(F.array(*counts))
    return F.when(best["n"] > 0, best["topic"]).otherwise("general")


def token_count(text: Column) -> Column:
    """Words between white space in the whole text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def rake(
    mass: np.ndarray,
    targets: Sequence[np.ndarray],
    budget: float,
    cells: np.ndarray | None = None,
    rounds: int = 200,
    tolerance: float = 1e-9,
) -> np.ndarray:
    """Expected tokens of each cell, at most what it has, with marginals in the targets' proportions.

    ``cells`` has a row for each dimension with the category of every cell, so only cells that occur
    need be there; without it ``mass`` is the full grid. Each round scales the cells along every
    dimension to its targets, then brings cells above what they hold back to it. Where a category
    holds too little, it is taken whole and the rest keeps the proportions it can. Stops when no
    cell moves by more than ``tolerance`` of the budget.
    """
    if cells is None:
        cells = np.indices(mass.shape).reshape(mass.ndim, -1)
    held = mass.ravel()
    limits = [np.bincount(c, held, len(t)).astype(float) for c, t in zip(cells, targets, strict=True)]
    kept = held * (budget / max(held.sum(), 1e-300))
    for _ in range(rounds):
        before = kept.copy()
        for category, target, limit in zip(cells, targets, limits, strict=True):
            now = np.bincount(category, kept, len(target)).astype(float)
            # What a category cannot give is shared among those that can.
            want = target * budget
            short = np.zeros(len(target), bool)
            while (want > limit)[~short].any():
                short |= want > limit
                share = target[~short].sum()
                rest = max(0.0, budget - limit[short].sum())
                want = np.where(short, limit, target * (rest / share) if share > 0 else 0.0)
            factor = np.divide(want, now, out=np.zeros_like(now), where=now > 0)
            kept = np.minimum(kept * factor[category], held)
        if np.abs(kept - before).max(initial=0) <= tolerance * max(budget, 1):
            break
    return kept.reshape(mass.shape)


def mix_to_targets(
    docs: DataFrame,
    targets: Mapping[str, Mapping[str, float]],
    fraction: float = 0.5,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    topics: Mapping[str, str] = TOPICS,
) -> DataFrame:
    """``docs`` with ``topic, n_tokens, probability, sampled``.

    ``targets`` gives, for each of the columns (say ``source``, ``lang``, ``topic``), the wanted
    share of tokens of each category. Categories that are not named, and null, count together as
    one; its share is what the named ones leave of 1, or, when they leave nothing, the share of the
    tokens that it has (the named ones then divide the rest). ``topic`` is computed by :func:`topic_of` unless ``docs`` has such a column.

    Tokens are summed over all documents by the cells of these categories that occur. Their number
    is bounded by the product of the targets' sizes; they are raked on the driver, and broadcast up
    to ``BROADCAST_CELLS``. A
    document's probability is the raked tokens of its cell over the tokens the cell has; with
    ``fraction`` of all tokens wanted. It is sampled when a hash of seed, id and text lies below
    that, so a second run, or a lost executor, changes nothing and repeated rows go together.
    Empty and null texts have no tokens and the probability of their cell; a cell without tokens
    has ``fraction``. An empty table gives no rows. Columns named like a new one are replaced,
    those named like helpers pass through. Texts of any length are read whole.
    """
    spark = docs.sparkSession
    out, renamed = set_aside(docs.drop("n_tokens", "probability", "sampled"))
    given, id_col, text_col = out.columns, renamed[id_col], renamed[text_col]
    if "topic" in targets and "topic" not in given:
        out = out.withColumn("topic", topic_of(F.coalesce(F.col(text_col), F.lit("")), topics))
    out = out.withColumn("n_tokens", token_count(F.col(text_col)))
    names = list(targets)
    keys = [sorted(targets[n]) + [OTHER] for n in names]
    cell = F.lit(0).cast("long")
    for name, key in zip(names, keys, strict=True):
        place = F.array_position(F.array(*map(F.lit, key[:-1])), F.col(renamed.get(name, name)).cast("string")).cast("int")
        cell = cell * len(key) + F.coalesce(F.when(place > 0, place - 1), F.lit(len(key) - 1))
    out = out.withColumn("_cell", cell)
    found = out.groupBy("_cell").agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n")).orderBy("_cell").collect()
    numbers, mass = np.array([r["_cell"] for r in found], np.int64), np.array([r["n"] for r in found], float)
    cells = np.array(np.unravel_index(numbers, [len(k) for k in keys])).reshape(len(keys), -1)
    wanted = []
    for category, name, key in zip(cells, names, keys, strict=True):
        shares = np.array([max(0.0, float(targets[name][k])) for k in key[:-1]])
        left = 1 - shares.sum()
        if left < 1e-9 and mass.sum() > 0:
            other = mass[category == len(key) - 1].sum() / mass.sum()
            full = np.append(shares / shares.sum() * (1 - other), other)
        else:
            full = np.append(shares, max(0.0, left))
        wanted.append(full / full.sum() if full.sum() > 0 else np.full(len(key), 1 / len(key)))
    kept = rake(mass, wanted, fraction * mass.sum(), cells)
    chance = np.where(mass > 0, kept / np.where(mass > 0, mass, 1), fraction)
    schema = T.StructType([T.StructField("_cell", T.LongType()), T.StructField("probability", T.DoubleType())])
    table = spark.createDataFrame([(int(i), float(min(1.0, c))) for i, c in zip(numbers, chance, strict=True)], schema)
    if len(numbers) <= BROADCAST_CELLS:
        table = F.broadcast(table)
    dice = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)), 11)).cast("double") / float(1 << 53)
    sampled = out.join(table, "_cell", "left").withColumn("sampled", dice < F.col("probability"))
    return put_back(sampled.drop("_cell"), renamed)
