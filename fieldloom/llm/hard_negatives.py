"""Hard negatives: rows of another label that score just below an anchor's positives.

The positives' upper limits cut the scores of an anchor into disjoint slots. Each task keeps the
best ``k`` rows of every slot, so what is shuffled doesn't depend on how many rows fall into a
window, and a merge takes the best ``k`` of what the tasks kept. As the slots are disjoint, the
best of all scores up to a limit are the lists of its slot and the slots below it, one after another;
one descending pass answers all overlapping windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.vectors import largest, matrices
from fieldloom.session import shared_folder, stored

#: Anchors that are sent to the tasks at once, and their bytes at most.
BLOCK_ANCHORS, BLOCK_BYTES = 4096, 32 << 20
#: Scores that a task holds at once.
_CELLS = 1 << 21

_RESULT = ("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
_NONE = np.iinfo(np.int64).min


@dataclass(frozen=True)
class Windows:
    """Scores ``s`` with ``low * p <= of * s <= high * p`` go with a positive of score ``p``."""

    low: int = 30
    high: int = 90
    of: int = 100

    def limits(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest score of the window; empty where the first is above the second."""
        return -((-self.low * p) // self.of), (self.high * p) // self.of


def first_of_groups(groups: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the best ``k`` of each group, in order of group, score (falling) and id."""
    order = np.lexsort((ids, -scores, groups))
    g = groups[order]
    new = np.ones(len(g), bool)
    new[1:] = g[1:] != g[:-1]
    places = np.arange(len(g))
    return order[places - np.maximum.accumulate(np.where(new, places, 0)) < k]


class Best:
    """The best ``k`` rows of each group among all that were offered."""

    def __init__(self, groups: int, k: int) -> None:
        self.k = k
        self.groups = np.empty(0, np.int64)
        self.scores = np.empty(0, np.int64)
        self.ids = np.empty(0, np.int64)
        #: Scores below this one can't enter a group any more.
        self.floor = np.full(groups, _NONE)

    def offer(self, groups: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(groups):
            return
        groups, scores, ids = (np.concatenate(x) for x in ((self.groups, groups), (self.scores, scores), (self.ids, ids)))
        keep = first_of_groups(groups, scores, ids, self.k)
        self.groups, self.scores, self.ids = groups[keep], scores[keep], ids[keep]
        full = np.bincount(self.groups, minlength=len(self.floor)) == self.k
        last = np.flatnonzero(np.r_[self.groups[1:] != self.groups[:-1], True])
        self.floor[self.groups[last]] = np.where(full[self.groups[last]], self.scores[last], _NONE)


@dataclass(frozen=True)
class Anchors:
    """A block of anchors: vectors of one length as a matrix for each length."""

    ids: np.ndarray
    labels: np.ndarray
    matrices: dict[int, tuple[np.ndarray, np.ndarray]]

    def scores(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Anchors' places, rows' ids and labels, and the matrix of inner products, piece by piece."""
        all_ids = batch.column(0).to_numpy(zero_copy_only=False)
        all_labels = batch.column(1).to_numpy(zero_copy_only=False)
        for rows, matrix in matrices(batch.column(2)):
            if matrix.shape[1] not in self.matrices:
                continue
            anchors, own = self.matrices[matrix.shape[1]]
            if largest(own) * largest(matrix) * matrix.shape[1] >= 1 << 53:
                raise ValueError("inner products beyond 2**53 are not exact: use a smaller scale")
            step = max(1, _CELLS // len(anchors))
            for at in range(0, len(rows), step):
                piece = rows[at : at + step]
                # Whole numbers below 2**53 are exact as doubles, and so are their sums.
                products = own.astype(float) @ matrix[at : at + step].astype(float).T
                yield anchors, all_ids[piece], all_labels[piece], products.astype(np.int64)


def _top_positives(block: Anchors, k: int):
    schema = pa.schema([("anchor", pa.int64()), ("score", pa.int64()), ("id", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(block.ids), k)
        for batch in batches:
            for anchors, ids, labels, scores in block.scores(batch):
                fits = (block.labels[anchors][:, None] == labels) & (block.ids[anchors][:, None] != ids)
                a, r = np.nonzero(fits & (scores >= best.floor[anchors][:, None]))
                best.offer(anchors[a], scores[a, r], ids[r])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (best.groups, best.scores, best.ids)], schema=schema)

    return search


def _slots(block: Anchors, positives: pd.DataFrame, windows: Windows, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Upper ends of each anchor's slots, falling, and the least score that any window takes."""
    upper = np.full((len(block.ids), width), _NONE)
    least = np.full(len(block.ids), np.iinfo(np.int64).max)
    low, high = windows.limits(positives["score"].to_numpy(np.int64))
    some = low <= high
    for anchor, rows in pd.DataFrame({"anchor": positives["anchor"].to_numpy()[some], "low": low[some], "high": high[some]}).groupby("anchor"):
        ends = np.unique(rows["high"].to_numpy())[::-1]
        upper[anchor, : len(ends)] = ends
        least[anchor] = rows["low"].min()
    return upper, least


def _top_in_slots(block: Anchors, upper: np.ndarray, least: np.ndarray, k: int):
    width = upper.shape[1]
    ends = np.maximum((upper > _NONE).sum(1) - 1, 0)  # the lowest slot of each anchor
    schema = pa.schema([("anchor", pa.int64()), ("slot", pa.int32()), ("score", pa.int64()), ("id", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(block.ids) * width, k)
        for batch in batches:
            for anchors, ids, labels, scores in block.scores(batch):
                floor = np.maximum(least[anchors], best.floor[anchors * width + ends[anchors]])
                near = (scores <= upper[anchors, 0][:, None]) & (scores >= floor[:, None])
                a, r = np.nonzero(near & (block.labels[anchors][:, None] != labels) & (block.ids[anchors][:, None] != ids))
                found, place = scores[a, r], anchors[a]
                slot = (upper[place] >= found[:, None]).sum(1) - 1
                group = place * width + slot
                good = found >= best.floor[group]
                best.offer(group[good], found[good], ids[r[good]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(best.groups // width), pa.array((best.groups % width).astype(np.int32)), pa.array(best.scores), pa.array(best.ids)],
            schema=schema)

    return search


def _merged(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The best ``k`` of what the tasks kept."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))
    return found.withColumn("place", place).filter(F.col("place") <= k)


def _answers(block: Anchors, positives: pd.DataFrame, upper: np.ndarray, windows: Windows, k: int):
    """Of the lists of an anchor's slots, the first ``k`` of each positive's window."""
    low, high = windows.limits(positives["score"].to_numpy(np.int64))
    by_anchor = {a: rows for a, rows in positives.assign(low=low, high=high).groupby("anchor")}

    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for anchor, rows in frame.groupby("anchor"):
            # From the lowest slot up: each list is put before the ones below it.
            suffix = np.empty((0, 2), np.int64)
            at_or_below = {}
            slots = {s: r for s, r in rows.sort_values("place").groupby("slot")}
            for slot in range(int((upper[anchor] > _NONE).sum()) - 1, -1, -1):
                if slot in slots:
                    suffix = np.concatenate([slots[slot][["score", "id"]].to_numpy(np.int64), suffix])[:k]
                at_or_below[int(upper[anchor, slot])] = suffix
            for p in by_anchor[anchor].itertuples():
                window = at_or_below.get(p.high, suffix[:0])
                window = window[window[:, 0] >= p.low]
                out += [(block.ids[anchor], p.id, n, i, p.score, s) for n, (s, i) in enumerate(window, 1)]
        return pd.DataFrame(out, columns=[x.split(" ")[0] for x in _RESULT.split(", ")])

    return answer


def hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 10,
    windows: Windows = Windows(),
    block: int = BLOCK_ANCHORS,
) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows`` has ``id``, ``label`` (both integer) and ``vector`` (array of long); other columns
    aren't read. A row's score is its inner product with the anchor; ties go to the smaller id. An
    anchor's positives are its best ``positives`` rows of the same label, and for each of them
    the best ``negatives`` rows of another label in its window come out.

    Rows with a null id, label or vector, or with a null component, take no part. Vectors are
    compared with anchors of their own length only. Rows with the anchor's id count as the anchor, so
    they are neither its positives nor its negatives; other rows that repeat an id each count.
    An anchor that is there twice is answered twice. Empty tables give no rows. Components must be so
    small that products stay below 2**53, else the call fails.

    Anchors are a stated query set; blocks of bounded size are sent to all tasks and scored
    against every row where it lies. Only what a task keeps of each slot is shuffled.
    """
    spark = rows.sparkSession
    known = rows.select(F.col("id").cast("long"), F.col("label").cast("long"), F.col("vector").cast("array<long>").alias("vector"))
    known = known.filter("id is not null and label is not null and vector is not null and not exists(vector, x -> x is null)")
    seeds = rows.select(F.col("id").cast("long"), F.col("label").cast("long"), F.col("vector").cast("array<long>").alias("vector"),
                        is_anchor.alias("chosen"))
    seeds = seeds.filter("chosen and id is not null and label is not null and vector is not null and not exists(vector, x -> x is null)")
    seeds = stored(seeds.select("id", "label", "vector", F.monotonically_increasing_id().alias("anchor")), "anchors")
    count, longest = seeds.agg(F.count("*"), F.max(F.size("vector"))).first()
    path = shared_folder(spark, "negatives")
    spark.createDataFrame([], _RESULT).write.mode("append").parquet(path)
    if count:
        block = max(1, min(block, BLOCK_BYTES // (8 * max(longest, 1))))
        blocks = -(-count // block)
        for b in range(blocks):
            # By hash, so that blocks are about equal; a block is bounded and goes through the driver.
            these = seeds.filter(F.pmod(F.xxhash64("anchor"), F.lit(blocks)) == b).orderBy("id", "anchor")
            _one_block(known, these, positives, negatives, windows).write.mode("append").parquet(path)
    return spark.read.schema(_RESULT).parquet(path)


def _one_block(known: DataFrame, seeds: DataFrame, positives: int, negatives: int, windows: Windows) -> DataFrame:
    spark = known.sparkSession
    found = seeds.select("id", "label", "vector").toArrow()
    block = Anchors(found.column(0).to_numpy().astype(np.int64), found.column(1).to_numpy().astype(np.int64),
                    {m.shape[1]: (r, m) for r, m in matrices(found.column(2))})
    rows = known.select("id", "label", "vector")
    top = rows.mapInArrow(_top_positives(block, positives), "anchor long, score long, id long")
    # At most so many rows as the block has positives.
    best = _merged(top, ["anchor"], positives).select("anchor", "score", "id").toPandas()
    best = best.sort_values(["anchor", "score", "id"], ascending=[True, False, True])
    upper, least = _slots(block, best, windows, positives)
    slots = rows.mapInArrow(_top_in_slots(block, upper, least, negatives), "anchor long, slot int, score long, id long")
    kept = _merged(slots, ["anchor", "slot"], negatives).withColumn("part", F.floor(F.col("anchor") / 64))
    answers = _answers(block, best, upper, windows, negatives)
    return kept.groupBy("part").applyInPandas(answers, _RESULT)
