"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.llm.bytewise import Words, in_blocks, text_bytes
from fieldloom.session import stored

#: Statistics of a text, all over its whole bytes and words.
STATISTICS = [
    "log_bytes", "log_words", "word_length", "word_length_spread", "upper", "digit", "space", "newline", "other_byte",
    "full_stop", "comma", "bang", "percent", "hash", "star", "dollar", "ampersand", "pipe", "bracket", "rare_sign",
    "distinct_words", "distinct_pairs", "doubled_words", "doubled_signs", "long_words",
    "one_letter",
]
_SIGNS = ["!?", "%", "#", "*", "$", "&", "|", "{}[]<>", "@^~`_=+\\/"]

#: Scores of cells of the calibration, and groups in which partial sums are added up.
BINS, GROUPS = 2000, 64


def statistics(texts: pd.Series) -> np.ndarray:
    """One row of :data:`STATISTICS` for each text; zeros for an empty text."""
    data, ends = text_bytes(texts)
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    sizes = np.maximum(ends - starts, 1).astype(float)

    def share(table: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])
        return (total[ends] - total[starts]) / sizes

    def of(chars: str | list[int]) -> np.ndarray:
        table = np.zeros(256, np.uint8)
        table[[ord(c) for c in chars] if isinstance(chars, str) else chars] = 1
        return table

    words = Words(data, ends)
    n_words = np.maximum(words.counts, 1).astype(float)
    lengths = (words.stops - words.starts).astype(float)
    by_text = lambda weights: np.bincount(words.text, weights=weights, minlength=len(ends))
    mean = by_text(lengths) / n_words
    spread = np.sqrt(np.maximum(by_text(lengths**2) / n_words - mean**2, 0))

    def distinct(h: np.ndarray, owner: np.ndarray) -> np.ndarray:
        order = np.lexsort((h, owner))
        h, owner = h[order], owner[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        return np.bincount(owner[fresh], minlength=len(ends))

    pairs = words.hashes[:-1] * np.uint64(3) + words.hashes[1:] if len(words.hashes) else words.hashes
    same = words.text[:-1] == words.text[1:]
    twice = words.hashes[:-1] == words.hashes[1:]
    doubled = np.zeros(len(data) + 1, np.int64)
    if len(data) > 1:
        doubled[2:] = np.cumsum((data[1:] == data[:-1]) & (of("".join(_SIGNS))[data[1:]] == 1))
    columns = [
        np.log1p(ends - starts), np.log1p(words.counts), mean, spread,
        share(of([*range(65, 91)])), share(of([*range(48, 58)])), share(of(" \t")), share(of("\n\r")), share(of([*range(128, 256)])),
        share(of(".")), share(of(",")), *(share(of(s)) for s in _SIGNS),
        distinct(words.hashes, words.text) / n_words,
        distinct(pairs[same], words.text[1:][same]) / n_words if len(same) else np.zeros(len(ends)),
        np.bincount(words.text[1:][same & twice], minlength=len(ends)) / n_words if len(same) else np.zeros(len(ends)),
        (doubled[ends] - doubled[starts]) / sizes, by_text(lengths > 15) / n_words, by_text(lengths == 1) / n_words,
    ]
    out = np.stack(columns, axis=1) if len(ends) else np.zeros((0, len(columns)))
    return np.where((ends > starts)[:, None], out, 0.0)


def with_statistics(docs: DataFrame, keep: list[Column], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` and the statistics as an array."""
    kept = docs.select(*keep)
    names = kept.columns
    schema = T.StructType([*kept.schema, T.StructField("stats", T.ArrayType(T.FloatType()))])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rows in in_blocks(batch, "_text"):
                yield rows[names].assign(stats=list(statistics(rows["_text"]).astype(np.float32)))

    return docs.select(*keep, F.col(text_col).alias("_text")).mapInPandas(work, schema)


def fourier(stats: np.ndarray, mean: np.ndarray, scale: np.ndarray, dims: int, width: float, seed: int) -> np.ndarray:
    """Random Fourier features of a Gaussian kernel of this width, the plain statistics and a one."""
    draw = np.random.default_rng(seed)
    z = np.clip((stats - mean) / scale, -8, 8)
    omega = draw.normal(0, 1 / width, (z.shape[1], dims))
    phase = draw.uniform(0, 2 * np.pi, dims)
    return np.hstack([np.sqrt(2 / dims) * np.cos(z @ omega + phase), z, np.ones((len(z), 1))])


def _added_up(partials: DataFrame) -> np.ndarray:
    """The sum of binary arrays of doubles of one length: first in groups, then of the groups."""

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.float64) for x in rows["sums"])
        return pd.DataFrame({"grp": rows["grp"].iloc[:1], "sums": [np.asarray(total).tobytes()]})

    total = None
    for row in partials.groupBy("grp").applyInPandas(add, "grp int, sums binary").toLocalIterator():
        x = np.frombuffer(row["sums"], np.float64)
        total = x if total is None else total + x
    return np.zeros(0) if total is None else total


def _summed(frame: DataFrame, sums_of) -> np.ndarray:
    """Partition-wise sums of ``sums_of(batch)`` (an array of doubles), added up."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            if len(batch):
                x = sums_of(batch)
                total = x if total is None else total + x
        if total is not None:
            grp = zlib.crc32(total.tobytes()) % GROUPS
            yield pd.DataFrame({"grp": [grp], "sums": [total.tobytes()]})

    return _added_up(frame.mapInPandas(work, "grp int, sums binary"))


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The closest non-decreasing sequence (pool adjacent violators)."""
    level, weight, length = [], [], []
    for v, w in zip(values, weights, strict=True):
        level.append(v)
        weight.append(w)
        length.append(1)
        while len(level) > 1 and level[-2] >= level[-1]:
            w2 = weight[-2] + weight[-1]
            level[-2] = (level[-2] * weight[-2] + level[-1] * weight[-1]) / w2
            weight[-2] = w2
            length[-2] += length[-1]
            level.pop(), weight.pop(), length.pop()
    return np.repeat(level, length)


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    dims: int = 256,
    width: float = 5.0,
    ridge: float = 1e-3,
    threshold: float = 0.3,
    folds: int = 5,
    seed: int = 7,
    keep: Sequence[Column] = (),
) -> DataFrame:
    """Rows ``id, held_out, score, predicted`` for every row of ``docs``, with the columns ``keep``.

    Scores estimate the chance of label 1 and lie in 0 to 1; ``predicted`` is 1 from ``threshold``
    on. Only statistics of the whole text are inputs, never labels, ids or other columns. Labels of
    rows whose ``crc32(id as text) mod folds`` is 0 are held out. Several rows with one id count
    each; null labels don't count. Without a label left, or with one class only, every score is the
    labels' mean (0.5 without any). Null and empty texts have statistics of zeros; null ids are
    scored and never held out.

    Statistics are computed once and written. Random Fourier features of them (a Gaussian kernel of
    ``width`` standard deviations, ``dims`` cosines) enter ridge normal equations, summed up in each
    partition, then in groups, so the driver gets a fixed number of small matrices. Isotonic
    calibration works on counts of labels by ``BINS`` cells of the raw score, computed the same way
    from models fitted without the rows they score: the sums are kept for two halves.
    """
    stats = stored(with_statistics(docs, [F.col(id_col), *keep], text_col), "stats")
    names = [c for c in stats.columns if c != "stats"]
    fold = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))
    held = F.coalesce(fold == 0, F.lit(False))
    wanted = labels.select(F.col(id_col), F.col(label_col).cast("double").alias("_y")).dropna()
    train = stored(stats.join(wanted, id_col).filter(~held).select(
        "stats", "_y", F.pmod(F.crc32(F.concat(F.lit("h"), F.col(id_col).cast("string")).cast("binary")), F.lit(2)).cast("int").alias("_half")), "train")

    def array(batch: pd.DataFrame) -> np.ndarray:
        return np.stack(batch["stats"].to_numpy()).astype(float)

    def moments(batch: pd.DataFrame) -> np.ndarray:
        x = array(batch)
        y = batch["_y"].to_numpy()
        return np.concatenate([[len(x), y.sum()], x.sum(0), (x**2).sum(0)])

    total = _summed(train, moments)
    count, ones = (total[0], total[1]) if len(total) else (0, 0)
    if count == 0 or ones in (0, count):
        flat = float(ones / count) if count else 0.5
        return stats.select(*names, held.alias("held_out"), F.lit(flat).alias("score"), F.lit(int(flat >= threshold)).alias("predicted"))
    k = len(STATISTICS)
    mean = total[2 : 2 + k] / count
    scale = np.sqrt(np.maximum(total[2 + k :] / count - mean**2, 1e-12))
    scale[scale < 1e-5] = 1.0
    width_of = dims + k + 1
    features = lambda x: fourier(x, mean, scale, dims, width, seed)
    # Of the rarer label each row counts as much as brings both to the same weight, in the fit only.
    weight = {0.0: count / (2 * (count - ones)), 1.0: count / (2 * ones)}

    def normal(batch: pd.DataFrame) -> np.ndarray:
        out = []
        x, y, half = features(array(batch)), batch["_y"].to_numpy(), batch["_half"].to_numpy()
        w = np.where(y > 0.5, weight[1.0], weight[0.0])
        for h in (0, 1):
            a, b, c = x[half == h], y[half == h], w[half == h]
            out += [(a.T @ (a * c[:, None])).ravel(), a.T @ (b * c)]
        return np.concatenate(out)

    sums = _summed(train, normal)
    step = width_of * width_of + width_of
    gram = [sums[h * step : h * step + width_of**2].reshape(width_of, width_of) for h in (0, 1)]
    right = [sums[h * step + width_of**2 : (h + 1) * step] for h in (0, 1)]
    solve = lambda g, r: np.linalg.solve(g + ridge * count * np.eye(width_of) / width_of, r)
    halves = [solve(gram[1 - h], right[1 - h]) for h in (0, 1)]
    model = solve(gram[0] + gram[1], right[0] + right[1])
    low, high = -0.5, 1.5
    cell = lambda raw: np.clip((raw - low) / (high - low) * BINS, 0, BINS - 1).astype(int)

    def calibration(batch: pd.DataFrame) -> np.ndarray:
        x, y, half = features(array(batch)), batch["_y"].to_numpy(), batch["_half"].to_numpy()
        at = cell(np.where(half == 0, x @ halves[0], x @ halves[1]))
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, weights=y, minlength=BINS)]).astype(float)

    counts = _summed(train, calibration)
    n, y = counts[:BINS], counts[BINS:]
    seen = np.flatnonzero(n)
    level = isotonic(y[seen] / n[seen], n[seen])
    centre = low + (seen + 0.5) / BINS * (high - low)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            raw = features(array(batch)) @ model
            # Calibrated, with a trace of the raw score so that rows of one step keep their order.
            value = 0.999 * np.interp(raw, centre, level) + 0.001 * np.clip((raw - low) / (high - low), 0, 1)
            yield batch[names].assign(score=np.clip(value, 0, 1))

    schema = T.StructType([*(stats.schema[c] for c in names), T.StructField("score", T.DoubleType())])
    return stats.mapInPandas(score, schema).select(
        *names, held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
