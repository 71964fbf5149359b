"""Vector codes: product quantisation with memoised grid cells, in whole numbers.

Vectors are cut into parts, and each part is replaced by the index of the nearest entry of the
part's codebook. To find it, the coarse grid cell of the part is hashed: for each cell that has
been met, a task remembers which entries can be nearest to some point of it. Entries whose least
distance to the cell's box is above another entry's largest distance are dominated and left out, so
only the others are evaluated exactly. Nothing of the result depends on the grid or the memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.llm.common import mixed
from fieldloom.llm.vectors import largest, matrices

#: Cells that a task remembers for one part. Beyond them it starts anew.
MOST_CELLS = 1 << 16


class CellMemory:
    """For the cells of one part: which entries of its codebook can be nearest."""

    def __init__(self, book: np.ndarray, width: int, most: int = MOST_CELLS) -> None:
        self.book, self.width, self.most = book, width, most
        self.hits = self.misses = self.evaluated = 0
        self._forget()

    def _forget(self) -> None:
        self.hashes = np.empty(0, np.uint64)
        self.cells = np.empty((0, self.book.shape[1]), np.int64)
        self.masks = np.empty((0, len(self.book)), bool)

    def _undominated(self, cells: np.ndarray) -> np.ndarray:
        low = (cells * self.width)[:, None, :]
        high = low + self.width - 1
        nearest = (np.maximum(np.maximum(low - self.book, self.book - high), 0) ** 2).sum(2)
        farthest = (np.maximum(np.abs(self.book - low), np.abs(high - self.book)) ** 2).sum(2)
        return nearest <= farthest.min(1, keepdims=True)

    def candidates(self, points: np.ndarray) -> np.ndarray:
        """For each point the entries that may be nearest to it."""
        cells = points // self.width
        hashes = np.zeros(len(cells), np.uint64)
        for column in cells.T:
            hashes = mixed(hashes * np.uint64(31) + column.astype(np.uint64))
        distinct, one, owner = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == distinct[inside]
        self.hits += int(known.sum())
        self.misses += int((~known).sum())
        if not known.all():
            if len(self.hashes) + int((~known).sum()) > self.most:
                self._forget()
                known[:] = False
            cells_new = cells[one[~known]]
            hashes_all = np.concatenate([self.hashes, distinct[~known]])
            order = np.argsort(hashes_all)
            self.hashes = hashes_all[order]
            self.cells = np.concatenate([self.cells, cells_new])[order]
            self.masks = np.concatenate([self.masks, self._undominated(cells_new)])[order]
        at = np.searchsorted(self.hashes, distinct)[owner]
        masks = self.masks[at]
        # Cells that only share a hash: all entries.
        masks[(self.cells[at] != cells).any(1)] = True
        return masks

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each point, the lowest of equals, and its distance."""
        masks = self.candidates(points)
        self.evaluated += int(masks.sum())
        index = np.zeros(len(points), np.int64)
        least = np.full(len(points), np.iinfo(np.int64).max)
        for entry, vector in enumerate(self.book):
            rows = np.flatnonzero(masks[:, entry])
            distance = ((points[rows] - vector) ** 2).sum(1)
            better = distance < least[rows]
            index[rows[better]], least[rows[better]] = entry, distance[better]
        return index, least


def cell_width(book: np.ndarray) -> int:
    """Sides of the grid cells: the diagonal is about a quarter of the usual gap between entries."""
    if not book.size:
        return 1
    gaps = np.sqrt(((book[:, None, :] - book[None, :, :]).astype(float) ** 2).sum(2))
    gaps = gaps[gaps > 0]
    return max(1, int(np.median(gaps) / (4 * np.sqrt(book.shape[1])))) if len(gaps) else 1


def memories(books: np.ndarray) -> list[CellMemory]:
    return [CellMemory(book, cell_width(book)) for book in books]


def _parts(column: pa.Array, books: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and their parts (row, part, place); vectors shorter than the longest end in zeros."""
    parts, _, width = books.shape
    for rows, matrix in matrices(column):
        if max(largest(matrix), largest(books)) ** 2 * 4 * max(width, 1) >= 1 << 63:
            raise ValueError("squared distances beyond 64 bits: use a smaller scale")
        full = np.zeros((len(rows), parts * width), np.int64)
        full[:, : matrix.shape[1]] = matrix
        yield rows, full.reshape(len(rows), parts, width)


def _assigned_sums(books: np.ndarray):
    parts, entries, width = books.shape
    schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, memory = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64), memories(books)
        for batch in batches:
            for _, cut in _parts(batch.column(0), books):
                for p in range(parts):
                    index, _ = memory[p].nearest(cut[:, p])
                    counts[p] += np.bincount(index, minlength=entries)
                    np.add.at(sums[p], index, cut[:, p])
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(counts[p, e]),
             pa.array(list(sums[p, e]), pa.list_(pa.int64()))], schema=schema)

    return work


def _coded(books: np.ndarray):
    parts = len(books)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = memories(books)
        for batch in batches:
            codes = np.zeros((batch.num_rows, parts), np.uint8)
            errors = np.zeros(batch.num_rows, np.int64)
            for rows, cut in _parts(batch.column("vector"), books):
                for p in range(parts):
                    codes[rows, p], least = memory[p].nearest(cut[:, p])
                    errors[rows] += least
            text = pa.array([c.tobytes().hex() for c in codes], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), text, pa.array(errors)], names=["id", "label", "code", "error"])

    return work


def first_codebooks(rows: DataFrame, parts: int = 8, entries: int = 16) -> np.ndarray:
    """Codebooks (part, entry, place): the parts of the ``entries`` rows of the smallest ids.
    Rows without an id come last; of rows that share one, smaller vectors come first."""
    longest = rows.agg(F.max(F.size("vector"))).first()[0]
    if longest is None:
        return np.zeros((parts, 0, 0), np.int64)
    width = -(-longest // parts)
    first = rows.orderBy(F.asc_nulls_last("id"), "vector").limit(entries).select("vector").collect()  # `entries` rows
    full = np.zeros((len(first), parts * width), np.int64)
    for k, row in enumerate(first):
        full[k, : len(row["vector"])] = row["vector"]
    return np.ascontiguousarray(full.reshape(len(first), parts, width).transpose(1, 0, 2))


def train_codebooks(rows: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> np.ndarray:
    """Codebooks after ``rounds`` rounds over all rows: assign every part to its nearest entry (ties
    to the lower index), replace each entry by the floor of the mean of its parts; unused
    entries stay. ``rows`` has ``id`` and ``vector`` (array of long, neither null nor with nulls).

    A task returns one sum per part and entry, so each round shuffles some rows of the size
    of the codebooks for each task, and the driver gets one row per part and entry.
    """
    books = first_codebooks(rows, parts, entries)
    if not books.shape[1]:
        return books
    if books.shape[1] > 256:
        raise ValueError("a code has two hexadecimal digits: at most 256 entries")
    for _ in range(rounds):
        sums = rows.select("vector").mapInArrow(_assigned_sums(books), "part int, entry int, n long, sums array<long>")
        # Sums of a place each, so that a part of the sum can be taken in every task of the shuffle.
        flat = sums.select("part", "entry", "n", F.posexplode_outer("sums").alias("place", "x"))
        total = flat.groupBy("part", "entry", "place").agg(
            F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
        books = books.copy()
        for row in total.filter("place is not null").collect():
            books[row["part"], row["entry"], row["place"]] = int(row["x"]) // int(row["n"])
    return books


def encode(rows: DataFrame, books: np.ndarray, label_col: str = "label") -> DataFrame:
    """Rows (id, label, code, error): two hexadecimal digits for each part, and the squared distance
    summed over the parts."""
    rows = rows.select("id", F.col(label_col).alias("label"), "vector")
    kinds = [*rows.schema.fields[:2], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]
    return rows.mapInArrow(_coded(books), T.StructType(kinds))


def codebook_digest(books: np.ndarray) -> str:
    """SHA-256 of all components as decimal numbers, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(x) for x in books.reshape(-1).tolist()).encode()).hexdigest()
