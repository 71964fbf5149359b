"""Repeated byte strings across documents, by backward extension on a Burrows-Wheeler transform."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.bytewise import _BYTE, _powers_to, in_blocks, text_bytes
from fieldloom.llm.common import bit_table, bitmap, in_bitmap, mixed, partitions, spans, with_hit
from fieldloom.session import stored

#: Bytes of the pieces whose least hash stands for a string.
PIECE = 24
_BLOCK, _FLUSH, _FLUSH_BYTES = 1 << 18, 500_000, 8 << 20
#: Bytes of runs, or of texts whose keys are counted, for each group of keys.
_GROUP_BYTES = 16 << 20


def _piece(length: int) -> int:
    return min(PIECE, max(1, length // 2))


class Runs:
    """Runs of neighbouring strings of ``length`` bytes that have the same least piece.

    Every such string inside one text lies in exactly one run, and equal strings have equal least
    pieces, so strings need only be compared among runs of the same ``key``.
    """

    def __init__(self, data: np.ndarray, ends: np.ndarray, length: int) -> None:
        n, empty = len(data), np.zeros(0, np.int64)
        self.first = self.last = self.text = empty
        self.key = empty.view(np.uint64)
        self.total = np.zeros(1, np.uint64)
        self.inverse = self.total
        if n < length:
            return
        power, inverse = _powers_to(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * power[:n], out=total[1:])
        piece = _piece(length)
        least = mixed((total[piece:] - total[:-piece]) * inverse[: n - piece + 1])
        reach, width = 1, length - piece + 1
        while reach < width:
            step = min(reach, width - reach)
            least = np.minimum(least[:-step], least[step:])
            reach += step
        # ``least[i]`` is now for the string that begins at byte i.
        starts = np.concatenate([[0], ends[:-1]])
        valid = np.zeros(len(least) + 1, np.int32)
        fits = ends - starts >= length
        np.add.at(valid, starts[fits], 1)
        np.add.at(valid, ends[fits] - length + 1, -1)
        valid = np.cumsum(valid)[:-1] > 0
        begin = valid.copy()
        begin[1:] &= (least[1:] != least[:-1]) | ~valid[:-1]
        # A text may end where the next begins with the same piece.
        at = starts[fits]
        begin[at] = True
        self.first = np.flatnonzero(begin)
        stop = np.zeros(len(valid), bool)
        stop[:-1] = valid[:-1] & (begin[1:] | ~valid[1:])
        stop[-1] = valid[-1]
        self.last = np.flatnonzero(stop)
        self.key = least[self.first]
        self.text = np.searchsorted(ends, self.first, side="right")
        self.total, self.inverse = total, inverse


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("_text"))


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of batches in blocks. A batch is let go of before the next one is read."""
    for batch in batches:
        yield from in_blocks(batch, "_text", _BLOCK)
        del batch


def _shared_keys(docs: DataFrame, length: int, bins: int) -> DataFrame:
    """Keys that occur in two documents, as rows (id long)."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        several: list[np.ndarray] = []

        def flush() -> pd.DataFrame:
            # A key of several texts of this task is sent twice, which says as much.
            keys = np.concatenate([np.unique(np.concatenate(held)), *map(np.unique, several)])
            held.clear(), several.clear()
            at = ((keys >> np.uint64(5)) % np.uint64(bins)).astype(np.int64)
            order = np.argsort(at, kind="stable")
            keys, at = keys[order], at[order]
            cuts = np.flatnonzero(np.diff(at, prepend=-1))
            return pd.DataFrame({"bin": at[cuts], "keys": [keys[a:b].tobytes() for a, b in zip(cuts, np.append(cuts[1:], len(at)), strict=True)]})

        count = 0
        for rows in _blocks(batches):
            runs = Runs(*text_bytes(rows["_text"]), length)
            if not len(runs.key):
                continue
            order = np.lexsort((runs.text, runs.key))
            key, text = runs.key[order], runs.text[order]
            twice = (key[1:] == key[:-1]) & (text[1:] != text[:-1])
            held.append(np.unique(key))
            several.append(key[1:][twice])
            count += len(held[-1])
            if count >= _FLUSH:
                # Of two blocks, one key each: two texts have it.
                keys, times = np.unique(np.concatenate(held), return_counts=True)
                several.append(keys[times > 1])
                yield flush()
                count = 0
        if held:
            keys, times = np.unique(np.concatenate(held), return_counts=True)
            several.append(keys[times > 1])
            yield flush()

    def twice(rows: pd.DataFrame) -> pd.DataFrame:
        keys, times = np.unique(np.concatenate([np.frombuffer(k, np.uint64) for k in rows["keys"]]), return_counts=True)
        return pd.DataFrame({"id": keys[times > 1].view(np.int64)})

    packed = docs.select("_text").mapInPandas(work, "bin long, keys binary")
    return packed.groupBy("bin").applyInPandas(twice, "id long")


def _chosen(rows: pd.DataFrame, keys: np.ndarray, length: int) -> tuple | None:
    """Of a block of rows (id, row, _text), the runs whose key may be among ``keys``: text, first byte
    in the block and in the text, size, key, name; and the bytes of the block."""
    data, ends = text_bytes(rows["_text"])
    runs = Runs(data, ends, length)
    take = in_bitmap(runs.key.view(np.int64), keys) if len(runs.key) else np.zeros(0, bool)
    if not take.any():
        return None
    first, stop, text = runs.first[take], runs.last[take] + length, runs.text[take]
    sizes = stop - first
    name = mixed((runs.total[stop] - runs.total[first]) * runs.inverse[first] + sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return text, first, first - np.concatenate([[0], ends[:-1]])[text], sizes, runs.key[take], name, data


def _places(docs: DataFrame, shared: np.ndarray, length: int) -> DataFrame:
    """Where runs with a shared key are: rows (id, row, at, size, key, name)."""
    keys_of = docs.sparkSession.sparkContext.broadcast(shared)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _blocks(batches):
            found = _chosen(rows, keys_of.value, length)
            if found is not None:
                text, _, at, sizes, key, name, _ = found
                yield pd.DataFrame({
                    "id": rows["id"].to_numpy(np.int64)[text], "row": rows["row"].to_numpy(np.int64)[text], "at": at,
                    "size": sizes, "key": key.view(np.int64), "name": name.view(np.int64)})

    return docs.mapInPandas(work, "id long, row long, at long, size long, key long, name long")


def _packs(docs: DataFrame, several: np.ndarray, length: int, bins: int) -> DataFrame:
    """In packs by bin of keys, the bytes of each task's different runs with the smallest id that has them."""
    keys_of = docs.sparkSession.sparkContext.broadcast(several)

    def packed(held: list[tuple]) -> pd.DataFrame:
        key, name, ids, sizes, data = (np.concatenate([h[k] for h in held]) for k in range(5))
        offset = np.cumsum(sizes) - sizes
        order = np.lexsort((ids, name, key))
        k, m = key[order], name[order]
        chosen = order[np.append(True, (k[1:] != k[:-1]) | (m[1:] != m[:-1]))]
        at = ((key[chosen] >> np.uint64(5)) % np.uint64(bins)).astype(np.int64)
        chosen, at = chosen[np.argsort(at, kind="stable")], np.sort(at)
        cuts = np.flatnonzero(np.diff(at, prepend=-1))
        out = []
        for a, b in zip(cuts, np.append(cuts[1:], len(at)), strict=True):
            c = chosen[a:b]
            run, inner = spans(sizes[c])
            out.append((int(at[a]), key[c].tobytes(), name[c].tobytes(), ids[c].tobytes(), sizes[c].astype(np.int32).tobytes(),
                        data[offset[c][run] + inner].tobytes()))
        return pd.DataFrame(out, columns=["bin", "keys", "names", "ids", "sizes", "bytes"])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        size = 0
        for rows in _blocks(batches):
            found = _chosen(rows, keys_of.value, length)
            if found is None:
                continue
            text, first, _, sizes, key, name, data = found
            run, inner = spans(sizes)
            held.append((key, name, rows["id"].to_numpy(np.int64)[text], sizes, data[first[run] + inner]))
            size += len(run)
            if size >= _FLUSH_BYTES:
                yield packed(held)
                held, size = [], 0
        if held:
            yield packed(held)

    return docs.mapInPandas(work, "bin long, keys binary, names binary, ids binary, sizes binary, bytes binary")


def least_owner(data: np.ndarray, offset: np.ndarray, sizes: np.ndarray, owner: np.ndarray, length: int) -> np.ndarray:
    """For every string of ``length`` bytes inside the pieces: the least owner among equal ones.

    Breadth-first backward extension. The positions behind the strings are, at first, one interval:
    that of the empty string. A step takes the byte before each position and sorts stably by it,
    which is the mapping from the last to the first column of the transform: positions then lie in
    the order of the one byte longer strings that begin there, and an interval is what has the same
    byte and came from the same interval. Where two neighbours part, their common prefix is as long
    as the level, so common prefixes come out by increasing value. An interval of one position can
    never grow again and is left out; the steps stop at ``length``.
    """
    strings = sizes - length + 1
    # Places in half the memory where they fit.
    number = np.int32 if len(data) + length < 1 << 31 else np.int64
    piece = np.repeat(np.arange(len(sizes), dtype=number), strings)
    result = owner[piece]
    at = (offset - (np.cumsum(strings) - strings) + length).astype(number)[piece]
    index = np.arange(len(piece), dtype=number)
    at += index
    interval = np.zeros(len(piece), np.int32)
    del piece
    for _ in range(length):
        at = at - number(1)
        byte = data[at]
        order = np.argsort(byte, kind="stable")
        at, index, byte, interval = at[order], index[order], byte[order], interval[order]
        del order
        new = np.empty(len(at), bool)
        new[:1] = True
        new[1:] = (byte[1:] != byte[:-1]) | (interval[1:] != interval[:-1])
        alone = new.copy()
        alone[:-1] &= new[1:]
        interval = np.cumsum(new, dtype=np.int32)
        if alone.any():
            keep = ~alone
            at, index, interval = at[keep], index[keep], interval[keep]
        if not len(at):
            return result
    cuts = np.flatnonzero(np.diff(interval, prepend=-1))
    least = np.minimum.reduceat(result[index], cuts)
    result[index] = np.repeat(least, np.diff(np.append(cuts, len(index))))
    return result


def _expanded(rows: pd.DataFrame, length: int) -> pd.DataFrame:
    """Of one bin: for each different piece, runs of strings (lo to hi) with their least owner."""
    key, name, ids = (np.concatenate([np.frombuffer(x, t) for x in rows[c]]) for c, t in (("keys", np.int64), ("names", np.int64), ("ids", np.int64)))
    sizes = np.concatenate([np.frombuffer(x, np.int32) for x in rows["sizes"]]).astype(np.int64)
    data = np.concatenate([np.frombuffer(x, np.uint8) for x in rows["bytes"]])
    offset = np.cumsum(sizes) - sizes
    order = np.lexsort((ids, name, key))
    k, m = key[order], name[order]
    chosen = order[np.append(True, (k[1:] != k[:-1]) | (m[1:] != m[:-1]))]
    key, name, ids, sizes, offset = key[chosen], name[chosen], ids[chosen], sizes[chosen], offset[chosen]
    least = least_owner(data, offset, sizes, ids, length)
    strings = sizes - length + 1
    piece = np.repeat(np.arange(len(sizes)), strings)
    begin = np.cumsum(strings) - strings
    cuts = np.flatnonzero(np.append(True, (piece[1:] != piece[:-1]) | (least[1:] != least[:-1])))
    ends = np.append(cuts[1:], len(piece)) - 1
    p = piece[cuts]
    return pd.DataFrame({"key": key[p], "name": name[p], "lo": cuts - begin[p], "hi": ends - begin[p], "owner": least[cuts]})


def _merged(spans, size: int, copy: bool, length: int) -> list[tuple[int, int]]:
    if copy:
        return [(0, size)] if size >= length else []
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def repeated_spans(
    docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row for each row of ``docs``: ``id, n_bytes, n_removed, spans, kept`` (binary).

    A byte goes when a string of ``length`` bytes covers it that also begins in a document with a
    smaller id; overlaps count, and strings are judged on the input. Strings never cross documents.
    ``spans`` are the maximal removed runs (lo, hi) in bytes, ``kept`` the remaining bytes. Null
    texts are empty. Ids are integers; rows with the same id never judge each other, and a row
    without id loses nothing and judges nothing. An empty table gives no rows; other columns are
    not read.

    1. Copies of whole texts lose everything (from ``length`` bytes on) and are left aside.
    2. Strings are told apart by the least hash among their pieces. Keys that two documents share
       become a bitmap of fixed size; a key that passes it unshared costs work only.
    3. Where runs of strings with such a key are is written once, without bytes. A key whose runs all
       have one name (a hash of the whole run) belongs to the smallest id; most runs of near copies
       and of repeated passages are of this kind.
    4. Bytes are sent only of runs whose key has several names, by key. A task sends equal runs once,
       with the smallest id, so a passage of a third of all documents stays small. Each group of keys
       (their number grows with the bytes) is indexed and expanded (:func:`least_owner`).
    5. The least owners are joined to where the runs occur, and what is owned by a smaller id is
       merged to spans. Only texts that lose something are shuffled.
    """
    spark = docs.sparkSession
    bins = partitions(spark)
    numbered = _numbered(docs, id_col, text_col)
    digest = F.sha2(F.encode(F.coalesce(F.col("_text"), F.lit("")), "UTF-8"), 256)
    # Copies and spans belong to texts, not to ids: texts of a repeated id are told apart by a hash.
    ids = stored(numbered.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id"), "ids")
    often = bit_table(ids.select(F.xxhash64("id").alias("id")))

    def with_row(frame: DataFrame, id_: Column) -> DataFrame:
        columns = frame.columns
        row = F.when(F.col("_hit"), F.xxhash64(F.coalesce(F.col("_text"), F.lit("")))).otherwise(F.lit(0).cast("long"))
        return with_hit(frame, often, F.xxhash64(id_)).select(*columns, row.alias("row"))

    numbered = with_row(numbered, F.col("id"))
    named = numbered.select("id", "row", digest.alias("digest"))
    first = named.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    copies = stored(named.join(first, "digest").filter("id > first").select("id", "row").distinct(), "copies")
    marked = with_hit(numbered, bit_table(copies.select(F.xxhash64("id", "row").alias("id"))), F.xxhash64("id", "row"))
    singles = marked.filter("not _hit").drop("_hit").union(
        marked.filter("_hit").join(copies, ["id", "row"], "left_anti").select("id", "_text", "row"))
    bytes_in = singles.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    shared = bitmap(_shared_keys(singles, length, max(bins, bytes_in // _GROUP_BYTES)))
    places = stored(_places(singles, shared, length), "places")
    by_key = stored(
        places.groupBy("key").agg(
            F.min("name").alias("name"), (F.min("name") != F.max("name")).alias("several"), F.min("id").alias("owner"),
            F.max("id").alias("last"), F.max("size").alias("size"), F.sum("size").alias("bytes"))
        .filter("several or owner < last"), "keys")
    several = by_key.filter("several")
    bytes_in = several.agg(F.sum("bytes")).first()[0] or 0
    compared = _packs(singles, bitmap(several.select(F.col("key").alias("id"))), length, max(bins, bytes_in // _GROUP_BYTES))
    compared = compared.groupBy("bin").applyInPandas(
        lambda rows: _expanded(rows, length), "key long, name long, lo long, hi long, owner long")
    alike = by_key.filter("not several").select(
        "key", "name", F.lit(0).cast("long").alias("lo"), (F.col("size") - length).alias("hi"), "owner")
    owners = compared.union(alike)
    lost = stored(
        places.join(owners, ["key", "name"]).filter("owner < id")
        .select("id", "row", (F.col("at") + F.col("lo")).alias("lo"), (F.col("at") + F.col("hi") + length).alias("hi")), "spans")
    touched = bit_table(lost.select("id", "row").union(copies).select(F.xxhash64("id", "row").alias("id")))
    every = with_row(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text")), F.col("id").cast("long"))
    every = with_hit(every, touched, F.xxhash64(F.col("id").cast("long"), "row"))
    info = lost.groupBy("id", "row").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")).join(
        copies.withColumn("copy", F.lit(True)), ["id", "row"], "full").withColumnsRenamed({"id": "_id", "row": "_row"})
    losing = every.filter("_hit")
    losing = losing.join(info, (F.col("id").cast("long") == F.col("_id")) & (F.col("row") == F.col("_row")), "left").select("id", "_text", "spans", "copy")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, text, found, copy in batch.itertuples(index=False):
                raw = (text or "").encode()
                gone = _merged(found if found is not None else [], len(raw), copy is True, length)
                edges = [0, *(x for s in gone for x in s), len(raw)]
                kept = b"".join(raw[edges[j] : edges[j + 1]] for j in range(0, len(edges), 2))
                out.append((i, len(raw), len(raw) - len(kept), [{"lo": a, "hi": b} for a, b in gone], kept))
            yield pd.DataFrame(out, columns=["id", "n_bytes", "n_removed", "spans", "kept"])

    schema = f"id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_removed long, spans array<struct<lo:long,hi:long>>, kept binary"
    raw: Column = F.coalesce(F.encode(F.col("_text"), "UTF-8"), F.lit(b""))
    whole = every.filter("not _hit").select(
        "id", F.octet_length(raw).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        F.array().cast("array<struct<lo:bigint,hi:bigint>>").alias("spans"), raw.alias("kept"))
    return losing.mapInPandas(cut, schema).union(whole)
