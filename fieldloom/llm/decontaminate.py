"""Benchmark passages in documents: latent semantic retrieval, then subsequence and answer checks."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.llm.bytewise import SIGNS, Words, in_blocks, text_bytes
from fieldloom.llm.common import put_back, row_key, set_aside, spans, without
from fieldloom.session import stored

#: Words of a segment; a passage is a run of segments.
SEGMENT = 8
#: Segments of passages, by length of item: an item belongs to the last that it fills.
SCALES = (2, 4, 8)
_SLOTS, _GROUPS, _BLOCK, _CELLS, _AT_ONCE, _RUNS = 20, 32, 1 << 20, 1 << 21, 512, 256
#: Terms up to which a task counts pairs of terms in a table (64 MB); more are projected passage by passage.
_PAIRED = 1 << 12
#: Places of a passage counted into the table at most before it is multiplied out: no cell can overflow.
_MOST_PLACES = (1 << 31) // (4 * SEGMENT) - 1
_AT_A_TIME = _MOST_PLACES // (4 * SEGMENT)


def words_of(texts: pd.Series) -> Words:
    """Words of letters and digits, A-Z lower-cased; other ASCII signs part words."""
    return Words(*text_bytes(texts), SIGNS)


@dataclass
class Vocabulary:
    """The terms of the benchmark, found by a table over 20 bits of their hash, then compared."""

    terms: np.ndarray
    slots: np.ndarray

    @classmethod
    def of(cls, hashes: np.ndarray) -> Vocabulary:
        terms = np.unique(hashes)
        slots = np.full(1 << _SLOTS, len(terms), np.int32)
        at = (terms >> np.uint64(64 - _SLOTS)).astype(np.int64)
        slots[at[::-1]] = np.arange(len(terms) - 1, -1, -1)
        return cls(terms, slots)

    def index(self, hashes: np.ndarray) -> np.ndarray:
        """Term number of each hash; ``len(terms)`` for others. Terms in one slot lie together."""
        n = len(self.terms)
        found = self.slots[(hashes >> np.uint64(64 - _SLOTS)).astype(np.int64)]
        padded = np.append(self.terms, np.uint64(0))
        out = np.full(len(hashes), n, np.int32)
        todo = np.flatnonzero(found < n)
        at = found[todo]
        while len(todo):
            same = padded[at] == hashes[todo]
            out[todo[same]] = at[same]
            on = ~same & (at + 1 < n) & (padded[np.minimum(at + 1, n)] <= hashes[todo])
            todo, at = todo[on], at[on] + 1
        return out


def _passages(words: Words, term: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Known terms with their passage, of four segments laid end to end, and how many there are."""
    inner = np.arange(len(term)) - (np.cumsum(words.counts) - words.counts)[words.text]
    fresh = inner % (4 * SEGMENT) == 0
    known = term < n
    return term[known], (np.cumsum(fresh) - 1)[known], int(fresh.sum())


def _summed(docs: DataFrame, vocabulary: Vocabulary, size: int, sums_of, begin=lambda: None, end=lambda total, state: None) -> np.ndarray:
    """Sums over all documents of what ``sums_of(total, state, term, passage, passages)`` adds for a block: in
    each task, then in groups of tasks, then of the groups. One array reaches the driver. A task's ``state`` is
    what ``begin`` makes; ``end`` adds what is left in it."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, state = np.zeros(size), begin()
        for batch in batches:
            for rows in in_blocks(batch, "_text", _BLOCK):
                words = words_of(rows["_text"])
                if len(words.hashes):
                    sums_of(total, state, *_passages(words, shared.value.index(words.hashes), len(shared.value.terms)))
        end(total, state)
        if total.any():
            yield pd.DataFrame({"grp": [zlib.crc32(total.tobytes()) % _GROUPS], "sums": [total.tobytes()]})

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(size)
        for x in rows["sums"]:
            total += np.frombuffer(x, np.float64)
        return pd.DataFrame({"grp": [0], "sums": [total.tobytes()]})

    schema = "grp int, sums binary"
    grouped = docs.select("_text").mapInPandas(work, schema).groupBy("grp").applyInPandas(add, schema)
    found = grouped.groupBy("grp").applyInPandas(add, schema).first()
    return np.zeros(size) if found is None else np.frombuffer(found["sums"], np.float64)


def _frequencies(docs: DataFrame, vocabulary: Vocabulary) -> tuple[np.ndarray, float]:
    """In how many passages of all documents each term is, and how many passages there are."""
    n = len(vocabulary.terms)

    def count(total: np.ndarray, _, term: np.ndarray, passage: np.ndarray, passages: int) -> None:
        total[n] += passages
        total[:n] += np.bincount(np.unique(passage * n + term) % n, minlength=n)

    total = _summed(docs, vocabulary, n + 1, count)
    return total[:n], float(total[n])


def _gram(product: np.ndarray, test: np.ndarray, term: np.ndarray, passage: np.ndarray, passages: int) -> None:
    """Add ``T' T test`` to ``product``, for the counts ``T`` of terms in these passages."""
    if not len(term):
        return
    sums = np.zeros((passages, test.shape[1]), np.float32)
    _add_runs(sums, test, term, passage)
    order = np.argsort(term, kind="stable")
    _add_runs(product, sums, passage[order], term[order])


def _add_runs(total: np.ndarray, rows: np.ndarray, at: np.ndarray, run: np.ndarray) -> None:
    """Add ``rows[at]`` to ``total[run]``, for equal runs laid end to end; some runs at a time, so that
    the rows taken stay in the processor's cache."""
    cuts = np.flatnonzero(np.diff(run, prepend=-1))
    ends = np.append(cuts[1:], len(run))
    for k in range(0, len(cuts), _RUNS):
        some = cuts[k : k + _RUNS]
        taken = rows[at[some[0] : ends[min(k + _RUNS, len(cuts)) - 1]]]
        total[run[some]] += np.add.reduceat(taken, some - some[0], axis=0)


class Pairs:
    """How often two of ``n`` terms stand in a passage: ``T' T`` for the counts ``T`` of terms in passages.

    A passage of four segments has 496 pairs of places at most, each one step in the table; to project it
    takes 64 rows of the rank's length, several times as long.
    """

    def __init__(self, n: int) -> None:
        self.n, self.places = n, 0
        #: Pairs of an earlier and a later place, and single places.
        self.table = np.zeros(n * n, np.int32)
        self.single = np.zeros(n, np.int64)

    def add(self, term: np.ndarray, passage: np.ndarray) -> None:
        """Add the terms of passages, each of four segments at most, laid end to end."""
        self.places += len(term)
        self.single += np.bincount(term, minlength=self.n)
        row = term.astype(np.int64) * self.n
        for step in range(1, 4 * SEGMENT):
            same = np.flatnonzero(passage[step:] == passage[:-step])
            if not len(same):
                break
            np.add.at(self.table, row[same] + term[same + step], np.int32(1))

    def multiply(self, product: np.ndarray, test: np.ndarray) -> None:
        """Add ``T' T test`` to ``product`` and begin anew."""
        table = self.table.reshape(self.n, self.n)
        for k in range(0, self.n, _AT_ONCE):
            both = table[k : k + _AT_ONCE] + table[:, k : k + _AT_ONCE].T.astype(np.float32)
            product[k : k + _AT_ONCE] += both.astype(np.float32) @ test
        product += self.single[:, None] * test
        self.table[:], self.single[:], self.places = 0, 0, 0


def _sketch(docs: DataFrame, vocabulary: Vocabulary, omega: np.ndarray) -> np.ndarray:
    """``T' T omega`` for the counts ``T`` of terms in all passages of these documents."""
    n, rank = omega.shape
    test = omega.astype(np.float32)

    def project(total: np.ndarray, _, term: np.ndarray, passage: np.ndarray, passages: int) -> None:
        _gram(total.reshape(n, rank), test, term, passage, passages)

    def count(total: np.ndarray, pairs: Pairs, term: np.ndarray, passage: np.ndarray, passages: int) -> None:
        # A long text is a block of its own, so a block may be cut, but not a passage.
        for first in range(0, passages, _AT_A_TIME):
            a, b = np.searchsorted(passage, (first, first + _AT_A_TIME))
            if pairs.places + b - a > _MOST_PLACES:
                multiply(total, pairs)
            pairs.add(term[a:b], passage[a:b])

    def multiply(total: np.ndarray, pairs: Pairs) -> None:
        pairs.multiply(total.reshape(n, rank), test)

    if n > _PAIRED:
        return _summed(docs, vocabulary, n * rank, project).reshape(n, rank)
    return _summed(docs, vocabulary, n * rank, count, lambda: Pairs(n), multiply).reshape(n, rank)


def latent_terms(product: np.ndarray, found: np.ndarray, passages: float, omega: np.ndarray) -> np.ndarray:
    """Latent vectors of the terms, from the sketch of a randomised singular value decomposition.

    With inverse document frequencies ``D``, the TF-IDF matrix is ``A = T D`` and the sketch gives
    ``A'A`` times ``D^-1 omega``. Nystrom's formula turns that into right singular vectors. All
    directions count alike, so a passage that lies in a third of all documents stays near its item.
    """
    idf = np.log((1 + passages) / (1 + found)) + 1
    y = product * idf[:, None]
    test = omega / idf[:, None]
    shift = 1e-6 * np.linalg.norm(y) / max(1, np.sqrt(len(y)))
    core = test.T @ (y + shift * test)
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    keep = values > values.max(initial=0) * 1e-10
    half = vectors[:, keep] / np.sqrt(values[keep])
    u, s, _ = np.linalg.svd(y @ half, full_matrices=False)
    keep = s > s.max(initial=0) * 1e-6
    return u[:, keep] * idf[:, None]


def common_subsequence(item: np.ndarray, text: np.ndarray) -> int:
    """Length of the longest common subsequence (bit-parallel over the item's words)."""
    places: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    row = full
    for w in text.tolist():
        hit = row & places.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(item) - bin(row).count("1")


def holds(item: np.ndarray, text: np.ndarray) -> bool:
    """Whether the item's words occur in the text one after another."""
    if not len(item) or len(item) > len(text):
        return False
    windows = np.lib.stride_tricks.sliding_window_view(text, len(item))
    return bool((windows == item).all(1).any())


def _slot(keys: np.ndarray) -> np.ndarray:
    """Place of each number in a table of ``1 << _SLOTS``."""
    return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _SLOTS)).view(np.int64)


@dataclass
class Items:
    """A block of benchmark items, as the search needs them; sizes grow with their words alone."""

    names: np.ndarray
    texts: list[np.ndarray]
    lengths: np.ndarray
    #: How many of its words (counted as often as it has them) a match has.
    least: np.ndarray
    #: The rarest terms of each item, and how many places of them a match has.
    rare: np.ndarray
    rare_of: np.ndarray
    rare_least: np.ndarray
    #: Every (item, term) as one number, and how often the item has the term.
    keys: np.ndarray
    times: np.ndarray
    #: Where the hash of such a number falls: what falls elsewhere is none of them.
    maybe: np.ndarray
    scale: np.ndarray
    #: Latent vectors of length 1 by piece, and the item's first piece.
    vectors: np.ndarray
    piece: np.ndarray

    @classmethod
    def of(cls, names: np.ndarray, words: Words, vocabulary: Vocabulary, found: np.ndarray, latent: np.ndarray, share: float) -> Items:
        n, lengths = len(found), words.counts
        texts = np.split(words.hashes, np.cumsum(lengths)[:-1])
        term = vocabulary.index(words.hashes).astype(np.int64)
        least = np.where(lengths < 4, lengths, np.ceil(share * lengths - 1e-9)).astype(np.int64)
        # Of any ``least`` words of an item, at least k are among its ``length - least + k`` rarest.
        k = np.maximum(1, least // 3)
        order = np.lexsort((np.append(found, 0)[term], words.text))
        place = np.arange(len(term)) - (np.cumsum(lengths) - lengths)[words.text]
        chosen = order[place < (lengths - least + k)[words.text]]
        every = words.text.astype(np.int64) * (n + 1) + term
        keys, times = np.unique(every[term < n], return_counts=True)
        maybe = np.zeros(1 << _SLOTS, bool)
        maybe[_slot(keys)] = True
        rare = np.unique(every[chosen[term[chosen] < n]])
        # Items much longer than the longest passage are searched by pieces of about its length.
        most = SCALES[-1] * SEGMENT
        cut = [np.array_split(t, 1 if 3 * len(t) <= 5 * most else -(-len(t) // most)) for t in texts]
        # A piece belongs to passages of at most about its own length, at least two segments.
        scale = np.array([max([s for s in SCALES if s * SEGMENT <= 1.2 * len(c[-1])], default=SCALES[0]) for c in cut], np.int64)
        padded = np.vstack([latent, np.zeros((1, latent.shape[1]), latent.dtype)])
        vectors = np.stack([padded[vocabulary.index(t)].sum(0) for c in cut for t in c])
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
        piece = np.cumsum([0, *map(len, cut)])
        return cls(names, texts, lengths, least, rare % (n + 1), rare // (n + 1), k, keys, times, maybe, scale, vectors, piece)


def benchmark_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    rank: int = 192,
    similarity: float = 0.4,
    overlap: float = 0.7,
    with_answer: float = 0.5,
    answer_words: int = 6,
    block_items: int = 4000,
    fit_passages: int | None = None,
    seed: int = 11,
) -> DataFrame:
    """Rows (id, item_id, overlap, answer, similarity, at): documents that hold a benchmark item.

    Every text is cut into overlapping passages in three lengths; items are compared with passages
    of about their own length (long ones by pieces, each match judged by the whole item). Terms are
    the words of the benchmark (no other word brings a passage closer to an item), all that occur,
    weighted by their counts over all documents. A distributed randomised decomposition of the
    TF-IDF matrix gives latent vectors; passages whose cosine with an item reaches ``similarity``
    are the only candidates. A candidate is a match when the longest common subsequence of words is at
    least ``overlap`` of the item, or ``with_answer`` (the lesser share) of it when the item's last
    ``answer_words`` words, its answer, occur there in a row. One row, of the greatest overlap, for
    each row of ``docs`` and item; ``at`` is the first word of the passage. Items of fewer than 4
    words must occur whole.

    Counts, the decomposition and the search cover the items and every document. Only a caller that
    names ``fit_passages`` has the decomposition fitted on about so many passages, of documents chosen
    by a hash (on all, when those have no word of the items). No common subsequence is longer than the count
    of an item's words around a passage, so vectors are computed only where that count, first of the
    item's rarest words, still allows a match: an upper bound, which leaves no match out.

    Items without words, null texts and empty tables match nothing. Repeated rows and items, and
    rows without id, match like others. A long text is a block of its own. The benchmark goes to the
    executors in blocks of ``block_items``, each with a search of its own; what is sent is its words,
    and a matrix of its terms by ``rank``. Nothing else is gathered.
    """
    numbered = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"))
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text).alias("_text"))
    blocks = items.count() // block_items + 1
    schema = T.StructType([
        T.StructField("id", docs.schema[id_col].dataType), T.StructField("item_id", benchmark.schema[item_col].dataType),
        T.StructField("overlap", T.DoubleType()), T.StructField("answer", T.BooleanType()),
        T.StructField("similarity", T.DoubleType()), T.StructField("at", T.LongType())])
    out = None
    for b in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item", "_text"), F.lit(blocks)) == b).toPandas()
        words = words_of(part["_text"])
        if not len(words.hashes):
            continue
        vocabulary = Vocabulary.of(words.hashes)
        found, passages = _frequencies(numbered, vocabulary)
        if not found.any():
            # No document has a word of these items.
            continue
        vocabulary, found = Vocabulary.of(vocabulary.terms[found > 0]), found[found > 0]
        omega = np.random.default_rng(seed).normal(size=(len(found), min(rank, len(found))))
        fitted = numbered if fit_passages is None else _sample(numbered, fit_passages / passages, seed)
        product = _sketch(fitted, vocabulary, omega)
        if not product.any():
            product = _sketch(numbered, vocabulary, omega)
        product = product.copy()
        term = vocabulary.index(words.hashes)
        known = term < len(found)
        _gram(product, omega.astype(np.float32), term[known], words.text[known], len(words.counts))
        latent = latent_terms(product, found, passages, omega).astype(np.float32)
        known_items = Items.of(part["item"].to_numpy(), words, vocabulary, found, latent, min(overlap, with_answer))
        matches = _search(numbered, known_items, vocabulary, latent, similarity, overlap, with_answer, answer_words, schema)
        out = matches if out is None else out.union(matches)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def _sample(docs: DataFrame, share: float, seed: int) -> DataFrame:
    """About this share of the rows, by a hash; as they are few, in few tasks."""
    if share >= 1:
        return docs
    dice = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id", "_text"), 11).cast("double") / float(1 << 53)
    return docs.filter(dice < share).repartition(_GROUPS)


def _search(docs, items, vocabulary, latent, similarity, overlap, with_answer, answer_words, schema) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((items, vocabulary, latent))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items, vocabulary, latent = shared.value
        padded = np.vstack([latent, np.zeros((1, latent.shape[1]), latent.dtype)])
        for batch in batches:
            for rows in in_blocks(batch, "_text", _BLOCK):
                words = words_of(rows["_text"])
                yield matches(rows["id"].to_numpy(), words, vocabulary.index(words.hashes), items, padded)

    def matches(ids, words, term, items, padded) -> pd.DataFrame:
        best: dict[tuple[int, int], tuple] = {}
        begin = np.cumsum(words.counts) - words.counts
        for item, start in possible_passages(words, term, items, len(padded) - 1):
            cosine = _cosines(words, term, items, padded, item, start)
            near = np.flatnonzero(cosine >= similarity)
            for i, p, value in zip(item[near].tolist(), start[near].tolist(), cosine[near].tolist(), strict=True):
                row = int(words.text[p])
                if best.get((row, i), (0,))[0] == 1:
                    continue
                text, first, m = items.texts[i], int(begin[row]), int(items.lengths[i])
                region = words.hashes[max(first, p - m) : min(first + int(words.counts[row]), p + int(items.scale[i]) * SEGMENT + m)]
                if m < 4:
                    answer = whole = holds(text, region)
                    share = float(whole)
                else:
                    share = common_subsequence(text, region) / m
                    answer = share >= with_answer and holds(text[-answer_words:], region)
                    whole = share >= overlap or answer
                if whole and ((row, i) not in best or best[row, i][0] < share):
                    best[row, i] = (share, bool(answer), value, p - first)
        return pd.DataFrame(
            [(ids[r], items.names[i], *v) for (r, i), v in best.items()], columns=["id", "item_id", "overlap", "answer", "similarity", "at"])

    return docs.mapInPandas(work, schema)


def possible_passages(words: Words, term: np.ndarray, items: Items, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (item, place of a passage's first word) for which the words around allow a match.

    Around a passage are as many words on both sides as the item has. A match has ``least`` of the
    item's words there, so ``rare_least`` places of its rarest terms lie in as short a stretch. Only
    stretches that hold them are looked at; then all words of the item are counted. Items are taken
    in groups that fill bounded memory (a single item has at most one place for each word).
    """
    load = np.bincount(items.rare_of, np.bincount(term, minlength=n + 1)[items.rare], len(items.lengths))
    group = (np.cumsum(load) // _CELLS).astype(np.int64)
    for g in np.unique(group[load > 0]):
        mine = group[items.rare_of] == g
        by_term = np.argsort(items.rare[mine], kind="stable")
        of_term = items.rare_of[mine][by_term]
        degree = np.bincount(items.rare[mine], minlength=n + 1)
        offset = np.cumsum(degree) - degree
        at = np.flatnonzero(degree[term])
        run, inner = spans(degree[term[at]])
        at = at[run]
        item = of_term[offset[term[at]] + inner]
        order = np.argsort(item, kind="stable")
        item, at = item[order], at[order]
        end = np.arange(len(at)) + items.rare_least[item] - 1
        inside = end < len(at)
        end = np.minimum(end, len(at) - 1)
        inside &= (item[end] == item) & (words.text[at[end]] == words.text[at])
        inside &= at[end] - at < (items.scale * SEGMENT + 2 * items.lengths)[item]
        hit = np.flatnonzero(inside)
        if len(hit):
            pairs = _passages_around(words, items, item[hit], at[hit], at[end[hit]])
            enough = [_enough(words, term, items, *(x[k : k + (1 << 16)] for x in pairs), n) for k in range(0, len(pairs[0]), 1 << 16)]
            keep = np.concatenate(enough) if enough else np.zeros(0, bool)
            if keep.any():
                yield pairs[0][keep], pairs[1][keep]


def _passages_around(words: Words, items: Items, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Passages of these items that have the words from ``low`` to ``high`` around them, each once.
    Half of a passage overlaps with the next."""
    text = words.text[low]
    begin = (np.cumsum(words.counts) - words.counts)[text]
    low, high, size = low - begin, high - begin, items.lengths[item]
    step = np.maximum(SEGMENT, items.scale[item] * SEGMENT // 2)
    first = -(-np.maximum(0, high - items.scale[item] * SEGMENT - size + 1) // step)
    last = np.minimum(low + size, words.counts[text] - 1) // step
    run, inner = spans(np.maximum(0, last - first + 1))
    start = begin[run] + (first[run] + inner) * step[run]
    total = max(1, len(words.hashes))
    found = np.unique(item[run] * total + start)
    return found // total, found % total


def _around(words: Words, start: np.ndarray, before: np.ndarray, behind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words from ``start - before`` to ``start + behind`` inside the text, end to end,
    and which of the passages each belongs to."""
    begin = (np.cumsum(words.counts) - words.counts)[words.text[start]]
    low = np.maximum(begin, start - before)
    run, inner = spans(np.minimum(begin + words.counts[words.text[start]], start + behind) - low)
    return low[run] + inner, run


def _enough(words: Words, term: np.ndarray, items: Items, item: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    """Whether the words around each passage hold enough of its item, as often as the item has them."""
    size = items.lengths[item]
    at, run = _around(words, start, size, items.scale[item] * SEGMENT + size)
    key = (item * (n + 1))[run] + term[at]
    some = np.flatnonzero(items.maybe[_slot(key)])
    run, key = run[some], key[some]
    place = np.minimum(np.searchsorted(items.keys, key), len(items.keys) - 1)
    has = items.keys[place] == key
    # How often each passage has a term of its item, and how often the item has it.
    both, count = np.unique(run[has] * len(items.keys) + place[has], return_counts=True)
    count = np.minimum(count, items.times[both % len(items.keys)])
    return np.bincount(both // len(items.keys), count, len(item)) >= items.least[item]


def _cosines(words: Words, term: np.ndarray, items: Items, padded: np.ndarray, item: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Latent cosine of each passage with the closest piece of its item."""
    out = np.zeros(len(item))
    for k in range(0, len(item), _AT_ONCE):
        i, p = item[k : k + _AT_ONCE], start[k : k + _AT_ONCE]
        at, run = _around(words, p, np.zeros_like(p), items.scale[i] * SEGMENT)
        vector = np.add.reduceat(padded[term[at]], np.flatnonzero(np.diff(run, prepend=-1)), axis=0)
        vector /= np.maximum(np.linalg.norm(vector, axis=1, keepdims=True), 1e-12)
        run, inner = spans(np.diff(items.piece)[i])
        near = np.einsum("ij,ij->i", vector[run], items.vectors[items.piece[i[run]] + inner])
        out[k : k + _AT_ONCE] = np.maximum.reduceat(near, np.flatnonzero(np.diff(run, prepend=-1)))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without a match. Each row is judged by its own text: rows that repeat an
    id, or have none, go only when their text holds an item. Other columns pass through, whatever their names."""
    docs, names = set_aside(docs)
    id_col, text_col = names[id_col], names[text_col]
    keyed = docs.withColumn("_key", row_key(id_col, text_col))
    matches = benchmark_matches(keyed, benchmark, id_col="_key", text_col=text_col, **options)
    found = stored(matches.select(F.col("id").alias("_key")).distinct(), "found")
    return put_back(without(keyed, found, ["_key"]).select(*docs.columns), names)
