"""Exact copies, near copies, repeated strings and lines against brute force on small tables."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldloom.llm import ngram_join
from fieldloom.llm.common import components
from fieldloom.llm.decontaminate import drop_contaminated
from fieldloom.llm.exact_dedup import exact_dedup
from fieldloom.llm.line_dedup import line_dedup
from fieldloom.llm.mixing import mix_to_targets
from fieldloom.llm.ngram_join import CountTree, drop_near_duplicates, near_duplicates
from fieldloom.llm.sharding import hilbert_shards
from fieldloom.llm.suffix_dedup import least_owner, repeated_spans

SCHEMA = "doc_id long, text string, lang string, size long, _text string"


def words(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice("alpha beta gamma delta Eps zeta eta theta iota kappa la mu nu xi".split()) + str(rng.randrange(60)) for _ in range(n))


def sample(seed: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    passage = words(rng, 30)
    rows: list[tuple] = [(0, None), (1, ""), (2, " \t\n"), (3, "one two"), (4, "ONE\ttwo"), (5, "one  two three"), (None, "one two"), (None, None)]
    for i in range(10, 70):
        text = words(rng, rng.choice([3, 8, 40, 120]))
        rows.append((i, text + (" " + passage if i % 5 == 0 else "")))
        if i % 3 == 0:
            parts = text.split(" ")
            for _ in range(rng.randrange(3)):
                parts[rng.randrange(len(parts))] = "é" + str(rng.randrange(9))
            rows.append((i + 1000, " ".join(parts)))
        if i % 4 == 0:
            rows.append((i + 2000, text.replace(" ", "\n", 1)))
    rows += [(900 + i, "x" * 300) for i in range(3)] + [(903, "ab" * 4000), (904, "ab" * 90), (905, "é" * 60), (906, "é" * 40 + "x" * 20)]
    rows += [rows[12], rows[12]]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows() -> list[tuple]:
    return sample()


@pytest.fixture(scope="module")
def docs(spark, rows):
    # Names that the operators use themselves pass through or are not read.
    full = [(i, t, "en", 7, "x") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(5)


def test_exact_copies(spark, docs, rows, tmp_path):
    path = str(tmp_path / "docs")
    docs.repartition(4).write.parquet(path)
    groups: dict[str, list] = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((i, len(t or "")))
    want = []
    for bare, found in groups.items():
        keep = min(found, key=lambda x: (-x[1], x[0] is None, x[0] or 0))[0]
        want += [(i, keep, len(found), hashlib.sha256(bare.encode()).hexdigest()) for i, _ in found]
    order = lambda x: tuple((v is None, v or 0) if not isinstance(v, str) else v for v in x)
    # A digest of one hex digit puts many texts together; checking bytes must tell them apart.
    for digest in (None, lambda t: F.substring(F.sha2(F.encode(t, "UTF-8"), 256), 1, 1)):
        got = exact_dedup(spark, path, max_bytes=2000, **({"digest": digest} if digest else {})).collect()
        assert sorted([(r.id, r.keep_id, r.group_size) for r in got], key=order) == sorted([w[:3] for w in want], key=order)
        if digest is None:
            assert sorted([r.digest for r in got]) == sorted(w[3] for w in want)
        assert sum(r.kept for r in got) == len(groups)
        assert all(r.id == r.keep_id for r in got if r.kept)


def test_exact_copies_of_an_empty_table(spark, docs, tmp_path):
    path = str(tmp_path / "none")
    docs.limit(0).write.parquet(path)
    assert exact_dedup(spark, path).count() == 0


def shingle_sets(rows):
    out = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out[i] = {b" ".join(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {b" ".join(w)} if w else set()
    return out


def brute_components(rows):
    sets = shingle_sets([r for r in rows if r[0] is not None])
    ids = sorted(sets)
    root = {i: i for i in ids}
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                for k in ids:
                    if root[k] in (x, y):
                        root[k] = min(x, y)
    return {i: (len(sets[i]), root[i]) for i in ids}


@pytest.mark.parametrize("options", [{}, {"hot": 2, "block": 150}])
def test_near_copies(docs, rows, options):
    """Also with every shingle taken as frequent, and families cut into many blocks."""
    got = near_duplicates(docs, **options).collect()
    assert len(got) == len(rows)
    assert {r.id: (r.n_shingles, r.component_id) for r in got if r.id is not None} == brute_components(rows)
    # Without an id: the component of the text's copies, or none.
    assert {r.component_id for r in got if r.id is None} == {3, None}


def test_one_of_each_group_stays(docs, rows):
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    left = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in left if i is not None) == sorted({c for _, c in brute_components(rows).values()})
    assert left.count(None) >= 1


def test_near_copies_are_judged_by_text(spark):
    """Of texts without id, or with one id, only the near copies go."""
    rng = random.Random(9)
    base = [words(rng, 60) for _ in range(7)]
    near = [t + " more" for t in base]
    rows = [(1, base[0]), (5, near[0]), (5, base[1]), (5, base[2]), (None, base[3]), (None, near[3]), (None, base[4]), (None, near[1]),
            (None, None), (None, None), (9, base[5]), (9, near[5]), (9, base[6]), (9, base[6])]
    docs = spark.createDataFrame([(i, t, "en", 7, "x") for i, t in rows], SCHEMA)
    kept = sorted(((r.doc_id, r.text) for r in drop_near_duplicates(docs).collect()), key=str)
    assert [r for r in kept if r[1] not in (base[3], near[3])] == sorted([
        (1, base[0]), (5, base[1]), (5, base[2]), (None, base[4]), (None, None), (None, None), (9, near[5]), (9, base[6])], key=str)
    assert sum(r in ((None, base[3]), (None, near[3])) for r in kept) == 1


def test_strings_are_removed_by_text(spark):
    """A text whose id is repeated by a copy, or by a text with a repeated passage, loses nothing."""
    rng = random.Random(10)
    a, b, c, d = (words(rng, 40) for _ in range(4))
    rows = [(1, a), (4, a), (4, b), (4, c + " " + a), (4, d), (6, d), (6, words(rng, 40)), (None, a), (None, d)]
    docs = spark.createDataFrame([(i, t, "en", 7, "x") for i, t in rows], SCHEMA)
    found: dict = {}
    for r in repeated_spans(docs, 50).collect():
        found.setdefault(r.id, set()).add((r.n_bytes, r.n_removed, tuple((s.lo, s.hi) for s in r.spans), bytes(r.kept)))
    assert found == brute_spans(rows, 50)


def test_near_copies_of_an_empty_table(docs):
    assert near_duplicates(docs.limit(0)).count() == 0


def test_the_tree_loses_no_pair():
    import numpy as np

    rng = np.random.default_rng(5)
    base = rng.integers(0, 3, (40, 16))
    vectors = np.vstack([base + (rng.random((40, 16)) < 0.05) for _ in range(12)]).astype(np.int32)
    sizes = vectors.sum(1)
    tree = CountTree(vectors, sizes)
    for q in range(0, len(sizes), 7):
        overlap = np.minimum(vectors, vectors[q]).sum(1)
        fits = (overlap * 180 >= 80 * (sizes + sizes[q])) & (sizes * 80 <= sizes[q] * 100) & (sizes[q] * 80 <= sizes * 100)
        assert set(np.flatnonzero(fits)) <= set(tree.search(vectors[q], int(sizes[q]), 80))


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, k) for k in range(200, 260)] + [(9, 9), (260, 161), (161, 160)]
    frame = spark.createDataFrame([(b, a) if a % 2 else (a, b) for a, b in edges], "a long, b long")
    got = {r.node: r.root for r in components(frame).collect()}
    assert got == {i: 100 for i in range(100, 162)} | {260: 100} | {k: 5 for k in [5, *range(200, 260)]}


def brute_spans(rows, length):
    out = {}
    for i, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        if i is not None:
            earlier = [(u or "").encode() for j, u in rows if j is not None and j < i]
            for k in range(len(raw) - length + 1):
                if any(raw[k : k + length] in e for e in earlier):
                    gone[k : k + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        runs = [m.span() for m in re.finditer(rb"\x01+", bytes(gone))]
        out.setdefault(i, set()).add((len(raw), len(raw) - len(kept), tuple(runs), kept))
    return out


@pytest.mark.parametrize("length", [50, 20])
def test_repeated_strings(docs, rows, length):
    got = repeated_spans(docs, length).collect()
    assert len(got) == len(rows)
    found: dict = {}
    for r in got:
        found.setdefault(r.id, set()).add((r.n_bytes, r.n_removed, tuple((s.lo, s.hi) for s in r.spans), bytes(r.kept)))
    assert found == brute_spans(rows, length)


def test_backward_extension_finds_every_equal_string():
    import numpy as np

    rng = np.random.default_rng(2)
    pieces = [bytes(rng.integers(97, 99, n).astype(np.uint8)) for n in rng.integers(6, 40, 60)] + [b"a" * 30, b"\0" * 12, b"\0" * 9]
    sizes = np.array([len(p) for p in pieces])
    owner = rng.integers(0, 30, len(pieces))
    got = least_owner(np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(sizes) - sizes, sizes, owner, 6)
    strings = [p[k : k + 6] for p in pieces for k in range(len(p) - 5)]
    of = [o for p, o in zip(pieces, owner, strict=True) for _ in range(len(p) - 5)]
    least: dict[bytes, int] = {}
    for s, o in zip(strings, of, strict=True):
        least[s] = min(least.get(s, 99), o)
    assert got.tolist() == [least[s] for s in strings]


def test_recurring_lines(spark):
    rows = [
        (1, "Order 12 shipped to Ana today please\nA line of its own here\nfoot note of all pages"),
        (2, "  foot  note of\tall pages \r\nOrder 7b shipped to Ana today please\nAnother line of its own"),
        (3, None), (4, ""), (5, "one two\n\nfoot note of all pages"), (None, "foot note of all pages\nnothing else recurs here"),
        (6, "User Eve has logged in from home now"), (7, "User Bob has logged in from home now"), (5, "one two\n\nfoot note of all pages"),
    ]
    docs = spark.createDataFrame([(i, t, "keep", 9) for i, t in rows], "doc_id long, text string, extra string, n_lines long")
    got = line_dedup(docs, depth=1)
    assert got.columns == ["doc_id", "text", "extra", "n_lines", "n_dropped"]
    found = sorted([(r.doc_id or -1, r.text, r.n_lines, r.n_dropped) for r in got.collect()], key=str)
    assert found == sorted([
        (1, rows[0][1], 3, 0), (2, "Another line of its own", 3, 2), (3, None, 0, 0), (4, "", 1, 0), (5, "one two\n", 3, 1),
        (5, "one two\n", 3, 1), (-1, "nothing else recurs here", 2, 1), (6, rows[6][1], 1, 0), (7, "", 1, 1)], key=str)
    assert line_dedup(docs.limit(0)).count() == 0
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_frequencies_are_counts_of_sets(docs, rows):
    counts: dict = {}
    for s in {frozenset(s) for s in shingle_sets(rows).values()}:
        for x in s:
            counts[x] = counts.get(x, 0) + 1
    # In one task equal sets count once; half of the shingles of larger sets are counted.
    found = [r.df for r in ngram_join._frequencies(docs.coalesce(1), 5, 3, "text").collect()]
    shared = sorted(n for n in counts.values() if n > 1)
    assert found and 0.3 * len(shared) < len(found) <= len(shared) and max(found) <= max(shared)


def test_unique_lines_with_a_common_beginning_stay(spark):
    """Leading words are the same in every line of a leaf, so they say nothing about a template."""
    rows = [(1, "The population of the city"), (2, "The population of the county"), (3, "We have seen it all before"),
            (4, "We have seen it not yet"), (5, "The population of the city")]
    got = {r.doc_id: r.text for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(rows) | {5: ""}


#: Names that the operators give to columns of their own (Spark ignores their case).
HELPERS = ["_WORD", "_bits", "_h", "_hit", "_id", "_hash", "_parts", "_lost", "_key", "_root", "_r", "_n", "_q0", "_q1", "_at",
           "_rank", "_cell", "_part", "_all", "_cell_n", "_cell_at", "_part_at", "_text", "aside_4"]


@pytest.mark.parametrize("name", ["line_dedup", "drop_near_duplicates", "drop_contaminated", "hilbert_shards", "mix_to_targets", "quality"])
def test_columns_named_like_helpers_pass_through(spark, name):
    names = ["doc_id", "text", "lang", "source", "n_chars", *HELPERS]
    texts = ["ka lo mi re tun sh ve do a b c d", "one two three four five six seven eight", "ka lo mi re tun sh ve do a b c d", None, ""]
    rows = [(i, t, "en", f"s{i % 2}", len(t or ""), *(f"{h} {i}" for h in HELPERS), {"k": i}) for i, t in enumerate(texts)]
    kinds = ", ".join(f"`{c}` {k}" for c, k in zip(names, ["long", "string", "string", "string", "long", *["string"] * len(HELPERS)], strict=True))
    docs = spark.createDataFrame(rows, kinds + ", _map map<string, long>")
    bench = spark.createDataFrame([(1, "one two three four five six seven eight")], "item_id long, text string")
    left = {"line_dedup": 5, "drop_near_duplicates": 4, "drop_contaminated": 4, "hilbert_shards": 5, "mix_to_targets": 5, "quality": 5}
    got = {
        "line_dedup": lambda: line_dedup(docs),
        "drop_near_duplicates": lambda: drop_near_duplicates(docs),
        "drop_contaminated": lambda: drop_contaminated(docs, bench),
        "hilbert_shards": lambda: hilbert_shards(docs, shards=2),
        "mix_to_targets": lambda: mix_to_targets(docs, {"source": {"s0": 0.5, "s1": 0.5}}),
        "quality": lambda: corpus_pipeline.quality(spark, docs, "/root/testdata/sf0.001"),
    }[name]()
    found = got.collect()
    assert got.columns[: len(docs.columns)] == docs.columns
    assert len(found) == left[name] if name != "quality" else 0 < len(found) <= 5
    for r in found:
        assert all(r[h] == f"{h} {r.doc_id}" for h in HELPERS) and r["_map"] == {"k": r.doc_id}
    assert drop_near_duplicates(docs.union(docs)).count() == 4
