"""License scan, hard negatives and vector codes against brute force on small tables."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import hard_negatives as hn
from fieldloom.llm.hard_negatives import Best, Windows, first_of_groups, hard_negatives
from fieldloom.llm.license_scan import NOTICES, PHRASES, Template, license_hits, license_scan, wanted
from fieldloom.llm.queries import QUERIES
from fieldloom.llm.vector_codes import CellMemory, cell_width, codebook_digest, encode, train_codebooks
from fieldloom.llm.vectors import scaled, usable

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))


# --- licenses --------------------------------------------------------------------------------


def brute_scan(text: str | None) -> tuple:
    words, templates = words_of(text), [*PHRASES, *NOTICES]
    core = max(len(words_of(t.text)) for t in templates)
    base, labels, score, base_labels = [], set(), 0.0, set()
    for k, t in enumerate(templates):
        phrase = words_of(t.text)
        if t.phrase:
            places = [i for i in range(len(words)) if words[i : i + len(phrase)] == phrase]
            if places:
                labels.add(t.label)
                score = 1.0
                if k < len(PHRASES):
                    base += places
                    base_labels.add(t.label)
            continue
        for at in range(0, len(words), core):
            shared = len(set(words[at : at + 2 * core]) & set(phrase))
            if shared >= wanted(len(set(phrase))):
                labels.add(t.label)
                score = max(score, shared / len(set(phrase)))
    return (len(words), len(base), min(base, default=None), max(base, default=None), ",".join(sorted(base_labels)),
            ",".join(sorted(labels)), score)


def texts() -> list[tuple]:
    rng = random.Random(5)
    filler = lambda n: " ".join(rng.choice("the of software and in to or ist das été Straße 12 notice any work is this that file".split()) for _ in range(n))
    out = [(0, None), (1, ""), (2, " .\n;"), (None, "MIT License"), (None, None), (3, "the MIT\nLicense, cc-by-nc and CC  BY. Apache\tLICENSE"),
           (4, "gnu general public gnu general public license"), (5, "émit license and mit licenseé"), (6, "cc by " * 500), (6, "cc by " * 500),
           (7, filler(40_000) + " mit license " + filler(100)), (8, "cc by cc by nc")]
    for i, t in enumerate([*PHRASES, *NOTICES]):
        words = t.text.split(" ")
        for lost in (0, 1, len(words) // 5, len(words) // 3):
            left = list(words)
            for _ in range(lost):
                left.pop(rng.randrange(len(left)))
            if lost % 2:
                rng.shuffle(left)
            out.append((100 * (i + 1) + lost, filler(rng.randrange(90)) + ". " + " ".join(left) + "! " + filler(rng.randrange(50))))
    return out


def test_license_scan_equals_brute_force(spark):
    rows = texts()
    docs = spark.createDataFrame([(i, t, "x", 1, ["y"]) for i, t in rows], "doc_id long, text string, id string, key long, words array<string>")
    found = license_scan(docs.repartition(4), PHRASES, NOTICES).drop("hits").collect()
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    assert sorted((tuple(r) for r in found), key=key) == sorted(((i, *brute_scan(t)) for i, t in rows), key=key)
    assert sum(r["n_base"] for r in found) > 1000


def test_license_scan_of_nothing_and_of_other_templates(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert license_scan(empty, PHRASES, NOTICES).collect() == []
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "e d c b a"), (3, "a b")], "doc_id long, text string")
    assert [r["hits"] for r in license_hits(docs, [Template("none", " .")]).collect()] == [[], [], []]
    found = license_hits(docs, [Template("set", "a b c d"), Template("run", "b c", True), Template("set", "a b x y z")], containment=0.7)
    assert {r["id"]: sorted((h["template"], h["places"]) for h in r["hits"]) for r in found.collect()} == {
        1: [(0, None), (1, [1])], 2: [(0, None)], 3: []}


def test_license_scan_is_native(spark):
    docs = spark.createDataFrame([(1, "mit license")], "doc_id long, text string")
    plan = license_scan(docs, PHRASES, NOTICES)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|ArrowEval|MapInArrow", plan)


# --- hard negatives --------------------------------------------------------------------------


def brute_negatives(rows: list[tuple], positives: int = 5, negatives: int = 10) -> list[tuple]:
    rows = [(i, c, v) for i, c, v in rows if i is not None and c is not None and v is not None and None not in v]
    out = []
    for a, label, vector in rows:
        if a % 100:
            continue
        score = lambda v: sum(x * y for x, y in zip(vector, v))
        others = [(-score(v), i, c) for i, c, v in rows if i != a and len(v) == len(vector)]
        for p, pi, _ in sorted(x for x in others if x[2] == label)[:positives]:
            fits = sorted(x for x in others if x[2] != label and -30 * p <= -100 * x[0] <= -90 * p)
            out += [(a, pi, n, ni, -p, -s) for n, (s, ni, _) in enumerate(fits[:negatives], 1)]
    return out


@pytest.mark.parametrize("block", [1, 4, 4096])
def test_hard_negatives_equal_brute_force(spark, block):
    rng = np.random.default_rng(block)
    rows = []
    for i in range(0, 900, 3):
        base = rng.integers(-40, 60, 6) if i % 2 else np.array([20, 30, -10, 5, 0, 7]) + rng.integers(0, 4, 6)
        rows.append((i, int(rng.integers(0, 3)), [int(x) for x in base]))
    rows += [(5000 + i, i % 3, [20, 30, -10, 5, 0, 7]) for i in range(60)]  # equal vectors: ties
    rows += [rows[7], rows[7], (300, 1, None), (None, 1, [1] * 6), (1200, None, [2] * 6), (1300, 1, [1, None, 2, 3, 4, 5]),
             (1400, 1, []), (1500, 2, []), (1600, 0, [9, 9]), (1601, 0, [5, 5]), (1602, 1, [3, 3]), (1700, 7, [0] * 6)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "id long, label int, vector array<long>, score string, anchor int")
    found = hard_negatives(frame.repartition(6), F.col("id") % 100 == 0, block=block).collect()
    want = brute_negatives(rows)
    assert sorted(tuple(r) for r in found) == sorted(want)
    assert len(want) > 100


def test_hard_negatives_of_nothing(spark, monkeypatch):
    empty = spark.createDataFrame([], "id long, label int, vector array<long>")
    assert hard_negatives(empty, F.col("id") % 100 == 0).collect() == []
    some = spark.createDataFrame([(1, 1, [1]), (100, 2, [1])], empty.schema)
    assert hard_negatives(some, F.col("id") % 100 == 0).collect() == []
    monkeypatch.setattr(hn, "_CELLS", 3)  # pieces of a few rows
    rows = [(i, i % 2, [i % 13, 3]) for i in range(200)]
    frame = spark.createDataFrame(rows, empty.schema)
    assert sorted(tuple(r) for r in hard_negatives(frame, F.col("id") % 100 == 0).collect()) == sorted(brute_negatives(rows))


def test_best_keeps_the_first_of_each_group():
    rng = np.random.default_rng(1)
    groups, scores, ids = rng.integers(0, 7, 500), rng.integers(0, 20, 500), rng.permutation(500)
    best = Best(7, 4)
    for k in range(0, 500, 90):
        best.offer(groups[k : k + 90], scores[k : k + 90], ids[k : k + 90])
    want = [sorted((-s, i) for g2, s, i in zip(groups, scores, ids) if g2 == g)[:4] for g in range(7)]
    assert [[(-s, i) for g2, s, i in zip(best.groups, best.scores, best.ids) if g2 == g] for g in range(7)] == want
    assert list(best.floor) == [-w[-1][0] for w in want]
    assert len(first_of_groups(groups, scores, ids, 1)) == 7
    low, high = Windows().limits(np.array([100, 33, 0, -50]))
    assert list(low) == [30, 10, 0, -15] and list(high) == [90, 29, 0, -45]


# --- vector codes ----------------------------------------------------------------------------


def brute_codes(rows: list[tuple], parts: int, entries: int, rounds: int) -> tuple[dict, list]:
    width = -(-max(len(v) for _, _, v in rows) // parts)
    cut = [[(list(v) + [0] * (parts * width))[p * width : (p + 1) * width] for p in range(parts)] for _, _, v in rows]
    first = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, rows[k][2]))[:entries]
    books = [[cut[k][p] for k in first] for p in range(parts)]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))
    near = lambda x, book: min((far(x, c), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            owner = [near(c[p], books[p])[1] for c in cut]
            books[p] = [
                [sum(x) // len(x) for x in zip(*(c[p] for c, o in zip(cut, owner) if o == e))] if e in owner else old
                for e, old in enumerate(books[p])]
    final = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    return sorted(("%s" % r[0], "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f)) for r, f in zip(rows, final)), books


@pytest.mark.parametrize("parts,width,entries", [(8, 8, 16), (4, 3, 5), (3, 1, 40)])
def test_vector_codes_equal_brute_force(spark, parts, width, entries):
    rng = np.random.default_rng(parts)
    rows = [(int(i), int(i % 3), [int(x) for x in rng.integers(-900, 900, parts * width)]) for i in rng.permutation(70)]
    rows += [rows[3], rows[3], (None, None, [5] * (parts * width)), (900, None, [7] * (parts * width - 1)), (901, 1, [])]
    rows += [(1000 + i, 0, [1] * (parts * width)) for i in range(40)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "id long, label int, vector array<long>, code string").repartition(5)
    books = train_codebooks(frame, parts, entries, rounds=3)
    want, want_books = brute_codes(rows, parts, entries, 3)
    assert books.tolist() == want_books
    got = encode(frame, books).collect()
    assert sorted((str(r["id"]), r["code"], r["error"]) for r in got) == want
    assert codebook_digest(books) == hashlib.sha256(",".join(str(x) for p in want_books for e in p for x in e).encode()).hexdigest()


def test_vector_codes_of_nothing(spark):
    empty = spark.createDataFrame([], "id long, label int, vector array<long>")
    books = train_codebooks(empty)
    assert books.shape == (8, 0, 0) and encode(empty, books).collect() == []
    blank = spark.createDataFrame([(1, 1, []), (2, None, [])], empty.schema)
    assert [(r["code"], r["error"]) for r in encode(blank, train_codebooks(blank)).collect()] == [("00" * 8, 0)] * 2


def test_cell_memory_leaves_out_no_nearest_entry():
    rng = np.random.default_rng(2)
    book = rng.integers(-500, 500, (16, 4))
    points = np.concatenate([rng.integers(-900, 900, (4000, 4)), np.repeat(book, 3, 0), np.repeat(rng.integers(-9, 9, (5, 4)), 200, 0)])
    distance = ((points[:, None] - book) ** 2).sum(2)
    for width, most in ((1, 100), (cell_width(book), 1 << 16), (1000, 7)):
        memory = CellMemory(book, width, most)
        for _ in range(2):
            index, least = memory.nearest(points)
            assert (index == distance.argmin(1)).all() and (least == distance.min(1)).all()
    memory = CellMemory(book, cell_width(book))
    memory.nearest(points)
    assert memory.evaluated < 0.6 * distance.size
    memory.nearest(points)
    assert memory.hits >= memory.misses
    # Cells that share a hash are told apart by their places.
    memory.hashes, memory.cells, memory.masks = memory.hashes[:], memory.cells + 1, np.zeros_like(memory.masks)
    assert (memory.nearest(points)[0] == distance.argmin(1)).all()


def test_queries_leave_out_unusable_vectors(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(i, i % 3, [((i * 7 + k) % 11) / 10 for k in range(16)]) for i in range(40)]
    bad = [(100, 1, None), (101, 1, [nan] * 16), (102, 2, [inf] * 16), (103, 1, [None] + [0.1] * 15), (200, None, [0.2] * 16)]
    frame = spark.createDataFrame(rows + bad, "vec_id long, label int, embedding array<float>")
    assert frame.filter(usable(F.col("embedding"))).count() == 41
    floors = np.floor(np.array(rows[1][2], np.float32).astype(float) * 10).astype(int).tolist()
    assert frame.filter("vec_id = 1").select(scaled(F.col("embedding"), 10)).first()[0] == floors
    frame.write.parquet(str(tmp_path / "embeddings.parquet"))
    codes = QUERIES["op13_vector_codes"](spark, str(tmp_path)).collect()
    assert len(codes) == 41 and {r["vec_id"] for r in codes} == {*range(40), 200}
    by_id = {r["vec_id"]: r for r in codes}
    assert by_id[200]["label_error"] == by_id[200]["error"]
    assert by_id[1]["label_error"] == sum(by_id[i]["error"] for i in range(1, 40, 3))
    found = QUERIES["op12_hard_negatives"](spark, str(tmp_path)).collect()
    assert found and {r["anchor_id"] for r in found} == {0}
