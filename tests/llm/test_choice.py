"""Quality, decontamination, mixing, shards and the pipeline."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldloom.llm import queries
from fieldloom.llm.common import bit_table, bitmap, in_bitmap, with_hit
from fieldloom.llm.decontaminate import (
    Items, Vocabulary, benchmark_matches, common_subsequence, drop_contaminated, latent_terms, possible_passages, words_of)
from fieldloom.llm.mixing import mix_to_targets, rake
from fieldloom.llm.quality import BINS, STATISTICS, isotonic, quality_scores, statistics
from fieldloom.llm.sharding import hilbert_index, hilbert_shards, quantised, write_shards

SF = "/root/testdata/sf0.001"


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(["ka", "lo", "mi", "re", "tun", "sh"]) for _ in range(rng.randrange(1, 5))) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    rows = []
    for i in range(240):
        good = prose(rng, rng.randrange(5, 80))
        rows.append((i, good if i % 3 else " ".join(w + rng.choice(["!!", "###", "$$$"]) for w in good.upper().split()), int(i % 3 > 0)))
    return rows


def docs_of(spark, rows):
    return spark.createDataFrame(
        [(i, t, ("en", "de", None)[(i or 0) % 3], f"src{(i or 0) % 4}", len(t or ""), 1.0) for i, t in rows],
        "doc_id long, text string, lang string, source string, n_chars long, score double")


def test_quality_learns_and_holds_out(spark, texts):
    odd = [(900, None), (901, ""), (None, "ka lo mi"), (902, "x" * 50_000), (5, texts[5][1])]
    docs = docs_of(spark, [r[:2] for r in texts] + odd)
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in texts] + [(901, None, 1), (None, 1, 0), (7777, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality_scores(docs, labels).collect()
    assert len(got) == len(texts) + len(odd)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    truth = {i: q for i, _, q in texts}
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([p == q for p, q in held]) > 0.95
    # Labels of held out rows change nothing, nor does the order of rows.
    flipped = spark.createDataFrame([(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, _, q in texts], "doc_id long, quality int")
    again = {r.doc_id: r.score for r in quality_scores(docs.repartition(3), flipped).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-6 for r in got)


def test_quality_equals_a_fit_in_one_place(spark, texts):
    """Features, ridge and calibration over all rows at once: least squares with extra rows for the
    penalty, and the minimum-maximum form of isotonic regression."""
    rng = random.Random(14)
    truth = [(i, t, q if rng.random() < 0.85 else 1 - q) for i, t, q in texts]
    got = {r.doc_id: r.score for r in quality_scores(
        docs_of(spark, [r[:2] for r in truth]).repartition(5), spark.createDataFrame([(i, q) for i, _, q in truth], "doc_id long, quality int")).collect()}
    ids, y = [i for i, _, _ in truth], np.array([q for _, _, q in truth], float)
    stats = np.asarray(statistics(pd.Series([t for _, t, _ in truth])), float)
    known = np.array([zlib.crc32(str(i).encode()) % 5 > 0 for i in ids])
    half = np.array([zlib.crc32(f"h{i}".encode()) % 2 for i in ids])
    spread = stats[known].std(0)
    z = np.clip((stats - stats[known].mean(0)) / np.where(spread < 1e-5, 1, spread), -8, 8)
    draw = np.random.default_rng(7)
    omega, phase = draw.normal(0, 1 / 5.0, (z.shape[1], 256)), draw.uniform(0, 2 * np.pi, 256)
    x = np.column_stack([np.cos(z @ omega + phase) * np.sqrt(2 / 256), z, np.ones(len(z))])
    n, wide = known.sum(), x.shape[1]
    weight = np.where(y == 1, n / (2 * y[known].sum()), n / (2 * (n - y[known].sum())))

    def raw_of(rows):
        root = np.sqrt(weight[rows])
        a = np.vstack([x[rows] * root[:, None], np.sqrt(1e-3 * n / wide) * np.eye(wide)])
        return x @ np.linalg.lstsq(a, np.concatenate([y[rows] * root, np.zeros(wide)]), rcond=None)[0]

    apart = np.where(half == 0, raw_of(known & (half == 1)), raw_of(known & (half == 0)))
    cell = np.clip((apart + 0.5) / 2 * BINS, 0, BINS - 1).astype(int)
    seen = np.unique(cell[known])
    count = np.array([(cell[known] == c).sum() for c in seen])
    ones = np.array([y[known][cell[known] == c].sum() for c in seen])
    mean = lambda i, j: ones[i : j + 1].sum() / count[i : j + 1].sum()
    level = [max(min(mean(i, j) for j in range(k, len(seen))) for i in range(k + 1)) for k in range(len(seen))]
    raw = raw_of(known)
    want = np.clip(0.999 * np.interp(raw, -0.5 + 2 * (seen + 0.5) / BINS, level) + 0.001 * np.clip((raw + 0.5) / 2, 0, 1), 0, 1)
    assert len(seen) > 20 and np.allclose([got[i] for i in ids], want, atol=1e-3)


def test_quality_without_labels_or_rows(spark, texts):
    docs = docs_of(spark, [r[:2] for r in texts[:5]])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality_scores(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(i, 1) for i in range(5)], "doc_id long, quality int")
    assert {(r.score, r.predicted) for r in quality_scores(docs, one).collect()} == {(1.0, 1)}
    assert quality_scores(docs.limit(0), one).count() == 0


def test_statistics_and_isotonic():
    import pandas as pd

    rows = statistics(pd.Series(["Ab, ab!! ab", None, "", "\n", "é1"]))
    by = dict(zip(STATISTICS, rows[0], strict=True))
    assert by["comma"] == by["upper"] == pytest.approx(1 / 11) and by["bang"] == pytest.approx(2 / 11)
    assert not rows[1].any() and not rows[2].any() and rows[3].any() and len(rows) == 5
    assert isotonic(np.array([0.0, 0.5, 0.2, 1.0, 0.9]), np.array([1.0, 1, 2, 1, 1])).tolist() == pytest.approx([0, 0.3, 0.3, 0.95, 0.95])


def brute_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_subsequence():
    rng = np.random.default_rng(4)
    for _ in range(60):
        a, b = (rng.integers(0, 6, rng.integers(0, 70)).astype(np.uint64) for _ in range(2))
        assert common_subsequence(a, b) == brute_subsequence(a.tolist(), b.tolist())


def test_latent_space_is_that_of_the_full_decomposition():
    rng = np.random.default_rng(6)
    counts = rng.poisson(0.3, (300, 12)).astype(float)
    counts[:, 0] += 1
    found = (counts > 0).sum(0)
    omega = rng.normal(size=(12, 12))
    got = latent_terms(counts.T @ counts @ omega, found, 300.0, omega)
    idf = np.log(301 / (1 + found)) + 1
    # With as many directions as terms, cosines are those of the TF-IDF vectors themselves.
    a = counts * idf
    x = counts[:20] @ got
    cosine = lambda g: g / np.sqrt(np.outer(np.diag(g), np.diag(g)))
    assert np.allclose(cosine(x @ x.T), cosine(a[:20] @ a[:20].T), atol=1e-3)
    # With fewer, they still are when the matrix has no more directions.
    counts = rng.poisson(2, (300, 3)) @ rng.poisson(1, (3, 12)).astype(float)
    found = (counts > 0).sum(0)
    test = rng.normal(size=(12, 8))
    a = counts * (np.log(301 / (1 + found)) + 1)
    x = counts[50:70] @ latent_terms(counts.T @ counts @ test, found, 300.0, test)
    some = a[50:70].any(1)
    assert some.sum() > 10 and np.allclose(cosine((x @ x.T)[some][:, some]), cosine((a[50:70] @ a[50:70].T)[some][:, some]), atol=1e-3)


@pytest.mark.parametrize("block", [4000, 4])
def test_benchmark_passages(spark, block):
    rng = random.Random(12)
    items = [prose(rng, n) for n in (8, 15, 25, 40, 60, 100)] + ["", None, "ka lo"]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    rows, want = [], set()
    for i in range(120):
        text = prose(rng, rng.randrange(20, 400))
        if i % 8 == 0:
            k = (i // 8) % 6
            item = items[k].split(" ")
            if i % 16 == 0:
                # A paraphrase: other case, signs, some words dropped; the end is kept.
                item = [w.upper() + "," for j, w in enumerate(item) if j % 6 != 2 or j > len(item) - 7]
            words = text.split(" ")
            at = rng.randrange(len(words))
            text = " ".join(words[:at] + item + words[at:])
            want.add((i, k))
        rows.append((i, text))
    rows += [(500, None), (501, ""), (None, items[3]), (0, rows[0][1])]
    docs = docs_of(spark, rows)
    got = benchmark_matches(docs, bench, block_items=block).collect()
    assert {(r.id, r.item_id) for r in got} >= want | {(None, 3)}
    assert {(r.id, r.item_id) for r in got} - want - {(None, 3)} <= {(i, 8) for i, _ in rows}
    kept = drop_contaminated(docs, bench.filter("item_id < 8"), block_items=block)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - {i for i, _ in want} - {None}
    assert benchmark_matches(docs.limit(0), bench).count() == 0
    assert benchmark_matches(docs, bench.limit(0)).count() == 0


def paraphrased(rng: random.Random, item: list[str], n: int, others: list[str]) -> list[str]:
    out = list(item)
    for j in rng.sample(range(len(item)), n):
        out[j] = rng.choice(others)
    return out


def brute_matches(rows, items):
    """By the longest common subsequence with the whole text, which may only find more."""
    split = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    return {(i, k) for i, t in rows for k, item in enumerate(items) if brute_subsequence(split(item), split(t)) >= 0.7 * len(split(item))}


@pytest.mark.parametrize("kind", ["copies", "passage", "few"])
def test_hot_paraphrases(spark, kind):
    """A paraphrase in a third of all rows, as copies of one text or in texts of their own; and in few rows."""
    rng = random.Random(31)
    words = ["".join(rng.choice(["ka", "lo", "mi", "re", "tun", "sh", "ve", "do"]) for _ in range(3)) for _ in range(900)]
    items = [" ".join(rng.sample(words, 40)) for _ in range(6)]
    some = paraphrased(rng, items[0].split(), 11, words)
    rows = [(i, " ".join(rng.choice(words) for _ in range(120))) for i in range(6 if kind == "few" else 240)]
    host = rows[0][1].split()
    for i in range(2 if kind == "few" else 120):
        other = host if kind == "copies" else [rng.choice(words) for _ in range(120)]
        at = 60 if kind == "copies" else rng.randrange(120)
        rows.append((1000 + i, " ".join(other[:at] + some + other[at:])))
    docs = docs_of(spark, rows)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.id, r.item_id) for r in benchmark_matches(docs, bench).collect()}
    assert got == brute_matches(rows[:1] + rows[-2:], items) | {(i, 0) for i, _ in rows if i >= 1000}
    assert {r.doc_id for r in drop_contaminated(docs, bench).collect()} == {i for i, _ in rows if i < 1000}


def test_latent_cosines_alone_find_the_matches(spark):
    """Recall of the cosine against brute force in a hot group and in cold ones, with the sample that
    a large table has; without the cosine nothing is found by another way."""
    rng = random.Random(52)
    words = ["".join(rng.choice(["ka", "lo", "mi", "re", "tun", "sh", "ve", "do"]) for _ in range(3)) for _ in range(900)]
    items = [" ".join(rng.choice(words) for _ in range(rng.randrange(15, 60))) for _ in range(40)]
    rows = []
    for i in range(400):
        other = [rng.choice(words) for _ in range(rng.randrange(10, 300))]
        k = 0 if i % 3 == 0 else i % 40 if i % 3 == 1 else None
        if k is not None:
            at = rng.randrange(len(other))
            item = items[k].split()
            other = other[:at] + paraphrased(rng, item, len(item) // 5, words) + other[at:]
        rows.append((i, " ".join(other)))
    docs = docs_of(spark, rows)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = brute_matches(rows, items)
    for options in ({}, {"fit_passages": 200}, {"fit_passages": 1}):
        got = {(r.id, r.item_id) for r in benchmark_matches(docs, bench, **options).collect()}
        assert got <= want
        for hot in (True, False):
            part = {x for x in want if (x[1] == 0) == hot}
            assert len(part) > 100 and len(part & got) >= 0.9 * len(part)
    assert benchmark_matches(docs, bench, similarity=1.1).count() == 0


def test_the_decomposition_is_fitted_on_all_documents(spark):
    """Also on a table of more passages (some 100,000) than a caller would take for a fit."""
    rng = random.Random(53)
    words = [f"w{i}" for i in range(300)]
    items = [" ".join(rng.choices(words, k=30)) for _ in range(5)]
    rows = [(i, " ".join(rng.choices(words, k=200)) + " x" * 80_000 + " " + " ".join(paraphrased(rng, items[i % 5].split(), 3, words))) for i in range(40)]
    docs = docs_of(spark, rows)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    plain, whole = ({(r.id, r.item_id): r.similarity for r in benchmark_matches(docs, bench, rank=16, **options).collect()} for options in ({}, {"fit_passages": 1 << 40}))
    assert len(plain) >= 40 and plain == pytest.approx(whole, abs=1e-4)


def test_the_bounds_leave_no_passage_out():
    """Every passage around which enough of an item's words lie is looked at."""
    rng = random.Random(77)
    words = [a + b for a in "abcdefg" for b in "uvwxyz"]
    items = pd.Series([" ".join(rng.choices(words, k=rng.randrange(1, 30))) for _ in range(25)] + [None, ""])
    texts = pd.Series([" ".join(rng.choices(words, k=rng.choice([0, 3, 20, 90]))) for _ in range(40)] + [None])
    of_items, of_texts = words_of(items), words_of(texts)
    vocabulary = Vocabulary.of(of_items.hashes)
    n = len(vocabulary.terms)
    known = Items.of(np.arange(27), of_items, vocabulary, np.arange(n) + 1.0, np.eye(n, dtype=np.float32), 0.5)
    got = {(int(i), int(p)) for a, b in possible_passages(of_texts, vocabulary.index(of_texts.hashes), known, n) for i, p in zip(a, b)}
    want, at = set(), 0
    for t in texts.fillna(""):
        t = t.split()
        for i, item in enumerate(items.fillna("")):
            item = item.split()
            m, s = len(item), int(known.scale[i]) * 8
            for lo in range(0, len(t), max(8, s // 2)):
                both = Counter(t[max(0, lo - m) : lo + s + m]) & Counter(item)
                if m and sum(both.values()) >= (m if m < 4 else -(-m // 2)):
                    want.add((i, at + lo))
        at += len(t)
    assert got == want and len(want) > 50


def test_long_items(spark):
    """Items of 300 and 1,000 words, verbatim and with 0.25 of the words replaced."""
    rng = random.Random(41)
    words = ["".join(rng.choice(["ka", "lo", "mi", "re", "tun", "sh", "ve", "do"]) for _ in range(5)) for _ in range(9000)]
    items = [rng.sample(words, n) for n in (300, 1000)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(400))) for i in range(100)]
    for k, item in enumerate(items):
        for j in range(2):
            body = paraphrased(rng, item, j * len(item) // 4, words)
            rows.append((1000 + 2 * k + j, " ".join(rows[k][1].split()[:90] + body + rows[j][1].split()[:70])))
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    got = {(r.id, r.item_id) for r in benchmark_matches(docs_of(spark, rows), bench).collect()}
    assert got == {(1000 + 2 * k + j, k) for k in range(2) for j in range(2)}


def test_contamination_is_judged_by_text(spark):
    """One bad and several clean texts without id, and with one id."""
    rng = random.Random(3)
    item = prose(rng, 30)
    clean = [prose(rng, 60) for _ in range(8)]
    rows = [(i, t) for i in (None, 7) for t in (*clean[:3], clean[3] + " " + item, None)] + [(8, clean[5]), (None, clean[5])]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = drop_contaminated(docs_of(spark, rows), bench).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted((r for r in rows if item not in (r[1] or "")), key=str)


def test_raking_meets_its_targets():
    rng = np.random.default_rng(3)
    mass = rng.random((4, 3, 2)) * 100
    targets = [np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.5, 0.3, 0.2]), np.array([0.6, 0.4])]
    kept = rake(mass, targets, 0.2 * mass.sum())
    for axis, target in enumerate(targets):
        share = kept.sum(axis=tuple(a for a in range(3) if a != axis))
        assert np.allclose(share / share.sum(), target, atol=1e-6)
    assert (kept <= mass + 1e-9).all() and kept.sum() == pytest.approx(0.2 * mass.sum())
    # Cells that do not occur need not be there, and the fitted table is the grid's times one factor
    # for each category: that is what proportional fitting gives, and nothing else has these margins.
    some = rng.random((4, 3, 2)) < 0.8
    some[:, 0, 0] = some[0] = True
    sparse = rake(mass[some], targets, 0.2 * mass.sum(), np.array(np.nonzero(some)))
    assert np.allclose(sparse, rake(np.where(some, mass, 0), targets, 0.2 * mass.sum())[some])
    logs = np.log(kept / mass)
    assert np.allclose(logs - logs[:1] - logs[:, :1] - logs[:, :, :1] + logs[:1, :1] + logs[:1, :, :1] + logs[:, :1, :1], logs[:1, :1, :1], atol=1e-6)
    # A category that holds too little is taken whole.
    scarce = rake(np.array([[1.0], [99.0]]), [np.array([0.5, 0.5]), np.array([1.0])], 50)
    assert scarce.ravel() == pytest.approx([1, 49])


def test_mixing(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, 30) + (" licensed" if i % 5 == 0 else "")) for i in range(3000)] + [(None, None), (3001, ""), (7, None)]
    docs = docs_of(spark, rows)
    targets = {"source": {"src0": 0.4, "src1": 0.2}, "topic": {"general": 0.5, "licence": 0.5}}
    got = mix_to_targets(docs, targets, 0.2)
    assert got.columns == [*docs.columns, "topic", "n_tokens", "probability", "sampled"]
    found = got.collect()
    assert len(found) == len(rows)
    kept = [r for r in found if r.sampled]
    tokens = sum(r.n_tokens for r in kept)
    assert tokens == pytest.approx(0.2 * sum(r.n_tokens for r in found), rel=0.12)
    assert sum(r.n_tokens for r in kept if r.topic == "licence") / tokens == pytest.approx(0.5, abs=0.08)
    assert sum(r.n_tokens for r in kept if r.source == "src0") / tokens == pytest.approx(0.4, abs=0.08)
    again = {(r.doc_id, r.text) for r in mix_to_targets(docs.repartition(7), targets, 0.2).filter("sampled").collect()}
    assert again == {(r.doc_id, r.text) for r in kept}
    assert mix_to_targets(docs.limit(0), targets, 0.2).count() == 0


def test_mixing_keeps_what_targets_do_not_name(spark):
    """Null and unlisted sources and languages, under the registered targets and those of the stage."""
    rng = random.Random(5)
    kinds = [("src1", "en"), ("src20", "en"), (None, "de"), ("src2", None), ("src3", "pl"), (None, None), ("src4", "fr")]
    docs = spark.createDataFrame(
        [(i, prose(rng, 30), *kinds[i % 7]) for i in range(1400)], "doc_id long, text string, source string, lang string")
    for targets in (queries.MIX_TARGETS, corpus_pipeline.MIX_TARGETS):
        got = mix_to_targets(docs, targets, 0.5).collect()
        for kind in kinds:
            assert any(r.sampled for r in got if (r.source, r.lang) == kind), kind
        assert min(r.probability for r in got) > 0


def test_curve_steps_to_neighbours(spark):
    grid = spark.range(1 << 9).selectExpr("id % 8 as x", "id div 8 % 8 as y", "id div 64 as z")
    from pyspark.sql import functions as F

    path = [(r.x, r.y, r.z) for r in grid.withColumn("h", hilbert_index([F.col("x"), F.col("y"), F.col("z")], 3)).orderBy("h").collect()]
    assert len(set(path)) == 512
    assert all(sum(abs(a - b) for a, b in zip(p, q, strict=True)) == 1 for p, q in zip(path, path[1:], strict=False))


def test_shards(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, rng.randrange(1, 90))) for i in range(101)] + [(None, None), (3, ""), (3, ""), (200, "é" * 9)]
    docs = docs_of(spark, rows).withColumnRenamed("score", "shard")
    got = hilbert_shards(docs, shards=16)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "size", "text_crc32", "hilbert", "shard", "slot"]
    found = got.collect()
    by_shard: dict[int, list] = {}
    for r in found:
        by_shard.setdefault(r.shard, []).append(r)
        assert r.size == len((r.text or "").encode()) + 1 and r.text_crc32 == zlib.crc32((r.text or "").encode())
    counts = [len(by_shard[k]) for k in range(16)]
    assert sum(counts) == len(rows) and max(counts) - min(counts) <= 1
    last = -1
    for k in range(16):
        here = sorted(by_shard[k], key=lambda r: r.slot)
        assert [r.slot for r in here] == list(range(len(here)))
        assert all(a.hilbert <= b.hilbert for a, b in zip(here, here[1:], strict=False)) and here[0].hilbert >= last
        last = here[-1].hilbert
    few = hilbert_shards(docs.limit(3), shards=16).collect()
    assert sorted((r.shard, r.slot) for r in few) == [(0, 0), (1, 0), (2, 0)]
    assert hilbert_shards(docs.limit(0)).count() == 0
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_shard_files_can_be_skipped(spark, tmp_path):
    """Dimensions are cut at quantiles, so sources with a common prefix, and a hot one, are told apart."""
    rng = random.Random(9)
    rows = [(i, "x" * rng.randrange(1, 400), ("en", "de", "fr", None)[i // 3 % 4], "src0" if i % 3 == 0 else f"src{rng.randrange(20)}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text"))
    steps = quantised(docs, ("lang", "source", "n_chars")).groupBy("_q1").agg(F.countDistinct("source").alias("n")).collect()
    assert len(steps) >= 8 and max(r.n for r in steps) <= 4
    write_shards(hilbert_shards(docs, shards=4), str(tmp_path / "out"), 4)
    assert spark.read.parquet(str(tmp_path / "out")).drop("shard").select(*docs.columns).exceptAll(docs).count() == 0
    files = [pq.ParquetFile(f) for f in (tmp_path / "out").rglob("*.parquet")]
    assert sum(f.metadata.num_rows for f in files) == 6000 and len(files) >= 12

    def must_read(column: str, value) -> int:
        at = files[0].schema_arrow.get_field_index(column)
        ends = [f.metadata.row_group(g).column(at).statistics for f in files for g in range(f.num_row_groups)]
        return sum(e.has_min_max and e.min <= value <= e.max for e in ends)

    for column, value in (("lang", "fr"), ("source", "src13"), ("n_chars", 390)):
        assert must_read(column, value) <= 0.7 * len(files)


def test_set_filters(spark):
    ids = spark.range(0, 5000, 7)
    full = bitmap(ids, 20)
    inside = in_bitmap(np.arange(0, 5000, dtype=np.int64), full, 20)
    assert inside[::7].all() and inside.mean() < 0.2
    from pyspark.sql import functions as F

    hits = with_hit(spark.range(5000), bit_table(ids.select(F.xxhash64("id").alias("id"))), F.xxhash64("id"))
    members = [r.id for r in hits.filter("_hit").collect()]
    assert set(range(0, 5000, 7)) <= set(members) and len(members) < 1000


def test_pipeline(spark):
    docs = queries.table(spark, SF, "documents")
    before, counts = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.stored(stage(spark, before, SF), name)
        if name != "sharding":
            assert after.columns == docs.columns
            assert after.exceptAll(before).count() == 0
        counts.append(after.count())
        before = after
    assert counts[0] > counts[1] > counts[2] > counts[3] > counts[4] == counts[5] > 0
    assert {r.shard for r in before.select("shard").distinct().collect()} == set(range(16))
    labels = {r.doc_id: r.quality for r in queries.table(spark, SF, "labels").collect()}
    assert all(labels.get(r.doc_id, 1) == 1 for r in before.collect())


def test_pipeline_of_nothing(spark):
    docs = queries.table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(spark, name):
    import check

    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert check.rows_of(got) == check.rows_of(want)


def test_one_query_for_each_operator_and_the_pipeline():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op"))
    assert numbers == list(range(1, 14)) and "pipeline" in queries.QUERIES
