"""Pairs of terms counted in a table give the sketch that projecting every passage gives."""

from __future__ import annotations

import numpy as np
import pytest

from fieldloom.llm import decontaminate as D


def passages(seed: int, terms: int, sizes: list[int]):
    rng = np.random.default_rng(seed)
    term = rng.integers(0, terms, sum(sizes)).astype(np.int32)
    return term, np.repeat(np.arange(len(sizes)), sizes), len(sizes)


@pytest.mark.parametrize("terms", [1, 3, 40, 700])
def test_pairs_give_the_product(terms):
    sizes = [32, 0, 1, 2, 31, 32, 32, 0, 7]
    term, passage, n = passages(terms, terms, sizes)
    counts = np.zeros((n, terms))
    np.add.at(counts, (passage, term), 1)
    test = np.random.default_rng(1).normal(size=(terms, 5)).astype(np.float32)
    pairs, got, by_passage = D.Pairs(terms), np.zeros((terms, 5)), np.zeros((terms, 5))
    for _ in range(2):
        pairs.add(term, passage)
    pairs.multiply(got, test)
    pairs.add(term, passage)
    pairs.multiply(got, test)
    D._gram(by_passage, test, term, passage, n)
    assert np.allclose(got, 3 * counts.T @ counts @ test, rtol=1e-5, atol=1e-4)
    assert np.allclose(got, 3 * by_passage, rtol=1e-5, atol=1e-4)
    assert not pairs.table.any() and not pairs.single.any() and pairs.places == 0


@pytest.mark.parametrize("limits", [{"_PAIRED": 0}, {}])
def test_the_sketch_covers_all_documents(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(D, name, value)
    texts = [" ".join(f"w{(i * j) % 11}" for j in range(i % 90)) for i in range(120)] + [None, ""]
    docs = spark.createDataFrame([(t,) for t in texts], "_text string").repartition(5)
    vocabulary = D.Vocabulary.of(D.words_of(D.pd.Series([" ".join(f"w{k}" for k in range(9))])).hashes)
    omega = np.random.default_rng(2).normal(size=(9, 4))
    want = np.zeros((9, 4))
    for text in texts:
        found = vocabulary.index(D.words_of(D.pd.Series([text])).hashes)
        for k in range(0, len(found), 32):
            row = np.bincount(found[k : k + 32], minlength=10)[:9].astype(float)
            want += np.outer(row, row @ omega)
    assert np.allclose(D._sketch(docs, vocabulary, omega), want, rtol=1e-4, atol=1e-3)
