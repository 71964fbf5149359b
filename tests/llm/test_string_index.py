"""The index of strings in a bin: the least owner of equal strings, within bounded memory."""

from __future__ import annotations

import tracemalloc

import numpy as np

from fieldloom.llm.suffix_dedup import least_owner


def test_least_owner_needs_few_bytes_a_string():
    rng = np.random.default_rng(0)
    sources = rng.integers(97, 101, (400, 80)).astype(np.uint8)
    sizes = rng.integers(50, 81, 3000)
    pieces = [sources[s][:z] for s, z in zip(rng.integers(0, 400, len(sizes)), sizes, strict=True)]
    data, offset, owner = np.concatenate(pieces), np.cumsum(sizes) - sizes, rng.permutation(len(sizes))
    least_owner(data[: sizes[0]], offset[:1], sizes[:1], owner[:1], 50)
    tracemalloc.start()
    got = least_owner(data, offset, sizes, owner, 50)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    first: dict[bytes, int] = {}
    strings = [(p[k : k + 50].tobytes(), int(o)) for p, o in zip(pieces, owner, strict=True) for k in range(len(p) - 49)]
    for text, o in strings:
        first[text] = min(o, first.get(text, o))
    assert got.tolist() == [first[text] for text, _ in strings]
    assert peak < 60 * len(strings)
