"""Counts of columns in bounded memory."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import jaccard


@pytest.mark.parametrize("limit", [1 << 21, 64])
def test_repeated_columns(limit):
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(list("abc"), int(rng.integers(0, 60)))) for _ in range(300)] + [None, "", "a b c d e", "a b c d e"]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[i : i + 70], pa.string())], ["text"]) for i in range(0, len(texts), 70)]
    got = Counter()
    for part in jaccard.repeated_columns(batches, limit):
        assert min(part.column(1).to_pylist(), default=2) > 1
        for token, n in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            got[token] += n
    sets = {s.tobytes(): s for s in jaccard.shingle_sets(texts) if len(s)}
    want = Counter(x for s in sets.values() for x in s.view(np.int64).tolist())
    if limit > 64:
        assert got == Counter({k: n for k, n in want.items() if n > 1})
    assert all(n <= len(texts) for n in got.values()) and set(got) <= set(want)
