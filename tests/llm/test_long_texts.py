"""Near copies with more shingles than a byte counts in each part of a sketch."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from tidemark.llm import ngram_jaccard
from tidemark.llm._words import text_chunks


@pytest.mark.parametrize("n, similarity", [(4, (85, 100)), (5, (80, 100))])
def test_near_copies_of_many_shingles_link(spark, n, similarity):
    words = [f"v{i}" for i in range(82_000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, "more"])), (3, " ".join(f"u{i}" for i in range(82_000)))]
    got = ngram_jaccard.ngram_jaccard(spark.createDataFrame(rows, "doc_id long, text string"), n, similarity).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(1, 1), (2, 1), (3, 3)}


def test_sketches_bound_every_overlap():
    sizes = [50_000, 56_000, 80_000, 80_001]
    texts = pa.array([" ".join(f"v{i}" for i in range(k + 3)) for k in sizes])
    sketch, grams = [], []
    for _, _, data, offsets in text_chunks(texts):
        hashes, counts = ngram_jaccard.incidence(data, offsets, 4)
        sketch += ngram_jaccard.sketches(hashes, counts).to_pylist()
        grams += np.split(hashes, np.cumsum(counts)[:-1])
    assert [len(x) for x in grams] == sizes and len({len(x) for x in sketch}) == 2
    counts = ngram_jaccard.counts_of(pd.Series(sketch)).astype(np.int64)
    for a in range(4):
        for b in range(a):
            assert np.minimum(counts[a], counts[b]).sum() >= len(np.intersect1d(grams[a], grams[b]))
    block = pd.DataFrame({"own": 0, "i": 0, "j": 0, "n": sizes, "c": range(4), "component": range(4), "sketch": sketch})
    assert set(zip(*map(np.ndarray.tolist, ngram_jaccard.candidates(block, 85, 100)), strict=True)) == {(0, 1), (2, 3)}
