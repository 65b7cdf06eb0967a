"""Toxic words count wherever they stand, but mere repetition of one is no passage."""

import numpy as np
import pyarrow as pa

from tidemark.llm import toxicity
from tidemark.llm._words import word_hashes


def lexicon(*words):
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    hashes = np.sort(word_hashes(data, np.array([0, len(data)]), lower=True, letters=True)[0])
    return hashes, np.full(len(hashes), 4.0)


def segments_of(text, *words):
    ((_, _, found),) = toxicity.scan(pa.array([text]), *lexicon(*words))
    return found[0]


def test_passages_of_the_same_words_are_all_found():
    bad, calm = "awful vile nasty rotten", "calm " * 300
    assert segments_of(f"{calm}{bad} {calm}{bad} {calm}", *bad.split()) == [(300, 304, 16.0), (604, 608, 16.0)]
    mentions = " ".join(f"{w} {calm}" for w in bad.split())
    assert segments_of(mentions + bad, *bad.split())[-1][2] == 16.0


def test_repeating_one_word_is_no_passage():
    assert max(s for _, _, s in segments_of("vile " * 1000, "vile")) == 4.0
    assert max(s for _, _, s in segments_of("vile calm calm calm " * 300, "vile")) == 4.0
