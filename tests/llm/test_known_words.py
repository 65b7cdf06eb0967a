"""A word is looked at once: what is known, alone or before punctuation, is not judged again."""

import pyarrow as pa

from tidemark.llm import _tokens


def test_known_words_are_not_judged_again(monkeypatch):
    coder = _tokens.Encoder(_tokens.vocabulary_path("word_bpe_49k.json"))
    texts = ["The straße, the ñandú... and X1, don't. ok,. , .", "été, 12, a.b. 日本. the", None, ""]
    want = [coder.full.encode(t or "", add_special_tokens=False).ids for t in texts]
    judged = []
    monkeypatch.setattr(coder, "_plain", lambda w, f=coder._plain: judged.append(w) or f(w))
    for again in (False, True):
        judged.clear()
        ids, sizes = coder.encode(pa.array(texts, pa.string()))
        assert ids.tolist() == [i for w in want for i in w] and sizes.tolist() == [len(w) for w in want]
    assert "ñandú" not in judged and "straße" not in judged
