"""Words that keep coming stay known when others are forgotten, and few words need the whole tokenizer."""

import pyarrow as pa

from tidemark.llm import _tokens


class Counted:
    """A tokenizer that notes what it encodes."""

    def __init__(self, full):
        self.full, self.model, self.seen = full, full.model, []

    def encode(self, text, **how):
        self.seen.append(text)
        return self.full.encode(text, **how)


def whole(coder, texts):
    return [i for t in texts for i in coder.full.encode(t, add_special_tokens=False).ids]


def test_words_that_keep_coming_stay_known(monkeypatch):
    coder = _tokens.Encoder(_tokens.vocabulary_path("word_bpe_49k.json"))
    monkeypatch.setattr(_tokens, "REMEMBERED", 4_000)
    judged = []
    monkeypatch.setattr(coder, "_word", lambda w, f=coder._word: judged.append(w) or f(w))
    for i in range(40):
        texts = ["common " + " ".join(chr(97 + i % 26) * j + "b" * (i // 26) for j in range(1, 8))]
        assert coder.encode(pa.array(texts))[0].tolist() == whole(coder, texts)
        assert len(coder.known) + len(coder.before) < 40
    assert judged.count("common") == 1


def test_capitals_and_stops_need_no_whole_tokenizer():
    coder = _tokens.Encoder(_tokens.vocabulary_path("word_bpe_49k.json"))
    texts = ["Äie Über. Été, x1, 12. Ñandú", "×. ÷, ². é. É İ. ẞ. ǅa, ɐ. Ωσ. 日. a.. .a. ., . x.,", "don't. it's, (a). K. Å, ŉ. ª. ɏ.", "", " Ä. b,"]
    want = whole(coder, texts)
    coder.full = Counted(coder.full)
    assert coder.encode(pa.array(texts))[0].tolist() == want
    assert not {"Äie", "Über", "Über.", "Été", "Été,", "Ñandú", "x1,", "12."} & set(coder.full.seen)


def test_batches_without_words():
    coder = _tokens.Encoder(_tokens.vocabulary_path("word_bpe_49k.json"))
    for texts in ([], [""], [" "], [None, " \n"], [" a "], ["."], [",", " "]):
        for kind in (pa.string(), pa.large_string()):
            ids, sizes = coder.encode(pa.array(texts, kind))
            assert ids.tolist() == whole(coder, [t or "" for t in texts]) and len(sizes) == len(texts) and sizes.sum() == len(ids)
