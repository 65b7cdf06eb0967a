"""Token ids of whole Arrow batches of texts by the tokenizers library."""

from __future__ import annotations

import os
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ._words import ragged

#: Bytes of the words and ids, with their objects, that a worker remembers before it starts anew.
REMEMBERED = 64 << 20
#: Characters tokenized at once.
CHARACTERS = 1 << 21
#: Two texts whose ids must be those of their parts, for a tokenizer that drops white space.
PROBES = ("It's 12 o'clock, déjà-vu... x1", "'s don'té́ !?", "a", "...")

#: By last byte, or last two: ASCII letters and digits, and the Latin letters of two bytes that stay one letter in lower case (İ doesn't).
_ENDS, _ENDS_OF_TWO = np.zeros(1 << 8, bool), np.zeros(1 << 16, bool)
_ENDS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_ENDS_OF_TWO[[int.from_bytes(chr(c).encode()) for c in range(0xC0, 0x240) if chr(c).lower().isalpha()]] = True

_OPEN: dict[str, Encoder] = {}


def strings(words: pa.Array) -> list[str]:
    """to_pylist() without a scalar object for each string."""
    return words.to_numpy(zero_copy_only=False).tolist()


class Encoder:
    """Ids as encode(text, add_special_tokens=False) gives them. Where white space only separates (checked on PROBES), each distinct word is tokenized once."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        #: Ids of the words met lately, and of those met before them; when the first are many, they take the place of the second.
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.remembered = 0
        ids = lambda s: self.full.encode(s, add_special_tokens=False).ids
        self.by_words = all(ids(f" {a} \n\t{b}  ") == ids(a) + ids(b) for a in PROBES for b in PROBES)
        self.lowers = self.by_words and ids("ABC'S É") == ids("abc's é")
        #: Whether a word of lower-case Latin letters is one piece for the model, with bytes written as the printable characters of byte-level BPE.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(printable)]
        self.bytes = {b: b for b in printable} | {b: 256 + i for i, b in enumerate(hidden)}
        self.direct = self.lowers and all([t.id for t in self.full.model.tokenize(self._shown(w))] == ids(w) for w in ("the", "déjà", "xqzthou", "straße", "ñandú"))
        self.stops = [array("I", ids(x)).tobytes() for x in ".,"]

    def _shown(self, word: str) -> str:
        return word if word.isascii() else word.encode().decode("latin-1").translate(self.bytes)

    def _plain(self, word: str) -> bool:
        low = word if word.islower() else word.lower()
        return low.isalpha() and low.islower() and (word.isascii() or (max(low) < "ɐ" and unicodedata.is_normalized("NFC", word)))

    def _word(self, word: str) -> bytes:
        """The ids of a word that isn't known yet."""
        if self.direct and self._plain(word):
            ids = [t.id for t in self.full.model.tokenize(self._shown(word.lower()))]
        else:
            ids = self.full.encode(word, add_special_tokens=False).ids
        ids = self.known[word] = array("I", ids).tobytes()
        self.remembered += 200 + len(word) + len(ids)
        return ids

    def _again(self, word: str) -> bytes | None:
        """The ids of a word that was last met before the words of now, and counts as one of them from here on."""
        ids = self.before.pop(word, None)
        if ids is not None:
            self.known[word] = ids
            self.remembered += 200 + len(word) + len(ids)
        return ids

    def _words(self, words: list[str]) -> list[bytes]:
        if self.remembered > REMEMBERED // 2:
            self.before, self.known, self.remembered = self.known, {}, 0
        known, again, word = self.known.get, self._again, self._word
        return [known(w) or again(w) or word(w) for w in words]

    def _each(self, words: pa.Array) -> pa.Array:
        """The ids of each of some words, as bytes. One full stop or comma after a Latin letter or a digit is a piece of its own, so it is cut off before the word is looked up."""
        if not self.direct or not pc.any(pc.not_equal(words, "")).as_py():
            return pa.array(self._words(strings(words)), pa.binary())
        data = np.frombuffer(words.buffers()[2], np.uint8)
        at = np.cumsum(pc.binary_length(words).to_numpy().astype(np.int64))
        last, one, two = (data[np.maximum(at - i, 0)] for i in (1, 2, 3))
        letter = _ENDS[one] | _ENDS_OF_TWO[two.astype(np.int64) << 8 | one]
        size = np.diff(at, prepend=0)
        end = np.where((size > 1) & letter, (last == 46) + 2 * (last == 44), 0)
        coded = pc.if_else(pa.array(end > 0), pc.ascii_rtrim(words, ".,"), words).dictionary_encode()
        stems = pa.array(self._words(strings(coded.dictionary)), pa.binary()).take(coded.indices)
        return pc.binary_join_element_wise(stems, pa.array([b"", *self.stops]).take(pa.array(end)), b"")

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, ids of each text). Null counts as empty."""
        texts = texts.fill_null("") if texts.null_count else texts
        if not self.by_words:
            ids = [np.array(x.ids, np.uint32) for x in self.full.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.uint32), *ids]), np.array([len(x) for x in ids], np.int64)
        if self.lowers and not pc.any(pc.match_substring(texts, "<|")).as_py():  # special tokens are matched before case is folded
            texts = pc.ascii_lower(texts)
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        each = self._each(coded.dictionary)
        flat = np.frombuffer(each.buffers()[2] or b"", np.uint32)
        lengths = pc.binary_length(each).to_numpy().astype(np.int64) // 4
        word = coded.indices.to_numpy()
        of_word = lengths[word]
        ids = flat[ragged((np.cumsum(lengths) - lengths)[word], of_word)]
        ends = np.concatenate([[0], np.cumsum(of_word)])
        return ids, np.diff(ends[np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])])


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file; Python workers live on between tasks."""
    if path not in _OPEN:
        _OPEN[path] = Encoder(path)
    return _OPEN[path]


def slices(texts: pa.Array):
    """(first row, end row) of about CHARACTERS each."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHARACTERS, "right")))
        yield at, end
        at = end


def vocabulary_path(name: str) -> str:
    """A file of the public tokenizers package."""
    import public_tokenizers

    return public_tokenizers.path(name)
