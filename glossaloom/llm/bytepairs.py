"""Byte-level BPE ids of texts through a table of distinct words.

The pre-tokenizer of byte-level models never joins a word to the space that follows it, so a text may be cut before every
single space that stands between two other characters, and the ids of the cuts are joined by position.
"""

from __future__ import annotations

import re
import struct

import numpy as np

from glossaloom.llm.batches import WordTable

#: White space other than the space.
_BLANKS = [chr(c) for c in range(0x110000) if chr(c).isspace() and c != 32]
#: A space between two letters or digits is always a safe cut.
_SAFE_CUT = re.compile(r"(?<=[^\W_]) (?=[^\W_])")
#: New words put through the library in one string.
_TOGETHER = 2000
_CODECS: dict[tuple[int, bool], "BytePairCodec"] = {}


def cuts(text: str) -> list[str]:
    """The parts of a text; every part but the first had a space before it.

    Where a space stands beside white space or at an end of the text, the text is cut between letters and digits only.
    """
    beside = text[:1] == " " or text[-1:] == " " or "  " in text or any(b in text and (b + " " in text or " " + b in text) for b in _BLANKS)
    return _SAFE_CUT.split(text) if beside else text.split(" ")


class BytePairCodec:
    """A tokenizers file (JSON text) in one Python worker; ids are packed in the narrowest unsigned integers.

    With ``plain_specials`` the strings of special tokens are text like any other, else they are their tokens.
    """

    def __init__(self, spec: bytes, plain_specials: bool = True):
        from tokenizers import Tokenizer, pre_tokenizers

        self.lib = Tokenizer.from_str(spec.decode())
        self.lib.encode_special_tokens = plain_specials
        self.vocabulary = self.lib.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.vocabulary <= 1 << 16 else "<u4")
        by_words = (
            isinstance(self.lib.pre_tokenizer, pre_tokenizers.ByteLevel) and self.lib.normalizer is None
            and not self.lib.pre_tokenizer.add_prefix_space and self.lib.pre_tokenizer.use_regex
        )
        added = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        #: texts that hold one of these go through the library as a whole
        self.added = [] if plain_specials else added
        if not plain_specials:
            by_words = by_words and not any(" " in a for a in added)
            self.whole = Tokenizer.from_str(spec.decode())
            self.lib.encode_special_tokens = by_words
        names = self.lib.get_vocab()
        self.spaced = np.zeros(max(names.values(), default=0) + 1, bool)
        self.spaced[[i for name, i in names.items() if name.startswith("Ġ")]] = True
        self.stops = {s: self._packed(self._ids(s)) for s in ".,"}
        self.first, self.later = (WordTable(self._first), WordTable(self._later)) if by_words else (None, None)

    def _packed(self, ids: list[int]) -> bytes:
        return np.asarray(ids, self.dtype).tobytes()

    def _first(self, words: list[str]) -> list[bytes]:
        return [self._packed(e.ids) for e in self.lib.encode_batch_fast(words, add_special_tokens=False)]

    def _later(self, words: list[str]) -> list[bytes]:
        """Ids of words with a space before them.

        A word of ASCII letters is one pre-token, and a full stop or comma behind it another: they go straight to the
        library's merges.  Others without spaces go through the whole library many at a time.
        """
        made: dict[str, bytes] = {}
        merges, code = self.lib.model.tokenize, "H" if self.dtype.itemsize == 2 else "I"
        pack = lambda *ids: struct.pack(f"<{len(ids)}{code}", *ids)
        for w in words:
            stop = self.stops.get(w[-1:], b"")
            letters = w[:-1] if stop else w
            if letters.isalpha() and letters.isascii():
                made[w] = pack(*[t.id for t in merges("Ġ" + letters)]) + stop
        simple = [w for w in words if w and w not in made and " " not in w and not w[0].isspace() and not w[-1].isspace()]
        for at in range(0, len(simple), _TOGETHER):
            part = simple[at : at + _TOGETHER]
            ids = np.asarray(self._ids(" " + " ".join(part)), self.dtype)
            starts = np.flatnonzero(self.spaced[ids])
            if len(starts) == len(part):
                packed, ends = ids.tobytes(), [*starts[1:].tolist(), len(ids)]
                size = self.dtype.itemsize
                made |= {w: packed[a * size : b * size] for w, a, b in zip(part, starts.tolist(), ends)}
        rest = [w for w in words if w not in made]
        return [made[w] for w in words] if not rest else self._mixed(words, made, rest)

    def _mixed(self, words: list[str], made: dict[str, bytes], rest: list[str]) -> list[bytes]:
        made |= dict(zip(rest, self._first([" " + w for w in rest])))
        return [made[w] for w in words]

    def _ids(self, text: str) -> list[int]:
        return self.lib.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each whole text, equal to the library's."""
        if self.first is None:
            return self._first(texts)
        held = [i for i, t in enumerate(texts) if any(a in t for a in self.added)]
        if held:
            made = self._by_words(["" if any(a in t for a in self.added) else t for t in texts])
            for i, e in zip(held, self.whole.encode_batch_fast([texts[i] for i in held], add_special_tokens=False)):
                made[i] = self._packed(e.ids)
            return made
        return self._by_words(texts)

    def _by_words(self, texts: list[str]) -> list[bytes]:
        words = [cuts(t) for t in texts]
        heads, tails = [w[:1] for w in words], [w[1:] for w in words]
        first, later = self.first.covering(heads), self.later.covering(tails).__getitem__
        return [first[h[0]] + b"".join(map(later, t)) for h, t in zip(heads, tails)]


def codec(spec: bytes, plain_specials: bool = True) -> BytePairCodec:
    """The codec of this worker for a tokenizer file."""
    key = (hash(spec), plain_specials)
    if key not in _CODECS:
        _CODECS[key] = BytePairCodec(spec, plain_specials)
    return _CODECS[key]
