"""Token ids of a public byte-level BPE vocabulary, read from a file that the caller names."""

from __future__ import annotations

import base64
import functools
import re
import sys
from array import array

import numpy as np

#: Words whose ids a worker remembers.
REMEMBERED = 100_000
#: Characters after which the words looked up are weighed: if one in FEW was unknown, SPARED times as many characters are
#: encoded without a look at their words, which costs less than looking unknown ones up.
TRIED, FEW, SPARED = 1 << 16, 8, 32


class _OtherSpace(Exception):
    """A space is followed by more white space, or by nothing."""


class _WordIds(dict):
    """The ids of a word behind ``before``, as little-endian unsigned 32-bit bytes.

    Of REMEMBERED words half are the latest; when these are full the older half goes, so that frequent words stay.
    """

    def __init__(self, encode, before: str):
        super().__init__()
        self.encode, self.before, self.older, self.unknown = encode, before, {}, 0

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            if self.before and (not word or word[0].isspace()):
                raise _OtherSpace
            self.unknown += 1
            ids = _little_endian(self.encode(self.before + word))
            if len(word) >= 64:
                return ids
        if len(self) >= REMEMBERED // 2:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids


def _little_endian(ids: list[int]) -> bytes:
    found = array("I", ids)
    if sys.byteorder == "big":
        found.byteswap()
    return found.tobytes()


class Encoder:
    """Encodes texts word by word, or as a whole where many words are new. ``added`` are tokens that stand for themselves: a text
    is cut at them first.

    The vocabulary's pattern starts a new piece before a single space that stands before a word, so
    the text can be cut there, and a word's ids do not depend on its neighbours. A text in which
    a space is followed by more white space is encoded as a whole.
    """

    def __init__(self, ranks_path: str, pattern: str, added: tuple[tuple[str, int], ...] = ()):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.words, self.spaced = (_WordIds(self.encoding.encode_ordinary, before) for before in ("", " "))
        self.tried = self.looked_up = self.spared = 0
        self.added = {token: np.array([number], dtype="<u4").tobytes() for token, number in added}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.cut = re.compile(f"({'|'.join(map(re.escape, longest_first))})").split if added else None
        self.sentence_end = np.zeros(max(ranks.values()) + 1, dtype=bool)
        for token, rank in ranks.items():
            self.sentence_end[rank] = token[-1:] in b".!?\n"

    def __call__(self, text: str) -> bytes:
        if not any(token in text for token in self.added):
            return self._ordinary(text)
        # every second part is an added token
        return b"".join(self.added[part] if i % 2 else self._ordinary(part) for i, part in enumerate(self.cut(text)))

    def _ordinary(self, text: str) -> bytes:
        if self.spared > 0:
            self.spared -= len(text)
            return _little_endian(self.encoding.encode_ordinary(text))
        if self.tried >= TRIED:
            few_known = self.spaced.unknown * FEW > self.looked_up
            self.tried = self.looked_up = self.spaced.unknown = 0
            if few_known:
                self.spared = SPARED * TRIED
                return self._ordinary(text)
        first, *rest = text.split(" ")
        self.tried, self.looked_up = self.tried + len(text), self.looked_up + len(rest)
        try:
            return b"".join([self.words[first] if first else b"", *map(self.spaced.__getitem__, rest)])
        except _OtherSpace:
            return _little_endian(self.encoding.encode_ordinary(text))


@functools.cache
def encoder(ranks_path: str, pattern: str, added: tuple[tuple[str, int], ...] = ()) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    return Encoder(ranks_path, pattern, added)
