"""Byte-level BPE ids of whole texts by the tokenizers library, with a cache of words.

A text is cut at single spaces. Where every piece ends in a character other than white
space, the ids of a piece with the space before it depend on nothing else, so they can be
kept and reused; other texts, and those that spell the special token, go to the library whole.
"""

from __future__ import annotations

import struct

import regex
from tokenizers import Tokenizer

#: Words kept per Python worker; the cache starts anew when it is full.
MAX_WORDS = 700_000
_PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: ASCII that is neither letter, digit nor white space.
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
_by_path: dict[str, "Encoder"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str) -> "Encoder":
    """The worker's encoder for a vocabulary file."""
    if path not in _by_path:
        _by_path[path] = Encoder(path)
    return _by_path[path]


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins of the 256 bytes in byte-level vocabularies, for str.translate."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder(dict):
    """Maps a piece to the ids of a space and that piece, as little-endian 16- or 32-bit bytes; None where the next piece matters.

    Two generations of pieces are kept, so that a full cache forgets only what was not asked for lately.
    """

    def __init__(self, path: str, max_words: int = MAX_WORDS):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.width = 2 if self.size <= 1 << 16 else 4
        self.max_words, self.old, self.parts, self.old_parts = max_words, {}, {}, {}
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = _byte_letters()
        self.space = self.letters[32]
        self.bytes = [i.to_bytes(self.width, "little") for i in range(self.size)]
        self.model = self.tokenizer.model

    def _bytes(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.width == 2 else 'I'}", *ids)

    def _model(self, pretoken: str) -> bytes:
        of = self.bytes
        return b"".join([of[t.id] for t in self.model.tokenize(pretoken.encode("utf-8").decode("latin-1").translate(self.letters))])

    def _part(self, pretoken: str) -> bytes:
        if (got := self.parts.get(pretoken)) is None:
            if (got := self.old_parts.get(pretoken)) is None:
                got = self._model(pretoken)
            if len(self.parts) >= self.max_words // 2:
                self.old_parts, self.parts = self.parts, {}
            self.parts[pretoken] = got
        return got

    def _piece(self, piece: str) -> bytes | None:
        if not piece or piece[-1].isspace():
            return None
        return b"".join(map(self._part, _PRETOKEN.findall(piece)))

    def __missing__(self, word: str) -> bytes | None:
        if word.isalpha():
            if (got := self.old.get(word)) is None:
                if word.isascii():  # such letters stand for themselves
                    of = self.bytes
                    got = b"".join([of[t.id] for t in self.model.tokenize(self.space + word)])
                else:
                    got = self._model(" " + word)
            if len(word) < 64:
                self[word] = got
            return got
        core = word.rstrip(_MARKS)
        if core.isalpha():  # letters, then marks: two pretokens
            if (got := self.get(core)) is None:
                return self[core] + self._part(word[len(core) :])
            got += self._part(word[len(core) :])  # kept only if the letters were seen before
        elif not word:
            got = None
        elif (got := self.old.get(word, 0)) == 0:
            got = self._piece(" " + word)
        if len(word) < 64:
            self[word] = got
        return got

    def whole(self, text: str) -> bytes:
        return self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        """The ids of `text`, `width` bytes each; what tokenizers' encode gives without special tokens added."""
        if not text:
            return b""
        if any(s in text for s in self.specials):
            return self.whole(text)
        if len(self) >= self.max_words // 2:
            self.old = dict(self)
            self.clear()
        pieces = iter(text.split(" "))
        try:
            return self._piece(next(pieces)) + b"".join(map(self.__getitem__, pieces))
        except TypeError:  # a None: white space meets white space
            return self.whole(text)
