"""Token ids of whole texts with the ``tokenizers`` library, and what both token operators share.

A text is cut where no pre-token can reach across: at single spaces and newlines between
characters that are not white space. The pieces repeat a great deal, so each worker keeps their
ids. A new piece of letters, or of letters and one mark, is one or two pre-tokens and goes to the
library's BPE model as such; any other piece goes through the whole tokenizer, and a text with
other white space next to a cut, or one that holds an added token's string, is encoded whole. The result equals encoding each text whole.
"""

from __future__ import annotations

import os
from array import array
from functools import lru_cache

#: Pieces of a generation; a worker keeps the current one and the one before, so that frequent pieces stay (it affects speed and memory only).
CACHE = 400_000
MARKS = frozenset(".,;:!?")


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Pieces(dict):
    """Piece to little-endian unsigned 32-bit ids, filled on demand; None: the text must be encoded whole."""

    def __init__(self, tokenizer, spaced: bool, head: bool, cache: int):
        super().__init__()
        self.tokenizer, self.spaced, self.head, self.cache = tokenizer, spaced, head, cache
        self.before: dict[str, bytes | None] = {}
        self.tokenize = tokenizer.model.tokenize
        self.letters = str.maketrans({b: c for b, c in enumerate(byte_letters())})

    def _ids(self, pretoken: str) -> array:
        shown = pretoken if pretoken.isascii() and " " not in pretoken else pretoken.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.tokenize(shown)])

    def __missing__(self, piece: str) -> bytes | None:
        if len(self) >= self.cache:
            self.before = dict(self)
            self.clear()
        ids = self[piece] = self.before[piece] if piece in self.before else self._of(piece)
        return ids

    def _of(self, piece: str) -> bytes | None:
        if self.spaced:
            if self.head and not piece:
                return b""
            body = piece[1:] if piece[:1] == "\n" and not self.head else piece
            if not body or body[0].isspace() or body[-1].isspace():
                return None
            whole = piece if self.head or body is not piece else " " + piece
            word = whole if body is piece else ""
        else:
            whole, word = piece, piece.lower() if piece.isascii() else self.tokenizer.normalizer.normalize_str(piece)
            if not word:
                return b""
        letters = word[1:] if self.spaced and word[:1] == " " else word
        if letters.isalpha():
            return self._ids(word).tobytes()
        if letters[-1:] in MARKS and letters[:-1].isalpha():
            return (self._ids(word[:-1]) + self._ids(word[-1])).tobytes()
        return array("I", self.tokenizer.encode(whole, add_special_tokens=False).ids).tobytes()


class Encoder:
    """Texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str, spaced: bool, cache: int = CACHE):
        """spaced: the tokenizer keeps white space, so a piece carries the space before it."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.spaced = spaced
        self.pieces = Pieces(self.tokenizer, spaced, False, cache)
        self.heads = Pieces(self.tokenizer, spaced, True, cache)

    @property
    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size()

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        if any(token in text for token in self.added):
            return self._whole(text)
        if not self.spaced:
            return b"".join(map(self.pieces.__getitem__, text.replace("\n", " ").split(" ")))
        parts = text.replace("\n", " \n").split(" ")
        head = self.heads[parts[0]]
        try:
            return b"".join([head, *map(self.pieces.__getitem__, parts[1:])])
        except TypeError:
            return self._whole(text)


@lru_cache(maxsize=2)
def encoder(path: str, spaced: bool, cache: int = CACHE) -> Encoder:
    """The worker's encoder, loaded once and kept between tasks."""
    return Encoder(path, spaced, cache)
