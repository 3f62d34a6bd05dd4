"""Cutting text at places where a byte-level pre-tokenizer always cuts.

The public pattern never matches across the change from a non-space character to white space,
and what it finds after such a place depends on the following text alone. So a text can be cut
before each single space, and the encoding of a cut ("piece") remembered: the same piece
has the same ids wherever it stands. Runs of white space are one match that ends before the last
character, so a text that holds a space with white space on both sides (or at its very end,
after white space) is not cut but encoded as one piece.
"""

from __future__ import annotations

import re
from collections.abc import Callable

_RUN = re.compile(r"\s \s|\s \Z")


def cut(text: str) -> list[str]:
    """Pieces whose concatenation is ``text`` and that the pre-tokenizer treats on their own."""
    if _RUN.search(text):
        return [text]
    head, *rest = text.split(" ")
    return [head, *[" " + piece for piece in rest]]


class _Young(dict):
    """Pieces to their values; a piece that it lacks is taken from the elder pieces, or noted as new with a value to be filled."""

    def __init__(self, elder: dict, new: list[tuple[str, list]]):
        self.elder, self.new = elder, new

    def __missing__(self, piece: str) -> list:
        value = self.elder.get(piece)
        if value is None:
            value = []
            self.new.append((piece, value))
        self[piece] = value
        return value


class PieceMemory:
    """Remembers what ``encode`` gives for a piece of at most 64 characters.

    Two generations of at most ``limit`` pieces (and one call's) each: what the younger lacks is looked for in the
    elder and moves up; a full younger generation becomes the elder.
    """

    def __init__(self, encode: Callable[[list[str]], list[tuple]], limit: int = 350_000):
        self.encode, self.limit, self.new = encode, limit, []
        self.young = _Young({}, self.new)

    def __call__(self, texts: list[str]) -> list[list]:
        """For each text the values of its pieces, in order."""
        if len(self.young) > self.limit:
            self.young.elder = {}
            self.young = _Young(dict(self.young), self.new)
        get = self.young.__getitem__
        found = [list(map(get, cut(t))) for t in texts]
        if self.new:
            pieces = [p for p, _ in self.new]
            try:
                for (_, value), got in zip(self.new, self.encode(pieces)):
                    value.extend(got)
            except BaseException:
                self.young = _Young({}, self.new)  # values that were not filled must not stay
                raise
            finally:
                self.new.clear()
            for p in pieces:
                if len(p) > 64:
                    del self.young[p]
        return found
