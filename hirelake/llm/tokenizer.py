"""Vocabulary files, and splitting of texts into the pieces of a pattern with a cache of frequent words."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable

import regex

#: Words in each of a cache's two generations.
GENERATION = 500_000
_SPACE_BEFORE_WORD = re.compile(r" (?=\S)")
_SPACE_RUN = re.compile(r" (?:\s|$)")


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a rank file: on each line a base64 token and its number."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class WordCache:
    """Remembers what ``make`` gives for a word in two generations, of which the older is forgotten."""

    def __init__(self, make: Callable, size: int = GENERATION) -> None:
        self.make, self.size = make, size
        self.young: dict[str | bytes, object] = {}
        self.old: dict[str | bytes, object] = {}

    def __call__(self, word: str | bytes):
        value = self.old.get(word)
        if value is None:
            value = self.make(word)
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        if len(word) <= 256:
            self.young[word] = value
        return value

    def all(self, words: list) -> list:
        found = list(map(self.young.get, words))
        if None in found:
            young = self.young
            for i, value in enumerate(found):
                if value is None:
                    value = young.get(words[i])
                    found[i] = self(words[i]) if value is None else value
                    young = self.young
        return found


def words_of(text: str) -> list[str]:
    """Cuts a text before each space that another character than a space follows.

    No match of a pattern whose space can only lead a match or belong to a run of spaces crosses such
    a cut, so the words can be split on their own.
    """
    parts = _SPACE_BEFORE_WORD.split(text) if _SPACE_RUN.search(text) else text.split(" ")
    first, *rest = parts
    return [first, *[" " + p for p in rest]] if first else [" " + p for p in rest]


class Pieces:
    """Gives the UTF-8 bytes of each match of a pattern in a word."""

    def __init__(self, pattern: str) -> None:
        self.found = regex.compile(pattern)

    def __call__(self, word: str) -> list[bytes]:
        return [m.encode("utf-8", "surrogatepass") for m in self.found.findall(word)]
