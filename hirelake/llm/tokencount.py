"""Greedy longest-match token counts by a linear automaton: a vocabulary trie with failure links."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.llm.tokenizer import Pieces, WordCache, read_ranks, words_of


class LongestMatch:
    """Counts the tokens of greedy longest-match splits in one pass over a word, without the pieces.

    The trie holds the vocabulary; with a continuation mark (``##`` in some vocabularies) tokens that
    carry it match after a word's start only, and the others at the start only. fail[v] is where
    matching goes on after the longest tokens have been popped off the string of v, and popped[v] is
    how many those are; fail is -1 where no token starts the string of v.
    """

    def __init__(self, vocabulary: list[bytes], mark: bytes = b"") -> None:
        self.edges: dict[int, int] = {}
        kids: list[list[tuple[int, int]]] = [[]]
        token: list[bool] = [False]

        def walk(node: int, piece: bytes) -> int:
            for byte in piece:
                at = node << 8 | byte
                if at not in self.edges:
                    self.edges[at] = len(kids)
                    kids[node].append((byte, len(kids)))
                    kids.append([])
                    token.append(False)
                node = self.edges[at]
            return node

        self.inner = walk(0, mark)
        for piece in vocabulary:
            if piece and piece != mark:
                token[walk(0, piece)] = True
        self.fail, self.popped = [-1] * len(kids), [0] * len(kids)
        todo = deque([0] if not mark else [0, self.inner])
        edges, fail, popped = self.edges, self.fail, self.popped
        while todo:
            at = todo.popleft()
            for byte, kid in kids[at]:
                if kid == self.inner and mark:
                    continue
                if token[kid]:
                    fail[kid], popped[kid] = self.inner, 1
                else:
                    z, count = fail[at], popped[at]
                    while z != -1 and (z << 8 | byte) not in edges:
                        z, count = fail[z], count + popped[z]
                    if z != -1:
                        fail[kid], popped[kid] = edges[z << 8 | byte], count
                todo.append(kid)

    def count(self, word: bytes) -> int:
        """Tokens of the word; a word that the vocabulary can't spell is one unknown token."""
        edges, fail, popped = self.edges, self.fail, self.popped
        at = found = 0
        for byte in word:
            while (following := edges.get(at << 8 | byte)) is None:
                found += popped[at]
                at = fail[at]
                if at == -1:
                    return 1
            at = following
        while at != self.inner and at:
            if fail[at] == -1:
                return 1
            found += popped[at]
            at = fail[at]
        return found


class Counter:
    """Counts the words and tokens of texts."""

    def __init__(self, vocabulary: list[bytes], pattern: str, mark: bytes = b"") -> None:
        self.automaton, self.pieces = LongestMatch(vocabulary, mark), Pieces(pattern)
        self.words = WordCache(self._word)

    def _word(self, word: str) -> tuple[int, int]:
        matches = self.pieces(word)
        return len(matches), sum(map(self.automaton.count, matches))

    def __call__(self, text: str | None) -> tuple[int, int, int]:
        """(bytes, words, tokens)."""
        found = self.words.all(words_of(text)) if text else []
        return len((text or "").encode("utf-8", "surrogatepass")), sum([f[0] for f in found]), sum([f[1] for f in found])


def count_tokens(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_words, n_tokens) of every row of ``docs``.

    Words are the matches of the pattern; each is split greedily into the longest tokens of the
    vocabulary file. A null text counts as empty, with zeros. Texts are counted whole; a word's count is
    remembered, within a bound. Null ids and repeated rows stay; other columns are ignored.
    """
    counter = docs.sparkSession.sparkContext.broadcast(Counter(list(read_ranks(ranks_path)), pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = list(map(counter.value, batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([o[k] for o in out], pa.int64()) for k in range(3))], ["id", "n_bytes", "n_words", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, n_bytes long, n_words long, n_tokens long").withColumnRenamed("id", id_col)
