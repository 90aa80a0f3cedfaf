"""Byte-level BPE encoding and decoding with a segment tree over byte positions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.llm.tokenizer import Pieces, WordCache, read_ranks, words_of

NONE = 1 << 60


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The token ids of one match: the adjacent pair of least rank, the leftmost of equals, merges first.

    Leaf i of the tree holds the rank of the pair that starts at byte i, shifted to make room for i, so
    that the root is the leftmost minimum. A merge changes three leaves: the pair that goes, the pair
    of the merged token with the next live token, and the pair of the previous live token with it.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n == 1:
        raise ValueError(f"the vocabulary lacks the byte {piece!r}")
    bits = (n - 2).bit_length()
    size = 1 << bits
    get = ranks.get
    tree = [NONE] * (2 * size)
    for i, k in enumerate(range(size, size + n - 1)):
        rank = get(piece[i : i + 2])
        if rank is not None:
            tree[k] = rank << bits | i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n))
    low = size - 1

    def put(k: int, value: int) -> None:
        k += size
        while tree[k] != value:
            tree[k] = value
            if k == 1:
                return
            other = tree[k ^ 1]
            if other < value:
                value = other
            k >>= 1

    while (top := tree[1]) != NONE:
        i = top & low
        gone = after[i]
        end = after[i] = after[gone]
        before[end] = i
        if gone < n - 1:
            put(gone, NONE)
        rank = get(piece[i : after[end]]) if end < n else None
        put(i, NONE if rank is None else rank << bits | i)
        if i:
            p = before[i]
            rank = get(piece[p:end])
            put(p, NONE if rank is None else rank << bits | p)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class Codec:
    """Encodes texts to little-endian unsigned 32-bit ids and decodes them."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pieces = ranks, Pieces(pattern)
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.matches = WordCache(self._match)
        self.words = WordCache(self._word)

    def _match(self, piece: bytes) -> bytes:
        ids = encode_piece(piece, self.ranks)
        return pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        pieces = self.pieces(word)
        return self._match(pieces[0]) if len(pieces) == 1 else b"".join(self.matches.all(pieces))

    def encode(self, text: str | None) -> bytes:
        return b"".join(self.words.all(words_of(text))) if text else b""

    def decode(self, ids: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) of every row of ``docs``.

    Each match of the pattern is encoded separately by the file's ranks, without special tokens, and the
    ids are decoded again. A null text is the empty text, which has no tokens. Texts are encoded whole;
    a word's ids are remembered, within a bound. Null ids and repeated rows stay; other columns are
    ignored. The vocabulary is read on the driver and broadcast: its size is that of the file.
    """
    # A worker keeps the codec, and the words that it remembers, from task to task.
    codec = docs.sparkSession.sparkContext.broadcast(Codec(read_ranks(ranks_path), pattern))
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, decode = codec.value.encode, codec.value.decode
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids = [encode(t) for t in part.column(1).to_pylist()]
                found = [
                    part.column(0),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(decode(x)).hexdigest() for x in ids], pa.string()),
                ]
                if with_ids:
                    ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
                    found.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4"))))
                yield pa.RecordBatch.from_arrays(found, ["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(found)])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
