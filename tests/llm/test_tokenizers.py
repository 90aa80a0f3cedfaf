import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from hirelake.llm.bpe import Codec, encode_piece, encode_texts
from hirelake.llm.queries import op6_bpe, op9_tokencount
from hirelake.llm.tokencount import LongestMatch, count_tokens
from hirelake.llm.tokenizer import Pieces, read_ranks, words_of
from tests.conftest import SMALL

PATH = P.path("byte_bpe_multi_50k.tiktoken")
RANKS = read_ranks(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
HARD = ["", " ", "  ", "a", "a  b", "a   b\n\n c", "\n x", "   y z", "don't WE'LL it's", "x\x1cy \x1dz \x85 q", "日本語 テスト ١٢٣ ½", "🙂🙂 👩‍👩‍👧 é", "tab\t\tend \t", "aaaa" * 500, "#!? ..." * 40, " end "]


def random_texts(n=300):
    rng = random.Random(3)
    letters = "ab é漢1 2\n\t\r'  s.t,-🙂  \x1c"
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(n)]


@pytest.mark.parametrize("text", HARD)
def test_ids_equal_the_library(text):
    codec = Codec(RANKS, P.PATTERN)
    ids = codec.encode(text)
    assert [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)] == LIBRARY.encode_ordinary(text)
    assert codec.decode(ids).decode() == text


def test_random_texts_equal_the_library():
    codec = Codec(RANKS, P.PATTERN)
    for text in random_texts():
        ids = codec.encode(text)
        assert [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)] == LIBRARY.encode_ordinary(text), repr(text)


def test_words_join_to_the_text():
    pieces = Pieces(P.PATTERN)
    for text in HARD + random_texts():
        if text:
            assert "".join(words_of(text)) == text
            assert [p for w in words_of(text) for p in pieces(w)] == pieces(text), repr(text)


def test_ties_merge_the_leftmost_pair_first():
    ranks = {b"a": 0, b"b": 1, b"aa": 2, b"aab": 3}
    assert encode_piece(b"aaab", ranks) == [2, 0, 1]
    with pytest.raises(ValueError):
        encode_piece(b"c", ranks)


def slow_count(word, vocabulary, mark=b""):
    at = n = 0
    while at < len(word):
        lead = mark if at else b""
        end = next((e for e in range(len(word), at, -1) if lead + word[at:e] in vocabulary and (at or not mark or not word[at:e].startswith(mark))), None)
        if end is None:
            return 1
        n, at = n + 1, end
    return n


def test_counts_equal_greedy_splits():
    rng = random.Random(9)
    for mark in (b"", b"##"):
        for _ in range(200):
            plain = {bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(1, 12))}
            inner = {mark + bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(1, 12))} if mark else set()
            automaton = LongestMatch(sorted(plain | inner), mark)
            for _ in range(30):
                word = bytes(rng.choice(b"abc") for _ in range(rng.randrange(12)))
                assert automaton.count(word) == slow_count(word, plain | inner, mark), (plain, inner, word)


def test_queries(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for r in op6_bpe(spark, SMALL).collect():
        ids = LIBRARY.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(b"".join(i.to_bytes(4, "little") for i in ids)), sha(texts[r.doc_id].encode()))
    pieces = Pieces(P.PATTERN)
    for r in op9_tokencount(spark, SMALL).limit(40).collect():
        words = pieces(texts[r.doc_id])
        assert (r.n_words, r.n_tokens) == (len(words), sum(slow_count(w, RANKS) for w in words))


def test_edge_rows(spark):
    df = spark.createDataFrame([(1, None, 1), (1, "", 1), (None, "ab  c", 1), (2, "word " * 30000, 1)], "doc_id long, text string, ids int")
    found = sorted((r.doc_id or 0, r.n_tokens, len(r.ids)) for r in encode_texts(df, PATH, P.PATTERN).collect())
    assert found[:3] == [(0, 3, 3), (1, 0, 0), (1, 0, 0)] and found[3][1] == len(LIBRARY.encode_ordinary("word " * 30000))
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_words) for r in count_tokens(df, PATH, P.PATTERN).collect())[:3] == [(0, 5, 3), (1, 0, 0), (1, 0, 0)]
    assert encode_texts(df.limit(0), PATH, P.PATTERN).count() == count_tokens(df.limit(0), PATH, P.PATTERN).count() == 0
