import hashlib
import random

import numpy as np
import pytest

from hirelake.llm.queries import op5_suffixes
from hirelake.llm.suffixes import COVER_273, Windows, difference_cover, remove_repeats


def brute(texts, length):
    datas = [(t or "").encode() for t in texts]
    seen = {}
    for d in datas:
        for i in range(len(d) - length + 1):
            seen[d[i : i + length]] = seen.get(d[i : i + length], 0) + 1
    out = []
    for d in datas:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(d)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


@pytest.mark.parametrize("period", [1, 2, 3, 7, 16, 50, 273, 300])
def test_covers_cover_every_difference(period):
    cover = difference_cover(period)
    assert {(a - b) % period for a in cover for b in cover} == set(range(period)) and cover.max() < period
    assert len(COVER_273) == 17


def test_fingerprints_depend_on_the_string_alone(monkeypatch):
    monkeypatch.setattr("hirelake.llm.suffixes.HASHED_AT_ONCE", 50)
    data = np.frombuffer(b"abcdefghij" * 30, np.uint8)
    h = Windows(20)(data)
    assert len(h) == 281 and (h[10:] == h[:-10]).all() and len(set(h[:10].tolist())) == 10


def test_small_strings_match_brute_force(spark):
    rng = random.Random(6)
    passages = ["".join(rng.choice("abcé") for _ in range(rng.randrange(20, 90))) for _ in range(12)]
    texts = ["".join(rng.choice(passages)[rng.randrange(8) :] if rng.random() < 0.5 else "".join(rng.choice("abcdxyz ") for _ in range(30)) for _ in range(rng.randrange(6))) for _ in range(200)]
    texts += ["a" * 300, "ab" * 100, None, "", "short", texts[3], texts[3], "a" * 19]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want = brute(texts, 20)
    for r in remove_repeats(df, 20, 13, with_text=True).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) == want[r.doc_id], r.doc_id


def test_query_matches_brute_force(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(texts)
    want = dict(zip(ids, brute([texts[i] for i in ids], 400), strict=True))
    found = op5_suffixes(spark, "/root/testdata/sf0.001").collect()
    assert len(found) == len(ids)
    for r in found:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id][:4]


def test_edge_rows(spark):
    long = "x" * 500
    df = spark.createDataFrame([(1, None, "s"), (2, "a b", "s"), (2, "a b", "s"), (None, long, "s")], "doc_id long, text string, sha string")
    found = sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans) for r in remove_repeats(df).collect())
    assert found == [(0, 500, 500, 1), (1, 0, 0, 0), (2, 3, 0, 0), (2, 3, 0, 0)]
    assert remove_repeats(df.limit(0)).count() == 0
