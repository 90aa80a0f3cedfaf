import math
import zlib
from collections import Counter

import numpy as np

from hirelake.llm.langid import Index, Model, grams, identify, keep_identified
from hirelake.llm.queries import op7_langid


def slow_bits(train, text, order):
    """Code length under the counts of the training texts, context by context."""
    counts = {}
    for data in train:
        for i in range(len(data)):
            for k in range(min(i, order) + 1):
                counts.setdefault(data[i - k : i], Counter())[data[i]] += 1
    bits = 0.0
    for i in range(len(text)):
        for k in range(min(i, order), -2, -1):
            if k < 0:
                bits += 8
                break
            c = counts.get(text[i - k : i])
            if not c:
                continue
            total = sum(c.values()) + len(c)
            if text[i] in c:
                bits -= math.log2(c[text[i]] / total)
                break
            bits -= math.log2(len(c) / total)
    return bits


def make(trains, order):
    counted = {}
    for k in range(order + 1):
        rows = [(lang, c) for lang, data in enumerate(trains) for d in data for c in grams(d, order)[k].tolist()]
        tally = Counter(rows)
        counted[k] = (np.array([x[0] for x in tally], np.int64), np.array([x[1] for x in tally], np.uint64), np.array([*tally.values()]))
    return Model(["a", "b"], order, counted)


def test_code_lengths_are_exact():
    trains = ([b"the cat sat on the mat", b"a dog"], ["die katze saß".encode(), b"x"])
    for order in (1, 2, 3, 5):
        model = make(trains, order)
        for text in (b"", b"t", b"the katze", "zzß the mat sat\x00".encode(), b"on the die " * 20):
            assert np.allclose(model.bits(text), [slow_bits(t, text, order) for t in trains])


def test_index_finds_every_key():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 40, 5000).astype(np.uint64))
    index = Index(keys)
    assert (index.find(keys) == np.arange(len(keys))).all()
    assert (index.find(np.array([1 << 50], np.uint64)) == -1).all() and (Index(keys[:0]).find(keys[:3]) == -1).all()


def test_held_out_accuracy(spark):
    base = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{base}/documents.parquet").select("doc_id", "lang").collect()}
    found = op7_langid(spark, base).collect()
    assert len(found) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    held = [r for r in found if r.held_out and r.lang_pred != "und"]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97


def test_edge_rows(spark):
    rows = [(1, "the one text here", "en"), (2, None, "en"), (3, "12 ... 7", "en"), (3, "12 ... 7", "en"), (4, "", None), (None, "le texte", "fr"), (6, "the other", None)]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    found = sorted((r.doc_id or 0, r.lang_pred) for r in identify(df).collect())
    assert found == [(0, "en"), (1, "en"), (2, "und"), (3, "und"), (3, "und"), (4, "und"), (6, "en")]
    assert sorted(r.doc_id or 0 for r in keep_identified(df).collect()) == [0, 1, 6] and keep_identified(df).columns == df.columns
    assert {r.doc_id: r.lang for r in keep_identified(df).collect()}[6] == "en"
    assert keep_identified(df, least_score=1.1).count() == 0
    assert identify(df.limit(0)).count() == 0
    assert {r.lang_pred for r in identify(df.withColumn("lang", df.lang.substr(1, 0)).where("false").unionByName(df.selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang", "score"))).collect()} == {"und"}


def test_a_table_without_lang_keeps_what_has_a_letter(spark):
    rows = [(1, "some words", None), (2, None, None), (3, "", None), (4, "12 34", None), (5, "weitere Worte", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in keep_identified(df).collect()) == [1, 5]
