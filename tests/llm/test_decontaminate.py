import math
import random

import numpy as np

from hirelake.llm.common import cut
from hirelake.llm.decontaminate import DIMENSIONS, LIKELY, SURE, Index, build, common_length, find_contaminated, keep_clean, words
from hirelake.llm.queries import op8_decontaminate


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = _step(row, x, b)
    return row[-1]


def _step(row, x, b):
    new = [0]
    for j, y in enumerate(b):
        new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
    return new


def test_common_length_is_the_longest_subsequence():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(1, 20))] for _ in range(2))
        mask = {}
        for k, t in enumerate(a):
            mask[t] = mask.get(t, 0) | 1 << k
        assert common_length(mask, len(a), b) == slow_lcs(a, b)


def test_query_finds_every_copied_item(spark):
    base = "/root/testdata/sf0.01"
    items = {r.item_id: words(r.text) for r in spark.read.parquet(f"{base}/benchmark.parquet").collect()}
    grams = {}
    for k, w in items.items():
        for i in range(len(w) - 4):
            grams.setdefault(tuple(w[i : i + 5]), set()).add(k)
    want = set()
    for r in spark.read.parquet(f"{base}/documents.parquet").collect():
        w, seen = words(r.text), {}
        for i in range(len(w) - 4):
            for k in grams.get(tuple(w[i : i + 5]), ()):
                seen.setdefault(k, set()).add(tuple(w[i : i + 5]))
        want |= {(r.doc_id, k) for k, s in seen.items() if len(s) >= 0.9 * (len(items[k]) - 4)}
    assert {(r.doc_id, r.item_id) for r in op8_decontaminate(spark, base).collect()} == want


def corpus(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    line = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [line(30) for _ in range(20)]
    docs = [(k, " ".join(line(200)), 1) for k in range(100)]
    changed = [w if i % 6 else "other" for i, w in enumerate(items[3])]
    half = items[5][:12]
    docs += [(200, " ".join(line(70) + items[0] + line(50)), 1), (201, " ".join(line(90) + changed + line(10)), 1), (202, " ".join(line(50) + half + line(50)), 1)]
    docs += [(300, None, 1), (301, "", 1), (302, "one", 1), (None, " ".join(items[1]).upper(), 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)] + [(90, None), (91, ""), (92, "too short"), (93, "...")], "item_id long, text string")
    return df, bench


def test_paraphrases_and_edge_rows(spark):
    df, bench = corpus(spark)
    assert {(r.doc_id, r.item_id) for r in find_contaminated(df, bench).collect()} == {(200, 0), (201, 3), (None, 1)}
    kept = keep_clean(df, bench)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [*range(100), 202, 300, 301, 302]
    for docs, items in ((df.limit(0), bench), (df, bench.limit(0)), (df, bench.where("item_id > 89"))):
        assert find_contaminated(docs, items).count() == 0 and keep_clean(docs, items).count() == docs.count()


def lines(seed, count, size):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(300)]
    return [[rng.choice(vocabulary) for _ in range(size)] for _ in range(count)]


def test_frequent_items_are_found(spark):
    items = lines(5, 30, 40)
    items[0] = items[0][:15]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    for share in (3, 1):
        docs = []
        for k, w in enumerate(lines(6, 300, 120)):
            docs.append((k, " ".join(w[: k % 100] + items[0] * (k % share == 0) + w[k % 100 :])))
        df = spark.createDataFrame(docs, "doc_id long, text string")
        found = {r.doc_id for r in find_contaminated(df, bench).where("item_id = 0 and overlap = 1").collect()}
        assert found == set(range(0, 300, share))
        assert {r.doc_id for r in keep_clean(df, bench).collect()}.isdisjoint(found)


def test_table_of_one_document(spark):
    items = lines(7, 3, 20)
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    df = spark.createDataFrame([(1, " ".join(["so", *items[0], *items[2][:4]]))], "doc_id long, text string")
    assert [(r.item_id, r.overlap) for r in find_contaminated(df, bench).collect()] == [(0, 1.0)]
    assert keep_clean(df, bench).count() == 0


def test_basis_holds_the_leading_singular_vectors(spark):
    """The latent space carries nearly as much of the TF-IDF rows as that of an exact decomposition."""
    rng = np.random.default_rng(3)
    topics = rng.dirichlet(np.full(120, 0.05), 40)
    names = [f"w{k}" for k in range(120)]
    docs = [" ".join(rng.choice(names, 60, p=topics[rng.integers(40)])) for _ in range(400)]
    index = Index([(k, " ".join(names[k * 6 : k * 6 + 6]), None) for k in range(20)])
    coded = [index.encode(d) for d in docs]
    build(cut(spark.createDataFrame([(c.tobytes(),) for c in coded], "tokens binary"), "test-words"), index)
    rows = np.zeros((len(docs), len(index.idf)))
    for k, c in enumerate(coded):
        np.add.at(rows[k], c, index.idf[c].astype(float))
    items = np.zeros((len(index.texts), len(index.idf)))
    for k, t in enumerate(index.texts):
        np.add.at(items[k], t, index.idf[t].astype(float) / np.sqrt((index.idf[t].astype(float) ** 2).sum()))
    basis = np.divide(index.terms, index.idf[:, None], out=np.zeros_like(index.terms), where=index.idf[:, None] > 0).astype(float)
    both = np.concatenate([rows / np.linalg.norm(rows), items / np.linalg.norm(items)])
    best = (np.linalg.svd(both, compute_uv=False)[:DIMENSIONS] ** 2).sum()
    assert np.allclose(basis.T @ basis, np.eye(DIMENSIONS), atol=1e-4)
    exact = np.linalg.svd(both, compute_uv=False)
    assert np.allclose(index.singular[:3], exact[:3], rtol=0.1), (index.singular[:3], exact[:3])
    assert ((both @ basis) ** 2).sum() > 0.95 * best and (np.diff(index.singular) <= 1e-9).all()


def slow_matches(items, tokens):
    """Items that some window holds, by the longest common subsequence with every window of the text."""
    found = set()
    for k, w in items.items():
        if len(w) < 5:
            found |= {k} if any(tokens[i : i + len(w)] == w for i in range(len(tokens))) else set()
            continue
        mask = {}
        for place, t in enumerate(w):
            mask[t] = mask.get(t, 0) | 1 << place
        if any(common_length(mask, len(w), tokens[i : i + len(w) + 16]) >= SURE * len(w) for i in range(max(1, len(tokens)))):
            found.add(k)
    return found


def test_recall_of_edited_items_against_all_windows(spark):
    """Items with words replaced, dropped, added and moved; what every-window search finds by its share alone is found."""
    rng = random.Random(11)
    base = "/root/testdata/sf0.01"
    items = {r.item_id: words(r.text) for r in spark.read.parquet(f"{base}/benchmark.parquet").collect()}
    texts = [words(r.text) for r in spark.read.parquet(f"{base}/documents.parquet").limit(120).collect()]
    docs = []
    for k, text in enumerate(texts):
        w = list(items[rng.choice([*items])])
        for _ in range(len(w) * (k % 6) // 10):
            at, how = rng.randrange(len(w)), rng.randrange(4)
            if how == 0:
                w[at] = "changed"
            elif how == 1:
                w.insert(at, "added")
            elif how == 2 and len(w) > 8:
                del w[at]
            elif at + 1 < len(w):
                w[at], w[at + 1] = w[at + 1], w[at]
        at = rng.randrange(len(text) + 1)
        docs.append((k, " ".join(text[:at] + w + text[at:])))
    want = {(i, k) for i, t in docs for k in slow_matches(items, words(t))}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = {(r.doc_id, r.item_id): r.overlap for r in find_contaminated(df, spark.read.parquet(f"{base}/benchmark.parquet")).collect()}
    assert len(want) > 70 and want <= set(found), want - set(found)
    for i, k in set(found) - want:
        # The rest hold most of an item with its answer in a slightly wider window.
        mask = {}
        for place, t in enumerate(items[k]):
            mask[t] = mask.get(t, 0) | 1 << place
        tokens = words(docs[i][1])
        assert max(common_length(mask, len(items[k]), tokens[j : j + len(items[k]) + 64]) for j in range(len(tokens))) >= math.ceil(LIKELY * len(items[k]) - 1e-9)


def test_short_items_and_scripts_without_spaces(spark):
    bench = spark.createDataFrame([(1, "nine red birds"), (2, "日本語の長い文章はここにあります"), (3, "?"), (4, None)], "item_id long, text string")
    docs = [(1, "saw Nine red birds there"), (2, "nine birds red"), (3, "前に日本語の長い文章はここにあります後"), (4, "日本の文"), (5, None), (6, "w " * 70_000 + "nine red birds"), (7, "nine red"), (8, "red birds nine red birds")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in find_contaminated(df, bench).collect()} == {(1, 1), (3, 2), (6, 1), (8, 1)}
    assert {r.doc_id for r in keep_clean(df, bench).collect()} == {2, 4, 5, 7}


def test_batches_are_encoded_like_single_texts(monkeypatch):
    items = [(1, "the small house by the sea", None), (2, "ein grünes haus am see", None), (3, "日本の家", "家")]
    texts = ["The SMALL house, by: the_sea", "«Ein» grünes Haus!", "日本の家です", None, "", "\n\nsea", "x" * 400 + " house", "A_b é", "¿sea"]
    for more in ([], [(4, "y" * 300 + " long word", None)]):
        index = Index(items + more)
        monkeypatch.setattr("hirelake.llm.decontaminate.AT_ONCE", 1 << 19 if more else 12)
        assert all(np.array_equal(index.encode(t), c) for t, c in zip(texts, index.encode_all(texts), strict=True))
