import pytest
import xxhash

from hirelake.llm.components import connected_components
from hirelake.llm.queries import op1_simhash
from hirelake.llm.simhash import BKTree, fingerprint, keep_one, keep_single, links, simhash_components

MASK = (1 << 64) - 1


def slow_fingerprint(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    pieces = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in pieces]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in root}


@pytest.mark.parametrize("text", [None, "", " \n\t ", "One", "One two", "a b c", "A  b\tc d É ñ", "x y z " * 50])
def test_fingerprint_matches_the_plain_rule(text):
    assert fingerprint(text) == slow_fingerprint(text)


def test_tree_finds_what_a_scan_finds():
    import random

    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(20)]
    values = [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(20)]
    tree = BKTree()
    for v in values:
        tree.add(v)
    for v in values[:50]:
        assert sorted(tree.within(v, 3)) == [i for i, w in enumerate(values) if (v ^ w).bit_count() <= 3]


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 199)]
    df = spark.createDataFrame([*pairs, (None, 3)], "x long, y long")
    expected = components([p for p in pairs if p[0] != p[1]])
    assert {r.node: r.component for r in connected_components(df).collect()} == expected


def test_links_and_hot_shards_match_brute_force(spark, monkeypatch):
    import random

    monkeypatch.setattr("hirelake.llm.simhash.TREE_SIZE", 16)
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(6)]
    values = list({b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(60)})
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    near = [(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if (a ^ b).bit_count() <= 3]
    expected, groups = components(near), {}
    for k, v in expected.items():
        groups.setdefault(v, set()).add(k)
    found = {}
    for r in connected_components(links(df)).collect():
        found.setdefault(r.component, set()).add(r.node & MASK)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, groups.values()))


def test_query_matches_brute_force(spark):
    from tests.conftest import SMALL

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    fps = {r.doc_id: slow_fingerprint(r.text) for r in docs}
    ids = sorted(fps)
    near = components([(a, b) for i, a in enumerate(ids) for b in ids[i:] if (fps[a] ^ fps[b]).bit_count() <= 3])
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in op1_simhash(spark, SMALL).collect()}
    assert found == {i: (f"{fps[i]:016x}", near[i]) for i in ids}


def test_edge_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "same words here", "x"), (3, "same words here", "x"), (4, "SAME words here", "x"), (None, "same words here", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    found = sorted((r.doc_id or 0, r.component_id) for r in simhash_components(df).collect())
    assert found == [(0, None), (1, 1), (2, 1), (3, 3), (3, 3), (4, 3)]
    assert sorted((r.doc_id or 0) for r in keep_one(df).collect()) == [0, 1, 3, 3]
    assert simhash_components(df.limit(0)).count() == 0


def test_a_table_appended_twice_keeps_one_of_each(spark):
    rows = [(1, "the first of some texts", "b"), (2, "the FIRST of some texts", "a"), (3, "wholly different words in here", "x"), (None, "a row without id", "x")]
    df = spark.createDataFrame(rows + rows + [(1, "the first of some texts", "a")], "doc_id long, text string, fp string")
    # Id 9 carries a text of component 1 and one of its own, which must not go with the other.
    df = df.unionByName(spark.createDataFrame([(9, "the first of some texts", "x"), (9, "nobody else has this one", "y")], df.schema))
    found = sorted(((r.doc_id or 0), r.fp) for r in keep_single(df).collect())
    assert found == [(0, "x"), (0, "x"), (1, "a"), (3, "x"), (9, "y")] and keep_single(df).columns == df.columns
    assert keep_single(df.limit(0)).count() == 0
