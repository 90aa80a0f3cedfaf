import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from hirelake.llm.pii import candidates, decided, find_spans, masked, reliabilities, redact, running
from hirelake.llm.queries import op10_pii
from tests.conftest import SMALL

SPEC = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(digits[::-1])) % 10 == 0


def good(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def base(text):
    return [(k, m.start(), m.end()) for k, rx in SPEC.items() for m in re.finditer(rx, text or "") if good(k, m[0])]


def check(rows, texts):
    for r in rows:
        want = base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest(), (texts[r.doc_id], want, r.spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(w[0] == k for w in want) for k in SPEC)
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(r.spans.split(","))
        assert r.n_spans == len([x for x in r.spans.split(",") if x])


def test_query_matches_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = op10_pii(spark, SMALL).collect()
    assert len(rows) == len(texts)
    check(rows, texts)


def test_random_strings_match_brute_force(spark):
    rng = random.Random(8)
    bits = ["a", "b.", "@", "x@y.z", "1", "25", "256", ".", "1.2.3.4", "+", " ", "-", "(", ")", "4532015112830366", "+1 555 123 4567", "é🙂", "_", "%"]
    texts = {k: "".join(rng.choice(bits) for _ in range(rng.randrange(30))) for k in range(400)}
    texts |= {1000: "a" * 200_000, 1001: "1" * 100_000, 1002: "1.2.3.4 " * 700, 1003: "+1(" * 30_000, 1004: "a@" + "b." * 50_000}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(8)
    check(find_spans(df).collect(), texts)


def test_looser_spans_are_added(spark):
    rows = [(k, f"please call me: +1 (555) 123-{k:04d} now") for k in range(100)] + [(k, f"my phone (555) 123-{k:04d} works") for k in range(100, 120)]
    found = {r.doc_id: r.spans for r in find_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[3] == "phone:16:33" and found[110] == "phone:9:23"


def test_edge_rows(spark):
    rows = [(1, None, 3, "s"), (2, "", 0, "s"), (2, "", 0, "s"), (None, "x a@b.c, +1 555 123 4567 é 10.0.0.1", 9, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, spans string")
    found = sorted((r.doc_id or 0, r.n_email, r.n_ip, r.n_phone) for r in find_spans(df).collect())
    assert found == [(0, 1, 1, 1), (1, 0, 0, 0), (2, 0, 0, 0), (2, 0, 0, 0)]
    assert sorted((r.doc_id or 0, r.text, r.n_chars) for r in redact(df).collect())[0] == (0, "x [EMAIL], [PHONE] é [IP]", 25)
    assert redact(df).columns == df.columns
    assert find_spans(df.limit(0)).count() == 0 and redact(df.limit(0)).count() == 0


def test_added_spans_are_the_planted_secrets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = op10_pii(spark, "/root/testdata/sf0.01").collect()
    check(rows, texts)
    added = {(r.doc_id, x) for r in rows for x in set(r.spans.split(",")) - {f"{k}:{a}:{b}" for k, a, b in base(texts[r.doc_id])} - {""}}
    planted = {(i, f"secret:{m.start(1)}:{m.end(1)}") for i, t in texts.items() for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', t)}
    assert len(planted) > 10
    precision, recall = len(added & planted) / len(added), len(added & planted) / len(planted)
    assert precision == 1.0 and recall == 1.0, (precision, recall, added ^ planted)


def test_reliabilities_by_votes_alone(spark):
    """Brute-force expectation-maximisation over 600 candidates of known labelers gives the same reliabilities."""
    rng, right = random.Random(3), (0.9, 0.8, 0.7, 0.6)
    truth = [rng.random() < 0.4 for _ in range(600)]
    votes = [[(1 if y == (rng.random() < p) else -1) * (rng.random() < 0.9) for p in right] for y in truth]
    df = spark.createDataFrame([("k", [int(x) for x in v]) for v in votes], "kind string, votes array<int>").groupBy("kind", "votes").agg(F.count("*").cast("double").alias("n"))
    state = reliabilities(df).first().state
    prior, sens, spec = 0.5, [0.8] * 4, [0.8] * 4
    for _ in range(12):
        post = []
        for v in votes:
            a, b = prior, 1 - prior
            for j, x in enumerate(v):
                if x:
                    a *= sens[j] if x > 0 else 1 - sens[j]
                    b *= 1 - spec[j] if x > 0 else spec[j]
            post.append(a / (a + b))
        on = lambda j, s, w: sum(p for p, v in zip(w, votes, strict=True) if v[j] == s)  # noqa: B023, E731
        no = [1 - p for p in post]
        prior = (sum(post) + 2) / (len(post) + 4)
        sens = [(on(j, 1, post) + 4) / (on(j, 1, post) + on(j, -1, post) + 5) for j in range(4)]
        spec = [(on(j, -1, no) + 4) / (on(j, -1, no) + on(j, 1, no) + 5) for j in range(4)]
    assert all(abs(x - y) < 1e-6 for x, y in zip([state.prior, *state.sens, *state.spec], [prior, *sens, *spec], strict=True))


def test_running_folds_and_masks(spark):
    rng = random.Random(5)
    rows = [(k, [rng.randrange(-9, 9) for _ in range(n)]) for k, n in enumerate((0, 1, 63, 64, 65, 1000))]
    df = spark.createDataFrame(rows, "k long, v array<int>").select("k", running(F.col("v"), lambda x, y: x + y, 0).alias("s"))
    assert {r.k: r.s for r in df.collect()} == {k: [sum(v[: i + 1]) for i in range(len(v))] for k, v in rows}
    text = "".join(rng.choice("aé🙂 ") for _ in range(9000))
    spans = sorted((a, a + rng.randrange(1, 12)) for a in rng.sample(range(8900), 700))
    want, at = "", 0
    for a, b in spans:
        if a >= at:
            want += text[at:a] + "[X]"
        at = max(at, b)
    got = spark.createDataFrame([(text, [(a, b, "x") for a, b in spans])], "t string, s array<struct<start:int,end:int,kind:string>>").select(masked(F.col("t"), F.col("s")).alias("m")).first().m
    assert got == want + text[at:]


def test_loose_spans_never_overlap_base_ones(spark):
    kinds = "array<struct<kind:string,start:int,end:int,base:boolean,votes:array<int>,traits:array<string>>>"
    rng = random.Random(6)
    cands = [(rng.choice(["email", "card"]), a, a + rng.randrange(1, 30), rng.random() < 0.5, [1], ["x"]) for a in rng.sample(range(4000), 300)]
    kept = spark.createDataFrame([(cands,)], f"c {kinds}").select(F.explode(decided(F.col("c"), {"": 9.0})).alias("s")).select("s.*").collect()
    base_spans = [c for c in cands if c[3]]
    want = {(k, a, b) for k, a, b, is_base, _, _ in cands if is_base or not any(x[1] < b and a < x[2] for x in base_spans)}
    assert {(r.kind, r.start, r.end) for r in kept} == want and 0 < len(want) < 300


def test_time_follows_the_matches(spark):
    """Four times the matches in one text take about four times the time, not sixteen."""

    def took(n):
        df = spark.createDataFrame([("1.2.3.4 x@y.com " * (n // 2),)], "text string").cache()
        df.count()
        began = time.perf_counter()
        df.select(F.size(candidates(F.col("text")))).collect()
        return time.perf_counter() - began

    took(2000)
    assert took(64_000) < 8 * max(0.5, took(16_000))
