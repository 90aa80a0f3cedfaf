import random
import re
from collections import Counter

import pytest

from hirelake.llm.collocations import mine_collocations


def brute(rows, least, places):
    count, total = Counter(), Counter()
    for lang, text in rows:
        lang, text = "und" if lang is None else lang, re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", text):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            total[lang] += len(words)
            for i in range(len(words)):
                for m in range(1, 5):
                    if i + m <= len(words):
                        count[lang, tuple(words[i : i + m])] += 1
    found = {p: a for p, a in count.items() if len(p[1]) >= 2 and a >= least}
    out = []
    for lang in total:
        rows = []
        for (of, p), a in found.items():
            if of != lang:
                continue
            held = any(g == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * f >= 80 * a for (g, q), f in found.items())
            if not held:
                score, k = min((2_000_000 * a // (count[lang, p[:k]] + count[lang, p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), count[lang, p[:k]], count[lang, p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:places])]
    return sorted(out)


@pytest.mark.parametrize(("least", "places"), [(3, 2000), (8, 4)])
def test_equals_brute_force(spark, least, places):
    rng = random.Random(3)
    vocabulary = ["a", "B", "c", "é", "ß", "𝔘nicode", "tab", "the", "of", "E", "f"]
    rows = [(rng.choice(["en", "de", None, ""]), "".join(rng.choices(vocabulary, [9, 5, 3, 2, 1, 1, 1, 9, 5, 1, 1])[0] + rng.choices([" ", "  ", "\t", ". ", "\n", ",", "\x0b", "\xa0"], [30, 1, 2, 2, 1, 1, 1, 1])[0] for _ in range(rng.choice([1, 3, 40])))) for _ in range(150)]
    rows += [("en", None), (None, None), ("en", ""), ("de", " \t "), ("fr", "...")]
    rows += [("en", "one two three four five")] * 9 + [("en", "x\x00y z " * 12)]
    df = spark.createDataFrame([(lang, text, 1, "w") for lang, text in rows], "lang string, text string, n long, w1 string")
    assert sorted(map(tuple, mine_collocations(df, least, places).collect())) == brute(rows, least, places)


def test_a_long_text_and_none(spark):
    rows = [("en", "alpha beta gamma " * 40_000 + "end"), ("en", "alpha beta")]
    df = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(map(tuple, mine_collocations(df).collect())) == brute(rows, 30, 2000)
    assert mine_collocations(df.limit(0)).count() == 0


def test_counts_may_pass_64_bits_in_products(spark):
    from pyspark.sql import functions as F

    big = spark.range(1).select(F.lit(6_000_000_000_000_000_000).alias("a"), F.lit(7_000_000_000_000_000_000).alias("l"), F.lit(8_000_000_000_000_000_000).alias("r"))
    score = F.expr("cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    assert big.select(score).first()[0] == 2_000_000 * 6 * 10**18 // (15 * 10**18)
