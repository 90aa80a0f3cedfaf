import numpy as np

from hirelake.llm.queries import op4_toxicity
from hirelake.llm.toxicity import fit_bags, score_toxicity


def test_noisy_or_blames_the_right_feature():
    bags = [[[0], [1]], [[0]], [[1]], [[0], [0]], [[2], [1]]] * 20
    weights, bias = fit_bags(bags, np.array([1, 1, 0, 1, 0] * 20), np.zeros(3))
    p = 1 / (1 + np.exp(-(bias + weights)))
    assert p[0] > 0.9 and p[1] < 0.1 and p[2] < 0.1


def test_held_out_accuracy(spark):
    base = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{base}/labels.parquet").collect()}
    found = [r for r in op4_toxicity(spark, base).collect() if r.held_out and r.doc_id in truth]
    right = [r.predicted == truth[r.doc_id] for r in found]
    caught = [r.predicted for r in found if truth[r.doc_id]]
    assert np.mean(right) > 0.98 and np.mean(caught) > 0.9


def test_edge_rows(spark):
    docs = [(i, f"w{'abcdefg'[i % 7]} plain words. You awful thing! more" if i % 2 else "plain words. more of them", 1) for i in range(200)]
    docs += [(None, "awful", 1), (900, None, 1), (901, "", 1), (902, "awful", 1), (902, "awful", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, i % 2, 9) for i in range(200)] + [(None, 1, 9), (3, None, 9)], "doc_id long, toxic int, text int")
    found = {(r.doc_id, r.predicted): r for r in score_toxicity(df, labels, locate=True).collect()}
    assert (900, 0) in found and (901, 0) in found and (902, 1) in found and (None, 1) in found and found[902, 1].score <= 1
    start, end, _ = found[(1, 1)].offending[0]
    assert docs[1][1][start:end] == " You awful thing"
    assert score_toxicity(df.limit(0), labels).count() == 0
    assert {r.predicted for r in score_toxicity(df, labels.limit(0)).collect()} == {0}
