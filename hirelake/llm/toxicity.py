"""Toxicity by multiple-instance learning: a document is a bag of sentences, labelled as a whole.

A sentence's score is logistic in the evidence of its words; a document's score is the noisy-or of its
sentences' scores. The evidence features are words and word beginnings that the labelled documents'
counts tie to the label; their weights are fitted to the documents' labels through the noisy-or, and
the sentence scores then tell where the offence is.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.llm.common import fold
from hirelake.llm.tokenizer import WordCache

#: Labelled documents of each class that train, on average, chosen by a hash of the id. Features have no limit of
#: their own: each needs evidence from several documents of the sample, which bounds them.
TRAIN_DOCS = 10_000
#: The least log-likelihood ratio (G squared) and number of positive documents of a feature.
LEAST_G2, LEAST_DOCS = 16.0, 3
THRESHOLD = 0.7
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n。！？]+")


def features(word: str) -> list[str]:
    """The word itself, and its first letters where it is longer."""
    return [word, *(word[:k] + "*" for k in (4, 5) if len(word) > k)]


def fit_bags(bags: list[list[list[int]]], labels: np.ndarray, start: np.ndarray, centre: np.ndarray | None = None, steps: int = 400, rate: float = 0.05, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias of the sentence score whose noisy-or fits the labels; full-batch Adam.

    Weights are drawn to ``centre`` (zeros): where other sentences explain a document, a word keeps what its
    own counts say. A bag lists the features of each sentence that has any; bags without such sentences teach nothing.
    """
    sentence_of, feature, doc_of = [], [], []
    for d, bag in enumerate(bags):
        for sentence in bag:
            sentence_of += [len(doc_of)] * len(sentence)
            feature += sentence
            doc_of.append(d)
    if not doc_of:
        return start, -2.0
    sentence_of, feature, doc_of = np.array(sentence_of), np.array(feature), np.array(doc_of)
    used = np.zeros(len(bags), bool)
    used[doc_of] = True
    params = np.append(start, -2.0)
    m, v = np.zeros_like(params), np.zeros_like(params)
    centre = np.zeros(len(start)) if centre is None else centre
    for t in range(1, steps + 1):
        z = params[-1] + np.bincount(sentence_of, params[feature], len(doc_of))
        total = np.bincount(doc_of, np.logaddexp(0, z), len(bags))
        pull = np.where(labels == 1, -1 / np.expm1(np.maximum(total, 1e-9)), 1.0) * used / used.sum()
        dz = pull[doc_of] / (1 + np.exp(-z))
        grad = np.append(np.bincount(feature, dz[sentence_of], len(start)) + ridge * (params[:-1] - centre), dz.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params = params - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return params[:-1], float(params[-1])


class Scorer:
    """Scores whole texts and locates their offending sentences."""

    def __init__(self, weights: dict[str, float], bias: float, rest: float) -> None:
        """rest: the score of a text without any evidence."""
        self.weights, self.bias, self.rest = weights, bias, rest
        self.words = WordCache(self._evidence)

    def _evidence(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in features(word))

    def sentences(self, text: str | None) -> list[tuple[int, int, float]]:
        """(start, end, score) of each sentence that has evidence; ends are exclusive."""
        lower = (text or "").lower()
        if not any(self.words.all(_WORD.findall(lower))):
            return []
        found = []
        lower = lower if len(lower) == len(text) else text
        for m in _SENTENCE.finditer(lower):
            values = self.words.all(_WORD.findall(m[0].lower()))
            if any(values):
                found.append((m.start(), m.end(), float(1 / (1 + np.exp(-(self.bias + sum(values)))))))
        return found

    def score(self, found: list[tuple[int, int, float]]) -> float:
        miss = 1 - self.rest
        for _, _, p in found:
            miss *= 1 - p
        return min(1.0, max(0.0, 1 - miss))


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Scorer:
    """A scorer from documents (id, text) and labels (id, y) outside fold 1."""
    spark = docs.sparkSession
    known = labels.where("id IS NOT NULL AND y IN (0, 1)").where(fold(F.col("id")) != 1).groupBy("id").agg(F.max("y").alias("y"))
    sizes = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if set(sizes) != {0, 1}:
        return Scorer({}, 0.0, float(min(1.0, max(sizes, default=0))))
    share = F.when(F.col("y") == 1, F.lit(min(1.0, train_docs / sizes[1]))).otherwise(F.lit(min(1.0, train_docs / sizes[0])))
    # About twice train_docs short rows at most, so they can be broadcast.
    sample = F.broadcast(known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share * (1 << 20)))
    joined = docs.join(sample, "id").select("y", F.coalesce("text", F.lit("")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[y].update({f for w in set(_WORD.findall(text.lower())) for f in features(w)})
        names = [*(seen[0].keys() | seen[1].keys())]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([seen[y][f] for f in names], pa.int64()) for y in (0, 1))], ["feature", "neg", "pos"])

    counted = joined.mapInArrow(count, "feature string, neg long, pos long").groupBy("feature").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    n = joined.groupBy().agg(F.sum(1 - F.col("y")).alias("neg"), F.sum("y").alias("pos")).first()
    if not n.neg or not n.pos:
        return Scorer({}, 0.0, float(bool(n.pos)))
    term = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    pos, neg, both = F.col("pos").cast("double"), F.col("neg").cast("double"), (F.col("pos") + F.col("neg")).cast("double")
    share_pos, share_neg = n.pos / (n.pos + n.neg), n.neg / (n.pos + n.neg)
    g2 = 2 * (term(pos, both * share_pos) + term(neg, both * share_neg) + term(n.pos - pos, (n.pos + n.neg - both) * share_pos) + term(n.neg - neg, (n.pos + n.neg - both) * share_neg))
    strong = counted.where((pos >= LEAST_DOCS) & (pos * n.neg > neg * n.pos)).withColumn("g2", g2).where(F.col("g2") >= LEAST_G2)
    chosen = strong.orderBy(F.desc("g2"), "feature").collect()
    number = {r.feature: k for k, r in enumerate(chosen)}
    ratio = np.array([np.clip(np.log((r.pos + 0.5) / (n.pos + 1)) - np.log((r.neg + 0.5) / (n.neg + 1)), 0, 6) for r in chosen])
    # A beginning counts half: its words carry the rest.
    centre = ratio * np.where([r.feature.endswith("*") for r in chosen], 0.5, 1.0)
    numbers = spark.sparkContext.broadcast(number)

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = []
            for text in batch.column(1).to_pylist():
                found = ([numbers.value[f] for w in _WORD.findall(m[0]) for f in features(w) if f in numbers.value] for m in _SENTENCE.finditer(text.lower()))
                bags.append([s for s in found if s])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bags, pa.list_(pa.list_(pa.int32())))], ["y", "bag"])

    # The rows of the bounded sample, each with the numbers of its few evidence features.
    rows = joined.mapInArrow(bag, "y int, bag array<array<int>>").collect()
    y = np.array([r.y for r in rows])
    weights, bias = fit_bags([r.bag for r in rows], y, ratio / 2, centre)
    without = [r.y for r in rows if not r.bag]
    rest = (sum(without) + 0.5) / (len(without) + 50)
    return Scorer(dict(zip(number, weights.tolist(), strict=True)), bias, rest)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_docs: int = TRAIN_DOCS, locate: bool = False) -> DataFrame:
    """(doc_id, held_out, score, predicted[, offending]) of every row of ``docs``.

    Labels are 0 or 1 (others and nulls teach nothing); of several labels of an id the largest counts.
    Rows of fold 1 and with a null id don't train. Null and empty texts get the score of a text without
    evidence. Without labels of both classes the score is that of the only class, else 0. Texts are
    read whole. ``locate`` adds the (start, end, score) of sentences that alone reach the threshold.
    Repeated rows stay; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    marks = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y"))
    scorer = docs.sparkSession.sparkContext.broadcast(train(rows, marks, train_docs))
    schema = "id long, score double" + ", offending array<struct<start:int,end:int,score:double>>" * locate

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scorer.value.sentences(t) for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array([scorer.value.score(f) for f in found], pa.float64())]
            if locate:
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
                columns.append(pa.array([[{"start": a, "end": b, "score": p} for a, b, p in f if p >= THRESHOLD] for f in found], kind))
            yield pa.RecordBatch.from_arrays(columns, ["id", "score", "offending"][: len(columns)])

    scored = rows.mapInArrow(run, schema)
    more = ["offending"] if locate else []
    return scored.select(F.col("id").alias(id_col), F.coalesce(fold(F.col("id")) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), *more)
