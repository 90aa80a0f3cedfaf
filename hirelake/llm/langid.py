"""Language identification by prediction by partial matching.

Each language has a byte context tree of variable order: the counts of a byte after the 0 to ORDER
bytes before it. A byte that a context hasn't seen costs that context's escape (method C: distinct
followers over their number plus distinct followers) and then its cost in the next shorter context,
down to 8 bits. The statistics are frozen after training, so the cost of a byte in its context is a
fixed number, and a text's code length is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.llm.common import fold

ORDER = 3
#: Training documents of each language, on average; the sample is chosen by a hash of the id.
TRAIN_DOCS = 2000
UNKNOWN = "und"
#: The least score of an identified document: the best language is likelier than all others together.
LEAST_SCORE = 0.5
_LETTER = regex.compile(r"\p{L}")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def grams(data: bytes, order: int) -> list[np.ndarray]:
    """For k = 0..order, the k + 1 bytes that end at each position, as one number."""
    x = np.frombuffer(data, np.uint8).astype(np.uint64)
    codes = [x]
    for k in range(1, order + 1):
        codes.append(x[: max(0, len(x) - k)] << np.uint64(8 * k) | codes[-1][1:])
    return codes


class Index:
    """Finds numbers of a sorted array: a hash table first, a binary search for what it can't place."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        self.shift = np.uint64(64 - max(8, int(8 * len(keys) + 1).bit_length()))
        self.slots = np.zeros(1 << (64 - int(self.shift)), np.int32)
        at = keys * _MIX >> self.shift
        self.slots[at] = np.arange(len(keys))
        self.full = bool(len(keys)) and bool((self.slots[at] == np.arange(len(keys))).all())

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Positions in the keys; -1 for what isn't there."""
        if not len(self.keys):
            return np.full(len(codes), -1, np.int32)
        at = self.slots[codes * _MIX >> self.shift]
        missed = np.nonzero(self.keys[at] != codes)[0]
        if len(missed):
            found = -1
            if not self.full:
                rest = codes[missed]
                place = np.minimum(np.searchsorted(self.keys, rest), len(self.keys) - 1)
                found = np.where(self.keys[place] == rest, place, -1)
            at[missed] = found
        return at


class Model:
    """Code lengths of bytes in their contexts for every language, from counted n-grams."""

    def __init__(self, languages: list[str], order: int, counted: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """counted: by k, the languages' numbers, the codes of k + 1 bytes, and their counts."""
        self.languages, self.order = languages, order
        self.grams: list[tuple[Index, np.ndarray]] = []
        self.contexts: list[tuple[Index, np.ndarray]] = []
        for k in range(order + 1):
            lang, code, n = counted.get(k, (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0)))
            keys, where = np.unique(code, return_inverse=True)
            count = np.zeros((len(keys), len(languages)))
            count[where, lang] = n
            heads, of = np.unique(keys >> np.uint64(8), return_inverse=True)
            total, kinds = np.zeros((len(heads), len(languages))), np.zeros((len(heads), len(languages)))
            np.add.at(total, of, count)
            np.add.at(kinds, of, count > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                own = -np.log2(count / (total + kinds)[of])
            if k:
                index, costs = self.grams[k - 1]
                shorter = costs[index.find(keys & np.uint64((1 << 8 * k) - 1))]
            else:
                shorter = np.full((len(keys), len(languages)), 8.0)
            self.grams.append((Index(keys), np.where(count > 0, own, escape[of] + shorter)))
            self.contexts.append((Index(heads), escape))

    def _bits(self, codes: np.ndarray, k: int) -> np.ndarray:
        index, costs = self.grams[k]
        at = index.find(codes)
        missed = np.nonzero(at < 0)[0]
        if not len(missed):
            return costs[at].sum(0)
        known = costs[at[at >= 0]].sum(0)
        rest = codes[missed]
        heads, escapes = self.contexts[k]
        left = heads.find(rest >> np.uint64(8))
        known = known + escapes[left[left >= 0]].sum(0)
        return known + (self._bits(rest & np.uint64((1 << 8 * k) - 1), k - 1) if k else 8.0 * len(rest))

    def bits(self, data: bytes) -> np.ndarray:
        """The code length of the bytes in each language."""
        total = np.zeros(len(self.languages))
        for lo in range(0, len(data), 1 << 20):
            begin = max(0, lo - self.order)
            codes = grams(data[begin : lo + (1 << 20)], self.order)
            if not begin:
                for k in range(self.order):
                    total += self._bits(codes[k][:1], k) if len(codes[k]) else 0
            if len(codes[-1]):
                total += self._bits(codes[-1], self.order)
        return total

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not _LETTER.search(text):
            return UNKNOWN, 0.0
        bits = self.bits(text.encode("utf-8", "surrogatepass"))
        best = int(np.argmin(bits))
        return self.languages[best], float(1 / np.exp2(np.maximum(bits[best] - bits, -1000.0)).sum())


def train(docs: DataFrame, order: int = ORDER, train_docs: int = TRAIN_DOCS) -> Model:
    """The model of documents (id, text, lang) that are not held out: about ``train_docs`` of each language.

    Its size follows the number of languages, a closed set of labels, and not the number of documents.
    """
    labelled = docs.where("text IS NOT NULL AND lang IS NOT NULL AND text <> ''").where(fold(F.col("id")) != 1)
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    number = {x: k for k, x in enumerate(languages)}
    if not languages:
        return Model([], order, {})
    shares = F.create_map(*(F.lit(y) for x in languages for y in (x, int((1 << 20) * min(1.0, train_docs / sizes[x])))))
    sample = labelled.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < shares[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(text.encode("utf-8", "surrogatepass"))
            for lang, datas in by_lang.items():
                each = [grams(d, order) for d in datas]
                for k in range(order + 1):
                    codes, n = np.unique(np.concatenate([g[k] for g in each]), return_counts=True)
                    size = len(codes)
                    yield pa.RecordBatch.from_arrays([pa.array([number[lang]] * size, pa.int32()), pa.array([k] * size, pa.int32()), pa.array(codes.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "k", "code", "n"])

    rows = sample.mapInArrow(count, "lang int, k int, code long, n long").groupBy("lang", "k", "code").agg(F.sum("n").alias("n")).toArrow()
    lang, ks, code, n = (rows.column(c).to_numpy() for c in range(4))
    return Model(languages, order, {k: (lang[ks == k], code[ks == k].view(np.uint64), n[ks == k]) for k in range(order + 1)})


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``docs``.

    Only text and non-null language of rows outside fold 1 train; rows with a null id don't. A text that
    is null or has no letter is ``und`` with score 0, and so is every text when no language was learned.
    The score is the best language's share of the likelihood; equally good languages go by name. Texts
    are read whole. Repeated rows stay; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    model = docs.sparkSession.sparkContext.broadcast(train(rows, order, train_docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.value.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["id", "lang_pred", "score"])

    scored = rows.select("id", "text").mapInArrow(run, "id long, lang_pred string, score double")
    return scored.select(F.col("id").alias(id_col), F.coalesce(fold(F.col("id")) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, order: int = ORDER, train_docs: int = TRAIN_DOCS, least_score: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, lang, ...) whose language is identified, with all columns.

    Rejected are texts without a language (null ones and those without a letter), and texts whose best
    language has a score below ``least_score``. A kept row without lang gets the predicted one. Where no
    language could be learned (no labelled row outside the held-out fold) only texts without a letter go.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = docs.sparkSession.sparkContext.broadcast(train(rows, order, train_docs))
    at = docs.columns.index("lang")
    kind = docs.schema["lang"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.value.predict(t) for t in batch.column("text").to_pylist()]
            if model.value.languages:
                kept = [lang != UNKNOWN and score >= least_score for lang, score in found]
            else:
                kept = [bool(t and _LETTER.search(t)) for t in batch.column("text").to_pylist()]
            if kind == "string" and model.value.languages:
                langs = [old if old is not None else new[0] for old, new in zip(batch.column("lang").to_pylist(), found, strict=True)]
                batch = batch.set_column(at, batch.schema.field(at).name, pa.array(langs, pa.string()))
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
