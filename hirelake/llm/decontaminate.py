"""Benchmark decontamination by latent semantic retrieval.

Passages of all documents, and the benchmark's items, are TF-IDF rows A over the benchmark's words. A
distributed randomised singular value decomposition finds their leading right singular vectors: every
task multiplies its passages with a random matrix, some columns wider than wanted, and the result with
the passages again; the products are summed to A'A times the random matrix, and from these two alone a
small decomposition gives singular vectors and values, of which the weakest are cut off. Windows of
documents whose latent vectors are close to an item's by cosine are its candidates, and so are those that
hold enough of an item's rarer words, whatever their cosine. A candidate counts when the longest common
subsequence of words holds most of the item, or a good part of it together with the item's rarest words,
its answer. A stretch of text that lacks the item's rarer words can't count and isn't looked at again.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.llm.common import cut
from hirelake.llm.langid import Index as Positions

#: Latent dimensions, and columns of the random matrix beyond them; words of a passage.
DIMENSIONS, OVERSAMPLE, PASSAGE = 32, 16, 64
#: Words between window starts; window starts of a stretch that is judged at once; the cosine of a candidate.
STRIDE, STRETCH, COSINE = 16, 8, 0.5
#: Shares of an item's words in common: enough alone, and enough together with the answer's share.
SURE, LIKELY, ANSWER = 0.8, 0.6, 0.8
#: Items with fewer words match only as a whole, word after word.
WHOLE_WORDS = 5
#: Bytes of item texts that are indexed (and broadcast) at once; more items take another pass over the corpus.
BYTES_AT_ONCE = 16 << 20
#: Cells of the table of stretches and items that are judged at once, and characters or words of texts at once.
CELLS, AT_ONCE = 1 << 20, 1 << 19
#: Scripts that write without spaces: each of their characters is a word.
SPACELESS = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_SPACELESS, _MIXED, _WORD = re.compile(f"[{SPACELESS}]"), re.compile(rf"[{SPACELESS}]|[^\W{SPACELESS}]+"), re.compile(r"\w+")
#: Beyond ASCII, what is no part of a word or is a word alone.
_ODD = re.compile(rf"[^\x00-\x7f\w]|[{SPACELESS}]")
_IN_WORD = np.array([chr(b).isalnum() or b == 95 or b > 127 for b in range(256)])
#: Bytes of the longest word that is found by its hash.
_LONGEST = 255
_PARTS = 16


def words(text: str | None) -> list[str]:
    low = (text or "").lower()
    return (_WORD if low.isascii() or not _SPACELESS.search(low) else _MIXED).findall(low)


def common_length(item: dict[int, int], size: int, tokens: list[int]) -> int:
    """The length of the longest common subsequence; ``item`` has the bit mask of each word's places."""
    full = (1 << size) - 1
    row = full
    for t in tokens:
        mask = item.get(t)
        if mask is not None:
            hit = row & mask
            row = ((row + hit) | (row - hit)) & full
    return size - row.bit_count()


def grouped(sizes: list[int]) -> Iterator[range]:
    """Ranges of the sizes' places, each of AT_ONCE in sum or of one place."""
    begin, total = 0, 0
    for k, size in enumerate(sizes):
        if k > begin and total + size > AT_ONCE:
            yield range(begin, k)
            begin, total = k, 0
        total += size
    if begin < len(sizes):
        yield range(begin, len(sizes))


def pieces(text: str) -> Iterator[str]:
    """The text in pieces of about AT_ONCE characters, each but the last up to a space."""
    lo = 0
    while lo < len(text):
        hi = text.find(" ", lo + AT_ONCE)
        hi = len(text) if hi < 0 else hi + 1
        yield text[lo:hi]
        lo = hi


class Index:
    """The benchmark's items in the latent space, and what verifies a candidate."""

    def __init__(self, items: list[tuple[int, str, str | None]]) -> None:
        """items: (id, text, answer or None)."""
        self.ids, texts, answers = [], [], []
        for item, text, answer in items:
            if tokens := words(text):
                self.ids.append(item)
                texts.append(tokens)
                answers.append(words(answer))
        names = sorted({w for t in texts + answers for w in t})
        self.number = {w: k for k, w in enumerate(names, 1)}
        self.texts = [[self.number[w] for w in t] for t in texts]
        self.answers = [{self.number[w] for w in a} for a in answers]
        self.idf = np.zeros(len(names) + 1, np.float32)
        self.singular = np.zeros(0)

    def encode(self, text: str | None) -> np.ndarray:
        """The numbers of a text's words, 0 for words that no item has."""
        found = words(text)
        return np.fromiter(map(self.number.get, found, repeat(0)), np.int32, len(found))

    def _hashes(self) -> tuple[np.ndarray, np.ndarray, Positions, np.ndarray] | None:
        """Values of bytes and places, and the words' numbers by their hashes; nothing where a word is too long.

        The values are drawn until the words' own hashes differ. That of another word is one of theirs with
        a chance of their number in 2**64.
        """
        if not hasattr(self, "_found"):
            names = [w.encode("utf-8", "surrogatepass") for w in self.number]
            self._found = None
            for seed in range(9):
                draw = np.random.default_rng(seed).integers(0, 1 << 63, (2, 256), np.uint64) * np.uint64(2) + np.uint64(1)
                keys = np.array([(draw[0][np.frombuffer(w, np.uint8)] * draw[1][: len(w)]).sum(dtype=np.uint64) for w in names if len(w) <= _LONGEST], np.uint64)
                if len(keys) == len(names) and len(np.unique(keys)) == len(keys):
                    order = np.argsort(keys)
                    self._found = (draw[0], draw[1], Positions(keys[order]), np.append(order + 1, 0).astype(np.int32))
                    break
        return self._found

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """``encode`` of each text; long ones in pieces that end at a space."""
        out = []
        for group in grouped([len(t or "") for t in texts]):
            some = texts[group.start : group.stop]
            if len(some) == 1 and len(some[0] or "") > 2 * AT_ONCE:
                out.append(np.concatenate([self._encode_some([piece])[0] for piece in pieces(some[0])]))
            else:
                out += self._encode_some(some)
        return out

    def _encode_some(self, texts: list[str | None]) -> list[np.ndarray]:
        """``encode`` of each text, those of plain words all at once by the words' hashes."""
        found = self._hashes()
        low = [(t or "").lower() for t in texts]
        plain = [found is not None and (t.isascii() or not _ODD.search(t)) for t in low]
        data = "\n".join([t for t, p in zip(low, plain, strict=True) if p])
        data = np.frombuffer((data + "\n").encode("utf-8", "surrogatepass"), np.uint8)
        inside = _IN_WORD[data]
        edges = np.nonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))[0]
        starts, ends = edges[::2], edges[1::2]
        codes = np.zeros(0, np.int32)
        if len(starts):
            size = ends - starts
            place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            hashes = np.add.reduceat(found[0][data[inside]] * found[1][np.minimum(place, _LONGEST)], np.cumsum(size) - size)
            codes = found[3][found[2].find(hashes)]
        sizes = [len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass")) for t, p in zip(low, plain, strict=True) if p]
        parts = iter(np.split(codes, np.searchsorted(starts, np.cumsum([s + 1 for s in sizes])[:-1])) if sizes else [])
        return [next(parts) if p else self.encode(t) for t, p in zip(texts, plain, strict=True)]

    def finish(self, basis: np.ndarray) -> None:
        """Takes the words' latent basis and places the items."""
        self.terms = (self.idf[:, None] * basis).astype(np.float32)
        self.masks, self.rare, self.least = [], [], []
        for k, tokens in enumerate(self.texts):
            mask: dict[int, int] = {}
            for place, t in enumerate(tokens):
                mask[t] = mask.get(t, 0) | 1 << place
            self.masks.append(mask)
            rare = sorted(set(tokens), key=lambda t: (-self.idf[t], t))
            if not self.answers[k]:
                self.answers[k] = set(rare[: max(3, len(rare) // 5)])
            self._hold(k, rare)
        held = np.concatenate([w for w, _ in self.rare])
        order = np.argsort(held, kind="stable")
        #: For each word, the items that have it among their rarer words, with its places there.
        self.first = np.searchsorted(held[order], np.arange(len(self.idf) + 1))
        self.of = np.repeat(np.arange(len(self.rare)), [len(w) for w, _ in self.rare])[order]
        self.places = np.concatenate([p for _, p in self.rare])[order]
        self.least = np.array(self.least)
        vectors = np.array([self.terms[t].sum(0) for t in self.texts])
        self.vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
        #: Blocks of a window that holds the item wherever it begins.
        self.sizes = np.array([-(-(len(t) + STRIDE - 1) // STRIDE) for t in self.texts])

    def _needed(self, k: int) -> int:
        """The words of the item that a match has in common with it at least."""
        length = len(self.texts[k])
        return length if length < WHOLE_WORDS else math.ceil(LIKELY * length - 1e-9)

    def _hold(self, k: int, rare: list[int]) -> None:
        """Notes the rarer words of item ``k`` and how many of their places a window that counts covers.

        A window that counts leaves at most ``spare`` places of the item uncovered, so of words that take
        more places than that it has some, and of a fifth of the item more it has a fifth at least.
        """
        length, mask = len(self.texts[k]), self.masks[k]
        spare = length - self._needed(k)
        places = np.cumsum([mask[t].bit_count() for t in rare])
        end = int(np.searchsorted(places, min(length, spare + max(1, length // 5)))) + 1
        chosen, weights = np.array(rare[:end], np.int32), np.diff(places[:end], prepend=0)
        order = np.argsort(chosen)
        self.rare.append((chosen[order], weights[order]))
        self.least.append(int(places[end - 1]) - spare)

    def matches(self, tokens: np.ndarray, ends: np.ndarray) -> dict[int, list[tuple[int, float, float, int]]]:
        """By text number, (item id, share in common, cosine, first word of the window) of the items that it holds.

        ``tokens`` has the texts' words one text after another, ``ends`` where each text ends.
        """
        best: dict[tuple[int, int], tuple[float, float, int]] = {}
        begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        if self.ids and len(tokens):
            reach = int(self.sizes.max()) + 1
            # Stretches of a text overlap by the longest window, so that each window lies in one of them.
            counts = np.maximum(1, -(-(ends - begins) // (STRETCH * STRIDE)))
            text = np.repeat(np.arange(len(ends)), counts)
            place = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
            lo = begins[text] + place * STRETCH * STRIDE
            hi = np.minimum(lo + (STRETCH + reach) * STRIDE, ends[text])
            step = max(1, CELLS // max(len(self.ids), 1))
            for k in range(0, len(lo), step):
                for stretch, item in self._possible(tokens, np.maximum(lo[k : k + step] - STRIDE, begins[text[k : k + step]]), hi[k : k + step]):
                    self._search(tokens, int(begins[text[k + stretch]]), int(ends[text[k + stretch]]), int(lo[k + stretch]), item, best, int(text[k + stretch]))
        out: dict[int, list] = {}
        for (number, item), found in sorted(best.items()):
            out.setdefault(number, []).append((self.ids[item], *found))
        return out

    def _possible(self, tokens: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[int, int]]:
        """The (stretch, item) pairs in which the item can count, by its rarer words."""
        length = hi - lo
        of = np.repeat(np.arange(len(lo)), length)
        words_ = tokens[np.arange(len(of)) - np.repeat(np.cumsum(length) - length, length) + np.repeat(lo, length)]
        # Words that no item has among its rarer ones say nothing.
        useful = self.first[words_ + 1] > self.first[words_] if len(words_) else np.zeros(0, bool)
        pair = np.sort(of[useful] * np.int64(len(self.idf)) + words_[useful])
        pair = pair[np.concatenate([[True], pair[1:] != pair[:-1]])] if len(pair) else pair
        of, words_ = pair // len(self.idf), pair % len(self.idf)
        count = self.first[words_ + 1] - self.first[words_]
        at = np.repeat(self.first[words_] - np.cumsum(count) + count, count) + np.arange(count.sum())
        sums = np.bincount(np.repeat(of, count) * len(self.ids) + self.of[at], self.places[at], len(lo) * len(self.ids))
        return zip(*np.nonzero(sums.reshape(len(lo), -1) >= self.least), strict=True)

    def _search(self, tokens: np.ndarray, begin: int, end: int, lo: int, item: int, best: dict, number: int) -> None:
        """Looks for the item in the windows that begin in one stretch of a text."""
        size, length, mask = int(self.sizes[item]), len(self.texts[item]), self.masks[item]
        # A block before the stretch and the windows' blocks after it.
        first, last = max(begin, lo - STRIDE), min(end, lo + (STRETCH + size + 1) * STRIDE)
        part = tokens[first:last]
        if self._common(mask, part) < self._needed(item):
            return
        starts = np.arange(lo, min(lo + STRETCH * STRIDE, max(end, lo + 1)), STRIDE)
        blocks = np.zeros((-(-len(part) // STRIDE), STRIDE), np.int32)
        blocks.ravel()[: len(part)] = part
        rare, weights = self.rare[item]
        where = np.minimum(np.searchsorted(rare, blocks), len(rare) - 1)
        places = np.concatenate([[0], np.cumsum(np.where(rare[where] == blocks, weights[where], 0).sum(1))])
        begin_block = (starts - first) // STRIDE
        end_block = np.minimum(begin_block + size, len(blocks))
        held = places[np.minimum(end_block + 1, len(blocks))] - places[np.maximum(begin_block - 1, 0)] >= self.least[item]
        sums = np.zeros((len(blocks) + 1, DIMENSIONS))
        np.cumsum(self.terms[blocks].sum(1), axis=0, out=sums[1:])
        window = sums[end_block] - sums[begin_block]
        cos = window @ self.vectors[item] / np.maximum(np.sqrt((window * window).sum(1)), 1e-9)
        for w in np.nonzero((cos >= COSINE) | held)[0]:
            at = int(starts[w])
            inside = tokens[max(begin, at - STRIDE) : min(end, at + (size + 1) * STRIDE)]
            share = self._share(item, inside, length, mask)
            if share > best.get((number, item), (0.0,))[0]:
                best[number, item] = (share, float(cos[w]), at - begin)

    @staticmethod
    def _common(mask: dict[int, int], part: np.ndarray) -> int:
        """The item's places whose word is in the part: no common subsequence is longer."""
        return sum([mask[t].bit_count() for t in mask.keys() & set(part.tolist())])

    def _share(self, item: int, inside: np.ndarray, length: int, mask: dict[int, int]) -> float:
        """The share of the item's words that the window has in common with it; 0 when it doesn't count."""
        if length < WHOLE_WORDS:
            whole = np.array(self.texts[item], np.int32).tobytes()
            data, at = inside.tobytes(), -1
            while (at := data.find(whole, at + 1)) >= 0:
                if at % 4 == 0:
                    return 1.0
            return 0.0
        if self._common(mask, inside) < self._needed(item):
            return 0.0
        part = inside[inside > 0].tolist()
        share = common_length(mask, length, part) / length
        if share < LIKELY or share < SURE and len(self.answers[item].intersection(part)) < ANSWER * len(self.answers[item]):
            return 0.0
        return share


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words of the items, number of their passage) of some thousand passages at a time."""
    held, kept, passages = [], [], 0
    for batch in batches:
        for value in batch.column(0):
            tokens = np.frombuffer(value.as_buffer(), np.int32)
            inside = np.nonzero(tokens)[0]
            held.append(tokens[inside])
            kept.append(inside // PASSAGE + passages)
            passages += len(tokens) // PASSAGE + 1
            if passages >= 4096:
                if sum(map(len, held)):
                    yield np.concatenate(held), np.concatenate(kept)
                held, kept, passages = [], [], 0
    if sum(map(len, held)):
        yield np.concatenate(held), np.concatenate(kept)


def _firsts(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.nonzero(np.concatenate([[True], values[1:] != values[:-1]]))[0]


def summed(coded: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], np.ndarray], rows: int, columns: int) -> np.ndarray:
    """The sum over all tasks of the matrix that each makes of its texts, added up in parts by rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = work(batches)
        yield pa.RecordBatch.from_arrays([pa.array(range(_PARTS), pa.int32()), pa.array([total[p::_PARTS].tobytes() for p in range(_PARTS)], pa.binary())], ["part", "sums"])

    def add_up(table: pa.Table) -> pa.Table:
        sums = sum(np.frombuffer(s.as_buffer()) for s in table.column("sums"))
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "sums": pa.array([sums.tobytes()], pa.binary())})

    total = np.zeros((rows, columns))
    for r in coded.mapInArrow(run, "part int, sums binary").groupBy("part").applyInArrow(add_up, "part int, sums binary").collect():
        total[r.part :: _PARTS] = np.frombuffer(r.sums).reshape(-1, columns)
    return total


def build(coded: DataFrame, index: Index) -> Index:
    """Finishes the index from the corpus: (tokens binary) rows of every document's word numbers."""
    spark, size, wide = coded.sparkSession.sparkContext, len(index.idf), DIMENSIONS + OVERSAMPLE

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, texts = np.zeros(size, np.int64), 0
        for batch in batches:
            for tokens in batch.column(0):
                seen[np.unique(np.frombuffer(tokens.as_buffer(), np.int32))] += 1
            texts += batch.num_rows
        # Word 0 is none of the items'; its row counts the texts.
        seen[0] = texts
        term = np.nonzero(seen)[0]
        yield pa.RecordBatch.from_arrays([pa.array(term.astype(np.int32)), pa.array(seen[term])], ["term", "n"])

    seen = np.zeros(size)
    for r in coded.mapInArrow(frequencies, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        seen[r.term] = r.n
    # A word that every document has keeps a weight, or a frequent item's words would all have none.
    index.idf = np.log(1 + (seen[0] + 1) / (seen + 1)).astype(np.float32)
    index.idf[0] = 0
    idf = spark.broadcast(index.idf)

    def products(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        """A'(A random), and below it the squares of A random, whose mean tells the size of A."""
        matrix = np.random.default_rng(11).normal(size=(size, wide)).astype(np.float32) * idf.value[:, None]
        total = np.zeros((size + 1, wide))
        for tokens, passage in _passages(batches):
            first = _firsts(passage)
            rows = np.add.reduceat(matrix[tokens], first, axis=0)
            of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(passage))))
            # Numbers of 16 bits are sorted by radix.
            order = np.argsort(tokens.astype(np.uint16) if size <= 1 << 16 else tokens, kind="stable")
            start = _firsts(tokens[order])
            total[tokens[order][start]] += np.add.reduceat(rows[of[order]], start, axis=0)
            total[size] += (rows.astype(np.float64) ** 2).sum(0)
        return total

    total = summed(coded, products, size + 1, wide)
    # The items are passages too. Both parts weigh the same, lest frequent words of the corpus leave no
    # room for an item's own words in the basis.
    weight = index.idf.astype(np.float64)

    def own(matrix: np.ndarray) -> np.ndarray:
        return np.array([(weight[t, None] * matrix[t]).sum(0) / max(1e-12, math.sqrt(float((weight[t] ** 2).sum()))) for t in index.texts])

    random = np.random.default_rng(11).normal(size=(size, wide))
    drawn, mine = own(random), np.zeros((size, wide))
    for t, row in zip(index.texts, drawn, strict=True):
        np.add.at(mine, t, weight[t, None] * row / max(1e-12, math.sqrt(float((weight[t] ** 2).sum()))))
    corpus_scale, item_scale = max(1e-12, float(total[size].mean())), max(1e-12, float((drawn**2).sum(0).mean()))
    basis, index.singular = decomposed(weight[:, None] * total[:size] / corpus_scale + mine / item_scale, random)
    index.finish(basis)
    idf.destroy()
    return index


def decomposed(product: np.ndarray, random: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The leading right singular vectors and singular values of A, from A'A ``random``.

    The small matrix random'(A'A)random is inverted on its range, which gives a factor of A'A as wide as
    ``random``; its singular value decomposition is cut off after DIMENSIONS columns. Missing ones are zero.
    """
    values, vectors = np.linalg.eigh((random.T @ product + product.T @ random) / 2)
    good = values > 1e-10 * max(1e-300, float(values.max()))
    factor = product @ (vectors[:, good] / np.sqrt(values[good]))
    left, singular, _ = np.linalg.svd(factor, full_matrices=False)
    left, singular = left[:, :DIMENSIONS], singular[:DIMENSIONS]
    missing = DIMENSIONS - len(singular)
    return np.pad(left, ((0, 0), (0, missing))), np.pad(singular, (0, missing))


def _indexes(docs: DataFrame, items: DataFrame, text_col: str) -> Iterator[tuple[Index, DataFrame]]:
    """A finished index of the items, with the documents' word numbers (id, tokens).

    A benchmark of more than BYTES_AT_ONCE bytes comes in blocks of about that size.
    """
    total = items.agg(F.sum(F.octet_length("text") + F.coalesce(F.octet_length("answer"), F.lit(0)))).first()[0] or 0
    blocks = -(-total // BYTES_AT_ONCE)
    for k in range(blocks):
        index = Index([tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()])
        if not index.ids:
            continue
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def encode(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                coded = [c.tobytes() for c in shared.value.encode_all(batch.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(coded, pa.binary())], ["id", "tokens"])

        coded = cut(docs.select("id", F.col(text_col).cast("string").alias("text")).mapInArrow(encode, "id long, tokens binary"), "word-numbers")
        shared.destroy()
        yield build(coded.select("tokens"), index), coded


def _joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.zeros(0, np.int32), *texts]), np.cumsum([len(t) for t in texts])


def _items(benchmark: DataFrame) -> DataFrame:
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"), answer.alias("answer"))


def find_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, overlap, cosine, start_word) of each benchmark item that a document holds.

    Documents without any are not in the result. ``overlap`` is the share of the item's words in the
    longest common subsequence with the best window. The benchmark may have an ``answer`` column; else an
    item's rarest words stand for it. Items of fewer than five words match where all of their words stand
    in a row. In scripts without spaces each character is a word. Items without a word, null texts and
    empty ones match nothing; a null id stays null; repeated rows repeat their matches; other columns are
    ignored. Texts are searched whole, and word statistics cover all documents. Empty tables give an
    empty result.
    """
    schema = "id long, item_id long, overlap double, cosine double, start_word long"
    found = []
    for index, coded in _indexes(docs.select(F.col(id_col).cast("long").alias("id"), text_col), _items(benchmark), text_col):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, texts, out = batch.column(0).to_pylist(), [np.frombuffer(t.as_buffer(), np.int32) for t in batch.column(1)], []
                for group in grouped([len(t) for t in texts]):
                    found = shared.value.matches(*_joined(texts[group.start : group.stop]))
                    out += [(ids[group.start + k], *m) for k, ms in found.items() for m in ms]
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], k) for c, k in enumerate(kinds)], ["id", "item_id", "overlap", "cosine", "start_word"])

        found.append(coded.mapInArrow(run, schema))
    if not found:
        return docs.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    return reduce(DataFrame.unionByName, found).withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) that hold no benchmark item, with all columns."""
    kept = docs
    for index, _ in _indexes(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), _items(benchmark), "text"):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, dirty = batch.column("text").to_pylist(), set()
                for group in grouped([len(t or "") for t in texts]):
                    found = shared.value.matches(*_joined(shared.value.encode_all(texts[group.start : group.stop])))
                    dirty.update(group.start + k for k in found)
                yield batch.filter(pa.array([k not in dirty for k in range(batch.num_rows)], pa.bool_()))

        kept = kept.mapInArrow(run, docs.schema)
    return kept
